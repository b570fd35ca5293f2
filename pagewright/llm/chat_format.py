"""Chat formatting: schema fingerprints select a declarative mapping to canonical turns; a reversible template follows.

A record is JSON in any of several layouts. The set of its nested field paths, less what no mapping knows, is hashed;
the hash selects the mapping, which says where role and text of each turn are found. Turns are then written with
control strings around them. Text can't forge a turn: control strings inside it get a backslash, which reading back
removes.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Mapping:
    """A layout. ``turns`` of single fields: (path, role) in order; or ``items``, a list with fields ``role`` and ``text``."""

    name: str
    turns: tuple[tuple[str, str], ...] = ()
    items: str = ""
    role: str = ""
    text: str = ""
    roles: tuple[tuple[str, str], ...] = ()  # names of roles in this layout, and the canonical ones

    def paths(self) -> frozenset[str]:
        return frozenset(p for p, _ in self.turns) if self.turns else frozenset((f"{self.items}[].{self.role}", f"{self.items}[].{self.text}"))

    def read(self, record: dict) -> list[tuple[str, str]]:
        if self.turns:
            return [(role, str(_at(record, path) or "")) for path, role in self.turns]
        names = dict(self.roles)
        return [(names.get(r := str(x.get(self.role) or ""), r), str(x.get(self.text) or "")) for x in _at(record, self.items) or [] if isinstance(x, dict)]


def _at(record: dict, path: str):
    for key in path.split("."):
        record = record.get(key) if isinstance(record, dict) else None
    return record


_SHARED = (("human", "user"), ("gpt", "assistant"))
MAPPINGS = (
    Mapping("prompt_completion", turns=(("prompt", "user"), ("completion", "assistant"))),
    Mapping("prompt_response", turns=(("prompt", "user"), ("response", "assistant"))),
    Mapping("question_answer", turns=(("question", "user"), ("answer", "assistant"))),
    Mapping("instruction", turns=(("instruction", "user"), ("output", "assistant"))),
    Mapping("instruction_input", turns=(("instruction", "system"), ("input", "user"), ("output", "assistant"))),
    Mapping("nested_prompt", turns=(("data.prompt", "user"), ("data.response", "assistant"))),
    Mapping("messages", items="messages", role="role", text="content"),
    Mapping("shared", items="conversations", role="from", text="value", roles=_SHARED),
    Mapping("turns", items="turns", role="speaker", text="text", roles=_SHARED),
)


def field_paths(value: object, at: str = "") -> set[str]:
    """The paths of all leaves of a record; ``[]`` stands for the items of a list."""
    if isinstance(value, dict) and value:
        return set().union(*(field_paths(v, f"{at}.{k}" if at else k) for k, v in value.items()))
    if isinstance(value, list) and value:
        return set().union(*(field_paths(v, f"{at}[]") for v in value))
    return {at}


def schema_fingerprint(paths: Sequence[str] | set[str] | frozenset[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def registry(mappings: Sequence[Mapping]) -> tuple[dict[str, Mapping], frozenset[str]]:
    """Mappings by fingerprint, and all paths that any of them knows."""
    return {schema_fingerprint(m.paths()): m for m in mappings}, frozenset().union(*(m.paths() for m in mappings))


def read_record(text: str | None, known: dict[str, Mapping], paths: frozenset[str]) -> tuple[str | None, str | None, list[tuple[str, str]] | None]:
    """Fingerprint, layout and turns of one record."""
    try:
        record = json.loads(text) if text is not None else None
    except ValueError:
        record = None
    if not isinstance(record, dict):
        return None, None, None
    print_ = schema_fingerprint(field_paths(record) & paths)
    m = known.get(print_)
    return print_, m and m.name, m and m.read(record)


def _structs(turns: Sequence[tuple[str, str]]) -> list[dict[str, str]]:
    return [{"role": r, "text": t} for r, t in turns]


def canonical_turns(records: DataFrame, id_col: str, json_col: str, mappings: Sequence[Mapping] = MAPPINGS) -> DataFrame:
    """For each row its id, fingerprint, layout and turns (array of role and text).

    Paths that no mapping knows don't count, so that extra fields change nothing. A record of a layout that isn't
    known, or that isn't a JSON object, or null, has a null layout and null turns. Null texts and roles are empty.
    """
    known, paths = registry(mappings)
    kind = records.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(a, b, turns and _structs(turns)) for a, b, turns in (read_record(text, known, paths) for text in pdf["record"])]
            yield pd.DataFrame({"id": pdf["id"], "fingerprint": [x[0] for x in out], "layout": [x[1] for x in out], "turns": [x[2] for x in out]})

    rows = records.select(F.col(id_col).alias("id"), F.col(json_col).alias("record"))
    return rows.mapInPandas(run, f"id {kind}, fingerprint string, layout string, turns array<struct<role:string,text:string>>").withColumnRenamed("id", id_col)


#: Control strings of the template, opening and closing, by role; other roles are named inside the last pair.
CONTROLS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[TURN]", "[:]", "[/TURN]")
_ALL = [*(c for pair in CONTROLS.values() for c in pair), *OTHER]
_CONTROL = "|".join(re.escape(c[1:]) for c in sorted(_ALL, key=len, reverse=True))
_ESCAPE = re.compile(rf"([<\[])(\\*)({_CONTROL})")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)({_CONTROL})")
_TURN = re.compile("|".join([*(f"{re.escape(a)}(?P<{role}>.*?){re.escape(b)}" for role, (a, b) in CONTROLS.items()), rf"{re.escape(OTHER[0])}(?P<role>.*?){re.escape(OTHER[1])}(?P<text>.*?){re.escape(OTHER[2])}"]), re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def format_turns(turns: Sequence[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and its loss mask: (start, length) in code points of every text of role ``learn``."""
    out, spans, at = [], [], 0
    for role, text in turns:
        before, after = CONTROLS.get(role, (OTHER[0] + escape(role) + OTHER[1], OTHER[2]))
        body = escape(text)
        if role == learn:
            spans.append((at + len(before), len(body)))
        piece = before + body + after
        out.append(piece)
        at += len(piece)
    return "".join(out), spans


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation; the inverse of ``format_turns``. ValueError if it isn't one."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        role = next((r for r in CONTROLS if m[r] is not None), None)
        turns.append((unescape(m["role"]), unescape(m["text"])) if role is None else (role, unescape(m[role])))
        at = m.end()
    return turns


def masked(formatted: str, spans: Sequence[tuple[int, int]]) -> list[str]:
    """The unescaped text under every span of the loss mask."""
    return [unescape(formatted[a : a + n]) for a, n in spans]


def format_conversations(canonical: DataFrame, id_col: str, turns_col: str = "turns") -> DataFrame:
    """For each row its id, formatted (text) and loss (array of start and length in code points). Null turns give nulls."""
    kind = canonical.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = [(None, None) if turns is None else format_turns([(t["role"] or "", t["text"] or "") for t in turns]) for turns in pdf["turns"]]
            loss = [None if spans is None else [{"start": a, "length": n} for a, n in spans] for _, spans in done]
            yield pd.DataFrame({"id": pdf["id"], "formatted": [x[0] for x in done], "loss": loss})

    rows = canonical.select(F.col(id_col).alias("id"), F.col(turns_col).alias("turns"))
    return rows.mapInPandas(run, f"id {kind}, formatted string, loss array<struct<start:long,length:long>>").withColumnRenamed("id", id_col)


def read_back(formatted: DataFrame, id_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """From formatted and loss alone: id, turns, and loss_texts, the unescaped text under every span of the mask.

    Columns named in ``keep`` are passed on.
    """
    kind = formatted.schema[id_col].dataType.simpleString()
    more = "".join(f", {c} {formatted.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            turns = [None if x is None else _structs(parse_turns(x)) for x in pdf["formatted"]]
            texts = [None if x is None else masked(x, [(s["start"], s["length"]) for s in spans]) for x, spans in zip(pdf["formatted"], pdf["loss"], strict=True)]
            yield pd.DataFrame({"id": pdf["id"], "turns": turns, "loss_texts": texts} | {c: pdf[c] for c in keep})

    rows = formatted.select(F.col(id_col).alias("id"), "formatted", "loss", *keep)
    return rows.mapInPandas(run, f"id {kind}, turns array<struct<role:string,text:string>>, loss_texts array<string>{more}").withColumnRenamed("id", id_col)


#: Records that ``format_records`` holds at once.
HELD = 256


def format_records(records: DataFrame, id_col: str, json_col: str, mappings: Sequence[Mapping] = MAPPINGS) -> DataFrame:
    """``canonical_turns``, ``format_conversations`` and ``read_back`` of JSON records in one step, so that a task has one Python worker.

    id, fingerprint, layout, formatted and loss; turns and loss_texts as read back from these two. Null where the layout isn't known.
    """
    known, paths = registry(mappings)
    kind = records.schema[id_col].dataType.simpleString()
    turn, span = pa.struct([("role", pa.string()), ("text", pa.string())]), pa.struct([("start", pa.int64()), ("length", pa.int64())])
    own = [("fingerprint", pa.string()), ("layout", pa.string()), ("formatted", pa.string()), ("loss", pa.list_(span)), ("turns", pa.list_(turn)), ("loss_texts", pa.list_(pa.string()))]

    def row(text: str | None) -> tuple:
        print_, layout, turns = read_record(text, known, paths)
        if turns is None:
            return print_, layout, None, None, None, None
        formatted, spans = format_turns(turns)
        return print_, layout, formatted, [{"start": a, "length": n} for a, n in spans], _structs(parse_turns(formatted)), masked(formatted, spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([batch.schema.field("id"), *own])
            for part in (batch.slice(at, HELD) for at in range(0, len(batch), HELD)):
                columns = zip(*map(row, part["record"].to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([part["id"], *[pa.array(c, t) for c, (_, t) in zip(columns, own, strict=True)]], schema=schema)

    rows = records.select(F.col(id_col).alias("id"), F.col(json_col).alias("record"))
    done = rows.mapInArrow(run, f"id {kind}, fingerprint string, layout string, formatted string, loss array<struct<start:long,length:long>>, turns array<struct<role:string,text:string>>, loss_texts array<string>")
    return done.withColumnRenamed("id", id_col)


def conversation_records(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", mappings: Sequence[Mapping] = MAPPINGS) -> DataFrame:
    """Rows by turn as one JSON record for each conversation, in one of the layouts that can hold its roles.

    Which one, a hash of the id says, so that a table of uniform rows becomes one of heterogeneous records. Turns are in
    the order of ``turn``, then role and text; repeated rows repeat. Null roles and texts are empty; rows with a null
    id make one conversation with a null id. A conversation must fit in a row.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("content"))
    convs = rows.groupBy(F.col(id_col).alias("_id")).agg(F.array_sort(F.collect_list(turn)).alias("t"))
    own = F.transform("t", lambda x: x["role"])

    def tree(fields: dict[tuple[str, ...], Column]) -> Column:
        """A struct of the fields by their paths."""
        heads = dict.fromkeys(path[0] for path in fields)
        return F.struct(*[(fields[(h,)] if (h,) in fields else tree({p[1:]: c for p, c in fields.items() if p[0] == h})).alias(h) for h in heads])

    def fits(m: Mapping) -> Column:
        if m.turns:
            return own == F.array(*[F.lit(role) for _, role in m.turns])
        return ~F.arrays_overlap(own, F.array(*[F.lit(name) for name, _ in m.roles])) if m.roles else F.lit(True)

    def record(m: Mapping) -> Column:
        if m.turns:
            return F.to_json(tree({tuple(path.split(".")): F.get("t", F.lit(i))["content"] for i, (path, _) in enumerate(m.turns)}))
        name = lambda role: F.coalesce(*[F.when(role == mine, F.lit(theirs)) for theirs, mine in m.roles], role)
        items = F.transform("t", lambda x: F.struct(name(x["role"]).alias(m.role), x["content"].alias(m.text)))
        return F.to_json(tree({tuple(m.items.split(".")): items}))

    able = F.array_compact(F.array(*[F.when(fits(m), F.lit(i)) for i, m in enumerate(mappings)]))
    convs = convs.withColumn("_able", able)
    chosen = F.get("_able", F.pmod(F.xxhash64(F.col("_id").cast("string")), F.size("_able")).cast("int"))
    records = F.coalesce(*[F.when(F.col("_layout") == i, record(m)) for i, m in enumerate(mappings)])
    return convs.withColumn("_layout", chosen).select(F.col("_id").alias(id_col), records.alias("record"))
