"""Sum-of-squares packing of tokenised documents into sequences.

Where a document's remainder goes is decided online: of all fill levels that have an open window with room (and level
0, a new window), the one after which the sum of the squared numbers of windows at each level is least.

First each task packs the rows of its own partition; full sequences leave at once. What is in open windows at its end
is dealt to fewer tasks and packed by the same rule, and so on until one task is left, so that the last windows are
chosen among the rests of all partitions. Only there are windows filled up by cutting: the emptiest ones are taken apart
for the gaps of the fullest, and the last rest goes into sequences of powers of two. Nothing is padded.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
CAPACITY, SEPARATOR = 1024, 0
#: Ids of open windows, about, that one task of a later round packs: 32 MB.
TASK_IDS = 1 << 23
#: Pieces in one output batch, at most.
ROWS = 2048


def _byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte: itself, or the next free one from U+0100."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> tiktoken.Encoding:
    """The ids that the tokenizers library gives for a byte-level vocabulary file, by the faster core of tiktoken.

    Ids of such a vocabulary follow the order of its merges, so that they serve as ranks. Added tokens, special or not,
    are cut out of a text first, each as its one id, as tokenizers does.
    """
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    added = {x["content"]: x["id"] for x in model.get("added_tokens", ())}
    if bent := [x["content"] for x in model.get("added_tokens", ()) if x.get("single_word") or x.get("lstrip") or x.get("rstrip")]:
        raise ValueError(f"added tokens that also match what stands around them aren't supported: {bent}")
    letters = _byte_letters()
    ranks = {bytes(letters[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in added}
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)


class Packer:
    """Puts pieces (doc, start, doc_tokens, ids) into windows of ``capacity`` ids; ``done`` gets lists of those of full windows."""

    def __init__(self, capacity: int):
        self.capacity, self.done = capacity, []
        self.count = np.zeros(capacity + 1, np.int64)  # open windows by fill level
        self.open: dict[int, list[list]] = {}

    def level_for(self, size: int) -> int:
        """The fill level to place ``size`` ids on: the least growth of the sum of squares, the fullest of equals."""
        c, count = self.capacity, self.count
        growth = 2 * (count[size:c] - count[: c - size] + 1)  # from level h to h + size, both open
        growth[0] = 2 * count[size] + 1  # a new window
        usable = count[: c - size] > 0
        usable[0] = True
        growth = np.where(usable, growth, np.iinfo(np.int64).max)
        best = len(growth) - 1 - int(np.argmin(growth[::-1]))
        full = count[c - size]
        return c - size if full and 1 - 2 * full <= growth[best] else best

    def add(self, doc, start: int, total: int, ids: np.ndarray) -> None:
        c = self.capacity
        whole = len(ids) - len(ids) % c
        for at in range(0, whole, c):
            self.done.append([(doc, start + at, total, ids[at : at + c])])
        size = len(ids) - whole
        if not size:
            return
        level = self.level_for(size)
        window = []
        if level:
            window = self.open[level].pop()
            self.count[level] -= 1
        window.append((doc, start + whole, total, ids[whole:].copy()))
        if level + size == c:
            self.done.append(window)
        else:
            self.open.setdefault(level + size, []).append(window)
            self.count[level + size] += 1

    def take(self) -> list[list]:
        """The open windows, fullest first; none stays open."""
        windows = [w for level in sorted(self.open, reverse=True) for w in self.open[level]]
        self.open = {}
        self.count[:] = 0
        return windows

    def finish(self) -> int:
        """Fills the open windows with what is in the emptiest of them; gives how many ids have been moved to do so."""
        windows, moved = self.take(), 0
        at = 0
        while at < len(windows):
            gap = self.capacity - sum(len(p[3]) for p in windows[at])
            while gap and len(windows) > at + 1:
                doc, start, total, ids = windows[-1].pop()
                n = min(gap, len(ids))
                windows[at].append((doc, start, total, ids[:n]))
                if n < len(ids):
                    windows[-1].append((doc, start + n, total, ids[n:]))
                if not windows[-1]:
                    windows.pop()
                gap, moved = gap - n, moved + n
            if gap:  # the last one
                break
            self.done.append(windows[at])
            at += 1
        for window in windows[at:]:
            moved += sum(len(p[3]) for p in window)
            self.halve(window)
        return moved

    def halve(self, pieces: list) -> None:
        """Cuts less than a full window into sequences of powers of two, the longest first."""
        left = sum(len(p[3]) for p in pieces)
        room, window = 0, []
        for doc, start, total, ids in pieces:
            while len(ids):
                room = room or 1 << (left.bit_length() - 1)
                n = min(room, len(ids))
                window.append((doc, start, total, ids[:n]))
                start, ids, room, left = start + n, ids[n:], room - n, left - n
                if not room:
                    self.done.append(window)
                    window = []


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN, capacity: int = CAPACITY, separator: int = SEPARATOR) -> DataFrame:
    """A row for each piece: id, start, length, ids (packed little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A document is its ids and ``separator``; a null or empty text is the separator alone. Rows are packed each on its
    own: repeated rows repeat, null ids stay, an empty table has no pieces, and other columns are not read. sequence_id
    is the round times 2^53, the partition's number times 2^33 and the place of the sequence there. A task holds the
    ids of its open windows, at most those of its partition. Rounds are written to the shared folder.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def tokenised(batch: pa.RecordBatch) -> Iterator[tuple]:
        enc = tokenizer(vocabulary, pattern)
        for doc, text in zip(batch.column("id"), batch.column("text"), strict=True):
            ids = enc.encode_to_numpy(text.as_py() or "", allowed_special="all")
            yield doc.as_py(), 0, len(ids) + 1, np.append(ids, ids.dtype.type(separator))

    def rests(batch: pa.RecordBatch) -> Iterator[tuple]:
        for doc, start, total, ids in zip(*(batch.column(c) for c in ("id", "start", "doc_tokens", "ids")), strict=True):
            yield doc.as_py(), start.as_py(), total.as_py(), np.frombuffer(ids.as_py(), "<u4")

    def packing(turn: int, last: bool, pieces: Callable[[pa.RecordBatch], Iterator[tuple]]) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            packer, rows, sequence = Packer(capacity), [], (turn << 53) + (TaskContext.get().partitionId() << 33)
            id_type = None

            def out() -> pa.RecordBatch:
                types = [id_type, pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 3]
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                rows.clear()
                return pa.RecordBatch.from_arrays(cols, names=["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

            def put(window: list, number: int | None) -> None:
                offset = 0
                for doc, start, total, ids in window:
                    rows.append((doc, start, len(ids), ids.astype("<u4").tobytes(), total, number, None if number is None else offset))
                    offset += len(ids)

            def drain() -> Iterator[pa.RecordBatch]:
                nonlocal sequence
                for window in packer.done:
                    put(window, sequence)
                    sequence += 1
                    if len(rows) >= ROWS:
                        yield out()
                packer.done.clear()

            for batch in batches:
                id_type = batch.column("id").type
                for piece in pieces(batch):
                    packer.add(*piece)
                    yield from drain()
            if last:
                packer.finish()
                yield from drain()
            for window in packer.take():
                put(window, None)
                if len(rows) >= ROWS:
                    yield out()
            if rows:
                yield out()

        return run

    schema = f"id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    packed = written(rows.mapInArrow(packing(0, False, tokenised), schema), "packed")
    done, before = [packed.where("sequence_id is not null")], None
    while n := packed.where("sequence_id is null").agg(F.sum("length")).first()[0]:
        tasks = -(-n // TASK_IDS)
        last = tasks == 1 or (before is not None and 2 * n > before)  # where pieces fit nowhere, dealing them anew is of no use
        packed = written(packed.where("sequence_id is null").repartition(tasks).mapInArrow(packing(len(done), last, rests), schema), "packed")
        done, before = [*done, packed.where("sequence_id is not null")], n
    return reduce(DataFrame.union, done).withColumnRenamed("id", id_col)
