"""WARC archives of page captures, and an external merge of their index.

Writing: tasks append one gzip member a record to archives in the shared folder. Beside each archive lie the index rows
of its records as runs, files of blocks sorted by URL key, timestamp and id. What a job carries on is one row a block.
Merging: while there are more runs than a task can have open, groups of runs are merged into longer ones. Then the key
is cut into ranges; each task merges the blocks of its range from all runs with a loser tree, holding one block a run,
and all ranges together are the capture histories in global order. Reading: tasks stream archives record by record.

Captures of equal payloads are stored once: that with the smallest id as a response, the others as revisits.
"""

from __future__ import annotations

import uuid
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch_path, written

#: Payloads below this many bytes are always stored whole.
LEAST_BYTES = 100
#: Compressed bytes after which a task begins another archive; index rows after which it ends a run, and rows of a block.
ARCHIVE_BYTES, RUN_ROWS, BLOCK_ROWS = 64 << 20, 50_000, 2_000
#: Runs that a task merges at once, about, and rows of a range, about.
FAN_IN, RANGE_ROWS = 64, 200_000
#: Blocks among whose first keys the ranges are cut: those with the smallest hashes. More of them would only even out ranges.
MOST_CUTS = 20_000
LEVEL = 1
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: Column) -> Column:
    """A URL's sort key: host labels in reverse, then path and query; no scheme, user, port or fragment, lower case."""
    u = F.lower(F.coalesce(url, F.lit("")))
    host = F.regexp_extract(u, r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    rest = F.regexp_extract(u, r"^(?:[a-z][a-z0-9+.-]*://[^/?#]*)?([^#]*)", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)


def classify(captures: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """``captures`` (id, payload, ...) with payload_digest, record_type and refers_to.

    Only ids and digests meet by digest, so that a payload of many captures gathers no payloads in one task; payloads
    are dealt by id.
    """
    rows = captures.withColumn("payload_digest", F.sha2("payload", 256))
    prints = rows.where(F.octet_length("payload") >= least).select("id", "payload_digest")
    first = prints.groupBy("payload_digest").agg(F.min("id").alias("refers_to"), F.max("id").alias("last")).where("refers_to < last").drop("last")
    again = prints.join(first.hint("merge"), "payload_digest").where("refers_to < id").distinct()
    out = rows.join(again.hint("merge"), ["id", "payload_digest"], "left")
    return out.withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))


def record(kind: str, id_: object, uri: str | None, date: str, digest: str, payload: bytes, refers_to: object = None) -> bytes:
    """One record. A revisit has the HTTP headers of its payload, with the payload's length, but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = [f"WARC/1.1\r\nWARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{id_}>", f"WARC-Date: {date}"]
    if uri:
        head.append("WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if kind == "revisit":
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Headers in lower case, and block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    return headers | {"block": rest[: int(headers["content-length"])]}


#: One row a block of a run: the run's file, how many rows it has, and the first and last key of the block.
_KEY = "url_key string, date string, id long, file string, at long"
_BLOCKS = f"run string, block int, n_rows long, first struct<{_KEY}>, last struct<{_KEY}>, archive string"
_FIELDS = ("url_key", "date", "id", "file", "at", "size")
_TYPES = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
_RUN_SCHEMA = pa.schema(list(zip(_FIELDS, _TYPES, strict=True)))
_KEY_TYPE = pa.struct(list(_RUN_SCHEMA)[:5])
_BLOCK_SCHEMA = pa.schema([("run", pa.string()), ("block", pa.int32()), ("n_rows", pa.int64()), ("first", _KEY_TYPE), ("last", _KEY_TYPE), ("archive", pa.string())])


class _RunWriter:
    """Writes sorted index rows as a run in the shared folder; ``blocks`` has what the job carries on."""

    def __init__(self, store: fs.FileSystem, path: str, archive: str | None = None):
        self.name, self.blocks, self.archive, self.rows = f"{uuid.uuid4().hex}.run", [], archive, []
        self.out = store.open_output_stream(f"{path}/{self.name}", compression=None)
        self.ipc = pa.ipc.new_file(self.out, _RUN_SCHEMA)

    def add(self, row: Sequence) -> None:
        self.rows.append(row)
        if len(self.rows) >= BLOCK_ROWS:
            self._flush()

    def _flush(self) -> None:
        self.ipc.write_batch(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*self.rows, strict=True), _TYPES, strict=True)], schema=_RUN_SCHEMA))
        key = lambda r: dict(zip(_FIELDS[:5], r[:5], strict=True))
        self.blocks.append({"run": self.name, "block": len(self.blocks), "n_rows": len(self.rows), "first": key(self.rows[0]), "last": key(self.rows[-1]), "archive": self.archive})
        self.rows = []

    def close(self) -> list[dict]:
        if self.rows:
            self._flush()
        self.ipc.close()
        self.out.close()
        return self.blocks


def write_archives(captures: DataFrame, folder: str, run_rows: int = RUN_ROWS) -> DataFrame:
    """Writes classified captures (id, url, url_key, date, ...) and the runs of their index; gives a row for each block of a run.

    Archives and runs have names of their own for each attempt of a task, and blocks name only those of attempts that
    ended well; what a lost executor left behind is never read. The blocks are a table in the shared folder.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        out, name, at, rows = None, "", 0, []

        def index() -> pa.RecordBatch:
            writer = _RunWriter(store, path, name)
            for row in sorted(rows, key=_key):
                writer.add(row)
            rows.clear()
            return pa.RecordBatch.from_pylist(writer.close(), _BLOCK_SCHEMA)

        for batch in batches:
            for x in (r for start in range(0, batch.num_rows, 256) for r in batch.slice(start, 256).to_pylist()):
                if out is None:
                    name, at = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                data = record(x["record_type"], x["id"], x["url"], x["date"], x["payload_digest"], x["payload"], x["refers_to"])
                member = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                data = member.compress(data) + member.flush()
                out.write(data)
                rows.append((x["url_key"], x["date"], x["id"], name, at, len(data)))
                at += len(data)
                if len(rows) >= run_rows or at >= ARCHIVE_BYTES:
                    yield index()
                if at >= ARCHIVE_BYTES:
                    out.close()
                    out = None
        if rows:
            yield index()
        if out is not None:
            out.close()

    cols = captures.select("id", "url", "url_key", "date", "payload", "payload_digest", "record_type", "refers_to")
    return written(cols.mapInArrow(run, _BLOCKS), "blocks")


def _key(row: Sequence) -> tuple:
    """URL key, date, then id with nulls last, then place: what runs are sorted by."""
    return (row[0], row[1], row[2] is None, row[2] if row[2] is not None else 0, row[3], row[4])


def merge_runs(runs: Sequence[Iterator[Sequence]]) -> Iterator[Sequence]:
    """The rows of sorted runs in order, by a tree of losers: every step replays one path from leaf to root."""
    k, runs = len(runs), [iter(r) for r in runs]
    if k == 0:
        return
    rows = [next(r, None) for r in runs]
    done = (1,)  # after every key, which begin with 0
    heads = [done if r is None else (0, _key(r), i) for i, r in enumerate(rows)]
    losers = [-1] * k  # losers[0] is the winner
    for i in range(k):  # play the leaves in; the first to come to a match waits there
        winner, node = i, (i + k) // 2
        while node:
            if losers[node] < 0:
                losers[node], winner = winner, -1
                break
            if heads[losers[node]] < heads[winner]:
                losers[node], winner = winner, losers[node]
            node //= 2
        if winner >= 0:
            losers[0] = winner
    while heads[top := losers[0]] is not done:
        yield rows[top]
        rows[top] = row = next(runs[top], None)
        heads[top] = done if row is None else (0, _key(row), top)
        winner, node = top, (top + k) // 2
        while node:
            if heads[losers[node]] < heads[winner]:
                losers[node], winner = winner, losers[node]
            node //= 2
        losers[0] = winner


def _read_blocks(store: fs.FileSystem, path: str, run: str, blocks: Sequence[int]) -> Iterator[list]:
    """The rows of some blocks of a run, in order; one block is in memory at a time."""
    with store.open_input_file(f"{path}/{run}") as f, pa.ipc.open_file(f) as ipc:
        for i in blocks:
            yield from zip(*(c.to_pylist() for c in ipc.get_batch(i).columns), strict=True)


def _by_part(folder: str, found: Callable[[int, list[Iterator], fs.FileSystem, str], Iterator[pa.RecordBatch]]) -> Callable:
    """A task over rows (part, run, block) in that order: ``found`` gets each part with readers of its runs."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("part", "run", "block")), strict=True))
        for part, own in groupby(rows, key=lambda r: r[0]):
            readers = [_read_blocks(store, path, run, [r[2] for r in some]) for run, some in groupby(own, key=lambda r: r[1])]
            yield from found(part, readers, store, path)

    return task


def longer_runs(blocks: DataFrame, folder: str, fan_in: int = FAN_IN) -> DataFrame:
    """The blocks of fewer runs: groups of about ``fan_in`` of them, chosen by hash, are merged each into one. Archives are no longer named."""
    n_groups = -(-blocks.select("run").distinct().count() // fan_in)

    def merged(part: int, readers: list[Iterator], store: fs.FileSystem, path: str) -> Iterator[pa.RecordBatch]:
        writer = _RunWriter(store, path)
        for row in merge_runs(readers):
            writer.add(row)
        yield pa.RecordBatch.from_pylist(writer.close(), _BLOCK_SCHEMA)

    parts = blocks.select(F.pmod(F.xxhash64("run"), F.lit(n_groups)).cast("int").alias("part"), "run", "block")
    parts = parts.repartition(n_groups, "part").sortWithinPartitions("part", "run", "block")
    return written(parts.mapInArrow(_by_part(folder, merged), blocks.schema), "blocks")


def merged_index(blocks: DataFrame, folder: str, range_rows: int = RANGE_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """The index in global order of URL key, date and id: url_key, date, id, file, at, size and seq, the row's place from 1.

    Ids are integers. Ranges are cut by the whole key, so that one URL with many captures is cut as well. A task
    holds a block of each of about ``fan_in`` runs. An empty index gives an empty result.
    """
    spark = blocks.sparkSession
    while blocks.select("run").distinct().count() > 2 * fan_in:
        blocks = longer_runs(blocks, folder, fan_in)
    n_rows = blocks.agg(F.sum("n_rows")).first()[0] or 0
    n_ranges = -(-n_rows // range_rows)
    sample = blocks.orderBy(F.xxhash64("run", "block")).limit(MOST_CUTS).select("first.*").collect() if n_ranges > 1 else []
    keys = sorted(map(_key, sample))  # bounded: MOST_CUTS keys
    cuts = sorted({keys[i * len(keys) // n_ranges] for i in range(1, n_ranges)}) if keys else []

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for run, block, first, last in zip(*(b.column(c).to_pylist() for c in ("run", "block", "first", "last")), strict=True):
                lo, hi = (bisect_right(cuts, _key(tuple(x.values()))) for x in (first, last))
                out += [(part, run, block) for part in range(lo, hi + 1)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.string(), pa.int32()), strict=True)], names=["part", "run", "block"])

    def merged(part: int, readers: list[Iterator], store: fs.FileSystem, path: str) -> Iterator[pa.RecordBatch]:
        low, high = cuts[part - 1] if part else (), cuts[part] if part < len(cuts) else None
        inside = lambda rows: (r for r in rows if low <= (k := _key(r)) and (high is None or k < high))
        out, n = [], 0
        for n, row in enumerate(merge_runs([inside(r) for r in readers]), 1):
            out.append((part, n, *row))
            if len(out) >= 10_000:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    def batch(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), *_TYPES), strict=True)], names=["part", "n", *_FIELDS])

    parts = blocks.select("run", "block", "first", "last").mapInArrow(ranges, "part int, run string, block int")
    parts = parts.repartition(len(cuts) + 1, "part").sortWithinPartitions("part", "run", "block")
    rows = written(parts.mapInArrow(_by_part(folder, merged), "part int, n long, url_key string, date string, id long, file string, at long, size long"), "history")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy("part").agg(F.max("n").alias("m"))  # a row a range, MOST_CUTS at most
    ends = ends.select("part", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(ends), "part").select(*_FIELDS, (F.col("before") + F.col("n")).alias("seq"))


def read_archives(files: DataFrame, folder: str, n_tasks: int) -> DataFrame:
    """A row for each record of the archives named in ``files`` (archive): place, headers and payload (null for revisits).

    Archives are streamed from end to end, a record at a time, ``n_tasks`` tasks at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        names = ["file", "at", "record_id", "record_type", "refers_to", "url", "date", "header_digest", "header_bytes", "payload"]
        types = [pa.string(), pa.int64(), *[pa.string()] * 6, pa.int64(), pa.binary()]
        rows = []

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
            rows.clear()
            return batch

        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_stream(f"{path}/{name}", compression=None) as f:
                    for at, data in members(f):
                        x = parse_record(data)
                        http, _, payload = x["block"].partition(b"\r\n\r\n")
                        length = int(http.rpartition(b"Content-Length: ")[2])
                        page = lambda v: v.removeprefix("<urn:page:").removesuffix(">") if v else None
                        rows.append((name, at, page(x["warc-record-id"]), x["warc-type"], page(x.get("warc-refers-to")), x.get("warc-target-uri"), x["warc-date"], x["warc-payload-digest"].partition(":")[2], length, payload if x["warc-type"] == "response" else None))
                        if len(rows) >= 256:
                            yield out()
        if rows:
            yield out()

    schema = "file string, at long, record_id string, record_type string, refers_to string, url string, date string, header_digest string, header_bytes long, payload binary"
    return files.select("archive").distinct().repartition(n_tasks).mapInArrow(run, schema)


def members(f, chunk: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """The gzip members of a stream, each with its offset."""
    at, rest = 0, b""
    while rest or (rest := f.read(chunk)):
        member, parts, used = zlib.decompressobj(31), [], 0
        while not member.eof:
            if not rest and not (rest := f.read(chunk)):
                raise ValueError("an archive ends inside a record")
            parts.append(member.decompress(rest))
            used += len(rest) - len(member.unused_data)
            rest = member.unused_data
        yield at, b"".join(parts)
        at += used


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: Column | None = None, least: int = LEAST_BYTES, run_rows: int = RUN_ROWS) -> tuple[DataFrame, str]:
    """Writes every row as a record; returns the blocks of the index and the folder of archives and runs.

    A null html is an empty payload, a null URL leaves out the target. Ids are integers; rows that repeat an id and a
    payload are all what the first of them is. A row with a null id is a response. Other columns are not read. Files
    stay in the shared folder until it is cleared.
    """
    folder = scratch_path(pages.sparkSession, "warc")
    when = date if date is not None else F.lit("1970-01-01T00:00:00Z")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), url_key(F.col(url_col)).alias("url_key"), when.alias("date"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"))
    return write_archives(classify(rows, least), folder, run_rows), folder
