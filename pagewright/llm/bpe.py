"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Spark deals the rows; each Python worker keeps one encoder and encodes the distinct pre-tokens that it meets. An
encoder merges a pre-token's symbols in a linked list. Every adjacent pair waits in the bucket of its merge rank; a
two-level bitmap marks the buckets in use, so that find-first-set yields the next rank in two steps however long the
pre-token is. A merge leaves the neighbours' old entries where they are; they are skipped when they come up.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import islice

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Pre-tokens that a worker remembers before it starts anew, and the longest that it remembers, in characters.
CACHE_ENTRIES, CACHE_CHARS = 500_000, 64
#: Bits of a rank that one word of the bitmap's lower level holds, as a power of two.
WORD = 8
MASK = (1 << WORD) - 1
#: Rows that are turned into one output batch.
ROWS = 256


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a line for each token, its bytes in base 64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Encoder(dict):
    """Maps a pre-token to its ids, packed as little-endian unsigned 32-bit integers; remembers short ones."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.low = [0] * ((max(ranks.values(), default=0) >> WORD) + 1)  # the lower level of the bitmap; all zeros between calls
        self.single = [ranks.get(bytes([b])) for b in range(256)]
        self.pairs: dict[int, int] = {}
        self.token = {rank: token for token, rank in ranks.items()}

    def __missing__(self, piece: str) -> bytes:
        ids = self.merge(piece.encode())
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:  # the older half goes; what is frequent comes back at once
                for old in list(islice(self, CACHE_ENTRIES // 2)):
                    del self[old]
            self[piece] = packed
        return packed

    def rank_of(self, key: int) -> int:
        """The rank of two tokens side by side (one in the upper, one in the lower 32 bits), -1 if they don't merge."""
        if len(self.pairs) >= CACHE_ENTRIES:
            self.pairs.clear()
        rank = self.pairs[key] = self.ranks.get(self.token[key >> 32] + self.token[key & 0xFFFFFFFF], -1)
        return rank

    def merge(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, low, top, known = len(piece), self.low, 0, self.pairs
        buckets: dict[int, int | list[int]] = {}  # by rank: one position, or a heap of several
        ids = [self.single[b] for b in piece]
        after, before = [*range(1, n + 1)], [*range(-1, n)]
        waiting = [-1] * (n + 1)  # the rank under which the pair that starts at a position waits
        new = range(n - 1)  # positions whose pair has come up
        while True:
            for i in new:
                key = ids[i] << 32 | ids[after[i]]
                rank = known[key] if key in known else self.rank_of(key)
                waiting[i] = rank
                if rank >= 0:
                    if rank in buckets:
                        bucket = buckets[rank]
                        if type(bucket) is int:
                            buckets[rank] = [bucket, i] if bucket < i else [i, bucket]
                        else:
                            heappush(bucket, i)
                    else:
                        buckets[rank] = i
                        word = rank >> WORD
                        low[word] |= 1 << (rank & MASK)
                        top |= 1 << word
            while top:  # find the first set bit of either level: the lowest rank in use
                word = (top & -top).bit_length() - 1
                bits = low[word]
                rank = (word << WORD) + (bits & -bits).bit_length() - 1
                i = buckets[rank]
                if type(i) is int:
                    del buckets[rank]
                    low[word] = bits = bits & (bits - 1)
                    if not bits:
                        top &= top - 1
                else:
                    heap, i = i, heappop(i)
                    if len(heap) == 1:
                        buckets[rank] = heap[0]
                if waiting[i] == rank:
                    break  # else the entry is stale: one of the two symbols has merged with another since
            else:
                return [x for x in ids if x >= 0]
            j = after[i]
            after[i] = k = after[j]
            ids[i], ids[j], waiting[j], waiting[i] = rank, -1, -1, -1
            h = before[i]
            if k < n:
                before[k] = i
                new = (i,) if h < 0 else (i, h)
            else:
                new = () if h < 0 else (h,)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.split(text)))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(read_ranks(path), pattern)


@lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes]:
    ranks = read_ranks(path)
    out = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """For each row its id, n_tokens and ids, the token ids as packed little-endian unsigned 32-bit integers.

    Null texts count as empty: no tokens. Rows are encoded each on its own, so that repeated rows repeat and null ids
    stay; other columns are not read. A text may be of any length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                packed = [enc.encode(t) if t else b"" for t in part.column(1).to_pylist()]
                counts = pa.array([len(x) >> 2 for x in packed], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), counts, pa.array(packed, pa.binary())], names=["id", "n_tokens", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, ids binary").withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, ids_col: str = "ids", out_col: str = "decoded", ranks_path: str = RANKS) -> DataFrame:
    """``encoded`` with one more column: the bytes of its packed ids. Null ids give null bytes; an id without a token fails."""
    keep = [c for c in encoded.columns if c != out_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_bytes(ranks_path)
        for batch in batches:
            at = batch.schema.get_field_index(ids_col)
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                decoded = [None if x is None else b"".join(map(tokens.__getitem__, memoryview(x).cast("I"))) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(decoded, pa.binary())], names=[*part.schema.names, out_col])

    rows = encoded.select(*keep)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), f"`{out_col}` binary"])
    return rows.mapInArrow(run, schema)
