"""Language-model scores by stupid backoff: every text under the n-gram counts of all other texts.

The relations are those of a plain join, packed into arrays. Documents are dealt into blocks of bounded size. A block
explodes its n-grams, and counts each once: an n-gram, however frequent, is one entry of a block. Entries go to
buckets by hash; a bucket holds the count table of its range of hashes, adds up what all blocks have counted, and
joins the totals back to each block's entries, in their order. The block then scores its n-grams and sums by document.

Counts leave the scored document itself out. With c the counts in all other texts, S(w | h) = c(h w) / c(h) where
c(h w) > 0, else BACKOFF * S(w | h without its first word); S(w) = c(w) / N, or 1 / (N + 1) for a word that no other
text has, with N the number of words in all other texts.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDER, BACKOFF = 2, 0.4
#: Characters of a block, about; the number of blocks and of buckets follows from the size of the corpus.
BLOCK_CHARS = 12_000_000
_WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
_U = np.uint64


class _Hashes(dict):
    """64-bit hashes of words; remembers a bounded number."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 400_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_hashes = _Hashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def block_ngrams(texts: list[str | None], order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The document of each word, and for each length the hash of the n-gram that ends at each word; 0 where none does."""
    each = [np.fromiter(map(_hashes.__getitem__, _WORDS(t.lower())), _U) if t else np.empty(0, _U) for t in texts]
    doc = np.repeat(np.arange(len(each)), [len(x) for x in each])
    words = np.concatenate(each) if each else np.empty(0, _U)
    levels = [_mix(words) | _U(1)]
    for n in range(2, order + 1):
        longer = np.zeros(len(words), _U)
        inside = np.flatnonzero(doc[n - 1 :] == doc[: len(doc) - n + 1]) + n - 1 if len(doc) >= n else np.empty(0, np.int64)
        longer[inside] = _mix(levels[-1][inside - 1] * _U(0x9E3779B97F4A7C15) + words[inside] + _U(n)) | _U(1)
        levels.append(longer)
    return doc, levels


def _entries(levels: list[np.ndarray]) -> np.ndarray:
    """The n-grams of all lengths of a block, in its order."""
    return np.concatenate(levels)


def score_block(doc: np.ndarray, levels: list[np.ndarray], n_docs: int, uniq: np.ndarray, at: np.ndarray, totals: np.ndarray, n_words: int, backoff: float) -> tuple[np.ndarray, np.ndarray]:
    """The sum of log scores and the number of words scored below the full order, by document.

    ``at`` has the place in ``uniq`` of each n-gram, level by level; ``totals`` the count of each of ``uniq`` in all texts.
    """
    n = len(doc)
    at = at.reshape(len(levels), n)
    own_words = np.bincount(doc, minlength=n_docs)
    others = (n_words - own_words)[doc].astype(np.float64)
    rest = []  # by level: how often other texts have the n-gram that ends here
    for level in range(len(levels)):
        pair = doc.astype(np.int64) * len(uniq) + at[level]
        _, inverse, counts = np.unique(pair, return_inverse=True, return_counts=True)
        left = totals[at[level]] - counts[inverse]
        rest.append(np.where(levels[level] == 0, 0, left))
    score = np.log(np.where(rest[0] > 0, rest[0] / np.maximum(others, 1), 1 / (others + 1)))
    depth = np.zeros(n, np.int64)
    for level in range(1, len(levels)):
        seen = rest[level] > 0
        context = np.concatenate([[0], rest[level - 1][:-1]]) if n else rest[level - 1]
        possible = levels[level] != 0
        score = np.where(seen, np.log(np.maximum(rest[level], 1) / np.maximum(context, 1)), np.where(possible, np.log(backoff) + score, score))
        depth += possible & ~seen
    return np.bincount(doc, weights=score, minlength=n_docs), np.bincount(doc, weights=depth > 0, minlength=n_docs).astype(np.int64)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, backoff: float = BACKOFF, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """For each row its id, n_words, log_score (sum of natural logs), mean_log_score and n_backoffs (words scored on less context).

    Words are runs of other characters than blanks, in lower case; n-grams don't cross documents. A null or blank text
    has no words and zeros throughout. Repeated rows are documents of their own, and so is each row with a null id.
    Other columns are not read. An empty table gives an empty result. A document must fit in a task; equal rows, with one
    id and one text, are in one block, which then holds all of them.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.length("text")).alias("chars"), F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("words")).first()
    n_words = int(size["words"] or 0)
    n_blocks = max(1, -(-int(size["chars"] or 0) // block_chars))
    bits = max(1, (n_blocks - 1).bit_length())
    kind = rows.schema["id"].dataType.simpleString()
    # by the text as well, so that rows without an id or with one id spread over the blocks
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)).cast("int"))

    def count(table: pa.Table) -> pa.Table:
        _, levels = block_ngrams(table.column("text").to_pylist(), order)
        found = _entries(levels)
        uniq, counts = np.unique(found[found != 0], return_counts=True)
        cuts = np.searchsorted(uniq >> _U(64 - bits), np.arange((1 << bits) + 1, dtype=_U))
        some = [b for b in range(1 << bits) if cuts[b] < cuts[b + 1]]
        block = table.column("block")[0].as_py()
        return pa.table({
            "bucket": pa.array(some, pa.int32()), "block": pa.array([block] * len(some), pa.int32()),
            "hashes": pa.array([uniq[cuts[b] : cuts[b + 1]].tobytes() for b in some], pa.binary()), "counts": pa.array([counts[cuts[b] : cuts[b + 1]].astype("<u4").tobytes() for b in some], pa.binary()),
        })

    def add_up(table: pa.Table) -> pa.Table:
        hashes = [np.frombuffer(x, "<u8") for x in table.column("hashes").to_pylist()]
        counts = np.concatenate([np.frombuffer(x, "<u4") for x in table.column("counts").to_pylist()])
        uniq, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
        totals = np.bincount(inverse, weights=counts, minlength=len(uniq)).astype("<u8")[inverse]
        cuts = np.cumsum([0, *map(len, hashes)])
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "totals": pa.array([totals[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())})

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        doc, levels = block_ngrams(left.column("text").to_pylist(), order)
        found = _entries(levels)
        uniq, at = np.unique(found, return_inverse=True)
        parts = sorted(zip(right.column("bucket").to_pylist(), right.column("totals").to_pylist(), strict=True))
        totals = np.concatenate([np.empty(0, np.int64), *(np.frombuffer(x, "<u8").astype(np.int64) for _, x in parts)])
        if len(uniq) and uniq[0] == 0:  # stands for no n-gram
            totals = np.concatenate([[0], totals])
        n_docs = left.num_rows
        total, backoffs = score_block(doc, levels, n_docs, uniq, at, totals, n_words, backoff)
        own = np.bincount(doc, minlength=n_docs)
        return pa.table({"id": left.column("id"), "n_words": pa.array(own, pa.int64()), "log_score": pa.array(total, pa.float64()), "mean_log_score": pa.array(total / np.maximum(own, 1), pa.float64()), "n_backoffs": pa.array(backoffs, pa.int64())})

    counted = dealt.groupBy("block").applyInArrow(count, "bucket int, block int, hashes binary, counts binary")
    totals = counted.groupBy("bucket").applyInArrow(add_up, "block int, bucket int, totals binary")
    scored = dealt.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(score, f"id {kind}, n_words long, log_score double, mean_log_score double, n_backoffs long")
    return scored.withColumnRenamed("id", id_col)
