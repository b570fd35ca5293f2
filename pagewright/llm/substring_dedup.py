"""Repeated stretches of words by recompression: equal stretches get equal symbols inside, wherever they stand.

1. Round by round a text's symbols are renamed: runs of one symbol become one, or pairs do, of a left and a right
   symbol (a bit of the name says which, so that pairs never overlap). A name is a hash of what it stands for, so that
   it is the same in every document and task, without a dictionary that grows with the corpus.
2. What a round makes of a stretch depends on the stretch alone but for the symbols at its ends, which may merge with
   what stands outside. What is left inside is its core; equal windows have equal cores. The anchor of a window is the
   longest symbol of its core after the last round that leaves one; windows side by side mostly share it.
3. Spark counts the anchors' names. Windows whose anchor occurs once are unique. Of the others, whole ranges of windows
   with one anchor are compared by a hash of all their words: ranges that occur twice are repeats.
4. Where a name has several ranges, these partly agree: one range of each kind is joined back to its text, and its
   windows are compared one by one. What is equal agrees in two independent hashes, 128 bits together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Words of a window.
WINDOW = 35
#: Rounds: runs become one symbol, or pairs do. A round of runs costs each core a symbol at either end. After more rounds
#: symbols are longer, but cores have fewer of them, and windows side by side share their longest one less often.
ROUNDS = ("runs", "pairs", "pairs", "pairs", "pairs", "pairs")
#: An anchor of fewer words tells too little; the window's own hash takes its place.
SHORTEST = 4
#: Words that are renamed at once; a longer text is one piece.
CHUNK = 400_000

_U = np.uint64
_GOLD, _BASE, _OTHER = _U(0x9E3779B97F4A7C15), 0xD1342543DE82EF95, 0xAF251AF3B0F025B5


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Names(dict):
    """Hashes of words, kept for the next text; forgotten when there are many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        name = self[word] = xxhash.xxh3_64_intdigest(word)
        return name


def word_hashes(text: str | None, names: _Names) -> np.ndarray:
    """64 bits for each word. Bytes are split at exactly the blanks that part words."""
    return np.fromiter(map(names.__getitem__, (text or "").encode().split()), _U)


class _Stretches:
    """Hashes of any stretch of a sequence of word hashes."""

    def __init__(self, h: np.ndarray, base: int) -> None:
        n = len(h) + 1
        inverse = pow(base, -1, 2**64)
        self.back = np.cumprod(np.r_[_U(1), np.full(n - 1, inverse, _U)], dtype=_U)
        ahead = np.cumprod(np.r_[_U(1), np.full(n - 1, base, _U)], dtype=_U)
        self.sums = np.cumsum(np.r_[_U(0), h * ahead[:-1]], dtype=_U)

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[begin]) * self.back[begin])


def _round(kind: str, k: int, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First symbol and name of each new symbol, the new symbol of each old one, and the next and the last symbol that stay inside a core from, or up to, each."""
    at = np.arange(len(names))
    if kind == "runs":
        begins = np.r_[True, names[1:] != names[:-1]]
        new = np.cumsum(begins) - 1
        first = np.flatnonzero(begins)
        length = np.diff(np.r_[first, len(names)])
        named = np.where(length == 1, names[first], _mix(names[first] + length.astype(_U) * _GOLD))
        return first, named, new, (first + length)[new], first[new] - 1
    left = (_mix(names + _U((k + 1) * int(_GOLD) % 2**64)) & _U(1)) == 1
    pair = np.r_[left[:-1] & ~left[1:], False]
    begins = ~np.r_[False, pair[:-1]]
    new = np.cumsum(begins) - 1
    first = np.flatnonzero(begins)
    after = np.r_[names[1:], _U(0)]
    named = np.where(pair[first], _mix(_mix(names[first]) * _GOLD + after[first]), names[first])
    return first, named, new, at + ~left, at - left


def anchors(h: np.ndarray, sizes: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Of texts that follow each other in ``h``: the text, f (name), a and b (first and last window, by their places in the text), c (hash of all their words) of each anchor."""
    ends = np.cumsum(sizes)
    begins = ends - sizes
    n = np.maximum(0, sizes - window + 1)
    text = np.repeat(np.arange(len(sizes)), n)
    places = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + begins[text]
    if not len(places):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    start, length, name = places.copy(), np.ones(len(places), np.int64), h[places]
    level = np.zeros(len(places), np.int8)
    symbols, at, lo, hi, own = h, np.arange(len(h)), places, places + window - 1, np.arange(len(places))
    for k, kind in enumerate(ROUNDS):
        first, named, new, following, before = _round(kind, k, symbols)
        lo, hi = following[lo], before[hi]
        inside = lo <= hi
        own, lo, hi = own[inside], new[lo[inside]], new[hi[inside]]
        symbols, at = named, at[first]
        level[own] = k + 1
        width = np.diff(np.r_[at, len(h)])
        key = (np.minimum(width, 2**15 - 1).astype(_U) << _U(48)) | (_mix(symbols) >> _U(16))
        best = lo.copy()
        for step in range(1, int((hi - lo).max(initial=0)) + 1 if k == len(ROUNDS) - 1 else 1):
            other = lo + step
            more = np.flatnonzero(other <= hi)
            more = more[key[other[more]] > key[best[more]]]
            best[more] = other[more]
        start[own], length[own], name[own] = at[best], width[best], symbols[best]
    stretches = _Stretches(h, _BASE)
    short = length < SHORTEST
    name = np.where(short, 0, name)
    start = np.where(short, places, start)
    group = np.flatnonzero(np.r_[True, short[1:] | short[:-1] | (start[1:] != start[:-1]) | (level[1:] != level[:-1]) | (text[1:] != text[:-1])])
    last = np.r_[group[1:], len(places)] - 1
    a, b = places[group], places[last]
    c = _mix(stretches.of(a, b + window) + _mix(((b - a).astype(_U) << _U(32)) + (start[group] - a + window).astype(_U)))
    f = _mix(name[group] + level[group].astype(_U) * _GOLD)
    alone = short[group]
    f[alone] = _Stretches(h, _OTHER).of(a[alone], a[alone] + window)
    # windows of the same words one after the other, inside a run of one word: all but the first are one range, of the first one's kind
    again = np.r_[False, alone[1:] & alone[:-1] & (f[1:] == f[:-1]) & (c[1:] == c[:-1]) & (a[1:] == a[:-1] + 1) & (text[group][1:] == text[group][:-1])]
    heads = np.flatnonzero(~again | ~np.r_[False, again[:-1]])
    b = b[np.r_[heads[1:], len(b)] - 1]
    group, f, a, c = group[heads], f[heads], a[heads], c[heads]
    return text[group], f.view(np.int64), a - begins[text[group]], b - begins[text[group]], c.view(np.int64)


def _pieces(batch: pa.RecordBatch, names: _Names) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The words of a batch's texts, CHUNK at a time: the first row, and the hashes of each row's words."""
    at, held, size = 0, [], 0
    for i, text in enumerate(batch["text"].to_pylist()):
        held.append(word_hashes(text, names))
        size += len(held[-1])
        if size >= CHUNK:
            yield at, held
            at, held, size = i + 1, [], 0
    if held:
        yield at, held


def _anchor_rows(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _Names()
        for batch in batches:
            keys = batch["at"].to_numpy()
            for first, held in _pieces(batch, names):
                text, f, a, b, c = anchors(np.concatenate(held), np.array([len(x) for x in held]), window)
                columns = [keys[first:][text], f, a.astype(np.int32), b.astype(np.int32), c]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["at", "f", "a", "b", "c"])

    return task


def _window_rows(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The hash of each window of the ranges that a text came with."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _Names()
        for batch in batches:
            for at, text, ranges in zip(batch["at"].to_pylist(), batch["text"].to_pylist(), batch["ranges"], strict=True):
                x = ranges.values
                f, a, b, n = (x.field(k).to_numpy() for k in ("f", "a", "b", "n"))
                each = b.astype(np.int64) - a + 1
                row = np.repeat(np.arange(len(a)), each)
                p = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + a[row]
                w = _Stretches(word_hashes(text, names), _BASE).of(p, p + window)
                columns = [np.full(len(p), at, np.int64), p.astype(np.int32), f[row], w.view(np.int64), n[row]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["at", "p", "f", "w", "n"])

    return task


def repeated_ranges(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """(at, a, e) for ``texts`` (at, text), at a unique long: words a to e - 1 of the text are covered by repeated windows. Ranges may overlap."""
    found = written(texts.mapInArrow(_anchor_rows(window), "at long, f long, a int, b int, c long"), "anchors")
    # what is joined is written first: Spark splits a frequent name's rows only where both sides come straight from a shuffle
    shared = written(found.groupBy("f").agg(F.count("*").alias("n")).where("n > 1").select("f"), "names")
    found = written(found.join(shared, "f", "left_semi"), "shared")
    kinds = written(found.groupBy("f", "c").agg(F.count("*").alias("n"), F.min(F.struct("at", "a", "b")).alias("one")), "kinds")
    whole = found.join(kinds.where("n > 1").select("f", "c"), ["f", "c"], "left_semi").select("at", "a", (F.col("b") + window).alias("e"))

    several = written(kinds.groupBy("f").agg(F.count("*").alias("k")).where("k > 1").select("f"), "several")
    asked = kinds.join(several, "f", "left_semi").select("one.at", F.struct("f", "one.a", "one.b", "n").alias("x"))
    asked = asked.groupBy("at").agg(F.collect_list("x").alias("ranges"))
    windows = written(texts.join(asked, "at").select("at", "text", "ranges").mapInArrow(_window_rows(window), "at long, p int, f long, w long, n long"), "windows")
    again = written(windows.groupBy("f", "w").agg(F.sum("n").alias("n")).where("n > 1").select("f", "w"), "again")
    single = windows.where("n = 1").join(again, ["f", "w"], "left_semi").select("at", F.col("p").alias("a"), (F.col("p") + window).alias("e"))
    return whole.union(single)


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text without the words that its ranges cover, joined by one space."""
    for batch in batches:
        counts, gone, kept = [], [], []
        for text, ranges in zip(batch["text"].to_pylist(), batch["ranges"], strict=True):
            w = (text or "").encode().split()
            counts.append(len(w))
            cover = np.zeros(len(w) + 1, np.int64)
            if ranges.is_valid:
                np.add.at(cover, ranges.values.field("a").to_numpy(), 1)
                np.subtract.at(cover, ranges.values.field("e").to_numpy(), 1)
            stays = np.flatnonzero(np.cumsum(cover)[:-1] == 0)
            gone.append(len(w) - len(stays))
            kept.append(None if text is None else b" ".join(w if len(stays) == len(w) else [w[i] for i in stays]).decode())
        yield pa.RecordBatch.from_arrays([batch["at"], pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["at", "n_words", "n_removed", "kept"])


def _keyed(docs: DataFrame, id_col: str) -> tuple[DataFrame, bool]:
    """``docs`` with _pw_at, a long that no other row has, and whether that is the id; where ids repeat, are null or no integers, it is a number."""
    if docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long"):
        ids = docs.groupBy(id_col).count().where(F.col(id_col).isNull() | (F.col("count") > 1))
        if ids.isEmpty():
            return docs.withColumn("_pw_at", F.col(id_col).cast("long")), True
    return written(docs.withColumn("_pw_at", F.monotonically_increasing_id()), "numbered"), False


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """id, n_words, n_removed, kept: each text without the words of windows that start anywhere else too.

    Words are runs of other characters than blanks. A window is ``window`` words of one text; where the same words
    start at another place, in another row or in the same one, all of them go, in all places. Windows are judged on the
    texts as they come. kept has the words that stay, joined by one space; null texts stay null and have no words.
    Every row has a row in the result: rows that repeat an id, or have none, are texts like any other. Other columns
    are not read. An empty table gives an empty result.
    """
    rows, by_id = _keyed(docs.select(id_col, F.col(text_col).cast("string").alias("_pw_text")), id_col)
    texts = rows.select(F.col("_pw_at").alias("at"), F.col("_pw_text").alias("text"))
    ranges = repeated_ranges(texts.where(F.length("text") >= 2 * window - 1), window).groupBy("at").agg(F.collect_list(F.struct("a", "e")).alias("ranges"))
    out = texts.join(ranges, "at", "left").select("at", "text", "ranges").mapInArrow(_without, "at long, n_words long, n_removed long, kept string")
    if by_id:
        return out.select(F.col("at").cast(rows.schema[id_col].dataType).alias(id_col), "n_words", "n_removed", "kept")
    return rows.select(F.col("_pw_at").alias("at"), id_col).join(out, "at").drop("at")
