"""Phrases whose words occur together far more often than alone, by bucket counts and pruning (PCY, DHP, Apriori).

1. Texts become blocks of word numbers with a vocabulary of their own, one language a block; all passes read these.
2. Pass k counts phrases of k words exactly, but only occurrences that may be frequent: whose bucket, counted in the
   pass before, reaches ``min_count``, and whose first and last k - 1 words are frequent phrases. In the same pass the
   occurrences of k + 1 words of which both parts are left are counted by buckets of their hashes.
3. Bitmaps of frequent buckets, and of the buckets of frequent phrases, go to all tasks: a bit for each WORDS_EACH words of
   the corpus, MOST_BUCKETS at most. A bucket may hold several phrases, so that bitmaps let through too much and
   never too little; exact counts decide.
4. Scores are joins of the frequent phrases with each other: each part of a candidate is frequent too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

#: Words of the corpus for each bucket of a pass, and buckets at most: a bitmap of these is 8 MB, their counts in a task 64.
WORDS_EACH, MOST_BUCKETS = 8, 1 << 26
#: Buckets that travel in one row, and that there are at least; rows that are summed at once.
SHARE, SUMMED = 1 << 16, 64
#: Words of a block; a longer text is a block of its own.
BLOCK = 250_000
#: Words that a task of a pass reads at least, unless there are fewer tasks than cores: nearly every task meets nearly every
#: frequent phrase and gives out a count of it, so that tasks as small as the files' splits give out many times as many.
TASK = 16_000_000
#: Counted phrases that a task holds before it gives them out; those of its blocks are added up so far.
HELD = 500_000

_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)
_CUT = b"\xff"  # no byte of UTF-8
_CODED = "lang string, words binary, ids binary, sizes array<int>, n long"
_COUNTED = "lang string, phrase string, hash long, n long, share int, counts binary"
_OWN = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("hash", pa.int64()), ("n", pa.int64())])


def _table() -> bytes:
    """Bytes as they are read: A-Z lower-cased, what parts pieces as one byte, tabs as spaces."""
    table = bytearray(range(256))
    table[65:91] = range(97, 123)
    for c in b".,;:!?\n\x0b\x0c\r":
        table[c] = _CUT[0]
    table[9] = 32
    return bytes(table)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Numbers(dict):
    """A number for each word, in the order in which they come; -1 between pieces."""

    def __init__(self) -> None:
        self[_CUT] = -1

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self) - 1
        return n


def _packed(content: bytes) -> bytes:
    """Compressed, so that what tasks hold of blocks that wait is small."""
    return pa.compress(content, codec="zstd", asbytes=True)


def _unpacked(packed: bytes | pa.Buffer, size: int) -> bytes:
    return pa.decompress(packed, size, codec="zstd", asbytes=True)


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of (lang, text)."""
    table, held = _table(), {}
    schema = pa.schema([("lang", pa.string()), ("words", pa.binary()), ("ids", pa.binary()), ("sizes", pa.list_(pa.int32())), ("n", pa.int64())])

    def block(lang: str) -> pa.RecordBatch:
        numbers, ids, _ = held.pop(lang)
        words = _CUT.join(w for w in numbers if w != _CUT)
        ids = np.concatenate(ids)
        row = {"lang": [lang], "words": [_packed(words)], "ids": [_packed(ids.tobytes())], "sizes": [[len(words), ids.nbytes]], "n": [int((ids >= 0).sum())]}
        return pa.RecordBatch.from_pydict(row, schema=schema)

    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
            tokens = text.encode().translate(table).replace(_CUT, b" \xff ").split()
            tokens.append(_CUT)
            numbers, ids, size = held.get(lang) or (_Numbers(), [], 0)
            ids.append(np.fromiter(map(numbers.__getitem__, tokens), np.int32, len(tokens)))
            held[lang] = numbers, ids, size + len(tokens)
            if size + len(tokens) >= BLOCK:
                yield block(lang)
    for lang in list(held):
        yield block(lang)


def _phrases(ids: np.ndarray, at: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the phrases of k words at ``at``: where each distinct one is first, its name and how often it is there.

    Names are hashes; that equal names mean equal words is checked, and else the words are compared.
    """
    name, first, which, n = np.unique(names[at], return_index=True, return_inverse=True, return_counts=True)
    words = [ids[at + j] for j in range(k)]
    if all((x == x[first][which]).all() for x in words):
        return at[first], name, n
    _, first, n = np.unique(np.stack(words, axis=1), axis=0, return_index=True, return_counts=True)
    return at[first], names[at[first]], n


def _bit(bitmap: np.ndarray, names: np.ndarray) -> np.ndarray:
    b = names & _U(64 * len(bitmap) - 1)
    return (bitmap[(b >> _U(6)).astype(np.int64)] >> (b & _U(63))) & _U(1) == 1


def _pass(k: int, most: int, min_count: int, size: int, buckets: np.ndarray | None, frequent: np.ndarray | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of the phrases of k words that may be frequent, added up in the task, and of the buckets of k + 1 words, up to ``min_count`` a task."""

    def counted(lang: str, words: list[bytes], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Names of k words, where they may be frequent, names of k + 1 words and where both of their parts may be."""
        own = np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, len(words))
        single = _mix(np.append(own, _U(0)) + _U(xxhash.xxh3_64_intdigest(lang)))[ids]
        names, word = [None, single], ids >= 0
        inside = [np.ones(len(ids), bool), word]
        for j in range(2, k + 2):
            at = max(0, len(ids) - j + 1)
            if j > 2:
                names[j - 3] = None
            names.append(_mix(names[-1][:at] * _GOLD + single[j - 1 : j - 1 + at]))
            inside.append(inside[-1][:at] & word[j - 1 : j - 1 + at])
        may = inside[k].copy()
        if k:
            own = np.flatnonzero(may)
            own = own[_bit(buckets, names[k][own])]
            if k > 1:
                own = own[_bit(frequent, names[k - 1][own])]
                own = own[_bit(frequent, names[k - 1][own + 1])]
            may[:] = False
            may[own] = True
        del own, single, word
        longer = inside[k + 1] & may[: len(inside[k + 1])] & may[1 : 1 + len(inside[k + 1])] if k else inside[1]
        return names[k], np.flatnonzero(may), names[k + 1], np.flatnonzero(longer)

    def added(held: list[pa.Table]) -> pa.Table:
        pa.default_memory_pool().release_unused()
        return pa.concat_tables(held).group_by(_OWN.names[:3]).aggregate([("n", "sum")]).rename_columns(_OWN.names)

    def given(table: pa.Table, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        nothing = pa.nulls(len(table))
        for c, kind in (("share", pa.int32()), ("counts", pa.binary())):
            table = table.append_column(c, nothing.cast(kind))
        yield from table.cast(schema).to_batches(max_chunksize=100_000)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        sums = np.zeros(size, _kind(min_count))
        schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("hash", pa.int64()), ("n", pa.int64()), ("share", pa.int32()), ("counts", pa.binary())])
        for batch in batches:
            for lang, joined, packed, sizes in zip(batch["lang"].to_pylist(), batch["words"], batch["ids"], batch["sizes"].to_pylist(), strict=True):
                ids = np.frombuffer(_unpacked(packed.as_buffer(), sizes[1]), np.int32)
                words = _unpacked(joined.as_buffer(), sizes[0]).split(_CUT)
                names, at, longer, both = counted(lang, words, ids)
                if k and len(at):
                    first, name, n = _phrases(ids, at, names, k)
                    own = pa.array(words, pa.binary()).cast(pa.string())
                    phrase = pc.binary_join_element_wise(*[own.take(pa.array(ids[first + j])) for j in range(k)], " ")
                    held.append(pa.Table.from_arrays([pa.array([lang] * len(n), pa.string()), phrase, pa.array(name.view(np.int64)), pa.array(n)], schema=_OWN))
                    if sum(map(len, held)) > HELD:
                        held = [added(held)]
                        if 2 * len(held[0]) > HELD:
                            yield from given(held.pop(), schema)
                if k < most:
                    at, n = np.unique(longer[both] & _U(size - 1), return_counts=True)
                    at = at.astype(np.int64)
                    sums[at] = np.minimum(sums[at] + n, min_count)
        if held:
            yield from given(added(held), schema)
        for share in range(size // SHARE):
            part = sums[share * SHARE : (share + 1) * SHARE]
            if part.any():
                yield pa.RecordBatch.from_pylist([{"share": share, "counts": _short(part, min_count)}], schema=schema)

    return task


def _kind(min_count: int) -> type:
    """The type of counts that go up to ``min_count``."""
    return np.uint8 if min_count < 256 else np.uint32


def _short(counts: np.ndarray, min_count: int) -> bytes:
    return _packed(counts.astype(_kind(min_count)).tobytes())


def _counts(short: bytes | pa.Buffer, min_count: int) -> np.ndarray:
    kind = np.dtype(_kind(min_count))
    return np.frombuffer(_unpacked(short, SHARE * kind.itemsize), kind)


def _frequent_buckets(counted: DataFrame, min_count: int, size: int) -> np.ndarray:
    """A bit for each of ``size`` buckets: whether it was counted ``min_count`` times over all tasks."""

    def added(key: tuple, table: pa.Table) -> pa.Table:
        total = np.zeros(SHARE, np.int64)
        for counts in table["counts"]:
            total += _counts(counts.as_buffer(), min_count)
        row = {"share": key[0].as_py(), "task": key[1].as_py(), "counts": _short(np.minimum(total, min_count), min_count)}
        return pa.Table.from_pylist([row], schema=pa.schema([("share", pa.int32()), ("task", pa.int64()), ("counts", pa.binary())]))

    rows = counted.where("share is not null").select("share", "counts")
    tasks = rows.select("share", F.monotonically_increasing_id().alias("task"), "counts")
    most = tasks.groupBy("share").count().agg(F.max("count")).first()[0] or 0
    while most > 1:
        groups = -(-most // SUMMED)
        spread = F.pmod(F.xxhash64("task"), F.lit(groups))
        tasks = tasks.withColumn("task", spread).groupBy("share", "task").applyInArrow(added, "share int, task long, counts binary")
        if groups > 1:
            tasks = written(tasks, "buckets")
        most = groups
    bits = np.zeros(size, bool)
    for row in tasks.select("share", "counts").toLocalIterator():
        bits[row["share"] * SHARE : (row["share"] + 1) * SHARE] = _counts(bytes(row["counts"]), min_count) >= min_count
    return np.packbits(bits, bitorder="little").view(np.uint64)


def _phrase_buckets(frequent: DataFrame, size: int) -> np.ndarray:
    """A bit for each bucket: whether a frequent phrase's name is in it."""
    b = F.col("hash").bitwiseAND(F.lit(size - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), b.bitwiseAND(F.lit(63)).cast("int"))
    words = frequent.groupBy(F.shiftright(b, 6).cast("int").alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bitmap = np.zeros(size // 64, np.int64)
    bitmap[words["at"].to_numpy()] = words["bits"].to_numpy()
    return bitmap.view(np.uint64)


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = 100, max_words: int = 5) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f) of all phrases of up to ``max_words`` words that occur ``min_count`` times in a language, and (lang, n) of all words."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    coded = written(texts.mapInArrow(_coded, _CODED), "coded")
    n = coded.agg(F.sum("n")).first()[0] or 0
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-n // TASK))
    blocks = coded.select("lang", "words", "ids", "sizes").coalesce(tasks)
    size = min(MOST_BUCKETS, max(SHARE, 1 << (n // WORDS_EACH).bit_length()))
    buckets = phrases = None
    out = []
    for k in range(max_words + 1):
        counted = written(blocks.mapInArrow(_pass(k, max_words, min_count, size, buckets, phrases), _COUNTED), "counted")
        if k:
            whole = counted.where("phrase is not null").groupBy("lang", "phrase").agg(F.sum("n").alias("f"), F.min("hash").alias("hash"))
            found = written(whole.where(F.col("f") >= min_count), "frequent")
            phrases = _phrase_buckets(found, size)
            out.append(found.select("lang", "phrase", F.lit(k).alias("k"), "f"))
        if k < max_words:
            buckets = _frequent_buckets(counted, min_count, size)
    frequent = out[0]
    for more in out[1:]:
        frequent = frequent.union(more)
    return frequent, coded.groupBy("lang").agg(F.sum("n").alias("n"))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = 100, max_words: int = 5, top: int = 2000) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score, cut.

    Texts are lower-cased (A-Z), split into pieces at ``.,;:!?``, line ends and \\x0b-\\x0d, and these into words at
    spaces and tabs. Candidates are phrases of 2 to ``max_words`` words that occur a >= ``min_count`` times inside
    pieces of their language. With n words in all, and the parts before and behind a cut occurring l and r times, a
    cut's score is floor(1000 * a * n / (l * r)); the candidate's is that of its lowest cut, the first where they tie.
    A candidate goes whose words lie side by side in a longer candidate that occurs as often. Order: score and a
    descending, then the phrase's UTF-8 bytes.

    Null texts are empty; a null language is ``und``. Rows that repeat count each time. Other columns are not read. An
    empty table gives an empty result. Scores are exact up to 1000 * a * n below 10 ** 38.
    """
    frequent, totals = frequent_phrases(docs, text_col, lang_col, min_count, max_words)
    words = F.split("phrase", " ")
    part = lambda begin, size: F.array_join(F.slice("w", begin, size), " ")
    found = frequent.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), words.alias("w"))

    cuts = found.select("lang", "phrase", "k", "a", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("left"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    side = lambda name, f: frequent.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    big = lambda c: F.col(c).cast(T.DecimalType(19, 0))
    scored = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"]).join(totals, "lang")
    whole = F.lit(1000).cast(T.DecimalType(4, 0)) * (big("a") * big("n"))
    scored = scored.withColumns({"top": whole, "under": big("l") * big("r")}).withColumn("score", F.expr("top div under"))
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "l", "r", "n", "a")).alias("x")).select("lang", "phrase", "x.*")

    spans = F.expr("flatten(transform(sequence(2, k - 1), size -> transform(sequence(1, k - size + 1), i -> array_join(slice(w, i, size), ' '))))")
    inside = found.where("k > 2").select("lang", F.explode(spans).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = lowest.join(inside, ["lang", "phrase"], "left").where("longer is null or longer < a")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    out = left.withColumn("rank", rank).where(F.col("rank") <= top)
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", F.col("cut").cast("long").alias("cut"))
