"""Document fingerprints: one-permutation MinHash with optimal densification, stored as packed low-order bits.

Every shingle of a text is hashed once. The top bits of the hash choose one of ``bins`` bins, and each bin keeps the
smallest hash that fell into it. An empty bin takes the value of a full one (optimal densification): each bin has one
fixed random order of all bins, the same for every text, and takes the first full bin in it, so that two texts agree
in a filled bin as often as in any other. Of each bin the
low ``bits`` bits are stored; chance agreement of these is taken off the likeness. All of it is built-in expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, words

BINS, BITS, SHINGLE = 256, 8, 5
#: The order of bins for an empty bin: by the draw that first gives them, among so many draws that are tried a step at a
#: time; then, for bins that no draw gives, by hash. This is one random order, as it depends on no text.
DRAWS = (8, 64)
#: Ranges of ids at most, among which neighbours are looked up; beyond, ranges grow. A window sorts a range on disk, so
#: that no range has to be in memory.
RANGES = 4_000


def bin_minima(text: Column, bins: int = BINS, shingle: int = SHINGLE) -> Column:
    """An array with the smallest shingle hash of every bin, null where a bin is empty.

    Shingles are runs of ``shingle`` words; a text of fewer words is one shingle; one without words leaves all empty.
    """
    shift = 63 - (bins.bit_length() - 1)
    if bins != 1 << (63 - shift):
        raise ValueError("bins must be a power of two")

    def hashes(w: Column) -> Column:
        many = F.transform(F.slice(w, F.lit(1), F.size(w) - (shingle - 1)), lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, shingle)]))
        return F.when(F.size(w) >= shingle, many).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))

    def spread(s: Column) -> Column:
        """The sorted minima, with a null before each bin that has none."""

        def with_gaps(m: Column) -> Column:
            key = lambda k: F.shiftright(F.get(m, k), shift).cast("int")
            gap = lambda x, i: F.array_repeat(F.lit(None).cast("bigint"), F.shiftright(x, shift).cast("int") - F.when(i == 0, F.lit(-1)).otherwise(key(i - 1)) - 1)
            filled = F.flatten(F.transform(m, lambda x, i: F.concat(gap(x, i), F.array(x))))
            return let(filled, lambda x: F.concat(x, F.array_repeat(F.lit(None).cast("bigint"), bins - F.size(x))))

        new = lambda x, i: (i == 0) | (F.shiftright(x, shift) != F.shiftright(F.get(s, i - 1), shift))
        return let(F.filter(s, new), with_gaps)

    positive = F.transform(let(words(text), hashes), lambda h: h.bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF)))
    return let(F.sort_array(positive), spread)


def densified(minima: Column, bins: int = BINS) -> Column:
    """``minima`` with every empty bin filled from a full one; all zeros where no bin is full."""

    def fill(m: Column) -> Column:
        def drawn(b: Column, n: int) -> Column:
            tried = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda t: F.get(m, F.pmod(F.xxhash64(b, t), F.lit(bins)).cast("int")))
            return F.get(F.filter(tried, lambda v: v.isNotNull()), 0)

        full = lambda b: F.filter(F.transform(m, lambda v, i: F.when(v.isNotNull(), F.struct(F.xxhash64(b, F.lit(-1), i).alias("h"), v.alias("v")))), lambda x: x.isNotNull())
        return F.transform(m, lambda v, b: F.coalesce(v, *[drawn(b, n) for n in DRAWS], F.array_min(full(b))["v"]))

    empty = F.array_repeat(F.lit(0).cast("bigint"), bins)
    return let(minima, lambda m: F.when(F.size(F.array_compact(m)) > 0, fill(m)).otherwise(empty))


def fingerprint(text: Column, bins: int = BINS, bits: int = BITS, shingle: int = SHINGLE) -> Column:
    """The low ``bits`` (at most 8) of every bin of a text, as an array of small integers. Equal texts have equal ones."""
    if not 1 <= bits <= 8:
        raise ValueError("bits must be from 1 to 8")
    low = lambda v: (v.bitwiseAND(F.lit((1 << bits) - 1)) - (1 << (bits - 1))).cast("tinyint")
    return F.transform(densified(bin_minima(text, bins, shingle), bins), low)


def packed(bins_: Column, bits: int = BITS) -> Column:
    """A fingerprint as a hexadecimal string; bins of 4 bits take one digit, others two."""
    digits = 1 if bits <= 4 else 2
    return F.array_join(F.transform(bins_, lambda v: F.lower(F.lpad(F.hex(v.cast("int") + (1 << (bits - 1))), digits, "0"))), "")


def likeness(a: Column, b: Column, bits: int = BITS) -> Column:
    """The estimated Jaccard similarity of two texts by their fingerprints, from 0 to 1; equal fingerprints give 1."""
    chance = 2.0**-bits
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.size(a)
    return F.greatest(F.lit(0.0), (same - chance) / (1 - chance))


def with_next(docs: DataFrame, id_col: str, carry: list[str], n_buckets: int, derive: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """``derive(docs)`` with ``next_<c>`` for each column of ``carry``: those of the next row by descending id.

    Ids are numbers. After the last row comes the first. Null ids come last; equal ids are in the order of the first carried column.
    Rows are dealt into ranges of ids of about equal size; in a range a window gives the next row, and the first row
    of the range after it joins as a guest, so that no task sees more than its range.
    """
    ids = docs.where(F.col(id_col).isNotNull()).agg(F.percentile_approx(id_col, [i / n_buckets for i in range(1, n_buckets)], 100 * n_buckets).alias("cut")) if n_buckets > 1 else None
    cuts = sorted(set((ids.first()["cut"] if ids is not None else None) or []), reverse=True)  # one number a range
    bucket = F.lit(len(cuts) + 1)
    if cuts:  # the number of cuts at or above the id, by binary search
        at = F.array(*[F.lit(int(c)) for c in cuts])
        step = lambda s, _, x, t: F.when(s["lo"] < s["hi"], F.when(F.get(t, F.shiftright(s["lo"] + s["hi"], 1)) >= x, F.struct((F.shiftright(s["lo"] + s["hi"], 1) + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), F.shiftright(s["lo"] + s["hi"], 1).alias("hi")))).otherwise(s)
        rounds = F.array_repeat(F.lit(0), len(cuts).bit_length() + 1)
        start = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))
        found = let(at, lambda t: let(F.col(id_col), lambda x: F.aggregate(rounds, start, lambda s, i: step(s, i, x, t), lambda s: s["lo"])))
        bucket = F.when(F.col(id_col).isNotNull(), found).otherwise(bucket)
    dealt = docs.withColumn("_bucket", bucket.cast("int"))
    order = [F.col(id_col).desc_nulls_last(), F.col(carry[0]).asc_nulls_last()]
    tops = dealt.groupBy("_bucket").agg(F.max(id_col).alias("top")).orderBy("_bucket").collect()  # a number or two a range
    if not tops:
        tops = [{"_bucket": 0, "top": None}]
    # the guests: the head of each range, sent to the range before it, below all of its rows
    heads = [(t["_bucket"], tops[i - 1]["_bucket"], t["top"]) for i, t in enumerate(tops)]
    spark = docs.sparkSession
    head = F.broadcast(spark.createDataFrame(heads, f"_bucket int, _to int, _top {docs.schema[id_col].dataType.simpleString()}"))
    guests = dealt.join(head, (dealt["_bucket"] == head["_bucket"]) & dealt[id_col].eqNullSafe(head["_top"])).select(*[dealt[c] for c in docs.columns], F.col("_to").alias("_bucket"), F.lit(1).alias("_guest"))
    w = Window.partitionBy("_bucket").orderBy("_guest", *order)
    both = derive(dealt.withColumn("_guest", F.lit(0)).unionByName(guests))
    out = both.select("*", *[F.lead(F.struct(c)).over(w)[c].alias(f"next_{c}") for c in carry])
    return out.where("_guest = 0").drop("_bucket", "_guest")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bins: int = BINS, bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """Per row: id, n_chars, edited (text), fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the first half (its longer half if odd) of the text, then as many code points as are missing
    from the start of the next document by descending id, or all of it. Null texts count as empty; a text without
    words has a fingerprint of zeros in all bins, and its likeness to another of that kind is 1. A table of one row has itself as its
    next; an empty table gives an empty result. Repeated rows follow each other.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    spark = docs.sparkSession
    n_buckets = min(RANGES, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = with_next(rows, "id", ["text", "fp"], n_buckets, lambda d: d.withColumn("fp", fingerprint(F.col("text"), bins, bits, shingle)))
    edited = rows.select("id", F.length("text").cast("long").alias("n_chars"), "fp", "next_fp", F.concat(F.expr("substring(text, 1, length(text) - length(text) div 2)"), F.expr("substring(next_text, 1, length(text) div 2)")).alias("edited"))
    edited = edited.withColumn("edited_fp", fingerprint(F.col("edited"), bins, bits, shingle))
    return edited.select(
        F.col("id").alias(id_col), "n_chars", "edited", packed(F.col("fp"), bits).alias("fingerprint"), packed(F.col("edited_fp"), bits).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp"), bits).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp"), bits).alias("near_next"),
    )
