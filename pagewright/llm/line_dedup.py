"""Line deduplication: winnowed hashes of words find passages that repeat; later copies of a passage are deleted.

Every word goes that lies in a stretch of ``min_words`` words which occurs earlier in the corpus: in a document of a
smaller id, or before in the same document. A passage may begin and end inside a line, and is found in whatever lines
it was put.

1. A stretch of ``min_words`` words holds WINDOW grams of GRAM words. Grams are fingerprints where the hash of their
   first two words is low; a stretch belongs to the first such gram in it, in want of that to the last one of a
   second, more frequent kind, and else stands for itself. Copies of a stretch thus have the same fingerprint.
2. Where all words of a fingerprint's stretches occur together earlier, all of these stretches do. Of the others those
   are left whose fingerprint is not the only one: they are joined back to their documents.
3. There every stretch is hashed; all but the first of equal ones occur earlier.
4. Words of stretches that occur earlier go. All of it is DataFrame operations on built-in functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, words, written

MIN_WORDS, WINDOW = 36, 29
#: One gram in so many is taken as a fingerprint, and in stretches that have none of these one in so many.
RATE, MORE_RATE = 11, 4
_MORE = 1 << 30  # marks the latter
_MARK = "\x01"


def cut_lines(text: Column) -> Column:
    """The lines of a text, each with what follows it up to the next; joined they are the text."""
    marked = F.replace(text, F.lit("\n"), F.lit("\n" + _MARK))
    for end in ".!?":
        marked = F.replace(marked, F.lit(end + " "), F.lit(end + " " + _MARK))
    return F.when(F.contains(text, F.lit(_MARK)), F.split(text, r"(?<=\n)|(?<=[.!?] )")).otherwise(F.split(marked, _MARK))


def count_lines(text: Column) -> Column:
    """How many lines ``cut_lines`` gives."""
    size = F.octet_length(text)
    count = lambda end: F.floor((size - F.octet_length(F.replace(text, F.lit(end), F.lit("")))) / len(end))
    return (1 + sum((count(end) for end in ("\n", ". ", "! ", "? ")), F.lit(0))).cast("int")


def cut_words(text: Column) -> Column:
    """The words of a text, each with the blanks that follow it, and perhaps an empty one behind; blanks before the first word belong to none."""
    begun = F.regexp_replace(text, r"^[\x20\x09-\x0D]+", "")
    marked = F.replace(F.replace(begun, F.lit(" "), F.lit(" " + _MARK)), F.lit("\n"), F.lit("\n" + _MARK))
    odd = [x + y for x in " \n" for y in " \n"] + ["\t", "\x0b", "\x0c", "\r", _MARK]
    any_odd = reduce(Column.__or__, (F.contains(text, F.lit(x)) for x in odd))
    return F.when(any_odd, F.split(begun, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")).otherwise(F.split(marked, _MARK))


def fingerprints(docs: DataFrame, min_words: int = MIN_WORDS, window: int = WINDOW) -> DataFrame:
    """at, f, c, a and b: for the documents (at and w, their words) the hash f of each fingerprint, its stretches from a to b, and c, the hash of all words of these.

    Every stretch belongs to one row. Lambdas are interpreted and see each word once; the rest is compiled.
    """
    gram = min_words - window + 1
    last = F.size("w") - min_words

    def below(rate: int):
        """Whether the hash of two words lies in the least of ``rate`` parts."""
        pair = lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1)) if gram > 1 else F.xxhash64(F.get("w", i))
        return lambda i: pair(i) < F.lit(-(2**63) + 2**64 // rate)

    def filled(e: Column) -> Column:
        """Each place as x with ``before``, the last one of the first kind; in wider gaps places of the second kind as well."""
        before = lambda i: F.coalesce(F.get(e, i - 1), F.lit(-1))
        more = lambda x, y: F.transform(F.filter(F.sequence(y + 1, x - 1), below(MORE_RATE)), lambda z: _range(y, z).bitwiseOR(F.lit(_MORE)))
        each = lambda x, y: F.when(x - y > window, F.concat(more(x, y), F.array(_range(y, x)))).otherwise(F.array(_range(y, x)))
        return F.flatten(F.transform(e, lambda x, i: each(x, before(i))))

    ends = F.concat(F.filter(F.sequence(F.lit(0), last + (window - 1)), below(RATE)), F.array(last + window))
    # outer, as Spark would infer a filter from the others and split the texts once more for that
    anchors = docs.select("at", "w", F.when(last >= 0, let(ends, filled)).alias("ends")).select("at", "w", "ends", F.posexplode_outer("ends").alias("i", "x")).where("x is not null")
    place = lambda x: F.coalesce(_end(x).bitwiseAND(F.lit(_MORE - 1)), F.lit(-1))
    near = place(F.get("ends", F.col("i") - 1)), place(F.get("ends", F.col("i") + 1))
    anchors = anchors.select("at", "w", place(F.col("x")).alias("x"), _begin(F.col("x")).alias("before"), near[0].alias("left"), near[1].alias("right"), (F.col("x").bitwiseAND(F.lit(_MORE)) != 0).alias("more"))
    upto = F.when(F.col("more"), F.least("x", F.col("right") - window)).otherwise(F.least("x", last))
    anchors = anchors.select("at", "w", "x", "left", F.greatest(F.col("before") + 1, F.col("x") - (window - 1)).alias("first"), upto.alias("last"))
    alone = F.col("x") - window  # up to here stretches have no fingerprint, and stand for themselves
    own = F.when(F.col("first") <= F.col("last"), F.array("first")).otherwise(F.array().cast("array<int>"))
    starts = F.when(alone > F.col("left"), F.concat(F.sequence(F.col("left") + 1, alone), own)).otherwise(own)
    each = anchors.select("at", "w", "x", "last", F.explode_outer(starts).alias("a")).where("a is not null")
    single = F.col("a") <= alone
    each = each.select("at", "w", "a", single.alias("single"), F.when(single, F.col("a")).otherwise(F.col("last")).alias("b"), F.when(single, F.col("a")).otherwise(F.col("x")).alias("x"), F.when(single, min_words).otherwise(gram).alias("n"))
    each = each.select("at", "w", "a", "b", "x", "single", F.xxhash64(F.slice("w", F.col("x") + 1, F.col("n"))).alias("f"))
    c = F.when(F.col("single"), F.col("f")).otherwise(F.xxhash64(F.col("x") - F.col("a"), F.slice("w", F.col("a") + 1, F.col("b") - F.col("a") + min_words)))
    return each.select("at", "f", c.alias("c"), "a", "b")


def _range(a: Column, b: Column) -> Column:
    """Two places as one number that sorts like them."""
    return F.shiftleft(a.cast("long"), 32).bitwiseOR(b.cast("long"))


def _begin(x: Column) -> Column:
    return F.shiftright(x, 32).cast("int")


def _end(x: Column) -> Column:
    return x.bitwiseAND(F.lit(2**32 - 1)).cast("int")


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with _pw_at: the id, or where rows repeat an id, the id and a number by their texts' order."""
    out = docs.withColumn("_pw_at", F.col(id_col))
    ids = docs.select(F.col(id_col).alias("_pw_at")).where("_pw_at is not null")
    if ids.groupBy("_pw_at").count().where("count > 1").isEmpty():
        return out
    copy = F.row_number().over(Window.partitionBy("_pw_at").orderBy(text_col))
    return out.withColumn("_pw_copy", copy).withColumn("_pw_at", F.when(F.col("_pw_at").isNotNull(), F.struct("_pw_at", "_pw_copy"))).drop("_pw_copy")


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, window: int = WINDOW) -> DataFrame:
    """_pw_at and runs: for each document that has some, the runs of words (a to b) that occur earlier, in order. Ids must be unique."""
    window = max(1, min(window, min_words - 1))
    docs = docs.where(F.col(id_col).isNotNull() & (F.length(text_col) >= 2 * min_words - 1)).select(F.col(id_col).alias("at"), F.col(text_col).alias("text"))

    prints = fingerprints(docs.select("at", words(F.col("text")).alias("w")), min_words, window).repartition("f")  # dealt and sorted once for both windows
    prints = prints.withColumn("later", F.row_number().over(Window.partitionBy("f", "c").orderBy("at", "a")) > 1)
    prints = prints.withColumn("left", F.sum(F.when(F.col("later"), 0).otherwise(1)).over(Window.partitionBy("f")))
    ranges = written(prints.where("later or left > 1").select("at", _range(F.col("a"), F.col("b")).alias("x"), "later"), "ranges")

    hits = ranges.where("not later").groupBy("at").agg(F.collect_list("x").alias("hits")).hint("shuffle_hash")
    near = docs.join(hits, "at").select("at", words(F.col("text")).alias("w"), "hits").select("at", "w", F.explode_outer("hits").alias("x"))
    near = near.select("at", "w", F.explode_outer(F.sequence(_begin(F.col("x")), _end(F.col("x")))).alias("p"))
    stretches = near.select("at", "p", F.xxhash64(F.slice("w", F.col("p") + 1, min_words)).alias("c"))
    again = F.row_number().over(Window.partitionBy("c").orderBy("at", "p")) > 1
    later = stretches.withColumn("again", again).where("again").select("at", _range(F.col("p"), F.col("p")).alias("x"))
    found = later.union(ranges.where("later").select("at", "x")).groupBy("at").agg(F.sort_array(F.collect_list("x")).alias("p"))

    def joined(p: Column) -> Column:
        begins = F.filter(p, lambda x, i: (i == 0) | (_begin(x) - _end(F.get(p, i - 1)) > min_words))
        ends = F.filter(p, lambda x, i: (i == F.size(p) - 1) | (_begin(F.get(p, i + 1)) - _end(x) > min_words))
        return F.zip_with(begins, ends, lambda x, y: F.struct(_begin(x).alias("a"), (_end(y) + (min_words - 1)).alias("b")))

    return found.select(F.col("at").alias("_pw_at"), let(F.col("p"), joined).alias("runs"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out_col: str = "dedup", min_words: int = MIN_WORDS, window: int = WINDOW) -> DataFrame:
    """``docs`` with later copies of repeated runs of words cut from the text, and a struct column: n_lines, n_removed, runs.

    A run goes with the blanks behind it. n_lines is of the text as it came, n_removed by how many lines it got
    shorter, and runs has the places of the first and last word of each cut, so that it alone tells whether there was
    one. All rows and columns stay; a column that is already named ``out_col`` is replaced. Null texts stay null. A row
    with a null id stays as it is and makes no other row lose anything. Rows that repeat an id follow each other in
    the order of their texts, and so a repeated row loses what its first one keeps. A text may become empty.
    """
    rows = _numbered(docs, id_col, text_col)
    runs = repeated_runs(rows.select("_pw_at", F.col(text_col).cast("string").alias("_pw_text")), "_pw_at", "_pw_text", min_words, window)
    out = rows.join(runs.withColumnRenamed("runs", "_pw_runs"), "_pw_at", "left")

    def kept(w: Column, r: Column) -> Column:
        begins = F.concat(F.array(F.lit(0)), F.transform(r, lambda x: x["b"] + 1))
        ends = F.concat(F.transform(r, lambda x: x["a"]), F.array(F.size(w)))
        parts = F.zip_with(begins, ends, lambda a, b: F.array_join(F.slice(w, a + 1, b - a), ""))
        return F.concat(F.regexp_extract(text_col, r"^[\x20\x09-\x0D]*", 0), F.array_join(parts, ""))

    cut = let(cut_words(F.col(text_col)), lambda w: let(F.col("_pw_runs"), lambda r: kept(w, r)))
    out = out.withColumn("_pw_kept", F.when(F.col("_pw_runs").isNotNull(), cut).otherwise(F.col(text_col)))
    n_lines = lambda c: F.when(F.col(c).isNull(), 0).otherwise(count_lines(F.col(c))).cast("long")
    n_removed = F.when(F.col("_pw_runs").isNotNull(), n_lines(text_col) - n_lines("_pw_kept")).otherwise(F.lit(0)).cast("long")
    stats = F.struct(n_lines(text_col).alias("n_lines"), n_removed.alias("n_removed"), F.coalesce("_pw_runs", F.array().cast("array<struct<a:int,b:int>>")).alias("runs"))
    out = out.withColumn(out_col, stats).withColumn(text_col, F.col("_pw_kept"))
    names = [*(c for c in docs.columns if c != out_col), out_col]
    return out.select(*names)
