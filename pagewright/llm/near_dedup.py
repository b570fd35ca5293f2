"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full sets, union-find grouping.

1. A document's set of word shingles is hashed to 64 bits a shingle; equal sets are one class from here on.
2. Every class gets a SuperMinHash signature and from it one key for each band.
3. Buckets of equal band keys are divided by size: any two sizes that a link may have meet in one of them, and none is
   more than (100 / percent) ** 2 times another. In every bucket all members are compared with the smallest, its head: linear in the bucket.
   A candidate pair is a link only after its whole shingle sets have been compared.
4. Members u, v of a bucket that the first components leave apart are decided by what they share beside its head R.
   Where both are close to R, a link must share some of the shingles in which they differ from R; where u or v has
   little in common with R, some of the shingles outside R. How many is known from sizes, so that a prefix of these
   shingles must meet, in the order of how many members hold a shingle: what most of them share is met last, if at
   all. Sketches of the differences, a few words a text, then bound what a pair can have in common. Pairs that are left
   are decided exactly, by their differences from R or on full sets.
5. Links meet in union-find forests, first inside each partition, then across partitions by star contraction.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, words, written

#: Signature registers: BANDS bands of ROWS. A pair of similarity 0.8 misses every band with probability 1.3e-7.
BANDS, ROWS = 40, 5
#: Shingles whose permutations are in memory at once.
CHUNK = 100_000
#: Ids of candidate pairs that are broadcast at most, so that texts without a candidate stay where they are; beyond it
#: the same texts are found by a join that deals out all of them. Results are the same.
BROADCAST_IDS = 1_000_000

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def super_minhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash signatures of sets of 64-bit hashes: one row of ``m`` registers for each set.

    Element by element a random permutation of the registers is walked; at step j the element offers register p(j)
    the rank j and a random fraction. A register that has a value from an earlier step can't improve, so a set is done
    after the first step that leaves none of its registers empty. A set without elements has registers of all ones.
    """
    empty = np.iinfo(np.uint64).max
    sig = np.full((len(sets), m), empty, _U)
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    at = 0
    while at < len(order):
        upto = at + max(1, int(np.searchsorted(np.cumsum(sizes[order[at:]]), CHUNK, side="right")))
        own = order[at:upto]
        at = upto
        x = np.concatenate([sets[i] for i in own]).view(_U) if len(own) > 1 else sets[own[0]].view(_U)
        row = np.repeat(np.arange(len(own)), sizes[own])
        part = np.full((len(own), m), empty, _U)
        perm = None
        for j in range(m):
            r = _mix(x + _U((0x9E3779B97F4A7C15 * (j + 1)) % 2**64))
            k = (j + (r & _U(0xFFFFFFFF)) % _U(m - j)).astype(np.int64)
            value = (_U(j) << _U(32)) | (r >> _U(32))
            if perm is None:
                register = k
            else:
                ids = np.arange(len(x))
                register = perm[ids, k].astype(np.int64)
                perm[ids, k] = perm[:, j]
            cell = row * m + register
            flat = part.reshape(-1)
            free = flat[cell] >= (_U(j) << _U(32))
            np.minimum.at(flat, cell[free], value[free])
            todo = (part == empty).any(axis=1)
            if not todo.any():
                break
            keep = todo[row]
            if perm is None:
                rest = np.flatnonzero(keep)
                perm = np.tile(np.arange(m, dtype=np.uint16), (len(rest), 1))
                perm[np.arange(len(rest)), k[rest]] = 0
                x, row = x[rest], row[rest]
            elif not keep.all():
                x, row, perm = x[keep], row[keep], perm[keep]
        sig[own] = part
    return sig


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    key = np.tile(_mix(np.arange(1, bands + 1, dtype=_U)), (len(sig), 1))
    parts = sig.reshape(len(sig), bands, rows)
    for i in range(rows):
        key = _mix(key * _U(0x9E3779B97F4A7C15) + parts[:, :, i])
    return key.view(np.int64)


def shingle_set(text: Column, size: int = 5) -> Column:
    """The distinct ``size``-word shingles of a text as 64-bit hashes; a shorter text is one shingle, a blank one none.

    A-Z are lower-cased; words are runs of other characters than blanks.
    """
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def shingles(w: Column) -> Column:
        many = F.transform(F.slice(w, F.lit(1), F.size(w) - (size - 1)), lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, size)]))
        whole = F.array(F.xxhash64(F.array_join(w, " ")))
        return F.when(F.size(w) >= size, F.array_distinct(many)).when(F.size(w) > 0, whole).otherwise(F.array().cast("array<bigint>"))

    return let(words(lower), shingles)


def _signed(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """id, n, the set's key (ka, kb), the text's hash and the band keys of each row."""

    @F.pandas_udf("array<bigint>")
    def keys(hashes: pd.Series) -> pd.Series:
        return pd.Series(list(band_keys(super_minhash(list(hashes), bands * rows), bands, rows)))

    sets = docs.select("id", F.xxhash64("text").alias("th"), shingle_set(F.col("text"), shingle).alias("s"))
    same = lambda s: F.struct(F.xxhash64(s).alias("a"), F.xxhash64(F.lit(7), s).alias("b"))
    out = sets.select("id", "th", F.size("s").cast("long").alias("n"), let(F.sort_array("s"), same).alias("k"), keys("s").alias("keys"))
    return out.select("id", "th", "n", F.col("k.a").alias("ka"), F.col("k.b").alias("kb"), "keys")


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edges of a partition as a union-find forest: each node that isn't the smallest of its tree, and that smallest."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := root.get(x, x)) != x:
            root[x] = root.get(p, p)
            x = root[x]
        return x

    for pdf in batches:
        for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist(), strict=True):
            a, b = find(u), find(v)
            if a != b:
                root[max(a, b)] = min(a, b)
    nodes = list(root)
    yield pd.DataFrame({"u": np.array(nodes, np.int64), "v": np.array([find(x) for x in nodes], np.int64)})


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for the nodes of ``edges`` (u, v), longs: the smallest node that is reachable. Loops are ignored.

    Each round first shrinks every partition's edges to a union-find forest, then links all larger neighbours of a
    node to its smallest one (large star), then all smaller neighbours and the node itself (small star). It ends when
    every node hangs on its component's smallest. Rounds are written to the shared folder.
    """
    now = written(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().mapInPandas(_forest, "u long, v long"), name)
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(small.select("u", F.col("m").alias("v")))
        now = written(star.distinct().mapInPandas(_forest, "u long, v long").distinct(), name)
        parents = now.groupBy("u").agg(F.count("*").alias("c"), F.min("v").alias("v"))
        unfinished = parents.where("c > 1").select("u").union(parents.join(now.select(F.col("u").alias("v")).distinct(), "v", "left_semi").select("u"))
        if unfinished.isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _compared(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (u, v) with the sizes of their whole shingle sets (nu, nv), of the intersection (i), and linked.

    outside has the shingles of u that v lacks. close: v holds half of u or more, and u of v; or v holds so
    much of u that a link of u may have all it shares in v. Then missing has the shingles of v that u lacks, else none. Both texts of a pair meet in one row.
    """
    asked = pairs.select("u", "v", F.explode(F.array("u", "v")).alias("id"))
    ids = written(asked.select("id").distinct(), "asked")
    if ids.count() <= BROADCAST_IDS:  # else the join below deals out all texts
        docs = docs.join(F.broadcast(ids), "id", "left_semi")
    side = lambda name: F.min_by(F.when(F.col("id") == F.col(name), F.col("text")), F.when(F.col("id") == F.col(name), F.xxhash64("text")))
    texts = asked.join(docs, "id").groupBy("u", "v").agg(side("u").alias("a"), side("v").alias("b"))
    sets = texts.select("u", "v", shingle_set(F.col("a"), shingle).alias("a"), shingle_set(F.col("b"), shingle).alias("b"))
    o, m = F.sort_array(F.array_except("a", "b")), F.array_except("b", "a")
    sets = sets.select("u", "v", F.size("a").alias("nu"), F.size("b").alias("nv"), o.alias("o"), m.alias("m")).withColumn("i", F.col("nu") - F.size("o"))
    linked = 100 * F.col("i") >= percent * (F.col("nu") + F.col("nv") - F.col("i"))
    close = (2 * F.col("i") >= F.greatest("nu", "nv")) | (100 * F.col("i") >= percent * F.col("nu"))
    sets = sets.withColumn("linked", linked).withColumn("close", close)
    missing = F.when(F.col("close"), F.col("m")).otherwise(F.array().cast("array<bigint>"))
    return sets.select("u", "v", "nu", "nv", "i", "linked", "close", F.col("o").alias("outside"), missing.alias("missing"))


def by_size(key_rows: DataFrame, percent: int) -> DataFrame:
    """(id, key), two rows for each (id, n, key): every key is divided into overlapping ranges of n, so that sizes in a ratio of percent / 100 share one."""
    step = math.log(100 / percent) + 1e-9  # more than the ratio, so that rounding parts no two
    at = F.floor(F.log("n") / step)
    return key_rows.select("id", F.explode(F.array(F.xxhash64("key", at), F.xxhash64("key", at + 1))).alias("key")).distinct()


def _prefixes(rows: DataFrame, items: str) -> DataFrame:
    """``rows`` with shared: those of ``items`` that another member of the head holds, (c, s), rarest first; c members hold s. Rows with none go."""
    s = rows.select("head", "id", F.explode(items).alias("s"))
    held = s.groupBy("head", "s").agg(F.count("*").alias("c")).where("c > 1")
    shared = s.join(held, ["head", "s"]).groupBy("head", "id").agg(F.sort_array(F.collect_list(F.struct("c", "s"))).alias("shared"))
    return rows.join(shared, ["head", "id"])


def _prefix(items: str, need: Column) -> Column:
    """The first of ``shared``, of which two members meet in one if they have ``need`` of ``items`` in common, or more.

    With items in one order for all members, each two links meet within all but so many, less one. Items that no other
    member holds come first: they can't meet and only count.
    """
    alone = F.size(items) - F.size("shared")
    prefix = F.slice("shared", F.lit(1), F.greatest(F.lit(0), F.size(items) - F.greatest(F.lit(1), need) + 1 - alone))
    return F.transform(prefix, lambda x: x["s"])


#: Words of 64 bits in a sketch.
SKETCH = 8


def _sketch(items: Column) -> Column:
    """A bit for each item, of SKETCH * 64: a bit that one sketch has and another lacks stands for an item that the other set lacks."""
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(x, 3).bitwiseAND(F.lit(63)).cast("int"))
    word = lambda j: F.aggregate(items, F.lit(0).cast("long"), lambda a, x: F.when(x.bitwiseAND(F.lit(SKETCH - 1)) == j, a.bitwiseOR(bit(x))).otherwise(a))
    return F.array(*[word(j) for j in range(SKETCH)])


def _close_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(head, u, v) of members close to the head, of different components, that may be links; one of them is loose.

    Let D be the shingles in which a member of n shingles differs from the head, d their number, and
    w = (100 + percent) d - (100 - percent) n. Links u, v have (w(u) + w(v)) / (2 (100 + percent)) of D in common, or
    more. A member that is no link of the head has w > b = (100 - percent) nh, any has w >= -b; of two members of
    different components one at least is no link of the head, so that the bound is over 0. Hence of two that are no
    links, that with the smaller w shares w / (100 + percent), the other (w + b) / (2 (100 + percent)); one that is a
    link shares (w + b) / (2 (100 + percent)) with one that isn't, and this (w - b) / (2 (100 + percent)).
    """
    p, q = 100 + percent, 100 - percent
    rows = rows.select("head", "id", "n", "component", "linked", "loose", F.concat("outside", "missing").alias("d"), (q * F.col("nh")).alias("b"))
    rows = _prefixes(rows.withColumns({"w": p * F.size("d") - q * F.col("n"), "sketch": _sketch(F.col("d"))}), "d")
    share = lambda x, over: F.ceil(x / over).cast("int")
    side = lambda members, need: members.select("head", "id", "n", "w", "component", "loose", "sketch", F.size("d").alias("size"), F.explode(_prefix("d", need)).alias("s"))
    no_links = rows.where("not linked")
    less, more = side(no_links, share(F.col("w"), p)), side(no_links, share(F.col("w") + F.col("b"), 2 * p))
    alone, links = side(no_links.where("loose"), share(F.col("w") - F.col("b"), 2 * p)), side(rows.where("linked"), share(F.col("w") + F.col("b"), 2 * p))

    def met(x: DataFrame, y: DataFrame, ordered: Column) -> DataFrame:
        near = (F.col("a.component") != F.col("b.component")) & (100 * F.least("a.n", "b.n") >= percent * F.greatest("a.n", "b.n"))
        lacks = lambda i, j: sum((F.bit_count(F.get(f"{i}.sketch", F.lit(k)).bitwiseAND(F.bitwise_not(F.get(f"{j}.sketch", F.lit(k))))) for k in range(SKETCH)), F.lit(0))
        at_most = F.least(F.col("a.size") - lacks("a", "b"), F.col("b.size") - lacks("b", "a"))
        pairs = x.alias("a").join(y.alias("b"), (F.col("a.head") == F.col("b.head")) & (F.col("a.s") == F.col("b.s")) & near & ordered & (2 * p * at_most >= F.col("a.w") + F.col("b.w")))
        return pairs.select(F.col("a.head").alias("head"), F.greatest("a.id", "b.id").alias("u"), F.least("a.id", "b.id").alias("v"))

    rising = F.col("a.w") <= F.col("b.w")
    return met(less.where("loose"), more, rising).union(met(less, more.where("loose"), rising)).union(met(alone, links, F.lit(True))).distinct()


def _apart(compared: DataFrame, buckets: DataFrame, groups: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links, and pairs that may be links, (u, v) of a bucket beside its head and of different components; one is loose, of another than the head.

    With p = percent, a pair is a link where (100 + p) |u & v| >= p (nu + nv). Where both are close to the head, of size
    nh, |u & v| is nh less what u and what v lack of it, plus what both lack, plus what both have outside.
    """
    members = buckets.where("id != first").join(groups, F.col("id") == F.col("node"), "left").select("key", "first", "id", F.coalesce("component", "id").alias("component"))
    mixed = members.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("key")
    apart = members.join(mixed, "key").select(F.col("first").alias("v"), F.col("id").alias("u"), "component").distinct()
    heads = groups.select(F.col("node").alias("v"), F.col("component").alias("top"))
    apart = apart.join(heads, "v", "left").withColumn("loose", F.col("component") != F.coalesce("top", "v")).drop("top")
    rows = written(compared.join(apart, ["u", "v"]).withColumnsRenamed({"v": "head", "u": "id", "nu": "n", "nv": "nh"}), "apart")

    d = rows.where("close")
    one = lambda name: d.select("head", F.col("id").alias(name), F.struct("n", "nh", "outside", "missing").alias(f"{name}_"))
    pairs = written(_close_pairs(d, percent), "pairs").join(one("u"), ["head", "u"]).join(one("v"), ["head", "v"])
    both = lambda c: F.size(F.array_intersect(f"u_.{c}", f"v_.{c}"))
    shared = F.col("u_.nh") - F.size("u_.missing") - F.size("v_.missing") + both("missing") + both("outside")
    links = pairs.where((100 + percent) * shared >= percent * (F.col("u_.n") + F.col("v_.n"))).select("u", "v").distinct()

    # a link shares percent * n / 100 - i of the shingles outside the head, one or more for the text that isn't close
    s = _prefixes(rows.select("head", "id", "n", "i", "component", "loose", "close", "outside"), "outside")
    s = s.select("head", "id", "n", "component", "loose", "close", F.explode(_prefix("outside", F.ceil((percent * F.col("n") - 100 * F.col("i")) / 100).cast("int"))).alias("s"))
    near = (F.col("a.id") != F.col("b.id")) & (F.col("a.component") != F.col("b.component")) & (100 * F.least("a.n", "b.n") >= percent * F.greatest("a.n", "b.n"))
    far = s.where("loose").alias("a").join(s.alias("b"), (F.col("a.head") == F.col("b.head")) & (F.col("a.s") == F.col("b.s")) & near & ~(F.col("a.close") & F.col("b.close")))
    return links, far.select(F.greatest("a.id", "b.id").alias("u"), F.least("a.id", "b.id").alias("v")).distinct().join(compared.select("u", "v"), ["u", "v"], "left_anti")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """A row for each id: id, n_shingles, component_id (the smallest id reachable over links, itself included), kept.

    Two documents are linked where 100 * intersection >= percent * union of their shingle sets. Null and blank texts
    have an empty set and are linked with nothing. Ids are integers; rows with a null id are left out, and of rows
    that repeat an id one counts, that whose text has the smallest hash. Other columns are not read. An empty table
    gives an empty result.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where("id is not null")
    signed = written(_signed(texts, shingle, bands, rows), "signed")
    if not signed.groupBy("id").count().where("count > 1").isEmpty():
        first_row = F.row_number().over(Window.partitionBy("id").orderBy("th", "ka", "kb"))
        signed = written(signed.withColumn("at", first_row).where("at = 1").drop("at"), "signed")
    classes = written(signed.where("n > 0").groupBy("ka", "kb").agg(F.min("id").alias("rep")), "classes")
    key_rows = signed.join(classes.select(F.col("rep").alias("id")), "id", "left_semi").select("id", "n", F.explode("keys").alias("key")).distinct()
    key_rows = by_size(written(key_rows.join(key_rows.groupBy("key").count().where("count > 1").select("key"), "key", "left_semi"), "keys"), percent)
    stars = key_rows.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
    buckets = written(key_rows.join(stars, "key"), "buckets")

    first = written(buckets.where("id != first").select(F.col("id").alias("u"), F.col("first").alias("v")).distinct(), "first")
    compared = written(_compared(first, texts, shingle, percent), "compared")
    groups = components(compared.where("linked").select("u", "v"))
    more, second = _apart(compared, buckets, groups, percent)
    more, second = written(more, "links"), written(second, "second")
    if not second.isEmpty():
        more = more.union(_compared(second, texts, shingle, percent).where("linked").select("u", "v"))
    groups = components(more.union(groups.select(F.col("node").alias("u"), F.col("component").alias("v"))))

    by_class = classes.join(groups, classes["rep"] == groups["node"], "left").select("ka", "kb", F.coalesce("component", "rep").alias("component"))
    members = signed.select("id", "n", "ka", "kb").join(by_class, ["ka", "kb"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    out = members.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.col(id_col) == F.col("component_id"))
