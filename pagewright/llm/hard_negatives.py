"""Hard negatives by product quantisation with residual norms: bounds filter, exact integer scores decide.

1. Vectors become integers, floor(scale * x). Codebooks, one for each part of PART dimensions, are fitted on SAMPLE
   rows, those with the smallest id hashes. Every row is indexed: its codes, and the norm of what the codes leave over.
2. Rows lie in packed blocks. Anchors are taken in blocks of ANCHORS, which bounds what tasks are sent; for each
   block of anchors two jobs go over all row blocks. A lookup table gives the score of an anchor with a row's codes;
   by Cauchy-Schwarz the true score is no farther from it than the anchor's norm times the row's residual norm.
3. First job: rows of the anchor's label whose upper bound reaches its best exact scores so far are scored exactly.
   Second job: the same for rows of other labels within the window that each positive opens. A row is left out only
   where its bounds prove that it can't be among the first ones, so results are those of all pairs.
4. Tasks give the first few rows for each anchor or window, Spark ranks them over all tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch_path, written

#: Dimensions of a part; centroids of a part's codebook, one byte a code.
PART, CENTROIDS = 2, 256
#: Rows at most on which codebooks are fitted, and rounds of k-means.
SAMPLE, ROUNDS = 8192, 8
#: Anchors that one job takes, anchors whose lookup tables are in memory at once, rows of a block.
ANCHORS, TABLES, BLOCK = 4096, 256, 4096
#: Rows whose exact scores are computed at once.
EXACT = 65_536

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long, positive_rank int"
_BLOCKS = "ids binary, labels binary, vectors binary, codes binary, residuals binary"
_ANCHORS = "block long, ids binary, labels binary, vectors binary"


def _parts(x: np.ndarray) -> np.ndarray:
    """(rows, parts, PART) of (rows, dimensions), with zeros at the end."""
    more = -x.shape[1] % PART
    return np.pad(x, ((0, 0), (0, more))).reshape(len(x), -1, PART).astype(np.float64)


def _nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.argmin((book * book).sum(1) - 2 * (x @ book.T), axis=1)


def fit_codebooks(sample: np.ndarray) -> np.ndarray:
    """(parts, CENTROIDS, PART): k-means for each part, begun with rows at even steps of the part's order."""
    books = []
    for x in _parts(sample).transpose(1, 0, 2):
        order = np.lexsort(x.T)
        book = x[order[np.linspace(0, len(x) - 1, CENTROIDS).astype(int)]]
        for _ in range(ROUNDS):
            near = _nearest(x, book)
            counts = np.bincount(near, minlength=CENTROIDS)
            sums = np.stack([np.bincount(near, weights=x[:, d], minlength=CENTROIDS) for d in range(PART)], axis=1)
            book = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], book)
        books.append(book)
    return np.stack(books)


def encode(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of each row and an upper bound of its residual's norm."""
    parts = _parts(x)
    codes = np.stack([_nearest(parts[:, m], books[m]) for m in range(len(books))], axis=1).astype(np.uint8)
    rest = parts - books[np.arange(len(books)), codes]
    norm = np.sqrt((rest * rest).sum((1, 2)))
    return codes, np.nextafter((norm * (1 + 1e-9)).astype(np.float32), np.float32(np.inf))


class _First:
    """The first ``n`` (score descending, id ascending) of each key, over all that was added."""

    def __init__(self, n: int, keys: int) -> None:
        self.n, self.keys = n, keys
        self.rows = np.zeros((0, 3), np.int64)
        self.floor = np.full(keys, -np.inf)

    def add(self, key: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        rows = np.concatenate([self.rows, np.stack([key, score, ident], axis=1)])
        rows = rows[np.lexsort((rows[:, 2], -rows[:, 1], rows[:, 0]))]
        begins = np.searchsorted(rows[:, 0], rows[:, 0])
        place = np.arange(len(rows)) - begins
        self.rows = rows[place < self.n]
        last = rows[place == self.n - 1]
        self.floor[last[:, 0]] = last[:, 1]


def _lookup(anchors: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tables (parts, CENTROIDS, anchors), and for each anchor a bound of its norm and of what rounding can add."""
    tables = np.einsum("amd,mcd->mca", _parts(anchors), books)
    norm = np.sqrt((anchors.astype(np.float64) ** 2).sum(1)) * (1 + 1e-9)
    slack = np.abs(tables).max(axis=1).sum(axis=0) * (len(books) + 8) * 2.0**-23 + 1e-3
    return tables.astype(np.float32), np.nextafter(norm.astype(np.float32), np.float32(np.inf)), slack.astype(np.float32) * np.float32(1.01)


def _exact(a: np.ndarray, x: np.ndarray, ai: np.ndarray, ri: np.ndarray) -> np.ndarray:
    """Integer inner products of the pairs (ai, ri)."""
    cut = range(0, len(ai), EXACT)
    return np.concatenate([np.zeros(0, np.int64), *(np.einsum("ij,ij->i", a[ai[i : i + EXACT]], x[ri[i : i + EXACT]]) for i in cut)])


def _scan(books: np.ndarray, anchors: dict[str, np.ndarray], windows: np.ndarray | None, n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What a task does with its row blocks: the first ``n`` of the same label for each anchor, or of other labels in each window.

    ``windows`` are (anchors, windows an anchor, lowest and highest score); an empty window has its lowest over its highest.
    """
    a_ids, a_labels, a_vectors = anchors["ids"], anchors["labels"], anchors["vectors"]
    each = 1 if windows is None else windows.shape[1]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = _First(n, len(a_ids) * each)
        for batch in batches:
            for block in batch.to_pylist():
                ids, labels = np.frombuffer(block["ids"], np.int64), np.frombuffer(block["labels"], np.int64)
                x = np.frombuffer(block["vectors"], np.int64).reshape(len(ids), -1)
                codes, rest = np.frombuffer(block["codes"], np.uint8).reshape(len(ids), -1), np.frombuffer(block["residuals"], np.float32)
                for at in range(0, len(a_ids), TABLES):
                    own = slice(at, at + TABLES)
                    tables, norm, slack = _lookup(a_vectors[own], books)
                    score = np.zeros((len(ids), tables.shape[2]), np.float32)
                    for m in range(len(books)):
                        score += tables[m][codes[:, m]]
                    far = rest[:, None] * norm[None, :] * np.float32(1.000001) + slack
                    low, high = score - far, score + far
                    same = labels[:, None] == a_labels[None, own]
                    if windows is None:
                        found = [(0, same & (ids[:, None] != a_ids[None, own]) & (high >= first.floor[own]))]
                    else:
                        lo, hi = windows[own, :, 0], windows[own, :, 1]
                        floor = np.maximum(first.floor.reshape(-1, each)[own], lo)
                        found = [(k, ~same & (low <= hi[:, k]) & (high >= floor[:, k])) for k in range(each) if (lo[:, k] <= hi[:, k]).any()]
                    for k, mask in found:
                        ri, ai = np.nonzero(mask)
                        ai += at
                        exact = _exact(a_vectors, x, ai, ri)
                        if windows is not None:
                            fits = (exact >= windows[ai, k, 0]) & (exact <= windows[ai, k, 1])
                            ai, ri, exact = ai[fits], ri[fits], exact[fits]
                        first.add(ai * each + k, exact, ids[ri])
        key, score, ident = first.rows.T
        yield pa.RecordBatch.from_arrays([pa.array(a_ids[key // each]), pa.array((key % each).astype(np.int32)), pa.array(ident), pa.array(score)], names=["anchor", "slot", "id", "score"])

    return task


def _packed(df: DataFrame, schema: str, size: int, pack: Callable[[int, np.ndarray, np.ndarray, np.ndarray], list]) -> DataFrame:
    """(id, label, v) of each partition in packed rows of at most ``size`` vectors."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, done = [c.split()[0] for c in schema.split(", ")], 0
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                ids, labels = part["id"].to_numpy(), part["label"].to_numpy()
                v = part["v"].flatten().to_numpy().reshape(len(ids), -1)
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in pack(done, ids, labels, v)], names=names)
                done += 1

    return df.mapInArrow(task, schema)


def _ranked(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id"))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)


def mine_hard_negatives(
    rows: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
) -> DataFrame:
    """For the rows where ``anchor`` holds: anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank.

    A score is the integer inner product of two rows whose components x became floor(scale * x); higher ones come
    first, ties by smaller id. Positives of an anchor are its first ``n_positives`` other rows of the same label.
    Negatives of a positive are the first ``n_negatives`` rows of other labels with low * positive_score <=
    100 * negative_score <= high * positive_score; rank counts them from 1. All rows are searched.

    Rows take no part whose id, label, vector or any component is null, or a component not finite. Shorter vectors
    count as filled up with zeros. Of rows that repeat an id one counts, that of the smallest label and vector. Other
    columns are not read. An empty table, or one without anchors, gives an empty result. Scores must fit 64 bits;
    vectors for which that isn't certain raise ValueError.
    """
    spark = rows.sparkSession
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    used = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), x.alias("x"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    used = used.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull()).where(F.forall("x", finite))
    used = used.withColumn("v", F.transform("x", lambda c: F.floor(scale * c))).drop("x")
    if not used.groupBy("id").count().where("count > 1").isEmpty():
        used = used.withColumn("at", F.row_number().over(Window.partitionBy("id").orderBy("label", "v", "anchor"))).where("at = 1").drop("at")
    about = used.agg(F.count("*").alias("n"), F.count_if("anchor").alias("anchors"), F.max(F.size("v")).alias("dims"), F.max(F.array_max(F.transform("v", F.abs))).alias("most")).first()
    empty = spark.createDataFrame([], RESULT)
    if not about["anchors"]:
        return empty
    dims = max(1, about["dims"])
    if dims * (about["most"] or 0) ** 2 * max(100, high) >= 2**63:
        raise ValueError("scores of these vectors may pass 64 bits")
    padded = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("v")))
    used = used.withColumn("v", padded)

    sample = used.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()
    books = fit_codebooks(sample.flatten().to_numpy().reshape(len(sample), -1))

    def indexed(_: int, ids: np.ndarray, labels: np.ndarray, v: np.ndarray) -> list[bytes]:
        codes, rest = encode(v, books)
        return [ids.tobytes(), labels.tobytes(), v.tobytes(), codes.tobytes(), rest.tobytes()]

    parts = max(spark.sparkContext.defaultParallelism, math.ceil(about["n"] / (16 * BLOCK)))
    blocks = written(_packed(used.select("id", "label", "v").repartition(parts, "id"), _BLOCKS, BLOCK, indexed), "pq_blocks")
    chosen = used.where("anchor").select("id", "label", "v").repartition(math.ceil(about["anchors"] / ANCHORS), "id")

    def numbered(done: int, ids: np.ndarray, labels: np.ndarray, v: np.ndarray) -> list:
        from pyspark import TaskContext

        return [(TaskContext.get().partitionId() << 32) + done, ids.tobytes(), labels.tobytes(), v.tobytes()]

    anchors = written(_packed(chosen, _ANCHORS, ANCHORS, numbered), "pq_anchors")
    found, result = "anchor long, slot int, id long, score long", scratch_path(spark, "hard_negatives")
    for (block,) in sorted(anchors.select("block").collect()):
        row = anchors.where(F.col("block") == block).first()
        own = {k: np.frombuffer(row[k], np.int64) for k in ("ids", "labels")}
        own["vectors"] = np.frombuffer(row["vectors"], np.int64).reshape(len(own["ids"]), -1)
        near = _ranked(blocks.mapInArrow(_scan(books, own, None, n_positives), found), ["anchor"], n_positives)
        positives = near.select("anchor", "id", "score", "rank").toArrow().to_pandas()
        windows = np.zeros((len(own["ids"]), n_positives, 2), np.int64)
        windows[:, :, 0] = 1  # empty
        order = np.argsort(own["ids"])
        at = order[np.searchsorted(own["ids"][order], positives["anchor"].to_numpy())]
        score, slot = positives["score"].to_numpy(), positives["rank"].to_numpy() - 1
        windows[at, slot, 0], windows[at, slot, 1] = -(-low * score // 100), high * score // 100
        inside = _ranked(blocks.mapInArrow(_scan(books, own, windows, n_negatives), found), ["anchor", "slot"], n_negatives)
        opened = spark.createDataFrame(positives[["anchor", "id", "score", "rank"]], "anchor long, positive_id long, positive_score long, positive_rank int")
        out = inside.join(opened, (inside["anchor"] == opened["anchor"]) & (F.col("slot") == F.col("positive_rank") - 1))
        out = out.select(inside["anchor"].alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"), "positive_rank")
        out.write.mode("append").parquet(result)
    return spark.read.schema(RESULT).parquet(result)
