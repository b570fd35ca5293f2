"""Quality classifier: Bradley-Terry ranking learnt from preference pairs.

A pair is a labelled good document and a labelled bad one; the good one should win. The chance that it wins is the
logistic function of the difference of the two scores, scores are linear in features of a text, and so the weights
are a logistic regression without intercept on feature differences. The threshold is the quantile of the training
scores below which the share of bad labels lies; scores are mapped to 0 to 1 so that it falls on a given value.

Features are built-in Spark expressions over whole texts. Only a bounded sample of labelled rows goes to the driver,
as a few numbers a row; all documents are scored in one projection.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, words
from .quality_rules import rule_metrics

#: Labelled rows that the model is fitted on at most, chosen by the smallest hashes of their ids.
MOST_LABELLED = 16_000
#: Preference pairs drawn for each fitted model, at most.
MOST_PAIRS = 200_000
#: Score of a text at the threshold.
AT_THRESHOLD = 0.3
FEATURES = ("symbols", "stop_words", "dup_lines", "repeated", "word_length", "upper", "bangs", "digits", "distinct", "length", "sentences", "few_stops")


def features(text: Column) -> Column:
    """The features of a text, an array of doubles in the order of FEATURES; a null or blank text has those of nothing."""
    t = F.coalesce(text, F.lit(""))
    counts = F.struct(
        rule_metrics(t).alias("m"),
        let(words(F.lower(t)), lambda w: F.size(F.array_distinct(w))).alias("distinct"),
        F.regexp_count(t, F.lit(r"\p{Lu}")).alias("upper"),
        F.regexp_count(t, F.lit(r"[0-9]")).alias("digits"),
        (F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit("")))).alias("bangs"),
        F.regexp_count(t, F.lit(r"[.?!](?:\s|$)")).alias("ends"),
    )

    def vector(c: Column) -> Column:
        m = c["m"]
        n = F.greatest(m["w"]["n_words"], F.lit(1)).cast("double")
        chars = F.greatest(m["word_chars"], F.lit(1)).cast("double")
        share = lambda x, total: F.log1p(20 * x / total)  # noqa: E731  a small share counts, a large one doesn't drown the rest
        stops = m["n_stop_words"] / n
        return F.array(
            share(m["n_symbols"], n), stops, share(m["l"]["n_dup_lines"], F.greatest(m["l"]["n_lines"], F.lit(1))), share(m["w"]["n_repeat_words"], n),
            F.log1p(m["word_chars"] / n), share(c["upper"], chars), share(c["bangs"], n), share(c["digits"], chars),
            F.log1p(c["distinct"]) / F.log1p(n), F.log1p(n), share(c["ends"], n), F.when(n >= 20, F.greatest(F.lit(0.0), 0.15 - stops)).otherwise(F.lit(0.0)),
        )

    return let(counts, vector)


@dataclass(frozen=True)
class Model:
    weights: tuple[float, ...]
    threshold: float  # of raw scores
    scale: float

    def raw(self, x: Column) -> Column:
        return sum((F.get(x, i) * w for i, w in enumerate(self.weights)), F.lit(0.0))

    def score(self, x: Column) -> Column:
        """From 0 to 1; AT_THRESHOLD at the threshold."""
        z = (self.raw(x) - self.threshold) * self.scale + math.log(AT_THRESHOLD / (1 - AT_THRESHOLD))
        return 1 / (1 + F.exp(-z))


def held_out(id_col: Column, folds: int = 5) -> Column:
    """Whether a row's label is kept from the fit: crc32 of its id as text is a multiple of ``folds``."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit_pairs(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 25) -> Model:
    """Bradley-Terry weights from rows of features and 0/1 labels, by Newton's method on the logistic loss of pairs.

    Each bad row meets several good ones, and each good row at least one bad one, as far as MOST_PAIRS goes. With one
    kind of label only there is nothing to prefer: all weights are 0 and every score is AT_THRESHOLD.
    """
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Model((0.0,) * x.shape[1], 0.0, 1.0)
    rng = np.random.default_rng(0)
    n = min(MOST_PAIRS, 40 * max(len(good), len(bad)))
    mean, std = x.mean(0), x.std(0) + 1e-9
    z = (x - mean) / std
    d = z[rng.choice(good, n)] - z[rng.choice(bad, n)]
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # chance of the wrong order
        gradient = -(d * p[:, None]).mean(0) + l2 * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / n + l2 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    raw = z @ w
    low, high = np.median(raw[bad]), np.median(raw[good])
    # the quantile at the share of bad labels, halfway to the next score above it
    order = np.sort(raw)
    k = min(len(bad), len(order) - 1)
    threshold = (order[k - 1] + order[k]) / 2
    scale = 4 / max(high - low, 1e-6)
    weights = w / std
    return Model(tuple(map(float, weights)), float(threshold + (w / std) @ mean), float(scale))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MOST_LABELLED) -> Model:
    """A model from the labelled rows that aren't held out: at most ``most`` of them, those with the smallest hashes of ids.

    Labels other than 0 and 1 and null ids are left out; of labels that repeat an id the smallest counts.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1))
    known = known.where(~held_out(F.col("id"))).groupBy("id").agg(F.min("y").alias("y"))
    sample = known.orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(most)  # bounded: at most ``most`` rows
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "id")
    got = rows.select("id", "y", features(F.col("text")).alias("x")).collect()
    got.sort(key=lambda r: (str(r["id"]), r["x"]))
    x = np.array([r["x"] for r in got], np.float64).reshape(len(got), len(FEATURES))
    return fit_pairs(x, np.array([r["y"] for r in got], np.int64))


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", out_col: str = "quality_score") -> DataFrame:
    """``docs`` with one more struct column: score (0 to 1) and predicted (1 if the score is AT_THRESHOLD or more).

    All rows and columns stay; a column that is already named ``out_col`` is replaced. Null texts score as empty ones.
    """
    score = let(features(F.col(text_col)), model.score)
    return docs.withColumn(out_col, let(score, lambda s: F.struct(s.alias("score"), (s >= AT_THRESHOLD).cast("int").alias("predicted"))))
