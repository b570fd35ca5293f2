"""A training-data pipeline over ``documents``: STAGES in order, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's docs. All but the last return the columns of ``documents``; n_chars follows the text where that changes.
Columns of ``documents`` beside doc_id and text may be missing, null or of other types; extra columns pass through.
An empty table goes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import bt_quality
from pagewright.llm.common import written
from pagewright.llm.line_dedup import dedup_lines
from pagewright.llm.near_dedup import near_duplicates
from pagewright.llm.packing import pack_documents
from pagewright.llm.quality_rules import apply_rules


def _free(docs: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the threshold table keeps. Null and very short texts go."""
    out = _free(docs, "verdict")
    return apply_rules(docs, out_col=out).where(F.col(out)["kept"]).drop(out)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts as good; it is fitted on labelled rows of all documents, not only of ``docs``.

    Labels of held-out rows are not used, here either.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = bt_quality.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels)
    out = _free(docs, "verdict")
    return bt_quality.score_documents(docs, model, out_col=out).where(F.col(out)["predicted"] == 1).drop(out)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the later copies of repeated runs; a document of which nothing is left goes."""
    name = _free(docs, "verdict")
    out = dedup_lines(docs, out_col=name)
    out = out.where((F.size(F.col(name)["runs"]) == 0) | F.expr("length(btrim(text, ' \\t\\n\\r')) > 0")).drop(name)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates (shingles of five words, 0.8); rows without an id stay.

    At five words each edited word breaks five shingles, so that only copies with few edits for their length are linked.
    """
    name = _free(docs, "gone")
    gone = near_duplicates(docs).where("not kept").select(F.col("doc_id").alias(name))
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 ids: doc_id, start, length, ids, doc_tokens, sequence_id, offset."""
    return pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("packing", packing),
]
#: SQL can't express the classifier, the packing and the near duplicates; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
