"""Small column helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = "\t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is evaluated once a row even where lambdas inside ``body`` use it often."""
    return F.transform(F.array(value), body).getItem(0)


def words(text: Column) -> Column:
    """The runs of ``[^\\x20\\x09-\\x0D]`` in a text, in order; null and blank texts have none."""
    spaced = F.coalesce(text, F.lit(""))
    for blank in BLANKS:  # cheaper than one translate, which looks up every character
        spaced = F.replace(spaced, F.lit(blank), F.lit(" "))
    return F.array_remove(F.split(spaced, " "), "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; on a local master one of our own where that is unset.

    What is written there stays until the folder is cleared; jobs give their files unique names.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        sc = spark.sparkContext
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = getattr(sc, "_pagewright_shared", None)
        if folder is None:
            folder = "file://" + tempfile.mkdtemp(prefix="pagewright-")
            sc._pagewright_shared = folder
            if sc.getCheckpointDir() is None:
                sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its lineage is cut and any executor can read it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
