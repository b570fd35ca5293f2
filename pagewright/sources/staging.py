"""Tables between the stages of a job: written once, read by all that follow, by whatever executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the folder that driver and executors share, so that it is computed once and survives lost executors.

    The folder is spark.checkpoint.dir; on a local master, as in tests, a temporary one of our own where that is unset.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = getattr(spark.sparkContext, "_pagewright_staging", None) or "file://" + tempfile.mkdtemp(prefix="pagewright-")
        spark.sparkContext._pagewright_staging = folder
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
