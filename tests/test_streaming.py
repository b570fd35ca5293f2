"""Streams of pages from files, batch by batch."""

from __future__ import annotations

import pytest

from pagewright.streaming.pages import clean_stream, completed_books

SCHEMA = "book_id long, page_index int, page_count int, native_text string"


def through(spark, df, name, tmp_path):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    ended = query.awaitTermination(60)
    query.stop()
    assert ended
    return spark.table(name).collect()


@pytest.fixture
def settings(spark):
    """Few state partitions, and no batches without data, which a processing-time timeout asks for without end."""
    own = {"spark.sql.shuffle.partitions": "2", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_streams(spark, tmp_path, settings):
    path = str(tmp_path / "in")
    batches = [[(1, 0, 2, "a\r\nb"), (2, 0, 3, None)], [(1, 0, 2, "again"), (3, 0, 1, "x  y"), (2, None, None, "")], [(1, 1, 2, "end"), (2, 1, 3, "z")]]
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    assert sorted(map(tuple, through(spark, completed_books(stream), "done", tmp_path))) == [(1, 2, True), (3, 1, True)]
    assert sorted(r["text"] for r in through(spark, clean_stream(stream).select("text"), "clean", tmp_path)) == sorted(["a\nb", "", "again", "x y", "", "end", "z"])
