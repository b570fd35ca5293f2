"""Text of any script, functions for SQL, and files as rows, those that can't be read among them."""

from __future__ import annotations

import unicodedata

import pytest
from pyspark.sql import functions as F

from pagewright.config import ChunkConfig
from pagewright.functions import session
from pagewright.functions import text as t
from pagewright.functions.chunks import chunk_text, sentences
from pagewright.functions.ids import stable_id
from pagewright.operators import books
from pagewright.sources import files

ODD = ["Café  ÉTÉ", "été", "Ελλάδα ΟΔΌΣ", "Ёлка й", "がぎ パ", "हिन्दी", "Việt Nam", "שָׁלוֹם", "مُحَمَّد", "Ångström Å", "한국어", "", " \t", "plain ascii", "ﬁ ligature", "𝒳 🎉"]


def test_folding_in_any_script(spark):
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(ODD)], "i int, x string").orderBy("i").select(t.fold(F.col("x"))).collect()]
    assert got == ["".join(c for c in unicodedata.normalize("NFD", x.lower()) if unicodedata.category(c) != "Mn") for x in ODD]


def test_composed_and_decomposed_texts_are_alike(spark):
    rows = [(unicodedata.normalize("NFC", x), unicodedata.normalize("NFD", x)) for x in ("Café déjà", "한국어 글", "Việt đẹp", "がぎぐ")] + [("é" * 513, "é" * 513), ("é" * 513, "é" * 512 + "x"), ("é" * 512, "é" * 511 + "x")]
    got = [r[0] for r in spark.createDataFrame(rows, "a string, b string").coalesce(1).select(t.similarity(F.col("a"), F.col("b"))).collect()]
    assert got[:5] == [1.0] * 5 and got[5] == 0.0 and got[6] == pytest.approx(511 / 512)


def test_functions_for_sql(spark):
    assert session.register(spark) == ["pw_chunks", "pw_sentences", "pw_signature", "pw_stable_id"]
    said = "One sentence here. Another one follows it. " * 20 + "The last one."
    spark.createDataFrame([(1, said), (2, ""), (3, None)], "id int, body string").createOrReplaceTempView("pw_bodies")
    got = spark.sql("SELECT id, chunk_index, chunk FROM pw_bodies, LATERAL pw_chunks(body, 100, 30) ORDER BY id, chunk_index").collect()
    assert [tuple(r) for r in got] == [(1, i, c) for i, c in enumerate(chunk_text(said, ChunkConfig(100, 30)))]
    assert [r[0] for r in spark.sql("SELECT pw_sentences(body) FROM pw_bodies WHERE id = 1").collect()] == [sentences(said)]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(ODD)], "i int, x string")
    rows.createOrReplaceTempView("pw_lines")
    both = rows.select(F.expr("pw_signature(x)").alias("a"), t.signature(F.col("x")).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in both)
    ids = rows.select(F.expr("pw_stable_id('page', array(cast(i as string), x))").alias("a"), stable_id("page", F.col("i"), F.col("x")).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in ids) and len({r["a"] for r in ids}) == len(ODD)


def picky(content: bytes) -> list[str]:
    if content.startswith(b"LOCKED"):
        raise files.Locked
    return files.plain_text(content)


def test_files_as_rows(spark, tmp_path):
    for name, content in {"a.txt": "One.\fTwo é.".encode(), "b.txt": b"\xff\xfe broken", "c.txt": b"LOCKED", "d.txt": b""}.items():
        (tmp_path / name).write_bytes(content)
    want = {("a", 0, "One.", None), ("a", 1, "Two é.", None), ("b", None, None, "invalid_file"), ("c", None, None, "password_protected"), ("d", 0, "", None)}
    rows = lambda df: {tuple(r) for r in df.select("book_id", "page_index", "native_text", "code").collect()}
    spark.dataSource.register(files.DecodedFiles)
    read = spark.read.format("pagewright_files").option("decoder", f"{picky.__module__}:picky").option("bytesPerPartition", 1)
    df = read.load(str(tmp_path))
    assert rows(df) == want and df.rdd.getNumPartitions() >= 3  # the groups are small
    assert rows(read.load(f"{tmp_path}/[ab].txt")) == {r for r in want if r[0] in "ab"}
    assert rows(read.load(f"{tmp_path}/none.txt")) == {("none", None, None, "file_not_found")}
    assert rows(files.decoded_pages(spark, str(tmp_path), picky)) == {r for r in want if r[0] != "d"}
    held = spark.createDataFrame([("x/e.txt", bytearray(b"Here.")), ("x/f.txt", None)], "path string, content binary")
    assert rows(files.decoded_contents(held)) == {("e", 0, "Here.", None), ("f", None, None, "file_not_found")}


def test_text_of_books_falls_back_on_chapters(spark):
    pages = spark.createDataFrame([(0, 1, "B"), (0, 0, "A"), (0, 2, " ")], "book_id int, page_index int, text string")
    parts = spark.createDataFrame([(0, 0, "no"), (1, 1, "Two"), (1, 0, "One")], "book_id int, chapter_order int, plain_text string")
    assert {tuple(r) for r in books.plain_text(pages, "|", parts).collect()} == {(0, "A|B"), (1, "One|Two")}
    assert {tuple(r) for r in books.plain_text(pages).collect()} == {(0, "A\n\nB")}
