"""Books: chunks and segments, outlines, cleaning with layout fingerprints, hyphens, settings."""

from __future__ import annotations

import random

import pytest
import regex
from pyspark.sql import functions as F

from pagewright.config import ChunkConfig, OcrConfig
from pagewright.functions import chunks
from pagewright.functions import text as t
from pagewright.operators import books, chapters, cleanup, layout, policy, segments

PAGE_SCHEMA = "book_id int, page_index int, text string, extraction_source string, confidence double"


def test_languages_keep_their_order():
    assert OcrConfig(languages=("en", "fr", "EN", " ", "de", "Fr")).languages == ("en", "fr", "de")


def test_chunks_fit_and_lose_nothing():
    rng = random.Random(1)
    for _ in range(300):
        text = " ".join("".join(rng.choice("ab́ë漢。.!🇫🇷‍,") for _ in range(rng.randrange(1, 9))) for _ in range(40))
        for most in (7, 30, 200):
            got = chunks.chunk_text(text, ChunkConfig(most, most // 3))
            assert all(len(regex.findall(r"\X", c)) <= most for c in got)
            assert "".join("".join(got).split()) == "".join(text.split())


@pytest.mark.parametrize(("text", "want"), [
    ("Dr. Who came. He left, e.g. J. did! So?", ["Dr. Who came.", "He left, e.g. J. did!", "So?"]),
    ("一。二！三", ["一。", "二！", "三"]),
    ("no end", ["no end"]),
])
def test_sentences(text, want):
    assert chunks.sentences(text) == want


def packed_by_hand(pages, most, across):
    """The segments of one chapter: (text, lo, hi, confidence)."""
    out = []
    for i, text, confidence in pages:
        for piece in chunks.chunk_text(text, ChunkConfig(most)):
            if out and (out[-1][2] == i and out[-1][1] == i or across and i <= out[-1][2] + 1):
                a = out[-1]
                joined = a[0] + " " + piece
                if len(joined) <= most:
                    n, m = max(1, len(a[0])), max(1, len(piece))
                    out[-1] = (joined, a[1], i, (a[3] * n + confidence * m) / (n + m))
                    continue
            out.append((piece, i, i, confidence))
    return out


@pytest.mark.parametrize("across", [True, False])
def test_segments_match_brute_force(spark, across):
    rng = random.Random(2)
    pages = {b: [(i, " ".join(rng.choice(["One two three.", "A longer sentence than that one is.", "Yes!"]) for _ in range(rng.randrange(0, 9))), rng.choice([0.5, 1.0])) for i in range(7) if i != 3] for b in range(6)}
    rows = [(b, i, x, "native", c) for b, own in pages.items() for i, x, c in own]
    df = spark.createDataFrame(rows, PAGE_SCHEMA)
    got = {}
    for r in segments.build_segments(df, chapters.build_chapters(df), ChunkConfig(60), across).orderBy("book_id", "seg_order").collect():
        got.setdefault(r["book_id"], []).append((r["text"], r["page_lo"], r["page_hi"], pytest.approx(r["confidence"])))
    assert got == {b: w for b, own in pages.items() if (w := packed_by_hand(own, 60, across))}


def test_a_start_may_name_a_missing_page(spark):
    rows = [(0, i, f"text {i}", "native", 1.0) for i in (0, 1, 4, 5)]
    outline = spark.createDataFrame([(0, 0, "First", 0, 0), (0, 1, "Second", 3, 0)], "book_id int, source_order int, title string, page_index int, level int")
    got = [(r["title"], r["page_lo"], r["page_hi"], r["plain_text"]) for r in chapters.build_chapters(spark.createDataFrame(rows, PAGE_SCHEMA), outline).orderBy("chapter_order").collect()]
    assert got == [("First", 0, 2, "text 0\n\ntext 1"), ("Second", 3, 5, "text 4\n\ntext 5")]


def test_outlines_of_any_depth(spark):
    rows = [(0, f"i{k}", f"i{k - 1}" if k else None, 0, f"T{k}", k) for k in range(12)] + [(0, "x", "y", 0, "cycle", 1), (0, "y", "x", 0, "cycle", 1)]
    items = spark.createDataFrame(rows, "book_id int, id string, parent_id string, position int, title string, page_index int")
    got = books.flatten_outline(items, spark.createDataFrame([(0, 6)], "book_id int, n_pages int")).orderBy("source_order").collect()
    assert [(r["id"], r["level"], r["page_index"]) for r in got] == [(f"i{k}", k, k if k < 6 else None) for k in range(12)]


def test_scanned_books_go_by_position(spark):
    rows = [(0, i, "x" if k % 2 == 0 else "a long enough text to be no scanned page at all") for k, i in enumerate((10, 20, 30, 40, 50, 60, 70, 80, 90, 100))]
    assert policy.scanned_books(spark.createDataFrame(rows, "book_id int, page_index int, native_text string")).first()["is_scanned"]


def test_cleaning_with_fingerprints(spark):
    """A header goes by its place and signature; one that is a sure heading stays on its first page; text that merely repeats lower down stays."""
    pages = [(0, i, f"The Running Title\nbody of page {i}\nCommon words here\nmore of {i}\nand {i} more\nlast of {i}", "native", 1.0) for i in range(6)]
    prints = [(0, i, 0, ["the running title"], (0.1, 0.05 + 0.001 * i, 0.5, 0.02), "heading" if i == 2 else "body", 0.9) for i in range(6)]
    df = spark.createDataFrame(pages, PAGE_SCHEMA)
    fp = spark.createDataFrame(prints, "book_id int, page_index int, block_id int, line_signatures array<string>, rect struct<x:double,y:double,w:double,h:double>, role string, role_confidence double")
    got = {r["page_index"]: r["text"] for r in cleanup.clean_books(df, fingerprints=fp).collect()}
    assert [i for i, x in got.items() if "Running" in x] == [2]
    assert all(f"body of page {i}" in x and "Common words here" in x for i, x in got.items())
    scattered = fp.withColumn("rect", F.struct(F.col("rect.x"), (F.col("page_index") * 0.05).alias("y"), F.col("rect.w"), F.col("rect.h")))
    kept = {r["page_index"]: r["text"] for r in cleanup.clean_books(df, fingerprints=scattered).collect()}
    assert all("Running" in x for x in kept.values())  # no band of heights has enough pages


@pytest.mark.parametrize(("text", "want"), [
    ("exam-\nple here", "example here"), ("well-\nknown", "well-known"), ("re-\nof it", "re-of it"), ("- item-\nnext", "- item-\nnext"), ("LOUD-\nword", "LOUD-\nword"), ("a com-\nbi-\nnation", "a com-bination"), ("Capi-\nTal", "Capi-\nTal"),
])
def test_hyphens_at_line_ends(spark, text, want):
    assert spark.range(1).select(t.clean_page(F.lit(text)).alias("x")).first()["x"] == want


def test_inventories(spark):
    same = lambda a, b: spark.range(1).select((layout.inventory(F.lit(a)) == layout.inventory(F.lit(b))).alias("x")).first()["x"]
    assert same("ab, c1", "1. c ab") and not same("aab", "ab") and same("", " .")
