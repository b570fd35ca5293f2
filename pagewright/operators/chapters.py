"""Chapters of books: from the outline, else from headings in the text, else in runs of 25 pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.text import html_preview, is_blank, is_chapter_heading, trim

from .books import ordered_text

BUCKET = 25


def outline_starts(pages: DataFrame, outline: DataFrame) -> DataFrame:
    """Chapter starts (book_id, page_index, title) from outline rows (book_id, source_order, title, page_index, level).

    One level of the outline is taken: the outermost with two pages or more in page order, else the outermost with
    two pages, else the outermost with a page in the book. Of items on one page the first counts.
    """
    span = pages.groupBy("book_id").agg(F.min("page_index").alias("lo"), F.max("page_index").alias("hi"))
    inside = outline.join(span, "book_id").where("page_index between lo and hi")
    back = F.lag("page_index").over(Window.partitionBy("book_id", "level").orderBy("source_order")) > F.col("page_index")
    levels = inside.withColumn("back", F.coalesce(back, F.lit(False))).groupBy("book_id", "level").agg(F.count_distinct("page_index").alias("n"), F.bool_or("back").alias("back"))
    rank = F.when((F.col("n") >= 2) & ~F.col("back"), 0).when(F.col("n") >= 2, 1).otherwise(2)
    chosen = levels.groupBy("book_id").agg(F.min_by("level", F.struct(rank, "level")).alias("level"))
    first = F.row_number().over(Window.partitionBy("book_id", "page_index").orderBy("source_order"))
    title = F.when(is_blank(F.col("title")), "Untitled").otherwise(trim(F.col("title")))
    return inside.join(chosen, ["book_id", "level"]).withColumn("_at", first).where("_at = 1").select("book_id", "page_index", title.alias("title"))


def heading_starts(pages: DataFrame) -> DataFrame:
    """Chapter starts from the first chapter heading among the first four lines of each page."""
    found = F.get(F.filter(F.slice(F.split("text", r"\r\n|[\n-\r\x{85}\x{2028}\x{2029}]"), 1, 4), is_chapter_heading), 0)
    return pages.select("book_id", "page_index", trim(found).alias("title")).where("title is not null")


def bucket_starts(pages: DataFrame) -> DataFrame:
    """A start at every 25th page of a book, by place and not by number; titles come later."""
    at = F.row_number().over(Window.partitionBy("book_id").orderBy("page_index")) - 1
    return pages.select("book_id", "page_index", at.alias("_at")).where(F.col("_at") % BUCKET == 0).select("book_id", "page_index", F.lit(None).cast("string").alias("title"))


def with_start(pages: DataFrame, starts: DataFrame, *carry: str) -> DataFrame:
    """``pages`` with the columns ``carry`` of the last of ``starts`` (book_id, page_index, one row a page) at or before each; pages before the first go.

    Both lie in one window over the book, so that no range join is needed and a start may name a page that isn't there.
    """
    mark = F.struct(*carry)
    rows = pages.withColumn("_start", F.lit(None).cast(starts.select(mark.alias("x")).schema["x"].dataType)).unionByName(starts.select("book_id", "page_index", mark.alias("_start")), allowMissingColumns=True)
    book = Window.partitionBy("book_id").orderBy("page_index", F.col("_start").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_last": F.last("_start", ignorenulls=True).over(book), "_page": F.col("_start").isNull()})
    return rows.where("_page and _last is not null").select(*pages.columns, "_last.*")


def ranges(starts: DataFrame, span: DataFrame) -> DataFrame:
    """book_id, page_lo, page_hi and what starts have, for the pages between starts; what stands before the first is Front Matter."""
    front = starts.groupBy("book_id").agg(F.min("page_index").alias("first"), F.any_value("kind").alias("kind")).join(span, "book_id").where("first > lo")
    front = front.select("book_id", F.col("lo").alias("page_index"), F.lit("Front Matter").alias("title"), "kind")
    book = Window.partitionBy("book_id").orderBy("page_index")
    ends = starts.select("book_id", "page_index", "title", "kind").unionByName(front).join(span.select("book_id", "hi"), "book_id")
    return ends.select("book_id", "title", "kind", F.col("page_index").alias("page_lo"), F.coalesce(F.lead("page_index").over(book) - 1, F.col("hi")).alias("page_hi"))


def build_chapters(pages: DataFrame, outline: DataFrame | None = None, html: bool = False) -> DataFrame:
    """Chapters of every book: book_id, chapter_order, title, page_lo, page_hi, plain_text, confidence, is_ocr_sourced.

    ``pages``: book_id, page_index, text, extraction_source, confidence; one row a page. A book whose outline has no
    page in it falls back on headings, then on runs of 25 pages named Beginning, Section 2, ...; chapters without text
    go, and a book without any text is a single empty chapter, Full Text. ``html`` adds html_preview.
    Which of the three it is, is decided on the starts, a few short rows a book, so that texts are assembled once.
    """
    whole = F.struct(F.avg("confidence").alias("confidence"), F.bool_or(F.col("extraction_source") == "ocr").alias("is_ocr_sourced"))
    span = pages.groupBy("book_id").agg(F.min("page_index").alias("lo"), F.max("page_index").alias("hi"), F.bool_or(~is_blank(F.col("text"))).alias("has_text"), whole.alias("whole"))
    kinds = [heading_starts(pages), bucket_starts(pages)]
    if outline is not None:
        kinds.insert(0, outline_starts(pages, outline))
    last = len(kinds) - 1
    starts = reduce(DataFrame.unionByName, [k.withColumn("kind", F.lit(i)) for i, k in enumerate(kinds)])
    starts = starts.withColumn("_best", F.min("kind").over(Window.partitionBy("book_id"))).where("kind = _best").drop("_best")
    starts = starts.join(span.where("has_text").select("book_id"), "book_id", "left_semi")

    found = ranges(starts, span)
    member = with_start(pages.select("book_id", "page_index", "text", "confidence", "extraction_source"), found.withColumn("page_index", F.col("page_lo")), "page_lo", "page_hi", "title", "kind")
    text = ordered_text(F.col("text"), F.col("page_index"))
    out = member.groupBy("book_id", "page_lo", "page_hi", "title", "kind").agg(text.alias("plain_text"), F.avg("confidence").alias("confidence"), F.bool_or(F.col("extraction_source") == "ocr").alias("is_ocr_sourced"))
    out = out.where("plain_text != ''").withColumn("chapter_order", F.row_number().over(Window.partitionBy("book_id").orderBy("page_lo")) - 1)
    section = F.when(F.col("chapter_order") == 0, "Beginning").otherwise(F.concat(F.lit("Section "), F.col("chapter_order") + 1))
    out = out.withColumn("title", F.when(F.col("kind") == last, section).otherwise(F.col("title")))
    blank = span.where("not has_text").select("book_id", F.col("lo").alias("page_lo"), F.col("hi").alias("page_hi"), F.lit("Full Text").alias("title"), F.lit("").alias("plain_text"), F.lit(0).alias("chapter_order"), "whole.*")
    columns = ["book_id", "chapter_order", "title", "page_lo", "page_hi", "plain_text", "confidence", "is_ocr_sourced"]
    out = out.select(*columns).unionByName(blank.select(*columns))
    return out.withColumn("html_preview", html_preview(F.col("plain_text"), F.col("title"))) if html else out
