"""Books as a whole: attributes, outlines, page tables, statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.text import is_blank, trim, word_count
from pagewright.sources.staging import staged


def metadata(attributes: DataFrame) -> DataFrame:
    """title, authors and keywords of raw attributes: title, else the file's stem, else Untitled; lists cut at commas.

    Items of lists are trimmed and kept when empty; a null attribute is an empty list.
    """
    stem = F.regexp_replace(F.regexp_extract(F.coalesce("path", F.lit("")), r"([^/]*)$", 1), r"\.[^.]*$", "")
    named = lambda c: F.when(~is_blank(c), trim(c))
    items = lambda c: F.when(F.col(c).isNull(), F.array().cast("array<string>")).otherwise(F.transform(F.split(F.col(c), ","), trim))
    return attributes.withColumns({"title": F.coalesce(named(F.col("title")), named(stem), F.lit("Untitled")), "authors": items("author"), "keywords": items("keywords")})


def author_line(authors: Column, creator: Column) -> Column:
    return F.when(F.size(authors) > 0, F.array_join(authors, ", ")).otherwise(F.coalesce(creator, F.lit("Unknown")))


def latest_pages(pages: DataFrame, order: str) -> DataFrame:
    """One row a page: of rows that repeat a page, the last by ``order``."""
    rest = [c for c in pages.columns if c not in ("book_id", "page_index")]
    return pages.groupBy("book_id", "page_index").agg(F.max_by(F.struct(*rest), order).alias("r")).select("book_id", "page_index", *[f"r.{c}" for c in rest])


def ordered_text(text: Column, order: Column, separator: str = "\n\n") -> Column:
    """Aggregate: the texts of a group that aren't blank, in order. A group is a book or a chapter, which fits in a row."""
    kept = F.array_sort(F.collect_list(F.when(~is_blank(text), F.struct(order.alias("o"), text.alias("t")))))
    return F.array_join(F.transform(kept, lambda x: x["t"]), separator)


def plain_text(pages: DataFrame, separator: str = "\n\n", chapters: DataFrame | None = None) -> DataFrame:
    """book_id, text: a book's pages that aren't blank, in order; of a book without pages, its ``chapters`` (chapter_order, plain_text)."""
    by_page = _pages_text(pages, separator)
    if chapters is None:
        return by_page
    rest = chapters.join(by_page, "book_id", "left_anti").groupBy("book_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chapter_order", F.coalesce("plain_text", F.lit("")).alias("t")))), lambda x: x["t"]), separator).alias("text"))
    return by_page.unionByName(rest)


def _pages_text(pages: DataFrame, separator: str) -> DataFrame:
    return pages.groupBy("book_id").agg(ordered_text(F.col("text"), F.col("page_index"), separator).alias("text"))


def statistics(pages: DataFrame) -> DataFrame:
    """By book: words, minutes to read (220 words a minute, at least 1 if there is a word), pages of each kind."""
    n = F.sum(word_count(F.col("text"))).cast("long")
    return pages.groupBy("book_id").agg(
        F.count("*").alias("n_pages"), n.alias("total_words"), F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 220))).cast("long").alias("reading_minutes"),
        F.count_if(F.col("extraction_source") == "ocr").alias("ocr_pages"), F.count_if(F.col("extraction_source") == "empty").alias("empty_pages"),
    )


def flatten_outline(items: DataFrame, n_pages: DataFrame | None = None) -> DataFrame:
    """Outline rows (book_id, id, parent_id, position, title, page_index) with level, path id and pre-order source_order.

    Roots have a null parent. A level is one join, and levels are walked until one is empty, however deep an outline is;
    each is written to the shared folder. Blank titles become Untitled; pages outside the book (``n_pages``: book_id,
    n_pages) become null. Items in a cycle are not reachable and go.
    """
    items = staged(items.select("book_id", "id", "parent_id", F.col("position").cast("int").alias("position"), "title", "page_index"), "outline")
    walk = items.where("parent_id is null").select("book_id", "id", F.lit(0).alias("level"), F.concat(F.lit("outline:"), "position").alias("path"), F.array("position").alias("sort_key"))
    levels = [staged(walk, "level")]
    children = items.where("parent_id is not null").select("book_id", F.col("id").alias("child"), F.col("parent_id").alias("id"), "position")
    while not levels[-1].isEmpty():
        below = levels[-1].join(children, ["book_id", "id"])
        below = below.select("book_id", F.col("child").alias("id"), (F.col("level") + 1).alias("level"), F.concat("path", F.lit("/"), "position").alias("path"), F.array_append("sort_key", F.col("position")).alias("sort_key"))
        levels.append(staged(below, "level"))
    walked = reduce(DataFrame.union, levels)
    walked = walked.withColumn("source_order", F.row_number().over(Window.partitionBy("book_id").orderBy("sort_key")) - 1).drop("sort_key")
    title = F.when(is_blank(F.col("title")), "Untitled").otherwise(trim(F.col("title")))
    out = walked.join(items.select("book_id", "id", "parent_id", title.alias("title"), "page_index"), ["book_id", "id"])
    if n_pages is None:
        return out
    inside = F.when((F.col("page_index") >= 0) & (F.col("page_index") < F.col("_n")), F.col("page_index"))
    return out.join(n_pages.select("book_id", F.col("n_pages").alias("_n")), "book_id", "left").withColumn("page_index", inside).drop("_n")
