"""Running headers and footers and page numbers of books, found by recurrence over pages and taken out.

Only the first and last lines of pages are looked at, so that what is shuffled is a few short rows a page. All
windows and groups are within one book.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.config import CleanupConfig
from pagewright.functions.text import finalize_whitespace, is_blank, is_short_edge_text, page_number, signature, trim
from pagewright.sources.staging import staged

KEY = ["book_id", "page_index"]


def page_lines(pages: DataFrame) -> DataFrame:
    """A row for each line of each page: book_id, page_index, line_index, line."""
    return pages.select(*KEY, F.posexplode(F.split("text", "\n")).alias("line_index", "line"))


def edge_candidates(pages: DataFrame) -> DataFrame:
    """The first two and last two lines that aren't blank of each page, if short: side, text, normalized, and number (struct or null)."""
    numbered = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("line_index"), x.alias("line"))), lambda x: ~is_blank(x["line"]))
    some = pages.select(*KEY, numbered.alias("l")).where(F.size("l") > 0)
    edge = lambda side, part: F.transform(part, lambda x: F.struct(F.lit(side).alias("side"), x["line_index"].alias("line_index"), x["line"].alias("line")))
    sides = F.concat(edge("top", F.slice("l", 1, 2)), edge("bottom", F.slice("l", F.greatest(F.lit(1), F.size("l") - 1), F.lit(2))))
    rows = some.select(*KEY, F.inline(sides)).where(is_short_edge_text(F.col("line")))
    text = trim(F.col("line"))
    return rows.select(*KEY, "side", "line_index", text.alias("text"), signature(text).alias("normalized"), page_number(text).alias("number"))


def geometry_candidates(pages: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Edge candidates from layout fingerprints (book_id, page_index, block_id, line_signatures, rect, role, role_confidence).

    A block in the upper or lower 0.30 of a page names lines by signature; the first such line of the page at the top,
    the last at the bottom.
    """
    bottom = F.col("rect.y") + F.col("rect.h")
    side = F.when(bottom <= 0.30, "top").when(F.col("rect.y") >= 0.70, "bottom")
    marks = fingerprints.withColumn("side", side).where("side is not null").select(*KEY, "side", "rect", "role", "role_confidence", F.explode("line_signatures").alias("normalized"))
    lines = page_lines(pages).withColumn("normalized", signature(F.col("line"))).where(~is_blank(F.col("line")))
    met = marks.join(lines, [*KEY, "normalized"])
    at = F.when(F.col("side") == "top", F.min("line_index")).otherwise(F.max("line_index"))
    found = met.groupBy(*KEY, "side", "normalized", "rect", "role", "role_confidence").agg(at.alias("line_index"))
    rows = found.join(lines.select(*KEY, "line_index", "line"), [*KEY, "line_index"]).where(is_short_edge_text(F.col("line")))
    text = trim(F.col("line"))
    return rows.select(*KEY, "side", "line_index", text.alias("text"), "normalized", page_number(text).alias("number"), (F.col("rect.y") + F.col("rect.h") / 2).alias("mid_y"), F.col("rect.h").alias("height"), "role", "role_confidence")


def all_candidates(pages: DataFrame, fingerprints: DataFrame | None = None) -> DataFrame:
    """Both kinds of candidates, one for each place and signature: with geometry first, then the surer role, then the smaller text."""
    plain = edge_candidates(pages).withColumns({"mid_y": F.lit(None).cast("double"), "height": F.lit(None).cast("double"), "role": F.lit(None).cast("string"), "role_confidence": F.lit(0.0)})
    if fingerprints is None:
        return plain.dropDuplicates([*KEY, "side", "line_index"])
    best = Window.partitionBy(*KEY, "line_index", "side", "normalized").orderBy(F.col("mid_y").isNull(), F.col("role_confidence").desc(), "text")
    return plain.unionByName(geometry_candidates(pages, fingerprints)).withColumn("_at", F.row_number().over(best)).where("_at = 1").drop("_at")


def required_pages(n_pages: Column) -> Column:
    return F.greatest(F.lit(3), F.ceil(n_pages * 0.4))


def _recurring(candidates: DataFrame, group: list[str], required: Column, geometry: bool) -> DataFrame:
    """Candidates of groups on enough pages. Where enough of those have geometry, only the densest band of heights counts."""
    by = Window.partitionBy("book_id", *group)
    keys = ["book_id", *group]
    counts = candidates.groupBy(*keys).agg(F.count_distinct("page_index").alias("_pages"), F.count_distinct(F.when(F.col("mid_y").isNotNull(), F.col("page_index"))).alias("_placed"))
    same = reduce(lambda a, b: a & b, [F.col(f"c.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys])
    seen = candidates.alias("c").join(counts.alias("n"), same).select("c.*", "n._pages", "n._placed")
    if not geometry:
        return seen.where(F.col("_pages") >= required).drop("_pages", "_placed")
    seen = seen.withColumn("_required", required)
    seen = seen.where("_pages >= _required")
    text_only = seen.where("_placed < _required").drop("_pages", "_placed", "_required")
    placed = seen.where("_placed >= _required and mid_y is not null")
    height = F.median(F.when(F.col("height") > 0, F.col("height"))).over(by)
    placed = placed.withColumn("_tol", F.greatest(F.lit(0.022), F.least(F.lit(0.060), F.coalesce(height, F.lit(0.015)) * 1.8)))
    seeds = placed.select("book_id", *group, F.col("mid_y").alias("_seed")).distinct()
    near = placed.join(seeds, ["book_id", *group]).where(F.abs(F.col("mid_y") - F.col("_seed")) <= F.col("_tol"))
    size = near.groupBy("book_id", *group, "_seed").agg(F.count_distinct("page_index").alias("_n"), F.min(F.struct("page_index", "line_index", "normalized")).alias("_first"))
    best = size.groupBy("book_id", *group).agg(F.min_by(F.struct("_seed", "_n"), F.struct(-F.col("_n"), F.col("_first"), F.col("_seed"))).alias("_best"))
    banded = placed.join(best, ["book_id", *group]).where((F.abs(F.col("mid_y") - F.col("_best._seed")) <= F.col("_tol")) & (F.col("_best._n") >= F.col("_required")))
    return text_only.unionByName(banded.select(*text_only.columns))


def removals(pages: DataFrame, config: CleanupConfig | None = None, fingerprints: DataFrame | None = None) -> DataFrame:
    """The lines to take out: book_id, page_index, line_index.

    Repeated running matter keeps one occurrence: a sure heading, else the first. Plain page numbers that follow the
    page order all go, decorated ones but one. Lines that are sure headings stay unless they are page numbers.
    """
    config = config or CleanupConfig()
    counts = pages.groupBy("book_id").agg(F.count("*").alias("n_pages"))
    # a few short rows a page, which every branch below reads
    found = staged(all_candidates(pages, fingerprints), "edges").join(counts, "book_id")
    placed = fingerprints is not None
    sure = (F.col("role") == "heading") & (F.col("role_confidence") >= 0.70)
    order = [F.col("page_index"), F.col("line_index"), F.when(F.col("side") == "top", 0).otherwise(1), F.col("normalized")]
    parts = []

    def all_but_one(rows: DataFrame, group: list[str]) -> DataFrame:
        w = Window.partitionBy("book_id", *group).orderBy(F.coalesce(~sure, F.lit(True)), *order)
        return rows.withColumn("_at", F.row_number().over(w)).where("_at > 1")

    if config.removes_running_matter:
        matter = found.where((F.col("n_pages") >= 4) & F.col("text").rlike(r"\p{L}") & F.col("number").isNull())
        group = ["side", "normalized"]
        parts.append(all_but_one(_recurring(matter, group, required_pages(F.col("n_pages")), placed), group))
    if config.removes_page_numbers:
        numbered = found.where("number is not null").withColumns({"template": F.col("number.template"), "pure": F.col("number.pure"), "shift": F.col("number.number") - F.col("page_index")})
        group = ["side", "template", "shift", "pure"]
        proven = _recurring(numbered, group, F.when(F.col("pure"), F.lit(3)).otherwise(required_pages(F.col("n_pages"))), placed)
        parts += [proven.where("pure"), all_but_one(proven.where("not pure"), group)]
    gone = None
    for p in parts:
        p = p.select(*KEY, "line_index")
        gone = p if gone is None else gone.union(p)
    if gone is None:
        return pages.select(*KEY, F.lit(0).alias("line_index")).where(F.lit(False))
    gone = gone.distinct()
    if fingerprints is not None:
        kept = found.where(sure & F.col("number").isNull()).select(*KEY, "line_index").distinct()
        gone = gone.join(kept, [*KEY, "line_index"], "left_anti")
    return gone


def clean_books(pages: DataFrame, config: CleanupConfig | None = None, fingerprints: DataFrame | None = None) -> DataFrame:
    """Pages without the lines in ``removals``; a page of which nothing is left is empty, with confidence 0.

    ``pages``: book_id, page_index, text, extraction_source, confidence; one row a page. Other columns pass through.
    """
    gone = removals(pages, config, fingerprints).groupBy(*KEY).agg(F.collect_set("line_index").alias("_gone"))
    out = pages.join(gone, KEY, "left")
    left = F.array_join(F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains("_gone", i)), "\n")
    out = out.withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(finalize_whitespace(left)))
    emptied = F.col("_gone").isNotNull() & (F.col("text") == "")
    return out.withColumns({"extraction_source": F.when(emptied, "empty").otherwise(F.col("extraction_source")), "confidence": F.when(emptied, 0.0).otherwise(F.col("confidence"))}).drop("_gone")
