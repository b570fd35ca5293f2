"""What the layout found on each page, for people: the edges that its order comes to, and the whole as JSON or as lines of text.

Nothing here changes a result. A page that was not taken apart has its decision and nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.text import at_most_graphemes, graphemes
from pagewright.operators.columns import column_gaps
from pagewright.operators.pagewise import PAGE

#: Graphemes of a text that are shown.
SHOWN = 160
#: Column that orders the lines of a page's text form.
_PLACE = ["section", "nth"]


def brief(text: Column) -> Column:
    return F.when(graphemes(text) > SHOWN, F.concat(at_most_graphemes(text, SHOWN), F.lit("…"))).otherwise(text)


def number(c: Column) -> Column:
    """Three decimals, as text."""
    return F.format_string("%.3f", c.cast("double"))


def effective_edges(order: DataFrame, regions: DataFrame, columns: DataFrame, roles: DataFrame, hints: DataFrame) -> DataFrame:
    """book_id, page_index, nth, src, dst, reason, confidence: each two blocks that follow each other, and why.

    The first of: a footnote comes; a caption follows its anchor; an edge was asked for; the region changes; a sidebar
    comes; the column stays or changes. A block counts for its first region. ``confidence`` is the order's.
    """
    at = order.select(*PAGE, "confidence", F.posexplode("ordered_ids").alias("nth", "src"))
    pairs = at.withColumn("dst", F.lead("src").over(Window.partitionBy(*PAGE).orderBy("nth"))).where("dst is not null")
    members = regions.select(*PAGE, "region_id", "sidebar_ids", F.explode(F.array_distinct(F.concat("primary_ids", "sidebar_ids", "spanning_ids"))).alias("block_id"))
    home = members.groupBy(*PAGE, "block_id").agg(F.min(F.struct("region_id", F.array_contains("sidebar_ids", F.col("block_id")).alias("aside"))).alias("r"))
    lanes = columns.select(*PAGE, "region_id", "column_id", F.explode("block_ids").alias("block_id"))
    lane = lanes.groupBy(*PAGE, "block_id", "region_id").agg(F.min("column_id").alias("column_id"))
    home = home.select(*PAGE, "block_id", "r.region_id", "r.aside").join(lane, [*PAGE, "block_id", "region_id"], "left")
    home = roles.select(*PAGE, "block_id", "role").join(home, [*PAGE, "block_id"], "left")
    end = lambda k: home.select(*PAGE, F.col("block_id").alias(k), F.struct("region_id", "aside", "column_id", "role").alias(f"{k}_at"))
    captions = F.max(F.col("reason") == "captionAttachment")
    asked = hints.groupBy(*PAGE, "src", "dst").agg(captions.alias("is_caption"), F.min(F.when(F.col("reason") != "captionAttachment", F.col("reason"))).alias("asked"))
    rows = pairs.join(end("src"), [*PAGE, "src"], "left").join(end("dst"), [*PAGE, "dst"], "left").join(asked, [*PAGE, "src", "dst"], "left")
    a, b = F.col("src_at"), F.col("dst_at")
    reason = (
        F.when(b["role"] == "footnote", "footnotePlacement").when(F.col("is_caption"), "captionAttachment").when(F.col("asked").isNotNull(), F.col("asked"))
        .when(~a["region_id"].eqNullSafe(b["region_id"]), "regionSequence").when(b["aside"], "sidebarAttachment").when(a["column_id"] != b["column_id"], "columnSequence").otherwise("sameColumn")
    )
    return rows.select(*PAGE, "nth", "src", "dst", reason.alias("reason"), "confidence")


def snapshots(decisions: DataFrame, got: dict[str, DataFrame]) -> DataFrame:
    """book_id, page_index, snapshot (JSON, keys in order), description (lines of text) of every page in ``decisions``.

    ``got``: what ``operators.layout.examine`` found: lines, blocks, regions, columns, roles, order, hints. A page's
    parts are gathered in one row, which a page bounds.
    """
    edges = effective_edges(*[got[k] for k in ("order", "regions", "columns", "roles", "hints")])
    gaps = column_gaps(got["columns"]).withColumn("nth", F.row_number().over(Window.partitionBy(*PAGE).orderBy("region_id", "min_x")) - 1)
    removed = got["order"].select(*PAGE, F.posexplode("removed").alias("nth", "e")).select(*PAGE, "nth", "e.*")

    def gather(name: str, rows: DataFrame, *fields) -> DataFrame:
        return rows.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))

    sure = number(F.col("confidence")).alias("confidence")
    parts = [
        gather("lines", got["lines"], "line_id", brief(F.col("text")).alias("text"), "rtl"), gather("blocks", got["blocks"], "block_id", brief(F.col("text")).alias("text"), "n_lines"),
        gather("regions", got["regions"], "region_id", "kind", sure, "primary_ids", "sidebar_ids", "spanning_ids"), gather("roles", got["roles"], "block_id", "role", sure, "signals"),
        gather("gutters", gaps, "region_id", "nth", number(F.col("min_x")).alias("min_x"), number(F.col("max_x") - F.col("min_x")).alias("width")), gather("edges", edges, "nth", "src", "dst", "reason", sure), gather("removed", removed, "nth", "src", "dst", "reason", sure),
        got["order"].select(*PAGE, "ordered_ids", number(F.col("confidence")).alias("order_confidence"), "used_fallback"),
    ]
    out = decisions.select(*PAGE, "decision", "reason", "complexity", number(F.col("complexity_confidence")).alias("complexity_confidence"))
    for p in parts:
        out = out.join(p, PAGE, "left")
    named = sorted(c for c in out.columns if c not in PAGE)
    return out.select(*PAGE, F.to_json(F.struct(*named), {"pretty": "true"}).alias("snapshot"), description(out).alias("description"))


def description(page: DataFrame) -> Column:
    """A page's row of ``snapshots`` as lines of text."""
    some = lambda c: F.coalesce(F.col(c), F.array())
    ids = lambda c: F.concat(F.lit("["), F.array_join(c, ", "), F.lit("]"))
    edge = lambda kind: lambda e: F.format_string(f"{kind} %d->%d reason=%s confidence=%s", e["src"], e["dst"], e["reason"], e["confidence"])
    counts = F.format_string("lines=%d blocks=%d regions=%d gutters=%d", *[F.greatest(F.lit(0), F.size(F.col(c))) for c in ("lines", "blocks", "regions", "gutters")])
    lines = [
        F.array(F.format_string("page=%s decision=%s", F.col("page_index").cast("string"), F.col("decision")), F.format_string("reason=%s", F.col("reason"))),
        F.array(F.when(F.col("complexity").isNotNull(), F.format_string("complexity=%s confidence=%s", F.col("complexity"), F.col("complexity_confidence"))), counts),
        F.array(F.when(F.col("ordered_ids").isNotNull(), F.format_string("order confidence=%s fallback=%s ids=%s", F.col("order_confidence"), F.col("used_fallback").cast("string"), ids(F.col("ordered_ids"))))),
        F.transform(some("regions"), lambda r: F.format_string("region[%d] kind=%s confidence=%s primary=%s sidebars=%s spanning=%s", r["region_id"], r["kind"], r["confidence"], ids(r["primary_ids"]), ids(r["sidebar_ids"]), ids(r["spanning_ids"]))),
        F.transform(some("gutters"), lambda g: F.format_string("gutter region=%d x=%s width=%s", g["region_id"], g["min_x"], g["width"])),
        F.transform(some("edges"), edge("edge")), F.transform(some("removed"), edge("removedEdge")),
    ]
    return F.array_join(F.array_compact(F.concat(*lines)), "\n")


def extraction_text(lines: DataFrame, glyphs: DataFrame, fragments: DataFrame) -> DataFrame:
    """book_id, page_index, description: the native lines of each page, their glyphs in number, and the fragments made of them, as text."""
    n = glyphs.groupBy(*PAGE, "line_id").agg(F.count("*").alias("n"))
    xy = lambda r: F.format_string("(%s, %s, %s, %s)", *[number(r[c]) for c in "xywh"])
    a = lines.join(n, [*PAGE, "line_id"], "left")
    a = a.select(*PAGE, F.lit(0).alias("section"), F.col("line_id").alias("nth"), F.format_string("line[%d] ranges=%d glyphs=%d rect=%s text=%s", F.col("line_id"), F.col("n_ranges"), F.coalesce("n", F.lit(0)), xy(F.col("rect")), brief(F.col("text"))).alias("s"))
    b = fragments.select(*PAGE, F.lit(1).alias("section"), F.col("fragment_id").alias("nth"), F.format_string("fragment[%d] rect=%s text=%s", F.col("fragment_id"), xy(F.col("rect")), brief(F.col("text"))).alias("s"))
    return a.unionByName(b).groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*_PLACE, "s"))), lambda x: x["s"]), "\n").alias("description"))
