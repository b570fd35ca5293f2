"""Named queries over whole tables, and DuckDB SQL for those that SQL can express.

Structure that the synthetic texts lack (headers, page numbers, headings, ligatures) is planted by the same rule in
both; rectangles are made of line items. No query takes a part of a table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.config import OcrConfig
from pagewright.functions import geometry as g
from pagewright.functions import text as t
from pagewright.functions.ids import stable_id
from pagewright.operators import assembly, bands, blocks, books, chapters, cleanup, columns, complexity, diagnostics, glyphs, layout, lines, paragraphs, policy, reading, regions, roles, segments
from pagewright.sources.adapters import PAGES_PER_BOOK, conversation_pages, document_pages
from pagewright.sources.staging import staged

FLAGSHIP = "book_cleanup"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cleaned_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document pages after page-local cleaning, as native pages; a table, as most queries read them several times."""
    p = document_pages(spark, sf_dir)
    text = t.clean_page(F.col("native_text"), dehyphenates=False)
    p = staged(p.select("book_id", "page_index", text.alias("text")), "cleaned")
    blank = F.col("text") == ""
    return p.withColumns({"extraction_source": F.when(blank, "empty").otherwise("native"), "confidence": F.when(blank, 0.0).otherwise(1.0)})


def cleaned_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = conversation_pages(spark, sf_dir)
    p = staged(p.select("book_id", "page_index", t.clean_page(F.col("native_text"), dehyphenates=False).alias("text")), "turns")
    blank = F.col("text") == ""
    return p.withColumns({"extraction_source": F.when(blank, "empty").otherwise("native"), "confidence": F.when(blank, 0.0).otherwise(1.0)})


def planted_outline(pages: DataFrame) -> DataFrame:
    """An outline with an item for every fourth page, every eighth on the outer level; one points nowhere."""
    at = pages.where("page_index % 4 = 0")
    level = F.when(F.col("page_index") % 8 == 0, 0).otherwise(1)
    page = F.when(F.col("page_index") == 12, F.lit(None)).otherwise(F.col("page_index"))
    return at.select("book_id", F.col("page_index").alias("source_order"), F.concat(F.lit(" Part "), F.col("page_index")).alias("title"), page.alias("page_index"), level.alias("level"))


# ---- queries


def page_clean(spark, sf_dir):
    p = document_pages(spark, sf_dir)
    p = p.select("book_id", "page_index", t.clean_page(F.col("native_text"), dehyphenates=False).alias("text"))
    return p.select("book_id", "page_index", "text", t.word_count(F.col("text")).alias("n_words"))


def page_dehyphenated(spark, sf_dir):
    """Documents in which words are broken over lines, put together again."""
    d = _read(spark, sf_dir, "documents")
    broken = F.coalesce("text", F.lit(""))
    for whole, parts in (("tion", "ti-\non"), (" the ", " well-\nthe "), (" und ", " zwei-\nund-drei "), (". ", ".\n")):
        broken = F.replace(broken, F.lit(whole), F.lit(parts))
    return d.select("doc_id", t.dehyphenate(broken).alias("text"))


def quality_policy(spark, sf_dir):
    odd = [F.col("text"), F.lit(""), F.lit("Short text"), F.repeat(F.lit("�"), F.lit(20)), F.lit("@@@ ### $$$ %%% !!!"), F.substring("text", 1, 60)]
    config = OcrConfig(native_text_threshold=60)
    rows = _read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.array(*odd)).alias("variant", "native"), F.col("text").alias("ocr"))
    rows = rows.withColumn("quality", policy.native_quality(F.col("native"), 60))
    asks = policy.should_recognize(F.col("native"), config, F.col("quality"))
    return rows.select("doc_id", "variant", "quality", asks.alias("asks"), policy.prefers_recognized(F.col("ocr"), F.lit(0.85), F.col("native"), config, F.col("quality")).alias("prefers"))


def source_selection(spark, sf_dir):
    rows = conversation_pages(spark, sf_dir)
    rows = rows.select("book_id", "page_index", F.when(F.col("page_index") % 2 == 0, F.col("native_text")).otherwise("").alias("native_text"), F.concat(F.lit("scan "), "native_text").alias("ocr_text"), (F.col("page_index") / 10.0).alias("ocr_confidence"))
    return policy.select_source(rows).select("book_id", "page_index", "text", "extraction_source", "confidence")


def recognized_text(spark, sf_dir):
    d = _read(spark, sf_dir, "documents")
    lines = d.select(F.col("doc_id").alias("book_id"), F.lit(0).alias("page_index"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("source_order", "text"))
    got = policy.recognized_pages(lines.withColumn("confidence", (F.length("text") % 8) / 8.0))
    return got.select(F.col("book_id").alias("doc_id"), "ocr_text", F.round("ocr_confidence", 9).alias("ocr_confidence"))


def scanned(spark, sf_dir):
    p = conversation_pages(spark, sf_dir)
    return policy.scanned_books(p.withColumn("native_text", F.when(F.col("page_index") > 2, F.col("native_text")).otherwise("x")))


def edge_lines(spark, sf_dir):
    c = cleanup.edge_candidates(cleaned_documents(spark, sf_dir))
    return c.select("book_id", "page_index", "side", "line_index", "text", "normalized", F.col("number.number").alias("number"), F.col("number.template").alias("template"), F.col("number.pure").alias("pure"))


def book_cleanup(spark, sf_dir):
    return cleanup.clean_books(cleaned_documents(spark, sf_dir)).select("book_id", "page_index", "text", "extraction_source", "confidence")


def chapters_by_heading(spark, sf_dir):
    c = chapters.build_chapters(cleaned_documents(spark, sf_dir))
    return c.select("book_id", "chapter_order", "title", "page_lo", "page_hi", "plain_text", "confidence", "is_ocr_sourced")


def chapters_by_outline(spark, sf_dir):
    p = cleaned_documents(spark, sf_dir)
    return chapters.build_chapters(p, planted_outline(p)).select("book_id", "chapter_order", "title", "page_lo", "page_hi", "plain_text", "confidence")


def chapters_by_bucket(spark, sf_dir):
    return chapters.build_chapters(cleaned_turns(spark, sf_dir)).select("book_id", "chapter_order", "title", "page_lo", "page_hi", "plain_text")


def book_statistics(spark, sf_dir):
    return books.statistics(cleaned_documents(spark, sf_dir))


def book_text(spark, sf_dir):
    return books.plain_text(cleaned_turns(spark, sf_dir))


def latest_turns(spark, sf_dir):
    order = conversation_pages(spark, sf_dir)
    p = order.select("book_id", F.floor(F.col("page_index") / 2).cast("int").alias("page_index"), F.col("page_index").alias("input_order"), "native_text")
    return books.latest_pages(p, "input_order").select("book_id", "page_index", "native_text")


def book_metadata(spark, sf_dir):
    d = _read(spark, sf_dir, "supplier")
    raw = d.select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, F.lit("  ")).otherwise(F.concat(F.lit("\t"), F.col("s_name"))).alias("title"), F.concat(F.lit("/books/"), F.col("s_name"), F.lit(".pdf")).alias("path"), F.lit("A. One , B. Two,").alias("author"), F.lit(None).cast("string").alias("keywords"))
    m = books.metadata(raw)
    return m.select("s_suppkey", "title", F.array_join("authors", "|").alias("authors"), F.size("keywords").cast("long").alias("n_keywords"), books.author_line(F.col("authors"), F.lit(None).cast("string")).alias("author_line"))


def outline_walk(spark, sf_dir):
    n, r = _read(spark, sf_dir, "nation"), _read(spark, sf_dir, "region")
    roots = r.select(F.lit(0).alias("book_id"), F.concat(F.lit("r"), F.col("r_regionkey")).alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_regionkey").alias("position"), F.col("r_name").alias("title"), F.lit(None).cast("int").alias("page_index"))
    leaves = n.select(F.lit(0).alias("book_id"), F.concat(F.lit("n"), F.col("n_nationkey")).alias("id"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("parent_id"), F.col("n_nationkey").alias("position"), F.lit("  ").alias("title"), F.col("n_nationkey").cast("int").alias("page_index"))
    return books.flatten_outline(roots.unionByName(leaves)).select("id", "parent_id", "level", "path", "title", "page_index", F.col("source_order").cast("long").alias("source_order"))


def line_signatures(spark, sf_dir):
    lines = _read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_index", "line"))
    return lines.select("doc_id", "line_index", t.signature(F.col("line")).alias("signature"), t.word_count(F.col("line")).alias("n_words"), t.alnum_count(F.col("line")).alias("n_alnum"))


def page_numbers(spark, sf_dir):
    kinds = [F.concat(F.lit("Page "), "doc_id"), F.concat("doc_id", F.lit(" of 99999")), F.concat(F.lit("Some Book • "), "doc_id"), F.concat(F.lit("ÉTÉ – "), "doc_id"), F.lit("iv"), F.concat(F.lit("1234567"), "doc_id"), F.col("text")]
    rows = _read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.array(*kinds)).alias("kind", "line"))
    n = t.page_number(F.col("line"))
    return rows.select("doc_id", "kind", n["number"].alias("number"), n["template"].alias("template"), n["pure"].alias("pure"))


def html_pages(spark, sf_dir):
    p = _read(spark, sf_dir, "pages")
    return p.select("page_id", t.html_preview(F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))).alias("preview"))


def stable_ids(spark, sf_dir):
    c = _read(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", stable_id("page", F.col("conv_id"), F.col("turn"), F.coalesce("role", F.lit(""))).alias("id"))


def table_rows(spark, sf_dir):
    o = _read(spark, sf_dir, "orders")
    cells = F.array(F.col("o_orderkey").cast("string"), F.concat(F.lit("  "), "o_orderstatus", F.lit("\t ")), F.lit(" "), F.col("o_orderpriority"))
    heads = F.array(F.lit("Order"), F.lit(""), F.lit("Gap"), F.lit("Priority"))
    return o.select("o_orderkey", t.linearize_row(cells).alias("row_major"), t.linearize_row_with_headers(heads, cells).alias("with_headers"))


def _rect_of_item():
    """A rectangle of a line item: thousandths from integer arithmetic, a few of them without area."""
    k = lambda c, m: (F.col(c) % m).cast("int")
    return g.rect(k("l_partkey", 700) / 1000.0, k("l_suppkey", 90) * 10 / 1000.0, k("l_partkey", 300) / 1000.0, (k("l_suppkey", 40) + 10) / 1000.0)


def _rects(spark, sf_dir):
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", _rect_of_item().alias("rect"))


def rect_unions(spark, sf_dir):
    r = _rects(spark, sf_dir).where(g.is_valid(F.col("rect")))
    u = r.groupBy("l_orderkey").agg(g.union_agg(F.col("rect")).alias("u"), F.count("*").alias("n"), F.median("rect.h").alias("median_h"), g.upper_median_agg(F.col("rect.h")).alias("upper_h"), g.lower_median_agg(F.col("rect.h")).alias("lower_h"))
    six = lambda c: F.round(c, 6)
    return u.select("l_orderkey", "n", *[six(F.col(f"u.{c}")).alias(c) for c in "xywh"], six("median_h").alias("median_h"), six("upper_h").alias("upper_h"), six("lower_h").alias("lower_h"))


def rect_conflicts(spark, sf_dir):
    r = _rects(spark, sf_dir).where(g.is_valid(F.col("rect")))
    a, b = r.alias("a"), r.alias("b")
    pairs = a.join(b, (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.l_linenumber") < F.col("b.l_linenumber")))
    share = g.overlap_over_smaller(F.col("a.rect"), F.col("b.rect"))
    return pairs.groupBy(F.col("a.l_orderkey").alias("l_orderkey")).agg(F.count("*").alias("pairs"), F.count_if(share >= 0.65).alias("conflicts"), F.round(F.max(share), 6).alias("largest"))


def rect_normalized(spark, sf_dir):
    li = _read(spark, sf_dir, "lineitem")
    page = g.rect(F.lit(10.0), F.lit(20.0), F.lit(600.0), F.lit(800.0))
    raw = g.rect((F.col("l_partkey") % 700).cast("double"), (F.col("l_suppkey") % 900).cast("double"), F.lit(50.0), F.lit(12.0))
    n = li.select("l_orderkey", "l_linenumber", g.normalized(raw, page, F.col("l_linenumber") * 90).alias("r"))
    return n.select("l_orderkey", "l_linenumber", *[F.round(F.col(f"r.{c}"), 9).alias(c) for c in "xywh"])


def _blocks(spark, sf_dir):
    """Line items as blocks: an order is a page, a third of its items are captions."""
    li = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    id_ = (F.col("l_partkey") * 100_000 + F.col("l_suppkey")) * 10 + F.col("l_linenumber")
    r = li.select("l_orderkey", id_.alias("block_id"), _rect_of_item().alias("rect")).where(g.is_valid(F.col("rect")))
    return r.select(F.lit(0).alias("book_id"), F.col("l_orderkey").alias("page_index"), "block_id", "rect", F.when(F.col("block_id") % 3 == 0, "caption").otherwise("body").alias("role"), F.lit("x").alias("text"), (-F.col("block_id")).alias("source_order"))


def block_neighbours(spark, sf_dir):
    n = blocks.neighbours(_blocks(spark, sf_dir))
    return n.select("page_index", "block_id", F.round("before", 9).alias("before"), F.round("after", 9).alias("after"), "next_block", "anchor")


def block_rows(spark, sf_dir):
    return blocks.row_statistics(_blocks(spark, sf_dir)).drop("book_id")


def block_backtracks(spark, sf_dir):
    return blocks.backtracks(_blocks(spark, sf_dir)).drop("book_id")


def _fragments(spark, sf_dir):
    """Line items as positioned fragments: an order is a page, and a fragment says its part and how it is shipped."""
    li = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus").distinct()
    order = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")) - 1
    rows = li.select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", _rect_of_item().alias("rect"), order.alias("at"))
    said = F.concat(F.lit("Part "), "l_partkey", F.lit(" of "), "l_returnflag", F.when(F.col("l_linestatus") == "O", ".").otherwise(""))
    size = F.when(F.col("l_suppkey") % 5 == 0, 14.0).otherwise(10.0)
    return rows.select(F.lit(0).alias("book_id"), F.col("l_orderkey").cast("int").alias("page_index"), F.col("at").alias("fragment_id"), said.alias("text"), "rect", F.col("at").alias("source_order"), size.alias("font_size"), (F.col("l_suppkey") % 7 == 0).alias("is_bold"), F.lit("native").alias("source"), F.lit(1.0).alias("confidence"))


def page_gaps(spark, sf_dir):
    return columns.longest_interior_gap(lines.valid_fragments(_fragments(spark, sf_dir))).drop("book_id")


def page_gutters(spark, sf_dir):
    """Every gutter that two rows give, or one."""
    g = columns.gutters(lines.valid_fragments(_fragments(spark, sf_dir)).withColumnRenamed("fragment_id", "line_id"), least_rows=1)
    six = lambda c: F.round(c, 6).alias(c)
    return g.select("page_index", six("min_x"), six("max_x"), six("y_lo"), six("y_hi"))


def page_inventories(spark, sf_dir):
    d = _read(spark, sf_dir, "benchmark")
    return d.select("item_id", layout.inventory(F.col("text")).alias("inventory"))


def fragment_widths(spark, sf_dir):
    f = lines.valid_fragments(_fragments(spark, sf_dir))
    return f.select("page_index", "fragment_id", F.round(lines.character_width(F.col("text"), F.col("rect")), 9).alias("width"), roles.begins_reference(F.col("text")).alias("is_note"), assembly.begins_list_item(F.col("text")).alias("is_item"), paragraphs.ends_sentence(F.col("text")).alias("ends"), paragraphs.is_prose(F.col("text")).alias("is_prose"))


def note_marks(spark, sf_dir):
    """How the beginnings and ends of lines are read, with marks planted before and behind them."""
    kinds = ["{}", "12) {}", "• {}", "a. {}", "* {}", "// {}", "{}.”", "{};", "- {}", "†{}", "{} —"]
    d = _read(spark, sf_dir, "benchmark")
    rows = d.select("item_id", F.posexplode(F.array(*[F.concat(F.lit(k.partition("{}")[0]), F.col("text"), F.lit(k.partition("{}")[2])) for k in kinds])).alias("kind", "line"))
    x = F.col("line")
    return rows.select("item_id", "kind", roles.begins_reference(x).alias("is_note"), assembly.begins_list_item(x).alias("is_item"), paragraphs.ends_sentence(x).alias("ends"), paragraphs.is_prose(x).alias("is_prose"), roles.visible(x).alias("n_visible"))


def column_serials(spark, sf_dir):
    """Whether suppliers as columns follow each other in the order of an order's lines."""
    li = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber")
    members = li.select(F.lit(0).alias("book_id"), F.col("l_orderkey").alias("page_index"), F.lit(0).alias("region_id"), (F.col("l_suppkey") % 3).alias("column_id"), g.rect((F.col("l_suppkey") % 3).cast("double"), F.lit(0.0), F.lit(0.3), F.lit(1.0)).alias("rect"), F.col("l_linenumber").alias("source_order"))
    return columns.columns_follow_source(members).select("page_index", "serial")


def page_complexity(spark, sf_dir):
    a = complexity.assess(_fragments(spark, sf_dir))
    return a.select("page_index", *[F.round(c, 6).alias(c) if c in ("interior_gap", "lane_gap", "median_w", "median_h", "short_share") else c for c in complexity.FEATURES], "complexity", F.round("confidence", 6).alias("confidence"), "analyzes")


def layout_lines(spark, sf_dir):
    f = _fragments(spark, sf_dir)
    return lines.build_lines(f).select("page_index", "line_id", F.size("fragment_ids").alias("n_fragments"), "text", "rtl")


def layout_blocks(spark, sf_dir):
    return _layout_blocks(spark, sf_dir).select("page_index", "block_id", "text", "n_lines", "is_bold")


def _layout_blocks(spark, sf_dir):
    return staged(assembly.build_blocks(staged(lines.build_lines(_fragments(spark, sf_dir)), "lines")), "blocks")


def layout_regions(spark, sf_dir):
    areas, _ = regions.regions(_layout_blocks(spark, sf_dir))
    return areas.select("page_index", "region_id", "kind", F.round("confidence", 6).alias("confidence"), "primary_ids", "sidebar_ids", "spanning_ids")


def layout_roles(spark, sf_dir):
    b = _layout_blocks(spark, sf_dir)
    return roles.assign_roles(b, regions.sidebars(b)).select("page_index", "block_id", "role", F.round("confidence", 6).alias("confidence"))


def layout_order(spark, sf_dir):
    b = _layout_blocks(spark, sf_dir)
    areas, own = regions.regions(b)
    assigned = staged(roles.assign_roles(b, regions.sidebars(b)), "roles")
    o = reading.reading_order(b, areas, staged(own, "columns"), assigned, roles.hints(b, assigned))
    return o.select("page_index", "ordered_ids", F.size("removed").alias("n_removed"), "n_conflicts", F.round("confidence", 6).alias("confidence"), "used_fallback")


def layout_decisions(spark, sf_dir):
    f = staged(_fragments(spark, sf_dir), "fragments")
    decisions, _ = layout.analyze(f.select("book_id", "page_index").distinct(), f)
    return decisions.select("page_index", "decision", "reason", "text")


#: Lines of a planted page, and the rows that its planted gutters reach down.
LINES_PER_PAGE, ROWS_WITH_GUTTER = 60, 18


def _column_lines(spark, sf_dir):
    """Documents set in two or three lanes: their sentences are lines, some across all lanes, inset, or of another height."""
    d = _read(spark, sf_dir, "documents").select("doc_id", F.filter(F.split(F.coalesce("text", F.lit("")), r"\n|\. "), lambda x: F.length(F.trim(x)) > 0).alias("s"))
    rows = d.select("doc_id", F.posexplode("s").alias("k", "s"))
    n, slot = 2 + F.col("doc_id") % 2, F.col("k") % LINES_PER_PAGE
    rows = rows.withColumns({"page_index": F.floor(F.col("k") / LINES_PER_PAGE).cast("int"), "n": n.cast("int"), "slot": slot, "lane": (slot % n).cast("int"), "row": F.floor(slot / n).cast("int")})
    spans = ((F.col("doc_id") % 4 == 0) & (F.col("slot") % 20 == 19)) | ((F.col("doc_id") % 4 == 1) & (F.col("slot") == LINES_PER_PAGE - 1))
    inset = F.when((F.col("doc_id") % 5 == 0) & (F.col("row") % 6 == 5), 20).otherwise(0)
    lower = F.when(F.col("doc_id") % 7 == 0, F.col("lane") * 4).otherwise(0) + F.when(spans, 12).otherwise(0)
    y = 60 + F.col("row") * 28 + lower + F.when((F.col("doc_id") % 3 == 2) & (F.col("slot") >= 3 * LINES_PER_PAGE / 4), 60).otherwise(0)
    w = F.when(spans, 850).otherwise(F.least(F.lit(230), 40 + F.length("s") * 3))
    h = F.when((F.col("doc_id") % 11 == 0) & (F.col("lane") == 1), 10).otherwise(15)
    box = g.rect((50 + F.when(spans, 0).otherwise(F.col("lane") * 300 + inset)) / 1000.0, y / 1000.0, w / 1000.0, h / 1000.0)
    text = F.concat("s", F.when((F.col("k") * 7 + F.col("doc_id")) % 5 < 3, F.lit(".")).otherwise(F.lit("")))
    rtl = F.col("doc_id") % 6 == 3
    return rows.select(F.col("doc_id").alias("book_id"), "page_index", F.col("slot").alias("line_id"), text.alias("text"), box.alias("rect"), rtl.alias("rtl"), F.col("slot").alias("source_order"), F.lit(10.0).alias("font_size"), spans.alias("is_bold"), F.array(F.col("slot")).alias("fragment_ids"), "n", "lane", "row")


def column_lanes(spark, sf_dir):
    """Pages that are plain between planted gutters, which end above the last rows."""
    rows = staged(_column_lines(spark, sf_dir), "lines")
    page = ["book_id", "page_index"]
    reach = rows.where(F.col("row") < ROWS_WITH_GUTTER).groupBy(*page).agg(F.min("rect.y").alias("y_lo"), F.max(F.col("rect.y") + F.col("rect.h")).alias("y_hi"), F.first("n").alias("n"))
    found = reach.select(*page, "y_lo", "y_hi", F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("j")).withColumns({"min_x": (F.col("j") * 300 - 15) / 1000.0, "max_x": (F.col("j") * 300 + 45) / 1000.0})
    found = found.withColumn("center", (F.col("min_x") + F.col("max_x")) / 2)
    return bands.lanes(rows, found).select(*page, "line_id", "part", "lane", "rtl")


def column_bands(spark, sf_dir):
    """The bands and lanes of documents set in columns, with the gutters that their lines leave open."""
    rows = staged(_column_lines(spark, sf_dir).drop("n", "lane", "row"), "lines")
    found = staged(columns.gutters(rows), "gutters")
    mixed = staged(bands.mixed_parts(rows, found), "mixed")
    whole = bands.lanes(rows.join(mixed.select("book_id", "page_index").distinct(), ["book_id", "page_index"], "left_anti"), found)
    whole = whole.select("book_id", "page_index", F.lit(0).alias("band"), "line_id", "part", "lane", "rtl", F.lit("lanes").alias("kind"))
    return mixed.unionByName(whole).select("book_id", "page_index", "line_id", "band", "part", "kind")


#: Glyphs of a planted line, lines of a planted page.
LINE_GLYPHS, PAGE_LINES = 40, 40


def _glyphs(spark, sf_dir):
    """Turns set in lines of 40 glyphs: some have a wide gap inside, some are made of two stretches, some pages are turned."""
    t = _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split(F.coalesce("text", F.lit("")), "")).alias("k", "char"))
    k, i = F.floor(F.col("k") / LINE_GLYPHS), F.col("k") % LINE_GLYPHS
    rows = t.where("char != ''").select(F.col("conv_id").alias("book_id"), (F.col("turn") * 1000 + F.floor(k / PAGE_LINES)).cast("int").alias("page_index"), (k % PAGE_LINES).cast("int").alias("line_id"), i.cast("int").alias("at"), "char")
    odd = (F.col("book_id") + F.col("line_id")) % 3 != 0
    x = 40 + F.col("at") * 12 + F.when((F.col("at") >= 20) & odd, 60).otherwise(0) + F.when((F.col("at") >= 30) & (F.col("line_id") % 5 == 0), 31).otherwise(0)
    box = g.rect(x / 1000.0, (50 + F.col("line_id") * 20) / 1000.0, (8 + F.ascii("char") % 5) / 1000.0, F.lit(0.012))
    part = F.when((F.col("book_id") % 7 == 0) & (F.col("at") >= 35), 1).otherwise(0)
    size = F.when(F.col("at") % 9 == 0, 14.0).otherwise(10.0)
    return rows.select("book_id", "page_index", "line_id", part.alias("part"), "at", "char", box.alias("rect"), size.alias("font_size"), ((F.col("line_id") % 4 == 0) & (F.col("at") % 11 == 3)).alias("is_bold"), F.lit(False).alias("is_italic"))


def _native_lines(rows):
    """The lines of planted glyphs: a page is 600 points wide and 1000 high; text without a wide gap is tightly set."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "char"))), lambda x: x["char"]), "")
    last = F.max_by(F.col("rect.w"), "at")
    l = rows.groupBy("book_id", "page_index", "line_id").agg(text.alias("text"), g.union_agg(F.col("rect")).alias("rect"), F.count_distinct("part").cast("int").alias("n_ranges"), ((F.count("*") - 1) * 12 / 1000.0 + last).alias("set"))  # noqa: E741
    box = g.rect(F.col("rect.x") * 600, (1 - F.col("rect.y") - F.col("rect.h")) * 1000, F.col("rect.w") * 600, F.col("rect.h") * 1000)
    turned = F.when(F.col("book_id") % 13 == 0, 90).otherwise(0)
    return l.select("book_id", "page_index", "line_id", "text", "rect", box.alias("box"), F.lit(600.0).alias("page_width"), turned.alias("rotation"), (F.col("set") * 600).alias("natural_width"), "n_ranges")


def glyph_islands(spark, sf_dir):
    """Every stretch of a line cut at its wide gaps."""
    p = glyphs.pieces(glyphs.glyph_islands(_glyphs(spark, sf_dir)))
    return p.select("book_id", "page_index", "line_id", "part", "island", "text", F.round("rect.x", 6).alias("x"), F.round("rect.w", 6).alias("w"), "n_glyphs", "font_size", "is_bold")


def glyph_samples(spark, sf_dir):
    rows = staged(_glyphs(spark, sf_dir), "glyphs")
    return glyphs.sampled_lines(_native_lines(rows), rows)


def glyph_gutters(spark, sf_dir):
    rows = staged(_glyphs(spark, sf_dir), "glyphs")
    found = glyphs.glyph_gutters(_native_lines(rows), glyphs.glyph_islands(rows))
    six = lambda c: F.round(c, 6).alias(c)
    return found.select("book_id", "page_index", *map(six, ("min_x", "max_x", "y_lo", "y_hi")))


def native_fragments(spark, sf_dir):
    rows = _glyphs(spark, sf_dir)  # read twice, which takes less than a table of all glyphs
    f = glyphs.native_fragments(staged(_native_lines(rows), "lines"), rows)
    return f.select("book_id", "page_index", "fragment_id", "text", F.round("rect.x", 6).alias("x"), F.round("rect.w", 6).alias("w"), "font_size", "is_bold")


def native_order(spark, sf_dir):
    return glyphs.natively_ordered(_native_lines(_glyphs(spark, sf_dir)))


def native_paragraphs(spark, sf_dir):
    """Documents as pages of native lines, further apart before every fourth line."""
    d = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("book_id"), F.lit(0).alias("page_index"), F.coalesce("text", F.lit("")).alias("text"))
    l = d.select("book_id", "page_index", F.posexplode(F.filter(F.split("text", r"\r\n|\r|\n"), lambda x: F.length(F.trim(x)) > 0)).alias("line_id", "text"))  # noqa: E741
    y = F.col("line_id") * 12 + F.floor(F.col("line_id") / 4) * 9
    box = g.rect(F.lit(0.1), y / 1000.0, F.least(F.lit(800), F.length("text") * 6) / 1000.0, F.lit(0.01))
    l = l.select("*", box.alias("rect"), F.lit(0).alias("rotation"), F.when((F.col("book_id") % 5 == 0) & (F.col("line_id") == 9), 2).otherwise(1).alias("n_ranges"))  # noqa: E741
    return glyphs.native_paragraphs(d, l).select(F.col("book_id").alias("doc_id"), "text")


def effective_edges(spark, sf_dir):
    """Why the items of an order follow each other, with regions, columns, roles and asked edges planted by their keys."""
    li = _read(spark, sf_dir, "lineitem").select(F.lit(0).alias("book_id"), F.col("l_orderkey").alias("page_index"), F.col("l_linenumber").cast("int").alias("id"), "l_partkey", "l_suppkey", "l_returnflag").distinct()
    li = li.groupBy("book_id", "page_index", "id").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"), F.min("l_returnflag").alias("f"))
    page = ["book_id", "page_index"]
    order = li.groupBy(*page).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("s") % 5, "id"))), lambda x: x["id"]).alias("ordered_ids"), F.lit(0.9).alias("confidence"))
    ids = lambda cond: F.sort_array(F.collect_list(F.when(cond, F.col("id"))))
    kind = F.col("p") % 4
    areas = li.where("p % 11 != 0").groupBy(*page, (F.col("p") % 2).cast("int").alias("region_id")).agg(ids(kind < 2).alias("primary_ids"), ids(kind == 2).alias("sidebar_ids"), ids(kind == 3).alias("spanning_ids"))
    lanes = li.where("p % 4 < 2").groupBy(*page, (F.col("p") % 2).cast("int").alias("region_id"), (F.col("s") % 2).cast("int").alias("column_id")).agg(F.sort_array(F.collect_list("id")).alias("block_ids"))
    roles_ = li.select(*page, F.col("id").alias("block_id"), F.when((F.col("f") == "R") & (F.col("p") % 3 == 0), "footnote").otherwise("body").alias("role"))
    asked = li.where("p % 5 = 0").select(*page, F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.when(F.col("p") % 2 == 0, "captionAttachment").otherwise("semanticHint").alias("reason"))
    return diagnostics.effective_edges(order, areas, lanes, roles_, asked).select("page_index", "nth", "src", "dst", "reason", "confidence")


def reading_edges(spark, sf_dir):
    li = _read(spark, sf_dir, "lineitem")
    return blocks.distinct_edges(li.select((F.col("l_partkey") % 100).alias("src"), (F.col("l_suppkey") % 100).alias("dst"), (F.col("l_linenumber") / 8.0).alias("confidence"), F.col("l_returnflag").alias("reason")))


def text_similarity(spark, sf_dir):
    d = _read(spark, sf_dir, "benchmark")
    other = F.concat(F.lit("The  "), F.expr("substring(text, 3)"))
    return d.select("item_id", F.round(t.similarity(F.col("text"), other), 9).alias("similarity"))


def speech_segments(spark, sf_dir):
    p = staged(cleanup.clean_books(cleaned_documents(spark, sf_dir)), "books")
    return segments.build_segments(p, chapters.build_chapters(p))


def speech_segments_by_page(spark, sf_dir):
    p = cleaned_turns(spark, sf_dir)
    return segments.build_segments(p, chapters.build_chapters(p), across_pages=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        page_clean, page_dehyphenated, quality_policy, source_selection, recognized_text, scanned, edge_lines, book_cleanup, chapters_by_heading, chapters_by_outline, chapters_by_bucket, book_statistics, book_text,
        latest_turns, book_metadata, outline_walk, line_signatures, page_numbers, html_pages, stable_ids, table_rows, rect_unions, rect_conflicts, rect_normalized, block_neighbours, block_rows, block_backtracks, reading_edges, text_similarity, speech_segments, speech_segments_by_page,
        page_gaps, page_gutters, page_inventories, fragment_widths, note_marks, column_serials, page_complexity, layout_lines, layout_blocks, layout_regions, layout_roles, layout_order, layout_decisions, column_lanes, column_bands, glyph_islands, glyph_samples, glyph_gutters, native_fragments, native_order, native_paragraphs, effective_edges,
    )
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


# ---- SQL

_W, _NW = r"[\t-\r\x{85}\p{Z}]", r"[^\t-\r\x{85}\p{Z}]"


def _trim(x: str) -> str:
    return rf"regexp_replace({x}, '^{_W}+|{_W}+$', '', 'g')"


def _final(x: str) -> str:
    x = rf"regexp_replace({x}, '[ \t]+\n', chr(10), 'g')"
    x = rf"regexp_replace({x}, '[ \t]{{2,}}', ' ', 'g')"
    return _trim(rf"regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g')")


def _clean(x: str) -> str:
    x = f"replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    x = rf"regexp_replace({x}, '[\x00-\x08\x0B-\x1F\x7F-\x{{9F}}\p{{Cf}}]', '', 'g')"
    for a, b in t.LIGATURES:
        x = f"replace({x}, '{a}', '{b}')"
    return _final(x)


def _words(x: str) -> str:
    return f"len(regexp_extract_all({x}, '{_NW}+'))"


def _signature(x: str) -> str:
    return rf"strip_accents(lower(regexp_replace({_trim(x)}, '[ \t]+', ' ', 'g')))"


_LOW = rf"lower(regexp_replace({_trim('line')}, '[ \t]+', ' ', 'g'))"
_NUMBER = rf"""
  SELECT *, CASE WHEN pure_n != '' THEN pure_n::INT WHEN is_decorated THEN deco_n::INT END AS number,
         CASE WHEN pure_n != '' THEN 'page-number' WHEN is_decorated THEN prefix || '#' END AS template,
         CASE WHEN pure_n != '' THEN true WHEN is_decorated THEN false END AS pure
  FROM (SELECT *, deco_n != '' AND regexp_matches(prefix, '\p{{L}}') AS is_decorated
        FROM (SELECT *, regexp_extract({_LOW}, '{t.PURE_PAGE_NUMBER}', 1) AS pure_n,
                     regexp_extract({_LOW}, '{t.DECORATED_NUMBER}', 2) AS deco_n,
                     {_signature(f"regexp_extract({_LOW}, '{t.DECORATED_NUMBER}', 1)")} AS prefix FROM lines_in))"""

_PAGES = rf"""
raw_pages AS (
  SELECT doc_id // {PAGES_PER_BOOK} AS book_id, (doc_id % {PAGES_PER_BOOK})::INT AS page_index,
         'The Collected Book ' || (doc_id // {PAGES_PER_BOOK}) || chr(10)
           || CASE WHEN (doc_id % {PAGES_PER_BOOK}) % 10 = 0 THEN 'Chapter ' || ((doc_id % {PAGES_PER_BOOK}) // 10 + 1) || chr(10) ELSE '' END
           || replace(replace(coalesce(text, ''), 'fi', 'ﬁ'), '. ', '.  ')
           || chr(13) || chr(10) || 'Page ' || (doc_id % {PAGES_PER_BOOK} + 1) AS native_text
  FROM documents),
pages_in AS (
  SELECT book_id, page_index, text, CASE WHEN text = '' THEN 'empty' ELSE 'native' END AS extraction_source,
         CASE WHEN text = '' THEN 0.0 ELSE 1.0 END::DOUBLE AS confidence
  FROM (SELECT book_id, page_index, {_clean('native_text')} AS text FROM raw_pages))"""
_TURNS = rf"""
pages_in AS (
  SELECT book_id, page_index, text, CASE WHEN text = '' THEN 'empty' ELSE 'native' END AS extraction_source,
         CASE WHEN text = '' THEN 0.0 ELSE 1.0 END::DOUBLE AS confidence
  FROM (SELECT conv_id AS book_id, turn::INT AS page_index, {_clean("coalesce(text, '')")} AS text FROM conversations))"""
_EDGES = rf"""
all_lines AS (
  SELECT book_id, page_index, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_index FROM pages_in),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY book_id, page_index ORDER BY line_index) AS a,
         row_number() OVER (PARTITION BY book_id, page_index ORDER BY line_index DESC) AS z
  FROM all_lines WHERE regexp_matches(line, '{_NW}')),
lines_in AS (
  SELECT book_id, page_index, side, line_index, line FROM (
    SELECT *, 'top' AS side FROM ranked WHERE a <= 2 UNION ALL SELECT *, 'bottom' FROM ranked WHERE z <= 2)
  WHERE length_grapheme({_trim('line')}) <= 100 AND {_words('line')} <= 14),
edges AS (SELECT book_id, page_index, side, line_index::INT AS line_index, {_trim('line')} AS text, {_signature('line')} AS normalized, number, template, pure FROM ({_NUMBER}))"""

_GONE = r"""
sizes AS (SELECT book_id, count(*) AS n_pages FROM pages_in GROUP BY book_id),
need AS (SELECT book_id, n_pages, greatest(3, ceil(n_pages * 0.4)) AS required FROM sizes),
matter AS (
  SELECT e.*, required, row_number() OVER (PARTITION BY e.book_id, side, normalized ORDER BY page_index, line_index) AS nth
  FROM edges e JOIN need n ON n.book_id = e.book_id WHERE n_pages >= 4 AND number IS NULL AND regexp_matches(text, '\p{L}')),
matter_groups AS (SELECT book_id, side, normalized FROM matter GROUP BY book_id, side, normalized, required HAVING count(DISTINCT page_index) >= required),
numbered AS (
  SELECT e.*, CASE WHEN pure THEN 3 ELSE required END AS required, number - page_index AS shift,
         row_number() OVER (PARTITION BY e.book_id, side, template, pure, number - page_index ORDER BY page_index, line_index) AS nth
  FROM edges e JOIN need n ON n.book_id = e.book_id WHERE number IS NOT NULL),
number_groups AS (SELECT book_id, side, template, pure, shift FROM numbered GROUP BY book_id, side, template, pure, shift, required HAVING count(DISTINCT page_index) >= required),
gone AS (
  SELECT book_id, page_index, line_index FROM matter SEMI JOIN matter_groups USING (book_id, side, normalized) WHERE nth > 1
  UNION SELECT book_id, page_index, line_index FROM numbered SEMI JOIN number_groups USING (book_id, side, template, pure, shift) WHERE pure OR nth > 1)"""

_CHAPTERS = rf"""
span AS (SELECT book_id, min(page_index) AS lo, max(page_index) AS hi FROM pages_in GROUP BY book_id),
starts_all AS (
  SELECT book_id, page_index, title FROM starts
  UNION ALL SELECT s.book_id, s.lo, 'Front Matter' FROM span s JOIN (SELECT book_id, min(page_index) AS first FROM starts GROUP BY book_id) f ON f.book_id = s.book_id AND f.first > s.lo),
ranges AS (
  SELECT a.book_id, a.title, a.page_index AS page_lo, coalesce(lead(a.page_index) OVER (PARTITION BY a.book_id ORDER BY a.page_index) - 1, s.hi) AS page_hi
  FROM starts_all a JOIN span s ON s.book_id = a.book_id),
found AS (
  SELECT r.book_id, r.title, r.page_lo, r.page_hi,
         string_agg(p.text, chr(10) || chr(10) ORDER BY p.page_index) FILTER (regexp_matches(p.text, '{_NW}')) AS plain_text, avg(p.confidence) AS confidence
  FROM ranges r JOIN pages_in p ON p.book_id = r.book_id AND p.page_index BETWEEN r.page_lo AND r.page_hi
  GROUP BY r.book_id, r.title, r.page_lo, r.page_hi)"""
_CHAPTER_ROWS = "SELECT book_id, (row_number() OVER (PARTITION BY book_id ORDER BY page_lo) - 1)::INT AS chapter_order, title, page_lo, page_hi, plain_text, confidence FROM found WHERE plain_text IS NOT NULL"

_QUALITY = rf"""
CASE WHEN visible = 0 THEN 'empty'
     WHEN odd / visible > 0.02 OR (visible >= 30 AND alnum / visible < 0.45) THEN 'suspicious'
     WHEN length_grapheme({_trim('native')}) < 60 THEN 'insufficient' ELSE 'usable' END"""


def _counts(x: str) -> str:
    return rf"len(regexp_extract_all({x}, '[\p{{L}}\p{{M}}\p{{N}}]'))"


_RECTS = """
rects AS (
  SELECT l_orderkey, l_linenumber, (l_partkey % 700) / 1000.0::DOUBLE AS x, (l_suppkey % 90) * 10 / 1000.0::DOUBLE AS y,
         (l_partkey % 300) / 1000.0::DOUBLE AS w, (l_suppkey % 40 + 10) / 1000.0::DOUBLE AS h
  FROM lineitem WHERE l_partkey % 300 > 0)"""

_BLOCKS = """
blocks AS (
  SELECT DISTINCT l_orderkey, (l_partkey * 100000 + l_suppkey) * 10 + l_linenumber AS id, (l_partkey % 700) / 1000.0::DOUBLE AS x, (l_suppkey % 90) * 10 / 1000.0::DOUBLE AS y,
         (l_partkey % 300) / 1000.0::DOUBLE AS w, (l_suppkey % 40 + 10) / 1000.0::DOUBLE AS h
  FROM lineitem WHERE l_partkey % 300 > 0)"""

_FRAGMENTS = """
items AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus FROM lineitem),
numbered AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) - 1 AS nth FROM items),
fragments AS (
  SELECT l_orderkey::INT AS page_index, nth::INT AS fragment_id, (l_partkey % 700) / 1000.0::DOUBLE AS x, (l_suppkey % 90) * 10 / 1000.0::DOUBLE AS y,
         (l_partkey % 300) / 1000.0::DOUBLE AS w, (l_suppkey % 40 + 10) / 1000.0::DOUBLE AS h,
         'Part ' || l_partkey || ' of ' || l_returnflag || CASE WHEN l_linestatus = 'O' THEN '.' ELSE '' END AS text
  FROM numbered WHERE l_partkey % 300 > 0)"""
_MARKS = r"""regexp_matches(trimmed, '^[\p{N}*†‡]') AS is_note, regexp_matches(trimmed, '^([•◦▪▫‣⁃*–—-]|\p{N}{1,4}[.)\]:]|\p{L}[.)])') AS is_item,
regexp_matches(trimmed, '[.!?…。！？]["''’”»)\]}]*$') AS ends,
trimmed != '' AND NOT regexp_matches(trimmed, '[{}]|;$|^(//|```|#|[•◦▪▫‣⁃])|^[*–—-]([\t-\r\p{Z}]|$)|^(\p{N}+|\p{L})[.)\]:]([\t-\r\p{Z}]|$)') AS is_prose"""

_GLYPHS = f"""
chars AS (SELECT conv_id AS book_id, turn, unnest(string_split(coalesce(text, ''), '')) AS ch, unnest(range(len(string_split(coalesce(text, ''), '')))) AS k FROM conversations WHERE coalesce(text, '') != ''),
placed AS (SELECT book_id, (turn * 1000 + k // {LINE_GLYPHS} // {PAGE_LINES})::INT AS page_index, (k // {LINE_GLYPHS} % {PAGE_LINES})::INT AS line_id, (k % {LINE_GLYPHS})::INT AS i, ch FROM chars),
glyphs AS (
  SELECT book_id, page_index, line_id, i, ch, CASE WHEN book_id % 7 = 0 AND i >= 35 THEN 1 ELSE 0 END AS part,
         (40 + i * 12 + CASE WHEN i >= 20 AND (book_id + line_id) % 3 != 0 THEN 60 ELSE 0 END + CASE WHEN i >= 30 AND line_id % 5 = 0 THEN 31 ELSE 0 END) / 1000.0::DOUBLE AS x,
         (50 + line_id * 20) / 1000.0::DOUBLE AS y, (8 + ord(ch) % 5) / 1000.0::DOUBLE AS w,
         CASE WHEN i % 9 = 0 THEN 14.0 ELSE 10.0 END::DOUBLE AS font_size, line_id % 4 = 0 AND i % 11 = 3 AS is_bold FROM placed),
set_lines AS (
  SELECT book_id, page_index, line_id, count(*) AS n, count(DISTINCT part) AS n_ranges, min(x) AS x, max(x + w) - min(x) AS w, min(y) AS y, 0.012::DOUBLE AS h, ((count(*) - 1) * 12 / 1000.0::DOUBLE + arg_max(w, i)) * 600 AS nat_w
  FROM glyphs GROUP BY ALL),
fitted AS (SELECT *, coalesce(nat_w > 0 AND abs(w * 600 - nat_w) <= nat_w * 0.005::DOUBLE + 0.5::DOUBLE, false) AS tight FROM set_lines)"""

SQL: dict[str, str] = {
    "glyph_islands": rf"""
WITH {_GLYPHS},
seen AS (SELECT *, regexp_matches(ch, '{_NW}') AS shows FROM glyphs),
lagged AS (
  SELECT *, last_value(CASE WHEN shows THEN x + w END IGNORE NULLS) OVER p AS b_end, last_value(CASE WHEN shows THEN x END IGNORE NULLS) OVER p AS b_x,
         list_sort(list(w) FILTER (shows) OVER (PARTITION BY book_id, page_index, line_id, part)) AS ws
  FROM seen WINDOW p AS (PARTITION BY book_id, page_index, line_id, part ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cut AS (
  SELECT *, coalesce(shows AND b_x IS NOT NULL AND greatest(x - b_end, b_x - (x + w), 0) >= greatest(0.024::DOUBLE, least(0.06::DOUBLE, ws[len(ws) // 2 + 1] * 4)), false) AS strong FROM lagged),
numbered AS (SELECT *, sum(strong::INT) OVER (PARTITION BY book_id, page_index, line_id, part ORDER BY i)::INT AS island FROM cut)
SELECT book_id, page_index, line_id, part, island, string_agg(ch, '' ORDER BY i) AS text, round(min(x) FILTER (shows), 6) AS x, round(max(x + w) FILTER (shows) - min(x) FILTER (shows), 6) AS w,
       count(*) AS n_glyphs, list_sort(list(font_size))[count(*) // 2 + 1] AS font_size, bool_or(is_bold) AS is_bold
FROM numbered GROUP BY book_id, page_index, line_id, part, island""",
    "glyph_samples": f"""
WITH {_GLYPHS},
may AS (SELECT *, row_number() OVER (PARTITION BY book_id, page_index ORDER BY line_id) - 1 AS nth, count(*) OVER (PARTITION BY book_id, page_index) - 1 AS last FROM fitted WHERE n >= 8 AND n_ranges = 1 AND NOT tight)
SELECT book_id, page_index, line_id, (row_number() OVER (PARTITION BY book_id, page_index ORDER BY line_id) - 1)::INT AS row
FROM may WHERE last >= 1 AND (last < 5 OR list_contains([0, round(last / 4.0::DOUBLE), round(last / 2.0::DOUBLE), round(last * 0.75::DOUBLE), last], nth))""",
    "native_order": """
WITH """ + _GLYPHS + """,
boxed AS (SELECT *, x * 600 AS bx, (1 - y - h) * 1000 AS b_y, w * 600 AS bw, h * 1000 AS bh FROM fitted),
told AS (
  SELECT book_id, page_index, abs(bx - first_value(bx) OVER o) <= 1 AND coalesce(b_y + bh <= lag(b_y) OVER o + 0.5::DOUBLE, true) AND n_ranges = 1 AND book_id % 13 != 0 AND tight AS fine
  FROM boxed WINDOW o AS (PARTITION BY book_id, page_index ORDER BY line_id))
SELECT book_id, page_index, bool_and(fine) AND count(*) >= 3 AS is_plain FROM told GROUP BY book_id, page_index""",
    "page_gaps": f"""
WITH {_FRAGMENTS}, strips AS (
  SELECT DISTINCT page_index, unnest(range(least(63, floor(x * 64)::INT), least(63, floor(greatest(x, x + w - 0.000001::DOUBLE) * 64)::INT) + 1)) AS strip FROM fragments),
steps AS (SELECT page_index, strip - lag(strip) OVER (PARTITION BY page_index ORDER BY strip) - 1 AS empty FROM strips)
SELECT page_index, coalesce(max(empty), 0) / 64.0::DOUBLE AS gap FROM steps GROUP BY page_index""",
    "fragment_widths": rf"""
WITH {_FRAGMENTS}, t AS (SELECT *, text AS trimmed FROM fragments)
SELECT page_index, fragment_id, round(greatest(0.001::DOUBLE, w / greatest(1, length(replace(text, ' ', '')))), 9) AS width, {_MARKS} FROM t""",
    "note_marks": rf"""
WITH v AS (
  SELECT item_id, unnest([text, '12) ' || text, '• ' || text, 'a. ' || text, '* ' || text, '// ' || text, text || '.”', text || ';', '- ' || text, '†' || text, text || ' —']) AS line, unnest(range(11))::INT AS kind FROM benchmark),
t AS (SELECT *, {_trim('line')} AS trimmed FROM v)
SELECT item_id, kind, {_MARKS}, len(regexp_extract_all(line, '{_NW}'))::INT AS n_visible FROM t""",
    "page_inventories": r"""
SELECT item_id, array_to_string(list_sort(regexp_extract_all(text, '[\p{L}\p{M}\p{N}]')), '') AS inventory FROM benchmark""",
    "column_lanes": rf"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\n|\. '), lambda x: length(trim(x)) > 0) AS s FROM documents),
k AS (SELECT doc_id, unnest(s) AS s, unnest(range(len(s))) AS k, 2 + doc_id % 2 AS n FROM d),
r AS (SELECT *, (k // {LINES_PER_PAGE})::INT AS page_index, k % {LINES_PER_PAGE} AS slot, k % {LINES_PER_PAGE} % n AS ln, k % {LINES_PER_PAGE} // n AS row FROM k),
f AS (SELECT *, (doc_id % 4 = 0 AND slot % 20 = 19) OR (doc_id % 4 = 1 AND slot = {LINES_PER_PAGE - 1}) AS spans FROM r),
l AS (
  SELECT doc_id AS book_id, page_index, slot AS id, n, row, doc_id % 6 = 3 AS rtl,
         s || CASE WHEN (k * 7 + doc_id) % 5 < 3 THEN '.' ELSE '' END AS text,
         (50 + CASE WHEN spans THEN 0 ELSE ln * 300 + CASE WHEN doc_id % 5 = 0 AND row % 6 = 5 THEN 20 ELSE 0 END END) / 1000.0::DOUBLE AS x,
         (60 + row * 28 + CASE WHEN doc_id % 7 = 0 THEN ln * 4 ELSE 0 END + CASE WHEN spans THEN 12 ELSE 0 END
           + CASE WHEN doc_id % 3 = 2 AND slot >= 3 * {LINES_PER_PAGE} / 4 THEN 60 ELSE 0 END) / 1000.0::DOUBLE AS y,
         CASE WHEN spans THEN 850 ELSE least(230, 40 + length(s) * 3) END / 1000.0::DOUBLE AS w,
         CASE WHEN doc_id % 11 = 0 AND ln = 1 THEN 10 ELSE 15 END / 1000.0::DOUBLE AS h
  FROM f),
g AS (
  SELECT book_id, page_index, n, min(y) AS top, max(y + h) AS bottom,
         list_transform(range(1, n), lambda j: ((j * 300 - 15) / 1000.0::DOUBLE + (j * 300 + 45) / 1000.0::DOUBLE) / 2) AS centers
  FROM l WHERE row < {ROWS_WITH_GUTTER} GROUP BY book_id, page_index, n),
m AS (
  SELECT l.*, top, bottom, len(list_filter(centers, lambda c: x + w / 2 > c)) AS lane, len(list_filter(centers, lambda c: x < c AND x + w > c)) > 0 AS crosses,
         y + h < top + 0.001::DOUBLE AS above, regexp_matches({_trim('text')}, '[.!?。！？]\z') AS ends,
         row_number() OVER (PARTITION BY l.book_id, l.page_index ORDER BY y, x, id) AS pos
  FROM l JOIN g USING (book_id, page_index)),
ys AS (SELECT DISTINCT book_id, page_index, y FROM l),
dy AS (SELECT book_id, page_index, y - lag(y) OVER (PARTITION BY book_id, page_index ORDER BY y) AS d FROM ys),
wide AS (SELECT book_id, page_index, greatest(0.045::DOUBLE, coalesce(list_sort(list(d) FILTER (d > 0.005::DOUBLE))[len(list(d) FILTER (d > 0.005::DOUBLE)) // 2 + 1], 0) * 1.5::DOUBLE) AS wide FROM dy GROUP BY ALL),
below AS (
  SELECT book_id, page_index, y, greatest(bottom, coalesce(max(y + h) OVER (PARTITION BY book_id, page_index ORDER BY y, x, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), bottom)) AS reach
  FROM m WHERE y > bottom),
ended AS (SELECT g.book_id, g.page_index, coalesce(min(reach) FILTER (b.y - reach > wide), 1.0::DOUBLE) AS body_end FROM g JOIN wide USING (book_id, page_index) LEFT JOIN below b USING (book_id, page_index) GROUP BY ALL),
liked AS (
  SELECT m.*, body_end, EXISTS (
    SELECT 1 FROM m q WHERE q.book_id = m.book_id AND q.page_index = m.page_index AND q.lane = m.lane AND q.y >= q.top - 0.001::DOUBLE AND q.y + q.h <= q.bottom + 0.001::DOUBLE
      AND abs(q.x - m.x) <= 0.015::DOUBLE AND least(q.h, m.h) / greatest(q.h, m.h) >= 0.9::DOUBLE) AS likes
  FROM m JOIN ended USING (book_id, page_index)),
crossed AS (SELECT book_id, page_index, min(pos) AS first FROM liked WHERE NOT above AND crosses AND y > bottom AND y <= body_end GROUP BY ALL),
begun AS (
  SELECT a.*, first, EXISTS (
    SELECT 1 FROM liked q WHERE q.book_id = a.book_id AND q.page_index = a.page_index AND q.lane = a.lane AND q.y <= q.bottom AND abs(q.x - a.x) <= 0.015::DOUBLE
      AND CASE WHEN q.above THEN q.likes ELSE NOT q.crosses END) AS begun
  FROM liked a LEFT JOIN crossed USING (book_id, page_index)),
told AS (
  SELECT *, CASE WHEN above THEN CASE WHEN likes THEN 1 ELSE 0 END WHEN y > body_end OR pos >= first THEN 2 WHEN crosses OR (y > bottom AND NOT begun) THEN 3 ELSE 1 END AS kind FROM begun),
each_lane AS (
  SELECT book_id, page_index, lane, count(*) AS c, list_sort(list(h))[count(*) // 2 + 1] AS mh, count_if(ends) AS e, count_if(rtl) AS r FROM told WHERE kind = 1 GROUP BY ALL),
plain AS (
  SELECT book_id, page_index, sum(r) * 2 > sum(c) AS rtl FROM each_lane JOIN g USING (book_id, page_index)
  GROUP BY ALL HAVING count(*) = any_value(n) AND min(c) / max(c) >= 0.35::DOUBLE AND min(mh) / max(mh) >= 0.8::DOUBLE AND min(c) >= 2 AND min(e) >= 2 AND min(e / c) >= 0.3::DOUBLE)
SELECT book_id, page_index, id AS line_id, CASE kind WHEN 0 THEN 0 WHEN 1 THEN CASE WHEN p.rtl THEN n - 1 - lane ELSE lane END + 1 ELSE n + 1 END AS part,
       CASE WHEN kind = 1 THEN lane END AS lane, p.rtl
FROM told JOIN plain p USING (book_id, page_index)
WHERE NOT EXISTS (SELECT 1 FROM told q WHERE q.book_id = told.book_id AND q.page_index = told.page_index AND q.kind = 3)""",
    "effective_edges": """
WITH li AS (SELECT l_orderkey AS page_index, l_linenumber AS id, min(l_partkey) AS p, min(l_suppkey) AS s, min(l_returnflag) AS f FROM lineitem GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER w - 1 AS nth, lead(id) OVER w AS dst, lead(p) OVER w AS dp, lead(s) OVER w AS ds, lead(f) OVER w AS df FROM li WINDOW w AS (PARTITION BY page_index ORDER BY s % 5, id))
SELECT page_index, nth::INT AS nth, id::INT AS src, dst::INT AS dst, 0.9::DOUBLE AS confidence,
       CASE WHEN df = 'R' AND dp % 3 = 0 THEN 'footnotePlacement'
            WHEN p % 5 = 0 AND dst = id + 1 THEN CASE WHEN p % 2 = 0 THEN 'captionAttachment' ELSE 'semanticHint' END
            WHEN (CASE WHEN p % 11 != 0 THEN p % 2 END) IS DISTINCT FROM (CASE WHEN dp % 11 != 0 THEN dp % 2 END) THEN 'regionSequence'
            WHEN dp % 11 != 0 AND dp % 4 = 2 THEN 'sidebarAttachment'
            WHEN p % 11 != 0 AND p % 4 < 2 AND dp % 4 < 2 AND s % 2 != ds % 2 THEN 'columnSequence' ELSE 'sameColumn' END AS reason
FROM o WHERE dst IS NOT NULL""",
    "column_serials": """
WITH c AS (SELECT l_orderkey, l_suppkey % 3 AS k, min(l_linenumber) AS lo, max(l_linenumber) AS hi FROM lineitem GROUP BY 1, 2),
w AS (SELECT l_orderkey, coalesce(lag(hi) OVER o < lo, true) AS up, coalesce(lag(lo) OVER o > hi, true) AS down FROM c WINDOW o AS (PARTITION BY l_orderkey ORDER BY k))
SELECT l_orderkey AS page_index, bool_and(up) OR bool_and(down) AS serial FROM w GROUP BY l_orderkey""",
    "page_clean": f"WITH {_PAGES} SELECT book_id, page_index, text, {_words('text')}::INT AS n_words FROM pages_in",
    "page_dehyphenated": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, string_split(replace(replace(replace(replace(coalesce(text, ''), 'tion', 'ti-' || chr(10) || 'on'), ' the ', ' well-' || chr(10) || 'the '), ' und ', ' zwei-' || chr(10) || 'und-drei '), '. ', '.' || chr(10)), chr(10)) AS l
  FROM documents),
l AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS k FROM d),
b AS (SELECT *, regexp_replace(line, '^[ \t\p{Zs}]+|[ \t\p{Zs}]+$', '', 'g') AS bare FROM l),
f AS (
  SELECT doc_id, k, line AS now, '' AS done FROM b WHERE k = 1
  UNION ALL
  SELECT doc_id, k, CASE WHEN NOT joins THEN line
                         WHEN contains(word, '-') OR list_contains(['self', 'well', 'state', 'high', 'low', 'long', 'short', 'full', 'part', 'cross', 'half'], stem)
                           OR list_contains(['a', 'an', 'and', 'as', 'at', 'be', 'been', 'being', 'by', 'for', 'from', 'in', 'is', 'of', 'on', 'or', 'the', 'to', 'was', 'were', 'with'], word) THEN x || bare
                         ELSE x[1:length(x) - 1] || bare END,
         CASE WHEN joins THEN done ELSE done || now || chr(10) END
  FROM (
    SELECT *, lower(regexp_extract(x, '(\p{L}*)-$', 1)) AS stem, lower(regexp_extract(bare, '^[\p{L}-]*')) AS word,
           x LIKE '%-' AND length(regexp_extract(x, '(\p{L}*)-$', 1)) >= 2 AND regexp_matches(bare, '^\p{Ll}')
             AND NOT regexp_matches(x, '^\s*([-*•]|[0-9]+[.)]|[A-Za-z][.)])\s+') AND NOT regexp_matches(bare, '^\s*([-*•]|[0-9]+[.)]|[A-Za-z][.)])\s+')
             AND NOT (len(regexp_extract_all(x, '\p{L}')) >= 4 AND NOT regexp_matches(x, '\p{Ll}')) AS joins
    FROM (SELECT b.doc_id, b.k, b.line, b.bare, now, done, regexp_replace(now, '^[ \t\p{Zs}]+|[ \t\p{Zs}]+$', '', 'g') AS x FROM f JOIN b ON b.doc_id = f.doc_id AND b.k = f.k + 1)))
SELECT f.doc_id, done || now AS text FROM f JOIN d ON d.doc_id = f.doc_id AND f.k = len(d.l)""",
    "quality_policy": rf"""
WITH v AS (
  SELECT doc_id, coalesce(text, '') AS ocr, unnest([text, '', 'Short text', repeat(chr(65533), 20), '@@@ ### $$$ %%% !!!', text[1:60]]) AS native,
         unnest(range(6))::INT AS variant FROM documents),
c AS (SELECT *, len(regexp_extract_all(native, '{_NW}'))::DOUBLE AS visible, {_counts('native')} AS alnum, {_counts('ocr')} AS got,
             len(regexp_extract_all(native, '[\x{{FFFD}}\x00-\x08\x0E-\x1F\x7F-\x{{84}}\x{{86}}-\x{{9F}}\p{{Cf}}]')) AS odd FROM v),
q AS (SELECT *, {_QUALITY} AS quality FROM c)
SELECT doc_id, variant, quality, quality != 'usable' AS asks,
       got > 0 AND CASE quality WHEN 'empty' THEN true WHEN 'insufficient' THEN got >= greatest(3, floor(alnum * 0.8))
         WHEN 'suspicious' THEN got >= greatest(3, floor(alnum * 0.6)) ELSE got >= alnum + greatest(12, alnum // 4) END AS prefers
FROM q""",
    "source_selection": rf"""
WITH p AS (
  SELECT conv_id AS book_id, turn::INT AS page_index, CASE WHEN turn % 2 = 0 THEN coalesce(text, '') ELSE '' END AS native,
         'scan ' || coalesce(text, '') AS ocr, turn / 10.0::DOUBLE AS conf FROM conversations),
c AS (SELECT *, len(regexp_extract_all(native, '{_NW}'))::DOUBLE AS visible, {_counts('native')} AS alnum, {_counts('ocr')} AS got FROM p),
q AS (SELECT *, CASE WHEN visible = 0 THEN 'empty' WHEN visible >= 12 AND alnum / visible < 0.45 THEN 'suspicious'
                     WHEN length_grapheme({_trim('native')}) < 20 THEN 'insufficient' ELSE 'usable' END AS quality FROM c),
w AS (SELECT *, got > 0 AND CASE quality WHEN 'empty' THEN conf >= 0.05 WHEN 'insufficient' THEN conf >= 0.2 AND got >= greatest(3, floor(alnum * 0.8))
         WHEN 'suspicious' THEN conf >= 0.2 AND got >= greatest(3, floor(alnum * 0.6)) ELSE false END AS wins FROM q)
SELECT book_id, page_index, CASE WHEN wins THEN ocr WHEN visible > 0 THEN native ELSE '' END AS text,
       CASE WHEN wins THEN 'ocr' WHEN visible > 0 THEN 'native' ELSE 'empty' END AS extraction_source,
       CASE WHEN wins THEN least(1, conf) WHEN visible > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS confidence FROM w""",
    "recognized_text": """
SELECT doc_id, coalesce(text, '') AS ocr_text, round(list_avg([(length(x) % 8) / 8.0::DOUBLE for x in string_split(coalesce(text, ''), chr(10))]), 9) AS ocr_confidence FROM documents""",
    "scanned": rf"""
WITH p AS (SELECT conv_id AS book_id, turn, CASE WHEN turn > 2 THEN coalesce(text, '') ELSE 'x' END AS x FROM conversations),
s AS (SELECT book_id, x, row_number() OVER (PARTITION BY book_id ORDER BY turn) - 1 AS nth, greatest(1, count(*) OVER (PARTITION BY book_id) // 5) AS step FROM p)
SELECT book_id, avg((length_grapheme({_trim('x')}) < 30)::INT) >= 0.6 AS is_scanned
FROM s WHERE nth % step = 0 AND nth // step < 5 GROUP BY book_id""",
    "edge_lines": f"WITH {_PAGES}, {_EDGES} SELECT * FROM edges",
    "book_cleanup": rf"""
WITH {_PAGES}, {_EDGES}, {_GONE},
kept AS (SELECT l.* FROM all_lines l ANTI JOIN gone g ON g.book_id = l.book_id AND g.page_index = l.page_index AND g.line_index = l.line_index),
rest AS (SELECT book_id, page_index, {_final("string_agg(line, chr(10) ORDER BY line_index)")} AS text FROM kept GROUP BY book_id, page_index),
touched AS (SELECT DISTINCT book_id, page_index FROM gone),
out AS (SELECT p.*, t.book_id IS NOT NULL AS cut, CASE WHEN t.book_id IS NULL THEN p.text ELSE coalesce(r.text, '') END AS now
        FROM pages_in p LEFT JOIN touched t ON t.book_id = p.book_id AND t.page_index = p.page_index LEFT JOIN rest r ON r.book_id = p.book_id AND r.page_index = p.page_index)
SELECT book_id, page_index, now AS text, CASE WHEN cut AND now = '' THEN 'empty' ELSE extraction_source END AS extraction_source,
       CASE WHEN cut AND now = '' THEN 0.0 ELSE confidence END AS confidence FROM out""",
    "chapters_by_heading": rf"""
WITH {_PAGES}, heads AS (SELECT book_id, page_index, list_filter(string_split(text, chr(10))[1:4], lambda x: regexp_matches({_trim('x')}, '{t.CHAPTER_HEADING}') AND length_grapheme({_trim('x')}) BETWEEN 4 AND 119) AS h FROM pages_in),
starts AS (SELECT book_id, page_index, {_trim('h[1]')} AS title FROM heads WHERE len(h) > 0), {_CHAPTERS}
SELECT *, false AS is_ocr_sourced FROM ({_CHAPTER_ROWS})""",
    "chapters_by_outline": rf"""
WITH {_PAGES}, items AS (
  SELECT book_id, page_index AS source_order, 'Part ' || page_index AS title, page_index, CASE WHEN page_index % 8 = 0 THEN 0 ELSE 1 END AS level
  FROM pages_in WHERE page_index % 4 = 0 AND page_index != 12),
levels AS (SELECT book_id, level, count(DISTINCT page_index) AS n FROM items GROUP BY book_id, level),
chosen AS (SELECT book_id, arg_min(level, CASE WHEN n >= 2 THEN 0 ELSE 2 END * 10 + level) AS level FROM levels GROUP BY book_id),
starts AS (SELECT i.book_id, i.page_index, i.title FROM items i JOIN chosen c ON c.book_id = i.book_id AND c.level = i.level), {_CHAPTERS}
{_CHAPTER_ROWS}""",
    "chapters_by_bucket": rf"""
WITH {_TURNS}, heads AS (SELECT book_id, page_index, list_filter(string_split(text, chr(10))[1:4], lambda x: regexp_matches({_trim('x')}, '{t.CHAPTER_HEADING}') AND length_grapheme({_trim('x')}) BETWEEN 4 AND 119) AS h FROM pages_in),
numbered AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY page_index) - 1 AS nth FROM pages_in),
starts AS (SELECT book_id, page_index, '' AS title FROM numbered WHERE nth % 25 = 0), {_CHAPTERS}, named AS ({_CHAPTER_ROWS})
SELECT book_id, chapter_order, CASE WHEN chapter_order = 0 THEN 'Beginning' ELSE 'Section ' || (chapter_order + 1) END AS title, page_lo, page_hi, plain_text FROM named""",
    "book_statistics": rf"""
WITH {_PAGES}, n AS (SELECT book_id, count(*) AS n_pages, sum({_words('text')})::BIGINT AS total_words, count_if(extraction_source = 'empty') AS empty_pages FROM pages_in GROUP BY book_id)
SELECT book_id, n_pages, total_words, CASE WHEN total_words = 0 THEN 0 ELSE greatest(1, total_words // 220) END AS reading_minutes, 0::BIGINT AS ocr_pages, empty_pages::BIGINT AS empty_pages FROM n""",
    "book_text": f"WITH {_TURNS} SELECT book_id, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY page_index) FILTER (regexp_matches(text, '{_NW}')), '') AS text FROM pages_in GROUP BY book_id",
    "latest_turns": "SELECT conv_id AS book_id, (turn // 2)::INT AS page_index, arg_max(coalesce(text, ''), turn) AS native_text FROM conversations GROUP BY 1, 2",
    "book_metadata": "SELECT s_suppkey, s_name AS title, 'A. One|B. Two|' AS authors, 0::BIGINT AS n_keywords, 'A. One, B. Two, ' AS author_line FROM supplier",
    "outline_walk": """
WITH i AS (
  SELECT 'r' || r_regionkey AS id, NULL AS parent_id, 0 AS level, 'outline:' || r_regionkey AS path, r_name AS title, NULL::INT AS page_index, r_regionkey AS a, -1 AS b FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 1, 'outline:' || n_regionkey || '/' || n_nationkey, 'Untitled', n_nationkey::INT, n_regionkey, n_nationkey FROM nation)
SELECT id, parent_id, level, path, title, page_index, row_number() OVER (ORDER BY a, b) - 1 AS source_order FROM i""",
    "line_signatures": f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10)))))::INT AS line_index FROM documents)
SELECT doc_id, line_index, {_signature('line')} AS signature, {_words('line')}::INT AS n_words, {_counts('line')}::INT AS n_alnum FROM l""",
    "page_numbers": f"""
WITH lines_in AS (
  SELECT doc_id, unnest(['Page ' || doc_id, doc_id || ' of 99999', 'Some Book • ' || doc_id, 'ÉTÉ – ' || doc_id, 'iv', '1234567' || doc_id, text]) AS line, unnest(range(7))::INT AS kind FROM documents)
SELECT doc_id, kind, number, template, pure FROM ({_NUMBER})""",
    "stable_ids": """
WITH p AS (SELECT conv_id, turn, [conv_id::VARCHAR, turn::VARCHAR, coalesce(role, '')] AS c FROM conversations),
b AS (SELECT conv_id, turn, flatten([list_concat([ord(z)::UHUGEINT for z in string_split(length(x)::VARCHAR || ':' || x, '')], [255::UHUGEINT]) for x in c]) AS bytes FROM p)
SELECT conv_id, turn, 'page-' || lower(printf('%x', list_reduce(list_prepend(14695981039346656037::UHUGEINT, bytes),
  lambda h, x: ((h - h % 256 + xor((h % 256)::INT, x::INT)::UHUGEINT) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT)) AS id FROM b""",
    "table_rows": "SELECT o_orderkey, o_orderkey || '. ' || o_orderstatus || '. ' || o_orderpriority || '.' AS row_major, 'Order: ' || o_orderkey || '. ' || o_orderstatus || '. Priority: ' || o_orderpriority || '.' AS with_headers FROM orders",
    "rect_unions": f"""
WITH {_RECTS}
SELECT l_orderkey, count(*) AS n, round(min(x), 6) AS x, round(min(y), 6) AS y, round(max(x + w) - min(x), 6) AS w, round(max(y + h) - min(y), 6) AS h,
       round(median(h), 6) AS median_h, round(list_sort(list(h))[len(list(h)) // 2 + 1], 6) AS upper_h, round(list_sort(list(h))[(len(list(h)) - 1) // 2 + 1], 6) AS lower_h
FROM rects GROUP BY l_orderkey""",
    "rect_conflicts": f"""
WITH {_RECTS}, p AS (
  SELECT a.l_orderkey, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) / least(a.w * a.h, b.w * b.h) AS s
  FROM rects a JOIN rects b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber)
SELECT l_orderkey, count(*) AS pairs, count_if(s >= 0.65)::BIGINT AS conflicts, round(max(s), 6) AS largest FROM p GROUP BY l_orderkey""",
    "rect_normalized": """
WITH r AS (SELECT l_orderkey, l_linenumber, (l_linenumber * 90) % 360 AS turn,
    least(1, greatest(0, (l_partkey % 700 - 10) / 600.0::DOUBLE)) AS ax, least(1, greatest(0, (l_partkey % 700 + 40) / 600.0::DOUBLE)) AS bx,
    least(1, greatest(0, (l_suppkey % 900 - 20) / 800.0::DOUBLE)) AS ay, least(1, greatest(0, (l_suppkey % 900 - 8) / 800.0::DOUBLE)) AS b_y FROM lineitem)
SELECT l_orderkey, l_linenumber,
       round(CASE turn WHEN 90 THEN ay WHEN 180 THEN 1 - bx WHEN 270 THEN 1 - b_y ELSE ax END, 9) AS x,
       round(CASE turn WHEN 90 THEN ax WHEN 180 THEN ay WHEN 270 THEN 1 - bx ELSE 1 - b_y END, 9) AS y,
       round(CASE WHEN turn IN (90, 270) THEN b_y - ay ELSE bx - ax END, 9) AS w, round(CASE WHEN turn IN (90, 270) THEN bx - ax ELSE b_y - ay END, 9) AS h
FROM r""",
    "block_neighbours": f"""
WITH {_BLOCKS}, p AS (
  SELECT a.l_orderkey AS page_index, a.id AS block_id, a.y AS ay, a.y + a.h AS aend, b.id AS other, b.x AS bx, b.y AS b_y, b.y + b.h AS bend,
         a.id % 3 = 0 AS is_caption, b.id % 3 != 0 AND least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) > 0 AS fits,
         CASE WHEN b.y + b.h <= a.y THEN a.y - (b.y + b.h) WHEN a.y + a.h <= b.y THEN b.y - (a.y + a.h) ELSE 0.0::DOUBLE END + abs((a.x + a.w / 2) - (b.x + b.w / 2)) * 0.25::DOUBLE AS far
  FROM blocks a LEFT JOIN blocks b ON a.l_orderkey = b.l_orderkey AND a.id != b.id)
SELECT page_index, block_id, round(coalesce(min(ay - bend) FILTER (ay - bend >= 0), any_value(ay)), 9) AS before,
       round(coalesce(min(b_y - aend) FILTER (b_y - aend >= 0), greatest(0.0::DOUBLE, 1 - any_value(aend))), 9) AS after,
       arg_min(other, (b_y, bx, other)) FILTER (b_y >= aend - 0.005::DOUBLE) AS next_block,
       arg_min(other, (far, other)) FILTER (is_caption AND fits) AS anchor
FROM p GROUP BY page_index, block_id""",
    "block_rows": f"""
WITH RECURSIVE {_BLOCKS},
hs AS (SELECT l_orderkey AS page_index, list_sort(list(h)) AS hs FROM blocks GROUP BY 1),
items AS (
  SELECT b.l_orderkey AS page_index, id, x, w, y + h / 2 AS v, (hs[(len(hs) - 1) // 2 + 1] + hs[len(hs) // 2 + 1]) / 2 AS mid
  FROM blocks b JOIN hs ON hs.page_index = b.l_orderkey),
by_y AS (SELECT *, greatest(0.014::DOUBLE, least(0.035::DOUBLE, mid * 0.8::DOUBLE)) AS tol, row_number() OVER (PARTITION BY page_index ORDER BY v, id) AS k FROM items),
by_x AS (SELECT page_index, x AS v, greatest(0.014::DOUBLE, least(0.035::DOUBLE, mid * 0.85::DOUBLE)) AS tol, row_number() OVER (PARTITION BY page_index ORDER BY x, id) AS k FROM items),
cy AS (
  SELECT page_index, k, v AS center, 1 AS n, 1 AS cluster FROM by_y WHERE k = 1
  UNION ALL
  SELECT s.page_index, s.k, CASE WHEN abs(c.center - s.v) <= s.tol THEN (c.center * c.n + s.v) / (c.n + 1) ELSE s.v END,
         CASE WHEN abs(c.center - s.v) <= s.tol THEN c.n + 1 ELSE 1 END, CASE WHEN abs(c.center - s.v) <= s.tol THEN c.cluster ELSE c.cluster + 1 END
  FROM cy c JOIN by_y s ON s.page_index = c.page_index AND s.k = c.k + 1),
cx AS (
  SELECT page_index, k, v AS center, 1 AS n, 1 AS cluster FROM by_x WHERE k = 1
  UNION ALL
  SELECT s.page_index, s.k, CASE WHEN abs(c.center - s.v) <= s.tol THEN (c.center * c.n + s.v) / (c.n + 1) ELSE s.v END,
         CASE WHEN abs(c.center - s.v) <= s.tol THEN c.n + 1 ELSE 1 END, CASE WHEN abs(c.center - s.v) <= s.tol THEN c.cluster ELSE c.cluster + 1 END
  FROM cx c JOIN by_x s ON s.page_index = c.page_index AND s.k = c.k + 1),
gaps AS (SELECT s.page_index, cluster, x - lag(x + w) OVER (PARTITION BY s.page_index, cluster ORDER BY x, id) AS gap FROM by_y s JOIN cy ON cy.page_index = s.page_index AND cy.k = s.k),
r AS (SELECT page_index, cluster, count(*) AS n, coalesce(bool_or(gap >= 0.035::DOUBLE), false) AS wide, coalesce(list_sort(list(gap) FILTER (gap > 0)), []) AS open FROM gaps GROUP BY page_index, cluster),
edges AS (SELECT page_index, max(cluster) AS left_edges FROM cx GROUP BY page_index)
SELECT r.page_index, count(*)::INT AS n_rows, count_if(wide)::INT AS side_by_side, count_if(n >= 2)::INT AS aligned,
       count_if(n >= 3 AND len(open) > 0 AND (open[(len(open) - 1) // 2 + 1] + open[len(open) // 2 + 1]) / 2 <= 0.03::DOUBLE)::INT AS tight,
       max(n)::INT AS most_items, count_if(n = 1)::INT AS single_rows, any_value(left_edges)::INT AS left_edges
FROM r JOIN edges ON edges.page_index = r.page_index GROUP BY r.page_index""",
    "page_gutters": f"""
WITH RECURSIVE {_FRAGMENTS},
l AS (SELECT page_index, x, y, w, h, row_number() OVER (PARTITION BY page_index ORDER BY y, x, fragment_id) AS pos FROM fragments),
p AS (
  SELECT a.page_index, a.pos AS one, b.pos AS two, CASE WHEN a.x < b.x THEN a ELSE b END AS a, CASE WHEN a.x < b.x THEN b ELSE a END AS b
  FROM l a JOIN l b ON a.page_index = b.page_index AND a.pos < b.pos AND b.y <= a.y + a.h AND least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) > least(a.h, b.h) * 0.5::DOUBLE),
q AS (
  SELECT page_index, one, row_number() OVER (PARTITION BY page_index ORDER BY one, two) AS k, a.x + a.w AS lo, b.x AS hi, least(a.y, b.y) AS top, greatest(a.y + a.h, b.y + b.h) AS low
  FROM p WHERE b.x - (a.x + a.w) >= 0.015::DOUBLE AND NOT EXISTS (
    SELECT 1 FROM l m WHERE m.page_index = p.page_index AND m.x > p.a.x AND m.x < p.b.x AND m.y + m.h > greatest(p.a.y, p.b.y) AND m.y < least(p.a.y + p.a.h, p.b.y + p.b.h))),
f AS (
  SELECT page_index, 1::BIGINT AS k, [lo] AS los, [hi] AS his, 1::BIGINT AS hit FROM q WHERE k = 1
  UNION ALL
  SELECT page_index, k, CASE WHEN hit > len(los) THEN list_append(los, lo) ELSE list_transform(range(1, len(los) + 1), lambda i: CASE WHEN i = hit THEN greatest(los[i], lo) ELSE los[i] END) END,
         CASE WHEN hit > len(his) THEN list_append(his, hi) ELSE list_transform(range(1, len(his) + 1), lambda i: CASE WHEN i = hit THEN least(his[i], hi) ELSE his[i] END) END, hit
  FROM (SELECT q.page_index, q.k, los, his, lo, hi,
               coalesce(list_filter(range(1, len(los) + 1), lambda i: least(his[i], q.hi) - greatest(los[i], q.lo) >= 0.015::DOUBLE)[1], len(los) + 1) AS hit
        FROM f JOIN q ON q.page_index = f.page_index AND q.k = f.k + 1))
SELECT q.page_index, round(max(lo), 6) AS min_x, round(min(hi), 6) AS max_x, round(min(top), 6) AS y_lo, round(max(low), 6) AS y_hi
FROM q JOIN f ON f.page_index = q.page_index AND f.k = q.k GROUP BY q.page_index, f.hit""",
    "page_complexity": f"""
WITH RECURSIVE {_FRAGMENTS},
fr AS (
  SELECT page_index, row_number() OVER (PARTITION BY page_index ORDER BY fragment_id) - 1 AS i, x, y, w, h, text, CASE WHEN l_suppkey % 5 = 0 THEN 14.0 ELSE 10.0 END::DOUBLE AS font_size, l_suppkey % 7 = 0 AS bold
  FROM fragments JOIN numbered ON l_orderkey = page_index AND nth = fragment_id),
ls AS (SELECT page_index, count(*) AS n, list_sort(list(h)) AS hs, list_sort(list(w)) AS ws, list_sort(list(font_size)) AS fs, count_if(length(replace(text, ' ', '')) <= 22) / count(*) AS short_share FROM fr GROUP BY page_index),
pg AS (
  SELECT page_index, n, short_share, 0.5::DOUBLE * hs[(n - 1) // 2 + 1] + 0.5::DOUBLE * hs[n // 2 + 1] AS median_h, 0.5::DOUBLE * ws[(n - 1) // 2 + 1] + 0.5::DOUBLE * ws[n // 2 + 1] AS median_w,
         0.5::DOUBLE * fs[(n - 1) // 2 + 1] + 0.5::DOUBLE * fs[n // 2 + 1] AS font FROM ls),
by_x AS (SELECT fr.page_index, i, x AS v, greatest(0.014::DOUBLE, least(0.035::DOUBLE, median_h * 0.85::DOUBLE)) AS tol, row_number() OVER (PARTITION BY fr.page_index ORDER BY x, i) AS k FROM fr JOIN pg USING (page_index)),
by_y AS (SELECT fr.page_index, i, y + h / 2 AS v, greatest(0.014::DOUBLE, least(0.035::DOUBLE, median_h * 0.8::DOUBLE)) AS tol, row_number() OVER (PARTITION BY fr.page_index ORDER BY y + h / 2, i) AS k FROM fr JOIN pg USING (page_index)),
cx AS (
  SELECT page_index, k, i, v AS center, 1 AS n, 1 AS cluster FROM by_x WHERE k = 1
  UNION ALL
  SELECT s.page_index, s.k, s.i, CASE WHEN abs(c.center - s.v) <= s.tol THEN (c.center * c.n + s.v) / (c.n + 1) ELSE s.v END,
         CASE WHEN abs(c.center - s.v) <= s.tol THEN c.n + 1 ELSE 1 END, CASE WHEN abs(c.center - s.v) <= s.tol THEN c.cluster ELSE c.cluster + 1 END
  FROM cx c JOIN by_x s ON s.page_index = c.page_index AND s.k = c.k + 1),
cy AS (
  SELECT page_index, k, i, v AS center, 1 AS n, 1 AS cluster FROM by_y WHERE k = 1
  UNION ALL
  SELECT s.page_index, s.k, s.i, CASE WHEN abs(c.center - s.v) <= s.tol THEN (c.center * c.n + s.v) / (c.n + 1) ELSE s.v END,
         CASE WHEN abs(c.center - s.v) <= s.tol THEN c.n + 1 ELSE 1 END, CASE WHEN abs(c.center - s.v) <= s.tol THEN c.cluster ELSE c.cluster + 1 END
  FROM cy c JOIN by_y s ON s.page_index = c.page_index AND s.k = c.k + 1),
edges AS (SELECT page_index, cluster, count(*) AS c, arg_max(center, k) AS center, list_sort(list(x + w)) AS rs, list_sort(list(x)) AS xs FROM cx JOIN fr USING (page_index, i) GROUP BY page_index, cluster),
lanes AS (
  SELECT e.page_index, cluster, center, (rs[(c - 1) // 2 + 1] + rs[c // 2 + 1]) / 2 AS r, (xs[(c - 1) // 2 + 1] + xs[c // 2 + 1]) / 2 AS l
  FROM edges e JOIN pg USING (page_index) WHERE c >= greatest(2, ceil(n * 0.18::DOUBLE))),
between_ AS (SELECT page_index, lo, hi FROM (SELECT page_index, r AS lo, lead(l) OVER (PARTITION BY page_index ORDER BY cluster) AS hi FROM lanes) WHERE hi IS NOT NULL),
gaps AS (SELECT cy.page_index, cluster, cy.k, i, x - lag(x + w) OVER (PARTITION BY cy.page_index, cluster ORDER BY x, i) AS gap FROM cy JOIN fr USING (page_index, i)),
rw AS (SELECT page_index, cluster AS at_row, count(*) AS c, arg_min(i, k) AS first, coalesce(bool_or(gap >= 0.035::DOUBLE), false) AS wide, coalesce(list_sort(list(gap) FILTER (gap > 0)), []) AS open FROM gaps GROUP BY page_index, cluster),
per AS (
  SELECT page_index, count_if(wide) AS side_by_side, count_if(c >= 2) AS aligned, max(c) AS most_items, count_if(c = 1) AS single_rows, min(at_row) FILTER (wide) AS a, max(at_row) FILTER (wide) AS z,
         count_if(c >= 3 AND len(open) > 0 AND (open[(len(open) - 1) // 2 + 1] + open[len(open) // 2 + 1]) / 2 <= 0.03::DOUBLE) AS tight FROM rw GROUP BY page_index),
singles AS (
  SELECT rw.page_index, at_row, (median_w > 0 AND w >= median_w * 1.3::DOUBLE) OR bold OR (font > 0 AND font_size >= font * 1.22::DOUBLE) OR EXISTS (
    SELECT 1 FROM between_ g WHERE g.page_index = rw.page_index AND hi - lo >= 0.015::DOUBLE AND x <= lo + (hi - lo) * 0.35::DOUBLE AND x + w >= hi - (hi - lo) * 0.35::DOUBLE) AS strong
  FROM rw JOIN fr ON fr.page_index = rw.page_index AND fr.i = rw.first JOIN pg ON pg.page_index = rw.page_index WHERE c = 1),
placed AS (SELECT s.page_index, bool_or(at_row < a) AS ahead, bool_or(at_row > z) AS behind, bool_or(at_row > a AND at_row < z) AS inside, bool_or(strong) AS strong FROM singles s JOIN per USING (page_index) GROUP BY s.page_index),
nl AS (SELECT page_index, count(*) AS dominant_lanes, min(cluster) AS only_one, min(center) AS center FROM lanes GROUP BY page_index),
body AS (SELECT cx.page_index, min(y) AS top, max(y + h) AS low FROM cx JOIN nl ON nl.page_index = cx.page_index AND cx.cluster = only_one JOIN fr ON fr.page_index = cx.page_index AND fr.i = cx.i WHERE dominant_lanes = 1 GROUP BY cx.page_index),
sided AS (
  SELECT b.page_index FROM body b JOIN nl USING (page_index) JOIN cx USING (page_index) JOIN fr ON fr.page_index = b.page_index AND fr.i = cx.i
  WHERE cx.cluster != only_one AND abs(x - nl.center) >= 0.14::DOUBLE AND y + h / 2 >= top - 0.02::DOUBLE AND y + h / 2 <= low + 0.02::DOUBLE GROUP BY b.page_index),
strips AS (SELECT DISTINCT page_index, unnest(range(least(63, floor(x * 64)::INT), least(63, floor(greatest(x, x + w - 0.000001::DOUBLE) * 64)::INT) + 1)) AS strip FROM fr),
steps AS (SELECT page_index, strip - lag(strip) OVER (PARTITION BY page_index ORDER BY strip) - 1 AS empty FROM strips),
ig AS (SELECT page_index, coalesce(max(empty), 0) / 64.0::DOUBLE AS interior_gap FROM steps GROUP BY page_index),
lg AS (SELECT page_index, greatest(0, max(hi - lo)) AS lane_gap FROM between_ GROUP BY page_index),
le AS (SELECT page_index, max(cluster) AS left_edges FROM cx GROUP BY page_index),
ft AS (
  SELECT page_index, n AS n_fragments, left_edges, coalesce(dominant_lanes, 0) AS dominant_lanes, side_by_side, aligned, most_items, single_rows, interior_gap, coalesce(lane_gap, 0) AS lane_gap, median_w, median_h, short_share, tight,
         sided.page_index IS NOT NULL AS side_lane,
         coalesce(dominant_lanes >= 2 AND side_by_side > 0 AND single_rows > 0 AND (inside OR (ahead AND behind) OR ((ahead OR behind) AND strong)), false) AS mixed_bands
  FROM pg JOIN per USING (page_index) JOIN le USING (page_index) JOIN ig USING (page_index) LEFT JOIN nl USING (page_index) LEFT JOIN lg USING (page_index) LEFT JOIN placed USING (page_index) LEFT JOIN sided USING (page_index)),
vd AS (
  SELECT *, CASE WHEN (aligned >= 2 AND dominant_lanes >= 2 AND short_share >= 0.72::DOUBLE AND median_w <= 0.22::DOUBLE) OR (tight >= 2 AND most_items >= 3 AND dominant_lanes >= 3) THEN 'likelyTableHeavy'
                 WHEN mixed_bands AND dominant_lanes >= 2 AND aligned >= 2 AND lane_gap >= 0.015::DOUBLE THEN 'mixedRegions'
                 WHEN dominant_lanes >= 2 AND lane_gap >= 0.025::DOUBLE THEN 'likelyMultiColumn' WHEN side_lane THEN 'irregularPositioned'
                 WHEN dominant_lanes <= 1 AND side_by_side <= 1 THEN 'simpleSingleColumn' ELSE 'unknown' END AS complexity FROM ft),
cf AS (
  SELECT *, least(1, CASE complexity
    WHEN 'likelyTableHeavy' THEN 0.74::DOUBLE + least(0.1::DOUBLE, aligned * 0.02::DOUBLE) + CASE WHEN most_items >= 3 THEN 0.08::DOUBLE ELSE 0 END + CASE WHEN short_share >= 0.9::DOUBLE THEN 0.04::DOUBLE ELSE 0 END
    WHEN 'mixedRegions' THEN 0.74::DOUBLE + least(0.1::DOUBLE, aligned * 0.02::DOUBLE) + least(0.08::DOUBLE, (dominant_lanes - 1) * 0.04::DOUBLE) + least(0.06::DOUBLE, lane_gap * 0.35::DOUBLE)
    WHEN 'likelyMultiColumn' THEN 0.68::DOUBLE + least(0.14::DOUBLE, aligned * 0.025::DOUBLE) + least(0.1::DOUBLE, (dominant_lanes - 1) * 0.05::DOUBLE) + least(0.08::DOUBLE, lane_gap * 0.4::DOUBLE)
    WHEN 'irregularPositioned' THEN 0.68::DOUBLE + least(0.12::DOUBLE, (left_edges - 1) * 0.04::DOUBLE)
    WHEN 'simpleSingleColumn' THEN CASE WHEN left_edges <= 2 THEN 0.94::DOUBLE ELSE 0.86::DOUBLE END ELSE 0.45::DOUBLE END) AS confidence FROM vd)
SELECT page_index, n_fragments::INT AS n_fragments, left_edges::INT AS left_edges, dominant_lanes::INT AS dominant_lanes, side_by_side::INT AS side_by_side, aligned::INT AS aligned, most_items::INT AS most_items, single_rows::INT AS single_rows,
       round(interior_gap, 6) AS interior_gap, round(lane_gap, 6) AS lane_gap, round(median_w, 6) AS median_w, round(median_h, 6) AS median_h, round(short_share, 6) AS short_share, side_lane, mixed_bands,
       complexity, round(confidence, 6) AS confidence, complexity NOT IN ('simpleSingleColumn', 'unknown') AND confidence >= 0.62::DOUBLE AS analyzes
FROM cf""",
    "block_backtracks": f"""
WITH {_BLOCKS}, w AS (
  SELECT l_orderkey, x, y, w, lead(x) OVER o AS nx, lead(y) OVER o AS ny, lead(w) OVER o AS nw, median(h) OVER (PARTITION BY l_orderkey) AS m
  FROM blocks WINDOW o AS (PARTITION BY l_orderkey ORDER BY -id))
SELECT l_orderkey AS page_index, bool_or(coalesce(y - ny >= greatest(0.035::DOUBLE, least(0.1::DOUBLE, m * 1.8::DOUBLE))
  AND (greatest(0, least(x + w, nx + nw) - greatest(x, nx)) / least(w, nw) >= 0.3::DOUBLE OR abs((x + w / 2) - (nx + nw / 2)) <= 0.2::DOUBLE), false)) AS needs_repair
FROM w GROUP BY l_orderkey""",
    "reading_edges": """
WITH e AS (SELECT l_partkey % 100 AS src, l_suppkey % 100 AS dst, l_linenumber / 8.0::DOUBLE AS confidence, l_returnflag AS reason FROM lineitem)
SELECT src, dst, max(confidence) AS confidence, arg_min(reason, (-confidence, reason)) AS reason FROM e WHERE src != dst GROUP BY src, dst""",
    "text_similarity": rf"""
WITH p AS (SELECT item_id, lower({_trim(f"regexp_replace(text, '{_W}+', ' ', 'g')")}) AS a, lower({_trim(f"regexp_replace('The  ' || text[3:], '{_W}+', ' ', 'g')")}) AS b FROM benchmark)
SELECT item_id, round(CASE WHEN a = b THEN 1.0 WHEN greatest(length(a), length(b)) > 512 THEN 0.0 ELSE 1 - levenshtein(a, b) / greatest(length(a), length(b))::DOUBLE END, 9) AS similarity FROM p""",
}


def _html_sql() -> str:
    def esc(x: str) -> str:
        for a, b in t.HTML_ESCAPES:
            x = f"replace({x}, '{a.replace(chr(39), chr(39) * 2)}', '{b}')"
        return x

    body = f"replace(replace({esc(chr(99) + 'oalesce(html, ' + chr(39) * 2 + ')')}, chr(10) || chr(10), '</p><p>'), chr(10), '<br>')"
    return f"SELECT page_id, '{t.HTML_HEAD}' || {esc('coalesce(url, ' + chr(39) * 2 + ')')} || '</h1><p>' || {body} || '</p></body></html>' AS preview FROM pages"


SQL["html_pages"] = _html_sql()


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
