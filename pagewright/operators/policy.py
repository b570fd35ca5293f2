"""Which text of a page counts: its own or a recognised one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.config import OcrConfig
from pagewright.functions.geometry import clamp
from pagewright.functions.text import alnum_count, at_most_graphemes, is_blank, let, trim, visible_count

#: Characters that a decoder leaves where it fails: the replacement character, controls that aren't white space, formats.
ODD = r"[\x{FFFD}\x00-\x08\x0E-\x1F\x7F-\x{84}\x{86}-\x{9F}\p{Cf}]"


def native_quality(text: Column, threshold: int) -> Column:
    """empty, suspicious, insufficient or usable; looked at in this order, after trimming."""

    def judged(m: Column) -> Column:
        return (
            F.when(m["visible"] == 0, "empty")
            .when((m["odd"] / m["visible"] > 0.02) | ((m["visible"] >= max(12, threshold // 2)) & (m["alnum"] / m["visible"] < 0.45)), "suspicious")
            .when(m["short"], "insufficient")
            .otherwise("usable")
        )

    def measured(t: Column) -> Column:
        odd = F.regexp_count(t, F.lit(ODD))
        short = at_most_graphemes(t, threshold - 1) if threshold > 0 else F.lit(False)
        return F.struct(visible_count(t).alias("visible"), odd.alias("odd"), alnum_count(t).alias("alnum"), short.alias("short"))

    return let(let(trim(F.coalesce(text, F.lit(""))), measured), judged)


def should_recognize(text: Column, config: OcrConfig, quality: Column | None = None) -> Column:
    """``quality`` is that of the text, where it is known already."""
    if config.mode != "auto":
        return F.lit(config.mode == "always")
    return (native_quality(text, config.native_text_threshold) if quality is None else quality) != "usable"


def prefers_recognized(recognized: Column, confidence: Column, native: Column, config: OcrConfig, quality: Column | None = None) -> Column:
    """Whether recognised text beats a page's own; what it takes depends on the quality of the latter."""
    conf = clamp(F.coalesce(confidence, F.lit(0.0)))
    facts = F.struct((native_quality(native, config.native_text_threshold) if quality is None else quality).alias("quality"), alnum_count(F.coalesce(recognized, F.lit(""))).alias("got"), alnum_count(F.coalesce(native, F.lit(""))).alias("had"))

    def wins(m: Column) -> Column:
        gain = lambda share: m["got"] >= F.greatest(F.lit(3), F.floor(m["had"] * share))
        enough = (
            F.when(m["quality"] == "empty", conf >= 0.05)
            .when(m["quality"] == "insufficient", (conf >= 0.20) & gain(0.8))
            .when(m["quality"] == "suspicious", (conf >= 0.20) & gain(0.6))
            .otherwise((conf >= 0.65) & (m["got"] >= m["had"] + F.greatest(F.lit(12), F.floor(m["had"] / 4))))
        )
        return (m["got"] > 0) & enough

    return ~is_blank(recognized) & let(facts, wins)


def select_source(pages: DataFrame, config: OcrConfig | None = None) -> DataFrame:
    """Pages with native_text, ocr_text and ocr_confidence, plus text, extraction_source (native, ocr, empty) and confidence."""
    config = config or OcrConfig()
    native, ocr = F.col("native_text"), F.col("ocr_text")
    quality = F.col("_quality")
    ocr_wins = should_recognize(native, config, quality) & prefers_recognized(ocr, F.col("ocr_confidence"), native, config, quality)
    source = F.when(ocr_wins, "ocr").when(~is_blank(native), "native").otherwise("empty")
    out = pages.withColumn("_quality", native_quality(native, config.native_text_threshold)).withColumn("extraction_source", source).drop("_quality")
    text = F.when(F.col("extraction_source") == "ocr", ocr).when(F.col("extraction_source") == "native", native).otherwise(F.lit(""))
    conf = F.when(F.col("extraction_source") == "ocr", clamp(F.col("ocr_confidence"))).when(F.col("extraction_source") == "native", 1.0).otherwise(0.0)
    return out.withColumn("text", text).withColumn("confidence", conf)


def recognized_pages(observations: DataFrame) -> DataFrame:
    """Observations (book_id, page_index, source_order, text, confidence) as one text a page with its mean confidence."""
    lines = F.array_sort(F.collect_list(F.struct("source_order", "text")))
    return observations.groupBy("book_id", "page_index").agg(F.array_join(F.transform(lines, lambda x: x["text"]), "\n").alias("ocr_text"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("ocr_confidence"))


def scanned_books(pages: DataFrame, samples: int = 5) -> DataFrame:
    """book_id and is_scanned: of up to ``samples`` evenly spread pages, 0.6 or more have under 30 native characters."""
    book = Window.partitionBy("book_id")
    placed = pages.select("book_id", "native_text", (F.row_number().over(book.orderBy("page_index")) - 1).alias("at"), F.count("*").over(book).alias("n"))
    placed = placed.withColumn("step", F.greatest(F.lit(1), F.floor(F.col("n") / samples)))
    chosen = placed.where((F.col("at") % F.col("step") == 0) & (F.col("at") / F.col("step") < samples))
    short = at_most_graphemes(trim(F.coalesce("native_text", F.lit(""))), 29).cast("double")
    return chosen.groupBy("book_id").agg((F.avg(short) >= 0.6).alias("is_scanned"))
