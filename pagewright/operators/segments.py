"""Segments for speech: pieces of pages packed within chapters, with exact page ranges, confidence and stable ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.config import ChunkConfig
from pagewright.functions.chunks import chunks
from pagewright.functions.ids import stable_id
from pagewright.functions.text import graphemes
from pagewright.operators.chapters import with_start

PIECE = "struct<text:string,lo:int,hi:int,confidence:double,n:int>"


def pieces(pages: DataFrame, chapters: DataFrame, config: ChunkConfig) -> DataFrame:
    """book_id, chapter_order, title and the pieces (page order, then place) of each chapter; a chapter whose pages are missing is cut from its own text."""
    cut = pages.select("book_id", "page_index", "confidence", chunks(F.col("text"), config).alias("c"))
    starts = chapters.select("book_id", F.col("page_lo").alias("page_index"), "chapter_order", "title", "page_hi")
    inside = with_start(cut, starts, "chapter_order", "title", "page_hi").where("page_index <= page_hi")
    of_pages = inside.select("book_id", "chapter_order", "title", F.col("page_index").alias("at"), F.posexplode("c").alias("i", "text"), F.col("page_index").cast("int").alias("lo"), F.col("page_index").cast("int").alias("hi"), "confidence")
    there = with_start(pages.select("book_id", "page_index"), starts, "chapter_order", "page_hi").where("page_index <= page_hi")
    bare = chapters.join(there.select("book_id", "chapter_order").distinct(), ["book_id", "chapter_order"], "left_anti")
    of_text = bare.select("book_id", "chapter_order", "title", F.col("page_lo").alias("at"), F.posexplode(chunks(F.col("plain_text"), config)).alias("i", "text"), F.col("page_lo").cast("int").alias("lo"), F.col("page_hi").cast("int").alias("hi"), "confidence")
    return of_pages.unionByName(of_text)


def _pack(all_pieces: Column, most: int, across_pages: bool) -> Column:
    """A fold over the sorted pieces of a chapter: the next one joins where its range allows it and the text stays in bounds.

    Lengths are counted once a piece: ``n`` alone and ``more`` behind a blank, which takes in a combining mark at its start.
    """
    sized = F.transform(all_pieces, lambda p: p.withField("n", graphemes(p["text"])).withField("more", graphemes(F.concat(F.lit(" "), p["text"]))))

    def step(a: Column, p: Column) -> Column:
        now = a["now"]
        text = F.concat(now["text"], F.lit(" "), p["text"])
        same = (p["lo"] == now["lo"]) & (p["hi"] == now["hi"])
        allowed = same | (p["lo"] <= now["hi"] + 1) if across_pages else same
        joins = a["any"] & allowed & (now["n"] + p["more"] <= most)
        left, right = F.greatest(F.lit(1), now["n"]), F.greatest(F.lit(1), p["n"])
        mean = (now["confidence"] * left + p["confidence"] * right) / (left + right)
        merged = F.struct(text.alias("text"), now["lo"].alias("lo"), p["hi"].alias("hi"), mean.alias("confidence"), (now["n"] + p["more"]).alias("n"))
        alone = F.struct(p["text"].alias("text"), p["lo"].alias("lo"), p["hi"].alias("hi"), p["confidence"].alias("confidence"), p["n"].alias("n"))
        out = F.when(joins | ~a["any"], a["out"]).otherwise(F.concat(a["out"], F.array(now)))
        return F.struct(F.lit(True).alias("any"), F.when(joins, merged).otherwise(alone).alias("now"), out.alias("out"))

    start = F.struct(F.lit(False).alias("any"), F.lit(None).cast(PIECE).alias("now"), F.array().cast(f"array<{PIECE}>").alias("out"))
    return F.aggregate(sized, start, step, lambda a: F.when(a["any"], F.concat(a["out"], F.array(a["now"]))).otherwise(a["out"]))


def build_segments(pages: DataFrame, chapters: DataFrame, config: ChunkConfig | None = None, across_pages: bool = True) -> DataFrame:
    """book_id, seg_order, id, chapter_index, chapter_title, text, page_lo, page_hi, confidence.

    ``across_pages`` lets short pieces of neighbouring pages share a segment. Segments never cross chapters.
    """
    config = config or ChunkConfig()
    per_chapter = pieces(pages, chapters, config).groupBy("book_id", "chapter_order", "title").agg(F.array_sort(F.collect_list(F.struct("at", "i", "text", "lo", "hi", "confidence"))).alias("p"))
    packed = per_chapter.select("book_id", F.col("chapter_order").alias("chapter_index"), F.col("title").alias("chapter_title"), F.posexplode(_pack(F.col("p"), config.max_characters, across_pages)).alias("i", "s"))
    order = F.row_number().over(Window.partitionBy("book_id").orderBy("chapter_index", "i")) - 1
    rows = packed.select("book_id", order.alias("seg_order"), "chapter_index", "chapter_title", "s.text", F.col("s.lo").alias("page_lo"), F.col("s.hi").alias("page_hi"), "s.confidence")
    key = stable_id("segment", F.col("chapter_index"), F.col("seg_order"), F.col("page_lo"), F.col("page_hi"), F.col("text"))
    return rows.select("book_id", "seg_order", key.alias("id"), "chapter_index", "chapter_title", "text", "page_lo", "page_hi", "confidence")
