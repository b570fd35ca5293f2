"""Tables of other kinds seen as pages of books. Book and page follow from a row's own keys, without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents that make a book, in the order of their ids.
PAGES_PER_BOOK = 40


def conversation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as pages."""
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return t.select(F.col("conv_id").alias("book_id"), F.col("turn").cast("int").alias("page_index"), F.coalesce("text", F.lit("")).alias("native_text"))


def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of documents as books. Each page gets a running header, every tenth a chapter heading, and a page number."""
    t = spark.read.parquet(f"{sf_dir}/documents.parquet")
    book, page = F.floor(F.col("doc_id") / PAGES_PER_BOOK), (F.col("doc_id") % PAGES_PER_BOOK).cast("int")
    heading = F.when(page % 10 == 0, F.concat(F.lit("Chapter "), F.floor(page / 10) + 1, F.lit("\n"))).otherwise("")
    body = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("fi"), F.lit("ﬁ")), F.lit(". "), F.lit(".  "))
    text = F.concat(F.lit("The Collected Book "), book, F.lit("\n"), heading, body, F.lit("\r\nPage "), page + 1)
    return t.select(book.alias("book_id"), page.alias("page_index"), text.alias("native_text"))
