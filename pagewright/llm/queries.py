"""One query for each operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bt_quality, ngram_lm, sql
from .bpe import decode_documents, encode_documents
from .chat_format import conversation_records, format_records
from .collocations import collocations
from .common import read_table
from .fingerprints import fingerprint_edits
from .hard_negatives import mine_hard_negatives
from .line_dedup import dedup_lines
from .near_dedup import near_duplicates
from .packing import pack_documents
from .quality_rules import apply_rules
from .substring_dedup import remove_repeats
from .warc import archive_pages, merged_index, read_archives

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = apply_rules(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", *[F.col(f"rules.{k}").alias(k) for k in (*BASE, "n_lines", "n_stop_words")])


def op1_bt_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = bt_quality.fit(docs, read_table(spark, sf_dir, "labels"))
    scored = bt_quality.score_documents(docs, model, out_col="q")
    return scored.select("doc_id", bt_quality.held_out(F.col("doc_id")).alias("held_out"), "q.score", "q.predicted")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = decode_documents(encode_documents(read_table(spark, sf_dir, "documents")))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(read_table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), shingle=2)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    talks = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    talks = talks.unionByName(spark.createDataFrame([(-1, 0, "user", own), (-1, 1, "assistant", own)], "conv_id long, turn long, role string, text string"))
    back = format_records(conversation_records(talks), "conv_id", "record")
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), digest(turns).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), digest(loss).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op6_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ngram_lm.score_documents(read_table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", F.round("mean_log_score", 6).alias("mean_log_score"), "n_backoffs")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "dedup.n_lines", "dedup.n_removed", F.length("text").cast("long").alias("kept_chars"), F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    date = F.date_format(F.timestamp_seconds(F.lit(1_704_067_200) + F.coalesce("page_id", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    blocks, folder = archive_pages(read_table(spark, sf_dir, "pages"), date=date)
    n_files = blocks.select("archive").distinct().count()
    back = read_archives(blocks, folder, max(1, n_files))
    back = back.select(
        "file", "at", F.col("record_id").cast("long").alias("page_id"), F.coalesce(F.octet_length("payload").cast("long"), F.col("header_bytes")).alias("payload_bytes"),
        F.coalesce(F.sha2("payload", 256), F.col("header_digest")).alias("payload_digest"), "record_type", F.col("refers_to").cast("long").alias("refers_to"),
    )
    history = merged_index(blocks, folder).select("file", "at", "url_key", F.col("date").alias("captured_at"), F.col("seq").alias("history_rank"))
    return back.join(history.hint("merge"), ["file", "at"]).drop("file", "at")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    edits = fingerprint_edits(read_table(spark, sf_dir, "documents"))
    return edits.select("doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(read_table(spark, sf_dir, "embeddings").withColumn("label", label), anchor=F.col("vec_id") % 50 == 0)


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode(F.coalesce("kept", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bt_quality": op1_bt_quality,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_packing": op3_packing,
    "op4_minhash_dedup": op4_minhash_dedup,
    "op5_chat_format": op5_chat_format,
    "op6_ngram_lm": op6_ngram_lm,
    "op7_line_dedup": op7_line_dedup,
    "op8_warc": op8_warc,
    "op9_fingerprints": op9_fingerprints,
    "op10_quality_rules": op10_quality_rules,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_collocations": op13_collocations,
}
ORACLE_SQL: dict[str, str] = {
    "op5_chat_format": sql.CHAT_FORMAT,
    "op6_ngram_lm": sql.NGRAM_LM,
    "op8_warc": sql.WARC,
    "op10_quality_rules": sql.QUALITY_RULES,
    "op11_hard_negatives": sql.HARD_NEGATIVES,
    "op12_substring_dedup": sql.SUBSTRING_DEDUP,
    "op13_collocations": sql.COLLOCATIONS,
}
