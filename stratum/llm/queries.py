"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exchange, html_extract, license_scan, lm_scoring, mixing, quality, simhash, suffix_dedup, token_output, url_filter

#: A public byte-level BPE vocabulary.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return lm_scoring.score(_table(spark, sf_dir, "documents").select("doc_id", "text"), held_out)


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_extract.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes: the labels whose doc_id is the page's id; bad is low quality or toxic."""
    outcomes = _table(spark, sf_dir, "labels").select("doc_id", F.greatest(1 - F.col("quality"), F.col("toxic")).alias("bad"))
    out = url_filter.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), outcomes)
    return out.select("page_id", "host", "path", "rule", "verdict", F.bround("reputation", 6).alias("reputation"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    n_items = F.size("items").cast("long")
    return found.select("doc_id", "n_words", "n_hit", n_items.alias("n_items"), decontaminate.items_digest(F.col("items")).alias("items_sha256"), (n_items >= 2).alias("contaminated"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.features(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    out = quality.judge(exchange.cut(found))  # a few numbers a document
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.bround("quality", 6).alias("quality"))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.materialise(_table(spark, sf_dir, "documents"), VOCABULARY)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_lm_scoring, op2_html_extract, op3_simhash, op4_url_filter, op5_suffix_dedup, op6_mixing, op7_license_scan, op8_decontaminate, op9_quality, op10_token_output)}


def oracle_sql() -> dict[str, str]:
    from .oracle import SQL

    return dict(SQL)
