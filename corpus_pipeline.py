"""A corpus pipeline: quality rules, near-dedup, decontamination, mixing, token output.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a
DataFrame, which is written as Parquet and read back as the next stage's documents. All but the
last return the columns of ``documents``. The last one also writes the sequences as shards of fixed
stride, into the folder of the setting ``stratum.shards.dir``, or else into the shared folder for as long as the session lasts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from stratum.llm import decontaminate, exchange, mixing, quality, simhash, token_output
from stratum.llm.queries import VOCABULARY


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat(docs)


def token_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    placed = token_output.places(docs, VOCABULARY)
    folder = spark.conf.get("stratum.shards.dir", None)
    with exchange.dropping_shuffles(spark):
        token_output.write_shards(placed, folder or exchange.fresh_folder(spark, f"shards-{uuid.uuid4().hex}"))
    return token_output.in_order(placed)


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixture),
    ("token output", token_sequences),
]

#: SimHash, the automaton and the encoder have no form in SQL; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = exchange.stored(docs, name.replace(" ", "-"))
            docs = spark.read.schema(docs.schema).parquet(path)
            if before:
                exchange.discard(spark, before)  # its only reader has been written
            before = path
    return docs
