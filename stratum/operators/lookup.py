"""Lookups of items, set at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .build import KnowledgeBase, kind_of


def names(kb: KnowledgeBase, items: DataFrame) -> DataFrame:
    """Labels, aliases, description and single label; unknown items name themselves, a null is 'None'."""
    found = items.join(kb.texts, "item", "left")
    own = F.array(F.coalesce("item", F.lit("None")))
    labels = F.when(X.is_timestamp(F.col("item")), F.array(X.timestamp_label(F.col("item")))).when(F.size("labels") > 0, F.col("labels")).otherwise(own)
    found = found.withColumn("labels", labels)
    return found.select(*items.columns, "labels", F.when(F.size("aliases") > 0, F.col("aliases")).otherwise(own).alias("aliases"), F.coalesce("description", F.lit("None")).alias("description"), X.single_label(F.col("item"), F.col("labels")).alias("label"))


def frequency(kb: KnowledgeBase, items: DataFrame, qualifiers: bool = True) -> DataFrame:
    """[0, 0] for what is unknown or a literal; C27: without ``qualifiers`` only subjects and objects count."""
    own = kb.freq if qualifiers else kb.main_freq
    return items.join(own, "item", "left").select(*items.columns, F.coalesce("freq_s", F.lit(0)).alias("freq_s"), F.coalesce("freq_o", F.lit(0)).alias("freq_o"))


def known(kb: KnowledgeBase, items: DataFrame) -> DataFrame:
    """The items that have facts."""
    return items.join(kb.freq.select("item"), "item", "left_semi")


def types(kb: KnowledgeBase, items: DataFrame) -> DataFrame:
    """Objects of P31 and P106 facts whose subject is the item, in fact order."""
    own = kb.index.where("pos = 0 and predicate in ('P31', 'P106')").select("item", "fact_id", F.col("object").alias("type_id"))
    return items.join(own, "item")


def top_type(kb: KnowledgeBase, items: DataFrame) -> DataFrame:
    """The most frequent type; the first fact's wins ties, types without facts do not count."""
    total = kb.freq.select(F.col("item").alias("type_id"), (F.col("freq_s") + F.col("freq_o")).alias("n"))
    ranked = types(kb, items).join(total, "type_id").where("n > 0")
    first = Window.partitionBy("item").orderBy(F.desc("n"), "fact_id")
    return ranked.withColumn("nth", F.row_number().over(first)).where("nth = 1").select("item", "type_id", "n")


def encode(items: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Code of every item, null if there is none."""
    return items.join(dictionary.select("item", "code"), "item", "left")


def decode(codes: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Item of every code."""
    return codes.join(dictionary.select("item", "code"), "code", "left")


def labelled(kb: KnowledgeBase, facts: DataFrame, key: list[str], types: bool = False) -> DataFrame:
    """Every element of a fact as (id, label), or with ``types`` as (id, label, type (id, label)), in place.

    Each distinct element is looked up once, whatever the number of facts that hold it.
    """
    flat = facts.select(*key, F.posexplode("items").alias("at", "item"))
    known = names(kb, flat.select("item").distinct()).select("item", "label")
    inside = [F.col("item").alias("id"), F.col("label")]
    if types:
        best = top_type(kb, known.select("item"))
        of = best.join(names(kb, best.select(F.col("type_id").alias("item")).distinct()).select(F.col("item").alias("type_id"), F.col("label").alias("type_label")), "type_id")
        known = known.join(of.select("item", F.struct(F.col("type_id").alias("id"), F.col("type_label").alias("label")).alias("type")), "item", "left")
        inside.append(F.col("type"))
    rows = flat.join(known, "item").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("at", F.struct(*inside).alias("x")))).alias("xs"))
    return rows.select(*key, F.col("xs.x").alias("elements"))


__all__ = ["decode", "encode", "frequency", "kind_of", "known", "labelled", "names", "top_type", "types"]
