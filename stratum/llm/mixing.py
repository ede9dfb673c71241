"""Mixing sources to target weights.

Targets come from the sizes of the sources and their weights, filled up like connected
vessels under a ceiling of epochs. Within a source documents stand in a pseudo-random order
of their ids; a distributed prefix sum (slices of the key range first, then inside each
slice) tells where the source's budget cuts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import exchange

#: Slices of a source's key range for each bucket of the session's shuffles; a hot source is spread over all of them.
SLICES_A_BUCKET = 32


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = (5, 2, 1), ceiling: int = 3) -> dict[str | None, float]:
    """Words that each source should give; ``sizes`` has every source once."""
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size = dict(order)
    total = float(sum(size.values()))
    full: dict[str | None, float] = {}
    while True:
        rest = [s for s, _ in order if s not in full]
        left, all_weights = total - sum(full.values()), sum(weight[s] for s in rest)
        share = {s: left * weight[s] / all_weights for s in rest}
        above = [s for s in rest if share[s] > ceiling * size[s]]
        if not above:
            return full | share
        full |= {s: float(ceiling * size[s]) for s in above}


OWN = ("size", "source_size", "target", "taken", "last", "whole", "_key", "_tie", "_slice", "_sum", "_of", "_at", "_before", "_within", "_source", "_rest", "_whole")


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", seed: int = 42, weights: tuple[float, ...] = (5, 2, 1), ceiling: int = 3, most_sources: int = 1_000_000, keep_text: bool = False) -> DataFrame:
    """Append size, source_size, target, taken (all repeats), last (words of the last, cut repeat) and whole (repeats before it).

    A null text has size 0. A source is taken whole as often as its target holds it; then documents
    are taken in key order until the budget, rounded down to whole words, is spent to the word.
    Rows with the same id and text are interchangeable. More sources than ``most_sources`` raise an
    error, as the table of sources is put together on the driver. Columns that clash with those
    appended are replaced by them; an empty table stays empty.
    """
    spark = docs.sparkSession
    mine, _ = exchange.set_aside(docs, set(OWN))
    taken = {c: h for h, c in _.items()}
    source, doc_id = taken.get(source, source), taken.get(doc_id, doc_id)
    text_at = taken.get(text, text)
    others = [c for c in mine.columns if c not in _ and (keep_text or c != text_at)]
    n_slices = SLICES_A_BUCKET * exchange.partitions(spark)
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))))
    held = list(dict.fromkeys([*others, source]))
    rows = mine.select(*held, n_words(F.col(text_at)).alias("size"), key.alias("_key"), F.xxhash64(*[c for c in mine.columns if c != text_at], F.xxhash64(F.col(text_at))).alias("_tie"))
    # a key spreads evenly, so its first digits cut each source into slices of like size
    rows = rows.withColumn("_slice", F.floor(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") * n_slices / (1 << 32)).cast("int"))
    if not keep_text:
        rows = exchange.cut(rows)  # without texts, so that words are counted once
    sums = exchange.cut(rows.groupBy(source, "_slice").agg(F.sum("size").alias("_sum")))
    per_source = [(r[0], int(r[1])) for r in sums.groupBy(source).agg(F.sum("_sum")).limit(most_sources + 1).collect()]
    if len(per_source) > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    aim = targets(per_source, weights, ceiling)
    plan = [(s, n, aim[s], int(aim[s] // n) if n else 0, int(aim[s]) - int(aim[s] // n) * n if n else 0) for s, n in per_source]
    plan_df = F.broadcast(spark.createDataFrame(plan, "_source string, source_size long, target double, _whole long, _rest long"))
    before = Window.partitionBy(source).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = sums.select(F.col(source).alias("_of"), F.col("_slice").alias("_at"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(source, "_slice").orderBy("_key", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(slices, rows[source].eqNullSafe(slices["_of"]) & (rows["_slice"] == slices["_at"]))
    rows = rows.join(plan_df, rows[source].eqNullSafe(F.col("_source")))
    last = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - F.col("_before") - F.col("_within"))).cast("long")
    out = rows.withColumn("last", last).withColumn("taken", F.col("_whole") * F.col("size") + F.col("last"))
    return out.select(*others, "size", "source_size", "target", "taken", "last", F.col("_whole").alias("whole"))


def repeat(docs: DataFrame, source: str = "source", text: str = "text", **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, the last repeat cut after its last word taken.

    Documents without words, and those beyond their source's budget, are not in the mix. All columns pass through, whatever their names.
    """
    mine, back = exchange.set_aside(docs, {*OWN, "_take"})
    there = {c: h for h, c in back.items()}
    text_at = there.get(text, text)
    mixed = mix(mine, source=there.get(source, source), text=text_at, keep_text=True, **options)
    partial = F.when(F.col("last") > 0, F.array(F.col("last"))).otherwise(F.array().cast("array<bigint>"))
    takes = mixed.withColumn("_take", F.explode(F.concat(F.array_repeat(F.col("size"), F.when(F.col("size") > 0, F.col("whole")).otherwise(0).cast("int")), partial)))
    words = F.slice(F.filter(F.split(F.col(text_at), r"[\x20\x09-\x0D]+"), lambda w: w != ""), 1, F.col("_take").cast("int"))
    shown = F.when(F.col("_take") < F.col("size"), F.array_join(words, " ")).otherwise(F.col(text_at))
    return takes.withColumn(text_at, shown).select(*[F.col(there.get(c, c)).alias(c) for c in docs.columns])
