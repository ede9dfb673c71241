"""Readers and sinks of knowledge-base files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import keep

ENTITY, PREDICATE = "^Q[0-9]+$", "^P[0-9]+$"
#: A literal of this many characters or more does not enter the knowledge base.
LITERAL_LIMIT = 40


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """A1: (s, p, o) per line; the object may contain commas."""
    cut = F.split("value", ",", 3)
    return spark.read.text(path).select(cut[0].alias("s"), F.get(cut, F.lit(1)).alias("p"), F.get(cut, F.lit(2)).alias("o"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """A4: JSON lines (item, labels[], aliases[], description)."""
    return spark.read.schema("item string, labels array<string>, aliases array<string>, description string").json(path)


def read_benchmark(spark: SparkSession, path: str, split: str) -> DataFrame:
    """A5: one JSON object with arrays of questions by split."""
    one = "array<struct<question: string, answers: array<string>>>"
    raw = spark.read.schema(f"dev {one}, test {one}").json(path, multiLine=True)
    return raw.select(F.posexplode(split).alias("qid", "x")).select("qid", F.lit(split).alias("split"), "x.question", "x.answers")


def read_words(spark: SparkSession, path: str) -> list[str]:
    """A stop-word list, one word a line."""
    return [r[0] for r in spark.read.text(path).where("trim(value) <> ''").collect()]


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of one level as rows (key, value): item dictionaries, titles of entities."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "value"))
    return raw


def read_vectors(spark: SparkSession, path: str, entity_prefix: str = "ENTITY/") -> tuple[DataFrame, DataFrame]:
    """Vectors in the text format of word2vec, one a line, to (word, vec) and (title, vec) of entities; a line of two numbers is a header."""
    cut = F.split(F.trim("value"), " ")
    rows = spark.read.text(path).select(cut[0].alias("name"), F.slice(cut, F.lit(2), F.size(cut) - 1).cast("array<double>").alias("vec")).where(F.size("vec") > 1)
    entity = F.col("name").startswith(entity_prefix)
    words = rows.where(~entity).select(F.col("name").alias("word"), "vec")
    return words, rows.where(entity).select(F.regexp_replace(F.substring(F.col("name"), len(entity_prefix) + 1, 1 << 20), "_", " ").alias("title"), "vec")


def read_flat(spark: SparkSession, path: str) -> DataFrame:
    """A2: (pos, item) of a flat list with an element a line, in the order of files and lines."""
    return spark.read.text(path).select(F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line")).alias("pos"), F.col("value").alias("item")).where("item <> ''")


def search_triples(triples: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
    """The triples of a pattern; what is None or empty may be anything."""
    for column, value in (("s", s), ("p", p), ("o", o)):
        triples = triples.where(F.col(column) == value) if value else triples
    return triples


def facts_of_rows(rows: DataFrame) -> DataFrame:
    """Result rows (statement, s, p, o, qp, qo), one for each qualifier, to one fact a statement; qualifiers distinct, in order."""
    q = F.when(F.col("qp").isNotNull(), F.struct(F.col("qp").alias("p"), F.col("qo").alias("v")))
    out = rows.groupBy("statement", "s", "p", "o").agg(F.array_sort(F.collect_set(q)).alias("qualifiers"))
    tail = F.flatten(F.transform("qualifiers", lambda x: F.array(x["p"], x["v"])))
    return out.select("statement", F.col("s").alias("subject"), F.col("p").alias("predicate"), F.col("o").alias("object"), "qualifiers", F.concat(F.array("s", "p", "o"), tail).alias("items"))


#: How many elements the fact at hand has, as far as it matters: 0, 1, 2, an odd number from 3 on, an even one from 4 on.
_NEXT = {False: (1, 2, 3, 4, 3), True: (1, 2, 3, 1, 3)}


def parse_flat(tokens: DataFrame, drop_last: bool = False) -> DataFrame:
    """Rows (pos, item) of a flat list to facts (fact_id, items), numbered in order.

    A fact has three core items and then pairs of qualifiers; an entity where a qualifier's predicate would
    stand opens the next fact. Of the elements before, only five cases matter; so every slice of the list is
    run from all five at once, the slices' outcomes are chained (a row a slice), and then each slice is cut with the case that it really begins
    with. ``drop_last`` leaves the last fact out, as a loader that flushes at the next fact only (ledger Q4).
    """
    import pandas as pd

    spark = tokens.sparkSession
    rows = keep(tokens.repartitionByRange("pos").sortWithinPartitions("pos").withColumn("part", F.spark_partition_id()).withColumn("nth", F.monotonically_increasing_id()))
    entity = F.col("item").rlike(ENTITY)

    def outcomes(slice_: pd.DataFrame) -> pd.DataFrame:
        flags = slice_.sort_values("nth")["entity"].to_numpy().tolist()
        states, starts = list(range(5)), [0] * 5
        for e in flags:
            for k in range(5):
                new = _NEXT[e][states[k]]
                starts[k] += new == 1
                states[k] = new
        return pd.DataFrame({"part": [int(slice_["part"].iloc[0])], "states": [states], "starts": [starts]})

    chained, state, so_far = {}, 0, 0
    marked = rows.select("part", "nth", "item", entity.alias("entity"))
    for r in sorted(marked.select("part", "nth", "entity").groupBy("part").applyInPandas(outcomes, "part int, states array<int>, starts array<long>").collect()):
        chained[r["part"]] = (state, so_far)
        state, so_far = r["states"][state], so_far + r["starts"][state]

    def numbered(slice_: pd.DataFrame) -> pd.DataFrame:
        out = slice_.sort_values("nth")
        k, n = chained[int(out["part"].iloc[0])]
        ids = []
        for e in out["entity"].to_numpy().tolist():
            k = _NEXT[e][k]
            n += k == 1
            ids.append(n - 1)
        return pd.DataFrame({"fact_id": ids, "nth": out["nth"], "item": out["item"]})

    flat = marked.groupBy("part").applyInPandas(numbered, "fact_id long, nth long, item string")
    facts = flat.groupBy("fact_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "item"))), lambda x: x["item"]).alias("items")).where(F.size("items") >= 3)
    return facts.where(F.col("fact_id") < so_far - 1) if drop_last else facts


def write_results(df: DataFrame, path: str) -> None:
    """One JSON object per question."""
    df.write.mode("overwrite").json(path)


def running_presence(results: DataFrame, order: str = "qid", hit: str = "hit") -> DataFrame:
    """Running mean of answer presence."""
    w = Window.partitionBy("benchmark").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return results.withColumn("running", F.avg(F.col(hit).cast("double")).over(w))


def clean_value(value):
    """The item of a result cell: an address's last part, a typed literal without its sign, a year or date as a timestamp, else without quotes."""
    from ..functions import text as X

    typed = F.regexp_extract(value, '^"\\+?([^"]*)"\\^\\^', 1)
    bare = F.regexp_replace(value, '"', "")
    plain = F.when(X.is_year(bare), X.year_to_timestamp(bare)).when(X.is_date(bare), X.date_to_timestamp(bare)).otherwise(bare)
    return F.when(typed != "", typed).when(value.startswith("http"), F.substring_index(value, "/", -1)).otherwise(plain)


def write_report(summary: DataFrame, path: str) -> None:
    """A line for each benchmark and parameter set, and the same rows as JSON beside it."""
    line = F.format_string("Benchmark: %s, Answer presence: %s, Search space size: %s, Parameters: %s", "benchmark", F.col("presence").cast("string"), F.col("items").cast("string"), F.coalesce(F.col("parameters") if "parameters" in summary.columns else F.lit(None).cast("string"), F.lit("")))
    summary.select(line.alias("value")).coalesce(1).write.mode("append").text(f"{path}.res")  # a row a benchmark
    summary.coalesce(1).write.mode("overwrite").json(f"{path}.json")
