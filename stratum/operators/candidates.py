"""Question words, candidates from the lexicon, automatic k and p."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.store import keep
from .build import KnowledgeBase


def lexicon(kb: KnowledgeBase) -> DataFrame:
    """(token, item, n_chars) of the labels' lower-cased tokens."""
    rows = kb.texts.select("item", F.explode("labels").alias("label"))
    return rows.select(F.explode(F.array_distinct(F.split(F.lower("label"), "[ #]+"))).alias("token"), "item", F.length("label").alias("n_chars")).where("token <> ''")


def question_words(questions: DataFrame, gazetteer: DataFrame, longest: int = 3) -> DataFrame:
    """(qid, widx, word): names of several words that the gazetteer (label) knows, then the other words.

    Names are found by n-grams of the question; of overlapping ones the longer, then the earlier stays.
    """
    words = questions.select("qid", X.plain_words(F.col("question")).alias("ws"))
    grams = words.select("qid", "ws", F.explode(F.expr(f"filter(flatten(transform(sequence(0, greatest(size(ws) - 1, 0)), i -> transform(sequence(2, {longest}), n -> struct(i as i, n as n, array_join(slice(ws, i + 1, n), ' ') as g)))), x -> x.i + x.n <= size(ws))")).alias("x"))
    spots = grams.select("qid", "x.i", "x.n", F.col("x.g").alias("label")).join(gazetteer.select(F.lower("label").alias("label")).distinct(), "label")
    better = spots.alias("a").join(spots.alias("b"), F.expr("a.qid = b.qid and a.i < b.i + b.n and b.i < a.i + a.n and (b.n > a.n or b.n = a.n and b.i < a.i)"), "left_anti")
    named = better.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("i", "n", "label"))).alias("spots"))
    both = words.join(named, "qid", "left")
    left = F.expr("filter(transform(ws, (w, i) -> if(exists(coalesce(spots, array()), s -> i >= s.i and i < s.i + s.n), null, w)), w -> w is not null)")
    out = both.select("qid", F.posexplode(F.concat(F.coalesce(F.col("spots.label"), F.array().cast("array<string>")), left)).alias("widx", "word"))
    return out


def word_pairs(words: DataFrame) -> DataFrame:
    """Pairs of a question's words."""
    a, b = words.alias("a"), words.alias("b")
    return a.join(b, F.expr("a.qid = b.qid and a.widx < b.widx")).select("a.qid", F.col("a.widx").alias("i"), F.col("b.widx").alias("j"))


def spot_by_model(questions: DataFrame, spotter, column: str = "question") -> DataFrame:
    """(qid, i, label): the names that a model finds. ``spotter`` takes a list of questions and gives a list of lists of names; batches go by Arrow."""
    import pandas as pd

    kind = questions.schema["qid"].dataType.simpleString()

    def run(batches):
        for b in batches:
            found = spotter(b[column].fillna("").tolist())
            rows = [(q, i, x) for q, xs in zip(b["qid"], found) for i, x in enumerate(xs)]
            yield pd.DataFrame(rows, columns=["qid", "i", "label"])

    return questions.select("qid", column).mapInPandas(run, f"qid {kind}, i int, label string")


def linked_names(kb: KnowledgeBase, words: DataFrame, kind: str = "E") -> DataFrame:
    """(qid, widx, word, item, label): every word with its first candidate of a kind, and that item's first label."""
    best = candidates(kb, words, 1, kind).where("rank = 1")
    return best.join(kb.texts.select("item", F.get("labels", F.lit(0)).alias("label")), "item").select("qid", "widx", "word", "item", "label")


def candidates(kb: KnowledgeBase, words: DataFrame, d: int = 20, kind: str | None = None) -> DataFrame:
    """E2, A9, A10 (``kind``: only entities 'E' or predicates 'P'): (qid, widx, word, rank, item): the first 2d hits, of which the first d that have facts stay.

    Hits are ranked by matched tokens, then the shorter label, then the item. The distinct words are looked
    up once, whatever the number of questions.
    """
    distinct = words.select("word").distinct()
    asked = distinct.select("word", F.explode(F.array_distinct(F.split(F.lower("word"), "[ #]+"))).alias("token"))
    known = lexicon(kb)
    if kind:
        known = known.where(F.col("item").rlike({"E": "^Q[0-9]+$", "P": "^P[0-9]+$"}[kind]))
    hits = asked.join(known, "token").groupBy("word", "item").agg(F.count(F.lit(1)).alias("n"), F.min("n_chars").alias("n_chars"))
    order = Window.partitionBy("word").orderBy(F.desc("n"), "n_chars", "item")
    top = hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= 2 * d)
    top = keep(top) if kb.views else top  # looked up and joined
    some = top.join(kb.counts(top).select("item"), "item", "left_semi")
    again = Window.partitionBy("word").orderBy("place")
    ranked = some.withColumn("rank", F.row_number().over(again)).where(F.col("rank") <= d).select("word", "rank", "item")
    return words.join(ranked, "word").select("qid", "widx", "word", "rank", "item")


def matching(rank: Column) -> Column:
    """1/2, 1/3, ... rounded to 4 places."""
    return F.bround(F.lit(1.0) / (rank + 1), 4)


def auto_k(kb: KnowledgeBase, found: DataFrame, words: DataFrame) -> DataFrame:
    """floor of the entropy (base 2) of the candidates' frequencies, and one; 0 without any."""
    n = found.join(kb.counts(found), "item").select("qid", "widx", (F.col("freq_s") + F.col("freq_o")).cast("double").alias("f"))
    share = F.col("f") / F.sum("f").over(Window.partitionBy("qid", "widx"))
    bits = n.where("f > 0").withColumn("s", share).groupBy("qid", "widx").agg((-F.sum(F.col("s") * F.log2("s"))).alias("h"))
    return words.join(bits, ["qid", "widx"], "left").select("qid", "widx", F.coalesce(F.floor(F.bround("h", 9)) + 1, F.lit(0)).cast("int").alias("k"))


def dynamic_p(setting: str, k: Column) -> Column:
    """F8: the pruning threshold of a named setting, or a number."""
    ways = {"DYNAMIC1": F.pow(F.lit(10.0), 6 - k), "DYNAMIC2": F.pow(F.lit(10.0), 5 - k), "DYNAMIC3": F.pow(F.lit(10.0), 5 - k / 2), "DYNAMIC4": F.pow(F.lit(10.0), 4 - k / 2), "DYNAMIC5": F.pow(F.lit(10.0), k), "DYNAMIC6": F.when(k == 1, 10000.0).when(k < 4, 1000.0).otherwise(100.0)}
    return ways.get(setting, F.lit(float(setting) if setting not in ways else 0.0)).cast("long")
