"""Vectors and the scores of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.store import keep
from .build import KnowledgeBase
from .graph import connectivity


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def embed(phrases: DataFrame, word_vec: DataFrame, column: str = "phrase") -> DataFrame:
    """Mean of the known words' vectors and its norm; phrases without any are absent."""
    rows = phrases.select(column).distinct().select(column, F.explode(F.filter(F.split(F.lower(column), " +"), lambda w: ~w.isin([*X.STOP_WORDS, ""]))).alias("word"))
    flat = rows.join(word_vec, "word").select(column, F.posexplode("vec").alias("i", "x"))
    mean = flat.groupBy(column, "i").agg(F.avg("x").alias("x"))
    vec = mean.groupBy(column).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vec"))
    return vec.withColumn("norm", F.sqrt(dot(F.col("vec"), F.col("vec"))))


def cosine(a: str, b: str) -> Column:
    return dot(F.col(f"{a}.vec"), F.col(f"{b}.vec")) / (F.col(f"{a}.norm") * F.col(f"{b}.norm"))


def item_vectors(kb: KnowledgeBase, found: DataFrame, word_vec: DataFrame, titles: DataFrame | None = None, title_vec: DataFrame | None = None) -> DataFrame:
    """E5: (item, vec, norm): an entity's title vector if ``titles`` (item, title) and ``title_vec`` (title, vec) have one, else by its label.

    Predicates go by their label, anything else by its own text.
    """
    items = found.select("item").distinct()
    labels = items.join(kb.texts, "item", "left").select("item", X.single_label(F.col("item"), F.coalesce("labels", F.array("item"))).alias("phrase"))
    by_label = labels.join(embed(labels, word_vec), "phrase").select("item", "vec", "norm")
    if titles is None or title_vec is None:
        return by_label
    shown = titles.where(X.is_entity(F.col("item"))).select("item", F.regexp_replace(F.regexp_replace("title", "%27", "'"), "_", " ").alias("title"))
    own = items.join(shown, "item").join(title_vec, "title").select("item", "vec").withColumn("norm", F.sqrt(dot(F.col("vec"), F.col("vec"))))
    return own.unionByName(by_label.join(own.select("item"), "item", "left_anti"))


def matching_by_vectors(found: DataFrame, words: DataFrame, word_vec: DataFrame, items: DataFrame) -> DataFrame:
    """The alternative matching score: cosine of an item and its own question word; 0 where either has no vector."""
    wv = embed(words.select(F.col("word").alias("phrase")), word_vec).select(F.col("phrase").alias("word"), "vec", "norm")
    both = found.alias("f").join(items.alias("a"), "item").join(wv.alias("b"), "word").select("qid", "widx", "item", cosine("a", "b").alias("sim"))
    return found.join(both, ["qid", "widx", "item"], "left").select("qid", "widx", "item", F.coalesce("sim", F.lit(0.0)).alias("similarity"))


def relevance(found: DataFrame, words: DataFrame, word_vec: DataFrame, items: DataFrame) -> DataFrame:
    """Mean cosine with the question's other words that have a vector; 0 without any."""
    wv = embed(words.select(F.col("word").alias("phrase")), word_vec)
    ws = words.join(wv, words["word"] == wv["phrase"]).select("qid", F.col("widx").alias("other"), "vec", "norm")
    pairs = found.join(items, "item").alias("a").join(ws.alias("b"), F.expr("a.qid = b.qid and a.widx <> b.other"))
    means = pairs.groupBy("a.qid", "a.widx", "a.item").agg(F.bround(F.avg(cosine("a", "b")), 4).alias("rel"))
    return found.join(means, ["qid", "widx", "item"], "left").select("qid", "widx", "item", F.coalesce("rel", F.lit(0.0)).alias("rel"))


def candidate_pairs(found: DataFrame) -> DataFrame:
    """Distinct unordered pairs of candidates of different words of one question."""
    a, b = found.alias("a"), found.alias("b")
    pairs = a.join(b, F.expr("a.qid = b.qid and a.widx < b.widx")).select("a.qid", F.least("a.item", "b.item").alias("i1"), F.greatest("a.item", "b.item").alias("i2"))
    return pairs.distinct()


def connectivity_edges(kb: KnowledgeBase, pairs: DataFrame) -> DataFrame:
    """Edges with a weight over 0; each pair of items is looked up once for all questions."""
    w = connectivity(kb, pairs.select("i1", "i2")).where("connectivity > 0")
    return pairs.join(w, ["i1", "i2"]).select("qid", "i1", "i2", F.col("connectivity").alias("w"))


def coherence_edges(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Cosines of candidates that have vectors, all but 0."""
    both = pairs.alias("p").join(items.alias("a"), F.expr("p.i1 = a.item")).join(items.alias("b"), F.expr("p.i2 = b.item"))
    return both.select("p.qid", "p.i1", "p.i2", cosine("a", "b").alias("w")).where("w <> 0")


def single_score(found: DataFrame, words: DataFrame, edges: DataFrame, out: str) -> DataFrame:
    """For each other word the best edge that credits it, summed and divided by words - 1."""
    m = words.groupBy("qid").agg(F.count(F.lit(1)).alias("m"))
    own = found.groupBy("qid", "item").agg(F.collect_set("widx").alias("ws"))  # a question has few words
    both = edges.select("qid", F.col("i1").alias("item"), F.col("i2").alias("other"), "w").union(edges.where("i1 <> i2").select("qid", F.col("i2"), F.col("i1"), "w"))
    near = both.join(own, ["qid", "item"]).join(own.select("qid", F.col("item").alias("other"), F.col("ws").alias("theirs")), ["qid", "other"])
    credit = near.select("qid", "item", "w", F.explode(F.array_union("ws", "theirs")).alias("i"))
    best = credit.groupBy("qid", "item", "i").agg(F.max("w").alias("best"))
    mine = found.select("qid", "widx", "item").join(best, ["qid", "item"]).where("i <> widx")
    total = mine.groupBy("qid", "widx", "item").agg(F.sum("best").alias("s")).join(m, "qid")
    scored = total.select("qid", "widx", "item", F.bround(F.col("s") / F.greatest(F.col("m") - 1, F.lit(1)), 4).alias(out))
    return found.join(scored, ["qid", "widx", "item"], "left").select("qid", "widx", "item", F.coalesce(out, F.lit(0.0)).alias(out))


def tuple_score(edges: DataFrame, tuples: DataFrame) -> DataFrame:
    """Mean weight over all pairs of a tuple (qid, item); pairs without an edge count 0."""
    a, b = tuples.alias("a"), tuples.alias("b")
    pairs = a.join(b, F.expr("a.qid = b.qid and a.item < b.item")).select("a.qid", F.col("a.item").alias("i1"), F.col("b.item").alias("i2"))
    return pairs.join(edges, ["qid", "i1", "i2"], "left").groupBy("qid").agg(F.avg(F.coalesce("w", F.lit(0.0))).alias("score"))


def edge_weight(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """The stored weight of (qid, i1, i2) in either order, or 0."""
    ordered = pairs.withColumn("lo", F.least("i1", "i2")).withColumn("hi", F.greatest("i1", "i2"))
    stored = edges.select("qid", F.col("i1").alias("lo"), F.col("i2").alias("hi"), "w")
    return ordered.join(stored, ["qid", "lo", "hi"], "left").select("qid", "i1", "i2", F.coalesce("w", F.lit(0.0)).alias("w"))


def graph_nodes(found: DataFrame) -> DataFrame:
    """(qid, item, words): the nodes with the question words that they stand for, in order."""
    return found.groupBy("qid", "item").agg(F.array_sort(F.collect_set("widx")).alias("words"))


def graph_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(qid, item, root): root is the smallest item linked, directly or not.

    Labels spread along the edges and then jump to their label's label, so that the rounds grow with the logarithm of
    the longest path; ``RuntimeError`` if they have not settled in ``rounds``.
    """
    both = keep(edges.select("qid", F.col("i1").alias("item"), F.col("i2").alias("other")).union(edges.select("qid", F.col("i2"), F.col("i1"))).distinct())
    now = keep(both.select("qid", "item").distinct().withColumn("root", F.col("item")))
    for _ in range(rounds):
        near = both.join(now.select("qid", F.col("item").alias("other"), "root"), ["qid", "other"]).select("qid", "item", "root")
        spread = now.unionByName(near).groupBy("qid", "item").agg(F.min("root").alias("root"))
        jump = now.select("qid", F.col("item").alias("root"), F.col("root").alias("further"))
        new = keep(spread.join(jump, ["qid", "root"]).select("qid", "item", F.least("root", "further").alias("root")))
        if new.join(now, ["qid", "item", "root"], "left_anti").isEmpty():
            return now
        now = new
    raise RuntimeError(f"components have not settled in {rounds} rounds")


__all__ = ["candidate_pairs", "coherence_edges", "connectivity_edges", "edge_weight", "embed", "graph_components", "graph_nodes", "item_vectors", "matching_by_vectors", "relevance", "single_score", "tuple_score"]
