"""Questions to search spaces: scores, weighted top-k, facts, BM25, evaluation."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import candidates as C
from ..operators import graph as G
from ..operators import scores as S
from ..operators.build import KnowledgeBase
from ..sources.store import keep


@dataclass(frozen=True)
class Parameters:
    """Weights and limits; the defaults are those of the interface, ``PRESETS`` those of the sweep."""

    h_match: float = 0.4
    h_rel: float = 0.3
    h_conn: float = 0.2
    h_coh: float = 0.1
    d: int = 20
    k: str | int = "AUTO"
    p: str | int = 1000
    bm25_limit: int | None = None


_SWEEP = Parameters(h_rel=0.2, h_conn=0.3)
PRESETS = [replace(_SWEEP, k="AUTO", p=1000), replace(_SWEEP, k=1, p=10000), replace(_SWEEP, k=5, p=100)]


def scored(kb: KnowledgeBase, words: DataFrame, word_vec: DataFrame, d: int = 20, found: DataFrame | None = None, vectors: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """(qid, widx, word, rank, item, match, rel, conn, coh) of every candidate; given tables are not made anew."""
    found = keep(C.candidates(kb, words, d)) if found is None else found
    vectors = keep(S.item_vectors(kb, found, word_vec)) if vectors is None else vectors
    pairs = S.candidate_pairs(found) if pairs is None else pairs
    key = ["qid", "widx", "item"]
    conn = keep(S.single_score(found, words, keep(S.connectivity_edges(kb, pairs)), "conn"))
    coh = keep(S.single_score(found, words, keep(S.coherence_edges(pairs, vectors)), "coh"))
    rel = keep(S.relevance(found, words, word_vec, vectors))
    return found.withColumn("match", C.matching(F.col("rank"))).join(rel, key).join(conn, key).join(coh, key)


def weighted(rows: DataFrame, par: Parameters = Parameters()) -> DataFrame:
    """the weighted sum."""
    return rows.withColumn("score", par.h_match * F.col("match") + par.h_rel * F.col("rel") + par.h_conn * F.col("conn") + par.h_coh * F.col("coh"))


def top_k(rows: DataFrame, k: DataFrame | int, early_stop_order: bool = True) -> DataFrame:
    """The k best of every word, positive scores only.

    Equal scores keep the order in which a row-wise scan over the four sorted lists meets the items.
    """
    by_word = Window.partitionBy("qid", "widx")
    seen = [4 * (F.row_number().over(by_word.orderBy(F.desc(c), "rank")) - 1) + j for j, c in enumerate(("match", "rel", "conn", "coh"))]
    out = rows.withColumn("seen", F.least(*seen) if early_stop_order else F.col("rank"))
    out = out.where("score > 0").withColumn("place", F.row_number().over(by_word.orderBy(F.desc("score"), "seen")))
    if isinstance(k, int):
        return out.where(F.col("place") <= k).drop("seen")
    return out.join(k, ["qid", "widx"]).where("place <= k").drop("seen")


def padded(top: DataFrame, words: DataFrame, k: DataFrame | int) -> DataFrame:
    """F3 (ledger Q10): ``top`` with rows of no item and score 0 up to k for every word, as the interface returns them."""
    wanted = words.select("qid", "widx").withColumn("k", F.lit(k)) if isinstance(k, int) else k.select("qid", "widx", "k")
    slots = wanted.where("k > 0").select("qid", "widx", F.explode(F.sequence(F.lit(1), F.col("k").cast("int"))).alias("place"))
    full = slots.join(top.drop("k"), ["qid", "widx", "place"], "left")
    return full.select("qid", "widx", "place", "item", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("match", "rel", "conn", "coh", "score")])


def fagin(rows: DataFrame, k: DataFrame | int) -> DataFrame:
    """Fagin's algorithm: rows of the four lists are read until k items stood in all of them; of all that was seen, the k best.

    Scores of any sign stay, nothing is padded, and equal scores keep the order in which items were first seen.
    """
    by_word = Window.partitionBy("qid", "widx")
    out = rows
    for j, c in enumerate(("match", "rel", "conn", "coh")):
        out = out.withColumn(f"at{j}", F.row_number().over(by_word.orderBy(F.desc(c), "rank")))
    ats = [F.col(f"at{j}") for j in range(4)]
    out = out.withColumn("full", F.greatest(*ats)).withColumn("first", F.least(*ats)).withColumn("seen", F.least(*[4 * a + j for j, a in enumerate(ats)]))
    out = out.withColumn("k", F.lit(k)) if isinstance(k, int) else out.join(k.select("qid", "widx", "k"), ["qid", "widx"])
    out = out.withColumn("nth", F.row_number().over(by_word.orderBy("full", "seen")))
    stop = F.coalesce(F.max(F.when(F.col("nth") == F.col("k"), F.col("full"))).over(by_word), F.count(F.lit(1)).over(by_word))
    out = out.withColumn("stop", stop).where("first <= stop and k > 0")
    out = out.withColumn("place", F.row_number().over(by_word.orderBy(F.desc("score"), "seen"))).where("place <= k")
    return out.drop("at0", "at1", "at2", "at3", "full", "first", "seen", "nth", "stop", "k")


def selected(kb: KnowledgeBase, words: DataFrame, rows: DataFrame, par: Parameters = Parameters()) -> DataFrame:
    """The chosen items of weighted rows, with the k of the parameters."""
    k = par.k if isinstance(par.k, int) else C.auto_k(kb, rows.select("qid", "widx", "item"), words)
    return top_k(rows, k)


def search_space(kb: KnowledgeBase, chosen: DataFrame, par: Parameters = Parameters(), questions: DataFrame | None = None) -> DataFrame:
    """(qid, widx, place, item, pos, fact_id, items): the facts of all chosen items, not made distinct.

    With ``bm25_limit`` set, ``questions`` (qid, question) are asked for, and larger spaces shrink to the best facts (F9).
    """
    if isinstance(par.p, int):
        out = G.neighborhood(kb, chosen.select("qid", "widx", "place", "item"), par.p)
    else:
        n = chosen.withColumn("p", C.dynamic_p(par.p, F.count(F.lit(1)).over(Window.partitionBy("qid", "widx"))))
        hubs = n.select("qid", "widx", "place", "item", "p").join(kb.counts(n), "item").withColumn("hub", F.col("freq_o") > F.col("p"))
        out = kb.asked(hubs).join(kb.entries.select("item", "fact_id", "pos", "items"), "item").where("not hub or pos = 0").select("qid", "widx", "place", "item", "pos", "fact_id", "items")
    if par.bm25_limit:
        if questions is None:
            raise ValueError("bm25_limit needs the questions")
        return pruned(kb, out, questions, par.bm25_limit)
    return out


def pruned(kb: KnowledgeBase, space: DataFrame, questions: DataFrame, limit: int) -> DataFrame:
    """of spaces with more than ``limit`` facts the best by BM25 of their words; every occurrence of a fact is a document of its own.

    Facts are put into words once each, and only for spaces that are too large.
    """
    large = space.groupBy("qid").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select("qid")
    rows = keep(space.join(large, "qid").withColumn("did", F.struct("widx", "place", F.expr("pos > 0").alias("o"), "fact_id", "pos", "item")))
    docs = rows.select("qid", "did", "fact_id").join(verbalize(kb, rows), "fact_id").select("qid", "did", "text")
    best = bm25(docs, questions.join(large, "qid"), limit).select("qid", "did")
    return space.join(large, "qid", "left_anti").unionByName(rows.join(best, ["qid", "did"], "left_semi").select(*space.columns))


def result(kb: KnowledgeBase, chosen: DataFrame, space: DataFrame, types: bool = False) -> tuple[DataFrame, DataFrame]:
    """the interface's two tables: (qid, widx, place, kb_item) with kb_item (item (id, label), question_word, score, rank), and
    (qid, widx, place, pos, fact_id, elements) in that order, elements (id, label[, type])."""
    from ..operators.lookup import labelled, names

    named = names(kb, chosen.select("item").where("item is not null").distinct()).select("item", "label")
    word = F.col("word") if "word" in chosen.columns else F.lit(None).cast("string")
    items = chosen.join(named, "item", "left").select("qid", "widx", "place", F.struct(F.struct(F.col("item").alias("id"), F.coalesce("label", F.lit("None")).alias("label")).alias("item"), word.alias("question_word"), "score", F.col("place").alias("rank")).alias("kb_item"))
    elements = labelled(kb, space.select("fact_id", "items").dropDuplicates(["fact_id"]), ["fact_id"], types)
    return items, space.select("qid", "widx", "place", "item", "pos", "fact_id").join(elements, "fact_id")


def verbalize(kb: KnowledgeBase, facts: DataFrame) -> DataFrame:
    """(fact_id, text): labels of the elements, joined by a blank."""
    from ..operators.lookup import labelled

    rows = labelled(kb, facts.select("fact_id", "items").dropDuplicates(["fact_id"]), ["fact_id"])
    return rows.select("fact_id", F.trim(F.array_join(F.transform("elements", lambda e: e["label"]), " ")).alias("text"))


def bm25(docs: DataFrame, questions: DataFrame, limit: int, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """docs (qid, did, text) and questions (qid, question) to the ``limit`` best (qid, did, score, place) of every question.

    A question with no more than ``limit`` docs keeps all. Terms of negative idf get epsilon times the mean idf.
    """
    terms = docs.select("qid", "did", F.explode(X.tokens(F.col("text"))).alias("term"))
    tf = terms.groupBy("qid", "did", "term").agg(F.count(F.lit(1)).alias("tf"))
    length = docs.select("qid", "did", F.size(X.tokens(F.col("text"))).alias("dl"))
    n = length.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    df = tf.groupBy("qid", "term").agg(F.count(F.lit(1)).alias("df")).join(n, "qid").withColumn("idf", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = df.groupBy("qid").agg(F.avg("idf").alias("mean_idf"))
    weight = df.join(mean, "qid").withColumn("idf", F.when(F.col("idf") < 0, epsilon * F.col("mean_idf")).otherwise(F.col("idf"))).select("qid", "term", "idf", "avgdl")
    asked = questions.select("qid", F.explode(X.tokens(F.col("question"))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("times"))
    hits = asked.join(tf, ["qid", "term"]).join(weight, ["qid", "term"]).join(length, ["qid", "did"])
    part = F.col("times") * F.col("idf") * (F.col("tf") * (k1 + 1)) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    score = hits.groupBy("qid", "did").agg(F.sum(part).alias("score"))
    rows = length.join(score, ["qid", "did"], "left").select("qid", "did", F.coalesce("score", F.lit(0.0)).alias("score"))
    order = Window.partitionBy("qid").orderBy(F.desc(F.bround("score", 9)), "did")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def _plain(x: Column) -> Column:
    return F.translate(x, '"+', "")


def evaluate(space: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, hit, n_facts, n_items) of every question; no facts: no hit, zeros."""
    gold = questions.select("qid", F.array_distinct(F.transform("answers", lambda a: F.when(X.is_date(a), X.date_to_timestamp(a)).otherwise(a))).alias("gold"))
    rows = space.select("qid", "fact_id", F.explode("items").alias("x")).join(gold, "qid")
    some = (F.length("x") >= 2) & ~X.is_predicate(F.col("x"))
    hit = some & (F.array_contains("gold", _plain(F.col("x"))) | (X.is_timestamp(F.col("x")) & F.array_contains("gold", X.year_of(F.col("x")))))
    found = rows.groupBy("qid").agg(F.max(hit.cast("int")).alias("hit"), F.countDistinct(F.when(~X.is_predicate(F.col("x")), F.col("x"))).alias("n_items"))
    size = space.groupBy("qid").agg(F.count(F.lit(1)).alias("n_facts"))
    out = questions.select("qid").join(found, "qid", "left").join(size, "qid", "left")
    return out.select("qid", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("hit", "n_facts", "n_items")])


def answer_facts(space: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, fact_id, answer): the facts that hold a gold answer, once for each match (ledger Q26); answers as ``evaluate`` takes them.

    An element that is a timestamp matches by its year and, once more, as it stands.
    """
    gold = questions.select("qid", F.explode(F.array_distinct(F.transform("answers", lambda a: F.when(X.is_date(a), X.date_to_timestamp(a)).otherwise(a)))).alias("answer"))
    x = space.select("qid", "fact_id", F.explode("items").alias("x")).where((F.length("x") >= 2) & ~X.is_predicate(F.col("x")))
    year = F.when(X.is_timestamp(F.col("x")), X.year_of(_plain(F.col("x"))))
    asked = x.select("qid", "fact_id", F.explode(F.array_compact(F.array(_plain(F.col("x")), year))).alias("answer"))
    return asked.join(gold, ["qid", "answer"]).select("qid", "fact_id", "answer")


def summary(results: DataFrame) -> DataFrame:
    """Means over the questions of a benchmark and parameter set."""
    timed = [F.bround(F.avg("seconds"), 2).alias("seconds")] if "seconds" in results.columns else []
    return results.groupBy("benchmark").agg(F.bround(F.avg("hit"), 3).alias("presence"), F.bround(F.avg("n_facts"), 3).alias("facts"), F.bround(F.avg("n_items"), 3).alias("items"), *timed)


def in_thousands(mean: Column) -> Column:
    """A mean size as reports show it, rounded to hundreds: ``1.2k``."""
    return F.concat((F.bround(mean, -2) / 1000).cast("string"), F.lit("k"))


def sweep(kb: KnowledgeBase, words: DataFrame, questions: DataFrame, rows: DataFrame) -> DataFrame:
    """The summary of every preset over the same scored candidates."""
    out = None
    for i, par in enumerate(PRESETS):
        one = evaluate(search_space(kb, selected(kb, words, weighted(rows, par), par), par), questions).withColumn("benchmark", F.lit(f"set{i}"))
        out = one if out is None else out.unionByName(one)
    return summary(out)
