"""Neighbourhoods, connectivity, paths and distance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codes as N
from ..sources.readers import ENTITY
from ..sources.store import keep
from .build import MASK_BITS, SENT_ITEMS, KnowledgeBase

MAX_DEPTH = 7


def neighborhood(kb: KnowledgeBase, items: DataFrame, p: int | None = 1000) -> DataFrame:
    """The facts of every item, once per occurrence; all facts in which it is no subject go if they are over p."""
    facts = kb.entries.select("item", "fact_id", "pos", "items")
    if p:
        hubs = kb.counts(items).where(F.col("freq_o") > p).select("item", F.lit(True).alias("hub"))
        items = kb.asked(items.join(hubs, "item", "left"))
        return items.join(facts, "item").where("hub is null or pos = 0").drop("hub")
    return kb.asked(items).join(facts, "item")


def two_hop(kb: KnowledgeBase, items: DataFrame, p: int | None = 1000, drop_start_facts: bool = True) -> DataFrame:
    """One hop, and for each distinct entity in it its own one hop, without facts that hold the start item."""
    one = neighborhood(kb, items.select("item"), p)
    via = one.select(F.col("item").alias("start"), F.explode("items").alias("item")).where("item rlike '^Q[0-9]+$' and item <> start").distinct()
    two = neighborhood(kb, via, p)
    if drop_start_facts:
        two = two.where(~F.array_contains(F.col("items"), F.col("start")))
    first = one.select(F.col("item").alias("start"), F.lit(1).alias("hop"), F.col("item").alias("via"), "fact_id", "items")
    return first.unionByName(two.select("start", F.lit(2).alias("hop"), F.col("item").alias("via"), "fact_id", "items"))


def neighbors(kb: KnowledgeBase, items: DataFrame, indexed: bool = True) -> DataFrame:
    """C11: distinct (item, neighbor): the stored entities, or without the index all elements of all facts, predicates and literals too."""
    if indexed:
        items = items.select("item").distinct()
        return items.join(kb.near(items), "item")
    rows = kb.asked(items.select("item").distinct()).join(kb.entries.select("item", "items"), "item")
    return rows.select("item", F.explode("items").alias("neighbor")).distinct()


def _smaller_first(kb: KnowledgeBase, pairs: DataFrame) -> DataFrame:
    """Append a and b: the pair's items, that with fewer facts first, so that hubs are looked into and never expanded."""
    n = kb.counts(_ends(pairs)).select("item", (F.col("freq_s") + F.col("freq_o")).alias("n"))
    for c in ("i1", "i2"):
        pairs = pairs.join(n.select(F.col("item").alias(c), F.col("n").alias(f"n_{c}")), c, "left")
    first = F.coalesce("n_i1", F.lit(0)) <= F.coalesce("n_i2", F.lit(0))
    return pairs.withColumn("a", F.when(first, F.col("i1")).otherwise(F.col("i2"))).withColumn("b", F.when(first, F.col("i2")).otherwise(F.col("i1"))).drop("n_i1", "n_i2")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("i1").alias("item")).union(pairs.select("i2")).distinct()


def shared_neighbors(kb: KnowledgeBase, pairs: DataFrame, adj: DataFrame | None = None) -> DataFrame:
    """(i1, i2, middle) for every common neighbour of a pair. ``adj``: neighbours of the pairs' items, if at hand."""
    pairs = _smaller_first(kb, pairs.select("i1", "i2").distinct())
    if adj is None and kb.views:
        # of views, neighbours of the items with more facts are looked for only among those of the others
        pairs = keep(pairs)
        near = keep(pairs.join(kb.near(pairs.select(F.col("a").alias("item"))).select(F.col("item").alias("a"), F.col("neighbor").alias("middle")), "a"))
        adj = kb.near(pairs.select(F.col("b").alias("item")), near.select(F.col("middle").alias("item")))
    else:
        adj = kb.near(_ends(pairs)) if adj is None else adj
        near = pairs.join(adj.select(F.col("item").alias("a"), F.col("neighbor").alias("middle")), "a")
    return near.join(adj.select(F.col("item").alias("b"), F.col("neighbor").alias("middle")), ["b", "middle"], "left_semi").select("i1", "i2", "middle")


def _linked(kb: KnowledgeBase, pairs: DataFrame, literals: bool = False) -> DataFrame | None:
    """(i1, i2, near, shared) of distinct pairs whose one side has few items, of views; None for other pairs.

    ``near``: both are in one fact; ``shared``: some entity shares a fact with each of them (with ``literals`` a literal too that does not begin with P).
    Each of the few items is a bit. Every item gets the bits that it shares facts with, and then the bits of all its neighbours; so the
    neighbours of the many items are met once for all the few, and none of them is written.
    """
    if not kb.views:
        return None
    for few, many in (("i2", "i1"), ("i1", "i2")):
        names = pairs.select(few).distinct().limit(MASK_BITS + 1).select(few, N.of_item(F.col(few)).alias("code")).collect()
        if len(names) <= MASK_BITS:
            break
    else:
        return None
    bits = {r["code"]: 1 << k for k, r in enumerate(names) if r["code"] is not None}
    if not bits:
        return pairs.select("i1", "i2", F.lit(False).alias("near"), F.lit(False).alias("shared"))
    spark = pairs.sparkSession
    few_bits = F.broadcast(spark.createDataFrame(list(bits.items()), "b long, bit long"))
    marks = kb.marks(bits)
    ends = keep(pairs.select(N.of_item(F.col(many)).alias("code")).where("code is not null").distinct())
    others = keep(ends.where(~F.col("code").isin(list(bits))))
    own = keep(marks.join(F.broadcast(ends) if ends.count() <= SENT_ITEMS else ends, "code"))
    # a few's own neighbours are those that have its bit
    sets = marks.where("code >= 0").select("mask").distinct()
    more = [kb.shared_marks(others, marks), own.where("code >= 0")]
    if literals:
        texts = kb.marked(bits).select("codes", "items", "mask", F.posexplode("codes").alias("pos", "x")).where("x is null").select("codes", "mask", F.get("items", F.col("pos")).alias("text")).where("text not like 'P%' and text <> ''")
        said = keep(texts.groupBy("text").agg(F.bit_or("mask").alias("mask")))
        sets = sets.union(said.select("mask").distinct())
        mine = texts.select("text", F.explode("codes").alias("code")).join(F.broadcast(others) if others.count() <= SENT_ITEMS else others, "code").distinct()
        more.append(mine.join(said, "text").select("code", "mask"))
    more.append(sets.join(few_bits, F.expr("mask & bit <> 0")).select(F.col("b").alias("code"), "mask"))
    shared = more[0]
    for m in more[1:]:
        shared = shared.unionByName(m.select("code", "mask"))
    shared = shared.groupBy("code").agg(F.bit_or("mask").alias("far"))
    rows = pairs.select("i1", "i2", N.of_item(F.col(many)).alias("code"), N.of_item(F.col(few)).alias("b")).join(few_bits, "b", "left").join(own, "code", "left").join(shared, "code", "left")
    has = lambda m: F.coalesce(F.col(m).bitwiseAND(F.col("bit")) != 0, F.lit(False))
    return rows.select("i1", "i2", has("mask").alias("near"), has("far").alias("shared"))


def connectivity(kb: KnowledgeBase, pairs: DataFrame) -> DataFrame:
    """Pairs (i1, i2) with 1 if one is in the other's neighbours, 0.5 if they share one, else 0.

    Pairs of weight 1 are settled first; only the others are expanded, from the item with fewer facts.
    """
    pairs = pairs.select("i1", "i2").distinct()
    linked = _linked(kb, pairs)
    if linked is not None:
        one = F.col("near") & (F.col("i1").rlike(ENTITY) | F.col("i2").rlike(ENTITY))  # only entities are neighbours
        return linked.select("i1", "i2", F.when(one, 1.0).when(F.col("shared"), 0.5).otherwise(0.0).alias("connectivity"))
    adj = kb.near(_ends(pairs))
    straight = pairs.join(adj.select(F.col("item").alias("i1"), F.col("neighbor").alias("i2")), ["i1", "i2"], "left_semi")
    back = pairs.join(adj.select(F.col("item").alias("i2"), F.col("neighbor").alias("i1")), ["i1", "i2"], "left_semi")
    ones = keep(straight.unionByName(back).distinct())
    halves = shared_neighbors(kb, pairs.join(ones, ["i1", "i2"], "left_anti"), adj).select("i1", "i2").distinct()
    some = ones.withColumn("w", F.lit(1.0)).unionByName(halves.withColumn("w", F.lit(0.5)))
    return pairs.join(some, ["i1", "i2"], "left").select("i1", "i2", F.coalesce("w", F.lit(0.0)).alias("connectivity"))


def connectivity_of_sets(kb: KnowledgeBase, pairs: DataFrame, test: str = "smaller") -> DataFrame:
    """The other backends' test on sets of all elements of all facts, taken from one side only.

    ``test``: 'smaller' looks into the smaller set (ties: the second item's), 'second' into the second item's. Predicates do not count as shared.
    """
    pairs = pairs.select("i1", "i2").distinct()
    linked = _linked(kb, pairs, literals=True) if test == "smaller" else None  # a literal has no facts, so it is the smaller, and holds nothing
    if linked is not None:
        return linked.select("i1", "i2", F.when(F.col("near"), 1.0).when(F.col("shared"), 0.5).otherwise(0.0).alias("connectivity"))
    items = pairs.select(F.col("i1").alias("item")).union(pairs.select("i2"))
    near = keep(neighbors(kb, items, indexed=False))
    size = near.groupBy("item").count()
    p = pairs.join(size.select(F.col("item").alias("i1"), F.col("count").alias("n1")), "i1", "left").join(size.select(F.col("item").alias("i2"), F.col("count").alias("n2")), "i2", "left").na.fill(0, ["n1", "n2"])
    into_first = (F.col("n1") < F.col("n2")) if test == "smaller" else F.lit(False)
    p = p.select("i1", "i2", F.when(into_first, F.col("i1")).otherwise(F.col("i2")).alias("of"), F.when(into_first, F.col("i2")).otherwise(F.col("i1")).alias("what"), F.when(F.col("n1") <= F.col("n2"), F.col("i1")).otherwise(F.col("i2")).alias("a"), F.when(F.col("n1") <= F.col("n2"), F.col("i2")).otherwise(F.col("i1")).alias("b"))
    ones = p.join(near.select(F.col("item").alias("of"), F.col("neighbor").alias("what")), ["of", "what"], "left_semi").select("i1", "i2", F.lit(1.0).alias("w"))
    shared = near.where("neighbor not like 'P%' and neighbor <> ''")
    halves = p.join(shared.select(F.col("item").alias("a"), "neighbor"), "a").join(shared.select(F.col("item").alias("b"), "neighbor"), ["b", "neighbor"], "left_semi").select("i1", "i2", F.lit(0.5).alias("w"))
    best = ones.unionByName(halves).groupBy("i1", "i2").agg(F.max("w").alias("w"))
    return pairs.join(best, ["i1", "i2"], "left").select("i1", "i2", F.coalesce("w", F.lit(0.0)).alias("connectivity"))


def one_hop_paths(kb: KnowledgeBase, pairs: DataFrame) -> DataFrame:
    """The facts of the pair's item with fewer facts (ties: i1) that hold the other, once per occurrence (ledger Q5)."""
    facts = kb.entries.select(F.col("item").alias("a"), "fact_id", "items")
    return kb.asked(_smaller_first(kb, pairs.select("i1", "i2")), "a").join(facts, "a").where(F.array_contains(F.col("items"), F.col("b"))).select("i1", "i2", "fact_id", "items")


def two_hop_paths(kb: KnowledgeBase, pairs: DataFrame, max_middle: int | None = None) -> DataFrame:
    """C20: (i1, i2, middle, side, fact_id, items): for every shared neighbour the facts with i1 ('l') and those with i2 ('r').

    ``max_middle`` leaves out neighbours with more facts than that (ledger Q3).
    """
    both = shared_neighbors(kb, pairs)
    if max_middle:
        both = both.join(kb.freq.where(F.col("freq_s") + F.col("freq_o") > max_middle).select(F.col("item").alias("middle")), "middle", "left_anti")
    both = keep(both)
    steps = both.select(F.col("i1").alias("end"), "middle").union(both.select("i2", "middle")).distinct()
    facts = keep(one_hop_paths(kb, steps.select(F.col("end").alias("i1"), F.col("middle").alias("i2"))).select(F.col("i1").alias("end"), F.col("i2").alias("middle"), "fact_id", "items"))
    side = lambda c, name: both.withColumn("end", F.col(c)).join(facts, ["end", "middle"]).select("i1", "i2", "middle", F.lit(name).alias("side"), "fact_id", "items")
    return side("i1", "l").unionByName(side("i2", "r"))


def connect(kb: KnowledgeBase, pairs: DataFrame, hop: float | None = None, max_middle: int | None = None) -> DataFrame:
    """(i1, i2, hop, middle, side, fact_id, items): the paths of the pair's own connectivity, or of a forced hop (1 or 0.5; else none)."""
    rows = pairs.select("i1", "i2").distinct()
    if hop is None:
        w = keep(connectivity(kb, rows))
        near, far = (w.where(F.col("connectivity") == x).select("i1", "i2") for x in (1.0, 0.5))
    else:
        near, far = (rows if hop == x else rows.limit(0) for x in (1, 0.5))
    none = F.lit(None).cast("string")
    one = one_hop_paths(kb, near).select("i1", "i2", F.lit(1.0).alias("hop"), none.alias("middle"), none.alias("side"), "fact_id", "items")
    return one.unionByName(two_hop_paths(kb, far, max_middle).withColumn("hop", F.lit(0.5)))


def distance(kb: KnowledgeBase, pairs: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Hops between i1 and i2, null beyond the depth; an item with facts is 1 from itself.

    The first two hops come from ``connectivity``'s joins. Further on the search is breadth first from the i1 of
    pairs that are still open, all at once; what is settled goes, and a level that reaches nothing new ends it.
    """
    pairs = pairs.select("i1", "i2").distinct()
    step = kb.adj.select(F.col("item").alias("at"), F.col("neighbor").alias("to"))
    done = keep(pairs.join(kb.adj.select(F.col("item").alias("i1"), F.col("neighbor").alias("i2")), ["i1", "i2"], "left_semi").withColumn("d", F.lit(1)))
    left = keep(pairs.where("i2 like 'Q%'").join(done, ["i1", "i2"], "left_anti"))  # nothing else is in anyone's neighbours
    # an entity at the far end has its neighbours on either side, so that two hops are a shared neighbour
    if max_depth > 1 and not left.isEmpty():
        two = keep(shared_neighbors(kb, left).select("i1", "i2").distinct().withColumn("d", F.lit(2)))
        done, left = done.unionByName(two), keep(left.join(two, ["i1", "i2"], "left_anti"))
    if max_depth > 2 and not left.isEmpty():
        starts = left.select("i1").distinct()
        seen = keep(starts.join(kb.adj.select(F.col("item").alias("i1"), F.col("neighbor").alias("at")), "i1"))
        front = seen
        for depth in range(2, max_depth + 1):
            reached = front.join(step, "at").select("i1", F.col("to").alias("at")).distinct()
            front = keep(reached.join(seen, ["i1", "at"], "left_anti"))
            if front.isEmpty():
                break
            hits = keep(left.join(front.select("i1", F.col("at").alias("i2")), ["i1", "i2"], "left_semi").withColumn("d", F.lit(depth)))
            done, left = done.unionByName(hits), keep(left.join(hits, ["i1", "i2"], "left_anti"))
            if left.isEmpty():
                break
            open_ = left.select("i1").distinct()
            front, seen = front.join(open_, "i1", "left_semi"), keep(seen.unionByName(front).join(open_, "i1", "left_semi"))
    return pairs.join(done, ["i1", "i2"], "left").select("i1", "i2", F.col("d").alias("distance"))


def search_space_of(kb: KnowledgeBase, tuples: DataFrame, p: int | None = 1000) -> DataFrame:
    """Tuples (tid, item): the neighbourhoods of a tuple's items together, not made distinct."""
    return neighborhood(kb, tuples, p)


def connected_space(kb: KnowledgeBase, tuples: DataFrame, p: int | None = 1000) -> DataFrame:
    """Of these, the facts that hold more than one distinct item of the tuple."""
    members = tuples.groupBy("tid").agg(F.collect_set("item").alias("members"))  # a tuple is a question's few items
    return search_space_of(kb, tuples, p).join(members, "tid").where(F.size(F.array_intersect("items", "members")) > 1).drop("members")


def context_graph(kb: KnowledgeBase, tuples: DataFrame, p: int = 1000, hub: int = 10_000) -> DataFrame:
    """The search space, and for frequent items the facts of other items' neighbours that hold them."""
    base = search_space_of(kb, tuples, p).select("tid", "fact_id", "items")
    frequent = tuples.join(kb.freq.where(F.col("freq_o") > p).select("item"), "item").select("tid", F.col("item").alias("frequent"))
    anchors = tuples.join(kb.freq.where(F.col("freq_o") <= p).select("item"), "item")
    near = anchors.join(kb.near(anchors), "item").select("tid", F.col("neighbor").alias("item")).distinct().join(kb.freq.where(F.col("freq_o") <= hub).select("item"), "item", "left_semi")
    more = kb.asked(near.join(frequent, "tid")).join(kb.index.select("item", "fact_id", "items"), "item").where(F.array_contains(F.col("items"), F.col("frequent")))
    return base.unionByName(more.select("tid", "fact_id", "items"))
