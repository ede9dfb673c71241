"""The micro knowledge base of FIXTURES.md, with its expected values."""

import pytest
from pyspark.sql import functions as F

from stratum.functions import text as X
from stratum.operators import build as B
from stratum.operators import candidates as C
from stratum.operators import graph as G
from stratum.operators import lookup as L
from stratum.sources import readers
from stratum.sources.derived import with_items

FACTS = ["Q1 P31 Q10", "Q2 P31 Q10", 'Q1 P26 Q2 P580 "2018-07-15T00:00:00Z"', "Q3 P106 Q11", "Q3 P31 Q10", "Q3 P50 Q1 P1 Q4", "Q4 P99 P26", "Q5 P5 Q5", "Q10 P279 Q12"]


@pytest.fixture(scope="module")
def kb(spark):
    rows = []
    for i, f in enumerate(FACTS):
        x = f.split(" ")
        rows.append((i, x[0], x[1], x[2], [(x[k], x[k + 1]) for k in range(3, len(x), 2)]))
    facts = spark.createDataFrame(rows, "fact_id long, subject string, predicate string, object string, qualifiers array<struct<p:string,v:string>>")
    texts = spark.createDataFrame([("Q1", ["Q1", "Ann"], ["Annie"], "a person"), ("Q10", ["human"], [], None)], "item string, labels array<string>, aliases array<string>, description string")
    return B.KnowledgeBase(with_items(facts), texts)


def items(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "item string")


def test_frequency(spark, kb):
    got = {r.item: (r.freq_s, r.freq_o) for r in L.frequency(kb, items(spark, "Q1", "Q3", "Q10", "P26", "P580", "nothing")).collect()}
    assert got == {"Q1": (2, 1), "Q3": (3, 0), "Q10": (1, 3), "P26": (0, 2), "P580": (0, 1), "nothing": (0, 0)}


def test_neighbors(kb):
    near = {r[0]: set(r[1]) for r in kb.adj.groupBy("item").agg(F.collect_set("neighbor")).collect()}
    assert near["Q1"] == {"Q1", "Q2", "Q3", "Q4", "Q10"} and near["Q5"] == {"Q5"} and near["P26"] == {"Q1", "Q2", "Q4"}


def test_connectivity_and_distance(spark, kb):
    want = {("Q1", "Q2"): 1, ("P26", "Q2"): 1, ("Q2", "P26"): 1, ("Q1", "Q1"): 1, ("Q2", "Q4"): 0.5, ("Q1", "Q12"): 0.5, ("P26", "P31"): 0.5, ("P26", "P26"): 0.5, ("Q4", "Q12"): 0, ("Q1", "Q5"): 0, ("P5", "P31"): 0}
    got = {(r.i1, r.i2): r.connectivity for r in G.connectivity(kb, spark.createDataFrame(list(want), "i1 string, i2 string")).collect()}
    assert got == want
    far = {("Q4", "Q12"): 3, ("Q11", "Q12"): 3, ("Q1", "Q1"): 1, ("Q1", "Q5"): None}
    assert {(r.i1, r.i2): r.distance for r in G.distance(kb, spark.createDataFrame(list(far), "i1 string, i2 string")).collect()} == far


@pytest.mark.parametrize("item,p,want", [("Q1", 1000, [0, 2, 5]), ("Q10", 3, [0, 1, 4, 8]), ("Q10", 2, [8]), ("P26", 1000, [2, 6]), ("Q5", 1000, [7, 7])])
def test_neighborhood(spark, kb, item, p, want):
    assert sorted(r.fact_id for r in G.neighborhood(kb, items(spark, item), p).collect()) == want


def test_two_hop_holds_one_hop(spark, kb):
    rows = G.two_hop(kb, items(spark, "Q1")).collect()
    assert sorted(r.fact_id for r in rows if r.hop == 1) == [0, 2, 5] and all("Q1" not in r["items"] for r in rows if r.hop == 2)


def test_types_and_names(spark, kb):
    assert [r.type_id for r in L.types(kb, items(spark, "Q3")).orderBy("fact_id").collect()] == ["Q11", "Q10"]
    assert L.top_type(kb, items(spark, "Q3")).first().type_id == "Q10"
    got = {r.item: r for r in L.names(kb, items(spark, "Q1", "Q7", '"2018-07-15T00:00:00Z"')).collect()}
    assert got["Q1"].label == "Ann" and got["Q7"].labels == ["Q7"] and got["Q7"].description == "None" and got['"2018-07-15T00:00:00Z"'].label == "15 July 2018"


def test_etl_round_trip(spark, tmp_path):
    lines = ["Q1,P26-1,Q2", "P26-1,P580,2018", "P26-1,P580,2018", "Q1,P31,Q10", f"Q1,P1,{'x' * 40}", "Q2,P2,a,b"]
    (tmp_path / "t.csv").write_text("\n".join(lines) + "\n")
    facts = B.assemble(readers.read_triples(spark, str(tmp_path / "t.csv")))
    got = sorted(tuple(r["items"]) for r in facts.collect())
    assert got == [("Q1", "P26", "Q2", "P580", "2018"), ("Q1", "P31", "Q10"), ("Q2", "P2", "a,b")]
    codes = {r.item: r.code for r in B.dictionary(facts).collect()}
    assert codes["Q1"] == 10000 and min(c for i, c in codes.items() if i[0] == "P") == 1 and codes["2018"] < 0
    flat = [(i, x) for i, x in enumerate(x for f in got for x in f)]
    back = readers.parse_flat(spark.createDataFrame(flat, "pos long, item string"))
    assert sorted(tuple(r["items"]) for r in back.collect()) == got


def test_dates_and_dynamic_p(spark):
    one = spark.range(1).select(X.date_to_timestamp(F.lit("15 July 2018")), X.year_to_timestamp(F.lit("1939")), *[C.dynamic_p(f"DYNAMIC{i}", F.lit(2)) for i in range(1, 7)]).first()
    assert tuple(one) == ("2018-07-15T00:00:00Z", "1939-01-01T00:00:00Z", 10000, 1000, 10000, 1000, 100, 1000)


#: Queries that must not write the facts or the index, which are many times the tables they are made from.
LEAN = [
    "frequency",
    "connected_space",
    "bm25",
    "types",
    "triple_pattern",
    "kb_qualifiers",
    "kb_facts",
    "clean_values",
]


@pytest.mark.parametrize("query", LEAN)
def test_facts_are_not_written(spark, monkeypatch, query):
    """Tables of the derived knowledge base that hold whole facts stay views; what is written is what was asked for."""
    from stratum import registry

    wrote = []
    for module in (B, G, registry):
        monkeypatch.setattr(module, "keep", lambda df, keep=module.keep: (wrote.append(df.columns), keep(df))[1])
    monkeypatch.setattr(registry, "_bases", {})
    monkeypatch.setattr(registry, "_tables", {})
    assert registry.queries()[query](spark, "/root/testdata/sf0.001").count() > 0
    assert not [c for c in wrote if "items" in c or "qualifiers" in c]


#: Queries that look up few items, so that not all items of the knowledge base are counted for them.
FEW_COUNTED = [
    "graph_components",
    "coherence_score",
    "relevance",
]


@pytest.mark.parametrize("query", FEW_COUNTED)
def test_few_items_are_counted_alone(spark, monkeypatch, query):
    from stratum import registry

    monkeypatch.setattr(registry, "_bases", {})
    monkeypatch.setattr(registry, "_tables", {})
    assert registry.queries()[query](spark, "/root/testdata/sf0.001").count() > 0
    (kb,) = registry._bases.values()
    assert "freq" not in kb.__dict__
    some = kb.texts.where("item like 'Q4%'").select("item").union(items(spark, "P31", "nothing"))
    assert sorted(kb.counts(some).collect()) == sorted(kb.freq.join(some, "item", "left_semi").collect())


def test_codes(spark):
    from stratum.functions import codes as N

    names = ["Q0", "Q5", "Q50", "Q500", "Q6", "Q1000000001", "Q9999999999", "Q10000000000", "P0", "P31"]
    got = {r.item: r for r in items(spark, *names, "Q05", "P", "12", "Q1-2", "Q123456789012345678").withColumn("code", N.of_item(F.col("item"))).withColumn("back", N.to_item(F.col("code"))).collect()}
    assert all(got[n].back == n for n in names) and [n for n in got if got[n].code is None] == [n for n in got if n not in names]
    entities = [n for n in names if n[0] == "Q"]
    assert sorted(entities) == sorted(entities, key=lambda n: got[n].code) and got["P31"].code == N.of_predicate(31)
    same = items(spark, *entities).select("item", N.of_entity(F.expr("try_cast(substring(item, 2) as bigint)")).alias("code")).collect()
    assert all(r.code == got[r.item].code for r in same)


def test_adjacency_is_not_written(spark, monkeypatch):
    """neighbours of all items are counted by parts; no table of pairs is written."""
    from stratum import registry

    wrote = []
    monkeypatch.setattr(B, "keep", lambda df, keep=B.keep: (wrote.append(df.columns), keep(df))[1])
    monkeypatch.setattr(registry, "_bases", {})
    monkeypatch.setattr(B, "SLICED_FACTS", 1)
    got = sorted(registry.kb_adjacency(spark, "/root/testdata/sf0.001").collect())
    assert not [c for c in wrote if "neighbor" in c]
    (kb,) = registry._bases.values()
    assert got == sorted(B.adjacency(kb.facts).groupBy("item").agg(F.count(F.lit(1)), F.min("neighbor"), F.max("neighbor")).collect())


#: Queries on pairs of which one side has few items: neighbours of the other side are never written, nor those of predicates.
FEW_AND_MANY = [
    "connectivity",
    "connectivity_of_sets",
    "connect",
]


@pytest.mark.parametrize("query", FEW_AND_MANY)
def test_pairs_with_few_items_write_no_neighbors(spark, monkeypatch, query):
    from stratum import registry

    wrote = []
    for module in (B, G):
        monkeypatch.setattr(module, "keep", lambda df, keep=module.keep: (wrote.append((df.columns, keep(df))), wrote[-1][1])[1])
    monkeypatch.setattr(registry, "_bases", {})
    monkeypatch.setattr(B, "SLICED_FACTS", 1)
    got = registry.queries()[query](spark, "/root/testdata/sf0.001").collect()
    (kb,) = registry._bases.values()
    some = kb.texts.where("item like 'Q4%'").select("item")
    assert sum(df.count() for columns, df in wrote if "neighbor" in columns) < kb.near(some).count() / 2
    if query in ("connectivity", "connectivity_of_sets"):
        pairs = registry._some_pairs(kb).where("i1 not like 'Q4%' or i1 like '%1'")
        monkeypatch.setattr(G, "MASK_BITS", 1)  # too few for either side: pairs go the other way
        want = {(r.i1, r.i2): r.connectivity for r in getattr(G, query)(kb, pairs).collect()}
        assert want and want == {k: v for k, v in ((tuple(r)[:2], r.connectivity) for r in got) if k in want}


def test_entry_imports():
    import __spark_entry__ as e

    assert "search_space" in e.queries() and set(e.oracle_sql()) <= set(e.queries())
