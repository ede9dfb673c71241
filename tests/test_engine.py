"""The interface, files to a knowledge base, flat lists, and operators that no SQL covers, on the micro knowledge base."""

import json

import pytest
from pyspark.sql import functions as F

from stratum.api import Engine
from stratum.operators import build as B
from stratum.operators import candidates as C
from stratum.operators import graph as G
from stratum.operators import lookup as L
from stratum.operators import scores as S
from stratum.plans import search_space as P
from stratum.sources import readers

LINES = [
    "Q1,P31,Q10", "Q2,P31,Q10", "Q1,P26-1,Q2", 'P26-1,P580,"2018-07-15T00:00:00Z"', "Q3,P106,Q11", "Q3,P31,Q10", "Q3,P50-2,Q1", "P50-2,P1,Q4", "Q4,P99,P26", "Q5,P5,Q5", "Q10,P279,Q12",
]
NAMES = {"Q1": "Ann Lee", "Q2": "Bob", "Q3": "Cat", "Q4": "Dan", "Q5": "Eve", "Q10": "human", "Q11": "writer", "Q12": "species", "P26": "spouse", "P50": "author"}


@pytest.fixture(scope="module")
def kb(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("kb")
    (folder / "t.csv").write_text("\n".join(LINES) + "\n")
    (folder / "l.json").write_text("\n".join(json.dumps({"item": k, "labels": [v], "aliases": [v[0]], "description": None}) for k, v in NAMES.items()))
    built = B.build(readers.read_triples(spark, str(folder / "t.csv")), readers.read_labels(spark, str(folder / "l.json")))
    built.save(str(folder / "saved"))
    return B.KnowledgeBase.load(spark, str(folder / "saved"))


@pytest.fixture(scope="module")
def engine(spark, kb, tmp_path_factory):
    path = tmp_path_factory.mktemp("vec") / "v.txt"
    path.write_text("4 2\nbob 1 0\ncat 0.5 1\nhuman 0 1\nENTITY/Ann_Lee 1 1\n")
    words, titles = readers.read_vectors(spark, str(path))
    assert {r.word: r.vec for r in words.collect()} == {"bob": [1.0, 0.0], "cat": [0.5, 1.0], "human": [0.0, 1.0]} and titles.first().title == "Ann Lee"
    return Engine(spark, kb, words)


def test_files_to_facts_and_back(kb):
    facts = {tuple(r["items"]) for r in kb.facts.collect()}
    assert facts == {("Q1", "P31", "Q10"), ("Q2", "P31", "Q10"), ("Q1", "P26", "Q2", "P580", '"2018-07-15T00:00:00Z"'), ("Q3", "P106", "Q11"), ("Q3", "P31", "Q10"), ("Q3", "P50", "Q1", "P1", "Q4"), ("Q4", "P99", "P26"), ("Q5", "P5", "Q5"), ("Q10", "P279", "Q12")}
    order = [tuple(r["items"]) for r in kb.facts.orderBy("fact_id").collect()]
    for n in (0, 2, 3, 11, 100):
        want, total = [], 0
        for f in order:
            total += len(f)
            if total <= n:
                want.append(f)
        assert [tuple(r["items"]) for r in B.first_elements(kb.facts, n).orderBy("fact_id").collect()] == want
    codes = B.dictionary(kb.facts)
    assert {r["item"] for r in L.decode(B.rekey(kb.texts, codes), codes).collect()} == set(NAMES)


@pytest.mark.parametrize("slices", [1, 7, 40])
def test_flat_list_in_slices(spark, slices, tmp_path):
    """Facts of many lengths, with predicates as objects and as qualifiers' values, cut anywhere."""
    facts = [["Q1", "P1", "P2"], ["Q2", "P1", "x", "P3", "Q9", "P4", "P5"], ["Q3", "P1", "Q3"], ["Q4", "P1", "Q1", "P3", "12"]] * 25
    flat = [x for f in facts for x in f]
    tokens = spark.createDataFrame(list(enumerate(flat)), "pos long, item string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(slices))
    try:
        got = readers.parse_flat(tokens).orderBy("fact_id").collect()
        assert [r["items"] for r in got] == facts and [r["fact_id"] for r in got] == list(range(100))
        assert readers.parse_flat(tokens, drop_last=True).count() == 99
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    (tmp_path / "flat.txt").write_text("\n".join(flat))
    assert [r["items"] for r in readers.parse_flat(readers.read_flat(spark, str(tmp_path / "flat.txt"))).orderBy("fact_id").collect()] == facts
    assert readers.parse_flat(tokens.limit(0)).count() == 0


def test_tasks(engine):
    """The eleven kinds of tasks that a batch may hold, and one that fails."""
    tasks = [
        {"task": "get_label", "kb_item": "Q1"}, {"task": "get_labels", "kb_item": "Q1"}, {"task": "get_aliases", "kb_item": "Q9"}, {"task": "get_description", "kb_item": "Q1"}, {"task": "get_types", "kb_item": "Q3"},
        {"task": "get_frequency", "kb_item": "Q1"}, {"task": "get_neighborhood", "kb_item": "Q1", "p": 1000, "include_labels": True}, {"task": "get_neighborhood_two_hop", "kb_item": "Q11", "p": 1000, "include_labels": False},
        {"task": "connect", "kb_item1": "Q1", "kb_item2": "Q2"}, {"task": "connect", "kb_item1": "Q2", "kb_item2": "Q4"}, {"task": "get_search_space", "question": "Is Bob the human spouse of Ann Lee?", "parameters": {"p": 1000}, "include_labels": True},
        {"task": "no_such_thing"}, {"task": "get_type", "kb_item": "Q3"}, {"task": "connectivity_check", "kb_item1": "Q4", "kb_item2": "Q12"}, {"task": "connect", "kb_item1": "Q4", "kb_item2": "Q12"},
    ]
    got = engine.process_tasks(tasks)
    assert got[:6] == ["Ann Lee", ["Ann Lee"], ["Q9"], "None", [{"id": "Q11", "label": "writer"}, {"id": "Q10", "label": "human"}], [2, 1]]
    assert [x["id"] for x in got[6][0]] == ["Q1", "P31", "Q10"] and got[6][1][4] == {"id": '"2018-07-15T00:00:00Z"', "label": "15 July 2018"} and len(got[6]) == 3
    assert got[7][0] == ["Q3", "P106", "Q11"] and ["Q3", "P31", "Q10"] in got[7] and not any("Q11" in f for f in got[7][1:])
    assert got[8] == [["Q1", "P26", "Q2", "P580", '"2018-07-15T00:00:00Z"']]
    assert got[9] == [[[["Q1", "P26", "Q2", "P580", '"2018-07-15T00:00:00Z"']], [["Q3", "P50", "Q1", "P1", "Q4"]]]]
    chosen = [(x["question_word"], x["item"]["id"]) for x in got[10]["kb_item_tuple"]]
    assert {("ann lee", "Q1"), ("bob", "Q2"), ("human", "Q10"), ("spouse", "P26")} <= set(chosen) and len(got[10]["search_space"]) == 3 + 2 + 4 + 2
    assert got[11] is None and got[12] == {"id": "Q10", "label": "human"} and got[13] == 0.0 and got[14] is None
    assert engine.handle("frequency", {"item": "Q1"}) == [2, 1] and engine.handle("neighborhood", {}) == [] and engine.handle("item_to_label", {}) is None


def test_parameters_do_not_leak(engine):
    assert engine.parameters({"p_setting": "DYNAMIC1", "bm25_limit": False}).p == "DYNAMIC1" and engine.parameters().p == 1000


def test_forced_hops_and_middles(spark, kb):
    pair = spark.createDataFrame([("Q1", "Q2")], "i1 string, i2 string")
    middles = {r.middle for r in G.connect(kb, pair, hop=0.5).collect()}
    assert middles == {"Q1", "Q2", "Q10"} and {r.middle for r in G.two_hop_paths(kb, pair, max_middle=3).collect()} == {"Q1", "Q2"}
    assert G.connect(kb, pair, hop=3).count() == 0 and G.connect(kb, spark.createDataFrame([("Q5", "Q5")], "i1 string, i2 string")).count() == 2  # once for each time it occurs


def test_fagin_and_padding_against_plain_loops(spark):
    import random

    rng, rows = random.Random(2), []
    for q in range(40):
        for r in range(1, 8):
            m, x, c, h = 1 / (r + 1), rng.choice([0.0, 0.1, 0.2]), rng.choice([0.0, 0.5, 1.0]), rng.choice([-0.2, 0.0, 0.3])
            rows.append((q, 0, f"Q{r}", r, m, x, c, h, 0.4 * m + 0.3 * x + 0.2 * c + 0.1 * h - 0.2))
    df = spark.createDataFrame(rows, "qid int, widx int, item string, rank int, match double, rel double, conn double, coh double, score double")
    got = {}
    for r in P.fagin(df, 3).orderBy("qid", "place").collect():
        got.setdefault(r.qid, []).append(r["item"])
    for q in range(40):
        own = [r for r in rows if r[0] == q]
        queues = [sorted(own, key=lambda r: -r[j]) for j in (4, 5, 6, 7)]
        seen = {}
        for i in range(7):
            for z in queues:
                seen[z[i][2]] = seen.get(z[i][2], 0) + 1
            if sum(n == 4 for n in seen.values()) >= 3:
                break
        by = {r[2]: r[8] for r in own}
        assert got[q] == sorted(seen, key=lambda x: -by[x])[:3]
    top = P.top_k(df, 7)
    pad = P.padded(top, df.select("qid", "widx").distinct(), 9).collect()
    assert len(pad) == 40 * 9 and sum(r["item"] is None for r in pad) == 40 * 9 - top.count()


def test_components_of_long_chains_and_the_bound_of_rounds(spark):
    edges = spark.createDataFrame([(1, f"a{i:03d}", f"a{i + 1:03d}", 1.0) for i in range(120)] + [(1, "b", "b", 1.0), (2, "a000", "a119", 1.0)], "qid int, i1 string, i2 string, w double")
    got = {(r.qid, r["item"]): r.root for r in S.graph_components(edges).collect()}
    assert {v for (q, _), v in got.items() if q == 1} == {"a000", "b"} and got[2, "a119"] == "a000"
    with pytest.raises(RuntimeError):
        S.graph_components(edges, rounds=2)


def test_title_vectors_before_labels(spark, kb):
    word_vec = spark.createDataFrame([("ann", [1.0, 0.0]), ("bob", [0.0, 2.0])], "word string, vec array<double>")
    titles = spark.createDataFrame([("Q1", "Ann%27s_page"), ("P26", "Ann%27s_page")], "item string, title string")
    title_vec = spark.createDataFrame([("Ann's page", [3.0, 4.0])], "title string, vec array<double>")
    found = spark.createDataFrame([("Q1",), ("Q2",), ("P26",)], "item string")
    assert {r["item"]: (r.vec, r.norm) for r in S.item_vectors(kb, found, word_vec, titles, title_vec).collect()} == {"Q1": ([3.0, 4.0], 5.0), "Q2": ([0.0, 2.0], 2.0)}


def test_dates_of_answers(spark):
    space = spark.createDataFrame([(1, 7, ["Q1", "P1", '"1939-01-01T00:00:00Z"']), (1, 8, ["Q1", "P2", '"2018-07-15T00:00:00Z"'])], "qid int, fact_id long, items array<string>")
    asked = spark.createDataFrame([(1, ["1939", "15 July 2018"])], "qid int, answers array<string>")
    assert P.evaluate(space, asked).first().hit == 1
    assert {(r.fact_id, r.answer) for r in P.answer_facts(space, asked).collect()} == {(7, "1939"), (8, "2018-07-15T00:00:00Z")}
    assert spark.range(1).select(P.in_thousands(F.lit(1234.0))).first()[0] == "1.2k"


def test_model_names_and_links(spark, kb):
    asked = spark.createDataFrame([(1, "Bob and Cat"), (2, None)], "qid int, question string")
    found = C.spot_by_model(asked, lambda qs: [[w for w in q.split() if w.istitle()] for q in qs])
    assert [(r.qid, r.i, r.label) for r in found.orderBy("qid", "i").collect()] == [(1, 0, "Bob"), (1, 1, "Cat")]
    words = found.select("qid", F.col("i").alias("widx"), F.col("label").alias("word"))
    assert {(r.word, r["item"], r.label) for r in C.linked_names(kb, words).collect()} == {("Bob", "Q2", "Bob"), ("Cat", "Q3", "Cat")}


def test_reports_and_dictionaries(spark, tmp_path):
    summary = spark.createDataFrame([("b", 0.5, 10.0, 20.0)], "benchmark string, presence double, facts double, items double")
    readers.write_report(summary, str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r.res")).first()[0] == "Benchmark: b, Answer presence: 0.5, Search space size: 20.0, Parameters: " and spark.read.json(str(tmp_path / "r.json")).count() == 1
    (tmp_path / "m.json").write_text(json.dumps({"Q1": "Ann_Lee", "Q2": "Bob"}))
    assert {r.key: r.value for r in readers.read_dictionary(spark, str(tmp_path / "m.json")).collect()} == {"Q1": "Ann_Lee", "Q2": "Bob"}
