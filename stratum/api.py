"""The interface of the engine: named functions over one item or many, and batches of tasks.

Every function takes an item or a DataFrame of items, and returns a DataFrame; nothing is collected
but by ``process_tasks``, which answers a short list of tasks with JSON.
"""

from __future__ import annotations

import json
from dataclasses import fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .operators import candidates as C
from .operators import graph as G
from .operators import lookup as L
from .operators.build import KnowledgeBase
from .plans import search_space as P

#: The server's routes and the functions behind them.
ROUTES = {
    "neighborhood": "get_neighborhood", "two_hop_neighborhood": "get_neighborhood_two_hop", "connect": "connect", "connectivity_check": "connectivity_check", "item_to_types": "get_types", "item_to_type": "get_type",
    "item_to_label": "get_label", "item_to_labels": "get_labels", "item_to_aliases": "get_aliases", "item_to_description": "get_description", "frequency": "get_frequency", "search_space": "get_search_space",
}


class Engine:
    def __init__(self, spark: SparkSession, kb: KnowledgeBase, word_vec: DataFrame, gazetteer: DataFrame | None = None, defaults: P.Parameters = P.Parameters()):
        self.spark, self.kb, self.word_vec, self.defaults = spark, kb, word_vec, defaults
        names = kb.texts.select(F.explode("labels").alias("label")) if gazetteer is None else gazetteer
        self.gazetteer = names.where("label like '% %'")

    def _items(self, kb_item: str | DataFrame) -> DataFrame:
        return kb_item.select("item") if isinstance(kb_item, DataFrame) else self.spark.createDataFrame([(kb_item,)], "item string")

    def _pairs(self, kb_item1: str | DataFrame, kb_item2: str | None) -> DataFrame:
        return kb_item1.select("i1", "i2") if isinstance(kb_item1, DataFrame) else self.spark.createDataFrame([(kb_item1, kb_item2)], "i1 string, i2 string")

    def get_label(self, kb_item) -> DataFrame:
        return L.names(self.kb, self._items(kb_item)).select("item", "label")

    def get_labels(self, kb_item) -> DataFrame:
        return L.names(self.kb, self._items(kb_item)).select("item", "labels")

    def get_aliases(self, kb_item) -> DataFrame:
        return L.names(self.kb, self._items(kb_item)).select("item", "aliases")

    def get_description(self, kb_item) -> DataFrame:
        return L.names(self.kb, self._items(kb_item)).select("item", "description")

    def get_types(self, kb_item) -> DataFrame:
        """(item, types): all types as (id, label), in fact order, repeats kept."""
        found = L.types(self.kb, self._items(kb_item))
        named = L.names(self.kb, found.select(F.col("type_id").alias("item")).distinct()).select(F.col("item").alias("type_id"), "label")
        rows = found.join(named, "type_id").groupBy("item").agg(F.array_sort(F.collect_list(F.struct("fact_id", F.struct(F.col("type_id").alias("id"), "label").alias("type")))).alias("x"))
        return rows.select("item", F.col("x.type").alias("types"))

    def get_type(self, kb_item) -> DataFrame:
        best = L.top_type(self.kb, self._items(kb_item))
        named = L.names(self.kb, best.select(F.col("type_id").alias("item")).distinct()).select(F.col("item").alias("type_id"), "label")
        return best.join(named, "type_id").select("item", F.struct(F.col("type_id").alias("id"), "label").alias("type"))

    def get_frequency(self, kb_item) -> DataFrame:
        return L.frequency(self.kb, self._items(kb_item)).select("item", F.array("freq_s", "freq_o").alias("frequency"))

    def _shown(self, facts: DataFrame, order: list[str], include_labels: bool, include_type: bool) -> DataFrame:
        if not include_labels:
            return facts
        elements = L.labelled(self.kb, facts.select("fact_id", "items").dropDuplicates(["fact_id"]), ["fact_id"], include_type)
        return facts.drop("items").join(elements, "fact_id").select(*order, "elements")

    def get_neighborhood(self, kb_item, p: int | None = 1000, include_labels: bool = True, include_type: bool = False) -> DataFrame:
        """The facts of every item: (item, pos, fact_id, elements), or with their plain items."""
        return self._shown(G.neighborhood(self.kb, self._items(kb_item), p), ["item", "pos", "fact_id"], include_labels, include_type)

    def get_neighborhood_two_hop(self, kb_item, p: int | None = 1000, include_labels: bool = True, include_type: bool = False) -> DataFrame:
        return self._shown(G.two_hop(self.kb, self._items(kb_item), p), ["start", "hop", "via", "fact_id"], include_labels, include_type)

    def connect(self, kb_item1, kb_item2: str | None = None, hop: float | None = None) -> DataFrame:
        return G.connect(self.kb, self._pairs(kb_item1, kb_item2), hop)

    def connectivity_check(self, kb_item1, kb_item2: str | None = None) -> DataFrame:
        return G.connectivity(self.kb, self._pairs(kb_item1, kb_item2))

    def is_wikidata_entity(self, string: str) -> DataFrame:
        return self._items(string).select("item", X.is_entity(F.col("item")).alias("result"))

    def is_wikidata_predicate(self, string: str) -> DataFrame:
        return self._items(string).select("item", X.is_predicate(F.col("item")).alias("result"))

    def entity_linking(self, question: str | DataFrame, k: int = 1) -> DataFrame:
        """The first candidates of every word among entities."""
        return C.candidates(self.kb, self._words(self._questions(question)), k, "E")

    def relation_linking(self, question: str | DataFrame, k: int = 1) -> DataFrame:
        return C.candidates(self.kb, self._words(self._questions(question)), k, "P")

    def _questions(self, question) -> DataFrame:
        return question if isinstance(question, DataFrame) else self.spark.createDataFrame([(0, question)], "qid int, question string")

    def _words(self, questions: DataFrame) -> DataFrame:
        return P.keep(C.question_words(questions, self.gazetteer))

    def parameters(self, given: dict | None = None, **more) -> P.Parameters:
        """The defaults with what is given; ``p`` and ``p_setting`` are the same (ledger Q7, Q8)."""
        given = {**(given or {}), **{k: v for k, v in more.items() if v is not None}}
        if "p_setting" in given:
            given["p"] = given.pop("p_setting")
        if not given.get("bm25_limit", True):
            given["bm25_limit"] = None
        return replace(self.defaults, **{f.name: given[f.name] for f in fields(P.Parameters) if f.name in given})

    def get_search_space(self, question, parameters: dict | None = None, include_labels: bool = True, include_type: bool = False, p=None, k=None) -> tuple[DataFrame, DataFrame]:
        """(kb_item_tuple, search_space) of one question or of a DataFrame (qid, question); words short of k items are padded."""
        par = self.parameters(parameters, p=p, k=k)
        questions = self._questions(question)
        words = self._words(questions)
        rows = P.weighted(P.keep(P.scored(self.kb, words, self.word_vec, par.d)), par)
        k_of = par.k if isinstance(par.k, int) else P.keep(C.auto_k(self.kb, rows.select("qid", "widx", "item"), words))
        chosen = P.keep(P.top_k(rows, k_of))
        space = P.search_space(self.kb, chosen, par, questions)
        shown = P.padded(chosen, words, k_of).join(words, ["qid", "widx"])
        items, facts = P.result(self.kb, shown, space, include_type)
        return items, facts if include_labels else space

    def handle(self, route: str, request: dict) -> object:
        """The JSON answer of a route; ``item``, ``item1`` and ``item2`` name what functions call kb_item."""
        name = ROUTES[route]
        if name != "get_search_space" and not any(k in request for k in ("item", "item1")):
            return [] if name.startswith("get_neighborhood") else None
        args = {f"kb_{k}" if k.startswith("item") else k: v for k, v in request.items()}
        return self.answer({"task": name, **args})

    def answer(self, task: dict) -> object:
        """The JSON answer of one task."""
        args = dict(task)
        name = args.pop("task")
        if name.startswith("_") or name in ("answer", "handle", "parameters", "process_tasks"):
            raise ValueError(f"no task {name}")
        out = getattr(self, name)(**args)
        plain = lambda df: [json.loads(r[0]) for r in df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).collect()]
        if name == "get_search_space":
            items, facts = out
            last = "elements" if "elements" in facts.columns else "items"
            order = [F.col("widx"), F.col("place"), F.col("pos") > 0, F.col("fact_id")]
            return {"kb_item_tuple": [r["kb_item"] for r in plain(items.orderBy("widx", "place").select("kb_item"))], "search_space": [r[last] for r in plain(facts.orderBy(*order).select(last))]}
        if name.startswith("get_neighborhood"):
            last = "elements" if "elements" in out.columns else "items"
            order = [F.col("pos") > 0, F.col("fact_id")] if "pos" in out.columns else ["hop", "via", "fact_id"]
            return [r[last] for r in plain(out.orderBy(*order).select(last))]
        if name == "connect":
            rows = plain(out.orderBy("middle", "side", "fact_id"))
            if not rows:
                return None
            if rows[0]["hop"] == 1:
                return [r["items"] for r in rows]
            middles = list(dict.fromkeys(r["middle"] for r in rows))
            return [[[r["items"] for r in rows if (r["middle"], r["side"]) == (m, s)] for s in "lr"] for m in middles]
        rows = plain(out.drop("item", "i1", "i2"))
        if name.endswith("_linking"):
            return rows
        empty = [] if name == "get_types" else None
        return next(iter(rows[0].values())) if rows else empty

    def process_tasks(self, tasks: list[dict]) -> list[object]:
        """The answers of a list of tasks; a task that fails gives None."""
        out = []
        for task in tasks:
            try:
                out.append(self.answer(task))
            except Exception:  # one bad task does not end the rest
                out.append(None)
        return out
