"""The registered queries in SQL for DuckDB, over the same tables."""

from __future__ import annotations

from .functions.text import STOP_WORDS


def _e(space: int, key: str) -> str:
    return f"'Q' || ({space}000000000::BIGINT + {key})::VARCHAR"


_DAY = "'\"' || strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00Z\"'"

_FACTS = f"""fact AS MATERIALIZED (SELECT row_number() OVER () AS f, items FROM (
  SELECT [{_e(1, 'r_regionkey')}, 'P31', 'Q7000000001'] AS items FROM region
  UNION ALL SELECT [{_e(2, 'n_nationkey')}, 'P31', 'Q7000000002'] FROM nation
  UNION ALL SELECT [{_e(3, 'c_custkey')}, 'P31', 'Q7000000003'] FROM customer
  UNION ALL SELECT [{_e(4, 's_suppkey')}, 'P31', 'Q7000000004'] FROM supplier
  UNION ALL SELECT [{_e(5, 'p_partkey')}, 'P31', 'Q7000000005'] FROM part
  UNION ALL SELECT [{_e(2, 'n_nationkey')}, 'P361', {_e(1, 'n_regionkey')}] FROM nation
  UNION ALL SELECT [{_e(3, 'c_custkey')}, 'P17', {_e(2, 'c_nationkey')}] FROM customer
  UNION ALL SELECT [{_e(4, 's_suppkey')}, 'P17', {_e(2, 's_nationkey')}] FROM supplier
  UNION ALL SELECT [{_e(6, 'o_orderkey')}, 'P50', {_e(3, 'o_custkey')}, 'P585', {_DAY}] FROM orders
  UNION ALL SELECT [{_e(4, 's_suppkey')}, 'P106', 'Q7000000003'] FROM supplier
  UNION ALL SELECT [{_e(2, 'n_nationkey')}, 'P106', 'Q7000000006'] FROM nation
  UNION ALL SELECT [{_e(6, 'l_orderkey')}, 'P527', {_e(5, 'l_partkey')}, 'P176', {_e(4, 'l_suppkey')}, 'P1114', l_quantity::BIGINT::VARCHAR] FROM lineitem))"""

_ITEMS = """el AS MATERIALIZED (SELECT f, items, unnest(items) AS item, generate_subscripts(items, 1) - 1 AS pos FROM fact),
ix AS MATERIALIZED (SELECT * FROM el WHERE regexp_full_match(item, '[QP][0-9]+')),
freq AS MATERIALIZED (SELECT item, count(*) FILTER (pos = 0) AS freq_s, count(*) FILTER (pos > 0) AS freq_o FROM ix GROUP BY item)"""

_ADJ = "adj AS MATERIALIZED (SELECT DISTINCT a.item, b.item AS neighbor FROM ix a JOIN ix b ON a.f = b.f WHERE b.item LIKE 'Q%')"

_TEXTS = f"""txt AS MATERIALIZED (
  SELECT {_e(1, 'r_regionkey')} AS item, r_name AS label, NULL::VARCHAR AS alias, NULL::VARCHAR AS descr FROM region
  UNION ALL SELECT {_e(2, 'n_nationkey')}, n_name, NULL, NULL FROM nation
  UNION ALL SELECT {_e(3, 'c_custkey')}, c_name, NULL, c_mktsegment FROM customer
  UNION ALL SELECT {_e(4, 's_suppkey')}, s_name, NULL, NULL FROM supplier
  UNION ALL SELECT {_e(5, 'p_partkey')}, p_name, p_brand || ' ' || p_name, p_type FROM part
  UNION ALL SELECT {_e(6, 'o_orderkey')}, 'Order#' || o_orderkey, NULL, NULL FROM orders
  UNION ALL SELECT 'Q700000000' || k, n, NULL, NULL FROM (VALUES (1, 'region'), (2, 'nation'), (3, 'customer'), (4, 'supplier'), (5, 'part')) v(k, n)
  UNION ALL SELECT k, n, NULL, NULL FROM (VALUES ('P31', 'instance of'), ('P106', 'occupation'), ('P361', 'part of'), ('P17', 'country'), ('P50', 'placed by'), ('P585', 'point in time'), ('P527', 'has part'), ('P176', 'manufacturer'), ('P1114', 'quantity')) v(k, n))"""

_DATE = "CASE WHEN month({0}) = 1 AND day({0}) = 1 THEN year({0})::VARCHAR ELSE day({0}) || ' ' || monthname({0}) || ' ' || year({0}) END"
#: Label of every item of a fact, and the facts as text.
_LABELS = f"""lb AS MATERIALIZED (SELECT item, coalesce(label, CASE WHEN item LIKE '"%T00:00:00Z"' THEN {_DATE.format("substr(item, 2, 10)::DATE")} ELSE item END) AS lab FROM (SELECT DISTINCT item FROM el) LEFT JOIN txt USING (item))"""
_VERBAL = "fv AS MATERIALIZED (SELECT f, trim(string_agg(lab, ' ' ORDER BY pos)) AS text FROM el JOIN lb USING (item) GROUP BY f)"
_TOP_TYPE = """tt AS MATERIALIZED (SELECT item, type_id, n FROM (SELECT items[1] AS item, items[3] AS type_id, freq_s + freq_o AS n, row_number() OVER (PARTITION BY items[1] ORDER BY freq_s + freq_o DESC, (items[2] = 'P31') DESC) AS r
  FROM (SELECT * FROM fact WHERE items[2] IN ('P31', 'P106')) f JOIN freq ON freq.item = f.items[3]) WHERE r = 1)"""
_TYPED = "fty AS MATERIALIZED (SELECT f, string_agg(lb.lab || '/' || coalesce(tl.lab, ''), '|' ORDER BY pos) AS fact FROM el JOIN lb USING (item) LEFT JOIN tt ON tt.item = el.item LEFT JOIN lb tl ON tl.item = tt.type_id GROUP BY f)"

#: Questions are 'Which part is the <part name> from <nation>?': the name is a spot, then part and the nation are left.
_WORDS = """qn AS MATERIALIZED (SELECT p_name, k, row_number() OVER (ORDER BY p_name) - 1 AS qid FROM (SELECT p_name, min(p_partkey) AS k FROM part GROUP BY p_name)),
wd AS MATERIALIZED (SELECT qid::INTEGER AS qid, w.widx::INTEGER AS widx, w.word FROM qn JOIN nation ON qid % 25 = n_nationkey, LATERAL (VALUES (0, lower(p_name)), (1, 'part'), (2, lower(n_name))) w(widx, word)),
lx AS MATERIALIZED (SELECT DISTINCT unnest(regexp_split_to_array(lower(label), '[ #]+')) AS token, item, length(label) AS nc FROM txt),
uw AS (SELECT DISTINCT word FROM wd),
hit AS (SELECT word, item, count(*) AS n, min(nc) AS nc FROM (SELECT DISTINCT word, unnest(regexp_split_to_array(lower(word), '[ #]+')) AS token FROM uw) JOIN lx USING (token) WHERE token <> '' GROUP BY ALL),
top40 AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY n DESC, nc, item) AS pl FROM hit QUALIFY pl <= 40),
top20 AS MATERIALIZED (SELECT word, item, row_number() OVER (PARTITION BY word ORDER BY pl) AS rank FROM top40 WHERE item IN (SELECT item FROM freq) QUALIFY rank <= 20),
cand AS MATERIALIZED (SELECT qid, widx, word, rank::INTEGER AS rank, item, round_even(1.0::DOUBLE / (rank + 1), 4) AS match FROM wd JOIN top20 USING (word))"""

_NO_WORDS = ", ".join(f"'{w}'" for w in STOP_WORDS)

_VEC = f"""emb AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
tok AS (SELECT DISTINCT unnest(string_split(lower(word), ' ')) AS w FROM uw UNION SELECT DISTINCT unnest(string_split(lower(label), ' ')) FROM txt WHERE item IN (SELECT item FROM top20)),
wv AS (SELECT w, v FROM tok JOIN emb ON vec_id = ('0x' || substr(md5(w), 1, 8))::BIGINT % (SELECT count(*) FROM embeddings)),
phr AS (SELECT DISTINCT word AS ph FROM uw UNION SELECT DISTINCT label FROM txt WHERE item IN (SELECT item FROM top20)),
pw AS (SELECT ph, unnest(string_split(lower(ph), ' ')) AS w FROM phr),
pe AS (SELECT ph, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM pw JOIN wv USING (w) WHERE w NOT IN ({_NO_WORDS})),
pm AS (SELECT ph, i, avg(x) AS x FROM pe GROUP BY ph, i),
pv AS MATERIALIZED (SELECT ph, list(x ORDER BY i) AS v, sqrt(sum(x * x)) AS nm FROM pm GROUP BY ph),
iv AS MATERIALIZED (SELECT t.item, p.v, p.nm FROM txt t JOIN pv p ON p.ph = t.label WHERE t.item IN (SELECT item FROM top20)),
rel AS MATERIALIZED (SELECT c.qid, c.widx, c.item, coalesce(round_even(avg(list_inner_product(a.v, b.v) / (a.nm * b.nm)), 4) + 0.0, 0) AS rel
  FROM cand c LEFT JOIN iv a ON a.item = c.item LEFT JOIN wd o ON o.qid = c.qid AND o.widx <> c.widx LEFT JOIN pv b ON b.ph = o.word GROUP BY ALL)"""

_PAIRS = """pr AS MATERIALIZED (SELECT DISTINCT a.qid, least(a.item, b.item) AS i1, greatest(a.item, b.item) AS i2 FROM cand a JOIN cand b ON a.qid = b.qid AND a.widx < b.widx),
mm AS (SELECT qid, count(*) AS m FROM wd GROUP BY qid),
nw AS (SELECT qid, item, list(DISTINCT widx) AS ws FROM cand GROUP BY qid, item)"""

_CONN_EDGES = """up AS (SELECT DISTINCT i1, i2 FROM pr),
ced AS MATERIALIZED (SELECT i1, i2, 1.0::DOUBLE AS w FROM up WHERE EXISTS (SELECT 1 FROM adj WHERE item = i1 AND neighbor = i2) OR EXISTS (SELECT 1 FROM adj WHERE item = i2 AND neighbor = i1)),
half AS MATERIALIZED (SELECT DISTINCT i1, i2, 0.5::DOUBLE AS w FROM (SELECT * FROM up ANTI JOIN ced USING (i1, i2)) u JOIN adj a ON a.item = u.i1 JOIN adj b ON b.item = u.i2 AND b.neighbor = a.neighbor),
cedge AS MATERIALIZED (SELECT qid, i1, i2, w FROM pr JOIN (SELECT * FROM ced UNION ALL SELECT * FROM half) USING (i1, i2))"""

_COH_EDGES = "hedge AS MATERIALIZED (SELECT qid, i1, i2, list_inner_product(a.v, b.v) / (a.nm * b.nm) AS w FROM pr JOIN iv a ON a.item = i1 JOIN iv b ON b.item = i2 WHERE w <> 0)"


def _single(edges: str, out: str) -> str:
    return f"""{out}_nb AS (SELECT qid, i1 AS item, i2 AS other, w FROM {edges} UNION ALL SELECT qid, i2, i1, w FROM {edges} WHERE i1 <> i2),
{out}_cr AS (SELECT n.qid, n.item, n.w, unnest(list_distinct(list_concat(a.ws, b.ws))) AS i FROM {out}_nb n JOIN nw a ON a.qid = n.qid AND a.item = n.item JOIN nw b ON b.qid = n.qid AND b.item = n.other),
{out}_be AS (SELECT qid, item, i, max(w) AS best FROM {out}_cr GROUP BY ALL),
{out}_su AS (SELECT c.qid, c.widx, c.item, sum(best) AS s FROM cand c JOIN {out}_be b ON b.qid = c.qid AND b.item = c.item AND b.i <> c.widx GROUP BY ALL),
{out} AS MATERIALIZED (SELECT c.qid, c.widx, c.item, coalesce(round_even(s / greatest(m - 1, 1), 4) + 0.0, 0) AS {out} FROM cand c JOIN mm USING (qid) LEFT JOIN {out}_su USING (qid, widx, item))"""


_AUTO_K = """fs AS (SELECT qid, widx, (freq_s + freq_o)::DOUBLE AS f FROM cand JOIN freq USING (item)),
ft AS (SELECT qid, widx, f / sum(f) OVER (PARTITION BY qid, widx) AS s FROM fs),
ak AS MATERIALIZED (SELECT qid, widx, coalesce(floor(round_even(-sum(s * log2(s)), 9)) + 1, 0)::INTEGER AS k FROM wd LEFT JOIN ft USING (qid, widx) GROUP BY ALL)"""

_SCORED = """sc AS MATERIALIZED (SELECT *, 0.4 * match + {rel} * rel + {conn} * conn + 0.1 * coh AS score FROM cand JOIN rel USING (qid, widx, item) JOIN conn USING (qid, widx, item) JOIN coh USING (qid, widx, item)),
sn AS (SELECT *, least(4 * (row_number() OVER (PARTITION BY qid, widx ORDER BY match DESC, rank) - 1), 4 * (row_number() OVER (PARTITION BY qid, widx ORDER BY rel DESC, rank) - 1) + 1,
  4 * (row_number() OVER (PARTITION BY qid, widx ORDER BY conn DESC, rank) - 1) + 2, 4 * (row_number() OVER (PARTITION BY qid, widx ORDER BY coh DESC, rank) - 1) + 3) AS seen FROM sc),
rk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY qid, widx ORDER BY score DESC, seen) AS place FROM sn WHERE score > 0)"""

_TOP = "tk AS MATERIALIZED (SELECT rk.* FROM rk JOIN ak USING (qid, widx) WHERE place <= k)"


def _space(name: str, top: str, p: int) -> str:
    return f"{name} AS MATERIALIZED (SELECT t.qid, t.widx, t.place, t.item, x.items, x.f, x.pos FROM {top} t JOIN ix x ON x.item = t.item JOIN freq q ON q.item = t.item WHERE x.pos = 0 OR q.freq_o <= {p})"


def _eval(name: str, space: str) -> str:
    return f"""{name} AS (SELECT q.qid::INTEGER AS qid, coalesce(max((x.item = {_e(5, 'k')})::INTEGER), 0)::BIGINT AS hit, count(DISTINCT (x.f, x.pos0, x.own, x.widx))::BIGINT AS n_facts,
  count(DISTINCT x.item) FILTER (NOT regexp_full_match(x.item, 'P[0-9]+'))::BIGINT AS n_items FROM qn q LEFT JOIN (SELECT qid, f, pos AS pos0, item AS own, widx, unnest(items) AS item FROM {space}) x ON x.qid = q.qid GROUP BY q.qid)"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


_KB = (_FACTS, _ITEMS)
_QW = (_FACTS, _ITEMS, _TEXTS, _WORDS)
_ALL = (*_QW, _ADJ, _VEC, _PAIRS, _CONN_EDGES, _COH_EDGES, _single("cedge", "conn"), _single("hedge", "coh"), _AUTO_K)
_MAIN = (*_ALL, _SCORED.format(rel=0.3, conn=0.2), _TOP)
_FACT = "array_to_string(items, '|') AS fact"
_SIDE = "CASE WHEN pos = 0 THEN 's' ELSE 'o' END AS side"


def _cross(left: str, right: str) -> str:
    """Pairs of name spaces, '4' for suppliers and so on, 'P' for predicates."""
    some = lambda c, xs: f"substr({c}.item, 1, 2) IN ({', '.join(repr('Q' + x) for x in xs if x != 'P')})" + f" OR {c}.item LIKE 'P%'" * ("P" in xs)
    return f"SELECT a.item AS i1, b.item AS i2 FROM txt a, txt b WHERE ({some('a', left)}) AND ({some('b', right)})"


def _digest(source: str, *key: str) -> str:
    k = ", ".join(key)
    return f"SELECT {k}, count(*) AS n_facts, min(fact) AS first_fact, max(fact) AS last_fact FROM ({source}) GROUP BY {k}"


#: For pairs pq: n facts that hold both items, once for each time that the item with fewer facts occurs.
_ONE_HOP = """tf0 AS (SELECT item, freq_s + freq_o AS n FROM freq),
sm AS (SELECT i1, i2, CASE WHEN coalesce(a.n, 0) <= coalesce(b.n, 0) THEN i1 ELSE i2 END AS a, CASE WHEN coalesce(a.n, 0) <= coalesce(b.n, 0) THEN i2 ELSE i1 END AS b FROM pq LEFT JOIN tf0 a ON a.item = i1 LEFT JOIN tf0 b ON b.item = i2),
oh AS MATERIALIZED (SELECT i1, i2, array_to_string(items, '|') AS fact FROM sm JOIN ix ON ix.item = sm.a WHERE list_contains(items, b))"""


def _two_hop(pairs: str) -> tuple[str, ...]:
    """CTEs th (i1, i2, middle, side, fact) over pairs with a shared neighbour."""
    return (
        f"p0 AS MATERIALIZED ({pairs})", "ends AS (SELECT i1 AS item FROM p0 UNION SELECT i2 FROM p0)", "na AS MATERIALIZED (SELECT adj.* FROM adj SEMI JOIN ends USING (item))",
        "mid AS MATERIALIZED (SELECT i1, i2, a.neighbor AS middle FROM p0 JOIN na a ON a.item = i1 JOIN na b ON b.item = i2 AND b.neighbor = a.neighbor)",
        "pq AS MATERIALIZED (SELECT DISTINCT i1, i2 FROM (SELECT i1, middle AS i2 FROM mid UNION ALL SELECT i2, middle FROM mid))", _ONE_HOP,
        "th AS MATERIALIZED (SELECT m.i1, m.i2, middle, 'l' AS side, fact FROM mid m JOIN oh ON oh.i1 = m.i1 AND oh.i2 = middle UNION ALL SELECT m.i1, m.i2, middle, 'r', fact FROM mid m JOIN oh ON oh.i1 = m.i2 AND oh.i2 = middle)",
    )


_CONN = """o AS MATERIALIZED (SELECT i1, i2 FROM pq WHERE (i1, i2) IN (SELECT item, neighbor FROM adj) OR (i2, i1) IN (SELECT item, neighbor FROM adj)),
e AS (SELECT i1 AS item FROM pq UNION SELECT i2 FROM pq), ne AS MATERIALIZED (SELECT adj.* FROM adj SEMI JOIN e USING (item)),
h AS MATERIALIZED (SELECT DISTINCT i1, i2 FROM (SELECT * FROM pq ANTI JOIN o USING (i1, i2)) r JOIN ne a ON a.item = i1 JOIN ne b ON b.item = i2 AND b.neighbor = a.neighbor)"""
_CONN_OF = "(CASE WHEN (i1, i2) IN (SELECT i1, i2 FROM o) THEN 1.0 WHEN (i1, i2) IN (SELECT i1, i2 FROM h) THEN 0.5 ELSE 0.0 END)::DOUBLE"
_STOP = "'" + "', '".join(STOP_WORDS) + "'"


def _bm25(docs: str, asked: str) -> str:
    """CTE ss (qid, did, score) of docs (qid, did, text) for asked (qid, question)."""
    words = lambda c: rf"list_filter(string_split_regex(trim(replace({c}, ',', '')), '\s+'), lambda w: w NOT IN ('', {_STOP}))"
    return f"""dc AS MATERIALIZED (SELECT qid, did, {words("text")} AS ts FROM ({docs})),
tf AS MATERIALIZED (SELECT qid, did, term, count(*) AS tf FROM (SELECT qid, did, unnest(ts) AS term FROM dc) GROUP BY ALL),
nn AS (SELECT qid, count(*) AS n, avg(len(ts)) AS al FROM dc GROUP BY qid),
df AS (SELECT qid, term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM tf JOIN nn USING (qid) GROUP BY qid, term, n),
mi AS (SELECT qid, avg(idf) AS mi FROM df GROUP BY qid),
wt AS (SELECT qid, term, CASE WHEN idf < 0 THEN 0.25 * mi ELSE idf END AS idf FROM df JOIN mi USING (qid)),
aq AS (SELECT qid, unnest({words("question")}) AS term FROM ({asked})),
ss AS (SELECT d.qid, d.did, coalesce(sum(w.idf * (t.tf * 2.5) / (t.tf + 1.5 * (0.25 + 0.75 * len(d.ts) / n.al))), 0) AS score FROM dc d JOIN nn n ON n.qid = d.qid LEFT JOIN (aq JOIN tf t USING (qid, term) JOIN wt w USING (qid, term)) ON t.qid = d.qid AND t.did = d.did GROUP BY d.qid, d.did)"""


_QUESTION = "SELECT qid::INTEGER AS qid, 'Which part is the ' || p_name || ' from ' || n_name || '?' AS question FROM qn JOIN nation ON qid % 25 = n_nationkey"


_TUPLES = "tp AS (SELECT item AS tid, unnest([item, 'Q7000000002', 'Q7000000004']) AS item FROM txt WHERE item LIKE 'Q2%')"
_PATH = "one AS MATERIALIZED (SELECT DISTINCT a.item AS x, b.item AS y, a.f FROM ix a JOIN ix b ON a.f = b.f), oc AS MATERIALIZED (SELECT x, y, count(*) AS n FROM one GROUP BY ALL)"

_HOPS = ("nh AS MATERIALIZED (SELECT ix.* FROM ix JOIN freq USING (item) WHERE pos = 0 OR freq_o <= 1000)", "st AS MATERIALIZED (SELECT item AS start, f, items FROM nh WHERE item LIKE 'Q1%' OR item LIKE 'Q2%')", "via AS MATERIALIZED (SELECT DISTINCT start, item FROM (SELECT start, unnest(items) AS item FROM st) WHERE item LIKE 'Q%' AND item <> start)")
_HOP_ROWS = """SELECT start, hop, via, count(*) AS n_facts, min(array_to_string(items, '|')) AS first_fact FROM (
SELECT start, 1 AS hop, start AS via, items FROM st UNION ALL SELECT start, 2, via.item, items FROM via JOIN nh USING (item) WHERE true{}) GROUP BY ALL"""

SQL: dict[str, str] = {
    "kb_facts": _with(_FACTS) + f"SELECT items[1] AS subject, items[2] AS predicate, items[3] AS object, {_FACT} FROM fact",
    "kb_qualifiers": _with(_FACTS) + "SELECT items[2] AS predicate, items[i] AS qualifier, count(*) AS n, count(DISTINCT items[i + 1]) AS n_values FROM fact, (VALUES (4), (6)) v(i) WHERE len(items) > i GROUP BY ALL",
    "kb_adjacency": _with(*_KB, _ADJ) + "SELECT item, count(*) AS n_neighbors, min(neighbor) AS first_neighbor, max(neighbor) AS last_neighbor FROM adj GROUP BY item",
    "kb_statistics": _with(_FACTS) + "SELECT count(*) AS n_facts, count(*) FILTER (len(items) > 3) AS n_qualified FROM fact",
    "frequency": _with(*_KB, _TEXTS) + "SELECT item, coalesce(freq_s, 0) AS freq_s, coalesce(freq_o, 0) AS freq_o FROM txt LEFT JOIN freq USING (item)",
    "is_known": _with(*_KB, _TEXTS) + "SELECT item FROM (SELECT item FROM txt UNION ALL VALUES ('Q1'), ('P31'), ('P9')) WHERE item IN (SELECT item FROM freq)",
    "labels": _with(_TEXTS) + """SELECT item, label AS labels, coalesce(alias, item) AS aliases, coalesce(descr, 'None') AS description, label FROM txt
UNION ALL SELECT i, l, i, 'None', l FROM (VALUES ('"2018-07-15T00:00:00Z"', '15 July 2018'), ('"2018-01-01T00:00:00Z"', '2018'), ('Q1', 'Q1'), ('12', '12')) v(i, l)""",
    "types": _with(_FACTS) + "SELECT items[1] AS item, items[3] AS type_id FROM fact WHERE items[2] IN ('P31', 'P106')",
    "top_type": _with(*_KB, _TEXTS, _TOP_TYPE) + "SELECT tt.* FROM tt SEMI JOIN txt USING (item)",
    "neighborhood": _with(*_KB, _TEXTS) + _digest(f"SELECT item, {_SIDE}, {_FACT} FROM ix SEMI JOIN txt USING (item)", "item", "side"),
    "neighborhood_pruned": _with(*_KB, _TEXTS) + _digest(f"SELECT item, {_SIDE}, {_FACT} FROM ix JOIN freq USING (item) SEMI JOIN txt USING (item) WHERE pos = 0 OR freq_o <= 100", "item", "side"),
    "two_hop": _with(*_KB, *_HOPS) + _HOP_ROWS.format(" AND NOT list_contains(items, start)"),
    "two_hop_all": _with(*_KB, *_HOPS) + _HOP_ROWS.format(""),
    "connectivity": _with(*_KB, _TEXTS, _ADJ, f"pq AS MATERIALIZED ({_cross('42P', '217P')})", _CONN) + f"SELECT i1, i2, {_CONN_OF} AS connectivity FROM pq",
    "connect_1hop": _with(*_KB, _TEXTS, f"pq AS MATERIALIZED ({_cross('34P', '27')})", _ONE_HOP) + "SELECT i1, i2, count(*) AS n_facts, min(fact) AS first_fact FROM oh GROUP BY ALL",
    "connect_2hop": _with(*_KB, _TEXTS, _ADJ, *_two_hop(_cross("4", "1"))) + "SELECT i1, i2, middle, side, count(*) AS n_facts, min(fact) AS first_fact FROM th GROUP BY ALL",
    "distance": _with(*_KB, _TEXTS, _ADJ, f"pq AS MATERIALIZED ({_cross('127', '127')})", """e AS (SELECT DISTINCT i1 AS item FROM pq), l1 AS MATERIALIZED (SELECT adj.item AS x, neighbor AS y FROM adj SEMI JOIN e USING (item)),
l2 AS MATERIALIZED (SELECT DISTINCT x, neighbor AS y FROM l1 JOIN adj ON item = y), d2 AS MATERIALIZED (SELECT DISTINCT a.x, b.x AS y FROM l1 a JOIN l1 b USING (y)), d3 AS MATERIALIZED (SELECT DISTINCT a.x, b.x AS y FROM l2 a JOIN l1 b USING (y)), d4 AS MATERIALIZED (SELECT DISTINCT a.x, b.x AS y FROM l2 a JOIN l2 b USING (y)), l3 AS MATERIALIZED (SELECT DISTINCT x, neighbor AS y FROM l2 JOIN adj ON item = y), d5 AS MATERIALIZED (SELECT DISTINCT a.x, b.x AS y FROM l3 a JOIN l2 b USING (y))""") + "SELECT i1, i2, CASE WHEN (i1, i2) IN (FROM l1) THEN 1 WHEN (i1, i2) IN (FROM d2) THEN 2 WHEN (i1, i2) IN (FROM d3) THEN 3 WHEN (i1, i2) IN (FROM d4) THEN 4 WHEN (i1, i2) IN (FROM d5) THEN 5 END AS distance FROM pq",
    "search_space_union": _with(*_KB, _TEXTS, _TUPLES) + "SELECT tid, item, count(*) AS n_facts FROM tp JOIN ix USING (item) JOIN freq USING (item) WHERE pos = 0 OR freq_o <= 1000 GROUP BY ALL",
    "connected_space": _with(*_KB, _TEXTS, _TUPLES) + f"SELECT tid, item, {_FACT} FROM tp JOIN ix USING (item) WHERE len(list_intersect(items, [tid, 'Q7000000002', 'Q7000000004'])) > 1",
    "question_words": _with(*_QW) + "SELECT qid, widx, word FROM wd",
    "candidates": _with(*_QW) + "SELECT qid, widx, word, rank, item, match FROM cand",
    "auto_k": _with(*_QW, _AUTO_K) + "SELECT * FROM ak",
    "dynamic_p": """SELECT s AS setting, k, (CASE s WHEN 'DYNAMIC1' THEN pow(10, 6 - k) WHEN 'DYNAMIC2' THEN pow(10, 5 - k) WHEN 'DYNAMIC3' THEN floor(pow(10, 5 - k / 2.0)) WHEN 'DYNAMIC4' THEN floor(pow(10, 4 - k / 2.0)) WHEN 'DYNAMIC5' THEN pow(10, k)
WHEN 'DYNAMIC6' THEN CASE WHEN k = 1 THEN 10000 WHEN k < 4 THEN 1000 ELSE 100 END ELSE 1000 END)::BIGINT AS p FROM (VALUES ('DYNAMIC1'), ('DYNAMIC2'), ('DYNAMIC3'), ('DYNAMIC4'), ('DYNAMIC5'), ('DYNAMIC6'), ('1000')) a(s), (SELECT unnest([1, 2, 3, 4]::BIGINT[]) AS k)""",
    "relevance": _with(*_QW, _VEC) + "SELECT * FROM rel",
    "connectivity_score": _with(*_QW, _ADJ, _PAIRS, _CONN_EDGES, _single("cedge", "conn")) + "SELECT * FROM conn",
    "coherence_score": _with(*_QW, _VEC, _PAIRS, _COH_EDGES, _single("hedge", "coh")) + "SELECT * FROM coh",
    "topk": _with(*_MAIN) + "SELECT qid, widx, item, match, rel, conn, coh, round_even(score, 6) AS score, place::INTEGER AS place FROM tk",
    "search_space": _with(*_MAIN, _space("sp", "tk", 1000)) + f"SELECT qid, widx, place::INTEGER AS place, item, {_FACT} FROM sp",
    "answer_presence": _with(*_MAIN, _space("sp", "tk", 1000), _eval("ev", "sp")) + "SELECT * FROM ev",
    "benchmark_summary": _with(*_ALL, _SCORED.format(rel=0.2, conn=0.3), _TOP, "t1 AS (SELECT * FROM rk WHERE place <= 1)", "t5 AS (SELECT * FROM rk WHERE place <= 5)", _space("s0", "tk", 1000), _space("s1", "t1", 10000), _space("s2", "t5", 100), _eval("e0", "s0"), _eval("e1", "s1"), _eval("e2", "s2"))
    + "SELECT benchmark, round_even(avg(hit), 3) AS presence, round_even(avg(n_facts), 3) AS facts, round_even(avg(n_items), 3) AS items FROM (SELECT 'set0' AS benchmark, * FROM e0 UNION ALL SELECT 'set1', * FROM e1 UNION ALL SELECT 'set2', * FROM e2) GROUP BY benchmark",
    "bm25": _with(_FACTS, _TEXTS, """dc AS (SELECT items[3] AS qid, t.item AS did, string_split(t.label || coalesce(' ' || t.descr, ''), ' ') AS ts FROM fact JOIN txt t ON t.item = items[1] WHERE items[2] = 'P17'),
tf AS (SELECT qid, did, term, count(*) AS tf FROM (SELECT qid, did, unnest(ts) AS term FROM dc) GROUP BY ALL),
nn AS (SELECT qid, count(*) AS n, avg(len(ts)) AS al FROM dc GROUP BY qid),
df AS (SELECT qid, term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM tf JOIN nn USING (qid) GROUP BY qid, term, n),
mi AS (SELECT qid, avg(idf) AS mi FROM df GROUP BY qid),
wt AS (SELECT qid, term, CASE WHEN idf < 0 THEN 0.25 * mi ELSE idf END AS idf FROM df JOIN mi USING (qid)),
aq AS (SELECT item AS qid, unnest(['HOUSEHOLD', 'MACHINERY', label]) AS term FROM txt WHERE item LIKE 'Q2%'),
ss AS (SELECT d.qid, d.did, coalesce(sum(w.idf * (t.tf * 2.5) / (t.tf + 1.5 * (0.25 + 0.75 * len(d.ts) / n.al))), 0) AS score FROM dc d JOIN nn n ON n.qid = d.qid LEFT JOIN (aq JOIN tf t USING (qid, term) JOIN wt w USING (qid, term)) ON t.qid = d.qid AND t.did = d.did GROUP BY d.qid, d.did)""")
    + "SELECT qid, did, round_even(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round_even(score, 9) DESC, did)::INTEGER AS place FROM ss QUALIFY place <= 20",
    "flat_list": _with(_FACTS) + f"SELECT {_FACT} FROM fact",
    "date_labels": f"""WITH d AS (SELECT DISTINCT {_DAY} AS item, o_orderdate::DATE AS o FROM orders)
SELECT item, CASE WHEN month(o) = 1 AND day(o) = 1 THEN year(o)::VARCHAR ELSE day(o) || ' ' || monthname(o) || ' ' || year(o) END AS label, year(o)::VARCHAR AS year, strftime(o, '%Y-%m-%d') || 'T00:00:00Z' AS timestamp FROM d""",
}
SQL["kb_dictionary"] = _with(_FACTS, "nd AS (SELECT DISTINCT unnest(items) AS item FROM fact)", "kd AS (SELECT item, CASE WHEN regexp_full_match(item, 'Q[0-9]+') THEN 'E' WHEN regexp_full_match(item, 'P[0-9]+') THEN 'P' ELSE 'L' END AS kind FROM nd)",
    "rn AS (SELECT item, kind, row_number() OVER (PARTITION BY kind ORDER BY item) AS n FROM kd)") + "SELECT item, kind, CASE kind WHEN 'E' THEN n + 9999 WHEN 'P' THEN n ELSE -n END AS code FROM rn"
SQL |= {
    "neighborhood_typed": _with(*_KB, _TEXTS, _LABELS, _TOP_TYPE, _TYPED) + f"SELECT item, {_SIDE}, fty.fact FROM ix JOIN freq USING (item) JOIN fty USING (f) SEMI JOIN txt USING (item) WHERE (item LIKE 'Q1%' OR item LIKE 'Q2%') AND (pos = 0 OR freq_o <= 1000)",
    "neighbors_unindexed": _with(*_KB, _TEXTS) + "SELECT item, count(*) AS n_neighbors, min(neighbor) AS first_neighbor, max(neighbor) AS last_neighbor FROM (SELECT DISTINCT item, unnest(items) AS neighbor FROM ix SEMI JOIN txt USING (item)) GROUP BY item",
    "legacy_index": _with(*_KB) + "SELECT item, count(*) AS n_facts FROM ix GROUP BY item",
    "frequency_main": _with(*_KB, _TEXTS) + "SELECT item, count(pos) FILTER (pos = 0) AS freq_s, count(pos) FILTER (pos = 2) AS freq_o FROM txt LEFT JOIN ix USING (item) GROUP BY item",
    "connectivity_of_sets": _with(*_KB, _TEXTS, f"pq AS MATERIALIZED ({_cross('42P', '217P')})", "e AS (SELECT i1 AS item FROM pq UNION SELECT i2 FROM pq)", "ne AS MATERIALIZED (SELECT DISTINCT item, unnest(items) AS neighbor FROM ix SEMI JOIN e USING (item))",
        "o AS MATERIALIZED (SELECT i1, i2 FROM pq WHERE (i1, i2) IN (SELECT item, neighbor FROM ne))", "h AS MATERIALIZED (SELECT DISTINCT i1, i2 FROM (SELECT * FROM pq ANTI JOIN o USING (i1, i2)) r JOIN ne a ON a.item = i1 JOIN ne b ON b.item = i2 AND b.neighbor = a.neighbor WHERE a.neighbor NOT LIKE 'P%')") + f"SELECT i1, i2, {_CONN_OF} AS connectivity FROM pq",
    "connect": _with(*_KB, _TEXTS, _ADJ, f"p1 AS MATERIALIZED ({_cross('4', '12')})", "o1 AS MATERIALIZED (SELECT i1, i2 FROM p1 WHERE (i1, i2) IN (SELECT item, neighbor FROM adj))", *_two_hop("SELECT * FROM p1 ANTI JOIN o1 USING (i1, i2)"),
        "sm1 AS (SELECT i1, i2, CASE WHEN coalesce(a.n, 0) <= coalesce(b.n, 0) THEN i1 ELSE i2 END AS a, CASE WHEN coalesce(a.n, 0) <= coalesce(b.n, 0) THEN i2 ELSE i1 END AS b FROM o1 LEFT JOIN tf0 a ON a.item = i1 LEFT JOIN tf0 b ON b.item = i2)")
    + "SELECT i1, i2, hop, middle, side, count(*) AS n_facts, min(fact) AS first_fact FROM (SELECT i1, i2, 1.0::DOUBLE AS hop, NULL AS middle, NULL AS side, array_to_string(items, '|') AS fact FROM sm1 JOIN ix ON ix.item = sm1.a WHERE list_contains(items, b) UNION ALL SELECT i1, i2, 0.5, middle, side, fact FROM th) GROUP BY ALL",
    "context_graph": _with(*_KB, _TEXTS, _TUPLES, "base AS (SELECT tid, x.f, items FROM tp JOIN ix x USING (item) JOIN freq USING (item) WHERE pos = 0 OR freq_o <= 100)", "frq AS (SELECT tid, item AS frequent FROM tp JOIN freq USING (item) WHERE freq_o > 100)", _ADJ,
        "near AS (SELECT DISTINCT tid, neighbor AS item FROM tp JOIN freq USING (item) JOIN adj USING (item) JOIN freq g ON g.item = neighbor WHERE freq.freq_o <= 100 AND g.freq_o <= 10000)", "more AS (SELECT near.tid, x.f FROM near JOIN frq USING (tid) JOIN ix x USING (item) WHERE list_contains(x.items, frequent))")
    + "SELECT tid, count(*) AS n_facts, count(DISTINCT f) AS n_distinct FROM (SELECT tid, f FROM base UNION ALL SELECT tid, f FROM more) GROUP BY tid",
    "verbalized": _with(*_KB, _TEXTS, _LABELS, _VERBAL) + "SELECT text FROM fv",
    "word_pairs": _with(*_QW) + "SELECT a.qid, a.widx AS i, b.widx AS j FROM wd a JOIN wd b ON a.qid = b.qid AND a.widx < b.widx",
    "candidates_by_kind": _with(*_QW, *[f"t{k} AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY n DESC, nc, item) AS pl FROM hit WHERE item LIKE '{x}%' QUALIFY pl <= 6), r{k} AS (SELECT word, item, row_number() OVER (PARTITION BY word ORDER BY pl) AS rank FROM t{k} WHERE item IN (SELECT item FROM freq) QUALIFY rank <= 3)" for k, x in (("e", "Q"), ("p", "P"))])
    + "SELECT 'E' AS kind, qid, widx, rank::INTEGER AS rank, item FROM wd JOIN re USING (word) UNION ALL SELECT 'P', qid, widx, rank::INTEGER, item FROM wd JOIN rp USING (word)",
    "linked_names": _with(*_QW, "te AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY n DESC, nc, item) AS pl FROM hit WHERE item LIKE 'Q%' QUALIFY pl <= 2), le AS (SELECT word, item FROM te WHERE item IN (SELECT item FROM freq) QUALIFY row_number() OVER (PARTITION BY word ORDER BY pl) = 1)") + "SELECT qid, widx, word, item, label FROM wd JOIN le USING (word) JOIN txt USING (item)",
    "graph_nodes": _with(*_QW) + "SELECT qid, item, string_agg(DISTINCT widx::VARCHAR, ',' ORDER BY widx::VARCHAR) AS words FROM cand GROUP BY qid, item",
    "edge_weights": _with(*_QW, _ADJ, _PAIRS, _CONN_EDGES) + "SELECT pr.qid, pr.i2 AS i1, pr.i1 AS i2, coalesce(w, 0)::DOUBLE AS w FROM pr LEFT JOIN cedge USING (qid, i1, i2)",
    "graph_components": _with(*_QW, _ADJ, _PAIRS, _CONN_EDGES, "nb AS MATERIALIZED (SELECT qid, i1 AS a, i2 AS b FROM cedge UNION SELECT qid, i2, i1 FROM cedge)", "rc(qid, a, b) AS (SELECT qid, a, a FROM nb UNION SELECT r.qid, r.a, nb.b FROM rc r JOIN nb ON nb.qid = r.qid AND nb.a = r.b)").replace("WITH ", "WITH RECURSIVE ", 1) + "SELECT qid, a AS item, min(b) AS root FROM rc GROUP BY ALL",
    "tuple_score": _with(*_MAIN, "tu AS (SELECT DISTINCT qid, item FROM tk WHERE place = 1)") + "SELECT a.qid, round_even(avg(coalesce(w, 0)), 6)::DOUBLE AS score FROM tu a JOIN tu b ON a.qid = b.qid AND a.item < b.item LEFT JOIN cedge c ON c.qid = a.qid AND c.i1 = a.item AND c.i2 = b.item GROUP BY a.qid",
    "matching_similarity": _with(*_QW, _VEC) + "SELECT c.qid, c.widx, c.item, coalesce(round_even(list_inner_product(a.v, b.v) / (a.nm * b.nm), 4) + 0.0, 0) AS similarity FROM cand c LEFT JOIN iv a USING (item) LEFT JOIN pv b ON b.ph = c.word",
    "topk_fagin": _with(*_ALL, _SCORED.format(rel=0.3, conn=0.2), "fa AS (SELECT *, " + ", ".join(f"row_number() OVER (PARTITION BY qid, widx ORDER BY {c} DESC, rank) AS a{j}" for j, c in enumerate(("match", "rel", "conn", "coh"))) + " FROM sc)",
        "fb AS (SELECT *, greatest(a0, a1, a2, a3) AS full_, least(a0, a1, a2, a3) AS first_, least(4 * a0, 4 * a1 + 1, 4 * a2 + 2, 4 * a3 + 3) AS seen_ FROM fa)", "fc AS (SELECT *, row_number() OVER (PARTITION BY qid, widx ORDER BY full_, seen_) AS nth FROM fb)",
        "fd AS (SELECT *, coalesce(max(full_) FILTER (nth = 5) OVER (PARTITION BY qid, widx), count(*) OVER (PARTITION BY qid, widx)) AS stop FROM fc)") + "SELECT qid, widx, item, round_even(score, 6) AS score, row_number() OVER (PARTITION BY qid, widx ORDER BY score DESC, seen_)::INTEGER AS place FROM fd WHERE first_ <= stop QUALIFY place <= 5",
    "topk_padded": _with(*_ALL, _SCORED.format(rel=0.3, conn=0.2)) + "SELECT wd.qid, wd.widx, item, coalesce(round_even(score, 6), 0)::DOUBLE AS score, p::INTEGER AS place FROM wd, range(1, 26) r(p) LEFT JOIN rk ON rk.qid = wd.qid AND rk.widx = wd.widx AND rk.place = p",
    "search_space_typed": _with(*_MAIN, _space("sp", "tk", 1000), _LABELS, _TOP_TYPE, _TYPED) + "SELECT sp.qid, sp.widx, place::INTEGER AS place, lb.lab AS label, wd.word, fty.fact FROM sp JOIN fty USING (f) JOIN lb ON lb.item = sp.item JOIN wd ON wd.qid = sp.qid AND wd.widx = sp.widx",
    "search_space_bm25": _with(*_MAIN, _space("sp", "tk", 1000)) + "SELECT qid, least(50, count(*)) AS n_facts FROM sp GROUP BY qid",
    "bm25_facts": _with(*_MAIN, _space("sp", "tk", 1000), _LABELS, _VERBAL, _bm25("SELECT qid, row_number() OVER () AS did, text FROM sp JOIN fv USING (f)", _QUESTION)) + "SELECT qid, round_even(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round_even(score, 9) DESC)::INTEGER AS place FROM ss QUALIFY place <= 50",
    "answer_facts": _with(*_MAIN, _space("sp", "tk", 1000)) + f"SELECT qid::INTEGER AS qid, {_e(5, 'k')} AS answer, count(*) AS n FROM (SELECT qid, unnest(items) AS item FROM sp) JOIN qn USING (qid) WHERE item = {_e(5, 'k')} GROUP BY ALL",
    "running_presence": _with(*_MAIN, _space("sp", "tk", 1000), _eval("ev", "sp")) + "SELECT qid, round_even(avg(hit) OVER (ORDER BY qid), 6) AS running FROM ev",
    "assembled": _with(_FACTS) + "SELECT array_to_string(list_concat(items[1:3], flatten(list_sort([x for x in [items[4:5], items[6:7]] if len(x) > 0]))), '|') AS fact FROM fact",
    "triple_pattern": _with(_FACTS) + "SELECT items[1] AS s, items[3] AS o FROM fact WHERE items[2] = 'P17'",
    "clean_values": _with(_TEXTS) + """SELECT 'http://www.wikidata.org/entity/' || item AS cell, item FROM txt UNION ALL SELECT '"+' || d || 'T00:00:00Z"^^<http://www.w3.org/2001/XMLSchema#dateTime>', d || 'T00:00:00Z' FROM (SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders)
UNION ALL SELECT y, y || '-01-01T00:00:00Z' FROM (SELECT DISTINCT year(o_orderdate)::VARCHAR AS y FROM orders)""",
}
SQL["facts_of_rows"] = SQL["assembled"]
_CODES = SQL["kb_dictionary"].replace("SELECT item, kind, CASE kind", "SELECT item, CASE kind")
SQL["encoded"] = f"WITH {_TEXTS}, cd AS ({_CODES}) SELECT item, code FROM (SELECT item FROM txt UNION ALL VALUES ('Q1'), ('nothing')) LEFT JOIN cd USING (item)"
SQL["rekeyed_texts"] = f"WITH {_TEXTS}, cd AS ({_CODES}) SELECT code, item, label AS labels FROM txt JOIN cd USING (item)"
