"""Queries of this subpackage in SQL for DuckDB, where SQL can express them."""

from __future__ import annotations

from .license_scan import FUNCTION_WORDS, PHRASES, TEMPLATES
from .quality import RULES
from .url_filter import CELLS, REACH, SECOND_LABELS
from .url_filter import RULES as URL_RULES

_SPACED = r"[^\x20\x09-\x0D]+"
_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _low(x: str) -> str:
    return f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _weight(name: str, table: str, n: str, b: str, above: str) -> str:
    """CTE (m, w): mean rate and prior weight by the method of moments."""
    return f"""{name}0 AS (SELECT sum({b}) AS b, sum({n}) AS n, count(*) AS k, sum({n} * {n}) AS q, sum({b} * {b} / {n}) AS s FROM {table} GROUP BY {above}),
{name}1 AS (SELECT sum(b) AS b, sum(n) AS n, sum(s - n * (b / n) * (b / n) - (k - 1) * (b / n) * (1 - b / n)) / sum(n - q / n) AS betw, sum(n * (b / n) * (1 - b / n)) / sum(n) AS within FROM {name}0),
{name} AS MATERIALIZED (SELECT (b + 0.5) / (n + 1) AS m, CASE WHEN betw > 1e-9 THEN least(1000.0, greatest(1.0, within / betw - 1)) ELSE 1000.0 END AS w FROM {name}1)"""


def _bound(name: str, source: str) -> str:
    """CTE (key, bound): the 5 % quantile of Beta(a, b) from (key, a, b)."""
    return f"""{name}0 AS (SELECT key, a, b, ln(a / b) - {REACH} * (sqrt(1 / a + 1 / b) + 1 / a) AS lo, ln(a / b) + {REACH} * (sqrt(1 / a + 1 / b) + 1 / b) AS hi FROM (SELECT key, a::DOUBLE AS a, b::DOUBLE AS b FROM ({source}))),
{name}1 AS (SELECT key, a, b, lo, hi, i, lo + (hi - lo) * (i + 0.5::DOUBLE) / {CELLS} AS u FROM {name}0, range({CELLS}) r(i)),
{name}2 AS (SELECT key, lo, hi, i, -a * (greatest(-u, 0) + ln(1 + exp(-abs(u)))) - b * (greatest(u, 0) + ln(1 + exp(-abs(u)))) AS l FROM {name}1),
{name}3 AS (SELECT key, lo, hi, i, exp(l - max(l) OVER (PARTITION BY key)) AS m FROM {name}2),
{name}4 AS (SELECT *, sum(m) OVER (PARTITION BY key ORDER BY i) - m AS before, 0.05 * sum(m) OVER (PARTITION BY key) AS goal FROM {name}3),
{name} AS MATERIALIZED (SELECT key, 1 / (1 + exp(-(lo + (hi - lo) * (i + (goal - before) / m) / {CELLS}))) AS bound FROM {name}4 WHERE before < goal AND before + m >= goal)"""


def _rule(what: int) -> str:
    cases = []
    for kind, text in sorted(URL_RULES, key=lambda r: -len(r[1])):
        host, slash, path = text.partition("/")
        cases.append(f"WHEN (host = '{host}' OR host LIKE '%.{host}') AND starts_with(path, '{slash}{path}') THEN '{(kind, text)[what]}'")
    return "CASE " + " ".join(cases) + " END"


_SECOND = ", ".join(f"'{x}'" for x in SECOND_LABELS)

OP4 = f"""WITH u AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS rest FROM pages),
p AS MATERIALIZED (SELECT page_id, coalesce({_low("regexp_extract(rest, '^([^/?#]*)', 1)")}, '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
h AS (SELECT DISTINCT host, string_split(host, '.') AS parts FROM p),
lv0 AS (SELECT host, parts, CASE WHEN length(parts[-1]) = 2 AND parts[-2] IN ({_SECOND}) THEN 2 ELSE 1 END AS n FROM h),
lv AS MATERIALIZED (SELECT host, array_to_string(parts[greatest(1, len(parts) - n + 1):], '.') AS suffix, array_to_string(parts[greatest(1, len(parts) - n):], '.') AS domain FROM lv0),
hc AS MATERIALIZED (SELECT host, domain, suffix, count(*)::DOUBLE AS n, sum(greatest(1 - quality, toxic))::DOUBLE AS b FROM p JOIN labels ON doc_id = page_id JOIN lv USING (host) WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY ALL),
dc AS (SELECT domain, suffix, sum(n) AS dn, sum(b) AS db FROM hc GROUP BY ALL), sc AS (SELECT suffix, sum(dn) AS sn, sum(db) AS sb FROM dc GROUP BY ALL),
{_weight("ws", "sc", "sn", "sb", "()")}, {_weight("wd", "dc", "dn", "db", "suffix")}, {_weight("wh", "hc", "n", "b", "domain")},
sm AS (SELECT suffix, (sb + ws.w * ws.m) / (sn + ws.w) AS sm FROM sc, ws), dm AS (SELECT domain, (db + wd.w * sm) / (dn + wd.w) AS dm FROM dc JOIN sm USING (suffix), wd),
{_bound("hb", "SELECT host AS key, b + wh.w * dm AS a, n - b + wh.w * (1 - dm) AS b FROM hc JOIN dm USING (domain), wh")},
{_bound("db", "SELECT domain AS key, wh.w * dm AS a, wh.w * (1 - dm) AS b FROM dm, wh")},
{_bound("sb", "SELECT suffix AS key, least(wh.w, wd.w) * sm AS a, least(wh.w, wd.w) * (1 - sm) AS b FROM sm, wh, wd")},
{_bound("ab", "SELECT 0 AS key, least(wh.w, wd.w, ws.w) * ws.m AS a, least(wh.w, wd.w, ws.w) * (1 - ws.m) AS b FROM ws, wd, wh")}
SELECT page_id, host, path, {_rule(1)} AS rule, coalesce({_rule(0)}, CASE WHEN coalesce(hb.bound, db.bound, sb.bound, ab.bound) > least(0.9, 1.5 * ws.m / (1 - ws.m + 1.5 * ws.m)) THEN 'block' ELSE 'allow' END) AS verdict,
  round_even(coalesce(hb.bound, db.bound, sb.bound, ab.bound), 6) AS reputation
FROM p JOIN lv USING (host) LEFT JOIN hb ON hb.key = host LEFT JOIN db ON db.key = domain LEFT JOIN sb ON sb.key = suffix, ab, ws"""

OP6 = rf"""WITH s AS MATERIALIZED (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_SPACED}'))::BIGINT AS size, md5('42:' || coalesce(doc_id::VARCHAR, 'null')) AS k FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS n FROM s GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM t),
o AS (SELECT *, row_number() OVER (ORDER BY 3 * n / w, source) AS j, 3 * n / w AS ratio, sum(n) OVER () AS total, sum(w) OVER () AS all_w FROM w),
c AS (SELECT *, (total - coalesce(sum(3 * n) OVER (ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS left_, all_w - coalesce(sum(w) OVER (ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_w FROM o),
f AS (SELECT min(j) AS j FROM c WHERE left_ * w / rest_w <= 3 * n),
a AS (SELECT c.source, c.n, CASE WHEN f.j IS NULL OR c.j < f.j THEN 3.0 * c.n ELSE d.left_ * c.w / d.rest_w END::DOUBLE AS target FROM c LEFT JOIN f ON true LEFT JOIN c d ON d.j = f.j),
p AS (SELECT s.*, a.n, a.target, CASE WHEN n > 0 THEN floor(target / n)::BIGINT ELSE 0 END AS whole, sum(size) OVER (PARTITION BY s.source ORDER BY k) - size AS before FROM s JOIN a ON a.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, size, n AS source_size, target, (whole * size + greatest(0, least(size, floor(target)::BIGINT - whole * n - before)))::BIGINT AS taken FROM p"""

OP8 = rf"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_low("coalesce(text, '')")}, '{_WORDS}') AS ws FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS id, regexp_extract_all({_low("coalesce(text, '')")}, '{_WORDS}') AS ws FROM benchmark),
bk AS (SELECT id, ws, least(8, len(ws)) AS k FROM b WHERE len(ws) > 0),
bw AS MATERIALIZED (SELECT DISTINCT id, k, array_to_string(ws[i:i + k - 1], ' ') AS g FROM bk, LATERAL (SELECT unnest(range(1, len(ws) - k + 2)) AS i)),
dw AS (SELECT rid, k, i, array_to_string(ws[i:i + k - 1], ' ') AS g FROM d, (SELECT DISTINCT k FROM bw), LATERAL (SELECT unnest(range(1, len(ws) - k + 2)) AS i)),
h AS MATERIALIZED (SELECT rid, i, k, id FROM dw JOIN bw USING (k, g)),
n AS (SELECT rid, count(DISTINCT spot) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS spot FROM (SELECT DISTINCT rid, i, k FROM h)) GROUP BY rid),
m AS (SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT rid, id FROM h) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated FROM d LEFT JOIN n USING (rid) LEFT JOIN m USING (rid)"""


def _em() -> str:
    """CTE em: the rules' accuracies after 50 rounds over the pattern counts, one row that carries all counts along as a list."""
    k = len(RULES)
    post = f"""list_transform(list_transform(ps, lambda p: ln(prior / (1 - prior)) + list_sum(list_transform(range(1, {k + 1}), lambda r: CASE p.v[r] WHEN '1' THEN ln(good[r] / (1 - bad[r])) WHEN '0' THEN ln((1 - good[r]) / bad[r]) ELSE 0.0 END))), lambda x: 1 / (1 + exp(-greatest(-500.0, least(500.0, x)))))"""
    some = lambda v, q: f"list_sum(list_transform(range(1, len(ps) + 1), lambda j: CASE WHEN ps[j].v[r] = '{v}' THEN ps[j].n * ({q}) ELSE 0.0 END))"
    return f"""ps AS MATERIALIZED (SELECT list(struct_pack(v := string_split(votes, ''), n := n) ORDER BY votes) AS ps, sum(n) AS total FROM (SELECT votes, count(*)::DOUBLE AS n FROM v GROUP BY votes)),
em(i, ps, total, prior, good, bad) AS (SELECT 0, ps, total, 0.8::DOUBLE, list_transform(range({k}), lambda r: 0.85::DOUBLE), list_transform(range({k}), lambda r: 0.85::DOUBLE) FROM ps
UNION ALL SELECT i + 1, ps, total, greatest(0.05, least(0.95, mass / total)), good2, list_transform(range(1, {k + 1}), lambda r: greatest(1.02 - good2[r], least(0.99, (b0[r] + 8.5) / (b0[r] + b1[r] + 10)))) FROM
(SELECT *, list_transform(range(1, {k + 1}), lambda r: greatest(0.5, least(0.99, (g1[r] + 8.5) / (g1[r] + g0[r] + 10)))) AS good2 FROM
(SELECT *, list_sum(list_transform(range(1, len(ps) + 1), lambda j: ps[j].n * q[j])) AS mass, list_transform(range(1, {k + 1}), lambda r: {some("1", "q[j]")}) AS g1, list_transform(range(1, {k + 1}), lambda r: {some("0", "q[j]")}) AS g0,
list_transform(range(1, {k + 1}), lambda r: {some("0", "1 - q[j]")}) AS b0, list_transform(range(1, {k + 1}), lambda r: {some("1", "1 - q[j]")}) AS b1 FROM (SELECT *, {post} AS q FROM em WHERE i < 50)))),
po AS MATERIALIZED (SELECT unnest(list_transform(ps, lambda p: array_to_string(p.v, ''))) AS votes, unnest({post}) AS quality FROM em WHERE i = 50)"""


_VOTES = " || ".join(f"CASE WHEN {bad} THEN '0' WHEN {good} THEN '1' ELSE '2' END" for good, bad in RULES.values())
_WS = r"[\x20\x09-\x0D]+"

OP9 = rf"""WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '{_SPACED}')) AS ls FROM documents),
g AS MATERIALIZED (SELECT rid, i, array_to_string(ws[i:i + 2], ' ') AS g FROM d, LATERAL (SELECT unnest(range(1, len(ws) - 1)) AS i)),
rp AS (SELECT rid, g FROM g GROUP BY ALL HAVING count(*) > 1),
rw AS (SELECT rid, count(DISTINCT spot) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS spot FROM g JOIN rp USING (rid, g)) GROUP BY rid),
f AS MATERIALIZED (SELECT rid, doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '{_WS}', '', 'g'))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls)::BIGINT AS n_lines, len(list_distinct(ws))::BIGINT AS n_distinct, coalesce(n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN rw USING (rid)),
v AS MATERIALIZED (SELECT *, {_VOTES} AS votes FROM f),
{_em()}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND quality >= 0.5 AS kept, round_even(quality, 6) AS quality FROM v JOIN po USING (votes)"""


def _op7() -> str:
    """Votes of each template's rarest words in a text, by offset; labels where two agree and the phrase stands in the text."""
    words = lambda t: [w for w in "".join(c if c.isalnum() else " " for c in t.lower()).split()]
    posts = ", ".join(f"({t}, {p}, '{w}')" for t, (_, notice, _) in enumerate(TEMPLATES) for p, w in enumerate(words(notice)) if w not in FUNCTION_WORDS)
    keys = ", ".join(f"({t}, '{label}', '{phrase}', {len(phrase.split())})" for t, (label, _, phrase) in enumerate(TEMPLATES))
    base = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in PHRASES.items())
    return rf"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_low("coalesce(text, '')")}, '{_WORDS}') AS ws FROM documents),
po(t, p, w) AS (VALUES {posts}), ky(t, label, phrase, k) AS (VALUES {keys}), bp(phrase, label, k) AS (VALUES {base}),
vo AS (SELECT w FROM po UNION SELECT unnest(string_split(phrase, ' ')) FROM ky UNION SELECT unnest(string_split(phrase, ' ')) FROM bp),
hw AS MATERIALIZED (SELECT rid, w, i - 1 AS i FROM (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d) SEMI JOIN vo USING (w)),
fr AS (SELECT w, count(DISTINCT rid) AS n FROM hw GROUP BY w),
idf AS MATERIALIZED (SELECT w, ln(((SELECT count(*) FROM d) + 1) / (coalesce(n, 0) + 1)) AS idf FROM vo LEFT JOIN fr USING (w)),
ph AS MATERIALIZED (SELECT DISTINCT phrase, k FROM ky UNION SELECT phrase, k FROM bp),
fi AS MATERIALIZED (SELECT h.rid, h.i, ph.phrase FROM hw h JOIN ph ON split_part(ph.phrase, ' ', 1) = h.w JOIN d ON d.rid = h.rid WHERE array_to_string(d.ws[h.i + 1:h.i + ph.k], ' ') = ph.phrase),
bs AS (SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, array_to_string(list_sort(list_distinct(list(label))), ',') AS base_labels, list(label) AS ls FROM fi JOIN bp USING (phrase) GROUP BY rid),
lk AS MATERIALIZED (SELECT rid, t, w FROM (SELECT DISTINCT h.rid, po.t, po.w, idf FROM hw h JOIN po USING (w) JOIN idf USING (w)) QUALIFY row_number() OVER (PARTITION BY rid, t ORDER BY idf DESC, w) <= 6),
vt AS (SELECT lk.rid, lk.t, h.i - po.p AS o, count(*) AS n FROM lk JOIN hw h ON h.rid = lk.rid AND h.w = lk.w JOIN po ON po.t = lk.t AND po.w = lk.w GROUP BY ALL HAVING count(*) >= 2),
sz AS (SELECT t, least(6, count(*)) AS least_ FROM po GROUP BY t),
fo AS (SELECT vt.rid, list(DISTINCT ky.label) AS ls, max(least(1.0, vt.n / least_)) AS score FROM vt JOIN ky USING (t) JOIN sz USING (t) SEMI JOIN fi ON fi.rid = vt.rid AND fi.phrase = ky.phrase GROUP BY vt.rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(bs.ls, []), coalesce(fo.ls, [])))), ',') AS labels, (CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(fo.score, 0.0) END)::DOUBLE AS score
FROM d LEFT JOIN bs USING (rid) LEFT JOIN fo USING (rid)"""


SQL: dict[str, str] = {"op4_url_filter": OP4, "op6_mixing": OP6, "op7_license_scan": _op7(), "op8_decontaminate": OP8, "op9_quality": OP9}
