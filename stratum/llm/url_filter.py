"""URL filter: block and allow rules, and a Beta-binomial reputation of hosts elsewhere.

Labelled outcomes are counted per host, registered domain and public suffix. Each level's
rate is shrunk towards the level above, with a weight that the spread between its members
gives by the method of moments; a host is blocked when the lower bound of the posterior
share of bad pages, a quantile of its Beta distribution, has odds over a multiple of those of the share among
all labelled pages. Only DataFrame and SQL functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange

# Rules of the contract, then second labels that registries of two-letter domains hand names out under.
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
SECOND_LABELS = ["ac", "co", "com", "edu", "go", "gob", "gov", "gouv", "govt", "ltd", "mil", "ne", "net", "nom", "or", "org", "plc", "sch"]
#: Cells of the numerical integral over the log-odds that the Beta quantile is read from, and its reach in standard deviations.
CELLS, REACH = 400, 8


def split_url(url):
    """(host, path) of a url column; both empty without ``://``. A-Z of the host are lower-cased."""
    rest = F.expr("substring({0}, nullif(locate('://', {0}), 0) + 3)".format(url)) if isinstance(url, str) else None
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), upper, lower)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def levels(pages: DataFrame, suffixes: list[str] | None = None) -> DataFrame:
    """Append domain (registered domain) and suffix of column host.

    A suffix is the last label, or the last two below a two-letter domain if the second last is in
    ``SECOND_LABELS``, or the longest of ``suffixes`` (a public suffix list without its wild cards) if given.
    """
    parts = F.split("host", r"\.")
    n = F.when((F.length(F.element_at(parts, -1)) == 2) & F.get(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - 1), 1), F.lit(0)).isin(SECOND_LABELS), F.lit(2)).otherwise(F.lit(1))
    tail = lambda k: F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - k + 1), k), ".")
    for k in range(2, max([1, *(x.count(".") + 1 for x in suffixes or [])]) + 1):
        n = F.when(tail(F.lit(k)).isin([x for x in suffixes if x.count(".") + 1 == k]), F.lit(k)).otherwise(n)
    return pages.withColumn("suffix", tail(n)).withColumn("domain", tail(n + 1))


def _weight(counts: DataFrame, n: str, bad: str, above: str | None) -> tuple[float, float]:
    """Mean rate, and prior weight by the method of moments from the spread around the rates of the level above; one row comes back."""
    groups = counts.groupBy(*([above] if above else [])).agg(F.sum(bad).alias("b"), F.sum(n).alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col(n) * F.col(n)).alias("q"), F.sum(F.col(bad) * F.col(bad) / F.col(n)).alias("s"))
    rate = F.col("b") / F.col("n")
    r = groups.agg(F.sum("b").alias("b"), F.sum("n").alias("n"), F.sum(F.col("s") - F.col("n") * rate * rate - (F.col("k") - 1) * rate * (1 - rate)).alias("excess"), F.sum(F.col("n") - F.col("q") / F.col("n")).alias("spread"), F.sum(F.col("n") * rate * (1 - rate)).alias("within")).first()
    if not r["n"]:
        return 0.5, 2.0
    total = float(r["n"])
    m, within = (float(r["b"]) + 0.5) / (total + 1.0), float(r["within"]) / total
    between = float(r["excess"]) / float(r["spread"]) if r["spread"] > 0 else 0.0
    return m, min(1000.0, max(1.0, within / between - 1.0)) if between > 1e-9 else 1000.0


def _bound(a: str, b: str, level: float) -> F.Column:
    """The ``level`` quantile of Beta(a, b): masses of ``CELLS`` cells of the log-odds around the mode, added up from below."""
    sd = f"sqrt(1 / {a} + 1 / {b})"
    lo, hi = f"(ln({a} / {b}) - {REACH} * ({sd} + 1 / {a}))", f"(ln({a} / {b}) + {REACH} * ({sd} + 1 / {b}))"
    odds = f"transform(sequence(0, {CELLS - 1}), i -> {lo} + ({hi} - {lo}) * (i + 0.5D) / {CELLS})"
    logs = f"transform({odds}, u -> -({a}) * (greatest(-u, 0D) + ln(1 + exp(-abs(u)))) - {b} * (greatest(u, 0D) + ln(1 + exp(-abs(u)))))"
    mass = f"transform(array({logs}), l -> transform(l, x -> exp(x - array_max(l))))[0]"
    step = "struct(s.acc + m as acc, s.i + 1 as i, if(s.acc < goal and s.acc + m >= goal, s.i + (goal - s.acc) / m, s.at) as at)"
    at = f"transform(array({mass}), w -> transform(array({level}D * aggregate(w, 0D, (s, m) -> s + m)), goal -> aggregate(w, struct(0D as acc, 0D as i, 0D as at), (s, m) -> {step}, s -> s.at))[0])[0]"
    return F.expr(f"1 / (1 + exp(-({lo} + ({hi} - {lo}) * {at} / {CELLS})))")


def reputations(labelled: DataFrame, level: float = 0.05) -> tuple[float, list[DataFrame]]:
    """The share of bad pages among all, and [(host, bound), (domain, domain_bound), (suffix, suffix_bound), (all_bound)] from rows (host, domain, suffix, bad 0/1).

    Only what has labels is in them. The bounds of a domain, of a suffix and of all are those of a
    host of which nothing else is known: the level's mean, with the least prior weight on the way down.
    """
    host = labelled.groupBy("host", "domain", "suffix").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("bad").cast("double").alias("b"))
    domain = host.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("b").alias("db"))
    suffix = domain.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("db").alias("sb"))
    m, ws = _weight(suffix, "sn", "sb", None)
    wd, wh = _weight(domain, "dn", "db", "suffix")[1], _weight(host, "n", "b", "domain")[1]
    suffix = suffix.withColumn("sm", (F.col("sb") + ws * m) / (F.col("sn") + ws))
    domain = domain.join(suffix, "suffix").withColumn("dm", (F.col("db") + wd * F.col("sm")) / (F.col("dn") + wd))
    host = host.join(domain.select("domain", "dm"), "domain")

    def bounded(df: DataFrame, key: list[str], a, b, out: str) -> DataFrame:
        return df.select(*key, a.alias("_a"), b.alias("_b")).select(*key, _bound("_a", "_b", level).alias(out))

    prior = lambda mean, w: (F.lit(w) * mean, F.lit(w) * (1 - mean))
    return m, [
        bounded(host, ["host"], F.col("b") + wh * F.col("dm"), F.col("n") - F.col("b") + wh * (1 - F.col("dm")), "bound"),
        bounded(domain, ["domain"], *prior(F.col("dm"), wh), "domain_bound"),
        bounded(suffix, ["suffix"], *prior(F.col("sm"), min(wh, wd)), "suffix_bound"),
        bounded(labelled.sparkSession.range(1), [], *prior(F.lit(m), min(wh, wd, ws)), "all_bound"),
    ]


APPENDED = ("host", "path", "rule", "verdict", "reputation")


def judge(pages: DataFrame, outcomes: DataFrame, url: str = "url", key: str = "page_id", rules: list[tuple[str, str]] = RULES, lift: float = 1.5, level: float = 0.05, suffixes: list[str] | None = None) -> DataFrame:
    """Append host, path, rule, verdict, reputation (lower bound of the share of bad pages).

    ``outcomes`` has rows (key, bad 0/1); repeated keys all count, null keys and outcomes do not. A url that is
    null or has no ``://`` has an empty host and path. The longest fitting rule decides; with none
    the host is blocked if the odds of its bound are over ``lift`` times those of the share of bad pages among all labelled
    ones (a bound over 0.9 always blocks), else allowed. A host without labels has the bound of its registered domain, else of its suffix, else of all.
    Rules of equal length that both fit cannot differ but in kind; the later one wins. Repeated rows stay, other columns pass
    through, those that clash with the appended ones are replaced, and an empty table stays empty.
    """
    mine, back = exchange.set_aside(pages, {*APPENDED, "suffix", "domain", "bound", "domain_bound", "suffix_bound", "all_bound", "_key", "bad"})
    there = {c: h for h, c in back.items()}
    host, path = split_url(f"`{there.get(url, url)}`")
    parsed = mine.withColumn("host", host).withColumn("path", path)
    known = outcomes.toDF("_key", "bad").where("bad is not null")
    labelled = levels(parsed.select(F.col(there.get(key, key)).alias("_key"), "host").join(known, "_key"), suffixes)
    share, (hosts, domains, suffixes_, everywhere) = reputations(labelled, level)
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):  # the longest is asked first
        rule_host, slash, rule_path = text.partition("/")
        fits = ((F.col("host") == rule_host) | F.col("host").endswith("." + rule_host)) & F.col("path").startswith(slash + rule_path)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    out = levels(parsed, suffixes).join(hosts, "host", "left").join(domains, "domain", "left").join(F.broadcast(suffixes_), "suffix", "left").crossJoin(F.broadcast(everywhere))
    out = out.select("host", *(c for c in parsed.columns if c != "host"), F.coalesce("bound", "domain_bound", "suffix_bound", "all_bound").alias("reputation"))
    by_method = F.when(F.col("reputation") > min(0.9, lift * share / (1 - share + lift * share)), "block").otherwise("allow")
    return exchange.put_back(out.withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, by_method)), back, APPENDED)
