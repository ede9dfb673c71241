"""Quality by weak supervision: rules vote or abstain, and EM weighs them.

Every rule says good, bad or nothing about a document. Expectation-maximisation over the
counts of all vote patterns estimates how often each rule is right; the posterior
probability of good quality then decides. Only DataFrame and SQL functions touch documents;
the driver sees at most 3^rules pattern counts.
"""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange

_WS = r"[\\x20\\x09-\\x0D]+"
_WS_CHARS = "' \\t\\n\\u000b\\u000c\\r'"

#: name: (SQL that holds for a good document, SQL that holds for a bad one); neither: abstain.
RULES = {
    "length": ("n_words >= 80", "n_words < 50"),
    "repeats": ("n_repeat_words <= 0.2 * n_words", "n_repeat_words > 0.4 * n_words"),
    "symbols": ("n_symbols <= 0.02 * word_chars", "n_symbols > 0.06 * word_chars"),
    "marked_words": ("n_symbols <= 0.1 * n_words", "n_symbols > 0.25 * n_words"),
    "lines": ("false", "n_dup_lines > 0.3 * n_lines"),
    "word_length": ("word_chars between 3 * n_words and 9 * n_words", "word_chars not between 2 * n_words and 14 * n_words"),
    "distinct": ("n_distinct >= 0.35 * n_words", "n_distinct < 0.15 * n_words"),
}


FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_distinct", "n_repeat_words", "_words", "_lines", "_grams", "_some", "_sorted", "_at")


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Append n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_distinct, n_repeat_words (longs).

    A null text counts as empty. Words, lines and windows are those of the whole text. Columns that clash
    with the appended ones are replaced; rows are independent, and an empty table stays empty.
    """
    have = [F.col(c) for c in docs.columns if c.lower() not in FEATURES]
    a = docs.select(
        *have,
        F.expr(f"filter(split(coalesce(`{text}`, ''), '{_WS}'), w -> w <> '')").alias("_words"),
        F.expr(f"filter(split(coalesce(`{text}`, ''), '\\n'), l -> translate(l, {_WS_CHARS}, '') <> '')").alias("_lines"),
        F.expr(f"cast(length(translate(coalesce(`{text}`, ''), {_WS_CHARS}, '')) as bigint)").alias("word_chars"),
        F.expr(f"cast(length(coalesce(`{text}`, '')) - length(translate(coalesce(`{text}`, ''), '#*$%&|<>', '')) as bigint)").alias("n_symbols"),
    )
    b = a.select(
        *have, "word_chars", "n_symbols",
        F.expr("cast(size(_words) as bigint)").alias("n_words"),
        F.expr("cast(size(_lines) as bigint)").alias("n_lines"),
        F.expr("cast(size(_lines) - size(array_distinct(_lines)) as bigint)").alias("n_dup_lines"),
        F.expr("cast(size(array_distinct(_words)) as bigint)").alias("n_distinct"),
        F.expr("if(size(_words) > 3, transform(sequence(0, size(_words) - 3), i -> xxhash64(_words[i], _words[i + 1], _words[i + 2])), cast(array() as array<bigint>))").alias("_grams"),
    )
    plain = ["word_chars", "n_symbols", "n_words", "n_lines", "n_dup_lines", "n_distinct"]
    c = b.select(*have, *plain, "_grams", F.expr("size(array_distinct(_grams)) < size(_grams)").alias("_some"))
    d = c.select(*have, *plain, F.expr("if(_some, sort_array(transform(_grams, (h, i) -> struct(h, i))), null)").alias("_sorted"))
    places = "transform(filter(sequence(0, size(_sorted) - 1), j -> coalesce(get(_sorted, j - 1).h = _sorted[j].h, false) or coalesce(get(_sorted, j + 1).h = _sorted[j].h, false)), j -> _sorted[j].i)"
    e = d.select(*have, *plain, F.expr(f"if(_sorted is null, null, sort_array({places}))").alias("_at"))
    covered = "aggregate(sequence(0, size(_at) - 1), 0L, (s, j) -> s + coalesce(least(3, get(_at, j + 1) - _at[j]), 3))"
    return e.select(*have, *plain, F.expr(f"if(_at is null, 0L, {covered})").alias("n_repeat_words"))


def votes(rules: dict[str, tuple[str, str]] = RULES):
    """A column that has a digit for each rule: 1 good, 0 bad, 2 abstain."""
    return F.concat(*[F.when(F.expr(bad), "0").when(F.expr(good), "1").otherwise("2") for good, bad in rules.values()])


def estimate(counts: dict[str, int], n_rules: int, rounds: int = 50, prior: float = 0.8, accuracy: float = 0.85) -> dict[str, float]:
    """Posterior probability of good quality of every possible pattern, by EM over pattern counts.

    The prior stays within [0.05, 0.95] and a good vote is at least as likely for a good
    document as for a bad one, so rules keep their meaning whatever the corpus; no document at
    all leaves the starting values.
    """
    good, bad = [accuracy] * n_rules, [accuracy] * n_rules  # P(vote good | good), P(vote bad | bad)
    patterns = ["".join(p) for p in product("012", repeat=n_rules)]

    def posterior(p: str) -> float:
        x = math.log(prior / (1 - prior))
        for k, v in enumerate(p):
            if v == "1":
                x += math.log(good[k] / (1 - bad[k]))
            elif v == "0":
                x += math.log((1 - good[k]) / bad[k])
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))

    clamp = lambda x, lo, hi: max(lo, min(hi, x))
    total = sum(counts.values())
    for _ in range(rounds if total else 0):
        post = {p: posterior(p) for p in counts}
        new_prior = clamp(sum(n * post[p] for p, n in counts.items()) / total, 0.05, 0.95)
        for k in range(n_rules):
            g = [sum(n * post[p] for p, n in counts.items() if p[k] == v) for v in "10"]
            b = [sum(n * (1 - post[p]) for p, n in counts.items() if p[k] == v) for v in "01"]
            good[k] = clamp((g[0] + 8.5) / (g[0] + g[1] + 10), 0.5, 0.99)
            bad[k] = clamp((b[0] + 8.5) / (b[0] + b[1] + 10), 1.02 - good[k], 0.99)
        prior = new_prior
    return {p: posterior(p) for p in patterns}


BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


def posteriors(voted: DataFrame) -> dict[str, float]:
    """Posterior of every vote pattern that column _votes has; at most 3^rules counts come to the driver."""
    counts = {r["_votes"]: r["count"] for r in voted.groupBy("_votes").count().collect()}
    posterior = estimate(counts, len(RULES)) if counts else {}
    return {p: posterior[p] for p in counts}


def _quality(posterior: dict[str, float]):
    if not posterior:
        return F.lit(0.5)
    table = F.create_map(*[x for p in sorted(posterior) for x in (F.lit(p), F.lit(posterior[p]))])
    return F.coalesce(table[F.col("_votes")], F.lit(0.5))


def judge(found: DataFrame, least: float = 0.5) -> DataFrame:
    """Append base_failed, quality (posterior probability) and kept to rows that have the features, which are read twice.

    Fewer than 50 words, or over half of the words in repeated windows, fail in any case. Columns that
    clash with the appended ones are replaced.
    """
    voted = found.withColumn("_votes", votes())
    out = voted.withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("quality", _quality(posteriors(voted)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least)).drop("_votes")


OWN = {*FEATURES, "base_failed", "quality", "kept", "_votes", "_failed"}


def keep_good(docs: DataFrame, text: str = "text", least: float = 0.5) -> DataFrame:
    """The documents that are kept, with all their columns; clashing names are set aside meanwhile.

    Rules are asked once: rows are written with their votes, of which the counts read nothing else.
    """
    mine, back = exchange.set_aside(docs, OWN)
    text_at = {c: h for h, c in back.items()}.get(text, text)
    voted = features(mine, text_at).select(*mine.columns, votes().alias("_votes"), F.expr(BASE_FAILED).alias("_failed"))
    voted = exchange.written(voted, "votes")
    kept = voted.where(~F.col("_failed") & (_quality(posteriors(voted)) >= least))
    return kept.drop("_votes", "_failed").withColumnsRenamed(back).select(*docs.columns)
