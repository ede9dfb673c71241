"""Brute-force versions of the training-data operators on small fixtures with odd rows."""

import collections
import hashlib
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from stratum.llm import arrays, decontaminate, html_extract, license_scan, lm_scoring, mixing, quality, simhash, suffix_dedup, token_output, url_filter
from stratum.llm.queries import VOCABULARY

WORD, ALNUM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LONG = "the quick brown fox jumps over the lazy dog and runs far away from here to there again "
TEXTS = [None, "", " ", "a", "Mit License", LONG * 3, LONG * 3, LONG * 3 + "x", LONG + "Licensed under CC BY-NC 4.0. " + LONG, "é ü  z\n\n" + LONG, "w " * 3000, "Under the Apache License and MIT-license " * 2, LONG * 300]
SCHEMA = "doc_id long, text string, source string, n_words int, size string, kept string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 4 else None, t, ["b", "a", None][i % 3], 7, "s", "k") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows + [rows[5]], SCHEMA).cache()  # one row twice; names that clash


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_simhash(docs, empty):
    def ref(t):
        w = WORD.findall(low(t))
        g = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 3 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in g]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    fps = {r.doc_id: r.fp % 2**64 for r in rows}
    assert all(fps[i] == ref(t) for i, t in enumerate(TEXTS) if i != 4)
    root = {i: i for i in fps}
    for _ in fps:
        for a in fps:
            for b in fps:
                if bin(fps[a] ^ fps[b]).count("1") <= 2:
                    root[a] = root[b] = min((x for x in (root[a], root[b]) if x is not None), default=None)
    assert {r.doc_id: r.component for r in rows} == root
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and {0, 5} <= {r.doc_id for r in kept.collect()} and kept.where("doc_id in (1, 2, 6)").count() == 0


def test_bit_sliced_links_find_every_pair():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, base ^ np.uint64(1), base ^ np.uint64(0b1010), base ^ np.uint64(0b111)]))
    i, j = simhash.bit_sliced_links(fps, np.zeros(len(fps), np.int64))
    want = {(a, b) for a in range(len(fps)) for b in range(a + 1, len(fps)) if bin(int(fps[a] ^ fps[b])).count("1") <= 2}
    assert set(zip(i.tolist(), j.tolist())) == want


def test_decontaminate(spark, docs, empty):
    items = [(1, LONG), (2, "w w w"), (10, "MIT, license"), (3, None), (4, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = collections.defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(low(t))
        k = min(8, len(w))
        for a in range(len(w) - k + 1 if w else 0):
            windows[tuple(w[a : a + k])].add(str(i))
    for r in decontaminate.report(docs, bench).collect():
        t = TEXTS[r.doc_id if r.doc_id is not None else 4]
        w, hit, found = ALNUM.findall(low(t)), set(), set()
        for k in {len(x) for x in windows}:
            for a in range(len(w) - k + 1):
                if o := windows.get(tuple(w[a : a + k])):
                    hit |= set(range(a, a + k))
                    found |= o
        assert (r.n_words, r.n_hit, sorted(r["items"])) == (len(w), len(hit), sorted(found))
    several = decontaminate.scan(docs.drop("n_words"), decontaminate.build_index(bench, most_chars=40))
    assert sorted((r.n_words, str(r.spans), r["items"]) for r in several.collect()) == sorted((r.n_words, str(r.spans), r["items"]) for r in decontaminate.scan(docs.drop("n_words"), decontaminate.build_index(bench)).collect())
    assert decontaminate.report(empty, bench).count() == 0
    assert decontaminate.remove(docs, bench.limit(0)).count() == docs.count()
    cut = {r.doc_id: r.text for r in decontaminate.remove(docs, bench, most_share=0.99).collect()}
    assert cut[8].strip() == ". Licensed under CC BY-NC 4.0. ." or LONG.strip() not in cut[8]


def held_at_most(f):
    """What ``f()`` gives, and the MB that it held at a time."""
    tracemalloc.start()
    try:
        return f(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_hashing_and_decontamination_hold_little_beside_the_text(monkeypatch):
    monkeypatch.setattr(arrays, "_powers", {})
    long = b"ab" * arrays.HASH_BYTES  # a word of two windows
    words = [*(b"w%06d" % (i % 70_000) for i in range(700_000)), long, *(b"w%06d" % i for i in range(50_000)), long]
    buf = np.frombuffer(b" ".join(words), np.uint8)
    starts, ends, _ = arrays.word_spans(buf, np.array([0, len(buf)]), arrays.WORD_CHARS)
    hashes, mb = held_at_most(lambda: arrays.hash_spans(buf, starts, ends, arrays.FOLDED))
    assert mb < 60  # 20 for the places and hashes, and the long word's own tables
    assert sum(x.nbytes for x in arrays._powers.values()) < 10e6  # a worker keeps these
    one = lambda w: int(arrays.hash_spans(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]), arrays.FOLDED)[0])
    assert len(hashes) == len(words) and len(set(hashes.tolist())) == 70_001
    assert all(int(hashes[i]) == one(words[i]) for i in [*range(0, 750_000, 9973), 699_999, 700_000, 700_001, len(words) - 1])
    rows = pa.array([" ".join(f"w{i % 5000:06d}" for i in range(a, a + 300)) + " " + LONG for a in range(2500)])
    index = decontaminate.Index([("x", LONG)], 8)
    found, mb = held_at_most(lambda: [(n.tolist(), [f and (f["spans"], f["items"]) for f in x]) for n, x in index.rows(rows)])
    n = len(LONG.split())
    assert sum((x for x, _ in found), []) == [300 + n] * 2500 and all(f[1] == {0} and sum(b - a for a, b in f[0]) == n for _, x in found for f in x)
    assert mb < 70  # 138 with slabs and windows of 6 MB


def test_suffix_dedup(docs, empty):
    seen, want = set(), []
    rows = sorted(((i, t) for i, t in enumerate(TEXTS) if i != 4), key=lambda r: r[0]) + [(None, TEXTS[4])]
    rows.insert(6, (5, TEXTS[5]))
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(b[k : k + 100])
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        want.append((i, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, r)
    assert sorted((tuple(r) for r in suffix_dedup.remove_repeats(docs).collect()), key=key) == sorted(want, key=key)
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_mixing(docs, empty):
    rows = mixing.mix(docs).collect()
    by = collections.defaultdict(int)
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        by[r.source] += r.taken
    aim = {r.source: r.target for r in rows}
    assert all(abs(by[s] - int(aim[s])) <= 1 for s in aim) and abs(sum(aim.values()) - sum(r.size for r in rows)) < 1e-6
    assert mixing.targets([("a", 10), ("b", 10), (None, 10)]) == {"a": 18.75, "b": 7.5, None: 3.75}
    again = mixing.repeat(docs)
    assert again.columns == docs.columns and again.select(F.sum(mixing.n_words(F.col("text")))).first()[0] == sum(by.values())
    assert mixing.mix(empty).count() == 0


def test_quality(docs, empty):
    found = {r.doc_id: r for r in quality.judge(quality.features(docs).drop("text")).collect()}
    for i, t in enumerate(TEXTS):
        w = WORD.findall(t or "")
        grams = collections.Counter(zip(w, w[1:], w[2:]))
        repeat = {a + k for a in range(len(w) - 2) if grams[tuple(w[a : a + 3])] > 1 for k in range(3)}
        r = found[i if i != 4 else None]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(repeat))
        assert r.base_failed == (len(w) < 50 or 100 * len(repeat) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert quality.keep_good(docs).columns == docs.columns and quality.keep_good(empty).count() == 0


def test_license(docs, empty):
    rows = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    assert rows[None].base_labels == "mit" and rows[None].first_word == 0 and rows[11].n_base == 4 and rows[11].base_labels == "apache,mit"
    assert rows[8].labels == "cc-by-nc" and rows[8].base_labels == "" and rows[0].n_words == 0 and rows[0].first_word is None
    assert license_scan.scan(empty).count() == 0


def test_urls(spark):
    urls = ["http://A.Example.com/en/71?q", None, "nothing", "https://example.com/en/9", "http://x.net/de/8", "http://example.net/de/8#a", "http://q.org/fr/", "http://bad.info/x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    more = spark.createDataFrame([(100 + i, "http://bad.info/y") for i in range(60)] + [(200 + i, "http://good.info/") for i in range(60)], "page_id long, url string")
    outcomes = spark.createDataFrame([(100 + i, 1) for i in range(60)] + [(200 + i, 0) for i in range(60)] + [(None, 1)], "k long, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages.union(more), outcomes).collect()}
    assert got[0] == ("a.example.com", "/en/71", "example.com/en/7", "allow") and got[1] == ("", "", None, "allow") == got[2]
    assert got[3][2:] == ("com/en/", "block") and got[4][2:] == ("net/de/", "allow") and got[5][2:] == ("example.net/de/8", "block")
    assert got[7][3] == "block" and got[200][3] == "allow"
    assert url_filter.judge(pages.limit(0), outcomes).count() == 0


def test_html():
    page = "<body><nav><a href=x>Home</a></nav><article><h1>A &amp; B</h1><p>One<br>two.<p>The <b>end</b> of it.<div class='comments'><p>I think so</div></article><footer>c</footer><script>x('</p>')</script>"
    assert html_extract.main_text(page) == "A & B\nOne two.\nThe end of it."
    assert html_extract.main_text(None) == html_extract.main_text("") == ""


def test_scores(docs, empty):
    rows = lm_scoring.score(docs.select("doc_id", "text"), F.col("doc_id") == 12).collect()
    train = [low(t) for i, t in enumerate(TEXTS) if i != 12] + [low(TEXTS[5])]
    count = collections.Counter(w for t in train for w in [*WORD.findall(t), None])
    n, v = sum(count.values()), len(count)
    for r in rows:
        w = [*WORD.findall(low(TEXTS[r.doc_id if r.doc_id is not None else 4])), None]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(count[x] > 0 for x in w), n)
        assert abs(r.base_score - sum(np.log10((count[x] + 1) / (n + v + 1)) for x in w)) < 1e-6 * len(w) and r.score < 0
    assert lm_scoring.score(empty.select("doc_id", "text"), F.lit(False)).count() == 0


def test_tokens(spark, docs, empty, tmp_path):
    enc = token_output.Encoder(open(VOCABULARY, "rb").read())
    rows = token_output.materialise(docs, VOCABULARY, length=64, per_shard=50).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    for i, t in enumerate(TEXTS):
        own = collections.defaultdict(list)
        for r in rows:
            if r.doc_id == (i if i != 4 else None):
                own[r.seq].append(np.frombuffer(r.record, np.uint16)[: r.n_tokens].tolist())
        assert sum((own[k][0] for k in sorted(own)), []) == enc.encode(t or "") + [enc.end]
    p = token_output.Feistel(1000, 7)
    assert sorted(p.forward(np.arange(1000))) == list(range(1000)) and (p.back(p.forward(np.arange(1000))) == np.arange(1000)).all()
    assert token_output.materialise(empty, VOCABULARY).count() == 0
    placed = token_output.materialise(docs, VOCABULARY, length=64, per_shard=50)
    token_output.write_shards(placed, str(tmp_path / "s"))
    by = {r.slot: r.record for r in rows}
    starts = {r.slot: (r.shard, r.offset) for r in rows}
    raw = {k: b"".join(bytes(r[0]) for r in spark.read.format("binaryFile").load(f"{tmp_path}/s/shard={k}").select("content").collect()) for k in {k for k, _ in starts.values()}}
    assert all(raw[k][at : at + 128] == by[slot] for slot, (k, at) in starts.items())  # every record lies where the query says
    for first, count in ((0, 3), (47, 60), (len(rows) - 2, 2), (3, 0)):
        got = token_output.read_from(spark, str(tmp_path / "s"), first, count, 50, 64).collect()
        assert [(r.slot, bytes(r.record)) for r in got] == [(k, bytes(by[k])) for k in range(first, first + count)]
    with pytest.raises(IndexError):
        token_output.read_from(spark, str(tmp_path / "s"), len(rows) - 2, 3, 50, 64)
    with pytest.raises(IndexError):
        token_output.read_from(spark, str(tmp_path / "s"), len(rows) + 500, 1, 50, 64)


def test_shards_are_dealt_once(spark, tmp_path, monkeypatch):
    """The pipeline's last stage deals the records out once for the shards, not first into the order of its result."""
    import corpus_pipeline

    plans = []
    monkeypatch.setattr(token_output, "write_shards", lambda placed, path: plans.append(placed.select("shard", "slot", "record")._jdf.queryExecution().optimizedPlan().toString()))
    docs = spark.createDataFrame([(i, "a few words " * i) for i in range(50)], "doc_id long, text string")
    out = corpus_pipeline.token_sequences(spark, docs, "")
    assert "Repartition" not in plans[0]
    assert out.columns == ["slot", "shard", "offset", "doc_id", "seq", "n_tokens", "record"] and [r.slot for r in out.collect()] == list(range(out.count()))


def _jaccard(a, b, n=5):
    x, y = ({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def test_wide_links_are_those_of_brute_force():
    rng = np.random.default_rng(3)
    base, rows = rng.integers(0, 1 << 63, (4, 8), dtype=np.uint64), []
    for i in range(200):
        x = base[i % 4].copy()
        for p in rng.choice(512, rng.integers(0, 70), replace=False):
            x[p >> 6] ^= np.uint64(1) << np.uint64(p & 63)
        rows.append(x)
    fps, group = np.array(rows), np.repeat([0, 1], [130, 70])
    apart = lambda i, j: sum(int(x).bit_count() for x in fps[i] ^ fps[j])
    want = {(i, j) for i in range(200) for j in range(i + 1, 200) if group[i] == group[j] and apart(i, j) <= simhash.WIDE_RADIUS}
    assert set(zip(*(x.tolist() for x in simhash.wide_links(fps, group)))) == want


def test_keep_one_finds_copies_of_similarity_over_0_8_and_keeps_the_rest(spark):
    rng = random.Random(5)
    rows, copies = [], set()
    for k in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        rows.append((10 * k, " ".join(words)))
        for c, changes in enumerate((1, 3, 5), 1):
            other = list(words)
            for p in rng.sample(range(300), changes):
                other[p] = "x"
            rows.append((10 * k + c, " ".join(other)))
            assert _jaccard(rows[-1][1], " ".join(words)) > 0.8
            copies.add(10 * k + c)
        far = words[:150] + [f"v{rng.randrange(5000)}" for _ in range(150)]  # shares a passage only
        rows.append((10 * k + 9, " ".join(far)))
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {r[0] for r in rows} - copies


def test_a_key_of_thousands_is_linked_in_parts():
    rng = np.random.default_rng(9)
    base, n = rng.integers(0, 1 << 63, (2, 8), dtype=np.uint64), 9000
    fps = base[np.arange(n) % 2].copy()
    fps[np.arange(n), rng.integers(0, 8, n)] ^= np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64)
    batches = [pa.RecordBatch.from_arrays([pa.array(np.full(1000, 7)), pa.array(np.arange(a, a + 1000)), pa.array([x.tobytes() for x in fps[a : a + 1000]], pa.binary())], ["key", "same", "fp"]) for a in range(0, n, 1000)]
    edges = [e for b in simhash._wide_link_partition(batches) for e in zip(*(c.to_pylist() for c in b.columns))]
    root = simhash._spanning(np.array([b for _, b in edges]), np.array([a for a, _ in edges]), n)
    assert (root == np.arange(n) % 2).all()


def test_members_of_a_hot_key_are_compared_with_all_that_come_later():
    rng = np.random.default_rng(4)
    flip = lambda x, a, z: x ^ np.array([sum(1 << p - 64 * w for p in range(max(a, 64 * w), min(z, 64 * w + 64))) for w in range(8)], np.uint64)
    base = rng.integers(0, 1 << 63, 8, dtype=np.uint64)
    fps = [flip(base, 0, 90), base, *rng.integers(0, 1 << 63, (4998, 8), dtype=np.uint64), flip(base, 200, 290)]  # the last is near the second only
    batches = [pa.RecordBatch.from_arrays([pa.array([7] * len(x)), pa.array(range(a, a + len(x))), pa.array([f.tobytes() for f in x], pa.binary())], ["key", "same", "fp"]) for a in range(0, len(fps), 1000) for x in [fps[a : a + 1000]]]
    edges = {e for b in simhash._wide_link_partition(batches) for e in zip(*(c.to_pylist() for c in b.columns))}
    assert edges == {(1, 0), (5000, 0)}


@pytest.mark.parametrize("block", [1024, 2])
def test_keep_one_is_exact_around_0_8(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK_ROWS", block)
    rng, rows = random.Random(6), []
    for k in range(30):
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        rows.append((10 * k, " ".join(words)))
        for c, changes in enumerate((4, 6, 8, 9, 11, 12, 14) if k else range(1, 15)):
            other = list(words)
            for p in rng.sample(range(300), changes):
                other[p] = f"x{rng.randrange(50)}"
            rows.append((10 * k + 1 + c if k else 1000 + c, " ".join(other)))
    root = {i: i for i, _ in rows}
    for i, a in rows:
        for j, b in rows:
            if i < j and root[i] != root[j] and _jaccard(a, b) >= 0.8:
                low_, high = sorted((root[i], root[j]))
                root = {x: low_ if r == high else r for x, r in root.items()}
    assert 30 < len(set(root.values())) < len(rows) - 30
    assert {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == set(root.values())


@pytest.mark.parametrize("most_apart", [0, 3, 100])
def test_hot_keys_lose_no_link_and_do_not_meet_in_full(spark, monkeypatch, most_apart):
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 4)
    rng, met = random.Random(most_apart), []
    value = {i: i // 2 if i < 160 else 1000 + 9 * i for i in range(200)}  # pairs or a chain, and rows near nothing
    key = {i: [1] + [2] * (i % 3 == 0) + [10 + i // 2] for i in value}
    rows = spark.createDataFrame([(k, i * 7919 - 10**6, value[i], 0) for i in value for k in key[i]], "key long, same long, v long, size int").cache()

    def link(dealt):
        met.append(dealt.count())
        x, y = dealt.select("group", F.col("same").alias("a"), F.col("v").alias("va")), dealt.select("group", F.col("same").alias("b"), F.col("v").alias("vb"))
        return x.join(y, "group").where(f"a < b and abs(va - vb) <= {most_apart}").select("a", "b")

    got = {r.node: r.root for r in simhash._linked(rows, link).collect()}
    root = {i: i for i in value}
    for i in value:
        for j in value:
            if i < j and set(key[i]) & set(key[j]) and abs(value[i] - value[j]) <= most_apart and root[i] != root[j]:
                root = {x: min(root[i], root[j]) if r in (root[i], root[j]) else r for x, r in root.items()}
    assert {i: (got.get(i * 7919 - 10**6, i * 7919 - 10**6) + 10**6) // 7919 for i in value} == root
    assert len(met) == 2 and sum(met) < (12_000 if most_apart < 100 else 6_000)  # every two blocks would be 10,900 rows


def test_hosts_without_labels_inherit_from_domain_suffix_and_all(spark):
    rows = [(f"http://h{i % 9}.bad.com/", 1) for i in range(90)] + [(f"http://h{i % 9}.good.com/", 0) for i in range(90)] + [(f"http://h{i}.d{i % 10}.info/", 1) for i in range(200)] + [(f"http://h{i}.d{i % 10}.fr/", 0) for i in range(200)]
    new = ["http://new.bad.com/x", "http://new.good.com/x", "http://new.unseen.info/", "http://new.unseen.fr/", "http://new.unseen.zz/"]
    pages = spark.createDataFrame([*((i, u) for i, (u, _) in enumerate(rows)), *((1000 + i, u) for i, u in enumerate(new))], "page_id long, url string")
    outcomes = spark.createDataFrame([(i, b) for i, (_, b) in enumerate(rows)], "k long, bad int")
    got = {r.page_id: r for r in url_filter.judge(pages, outcomes, rules=[]).collect()}
    assert len(got) == len(rows) + len(new) and all(r.reputation is not None for r in got.values())
    assert [got[1000 + i].verdict for i in range(5)] == ["block", "allow", "block", "allow", "allow"]
    outcomes = spark.createDataFrame([(i, 1) for i in range(len(rows))], "k long, bad int")
    assert {r.verdict for r in url_filter.judge(pages, outcomes, rules=[]).collect()} == {"block"}


def test_license_finds_every_notice_of_a_text(spark):
    notice = {label: text for label, text, _ in reversed(license_scan.TEMPLATES)}
    bsd, mit = notice["bsd"], license_scan.TEMPLATES[1][1]
    pairs = [(bsd, "cc-by-nc"), (bsd, "cc-by"), (mit, "cc-by-nc")]
    notice["cc-by"] = "Licensed under CC BY 4.0"
    texts = [f"{long}. {notice[label]}." for long, label in pairs] + ["licensed cc by nc 4 0"] * 20
    rows = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    labels = {r.doc_id: r["labels"] for r in rows}
    assert [labels[i] for i in range(3)] == ["bsd,cc-by-nc", "bsd,cc-by", "cc-by-nc,mit"]
    assert all(0 <= r.score <= 1 for r in rows)


def test_suffix_dedup_on_dense_repeats(spark):
    """Two letters only, so that strings tie for long and share their parts in every way; odd bytes among them."""
    rng = random.Random(1)
    base = ["".join(rng.choice("ab") for _ in range(300)) for _ in range(4)]
    rows = []
    for i in range(80):
        t = ""
        for _ in range(rng.randrange(0, 5)):
            a = rng.randrange(0, 250)
            t += rng.choice(base)[a : a + rng.randrange(20, 200)] + (rng.choice(["x", "é", "\0", "zz"]) if rng.random() < 0.5 else "")
        rows.append((i, t))
    rows += [(200, None), (201, ""), (202, "a" * 1000), (203, "a" * 99), (204, "a" * 100)]
    seen, want = set(), {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(b[k : k + 100])
        want[i] = (sum(gone), sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1])))
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert {r.doc_id: (r.n_removed, r.n_spans) for r in got.collect()} == want and sum(n for n, _ in want.values()) > 5000


def test_offsets_of_contexts_against_plain_comparison():
    rng = np.random.default_rng(0)
    rows = rng.integers(0, 2, (300, 12), dtype=np.uint8)  # 3 bytes before, 4, 3 after, and how many of either are text
    rows[:, 3:7] = rng.integers(0, 2, (300, 1))
    rows[:, 10:] = rng.integers(0, 4, (300, 2))
    for r in rows:
        r[: 3 - r[10]] = 0
        r[7 + r[11] : 10] = 0
    want, seen = np.zeros(300, np.uint32), set()
    for i, r in enumerate(rows):
        for d in range(4):
            if r[10] >= d and r[11] >= 3 - d:
                s = (d, bytes(r[3 - d : 10 - d]))
                want[i] |= (s in seen) << d
                seen.add(s)
    assert (suffix_dedup._repeated_offsets(rows, 4, 3) == want).all()


def test_tables_are_drawn_from_their_distribution():
    """Against all ways to seat four customers one after another; and the weights of a context sum to one."""
    d, base, slope = 0.6, 0.7, 0.3
    weight = collections.Counter({(1,): base})
    for _ in range(3):
        new = collections.Counter()
        for sizes, w in weight.items():
            new[tuple(sorted((*sizes, 1)))] += w * (base + slope * len(sizes))
            for k in range(len(sizes)):
                new[tuple(sorted(sizes[:k] + (sizes[k] + 1,) + sizes[k + 1 :]))] += w * (sizes[k] - d)
        weight = new
    share = [sum(w for s, w in weight.items() if len(s) == t) / sum(weight.values()) for t in range(1, 5)]
    n = 200_000
    got = lm_scoring.draw_tables(np.full(n, 4), np.full(n, base), np.full(n, slope), d, np.random.default_rng(3))
    assert np.abs(np.bincount(got.astype(int), minlength=5)[1:] / n - share).max() < 0.005
    many = lm_scoring.draw_tables(np.array([5000, 70, 1]), np.full(3, 2.0), np.full(3, 0.1), 0.5, np.random.default_rng(1))
    assert (many >= 1).all() and many[0] > many[1] > 0 and many[2] == 1


def test_a_bucket_adds_up_its_pairs_in_parts():
    rng = np.random.default_rng(3)

    def block(words, contexts, docs=50):
        word = np.unique(rng.choice(words, len(words) // 2))
        pairs = rng.integers(1, 40, len(word)).astype(np.uint32)
        ctx = np.concatenate([rng.choice(contexts, k, replace=False) for k in pairs])
        entries = rng.integers(1, 3, len(ctx)).astype(np.uint8)
        doc = np.concatenate([rng.choice(docs, k, replace=False) for k in entries]).astype(np.uint16)
        held = rng.random(docs) < 0.3
        return {"word": word, "pairs": pairs, "ctx": lm_scoring._packed(ctx, 4), "entries": entries, "doc": doc, "times": rng.integers(1, 5, len(doc)).astype(np.uint8), "held": np.packbits(held), "docs": np.array([docs], np.int64)}

    words, contexts = rng.integers(1, 1 << 63, 500, dtype=np.uint64), rng.choice(1 << 32, 400, replace=False).astype(np.uint64)
    blocks = [block(words, contexts) for _ in range(5)]
    want = collections.Counter()
    for b in blocks:
        held, entry = np.unpackbits(b["held"]), iter(zip(b["doc"].tolist(), b["times"].tolist()))
        pairs = zip(np.repeat(b["word"], b["pairs"]).tolist(), lm_scoring._unpacked(b["ctx"], 4).tolist(), b["entries"].tolist())
        for w, c, k in pairs:
            want[w, c] += sum(t for d, t in (next(entry) for _ in range(k)) if not held[d])
    x = lm_scoring.Bucket(blocks, 4)
    assert set(x.words.tolist()) == {w for w, _ in want} and set(x.contexts.tolist()) == {c for _, c in want}
    assert dict(zip(zip(x.words[x.word].tolist(), x.contexts[x.ctx].tolist()), x.count.tolist())) == {k: v for k, v in want.items() if v}
    many = 400 * blocks  # 4 million pairs and more, of which few are distinct
    y, mb = held_at_most(lambda: lm_scoring.Bucket(many, 4))
    assert sum(int(b["pairs"].sum()) for b in many) > 4e6
    assert (y.key == x.key).all() and (y.count == 400 * x.count).all()
    assert mb < 60
    assert not len(lm_scoring.Bucket([], 4).key)


def test_a_bucket_is_read_packed_and_by_one_worker_a_task(docs):
    rng = np.random.default_rng(5)

    def block(words=20_000, docs=60):
        doc = np.sort(rng.integers(0, docs, words)).astype(np.uint16)
        return {"word": np.arange(1, words + 1, dtype=np.uint64), "pairs": np.ones(words, np.uint32), "ctx": lm_scoring._packed(np.arange(words, dtype=np.uint64), 4), "entries": np.ones(words, np.uint8), "doc": doc, "times": np.ones(words, np.uint8), "held": np.packbits(np.zeros(docs, bool)), "docs": np.array([docs], np.int64)}

    table = pa.Table.from_batches([lm_scoring._batch([(7, 100 - i, 0, arrays.pack(**block())) for i in range(100)] + [(7, 3, 1, b"head")])])
    (bucket, heads, blocks, x), mb = held_at_most(lambda: lm_scoring._bucket_of(table, 4))
    assert (bucket, len(heads), len(x.key), int(x.count.sum())) == (7, 1, 20_000, 2_000_000)
    assert [len(b["word"]) for b in blocks] == [20_000] * 100 and blocks.chunks == sorted(blocks.chunks) and not lm_scoring.Blocks(table.slice(100))
    assert mb < 35  # the blocks alone are 40 unpacked
    plan = lm_scoring.score(docs.select("doc_id", "text"), F.lit(False))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapCoGroupsInArrow") == plan.count("FlatMapGroupsInArrow") == 1 and "MapInArrow" not in plan.replace("FlatMap", "")
    assert plan.count("Sort [") == 2  # what buckets send, and the shares of a slab: the blocks are in order


def test_scores_against_a_sequential_sampler(spark):
    """A plain Gibbs sampler, customer by customer with every table's size, on a small corpus."""
    rng = random.Random(11)
    chain = {w: [rng.choice("abcdefgh") for _ in range(3)] for w in "abcdefgh"}
    rows = []
    for i in range(60):
        w = [rng.choice("abcdefgh")]
        while len(w) < 12:
            w.append(rng.choice(chain[w[-1]]))
        rows.append((i, " ".join(w)))
    held = F.col("doc_id") >= 50
    got = {r.doc_id: r.score for r in lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string"), held, burn_in=15, samples=15).collect()}
    pairs = lambda t: list(zip(["<", *t.split()], [*t.split(), ">"]))
    train = [p for i, t in rows if i < 50 for p in pairs(t)]
    count = collections.Counter(train)
    one, two = sum(c == 1 for c in count.values()), sum(c == 2 for c in count.values())
    kinds = collections.Counter(w for _, w in count if w != ">")
    m1, m2 = sum(c == 1 for c in kinds.values()), sum(c == 2 for c in kinds.values())
    d1 = min(0.95, max(0.05, one / (one + 2 * two)))
    d0 = min(0.95, max(0.05, m1 / (m1 + 2 * m2))) if m1 + m2 else 0.5
    s1, s0 = lm_scoring.STRENGTH
    v = len({w for _, w in train})
    low, top = collections.defaultdict(lambda: collections.defaultdict(list)), collections.defaultdict(list)  # sizes of tables by context and word, and by word

    def p_top(w):
        c, t = sum(map(sum, top.values())), sum(map(len, top.values()))
        return (sum(top[w]) - d0 * len(top[w])) / (s0 + c) + (s0 + d0 * t) / (s0 + c) / (v + 1)

    def p_low(u, w):
        c, t = sum(sum(x) for x in low[u].values()), sum(len(x) for x in low[u].values())
        return (sum(low[u][w]) - d1 * len(low[u][w])) / (s1 + c) + (s1 + d1 * t) / (s1 + c) * p_top(w)

    def seat(tables, discount, new):
        weights = [x - discount for x in tables] + [new]
        k = rng.choices(range(len(weights)), weights)[0]
        if k == len(tables):
            tables.append(1)
            return True
        tables[k] += 1
        return False

    def leave(tables):
        k = rng.choices(range(len(tables)), tables)[0]
        tables[k] -= 1
        if not tables[k]:
            tables.pop(k)
            return True
        return False

    def enter(u, w):
        t = sum(len(x) for x in low[u].values())
        if seat(low[u][w], d1, (s1 + d1 * t) * p_top(w)):
            seat(top[w], d0, (s0 + d0 * sum(map(len, top.values()))) / (v + 1))

    for p in train:
        enter(*p)
    mean, n = collections.Counter(), 0
    asked = {p for _, t in rows for p in pairs(t)}
    for sweep in range(40):
        for u, w in train:
            if leave(low[u][w]):
                leave(top[w])
            enter(u, w)
        if sweep >= 10:
            n += 1
            for p in asked:
                mean[p] += p_low(*p)
    for i, t in rows:
        want = sum(np.log10(mean[p] / n) for p in pairs(t))
        assert abs(got[i] - want) < 0.02 * abs(want), (i, got[i], want)


def test_pages_without_declared_furniture():
    """Labelled blocks: what counts is what a block says, how long it is and how much of it is links; names are only a hint."""
    long = "The house on the hill was built by the family that had lived in the valley for more than a hundred years, and it is one of the few that are still there. "
    links = "".join(f"<li><a href=/{i}>Section {i}</a></li>" for i in range(8))
    page = f"<body><div><ul>{links}</ul></div><div>Get 20 % off</div><h2>The house</h2><p>{long * 2}</p><p>Quite so.</p><p>{long}</p><div><p><a href=/a>More stories about houses in this region and others</a> <a href=/b>All of them here</a></p></div></body>"
    want = ["The house", (long * 2).strip(), "Quite so.", long.strip()]
    assert html_extract.main_text(page) == "\n".join(want)
    inside = f"<body><nav><a href=/>Home</a></nav><article><h1>On houses</h1><div class='side-effects'>Rare ones.</div><p>{long}</p><div class='product-widget'>A lamp of brass.</div><p><label>Built:</label> 1810</p><ul>{links}</ul><p>{long}</p><div class='cookie-notice'>{long}</div></article><footer>{long}</footer></body>"
    assert html_extract.main_text(inside) == "\n".join(["On houses", "Rare ones.", long.strip(), "A lamp of brass.", "Built: 1810", long.strip()])
    teaser = f"<body><article><a href=/1>One more story</a></article><div><p>{long * 2}</p></div></body>"
    assert long.strip() in html_extract.main_text(teaser)  # a long text outside of an article stays


def test_pages_through_the_operator(spark, monkeypatch):
    long = "The text of the page is here and it is long enough to be one of those that are kept by the rules, as it was in the days of old. "
    pages = [(1, "http://a/", f"<p>{long * 2}</p><ul><li><a href=x>Menu</a></li></ul>", "t"), (2, None, None, "t"), (3, "u", "", "t"), (1, "http://a/", f"<p>{long * 2}</p><ul><li><a href=x>Menu</a></li></ul>", "t"), (4, "u", "<article>" + f"<p>{long}" * 4000, "t")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text string")
    rows = html_extract.extract(df).collect()
    got = collections.defaultdict(list)
    for r in rows:
        got[r.page_id].append(r.text)
    assert got[1] == [(long * 2).strip()] * 2 and got[2] == got[3] == [""] and got[4] == ["\n".join([long.strip()] * 4000)]
    assert html_extract.extract(df.limit(0)).count() == 0 and rows[0].url is not None
    monkeypatch.setattr(html_extract, "by_text", lambda b: "good")  # without the text rules the menu would stay
    assert "Menu" in html_extract.main_text(pages[0][2])


def test_components_of_a_chain_and_a_hub(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HUB_EDGES", 20)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001 + i) for i in range(300)] + [(5000, 1100), (7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    root = {r.node: r.root for r in simhash.components(df).collect()}
    assert {root[i] for i in range(1, 201)} == {0} and {root[i] for i in [*range(1001, 1301), 5000]} == {1000}
    with pytest.raises(RuntimeError):
        simhash.components(df, most_rounds=1)


def test_few_edges_are_joined_by_one_task(spark, monkeypatch):
    edges = [(i, i + 1) for i in range(200)] + [(-9, 300 + i) for i in range(50)] + [(320, -(2**62)), (7, 7), (3, 2), (900, 901)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    want = {(r.node, r.root) for r in simhash.components(df).collect()}
    cuts, cut = [], simhash.exchange.cut
    monkeypatch.setattr(simhash.exchange, "cut", lambda df, **kw: cuts.append(1) or cut(df, **kw))
    got = simhash.components(df, at_once=1000).collect()
    assert {(r.node, r.root) for r in got} == want and len(got) == len(want) and len(cuts) == 2
    assert {(r.node, r.root) for r in simhash.components(df, at_once=252).collect()} == want and len(cuts) == 4  # just as many edges
    assert {(r.node, r.root) for r in simhash.components(df, at_once=251).collect()} == want and len(cuts) > 6  # one too many
    assert simhash.components(df.limit(0), at_once=10).collect() == []


def test_posteriors_of_votes_against_a_plain_loop():
    counts = {"1112112": 40, "0001001": 9, "1121222": 13, "0202020": 5, "2222222": 3}
    prior, good, bad = 0.8, [0.85] * 7, [0.85] * 7

    def posterior(p):
        a, b = prior, 1 - prior
        for k, v in enumerate(p):
            if v != "2":
                a, b = (a * good[k], b * (1 - bad[k])) if v == "1" else (a * (1 - good[k]), b * bad[k])
        return a / (a + b)

    for _ in range(50):
        q = {p: posterior(p) for p in counts}
        prior = min(0.95, max(0.05, sum(n * q[p] for p, n in counts.items()) / 70))
        for k in range(7):
            said = lambda v, f: sum(n * f(q[p]) for p, n in counts.items() if p[k] == v)  # noqa: B023, E731
            g1, g0, b1, b0 = said("1", lambda x: x), said("0", lambda x: x), said("1", lambda x: 1 - x), said("0", lambda x: 1 - x)
            good[k] = min(0.99, max(0.5, (g1 + 8.5) / (g1 + g0 + 10)))
            bad[k] = min(0.99, max(1.02 - good[k], (b0 + 8.5) / (b0 + b1 + 10)))
    got = quality.estimate(counts, 7)
    assert all(abs(got[p] - posterior(p)) < 1e-9 for p in counts) and got["0001001"] < 0.5 < got["1112112"]


def test_clashing_names_stay_or_are_replaced(spark):
    docs = spark.createDataFrame([(i, "word " * 60 + str(i), "s", 1, 2, 3, 4, 5, 6) for i in range(6)], "doc_id long, text string, source string, size int, taken int, _hash int, _nth int, n_words int, quality int")
    assert set(simhash.keep_one(docs).columns) == set(docs.columns) and simhash.keep_one(docs).first()["_nth"] == 4
    assert mixing.repeat(docs).columns == docs.columns and mixing.repeat(docs).first().size == 1 and mixing.mix(docs).first()["_hash"] == 3
    bench = spark.createDataFrame([(1, "none of these")], "item_id long, text string")
    assert decontaminate.remove(docs, bench).columns == docs.columns and quality.keep_good(docs).columns == docs.columns
    pages = spark.createDataFrame([(1, "http://a.com/x", "mine", "d", "s")], "page_id long, url string, host string, domain string, suffix string")
    out = url_filter.judge(pages, spark.createDataFrame([(1, 0)], "k long, bad int")).first()
    assert (out.host, out["domain"], out.suffix) == ("a.com", "d", "s")


def test_pipeline_against_plain_stages(spark, tmp_path):
    """All stages over a small corpus: who goes at each, and what the last one writes."""
    import corpus_pipeline

    rng = random.Random(4)
    words = [f"{''.join(rng.choice('abcdefghijklmnoprstu') for _ in range(rng.randrange(3, 9)))}" for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, text(120), "s" + str(i % 3)) for i in range(30)]
    rows += [(100 + i, rows[i][1] + " more", "s1") for i in range(5)]  # near copies
    rows += [(200, "short one", "s0"), (201, "same again and " * 60, "s0")]  # rejected by the rules
    item = text(12)
    rows += [(300, text(60) + " " + item + " " + text(60), "s2")]  # a passage of the benchmark
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = {r.doc_id: r.text for r in docs.collect()}
    now = docs
    gone = [{200, 201}, set(range(100, 105)), set()]
    for (_, stage), out in zip(corpus_pipeline.STAGES[:3], gone):
        now = stage(spark, now, str(tmp_path))
        assert {r.doc_id for r in now.collect()} == (kept := {k: v for k, v in kept.items() if k not in out}).keys()
    after = {r.doc_id: r.text for r in now.collect()}
    assert item not in after[300] and all(after[k] == v for k, v in kept.items() if k != 300)
    spark.conf.set("stratum.shards.dir", str(tmp_path / "shards"))
    try:
        out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("stratum.shards.dir")
    enc = token_output.Encoder(open(VOCABULARY, "rb").read())
    assert sorted(r.slot for r in out) == list(range(len(out))) and {r.doc_id for r in out} <= set(kept)
    mixed = mixing.repeat(now).collect()
    assert sum(int(r.n_tokens) for r in out) == sum(len(enc.encode(r.text)) + 1 for r in mixed)
    back = token_output.read_from(spark, str(tmp_path / "shards"), 0, len(out), 65536, 512).collect()
    assert [bytes(r.record) for r in back] == [bytes(r.record) for r in sorted(out, key=lambda r: r.slot)]
