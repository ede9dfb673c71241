"""Scoring by a hierarchical Pitman-Yor language model, seated by Gibbs sampling.

Every context, the word before, has a restaurant whose tables draw their dishes from one shared parent, the
restaurant of single words, which draws from a uniform base. Words are dealt into buckets: all customers of a dish are in
one bucket, with every text's share in it; frequent words, which a sample of the texts names, are dealt by their context too. What
a restaurant needs to know about its other dishes is how many customers and tables it has in all; so buckets send each context's
numbers to the context's owner, which adds them up and sends the sums back: restaurants are as many as contexts are.

A Gibbs step takes all customers of a dish out of a restaurant and draws their number of tables anew given everybody
else, exactly (from generalised Stirling numbers) up to ``EXACT`` customers; beyond, the first ones are drawn so and the rest is seated in
groups by binomial draws, which is an approximation. All dishes are drawn at a time, given the totals of other buckets as of the last
exchange, as in distributed topic models. Discounts come from the counts of counts. Predictive probabilities are averaged over samples, each with
its own exact totals, so that those of a context sum to one. All draws are seeded by bucket, so a lost task draws the same again.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays, exchange

END = np.uint64(0x5D1E0F5EA7ED0001)  # the end of a text, counted as a word; no word's hash by all odds
BEGIN = np.uint64(0x5D1E0F5EA7ED0002)  # what stands before the first word

STRENGTH = (2.0, 5.0)  # of context restaurants, of the restaurant of words
BURN_IN, SAMPLES = 2, 2
EXACT = 64
#: Bytes of text in a slab, which a worker counts at once.
SLAB_BYTES = 3 << 20
#: Pairs of word and context that a bucket gathers before it adds them up.
MOST_PAIRS = 1 << 19
#: Weights of seatings that are held at a time.
MOST_WEIGHTS = 1 << 17
#: Share of the texts that is looked at for frequent words; it only decides where things are dealt to.
LOOK = 0.01


def context_bytes(n: int) -> int:
    """Bytes that tell contexts apart: more as the session's partitions, and so the input, grow."""
    return 4 + (n > 1024) + (n > 1 << 16)


def _context(words: np.ndarray, width: int) -> np.ndarray:
    return arrays.mix(words ^ np.uint64(0xA5A5A5A5DEADBEEF)) >> np.uint64(64 - 8 * width)


def _packed(x: np.ndarray, width: int) -> np.ndarray:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).reshape(-1)


def _unpacked(x: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(x) // width, 8), np.uint8)
    out[:, :width] = x.reshape(-1, width)
    return out.view("<u8").reshape(-1)


_BLOCK = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("chunk", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("block", T.BinaryType())])
# Kinds of rows: 0 words of a bucket, 1 head of a slab of texts, 2 a bucket's contexts for their owner, 3 sums for a bucket, 4 a bucket's own
# tables, 5 numbers for the driver, 6 frequent words for their owner, 7 sums of frequent words for the driver.


def _batch(rows) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(list(cols[0]), pa.int32()), pa.array(list(cols[1]), pa.int64()), pa.array(list(cols[2]), pa.int32()), pa.array(list(cols[3]), pa.binary())], _BLOCK.names)


def _rows(table: pa.Table) -> list[tuple]:
    return sorted(zip(*(table.column(c).to_pylist() for c in ("kind", "chunk", "bucket", "block"))), key=lambda r: r[:3])


def _count(ids_of: list[int], width: int, hot: np.ndarray):
    """Blocks of (word, context, text, count) by bucket, and a head block for each slab of texts; ``ids_of`` has the buckets' numbers."""
    buckets = len(ids_of)

    def slab(buf, offsets, held, ids, chunk):
        starts, ends, row = arrays.word_spans(buf, offsets, arrays.NON_SPACE)
        docs = len(offsets) - 1
        per_doc = np.bincount(row, minlength=docs)
        seq = np.empty(len(starts) + docs, np.uint64)
        doc = np.repeat(np.arange(docs), per_doc + 1)
        last = np.cumsum(per_doc + 1) - 1
        seq[np.arange(len(starts)) + row] = arrays.hash_spans(buf, starts, ends, arrays.FOLDED)
        seq[last] = END
        words, word = np.unique(seq, return_inverse=True)
        word = word.astype(np.uint64)
        ctx = np.empty_like(word)
        ctx[1:] = word[:-1]
        ctx[0] = len(words)
        ctx[last[:-1] + 1] = len(words)
        words = np.r_[words, BEGIN]
        del seq
        key = (word << np.uint64(40)) | (ctx << np.uint64(16)) | doc.astype(np.uint64)
        del word, ctx, doc
        key.sort()
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        times = np.diff(np.r_[first, len(key)])
        key = key[first]
        pair_at = np.flatnonzero(np.r_[True, key[1:] >> np.uint64(16) != key[:-1] >> np.uint64(16)])
        entries = np.diff(np.r_[pair_at, len(key)])
        w, c = (key[pair_at] >> np.uint64(40)).astype(np.int64), (key[pair_at] >> np.uint64(16)).astype(np.int64) & 0xFFFFFF
        mixed = arrays.mix(words)
        to = mixed[w] % np.uint64(buckets)
        frequent = np.isin(words, hot)[w]
        to[frequent] = arrays.mix(mixed[w[frequent]] ^ words[c[frequent]]) % np.uint64(buckets)
        order = np.argsort(to, kind="stable")
        present, edge = np.unique(to[order], return_index=True)
        held_bits = np.packbits(held)
        context = _context(words, width)
        for b, x, z in zip(present.tolist(), edge, np.r_[edge[1:], len(order)]):
            i = order[x:z]
            new = np.flatnonzero(np.r_[True, w[i][1:] != w[i][:-1]])
            e = arrays.ranges(pair_at[i], entries[i])
            t = times[e]
            yield ids_of[b], chunk, 0, arrays.pack(
                word=words[w[i[new]]], pairs=np.diff(np.r_[new, len(i)]).astype(np.uint32), ctx=_packed(context[c[i]], width), entries=entries[i].astype(np.uint8 if entries[i].max() < 256 else np.uint32),
                doc=(key[e] & np.uint64(0xFFFF)).astype(np.uint16), times=t.astype(np.uint8 if t.max() < 256 else np.uint32), held=held_bits, docs=np.array([docs], np.int64),
            )
        yield ids_of[chunk % buckets], chunk, 1, pickle.dumps((ids, per_doc + 1, held))

    def run(batches):
        serial = 0
        for b in batches:
            all_buf, all_off = arrays.texts(b.column(1))
            held = b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            ids = b.column(0).to_pylist()
            for a, z in arrays.row_slabs(all_off, most_bytes=SLAB_BYTES):
                chunk = (TaskContext.get().partitionId() << 32) + serial
                serial += 1
                yield _batch(slab(all_buf[all_off[a] : all_off[z]], all_off[a : z + 1] - all_off[a], held[a:z], ids[a:z], chunk))
                arrays.give_back()

    return run


def _frequent(rows: DataFrame, n: int) -> np.ndarray:
    """Words with more than half a partition's share of all words, by a sample: 2 * n at most; the end of texts is always one."""

    def run(batches):
        for b in batches:
            buf, off = arrays.texts(b.column(0))
            starts, ends, _ = arrays.word_spans(buf, off, arrays.NON_SPACE)
            words, times = np.unique(arrays.hash_spans(buf, starts, ends, arrays.FOLDED), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(times)], ["w", "n"])

    counts = rows.select("text").sample(LOOK, 7).mapInArrow(run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))
    total = counts.select("n", "w").groupBy().agg(F.sum("n").alias("total"))
    found = counts.crossJoin(F.broadcast(total)).where(F.col("n") * 2 * n > F.col("total")).select("w").collect()
    return np.unique(np.concatenate([np.array([r[0] for r in found], np.int64).view(np.uint64), np.array([END], np.uint64)]))


def _unique(x: np.ndarray) -> np.ndarray:
    """The distinct values, ascending; by sorting, which is faster here than by hashing."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def _distinct(parts) -> np.ndarray:
    """The distinct values of all parts, ascending, with about twice as much held at a time."""
    out, new, some = np.zeros(0, np.uint64), [], 0
    for x in parts:
        new.append(_unique(x))
        some += len(new[-1])
        if some > len(out) // 2 + MOST_PAIRS:
            out, new, some = _unique(np.concatenate([out, *new])), [], 0
    return _unique(np.concatenate([out, *new]))


def _places(values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """``np.searchsorted(values, x)``, with the lookups in order, so that they run through ``values`` once."""
    order = np.argsort(x)
    out = np.empty(len(x), np.int64)
    out[order] = np.searchsorted(values, x[order])
    return out


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of all parts, ascending, and the sums of their counts; ``parts`` is emptied, so that they are not held twice."""
    keys, counts = (list(x) for x in zip(*parts))
    parts.clear()
    key = np.concatenate(keys)
    keys.clear()
    order = np.argsort(key)
    key = key[order]
    count = np.concatenate(counts)
    counts.clear()
    count = count[order]
    del order
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(count, first) if len(first) else count


class Bucket:
    """A bucket's words and contexts, and its pairs of both with training counts, sorted by word and context."""

    def __init__(self, blocks, width: int):
        """``blocks``: dicts of arrays, gone through some times over."""
        self.width = width
        self.words = _distinct(x["word"] for x in blocks)
        self.contexts = _distinct(_unpacked(x["ctx"], width) for x in blocks)
        parts, pairs = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0  # the sums so far, then what is new
        for x in blocks:
            held = np.unpackbits(x["held"], count=int(x["docs"][0])).astype(bool)
            t = np.where(held[x["doc"]], 0, x["times"].astype(np.int64))
            count = np.add.reduceat(t, np.r_[0, np.cumsum(x["entries"][:-1].astype(np.int64))])
            parts.append((self.keys(x)[count > 0], count[count > 0]))
            pairs += len(parts[-1][0])
            if pairs > len(parts[0][0]) // 2 + MOST_PAIRS:
                parts, pairs = [_summed(parts)], 0
        self.key, self.count = _summed(parts)
        self.word, self.ctx = self.key // max(1, len(self.contexts)), self.key % max(1, len(self.contexts))

    def keys(self, block: dict[str, np.ndarray]) -> np.ndarray:
        """A block's pairs as ``key`` has them."""
        word = np.repeat(np.searchsorted(self.words, block["word"]), block["pairs"])
        return word.astype(np.int64) * len(self.contexts) + _places(self.contexts, _unpacked(block["ctx"], self.width))

    def by_word(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.word, values, len(self.words))

    def by_context(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.ctx, values, len(self.contexts))


_stirling: dict[float, np.ndarray] = {}


def log_stirling(discount: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers S(c, t) up to ``EXACT``: the weight of t tables among c customers."""
    if discount not in _stirling:
        out = np.full((EXACT + 1, EXACT + 1), -np.inf)
        out[1, 1] = 0.0
        for c in range(1, EXACT):
            t = np.arange(1, c + 2)
            with np.errstate(divide="ignore"):
                out[c + 1, t] = np.logaddexp(out[c, t - 1], np.log(np.maximum(c - discount * t, 0)) + out[c, t])
        _stirling[discount] = out
    return _stirling[discount]


def draw_tables(count: np.ndarray, base: np.ndarray, slope: np.ndarray, discount: float, rng) -> np.ndarray:
    """Numbers of tables of each row's customers; its k-th table (from 0) has weight base + slope * k."""
    out, table = np.ones(len(count)), log_stirling(discount)
    capped = np.minimum(count, EXACT).astype(np.int64)
    order = np.argsort(capped, kind="stable")
    sizes, edge = np.unique(capped[order], return_index=True)
    for c, a, z in zip(sizes.tolist(), edge, np.r_[edge[1:], len(order)]):
        if c < 2:
            continue
        step = max(1, MOST_WEIGHTS // c)
        for x in range(a, z, step):
            i = order[x : min(z, x + step)]
            weights = np.cumsum(np.log(base[i, None] + slope[i, None] * np.arange(c)), axis=1) + table[c, 1 : c + 1]
            out[i] = 1 + (weights - np.log(-np.log(rng.random(weights.shape)))).argmax(axis=1)
    i = EXACT
    live = np.flatnonzero(count > i)
    while len(live):
        group = np.minimum(max(1, i // 16), count[live] - i).astype(np.int64)
        opened, old = base[live] + slope[live] * out[live], i - discount * out[live]
        out[live] += rng.binomial(group, np.clip(opened / (opened + old), 0, 1))
        i += max(1, i // 16)
        live = live[count[live] > i]
    return out


class Shared:
    """What all buckets share: discounts, totals of the restaurant of words for each sample, and the frequent words' numbers in it."""

    def __init__(self, tokens: int, types: int, discounts: tuple[float, float], hot: np.ndarray, hot_count: np.ndarray):
        self.tokens, self.types, self.discounts, self.hot, self.hot_count = tokens, types, discounts, hot, hot_count
        self.customers, self.tables, self.hot_guests, self.hot_tables = [], [], [], []

    def add(self, customers: float, tables: float, guests: np.ndarray, hot_tables: np.ndarray) -> None:
        self.customers.append(customers)
        self.tables.append(tables + float(hot_tables.sum()))
        self.hot_guests.append(guests)
        self.hot_tables.append(hot_tables)

    def draw_hot(self, guests: np.ndarray, tables: float, seed: int) -> np.ndarray:
        """Tables of the frequent words, whose customers come from all buckets."""
        base = np.full(len(guests), (STRENGTH[1] + self.discounts[1] * tables) / (self.types + 1))
        t = draw_tables(np.maximum(guests, 1).astype(np.int64), base, np.full(len(guests), self.discounts[1] / (self.types + 1)), self.discounts[1], np.random.default_rng(seed))
        return np.where(guests > 0, t, 0.0)

    def new_word(self, k: int) -> float:
        """Probability of a word that no table of the restaurant of words has."""
        d, s = self.discounts[1], STRENGTH[1]
        return (s + d * self.tables[k]) / (s + self.customers[k]) / (self.types + 1)

    def words(self, x: Bucket, k: int, guests: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Probability of each word of a bucket in the restaurant of words."""
        guests, tables = guests.copy(), tables.copy()
        at, of = _positions(x.words, self.hot)
        guests[at], tables[at] = self.hot_guests[k][of], self.hot_tables[k][of]
        return np.maximum(guests - self.discounts[1] * tables, 0) / (STRENGTH[1] + self.customers[k]) + self.new_word(k)


def _positions(words: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in ``words`` frequent ones stand, and which they are; both ascend."""
    _, at, of = np.intersect1d(words, hot, assume_unique=True, return_indices=True)
    return at, of


def _start(x: Bucket) -> tuple[np.ndarray, np.ndarray]:
    tables = np.maximum(1.0, np.floor(x.count.astype(float) ** 0.7))
    guests = x.by_word(tables)
    return tables, np.where(guests > 0, np.maximum(1.0, np.floor(guests**0.7)), 0.0)


def _sweep(x: Bucket, shared: Shared, k: int, total: np.ndarray, own: np.ndarray, tables: np.ndarray, word_tables: np.ndarray, rng) -> tuple[np.ndarray, np.ndarray]:
    """All tables drawn anew. ``total``: tables of the contexts as of the last exchange, ``own`` of them from this bucket at that time."""
    (d1, d0), (s1, s0) = shared.discounts, STRENGTH
    many = np.flatnonzero(x.count > 1)
    p = shared.words(x, k, x.by_word(tables), word_tables)[x.word[many]]
    others = np.maximum(0.0, (total - own + x.by_context(tables))[x.ctx[many]] - tables[many])
    tables = tables.copy()
    tables[many] = draw_tables(x.count[many], (s1 + d1 * others) * p, d1 * p, d1, rng)
    guests = x.by_word(tables)
    word_tables = np.zeros(len(x.words))
    some = np.flatnonzero(guests > 0)
    word_tables[some] = draw_tables(guests[some].astype(np.int64), np.full(len(some), (s0 + d0 * shared.tables[k]) / (shared.types + 1)), np.full(len(some), d0 / (shared.types + 1)), d0, rng)
    return tables, word_tables


def _sent(x: Bucket, bucket: int, n: int, width: int, values: dict[str, np.ndarray], state: list[tuple[np.ndarray, np.ndarray]], numbers: list[float], hot: np.ndarray, hot_values: dict[str, np.ndarray]):
    """A bucket's rows of an exchange: its contexts' values to their owners, its tables to itself, its numbers to the driver."""
    owner = arrays.mix(x.contexts) % np.uint64(n)
    order = np.argsort(owner, kind="stable")
    present, edge = np.unique(owner[order], return_index=True)
    for o, a, z in zip(present.tolist(), edge, np.r_[edge[1:], len(order)]):
        i = order[a:z]
        yield int(o), bucket, 2, arrays.pack(ctx=_packed(x.contexts[i], width), **{c: v[i].astype(np.uint32) for c, v in values.items()})
    yield bucket, bucket, 4, arrays.pack(**{f"t{k}": t.astype(np.uint32) for k, (t, _) in enumerate(state)}, **{f"w{k}": w.astype(np.uint32) for k, (_, w) in enumerate(state)})
    yield bucket, bucket, 5, arrays.pack(numbers=np.array(numbers, float))
    at, of = _positions(x.words, hot)
    for o in np.unique(of % n).tolist() if len(of) else ():
        mine = of % n == o
        yield int(o), bucket, 6, arrays.pack(of=of[mine], **{c: v[at[mine]] for c, v in hot_values.items()})


def _owners(width: int):
    """Adds up what buckets sent for each context, and sends the sums back in the order sent; the rest passes, or is added up for the driver."""

    def run(batches):
        mine, frequent = [], []
        for b in batches:
            rows = list(zip(*(b.column(i).to_pylist() for i in range(4))))
            mine += [(owner, sender, block) for owner, sender, kind, block in rows if kind == 2]
            frequent += [(sender, block) for _, sender, kind, block in rows if kind == 6]
            yield _batch([r for r in rows if r[2] in (4, 5)])
        for o in sorted({x[0] for x in mine}):
            parts = [(sender, arrays.unpack(block)) for owner, sender, block in sorted(mine, key=lambda x: x[:2]) if owner == o]
            _, inverse = np.unique(np.concatenate([_unpacked(p["ctx"], width) for _, p in parts]), return_inverse=True)
            names = [c for c in parts[0][1] if c != "ctx"]
            sums = {c: np.bincount(inverse, np.concatenate([p[c] for _, p in parts]))[inverse].astype(np.uint64) for c in names}
            edge = np.cumsum([0, *(len(p["ctx"]) // width for _, p in parts)])
            for (sender, _), a, z in zip(parts, edge[:-1], edge[1:]):
                yield _batch([(sender, o, 3, arrays.pack(**{c: v[a:z].astype(np.uint32 if not a < z or v[a:z].max() < 1 << 32 else np.uint64) for c, v in sums.items()}))])
        if frequent:
            parts = [arrays.unpack(block) for _, block in sorted(frequent, key=lambda x: x[0])]
            of, inverse = np.unique(np.concatenate([p["of"] for p in parts]), return_inverse=True)
            yield _batch([(0, 0, 7, arrays.pack(of=of, **{c: np.bincount(inverse, np.concatenate([p[c] for p in parts])) for c in parts[0] if c != "of"}))])

    return run


def _returned(x: Bucket, rows: list[tuple], n: int, name: str) -> np.ndarray:
    """A context's sums, put back into the bucket's order."""
    owner = arrays.mix(x.contexts) % np.uint64(n)
    out = np.zeros(len(x.contexts))
    out[np.argsort(owner, kind="stable")] = np.concatenate([np.zeros(0), *(arrays.unpack(b)[name] for kind, _, _, b in rows if kind == 3)])
    return out


class Blocks:
    """A table's blocks of words in the order of their chunks. They stay compressed; whoever goes through them has one unpacked at a time."""

    def __init__(self, table: pa.Table):
        chunks = table.column("chunk").to_pylist()
        self.order = sorted((i for i, k in enumerate(table.column("kind").to_pylist()) if k == 0), key=lambda i: chunks[i])
        self.chunks, self.column = [chunks[i] for i in self.order], table.column("block")

    def __len__(self) -> int:
        return len(self.order)

    def __iter__(self):
        return (arrays.unpack(self.column[i].as_py()) for i in self.order)


def _bucket_of(table: pa.Table, width: int) -> tuple[int, list, Blocks, Bucket]:
    heads = _rows(table.filter(pa.array([k == 1 for k in table.column("kind").to_pylist()], pa.bool_())))
    blocks = Blocks(table)
    return (table.column("bucket")[0].as_py() if len(table) else 0), heads, blocks, Bucket(blocks, width)


def _table(rows) -> pa.Table:
    out = pa.Table.from_batches([_batch(list(rows))])
    arrays.give_back()
    return out


def _first_exchange(n: int, width: int, hot: np.ndarray):
    def run(table: pa.Table) -> pa.Table:
        bucket, _, blocks, x = _bucket_of(table, width)
        if not blocks:  # it only holds heads of slabs
            return _table([])
        tables, word_tables = _start(x)
        guests, total, kinds = x.by_word(tables), x.by_word(x.count), x.by_word(np.ones(len(x.key)))
        plain = ~np.isin(x.words, hot)
        numbers = [x.count.sum(), (plain & (total > 0)).sum(), guests.sum(), word_tables[plain].sum(), (x.count == 1).sum(), (x.count == 2).sum(), (plain & (kinds == 1)).sum(), (plain & (kinds == 2)).sum()]
        return _table(_sent(x, bucket, n, width, {"c": x.by_context(x.count), "t0": x.by_context(tables)}, [(tables, word_tables)], numbers, hot, {"count": total, "g0": guests}))

    return run


def _sample_exchange(n: int, width: int, shared: Shared, k: int, sweeps: int, kept: int):
    """Draws on from the tables of the last exchange, and sends what the last ``kept`` sweeps have."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        bucket, _, blocks, x = _bucket_of(left, width)
        if not blocks:
            return _table([])
        back = _rows(right)
        total = _returned(x, back, n, f"t{_last(back)}")
        own = next(arrays.unpack(b) for kind, _, _, b in back if kind == 4)
        tables, word_tables = own[f"t{_last(back)}"].astype(float), own[f"w{_last(back)}"].astype(float)
        before, rng, state = x.by_context(tables), np.random.default_rng([bucket, k]), []
        for _ in range(sweeps):
            tables, word_tables = _sweep(x, shared, -1, total, before, tables, word_tables, rng)
            state = [*state, (tables, word_tables)][-kept:]
        plain = ~np.isin(x.words, shared.hot)
        numbers = [v for t, w in state for v in (t.sum(), w[plain].sum())]
        return _table(_sent(x, bucket, n, width, {f"t{i}": x.by_context(t) for i, (t, _) in enumerate(state)}, state, numbers, shared.hot, {f"g{i}": x.by_word(t) for i, (t, _) in enumerate(state)}))

    return run


def _last(rows: list[tuple]) -> int:
    return sum(c.startswith("w") for c in next(arrays.unpack(b) for kind, _, _, b in rows if kind == 4)) - 1


def _scores(n: int, width: int, shared: Shared, samples: int):
    """The shares of score, base score and known words that a bucket has of its texts, by slab; ``shared`` has the samples last."""
    (d1, d0), (s1, s0) = shared.discounts, STRENGTH

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        bucket, heads, blocks, x = _bucket_of(left, width)
        back = _rows(right)
        out = [(b, chunk, kind, block) for kind, chunk, b, block in heads]
        if not blocks:
            return _table(out)
        customers = _returned(x, [r for r in back if r[0] == 3 and "c" in arrays.unpack(r[3])], n, "c")
        sums = [r for r in back if r[0] == 3 and "c" not in arrays.unpack(r[3])]
        own = next(arrays.unpack(b) for kind, _, _, b in back if kind == 4)
        seen, p_words, news = 0.0, [], []
        for i in range(samples):
            t, w = own[f"t{i}"].astype(float), own[f"w{i}"].astype(float)
            p_words.append(shared.words(x, i - samples, x.by_word(t), w))
            news.append((s1 + d1 * _returned(x, sums, n, f"t{i}")) / (s1 + customers))
            seen = seen + (x.count - d1 * t) / (s1 + customers[x.ctx]) / samples
        total = x.by_word(x.count)
        at, of = _positions(x.words, shared.hot)
        total[at] = shared.hot_count[of]
        log_count = np.log10(total + 1.0)
        for chunk, b in zip(blocks.chunks, blocks):
            key = x.keys(b)
            word, ctx = key // len(x.contexts), key % len(x.contexts)
            place = np.minimum(_places(x.key, key), max(0, len(x.key) - 1))
            p = np.where(x.key[place] == key, seen[place], 0.0) if len(x.key) else np.zeros(len(key))
            for new, pw in zip(news, p_words):
                p = p + new[ctx] * pw[word] / samples
            times = b["times"].astype(np.int64)
            entry = np.repeat(np.arange(len(key)), b["entries"])
            (doc, text), w = np.unique(b["doc"], return_inverse=True), word[entry]
            known = np.bincount(text, (total[w] > 0) * times).astype(np.uint32)
            out.append((bucket, chunk, 0, arrays.pack(doc=doc, score=np.bincount(text, np.log10(p)[entry] * times), base=np.bincount(text, log_count[w] * times), known=known)))
        return _table(out)

    return run


def _texts(n_train: int, n_types: int):
    """Adds up the buckets' shares of one slab of texts."""

    def run(table: pa.Table) -> pa.Table:
        rows = _rows(table)
        ids, tokens, held = next(pickle.loads(b) for k, _, _, b in rows if k == 1)
        score, base, known = np.zeros(len(ids)), np.zeros(len(ids)), np.zeros(len(ids), np.int64)
        for k, _, _, b in rows:
            if not k:
                x = arrays.unpack(b)
                score[x["doc"]] += x["score"]
                base[x["doc"]] += x["base"]
                known[x["doc"]] += x["known"]
        base -= tokens * np.log10(float(n_train + n_types + 1))
        return pa.table({"id": pa.array(ids, pa.string()), "held_out": held, "n_tokens": tokens.astype(np.int64), "n_known": known, "train_tokens": np.full(len(ids), n_train, np.int64), "base_score": base, "score": score})

    return run


def _numbers(stage: DataFrame, hot: np.ndarray, names: list[str]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The sums of the buckets' numbers, and the frequent words' sums: some rows a bucket, and 2 * partitions words at most."""
    numbers, frequent = 0.0, {c: np.zeros(len(hot)) for c in names}
    for r in stage.where("kind in (5, 7)").select("kind", "block").collect():
        x = arrays.unpack(bytes(r["block"]))
        if r["kind"] == 5:
            numbers = numbers + x["numbers"]
        else:
            for c in names:
                frequent[c][x["of"]] += x[c]
    return numbers, frequent


def score(docs: DataFrame, held_out: F.Column, doc_id: str = "doc_id", text: str = "text", burn_in: int = BURN_IN, samples: int = SAMPLES) -> DataFrame:
    """Per document: (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity).

    The model learns from all documents for which ``held_out`` is not true and scores all. A null
    text is empty: its end alone is scored. With nothing to learn from, the uniform base over one
    unseen word is left. Repeated rows are scored, and learnt from, each by itself. Other columns are not looked at, and an empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    n = exchange.partitions(spark)
    width = context_bytes(n)
    kind = docs.schema[doc_id].dataType
    rows = docs.select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    hot = _frequent(rows, n)
    blocks = exchange.cut(rows.mapInArrow(_count(exchange.even_ids(spark, n), width, hot), _BLOCK).repartition(n, "bucket").sortWithinPartitions("bucket"), keep_partitioning=True)  # sorted once for all that read it
    summed = lambda sent: exchange.cut(sent.repartitionById(n, F.expr(f"bucket % {n}")).mapInArrow(_owners(width), _BLOCK))
    together = lambda back, f: blocks.groupBy("bucket").cogroup(back.where("kind in (3, 4)").groupBy("bucket")).applyInArrow(f, _BLOCK)

    first = summed(blocks.groupBy("bucket").applyInArrow(_first_exchange(n, width, hot), _BLOCK))
    v, frequent = _numbers(first, hot, ["count", "g0"])
    v = v if len(np.atleast_1d(v)) == 8 else np.zeros(8)
    rate = lambda one, two: float(np.clip(one / (one + 2 * two), 0.05, 0.95)) if one + two else 0.5
    shared = Shared(int(v[0]), int(v[1]) + int((frequent["count"] > 0).sum()), (rate(v[4], v[5]), rate(v[6], v[7])), hot, frequent["count"])
    shared.add(v[2], v[3], frequent["g0"], np.where(frequent["g0"] > 0, np.maximum(1.0, np.floor(frequent["g0"] ** 0.7)), 0.0))
    burnt = summed(together(first, _sample_exchange(n, width, shared, 1, burn_in, 1)))
    v, frequent = _numbers(burnt, hot, ["g0"])
    v = v if len(np.atleast_1d(v)) == 2 else np.zeros(2)
    shared.add(v[0], v[1], frequent["g0"], shared.draw_hot(frequent["g0"], v[1], 1))
    kept = summed(together(burnt, _sample_exchange(n, width, shared, 2, samples, samples)))
    v, frequent = _numbers(kept, hot, [f"g{k}" for k in range(samples)])
    v = v if len(np.atleast_1d(v)) == 2 * samples else np.zeros(2 * samples)
    for k in range(samples):
        shared.add(v[2 * k], v[2 * k + 1], frequent[f"g{k}"], shared.draw_hot(frequent[f"g{k}"], v[2 * k + 1], 2 + k))
    parts = together(first.where("kind = 3").unionByName(kept), _scores(n, width, shared, samples))
    out = parts.groupBy("chunk").applyInArrow(_texts(shared.tokens, shared.types), "id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.select(F.col("id").cast(kind).alias(doc_id), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
