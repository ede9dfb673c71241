"""Near-duplicate documents by SimHash, compared bit-sliced.

Fingerprints stand vertically: bit p of 64 fingerprints is one machine word. A query
flips the planes where its own bit is set, and a carry-save counter of two bits plus an
overflow bit adds up all 64 distances at once; a block is abandoned as soon as all its
distances are beyond the radius. Which fingerprints meet in a block comes from the
pigeonhole principle on equal bit fields, which loses no pair within the radius.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays, exchange

_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _shingle_hashes(text: str | None, shingle: int) -> list[int]:
    """XXH64 of every shingle of the lower-cased words, repeats included; the whole sequence if it has fewer words."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(joined, 42)]
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :])]


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of a text; 0 for a text without words."""
    hashes = _shingle_hashes(text, shingle)
    if not hashes:
        return 0
    n, ones = len(hashes), np.zeros(64, np.int64)
    values = np.array(hashes, np.uint64)
    for i in range(0, n, 1 << 14):
        bits = np.unpackbits(values[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fp", shingle: int = 3) -> DataFrame:
    """Append the fingerprint of ``text`` as a long; other columns pass through."""
    names = docs.columns

    def run(batches):
        for b in batches:
            values = [fingerprint(t, shingle) for t in b.column(names.index(text)).to_pylist()]
            cols = [b.column(i) for i, c in enumerate(names) if c != text]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.array(values, np.uint64).view(np.int64))], [*(c for c in names if c != text), out])

    schema = T.StructType([*(f for f in docs.schema if f.name != text), T.StructField(out, T.LongType())])
    return docs.mapInArrow(run, schema)


def _fields(blocks: int, radius: int) -> list[int]:
    """Masks of which at least one is equal for any two fingerprints within the radius."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(x) for x in combinations(masks, blocks - radius)]


def _thirds(mask: int, parts: int) -> list[int]:
    """The mask together with one part each of the bits that it leaves open."""
    free = [i for i in range(64) if not mask >> i & 1]
    edges = [len(free) * i // parts for i in range(parts + 1)]
    return [mask | sum(1 << i for i in free[a:b]) for a, b in zip(edges, edges[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bit_sliced_links(fps: np.ndarray, group: np.ndarray, radius: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j) of the same group within the radius; ``group`` ascends.

    A work item is one query against one block of up to 64 fingerprints of its group.
    """
    n = len(fps)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[first, n])
    rank = np.arange(n) - np.repeat(first, size)
    blocks_of = (size + 63) // 64
    block0 = np.repeat(np.cumsum(blocks_of) - blocks_of, size)
    block, lane = block0 + rank // 64, (rank % 64).astype(np.uint64)
    start = np.zeros(int(blocks_of.sum()), np.int64)
    start[block[lane == 0]] = np.flatnonzero(lane == 0)
    planes = np.zeros((64, len(start)), np.uint64)
    for p in range(64):
        bits = ((fps >> np.uint64(p)) & np.uint64(1)) << lane
        planes[p] = np.bitwise_or.reduceat(bits, start)
    filled = np.bitwise_or.reduceat(np.uint64(1) << lane, start)
    left, right = [], []
    todo = np.repeat(blocks_of, size) - rank // 64  # from its own block to the group's last
    for a in range(0, n, 4096):
        k = todo[a : a + 4096]
        q = np.repeat(np.arange(a, min(a + 4096, n)), k)
        b = block[q] + (np.arange(len(q)) - np.repeat(np.cumsum(k) - k, k))
        over = ~filled[b]
        own = b == block[q]  # in its own block only later lanes count
        over[own] |= (np.uint64(2) << lane[q[own]]) - np.uint64(1)
        ones, twos = np.zeros(len(q), np.uint64), np.zeros(len(q), np.uint64)
        for p in range(64):
            if p % 8 == 0:
                live = over != _ALL
                if not live.all():  # abandoned: every distance is beyond the radius
                    q, b, over, ones, twos = q[live], b[live], over[live], ones[live], twos[live]
                if not len(q):
                    break
            flip = np.where(fps[q] >> np.uint64(p) & np.uint64(1), _ALL, np.uint64(0))
            differs = planes[p, b] ^ flip
            carry = ones & differs
            ones ^= differs
            over |= twos & carry
            twos |= carry
            if radius < 3:
                over |= _beyond(ones, twos, radius)
        hits = ~over
        while len(q):
            some = hits != 0
            q, b, hits = q[some], b[some], hits[some]
            if not len(q):
                break
            low = hits & (~hits + np.uint64(1))
            left.append(q)
            right.append(start[b] + np.round(np.log2(low.astype(np.float64))).astype(np.int64))
            hits = hits ^ low
    if not left:
        z = np.zeros(0, np.int64)
        return z, z
    return np.concatenate(left), np.concatenate(right)


def _beyond(ones: np.ndarray, twos: np.ndarray, radius: int) -> np.ndarray:
    return (ones | twos) if radius == 0 else twos if radius == 1 else ones & twos


def _spanning(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """Smallest index that each index is linked to, directly or not."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, left, label[right])
        np.minimum.at(label, right, label[left])
        label = label[label]
        if (label == before).all():
            return label


def _link_partition(radius: int):
    def links(fp: np.ndarray, group: np.ndarray):
        x = fp.view(np.uint64)
        i, j = bit_sliced_links(x, group, radius)
        root = _spanning(i, j, len(x))
        some = root != np.arange(len(x))
        return pa.RecordBatch.from_arrays([pa.array(fp[some]), pa.array(fp[root[some]])], ["a", "b"])

    def run(batches):
        held: list[np.ndarray] = []  # the rows of the last key, which may go on in the next batch
        for b in batches:
            if not b.num_rows:
                continue
            rows = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()])
            rows = np.concatenate([*held, rows], axis=1)
            new = np.flatnonzero((rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1]))
            at = int(new[-1]) + 1 if len(new) else 0
            held = [rows[:, at:]]
            if at:
                done = rows[:, :at]
                yield links(done[2], np.searchsorted(new, np.arange(at), side="left"))
        if held and held[0].shape[1] > 1:
            yield links(held[0][2].copy(), np.zeros(held[0].shape[1], np.int64))

    return run


def near_pairs(fps: DataFrame, radius: int = 2, blocks: int = 4, most: int = 2048) -> DataFrame:
    """(a, b) edges that join all distinct fingerprints within the radius, directly or by way of others.

    ``fps`` has distinct longs in column fp. A key that more than ``most`` fingerprints share
    is replaced by finer keys, ``radius + 1`` for one, in which one more part of the open bits
    is equal; that keeps every pair, and after the last of the three steps a key leaves so few
    bits open that few thousand different fingerprints can share it.
    """
    spark = fps.sparkSession
    masks = _fields(blocks, radius)
    todo = fps.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    found = []
    for level in range(3):
        keyed = todo.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        counted = keyed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        some = keyed.join(counted, ["mask", "key"])
        some = exchange.cut(some) if level < 2 else some
        small = some if level == 2 else some.where(F.col("n") <= most)
        sorted_ = small.select("mask", "key", "fp").repartition(exchange.partitions(spark), "mask", "key").sortWithinPartitions("mask", "key", "fp")
        found.append(sorted_.mapInArrow(_link_partition(radius), "a long, b long"))
        if level == 2:
            break
        large = some.where(F.col("n") > most)
        finer = {m: _thirds(m, radius + 1) for m in masks}
        if large.isEmpty():
            break
        pairs = [F.struct(F.lit(_signed(m)).alias("old"), F.lit(_signed(x)).alias("new")) for m, xs in finer.items() for x in xs]
        todo = large.select("fp", "mask", F.explode(F.array(*pairs)).alias("x")).where("x.old = mask").select("fp", F.col("x.new").alias("mask"))
        masks = sorted({x for xs in finer.values() for x in xs})
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out.distinct()


#: A node with over this share of all edges, and over this many, is a hub; so there are at most twice as many as the share's inverse.
HUB_SHARE, HUB_EDGES = 1024, 256


def _beside(rows: DataFrame, least: DataFrame, edges: int) -> DataFrame:
    """``rows`` (a, ...) with the column m of ``least`` (a, m, n: rows of a). The few hubs, at most 2 * ``HUB_SHARE``, are broadcast, so their rows stay where they are."""
    limit = max(HUB_EDGES, edges // HUB_SHARE)
    hubs = least.where(F.col("n") > limit).select("a", F.col("m").alias("hub_m"))
    marked = rows.join(F.broadcast(hubs), "a", "left")
    rest = marked.where("hub_m is null").drop("hub_m").join(least.where(F.col("n") <= limit).select("a", "m"), "a")
    return marked.where("hub_m is not null").withColumnRenamed("hub_m", "m").select(*rest.columns).unionByName(rest)


#: So many distinct edges at most are joined by one task; every round would write a file for each partition, however few they are.
AT_ONCE = 1 << 17


def _root_partition(batches):
    """(node, root) of all edges (a, b) of a partition."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not held:
        return
    left, right = (np.concatenate(x) for x in zip(*held))
    node, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    root = _spanning(at[: len(left)], at[len(left) :], len(node))
    some = root != np.arange(len(node))
    yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[root[some]])], ["node", "root"])


def components(edges: DataFrame, most_rounds: int = 60, at_once: int = 0) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) but the roots; root is the smallest node of its component.

    Up to ``at_once`` distinct edges, of longs, are joined by one task; more, or all by default, in rounds
    of alternating large-star and small-star steps, each a min per node and one join; the rows of hubs are joined where they are. The number of rounds grows with the logarithm of the largest component, so
    ``most_rounds`` is out of reach; should labels not have settled by then, ``RuntimeError`` is raised.
    """
    now = exchange.cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    n, before = now.count(), None
    if n <= at_once:
        return exchange.cut(now.repartition(1).mapInArrow(_root_partition, "node long, root long"))
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = exchange.cut(_beside(both.where("b > a"), least, n).select(F.col("b").alias("a"), F.col("m").alias("b")))
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = _beside(large, least, n).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.greatest("b", "m")).alias("a"), F.col("m").alias("b"))
        now = exchange.cut(small.where("a <> b").distinct())
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long")), F.countDistinct("a")).first())
        if state == before or state[0] == state[2] and now.select("b").distinct().join(now.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        n, before = state[0], state
    raise RuntimeError(f"components have not settled in {most_rounds} rounds")


def _classes(fp: DataFrame, least: F.Column, radius: int, blocks: int) -> DataFrame:
    """(fp, component): ``least`` over all rows whose fingerprint is in the same component."""
    nodes = exchange.cut(fp.groupBy("fp").agg(least.alias("least")))
    roots = components(near_pairs(nodes.select("fp"), radius, blocks), at_once=AT_ONCE)
    named = nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return named.join(named.groupBy("root").agg(F.min("least").alias("component")), "root").select("fp", "component")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 2, shingle: int = 3, blocks: int = 4) -> DataFrame:
    """One row per document: (doc_id, fp, component), component being the smallest id reachable.

    Null and empty texts have fingerprint 0 and link like any other. A null id never
    becomes a component's name unless the component has no other id. Repeated rows stay,
    columns of other names are not looked at, and an empty table gives an empty result.
    """
    fp = exchange.cut(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), shingle=shingle))
    return fp.join(_classes(fp, F.min("doc_id"), radius, blocks), "fp", "left").select("doc_id", "fp", "component")


#: Bits of a wide fingerprint, and the largest number of them that differ in candidates, which are then
#: compared exactly. The mean distance at a similarity of 0.8 is 78 (standard deviation 8), so that the radius
#: is 6 deviations off; of the shortest texts, 4 shingles in 5, it is 95, and 1 pair in 7,000 is missed. One
#: less than a multiple of 8, so that the counters overflow exactly beyond it.
WIDE_BITS, WIDE_RADIUS = 512, 127
#: Least hashes of a text, and the keys made of three of them, no two of which share more than one: two texts
#: of similarity 0.8 share no key with probability 0.00006.
MIN_HASHES = 24
_KEY_ROWS = np.concatenate([np.arange(24).reshape(8, 3), *(np.stack([np.arange(8), 8 + (np.arange(8) + x) % 8, 16 + (np.arange(8) + y) % 8], axis=1) for x, y in ((0, 0), (3, 5)))])
MIN_KEYS = len(_KEY_ROWS)
#: Texts are near copies from this share of common shingles on.
SIMILAR = (4, 5)
#: Rows and shingles in a block of a large group.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 1 << 20
_MIX = np.random.default_rng(42).integers(1, 1 << 63, (MIN_HASHES + WIDE_BITS // 64, 2), dtype=np.uint64) | np.uint64(1)


def _mixed(h: np.ndarray, i: int) -> np.ndarray:
    x = (h ^ _MIX[i, 0]) * _MIX[i, 1]
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """Hashes of the distinct shingles of a whole text, ascending; one set for all texts without words."""
    return np.unique(np.array(_shingle_hashes(text, shingle) or [0], np.uint64))


def wide_sketch(text: str | None, shingle: int = 5) -> tuple[int, bytes, list[int], int]:
    """(hash of the set of shingles, wide fingerprint, keys, number of distinct shingles) of a whole text."""
    h = shingle_set(text, shingle)
    ones = np.zeros(WIDE_BITS, np.int64)
    for a in range(0, len(h), 1 << 12):
        part = h[a : a + (1 << 12)]
        words = np.stack([_mixed(part, MIN_HASHES + i) for i in range(WIDE_BITS // 64)], axis=1)
        ones += np.unpackbits(words.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    least = np.array([_mixed(h, i).min() for i in range(MIN_HASHES)], np.uint64)
    keys = [xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(least[_KEY_ROWS])]
    return xxhash.xxh64_intdigest(h.tobytes(), 42), np.packbits(ones * 2 > len(h), bitorder="little").tobytes(), keys, len(h)


def _save_carry(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    half = a ^ b
    return half ^ c, (a & b) | (half & c)


def wide_links(fps: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j) of the same group at ``WIDE_RADIUS`` or less; rows of ``fps`` are fingerprints, ``group`` ascends.

    Eight planes at a time go through a tree of carry-save adders into counters of ones, twos
    and fours; what comes out, an eight, is added to a counter that starts so high that its
    overflow means a distance beyond the radius. Blocks of which all lanes have overflowed are
    abandoned.
    """
    n = len(fps)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[first, n])
    rank = np.arange(n) - np.repeat(first, size)
    blocks_of = (size + 63) // 64
    block, lane = np.repeat(np.cumsum(blocks_of) - blocks_of, size) + rank // 64, (rank % 64).astype(np.uint64)
    start = np.flatnonzero(lane == 0)
    filled = np.bitwise_or.reduceat(np.uint64(1) << lane, start)
    bit = lambda p: (fps[:, p >> 6] >> np.uint64(p & 63)) & np.uint64(1)
    planes = np.stack([np.bitwise_or.reduceat(bit(p) << lane, start) for p in range(WIDE_BITS)])
    todo = np.repeat(blocks_of, size) - rank // 64  # from its own block to the group's last
    bias = 16 - (WIDE_RADIUS + 1) // 8
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a in range(0, n, 1024):
        k = todo[a : a + 1024]
        q = np.repeat(np.arange(a, min(a + 1024, n)), k)
        b = block[q] + (np.arange(len(q)) - np.repeat(np.cumsum(k) - k, k))
        over = ~filled[b]
        own = b == block[q]  # in its own block only later lanes count
        over[own] |= (np.uint64(2) << lane[q[own]]) - np.uint64(1)
        zero = np.zeros(len(q), np.uint64)
        ones, twos, fours = zero, zero, zero
        eights = [np.full(len(q), _ALL if bias >> i & 1 else np.uint64(0)) for i in range(4)]
        for p in range(0, WIDE_BITS, 8):
            live = over != _ALL
            if not live.all():
                q, b, over, ones, twos, fours = q[live], b[live], over[live], ones[live], twos[live], fours[live]
                eights = [x[live] for x in eights]
            if not len(q):
                break
            d = [planes[p + i, b] ^ (np.uint64(0) - (fps[q, p + i >> 6] >> np.uint64(p + i & 63) & np.uint64(1))) for i in range(8)]
            ones, t0 = _save_carry(ones, d[0], d[1])
            ones, t1 = _save_carry(ones, d[2], d[3])
            twos, f0 = _save_carry(twos, t0, t1)
            ones, t0 = _save_carry(ones, d[4], d[5])
            ones, t1 = _save_carry(ones, d[6], d[7])
            twos, f1 = _save_carry(twos, t0, t1)
            fours, carry = _save_carry(fours, f0, f1)
            for i in range(4):
                eights[i], carry = eights[i] ^ carry, eights[i] & carry
            over = over | carry
        hits = ~over
        while len(q):
            some = hits != 0
            q, b, hits = q[some], b[some], hits[some]
            low = hits & (~hits + np.uint64(1))
            left.append(q)
            right.append(start[b] + np.log2(low.astype(np.float64)).astype(np.int64))
            hits = hits ^ low
    return np.concatenate(left), np.concatenate(right)


def _sketch_partition(shingle: int):
    def run(batches):
        for b in batches:
            found = [wide_sketch(t, shingle) for t in b.column(2).to_pylist()]
            as_long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            keys = pa.ListArray.from_arrays(np.arange(len(found) + 1, dtype=np.int32) * MIN_KEYS, as_long([k for x in found for k in x[2]]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), as_long([x[0] for x in found]), pa.array([x[1] for x in found], pa.binary()), keys, pa.array([x[3] for x in found], pa.int64())], ["doc_id", "hash", "same", "fp", "keys", "shingles"])
            del found, keys
            arrays.give_back()

    return run


def _star(same: np.ndarray, left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
    root = _spanning(left, right, len(same))
    some = root != np.arange(len(same))
    return pa.RecordBatch.from_arrays([pa.array(same[some]), pa.array(same[root[some]])], ["a", "b"])


def _wide_link_partition(batches):
    """Star edges of rows (key, same, fp) sorted by key: what is linked, directly or not, among all rows of a key."""
    key, same, fps = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, WIDE_BITS // 64), np.uint64)

    def linked(n):
        first = np.flatnonzero(np.r_[True, key[1:n] != key[: n - 1]])
        a = 0
        while a < n:  # whole keys of some thousand rows at a time
            z = int(np.append(first, n)[np.searchsorted(first, min(a + 2 * BLOCK_ROWS, n))])
            yield _star(same[a:z], *wide_links(fps[a:z], np.cumsum(np.r_[False, key[a + 1 : z] != key[a : z - 1]])))
            a = z

    held = []  # parts of the rows from the last key's first row on
    for b in batches:
        if not b.num_rows:
            continue
        held.append((b.column(0).to_numpy(), b.column(1).to_numpy(), np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint64).reshape(-1, WIDE_BITS // 64)))
        if held[-1][0][-1] == held[0][0][0]:
            continue
        key, same, fps = (np.concatenate(x) for x in zip(*held))
        at = int(np.searchsorted(key, key[-1]))  # where the last key begins
        yield from linked(at)
        held = [(key[at:], same[at:], fps[at:])]
    if held:
        key, same, fps = (np.concatenate(x) for x in zip(*held))
        yield from linked(len(key))
    key, same, fps, held = key[:0].copy(), same[:0].copy(), fps[:0].copy(), []
    arrays.give_back()


def similar_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the index pairs those whose sets share ``SIMILAR`` or more, but none that others of them have linked before."""
    n, (share, of) = len(sets), SIMILAR
    size = np.array([len(x) for x in sets], np.int64)
    first = np.cumsum(size) - size
    distinct, ids = np.unique(np.concatenate(sets), return_inverse=True)
    marked, label = np.zeros(len(distinct), np.int64), np.arange(n)
    order = np.argsort(left, kind="stable")
    left, right = left[order], right[order]
    edge = np.searchsorted(left, np.arange(n + 1))
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for q in np.flatnonzero(np.diff(edge)):
        c = right[edge[q] : edge[q + 1]]
        c = c[(label[c] != label[q]) & (of * np.minimum(size[c], size[q]) >= share * np.maximum(size[c], size[q]))]
        if not len(c):
            continue
        own = ids[first[q] : first[q] + size[q]]
        marked[own] = 1
        both = np.array([marked[ids[first[x] : first[x] + size[x]]].sum() for x in c])
        marked[own] = 0
        c = c[of * both >= share * (size[q] + size[c] - both)]
        label[np.isin(label, label[c])] = label[q]
        out.append((np.full(len(c), q), c))
    return tuple(np.concatenate(x) for x in zip(*out))


def _similar_partition(shingle: int):
    """Star edges of rows (group, same, fp, text) sorted by group and same, by exact comparison."""

    def links(group, same, fps, sets):
        f = np.frombuffer(b"".join(fps), np.uint64).reshape(-1, WIDE_BITS // 64)
        g = np.array(group)
        near = wide_links(f, np.cumsum(np.r_[False, g[1:] != g[:-1]]))
        return _star(np.array(same), *similar_links(sets, *near))

    def run(batches):
        group, same, fps, sets = held = [], [], [], []
        for b in batches:
            for g, s, f, t in zip(*(b.column(i).to_pylist() for i in range(4))):
                if group and g == group[-1] and s == same[-1]:
                    continue  # the same row again
                if group and g != group[-1] and len(group) >= BLOCK_ROWS // 4:
                    yield links(*held)
                    group, same, fps, sets = held = [], [], [], []
                for x, v in zip(held, (g, s, f, shingle_set(t, shingle))):
                    x.append(v)
        if len(group) > 1:
            yield links(*held)
        group, same, fps, sets = held = [], [], [], []
        arrays.give_back()

    return run


#: SQL arrays of the groups (x, y) of a row in block own of the m of its key. ``_RING``: each block with the next. ``_REST``: the mr
#: blocks of the rows outside the largest joined set (rest) with all blocks; if those are half of the key, every two blocks that are not neighbours.
_PAIR = "struct(least(own, o) as x, greatest(own, o) as y)"
_RING = f"if(m = 1, array(struct(0L as x, 0L as y)), transform(array_distinct(array(pmod(own + 1, m), pmod(own - 1, m))), o -> {_PAIR}))"
_REST = f"""if(2 * r >= n, transform(filter(sequence(0L, m - 1), o -> pmod(own - o, m) not in (0, 1, m - 1)), o -> {_PAIR}), array_distinct(concat(
    transform(sequence(0L, mr - 1), q -> struct(own as x, m + q as y)),
    transform(filter(sequence(0L, m - 1), o -> rest), o -> struct(o as x, m + pmod(xxhash64(same, 1), mr) as y)))))"""


def _dealt(rows: DataFrame, groups: str) -> DataFrame:
    """``rows`` (key, same, m, ...) once for each of their ``groups``, with a column group."""
    rows = rows.withColumn("own", F.expr("pmod(xxhash64(same), m)")).withColumn("_at", F.explode(F.expr(groups)))
    return rows.withColumn("group", F.xxhash64("key", "_at.x", "_at.y")).drop("own", "_at")


def _linked(rows: DataFrame, link: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, root) of what ``link`` joins, directly or not, among the rows (key, same, size, ...) of each key; ``rows`` is read twice.

    ``link`` makes edges (a, b) of the rows of a group. Keys are dealt in blocks. First each block meets the next;
    then rows outside the largest set of their key that this has joined meet all rows of the key, block by
    block. Two rows of that set need not meet, as they are joined already, so no link is lost, and what is copied grows
    with the key times the rows left outside, not with the square of the key.
    """
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("long")
    sizes = exchange.cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), blocks.alias("m")).where("n > 1"))
    joined = components(link(_dealt(rows.join(sizes, "key"), _RING)).distinct(), at_once=AT_ONCE)
    hot = sizes.where("m > 3")  # in a ring of three all have met
    if hot.isEmpty():
        return joined
    rooted = rows.join(hot, "key").join(joined.withColumnRenamed("node", "same"), "same", "left").withColumn("root", F.coalesce("root", "same"))
    rooted = exchange.cut(rooted)
    largest = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("main"))
    rooted = rooted.join(largest, "key").withColumn("rest", F.col("root") != F.col("main")).drop("root", "main")
    left = exchange.cut(rooted.where("rest").groupBy("key").agg(F.count(F.lit(1)).alias("r"), blocks.alias("mr")))
    if left.isEmpty():
        return joined
    more = link(_dealt(rooted.join(left, "key"), _REST))
    return components(joined.toDF("a", "b").unionByName(more).distinct(), at_once=AT_ONCE)


def _near(nodes: DataFrame) -> DataFrame:
    """(node, root) of candidates: nodes whose wide fingerprints are near those of others with an equal key, directly or not."""

    def link(met: DataFrame) -> DataFrame:
        met = met.select("same", "group").join(nodes.select("same", "fp"), "same").select("group", "same", "fp")
        met = met.repartition(exchange.partitions(nodes.sparkSession), "group").sortWithinPartitions("group", "same")
        return met.mapInArrow(_wide_link_partition, "a long, b long")

    return _linked(nodes.select("same", F.lit(0).alias("size"), F.explode("keys").alias("key")), link)


def _similar(rows: DataFrame, nodes: DataFrame, joined: DataFrame, shingle: int) -> DataFrame:
    """(node, root) of near copies within ``joined``, the (node, root) of candidates."""
    joined = joined.union(joined.select("root", "root")).distinct()
    some = exchange.cut(nodes.select("same", "least", "fp", F.col("shingles").alias("size")).join(joined.toDF("same", "key"), "same"))

    def link(met: DataFrame) -> DataFrame:
        texts = rows.join(met, rows["doc_id"].eqNullSafe(F.col("least.doc_id")) & (rows["hash"] == F.col("least.hash"))).select("group", "same", "fp", "text")
        texts = texts.repartition(exchange.partitions(rows.sparkSession), "group").sortWithinPartitions("group", "same")
        return texts.mapInArrow(_similar_partition(shingle), "a long, b long")

    return _linked(some, link)


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5) -> DataFrame:
    """``docs`` with one document of each group of near copies: the one of the smallest id.

    Near copies share 0.8 or more of their five-word shingles. Candidates are found by 512-bit SimHash
    fingerprints compared bit-sliced; at their distance equal bit fields find no pairs, so texts
    meet in the blocks of equal keys of least shingle hashes. Within what candidates join, those are
    compared again by their sets of shingles, and only these links count, directly or not.
    A row with a null id stays only if its group has no other; of rows with the
    same id and text one stays. Texts without words are one group. All columns pass through, whatever their
    names; an empty table stays empty.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("hash"), F.col(text).alias("text"))
    schema = T.StructType([rows.schema["doc_id"], *T._parse_datatype_string("hash long, same long, fp binary, keys array<long>, shingles long")])
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")).alias("least")
    nodes = exchange.cut(rows.mapInArrow(_sketch_partition(shingle), schema).groupBy("same").agg(least, F.min("fp").alias("fp"), F.min("keys").alias("keys"), F.min("shingles").alias("shingles")))
    roots = _similar(rows, nodes, _near(nodes), shingle)
    named = nodes.select("same", "least").join(roots.select(F.col("node").alias("same"), "root"), "same", "left").withColumn("root", F.coalesce("root", "same"))
    stay = exchange.cut(named.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.doc_id").alias("_kept_id"), F.col("least.hash").alias("_kept_hash")))
    mine, back = exchange.set_aside(docs, {"_hash", "_nth", "_kept_id", "_kept_hash"})
    mine = mine.withColumn("_hash", F.xxhash64(F.col(text)))
    mine = mine.join(stay, mine[doc_id].eqNullSafe(stay["_kept_id"]) & (mine["_hash"] == stay["_kept_hash"]), "left_semi")
    once = Window.partitionBy(doc_id, "_hash").orderBy(F.lit(1))
    return mine.withColumn("_nth", F.row_number().over(once)).where("_nth = 1").drop("_nth", "_hash").withColumnsRenamed(back)
