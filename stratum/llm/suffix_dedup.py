"""Exact substring de-duplication by blockwise suffix sorting with a difference cover.

Two equal strings of ``length`` bytes at any two places share an offset below the cover's
period at which both places belong to the cover sample, whatever their positions are, and from there on
they agree in ``length - period + 1`` bytes. So the suffixes of the cover sample alone settle all ties. A first
exchange of short hashes rules out those that no other place can tie with. The others are dealt into
buckets by their first bytes' hash, each with the bytes before and after that a string of ``length`` may
take in, and one bucket at a time is sorted by bytes: suffixes that tie through ``length - period + 1`` bytes stand
together, and the lengths of their common continuations, to the right and, sorted again, to the left, tell
for each offset which strings are equal. No hash is taken for equality of bytes.

A bucket is of the size of ``BUCKET_BYTES`` or less on average, whatever the corpus, and copies of a context within a block
of texts are sent once.

Texts lie in compressed blocks, dealt by a hash of the text; whole copies meet there and only
the first one is looked at further.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays, exchange

#: Bytes of contexts in a bucket of suffixes, on average, which is sorted in memory.
BUCKET_BYTES = 16 << 20
#: A perfect difference set: every residue but 0 is the difference of exactly one pair.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
assert len({(a - b) % PERIOD for a in COVER for b in COVER}) == PERIOD


def _bucket(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) % np.uint64(n)).astype(np.int64)


class Shelf:
    """The texts of one block: bytes, row borders, ids, and which rows are first copies."""

    def __init__(self, blobs: list[bytes]):
        nothing = {"data": np.zeros(0, np.uint8), "size": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "null": np.zeros(0, bool)}
        parts = [nothing, *map(arrays.unpack, blobs)]
        data = np.concatenate([p["data"] for p in parts])
        size = np.concatenate([p["size"] for p in parts])
        ids = np.concatenate([p["id"] for p in parts])
        null = np.concatenate([p["null"] for p in parts])
        offsets = np.r_[0, np.cumsum(size)]
        raw = data.tobytes()
        rows = [raw[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
        order = sorted(range(len(rows)), key=lambda i: (bool(null[i]), int(ids[i]), rows[i]))  # a null id comes last
        seen: set[bytes] = set()
        self.rows, self.first = [rows[i] for i in order], []
        self.ids, self.null = ids[order], null[order]
        for r in self.rows:
            digest = hashlib.blake2b(r, digest_size=16).digest()
            self.first.append(digest not in seen)
            seen.add(digest)

    def slabs(self, least: int):
        """(row numbers, bytes, offsets) of the first copies that are long enough, in bounded pieces."""
        pick, total = [], 0
        for i, r in enumerate(self.rows):
            if self.first[i] and len(r) >= least:
                pick.append(i)
                total += len(r)
                if total >= arrays.SLAB_BYTES:
                    yield self._slab(pick)
                    pick, total = [], 0
        if pick:
            yield self._slab(pick)

    def _slab(self, pick: list[int]):
        return pick, np.frombuffer(b"".join(self.rows[i] for i in pick), np.uint8), np.r_[0, np.cumsum([len(self.rows[i]) for i in pick])]


def _starts(offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """All places at which a string of that length begins, and their row-relative positions."""
    counts = np.maximum(0, np.diff(offsets) - length + 1)
    at = arrays.ranges(offsets[:-1], counts)
    return at, at - np.repeat(offsets[:-1], counts)


def _sample(buf: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cover places, their class within the cover, and the hash of the width bytes there; by class, then place."""
    at, relative = _starts(offsets, width)
    residue = relative % PERIOD
    kind = np.full(PERIOD, -1, np.int8)
    kind[list(COVER)] = range(len(COVER))
    kinds = kind[residue]
    some = np.flatnonzero(kinds >= 0)
    at, kinds = at[some], kinds[some]
    hashes = arrays.hash_spans(buf, at, at + width)
    return at, kinds, hashes


def _deal(items: list[tuple[np.ndarray, dict[str, np.ndarray]]], n: int):
    """Split arrays by bucket: yields (bucket, arrays)."""
    for bucket, fields in items:
        order = np.argsort(bucket, kind="stable")
        edge = np.searchsorted(bucket[order], np.arange(n + 1))
        for b in np.flatnonzero(np.diff(edge)):
            yield int(b), {k: v[order[edge[b] : edge[b + 1]]] for k, v in fields.items()}


_BLOCK = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("shelf", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("slab", T.IntegerType()), T.StructField("block", T.BinaryType())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([*(pa.array(list(c), pa.int32()) for c in cols[:4]), pa.array(list(cols[4]), pa.binary())], _BLOCK.names)


def _gather(batches) -> dict[int, list[tuple[int, int, bytes]]]:
    """The blocks of a partition by bucket, in a fixed order."""
    out: dict[int, list] = {}
    for b in batches:
        for bucket, shelf, kind, slab, block in zip(*(b.column(i).to_pylist() for i in range(5))):
            out.setdefault(bucket, []).append((kind, shelf, slab, block))
    return {k: sorted(v, key=lambda x: x[:3]) for k, v in sorted(out.items())}


def _shelve(n: int, length: int, hot: int = 8):
    """Deal texts by their hash. Copies within a slab are known at once: only the first goes on,
    and if there are many, it is dealt by the slab's number too, so that no shelf gathers a hot text.
    Texts too short for a repeat go anywhere."""

    def run(batches):
        serial = TaskContext.get().partitionId() * 1_000_003
        for b in batches:
            all_buf, all_off = arrays.texts(b.column(1))
            ids = b.column(0)
            null = np.array(ids.is_null())
            id_ = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, z in arrays.row_slabs(all_off):
                serial += 1
                size = np.diff(all_off[a : z + 1])
                to = arrays.hash_spans(all_buf, all_off[a:z], all_off[a + 1 : z + 1])
                to = (to % np.uint64(n)).astype(np.int64)
                to[size < length] = (np.flatnonzero(size < length) + serial) % n
                by_text: dict[bytes, list[int]] = {}
                for i in np.flatnonzero(size >= length).tolist():
                    by_text.setdefault(all_buf[all_off[a + i] : all_off[a + i + 1]].tobytes(), []).append(i)
                stay, rows = np.ones(z - a, bool), []
                for same in by_text.values():
                    if len(same) > 1:
                        first = min(same, key=lambda i: (bool(null[a + i]), int(id_[a + i])))
                        stay[[i for i in same if i != first]] = False
                        if len(same) >= hot:
                            to[first] = (to[first] + serial) % n
                gone = np.flatnonzero(~stay)
                if len(gone):
                    rows.append((serial % n, serial % n, 9, 0, arrays.pack(size=size[gone], id=id_[a + gone], null=null[a + gone])))
                for bucket, f in _deal([(to[stay], {"i": a + np.flatnonzero(stay)})], n):
                    i = f["i"]
                    data = all_buf[arrays.ranges(all_off[i], all_off[i + 1] - all_off[i])]
                    rows.append((bucket, bucket, 0, 0, arrays.pack(data=data, size=all_off[i + 1] - all_off[i], id=id_[i], null=null[i])))
                yield _batch(rows)

    return run


def _sample_ranks(n: int, width: int):
    """Blocks of sample keys: 6 bytes of the hash, enough beside the bucket to rule a suffix in or out."""

    def run(batches):
        for shelf, blobs in _gather(batches).items():
            s = Shelf([x[3] for x in blobs if x[0] == 0])
            for k, (_, buf, off) in enumerate(s.slabs(width)):
                _, kinds, hashes = _sample(buf, off, width)
                low = (hashes & np.uint64(0xFFFFFFFFFFFF)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
                bucket = ((hashes >> np.uint64(48)) % np.uint64(n)).astype(np.int64)
                rows = [(b, shelf, 1, k, arrays.pack(key=np.ascontiguousarray(f["low"]).reshape(-1), kind=f["kind"])) for b, f in _deal([(bucket, {"low": low, "kind": kinds})], n)]
                yield _batch(rows)

    return run


def _shared_ranks(batches):
    """Which sample suffixes have a rank that can join two different places."""
    for bucket, blocks in _gather(batches).items():
        parts = [arrays.unpack(x[3]) for x in blocks]
        raw = np.concatenate([p["key"] for p in parts]).reshape(-1, 6)
        kind = np.concatenate([p["kind"] for p in parts])
        key = np.zeros((len(raw), 8), np.uint8)
        key[:, :6] = raw
        key = key.view("<u8").reshape(-1)
        order = np.argsort(key, kind="stable")
        s, kd = key[order], kind[order]
        first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
        count = np.diff(np.r_[first, len(s)])
        lo, hi = (np.minimum.reduceat(kd, first), np.maximum.reduceat(kd, first)) if len(s) else (kd, kd)
        # places of equal residue meet at all classes of the cover; the first class is enough for them
        useful = (count > 1) & ((lo != hi) | (lo == 0))
        flags = np.zeros(len(s), bool)
        flags[order] = np.repeat(useful, count)
        at = np.cumsum([0, *(len(p["kind"]) for p in parts)])
        yield _batch([(shelf, bucket, 2, slab, arrays.pack(flags=np.packbits(flags[a:z]))) for (_, shelf, slab, _), a, z in zip(blocks, at[:-1], at[1:]) if flags[a:z].any()])


def _flags(blocks: list[tuple[int, int, int, bytes]], kind: int) -> dict[tuple[int, int], np.ndarray]:
    return {(slab, bucket): arrays.unpack(block)["flags"] for k, bucket, slab, block in blocks if k == kind}


def _spread(bucket: np.ndarray, slab: int, flags: dict[tuple[int, int], np.ndarray], n: int) -> np.ndarray:
    """Flags that came back by bucket, put in the order in which the keys were sent."""
    out = np.zeros(len(bucket), bool)
    order = np.argsort(bucket, kind="stable")
    edge = np.searchsorted(bucket[order], np.arange(n + 1))
    for b in np.flatnonzero(np.diff(edge)):
        got = flags.get((slab, int(b)))
        if got is not None:
            out[order[edge[b] : edge[b + 1]]] = np.unpackbits(got, count=int(edge[b + 1] - edge[b])).astype(bool)
    return out


def _copies(rows: np.ndarray) -> np.ndarray:
    """For each row of bytes the first row that is equal."""
    m, width = rows.shape
    padded = np.zeros((m, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = rows
    words = padded.view(np.uint64)
    h = np.zeros(m, np.uint64)
    for j in range(words.shape[1]):
        h = arrays.mix(h ^ words[:, j]) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(h, kind="stable")
    new = np.ones(m, bool)
    near = np.flatnonzero(h[order[1:]] == h[order[:-1]])
    new[near + 1] = (rows[order[near + 1]] != rows[order[near]]).any(axis=1)  # equal hashes are only a hint
    first = np.empty(m, np.int64)
    first[order] = order[np.maximum.accumulate(np.where(new, np.arange(m), 0))] if m else order
    return first


def _contexts(padded: np.ndarray, at: np.ndarray, before: np.ndarray, after: np.ndarray, width: int, margin: int) -> np.ndarray:
    """Rows of margin bytes before, width bytes from, and margin bytes after each place, zero beyond the text, and how many of the margins are text."""
    m = np.lib.stride_tricks.sliding_window_view(padded, width + 2 * margin)[at].copy()
    steps = np.arange(margin)
    m[:, :margin][margin - steps[None, :] > before[:, None]] = 0
    m[:, margin + width :][steps[None, :] >= after[:, None]] = 0
    return np.concatenate([m, before[:, None].astype(np.uint8), after[:, None].astype(np.uint8)], axis=1)


def _all_offsets(before: np.ndarray, after: np.ndarray, margin: int) -> np.ndarray:
    """A bit for each offset at which a string of full length lies within the text."""
    out = np.zeros(len(before), np.uint32)
    for d in range(margin + 1):
        out |= ((before >= d) & (after >= margin - d)).astype(np.uint32) << np.uint32(d)
    return out


def _suffix_contexts(n: int, buckets: int, length: int, width: int):
    """Per block of texts and the shared ranks in it: the contexts of its shared sample suffixes by bucket, and for itself their places."""
    margin = length - width

    def run(left, right):
        blobs, flags = _pair(left, right)
        if not flags or not any(x[0] == 0 for x in blobs):
            return
        s = Shelf([x[3] for x in blobs if x[0] == 0])
        got, shelf = _flags(flags, 2), blobs[0][1]
        for k, (pick, buf, off) in enumerate(s.slabs(width)):
            at, _, hashes = _sample(buf, off, width)
            some = _spread(((hashes >> np.uint64(48)) % np.uint64(n)).astype(np.int64), k, got, n)
            at, hashes = at[some], hashes[some]
            if not len(at):
                continue
            place = np.argsort(at, kind="stable")  # in the order of the texts
            at, bucket = at[place], (arrays.mix(hashes[place]) % np.uint64(buckets)).astype(np.int64)
            row = np.searchsorted(off, at, side="right") - 1
            before, after = np.minimum(margin, at - off[row]), np.minimum(margin, off[row + 1] - at - width)
            padded = np.concatenate([np.zeros(margin, np.uint8), buf, np.zeros(margin, np.uint8)])
            order = np.argsort(bucket, kind="stable")
            present, edge = np.unique(bucket[order], return_index=True)
            own, rows = np.zeros(len(at), bool), []
            for b, x, z in zip(present, edge, np.r_[edge[1:], len(order)]):
                i = order[x:z]
                m = _contexts(padded, at[i], before[i], after[i], width, margin)
                first = _copies(m)
                lead = first == np.arange(len(i))
                own[i] = lead
                who = row[i[lead]]
                cut = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
                of = np.array(pick, np.int64)[who[cut]]
                rows.append((int(b), shelf, 3, k, arrays.pack(rows=m[lead].reshape(-1), count=np.diff(np.r_[cut, len(who)]).astype(np.uint32), id=s.ids[of], null=s.null[of], row=of)))
                if len(rows) >= 256:
                    yield _batch(rows)
                    rows = []
            rows.append((shelf, shelf, 5, k, arrays.pack(at=at[order].astype(np.uint32), own=np.packbits(own[order]), bucket=present.astype(np.uint32), count=np.diff(np.r_[edge, len(order)]).astype(np.uint32))))
            yield _batch(rows)

    return lambda left, right: _whole(run(left, right))


def _byte_order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by their bytes, and how many leading bytes each has in common with the one before."""
    m, width = rows.shape
    padded = np.zeros((m, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = rows
    words = padded.view(">u8").astype(np.uint64)
    order = np.lexsort(words.T[::-1])
    s = rows[order]
    differs = s[1:] != s[:-1]
    common = np.zeros(m, np.int64)
    common[1:] = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
    return order, common


def _repeated_offsets(contexts: np.ndarray, width: int, margin: int) -> np.ndarray:
    """A bit for each offset at which the row's string of full length is that of an earlier row."""
    before, after = contexts[:, -2].astype(np.int64), contexts[:, -1].astype(np.int64)
    first = _copies(contexts)
    out = np.where(first != np.arange(len(contexts)), _all_offsets(before, after, margin), 0).astype(np.uint32)
    lead = np.flatnonzero(first == np.arange(len(contexts)))
    order, common = _byte_order(contexts[lead, margin : 2 * margin + width])  # the suffix and its continuation
    alone = common < width  # no tie with the one before
    alone &= np.r_[alone[1:], True]
    keep = np.zeros(len(lead), bool)
    keep[order] = ~alone
    lead = lead[keep]
    if not len(lead):
        return out
    rows = contexts[lead]
    to_right, right_common = _byte_order(rows[:, margin : 2 * margin + width])
    to_left, left_common = _byte_order(np.concatenate([rows[:, margin : margin + width], rows[:, margin - 1 :: -1]], axis=1))
    n = len(lead)
    right, left = np.empty(n, np.int64), np.empty(n, np.int64)
    before, after = before[lead], after[lead]
    for d in range(margin + 1):
        right[to_right] = np.cumsum(right_common < width + margin - d)
        left[to_left] = np.cumsum(left_common < width + d)
        some = np.flatnonzero((before >= d) & (after >= margin - d))
        key = right[some] * (n + 1) + left[some]
        by_key = np.argsort(key, kind="stable")  # rows are in the order of the texts
        s = key[by_key]
        again = some[by_key[1:][s[1:] == s[:-1]]]
        out[lead[again]] |= np.uint32(1 << d)
    return out


def _whole(batches) -> pa.Table:
    got = [b for b in batches if b.num_rows]
    arrays.give_back()
    return pa.Table.from_batches(got) if got else pa.Table.from_batches([_batch([])])


def _pair(left: pa.Table, right: pa.Table):
    take = lambda t: [x for v in _gather(t.to_batches()).values() for x in v]
    return sorted(take(left), key=lambda x: (x[0], x[3])), take(right)


def _repeats(width: int, margin: int):
    """Sort one bucket of suffixes at a time; what a block of texts keeps for itself passes through."""

    def run(batches):
        of_bucket: dict[int, list] = {}
        for b in batches:
            for bucket, shelf, kind, slab, block in zip(*(b.column(i).to_pylist() for i in range(5))):
                if kind == 5:
                    yield _batch([(bucket, shelf, kind, slab, block)])
                else:
                    of_bucket.setdefault(bucket, []).append((shelf, slab, block))
        for bucket in sorted(of_bucket):
            blocks = sorted(of_bucket.pop(bucket), key=lambda x: x[:2])
            parts = [arrays.unpack(x[2]) for x in blocks]
            rows = np.concatenate([p["rows"] for p in parts]).reshape(-1, width + 2 * margin + 2)
            count = np.concatenate([p["count"] for p in parts]).astype(np.int64)
            ids, null = np.concatenate([p["id"] for p in parts]), np.concatenate([p["null"] for p in parts]).astype(bool)
            shelf = np.concatenate([np.full(len(p["row"]), x[0], np.int64) for x, p in zip(blocks, parts)])
            row = np.concatenate([p["row"] for p in parts])
            texts = np.lexsort((row, shelf, ids, null))  # in the order of the texts, places of a text as they come
            order = arrays.ranges((np.cumsum(count) - count)[texts], count[texts])
            flags = np.zeros(len(rows), np.uint32)
            flags[order] = _repeated_offsets(rows[order], width, margin)
            at = np.cumsum([0, *(len(p["rows"]) // rows.shape[1] for p in parts)])
            yield _batch([(sh, bucket, 4, slab, arrays.pack(flags=flags[a:z])) for (sh, slab, _), a, z in zip(blocks, at[:-1], at[1:]) if flags[a:z].any()])

    return run


def _finish(n: int, length: int, width: int, schema: list[str], keep_text: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        blobs, flags = _pair(left, right)
        s = Shelf([x[3] for x in blobs if x[0] == 0])
        margin = length - width
        places = {slab: arrays.unpack(block) for k, _, slab, block in flags if k == 5}
        repeats = _flags(flags, 4)
        removed: dict[int, np.ndarray] = {}
        for k, (pick, buf, off) in enumerate(s.slabs(width) if places else ()):
            if k not in places:
                continue
            p = places[k]
            at = p["at"].astype(np.int64)
            own = np.unpackbits(p["own"], count=len(at)).astype(bool)
            bits = np.zeros(len(at), np.uint32)
            edge = np.cumsum(np.r_[0, p["count"].astype(np.int64)])
            for b, x, z in zip(p["bucket"].tolist(), edge[:-1], edge[1:]):
                got = repeats.get((k, b))
                if got is not None:
                    bits[x:z][own[x:z]] = got
            row = np.searchsorted(off, at, side="right") - 1
            copy = ~own  # the same context stands earlier in this block
            bits[copy] = _all_offsets(np.minimum(margin, at - off[row])[copy], np.minimum(margin, off[row + 1] - at - width)[copy], margin)
            change = np.zeros(len(buf) + 1, np.int32)
            for d in range(margin + 1):
                hit = at[(bits >> np.uint32(d)) & np.uint32(1) != 0] - d
                np.add.at(change, hit, 1)
                np.add.at(change, hit + length, -1)
            gone = np.cumsum(change[:-1]) > 0
            for j, i in enumerate(pick):
                g = gone[off[j] : off[j + 1]]
                if g.any():
                    removed[i] = g
        cols: dict[str, list] = {c: [] for c in schema}
        for i, r in enumerate(s.rows):
            whole = not s.first[i] and len(r) >= length
            g = removed.get(i)
            spans = 1 if whole else 0 if g is None else int(np.count_nonzero(np.diff(np.r_[0, g.view(np.int8)]) == 1))
            kept = b"" if whole else r if g is None else np.frombuffer(r, np.uint8)[~g].tobytes()
            if not s.first[i] and not whole:  # a short copy loses nothing
                kept, spans = r, 0
            cols["doc_id"].append(None if s.null[i] else int(s.ids[i]))
            cols["n_bytes"].append(len(r))
            cols["n_removed"].append(len(r) - len(kept))
            cols["n_spans"].append(spans)
            cols["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            if keep_text:
                cols["kept"].append(kept)
        for copies in (arrays.unpack(x[3]) for x in blobs if x[0] == 9):
            cols["doc_id"] += [None if no else int(i) for i, no in zip(copies["id"], copies["null"])]
            cols["n_bytes"] += copies["size"].tolist()
            cols["n_removed"] += copies["size"].tolist()
            cols["n_spans"] += [1] * len(copies["size"])
            cols["kept_sha256"] += [hashlib.sha256(b"").hexdigest()] * len(copies["size"])
            if keep_text:
                cols["kept"] += [b""] * len(copies["size"])
        kinds = {"kept_sha256": pa.string(), "kept": pa.binary()}
        return pa.table({c: pa.array(v, kinds.get(c, pa.int64())) for c, v in cols.items()})

    return run


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 100, keep_text: bool = False) -> DataFrame:
    """Per document: (doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept bytes]).

    A byte goes if a string of ``length`` bytes over it starts earlier: in a document of smaller id, or
    earlier in the same one. Ids are integers, nulls come last; rows of the same id count in the order
    of their texts where these are equal and of their blocks otherwise. A null text is empty, texts shorter than ``length`` stay.
    """
    width = length - PERIOD + 1
    if width < 12:
        raise ValueError(f"length must be {PERIOD + 11} or more")
    spark = docs.sparkSession
    n = exchange.partitions(spark)
    narrow = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    shelves = exchange.cut(narrow.mapInArrow(_shelve(n, length), _BLOCK).repartition(n, "bucket"), keep_partitioning=True)
    # no name for what lies before a cut, so that its shuffle files can go
    shared = exchange.cut(exchange.by_bucket(shelves.mapInArrow(_sample_ranks(n, width), _BLOCK), n).mapInArrow(_shared_ranks, _BLOCK))
    # a flag is a bit of a sample suffix, of which perhaps every one is shared
    suffixes = shared.agg(F.coalesce(F.sum(8 * F.octet_length("block")), F.lit(0))).first()[0]
    buckets = n * max(1, -(-int(suffixes) * (length + PERIOD) // (n * BUCKET_BYTES)))
    contexts = shelves.groupBy("bucket").cogroup(shared.groupBy("bucket")).applyInArrow(_suffix_contexts(n, buckets, length, width), _BLOCK)
    repeats = exchange.cut(contexts.repartitionById(n, F.expr(f"bucket % {n}")).mapInArrow(_repeats(width, length - width), _BLOCK))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * keep_text]
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    return shelves.groupBy("bucket").cogroup(repeats.groupBy("bucket")).applyInArrow(_finish(n, length, width, names, keep_text), schema)
