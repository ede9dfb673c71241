"""Token sequences in training order, in shards of fixed stride.

Texts are encoded with a byte-level BPE vocabulary, closed by an end id and cut into sequences
of one length. Sequences are numbered without gaps in an order that depends on the rows alone; a
keyed Feistel network with cycle-walking permutes the numbers, and the result is the sequence's
place in training. Range partitions of the places are then written as shards, in which record k
begins at k times the stride, so that a reader goes on from any place by seeking.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays, exchange

#: Slices for each bucket of the session's shuffles: what is dealt out grows with the input, and so does what the driver counts.
SLICES_A_BUCKET = 32
#: The public vocabulary's way to cut a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space beyond ASCII and the control separators, as UTF-8.
_ODD_SPACE = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80", b"\x1c", b"\x1d", b"\x1e", b"\x1f")


class Feistel:
    """A keyed permutation of range(n): four rounds on an even number of bits, walked until below n."""

    def __init__(self, n: int, key: int, rounds: int = 4):
        self.n = n
        self.half = np.uint64(max(1, (max(1, n - 1).bit_length() + 1) // 2))
        digest = hashlib.sha256(f"{key}:{n}".encode()).digest()
        self.keys = [np.uint64(int.from_bytes(digest[8 * i : 8 * i + 8], "little")) for i in range(rounds)]
        self.mask = np.uint64((1 << int(self.half)) - 1)

    def _once(self, x: np.ndarray, keys) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for k in keys:
            left, right = right, left ^ (arrays.mix(right + k) & self.mask)
        return (right << self.half) | left  # swapped, so that the keys in reverse undo it

    def _walk(self, x: np.ndarray, keys) -> np.ndarray:
        out = self._once(np.asarray(x, np.uint64), keys)
        while (far := out >= np.uint64(self.n)).any():
            out[far] = self._once(out[far], keys)
        return out.astype(np.int64)

    def forward(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, self.keys)

    def back(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, self.keys[::-1])


class Encoder:
    """Byte-level BPE over Arrow text buffers; equal pieces of a slab are encoded once."""

    def __init__(self, vocabulary: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        self.end = max(self.ranks.values()) + 1
        self.dtype = np.uint16 if self.end < 1 << 16 else np.uint32
        self.size = np.zeros(self.end + 1, np.int64)
        self.size[list(self.ranks.values())] = [len(k) for k in self.ranks]
        self._bpe = None

    def __getstate__(self):
        return self.__dict__ | {"_bpe": None}

    def encode(self, text: str) -> list[int]:
        if self._bpe is None:
            import tiktoken

            self._bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        return self._bpe.encode_ordinary(text)

    def rows(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All tokens one after another, and how many each row has."""
        n = len(offsets) - 1
        raw = buf.tobytes()
        if any(x in raw for x in _ODD_SPACE):  # pieces may not be cut at ASCII space there
            each = [np.array(self.encode(raw[a:b].decode()), self.dtype) for a, b in zip(offsets[:-1], offsets[1:])]
            return np.concatenate([np.zeros(0, self.dtype), *each]), np.array([len(x) for x in each], np.int64)
        space = ~arrays.NON_SPACE[buf]
        cut = np.zeros(len(buf) + 1, bool)
        cut[1:-1] = space[1:] & ~space[:-1]
        cut[offsets] = True
        cut[len(buf)] = False
        starts = np.flatnonzero(cut)
        ends = np.r_[starts[1:], len(buf)]
        row = np.searchsorted(offsets, starts, side="right") - 1
        _, at, inverse = np.unique(arrays.hash_spans(buf, starts, ends), return_index=True, return_inverse=True)
        bare, blank = ~space[starts[at]], space[ends[at] - 1]
        count = np.zeros(len(at), np.int64)
        got: list[np.ndarray] = []
        where = np.zeros(len(at), np.int64)
        total = 0
        for some, lead in ((np.flatnonzero(~bare & ~blank), b""), (np.flatnonzero(bare & ~blank), b"\n")):
            if not len(some):
                continue
            # a piece that begins with space, or with a line feed put before it, is encoded alike in any company
            pieces = [lead + raw[a:b] for a, b in zip(starts[at[some]], ends[at[some]])]
            tokens = np.array(self.encode(b"".join(pieces).decode()), np.int64)
            edge = np.searchsorted(np.cumsum(self.size[tokens]), np.cumsum([len(p) for p in pieces])) + 1
            first = np.r_[0, edge[:-1]] + len(lead)
            where[some], count[some] = total + first, edge - first
            got.append(tokens)
            total += len(tokens)
        for i in np.flatnonzero(blank):
            tokens = np.array(self.encode(raw[starts[at[i]] : ends[at[i]]].decode()), np.int64)
            where[i], count[i] = total, len(tokens)
            got.append(tokens)
            total += len(tokens)
        flat = np.concatenate(got).astype(self.dtype) if got else np.zeros(0, self.dtype)
        return flat[arrays.ranges(where[inverse], count[inverse])], np.bincount(row, count[inverse], n).astype(np.int64)


def _binary(matrix: np.ndarray) -> pa.Array:
    """One binary value for each row of a matrix, without copying."""
    n, width = len(matrix), matrix.shape[1] * matrix.itemsize
    offsets = np.arange(n + 1, dtype=np.int64) * width
    if offsets[-1] < 1 << 31:
        return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(matrix))])
    return pa.array([r.tobytes() for r in matrix], pa.binary())


def slices(spark: SparkSession) -> int:
    return SLICES_A_BUCKET * exchange.partitions(spark)


def sequences(docs: DataFrame, encoder: Encoder, length: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(slice, rank, doc_id, seq, n_tokens, record): the sequences of every text, numbered within hash slices."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(encoder)  # the vocabulary file: fixed, about a megabyte
    key = F.xxhash64(F.col(doc_id), F.col(text))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), key.alias("key"))
    rows = rows.withColumn("slice", F.expr(f"cast(pmod(key, {slices(spark)}L) as int)"))
    rows = rows.repartition(exchange.partitions(spark), "slice").sortWithinPartitions("slice", "key", "doc_id", "text")
    names = ["slice", "rank", "doc_id", "seq", "n_tokens", "record"]

    def run(batches):
        enc, last, so_far = shared.value, -1, 0
        for b in batches:
            all_buf, all_off = arrays.texts(b.column(1))
            all_slices = b.column(3).to_numpy()
            for a, z in arrays.row_slabs(all_off):
                tokens, n = enc.rows(all_buf[all_off[a] : all_off[z]], all_off[a : z + 1] - all_off[a])
                parts = -(-(n + 1) // length)
                total = int(parts.sum())
                first = np.cumsum(parts) - parts
                flat = np.full(total * length, enc.end, enc.dtype)  # the end id closes a text and fills its last sequence
                flat[arrays.ranges(first * length, n)] = tokens
                row = np.repeat(np.arange(z - a), parts)
                seq = np.arange(total) - first[row]
                size = np.minimum(length, n[row] + 1 - seq * length)
                slices = all_slices[a:z][row]
                new = np.flatnonzero(np.r_[slices[0] != last, slices[1:] != slices[:-1]]) if total else np.zeros(0, np.int64)
                start = np.zeros(total, np.int64)
                start[new] = new
                start = np.maximum.accumulate(start) if total else start
                rank = np.arange(total) - start
                head = int(new[0]) if len(new) else total
                rank[:head] += so_far
                if total:
                    last, so_far = int(slices[-1]), int(rank[-1]) + 1
                yield pa.RecordBatch.from_arrays([pa.array(slices), pa.array(rank), b.column(0).slice(a, z - a).take(pa.array(row)), pa.array(seq), pa.array(size), _binary(flat.reshape(total, length))], names)

    kinds = [T.IntegerType(), T.LongType(), docs.schema[doc_id].dataType, T.LongType(), T.LongType(), T.BinaryType()]
    return rows.mapInArrow(run, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)]))


def materialise(docs: DataFrame, vocabulary: str, length: int = 512, key: int = 20240229, per_shard: int = 65536, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(slot, shard, offset, doc_id, seq, n_tokens, record), range-partitioned and sorted by slot."""
    return in_order(places(docs, vocabulary, length, key, per_shard, doc_id, text)).withColumnRenamed("doc_id", doc_id)


def places(docs: DataFrame, vocabulary: str, length: int = 512, key: int = 20240229, per_shard: int = 65536, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(slot, shard, offset, part, doc_id, seq, n_tokens, record), not dealt out yet; ``part`` is the range of slots for ``in_order``.

    Slots are a permutation of 0 .. number of sequences - 1; shard and offset (bytes) say where
    ``write_shards`` puts the record: ``length`` little-endian ids, a stride of which the last byte is a line feed. Every text ends with the end id, so a null or
    empty text is one sequence; what is left of a text's last sequence holds the end id too and n_tokens tells
    how many ids count. Equal rows get different slots; their order does not matter.
    """
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        encoder = Encoder(f.read())
    table = exchange.written(sequences(docs, encoder, length, doc_id, text), "sequences")
    counts = {r[0]: r[1] for r in table.groupBy("slice").agg(F.count(F.lit(1))).collect()}  # one row a slice
    some = slices(spark)
    starts = np.zeros(some, np.int64)
    starts[1:] = np.cumsum([counts.get(i, 0) for i in range(some)])[:-1]
    total = sum(counts.values())
    order, step, n = Feistel(total, key), stride(length, np.dtype(encoder.dtype).itemsize), exchange.partitions(spark)
    names = ["slot", "shard", "offset", "part", "doc_id", "seq", "n_tokens", "record"]

    def run(batches):
        for b in batches:
            slot = order.forward(starts[b.column(0).to_numpy()] + b.column(1).to_numpy()) if b.num_rows else np.zeros(0, np.int64)
            part = (slot.astype(np.float64) * n / max(1, total)).astype(np.int32).clip(0, n - 1)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(slot // per_shard), pa.array(slot % per_shard * step), pa.array(part), *(b.column(i) for i in range(2, 6))], names)

    schema = T.StructType([*(T.StructField(c, T.LongType()) for c in names[:3]), T.StructField("part", T.IntegerType()), *table.schema.fields[2:]])
    return table.mapInArrow(run, schema)


def in_order(placed: DataFrame) -> DataFrame:
    """Records with their places, range-partitioned and sorted by slot."""
    return exchange.by_bucket(placed, exchange.partitions(placed.sparkSession), "part").sortWithinPartitions("slot").drop("part")


def stride(length: int, width: int = 2) -> int:
    """Bytes from one record of a shard to the next: the ids and the line feed that Spark's text writer puts behind them."""
    return length * width + 1


def write_shards(placed: DataFrame, path: str) -> None:
    """Write the records as raw files of fixed stride, a folder for each shard: record k of a shard begins at k times the stride.

    Spark's text writer commits whole tasks, so a lost executor leaves no half shard. Rows are dealt by
    ranges of slots, cut at the borders of shards, so that a shard is one file. ``places`` will do: what is in order would be dealt out twice.
    """
    n = max(1, (placed.agg(F.max("shard")).first()[0] or 0) + 1)
    lines = exchange.by_bucket(placed.select("shard", "slot", "record"), int(n), "shard").sortWithinPartitions("shard", "slot")
    lines.select("shard", F.col("record").cast("string").alias("value")).write.partitionBy("shard").text(path)


def read_from(spark: SparkSession, path: str, slot: int, count: int, per_shard: int, length: int, width: int = 2) -> DataFrame:
    """(slot, record) of ``count`` sequences from a slot on, over the borders of shards, in order: a training run that resumes.

    The shards are read as records of fixed length by Hadoop's input format, which seeks to its split by the stride; the
    row's place is the shard's first slot plus its number in the file. Only the shards of the range are opened. Raises
    ``IndexError`` if the range goes beyond the last slot.
    """
    step = stride(length, width)
    shards = range(slot // per_shard, (slot + max(1, count) - 1) // per_shard + 1)
    parts = []
    for k in shards:
        conf = {"fixedlengthinputformat.record.length": str(step)}
        try:
            rows = spark.sparkContext.newAPIHadoopFile(f"{path}/shard={k}", "org.apache.hadoop.mapreduce.lib.input.FixedLengthInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf=conf)
        except Exception as e:
            if "InvalidInput" in str(e) or "does not exist" in str(e):
                raise IndexError(f"no shard {k}") from e
            raise
        got = rows.toDF("at long, raw binary")
        parts.append(got.select((F.lit(k * per_shard) + F.col("at") / step).cast("long").alias("slot"), F.expr(f"substring(raw, 1, {length * width})").alias("record")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    out = out.where((F.col("slot") >= slot) & (F.col("slot") < slot + count))
    if (n := out.count()) != count:
        raise IndexError(f"{n} of {count} sequences from slot {slot} on exist")
    return out.orderBy("slot")
