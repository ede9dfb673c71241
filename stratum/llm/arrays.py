"""Vectorised text primitives over the UTF-8 buffers of Arrow columns.

Texts are never turned into Python strings here: a whole Arrow batch is one byte
array plus offsets, and words, hashes and windows are numpy operations on it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; bounds the temporary arrays of a Python worker.
SLAB_BYTES = 6 << 20
#: Bytes hashed at once: eight times as many are held some times over, and two tables of powers for as long as a worker lives.
HASH_BYTES = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of the words ``[^\x20\x09-\x0D]+``.
NON_SPACE = ~_SPACE
#: Bytes of the words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z are lower-cased.
WORD_CHARS = np.zeros(256, bool)
for _lo, _hi in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    WORD_CHARS[_lo:_hi] = True


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


mix = _mix

_BASE = 0xD6E8FEB86659FD93
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
#: A random odd weight for every byte value; the folded table gives A-Z the weights of a-z.
EXACT = _mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
FOLDED = EXACT.copy()
FOLDED[0x41:0x5B] = EXACT[0x61:0x7B]

_powers = {}


def _power_table(base: int, n: int) -> np.ndarray:
    table = _powers.get(base)
    if table is None or len(table) < n:
        table = np.full(max(n, 2 * HASH_BYTES), base, np.uint64)
        table[0] = 1
        np.cumprod(table, out=table)
        if len(table) == 2 * HASH_BYTES:  # a longer one, for a long span, is not kept
            _powers[base] = table
    return table


def _prefix(buf: np.ndarray, weights: np.ndarray) -> np.ndarray:
    out = np.empty(len(buf) + 1, np.uint64)
    out[0] = 0
    np.cumsum(weights[buf] * _power_table(_BASE, len(buf))[: len(buf)], out=out[1:])
    return out


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, weights: np.ndarray = EXACT) -> np.ndarray:
    """64-bit hashes of the byte ranges ``[start, end)``, in ascending order of start.

    The value depends on the bytes alone, so equal strings hash alike in every batch.
    """
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(starts, lo + HASH_BYTES)))
        s, e = starts[i:j] - lo, ends[i:j] - lo
        prefix = _prefix(buf[lo : lo + int(e.max())], weights)
        raw = (prefix[e] - prefix[s]) * _power_table(_BASE_INVERSE, int(s[-1]) + 1)[s]
        out[i:j] = _mix(raw + (e - s).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        i = j
    return out


def texts(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(buf: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the maximal runs of word bytes; runs end at row borders."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = is_word[buf]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], after[-1] = False, False
    before[1:], after[:-1] = inside[:-1], inside[1:]
    borders = offsets[(offsets > 0) & (offsets < n)]
    before[borders], after[borders - 1] = False, False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def row_slabs(offsets: np.ndarray, most_rows: int = 60_000, most_bytes: int = SLAB_BYTES):
    """(first, end) row ranges of bounded size; a longer text is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most_bytes, side="right")) - 1
        j = min(max(i + 1, j), n, i + most_rows)
        yield i, j
        i = j


def pack(**arrays: np.ndarray) -> bytes:
    """Arrays of one dimension as a compressed block of bytes."""
    import pickle

    raw = pickle.dumps({k: (v.dtype.str, v.tobytes()) for k, v in arrays.items()}, protocol=5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(block: bytes) -> dict[str, np.ndarray]:
    import pickle

    raw = pa.decompress(block[8:], int.from_bytes(block[:8], "little"), codec="zstd", asbytes=True)
    return {k: np.frombuffer(v, np.dtype(d)) for k, (d, v) in pickle.loads(raw).items()}


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of ``arange(start, start + length)``."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts.astype(np.int64) - (ends - lengths), lengths)


def give_back() -> None:
    """Return freed memory to the system, where the C library can: a Python worker lives on after its task."""
    import ctypes

    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass
    pa.default_memory_pool().release_unused()
