"""Benchmark decontamination with a generalised suffix automaton of the test items.

Items and documents are sequences of normalised words. The automaton holds every substring
of every item; a document streams through it while the longest match that ends at each word
is tracked. Only stretches in which all words occur in some item are streamed, as no match
can reach over any other word.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays, exchange

#: Bytes of text in a slab, which a worker looks through at once.
SLAB_BYTES = 2 << 20


class SuffixAutomaton:
    """All substrings of several word sequences; each window state knows the items that hold it."""

    def __init__(self, items: list[tuple[str, list[int]]], window: int):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.window = window
        self.names = [name for name, _ in items]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        #: For each length that counts as a window, the items of the states that reach it.
        self.short = sorted({len(words) for _, words in items if 0 < len(words) < window})
        self._owners: dict[tuple[int, int], set[int]] = {}
        for k, (_, words) in enumerate(items):
            self._own(k, words)

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:  # an earlier item has this substring
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def _own(self, k: int, words: list[int]) -> None:
        n = len(words)
        want = self.window if n >= self.window else n
        state, length = 0, 0
        for i, w in enumerate(words):
            state, length = self.step(state, length, w)
            if i + 1 >= want:
                self._owners.setdefault((self.at_length(state, want), want), set()).add(k)

    def step(self, state: int, length: int, w: int) -> tuple[int, int]:
        """The state of the longest match after one more word, and its length."""
        nxt = self.next
        while state and w not in nxt[state]:
            state = self.link[state]
            length = self.length[state]
        to = nxt[state].get(w)
        return (0, 0) if to is None else (to, length + 1)

    def at_length(self, state: int, length: int) -> int:
        """The state of the suffix of that length."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state


class Packed:
    """A finished automaton in sorted arrays, some tens of bytes for each word of its items."""

    def __init__(self, a: SuffixAutomaton):
        self.window, self.names, self.wants = a.window, a.names, [*a.short, a.window]
        self.link, self.length = array("i", a.link), array("i", a.length)
        edges = sorted((state << 32 | w, to) for state, nxt in enumerate(a.next) for w, to in nxt.items())
        self.edge, self.to = array("Q", [k for k, _ in edges]), array("i", [t for _, t in edges])
        owners = sorted((state << 32 | want, sorted(items)) for (state, want), items in a._owners.items())
        self.owner = array("Q", [k for k, _ in owners])
        self.first = array("q", [0, *accumulate(len(x) for _, x in owners)])
        self.item = array("i", [i for _, x in owners for i in x])

    def _next(self, state: int, w: int) -> int:
        key = state << 32 | w
        i = bisect_left(self.edge, key)
        return self.to[i] if i < len(self.edge) and self.edge[i] == key else -1

    def scan(self, words: list[int]) -> Iterator[tuple[int, int, array]]:
        """(end, length, items) of every window that ends in ``words``; end is exclusive."""
        state = length = 0
        for i, w in enumerate(words, 1):
            to = self._next(state, w)
            while state and to < 0:
                state = self.link[state]
                length = self.length[state]
                to = self._next(state, w)
            state, length = (to, length + 1) if to >= 0 else (0, 0)
            for want in self.wants:
                if length >= want:
                    at = state
                    while self.length[self.link[at]] >= want:
                        at = self.link[at]
                    k = bisect_left(self.owner, at << 32 | want)
                    if k < len(self.owner) and self.owner[k] == at << 32 | want:
                        yield i, want, self.item[self.first[k] : self.first[k + 1]]


class Index:
    """The automaton with the word numbers that it is built on."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        sequences, numbers, self.longest = [], {}, 0
        for name, text in items:
            buf, offsets = arrays.texts(pa.array([text], pa.string()))
            starts, ends, _ = arrays.word_spans(buf, offsets, arrays.WORD_CHARS)
            hashes = arrays.hash_spans(buf, starts, ends, arrays.FOLDED)
            sequences.append((name, [numbers.setdefault(int(h), len(numbers)) for h in hashes]))
        self.automaton = Packed(SuffixAutomaton(sequences, window))
        self.hashes = np.array(sorted(numbers), np.uint64)
        self.number = np.array([numbers[int(h)] for h in self.hashes], np.int64)
        sizes = [len(s) for _, s in sequences if s]
        self.least = min([window, *sizes])
        # a table of 2^20 bits tells most foreign words apart without a search
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[self.hashes >> np.uint64(44)] = True

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The words' numbers, -1 for words of no item."""
        out = np.full(len(hashes), -1, np.int64)
        some = np.flatnonzero(self.sieve[hashes >> np.uint64(44)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[some]), max(0, len(self.hashes) - 1))
        if len(self.hashes):
            out[some] = np.where(self.hashes[at] == hashes[some], self.number[at], -1)
        return out

    def rows(self, column) -> Iterator[tuple[np.ndarray, list[dict]]]:
        """Of each text: its number of words, hit spans [(first, end)] in words, items, and byte places of the spans."""
        all_buf, all_offsets = arrays.texts(column)
        for a, z in arrays.row_slabs(all_offsets, most_bytes=SLAB_BYTES):
            offsets = all_offsets[a : z + 1] - all_offsets[a]
            buf = all_buf[all_offsets[a] : all_offsets[z]]
            starts, ends, row = arrays.word_spans(buf, offsets, arrays.WORD_CHARS)
            first = np.searchsorted(row, np.arange(z - a + 1))
            number = self.numbers(arrays.hash_spans(buf, starts, ends, arrays.FOLDED))
            known = number >= 0
            edge = np.ones(len(known) + 1, bool)
            edge[1:-1] = (row[1:] != row[:-1]) | (known[1:] != known[:-1])
            cuts = np.flatnonzero(edge)
            lengths = np.diff(cuts)
            found: dict[int, dict] = {}
            for s, n in zip(cuts[:-1][known[cuts[:-1]] & (lengths >= self.least)], lengths[known[cuts[:-1]] & (lengths >= self.least)]):
                r = int(row[s])
                for end, length, owners in self.automaton.scan(number[s : s + n].tolist()):
                    f = found.setdefault(r, {"spans": [], "items": set()})
                    lo, hi = int(s) + end - length, int(s) + end
                    while f["spans"] and f["spans"][-1][1] >= lo and f["spans"][-1][0] >= lo:
                        f["spans"].pop()
                    if f["spans"] and f["spans"][-1][1] >= lo:
                        f["spans"][-1] = (f["spans"][-1][0], max(hi, f["spans"][-1][1]))
                    else:
                        f["spans"].append((lo, hi))
                    f["items"].update(owners)
            for f in found.values():
                f["bytes"] = [(int(starts[x]), int(ends[y - 1])) for x, y in f["spans"]]
            yield np.diff(first), [found.get(r) and found[r] | {"base": int(offsets[r])} for r in range(z - a)]


def build_index(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = 8, most_chars: int = 2 << 20) -> Iterator[Index]:
    """Automata over all items, one after another, each of about ``most_chars`` characters of item text (one item may be longer).

    That bounds what the driver holds at a time (some 220 bytes a character while it builds) and what a worker holds (some 12).
    A larger benchmark becomes more automata, through which every batch of documents streams one after another.
    """
    rows = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).where("t is not null and t <> ''")
    total = rows.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    parts = int(total // most_chars) + 1
    for k in range(parts):
        share = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k)
        yield Index(sorted((r[0] if r[0] is not None else "", r[1]) for r in share.toLocalIterator()), window)


def scan(docs: DataFrame, indexes: Iterable[Index], text: str = "text", keep_text: bool = True) -> DataFrame:
    """Append per document: n_words, spans (array of first and end word), cuts (byte places of the spans), items.

    A null text has no words. All other columns pass through. Automata are broadcast one by one as they are built, and
    where there are several, a worker holds one at a time.
    """
    spark = docs.sparkSession
    shared = [spark.sparkContext.broadcast(x) for x in indexes]
    names = docs.columns

    def run(batches):
        for b in batches:
            column = b.column(names.index(text))
            n_words = np.zeros(b.num_rows, np.int64)
            spans = [[] for _ in range(b.num_rows)]
            cuts = [[] for _ in range(b.num_rows)]
            items: list[set[str]] = [set() for _ in range(b.num_rows)]
            for k, s in enumerate(shared):
                index, at = s.value, 0
                for n, found in index.rows(column):
                    if k == 0:
                        n_words[at : at + len(n)] = n
                    base = np.cumsum(np.r_[0, n[:-1]]) if len(n) else n
                    for i, f in enumerate(found):
                        if f:
                            r = at + i
                            spans[r] = _union(spans[r] + [(x - int(base[i]), y - int(base[i])) for x, y in f["spans"]])
                            cuts[r] = _union(cuts[r] + [(x - f["base"], y - f["base"]) for x, y in f["bytes"]])
                            items[r] |= {index.automaton.names[o] for o in f["items"]}
                    at += len(n)
                if len(shared) > 1:
                    del index
                    s.__dict__.pop("_value", None)  # read again from the executor's copy when its turn comes
            pairs = pa.list_(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i, c in enumerate(names) if keep_text or c != text), pa.array(n_words), pa.array([[list(x) for x in s] for s in spans], pairs), pa.array([[list(x) for x in s] for s in cuts], pairs), pa.array([sorted(s) for s in items], pa.list_(pa.string()))],
                [*(c for c in names if keep_text or c != text), "n_words", "spans", "cuts", "items"],
            )
            arrays.give_back()

    pairs = T.ArrayType(T.ArrayType(T.LongType()))
    own = [T.StructField("n_words", T.LongType()), T.StructField("spans", pairs), T.StructField("cuts", pairs), T.StructField("items", T.ArrayType(T.StringType()))]
    return docs.mapInArrow(run, T.StructType([*(f for f in docs.schema if keep_text or f.name != text), *own]))


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def report(docs: DataFrame, benchmark: DataFrame, window: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: (doc_id, n_words, n_hit, items). No item or no words: no hits."""
    found = scan(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), build_index(benchmark, window=window), keep_text=False)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), "items")


def remove(docs: DataFrame, benchmark: DataFrame, window: int = 8, text: str = "text", most_items: int = 1, most_share: float = 0.5) -> DataFrame:
    """Cut the spans of benchmark windows out of the texts; documents beyond the limits go.

    A document goes if windows of more than ``most_items`` items occur in it, or if they cover
    more than ``most_share`` of its words. Documents without hits stay as they are, with all columns.
    """
    mine, back = exchange.set_aside(docs, {"n_words", "spans", "cuts", "items"})
    shown = {c: h for h, c in back.items()}.get(text, text)
    found = scan(mine, build_index(benchmark, window=window), shown)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    raw = F.encode(F.col(shown), "utf-8")
    ends = F.transform("cuts", lambda c: c[1])
    starts = F.concat(F.transform("cuts", lambda c: c[0]), F.array(F.octet_length(F.col(shown)).cast("long")))
    froms = F.concat(F.array(F.lit(0).cast("long")), ends)
    rest = F.transform(F.arrays_zip(froms.alias("f"), starts.alias("t")), lambda x: F.decode(F.substring(raw, (x["f"] + 1).cast("int"), (x["t"] - x["f"]).cast("int")), "utf-8"))
    cleaned = F.when(F.size("cuts") > 0, F.array_join(rest, "")).otherwise(F.col(shown))
    kept = found.where((F.size("items") <= most_items) & (n_hit <= most_share * F.col("n_words")))
    return kept.withColumn(shown, cleaned).drop("n_words", "spans", "cuts", "items").withColumnsRenamed(back).select(*docs.columns)


def items_digest(items: F.Column) -> F.Column:
    return F.sha2(F.array_join(F.array_sort(items), ",").cast("binary"), 256)


__all__ = ["Index", "Packed", "SuffixAutomaton", "build_index", "items_digest", "remove", "report", "scan"]
