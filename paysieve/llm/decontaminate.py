"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items' words feed one automaton; each document streams through it, and the longest suffix that occurs in an item is known at
every word. A match of ``window`` words or more, or a whole item that is shorter, marks its words. The automaton is built for at
most ``ITEM_WORDS`` words of items, so what a task holds does not grow with the benchmark: further items make further automata,
and the documents stream through all of them in one stage without a shuffle.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of items in one automaton.
ITEM_WORDS = 100_000
#: Bytes to separators or to lower case: a word is a run of 0-9, a-z and every character beyond ASCII.
_FOLD = bytes(b if b >= 128 or 48 <= b < 58 or 97 <= b < 123 else b + 32 if 65 <= b < 91 else 32 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


class Automaton:
    """All substrings of the items' words."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window, self.vocab = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.whole: dict[int, list[tuple[int, str]]] = {}
        owned: list[set[str]] = [set()]
        self._owned = owned
        for item, words in items:
            at = 0
            for w in words:
                at = self._extend(at, self.vocab.setdefault(w, len(self.vocab)))
                owned[at].add(item)
            if 0 < len(words) < window:
                self.whole.setdefault(at, []).append((len(words), item))
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.link[v] > 0 and self.length[self.link[v]] >= window:      # shorter ones answer for no window
                owned[self.link[v]] |= owned[v]
        self.least = min([window, *(n for got in self.whole.values() for n, _ in got)])
        self._short: dict[int, list[tuple[int, str]]] = {}

    def _new(self, length: int, link: int, follow: dict[int, int]) -> int:
        self.next.append(follow)
        self.length.append(length)
        self.link.append(link)
        self._owned.append(set())
        return len(self.link) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The part of state ``q`` that is one word longer than ``p``, as a state of its own."""
        if self.length[p] + 1 == self.length[q]:
            return q
        twin = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = twin
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = twin
            p = self.link[p]
        return twin

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c, self.next[last][c])
        made, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = made
            p = self.link[p]
        if p >= 0:
            self.link[made] = self._split(p, c, self.next[p][c])
        return made

    def _items(self, v: int) -> set[str]:
        """Items that hold the window ending here; the state is the one whose strings include that length."""
        while self.length[self.link[v]] >= self.window:
            v = self.link[v]
        return self._owned[v]

    def _shorter(self, v: int) -> list[tuple[int, str]]:
        """Whole short items that are suffixes of the strings of a state."""
        if v <= 0:
            return []
        while self.length[self.link[v]] >= self.window:                           # the state of a short item is no longer than it
            v = self.link[v]
        if v not in self._short:
            self._short[v] = self.whole.get(v, []) + (self._shorter(self.link[v]) if self.link[v] > 0 else [])
        return self._short[v]

    def stream(self, ids: list[int], base: int, hits: list[tuple[int, int]], items: set[str]) -> None:
        """Follow one run of known words; adds [start, end) word ranges and the items."""
        follow, link, length, window = self.next, self.link, self.length, self.window
        v = n = 0
        for i, c in enumerate(ids, base + 1):
            while v and c not in follow[v]:
                v = link[v]
                n = length[v]
            if c in follow[v]:
                v, n = follow[v][c], n + 1
            else:
                v = n = 0
            if n >= window:
                hits.append((i - n, i))
                items |= self._items(v)
            if self.whole:
                for m, item in self._shorter(v):
                    if m <= n:
                        hits.append((i - m, i))
                        items.add(item)

    def match(self, words: list[bytes], ids: np.ndarray) -> tuple[list[tuple[int, int]], set[str]]:
        hits: list[tuple[int, int]] = []
        items: set[str] = set()
        known = np.concatenate([[False], ids >= 0, [False]])
        edges = np.flatnonzero(known[1:] != known[:-1]).reshape(-1, 2)
        for a, b in edges[edges[:, 1] - edges[:, 0] >= self.least].tolist():      # a word of no item resets the automaton
            self.stream(ids[a:b].tolist(), a, hits, items)
        return hits, items


def _merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def _cut(text: str, spans: list[list[int]]) -> str:
    """The text without the characters from the first to the last word of each span."""
    data = text.encode()
    at = [m.span() for m in _WORD.finditer(data)]
    parts, last = [], 0
    for a, b in spans:
        parts.append(data[last:at[a][0]])
        last = at[b - 1][1]
    return b"".join([*parts, data[last:]]).decode()


def _item_blocks(items: DataFrame, item_words: int):
    held, size = [], 0
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.coalesce("text", F.lit("")).alias("t")).dropDuplicates().orderBy("i", "t")
    for r in rows.toLocalIterator():
        words = words_of(r["t"])
        if words:
            if held and size + len(words) > item_words:
                yield held
                held, size = [], 0
            held.append((r["i"], words))
            size += len(words)
    if held:
        yield held


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, texts: bool = False, item_words: int = ITEM_WORDS, carry: bool = False) -> DataFrame:
    """doc_id (with ``carry`` the whole row as struct ``given``), n_words, n_hit, spans ([start, end) word ranges), items (ids as strings, sorted) of every document; with ``texts``
    also ``clean_text``, the text without those spans.

    Words: after lower-casing A-Z, runs of digits, a-z and characters beyond ASCII. A word is hit if it lies in ``window``
    consecutive words of an item, or in a whole item of fewer words. Null texts have no words; items without words match nothing;
    repeated items count once; an item whose id is null is named by the empty string. No items: no hits.
    """
    def through(automaton: Automaton, last: bool):
        def run(batches):
            for batch in batches:
                text, before, known = batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()
                n_words, spans, found, clean = [], [], [], []
                get = automaton.vocab.get
                for k, t in enumerate(text):
                    t = t.as_py()
                    words = words_of(t)
                    ids = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
                    hits, names = automaton.match(words, ids)
                    merged = _merged([*map(tuple, before[k]), *hits])
                    n_words.append(len(words))
                    spans.append(merged)
                    found.append(sorted(names.union(known[k])))
                    if last and texts:
                        clean.append(_cut(t, merged) if merged else t)
                out = [batch.column(0), text, pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(found, pa.list_(pa.string())), pa.array(n_words, pa.int64())]
                if last:
                    out[1] = pa.array(clean if texts else [None] * len(n_words), pa.string())
                yield pa.RecordBatch.from_arrays(out, names=["given", "text", "spans", "items", "n_words"])
        return run

    first = F.struct(*(F.col(c) for c in docs.columns)).alias("given") if carry else F.col("doc_id").alias("given")
    rows = docs.select(first, F.coalesce("text", F.lit("")).alias("text"), F.array().cast("array<array<long>>").alias("spans"), F.array().cast("array<string>").alias("items"))
    schema = T.StructType([rows.schema["given"], T.StructField("text", T.StringType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
                           T.StructField("items", T.ArrayType(T.StringType())), T.StructField("n_words", T.LongType())])
    groups = _item_blocks(items, item_words)
    ahead = next(groups, [])
    while True:
        held, ahead = ahead, next(groups, None)
        rows = rows.select("given", "text", "spans", "items").mapInArrow(through(Automaton(held, window), ahead is None), schema)
        if ahead is None:
            break
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x[1] - x[0])
    return rows.select(F.col("given").alias("given" if carry else "doc_id"), "n_words", n_hit.alias("n_hit"), "spans", "items", *([F.col("text").alias("clean_text")] if texts else []))
