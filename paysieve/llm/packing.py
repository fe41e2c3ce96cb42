"""Best-fit packing of tokenised documents by linear grouping.

The plan is made from the histogram of piece lengths alone, at most ``capacity`` numbers however large the table is:

1. Pieces longer than ``small`` are put in ``groups`` groups of equal cardinality by length, and each counts as long as the longest
   of its group (linear grouping), so few sizes remain.
2. Configurations of these sizes are optimised: the largest size left, with the set of others that fills the sequence best (a
   subset sum), as often as the counts allow.
3. Actual pieces take the places of their group, by rank; what they leave free is known from the histogram again.
4. Small pieces go, longest first, into the fullest sequences that hold them (best fit), whole intervals of equal sequences at a time.

A piece finds its sequence from its rank among the pieces of its length. Ranks are counted by task while tokenising and shifted by
the counts of earlier tasks, so no length is sorted or gathered in one place.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from bisect import bisect_left, bisect_right, insort
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, Words, workspace

CAPACITY, END_ID, GROUPS = 4096, 1, 512
#: Words whose ids a task remembers; then it starts anew, as does the next task of a worker, which else would hold them for ever.
CACHED_WORDS = 250_000
#: Bytes of text encoded at once.
SLICE = 1_000_000
_coders: dict[str, "Coder"] = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class Coder:
    """Ids of texts. Its pre-tokeniser never joins over ASCII blanks, so the ids of a text are those of its words in turn.

    It lower-cases, and parts a letter or digit from a mark after it, so a word is looked up without its case and without one stop or
    comma at its end. Words are parted, folded and made distinct as arrays; only the distinct ones of a slice become Python objects,
    and only unknown ones go to the tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.ends_word = np.array([(self.tokenizer.id_to_token(k) or "").endswith("</w>") for k in range(size)])
        self._forget()

    def _forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.lengths, self.flat, self.used, self.rows = np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.uint32), 0, 0
        self.begins = np.zeros(1 << 16, np.int64)

    def _add(self, words: list[bytes], ids: np.ndarray, n: np.ndarray) -> None:
        while self.rows + len(words) > len(self.lengths):
            self.lengths, self.begins = (np.concatenate([x, np.zeros_like(x)]) for x in (self.lengths, self.begins))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used:self.used + len(ids)] = ids
        self.lengths[self.rows:self.rows + len(words)] = n
        self.begins[self.rows:self.rows + len(words)] = self.used + np.concatenate([[0], np.cumsum(n)[:-1]])
        self.index.update(zip(words, range(self.rows, self.rows + len(words))))
        self.used, self.rows = self.used + len(ids), self.rows + len(words)

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.lengths[at].astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(n)])
        return self.flat[np.repeat(self.begins[at] - ends[:-1], n) + np.arange(ends[-1])], n

    def _ask(self, words: list[bytes]) -> None:
        """Encodes new words, some thousand in one text. A word of letters alone ends with its only id that ends a word; for others
        the offsets tell which word an id belongs to."""
        letters = [w.isalpha() or not w.isascii() and _is_letters(w.decode()) for w in words]
        for plain in (True, False):
            group = [w for w, x in zip(words, letters) if x == plain]
            for k in range(0, len(group), 4000):
                part = group[k:k + 4000]
                joined = b" ".join(part).decode()
                if plain:
                    ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.int64)
                    n = np.diff(np.concatenate([[-1], np.flatnonzero(self.ends_word[ids])]))
                else:
                    code = self.tokenizer.encode(joined, add_special_tokens=False)
                    ids, n = np.array(code.ids, np.int64), np.zeros(len(part), np.int64)
                    if len(ids):
                        at = np.cumsum([0] + [len(w.decode()) + 1 for w in part[:-1]])
                        n = np.bincount(np.searchsorted(at, [o for o, _ in code.offsets], "right") - 1, minlength=len(part))
                if len(n) != len(part) or n.sum() != len(ids):
                    raise RuntimeError("the vocabulary does not part words at blanks")
                self._add(part, ids, n)

    def _rows_of(self, words: list[bytes]) -> np.ndarray:
        """Where the ids of each word stand."""
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        if len(missing := np.flatnonzero(at < 0)):
            self._ask(list(dict.fromkeys(words[i] for i in missing)))
            at[missing] = [self.index[words[i]] for i in missing]
        return at

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text begins and the last ends."""
        if len(self.index) > CACHED_WORDS:
            self._forget()
        w = Words(texts)
        buf = np.frombuffer(w.data.translate(LOWER), np.uint8)
        at = w.data.find(b"<|")
        if at >= 0:                                                              # a special token is known by its case
            buf, raw = buf.copy(), w.buf
            while at >= 0:
                i = int(np.searchsorted(w.starts, at, "right")) - 1
                buf[w.starts[i]:w.ends[i]] = raw[w.starts[i]:w.ends[i]]
                at = w.data.find(b"<|", int(w.ends[i]))
        w.data, w.buf = buf.tobytes(), buf
        last, before = buf[w.ends - 1], buf[np.maximum(w.ends - 2, 0)]
        tail = np.isin(last, _STOPS) & _ALNUM[before] & (w.ends - w.starts > 1)
        w.ends = w.ends - tail
        _, first, which = np.unique(w.keys(), return_index=True, return_inverse=True)
        _check_equal(w, first[which])
        data, known = w.data, [bytes([x]) for x in _STOPS]
        rows = self._rows_of([data[a:b] for a, b in zip(w.starts[first].tolist(), w.ends[first].tolist())] + known)
        stops = np.zeros(256, np.int64)
        stops[_STOPS] = rows[len(first):]
        order = np.empty(len(w.starts) + int(tail.sum()), np.int64)
        place = np.arange(len(w.starts)) + np.cumsum(tail) - tail
        order[place] = rows[which]
        order[place[tail] + 1] = stops[last[tail]]
        ids, n = self._gather(order)
        ends = np.concatenate([[0], np.cumsum(n)])
        upto = np.concatenate([[0], w.after]).astype(np.int64)                   # words, then words and stops, before each text
        return ids, ends[upto + np.concatenate([[0], np.cumsum(tail)])[upto]]


_STOPS = np.frombuffer(b".,", np.uint8)
_ALNUM = np.array([bytes([x]).isalnum() for x in range(256)])


def _check_equal(w: Words, other: np.ndarray) -> None:
    """Words with one key must be one word, byte by byte."""
    size = w.ends - w.starts
    if (size != size[other]).any():
        raise RuntimeError("two words with one key")
    for lo in range(0, len(size), 1 << 18):
        n = size[lo:lo + (1 << 18)]
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        a, b = (np.repeat(x[lo:lo + (1 << 18)], n) + inside for x in (w.starts, w.starts[other]))
        if (w.buf[a] != w.buf[b]).any():
            raise RuntimeError("two words with one key")


def _is_letters(text: str) -> bool:
    """Whether a text stays one run of letters when it is composed and lower-cased."""
    low = text.lower()
    return low.isalpha() and unicodedata.is_normalized("NFC", low)


def _coder(path: str | None) -> Coder:
    path = path or tokenizer_path()
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def pieces_of(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None) -> DataFrame:
    """Pieces of all documents with ``chunk`` (the task) and ``rank`` (among the task's pieces of that length). Store before use."""
    kind = dict(docs.dtypes)["doc_id"]

    def cut(batches):
        coder, seen, chunk = _coder(tokenizer), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            texts = [(t.as_py() or "").encode() for t in batch.column(1)]
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= SLICE):
                    size, to = size + len(texts[to]), to + 1
                ids, ends = coder.encode(texts[at:to])
                rows = []
                for k in range(to - at):
                    own = np.append(ids[ends[k]:ends[k + 1]], np.uint32(end_id)).astype("<u4")
                    for p, start in enumerate(range(0, len(own), capacity)):
                        part = own[start:start + capacity]
                        rows.append((at + k, p, start, len(part), zlib.crc32(part.tobytes()), seen[len(part)]))
                        seen[len(part)] += 1
                cols = [np.array(c, np.int64) for c in zip(*rows)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0])), pa.array(cols[1].astype(np.int32)), *map(pa.array, cols[2:]), pa.array([chunk] * len(rows), pa.int32())],
                                                 names=["doc_id", "piece", "start", "length", "ids_crc32", "rank", "chunk"])
                at = to
        coder._forget()

    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, rank long, chunk int")


# ---- the plan --------------------------------------------------------------------------------------------------------


def best_fill(sizes: list[int], counts: list[int], room: int) -> list[int]:
    """How many of each size (descending) fill ``room`` best: a bounded subset sum over bits of an integer."""
    full, reach, steps = (1 << (room + 1)) - 1, 1, []
    for k, (s, c) in enumerate(zip(sizes, counts)):
        c, take = min(c, room // s), 1
        while c > 0:
            n = min(take, c)
            steps.append((k, n, reach))
            reach |= (reach << (n * s)) & full
            c, take = c - n, take * 2
        if reach >> room:
            break
    total, out = reach.bit_length() - 1, [0] * len(sizes)
    for k, n, before in reversed(steps):
        if not before >> total & 1:
            out[k] += n
            total -= n * sizes[k]
    return out


class Plan:
    """Where the q-th piece in descending order of length goes: in range i, sequence ``bins[i] + (q - starts[i]) // each[i]``."""

    def __init__(self, histogram: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS, small: int | None = None):
        small = capacity // 16 if small is None else small
        self.sizes = [s for s in range(capacity, 0, -1) if histogram[s]]
        self.upto = [0]
        for s in self.sizes:
            self.upto.append(self.upto[-1] + int(histogram[s]))
        self.base = np.zeros(capacity + 1, np.int64)
        self.base[self.sizes] = self.upto[:-1]
        self.n_bins, self.capacity, self.ranges = 0, capacity, []
        self.free: dict[int, list[tuple[int, int]]] = {}
        self.keys: list[int] = []
        self._large(self.upto[sum(s > small for s in self.sizes)], groups)
        for s, q, n in zip(self.sizes, self.upto, np.diff(self.upto).tolist()):
            if s <= small:
                self._best_fit(s, q, n)
        self.ranges.sort()
        self.starts, self.bins, self.each = (np.array(c, np.int64) for c in zip(*self.ranges)) if self.ranges else (np.zeros(0, np.int64),) * 3

    def _length(self, q: int) -> int:
        return self.sizes[bisect_right(self.upto, q) - 1]

    def _give(self, room: int, begin: int, n: int) -> None:
        if room and n:
            if room not in self.free:
                self.free[room] = []
                insort(self.keys, room)
            self.free[room].append((begin, n))

    def _large(self, n: int, groups: int) -> None:
        per, at, next_q, left = max(1, -(-n // groups)), 0, {}, {}
        while at < n:
            size = self._length(at)                       # the longest of the group stands for all
            next_q.setdefault(size, at)
            left[size] = left.get(size, 0) + min(per, n - at)
            at += per
        while left:
            sizes = sorted(left, reverse=True)
            top = sizes[0]
            counts = [left[s] - (s == top) for s in sizes]
            used = best_fill(sizes, counts, self.capacity - top)
            used[0] += 1
            config = [(s, c) for s, c in zip(sizes, used) if c]
            times = min(left[s] // c for s, c in config)
            self._apply(config, times, next_q)
            for s, c in config:
                next_q[s] += c * times
                left[s] -= c * times
                if not left[s]:
                    del left[s]

    def _apply(self, config: list[tuple[int, int]], times: int, next_q: dict[int, int]) -> None:
        """Actual pieces in place of the sizes; what each sequence has left changes only where a length changes."""
        cuts = {0, times}
        for s, c in config:
            q = next_q[s]
            self.ranges.append((q, self.n_bins, c))
            for edge in self.upto[bisect_right(self.upto, q):bisect_left(self.upto, q + c * times)]:
                cuts.update(((edge - q) // c, min(times, (edge - q) // c + 1)))
        marks = sorted(cuts)
        for a, b in zip(marks, marks[1:]):
            held = sum(self._length(next_q[s] + a * c + k) for s, c in config for k in range(c))
            self._give(self.capacity - held, self.n_bins + a, b - a)
        self.n_bins += times

    def _best_fit(self, s: int, q: int, n: int) -> None:
        def put(begin, bins, each, room):
            nonlocal q, n
            if bins and each:
                self.ranges.append((q, begin, each))
                self._give(room - each * s, begin, bins)
                q, n = q + bins * each, n - bins * each

        while n:
            k = bisect_left(self.keys, s)
            if k == len(self.keys):
                room, begin = self.capacity, self.n_bins
                bins = -(-n // (room // s))
                self.n_bins += bins
            else:
                room = self.keys[k]
                begin, bins = self.free[room].pop()
                if not self.free[room]:
                    del self.free[room], self.keys[k]
            each = room // s
            whole = min(bins, n // each)
            put(begin, whole, each, room)
            if whole < bins and n:
                put(begin + whole, 1, n, room)
                whole += 1
            self._give(room, begin + whole, bins - whole)

    def sequences(self, q: np.ndarray) -> np.ndarray:
        i = np.searchsorted(self.starts, q, "right") - 1
        return self.bins[i] + (q - self.starts[i]) // self.each[i]


def pack(docs: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, end_id: int = END_ID, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and ``end_id``; only a longer one is cut, into pieces of ``capacity``. A null or empty text is the
    end id alone; repeated rows and null ids are documents like others; an empty table gives an empty result. ``tokenizer`` is the
    path of a vocabulary file, the public word BPE unless given.
    """
    ws = workspace(docs.sparkSession)
    stored = ws.materialize(pieces_of(docs, capacity, end_id, tokenizer), "pieces")
    counts = ws.materialize(stored.groupBy("chunk", "length").agg(F.count("*").alias("n")), "counts")
    histogram = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():         # at most ``capacity`` rows
        histogram[r["length"]] = r["n"]
    plan = Plan(histogram, capacity, groups)
    base, starts, bins, each = plan.base, plan.starts, plan.bins, plan.each

    def place(batches):
        for b in batches:
            q = b.column("q").to_numpy() + base[b.column("length").to_numpy()]
            i = np.searchsorted(starts, q, "right") - 1
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(bins[i] + (q - starts[i]) // each[i]), pa.array(q)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "q"])

    earlier = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("chunk", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift"))
    ranked = stored.join(shift.hint("merge"), ["chunk", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("shift") + F.col("rank")).alias("q"))
    placed = ranked.mapInArrow(place, f"doc_id {dict(docs.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long, sequence_id long, q long")
    offset = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("q").rowsBetween(Window.unboundedPreceding, -1))
    return placed.withColumn("offset", F.coalesce(offset, F.lit(0)).cast("long")).drop("q")
