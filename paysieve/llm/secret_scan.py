"""Secret scanning with a linear-chain conditional random field.

Tokens are runs of the characters secrets are made of. A chain of tags (outside, begin, inside) is scored by each token's shape,
length and mix of characters, what stands before and after it, the word before it and features of the whole text; Viterbi finds the
best chain. The model is trained on a bounded sample whose silver tags come from three fixed patterns, and finds what has the shape
and surroundings of a secret though no pattern matches. The patterns' own matches are always reported.

Decoding is exact without visiting every token: a token whose outside score beats every other by more than any transition and
neighbour could give back is outside in the best chain, so it cuts the text, and only the stretches between are decoded.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed patterns: kind, expression, shortest match, group that must have that length.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")                  # runs are maximal, so those that are too short match nowhere
KINDS = ("assign", "access", "hex", "crf")
#: Texts that training reads, about (rows are taken by a hash of the text); one in ``OTHERS`` of those without a match is used.
SAMPLE, OTHERS = 20_000, 10
#: Tokens of a training sequence, sequences at most, hashed words before a token.
LENGTH, SEQUENCES, WORDS = 32, 3000, 1024
TAGS = 3                                            # outside, begin, inside
PLAIN = 16

_TOKEN = np.isin(np.arange(256), list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.-")) | (np.arange(256) >= 128)
_DIGIT = np.isin(np.arange(256), list(b"0123456789")).astype(np.int32)
_HEXADECIMAL = np.isin(np.arange(256), list(b"0123456789abcdef"))
_CLASS = np.zeros((4, 256), np.int64)               # digit, upper, lower, other
for _b in range(256):
    _CLASS[0 if 48 <= _b < 58 else 1 if 65 <= _b < 91 else 2 if 97 <= _b < 123 else 3, _b] = 1
_AROUND = np.full(256, 5, np.int64)
for _k, _chars in enumerate((b" \t\x0b\x0c", b"\n\r", b"\"'`", b"=", b":")):
    _AROUND[list(_chars)] = _k
_LENGTHS = np.array([2, 4, 8, 12, 16, 20, 32, 48, 1 << 60])
#: Blocks of the feature table: shape, length, mix, before, second before, after, share of digits in the text, marks in the text, word before.
SIZES = (32, 9, 8, 6, 6, 6, 4, 4, WORDS)
STARTS = np.concatenate([[0], np.cumsum(SIZES)])
_KEYWORDS = (b"passw", b"secret", b"token", b"api")


def _long_hexadecimal(data: bytes) -> bool:
    inside = np.concatenate([[False], _HEXADECIMAL[np.frombuffer(data, np.uint8)], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return bool(len(edges)) and int((edges[1::2] - edges[0::2]).max()) >= 16


def base_spans(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the secret itself), per kind leftmost and non-overlapping, in the order of start, then kind."""
    data = text.encode()
    low, out = data.lower(), []
    if any(k in low for k in _KEYWORDS):
        out += [("assign", m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if b"AKIA" in data:
        out += [("access", m.start(), m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if _long_hexadecimal(data):
        out += [("hex", m.start(), m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


class Tokens:
    """Tokens of one or more texts as byte ranges, with their features."""

    def __init__(self, texts: list[bytes]):
        self.data = b"\n".join([b"", *texts, b""])
        buf = self.buf = np.frombuffer(self.data, np.uint8)
        is_token = _TOKEN[buf]
        edges = np.flatnonzero(is_token[1:] != is_token[:-1]) + 1
        self.starts, self.ends = edges[0::2], edges[1::2]
        size = np.array([len(t) for t in texts], np.int64)
        self.begin = 1 + np.concatenate([[0], np.cumsum(size + 1)[:-1]]).astype(np.int64) if texts else np.zeros(0, np.int64)
        self.first = np.searchsorted(self.starts, self.begin)
        self.last = np.concatenate([self.first[1:], [len(self.starts)]]).astype(np.int64) if texts else self.first
        sums = np.zeros(len(buf) + 1, np.int32)
        np.cumsum(_DIGIT[buf], out=sums[1:])
        self.size, self.digits = self.ends - self.starts, sums[self.ends] - sums[self.starts]
        share = (sums[self.begin + size] - sums[self.begin]) / np.maximum(size, 1) if texts else np.zeros(0)
        self.share = np.searchsorted([0.005, 0.02, 0.1], share)
        self.marks = np.array([min(3, t.count(b"=") + t.count(b":")) for t in texts], np.int64)

    def features(self, at: np.ndarray) -> np.ndarray:
        """Features x tokens of some tokens, all but the word before."""
        if not len(at):
            return np.zeros((len(SIZES) - 1, 0), np.int64)
        n, starts, ends = self.size[at], self.starts[at], self.ends[at]
        cuts = np.concatenate([[0], np.cumsum(n)[:-1]])
        own = self.buf[np.repeat(starts - cuts, n) + np.arange(int(n.sum()))]
        digit, upper, lower, other = (np.add.reduceat(c[own], cuts) for c in _CLASS)
        shape = (digit > 0) * 1 + (upper > 0) * 2 + (lower > 0) * 4 + (other > 0) * 8 + (upper > 1) * 16
        mixed = np.minimum(3, digit * 4 // n) + 4 * (digit + np.minimum(upper, lower) >= n // 3)
        doc = np.searchsorted(self.first, at, "right") - 1
        cols = (shape, np.searchsorted(_LENGTHS, n, "right"), mixed, _AROUND[self.buf[starts - 1]], _AROUND[self.buf[np.maximum(starts - 2, 0)]], _AROUND[self.buf[ends]],
                self.share[doc], self.marks[doc])
        return np.stack([c.astype(np.int64) + b for c, b in zip(cols, STARTS)])

    def word_before(self, at: np.ndarray) -> np.ndarray:
        """The feature of the lower-cased last letters before each token; the first token of a text sees the text before it as none."""
        firsts = set(self.first.tolist())
        out = []
        for k in at.tolist():
            word = b"" if k in firsts else self.data[self.starts[k - 1]:self.ends[k - 1]].lower()[-24:]
            h = 2166136261
            for c in word:
                h = (h ^ c) * 16777619 & 0xFFFFFFFF
            out.append(h % WORDS)
        return np.array(out, np.int64) + STARTS[-2]


class Chain:
    """Weights of the field: features x tags, tag to tag, and the first tag."""

    def __init__(self, emit: np.ndarray, move: np.ndarray, start: np.ndarray):
        self.emit, self.move, self.start = emit, move, start
        # with all other tags fixed, how much more than outside another tag can get from the first tag, its neighbours and the word before
        odd = range(1, TAGS)
        gains = [start[x] - start[0] for x in odd]
        gains += [move[a, x] - move[a, 0] for a in range(TAGS) for x in odd] + [start[x] + move[x, b] - start[0] - move[0, b] for x in odd for b in range(TAGS)]
        gains += [move[a, x] + move[x, b] - move[a, 0] - move[0, b] for a in range(TAGS) for x in odd for b in range(TAGS)]
        self.lead = emit[:, 0] - emit[:, 1:].max(axis=1)                       # of outside, by feature
        self.margin = float(max(gains)) - float(self.lead[STARTS[-2]:].min(initial=0.0))
        # of tokens without a digit and shorter than PLAIN, whatever else they are made of; and of each byte around a token
        block = lambda k, keep=slice(None): self.lead[STARTS[k]:STARTS[k + 1]][keep]
        self.inner = float(block(0, [v for v in range(32) if not v & 1]).min() + block(2, [0, 4]).min() + block(1, slice(0, int(np.searchsorted(_LENGTHS, PLAIN)) + 1)).min())
        self.around = [block(k)[_AROUND] for k in (3, 4, 5)]

    def outside(self, tokens: Tokens) -> np.ndarray:
        """Tokens that are outside in every best chain, from what is cheap to know."""
        doc = self.lead[STARTS[6]:][tokens.share] + self.lead[STARTS[7]:][tokens.marks]
        block = np.repeat(doc, tokens.last - tokens.first) + self.inner
        block += self.around[0][tokens.buf[tokens.starts - 1]]
        block += self.around[1][tokens.buf[np.maximum(tokens.starts - 2, 0)]]
        block += self.around[2][tokens.buf[tokens.ends]]
        return (tokens.digits == 0) & (tokens.size < PLAIN) & (block > self.margin)

    def viterbi(self, scores: np.ndarray) -> np.ndarray:
        """Best tags of one stretch; its neighbours are outside or the edge of the text."""
        n = len(scores)
        best, back = scores[0], np.zeros((n, TAGS), np.int64)
        for t in range(1, n):
            step = best[:, None] + self.move
            back[t] = step.argmax(axis=0)
            best = step.max(axis=0) + scores[t]
        tags = np.empty(n, np.int64)
        tags[-1] = best.argmax()
        for t in range(n - 1, 0, -1):
            tags[t - 1] = back[t, tags[t]]
        return tags

    def decode(self, tokens: Tokens) -> np.ndarray:
        """Tags of all tokens: stretches between certain outside tokens, with those as their neighbours."""
        n = len(tokens.starts)
        tags = np.zeros(n, np.int64)
        if not n:
            return tags
        at = np.flatnonzero(~self.outside(tokens))
        part_scores = np.zeros((len(at), TAGS))
        for c in tokens.features(at):
            part_scores += self.emit[c]
        unsure = part_scores[:, 0] - part_scores[:, 1:].max(axis=1) <= self.margin
        open_ = at[unsure]
        if not len(open_):
            return tags
        scores = part_scores[unsure] + self.emit[tokens.word_before(open_)]
        doc_first, doc_last = set(tokens.first.tolist()), set(tokens.last.tolist())
        cut = np.flatnonzero((np.diff(open_) > 1) | np.isin(open_[1:], list(doc_first))) + 1
        for part, s in zip(np.split(open_, cut), np.split(scores, cut)):
            s = s.copy()
            s[0] += self.start if int(part[0]) in doc_first else self.move[0]
            if int(part[-1]) + 1 not in doc_last:
                s[-1] += self.move[:, 0]
            tags[part] = self.viterbi(s)
        return tags


def fit(cols: np.ndarray, tags: np.ndarray, mask: np.ndarray, steps: int = 60, rate: float = 0.2, decay: float = 1e-4) -> Chain:
    """Maximum likelihood by Adam. ``cols``: sequences x length x features, ``tags`` and ``mask``: sequences x length."""
    emit, move, start = np.zeros((STARTS[-1], TAGS)), np.zeros((TAGS, TAGS)), np.zeros(TAGS)
    shapes = [p.shape for p in (emit, move, start)]
    m1, m2 = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
    n_seq, length, _ = cols.shape
    weight = 1.0 / max(1, n_seq)
    gold = np.eye(TAGS)[tags] * mask[..., None]
    gold_emit = np.zeros_like(emit)
    np.add.at(gold_emit, cols.reshape(-1), np.repeat(gold.reshape(-1, TAGS), cols.shape[2], axis=0))
    gold_move = np.einsum("sti,stj->ij", gold[:, :-1], gold[:, 1:])
    gold_start = gold[:, 0].sum(axis=0)
    norm = lambda x: np.log(np.exp(x - x.max(axis=-1, keepdims=True)).sum(axis=-1)) + x.max(axis=-1)
    for step in range(1, steps + 1):
        scores = emit[cols].sum(axis=2)
        alpha, beta = np.zeros((n_seq, length, TAGS)), np.zeros((n_seq, length, TAGS))
        alpha[:, 0] = start + scores[:, 0]
        for t in range(1, length):
            now = norm(alpha[:, t - 1][:, None, :] + move.T[None]) + scores[:, t]
            alpha[:, t] = np.where(mask[:, t, None], now, alpha[:, t - 1])
        for t in range(length - 2, -1, -1):
            now = norm(move[None] + (beta[:, t + 1] + scores[:, t + 1])[:, None, :])
            beta[:, t] = np.where(mask[:, t + 1, None], now, 0)
        total = norm(alpha[:, -1])
        post = np.exp(alpha + beta - total[:, None, None]) * mask[..., None]
        g_emit = np.zeros_like(emit)
        flat, grad = cols.reshape(-1), np.repeat(post.reshape(-1, TAGS), cols.shape[2], axis=0)
        for k in range(TAGS):
            g_emit[:, k] = np.bincount(flat, grad[:, k], STARTS[-1])
        pair = np.exp(alpha[:, :-1, :, None] + move[None, None] + (scores[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None]) * mask[:, 1:, None, None]
        for k, (p, g) in enumerate(((emit, g_emit - gold_emit), (move, pair.sum(axis=(0, 1)) - gold_move), (start, post[:, 0].sum(axis=0) - gold_start))):
            g = g * weight + decay * p
            m1[k], m2[k] = 0.9 * m1[k] + 0.1 * g, 0.999 * m2[k] + 0.001 * g * g
            p -= rate * (m1[k] / (1 - 0.9 ** step)) / (np.sqrt(m2[k] / (1 - 0.999 ** step)) + 1e-8)
    return Chain(emit, move, start)


def _byte_at(text: str, at: list[int]) -> list[int]:
    """Byte offsets of ascending code point offsets."""
    out, last, size = [], 0, 0
    for a in at:
        size += len(text[last:a].encode())
        last = a
        out.append(size)
    return out


def examples(text: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """Training sequences (features, silver tags) of a text: stretches of ``LENGTH`` tokens around each match, or its first ones."""
    data = text.encode()
    t = Tokens([data])
    n = len(t.starts)
    if not n:
        return []
    tags = np.zeros(n, np.int64)
    spans = sorted({(s, e) for _, _, e, s in base_spans(text)})
    marks = []
    for (a, b) in spans:
        lo, hi = _byte_at(text, [a, b])
        i, j = np.searchsorted(t.ends, lo + 1, "right"), np.searchsorted(t.starts, hi + 1, "left")
        if i < j:
            tags[i] = 1
            tags[i + 1:j] = 2
            marks.append(int(i))
    cols = np.concatenate([t.features(np.arange(n)), t.word_before(np.arange(n))[None]]).T
    at = sorted({max(0, min(m - LENGTH // 2, n - LENGTH)) for m in marks} or {0})
    return [(cols[a:a + LENGTH], tags[a:a + LENGTH]) for a in at]


def learn(docs: DataFrame) -> Chain | None:
    """The field from a sample of the texts; None where none of them has a match to learn from."""
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    n = texts.count()
    sample = texts.filter(F.pmod(F.xxhash64("text", F.lit(5)), F.lit(1_000_000)) < min(1_000_000, -(-1_000_000 * SAMPLE // max(1, n))))

    def used(text: str) -> bool:
        return zlib.crc32(text.encode()) % OTHERS == 0 or bool(base_spans(text))

    def extract(batches):
        for batch in batches:
            rows = [(c.astype(np.int32).tobytes(), g.astype(np.int8).tobytes()) for t in batch.column(0).to_pylist() if used(t) for c, g in examples(t)]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.binary()), pa.array([g for _, g in rows], pa.binary())], names=["cols", "tags"])

    def train(g: pd.DataFrame) -> pd.DataFrame:
        if not any(any(t) for t in g["tags"]):
            return pd.DataFrame({"emit": [], "move": [], "start": []})
        g = g.sort_values(["cols", "tags"]).drop_duplicates(["cols", "tags"])
        if len(g) > SEQUENCES:
            g = g.sample(SEQUENCES, random_state=0)
        cols = np.zeros((len(g), LENGTH, len(SIZES)), np.int64)
        tags, mask = np.zeros((len(g), LENGTH), np.int64), np.zeros((len(g), LENGTH), bool)
        for k, (c, t) in enumerate(zip(g["cols"], g["tags"])):
            t = np.frombuffer(t, np.int8)
            cols[k, :len(t)] = np.frombuffer(c, np.int32).reshape(len(t), len(SIZES))
            tags[k, :len(t)], mask[k, :len(t)] = t, True
        chain = fit(cols, tags, mask)
        return pd.DataFrame({"emit": [chain.emit.tobytes()], "move": [chain.move.tobytes()], "start": [chain.start.tobytes()]})

    row = sample.mapInArrow(extract, "cols binary, tags binary").withColumn("one", F.lit(1)).groupBy("one").applyInPandas(train, "emit binary, move binary, start binary").first()
    if row is None:
        return None
    return Chain(np.frombuffer(row["emit"]).reshape(-1, TAGS), np.frombuffer(row["move"]).reshape(TAGS, TAGS), np.frombuffer(row["start"]))


def _added(texts: list[str], base: list[list[tuple]], chain: Chain) -> list[list[tuple[str, int, int]]]:
    """Spans of the field, in code points, that overlap no match of a pattern."""
    data = [t.encode() for t in texts]
    t = Tokens(data)
    tags = chain.decode(t)
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    begins = np.flatnonzero(tags > 0)
    if not len(begins):
        return out
    heads = begins[(tags[begins] == 1) | ~np.isin(begins - 1, begins) | np.isin(begins, t.first)]
    doc = np.searchsorted(t.first, heads, "right") - 1
    where: dict[int, tuple[int, int]] = {}
    for h, d in zip(heads.tolist(), doc.tolist()):
        e = h + 1
        while e < t.last[d] and tags[e] == 2:
            e += 1
        last, at = where.get(d, (0, 0))
        lo, hi = int(t.starts[h] - t.begin[d]), int(t.ends[e - 1] - t.begin[d])
        start = at + len(data[d][last:lo].decode())
        end = start + len(data[d][lo:hi].decode())
        where[d] = (hi, end)
        if not any(a < end and start < b for _, a, b, _ in base[d]):
            out[d].append(("crf", start, end))
    return out


def scan(docs: DataFrame, chain: Chain | None) -> DataFrame:
    """doc_id and spans (array of kind, start, end in code points, end exclusive) of every row.

    Order: start, then assign, access, hex, crf. A null text counts as empty; without a model only the patterns' matches are given.
    """
    kind = dict(docs.dtypes)["doc_id"]
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows, at = [], 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= 500_000):
                    size, to = size + len(texts[to]), to + 1
                base = [base_spans(t) for t in texts[at:to]]
                more = _added(texts[at:to], base, chain) if chain else [[] for _ in base]
                for b, m in zip(base, more):
                    every = sorted([(k, s, e) for k, s, e, _ in b] + m, key=lambda x: (x[1], KINDS.index(x[0])))
                    rows.append([{"kind": k, "start": s, "end": e} for k, s, e in every])
                at = to
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, span)], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:long,end:long>>")
