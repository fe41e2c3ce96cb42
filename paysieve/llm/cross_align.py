"""Two tokenizers' tokens of one text, cut into groups where both end a token, and linked within the groups.

Fragments of a text form a monoid: the tokens that end in a byte range are an open prefix (up to the first place where both tokenizers
end a token), closed groups, and an open suffix; without such a place all of them are open. Two neighbours compose to one: suffix and
prefix become a closed group. Composition is associative, so the fragments of a long document, made in different tasks, are reduced as
a tree of fixed fan-in, whose nodes hold open ends alone; closed groups stay where they are and are added up by document.

Short documents are one fragment each. They are bundled in blocks; a block asks once for each id pair that it holds and is told in how
many documents of the corpus the pair is linked.

Texts are cut before a single blank between two characters that are not white space. Neither tokenizer has a token that crosses such a
place, so the pieces between are encoded on their own, each distinct piece once.
"""

from __future__ import annotations

import hashlib
import os
import re
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, back, digest_pieces, docs_of, with_replies, workspace

#: Bytes of a range; a longer document is dealt out in ranges.
RANGE = 65_536
#: Bytes of short documents in a block, and of text that is encoded at once.
BLOCK, ENCODED = 4_000_000, 200_000
#: Pieces that a task remembers; then it starts anew.
CACHED_PIECES = 300_000
#: Fragments composed by one task of the tree.
FAN = 16
#: Token pairs of a group above which equal ids are counted before they are paired.
LARGE_GROUP = 10_000
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: The same in bytes: no ASCII control, blank or other white space of Unicode on either side.
_WHITE = rb"\xc2[\x85\xa0]", rb"\xe1\x9a\x80", rb"\xe2\x80[\x80-\x8a\xa8\xa9\xaf]", rb"\xe2\x81\x9f", rb"\xe3\x80\x80"
_BYTE_CUT = re.compile(b"(?<![\\x00-\\x20\\x7f])" + b"".join(b"(?<!" + w + b")" for w in _WHITE) + b" (?![\\x00-\\x20\\x7f]|" + b"|".join(_WHITE) + b"|$)", re.S)
_aligners: dict[tuple[str, str], "Aligner"] = {}


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("piece_bpe_32k.model"))


def _byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class _Store:
    """The ids of remembered pieces, one after another."""

    def __init__(self):
        self.flat, self.begin, self.size, self.used, self.rows = np.zeros(1 << 18, np.int32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0, 0

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.rows + len(sizes) > len(self.size):
            self.begin, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size))
        self.flat[self.used:self.used + len(ids)] = ids
        rows = slice(self.rows, self.rows + len(sizes))
        self.begin[rows], self.size[rows] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used, self.rows = self.used + len(ids), self.rows + len(sizes)

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.size[at]
        return self.flat[np.repeat(self.begin[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], n


class Aligner:
    """Encodes texts by both tokenizers. ``byte_bpe`` (A) gets a blank before the text, ``piece_bpe`` (B) puts it there itself."""

    def __init__(self, byte_bpe: str, piece_bpe: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_bpe)
        self.a.encode_special_tokens = True                 # their strings inside texts are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_bpe)
        chars = _byte_of_char()
        entries = [self.a.id_to_token(k) or "" for k in range(self.a.get_vocab_size())]
        bytes_a = [bytes(chars[c] for c in t) if all(c in chars for c in t) else t.encode() for t in entries]
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece has a blank after other characters: texts cannot be cut at blanks")
        self.bytes, self.length = (bytes_a, bytes_b), tuple(np.array([len(x) for x in t], np.int64) for t in (bytes_a, bytes_b))
        self.size_b = len(pieces)
        self.bits = (len(entries) * len(pieces)).bit_length()
        number = lambda n, end: [b"%d%s" % (k, end) for k in range(n)]
        self.shown = [*number(len(entries), b","), *number(len(entries), b"|"), *number(len(pieces), b","), *number(len(pieces), b";"), *number(len(pieces), b"")]
        self.at_b = 2 * len(entries)
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.stores, self.good = (_Store(), _Store()), np.zeros(1 << 16, bool)

    def _ids(self, which: int, text: str) -> np.ndarray:
        """The ids of a blank and the text."""
        return np.array(self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids if which == 0 else self.b.encode(text), np.int64)

    def _fits(self, which: int, ids: np.ndarray, data: bytes) -> bool:
        return int(self.length[which][ids].sum()) == len(data) and b"".join(map(self.bytes[which].__getitem__, ids.tolist())) == data

    def _learn(self, pieces: list[str]) -> None:
        """Encodes unknown pieces, many in one text where they neither begin nor end with white space."""
        clean = [p for p in pieces if p and not p[0].isspace() and not p[-1].isspace()]
        groups, size = [[]], 0
        for p in clean:
            if size > ENCODED:
                groups, size = [*groups, []], 0
            groups[-1].append(p)
            size += len(p)
        kept = set(clean)
        for group in [*groups, *([p] for p in pieces if p not in kept)]:
            self._encode(group)

    def _encode(self, group: list[str]) -> None:
        if not group:
            return
        text = " ".join(group)
        data, ends = (" " + text).encode(), np.cumsum([len(p.encode()) + 1 for p in group])
        found = [self._ids(w, text) for w in (0, 1)]
        good = all(self._fits(w, found[w], data) for w in (0, 1))
        if not good and len(group) > 1:
            for half in (group[:len(group) // 2], group[len(group) // 2:]):
                self._encode(half)
            return
        for store, ids, length in zip(self.stores, found, self.length):
            at = np.cumsum(length[ids])
            sizes = np.diff(np.concatenate([[0], np.searchsorted(at, ends, "right")])) if good else np.zeros(len(group), np.int64)
            if good and not (at[np.cumsum(sizes) - 1] == ends).all():
                raise RuntimeError("a token crosses a blank")
            store.add(ids if good else ids[:0], sizes)
        rows = range(self.stores[0].rows - len(group), self.stores[0].rows)
        while rows.stop > len(self.good):
            self.good = np.concatenate([self.good, np.zeros_like(self.good)])
        self.good[rows.start:rows.stop] = good
        self.index.update(zip(group, rows))

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Ids of A and of B of all texts in a row, tokens a text of each, and which texts have tokens: not the empty ones, nor those
        whose tokens do not spell them."""
        if len(self.index) > CACHED_PIECES:
            self._forget()
        split = [_CUT.split(t) for t in texts]
        pieces = [p for s in split for p in s]
        at = np.fromiter(map(self.index.get, pieces, repeat(-1)), np.int64, len(pieces))
        if len(missing := np.flatnonzero(at < 0)):
            self._learn(list(dict.fromkeys(pieces[i] for i in missing)))
            at[missing] = [self.index[pieces[i]] for i in missing]
        cuts = np.cumsum([0] + [len(s) for s in split])
        bad = np.concatenate([[0], np.cumsum(~self.good[at])])
        good = (bad[cuts[1:]] == bad[cuts[:-1]]) & np.array([len(t) > 0 for t in texts], bool)
        at = at[np.repeat(good, np.diff(cuts))]
        inside = np.concatenate([[0], np.cumsum(np.where(good, np.diff(cuts), 0))])
        ids, sizes = [], []
        for store in self.stores:
            flat, n = store.gather(at)
            upto = np.concatenate([[0], np.cumsum(n)])
            ids.append(flat.astype(np.int64))
            sizes.append(np.diff(upto[inside]))
        return ids, sizes, good


def _aligner(paths: tuple[str, str] | None) -> Aligner:
    paths = paths or tokenizer_paths()
    if paths not in _aligners:
        _aligners[paths] = Aligner(*paths)
    return _aligners[paths]


class Groups:
    """Tokens in groups: group k ends where both tokenizers end a token the k-th time, at ``common[k]``."""

    def __init__(self, a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray, common: np.ndarray):
        self.a, self.b, self.n = a, b, len(common)
        self.of_a, self.of_b = np.searchsorted(common, a_ends), np.searchsorted(common, b_ends)
        self.n_a, self.n_b = np.bincount(self.of_a, minlength=self.n), np.bincount(self.of_b, minlength=self.n)
        self.links = self.n_a * self.n_b

    def pairs(self, size_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Group, code of the id pair, and how often, of all links; a pair may come more than once."""
        large = self.links > LARGE_GROUP
        begin_a, begin_b = np.cumsum(self.n_a) - self.n_a, np.cumsum(self.n_b) - self.n_b
        i = np.flatnonzero(~large[self.of_a])
        n = self.n_b[self.of_a[i]]
        i = np.repeat(i, n)
        j = begin_b[self.of_a[i]] + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        out = [(self.of_a[i], self.a[i] * size_b + self.b[j], np.ones(len(i), np.int64))]
        for g in np.flatnonzero(large):
            x, nx = np.unique(self.a[begin_a[g]:begin_a[g] + self.n_a[g]], return_counts=True)
            y, ny = np.unique(self.b[begin_b[g]:begin_b[g] + self.n_b[g]], return_counts=True)
            out.append((np.full(len(x) * len(y), g), (x[:, None] * size_b + y).ravel(), (nx[:, None] * ny).ravel()))
        return tuple(np.concatenate(c) for c in zip(*out))

    def shown(self, aligner: Aligner, closing: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """The tokens in text, in order, and where each group begins among them; after a ``closing`` group no semicolon follows."""
        size_a, end_a, end_b = aligner.at_b // 2, np.cumsum(self.n_a), np.cumsum(self.n_b)
        last_a, last_b = (np.append(g[1:] != g[:-1], True)[:len(g)] for g in (self.of_a, self.of_b))
        order = np.empty(len(self.a) + len(self.b), np.int64)
        order[np.arange(len(self.a)) + (end_b - self.n_b)[self.of_a]] = self.a + last_a * size_a
        order[np.arange(len(self.b)) + end_a[self.of_b]] = aligner.at_b + self.b + last_b * aligner.size_b * (1 + closing[self.of_b])
        return list(map(aligner.shown.__getitem__, order.tolist())), end_a - self.n_a + end_b - self.n_b


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sum of each."""
    order = np.argsort(keys, kind="stable")
    keys, sums = keys[order], np.concatenate([[0], np.cumsum(n[order])])
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[:len(keys)])
    return keys[first], np.diff(sums[np.append(first, len(keys))])


# ---- short documents in blocks ---------------------------------------------------------------------------------------

STORED = "block long, ids binary, numbers binary, shas array<string>, codes binary, holders binary, links binary, row long, doc_id long, k int, lo long, hi long, at long, body binary"
_NAMES = [c.split()[0] for c in STORED.split(", ")]
_TYPES = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]


def _row(**given) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([given.get(c)], t) for c, t in zip(_NAMES, _TYPES)], names=_NAMES)


def _block(aligner: Aligner, block: int, ids: list[int], texts: list[str]) -> pa.RecordBatch:
    """What a block holds of its documents: their numbers, its distinct pairs (ascending codes, documents that hold each), and the links
    of each document as places among the pairs."""
    (a, b), (n_a, n_b), good = aligner.encode(texts)
    a_ends, b_ends = np.cumsum(aligner.length[0][a]), np.cumsum(aligner.length[1][b])
    common = np.intersect1d(a_ends, b_ends, assume_unique=True)
    size = np.cumsum([len(t.encode()) + 1 if g else 0 for t, g in zip(texts, good.tolist())])
    doc = np.searchsorted(size, common)
    groups = Groups(a, a_ends, b, b_ends, common)
    n_groups = np.bincount(doc, minlength=len(texts))
    upto = np.concatenate([[0], np.cumsum(n_groups)])
    n_links = np.diff(np.concatenate([[0], np.cumsum(groups.links)])[upto])
    shown, begin = groups.shown(aligner, np.append(doc[1:] != doc[:-1], True)[:len(doc)])
    begin = np.append(begin, len(shown))[upto].tolist()
    shas = [hashlib.sha256(b"".join(shown[x:y])).hexdigest() if y > x else "" for x, y in zip(begin[:-1], begin[1:])]
    group, code, times = groups.pairs(aligner.size_b)
    keys, times = _summed((doc[group] << aligner.bits) | code, times)
    codes, place, holders = np.unique(keys & ((1 << aligner.bits) - 1), return_inverse=True, return_counts=True)
    per_doc = np.bincount(keys >> aligner.bits, minlength=len(texts))
    packed = zstandard.ZstdCompressor(level=1).compress(np.concatenate([per_doc, place, times]).astype("<u4").tobytes())
    return _row(block=block, ids=np.array(ids, np.int64).tobytes(), numbers=np.stack([n_a, n_b, n_groups, n_links]).astype(np.int64).tobytes(), shas=shas,
                codes=codes.astype(np.int64).tobytes(), holders=holders.astype(np.int64).tobytes(), links=packed)


def ranges(data: bytes, size: int) -> list[tuple[int, int, int, int]]:
    """(lo, hi, from, to): byte ranges of about ``size``, and what to encode for the tokens that end in each, from cut to cut. Where no cut
    lies within ``size`` of an edge, the edge is left out, so a run without cuts is encoded once, in one range."""
    edges = [(0, 0, 0)]
    for at in range(size, len(data), size):
        before = None
        for back_by in (256, size):
            if found := [m.start() for m in _BYTE_CUT.finditer(data, max(0, at - back_by), min(len(data), at + 16)) if m.start() <= at]:
                before = found[-1]
                break
        after = _BYTE_CUT.search(data, at, min(len(data), at + size))
        if before is not None and after:
            edges.append((at, before, after.start()))
    edges.append((len(data), len(data), len(data)))
    return [(x[0], y[0], x[1], y[2]) for x, y in zip(edges, edges[1:])]


def _first_pass(paths, size: int, block_bytes: int):
    def run(batches):
        part, blocks, longs, ids, texts, held = TaskContext.get().partitionId() << 32, 0, 0, [], [], 0
        aligner = _aligner(paths)
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text, i = text.as_py(), int(NO_ID) if i is None else i
                data = (" " + text).encode() if len(text) * 4 > size else b""
                if len(data) > size:
                    for k, (lo, hi, x, y) in enumerate(ranges(data, size)):
                        yield _row(row=part + longs, doc_id=i, k=k, lo=lo, hi=hi, at=x, body=data[x:y])
                    longs += 1
                    continue
                ids.append(i)
                texts.append(text)
                held += len(text)
                if held >= block_bytes:
                    yield _block(aligner, part + blocks, ids, texts)
                    blocks, ids, texts, held = blocks + 1, [], [], 0
        if ids:
            yield _block(aligner, part + blocks, ids, texts)

    return run


def _asked(batches):
    """The pairs of blocks, with the documents of the block that hold each."""
    for batch in batches:
        for block, codes, holders in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            codes = np.frombuffer(codes, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), block, np.int64)), pa.array(codes), pa.array(np.frombuffer(holders, np.int64))], names=["block", "code", "n"])


def _finish(row, told: pd.DataFrame):
    """The documents of a block, from what is told of its pairs: how many documents hold each, and whether its A id has none with more."""
    n_a, n_b, n_groups, n_links = np.frombuffer(row.numbers, np.int64).reshape(4, -1)
    links = np.frombuffer(zstandard.ZstdDecompressor().decompress(row.links), "<u4").astype(np.int64)
    per_doc, rest = links[:len(n_a)], links[len(n_a):]
    place, times = rest[:len(rest) // 2], rest[len(rest) // 2:]
    codes = np.frombuffer(row.codes, np.int64)
    order = np.argsort(told["code"].to_numpy(np.int64))
    if len(order) != len(codes):
        raise RuntimeError("a block was not told of all its pairs")
    count, best = told["count"].to_numpy(np.int64)[order], told["best"].to_numpy(bool)[order]
    cuts = np.concatenate([[0], np.cumsum(per_doc)])
    total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[cuts])
    yield pd.DataFrame({"doc_id": np.frombuffer(row.ids, np.int64), "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "n_best": total(times * best[place]),
                        "count_sum": total(times * count[place]), "groups_sha256": list(row.shas)})


# ---- long documents as fragments -------------------------------------------------------------------------------------

_ENDS = ("pa", "pb", "sa", "sb")


class Fragment:
    """``pa``, ``pb`` (the open prefix's ids of A and B), ``sa``, ``sb`` (the open suffix's) and whether there is a cut between. Without
    one all tokens are the prefix."""

    def __init__(self, k: int, cut: bool, pa, pb, sa, sb):
        self.k, self.cut, self.ends = k, cut, tuple(np.asarray(x, np.int64) for x in (pa, pb, sa, sb))

    def compose(self, other: "Fragment") -> tuple["Fragment", tuple[int, np.ndarray, np.ndarray] | None]:
        """The fragment of both ranges, and the group that closes between them: its place, its ids of A and of B."""
        (pa_, pb, sa, sb), (qa, qb, ta, tb) = self.ends, other.ends
        join = np.concatenate
        if not self.cut:
            return Fragment(self.k, other.cut, join([pa_, qa]), join([pb, qb]), ta, tb), None
        if not other.cut:
            return Fragment(self.k, True, pa_, pb, join([sa, qa]), join([sb, qb])), None
        middle = (other.k, join([sa, qa]), join([sb, qb]))
        return Fragment(self.k, True, pa_, pb, ta, tb), middle if len(middle[1]) else None


def fragment(k: int, a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray) -> tuple[Fragment, Groups]:
    """The fragment of the tokens of a range, and its closed groups."""
    common = np.intersect1d(a_ends, b_ends, assume_unique=True)
    if not len(common):
        none = a[:0]
        return Fragment(k, False, a, b, none, none), Groups(none, none, none, none, none)
    parts = []
    for ids, ends in ((a, a_ends), (b, b_ends)):
        lo, hi = np.searchsorted(ends, common[0], "right"), np.searchsorted(ends, common[-1], "right")
        parts.append((ids[:lo], ids[hi:], ids[lo:hi], ends[lo:hi]))
    (pa_, sa, ca, ea), (pb, sb, cb, eb) = parts
    return Fragment(k, True, pa_, pb, sa, sb), Groups(ca, ea, cb, eb, common[1:])


CLOSED = "row long, place long, good boolean, n_a long, n_b long, n_groups long, n_links long, shown binary, codes binary, times binary"
OPEN = "row long, k int, cut boolean, pa binary, pb binary, sa binary, sb binary"
_FRAGMENT = CLOSED + ", " + OPEN.replace("row long, ", "")


def _closed(aligner: Aligner, groups: Groups) -> dict:
    """What closed groups add to their document."""
    shown, _ = groups.shown(aligner, np.arange(groups.n) == groups.n - 1)
    _, code, times = groups.pairs(aligner.size_b)
    code, times = _summed(code, times)
    return {"n_groups": groups.n, "n_links": int(groups.links.sum()), "shown": b"".join(shown), "codes": code.tobytes(), "times": times.tobytes()}


def _binary(f: Fragment) -> dict:
    return {"k": f.k, "cut": f.cut, **{c: x.tobytes() for c, x in zip(_ENDS, f.ends)}}


def _frame(rows: list[dict], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])


def _fragments(paths):
    """Ranges of long documents to fragments and what their closed groups add."""
    def run(frames):
        aligner = _aligner(paths)
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                ids, _, good = aligner.encode([r.body[1:].decode()])
                inside = []
                for x, length in zip(ids, aligner.length):
                    ends = np.cumsum(length[x]) + r.at
                    keep = (ends > r.lo) & (ends <= r.hi)
                    inside += [x[keep], ends[keep]]
                f, groups = fragment(r.k, *inside)
                rows.append({"row": r.row, "place": 2 * r.k + 1, "good": bool(good[0]), "n_a": len(inside[0]), "n_b": len(inside[2]), **_closed(aligner, groups), **_binary(f)})
            yield _frame(rows, _FRAGMENT)

    return run


def _compose(paths, last: bool):
    """A few neighbouring fragments to one, and the groups that close between them; in the last round the prefix is a group as well."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        aligner, row = _aligner(paths), int(frame["row"].iloc[0])
        left, closed = None, []
        for r in frame.sort_values("k").itertuples(index=False):
            one = Fragment(r.k, r.cut, *(np.frombuffer(getattr(r, c), np.int64) for c in _ENDS))
            left, group = (one, None) if left is None else left.compose(one)
            closed += [group] if group else []
        if last and len(left.ends[0]):
            closed.append((0, *left.ends[:2]))
        one = lambda a, b: Groups(a, np.ones(len(a), np.int64), b, np.ones(len(b), np.int64), np.ones(1, np.int64))
        rows = [{"row": row, "place": 2 * k, "good": True, "n_a": 0, "n_b": 0, **_closed(aligner, one(a, b))} for k, a, b in closed]
        out = _frame([*rows, {"row": row, **_binary(left)}], _FRAGMENT)
        return out.astype({c: "Int64" for c in ("place", "n_a", "n_b", "n_groups", "n_links", "k")})

    return run


def _pairs_of(batches):
    for batch in batches:
        for row, codes, times in zip(*(batch.column(c).to_pylist() for c in range(3))):
            codes = np.frombuffer(codes, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), row, np.int64)), pa.array(codes), pa.array(np.frombuffer(times, np.int64))], names=["row", "code", "times"])


def align_tokens(docs: DataFrame, paths: tuple[str, str] | None = None, range_bytes: int = RANGE, block_bytes: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A blank and the text are encoded by a byte-level BPE (A) and a piece BPE (B), strings of special tokens as plain text. Places where
    tokens of both end cut them into groups; all tokens of A and of B in one group are linked. The count of an id pair is the number of
    documents in which it is linked; ``n_best`` are the links whose count is the highest of their A id, ``count_sum`` adds the counts of
    all links. ``groups_sha256`` is the SHA-256 of ``a,a|b;a|b,b``. Null and empty texts, and texts that the tokens of A or B do not spell
    (B folds U+2581 into a blank), have no tokens: zeros and an empty hash; they add to no count. Repeated rows and null ids are documents
    each. An empty table gives an empty result. Other columns are not read. ``paths`` are the vocabulary files of A and B.
    """
    ws = workspace(docs.sparkSession)
    stored = ws.materialize(docs_of(docs).mapInArrow(_first_pass(paths, range_bytes, block_bytes), STORED), "blocks")
    blocks = stored.filter("block is not null").select("block", "ids", "numbers", "shas", "codes", "holders", "links")
    pieces = stored.filter("row is not null").select("row", "doc_id", "k", "lo", "hi", "at", "body")
    size = pieces.agg(F.count("*").alias("n"), F.coalesce(F.max("k"), F.lit(0)).alias("k")).first()
    spread = max(1, -(-size["n"] // 16))                                       # about a megabyte of text a task
    made = ws.materialize(pieces.repartition(spread, "row", "k").mapInPandas(_fragments(paths), _FRAGMENT), "fragments")
    level, closed, fan = made.select(*(c.split()[0] for c in OPEN.split(", "))), made.drop("k", "cut", *_ENDS), FAN
    while True:
        last = fan > size["k"]
        done = ws.materialize(level.groupBy("row", F.floor(F.col("k") / fan).alias("g")).applyInPandas(_compose(paths, last), _FRAGMENT), "composed")
        closed = closed.unionByName(done.filter("place is not null").drop("k", "cut", *_ENDS))
        if last:
            break
        level, fan = done.filter("k is not null").select(*level.columns), fan * FAN
    sums = ws.materialize(closed.groupBy("row").agg(F.min("good").alias("good"), *(F.sum(c).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links"))), "sums")
    sound = closed.join(sums.filter("good").select("row"), "row", "left_semi")
    held = ws.materialize(sound.select("row", "codes", "times").mapInArrow(_pairs_of, "row long, code long, times long").groupBy("row", "code").agg(F.sum("times").alias("times")), "pairs")
    asked = ws.materialize(blocks.select("block", "codes", "holders").mapInArrow(_asked, "block long, code long, n long"), "asked")
    counted = asked.select("code", "n").unionByName(held.select("code", F.lit(1).cast("long").alias("n"))).groupBy("code").agg(F.sum("n").alias("count"))
    counted = ws.materialize(counted, "counts")
    of_a = F.expr(f"code div {_aligner(paths).size_b}")
    most = counted.groupBy(of_a.alias("a")).agg(F.max("count").alias("most"))
    known = ws.materialize(counted.withColumn("a", of_a).join(most, "a").select("code", "count", (F.col("count") == F.col("most")).alias("best")), "known")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    short = with_replies(blocks, asked.select("block", "code").join(known, "code"), _finish, schema)
    links = held.join(known, "code").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    hashed = digest_pieces(sound.filter("n_groups > 0").select("row", "place", "shown"), "row long", "place", "shown", b";", spread, "groups_sha256")
    long = pieces.filter("k = 0").select("row", "doc_id").join(sums, "row").join(links, "row", "left").join(hashed, "row", "left")
    number = lambda c: F.when(F.col("good"), F.coalesce(c, F.lit(0))).otherwise(0).cast("long").alias(c)
    told = long.select("doc_id", *map(number, ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
    return back(short.unionByName(told))
