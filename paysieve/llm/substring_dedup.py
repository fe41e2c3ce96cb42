"""Substring deduplication with difference-cover anchors.

Positions of a document are taken modulo a period ``v``; only windows of ``w`` words at the residues of a difference cover are
hashed. Of any two equal windows of ``v + w - 1`` words, some anchor lies at a cover position in both, whatever their offsets, so
anchors that occur nowhere else rule out every window around them. First the anchors are exchanged (5 bytes each, three of seven
positions); then the windows around shared anchors extend them to the full length: their 96-bit hashes are exchanged with the
smallest doc_id per block, and the owner answers whether a smaller document holds the same words.

No pair of documents is ever formed: a passage in a third of all documents costs one entry per block of documents.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Sent, Words, back, blocks, owner_count, shared_replies, unpack, window_hashes, with_replies, workspace

#: Perfect difference covers: every residue modulo the period is a difference of two members.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}


def cover_for(window: int) -> tuple[int, tuple[int, ...], int]:
    """Period, cover and anchor length: the largest period with anchors of at least as many words."""
    period = max(v for v in COVERS if v <= max(1, (window + 1) // 2))
    return period, COVERS[period], window - period + 1


class _Block:
    """The word hashes of a block and what follows from the answers to it."""

    def __init__(self, row, window: int):
        self.ids, self.texts = unpack(row.ids, row.ends, row.body)
        self.window, (self.period, cover, self.anchor) = window, cover_for(window)
        self.w = Words(self.texts)
        self.h = self.w.keys()
        starts = self.w.windows(window)
        self.starts = starts
        inside = np.arange(len(self.h)) - np.repeat(self.w.first, self.w.per_doc)
        at = self.w.windows(self.anchor)
        at = at[np.isin(inside[at] % self.period, cover)]
        self.at = at[np.repeat(self.w.per_doc, self.w.per_doc)[at] >= window]

    def anchors(self, owners: int) -> Sent:
        return Sent(window_hashes(self.h, self.at, self.anchor), owners)

    def candidates(self, anchors: Sent, replies: dict[int, bytes], owners: int) -> None:
        """The windows that hold a shared anchor, in the order in which they are sent."""
        shared = np.zeros(len(self.h) + 1, np.int64)
        shared[self.at + 1] = anchors.answer(replies)
        sums = np.cumsum(shared)
        at = self.starts[sums[self.starts + self.period] > sums[self.starts]]
        doc = self.ids[self.w.doc_of_word()[at]]
        a, b = window_hashes(self.h, at, self.window, 1), window_hashes(self.h, at, self.window, 2).astype(np.uint32)
        owner = (a % np.uint64(owners)).astype(np.int64)
        order = np.lexsort((doc, b, a, owner))
        self.c_at, self.c_doc, a, b, owner = at[order], doc[order], a[order], b[order], owner[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        self.group, first = np.cumsum(new) - 1, np.flatnonzero(new)
        self.a, self.b, self.least, self.owner = a[first], b[first], self.c_doc[first], owner[first]

    def removed(self, replies: dict[int, bytes]) -> np.ndarray:
        """Which words are covered by a window that starts in a document with a smaller id."""
        names, at = np.unique(self.owner, return_index=True)
        smaller = np.zeros(len(self.a), bool)
        for o, lo, hi in zip(names, at, [*at[1:], len(self.a)]):
            smaller[lo:hi] = np.unpackbits(np.frombuffer(replies[int(o)], np.uint8), count=hi - lo)
        hit = self.c_at[smaller[self.group] | (self.c_doc > self.least[self.group])]
        edge = np.zeros(len(self.h) + 1, np.int64)
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + self.window, -1)
        return np.cumsum(edge)[:-1] > 0


def _bits(replies: pd.DataFrame, kind: int) -> dict[int, bytes]:
    own = replies[replies["kind"] == kind]
    return dict(zip(own["owner"].astype(int), own["bits"]))


def _smaller(g: pa.Table) -> pa.Table:
    """One bit per window of each message: does a smaller document hold it?"""
    join = lambda c, t: np.concatenate([np.frombuffer(x.as_py(), t) for x in g.column(c)])
    a, b, doc = join("a", np.uint64), join("b", np.uint32), join("docs", np.int64)
    order = np.lexsort((doc, b, a))
    new = np.ones(len(a), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    least = np.empty(len(a), np.int64)
    least[order] = doc[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    sizes = [len(x.as_py()) // 4 for x in g.column("b")]
    bits = [np.packbits(f).tobytes() for f in np.split(least < doc, np.cumsum(sizes)[:-1])]
    return pa.table({"owner": g.column("owner"), "block": g.column("block"), "bits": pa.array(bits, pa.binary())})


def substring_dedup(docs: DataFrame, window: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text, spans of every document.

    Words are runs of anything but the six ASCII blanks. A word goes if it lies in a window of ``window`` words whose words also
    start in a document with a smaller doc_id; windows are judged on the input. ``kept_text`` joins the other words with one
    space, ``spans`` are [start, end) word ranges that went. A null text has no words; a null id stands after all others;
    repeated rows with one id do not count against each other. An empty table gives an empty result.
    """
    if window < 1:
        raise ValueError("window must be at least 1")
    ws = workspace(docs.sparkSession)
    stored = ws.materialize(blocks(docs), "blocks")
    total = stored.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    owners = owner_count(total // 12)

    def send(batches):
        for batch in batches:
            for row in batch.to_pandas().itertuples(index=False):
                got = list(_Block(row, window).anchors(owners).messages())
                yield pa.RecordBatch.from_pydict({"owner": pa.array([o for o, _, _ in got], pa.int64()), "block": pa.array([row.block] * len(got), pa.int64()),
                                                  "body": pa.array([b for _, b, _ in got], pa.binary()), "many": pa.array([m for _, _, m in got], pa.binary())})

    def extend(row, replies):
        block = _Block(row, window)
        block.candidates(block.anchors(owners), _bits(replies, 0), owners)
        names, at = np.unique(block.owner, return_index=True)
        parts = [slice(a, b) for a, b in zip(at, [*at[1:], len(block.a)])]
        yield pd.DataFrame({"owner": names, "block": row.block, "a": [block.a[p].tobytes() for p in parts], "b": [block.b[p].tobytes() for p in parts],
                            "docs": [block.least[p].tobytes() for p in parts]})

    def finish(row, replies):
        block = _Block(row, window)
        block.candidates(block.anchors(owners), _bits(replies, 0), owners)
        gone = block.removed(_bits(replies, 1))
        out = []
        for text, lo, n in zip(block.texts, block.w.first, block.w.per_doc):
            words, cut = text.split(), gone[lo:lo + n]
            edges = np.flatnonzero(np.diff(np.concatenate([[False], cut, [False]]).astype(np.int8)))
            kept = words if not len(edges) else [w for w, c in zip(words, cut.tolist()) if not c]
            out.append((n, int(cut.sum()), b" ".join(kept).decode(), edges.reshape(-1, 2).tolist()))
        yield pd.DataFrame({"doc_id": block.ids, **{c: [x[i] for x in out] for i, c in enumerate(("n_words", "n_removed", "kept_text", "spans"))}})

    replies = shared_replies(stored.select("block", "ids", "ends", "body").mapInArrow(send, "owner long, block long, body binary, many binary"))
    # a block without anchors has no reply and needs none
    anchors = ws.materialize(replies.withColumn("kind", F.lit(0)), "shared-anchors")
    windows = with_replies(stored, anchors, extend, "owner long, block long, a binary, b binary, docs binary")
    smaller = windows.groupBy("owner").applyInArrow(_smaller, "owner long, block long, bits binary")
    both = anchors.unionByName(ws.materialize(smaller.withColumn("kind", F.lit(1)), "smaller"))
    return back(with_replies(stored, both, finish, "doc_id long, n_words long, n_removed long, kept_text string, spans array<array<long>>"))
