"""The trie of conversations against one built turn by turn."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from paysieve.llm.prefix_trie import RangeMin, _sequence_batch, prefix_trie, trie_nodes


def trie(sequences):
    """(conv_id, depth, parent, n_convs, n_children, n_leaves, saved, ends) of every node; a sequence is a list of (role, text)."""
    members = {}
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for key in members:
        if key:
            kids.setdefault(key[:-1], []).append(key)

    def below(key):
        own, todo = [], [key]
        while todo:
            own.append(todo.pop())
            todo += kids.get(own[-1], [])
        return own

    out = []
    for key, m in members.items():
        under = below(key)
        ends = ",".join(str(c) for c in sorted(m) if len(sequences[c]) == len(key))
        out.append((min(m), len(key), min(members[key[:-1]]) if key else None, len(m), len(kids.get(key, [])), sum(k not in kids for k in under),
                    sum((len(members[k]) - 1) * len(k[-1][1]) for k in under if k), hashlib.sha256(ends.encode()).hexdigest()))
    return out


def rebuild(rows):
    own = {}
    name = lambda r: hashlib.sha256(f"{len(r[0])}:{r[0]}{r[1]}".encode()).digest()
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x, key=lambda v: (v[0], v[1], v[2], name(v[2:])))] for c, x in own.items()}
    trunc = lambda c: c - int(np.fmod(c, 100))
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    return {c: own.get(trunc(c), [])[:h[c]] + x[h[c]:] for c, x in own.items()}


def frame(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.select("*", *(F.lit(1).alias(c) for c in ("name", "n", "names", "lens", "base", "h", "key", "depth", "seq")))


def told(df):
    return sorted(map(repr, map(tuple, df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())))


def conversations(seed, n):
    rng, rows = random.Random(seed), []
    for c in range(n):
        for k in range(rng.choice([0, 1, 2, 3, 5, 9])):
            rows.append((c if c % 7 else c + 300, k, "user" if k % 2 == 0 else "assistant", f"say {rng.choice('aab') * (k + 1)}"))
    rows += [(c, None, None, None) for c in (5, 6, 205)] + [(7, 3, "user", "tie"), (7, 3, "user", "eit"), (7, 3, None, "x"), (7, 3, "user", "tie"), (-3, 0, "user", "minus"),
             (-3, 1, "user", "two"), (None, 0, "user", "nobody"), (901, 0, "user", "é" * 50_000), (902, 0, "user", "é" * 50_000)]
    rows += [(1000, k, "user", "long talk") for k in range(150)] + [(1001, k, "user", "long talk") for k in range(90)]
    return rows


def test_against_a_plain_trie(spark):
    rows = conversations(1, 320)
    assert told(prefix_trie(frame(spark, rows))) == sorted(map(repr, trie(rebuild(rows))))


def sequence_table(spark, sequences):
    pack = lambda turns: b"".join(hashlib.sha256(repr(t).encode()).digest()[:16] for t in turns)
    rows = [(c, pack(s), np.array([len(t) for _, t in s], "<i4").tobytes()) for c, s in sequences.items()]
    return spark.createDataFrame(rows, "conv_id long, names binary, lens binary") if rows else spark.createDataFrame([], "conv_id long, names binary, lens binary")


@pytest.mark.parametrize("turns,rows", [(60, 10), (10**6, 40), (10**6, 10**6)])
def test_nodes_across_chunks(spark, turns, rows):
    rng = random.Random(turns)
    seqs = {c: [("u", rng.choice(["a", "a", "bb"])) for _ in range(rng.choice([0, 0, 1, 2, 4, 6]))] for c in range(120)}
    seqs |= {c: [("u", "a"), ("u", "copy")] for c in range(200, 260)}            # a group of copies over many chunks
    assert told(trie_nodes(sequence_table(spark, seqs), turns, rows)) == sorted(map(repr, trie(seqs)))


def test_no_conversations_and_no_turns(spark):
    assert prefix_trie(frame(spark, [(1, 0, "user", "x")]).limit(0)).count() == 0
    assert told(trie_nodes(sequence_table(spark, {3: [], 1: []}))) == sorted(map(repr, trie({3: [], 1: []})))
    assert told(prefix_trie(frame(spark, [(None, 0, "user", "x")]))) == []


@given(st.lists(st.integers(0, 6), min_size=1, max_size=40), st.integers(0, 7), st.data())
@settings(max_examples=150, deadline=None)
def test_extents(values, least, data):
    v, n = np.array(values), len(values)
    at = data.draw(st.integers(0, n - 1))
    table, one = RangeMin(v), lambda x: np.array([x])
    right = max(r for r in range(at, n) if all(v[at + 1:r + 1] >= least))
    left = min(x for x in range(at + 1) if all(v[x + 1:at + 1] >= least))
    assert table.rightmost(one(at), one(least))[0] == right and table.leftmost(one(at), one(least))[0] == left
    hi = data.draw(st.integers(at, n - 1))
    assert table.minimum(one(at), one(hi))[0] == v[at:hi + 1].min()


def test_batches_keep_types():
    assert [str(t) for t in _sequence_batch([(1, b"x" * 16, b"abcd")]).schema.types] == ["int64", "binary", "binary"]
