"""Packing against the tokenizer and the lower bound, sharding against its law."""

import zlib
from collections import Counter

import numpy as np
from corpus_fixture import documents, frame, passage
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from paysieve.llm.packing import Coder, Plan, best_fill, pack, tokenizer_path
from paysieve.llm.sharding import evening, flows, shard_documents

ODD = ["", "  ", "a<|endoftext|>b  É İstanbul 'S x'll  \x85 \x1c q é क़ ab\x00c 12 3½ 漢字", "ſt ǆ ﬁ we'll it's", "tab\there"]


def test_coder_equals_the_tokenizer():
    plain, coder = Tokenizer.from_file(tokenizer_path()), Coder(tokenizer_path())
    texts = ODD + [passage(k, 50) for k in range(5)]
    for _ in range(2):
        ids, ends = coder.encode([t.encode() for t in texts])
        for k, t in enumerate(texts):
            assert ids[ends[k]:ends[k + 1]].tolist() == plain.encode(t, add_special_tokens=False).ids


def test_pack(spark):
    rows = documents() + [(100 + k, t) for k, t in enumerate(ODD)]
    plain, got = Tokenizer.from_file(tokenizer_path()), pack(frame(spark, rows)).collect()
    want = []
    for i, t in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [1]
        want += [(i, k, s, len(ids[s:s + 4096]), zlib.crc32(np.array(ids[s:s + 4096], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 4096))]
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in got)
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 4096
    assert len(seqs) <= -(-sum(r.length for r in got) // 4096) + 1
    assert pack(frame(spark, rows).limit(0)).count() == 0


@given(st.lists(st.tuples(st.integers(1, 64), st.integers(1, 40)), max_size=12), st.integers(1, 40))
@settings(max_examples=150, deadline=None)
def test_plan(lengths, groups):
    h = np.zeros(65, np.int64)
    for n, c in lengths:
        h[n] += c
    plan = Plan(h, 64, groups)
    total = int(h.sum())
    if total:
        of = np.repeat(np.arange(64, 0, -1), h[:0:-1])
        fill = np.bincount(plan.sequences(np.arange(total)), of, plan.n_bins)
        assert len(fill) == plan.n_bins and fill.min() > 0 and fill.max() <= 64


def test_best_fill():
    assert best_fill([50, 30, 20], [1, 2, 9], 100) == [1, 1, 1]
    assert best_fill([7], [3], 20) == [2]


def test_plan_is_close_to_the_bound_and_small():
    h = np.bincount(np.clip(np.random.default_rng(1).lognormal(6, 1.3, 50_000).astype(int), 1, 4096), minlength=4097)
    one, many = Plan(h), Plan(h * 1000)
    assert one.n_bins <= 1.01 * (h * np.arange(4097)).sum() / 4096 + 1
    assert len(many.starts) < 4 * len(one.starts)                                # the plan does not grow with the table


def test_shards(spark):
    rows = documents() + [(1000 + k, "copy") for k in range(150)] + [(2000 + k, f"single {k}") for k in range(200)]
    got = shard_documents(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    texts = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert texts == Counter((r.doc_id, r["size"], r.text_crc32) for r in got) and {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    copies = Counter(r.shard for r in got if 1000 <= (r.doc_id or 0) < 1150)
    assert sum(n for _, n in copies.most_common(4)) >= 140                       # 150 copies cannot fit one shard of 48, but need few
    assert shard_documents(frame(spark, rows).limit(0)).count() == 0


def test_flows_respect_capacity():
    x = flows({(0, 1): 50, (1, 0): 10, (2, 1): 40}, [60, 60, 60], [63, 63, 63])
    assert 60 + sum(n for (_, b), n in x.items() if b == 1) - sum(n for (a, _), n in x.items() if a == 1) <= 63
    moves = evening({(0, 0): 3, (0, 1): 7, (1, 0): 1}, [6, 5])
    assert moves == {(0, 0): [(1, 3)], (0, 1): [(1, 1)]}


def test_groups_stay_together(spark):
    rows = [(10 * g + k, f"text {g}") for g in range(60) for k in range(2 + g % 5)] + [(2000 + k, f"single {k}") for k in range(200)]
    shards = {}
    for r in shard_documents(frame(spark, rows)).collect():
        shards.setdefault(r.text_crc32, []).append(r.shard)
    cut = sum(len(s) - max(Counter(s).values()) for s in shards.values())
    assert cut <= 0.1 * 240
