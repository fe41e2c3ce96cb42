"""Exact and substring deduplication, the n-gram join and decontamination against plain versions."""

import random

import numpy as np
import pytest
from corpus_fixture import ITEMS, components, documents, exact, frame, hits, passage, same, substring
from hypothesis import given, settings, strategies as st

from paysieve.llm.decontaminate import Automaton, decontaminate
from paysieve.llm.exact_dedup import exact_dedup, golomb_decode, golomb_encode, keep_documents as exact_dedup_stage
from paysieve.llm.common import Words
from paysieve.llm.ngram_join import boundary, filed, keep_documents as near_stage, ngram_join, overlap, partners, subsets_of
from paysieve.llm.substring_dedup import COVERS, substring_dedup


@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=60), st.booleans())
@settings(max_examples=60, deadline=None)
def test_golomb_round_trip(values, crowded):
    v = np.array(sorted(values), np.uint64) >> np.uint64(40 if crowded else 0)
    v = np.unique(v)
    code, k = golomb_encode(v)
    assert (golomb_decode(code, k, len(v)) == v).all()


def test_difference_covers():
    for period, cover in COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_exact(spark):
    rows = documents()
    got = exact_dedup(frame(spark, rows)).collect()
    same([(r.doc_id, r.keep_id, r.group_size) for r in got], exact(rows))
    groups = {}
    for r in got:
        groups.setdefault(r.text_sha256, []).append(r)
    for g in groups.values():
        assert [r.doc_id for r in g if r.kept] == [g[0].keep_id]                 # exactly one row of each group


def test_exact_keeps_documents(spark):
    rows = documents()
    df = frame(spark, rows)
    got = exact_dedup_stage(df)
    assert got.columns == df.columns
    kept = got.collect()
    assert len({(r.text or "").lower() for r in kept if (r.text or "").isascii()}) == sum((r.text or "").isascii() for r in kept)
    assert len(kept) == len({(t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for _, t in rows})


def test_substring(spark):
    rows = documents()
    got = substring_dedup(frame(spark, rows)).collect()
    same([(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got], substring(rows))
    assert all(r.n_removed == sum(b - a for a, b in r.spans) for r in got)


@pytest.mark.parametrize("window", [1, 5])
def test_substring_other_windows(spark, window):
    rows = [r for r in documents() if r[0] != 24]
    got = substring_dedup(frame(spark, rows), window).collect()
    same([(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got], substring(rows, window))


def test_join(spark):
    rows = documents()
    got = ngram_join(frame(spark, rows)).collect()
    same([(r.doc_id, r.n_shingles, r.component_id) for r in got], components(rows))


def test_join_chains_and_small_sets(spark):
    """Chains whose ends are far apart, sets around the boundary of light and heavy, and a crowd around one text."""
    rng = random.Random(5)
    rows, base = [], passage(1, 70).split()
    for k in range(25):                                                          # each differs from the last by one word
        base = base[:k * 2] + [f"w{k}"] + base[k * 2 + 1:]
        rows.append((100 - k, " ".join(base)))
    for n in range(3, 34):
        words = [f"s{n}x{j}" for j in range(n)]
        for k, cut in enumerate((words, words[1:], words[:-1] + ["end"], words[:n // 2] + ["mid"] + words[n // 2 + 1:])):
            rows.append((1000 + n * 10 + k, " ".join(cut)))
    centre = passage(33, 80).split()
    for k in range(60):
        w = list(centre)
        for j in rng.sample(range(80), rng.randint(0, 4)):
            w[j] = f"r{k}{j}"
        rows.append((5000 + k, " ".join(w)))
    got = ngram_join(frame(spark, rows)).collect()
    same([(r.doc_id, r.n_shingles, r.component_id) for r in got], components(rows))
    got = ngram_join(frame(spark, rows), 5, 80).collect()
    same([(r.doc_id, r.n_shingles, r.component_id) for r in got], components(rows, 5, 80))


def test_join_bounds():
    for a in range(1, 60):
        for b in range(1, 60):
            for i in range(min(a, b) + 1):
                if 100 * i >= 85 * (a + b - i):
                    assert i >= overlap(a, b, 85) and b in partners(a, 85) and i > a - filed(a, 85)
    assert boundary({}, 85) == 0 and 0 < boundary({n: 1000 for n in range(1, 25)}, 85) < 24 and subsets_of(1, 85) == 1


@pytest.mark.parametrize("words", [100_000, 15])
def test_decontaminate(spark, words):
    rows = documents()
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate(frame(spark, rows), items, texts=True, item_words=words).collect()
    same([(r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got], hits(rows, ITEMS))
    clean = {r.doc_id: r.clean_text for r in got}
    assert clean[13] == passage(20, 30) + "  " + passage(21, 30) and clean[16] == passage(40, 200)


@given(st.lists(st.lists(st.sampled_from("abc"), min_size=1, max_size=14), min_size=1, max_size=4), st.lists(st.sampled_from("abcd"), max_size=40))
@settings(max_examples=150, deadline=None)
def test_automaton(items, text):
    named = [(str(k), " ".join(i)) for k, i in enumerate(items)]
    a = Automaton([(k, t.encode().split()) for k, t in named], 4)
    words = [w.encode() for w in text]
    spans, found = a.match(words, np.array([a.vocab.get(w, -1) for w in words], np.int64))
    (_, _, n_hit, want), = hits([(1, " ".join(text))], named, 4)
    assert sorted(found) == want and len({j for x, y in spans for j in range(x, y)}) == n_hit


def test_empty_tables(spark):
    df = frame(spark, documents()).limit(0)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert exact_dedup(df).count() == substring_dedup(df).count() == ngram_join(df).count() == decontaminate(df, items).count() == 0
    assert [r.n_hit for r in decontaminate(frame(spark, documents()), items.limit(0)).collect()] == [0] * len(documents())


def test_many_owners_of_hash_ranges(spark, monkeypatch):
    """The exchanges split over owners give the same results."""
    import paysieve.llm.common as common
    import paysieve.llm.exact_dedup as exact_module
    monkeypatch.setattr(common, "OWNER_VALUES", 150)
    monkeypatch.setattr(exact_module, "OWNER_VALUES", 4)
    rows = [r for r in documents() if r[0] != 24]
    df = frame(spark, rows).repartition(3)
    same([(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup(df).collect()], exact(rows))
    same([(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(df).collect()], substring(rows))
    same([(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join(df).collect()], components(rows))


def thue_morse(n):
    """Two words of ``n`` letters that a polynomial in the bytes modulo a power of two cannot tell apart."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_that_weak_hashes_confuse(spark, n):
    one, other = thue_morse(n)
    rows = [(1, passage(3, 12) + " " + one), (2, passage(3, 12) + " " + other), (3, one), (4, other)]
    assert [r.n_removed for r in substring_dedup(frame(spark, rows)).collect()] == [0] * 4
    assert {(r.doc_id, r.component_id) for r in ngram_join(frame(spark, rows[2:])).collect()} == {(3, 3), (4, 4)}
    got = ngram_join(frame(spark, rows[:2]), 4, 85).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == set(components(rows[:2]))


def test_word_keys():
    words = [bytes([97 + k % 26]) * n for n in (*range(1, 20), 31, 32, 33, 64, 500) for k in range(26)] + [x.encode() for n in (8, 64, 1024) for x in thue_morse(n)]
    assert len(set(Words([b" ".join(words)]).keys().tolist())) == len(set(words))
    assert (Words([b" ".join(words)]).keys(7) == Words(words).keys()).all()


def test_columns_of_any_name_are_kept(spark):
    docs = frame(spark, documents())
    marks = [c for c in docs.columns if c not in ("doc_id", "text")]
    for stage in (exact_dedup_stage, near_stage):
        kept = stage(docs)
        assert kept.schema == docs.schema and kept.select(*marks).distinct().exceptAll(docs.select(*marks).distinct()).isEmpty()
