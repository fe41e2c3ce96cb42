"""Aligned tokens against whole texts encoded by the tokenizers themselves."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from corpus_fixture import documents, frame, passage
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from paysieve.llm.cross_align import Aligner, Fragment, Groups, align_tokens, fragment, ranges, tokenizer_paths

ODD = ["a  b \n c\u3000d \u2581x", "<s> </s> <|endoftext|> <unk> 😀", "don't  stop!!  now \x00 x", " lead", "trail ", "\n\n x \t y\r\nz", "漢字かな交じり文 " * 40, "nospace" * 60, "😀" * 90,
       "x" * 200 + " " + "y" * 300 + " z", "é\u00a0ü \u2003 q", "\u2581", " ", "word " * 80, "a \u0301b ﬁ ½ \ud7ff", "same same same", "a b\u0085 c"]


@pytest.fixture(scope="module")
def tools():
    a, b = tokenizer_paths()
    plain = Tokenizer.from_file(a)
    plain.encode_special_tokens = True
    return plain, sentencepiece.SentencePieceProcessor(model_file=b), Aligner(a, b)


def encoded(tools, text):
    """(ids, ends) of both, or none."""
    plain, piece, aligner = tools
    data, out = (" " + text).encode(), []
    for w, ids in enumerate((plain.encode(" " + text, add_special_tokens=False).ids, piece.encode(text))):
        if not text or b"".join(aligner.bytes[w][i] for i in ids) != data:
            return None
        out.append((ids, np.cumsum([len(aligner.bytes[w][i]) for i in ids]).tolist()))
    return out


def plain_rows(tools, rows):
    docs, count = [], Counter()
    for i, t in rows:
        found, groups = encoded(tools, t or ""), []
        if found:
            (a, ea), (b, eb) = found
            x = y = 0
            for end in sorted(set(ea) & set(eb)):
                u, v = ea.index(end) + 1, eb.index(end) + 1
                groups.append((a[x:u], b[y:v]))
                x, y = u, v
        links = Counter((p, q) for g in groups for p in g[0] for q in g[1])
        count.update(links.keys())
        docs.append((i, len(found[0][0]) if found else 0, len(found[1][0]) if found else 0, groups, links))
    best = {}
    for (p, _), n in count.items():
        best[p] = max(best.get(p, 0), n)
    show = lambda g: hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g).encode()).hexdigest() if g else ""
    return [(i, n, m, len(g), sum(k.values()), sum(c for p, c in k.items() if count[p] == best[p[0]]), sum(c * count[p] for p, c in k.items()), show(g)) for i, n, m, g, k in docs]


@pytest.mark.parametrize("size,block", [(48, 500), (700, 3000), (65_536, 4_000_000)])
def test_against_whole_texts(spark, tools, size, block):
    rows = [r for r in documents() if len(r[1] or "") < 20_000] + [(100 + k, t) for k, t in enumerate(ODD)] + [(200 + k, passage(k, 300)) for k in range(2)] + [(300, passage(1, 300))]
    got = align_tokens(frame(spark, rows), range_bytes=size, block_bytes=block).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain_rows(tools, rows)))


def test_no_documents(spark):
    assert align_tokens(frame(spark, documents()).limit(0)).count() == 0


def test_pieces_equal_whole_texts(tools):
    texts = ODD + [passage(k, 60) for k in range(4)]
    (a, b), (n_a, n_b), good = tools[2].encode(texts)
    at = [np.concatenate([[0], np.cumsum(n)]) for n in (n_a, n_b)]
    for k, t in enumerate(texts):
        found = encoded(tools, t)
        assert bool(good[k]) == (found is not None)
        if found:
            assert a[at[0][k]:at[0][k + 1]].tolist() == list(found[0][0]) and b[at[1][k]:at[1][k + 1]].tolist() == list(found[1][0])


@given(st.lists(st.sampled_from(["a", "b c", " ", "  ", "\n", "é", "\u3000", "word and word", "x" * 30, "\x85"]), max_size=40), st.integers(4, 60))
@settings(max_examples=100, deadline=None)
def test_ranges_cover_a_text_once(parts, size):
    data = (" " + "".join(parts)).encode()
    got = ranges(data, size)
    assert [lo for lo, *_ in got] == [0, *(hi for _, hi, *_ in got[:-1])] and got[-1][1] == len(data)
    assert all(x <= lo and y >= hi and (x == 0 or data[x:x + 1] == b" ") for lo, hi, x, y in got)


@given(st.lists(st.integers(1, 4), min_size=1, max_size=30), st.lists(st.integers(1, 4), min_size=1, max_size=30), st.lists(st.integers(1, 60), max_size=5), st.randoms())
@settings(max_examples=150, deadline=None)
def test_composition_in_any_order(a, b, cuts, rng):
    ea, eb = np.cumsum(a), np.cumsum(b)
    end = max(ea[-1], eb[-1])
    ea, eb = np.append(ea[ea < end], end), np.append(eb[eb < end], end)
    ids = lambda e: np.arange(len(e)) + 100
    edges, parts, closed = sorted({0, *(c for c in cuts if c < end), int(end)}), [], []
    show = lambda g: [(g.a[g.of_a == k].tolist(), g.b[g.of_b == k].tolist()) for k in range(g.n)]
    for k, (lo, hi) in enumerate(zip(edges, edges[1:])):
        x, y = (ea > lo) & (ea <= hi), (eb > lo) & (eb <= hi)
        f, groups = fragment(k, ids(ea)[x], ea[x], ids(eb)[y], eb[y])
        parts.append(f)
        closed += show(groups)
    while len(parts) > 1:
        k = rng.randrange(len(parts) - 1)
        one, middle = parts[k].compose(parts[k + 1])
        parts[k:k + 2] = [one]
        closed += [(middle[1].tolist(), middle[2].tolist())] if middle else []
    closed.append((parts[0].ends[0].tolist(), parts[0].ends[1].tolist()))
    assert parts[0].cut and not len(parts[0].ends[2]) and not len(parts[0].ends[3])
    assert sorted(closed) == sorted(show(Groups(ids(ea), ea, ids(eb), eb, np.intersect1d(ea, eb))))
    assert isinstance(parts[0], Fragment)


def test_large_groups_count_equal_ids_first():
    a, b = np.arange(300) % 7, np.arange(200) % 5
    g = Groups(a, np.ones(300, int), b, np.ones(200, int), np.ones(1, int))
    _, codes, times = g.pairs(10)
    assert len(codes) == 35 and times.sum() == 60_000 == g.links[0]
    assert dict(zip(codes.tolist(), times.tolist())) == Counter(int(x) * 10 + int(y) for x in a for y in b)
