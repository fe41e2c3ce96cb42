"""Registered queries against their SQL, and each stage of the pipeline against a plain version."""

import pytest
from corpus_fixture import components, documents, frame, hits, ITEMS, passage
from oracle import compare, connect
from pyspark.sql import functions as F

import corpus_pipeline as P
from paysieve.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), connect(SF), ORACLES[name]) is None


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14)) and len(P.STAGES) == 5


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    """Documents of a small test set with the awkward ones, and what each stage makes of them."""
    base = tmp_path_factory.mktemp("stages")
    odd = frame(spark, [(i if i is None else i + 100_000, t) for i, t in documents()])
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.read.parquet(f"{SF}/documents.parquet"))
    items = spark.createDataFrame(ITEMS, "item_id long, text string").unionByName(spark.read.parquet(f"{SF}/benchmark.parquet"))
    items.write.parquet(f"{base}/sf/benchmark.parquet")
    docs.write.parquet(f"{base}/sf/documents.parquet")
    seen = [spark.read.parquet(f"{base}/sf/documents.parquet")]
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, seen[-1], f"{base}/sf").write.parquet(f"{base}/{k}")
        seen.append(spark.read.parquet(f"{base}/{k}"))
    return f"{base}/sf", seen


def test_stages_return_documents(staged):
    _, seen = staged
    assert all(d.columns == seen[0].columns for d in seen[1:5])


def test_language_rejects_texts_without_letters(staged):
    _, seen = staged
    before, after = ([(r.doc_id, r.text) for r in d.collect()] for d in seen[:2])
    gone = set(map(repr, before)) - set(map(repr, after))
    assert {repr((100_007, None)), repr((100_008, "")), repr((100_023, "!!! ... ???"))} <= gone
    assert sum(r[0] is not None and r[0] < 100_000 for r in before) == sum(r[0] is not None and r[0] < 100_000 for r in after)


def test_exact_copies_go(staged):
    _, seen = staged
    low = lambda d: [((r.text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), r.doc_id) for r in d.collect()]
    best = {}
    for t, i in low(seen[1]):
        best[t] = max(best.get(t, -1), -1 if i is None else i)
    assert sorted(low(seen[2])) == sorted((t, i if i >= 0 else None) for t, i in best.items())


def test_near_copies_go(staged):
    _, seen = staged
    rows = [(r.doc_id, r.text) for r in seen[2].collect()]
    want = {i for i, _, c in components(rows, P.SHINGLE, P.PERCENT) if i == c}
    assert {r.doc_id for r in seen[3].collect()} == want


def test_near_copies_by_row(spark):
    """A verdict is of a row: null ids and repeated ids share none, and of each class exactly one row stays."""
    def pair(start):
        text = passage(start, 40)
        return text, text + " end"

    (a, a1), (b, b1), (c, c1), clean, other = pair(3), pair(21), pair(40), passage(60, 40), passage(75, 40)
    rows = [(1, a), (None, a1), (None, clean),                      # (a) a null id that copies, beside a clean one
            (5, a + " more"), (5, other),                           # (b) an id with a copy and another text
            (7, b), (7, b1), (None, c), (None, c1),                 # (c) classes under one id, and without any
            (9, "quite short"), (9, "quite short"), (None, None), (None, "")]
    got = [(r.doc_id, r.text) for r in P.near_copies(spark, frame(spark, rows), SF).collect()]
    free = {7: {b, b1}, None: {c, c1}}                               # either of the two, but one
    for i, texts in free.items():
        assert sum(j == i and t in texts for j, t in got) == 1
    rest = [r for r in got if r[1] not in free.get(r[0], ())]
    assert sorted(map(repr, rest)) == sorted(map(repr, [(1, a), (None, clean), (5, other), (9, "quite short"), (None, None), (None, "")]))


def test_passages_go(staged):
    sf, seen = staged
    items = [(r.item_id, r.text) for r in seen[0].sparkSession.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in seen[3].collect()]
    after = {r.doc_id: r for r in seen[4].collect()}
    found = hits(rows, items)
    assert set(after) == {i for i, n, h, _ in found if h <= P.MOST_COVERED * n}
    for (i, t), (_, _, h, _) in zip(rows, found):
        if i in after:
            assert (after[i].text == t) == (h == 0) and (h == 0 or after[i].n_chars == len(after[i].text))
    assert sum(h > 0 for _, _, h, _ in found) > 3


def test_last_stage_packs_all(staged):
    _, seen = staged
    assert {r.doc_id for r in seen[5].select("doc_id").collect()} == {r.doc_id for r in seen[4].select("doc_id").collect()}
    assert seen[5].groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 4096").count() == 0


def test_run_equals_its_stages(spark, staged):
    sf, seen = staged
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = P.run(spark, sf).select(*cols)
    assert got.exceptAll(seen[5].select(*cols)).count() == 0 and got.count() == seen[5].count()


def test_pipeline_over_no_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
