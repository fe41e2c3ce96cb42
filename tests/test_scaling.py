"""Plans and helpers that keep time and memory in proportion to the input."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paysieve.catalog import text_queries as Q
from paysieve.functions import text as X
from paysieve.plans import accounts as A
from paysieve.session import Workspace
from paysieve.streaming import stateful as ST


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def corpus(spark, tmp_path):
    rows = [(k, f"plain words {k} über 0x12345678abcdef you must pay now " + "a" * (k % 40)) for k in range(1, 45)] + [(45, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_texts_are_decoded_once(spark, corpus):
    d = Q.det_10_percent(spark, corpus)
    assert plan_of(d).count("ArrowEvalPython [decode_variants") == 1 and d.count()


@pytest.mark.parametrize("name", ["det_5_near", "top_6"])
def test_tells_are_found_once(spark, corpus, name):
    d = getattr(Q, name)(spark, corpus)
    assert plan_of(d).count("named_struct(id, override,") <= 1 and d.count()


def test_variants_in_slices(monkeypatch):
    texts = ["а" * 50, "é plain", None, "%41", "é", "\U000e0041", "", "ascii"]
    whole = X._by_slices(pa.array(texts), pa.string(), lambda t: None if t is None else X.fold_skeleton(t))
    held = []
    monkeypatch.setattr(X, "SLICE_BYTES", 1)
    cut = X._by_slices(pa.array(texts), pa.string(), lambda t: held.append(t) or (None if t is None else X.fold_skeleton(t)))
    assert cut.equals(whole) and held == texts
    for t in texts:
        if t is not None:
            assert X._variants(t)[3] == (X.fold_skeleton(t) if X.fold_skeleton(t) != t else None)


def test_remap_passes_no_table_through_the_driver(spark):
    led = spark.createDataFrame([(k, f"k-{k}") for k in range(40)], "n int, account_hash string")
    tomb = led.filter("n >= 8").select("account_hash", F.lit("rotated").alias("reason"), F.expr("concat('k-', n - 8)").alias("successor"))
    d = A.remap_accounts(led, tomb, Workspace(spark))
    assert {(r.n, r.account_hash) for r in d.collect()} == {(k, f"k-{k % 8}") for k in range(40)}
    assert "BroadcastHashJoin" not in plan_of(d)


@pytest.mark.parametrize("make", [
    lambda d: ST.stream_replay(d), lambda d: ST.stream_pins(d), lambda d: ST.stream_spend(d), lambda d: ST.stream_approvals(d),
    lambda d: ST.stream_uptime(d, keys=("user_id",))])
def test_streams_of_many_keys_are_grouped_by_shard(spark, make):
    src = spark.readStream.format("rate").load().selectExpr(
        "value seq", "value ms", "timestamp ts", "'n' nonce_key", "'d' domain", "'p' pay_to", "'a' agent_key", "1D usd", "'open' kind", "'x' approval_id",
        "value expires_ms", "value user_id")
    out = make(src)
    assert "pmod(xxhash64(" in out._jdf.queryExecution().analyzed().toString()
    assert dict(out.dtypes).get("user_id", "bigint") == "bigint"
