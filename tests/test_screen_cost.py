"""What a screening computes per row and what it leaves on disk."""

import os

from pyspark.sql import functions as F

from paysieve import screen, update_ledgers
from paysieve.functions import patterns as P, text as X
from paysieve.operators import rowlocal as R
from paysieve.operators.checks import fold_verdict, in_order
from paysieve.schemas import CHECKS, PAYMENTS
from paysieve.session import Workspace
from test_screen_model import CFG, frame, histories


def _plan(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_offer_terms_read_each_leg_once(spark):
    d = R.with_offer_terms(spark.createDataFrame([("{}",)], "offer string"))
    assert _plan(d).count("variant_get") < 60


def test_payment_texts_are_searched_once(spark):
    d = frame(spark, []).select(R.payment_pii().alias("c"))
    assert _plan(d).count(P.SEED_PHRASE) == 1


def test_offer_terms_of_odd_offers(spark):
    offers = ['{"accepts":[{"payTo":null,"pay_to":"0xA","price":"$1,000.5"}]}', '[{"payee":"b","amount":"0x10","asset_decimals":null,"extra":{"decimals":"1"}},7]',
              '{"accepts":[],"items":[[]],"recipient":"c"}', '{"accepts":"x","offers":{},"recipient":"C","priceUsd":2}', "7", "null", "no json", "", None]
    d = R.with_offer_terms(spark.createDataFrame([(i, o) for i, o in enumerate(offers)], "i int, offer string"))
    got = {r.i: None if r.legs is None else [(t.pay_to, t.usd) for t in r.legs] for r in d.select("i", "legs").collect()}
    assert got == {0: [("0xa", 1000.5)], 1: [("b", 1.6)], 2: [(None, None)], 3: [("c", 2.0)], 4: None, 5: None, 6: None, 7: None, 8: None}


def test_base64_runs_equal_the_plain_patterns(spark):
    import random
    rnd = random.Random(5)
    pieces = ["A" * 11, "b" * 12, "c-_/" * 6, "d" * 24, "e" * 50, "=", "==", "===", "\n", "\r\n", " \n\t", " ", "\t", "\r", ".", "x"]
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randrange(1, 14))) for _ in range(3000)]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.regexp_extract_all(F.regexp_replace("t", P.BASE64_WRAP, "$1"), F.lit(P.BASE64_BLOB), F.lit(0))
    wrong = d.filter((plain != X.base64_blobs("t")) | (F.col("t").rlike(P.BASE64_RUN) != F.col("t").rlike(P.BASE64_LONG_RUN)))
    assert wrong.count() == 0


def test_short_secrets_pass_the_cheap_condition(spark):
    texts = ["123-45-6789", "4111 1111 1111 1111", "a@b.co", "555 123 4567", "(555)-123-4567", "AKIA" + "A" * 16, "sk-" + "a" * 20, "ghp_" + "a" * 20,
             "xoxb-" + "a" * 10, "eyJ" + "a" * 10 + "." + "b" * 10 + "." + "c" * 10, "?token=abcdef", "f" * 64, " ".join(["abc", "abd", "abe", "abf", "abg", "abh"] * 2)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", F.size(R.pii_hits("t")).alias("n")).collect()
    assert [r.i for r in got if r.n == 0] == [12]          # six distinct words of twelve are no seed phrase
    assert spark.range(1).select(F.size(R.pii_hits(F.lit(None).cast("string")))).first()[0] == 0


def test_findings_in_order_and_their_fold(spark):
    rows = [([(5, "b", "flag", "low"), (1, "a", "allow", "info"), (5, "a", "block", "odd")],), ([(2, "x", None, None)],), ([],), (None,)]
    d = spark.createDataFrame(rows, "c array<struct<ord:int,id:string,verdict:string,severity:string>>").select(
        F.transform("c", lambda x: F.struct(x["ord"].alias("ord"), x["id"].alias("id"), x["verdict"].alias("verdict"), x["severity"].alias("severity"),
                                            F.lit(None).cast("map<string,string>").alias("details"), F.lit(None).cast("string").alias("at"))).cast(CHECKS).alias("c"))
    d = d.withColumn("c", in_order(F.col("c"))).withColumns(fold_verdict(F.col("c")))
    got = [(r.ids, r.verdict, r.risk_score, r.fired) for r in d.select(F.col("c.id").alias("ids"), "verdict", "risk_score", "fired").collect()]
    assert got == [(["a", "b", "a"], "block", 20, ["a", "b"]), (["x"], "allow", 0, []), ([], "allow", 0, []), (None, "allow", None, None)]


def test_screening_leaves_only_what_its_result_reads(spark):
    ws = Workspace(spark)
    result = screen(frame(spark, histories(2, 30, 3)), cfg=CFG, workspace=ws)
    left = {n.split("-", 1)[1] for n in os.listdir(ws.path.removeprefix("file:"))}
    assert left == {"settled", "pins", "counterparties", "incidents", "findings"}
    led = update_ledgers(result)
    assert led.scan_index.count() == 60 and led.nonces.count() > 0
    assert {"payment_sha256", "agent_id"}.isdisjoint(result.rows.columns)
    assert set(PAYMENTS.fieldNames()) & {"pay_to", "network", "account_hash"} <= set(result.decisions.columns)
    ws.close()
