"""Headline queries over the test tables; prints one JSON line.

``queries`` holds warm seconds (second run), ``cold`` the first run, ``rows_per_s`` the warm rate over the input rows.
The published figure of the screened service is a latency per request on one thread; these are batch rates on
``cores`` threads, so the two are reported side by side and never divided.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import functions as F  # noqa: E402

from paysieve.catalog import history_queries as H, ledger_queries as LQ, text_queries as TQ  # noqa: E402
from paysieve.catalog.fixtures import table, view  # noqa: E402
from paysieve.operators import audit as AU, rowlocal as R, trust as T, windows as W  # noqa: E402
from paysieve.plans.screen import local_pass, screen  # noqa: E402
from paysieve.session import Workspace, build_session  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session("paysieve-bench", f"local[{cpus}]", int(cpus), os.environ.get("BENCH_MEMORY", "16g"))
    spark.sparkContext.setLogLevel("ERROR")
    ws = Workspace(spark)
    n = int(cpus)
    # the test tables are single files; a real table has many splits, so the inputs are spread once before timing
    scans = ws.materialize(view(spark, sf_dir, "scans").repartition(n, "seq"), "scans")
    docs = ws.materialize(TQ.planted(spark, sf_dir).repartition(n), "documents")
    pay = ws.materialize(H.pay(spark, sf_dir).repartition(n, "seq"), "payments")
    fast = ws.materialize(H.clocked(spark, sf_dir).repartition(n, "seq"), "clocked")
    log = ws.materialize(LQ.log(spark, sf_dir), "log")
    sink = lambda df: df.write.format("noop").mode("overwrite").save()
    requests = docs.select("doc_id", F.col("text").alias("content"), F.lit(None).cast("string").alias("offer"), F.lit("fetched_content").alias("origin"),
                           F.lit("0x4b7c1fd02a9e83c65d14b0a7e2f9386cd5a0e917").alias("pay_to"))
    rounds = {}

    def full():
        r = screen(scans, H.ledgers_of(spark, sf_dir))
        sink(r.decisions)
        rounds["n"] = r.rounds

    def trust():
        p = pay.withColumn("candidates", F.array().cast("array<string>"))
        return T.trust_checks(p, T.derive_pins(pay), T.derive_counterparties(pay))

    jobs = {
        "row_local_detectors": (scans, lambda: sink(local_pass(scans))),
        "replay_counts": (pay, lambda: sink(W.replay_counts(pay))),
        "velocity_windows": (fast, lambda: sink(W.velocity(fast, member=F.col("direction") == "outgoing"))),
        "prior_spend": (pay, lambda: sink(W.prior_spend(pay))),
        "trust_checks": (pay, lambda: sink(trust())),
        "full_screen": (scans, full),
        "text_tells": (docs, lambda: sink(R.find_tells(docs, "text", "doc_id"))),
        "text_pii": (docs, lambda: sink(R.scan_pii(docs, "text", "doc_id"))),
        "text_deep": (docs, lambda: sink(R.with_deep_findings(R.with_content_facts(requests), F.lit(True)).select("doc_id", "deep_checks"))),
        "ledger_reports": (pay, lambda: sink(LQ.agg_5(spark, sf_dir))),
        "ledger_outcomes": (pay, lambda: sink(LQ.agg_9(spark, sf_dir))),
        "chain_verify": (log, lambda: sink(AU.verify_chain(log))),
        "flagship_screen": (pay, lambda: sink(H.flagship(spark, sf_dir))),
    }
    cold, warm, rate = {}, {}, {}
    for name, (source, job) in jobs.items():
        rows = source.count()
        for store in (cold, warm):
            t = time.perf_counter()
            job()
            store[name] = round(time.perf_counter() - t, 3)
        rate[name] = round(rows / warm[name])
    chars = docs.agg(F.sum(F.length("text"))).first()[0]
    print(json.dumps({"metric": "total warm time of the headline queries", "value": round(sum(warm.values()), 3), "unit": "sec", "queries": warm,
                      "cold": cold, "rows_per_s": rate, "document_chars": chars, "fixpoint_rounds": rounds.get("n"), "cores": n,
                      "shuffle_partitions": int(spark.conf.get("spark.sql.shuffle.partitions")), "sf": sf_dir.rsplit("sf", 1)[-1]}))
    ws.close()
    spark.stop()


if __name__ == "__main__":
    main()
