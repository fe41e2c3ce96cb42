"""Ledgers of a stream as runs that are appended and merged."""

import random

from paysieve.config import HOUR_MS, ScreenConfig
from paysieve.plans.screen import Ledgers, learned, merge_learned, screen, update_ledgers
from paysieve.sources.ledger_io import load_ledgers
from paysieve.streaming import screening as SC

SCHEMAS = {"nonces": "nonce_key string, ms long, scan_id string, weight long", "velocity_events": "agent_key string, ms long, usd double",
           "spend": "agent_key string, pay_to_lc string, usd double, scans long, first_ms long, last_ms long",
           "scan_counts": "pay_to string, scans long, first_ms long, last_ms long", "pins": "domain string, pay_to string, ms long, seq long",
           "counterparties": "agent_key string, pay_to string, ms long, seq long", "scan_index": "scan_id string, pay_to string, ms long"}
ADDRESS = ["0x" + c * 40 for c in "1234"]


def a_run(spark, seed):
    rng = random.Random(seed)
    keys, ms = lambda n: rng.sample(range(n), n // 2), lambda: rng.randrange(10 * HOUR_MS)
    rows = {"nonces": [(f"n{k}", ms(), f"s{seed}", seed + 1) for k in keys(12)],
            "velocity_events": [(f"a{rng.randrange(3)}", ms(), rng.randrange(8) / 4) for _ in range(9)],
            "spend": [(f"a{k}", ADDRESS[k % 4], k / 4, 1 + k, ms(), ms()) for k in keys(6)],
            "scan_counts": [(f"p{k}", 1 + k, ms(), ms()) for k in keys(6)],
            "pins": [(f"d{k}", rng.choice(ADDRESS), ms(), 100 * seed + k) for k in keys(8)],
            "counterparties": [(f"a{k}", ADDRESS[k % 4], ms(), 100 * seed + k) for k in keys(8)],
            "scan_index": [(f"s{seed}-{k}", ADDRESS[0], ms()) for k in keys(4)]}
    return {n: spark.createDataFrame(r, SCHEMAS[n]) for n, r in rows.items()}


def contents(tables):
    return {n: sorted(map(repr, (r.asDict() for r in d.select(*sorted(d.columns)).collect()))) for n, d in tables.items()}


def test_runs_merge_in_any_grouping(spark):
    runs, as_of = [a_run(spark, k) for k in range(5)], 10 * HOUR_MS
    cfg = ScreenConfig(nonce_ttl_hours=6)
    whole = contents(merge_learned(runs, cfg, as_of))
    left = merge_learned([merge_learned(runs[:2]), merge_learned(runs[2:4]), runs[4]], cfg, as_of)
    right = merge_learned([runs[0], merge_learned([merge_learned(runs[1:3]), merge_learned(runs[3:])])], cfg, as_of)
    assert contents(left) == whole and contents(right) == whole
    newest = {}
    for k, r in enumerate(runs):
        newest.update({x.nonce_key: (x.ms, x.weight) for x in r["nonces"].collect()})
    assert {k for k, (ms, _) in newest.items() if ms >= 4 * HOUR_MS} == {eval(x)["nonce_key"] for x in whole["nonces"]}


def payments(spark, lo, hi):
    rows = [(k, f"s{k}", 1_706_745_600_000 + 1000 * k, "outgoing", f"ag{k % 3}", "eip155:8453", "0xp", f"n{k % 7}", ADDRESS[k % 4],
             f"https://shop{k % 5}.example/x", 1.0) for k in range(lo, hi)]
    return spark.createDataFrame(rows, "seq long, scan_id string, ms long, direction string, agent_id string, network string, payer string, nonce string, "
                                       "pay_to string, resource_url string, amount_usd double")


def test_runs_equal_rewritten_ledgers(spark, tmp_path, monkeypatch):
    """After every batch the merged runs are the ledgers that one table rewritten each time would hold; a batch's own run does not grow."""
    monkeypatch.setattr(SC, "FANOUT", 2)
    cfg, led, root, first = ScreenConfig(), Ledgers(), str(tmp_path / "led"), []
    for b in range(3):
        d = payments(spark, 20 * b, 20 * b + 20)
        read = SC.current_ledgers(spark, root, b, cfg)
        result = screen(d, read, cfg)
        latest = 1_706_745_600_000 + 1000 * (20 * b + 19)
        new = learned(result, read)
        first.append({n: t.count() for n, t in new.items()})
        for _ in range(2 if b == 1 else 1):                         # the second batch is repeated, as after a failure
            SC._append_run(spark, root, b, new, cfg, latest)
        led = update_ledgers(result, led, cfg, as_of=latest)
        got, names = SC.current_ledgers(spark, root, None, cfg), sorted(new)
        assert contents({n: getattr(got, n) for n in names}) == contents({n: getattr(led, n).select(getattr(got, n).columns) for n in names})
    assert [r.level for r in SC._live_runs(spark, root)] == [1, 0]
    assert first[2]["scan_index"] == 20 and first[2]["pins"] <= first[0]["pins"] and first[2]["counterparties"] <= first[0]["counterparties"]
    before = contents(load_ledgers(spark, SC._live_runs(spark, root)[0].path))
    assert SC.vacuum_ledgers(spark, root, 2) >= 1
    assert contents(load_ledgers(spark, SC._live_runs(spark, root)[0].path)) == before
