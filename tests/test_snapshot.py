"""The parallel reader of exported snapshots, against the whole document parsed at once."""

import json
import random

import pytest

from paysieve.plans.screen import screen, update_ledgers
from paysieve.sources.snapshot import SNAPSHOT, load_snapshot, snapshot_ledgers

NASTY = ['a,b', 'say "hi", {x}', '[1,2', '}},{', 'tail\\', '\\",', 'ünï, cödé', '', 'line\nbreak,  ', '"pins":{"q":1},']


def document(seed, n):
    rng = random.Random(seed)
    text, iso = lambda: rng.choice(NASTY) + str(rng.randrange(1000)), lambda: f"2024-01-{rng.randrange(1, 29):02d}T00:00:00Z"
    key = lambda k: f"{rng.choice(NASTY)}{k}"
    return {
        "version, \"one\"": text(), "note": 'x, "reports": [', "extra": {"a": [1, {"b": ["c, d", {}]}], "e": {}},
        "nonces": {key(k): {"first_seen": iso(), "times_seen": k, "scan_id": text()} for k in range(n)},
        "reports": [{"address": f"0x{k}", "category": "scam", "reason": text(), "reporter_agent_id": text(), "evidence_url": None, "reported_at": iso()} for k in range(n)],
        "disputes": {}, "uptime_ranges": [], "other": [[], [[1, 2], {}], "reports"],
        "outcomes": {key(k): {"delivered": k, "reporters": [text() for _ in range(k % 4)], "first_at": iso()} for k in range(n)},
        "counterparties": {key(k): [text() for _ in range(k % 5)] for k in range(n)},
        "velocity": {key(k): [{"t": j, "usd": j / 4} for j in range(k % 3)] for k in range(n)},
        "cumulative_spend": {f"agent|{k}|0x{k}": {"usd": k / 8, "scans": k, "first_at": iso(), "last_at": iso()} for k in range(n)},
        "pins": {key(k): {"pay_to": text(), "first_seen": iso(), "times_seen": 1, "cdp_status": "verified", "unknown": {"x": [1, 2]}} for k in range(n)}}


def plain(doc, name):
    """Rows of one member as ``load_snapshot`` gives them, in the order of ``row``."""
    kind, m = SNAPSHOT[name], doc.get(name)
    if kind.startswith("array"):
        return [{"pos": i, **e} for i, e in enumerate(m or [])]
    if kind.startswith("map<string,array<struct"):
        return [{"key": k, "pos": i, **e} for k, l in (m or {}).items() for i, e in enumerate(l)]
    if kind.startswith("map<string,array"):
        return [{"key": k, "pos": i, "value": e} for k, l in (m or {}).items() for i, e in enumerate(l)]
    return [{"pos": i, "key": k, **e} for i, (k, e) in enumerate((m or {}).items())]


def same(df, want):
    cols = df.columns
    got = sorted(json.dumps(r.asDict(True), sort_keys=True) for r in df.collect())
    return got == sorted(json.dumps({c: w.get(c) for c in cols}, sort_keys=True) for w in want)


@pytest.fixture
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", n)
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("size,indent", [(211, None), (1999, 2)])
def test_snapshot_in_splits_of_any_size(spark, tmp_path, small_splits, size, indent):
    doc = document(size, 7 if indent is None else 25)
    (tmp_path / "s.json").write_text(json.dumps(doc, indent=indent, ensure_ascii=indent is None))
    small_splits(size)
    tables = load_snapshot(spark, str(tmp_path / "s.json"))
    assert set(tables) == set(SNAPSHOT)
    for name in ("nonces", "reports", "disputes", "outcomes", "counterparties", "velocity", "pins"):
        assert same(tables[name], plain(doc, name)), name


def test_snapshot_that_does_not_close_or_is_empty(spark, tmp_path):
    whole = json.dumps(document(1, 5))
    for k, text in enumerate((whole[:-2], "", "{}", '{"pins":{"a":"')):
        (tmp_path / f"{k}.json").write_text(text)
        assert all(t.isEmpty() for t in (lambda d: (d["pins"], d["nonces"], d["reports"]))(load_snapshot(spark, str(tmp_path / f"{k}.json"))))


def test_snapshot_as_history(spark, tmp_path):
    """A payee pinned and a nonce spent in the exported history count in the next screening."""
    t0 = 1_706_745_600_000
    doc = {"pins": {"shop.example": {"pay_to": "0x" + "1" * 40, "first_seen": "2024-01-01T00:00:00Z", "times_seen": 1}},
           "counterparties": {"ag": ["0x" + "1" * 40]}, "velocity": {"ag": [{"t": t0 - 1000, "usd": 1.0}]},
           "cumulative_spend": {"ag|0x" + "1" * 40: {"usd": 2.0, "scans": 1, "first_at": "2024-01-01T00:00:00Z", "last_at": "2024-01-01T00:00:00Z"}},
           "nonces": {"eip155:8453:0xp:n1": {"first_seen": "2024-01-31T23:59:00Z", "times_seen": 1, "scan_id": "old"}},
           "reports": [{"address": "0x" + "2" * 40, "category": "scam", "reporter_agent_id": "r", "reported_at": "2024-01-02T00:00:00Z"}]}
    (tmp_path / "s.json").write_text(json.dumps(doc))
    led = snapshot_ledgers(load_snapshot(spark, str(tmp_path / "s.json")))
    assert [tuple(r) for r in led.spend.select("agent_key", "pay_to_lc", "usd").collect()] == [("ag", "0x" + "1" * 40, 2.0)]
    d = spark.createDataFrame([(1, "s1", t0, "outgoing", "ag", "eip155:8453", "0xp", "n1", "0x" + "2" * 40, "https://shop.example/x", 1.0)],
                              "seq long, scan_id string, ms long, direction string, agent_id string, network string, payer string, nonce string, pay_to string, "
                              "resource_url string, amount_usd double")
    got = screen(d, led)
    fired = set(got.decisions.collect()[0].fired)
    assert any(f.startswith("replay.") for f in fired), fired
    assert any(f.startswith(("pin.", "trust.", "poison.")) for f in fired) or len(fired) > 1, fired
    after = update_ledgers(got, led)
    assert after.pins.count() == 1 and {r.nonce_key for r in after.nonces.collect()} == {"eip155:8453:0xp:n1"}
