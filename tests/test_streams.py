"""Streams whose rows arrive out of order and late, and what their state holds when time has passed."""

import random

import pytest

from paysieve.streaming import stateful as ST

DELAY = 100_000
MARK = 10**9


def feed(spark, path, batches, schema, operator):
    """Each batch is one file and one micro-batch; returns the rows that came out and the rows of state after each batch."""
    ST.rocksdb(spark)
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    out = operator(src)
    q = out.writeStream.format("parquet").option("checkpointLocation", f"{path}/ck").outputMode("append").trigger(availableNow=True).start(f"{path}/out")
    q.awaitTermination()
    state = [s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]]
    return [r.asDict() for r in spark.read.schema(out.schema).parquet(f"{path}/out").collect()], state


def split(batches, ms=1):
    """(accepted, late) rows: late is what the newest time of earlier batches, less the delay, has passed."""
    newest, good, late = None, [], []
    for rows in batches:
        for r in rows:
            (late if newest is not None and r[ms] < newest - DELAY else good).append(r)
        newest = max([r[ms] for r in rows] + ([] if newest is None else [newest]))
    return good, late


def shuffled(seed, n, make):
    rng = random.Random(seed)
    rows = [make(rng, k) for k in range(n)]
    rows.sort(key=lambda r: r[1] + rng.choice([0, 10_000, 60_000, 90_000, 5_000_000 if rng.random() < 0.1 else 0]))
    return [rows[k:k + n // 4] for k in range(0, n, n // 4)]


def test_velocity_out_of_order(spark, tmp_path):
    batches = shuffled(1, 240, lambda rng, k: (k, rng.randrange(9_000_000), rng.choice("ab"), "outgoing", rng.choice([None, 0.5, 2.0])))
    schema = "seq long, ms long, agent_key string, direction string, usd double"
    got, state = feed(spark, str(tmp_path), [*batches, [(None, MARK, "", "outgoing", None)]], schema, lambda s: ST.stream_velocity(s, f"{DELAY} milliseconds"))
    good, late = split(batches)
    assert late and {r["seq"] for r in got if r["late"]} == {r[0] for r in late}
    want = {}
    for seq, ms, key, _, _ in good:
        before = [r for r in good if r[2] == key and (r[1], r[0]) <= (ms, seq)]
        want[seq] = (sum(ms - r[1] < 60_000 for r in before), round(sum(r[4] or 0 for r in before if ms - r[1] < 3_600_000), 6))
    assert {r["seq"]: (r["per_minute"], round(r["hour_usd"], 6)) for r in got if not r["late"]} == want
    assert state[-1] == 0 and max(state) > 0                               # an hour after the last row nothing is kept


def test_late_row_in_the_second_of_three_batches(spark, tmp_path):
    batches = [[(1, 300_000, "a", "outgoing", 1.0)], [(2, 200_000 + 50_000, "a", "outgoing", 1.0)], [(3, 320_000, "a", "outgoing", 1.0)], [(None, MARK, "", "outgoing", None)]]
    got, _ = feed(spark, str(tmp_path), batches, "seq long, ms long, agent_key string, direction string, usd double", lambda s: ST.stream_velocity(s, f"{DELAY} milliseconds"))
    assert sorted((r["ms"] if "ms" in r else r["seq"], r["per_minute"]) for r in got) == [(1, 2), (2, 1), (3, 2)]     # 250 s, 300 s, 320 s


@pytest.mark.parametrize("ttl", [1])
def test_replay_forgets_a_nonce_after_its_time(spark, tmp_path, ttl):
    batches = shuffled(2, 120, lambda rng, k: (k, rng.randrange(12_000_000), rng.choice("nm")))
    got, state = feed(spark, str(tmp_path), [*batches, [(None, MARK, "")]], "seq long, ms long, nonce_key string", lambda s: ST.stream_replay(s, ttl, f"{DELAY} milliseconds"))
    good, late = split(batches)
    first, want = {}, {}
    for seq, ms, key in sorted(good, key=lambda r: (r[1], r[0])):
        if key not in first or ms - first[key][0] > ttl * ST.HOUR:
            first[key] = (ms, 0)
        first[key] = (first[key][0], first[key][1] + 1)
        want[seq] = (first[key][1], first[key][0])
    assert {r["seq"]: (r["nonce_seen"], r["nonce_first_ms"]) for r in got if not r["late"]} == want
    assert {r["seq"] for r in got if r["late"]} == {r[0] for r in late} and state[-1] == 0


def test_sessions_close_by_time_and_by_mark(spark, tmp_path):
    rows = [(1, 0, "a", "beat"), (2, 100_000, "a", "beat"), (3, 100_000, "a", "beat"), (4, 220_000, "a", "beat"), (5, 341_000, "a", "beat"), (6, 10_000, "b", "beat"), (7, 20_000, "b", "close"),
            (8, 30_000, "b", "beat")]
    got, state = feed(spark, str(tmp_path), [rows[:5], rows[5:], [(None, MARK, "", None)]], "seq long, ms long, service string, kind string", lambda s: ST.on_time(ST.stream_uptime(s, 120, "10 minutes")))
    assert sorted((r["service"], r["from_ms"], r["to_ms"], r["beats"]) for r in got) == [("a", 0, 220_000, 3), ("a", 341_000, 341_000, 1), ("b", 10_000, 10_000, 1), ("b", 30_000, 30_000, 1)]
    assert state[-1] == 0


def test_rate_limit_and_provenance_let_idle_keys_go(spark, tmp_path):
    hits = [[(k, 1000 * k, "a") for k in range(8)], [(None, MARK, "")]]
    got, state = feed(spark, f"{tmp_path}/r", hits, "seq long, ms long, agent string", lambda s: ST.stream_rate_limit(s, "agent", 3, 60_000))
    assert {r["seq"] for r in got if r["allowed"]} == {0, 1, 2} and state[-1] == 0
    events = [[(1, 1000, "a", "tool_result"), (3, 3000, "a", "payment"), (2, 2000, "a", "fetched_content"), (4, 4000, "a", "tool_result")], [(None, MARK, "", "")]]
    got, state = feed(spark, f"{tmp_path}/p", events, "seq long, ms long, agent_key string, kind string", lambda s: ST.stream_provenance(s, 5000))
    assert [(r["seq"], r["origin"], r["observation_seq"]) for r in got] == [(3, "fetched_content", 2)] and state[-1] == 0
