"""Streaming operators run over the test tables in several micro-batches, compared with the batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import Workspace
from ..sources.streams import stream_payments, with_event_time, write_stream
from ..streaming import stateful as ST
from .history_queries import _OBS, clocked, pay
from .fixtures import view
from .registry import ORACLES, query


def _stream(spark, slices, schema, operator, files: int):
    """Feed ``slices`` as micro-batches of ``files`` files through ``operator`` and read what it wrote."""
    ws = Workspace(spark)
    ST.rocksdb(spark)
    for d in slices:
        (d.coalesce(1) if files == 1 else d.repartition(files)).write.mode("append").parquet(ws.path + "/in")
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(ws.path + "/in")
    out = operator(with_event_time(src))
    q = (out.writeStream.format("parquet").option("checkpointLocation", ws.path + "/ckpt").outputMode("append")
         .trigger(availableNow=True).start(ws.path + "/out"))
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(ws.path + "/out")


def _in_order(spark, df, operator, parts: int = 3, files: int = 4, mark: dict | None = None):
    """``df`` in ``parts`` micro-batches through ``operator``: the time line is cut at its quantiles, one slice after another.

    With ``mark`` a last slice only carries time, a week after all rows; its columns are as ``mark`` says.
    """
    cuts = df.stat.approxQuantile("ms", [i / parts for i in range(1, parts)], 0.001)
    lows, highs, slices = [None, *cuts], [*cuts, None], []
    for lo, hi in zip(lows, highs):
        d = df
        d = d if lo is None else d.filter(F.col("ms") > lo)
        slices.append(d if hi is None else d.filter(F.col("ms") <= hi))
    if mark is not None:
        slices.append(ST.time_mark(df, df.agg(F.max("ms")).first()[0] + 7 * 24 * ST.HOUR, **mark))
    return _stream(spark, slices, df.schema, operator, files)


@query("str_1_replay", ORACLES["win_1_replay_ttl"])
def str_1(spark, sf):
    d = pay(spark, sf).select("seq", "ms", "nonce_key")
    return _in_order(spark, d, lambda s: ST.on_time(ST.stream_replay(s, 24)), mark={}).select("seq", "nonce_first_ms", (F.col("nonce_seen") > 1).alias("reused"))


@query("str_2_velocity", ORACLES["win_2_scans_per_minute"])
def str_2(spark, sf):
    d = clocked(spark, sf).select("seq", "ms", "agent_key", "direction", "usd")
    return _in_order(spark, d, lambda s: ST.on_time(ST.stream_velocity(s)), mark={"direction": "outgoing"}).select("seq", "per_minute")


@query("str_3_pins", ORACLES["det_20_pins"])
def str_3(spark, sf):
    d = pay(spark, sf).select("seq", "ms", "domain", "pay_to", F.lit("payment").alias("kind"))
    return _in_order(spark, d, lambda s: ST.on_time(ST.stream_pins(s)), mark={}).select("seq", "check_id")


@query("str_4_spend", ORACLES["win_4_prior_spend"])
def str_4(spark, sf):
    d = pay(spark, sf).select("seq", "ms", "agent_key", "pay_to", "usd")
    return _in_order(spark, d, lambda s: ST.on_time(ST.stream_spend(s)), mark={}).select("seq", F.round("prior_usd", 6).alias("prior_usd"))


@query("str_6_provenance", ORACLES["join_16_provenance"])
def str_6(spark, sf):
    p = clocked(spark, sf).filter("agent_key is not null")
    d = p.select("seq", "ms", "agent_key", F.expr(f"CASE WHEN event_type = 'click' THEN {_OBS} ELSE 'payment' END").alias("kind"))
    return _in_order(spark, d, lambda s: ST.on_time(ST.stream_provenance(s, 1000)), mark={}).select("seq", "origin")


@query("str_7_uptime", ORACLES["win_8_uptime_ranges"])
def str_7(spark, sf):
    d = view(spark, sf, "beats").select(F.col("user_id").alias("seq"), F.col("at_ms").alias("ms"), "user_id", F.lit("beat").alias("kind"))
    return _in_order(spark, d, lambda x: ST.on_time(ST.stream_uptime(x, 7200, "1 hour", ("user_id",))), mark={"user_id": -1})


_DELAY, _PARTS = 600_000, 6
_ARRIVAL = f"m + CASE WHEN seq % 11 = 0 THEN {5 * _DELAY} ELSE seq * 7919 % {_DELAY} END"


# rows arrive out of order, one in eleven long after its time; what the watermark has passed by then is late and counts for nobody
@query("str_10_late", f"""WITH o AS (SELECT seq, agent_key, m, {_ARRIVAL} AS arrival FROM payments WHERE direction = 'outgoing' AND agent_key IS NOT NULL),
p AS (SELECT o.*, (arrival - lo) * {_PARTS} // (hi - lo + 1) AS part FROM o, (SELECT min(arrival) AS lo, max(arrival) AS hi FROM o) e),
w AS (SELECT part, max(max(m)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {_DELAY} AS mark FROM p GROUP BY part),
j AS (SELECT p.*, coalesce(m < mark, false) AS late FROM p JOIN w USING (part))
SELECT seq, count(*) OVER (PARTITION BY agent_key ORDER BY m RANGE BETWEEN 59999 PRECEDING AND 1 PRECEDING)
  + row_number() OVER (PARTITION BY agent_key, m ORDER BY seq) AS per_minute, late FROM j WHERE NOT late
UNION ALL SELECT seq, NULL, late FROM j WHERE late""", "payments")
def str_10(spark, sf):
    """Velocity over rows that arrive out of order, and the rows that came too late for it."""
    d = clocked(spark, sf).filter("direction = 'outgoing' and agent_key is not null").select("seq", "ms", "agent_key", "direction", "usd", F.expr(_ARRIVAL).alias("arrival"))
    lo, hi = d.agg(F.min("arrival"), F.max("arrival")).first()
    part = F.expr(f"(arrival - {lo}L) * {_PARTS} div ({hi}L - {lo}L + 1)")
    rows = d.drop("arrival")
    slices = [d.filter(part == k).drop("arrival") for k in range(_PARTS)]
    slices.append(ST.time_mark(rows, hi + 7 * 24 * ST.HOUR, direction="outgoing"))
    return _stream(spark, slices, rows.schema, lambda s: ST.stream_velocity(s, f"{_DELAY} milliseconds"), 1).select("seq", "per_minute", "late")


@query("str_9_rate_limit", ORACLES["win_9_rate_limit"])
def str_9(spark, sf):
    d = clocked(spark, sf).filter("agent_key is not null").select("seq", "ms", "agent_key")
    return _in_order(spark, d, lambda s: ST.on_time(ST.stream_rate_limit(s, "agent_key", 5, 600_000)), mark={}).select("seq", "allowed")


# an approval nobody decides expires once the stream's time has passed its end
@query("str_5_approvals", """WITH w AS (SELECT max(created_ms + CASE WHEN status = 'pending' THEN 0 ELSE latency_ms END) AS now_ms FROM approvals),
s AS (SELECT 'pending' AS status FROM approvals UNION ALL SELECT status FROM approvals WHERE status <> 'pending'
  UNION ALL SELECT 'expired' FROM approvals, w WHERE status = 'pending' AND expires_ms < now_ms)
SELECT status, count(*) AS n FROM s GROUP BY status""", "approvals")
def str_5(spark, sf):
    a = view(spark, sf, "approvals")
    opened = a.select("approval_id", F.col("created_ms").alias("ms"), (F.col("seq") * 2).alias("seq"), F.lit("open").alias("kind"), "expires_ms")
    said = a.filter("status <> 'pending'").select("approval_id", (F.col("created_ms") + F.col("latency_ms")).alias("ms"), (F.col("seq") * 2 + 1).alias("seq"),
                                                  F.when(F.col("status") == "approved", "approve").otherwise("deny").alias("kind"), "expires_ms")
    return _in_order(spark, opened.unionByName(said), ST.stream_approvals).groupBy("status").agg(F.count("*").alias("n"))


@query("src_11_stream_payments", "SELECT seq, ms, direction, pay_to, nonce, amount_usd, ms AS event_ms FROM payments", "payments")
def src_11(spark, sf):
    """Payments arriving as JSON files, a few at a time, and what the sink holds of them."""
    ws = Workspace(spark)
    view(spark, sf, "payments").select("seq", "ms", "direction", "pay_to", "nonce", "amount_usd").repartition(6).write.json(ws.path + "/in")
    got = stream_payments(spark, ws.path + "/in", max_files=2)
    write_stream(got, ws.path + "/out", ws.path + "/ckpt").awaitTermination()
    out = spark.read.schema(got.schema).parquet(ws.path + "/out")
    return out.select("seq", "ms", "direction", "pay_to", "nonce", "amount_usd", F.unix_millis("ts").alias("event_ms"))
