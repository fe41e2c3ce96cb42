"""Queries over ordered history: replay, velocity, spend, pins, look-alikes, provenance, policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DAY_MS, HOUR_MS, ScreenConfig
from ..operators import policy as PO, trust as T, windows as W
from ..plans import accounts as A
from ..plans.screen import Ledgers, pin_findings, replay_finding, screen, update_ledgers, velocity_findings
from ..session import Workspace
from .fixtures import AS_OF, view
from .registry import query


def pay(spark, sf):
    """Payments with the internal column names; every row counts as teaching."""
    d = view(spark, sf, "payments")
    return d.withColumns({"pay_to_lc": F.lower("pay_to"), "usd": F.col("amount_usd"), "agent_id": F.col("agent_key"), "nonce_key": F.col("nonce")})


def clocked(spark, sf):
    """The same with the clock running a thousand times faster, so that minutes and hours fill up."""
    return pay(spark, sf).withColumn("ms", F.col("m"))


_ORD = "ORDER BY ms, seq"
_SEEN = f"row_number() OVER (PARTITION BY nonce {_ORD})"


@query("win_1_replay_counts", f"""SELECT seq, {_SEEN} AS nonce_seen, min(ms) OVER (PARTITION BY nonce) AS nonce_first_ms,
  first_value(scan_id) OVER (PARTITION BY nonce {_ORD}) AS nonce_first_scan FROM payments""", "payments")
def win_1(spark, sf):
    return W.replay_counts(pay(spark, sf)).select("seq", "nonce_seen", "nonce_first_ms", "nonce_first_scan")


_TTL = 24 * HOUR_MS


@query("win_1_replay_ttl", f"""WITH RECURSIVE k AS (SELECT seq, nonce, ms FROM payments), a AS (SELECT nonce, min(ms) AS ms FROM k GROUP BY nonce
  UNION ALL SELECT a.nonce, min(k.ms) AS ms FROM a JOIN k ON k.nonce = a.nonce AND k.ms > a.ms + {_TTL} GROUP BY a.nonce)
SELECT k.seq, max(a.ms) AS nonce_first_ms, max(a.ms) < k.ms AS reused FROM k JOIN a ON a.nonce = k.nonce AND a.ms <= k.ms GROUP BY k.seq, k.ms""", "payments")
def win_1_ttl(spark, sf):
    d = W.replay_counts(pay(spark, sf), ttl_hours=24, workspace=Workspace(spark))
    return d.select("seq", "nonce_first_ms", (F.col("nonce_seen") > 1).alias("reused"))


@query("det_2_replay", f"SELECT seq, CASE WHEN nonce IS NULL THEN 'replay.no_nonce' WHEN {_SEEN} > 1 THEN 'replay.nonce_reuse' ELSE 'replay.clean' END AS check_id FROM "
                       "(SELECT seq, ms, CASE WHEN seq % 19 = 0 THEN NULL ELSE nonce END AS nonce FROM payments)", "payments")
def det_2(spark, sf):
    d = pay(spark, sf).withColumn("nonce_key", F.when(F.col("seq") % 19 != 0, F.col("nonce"))).withColumn("phase", F.lit(None).cast("string"))
    return W.replay_counts(d).select("seq", F.explode(replay_finding()).alias("c")).select("seq", F.col("c.id").alias("check_id"))


_MEMBER = "direction = 'outgoing' AND agent_key IS NOT NULL"


@query("win_2_scans_per_minute", f"""WITH o AS (SELECT seq, agent_key, m FROM payments WHERE {_MEMBER})
SELECT seq, count(*) OVER (PARTITION BY agent_key ORDER BY m RANGE BETWEEN 59999 PRECEDING AND 1 PRECEDING)
  + row_number() OVER (PARTITION BY agent_key, m ORDER BY seq) AS per_minute FROM o""", "payments")
def win_2(spark, sf):
    d = W.velocity(clocked(spark, sf), member=F.col("direction") == "outgoing")
    return d.filter("per_minute is not null").select("seq", "per_minute")


@query("win_3_usd_per_hour", f"""WITH o AS (SELECT seq, agent_key, ms, CAST(amount_usd AS decimal(38,12)) AS u FROM payments WHERE {_MEMBER})
SELECT seq, round(CAST(coalesce(sum(u) OVER (PARTITION BY agent_key ORDER BY ms RANGE BETWEEN 3599999 PRECEDING AND 1 PRECEDING), 0)
  + sum(u) OVER (PARTITION BY agent_key, ms ORDER BY seq) AS double), 6) AS hour_usd FROM o""", "payments")
def win_3(spark, sf):
    d = W.velocity(pay(spark, sf), member=F.col("direction") == "outgoing")
    return d.filter("hour_usd is not null").select("seq", F.round("hour_usd", 6).alias("hour_usd"))


@query("det_23_velocity", f"""WITH o AS (SELECT seq, scan_id, agent_key, m, amount_usd AS u, pay_to, ms FROM payments WHERE {_MEMBER}),
w AS (SELECT *, count(*) OVER (PARTITION BY agent_key ORDER BY m RANGE BETWEEN 59999 PRECEDING AND 1 PRECEDING) + row_number() OVER (PARTITION BY agent_key, m ORDER BY seq) AS n,
  coalesce(sum(CAST(u AS decimal(38,12))) OVER (PARTITION BY agent_key ORDER BY m RANGE BETWEEN 3599999 PRECEDING AND 1 PRECEDING), 0)
   + sum(CAST(u AS decimal(38,12))) OVER (PARTITION BY agent_key, m ORDER BY seq) AS h, row_number() OVER (PARTITION BY agent_key, pay_to ORDER BY m, seq) = 1 AS fresh FROM o),
f AS (SELECT seq, 'velocity.rate_block' AS check_id FROM w WHERE n >= 20 UNION ALL SELECT seq, 'velocity.rate_flag' FROM w WHERE n >= 10 AND n < 20
  UNION ALL SELECT seq, 'velocity.spend_cap' FROM w WHERE h > 5 UNION ALL SELECT seq, 'velocity.first_contact_size' FROM w WHERE fresh AND u > 1)
SELECT * FROM f UNION ALL SELECT seq, 'velocity.clean' FROM w WHERE seq NOT IN (SELECT seq FROM f)
UNION ALL SELECT seq, 'velocity.unscoped' FROM payments WHERE direction = 'outgoing' AND agent_key IS NULL""", "payments")
def det_23(spark, sf):
    p = clocked(spark, sf)
    d = A.resolve_config(W.velocity(p, member=F.col("direction") == "outgoing"), None, None)
    d = T.join_counterparties(d, T.derive_counterparties(p))
    return d.select("seq", F.explode(velocity_findings()).alias("c")).select("seq", F.col("c.id").alias("check_id"))


_PRIOR = f"coalesce(sum(CAST(amount_usd AS decimal(38,12))) OVER (PARTITION BY agent_key, pay_to {_ORD} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"


@query("win_4_prior_spend", f"SELECT seq, round(CAST({_PRIOR} AS double), 6) AS prior_usd FROM payments WHERE agent_key IS NOT NULL", "payments")
def win_4(spark, sf):
    d = pay(spark, sf).filter("agent_key is not null")
    return W.prior_spend(d).select("seq", F.round("prior_usd", 6).alias("prior_usd"))


@query("det_8_deep_gate", """SELECT seq, u >= 0.5 AS single, u < 0.5 AND agent_key IS NOT NULL AND CAST(p AS double) + u >= 0.5 AS cumulative FROM
(SELECT seq, agent_key, amount_usd / 20 AS u, coalesce(sum(CAST(amount_usd / 20 AS decimal(38,12))) OVER (PARTITION BY agent_key, pay_to ORDER BY ms, seq
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM payments)""", "payments")
def det_8(spark, sf):
    d = W.prior_spend(pay(spark, sf).withColumn("usd", F.col("amount_usd") / 20))
    single = F.col("usd") >= 0.5
    return d.select("seq", single.alias("single"), (~single & F.col("agent_key").isNotNull() & (F.col("prior_usd") + F.col("usd") >= 0.5)).alias("cumulative"))


@query("win_5_first_contact", "SELECT seq, row_number() OVER (PARTITION BY agent_key, pay_to ORDER BY ms, seq) = 1 AS first_contact FROM payments "
                              f"WHERE {_MEMBER}", "payments")
def win_5(spark, sf):
    p = pay(spark, sf)
    d = T.join_counterparties(p.filter("direction = 'outgoing' and agent_key is not null"), T.derive_counterparties(p))
    return d.select("seq", (~F.col("known_payee")).alias("first_contact"))


_FIRST_CP = "c AS (SELECT agent_key, pay_to, min(ms) AS ms FROM payments WHERE direction = 'outgoing' AND agent_key IS NOT NULL GROUP BY ALL)"


@query("join_3_counterparties", f"WITH {_FIRST_CP} SELECT p.seq, coalesce(c.ms < p.ms, false) AS known_payee FROM payments p LEFT JOIN c USING (agent_key, pay_to)", "payments")
def join_3(spark, sf):
    p = pay(spark, sf)
    return T.join_counterparties(p, T.derive_counterparties(p)).select("seq", "known_payee")


_PIN = f"first_value(pay_to) OVER (PARTITION BY domain {_ORD})"
_NTH = f"row_number() OVER (PARTITION BY domain {_ORD})"


@query("join_2_pins", f"SELECT seq, CASE WHEN {_NTH} > 1 THEN {_PIN} END AS pin_pay_to FROM payments", "payments")
def join_2(spark, sf):
    p = pay(spark, sf)
    return T.join_pins(p, T.derive_pins(p)).select("seq", "pin_pay_to")


@query("join_2_pins_cleared", f"""WITH c AS (SELECT domain, ms FROM payments WHERE seq % 503 = 100),
e AS (SELECT p.*, (SELECT count(*) FROM c WHERE c.domain = p.domain AND c.ms <= p.ms) AS epoch FROM payments p)
SELECT seq, epoch, CASE WHEN row_number() OVER (PARTITION BY domain, epoch {_ORD}) > 1 THEN first_value(pay_to) OVER (PARTITION BY domain, epoch {_ORD}) END AS pin_pay_to FROM e""", "payments")
def join_2_clears(spark, sf):
    p = pay(spark, sf)
    return T.join_pins_with_clears(p, p.filter("seq % 503 = 100")).select("seq", "epoch", "pin_pay_to")


@query("det_20_pins", f"SELECT seq, CASE WHEN {_NTH} = 1 THEN 'pin.created' WHEN {_PIN} = pay_to THEN 'pin.match' ELSE 'pin.mismatch' END AS check_id FROM payments", "payments")
def det_20(spark, sf):
    p = pay(spark, sf)
    return T.join_pins(p, T.derive_pins(p)).select("seq", F.explode(pin_findings()).alias("c")).select("seq", F.col("c.id").alias("check_id"))


@query("win_6_pin_times_seen", f"SELECT seq, CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY domain {_ORD}) AS bigint) AS times_seen FROM "
                               f"(SELECT *, {_PIN} = pay_to AS hit FROM payments)", "payments")
def win_6(spark, sf):
    p = pay(spark, sf)
    return T.pin_times_seen(p, T.derive_pins(p)).select("seq", "times_seen")


@query("prj_10_pin_evidence", f"""SELECT seq, CASE WHEN p = pay_to THEN domain END AS pin_domain, CASE WHEN p = pay_to THEN (ms - t) // 1000 END AS pin_age_seconds,
  CASE WHEN p = pay_to THEN 'none' END AS pin_corroboration FROM (SELECT *, {_PIN} AS p, first_value(ms) OVER (PARTITION BY domain {_ORD}) AS t FROM payments)""", "payments")
def prj_10(spark, sf):
    p = pay(spark, sf)
    return T.with_pin_evidence(p, T.derive_pins(p)).select("seq", "pin_domain", "pin_age_seconds", "pin_corroboration")


_DIR = "d AS (SELECT DISTINCT pay_to, CASE WHEN length(domain) % 2 = 0 THEN domain ELSE 'other.example.org' END AS domain FROM payments WHERE seq % 3 = 0)"
_PINS = "pins AS (SELECT DISTINCT domain, first_value(pay_to) OVER (PARTITION BY domain ORDER BY ms, seq) AS pay_to FROM payments)"


def directory(spark, sf):
    return pay(spark, sf).filter("seq % 3 = 0").select("pay_to", F.expr("CASE WHEN length(domain) % 2 = 0 THEN domain ELSE 'other.example.org' END").alias("domain")).distinct()


@query("join_6_directory_status", f"""WITH {_DIR}, {_PINS} SELECT domain, CASE WHEN EXISTS (SELECT 1 FROM d WHERE d.pay_to = pins.pay_to AND d.domain = pins.domain) THEN 'verified'
  WHEN EXISTS (SELECT 1 FROM d WHERE d.pay_to = pins.pay_to) THEN 'mismatch' ELSE 'unchecked' END AS directory_status FROM pins""", "payments")
def join_6(spark, sf):
    return T.pin_directory_status(T.derive_pins(pay(spark, sf)), directory(spark, sf)).select("domain", "directory_status")


@query("det_21_directory", f"""WITH {_DIR}, {_PINS}, bad AS (SELECT domain FROM pins WHERE EXISTS (SELECT 1 FROM d WHERE d.pay_to = pins.pay_to)
  AND NOT EXISTS (SELECT 1 FROM d WHERE d.pay_to = pins.pay_to AND d.domain = pins.domain))
SELECT seq FROM (SELECT *, {_NTH} AS n FROM payments) WHERE n > 1 AND domain IN (SELECT domain FROM bad)""", "payments")
def det_21(spark, sf):
    p = pay(spark, sf)
    pins = T.derive_pins(p)
    bad = T.pin_directory_status(pins, directory(spark, sf)).filter("directory_status = 'mismatch'").select("domain")
    return T.join_pins(p, pins).filter("pin_pay_to is not null").join(bad, "domain", "left_semi").select("seq")


_SHARED = ("coalesce(list_position([substr({a}, i, 1) = substr({b}, i, 1) FOR i IN range(3, 43)], false), 41) - 1")
_REV = "concat('0x', reverse(substr({x}, 3)))"


def _sum_shared(a, b):
    return f"({_SHARED.format(a=a, b=b)} + {_SHARED.format(a=_REV.format(x=a), b=_REV.format(x=b))})"


_KNOWN = """pins AS (SELECT pay_to, min(ms) AS ms FROM (SELECT domain, min_by(pay_to, ms) AS pay_to, min(ms) AS ms FROM payments GROUP BY domain) GROUP BY pay_to),
c AS (SELECT agent_key, pay_to, min(ms) AS ms FROM payments WHERE direction = 'outgoing' AND agent_key IS NOT NULL GROUP BY ALL),
near AS (SELECT p.seq, p.pay_to AS a, k.pay_to AS b FROM payments p JOIN pins k ON substr(p.pay_to, 3, 4) = substr(k.pay_to, 3, 4) AND right(p.pay_to, 4) = right(k.pay_to, 4)
  AND p.pay_to <> k.pay_to AND k.ms < p.ms UNION
  SELECT p.seq, p.pay_to, k.pay_to FROM payments p JOIN c k ON p.agent_key = k.agent_key AND substr(p.pay_to, 3, 4) = substr(k.pay_to, 3, 4) AND right(p.pay_to, 4) = right(k.pay_to, 4)
  AND p.pay_to <> k.pay_to AND k.ms < p.ms),
exact AS (SELECT p.seq FROM payments p JOIN pins k ON p.pay_to = k.pay_to AND k.ms < p.ms UNION SELECT p.seq FROM payments p JOIN c k ON p.agent_key = k.agent_key AND p.pay_to = k.pay_to AND k.ms < p.ms)"""


def _trust(spark, sf):
    p = pay(spark, sf).withColumn("candidates", F.array().cast("array<string>"))
    return p, T.derive_pins(p), T.derive_counterparties(p)


@query("det_18_lookalike", f"WITH {_KNOWN} SELECT DISTINCT seq FROM near WHERE seq NOT IN (SELECT seq FROM exact)", "payments")
def det_18(spark, sf):
    return T.trust_checks(*_trust(spark, sf)).filter("lookalike").select("seq")


@query("join_4_near_address", f"WITH {_KNOWN} SELECT seq, CAST(max({_sum_shared('a', 'b')}) AS bigint) AS shared FROM near GROUP BY seq", "payments")
def join_4(spark, sf):
    p, pins, cps = _trust(spark, sf)
    probes = p.select(F.col("seq").alias("probe_id"), F.lit(0).alias("pos"), F.col("pay_to_lc").alias("address"), "ms", "seq", F.col("agent_key").alias("scope"))
    watched = T.affected_rows(p.withColumn("domain", F.lit(None).cast("string")), pins, cps).select("seq")
    d = T.near_address_best(probes.join(watched, "seq", "left_semi"), T.known_addresses(cps, pins))
    return d.select(F.col("probe_id").alias("seq"), (F.col("shared_prefix") + F.col("shared_suffix")).cast("bigint").alias("shared"))


@query("top_2_best_lookalike", f"""WITH o AS (SELECT *, CAST(ms AS hugeint) * 1000000000000000000 + seq AS o_at FROM payments),
known AS (SELECT '' AS scope, pay_to, 'pin' AS source, 2 AS src, min(o_at) AS o_at FROM (SELECT domain, min_by(pay_to, o_at) AS pay_to, min(o_at) AS o_at FROM o GROUP BY domain) GROUP BY pay_to
  UNION ALL SELECT agent_key, pay_to, 'counterparty', 1, min(o_at) FROM o WHERE direction = 'outgoing' AND agent_key IS NOT NULL GROUP BY agent_key, pay_to),
met AS (SELECT p.seq, p.pay_to AS a, k.* EXCLUDE (scope) FROM o p JOIN known k ON right(p.pay_to, 4) = right(k.pay_to, 4) AND substr(p.pay_to, 3, 4) = substr(k.pay_to, 3, 4)
  AND k.scope IN ('', p.agent_key) AND k.o_at < p.o_at),
near AS (SELECT *, {_SHARED.format(a='a', b='pay_to')} AS shared_prefix, {_SHARED.format(a=_REV.format(x='a'), b=_REV.format(x='pay_to'))} AS shared_suffix
  FROM met WHERE a <> pay_to AND seq NOT IN (SELECT seq FROM met WHERE a = pay_to))
SELECT seq, pay_to AS similar_to, source AS similar_source, CAST(shared_prefix AS integer) AS shared_prefix, CAST(shared_suffix AS integer) AS shared_suffix
FROM near QUALIFY row_number() OVER (PARTITION BY seq ORDER BY shared_prefix + shared_suffix DESC, src, o_at, pay_to) = 1""", "payments")
def top_2(spark, sf):
    p, pins, cps = _trust(spark, sf)
    hits = T.trust_checks(p, pins, cps).filter("lookalike")
    known = T.known_addresses(cps, pins)
    probes = hits.select(F.col("seq").alias("probe_id"), F.lit(0).alias("pos"), F.col("pay_to_lc").alias("address"), "ms", "seq", F.col("agent_key").alias("scope"))
    return T.best_lookalike(T.near_address_best(probes, known)).select(F.col("probe_id").alias("seq"), "similar_to", "similar_source", "shared_prefix", "shared_suffix")


_BAIT = "concat('pay ', substr(pay_to, 1, 6), md5(scan_id), substr(pay_to, 39, 4), ' or ', upper(substr(pay_to, 3)), ' or 0x', md5(domain), '01234567')"


@query("set_2_other_addresses", f"SELECT seq, concat(substr(pay_to, 1, 6), md5(scan_id), substr(pay_to, 39, 4)) AS address FROM payments UNION ALL "
                                "SELECT seq, concat('0x', md5(domain), '01234567') FROM payments", "payments")
def set_2(spark, sf):
    p = pay(spark, sf).withColumn("text", F.expr(_BAIT))
    return p.select("seq", F.explode(T.text_addresses("text", "pay_to_lc")).alias("address"))


@query("det_19_content_lookalike", "SELECT seq FROM payments WHERE seq % 3 = 0", "payments")
def det_19(spark, sf):
    p = pay(spark, sf)
    p = p.withColumn("candidates", F.when(F.col("seq") % 3 == 0, T.text_addresses(F.expr(_BAIT), "pay_to_lc")).otherwise(F.array().cast("array<string>")))
    return T.trust_checks(p, T.derive_pins(p), T.derive_counterparties(p)).filter("bait").select("seq")


@query("set_1_known_addresses", f"""WITH {_FIRST_CP} SELECT agent_key AS scope, pay_to AS address, 'counterparty' AS source FROM c UNION ALL
SELECT DISTINCT '', first_value(pay_to) OVER (PARTITION BY domain ORDER BY ms, seq), 'pin' FROM payments""", "payments")
def set_1(spark, sf):
    p = pay(spark, sf)
    return T.known_addresses(T.derive_counterparties(p), T.derive_pins(p)).select("scope", "address", "source")


# ---------------------------------------------------------------- ratings

_RATE = "r AS (SELECT seq AS rid, domain, ms, CASE seq % 6 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'LOW' WHEN 3 THEN 'VERY_LOW' WHEN 4 THEN 'unavailable' ELSE 'HIGH' END AS level FROM payments WHERE event_type = 'view')"


def ratings(spark, sf):
    return view(spark, sf, "payments").filter("event_type = 'view'").select("domain", F.col("ms").alias("checked_ms"), F.expr(
        "CASE seq % 6 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'LOW' WHEN 3 THEN 'VERY_LOW' WHEN 4 THEN 'unavailable' ELSE 'HIGH' END").alias("level"),
        (F.col("seq") % 100).cast("double").alias("score"))


@query("join_7_ratings", f"WITH {_RATE} SELECT p.seq, r.level AS rating_level FROM payments p ASOF LEFT JOIN r ON p.domain = r.domain AND p.ms >= r.ms", "payments")
def join_7(spark, sf):
    return PO.join_ratings(pay(spark, sf), ratings(spark, sf)).select("seq", "rating_level")


@query("det_22_rating", f"""WITH {_RATE} SELECT p.seq, CASE r.level WHEN 'LOW' THEN 'medium' ELSE 'high' END AS severity FROM payments p
ASOF JOIN r ON p.domain = r.domain AND p.ms >= r.ms WHERE r.level IN ('LOW', 'VERY_LOW')""", "payments")
def det_22(spark, sf):
    d = PO.join_ratings(pay(spark, sf), ratings(spark, sf)).filter("rating_level in ('LOW', 'VERY_LOW')")
    return d.select("seq", F.when(F.col("rating_level") == "LOW", "medium").otherwise("high").alias("severity"))


@query("join_7_refresh", f"""WITH {_RATE}, l AS (SELECT domain, max(ms) AS ms, arg_max(level, ms) AS level FROM r GROUP BY domain)
SELECT DISTINCT p.domain FROM payments p LEFT JOIN l ON l.domain = p.domain WHERE l.ms IS NULL OR {AS_OF} - 2 * 86400000 - l.ms >= CASE WHEN level = 'unavailable' THEN 3600000 ELSE 86400000 END""", "payments")
def join_7_refresh(spark, sf):
    return PO.ratings_to_refresh(pay(spark, sf), ratings(spark, sf), AS_OF - 2 * DAY_MS)


@query("prj_17_clean_ratings", """SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'LOW' ELSE 'VERY_LOW' END AS level, CAST(least(12, s_suppkey % 20) AS bigint) AS n_flags,
  CASE WHEN s_suppkey % 20 > 0 THEN substr(repeat(s_name, 9), 1, 64) END AS first_flag FROM supplier WHERE s_suppkey % 6 < 3""")
def prj_17(spark, sf):
    d = spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey", F.expr(
        "CASE s_suppkey % 6 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'LOW' WHEN 2 THEN 'VERY_LOW' WHEN 3 THEN 'odd' END").alias("level"),
        F.lit(1.5).alias("score"), F.expr("array_repeat(repeat(s_name, 9), cast(s_suppkey % 20 as int))").alias("flags"))
    return PO.clean_ratings(d).select("s_suppkey", "level", F.size("flags").cast("bigint").alias("n_flags"), F.get("flags", F.lit(0)).alias("first_flag"))


# ---------------------------------------------------------------- limiter, policy, provenance, ranges

@query("win_9_rate_limit", """WITH RECURSIVE p AS (SELECT seq, agent_key, m, row_number() OVER (PARTITION BY agent_key ORDER BY m, seq) AS i FROM payments WHERE agent_key IS NOT NULL),
r AS (SELECT seq, agent_key, i, true AS allowed, [m] AS times FROM p WHERE i = 1
  UNION ALL SELECT p.seq, p.agent_key, p.i, len([t for t in r.times if t > p.m - 600000]) < 5,
    CASE WHEN len([t for t in r.times if t > p.m - 600000]) < 5 THEN list_append([t for t in r.times if t > p.m - 600000], p.m) ELSE r.times END
  FROM r JOIN p ON p.agent_key = r.agent_key AND p.i = r.i + 1)
SELECT seq, allowed FROM r""", "payments")
def win_9(spark, sf):
    d = clocked(spark, sf).filter("agent_key is not null")
    return W.rate_limit(d, "agent_key", 5, 600_000, Workspace(spark)).select("seq", "allowed")


@query("det_27_policy_caps", """WITH p AS (SELECT seq, pay_to, CAST(floor(amount_usd * 1000000) AS bigint) AS a FROM payments)
SELECT seq, CASE WHEN seq % 41 = 0 THEN 'amount is not a plain integer' WHEN a > 5000000 THEN 'above the per-payment cap' END AS policy_reason FROM p""", "payments")
def det_27(spark, sf):
    d = pay(spark, sf).withColumn("amount", F.when(F.col("seq") % 41 == 0, "1.5").otherwise(F.floor(F.col("amount_usd") * 1000000).cast("string")))
    return PO.check_policy(d, max_amount=5_000_000).select("seq", "policy_reason")


@query("det_27_policy_allowlist", "SELECT seq, CASE WHEN pay_to NOT IN (SELECT pay_to FROM payments WHERE seq % 5 = 0) THEN 'recipient is not on the allow-list' END AS policy_reason FROM payments", "payments")
def det_27_list(spark, sf):
    d = pay(spark, sf).withColumn("amount", F.lit("1"))
    allow = d.filter("seq % 5 = 0").select(F.upper("pay_to").alias("address")).withColumn("address", F.replace("address", F.lit("0X"), F.lit("0x")))
    return PO.check_policy(d, allowlist=allow).select("seq", "policy_reason")


@query("det_27_policy_cumulative", """WITH RECURSIVE p AS (SELECT seq, agent_key, CAST(floor(amount_usd * 1000000) AS bigint) AS a,
  row_number() OVER (PARTITION BY agent_key ORDER BY ms, seq) AS i FROM payments WHERE agent_key IS NOT NULL),
r AS (SELECT seq, agent_key, i, a <= 20000000 AS ok, CASE WHEN a <= 20000000 THEN a ELSE 0 END AS total FROM p WHERE i = 1
  UNION ALL SELECT p.seq, p.agent_key, p.i, r.total + p.a <= 20000000, r.total + CASE WHEN r.total + p.a <= 20000000 THEN p.a ELSE 0 END
  FROM r JOIN p ON p.agent_key = r.agent_key AND p.i = r.i + 1)
SELECT seq, CASE WHEN NOT ok THEN 'above the cumulative cap' END AS policy_reason FROM r""", "payments")
def det_27_total(spark, sf):
    d = pay(spark, sf).withColumn("amount", F.floor(F.col("amount_usd") * 1000000).cast("string")).filter("agent_key is not null")
    return PO.check_policy(d, max_total=20_000_000, workspace=Workspace(spark)).select("seq", "policy_reason")


_OBS = "CASE seq % 4 WHEN 0 THEN 'tool_result' WHEN 1 THEN 'fetched_content' WHEN 2 THEN 'planning' ELSE 'user_instruction' END"


@query("join_16_provenance", f"""WITH s AS (SELECT seq, agent_key, m AS ms, CASE WHEN event_type = 'click' THEN NULL ELSE 1 END AS scan, {_OBS} AS kind FROM payments WHERE agent_key IS NOT NULL),
g AS (SELECT *, coalesce(sum(scan) OVER (PARTITION BY agent_key ORDER BY ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM s),
l AS (SELECT agent_key, grp, arg_max(kind, (ms, seq)) AS kind, max(ms) AS ms FROM g WHERE scan IS NULL GROUP BY agent_key, grp)
SELECT g.seq, CASE WHEN l.kind IN ('planning', 'user_instruction') OR g.ms - l.ms <= 1000 THEN l.kind ELSE 'unknown' END AS origin
FROM g LEFT JOIN l USING (agent_key, grp) WHERE g.scan = 1""", "payments")
def join_16(spark, sf):
    p = clocked(spark, sf).filter("agent_key is not null")
    obs = p.filter("event_type = 'click'").select("agent_key", "ms", "seq", F.expr(_OBS).alias("kind"))
    return PO.tag_provenance(p.filter("event_type <> 'click'").select("seq", "agent_key", "ms"), obs, ttl_ms=1000).select("seq", "origin")


@query("win_8_uptime_ranges", """WITH b AS (SELECT DISTINCT user_id, at_ms FROM beats), s AS (SELECT *, CASE WHEN at_ms - lag(at_ms) OVER (PARTITION BY user_id ORDER BY at_ms) <= 7200000 THEN 0 ELSE 1 END AS n FROM b),
g AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY at_ms) AS r FROM s) SELECT user_id, min(at_ms) AS from_ms, max(at_ms) AS to_ms, count(*) AS beats FROM g GROUP BY user_id, r""", "beats")
def win_8(spark, sf):
    return W.uptime_ranges(view(spark, sf, "beats"), gap_s=7200, keys=("user_id",)).select("user_id", "from_ms", "to_ms", "beats")


# ---------------------------------------------------------------- the whole screening

def ledgers_of(spark, sf):
    return Ledgers(badlist=view(spark, sf, "badlist"), reports=view(spark, sf, "reports"), ratings=ratings(spark, sf), directory=directory(spark, sf),
                   outcomes=view(spark, sf, "outcome_reports").withColumnRenamed("account_hash", "reporter"), accounts=view(spark, sf, "accounts"))


@query("scr_1_screen")
def scr_1(spark, sf):
    return screen(view(spark, sf, "scans"), ledgers_of(spark, sf)).decisions.select("seq", "verdict", "risk_score", F.array_join("fired", ",").alias("fired"))


@query("set_6_checks")
def set_6(spark, sf):
    return screen(view(spark, sf, "scans"), ledgers_of(spark, sf)).checks.groupBy("check_id", "verdict", "severity").agg(F.count("*").alias("n"))


@query("scr_2_update_ledgers")
def scr_2(spark, sf):
    r = screen(view(spark, sf, "scans"), Ledgers(badlist=view(spark, sf, "badlist")))
    led = update_ledgers(r, Ledgers(), ScreenConfig())
    parts = [(n, getattr(led, n)) for n in ("pins", "counterparties", "nonces", "velocity_events", "spend", "incidents", "scan_index", "scan_counts")]
    out = None
    for n, d in parts:
        one = d.agg(F.count("*").alias("rows")).select(F.lit(n).alias("ledger"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


@query("scr_3_resolve_config", """SELECT p.seq, CASE WHEN o THEN CASE plan WHEN 'pro' THEN 60 ELSE 300 END ELSE 10 END AS lim_per_minute,
  CAST(CASE WHEN o THEN CASE plan WHEN 'pro' THEN 50 ELSE 250 END ELSE 5 END AS double) AS lim_usd_per_hour,
  CAST(CASE WHEN o THEN CASE plan WHEN 'pro' THEN 5 ELSE 25 END ELSE 1 END AS double) AS lim_first_payment, CAST(CASE WHEN o THEN 0 ELSE 0.005 END AS double) AS lim_micro
FROM (SELECT s.seq, a.plan, coalesce(a.plan IS NOT NULL AND a.plan_expires_ms > s.ms, false) AS o FROM scans s LEFT JOIN accounts a USING (account_hash)) p""", "scans", "accounts")
def scr_3(spark, sf):
    d = A.resolve_config(view(spark, sf, "scans"), view(spark, sf, "accounts"), None)
    return d.select("seq", "lim_per_minute", "lim_usd_per_hour", "lim_first_payment", "lim_micro")


@query("flagship_screen", f"""WITH w AS (SELECT seq, m, amount_usd AS u, expected_price_usd AS e, direction, agent_key, {_SEEN.replace('ORDER BY ms', 'ORDER BY m')} AS seen FROM payments),
o AS (SELECT *, count(*) OVER (PARTITION BY agent_key ORDER BY m RANGE BETWEEN 59999 PRECEDING AND 1 PRECEDING) + row_number() OVER (PARTITION BY agent_key, m ORDER BY seq) AS n,
  coalesce(sum(CAST(u AS decimal(38,12))) OVER (PARTITION BY agent_key ORDER BY m RANGE BETWEEN 3599999 PRECEDING AND 1 PRECEDING), 0) + sum(CAST(u AS decimal(38,12))) OVER (PARTITION BY agent_key, m ORDER BY seq) AS h
  FROM w WHERE {_MEMBER}),
c AS (SELECT seq, CASE WHEN u <= 0 OR u > 10 OR (e > 0 AND u / e >= 10) THEN 70 WHEN e > 0 AND u / e >= 3 THEN 40 ELSE 0 END AS s, CASE WHEN u <= 0 OR u > 10 OR (e > 0 AND u / e >= 10) THEN 2 WHEN e > 0 AND u / e >= 3 THEN 1 ELSE 0 END AS r FROM w
  UNION ALL SELECT seq, CASE WHEN seen > 1 THEN 95 ELSE 0 END, CASE WHEN seen > 1 THEN 2 ELSE 0 END FROM w
  UNION ALL SELECT seq, CASE WHEN n >= 20 THEN 95 WHEN n >= 10 THEN 40 ELSE 0 END, CASE WHEN n >= 20 THEN 2 WHEN n >= 10 THEN 1 ELSE 0 END FROM o
  UNION ALL SELECT seq, CASE WHEN h > 5 THEN 70 ELSE 0 END, CASE WHEN h > 5 THEN 2 ELSE 0 END FROM o
  UNION ALL SELECT seq, 15, 1 FROM w WHERE direction = 'outgoing' AND agent_key IS NULL),
v AS (SELECT seq, max(r) AS r, CASE WHEN count(*) FILTER (r > 0) > 1 THEN least(100, max(s) + (count(*) FILTER (r > 0) - 1) * 5) ELSE max(s) END AS risk FROM c GROUP BY seq)
SELECT CASE r WHEN 2 THEN 'block' WHEN 1 THEN 'flag' ELSE 'allow' END AS verdict, count(*) AS scans, round(avg(risk), 6) AS mean_risk FROM v GROUP BY r""", "payments")
def flagship(spark, sf):
    """Replay, price, rate and spend of every payment, folded into a verdict and counted."""
    from ..operators.checks import fold_verdict
    from ..operators.rowlocal import overpayment
    p = clocked(spark, sf).withColumn("phase", F.lit(None).cast("string"))
    d = W.replay_counts(p)
    d = A.resolve_config(W.velocity(d, member=F.col("direction") == "outgoing"), None, None).withColumn("known_payee", F.lit(True))
    d = d.withColumn("checks", F.concat(overpayment(), replay_finding(), velocity_findings()))
    d = d.withColumns(fold_verdict(F.col("checks")))
    return d.groupBy("verdict").agg(F.count("*").alias("scans"), F.round(F.avg("risk_score"), 6).alias("mean_risk"))
