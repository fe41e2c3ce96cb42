"""Queries over ledgers, accounts, approvals, the decision log and analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DAY_MS, GENESIS_HASH, ScreenConfig
from ..functions import scalars as S
from ..operators import analytics as AN, approvals as AP, audit as AU, ledgers as L, policy as PO, windows as W
from ..operators.checks import aggregate_verdicts, check, collect, explode_checks, when
from ..plans import accounts as A
from ..session import Workspace
from ..sources import ledger_io as IO, payments as SP, snapshot as SN
from .fixtures import AS_OF, table, view
from .history_queries import pay
from .registry import query

_DECAY = f"pow(2.0, -greatest(0.0, ({AS_OF} - {{t}}) / 86400000.0) / 90.0)"
_CP = "cp AS (SELECT agent_key, count(DISTINCT pay_to) AS n FROM payments WHERE direction = 'outgoing' AND agent_key IS NOT NULL GROUP BY agent_key)"
_CRED = "(0.5 + 0.5 * least(1.0, coalesce(n, 0) / 10.0))"


def counterparties(spark, sf):
    from ..operators.trust import derive_counterparties
    return derive_counterparties(pay(spark, sf))


@query("prj_11_decay", f"SELECT seq, round({_DECAY.format(t='ms')}, 9) AS weight FROM payments", "payments")
def prj_11(spark, sf):
    return view(spark, sf, "payments").select("seq", F.round(S.decay("ms", F.lit(AS_OF)), 9).alias("weight"))


@query("prj_12_credibility", f"WITH {_CP} SELECT DISTINCT reporter, {_CRED} AS credibility FROM reports LEFT JOIN cp ON agent_key = reporter", "reports")
def prj_12(spark, sf):
    cp = counterparties(spark, sf).groupBy(F.col("agent_key").alias("reporter")).agg(F.count("*").alias("n"))
    return view(spark, sf, "reports").select("reporter").distinct().join(cp, "reporter", "left").select("reporter", S.credibility("n").alias("credibility"))


_SUMMARY = f"""{_CP}, f AS (SELECT address, category, reporter, min(reported_ms) AS t FROM reports GROUP BY ALL),
v AS (SELECT address, reporter, max(t) AS newest, min(t) AS first, count(*) AS k FROM f GROUP BY ALL),
s AS (SELECT address, CAST(sum(k) AS bigint) AS report_count, count(*) AS distinct_reporters, round(sum({_CRED} * {_DECAY.format(t='newest')}), 2) AS weighted_score,
  min(first) AS first_reported_ms, max(newest) AS last_reported_ms FROM v LEFT JOIN cp ON agent_key = reporter GROUP BY address)"""
_GRADE = "CASE WHEN weighted_score >= 2.5 THEN 'high' WHEN weighted_score >= 1 THEN 'medium' WHEN weighted_score > 0.1 THEN 'low' ELSE 'none' END"


@query("agg_5_report_summary", f"WITH {_SUMMARY} SELECT *, {_GRADE} AS risk FROM s", "reports")
def agg_5(spark, sf):
    return L.summarize_reports(view(spark, sf, "reports"), counterparties(spark, sf), AS_OF).drop("categories")


@query("agg_5_report_categories", "SELECT address, category, count(*) AS n FROM (SELECT DISTINCT address, category, reporter FROM reports) GROUP BY ALL", "reports")
def agg_5_cat(spark, sf):
    d = L.summarize_reports(view(spark, sf, "reports"), None, AS_OF)
    return d.select("address", F.explode("categories").alias("category", "n"))


@query("set_5_distinct_voices", "SELECT address, count(DISTINCT reporter) AS voices FROM reports GROUP BY address", "reports")
def set_5(spark, sf):
    return L.distinct_voices(view(spark, sf, "reports"), "address", "reporter")


@query("join_8_reputation", f"WITH {_SUMMARY} SELECT p.seq, CASE WHEN s.address IS NULL THEN 'reputation.clean' WHEN weighted_score > 0.1 THEN 'reputation.reported' ELSE 'reputation.decayed' END AS check_id "
                            "FROM payments p LEFT JOIN s ON p.pay_to = s.address", "payments", "reports")
def join_8(spark, sf):
    s = L.summarize_reports(view(spark, sf, "reports"), counterparties(spark, sf), AS_OF).withColumnRenamed("address", "pay_to_lc")
    d = pay(spark, sf).join(s, "pay_to_lc", "left")
    return d.select("seq", F.explode(L.reputation_finding()).alias("c")).select("seq", F.col("c.id").alias("check_id"))


@query("det_24_reputation_as_of_row", """WITH f AS (SELECT address, category, reporter, min(reported_ms) AS t FROM reports GROUP BY ALL),
v AS (SELECT p.seq, p.ms, f.reporter, max(f.t) AS t, count(*) AS k FROM payments p JOIN f ON f.address = p.pay_to AND f.t < p.ms GROUP BY ALL)
SELECT p.seq, CAST(coalesce(sum(v.k), 0) AS bigint) AS report_count, coalesce(round(sum(0.5 * pow(2.0, -(v.ms - v.t) / 86400000.0 / 90.0)), 2), 0.0) AS score
FROM payments p LEFT JOIN v USING (seq) GROUP BY p.seq""", "payments", "reports")
def det_24(spark, sf):
    d = L.read_back(pay(spark, sf).select("seq", "ms", "pay_to_lc"), "pay_to_lc", L.address_events(view(spark, sf, "reports"), None, None), L.ADDRESS_MEASURES, "a_")
    return d.select("seq", F.col("a_rep_n").cast("bigint").alias("report_count"), L.decayed("a_rep_w").alias("score"))


def _disputes(spark, sf):
    d = view(spark, sf, "payments").filter("event_type = 'error'")
    return L.ingest_disputes(d.select(F.col("pay_to").alias("address"), F.concat(F.lit("statement number "), F.col("seq").cast("string")).alias("statement"),
                                      F.col("ms").alias("disputed_ms"), F.lit(True).alias("verified")))


@query("agg_5b_recent_disputes", """SELECT address, CAST(least(5, count(*)) AS integer) AS dispute_count, arg_max(statement, (ms, statement)) AS newest FROM
(SELECT pay_to AS address, concat('statement number ', CAST(seq AS varchar)) AS statement, ms FROM payments WHERE event_type = 'error') GROUP BY address""", "payments")
def agg_5b(spark, sf):
    r = L.recent_disputes(_disputes(spark, sf))
    return r.select("address", "dispute_count", F.get("statements", F.lit(0)).alias("newest"))


@query("scr_9_ingest_disputes", """SELECT DISTINCT lower(pay_to) AS address, trim(substr('too short, or long enough', 1, CAST(seq % 24 + 1 AS bigint))) AS statement FROM payments
WHERE seq % 3 > 0 AND length(trim(substr('too short, or long enough', 1, CAST(seq % 24 + 1 AS bigint)))) >= 10""", "payments")
def scr_9(spark, sf):
    d = view(spark, sf, "payments").select(F.upper("pay_to").alias("a"), F.expr("substr('too short, or long enough', 1, cast(seq % 24 + 1 as int))").alias("statement"),
                                           F.col("ms").alias("disputed_ms"), (F.col("seq") % 3 > 0).alias("verified"))
    d = d.withColumn("address", F.replace("a", F.lit("0X"), F.lit("0x")))
    return L.ingest_disputes(d).select("address", "statement")


@query("join_14_disputes", "WITH d AS (SELECT pay_to AS address, least(5, count(*)) AS n FROM payments WHERE event_type = 'click' GROUP BY pay_to) "
                           "SELECT DISTINCT r.address, CAST(coalesce(n, 0) AS integer) AS dispute_count FROM reports r LEFT JOIN d USING (address)", "payments", "reports")
def join_14(spark, sf):
    p = view(spark, sf, "payments").filter("event_type = 'click'")
    d = p.select(F.col("pay_to").alias("address"), F.concat(F.lit("statement number "), F.col("seq").cast("string")).alias("statement"), F.col("ms").alias("disputed_ms"))
    r = view(spark, sf, "reports").select("address").distinct().join(L.recent_disputes(d), "address", "left")
    return r.select("address", F.coalesce("dispute_count", F.lit(0)).alias("dispute_count"))


_RAW_REPORT = ("SELECT seq, CASE WHEN seq % 13 = 0 THEN 'abc' ELSE concat(' ', upper(pay_to)) END AS address, CASE WHEN seq % 11 = 0 THEN 'nonsense' ELSE 'scam' END AS category, "
               "CASE WHEN seq % 7 = 0 THEN 'short' ELSE 'a long enough reason' END AS reason, agent_key AS reporter, ms AS reported_ms FROM payments")


@query("scr_8_ingest_reports", f"""WITH r AS ({_RAW_REPORT}) SELECT coalesce(CASE WHEN length(trim(address)) < 6 THEN 'address is required' WHEN category <> 'scam' THEN 'unknown category'
  WHEN reporter IS NULL THEN 'reporter is required' WHEN length(reason) < 10 THEN 'reason is too short' END, 'accepted') AS outcome, CAST(count(DISTINCT
  CASE WHEN length(trim(address)) < 6 OR category <> 'scam' OR reporter IS NULL OR length(reason) < 10 THEN CAST(seq AS varchar) ELSE concat(trim(address), '|', reporter) END) AS bigint) AS n FROM r GROUP BY 1""", "payments")
def scr_8(spark, sf):
    raw = pay(spark, sf).select("seq", F.expr("CASE WHEN seq % 13 = 0 THEN 'abc' ELSE concat(' ', upper(pay_to)) END").alias("address"),
                                F.expr("CASE WHEN seq % 11 = 0 THEN 'nonsense' ELSE 'scam' END").alias("category"),
                                F.expr("CASE WHEN seq % 7 = 0 THEN 'short' ELSE 'a long enough reason' END").alias("reason"),
                                F.col("agent_key").alias("reporter"), F.col("ms").alias("reported_ms"))
    good, bad = L.ingest_reports(raw)
    return good.agg(F.count("*").alias("n")).select(F.lit("accepted").alias("outcome"), "n").unionByName(
        bad.groupBy(F.col("rejected_because").alias("outcome")).agg(F.count("*").alias("n")))


# ---------------------------------------------------------------- incidents

@query("agg_6_incident_summary", f"""WITH f AS (SELECT address, observer, min(ms) AS ms FROM incidents GROUP BY ALL),
k AS (SELECT * FROM f )
SELECT address, CAST(count(*) AS bigint) AS incident_count, count(*) AS distinct_observers, round(sum(0.5 * {_DECAY.format(t='ms')}), 2) AS weighted_score, min(ms) AS first_ms, max(ms) AS last_ms
FROM k GROUP BY address""", "incidents")
def agg_6(spark, sf):
    return L.summarize_incidents(view(spark, sf, "incidents"), None, AS_OF).drop("check_counts")


@query("agg_6_incident_checks", """WITH f AS (SELECT address, observer, arg_min(check_id, ms) AS check_id FROM incidents GROUP BY ALL)
SELECT address, check_id, count(*) AS n FROM f GROUP BY ALL""", "incidents")
def agg_6_checks(spark, sf):
    """The map of counts per check, as rows."""
    return L.summarize_incidents(view(spark, sf, "incidents"), None, AS_OF).select("address", F.explode("check_counts").alias("check_id", "n"))


@query("det_25_injection_history", """WITH f AS (SELECT address, observer, min(ms) AS t FROM incidents GROUP BY ALL),
s AS (SELECT p.seq, round(sum(0.5 * pow(2.0, -(p.ms - f.t) / 86400000.0 / 90.0)), 2) AS score FROM payments p JOIN f ON f.address = p.pay_to AND f.t < p.ms GROUP BY p.seq)
SELECT seq, CASE WHEN score >= 1 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS severity FROM s WHERE score > 0.1""", "payments", "incidents")
def det_25(spark, sf):
    d = L.read_back(pay(spark, sf).select("seq", "ms", "pay_to_lc"), "pay_to_lc", L.address_events(None, view(spark, sf, "incidents"), None), L.ADDRESS_MEASURES, "a_")
    d = d.select("seq", F.explode(L.history_finding(L.decayed("a_inc_w"), F.col("a_inc_n").cast("bigint"))).alias("c"))
    return d.select("seq", "c.severity")


# ---------------------------------------------------------------- outcomes

_COUNTS = ("CAST(count(*) FILTER (outcome = 'delivered') AS bigint) AS delivered, CAST(count(*) FILTER (outcome = 'not_delivered') AS bigint) AS not_delivered, "
           "CAST(count(*) FILTER (outcome = 'partial') AS bigint) AS partial, CAST(count(*) FILTER (outcome = 'wrong_content') AS bigint) AS wrong_content, "
           "CAST(count(*) FILTER (settlement_receipt = 'absent') AS bigint) AS receiptless, min(reported_ms) AS first_ms, max(reported_ms) AS last_ms, "
           "CAST(count(DISTINCT account_hash) AS bigint) AS distinct_reporters")


def accepted(spark, sf):
    return view(spark, sf, "outcome_reports").withColumn("reporter", F.col("account_hash"))


@query("agg_7_outcomes_by_payee", f"SELECT pay_to, {_COUNTS} FROM outcome_reports GROUP BY pay_to", "outcome_reports")
def agg_7(spark, sf):
    return L.outcomes_by_payee(accepted(spark, sf))


@query("agg_8_outcomes_by_domain", f"""WITH u AS (SELECT domain, pay_to, min(CAST(reported_ms AS hugeint) * 100000000 + seq) AS o FROM outcome_reports GROUP BY domain, pay_to),
l AS (SELECT domain, string_agg(pay_to, ',' ORDER BY o) AS payees FROM u GROUP BY domain)
SELECT o.*, l.payees FROM (SELECT domain, {_COUNTS} FROM outcome_reports GROUP BY domain) o JOIN l USING (domain)""", "outcome_reports")
def agg_8(spark, sf):
    return L.outcomes_by_domain(accepted(spark, sf)).withColumn("payees", F.concat_ws(",", "pay_tos")).drop("pay_tos")


_RATES = ("delivered + not_delivered + partial + wrong_content AS total, round(delivered / (delivered + not_delivered + partial + wrong_content), 4) AS raw_rate, "
          "round((delivered + 9.0) / (delivered + not_delivered + partial + wrong_content + 10.0), 4) AS smooth")


@query("agg_9_delivery_summary", f"""WITH o AS (SELECT pay_to, {_COUNTS} FROM outcome_reports GROUP BY pay_to), r AS (SELECT *, {_RATES} FROM o),
c AS (SELECT pay_to, count(*) AS scans_seen FROM payments WHERE seq % 4 > 0 GROUP BY pay_to)
SELECT coalesce(r.pay_to, c.pay_to) AS pay_to, CAST(coalesce(total, 0) AS bigint) AS outcomes_total, raw_rate AS delivery_rate, smooth AS smoothed_delivery_rate,
  CAST(coalesce(scans_seen, 0) AS bigint) AS scans_seen, CASE WHEN scans_seen > 0 THEN round(least(1.0, coalesce(total, 0) / scans_seen), 4) END AS report_coverage
FROM r FULL JOIN c ON r.pay_to = c.pay_to""", "payments", "outcome_reports")
def agg_9(spark, sf):
    counts = L.scan_counts(pay(spark, sf).withColumn("verdict", F.when(F.col("seq") % 4 > 0, "allow").otherwise("block")))
    d = L.delivery_summary(L.outcomes_by_payee(accepted(spark, sf)), counts)
    return d.select("pay_to", "outcomes_total", "delivery_rate", "smoothed_delivery_rate", "scans_seen", "report_coverage")


@query("prj_13_smoothed_rate", f"SELECT pay_to, round((delivered + 9.0) / (delivered + not_delivered + partial + wrong_content + 10.0), 9) AS rate FROM (SELECT pay_to, {_COUNTS} FROM outcome_reports GROUP BY pay_to)", "outcome_reports")
def prj_13(spark, sf):
    d = L.outcomes_by_payee(accepted(spark, sf))
    return d.select("pay_to", F.round(S.smoothed_rate("delivered", L.total_of()), 9).alias("rate"))


@query("prj_14_classify_delivery", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 < 3 THEN 'delivered' ELSE 'not_delivered' END AS outcome FROM orders")
def prj_14(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", S.classify_delivery(F.expr("CASE WHEN o_orderkey % 7 < 3 THEN 200 + o_orderkey % 3 ELSE 400 + o_orderkey % 9 END")).alias("outcome"))


@query("agg_10_scan_counts", "SELECT pay_to, count(*) AS scans, min(ms) AS first_ms, max(ms) AS last_ms FROM payments WHERE seq % 4 > 0 GROUP BY pay_to", "payments")
def agg_10(spark, sf):
    return L.scan_counts(pay(spark, sf).withColumn("verdict", F.when(F.col("seq") % 4 > 0, "allow").otherwise("block")))


@query("agg_11_cumulative_spend", "SELECT agent_key, pay_to AS pay_to_lc, round(CAST(sum(CAST(amount_usd AS decimal(38,12))) AS double), 6) AS usd, count(*) AS scans, min(ms) AS first_ms, max(ms) AS last_ms "
                                  "FROM payments WHERE agent_key IS NOT NULL AND amount_usd > 0 GROUP BY ALL", "payments")
def agg_11(spark, sf):
    return L.cumulative_spend(pay(spark, sf)).withColumn("usd", F.round("usd", 6))


_BAD = ("CASE WHEN not_delivered + wrong_content >= 3 AND delivered = 0 THEN 'delivery.no_confirmed' WHEN total >= 5 AND smooth < 0.7 THEN 'delivery.low_rate' END")


@query("det_26_delivery", f"""WITH o AS (SELECT pay_to, {_COUNTS} FROM outcome_reports GROUP BY pay_to), r AS (SELECT *, {_RATES} FROM o)
SELECT pay_to, coalesce({_BAD}, 'delivery.history') AS check_id FROM r UNION ALL SELECT pay_to, 'delivery.receiptless_settlement' FROM r WHERE receiptless > 0""", "outcome_reports")
def det_26(spark, sf):
    d = L.with_rates(L.outcomes_by_payee(accepted(spark, sf)))
    return d.select("pay_to", F.explode(L.delivery_findings()).alias("c")).select("pay_to", F.col("c.id").alias("check_id"))


@query("det_26_delivery_as_of_row", """SELECT p.seq, CAST(count(o.seq) FILTER (o.outcome = 'delivered') AS bigint) AS delivered, CAST(count(o.seq) AS bigint) AS total
FROM payments p LEFT JOIN outcome_reports o ON o.pay_to = p.pay_to AND o.reported_ms < p.ms GROUP BY p.seq""", "payments", "outcome_reports")
def det_26_row(spark, sf):
    d = L.read_back(pay(spark, sf).select("seq", "ms", "pay_to_lc"), "pay_to_lc", L.address_events(None, None, accepted(spark, sf)), L.ADDRESS_MEASURES, "a_")
    total = F.col("a_delivered") + F.col("a_not_delivered") + F.col("a_partial") + F.col("a_wrong_content")
    return d.select("seq", F.col("a_delivered").cast("bigint").alias("delivered"), total.cast("bigint").alias("total"))


@query("join_10_rotated_history", f"""WITH o AS (SELECT domain, {_COUNTS} FROM outcome_reports GROUP BY domain), r AS (SELECT *, {_RATES} FROM o), b AS (SELECT *, {_BAD} AS kind FROM r)
SELECT p.seq, CASE WHEN kind = 'delivery.no_confirmed' THEN CASE WHEN not_delivered + wrong_content >= 5 THEN 'high' ELSE 'medium' END ELSE CASE WHEN smooth < 0.35 THEN 'high' ELSE 'medium' END END AS severity
FROM payments p JOIN b USING (domain) WHERE kind IS NOT NULL AND EXISTS (SELECT 1 FROM outcome_reports q WHERE q.domain = p.domain AND q.pay_to <> p.pay_to)""", "payments", "outcome_reports")
def join_10(spark, sf):
    d = L.join_rotated_history(pay(spark, sf), L.outcomes_by_domain(accepted(spark, sf)))
    return d.filter("rotated_severity is not null").select("seq", F.col("rotated_severity").alias("severity"))


def _index(spark, sf):
    p = pay(spark, sf)
    return p.select("scan_id", F.sha2(F.concat("scan_id", F.lit("|"), "pay_to"), 256).alias("commitment"), "pay_to", "domain",
                    F.when(F.col("seq") % 5 > 0, F.concat(F.lit("acct-"), (F.col("seq") % 40).cast("string"))).alias("account_hash"))


def _claims(spark, sf):
    """Outcome claims: some with a wrong commitment, some by another account, some repeated with the same or another outcome."""
    o = view(spark, sf, "outcome_reports").withColumn("commitment", F.sha2(F.concat("scan_id", F.lit("|"), "pay_to"), 256))
    o = o.withColumn("commitment", F.when(F.col("seq") % 17 == 0, F.lit("00")).otherwise(F.col("commitment")))
    o = o.withColumn("account_hash", F.when(F.col("seq") % 13 == 0, F.lit("acct-x")).otherwise(F.col("account_hash")))
    again = o.filter("seq % 3 = 0").withColumns({"reported_ms": F.col("reported_ms") + 5, "seq": F.col("seq") + 10_000_000,
                                                 "outcome": F.when(F.col("seq") % 2 == 0, F.lit("delivered")).otherwise(F.col("outcome"))})
    return o.unionByName(again)


_CLAIMS = """o AS (SELECT seq, scan_id, outcome, reported_ms, seq % 17 = 0 OR (seq % 13 = 0 AND seq % 5 > 0) AS lost, CASE WHEN seq % 2 = 0 THEN 'delivered' ELSE outcome END AS second FROM outcome_reports),
r AS (SELECT seq, CASE WHEN lost THEN 'unknown' ELSE 'accepted' END AS status FROM o UNION ALL
  SELECT seq + 10000000, CASE WHEN lost THEN 'unknown' WHEN second = outcome THEN 'idempotent' ELSE 'conflict' END FROM o WHERE seq % 3 = 0)"""


@query("scr_6_ingest_outcomes", f"WITH {_CLAIMS} SELECT * FROM r", "outcome_reports")
def scr_6(spark, sf):
    return L.ingest_outcomes(_claims(spark, sf), _index(spark, sf)).select("seq", "status")


@query("join_9_match_outcomes", f"WITH {_CLAIMS} SELECT seq FROM r WHERE status <> 'unknown'", "outcome_reports")
def join_9(spark, sf):
    return L.match_outcomes(_claims(spark, sf), _index(spark, sf))[0].select("seq")


@query("scr_10_address_profile", f"""WITH {_SUMMARY}, i AS (SELECT address, count(DISTINCT observer) AS n FROM incidents GROUP BY address),
o AS (SELECT pay_to AS address, count(*) AS n FROM outcome_reports GROUP BY pay_to), a AS (SELECT DISTINCT pay_to AS address FROM payments),
q AS (SELECT pay_to AS address, CAST(least(5, count(*)) AS integer) AS n FROM payments WHERE event_type = 'error' GROUP BY pay_to)
SELECT a.address, CASE WHEN report_count > 0 THEN 'reported' ELSE 'clean' END AS status, coalesce({_GRADE.replace("ELSE 'none'", "ELSE NULL")}, 'none') AS risk, report_count AS reports,
  CAST(i.n AS bigint) AS incidents, CAST(coalesce(o.n, 0) AS bigint) AS outcomes, q.n AS disputes
FROM a LEFT JOIN s USING (address) LEFT JOIN i USING (address) LEFT JOIN o USING (address) LEFT JOIN q USING (address)""", "payments", "reports", "incidents", "outcome_reports")
def scr_10(spark, sf):
    p = pay(spark, sf)
    counts = L.scan_counts(p.withColumn("verdict", F.lit("allow")))
    d = L.address_profile(p.select(F.col("pay_to_lc").alias("address")), L.summarize_reports(view(spark, sf, "reports"), counterparties(spark, sf), AS_OF),
                          L.recent_disputes(_disputes(spark, sf)), L.summarize_incidents(view(spark, sf, "incidents"), None, AS_OF), L.delivery_summary(L.outcomes_by_payee(accepted(spark, sf)), counts))
    return d.select("address", "status", "risk", F.col("reports_report_count").alias("reports"), F.col("incidents_incident_count").alias("incidents"),
                    F.col("delivery_outcomes_total").alias("outcomes"), F.col("disputes_dispute_count").alias("disputes"))


# ---------------------------------------------------------------- bad list, trust queries

@query("det_17_badlist", "SELECT seq FROM payments WHERE pay_to IN (SELECT address FROM badlist)", "payments", "badlist")
def det_17(spark, sf):
    bad = view(spark, sf, "badlist").select(F.lower("address").alias("pay_to_lc"))
    return pay(spark, sf).join(bad, "pay_to_lc", "left_semi").select("seq")


@query("join_1_badlist_counts", "SELECT pay_to, count(*) AS n FROM payments WHERE pay_to IN (SELECT address FROM badlist) GROUP BY pay_to", "payments", "badlist")
def join_1(spark, sf):
    return pay(spark, sf).join(view(spark, sf, "badlist"), F.col("pay_to") == F.col("address"), "left_semi").groupBy("pay_to").agg(F.count("*").alias("n"))


_QUERY_JSON = """CASE seq % 4 WHEN 0 THEN concat('{"payer":{"wallet":"', upper(pay_to), '"}}') WHEN 1 THEN concat('{"address":" ', pay_to, ' "}')
 WHEN 2 THEN '{"payer":{"agent_id":"agent-1"}}' ELSE concat('{"wallet":"', pay_to, '","payer":{"wallet":"abc"}}') END"""


@query("prj_18_trust_queries", "SELECT seq, CASE WHEN seq % 4 <> 2 THEN pay_to END AS wallet, CASE WHEN seq % 4 = 2 THEN 'agent-1' END AS query_agent FROM payments", "payments")
def prj_18(spark, sf):
    return PO.parse_trust_queries(view(spark, sf, "payments").select("seq", F.expr(_QUERY_JSON).alias("raw"))).select("seq", "wallet", "query_agent")


@query("join_15_trust", f"""WITH {_SUMMARY}, g AS (SELECT address, {_GRADE} AS risk FROM s)
SELECT p.seq, CASE WHEN p.seq % 4 = 2 THEN 'NO_WALLET_SUBJECT' WHEN pay_to IN (SELECT address FROM badlist) THEN 'BADLISTED' WHEN risk = 'high' THEN 'REPORTED_HIGH_DENSITY'
  WHEN risk = 'medium' THEN 'REPORTED_MEDIUM_DENSITY' WHEN risk = 'low' THEN 'REPORTED_LOW_DENSITY' ELSE 'NO_ADVERSE_HISTORY' END AS reason_code FROM payments p LEFT JOIN g ON g.address = p.pay_to""", "payments", "reports", "badlist")
def join_15(spark, sf):
    q = PO.parse_trust_queries(view(spark, sf, "payments").select("seq", F.expr(_QUERY_JSON).alias("raw")))
    return PO.evaluate_trust(q, view(spark, sf, "badlist"), L.summarize_reports(view(spark, sf, "reports"), counterparties(spark, sf), AS_OF)).select("seq", "reason_code")


# ---------------------------------------------------------------- accounts and plans

_TOMBS = """t AS (SELECT concat('old-', CAST(c_custkey AS varchar)) AS account_hash, CASE WHEN c_custkey % 3 = 0 THEN 'revoked' ELSE 'rotated' END AS reason,
  concat('acct-', CAST(c_custkey * 2 AS varchar)) AS successor, 1000 + c_custkey AS grace_until_ms FROM customer)"""


def tombstones(spark, sf):
    return table(spark, sf, "customer").selectExpr("concat('old-', cast(c_custkey as string)) account_hash", "CASE WHEN c_custkey % 3 = 0 THEN 'revoked' ELSE 'rotated' END reason",
                                                   "concat('acct-', cast(c_custkey * 2 as string)) successor", "1000 + c_custkey grace_until_ms")


def presented(spark, sf):
    return table(spark, sf, "customer").select(F.expr("CASE WHEN c_custkey % 2 = 0 THEN concat('acct-', cast(c_custkey as string)) ELSE concat('old-', cast(c_custkey as string)) END").alias("account_hash"))


@query("join_11_resolve_accounts", f"""WITH {_TOMBS}, q AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN concat('acct-', CAST(c_custkey AS varchar)) ELSE concat('old-', CAST(c_custkey AS varchar)) END AS account_hash FROM customer),
j AS (SELECT q.account_hash, a.account_hash AS live, t.*, h.account_hash AS heir, coalesce(t.reason = 'rotated' AND h.account_hash IS NOT NULL AND t.grace_until_ms > 1060, false) AS grace
  FROM q LEFT JOIN accounts a ON a.account_hash = q.account_hash LEFT JOIN t ON t.account_hash = q.account_hash LEFT JOIN accounts h ON h.account_hash = t.successor)
SELECT account_hash, coalesce(live, CASE WHEN grace THEN successor END) AS resolved_account, live IS NULL AND grace AS via_grace, CASE WHEN live IS NULL AND NOT grace THEN reason END AS dead_reason FROM j""", "accounts")
def join_11(spark, sf):
    return A.resolve_accounts(presented(spark, sf), view(spark, sf, "accounts"), tombstones(spark, sf), 1060)


@query("join_12_plan_limits", """SELECT account_hash, CASE WHEN o THEN plan END AS plan_id, CAST(CASE WHEN o THEN CASE plan WHEN 'pro' THEN 60 ELSE 300 END ELSE 10 END AS integer) AS lim_per_minute,
  CAST(CASE WHEN o THEN CASE plan WHEN 'pro' THEN 0.005 ELSE 0.002 END ELSE 0.01 END AS double) AS price FROM (SELECT *, plan IS NOT NULL AND plan_expires_ms > 1706745600000 AS o FROM accounts)""", "accounts")
def join_12(spark, sf):
    a = view(spark, sf, "accounts")
    return A.join_plan_limits(a.select("account_hash"), a, A.plan_table(spark), AS_OF).select("account_hash", "plan_id", "lim_per_minute", "price")


@query("join_19_remap_accounts", """SELECT c_custkey, CASE WHEN c_custkey >= 8 THEN concat('k-', CAST(c_custkey % 8 AS varchar)) ELSE concat('k-', CAST(c_custkey AS varchar)) END AS account_hash FROM customer""")
def join_19(spark, sf):
    c = table(spark, sf, "customer")
    led = c.select("c_custkey", F.concat(F.lit("k-"), F.col("c_custkey").cast("string")).alias("account_hash"))
    tomb = c.filter("c_custkey >= 8").selectExpr("concat('k-', cast(c_custkey as string)) account_hash", "'rotated' reason", "concat('k-', cast(c_custkey - 8 as string)) successor")
    return A.remap_accounts(led, tomb, Workspace(spark))


@query("win_11_plan_expiry", """WITH RECURSIVE p AS (SELECT o_custkey, <OMS> AS ms, o_orderkey AS seq, CASE WHEN o_orderkey % 3 = 0 THEN 'scale' ELSE 'pro' END AS plan FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY ms, seq) AS i FROM p),
r AS (SELECT o_custkey, seq, ms, plan, i, ms + 2592000000 AS e FROM n WHERE i = 1 UNION ALL
  SELECT n.o_custkey, n.seq, n.ms, n.plan, n.i, (CASE WHEN n.plan = r.plan THEN greatest(n.ms, r.e) ELSE n.ms END) + 2592000000 FROM r JOIN n ON n.o_custkey = r.o_custkey AND n.i = r.i + 1)
SELECT seq, e AS expires_ms FROM r""")
def win_11(spark, sf):
    from .fixtures import SLOTS
    p = table(spark, sf, "orders").selectExpr("concat('acct-', cast(o_custkey as string)) account_hash", f"{SLOTS['spark']['OMS']} ms", "o_orderkey seq",
                                              "CASE WHEN o_orderkey % 3 = 0 THEN 'scale' ELSE 'pro' END plan_id")
    return W.plan_expiry(p, A.plan_table(spark)).select("seq", "expires_ms")


@query("win_12_meter_calls", """WITH c AS (SELECT s.*, row_number() OVER (PARTITION BY account_hash ORDER BY ms, seq) AS n FROM scans s WHERE account_hash IS NOT NULL)
SELECT c.seq, n AS call_no, CAST(CASE WHEN n <= 20 THEN 0 WHEN a.plan IS NOT NULL AND c.ms < a.plan_expires_ms THEN CASE a.plan WHEN 'pro' THEN 0.005 ELSE 0.002 END ELSE 0.01 END AS double) AS charge
FROM c LEFT JOIN accounts a USING (account_hash)""", "scans", "accounts")
def win_12(spark, sf):
    a = view(spark, sf, "accounts").filter("plan is not null").select("account_hash", F.lit(0).cast("bigint").alias("from_ms"), F.col("plan_expires_ms").alias("until_ms"),
                                                                       F.expr("CASE plan WHEN 'pro' THEN 0.005D ELSE 0.002D END").alias("price_per_scan"))
    d = W.meter_calls(view(spark, sf, "scans").select("seq", "ms", "account_hash"), a, free=20)
    return d.select("seq", "call_no", F.col("charge").cast("double").alias("charge"))


# ---------------------------------------------------------------- decisions and analytics

_DEC = """d AS (SELECT seq, scan_id, ms, direction, agent_key AS agent_id, amount_usd AS logged_usd, pay_to, account_hash,
  CASE WHEN seq % 7 = 0 THEN 'block' WHEN seq % 3 = 0 THEN 'flag' ELSE 'allow' END AS verdict, coalesce(a.first_party, false) AS first_party
  FROM (SELECT *, CASE WHEN seq % 4 > 0 THEN concat('acct-', CAST(user_id AS varchar)) END AS account_hash FROM payments) LEFT JOIN (SELECT account_hash, first_party FROM accounts) a USING (account_hash))"""


def decisions(spark, sf):
    d = view(spark, sf, "payments").withColumn("account_hash", F.when(F.col("seq") % 4 > 0, F.concat(F.lit("acct-"), F.col("user_id").cast("string"))))
    d = d.withColumn("verdict", F.expr("CASE WHEN seq % 7 = 0 THEN 'block' WHEN seq % 3 = 0 THEN 'flag' ELSE 'allow' END"))
    d = d.select("seq", "scan_id", "ms", "direction", F.col("agent_key").alias("agent_id"), F.col("amount_usd").alias("logged_usd"), "pay_to", "account_hash", "verdict")
    return d.withColumn("fired", F.expr("CASE WHEN seq % 7 = 0 THEN array('pin.mismatch', 'replay.nonce_reuse') WHEN seq % 3 = 0 THEN array('pii.email') ELSE array() END"))


def _filters(kind, cond):
    return ", ".join(f"count(*) FILTER ({cond} AND verdict = '{v}') AS {kind}_{v}" for v in ("allow", "flag", "block"))


@query("agg_2_decision_stats", f"""WITH {_DEC} SELECT count(*) AS count, count(*) FILTER (verdict = 'allow') AS allow, count(*) FILTER (verdict = 'flag') AS flag, count(*) FILTER (verdict = 'block') AS block,
  count(*) FILTER (direction = 'outgoing') AS outgoing, count(*) FILTER (direction = 'incoming') AS incoming, count(DISTINCT agent_id) AS distinct_agents,
  CAST(round(sum(CAST(logged_usd AS decimal(38,12))), 2) AS double) AS total_scanned_usd, min(ms) AS first_ms, max(ms) AS last_ms, count(*) FILTER (first_party) AS first_party_count,
  count(*) FILTER (NOT first_party) AS third_party_count, {_filters('first_party', 'first_party')}, {_filters('third_party', 'NOT first_party')},
  count(DISTINCT CASE WHEN first_party THEN agent_id END) AS first_party_agents, count(DISTINCT CASE WHEN NOT first_party THEN agent_id END) AS third_party_agents FROM d""", "payments", "accounts")
def agg_2(spark, sf):
    return AN.decision_stats(AN.split_party(decisions(spark, sf), view(spark, sf, "accounts")))


@query("agg_2_decision_cube", f"WITH {_DEC} SELECT verdict, direction, first_party, count(*) AS n, CAST(grouping_id(verdict, direction, first_party) AS bigint) AS level FROM d GROUP BY CUBE (verdict, direction, first_party)", "payments", "accounts")
def agg_2_cube(spark, sf):
    return AN.decision_cube(AN.split_party(decisions(spark, sf), view(spark, sf, "accounts")))


@query("join_17_split_party", f"WITH {_DEC} SELECT first_party, verdict, count(*) AS n FROM d GROUP BY ALL", "payments", "accounts")
def join_17(spark, sf):
    return AN.split_party(decisions(spark, sf), view(spark, sf, "accounts")).groupBy("first_party", "verdict").agg(F.count("*").alias("n"))


@query("join_18_non_blocked", "SELECT seq FROM payments WHERE seq % 7 > 0", "payments")
def join_18(spark, sf):
    blocked = decisions(spark, sf).filter("verdict = 'block'").select("seq")
    return view(spark, sf, "payments").join(blocked, "seq", "left_anti").select("seq")


@query("agg_3_daily_series", f"""WITH {_DEC}, c AS (SELECT DATE '2024-02-01' - CAST(i AS integer) AS day FROM range(0, 35) t(i))
SELECT c.day, count(d.seq) AS total, count(d.seq) FILTER (verdict = 'block') AS block FROM c LEFT JOIN d ON CAST(make_timestamp(d.ms * 1000) AS date) = c.day GROUP BY c.day""", "payments", "accounts")
def agg_3(spark, sf):
    return AN.daily_series(decisions(spark, sf), 35, AS_OF)


@query("agg_4_top_checks", "SELECT * FROM (SELECT 'pin.mismatch' AS check_id, count(*) FILTER (seq % 7 = 0) AS n FROM payments UNION ALL SELECT 'replay.nonce_reuse', count(*) FILTER (seq % 7 = 0) FROM payments "
                           "UNION ALL SELECT 'pii.email', count(*) FILTER (seq % 7 > 0 AND seq % 3 = 0) FROM payments) ORDER BY n DESC, check_id LIMIT 2", "payments")
def agg_4(spark, sf):
    return AN.top_checks(decisions(spark, sf), 2)


@query("top_1_top_k", "SELECT pay_to, count(*) AS n FROM payments GROUP BY pay_to ORDER BY n DESC, pay_to LIMIT 8", "payments")
def top_1(spark, sf):
    return AN.top_k(view(spark, sf, "payments").groupBy("pay_to").agg(F.count("*").alias("n")), 8, F.desc("n"), F.asc("pay_to"))


@query("agg_12_account_usage", f"""WITH {_DEC}, g AS (SELECT account_hash, count(*) AS total, count(*) FILTER (verdict = 'allow') AS allow, count(*) FILTER (verdict = 'flag') AS flag, count(*) FILTER (verdict = 'block') AS block FROM d WHERE account_hash IS NOT NULL GROUP BY account_hash)
SELECT a.account_hash, coalesce(total, 0) AS total, coalesce(allow, 0) AS allow, coalesce(flag, 0) AS flag, coalesce(block, 0) AS block, CASE WHEN total > 0 THEN round(block / total, 4) ELSE 0.0 END AS block_rate,
  greatest(0, 100 - coalesce(total, 0)) AS free_left FROM accounts a LEFT JOIN g USING (account_hash)""", "payments", "accounts")
def agg_12(spark, sf):
    return AN.account_usage(decisions(spark, sf), view(spark, sf, "accounts")).select("account_hash", "total", "allow", "flag", "block", "block_rate", "free_left")


@query("agg_13_owner_stats", f"""WITH {_DEC}, g AS (SELECT account_hash, count(*) AS total, max(ms) AS last FROM d WHERE account_hash IS NOT NULL GROUP BY account_hash)
SELECT count(*) AS accounts, count(plan) AS with_plan, count(*) FILTER (last > {AS_OF} - 7 * 86400000) AS active_7d, CAST(sum(total) AS bigint) AS keyed_total, (SELECT count(*) FROM reports) AS reports,
  (SELECT count(DISTINCT domain) FROM payments) AS pins, (SELECT count(*) FROM badlist) AS badlist FROM accounts LEFT JOIN g USING (account_hash)""", "payments", "accounts", "reports", "badlist")
def agg_13(spark, sf):
    from ..operators.trust import derive_pins
    usage = AN.account_usage(decisions(spark, sf), view(spark, sf, "accounts"))
    d = AN.owner_stats(usage, view(spark, sf, "reports"), derive_pins(pay(spark, sf)), view(spark, sf, "badlist"), AS_OF)
    return d.select("accounts", "with_plan", "active_7d", "keyed_total", "reports", "pins", "badlist")


@query("agg_14_public_stats", f"""WITH {_DEC}, f AS (SELECT count(*) AS n, count(*) FILTER (verdict = 'block') AS b, count(*) FILTER (verdict = 'flag') AS g FROM d WHERE first_party AND account_hash IS NOT NULL),
o AS (SELECT count(*) AS k FROM (SELECT DISTINCT agent_id FROM d WHERE agent_id IS NOT NULL INTERSECT SELECT agent_id FROM accounts WHERE first_party))
SELECT count(*) AS scans, count(*) FILTER (verdict = 'block') AS blocked, count(*) FILTER (verdict = 'flag') AS flagged, count(DISTINCT agent_id) AS distinct_agents,
  count(*) - any_value(f.n) AS third_party_scans, count(*) FILTER (verdict = 'block') - any_value(f.b) AS third_party_blocked, count(*) FILTER (verdict = 'flag') - any_value(f.g) AS third_party_flagged,
  greatest(0, count(DISTINCT agent_id) - any_value(o.k)) AS third_party_agents FROM d, f, o""", "payments", "accounts")
def agg_14(spark, sf):
    d = AN.public_stats(decisions(spark, sf), view(spark, sf, "accounts"))
    return d.select("scans", "blocked", "flagged", "distinct_agents", "third_party_scans", "third_party_blocked", "third_party_flagged", "third_party_agents")


@query("set_4_agent_overlap", "SELECT DISTINCT agent_key AS agent_id FROM payments WHERE agent_key IN (SELECT agent_id FROM accounts WHERE first_party)", "payments", "accounts")
def set_4(spark, sf):
    return AN.agent_overlap(decisions(spark, sf), view(spark, sf, "accounts"))


@query("agg_15_uptime", f"""WITH b AS (SELECT DISTINCT user_id, at_ms FROM beats), s AS (SELECT *, CASE WHEN at_ms - lag(at_ms) OVER (PARTITION BY user_id ORDER BY at_ms) <= 7200000 THEN 0 ELSE 1 END AS n FROM b),
g AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY at_ms) AS r FROM s), w AS (SELECT user_id, min(at_ms) AS f, max(at_ms) AS t FROM g GROUP BY user_id, r),
c AS (SELECT user_id, greatest(f, {AS_OF} - 20 * 86400000) AS a, CASE WHEN {AS_OF} - t <= 120000 THEN {AS_OF} ELSE t END AS z FROM w)
SELECT user_id, round(least(100.0, CAST(sum(z - a) AS double) / ({AS_OF} - min(a)) * 100), 2) AS pct, min(a) AS measured_since_ms, count(*) - 1 AS interruptions FROM c WHERE z >= a GROUP BY user_id""", "beats")
def agg_15(spark, sf):
    return AN.uptime(W.uptime_ranges(view(spark, sf, "beats"), gap_s=7200, keys=("user_id",)), AS_OF, 20, keys=("user_id",))


_CHK = """c AS (SELECT scan_id, 0 AS o, 'a' AS id, CASE WHEN seq % 5 = 0 THEN 'block' ELSE 'allow' END AS verdict, CASE WHEN seq % 5 = 0 THEN 95 ELSE 0 END AS s FROM payments
UNION ALL SELECT scan_id, 1, 'b', CASE WHEN seq % 3 = 0 THEN 'flag' ELSE 'allow' END, CASE WHEN seq % 3 = 0 THEN 40 ELSE 0 END FROM payments
UNION ALL SELECT scan_id, 2, 'c', 'flag', 15 FROM payments WHERE seq % 2 = 0)"""


@query("agg_1_aggregate_verdicts", f"""WITH {_CHK} SELECT scan_id, CASE max(CASE verdict WHEN 'block' THEN 2 WHEN 'flag' THEN 1 ELSE 0 END) WHEN 2 THEN 'block' WHEN 1 THEN 'flag' ELSE 'allow' END AS verdict,
  CAST(CASE WHEN count(*) FILTER (verdict <> 'allow') > 1 THEN least(100, max(s) + (count(*) FILTER (verdict <> 'allow') - 1) * 5) ELSE max(s) END AS integer) AS risk_score,
  coalesce(string_agg(CASE WHEN verdict <> 'allow' THEN id END, ',' ORDER BY o), '') AS fired FROM c GROUP BY scan_id""", "payments")
def agg_1(spark, sf):
    third = lambda n: F.col("seq") % n == 0
    d = view(spark, sf, "payments").withColumn("checks", collect(
        check("pii", 0, "a", F.when(third(5), "block").otherwise("allow"), F.when(third(5), "critical").otherwise("info")),
        check("replay", 0, "b", F.when(third(3), "flag").otherwise("allow"), F.when(third(3), "medium").otherwise("info")),
        when(third(2), check("overpay", 0, "c", "flag", "low"))))
    return aggregate_verdicts(explode_checks(d)).withColumn("fired", F.array_join("fired", ","))


@query("prj_15_advisory", """WITH p AS (SELECT seq, direction, CASE WHEN seq % 7 = 0 THEN 'block' WHEN seq % 3 = 0 THEN 'flag' ELSE 'allow' END AS verdict FROM payments),
a(verdict, outgoing, advisory) AS (VALUES ('allow', true, 'No issue was found. The result is advice; settling stays with the wallet.'),
  ('allow', false, 'No issue was found. The result is advice; settling stays with the wallet.'),
  ('flag', true, 'Review the flagged checks and confirm the intent before settling.'),
  ('flag', false, 'Review the flagged checks and verify the counterparty before acting on this request.'),
  ('block', true, 'Do not settle this payment: a check found signs of theft or leakage.'),
  ('block', false, 'Do not comply with this payment request: a check found signs of fraud.'))
SELECT seq, p.verdict, advisory FROM p JOIN a ON a.verdict = p.verdict AND a.outgoing = (direction = 'outgoing')""", "payments")
def prj_15(spark, sf):
    """The advice for every payment."""
    return decisions(spark, sf).select("seq", "verdict", S.advisory("direction", "verdict").alias("advisory"))


@query("top_3_newest_n", "SELECT pay_to, seq FROM payments QUALIFY row_number() OVER (PARTITION BY pay_to ORDER BY ms DESC, seq DESC) <= 5", "payments")
def top_3(spark, sf):
    return W.newest_n(view(spark, sf, "payments"), ["pay_to"], 5, "ms", "seq").select("pay_to", "seq")


@query("top_4_retention", f"SELECT seq FROM payments WHERE ms >= {AS_OF} - 10 * 86400000 ORDER BY ms DESC, seq DESC LIMIT 500", "payments")
def top_4(spark, sf):
    return L.apply_retention(view(spark, sf, "payments"), order=("ms", "seq"), max_rows=500, ttl_ms=10 * DAY_MS, as_of=AS_OF).select("seq")


# ---------------------------------------------------------------- approvals

def approvals(spark, sf):
    return view(spark, sf, "approvals").withColumn("decided_ms", F.col("created_ms") + F.col("latency_ms"))


_RING = ("r AS (SELECT *, row_number() OVER (PARTITION BY account_hash ORDER BY created_ms + latency_ms DESC, approval_id DESC) AS n FROM approvals WHERE status IN ('approved', 'denied') QUALIFY n <= 50)")


@query("agg_16_approval_telemetry", f"""WITH {_RING}, t AS (SELECT account_hash, count(*) AS decided, CAST(floor(median(latency_ms) + 0.5) AS bigint) AS median_ms, CAST(quantile_disc(latency_ms, 0.9) AS bigint) AS p90_ms,
  count(*) FILTER (n <= 20) AS recent_count, round(count(*) FILTER (n <= 20 AND status = 'approved') / count(*) FILTER (n <= 20), 4) AS recent_approval_rate,
  count(*) FILTER (n > 20) AS baseline_count FROM r GROUP BY account_hash), q AS (SELECT account_hash, count(*) AS requested, count(*) FILTER (status = 'approved') AS approved, count(*) FILTER (status = 'denied') AS denied FROM approvals GROUP BY account_hash)
SELECT q.*, decided, median_ms, p90_ms, recent_count, recent_approval_rate, baseline_count FROM q LEFT JOIN t USING (account_hash)""", "approvals")
def agg_16(spark, sf):
    d = AP.approval_telemetry(approvals(spark, sf))
    return d.select("account_hash", "requested", "approved", "denied", "decided", "median_ms", "p90_ms", "recent_count", "recent_approval_rate", "baseline_count")


@query("win_10_recent_ring", f"WITH {_RING} SELECT approval_id, CAST(n AS integer) AS ring_no, n <= 20 AS is_recent FROM r", "approvals")
def win_10(spark, sf):
    d = approvals(spark, sf).filter("status in ('approved', 'denied')")
    return W.recent_ring(d, ["account_hash"], 50, 20, ("decided_ms", "approval_id")).select("approval_id", "ring_no", "is_recent")


@query("join_13_approval_outcomes", "SELECT a.approval_id, o.outcome AS delivery_outcome FROM approvals a LEFT JOIN outcome_reports o USING (scan_id)", "approvals", "outcome_reports")
def join_13(spark, sf):
    return AP.join_approval_outcomes(approvals(spark, sf), view(spark, sf, "outcome_reports")).select("approval_id", "delivery_outcome")


@query("scr_4_open_approvals", f"WITH {_DEC} SELECT scan_id, ms AS created_ms, ms + 600000 AS expires_ms, CASE WHEN row_number() OVER (ORDER BY ms, seq) <= 40 THEN 'pending' ELSE 'refused' END AS status FROM d WHERE verdict = 'flag' AND account_hash IN (SELECT account_hash FROM accounts WHERE plan IS NOT NULL)", "payments", "accounts")
def scr_4(spark, sf):
    cfg = ScreenConfig(approvals_max=40)                    # a table that fills up
    flags, asked = decisions(spark, sf), view(spark, sf, "accounts").filter("plan is not null")
    both = AP.open_approvals(flags, asked, cfg).unionByName(AP.refused_approvals(flags, asked, cfg))
    return both.select("scan_id", "created_ms", "expires_ms", "status")


@query("scr_5_decide_approvals", """SELECT seq, CASE WHEN (seq % 90) * 10000 + 1000 < 600000 AND seq % 3 < 2 THEN CASE WHEN seq % 2 = 0 THEN 'approved' ELSE 'denied' END ELSE 'expired' END AS status,
  CASE WHEN (seq % 90) * 10000 + 1000 < 600000 AND seq % 3 < 2 THEN (seq % 90) * 10000 + 1000 END AS latency_ms FROM approvals""", "approvals")
def scr_5(spark, sf):
    a = view(spark, sf, "approvals").withColumns({"status": F.lit("pending"), "original_verdict": F.lit("flag")}).drop("latency_ms")
    said = a.filter("seq % 3 < 2").select("approval_id", F.expr("CASE WHEN seq % 2 = 0 THEN 'approve' ELSE 'deny' END").alias("decision"),
                                          (F.col("created_ms") + (F.col("seq") % 90) * 10_000 + 1000).alias("at_ms"))
    late = said.withColumns({"at_ms": F.col("at_ms") + 1, "decision": F.lit("deny")})
    return AP.decide_approvals(a, said.unionByName(late), AS_OF).select("seq", "status", "latency_ms")


# ---------------------------------------------------------------- decision log

_LOGSQL = f"""b AS (SELECT event_id + 1 AS seq, concat('{{"seq":', CAST(event_id + 1 AS varchar), ',"scan_id":"scan-', CAST(event_id AS varchar), '"}}') AS body FROM events),
l AS (SELECT seq, body, sha256(body) AS entry_hash, coalesce(lag(sha256(body)) OVER (ORDER BY seq), '{GENESIS_HASH}') AS prev_hash FROM b)"""


def log(spark, sf):
    """A log whose hashes cover the row bodies; links point at the row before."""
    d = table(spark, sf, "events").select((F.col("event_id") + 1).alias("seq"), F.format_string('{"seq":%d,"scan_id":"scan-%d"}', F.col("event_id") + 1, F.col("event_id")).alias("body"))
    d = d.withColumn("entry_hash", F.sha2("body", 256))
    p = d.select((F.col("seq") + 1).alias("seq"), F.col("entry_hash").alias("prev_hash"))
    d = d.join(p, "seq", "left").withColumn("prev_hash", F.coalesce("prev_hash", F.lit(GENESIS_HASH)))
    return d.withColumn("raw", F.concat(F.regexp_replace("body", r"\}$", ""), F.lit(',"entry_hash":"'), "entry_hash", F.lit('"}')))


@query("win_7_chain_links", f"WITH {_LOGSQL} SELECT seq, CASE WHEN seq % 100 = 0 THEN false ELSE true END AS linked FROM l")
def win_7(spark, sf):
    d = log(spark, sf).withColumn("prev_hash", F.when(F.col("seq") % 100 == 0, "00").otherwise(F.col("prev_hash")))
    return AU.chain_links(d).select("seq", (F.col("previous_hash") == F.col("prev_hash")).alias("linked"))


@query("scr_7_verify_chain", f"WITH {_LOGSQL} SELECT true AS ok, count(*) AS count, CAST(NULL AS bigint) AS broken_at, CAST(NULL AS varchar) AS reason FROM l")
def scr_7(spark, sf):
    return AU.verify_chain(log(spark, sf))


@query("scr_7_verify_tampered", "SELECT false AS ok, count(*) AS count, CAST(500 AS bigint) AS broken_at, 'entry_hash does not match content' AS reason FROM events")
def scr_7_bad(spark, sf):
    d = log(spark, sf).withColumn("raw", F.when(F.col("seq") % 500 == 0, F.replace("raw", F.lit("scan-"), F.lit("scam-"))).otherwise(F.col("raw")))
    return AU.verify_chain(d)


@query("scr_7_verify_dropped", "SELECT false AS ok, count(*) - 1 AS count, CAST(321 AS bigint) AS broken_at, 'seq mismatch' AS reason FROM events")
def scr_7_gap(spark, sf):
    return AU.verify_chain(log(spark, sf).filter("seq <> 321"))


@query("agg_18_chain_head", f"WITH {_LOGSQL} SELECT max(seq) AS seq, arg_max(entry_hash, seq) AS hash FROM l")
def agg_18(spark, sf):
    return AU.chain_head(log(spark, sf))


@query("src_7_compare_exports", "SELECT count(*) AS old_count, count(*) FILTER (event_id % 900 <> 5) AS new_count, count(*) FILTER (event_id % 900 = 5 OR event_id % 700 = 3) AS changed, "
                                "min(event_id + 1) FILTER (event_id % 900 = 5 OR event_id % 700 = 3) AS first_changed, true AS shrank, true AS alarm FROM events")
def src_7(spark, sf):
    old = log(spark, sf)
    new = old.filter("(seq - 1) % 900 <> 5").withColumn("entry_hash", F.when((F.col("seq") - 1) % 700 == 3, "x").otherwise(F.col("entry_hash")))
    return AU.compare_audit_exports(old, new)


# ---------------------------------------------------------------- sources and sinks round trips

_ENVELOPE = """to_json(named_struct('agent_id', agent_key, 'expected_price_usd', expected_price_usd, 'payment', named_struct('amount_usd', amount_usd, 'pay_to', pay_to, 'nonce', nonce,
 'scheme', CASE WHEN seq % 5 = 0 THEN repeat('s', 120) ELSE 'exact' END, 'metadata', map('a', scan_id)), 'context', named_struct('origin', CASE WHEN seq % 3 = 0 THEN 'odd' ELSE 'planning' END, 'phase', 'pre_sign')))"""


@query("src_1_coerce_payments", """SELECT seq, agent_key AS agent_id, amount_usd, pay_to, nonce, length(CASE WHEN seq % 5 = 0 THEN repeat('s', 100) ELSE 'exact' END) AS scheme_length, scan_id AS meta,
  CASE WHEN seq % 3 = 0 THEN 'unknown' ELSE 'planning' END AS origin FROM payments WHERE seq % 10 > 0""", "payments")
def src_1(spark, sf):
    raw = view(spark, sf, "payments").select("seq", "scan_id", "ms", "direction", F.expr(f"CASE WHEN seq % 10 = 0 THEN '[1]' ELSE {_ENVELOPE} END").alias("raw"))
    good, _ = SP.coerce_payments(raw)
    return good.select("seq", "agent_id", "amount_usd", "pay_to", "nonce", F.length("scheme").cast("bigint").alias("scheme_length"), F.col("metadata")["a"].alias("meta"), "origin")


@query("src_1_rejects", "SELECT seq FROM payments WHERE seq % 10 = 0", "payments")
def src_1_bad(spark, sf):
    raw = view(spark, sf, "payments").select("seq", F.expr(f"CASE WHEN seq % 10 = 0 THEN '[1]' ELSE {_ENVELOPE} END").alias("raw"))
    return SP.coerce_payments(raw)[1].select("seq")


@query("src_8_offers", "SELECT seq, CAST(seq % 9 AS varchar) || '00000' AS amount, pay_to, concat('https://', domain) AS resource_url FROM payments", "payments")
def src_8(spark, sf):
    d = view(spark, sf, "payments").select("seq", F.expr("concat('{\"maxAmountRequired\":', CASE WHEN seq % 2 = 0 THEN concat('\"', seq % 9, '00000\"') ELSE concat(seq % 9, '00000') END, ',\"payTo\":\"', pay_to, '\"}')").alias("entry"),
                                           F.concat(F.lit("https://"), "domain").alias("request_url"))
    d = d.withColumn("entry", F.when(F.col("seq") % 9 == 0, F.regexp_replace("entry", r'":0+,', '":"000000",')).otherwise(F.col("entry")))
    return SP.payments_from_offers(d).select("seq", "amount", "pay_to", "resource_url")


@query("src_9_authorizations", "SELECT seq, 'eip155:8453' AS network, pay_to, agent_key AS payer, CAST(seq AS varchar) AS amount FROM payments WHERE seq % 3 < 2 AND agent_key IS NOT NULL", "payments")
def src_9(spark, sf):
    d = view(spark, sf, "payments").filter("agent_key is not null").select("seq", F.expr("""CASE seq % 3 WHEN 0 THEN concat('{"primaryType":"TransferWithAuthorization","domain":{"chainId":8453},"message":{"to":"', pay_to, '","from":"', agent_key, '","value":"', seq, '"}}')
      WHEN 1 THEN concat('{"primaryType":"Permit","domain":{"chainId":"8453"},"message":{"spender":"', pay_to, '","owner":"', agent_key, '","value":', seq, '}}') ELSE '{"primaryType":"Mail"}' END""").alias("typed"))
    return SP.payments_from_authorizations(d)[0].select("seq", "network", "pay_to", "payer", "amount")


@query("src_3_write_decisions", f"WITH {_DEC} SELECT scan_id, verdict, strftime(make_timestamp(ms * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS ts FROM d", "payments", "accounts")
def src_3(spark, sf):
    ws = Workspace(spark)
    d = decisions(spark, sf).withColumns({"risk_score": F.lit(0), "payment_sha256": F.sha2("scan_id", 256), "network": F.lit("eip155:8453")})
    IO.write_decisions(d, ws.path + "/log")
    return spark.read.parquet(ws.path + "/log").select("scan_id", "verdict", "ts")


@query("src_2_read_audit_log", f"WITH {_LOGSQL} SELECT seq, entry_hash, seq AS pos FROM l")
def src_2(spark, sf):
    ws = Workspace(spark)
    log(spark, sf).repartitionByRange(4, "seq").sortWithinPartitions("seq").select("raw").write.text(ws.path + "/log")
    return IO.read_audit_log(spark, ws.path + "/log", with_position=True).select("seq", "entry_hash", "pos")


_EXPORTED = """SELECT 'reports' AS ledger, address AS k, coalesce(reporter, '') AS who, reported_ms AS ms FROM reports
UNION ALL SELECT 'incidents', address, observer, ms FROM incidents
UNION ALL SELECT 'scan_index', scan_id, pay_to, ms FROM payments
UNION ALL SELECT 'pins', domain, max(pay_to), min(ms) FROM payments GROUP BY domain
UNION ALL SELECT 'scan_counts', pay_to, CAST(count(*) AS varchar), max(ms) FROM payments GROUP BY pay_to"""


# one JSON document in part files, with texts that look like its own syntax
@query("src_4_load_snapshot", _EXPORTED, "payments", "reports", "incidents")
def src_4(spark, sf):
    ws = Workspace(spark)
    pay, iso = view(spark, sf, "payments"), lambda c: S.iso_utc(c)
    odd = F.lit('pay, "quoted" {[ here\\, "pins":{"x":"')
    entry = lambda k, v: F.concat(F.to_json(F.array(k)).substr(F.lit(2), F.length(F.to_json(F.array(k))) - 2), F.lit(":"), v)
    members = {
        "reports": ("[", "]", view(spark, sf, "reports").select(F.to_json(F.struct(
            "address", "category", odd.alias("reason"), F.col("reporter").alias("reporter_agent_id"), iso("reported_ms").alias("reported_at"))).alias("e"))),
        "injection_incidents": ("{", "}", view(spark, sf, "incidents").select(entry(F.col("scan_id"), F.to_json(F.array(F.struct(
            "address", "check_id", odd.alias("origin"), "observer", "scan_id", iso("ms").alias("at"))))).alias("e"))),
        "scan_index": ("{", "}", pay.select(entry(F.col("scan_id"), F.to_json(F.struct(odd.alias("commitment"), "pay_to", "domain", iso("ms").alias("at")))).alias("e"))),
        "pins": ("{", "}", pay.groupBy("domain").agg(F.max("pay_to").alias("pay_to"), F.min("ms").alias("ms")).select(
            entry(F.col("domain"), F.to_json(F.struct("pay_to", iso("ms").alias("first_seen")))).alias("e"))),
        "scan_counts": ("{", "}", pay.groupBy("pay_to").agg(F.count("*").alias("scans"), F.min("ms").alias("a"), F.max("ms").alias("b")).select(
            entry(F.col("pay_to"), F.to_json(F.struct("scans", iso("a").alias("first_at"), iso("b").alias("last_at")))).alias("e")))}
    lines = None
    for at, (name, (opening, closing, rows)) in enumerate(members.items()):
        rows = ws.materialize(rows.withColumn("k", F.monotonically_increasing_id()), name)
        first = rows.agg(F.min("k").alias("first"))
        body = rows.join(first).select(F.lit(at).alias("at"), "k", F.concat(F.when(F.col("k") == F.col("first"), "").otherwise(","), "e").alias("value"))
        frame = spark.createDataFrame([(at, -1, f'{"," if at else "{"}"{name}":{opening}'), (at, 2**63 - 1, closing + ("}" if at == len(members) - 1 else ""))],
                                      "at int, k bigint, value string")
        lines = body.unionByName(frame) if lines is None else lines.unionByName(body).unionByName(frame)
    lines.repartitionByRange(4, "at", "k").sortWithinPartitions("at", "k").select("value").write.text(ws.path + "/snapshot")
    led = SN.snapshot_ledgers(SN.load_snapshot(spark, ws.path + "/snapshot", ws))
    row = lambda df, name, k, who, ms: df.select(F.lit(name).alias("ledger"), F.col(k).alias("k"), F.coalesce(F.col(who) if isinstance(who, str) else who, F.lit("")).alias("who"), F.col(ms).alias("ms"))
    return (row(led.reports, "reports", "address", "reporter", "reported_ms")
            .unionByName(row(led.incidents.filter(F.col("origin") == odd), "incidents", "address", "observer", "ms"))
            .unionByName(row(led.scan_index.filter(F.col("commitment") == odd), "scan_index", "scan_id", "pay_to", "ms"))
            .unionByName(row(led.pins, "pins", "domain", "pay_to", "ms"))
            .unionByName(row(led.scan_counts, "scan_counts", "pay_to", F.col("scans").cast("string"), "last_ms")))


@query("src_5_save_load_ledgers", f"SELECT address, category, reporter, reported_ms FROM reports", "reports")
def src_5(spark, sf):
    version = IO.save_ledgers({"reports": view(spark, sf, "reports"), "badlist": view(spark, sf, "badlist")}, Workspace(spark).path)
    return IO.load_ledgers(spark, version)["reports"]


@query("src_6_read_badlist", "SELECT address FROM badlist", "badlist")
def src_6(spark, sf):
    ws = Workspace(spark)
    view(spark, sf, "badlist").select(F.concat(F.lit('"'), F.upper("address"), F.lit('"'))).write.text(ws.path + "/bad")
    return IO.read_badlist(spark, ws.path + "/bad").select("address")


# ---------------------------------------------------------------- attestations and authorisations

@query("prj_16_attestations", """SELECT seq, concat_ws('|', scan_id, direction, 'allow', '0', strftime(make_timestamp(ms * 1000), '%Y-%m-%dT%H:%M:%S.%gZ'), sha256(scan_id), strftime(make_timestamp((ms + 300000) * 1000), '%Y-%m-%dT%H:%M:%S.%gZ')) AS message,
  sha256(scan_id) AS att_commitment, CAST(0 AS double) AS att_risk FROM payments""", "payments")
def prj_16(spark, sf):
    d = view(spark, sf, "payments").withColumns({"verdict": F.lit("allow"), "risk_score": F.lit(0), "payment_commitment": F.sha2("scan_id", 256), "pin_domain": F.lit(None).cast("string"),
                                                 "pin_age_seconds": F.lit(None).cast("bigint"), "pin_corroboration": F.lit(None).cast("string")})
    return PO.parse_attestations(PO.format_attestation(d)).select("seq", "message", "att_commitment", "att_risk")


@query("det_28_attestations", """SELECT seq, CASE WHEN seq % 11 = 0 THEN 'signature invalid' WHEN seq % 7 = 0 THEN 'message does not match the scan' WHEN seq % 5 = 0 THEN 'commitment belongs to another payment'
  WHEN ms + 300000 <= 1705000000000 THEN 'expired' WHEN seq % 3 = 0 THEN 'pin mirror differs' END AS failure FROM payments""", "payments")
def det_28(spark, sf):
    d = view(spark, sf, "payments").withColumns({"verdict": F.lit("allow"), "risk_score": F.lit(0), "payment_commitment": F.sha2("scan_id", 256), "pin_domain": F.col("domain"),
                                                 "pin_age_seconds": F.col("seq"), "pin_corroboration": F.lit("cdp_bazaar")})
    d = PO.format_attestation(d)
    d = d.withColumn("pin_mirror", F.concat(F.lit('{"domain":"'), "domain", F.lit('","age_seconds":'), F.when(F.col("seq") % 3 == 0, F.col("seq") + 1).otherwise(F.col("seq")).cast("string"), F.lit(',"corroboration":["cdp_bazaar"]}')))
    att = d.select("seq", "scan_id", "message", "evidence_message", (F.col("seq") % 11 > 0).alias("signature_ok"), F.lit(True).alias("evidence_signature_ok"), "pin_mirror")
    scans = d.select("scan_id", "direction", F.when(F.col("seq") % 7 == 0, "flag").otherwise("allow").alias("verdict"), "risk_score", "scanned_at")
    pays = d.select("scan_id", F.when(F.col("seq") % 5 == 0, F.lit("00")).otherwise(F.col("payment_commitment")).alias("payment_commitment"))
    return PO.audit_attestations(att, scans, pays, 1_705_000_000_000).select("seq", "failure")


@query("det_29_authorizations", """WITH a AS (SELECT seq, ms, nonce FROM payments WHERE seq % 2 = 0), v AS (SELECT seq, ms, nonce FROM payments WHERE seq % 2 = 1 AND seq % 3 > 0),
j AS (SELECT a.seq, a.ms, v.seq AS vid, v.ms AS vms FROM a ASOF LEFT JOIN v ON v.nonce = a.nonce AND v.ms <= a.ms), k AS (SELECT *, row_number() OVER (PARTITION BY vid ORDER BY ms, seq) AS n, min(ms) OVER (PARTITION BY vid) AS f FROM j)
SELECT seq, CASE WHEN vid IS NULL THEN 'no accepted verdict' WHEN n > 1 AND f < vms + 43200000 THEN 'verdict already used' WHEN n > 1 THEN 'no accepted verdict' WHEN ms >= vms + 43200000 THEN 'verdict is stale' END AS violation FROM k""", "payments")
def det_29(spark, sf):
    p = view(spark, sf, "payments")
    auths = p.filter("seq % 2 = 0").select("seq", "ms", F.col("nonce").alias("commitment"))
    ok = p.filter("seq % 2 = 1").select("seq", "ms", F.col("nonce").alias("commitment"), F.when(F.col("seq") % 3 > 0, "allow").otherwise("flag").alias("verdict"), (F.col("ms") + 43_200_000).alias("expires_ms"))
    return PO.audit_authorizations(auths, ok).select("seq", "violation")
