"""Ledgers: complaints, disputes, incidents and delivery outcomes, and what a scan reads back from them.

Distinct reporters, map counts and capped lists are built by two-level grouping, so a heavily reported address is
pre-aggregated before any of its rows meet.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..config import DAY_MS, HALF_LIFE_DAYS, HOUR_MS, OUTCOMES, REPORT_CATEGORIES, ScreenConfig
from ..functions import patterns as P
from ..functions.scalars import col, credibility, decay, let, risk_grade, smoothed_rate, trimmed
from .checks import check, collect, first_of, when
from .windows import first_rows, newest_n, running_totals, spread_null

_LATE = 2**63 - 1                     # a record without a row number counts only for later milliseconds
_EPOCH = 1_700_000_000_000            # reference point of decayed sums; any fixed time gives the same weights


# ---------------------------------------------------------------- complaints and disputes

def ingest_reports(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) complaints. The first of an (address, category, reporter) is kept; rejects say why."""
    d = raw.withColumn("address", F.lower(trimmed(F.substring("address", 1, 200))))
    d = d.withColumn("reason", F.substring("reason", 1, 1000)).withColumn("reporter", F.substring("reporter", 1, 200))
    why = (F.when(F.coalesce(F.length("address"), F.lit(0)) < 6, "address is required")
           .when(~F.coalesce(F.col("category").isin(*REPORT_CATEGORIES), F.lit(False)), "unknown category")
           .when(F.coalesce(F.length("reporter"), F.lit(0)) == 0, "reporter is required")
           .when(F.coalesce(F.length("reason"), F.lit(0)) < 10, "reason is too short"))
    d = d.withColumn("rejected_because", why)
    good = d.filter(F.col("rejected_because").isNull()).drop("rejected_because")
    return first_reports(good), d.filter(F.col("rejected_because").isNotNull())


def first_reports(reports: DataFrame) -> DataFrame:
    """First report per (address, category, reporter), by map-side minimum."""
    rest = [c for c in reports.columns if c not in ("address", "category", "reporter", "reported_ms")]
    g = reports.groupBy("address", "category", "reporter").agg(F.min(F.struct("reported_ms", *rest)).alias("f"))
    return g.select("address", "category", "reporter", "f.*")


def ingest_disputes(raw: DataFrame) -> DataFrame:
    """Verified rebuttals of EVM addresses, distinct statements of 10-1000 characters."""
    d = raw.withColumn("address", F.lower(trimmed("address"))).withColumn("statement", trimmed("statement"))
    d = d.filter(F.col("address").rlike(P.EVM_ADDRESS) & F.length("statement").between(10, 1000) & F.col("verified"))
    return d.groupBy("address", "statement").agg(F.min("disputed_ms").alias("disputed_ms"))


def recent_disputes(disputes: DataFrame, n: int = 5) -> DataFrame:
    """The newest ``n`` statements per address, newest first."""
    top = newest_n(disputes, ["address"], n, "disputed_ms", "statement")
    return top.groupBy("address").agg(F.array_sort(F.collect_list(F.struct((-F.col("disputed_ms")).alias("at"), "statement"))).alias("s")).select(
        "address", F.size("s").alias("dispute_count"), F.transform("s", lambda s: s["statement"]).alias("statements"))


def _voices(df: DataFrame, key: str, voice: str, time: str, counterparties: DataFrame | None, as_of) -> DataFrame:
    """Weight per address: over distinct voices, credibility times decay of the newest record."""
    per = df.groupBy(key, voice).agg(F.max(time).alias("_newest"), F.min(time).alias("_first"), F.count("*").alias("_n"))
    if counterparties is not None:
        seen = counterparties.groupBy(F.col("agent_key").alias(voice)).agg(F.count("*").alias("_seen"))
        per = per.join(seen, voice, "left")
    else:
        per = per.withColumn("_seen", F.lit(0))
    return per.withColumn("_w", credibility("_seen") * decay("_newest", F.lit(as_of)))


def _count_map(df: DataFrame, key: str, what: str, name: str) -> DataFrame:
    """Map of counts per value of a small domain."""
    c = df.groupBy(key, what).agg(F.count("*").alias("_n"))
    return c.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(what, "_n")))).alias(name))


def summarize_reports(reports: DataFrame, counterparties: DataFrame | None = None, as_of: int = 0) -> DataFrame:
    """Complaint summary per address: counts, distinct reporters, categories, weighted score and risk grade."""
    r = first_reports(reports.select("address", "category", "reporter", "reported_ms"))
    per = _voices(r, "address", "reporter", "reported_ms", counterparties, as_of)
    s = per.groupBy("address").agg(F.sum("_n").alias("report_count"), F.count("*").alias("distinct_reporters"),
                                   F.round(F.sum("_w"), 2).alias("weighted_score"), F.min("_first").alias("first_reported_ms"),
                                   F.max("_newest").alias("last_reported_ms"))
    s = s.withColumn("risk", risk_grade("weighted_score"))
    return s.join(_count_map(r, "address", "category", "categories"), "address")


def summarize_incidents(incidents: DataFrame, counterparties: DataFrame | None = None, as_of: int = 0, keep: int | None = None) -> DataFrame:
    """Incident summary per address: one voice per observer, counts per check, weighted score; with ``keep`` of the newest ones only."""
    i = first_incidents(incidents)
    i = i if keep is None else newest_n(i, ["address"], keep, "ms", "observer")
    per = _voices(i, "address", "observer", "ms", counterparties, as_of)
    s = per.groupBy("address").agg(F.sum("_n").alias("incident_count"), F.count("*").alias("distinct_observers"),
                                   F.round(F.sum("_w"), 2).alias("weighted_score"), F.min("_first").alias("first_ms"), F.max("_newest").alias("last_ms"))
    return s.join(_count_map(i, "address", "check_id", "check_counts"), "address")


def first_incidents(incidents: DataFrame) -> DataFrame:
    """First incident per (address, observer) of an address-shaped subject."""
    d = incidents.withColumn("address", F.lower(trimmed("address"))).filter(F.col("address").rlike(P.IMPLICATED))
    rest = [c for c in ("seq", "check_id", "origin", "scan_id") if c in d.columns]
    return d.groupBy("address", "observer").agg(F.min(F.struct("ms", *rest)).alias("f")).select("address", "observer", "f.*")


def address_profile(addresses: DataFrame, reports: DataFrame, disputes: DataFrame, incidents: DataFrame, delivery: DataFrame) -> DataFrame:
    """One row per address from the four summaries; absent history stays null."""
    pre = lambda d, p: d.select("address", *[F.col(c).alias(f"{p}_{c}") for c in d.columns if c != "address"])
    out = addresses.select("address").distinct()
    for name, d in (("reports", reports), ("disputes", disputes), ("incidents", incidents)):
        out = out.join(pre(d, name), "address", "left")
    out = out.join(pre(delivery.withColumnRenamed("pay_to", "address"), "delivery"), "address", "left")
    return out.withColumn("status", F.when(F.col("reports_report_count") > 0, "reported").otherwise("clean")).withColumn(
        "risk", F.coalesce("reports_risk", F.lit("none")))


# ---------------------------------------------------------------- outcomes

def match_outcomes(reports: DataFrame, scan_index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matched, unmatched) outcome reports by (scan_id, commitment); a keyed scan answers only to its own account."""
    idx = scan_index.select("scan_id", "commitment", F.col("account_hash").alias("_owner"), "pay_to", "domain")
    own = reports.drop(*[c for c in ("pay_to", "domain") if c in reports.columns])
    j = own.join(idx, ["scan_id", "commitment"], "inner").filter(F.col("_owner").isNull() | F.col("_owner").eqNullSafe(F.col("account_hash")))
    matched = j.withColumn("reporter", F.coalesce("_owner", F.lit("anon"))).drop("_owner")
    lost = reports.join(matched.select("seq").distinct(), "seq", "left_anti").withColumn("reason", F.lit("unknown scan or commitment mismatch"))
    return matched, lost


def ingest_outcomes(reports: DataFrame, scan_index: DataFrame) -> DataFrame:
    """Every report with its ``status``: accepted, idempotent, conflict, unknown, invalid. The first report per scan is final."""
    valid = reports.filter(F.col("outcome").isin(*OUTCOMES))
    matched, lost = match_outcomes(valid, scan_index)
    first = matched.groupBy("scan_id").agg(F.min(F.struct("reported_ms", "seq", "outcome")).alias("f"))
    m = matched.join(first, "scan_id")
    status = F.when(F.col("f.seq") == F.col("seq"), "accepted").when(F.col("f.outcome") == F.col("outcome"), "idempotent").otherwise("conflict")
    m = m.withColumn("status", status).drop("f")
    rest = reports.filter(~F.coalesce(F.col("outcome").isin(*OUTCOMES), F.lit(False))).withColumn("status", F.lit("invalid"))
    cols = ["seq", "scan_id", "outcome", "reported_ms", "settlement_receipt", "status"]
    nulls = lambda d: d.select(*cols, *[F.lit(None).cast("string").alias(c) for c in ("pay_to", "domain", "reporter")])
    return (m.select(*cols, "pay_to", "domain", "reporter").unionByName(nulls(lost.withColumn("status", F.lit("unknown"))))
            .unionByName(nulls(rest)))


def accepted_outcomes(reports: DataFrame, scan_index: DataFrame) -> DataFrame:
    return ingest_outcomes(reports, scan_index).filter("status = 'accepted'").drop("status")


def _counters() -> list[Column]:
    return [F.sum(f"_{k}").alias(k) for k in OUTCOMES] + [F.sum("_receiptless").alias("receiptless"),
                                                          F.min("_first").alias("first_ms"), F.max("_last").alias("last_ms")]


def _per_voice(accepted: DataFrame, keys: list[str]) -> DataFrame:
    return accepted.groupBy(*keys, "reporter").agg(
        *[F.count_if(F.col("outcome") == k).alias(f"_{k}") for k in OUTCOMES],
        F.count_if(F.col("settlement_receipt") == "absent").alias("_receiptless"),
        F.min("reported_ms").alias("_first"), F.max("reported_ms").alias("_last"))


def _at_most(n: Column, most: int | None) -> Column:
    return n if most is None else F.least(n, F.lit(most))


def outcomes_by_payee(accepted: DataFrame, max_reporters: int | None = None) -> DataFrame:
    """Delivery ledger per payee. Two-level grouping: per (payee, reporter) first."""
    d = _per_voice(accepted.filter(F.length("pay_to") > 0), ["pay_to"])
    return d.groupBy("pay_to").agg(*_counters(), _at_most(F.count("*"), max_reporters).alias("distinct_reporters"))


def outcomes_by_domain(accepted: DataFrame, max_reporters: int | None = None, max_payees: int | None = None) -> DataFrame:
    """Delivery ledger per domain with the payees it used, oldest first (with ``max_payees`` only so many are listed)."""
    d = accepted.filter(F.col("domain").isNotNull() & (F.length("pay_to") > 0))
    led = _per_voice(d, ["domain"]).groupBy("domain").agg(*_counters(), _at_most(F.count("*"), max_reporters).alias("distinct_reporters"))
    used = d.groupBy("domain", "pay_to").agg(F.min(F.struct("reported_ms", "seq")).alias("_o"))
    if max_payees is not None:
        used = used.withColumn("_r", F.row_number().over(W.partitionBy("domain").orderBy("_o"))).filter(F.col("_r") <= max_payees)
    used = used.groupBy("domain").agg(F.array_sort(F.collect_list(F.struct("_o", "pay_to"))).alias("p")).select(
        "domain", F.transform("p", lambda p: p["pay_to"]).alias("pay_tos"))
    return led.join(used, "domain")


def total_of() -> Column:
    return reduce(lambda a, b: a + b, [F.col(k) for k in OUTCOMES])


def with_rates(ledger: DataFrame, cfg: ScreenConfig = ScreenConfig()) -> DataFrame:
    d = ledger.withColumn("outcomes_total", total_of()).filter(F.col("outcomes_total") > 0)
    return (d.withColumn("delivery_rate", F.round(F.col("delivered") / F.col("outcomes_total"), 4))
            .withColumn("smoothed_delivery_rate", F.round(smoothed_rate("delivered", "outcomes_total", cfg.delivery_prior_rate,
                                                                        cfg.delivery_prior_strength), 4)))


def scan_counts(decisions: DataFrame) -> DataFrame:
    """Non-blocked scans per payee: the denominator of report coverage."""
    d = decisions.filter((F.col("verdict") != "block") & (F.length("pay_to") > 0))
    return d.groupBy(F.lower("pay_to").alias("pay_to")).agg(F.count("*").alias("scans"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"))


def delivery_summary(by_payee: DataFrame, counts: DataFrame, cfg: ScreenConfig = ScreenConfig()) -> DataFrame:
    """Rates and report coverage per payee; payees that were scanned but never reported appear with zero outcomes."""
    c = counts.select("pay_to", F.col("scans").alias("scans_seen"), F.col("first_ms").alias("scans_tracked_since_ms"))
    j = with_rates(by_payee, cfg).join(c, "pay_to", "full_outer")
    j = j.withColumn("outcomes_total", F.coalesce("outcomes_total", F.lit(0))).withColumn("scans_seen", F.coalesce("scans_seen", F.lit(0)))
    cover = F.when(F.col("scans_seen") > 0, F.round(F.least(F.lit(1.0), F.col("outcomes_total") / F.nullif("scans_seen", F.lit(0))), 4))
    return j.withColumn("report_coverage", cover)


def cumulative_spend(payments: DataFrame) -> DataFrame:
    """Scanned spend per (agent, payee), blocked rows included."""
    from .windows import money
    d = payments.filter(F.col("agent_key").isNotNull() & F.col("pay_to_lc").isNotNull() & (F.col("usd") > 0))
    return d.groupBy("agent_key", "pay_to_lc").agg(F.sum(money("usd")).cast("double").alias("usd"), F.count("*").alias("scans"),
                                                   F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"))


def failure(total="outcomes_total", delivered="delivered", bad=None, smoothed="smoothed_delivery_rate", cfg: ScreenConfig = ScreenConfig()) -> Column:
    """``struct<kind, severity>`` when the record is bad: failures without a delivery, or a low smoothed rate."""
    bad = F.col("not_delivered") + F.col("wrong_content") if bad is None else bad
    sev = lambda high: F.when(high, "high").otherwise("medium")
    none = (bad >= 3) & (col(delivered) == 0)
    low = (col(total) >= cfg.delivery_min_outcomes) & (col(smoothed) < cfg.delivery_flag_rate)
    return (F.when(none, F.struct(F.lit("no_confirmed").alias("kind"), sev(bad >= cfg.delivery_min_outcomes).alias("severity")))
            .when(low, F.struct(F.lit("low_rate").alias("kind"), sev(col(smoothed) < cfg.delivery_flag_rate / 2).alias("severity"))))


# ---------------------------------------------------------------- what a scan reads back

def reputation_finding(count="report_count", score="weighted_score", risk="risk", payee="pay_to_lc", disputes=None) -> Column:
    p, n = col(payee), F.coalesce(col(count), F.lit(0))
    facts = {"report_count": n, "weighted_score": col(score)}
    if disputes is not None:
        facts["disputes"] = col(disputes)
    return first_of(
        (F.coalesce(F.length(p), F.lit(0)) == 0, check("reputation", 0, "reputation.no_address", "allow", "info")),
        (n == 0, check("reputation", 0, "reputation.clean", "allow", "info")),
        (F.coalesce(col(risk), F.lit("none")) == "none", check("reputation", 0, "reputation.decayed", "allow", "info", facts)),
        check("reputation", 0, "reputation.reported", "flag", col(risk), facts))


def history_finding(score, count) -> Column:
    s = col(score)
    sev = F.when(s >= 1.0, "high").when(s >= 0.5, "medium").otherwise("low")
    return collect(when(s > 0.1, check("history", 0, "reputation.injection_history", "flag", sev, {"incident_count": col(count), "weighted_score": s})))


def delivery_findings(d: str = "", cfg: ScreenConfig = ScreenConfig(), domain_bad: Column | None = None, domain_other: Column | None = None) -> Column:
    """Findings of the payee's record, receipts, and the domain's record under other payees.

    Reads ``outcomes_total, delivered, not_delivered, partial, wrong_content, receiptless, smoothed_delivery_rate``
    with the given prefix; ``domain_bad`` is the failure struct of the domain ledger.
    """
    c = lambda n: F.col(d + n)
    has = F.coalesce(c("outcomes_total") > 0, F.lit(False))
    record = failure(c("outcomes_total"), c("delivered"), c("not_delivered") + c("wrong_content"), c("smoothed_delivery_rate"), cfg)
    facts = {"outcomes_total": c("outcomes_total"), "delivered": c("delivered"), "smoothed_delivery_rate": c("smoothed_delivery_rate")}
    most = (c("receiptless") * 2 >= c("outcomes_total")) & (c("receiptless") >= 3)

    def findings(both):
        bad, elsewhere = both["bad"], both["elsewhere"]
        flagged = has & bad.isNotNull()
        out = [F.when(flagged, check("delivery", 0, F.concat(F.lit("delivery."), bad["kind"]), "flag", bad["severity"], facts))
               .when(has, check("delivery", 0, "delivery.history", "allow", "info", facts)),
               when(has & (c("receiptless") > 0), check("delivery", 1, "delivery.receiptless_settlement", "flag",
                                                        F.when(most, "high").otherwise("medium"),
                                                        {"receiptless": c("receiptless"), "outcomes_total": c("outcomes_total")}))]
        if domain_bad is not None:
            out.append(when(~flagged & elsewhere.isNotNull() & F.coalesce(domain_other, F.lit(False)),
                            check("delivery", 2, "delivery.rotated_history", "flag", elsewhere["severity"], {"domain": F.col("domain")})))
        return collect(*out)

    return let(F.struct(record.alias("bad"), (F.lit(None) if domain_bad is None else domain_bad).alias("elsewhere")), findings)


ADDRESS_MEASURES = ("rep_w", "rep_n", "inc_w", "inc_n", "delivered", "not_delivered", "partial", "wrong_content", "receiptless")


def _voice_events(df: DataFrame, voice: str, time: str, counterparties: DataFrame | None) -> DataFrame:
    """Change of an address's weight at each record: a voice counts with its newest record only."""
    w = W.partitionBy("address", voice).orderBy(time)
    d = df.withColumn("_prev", F.lag(time).over(w))
    if counterparties is not None:
        seen = counterparties.groupBy(F.col("agent_key").alias(voice)).agg(F.count("*").alias("_seen"))
        d = d.join(seen, voice, "left")
    else:
        d = d.withColumn("_seen", F.lit(0))
    grow = lambda t: F.pow(F.lit(2.0), (t - _EPOCH) / float(DAY_MS * HALF_LIFE_DAYS))
    return d.withColumn("_dw", credibility("_seen") * (grow(F.col(time)) - F.coalesce(grow(F.col("_prev")), F.lit(0.0))))


def address_events(reports: DataFrame | None, incidents: DataFrame | None, outcomes: DataFrame | None,
                   counterparties: DataFrame | None = None) -> DataFrame | None:
    """One time line of all records about an address, as changes of ADDRESS_MEASURES."""
    parts = []
    zero = {m: F.lit(0.0) for m in ADDRESS_MEASURES}

    def add(d, **given):
        m = {**zero, **given}
        at = F.col("seq").cast("bigint") if "seq" in d.columns else F.lit(_LATE)
        parts.append(d.select("address", "ms", at.alias("seq"), *[m[k].cast("double").alias(k) for k in ADDRESS_MEASURES]))

    if reports is not None:
        r = first_reports(reports.select("address", "category", "reporter", "reported_ms"))
        add(_voice_events(r, "reporter", "reported_ms", counterparties).withColumnRenamed("reported_ms", "ms"), rep_w=F.col("_dw"), rep_n=F.lit(1.0))
    if incidents is not None:
        add(_voice_events(first_incidents(incidents), "observer", "ms", counterparties), inc_w=F.col("_dw"), inc_n=F.lit(1.0))
    if outcomes is not None:
        o = outcomes.filter(F.length("pay_to") > 0).select(F.col("pay_to").alias("address"), F.col("reported_ms").alias("ms"), "outcome", "settlement_receipt")
        add(o, receiptless=(F.col("settlement_receipt") == "absent").cast("int"), **{k: (F.col("outcome") == k).cast("int") for k in OUTCOMES})
    return reduce(DataFrame.unionByName, parts) if parts else None


def read_back(rows: DataFrame, key: str, events: DataFrame | None, measures: tuple, prefix: str,
              base: DataFrame | None = None) -> DataFrame:
    """Running sums of the events strictly before each row, on one shared time line per key.

    ``base`` is a cheap copy of the rows (key, ms, seq) for the bucket totals.
    """
    names = [prefix + m for m in measures]
    if events is None:
        return rows.withColumns({n: F.lit(0.0) for n in names})

    def line(d):
        cols = d.columns
        left = d.select(*cols, F.col("ms").alias("_t"), F.col("seq").alias("_s"), F.lit(0).alias("_side"),
                        *[F.lit(0.0).alias(f"_{m}") for m in measures])
        right = events.select(*[F.col(events.columns[0]).alias(c) if c == key else F.lit(None).cast(d.schema[c].dataType).alias(c) for c in cols],
                              F.col("ms").alias("_t"), F.col("seq").alias("_s"), F.lit(1).alias("_side"), *[F.col(m).alias(f"_{m}") for m in measures])
        return left.unionByName(right).withColumn("_k", spread_null(key))

    d = running_totals(line(rows), ["_k"], {n: F.col(f"_{m}") for n, m in zip(names, measures)},
                       base=None if base is None else line(base.select(key, "ms", "seq")),
                       order=("_t", "_s", "_side"), unit_ms=DAY_MS)
    return d.filter("_side = 0").select(*rows.columns, *names)


def decayed(weight, as_of="ms") -> Column:
    """A running weight brought to the row's time, at two decimals."""
    return F.round(col(weight) * F.pow(F.lit(2.0), (F.lit(_EPOCH) - col(as_of)) / float(DAY_MS * HALF_LIFE_DAYS)), 2)


DOMAIN_MEASURES = ("payees", "delivered", "not_delivered", "partial", "wrong_content")


def domain_events(outcomes: DataFrame) -> DataFrame:
    """Time line of a domain's outcomes; ``payees`` counts the first outcome of every payee."""
    d = outcomes.filter(F.col("domain").isNotNull() & (F.length("pay_to") > 0))
    o = d.select("domain", F.col("reported_ms").alias("ms"), F.lit(_LATE).alias("seq"), F.lit(0.0).alias("payees"), *[(F.col("outcome") == k).cast("double").alias(k) for k in OUTCOMES])
    first = d.groupBy("domain", "pay_to").agg(F.min("reported_ms").alias("ms"))
    return o.unionByName(first.select("domain", "ms", F.lit(_LATE).alias("seq"), F.lit(1.0).alias("payees"), *[F.lit(0.0).alias(k) for k in OUTCOMES]))


def domain_first_payee(outcomes: DataFrame) -> DataFrame:
    d = outcomes.filter(F.col("domain").isNotNull() & (F.length("pay_to") > 0))
    return d.groupBy("domain").agg(F.min_by("pay_to", F.struct("reported_ms", "seq")).alias("_first_payee"))


def join_rotated_history(rows: DataFrame, by_domain: DataFrame, cfg: ScreenConfig = ScreenConfig()) -> DataFrame:
    """Adds ``rotated_severity`` when the domain's ledger is bad and was earned under another payee."""
    led = with_rates(by_domain, cfg).withColumn("_bad", failure(cfg=cfg)).select("domain", "_bad", "pay_tos")
    d = rows.join(led, "domain", "left")
    other = F.exists("pay_tos", lambda a: a != F.col("pay_to_lc"))
    return d.withColumn("rotated_severity", F.when(other, F.col("_bad.severity"))).drop("_bad", "pay_tos")


def distinct_voices(df: DataFrame, key: str, voice: str) -> DataFrame:
    return df.select(key, voice).distinct().groupBy(key).agg(F.count(voice).alias("voices"))


def apply_retention(table: DataFrame, *, keys: list[str] | None = None, order: tuple = ("ms",), max_rows: int | None = None,
                    ttl_ms: int | None = None, as_of: int | None = None, keep: Column | None = None) -> DataFrame:
    """Retention job: drop rows older than the TTL, then the oldest beyond ``max_rows`` (per key when keys are given).

    ``keep`` marks rows that are never dropped (approvals still in flight). Without keys the cut-off is found from counts
    per hour of the first order column (epoch milliseconds), and only the hour it falls in is ranked.
    """
    safe = F.lit(False) if keep is None else keep
    d = table
    if ttl_ms is not None:
        d = d.filter(safe | (F.col(order[0]) >= F.lit(as_of) - ttl_ms))
    if max_rows is not None:
        held = d.filter(safe) if keep is not None else None
        rest = d.filter(~safe) if keep is not None else d
        rest = newest_n(rest, keys, max_rows, *order) if keys else first_rows(rest, max_rows, HOUR_MS, *order, newest=True)[0]
        d = rest if held is None else held.unionByName(rest)
    return d
