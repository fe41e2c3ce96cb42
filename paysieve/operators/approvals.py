"""Human approvals of flagged scans: opening, deciding, telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import MINUTE_MS, OUTCOMES, ScreenConfig
from .windows import first_rows, recent_ring


def open_approvals(decisions: DataFrame, configs: DataFrame, cfg: ScreenConfig = ScreenConfig(), in_flight: int = 0) -> DataFrame:
    """Pending approvals of flagged, keyed scans whose account asked for them. See ``refused_approvals`` for a table with a limit."""
    return _opened(decisions, configs, cfg, in_flight)[0]


def refused_approvals(decisions: DataFrame, configs: DataFrame, cfg: ScreenConfig = ScreenConfig(), in_flight: int = 0) -> DataFrame:
    """The approvals that found the table full: same columns, status ``refused``."""
    return _opened(decisions, configs, cfg, in_flight)[1].withColumn("status", F.lit("refused"))


def _opened(decisions, configs, cfg, in_flight):
    d = decisions.filter((F.col("verdict") == "flag") & F.col("account_hash").isNotNull())
    d = d.join(configs.select("account_hash").distinct(), "account_hash", "left_semi")
    # first come, first served over all accounts
    served, late = (d, d.limit(0)) if cfg.approvals_max is None else first_rows(d, max(0, cfg.approvals_max - in_flight), MINUTE_MS, "ms", "seq")
    return tuple(x.select(F.concat(F.lit("ap-"), "scan_id").alias("approval_id"), "account_hash", "scan_id", F.col("verdict").alias("original_verdict"),
                    F.lit("pending").alias("status"), F.col("ms").alias("created_ms"),
                    (F.col("ms") + cfg.approvals_ttl_minutes * MINUTE_MS).alias("expires_ms")) for x in (served, late))


def decide_approvals(approvals: DataFrame, decisions_in: DataFrame, as_of: int) -> DataFrame:
    """Approvals with their final status: the first timely decision wins, expiry beats a late one, only a flag can be approved."""
    first = decisions_in.filter(F.col("decision").isin("approve", "deny")).join(
        approvals.select("approval_id", "expires_ms", "original_verdict"), "approval_id").filter(
        (F.col("at_ms") < F.col("expires_ms")) & ((F.col("decision") == "deny") | (F.col("original_verdict") == "flag")))
    first = first.groupBy("approval_id").agg(F.min(F.struct("at_ms", "decision")).alias("f"))
    d = approvals.join(first, "approval_id", "left")
    status = (F.when(F.col("status") != "pending", F.col("status")).when(F.col("f.decision") == "approve", "approved")
              .when(F.col("f.decision") == "deny", "denied").when(F.col("expires_ms") <= as_of, "expired").otherwise("pending"))
    d = d.withColumn("status", status).withColumn("decided_ms", F.col("f.at_ms"))
    latency = F.when(F.col("decided_ms").isNotNull(), F.greatest(F.lit(0), F.col("decided_ms") - F.col("created_ms")))
    return d.withColumn("latency_ms", latency).drop("f")


def join_approval_outcomes(approvals: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Adds the delivery outcome of the approved scan, whichever of the two came first."""
    return approvals.join(outcomes.select("scan_id", F.col("outcome").alias("delivery_outcome")), "scan_id", "left")


def approval_telemetry(approvals: DataFrame, outcomes: DataFrame | None = None, ring: int = 50, recent: int = 20) -> DataFrame:
    """Per account: counts by status, latency of the newest ``ring`` decisions, newest against the rest, outcomes of approved ones."""
    status = F.col("status")
    counts = approvals.groupBy("account_hash").agg(F.count("*").alias("requested"), *[F.count_if(status == s).alias(s) for s in ("approved", "denied", "expired")])
    d = approvals.filter(status.isin("approved", "denied") & F.col("latency_ms").isNotNull())
    d = recent_ring(d, ["account_hash"], ring, recent, ("decided_ms", "approval_id"))
    d = join_approval_outcomes(d, outcomes) if outcomes is not None else d.withColumn("delivery_outcome", F.lit(None).cast("string"))
    yes, new = status == "approved", F.col("is_recent")
    mid = lambda c: F.floor(F.percentile(c, F.lit(0.5)) + 0.5).cast("bigint")
    lat = F.col("latency_ms")
    rate = lambda c: F.round(F.count_if(c & yes) / F.nullif(F.count_if(c), F.lit(0)), 4)
    t = d.groupBy("account_hash").agg(
        F.count("*").alias("decided"), mid(lat).alias("median_ms"), F.expr("percentile_disc(0.9) within group (order by latency_ms)").cast("bigint").alias("p90_ms"),
        F.count_if(new).alias("recent_count"), mid(F.when(new, lat)).alias("recent_median_ms"), rate(new).alias("recent_approval_rate"),
        F.count_if(~new).alias("baseline_count"), mid(F.when(~new, lat)).alias("baseline_median_ms"), rate(~new).alias("baseline_approval_rate"),
        *[F.count_if(yes & (F.col("delivery_outcome") == k)).alias(f"approved_{k}") for k in OUTCOMES],
        F.count_if(yes & ~F.coalesce(F.col("delivery_outcome").isin(*OUTCOMES), F.lit(False))).alias("approved_unreported"))
    return counts.join(t, "account_hash", "left")


def prune_approvals(approvals: DataFrame, as_of: int) -> DataFrame:
    """Expire overdue pending approvals and drop the settled ones a day after creation."""
    d = approvals.withColumn("status", F.when((F.col("status") == "pending") & (F.col("expires_ms") <= as_of), "expired").otherwise(F.col("status")))
    return d.filter((F.col("status") == "pending") | (F.lit(as_of) - F.col("created_ms") <= 24 * 60 * MINUTE_MS))
