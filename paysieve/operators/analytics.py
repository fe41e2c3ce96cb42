"""Usage analytics over decisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..config import DAY_MS, ScreenConfig


def day_of(ms="ms"):
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col(ms) / DAY_MS).cast("int"))


def decision_stats(decisions: DataFrame, approximate: bool = False) -> DataFrame:
    """One row of totals by verdict, direction and party, distinct agents, scanned USD, first and last time."""
    first = F.coalesce(F.col("first_party"), F.lit(False)) if "first_party" in decisions.columns else F.lit(False)
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    v = F.col("verdict")
    return decisions.agg(
        F.count("*").alias("count"), *[F.count_if(v == k).alias(k) for k in ("allow", "flag", "block")],
        *[F.count_if(F.col("direction") == k).alias(k) for k in ("outgoing", "incoming")],
        distinct("agent_id").alias("distinct_agents"),
        F.round(F.sum(F.col("logged_usd").cast("decimal(38,12)")), 2).cast("double").alias("total_scanned_usd"),
        F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"),
        F.count_if(first).alias("first_party_count"), F.count_if(~first).alias("third_party_count"),
        *[F.count_if(first & (v == k)).alias(f"first_party_{k}") for k in ("allow", "flag", "block")],
        *[F.count_if(~first & (v == k)).alias(f"third_party_{k}") for k in ("allow", "flag", "block")],
        distinct(F.when(first, F.col("agent_id"))).alias("first_party_agents"), distinct(F.when(~first, F.col("agent_id"))).alias("third_party_agents"))


def decision_cube(decisions: DataFrame) -> DataFrame:
    """Counts for every combination of verdict, direction and party, with subtotals (null = all)."""
    return decisions.cube("verdict", "direction", "first_party").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def daily_series(decisions: DataFrame, days: int, as_of: int) -> DataFrame:
    """The last ``days`` UTC days including today with total and blocked scans, zero-filled."""
    spark = decisions.sparkSession
    today = as_of // DAY_MS
    cal = spark.range(today - days + 1, today + 1).select(F.date_add(F.lit("1970-01-01").cast("date"), F.col("id").cast("int")).alias("day"))
    per = decisions.filter(F.col("ms") >= (today - days + 1) * DAY_MS).groupBy(day_of().alias("day")).agg(
        F.count("*").alias("total"), F.count_if(F.col("verdict") == "block").alias("block"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return cal.join(per, "day", "left").select("day", zero("total"), zero("block"))


def top_checks(decisions: DataFrame, k: int = 8) -> DataFrame:
    """The ``k`` most fired checks; ties go to the one seen first."""
    d = decisions.select("ms", "seq", F.posexplode("fired").alias("pos", "check_id"))
    g = d.groupBy("check_id").agg(F.count("*").alias("n"), F.min(F.struct("ms", "seq", "pos")).alias("_first"))
    return top_k(g, k, F.desc("n"), F.asc("_first")).drop("_first")


def top_k(df: DataFrame, k: int, *order) -> DataFrame:
    return df.orderBy(*order).limit(k)


def account_usage(decisions: DataFrame, accounts: DataFrame, cfg: ScreenConfig = ScreenConfig(), calls_used: str | None = None) -> DataFrame:
    """Scan counters, block rate and free calls left per account, accounts without scans included."""
    v = F.col("verdict")
    per = decisions.filter(F.col("account_hash").isNotNull()).groupBy("account_hash").agg(
        F.count("*").alias("total"), *[F.count_if(v == k).alias(k) for k in ("allow", "flag", "block")], F.max("ms").alias("last_used_ms"))
    d = accounts.join(per, "account_hash", "left")
    zero = [c for c in ("total", "allow", "flag", "block")]
    d = d.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in zero})
    used = F.col(calls_used) if calls_used else F.col("total")
    return (d.withColumn("block_rate", F.when(F.col("total") > 0, F.round(F.col("block") / F.nullif("total", F.lit(0)), 4)).otherwise(0.0))
            .withColumn("free_left", F.greatest(F.lit(0), F.lit(cfg.free_calls) - used)))


def owner_stats(usage: DataFrame, reports: DataFrame, pins: DataFrame, badlist: DataFrame, as_of: int) -> DataFrame:
    """One row: accounts, with plan, active within 7 days, keyed scans and registry sizes."""
    a = usage.agg(F.count("*").alias("accounts"), F.count_if(F.col("plan").isNotNull()).alias("with_plan"),
                  F.count_if(F.col("last_used_ms") > as_of - 7 * DAY_MS).alias("active_7d"),
                  *[F.sum(c).alias(f"keyed_{c}") for c in ("total", "allow", "flag", "block")])
    sizes = [d.agg(F.count("*").alias(n)) for n, d in (("reports", reports), ("pins", pins), ("badlist", badlist))]
    return reduce(lambda x, y: x.join(y, F.lit(True)), sizes, a)          # one-row frames


def split_party(decisions: DataFrame, accounts: DataFrame) -> DataFrame:
    """Adds ``first_party`` from the account's tag."""
    tag = accounts.select("account_hash", F.coalesce("first_party", F.lit(False)).alias("first_party"))
    return decisions.drop("first_party").join(tag, "account_hash", "left").withColumn("first_party", F.coalesce("first_party", F.lit(False)))


def agent_overlap(decisions: DataFrame, accounts: DataFrame) -> DataFrame:
    """Agents seen in decisions that are also tagged as the operator's own."""
    seen = decisions.select("agent_id").filter(F.length("agent_id") > 0)
    return seen.intersect(accounts.filter("first_party").select("agent_id").filter(F.length("agent_id") > 0))


def public_stats(decisions: DataFrame, accounts: DataFrame, usage: DataFrame | None = None, from_log: bool = True) -> DataFrame:
    """Totals with the operator's own share taken out; differences never fall below zero.

    ``usage`` (account counters, with ``first_party``) gives the own share; without a log it gives everything.
    """
    usage = account_usage(decisions, accounts) if usage is None else usage
    own = F.coalesce(F.col("first_party"), F.lit(False))
    fields = (("scans", "total"), ("blocked", "block"), ("flagged", "flag"))
    mine = usage.agg(*[F.coalesce(F.sum(F.when(own, F.col(c))), F.lit(0)).alias(f"first_party_{n}") for n, c in fields],
                     F.count_if(own & (F.col("total") > 0)).alias("first_party_agents"))
    if not from_log:
        every = usage.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in fields], F.count_if(F.col("total") > 0).alias("distinct_agents"),
                          *[F.coalesce(F.sum(F.when(~own, F.col(c))), F.lit(0)).alias(f"third_party_{n}") for n, c in fields],
                          F.count_if(~own & (F.col("total") > 0)).alias("third_party_agents"))
        return every.join(mine, F.lit(True))
    all_ = decisions.agg(F.count("*").alias("scans"), F.count_if(F.col("verdict") == "block").alias("blocked"),
                         F.count_if(F.col("verdict") == "flag").alias("flagged"),
                         F.count_distinct(F.when(F.length("agent_id") > 0, F.col("agent_id"))).alias("distinct_agents"), F.min("ms").alias("since_ms"))
    overlap = agent_overlap(decisions, accounts).agg(F.count("*").alias("_overlap"))
    d = all_.join(mine, F.lit(True)).join(overlap, F.lit(True))
    rest = lambda n: F.greatest(F.lit(0), F.col(n) - F.col(f"first_party_{n}"))
    return (d.withColumns({f"third_party_{n}": rest(n) for n, _ in fields})
            .withColumn("third_party_agents", F.greatest(F.lit(0), F.col("distinct_agents") - F.col("_overlap"))).drop("_overlap"))


def uptime(ranges: DataFrame, as_of: int, window_days: int = 90, live_grace_ms: int = 120_000, keys: tuple = ()) -> DataFrame:
    """Share of the trailing window covered by ranges, counted from the first covered moment."""
    start = as_of - window_days * DAY_MS
    a = F.greatest(F.col("from_ms"), F.lit(start))
    b = F.least(F.when(F.lit(as_of) - F.col("to_ms") <= live_grace_ms, F.lit(as_of)).otherwise(F.col("to_ms")), F.lit(as_of))
    d = ranges.withColumn("_a", a).withColumn("_b", b).filter("_b >= _a")
    g = d.groupBy(*keys).agg(F.sum(F.col("_b") - F.col("_a")).alias("_cov"), F.min("_a").alias("measured_since_ms"), F.count("*").alias("_n"))
    span = F.lit(as_of) - F.col("measured_since_ms")
    pct = F.when(span <= 0, 100.0).otherwise(F.least(F.lit(100.0), F.col("_cov") / F.nullif(span, F.lit(0)) * 100))
    return g.filter(F.col("measured_since_ms").isNotNull()).select(*keys, F.round(pct, 2).alias("pct"), "measured_since_ms",
                                                                   F.greatest(F.lit(0), F.col("_n") - 1).alias("interruptions"))


ADVISORY_CHECKS = ("injection.untrusted_origin", "injection.untrusted_origin_mitigated", "injection.unknown_origin", "injection.clean")


def detection_levels(checks: DataFrame, key: str = "scan_id") -> DataFrame:
    """Highest verdict per scan over content detection; provenance advice does not count."""
    d = checks.filter(F.col("check_id").rlike(r"^(?:injection|poison)\.") & ~F.col("check_id").isin(*ADVISORY_CHECKS))
    from ..functions.scalars import verdict_rank
    return d.groupBy(key).agg(F.max(verdict_rank("verdict")).alias("level"))


def evaluate_corpus(corpus: DataFrame, checks: DataFrame, by: tuple = ("kind",)) -> DataFrame:
    """Attacks that reached their minimum, benign cases within their maximum, known gaps open and closed."""
    from ..functions.scalars import verdict_rank
    d = corpus.join(detection_levels(checks), "scan_id", "left").withColumn("level", F.coalesce("level", F.lit(0)))
    want = verdict_rank("expect")
    ok = F.when(F.col("kind") == "attack", F.col("level") >= want).otherwise(F.col("level") <= want)
    gap = F.coalesce(F.col("known_gap"), F.lit(False))
    return d.groupBy(*by).agg(F.count_if(~gap).alias("gating"), F.count_if(~gap & ok).alias("passed"), F.count_if(gap & ok).alias("gaps_closed"),
                              F.count_if(gap & ~ok).alias("gaps_open"))
