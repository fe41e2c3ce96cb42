"""Hash-chained decision log: links, verification, head and comparison of exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import GENESIS_HASH


def chain_links(log: DataFrame) -> DataFrame:
    """Adds ``previous_hash`` (the entry_hash of seq-1, the genesis value for seq 1) by an equi-join, never by a global window."""
    prev = log.groupBy((F.col("seq") + 1).alias("seq")).agg(F.max("entry_hash").alias("_p"))
    d = log.join(prev, "seq", "left")
    return d.withColumn("previous_hash", F.when(F.col("seq") == 1, F.lit(GENESIS_HASH)).otherwise(F.col("_p"))).drop("_p")


def entry_digest(raw="raw"):
    """SHA-256 of the raw line without its trailing entry_hash member."""
    return F.sha2(F.regexp_replace(F.col(raw), r',"entry_hash":"[^"]*"\}\s*\z', "}"), 256)


def verify_chain(log: DataFrame) -> DataFrame:
    """One row ``ok, count, broken_at, reason`` for ``seq, prev_hash, entry_hash, raw`` and, where known, the line position ``pos``.

    With a position every line must carry its own number. Without one, a gap or a repeated number is the break.
    """
    d = chain_links(log)
    bad_hash = entry_digest() != F.col("entry_hash")
    if "pos" in log.columns:
        misplaced, at = F.col("seq") != F.col("pos"), F.col("pos")
        gaps = None
    else:
        dup = log.groupBy("seq").agg(F.count("*").alias("_n"))
        d = d.join(dup, "seq")
        misplaced, at = F.lit(False), F.col("seq")
        # the smallest missing number, if a larger one is present
        present = log.select("seq").distinct()
        follow = present.select((F.col("seq") + 1).alias("seq")).unionByName(log.sparkSession.range(1, 2).select(F.col("id").alias("seq")))
        missing = follow.join(present, "seq", "left_anti").agg(F.min("seq").alias("broken_at"))
        gaps = missing.join(log.agg(F.max("seq").alias("_last")), F.lit(True)).filter("broken_at < _last").select(
            "broken_at", F.lit("seq mismatch").alias("reason"))
        repeats = d.filter("_n > 1").agg((F.min("seq") + 1).alias("broken_at")).filter("broken_at is not null").withColumn("reason", F.lit("seq mismatch"))
        gaps = gaps.unionByName(repeats)
    why = (F.when(misplaced, "seq mismatch").when(~F.col("prev_hash").eqNullSafe(F.col("previous_hash")), "prev_hash does not match previous entry")
           .when(bad_hash, "entry_hash does not match content"))
    rank = F.when(F.col("reason") == "seq mismatch", 0).when(F.col("reason").startswith("prev"), 1).otherwise(2)
    breaks = d.select(at.alias("broken_at"), why.alias("reason")).filter("reason is not null")
    if gaps is not None:
        breaks = breaks.unionByName(gaps)
    first = breaks.agg(F.min(F.struct("broken_at", rank.alias("r"), "reason")).alias("b"))
    total = log.agg(F.count("*").alias("count"))
    return total.join(first, F.lit(True)).select(F.col("b").isNull().alias("ok"), "count", F.col("b.broken_at").alias("broken_at"), F.col("b.reason").alias("reason"))


def chain_head(log: DataFrame) -> DataFrame:
    """Last seq and hash, for anchoring outside."""
    return log.agg(F.max("seq").alias("seq"), F.max_by("entry_hash", "seq").alias("hash"))


def compare_audit_exports(old: DataFrame, new: DataFrame) -> DataFrame:
    """Alarm row: record counts of two exports, whether the log shrank and how many earlier records changed or vanished."""
    gone = old.select("seq", "entry_hash").join(new.select("seq", "entry_hash"), ["seq", "entry_hash"], "left_anti")
    counts = old.agg(F.count("*").alias("old_count")).join(new.agg(F.count("*").alias("new_count")), F.lit(True)).join(
        gone.agg(F.count("*").alias("changed"), F.min("seq").alias("first_changed")), F.lit(True))
    return counts.withColumn("shrank", F.col("new_count") < F.col("old_count")).withColumn("alarm", F.col("shrank") | (F.col("changed") > 0))
