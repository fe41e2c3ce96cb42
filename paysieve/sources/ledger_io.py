"""Saved ledgers, the bad list and the decision log. Exported snapshots are read by ``snapshot``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..config import DAY_MS
from ..functions.scalars import iso_utc, number_text
from ..schemas import struct_of


def save_ledgers(tables: dict[str, DataFrame], root: str) -> str:
    """Write the tables as Parquet into a fresh version folder and return it. The marker is written last, so readers see whole versions."""
    version = f"{root.rstrip('/')}/v-{uuid.uuid4().hex}"
    spark = None
    for name, df in tables.items():
        if df is not None:
            spark = df.sparkSession
            df.write.mode("errorifexists").parquet(f"{version}/{name}")
    if spark is not None:
        names = [(n,) for n, d in tables.items() if d is not None]
        spark.createDataFrame(names, "name string").coalesce(1).write.json(f"{version}/_tables")
    return version


def load_ledgers(spark: SparkSession, version: str) -> dict[str, DataFrame]:
    """The tables of a version folder; fails when the version was not completed."""
    names = [r.name for r in spark.read.schema("name string").json(f"{version}/_tables").collect()]
    return {n: spark.read.parquet(f"{version}/{n}") for n in names}


def read_badlist(spark: SparkSession, path: str) -> DataFrame:
    """Known-bad addresses of a JSON array or JSON lines: strings only, lower case, distinct."""
    raw = spark.read.text(path, wholetext=False)
    arrays = F.try_variant_get(F.try_parse_json("value"), "$", "array<variant>")
    if raw.filter(F.trim("value").startswith("[")).limit(1).isEmpty():
        one = F.try_parse_json("value")
        items = raw.select(F.when(F.schema_of_variant(one) == "STRING", F.try_variant_get(one, "$", "string")).alias("a"))
    else:
        whole = spark.read.text(path, wholetext=True)
        items = whole.select(F.explode(arrays).alias("v")).select(F.when(F.schema_of_variant("v") == "STRING", F.try_variant_get("v", "$", "string")).alias("a"))
    return items.filter(F.col("a").isNotNull()).select(F.lower("a").alias("address")).distinct()


AUDIT = struct_of("seq bigint, ts string, scan_id string, direction string, verdict string, risk_score int, agent_id string, "
                  "payment_sha256 string, network string, pay_to string, amount_usd double, fired array<string>, first_party boolean, "
                  "prev_hash string, entry_hash string")


def read_audit_log(spark: SparkSession, path: str, with_position: bool = False) -> DataFrame:
    """Decision log lines with their raw text. ``with_position`` adds the line number ``pos`` without a global sort:
    lines are counted per file split, and the counts of earlier splits are added."""
    d = spark.read.text(path)
    if with_position:
        d = d.select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_o"),
                     F.monotonically_increasing_id().alias("_i")).filter(F.length(F.trim("value")) > 0)
        w = W.partitionBy("_f", "_o").orderBy("_i")
        sizes = d.groupBy("_f", "_o").agg(F.count("*").alias("_n"))
        sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_f", "_o").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        d = d.withColumn("_r", F.row_number().over(w)).join(sizes, ["_f", "_o"])
        d = d.select("value", (F.col("_before") + F.col("_r")).cast("bigint").alias("pos"))
    else:
        d = d.filter(F.length(F.trim("value")) > 0)
    rec = d.withColumn("_r", F.from_json("value", AUDIT)).withColumnRenamed("value", "raw")
    out = rec.select("raw", *(["pos"] if with_position else []), "_r.*")
    return out.withColumn("ms", F.unix_millis(F.try_to_timestamp("ts")))


def audit_records(decisions: DataFrame) -> DataFrame:
    """Log record of a decision without its chain: the payment appears only as a digest."""
    d = decisions.select(iso_utc("ms").alias("ts"), "scan_id", "direction", "verdict", "risk_score", "agent_id", "payment_sha256", "network", "pay_to",
                         F.col("logged_usd").alias("amount_usd"), "fired", "seq", "ms")
    return d.withColumn("day", F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("ms") / DAY_MS).cast("int")))


def write_decisions(decisions: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append decision records, partitioned by UTC day."""
    audit_records(decisions).write.mode("append").partitionBy("day").format(fmt).save(path)
