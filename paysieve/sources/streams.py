"""Streaming sources and sinks for payments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..schemas import PAYMENTS, conform


def stream_payments(spark: SparkSession, path: str, fmt: str = "json", schema: T.StructType = PAYMENTS, max_files: int | None = None) -> DataFrame:
    """Payments arriving as files, with an event-time column ``ts`` from ``ms``."""
    r = spark.readStream.schema(schema).format(fmt)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return with_event_time(r.load(path))


def stream_kafka(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Payments as JSON messages of a topic (needs the Kafka connector on the class path)."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return with_event_time(raw.select(F.from_json(F.col("value").cast("string"), PAYMENTS).alias("p")).select("p.*"))


def with_event_time(df: DataFrame) -> DataFrame:
    return (conform(df) if "payer" in df.columns else df).withColumn("ts", F.timestamp_millis("ms"))


def write_stream(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", mode: str = "append", once: bool = True):
    w = df.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start(path)
