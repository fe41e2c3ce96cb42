"""Full screening on a stream, and the rule for late rows."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import ScreenConfig
from ..plans.screen import Ledgers, learned, merge_learned, screen
from ..session import Workspace
from ..sources.ledger_io import load_ledgers, save_ledgers

#: Runs of one level that are merged into one of the next: a row is rewritten once a level, and a reader opens at most this many runs a level.
FANOUT = 8


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _live_runs(spark: SparkSession, ledger_dir: str, before: int | None = None) -> list:
    """Runs that make up the history after the last batch before ``before``, oldest first: rows (pos, level, path, as_of)."""
    p, fs = _fs(spark, f"{ledger_dir}/_runs")
    if not fs.exists(p):
        return []
    done = [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(p)
            if "=" in s.getPath().getName() and fs.exists(_fs(spark, f"{s.getPath()}/_SUCCESS")[0])]
    done = [b for b in done if before is None or b < before]
    if not done:
        return []
    return spark.read.schema("pos int, level int, path string, as_of bigint").json(f"{ledger_dir}/_runs/batch={max(done)}").orderBy("pos").collect()


def _history(spark: SparkSession, runs: list, cfg: ScreenConfig) -> dict[str, DataFrame]:
    return merge_learned([load_ledgers(spark, r.path) for r in runs], cfg, max(r.as_of for r in runs)) if runs else {}


def current_ledgers(spark: SparkSession, ledger_dir: str, before: int | None = None, cfg: ScreenConfig = ScreenConfig()) -> Ledgers:
    """The history that the batches before ``before`` (all, if not given) have left, merged from its runs."""
    return Ledgers(**_history(spark, _live_runs(spark, ledger_dir, before), cfg))


def _append_run(spark: SparkSession, ledger_dir: str, batch_id: int, rows: dict[str, DataFrame], cfg: ScreenConfig, as_of: int) -> None:
    """Write what a batch taught as a run, merge full levels, and make the list of live runs the batch's last act."""
    runs = [(r.level, r.path, r.as_of) for r in _live_runs(spark, ledger_dir, batch_id)]
    runs.append((0, save_ledgers(rows, f"{ledger_dir}/ledgers"), as_of))
    while len(runs) >= FANOUT and len({r[0] for r in runs[-FANOUT:]}) == 1:
        full, runs = runs[-FANOUT:], runs[:-FANOUT]
        newest = max(r[2] for r in full)
        merged = merge_learned([load_ledgers(spark, r[1]) for r in full], cfg, newest)
        runs.append((full[0][0] + 1, save_ledgers(merged, f"{ledger_dir}/ledgers"), newest))
    listed = [(k, *r) for k, r in enumerate(runs)]
    spark.createDataFrame(listed, "pos int, level int, path string, as_of bigint").coalesce(1).write.mode("overwrite").json(f"{ledger_dir}/_runs/batch={batch_id}")


def vacuum_ledgers(spark: SparkSession, ledger_dir: str, keep: int = 10) -> int:
    """Delete all but the newest ``keep`` lists of runs and every run that none of these names; returns the number of runs deleted.

    Not to be called while a batch is being written: its runs are in no list yet.
    """
    if keep < 2:
        raise ValueError("a repeated batch reads the list before its own: keep at least 2")
    p, fs = _fs(spark, f"{ledger_dir}/_runs")
    if not fs.exists(p):
        return 0
    lists = sorted((s.getPath() for s in fs.listStatus(p) if "=" in s.getPath().getName()), key=lambda x: int(x.getName().split("=")[1]))
    for old in lists[:-keep]:
        fs.delete(old, True)
    named = {r.path.rsplit("/", 1)[1] for x in lists[-keep:] for r in spark.read.schema("path string").json(x.toString()).collect()}
    dead = [s.getPath() for s in fs.listStatus(_fs(spark, f"{ledger_dir}/ledgers")[0]) if s.getPath().getName() not in named]
    for d in dead:
        fs.delete(d, True)
    return len(dead)


def stream_screen(payments: DataFrame, ledger_dir: str, checkpoint: str, cfg: ScreenConfig = ScreenConfig(), fixed: Ledgers | None = None, once: bool = True):
    """Screen a stream of payments batch by batch.

    Each micro-batch is screened with the ledgers left by the batches before. Decisions go to a folder named after the batch. What the batch
    taught is appended as a run of its own; ``FANOUT`` runs of a level are merged into one of the next, so a batch writes what it adds and a row
    is rewritten about log(batches) times in all. A batch that is repeated after a failure overwrites its own output and list of runs and starts
    from the same history. ``fixed`` holds tables that do not change (bad list, accounts, ratings, reports); where it names a ledger
    that batches add to, that ledger's rows are read from ``fixed`` alone.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch.isEmpty():
            return
        led = current_ledgers(spark, ledger_dir, batch_id, cfg)
        for f in fields(Ledgers):
            if fixed is not None and getattr(fixed, f.name) is not None:
                setattr(led, f.name, getattr(fixed, f.name))
        ws = Workspace(spark)
        result = screen(batch.drop("ts"), led, cfg, ws)
        result.decisions.write.mode("overwrite").parquet(f"{ledger_dir}/decisions/batch={batch_id}")
        result.checks.write.mode("overwrite").parquet(f"{ledger_dir}/checks/batch={batch_id}")
        _append_run(spark, ledger_dir, batch_id, learned(result, led), cfg, batch.agg(F.max("ms")).first()[0])
        ws.close()

    w = payments.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def split_late(batch: DataFrame, watermark_ms: int) -> tuple[DataFrame, DataFrame]:
    """(on time, late) rows of a micro-batch: rows older than the watermark go to a side output, never into windows."""
    late = F.col("ms") < F.lit(watermark_ms)
    return batch.filter(~late), batch.filter(late)


def stream_split_late(df: DataFrame, delay_ms: int, on_time: str, late: str, checkpoint: str, once: bool = True):
    """Route rows by an event-time watermark that trails the newest time of earlier batches by ``delay_ms``."""
    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        marks = f"{checkpoint}/_marks"
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(marks)
        seen = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
        top = spark.read.schema("id bigint, ms bigint").json(marks).filter(F.col("id") < batch_id).agg(F.max("ms")).first()[0] if seen else None
        good, old = split_late(batch, (top if top is not None else -(2**62)) - delay_ms)
        good.write.mode("overwrite").parquet(f"{on_time}/batch={batch_id}")
        old.write.mode("overwrite").parquet(f"{late}/batch={batch_id}")
        newest = batch.agg(F.max("ms")).first()[0]
        if newest is not None:
            spark.createDataFrame([(batch_id, max(newest, top or newest))], "id bigint, ms bigint").coalesce(1).write.mode("append").json(marks)

    w = df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
