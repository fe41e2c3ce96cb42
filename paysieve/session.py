"""Session defaults and the shared workspace used to cut long lineages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "paysieve", master: str | None = None, partitions: int | None = None,
                  driver_memory: str | None = None) -> SparkSession:
    """A session with adaptive execution and UTC; cluster settings win where they are already given."""
    b = (SparkSession.builder.appName(app)
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if master:
        b = b.master(master).config("spark.ui.enabled", "false")
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    if driver_memory:
        b = b.config("spark.driver.memory", driver_memory)
    return b.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only in local mode where it is unset."""
    sc = spark.sparkContext
    conf = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    known = sc._jsc.sc().getCheckpointDir()
    current = known.get() if known.isDefined() else None
    if conf is None and current is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        current = tempfile.mkdtemp(prefix="paysieve-")
    if current is None:
        current = conf
    if not known.isDefined():
        sc.setCheckpointDir(current)
    return conf or current


_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Workspace:
    """Materialises intermediate tables as Parquet below the shared checkpoint folder.

    Written tables survive lost executors, can be read column-wise by later steps and give the planner
    true sizes, so join strategies are picked from measured bytes and not from guesses.
    """

    def __init__(self, spark: SparkSession, free_shuffles: bool = False):
        self.spark, self.free_shuffles = spark, free_shuffles
        self.path = f"{checkpoint_root(spark).rstrip('/')}/paysieve-{uuid.uuid4().hex}"
        self._n, self._tables = 0, {}

    def materialize(self, df: DataFrame, label: str) -> DataFrame:
        """The rows as a written table. With ``free_shuffles`` the shuffle files of the write go with it: later steps read the table alone."""
        self._n += 1
        path = f"{self.path}/{self._n:03d}-{label}"
        was = self.spark.conf.get(_FREE_SHUFFLES, "false")
        self.spark.conf.set(_FREE_SHUFFLES, "true" if self.free_shuffles else was)
        try:
            df.write.mode("errorifexists").parquet(path)
        finally:
            self.spark.conf.set(_FREE_SHUFFLES, was)
        self._tables.setdefault(label, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def discard(self, *labels: str) -> None:
        """Delete the newest table of each label, if there is one; whatever was built on it has to be written by now."""
        for label in labels:
            if self._tables.get(label):
                self._delete(self._tables[label].pop())

    def close(self) -> None:
        """Delete the tables. Call once no result built on them is needed any more."""
        self._delete(self.path)

    def _delete(self, path: str) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
