"""Session, table access and the shared scratch folder that cuts lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "gridloom", **conf: str) -> SparkSession:
    """A session with the settings that every query expects (UTC, AQE, Arrow)."""
    b = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table `name` of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Where the setting is absent
    (tests, a single machine) a temporary folder stands in and is removed at exit."""
    root = spark.sparkContext.getConf().get(CHECKPOINT_KEY, None) or spark.conf.get(CHECKPOINT_KEY, None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    global _own
    if _own is None:
        _own = tempfile.mkdtemp(prefix="gridloom-")
        atexit.register(shutil.rmtree, _own, ignore_errors=True)
    return f"file://{_own}"


_own: str | None = None


class Scratch:
    """Tables written under the shared folder: they survive lost executors, keep
    their statistics for the planner, and drop the plan that made them."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/gridloom-{label}-{uuid.uuid4().hex[:12]}"
        self._n = 0

    def save(self, df: DataFrame, label: str = "t") -> DataFrame:
        return self.save_with(df, label)[0]

    def save_with(self, df: DataFrame, label: str, **metrics: Column) -> tuple[DataFrame, dict]:
        """The written table, and aggregates over it gathered while it was written."""
        self._n += 1
        path = f"{self.root}/{label}-{self._n}"
        seen = Observation() if metrics else None
        rows = df.observe(seen, *[c.alias(k) for k, c in metrics.items()]) if metrics else df
        rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._gridloom_path = path
        return out, seen.get if seen else {}

    def drop(self, df: DataFrame | None) -> None:
        path = getattr(df, "_gridloom_path", None)
        if path:
            jvm = self.spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def cpu_count() -> int:
    return int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1))
