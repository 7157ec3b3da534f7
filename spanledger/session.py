"""Session settings shared by jobs, tests and the benchmark."""

from __future__ import annotations

import contextlib
import tempfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot key even where that costs one more shuffle afterwards.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Sizes are guessed from compressed files, before rows are made of their rows: what
    # counts as 10 MB may be a hundred times as much once the driver builds it.
    "spark.sql.autoBroadcastJoinThreshold": "256k",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.replaceHashWithSortAgg": "false",
}

#: For the queries on drawings: rows that a window has sorted by key are grouped as they come.
GROUPED = SQL_SETTINGS | {"spark.sql.execution.replaceHashWithSortAgg": "true"}

ROCKSDB_PROVIDER = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)


def local_session(cpus: str = "*", app: str = "spanledger", memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and measurements.

    A cluster job brings its own session and calls ``tune`` instead.
    """
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    )
    for key, value in SQL_SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_root(spark)
    return spark


def tune(spark: SparkSession, settings: dict[str, str] = SQL_SETTINGS) -> SparkSession:
    """Apply the runtime SQL settings the operators rely on to a given session."""
    for key, value in settings.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


@contextlib.contextmanager
def held_settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Settings for the jobs that run inside; the session's own come back after."""
    before = {key: spark.conf.get(key, None) for key in settings}
    tune(spark, settings)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash rows over the cores where the input has fewer splits than cores.

    A table in many files passes unchanged; only a small one, read by a few tasks,
    is shuffled before costly row-wise work.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Hash rows by ``keys`` into as many partitions as the session's shuffles have.

    For rows that each become many: adaptive merging would size the partitions by the
    few, and a task would hold all that they become.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def checkpoint_root(spark: SparkSession) -> str:
    """The folder for durable cuts.

    The cluster names a shared folder in ``spark.checkpoint.dir``. Only on one machine
    (tests, a laptop), where neither that nor an earlier call set one, a local one is
    used; on a cluster its absence is an error.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if not folder:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spanledger-checkpoint-")
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()
