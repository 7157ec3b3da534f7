"""Cutting lineage so that a lost executor costs little."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from spanledger.session import checkpoint_root

#: Settings under which tables of ``by_key`` with equally many parts are joined, grouped and scanned as they lie,
#: also by more columns than the key.
AS_DEALT = {
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
    "spark.sql.sources.bucketing.enabled": "true",
}


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from there."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def set_aside(df: DataFrame) -> DataFrame:
    """As ``durable``, as a Parquet table: far less room where texts repeat."""
    path = f"{checkpoint_root(df.sparkSession)}/aside-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_key(df: DataFrame, parts: int, key: str, *order: str) -> DataFrame:
    """``df`` in the shared checkpoint folder, dealt by a hash of ``key`` into ``parts`` files, sorted in each.

    Spark knows how the files were dealt, so that rows of a key need no further shuffle to
    meet. A key lies in one file: not for keys with more rows than a task should hold.
    """
    spark, name = df.sparkSession, f"dealt_{uuid.uuid4().hex}"
    path = f"{checkpoint_root(spark)}/{name}"
    df.repartition(parts, key).write.format("parquet").option("path", path).bucketBy(parts, key).sortBy(key, *order).saveAsTable(name)
    return spark.table(name)
