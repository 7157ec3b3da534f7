"""What the operators of this folder share: narrowed inputs and stored results."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanledger.session import checkpoint_root

#: White space of the word rules: blank and the control characters 9 to 13.
BLANKS = " \t\n\x0b\x0c\r"


#: What crosses to a Python task at once, so that long texts bound its memory too.
BATCH_SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "5000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, after telling its session to hand rows to Python tasks in small batches."""
    for key, value in BATCH_SETTINGS.items():
        if df.sparkSession.conf.get(key, None) != value:
            df.sparkSession.conf.set(key, value)
    return df


def released(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` of a Python task that gives its memory back at the end, as the process goes on to other tasks."""

    def run(frames: Iterator) -> Iterator:
        try:
            yield from work(frames)
        finally:
            gc.collect()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return run


def texts(messages: DataFrame, id_column: str = "id", content: str = "content") -> DataFrame:
    """Only ``id`` (long) and ``content`` of the messages, whatever else they carry."""
    return in_small_batches(messages).select(
        messages[id_column].cast("long").alias("id"), messages[content].cast("string").alias("content")
    )


def text_key(text: Column) -> Column:
    """A stand-in for a text in joins: rows with equal id and text have equal results."""
    return F.xxhash64(text)


def stored(df: DataFrame, name: str, *partition: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it from there.

    Cuts the lineage, so a lost executor costs no earlier stage, and what is used
    twice is computed once.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
