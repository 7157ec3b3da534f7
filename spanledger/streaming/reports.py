"""The report chain of the stream: what a generate event sets off, once for each batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanledger.operators import forms as R
from spanledger.plans.durable import durable

#: Buckets of phones of the filed messages; a batch reads those of the phones whose sessions it closes.
BUCKETS = 64
#: Closed sessions of a batch for each shuffle partition of its reports.
SESSIONS_A_PART = 1_000

FILED = "phone {phone}, session_no int, msg_id bigint, ts timestamp, type string, category string, content string, batch bigint, bucket int"
CELLS = "phone {phone}, session_no int, fmt string, sheet string, cell string, value string, batch bigint"
LOG = (
    "phone {phone}, session_no int, fmt string, rule int, severity string, sheet string, cell string, found string, "
    "expected string, was_corrected boolean, batch bigint"
)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


class ReportChain:
    """Reports of the sessions that a stream of messages closes, kept under one folder.

    ``apply`` takes a micro-batch of the session machine's rows. It files the batch's
    messages, takes a snapshot of every session that a generate event closed, reads the
    record's fields from its notes, fills the form's cells, checks them against record
    and notes, corrects what can be corrected and logs the findings. What a batch
    writes lies in folders of its own, and its number enters the ledger last: a batch
    that was interrupted writes the same again, one that is in the ledger changes
    nothing.

    ``messages`` has phone, msg_id, ts, type and content of the stored messages.
    ``write`` stands for the writer of the report: it takes the expected cells (key,
    sheet, cell, expected) and gives those that were written (key, sheet, cell, value).
    """

    def __init__(self, root: str, messages: DataFrame, write: Callable[[DataFrame], DataFrame] | None = None):
        self.root, self.messages, self.spark = root, messages, messages.sparkSession
        self.write = write or (lambda cells: cells.withColumnRenamed("expected", "value"))
        self.phone = messages.schema["phone"].dataType.simpleString()

    def apply(self, done: DataFrame, batch: int) -> None:
        if not self.ledger().filter(F.col("batch") == batch).isEmpty():
            return
        rows = durable(done)
        self._file(rows, batch)
        closed = rows.filter("action = 'generate'").select("phone", "session_no", F.col("format").alias("fmt")).distinct()
        sessions = closed.count()
        if sessions:
            self._with_partitions(sessions, lambda: self._report(closed, batch))
        self._put(self.spark.createDataFrame([(True,)], "done boolean"), "ledger", batch)

    def ledger(self) -> DataFrame:
        """The batches that are done."""
        return _read(self.spark, f"{self.root}/ledger", "done boolean, batch bigint").select("batch")

    def filed(self) -> DataFrame:
        return _read(self.spark, f"{self.root}/filed", FILED.format(phone=self.phone))

    def cells(self) -> DataFrame:
        """The corrected cells of all reports."""
        return _read(self.spark, f"{self.root}/cells", CELLS.format(phone=self.phone)).drop("batch")

    def log(self) -> DataFrame:
        """What the checks found in all reports."""
        return _read(self.spark, f"{self.root}/log", LOG.format(phone=self.phone)).drop("batch")

    def _put(self, df: DataFrame, name: str, batch: int, *partition: str) -> None:
        df.write.mode("overwrite").partitionBy(*partition).parquet(f"{self.root}/{name}/batch={batch}")

    def _with_partitions(self, sessions: int, work: Callable[[], None]) -> None:
        """Run ``work`` with as many shuffle partitions as the sessions need: every step of a report runs through all of them."""
        name, conf = "spark.sql.shuffle.partitions", self.spark.conf
        given = conf.get(name)
        least = 2 * self.spark.sparkContext.defaultParallelism
        conf.set(name, min(int(given), max(least, -(-sessions // SESSIONS_A_PART))))
        try:
            work()
        finally:
            conf.set(name, given)

    def _bucket(self):
        return F.pmod(F.xxhash64("phone"), F.lit(BUCKETS)).cast("int")

    def _file(self, rows: DataFrame, batch: int) -> None:
        filed = rows.filter("action = 'filed'").select("phone", "session_no", "msg_id", "category")
        texts = self.messages.select("phone", "msg_id", "ts", "type", "content")
        filed = filed.join(texts, ["phone", "msg_id"]).withColumn("bucket", self._bucket())
        names = ["phone", "session_no", "msg_id", "ts", "type", "category", "content", "bucket"]
        self._put(filed.select(*names).repartition("bucket"), "filed", batch, "bucket")

    def _report(self, closed: DataFrame, batch: int) -> None:
        c, key = F.col, ["phone", "session_no"]
        buckets = [r[0] for r in closed.select(self._bucket().alias("b")).distinct().collect()]  # at most BUCKETS
        snapshot = self.filed().filter(c("bucket").isin(buckets)).join(closed, key, "left_semi")
        named = F.concat_ws("/", c("phone").cast("string"), c("session_no").cast("string"))
        details = durable(
            snapshot.filter("category = 'bridge_details' AND coalesce(content, '') <> ''")
            .select(named.alias("key"), "ts", "msg_id", "content")
        )
        said = R.sequential_fields(details, ["key", "ts", "msg_id"], "content")
        long = durable(
            said.groupBy("key", "field").agg(F.max_by("value", F.struct("ts", "msg_id", "seq")).alias("value"))
        )
        forms = closed.select(*key, named.alias("key"), "fmt")
        expected = durable(R.form_expected(long, forms.select("key", "fmt"), "key", R.form_map(self.spark)))
        written = durable(self.write(expected.select("key", "sheet", "cell", "expected")).select("key", "sheet", "cell", "value"))
        # The notes of one session, in their order.
        notes = details.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "msg_id", "content"))), lambda m: m["content"]), "\n").alias("raw"))
        issues = durable(
            R.lost_inputs(expected, written, "key")
            .unionByName(R.special_values_kept(expected, written, "key"))
            .unionByName(R.untraceable(written, R.value_set(long, "key"), "key"))
            .unionByName(R.raw_label_gaps(notes, "key", "raw", long))
        )
        cells = R.corrected_cells(written, issues, "key").join(forms, "key")
        self._put(cells.select(*key, "fmt", "sheet", "cell", "value"), "cells", batch)
        found = issues.withColumn("was_corrected", c("auto_fixable") & c("rule").isin(1, 2, 4, 5)).join(forms, "key")
        names = ["fmt", "rule", "severity", "sheet", "cell", "found", "expected", "was_corrected"]
        self._put(found.select(*key, *names), "log", batch)
