"""Message intake: parsing, de-duplication, sessions and report events, as streams and in batch."""

from __future__ import annotations

import itertools
import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from spanledger.plans.fold import CHUNK_ROWS, Relative, fold
from spanledger.session import ROCKSDB_PROVIDER, checkpoint_root
from spanledger.streaming import machine

#: Messages of a phone that one step of the stream holds together; microseconds of a bucket of waiting messages.
PIECE_ROWS, BUCKET_US = 10_000, 60_000_000
#: Type of a row that only tells the time; action of a message that came too late.
TICK, LATE = "tick", "late"

# The part of a webhook body that is read.
PAYLOAD = (
    "struct<entry:array<struct<changes:array<struct<value:struct<messages:array<struct<"
    "`from`:string,id:string,type:string,text:struct<body:string>,image:struct<id:string,caption:string>,"
    "audio:struct<id:string>,reaction:struct<emoji:string>>>>>>>>>"
)


def parse_messages(raw: DataFrame, body: str) -> DataFrame:
    """Webhook bodies as messages; a body with a missing part is of type ``unknown``."""
    first = F.from_json(F.col(body), PAYLOAD)["entry"]
    m = F.get(F.get(F.get(first, 0)["changes"], 0)["value"]["messages"], 0)
    kind = m["type"]
    complete = m["from"].isNotNull() & m["id"].isNotNull() & kind.isNotNull()
    part = (
        F.when(kind == "text", m["text"]["body"].isNotNull())
        .when(kind == "reaction", m["reaction"].isNotNull())
        .when(kind == "audio", m["audio"]["id"].isNotNull())
        .when(kind == "image", m["image"]["id"].isNotNull())
        .otherwise(True)
    )
    ok = F.coalesce(complete & part, F.lit(False))
    content = (
        F.when(kind == "text", m["text"]["body"])
        .when(kind == "reaction", F.coalesce(m["reaction"]["emoji"], F.lit("")))
        .when(kind == "image", F.coalesce(m["image"]["caption"], F.lit("")))
    )
    media = F.when(kind == "audio", m["audio"]["id"]).when(kind == "image", m["image"]["id"])
    rest = [c for c in raw.columns if c != body]
    return raw.select(
        *rest,
        F.when(ok, m["from"]).otherwise("unknown").alias("phone"),
        F.when(ok, m["id"]).alias("msg_key"),
        F.when(ok, kind).otherwise("unknown").alias("type"),
        F.when(ok, content).alias("content"),
        F.when(ok, media).alias("media_id"),
        F.lit(0).alias("seq"),
    )


def known(messages: DataFrame) -> DataFrame:
    """Messages that a phone sent; bodies without one (phone ``unknown``) and unsupported kinds are no part of a session."""
    phone, kind = F.col("phone").cast("string"), F.col("type")
    return messages.filter(
        phone.isNotNull() & (phone != "unknown") & kind.isNotNull() & ~kind.isin("unknown", "unsupported")
    )


def deduplicate(messages: DataFrame, key: str, ts: str, delay: str = "1 day") -> DataFrame:
    """Drop repeated messages; the watermark bounds how long a key is remembered."""
    return messages.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def sessions_batch(messages: DataFrame, phone: str, order: list[str], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The session machine over a table of messages (msg_id, type, content)."""
    relative = Relative(machine.controls(), machine.control_of, machine.start_from, machine.after)
    rows = known(messages.withColumnRenamed(phone, "phone"))
    return fold(rows, ["phone"], order, machine.run, machine.OUTPUT, chunk_rows, relative).withColumnRenamed("phone", phone)


def _bucket(message) -> int:
    return message[0] // BUCKET_US


class SessionProcessor(StatefulProcessor):
    """The session machine of one phone, in the order of the messages' own times.

    Messages wait in the state until the phone's newest message or tick is ``delay``
    later than their bucket of time; then the buckets are applied one after the other.
    Few wait in one value, so that a batch reads and writes a phone's state once; more
    than ``PIECE_ROWS`` go into pieces of their buckets. What the state, a piece and a
    bucket hold bounds the memory, not what arrives of a phone at once. A message that
    comes after a later one was applied is given out as ``late`` and changes nothing.
    """

    def __init__(self, delay_us: int):
        self.delay_us = delay_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.saved = handle.getValueState("session", "state string, ts bigint, msg_id bigint, newest bigint, pieces bigint, held bigint, few string")
        self.pieces = handle.getMapState("pieces", "bucket bigint, no bigint", "messages string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        start = (None, -(1 << 62), -1, -(1 << 62), 0, 0, "[]")
        state, *last, newest, pieces, held, few = self.saved.get() if self.saved.exists() else start
        few = json.loads(few)
        for batch in rows:
            ts = batch["ts"].to_numpy().astype("datetime64[us]").astype("int64")
            newest = max(newest, int(ts.max()))
            kept = (batch["type"] != TICK).to_numpy()
            ids = batch["msg_id"].fillna(-1).to_numpy().astype("int64")  # a tick has none
            late = kept & ((ts < last[0]) | ((ts == last[0]) & (ids <= last[1])))
            if late.any():
                yield self._late(key, batch[late])
            on = kept & ~late
            few += zip(ts[on].tolist(), ids[on].tolist(), batch["type"][on].tolist(), batch["content"][on].tolist(), strict=True)
            if len(few) > PIECE_ROWS:
                few.sort(key=_bucket)
                for bucket, part in itertools.groupby(few, key=_bucket):
                    part = list(part)
                    for at in range(0, len(part), PIECE_ROWS):
                        self.pieces.updateValue((bucket, pieces), (json.dumps(part[at : at + PIECE_ROWS]),))
                        pieces, held = pieces + 1, held + 1
                few = []

        end = (newest - self.delay_us) // BUCKET_US
        due: dict[int, tuple[list, list]] = {}  # messages, names of pieces
        for m in few:
            if _bucket(m) < end:
                due.setdefault(_bucket(m), ([], []))[0].append(m)
        few = [m for m in few if _bucket(m) >= end]
        for k in self.pieces.keys() if held else ():
            if k[0] < end:
                due.setdefault(k[0], ([], []))[1].append(k)
        found = []
        for n, (_, (some, names)) in enumerate(sorted(due.items()), 1):
            for k in names:
                some += json.loads(self.pieces.getValue(k)[0])
            found += sorted(some, key=lambda r: (r[0], r[1]))
            if len(found) >= PIECE_ROWS or n == len(due):
                for at in range(0, len(found), PIECE_ROWS):
                    _, ids, kinds, contents = (list(x) for x in zip(*found[at : at + PIECE_ROWS], strict=True))
                    done, state = machine.run({"msg_id": ids, "type": kinds, "content": contents}, state)
                    yield self._rows(key, done)
                last, found = found[-1][:2], []
            for k in names:
                self.pieces.removeKey(k)
            held -= len(names)
        self.saved.update((state, *last, newest, pieces, held, json.dumps(few)))

    def _rows(self, key, done: dict) -> pd.DataFrame:
        out = pd.DataFrame(done).astype({"photo_num": "Int32", "session_no": "Int32", "is_open": "boolean"})
        out.insert(0, "phone", key[0])
        return out

    def _late(self, key, batch: pd.DataFrame) -> pd.DataFrame:
        done = dict.fromkeys(machine.OUTPUT_NAMES, [None] * len(batch))
        return self._rows(key, done | {"msg_id": batch["msg_id"].to_list(), "action": [LATE] * len(batch)})

    def close(self) -> None:
        pass


def sessions_stream(messages: DataFrame, phone_type: str = "bigint", delay_s: int = 0) -> DataFrame:
    """The session machine over a stream with phone, msg_id, ts, type and content.

    The messages of a phone are applied in (ts, msg_id) order, whatever batches they
    come in, if none is more than ``delay_s`` behind the phone's newest; ``late_messages``
    gives the others. A row of type ``tick`` is no message: it only tells a phone the
    time, so that a silent one does not wait.
    """
    messages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    ticks = messages.filter((F.col("type") == TICK) & F.col("phone").isNotNull())
    rows = known(messages.filter(F.coalesce(F.col("type") != TICK, F.lit(False)))).unionByName(ticks)
    return rows.filter("ts IS NOT NULL").groupBy("phone").transformWithStateInPandas(
        statefulProcessor=SessionProcessor(delay_s * 1_000_000),
        outputStructType=f"phone {phone_type}, {machine.OUTPUT}",
        outputMode="Append",
        timeMode="None",
    )


def late_messages(done: DataFrame) -> DataFrame:
    """phone and msg_id of the messages that came too late to be applied."""
    return done.filter(F.col("action") == LATE).select("phone", "msg_id")


def each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str):
    """Run ``work`` on every micro-batch until the source is drained.

    Every partition of the state starts a Python worker in every batch, however few
    rows it has. A new stream has no more of them than two for each core; one that goes
    on keeps those of its checkpoint.
    """
    conf, cores = stream.sparkSession.conf, stream.sparkSession.sparkContext.defaultParallelism
    given = conf.get("spark.sql.shuffle.partitions")
    conf.set("spark.sql.shuffle.partitions", min(int(given), 2 * cores))
    try:
        return stream.writeStream.outputMode("append").foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set("spark.sql.shuffle.partitions", given)


def late_count(query) -> int:
    """Rows that a stream dropped because they were older than its watermark, over the progress that Spark keeps."""
    return sum(o.numRowsDroppedByWatermark for p in query.recentProgress for o in p.stateOperators)


def drain(stream: DataFrame, out: str | None = None, counts: dict | None = None) -> DataFrame:
    """Run a stream to the end of its input and read back what it wrote.

    Each micro-batch overwrites a folder of its own, so a repeated batch leaves no
    duplicates. ``counts`` receives ``late``, the rows dropped by the watermark.
    """
    spark = stream.sparkSession
    root = out or f"{checkpoint_root(spark)}/stream-{uuid.uuid4().hex}"
    schema = stream.schema

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{root}/rows/batch={batch_id}")

    running = each_batch(stream, write, f"{root}/checkpoint")
    running.awaitTermination()
    if counts is not None:
        counts["late"] = late_count(running)
    return spark.read.schema(schema).parquet(f"{root}/rows").drop("batch")


def report_events(filed: DataFrame, generate: DataFrame, phone: str) -> DataFrame:
    """The messages a report is made of: those filed in the session a generate event closed."""
    keys = [phone, "session_no"]
    closed = generate.filter("action = 'generate'").select(*keys).distinct()
    return filed.filter("action = 'filed'").join(closed, keys, "left_semi")
