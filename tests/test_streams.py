"""The session machine over streams: any arrival order, late messages, and reports once for each batch."""

import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from spanledger.streaming import intake
from spanledger.streaming.reports import ReportChain

SCHEMA = "phone bigint, msg_id bigint, ts timestamp, type string, content string"
START = datetime.datetime(2024, 5, 1, tzinfo=datetime.UTC)

# A whole session: details, general and damaged photos, observations, recommendations, the report.
SESSION = [
    "hi", "2", "1", "river Tapi", "Seen maximum scour level 12.5 m", "done", "2", ("image", "General view"), "done", "3", ("image", "Crack"),
    "done", "4", "fair", "done", "5", "repair", "done", "6",
]


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def scripted(phone, first, begin=0, step=30):
    rows = []
    for k, said in enumerate(SESSION):
        kind, text = said if isinstance(said, tuple) else ("text", said)
        rows.append((phone, first + k, at(begin + k * step), kind, text))
    return rows


def source(spark, path, *files):
    for rows in files:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def plain(df):
    return sorted((r.phone, r.msg_id, r.action, r.session_no, r.state, r.format, r.photo_num) for r in df.collect())


def tick(phone, seconds=10**6):
    return (phone, None, at(seconds), intake.TICK, None)


def test_stream_equals_batch_in_any_order_of_arrival(spark, tmp_path):
    rows = scripted(1, 100) + scripted(2, 200, 7) + [(None, 900, at(1), "text", "hi"), (3, 901, None, "text", "hi")]
    early, middle, last = rows[::3], rows[1::3], rows[2::3]
    stream = intake.sessions_stream(source(spark, str(tmp_path / "in"), middle, last, early, [tick(1), tick(2)]), delay_s=3600)
    got = plain(intake.drain(stream))
    batch = intake.sessions_batch(spark.createDataFrame([r for r in rows if r[2] and r[0]], SCHEMA), "phone", ["ts", "msg_id"])
    assert got == plain(batch) and len(got) == 2 * len(SESSION)
    assert [r for r in got if r[2] == "generate"] and {r[6] for r in got if r[6]} == {1, 2}


def test_late_messages_are_given_out_and_change_nothing(spark, tmp_path):
    rows = scripted(1, 100)
    late = [(1, 50, at(45), "text", "EXIT"), (1, 100, at(0), "text", "hi")]  # older than what was applied, and one again
    stream = intake.sessions_stream(source(spark, str(tmp_path / "in"), rows + [tick(1, 2000)], late, [tick(1)]), delay_s=0)
    done = intake.drain(stream)
    assert sorted(r.msg_id for r in intake.late_messages(done).collect()) == [50, 100]
    assert plain(done.filter("action <> 'late'")) == plain(intake.sessions_batch(spark.createDataFrame(rows, SCHEMA), "phone", ["ts", "msg_id"]))


def test_a_phone_with_more_messages_than_a_piece(spark, tmp_path):
    n = 2 * intake.PIECE_ROWS + 17
    rows = [(1, k, at(k * 0.01), "text", ("hi", "1", "1", "note", "done", "6")[k % 6]) for k in range(n)]
    stream = intake.sessions_stream(source(spark, str(tmp_path / "in"), rows[1::2], rows[::2], [tick(1)]), delay_s=10**5)
    got = intake.drain(stream)
    assert got.count() == n
    assert plain(got.filter("action = 'generate'")) == plain(
        intake.sessions_batch(spark.createDataFrame(rows, SCHEMA), "phone", ["ts", "msg_id"]).filter("action = 'generate'")
    )


def test_a_batch_touches_the_state_of_a_phone_a_few_times():
    calls, kept = [], {}

    class State:
        def exists(self):
            return "v" in kept

        def __getattr__(self, name):
            def call(*args):
                calls.append(name)
                if name == "update":
                    kept["v"] = args[0]
                return kept["v"] if name == "get" else None

            return call

    class Handle:
        getValueState = getMapState = lambda self, *args: State()

    processor = intake.SessionProcessor(0)
    processor.init(Handle())
    names = ["phone", "msg_id", "ts", "type", "content"]
    batch = pd.DataFrame([(1, k, at(3600 * k).replace(tzinfo=None), "text", "hi") for k in range(100)], columns=names)
    out = pd.concat(processor.handleInputRows((1,), iter([batch]), None))
    out = pd.concat([out, *processor.handleInputRows((1,), iter([batch.tail(1).assign(msg_id=100, type=intake.TICK, ts=at(10**6).replace(tzinfo=None))]), None)])
    assert out["msg_id"].tolist() == list(range(100)) and len(calls) < 10


def test_messages_dropped_by_the_watermark_are_counted(spark, tmp_path):
    rows = lambda first: [(1, first + k, at(k), "text", "x") for k in range(3)]
    now = lambda k: [(1, k, at(10**6), "text", "x")]
    files = source(spark, str(tmp_path / "in"), rows(0), now(90), now(91), rows(0) + rows(10), now(92))
    counts = {}
    out = intake.drain(intake.deduplicate(files, "msg_id", "ts", "1 hour"), counts=counts)
    assert sorted(r.msg_id for r in out.collect()) == [0, 1, 2, 90, 91, 92] and counts == {"late": 6}


@pytest.fixture
def chain(spark, tmp_path):
    rows = scripted(1, 100) + scripted(1, 200, 10_000) + scripted(2, 300)
    messages = spark.createDataFrame(rows, SCHEMA)
    done = intake.sessions_batch(messages, "phone", ["ts", "msg_id"])
    return ReportChain(str(tmp_path / "reports"), messages), done


def cells(chain):
    return sorted((r.phone, r.session_no, r.sheet, r.cell, r.value) for r in chain.cells().collect())


def test_a_repeated_batch_changes_nothing(chain):
    reports, done = chain
    assert cells(reports) == [] and reports.ledger().isEmpty()
    reports.apply(done.filter("msg_id < 118"), 0)  # notes, no report yet
    assert cells(reports) == [] and reports.filed().count() == 6
    reports.apply(done.filter("msg_id >= 118 AND msg_id < 300"), 1)
    first = cells(reports)
    # The note is corrected into its cell from the raw text.
    assert [x for x in first if x[3] == "C48"] == [(1, n, "Appendix-A", "C48", "12.5 m") for n in (1, 2)]
    log = reports.log().collect()
    assert {(r.phone, r.session_no, r.rule, r.cell, r.was_corrected) for r in log} == {(1, n, 5, "C48", True) for n in (1, 2)}
    for batch in (0, 1, 1):
        reports.apply(done, batch)
    assert cells(reports) == first and reports.log().count() == len(log) and reports.filed().count() == 12
    assert sorted(r.batch for r in reports.ledger().collect()) == [0, 1]


def test_an_interrupted_batch_is_done_again(chain, monkeypatch):
    reports, done = chain
    calls = []

    def broken(df):
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("lost")
        return df.withColumnRenamed("expected", "value").filter("cell <> 'C6'").unionByName(
            df.limit(1).select("key", F.lit("Appendix-A").alias("sheet"), F.lit("C99").alias("cell"), F.lit("made up").alias("value"))
        )

    reports.write = broken
    with pytest.raises(RuntimeError):
        reports.apply(done, 7)
    assert reports.ledger().isEmpty() and reports.filed().count() == 18
    reports.apply(done, 7)
    assert reports.filed().count() == 18 and [r.batch for r in reports.ledger().collect()] == [7]
    got = cells(reports)
    # The river's cell was left out and is filled; what no source says is cleared.
    assert sum(x[3] == "C6" and x[4] == "Tapi" for x in got) == 6 and [x[4] for x in got if x[3] == "C99"] == [None]
    assert {r.rule for r in reports.log().collect()} == {1, 2, 5}


def test_a_report_runs_with_the_partitions_that_its_sessions_need(chain):
    reports, done = chain
    conf, seen = reports.spark.conf, []
    given = conf.get("spark.sql.shuffle.partitions")
    conf.set("spark.sql.shuffle.partitions", 200)
    try:
        reports.write = lambda df: (seen.append(conf.get("spark.sql.shuffle.partitions")), df.withColumnRenamed("expected", "value"))[1]
        reports.apply(done, 0)
        assert [int(n) for n in seen] == [2 * reports.spark.sparkContext.defaultParallelism]
        assert conf.get("spark.sql.shuffle.partitions") == "200"
    finally:
        conf.set("spark.sql.shuffle.partitions", given)
