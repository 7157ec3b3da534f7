"""Session machine in batch and as a stream, on messages made of the events."""

import uuid

from pyspark.sql import functions as F

from spanledger.plans.durable import durable
from spanledger.plans.scan import numbered
from spanledger.queries.registry import query
from spanledger.session import checkpoint_root
from spanledger.streaming import intake
from spanledger.streaming.reports import ReportChain

c = F.col

CONTENT_SQL = """CASE event_type WHEN 'signup' THEN CASE WHEN k<40 THEN 'hi' WHEN k<50 THEN 'EXIT' WHEN k<60 THEN 'yes' WHEN k<70 THEN 'no' ELSE 'hello' END
  WHEN 'click' THEN CAST(k%6+1 AS VARCHAR) WHEN 'view' THEN CASE WHEN k<10 THEN 'Thanks a lot' ELSE 'crack near pier '||k END WHEN 'error' THEN ' Done ' ELSE '' END"""


def messages(events):
    k = F.get_json_object("props", "$.k").cast("int")
    e = c("event_type")
    content = (
        F.when(e == "signup", F.when(k < 40, "hi").when(k < 50, "EXIT").when(k < 60, "yes").when(k < 70, "no").otherwise("hello"))
        .when(e == "click", (k % 6 + 1).cast("string"))
        .when(e == "view", F.when(k < 10, "Thanks a lot").otherwise(F.concat(F.lit("crack near pier "), k.cast("string"))))
        .when(e == "error", " Done ")
        .otherwise("")
    )
    return events.select(
        c("user_id").alias("phone"), c("event_id").alias("msg_id"), c("ts").cast("timestamp").alias("ts"),
        F.when(e == "purchase", "image").otherwise("text").alias("type"), content.alias("content"),
    )


MACHINE_SQL = f"""WITH RECURSIVE e AS (SELECT *, CAST(props->>'k' AS INTEGER) AS k FROM events),
m AS (SELECT user_id AS phone, event_id AS msg_id, event_type='purchase' AS img, lower(trim({CONTENT_SQL})) AS w, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM e),
s AS (SELECT phone, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS msg_id, 0 AS no, false AS op, CAST(NULL AS VARCHAR) AS st, CAST(NULL AS VARCHAR) AS fmt, 0 AS ph, false AS det, CAST(NULL AS VARCHAR) AS action FROM (SELECT DISTINCT phone FROM m)
 UNION ALL
 SELECT phone, i, msg_id,
   CASE WHEN opens THEN no+1 ELSE no END,
   CASE WHEN a IN ('exit','generate') THEN false WHEN opens THEN true ELSE op END,
   CASE WHEN a IN ('exit','generate') THEN NULL WHEN tgt IS NOT NULL THEN tgt WHEN opens THEN 'format_select' ELSE st END,
   CASE WHEN a='format' THEN CASE w WHEN '1' THEN 'word' WHEN '2' THEN 'excel_rb' ELSE 'excel_amc' END WHEN opens THEN NULL ELSE fmt END,
   CASE WHEN opens THEN 0 WHEN a='filed' AND img THEN ph+1 ELSE ph END,
   CASE WHEN opens THEN false WHEN a='filed' AND st NOT IN ('2','3','4','5') THEN true ELSE det END, a
 FROM (SELECT *, CASE WHEN thanks THEN 'reply' WHEN w='exit' THEN CASE WHEN op THEN 'state' ELSE 'reply' END
     WHEN NOT op THEN CASE WHEN w='done' THEN 'reply' WHEN w IN ('1','2','3') THEN 'format' ELSE 'open' END
     WHEN st='confirm_exit' THEN CASE w WHEN 'yes' THEN 'exit' WHEN 'no' THEN 'state' ELSE 'reply' END
     WHEN st='format_select' THEN CASE WHEN w IN ('1','2','3') THEN 'format' ELSE 'reply' END
     WHEN st='confirm_generate' THEN CASE w WHEN '6' THEN 'generate' WHEN '1' THEN 'state' ELSE 'reply' END
     WHEN st='menu' THEN CASE WHEN w NOT IN ('1','2','3','4','5','6') THEN 'reply' WHEN w='6' AND det THEN 'generate' ELSE 'state' END
     WHEN w='done' THEN 'state' WHEN w IN ('1','2','3','4','5','6') AND NOT img THEN 'reply' ELSE 'filed' END AS a,
   NOT thanks AND w<>'exit' AND NOT op AND w<>'done' AS opens,
   CASE WHEN thanks THEN NULL WHEN w='exit' THEN CASE WHEN op THEN 'confirm_exit' END
     WHEN NOT op THEN CASE WHEN w IN ('1','2','3') THEN 'menu' END
     WHEN st='confirm_exit' AND w='no' THEN 'menu' WHEN st='format_select' AND w IN ('1','2','3') THEN 'menu' WHEN st='confirm_generate' AND w='1' THEN '1'
     WHEN st='menu' AND w='6' AND NOT det THEN 'confirm_generate' WHEN st='menu' AND w IN ('1','2','3','4','5') THEN w
     WHEN st IN ('1','2','3','4','5') AND w='done' THEN 'menu' END AS tgt
   FROM (SELECT s.phone, m.i, m.msg_id, no, w, img, fmt, ph, det, st AS st0, regexp_matches(w,'thanks') AS thanks,
      op AND NOT (w IN ('hi','hello') AND st IN ('format_select','menu','confirm_generate','confirm_exit')) AS op,
      CASE WHEN op AND NOT (w IN ('hi','hello') AND st IN ('format_select','menu','confirm_generate','confirm_exit')) THEN st END AS st
     FROM s JOIN m ON m.phone=s.phone AND m.i=s.i+1)))
SELECT phone, msg_id, action, no AS session_no, st AS state, fmt AS format, op AS is_open, CASE WHEN action='filed' AND msg_id IN (SELECT msg_id FROM m WHERE img) THEN ph END AS photo_num FROM s WHERE i>0"""

SHOWN = ["phone", "msg_id", "action", "session_no", "state", "format", "is_open", "photo_num"]


@query("session_machine", MACHINE_SQL)
def session_machine(t):
    return intake.sessions_batch(messages(t.events), "phone", ["ts", "msg_id"]).select(*SHOWN)


def event_stream(t):
    schema = t.events.schema
    return t.spark.readStream.schema(schema).parquet(f"{t.folder}/event[s].parquet")


#: Slices of the source, one for each micro-batch, and their length: what belongs to a slice comes with the next one
#: for every seventh event, so the newest message seen may be two slices ahead.
SLICES, SLICE_S = 3, 10 * 86_400


def files_of(t):
    """Files of a slice, which the cores write and one micro-batch reads."""
    return t.spark.sparkContext.defaultParallelism


def message_files(t, rows):
    """Messages as files in order of arrival, and at last a tick for every phone."""
    start = F.to_timestamp(F.lit("2024-01-01"))
    no = F.floor((F.unix_timestamp("ts") - F.unix_timestamp(start)) / SLICE_S) + F.when(c("msg_id") % 7 == 0, 1).otherwise(0)
    rows = rows.withColumn("no", F.least(F.greatest(no, F.lit(0)), F.lit(SLICES)))
    path = f"{checkpoint_root(t.spark)}/messages-{uuid.uuid4().hex}"
    for k in range(SLICES + 1):
        rows.filter(c("no") == k).drop("no").repartition(files_of(t), "msg_id").write.mode("append").parquet(path)
    last = rows.groupBy("phone").agg(F.max("ts").alias("ts"))
    ticks = last.select(
        "phone", F.lit(None).cast("bigint").alias("msg_id"), (c("ts") + F.expr(f"INTERVAL {3 * SLICE_S} SECONDS")).alias("ts"),
        F.lit(intake.TICK).alias("type"), F.lit(None).cast("string").alias("content"),
    )
    ticks.repartition(files_of(t), "phone").write.mode("append").parquet(path)
    return path


def sessions(t, rows):
    source = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files_of(t)).parquet(message_files(t, rows))
    return intake.sessions_stream(source, delay_s=2 * SLICE_S)


@query("stream_sessions", MACHINE_SQL)
def stream_sessions(t):
    return intake.drain(sessions(t, messages(t.events))).select(*SHOWN)


#: The events of a user as a script: hello, a format, notes on the bridge, the report, and over again.
SCRIPT_SQL = """e AS (SELECT user_id AS phone, event_id AS msg_id, ts, CAST(props->>'k' AS INTEGER) AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)-1 AS i FROM events),
rec AS (SELECT phone, CAST(i//7+1 AS INTEGER) AS session_no, CASE phone%3 WHEN 0 THEN 'word' WHEN 1 THEN 'excel_rb' ELSE 'excel_amc' END AS fmt, max('Tapi '||k) FILTER (WHERE i%7=3) AS river,
  max('C'||k) FILTER (WHERE i%7=4 AND k%2=0) AS circle, max('Seen maximum scour level 12.'||k||' m') FILTER (WHERE i%7=4 AND k%2=1) AS title, max('12.'||k||' m') FILTER (WHERE i%7=4 AND k%2=1) AS scour
  FROM e GROUP BY 1,2,3 HAVING count(*)=7),"""

#: Corrected cells of all reports.
CHAIN_SQL = f"""WITH {SCRIPT_SQL}
cells AS (SELECT phone, session_no, fmt, unnest(list_filter([{{'sheet':'Appendix-A','cell':'C4','value':coalesce(title, river)}},{{'sheet':'Appendix-A','cell':'C6','value':river}},
    {{'sheet':'Appendix-A','cell':'C11','value':circle}},{{'sheet':'Appendix-A','cell':'C12','value':circle}},{{'sheet':'Appendix-A','cell':'C48','value':scour}},
    {{'sheet':'Appendix-B','cell':'C4','value':coalesce(title, river)}},{{'sheet':'Appendix-B','cell':'C6','value':river}},{{'sheet':'Appendix-B','cell':'C10','value':circle}}], lambda q: q.value IS NOT NULL AND (fmt<>'word' OR q.cell='C48')), recursive := true)
  FROM rec)"""


def script(t):
    k, i = F.get_json_object("props", "$.k").cast("int"), c("i") % 7
    rows = numbered(t.events.select("user_id", "event_id", "ts", "props"), ["user_id"], ["ts", "event_id"], "i").withColumn("i", c("i") - 1)
    text = k.cast("string")
    content = (
        F.when(i == 0, "hi").when(i == 1, (c("user_id") % 3 + 1).cast("string")).when(i == 2, "1").when(i == 3, F.concat(F.lit("river Tapi "), text))
        .when((i == 4) & (k % 2 == 0), F.concat(F.lit("circle C"), text)).when(i == 4, F.concat(F.lit("Seen maximum scour level 12."), text, F.lit(" m")))
        .when(i == 5, "done").otherwise("6")
    )
    return rows.select(c("user_id").alias("phone"), c("event_id").alias("msg_id"), c("ts").cast("timestamp").alias("ts"), F.lit("text").alias("type"), content.alias("content"))


def chain(t):
    """The chain over all micro-batches, each of them given twice."""
    rows = durable(script(t))  # read for every slice and every batch
    path = f"{checkpoint_root(t.spark)}/reports-{uuid.uuid4().hex}"
    reports = ReportChain(path, rows)

    def work(done, batch):
        for _ in range(2):
            reports.apply(done, batch)

    intake.each_batch(sessions(t, rows), work, f"{path}/checkpoint").awaitTermination()
    return reports


@query("report_chain", f"{CHAIN_SQL} SELECT phone, session_no, fmt, sheet, cell, value FROM cells")
def report_chain(t):
    return chain(t).cells().select("phone", "session_no", "fmt", "sheet", "cell", "value")


@query(
    "report_log",
    f"""{CHAIN_SQL} SELECT phone, session_no, fmt, 5 AS rule, cell, '(blank in report_json)' AS found, value AS expected, true AS was_corrected FROM cells WHERE cell='C48'""",
)
def report_log(t):
    return chain(t).log().select("phone", "session_no", "fmt", "rule", "cell", "found", "expected", "was_corrected")


@query("stream_dedup", "SELECT DISTINCT user_id AS phone, event_id AS msg_id FROM events")
def stream_dedup(t):
    once = messages(event_stream(t))
    return intake.drain(intake.deduplicate(once.unionByName(once), "msg_id", "ts", "60 days").select("phone", "msg_id"))


@query(
    "report_events",
    f"WITH x AS ({MACHINE_SQL}) SELECT phone, msg_id, session_no FROM x WHERE action='filed' AND (phone, session_no) IN (SELECT (phone, session_no) FROM x WHERE action='generate')",
)
def report_events(t):
    done = intake.sessions_batch(messages(t.events), "phone", ["ts", "msg_id"])
    return intake.report_events(done, done, "phone").select("phone", "msg_id", "session_no")


@query(
    "parse_messages",
    """SELECT event_id, CASE WHEN event_id%7=0 THEN 'unknown' ELSE 'p'||user_id END AS phone, CASE WHEN event_id%7<>0 THEN 'm'||event_id END AS msg_key,
    CASE WHEN event_id%7=0 THEN 'unknown' ELSE ['text','reaction','audio','image','sticker'][event_id%5+1] END AS type,
    CASE WHEN event_id%7<>0 THEN CASE event_id%5 WHEN 0 THEN event_type WHEN 1 THEN '👍' WHEN 3 THEN '' END END AS content,
    CASE WHEN event_id%7<>0 AND event_id%5 IN (2,3) THEN 'f'||event_id END AS media_id, 0 AS seq FROM events""",
)
def parse_messages(t):
    i, k = c("event_id").cast("string"), c("event_id") % 5
    part = (
        F.when(k == 0, F.concat(F.lit('"text","text":{"body":"'), "event_type", F.lit('"}')))
        .when(k == 1, '"reaction","reaction":{"emoji":"👍"}')
        .when(k == 2, F.concat(F.lit('"audio","audio":{"id":"f'), i, F.lit('"}')))
        .when(k == 3, F.concat(F.lit('"image","image":{"id":"f'), i, F.lit('"}')))
        .otherwise('"sticker"')
    )
    msg = F.concat(F.lit('{"from":"p'), c("user_id").cast("string"), F.lit('","id":"m'), i, F.lit('","type":'), part, F.lit("}"))
    body = F.concat(F.lit('{"entry":[{"changes":[{"value":{"messages":['), F.when(c("event_id") % 7 == 0, "").otherwise(msg), F.lit("]}}]}]}"))
    return intake.parse_messages(t.events.select("event_id", body.alias("body")), "body")
