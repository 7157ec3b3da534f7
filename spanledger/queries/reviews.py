"""Review and session operators on orders, lineitem, events and conversations."""

from pyspark.sql import functions as F

from spanledger.operators import reviews as R
from spanledger.operators import sessions as S
from spanledger.queries.registry import query

LISTING_SQL = """
WITH c AS (
  SELECT l_orderkey AS review_id,
         count(*) FILTER (WHERE l_returnflag='R' AND l_linestatus='O') AS open_errors,
         count(*) FILTER (WHERE l_returnflag='A' AND l_linestatus='O') AS open_warnings,
         count(*) FILTER (WHERE l_linestatus='O') AS open_total
  FROM lineitem GROUP BY 1)
SELECT o_orderkey AS review_id, o_custkey AS drawing_id, c_name AS name, c_mktsegment AS drawing_type,
       o_orderstatus AS status, o_orderdate AS created_at,
       coalesce(open_errors,0) AS open_errors, coalesce(open_warnings,0) AS open_warnings,
       coalesce(open_total,0) AS open_total
FROM orders JOIN customer ON c_custkey=o_custkey LEFT JOIN c ON c.review_id=o_orderkey
"""


def _reviews(t):
    return t.orders.select(
        F.col("o_orderkey").alias("review_id"),
        F.col("o_custkey").alias("drawing_id"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderdate").alias("created_at"),
    )


def _drawings(t):
    return t.customer.select(
        F.col("c_custkey").alias("drawing_id"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("drawing_type"),
    )


def _counts(issues):
    return R.issue_counts(
        issues,
        "review_id",
        F.col("l_returnflag") == "R",
        F.col("l_returnflag") == "A",
        F.col("l_linestatus") == "O",
    )


def _issues(t):
    return t.lineitem.select(F.col("l_orderkey").alias("review_id"), "l_returnflag", "l_linestatus")


@query("review_listing", LISTING_SQL)
def review_listing(t):
    return R.review_listing(_reviews(t), _drawings(t), _counts(_issues(t)), "review_id", "drawing_id")


@query("review_page", f"SELECT * FROM ({LISTING_SQL}) ORDER BY created_at DESC, review_id LIMIT 10 OFFSET 10")
def review_page(t):
    # The page is cut first, so that only its ten reviews meet the issues.
    listed = _reviews(t).join(_drawings(t), "drawing_id")
    shown = R.page(listed, [F.col("created_at").desc(), F.col("review_id")], 2)
    on_page = _issues(t).join(F.broadcast(shown.select("review_id")), "review_id", "left_semi")
    return shown.join(_counts(on_page), "review_id", "left").fillna(0)


@query("total_pages", "SELECT count(*) AS total, greatest(CAST(ceil(count(*)/10.0) AS BIGINT),1) AS total_pages FROM orders JOIN customer ON c_custkey=o_custkey")
def total_pages(t):
    return R.total_pages(t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left_semi"))


@query(
    "latest_active_session",
    """SELECT user_id, event_id, event_type AS state, ts AS started_at FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) rn
    FROM events WHERE event_type<>'error') WHERE rn=1""",
)
def latest_active_session(t):
    s = t.events.select("user_id", "event_id", F.col("event_type").alias("state"), F.col("ts").alias("started_at"))
    return S.active_session(s, "user_id", "started_at", F.col("state") != "error", "event_id")


@query(
    "session_snapshot",
    """SELECT d.doc_id AS session_id, d.lang, c.turn, c.role, c.text AS content, c.message_no
    FROM documents d LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS message_no
    FROM conversations) c ON c.conv_id=d.doc_id""",
)
def session_snapshot(t):
    sessions = t.documents.select(F.col("doc_id").alias("session_id"), "lang")
    messages = t.conversations.select(
        F.col("conv_id").alias("session_id"), "turn", "role", F.col("text").alias("content")
    )
    return S.session_snapshot(sessions, messages, "session_id", ["turn"])


@query(
    "has_category",
    """SELECT doc_id AS session_id, source FROM documents d
    WHERE EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id=d.doc_id AND c.role='system')""",
)
def has_category(t):
    sessions = t.documents.select(F.col("doc_id").alias("session_id"), "source")
    messages = t.conversations.select(F.col("conv_id").alias("session_id"), "role")
    return S.has_category(sessions, messages, "session_id", F.col("role") == "system")


@query(
    "latest_version_open",
    """WITH v AS (SELECT o_custkey AS drawing_id, max(o_orderkey) AS version FROM orders GROUP BY 1)
    SELECT drawing_id, version, l_linenumber AS issue_no, l_returnflag AS severity, l_quantity AS value
    FROM v JOIN lineitem ON l_orderkey=version WHERE l_linestatus='O'""",
)
def latest_version_open(t):
    reviews = t.orders.select(F.col("o_custkey").alias("drawing_id"), F.col("o_orderkey").alias("version"))
    latest = reviews.groupBy("drawing_id").agg(F.max("version").alias("version"))
    issues = t.lineitem.filter("l_linestatus = 'O'").select(
        F.col("l_orderkey").alias("version"),
        F.col("l_linenumber").alias("issue_no"),
        F.col("l_returnflag").alias("severity"),
        F.col("l_quantity").alias("value"),
    )
    return latest.join(issues, "version")


@query(
    "version_append",
    """WITH r AS (SELECT o_custkey AS drawing_id, o_orderkey,
       row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version,
       o_orderpriority AS design_data, CASE WHEN o_orderstatus='O' THEN NULL ELSE o_orderstatus END AS drawing_file FROM orders),
    l AS (SELECT drawing_id, version, design_data, drawing_file FROM r
          QUALIFY row_number() OVER (PARTITION BY drawing_id ORDER BY version DESC)=1),
    u AS (SELECT c_custkey AS drawing_id, c_nationkey%2=0 AS design_uploaded,
          CASE WHEN c_nationkey%4=0 THEN c_mktsegment END AS d, CASE WHEN c_nationkey%3=0 THEN c_name END AS f FROM customer)
    SELECT u.drawing_id, coalesce(version,0)+1 AS version,
       CASE WHEN design_uploaded THEN d ELSE design_data END AS design_data,
       coalesce(f, drawing_file) AS drawing_file, 'processing' AS status
    FROM u LEFT JOIN l ON l.drawing_id=u.drawing_id""",
)
def version_append(t):
    from spanledger.plans.scan import numbered

    orders = t.orders.select(
        F.col("o_custkey").alias("drawing_id"),
        "o_orderdate",
        "o_orderkey",
        F.col("o_orderpriority").alias("design_data"),
        F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")).alias("drawing_file"),
    )
    reviews = numbered(orders, ["drawing_id"], ["o_orderdate", "o_orderkey"], "version")
    nation = F.col("c_nationkey")
    uploads = t.customer.select(
        F.col("c_custkey").alias("drawing_id"),
        (nation % 2 == 0).alias("design_uploaded"),
        F.when(nation % 4 == 0, F.col("c_mktsegment")).alias("design_data"),
        F.when(nation % 3 == 0, F.col("c_name")).alias("drawing_file"),
    )
    return R.version_append(reviews, uploads, "drawing_id")


@query(
    "batch_insert",
    """SELECT o_custkey AS upload_id, o_orderkey AS row_id,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS batch_index,
    count(*) OVER (PARTITION BY o_custkey) AS batch_size,
    CASE WHEN count(*) OVER (PARTITION BY o_custkey)>1 THEN 'batch-'||o_custkey END AS batch_id,
    1 AS version, 'processing' AS status FROM orders""",
)
def batch_insert(t):
    rows = t.orders.select(F.col("o_custkey").alias("upload_id"), F.col("o_orderkey").alias("row_id"))
    return R.batch_insert(rows, "upload_id", ["row_id"])


@query(
    "batch_neighbours",
    """SELECT o_custkey AS batch_id, o_orderkey AS review_id, o_orderdate AS d,
    row_number() OVER w AS index, count(*) OVER (PARTITION BY o_custkey) AS total,
    lag(o_orderkey) OVER w AS prev_id, lead(o_orderkey) OVER w AS next_id
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
    QUALIFY count(*) OVER (PARTITION BY o_custkey) > 1""",
)
def batch_neighbours(t):
    rows = t.orders.select(
        F.col("o_custkey").alias("batch_id"), F.col("o_orderkey").alias("review_id"), F.col("o_orderdate").alias("d")
    )
    return R.batch_neighbours(rows, "batch_id", ["d", "review_id"], "review_id")


@query(
    "status_counts",
    """SELECT count(*) AS total, count(*) FILTER (WHERE event_type='click') AS click,
    count(*) FILTER (WHERE event_type='purchase') AS purchase, count(*) FILTER (WHERE event_type='error') AS error
    FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 3 HOUR""",
)
def status_counts(t):
    as_of = t.events.agg(F.max("ts")).scalar()
    live = S.recent(t.events, "ts", as_of)
    return S.status_counts(live, "event_type", ["click", "purchase", "error"])


@query(
    "latest_state",
    """SELECT o_custkey AS session_id, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status,
    arg_max(o_orderpriority, (o_orderdate, o_orderkey)) FILTER (WHERE o_orderpriority<>'5-LOW') AS report_format,
    count(*) AS changes FROM orders GROUP BY 1""",
)
def latest_state(t):
    log = t.orders.select(
        F.col("o_custkey").alias("session_id"),
        "o_orderdate",
        "o_orderkey",
        F.col("o_orderstatus").alias("status"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("report_format"),
    )
    return S.latest_state(log, ["session_id"], ["o_orderdate", "o_orderkey"], ["status", "report_format"])


@query(
    "photo_count",
    """SELECT conv_id AS session_id, turn, CASE WHEN role='assistant' THEN
    count(*) FILTER (WHERE role='assistant') OVER (PARTITION BY conv_id ORDER BY turn) END AS photo_num
    FROM conversations""",
)
def photo_count(t):
    m = t.conversations.select(F.col("conv_id").alias("session_id"), "turn", "role")
    return S.photo_count(m, "session_id", ["turn"], F.col("role") == "assistant").drop("role")


@query(
    "group_text",
    """WITH l AS (SELECT conv_id, role, trim(text, ' ') AS line,
      row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS line_no FROM conversations WHERE trim(text, ' ')<>''),
    u AS (SELECT conv_id, role, line_no, line FROM l UNION ALL
      SELECT DISTINCT conv_id, role, 0, CASE role WHEN 'system' THEN 'SETTINGS' WHEN 'user' THEN 'NOTES' ELSE 'REPLIES' END FROM l)
    SELECT conv_id, role, CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END AS category_no, line_no, line FROM u""",
)
def group_text(t):
    heads = {"system": "SETTINGS", "user": "NOTES", "assistant": "REPLIES"}
    return S.group_text(t.conversations, ["conv_id"], "role", "text", ["turn"], heads)


LINE_ORDER = "l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice"


@query(
    "issue_dedup_first",
    f"""SELECT l_partkey, l_returnflag, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_partkey, l_returnflag ORDER BY {LINE_ORDER})=1""",
)
def issue_dedup_first(t):
    cols = LINE_ORDER.split(", ")
    issues = t.lineitem.select("l_partkey", "l_returnflag", *cols)
    return R.dedup_issues(issues, ["l_partkey", "l_returnflag"], cols)


@query(
    "category_groups",
    """SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY first_ord, category) AS group_no FROM (
    SELECT l_orderkey AS review_id, l_returnflag AS category, min(l_linenumber) AS first_ord,
    count(*) FILTER (WHERE l_linestatus='O') AS open_count, count(*) AS issue_count FROM lineitem GROUP BY 1,2)""",
)
def category_groups(t):
    issues = t.lineitem.select(
        F.col("l_orderkey").alias("review_id"),
        F.col("l_returnflag").alias("category"),
        F.col("l_linenumber").alias("ord"),
        "l_linestatus",
    )
    return R.category_groups(issues, ["review_id"], "category", "ord", F.col("l_linestatus") == "O")


@query(
    "visible_issues",
    """SELECT l_orderkey AS id, l_linenumber AS no, CASE l_returnflag WHEN 'R' THEN 'error' ELSE 'warning' END AS severity,
    l_returnflag AS category FROM lineitem WHERE l_returnflag<>'N' AND l_linestatus='O'""",
)
def visible_issues(t):
    issues = t.lineitem.select(
        F.col("l_orderkey").alias("id"),
        F.col("l_linenumber").alias("no"),
        F.when(F.col("l_returnflag") == "R", "error").otherwise("warning").alias("severity"),
        F.when(F.col("l_returnflag") == "N", "AI Reasoning").otherwise(F.col("l_returnflag")).alias("category"),
        F.when(F.col("l_linestatus") == "O", "open").otherwise("resolved").alias("status"),
    )
    return R.visible_issues(issues, "checks", "open").drop("status").orderBy(*R.issue_order())
