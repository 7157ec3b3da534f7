"""Schedule reconstruction on the given tables."""

from pyspark.sql import functions as F

from spanledger.operators import schedule as S
from spanledger.queries.places import PTS, points
from spanledger.queries.registry import query

c = F.col


@query(
    "anchor_groups",
    f"""WITH RECURSIVE {PTS}, o AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY y, id) AS i FROM p),
    s AS (SELECT sheet, id, y, i, y AS anchor, id AS anchor_tie FROM o WHERE i=1
      UNION ALL SELECT o.sheet, o.id, o.y, o.i, CASE WHEN o.y-s.anchor>250 THEN o.y ELSE s.anchor END, CASE WHEN o.y-s.anchor>250 THEN o.id ELSE s.anchor_tie END FROM s JOIN o ON o.sheet=s.sheet AND o.i=s.i+1)
    SELECT id, round(anchor,3) AS anchor, anchor_tie FROM s""",
)
def anchor_groups(t):
    out = S.anchor_groups(points(t).withColumn("tol", F.lit(250.0)), ["sheet"], "y", "id", "tol")
    return out.select("id", F.round("anchor", 3).alias("anchor"), "anchor_tie")


@query(
    "assign_columns",
    f"""WITH {PTS}, k AS (SELECT unnest([0,1,2,3,4,5,6,7]) AS o), sp AS (SELECT sheet, o, -1400+o*400.0 AS cx FROM (SELECT DISTINCT sheet FROM p), k)
    SELECT id, arg_min(o, (abs(cx-x), o)) AS field FROM p JOIN sp USING (sheet) GROUP BY id, x HAVING min(abs(cx-x)) < 2800*0.2""",
)
def assign_columns(t):
    p = points(t)
    cols = p.select("sheet").distinct().withColumn("col_ord", F.explode(F.sequence(F.lit(0), F.lit(7)))).select("sheet", "col_ord", c("col_ord").alias("field"), (c("col_ord") * 400.0 - 1400).alias("col_x"))
    return S.assign_columns(p, cols, "sheet").select("id", "field")


@query(
    "mark_ranges",
    """WITH m AS (SELECT event_id, user_id, event_id AS r, (SELECT max(event_id)+1 FROM events) AS n FROM events), l AS (SELECT *, lag(r) OVER w AS p, lead(r) OVER w AS x FROM m WINDOW w AS (PARTITION BY user_id ORDER BY r))
    SELECT event_id, user_id, CAST(CASE WHEN p IS NULL THEN 0 ELSE (p+r)//2+1 END AS BIGINT) AS row_start, CAST(CASE WHEN x IS NULL THEN n ELSE (r+x)//2+1 END AS BIGINT) AS row_end FROM l""",
)
def mark_ranges(t):
    m = t.events.select("event_id", "user_id", c("event_id").alias("r"), t.events.agg(F.max("event_id") + 1).scalar().alias("n"))
    return S.mark_ranges(m, ["user_id"], "r", "event_id", "n").select("event_id", "user_id", "row_start", "row_end")


@query(
    "zone_ranges",
    """WITH g AS (SELECT user_id, min(event_id) AS rs, max(event_id)+1 AS re FROM events GROUP BY 1), a AS (SELECT user_id, event_id AS r FROM events WHERE event_type='click' AND value>100),
    l AS (SELECT g.*, r, lag(r) OVER w AS p, lead(r) OVER w AS x, row_number() OVER w AS z FROM g LEFT JOIN a USING (user_id) WINDOW w AS (PARTITION BY user_id ORDER BY r))
    SELECT user_id, CAST(z AS BIGINT) AS zone_ord, CAST(CASE WHEN p IS NULL THEN rs ELSE rs+(p+r-2*rs)//2+1 END AS BIGINT) AS zone_start, CAST(CASE WHEN x IS NULL THEN re ELSE rs+(r+x-2*rs)//2+1 END AS BIGINT) AS zone_end FROM l""",
)
def zone_ranges(t):
    ranges = t.events.groupBy("user_id").agg(F.min("event_id").alias("row_start"), (F.max("event_id") + 1).alias("row_end"))
    anchors = t.events.filter("event_type = 'click' AND value > 100").select("user_id", c("event_id").alias("r"))
    return S.zone_ranges(anchors, ranges, ["user_id"], "r").select("user_id", "zone_ord", "zone_start", "zone_end")


@query(
    "truncate_rows",
    """SELECT event_id FROM events e WHERE event_id < coalesce((SELECT min(event_id) FROM events x WHERE x.user_id=e.user_id AND x.event_type='error' AND x.value>60), 1e18)""",
)
def truncate_rows(t):
    hit = (c("event_type") == "error") & (c("value") > 60)
    return S.truncate_at_first(t.events, ["user_id"], "event_id", hit).select("event_id")


@query(
    "header_rows",
    """WITH l AS (SELECT user_id, event_id AS r, value, CASE WHEN event_type='view' AND value>60 THEN 'DIA. in mm NOS' WHEN event_type='click' AND value>50 THEN 'TOTAL LENGTH nos' ELSE 'LENGTH' END AS t FROM events),
    n AS (SELECT user_id, min(r) FILTER (WHERE t<>'LENGTH' AND r>=(SELECT max(event_id)//2 FROM events)) AS a, min(r) FILTER (WHERE t<>'LENGTH') AS b FROM l GROUP BY 1)
    SELECT user_id, coalesce(a,b) AS header_row, a IS NULL AS from_whole FROM n""",
)
def header_rows(t):
    e, v = c("event_type"), c("value")
    text = F.when((e == "view") & (v > 60), "DIA. in mm NOS").when((e == "click") & (v > 50), "TOTAL LENGTH nos").otherwise("LENGTH")
    lines = t.events.select("user_id", c("event_id").alias("r"), text.alias("row_text"))
    half = t.events.agg(F.floor(F.max("event_id") / 2)).scalar()
    return S.header_row(lines.filter(c("r") >= half), lines, ["user_id"], "r")


@query(
    "table_windows",
    """WITH l AS (SELECT event_id, user_id, value AS x, lag(value) OVER w AS p, lead(value) OVER w AS n FROM events WHERE event_type='signup' WINDOW w AS (PARTITION BY user_id ORDER BY value, event_id))
    SELECT event_id, round(coalesce((p+x)/2, -1.0),4) AS "left", round(coalesce((x+n)/2, 1000.0),4) AS "right" FROM l""",
)
def table_windows(t):
    labels = t.events.filter("event_type = 'signup'").select("event_id", "user_id", c("value").alias("x"), F.lit(-1.0).alias("lo"), F.lit(1000.0).alias("hi"))
    out = S.table_windows(labels, ["user_id"], "x", "event_id", "lo", "hi")
    return out.select("event_id", F.round("left", 4).alias("left"), F.round("right", 4).alias("right"))


@query(
    "table_header_cells",
    """WITH e AS (SELECT event_id, user_id, value AS x, CAST(ts AS DATE)-DATE '2024-01-01' AS day, event_type AS t FROM events),
    l AS (SELECT event_id AS tid, user_id, day AS lday, x, lag(x) OVER w AS p, lead(x) OVER w AS n FROM e WHERE t='signup' AND day<12 WINDOW w AS (PARTITION BY user_id ORDER BY x, event_id)),
    k AS (SELECT tid, e.* FROM e JOIN l ON l.user_id=e.user_id AND e.day>lday AND e.x>=coalesce((p+l.x)/2, -1.0) AND e.x<coalesce((l.x+n)/2, 1000.0)),
    f AS (SELECT tid, min(day) AS stop FROM (SELECT tid, day, arg_min(t, {'x': x, 'e': event_id}) AS t FROM k WHERE t<>'purchase' GROUP BY 1,2) WHERE t='error' GROUP BY 1)
    SELECT tid, event_id FROM k LEFT JOIN f USING (tid) WHERE stop IS NULL OR day<stop""",
)
def table_header_cells(t):
    day = F.datediff(c("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    e = c("event_type")
    text = F.when(e == "error", F.concat(F.lit(" (LP"), c("event_id").cast("string"), F.lit(" 110.5"))).when(e == "purchase", "  ").otherwise(F.concat(F.upper(e), F.lit(" LVL")))
    cells = t.events.select("user_id", c("event_id").alias("ord"), c("value").alias("x"), day.alias("row"), (-day).cast("double").alias("row_y"), text.alias("text"), "event_type")
    labels = cells.filter("event_type = 'signup' AND row < 12").select("user_id", c("ord").alias("tid"), "x", c("row_y").alias("y"), F.lit(-1.0).alias("lo"), F.lit(1000.0).alias("hi"))
    windows = S.table_windows(labels, ["user_id"], "x", "tid", "lo", "hi")
    return S.table_header_cells(cells.drop("event_type"), windows, ["user_id"], "tid").select("tid", c("ord").alias("event_id"))


@query(
    "section_bands",
    """WITH f AS (SELECT user_id, event_type, min(value) AS y FROM events WHERE value<100*0.80 GROUP BY 1,2)
    SELECT user_id, event_type, y AS y_start, round(coalesce(lead(y) OVER (PARTITION BY user_id ORDER BY y, event_type), 82.0),4) AS y_end FROM f""",
)
def section_bands(t):
    heads = t.events.select("user_id", "event_type", "value", F.lit(100.0).alias("h"))
    out = S.section_bands(heads, ["user_id"], "event_type", "value", "h")
    return out.select("user_id", "event_type", "y_start", F.round("y_end", 4).alias("y_end"))


@query(
    "bucket_rows",
    """SELECT l_orderkey, CAST(round_even(l_quantity/4,0) AS BIGINT)*4 AS line, string_agg(l_returnflag||l_linenumber, ' ' ORDER BY l_extendedprice, l_partkey) AS text, count(*) AS words FROM lineitem GROUP BY 1,2""",
)
def bucket_rows(t):
    w = t.lineitem.select("l_orderkey", "l_quantity", "l_extendedprice", "l_partkey", F.concat("l_returnflag", c("l_linenumber").cast("string")).alias("w"))
    return S.bucket_rows(w, ["l_orderkey"], "l_quantity", "l_extendedprice", "w", "l_partkey", 4)


@query(
    "header_columns",
    """WITH RECURSIVE w AS (SELECT l_orderkey AS k, l_suppkey*10.0 AS x, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey, l_linenumber, l_partkey, l_extendedprice) AS i,
      ['DIA','nos','LENGTH','TOTAL','MK.','SPACING','WT'][l_linenumber] AS t FROM lineitem),
    sp AS (SELECT k, greatest((max(x)-min(x))*0.02, 50.0) AS tol FROM w GROUP BY 1),
    s AS (SELECT k, i, x AS a, x, t FROM w WHERE i=1 UNION ALL SELECT w.k, w.i, CASE WHEN w.x-s.a>=tol THEN w.x ELSE s.a END, w.x, w.t FROM s JOIN w ON w.k=s.k AND w.i=s.i+1 JOIN sp ON sp.k=w.k),
    h AS (SELECT k, a, string_agg(upper(t), ' ' ORDER BY x, i) AS head FROM s GROUP BY 1,2),
    f AS (SELECT k, a, 'bar_dia_mm' AS field FROM h WHERE contains(head,'DIA') UNION ALL SELECT k, a, 'count' FROM h WHERE contains(head,'NOS') UNION ALL SELECT k, a, 'length_m' FROM h WHERE contains(head,'LENGTH')
      UNION ALL SELECT k, a, 'total_length_m' FROM h WHERE contains(head,'TOTAL') AND contains(head,'LENGTH') UNION ALL SELECT k, a, 'total_wt_kg' FROM h WHERE contains(head,'TOTAL') AND contains(head,'WT')
      UNION ALL SELECT k, a, 'bar_mark' FROM h WHERE contains(head,'MK') UNION ALL SELECT k, a, 'spacing_mm' FROM h WHERE contains(head,'SPACING'))
    SELECT k, field, CAST(min(a) AS DOUBLE) AS col_x FROM f GROUP BY 1,2""",
)
def header_columns(t):
    from spanledger.plans.scan import numbered

    heads = F.array(*[F.lit(x) for x in ("DIA", "nos", "LENGTH", "TOTAL", "MK.", "SPACING", "WT")])
    rows = numbered(t.lineitem, ["l_orderkey"], ["l_suppkey", "l_linenumber", "l_partkey", "l_extendedprice"], "ord")
    cells = rows.select(c("l_orderkey").alias("k"), (c("l_suppkey") * 10.0).alias("x"), "ord", F.get(heads, c("l_linenumber") - 1).alias("text"))
    return S.header_columns(cells, "k").select("k", "field", "col_x")


@query(
    "zone_values",
    """WITH r AS (SELECT l_orderkey AS k, l_linenumber AS l, l_suppkey AS s, l_partkey AS p, l_quantity AS q, l_extendedprice AS e, (CAST(l_linenumber AS BIGINT)*1000000000+l_suppkey*1000000+l_partkey) AS ord FROM lineitem),
    g AS (SELECT k, sum(CAST(q AS BIGINT)) FILTER (WHERE l=1 AND s%3=0) AS eq, sum(CAST(q AS BIGINT)*2) FILTER (WHERE l=1 AND s%3=1) AS mul, sum(CAST(q AS BIGINT)) FILTER (WHERE l=1 AND s%3=2) AS bare,
      arg_min(8+p%3*2, (ord,e)) FILTER (WHERE l=2) AS dia, arg_min(q/4, (ord,e)) FILTER (WHERE l=3 AND p%4<>0) AS len, sum(q*10) FILTER (WHERE l=4) AS tl, sum(q+1000) FILTER (WHERE l=5) AS tw FROM r GROUP BY 1),
    v AS (SELECT k, dia, len, tl, tw, CASE WHEN eq IS NOT NULL THEN eq WHEN mul IS NOT NULL THEN CASE WHEN bare IS NOT NULL AND len<>0 AND tl<>0 AND abs(mul*len-tl)>tl*0.05 AND abs(bare*len-tl)<=tl*0.05 THEN bare ELSE mul END ELSE bare END AS cnt FROM g)
    SELECT k, CAST(dia AS INTEGER) AS bar_dia_mm, CAST(len AS DOUBLE) AS length_m, CAST(tl AS DOUBLE) AS total_length_m, CAST(tw AS DOUBLE) AS total_wt_kg, CAST(cnt AS BIGINT) AS count FROM v WHERE dia IS NOT NULL OR len IS NOT NULL OR cnt IS NOT NULL""",
)
def zone_values(t):
    l, s, p, q = c("l_linenumber"), c("l_suppkey"), c("l_partkey"), c("l_quantity")
    big = l.cast("long")
    n = q.cast("long").cast("string")
    field = F.get(F.array(*[F.lit(x) for x in ("count", "bar_dia_mm", "length_m", "total_length_m", "total_wt_kg", "none", "none")]), l - 1)
    count = F.when(s % 3 == 0, F.concat(F.lit("= "), n)).when(s % 3 == 1, F.concat(n, F.lit("x2"))).otherwise(n)
    text = (
        F.when(l == 1, count).when(l == 2, F.concat((8 + p % 3 * 2).cast("string"), F.lit("Ø")))
        .when(l == 3, F.when(p % 4 == 0, "-").otherwise((q / 4).cast("string")))
        .when(l == 4, (q * 10).cast("string")).otherwise(F.concat(F.lit("1,0"), F.lpad(n, 2, "0")))
    )
    cells = t.lineitem.select(c("l_orderkey").alias("k"), field.alias("field"), text.alias("text"), (big * 1000000000 + s * 1000000 + p).alias("row"), c("l_extendedprice").alias("x"), F.lit(0).alias("ord"))
    return S.zone_values(cells, ["k"]).select("k", "bar_dia_mm", "length_m", "total_length_m", "total_wt_kg", "count")


@query(
    "shape_dims",
    """WITH d AS (SELECT DISTINCT l_orderkey, round_even(l_suppkey/10,0) AS x, l_quantity*5 AS v FROM lineitem WHERE l_suppkey/10>2 AND l_suppkey/10<8 AND l_quantity*5>=50)
    SELECT l_orderkey, string_agg(CAST(v AS VARCHAR), ',' ORDER BY v) AS dims FROM d GROUP BY 1""",
)
def shape_dims(t):
    cells = t.lineitem.select(
        "l_orderkey", (c("l_suppkey") / 10).alias("x"), (c("l_quantity") * 5).cast("string").alias("text"), c("l_partkey").alias("row"), c("l_extendedprice").alias("ord"),
        F.lit(2.0).alias("lo"), F.lit(8.0).alias("hi"),
    )
    out = S.shape_dims(cells, ["l_orderkey"], "lo", "hi")
    return out.select("l_orderkey", F.array_join(F.transform("shape_dimensions", lambda v: v.cast("string")), ",").alias("dims"))


@query(
    "merge_marks",
    """WITH r AS (SELECT l_orderkey, l_returnflag, l_linenumber*100000000+l_suppkey*1000000+l_partkey AS ord, l_extendedprice AS e, CASE WHEN l_partkey%6<>0 THEN l_quantity END AS q, l_linestatus AS st FROM lineitem)
    SELECT l_orderkey, l_returnflag, arg_min(st, (ord,e)) AS l_linestatus, CASE WHEN (arg_min({'q':q}, (ord,e))).q IS NOT NULL THEN sum(q) END AS count FROM r GROUP BY 1,2""",
)
def merge_marks(t):
    ord_ = F.struct((c("l_linenumber") * 100000000 + c("l_suppkey") * 1000000 + c("l_partkey")).alias("o"), c("l_extendedprice").alias("e"))
    rows = t.lineitem.select("l_orderkey", "l_returnflag", ord_.alias("ord"), "l_linestatus", F.when(c("l_partkey") % 6 != 0, c("l_quantity").cast("string")).otherwise("n/a").alias("count"))
    return S.merge_duplicate_marks(rows, ["l_orderkey", "l_returnflag"], "ord", ["count"], ["l_linestatus"])
