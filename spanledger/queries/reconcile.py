"""Reconciliation operators; design and drawing sides both come from the given tables."""

from pyspark.sql import functions as F

from spanledger.functions import numbers as N
from spanledger.operators import issues as I
from spanledger.operators import reconcile as C
from spanledger.plans.scan import numbered
from spanledger.queries.registry import query

BAR = C.BAR


def sheet_bars(t):
    """Line items as schedule rows of the drawing that is their order."""
    return t.once("sheet_bars", lambda: numbered_bars(t))


def numbered_bars(t):
    comp = F.when(F.col("l_returnflag") == "A", "pilecap").when(F.col("l_returnflag") == "N", "pile").otherwise("pier")
    mark = F.char(F.lit(96) + F.col("l_linenumber"))
    rows = t.lineitem.select(
        F.col("l_orderkey").alias("drawing_id"), comp.alias("component"), mark.alias("bar_mark"),
        F.col("l_linenumber").alias("mark_ord"), "l_partkey", "l_suppkey", "l_extendedprice",
        F.col("l_quantity").alias("q"),
    )
    return numbered(rows, BAR, ["l_suppkey", "l_partkey", "l_extendedprice"], "zone_ord")


def design_bars(t):
    p = F.col("l_partkey")
    return sheet_bars(t).select(
        *BAR, "mark_ord", "zone_ord",
        (F.lit(8) + p % 5).cast("int").alias("dia_mm"),
        F.when(p % 3 == 0, 100.0 + p % 7).alias("spacing_mm"),
        F.col("q").cast("int").alias("count"),
        (F.col("q") / 4).alias("length_m"),
        (F.col("q") * 10).alias("total_len_m"),
        (1 + (p % 4) / 4).alias("unit_wt"),
        (F.col("q") * 20).alias("total_wt_kg"),
        F.when(p % 3 == 0, "spacing").when(p % 3 == 1, "count").alias("reinf_secondary"),
        F.array(F.col("q") / 10, F.col("q") / 5).alias("shape_dims"),
    )


def drawing_bars(t):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    n = F.col("q").cast("int")
    dia = (F.lit(8) + p % 5 + F.when(p % 13 == 0, 2).otherwise(0)).cast("int")
    text = F.concat(dia.cast("string"), F.lit("φ"), F.when(p % 3 == 0, F.concat(F.lit("@"), (100 + p % 7 + F.when(s % 9 == 0, 20).otherwise(0)).cast("string"), F.lit(" c/c"))).otherwise(F.concat(F.lit(" – "), n.cast("string"), F.lit(" NOS."))))
    return sheet_bars(t).filter(p % 11 != 0).select(
        *BAR, "mark_ord", "zone_ord",
        text.alias("reinforcement_text"),
        F.when(p % 2 == 0, dia).alias("bar_dia_mm"),
        F.when((p % 3 == 0) & (s % 8 != 0), 100.0 + p % 7 + F.when(s % 9 == 0, 20).otherwise(0)).alias("spacing_mm"),
        (n + F.when(s % 6 == 0, s % 5).otherwise(0)).cast("int").alias("count"),
        (F.col("q") / 4 * F.when(s % 7 == 0, 1.25).otherwise(1.0)).alias("length_m"),
        (F.col("q") * 10 * F.when(s % 10 == 0, 1.5).otherwise(1.0)).alias("total_length_m"),
        (1 + (p % 4) / 4 + F.when(s % 15 == 0, 0.5).otherwise(0)).alias("unit_wt_kg_m"),
        (F.col("q") * 20 * F.when(s % 14 == 0, 0.5).otherwise(1.0)).alias("total_wt_kg"),
        F.array(F.col("q") * 100, F.col("q") * 200 * F.when(s % 16 == 0, 1.25).otherwise(1.0)).alias("shape_dimensions"),
        F.lit(None).cast("struct<x:double,y:double,w:double,h:double>").alias("row_bbox"),
    )


def pile_counts(t):
    return t.orders.select(F.col("o_orderkey").alias("drawing_id"), (F.col("o_custkey") % 3).alias("pile_count"))


SHEET_SQL = """b AS (SELECT l_orderkey AS drawing_id, CASE l_returnflag WHEN 'A' THEN 'pilecap' WHEN 'N' THEN 'pile' ELSE 'pier' END AS component,
  chr(96+l_linenumber) AS bar_mark, l_linenumber AS mark_ord, l_partkey AS p, l_suppkey AS s, l_quantity AS q,
  row_number() OVER (PARTITION BY l_orderkey, l_returnflag, l_linenumber ORDER BY l_suppkey, l_partkey, l_extendedprice) AS zone_ord FROM lineitem),
d AS (SELECT drawing_id, component, bar_mark, mark_ord, zone_ord, CAST(8+p%5 AS INTEGER) AS dia, CASE WHEN p%3=0 THEN 100.0+p%7 END AS sp, CAST(q AS INTEGER) AS cnt,
  q/4 AS len, q*10 AS tl, 1+(p%4)/4.0 AS uw, q*20 AS tw, CASE p%3 WHEN 0 THEN 'spacing' WHEN 1 THEN 'count' END AS kind FROM b),
w AS (SELECT drawing_id, component, bar_mark, mark_ord, zone_ord, CAST(8+p%5+CASE WHEN p%13=0 THEN 2 ELSE 0 END AS INTEGER) AS dia,
  CASE WHEN p%3=0 AND s%8<>0 THEN 100.0+p%7+CASE WHEN s%9=0 THEN 20 ELSE 0 END END AS sp,
  CASE WHEN p%2=0 THEN CAST(8+p%5+CASE WHEN p%13=0 THEN 2 ELSE 0 END AS INTEGER) END AS col_dia,
  CASE WHEN p%3=0 THEN 'spacing' ELSE 'count' END AS tkind, CASE WHEN p%3=0 THEN 100.0+p%7+CASE WHEN s%9=0 THEN 20 ELSE 0 END ELSE q END AS tval,
  CAST(q AS INTEGER)+CASE WHEN s%6=0 THEN s%5 ELSE 0 END AS cnt, q/4*CASE WHEN s%7=0 THEN 1.25 ELSE 1 END AS len,
  q*10*CASE WHEN s%10=0 THEN 1.5 ELSE 1 END AS tl, 1+(p%4)/4.0+CASE WHEN s%15=0 THEN 0.5 ELSE 0 END AS uw, q*20*CASE WHEN s%14=0 THEN 0.5 ELSE 1 END AS tw FROM b WHERE p%11<>0),
m AS (SELECT drawing_id, component, bar_mark, arg_min(struct_pack(dia:=dia, sp:=sp, cnt:=cnt, len:=len, uw:=uw, kind:=kind), zone_ord) AS f, count(*) AS zones,
  sum(cnt) AS cnt, sum(tl) AS tl, sum(tw) AS tw FROM d GROUP BY 1,2,3)"""


#: Findings on bars with their titles: single values (sc), shapes (sh), totals (tot), repeated values of zone rows (zr).
#: Totals of marks with equally many zone rows pair these one by one, the largest design count first, each with the
#: closest drawing row left.
BAR_SQL = SHEET_SQL + """,
j AS (SELECT w.*, f, zones, m.cnt AS dcnt, 'Bar '''||bar_mark||''' ('||component||'): ' AS pre FROM w JOIN m USING (drawing_id, component, bar_mark)),
sc AS (SELECT drawing_id, component, bar_mark, zone_ord, unnest(list_filter([
    {'code': 'bar_dia', 'hit': f.dia<>dia, 'title': pre||'Diameter mismatch — design '||f.dia||'mm, drawing '||dia||'mm'},
    {'code': 'bar_spacing', 'hit': abs(f.sp-sp)/f.sp*100>5, 'title': pre||'Spacing mismatch — design '||CAST(f.sp AS DOUBLE)||'mm c/c, drawing '||CAST(sp AS DOUBLE)||'mm c/c'},
    {'code': 'bar_spacing_missing', 'hit': f.sp IS NOT NULL AND sp IS NULL, 'title': pre||'Spacing not found in drawing ('||CAST(f.sp AS DOUBLE)||'mm expected)'},
    {'code': 'bar_length', 'hit': abs(f.len-len)/f.len*100>2, 'title': pre||'Bar length mismatch — design '||round_even(f.len,2)||'m, drawing '||round_even(len,2)||'m'},
    {'code': 'bar_unit_weight', 'hit': abs(f.uw-uw)/f.uw*100>2, 'title': pre||'Unit weight mismatch — design '||CAST(f.uw AS DOUBLE)||' kg/m, drawing '||CAST(uw AS DOUBLE)||' kg/m'},
    {'code': 'reinf_kind', 'hit': f.kind<>tkind, 'title': pre||'Reinforcement column format wrong — shows '||CASE tkind WHEN 'spacing' THEN 'φdia@spacing c/c' ELSE 'φdia × count NOS' END
       ||', expected '||CASE f.kind WHEN 'spacing' THEN 'φdia@spacing c/c' ELSE 'φdia × count NOS' END},
    {'code': 'reinf_spacing', 'hit': f.kind='spacing' AND tkind='spacing' AND abs(f.sp-tval)/f.sp*100>5, 'title': pre||'Reinforcement column spacing mismatch — design '||CAST(f.sp AS BIGINT)||'mm, drawing text '||CAST(tval AS BIGINT)||'mm'},
    {'code': 'reinf_count', 'hit': f.kind='count' AND tkind='count' AND CAST(tval AS BIGINT)<>CASE WHEN zones>1 THEN dcnt ELSE f.cnt END,
      'title': pre||'Reinforcement column count mismatch — design '||CASE WHEN zones>1 THEN dcnt ELSE f.cnt END||' NOS, drawing text '||CAST(tval AS BIGINT)||' NOS'}
    ], lambda x: x.hit), recursive := true) FROM j),
s1 AS (SELECT j.drawing_id, j.component, j.bar_mark, j.zone_ord, pre, b.q, b.s, q1 FROM j JOIN b USING (drawing_id, component, bar_mark, zone_ord)
    JOIN (SELECT drawing_id, component, bar_mark, arg_min(q, zone_ord) AS q1 FROM b GROUP BY 1,2,3) USING (drawing_id, component, bar_mark)),
s2 AS (SELECT *, unnest([{'i': 1, 'w': q*100}, {'i': 2, 'w': q*200*CASE WHEN s%16=0 THEN 1.25 ELSE 1 END}], recursive := true) FROM s1),
s3 AS (SELECT *, CAST(round_even(w,0) AS BIGINT)::VARCHAR AS dg FROM s2),
s4 AS (SELECT *, CASE WHEN length(dg)>=2 AND dg[1]='1' AND (abs(TRY_CAST(dg[2:] AS DOUBLE)-q1*100)/(q1*100)<0.03 OR abs(TRY_CAST(dg[2:] AS DOUBLE)-q1*200)/(q1*200)<0.03) THEN TRY_CAST(dg[2:] AS DOUBLE) ELSE w END AS v FROM s3),
s5 AS (SELECT drawing_id, component, bar_mark, zone_ord, any_value(pre) AS pre, any_value(q1)*100 AS d, max(v) FILTER (WHERE i=1) AS a, max(v) FILTER (WHERE i=2) AS z FROM s4 GROUP BY 1,2,3,4),
s6 AS (SELECT *, abs(a-d)<=abs(z-d) AS own FROM s5),
sh AS (SELECT drawing_id, component, bar_mark, zone_ord, x.d AS d, x.w AS w, pre||'Bar shape dimension mismatch — design '||CAST(round_even(x.d,0) AS BIGINT)||'mm, drawing '||CAST(round_even(x.w,0) AS BIGINT)||'mm' AS title
    FROM (SELECT *, unnest([{'d': d, 'w': CASE WHEN own THEN a ELSE z END}, {'d': 2*d, 'w': CASE WHEN own THEN z ELSE a END}]) AS x FROM s6)
    WHERE abs(x.d-x.w)/x.d*100>2 AND abs(x.d-x.w)/x.d*100<=55),
ws AS (SELECT drawing_id, component, bar_mark, count(*) AS wz, sum(cnt) FILTER (WHERE cnt<>0) AS cnt, sum(tl) AS tl, sum(tw) AS tw FROM w GROUP BY 1,2,3),
tj AS (SELECT ws.*, m.zones, m.cnt AS dcnt, m.tl AS dtl, m.tw AS dtw, coalesce(m.f.sp,0)<>0 AS ring, greatest(coalesce(o_custkey%3,1),1) AS piles, wz>1 AND wz=zones AS paired
    FROM ws JOIN m USING (drawing_id, component, bar_mark) LEFT JOIN orders ON o_orderkey=drawing_id),
dl AS (SELECT drawing_id, component, bar_mark, list({'k': cnt::BIGINT, 'i': zone_ord, 'l': tl, 'w': tw} ORDER BY cnt DESC, zone_ord) AS ds FROM d GROUP BY 1,2,3),
wl AS (SELECT drawing_id, component, bar_mark, list({'i': zone_ord, 'c': cnt::BIGINT, 'l': tl, 'w': tw}) AS rows FROM w GROUP BY 1,2,3),
g AS (SELECT drawing_id, component, bar_mark, ring, piles, 0 AS n, zones, ds, rows, NULL::STRUCT(k BIGINT, i BIGINT, l DOUBLE, w DOUBLE) AS dz, NULL::STRUCT(i BIGINT, c BIGINT, l DOUBLE, w DOUBLE) AS wz
    FROM tj JOIN dl USING (drawing_id, component, bar_mark) JOIN wl USING (drawing_id, component, bar_mark) WHERE paired
  UNION ALL SELECT drawing_id, component, bar_mark, ring, piles, n+1, zones, ds, list_filter(rows, lambda x: x.i<>best.r.i), ds[n+1], best.r
    FROM (SELECT *, list_sort(list_transform(rows, lambda x: {'s': abs(ds[n+1].k-x.c), 'i': x.i, 'r': x}))[1] AS best FROM g WHERE n<zones)),
tp AS (SELECT drawing_id, component, bar_mark, ring, piles, dcnt AS dc, dtl, dtw, cnt AS wc, tl AS wtl, tw AS wtw FROM tj WHERE NOT paired
  UNION ALL SELECT drawing_id, component, bar_mark, ring, piles, dz.k, dz.l, dz.w, wz.c, wz.l, wz.w FROM g WHERE n>0),
tot AS (SELECT drawing_id, component, bar_mark, unnest(list_filter([
    {'code': 'bar_count', 'hit': abs(dc-wc) > CASE WHEN ring THEN 2*piles ELSE 0 END, 'title': 'Bar '''||bar_mark||''' ('||component||'): Count mismatch — design '||dc||' nos, drawing '||wc||' nos'},
    {'code': 'bar_total_length', 'hit': abs(dtl-wtl)/dtl*100>2, 'title': 'Bar '''||bar_mark||''' ('||component||'): Total length mismatch — design '||round_even(dtl,2)||'m, drawing '||round_even(wtl,2)||'m'},
    {'code': 'bar_weight', 'hit': abs(dtw-wtw)/dtw*100>5, 'title': 'Bar '''||bar_mark||''' ('||component||'): Total weight mismatch — design '||printf('%.1f', dtw)||'kg, drawing '||printf('%.1f', wtw)||'kg'}
    ], lambda x: x.hit), recursive := true) FROM tp),
zl AS (SELECT drawing_id, component, bar_mark, zone_ord, 'Bar length' AS label, 'm' AS unit, len AS v, CAST(CAST(len AS DOUBLE) AS VARCHAR) AS t FROM w
  UNION ALL SELECT drawing_id, component, bar_mark, zone_ord, 'Unit weight', 'kg/m', uw, CAST(CAST(uw AS DOUBLE) AS VARCHAR) FROM w
  UNION ALL SELECT drawing_id, component, bar_mark, zone_ord, 'Spacing', 'mm c/c', sp, CAST(CAST(sp AS DOUBLE) AS VARCHAR) FROM w
  UNION ALL SELECT drawing_id, component, bar_mark, zone_ord, 'Diameter', 'mm', col_dia, CAST(col_dia AS VARCHAR) FROM w),
zf AS (SELECT *, first_value(v) OVER k AS fv, first_value(t) OVER k AS ft, first_value(zone_ord) OVER k AS fz FROM zl WHERE v<>0 WINDOW k AS (PARTITION BY drawing_id, component, bar_mark, label ORDER BY zone_ord)),
zr AS (SELECT drawing_id, component, bar_mark, label, 'Bar '''||bar_mark||''' ('||component||'): '||label||' differs between drawing zone-rows — row '||fz||': '||ft||unit||', row '||zone_ord||': '||t||unit AS title
  FROM zf WHERE abs(fv-v)/fv*100>2)"""


def scalar_issues(t):
    return C.bar_scalar_issues(C.mark_summary(design_bars(t)), drawing_bars(t))


def total_issues(t):
    return C.bar_total_issues(design_bars(t), drawing_bars(t), pile_counts(t))


@query(
    "bar_issues",
    f"""WITH RECURSIVE {BAR_SQL} SELECT drawing_id, component, bar_mark, CAST(zone_ord AS BIGINT) AS zone_ord, code, title FROM sc
    UNION ALL SELECT drawing_id, component, bar_mark, CAST(zone_ord AS BIGINT), 'bar_shape', title FROM sh""",
)
def bar_issues(t):
    return scalar_issues(t).select(*BAR, "zone_ord", "code", "title")


@query("bar_totals", f"WITH RECURSIVE {BAR_SQL} SELECT drawing_id, component, bar_mark, code, title FROM tot")
def bar_totals(t):
    return total_issues(t).select(*BAR, "code", "title")


@query(
    "bar_zone_pairs",
    f"WITH RECURSIVE {BAR_SQL} SELECT drawing_id, component, bar_mark, dz.i AS design_ord, wz.i AS drawing_ord FROM g WHERE n>0",
)
def bar_zone_pairs(t):
    # The zone rows that are compared with each other, for all marks with equally many on both sides.
    pairs = C.zone_pairs(design_bars(t), drawing_bars(t))
    return pairs.select(*BAR, *[F.col(f"{side}.ord").cast("bigint").alias(f"{side}_ord") for side in ("design", "drawing")])


@query(
    "bar_shapes",
    f"WITH RECURSIVE {BAR_SQL} SELECT drawing_id, component, bar_mark, zone_ord, round(d,3) AS design_mm, round(w,3) AS drawing_mm FROM sh",
)
def bar_shapes(t):
    # All segments off their design length.
    dims = N.match_dims(F.col("d.shape_dims"), F.col("shape_dimensions"))
    pairs = drawing_bars(t).join(C.mark_summary(design_bars(t)), BAR).select(*BAR, "zone_ord", F.explode(dims).alias("p"))
    pct = N.pct_diff(F.col("p.design_mm"), F.col("p.drawing_mm"))
    off = pairs.filter((pct > 2) & (pct <= 55))
    return off.select(*BAR, "zone_ord", F.round("p.design_mm", 3).alias("design_mm"), F.round("p.drawing_mm", 3).alias("drawing_mm"))


@query(
    "bar_match",
    """WITH d AS (SELECT p_brand, p_partkey FROM part WHERE p_size<40),
    w AS (SELECT DISTINCT p_brand, p_partkey FROM lineitem JOIN part ON p_partkey=l_partkey WHERE l_quantity>=45 AND p_brand NOT IN ('Brand#7','Brand#11')),
    s AS (SELECT DISTINCT p_brand FROM w)
    SELECT p_brand, NULL::BIGINT AS p_partkey, 'component_missing' AS outcome FROM (SELECT DISTINCT p_brand FROM d) WHERE p_brand NOT IN (SELECT p_brand FROM s)
    UNION ALL SELECT d.p_brand, d.p_partkey, CASE WHEN w.p_partkey IS NULL THEN 'mark_missing' ELSE 'matched' END
    FROM d LEFT JOIN w USING (p_brand, p_partkey) WHERE d.p_brand IN (SELECT p_brand FROM s)""",
)
def bar_match(t):
    design = t.part.filter("p_size < 40").select("p_brand", "p_partkey")
    brands = t.part.select("p_brand", F.col("p_partkey").alias("l_partkey"))
    drawing = (
        t.lineitem.filter("l_quantity >= 45").select("l_partkey").join(brands, "l_partkey")
        .filter(~F.col("p_brand").isin("Brand#7", "Brand#11")).withColumnRenamed("l_partkey", "p_partkey")
    )
    return C.match_bars(design, drawing, ["p_brand", "p_partkey"], ["p_brand"])


@query(
    "missing_bars",
    f"""WITH {SHEET_SQL}, sc AS (SELECT o_orderkey AS drawing_id, CASE o_orderstatus WHEN 'F' THEN ['pile'] WHEN 'P' THEN ['pier','pilecap'] END AS scope FROM orders),
    dm AS (SELECT DISTINCT drawing_id, component, bar_mark FROM d), wc AS (SELECT DISTINCT drawing_id, component FROM w), wm AS (SELECT DISTINCT drawing_id, component, bar_mark FROM w)
    SELECT drawing_id, component, NULL AS bar_mark, upper(component[1])||component[2:]||' schedule not found in drawing' AS title FROM (SELECT DISTINCT drawing_id, component FROM dm) x
      LEFT JOIN sc USING (drawing_id) WHERE (drawing_id, component) NOT IN (SELECT (drawing_id, component) FROM wc) AND (scope IS NULL OR list_contains(scope, component))
    UNION ALL SELECT drawing_id, component, bar_mark, 'Bar mark '''||bar_mark||''' ('||component||') not found in drawing schedule' FROM dm
      WHERE (drawing_id, component) IN (SELECT (drawing_id, component) FROM wc) AND (drawing_id, component, bar_mark) NOT IN (SELECT (drawing_id, component, bar_mark) FROM wm)""",
)
def missing_bars(t):
    status, name = F.col("o_orderstatus"), F.lit("SECTION A-A FOR PILECAP & PIER")
    sections = t.orders.select(
        F.col("o_orderkey").alias("drawing_id"),
        F.when(status == "F", "SECTION Z-Z (PILE)").when(status == "P", name).otherwise("PLAN OF PILECAP").alias("name"),
        F.lit(True).alias("present"),
    )
    scope = C.components_on_sheet(sections, "drawing_id")
    return C.missing_bar_issues(design_bars(t), drawing_bars(t), scope).select(*BAR, "title")


@query(
    "zone_consistency",
    """WITH g AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_extendedprice, l_tax FROM lineitem WHERE l_tax<>0),
    f AS (SELECT *, first_value(l_tax) OVER w AS first_value, first_value(l_linenumber) OVER w AS first_ord FROM g
      WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_extendedprice))
    SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_extendedprice, l_tax, first_value, first_ord FROM f WHERE abs(first_value-l_tax)/first_value*100>2""",
)
def zone_consistency(t):
    order = ["l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice"]
    return C.zone_consistency(t.lineitem.select("l_orderkey", *order, "l_tax"), ["l_orderkey"], order, "l_tax")


@query("zone_issues", f"WITH RECURSIVE {BAR_SQL} SELECT drawing_id, component, bar_mark, title FROM zr")
def zone_issues(t):
    return C.zone_issues(drawing_bars(t)).select(*BAR, "title")


@query(
    "spread_check",
    """SELECT l_partkey, max(l_quantity) AS hi, min(l_quantity) AS lo, count(*) AS n FROM lineitem GROUP BY 1
    HAVING count(*)>1 AND (max(l_quantity)-min(l_quantity))/max(l_quantity)*100 > 96""",
)
def spread_check(t):
    return C.spread_check(t.lineitem, ["l_partkey"], "l_quantity", F.lit(96.0))


@query(
    "geometry_check",
    """SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, round(abs(l_extendedprice/l_quantity-p_retailprice)/p_retailprice*100,4) AS diff_pct
    FROM lineitem JOIN part ON p_partkey=l_partkey WHERE abs(l_extendedprice/l_quantity-p_retailprice)/p_retailprice*100 > CASE WHEN p_size>25 THEN 200.0 ELSE 50.0 END""",
)
def geometry_check(t):
    readings = t.lineitem.select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit"))
    design = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_retailprice", F.when(F.col("p_size") > 25, 200.0).otherwise(50.0).alias("tol"))
    out = C.geometry_deviation(readings, design, ["l_partkey"], "unit", "p_retailprice", "tol")
    return out.select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", F.round("diff_pct", 4).alias("diff_pct"))


@query(
    "geometry_issues",
    """WITH r AS (SELECT l_orderkey AS id, CASE l_linenumber WHEN 1 THEN 'pilecap_depth' WHEN 2 THEN 'pile_spacing' WHEN 3 THEN 'pile_overhang' WHEN 4 THEN 'pile_dia' WHEN 5 THEN 'pier_plan_dim' ELSE 'pilecap_width' END AS param,
        l_quantity*100 AS v, l_linenumber*1000000+l_suppkey*10000+l_partkey AS ord FROM lineitem),
    dg AS (SELECT o_orderkey AS id, unnest([{'k':'pilecap_depth','v':1.5},{'k':'pile_spacing','v':3.0},{'k':'pile_overhang','v':0.5},{'k':'pile_dia','v':1.0+o_custkey%3},{'k':'pier_length','v':2.0},{'k':'pier_width','v':4.0},{'k':'pilecap_length_across','v':2.5}], recursive:=true) FROM orders),
    pp AS (SELECT id, arg_min(v, ord) AS v FROM r WHERE param='pier_plan_dim' GROUP BY 1),
    ck AS (SELECT dg.id, k AS param, dg.v*1000 AS d, CASE k WHEN 'pile_overhang' THEN 5.0 ELSE 2.0 END AS tol FROM dg WHERE k IN ('pilecap_depth','pile_spacing','pile_overhang','pile_dia')
       UNION ALL SELECT id, 'pilecap_width', v*1000, 2.0 FROM dg WHERE k='pilecap_length_across'
       UNION ALL SELECT id, 'pier_plan_dim', CASE WHEN abs(v-2000)<=abs(v-4000) THEN 2000 ELSE 4000 END, 5.0 FROM pp),
    m AS (SELECT DISTINCT id FROM r)
    SELECT id AS drawing_id, 'geometry' AS code, param, count(*) AS n FROM r JOIN ck USING (id, param) WHERE abs(r.v-d)/d*100>tol GROUP BY ALL
    UNION ALL SELECT id, 'geometry_missing', 'pilecap_depth', 1 FROM m WHERE id IN (SELECT o_orderkey FROM orders) AND id NOT IN (SELECT id FROM r WHERE param='pilecap_depth')
    UNION ALL SELECT id, 'geometry_spread', param, 1 FROM r JOIN ck USING (id, param) GROUP BY id, param, tol HAVING count(*)>1 AND (max(r.v)-min(r.v))/max(r.v)*100>tol""",
)
def geometry_issues(t):
    labels = {label: p for p, _, _, label, _ in C.GEOMETRY_CHECKS} | {"Pier plan dimension": "pier_plan_dim"}
    back = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    param = back[F.regexp_extract("title", r"^(.*?): ", 1)].alias("param")
    return geometry_findings(t).groupBy("drawing_id", "code", param).agg(F.count(F.lit(1)).alias("n"))


def geometry_findings(t):
    c = F.col
    names = ["pilecap_depth", "pile_spacing", "pile_overhang", "pile_dia", "pier_plan_dim"]
    param = F.lit("pilecap_width")
    for i, n in enumerate(names):
        param = F.when(c("l_linenumber") == i + 1, n).otherwise(param)
    readings = t.lineitem.select(
        c("l_orderkey").alias("drawing_id"), param.alias("param"), (c("l_quantity") * 100).alias("val_mm"),
        F.lit(10.0).alias("x_pct"), F.lit(20.0).alias("y_pct"),
        (c("l_linenumber") * 1000000 + c("l_suppkey") * 10000 + c("l_partkey")).alias("ord"),
    )
    values = {"pilecap_depth": F.lit(1.5), "pile_spacing": F.lit(3.0), "pile_overhang": F.lit(0.5), "pile_dia": 1.0 + c("o_custkey") % 3,
              "pier_length": F.lit(2.0), "pier_width": F.lit(4.0), "pilecap_length_across": F.lit(2.5)}
    kv = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("double").alias("value")) for k, v in values.items()])
    design = t.orders.select(c("o_orderkey").alias("drawing_id"), F.inline(kv))
    return C.geometry_issues(readings, design)


@query(
    "companion_order",
    """WITH m AS (SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_suppkey%3=0 THEN chr(CAST(97+l_partkey%2 AS INTEGER)) ELSE chr(CAST(97+l_partkey%2 AS INTEGER))||(l_suppkey%3) END AS mark, l_linenumber*100000+l_partkey AS ord FROM lineitem),
    b AS (SELECT l_orderkey, mark AS base, min(ord) AS base_ord FROM m WHERE length(mark)=1 GROUP BY 1,2)
    SELECT m.l_orderkey, m.mark, m.ord, b.base, b.base_ord FROM m JOIN b ON b.l_orderkey=m.l_orderkey AND b.base=m.mark[1] WHERE length(m.mark)=2 AND base_ord>ord""",
)
def companion_order(t):
    letter = F.char(F.lit(97) + F.col("l_partkey") % 2)
    s = F.col("l_suppkey") % 3
    marks = t.lineitem.select(
        "l_orderkey", F.when(s == 0, letter).otherwise(F.concat(letter, s.cast("string"))).alias("mark"),
        (F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("ord"),
    )
    return C.companion_order(marks, ["l_orderkey"], "mark", "ord").select("l_orderkey", "mark", "ord", "base", "base_ord")


@query(
    "callout_gaps",
    """WITH d AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS m FROM lineitem), w AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS m FROM lineitem WHERE l_partkey%4<>0),
    c AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS m FROM lineitem WHERE l_returnflag='R')
    SELECT k, m FROM d WHERE (k,m) IN (SELECT (k,m) FROM w) AND k IN (SELECT k FROM c) AND (k,m) NOT IN (SELECT (k,m) FROM c)""",
)
def callout_gaps(t):
    rows = t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("m"), "l_partkey", "l_returnflag")
    return C.callout_gaps(rows, rows.filter("l_partkey % 4 <> 0"), rows.filter("l_returnflag = 'R'"), "k", "m")


@query(
    "section_bars",
    f"""WITH {SHEET_SQL}, tt AS (SELECT drawing_id, component, bar_mark, sum(cnt) AS total FROM w GROUP BY 1,2,3 HAVING sum(cnt)<>0),
    x AS (SELECT b.drawing_id, b.component, b.bar_mark, b.zone_ord, b.p%40 AS visual_count, total, CASE WHEN b.s%2=0 THEN 2 ELSE 1 END AS bundle,
      CASE WHEN b.component='pile' THEN greatest(coalesce(o_custkey%3,1),1) ELSE 1 END AS piles FROM b JOIN tt USING (drawing_id, component, bar_mark) LEFT JOIN orders ON o_orderkey=drawing_id)
    SELECT drawing_id, component, bar_mark, zone_ord, visual_count, CAST(round_even(total/(piles*bundle),0) AS BIGINT) AS expected FROM x WHERE visual_count<>CAST(round_even(total/(piles*bundle),0) AS BIGINT)""",
)
def section_bars(t):
    sections = sheet_bars(t).select(*BAR, "zone_ord", (F.col("l_partkey") % 40).alias("visual_count"), (F.col("l_suppkey") % 2 == 0).alias("is_bundle"))
    out = C.section_bars(sections, drawing_bars(t).drop("zone_ord").withColumn("zone_ord", F.lit(1)), pile_counts(t))
    return out.select(*BAR, sections["zone_ord"], "visual_count", "expected")


@query(
    "y_calibration",
    """WITH a AS (SELECT o_custkey AS k, month(o_orderdate) AS m, avg(o_totalprice) AS y FROM orders WHERE o_orderstatus='F' GROUP BY 1,2),
    b AS (SELECT o_custkey AS k, month(o_orderdate) AS m, avg(o_totalprice) AS y FROM orders WHERE o_orderstatus<>'F' GROUP BY 1,2),
    j AS (SELECT k, m, a.y AS ya, b.y AS yb FROM a JOIN b USING (k, m)),
    e AS (SELECT k, arg_min(ya,m) AS la, arg_max(ya,m) AS ha, arg_min(yb,m) AS lb, arg_max(yb,m) AS hb, count(*) AS n FROM j GROUP BY 1)
    SELECT k, round((hb-lb)/(ha-la),4) AS scale, round(lb-(hb-lb)/(ha-la)*la,1) AS "offset" FROM e WHERE n>=2 AND abs(ha-la)>=0.5""",
)
def y_calibration(t):
    o = t.orders.select(F.col("o_custkey").alias("k"), F.month("o_orderdate").alias("m"), "o_orderstatus", "o_totalprice")
    side = lambda f: o.filter(f).groupBy("k", "m").agg(F.avg("o_totalprice").alias("y"))
    out = C.y_calibration(side("o_orderstatus = 'F'"), side("o_orderstatus <> 'F'"), ["k"], "m", F.col("m"), "y")
    return out.select("k", F.round("scale", 4).alias("scale"), F.round("offset", 1).alias("offset"))


@query(
    "title_check",
    r"""WITH f AS (SELECT o_orderkey AS id, unnest([{'field':'drawing_number','v':o_orderkey::VARCHAR},{'field':'revision','v':CASE WHEN o_custkey%2=0 THEN 'R'||o_custkey ELSE 'REV'||o_custkey END},
      {'field':'title','v':CASE WHEN o_custkey%3=0 THEN '' ELSE 'x' END},{'field':'date','v':o_orderdate::VARCHAR},{'field':'scale','v':CASE WHEN o_custkey%5=0 THEN NULL ELSE '1:50' END}], recursive:=true) FROM orders)
    SELECT o_orderkey AS drawing_id, CAST(2 AS INTEGER) AS "check", 'Missing field: '||x.field AS title FROM orders, (SELECT unnest(['drawing_number','revision','title','drawn_by','approved_by','date','scale']) AS field) x
      LEFT JOIN f ON f.id=o_orderkey AND f.field=x.field WHERE coalesce(f.v,'')=''
    UNION ALL SELECT id, 2, 'Revision format invalid: "'||v||'"' FROM f WHERE field='revision' AND NOT regexp_full_match(v,'R\d+')""",
)
def title_check(t):
    return title_issues(t).select("drawing_id", F.get("ord", 0).alias("check"), "title")


def title_issues(t):
    c = F.col
    fields = {
        "drawing_number": c("o_orderkey").cast("string"),
        "revision": F.concat(F.when(c("o_custkey") % 2 == 0, "R").otherwise("REV"), c("o_custkey").cast("string")),
        "title": F.when(c("o_custkey") % 3 == 0, "").otherwise("x"),
        "date": c("o_orderdate").cast("string"),
        "scale": F.when(c("o_custkey") % 5 != 0, "1:50"),
    }
    long = t.orders.select(c("o_orderkey").alias("drawing_id"), F.inline(F.array(*[F.struct(F.lit(k).alias("field"), v.alias("value")) for k, v in fields.items()])))
    return C.title_check(long, t.orders.select(c("o_orderkey").alias("drawing_id")), "drawing_id")


@query(
    "notes_check",
    """WITH n AS (SELECT o_orderkey AS id, CASE o_custkey%3 WHEN 0 THEN 'M35' WHEN 1 THEN 'm40' END AS lap, CASE WHEN o_custkey%4<>0 THEN 'M40' END AS pile, 20.0+o_custkey%2 AS pl, 20.0 AS dl, o_custkey%5 AS pf, 3.0 AS df FROM orders)
    SELECT id AS drawing_id, 'lap_grade' AS code FROM n WHERE upper(lap)<>upper(pile) UNION ALL SELECT id, 'lap_grade_missing' FROM n WHERE lap IS NULL
    UNION ALL SELECT id, 'pile_length' FROM n WHERE abs(dl-pl)/dl*100>1 UNION ALL SELECT id, 'pile_fixity' FROM n WHERE pf<>0 AND abs(df-pf)/df*100>1""",
)
def notes_check(t):
    return notes_issues(t).select("drawing_id", "code")


def notes_issues(t):
    c = F.col("o_custkey")
    notes = t.orders.select(
        F.col("o_orderkey").alias("drawing_id"),
        F.when(c % 3 == 0, "M35").when(c % 3 == 1, "m40").alias("lap_length_concrete_grade"),
        F.when(c % 4 != 0, "M40").alias("concrete_pile"),
        (20.0 + c % 2).alias("pile_length_m"), F.lit(20.0).alias("pile_length"),
        (c % 5).cast("double").alias("pile_fixity_m"), F.lit(3.0).alias("pile_fixity"),
    )
    return C.notes_check(notes, "drawing_id")


@query(
    "overlay_fields",
    """SELECT coalesce(c.k, s.k) AS k, coalesce(c.bal, s.bal) AS bal, coalesce(c.name, s.name) AS name FROM
    (SELECT c_custkey AS k, CASE WHEN c_acctbal>5000 THEN c_acctbal END AS bal, CASE WHEN c_nationkey<20 THEN c_name END AS name FROM customer WHERE c_custkey%3<>0) c
    FULL JOIN (SELECT s_suppkey AS k, s_acctbal AS bal, s_name AS name FROM supplier) s ON c.k=s.k""",
)
def overlay_fields(t):
    a = t.customer.filter("c_custkey % 3 <> 0").select(
        F.col("c_custkey").alias("k"), F.when(F.col("c_acctbal") > 5000, F.col("c_acctbal")).alias("bal"),
        F.when(F.col("c_nationkey") < 20, F.col("c_name")).alias("name"),
    )
    b = t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("bal"), F.col("s_name").alias("name"))
    return C.overlay(a, b, ["k"], ["bal", "name"])


@query(
    "keyed_union",
    """SELECT k, arg_max(v, r) AS v FROM (SELECT c_custkey AS k, c_mktsegment AS v, 0 AS r FROM customer UNION ALL
    SELECT o_custkey, CASE WHEN o_orderstatus='F' THEN '' ELSE o_orderpriority END, 1 FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)=1)
    UNION ALL SELECT s_suppkey, s_name, 2 FROM supplier) WHERE v<>'' GROUP BY 1""",
)
def keyed_union(t):
    from spanledger.plans.scan import first_per

    first = first_per(t.orders, ["o_custkey"], ["o_orderkey"])
    a = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    b = first.select(F.col("o_custkey").alias("k"), F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_orderpriority")).alias("v"))
    s = t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v"))
    return C.keyed_union([a, b, s], ["k"], "v")


DESIGN_SQL = """f AS (SELECT o_custkey AS k, o_orderkey AS ord, o_orderkey%5 AS m, o_orderpriority AS p FROM orders),
    v AS (SELECT k, ord, unnest([{'field':'pile_dia','value':CASE m WHEN 1 THEN '' ELSE '1.'||m END},{'field':'pier','value':CASE m WHEN 2 THEN '{}' ELSE '{"shape":"'||p||'"}' END},{'field':'own'||m,'value':p}], recursive := true) FROM f WHERE m>0)"""


def design_files(t):
    """The orders of a customer as its design files; every fifth is damaged."""
    m = F.col("o_orderkey") % 5
    dia = F.when(m == 1, "").otherwise(F.concat(F.lit("1."), m.cast("string")))
    pier = F.when(m == 2, "{}").otherwise(F.concat(F.lit('{"shape":"'), "o_orderpriority", F.lit('"}')))
    body = F.concat(F.lit('{"pile_dia": "'), dia, F.lit('", "pier": '), pier, F.lit(', "own'), m.cast("string"), F.lit('": "'), "o_orderpriority", F.lit('"'))
    body = F.when(m == 0, F.concat(body, F.lit(": broken"))).otherwise(F.concat(body, F.lit("}")))
    name = F.concat(F.col("o_orderkey").cast("string"), F.lit(".json"))
    return t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("ord"), name.alias("name"), body.alias("body"))


@query("design_merge", f"WITH {DESIGN_SQL} SELECT k, field, arg_max(value, ord) AS value FROM v WHERE value NOT IN ('', '{{}}') GROUP BY 1,2")
def design_merge(t):
    return C.merge_design_files(design_files(t), ["k"])[0]


@query("design_errors", f"WITH {DESIGN_SQL} SELECT k, ord, ord||'.json: not readable' AS message FROM f WHERE m=0")
def design_errors(t):
    return C.merge_design_files(design_files(t), ["k"])[1].select("k", "ord", "message")


@query(
    "header_carry",
    """SELECT * FROM (SELECT event_id, user_id, last_value(CASE WHEN event_type='signup' THEN value END IGNORE NULLS)
    OVER (PARTITION BY user_id ORDER BY ts, event_id) AS header FROM events) WHERE header IS NOT NULL""",
)
def header_carry(t):
    rows = t.events.select("event_id", "user_id", "ts", "event_type", "value")
    out = C.running_header(rows, ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "signup", F.col("value")), "header")
    return out.select("event_id", "user_id", "header")


@query(
    "saved_issues",
    """SELECT event_id, coalesce(user_id::VARCHAR, '') AS title, CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN NULL ELSE 'error' END AS severity,
    CAST(CASE WHEN event_type='click' THEN value ELSE 5 END AS DOUBLE) AS x, 'General' AS category, 1 AS page_num, 'open' AS status, CAST(10 AS DOUBLE) AS height FROM events""",
)
def saved_issues(t):
    kind = F.col("event_type")
    given = F.map_concat(
        F.create_map(F.lit("title"), F.col("user_id").cast("string")),
        F.when(kind == "view", F.create_map(F.lit("severity"), F.lit(None).cast("string"))).otherwise(F.create_map().cast("map<string,string>")),
        F.when(kind == "click", F.create_map(F.lit("x"), F.col("value").cast("string"))).otherwise(F.create_map().cast("map<string,string>")),
    )
    out = I.saved_issues(t.events.withColumn("given", given), "event_id", "given")
    return out.select("event_id", "title", "severity", "x", "category", "page_num", "status", "height")


@query(
    "degraded_issues",
    """WITH s AS (SELECT o_orderkey AS id, o_custkey%5<>0 AS hd, o_custkey%3<>0 AS hs, o_custkey%2=0 AS ht, o_custkey%7<3 AS pdf FROM orders),
    i AS (SELECT l_orderkey AS id, CASE l_returnflag WHEN 'R' THEN 'Reinforcement' WHEN 'A' THEN 'Notes' ELSE 'Levels (TABLE-1)' END AS category FROM lineitem)
    SELECT id, category, count(*) AS n FROM (
      SELECT i.* FROM i JOIN s USING (id) WHERE hd AND (hs OR ht) AND (hs OR NOT pdf OR category='Notes')
      UNION ALL SELECT id, 'Configuration' FROM s WHERE NOT hs
      UNION ALL SELECT id, 'Input' FROM s WHERE NOT hd
      UNION ALL SELECT id, 'Extraction' FROM s WHERE hd AND NOT hs AND NOT ht) GROUP BY ALL""",
)
def degraded_issues(t):
    c = F.col("o_custkey")
    status = t.orders.select(
        F.col("o_orderkey").alias("id"), (c % 5 != 0).alias("has_design"), (c % 3 != 0).alias("has_schedule"),
        (c % 2 == 0).alias("has_title"), (c % 7 < 3).alias("from_pdf"),
    )
    cat = F.when(F.col("l_returnflag") == "R", "Reinforcement").when(F.col("l_returnflag") == "A", "Notes").otherwise("Levels (TABLE-1)")
    issues = t.lineitem.select(F.col("l_orderkey").alias("id"), cat.alias("category"))
    return I.degraded(issues, status, "id").groupBy("id", "category").agg(F.count(F.lit(1)).alias("n"))
