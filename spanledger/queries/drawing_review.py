"""The review of drawings: every check on the given tables, as one table of issues, saved and saved again."""

import uuid

from pyspark.sql import functions as F

from spanledger.operators import labels as L
from spanledger.operators import reconcile as C
from spanledger.operators import review as V
from spanledger.queries import reconcile as B
from spanledger.queries.findings import spacing_issues
from spanledger.queries.reconcile import BAR_SQL
from spanledger.plans.durable import AS_DEALT, by_key, set_aside
from spanledger.plans.scan import hot_keys
from spanledger.queries.registry import Tables, query
from spanledger.session import checkpoint_root, held_settings

c = F.col

#: Line items of a part when they are dealt by drawing.
PART_ROWS = 200_000

VIEWS = list(L.REQUIRED_SECTIONS)
NOTES = ["PILE LENGTH = 20 M", "FIXITY LENGTH", "PILE DIA 1200", "GRADE M40", "FE500 STEEL", ""]

# What each check finds on a drawing, as drawing_id, code, category and title. The reduced sides of the checks on
# bars are in BAR_SQL; all others derive from orders and line items.
REVIEW_SQL = f"""{BAR_SQL},
    dr AS (SELECT o_orderkey AS id, o_custkey AS k, o_orderpriority AS p, o_orderstatus AS s,
      CASE o_orderstatus WHEN 'F' THEN ['pile'] WHEN 'P' THEN ['pier','pilecap'] END AS scope FROM orders),
    bad AS (SELECT id FROM dr WHERE id%97=0),
    dm AS (SELECT DISTINCT drawing_id, component, bar_mark FROM d), wc AS (SELECT DISTINCT drawing_id, component FROM w), wm AS (SELECT DISTINCT drawing_id, component, bar_mark FROM w),
    tt AS (SELECT drawing_id, component, bar_mark, sum(cnt) AS total FROM w GROUP BY 1,2,3 HAVING sum(cnt)<>0),
    xb AS (SELECT b.drawing_id, b.component, b.bar_mark, b.p%40 AS n, CAST(round_even(total/(CASE WHEN b.component='pile' THEN greatest(coalesce(o_custkey%3,1),1) ELSE 1 END*CASE WHEN b.s%2=0 THEN 2 ELSE 1 END),0) AS BIGINT) AS e
      FROM b JOIN tt USING (drawing_id, component, bar_mark) LEFT JOIN orders ON o_orderkey=drawing_id),
    mk AS (SELECT l_orderkey, CASE WHEN l_suppkey%3=0 THEN chr(CAST(97+l_partkey%2 AS INTEGER)) ELSE chr(CAST(97+l_partkey%2 AS INTEGER))||(l_suppkey%3) END AS mark, l_linenumber*100000+l_partkey AS ord FROM lineitem),
    bs AS (SELECT l_orderkey, mark AS base, min(ord) AS base_ord FROM mk WHERE length(mark)=1 GROUP BY 1,2),
    tf AS (SELECT id, unnest([{{'field':'drawing_number','v':id::VARCHAR}},{{'field':'revision','v':CASE WHEN k%2=0 THEN 'R'||k ELSE 'REV'||k END}},{{'field':'title','v':CASE WHEN k%3=0 THEN '' ELSE 'x' END}},
      {{'field':'drawn_by','v':NULL}},{{'field':'approved_by','v':NULL}},{{'field':'date','v':'x'}},{{'field':'scale','v':CASE WHEN k%5=0 THEN NULL ELSE '1:50' END}}], recursive:=true) FROM dr),
    nt AS (SELECT id, CASE k%3 WHEN 0 THEN 'M35' WHEN 1 THEN 'm40' END AS lap, CASE WHEN k%4<>0 THEN 'M40' END AS pile, 20.0::DOUBLE+k%2 AS pl, (k%5)::DOUBLE AS pf FROM dr),
    vw AS (SELECT unnest([{{'n':0,'v':'{VIEWS[0]}','c':['pile']}},{{'n':1,'v':'{VIEWS[1]}','c':['pile']}},{{'n':2,'v':'{VIEWS[2]}','c':['pilecap','pier']}},{{'n':3,'v':'{VIEWS[3]}','c':['pilecap','pier']}},
      {{'n':4,'v':'{VIEWS[4]}','c':['pilecap']}},{{'n':5,'v':'{VIEWS[5]}','c':['pilecap']}},{{'n':6,'v':'{VIEWS[6]}','c':[]}},{{'n':7,'v':'{VIEWS[7]}','c':[]}},{{'n':8,'v':'{VIEWS[8]}','c':[]}}], recursive:=true)),
    shown AS (SELECT DISTINCT l_orderkey AS id, l_partkey%9 AS n FROM lineitem UNION SELECT DISTINCT l_orderkey, 4 FROM lineitem WHERE l_partkey%9=5),
    na AS (SELECT id, list(DISTINCT l_suppkey%6) AS h FROM dr LEFT JOIN lineitem ON l_orderkey=id GROUP BY 1),
    cm AS (SELECT l_orderkey AS id, chr(CAST(65+l_partkey%7 AS INTEGER)) AS mark, CASE WHEN any_value(l_orderkey)%4=0 THEN 'see notes' ELSE 'plan' END AS seen FROM lineitem GROUP BY 1,2
      HAVING count(*)>=2 AND NOT (count(*)>=3 AND max(l_quantity)-min(l_quantity)<=5)),
    tl AS (SELECT DISTINCT l_orderkey AS id, chr(CAST(65+l_suppkey%7 AS INTEGER)) AS mark FROM lineitem WHERE l_linenumber%2=0),
    zm AS (SELECT DISTINCT l_orderkey AS id, chr(CAST(65+l_suppkey%3 AS INTEGER))||l_linenumber AS mark, l_partkey%5=0 AS titled FROM lineitem WHERE l_partkey%5<2),
    co AS (SELECT DISTINCT l_orderkey AS id, chr(96+l_linenumber) AS m FROM lineitem WHERE l_returnflag='R'),
    gr AS (SELECT l_orderkey AS id, CASE l_linenumber WHEN 1 THEN 'pilecap_depth' WHEN 2 THEN 'pile_spacing' WHEN 3 THEN 'pile_overhang' WHEN 4 THEN 'pile_dia' WHEN 5 THEN 'pier_plan_dim' ELSE 'pilecap_width' END AS param,
        l_quantity*100 AS v, l_linenumber*1000000+l_suppkey*10000+l_partkey AS ord FROM lineitem),
    gd AS (SELECT id, unnest([{{'k':'pilecap_depth','v':1.5}},{{'k':'pile_spacing','v':3.0}},{{'k':'pile_overhang','v':0.5}},{{'k':'pile_dia','v':1.0+k%3}},{{'k':'pilecap_length_across','v':2.5}}], recursive:=true) FROM (SELECT id, k FROM dr)),
    gp AS (SELECT id, arg_min(v, ord) AS v FROM gr WHERE param='pier_plan_dim' GROUP BY 1),
    gc AS (SELECT id, CASE k WHEN 'pilecap_length_across' THEN 'pilecap_width' ELSE k END AS param, gd.v*1000 AS d, CASE k WHEN 'pile_overhang' THEN 5.0 ELSE 2.0 END AS tol,
        CASE k WHEN 'pilecap_depth' THEN 'Pilecap depth' WHEN 'pile_spacing' THEN 'Pile c/c spacing' WHEN 'pile_overhang' THEN 'Pile overhang' WHEN 'pile_dia' THEN 'Pile diameter' ELSE 'Pilecap width (across)' END AS label FROM gd
       UNION ALL SELECT id, 'pier_plan_dim', CASE WHEN abs(v-2000)<=abs(v-4000) THEN 2000 ELSE 4000 END, 5.0, 'Pier plan dimension' FROM gp WHERE id IN (SELECT id FROM dr)),
    gn AS (SELECT id, param, count(*) AS n FROM gr GROUP BY 1,2),
    so AS (SELECT id, s, k%4 AS n, k%3<>0 AS even FROM dr WHERE k%5<>0),
    found(drawing_id, code, category, title) AS (
      SELECT id, CASE k%13 WHEN 0 THEN 'notes_grade' ELSE 'diagnostic' END, CASE k%13 WHEN 0 THEN 'Notes' ELSE 'Extraction' END, CASE k%13 WHEN 0 THEN 'Grade of section A-A differs: '||p ELSE substr('Layout '||p||repeat(' unread', 20), 1, 120) END FROM dr WHERE k%13<2
      UNION ALL SELECT id, 'title_field', 'Title Block', 'Missing field: '||field FROM tf WHERE coalesce(v,'')=''
      UNION ALL SELECT id, 'title_revision', 'Title Block', 'Revision format invalid: "'||v||'"' FROM tf WHERE field='revision' AND NOT regexp_full_match(v,'R\\d+')
      UNION ALL SELECT id, 'lap_grade', 'Notes', 'Lap length table references '||lap||' but pile concrete is '||pile FROM nt WHERE upper(lap)<>upper(pile)
      UNION ALL SELECT id, 'lap_grade_missing', 'Notes', 'Lap length concrete grade not found' FROM nt WHERE lap IS NULL
      UNION ALL SELECT id, 'pile_length', 'Notes', 'Pile length mismatch: note says '||pl||'m, design says 20.0m' FROM nt WHERE abs(20-pl)/20*100>1
      UNION ALL SELECT id, 'pile_fixity', 'Notes', 'Pile fixity mismatch: note says '||pf||'m, design says 3.0m' FROM nt WHERE pf<>0 AND abs(3-pf)/3*100>1
      UNION ALL SELECT drawing_id, 'component_missing', 'Reinforcement', upper(component[1])||component[2:]||' schedule not found in drawing' FROM (SELECT DISTINCT drawing_id, component FROM dm) LEFT JOIN dr ON id=drawing_id
        WHERE (drawing_id, component) NOT IN (SELECT (drawing_id, component) FROM wc) AND (scope IS NULL OR list_contains(scope, component))
      UNION ALL SELECT drawing_id, 'mark_missing', 'Reinforcement', 'Bar mark '''||bar_mark||''' ('||component||') not found in drawing schedule' FROM dm
        WHERE (drawing_id, component) IN (SELECT (drawing_id, component) FROM wc) AND (drawing_id, component, bar_mark) NOT IN (SELECT (drawing_id, component, bar_mark) FROM wm)
      UNION ALL SELECT drawing_id, code, CASE code WHEN 'bar_dia' THEN 'Bar Diameter' WHEN 'bar_spacing' THEN 'Bar Spacing' WHEN 'bar_spacing_missing' THEN 'Bar Spacing' WHEN 'bar_length' THEN 'Bar Length'
        WHEN 'bar_unit_weight' THEN 'Bar Unit Weight' ELSE 'Reinforcement' END, title FROM sc
      UNION ALL SELECT drawing_id, 'bar_shape', 'Bar Shape', title FROM sh
      UNION ALL SELECT drawing_id, code, CASE code WHEN 'bar_count' THEN 'Bar Count' WHEN 'bar_weight' THEN 'Bar Weight' ELSE 'Bar Total Length' END, title FROM tot
      UNION ALL SELECT drawing_id, 'zone_rows', 'Reinforcement', title FROM zr
      UNION ALL SELECT mk.l_orderkey, 'companion_order', 'Reinforcement', 'Bar mark '''||mk.mark||''' listed before '''||base||''' in pile schedule' FROM mk JOIN bs ON bs.l_orderkey=mk.l_orderkey AND base=mk.mark[1] WHERE length(mk.mark)=2 AND base_ord>mk.ord
      UNION ALL SELECT dr.id, 'view_missing', 'Missing Views', 'Missing view: '||v FROM dr, vw WHERE (dr.id, vw.n) NOT IN (SELECT (shown.id, shown.n) FROM shown) AND (scope IS NULL OR len(c)=0 OR list_has_any(c, scope))
      UNION ALL SELECT id, 'note_missing', 'Notes', unnest(['Concrete grade for pile not specified in notes', 'Concrete grade for pilecap not specified in notes', 'Concrete grade for pier not specified in notes']) FROM na WHERE NOT list_contains(h, 3)
      UNION ALL SELECT id, 'note_missing', 'Notes', 'Steel grade (Fe415/Fe500/Fe550) not specified in notes' FROM na WHERE NOT list_contains(h, 4)
      UNION ALL SELECT id, 'pile_info_missing', 'Notes', 'Pile related info missing: '||concat_ws(', ', CASE WHEN NOT list_contains(h,2) THEN 'diameter' END, CASE WHEN NOT list_contains(h,0) THEN 'length' END, CASE WHEN NOT list_contains(h,1) THEN 'fixity length' END)
        FROM na WHERE NOT (list_contains(h,0) AND list_contains(h,1) AND list_contains(h,2))
      UNION ALL SELECT id, 'label_error', 'Label Errors', 'Label '||p FROM dr WHERE k%17=0
      UNION ALL SELECT id, 'dimension_error', 'Dimension Errors', 'Dimension missing near '||p FROM dr WHERE k%19=0
      UNION ALL SELECT id, 'stray_box', 'Drawing Quality', 'Stray box / erroneous outline' FROM dr WHERE k%29=0
      UNION ALL SELECT id, 'section_spacing', 'Section Spacing', 'Section '||s||': bar ''a'' — uneven' FROM so WHERE NOT even AND n=0
      UNION ALL SELECT id, 'section_spacing', 'Section Spacing', 'Section '||s||': bar ''a'' — '||['bar clustering','gap between bars','possible missing bar'][j+1]||CASE WHEN j=1 THEN ' at 3 o''clock' ELSE '' END FROM (SELECT *, unnest(range(n)) AS j FROM so WHERE n>0)
      UNION ALL SELECT drawing_id, 'section_count', 'Section Bar Count', 'Section A: bar '''||bar_mark||''' count — drawn '||n||', expected '||e FROM xb WHERE n<>e
      UNION ALL SELECT id, 'section_missing', 'Missing Views', 'Missing section view: SECTION '||mark||'-'||mark FROM cm WHERE (id, mark) NOT IN (SELECT (id, mark) FROM tl) AND seen='plan'
      UNION ALL SELECT DISTINCT id, 'arrow_missing', 'Missing Views', 'Missing cut-mark arrow: '||mark FROM zm WHERE titled AND (id, mark) NOT IN (SELECT (id, mark) FROM zm WHERE NOT titled)
      UNION ALL SELECT id, 'view_unlabeled', 'Missing Views', 'Unlabeled view: Outline in the '||lower(p)||' part' FROM dr WHERE k%31=0
      UNION ALL SELECT r.id, 'geometry', 'Geometric Dimensions', label||': drawn '||CAST(round_even(r.v,0) AS BIGINT)||'mm ≠ design '||CAST(round_even(d,0) AS BIGINT)||'mm'||CASE WHEN n>1 THEN ' (view near x=10%)' ELSE '' END
        FROM gr r JOIN gc USING (id, param) JOIN gn USING (id, param) WHERE abs(r.v-d)/d*100>tol
      UNION ALL SELECT id, 'geometry_missing', 'Geometric Dimensions', 'Pilecap depth: not found in drawing' FROM dr WHERE id IN (SELECT id FROM gr) AND id NOT IN (SELECT id FROM gr WHERE param='pilecap_depth')
      UNION ALL SELECT id, 'geometry_spread', 'Geometric Dimensions', label||': inconsistent between drawing views' FROM gr JOIN gc USING (id, param) GROUP BY id, param, tol, label HAVING count(*)>1 AND (max(gr.v)-min(gr.v))/max(gr.v)*100>tol
      UNION ALL SELECT l_orderkey, 'callout_merged', 'Bar Mark Callouts', 'Merged bar-mark callout '''||m||'/'||m||'1'' — should be two separate leaders' FROM (SELECT l_orderkey, chr(96+l_linenumber) AS m FROM lineitem WHERE l_returnflag='A' AND l_suppkey%5=0)
      UNION ALL SELECT l_orderkey, 'callout_missing', 'Bar Mark Callouts', 'Bar mark '''||m||''' not called out in section view' FROM (SELECT DISTINCT l_orderkey, chr(96+l_linenumber) AS m FROM lineitem WHERE l_partkey%11<>0)
        WHERE l_orderkey IN (SELECT id FROM co) AND (l_orderkey, m) NOT IN (SELECT (id, m) FROM co)
      UNION ALL SELECT id, 'design_unreadable', 'Input', 'Design input could not be parsed' FROM dr WHERE k%37=0),
    st AS (SELECT id, k%41<>0 AS hd, k%11<>0 AS hs, k%22<>0 AS ht, k%7=3 AS pdf FROM dr WHERE id NOT IN (FROM bad)),
    r AS (SELECT DISTINCT drawing_id, code, category, title FROM found JOIN st ON id=drawing_id WHERE hd AND (hs OR ht) AND (hs OR NOT pdf OR category NOT IN ('Reinforcement','Levels (TABLE-1)'))
      UNION ALL SELECT id, 'no_schedule', 'Configuration', 'DXF extraction returned no schedule data' FROM st WHERE NOT hs AND NOT pdf
      UNION ALL SELECT id, 'no_vision', 'Configuration', 'AI vision extraction failed' FROM st WHERE NOT hs AND pdf
      UNION ALL SELECT id, 'no_design', 'Input', 'No design input provided' FROM st WHERE NOT hd
      UNION ALL SELECT id, 'no_drawing', 'Extraction', 'Drawing data extraction failed' FROM st WHERE hd AND NOT hs AND NOT ht
      UNION ALL SELECT id, 'system', 'System', 'Processing failed' FROM bad)"""


def _orders(t):
    return t.orders.select(c("o_orderkey").alias("drawing_id"), c("o_custkey").alias("k"), c("o_orderpriority").alias("p"), c("o_orderstatus").alias("s"))


def _lines(t):
    return t.lineitem.select(c("l_orderkey").alias("drawing_id"), "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag")


def _chosen(values, no):
    return F.get(F.array(*[F.lit(v) for v in values]), no.cast("int"))


def _letter(first, no):
    return F.char(F.lit(first) + no)


def _views(t, scope):
    """Missing views, cut marks and notes, from labels and texts that the line items of a drawing make up."""
    lines, drawings = _lines(t), _orders(t).select("drawing_id")
    labels = lines.select("drawing_id", _chosen(VIEWS, c("l_partkey") % 9).alias("label"), c("l_linenumber").alias("ord"))
    sections = L.required_sections(labels, drawings, "drawing_id", "label", "ord", L.REQUIRED_SECTIONS, "label")
    sections = sections.withColumn("no", F.array_position(F.array(*[F.lit(v) for v in VIEWS]), c("name")))
    notes = lines.select("drawing_id", _chosen(NOTES, c("l_suppkey") % 6).alias("text"))
    presence = L.required_notes(notes, drawings, "drawing_id", "text", L.NOTE_KEYWORDS)

    marks = lines.withColumn("mark", _letter(65, c("l_partkey") % 7))
    marks = L.cut_marks(marks.drop("l_partkey"), ["drawing_id"], c("mark"), "l_quantity", F.lit(5.0))
    letter = _letter(65, c("l_suppkey") % 7)
    titles = lines.filter("l_linenumber % 2 = 0").select("drawing_id", F.concat(F.lit("SECTION "), letter, F.lit("-"), letter).alias("label"))
    gone = L.missing_sections(marks, titles, ["drawing_id"], "label")
    gone = gone.withColumns({"found_on": F.when(c("drawing_id") % 4 == 0, "see notes").otherwise("plan"), "ord": F.ascii("mark")})
    zone = F.concat(_letter(65, c("l_suppkey") % 3), c("l_linenumber").cast("string"))
    zones = lines.select("drawing_id", zone.alias("zone"), (c("l_partkey") % 5).alias("kind"), "l_linenumber")
    titled = zones.filter("kind = 0").select("drawing_id", F.concat(F.lit("Section "), "zone", F.lit("-"), "zone").alias("label"), c("l_linenumber").alias("ord"))
    arrows = zones.filter("kind = 1").select("drawing_id", c("zone").alias("mark"))
    unseen = L.unreferenced_views(titled, arrows, ["drawing_id"], "label").select("drawing_id", "mark", "ord")
    return [
        V.view_issues(sections, scope, 5),
        V.note_issues(L.missing_notes(presence, "drawing_id"), 6),
        V.cut_mark_issues(gone, unseen, 10),
    ]


def _listed(t):
    """Findings that a drawing's reading lists."""
    o = _orders(t).withColumn("bbox", F.lit(None).cast("struct<x:double,y:double,w:double,h:double>")).withColumn("ord", F.lit(0))

    def said(when, text, name="description"):
        return o.filter(when).withColumn(name, text)

    message = F.when(c("k") % 13 == 0, F.concat(F.lit("Grade of section A-A differs: "), "p")).otherwise(F.concat(F.lit("Layout "), "p", F.repeat(F.lit(" unread"), 20)))
    code = F.when(c("k") % 13 == 0, "section_grade_mismatch").otherwise("layout")
    severity = F.when(c("k") % 13 < 2, "error").otherwise("info")
    return [
        V.diagnostic_issues(o.select("drawing_id", code.alias("code"), message.alias("message"), severity.alias("severity"), "ord"), 1),
        V.found_issues(said("k % 17 = 0", F.concat(F.lit("Label "), "p")), "label_error", 7),
        V.found_issues(said("k % 19 = 0", F.concat(F.lit("Dimension missing near "), "p")), "dimension_error", 8),
        V.found_issues(said("k % 29 = 0", F.concat(F.lit("Outline at "), "p")), "stray_box", 8),
        V.listed_issues(said("k % 31 = 0", F.concat(F.lit("Outline in the "), F.lower("p"), F.lit(" part")), "name"), "view_unlabeled", 12, "name"),
        V.listed_issues(said("k % 37 = 0", F.concat(F.lit("design "), "p", F.lit(".json: not readable")), "name"), "design_unreadable", 0, "name"),
    ]


def review_parts(t):
    order = _orders(t)
    scoped = F.when(c("s") == "F", "SECTION Z-Z (PILE)").when(c("s") == "P", "SECTION A-A FOR PILECAP & PIER").otherwise("PLAN OF PILECAP")
    scope = C.components_on_sheet(order.select("drawing_id", scoped.alias("name"), F.lit(True).alias("present")), "drawing_id")
    drawn, designed = B.drawing_bars(t), B.design_bars(t)
    sections = B.sheet_bars(t).select(
        *C.BAR, F.lit("A").alias("section_name"), c("zone_ord").alias("ord"), (c("l_partkey") % 40).alias("visual_count"), (c("l_suppkey") % 2 == 0).alias("is_bundle")
    )
    counted = C.section_bars(sections, drawn.withColumn("zone_ord", F.lit(1)), B.pile_counts(t))
    marks = B.companion_order(t).select(c("l_orderkey").alias("drawing_id"), "mark", "base", F.lit("pile").alias("component"), "ord")
    letter = _letter(96, c("l_linenumber"))
    raw = F.when(c("l_returnflag") == "R", letter).when((c("l_returnflag") == "A") & (c("l_suppkey") % 5 == 0), F.concat(letter, F.lit("/"), letter, F.lit("1")))
    leaders = _lines(t).select("drawing_id", raw.alias("raw"), F.lit(40.0).alias("x_pct"), F.lit(None).cast("double").alias("y_pct"), c("l_linenumber").alias("ord"))
    leaders = L.callout_marks(leaders.filter("raw IS NOT NULL"), ["drawing_id"], "raw")
    gaps = C.callout_gaps(designed, drawn, leaders.filter("kind = 'single'"))
    parts = [
        *_listed(t),
        B.title_issues(t),
        B.notes_issues(t),
        C.missing_bar_issues(designed, drawn, scope),
        B.scalar_issues(t),
        B.total_issues(t),
        C.zone_issues(drawn),
        V.companion_issues(marks, 4),
        *_views(t, scope),
        V.section_count_issues(counted, 9),
        spacing_issues(t),
        B.geometry_findings(t),
        V.callout_issues(gaps, leaders, 14),
    ]
    return parts, *review_status(t)


def review_status(t):
    """How far the extraction of each drawing came, and the drawings that failed."""
    order = _orders(t)
    status = order.select(
        "drawing_id", (c("k") % 41 != 0).alias("has_design"), (c("k") % 11 != 0).alias("has_schedule"), (c("k") % 22 != 0).alias("has_title"), (c("k") % 7 == 3).alias("from_pdf")
    )
    failures = order.filter("drawing_id % 97 = 0").select("drawing_id", F.lit("unreadable").alias("message"))
    return status, failures


def by_drawing(t):
    """The tables of the checks with the rows of a drawing side by side, so that no check shuffles them again.

    A drawing with more rows than one task should hold leaves them as they are.
    """
    if hot_keys(t.lineitem, "l_orderkey") or hot_keys(t.orders, "o_orderkey"):
        return t
    u = Tables(t.spark, t.folder)
    n = max(t.spark.sparkContext.defaultParallelism, t.lineitem.count() // PART_ROWS)
    for name, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        u.put(name, by_key(getattr(t, name), n, key))
    u.once("sheet_bars", lambda: by_key(B.numbered_bars(u), n, *C.BAR, "zone_ord"))
    return u


def found(t, *columns):
    """The issues of all drawings, of their columns those that are read."""
    with held_settings(t.spark, AS_DEALT):
        parts, _, _ = review_parts(by_drawing(t))
        return V.review_issues(parts, *review_status(t), columns=columns or V.COLUMNS)


@query("review_issues", f"WITH RECURSIVE {REVIEW_SQL} SELECT drawing_id, category, title FROM r")
def review_issues(t):
    return found(t, "category", "title").select("drawing_id", "category", "title")


@query("review_codes", f"WITH RECURSIVE {REVIEW_SQL} SELECT code, category, count(*) AS issues, count(DISTINCT drawing_id) AS drawings FROM r GROUP BY 1,2")
def review_codes(t):
    """How often each kind of finding occurs."""
    return found(t, "code", "category").groupBy("code", "category").agg(F.count(F.lit(1)).alias("issues"), F.count_distinct("drawing_id").alias("drawings"))


def _reviews(t):
    """Each drawing has one review; those of status O are pending."""
    status = F.when(c("o_orderstatus") == "O", "processing").otherwise("open")
    return t.orders.select((c("o_orderkey") * 10).alias("id"), c("o_orderkey").alias("drawing_id"), status.alias("status"))


def _counted(reviews, saved):
    counts = saved.groupBy("review_id").agg(F.count(F.lit(1)).alias("issues"), F.count_if(c("category") == "System").alias("failed"))
    return reviews.select(c("id").alias("review_id"), "status").join(counts, "review_id", "left").select(
        "review_id", "status", F.coalesce("issues", F.lit(0)).alias("issues"), F.coalesce("failed", F.lit(0)).alias("failed")
    )


@query(
    "review_pipeline",
    f"""WITH RECURSIVE {REVIEW_SQL} SELECT o_orderkey*10 AS review_id, CASE WHEN o_orderstatus='O' THEN 'complete' ELSE 'open' END AS status, CASE WHEN o_orderstatus='O' THEN count(title) ELSE 1 END AS issues,
      count(*) FILTER (WHERE category='System' AND o_orderstatus='O') AS failed FROM orders LEFT JOIN r ON drawing_id=o_orderkey GROUP BY o_orderkey, o_orderstatus""",
)
def review_pipeline(t):
    # Each review has one stored issue before; pending ones are completed.
    reviews = _reviews(t)
    done, issues = V.reviewed(reviews, found(t, "category", "title"))
    old = reviews.select(c("id").alias("review_id"), F.lit("Notes").alias("category"), F.lit("old").alias("title"))
    now = V.replaced(old, issues, reviews.filter("status = 'processing'").select(c("id").alias("review_id")))
    return _counted(done, now)


@query(
    "review_store",
    f"""WITH RECURSIVE {REVIEW_SQL} SELECT o_orderkey*10 AS review_id, CASE WHEN o_orderstatus='O' THEN 'complete' ELSE 'open' END AS status, CASE WHEN o_orderstatus='O' THEN count(title) ELSE 1 END AS issues,
      count(*) FILTER (WHERE category='System' AND o_orderstatus='O') AS failed FROM orders LEFT JOIN r ON drawing_id=o_orderkey GROUP BY o_orderkey, o_orderstatus""",
)
def review_store(t):
    """The same through the stored table: all reviews saved with an old issue, the pending ones reviewed and saved twice."""
    path = f"{checkpoint_root(t.spark)}/issues-{uuid.uuid4().hex}"
    reviews = _reviews(t)
    old = V.listed_issues(reviews.select("drawing_id", c("id").alias("review_id"), F.lit("old").alias("name"), F.lit(0).alias("ord")), "diagnostic", 0, "name")
    everything = reviews.select(c("id").alias("review_id"))
    V.save_issues(old.withColumn("review_id", c("drawing_id") * 10), everything, path, buckets=8)
    done, issues = V.reviewed(reviews, found(t))
    issues = set_aside(issues)  # saved twice
    pending = reviews.filter("status = 'processing'").select(c("id").alias("review_id"))
    for _ in range(2):
        V.save_issues(issues, pending, path, buckets=8)
    return _counted(done, V.saved_review_issues(t.spark, path))
