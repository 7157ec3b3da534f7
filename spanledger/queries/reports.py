"""Report forms, their checks, dictated notes and costs on the given tables."""

from pyspark.sql import functions as F

from spanledger.functions import text as T
from spanledger.operators import costs
from spanledger.operators import forms as R
from spanledger.plans.containment import contained
from spanledger.queries.registry import query
from spanledger.session import spread

c = F.col


@query(
    "traceable",
    "SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE length(b.text)>=3",
)
def traceable(t):
    return contained(
        t.benchmark.withColumn("k", F.lit(1)), spread(t.documents, "doc_id").withColumn("k", F.lit(1)), ["k"], "item_id", "text", "doc_id", "text"
    ).select("item_id", "doc_id")


CELLS_SQL = """cells AS (SELECT o_custkey AS k, 'S' AS sheet, 'C'||o_orderkey AS cell, CASE o_orderkey%6 WHEN 0 THEN o_orderpriority WHEN 1 THEN 'x'||c_mktsegment||'y' WHEN 2 THEN substr(c_name,3,9) WHEN 3 THEN 'C' WHEN 4 THEN ' - ' ELSE 'Z9'||o_orderkey END AS value FROM orders JOIN customer ON c_custkey=o_custkey),
vals AS (SELECT c_custkey AS k, unnest([c_name, c_mktsegment, 'N'||c_nationkey]) AS v FROM customer UNION ALL SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus='F')"""


def cells_and_values(t):
    m = c("o_orderkey") % 6
    value = (
        F.when(m == 0, c("o_orderpriority")).when(m == 1, F.concat(F.lit("x"), "c_mktsegment", F.lit("y")))
        .when(m == 2, F.substring("c_name", 3, 9)).when(m == 3, "C").when(m == 4, " - ")
        .otherwise(F.concat(F.lit("Z9"), c("o_orderkey").cast("string")))
    )
    cells = t.orders.join(t.customer, c("o_custkey") == c("c_custkey")).select(
        c("o_custkey").alias("k"), F.lit("S").alias("sheet"), F.concat(F.lit("C"), c("o_orderkey").cast("string")).alias("cell"), value.alias("value")
    )
    vals = t.customer.select(c("c_custkey").alias("k"), F.explode(F.array("c_name", "c_mktsegment", F.concat(F.lit("N"), c("c_nationkey").cast("string")))).alias("value"))
    return cells, vals.unionByName(t.orders.filter("o_orderstatus = 'F'").select(c("o_custkey").alias("k"), c("o_orderpriority").alias("value")))


@query(
    "untraceable_cells",
    f"""WITH {CELLS_SQL}, u AS (SELECT k, cell, trim(value) AS tx FROM cells WHERE trim(value) NOT IN ('','-','None'))
    SELECT k, cell, tx AS found FROM u WHERE NOT EXISTS (SELECT 1 FROM vals WHERE vals.k=u.k AND (v=tx OR (length(v)>=3 AND (contains(v,tx) OR contains(tx,v)))))""",
)
def untraceable_cells(t):
    cells, vals = cells_and_values(t)
    return R.untraceable(cells, vals, "k").select("k", "cell", "found")


RECORD_SQL = """rec AS (SELECT c_custkey AS k, CASE WHEN c_nationkey%2=0 THEN 'excel_rb' ELSE 'excel_amc' END AS fmt, unnest([{'f':'bridge_title','v':CASE WHEN c_nationkey%3=0 THEN '-' ELSE c_name END},{'f':'river_name','v':c_mktsegment},
  {'f':'latitude','v':c_acctbal::VARCHAR},{'f':'longitude','v':CASE WHEN c_nationkey%4=0 THEN '' ELSE c_nationkey::VARCHAR END},{'f':'division','v':'D'||(c_nationkey%5)},{'f':'circle','v':'D'||(c_nationkey%3)},
  {'f':'no_of_spans','v':c_nationkey||' Nos.'},{'f':'date_of_survey','v':'2024-05-'||(10+c_nationkey%9)},{'f':'performance','v':CASE c_nationkey%4 WHEN 0 THEN 'Not Visible' WHEN 1 THEN 'Good' END},{'f':'overall_condition_visual','v':'Fair'}], recursive:=true) FROM customer),
e0 AS (SELECT k, any_value(fmt) AS fmt, max(v) FILTER (WHERE f='bridge_title' AND v<>'-') AS bt, max(v) FILTER (WHERE f='river_name') AS rn, max(v) FILTER (WHERE f='latitude') AS la, max(v) FILTER (WHERE f='longitude' AND v<>'') AS lo,
  max(v) FILTER (WHERE f='division') AS dv, max(v) FILTER (WHERE f='circle') AS ci, max(v) FILTER (WHERE f='no_of_spans') AS sp, max(v) FILTER (WHERE f='date_of_survey') AS ds, max(v) FILTER (WHERE f='performance') AS pf FROM rec GROUP BY 1),
exp AS (SELECT k, fmt, 'Appendix-A' AS sheet, 'C4' AS cell, coalesce(bt,rn) AS expected FROM e0 UNION ALL SELECT k, fmt, 'Appendix-A','C6',rn FROM e0 UNION ALL SELECT k, fmt, 'Appendix-A','C9',la||'° , '||lo||'°' FROM e0 UNION ALL SELECT k, fmt, 'Appendix-A','C11',dv FROM e0 UNION ALL SELECT k, fmt, 'Appendix-A','C12',ci FROM e0
  UNION ALL SELECT k, fmt, 'Appendix-A','C15','Number of Span: '||sp FROM e0 UNION ALL SELECT k, fmt, 'Appendix-A','C92',pf FROM e0 UNION ALL SELECT k, fmt, 'Appendix-A','C93',strftime(CAST(ds AS DATE),'%d/%m/%Y') FROM e0
  UNION ALL SELECT k, fmt, 'Appendix-B','C4',coalesce(bt,rn) FROM e0 UNION ALL SELECT k, fmt, 'Appendix-B','C6',rn FROM e0 UNION ALL SELECT k, fmt, 'Appendix-B','C9',la||'° , '||lo||'°' FROM e0 UNION ALL SELECT k, fmt, 'Appendix-B','C10',CASE WHEN dv<>ci THEN dv||' / '||ci ELSE dv END FROM e0
  UNION ALL SELECT k, fmt, 'Appendix-B','C12',strftime(CAST(ds AS DATE),'%d/%m/%Y') FROM e0 UNION ALL SELECT k, fmt, 'Appendix-B', CASE WHEN fmt='excel_rb' THEN 'C128' ELSE 'C127' END,'Fair' FROM e0)"""


def record(t):
    n = c("c_nationkey")
    s = n.cast("string")
    fields = {
        "bridge_title": F.when(n % 3 == 0, "-").otherwise(c("c_name")), "river_name": c("c_mktsegment"), "latitude": c("c_acctbal").cast("string"),
        "longitude": F.when(n % 4 == 0, "").otherwise(s), "division": F.concat(F.lit("D"), (n % 5).cast("string")), "circle": F.concat(F.lit("D"), (n % 3).cast("string")),
        "no_of_spans": F.concat(s, F.lit(" Nos.")), "date_of_survey": F.concat(F.lit("2024-05-"), (10 + n % 9).cast("string")),
        "performance": F.when(n % 4 == 0, "Not Visible").when(n % 4 == 1, "Good"), "overall_condition_visual": F.lit("Fair"),
    }
    wide = t.customer.select(c("c_custkey").alias("k"), *[v.alias(f) for f, v in fields.items()])
    forms = t.customer.select(c("c_custkey").alias("k"), F.when(n % 2 == 0, "excel_rb").otherwise("excel_amc").alias("fmt"))
    return R.record_to_long(wide, ["k"]), forms


def expected(t):
    def make():
        long, forms = record(t)
        return R.form_expected(long, forms, "k", R.form_map(t.spark))

    return t.once("expected", make)


@query("form_expected", f"WITH {RECORD_SQL} SELECT k, sheet, cell, expected FROM exp WHERE expected IS NOT NULL")
def form_expected(t):
    return expected(t).select("k", "sheet", "cell", "expected")


ACTUAL_SQL = """act AS (SELECT k, sheet, cell, CASE WHEN k%5=0 AND cell='C6' THEN ' - ' WHEN k%7=0 AND cell='C92' THEN 'Visible' ELSE expected END AS value FROM exp WHERE expected IS NOT NULL AND NOT (k%11=0 AND cell IN ('C12','C92')))"""


def actual(t):
    k, cell = c("k"), c("cell")
    value = F.when((k % 5 == 0) & (cell == "C6"), " - ").when((k % 7 == 0) & (cell == "C92"), "Visible").otherwise(c("expected"))
    return expected(t).filter(~((k % 11 == 0) & cell.isin("C12", "C92"))).select("k", "sheet", "cell", value.alias("value"))


CHECK_SQL = f"""{RECORD_SQL}, {ACTUAL_SQL},
iss AS (SELECT e.k, 1 AS rule, e.sheet, e.cell, '(empty)' AS found, e.expected FROM exp e LEFT JOIN act a ON a.k=e.k AND a.sheet=e.sheet AND a.cell=e.cell WHERE e.expected IS NOT NULL AND (a.value IS NULL OR trim(a.value) IN ('','-'))
 UNION ALL SELECT e.k, 4, e.sheet, e.cell, coalesce(a.value,'(empty)'), e.expected FROM exp e LEFT JOIN act a ON a.k=e.k AND a.sheet=e.sheet AND a.cell=e.cell WHERE e.expected='Not Visible' AND a.value IS DISTINCT FROM 'Not Visible')"""


@query("lost_inputs", f"WITH {CHECK_SQL} SELECT k, rule, sheet, cell, found, expected FROM iss")
def lost_inputs(t):
    e, a = expected(t), actual(t)
    return R.lost_inputs(e, a, "k").unionByName(R.special_values_kept(e, a, "k")).select("k", "rule", "sheet", "cell", "found", "expected")


@query(
    "corrected_cells",
    f"""WITH {CHECK_SQL}, f AS (SELECT k, sheet, cell, arg_max(expected, rule) AS v FROM iss GROUP BY 1,2,3)
    SELECT coalesce(a.k,f.k) AS k, coalesce(a.sheet,f.sheet) AS sheet, coalesce(a.cell,f.cell) AS cell, coalesce(f.v, a.value) AS value FROM act a FULL JOIN f ON a.k=f.k AND a.sheet=f.sheet AND a.cell=f.cell""",
)
def corrected_cells(t):
    e, a = expected(t), actual(t)
    issues = R.lost_inputs(e, a, "k").unionByName(R.special_values_kept(e, a, "k"))
    return R.corrected_cells(a, issues, "k")


@query(
    "value_set",
    f"""WITH {RECORD_SQL}, x AS (SELECT k, trim(v) AS value FROM rec UNION SELECT k, la||'° , '||lo||'°' FROM e0 UNION SELECT k, dv||' / '||ci FROM e0 WHERE dv<>ci UNION SELECT k, 'Number of Span: '||sp FROM e0 UNION SELECT k, strftime(CAST(ds AS DATE),'%d/%m/%Y') FROM e0)
    SELECT DISTINCT k, value FROM x WHERE value NOT IN ('','-')""",
)
def value_set(t):
    return R.value_set(record(t)[0], "k")


@query(
    "record_long",
    """SELECT c_custkey, 'c_name' AS field, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'c_mktsegment', c_mktsegment FROM customer UNION ALL SELECT c_custkey, 'c_nationkey', c_nationkey::VARCHAR FROM customer""",
)
def record_long(t):
    return R.record_to_long(t.customer, ["c_custkey"], ["c_name", "c_mktsegment", "c_nationkey"])


@query(
    "raw_label_gaps",
    """WITH r AS (SELECT c_custkey AS k, CASE c_nationkey%5 WHEN 0 THEN 'Pier cap is wide next Design Agency absent' WHEN 1 THEN 'maximum scour level 12.5 metre and then x' WHEN 2 THEN 'Date of Completion n/a, fine' WHEN 3 THEN 'width of abutment cap 3 m'||chr(10)||'more' ELSE c_name END AS t FROM customer),
    x AS (SELECT k, 'C55' AS cell, 'is wide' AS expected, false AS fix FROM r WHERE t LIKE 'Pier cap%' UNION ALL SELECT k, 'C90', 'Absent', true FROM r WHERE t LIKE 'Pier cap%' UNION ALL SELECT k, 'C48', '12.5 m', true FROM r WHERE t LIKE 'maximum%' AND k%3<>0
      UNION ALL SELECT k, 'C81', 'Not Applicable', true FROM r WHERE t LIKE 'Date%' UNION ALL SELECT k, 'C57', '3 m', true FROM r WHERE t LIKE 'width%' UNION ALL SELECT k, 'C56', 'cap 3 m', false FROM r WHERE t LIKE 'width%')
    SELECT k, cell, expected, fix AS auto_fixable FROM x""",
)
def raw_label_gaps(t):
    m = c("c_nationkey") % 5
    text = (
        F.when(m == 0, "Pier cap is wide next Design Agency absent").when(m == 1, "maximum scour level 12.5 metre and then x")
        .when(m == 2, "Date of Completion n/a, fine").when(m == 3, "width of abutment cap 3 m\nmore").otherwise(c("c_name"))
    )
    raw = t.customer.select(c("c_custkey").alias("k"), text.alias("raw"))
    filled = raw.filter("k % 3 = 0").select("k", F.lit("design_scour_level").alias("field"))
    return R.raw_label_gaps(raw, "k", "raw", filled).select("k", "cell", "expected", "auto_fixable")


@query(
    "word_losses",
    """WITH v AS (SELECT doc_id AS k, unnest([{'f':'river_name','v':substr(text,5,30)},{'f':'road_name','v':'Not Visible'},{'f':'other','v':'Absent'},{'f':'circle','v':'-'},{'f':'performance','v':source||' x'}], recursive:=true) FROM documents),
    j AS (SELECT v.k, f, regexp_replace(v,'^\\s+|\\s+$','','g') AS v, text FROM v JOIN documents ON doc_id=v.k WHERE v<>'-')
    SELECT k, 1 AS rule, f AS field, v AS expected FROM j WHERE f<>'other' AND v<>'' AND NOT contains(text,v) UNION ALL SELECT k, 4, f, v FROM j WHERE v IN ('Not Visible','Absent') AND NOT contains(text,v)""".replace("\\\\", "\\"),
)
def word_losses(t):
    fields = {"river_name": F.substring("text", 5, 30), "road_name": F.lit("Not Visible"), "other": F.lit("Absent"), "circle": F.lit("-"), "performance": F.concat("source", F.lit(" x"))}
    docs = t.documents.withColumnRenamed("doc_id", "k")
    long = docs.select("k", F.inline(F.array(*[F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in fields.items()])))
    return R.word_losses(long, docs, "k", "text")


@query(
    "figure_numbers",
    """SELECT event_id, user_id, CASE WHEN event_type='purchase' THEN n END AS figure_no, CASE WHEN event_type='purchase' THEN '(Photo No.-'||n||')' END AS reference
    FROM (SELECT *, count(*) FILTER (WHERE event_type='purchase') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)""",
)
def figure_numbers(t):
    photos = t.events.select("event_id", "user_id", "ts", F.when(c("event_type") == "purchase", "Damaged").otherwise("general").alias("category"))
    return R.figure_numbers(photos, "user_id", ["ts", "event_id"], "category").select("event_id", "user_id", "figure_no", "reference")


@query(
    "photo_index",
    """SELECT event_id, CASE event_type WHEN 'view' THEN 'general' ELSE 'damaged' END AS "group", row_number() OVER (PARTITION BY user_id, event_type='view' ORDER BY ts, event_id)||'. '||event_type AS caption FROM events WHERE event_type IN ('view','error')""",
)
def photo_index(t):
    group = F.when(c("event_type") == "view", "general").when(c("event_type") == "error", "damaged")
    return R.photo_index(t.events, "user_id", ["ts", "event_id"], group, "event_type").select("event_id", "group", "caption")


@query(
    "zip_photos",
    """WITH v AS (SELECT vec_id, [x::VARCHAR FOR x IN embedding[1:6]] AS p FROM embeddings)
    SELECT vec_id, i+1 AS ord, CASE WHEN i<3 THEN 'T'||i ELSE '' END AS title, CASE WHEN i<vec_id%5 THEN 'general' ELSE 'damage' END AS category FROM (SELECT vec_id, unnest(range(0,6)) AS i FROM v) WHERE i<>vec_id%6""",
)
def zip_photos(t):
    idx = F.sequence(F.lit(0), F.lit(5))
    rec = t.embeddings.select(
        "vec_id",
        F.transform(idx, lambda i: F.when(i == c("vec_id") % 6, "").otherwise(F.concat(F.lit("p"), i.cast("string")))).alias("photos"),
        F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.concat(F.lit("T"), i.cast("string"))).alias("photo_titles"),
        F.array_repeat(F.lit("general"), (c("vec_id") % 5).cast("int")).alias("photo_categories"),
        F.slice("embedding", 1, 2).alias("photo_coords"),
    )
    return R.zip_photos(rec, "vec_id").select("vec_id", c("ord").cast("long").alias("ord"), "title", "category")


@query(
    "photo_text",
    """WITH RECURSIVE m AS (SELECT conv_id, turn+1 AS pos, role, text, turn+1 AS n FROM conversations),
    ph AS (SELECT conv_id, pos, n, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS i FROM m WHERE role='assistant'),
    cd AS (SELECT p.conv_id, p.pos, list({'a': a, 'b': b, 'tpos': tpos} ORDER BY a, b) AS o FROM (
      SELECT ph.conv_id, ph.pos, x.pos AS tpos, CASE WHEN nm THEN 1 WHEN x.pos-ph.pos BETWEEN -3 AND -1 THEN 2 WHEN x.pos-ph.pos BETWEEN 1 AND 3 THEN 3 END AS a, CASE WHEN nm THEN x.pos ELSE abs(x.pos-ph.pos) END AS b
      FROM ph JOIN (SELECT * FROM m WHERE role='user') x ON x.conv_id=ph.conv_id AND abs(x.pos-ph.pos)<=5, LATERAL (SELECT contains(lower(x.text),'photo '||ph.n) OR contains(lower(x.text),'pic '||ph.n) OR contains(lower(x.text),'image '||ph.n) OR contains(lower(x.text),ph.n||'.') AS nm)) p WHERE a IS NOT NULL GROUP BY 1,2),
    s AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS taken, CAST(NULL AS BIGINT) AS pos, CAST(NULL AS BIGINT) AS got FROM (SELECT DISTINCT conv_id FROM ph)
      UNION ALL SELECT s.conv_id, ph.i, CASE WHEN g IS NULL THEN taken ELSE list_append(taken, g) END, ph.pos, g FROM s JOIN ph ON ph.conv_id=s.conv_id AND ph.i=s.i+1 LEFT JOIN cd ON cd.conv_id=ph.conv_id AND cd.pos=ph.pos,
        LATERAL (SELECT list_filter(cd.o, lambda e: NOT list_contains(taken, e.tpos))[1].tpos AS g))
    SELECT s.conv_id, s.pos, md5(coalesce(regexp_replace(m.text,'^\\s+|\\s+$','','g'),'')) AS description FROM s LEFT JOIN m ON m.conv_id=s.conv_id AND m.pos=s.got WHERE s.i>0""".replace("\\\\", "\\"),
)
def photo_text(t):
    photo = c("role") == "assistant"
    m = t.conversations.filter(c("role").isin("assistant", "user", "system")).select(
        "conv_id", (c("turn") + 1).alias("pos"), F.when(~photo, c("text")).alias("content"), F.when(c("role") == "system", "system").otherwise("damaged").alias("category"),
        F.when(photo, "p.jpg").alias("media_path"), (c("turn") + 1).alias("photo_num"),
    )
    out = R.photo_descriptions(m, "conv_id", "pos")
    return out.select("conv_id", "pos", F.md5(c("description").cast("binary")).alias("description"))


@query(
    "defect_grid",
    """WITH d AS (SELECT unnest(['cracks','leaching','honeycombing','exposed_rebar','leakage','spalling','rust_marks','shuttering','delamination','vegetation','any_other']) AS defect, unnest(range(0,11)) AS i),
    e AS (SELECT user_id, event_type AS element, min(event_id) AS elem_ord FROM events GROUP BY 1,2), m AS (SELECT user_id, event_type AS element, CAST(props->>'k' AS INTEGER)%11 AS i, max(event_id) AS o FROM events WHERE value>30 GROUP BY 1,2,3)
    SELECT e.user_id, e.element, d.defect, d.i+5 AS row, CASE WHEN o%4<>0 THEN 'seen '||o END AS obs FROM e, d LEFT JOIN m ON m.user_id=e.user_id AND m.element=e.element AND m.i=d.i""",
)
def defect_grid(t):
    k = F.get_json_object("props", "$.k").cast("int") % 11
    elements = t.events.groupBy("user_id", c("event_type").alias("element")).agg(F.min("event_id").alias("elem_ord"))
    seen = t.events.filter("value > 30").groupBy("user_id", c("event_type").alias("element"), F.get(F.array(*[F.lit(d) for d in R.DEFECTS]), k).alias("defect")).agg(F.max("event_id").alias("o"))
    matrix = seen.select("user_id", "element", "defect", F.when(c("o") % 4 == 0, " Absent").otherwise(F.concat(F.lit("seen "), c("o").cast("string"))).alias("obs"))
    return R.defect_grid(elements, matrix, ["user_id"], 1).select("user_id", "element", "defect", "row", "obs")


@query(
    "railway_span",
    """WITH f AS (SELECT user_id, arg_min(event_type, event_id) AS element FROM events GROUP BY 1), m AS (SELECT user_id, event_type AS element, CAST(props->>'k' AS INTEGER)%4 AS d, max(value::INTEGER)::VARCHAR AS obs FROM events WHERE value>50 GROUP BY 1,2,3)
    SELECT f.user_id, f.element, coalesce(max(obs) FILTER (WHERE d=0),'Not Applicable') AS concrete, max(obs) FILTER (WHERE d=1) AS vegetation, coalesce(max(obs) FILTER (WHERE d=2), max(obs) FILTER (WHERE d=3)) AS any_other FROM f LEFT JOIN m ON m.user_id=f.user_id AND m.element=f.element GROUP BY 1,2""",
)
def railway_span(t):
    first = t.events.groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("element"))
    d = F.get(F.array(*[F.lit(x) for x in ("concrete", "vegetation", "any_other", "rust_marks")]), F.get_json_object("props", "$.k").cast("int") % 4)
    matrix = t.events.filter("value > 50").groupBy("user_id", c("event_type").alias("element"), d.alias("defect")).agg(F.max(F.bround("value").cast("int")).cast("string").alias("obs"))
    return R.railway_span(matrix, first, ["user_id"])


@query(
    "stretched_photos",
    """WITH i AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) AS k, l_quantity AS w, 1+l_suppkey%7 AS h FROM lineitem), s AS (SELECT o_orderkey, unnest([1,2,3]) AS k, 10+o_custkey%20 AS w, 4 AS h FROM orders)
    SELECT l_orderkey, i.k FROM i JOIN s ON o_orderkey=l_orderkey AND s.k=i.k WHERE abs(i.w/i.h - s.w/s.h)/(s.w/s.h)>0.25""",
)
def stretched_photos(t):
    from spanledger.plans.scan import numbered

    shown = numbered(t.lineitem, ["l_orderkey"], ["l_linenumber", "l_suppkey", "l_partkey"], "k").select("l_orderkey", "k", c("l_quantity").alias("width"), (1 + c("l_suppkey") % 7).alias("height"))
    src = t.orders.select(c("o_orderkey").alias("l_orderkey"), F.explode(F.array(*[F.lit(i).cast("long") for i in (1, 2, 3)])).alias("k"), (10 + c("o_custkey") % 20).alias("width"), F.lit(4).alias("height"))
    return R.stretched_photos(shown, src, ["l_orderkey"]).select("l_orderkey", "k")


@query(
    "sequential_fields",
    r"""WITH s AS (SELECT doc_id, [regexp_replace(regexp_replace(x,'[;,]\s*$',''),'^\s+|\s+$','','g') FOR x IN string_split(regexp_replace('Deck level: 7 then '||source||' next next '||lang||' and then x '||text, '\b(?:and\s+then|next|then)\b', chr(1), 'gi'), chr(1))] AS p FROM documents),
    l AS (SELECT doc_id, unnest(p) AS v, unnest(range(1, len(p)+1)) AS i FROM s)
    SELECT doc_id, CAST(i+19 AS INTEGER) AS seq, {DICTATED}[i+19] AS field, CASE WHEN i=1 THEN '7' ELSE v END AS value FROM l WHERE v<>'' AND i+19<={N}""".replace("{DICTATED}", str(R.DICTATED)).replace("{N}", str(len(R.DICTATED))),
)
def sequential_fields(t):
    # The whole text is dictated, with the separators that it holds itself.
    note = F.concat(F.lit("Deck level: 7 then "), "source", F.lit(" next next "), "lang", F.lit(" and then x "), "text")
    return R.sequential_fields(t.documents.select("doc_id", note.alias("note")), ["doc_id"], "note")


@query(
    "alias_fields",
    """SELECT event_id, CASE event_type WHEN 'click' THEN 'pier_cap_width' WHEN 'view' THEN 'total_length' WHEN 'error' THEN 'bm_gts_level' WHEN 'purchase' THEN 'design_scour_level' END AS field, CASE WHEN event_type<>'signup' THEN value||' m' END AS value FROM events""",
)
def alias_fields(t):
    e = c("event_type")
    head = F.when(e == "click", "Width of pier gap is ").when(e == "view", "Length of bridge between abutment faces: ").when(e == "error", "Location of BM ").when(e == "purchase", "maximum scour level is ").otherwise("deckchair ")
    hit = R.alias_field(c("s"))
    rows = t.events.select("event_id", F.concat(head, c("value").cast("string"), F.lit(" m")).alias("s"))
    return rows.select("event_id", hit["field"].alias("field"), hit["value"].alias("value"))


@query(
    "dictated_units",
    """SELECT event_id, value||' m + '||user_id||' km × 2 one' AS units, 'Refer Table '||n||' and '||(n+1)||' but one crack' AS numbers FROM (SELECT *, event_id%9+1 AS n FROM events)""",
)
def dictated_units(t):
    words = F.array(*[F.lit(w) for w in T.NUMBER_WORDS])
    n = (c("event_id") % 9).cast("int")
    units = F.concat(c("value").cast("string"), F.lit(" meters plus "), c("user_id").cast("string"), F.lit(" Kilometre into 2 one"))
    refs = F.concat(F.lit("Refer Table "), F.get(words, n), F.lit(" and "), F.get(words, n + 1), F.lit(" but one crack"))
    return t.events.select("event_id", T.unit_words(units).alias("units"), T.number_words(refs).alias("numbers"))


@query(
    "json_props",
    """SELECT event_id, CASE WHEN event_id%4<>3 THEN CAST(props->>'k' AS INTEGER) END AS k, event_id%4=3 AS bad FROM events""",
)
def json_props(t):
    m = c("event_id") % 4
    raw = (
        F.when(m == 0, c("props")).when(m == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```")))
        .when(m == 2, F.concat(F.lit("Here it is: "), "props")).otherwise(F.substring("props", 1, 4))
    )
    p = T.lenient_json(c("raw"), "k int")
    return t.events.select("event_id", raw.alias("raw")).select("event_id", p["k"].alias("k"), p["_corrupt_record"].isNotNull().alias("bad"))


@query(
    "cost_rollup",
    """SELECT month, CAST(CASE WHEN month IS NULL THEN 1 ELSE 0 END AS INTEGER) AS is_total, v AS variable_cost, f AS fixed_cost, v+f AS total_cost FROM (
    SELECT month(o_orderdate) AS month, CAST(sum(CAST(CASE WHEN month(o_orderdate) BETWEEN 6 AND 8 THEN 0.19 ELSE 0.095 END AS DECIMAL(9,3))) AS DOUBLE) AS v, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS f FROM orders GROUP BY ROLLUP(month(o_orderdate)))""",
)
def cost_rollup(t):
    m = F.month("o_orderdate")
    rate = F.when(m.between(6, 8), F.lit("0.19")).otherwise("0.095").cast("decimal(9,3)")
    out = costs.cost_projection(t.orders.withColumn("month", m), "month", rate, c("o_totalprice").cast("decimal(18,2)"))
    return out.select(c("month").cast("long").alias("month"), "is_total", c("variable_cost").cast("double").alias("variable_cost"), c("fixed_cost").cast("double").alias("fixed_cost"),
                      (c("variable_cost").cast("double") + c("fixed_cost").cast("double")).alias("total_cost"))
