"""Scalar functions on text built from, or held in, the given tables."""

from pyspark.sql import functions as F

from spanledger.functions import geo as G
from spanledger.functions import numbers as N
from spanledger.functions import text as T
from spanledger.queries.registry import query
from spanledger.session import spread

LINE_KEY = ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"]
LINE_SQL = "l_orderkey, l_linenumber, l_suppkey, l_extendedprice"


@query(
    "counts",
    f"""SELECT {LINE_SQL},
    CASE (l_linenumber-1)%4 WHEN 0 THEN a*b WHEN 1 THEN 1000*a WHEN 2 THEN a*b+a ELSE a END AS parsed,
    CAST(CASE (l_linenumber-1)%4 WHEN 0 THEN a*b WHEN 1 THEN 0 WHEN 2 THEN a ELSE NULL END AS INTEGER) AS normed,
    CASE WHEN (l_linenumber-1)%4=1 THEN CAST(1000*a AS DOUBLE) END AS floated
    FROM (SELECT *, CAST(l_quantity AS BIGINT) a, CAST(l_linenumber AS BIGINT) b FROM lineitem)""",
)
def counts(t):
    a, b = F.col("l_quantity").cast("long").cast("string"), F.col("l_linenumber").cast("string")
    total = (F.col("l_quantity").cast("long") * F.col("l_linenumber")).cast("string")
    kind = (F.col("l_linenumber") - 1) % 4
    text = (
        F.when(kind == 0, F.concat(a, F.lit("×"), b, F.lit(" = "), total))
        .when(kind == 1, F.concat(a, F.lit(",000")))
        .when(kind == 2, F.concat(a, F.lit("*"), b, F.lit("+"), a))
        .otherwise(F.concat(a, F.lit(" NOS.")))
    )
    # A trailing full stop keeps the last form from being a number.
    c = F.col("text")
    parsed = F.coalesce(N.parse_count(c), N.parse_count(F.replace(c, F.lit("."), F.lit(""))))
    return spread(t.lineitem, "l_orderkey").withColumn("text", text).select(
        *LINE_KEY,
        parsed.alias("parsed"),
        N.norm_count(c).alias("normed"),
        N.safe_float(c).alias("floated"),
    )


@query(
    "reinforcement_text",
    f"""SELECT {LINE_SQL}, d AS dia, CASE k WHEN 0 THEN 'spacing' WHEN 1 THEN 'count' WHEN 2 THEN 'count' ELSE 'spacing' END AS kind,
    CAST(q AS DOUBLE) AS value, CASE WHEN q IN (8,10,12,16,20,25,32) THEN q END AS bare_dia,
    CASE WHEN k=3 THEN q END AS spacing,
    CASE WHEN l_returnflag='R' THEN 'spacing' WHEN l_returnflag='A' THEN 'count' ELSE 'spacing' END AS secondary
    FROM (SELECT *, (l_linenumber-1)%4 AS k, CAST(8+l_suppkey%25 AS INTEGER) AS d, CAST(l_quantity AS INTEGER) AS q FROM lineitem)""",
)
def reinforcement_text(t):
    q = F.col("l_quantity").cast("int").cast("string")
    d = (F.lit(8) + F.col("l_suppkey") % 25).cast("string")
    kind = (F.col("l_linenumber") - 1) % 4
    tail = (
        F.when(kind == 0, F.concat(F.lit("@"), q, F.lit(" c/c")))
        .when(kind == 1, F.concat(F.lit(" – "), q, F.lit(" NOS.")))
        .when(kind == 2, F.concat(F.lit("*"), q))
        .otherwise(F.concat(F.lit(" "), q, F.lit(" c/c")))
    )
    text = F.concat(d, F.lit("Φ"), tail)
    p = F.col("p")
    spacing = F.when(kind == 3, F.concat(q, F.lit(" c/c"))).otherwise(F.lit("N.A."))
    flag = F.col("l_returnflag")
    return spread(t.lineitem, "l_orderkey").withColumn("text", text).withColumn("p", N.reinforcement(F.col("text"))).select(
        *LINE_KEY,
        p["dia"].alias("dia"),
        p["kind"].alias("kind"),
        p["value"].alias("value"),
        N.parse_dia(q).alias("bare_dia"),
        N.parse_spacing(spacing).alias("spacing"),
        N.secondary_kind(F.col("l_quantity"), F.col("l_quantity"), flag == "R", flag == "A").alias("secondary"),
    )


@query(
    "dates",
    """SELECT o_orderkey, CASE o_orderkey%5 WHEN 3 THEN 'about '||strftime(o_orderdate,'%Y') WHEN 4 THEN NULL
    ELSE strftime(o_orderdate,'%d/%m/%Y') END AS shown FROM orders""",
)
def dates(t):
    d, kind = F.col("o_orderdate"), F.col("o_orderkey") % 5
    text = (
        F.when(kind == 0, F.date_format(d, "dd/MM/yyyy"))
        .when(kind == 1, F.date_format(d, "yyyy-MM-dd"))
        .when(kind == 2, F.date_format(d, "dd-MM-yyyy"))
        .when(kind == 3, F.concat(F.lit(" about "), F.date_format(d, "yyyy"), F.lit(" ")))
        .otherwise(" - ")
    )
    return t.orders.select("o_orderkey", G.date_text(text).alias("shown"))


@query(
    "text_clean",
    r"""SELECT doc_id, md5(clean) AS clean_md5, length(clean) AS n,
    regexp_replace(regexp_replace(replace(replace('{W1;'||c2||'<>  NOS','{',''),'}',''),'<>',''),'\s{2,}',' ','g') AS override,
    translate(c2||'–5—6', '–—', '--') AS hyphens
    FROM (SELECT doc_id, regexp_replace(text,'^\s+|\s+$','','g') AS clean,
       regexp_replace(text,'^\s+|\s+$','','g') AS c2 FROM documents)""",
)
def text_clean(t):
    # Codes are put around each whole text and must come off again.
    mtext = F.concat(F.lit("{\\fArial;\\C4;"), F.col("text"), F.lit("}\\L"))
    legacy = F.concat(F.lit("%%u"), F.col("text"), F.lit("%%065"))
    c2 = T.strip(F.col("text"))
    over = T.strip_dimension_override(F.concat(F.lit("\\fArial;{W1;"), c2, F.lit("<>\\X NOS}")))
    both = F.when(T.strip_mtext_codes(mtext) == T.strip_text_codes(legacy), T.strip_mtext_codes(mtext))
    return spread(t.documents, "doc_id").select(
        "doc_id",
        F.md5(both.cast("binary")).alias("clean_md5"),
        F.length(both).cast("long").alias("n"),
        over.alias("override"),
        T.normal_hyphens(F.concat(c2, F.lit("–5—6"))).alias("hyphens"),
    )


@query(
    "comparison_pair",
    f"""SELECT {LINE_SQL}, CASE k WHEN 0 THEN q||' nos' WHEN 1 THEN q||'mm' WHEN 2 THEN q||'mm c/c' WHEN 3 THEN q||' kg/m' ELSE q||' bars' END AS design,
    CASE k WHEN 0 THEN s||' nos' WHEN 1 THEN s||'mm' WHEN 2 THEN 'not shown' WHEN 3 THEN s||' kg/m' ELSE s||' bars' END AS drawing,
    round(abs(q-s)/q*100, 4) AS diff_pct
    FROM (SELECT *, (l_linenumber-1)%5 AS k, CAST(l_quantity AS INTEGER) AS q, l_suppkey+1 AS s FROM lineitem)""",
)
def comparison_pair(t):
    q, s = F.col("l_quantity").cast("int"), F.col("l_suppkey") + 1
    forms = [
        "Design input specifies {q} bars for 'a' (pile). Drawing schedule shows {s} bars.",
        "Design input specifies {q}mm diameter for bar 'a' (pile). Drawing shows {s}mm.",
        "Design input specifies spacing of {q}mm c/c for bar 'a' but drawing schedule does not show spacing.",
        "Design input unit weight = {q} kg/m for 'a' (pile). Drawing schedule shows {s} kg/m.",
        "In Section A-A, {s} bar(s) are drawn for 'a' (pile). Expected {q} (total).",
    ]
    kind = (F.col("l_linenumber") - 1) % 5
    template = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        template = F.when(kind == i, form).otherwise(template)
    desc = T.fill(template, {"q": T.number_g(q.cast("double")), "s": s.cast("string")})
    pair = T.comparison_pair(F.col("desc"))
    return spread(t.lineitem, "l_orderkey").withColumn("desc", desc).select(
        *LINE_KEY,
        pair["design"].alias("design"),
        pair["drawing"].alias("drawing"),
        F.round(N.pct_diff(q.cast("double"), s.cast("double")), 4).alias("diff_pct"),
    )


@query(
    "form_cells",
    """SELECT c_custkey, CASE WHEN c_nationkey%3=0 THEN c_name ELSE c_mktsegment END AS title,
    CASE WHEN c_nationkey%3=0 THEN c_nationkey||'° , '||c_mktsegment||'°' END AS place,
    CASE WHEN c_nationkey%3=0 THEN c_name||' / '||c_mktsegment ELSE c_mktsegment END AS div_cir,
    CASE WHEN c_nationkey%3=0 THEN 'Number of Span: '||c_name END AS spans,
    CASE WHEN c_nationkey%3=0 THEN c_name||'; '||c_mktsegment ELSE c_mktsegment END AS both,
    CASE WHEN c_nationkey%3=1 THEN ' ' WHEN c_nationkey%3=2 THEN ' - ' ELSE c_name END AS kept,
    c_nationkey%3=0 AND c_nationkey%2=0 AS protected FROM customer""",
)
def form_cells(t):
    n = F.col("c_nationkey")
    name = F.when(n % 3 == 0, F.col("c_name")).when(n % 3 == 1, " ").otherwise(" - ")
    seg = F.col("c_mktsegment")
    phrase = F.when((n % 3 == 0) & (n % 2 == 0), "Not Visible").otherwise("visible")
    return t.customer.select(
        "c_custkey",
        T.first_present(name, seg).alias("title"),
        T.location(F.when(n % 3 == 0, n.cast("string")), seg).alias("place"),
        T.division_circle(name, seg).alias("div_cir"),
        T.spans_cell(name).alias("spans"),
        T.combine([name, seg], "; ").alias("both"),
        T.safe(name).alias("kept"),
        T.is_protected(phrase).alias("protected"),
    )


@query(
    "commands",
    """SELECT conv_id, turn, regexp_matches(lower(text),'thank you|thanks|thankyou|thank u|shukriya|dhanyawad|👍|🙏|❤️|😊|🤝|👏') AS gratitude,
    lower(regexp_replace(text,'^\\s+|\\s+$','','g')) IN ('done','1','2','3','4','5','6') AS option,
    regexp_matches(lower(w),'^[a-z][0-9]{0,2}$') AND lower(w) NOT IN ('m') AS mark
    FROM (SELECT *, regexp_extract(text,'^[A-Za-z0-9]+') AS w FROM conversations)""".replace("\\\\", "\\"),
)
def commands(t):
    word = F.regexp_extract("text", "^[A-Za-z0-9]+", 0)
    return t.conversations.select(
        "conv_id",
        "turn",
        T.is_gratitude(F.col("text")).alias("gratitude"),
        T.command(F.col("text")).isin("done", *"123456").alias("option"),
        T.is_bar_mark(word).alias("mark"),
    )


@query(
    "shape_match",
    """WITH RECURSIVE v AS (SELECT vec_id,
       list_sort([CAST(round(abs(x)*1000) AS DOUBLE)+1 FOR x IN embedding[1:5]]) AS d,
       list_sort([CAST(round(abs(x)*1000) AS DOUBLE)+1 FOR x IN embedding[6:9]]) AS w FROM embeddings),
    s AS (SELECT vec_id, d, w AS rest, 0 AS i, NULL::DOUBLE AS dm, NULL::DOUBLE AS wm FROM v
      UNION ALL
      SELECT vec_id, d, list_filter(rest, lambda x, j: j <> k), i+1, d[i+1], c[k]
      FROM (SELECT *, list_position(gap, list_min(gap)) AS k FROM
        (SELECT *, [abs(x-d[i+1]) FOR x IN c] AS gap FROM
          (SELECT *, [CASE WHEN substr(CAST(CAST(x AS BIGINT) AS VARCHAR),1,1)='1' AND len(CAST(CAST(x AS BIGINT) AS VARCHAR))>=2
              AND len(list_filter(d, lambda y: abs(CAST(substr(CAST(CAST(x AS BIGINT) AS VARCHAR),2) AS DOUBLE)-y)/y < 0.03))>0
              THEN CAST(substr(CAST(CAST(x AS BIGINT) AS VARCHAR),2) AS DOUBLE) ELSE x END FOR x IN rest] AS c
           FROM s WHERE i<5 AND len(rest)>0))))
    SELECT vec_id, i AS seq, dm AS design_mm, wm AS drawing_mm, abs(dm-wm)/dm*100>2 AND abs(dm-wm)/dm*100<=55 AS flagged
    FROM s WHERE i>0""",
)
def shape_match(t):
    whole = lambda x: F.round(F.abs(x.cast("double")) * 1000) + 1
    design = F.transform(F.slice("embedding", 1, 5), lambda x: whole(x) / 1000)
    drawn = F.transform(F.slice("embedding", 6, 4), whole)
    pairs = t.embeddings.select("vec_id", F.posexplode(N.match_dims(design, drawn)).alias("p", "pair"))
    d, w = F.round(F.col("pair.design_mm")), F.col("pair.drawing_mm")
    pct = N.pct_diff(d, w)
    return pairs.select(
        "vec_id",
        (F.col("p") + 1).alias("seq"),
        d.alias("design_mm"),
        w.alias("drawing_mm"),
        ((pct > 2) & (pct <= 55)).alias("flagged"),
    )


@query(
    "closest_pairs",
    """WITH RECURSIVE v AS (SELECT vec_id, [round(abs(x)*100) FOR x IN embedding[1:4]] AS d,
       [round(abs(x)*100) FOR x IN embedding[5:8]] AS w FROM embeddings),
    o AS (SELECT vec_id, w, list_transform(list_sort(list_transform([1,2,3,4], lambda i: {'k': -d[i], 'i': i})), lambda e: e.i) AS seq, d FROM v),
    s AS (SELECT vec_id, d, w, seq, [1,2,3,4] AS rest, 0 AS n, NULL::INTEGER AS design_ord, NULL::INTEGER AS drawing_ord FROM o
      UNION ALL
      SELECT vec_id, d, w, seq, list_filter(rest, lambda x: x<>best), n+1, seq[n+1], best FROM (
        SELECT *, list_sort(list_transform(rest, lambda j: {'s': CASE WHEN d[seq[n+1]]<>0 AND w[j]<>0 THEN abs(d[seq[n+1]]-w[j]) ELSE CAST('inf' AS DOUBLE) END, 'j': j}))[1].j AS best
        FROM s WHERE n<4))
    SELECT vec_id, design_ord, drawing_ord FROM s WHERE n>0""",
)
def closest_pairs(t):
    def rows(start):
        return F.transform(
            F.slice("embedding", start, 4),
            lambda x, i: F.struct(
                F.round(F.abs(x.cast("double")) * 100).alias("count"),
                F.lit(None).cast("double").alias("length"),
                (i + 1).alias("ord"),
            ),
        )

    return t.embeddings.select("vec_id", F.inline(N.closest_pairs(rows(1), rows(5))))


@query(
    "sheet_boxes",
    """WITH e AS (SELECT label, min(embedding[1])::DOUBLE x0, max(embedding[1])::DOUBLE x1, min(embedding[2])::DOUBLE y0, max(embedding[2])::DOUBLE y1 FROM embeddings GROUP BY 1),
    p AS (SELECT vec_id, e.*, embedding[1]::DOUBLE x, embedding[2]::DOUBLE y, embedding[3]::DOUBLE a FROM embeddings JOIN e USING (label)),
    b AS (SELECT vec_id, round_even((x-x0)/(x1-x0)*100,2) AS x_pct, round_even((y1-y)/(y1-y0)*100,2) AS y_pct,
      ((pi()/2 - a*8)/(2*pi())*12) AS hr, a FROM p),
    c AS (SELECT *, hr - floor(hr/12)*12 AS h FROM b)
    SELECT vec_id, round(x_pct,1) AS x_pct, round(y_pct,1) AS y_pct,
      CASE WHEN floor(h)=0 THEN 12 ELSE CAST(floor(h) AS INTEGER) END || ':' || lpad(CAST(CAST(floor((h-floor(h))*60) AS INTEGER) AS VARCHAR),2,'0') || ' o''clock' AS clock,
      CASE WHEN x_pct BETWEEN 0 AND 100 AND y_pct BETWEEN 0 AND 100 AND a*100>0 THEN round(a*100,3) ELSE 34.0 END AS box_w,
      CAST(CASE WHEN vec_id%3=0 THEN 25.4 WHEN vec_id%3=1 THEN 1000.0 ELSE 1.0 END AS DOUBLE) AS mm
    FROM c""",
)
def sheet_boxes(t):
    x, y = F.get("embedding", 0).cast("double"), F.get("embedding", 1).cast("double")
    pts = t.embeddings.select("vec_id", "label", x.alias("x"), y.alias("y"), F.get("embedding", 2).cast("double").alias("a"))
    cloud = pts.groupBy("label").agg(
        F.struct(F.min("x").alias("xmin"), F.min("y").alias("ymin"), F.max("x").alias("xmax"), F.max("y").alias("ymax")).alias("ext")
    )
    j = pts.join(cloud, "label").withColumn("ext", G.sheet_extent(F.col("ext"), F.col("ext")))
    p = G.to_pct(F.col("x"), F.col("y"), F.col("ext"))
    b = G.box(p["x"], p["y"], F.col("a") * 100, F.lit(5.0))
    code = F.when(F.col("vec_id") % 3 == 0, 1).when(F.col("vec_id") % 3 == 1, 6).otherwise(99)
    return j.select(
        "vec_id",
        F.round(p["x"], 1).alias("x_pct"),
        F.round(p["y"], 1).alias("y_pct"),
        G.clock(F.col("a") * 8).alias("clock"),
        F.round(G.box_or_fallback(F.lit("default"), b)["w"], 3).alias("box_w"),
        G.units_to_mm(code).alias("mm"),
    )


@query(
    "label_value",
    r"""WITH a AS (SELECT doc_id, text, strpos(lower(text), ' the ') AS p FROM documents),
    b AS (SELECT doc_id, regexp_replace(substr(text, p+5),'^\s+|\s+$','','g') AS r FROM a WHERE p>0),
    c AS (SELECT doc_id, r, CASE WHEN strpos(lower(r),'next ')>1 THEN strpos(lower(r),'next ')-1 END s1,
       CASE WHEN strpos(lower(r),' and then ')>1 THEN strpos(lower(r),' and then ')-1 END s2,
       CASE WHEN strpos(lower(r),chr(10))>1 THEN strpos(lower(r),chr(10))-1 END s3 FROM b),
    d AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(substr(r,1,least(s1,s2,s3)),r),'^\s+|\s+$','','g'),'[.,]+$','') AS k FROM c)
    SELECT doc_id, CASE WHEN starts_with(lower(k),'absent') THEN 'Absent'
      WHEN regexp_matches(k,'(?i)^\d+(\.\d+)?\s*(m|meter|metre|mtr)?\b') THEN regexp_extract(k,'^(\d+(?:\.\d+)?)',1)||' m'
      WHEN length(k)<=80 THEN k END AS value FROM d WHERE k<>''""",
)
def label_value(t):
    out = T.value_after_label(F.col("text"), " the ")
    found = F.locate(" the ", F.lower("text")) > 0
    return spread(t.documents, "doc_id").filter(found).select("doc_id", out.alias("value"))


@query(
    "titles_and_names",
    r"""SELECT page_id, array_to_string(list_slice(regexp_split_to_array(regexp_replace(html,'^\s+|\s+$','','g'),'\s+'),1,10),' ') AS short,
    regexp_replace(replace(url,'/','-'),'[^a-zA-Z0-9_\-]+','_','g') || '_report' AS file
    FROM pages""",
)
def titles_and_names(t):
    return t.pages.select(
        "page_id",
        T.short_title(F.col("html")).alias("short"),
        T.file_name([F.col("url"), F.lit("report")]).alias("file"),
    )


@query(
    "photo_refs",
    """SELECT event_id, n, CAST(i AS INTEGER) AS pos FROM (SELECT event_id, user_id::INTEGER AS n, 0 AS i FROM events
    UNION ALL SELECT event_id, (event_id%7)::INTEGER, 1 FROM events)""",
)
def photo_refs(t):
    text = F.concat(
        F.lit("cracks (Photo No.-"), F.col("user_id").cast("string"),
        F.lit(") and rust (Photo No.-"), (F.col("event_id") % 7).cast("string"), F.lit(")"),
    )
    refs = T.photo_refs(T.fill_from_map(F.lit("{{obs}}"), F.create_map(F.lit("obs"), text)))
    return t.events.select("event_id", F.posexplode(refs).alias("pos", "n"))
