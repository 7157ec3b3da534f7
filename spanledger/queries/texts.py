"""Rules, labels, notes and title blocks on the given tables."""

from pyspark.sql import functions as F

from spanledger.operators import labels as L
from spanledger.operators import rules as U
from spanledger.plans.scan import numbered
from spanledger.queries.reconcile import SHEET_SQL, drawing_bars
from spanledger.queries.registry import query
from spanledger.session import spread

c = F.col

RULES = [
    # rule_id, types, entities, formula type, field, limit, unit
    ("R-COVER", ["f", "o"], ["notes.cover"], "min_threshold", "notes.cover", 75.0, "mm"),
    ("R-STEEL", ["o", "p"], ["schedule.pile", "notes.cover"], "max_threshold", "schedule.pile", 60.0, "kg"),
    ("R-GRADE", ["f"], ["notes.grade"], "exact_match", "notes.grade", 40.0, None),
    ("R-LIST", ["f", "o", "p"], ["geometry.dia"], "exact_match", "geometry.dia", 2.0, None),
    ("R-RATIO", ["p"], ["notes.cover"], "formula_ratio", "notes.cover", 3.0, None),
]


def rule_table(spark):
    rows = [
        (i, i + " title", t, e, "deterministic", "Notes", "error", u,
         "Value {value}{unit} against {min_value}{max_value}{expected_value}",
         (k, f, v if k == "min_threshold" else None, v if k in ("max_threshold", "formula_ratio") else None, v if k == "exact_match" else None))
        for i, t, e, k, f, v, u in RULES
    ]
    return spark.createDataFrame(
        rows,
        "rule_id string, title string, applicable_drawing_types array<string>, required_entities array<string>, rule_type string, "
        "category string, severity string, unit string, message_template string, "
        "formula struct<type:string,field:string,min_value:double,max_value:double,expected_value:double>",
    )


def rule_values(t):
    o = t.orders.select(c("o_orderkey").alias("id"), (c("o_custkey") % 150).alias("cover"), F.when(c("o_custkey") % 3 == 0, F.concat(F.lit("M"), c("o_custkey").cast("string"))).alias("grade"))
    pile = t.lineitem.filter("l_returnflag = 'N'").groupBy(c("l_orderkey").alias("id")).agg(F.sum("l_quantity").alias("q"))
    dia = t.lineitem.filter("l_returnflag = 'R'").select(c("l_orderkey").alias("id"), "l_quantity")
    return U.paths(
        [
            (o, [F.lit("notes"), F.lit("cover")], c("cover")),
            (o, [F.lit("notes"), F.lit("grade")], c("grade")),
            (pile, [F.lit("schedule"), F.lit("pile")], c("q")),
            (dia, [F.lit("geometry"), F.lit("dia")], c("l_quantity")),
        ],
        "id",
    )


@query(
    "rule_verdicts",
    """WITH v AS (SELECT o_orderkey AS id, 'notes.cover' AS path, CAST(o_custkey%150 AS DOUBLE) AS n, 1 AS k FROM orders
      UNION ALL SELECT o_orderkey, 'notes.grade', NULL, 1 FROM orders WHERE o_custkey%3=0
      UNION ALL SELECT l_orderkey, 'schedule.pile', sum(l_quantity), 1 FROM lineitem WHERE l_returnflag='N' GROUP BY 1
      UNION ALL SELECT l_orderkey, 'geometry.dia', max(l_quantity), count(*) FROM lineitem WHERE l_returnflag='R' GROUP BY 1),
    d AS (SELECT o_orderkey AS id, lower(o_orderstatus) AS t FROM orders),
    x AS (SELECT id, 'R-COVER' AS r, CASE WHEN n<75 THEN 'violated' ELSE 'passed' END AS status, NULL AS reason, n, 'mm against 75' AS tail FROM d JOIN v USING (id) WHERE t IN ('f','o') AND path='notes.cover'
      UNION ALL SELECT id, 'R-STEEL', CASE WHEN n>60 THEN 'violated' ELSE 'passed' END, NULL, n, 'kg against 60' FROM d JOIN v USING (id) WHERE t IN ('o','p') AND path='schedule.pile'
      UNION ALL SELECT id, 'R-GRADE', 'skipped', 'not numeric', NULL, NULL FROM d JOIN v USING (id) WHERE t='f' AND path='notes.grade'
      UNION ALL SELECT id, 'R-LIST', CASE WHEN k>1 THEN 'skipped' WHEN n<>2 THEN 'violated' ELSE 'passed' END, CASE WHEN k>1 THEN 'absent' END, n, ' against 2' FROM d JOIN v USING (id) WHERE path='geometry.dia'
      UNION ALL SELECT id, 'R-RATIO', 'skipped', 'formula_ratio', NULL, NULL FROM d JOIN v USING (id) WHERE t='p' AND path='notes.cover')
    SELECT id, r AS rule_id, status, reason, r||' title ('||r||')' AS title, CASE WHEN status='violated' THEN 'Value '||CAST(n AS INTEGER)||tail END AS description FROM x""",
)
def rule_verdicts(t):
    rules, values = rule_table(t.spark), rule_values(t)
    drawings = t.orders.select(c("o_orderkey").alias("id"), F.lower("o_orderstatus").alias("drawing_type"))
    pairs = U.applicable_rules(rules, drawings, values, "id")
    return U.rule_verdicts(rules, pairs, values, "id").select("id", "rule_id", "status", "reason", "title", "description")


@query(
    "findings_join",
    """SELECT l.doc_id AS rule_id, source||' ('||l.doc_id||')' AS title, CASE WHEN quality=1 THEN 'Toxic passage seen' ELSE source END || ' (Source: '||lang||')' AS description
    FROM labels l JOIN documents d ON d.doc_id=l.doc_id WHERE NOT (quality=0 AND toxic=1)""",
)
def findings_join(t):
    findings = t.labels.select(
        c("doc_id").alias("rule_id"),
        F.when(c("quality") == 1, "Toxic passage seen").when(c("toxic") == 1, "It appears to comply.").otherwise("").alias("description"),
    )
    rules = t.documents.select(c("doc_id").alias("rule_id"), c("source").alias("title"), c("lang").alias("source_reference"))
    return U.judgment_issues(findings, rules).select("rule_id", "title", "description")


@query(
    "concepts",
    """WITH d AS (SELECT user_id, 'k'||(user_id%3) AS t, list_sort(list_distinct(list(event_type))) AS comps FROM events WHERE value>20 GROUP BY 1),
    u AS (SELECT DISTINCT user_id, 'k'||(user_id%3) AS t FROM events),
    k AS (SELECT * FROM (VALUES ('buy',['k0','k1'],['purchase']),('look',['k1'],['view','click']),('fail',['k2','k0'],['error','signup'])) v(concept_id, types, comps))
    SELECT u.user_id, k.concept_id FROM u LEFT JOIN d USING (user_id) JOIN k ON list_contains(k.types, u.t) WHERE d.comps IS NULL OR list_has_any(d.comps, k.comps)""",
)
def concepts(t):
    rows = [("buy", ["k0", "k1"], ["purchase"]), ("look", ["k1"], ["view", "click"]), ("fail", ["k2", "k0"], ["error", "signup"])]
    table = t.spark.createDataFrame(rows, "concept_id string, applicable_drawing_types array<string>, applicable_components array<string>")
    found = U.detected_components(t.events.filter("value > 20"), "user_id", "event_type")
    users = t.events.select("user_id").distinct().withColumn("drawing_type", F.concat(F.lit("k"), (c("user_id") % 3).cast("string")))
    return U.relevant_concepts(table, users.join(found, "user_id", "left"), "user_id")


@query(
    "drawing_type",
    """SELECT doc_id, CASE WHEN doc_id%7=0 OR contains(u,'PILE') THEN 'Pile Pilecap Pier' WHEN contains(u,'ABUTMENT') THEN 'Abutment'
    WHEN contains(u,'SUPERSTRUCTURE') OR contains(u,'GIRDER') OR contains(u,'DECK') THEN 'Superstructure' WHEN contains(u,'BEARING') THEN 'Bearing' ELSE 'General' END AS kind
    FROM (SELECT doc_id, upper(text||' '||CASE doc_id%5 WHEN 0 THEN 'abutment' WHEN 1 THEN 'deck slab' WHEN 2 THEN 'bearing' ELSE '' END) AS u FROM documents)""",
)
def drawing_type(t):
    k = c("doc_id") % 5
    tail = F.when(k == 0, "abutment").when(k == 1, "deck slab").when(k == 2, "bearing").otherwise("")
    return t.documents.select("doc_id", U.drawing_type(c("doc_id") % 7 == 0, F.concat("text", F.lit(" "), tail)).alias("kind"))


@query(
    "summary_lines",
    f"""WITH {SHEET_SQL}, z AS (SELECT drawing_id, component, bar_mark, count(*) AS zones FROM w GROUP BY 1,2,3)
    SELECT drawing_id, upper(component) AS section, bar_mark, zone_ord, '  '||bar_mark||CASE WHEN zones>1 THEN ' (zone '||zone_ord||')' ELSE '' END||': dia='||coalesce(col_dia::VARCHAR,'None')||'mm'
     ||coalesce(', spacing='||CAST(sp AS DOUBLE)||'mm','')||', count='||cnt||', length='||CAST(len AS DOUBLE)||'m' AS line FROM w JOIN z USING (drawing_id, component, bar_mark)""",
)
def summary_lines(t):
    return U.summary_lines(drawing_bars(t), "drawing_id")


DIGEST_SQL = f"""{SHEET_SQL}, z AS (SELECT drawing_id, component, bar_mark, count(*) AS zones FROM w GROUP BY 1,2,3), o AS (SELECT o_orderkey AS id, o_custkey AS k, o_orderpriority AS p FROM orders),
    bl AS (SELECT drawing_id AS id, upper(component) AS a, bar_mark AS b, zone_ord AS n, '  '||bar_mark||CASE WHEN zones>1 THEN ' (zone '||zone_ord||')' ELSE '' END||': dia='||coalesce(col_dia::VARCHAR,'None')||'mm'
      ||coalesce(', spacing='||CAST(sp AS DOUBLE)||'mm','')||', count='||cnt||', length='||CAST(len AS DOUBLE)||'m' AS line FROM w JOIN z USING (drawing_id, component, bar_mark) WHERE drawing_id IN (SELECT id FROM o)),
    sc AS (SELECT DISTINCT id, a FROM bl), kv AS (SELECT id, 3 AS part, 'pile_dia' AS name, (1000+k%3)::VARCHAR AS v FROM o WHERE k%2=0 UNION ALL SELECT id, 3, 'depth', '1800' FROM o WHERE k%4=0
      UNION ALL SELECT id, 4, 'cover', '75' FROM o WHERE k%3=0 UNION ALL SELECT id, 4, 'lap', 'M35' FROM o WHERE k%6=0),
    fl AS (SELECT id, p, n FROM o, (SELECT unnest([2, 1]) AS n) WHERE k%5=0),
    u AS (SELECT id, 0 AS part, '' AS a, '' AS b, 0 AS n, 'DRAWING SUMMARY' AS line FROM o UNION ALL SELECT id, 0, '', '', 1, '' FROM o
      UNION ALL SELECT o.id, 1, '', '', 0, 'Components present: '||coalesce(string_agg(lower(a), ', ' ORDER BY a), '(none detected)') FROM o LEFT JOIN sc USING (id) GROUP BY o.id UNION ALL SELECT id, 1, '', '', 1, '' FROM o
      UNION ALL SELECT id, 2, a, '', -1, a||' schedule:' FROM sc UNION ALL SELECT id, 2, a, b, n, line FROM bl UNION ALL SELECT id, 2, a, '~', 0, '' FROM sc
      UNION ALL SELECT DISTINCT id, part, '', '', -1, CASE part WHEN 3 THEN 'Geometry (dimensions extracted from drawing):' ELSE 'Notes:' END FROM kv UNION ALL SELECT id, part, name, '', 0, '  '||name||': '||v FROM kv UNION ALL SELECT DISTINCT id, part, '~', '', 0, '' FROM kv
      UNION ALL SELECT DISTINCT id, 5, '', '', -1, 'ALREADY-FLAGGED ISSUES (from the deterministic/rule/vision checks that already ran — for reference only, do not re-flag these individually; consider what they might indicate holistically):' FROM fl
      UNION ALL SELECT id, 5, 'a', '', n, '  ['||CASE n WHEN 1 THEN 'Notes' ELSE 'General' END||'] '||p||n FROM fl
      UNION ALL SELECT id, 5, '', '', -1, 'ALREADY-FLAGGED ISSUES: none found by the other checks.' FROM o WHERE k%5<>0 UNION ALL SELECT id, 5, '~', '', 0, '' FROM o)"""


@query("summary_digest", f"WITH {DIGEST_SQL} SELECT id, row_number() OVER (PARTITION BY id ORDER BY part, a, b, n) AS line_no, line FROM u")
def summary_digest(t):
    o = t.orders.select(c("o_orderkey").alias("id"), c("o_custkey").alias("k"), c("o_orderpriority").alias("p"))

    def pairs(**values):
        each = F.array(*[F.struct(F.lit(n).alias("name"), v.cast("string").alias("value")) for n, v in values.items()])
        return o.select("id", F.inline(each))

    k = c("k")
    geometry = pairs(pile_dia=F.when(k % 2 == 0, 1000 + k % 3), depth=F.when(k % 4 == 0, F.lit(1800)))
    notes = pairs(lap=F.when(k % 6 == 0, F.lit("M35")), cover=F.when(k % 3 == 0, F.lit(75)))
    n = F.explode(F.array(F.lit(2), F.lit(1)))
    issues = o.filter("k % 5 = 0").select("id", "p", n.alias("ord")).select("id", "ord", F.when(c("ord") == 1, "Notes").alias("category"), F.concat("p", c("ord").cast("string")).alias("title"))
    bars = drawing_bars(t).withColumnRenamed("drawing_id", "id").join(o.select("id"), "id", "left_semi")
    return U.summary_digest(o, bars, geometry, notes, issues, "id")


SECTIONS = {"the": ["THE"], "there": ["THERE"], "other": ["OTHER"], "and": ["AND"], "hand": ["HAND", "BRAND"], "la": ["LA"]}


@query(
    "required_sections",
    """WITH u AS (SELECT source, doc_id, upper(text) AS t FROM documents),
    h AS (SELECT source, doc_id, 'the' AS name FROM u WHERE contains(replace(replace(t,'THERE','#'),'OTHER','#'),'THE')
      UNION ALL SELECT source, doc_id, 'there' FROM u WHERE contains(t,'THERE') UNION ALL SELECT source, doc_id, 'other' FROM u WHERE contains(t,'OTHER')
      UNION ALL SELECT source, doc_id, 'and' FROM u WHERE contains(replace(replace(t,'BRAND','#'),'HAND','#'),'AND')
      UNION ALL SELECT source, doc_id, 'hand' FROM u WHERE contains(t,'HAND') OR contains(t,'BRAND') UNION ALL SELECT source, doc_id, 'la' FROM u WHERE contains(t,'LA')),
    m AS (SELECT source, name, min(doc_id) AS doc_id FROM h GROUP BY 1,2)
    SELECT s.source, n.name, m.doc_id IS NOT NULL AS present, m.doc_id FROM (SELECT DISTINCT source FROM documents) s, (SELECT unnest(['the','there','other','and','hand','la']) AS name) n LEFT JOIN m ON m.source=s.source AND m.name=n.name""",
)
def required_sections(t):
    docs = spread(t.documents, "doc_id").select("source", "doc_id", "text", c("doc_id").alias("ord"))
    return L.required_sections(docs, docs.select("source").distinct(), "source", "text", "ord", SECTIONS, "doc_id")


@query(
    "required_notes",
    """WITH u AS (SELECT source, upper(text||' fe–500 '||CASE WHEN doc_id%9=0 THEN 'fixity' ELSE '' END) AS t FROM documents),
    k AS (SELECT * FROM (VALUES ('steel_grade','FE-500'),('pile_fixity','FIXITY'),('pile_length','PILE LENGTH'),('irc','LICENSE'),('irc','LIZENZ')) v(item, w)),
    p AS (SELECT DISTINCT source, item FROM u JOIN k ON contains(replace(t,'–','-'), w))
    SELECT s.source, i.item, p.item IS NOT NULL AS present FROM (SELECT DISTINCT source FROM documents) s, (SELECT DISTINCT item FROM k) i LEFT JOIN p ON p.source=s.source AND p.item=i.item""",
)
def required_notes(t):
    tail = F.when(c("doc_id") % 9 == 0, "fixity").otherwise("")
    docs = spread(t.documents, "doc_id").select("source", F.concat("text", F.lit(" fe–500 "), tail).alias("text"))
    words = {"steel_grade": ["FE-500"], "pile_fixity": ["FIXITY"], "pile_length": ["PILE LENGTH"], "irc": ["LICENSE", "LIZENZ"]}
    return L.required_notes(docs, docs.select("source").distinct(), "source", "text", words)


@query(
    "missing_notes",
    """WITH p AS (SELECT o_custkey AS k, max(CASE WHEN o_orderstatus='F' THEN 1 ELSE 0 END) AS concrete, max(CASE WHEN o_orderstatus='P' THEN 1 ELSE 0 END) AS steel,
      max(CASE WHEN o_orderpriority='1-URGENT' THEN 1 ELSE 0 END) AS len, max(CASE WHEN o_orderpriority='2-HIGH' THEN 1 ELSE 0 END) AS fix FROM orders GROUP BY 1),
    m AS (SELECT k, unnest(['Concrete grade for pile not specified in notes','Concrete grade for pilecap not specified in notes','Concrete grade for pier not specified in notes']) AS title FROM p WHERE concrete=0
      UNION ALL SELECT k, 'Steel grade (Fe415/Fe500/Fe550) not specified in notes' FROM p WHERE steel=0
      UNION ALL SELECT k, 'Pile related info missing: diameter'||CASE WHEN len=0 THEN ', length' ELSE '' END||CASE WHEN fix=0 THEN ', fixity length' ELSE '' END FROM p)
    SELECT * FROM m""",
)
def missing_notes(t):
    s, p = c("o_orderstatus"), c("o_orderpriority")
    item = F.array(
        F.struct(F.lit("concrete_pile").alias("item"), (s == "F").alias("present")),
        F.struct(F.lit("steel_grade").alias("item"), (s == "P").alias("present")),
        F.struct(F.lit("pile_length").alias("item"), (p == "1-URGENT").alias("present")),
        F.struct(F.lit("pile_fixity").alias("item"), (p == "2-HIGH").alias("present")),
    )
    return L.missing_notes(t.orders.select(c("o_custkey").alias("k"), F.inline(item)), "k").select("k", "title")


@query(
    "note_values",
    r"""WITH d AS (SELECT doc_id, CASE doc_id%3 WHEN 0 THEN 'Pile length = '||(n_chars/8.0)||' m. Fe 500D' WHEN 1 THEN 'Fix. length: 2.5; TMT bars; pile dia.=1.2 m' ELSE 'Lap length for (M35) concrete, HYSD bars' END AS note, text FROM documents),
    u AS (SELECT doc_id, upper(CASE WHEN doc_id%2=0 THEN note||chr(10)||text ELSE text||chr(10)||note END) AS t FROM d),
    m AS (SELECT doc_id, t, regexp_extract(t, 'FIXITY\s*[=:]\s*([\d.]+)\s*M?|FIX\.?\s*LENGTH\s*[=:]\s*([\d.]+)', ['a','b']) AS fx FROM u)
    SELECT doc_id, TRY_CAST(regexp_extract(t, 'PILE\s+LENGTH\s*[=:]\s*([\d.]+)\s*M?', 1) AS DOUBLE) AS pile_length_m, TRY_CAST(CASE WHEN fx.a<>'' THEN fx.a ELSE fx.b END AS DOUBLE) AS pile_fixity_m,
      TRY_CAST(regexp_extract(t, 'PILE\s+DIA\.?\s*[=:]\s*([\d.]+)\s*M?', 1) AS DOUBLE) AS pile_dia_m, TRY_CAST(regexp_extract(t, 'MAX\.?\s+(?:SAFE\s+)?PILE\s+LOAD\s*[=:]\s*([\d.]+)\s*T', 1) AS DOUBLE) AS max_pile_load_t,
      TRY_CAST(regexp_extract(t, 'CLEAR\s+COVER\s+TO\s+ANY\s+REINFORCEMENT\s*[=:]\s*([\d.]+)\s*MM', 1) AS DOUBLE) AS clear_cover_mm,
      nullif(regexp_replace(regexp_extract(t, '\b(FE\s*-?\s*\d+[A-Z]*|HYSD|TMT)\b', 1), '\s+', '', 'g'), '') AS steel_grade,
      nullif(regexp_extract(t, 'LAP\s+LENGTH\b[^.!?\n]{0,120}?\b(M\d+)\b', 1), '') AS lap_length_concrete_grade FROM m""",
)
def note_values(t):
    k = c("doc_id") % 3
    note = (
        F.when(k == 0, F.concat(F.lit("Pile length = "), (c("n_chars") / 8).cast("string"), F.lit(" m. Fe 500D")))
        .when(k == 1, "Fix. length: 2.5; TMT bars; pile dia.=1.2 m")
        .otherwise("Lap length for (M35) concrete, HYSD bars")
    )
    v = L.note_values(c("note"))
    # The note stands before every second text and after the others, so what a text itself holds counts first there.
    first = c("doc_id") % 2 == 0
    whole = F.when(first, F.concat(note, F.lit("\n"), "text")).otherwise(F.concat("text", F.lit("\n"), note))
    return spread(t.documents, "doc_id").select("doc_id", whole.alias("note")).select("doc_id", *[x.alias(n) for n, x in v.items()])


@query(
    "note_grades",
    """WITH RECURSIVE n AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_extendedprice) AS i,
      CASE WHEN l_partkey%5=0 THEN NULL ELSE 'M'||(30+5*(l_suppkey%5)) END AS g, CASE l_partkey%4 WHEN 0 THEN 'pilecap' WHEN 1 THEN 'pile' WHEN 2 THEN 'pier' END AS t FROM lineitem),
    s AS (SELECT k, 0 AS i, NULL::VARCHAR AS a, NULL::VARCHAR AS b, NULL::VARCHAR AS c FROM (SELECT DISTINCT k FROM n)
      UNION ALL SELECT s.k, n.i,
        CASE WHEN s.a IS NULL AND g IS NOT NULL AND (t IS NULL OR t='pilecap' OR (t='pile' AND s.b IS NOT NULL) OR (t='pier' AND s.c IS NOT NULL)) THEN g ELSE s.a END,
        CASE WHEN s.b IS NULL AND g IS NOT NULL AND (t IS NULL OR t='pile' OR (t='pilecap' AND s.a IS NOT NULL) OR (t='pier' AND s.c IS NOT NULL)) THEN g ELSE s.b END,
        CASE WHEN s.c IS NULL AND g IS NOT NULL AND (t IS NULL OR t='pier' OR (t='pilecap' AND s.a IS NOT NULL) OR (t='pile' AND s.b IS NOT NULL)) THEN g ELSE s.c END
      FROM s JOIN n ON n.k=s.k AND n.i=s.i+1),
    f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY k ORDER BY i DESC)=1)
    SELECT k, 'pilecap' AS component, a AS grade FROM f WHERE a IS NOT NULL UNION ALL SELECT k, 'pile', b FROM f WHERE b IS NOT NULL UNION ALL SELECT k, 'pier', c FROM f WHERE c IS NOT NULL""",
)
def note_grades(t):
    grade = F.concat(F.lit("M"), (30 + 5 * (c("l_suppkey") % 5)).cast("string"))
    m = c("l_partkey") % 4
    name = F.when(m == 0, " PILECAP").when(m == 1, " Pile").when(m == 2, " pier").otherwise("")
    line = F.when(c("l_partkey") % 5 == 0, F.concat(F.lit("LAP LENGTH "), grade)).otherwise(F.concat(F.lit("Concrete "), grade, name))
    rows = t.lineitem.select(c("l_orderkey").alias("k"), "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice", line.alias("line"))
    ordered = numbered(rows, ["k"], ["l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice"], "i")
    return L.note_grades(ordered, "k", "line", "i")


@query(
    "cut_marks",
    """SELECT user_id, upper(event_type[1]) AS mark, count(*) AS n FROM events GROUP BY 1,2 HAVING count(*)>=2 AND NOT (count(*)>=3 AND max(value)-min(value)<=60)""",
)
def cut_marks(t):
    mark = L.letter_mark(F.upper(F.substring("event_type", 1, 1)), F.lit(False), F.lit(False))
    return L.cut_marks(t.events, ["user_id"], mark, "value", F.lit(60.0))


@query(
    "missing_sections",
    """WITH m AS (SELECT user_id, upper(event_type[1]) AS mark FROM events GROUP BY 1,2 HAVING count(*)>=2 AND NOT (count(*)>=3 AND max(value)-min(value)<=60)),
    l AS (SELECT DISTINCT user_id, unnest([upper(event_type[1]), 'Z']) AS mark FROM events WHERE value>90)
    SELECT user_id, mark FROM m WHERE (user_id, mark) NOT IN (SELECT (user_id, mark) FROM l)""",
)
def missing_sections(t):
    letter = F.upper(F.substring("event_type", 1, 1))
    marks = L.cut_marks(t.events, ["user_id"], letter, "value", F.lit(60.0))
    label = F.concat(F.lit("Section "), letter, F.lit("-"), letter, F.lit(" FOR PILE SECTION Z-Z"))
    labels = t.events.filter("value > 90").select("user_id", label.alias("label"))
    return L.missing_sections(marks, labels, ["user_id"], "label").select("user_id", "mark")


@query(
    "unreferenced_views",
    """WITH l AS (SELECT DISTINCT user_id, upper(event_type[1])||(event_id%3+1) AS mark FROM events WHERE value>100), m AS (SELECT user_id, upper(event_type[1])||(event_id%3+1) AS mark FROM events WHERE value<=10 GROUP BY 1,2 HAVING count(*)>=2)
    SELECT user_id, mark FROM l WHERE (user_id, mark) NOT IN (SELECT (user_id, mark) FROM m)""",
)
def unreferenced_views(t):
    mark = F.concat(F.upper(F.substring("event_type", 1, 1)), (c("event_id") % 3 + 1).cast("string"))
    label = F.concat(F.lit("SECTION "), mark, F.lit("-"), mark)
    labels = t.events.filter("value > 100").select("user_id", label.alias("label")).distinct()
    marks = L.cut_marks(t.events.filter("value <= 10"), ["user_id"], L.letter_mark(mark, F.lit(False), F.lit(False)), "value", F.lit(-1.0))
    return L.unreferenced_views(labels, marks, ["user_id"], "label").select("user_id", "mark")


@query(
    "missing_details",
    """SELECT DISTINCT user_id, upper(event_type[1]) AS mark FROM events WHERE value>=50 AND (user_id, upper(event_type[1])) NOT IN (SELECT (user_id, upper(event_type[1])) FROM events WHERE value>=100)""",
)
def missing_details(t):
    letter = F.upper(F.substring("event_type", 1, 1))
    texts = t.events.filter("value >= 50").select("user_id", F.concat(F.lit("see details "), letter, F.lit(" for bars")).alias("text"))
    labels = t.events.filter("value >= 100").select("user_id", F.concat(F.lit("DETAIL "), letter).alias("label"))
    return L.missing_details(texts, labels, ["user_id"], "text", "label")


@query(
    "duplicate_headers",
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10)))+1)) AS i FROM documents),
    k AS (SELECT doc_id, i, length(line) AS w, upper(regexp_replace(regexp_replace(line,'^\s+|\s+$','','g'),'\s+',' ','g')) AS header FROM l WHERE regexp_matches(line,'(?i)\b(the|la|der|el|and|de)\b'))
    SELECT doc_id, md5(header) AS header, count(*) AS n, round(avg(i),4) AS x, round(avg(w),4) AS y FROM k GROUP BY doc_id, k.header HAVING count(*)>=2""",
)
def duplicate_headers(t):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    cells = lines.select("doc_id", "line", (c("i") + 1).alias("x"), F.length("line").alias("y"))
    out = L.duplicate_headers(cells, ["doc_id"], "line", r"(?i)\b(the|la|der|el|and|de)\b", "x", "y")
    return out.select("doc_id", F.md5(c("header").cast("binary")).alias("header"), "n", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query(
    "callout_marks",
    """SELECT event_id, CASE WHEN event_id%3=0 THEN event_type[1]||(user_id%100) WHEN event_id%3=1 THEN event_type[1]||'/'||event_type[1]||'1' END AS bar_mark,
    CASE event_id%3 WHEN 0 THEN 'single' ELSE 'merged' END AS kind FROM events WHERE event_id%3<>2""",
)
def callout_marks(t):
    k, letter = c("event_id") % 3, F.substring("event_type", 1, 1)
    mark = F.when(k == 0, F.concat(letter, (c("user_id") % 100).cast("string"))).when(k == 1, F.concat(letter, F.lit("/"), letter, F.lit("1"))).otherwise("see note")
    raw = F.concat(F.lit("\\W0.8;"), F.upper(mark), F.lit("{x}"))
    return L.callout_marks(t.events.select("event_id", raw.alias("raw")), ["event_id"], "raw").select("event_id", "bar_mark", "kind")


@query(
    "liner_units",
    """SELECT user_id, count(*) FILTER (WHERE event_type='error') AS wrong_units, CAST(arg_max(event_id%20, event_id) FILTER (WHERE event_type='click') AS DOUBLE) AS liner_thickness_mm
    FROM events WHERE event_type IN ('error','click','view') GROUP BY 1""",
)
def liner_units(t):
    n = (c("event_id") % 20).cast("string")
    text = (
        F.when(c("event_type") == "error", F.concat(F.lit("{\\W1;STEEL LINER} "), n, F.lit(" M THK.")))
        .when(c("event_type") == "click", F.concat(F.lit("Liner "), n, F.lit(" mm thk")))
        .when(c("event_type") == "view", "liner").otherwise("5 MM THK")
    )
    return L.liner_units(t.events.select("user_id", "event_id", text.alias("text")), "user_id", "text", "event_id")


@query(
    "dimension_kinds",
    """SELECT l_orderkey, l_linenumber, l_suppkey, l_extendedprice, CASE k WHEN 0 THEN 'geometric' WHEN 1 THEN CASE WHEN abs(q-v)>greatest(2.0,v*0.25) THEN 'mismatch' END WHEN 2 THEN 'bar_count' WHEN 3 THEN CASE WHEN q*100>300 AND q*100<5000 THEN 'diameter' END
      WHEN 4 THEN 'zone' WHEN 5 THEN 'remaining' ELSE CASE WHEN q*1000>1000 AND q*1000<50000 THEN 'pile_length' ELSE 'geometric' END END AS kind,
    CASE k WHEN 0 THEN v WHEN 1 THEN CASE WHEN abs(q-v)>greatest(2.0,v*0.25) THEN q END WHEN 3 THEN CASE WHEN q*100>300 AND q*100<5000 THEN q*100 END WHEN 4 THEN q*100 WHEN 5 THEN 0 WHEN 6 THEN CASE WHEN q*1000>1000 AND q*1000<50000 THEN q*1000 ELSE v END END AS number,
    CASE WHEN k IN (4,5) THEN 'y1' END AS mark, CASE WHEN k=2 THEN 2 ELSE 0 END AS pairs
    FROM (SELECT *, l_linenumber-1 AS k, l_quantity AS q, CAST(l_suppkey+1 AS DOUBLE) AS v FROM lineitem)""",
)
def dimension_kinds(t):
    k, q = c("l_linenumber") - 1, c("l_quantity").cast("int")
    s = lambda m: (q * m).cast("string")
    text = (
        F.when(k == 0, "").when(k == 1, s(1)).when(k == 2, F.concat(F.lit("25 -"), s(1), F.lit(" NOS + 16 – 4 NOS")))
        .when(k == 3, F.concat(s(100), F.lit(" DIA"))).when(k == 4, F.concat(s(100), F.lit(" y1")))
        .when(k == 5, "REMAINING Y1").otherwise(F.concat(F.lit("LENGTH OF PILE = "), s(1000)))
    )
    d = L.classify_dimension(c("text"), (c("l_suppkey") + 1).cast("double"))
    rows = spread(t.lineitem, "l_orderkey").withColumn("text", text).withColumn("d", d)
    return rows.select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "d.kind", "d.number", "d.mark", F.size(L.bar_count_pairs(c("text"))).alias("pairs"))


@query(
    "title_fields",
    """WITH e AS (SELECT user_id, event_id, event_type AS e, event_id%30 AS n FROM events),
    f AS (SELECT user_id, event_id, 'revision' AS field, 'R'||n AS value FROM e WHERE e='click' UNION ALL SELECT user_id, event_id, 'width', n||'.5M' FROM e WHERE e='view'
      UNION ALL SELECT user_id, event_id, 'pier_range', 'P'||n||' TO P'||(n+1) FROM e WHERE e='error' UNION ALL SELECT user_id, event_id, 'scale', '1 : '||n FROM e WHERE e='signup'),
    nm AS (SELECT user_id, 'A.B.N'||n AS value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM e WHERE e='purchase')
    SELECT user_id, field, arg_min(value, event_id) AS value FROM f GROUP BY 1,2
    UNION ALL SELECT user_id, ['drawn_by','design_by','approved_by'][k], value FROM nm WHERE k<=3""",
)
def title_fields(t):
    n, e = (c("event_id") % 30), c("event_type")
    s = n.cast("string")
    text = (
        F.when(e == "click", F.concat(F.lit(" r"), s)).when(e == "view", F.concat(s, F.lit(".5m wide")))
        .when(e == "error", F.concat(F.lit("piers p"), s, F.lit(" to p"), (n + 1).cast("string")))
        .when(e == "signup", F.concat(F.lit("1 : "), s)).otherwise(F.concat(F.lit("A.B.N"), s))
    )
    rows = t.events.select("user_id", F.lit(1).alias("pass"), "event_id", text.alias("text"))
    return L.title_fields(rows, "user_id", "text", ["pass", "event_id"])


@query(
    "attribute_fields",
    """SELECT user_id, field, arg_max(v, event_id) AS value FROM (SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 'revision' WHEN 'view' THEN 'scale' WHEN 'error' THEN 'approved_by' END AS field, 'v'||user_id||event_type AS v
    FROM events WHERE event_type IN ('click','view','error') AND event_id%2=0) GROUP BY 1,2""",
)
def attribute_fields(t):
    e = c("event_type")
    tag = F.when(e == "click", "rev_no ").when(e == "view", "SCALE").when(e == "error", "checked_by").otherwise("OTHER")
    value = F.when(c("event_id") % 2 == 0, F.concat(F.lit(" v"), c("user_id").cast("string"), e)).otherwise("Drawing No")
    return L.attribute_fields(t.events.select("user_id", "event_id", tag.alias("tag"), value.alias("v")), "user_id", "tag", "v", "event_id")


@query(
    "section_headers",
    """SELECT l_orderkey, l_linenumber, l_suppkey, l_extendedprice, CASE k WHEN 0 THEN 'pilecap' WHEN 1 THEN 'pile' WHEN 5 THEN 'pier' END AS header, CASE s WHEN 0 THEN 'pile' WHEN 1 THEN 'pier' WHEN 2 THEN 'pilecap' END AS mark_comp,
    CASE s WHEN 0 THEN 'pilecap' WHEN 1 THEN 'pile' WHEN 2 THEN 'pier' ELSE 'unknown' END AS label_comp
    FROM (SELECT *, l_linenumber-1 AS k, l_suppkey%4 AS s FROM lineitem)""",
)
def section_headers(t):
    k, s = c("l_linenumber") - 1, c("l_suppkey") % 4
    rows = ["PILECAP", "pile (SCHEDULE PER PILE)", "PILE = 11460 KG", "MAX. LOAD ON TOP OF PILE", "PIER NO. BOT. OF PILECAP", "Pier (CIRCULAR)"]
    text = F.lit("PILE DESIGN QTY.=119.8 KG")
    for i, r in enumerate(rows):
        text = F.when(k == i, r).otherwise(text)
    mark = F.when(s == 0, "y7").when(s == 1, "i2").when(s == 2, "a").otherwise("q")
    label = F.when(s == 0, "section of pilecap & pier").when(s == 1, "PILE").when(s == 2, "Pier top").otherwise("abutment")
    return spread(t.lineitem, "l_orderkey").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice",
        L.section_header(text).alias("header"), L.component_of_mark(mark).alias("mark_comp"), L.component_of_label(label).alias("label_comp"),
    )


@query(
    "section_grades",
    """WITH s AS (SELECT o_custkey AS id, o_orderkey AS y, 'SECTION '||o_orderkey AS line, ['pile','pier','pilecap'][o_orderkey%3+1] AS component FROM orders WHERE o_orderstatus='P'),
    t AS (SELECT o_custkey AS id, o_orderkey AS ord, o_orderkey+37 AS y, 'M'||(30+5*(o_orderkey%5)) AS found FROM orders WHERE o_orderstatus='F'),
    g AS (SELECT c_custkey AS id, unnest([{'component':'pile','grade':'M35'},{'component':'pier','grade':'M'||(30+5*(c_custkey%5))}], recursive:=true) FROM customer),
    j AS (SELECT id, line, grade, arg_min(found, ord) AS found FROM s JOIN g USING (id, component) JOIN t USING (id) WHERE abs(t.y-s.y)<=900 GROUP BY id, line, component, grade)
    SELECT DISTINCT id, line, found, grade FROM j WHERE found<>grade""",
)
def section_grades(t):
    o = t.orders
    sections = o.filter("o_orderstatus = 'P'").select(
        c("o_custkey").alias("id"), c("o_orderkey").cast("double").alias("y"), F.concat(F.lit("SECTION "), c("o_orderkey").cast("string")).alias("line"),
        F.get(F.array(F.lit("pile"), F.lit("pier"), F.lit("pilecap")), (c("o_orderkey") % 3).cast("int")).alias("component"),
    )
    texts = o.filter("o_orderstatus = 'F'").select(
        c("o_custkey").alias("id"), c("o_orderkey").alias("ord"), (c("o_orderkey") + 37).cast("double").alias("y"),
        F.concat(F.lit("(M"), (30 + 5 * (c("o_orderkey") % 5)).cast("string"), F.lit(")")).alias("text"),
    )
    grades = t.customer.select(c("c_custkey").alias("id"), F.inline(F.array(
        F.struct(F.lit("pile").alias("component"), F.lit("M35").alias("grade")),
        F.struct(F.lit("pier").alias("component"), F.concat(F.lit("M"), (30 + 5 * (c("c_custkey") % 5)).cast("string")).alias("grade")),
    )))
    return L.section_grade_mismatch(sections, texts, grades, "id", F.lit(900.0))


@query(
    "section_box",
    """WITH l AS (SELECT o_custkey AS id, o_orderkey AS ord, CASE WHEN o_orderstatus='F' THEN 2 ELSE 0 END AS src, CASE WHEN o_orderkey%3=0 THEN 'TOP Z-Z' ELSE upper(o_orderpriority) END AS label FROM orders WHERE o_orderkey%5<>0),
    s AS (SELECT o_custkey AS id, o_orderkey AS ord, o_orderpriority||' (plan)' AS label FROM orders WHERE o_orderkey%4=0),
    i AS (SELECT c_custkey AS id, 'Bars in '||CASE WHEN c_nationkey%3=0 THEN 'top z-z' WHEN c_nationkey%3=1 THEN 'x1-urgenty' ELSE 'view 4-not specified' END||' are wrong' AS text FROM customer),
    h AS (SELECT i.id, l.label, src, ord FROM i JOIN l USING (id) WHERE contains(upper(i.text), l.label) OR len(list_filter(string_split(l.label,' '), lambda w: len(w)>=5 AND contains(upper(i.text), w)))>0
      UNION ALL SELECT i.id, s.label, 1, ord FROM i JOIN s USING (id) WHERE contains(upper(i.text), upper(s.label)) OR (len(upper(split_part(s.label,' (',1)))>=6 AND contains(upper(i.text), upper(split_part(s.label,' (',1)))))
    SELECT id, label, ['pdf','list','dxf'][src+1] AS space, ord AS box FROM h QUALIFY row_number() OVER (PARTITION BY id ORDER BY src, ord)=1""",
)
def section_box(t):
    own = [c("o_custkey").alias("id"), c("o_orderkey").alias("ord"), c("o_orderkey").alias("box")]
    labels = t.orders.filter("o_orderkey % 5 <> 0").select(
        *own, F.when(c("o_orderstatus") == "F", "dxf").otherwise("pdf").alias("space"),
        F.when(c("o_orderkey") % 3 == 0, "TOP Z-Z").otherwise(F.upper("o_orderpriority")).alias("label"),
    )
    sections = t.orders.filter("o_orderkey % 4 = 0").select(*own, F.concat("o_orderpriority", F.lit(" (plan)")).alias("name"))
    n = c("c_nationkey") % 3
    place = F.when(n == 0, "top z-z").when(n == 1, "x1-urgenty").otherwise("view 4-not specified")
    issues = t.customer.select(c("c_custkey").alias("id"), F.concat(F.lit("Bars in "), place, F.lit(" are wrong")).alias("text"))
    return L.section_box(issues.withColumn("iid", c("id")), labels, "id", "iid", "text", sections).drop("iid")
