"""Place operators; the first two embedding values are x and y, the label is the sheet."""

from pyspark.sql import functions as F

from spanledger.operators import geometry as G
from spanledger.plans import grid
from spanledger.queries.registry import query

c = F.col
PTS = "p AS (SELECT vec_id AS id, label AS sheet, embedding[1]::DOUBLE*10000 AS x, embedding[2]::DOUBLE*10000 AS y, embedding[3]::DOUBLE*10000 AS z FROM embeddings)"


def points(t):
    v = lambda i: F.get("embedding", i).cast("double") * 10000
    return t.embeddings.select(c("vec_id").alias("id"), c("label").alias("sheet"), v(0).alias("x"), v(1).alias("y"), v(2).alias("z"))


def dist(a, b):
    return f"sqrt(({a}.x-{b}.x)**2+({a}.y-{b}.y)**2)"


@query(
    "nearest_label",
    f"""WITH {PTS}, l AS (SELECT id AS lid, sheet%3 AS s, x, y, ['section','plan','detail'][id%3+1] AS view_type FROM p WHERE id%25=0 AND sheet%3<>2),
    d AS (SELECT p.id, arg_min(view_type, ({dist('p','l')}, lid)) AS v, min({dist('p','l')}) AS d FROM p JOIN l ON l.s=p.sheet%3 GROUP BY 1)
    SELECT p.id, CASE WHEN d.v IS NULL THEN NULL WHEN d<=400 THEN v ELSE 'unplaced' END AS view_type, CASE WHEN d<=400 THEN round(d,3) END AS dist FROM p LEFT JOIN d USING (id)""",
)
def nearest_label(t):
    p = points(t).withColumn("s", c("sheet") % 3)
    kind = F.get(F.array(F.lit("section"), F.lit("plan"), F.lit("detail")), (c("id") % 3).cast("int"))
    labels = p.filter("id % 25 = 0 AND s <> 2").select("s", c("id").alias("ord"), "x", "y", kind.alias("view_type"))
    return G.nearest_label(p, labels, "s", "id", 400.0).select("id", "view_type", F.round("dist", 3).alias("dist"))


@query(
    "points_in_box",
    f"""WITH {PTS}, b AS (SELECT id AS box, sheet, x-abs(z) AS xmin, y-2*abs(z) AS ymin, x+abs(z) AS xmax, y+abs(z) AS ymax FROM p WHERE id%7=0)
    SELECT p.id, b.box FROM p JOIN b ON b.sheet=p.sheet AND p.x BETWEEN xmin AND xmax AND p.y BETWEEN ymin AND ymax""",
)
def points_in_box(t):
    p, r = points(t), F.abs("z")
    boxes = p.filter("id % 7 = 0").select(
        c("id").alias("box"), "sheet", (c("x") - r).alias("xmin"), (c("y") - 2 * r).alias("ymin"), (c("x") + r).alias("xmax"), (c("y") + r).alias("ymax")
    )
    return grid.points_in_boxes(p, boxes, ["sheet"]).select("id", "box")


@query(
    "dots_in_boxes",
    f"""WITH {PTS}, q AS (SELECT *, CASE WHEN id%3=0 THEN 'block' ELSE 'circle' END AS source FROM p), b AS (SELECT id AS box, sheet, x-1500 AS xmin, y-1500 AS ymin, x+1500 AS xmax, y+1500 AS ymax FROM p WHERE id%11=0),
    j AS (SELECT q.id, b.box, source, z AS r FROM q JOIN b ON b.sheet=q.sheet AND q.x BETWEEN xmin AND xmax AND q.y BETWEEN ymin AND ymax),
    n AS (SELECT box, count(*) FILTER (WHERE source='block') AS k FROM j GROUP BY 1)
    SELECT id, box FROM j JOIN n USING (box) WHERE CASE WHEN k>=4 THEN source='block' ELSE source='circle' AND r<=600 END""",
)
def dots_in_boxes(t):
    p = points(t)
    dots = p.withColumns({"source": F.when(c("id") % 3 == 0, "block").otherwise("circle"), "r": c("z")})
    boxes = p.filter("id % 11 = 0").select(
        c("id").alias("box"), "sheet", (c("x") - 1500).alias("xmin"), (c("y") - 1500).alias("ymin"), (c("x") + 1500).alias("xmax"), (c("y") + 1500).alias("ymax")
    )
    return G.dots_in_boxes(dots, boxes, "sheet", "box").select("id", "box")


def rects(t):
    w, h = F.floor(F.abs("z")) + 100, F.floor(F.abs("z") / 2) + 50
    x, y = F.floor("x"), F.floor("y")
    return points(t).select("id", "sheet", x.alias("xmin"), y.alias("ymin"), (x + w).alias("xmax"), (y + h).alias("ymax"))


RECTS = f"{PTS}, r AS (SELECT id, sheet, floor(x) AS xmin, floor(y) AS ymin, floor(x)+floor(abs(z))+100 AS xmax, floor(y)+floor(abs(z)/2)+50 AS ymax FROM p)"


@query(
    "nested_boxes",
    f"""WITH {RECTS} SELECT id FROM r WHERE NOT EXISTS (SELECT 1 FROM r o WHERE o.sheet=r.sheet AND o.xmax-o.xmin>r.xmax-r.xmin AND o.xmin-100<=r.xmin AND r.xmax<=o.xmax+100
      AND (abs(r.ymin-o.ymax)<=100 OR abs(r.ymax-o.ymin)<=100))""",
)
def nested_boxes(t):
    return G.suppress_nested(rects(t), ["sheet"], "id").select("id")


@query(
    "component_size",
    f"""WITH {RECTS} SELECT id, CASE WHEN w>h*1.5 AND w*25 BETWEEN 1000 AND 15000 AND h*25>=200 THEN 'pilecap' WHEN w/h BETWEEN 0.6 AND 1.6 AND w*25 BETWEEN 300 AND 6000 AND h*25 BETWEEN 300 AND 6000 AND id%4<>0 THEN 'pier' END AS kind
    FROM (SELECT id, xmax-xmin AS w, ymax-ymin AS h FROM r)""",
)
def component_size(t):
    layer = F.when(c("id") % 4 == 0, "S_REINF").otherwise("OUTLINE")
    return rects(t).select("id", G.component_by_size(c("xmax") - c("xmin"), c("ymax") - c("ymin"), layer, F.lit(1e9), F.lit(1e9), F.lit(25.0)).alias("kind"))


@query(
    "circular_shapes",
    f"""WITH {RECTS}, s AS (SELECT r.*, p.x, p.y, p.z, id%3 AS k FROM r JOIN p USING (id)),
    g AS (SELECT id, sheet, CASE WHEN k=0 THEN x ELSE (xmin+xmax)/2 END AS cx, CASE WHEN k=0 THEN y ELSE (ymin+ymax)/2 END AS cy,
      CASE WHEN k=0 THEN z WHEN k=1 AND id%2=0 AND abs((xmax-xmin)-(ymax-ymin))/greatest(xmax-xmin,ymax-ymin)<=0.15 THEN ((xmax-xmin)+(ymax-ymin))/4 END AS rr FROM s)
    SELECT id, round(rr,3) AS r FROM g WHERE rr>=100 AND NOT (sheet%2=0 AND cx BETWEEN -500 AND 500 AND cy BETWEEN -500 AND 1500)""",
)
def circular_shapes(t):
    b = rects(t).withColumnsRenamed({"xmin": "x0", "xmax": "x1", "ymin": "y0", "ymax": "y1"})
    k = c("id") % 3
    shapes = points(t).drop("sheet").join(b, "id").select(
        "id", "sheet", "x", "y", c("z").alias("r"), "x0", "y0", "x1", "y1", F.when(k == 0, "circle").otherwise("outline").alias("kind"),
        (k == 1).alias("is_closed"), F.when(c("id") % 2 == 0, 8).otherwise(4).alias("n_points"),
    )
    even = c("sheet") % 2 == 0
    sheets = points(t).select("sheet").distinct().select(
        "sheet", F.lit(0.0).alias("ymin"), F.lit(1000.0).alias("ymax"), F.lit(1.0).alias("mm"),
        F.when(even, 0.0).alias("sx0"), F.when(even, 0.0).alias("sy0"), F.when(even, 0.0).alias("sx1"), F.when(even, 1000.0).alias("sy1"),
    )
    return G.circular(shapes, "sheet", sheets).select("id", F.round("ring_r", 3).alias("r"))


@query(
    "layer_preference",
    """WITH e AS (SELECT event_id, user_id, CASE WHEN event_type='error' AND value>60 THEN 'S-REINF' ELSE 'LAYER_'||event_type END AS layer FROM events)
    SELECT event_id FROM e WHERE layer='S-REINF' OR user_id NOT IN (SELECT user_id FROM e WHERE layer='S-REINF')""",
)
def layer_preference(t):
    layer = F.when((c("event_type") == "error") & (c("value") > 60), "S-REINF").otherwise(F.concat(F.lit("LAYER_"), "event_type"))
    return G.prefer_rebar(t.events.select("event_id", "user_id", layer.alias("layer")), "user_id", "layer").select("event_id")


@query(
    "sheet_regions",
    f"""WITH {PTS}, s AS (SELECT sheet, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p GROUP BY 1), a AS (SELECT sheet, arg_min(x,id) AS ax, arg_min(y,id) AS ay FROM p WHERE sheet%2=0 GROUP BY 1),
    j AS (SELECT p.*, s.*, ax, ay FROM p JOIN s USING (sheet) LEFT JOIN a USING (sheet))
    SELECT id, 'schedule' AS part FROM j WHERE x>=x0+0.3*(x1-x0) AND id%5<>0 UNION ALL SELECT id, 'title' FROM j WHERE x>=x0+0.6*(x1-x0) AND y<=y0+0.3*(y1-y0)
    UNION ALL SELECT id, 'views' FROM j WHERE x<x0+0.55*(x1-x0) UNION ALL SELECT id, 'notes' FROM j WHERE CASE WHEN ax IS NULL THEN x<x0+0.55*(x1-x0) ELSE abs(x-ax)<0.4*(x1-x0) AND y>=ay-0.4*(y1-y0) AND y<=ay+5 END""",
)
def sheet_regions(t):
    p = points(t).withColumn("from_block", c("id") % 5 == 0)
    sheets = p.groupBy("sheet").agg(F.min("x").alias("xmin"), F.max("x").alias("xmax"), F.min("y").alias("ymin"), F.max("y").alias("ymax"))
    anchors = p.filter("sheet % 2 = 0").groupBy("sheet").agg(F.min_by("x", "id").alias("ax"), F.min_by("y", "id").alias("ay"))
    parts = [G.region(p, sheets, "sheet", k).select("id", F.lit(k).alias("part")) for k in ("schedule", "title", "views")]
    parts.append(G.notes_window(p, sheets, anchors, "sheet").select("id", F.lit("notes").alias("part")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


@query(
    "unlabeled_views",
    f"""WITH {RECTS}, v AS (SELECT * FROM r WHERE id%2=0), tt AS (SELECT * FROM p WHERE id%2=1)
    SELECT id FROM v WHERE NOT EXISTS (SELECT 1 FROM tt WHERE tt.sheet=v.sheet AND tt.x BETWEEN xmin-200 AND xmax+200 AND tt.y BETWEEN ymin-200 AND ymax+200)""",
)
def unlabeled_views(t):
    # Every place is either a view or a title.
    return G.unlabeled_views(rects(t).filter("id % 2 = 0"), points(t).filter("id % 2 = 1"), ["sheet"], "id", 200.0).select("id")


@query(
    "gap_groups",
    """WITH s AS (SELECT event_id, user_id, epoch_us(ts) AS v FROM events), f AS (SELECT *, CASE WHEN lag(v) OVER w IS NULL OR v-lag(v) OVER w>3600000000 THEN 1 ELSE 0 END AS n FROM s WINDOW w AS (PARTITION BY user_id ORDER BY v, event_id))
    SELECT event_id, user_id, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY v, event_id) AS BIGINT) AS group_no FROM f""",
)
def gap_groups(t):
    rows = t.events.select("event_id", "user_id", F.unix_micros(c("ts").cast("timestamp")).alias("v"))
    return G.gap_groups(rows, ["user_id"], "v", "event_id", 3600000000).select("event_id", "user_id", "group_no")


@query(
    "gap_clusters",
    f"""WITH RECURSIVE {PTS}, e AS (SELECT a.id AS u, b.id AS v FROM p a JOIN p b ON a.sheet=b.sheet AND {dist('a','b')}<=300),
    r(id, root) AS (SELECT id, id FROM p UNION SELECT e.v, r.root FROM r JOIN e ON e.u=r.id WHERE r.root<e.v),
    m AS (SELECT id, min(root) AS cluster FROM r GROUP BY 1), s AS (SELECT sheet, cluster, count(*) AS size FROM m JOIN p USING (id) GROUP BY 1,2),
    k AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY size DESC, cluster) AS cluster_rank FROM s)
    SELECT id, sheet, cluster, size, cluster_rank FROM m JOIN p USING (id) JOIN k USING (sheet, cluster)""",
)
def gap_clusters(t):
    return grid.gap_clusters(points(t), ["sheet"], 300.0, "id").select("id", "sheet", "cluster", "size", "cluster_rank")


@query(
    "ring_spacing",
    f"""WITH {PTS}, m AS (SELECT sheet, avg(x) AS cx, avg(y) AS cy, count(*) AS n FROM p GROUP BY 1), a AS (SELECT p.*, cx, cy, n, atan2(y-cy, x-cx) AS ang FROM p JOIN m USING (sheet) WHERE n>=4),
    s AS (SELECT *, coalesce(lead(id) OVER w, first_value(id) OVER w) AS nid, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM a WINDOW w AS (PARTITION BY sheet ORDER BY ang, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    h AS (SELECT *, sqrt((nx-x)**2+(ny-y)**2) AS chord FROM s), q AS (SELECT sheet, list_sort(list(chord))[count(*)//2+1] AS med FROM h GROUP BY 1)
    SELECT id, nid AS next_id, round(chord,3) AS chord, round(chord/med,4) AS ratio, CASE WHEN chord/med>1.3 THEN 'gap' WHEN chord/med<0.4 THEN 'clustering' END AS kind FROM h JOIN q USING (sheet)""",
)
def ring_spacing(t):
    return G.ring_spacing(points(t), ["sheet"], "id").select("id", "next_id", F.round("chord", 3).alias("chord"), F.round("ratio", 4).alias("ratio"), "kind")


@query(
    "ring_issues",
    f"""WITH {PTS}, pp AS (SELECT id, sheet*100+CAST(floor((atan2(y,x)+pi())*3) AS INTEGER)*7%5 AS g, x, y FROM p), m AS (SELECT g, avg(x) AS cx, avg(y) AS cy, count(*) AS n FROM pp GROUP BY 1), a AS (SELECT pp.*, n, atan2(y-cy, x-cx) AS ang FROM pp JOIN m USING (g) WHERE n>=4),
    s AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM a WINDOW w AS (PARTITION BY g ORDER BY ang, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    h AS (SELECT *, sqrt((nx-x)**2+(ny-y)**2) AS chord FROM s), q AS (SELECT g, list_sort(list(chord))[count(*)//2+1] AS med FROM h GROUP BY 1),
    k AS (SELECT id, g, n, CASE WHEN chord/med>1.3 THEN 'gap' WHEN chord/med<0.4 THEN 'clustering' END AS kind FROM h JOIN q USING (g)),
    o AS (SELECT g FROM k GROUP BY 1 HAVING NOT (max(n)>=8 AND count(kind)>max(n)*0.25))
    SELECT id, g, kind FROM k JOIN o USING (g) WHERE kind IS NOT NULL""",
)
def ring_issues(t):
    import math

    sector = F.floor((F.atan2("y", "x") + F.lit(math.pi)) * 3).cast("int") * 7 % 5
    p = points(t).select("id", (c("sheet") * 100 + sector).alias("g"), "x", "y")
    return G.spacing_issues(G.ring_spacing(p, ["g"], "id"), ["g"]).select("id", "g", "kind")


NN = f"""d AS (SELECT a.sheet, a.id, b.id AS o, {dist('a','b')} AS d FROM p a JOIN p b ON a.sheet=b.sheet AND a.id<>b.id),
    k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, o) AS r FROM d), n AS (SELECT sheet, id, max(o) FILTER (WHERE r=1) AS n1, max(d) FILTER (WHERE r=1) AS d1, max(o) FILTER (WHERE r=2) AS n2, max(d) FILTER (WHERE r=2) AS d2 FROM k GROUP BY 1,2)"""


@query("two_nearest", f"WITH {PTS}, {NN} SELECT id, n1, round(d1,3) AS d1, n2, round(d2,3) AS d2 FROM n")
def two_nearest(t):
    out = grid.two_nearest(points(t), ["sheet"], "id")
    return out.select("id", "n1", F.round("d1", 3).alias("d1"), "n2", F.round("d2", 3).alias("d2"))


@query(
    "mutual_nn",
    f"""WITH {PTS}, {NN}, m AS (SELECT a.sheet, count(*) AS n, count(*) FILTER (WHERE b.n1=a.id) AS mutual FROM n a JOIN n b ON b.id=a.n1 GROUP BY 1),
    q AS (SELECT sheet, list_sort(list(d1/d2))[count(*)//2+1] AS ratio FROM n WHERE d2>0 GROUP BY 1)
    SELECT sheet, n, mutual, round(ratio,4) AS ratio, n>=4 AND mutual>=n*0.7 AND ratio<0.6 AS is_bundle FROM m JOIN q USING (sheet)""",
)
def mutual_nn(t):
    return G.bundles(points(t), ["sheet"], "id").select("sheet", "n", "mutual", F.round("ratio", 4).alias("ratio"), "is_bundle")


@query(
    "collapse_pairs",
    f"""WITH RECURSIVE {PTS}, e AS (SELECT a.sheet, a.id AS a, b.id AS b, {dist('a','b')} AS d FROM p a JOIN p b ON a.sheet=b.sheet AND a.id<b.id),
    k AS (SELECT sheet, a, b, row_number() OVER (PARTITION BY sheet ORDER BY d, a, b) AS i FROM e JOIN (SELECT sheet, min(d)*2.5 AS r FROM e GROUP BY 1) USING (sheet) JOIN (SELECT sheet FROM p GROUP BY 1 HAVING count(*)>=4) USING (sheet) WHERE d<=r),
    s AS (SELECT sheet, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b FROM (SELECT DISTINCT sheet FROM k)
      UNION ALL SELECT k.sheet, k.i, CASE WHEN list_contains(used,k.a) OR list_contains(used,k.b) THEN used ELSE list_concat(used,[k.a,k.b]) END,
        CASE WHEN list_contains(used,k.a) OR list_contains(used,k.b) THEN NULL ELSE k.a END, CASE WHEN list_contains(used,k.a) OR list_contains(used,k.b) THEN NULL ELSE k.b END FROM s JOIN k ON k.sheet=s.sheet AND k.i=s.i+1),
    t AS (SELECT a, b FROM s WHERE a IS NOT NULL)
    SELECT x.sheet, a AS first_id, b AS other_id, round((x.x+y.x)/2,3) AS x, round((x.y+y.y)/2,3) AS y FROM t JOIN p x ON x.id=a JOIN p y ON y.id=b
    UNION ALL SELECT sheet, id, NULL, round(x,3), round(y,3) FROM p WHERE id NOT IN (SELECT a FROM t) AND id NOT IN (SELECT b FROM t)""",
)
def collapse_pairs(t):
    out = G.collapse_pairs(points(t), ["sheet"], "id")
    return out.select("sheet", "first_id", "other_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query(
    "dedup_rings",
    f"""WITH RECURSIVE {PTS}, o AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY id) AS i FROM p),
    s AS (SELECT sheet, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(x DOUBLE, y DOUBLE)[]) AS kept, CAST(NULL AS BIGINT) AS id FROM (SELECT DISTINCT sheet FROM p)
      UNION ALL SELECT o.sheet, o.i, CASE WHEN len(list_filter(kept, lambda q: abs(q.x-o.x)<400 AND abs(q.y-o.y)<400))>0 THEN kept ELSE list_append(kept, {{'x': o.x, 'y': o.y}}) END,
        CASE WHEN len(list_filter(kept, lambda q: abs(q.x-o.x)<400 AND abs(q.y-o.y)<400))>0 THEN NULL ELSE o.id END FROM s JOIN o ON o.sheet=s.sheet AND o.i=s.i+1)
    SELECT id, sheet FROM s WHERE id IS NOT NULL""",
)
def dedup_rings(t):
    return grid.keep_first_apart(points(t), ["sheet"], "id", 400.0).select("id", "sheet")


@query(
    "snap_dimensions",
    f"""WITH {RECTS}, g AS (SELECT *, CASE WHEN xmax-xmin>700 AND id%3<>0 THEN 'pilecap' WHEN id%3=1 THEN 'pier' ELSE 'pile' END AS kind FROM r),
    d AS (SELECT id AS dim, sheet, CASE WHEN id%2=0 THEN 'H' ELSE 'V' END AS orient, CASE WHEN id%2=0 THEN xmin+id%40 ELSE ymin+id%40 END AS lo, CASE WHEN id%2=0 THEN xmax-id%30 ELSE ymax-id%30 END AS hi FROM r),
    n AS (SELECT sheet, count(*) AS n FROM g WHERE kind='pile' GROUP BY 1),
    pc AS (SELECT sheet, id, (xmin+xmax)/2 AS cx, CASE WHEN lag((xmin+xmax)/2) OVER w IS NULL OR (xmin+xmax)/2-lag((xmin+xmax)/2) OVER w>60 THEN 1 ELSE 0 END AS f FROM g WHERE kind='pile' WINDOW w AS (PARTITION BY sheet ORDER BY (xmin+xmax)/2, id)),
    pg AS (SELECT sheet, k, avg(cx) AS ce FROM (SELECT *, sum(f) OVER (PARTITION BY sheet ORDER BY cx, id) AS k FROM pc) GROUP BY 1,2),
    lr AS (SELECT sheet, min(ce) AS gl, max(ce) AS gr FROM pg JOIN n USING (sheet) WHERE n>=2 GROUP BY 1),
    f AS (
     SELECT d.sheet, dim, 'pilecap_depth' AS param, g.id AS rid, 0 AS prio, 0 AS sub FROM d JOIN g ON g.sheet=d.sheet AND kind='pilecap' AND orient='V' AND abs(lo-ymin)<=50 AND abs(hi-ymax)<=50
     UNION ALL SELECT d.sheet, dim, 'pilecap_width', g.id, 0, 0 FROM d JOIN g ON g.sheet=d.sheet AND kind='pilecap' AND orient='H' AND abs(lo-xmin)<=50 AND abs(hi-xmax)<=50
     UNION ALL SELECT d.sheet, dim, 'pilecap_length_overall', g.id, 0, 1 FROM d JOIN g ON g.sheet=d.sheet AND kind='pilecap' AND orient='H' AND hi-lo>(xmax-xmin)*1.05
     UNION ALL SELECT d.sheet, dim, 'pier_plan_dim', g.id, 1, 0 FROM d JOIN g ON g.sheet=d.sheet AND kind='pier' AND orient='H' AND abs(lo-xmin)<=50 AND abs(hi-xmax)<=50
     UNION ALL SELECT d.sheet, dim, 'pile_spacing', -1, 2, 0 FROM d JOIN pg a ON a.sheet=d.sheet JOIN pg b ON b.sheet=d.sheet AND a.k<b.k JOIN n ON n.sheet=d.sheet WHERE n>=2 AND orient='H' AND abs(lo-a.ce)<=50 AND abs(hi-b.ce)<=50
     UNION ALL SELECT d.sheet, dim, 'pile_overhang', g.id, 3, 0 FROM d JOIN g ON g.sheet=d.sheet AND kind='pilecap' AND orient='H' JOIN lr ON lr.sheet=d.sheet WHERE (abs(lo-gr)<=50 AND abs(hi-xmax)<=50) OR (abs(lo-xmin)<=50 AND abs(hi-gl)<=50)
     UNION ALL SELECT d.sheet, dim, 'pile_dia', g.id, 4, 0 FROM d JOIN g ON g.sheet=d.sheet AND kind='pile' AND orient='V' AND abs(lo-ymin)<=50 AND abs(hi-ymax)<=50),
    b AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY sheet, dim ORDER BY prio, rid, sub)=1)
    SELECT sheet, param, rid, min(dim) AS dim FROM b GROUP BY 1,2,3""",
)
def snap_dimensions(t):
    r = rects(t)
    kind = F.when((c("xmax") - c("xmin") > 700) & (c("id") % 3 != 0), "pilecap").when(c("id") % 3 == 1, "pier").otherwise("pile")
    regions = r.select("sheet", c("id").alias("rid"), kind.alias("kind"), *[c(n).cast("double").alias(n) for n in ("xmin", "ymin", "xmax", "ymax")])
    flat = c("id") % 2 == 0
    dims = r.select(
        "sheet", c("id").alias("dim"), F.when(flat, "H").otherwise("V").alias("orient"),
        (F.when(flat, c("xmin")).otherwise(c("ymin")) + c("id") % 40).cast("double").alias("lo"),
        (F.when(flat, c("xmax")).otherwise(c("ymax")) - c("id") % 30).cast("double").alias("hi"), F.lit(1.0).alias("val_mm"),
    )
    return G.snap_dimensions(dims, regions, "sheet", 50.0, 60.0).select("sheet", "param", "rid", "dim")


@query(
    "cut_mark_component",
    f"""WITH {PTS}, l AS (SELECT id AS lid, sheet, x, y, CASE id%3 WHEN 0 THEN ['pile'] WHEN 1 THEN ['pilecap','pier'] ELSE ['pile','pier'] END AS comps FROM p WHERE id%10=0),
    m AS (SELECT id, sheet, chr(CAST(65+id%4 AS INTEGER)) AS letter, x, y FROM p WHERE id%10<>0 AND sheet IN (SELECT sheet FROM p WHERE id%20=1)), cap AS (SELECT id AS cid, sheet, floor(x)+ (floor(abs(z))+100)/2 AS cx, floor(y) AS y0, floor(y)+floor(abs(z)/2)+50 AS y1 FROM p WHERE id%20=1),
    nl AS (SELECT m.*, comps FROM m JOIN l ON l.sheet=m.sheet QUALIFY row_number() OVER (PARTITION BY m.id ORDER BY {dist('m','l')}, lid)=1),
    nc AS (SELECT nl.id, y0, y1 FROM nl JOIN cap ON cap.sheet=nl.sheet WHERE len(comps)>1 QUALIFY row_number() OVER (PARTITION BY nl.id ORDER BY abs(cx-nl.x), cid)=1),
    v AS (SELECT nl.sheet, letter, nl.id, CASE WHEN len(comps)=1 THEN comps[1] WHEN NOT list_contains(comps,'pilecap') THEN NULL WHEN y>y1 THEN 'pier' WHEN y BETWEEN y0 AND y1 THEN 'pilecap' END AS vote FROM nl LEFT JOIN nc USING (id)),
    g AS (SELECT sheet, letter, vote, count(*) AS n, min(id) AS f FROM v WHERE vote IS NOT NULL GROUP BY 1,2,3)
    SELECT sheet, letter, vote, n FROM g QUALIFY row_number() OVER (PARTITION BY sheet, letter ORDER BY n DESC, f)=1""",
)
def cut_mark_component(t):
    p = points(t)
    k = c("id") % 3
    comps = F.when(k == 0, F.array(F.lit("pile"))).when(k == 1, F.array(F.lit("pilecap"), F.lit("pier"))).otherwise(F.array(F.lit("pile"), F.lit("pier")))
    labels = p.filter("id % 10 = 0").select("sheet", c("id").alias("ord"), "x", "y", comps.alias("components"))
    marks = p.filter("id % 10 <> 0").select("sheet", c("id").alias("mid"), F.char(65 + c("id") % 4).alias("letter"), "x", "y")
    caps = rects(t).filter("id % 20 = 1").withColumn("ord", c("id"))
    return G.cut_mark_component(marks, labels, caps, "sheet", 500.0)


@query(
    "ring_regions",
    f"""WITH RECURSIVE {RECTS}, l AS (SELECT id AS lid, sheet, CASE WHEN id%3=0 THEN 'pilecap' ELSE 'pier' END AS component, x, y FROM p WHERE id%40=0),
    g AS (SELECT sheet, 'pilecap' AS component, (xmin+xmax)/2 AS rx, (ymin+ymax)/2 AS ry FROM r WHERE id%120=0),
    f AS (SELECT * FROM l WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.sheet=l.sheet AND g.component=l.component AND (rx-l.x)**2+(ry-l.y)**2<9e6)),
    d AS (SELECT f.lid, f.sheet, f.component, f.x AS lx, f.y AS ly, p.id, p.x, p.y FROM f JOIN p ON p.sheet=f.sheet WHERE (p.x-f.x)**2+(p.y-f.y)**2<9e6),
    e AS (SELECT a.lid, a.id AS u, b.id AS v FROM d a JOIN d b ON a.lid=b.lid WHERE (a.x-b.x)**2+(a.y-b.y)**2<=490000),
    n(lid, id, root) AS (SELECT lid, id, id FROM d UNION SELECT e.lid, e.v, n.root FROM n JOIN e ON e.lid=n.lid AND e.u=n.id WHERE n.root<e.v),
    m AS (SELECT lid, id, min(root) AS cluster FROM n GROUP BY 1,2),
    k AS (SELECT sheet, lid, component, cluster, min(lx) AS lx, min(ly) AS ly, avg(x) AS mx, avg(y) AS my, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax, count(*) AS dots
      FROM d JOIN m USING (lid, id) GROUP BY 1,2,3,4 HAVING count(*)>=8),
    b AS (SELECT *, xmax-xmin AS w, ymax-ymin AS h FROM k QUALIFY row_number() OVER (PARTITION BY lid ORDER BY (mx-lx)**2+(my-ly)**2, -dots, cluster)=1)
    SELECT sheet, lid, component, xmin, ymin, xmax, ymax, dots FROM b WHERE w>0 AND h>0 AND component =
      CASE WHEN w/h>1.5 AND w BETWEEN 1000 AND 15000 AND h>=200 THEN 'pilecap' WHEN w/h BETWEEN 0.6 AND 1.6 AND w BETWEEN 300 AND 6000 AND h BETWEEN 300 AND 6000 THEN 'pier' END""",
)
def ring_regions(t):
    p = points(t)
    labels = p.filter("id % 40 = 0").select("sheet", c("id").alias("lid"), F.when(c("id") % 3 == 0, "pilecap").otherwise("pier").alias("component"), "x", "y")
    regions = rects(t).filter("id % 120 = 0").select("sheet", F.lit("pilecap").alias("component"), "xmin", "ymin", "xmax", "ymax")
    return G.ring_regions(labels, p.select("sheet", c("id").alias("did"), "x", "y"), regions, "sheet", "lid", "did", 3000.0, 700.0)


@query(
    "search_boxes",
    f"""WITH {RECTS}, l AS (SELECT id, sheet, id%3 AS comp, x, y FROM p), g AS (SELECT sheet, id%2 AS comp, min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax FROM r GROUP BY 1,2)
    SELECT id, round(CASE WHEN g.sheet IS NULL THEN x-4500 ELSE xmin-600 END,3) AS x0, round(CASE WHEN g.sheet IS NULL THEN y-5000 ELSE ymin-600 END,3) AS y0, round(CASE WHEN g.sheet IS NULL THEN x+4500 ELSE xmax+600 END,3) AS x1,
      round(CASE WHEN g.sheet IS NULL THEN y+700 ELSE ymax+600 END,3) AS y1 FROM l LEFT JOIN g USING (sheet, comp)""",
)
def search_boxes(t):
    # Labels of three components; the regions of a sheet are of two of them.
    name = lambda n: F.get(F.array(F.lit("pier"), F.lit("pile"), F.lit("pilecap")), n.cast("int"))
    labels = points(t).select("id", "sheet", name(c("id") % 3).alias("component"), "x", "y")
    regions = rects(t).groupBy("sheet", name(c("id") % 2).alias("component")).agg(*[F.min(n).alias(n) for n in ("xmin", "ymin")], *[F.max(n).alias(n) for n in ("xmax", "ymax")])
    out = G.search_boxes(labels, regions, "sheet", F.lit(1.0))
    return out.select("id", *[F.round(c(n).cast("double"), 3).alias(k) for n, k in (("xmin", "x0"), ("ymin", "y0"), ("xmax", "x1"), ("ymax", "y1"))])


@query(
    "primary_bar",
    """SELECT l_orderkey, l_returnflag, arg_min(l_linenumber, (l_suppkey%3<>0, l_linenumber, l_suppkey, l_partkey)) AS bar_mark FROM lineitem GROUP BY 1,2""",
)
def primary_bar(t):
    marks = t.lineitem.select(
        "l_orderkey", "l_returnflag", c("l_linenumber").alias("bar_mark"), (c("l_suppkey") % 3).alias("spacing_mm"),
        F.struct("l_linenumber", "l_suppkey", "l_partkey").alias("mark_ord"),
    )
    return G.primary_bar(marks, ["l_orderkey", "l_returnflag"])
