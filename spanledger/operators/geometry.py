"""Shapes, dots and dimensions placed on sheets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanledger.functions.geo import clock
from spanledger.plans.durable import durable
from spanledger.plans.grid import close_pairs, clusters_in_reach, greedy_matching, has_within, near_buckets, nearest, nearest_within, points_in_boxes, two_nearest
from spanledger.plans.scan import Neighbour, Running, numbered, ordered_scan

# Fixed values, millimetres: reach of a label, dimension snap, stacked boxes, dot
# radius, margin around a region, box around a label (half width, below, above),
# cluster gap, title margin.
LABEL_REACH = 8000.0
SNAP = 150.0
STACKED = 100.0
DOT_RADIUS = 600.0
REGION_MARGIN = 600.0
LABEL_BOX = (4500.0, 5000.0, 700.0)
CLUSTER_GAP = 2600.0
TITLE_MARGIN = 2000.0


# Filters --------------------------------------------------------------------


def region(df: DataFrame, sheets: DataFrame, key: str, kind: str) -> DataFrame:
    """Texts in one part of the sheet: schedule, title or views."""
    c = F.col
    w, h = c("xmax") - c("xmin"), c("ymax") - c("ymin")
    inside = {
        "schedule": (c("x") >= c("xmin") + 0.30 * w) & ~c("from_block"),
        "title": (c("x") >= c("xmin") + 0.60 * w) & (c("y") <= c("ymin") + 0.30 * h),
        "views": c("x") < c("xmin") + 0.55 * w,
    }[kind]
    return df.join(sheets, key).filter(inside).select(*df.columns)


def notes_window(df: DataFrame, sheets: DataFrame, anchors: DataFrame, key: str) -> DataFrame:
    """Texts around the notes label, or in the views part where a sheet has none.

    ``anchors``: key, ax, ay.
    """
    c = F.col
    j = df.join(sheets, key).join(anchors, key, "left")
    w, h = c("xmax") - c("xmin"), c("ymax") - c("ymin")
    near = (F.abs(c("x") - c("ax")) < 0.40 * w) & (c("y") >= c("ay") - 0.40 * h) & (c("y") <= c("ay") + 5)
    return j.filter(F.when(c("ax").isNull(), c("x") < c("xmin") + 0.55 * w).otherwise(near)).select(*df.columns)


def rebar_layer(layer: Column) -> Column:
    return F.upper(layer).rlike(r"REBAR|REINF|\bBAR\b")


def excluded_layer(layer: Column) -> Column:
    return F.upper(layer).rlike("REINF|REBAR|TEXT|SHAPE_BAR|SHAPE BAR")


def prefer_rebar(shapes: DataFrame, key: str, layer: str) -> DataFrame:
    """Shapes on rebar layers; all shapes of a sheet without such a layer."""
    have = shapes.filter(rebar_layer(F.col(layer))).select(key).distinct().withColumn("__have", F.lit(True))
    return shapes.join(have, key, "left").filter(F.col("__have").isNull() | rebar_layer(F.col(layer))).drop("__have")


def component_by_size(w: Column, h: Column, layer: Column, sheet_w: Column, sheet_h: Column, mm: Column) -> Column:
    """pilecap or pier by outline size; NULL for borders, odd sizes and excluded layers."""
    wm, hm, aspect = w * mm, h * mm, F.try_divide(w, h)
    border = (w > sheet_w * 0.95) & (h > sheet_h * 0.95)
    cap = (aspect > 1.5) & wm.between(1000, 15000) & (hm >= 200)
    pier = aspect.between(0.6, 1.6) & wm.between(300, 6000) & hm.between(300, 6000) & ~excluded_layer(layer)
    return F.when((w > 0) & (h > 0) & ~border, F.when(cap, "pilecap").when(pier, "pier"))


def circular(shapes: DataFrame, key: str, sheets: DataFrame) -> DataFrame:
    """Rings: large circles and nearly round closed outlines, outside the schedule.

    ``sheets``: key, ymin, ymax, mm, and the schedule box sx0, sy0, sx1, sy1 (may be NULL).
    """
    c = F.col
    j = shapes.join(sheets, key)
    least = F.greatest(F.lit(100.0) / c("mm"), (c("ymax") - c("ymin")) * 0.005)
    w, h = c("x1") - c("x0"), c("y1") - c("y0")
    round_ = c("is_closed") & (c("n_points") >= 6) & (F.abs(w - h) / F.greatest(w, h) <= 0.15)
    r = F.when(c("kind") == "circle", c("r")).when(round_, (w + h) / 4)
    x = F.when(c("kind") == "circle", c("x")).otherwise((c("x0") + c("x1")) / 2)
    y = F.when(c("kind") == "circle", c("y")).otherwise((c("y0") + c("y1")) / 2)
    pad = F.lit(500.0) / c("mm")
    inside = x.between(c("sx0") - pad, c("sx1") + pad) & y.between(c("sy0") - pad, c("sy1") + pad)
    out = j.withColumns({"ring_r": r, "ring_x": x, "ring_y": y}).filter((c("ring_r") >= least) & ~F.coalesce(inside, F.lit(False)))
    return out.select(*shapes.columns, "ring_x", "ring_y", "ring_r")


# Labels and boxes -------------------------------------------------------------


def nearest_label(points: DataFrame, labels: DataFrame, key: str, pid: str, reach: float = LABEL_REACH) -> DataFrame:
    """The view type of the nearest label; ``unplaced`` beyond the reach, NULL on a sheet without labels."""
    hit = nearest_within(points, labels, [key], pid, reach, ["view_type"], "ord")
    any_ = labels.select(key).distinct().withColumn("__any", F.lit(True))
    return hit.join(any_, key, "left").withColumn(
        "view_type", F.when(F.col("__any"), F.coalesce("view_type", F.lit("unplaced")))
    ).drop("__any")


def search_boxes(labels: DataFrame, regions: DataFrame, key: str, mm: Column) -> DataFrame:
    """Where to look for a section's dots: its component's region with a margin,
    else a fixed box around its label. ``regions``: key, component, xmin..ymax."""
    c = F.col
    j = labels.join(regions.withColumn("__r", F.lit(True)), [key, "component"], "left")
    m, (dx, below, above) = F.lit(REGION_MARGIN) / mm, [F.lit(v) / mm for v in LABEL_BOX]
    pick = lambda a, b: F.when(c("__r"), a).otherwise(b)
    return j.select(
        *labels.columns,
        pick(c("xmin") - m, c("x") - dx).alias("xmin"), pick(c("ymin") - m, c("y") - below).alias("ymin"),
        pick(c("xmax") + m, c("x") + dx).alias("xmax"), pick(c("ymax") + m, c("y") + above).alias("ymax"),
    )


def dots_in_boxes(dots: DataFrame, boxes: DataFrame, key: str, box: str) -> DataFrame:
    """Dots inside each box; block dots if there are at least four, else small circles."""
    inside = points_in_boxes(dots, boxes.select(key, box, "xmin", "ymin", "xmax", "ymax"), [key])
    blocks = inside.filter("source = 'block'").groupBy(key, box).agg(F.count(F.lit(1)).alias("__b"))
    j = inside.join(blocks, [key, box], "left")
    use = F.coalesce(F.col("__b"), F.lit(0)) >= 4
    wanted = F.when(use, F.col("source") == "block").otherwise((F.col("source") == "circle") & (F.col("r") <= DOT_RADIUS))
    return j.filter(wanted).drop("__b", "xmin", "ymin", "xmax", "ymax")


def suppress_nested(boxes: DataFrame, keys: list[str], bid: str, tol: float = STACKED) -> DataFrame:
    """Drop a box within the x-range of a wider one that it touches from above or below."""
    c = F.col
    wide = boxes.select(
        *keys, c("xmin").alias("ox0"), c("xmax").alias("ox1"), (c("xmax") - c("xmin")).alias("ow"),
        F.explode(F.array(F.struct(F.lit("t").alias("side"), c("ymax").alias("e")), F.struct(F.lit("b").alias("side"), c("ymin").alias("e")))).alias("o"),
    ).select(*keys, "ox0", "ox1", "ow", "o.*").withColumn("bucket", F.floor(c("e") / tol))
    own = boxes.select(
        *keys, bid, "xmin", "xmax",
        F.explode(F.array(F.struct(F.lit("t").alias("side"), c("ymin").alias("v")), F.struct(F.lit("b").alias("side"), c("ymax").alias("v")))).alias("s"),
    ).select(*keys, bid, "xmin", "xmax", "s.*").withColumn("bucket", F.explode(near_buckets(c("v"), tol)))
    hit = own.join(wide, [*keys, "side", "bucket"]).filter(
        (F.abs(c("v") - c("e")) <= tol) & (c("ow") > c("xmax") - c("xmin")) & (c("ox0") - tol <= c("xmin")) & (c("xmax") <= c("ox1") + tol)
    )
    return boxes.join(hit.select(*keys, bid).distinct(), [*keys, bid], "left_anti")


def unlabeled_views(clusters: DataFrame, titles: DataFrame, keys: list[str], cid: str, margin: float = TITLE_MARGIN) -> DataFrame:
    """Cluster boxes with no title inside the box widened by the margin."""
    c = F.col
    wide = clusters.select(*keys, cid, (c("xmin") - margin).alias("xmin"), (c("ymin") - margin).alias("ymin"), (c("xmax") + margin).alias("xmax"), (c("ymax") + margin).alias("ymax"))
    titled = points_in_boxes(titles.select(*keys, "x", "y"), wide, keys).select(*keys, cid).distinct()
    return clusters.join(titled, [*keys, cid], "left_anti")


# Dimensions -------------------------------------------------------------------


def pile_groups(piles: DataFrame, keys: list[str], x: str, pid: str, tol: float) -> DataFrame:
    """Pile positions chained by gaps of at most ``tol``: key, group_no, centre."""
    grouped = gap_groups(piles, keys, x, pid, tol)
    return grouped.groupBy(*keys, "group_no").agg(F.avg(x).alias("centre"))


def gap_groups(rows: DataFrame, keys: list[str], value: str, tie: str, tol: float) -> DataFrame:
    """Number runs of values: a new one starts where the step from the last exceeds ``tol``."""
    stepped = ordered_scan(rows, keys, [value, tie], {"__prev": Neighbour(value)})
    flag = F.when(F.col("__prev").isNull() | (F.col(value) - F.col("__prev") > tol), 1).otherwise(0)
    return ordered_scan(stepped.withColumn("__new", flag), keys, [value, tie], {"group_no": Running("sum", "__new")}).drop("__prev", "__new")


def snap_dimensions(dims: DataFrame, regions: DataFrame, key: str, tol: float = SNAP, bundle: float = 800.0) -> DataFrame:
    """Name each dimension by the region edges its ends meet.

    ``dims``: key, dim, orient (H or V), lo, hi, val_mm. ``regions``: key, rid, kind,
    xmin..ymax, ordered by rid. The names in order of precedence: depth, width and
    overall length of the first pilecap that fits, pier plan, pile spacing, pile
    overhang, pile diameter. One reading per (param, region): the first dimension.
    """
    c = F.col
    caps, piers, piles = (regions.filter(c("kind") == k) for k in ("pilecap", "pier", "pile"))

    def meet(d: DataFrame, edges: DataFrame) -> DataFrame:
        """Dimensions whose low end is near ``lo_e`` and high end near ``hi_e``."""
        left = d.withColumn("b", F.explode(near_buckets(c("lo"), tol)))
        right = edges.withColumn("b", F.floor(c("lo_e") / tol).cast("long"))
        return left.join(right, [key, "b"]).filter((F.abs(c("lo") - c("lo_e")) <= tol) & (F.abs(c("hi") - c("hi_e")) <= tol)).drop("b")

    def edges(r: DataFrame, lo: str, hi: str) -> DataFrame:
        return r.select(key, "rid", c(lo).alias("lo_e"), c(hi).alias("hi_e"))

    h, v = dims.filter("orient = 'H'"), dims.filter("orient = 'V'")
    named = lambda df, param, prio, sub=0: df.select(key, "dim", F.lit(param).alias("param"), "rid", F.lit(prio).alias("prio"), F.lit(sub).alias("sub"))

    # The first pilecap narrower than the dimension: a running minimum over widths.
    width = caps.select(key, ((c("xmax") - c("xmin")) * 1.05).alias("len"), c("rid").alias("cap"), F.lit(0).alias("is_dim"), F.lit(None).cast(dims.schema["dim"].dataType).alias("dim"))
    probe = h.select(key, (c("hi") - c("lo")).alias("len"), F.lit(None).cast(regions.schema["rid"].dataType).alias("cap"), F.lit(-1).alias("is_dim"), "dim")
    line = width.unionByName(probe).withColumn("tie", F.coalesce("dim", "cap"))
    overall = ordered_scan(line, [key], ["len", "is_dim", "tie"], {"rid": Running("min", "cap")}).filter("is_dim = -1 AND rid IS NOT NULL")

    centres = pile_groups(piles.withColumn("cx", (c("xmin") + c("xmax")) / 2), [key], "cx", "rid", bundle)
    side = lambda end: (
        h.withColumn("b", F.explode(near_buckets(c(end), tol)))
        .join(centres.withColumn("b", F.floor(c("centre") / tol).cast("long")), [key, "b"])
        .filter(F.abs(c(end) - c("centre")) <= tol)
    )
    lo_g = side("lo").groupBy(key, "dim").agg(F.min("group_no").alias("g1"))
    hi_g = side("hi").groupBy(key, "dim").agg(F.max("group_no").alias("g2"))
    spacing = lo_g.join(hi_g, [key, "dim"]).filter("g1 < g2").withColumn("rid", F.lit(-1).cast(regions.schema["rid"].dataType))
    several = piles.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select(key)
    outer = centres.groupBy(key).agg(F.min("centre").alias("gl"), F.max("centre").alias("gr")).join(several, key, "left_semi")
    hang = caps.join(outer, key).select(key, "rid", F.inline(F.array(
        F.struct(c("gr").alias("lo_e"), c("xmax").alias("hi_e")), F.struct(c("xmin").alias("lo_e"), c("gl").alias("hi_e")),
    )))

    options = [
        named(meet(v, edges(caps, "ymin", "ymax")), "pilecap_depth", 0),
        named(meet(h, edges(caps, "xmin", "xmax")), "pilecap_width", 0, 0),
        named(overall, "pilecap_length_overall", 0, 1),
        named(meet(h, edges(piers, "xmin", "xmax")), "pier_plan_dim", 1),
        named(spacing.join(several, key, "left_semi"), "pile_spacing", 2),
        named(meet(h, hang), "pile_overhang", 3),
        named(meet(v, edges(piles, "ymin", "ymax")), "pile_dia", 4),
    ]
    found = options[0]
    for o in options[1:]:
        found = found.unionByName(o)
    best = found.groupBy(key, "dim").agg(F.min_by(F.struct("param", "rid"), F.struct("prio", "rid", "sub")).alias("b")).select(key, "dim", "b.*")
    return best.groupBy(key, "param", "rid").agg(F.min("dim").alias("dim")).join(dims.select(key, "dim", "val_mm"), [key, "dim"])


# Dots -------------------------------------------------------------------------


def upper_median_of(rows: DataFrame, keys: list[str], value: str, tie: str, name: str) -> DataFrame:
    """The upper median of each key, by position instead of a collected list."""
    placed = numbered(rows.select(*keys, value, tie), keys, [value, tie], "__p")
    sizes = rows.groupBy(*keys).agg(F.count(value).alias("__n"))
    return placed.join(sizes, keys).filter(F.col("__p") == F.floor(F.col("__n") / 2) + 1).select(*keys, F.col(value).alias(name))


def ring_spacing(points: DataFrame, keys: list[str], pid: str) -> DataFrame:
    """Every step of the ring around the centroid with its chord, ratio and verdict.

    The points of a key are ordered by angle; the last step leads back to the first
    point. Chords above 1.3 times the upper median are gaps, below 0.4 clusterings.
    Keys with fewer than four points have no steps.
    """
    c = F.col
    centre = points.groupBy(*keys).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count(F.lit(1)).alias("n")).filter("n >= 4")
    p = points.select(*keys, pid, "x", "y").join(centre, keys).withColumn("angle", F.atan2(c("y") - c("cy"), c("x") - c("cx")))
    here = F.struct("x", "y", pid)
    step = ordered_scan(p, keys, ["angle", pid], {"__next": Neighbour(here, 1)})
    first = p.groupBy(*keys).agg(F.min_by(here, F.struct("angle", pid)).alias("__first"))
    ring = step.join(first, keys).withColumn("nxt", F.coalesce("__next", "__first"))
    ring = ring.withColumn("chord", F.sqrt((c("nxt.x") - c("x")) ** 2 + (c("nxt.y") - c("y")) ** 2))
    median = upper_median_of(ring, keys, "chord", pid, "median").filter("median > 0")
    ratio = c("chord") / c("median")
    mid = F.atan2((c("y") + c("nxt.y")) / 2 - c("cy"), (c("x") + c("nxt.x")) / 2 - c("cx"))
    return ring.join(median, keys).select(
        *keys, pid, c(f"nxt.{pid}").alias("next_id"), "n", "chord", "median", ratio.alias("ratio"),
        F.when(ratio > 1.3, "gap").when(ratio < 0.4, "clustering").alias("kind"),
        mid.alias("angle_rad"), clock(mid).alias("clock"),
    )


def spacing_issues(ring: DataFrame, keys: list[str]) -> DataFrame:
    """Irregular steps of reliable rings: eight or more points with over a quarter odd are not one ring."""
    odd = ring.groupBy(*keys).agg(F.count("kind").alias("__odd"), F.max("n").alias("__n"))
    sound = odd.filter(~((F.col("__n") >= 8) & (F.col("__odd") > F.col("__n") * 0.25))).select(*keys)
    return ring.filter("kind IS NOT NULL").join(sound, keys, "left_semi")


def bundles(points: DataFrame, keys: list[str], pid: str) -> DataFrame:
    """Whether the dots of each key come in touching pairs.

    True where 70 % of the dots are mutual nearest neighbours and the upper median
    of nearest to second-nearest distance is below 0.6.
    """
    c = F.col
    nn = two_nearest(points, keys, pid)
    back = nn.select(*keys, c(pid).alias("n1"), c("n1").alias("__back"))
    j = nn.join(back, [*keys, "n1"], "left").withColumn("mutual", c("__back") == c(pid))
    g = j.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if("mutual").alias("mutual"))
    ratios = j.filter("d2 > 0").withColumn("ratio", c("d1") / c("d2"))
    median = upper_median_of(ratios, keys, "ratio", pid, "ratio")
    paired = (c("n") >= 4) & (c("mutual") >= c("n") * 0.7) & (c("ratio") < 0.6)
    return g.join(median, keys, "left").withColumn("is_bundle", F.coalesce(paired, F.lit(False)))


def collapse_pairs(points: DataFrame, keys: list[str], pid: str) -> DataFrame:
    """Close pairs as one unit at their middle, other dots as they are.

    Pairs are taken by ascending distance up to 2.5 times the key's smallest one.
    Keys with fewer than four dots pass unchanged. Returns key, first_id, other_id, x, y.
    """
    c = F.col
    sizes = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    smallest = two_nearest(points, keys, pid).groupBy(*keys).agg((F.min("d1") * 2.5).alias("radius"))
    big = points.join(sizes.filter("n >= 4"), keys, "left_semi").join(smallest, keys)
    pairs = close_pairs(big, keys, pid, "radius")
    taken = greedy_matching(pairs, keys, ["d"])
    merged = taken.select(*keys, c("a").alias("first_id"), c("b").alias("other_id"), ((c("ax") + c("bx")) / 2).alias("x"), ((c("ay") + c("by")) / 2).alias("y"))
    used = taken.select(*keys, F.explode(F.array("a", "b")).alias(pid))
    single = points.join(used, [*keys, pid], "left_anti").select(*keys, c(pid).alias("first_id"), F.lit(None).cast(points.schema[pid].dataType).alias("other_id"), "x", "y")
    return merged.unionByName(single)


def primary_bar(marks: DataFrame, keys: list[str]) -> DataFrame:
    """The mark a section shows: the first without spacing, else the first."""
    spaced = F.coalesce(F.col("spacing_mm") != 0, F.lit(False))
    return marks.groupBy(*keys).agg(F.min_by("bar_mark", F.struct(spaced, "mark_ord")).alias("bar_mark"))


def ring_regions(labels: DataFrame, dots: DataFrame, regions: DataFrame, key: str, lid: str, did: str, reach: float = LABEL_REACH, gap: float = CLUSTER_GAP) -> DataFrame:
    """Regions from rings of at least eight dots near a section label that has none.

    ``labels``: key, lid, component, x, y. Dots belong to clusters of the whole sheet
    part within reach of the label; the cluster nearest the label counts if its box
    has the component's size.
    """
    c = F.col
    mid = regions.select(key, "component", ((c("xmin") + c("xmax")) / 2).alias("x"), ((c("ymin") + c("ymax")) / 2).alias("y"))
    taken = has_within(labels, mid, [key, "component"], lid, reach)
    free = durable(labels.join(taken.select(key, lid), [key, lid], "left_anti").select(key, lid, "component", c("x").alias("lx"), c("y").alias("ly")))
    # A dot within reach of several labels takes part once for each.
    clusters = clusters_in_reach(dots, free, [key], did, lid, reach, gap).filter("n >= 8")
    g = clusters.withColumnRenamed("n", "dots").join(free, [key, lid])
    best = g.groupBy(key, lid, "component").agg(
        F.min_by(F.struct("xmin", "ymin", "xmax", "ymax", "dots"), F.struct((c("mx") - c("lx")) ** 2 + (c("my") - c("ly")) ** 2, -c("dots"), c("cluster"))).alias("b")
    ).select(key, lid, "component", "b.*")
    w, h = c("xmax") - c("xmin"), c("ymax") - c("ymin")
    kind = component_by_size(w, h, F.lit(""), F.lit(math.inf), F.lit(math.inf), F.lit(1.0))
    return best.filter(kind == c("component"))


def cut_mark_component(marks: DataFrame, labels: DataFrame, caps: DataFrame, key: str, start: float) -> DataFrame:
    """The component of unqualified section letters, by majority of their cut marks.

    Labels and pilecaps count at any distance; the search begins within ``start``.
    A sheet without a pilecap gives no result.

    ``marks``: key, mid, letter, x, y; ``labels``: qualified labels key, ord, x, y,
    components (array); ``caps``: pilecap boxes with ord. A mark takes the
    components of its nearest label. With several, its height against the pilecap
    nearest in x decides: above it the pier, beside it the pilecap.
    """
    c = F.col
    marks = marks.join(caps.select(key).distinct(), key, "left_semi")
    hit = nearest(marks, labels, [key], "mid", start, ["components"], "ord")
    flat = caps.select(key, "ord", ((c("xmin") + c("xmax")) / 2).alias("x"), F.lit(0.0).alias("y"), "ymin", "ymax")
    many = hit.filter("size(components) > 1 AND array_contains(components, 'pilecap')").select(key, "mid", "letter", "components", "x", c("y").alias("my"), F.lit(0.0).alias("y"))
    cap = nearest(many, flat, [key], "mid", start, ["ymin", "ymax"], "ord")
    vote = F.when((c("my") > c("ymax")) & F.array_contains("components", "pier"), "pier").when(c("my").between(c("ymin"), c("ymax")), "pilecap")
    single = hit.filter("size(components) = 1").select(key, "mid", "letter", F.get("components", 0).alias("vote"))
    votes = single.unionByName(cap.select(key, "mid", "letter", vote.alias("vote"))).filter("vote IS NOT NULL")
    return majority(votes, [key, "letter"], "vote", "mid")


def majority(votes: DataFrame, keys: list[str], vote: str, order: str) -> DataFrame:
    """The most frequent vote of each key, the one cast first on ties."""
    g = votes.groupBy(*keys, vote).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    return g.groupBy(*keys).agg(F.max_by(vote, F.struct("n", -F.col("first"))).alias(vote), F.max("n").alias("n"))
