"""Joins by place: cells of a grid turn distance tests into equi-joins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanledger.plans.durable import durable
from spanledger.plans.scan import Neighbour, numbered, ordered_scan


def _aside(df: DataFrame, keys: list[str], pid: str | None = None) -> tuple[DataFrame, list[str], dict[str, str]]:
    """``df`` with its key columns (and ``pid``) under reserved names, and how to undo that.

    What a plan calls its own columns then never meets a caller's name.
    """
    names = {k: f"__key{i}" for i, k in enumerate(keys)} | ({pid: "__pid"} if pid else {})
    return df.withColumnsRenamed(names), [names[k] for k in keys], {v: k for k, v in names.items()}


def cell(v: Column | str, size: Column | float) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    return F.floor(v / size).cast("long")


def _shifts(reach: int) -> Column:
    steps = range(-reach, reach + 1)
    return F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in steps for j in steps])


def around(df: DataFrame, x: str, y: str, size: Column | float, reach: int = 1) -> DataFrame:
    """One row per cell of the neighbourhood of each row's own cell."""
    return (
        df.withColumn("__s", F.explode(_shifts(reach)))
        .withColumn("__cx", cell(x, size) + F.col("__s.i"))
        .withColumn("__cy", cell(y, size) + F.col("__s.j"))
        .drop("__s")
    )


def near_buckets(v: Column, tol: Column | float) -> Column:
    """The three buckets in which a value within ``tol`` may lie."""
    b = F.floor(v / tol).cast("long")
    return F.array(b - 1, b, b + 1)


def points_in_boxes(points: DataFrame, boxes: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Points joined with the boxes that hold them (edges included).

    A box lies in the grid whose cells are just as large as its longer side, so it
    touches at most four cells; a point looks into its own cell of every grid size in
    use. The sizes are powers of two, so there are few of them. ``boxes`` has
    xmin, ymin, xmax, ymax.
    """
    side = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"))
    level = F.when(side <= 2.0**-40, -40).otherwise(F.ceil(F.log2(side)).cast("int"))
    sized = boxes.withColumn("__level", level)
    size = F.pow(F.lit(2.0), F.col("__level"))
    span = lambda lo, hi: F.sequence(cell(lo, size), cell(hi, size))
    placed = (
        sized.withColumn("__cx", F.explode(span("xmin", "xmax")))
        .withColumn("__cy", F.explode(span("ymin", "ymax")))
    )
    levels = sized.agg(F.collect_set("__level")).scalar()
    looking = (
        points.withColumn("__levels", levels)
        .withColumn("__level", F.explode("__levels"))
        .drop("__levels")
        .withColumn("__cx", cell(x, size))
        .withColumn("__cy", cell(y, size))
    )
    j = looking.join(placed, [*keys, "__level", "__cx", "__cy"])
    inside = F.col(x).between(F.col("xmin"), F.col("xmax")) & F.col(y).between(F.col("ymin"), F.col("ymax"))
    return j.filter(inside).drop("__level", "__cx", "__cy")


def nearest_within(points: DataFrame, anchors: DataFrame, keys: list[str], pid: str, max_dist: float, carry: list[str], order: str, fine: int = 8) -> DataFrame:
    """The nearest anchor of each point within ``max_dist``; ties go to the lower ``order``.

    Points first look into cells of an eighth of the distance. Only those that find
    nothing there look into cells of the full distance, so that crowded anchors are
    met at close range only. ``points`` and ``anchors`` have x and y; the anchor's
    ``carry`` columns and ``dist`` are NULL where there is none.
    """
    a = anchors.select(*keys, F.col("x").alias("__ax"), F.col("y").alias("__ay"), F.col(order).alias("__ao"), *[F.col(c).alias(f"__a_{c}") for c in carry])

    def look(p: DataFrame, size: float) -> DataFrame:
        placed = p.withColumns({"__cx": cell("x", size), "__cy": cell("y", size)})
        d2 = (F.col("x") - F.col("__ax")) ** 2 + (F.col("y") - F.col("__ay")) ** 2
        hits = placed.join(around(a, "__ax", "__ay", size), [*keys, "__cx", "__cy"]).withColumn("__d2", d2).filter(F.col("__d2") <= size * size)
        best = hits.groupBy(*keys, pid).agg(
            F.min_by(F.struct(F.sqrt("__d2").alias("dist"), *[F.col(f"__a_{c}").alias(c) for c in carry]), F.struct("__d2", "__ao")).alias("__best")
        )
        return p.join(best, [*keys, pid], "left")

    first = durable(look(points, max_dist / fine))
    found = first.filter("__best IS NOT NULL")
    rest = look(first.filter("__best IS NULL").drop("__best"), max_dist)
    return found.unionByName(rest).select(*points.columns, "__best.*")


def nearest(points: DataFrame, anchors: DataFrame, keys: list[str], pid: str, start: float, carry: list[str], order: str) -> DataFrame:
    """The nearest anchor of each point of a key that has anchors, however far it is.

    Points look within ``start`` first; those that find nothing look twice as far,
    again and again, so the rounds follow the logarithm of the largest distance.
    """
    anchors = durable(anchors)
    open_ = durable(points.join(anchors.select(*keys).distinct(), keys, "left_semi"))
    reach, done = start, None
    while True:
        seen = durable(nearest_within(open_, anchors, keys, pid, reach, carry, order))
        found = seen.filter("dist IS NOT NULL")
        done = found if done is None else done.unionByName(found)
        open_ = seen.filter("dist IS NULL").select(*points.columns)
        if open_.isEmpty():
            return done
        reach *= 2


#: How far the second cell of a linked pair lies from the first.
HALF = [(i, j) for i in range(0, 3) for j in range(-2, 3) if (i, j) > (0, 0)]


def node_size(gap: float) -> float:
    """The side of cells whose points are all within ``gap`` of each other."""
    return gap / 1.4143


def cell_links(points: DataFrame, keys: list[str], gap: float, pid: str, levels: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Points with their cells, the cells, and the cell pairs that hold a pair of points within ``gap``.

    All points of one cell are within the gap of each other, so that a cell is one
    node however many points it holds. Whether two cells are linked follows from the
    boxes around their points where these are clearly near or far. Undecided pairs
    are split into quarter cells and looked at again; only what is still open after
    the last level compares points. Pairs are (a_nx, a_ny, b_nx, b_ny), b being one of
    ``HALF`` away from a.
    """
    size = node_size(gap)
    cut = points.select(*keys, pid, "x", "y")
    for level in range(levels + 1):
        s = size / 2**level
        cut = cut.withColumns({f"__x{level}": cell("x", s), f"__y{level}": cell("y", s)})
    cut = cut.withColumn("node", F.struct(F.col("__x0").alias("x"), F.col("__y0").alias("y")))

    def boxes(level: int) -> DataFrame:
        sub = [f"__x{level}", f"__y{level}"]
        return cut.groupBy(*keys, *sub).agg(
            F.min(pid).alias("first"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"),
            F.first("__x0").alias("nx"), F.first("__y0").alias("ny"),
        ).withColumnsRenamed({sub[0]: "cx", sub[1]: "cy"})

    def sides(b: DataFrame, p: str) -> DataFrame:
        return b.select(*keys, *[F.col(c).alias(f"{p}_{c}") for c in ("cx", "cy", "x0", "x1", "y0", "y1", "nx", "ny")])

    def judged(pairs: DataFrame) -> DataFrame:
        c = F.col
        dx = F.greatest(c("b_x0") - c("a_x1"), c("a_x0") - c("b_x1"), F.lit(0.0))
        dy = F.greatest(c("b_y0") - c("a_y1"), c("a_y0") - c("b_y1"), F.lit(0.0))
        fx = F.greatest(c("b_x1") - c("a_x0"), c("a_x1") - c("b_x0"))
        fy = F.greatest(c("b_y1") - c("a_y0"), c("a_y1") - c("b_y0"))
        return pairs.filter(dx * dx + dy * dy <= gap * gap).withColumn("sure", fx * fx + fy * fy <= gap * gap)

    top = boxes(0)
    shifts = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in HALF])
    left = sides(top, "a").withColumn("s", F.explode(shifts))
    left = left.withColumns({"b_cx": F.col("a_cx") + F.col("s.i"), "b_cy": F.col("a_cy") + F.col("s.j")}).drop("s")
    state = judged(left.join(sides(top, "b"), [*keys, "b_cx", "b_cy"]))
    node_pair = ["a_nx", "a_ny", "b_nx", "b_ny"]
    links = []
    for level in range(1, levels + 1):
        state = durable(state)
        links.append(state.filter("sure").select(*keys, *node_pair))
        known = state.filter("sure").select(*keys, *node_pair).distinct()
        open_ = state.filter("NOT sure").join(known, [*keys, *node_pair], "left_anti").select(*keys, "a_cx", "a_cy", "b_cx", "b_cy")
        quarter = boxes(level)
        up = lambda p: {f"{p}_px": F.floor(F.col(f"{p}_cx") / 2), f"{p}_py": F.floor(F.col(f"{p}_cy") / 2)}
        a, b = sides(quarter, "a").withColumns(up("a")), sides(quarter, "b").withColumns(up("b"))
        o = open_.withColumnsRenamed({f"{p}_c{d}": f"{p}_p{d}" for p in "ab" for d in "xy"})
        state = judged(
            o.join(a, [*keys, "a_px", "a_py"]).join(b, [*keys, "b_px", "b_py"]).drop("a_px", "a_py", "b_px", "b_py")
        )
    state = durable(state)
    links.append(state.filter("sure").select(*keys, *node_pair))
    known = state.filter("sure").select(*keys, *node_pair).distinct()
    open_ = state.filter("NOT sure").join(known, [*keys, *node_pair], "left_anti").select(*keys, *node_pair, "a_cx", "a_cy", "b_cx", "b_cy")
    last = [f"__x{levels}", f"__y{levels}"]
    p = lambda s: cut.select(*keys, *[F.col(l).alias(f"{s}_c{d}") for l, d in zip(last, "xy")], F.col("x").alias(f"{s}x"), F.col("y").alias(f"{s}y")).distinct()
    near = (F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2 <= gap * gap
    links.append(
        open_.join(p("a"), [*keys, "a_cx", "a_cy"]).join(p("b"), [*keys, "b_cx", "b_cy"]).filter(near).select(*keys, *node_pair)
    )
    edges = links[0]
    for e in links[1:]:
        edges = edges.unionByName(e)
    return cut, top, edges.distinct()


def linked_cells(points: DataFrame, keys: list[str], gap: float, pid: str) -> tuple[DataFrame, DataFrame]:
    """Points as members of cells that are named by their first point, and the links of these cells."""
    cut, top, edges = cell_links(points, keys, gap, pid)
    ids = top.select(*keys, F.struct(F.col("nx").alias("x"), F.col("ny").alias("y")).alias("node"), F.col("first").alias("node_id"))
    node = lambda s: F.struct(F.col(f"{s}_nx").alias("x"), F.col(f"{s}_ny").alias("y"))
    named = (
        edges.select(*keys, node("a").alias("a"), node("b").alias("b"))
        .join(ids.select(*keys, F.col("node").alias("a"), F.col("node_id").alias("u")), [*keys, "a"])
        .join(ids.select(*keys, F.col("node").alias("b"), F.col("node_id").alias("v")), [*keys, "b"])
        .select("u", "v")
    )
    members = cut.join(ids, [*keys, "node"]).select(*keys, pid, "node_id")
    return members, named


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Connected components: (node_id, root), the root being the smallest node id.

    Each round takes the smallest label among the neighbours and then jumps to that
    label's own label, until nothing changes. Rounds are cut by a checkpoint, so a
    lost executor repeats one round at most.
    """
    both = durable(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = durable(nodes.select("node_id", F.col("node_id").alias("root")).distinct())
    while True:
        near = both.join(labels.withColumnRenamed("node_id", "v"), "v").groupBy(F.col("u").alias("node_id")).agg(F.min("root").alias("other"))
        step = labels.join(near, "node_id", "left").select("node_id", F.col("root").alias("old"), F.least("root", F.coalesce("other", "root")).alias("root"))
        jump = step.select(F.col("node_id").alias("root"), F.col("root").alias("further"))
        moved = step.join(jump, "root", "left").select("node_id", "old", F.coalesce("further", "root").alias("root"))
        moved = durable(moved)
        labels = moved.select("node_id", "root")
        if moved.filter("old <> root").isEmpty():
            return labels


def gap_clusters(points: DataFrame, keys: list[str], gap: float, pid: str) -> DataFrame:
    """Clusters of points chained by steps of at most ``gap``.

    Adds the cluster's first point, its size, and its rank within the key, the
    largest first and the earlier first point on ties. ``pid`` is unique over all
    keys and gives the point order.
    """
    points, inner, back = _aside(points.select(*keys, pid, "x", "y"), keys, pid)
    members, links = linked_cells(points, inner, gap, "__pid")
    members = durable(members)
    roots = components(members, links)
    tagged = members.join(roots, "node_id").select(*inner, "__pid", F.col("root").alias("cluster"))
    sizes = tagged.groupBy(*inner, "cluster").agg(F.count(F.lit(1)).alias("size"))
    ranked = numbered(sizes.withColumn("__n", -F.col("size")), inner, ["__n", "cluster"], "cluster_rank").drop("__n")
    return tagged.join(ranked, [*inner, "cluster"]).withColumnsRenamed(back)


def cells_in_reach(centres: DataFrame, cells: DataFrame, keys: list[str], reach: float, size: float) -> DataFrame:
    """Centres (lx, ly) joined with the cells that may hold points closer than ``reach``.

    ``cells`` have the box x0, y0, x1, y1 around their points, no longer than ``size``.
    ``whole`` tells that all points of a cell are closer.
    """
    c = F.col
    step = reach + 2 * size
    looking = around(centres.withColumnsRenamed({"lx": "__lx", "ly": "__ly"}), "__lx", "__ly", step).withColumnsRenamed({"__cx": "__gx", "__cy": "__gy", "__lx": "lx", "__ly": "ly"})
    placed = cells.withColumns({"__gx": cell("x0", step), "__gy": cell("y0", step)})
    dx, dy = (F.greatest(c(f"{d}0") - c(f"l{d}"), c(f"l{d}") - c(f"{d}1"), F.lit(0.0)) for d in "xy")
    fx, fy = (F.greatest(c(f"l{d}") - c(f"{d}0"), c(f"{d}1") - c(f"l{d}")) for d in "xy")
    j = looking.join(placed, [*keys, "__gx", "__gy"]).drop("__gx", "__gy").filter(dx * dx + dy * dy < reach * reach)
    return j.withColumn("whole", fx * fx + fy * fy < reach * reach)


def has_within(points: DataFrame, anchors: DataFrame, keys: list[str], pid: str, reach: float) -> DataFrame:
    """The points (keys, pid) with an anchor closer than ``reach``.

    Anchors are met as cells; only those of a cell that is neither near nor far as a
    whole are compared themselves, by points that have no near cell.
    """
    c = F.col
    points, inner, back = _aside(points.select(*keys, pid, c("x").alias("lx"), c("y").alias("ly")), keys, pid)
    anchors = anchors.select(*[c(k).alias(i) for k, i in zip(keys, inner)], "x", "y")
    size = reach / 8
    anchors = anchors.withColumns({"__cx": cell("x", size), "__cy": cell("y", size)})
    boxes = anchors.groupBy(*inner, "__cx", "__cy").agg(*[f(v).alias(f"{v}{n}") for v in "xy" for f, n in ((F.min, 0), (F.max, 1))])
    # The cells keep names of their own, as the centres' are those of the wider grid.
    seen = durable(cells_in_reach(points, boxes.withColumnsRenamed({"__cx": "nx", "__cy": "ny"}), inner, reach, size))
    sure = seen.filter("whole").select(*inner, "__pid").distinct()
    open_ = seen.filter("NOT whole").join(sure, [*inner, "__pid"], "left_anti").select(*inner, "__pid", "lx", "ly", c("nx").alias("__cx"), c("ny").alias("__cy"))
    d2 = (c("x") - c("lx")) * (c("x") - c("lx")) + (c("y") - c("ly")) * (c("y") - c("ly"))
    more = open_.join(anchors, [*inner, "__cx", "__cy"]).filter(d2 < reach * reach).select(*inner, "__pid").distinct()
    return sure.unionByName(more).withColumnsRenamed(back)


def _parts(keys: list[str], gap: float):
    """Which cells of one centre hang together, and by which pairs others may, as a function of its cells.

    A cell that lies whole within reach is linked to another such one just as on the
    whole sheet. Of a cut one the box around the points left tells: the two points that
    face each other are no farther apart than their distance along one axis and the
    extent of both boxes along the other.
    """
    limit = gap * gap

    def parts(df):
        n = len(df)
        cx, cy, links, whole = (df[v].to_numpy() for v in ("nx", "ny", "links", "whole"))
        x0, x1, y0, y1 = (df[v].to_numpy() for v in ("x0", "x1", "y0", "y1"))
        at = {p: i for i, p in enumerate(zip(cx.tolist(), cy.tolist()))}
        pairs = [(i, at[q], s) for p, i in at.items() for s, (h, k) in enumerate(HALF) if (q := (p[0] + h, p[1] + k)) in at and links[i] >> s & 1]
        part = list(range(n))

        def root(i):
            while part[i] != i:
                part[i] = part[part[i]]
                i = part[i]
            return i

        open_ = []
        if pairs:
            a, b, s = np.array(pairs).T
            fx, fy = np.maximum(x1[b] - x0[a], x1[a] - x0[b]), np.maximum(y1[b] - y0[a], y1[a] - y0[b])
            facing = [(x0[b] - x1[a], fy), (x0[a] - x1[b], fy), (y0[b] - y1[a], fx), (y0[a] - y1[b], fx)]
            sure = whole[a] & whole[b]
            for d, f in facing:
                sure |= d * d + f * f <= limit
            dx, dy = np.maximum(np.maximum(x0[b] - x1[a], x0[a] - x1[b]), 0), np.maximum(np.maximum(y0[b] - y1[a], y0[a] - y1[b]), 0)
            maybe = ~sure & (dx * dx + dy * dy <= limit)
            for i, j in zip(a[sure].tolist(), b[sure].tolist()):
                i, j = root(i), root(j)
                part[max(i, j)] = min(i, j)
            open_ = list(zip(a[maybe].tolist(), s[maybe].tolist(), b[maybe].tolist()))
        out = df[[*keys, "nx", "ny"]].copy()
        out["part"] = [root(i) for i in range(n)]
        asks = [[] for _ in range(n)]
        for i, s, j in open_:
            if root(i) != root(j):
                asks[i].append((s, root(j)))
        out["asks"] = [[{"s": s, "other": o} for s, o in a] for a in asks]
        return out

    return parts


def clusters_in_reach(points: DataFrame, centres: DataFrame, keys: list[str], pid: str, cid: str, reach: float, gap: float) -> DataFrame:
    """Clusters, by steps of at most ``gap``, of the points closer to each centre than ``reach``.

    Per cluster of a centre: keys, cid, cluster (the first point), n, the mean mx, my
    and the box xmin, ymin, xmax, ymax. ``centres`` have lx and ly. A cell that lies whole
    within reach stands for its points; those of a cut one are summed up where
    they are met. So rows go with the centres, not with the points around them.
    """
    c = F.col
    points, inner, back = _aside(points.filter("x IS NOT NULL AND y IS NOT NULL").select(*keys, pid, "x", "y"), keys, pid)
    centres = centres.select(*[c(k).alias(i) for k, i in zip(keys, inner)], c(cid).alias("__cid"), "lx", "ly")
    cut, _, pairs = cell_links(points, inner, gap, "__pid")
    one = [*inner, "__cid"]
    node = [*inner, "nx", "ny"]
    dots = cut.select(*inner, c("__x0").alias("nx"), c("__y0").alias("ny"), "__pid", "x", "y")
    summed = [F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.min("__pid").alias("first")]
    summed += [f(v).alias(f"{v}{n}") for v in "xy" for f, n in ((F.min, 0), (F.max, 1))]
    bit = F.lit(0).cast("int")
    for s, (i, j) in enumerate(HALF):
        bit = F.when((c("b_nx") - c("a_nx") == i) & (c("b_ny") - c("a_ny") == j), 1 << s).otherwise(bit)
    links = pairs.groupBy(*inner, c("a_nx").alias("nx"), c("a_ny").alias("ny")).agg(F.bit_or(bit).alias("links"))
    nodes = dots.groupBy(*node).agg(*summed).join(links, node, "left").withColumn("links", F.coalesce("links", F.lit(0)))
    seen = durable(cells_in_reach(centres, nodes, inner, reach, node_size(gap)))

    inside = lambda x, y: (c(x) - c("lx")) * (c(x) - c("lx")) + (c(y) - c("ly")) * (c(y) - c("ly")) < reach * reach
    edge = seen.filter("NOT whole").select(*one, "lx", "ly", "nx", "ny", "links")
    rest = edge.join(dots, node).filter(inside("x", "y")).groupBy(*one, "lx", "ly", "nx", "ny", "links", F.lit(False).alias("whole")).agg(*summed)
    held = durable(seen.filter("whole").unionByName(rest))

    kinds = held.select(*one, "nx", "ny")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kinds.schema.fields)
    shape = held.select(*one, "nx", "ny", "links", "whole", "x0", "x1", "y0", "y1")
    told = durable(shape.groupBy(*one).applyInPandas(_parts(one, gap), f"{schema}, part int, asks array<struct<s:int,other:int>>"))

    # What boxes leave open between different parts is settled by the points that face the other box.
    ask = told.select(*node, "__cid", "part", F.inline("asks"))
    ask = ask.withColumns({f"o{d}": c(f"n{d}") + F.get(F.array(*[F.lit(h[k]) for h in HALF]), c("s")) for k, d in enumerate("xy")})
    box = held.select(*one, "lx", "ly", c("nx").alias("ox"), c("ny").alias("oy"), *[f"{v}{n}" for v in "xy" for n in (0, 1)])
    dx, dy = (F.greatest(c(f"{d}0") - c(d), c(d) - c(f"{d}1"), F.lit(0.0)) for d in "xy")
    near = ask.join(box, [*one, "ox", "oy"]).join(dots.drop("__pid"), node).filter(inside("x", "y") & (dx * dx + dy * dy <= gap * gap))
    near = near.select(*one, "part", "other", "ox", "oy", "lx", "ly", "x", "y")
    met = near.join(dots.select(*inner, c("nx").alias("ox"), c("ny").alias("oy"), c("x").alias("px"), c("y").alias("py")), [*inner, "ox", "oy"])
    d2 = (c("x") - c("px")) * (c("x") - c("px")) + (c("y") - c("py")) * (c("y") - c("py"))
    met = met.filter(inside("px", "py") & (d2 <= gap * gap))
    whose = lambda part: F.struct(*one, c(part).alias("part"))
    more = durable(met.select(whose("part").alias("u"), whose("other").alias("v")).distinct())
    ends = more.select(c("u").alias("node_id")).unionByName(more.select(c("v").alias("node_id")))
    roots = components(ends, more).select("node_id.*", c("root.part").alias("__root"))

    named = told.drop("asks").join(roots, [*one, "part"], "left").withColumn("part", F.coalesce("__root", "part")).drop("__root")
    out = held.join(named, [*one, "nx", "ny"]).groupBy(*one, "part").agg(
        F.min("first").alias("cluster"), F.sum("n").alias("n"), (F.sum("sx") / F.sum("n")).alias("mx"), (F.sum("sy") / F.sum("n")).alias("my"),
        F.min("x0").alias("xmin"), F.min("y0").alias("ymin"), F.max("x1").alias("xmax"), F.max("y1").alias("ymax"),
    )
    return out.drop("part").withColumnsRenamed({k: v for k, v in back.items() if k != "__pid"} | {"__cid": cid})


def two_nearest(points: DataFrame, keys: list[str], pid: str) -> DataFrame:
    """The nearest and second nearest other point of each point within its key.

    The places of a key are put in the order of a curve that fills the plane, by levels
    of a quad tree; a place's neighbours in that order bound the distance of the two it
    looks for. It then looks around it in cells of the size of that bound, so neither an
    outlier nor a crowd makes a cell of many places, and there are no rounds. Points in
    one place are one place. Adds n1, d1, n2, d2, NULL where a key is too small. Ties
    go to the lower ``pid``.
    """
    points, inner, back = _aside(points.select(*keys, pid, "x", "y"), keys, pid)
    return _two_nearest(points, inner, "__pid").withColumnsRenamed(back)


def _spread_bits(v: Column) -> Column:
    """The 31 bits of a number, each followed by a zero."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def _two_nearest(points: DataFrame, keys: list[str], pid: str) -> DataFrame:
    c = F.col
    # A place has the least numbers of its points; a point looks for those of others there first.
    points = points.withColumns({"x": c("x") + F.lit(0.0), "y": c("y") + F.lit(0.0)})  # one zero
    place = [*keys, "x", "y"]
    first = points.groupBy(*place).agg(F.min(pid).alias("p1"), F.count(F.lit(1)).alias("__n"))
    crowds = points.join(first.filter("__n > 1").drop("__n"), place).filter(c(pid) > c("p1"))
    second = crowds.groupBy(*place).agg(F.min(pid).alias("p2"))
    third = crowds.join(second, place).filter(c(pid) > c("p2")).groupBy(*place).agg(F.min(pid).alias("p3"))
    places = durable(first.drop("__n").join(second, place, "left").join(third, place, "left"))

    low = places.groupBy(*keys).agg(F.min("x").alias("__x0"), F.min("y").alias("__y0"), (F.max("x") - F.min("x")).alias("__w"), (F.max("y") - F.min("y")).alias("__h"))
    side = F.greatest("__w", "__h")
    low = low.select(*keys, "__x0", "__y0", F.when(side > 0, side).otherwise(1.0).alias("__side"))
    step = lambda v, v0: _spread_bits(F.floor((c(v) - c(v0)) / c("__side") * (2**31 - 1)).cast("long"))
    z = step("x", "__x0").bitwiseOR(F.shiftleft(step("y", "__y0"), 1))
    curve = places.join(low, keys).withColumn("__z", z).drop("__x0", "__y0", "__side")
    here = F.struct("x", "y", "p2")
    order = ["__z", "x", "y"]
    curve = ordered_scan(curve, keys, order, {"__s0": Neighbour(here, -1), "__s1": Neighbour(here, 1)})
    curve = ordered_scan(curve, keys, order, {"__s2": Neighbour("__s0", -1), "__s3": Neighbour("__s1", 1)})
    far = lambda o: F.sqrt((c("x") - c(o)["x"]) ** 2 + (c("y") - c(o)["y"]) ** 2)
    seen = [F.when(c(f"__s{i}").isNotNull(), far(f"__s{i}")) for i in range(4)]
    seen += [F.when(c(f"__s{i}.p2").isNotNull(), far(f"__s{i}")) for i in range(4)]
    seen = F.array_sort(F.array_compact(F.array(*seen)))
    bound = F.coalesce(F.get(seen, 1), F.get(seen, 0))  # the only other place of a key
    level = F.pow(F.lit(2.0), F.ceil(F.log2(bound)))
    open_ = curve.select(*place, F.when(level < bound, level * 2).otherwise(level).alias("__lvl")).filter("__lvl IS NOT NULL")

    looking = durable(open_.withColumns({"__cx": cell("x", c("__lvl")), "__cy": cell("y", c("__lvl"))}))
    cells = looking.select(*keys, "__lvl", "__cx", "__cy").distinct()
    wanted = cells.withColumn("__s", F.explode(_shifts(1))).select(
        *keys, "__lvl", "__cx", "__cy", (c("__cx") + c("__s.i")).alias("__nx"), (c("__cy") + c("__s.j")).alias("__ny")
    )
    own = places.select(*keys, c("x").alias("ox"), c("y").alias("oy"), c("p1").alias("o1"), c("p2").alias("o2"))
    own = own.join(cells.select(*keys, "__lvl").distinct(), keys).withColumns({"__nx": cell("ox", c("__lvl")), "__ny": cell("oy", c("__lvl"))})
    near = wanted.join(own, [*keys, "__lvl", "__nx", "__ny"]).drop("__nx", "__ny")
    d = F.sqrt((c("x") - c("ox")) ** 2 + (c("y") - c("oy")) ** 2)
    hits = looking.join(near, [*keys, "__lvl", "__cx", "__cy"]).filter((c("x") != c("ox")) | (c("y") != c("oy"))).filter(d <= c("__lvl"))
    both = F.array_compact(F.array(F.struct(d.alias("d"), c("o1").alias("o")), F.when(c("o2").isNotNull(), F.struct(d.alias("d"), c("o2").alias("o")))))
    hits = hits.select(*place, F.explode(both).alias("h"))
    one = hits.groupBy(*place).agg(F.min("h").alias("h1"))
    two = hits.join(one, place).filter(c("h") > c("h1")).groupBy(*place).agg(F.min("h").alias("h2"))
    done = places.join(one, place, "left").join(two, place, "left")

    at = lambda o: F.when(c(o).isNotNull() & (c(o) != c(pid)), F.struct(F.lit(0.0).alias("d"), c(o).alias("o")))
    found = F.array_sort(F.array_compact(F.array(at("p1"), at("p2"), at("p3"), c("h1"), c("h2"))))
    out = points.join(done, place).withColumn("__f", found)
    return out.select(
        *keys, pid, F.get("__f", 0)["o"].alias("n1"), F.get("__f", 0)["d"].alias("d1"), F.get("__f", 1)["o"].alias("n2"), F.get("__f", 1)["d"].alias("d2")
    )


def close_pairs(points: DataFrame, keys: list[str], pid: str, radius: str) -> DataFrame:
    """Pairs of points of a key no farther apart than the key's ``radius`` (a column)."""
    points, keys, back = _aside(points.select(*keys, pid, "x", "y", F.col(radius).alias("__radius")), keys, pid)
    pid, radius = "__pid", "__radius"
    p = points.filter(F.col(radius) > 0)
    left = p.select(*keys, F.col(pid).alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), radius).withColumns(
        {"__cx": cell("ax", F.col(radius)), "__cy": cell("ay", F.col(radius))}
    )
    right = around(p, "x", "y", F.col(radius)).select(*keys, F.col(pid).alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), "__cx", "__cy")
    d = F.sqrt((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2)
    return left.join(right, [*keys, "__cx", "__cy"]).filter("a < b").withColumn("d", d).filter(F.col("d") <= F.col(radius)).drop("__cx", "__cy", radius).withColumnsRenamed(back)


def chain_roots(links: DataFrame, keys: list[str]) -> DataFrame:
    """Where chains of ``links`` (keys, v, up) begin: keys, v, root and odd, whether that is an odd number of steps away.

    Each v has one link, none leads back. Every round doubles the steps that are taken
    at once, so rounds grow with the logarithm of the longest chain.
    """
    state = durable(links.select(*keys, "v", F.col("up").alias("root"), F.lit(True).alias("odd")))
    while True:
        on = state.select(*keys, F.col("v").alias("root"), F.col("root").alias("__r"), F.col("odd").alias("__o"))
        joined = durable(state.join(on, [*keys, "root"], "left"))
        if joined.filter("__r IS NOT NULL").isEmpty():
            return state
        odd = F.when(F.col("__o"), ~F.col("odd")).otherwise(F.col("odd"))
        state = durable(joined.select(*keys, "v", F.coalesce("__r", "root").alias("root"), odd.alias("odd")))


def greedy_matching(pairs: DataFrame, keys: list[str], weight: list[str]) -> DataFrame:
    """The pairs a greedy pass by ascending weight takes, each point once.

    ``pairs`` has a, b, which no key may be called. A pair that is the smallest of all open pairs at both of
    its points is certain to be taken; each round takes all such pairs at once and
    drops what they rule out. A pair that waits for one other only is taken if that is
    not: whole chains of such pairs are settled in the round that settles their first.
    """
    order = F.struct(*weight, "a", "b")
    open_, taken = durable(pairs.withColumn("__w", order)), None
    while True:
        ends = open_.select(*keys, "__w", F.explode(F.array("a", "b")).alias("__p"))
        # The two smallest pairs of a point decide whether a pair waits for none, one or more.
        first = ends.groupBy(*keys, "__p").agg(F.min("__w").alias("__w1"))
        second = ends.join(first, [*keys, "__p"]).filter("__w > __w1").groupBy(*keys, "__p").agg(F.min("__w").alias("__w2"))
        at = durable(first.join(second, [*keys, "__p"], "left"))
        seen = open_
        for end in ("a", "b"):
            own = at.select(*keys, F.col("__p").alias(end), F.col("__w1").alias(f"__1{end}"), F.col("__w2").alias(f"__2{end}"))
            seen = seen.join(own, [*keys, end])
        before = lambda e: F.when(F.col("__w") == F.col(f"__1{e}"), 0).when(F.col("__w") == F.col(f"__2{e}"), 1).otherwise(2)
        seen = durable(seen.withColumn("__n", before("a") + before("b")))
        sure = seen.filter("__n = 0").select(*open_.columns)
        if sure.isEmpty():
            return (taken if taken is not None else sure).drop("__w")
        up = F.when(F.col("__w") == F.col("__1a"), F.col("__1b")).otherwise(F.col("__1a"))
        # Pairs are named by their own order, so a chain leads to ever smaller ones.
        links = seen.filter("__n = 1").select(*keys, F.col("__w").alias("v"), up.alias("up"))
        roots = chain_roots(links, keys)
        even = roots.filter("NOT odd").join(sure.select(*keys, F.col("__w").alias("root")), [*keys, "root"], "left_semi")
        more = open_.join(even.select(*keys, F.col("v").alias("__w")), [*keys, "__w"], "left_semi").select(*open_.columns)
        new = durable(sure.unionByName(more))
        taken = new if taken is None else taken.unionByName(new)
        gone = new.select(*keys, F.explode(F.array("a", "b")).alias("__p"))
        for end in ("a", "b"):
            open_ = open_.join(gone.withColumnRenamed("__p", end), [*keys, end], "left_anti")
        open_ = durable(open_.select(*new.columns))


#: Points around a point up to which its earlier neighbours are counted.
FEW = 12


def keep_first_apart(points: DataFrame, keys: list[str], pid: str, size: float) -> DataFrame:
    """Keep each point, in ``pid`` order, that has no kept point closer than ``size`` in both axes.

    At most one point per cell of that size can be kept. Each round keeps the first
    open point of every cell that precedes all open points of the cells around it,
    and drops the open points it rules out. Where few points are around, one that has a
    single earlier neighbour is kept if that is not: whole chains of such points are
    settled in the round that settles their first.
    """
    open_ = durable(points.withColumns({"__cx": cell("x", size), "__cy": cell("y", size)}))
    kept = None
    here = [*keys, "__cx", "__cy"]
    c = F.col
    close = (F.abs(c("x") - c("__kx")) < size) & (F.abs(c("y") - c("__ky")) < size)

    def spread_out(df: DataFrame, *names: str) -> DataFrame:
        return df.withColumn("__s", F.explode(_shifts(1))).select(*keys, (c("__cx") + c("__s.i")).alias("__cx"), (c("__cy") + c("__s.j")).alias("__cy"), *names)

    while True:
        firsts = open_.groupBy(*here).agg(F.min(pid).alias("__f"), F.count(F.lit(1)).alias("__k"))
        lowest = spread_out(firsts, "__f", "__k").groupBy(*here).agg(F.min("__f").alias("__low"), F.sum("__k").alias("__k"))
        winners = firsts.drop("__k").join(lowest, here).filter("__f = __low").select(*keys, c("__f").alias(pid))
        new = durable(open_.join(winners, [*keys, pid], "left_semi"))
        if new.isEmpty():
            return (kept if kept is not None else new).drop("__cx", "__cy")

        sparse = open_.join(lowest.filter(c("__k") <= FEW).select(*here), here, "left_semi")
        others = spread_out(open_.select(*here, c(pid).alias("__o"), c("x").alias("__kx"), c("y").alias("__ky")), "__o", "__kx", "__ky")
        earlier = sparse.join(others, here).filter((c("__o") < c(pid)) & close).groupBy(*keys, pid).agg(F.min("__o").alias("up"), F.count(F.lit(1)).alias("__n"))
        roots = chain_roots(earlier.filter("__n = 1").select(*keys, c(pid).alias("v"), "up"), keys)
        even = roots.filter("NOT odd").join(new.select(*keys, c(pid).alias("root")), [*keys, "root"], "left_semi")
        new = durable(new.unionByName(open_.join(even.select(*keys, c("v").alias(pid)), [*keys, pid], "left_semi").select(*new.columns)))

        kept = new if kept is None else kept.unionByName(new)
        ruling = spread_out(new.withColumns({"__kx": c("x"), "__ky": c("y")}), "__kx", "__ky")
        out = open_.join(ruling, here).filter(close).select(*keys, pid).distinct()
        open_ = durable(open_.join(out, [*keys, pid], "left_anti"))
