"""Plan building blocks against plain computations, with one key holding most rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanledger.plans import grid, scan
from spanledger.plans.containment import GRAMS, contained, sampled_grams
from spanledger.plans.fold import fold
from spanledger.plans.scan import Neighbour, Running, ordered_scan
from spanledger.session import tune


def skewed(spark, n=600):
    rnd = random.Random(7)
    rows = []
    for i in range(n):
        key = "hot" if rnd.random() < 0.6 else rnd.choice(["a", "b", None])
        rows.append((i, key, rnd.randrange(200), rnd.choice([None, 1.0, 2.5, -3.0])))
    return spark.createDataFrame(rows, "id long, k string, o int, v double")


OUTPUTS = {
    "n": Running("count"),
    "nv": Running("count", "v"),
    "total": Running("sum", "v"),
    "before": Running("sum", "v", inclusive=False),
    "low": Running("min", "v"),
    "last": Running("last", "v"),
    "first": Running("first", "v"),
    "prev": Neighbour("v", -1),
    "next": Neighbour("v", 1),
}


@pytest.mark.parametrize("descending", [False, True])
def test_chunked_scan_equals_plain_scan(spark, monkeypatch, descending):
    df = skewed(spark)
    plain = ordered_scan(df, ["k"], ["o", "id"], OUTPUTS, descending)
    want = {r["id"]: r.asDict() for r in plain.collect()}
    monkeypatch.setattr(scan, "HOT_ROWS", 10)
    cut = ordered_scan(df, ["k"], ["o", "id"], OUTPUTS, descending)
    got = {r["id"]: r.asDict() for r in cut.collect()}
    assert got == want


def test_chunks_stay_even_under_a_hot_key(spark):
    df = spark.range(8000).withColumn("k", F.when(F.col("id") % 3 == 0, "hot").otherwise("c"))
    sizes = [r["count"] for r in scan.with_chunk(df, "id", 8).groupBy(scan.CHUNK).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 8000 / 8


def test_fold_in_chunks_equals_plain_fold(spark):
    def count_from_anchor(cols, state):
        anchor = int(state) if state else None
        out = []
        for o in cols["o"]:
            if anchor is None or o - anchor > 7:
                anchor = int(o)
            out.append(anchor)
        return {"id": cols["id"], "anchor": np.array(out)}, str(anchor)

    df = skewed(spark).select("id", "k", "o")
    run = lambda rows: {(r["id"], r["anchor"]) for r in fold(df, ["k"], ["o", "id"], count_from_anchor, "id long, anchor int", rows).collect()}
    assert run(10_000) == run(25)


def test_containment_equals_all_pairs(spark):
    rnd = random.Random(3)
    words = ["ab", "abc", "pier", "piercap", "x-1", "long", "longer", "zone"]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    hay = [(i, rnd.choice("pq"), text(rnd.randrange(1, 12)) + rnd.choice(["", "\n" + text(3)])) for i in range(60)]
    needles = []
    for i in range(120):
        base = rnd.choice(hay)[2]
        a = rnd.randrange(len(base))
        needles.append((i, rnd.choice("pq"), base[a : a + rnd.randrange(3, 30)]))
    needles = [n for n in needles if len(n[2]) >= 3 and n[2].strip()]
    n_df = spark.createDataFrame(needles, "nid int, k string, needle string")
    h_df = spark.createDataFrame(hay, "hid int, k string, text string")
    got = {(r[0], r[1]) for r in contained(n_df, h_df, ["k"], "nid", "needle", "hid", "text").select("nid", "hid").collect()}
    assert got == {(n[0], h[0]) for n in needles for h in hay if n[1] == h[1] and n[2] in h[2]}


def test_containment_of_needles_of_all_lengths(spark):
    rnd = random.Random(5)
    hay = [(i, "k", "".join(rnd.choice("ab é\n") for _ in range(rnd.choice([0, 1, 7, 40, 300])))) for i in range(40)]
    hay += [(90, "k", None), (91, "k", "ab" * 50_000), (92, "k", "x" * 100_000)]  # words of 100,000 characters
    needles = [(0, "k", "a"), (1, "k", "b "), (2, "k", " "), (3, "k", None), (4, "k", ""), (5, "k", "ba" * 40_000), (6, "k", "x" * 99_999 + "y"), (7, "z", "a")]
    for i in range(10, 90):
        base = rnd.choice(hay[:40])[2]
        at, n = rnd.randrange(len(base) + 1), rnd.choice([1, 2, 3, 7, 8, 9, 31, 32, 33, 200])
        needles.append((i, "k", base[at : at + n]))
    n_df = spark.createDataFrame(needles, "nid int, k string, needle string")
    h_df = spark.createDataFrame(hay, "hid int, k string, text string")
    for least in (1, 3):
        got = {(r["nid"], r["hid"]) for r in contained(n_df, h_df, ["k"], "nid", "needle", "hid", "text", least).collect()}
        want = {(n[0], h[0]) for n in needles for h in hay if n[2] and h[2] and n[1] == h[1] and n[2].strip() and len(n[2]) >= least and n[2] in h[2]}
        assert got == want
    none = n_df.limit(0)
    assert contained(none, h_df, ["k"], "nid", "needle", "hid", "text").count() == 0


@pytest.mark.parametrize("kind", range(len(GRAMS)))
def test_a_text_keeps_all_grams_of_its_parts(kind):
    rnd = random.Random(kind)
    least, size, window = GRAMS[kind]
    assert size + window - 1 <= least
    for _ in range(200):
        text = "".join(rnd.choice("abc") for _ in range(rnd.randrange(least, 4 * least + 5)))
        at = rnd.randrange(len(text) - least + 1)
        part = text[at : at + rnd.randrange(least, len(text) - at + 1)]
        kept = sampled_grams(part, kind)
        assert len(kept) and set(kept.tolist()) <= set(sampled_grams(text, kind).tolist())
    long = "".join(rnd.choice("abcdefgh") for _ in range(20_000))
    assert len(sampled_grams(long, kind)) <= 3 * len(long) / (window + 1)


def cloud(spark, n=150):
    rnd = random.Random(11)
    pts = [(i, i % 2, round(rnd.gauss(0, 300), 1), round(rnd.gauss(0, 300), 1)) for i in range(n)]
    pts += [(n + i, 0, 5.0, 5.0) for i in range(40)]  # many points in one place
    return pts, spark.createDataFrame(pts, "id long, s int, x double, y double")


def test_two_nearest_with_an_outlier_and_a_crowd(spark):
    rnd = np.random.default_rng(4)
    xy = np.vstack([rnd.normal(0, 3, (700, 2)), rnd.normal(5000, 0.01, (300, 2)), [[1e9, -1e9], [-0.0, 7.0], [0.0, 7.0]]]).round(4)
    pts = [(i, 0, float(x), float(y)) for i, (x, y) in enumerate(xy)]
    pts += [(20_000 + i, 0, 123.0, 45.0) for i in range(10_000)]  # a crowd in one place
    pts += [(40_000, 1, 1.0, 1.0), (40_001, 2, 1.0, 1.0), (40_002, 2, 1.0, 1.0), (40_003, 3, 0.0, 0.0), (40_004, 3, 5.0, 0.0)]
    df = spark.createDataFrame(pts, "id long, s int, x double, y double")
    got = {r["id"]: (r["n1"], r["d1"], r["n2"], r["d2"]) for r in grid.two_nearest(df, ["s"], "id").collect()}
    assert len(got) == len(pts)
    ids = np.array([p[0] for p in pts if p[1] == 0])
    at = np.array([p[2:] for p in pts if p[1] == 0])
    few = list(range(0, 1003, 7)) + [1000, 1001, 1002, 20_000, 20_001, 20_002, 29_999]
    for i in few:
        me = at[ids == i][0]
        d = np.sqrt(((at - me) ** 2).sum(axis=1))
        d[ids == i] = np.inf
        a, b = np.lexsort((ids, d))[:2]
        assert got[i] == (ids[a], d[a], ids[b], d[b])
    assert got[40_000] == (None,) * 4 and got[40_001] == (40_002, 0.0, None, None) and got[40_003] == (40_004, 5.0, None, None)


@pytest.fixture
def rounds(monkeypatch):
    """Counts how often a plan stores what it has so far."""
    calls = []
    real = grid.durable
    monkeypatch.setattr(grid, "durable", lambda df: calls.append(1) or real(df))
    return calls


def test_points_along_a_line_take_few_rounds(spark, rounds):
    line = [(i, 0, i * 7.0, 0.0) for i in range(1000)] + [(2000 + i, 1, 0.0, 0.0) for i in range(30)]
    got = {r["id"] for r in grid.keep_first_apart(spark.createDataFrame(line, "id long, s int, x double, y double"), ["s"], "id", 10.0).collect()}
    assert got == {*range(0, 1000, 2), 2000}
    assert len(rounds) <= 40  # 12 doublings, and what stands around them


def test_pairs_along_a_line_take_few_rounds(spark, rounds):
    pairs = [(0, i, i + 1, float(i)) for i in range(1000)]
    got = sorted((r["a"], r["b"]) for r in grid.greedy_matching(spark.createDataFrame(pairs, "s int, a long, b long, d double"), ["s"], ["d"]).collect())
    assert got == [(i, i + 1) for i in range(0, 1000, 2)]
    assert len(rounds) <= 45


def test_matching_and_thinning_equal_the_greedy_pass(spark):
    rnd = random.Random(6)
    pairs = {(min(a, b), max(a, b)): rnd.randint(1, 9) for a, b in ((rnd.randrange(40), rnd.randrange(40)) for _ in range(160)) if a != b}
    used, want = set(), []
    for (a, b), d in sorted(pairs.items(), key=lambda x: (x[1], x[0])):
        if not used & {a, b}:
            used |= {a, b}
            want.append((a, b))
    df = spark.createDataFrame([(0, a, b, d) for (a, b), d in pairs.items()], "s int, a long, b long, d int")
    assert sorted((r["a"], r["b"]) for r in grid.greedy_matching(df, ["s"], ["d"]).collect()) == sorted(want)
    assert grid.greedy_matching(df.limit(0), ["s"], ["d"]).count() == 0
    pts = [(i, 0, rnd.uniform(0, 60), rnd.uniform(0, 60)) for i in range(200)]
    kept = []
    for p in pts:
        if not any(abs(p[2] - q[2]) < 10 and abs(p[3] - q[3]) < 10 for q in kept):
            kept.append(p)
    got = grid.keep_first_apart(spark.createDataFrame(pts, "id long, s int, x double, y double"), ["s"], "id", 10.0).collect()
    assert sorted(r["id"] for r in got) == [p[0] for p in kept]


def test_gap_clusters_equal_closure(spark):
    pts, df = cloud(spark)
    got = {r["id"]: r["cluster"] for r in grid.gap_clusters(df, ["s"], 60.0, "id").collect()}
    root = {p[0]: p[0] for p in pts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in pts:
        for b in pts:
            if a[1] == b[1] and (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 <= 3600:
                x, y = find(a[0]), find(b[0])
                root[max(x, y)] = min(x, y)
    assert got == {p[0]: find(p[0]) for p in pts}


def test_keep_first_apart_equals_pass_in_order(spark):
    pts, df = cloud(spark)
    got = {r["id"] for r in grid.keep_first_apart(df, ["s"], "id", 80.0).collect()}
    kept = []
    for p in pts:
        if not any(q[1] == p[1] and abs(q[2] - p[2]) < 80 and abs(q[3] - p[3]) < 80 for q in kept):
            kept.append(p)
    assert got == {p[0] for p in kept}


def test_filters_and_columns_reach_the_scan(spark):
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = li.filter("l_linestatus = 'O'").select("l_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_linestatus), EqualTo(l_linestatus,O)]" in plan
    assert "l_comment" not in plan and "l_tax" not in plan


def test_top_row_is_pruned_before_the_shuffle(spark):
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = scan.first_per(li, ["l_partkey"], ["l_orderkey", "l_linenumber"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan


@pytest.mark.parametrize("key", ["s", "d", "h", "o", "w", "p", "f", "low", "node", "u", "cx", "first", "x0"])
def test_key_names_do_not_meet_inner_columns(spark, key):
    pts, df = cloud(spark, 20)
    named = df.withColumnRenamed("s", key)
    ids = lambda out: sorted(r["id"] for r in out.select("id", key).collect())
    assert ids(grid.gap_clusters(named, [key], 60.0, "id")) == [p[0] for p in pts]
    assert ids(grid.two_nearest(named, [key], "id")) == [p[0] for p in pts]
    assert ids(grid.keep_first_apart(named, [key], "id", 80.0)) == ids(
        grid.keep_first_apart(df, ["s"], "id", 80.0).withColumnRenamed("s", key)
    )


def test_nearest_has_no_limit(spark):
    points = spark.createDataFrame([(1, "a", 0.0, 0.0), (2, "a", 9000.0, 5.0), (3, "b", 1.0, 1.0)], "id int, k string, x double, y double")
    anchors = spark.createDataFrame([(7, "a", 1.0, 1.0), (8, "a", 2.0, 2.0)], "ord int, k string, x double, y double")
    got = grid.nearest(points, anchors.withColumn("name", F.col("ord")), ["k"], "id", 4.0, ["name"], "ord").collect()
    assert {(r["id"], r["name"]) for r in got} == {(1, 7), (2, 8)}


def test_rows_made_of_a_compressed_table_are_not_broadcast(spark, tmp_path):
    path = f"{tmp_path}/t.parquet"
    spark.range(200_000).coalesce(1).write.parquet(path)
    kinds = F.explode(F.array(*[F.lit(k) for k in "abcdefgh"])).alias("kind")
    rows = tune(spark).read.parquet(path).select("id", kinds)
    joined = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).join(rows, "id")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_a_reinforcement_text_is_searched_once_for_its_three_fields(spark):
    from spanledger.functions import numbers

    texts = ["16φ@150 c/c", "25Φ – 42 NOS.", "12φ*7", "20 c/c", "@ 12.5", "8φ 3 nos, 4 nos", "no number", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("p", numbers.reinforcement(F.col("t")))
    got = {r.i: tuple(r.p) for r in df.collect()}
    assert got == {
        0: (16, "spacing", 150.0), 1: (25, "count", 42.0), 2: (12, "count", 7.0), 3: (None, "spacing", 20.0), 4: (None, "spacing", 12.5),
        5: (8, "count", 3.0), 6: (None, None, None), 7: (None, None, None), 8: (None, None, None),
    }
    plan = df.select("p.dia", "p.kind", "p.value")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("c/c") == 1


def rings_by_all_pairs(labels, dots, reach, gap):
    """The clusters of the dots within reach of each label: (sheet, lid, first dot): dots and box."""
    out = {}
    for s, lid, lx, ly in labels:
        near = [(d, x, y) for k, d, x, y in dots if k == s and (x - lx) * (x - lx) + (y - ly) * (y - ly) < reach * reach]
        left = {d: (x, y) for d, x, y in near}
        while left:
            first = min(left)
            todo, got = [left.pop(first)], []
            while todo:
                x, y = todo.pop()
                got.append((x, y))
                step = [d for d, (a, b) in left.items() if (x - a) * (x - a) + (y - b) * (y - b) <= gap * gap]
                todo += [left.pop(d) for d in step]
            xs, ys = zip(*got)
            out[s, lid, first] = (len(got), min(xs), min(ys), max(xs), max(ys))
    return out


@pytest.mark.parametrize("kind", ["sparse", "crowded", "fringe"])
def test_clusters_in_reach_equal_all_pairs(spark, monkeypatch, kind):
    rnd = random.Random(kind)
    n, wide = {"sparse": (250, 9000), "crowded": (900, 2500), "fringe": (500, 3000)}[kind]
    if kind == "fringe":
        # Short pieces of a circle about a label: cells are cut by it everywhere, and some parts meet in corners only.
        turn = [rnd.uniform(0, 6.3) for _ in range(n)]
        far = [rnd.choice([2990.0, 3010.0, 2600.0]) + rnd.uniform(-12, 12) for _ in range(n)]
        dots = [(i % 2, i, r * np.cos(t), r * np.sin(t)) for i, (t, r) in enumerate(zip(turn, far)) if int(t * 5) % 2]
        dots = [(s, d, float(x), float(y)) for s, d, x, y in dots]
    else:
        dots = [(rnd.randrange(2), i, rnd.uniform(-wide, wide), rnd.uniform(-wide, wide)) for i in range(n)]
    labels = [(s, 10 * i + s, rnd.uniform(-900, 900), rnd.uniform(-900, 900)) for s in (0, 1) for i in range(12)] + [(0, 500, 0.0, 0.0), (2, 600, 0.0, 0.0)]
    df = spark.createDataFrame([*dots, (0, 9999, None, 1.0)], "sheet int, did long, x double, y double")
    at = spark.createDataFrame(labels, "sheet int, lid long, lx double, ly double")
    asked = []
    if kind == "fringe":
        plain = grid.components
        monkeypatch.setattr(grid, "components", lambda nodes, edges: [asked.append(edges.count()), plain(nodes, edges)][1])
    got = grid.clusters_in_reach(df, at, ["sheet"], "did", "lid", 3000.0, 700.0).collect()
    assert kind != "fringe" or asked[0] > 0  # boxes left some open
    want = rings_by_all_pairs(labels, dots, 3000.0, 700.0)
    assert {(r["sheet"], r["lid"], r["cluster"]): (r["n"], r["xmin"], r["ymin"], r["xmax"], r["ymax"]) for r in got} == want


def test_cells_that_face_each_other_undecided_are_settled_by_points(spark):
    # Both cells are linked on the whole sheet; within reach only one of the two pairs is, and boxes do not tell.
    size = grid.node_size(700.0)
    dots = [(0, 1, 10.0, 10.0), (0, 2, 10.0, size - 10), (0, 3, 2 * size + 20, 240.0), (0, 4, size + 480, 10.0), (0, 5, size * 2 + 190, size - 10)]
    labels = [(0, 7, -2000.0, 200.0), (0, 8, 500.0, 200.0), (0, 9, -1800.0, -400.0)]
    df = spark.createDataFrame(dots, "sheet int, did long, x double, y double")
    at = spark.createDataFrame(labels, "sheet int, lid long, lx double, ly double")
    for reach in (3000.0, 2990.0, 3250.0):
        got = grid.clusters_in_reach(df, at, ["sheet"], "did", "lid", reach, 700.0).collect()
        assert {(r["sheet"], r["lid"], r["cluster"]): (r["n"], r["xmin"], r["ymin"], r["xmax"], r["ymax"]) for r in got} == rings_by_all_pairs(labels, dots, reach, 700.0)


def test_points_with_an_anchor_within_reach(spark):
    rnd = random.Random(5)
    place = lambda n, wide: [(rnd.randrange(2), i, rnd.uniform(-wide, wide), rnd.uniform(-wide, wide)) for i in range(n)]
    points, anchors = place(300, 9000), [*place(60, 3000), (0, 900, 8000.0, 0.0)]
    make = lambda rows: spark.createDataFrame(rows, "k int, id long, x double, y double")
    got = grid.has_within(make(points), make(anchors), ["k"], "id", 1500.0).collect()
    want = {(k, i) for k, i, x, y in points if any(k == s and (x - a) * (x - a) + (y - b) * (y - b) < 1500.0**2 for s, _, a, b in anchors)}
    assert {(r["k"], r["id"]) for r in got} == want and len(got) == len(want)


def test_rings_keep_no_row_for_each_dot_of_each_label(spark, monkeypatch):
    from spanledger.operators import geometry

    rnd = random.Random(11)
    kept = []
    plain = grid.durable
    monkeypatch.setattr(grid, "durable", lambda df: [out := plain(df), kept.append(out.count())][0])
    labels = spark.createDataFrame([(0, i, "pier", 20.0 * i, 0.0) for i in range(20)], "sheet int, lid long, component string, x double, y double")
    dots = [(0, i, rnd.uniform(-2000, 2000), rnd.uniform(-2000, 2000)) for i in range(12000)]
    regions = spark.createDataFrame([(1, "pier", 0.0, 0.0, 1.0, 1.0)], "sheet int, component string, xmin double, ymin double, xmax double, ymax double")
    out = geometry.ring_regions(labels, spark.createDataFrame(dots, "sheet int, did long, x double, y double"), regions, "sheet", "lid", "did", 3000.0, 700.0).collect()
    assert len(out) == 20 and all(r["dots"] > 11000 for r in out)
    # Before: 240,000, one row for each dot of each label. Now the cell pairs of a sheet are most.
    assert max(kept) < 20 * len(dots) / 4
