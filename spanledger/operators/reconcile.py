"""Design schedule and geometry against what the drawing shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanledger.functions import numbers as N
from spanledger.functions.geo import section_box_or_fallback
from spanledger.operators.issues import described, emit, halves, held, held_nos, issue
from spanledger.plans.scan import Running, ordered_scan

COMPONENTS = ["pilecap", "pile", "pier"]
BAR = ["drawing_id", "component", "bar_mark"]

# What a geometry reading is compared with and how closely:
# reading, design key, tolerance in percent, label, unit of the design value.
GEOMETRY_CHECKS = [
    ("pilecap_depth", "pilecap_depth", 2.0, "Pilecap depth", "m"),
    ("pile_spacing", "pile_spacing", 2.0, "Pile c/c spacing", "m"),
    ("pile_overhang", "pile_overhang", 5.0, "Pile overhang", "m"),
    ("pilecap_width", "pilecap_length_across", 2.0, "Pilecap width (across)", "m"),
    ("pile_dia", "pile_dia", 2.0, "Pile diameter", "m"),
]


def component_no(c: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in COMPONENTS]), c)


def whole(c: Column) -> Column:
    return F.bround(c, 0).cast("long")


def r2(c: Column) -> Column:
    return F.bround(c.cast("double"), 2)


# Scope --------------------------------------------------------------------


def components_in(text: Column) -> Column:
    """The components a view name mentions, as an array."""
    # How a name mentions a component.
    patterns = {"pilecap": r"(?i)\bPILECAP\b", "pile": r"(?i)\bPILE\b(?!CAP)", "pier": r"(?i)\bPIER\b"}
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(c)) for c, p in patterns.items()]))


def components_on_sheet(sections: DataFrame, key: str) -> DataFrame:
    """The components that the present section and reinforcement views name.

    A drawing without such a view has no row: that is "no signal", not "nothing".
    """
    upper = F.upper("name")
    named = sections.filter(
        F.col("present") & (upper.startswith("SECTION") | upper.contains("REINFORCEMENT PLAN"))
    )
    return (
        named.select(key, F.explode(components_in(upper)).alias("c"))
        .groupBy(key)
        .agg(F.array_sort(F.collect_set("c")).alias("scope"))
    )


def in_scope(df: DataFrame, scope: DataFrame, key: str, component: Column) -> DataFrame:
    """Keep components on the sheet; no signal means no restriction."""
    j = df.join(scope, key, "left")
    return j.filter(F.col("scope").isNull() | F.array_contains("scope", component)).drop("scope")


# Bars ---------------------------------------------------------------------


def match_bars(design: DataFrame, drawing: DataFrame, keys: list[str], part: list[str]) -> DataFrame:
    """Each design mark with how it fared: matched, mark_missing or component_missing.

    ``part`` are the leading keys that name a component. A component wholly absent
    from the drawing comes once, with a NULL mark.
    """
    mark = [k for k in keys if k not in part]
    have_part = drawing.select(*part).distinct().withColumn("__p", F.lit(True))
    have_mark = drawing.select(*keys).distinct().withColumn("__m", F.lit(True))
    marks = design.select(*keys).distinct()
    absent = (
        marks.select(*part).distinct().join(have_part, part, "left_anti")
        .select(*part, *[F.lit(None).cast(marks.schema[m].dataType).alias(m) for m in mark],
                F.lit("component_missing").alias("outcome"))
    )
    there = (
        marks.join(have_part.drop("__p"), part, "left_semi")
        .join(have_mark, keys, "left")
        .select(*keys, F.when(F.col("__m"), "matched").otherwise("mark_missing").alias("outcome"))
    )
    return there.unionByName(absent)


def missing_bar_issues(design: DataFrame, drawing: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """Issues for absent components in scope and for absent marks."""
    outcome = match_bars(design, drawing, BAR, BAR[:2])
    gone = outcome.filter("outcome = 'component_missing'")
    if scope is not None:
        gone = in_scope(gone, scope, "drawing_id", F.col("component"))
    marks = outcome.filter("outcome = 'mark_missing'")
    comp, mark = F.col("component"), F.col("bar_mark")
    zone = F.concat(comp, F.lit("_schedule"))
    a = emit(gone, BAR, [F.lit(4), component_no(comp)], [(F.lit(True), issue("component_missing", zone=zone, comp=comp))])
    b = emit(marks, BAR, [F.lit(4), component_no(comp)], [(F.lit(True), issue("mark_missing", nobox=True, comp=comp, mark=mark))])
    return a.unionByName(b)


def _summed() -> list[Column]:
    """Per mark of the design: the first zone's values, zone count and the sums of given values."""
    first = F.struct("dia_mm", "spacing_mm", "count", "length_m", "unit_wt", "reinf_secondary", "shape_dims")
    total = lambda c: F.sum(N.given(F.col(c)))
    return [
        F.min_by(first, F.struct("zone_ord")).alias("d"),
        F.count(F.lit(1)).alias("d_zones"),
        total("count").alias("d_count"),
        total("total_len_m").alias("d_total_len"),
        total("total_wt_kg").alias("d_total_wt"),
    ]


def mark_summary(design: DataFrame) -> DataFrame:
    """Per mark: the first zone's values, zone count and the sums of given values."""
    return design.groupBy(*BAR).agg(*_summed())


def bar_scalar_issues(summary: DataFrame, drawing: DataFrame, sheet: DataFrame | None = None) -> DataFrame:
    """Every zone row of the drawing against the design values of its mark.

    ``sheet`` may give spacing_capable and shape_dims_capable per drawing; a missing
    flag means capable.
    """
    j = drawing.join(summary, BAR)
    if sheet is not None:
        j = j.join(sheet.select("drawing_id", "spacing_capable", "shape_dims_capable"), "drawing_id", "left")
    else:
        j = j.withColumns({"spacing_capable": F.lit(True), "shape_dims_capable": F.lit(True)})
    d, c = F.col("d"), F.col
    comp, mark = c("component"), c("bar_mark")
    say = {"comp": comp, "mark": mark}
    zone = F.concat(comp, F.lit("_schedule"))
    box = c("row_bbox")

    # Parsed once per row; the checks below refer to the results.
    j = j.withColumns(
        {
            "__dia": F.coalesce(N.given(c("bar_dia_mm")), N.norm_dia(c("reinforcement_text"))),
            "__text": N.reinforcement(c("reinforcement_text")),
        }
    )
    w_dia, text = c("__dia"), c("__text")
    sp_d, sp_w = d["spacing_mm"], c("spacing_mm").cast("double")
    kind = d["reinf_secondary"]
    has_text = kind.isNotNull() & (F.coalesce(c("reinforcement_text"), F.lit("")) != "")
    right_kind = has_text & text["kind"].eqNullSafe(kind)
    count_all = F.when(c("d_zones") > 1, c("d_count")).otherwise(d["count"])
    form = lambda k: F.when(k == "spacing", "φdia@spacing c/c").otherwise("φdia × count NOS")

    def mk(code, dv=None, wv=None):
        extra = {}
        if dv is not None:
            extra["d"] = dv
        if wv is not None:
            extra["w"] = wv
        return issue(code, box=box, zone=zone, **say, **extra)

    checks = [
        (N.present(d["dia_mm"]) & N.present(w_dia) & (d["dia_mm"] != w_dia), mk("bar_dia", d["dia_mm"], w_dia)),
        (N.pct_diff(sp_d, sp_w) > 5, mk("bar_spacing", r2(sp_d), r2(sp_w))),
        (N.present(sp_d) & ~N.present(sp_w) & F.coalesce("spacing_capable", F.lit(True)), mk("bar_spacing_missing", r2(sp_d))),
        (N.pct_diff(d["length_m"], c("length_m")) > 2, mk("bar_length", r2(d["length_m"]), r2(c("length_m")))),
        (N.pct_diff(d["unit_wt"], c("unit_wt_kg_m")) > 2, mk("bar_unit_weight", F.bround(d["unit_wt"], 3), F.bround("unit_wt_kg_m", 3))),
        (has_text & text["kind"].isNotNull() & (text["kind"] != kind), mk("reinf_kind", form(kind), form(text["kind"]))),
        (right_kind & (kind == "spacing") & (N.pct_diff(sp_d, text["value"]) > 5), mk("reinf_spacing", whole(sp_d), whole(text["value"]))),
        (right_kind & (kind == "count") & N.present(count_all) & (text["value"].cast("long") != count_all), mk("reinf_count", count_all, text["value"].cast("long"))),
    ]
    # Values and shape segments are found in one pass over the joined rows; numbers from
    # that of the last check on are segments.
    first = len(checks)
    off = lambda p: N.pct_diff(p["design_mm"], p["drawing_mm"]).between(2, 55) & (N.pct_diff(p["design_mm"], p["drawing_mm"]) != 2)
    dims = F.when(F.coalesce("shape_dims_capable", F.lit(True)), N.match_dims(d["shape_dims"], c("shape_dimensions")))
    segments = F.array_compact(F.transform("__dims", lambda p, i: F.when(off(p), first + i)))
    found = j.withColumns({"__mask": held(checks), "__dims": dims}).withColumn("__hit", F.explode_outer(F.concat(held_nos(first), F.coalesce(segments, F.array().cast("array<int>")))))
    rows = found.filter("__hit IS NOT NULL").withColumn("__no", F.least("__hit", F.lit(first)))
    seg, pair = c("__hit") - first, F.get("__dims", c("__hit") - first)
    shape = mk("bar_shape", whole(pair["design_mm"]), whole(pair["drawing_mm"]))
    ordering = [F.lit(4), component_no(comp).cast("int"), c("mark_ord").cast("int"), c("zone_ord").cast("int")]
    order = F.when(seg < 0, F.array(*ordering, c("__no"))).otherwise(F.array(*ordering, seg + 100, F.lit(0)))
    return described(rows, [*BAR, "zone_ord"], order, [*[f for _, f in checks], shape])


def _total_checks(comp: Column, mark: Column, d: dict[str, Column], w: dict[str, Column], ring: Column, piles: Column, zone: Column):
    gap = F.abs(d["count"] - w["count"])
    allowed = F.when(ring, 2 * F.greatest(piles, F.lit(1))).otherwise(0)
    both = N.present(d["count"]) & N.present(w["count"])
    say = {"comp": comp, "mark": mark}
    one = lambda v: F.format_string("%.1f", v.cast("double"))
    return [
        (both & (gap > allowed), issue("bar_count", zone=zone, d=d["count"].cast("long"), w=w["count"].cast("long"), **say)),
        (N.pct_diff(d["len"], w["len"]) > 2, issue("bar_total_length", zone=zone, d=r2(d["len"]), w=r2(w["len"]), **say)),
        (N.pct_diff(d["wt"], w["wt"]) > 5, issue("bar_weight", zone=zone, d=one(d["wt"]), w=one(w["wt"]), **say)),
    ]


def _zone_rows(length: str) -> Column:
    """The zone rows of one mark of one sheet: a handful of printed rows."""
    c = F.col
    return F.collect_list(F.struct(
        c("zone_ord").alias("ord"), c("count").cast("double").alias("count"),
        c(length).cast("double").alias("length"), c("total_wt_kg").cast("double").alias("wt"),
    ))


def _pairs(dr: Column, wr: Column) -> Column:
    """Zone rows of both sides, sorted, as pairs of structs in the order they were paired."""
    pick = lambda rows, o: F.get(F.filter(rows, lambda r: r["ord"] == o), 0)
    return F.transform(N.closest_pairs(dr, wr), lambda p: F.struct(pick(dr, p["design_ord"]).alias("design"), pick(wr, p["drawing_ord"]).alias("drawing")))


def zone_pairs(design: DataFrame, drawing: DataFrame) -> DataFrame:
    """The zone rows of a mark that are compared one by one: mark, no, design and drawing as structs.

    Only marks with equally many (more than one) zone rows on both sides are paired: the
    design row with the largest count first, each with the closest drawing row left.
    """

    def side(df: DataFrame, length: str, name: str) -> DataFrame:
        rows = df.groupBy(*BAR).agg(F.sort_array(_zone_rows(length)).alias(name))
        return rows.withColumn("n", F.size(name))

    both = side(design, "total_len_m", "dr").join(side(drawing, "total_length_m", "wr"), [*BAR, "n"]).filter("n > 1")
    return both.select(*BAR, F.posexplode(_pairs(F.col("dr"), F.col("wr"))).alias("no", "pair")).select(*BAR, "no", "pair.*")


def bar_total_issues(design: DataFrame, drawing: DataFrame, piles: DataFrame) -> DataFrame:
    """Count, total length and total weight of each mark.

    With equally many (more than one) zone rows on both sides the rows are paired
    and compared one by one, as by ``zone_pairs``; otherwise the sums of the given values
    are. Both come from one pass over either side. ``piles`` has drawing_id and pile_count.
    """
    c = F.col
    total = lambda n: F.sum(N.given(c(n)))
    drawn = drawing.groupBy(*BAR).agg(
        F.min("mark_ord").alias("mark_ord"),
        F.count(F.lit(1)).alias("w_zones"),
        total("count").alias("w_count"),
        total("total_length_m").alias("w_total_len"),
        total("total_wt_kg").alias("w_total_wt"),
        _zone_rows("total_length_m").alias("wr"),
    )
    designed = design.groupBy(*BAR).agg(*_summed(), _zone_rows("total_len_m").alias("dr"))
    paired = (c("w_zones") > 1) & (c("w_zones") == c("d_zones"))
    fields = (("count", "count"), ("total_len", "length"), ("total_wt", "wt"))
    one = lambda df, p: F.struct(F.lit(None).cast(df.schema["zone_ord"].dataType).alias("ord"), *[c(f"{p}_{v}").cast("double").alias(n) for v, n in fields])
    sums = F.array(F.struct(one(design, "d").alias("design"), one(drawing, "w").alias("drawing")))
    # The rows of a mark that is not paired go no further.
    marks = drawn.join(designed, BAR).select(
        *BAR, "mark_ord", N.present(c("d.spacing_mm")).alias("ring"), F.when(~paired, sums).alias("sums"),
        *[F.when(paired, F.sort_array(n)).alias(n) for n in ("dr", "wr")],
    ).join(piles, "drawing_id", "left")
    compared = F.coalesce("sums", _pairs(c("dr"), c("wr")))
    rows = marks.select(*BAR, "mark_ord", "ring", F.coalesce(N.given(c("pile_count")), F.lit(1)).alias("piles"), F.posexplode(compared).alias("no", "pair"))
    comp, mark = c("component"), c("bar_mark")
    side = lambda name: {"count": c(f"pair.{name}.count"), "len": c(f"pair.{name}.length"), "wt": c(f"pair.{name}.wt")}
    return emit(
        rows, BAR, [F.lit(4), component_no(comp), c("mark_ord"), c("no") + 1000],
        _total_checks(comp, mark, side("design"), side("drawing"), c("ring"), c("piles"), F.concat(comp, F.lit("_schedule"))),
    )


def zone_consistency(rows: DataFrame, keys: list[str], order: list[str], value: str, tol_pct: float = 2.0) -> DataFrame:
    """Rows whose value differs from the first given value of their key by more than ``tol_pct``."""
    given = rows.filter(N.present(F.col(value)))
    firsts = given.groupBy(*keys).agg(
        F.min_by(F.struct(F.col(value).alias("v"), *order), F.struct(*order)).alias("__f")
    )
    j = given.join(firsts, keys)
    return (
        j.withColumn("first_value", F.col("__f.v"))
        .withColumn("first_ord", F.col(f"__f.{order[0]}"))
        .filter(N.pct_diff(F.col("first_value"), F.col(value)) > tol_pct)
        .drop("__f")
    )


def zone_issues(drawing: DataFrame) -> DataFrame:
    """Zone rows of a mark that disagree on fields that should repeat."""
    # Field, label and unit.
    fields = [
        ("bar_dia_mm", "Diameter", "mm"),
        ("spacing_mm", "Spacing", "mm c/c"),
        ("length_m", "Bar length", "m"),
        ("unit_wt_kg_m", "Unit weight", "kg/m"),
    ]
    long = drawing.select(
        *BAR, "mark_ord", "zone_ord",
        F.posexplode(F.array(*[F.struct(F.lit(l).alias("label"), F.lit(u).alias("unit"), F.col(f).cast("double").alias("v")) for f, l, u in fields])).alias("f_no", "f"),
    ).select(*BAR, "mark_ord", "zone_ord", "f_no", "f.*")
    odd = zone_consistency(long, [*BAR, "f_no"], ["zone_ord"], "v")
    # A diameter shows as a whole number.
    show = lambda v: F.when(F.col("f_no") == 0, v.cast("int").cast("string")).otherwise(v.cast("string"))
    c = F.col
    return emit(
        odd, BAR, [F.lit(4), component_no(c("component")), c("mark_ord"), F.lit(2000), c("f_no"), c("zone_ord")],
        [(F.lit(True), issue("zone_rows", zone=F.concat(c("component"), F.lit("_schedule")), comp=c("component"), mark=c("bar_mark"), label=c("label"), unit=c("unit"),
                             row1=c("first_ord"), row2=c("zone_ord"), d=show(c("first_value")), w=show(c("v"))))],
    )


def companion_order(marks: DataFrame, keys: list[str], mark: str, order: str) -> DataFrame:
    """Suffixed marks such as ``y1`` that come before their base mark ``y``."""
    base = F.regexp_extract(F.col(mark), r"^([a-z])\d*$", 1)
    lettered = marks.withColumn("base", base).filter("base <> ''")
    bases = (
        lettered.filter(F.col(mark) == F.col("base"))
        .groupBy(*keys, "base").agg(F.min(order).alias("base_ord"))
    )
    return lettered.filter(F.col(mark) != F.col("base")).join(bases, [*keys, "base"]).filter(F.col("base_ord") > F.col(order))


def callout_gaps(design: DataFrame, drawing: DataFrame, callouts: DataFrame, key: str = "drawing_id", mark: str = "bar_mark") -> DataFrame:
    """Marks of both schedules without a callout, in drawings that use callouts at all."""
    using = callouts.select(key).distinct()
    both = design.select(key, mark).distinct().join(drawing.select(key, mark).distinct(), [key, mark], "left_semi")
    return both.join(using, key, "left_semi").join(callouts.select(key, mark).distinct(), [key, mark], "left_anti")


def row_boxes(bars: DataFrame, anchors: DataFrame | None, sections: DataFrame) -> DataFrame:
    """The box of each schedule row.

    ``sections`` has drawing_id, component, sect (its box or NULL). ``anchors`` has
    scale and offset per drawing. A row box is calibrated where a calibration
    exists, taken as it is without one, and else spread evenly over the section.
    """
    c = F.col
    zone = F.concat(c("component"), F.lit("_schedule"))
    sizes = bars.groupBy("drawing_id", "component").agg(F.count_distinct("bar_mark").alias("marks"))
    j = bars.join(sizes, ["drawing_id", "component"]).join(sections, ["drawing_id", "component"], "left")
    j = j.join(anchors, "drawing_id", "left") if anchors is not None else j.withColumns({"scale": F.lit(None).cast("double"), "offset": F.lit(None).cast("double")})
    j = j.withColumn("sect", section_box_or_fallback(zone, c("sect")))
    row_h = F.greatest(c("sect.h") / c("marks"), F.lit(2.0))

    def b(x, y, w, h):
        return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), w.cast("double").alias("w"), h.cast("double").alias("h"))

    cal = b(
        c("sect.x"),
        F.greatest(F.lit(0.0), F.least(F.lit(99.0), c("scale") * c("row_bbox.y") + c("offset"))),
        c("sect.w"),
        F.greatest(F.lit(0.5), F.abs(c("scale")) * c("row_bbox.h")),
    )
    spread = b(c("sect.x"), c("sect.y") + (c("mark_ord") - 1) * row_h, c("sect.w"), row_h)
    box = F.when(c("row_bbox").isNotNull() & c("scale").isNotNull(), cal).when(c("row_bbox").isNotNull(), c("row_bbox")).otherwise(spread)
    return j.withColumn("bar_box", box).drop("marks", "sect", "scale", "offset")


def y_calibration(a: DataFrame, b: DataFrame, key: list[str], anchor: str, rank: Column, y: str) -> DataFrame:
    """Scale and offset from the first and last anchor both sides have.

    None with fewer than two anchors or when they are closer than 0.5.
    """
    both = a.select(*key, anchor, F.col(y).alias("ya")).join(b.select(*key, anchor, F.col(y).alias("yb")), [*key, anchor])
    p = F.struct("ya", "yb")
    ends = both.groupBy(*key).agg(
        F.min_by(p, rank).alias("lo"), F.max_by(p, rank).alias("hi"), F.count(F.lit(1)).alias("n")
    ).filter((F.col("n") >= 2) & (F.abs(F.col("hi.ya") - F.col("lo.ya")) >= 0.5))
    scale = (F.col("hi.yb") - F.col("lo.yb")) / (F.col("hi.ya") - F.col("lo.ya"))
    return ends.select(*key, scale.alias("scale"), (F.col("lo.yb") - scale * F.col("lo.ya")).alias("offset"))


# Geometry -----------------------------------------------------------------


def spread_check(readings: DataFrame, keys: list[str], value: str, tol_pct: Column) -> DataFrame:
    """Keys with several readings that differ by more than the tolerance."""
    v = F.col(value)
    g = readings.groupBy(*keys).agg(F.max(v).alias("hi"), F.min(v).alias("lo"), F.count(F.lit(1)).alias("n"))
    return g.filter((F.col("n") > 1) & ((F.col("hi") - F.col("lo")) / F.col("hi") * 100 > tol_pct))


def geometry_deviation(readings: DataFrame, design: DataFrame, keys: list[str], drawn: str, wanted: str, tol: str) -> DataFrame:
    """Readings off the design value by more than the tolerance given with it."""
    j = readings.join(design, keys)
    pct = F.when(F.col(wanted) != 0, F.abs(F.col(drawn) - F.col(wanted)) / F.col(wanted) * 100).otherwise(0.0)
    return j.withColumn("diff_pct", pct).filter(F.col("diff_pct") > F.col(tol))


def closer_key(readings: DataFrame, design: DataFrame, key: str, ord_col: str) -> DataFrame:
    """The design key whose value is closest to the first reading of each drawing."""
    first = readings.groupBy(key).agg(F.min_by("val_mm", ord_col).alias("val_mm"))
    j = first.join(design, key)
    return j.groupBy(key).agg(
        F.min_by("design_key", F.struct(F.abs(F.col("val_mm") - F.col("value") * 1000), "key_ord")).alias("design_key")
    )


def geometry_issues(readings: DataFrame, design: DataFrame) -> DataFrame:
    """All geometry findings. ``readings``: drawing_id, param, val_mm, x_pct, y_pct, ord (any whole
    number); ``design``: drawing_id, key, value."""
    spark, c = readings.sparkSession, F.col
    checks = spark.createDataFrame(
        [(i, *row) for i, row in enumerate(GEOMETRY_CHECKS)],
        "no int, param string, key string, tol double, label string, unit string",
    )
    sides = design.filter(c("key").isin("pier_length", "pier_width") & c("value").isNotNull()).select(
        "drawing_id", c("key").alias("design_key"), "value", F.when(c("key") == "pier_length", 0).otherwise(1).alias("key_ord")
    )
    pier = closer_key(readings.filter("param = 'pier_plan_dim'"), sides, "drawing_id", "ord").select(
        "drawing_id", F.lit(len(GEOMETRY_CHECKS)).alias("no"), F.lit("pier_plan_dim").alias("param"), c("design_key").alias("key"),
        F.lit(5.0).alias("tol"), F.lit("Pier plan dimension").alias("label"), F.lit("m").alias("unit"),
    )
    measured = readings.select("drawing_id").distinct()
    values = design.filter(c("value").isNotNull()).join(measured, "drawing_id", "left_semi")
    wanted = values.join(F.broadcast(checks), "key").unionByName(
        values.join(pier, ["drawing_id", "key"])
    ).select("drawing_id", "no", "param", "tol", "label", F.when(c("unit") == "m", c("value") * 1000).otherwise(c("value")).alias("design_mm"))

    many = readings.groupBy("drawing_id", "param").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("x_pct", "y_pct"), "ord").alias("at"))
    off = geometry_deviation(readings, wanted, ["drawing_id", "param"], "val_mm", "design_mm", "tol").join(many, ["drawing_id", "param"])
    near = F.struct(c("x_pct").alias("x"), c("y_pct").alias("y"), F.lit(5.0).alias("w"), F.lit(2.0).alias("h"))
    suffix = F.when(c("n") > 1, F.concat(F.lit(" (view near x="), whole(F.coalesce("x_pct", F.lit(50.0))).cast("string"), F.lit("%)"))).otherwise("")
    a = emit(off, ["drawing_id"], [F.lit(13), c("no"), *halves(c("ord"))],
             [(F.lit(True), issue("geometry", box=near, label=c("label"), w=whole(c("val_mm")), d=whole(c("design_mm")), suffix=suffix,
                                  pct=F.format_string("%.1f", c("diff_pct")), tol=c("tol")))])
    absent = wanted.filter("param = 'pilecap_depth'").join(readings.select("drawing_id", "param").distinct(), ["drawing_id", "param"], "left_anti")
    mid = F.struct(F.lit(50.0).alias("x"), F.lit(50.0).alias("y"), F.lit(5.0).alias("w"), F.lit(2.0).alias("h"))
    b = emit(absent, ["drawing_id"], [F.lit(13), c("no"), F.lit(0)], [(F.lit(True), issue("geometry_missing", box=mid, label=c("label")))])
    spread = spread_check(
        readings.join(wanted, ["drawing_id", "param"]), ["drawing_id", "param", "no", "label", "tol"], "val_mm", c("tol")
    ).join(many.select("drawing_id", "param", "at"), ["drawing_id", "param"])
    at = F.struct(c("at.x_pct").alias("x"), c("at.y_pct").alias("y"), F.lit(5.0).alias("w"), F.lit(2.0).alias("h"))
    e = emit(spread, ["drawing_id"], [F.lit(13), c("no"), F.lit(2147483647)], [(F.lit(True), issue("geometry_spread", box=at, label=c("label")))])
    return a.unionByName(b).unionByName(e)


# Cross sections -----------------------------------------------------------


def bundle_factor(text: Column) -> Column:
    return F.when(F.upper(text).rlike("BUNDLE|LEGGED"), 2).otherwise(1)


def section_bars(sections: DataFrame, drawing: DataFrame, piles: DataFrame) -> DataFrame:
    """Bars counted in a section against the schedule's total per pile and bundle."""
    c = F.col
    totals = drawing.groupBy(*BAR).agg(
        F.sum("count").alias("schedule_count"),
        F.min_by("reinforcement_text", F.when(F.coalesce("reinforcement_text", F.lit("")) != "", c("zone_ord"))).alias("text"),
    ).filter(N.present(c("schedule_count")))
    j = sections.filter("visual_count IS NOT NULL").join(totals, BAR).join(piles, "drawing_id", "left")
    bundle = F.when(c("is_bundle"), 2).otherwise(bundle_factor(c("text")))
    divisor = F.when(c("component") == "pile", F.coalesce(N.given(c("pile_count")), F.lit(1)) * bundle).otherwise(bundle)
    expected = F.bround(c("schedule_count") / F.greatest(divisor, F.lit(1))).cast("long")
    return j.withColumn("expected", expected).filter(c("visual_count") != c("expected"))


def section_spacing_issues(sections: DataFrame) -> DataFrame:
    """One issue per irregular spot of a section; an unexplained one counts as uneven."""
    from spanledger.functions.geo import marker_box

    c = F.col
    spots = F.when(
        ~c("spacing_uniform") & (F.coalesce(F.size("spacing_issues"), F.lit(0)) == 0),
        F.array(F.struct(F.lit("uneven").alias("type"), F.lit("").alias("location"), F.lit("").alias("description"), F.lit(None).cast("double").alias("angle_rad"))),
    ).otherwise(c("spacing_issues"))
    rows = sections.filter("visual_count IS NOT NULL").select("drawing_id", "section_name", "bar_mark", "bbox", F.posexplode(spots).alias("no", "s"))
    # How a kind of irregularity is called.
    kind = F.when(c("s.type") == "clustering", "bar clustering").when(c("s.type") == "gap", "gap between bars").when(c("s.type") == "missing_bar", "possible missing bar").otherwise(c("s.type"))
    place = F.when(c("s.location") != "", F.concat(F.lit(" at "), c("s.location"))).otherwise("")
    return emit(rows, ["drawing_id"], [F.lit(9), c("no")],
                [(F.lit(True), issue("section_spacing", box=marker_box(c("bbox"), c("s.angle_rad")), section=c("section_name"), mark=c("bar_mark"), kind=kind, place=place))])


# Title block and notes ----------------------------------------------------

REQUIRED_TITLE = ["drawing_number", "revision", "title", "drawn_by", "approved_by", "date", "scale"]


def title_check(fields: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Missing required title fields and malformed revisions.

    ``fields``: key, field, value; ``keys``: all drawings.
    """
    c = F.col
    given = fields.filter(F.coalesce("value", F.lit("")) != "").select(key, "field", "value")
    want = keys.select(key, F.posexplode(F.array(*[F.lit(f) for f in REQUIRED_TITLE])).alias("no", "field"))
    j = want.join(given, [key, "field"], "left")
    return emit(
        j, [key], [F.lit(2), c("no")],
        [
            (c("value").isNull(), issue("title_field", zone=F.lit("title_block"), name=c("field"))),
            ((c("field") == "revision") & ~F.trim("value").rlike(r"^R\d+$"), issue("title_revision", zone=F.lit("title_block"), name=c("value"))),
        ],
    )


def notes_check(notes: DataFrame, key: str) -> DataFrame:
    """Lap grade against pile grade; pile length and fixity within 1 % of the design.

    ``notes``: one row per drawing with lap_length_concrete_grade, concrete_pile,
    pile_length_m, pile_fixity_m and the design's pile_length, pile_fixity.
    """
    c, zone = F.col, F.lit("notes")
    lap, pile = c("lap_length_concrete_grade"), c("concrete_pile")
    return emit(
        notes, [key], [F.lit(3)],
        [
            (F.upper(lap) != F.upper(pile), issue("lap_grade", zone=zone, w=lap, d=pile)),
            (F.coalesce(lap, F.lit("")) == "", issue("lap_grade_missing", zone=zone)),
            (N.pct_diff(c("pile_length"), c("pile_length_m")) > 1, issue("pile_length", zone=zone, w=c("pile_length_m"), d=c("pile_length"))),
            (N.pct_diff(c("pile_fixity"), c("pile_fixity_m")) > 1, issue("pile_fixity", zone=zone, w=c("pile_fixity_m"), d=c("pile_fixity"))),
        ],
    )


# Merging sources ----------------------------------------------------------


def overlay(primary: DataFrame, secondary: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Field by field, the secondary source fills only what the primary lacks."""
    p = primary.select(*keys, *[F.col(f).alias(f"__p_{f}") for f in fields])
    s = secondary.select(*keys, *[F.col(f).alias(f"__s_{f}") for f in fields])
    return p.join(s, keys, "full").select(
        *keys, *[F.coalesce(f"__p_{f}", f"__s_{f}").alias(f) for f in fields]
    )


def overlay_present(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Presence flags of two sources: a true from either wins."""
    return a.select(*keys, "present").unionByName(b.select(*keys, "present")).groupBy(*keys).agg(
        F.bool_or("present").alias("present")
    )


def keyed_union(sources: list[DataFrame], keys: list[str], value: str) -> DataFrame:
    """Later non-empty values replace earlier ones under the same key."""
    ranked = [
        s.select(*keys, value).withColumn("__rank", F.lit(i)) for i, s in enumerate(sources)
    ]
    out = ranked[0]
    for r in ranked[1:]:
        out = out.unionByName(r)
    full = F.col(value).isNotNull() & (F.col(value).cast("string") != "")
    return out.filter(full).groupBy(*keys).agg(F.max_by(value, "__rank").alias(value))


def merge_design_files(files: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Parsed design files of a drawing as one design, and the files that could not be read.

    ``files``: keys, ord, name and body, the file's content as one JSON object. Returns
    (keys, field, value) with nested values as JSON, where later non-empty values replace
    earlier ones, and (keys, ord, name, message) of the damaged files: a file that is
    damaged does not keep the others from being read. An empty body is damaged too.
    """
    c = F.col
    parsed = files.withColumn("__v", F.from_json("body", "map<string,string>")).withColumn("__ok", F.try_parse_json("body").isNotNull())
    good = c("__v").isNotNull() & c("__ok")
    rows = parsed.filter(good).select(*keys, "ord", F.explode("__v").alias("field", "value"))
    # What counts as empty.
    full = rows.filter(~F.coalesce(F.trim("value"), F.lit("")).isin("", "{}", "[]", "null", "false", "0", "0.0"))
    merged = full.groupBy(*keys, "field").agg(F.max_by("value", "ord").alias("value"))
    broken = parsed.filter(~F.coalesce(good, F.lit(False)))
    return merged, broken.select(*keys, "ord", "name", F.concat("name", F.lit(": not readable")).alias("message"))


def running_header(rows: DataFrame, keys: list[str], order: list[str], header: Column, name: str) -> DataFrame:
    """Carry the latest header down its rows; rows before any header are dropped."""
    marked = rows.withColumn("__h", header)
    return ordered_scan(marked, keys, order, {name: Running("last", "__h")}).filter(F.col(name).isNotNull()).drop("__h")
