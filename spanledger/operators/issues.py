"""The issue row: message forms, building, defaults and saving."""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanledger.functions.geo import box_or_fallback
from spanledger.functions.text import strip

# Category and title of each finding. Titles identify an issue (the
# first of equal category and title is kept), so their wording is part of the result.
# The third text is the description; it states design and drawing values in the
# forms that COMPARISON_FORMS reads back.
MESSAGES = {
    "no_design": ("Input", "No design input provided", "There is no design input; most checks could not run."),
    "no_drawing": ("Extraction", "Drawing data extraction failed", "Nothing could be read from the drawing."),
    "no_schedule": ("Configuration", "DXF extraction returned no schedule data", "The drawing holds no reinforcement schedule."),
    "no_vision": ("Configuration", "AI vision extraction failed", "The page review returned no data."),
    "component_missing": ("Reinforcement", "{Comp} schedule not found in drawing", "The {comp} schedule could not be read from the drawing."),
    "mark_missing": ("Reinforcement", "Bar mark '{mark}' ({comp}) not found in drawing schedule", "Bar mark '{mark}' is in the design but not in the {comp} schedule."),
    "companion_order": ("Reinforcement", "Bar mark '{mark}' listed before '{base}' in {comp} schedule", "The base mark '{base}' has to come first, '{mark}' below it."),
    "bar_dia": ("Bar Diameter", "Bar '{mark}' ({comp}): Diameter mismatch — design {d}mm, drawing {w}mm", "Design input specifies {d}mm diameter for bar '{mark}' ({comp}). Drawing shows {w}mm."),
    "bar_spacing": ("Bar Spacing", "Bar '{mark}' ({comp}): Spacing mismatch — design {d}mm c/c, drawing {w}mm c/c", "Design input specifies {d}mm c/c for bar '{mark}' ({comp}). Drawing shows {w}mm c/c."),
    "bar_spacing_missing": ("Bar Spacing", "Bar '{mark}' ({comp}): Spacing not found in drawing ({d}mm expected)", "Design input specifies spacing of {d}mm c/c for bar '{mark}'; the schedule shows none."),
    "bar_length": ("Bar Length", "Bar '{mark}' ({comp}): Bar length mismatch — design {d}m, drawing {w}m", "Design input bar length = {d}m for '{mark}' ({comp}). Drawing shows {w}m."),
    "bar_unit_weight": ("Bar Unit Weight", "Bar '{mark}' ({comp}): Unit weight mismatch — design {d} kg/m, drawing {w} kg/m", "Design input unit weight = {d} kg/m for '{mark}' ({comp}). Drawing schedule shows {w} kg/m."),
    "reinf_kind": ("Reinforcement", "Bar '{mark}' ({comp}): Reinforcement column format wrong — shows {w}, expected {d}", "Bar '{mark}' ({comp}): the reinforcement text is not in the expected form."),
    "reinf_spacing": ("Reinforcement", "Bar '{mark}' ({comp}): Reinforcement column spacing mismatch — design {d}mm, drawing text {w}mm", "Bar '{mark}' ({comp}): the reinforcement text gives {w}mm c/c, the design {d}mm c/c."),
    "reinf_count": ("Reinforcement", "Bar '{mark}' ({comp}): Reinforcement column count mismatch — design {d} NOS, drawing text {w} NOS", "Bar '{mark}' ({comp}): the reinforcement text gives {w} NOS, the design {d} NOS."),
    "bar_shape": ("Bar Shape", "Bar '{mark}' ({comp}): Bar shape dimension mismatch — design {d}mm, drawing {w}mm", "Bar '{mark}' ({comp}): design input has segment {d}mm but closest value in drawing is {w}mm."),
    "bar_count": ("Bar Count", "Bar '{mark}' ({comp}): Count mismatch — design {d} nos, drawing {w} nos", "Design input specifies {d} bars for '{mark}' ({comp}). Drawing schedule shows {w} bars."),
    "bar_total_length": ("Bar Total Length", "Bar '{mark}' ({comp}): Total length mismatch — design {d}m, drawing {w}m", "Design input total length = {d}m for '{mark}' ({comp}). Drawing schedule shows {w}m."),
    "bar_weight": ("Bar Weight", "Bar '{mark}' ({comp}): Total weight mismatch — design {d}kg, drawing {w}kg", "Design input total weight = {d}kg for bar '{mark}' ({comp}). Drawing schedule shows {w}kg."),
    "zone_rows": ("Reinforcement", "Bar '{mark}' ({comp}): {label} differs between drawing zone-rows — row {row1}: {d}{unit}, row {row2}: {w}{unit}", "Bar '{mark}' ({comp}): {label} should be the same in all its schedule rows."),
    "geometry": ("Geometric Dimensions", "{label}: drawn {w}mm ≠ design {d}mm{suffix}", "{label} drawn as {w}mm but design specifies {d}mm. Difference: {pct}% (tolerance {tol}%)."),
    "geometry_missing": ("Geometric Dimensions", "{label}: not found in drawing", "{label} is in the design but no such dimension is drawn."),
    "geometry_spread": ("Geometric Dimensions", "{label}: inconsistent between drawing views", "{label} measures differently in the views of the drawing."),
    "section_spacing": ("Section Spacing", "Section {section}: bar '{mark}' — {kind}{place}", "In Section {section}, the '{mark}' bars show {kind}."),
    "section_count": ("Section Bar Count", "Section {section}: bar '{mark}' count — drawn {w}, expected {d}", "In Section {section}, {w} bar(s) are drawn for '{mark}' ({comp}). Expected {d}."),
    "view_missing": ("Missing Views", "Missing view: {name}", "\"{name}\" was not found in the drawing."),
    "section_missing": ("Missing Views", "Missing section view: {name}", "Cut marks for \"{name}\" are shown but the view is not drawn."),
    "arrow_missing": ("Missing Views", "Missing cut-mark arrow: {name}", "The view for \"{name}\" is drawn but no such cut arrow."),
    "view_unlabeled": ("Missing Views", "Unlabeled view: {name}", "{name}. Every view needs a title label."),
    "note_missing": ("Notes", "{name}", "A required note was not found in the drawing text."),
    "pile_info_missing": ("Notes", "Pile related info missing: {name}", "These pile notes were not found: {name}."),
    "lap_grade": ("Notes", "Lap length table references {w} but pile concrete is {d}", "The lap length table and the pile concrete grade must match."),
    "lap_grade_missing": ("Notes", "Lap length concrete grade not found", "The grade of the lap length table could not be read."),
    "pile_length": ("Notes", "Pile length mismatch: note says {w}m, design says {d}m", "The pile length note differs from the design."),
    "pile_fixity": ("Notes", "Pile fixity mismatch: note says {w}m, design says {d}m", "The pile fixity note differs from the design."),
    "title_field": ("Title Block", "Missing field: {name}", "The field \"{name}\" is empty or could not be read."),
    "title_revision": ("Title Block", "Revision format invalid: \"{name}\"", "A revision reads R0, R1, R2 and so on."),
    "callout_merged": ("Bar Mark Callouts", "Merged bar-mark callout '{name}' — should be two separate leaders", "Each zone needs a leader of its own."),
    "callout_missing": ("Bar Mark Callouts", "Bar mark '{mark}' not called out in section view", "The mark is in the schedule but has no leader in any view."),
    "label_error": ("Label Errors", "{name}", "{name}"),
    "dimension_error": ("Dimension Errors", "{name}", "{name}"),
    "stray_box": ("Drawing Quality", "Stray box / erroneous outline", "{name}"),
    "notes_grade": ("Notes", "{name}", "{text}"),
    "diagnostic": ("Extraction", "{name}", "{text}"),
    "design_unreadable": ("Input", "Design input could not be parsed", "{name}"),
    "system": ("System", "Processing failed", "{name}"),
}

ISSUE = (
    "code string, category string, title string, description string, suggestion string, "
    "severity string, page_num int, x double, y double, width double, height double"
)


BOX = "struct<x:double,y:double,w:double,h:double>"


@dataclass(frozen=True)
class Finding:
    """What one issue needs: its code, the values its texts name, and its place."""

    code: str
    values: dict[str, Column]
    box: Column | None
    zone: Column | None
    nobox: bool


def issue(code: str, box: Column | None = None, zone: Column | None = None, nobox: bool = False, **values: Column) -> Finding:
    """The box is ``box`` where usable, else the fixed box of ``zone``; ``nobox``
    leaves the four numbers NULL."""
    named = set(re.findall(r"\{(\w+)\}", " ".join(MESSAGES[code])))
    given = {k: v for k, v in values.items() if k in named}
    if "Comp" in named:
        given["Comp"] = F.initcap(values["comp"])
    return Finding(code, given, box, zone, nobox)


def _by_no(options: list, make) -> Column:
    """One column if all findings share it, else a choice by finding number."""
    if all(o is options[0] for o in options):
        return make(options[0])
    out = make(options[0])
    for i, o in list(enumerate(options))[1:]:
        out = F.when(F.col("__no") == i, make(o)).otherwise(out)
    return out


def _values(found: list[Finding]) -> dict[str, Column]:
    """Each name that the findings give a value, and the value of a row's finding as text.

    One choice a name keeps the code of a row small: Java does not compile large methods.
    """
    out = {}
    for name in dict.fromkeys(k for f in found for k in f.values):
        unnamed = F.lit("{" + name + "}")
        own = [f.values.get(name, unnamed) for f in found]
        out[name] = _by_no(own, lambda v: v if v is unnamed else F.coalesce(v.cast("string"), F.lit("")))
    return out


def _text(column: int, found: list[Finding], values: dict[str, Column]) -> Column:
    """The text forms of the findings, filled in: their pieces and values in turn."""
    # Text, name, text, name and so on, to a text.
    forms = [re.split(r"\{(\w+)\}", MESSAGES[f.code][column]) for f in found]
    length = max(map(len, forms))
    forms = [[*x, *[None] * (length - len(x))] for x in forms]

    def filled(name: str | None) -> Column:
        return F.lit("") if name is None else values.get(name, F.lit("{" + name + "}"))

    out = []
    for at, options in enumerate(zip(*forms)):
        if at % 2 == 0:
            texts = [x or "" for x in options]
            out.append(F.lit(texts[0]) if len(set(texts)) == 1 else F.get(F.array(*[F.lit(x) for x in texts]), F.col("__no")))
        else:
            first, *others = dict.fromkeys(options)
            value = filled(first)
            for name in others:
                value = F.when(F.col("__no").isin([i for i, x in enumerate(options) if x == name]), filled(name)).otherwise(value)
            out.append(value)
    return F.concat(*out)


def emit(df: DataFrame, keys: list[str], ord_cols: list[Column], candidates: list[tuple[Column, Finding]]) -> DataFrame:
    """One row per candidate whose condition holds.

    ``candidates`` are (condition, issue) pairs of one input row; ``ord`` becomes
    the given numbers followed by the candidate's own.
    """
    if len(candidates) == 1:
        cond, only = candidates[0]
        return described(df.filter(cond).withColumn("__no", F.lit(0)), keys, F.array(*[c.cast("int") for c in ord_cols], F.lit(0)), [only])
    # Values are collected and texts built after the conditions have thinned the rows out.
    # (The outer form keeps Spark from testing the conditions in a filter of their own.)
    rows = df.withColumn("__mask", held(candidates)).withColumn("__no", F.explode_outer(held_nos(len(candidates)))).filter("__no IS NOT NULL")
    return described(rows, keys, F.array(*[c.cast("int") for c in ord_cols], F.col("__no")), [f for _, f in candidates])


def halves(order: Column) -> list[Column]:
    """A number of any size as two ints that sort like it, for ``ord``."""
    n = order.cast("long")
    return [F.shiftright(n, 32), n.bitwiseAND(F.lit(0xFFFFFFFF)) - F.lit(1 << 31)]


def held(candidates: list[tuple[Column, Finding]]) -> Column:
    """One bit for each candidate whose condition holds.

    Conditions inside a lambda, or in an array that one goes through, would be interpreted.
    """
    return functools.reduce(lambda a, b: a.bitwiseOR(b), [F.when(cond, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, (cond, _) in enumerate(candidates)])


def held_nos(n: int) -> Column:
    """The numbers of the bits that are set in ``__mask``."""
    return F.filter(F.array(*[F.lit(i) for i in range(n)]), lambda i: F.getbit("__mask", i) == 1)


def described(rows: DataFrame, keys: list[str], order: Column, found: list[Finding]) -> DataFrame:
    """Rows whose ``__no`` names one of ``found`` as issues."""
    values = _values(found)
    raw = rows.select(
        *keys,
        order.alias("ord"),
        F.get(F.array(*[F.lit(f.code) for f in found]), F.col("__no")).alias("code"),
        F.get(F.array(*[F.lit(MESSAGES[f.code][0]) for f in found]), F.col("__no")).alias("category"),
        _text(1, found, values).alias("title"),
        _text(2, found, values).alias("description"),
        _by_no([f.zone for f in found], lambda z: F.lit("default") if z is None else z).alias("__zone"),
        _by_no([f.box for f in found], lambda b: F.lit(None).cast(BOX) if b is None else b.cast(BOX)).alias("__box"),
        _by_no([f.nobox for f in found], F.lit).alias("__nobox"),
    )
    whole = F.when(~F.col("__nobox"), box_or_fallback(F.col("__zone"), F.col("__box")))
    return raw.select(
        *keys,
        "ord",
        "code",
        "category",
        "title",
        "description",
        F.lit("Review and correct.").alias("suggestion"),
        F.lit("error").alias("severity"),
        F.lit(1).alias("page_num"),
        whole.alias("__b"),
    ).select("*", *[F.col(f"__b.{k}").alias(n) for k, n in zip("xywh", ("x", "y", "width", "height"))]).drop("__b")


def union_all(parts: list[DataFrame]) -> DataFrame:
    """The outputs of all checks in one table."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def saved_issues(raw: DataFrame, review: str, fields: str) -> DataFrame:
    """Rows ready to save from a map of given fields.

    A default applies only where a field is absent; an explicit NULL stays NULL.
    """
    # Defaults of a saved issue.
    defaults = {
        "category": ("General", "string"),
        "title": ("Issue", "string"),
        "description": ("", "string"),
        "suggestion": ("", "string"),
        "severity": ("error", "string"),
        "page_num": ("1", "int"),
        "x": ("5", "double"),
        "y": ("5", "double"),
        "width": ("20", "double"),
        "height": ("10", "double"),
    }
    m = F.col(fields)
    cols = [
        F.when(F.map_contains_key(m, name), F.try_element_at(m, F.lit(name)))
        .otherwise(F.lit(value))
        .try_cast(kind)
        .alias(name)
        for name, (value, kind) in defaults.items()
    ]
    return raw.select(
        F.uuid().alias("id"),
        review,
        *cols,
        F.lit("open").alias("status"),
        F.try_element_at(m, F.lit("confidence")).alias("confidence"),
    )


def reasoning_issues(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Reviewer findings as issues; an unknown confidence reads as the most careful one."""
    known = F.col("confidence").isin("definite", "probable", "needs_verification")
    return findings.select(
        *keys,
        F.lit("AI Reasoning").alias("category"),
        F.coalesce(F.nullif("title", F.lit("")), F.lit("Engineering observation")).alias("title"),
        F.coalesce("description", F.lit("")).alias("description"),
        F.lit("error").alias("severity"),
        F.when(known, F.col("confidence")).otherwise("needs_verification").alias("confidence"),
    )


def passthrough(items: DataFrame, keys: list[str], code: str, check: int) -> DataFrame:
    """Listed findings (description, box, ord) as issues; empty descriptions are none."""
    said = items.filter(strip(F.col("description")) != "")
    return emit(
        said, keys, [F.lit(check), F.col("ord")],
        [(F.lit(True), issue(code, box=F.col("bbox"), name=F.col("description")))],
    )


def degraded(issues: DataFrame, status: DataFrame, key: str) -> DataFrame:
    """Adapt the issues of drawings whose extraction fell short.

    ``status`` has has_design, has_schedule, has_title, from_pdf per drawing. Without
    a design, or with neither schedule nor title, a drawing gets one issue and no
    checks. Without a schedule one Configuration issue comes first, and on the PDF
    path the schedule and level categories go.
    """
    s = F.col
    blocked = ~s("has_design") | (~s("has_schedule") & ~s("has_title"))
    j = issues.join(status, key)
    kept = j.filter(
        ~blocked
        & (s("has_schedule") | ~s("from_pdf") | ~s("category").isin("Reinforcement", "Levels (TABLE-1)"))
    ).select(*issues.columns)
    own = emit(
        status, [key], [F.lit(-1)],
        [
            (~s("has_schedule") & ~s("from_pdf"), issue("no_schedule")),
            (~s("has_schedule") & s("from_pdf"), issue("no_vision")),
            (~s("has_design"), issue("no_design")),
            (s("has_design") & blocked, issue("no_drawing")),
        ],
    )
    return union_all([own, kept])
