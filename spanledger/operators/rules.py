"""Coded rules and concepts kept as tables, and their evaluation over all drawings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanledger.functions.text import fill, number_g, strip
from spanledger.plans.scan import numbered
from spanledger.session import dealt

# Phrases by which a finding says that nothing is wrong.
NEGATIVE_PHRASES = [
    "no violation", "no issue", "no problem", "not violated", "not a violation",
    "appears compliant", "appears to comply", "complies with", "compliant with",
    "within acceptable", "no unwarranted", "does not violate", "doesn't violate",
]


def paths(parts: list[tuple[DataFrame, list[str | Column], Column]], key: str) -> DataFrame:
    """Dotted paths with their values from long tables.

    Each part is a table, the columns or literals that make up the path, and the
    value. Several values under one path make the path a list: such a path is
    present but has no single value. Rows are dealt by key and path, as they compress to
    a fraction of what they take in a task.
    """
    out = None
    for df, steps, value in parts:
        rows = df.select(key, F.concat_ws(".", *steps).alias("path"), value.cast("string").alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return (
        dealt(out.filter(F.coalesce("value", F.lit("")) != ""), key, "path")
        .groupBy(key, "path")
        .agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("v"))
        .select(key, "path", F.when(F.col("n") == 1, F.col("v")).alias("value"))
    )


def applicable_rules(rules: DataFrame, drawings: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """(drawing, rule) pairs of matching type with every required entity present.

    Types meet in an equi-join and entities in a relational division: a rule
    applies when as many of its entities are present as it requires. The rules, a
    registry that is read whole, go to the drawings; a drawing has at most one row for
    each entity that a rule requires.
    """
    by_type = rules.select("rule_id", F.explode("applicable_drawing_types").alias("drawing_type"), F.size(F.array_distinct("required_entities")).alias("needed")).distinct()
    typed = dealt(drawings.select(key, "drawing_type"), key).join(F.broadcast(by_type), "drawing_type")
    needs = rules.select("rule_id", F.explode("required_entities").alias("path")).distinct()
    wanted = present.select(key, "path").distinct().join(F.broadcast(needs.select("path").distinct()), "path")
    have = dealt(wanted, key).join(F.broadcast(needs), "path").groupBy(key).agg(F.collect_list("rule_id").alias("have"))
    met = F.coalesce(F.size(F.filter("have", lambda r: r == F.col("rule_id"))), F.lit(0))
    return typed.join(have, key, "left").filter(F.greatest(met, F.lit(0)) == F.col("needed")).select(key, "rule_id")


def rule_verdicts(rules: DataFrame, pairs: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """The outcome of each applicable deterministic rule.

    ``status`` is violated, passed or skipped with a reason: formula_ratio is not
    evaluated, and neither is a path without a single number.
    """
    r = rules.filter("rule_type = 'deterministic'").select(
        "rule_id", "title", "category", "severity", "unit", "message_template",
        F.col("formula.type").alias("kind"), F.col("formula.field").alias("path"),
        F.coalesce("formula.min_value", "formula.max_value", "formula.expected_value").alias("limit"),
    )
    # The rules' texts come after the values, so that they are in no shuffle.
    at = dealt(pairs.join(F.broadcast(r.select("rule_id", "path")), "rule_id"), key, "path")
    j = at.join(values.select(key, "path", "value"), [key, "path"], "left").join(F.broadcast(r.drop("path")), "rule_id")
    n = F.col("value").try_cast("double")
    kind, limit = F.col("kind"), F.col("limit")
    broken = (
        F.when(kind == "min_threshold", n < limit)
        .when(kind == "max_threshold", n > limit)
        .when(kind == "exact_match", n != limit)
    )
    reason = (
        F.when(kind == "formula_ratio", "formula_ratio")
        .when(F.col("value").isNull(), "absent")
        .when(n.isNull(), "not numeric")
        .when(broken.isNull(), "unknown formula")
    )
    shown = number_g(limit)
    message = fill(
        F.col("message_template"),
        {
            "value": number_g(n),
            "min_value": F.when(kind == "min_threshold", shown),
            "max_value": F.when(kind == "max_threshold", shown),
            "expected_value": F.when(kind == "exact_match", shown),
            "unit": F.coalesce("unit", F.lit("")),
        },
    )
    status = F.when(reason.isNotNull(), "skipped").when(broken, "violated").otherwise("passed")
    zone = F.when(F.col("path").startswith("notes."), "notes").otherwise("default")
    return j.select(
        key, "rule_id", "path", "value", "limit",
        status.alias("status"), reason.alias("reason"),
        "category", "severity",
        F.concat("title", F.lit(" ("), "rule_id", F.lit(")")).alias("title"),
        F.when(status == "violated", message).alias("description"),
        zone.alias("zone"),
    )


def says_nothing_wrong(desc: Column) -> Column:
    return F.lower(desc).rlike("|".join(NEGATIVE_PHRASES))


def judgment_issues(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings of known rules, without those that report no violation."""
    j = findings.join(rules.withColumnRenamed("title", "rule_title"), "rule_id")
    said = F.coalesce(F.nullif("description", F.lit("")), "rule_title")
    return (
        j.withColumn("__said", said)
        .filter(~says_nothing_wrong(F.col("__said")))
        .withColumn("title", F.concat("rule_title", F.lit(" ("), F.col("rule_id").cast("string"), F.lit(")")))
        .withColumn("description", F.concat("__said", F.lit(" (Source: "), "source_reference", F.lit(")")))
        .drop("__said", "rule_title")
    )


def relevant_concepts(concepts: DataFrame, drawings: DataFrame, key: str) -> DataFrame:
    """Concepts of the drawing's type that share a component with it.

    A drawing without detected components takes every concept of its type.
    ``drawings``: key, drawing_type, components (array).
    """
    by_type = concepts.select("concept_id", "applicable_components", F.explode("applicable_drawing_types").alias("drawing_type"))
    j = drawings.join(by_type, "drawing_type")
    none = F.coalesce(F.size("components"), F.lit(0)) <= 0
    return j.filter(none | F.arrays_overlap("applicable_components", "components")).select(key, "concept_id")


def detected_components(bars: DataFrame, key: str, component: str) -> DataFrame:
    return bars.groupBy(key).agg(F.array_sort(F.collect_set(component)).alias("components"))


def drawing_type(has_pile: Column, text: Column) -> Column:
    """The kind of drawing by what its schedule, labels and title name, first hit wins."""
    t = F.upper(text)
    return (
        F.when(has_pile | t.contains("PILE"), "Pile Pilecap Pier")
        .when(t.contains("ABUTMENT"), "Abutment")
        .when(t.rlike("SUPERSTRUCTURE|GIRDER|DECK"), "Superstructure")
        .when(t.contains("BEARING"), "Bearing")
        .otherwise("General")
    )


def summary_lines(bars: DataFrame, key: str) -> DataFrame:
    """The schedule part of a drawing's digest, one line per zone row.

    Lines carry (component, bar_mark, zone_ord) as their order; a mark with several
    zones numbers them. A digest of any length stays rows.
    """
    zones = bars.groupBy(key, "component", "bar_mark").agg(F.count(F.lit(1)).alias("zones"))
    c = F.col
    label = F.when(c("zones") > 1, F.concat("bar_mark", F.lit(" (zone "), c("zone_ord").cast("string"), F.lit(")"))).otherwise(c("bar_mark"))
    part = lambda name, col, unit: F.concat(F.lit(name + "="), F.col(col).cast("string"), F.lit(unit))
    values = F.concat_ws(
        ", ",
        F.concat(F.lit("dia="), F.coalesce(c("bar_dia_mm").cast("string"), F.lit("None")), F.lit("mm")),
        part("spacing", "spacing_mm", "mm"),
        part("count", "count", ""),
        part("length", "length_m", "m"),
    )
    return bars.join(zones, [key, "component", "bar_mark"]).select(
        key, F.upper("component").alias("section"), "bar_mark", "zone_ord",
        F.concat(F.lit("  "), label, F.lit(": "), values).alias("line"),
    )


def summary_digest(drawings: DataFrame, bars: DataFrame, geometry: DataFrame, notes: DataFrame, issues: DataFrame, key: str) -> DataFrame:
    """The whole digest of each drawing: key, line_no and line.

    ``geometry`` and ``notes`` have key, name and value (text; nulls are left out),
    ``issues`` key, ord, category and title. The parts are the components, their
    schedules, the geometry, the notes and what other checks found; a part without
    rows has no lines, but for the first and the last. A digest stays rows and is
    numbered in its order, whatever its length. Lines repeat and compress well, so they
    are dealt to all partitions and not merged by their compressed size.
    """
    c, text = F.col, "string"
    last = "\U0010ffff"  # after every name

    def lines(df: DataFrame, part: int, line, a="", b="", n=0) -> DataFrame:
        col = lambda v, kind: (F.lit(v) if isinstance(v, (str, int)) and not isinstance(v, bool) else v).cast(kind)
        return df.select(key, F.lit(part).alias("part"), col(a, text).alias("a"), col(b, text).alias("b"), col(n, "bigint").alias("n"), line.alias("line"))

    all_ = drawings.select(key).distinct()
    known = bars.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("component")), ", ").alias("c"))  # a fixed set of components
    present = all_.join(known, key, "left").select(key, F.concat(F.lit("Components present: "), F.coalesce("c", F.lit("(none detected)"))).alias("c"))
    schedules = bars.select(key, "component").distinct()
    zones = summary_lines(bars, key)
    out = [
        lines(all_, 0, F.lit("DRAWING SUMMARY")), lines(all_, 0, F.lit(""), n=1), lines(present, 1, c("c")), lines(all_, 1, F.lit(""), n=1),
        lines(schedules, 2, F.concat(F.upper("component"), F.lit(" schedule:")), F.upper("component"), "", -1),
        lines(zones, 2, c("line"), c("section"), c("bar_mark"), c("zone_ord")), lines(schedules, 2, F.lit(""), F.upper("component"), last),
    ]
    # The heads of the parts.
    heads = {3: "Geometry (dimensions extracted from drawing):", 4: "Notes:"}
    for part, rows in ((3, geometry), (4, notes)):
        given = rows.filter("value IS NOT NULL")
        own = given.select(key).distinct()
        row = F.concat(F.lit("  "), "name", F.lit(": "), c("value").cast(text))
        out += [lines(own, part, F.lit(heads[part]), "", "", -1), lines(given, part, row, c("name")), lines(own, part, F.lit(""), last)]
    flagged = issues.select(key).distinct()
    head = (
        "ALREADY-FLAGGED ISSUES (from the deterministic/rule/vision checks that already ran — for reference only, do not re-flag these "
        "individually; consider what they might indicate holistically):"
    )
    said = F.concat(F.lit("  ["), F.coalesce("category", F.lit("General")), F.lit("] "), F.coalesce("title", F.lit("")))
    none = F.lit("ALREADY-FLAGGED ISSUES: none found by the other checks.")
    out += [
        lines(flagged, 5, F.lit(head), "", "", -1), lines(issues, 5, said, "a", "", c("ord")),
        lines(all_.join(flagged, key, "left_anti"), 5, none, "", "", -1), lines(all_, 5, F.lit(""), last),
    ]
    union = out[0]
    for part in out[1:]:
        union = union.unionByName(part)
    return numbered(union, [key], ["part", "a", "b", "n"], "line_no", deal=True).select(key, "line_no", "line")


# Registry -----------------------------------------------------------------

RULE_SCHEMA = (
    "rule_id string, title string, applicable_drawing_types array<string>, applicable_components array<string>, "
    "required_entities array<string>, rule_type string, category string, engineering_rationale string, "
    "source_reference string, formula struct<type:string,field:string,min_value:double,max_value:double,"
    "expected_value:double,expression:string,compare_field:string,comparison:string,tolerance_pct:double>, "
    "reasoning_prompt string, unit string, severity string, message_template string, validation_status string"
)
CONCEPT_SCHEMA = (
    "concept_id string, title string, applicable_drawing_types array<string>, applicable_components array<string>, "
    "body string, source_reference string, topic_tags array<string>"
)

# What a rule must give and the words its fields may hold.
RULE_REQUIRED = ["rule_id", "title", "applicable_drawing_types", "required_entities", "rule_type", "category", "engineering_rationale", "source_reference"]
CONCEPT_REQUIRED = ["concept_id", "title", "applicable_drawing_types", "applicable_components", "body", "source_reference"]
RULE_TYPES = ["deterministic", "judgment"]
FORMULA_TYPES = ["min_threshold", "max_threshold", "exact_match", "formula_ratio"]
STATUSES = ["implemented", "pending_pilot_validation", "needs_real_example"]


def _lacking(df: DataFrame, required: list[str]) -> list[Column]:
    out = []
    for name in required:
        kind = df.schema[name].dataType.typeName()
        empty = F.coalesce(F.size(name), F.lit(0)) <= 0 if kind == "array" else F.coalesce(strip(F.col(name)), F.lit("")) == ""
        out.append(F.when(empty, F.lit(f"missing {name}")))
    return out


def rule_faults(rules: DataFrame) -> DataFrame:
    """Every fault of every rule: (rule_id, fault). An empty result means a sound registry."""
    c = F.col
    det, jud = c("rule_type") == "deterministic", c("rule_type") == "judgment"
    checks = _lacking(rules, RULE_REQUIRED) + [
        F.when(c("rule_type").isNotNull() & ~c("rule_type").isin(RULE_TYPES), "unknown rule_type"),
        F.when(det & c("formula").isNull(), "no formula"),
        F.when(det & c("formula").isNotNull() & ~F.coalesce(c("formula.type").isin(FORMULA_TYPES), F.lit(False)), "unknown formula type"),
        F.when(det & c("formula").isNotNull() & (F.coalesce("formula.field", F.lit("")) == ""), "formula without field"),
        F.when(det & (F.coalesce("message_template", F.lit("")) == ""), "no message_template"),
        F.when(jud & (F.coalesce("reasoning_prompt", F.lit("")) == ""), "no reasoning_prompt"),
        F.when(~F.coalesce("validation_status", F.lit(STATUSES[1])).isin(STATUSES), "unknown validation_status"),
    ]
    own = rules.select("rule_id", F.explode(F.array_compact(F.array(*checks))).alias("fault"))
    twice = rules.groupBy("rule_id").count().filter("count > 1").select("rule_id", F.lit("duplicate rule_id").alias("fault"))
    return own.unionByName(twice)


def concept_faults(concepts: DataFrame) -> DataFrame:
    own = concepts.select("concept_id", F.explode(F.array_compact(F.array(*_lacking(concepts, CONCEPT_REQUIRED)))).alias("fault"))
    twice = concepts.groupBy("concept_id").count().filter("count > 1").select("concept_id", F.lit("duplicate concept_id").alias("fault"))
    return own.unionByName(twice)


def load_rules(spark, path: str) -> DataFrame:
    """Read the rule registry (JSON lines); any fault is fatal."""
    rules = spark.read.schema(RULE_SCHEMA).json(path)
    _fail_on(rule_faults(rules))
    return rules.fillna({"severity": "error", "validation_status": STATUSES[1]})


def load_concepts(spark, path: str) -> DataFrame:
    concepts = spark.read.schema(CONCEPT_SCHEMA).json(path)
    _fail_on(concept_faults(concepts))
    return concepts


#: Faults that the error names; the others are counted.
SHOWN_FAULTS = 20


def _fail_on(faults: DataFrame) -> None:
    found = faults.limit(SHOWN_FAULTS).collect()
    if found:
        more = faults.count() - len(found)
        rest = [f"and {more} more"] if more else []
        raise ValueError("; ".join([f"{r[0]}: {r[1]}" for r in found] + rest))
