"""View labels, cut marks, notes and other text found on sheets."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanledger.functions.numbers import safe_float
from spanledger.functions.text import first_group, let, normal_hyphens, strip
from spanledger.plans.containment import contained
from spanledger.plans.durable import durable

# Required views and the words that show them.
REQUIRED_SECTIONS = {
    "SECTION A-A FOR PILE": ["A-A FOR PILE"],
    "SECTION Z-Z (PILE)": ["Z-Z"],
    "SECTION A-A FOR PILECAP & PIER": ["A-A FOR PILECAP"],
    "SECTION B-B FOR PILECAP & PIER": ["B-B FOR PILECAP"],
    "PLAN OF PILECAP": ["PLAN OF PILECAP"],
    "REINFORCEMENT PLAN OF PILECAP": ["REINFORCEMENT PLAN"],
    "TABLE-1": ["TABLE-1", "TABLE 1"],
    "LAP LENGTH TABLE": ["LAP LENGTH"],
    "SCHEDULE OF REINFORCEMENT": ["SCHEDULE OF REINFORCEMENT"],
}

# Words that show that a note is given.
NOTE_KEYWORDS = {
    "pile_length": ["PILE LENGTH", "LENGTH OF PILE"],
    "pile_fixity": ["FIXITY", "FIX. LENGTH", "FIX LENGTH", "FIXATION"],
    "pile_diameter": ["PILE DIA", "DIAMETER OF PILE", "PILE DIAMETER"],
    "concrete_pile": ["M30", "M35", "M40", "M45", "M50"],
    "concrete_pilecap": ["M30", "M35", "M40", "M45", "M50"],
    "concrete_pier": ["M30", "M35", "M40", "M45", "M50"],
    "steel_grade": ["FE415", "FE500", "FE550", "FE 415", "FE 500", "FE 550", "FE-415", "FE-500", "FE-550", "HYSD", "TMT"],
    "irc_code_ref": ["IRC:", "IRC-", "IRC "],
}

# How note values are written.
NOTE_NUMBERS = {
    "pile_length_m": (r"PILE\s+LENGTH\s*[=:]\s*([\d.]+)\s*M?", 1),
    "pile_fixity_m": (r"FIXITY\s*[=:]\s*([\d.]+)\s*M?|FIX\.?\s*LENGTH\s*[=:]\s*([\d.]+)", 2),
    "pile_dia_m": (r"PILE\s+DIA\.?\s*[=:]\s*([\d.]+)\s*M?", 1),
    "max_pile_load_t": (r"MAX\.?\s+(?:SAFE\s+)?PILE\s+LOAD\s*[=:]\s*([\d.]+)\s*T", 1),
    "clear_cover_mm": (r"CLEAR\s+COVER\s+TO\s+ANY\s+REINFORCEMENT\s*[=:]\s*([\d.]+)\s*MM", 1),
}
NOTE_TEXTS = {
    "steel_grade": (r"\b(Fe\s*-?\s*\d+[A-Z]*|FE\s*-?\s*\d+[A-Z]*|HYSD|TMT)\b", 1),
    "lap_length_concrete_grade": (r"LAP\s+LENGTH\b[^.!?\n]{0,120}?\b(M\d+)\b", 1),
}
GRADES = r"\b(M30|M35|M40|M45|M50)\b"

# Words of a source that make a cut mark a text reference.
TABLE_WORDS = ["lap length", "schedule of reinforcement", "table-1", "table 1", "referenced in", "notes", "annotation"]

# Title block template prompts that count as missing.
PLACEHOLDERS = [
    "DRAWN BY", "DRAWN", "APPROVED BY", "APPROVED", "DESIGN BY", "DESIGNED BY", "CHECKED BY", "CHECKED",
    "NAME", "INITIALS", "SIGNATURE", "DATE", "SCALE", "REVISION", "REV", "TITLE", "DRAWING NO",
    "DRAWING NUMBER", "DRG NO", "SPAN", "SPANS",
]

# Attribute tags of a title block and the fields they fill.
TITLE_TAGS = {
    "drawing_number": ["DWG_NO", "DRG_NO", "DRAWING_NO", "DRAWING_NUMBER", "DWG_NUMBER"],
    "revision": ["REV", "REVISION", "REV_NO"],
    "title": ["TITLE", "DWG_TITLE", "DRAWING_TITLE"],
    "date": ["DATE", "DRAWN_DATE", "DRG_DATE"],
    "drawn_by": ["DRAWN", "DRAWN_BY", "DRAWNBY"],
    "design_by": ["DESIGN", "DESIGN_BY", "DESIGNED", "DESIGNEDBY"],
    "approved_by": ["APPROVED", "APPROVED_BY", "APPROVEDBY", "CHECKED_BY"],
    "scale": ["SCALE", "DRAWING_SCALE"],
    "project_name": ["PROJECT", "PROJECT_NAME", "PROJ_NAME"],
    "spans": ["SPANS", "SPAN"],
}


def attribute_fields(attributes: DataFrame, key: str, tag: str, value: str, order: str) -> DataFrame:
    """Title fields from typed attributes; the last value of a field counts."""
    known = F.create_map(*[F.lit(x) for f, tags in TITLE_TAGS.items() for t in tags for x in (t, f)])
    v = strip(F.col(value))
    rows = attributes.select(
        key, order, F.try_element_at(known, F.upper(strip(F.col(tag)))).alias("field"), v.alias("value")
    ).filter(F.col("field").isNotNull() & (F.col("value") != "") & ~F.upper("value").isin(PLACEHOLDERS))
    return rows.groupBy(key, "field").agg(F.max_by("value", order).alias("value"))


def free_keyword(keyword: str, others: list[str]) -> str:
    """A pattern for ``keyword`` where no longer one of ``others`` covers it."""
    k = re.escape(keyword)
    guards = ""
    for other in others:
        if len(other) <= len(keyword):
            continue
        at = other.find(keyword)
        while at >= 0:
            before, after = re.escape(other[:at]), re.escape(other[at + len(keyword):])
            guards += f"(?!(?<={before}){k}{after})" if before else f"(?!{k}{after})"
            at = other.find(keyword, at + 1)
    return guards + k


def section_hits(label: Column, sections: dict[str, list[str]]) -> Column:
    """The names of the sections a label shows, as an array.

    The first keyword of a section found in the label has to occur somewhere outside
    every longer keyword of another section.
    """
    hits = []
    for name, words in sections.items():
        others = [w for n, ws in sections.items() if n != name for w in ws]
        shown = F.lit(False)
        for word in reversed(words):
            shown = F.when(label.contains(word), label.rlike(free_keyword(word, others))).otherwise(shown)
        hits.append(F.when(shown, F.lit(name)))
    return F.array_compact(F.array(*hits))


def required_sections(labels: DataFrame, keys: DataFrame, key: str, label: str, order: str, sections: dict[str, list[str]], carry: str) -> DataFrame:
    """Presence of each required section on each sheet, with the first label that shows it."""
    shown = labels.select(key, order, carry, F.explode_outer(let(F.upper(label), lambda u: section_hits(u, sections))).alias("name")).filter("name IS NOT NULL")
    first = shown.groupBy(key, "name").agg(F.min_by(carry, order).alias(carry))
    wanted = keys.select(key, F.explode(F.array(*[F.lit(n) for n in sections])).alias("name"))
    return wanted.join(first.withColumn("__hit", F.lit(True)), [key, "name"], "left").select(
        key, "name", F.coalesce("__hit", F.lit(False)).alias("present"), carry
    )


def note_hits(text: Column, keywords: dict[str, list[str]]) -> Column:
    def found(t: Column) -> Column:
        hits = []
        for item, words in keywords.items():
            any_ = F.lit(False)
            for w in words:
                any_ = any_ | t.contains(w.upper())
            hits.append(F.when(any_, F.lit(item)))
        return F.array_compact(F.array(*hits))

    return let(normal_hyphens(F.upper(text)), found)


def required_notes(texts: DataFrame, keys: DataFrame, key: str, text: str, keywords: dict[str, list[str]]) -> DataFrame:
    """Presence of each note item on each sheet."""
    seen = texts.select(key, F.explode_outer(note_hits(F.col(text), keywords)).alias("item")).filter("item IS NOT NULL").distinct()
    wanted = keys.select(key, F.explode(F.array(*[F.lit(i) for i in keywords])).alias("item"))
    return wanted.join(seen.withColumn("present", F.lit(True)), [key, "item"], "left").fillna(False, ["present"])


def missing_notes(presence: DataFrame, key: str) -> DataFrame:
    """Note findings: missing items, and one finding for the pile items together.

    Any concrete grade covers all three components.
    """
    # What is said of a missing note, and the pile items' names.
    said = {
        "concrete_pile": "Concrete grade for pile not specified in notes",
        "concrete_pilecap": "Concrete grade for pilecap not specified in notes",
        "concrete_pier": "Concrete grade for pier not specified in notes",
        "steel_grade": "Steel grade (Fe415/Fe500/Fe550) not specified in notes",
    }
    pile = {"pile_diameter": "diameter", "pile_length": "length", "pile_fixity": "fixity length"}
    g = presence.groupBy(key).agg(
        F.bool_or(F.col("present") & F.col("item").startswith("concrete_")).alias("concrete"),
        *[F.bool_or(F.col("present") & (F.col("item") == i)).alias(i) for i in ["steel_grade", *pile]],
    )
    concrete = [F.when(~F.col("concrete"), F.lit(said[i])) for i in said if i.startswith("concrete")]
    steel = F.when(~F.col("steel_grade"), F.lit(said["steel_grade"]))
    lacking = F.concat_ws(", ", *[F.when(~F.col(i), F.lit(n)) for i, n in pile.items()])
    info = F.when(lacking != "", F.concat(F.lit("Pile related info missing: "), lacking))
    return g.select(key, F.posexplode(F.array_compact(F.array(*concrete, steel, info))).alias("ord", "title"))


def note_values(text: Column) -> dict[str, Column]:
    """Note values read from a sheet's note text."""
    t = F.upper(text)
    out = {}
    for name, (pattern, groups) in NOTE_NUMBERS.items():
        out[name] = safe_float(first_group(t, pattern, groups))
    for name, (pattern, groups) in NOTE_TEXTS.items():
        out[name] = F.regexp_replace(first_group(t, pattern, groups), r"\s+", "")
    return out


def note_grades(lines: DataFrame, key: str, line: str, order: str) -> DataFrame:
    """Concrete grade per component from note lines in order.

    Lap lines do not count. A line naming a component sets it if it is unset;
    any other grade line sets all that are unset.
    """
    u = F.upper(line)
    target = F.when(u.contains("PILECAP"), "pilecap").when(u.contains("PILE"), "pile").when(u.contains("PIER"), "pier")
    graded = lines.filter(~u.rlike(r"\b(LAP|OVERLAP)\b")).select(
        key, order, F.nullif(F.regexp_extract(u, GRADES, 1), F.lit("")).alias("grade"), target.alias("target")
    ).filter("grade IS NOT NULL")
    # A component is set by the first of: a line naming it, or a line setting all.
    # A line names its component without effect on the others only the first time.
    firsts = graded.filter("target IS NOT NULL").groupBy(key, "target").agg(F.min(order).alias("own"))
    spread = (
        graded.join(firsts, [key, "target"], "left")
        .filter(F.col("target").isNull() | (F.col(order) > F.col("own")))
        .groupBy(key).agg(F.min_by(F.struct(order, "grade"), order).alias("all"))
    )
    own = graded.groupBy(key, "target").agg(F.min_by(F.struct(order, "grade"), order).alias("own"))
    wide = graded.select(key).distinct().withColumn("component", F.explode(F.array(*[F.lit(c) for c in ("pilecap", "pile", "pier")])))
    j = wide.join(own.filter("target IS NOT NULL").withColumnRenamed("target", "component"), [key, "component"], "left").join(spread, key, "left")
    pick = F.when(F.col("own").isNull(), F.col("all")).when(F.col("all").isNull(), F.col("own")).otherwise(F.least("own", "all"))
    return j.select(key, "component", pick["grade"].alias("grade")).filter("grade IS NOT NULL")


def cut_marks(texts: DataFrame, keys: list[str], mark: Column, y: str, band: Column) -> DataFrame:
    """Marks seen at least twice, without axis labels (three or more in one band)."""
    seen = texts.withColumn("mark", mark).filter("mark IS NOT NULL").withColumn("__band", band)
    g = seen.groupBy(*keys, "mark").agg(F.count(F.lit(1)).alias("n"), (F.max(y) - F.min(y)).alias("spread"), F.max("__band").alias("band"))
    axis = (F.col("n") >= 3) & (F.col("spread") <= F.col("band"))
    return g.filter((F.col("n") >= 2) & ~axis).select(*keys, "mark", "n")


def letter_mark(text: Column, from_block: Column, is_attrib: Column) -> Column:
    """A single capital or a compound mark such as Z1; block text only if typed by a user."""
    s = strip(text)
    return F.when((~from_block | is_attrib) & s.rlike(r"^[A-Z](\d{1,2})?$"), s)


def titled_letters(labels: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Letters of all ``SECTION X-X`` titles in the labels."""
    found = F.regexp_extract_all(F.upper(label), F.lit(r"SECTION\s+([A-Z])-\1"), F.lit(1))
    return labels.select(*keys, F.explode(found).alias("mark")).distinct()


def missing_sections(marks: DataFrame, labels: DataFrame, keys: list[str], label: str) -> DataFrame:
    return marks.filter("mark RLIKE '^[A-Z]$'").join(titled_letters(labels, keys, label), [*keys, "mark"], "left_anti")


def unreferenced_views(labels: DataFrame, marks: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Labels ``SECTION Z1-Z1`` for which no ``Z1`` arrow was seen."""
    m = F.nullif(F.regexp_extract(F.upper(label), r"SECTION\s+([A-Z]\d{1,2})-\1", 1), F.lit(""))
    return labels.withColumn("mark", m).filter("mark IS NOT NULL").join(marks.select(*keys, "mark"), [*keys, "mark"], "left_anti")


def missing_details(texts: DataFrame, labels: DataFrame, keys: list[str], text: str, label: str) -> DataFrame:
    """Letters of ``DETAIL X`` mentioned in texts (first per text) that no label names."""
    said = texts.select(*keys, F.nullif(F.regexp_extract(F.upper(text), r"\bDETAILS?\s+([A-Z])\b", 1), F.lit("")).alias("mark")).filter("mark IS NOT NULL").distinct()
    shown = labels.select(*keys, F.explode(F.regexp_extract_all(F.upper(label), F.lit(r"\bDETAILS?\s+([A-Z])\b"), F.lit(1))).alias("mark")).distinct()
    return said.join(shown, [*keys, "mark"], "left_anti")


def is_table_reference(found_on: Column) -> Column:
    return F.lower(found_on).rlike("|".join(re.escape(w) for w in TABLE_WORDS))


def duplicate_headers(cells: DataFrame, keys: list[str], text: str, word: str, x: str, y: str) -> DataFrame:
    """Header texts that occur twice in one table window, with their mean place."""
    norm = F.upper(F.regexp_replace(strip(F.col(text)), r"\s+", " "))
    return (
        cells.filter(F.col(text).rlike(word)).withColumn("header", norm)
        .groupBy(*keys, "header")
        .agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("x"), F.avg(y).alias("y"))
        .filter("n >= 2")
    )


def section_box(issues: DataFrame, labels: DataFrame, key: str, issue_id: str, text: str, sections: DataFrame | None = None) -> DataFrame:
    """The box of the view an issue text names: key, issue_id, label, space and box.

    Sources come in this order, and each in its own: labels in PDF space, ``sections``,
    labels in DXF space. A label matches if the text holds the whole label or one of
    its words of five letters or more; a section if it holds the name, or what stands
    before its first bracket if that has six letters or more. ``labels``: key, label,
    space, ord, box; ``sections``: key, name, ord, box. Case does not matter; rows
    without a box or with a blank name match nothing.
    """
    c = F.col
    up = F.upper("label")
    long = F.filter(F.split(up, r"\s+"), lambda w: F.length(w) >= 5)
    named = labels.select(
        key, "label", "space", F.struct(F.when(c("space") == "dxf", 2).otherwise(0).alias("source"), "ord").alias("rank"), "box",
        F.explode(F.array_distinct(F.concat(F.array(up), long))).alias("needle"),
    )
    if sections is not None:
        name = F.upper(F.trim("name"))
        short = F.trim(F.substring_index(name, "(", 1))
        parts = F.array_compact(F.array(name, F.when(F.length(short) >= 6, short)))
        named = named.unionByName(
            sections.select(
                key, c("name").alias("label"), F.lit("list").alias("space"), F.struct(F.lit(1).alias("source"), "ord").alias("rank"), "box",
                F.explode(F.array_distinct(parts)).alias("needle"),
            )
        )
    # Of all names that a text matches by the same words only the first counts.
    known = named.filter(c("box").isNotNull() & c("needle").rlike(r"\S")).groupBy(key, "needle").agg(F.min_by(F.struct("rank", "label", "space", "box"), "rank").alias("best"))
    said = issues.select(key, issue_id, F.upper(text).alias("__said"))
    wide = known.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter(c("__n") > NAMES_AT_ONCE).select(key)
    if wide.isEmpty():
        found = _named_in(said, known, key, issue_id)
    else:
        wide = durable(wide)
        some, many = (known.join(wide, key, how) for how in ("left_anti", "left_semi"))
        hits = contained(many.select(key, "needle", c("needle").alias("nid")), said, [key], "nid", "needle", issue_id, "__said", least=1)
        met = hits.join(many.withColumnRenamed("needle", "nid"), [key, "nid"]).select(key, issue_id, "best")
        found = _named_in(said, some, key, issue_id).unionByName(met)
    return found.groupBy(key, issue_id).agg(F.min_by("best", "best.rank").alias("hit")).select(key, issue_id, "hit.label", "hit.space", "hit.box")


#: Names of a drawing up to which a text is searched for them one by one; a drawing has some dozens.
NAMES_AT_ONCE = 500


def _named_in(said: DataFrame, known: DataFrame, key: str, issue_id: str) -> DataFrame:
    """The names (best) that each text holds, of drawings with few of them."""
    names = known.groupBy(key).agg(F.collect_list(F.struct("needle", "best")).alias("__names"))
    j = said.filter(F.col(issue_id).isNotNull()).join(names, key)
    held = F.filter("__names", lambda n: F.contains(F.col("__said"), n["needle"]))
    return j.select(key, issue_id, F.explode(F.transform(held, lambda n: n["best"])).alias("best"))


# Callouts and dimensions ----------------------------------------------------


def callout_marks(callouts: DataFrame, keys: list[str], raw: str) -> DataFrame:
    """Leader texts as marks: kind single for one mark, merged for two in one leader."""
    t = F.regexp_replace(F.col(raw), r"\\[A-Za-z][^;]*;", "")
    t = F.lower(strip(F.regexp_replace(t, r"\{[^}]*\}", "")))
    kind = F.when(t.rlike(r"^[a-z]\d{0,2}$"), "single").when(t.rlike(r"^([a-z]\d{0,2})[/\s]+([a-z]\d{0,2})$"), "merged")
    return callouts.withColumn("bar_mark", t).withColumn("kind", kind).filter("kind IS NOT NULL")


def liner_units(callouts: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """Liner callouts: thickness in metres is a finding, the last one in mm is the value."""
    from spanledger.functions.text import strip_dimension_override

    t = strip_dimension_override(F.col(text))
    u = F.upper(t)
    liner = callouts.filter(u.contains("LINER")).select(
        key, order,
        F.nullif(F.regexp_extract(u, r"(\d+(?:\.\d+)?)\s*\bM\b\s*THK", 1), F.lit("")).alias("metres"),
        F.nullif(F.regexp_extract(u, r"(\d+(?:\.\d+)?)\s*MM\s*THK", 1), F.lit("")).alias("mm"),
    )
    given = F.col("metres").isNull() & F.col("mm").isNotNull()
    return liner.groupBy(key).agg(
        F.count("metres").alias("wrong_units"),
        F.max_by(F.col("mm").cast("double"), F.when(given, F.col(order))).alias("liner_thickness_mm"),
    )


def classify_dimension(override: Column, value_mm: Column) -> Column:
    """What a dimension says, as struct(kind, mark, number).

    Kinds: mismatch, bar_count, diameter, zone, remaining, pile_length, geometric;
    NULL for a text that decides nothing.
    """
    o = strip(override)
    u, low = F.upper(o), F.lower(o)
    bare = F.when(o.rlike(r"^-?\d+(\.\d+)?$"), o).try_cast("double")
    dia = F.nullif(F.regexp_extract(u, r"(\d{3,5}(?:\.\d+)?)\s*DIA", 1), F.lit("")).try_cast("double")
    zone = low.rlike(r"^(\d+)\s+([a-z]\d*)\s*$")
    remaining = low.rlike(r"^remaining\s+([a-z]\d*)\s*$")
    length = F.nullif(F.regexp_extract(u, r"=\s*([\d.]+)", 1), F.lit("")).try_cast("double")
    named = u.rlike("PILE LENGTH|LENGTH OF PILE") & (length > 1000) & (length < 50000)

    def row(kind, mark=None, number=None):
        return F.struct(
            F.lit(kind).alias("kind"),
            (mark if mark is not None else F.lit(None).cast("string")).alias("mark"),
            (number if number is not None else F.lit(None).cast("double")).alias("number"),
        )

    return (
        F.when((o == "") & value_mm.isNotNull(), row("geometric", number=F.bround(value_mm, 1)))
        .when(bare.isNotNull() & (F.abs(bare - value_mm) > F.greatest(F.lit(2.0), value_mm * 0.25)), row("mismatch", number=bare))
        .when(bare.isNotNull(), F.lit(None))
        .when(u.rlike(r"(\d+)\s*[-–]\s*(\d+)\s*NOS"), row("bar_count"))
        .when((dia > 300) & (dia < 5000), row("diameter", number=dia))
        .when(dia.isNotNull(), F.lit(None))
        .when(zone, row("zone", F.regexp_extract(low, r"^(\d+)\s+([a-z]\d*)", 2), F.regexp_extract(low, r"^(\d+)", 1).try_cast("double")))
        .when(remaining, row("remaining", F.regexp_extract(low, r"^remaining\s+([a-z]\d*)", 1), F.lit(0.0)))
        .when(named, row("pile_length", number=length))
        .otherwise(row("geometric", number=F.bround(value_mm, 1)))
    )


def bar_count_pairs(override: Column) -> Column:
    """The (diameter, count) pairs of a ``d - n NOS`` text as an array."""
    u = F.upper(override)
    p = F.lit(r"(\d+)\s*[-–]\s*(\d+)\s*NOS")
    return F.zip_with(
        F.regexp_extract_all(u, p, F.lit(1)),
        F.regexp_extract_all(u, p, F.lit(2)),
        lambda d, n: F.struct(d.cast("int").alias("dia"), n.cast("int").alias("count")),
    )


# Title block ----------------------------------------------------------------

TITLE_PATTERNS = {
    "revision": r"(?i)^(R\d+)$",
    "date": r"^(\d{2}[/-]\d{2}[/-]\d{2,4}.*)$",
    "scale": r"(?i)^(.*(?:AS SHOWN|NTS|\b1\s*:\s*\d+\b).*)$",
    "drawing_number": r"(?i)^(.*(?:[A-Z]{2,}/[A-Z]{2,}/|[A-Z]{2,}-[A-Z0-9]{2,}-[\dA-Z+]{2,}-\d{2,}).*)$",
    "spans": r"(?i)(\d+\.?\d*\s*M\s*[-–]\s*\d+\.?\d*\s*M)",
    "width": r"(?i)(\d+\.?\d*\s*M)\s+WIDE",
    "pier_range": r"(?i)(P\d+\s+TO\s+P\d+)",
}


def title_fields(texts: DataFrame, key: str, text: str, order: list[str]) -> DataFrame:
    """The first text that shows each title field; names fill drawn, design, approved in order.

    ``order`` names pass and position, so that typed attributes precede model text
    and that precedes paper text.
    """
    s = strip(F.col(text))
    options = []
    for field, pattern in TITLE_PATTERNS.items():
        v = F.nullif(F.regexp_extract(s, pattern, 1), F.lit(""))
        if field in ("revision", "spans", "width", "pier_range"):
            v = F.upper(v)
        if field == "drawing_number":
            v = F.regexp_replace(v, r"\s+", "")
        options.append(F.when(v.isNotNull(), F.struct(F.lit(field).alias("field"), v.alias("value"))))
    name = s.rlike(r"^[A-Z]\.[A-Z]\.\w+$")
    options.append(F.when(name, F.struct(F.lit("name").alias("field"), s.alias("value"))))
    found = texts.select(key, *order, F.inline(F.array_compact(F.array(*options))))
    at = F.struct(*order)
    single = found.filter("field <> 'name'").groupBy(key, "field").agg(F.min_by("value", at).alias("value"))
    # The first three names; taking one minimum after the other keeps this an aggregate.
    names = found.filter("field = 'name'")
    out, roles = single, ("drawn_by", "design_by", "approved_by")
    for role in roles:
        first = names.groupBy(key).agg(F.min_by(F.struct(*order, "value"), at).alias("f"))
        out = out.unionByName(first.select(key, F.lit(role).alias("field"), F.col("f.value").alias("value")))
        names = names.join(first.select(key, F.struct(*[F.col("f")[o] for o in order]).alias("__at")), key).filter(at > F.col("__at")).drop("__at")
    return out


def view_label(text: Column) -> Column:
    """What a text labels: detail, plan or section; NULL if it is no view label."""
    t = F.upper(strip(text))
    short = (F.length(t) <= 80) & t.rlike(r"^(CROSS\s+SECTION|SECTION|PLAN OF|REINFORCEMENT PLAN OF|DETAIL)\b")
    return F.when(
        short,
        F.when(t.startswith("DETAIL"), "detail")
        .when(t.rlike("PLAN OF|REINFORCEMENT PLAN"), "plan")
        .otherwise("section"),
    )


def component_of_label(text: Column) -> Column:
    """The component a label names, the longest name first; unknown without one."""
    u = F.upper(text)
    return F.when(u.contains("PILECAP"), "pilecap").when(u.contains("PILE"), "pile").when(u.contains("PIER"), "pier").otherwise("unknown")


# Component by bar mark letter where a schedule has no headers.
MARK_COMPONENTS = {
    "pile": ["x", "x1", "y", "y1", "y2", "z"],
    "pilecap": ["a", "b", "c", "d", "e", "f", "f1"],
    "pier": ["g", "g1", "h", "h1", "h2", "i", "i1", "i2", "j", "j1", "j2", "k", "k1", "k2"],
}


def component_of_mark(mark: Column) -> Column:
    """The component of a mark, of its base letter if the mark itself is not listed."""
    known = F.create_map(*[F.lit(x) for comp, marks in MARK_COMPONENTS.items() for m in marks for x in (m, comp)])
    return F.coalesce(F.try_element_at(known, mark), F.try_element_at(known, F.regexp_replace(mark, r"\d+$", "")))


def section_header(row_text: Column) -> Column:
    """The component a schedule row heads, NULL for data, total and table rows."""
    t = F.upper(row_text)
    total = t.rlike(r"\b(PILECAP|PILE|PIER)\b(?:\s+DESIGN\s*QTY\.?)?\s*=\s*[\d.]")
    head = F.array_join(F.slice(F.split(strip(t), r"\s+"), 1, 2), " ")
    patterns = {"pilecap": r"\bPILECAP\b", "pile": r"\bPILE\b(?!CAP)", "pier": r"\bPIER\b"}
    out = F.lit(None).cast("string")
    for comp, p in reversed(list(patterns.items())):
        numbering = t.rlike(r"^.*?" + p + r"\s*NO\.*(\s|$)")
        out = F.when(t.rlike(p) & head.rlike(p) & ~numbering, comp).otherwise(out)
    return F.when(~total, out)


def section_grade_mismatch(sections: DataFrame, texts: DataFrame, grades: DataFrame, key: str, reach: Column) -> DataFrame:
    """Sections whose nearest-in-order grade text differs from the notes.

    ``sections``: key, line, y, component; ``texts``: key, text, y, ord; ``grades``:
    key, component, grade. Only texts holding a grade join, by height bands as wide
    as the reach, so that a section meets its own and the two next bands.
    """
    c = F.col
    graded = texts.select(key, "ord", c("y").alias("ty"), F.nullif(F.regexp_extract(F.upper("text"), GRADES, 1), F.lit("")).alias("found")).filter("found IS NOT NULL")
    want = sections.join(grades, [key, "component"]).withColumn("reach", reach)
    bands = want.withColumn("band", F.explode(F.array(*[F.floor(c("y") / c("reach")) + i for i in (-1, 0, 1)])))
    sized = graded.join(want.select(key, "reach").distinct(), key).withColumn("band", F.floor(c("ty") / c("reach"))).drop("reach")
    hits = bands.join(sized, [key, "band"]).filter(F.abs(c("ty") - c("y")) <= c("reach"))
    first = hits.groupBy(key, "line", "component", "grade").agg(F.min_by("found", "ord").alias("found"))
    return first.filter(c("found") != c("grade")).select(key, F.substring("line", 1, 60).alias("line"), "found", "grade").distinct()
