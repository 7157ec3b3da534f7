"""Report records, the form cells they fill, and the checks of a filled form."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanledger.functions import text as T
from spanledger.functions.geo import date_text
from spanledger.plans.containment import contained
from spanledger.plans.durable import durable
from spanledger.plans.fold import fold
from spanledger.plans.scan import Running, numbered, ordered_scan
from spanledger.session import dealt

# What each cell of column C holds: row, kind, fields in order of
# preference. Kinds other than text: date, location and div_cir (of two fields) and
# spans.
FORM_A = """
4 text bridge_title river_name
5 text bridge_number
6 text river_name
7 text road_name
8 text road_number
9 location latitude longitude
10 text bm_gts_level
11 text division circle
12 text circle
15 spans no_of_spans
16 text total_length
17 text angle_of_crossing
18 text bridge_level_type type_of_bridge
20 text hydraulic_parameters
21 text hydraulic_catchment
22 text hydraulic_discharge
23 text hydraulic_hfl
24 text hydraulic_ofl
25 text hydraulic_clearance
26 text hydraulic_lwl
27 text hydraulic_depth
28 text hydraulic_velocity
29 text hydraulic_channel_width
30 text hydraulic_spread
31 text hydraulic_bed_level
33 text subsoil_particulars
34 text subsoil_type
35 text subsoil_friction
36 text subsoil_cohesion
37 text subsoil_silt_factor
38 text subsoil_bearing_capacity
39 text subsoil_foundation_level
42 text loading_standard
43 text superstructure_type bridge_type
44 text span_arrangement span_length
45 text carriage_width
46 text deck_level
48 text design_scour_level
49 text design_foundation_level
50 text foundation_type
51 text substructure_type
52 text substructure_material
53 text pier_length
54 text pier_width_detail
55 text pier_cap_width
56 text abutment_width
57 text abutment_cap_width
58 text returns_length
59 text superstructure_type
60 text prestressing_details
61 text articulation_details
62 text total_load_foundation
63 text total_horizontal_force
64 text bearing_type_detail
65 text wearing_coat
66 text railing_type
67 text expansion_joint
68 text protection_works
69 text model_studies
70 text special_design_features
71 text settlement_report
73 text material_consumed
74 text material_cement
75 text material_reinforcement
76 text material_structural_steel
77 text material_hts_steel
80 date date_of_construction_start
81 date date_of_completion
82 text surface_utilities
83 text design_drawings
84 text ls_sketch
85 text special_features
86 text total_cost
87 text cost_per_sqm_carriageway
88 text cost_per_sqm_elevation
89 text cost_per_m_length
90 text design_agency
91 text construction_agency
92 text performance
93 date date_of_survey
"""
FORM_B = """
4 text bridge_title river_name
5 text bridge_number
6 text river_name
7 text road_name
8 text road_number
9 location latitude longitude
10 div_cir division circle
11 text type_of_bridge bridge_type
12 date date_of_survey
14 text approach_settlement
15 text approach_side_slopes
16 text approach_erosion
17 text approach_slab
18 text approach_geometrics
19 text approach_other
21 text prot_type
22 text prot_damage_layout
23 text prot_slope_pitching
24 text prot_floor_protection
25 text prot_scour_extent
26 text prot_reserve_stone
27 text prot_other
28 text waterway_obs
29 text waterway_obstruction
30 text waterway_scour
31 text waterway_flow
32 text waterway_flood_level
33 text waterway_afflux
34 text waterway_adequacy
35 text waterway_other
36 text foundations_obs
37 text foundations_settlement
38 text foundations_cracking
39 text foundations_floating
40 text foundations_subway
41 text foundations_other
42 text sub_section_obs
43 text sub_drainage_backfill
44 text sub_cracking_obs
45 text sub_subway_obs
46 text sub_other_obs
48 text bear_metallic_type
49 text bear_metallic_condition
50 text bear_metallic_functioning
51 text bear_metallic_greasing
52 text bear_pedestal_cracks
53 text bear_metallic_anchor
54 text bear_metallic_other
55 text bear_elastomeric_type
56 text bear_pad_condition
57 text bear_cleanliness
58 text bear_elastomeric_other
59 text super_section_obs superstructure_type
61 text super_spalling_obs
62 text super_cracking_obs
63 text super_corrosion_obs
64 text super_vehicle_damage
65 text super_articulation
66 text super_vibration
67 text super_deflection
68 text super_anchorage_cracks
69 text super_hinge_deflection
70 text steel_obs
79 text masonry_obs
86 text timber_obs
92 text exp_jt_functioning
93 text exp_jt_sealing
94 text exp_jt_fixing
95 text exp_jt_sliding_plate
96 text exp_jt_locking
97 text exp_jt_debris
98 text exp_jt_rattling
99 text exp_jt_other
100 text wear_coat_type
101 text wear_coat_surface
102 text wear_coat_evidence
103 text drain_type
104 text drain_clogging
105 text drain_projection
106 text drain_adequacy
107 text drain_subway
108 text drain_other
110 text handrail_condition
111 text handrail_collision
112 text handrail_alignment
114 text footpath_condition
115 text footpath_missing_slab
116 text footpath_other
117 text utilities_obs
118 text util_water_leakage
119 text util_cable_damage
120 text util_lighting
121 text util_other_damage
123 text bridge_num_condition
125 text aesthetics_intrusion
126 text maintenance_history
"""
FORM_B_RB = "128 text overall_condition_visual"
FORM_B_AMC = """
71 text steel_paint
72 text steel_corrosion
73 text steel_vibration
74 text steel_alignment
75 text steel_connections
76 text steel_camber_deflection
77 text steel_buckling
78 text steel_cleanliness
80 text masonry_joints
81 text masonry_profile
82 text masonry_cracks
83 text masonry_drainage
84 text masonry_vegetation
85 text masonry_other
87 text timber_paint
88 text timber_decay
89 text timber_joints
90 text timber_sag
127 text overall_condition_visual
"""

# Labels looked for in raw notes, in order, with field and cell.
RAW_LABELS = [
    ("span arrangement", "span_arrangement", "C44"),
    ("angle of crossing", "angle_of_crossing", "C17"),
    ("designed maximum scour level", "design_scour_level", "C48"),
    ("design scour level", "design_scour_level", "C48"),
    ("maximum scour level", "design_scour_level", "C48"),
    ("designed foundation level", "design_foundation_level", "C49"),
    ("design foundation level", "design_foundation_level", "C49"),
    ("foundation level from pile cap", "design_foundation_level", "C49"),
    ("straight length of pier", "pier_length", "C53"),
    ("pier length", "pier_length", "C53"),
    ("width of pier gap", "pier_cap_width", "C55"),
    ("pier gap", "pier_cap_width", "C55"),
    ("width of pier cap", "pier_cap_width", "C55"),
    ("pier cap", "pier_cap_width", "C55"),
    ("width of abutment cap", "abutment_cap_width", "C57"),
    ("abutment cap", "abutment_cap_width", "C57"),
    ("width of abutment", "abutment_width", "C56"),
    ("details of prestressing", "prestressing_details", "C60"),
    ("details of articulation", "articulation_details", "C61"),
    ("design agency", "design_agency", "C90"),
    ("construction agency", "construction_agency", "C91"),
    ("date of completion", "date_of_completion", "C81"),
    ("date of construction", "date_of_construction_start", "C80"),
]

# Defects in form order; the first stands in row 4.
DEFECTS = ["cracks", "leaching", "honeycombing", "exposed_rebar", "leakage", "spalling", "rust_marks", "shuttering", "delamination", "vegetation", "any_other"]

# Fields in the order notes are dictated in.
DICTATED = [
    "bridge_title", "bridge_number", "river_name", "road_name", "road_number", "latitude", "longitude", "bm_gts_level",
    "division", "circle", "no_of_spans", "total_length", "angle_of_crossing", "bridge_level_type", "hydraulic_parameters",
    "subsoil_particulars", "superstructure_type", "span_arrangement", "carriage_width", "deck_level", "design_scour_level",
    "design_foundation_level", "foundation_type", "substructure_type", "pier_length", "pier_width_detail", "pier_cap_width",
    "abutment_width", "abutment_cap_width", "returns_length", "superstructure_type", "prestressing_details",
    "articulation_details", "bearing_type_detail", "wearing_coat", "railing_type", "expansion_joint",
    "date_of_construction_start", "date_of_completion", "surface_utilities", "design_agency", "construction_agency", "performance",
]

# Short labels and the fields they mean.
ALIASES = {
    "bridge_title": ["name of bridge", "bridge name"],
    "bridge_number": ["no of bridge", "bridge no", "bridge number"],
    "river_name": ["name of river", "river", "nala name"],
    "road_name": ["road name", "name of road", "highway"],
    "road_number": ["road no", "road number"],
    "latitude": ["gps", "coordinates", "lat lon", "latitude"],
    "bm_gts_level": ["location of bm", "bm level", "gts level", "benchmark", "bm gts", "arbitrary level"],
    "division": ["division"],
    "circle": ["circle"],
    "no_of_spans": ["no of spans", "number of spans", "spans"],
    "total_length": ["total length", "bridge length", "length", "length of bridge between ends of decking", "length of bridge between abutment faces", "between ends of decking", "overall length"],
    "cc_of_piers": ["c/c", "c to c", "centre to centre", "c/c of piers"],
    "width_of_piers": ["pier width"],
    "pier_cap_width": ["pier cap", "cap width", "width of cap", "pier gap", "width of pier gap"],
    "abutment_cap_width": ["abutment cap", "abutment cap width"],
    "abutment_width": ["abutment width", "width of abutment"],
    "angle_of_crossing": ["angle", "skew", "skew angle", "crossing angle"],
    "bridge_level_type": ["type of bridge", "high level or submersible", "high level/rob/submersible"],
    "hydraulic_parameters": ["hydraulic"],
    "subsoil_particulars": ["sub soil", "subsoil", "soil particulars"],
    "superstructure_type": ["superstructure type", "type of superstructure"],
    "span_arrangement": ["span arrangement", "span details"],
    "carriage_width": ["carriage", "carriageway", "carriage width"],
    "footpath_width": ["footpath", "footpath width"],
    "deck_level": ["deck level", "deck"],
    "design_scour_level": ["designed maximum scour level", "design scour level", "maximum scour level"],
    "design_foundation_level": ["designed foundation level", "design foundation level", "foundation level from pile cap"],
    "foundation_type": ["foundation type", "type of foundation"],
    "substructure_type": ["substructure type", "type of substructure"],
    "pier_length": ["pier length", "height of pier", "pier height"],
    "returns_length": ["return walls", "wing walls", "returns"],
    "prestressing_details": ["prestressing", "prestress", "prestress details", "details of prestressing"],
    "articulation_details": ["articulation", "articulation details", "details of articulation"],
    "bearing_type_detail": ["bearing type", "type of bearing", "bearings"],
    "expansion_joint": ["expansion joint", "ej", "ej type"],
    "wearing_coat": ["wearing coat", "wc", "wc type"],
    "railing_type": ["railing", "parapet", "crash barrier type"],
    "construction_agency": ["contractor", "construction agency"],
    "design_agency": ["designer", "design agency"],
    "surface_utilities": ["utilities", "services on bridge", "surface utilities"],
    "performance": ["performance", "condition", "overall performance"],
}

# Fields a word report has to contain.
WORD_FIELDS = [
    "river_name", "road_name", "chainage", "latitude", "longitude", "circle", "division", "sub_division", "no_of_spans",
    "span_length", "span_arrangement", "total_length", "bridge_type", "bridge_level_type", "type_of_bridge",
    "superstructure_type", "substructure_type", "foundation_type", "bearing_type_detail", "approach_length", "railing_type",
    "river_training", "repair_work", "carriage_width", "year_of_construction", "river_perennial", "angle_of_crossing",
    "hydraulic_parameters", "subsoil_particulars", "deck_level", "pier_length", "date_of_completion", "surface_utilities",
    "performance", "prestressing_details", "date_of_survey",
]


# Records ------------------------------------------------------------------------


def record_to_long(records: DataFrame, keys: list[str], fields: list[str] | None = None) -> DataFrame:
    """Text fields of a record as rows (field, value)."""
    names = fields or [f for f in records.columns if f not in keys]
    return records.select(*keys, *[F.col(n).cast("string").alias(n) for n in names]).unpivot(keys, names, "field", "value")


def value_set(long: DataFrame, key: str) -> DataFrame:
    """All values a report cell may be traced to, with the derived ones.

    Fields are dealt by key once; all that follows stays where the key is.
    """
    c = F.col
    long = dealt(long, key)
    plain = long.select(key, T.strip(c("value")).alias("value"))
    wide = long.filter(c("field").isin("latitude", "longitude", "division", "circle", "no_of_spans")).groupBy(key).pivot(
        "field", ["latitude", "longitude", "division", "circle", "no_of_spans"]
    ).agg(F.first("value"))
    both = T.division_circle(c("division"), c("circle"))
    made = wide.select(
        key,
        F.explode(
            F.array(
                T.location(c("latitude"), c("longitude")),
                F.when(both.contains(" / "), both),
                F.when(T.present_text(c("no_of_spans")).isNotNull(), F.concat(F.lit("Number of Span: "), c("no_of_spans"))),
            )
        ).alias("value"),
    )
    dates = long.filter(c("field").isin("date_of_survey", "date_of_construction_start", "date_of_completion")).select(key, date_text(c("value")).alias("value"))
    return plain.unionByName(made).unionByName(dates).filter(~c("value").isin("", "-")).distinct()


def zip_photos(records: DataFrame, key: str) -> DataFrame:
    """Photos with title, category and coordinate; short lists are padded, photos without a path go."""
    z = F.arrays_zip("photos", "photo_titles", "photo_categories", "photo_coords")
    c = F.col
    return records.select(key, F.posexplode(z).alias("i", "p")).filter(F.coalesce(c("p.photos"), F.lit("")) != "").select(
        key, (c("i") + 1).alias("ord"), c("p.photos").alias("path"), F.coalesce("p.photo_titles", F.lit("")).alias("title"),
        F.coalesce("p.photo_categories", F.lit("damage")).alias("category"), c("p.photo_coords").alias("coord"),
    )


def figure_numbers(photos: DataFrame, key: str, order: list[str], category: str) -> DataFrame:
    """Damage photos numbered in order, with the text that refers to them."""
    damaged = F.lower(category).isin("damage", "damaged")
    marked = photos.withColumn("__d", F.when(damaged, F.lit(1)))
    out = ordered_scan(marked, [key], order, {"figure_no": Running("count", "__d")})
    no = F.when(F.col("__d") == 1, F.col("figure_no"))
    return out.withColumn("figure_no", no).withColumn(
        "reference", F.concat(F.lit("(Photo No.-"), F.col("figure_no").cast("string"), F.lit(")"))
    ).drop("__d")


def photo_index(photos: DataFrame, key: str, order: list[str], group: Column, title: str) -> DataFrame:
    """Numbered captions per group (general, damaged); rows of other groups are left out."""
    grouped = photos.withColumn("group", group).filter("group IS NOT NULL")
    return numbered(grouped, [key, "group"], order, "n").withColumn("caption", F.concat(F.col("n").cast("string"), F.lit(". "), F.col(title)))


def photo_descriptions(messages: DataFrame, key: str, pos: str) -> DataFrame:
    """A text for each photo message, each text used once.

    ``messages``: key, pos (1..n per key), content, category, media_path, photo_num.
    In order: the photo's own caption; the first text of its category within five
    places that names its number; the nearest one up to three before; the nearest
    up to three after. What a photo may take is gathered by place in a join; the
    photos then claim in order, remembering only the last places taken.
    """
    c = F.col
    photo = F.coalesce(c("media_path"), F.lit("")) != ""
    photos = messages.filter(photo).withColumns({"own": c("content"), "category": F.coalesce("category", F.lit("damaged"))})
    texts = messages.filter(~photo & (T.strip(c("content")) != "")).select(key, c(pos).alias("tpos"), c("category"), T.strip(c("content")).alias("text"))
    near = photos.select(key, pos, "category", "photo_num", F.explode(F.sequence(c(pos) - 5, c(pos) + 5)).alias("tpos"))
    n = c("photo_num").cast("string")
    low = F.lower("text")
    named = F.lit(False)
    for form in ("photo {}", "pic {}", "image {}", "{}."):
        head, tail = form.split("{}")
        named = named | F.contains(low, F.concat(F.lit(head), n, F.lit(tail)))
    gap = c("tpos") - c(pos)
    rank = (
        F.when((c("photo_num") != 0) & named, F.struct(F.lit(1).alias("a"), c("tpos").alias("b")))
        .when(gap.between(-3, -1), F.struct(F.lit(2).alias("a"), (-gap).alias("b")))
        .when(gap.between(1, 3), F.struct(F.lit(3).alias("a"), gap.alias("b")))
    )
    options = (
        near.join(texts, [key, "tpos", "category"]).withColumn("rank", rank).filter("rank IS NOT NULL")
        .groupBy(key, pos).agg(F.array_sort(F.collect_list(F.struct("rank.a", "rank.b", "tpos", "text"))).alias("o"))
    )
    waiting = photos.join(options, [key, pos], "left").select(key, pos, "own", F.to_json("o").alias("options"))

    def step(cols, state):
        taken: list[int] = json.loads(state) if state else []
        said = []
        for p, own, opts in zip(cols[pos], cols["own"], cols["options"]):
            text = own if isinstance(own, str) and own else ""
            if not text and isinstance(opts, str):
                for o in json.loads(opts):
                    if o["tpos"] not in taken:
                        taken.append(o["tpos"])
                        text = o["text"]
                        break
            taken = [t for t in taken if t > p - 12]
            said.append(text)
        return {pos: cols[pos], "description": np.array(said, dtype=object)}, json.dumps(taken)

    return fold(waiting, [key], [pos], step, f"{pos} bigint, description string")


# Form cells -----------------------------------------------------------------------


def form_map(spark) -> DataFrame:
    """(fmt, sheet, cell, kind, prio, field) of all forms; small and fixed."""
    rows = []
    for fmt, own_b in (("excel_rb", FORM_B_RB), ("excel_amc", FORM_B_AMC)):
        for sheet, block in (("Appendix-A", FORM_A), ("Appendix-B", FORM_B + own_b)):
            for line in block.strip().splitlines():
                if line.strip():
                    row, kind, *fields = line.split()
                    rows += [(fmt, sheet, f"C{row}", kind, i, f) for i, f in enumerate(fields)]
    return spark.createDataFrame(rows, "fmt string, sheet string, cell string, kind string, prio int, field string")


def form_expected(long: DataFrame, forms: DataFrame, key: str, mapping: DataFrame) -> DataFrame:
    """The value each form cell should hold. ``long``: key, field, value; ``forms``: key, fmt."""
    c = F.col
    given = long.withColumn("value", T.present_text(c("value"))).filter("value IS NOT NULL")
    j = dealt(given, key).join(dealt(forms, key), key).join(F.broadcast(mapping), ["fmt", "field"])
    part = lambda p: F.max(F.when(c("prio") == p, c("value")))
    g = j.groupBy(key, "fmt", "sheet", "cell", "kind").agg(F.min_by("value", "prio").alias("first"), part(0).alias("a"), part(1).alias("b"))
    value = (
        F.when(c("kind") == "location", T.location(c("a"), c("b")))
        .when(c("kind") == "div_cir", T.division_circle(c("a"), c("b")))
        .when(c("kind") == "date", date_text(c("first")))
        .when(c("kind") == "spans", T.spans_cell(c("first")))
        .otherwise(c("first"))
    )
    return g.select(key, "fmt", "sheet", "cell", value.alias("expected")).filter("expected IS NOT NULL")


#: ``found`` and ``expected`` are what a listing shows; ``full`` is the whole value that a fix writes.
CHECK = "rule int, severity string, sheet string, cell string, found string, expected string, auto_fixable boolean, full string"
SHOWN = 120


def _issue(df: DataFrame, key: str, rule: int, severity: str, found: Column, expected: Column, fixable: Column) -> DataFrame:
    shown = expected if rule == 4 else F.substring(expected, 1, SHOWN)
    return df.select(
        key, F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), "sheet", "cell",
        found.alias("found"), shown.alias("expected"), fixable.alias("auto_fixable"), expected.alias("full"),
    )


def lost_inputs(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Rule 1: cells that should hold a value but are empty."""
    c = F.col
    want = expected.withColumn("expected", T.cell_text(c("expected"))).filter("expected IS NOT NULL")
    have = actual.filter(T.cell_text(c("value")).isNotNull()).select(key, "sheet", "cell")
    gone = want.join(have, [key, "sheet", "cell"], "left_anti")
    return _issue(gone, key, 1, "warning", F.lit("(empty)"), c("expected"), F.lit(True))


def special_values_kept(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Rule 4: protected phrases that a cell does not hold unchanged."""
    c = F.col
    want = expected.withColumn("expected", T.cell_text(c("expected"))).filter(T.is_protected(c("expected")))
    j = want.join(actual.select(key, "sheet", "cell", T.cell_text(c("value")).alias("found")), [key, "sheet", "cell"], "left")
    odd = j.filter(~c("found").eqNullSafe(c("expected")))
    return _issue(odd, key, 4, "error", F.coalesce("found", F.lit("(empty)")), c("expected"), F.lit(True))


#: Values of a key up to which its cells are held against them in one array; a record has some dozens.
VALUES_AT_ONCE = 500


def untraceable(actual: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """Rule 2: cells whose text neither equals, holds, nor is held by any source value.

    ``actual``: key, sheet, cell, value. Values shorter than three characters count
    for equality only. The values of a key meet its cells as one array; a key with more
    of them than ``VALUES_AT_ONCE`` has its texts and values joined on sampled grams.
    """
    c = F.col
    cells = actual.withColumn("text", T.cell_text(c("value"))).filter("text IS NOT NULL")
    vals = values.filter(c(key).isNotNull() & c("value").isNotNull()).select(key, "value").distinct()
    wide = vals.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter(c("__n") > VALUES_AT_ONCE).select(key)
    if wide.isEmpty():
        odd = _unheld(cells, vals, key)
    else:
        wide = durable(wide)
        odd = _unheld(cells.join(wide, key, "left_anti"), vals.join(wide, key, "left_anti"), key).unionByName(
            _unheld_by_grams(cells.join(wide, key, "left_semi"), vals.join(wide, key, "left_semi"), key)
        )
    return _issue(odd, key, 2, "warning", F.substring("text", 1, 120), F.lit("value traceable to report_json"), F.lit(True))


def _unheld(cells: DataFrame, vals: DataFrame, key: str) -> DataFrame:
    """The cells that no value of their key traces."""
    c = F.col
    given = vals.groupBy(key).agg(F.collect_list("value").alias("__values"))

    def traces(v: Column) -> Column:
        held = F.contains(v, c("text")) | (v.rlike(r"\S") & F.contains(c("text"), v))
        return (v == c("text")) | ((F.length(v) >= 3) & held)

    j = cells.join(given, key, "left").filter(~F.coalesce(F.exists("__values", traces), F.lit(False)))
    return j.select(*cells.columns)


def _unheld_by_grams(cells: DataFrame, vals: DataFrame, key: str) -> DataFrame:
    """The same for keys of any number of values."""
    c = F.col
    texts = cells.select(key, "text").distinct()
    equal = texts.join(vals.withColumnRenamed("value", "text"), [key, "text"], "left_semi")
    rest = texts.join(equal, [key, "text"], "left_anti")
    big = vals.filter(F.length("value") >= 3)
    # A text of one or two characters is held by a value as one of its pieces.
    tiny = rest.filter(F.length("text") < 3)
    bits = big.select(key, F.explode(F.array_distinct(F.flatten(F.array(
        F.transform(F.sequence(F.lit(1), F.length("value")), lambda i: F.substring("value", i, F.lit(1))),
        F.transform(F.sequence(F.lit(1), F.length("value") - 1), lambda i: F.substring("value", i, F.lit(2))),
    )))).alias("text")).distinct()
    held_tiny = tiny.join(bits, [key, "text"], "left_semi")
    t = rest.withColumn("tid", c("text"))
    v = big.withColumn("vid", c("value"))
    held = contained(t, v, [key], "tid", "text", "vid", "value").select(key, c("tid").alias("text"))
    holds = contained(v, t, [key], "vid", "value", "tid", "text").select(key, c("tid").alias("text"))
    known = equal.unionByName(held_tiny).unionByName(held).unionByName(holds).distinct()
    return cells.join(known, [key, "text"], "left_anti").select(*cells.columns)


def stretched_photos(shown: DataFrame, sources: DataFrame, keys: list[str]) -> DataFrame:
    """Rule 3: the k-th image of a sheet against the k-th photo: more than 25 % off its aspect.

    Both sides have a position ``k``, width and height.
    """
    j = shown.join(sources.withColumnsRenamed({"width": "src_w", "height": "src_h"}), [*keys, "k"])
    c = F.col
    ok = j.filter((c("src_w") > 0) & (c("src_h") > 0) & (c("width") > 0) & (c("height") > 0))
    a, b = c("width") / c("height"), c("src_w") / c("src_h")
    return ok.withColumns({"display_aspect": a, "source_aspect": b}).filter(F.abs(a - b) / b > 0.25)


def raw_label_gaps(raw: DataFrame, key: str, text: str, filled: DataFrame) -> DataFrame:
    """Rule 5: labels in raw notes whose field the record leaves blank.

    ``filled``: key, field of the fields the record has. Of several labels of a field
    the first in the list counts.
    """
    c = F.col
    low = F.lower(text)
    hits = [
        F.when(F.contains(low, F.lit(p)), F.struct(F.lit(i).alias("no"), F.lit(p).alias("label"), F.lit(f).alias("field"), F.lit(cell).alias("cell")))
        for i, (p, f, cell) in enumerate(RAW_LABELS)
    ]
    found = raw.select(key, text, F.inline(F.array_compact(F.array(*hits))))
    first = found.groupBy(key, "field").agg(F.min_by(F.struct("label", "cell", text), "no").alias("h")).select(key, "field", "h.*")
    open_ = first.join(filled.select(key, "field").distinct(), [key, "field"], "left_anti")
    open_ = open_.withColumn("v", T.value_after_label(c(text), c("label"))).withColumn("sheet", F.lit("Appendix-A"))
    known = c("v").isin(*sorted(set(T.PHRASE_FORMS.values()))) | c("v").rlike(r"^\d")
    said = F.coalesce("v", F.concat(F.lit('(value after label "'), "label", F.lit('")')))
    return _issue(open_, key, 5, "warning", F.lit("(blank in report_json)"), said, F.coalesce(known, F.lit(False)))


def word_losses(long: DataFrame, documents: DataFrame, key: str, text: str) -> DataFrame:
    """The word variant of rules 1 and 4: values that the document's text does not contain."""
    c = F.col
    v = long.withColumn("v", T.strip(T.present_text(c("value")))).filter("v IS NOT NULL")
    # A document's values, as many as a record has fields, meet its text at once.
    wanted = v.groupBy(key).agg(F.collect_list(F.struct("field", "v")).alias("__values"))
    gone = wanted.join(documents.select(key, text), key).select(key, F.inline(F.filter("__values", lambda x: ~F.contains(c(text), x["v"]))))
    lost = gone.filter(c("field").isin(*WORD_FIELDS)).select(key, F.lit(1).alias("rule"), "field", F.substring("v", 1, 120).alias("expected"))
    return lost.unionByName(gone.filter(T.is_protected(c("v"))).select(key, F.lit(4).alias("rule"), "field", c("v").alias("expected")))


def corrected_cells(actual: DataFrame, issues: DataFrame, key: str) -> DataFrame:
    """The report after its fixable issues: rule 2 clears a cell, rules 1, 4 and 5 write the whole expected value."""
    c = F.col
    fixes = issues.filter("auto_fixable AND rule IN (1, 2, 4, 5)").groupBy(key, "sheet", "cell").agg(
        F.max_by(F.struct(F.when(c("rule") != 2, c("full")).alias("to")), "rule").alias("fix")
    )
    return actual.select(key, "sheet", "cell", "value").join(fixes, [key, "sheet", "cell"], "full").select(
        key, "sheet", "cell", F.when(c("fix").isNotNull(), c("fix.to")).otherwise(c("value")).alias("value")
    )


def append_check_log(issues: DataFrame, sessions: DataFrame, key: str, path: str) -> None:
    """Add one line per issue, with its session's phone, bridge and format, to the log of the day."""
    stamped = issues.join(sessions, key).withColumn("checked_at", F.current_timestamp()).withColumn("date", F.to_date("checked_at"))
    stamped.write.mode("append").partitionBy("date").json(path)


def defect_grid(elements: DataFrame, matrix: DataFrame, keys: list[str], row_offset: int = 0) -> DataFrame:
    """One row per listed element and defect with the observation, blank if absent or none.

    ``elements``: keys, element, elem_ord; ``matrix``: keys, element, defect, obs.
    ``row`` is the form row (4 for cracks), shifted by ``row_offset`` where a form
    has an extra head row.
    """
    grid = elements.select(*keys, "element", "elem_ord", F.posexplode(F.array(*[F.lit(d) for d in DEFECTS])).alias("i", "defect"))
    seen = matrix.filter(~F.lower(T.strip(F.col("obs"))).isin("absent", ""))
    return grid.join(seen, [*keys, "element", "defect"], "left").select(
        *keys, "element", "elem_ord", "defect", (F.col("i") + 4 + row_offset).alias("row"), "obs"
    )


def railway_span(matrix: DataFrame, first: DataFrame, keys: list[str]) -> DataFrame:
    """The first span of table 3: one block for concrete, then vegetation and other defects.

    Concrete reads ``Not Applicable`` if not observed; other defects fall back to rust marks.
    """
    obs = first.join(matrix, [*keys, "element"], "left").groupBy(*keys, "element").agg(
        *[F.max(F.when((F.col("defect") == d) & (F.col("obs") != ""), F.col("obs"))).alias(d) for d in ("concrete", "vegetation", "any_other", "rust_marks")]
    )
    return obs.select(
        *keys, "element", F.coalesce("concrete", F.lit("Not Applicable")).alias("concrete"), "vegetation",
        F.coalesce("any_other", "rust_marks").alias("any_other"),
    )


# Dictated notes -------------------------------------------------------------------


def alias_field(text: Column) -> Column:
    """The field a segment's leading label means and the text after it; the longest alias counts."""
    pairs = sorted(((a, f) for f, names in ALIASES.items() for a in names), key=lambda p: (-len(p[0]), p[0]))
    table = F.array(*[F.struct(F.lit(a).alias("alias"), F.lit(f).alias("field")) for a, f in pairs])

    def found(low: Column) -> Column:
        after = lambda p: F.substring(low, F.length(p["alias"]) + 1, F.lit(1))
        return F.get(F.filter(table, lambda p: low.startswith(p["alias"]) & after(p).isin("", " ", ":")), 0)

    def split(hit: Column) -> Column:
        rest = F.regexp_replace(F.substring(text, F.length(hit["alias"]) + 1, F.length(text)), r"(?i)^\s*(?:is\b|:)?\s*", "")
        return F.when(hit.isNotNull(), F.struct(hit["field"].alias("field"), rest.alias("value")))

    return T.let(T.let(F.lower(text), found), split)


def sequential_fields(notes: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Values dictated one after the other, as (seq, field, value).

    The text is split at ``next`` and ``then``; the k-th value goes to the k-th field
    of the order, an empty segment skips one, and a labelled segment sets the place
    from which counting goes on.
    """
    c = F.col
    order = F.array(*[F.lit(f) for f in DICTATED])
    # Back-to-back separators keep their empty segment.
    parts = F.split(F.regexp_replace(c(text), r"(?i)\b(?:and\s+then|next|then)\b", "\u0001"), "\u0001")
    seg = F.transform(parts, lambda s: T.strip(F.regexp_replace(s, r"[;,]\s*$", "")))
    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<seq:int,field:string,value:string>>").alias("out"))

    def step(acc, s):
        def take(named):
            at = F.array_position(order, named["field"]).cast("int")
            pos = F.when(named.isNotNull() & (at > 0), at).otherwise(acc["pos"] + 1)
            field = F.coalesce(named["field"], F.get(order, pos - 1))
            value = F.when(named.isNotNull(), named["value"]).otherwise(s)
            row = F.struct(pos.alias("seq"), field.alias("field"), value.alias("value"))
            keep = (value != "") & field.isNotNull()
            return F.struct(pos.alias("pos"), F.when(keep, F.concat(acc["out"], F.array(row))).otherwise(acc["out"]).alias("out"))

        return T.let(alias_field(s), take)

    return notes.select(*keys, F.inline_outer(F.aggregate(seg, start, step, lambda acc: acc["out"]))).filter("seq IS NOT NULL")
