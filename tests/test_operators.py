"""Domain operators on small literal inputs."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanledger.operators import forms, geometry, labels, reconcile, rules, schedule
from spanledger.operators.issues import passthrough
from spanledger.operators.labels import section_box
from spanledger.streaming import machine
from spanledger.streaming.intake import sessions_batch

SHEETS = "drawing_id long, xmin double, ymin double, xmax double, ymax double"
TEXTS = "drawing_id long, text string, x double, y double, from_block boolean, ord long"


def sheet_texts():
    rows = []

    def put(y, *cells):
        for x, t in cells:
            rows.append((1, t, float(x), float(y), False, len(rows)))

    put(900, (4000, "BAR MARK"), (5000, "REINFORCEMENT"), (5600, "DIA"), (6200, "NOS"), (6800, "LENGTH OF BAR"), (7400, "TOTAL LENGTH"), (8000, "UNIT WT"), (8600, "TOTAL WT"))
    put(860, (4000, "PILECAP"))
    put(820, (4000, "a"), (4150, "850"), (4400, "12,000"), (5000, "25Φ – 42 NOS."), (5600, "25"), (6200, "42"), (6800, "13.425"), (7400, "563.85"), (8000, "3.857"), (8600, "2,174.77"))
    put(780, (4000, "PILE (SCHEDULE PER PILE)"))
    put(740, (4000, "y"), (5600, "16Ø"), (6200, "21x4"), (6800, "2.0"), (7400, "168"), (8000, "1.578"), (8600, "265"))
    put(700, (5600, "16Ø"), (6200, "10"), (6800, "2.0"), (7400, "20"), (8000, "1.578"), (8600, "31"))
    put(660, (4000, "TABLE-1"))
    put(620, (4000, "b"), (5600, "12"), (6200, "9"))
    return rows


def test_read_schedule(spark):
    texts = spark.createDataFrame(sheet_texts(), TEXTS)
    sheets = spark.createDataFrame([(1, 0.0, 0.0, 10000.0, 1000.0)], SHEETS)
    got = {(r["component"], r["bar_mark"], r["zone_ord"]): r for r in schedule.read_schedule(texts, sheets).collect()}
    assert set(got) == {("pilecap", "a", 1), ("pile", "y", 1), ("pile", "y", 2)}
    a = got["pilecap", "a", 1]
    assert (a["bar_dia_mm"], a["count"], a["length_m"], a["total_length_m"], a["total_wt_kg"]) == (25, 42, 13.425, 563.85, 2174.77)
    assert a["reinforcement_text"] == "25Φ – 42 NOS." and a["shape_dimensions"] == [850.0, 12000.0]
    assert [got["pile", "y", z]["count"] for z in (1, 2)] == [84, 10]


def test_design_workbook(spark):
    grid = {
        (0, 0): "Length of Pilecap (along traffic)", (0, 1): "4.5", (0, 2): "a1=", (0, 3): "3.0",
        (1, 0): "No. of Piles=", (1, 1): "4", (2, 0): "Pier Shape=Circular", (3, 0): "PILE (SCHEDULE)",
        (4, 0): "x", (4, 7): "12.5", (4, 8): "25", (4, 9): "-", (4, 10): "10", (4, 11): "125", (4, 12): "3.857", (4, 13): "482",
        (5, 0): "y", (5, 7): "3", (5, 8): "16", (5, 9): "150", (5, 10): "40", (5, 11): "120",
        (6, 0): "z", (6, 8): "0", (6, 10): "5", (7, 0): "PIER (RECTANGULAR)", (8, 0): "g", (8, 8): "20", (8, 10): "6",
        (9, 0): "PIER (CIRCULAR)", (10, 0): "h", (10, 8): "32", (10, 10): "8",
    }
    formulas = {(5, 10): "=10*$B2", (4, 10): "10"}
    rows = [(1, r, c, v, formulas.get((r, c)), (r, c) == (5, 10)) for (r, c), v in grid.items()]
    cells = spark.createDataFrame(rows, "drawing_id long, row int, col int, value string, formula string, font_nonblack boolean")
    geo = {r["key"]: r["value"] for r in schedule.parse_geometry(cells).collect() if r["value"] is not None}
    assert geo["pile_spacing"] == 3.0 and geo["pile_overhang"] == 0.75 and geo["pile_count"] == 4.0
    bars = {r["bar_mark"]: r for r in schedule.parse_bars(cells).collect()}
    assert set(bars) == {"x", "y", "h"}
    assert bars["x"]["count"] == 40 and bars["x"]["total_len_m"] == 500.0 and bars["x"]["reinf_secondary"] == "count"
    # The coloured count wins over the spacing.
    assert bars["y"]["spacing_mm"] == 150.0 and bars["y"]["reinf_secondary"] == "count"


def test_a_formula_naming_the_pile_count_is_already_a_total(spark):
    rows = [(1, 0, 0, "No. of Piles=", None, False), (1, 0, 1, "4", None, False), (1, 1, 0, "PILE (A)", None, False),
            (1, 2, 0, "x", None, False), (1, 2, 8, "25", None, False), (1, 2, 10, "40", "=10*B1", False)]
    cells = spark.createDataFrame(rows, "drawing_id long, row int, col int, value string, formula string, font_nonblack boolean")
    assert [r["count"] for r in schedule.parse_bars(cells).collect()] == [40]


def test_scripted_session():
    script = ["hi", "2", "1", "details of it", "done", "3", None, "done", "4", "none seen", "done", "5", "paint", "done", "6"]
    cols = {
        "msg_id": np.arange(len(script)),
        "type": np.array(["image" if m is None else "text" for m in script]),
        "content": np.array(script, dtype=object),
    }
    out, state = machine.run(cols, None)
    assert out["action"][-1] == "generate" and json.loads(state)["open"] is False
    filed = [c for a, c in zip(out["action"], out["category"]) if a == "filed"]
    assert filed == ["bridge_details", "damaged", "observations", "recommendations"]
    assert out["format"][2] == "excel_rb" and out["photo_num"][6] == 1


def test_a_lone_done_opens_no_session():
    out, state = machine.run({"msg_id": np.array([1]), "type": np.array(["text"]), "content": np.array(["done"], dtype=object)}, None)
    assert out["reply"] == ["session_lost"] and json.loads(state)["open"] is False


def test_report_cells_of_a_record(spark):
    record = {
        "bridge_title": "SAMPLE ROB", "river_name": "Not Applicable", "latitude": "23.1", "longitude": "72.6", "division": "AMC",
        "circle": "AMC", "angle_of_crossing": "Q", "road_number": "-", "date_of_survey": "2026-04-13", "no_of_spans": "10",
    }
    long = spark.createDataFrame([(1, k, v) for k, v in record.items()], "k int, field string, value string")
    fmt = spark.createDataFrame([(1, "excel_rb")], "k int, fmt string")
    cells = {(r["sheet"], r["cell"]): r["expected"] for r in forms.form_expected(long, fmt, "k", forms.form_map(spark)).collect()}
    assert cells["Appendix-A", "C4"] == "SAMPLE ROB" and cells["Appendix-A", "C9"] == "23.1° , 72.6°"
    assert cells["Appendix-A", "C11"] == cells["Appendix-A", "C12"] == "AMC" and cells["Appendix-A", "C17"] == "Q"
    assert cells["Appendix-B", "C10"] == "AMC" and cells["Appendix-B", "C12"] == "13/04/2026"
    assert ("Appendix-A", "C8") not in cells and ("Appendix-A", "C45") not in cells


def test_cells_of_many_forms_stay_in_as_many_tasks_as_shuffles_have(spark):
    keys = spark.range(2000).withColumnRenamed("id", "k")
    long = keys.select("k", F.lit("river_name").alias("field"), F.lit("Tapi").alias("value"))
    given = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 13)
    try:
        out = forms.form_expected(long, keys.withColumn("fmt", F.lit("excel_rb")), "k", forms.form_map(spark))
        assert out.select(F.spark_partition_id()).distinct().count() == 13
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", given)


RULE = {
    "rule_id": "r1", "title": "t", "applicable_drawing_types": ["ppp"], "required_entities": ["notes.a"], "rule_type": "deterministic",
    "category": "Notes", "engineering_rationale": "e", "source_reference": "s", "message_template": "m",
    "formula": {"type": "min_threshold", "field": "notes.a", "min_value": 1.0},
}


def test_rule_registry(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(RULE) + "\n")
    loaded = rules.load_rules(spark, str(tmp_path)).first()
    assert loaded["severity"] == "error" and loaded["validation_status"] == "pending_pilot_validation"
    bad = [{**RULE, "rule_id": "r2", "formula": {"type": "guess", "field": "x"}}, {**RULE, "rule_id": "r3", "title": ""}, RULE, {**RULE, "rule_id": "r4", "rule_type": "judgment"}]
    (tmp_path / "b.json").write_text("\n".join(json.dumps(b) for b in bad))
    faults = {(r[0], r[1]) for r in rules.rule_faults(spark.read.schema(rules.RULE_SCHEMA).json(str(tmp_path))).collect()}
    assert faults == {("r2", "unknown formula type"), ("r3", "missing title"), ("r1", "duplicate rule_id"), ("r4", "no reasoning_prompt")}
    with pytest.raises(ValueError, match="duplicate rule_id"):
        rules.load_rules(spark, str(tmp_path))


def test_required_sections_need_a_place_of_their_own(spark):
    rows = [(1, 1, "REINFORCEMENT PLAN OF PILECAP"), (2, 1, "REINFORCEMENT PLAN OF PILECAP PLAN OF PILECAP"), (3, 1, "SECTION A-A FOR PILECAP")]
    df = spark.createDataFrame(rows, "d int, ord int, label string").withColumn("box", F.col("ord"))
    out = labels.required_sections(df, df.select("d").distinct(), "d", "label", "ord", labels.REQUIRED_SECTIONS, "box")
    # The longer title has to cover the shorter one where it stands.
    sections = {"REINFORCEMENT PLAN OF PILECAP": ["REINFORCEMENT PLAN OF PILECAP"], "PLAN OF PILECAP": ["PLAN OF PILECAP"]}
    two = labels.required_sections(df, df.select("d").distinct(), "d", "label", "ord", sections, "box")
    present = {(r["d"], r["name"]) for r in two.filter("present").collect()}
    assert (1, "PLAN OF PILECAP") not in present and (2, "PLAN OF PILECAP") in present
    assert {r["name"] for r in out.filter("present AND d = 3").collect()} == {"SECTION A-A FOR PILECAP & PIER"}


def test_passthrough_and_check_log(spark, tmp_path):
    items = spark.createDataFrame([(1, 0, "missing dimension", None), (1, 1, " ", None)], "drawing_id int, ord int, description string, bbox struct<x:double,y:double,w:double,h:double>")
    out = passthrough(items, ["drawing_id"], "dimension_error", 9).collect()
    assert [(r["title"], r["x"], r["width"]) for r in out] == [("missing dimension", 63.0, 34.0)]
    issues = spark.createDataFrame([(1, 2, "C4")], "k int, rule int, cell string")
    sessions = spark.createDataFrame([(1, "p", "excel_rb")], "k int, phone string, fmt string")
    for _ in range(2):
        forms.append_check_log(issues, sessions, "k", str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2


def test_corrections_write_the_whole_value(spark):
    long = "Pier cracks near the bearing. " * 8
    cells = "k int, sheet string, cell string, value string"
    expected = spark.createDataFrame([(1, "Appendix-A", "C9", long)], "k int, sheet string, cell string, expected string")
    actual = spark.createDataFrame([(1, "Appendix-A", "C9", "-")], cells)
    issues = forms.lost_inputs(expected, actual, "k")
    assert issues.first()["expected"] == long[:120]
    assert forms.corrected_cells(actual, issues, "k").first()["value"] == long.strip()


def test_cut_marks_look_at_any_distance_and_need_a_pilecap(spark):
    marks = spark.createDataFrame([(k, 1, "A", 0.0, 0.0) for k in (1, 2)], "k int, mid int, letter string, x double, y double")
    sheets = "k int, ord int, x double, y double, components array<string>"
    labels = spark.createDataFrame([(k, 1, 9000.0, 0.0, ["pile"]) for k in (1, 2)], sheets)
    caps = spark.createDataFrame([(1, 1, 0.0, 1.0, 0.0, 1.0)], "k int, ord int, xmin double, xmax double, ymin double, ymax double")
    got = geometry.cut_mark_component(marks, labels, caps, "k", 100.0).collect()
    assert [(r["k"], r["vote"]) for r in got] == [(1, "pile")]


def test_unknown_messages_open_no_session(spark):
    rows = [(1, "unknown", 1, "text", "hi"), (2, "p", 2, "unknown", None), (3, "p", 3, "unsupported", "hi"), (4, "p", 4, "text", "hi")]
    messages = spark.createDataFrame(rows, "msg_id long, phone string, ts int, type string, content string")
    got = sessions_batch(messages, "phone", ["ts"]).collect()
    assert [(r["msg_id"], r["session_no"]) for r in got] == [(4, 1)]


def test_session_machine_over_many_chunks_takes_as_many_jobs_as_over_few(spark):
    rng = np.random.default_rng(4)
    words = ["hi", "1", "2", "3", "4", "5", "6", "7", "done", "yes", "no", "crack at pier", "new", "thanks", "exit"]
    rows = [(k, "p" if k % 5 else "q", k, "image" if rng.random() < 0.2 else "text", str(rng.choice(words))) for k in range(3000)]
    df = spark.createDataFrame(rows, "msg_id long, phone string, ts int, type string, content string").repartition(2)
    group = spark.sparkContext.statusTracker()
    jobs, results = [], []
    for n, chunk in enumerate([1_000_000, 600, 50]):
        spark.sparkContext.setJobGroup(f"chunks-{n}", "")
        got = sessions_batch(df, "phone", ["ts"], chunk).collect()
        jobs.append(len(group.getJobIdsForGroup(f"chunks-{n}")))
        results.append(sorted(tuple(map(str, r)) for r in got))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert results[0] == results[1] == results[2] and jobs[1] >= jobs[2] - 3


def test_every_control_of_the_machine_is_listed():
    rng = np.random.default_rng(5)
    words = ["hi", "0", "1", "2", "3", "4", "5", "6", "7", "done", "yes", "no", "x", "new", "exit"]
    state, known = None, set(machine.controls())
    for _ in range(20_000):
        state = machine.run({"msg_id": [1], "type": [str(rng.choice(["text", "image"]))], "content": [str(rng.choice(words))]}, state)[1]
        assert machine.control_of(state) in known


def test_section_box_takes_its_sources_in_order(spark):
    labels = spark.createDataFrame(
        [
            (1, "Section Z-Z (pile)", "dxf", 0, 10), (1, "detail of pilecap", "pdf", 5, 11), (1, "PLAN", "pdf", 1, 12), (1, "x", "pdf", 0, None),
            (2, "SECTION Z-Z", "dxf", 0, 20), (3, "e" * 100_000, "pdf", 0, 30), (4, "", "pdf", 0, 40),
        ],
        "d long, label string, space string, ord int, box int",
    )
    sections = spark.createDataFrame(
        [(1, "Section B-B (pier)", 0, 50), (2, "SHORT (a)", 0, 60), (2, "section z-z (pile)", 1, 61), (2, None, 2, 62)],
        "d long, name string, ord int, box int",
    )
    said = [
        (1, 1, "see the DETAILED drawing"),  # a label's word inside another word
        (1, 2, "pilecap in section b-b is wrong"),  # a word of a PDF label before the list
        (1, 3, "section b-b is wrong"),  # the name before the bracket
        (1, 4, "section only"),  # a word of the DXF label
        (2, 5, "bars in section z-z"),  # the list before the DXF label
        (2, 6, "short"),  # five letters before the bracket are too few
        (3, 7, "in " + "E" * 100_001), (4, 8, "anything"), (5, 9, "plan"), (1, 10, None), (1, 11, "a plan"),
    ]
    issues = spark.createDataFrame(said, "d long, i int, t string")
    got = {r.i: (r.space, r.box) for r in section_box(issues, labels, "d", "i", "t", sections).collect()}
    assert got == {1: ("pdf", 11), 2: ("pdf", 11), 3: ("list", 50), 4: ("dxf", 10), 5: ("list", 61), 7: ("pdf", 30), 11: ("pdf", 12)}
    assert {r.i for r in section_box(issues, labels, "d", "i", "t").collect()} == {1, 2, 3, 4, 5, 7, 11}


def test_header_cells_end_at_each_table_s_own_data_row(spark):
    cells = [
        # two tables side by side; rows count from the top
        (1, 0, 10.0, 1, 90.0, "TABLE-1"), (1, 1, 60.0, 1, 90.0, "TABLE 1"), (1, 2, 5.0, 2, 80.0, "TOP LVL"), (1, 3, 70.0, 2, 80.0, "TOP LVL"),
        (1, 4, 8.0, 3, 70.0, "LP1"), (1, 5, 9.0, 3, 70.0, "x"), (1, 6, 65.0, 3, 70.0, "BOT LVL"), (1, 7, 64.0, 4, 60.0, " "), (1, 8, 66.0, 4, 60.0, "(rp2 5.5"),
        (1, 9, 67.0, 5, 50.0, "late"), (1, 10, 7.0, 0, 95.0, "above"),
    ]
    cells += [(2, 0, 10.0, 1, 90.0, "TABLE-1")] + [(2, k, 10.0 + k, 2, 80.0, f"c{k}") for k in range(1, 60)]  # no data row, and many cells
    df = spark.createDataFrame(cells, "d long, ord long, x double, row int, row_y double, text string")
    labels = spark.createDataFrame([(1, 0, 10.0, 90.0, 0.0, 100.0), (1, 1, 60.0, 90.0, 0.0, 100.0), (2, 0, 10.0, 90.0, 0.0, 100.0)], "d long, tid long, x double, y double, lo double, hi double")
    windows = schedule.table_windows(labels, ["d"], "x", "tid", "lo", "hi")
    got = sorted((r.d, r.tid, r.ord) for r in schedule.table_header_cells(df, windows, ["d"], "tid").collect())
    assert got == [(1, 0, 2), (1, 1, 3), (1, 1, 6)] + [(2, 0, k) for k in range(1, 60)]
    assert schedule.table_header_cells(df.limit(0), windows, ["d"], "tid").count() == 0


def test_digest_of_drawings_with_and_without_parts(spark):
    drawings = spark.createDataFrame([(1,), (2,)], "d long")
    bars = spark.createDataFrame(
        [(1, "pile", "b", 1, 16, None, 4, None), (1, "pile", "a", 1, None, 150.0, None, 2.5), (1, "pile", "a", 2, 20, None, None, None)],
        "d long, component string, bar_mark string, zone_ord int, bar_dia_mm int, spacing_mm double, count int, length_m double",
    )
    pairs = lambda rows: spark.createDataFrame(rows, "d long, name string, value string")
    issues = spark.createDataFrame([(1, 2, None, "second"), (1, 1, "Notes", "first")], "d long, ord int, category string, title string")
    out = rules.summary_digest(drawings, bars, pairs([(1, "z", "1"), (1, "a", "2")]), pairs([(1, "n", None)]), issues, "d").orderBy("d", "line_no").collect()
    one = [r.line for r in out if r.d == 1]
    assert one[:4] == ["DRAWING SUMMARY", "", "Components present: pile", ""] and one[4] == "PILE schedule:"
    assert one[5:9] == ["  a (zone 1): dia=Nonemm, spacing=150.0mm, length=2.5m", "  a (zone 2): dia=20mm", "  b: dia=16mm, count=4", ""]
    assert one[9:13] == ["Geometry (dimensions extracted from drawing):", "  a: 2", "  z: 1", ""]
    assert one[13].startswith("ALREADY-FLAGGED ISSUES (") and one[14:] == ["  [Notes] first", "  [General] second", ""]
    assert [r.line for r in out if r.d == 2] == [
        "DRAWING SUMMARY", "", "Components present: (none detected)", "", "ALREADY-FLAGGED ISSUES: none found by the other checks.", "",
    ]


def test_a_damaged_design_file_keeps_no_other_from_being_read(spark):
    files = [
        (1, 0, "a", '{"dia": "1.2", "pier": {"shape": "Circular"}, "cap": 5}'), (1, 1, "b", '{"dia": '), (1, 2, "c", '{"dia": "", "pier": {}, "cap": 0, "new": [1]}'),
        (1, 3, "d", None), (1, 4, "e", "[1, 2]"), (2, 0, "f", "not json"),
    ]
    merged, broken = reconcile.merge_design_files(spark.createDataFrame(files, "k long, ord int, name string, body string"), ["k"])
    assert sorted((r.k, r.field, r.value) for r in merged.collect()) == [
        (1, "cap", "5"), (1, "dia", "1.2"), (1, "new", "[1]"), (1, "pier", '{"shape":"Circular"}'),
    ]
    assert sorted((r.k, r["name"], r.message) for r in broken.collect()) == [(k, n, f"{n}: not readable") for k, n in ((1, "b"), (1, "d"), (1, "e"), (2, "f"))]


def test_all_faults_of_a_registry_are_counted(spark, tmp_path):
    (tmp_path / "r.json").write_text("\n".join(json.dumps({"rule_id": f"r{k}"}) for k in range(9)))
    with pytest.raises(ValueError, match=r"and \d+ more$"):
        rules.load_rules(spark, str(tmp_path / "r.json"))


def test_cells_are_traced_alike_with_few_and_with_many_values(spark, monkeypatch):
    cells = [(1, "abc"), (1, "zz"), (1, "q"), (1, "say Tapi twice"), (1, "no"), (1, "-"), (1, "a  b"), (2, "xy"), (2, "abc"), (None, "abc"), (3, "12.5 m")]
    cells = spark.createDataFrame([(k, "S", f"C{i}", t) for i, (k, t) in enumerate(cells)], "k long, sheet string, cell string, value string")
    vals = [(1, "xabcx"), (1, "zz"), (1, "q1"), (1, "Tapi"), (1, "n"), (1, "   "), (1, None), (2, "xyz"), (2, "xyz"), (None, "abc"), (3, "12")]
    vals = spark.createDataFrame(vals, "k long, value string")
    found = lambda: sorted(r.cell for r in forms.untraceable(cells, vals, "k").collect())
    monkeypatch.setattr(forms, "VALUES_AT_ONCE", 0)
    by_grams = found()
    monkeypatch.setattr(forms, "VALUES_AT_ONCE", 1)
    mixed = found()
    monkeypatch.setattr(forms, "VALUES_AT_ONCE", 500)
    monkeypatch.setattr(forms, "contained", None)  # few values need no join on grams
    assert found() == mixed == by_grams == ["C10", "C2", "C4", "C6", "C8", "C9"]


def test_section_boxes_with_few_and_with_many_names(spark, monkeypatch):
    rows = [(d, f"label no {d}{k}", "pdf", k, 10 * d + k) for d in (1, 2) for k in range(4)] + [(2, " ", "pdf", 0, 99)]
    names = spark.createDataFrame(rows, "d long, label string, space string, ord int, box int")
    issues = spark.createDataFrame([(1, 1, "see Label no 13"), (2, 2, "label no 21, label no 20"), (2, 3, "nothing"), (2, 4, None)], "d long, i int, t string")
    found = lambda: {r.i: r.box for r in section_box(issues, names, "d", "i", "t").collect()}
    monkeypatch.setattr(labels, "NAMES_AT_ONCE", 0)
    by_grams = found()
    monkeypatch.setattr(labels, "NAMES_AT_ONCE", 500)
    monkeypatch.setattr(labels, "contained", None)
    assert found() == by_grams


def test_anchors_of_many_keys_at_once_are_those_of_a_row_by_row_pass():
    rng = np.random.default_rng(3)
    for strict in (False, True):
        sizes = rng.integers(1, 30, 200)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        v = np.concatenate([np.sort(rng.integers(0, 60, n) / 4.0) for n in sizes])
        reach = np.repeat(rng.integers(1, 5, len(sizes)) / 2.0, sizes)
        want, anchor, place = [], v[0] - 0.25, -1
        for at, value in enumerate(v):
            gap = value - anchor
            if at and at in starts or (gap >= reach[at] if strict else gap > reach[at]):
                anchor, place = value, at
            want.append(place)
        assert schedule.anchor_places(starts, v, reach, strict, v[0] - 0.25).tolist() == want


def test_an_anchor_goes_on_into_the_next_batch_and_through_hot_keys(spark, monkeypatch):
    rows = [(k, float(x), 100 * k + x, 2.5) for k in range(3) for x in range(40)] + [(7, None, 900, 2.5), (7, 1.0, 901, 2.5)]
    items = spark.createDataFrame(rows, "k long, v double, tie long, tol double").repartition(3)
    given = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = lambda: sorted((r.tie, r.anchor, r.anchor_tie) for r in schedule.anchor_groups(items.filter("k < 7"), ["k"], "v", "tie", "tol").collect())
    want = [(100 * k + x, float(x // 3 * 3), 100 * k + x // 3 * 3) for k in range(3) for x in range(40)]
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
        assert found() == want
        assert {(r.tie, r.anchor) for r in schedule.anchor_groups(items, ["k"], "v", "tie", "tol").filter("k = 7").collect()} == {(900, None), (901, 1.0)}
        monkeypatch.setattr(schedule, "CHUNK_ROWS", 10)
        assert found() == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", given)


def shuffles(df):
    return [line for line in df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")).splitlines() if "Exchange hashpartitioning" in line]


def test_rules_meet_drawings_without_a_shuffle_by_rule_or_type(spark):
    kinds = "rule_id string, title string, applicable_drawing_types array<string>, required_entities array<string>, rule_type string, category string, severity string, unit string, message_template string, formula struct<type:string,field:string,min_value:double,max_value:double,expected_value:double>"
    row = lambda r, types, needs, field: (r, "t", types, needs, "deterministic", "c", "error", "mm", "{value}", ("min_threshold", field, 5.0, None, None))
    table = spark.createDataFrame([row("A", ["f", "o"], ["n.a", "n.b", "n.a"], "n.a"), row("B", ["f"], [], "n.b"), row("C", ["f"], ["n.c"], "n.c")], kinds)
    drawings = spark.createDataFrame([(1, "f"), (2, "o"), (3, "x"), (4, "f")], "d long, drawing_type string")
    given = spark.createDataFrame([(1, "a", "4"), (1, "b", "7"), (2, "a", "9"), (2, "b", "1"), (2, "b", "2"), (3, "a", "1"), (4, "a", None), (4, "c", "x")], "d long, p string, v string")
    values = rules.paths([(given, [F.lit("n"), F.col("p")], F.col("v"))], "d")
    pairs = rules.applicable_rules(table, drawings, values, "d")
    assert sorted(map(tuple, pairs.collect())) == [(1, "A"), (1, "B"), (2, "A"), (4, "B"), (4, "C")]
    out = rules.rule_verdicts(table, pairs, values, "d")
    assert sorted((r.d, r.rule_id, r.status, r.reason) for r in out.collect()) == [
        (1, "A", "violated", None), (1, "B", "passed", None), (2, "A", "passed", None), (4, "B", "skipped", "absent"), (4, "C", "skipped", "not numeric"),
    ]
    by = [line.split("hashpartitioning(")[1] for line in shuffles(out)]
    assert all(not x.startswith("rule_id") and not x.startswith("drawing_type") or "ENSURE" in x and "d#" in x for x in by), by
    assert any("REPARTITION_BY_NUM" in x for x in by)


def test_rows_that_swell_are_not_merged_by_their_compressed_size(spark):
    long = spark.createDataFrame([(1, "division", "a"), (1, "circle", "b")], "k long, field string, value string")
    values = forms.value_set(long, "k")
    assert sorted(r.value for r in values.collect()) == ["a", "a / b", "b"]
    assert all("REPARTITION_BY_NUM" in line for line in shuffles(values))
    empty = lambda kinds: spark.createDataFrame([], kinds)
    bars = empty("d long, component string, bar_mark string, zone_ord int, bar_dia_mm int, spacing_mm double, count int, length_m double")
    pairs, issues = empty("d long, name string, value string"), empty("d long, ord int, category string, title string")
    digest = rules.summary_digest(spark.createDataFrame([(1,)], "d long"), bars, pairs, pairs, issues, "d")
    assert digest.count() == 6 and any("REPARTITION_BY_NUM" in line for line in shuffles(digest))


def test_conditions_and_texts_of_issues_are_not_interpreted(spark):
    # Lambdas are interpreted, and with them the arrays they go through.
    from spanledger.operators.issues import emit, issue

    c = F.col
    df = spark.createDataFrame([(1, 5.0, 7.0), (2, 5.0, 5.0), (3, None, 7.0), (4, 0.0, 9.0)], "id long, a double, b double")
    checks = [
        (c("a") != c("b"), issue("pile_length", d=c("a"), w=c("b"))),
        (c("b") > 8, issue("note_missing", name=F.concat(F.lit("b of "), c("id").cast("string")))),
        (c("a") > 100, issue("stray_box", name=c("id"))),
    ]
    out = emit(df, ["id"], [F.lit(4), c("id")], checks).select("id", "ord", "code", "title", "description")
    assert [tuple(r) for r in out.orderBy("id", "ord").collect()] == [
        (1, [4, 1, 0], "pile_length", "Pile length mismatch: note says 7.0m, design says 5.0m", "The pile length note differs from the design."),
        (4, [4, 4, 0], "pile_length", "Pile length mismatch: note says 9.0m, design says 0.0m", "The pile length note differs from the design."),
        (4, [4, 4, 1], "note_missing", "b of 4", "A required note was not found in the drawing text."),
    ]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # Before: a fold over the values for each text, and the conditions inside the lambda that drops nulls.
    assert "aggregate(" not in plan
    lambdas = [line for line in plan.split("\n") if "lambdafunction" in line]
    assert lambdas and not any("CASE WHEN" in line for line in lambdas)


def test_bars_are_joined_once_for_values_and_shapes(spark):
    # Before: once for each.
    from spanledger.operators import reconcile as C
    from spanledger.queries.reconcile import design_bars, drawing_bars
    from spanledger.queries.registry import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    out = C.bar_scalar_issues(C.mark_summary(design_bars(t)), drawing_bars(t))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1


def test_segments_of_many_rows_are_matched_as_row_by_row(spark, monkeypatch):
    from spanledger.functions import numbers as N

    def greedy(design, drawing):
        if design is None:
            return None
        design = sorted(d * 1000 for d in design if d)
        rest = []
        for w in sorted(w for w in drawing or [] if w):
            digits = str(round(w))
            if len(digits) > 1 and digits[0] == "1" and any(d > 0 and abs(float(digits[1:]) - d) / d < 0.03 for d in design):
                w = float(digits[1:])
            rest.append(w)
        out = []
        for d in design:
            if rest:
                out.append((d, rest.pop(min(range(len(rest)), key=lambda i: abs(rest[i] - d)))))
        return out

    monkeypatch.setattr(N, "AT_ONCE", 64)
    rnd = random.Random(2)
    some = lambda values, n: [rnd.choice(values) for _ in range(n)]
    rows = [(i, some([0.12, 0.25, 0.25, 1.0, 0.0, None, 2.5], rnd.choice([0, 1, 2, 2, 5])), some([120.0, 1120.0, 20.0, 250.0, 1250.0, 0.0, None, -3.0, 2500.5], rnd.choice([0, 1, 2, 2, 40]))) for i in range(300)]
    rows += [(900, None, [1.0]), (901, [1.0], None), (902, [None], [None])]
    df = spark.createDataFrame(rows, "id long, a array<double>, b array<double>")
    out = df.select("id", N.match_dims(F.col("a"), F.col("b")).alias("p"))
    got = {r["id"]: None if r["p"] is None else [tuple(p) for p in r["p"]] for r in out.collect()}
    assert got == {i: greedy(a, b) for i, a, b in rows}
    # Before: nested lambdas for each row.
    assert "lambdafunction" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_bar_totals_take_one_pass_over_either_side(spark):
    from spanledger.operators import reconcile as C
    from spanledger.queries.reconcile import design_bars, drawing_bars, pile_counts
    from spanledger.queries.registry import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    out = C.bar_total_issues(design_bars(t), drawing_bars(t), pile_counts(t))
    # Before: sums and zone rows were grouped apart and the sums' rows made for each branch, six groupings and six joins.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 2 and plan.count("Join ") == 2


def test_bar_totals_of_paired_and_of_summed_marks(spark):
    from spanledger.operators import reconcile as C

    design = [("d", "pile", "a", 1, 1, 10, 10.0, 5.0), ("d", "pile", "a", 1, 2, 4, 4.0, 2.0), ("d", "pile", "b", 2, 1, 7, 7.0, 7.0), ("d", "pile", "b", 2, 2, 1, 1.0, None)]
    drawing = [("d", "pile", "a", 1, 1, 4, 4.0, 2.0), ("d", "pile", "a", 1, 2, 12, 10.0, 5.0), ("d", "pile", "b", 2, 1, 9, 8.0, 7.0)]
    more = {"dia_mm": "int", "spacing_mm": "double", "length_m": "double", "unit_wt": "double", "reinf_secondary": "string", "shape_dims": "array<double>"}
    names = "drawing_id string, component string, bar_mark string, mark_ord int, zone_ord int, count int, {} double, total_wt_kg double"
    d = spark.createDataFrame(design, names.format("total_len_m")).withColumns({k: F.lit(None).cast(v) for k, v in more.items()})
    w = spark.createDataFrame(drawing, names.format("total_length_m"))
    piles = spark.createDataFrame([("other", 3)], "drawing_id string, pile_count int")
    got = {(r["bar_mark"], r["code"], tuple(r["ord"]), r["title"]) for r in C.bar_total_issues(d, w, piles).collect()}
    # Rows of a are paired by count, those of b summed; a weight that is missing is not summed.
    assert got == {
        ("a", "bar_count", (4, 2, 1, 1000, 0), "Bar 'a' (pile): Count mismatch — design 10 nos, drawing 12 nos"),
        ("b", "bar_count", (4, 2, 2, 1000, 0), "Bar 'b' (pile): Count mismatch — design 8 nos, drawing 9 nos"),
    }


def test_geometry_of_readings_with_large_numbers(spark, tmp_path):
    from spanledger.queries import QUERIES

    spark.createDataFrame([(1, 0)], "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    lines = [(1, 5, 360_000, 2, 50.0), (1, 6, 1, 2, 20.0), (1, 6, 2, 1, 15.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    # Before: the order of a reading, 3,600 million here, was cast to an int.
    assert sorted(map(tuple, QUERIES["geometry_issues"](spark, str(tmp_path)).collect())) == [(1, "geometry", "pile_spacing", 2), (1, "geometry_spread", "pile_spacing", 1)]


def test_halves_sort_like_the_number(spark):
    from spanledger.operators.issues import halves

    numbers = [-(2**62), -(2**32), -1, 0, 1, 2**31 - 1, 2**31, 3_600_000_000, 2**32 - 1, 2**32, 2**62]
    df = spark.createDataFrame([(n,) for n in reversed(numbers)], "n long")
    assert [r["n"] for r in df.orderBy(F.array(*[h.cast("int") for h in halves(F.col("n"))])).collect()] == numbers
