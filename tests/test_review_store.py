"""The stored table of issues: replaced review by review, whatever is repeated."""

import pytest
from pyspark.sql import functions as F

from spanledger.operators import review as V
from spanledger.operators.issues import MESSAGES, degraded
from spanledger.queries import QUERIES


def issues_of(spark, rows):
    """Issues of (review, name, code) as a review gives them."""
    df = spark.createDataFrame(rows, "review_id long, name string, code string").withColumn("drawing_id", F.col("review_id")).withColumn("ord", F.lit(0))
    return V.listed_issues(df, "label_error", 7, "name").join(df.select("drawing_id", "review_id").distinct(), "drawing_id")


def stored(spark, path):
    return sorted((r.review_id, r.title) for r in V.saved_review_issues(spark, path).collect())


@pytest.mark.parametrize("buckets", [1, 4])
def test_only_the_given_reviews_change(spark, tmp_path, buckets):
    path = str(tmp_path / "issues")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "review_id long")
    first = issues_of(spark, [(i, f"t{i}", "") for i in range(8)] + [(3, "again", "")])
    V.save_issues(first, ids(*range(8)), path, buckets)
    want = sorted([(i, f"t{i}") for i in range(8)] + [(3, "again")])
    assert stored(spark, path) == want
    V.save_issues(first, ids(*range(8), 3), path, buckets)  # a repeat, and an id given twice
    assert stored(spark, path) == want
    # Issues of reviews that are not given are left out; a given review without issues loses those it had.
    V.save_issues(issues_of(spark, [(2, "new", ""), (5, "stray", "")]), ids(2, 3), path, buckets)
    assert stored(spark, path) == sorted([(i, f"t{i}") for i in (0, 1, 4, 5, 6, 7)] + [(2, "new")])
    V.save_issues(issues_of(spark, []), ids(*range(8)), path, buckets)
    assert stored(spark, path) == []


def test_store_of_no_reviews(spark, tmp_path):
    path = str(tmp_path / "issues")
    V.save_issues(issues_of(spark, [(1, "a", "")]), spark.createDataFrame([(1,)], "review_id long"), path, 4)
    V.save_issues(issues_of(spark, []), spark.createDataFrame([], "review_id long"), path, 4)
    assert stored(spark, path) == [(1, "a")]


def test_every_kind_of_finding_occurs_in_the_review(spark):
    from conftest import SMALL

    assert {r.code for r in QUERIES["review_codes"](spark, SMALL).collect()} == set(MESSAGES)


def test_plan_of_a_review_does_not_grow_with_its_checks(spark):
    one = issues_of(spark, [(1, "a", ""), (2, "b", "")]).select("drawing_id", *V.COLUMNS)
    status = spark.createDataFrame([(i, True, True, True, False) for i in (1, 2)], "drawing_id long, has_design boolean, has_schedule boolean, has_title boolean, from_pdf boolean")
    failures = spark.createDataFrame([(2, "unreadable")], "drawing_id long, message string")
    few, many = (V.review_issues([one] * n, status, failures) for n in (1, 9))
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))
    leaves = [df._jdf.queryExecution().optimizedPlan().collectLeaves().size() for df in (few, many)]
    assert leaves[0] == leaves[1]


def test_diagnostics_are_issues_only_as_errors(spark):
    rows = [
        (1, "layout", "x" * 300, "error", 0), (1, "layout", "seen", "info", 1), (1, "section_grade_mismatch", "M35", "error", 2), (1, None, None, "error", 3),
    ]
    out = V.diagnostic_issues(spark.createDataFrame(rows, "drawing_id long, code string, message string, severity string, ord int"), 1).collect()
    got = sorted((r.code, r.category, r.title, r.description) for r in out)
    assert got == [
        ("diagnostic", "Extraction", "Extraction degraded", "Extraction degraded"),
        ("diagnostic", "Extraction", "x" * 120, "x" * 300),
        ("notes_grade", "Notes", "M35", "M35"),
    ]


def test_views_of_other_components_are_not_required(spark):
    names = [("SECTION Z-Z (PILE)", 1), ("PLAN OF PILECAP", 2), ("TABLE-1", 3)]
    rows = [(d, n, False, k) for d in (1, 2, 3) for n, k in names] + [(1, "SECTION A-A FOR PILE", True, 0)]
    sections = spark.createDataFrame(rows, "drawing_id long, name string, present boolean, no int")
    scope = spark.createDataFrame([(1, ["pile"]), (2, [])], "drawing_id long, scope array<string>")
    got = sorted((r.drawing_id, r.title.removeprefix("Missing view: ")) for r in V.view_issues(sections, scope, 5).collect())
    assert got == [(1, "SECTION Z-Z (PILE)"), (1, "TABLE-1"), *[(d, n) for d in (2, 3) for n in ("PLAN OF PILECAP", "SECTION Z-Z (PILE)", "TABLE-1")]]


def test_marks_in_tables_are_no_cut_marks(spark):
    gone = spark.createDataFrame([(1, "A", "plan", 0), (1, "B", "General Notes", 1), (1, "C", None, 2)], "drawing_id long, mark string, found_on string, ord int")
    unseen = spark.createDataFrame([(1, "Z1", 0)], "drawing_id long, mark string, ord int")
    got = sorted(r.title for r in V.cut_mark_issues(gone, unseen, 10).collect())
    assert got == ["Missing cut-mark arrow: Z1", "Missing section view: SECTION A-A", "Missing section view: SECTION C-C"]


def test_degraded_without_rows(spark):
    status = spark.createDataFrame([(1, False, True, True, False)], "drawing_id long, has_design boolean, has_schedule boolean, has_title boolean, from_pdf boolean")
    none = V.listed_issues(spark.createDataFrame([], "drawing_id long, name string, ord int"), "label_error", 7, "name")
    assert [r.code for r in degraded(none, status, "drawing_id").collect()] == ["no_design"]


def small_tables(spark, folder):
    lines = [(d, 7 * d + n, 3 * d + n, n % 7 + 1, float(10 + d + n), 100.0 + n, "ANR"[n % 3]) for d in range(12) for n in range(9)]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string"
    spark.createDataFrame(lines, names).write.parquet(f"{folder}/lineitem.parquet")
    orders = [(d, 5 * d, "FOP"[d % 3], f"{d % 5}-HIGH") for d in range(12)]
    orders = spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string")
    orders.withColumn("o_orderdate", F.to_timestamp(F.lit("2020-01-01"))).write.parquet(f"{folder}/orders.parquet")


def test_checks_of_a_review_shuffle_nothing(spark, tmp_path):
    from spanledger.plans.durable import AS_DEALT
    from spanledger.queries import drawing_review as D
    from spanledger.queries.registry import Tables
    from spanledger.session import GROUPED, held_settings

    small_tables(spark, tmp_path)
    large = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    with held_settings(spark, GROUPED | AS_DEALT | large):
        parts, _, _ = D.review_parts(D.by_drawing(Tables(spark, str(tmp_path))))
        plans = [p._jdf.queryExecution().executedPlan().toString() for p in parts]
    # Before: each check read and shuffled the line items or orders anew, up to 22 times.
    assert [plan.count("Exchange hashpartitioning") for plan in plans] == [0] * len(parts)
    # One finding a row needs no list of findings.
    assert "Generate explode" not in plans[1] + plans[12]


def test_columns_that_are_not_read_change_nothing_else(spark):
    one = issues_of(spark, [(1, "a", ""), (1, "a", ""), (2, "b", ""), (3, "c", "")]).select("drawing_id", *V.COLUMNS)
    status = spark.createDataFrame([(i, i != 3, True, True, False) for i in (1, 2, 3)], "drawing_id long, has_design boolean, has_schedule boolean, has_title boolean, from_pdf boolean")
    failures = spark.createDataFrame([(2, "unreadable")], "drawing_id long, message string")
    whole, some = V.review_issues([one, one], status, failures), V.review_issues([one, one], status, failures, columns=["title"])
    assert some.columns == ["drawing_id", "ord", "code", "category", "title"]
    got = sorted(map(tuple, some.collect()))
    assert got == sorted(map(tuple, whole.select(*some.columns).collect()))
    assert [(r[0], r[4]) for r in got] == [(1, "a"), (2, "Processing failed"), (3, "No design input provided")]


def test_texts_are_filled_from_their_pieces(spark):
    from spanledger.operators.issues import emit, issue

    df = spark.createDataFrame([(1, "x", 2.5, None), (2, None, 1.0, "s")], "k long, mark string, d double, name string")
    say = {"mark": F.col("mark"), "comp": F.lit("pile"), "d": F.col("d"), "w": F.lit(3)}
    out = emit(df, ["k"], [], [(F.col("d") > 2, issue("reinf_kind", **say)), (F.lit(True), issue("bar_length", **say)), (F.col("k") == 2, issue("view_missing", name=F.col("name")))])
    assert sorted((r["k"], r["code"], r["title"]) for r in out.collect()) == [
        (1, "bar_length", "Bar 'x' (pile): Bar length mismatch — design 2.5m, drawing 3m"),
        (1, "reinf_kind", "Bar 'x' (pile): Reinforcement column format wrong — shows 3, expected 2.5"),
        (2, "bar_length", "Bar '' (pile): Bar length mismatch — design 1.0m, drawing 3m"),
        (2, "view_missing", "Missing view: s"),
    ]


def test_saved_issues_are_set_aside_as_a_table(spark, tmp_path, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    # Before: the rows of a save went into a checkpoint, in which equal texts are not packed.
    monkeypatch.setattr(DataFrame, "checkpoint", lambda *_, **__: pytest.fail("a checkpoint"))
    path = str(tmp_path / "issues")
    for name in ("a", "b"):
        V.save_issues(issues_of(spark, [(1, name, ""), (2, name, "")]), spark.createDataFrame([(1,), (3,)], "review_id long"), path, 4)
        assert stored(spark, path) == [(1, name)]
