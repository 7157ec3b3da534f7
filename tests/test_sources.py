"""Readers on small files."""

import json

from spanledger.sources.readers import read_report_records, read_table, record_defects, record_photos
from spanledger.sources.schemas import TABLES

RECORD = {
    "bridge_title": "KHOKHARA ROB", "no_of_spans": "3", "photos": ["a.jpg", "b.jpg"], "photo_titles": ["A", "B"],
    "photo_categories": ["general", "damaged"], "photo_coords": [[0.1, 0.2], None],
    "defect_sub1": {"P1": {"cracks": "Hairline", "leakage": "-"}, "P2": {}}, "sub_piers_side1": ["P1", "P2"],
}


def test_report_records(spark, tmp_path):
    (tmp_path / "s1.json").write_text(json.dumps(RECORD, indent=1))
    (tmp_path / "s2.json").write_text("{broken")
    df = read_report_records(spark, str(tmp_path), ["bridge_title", "no_of_spans", "river_name"])
    rows = {r["session_id"]: r for r in df.collect()}
    assert rows["s1"]["bridge_title"] == "KHOKHARA ROB" and rows["s1"]["river_name"] is None
    assert rows["s2"]["bridge_title"] is None
    defects = {(r["tbl"], r["element"], r["defect"], r["obs"]) for r in record_defects(df, "session_id").collect()}
    assert defects == {("defect_sub1", "P1", "cracks", "Hairline"), ("defect_sub1", "P1", "leakage", "-")}
    photos = [(r["ord"], r["path"], r["category"], r["coord"]) for r in record_photos(df, "session_id").orderBy("ord").collect()]
    assert photos == [(0, "a.jpg", "general", (0.1, 0.2)), (1, "b.jpg", "damaged", None)]


def test_tables_keep_their_schema_and_prune_columns(spark, tmp_path):
    for name in TABLES:
        spark.createDataFrame([], TABLES[name]).write.parquet(f"{tmp_path}/{name}")
        assert read_table(spark, str(tmp_path), name).columns == spark.createDataFrame([], TABLES[name]).columns
    some = read_table(spark, str(tmp_path), "messages", ["id", "content"])
    assert "image_data" not in some._jdf.queryExecution().executedPlan().toString()
    spark.createDataFrame([(1, 1, "A")], "row int, col int, value string").write.json(f"{tmp_path}/j/design_cells")
    cell = read_table(spark, f"{tmp_path}/j", "design_cells", source="json").first()
    assert (cell["row"], cell["value"], cell["formula"]) == (1, "A", None)
