"""Schemas of the stored tables, as DDL.

Binary columns (photo bytes, drawing files) are part of the schemas, so that a reader
that does not select them never touches them.
"""

BOX = "struct<x:double,y:double,w:double,h:double>"

TABLES = {
    "sessions": (
        "id bigint, phone string, bridge string, status string, state string, photo_count int, started_at timestamp, "
        "ended_at timestamp, report_path string, report_format string"
    ),
    "messages": (
        "id bigint, phone string, session_id bigint, type string, content string, media_path string, category string, "
        "photo_num int, seq int, created_at timestamp, image_data binary"
    ),
    "drawings": "id bigint, name string, drawing_type string, created_at timestamp",
    "reviews": (
        "id bigint, drawing_id bigint, version int, pdf_content binary, status string, created_at timestamp, "
        "design_data string, dxf_content binary, recovery_attempts int, batch_id string, batch_index int"
    ),
    "issues": (
        "id bigint, review_id bigint, category string, title string, description string, suggestion string, "
        "severity string, page_num int, x double, y double, width double, height double, status string, confidence string"
    ),
    "design_cells": "drawing_id string, row int, col int, value string, formula string, font_nonblack boolean",
    "text_entities": (
        "drawing_id string, layout string, text string, x double, y double, from_block boolean, is_attrib boolean, ord bigint"
    ),
    "shapes": (
        "drawing_id string, kind string, layer string, block_name string, x double, y double, r double, xmin double, "
        "ymin double, xmax double, ymax double, n_points int, is_closed boolean, ord bigint"
    ),
    "dimensions": (
        "drawing_id string, val double, override_text string, d2x double, d2y double, d3x double, d3y double, tx double, "
        "ty double, ord bigint"
    ),
    "callouts": "drawing_id string, raw_text string, x double, y double, ord bigint",
    "sheets": "drawing_id string, xmin double, ymin double, xmax double, ymax double, units_code int",
    "pdf_words": (
        "drawing_id string, page int, text string, x0 double, x1 double, top double, bottom double, page_w double, "
        "page_h double, ord bigint"
    ),
    "xsec": (
        "drawing_id string, section_name string, component string, bar_mark string, visual_count int, is_bundle boolean, "
        "spacing_uniform boolean, spacing_issues array<struct<type:string,location:string,description:string,"
        f"angle_rad:double>>, bbox {BOX}"
    ),
    "diagnostics": "drawing_id string, code string, message string, severity string",
}

#: The matrices and lists of a report record; every other field is text.
MATRICES = ["defect_sub1", "defect_sub2", "defect_super1", "defect_super2"]
LISTS = ["sub_piers_side1", "sub_piers_side2", "super_spans_side1", "super_spans_side2", "photos", "photo_titles", "photo_categories"]
