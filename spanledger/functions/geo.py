"""Sheet coordinates, units, clock positions and dates."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanledger.functions.text import strip

# Drawing unit code to millimetres.
UNITS_TO_MM = {1: 25.4, 2: 304.8, 4: 1.0, 5: 10.0, 6: 1000.0, 7: 1000000.0}

# Boxes (x, y, w, h in percent) used when a zone has no usable box.
FALLBACK_BOXES = {
    "pilecap_schedule": (62.0, 10.0, 35.0, 22.0),
    "pile_schedule": (62.0, 32.0, 35.0, 15.0),
    "pier_schedule": (62.0, 47.0, 35.0, 22.0),
    "title_block": (63.0, 77.0, 34.0, 20.0),
    "notes": (63.0, 67.0, 34.0, 9.0),
    "default": (63.0, 22.0, 34.0, 4.0),
}

BOX = "struct<x:double,y:double,w:double,h:double>"


def units_to_mm(code: Column) -> Column:
    known = F.create_map(*[F.lit(v) for kv in UNITS_TO_MM.items() for v in kv])
    return F.coalesce(F.try_element_at(known, code.cast("int")), F.lit(1.0))


def span(lo: Column, hi: Column) -> Column:
    return F.when(hi - lo == 0, F.lit(1.0)).otherwise(hi - lo)


def to_pct(x: Column, y: Column, ext: Column) -> Column:
    """A point in percent of the sheet; y counts from the top."""
    dx, dy = span(ext["xmin"], ext["xmax"]), span(ext["ymin"], ext["ymax"])
    return F.struct(
        F.bround((x - ext["xmin"]) / dx * 100, 2).alias("x"),
        F.bround((ext["ymax"] - y) / dy * 100, 2).alias("y"),
    )


def to_box(x0: Column, y0: Column, x1: Column, y1: Column, ext: Column) -> Column:
    dx, dy = span(ext["xmin"], ext["xmax"]), span(ext["ymin"], ext["ymax"])
    left, right = F.least(x0, x1), F.greatest(x0, x1)
    low, top = F.least(y0, y1), F.greatest(y0, y1)
    return F.struct(
        F.bround((left - ext["xmin"]) / dx * 100, 2).alias("x"),
        F.bround((ext["ymax"] - top) / dy * 100, 2).alias("y"),
        F.bround((right - left) / dx * 100, 2).alias("w"),
        F.bround((top - low) / dy * 100, 2).alias("h"),
    )


def box(x, y, w, h) -> Column:
    return F.struct(
        *[F.lit(v).cast("double").alias(n) if not isinstance(v, Column) else v.cast("double").alias(n)
          for n, v in zip("xywh", (x, y, w, h))]
    )


def fallback_box(zone: Column) -> Column:
    def fixed(v):
        return "named_struct('x', {}D, 'y', {}D, 'w', {}D, 'h', {}D)".format(*v)

    known = ", ".join(f"'{k}', {fixed(v)}" for k, v in FALLBACK_BOXES.items())
    return F.coalesce(F.try_element_at(F.expr(f"map({known})"), zone), F.expr(fixed(FALLBACK_BOXES["default"])))


def box_or_fallback(zone: Column, b: Column) -> Column:
    """A box inside loose limits, else the fixed box of its zone."""
    ok = (
        b["x"].between(0, 100)
        & b["y"].between(0, 100)
        & (b["w"] > 0) & (b["w"] <= 80)
        & (b["h"] > 0) & (b["h"] <= 50)
    )
    return F.when(F.coalesce(ok, F.lit(False)), box(b["x"], b["y"], b["w"], b["h"])).otherwise(
        fallback_box(zone)
    )


def section_box_or_fallback(zone: Column, b: Column) -> Column:
    """As above for a schedule section, which lies in the right part of a sheet."""
    ok = (
        b["x"].between(55, 85)
        & b["y"].between(0, 85)
        & b["w"].between(10, 45)
        & b["h"].between(4, 70)
    )
    return F.when(F.coalesce(ok, F.lit(False)), box(b["x"], b["y"], b["w"], b["h"])).otherwise(
        fallback_box(zone)
    )


def clock(angle: Column) -> Column:
    """Clock position of an angle (0 to the right, counter-clockwise)."""
    hours = F.pmod((F.lit(math.pi / 2) - angle) / (2 * math.pi) * 12, F.lit(12.0))
    hour = F.floor(hours).cast("int")
    return F.format_string(
        "%d:%02d o'clock",
        F.when(hour == 0, 12).otherwise(hour),
        F.floor((hours - F.floor(hours)) * 60).cast("int"),
    )


def marker_box(b: Column, angle: Column) -> Column:
    """A small box at an angle on the ellipse inside a section's box."""
    whole = box_or_fallback(F.lit("default"), b)
    w, h = F.greatest(whole["w"] * 0.12, F.lit(3.0)), F.greatest(whole["h"] * 0.12, F.lit(3.0))
    cx = whole["x"] + whole["w"] / 2 + 0.40 * (whole["w"] / 2) * F.cos(angle)
    cy = whole["y"] + whole["h"] / 2 - 0.40 * (whole["h"] / 2) * F.sin(angle)
    return F.when(b.isNull() | angle.isNull(), whole).otherwise(
        box(cx - w / 2, cy - h / 2, w, h)
    )


def sheet_extent(header: Column, cloud: Column) -> Column:
    """Header extents if ordered and finite, else the text cloud with 2 % padding.

    Both are struct(xmin, ymin, xmax, ymax); the last resort is a fixed sheet.
    """
    names = ("xmin", "ymin", "xmax", "ymax")
    sane = (header["xmin"] < header["xmax"]) & (header["ymin"] < header["ymax"])
    for n in names:
        sane = sane & (F.abs(header[n]) < 1e15)

    def pad(lo, hi):
        p = (hi - lo) * 0.02
        return F.when(p == 0, F.lit(10.0)).otherwise(p)

    px, py = pad(cloud["xmin"], cloud["xmax"]), pad(cloud["ymin"], cloud["ymax"])
    padded = F.struct(
        (cloud["xmin"] - px).alias("xmin"),
        (cloud["ymin"] - py).alias("ymin"),
        (cloud["xmax"] + px).alias("xmax"),
        (cloud["ymax"] + py).alias("ymax"),
    )
    fixed = F.struct(*[F.lit(v).alias(n) for n, v in zip(names, (0.0, 0.0, 1000.0, 700.0))])
    return (
        F.when(F.coalesce(sane, F.lit(False)), F.struct(*[header[n].alias(n) for n in names]))
        .when(cloud["xmin"].isNotNull(), padded)
        .otherwise(fixed)
    )


def date_text(c: Column) -> Column:
    """A date in one of three formats as dd/mm/yyyy; other text passes trimmed."""
    t = strip(c)
    forms = ("d/M/yyyy", "yyyy-M-d", "d-M-yyyy")
    parsed = F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in forms])
    shown = F.coalesce(F.date_format(parsed, "dd/MM/yyyy"), t)
    return F.when(~t.isin("", "-"), shown)
