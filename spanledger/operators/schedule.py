"""Rows, columns and zones of a schedule rebuilt from placed text."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanledger.functions import numbers as N
from spanledger.functions.text import bar_mark_token, is_bar_mark, strip
from spanledger.operators.labels import component_of_mark, section_header
from spanledger.plans.durable import durable
from spanledger.plans.fold import CHUNK_ROWS, fold
from spanledger.plans.scan import Neighbour, Running, numbered, ordered_scan

# Words of each column head.
COLUMN_WORDS = {
    "bar_mark": ["BAR MARK", "BAR\nMARK", "MARK", "MK.", "MK"],
    "reinforcement": ["REINFORCEMENT", "REINF.", "REINF", "TYPE OF REINF"],
    "bar_dia_mm": ["DIA", "Ø", "φ", "PHI", "DIAMETER"],
    "spacing_mm": ["SPACING", "C/C", "PITCH", "SPC"],
    "count": ["NOS", "NO.", "NUMBER", "COUNT", "NOS."],
    "length_m": ["LENGTH OF BAR", "LENGTH OF", "BAR LENGTH", "LENGTH (M)", "LENGTH(M)", "LENGTH"],
    "total_length_m": ["TOTAL LENGTH", "TOTAL LEN", "TOT. LEN"],
    "unit_wt_kg_m": ["UNIT WT", "UNIT WEIGHT", "WT./M", "KG/M", "UNIT W", "WEIGHT/R", "R. MT.", "WEIGHT/"],
    "total_wt_kg": ["TOTAL WT", "TOTAL WEIGHT", "TOTAL WGT", "TOT. WT"],
}

# Share of the column span within which a cell belongs to a column,
# shift that tells a second table, share of the sheet height that is one row, and
# that of the header band.
COLUMN_REACH = 0.20
TABLE_SHIFT = 1000.0
ROW_TOL = 0.004
HEADER_BAND = 0.012


# Rows -------------------------------------------------------------------------


def anchor_groups(items: DataFrame, keys: list[str], value: str, tie: str, tol: str, strict: bool = False) -> DataFrame:
    """Group sorted values around anchors.

    A value starts a new group when it is more than ``tol`` (a column, one value per
    key) above the first value of the current group; with ``strict``, when it is
    that far or more. Adds ``anchor`` (the group's first value) and ``anchor_tie``.
    """

    def step(cols, state):
        v, t, reach = cols[value].astype("float64"), cols[tie], float(cols[tol][0])
        anchor, name = json.loads(state) if state else (None, None)
        anchors, names = np.empty(len(v)), np.empty(len(v), dtype=t.dtype)
        i = 0
        while i < len(v):
            gap = v[i] - anchor if anchor is not None else None
            if gap is None or (gap >= reach if strict else gap > reach):
                anchor, name = float(v[i]), t[i].item()
            # The group ends at the first value too far from its anchor.
            far = v[i:] - anchor >= reach if strict else v[i:] - anchor > reach
            far[0] = False
            n = int(np.argmax(far)) if far.any() else len(far)
            anchors[i : i + n], names[i : i + n] = anchor, name
            i += n
        return {tie: t, "anchor": anchors, "anchor_tie": names}, json.dumps([anchor, name])

    kind = items.schema[tie].dataType.simpleString()
    rows = items.filter(" AND ".join(f"`{k}` IS NOT NULL" for k in [*keys, tie]))
    # Counted without value and tie, which may be costly to make.
    large = items.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > CHUNK_ROWS).select(*keys)
    if large.isEmpty():
        return _anchored(rows, keys, value, tie, tol, strict)
    large = durable(large)
    hot = rows.join(large, keys, "left_semi")
    groups = fold(hot.select(*keys, value, tie, tol), keys, [value, tie], step, f"{tie} {kind}, anchor double, anchor_tie {kind}")
    cold = _anchored(rows.join(large, keys, "left_anti").select(*items.columns), keys, value, tie, tol, strict)
    return cold.unionByName(hot.join(groups, [*keys, tie]))


def anchor_places(starts: np.ndarray, v: np.ndarray, reach: np.ndarray, strict: bool, first: float | None) -> np.ndarray:
    """The place of each value's anchor, for many keys at once; -1 stands for ``first``, the anchor the first key comes with.

    A key's values begin at its place in ``starts`` and ascend. All keys take their k-th
    value together, so that the steps follow the longest key and the work the values.
    """
    sizes = np.diff(np.append(starts, len(v)))
    by_size = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[by_size], sizes[by_size]
    place, places = np.full(len(starts), -1), np.empty(len(v), np.int64)
    anchor = np.full(len(starts), np.nan)
    if first is not None:
        anchor[by_size == 0] = first
    for k in range(int(sizes[0]) if len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -k))  # keys with more than k values
        at = starts[:n] + k
        gap = v[at] - anchor[:n]
        new = np.isnan(anchor[:n]) | (gap >= reach[at] if strict else gap > reach[at])
        place[:n][new] = at[new]
        anchor[:n][new] = v[at[new]]
        places[at] = place[:n]
    return places


def _anchored(items: DataFrame, keys: list[str], value: str, tie: str, tol: str, strict: bool) -> DataFrame:
    """``anchor_groups`` of keys that one task holds: rows pass by in order and take their anchor along."""
    kinds = {f.name: f.dataType.simpleString() for f in items.schema.fields}

    def work(batches):
        last = held = held_tie = None  # the key the batch before ended with, its anchor and the anchor's tie
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, bool)
            for k in keys:
                new[1:] |= pc.not_equal(batch[k][1:], batch[k][:-1]).to_numpy(zero_copy_only=False)
            key = [batch[k][0].as_py() for k in keys]
            new[0] = True
            starts = np.flatnonzero(new)
            # A missing value is before every other.
            v = batch[value].cast(pa.float64()).to_numpy(zero_copy_only=False)
            v = np.where(np.isnan(v), -np.inf, v)
            reach = batch[tol].cast(pa.float64()).to_numpy(zero_copy_only=False)
            goes_on = key == last
            if goes_on:
                first = -np.inf if held[0].as_py() is None else held[0].as_py()
            with np.errstate(invalid="ignore"):
                places = anchor_places(starts, v, reach, strict, first if goes_on else None)
            anchors, ties = batch[value].cast(pa.float64()), batch[tie]
            if goes_on:
                # The anchor from the batch before stands behind the batch's own.
                anchors = pa.concat_arrays([anchors, held])
                ties = pa.concat_arrays([ties, held_tie])
                places = np.where(places < 0, batch.num_rows, places)
            at = pa.array(places)
            anchors, ties = anchors.take(at), ties.take(at)
            last, held, held_tie = [batch[k][batch.num_rows - 1].as_py() for k in keys], anchors[-1:], ties[-1:]
            yield pa.RecordBatch.from_arrays([*batch.columns, anchors, ties], names=[*batch.schema.names, "anchor", "anchor_tie"])

    schema = ", ".join(f"`{n}` {k}" for n, k in kinds.items())
    ready = items.repartition(*keys).sortWithinPartitions(*keys, value, tie)
    return ready.mapInArrow(work, f"{schema}, anchor double, anchor_tie {kinds[tie]}")


def text_rows(texts: DataFrame, sheets: DataFrame, key: str, tol_frac: float = ROW_TOL) -> DataFrame:
    """Texts with their row number, the topmost row being 1, and the row's height ``row_y``."""
    tol = F.when(F.col("ymax") - F.col("ymin") == 0, 1.0).otherwise(F.col("ymax") - F.col("ymin")) * tol_frac
    placed = texts.join(sheets.select(key, tol.alias("__tol")), key).withColumn("__v", -F.col("y"))
    grouped = anchor_groups(placed, [key], "__v", "ord", "__tol")
    rows = grouped.select(key, "anchor", "anchor_tie").distinct()
    no = numbered(rows, [key], ["anchor", "anchor_tie"], "row")
    return grouped.join(no, [key, "anchor", "anchor_tie"]).withColumn("row_y", -F.col("anchor")).drop("anchor", "anchor_tie", "__v", "__tol")


def row_texts(cells: DataFrame, keys: list[str], row: str = "row") -> DataFrame:
    """The text of each row, its cells from left to right."""
    return cells.groupBy(*keys, row).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "ord", "text"))), lambda s: s["text"]), " ").alias("row_text")
    )


def bucket_rows(words: DataFrame, keys: list[str], top: str, x: str, text: str, order: str, k: int) -> DataFrame:
    """Words as lines by height rounded to multiples of ``k``, from left to right."""
    line = F.bround(F.col(top) / k).cast("long") * k
    return words.withColumn("line", line).groupBy(*keys, "line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(x, order, F.col(text).alias("__w")))), lambda s: s["__w"]), " ").alias("text"),
        F.count(F.lit(1)).alias("words"),
    )


def first_row(rows: DataFrame, keys: list[str], row: str, match: Column, name: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min(F.when(match, F.col(row))).alias(name))


def truncate_at_first(rows: DataFrame, keys: list[str], row: str, match: Column) -> DataFrame:
    """Drop each key's rows from the first match on."""
    end = first_row(rows, keys, row, match, "__end")
    return rows.join(end, keys).filter(F.col("__end").isNull() | (F.col(row) < F.col("__end"))).drop("__end")


def is_header(row_text: Column) -> Column:
    """A row with at least two of the words DIA, NOS and LENGTH."""
    u = F.upper(row_text)
    return sum(F.when(u.contains(w), 1).otherwise(0) for w in ("DIA", "NOS", "LENGTH")) >= 2


def header_row(near: DataFrame, whole: DataFrame, keys: list[str], row: str) -> DataFrame:
    """The header found in the schedule part of a sheet, else on the whole sheet."""
    a = first_row(near, keys, row, is_header(F.col("row_text")), "near_row")
    b = first_row(whole, keys, row, is_header(F.col("row_text")), "whole_row")
    return a.join(b, keys, "full").select(*keys, F.coalesce("near_row", "whole_row").alias("header_row"), F.col("near_row").isNull().alias("from_whole"))


# Ranges -----------------------------------------------------------------------


def mark_ranges(marks: DataFrame, keys: list[str], row: str, tie: str, last: str) -> DataFrame:
    """The rows of each mark: from after the middle towards the previous mark to the middle towards the next.

    ``last`` is the number of rows of the key; rows count from 0 and ``row_end`` is
    exclusive.
    """
    near = ordered_scan(marks, keys, [row, tie], {"__p": Neighbour(row, -1), "__n": Neighbour(row, 1)})
    c = F.col
    start = F.when(c("__p").isNull(), F.lit(0)).otherwise(F.floor((c("__p") + c(row)) / 2) + 1)
    end = F.when(c("__n").isNull(), c(last)).otherwise(F.floor((c(row) + c("__n")) / 2) + 1)
    return near.withColumns({"row_start": start.cast("bigint"), "row_end": end.cast("bigint")}).drop("__p", "__n")


def zone_ranges(anchors: DataFrame, ranges: DataFrame, keys: list[str], row: str) -> DataFrame:
    """Zones of each mark: its rows cut between its total-length cells; one zone without or with one.

    ``ranges`` has row_start and row_end per key of a mark.
    """
    c = F.col
    inside = ranges.join(anchors.select(*keys, row).distinct(), keys, "left").filter(
        c(row).isNull() | ((c(row) >= c("row_start")) & (c(row) < c("row_end")))
    )
    near = ordered_scan(inside, keys, [row], {"__p": Neighbour(row, -1), "__n": Neighbour(row, 1), "zone_ord": Running("count")})
    # Middles count from the mark's own first row.
    mid = lambda a, b: c("row_start") + F.floor((a + b - 2 * c("row_start")) / 2) + 1
    start = F.when(c("__p").isNull(), c("row_start")).otherwise(mid(c("__p"), c(row)))
    end = F.when(c("__n").isNull(), c("row_end")).otherwise(mid(c(row), c("__n")))
    cut = near.select(*ranges.columns, "zone_ord", start.cast("bigint").alias("zone_start"), end.cast("bigint").alias("zone_end"))
    bare = ranges.join(cut.select(*keys).distinct(), keys, "left_anti").select(
        *ranges.columns, F.lit(1).cast("bigint").alias("zone_ord"), c("row_start").cast("bigint").alias("zone_start"), c("row_end").cast("bigint").alias("zone_end")
    )
    return cut.unionByName(bare)


def table_windows(labels: DataFrame, keys: list[str], x: str, tie: str, xmin: str, xmax: str) -> DataFrame:
    """The x-window of each table label, cut in the middle between neighbours."""
    near = ordered_scan(labels, keys, [x, tie], {"__p": Neighbour(x, -1), "__n": Neighbour(x, 1)})
    c = F.col
    return near.withColumns(
        {
            "left": F.coalesce((c("__p") + c(x)) / 2, c(xmin)),
            "right": F.coalesce((c(x) + c("__n")) / 2, c(xmax)),
        }
    ).drop("__p", "__n")


#: How the first data row of a table begins.
DATA_ROW = r"(?i)^\(?(LP|RP)\d+\b"


def table_header_cells(cells: DataFrame, windows: DataFrame, keys: list[str], tid: str) -> DataFrame:
    """The cells of each table between its label and its first data row, with the table's ``tid``.

    ``cells``: keys, ord, x, row, row_y, text, rows counted from the top; ``windows``: keys,
    tid, y (of the label), left, right, as ``table_windows`` cuts them. A cell finds its
    window by one pass over both in order of x. A data row is one whose first cell that
    is not blank begins like one; a table without such a row has header cells to the end.
    """
    c = F.col
    table = F.struct(c(tid).alias("tid"), c("y").alias("y"), c("right").alias("right"))
    kind = cells.schema["ord"].dataType
    starts = windows.select(*keys, c("left").alias("__x"), F.lit(0).alias("__no"), F.lit(None).cast(kind).alias("ord"), table.alias("__w"))
    own = cells.withColumns({"__x": c("x"), "__no": F.lit(1)})
    line = own.unionByName(starts.withColumn("__tie", F.col("__w.tid")), allowMissingColumns=True)
    placed = ordered_scan(line, keys, ["__x", "__no", "__tie", "ord"], {"__in": Running("last", "__w")}).filter("__no = 1")
    inside = placed.filter((c("x") < c("__in.right")) & (c("row_y") < c("__in.y") - 1e-6)).select(*cells.columns, c("__in.tid").alias(tid))
    said = inside.filter(F.trim("text") != "").groupBy(*keys, tid, "row").agg(F.min_by(F.trim("text"), F.struct("x", "ord")).alias("__said"))
    end = said.filter(c("__said").rlike(DATA_ROW)).groupBy(*keys, tid).agg(F.min("row").alias("__end"))
    return inside.join(end, [*keys, tid], "left").filter(c("__end").isNull() | (c("row") < c("__end"))).drop("__end")


def section_bands(headers: DataFrame, keys: list[str], name: str, top: str, height: str) -> DataFrame:
    """The band of each component: from its topmost header to the next one, or to 82 % of the page."""
    c = F.col
    first = headers.filter(c(top) < c(height) * 0.80).groupBy(*keys, name).agg(F.min(top).alias("y_start"), F.max(height).alias("__h"))
    near = ordered_scan(first, keys, ["y_start", name], {"__n": Neighbour("y_start", 1)})
    return near.withColumn("y_end", F.coalesce("__n", c("__h") * 0.82)).drop("__n", "__h")


# Columns ----------------------------------------------------------------------


def header_columns(cells: DataFrame, key: str) -> DataFrame:
    """Field and x of each column head.

    Header cells are grouped into bands by x (2 % of the span, at least 50); a field
    takes the leftmost band whose text holds one of its words, or all words of a
    phrase.
    """
    span = cells.groupBy(key).agg(F.greatest((F.max("x") - F.min("x")) * 0.02, F.lit(50.0)).alias("__tol"))
    bands = anchor_groups(cells.join(span, key), [key], "x", "ord", "__tol", strict=True)
    text = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("x", "ord", F.upper(strip(F.col("text"))).alias("t")))), lambda s: s["t"]), " "
    )
    heads = bands.groupBy(key, "anchor", "anchor_tie").agg(text.alias("head"))
    found = []
    for no, (field, words) in enumerate(COLUMN_WORDS.items()):
        hit = F.lit(False)
        for w in words:
            parts = w.upper().split()
            together = F.lit(True)
            for p in parts:
                together = together & F.col("head").contains(p)
            hit = hit | F.col("head").contains(w.upper()) | (together if len(parts) > 1 else F.lit(False))
        found.append(F.when(hit, F.struct(F.lit(field).alias("field"), F.lit(no).alias("col_ord"))))
    fields = heads.select(key, "anchor", F.inline(F.array_compact(F.array(*found))))
    return fields.groupBy(key, "field", "col_ord").agg(F.min("anchor").alias("col_x"))


def assign_columns(cells: DataFrame, columns: DataFrame, key: str, shift: Column | None = None) -> DataFrame:
    """Each cell with the nearest column within 20 % of the column span; ties go to the first column.

    A sheet's columns (at most one per field) travel as one array, so a cell stays
    one row. ``shift`` is added to the columns' positions for a second table.
    """
    cols = columns.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("col_ord", "field", "col_x"))).alias("__cols"),
        F.when(F.count(F.lit(1)) > 1, F.max("col_x") - F.min("col_x")).otherwise(100.0).alias("__span"),
    )
    moved = shift if shift is not None else F.lit(0.0)
    j = cells.join(cols, key).withColumn("__shift", F.when(F.abs(moved) > TABLE_SHIFT, moved).otherwise(0.0))
    best = F.array_min(
        F.transform(
            "__cols",
            lambda k: F.struct(F.abs(k["col_x"] + F.col("__shift") - F.col("x")).alias("d"), k["col_ord"].alias("o"), k["field"].alias("field")),
        )
    )
    return (
        j.withColumn("__b", best)
        .filter(F.col("__b.d") < F.col("__span") * COLUMN_REACH)
        .withColumn("field", F.col("__b.field"))
        .drop("__b", "__cols", "__span", "__shift")
    )


# Zones ------------------------------------------------------------------------


def zone_count(text: Column, length: Column, total_length: Column) -> tuple[list[Column], Column]:
    """Aggregates and the count of a zone built from its count cells.

    Cells ``=n`` win over products, products over plain numbers. Products that do
    not fit the total length, where the plain sum does, are an annotation.
    """
    t = strip(text)
    equal, product = t.startswith("="), t.rlike("[×xX*]") & ~t.contains("=")
    eq = F.sum(F.when(equal, N.safe_float(F.substring(t, F.lit(2), F.length(t))).cast("long"))).alias("__eq")
    mul = F.sum(F.when(product, N.parse_count(t))).alias("__mul")
    bare = F.sum(F.when(~equal & ~product, N.parse_count(t))).alias("__bare")
    c = F.col
    off = lambda n: F.abs(n * length - total_length) > total_length * 0.05
    swap = c("__bare").isNotNull() & N.present(length) & N.present(total_length) & off(c("__mul")) & ~off(c("__bare"))
    value = F.when(c("__eq").isNotNull(), c("__eq")).when(c("__mul").isNotNull(), F.when(swap, c("__bare")).otherwise(c("__mul"))).otherwise(c("__bare"))
    return [eq, mul, bare], value


def zone_values(cells: DataFrame, keys: list[str]) -> DataFrame:
    """One row per zone from its assigned cells (field, text, row, x, ord).

    Diameter, spacing, length, unit weight and text are the first that can be read;
    total length and weight are sums. A zone without diameter, length and count is
    no bar.
    """
    c = F.col
    at = F.struct("row", "x", "ord")

    def first(field: str, value: Column) -> Column:
        return F.min_by(value, F.when((c("field") == field) & value.isNotNull(), at))

    def total(field: str) -> Column:
        return F.sum(F.when(c("field") == field, N.safe_float(c("text"))))

    text = F.when(strip(c("text")) != "", c("text"))
    count_cell = F.when(c("field") == "count", c("text"))
    parts, count = zone_count(count_cell, c("length_m"), c("total_length_m"))
    g = cells.groupBy(*keys).agg(
        first("reinforcement", text).alias("reinforcement_text"),
        first("bar_dia_mm", N.parse_dia(c("text"))).alias("bar_dia_mm"),
        first("spacing_mm", N.parse_spacing(c("text"))).alias("spacing_mm"),
        first("length_m", N.safe_float(c("text"))).alias("length_m"),
        first("unit_wt_kg_m", N.safe_float(c("text"))).alias("unit_wt_kg_m"),
        total("total_length_m").alias("total_length_m"),
        total("total_wt_kg").alias("total_wt_kg"),
        *parts,
    )
    return g.withColumn("count", count).drop("__eq", "__mul", "__bare").filter(
        "bar_dia_mm IS NOT NULL OR length_m IS NOT NULL OR count IS NOT NULL"
    )


def shape_dims(cells: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """Numbers of at least 50 between two columns, one per place and value, ascending.

    The dimensions of one printed row group are a handful, so they become one array.
    """
    v = N.safe_float(F.col("text"))
    inside = cells.withColumn("__v", v).filter((F.col("x") > F.col(left)) & (F.col("x") < F.col(right)) & (F.col("__v") >= 50))
    once = inside.groupBy(*keys, F.bround("x").alias("__x"), F.bround("__v").alias("__r")).agg(F.min_by("__v", F.struct("row", "x", "ord")).alias("__v"))
    return once.groupBy(*keys).agg(F.array_sort(F.collect_list("__v")).alias("shape_dimensions"))


def merge_duplicate_marks(rows: DataFrame, keys: list[str], order: str, sums: list[str], carry: list[str]) -> DataFrame:
    """Keep the first row of each mark; sums add up where the first row has a number."""
    c = F.col
    num = {s: c(s).try_cast("double") for s in sums}
    g = rows.groupBy(*keys).agg(
        *[F.min_by(x, order).alias(x) for x in carry],
        *[F.min_by(num[s], order).alias(f"__f_{s}") for s in sums],
        *[F.sum(num[s]).alias(f"__s_{s}") for s in sums],
    )
    return g.select(*keys, *carry, *[F.when(c(f"__f_{s}").isNotNull(), c(f"__s_{s}")).alias(s) for s in sums])


def read_schedule(texts: DataFrame, sheets: DataFrame) -> DataFrame:
    """Schedule rows (drawing_bars) of all sheets from their placed texts.

    ``texts``: drawing_id, text, x, y, from_block, ord; ``sheets``: drawing_id, xmin,
    ymin, xmax, ymax.
    """
    c, key = F.col, "drawing_id"
    own = texts.filter(~c("from_block")).select(key, "text", "x", "y", "ord")
    frame = sheets.select(key, "xmin", "xmax", (c("ymax") - c("ymin")).alias("dh"))
    # Each stage feeds several later ones, so it is written once.
    cells = durable(text_rows(own, sheets, key))
    lines = row_texts(cells, [key])
    near = row_texts(cells.join(frame, key).filter(c("x") >= c("xmin") + 0.30 * (c("xmax") - c("xmin"))), [key])
    head = header_row(near, lines, [key], "row").filter("header_row IS NOT NULL")
    head_y = cells.join(head, key).filter("row = header_row").groupBy(key, "header_row").agg(F.max("row_y").alias("head_y"))
    band = cells.join(head_y, key).join(frame.select(key, "dh"), key).filter(F.abs(c("row_y") - c("head_y")) < c("dh") * HEADER_BAND)
    columns = durable(header_columns(band.select(key, "text", "x", "ord"), key))
    mark_x = columns.filter("field = 'bar_mark'").select(key, c("col_x").alias("mark_x"))
    reinf_x = columns.filter("field = 'reinforcement'").select(key, c("col_x").alias("reinf_x"))
    span = columns.groupBy(key).agg(F.when(F.count(F.lit(1)) > 1, F.max("col_x") - F.min("col_x")).otherwise(100.0).alias("span"))

    data = lines.join(head, key).filter("row > header_row").withColumn("r", c("row") - c("header_row") - 1)
    data = truncate_at_first(data, [key], "r", c("row_text").rlike(r"(?i)\bTABLE-1\b|\bTABLE\s+1\b|\bNOTES\s*:"))
    sizes = data.groupBy(key).agg((F.max("r") + 1).alias("n_rows"))
    data = durable(data.withColumn("header", section_header(c("row_text"))))
    carried = ordered_scan(data, [key], ["r"], {"comp": Running("last", "header")})
    headed = data.filter("header IS NOT NULL").select(key).distinct().withColumn("headed", F.lit(True))

    body = cells.join(data.select(key, "row", "r", "header"), [key, "row"]).select(key, "text", "x", "y", "ord", "r", "header")
    token = bar_mark_token(c("text"))
    candidates = (
        body.filter(c("header").isNull() & is_bar_mark(c("text"))).join(span, key).join(mark_x, key, "left")
        .filter(c("mark_x").isNull() | (F.abs(c("x") - c("mark_x")) < c("span") * COLUMN_REACH))
    )
    marks = candidates.groupBy(key, "r").agg(F.min_by(F.struct(token.alias("bar_mark"), c("x").alias("bx"), c("mark_x")), F.struct("x", "ord")).alias("m")).select(key, "r", "m.*")
    ranges = mark_ranges(marks.join(sizes, key), [key], "r", "bar_mark", "n_rows")
    comp = F.when(c("headed"), c("comp")).otherwise(component_of_mark(c("bar_mark")))
    ranges = ranges.join(carried.select(key, "r", "comp"), [key, "r"]).join(headed, key, "left").withColumn("component", comp)
    ranges = ranges.filter("component IS NOT NULL").withColumn("shift", F.coalesce(c("bx") - c("mark_x"), F.lit(0.0)))
    # A mark seen again belongs to a second block and does not count twice.
    firsts = ranges.groupBy(key, "component", "bar_mark").agg(F.min("r").alias("r"))
    ranges = ranges.join(firsts, [key, "component", "bar_mark", "r"], "left_semi").select(key, "component", "bar_mark", c("r").alias("mark_row"), "row_start", "row_end", "shift")
    ranges = durable(ranges)

    # A row lies in one mark's range only: the mark is carried down from its first row.
    rows = data.select(key, "r")
    starts = ranges.select(key, c("row_start").alias("r"), F.struct("component", "bar_mark", "mark_row", "row_end", "shift").alias("m"))
    owner = ordered_scan(rows.join(starts, [key, "r"], "left"), [key], ["r"], {"own": Running("last", "m")}).filter("own IS NOT NULL AND r < own.row_end")
    mine = body.join(owner.select(key, "r", "own.component", "own.bar_mark", "own.mark_row", "own.shift"), [key, "r"])
    mine = durable(mine)
    placed = assign_columns(mine, columns, key, c("shift"))
    anchors = placed.filter((c("field") == "total_length_m") & N.safe_float(c("text")).isNotNull())
    zones = durable(zone_ranges(anchors, ranges, [key, "component", "bar_mark"], "r"))
    bar = [key, "component", "bar_mark"]
    zoned = lambda df: df.join(zones.select(*bar, "zone_ord", "zone_start", "zone_end"), bar).filter((c("r") >= c("zone_start")) & (c("r") < c("zone_end")))
    zone = [*bar, "mark_row", "zone_ord"]
    values = zone_values(zoned(placed).withColumn("row", c("r")), zone)
    between = zoned(mine).join(mark_x, key).join(reinf_x, key).withColumns({"row": c("r"), "__l": c("mark_x") + F.when(F.abs("shift") > TABLE_SHIFT, c("shift")).otherwise(0.0), "__r2": c("reinf_x") + F.when(F.abs("shift") > TABLE_SHIFT, c("shift")).otherwise(0.0)})
    dims = shape_dims(between, zone, "__l", "__r2")
    ext = zoned(mine).groupBy(*zone).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    out = values.join(dims, zone, "left").join(ext, zone, "left").join(sheets, key)
    from spanledger.functions.geo import to_box

    pad, side = (c("ymax") - c("ymin")) * ROW_TOL, (c("xmax") - c("xmin")) * 0.0
    box = to_box(c("x0") - side, c("y0") - pad, c("x1") + side, c("y1") + pad, F.struct("xmin", "ymin", "xmax", "ymax"))
    kept = numbered(out.withColumn("row_bbox", box), bar, ["zone_ord"], "zone_no").drop("zone_ord").withColumnRenamed("zone_no", "zone_ord")
    return kept.select(*bar, c("mark_row").alias("mark_ord"), "zone_ord", "reinforcement_text", "bar_dia_mm", "spacing_mm", c("count").cast("int").alias("count"),
                       "length_m", "total_length_m", "unit_wt_kg_m", "total_wt_kg", "shape_dimensions", "row_bbox")


# Design workbook ----------------------------------------------------------------

# Labels of design cells (any of the words), the key they give, how far
# to the right the value is, and the text cell that has to stand before it, if any.
GEOMETRY_LABELS = [
    (["Length of Pilecap (along traffic)"], "pilecap_length_along", 1, None),
    (["Length of Pilecap (along traffic)"], "pilecap_a1", 3, "a1="),
    (["Length of Pilecap (across traffic)"], "pilecap_length_across", 1, None),
    (["Length of Pilecap (across traffic)"], "pilecap_b1", 3, "b1="),
    (["Depth of Pilecap"], "pilecap_depth", 1, None),
    (["Foundation Cover", "Foundation cover"], "pilecap_cover", 1, None),
    (["Pile Dia="], "pile_dia", 1, None),
    (["Pile Spacing", "Pile c/c", "Pile C/C"], "pile_spacing", 1, None),
    (["Pile Overhang", "Overhang"], "pile_overhang", 1, None),
    (["No. of Piles="], "pile_count", 1, None),
    (["Pile length="], "pile_length", 1, None),
    (["Pile length="], "pile_fixity", 3, "Pile Fix. length="),
    (["Ht. of Pier="], "pier_height", 1, None),
    (["Pier Dimsion", "Pier Dimension"], "pier_length", 1, None),
    (["Pier Dimsion", "Pier Dimension"], "pier_width", 2, None),
    (["Pier Cover"], "pier_cover", 1, None),
]

# Column numbers of a design schedule.
DESIGN_COLUMNS = {"bar_mark": 0, "label": 2, "remarks": 4, "length_m": 7, "dia_mm": 8, "spacing_mm": 9, "count": 10, "total_len_m": 11, "unit_wt": 12, "total_wt_kg": 13}


def parse_geometry(cells: DataFrame, key: str = "drawing_id") -> DataFrame:
    """Design geometry (key, value, text) from workbook cells (row, col, value).

    A label's value stands in one of the next columns; the last label of a kind
    counts. Spacing and overhang fall back to the distances given beside the pilecap.
    """
    c = F.col
    wanted = [
        F.when(
            F.lit(False) if not words else c("value").rlike("|".join(w.replace("(", r"\(").replace(")", r"\)").replace(".", r"\.") for w in words)),
            F.struct(F.lit(name).alias("name"), F.lit(off).alias("off"), F.lit(before).cast("string").alias("before")),
        )
        for words, name, off, before in GEOMETRY_LABELS
    ]
    labels = cells.select(key, "row", "col", F.inline(F.array_compact(F.array(*wanted))))
    at = labels.select(key, "row", "name", "before", (c("col") + c("off")).alias("vcol"), F.struct("row", "col").alias("at"))
    val = cells.select(key, "row", c("col").alias("vcol"), c("value").alias("v"))
    mark = cells.select(key, "row", (c("col") + 1).alias("vcol"), c("value").alias("b"))
    j = at.join(val, [key, "row", "vcol"], "left").join(mark, [key, "row", "vcol"], "left")
    ok = j.filter(c("before").isNull() | (c("b") == c("before")))
    found = ok.groupBy(key, "name").agg(F.max_by(c("v").try_cast("double"), "at").alias("value"))
    wide = found.groupBy(key).pivot("name", sorted({n for _, n, _, _ in GEOMETRY_LABELS})).agg(F.first("value"))
    has = found.groupBy(key).agg(F.bool_or(c("name") == "pile_spacing").alias("hs"), F.bool_or(c("name") == "pile_overhang").alias("ho"))
    spacing = F.when(~c("hs"), F.coalesce(N.given(c("pilecap_a1")), N.given(c("pilecap_b1")))).otherwise(c("pile_spacing"))
    hang = F.when(
        ~c("ho"),
        F.when(N.present(c("pilecap_a1")) & N.present(c("pilecap_length_along")), (c("pilecap_length_along") - c("pilecap_a1")) / 2).when(
            N.present(c("pilecap_b1")) & N.present(c("pilecap_length_across")), (c("pilecap_length_across") - c("pilecap_b1")) / 2
        ),
    ).otherwise(c("pile_overhang"))
    full = wide.join(has, key).withColumns({"pile_spacing": spacing, "pile_overhang": hang}).drop("hs", "ho")
    long = full.unpivot([key], [x for x in full.columns if x != key], "key", "value").filter("value IS NOT NULL")
    shape = F.when(c("value").contains("Pier Shape=") & c("value").contains("Rectangle"), "Rectangle").when(c("value").contains("Pier Shape=") & c("value").contains("Circular"), "Circular")
    text = cells.withColumn("s", shape).filter("s IS NOT NULL").groupBy(key).agg(F.max_by("s", F.struct("row", "col")).alias("text"))
    return long.withColumn("text", F.lit(None).cast("string")).unionByName(
        text.select(key, F.lit("pier_shape").alias("key"), F.lit(None).cast("double").alias("value"), "text")
    )


def parse_bars(cells: DataFrame, key: str = "drawing_id") -> DataFrame:
    """Design bars from workbook cells (row, col, value, formula, font_nonblack).

    The section heading above a row names its component; bars without diameter or
    with count 0 are inactive. Pile counts are per pile unless their formula already
    names the pile-count cell. Of two pier sections the one of the pier's shape counts.
    """
    c = F.col
    pick = lambda col, what: F.max(F.when(c("col") == col, c(what)))
    d = DESIGN_COLUMNS
    shape_head = cells.filter(F.upper("value").contains("SHAPE OF")).groupBy(key).agg(F.min_by("col", F.struct("row", "col")).alias("shape_col"))
    dims = (
        cells.join(shape_head, key).filter((c("col") >= c("shape_col")) & (c("col") < d["remarks"]) & (c("col") != d["bar_mark"]))
        .withColumn("v", c("value").try_cast("double")).filter("v > 0")
        .groupBy(key, "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "v"))), lambda s: s["v"]).alias("shape_dims"))
    )
    rows = cells.groupBy(key, "row").agg(
        *[pick(i, "value").alias(n) for n, i in d.items()],
        pick(d["count"], "formula").alias("count_formula"),
        F.coalesce(pick(d["spacing_mm"], "font_nonblack"), F.lit(False)).alias("sp_colour"),
        F.coalesce(pick(d["count"], "font_nonblack"), F.lit(False)).alias("ct_colour"),
    )
    head = F.upper(strip(c("bar_mark")))
    part = (
        F.when(head == "PILECAP", "pilecap:").when(head.startswith("PILE ("), "pile:").when(head.contains("PIER (CIRCULAR)"), "pier:Circular")
        .when(head.rlike(r"PIER \((RECTANGULAR|CAPSULE)"), "pier:Rectangle")
    )
    stirrup = F.when(c("label").contains("Spacing b/w long"), c("length_m").try_cast("double"))
    scanned = ordered_scan(
        rows.withColumns({"__part": part, "__st": stirrup}), [key], ["row"],
        {"__sect": Running("last", "__part"), "__stirrup": Running("last", "__st")},
    )
    shape = (
        cells.filter(c("value").contains("Pier Shape=")).groupBy(key)
        .agg(F.max_by(F.when(c("value").rlike("Rectangle|Capsule"), "Rectangle").when(c("value").contains("Circular"), "Circular"), F.struct("row", "col")).alias("shape"))
    )
    piles_at = cells.filter(c("value").contains("No. of Piles=")).groupBy(key).agg(
        F.min_by(F.concat(F.char(c("col") + 66), (c("row") + 1).cast("string")), F.struct("row", "col")).alias("piles_cell"),
        F.max_by("row", F.struct("row", "col")).alias("prow"), F.max_by("col", F.struct("row", "col")).alias("pcol"),
    )
    count = cells.select(key, c("row").alias("prow"), (c("col") - 1).alias("pcol"), c("value").try_cast("int").alias("piles"))
    piles = piles_at.join(count, [key, "prow", "pcol"], "left").select(key, "piles_cell", "piles")
    mark = strip(c("bar_mark"))
    bars = (
        scanned.filter(c("__sect").isNotNull() & F.lower(mark).rlike(r"^[a-z]\d{0,2}$"))
        .join(piles, key, "left").join(shape, key, "left").join(dims, [key, "row"], "left")
        .withColumns({"n": c("count").try_cast("double").cast("int"), "dia": c("dia_mm").try_cast("double").cast("int"), "sp": N.design_spacing(c("spacing_mm"))})
        .filter("dia <> 0 AND (n IS NULL OR n <> 0)")
        .withColumn("sp", F.when(c("sp").isNull() & N.present(c("__stirrup")) & (mark == "e"), c("__stirrup")).otherwise(c("sp")))
        .withColumn("component", F.element_at(F.split("__sect", ":"), 1)).withColumn("pier", F.element_at(F.split("__sect", ":"), 2))
    )
    per_pile = (c("component") == "pile") & c("n").isNotNull() & (F.coalesce("piles", F.lit(1)) > 1) & ~F.coalesce(
        c("count_formula").startswith("=") & F.contains(F.upper("count_formula"), c("piles_cell")), F.lit(False)
    )
    times = F.when(per_pile, c("piles")).otherwise(1)
    rect = bars.filter("pier = 'Rectangle'").select(key).distinct().withColumn("has_rect", F.lit(True))
    use = F.coalesce("shape", F.when(c("has_rect"), "Rectangle").otherwise("Circular"))
    kept = bars.join(rect, key, "left").filter((c("component") != "pier") | (c("pier") == use))
    out = kept.select(
        key, "component", mark.alias("bar_mark"), "row",
        c("length_m").try_cast("double").alias("length_m"), c("dia").alias("dia_mm"), c("sp").alias("spacing_mm"),
        (c("n") * times).cast("int").alias("count"), (c("total_len_m").try_cast("double") * times).alias("total_len_m"),
        c("unit_wt").try_cast("double").alias("unit_wt"), (c("total_wt_kg").try_cast("double") * times).alias("total_wt_kg"),
        F.coalesce(strip(c("remarks")), F.lit("")).alias("remarks"), c("spacing_mm").alias("raw_spacing"),
        N.secondary_kind(c("sp"), c("n"), c("sp_colour"), c("ct_colour")).alias("reinf_secondary"), "shape_dims",
    )
    order = out.groupBy(key, "component", "bar_mark").agg(F.min("row").alias("mark_ord"))
    return numbered(out, [key, "component", "bar_mark"], ["row"], "zone_ord").join(order, [key, "component", "bar_mark"])
