"""Numbers read out of schedule text, and comparisons with tolerance."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanledger.functions.text import first_match, let, strip

PAIRS = T.ArrayType(T.StructType([T.StructField("design_mm", T.DoubleType()), T.StructField("drawing_mm", T.DoubleType())]))

# Bar diameters in millimetres accepted as bare numbers.
VALID_DIAMETERS = [8, 10, 12, 16, 20, 25, 32]

# Cell texts that mean no spacing and no count.
NO_SPACING = ["-", "N.A.", "NA", "", "None", "nil", "NIL"]
NO_COUNT = ["-", "N.A.", "NA", ""]


def present(c: Column) -> Column:
    """Neither NULL nor zero: what counts as given in a schedule."""
    return F.coalesce(c != 0, F.lit(False))


def given(c: Column) -> Column:
    """The value, NULL if zero."""
    return F.when(c != 0, c)


def pct_diff(design: Column, drawing: Column) -> Column:
    """Difference in percent of the design side; NULL if either is missing or zero."""
    return F.when(present(design) & present(drawing), F.abs(design - drawing) / design * 100)


def reinforcement(text: Column) -> Column:
    """Diameter, kind of secondary value and the value of texts like ``16φ@150 c/c``."""
    dia = first_match(text, r"(?iu)(\d+)\s*[φΦ]").try_cast("int")
    # The one number of the first match is what either of its forms gives.
    number = lambda pattern: F.regexp_substr(F.regexp_substr(text, F.lit(pattern)), F.lit(r"\d+(?:\.\d+)?")).try_cast("double")
    spacing = number(r"(?i)@\s*\d+(?:\.\d+)?|\d+(?:\.\d+)?\s*c/c")
    count = number(r"(?i)[*×]\s*\d+|[–-]\s*\d+\s*NOS|\d+\s*NOS")
    read = F.struct(dia.alias("dia"), spacing.alias("spacing"), count.alias("count"))

    def told(r: Column) -> Column:
        kind = F.when(r["spacing"].isNotNull(), "spacing").when(r["count"].isNotNull(), "count")
        return F.struct(r["dia"].alias("dia"), kind.alias("kind"), F.coalesce(r["spacing"], r["count"]).alias("value"))

    # Three fields of a row's text, which is searched once for all of them.
    return let(read, told)


def norm_dia(text: Column) -> Column:
    return first_match(text, r"(\d+)").try_cast("int")


def norm_count(text: Column) -> Column:
    """The number after ``=``, else the trailing number."""
    return F.coalesce(first_match(text, r"=\s*(\d+)"), first_match(text, r"(\d+)\s*$")).try_cast("int")


def safe_float(text: Column) -> Column:
    """A number with thousands commas."""
    return strip(F.replace(text, F.lit(","), F.lit(""))).try_cast("double")


def parse_dia(text: Column) -> Column:
    bare = first_match(strip(text), r"^(\d+)$").try_cast("int")
    return F.coalesce(
        first_match(text, r"(\d+)\s*[ØφΦø]").try_cast("int"),
        first_match(text, r"[Tt](\d+)").try_cast("int"),
        F.when(bare.isin(*VALID_DIAMETERS), bare),
    )


def parse_spacing(text: Column) -> Column:
    """The first number of a drawing's spacing cell, cut to an integer."""
    number = first_match(text, r"(\d+(?:\.\d+)?)").try_cast("double").cast("int")
    return F.when(~strip(text).isin(*NO_SPACING), number)


def design_spacing(text: Column) -> Column:
    """A positive number of a design spacing cell; products like ``10x20`` are none."""
    t = strip(text)
    value = t.try_cast("double")
    return F.when(~F.lower(t).contains("x") & ~t.isin("-", "", "None") & (value > 0), value)


def parse_count(text: Column) -> Column:
    """A count cell: what follows the last ``=``, or a number, or sums of products."""
    t = strip(text)
    t = F.when(t.contains("="), strip(F.element_at(F.split(t, "="), -1))).otherwise(t)
    plain = F.replace(t, F.lit(","), F.lit("")).try_cast("double").cast("long")
    expr = F.regexp_replace(F.regexp_replace(t, "[×xX]", "*"), r"[^\d*.+\-]", "")
    ok = expr.rlike(r"^-?\d+([*+\-]\d+)*$")
    terms = F.split(F.regexp_replace(expr, r"(?<=\d)-", "+-"), r"\+")
    product = lambda term: F.aggregate(
        F.transform(F.split(term, r"\*"), lambda n: n.try_cast("long")),
        F.lit(1).cast("long"),
        lambda a, n: a * n,
    )
    value = F.aggregate(terms, F.lit(0).cast("long"), lambda a, term: a + product(term))
    return F.when(
        ~strip(text).isin(*NO_COUNT) & (t != ""), F.coalesce(plain, F.when(ok, value))
    )


#: Array places that are compared at once, so that a few long arrays take no room of many short ones.
AT_ONCE = 1 << 20


def _segments(column: pa.Array, factor: float) -> tuple[np.ndarray, np.ndarray]:
    """The rows and values of arrays without nulls and zeros, ascending within a row."""
    column = column.cast(pa.list_(pa.float64()))
    values = column.flatten()
    rows = np.repeat(np.arange(len(column)), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
    known = values.is_valid().to_numpy(zero_copy_only=False)
    values = pc.fill_null(values, 0.0).to_numpy(zero_copy_only=False) * factor
    keep = known & (values != 0)
    rows, values = rows[keep], values[keep]
    order = np.lexsort((values, rows))
    return rows[order], values[order]


def _padded(rows: np.ndarray, values: np.ndarray, which: np.ndarray, sizes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of some rows side by side, and which places are filled."""
    places = np.arange(int(sizes[which].max(initial=0)))
    filled = places[None, :] < sizes[which][:, None]
    at = np.where(filled, starts[which][:, None] + places[None, :], 0)
    return (values[at] if len(values) else np.zeros(at.shape)), filled


def _without_leading_one(value: np.ndarray, filled: np.ndarray, design: np.ndarray, has: np.ndarray) -> np.ndarray:
    """The values, a leading 1 dropped where what remains is within 3 % of a design dimension."""
    whole = np.where(filled & (np.abs(value) < 1e18), np.rint(value), 0).astype(np.int64)
    tens = 10 ** np.arange(19, dtype=np.int64)
    top = tens[np.maximum(np.searchsorted(tens, whole, side="right") - 1, 0)]
    ones = (whole >= 10) & (whole < 2 * top)
    rest = (whole - top).astype(np.float64)
    with np.errstate(all="ignore"):
        for k in range(design.shape[1]):
            d = design[:, k : k + 1]
            near = ones & has[:, k : k + 1] & (d > 0) & (np.abs(rest - d) / d < 0.03)
            value, ones = np.where(near, rest, value), ones & ~near
    return value


def _matched(design_m: pa.Array, drawing_mm: pa.Array) -> pa.Array:
    n = len(design_m)
    sides = [_segments(design_m, 1000.0), _segments(drawing_mm, 1.0)]
    sizes = [np.bincount(rows, minlength=n) for rows, _ in sides]
    starts = [np.cumsum(s) - s for s in sizes]
    pairs = np.minimum(*sizes)
    ends = np.cumsum(pairs)
    out = np.zeros((2, int(pairs.sum())))
    # Rows by their lengths: those that are compared at once take about the same room.
    order = np.argsort(np.maximum(*sizes), kind="stable")
    order = order[pairs[order] > 0]
    while len(order):
        room = np.maximum(*sizes)[order]
        some = max(1, int(np.searchsorted(room * np.arange(1, len(order) + 1), AT_ONCE, side="right")))
        which, order = order[:some], order[some:]
        (d, has), (w, left) = (_padded(*side, which, size, start) for side, size, start in zip(sides, sizes, starts))
        w = _without_leading_one(w, left, d, has)
        for k in range(int(pairs[which].max())):
            on = np.flatnonzero(pairs[which] > k)
            best = np.where(left[on], np.abs(w[on] - d[on, k : k + 1]), np.inf).argmin(axis=1)
            left[on, best] = False
            at = ends[which[on]] - pairs[which[on]] + k
            out[0, at], out[1, at] = d[on, k], w[on, best]
    offsets = pa.array(np.concatenate([[0], ends]), pa.int32(), mask=np.concatenate([design_m.is_null().to_numpy(zero_copy_only=False), [False]]))
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(out[0]), pa.array(out[1])], ["design_mm", "drawing_mm"]))


def match_dims(design_m: Column, drawing_mm: Column) -> Column:
    """Each design segment, ascending, with the closest drawing segment left.

    Takes two arrays of one row, metres and millimetres; returns an array of
    (design_mm, drawing_mm), shorter than the design side when drawing segments run
    out. Of equally close ones the smaller is taken. All rows of a batch are matched
    together: Spark would interpret the nested lambdas for each row.
    """
    return F.arrow_udf(_matched, PAIRS)(design_m, drawing_mm)


def closest_pairs(design: Column, drawing: Column) -> Column:
    """Pair the zone rows of one bar mark, largest design count first.

    Both sides are arrays of struct(count, length, ord) held in one row, of equal
    size. A design row takes the remaining drawing row with the smallest count
    difference, or length difference where a count is missing; a row with nothing
    to compare takes the first. Returns an array of struct(design_ord, drawing_ord).
    """
    ordered = F.array_sort(
        F.transform(
            design,
            lambda d, i: F.struct(
                (-F.coalesce(d["count"], F.lit(0.0))).alias("k"), i.alias("i"), d.alias("d")
            ),
        )
    )
    indexed = F.transform(drawing, lambda w, i: F.struct(i.alias("i"), w.alias("w")))

    def score(d, w):
        return (
            F.when(present(d["count"]) & present(w["count"]), F.abs(d["count"] - w["count"]))
            .when(present(d["length"]) & present(w["length"]), F.abs(d["length"] - w["length"]))
            .otherwise(F.lit(float("inf")))
        )

    kind = "array<struct<design_ord:int,drawing_ord:int>>"
    start = F.struct(indexed.alias("rest"), F.array().cast(kind).alias("pairs"))

    def step(acc, x):
        nearest = F.array_min(
            F.transform(
                acc["rest"],
                lambda r: F.struct(
                    score(x["d"], r["w"]).alias("s"), r["i"].alias("i"), r["w"]["ord"].alias("o")
                ),
            )
        )

        def take(best):
            pair = F.struct(x["d"]["ord"].cast("int").alias("design_ord"), best["o"].cast("int").alias("drawing_ord"))
            return F.struct(
                F.filter(acc["rest"], lambda r: r["i"] != best["i"]).alias("rest"),
                F.concat(acc["pairs"], F.array(pair)).alias("pairs"),
            )

        return F.when(F.size(acc["rest"]) > 0, let(nearest, take)).otherwise(acc)

    return F.aggregate(ordered, start, step, lambda acc: acc["pairs"])


def secondary_kind(spacing: Column, count: Column, spacing_coloured: Column, count_coloured: Column) -> Column:
    """Which value the reinforcement text should show: the coloured one, else the given one."""
    sp = spacing_coloured & spacing.isNotNull()
    ct = count_coloured & count.isNotNull()
    return (
        F.when(sp & ~ct, "spacing")
        .when(ct & ~sp, "count")
        .when(spacing.isNotNull(), "spacing")
        .when(count.isNotNull(), "count")
    )


def upper_median(values: Column) -> Column:
    """The upper median of an array."""
    s = F.array_sort(values)
    return F.get(s, F.floor(F.size(s) / 2).cast("int"))
