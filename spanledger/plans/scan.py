"""Ordered scans (running totals, carry-forward, neighbours) over keys of any size.

A plain ``Window.partitionBy(key)`` puts a whole key into one task. Keys of
ordinary size are scanned that way. Keys with more rows than a task should hold
are found first by a count (combined before its shuffle) and cut into chunks along
the ordering column at equi-depth split points. Their window runs inside (key,
chunk); what a chunk needs from earlier chunks comes from a second window over one
summary row per (key, chunk). The result is the same either way.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanledger.plans.durable import durable
from spanledger.session import dealt

KEY, CHUNK = "__k", "__c"
HOT_ROWS = 1_000_000
#: Buckets whose rows are counted before those of keys.
BUCKETS = 1 << 14


@dataclass(frozen=True)
class Running:
    """``fn`` over all rows of the key up to and including the current one.

    ``fn`` is one of count, sum, min, max, last, first. ``count`` counts rows if
    ``value`` is None, else non-null values; ``last`` and ``first`` skip nulls.
    ``inclusive=False`` leaves the current row out.
    """

    fn: str
    value: Column | str | None = None
    inclusive: bool = True


@dataclass(frozen=True)
class Neighbour:
    """The value one row before (``step=-1``) or after (``step=1``) in the key."""

    value: Column | str
    step: int = -1


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_position(df: DataFrame, column: str) -> Column:
    """The ordering column as a DOUBLE that grows with it."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(F.col(column).cast("timestamp")).cast("double")
    return F.col(column).cast("double")


def chunk_count(rows: int, limit: int) -> int:
    """A power of two that leaves about half of ``limit`` rows to a chunk."""
    n = 8
    while n * limit < 2 * rows:
        n *= 2
    return n


def with_chunk(df: DataFrame, column: str, chunks: int, name: str = CHUNK) -> DataFrame:
    """Add the equi-depth chunk number of ``column`` (null values get -1)."""
    n = chunks
    position = as_position(df, column)
    shares = [i / n for i in range(1, n)]
    splits = df.select(
        F.percentile_approx(position, shares, max(1000, 8 * n))
    ).scalar()
    steps = []
    s = n // 2
    while s:
        steps.append(s)
        s //= 2
    split_col, pos_col = "__splits", "__pos"
    found = F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda acc, step: F.when(
            F.get(F.col(split_col), acc + step - 1) < F.col(pos_col), acc + step
        ).otherwise(acc),
    )
    return (
        df.withColumns({split_col: splits, pos_col: position})
        .withColumn(name, F.when(F.col(pos_col).isNull(), F.lit(-1)).otherwise(found))
        .drop(split_col, pos_col)
    )


def _total(spec: Running, order: Column) -> Column:
    if spec.fn == "count":
        return F.count(F.lit(1)) if spec.value is None else F.count(_col(spec.value))
    v = _col(spec.value)
    if spec.fn == "last":
        return F.max_by(v, F.when(v.isNotNull(), order))
    if spec.fn == "first":
        return F.min_by(v, F.when(v.isNotNull(), order))
    return {"sum": F.sum, "min": F.min, "max": F.max}[spec.fn](v)


def _windowed(spec: Running, w) -> Column:
    if spec.fn == "count":
        return (F.count(F.lit(1)) if spec.value is None else F.count(_col(spec.value))).over(w)
    v = _col(spec.value)
    if spec.fn == "last":
        return F.last(v, ignorenulls=True).over(w)
    if spec.fn == "first":
        return F.first(v, ignorenulls=True).over(w)
    return {"sum": F.sum, "min": F.min, "max": F.max}[spec.fn](v).over(w)


def _across(spec: Running, total: str, w) -> Column:
    """The same function over the chunk summaries before the current chunk."""
    if spec.fn == "count":
        return F.coalesce(F.sum(total).over(w), F.lit(0))
    if spec.fn in ("last", "first"):
        pick = F.last if spec.fn == "last" else F.first
        return pick(total, ignorenulls=True).over(w)
    return {"sum": F.sum, "min": F.min, "max": F.max}[spec.fn](total).over(w)


def _merge(spec: Running, before: Column, here: Column) -> Column:
    if spec.fn == "count":
        return before + here
    if spec.fn == "sum":
        return F.coalesce(before + here, before, here)
    if spec.fn == "min":
        return F.least(before, here)
    if spec.fn == "max":
        return F.greatest(before, here)
    if spec.fn == "last":
        return F.coalesce(here, before)
    return F.coalesce(before, here)


def hot_limit(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spanledger.hotKeyRows", str(HOT_ROWS)))


def hot_keys(df: DataFrame, key: str) -> tuple[DataFrame, int] | None:
    """The keys with more rows than one task should hold and all their rows, None if there are none.

    There can be no more of them than the table has such portions of rows.
    """
    limit = hot_limit(df)
    # Keys are counted by themselves only where a bucket of them holds as many rows.
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS))
    crowded = [r["__b"] for r in df.groupBy(bucket.alias("__b")).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > limit).collect()]
    if not crowded:
        return None
    found = df.filter(bucket.isin(crowded)).groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > limit)
    rows = found.agg(F.sum("__n")).first()[0]
    return None if rows is None else (durable(found.select(key)), int(rows))


def ordered_scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    outputs: dict[str, Running | Neighbour],
    descending: bool = False,
    chunks: int | None = None,
    deal: bool = False,
) -> DataFrame:
    """Add ``outputs`` to ``df``, each computed over the rows of ``keys`` in ``order``.

    The first ordering column must be a number, date or timestamp; the rest break
    ties, and together they should be unique within a key. Null keys form a key
    of their own. ``deal`` keeps ordinary keys in as many partitions as the session's
    shuffles have, for rows that take far more room than their compressed files say.
    """
    keyed = df.withColumn(KEY, F.struct(*keys) if keys else F.struct(F.lit(1).alias("one")))
    hot = hot_keys(keyed, KEY)
    parted = lambda rows: dealt(rows, *keys) if deal and keys else rows
    if hot is None:
        return _plain_scan(parted(df), keys, order, outputs, descending)
    hot, rows = hot
    chunks = chunks or chunk_count(rows, hot_limit(df))
    cold = _plain_scan(parted(keyed.join(hot, KEY, "left_anti").select(*df.columns)), keys, order, outputs, descending)
    cut = _chunked_scan(keyed.join(hot, KEY, "left_semi"), df.columns, order, outputs, descending, chunks)
    return cold.unionByName(cut)


def _plain_scan(df, keys, order, outputs, descending) -> DataFrame:
    by = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    over = Window.partitionBy(*keys).orderBy(*by)
    cols = {}
    for name, spec in outputs.items():
        if isinstance(spec, Running):
            frame = over.rowsBetween(Window.unboundedPreceding, 0 if spec.inclusive else -1)
            cols[name] = _windowed(spec, frame)
        else:
            step = F.lag if spec.step < 0 else F.lead
            cols[name] = step(_col(spec.value)).over(over)
    return df.select("*", *[c.alias(n) for n, c in cols.items()])


def _chunked_scan(base, columns, order, outputs, descending, chunks) -> DataFrame:
    base = with_chunk(base, order[0], chunks)
    rank = F.struct(*order)
    by = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    chunk_by = F.col(CHUNK).desc() if descending else F.col(CHUNK).asc()
    inside = Window.partitionBy(KEY, CHUNK).orderBy(*by)
    over_chunks = Window.partitionBy(KEY).orderBy(chunk_by)
    earlier = over_chunks.rowsBetween(Window.unboundedPreceding, -1)

    local, totals, offsets, final = {}, [], [], {}
    for name, spec in outputs.items():
        t, o = f"__t_{name}", f"__o_{name}"
        if isinstance(spec, Running):
            end = 0 if spec.inclusive else -1
            frame = inside.rowsBetween(Window.unboundedPreceding, end)
            local[f"__l_{name}"] = _windowed(spec, frame)
            if spec.fn in ("last", "first") and descending:
                flipped = Running("first" if spec.fn == "last" else "last", spec.value)
                totals.append(_total(flipped, rank).alias(t))
            else:
                totals.append(_total(spec, rank).alias(t))
            offsets.append(_across(spec, t, earlier).alias(o))
            before = F.coalesce(F.col(o), F.lit(0)) if spec.fn == "count" else F.col(o)
            final[name] = _merge(spec, before, F.col(f"__l_{name}"))
        else:
            # The value is boxed, so that a null value and a missing row differ.
            boxed = F.struct(_col(spec.value).alias("v"))
            local[f"__l_{name}"] = (
                F.lag(boxed).over(inside) if spec.step < 0 else F.lead(boxed).over(inside)
            )
            last_in_chunk = (spec.step < 0) != descending
            edge = F.max_by(boxed, rank) if last_in_chunk else F.min_by(boxed, rank)
            totals.append(edge.alias(t))
            moved = F.lag(t) if spec.step < 0 else F.lead(t)
            offsets.append(moved.over(over_chunks).alias(o))
            final[name] = F.coalesce(F.col(f"__l_{name}"), F.col(o))["v"]

    summary = base.groupBy(KEY, CHUNK).agg(*totals).select(KEY, CHUNK, *offsets)
    joined = base.withColumns(local).join(summary, [KEY, CHUNK], "left")
    return joined.select(*columns, *[c.alias(n) for n, c in final.items()])


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "pos", descending: bool = False, deal: bool = False) -> DataFrame:
    """Add the 1-based position of each row within its key."""
    return ordered_scan(df, keys, order, {name: Running("count")}, descending, deal=deal)


def first_per(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """Keep the first row of each key.

    ``row_number() = 1`` is pruned before the shuffle (window group limit), so a
    hot key sends one row per input partition.
    """
    cols = [_col(c) for c in order]
    return (
        df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*cols)))
        .filter("__rn = 1")
        .drop("__rn")
    )
