"""Row-by-row folds whose keys may be larger than one task should hold.

A fold needs the state left by all earlier rows of its key. Keys of ordinary size
are hashed to partitions, sorted there, and folded as the rows stream by, many keys
per task and with one state in memory. A key with more than ``chunk_rows`` rows is
cut into chunks that run side by side.

Where the state has a finite control part (``Relative``), every chunk is folded once
from each control state it might start with, which soon fall together, and gives a
small map from start to end. Going through the maps of a key, one row per chunk, then
gives every chunk's true start. The number of jobs does not depend on the chunks.

Without one, every chunk is folded from a guess; then the state each chunk ended with
is handed to the next one, and only the chunks whose start was guessed wrong are
folded again, until no start changes. States that forget their past (anchors, short
windows) settle after two or three rounds. The result is that of a plain fold either way.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanledger.plans.durable import durable
from spanledger.plans.scan import numbered

CHUNK_ROWS = 1_000_000

Columns = dict[str, np.ndarray]
Step = Callable[[Columns, str | None], tuple[Columns, str]]


@dataclass(frozen=True)
class Relative:
    """A state split into a finite control part and what is only counted or set.

    ``controls`` are all control states as text, ``control_of`` gives that of a saved
    state (None at the start of a key), ``start_from`` a saved state of a control with
    everything else unknown, and ``after`` the state that follows ``before`` once the
    rows were folded that led from such a start to ``effect``.
    """

    controls: list[str]
    control_of: Callable[[str | None], str]
    start_from: Callable[[str], str]
    after: Callable[[str | None, str], str]


def _segments(pdf: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Where a new key starts within a batch (the first row always counts)."""
    new = np.zeros(len(pdf), dtype=bool)
    new[0] = True
    for k in keys:
        v = pdf[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def _walk(batches: Iterator[pd.DataFrame], keys: list[str], step: Step):
    """Fold sorted batches; yields (batch, start, end, key values, output, state, is_same_key)."""
    last, state = None, None
    for pdf in batches:
        if not len(pdf):
            continue
        cols = {c: pdf[c].to_numpy() for c in pdf.columns}
        bounds = [*_segments(pdf, keys).tolist(), len(pdf)]
        for i, j in zip(bounds, bounds[1:]):
            key = tuple(cols[k][i] for k in keys)
            same = key == last
            if not same:
                start = cols["__state"][i]
                state = None if start is None or start != start else start
            out, state = step({c: v[i:j] for c, v in cols.items()}, state)
            yield key, same, out, j - i, state, j == len(pdf)
            last = key


def fold(df: DataFrame, keys: list[str], order: list[str], step: Step, output: str, chunk_rows: int = CHUNK_ROWS, relative: Relative | None = None) -> DataFrame:
    """Fold the rows of each key in order.

    ``step(columns, state)`` gets consecutive rows of one key as arrays and the state
    before them (text, None at the start of a key) and returns the output columns
    and the state after them. A key may arrive in several calls. ``output`` is the
    schema of the output rows without the keys.
    """
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    names = [f.strip().split(" ")[0].strip("`") for f in output.split(",")]

    def schema(cols: list[str]) -> str:
        return ", ".join(f"`{c}` {types.get(c, 'bigint')}" for c in cols)

    def rows_of(group: list[str]):
        def work(batches):
            parts: list[dict] = []
            for key, _, out, n, _, batch_ends in _walk(batches, group, step):
                parts.append({**{k: np.repeat(np.array([v], dtype=object), n) for k, v in zip(keys, key)}, **{c: out[c] for c in names}})
                if batch_ends:
                    yield pd.DataFrame({c: np.concatenate([np.asarray(p[c], dtype=object) for p in parts]) for c in [*keys, *names]}).infer_objects()
                    parts = []

        return work

    def ends_of(group: list[str]):
        def work(batches):
            done, held = [], None
            for key, _, _, _, state, batch_ends in _walk(batches, group, step):
                if held is not None and held[:-1] != key:
                    done.append(held)
                held = (*key, state)
                if batch_ends and done:
                    yield pd.DataFrame(done, columns=[*group, "__end"])
                    done = []
            if held is not None:
                yield pd.DataFrame([held], columns=[*group, "__end"])

        return work

    def sorted_by(part: DataFrame, group: list[str], by: list[str]) -> DataFrame:
        return part.repartition(*group).sortWithinPartitions(*group, *by)

    def plain(part: DataFrame) -> DataFrame:
        ready = sorted_by(part.withColumn("__state", F.lit(None).cast("string")), keys, order)
        return ready.mapInPandas(rows_of(keys), f"{schema(keys)}, {output}")

    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > chunk_rows).select(*keys)
    if hot.isEmpty():
        return plain(df)
    hot = durable(hot)

    group = [*keys, "__chunk"]
    placed = numbered(df.join(hot, keys, "left_semi"), keys, order, "__pos")
    placed = durable(placed.withColumn("__chunk", F.floor((F.col("__pos") - 1) / chunk_rows)))

    def ends(starts: DataFrame) -> DataFrame:
        ready = sorted_by(placed.join(starts, group), group, ["__pos"])
        return ready.mapInPandas(ends_of(group), f"{schema(group)}, __end string")

    def maps(batches):
        """The end of each chunk for every control it might start with."""
        last, effects = None, {}
        for pdf in batches:
            if not len(pdf):
                continue
            cols = {c: pdf[c].to_numpy() for c in pdf.columns}
            bounds = [*_segments(pdf, group).tolist(), len(pdf)]
            done = []
            for i, j in zip(bounds, bounds[1:]):
                key = tuple(cols[k][i] for k in group)
                if key != last:
                    if last is not None:
                        done.append((*last, json.dumps(effects)))
                    effects, last = {c: relative.start_from(c) for c in relative.controls}, key
                now = {c: relative.control_of(e) for c, e in effects.items()}
                part = {c: v[i:j] for c, v in cols.items()}
                ends = {c: step(part, relative.start_from(c))[1] for c in set(now.values())}
                effects = {c: relative.after(e, ends[now[c]]) for c, e in effects.items()}
            if done:
                yield pd.DataFrame(done, columns=[*group, "__end"])
        if last is not None:
            yield pd.DataFrame([(*last, json.dumps(effects))], columns=[*group, "__end"])

    def chain(pdf):
        """The state at the start of each chunk of one key."""
        pdf, state, starts = pdf.sort_values("__chunk"), None, []
        for text in pdf["__end"]:
            starts.append(state)
            state = relative.after(state, json.loads(text)[relative.control_of(state)])
        return pdf.assign(__state=pd.Series(starts, index=pdf.index, dtype=object))[[*group, "__state"]]

    if relative:
        known = sorted_by(placed, group, ["__pos"]).mapInPandas(maps, f"{schema(group)}, __end string")
        starts = known.groupBy(*keys).applyInPandas(chain, f"{schema(group)}, __state string")
        ready = sorted_by(placed.join(durable(starts), group), group, ["__pos"])
        chunked = ready.mapInPandas(rows_of(group), f"{schema(keys)}, {output}")
        return plain(df.join(hot, keys, "left_anti")).unionByName(chunked)

    starts = durable(placed.select(*group).distinct().withColumn("__state", F.lit(None).cast("string")))
    known = durable(ends(starts))
    over = Window.partitionBy(*keys).orderBy("__chunk")
    while True:
        proposed = known.withColumn("__next", F.lag("__end").over(over)).select(*group, "__next")
        wrong = durable(
            starts.join(proposed, group).filter(~F.col("__state").eqNullSafe(F.col("__next"))).select(*group, F.col("__next").alias("__state"))
        )
        if wrong.isEmpty():
            break
        starts = durable(starts.join(wrong.select(*group), group, "left_anti").unionByName(wrong))
        known = durable(known.join(wrong.select(*group), group, "left_anti").unionByName(ends(wrong)))
    ready = sorted_by(placed.join(starts, group), group, ["__pos"])
    chunked = ready.mapInPandas(rows_of(group), f"{schema(keys)}, {output}")
    return plain(df.join(hot, keys, "left_anti")).unionByName(chunked)
