"""Which texts contain which others, without comparing all pairs.

Texts meet on sampled grams. Of every window of neighbouring grams the one with the
least hash is kept; a text that holds another holds all its windows and so keeps the
same grams. Only a fraction of a text's grams travels, and long words need no
special care: a text of any length is worked through once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanledger.plans.durable import durable

#: Least length of a needle, size of its grams and grams in a window: the longer a needle, the fewer of a text's
#: grams are needed. A window of ``GRAMS[k]`` is never longer than the least length.
GRAMS = ((1, 1, 1), (2, 2, 1), (3, 3, 1), (8, 5, 4), (32, 16, 17))

_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def sampled_grams(text: str, kind: int) -> np.ndarray:
    """Hashes of the grams that the windows of a text keep, each once."""
    _, size, window = GRAMS[kind]
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(code) - size + 1
    if n < window:
        return np.zeros(0, np.int64)
    grams = np.full(n, kind + 1, np.uint64)
    for k in range(size):
        grams = grams * _BASE + code[k : k + n]
    grams = _mixed(grams)
    least = grams[: n - window + 1].copy()
    for k in range(1, window):
        np.minimum(least, grams[k : k + len(least)], out=least)
    return np.unique(least).view(np.int64)


def kind_of(length: int) -> int:
    """Which of ``GRAMS`` a needle of this length uses."""
    return max(k for k, (least, _, _) in enumerate(GRAMS) if length >= least)


def _cut(frames: Iterator[pa.RecordBatch], names: list[str], own: bool) -> Iterator[pa.RecordBatch]:
    for frame in frames:
        found = []
        kinds = frame["__kinds"].to_pylist()
        for text, asked in zip(frame["__text"].to_pylist(), kinds, strict=True):
            wanted = [kind_of(len(text))] if own else asked
            found.append(np.concatenate([sampled_grams(text, k) for k in wanted]) if wanted else np.zeros(0, np.int64))
        rows = np.repeat(np.arange(len(found)), [len(x) for x in found])
        kept = frame.select(names).take(pa.array(rows))
        piece = pa.array(np.concatenate(found) if found else np.zeros(0, np.int64), pa.int64())
        yield pa.RecordBatch.from_arrays([*kept.columns, piece], names=[*names, "piece"])


def _pieces(df: DataFrame, names: list[str], own: bool) -> DataFrame:
    """names and piece of texts (``__text``, ``__kinds``): those of their own kind, or of all kinds that are asked for."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*names).schema)
    return df.select(*names, "__text", "__kinds").mapInArrow(lambda frames: _cut(frames, names, own), f"{schema}, piece bigint")


def contained(
    needles: DataFrame, haystacks: DataFrame, keys: list[str], nid: str, needle: str, hid: str, text: str, least: int = 3
) -> DataFrame:
    """Pairs (nid, hid) of a key whose haystack text contains the needle text.

    Needles have at least ``least`` characters and are not blank; null texts are in no
    pair. Each needle meets the texts on the one of its grams that the fewest texts
    keep, and every met pair is confirmed on the full texts, which is the only time
    that these are shuffled.
    """
    c = F.col
    nd = needles.select(*keys, nid, c(needle).alias("__needle"))
    nd = nd.filter((F.length("__needle") >= max(1, least)) & c("__needle").rlike(r"\S"))
    kind = F.lit(0)
    for k, (length, _, _) in enumerate(GRAMS):
        kind = F.when(F.length("__needle") >= length, k).otherwise(kind)
    none = F.array().cast("array<int>")
    cut = _pieces(nd.withColumns({"__text": c("__needle"), "__kinds": none}), [*keys, nid], own=True)
    kinds = nd.agg(F.array_sort(F.collect_set(kind))).scalar()
    hs = haystacks.select(*keys, hid, c(text).alias("__text")).filter("__text IS NOT NULL")
    hay = _pieces(hs.withColumn("__kinds", F.coalesce(kinds, none)), [*keys, hid], own=False)

    # Grams that no needle keeps are dropped where they arise, if the needles are few.
    asked = cut.select(*keys, "piece").distinct()
    hay = durable(hay.join(asked, [*keys, "piece"], "left_semi"))
    counts = hay.groupBy(*keys, "piece").agg(F.count(F.lit(1)).alias("__c"))
    rated = cut.join(counts, [*keys, "piece"], "left")
    best = rated.groupBy(*keys, nid).agg(F.min(F.struct(F.coalesce("__c", F.lit(0)).alias("c"), c("piece").alias("p"))).alias("b"))
    chosen = best.filter("b.c > 0").select(*keys, nid, c("b.p").alias("piece"))
    met = chosen.join(hay, [*keys, "piece"]).select(*keys, nid, hid)
    return met.join(nd, [*keys, nid]).join(hs, [*keys, hid]).filter(F.contains(c("__text"), c("__needle"))).select(*keys, nid, hid)
