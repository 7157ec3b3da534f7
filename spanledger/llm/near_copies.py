"""Messages that are nearly the same text, by an LSH forest over MinHash signatures.

A message's set holds its distinct runs of ``words`` words. A signature is cut into
several trees; each tree orders all sets by their hashes as a sequence of levels. Sets
that agree in a long prefix of an order are likely similar, so the next neighbours in
each order are the candidates, down to a common prefix of ``MIN_DEPTH`` levels. How
deep neighbours really agree adapts to the region: where many sets are alike, the
next ones share many levels; elsewhere few do. In a region that holds more sets than
neighbours are looked at, each set also meets the region's hub, the set with the most
copies, at a shallow and at a deep level: what is edited from one text is linked
through it even where all copies of that text are far away in the order.

Regions wider than that which still hold several components are then finished: first
every set meets the region's centre, the set that agrees most with the region's usual
hashes; then a region's sets come together with their shingles, in blocks of bounded
size, and whatever does not hang together there yet is compared on the full sets. A
block gives the links that join its components, no pairs. So each pair that shares
``MIN_DEPTH`` levels of some tree is linked or was compared, however many sets are alike.

Equal sets are one class from the start, so copies are never paired with each other.
Candidates are confirmed on the full sets. The most promising pair of each set comes
first; after that only pairs are checked whose sets are not connected yet, since all
others change no component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanledger.llm.components import components
from spanledger.llm.rows import released, stored, text_key, texts

WORDS, SIMILARITY = 5, 80
TREES, DEPTH, MIN_DEPTH = 24, 8, 3
#: How many places ahead in each order a set is compared.
AHEAD = 3

SIGNED = "id long, key long, set_key binary, n_shingles long, signature binary"
NEAR = "a binary, b binary, depth int, tree int, branch binary, size long, copies long"
#: Levels of a region with a hub; marks the hub rows of a stretch's first and last region.
HUB_DEPTHS, HUB = (MIN_DEPTH, 5), -1
#: Shingles of a block of a wide region on its two sides; about so many sets show a region's usual hashes.
CHUNK, SLICE, SAMPLE = 300_000, 600_000, 128

_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_MULTIPLY = np.random.default_rng(3).integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Shingles:
    """64-bit hashes of the distinct word runs of texts."""

    def __init__(self, words: int):
        self.words = words

    def of(self, text: str | None) -> np.ndarray:
        found = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
        if not found:
            return np.zeros(0, np.uint64)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
        width = min(self.words, len(found))
        out = np.full(len(found) - width + 1, width, np.uint64)
        for k in range(width):
            out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(out)])
        return np.unique(out)


def signature(shingles: np.ndarray) -> bytes:
    """16 bits of each of the ``TREES * DEPTH`` smallest hashes, tree by tree."""
    least = np.full(TREES * DEPTH, ~np.uint64(0))
    for at in range(0, len(shingles), 1024):
        np.minimum(least, (shingles[at : at + 1024, None] * _MULTIPLY).min(axis=0), out=least)
    return (_mixed(least) >> np.uint64(48)).astype(">u2").tobytes()


def _sign(frames: Iterator[pd.DataFrame], words: int) -> Iterator[pd.DataFrame]:
    shingles = Shingles(words)
    for frame in frames:
        rows, signed = [], {}
        for item, key, text in zip(frame["id"], frame["key"], frame["content"], strict=True):
            found = shingles.of(text)
            if not len(found):
                rows.append((item, key, None, 0, None))
                continue
            name = xxhash.xxh3_128_digest(found.tobytes())
            if name not in signed:
                signed[name] = signature(found)
            rows.append((item, key, name, len(found), signed[name]))
        out = pd.DataFrame(rows, columns=["id", "key", "set_key", "n_shingles", "signature"])
        out["id"] = out["id"].astype("Int64")
        yield out


def _pairs(frame, i, j, depth, percent: int) -> pd.DataFrame:
    """Rows i and j as candidates if they agree deep enough and their sizes allow the similarity."""
    item, size = frame["set_key"].to_numpy(), frame["size"].to_numpy()
    small, large = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
    ok = (depth >= MIN_DEPTH) & (100 * small >= percent * large) & (i != j)
    out = pd.DataFrame({"a": item[i[ok]], "b": item[j[ok]], "depth": depth[ok]})
    for name in ("tree", "branch", "size", "copies"):
        out[name] = None
    return out


def _shared(frame, levels, i, j) -> np.ndarray:
    tree = frame["tree"].to_numpy()
    same = (levels[i] == levels[j]) & (tree[i] == tree[j])[:, None]
    return np.logical_and.accumulate(same, axis=1).sum(axis=1)


def _near(frames: Iterator[pd.DataFrame], percent: int, edges: bool) -> Iterator[pd.DataFrame]:
    """Candidates in one stretch of the sorted orders.

    With ``edges`` also its first and last rows, and the hubs of its first and last
    region, which may go on in the neighbouring stretches.
    """
    carry, first = None, None
    hubs: dict[int, pd.DataFrame | None] = dict.fromkeys(HUB_DEPTHS)
    first_hub = None
    for part in frames:
        if not len(part):
            continue
        frame = part if carry is None else pd.concat([carry, part], ignore_index=True)
        new = 0 if carry is None else len(carry)
        carry = frame.tail(AHEAD)
        first = frame.head(AHEAD) if first is None or len(first) < AHEAD else first
        levels = np.frombuffer(b"".join(frame["branch"]), np.uint16).reshape(-1, DEPTH)
        for step in range(1, AHEAD + 1):
            i = np.arange(max(0, new - step), len(frame) - step)
            yield _pairs(frame, i, i + step, _shared(frame, levels, i, i + step), percent)

        # The hub so far of a region that began in an earlier frame stands before the new rows.
        for depth in HUB_DEPTHS:
            held = hubs[depth]
            rows = part if held is None else pd.concat([held, part], ignore_index=True)
            levels = np.frombuffer(b"".join(rows["branch"]), np.uint16).reshape(-1, DEPTH)
            k = np.arange(1, len(rows))
            starts = np.concatenate([[0], k[_shared(rows, levels, k - 1, k) < depth]])
            size = np.diff(np.append(starts, len(rows)))
            copies = rows["copies"].to_numpy()
            region = np.repeat(np.arange(len(starts)), size)
            best = np.lexsort((-copies, region))[starts]
            hubs[depth] = rows.iloc[[best[-1]]]
            if first_hub is None and depth == MIN_DEPTH:
                first_hub = rows.iloc[[best[0]]]
            wide = np.flatnonzero(size[region] > AHEAD + 1)
            hub = best[region[wide]]
            yield _pairs(rows, wide, hub, _shared(rows, levels, wide, hub), percent)
    if edges and carry is not None:
        out = pd.concat([first, carry]).rename(columns={"set_key": "a"})
        out["b"], out["depth"] = None, None
        ends = pd.concat([first_hub, hubs[MIN_DEPTH]]).rename(columns={"set_key": "a"})
        ends["branch"] = [x[: 2 * MIN_DEPTH] for x in ends["branch"]]
        ends["b"], ends["depth"] = None, HUB
        for rows in (out, ends):
            yield rows[["a", "b", "depth", "tree", "branch", "size", "copies"]]


def candidates(sets: DataFrame, percent: int) -> DataFrame:
    """Pairs a < b of neighbouring sets and score, the levels they share over all orders.

    ``sets`` has set_key, n_shingles, copies and signature, one row per distinct set.
    A range partition splits even a region that most sets fall into; the few rows at
    the ends of the stretches are then compared once more across the cuts, and the
    hubs of regions that were cut meet all sets of these.
    """
    branches = sets.select(
        "set_key", F.col("n_shingles").alias("size"), "copies",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.lit(TREES - 1)),
                lambda t: F.struct(
                    t.alias("tree"),
                    F.substring("signature", t * (2 * DEPTH) + 1, F.lit(2 * DEPTH)).alias("branch"),
                ),
            )
        ).alias("t"),
    ).select(F.col("t.tree").alias("tree"), F.col("t.branch").alias("branch"), "set_key", "size", "copies")
    order = ["tree", "branch", "set_key"]
    ranged = branches.repartitionByRange(*order).sortWithinPartitions(*order)
    found = stored(ranged.mapInPandas(released(lambda frames: _near(frames, percent, True)), NEAR), "near-sets")
    ends = found.where("depth IS NULL").select("tree", "branch", F.col("a").alias("set_key"), "size", "copies")
    ends = ends.distinct().repartition(1).sortWithinPartitions(*order)  # 2 * AHEAD rows per task
    across = ends.mapInPandas(released(lambda frames: _near(frames, percent, False)), NEAR)

    hubs = found.where(F.col("depth") == HUB).groupBy("tree", F.col("branch").alias("region")).agg(
        F.max_by(F.struct("a", "size"), F.struct("copies", "a")).alias("hub"), F.count("*").alias("n")
    )
    # At most two rows per task; a region within one task has met its hub there.
    hubs = hubs.where("n > 1").select("tree", "region", F.col("hub.a").alias("a"), F.col("hub.size").alias("hub_size"))
    cut = branches.withColumn("region", F.substring("branch", 1, 2 * MIN_DEPTH)).join(hubs, ["tree", "region"])
    fits = 100 * F.least("size", "hub_size") >= percent * F.greatest("size", "hub_size")
    cut = cut.where(fits & (F.col("a") != F.col("set_key")))
    cut = cut.select("a", F.col("set_key").alias("b"), F.lit(MIN_DEPTH).alias("depth"))

    pairs = found.where("b IS NOT NULL").unionByName(across).select("a", "b", "depth").unionByName(cut)
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "depth")
    return pairs.groupBy("a", "b").agg(F.sum("depth").alias("score"))


def _spots(sets: DataFrame) -> DataFrame:
    """tree, region, set_key, size and component: each set in its region of each tree."""
    spots = sets.select(
        "set_key", F.col("n_shingles").alias("size"), "component",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.lit(TREES - 1)),
                lambda t: F.struct(
                    t.alias("tree"),
                    F.xxhash64(t, F.substring("signature", t * (2 * DEPTH) + 1, F.lit(2 * MIN_DEPTH))).alias("region"),
                ),
            )
        ).alias("t"),
    )
    return spots.select("t.tree", "t.region", "set_key", "size", "component")


def _with_components(sets: DataFrame, joined: DataFrame) -> DataFrame:
    own = joined.select(F.col("node").alias("set_key"), F.col("component").alias("in_"))
    return sets.join(own, "set_key", "left").withColumn("component", F.coalesce("in_", "set_key")).drop("in_")


def wide_rows(sets: DataFrame, joined: DataFrame) -> DataFrame:
    """tree, region, set_key and size of all sets of wide regions with several components."""
    spots = _spots(_with_components(sets, joined))
    return _several(spots, AHEAD + 1).select("tree", "region", "set_key", "size")


def _several(spots: DataFrame, above: int = 1) -> DataFrame:
    """Those of ``spots`` whose region has more than ``above`` sets and more than one component."""
    component = F.xxhash64("component")
    open_ = spots.groupBy("region").agg(
        F.count("*").alias("n"), F.min(component).alias("low"), F.max(component).alias("high")
    ).where(F.col("n") > above).where("low <> high")
    return spots.join(open_.select("region"), "region")


def _usual(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The most frequent hash of each place among the signatures of a region."""
    for frame in frames:
        out = []
        for signatures in frame["signatures"]:
            places = np.sort(np.frombuffer(b"".join(signatures), np.uint16).reshape(len(signatures), -1), axis=0)
            best, most, run = places[0].copy(), np.ones(places.shape[1], int), np.ones(places.shape[1], int)
            for before, row in zip(places, places[1:], strict=False):
                run = np.where(row == before, run + 1, 1)
                best, most = np.where(run > most, row, best), np.maximum(most, run)
            out.append(best.astype(np.uint16).tobytes())
        yield pd.DataFrame({"region": frame["region"], "usual": out})


def _agreeing(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        x, y = (np.frombuffer(b"".join(frame[k]), np.uint16).reshape(len(frame), -1) for k in ("signature", "usual"))
        yield frame[["region", "set_key", "size"]].assign(agreeing=(x == y).sum(axis=1))


def central_pairs(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs a < b of each set of a region and the region's centre, of different components.

    ``rows`` are wide_rows with component, ``sets`` has the signatures.
    """
    signed = rows.join(sets.select("set_key", "signature"), "set_key")
    n = rows.groupBy("region").agg(F.count("*").alias("n"))
    some = signed.join(n, "region").where(F.pmod(F.xxhash64("set_key"), F.ceil(F.col("n") / SAMPLE)) == 0)
    some = some.groupBy("region").agg(F.collect_list("signature").alias("signatures"))
    usual = some.mapInPandas(released(_usual), "region long, usual binary")
    met = signed.join(usual, "region").select("region", "set_key", "size", "signature", "usual")
    met = met.mapInPandas(released(_agreeing), "region long, set_key binary, size long, agreeing long")
    centre = met.groupBy("region").agg(F.max_by(F.struct("set_key", "size"), F.struct("agreeing", "set_key")).alias("c"))
    other = rows.select("region", F.col("set_key").alias("a"), F.col("component").alias("a_in"))
    centre = centre.select("region", F.col("c.set_key").alias("a"), F.col("c.size").alias("a_size")).join(other, ["region", "a"])
    fits = 100 * F.least("size", "a_size") >= percent * F.greatest("size", "a_size")
    pairs = rows.join(centre, "region").where(fits & (F.col("a_in") != F.col("component")))
    return pairs.select(F.least("a", "set_key").alias("a"), F.greatest("a", "set_key").alias("b")).distinct()


class _Joined:
    """Components that grow together, by the names of their members."""

    def __init__(self):
        self.above: dict = {}

    def root(self, x):
        while (y := self.above.get(x, x)) != x:
            self.above[x] = self.above.get(y, y)
            x = y
        return x

    def join(self, x, y) -> None:
        self.above[self.root(x)] = self.root(y)


def _block(frame: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links that join components of one block: its held sets are compared with all its met sets."""
    out = []
    held, met = frame[frame["held"]].reset_index(drop=True), frame[frame["met"]].reset_index(drop=True)
    if len(held) and len(met):
        sizes, keys, own = met["size"].to_numpy(), met["set_key"].to_numpy(), met["component"].to_numpy()
        shingles, place = np.unique(np.frombuffer(b"".join(met["shingles"]), np.uint64), return_inverse=True)
        place, starts = place.astype(np.int32), np.cumsum(sizes) - sizes
        joined, marks = _Joined(), np.zeros(len(shingles) + 1, np.int32)
        for key, size, component, data in zip(held["set_key"], held["size"], held["component"], held["shingles"], strict=True):
            x = np.frombuffer(data, np.uint64)
            at = np.searchsorted(shingles, x)
            at = at[shingles[np.minimum(at, len(shingles) - 1)] == x]
            marks[at] = 1
            shared = np.add.reduceat(marks[place], starts)
            marks[at] = 0
            for k in np.flatnonzero(100 * shared >= percent * (size + sizes - shared)):
                if joined.root(own[k]) != joined.root(component):
                    joined.join(own[k], component)
                    out.append((min(key, keys[k]), max(key, keys[k])))
    return pd.DataFrame(out, columns=["a", "b"], dtype=object)


def _shingled(frames: Iterator[pd.DataFrame], words: int) -> Iterator[pd.DataFrame]:
    shingles = Shingles(words)
    for frame in frames:
        yield pd.DataFrame({"set_key": frame["set_key"], "shingles": [shingles.of(t).tobytes() for t in frame["content"]]})


def remaining_links(rows: DataFrame, shingled: DataFrame, percent: int) -> DataFrame:
    """Links a < b between sets of one region and of different components, as many as join these.

    ``rows`` are wide_rows with component, ``shingled`` has the shingles of their sets.
    Sets outside a region's largest component are held in chunks and met by slices of
    all its sets; each chunk and slice is one block of bounded size, so no region is one task.
    """
    parts = rows.groupBy("region", "component").agg(F.count("*").alias("k"), F.sum("size").alias("s"))
    parts = parts.groupBy("region").agg(
        F.count("*").alias("components"), F.sum("s").alias("s"),
        F.max_by(F.struct("component", "s"), F.struct("k", "component")).alias("main"),
    ).where("components > 1")
    chunks, slices = F.ceil((F.col("s") - F.col("main.s")) / CHUNK), F.ceil(F.col("s") / SLICE)
    parts = parts.select("region", F.col("main.component").alias("main"), chunks.alias("chunks"), slices.alias("slices"))
    spots = rows.join(parts, "region").withColumn("h", F.xxhash64("set_key"))
    spots = spots.withColumn("held", F.col("component") != F.col("main")).withColumn("met", F.lit(True))
    one = (F.col("chunks") == 1) & (F.col("slices") == 1)
    names = ["region", "chunk", "slice", "held", "met", "set_key", "size", "component"]
    whole = spots.where(one).withColumns({"chunk": F.lit(0).cast("long"), "slice": F.lit(0).cast("long")}).select(*names)
    cut = spots.where(~one)
    held = cut.where("held").withColumns({"met": F.lit(False), "chunk": F.pmod("h", "chunks")})
    held = held.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
    met = cut.withColumns({"held": F.lit(False), "slice": F.pmod("h", "slices")})
    met = met.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    blocks = whole.unionByName(held.select(*names)).unionByName(met.select(*names)).join(shingled.hint("merge"), "set_key")
    return blocks.groupBy("region", "chunk", "slice").applyInPandas(lambda f: _block(f, percent), "a binary, b binary").distinct()


def _confirm(frames: Iterator[pd.DataFrame], words: int, percent: int) -> Iterator[pd.DataFrame]:
    shingles, last = Shingles(words), {}
    for frame in frames:
        keep = []
        for b, text_a, text_b in zip(frame["b"], frame["text_a"], frame["text_b"], strict=True):
            if b not in last:
                last = {b: shingles.of(text_b)}
            x, y = shingles.of(text_a), last[b]
            shared = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
        yield frame.loc[keep, ["a", "b"]]


def confirmed(pairs: DataFrame, sources: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of ``pairs`` whose full sets share at least ``percent`` of their union."""
    # Texts meet pairs by a shuffle at every size; neither side has a size bound.
    a = sources.select(F.col("set_key").alias("a"), F.col("content").alias("text_a")).hint("merge")
    b = sources.select(F.col("set_key").alias("b"), F.col("content").alias("text_b")).hint("merge")
    both = pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b")
    return both.mapInPandas(released(lambda frames: _confirm(frames, words, percent)), "a binary, b binary")


def near_copies(
    messages: DataFrame,
    id_column: str = "id",
    content: str = "content",
    words: int = WORDS,
    percent: int = SIMILARITY,
) -> DataFrame:
    """One row for each message: id, key, n_shingles, component_id and kept.

    Words are the runs without blanks of the text, A-Z in lower case; a text of fewer
    than ``words`` words has its whole sequence as the one element of its set. Two
    messages are linked if ``100 * shared >= percent * union``. component_id is the
    smallest id that links lead to, kept is true for that message. key stands for the
    text in joins.

    A null or empty text has no set and is linked with nothing; a row without id is
    kept and has no component; a row that repeats an id is judged by its own text; an
    empty table gives no rows.
    """
    docs = texts(messages, id_column, content).withColumn("key", text_key(F.col("content")))
    signed = stored(docs.mapInPandas(released(lambda frames: _sign(frames, words)), SIGNED), "signatures")
    known = signed.where("id IS NOT NULL AND n_shingles > 0")
    sets = stored(
        known.groupBy("set_key").agg(
            F.min(F.struct("id", "key")).alias("first"),
            F.count("*").alias("copies"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("signature").alias("signature"),
        ),
        "distinct-sets",
    )
    pairs = stored(candidates(sets, percent), "set-pairs")

    def sources_of(nodes: DataFrame) -> DataFrame:
        nodes = nodes.join(sets, "set_key").select("set_key", "first.id", "first.key").hint("merge")
        return docs.join(nodes, ["id", "key"]).select("set_key", "content").dropDuplicates(["set_key"])

    def texts_of(pairs: DataFrame) -> DataFrame:
        return stored(sources_of(pairs.select(F.explode(F.array("a", "b")).alias("set_key")).distinct()), "pair-texts")

    def with_links(joined: DataFrame, more: DataFrame) -> DataFrame:
        links = joined.select(F.col("node").alias("a"), F.col("component").alias("b"))
        return stored(components(links.unionByName(more)), "set-components")

    sources = texts_of(pairs)

    # The best partner of each set first, then what still crosses components.
    ends = pairs.select("a", "b", "score", F.explode(F.array("a", "b")).alias("node"))
    best = ends.groupBy("node").agg(F.max_by(F.struct("a", "b"), F.struct("score", "a", "b")).alias("p"))
    best = stored(best.select("p.a", "p.b").distinct(), "best-pairs")
    links = stored(confirmed(best, sources, words, percent), "set-links")
    joined = stored(components(links), "set-components")
    rest = pairs.join(best, ["a", "b"], "left_anti")
    for side in ("a", "b"):
        own = joined.select(F.col("node").alias(side), F.col("component").alias(f"{side}_in"))
        rest = rest.join(own, side, "left")
    rest = rest.where("a_in IS NULL OR b_in IS NULL OR a_in <> b_in")
    links = links.unionByName(confirmed(rest, sources, words, percent))
    joined = stored(components(links), "set-components")

    # What is left in wide regions: through their centres first, then pair by pair.
    rows = stored(wide_rows(sets, joined), "wide-rows")
    pairs = stored(central_pairs(_with_components(rows, joined), sets, percent), "central-pairs")
    if not pairs.isEmpty():
        joined = with_links(joined, confirmed(pairs, texts_of(pairs), words, percent))
    rows = stored(_several(_with_components(rows, joined)), "open-rows")
    if not rows.isEmpty():
        own = rows.select("set_key").distinct()
        shingled = sources_of(own).mapInPandas(released(lambda frames: _shingled(frames, words)), "set_key binary, shingles binary")
        joined = with_links(joined, remaining_links(rows, stored(shingled, "wide-shingles"), percent))

    members = sets.join(joined, sets["set_key"] == joined["node"], "left").select(
        "set_key", F.col("first.id").alias("own"), F.coalesce("component", "set_key").alias("component")
    )
    least = members.groupBy("component").agg(F.min("own").alias("component_id"))
    least = members.join(least, "component").select("set_key", "component_id")
    out = signed.join(least, "set_key", "left")
    own = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select("id", "key", "n_shingles", own.alias("component_id")).withColumn(
        "kept", F.col("id").isNull() | (F.col("id") == F.col("component_id"))
    )
