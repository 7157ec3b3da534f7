"""Repeated passages between messages, byte by byte, by hash-compared suffix sorting.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts in a message
with a smaller id. All strings of that length are compared, as follows.

1. Every window of ``LENGTH`` bytes belongs to the block of its smallest hashed
   12-byte gram. Neighbouring windows mostly share it, so a run of windows travels as
   one piece of text, and equal windows always meet in one block.
2. Pieces that are equal within a batch of messages are settled at once: all but the
   one with the smallest id are repeated whole and only their place travels on. So a
   passage that a third of all messages share reaches its block once per batch.
3. In a block, prefix polynomial hashes give the hash of any substring at once. Equal
   pieces are settled as before. The windows of the rest that occur twice are sorted
   as suffixes by mergesort; two suffixes are compared by a binary search, over
   hashes, for their common extension. Neighbours with a common extension of
   ``LENGTH`` bytes form a class; its smallest id keeps the string. Equal hashes are
   verified by comparing bytes.
4. Ranges and texts meet by message, both packed and compressed by the batch, and the
   ranges are merged and cut out there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanledger.llm.rows import in_small_batches, released, text_key

LENGTH = 50
GRAM = 12
#: Bytes of text that one batch settles among itself, and that are hashed at a time.
BATCH, STEP = 8 << 20, 1 << 20
#: Bytes of text for each block, which holds more than three times as many, and the
#: parts of a block that are sorted one after another.
BLOCK_TEXT, PARTS = 16 << 20, 24

PACKED = "block int, kind int, n int, body binary"
PACKED_COLUMNS = ["block", "kind", "n", "body"]
LEFT = (
    "id long, content string, spans array<array<long>>, n_bytes long, n_removed long, n_spans long, "
    "kept_sha256 string, others string"
)
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_VALUES = np.random.default_rng(50).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class PrefixHashes:
    """Polynomial hashes of every substring of ``data`` from those of its prefixes."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        powers = np.full(n + 1, BASE, np.uint64)
        powers[0] = 1
        np.cumprod(powers, out=powers)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUES[data] * powers[:n], out=self.prefix[1:])
        powers[:] = INVERSE
        powers[0] = 1
        np.cumprod(powers, out=powers)
        self.scale = powers

    def of(self, at: np.ndarray, length) -> np.ndarray:
        return (self.prefix[at + length] - self.prefix[at]) * self.scale[at]


def spread_index(at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All positions of the ranges ``at .. at + length``, one range after another."""
    total = int(length.sum())
    out = np.ones(total, np.int64)
    if total:
        ends = np.cumsum(length)
        out[0] = at[0]
        out[ends[:-1]] = at[1:] - (at[:-1] + length[:-1]) + 1
        np.cumsum(out, out=out)
    return out


def equal_ranges(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the bytes of each pair of ranges are the same."""
    if not len(a):
        return np.zeros(0, bool)
    out = np.zeros(len(a), bool)
    # A bounded number of bytes at a time.
    step = np.cumsum(length) // STEP
    for low, high in stretches(step):
        x, y, n = a[low:high], b[low:high], length[low:high]
        same = data[spread_index(x, n)] == data[spread_index(y, n)]
        out[low:high] = np.logical_and.reduceat(same, np.cumsum(n) - n)
    return out


def window_runs(data: np.ndarray, first: np.ndarray, size: np.ndarray, length: int):
    """Runs of windows with one smallest gram: (start, windows, gram, hash of the text).

    ``first`` and ``size`` are the messages' places in ``data``.
    """
    ends = first + size - length  # last window of each message
    keep = ends >= first
    first, ends = first[keep], ends[keep]
    valid = np.zeros(len(data) + 1, np.int8)
    np.add.at(valid, first, 1)
    np.add.at(valid, ends + 1, -1)
    valid = np.cumsum(valid, dtype=np.int8).astype(bool)
    begins = np.zeros(len(data) + 1, bool)
    begins[first] = True
    w = length - GRAM + 1
    out = []
    for low in range(0, len(data), STEP):
        high = min(low + STEP, len(data))
        part = data[low : min(high + length - 1, len(data))]
        if len(part) < length:
            continue
        g = part.astype(np.uint64)
        for width in (1, 2, 4):
            g = g[:-width] | (g[width:] << np.uint64(8 * width))
        h = mixed(g[: 8 - GRAM] * np.uint64(0xD6E8FEB86659FD93) + mixed(g[GRAM - 8 :]))
        step = 1
        while step * 2 <= w:
            h = np.minimum(h[:-step], h[step:])
            step *= 2
        if w > step:
            h = np.minimum(h[: step - w], h[w - step :])
        n = len(h)
        ok = valid[low : low + n]
        change = begins[low : low + n].copy()
        change[0] = True
        change[1:] |= (h[1:] != h[:-1]) | ~ok[:-1]
        starts = np.flatnonzero(change & ok)
        stops = np.flatnonzero(ok & ~np.append(ok[1:] & ~change[1:], False)) + 1
        runs = stops - starts
        hashed = PrefixHashes(part).of(starts, runs + length - 1)
        out.append((starts + low, runs, h[starts], mixed(hashed + runs.astype(np.uint64))))
    if not out:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def settle(data, at, size, digest, ids):
    """Equal texts: (representative of each, whether it repeats one with a smaller id).

    The representative has the smallest id of its class. Texts with equal digests but
    other bytes stay their own representatives.
    """
    order = np.lexsort((at, ids, digest))
    head = np.ones(len(order), bool)
    head[1:] = digest[order][1:] != digest[order][:-1]
    leader = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    lead = np.empty(len(order), np.int64)
    lead[order] = leader
    other = np.flatnonzero(lead != np.arange(len(lead)))
    fits = size[other] == size[lead[other]]
    same = np.zeros(len(other), bool)
    pick = other[fits]
    same[fits] = equal_ranges(data, at[pick], at[lead[pick]], size[pick])
    lead[other[~same]] = other[~same]
    return lead, ids > ids[lead]


#: Kinds of packed rows: pieces of text to compare, repeated ranges, whole texts.
PIECE, RANGE, TEXT = 0, 1, 2
ARRAYS = (np.int64, np.uint32, np.uint32, np.int32, np.uint8)


def packed(block: int, kind: int, arrays, data: bytes = b"") -> tuple:
    """A row of ids, keys, starts, sizes and marks, and the text behind them."""
    body = b"".join(x.astype(k).tobytes() for x, k in zip(arrays, ARRAYS, strict=True)) + data
    return block, kind, len(arrays[0]), zstandard.ZstdCompressor(level=3).compress(body)


def unpacked(n: int, body: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    body = zstandard.ZstdDecompressor().decompress(body)
    out, at = [], 0
    for kind in ARRAYS:
        out.append(np.frombuffer(body, kind, n, at))
        at += np.dtype(kind).itemsize * n
    return out, np.frombuffer(body, np.uint8, offset=at)


def stretches(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of the runs of equal values."""
    if len(values):
        edges = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        yield from zip(edges[:-1], edges[1:], strict=True)


def _shelves(ids: np.ndarray, blocks: int) -> np.ndarray:
    return (mixed(ids.astype(np.uint64)) % np.uint64(blocks)).astype(np.int64)


def _by_shelf(ids, keys, starts, sizes, blocks: int) -> Iterator[tuple]:
    """Repeated ranges packed by the shelf of their message."""
    shelf = _shelves(ids, blocks)
    order = np.lexsort((starts, ids, shelf))
    for a, b in stretches(shelf[order]):
        p = order[a:b]
        yield packed(int(shelf[p[0]]), RANGE, (ids[p], keys[p], starts[p], sizes[p], np.zeros(len(p))))


def _joined(starts: np.ndarray, sizes: np.ndarray, owner: np.ndarray):
    """Overlapping or touching ranges of one owner as one, given in order of owner and start."""
    if not len(starts):
        return starts, sizes, owner
    stop = starts + sizes
    # Starts rise within an owner; a running maximum of the stops, kept apart by owner.
    lift = owner * (int(stop.max()) + 1)
    reach = np.maximum.accumulate(stop + lift)
    head = np.ones(len(starts), bool)
    head[1:] = (starts + lift)[1:] > reach[:-1]
    at = np.flatnonzero(head)
    last = np.append(at[1:], len(starts)) - 1
    return starts[at], reach[last] - lift[at] - starts[at], owner[at]


def _cut(frames: Iterator[pd.DataFrame], length: int, blocks: int) -> Iterator[pd.DataFrame]:
    """Pieces of text for each block, and ranges that are settled within a batch."""

    def batch(ids: list[int], keys: list[int], texts_: list[bytes]) -> Iterator[tuple]:
        size = np.array([len(x) for x in texts_], np.int64)
        first = np.cumsum(size) - size
        data = np.frombuffer(b"".join(texts_), np.uint8)
        id_of, key_of = np.array(ids, np.int64), np.array(keys, np.int64)
        at, runs, gram, digest = window_runs(data, first, size, length)
        if not len(at):
            return
        owner = np.searchsorted(first, at, "right") - 1
        width = runs + length - 1
        lead, settled = settle(data, at, width, digest, id_of[owner])
        s = np.flatnonzero(settled)
        start, wide, who = _joined(at[s] - first[owner[s]], width[s], owner[s])
        yield from _by_shelf(id_of[who], key_of[who], start, wide, blocks)
        rest = np.flatnonzero(~settled)
        spot = mixed(gram[rest])
        block = (spot % np.uint64(blocks)).astype(np.int64)
        part = (spot >> np.uint64(48)) % np.uint64(PARTS)
        order = np.argsort(block, kind="stable")
        rest, block, part = rest[order], block[order], part[order]
        for a, b in stretches(block):
            p = rest[a:b]
            who = owner[p]
            arrays = (id_of[who], key_of[who], at[p] - first[who], width[p], part[a:b])
            yield packed(int(block[a]), PIECE, arrays, data[spread_index(at[p], width[p])].tobytes())

    ids, keys, held, total = [], [], [], 0
    for frame in frames:
        for item, key, text in zip(frame["id"], frame["key"], frame["content"], strict=True):
            body = text.encode("utf-8", "surrogatepass")
            ids.append(item)
            keys.append(key)
            held.append(body)
            total += len(body)
            if total >= BATCH:
                yield pd.DataFrame(batch(ids, keys, held), columns=PACKED_COLUMNS)
                ids, keys, held, total = [], [], [], 0
    if held:
        yield pd.DataFrame(batch(ids, keys, held), columns=PACKED_COLUMNS)


class SuffixOrder:
    """Mergesort of suffixes of ``data``, compared through prefix hashes."""

    def __init__(self, data: np.ndarray, hashes: PrefixHashes, length: int):
        self.data, self.hashes, self.length = data, hashes, length
        self.steps = [1 << k for k in range(length.bit_length() - 1, -1, -1)]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes ``a`` and ``b``, at most ``length``."""
        # Equal at full length is the most frequent case.
        whole = self.hashes.of(a, self.length) == self.hashes.of(b, self.length)
        out = np.where(whole, self.length, 0)
        for step in self.steps:
            open_ = np.flatnonzero(out + step <= self.length)
            x, y = a[open_] + out[open_], b[open_] + out[open_]
            same = self.hashes.of(x, step) == self.hashes.of(y, step)
            out[open_[same]] += step
        return out

    def before(self, a: np.ndarray, b: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether suffix ``a`` comes before ``b``; ``ties`` where they are equal."""
        shared = self.common(a, b)
        whole = shared >= self.length
        k = np.where(whole, 0, shared)
        return np.where(whole, ties, self.data[a + k] < self.data[b + k])

    def sorted(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """``at`` in suffix order within each group; groups are contiguous."""
        at = at.copy()
        n = len(at)
        head = np.flatnonzero(np.diff(group, prepend=group[0] - 1)) if n else np.zeros(0, np.int64)
        size = np.diff(np.append(head, n))
        low, top = np.repeat(head, size), np.repeat(head + size, size)
        index = np.arange(n)
        run = 1
        while n and run < size.max():
            pick = np.flatnonzero(top - low > run)  # groups of one run are in order
            i = index[pick]
            rank = i - low[pick]
            left = (rank // run) % 2 == 0
            own = low[pick] + rank // run * run
            sibling = np.where(left, own + run, own - run)
            stop = np.minimum(sibling + run, top[pick])
            a, b = np.minimum(sibling, stop), stop
            # Places before this one in the sibling run, by binary search.
            while (open_ := np.flatnonzero(a < b)).size:
                mid = (a[open_] + b[open_]) // 2
                # Equal suffixes of the left run come first.
                past = self.before(at[mid], at[i[open_]], ~left[open_])
                a[open_] = np.where(past, mid + 1, a[open_])
                b[open_] = np.where(past, b[open_], mid)
            passed = a - np.minimum(sibling, stop)
            target = np.minimum(own, np.where(left, own, sibling)) + (i - own) + passed
            moved = at.copy()
            moved[target] = at[i]
            at = moved
            run *= 2
        return at


def repeated_windows(data, at, ids, length: int, hashes: PrefixHashes) -> np.ndarray:
    """Whether each window (start ``at`` in ``data``) also occurs under a smaller id."""
    out = np.zeros(len(at), bool)
    digest = hashes.of(at, length)
    values = np.sort(digest)
    twice = np.unique(values[1:][values[1:] == values[:-1]])
    if not len(twice):
        return out
    shift = np.uint64(42)
    seen = np.zeros(1 << 22, bool)
    seen[twice >> shift] = True
    pick = np.flatnonzero(seen[digest >> shift])
    pick = pick[twice[np.minimum(np.searchsorted(twice, digest[pick]), len(twice) - 1)] == digest[pick]]
    # Start the mergesort from suffixes that agree in their first 16 bytes.
    words = [
        np.ascontiguousarray(data[at[pick][:, None] + np.arange(k, k + 8)]).view(">u8")[:, 0] for k in (0, 8)
    ]
    order = np.lexsort((words[1], words[0]))
    pick = pick[order]
    new = (np.diff(words[0][order], prepend=0) != 0) | (np.diff(words[1][order], prepend=0) != 0)
    new[0] = True
    group = np.cumsum(new)
    # Suffix starts are unique, so they lead back to the windows.
    suffixes = SuffixOrder(data, hashes, length)
    start = suffixes.sorted(at[pick], group)
    back = np.argsort(at[pick], kind="stable")
    window = pick[back[np.searchsorted(at[pick][back], start)]]
    near = suffixes.common(start[:-1], start[1:]) >= length
    rows = np.flatnonzero(near)
    wide = np.full(len(rows), length, np.int64)
    if not equal_ranges(data, start[rows], start[rows + 1], wide).all():
        # Two different strings with one hash: order these windows by their bytes.
        body = np.ascontiguousarray(data[at[pick][:, None] + np.arange(length)]).view(f"V{length}")[:, 0]
        _, classes = np.unique(body, return_inverse=True)
        back = np.argsort(classes, kind="stable")
        window, near = pick[back], np.diff(classes[back]) == 0
    class_ = np.cumsum(np.append(True, ~near)) - 1
    smallest = np.minimum.reduceat(ids[window], np.flatnonzero(np.append(True, ~near)))
    out[window] = ids[window] > smallest[class_]
    return out


def _resolve(frame: pd.DataFrame, length: int, blocks: int) -> pd.DataFrame:
    """The repeated ranges of one block's pieces, packed by message."""
    is_piece = frame["kind"] == PIECE
    rows = [tuple(x) for x in frame.loc[~is_piece, PACKED_COLUMNS].itertuples(index=False)]
    held = [unpacked(n, body) for n, body in frame.loc[is_piece, ["n", "body"]].itertuples(index=False)]
    for part in range(PARTS if held else 0):
        arrays, texts_ = [], []
        for (*ranges, mark), body in held:
            pick = mark == part
            at = (np.cumsum(ranges[3], dtype=np.int64) - ranges[3])[pick]
            arrays.append([x[pick].astype(np.int64) for x in ranges])
            texts_.append(body[spread_index(at, arrays[-1][3])])
        ids, keys, starts, sizes = (np.concatenate(x) for x in zip(*arrays, strict=True))
        if len(ids):
            who, begin, wide = _repeats(np.concatenate(texts_), ids, sizes, length)
            rows += _by_shelf(ids[who], keys[who], starts[who] + begin, wide, blocks)
    return pd.DataFrame(rows, columns=PACKED_COLUMNS)


def _repeats(data, ids, sizes, length: int):
    """Repeated ranges of the pieces in ``data``: piece, start in it, size."""
    at = np.cumsum(sizes) - sizes
    hashes = PrefixHashes(data)
    digest = mixed(hashes.of(at, sizes) + sizes.astype(np.uint64))
    lead, settled = settle(data, at, sizes, digest, ids)
    own = lead == np.arange(len(lead))
    reps, windows = np.flatnonzero(own), sizes - length + 1
    flags = np.zeros(len(data), bool)
    where = spread_index(at[reps], windows[reps])
    flags[where] = repeated_windows(data, where, np.repeat(ids[reps], windows[reps]), length, hashes)
    # Pieces that are equal to a representative of their own message share its flags.
    same = np.flatnonzero(~own & ~settled)
    flags[spread_index(at[same], windows[same])] = flags[spread_index(at[lead[same]], windows[same])]
    s = np.flatnonzero(settled)
    flags[spread_index(at[s], windows[s])] = True
    hit = np.flatnonzero(flags)
    piece = np.searchsorted(at, hit, "right") - 1
    new = np.ones(len(hit), bool)
    new[1:] = (np.diff(hit) > 1) | (np.diff(piece) > 0)
    begin = np.flatnonzero(new)
    runs = np.diff(np.append(begin, len(hit)))
    who = piece[begin]
    return who, hit[begin] - at[who], runs + length - 1


def _shelve(frames: Iterator[pd.DataFrame], blocks: int) -> Iterator[pd.DataFrame]:
    """Whole texts and other columns packed by the shelf of their message.

    The starts hold the bytes of the other columns; mark 1: no id, 2: no text.
    """
    for frame in frames:
        no_id, no_text = frame["id"].isna().to_numpy(), frame["content"].isna().to_numpy()
        ids = frame["id"].fillna(0).to_numpy(np.int64)
        bodies = [(x or "").encode("utf-8", "surrogatepass") for x in frame["content"]]
        others = [x.encode() for x in frame["others"]]
        size = np.array([len(x) for x in bodies], np.int64)
        extra = np.array([len(x) for x in others], np.int64)
        # Rows without id are dealt out by their place.
        shelf = _shelves(np.where(no_id, np.arange(len(ids)), ids), blocks)
        order, keys = np.argsort(shelf, kind="stable"), frame["key"].to_numpy(np.int64)
        rows = []
        for a, b in stretches(shelf[order]):
            p = order[a:b]
            arrays = (ids[p], keys[p], extra[p], size[p], no_id[p] + 2 * no_text[p])
            rows.append(packed(int(shelf[p[0]]), TEXT, arrays, b"".join(bodies[k] + others[k] for k in p)))
        yield pd.DataFrame(rows, columns=PACKED_COLUMNS)


def _gather(frame: pd.DataFrame) -> pd.DataFrame:
    """The messages of one shelf without their repeated ranges."""
    spans: dict[tuple[int, int], list[list[int]]] = {}
    ranges = frame.loc[frame["kind"] == RANGE, ["n", "body"]]
    if len(ranges):
        found = [unpacked(n, body)[0] for n, body in ranges.itertuples(index=False)]
        ids, keys, starts, sizes, _ = (np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True))
        order = np.lexsort((starts, keys, ids))
        ids, keys, starts, sizes = ids[order], keys[order], starts[order], sizes[order]
        new = (np.diff(ids, prepend=ids[0] - 1) != 0) | (np.diff(keys, prepend=keys[0]) != 0)
        head = np.flatnonzero(new)
        starts, sizes, owner = _joined(starts, sizes, np.cumsum(new) - 1)
        for a, size, k in zip(starts.tolist(), sizes.tolist(), head[owner].tolist(), strict=True):
            spans.setdefault((int(ids[k]), int(keys[k])), []).append([a, a + size])
    rows = []
    for n, body in frame.loc[frame["kind"] == TEXT, ["n", "body"]].itertuples(index=False):
        arrays, text = unpacked(n, body)
        text, at = text.tobytes(), 0
        for item, key, extra, size, mark in zip(*[x.tolist() for x in arrays], strict=True):
            whole, others = text[at : at + size], text[at + size : at + size + extra]
            at += size + extra
            cut = [] if mark & 1 else spans.get((item, key), [])
            edges = [0, *(x for pair in cut for x in pair), size]
            rest = b"".join(whole[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if cut else whole
            left = None if mark & 2 else rest.decode("utf-8", "ignore" if cut else "surrogatepass")
            digest = hashlib.sha256(rest).hexdigest()
            rows.append((None if mark & 1 else item, left, cut, size, size - len(rest), len(cut), digest, others.decode()))
    out = pd.DataFrame(rows, columns=[x.split()[0] for x in LEFT.split(", ")])
    out["id"] = out["id"].astype("Int64")
    return out


def _key():
    return text_key(F.col("content")).bitwiseAND(F.lit(0xFFFFFFFF))


def without_repeats(
    messages: DataFrame,
    id_column: str = "id",
    content: str = "content",
    length: int = LENGTH,
    others: list[str] | None = None,
) -> DataFrame:
    """Each message without the bytes that a message with a smaller id has already.

    Removed is every byte covered by a string of ``length`` (24 or more) UTF-8 bytes that
    also starts in a message with a smaller id; strings may overlap, never cross messages
    and are judged on the input. Returns id, content (what is left; of a character
    that is cut, nothing stays), spans (start and end in bytes), n_bytes, n_removed,
    n_spans, kept_sha256 (of the bytes left) and the struct others of the columns
    named in ``others``, unchanged.

    A null text counts as empty and stays null; a row without id is neither compared
    nor cut; rows that repeat an id are compared with other ids only and keep their
    place each; an empty table gives no rows.
    """
    if length < 2 * GRAM:
        raise ValueError("length must be at least twice the gram")
    # One named field keeps the struct from being empty.
    carried = F.struct(F.lit(0).alias("spanledger_row"), *[messages[c] for c in others or []])
    docs = in_small_batches(messages).select(
        messages[id_column].cast("long").alias("id"), messages[content].cast("string").alias("content"),
        carried.alias("carried"),
    )
    kind = docs.schema["carried"].dataType
    docs = docs.withColumn("key", _key()).withColumn("others", F.to_json("carried")).drop("carried")
    total = docs.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    blocks = max(16, int(total // BLOCK_TEXT) + 1)
    long_enough = docs.drop("others").where(F.col("id").isNotNull() & (F.octet_length("content") >= length))
    # fmt: off
    pieces = long_enough.mapInPandas(released(lambda frames: _cut(frames, length, blocks)), PACKED)
    ranges = pieces.groupBy("block").applyInPandas(lambda frame: _resolve(frame, length, blocks), PACKED)
    shelved = docs.mapInPandas(released(lambda frames: _shelve(frames, blocks)), PACKED)
    # fmt: on
    return ranges.unionByName(shelved).groupBy("block").applyInPandas(_gather, LEFT).withColumn(
        "others", F.from_json("others", kind).dropFields("spanledger_row") if others else F.lit(None)
    )
