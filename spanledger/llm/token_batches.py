"""Texts as numbers: batches of local word numbers, and word ids that all batches share.

A batch holds some megabytes of texts as numbers into its own list of words. Batches
learn what is known of their words, or of pairs of these, by asking: a question goes
to the shard of its key, the shard adds up what all batches say of the key, and the
answer returns in the order of the question. A key is asked once by a batch, however
often it occurs there, so no shard grows with the occurrences of one key.
"""

from __future__ import annotations

import itertools
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanledger.llm.rows import stored

#: Bytes of text of a batch; a longer text is a batch of its own.
BATCH_BYTES = 4 << 20
#: About so many entries meet in a shard; there are at least so many shards.
SHARD_ENTRIES, LEAST_SHARDS = 1_000_000, 16
#: Stands for the end of a text or a piece: no byte of UTF-8, so never a word.
BREAK = b"\xff"
#: Ids below hold no word: unknown words, and the place before a text.
UNKNOWN, START, FIRST_ID = 0, 1, 2

LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))

BATCH = (
    "batch long, n_words long, n_tokens long, parts array<string>, n_counted array<long>, words binary, counts binary, "
    "ids array<long>, counted array<boolean>, lengths array<int>, tokens binary"
)
WORDS_ASKED = "shard long, batch long, words binary, counts binary"
WORDS_KNOWN = "shard long, batch long, ids binary, totals binary, words binary"


def packed(numbers: np.ndarray) -> bytes:
    """Whole numbers or doubles as compressed bytes, plane by plane."""
    planes = np.ascontiguousarray(numbers).view(np.uint8).reshape(len(numbers), numbers.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpacked(data: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, -1).T).view(kind).ravel()


def packed_words(words: list[bytes]) -> bytes:
    """Words, none of which holds a line end."""
    return zstandard.ZstdCompressor(level=1).compress(b"\n".join(words))


def unpacked_words(data: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(data).split(b"\n")


def packed_ascending(numbers: np.ndarray) -> bytes:
    return packed(np.diff(numbers, prepend=0))


def unpacked_ascending(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, np.int64))


def packed_values(numbers: np.ndarray) -> bytes:
    """Doubles of which many are equal: the distinct ones and places in these."""
    values, at = np.unique(numbers, return_inverse=True)
    head = packed(values)
    return len(head).to_bytes(8, "little") + head + packed(at.astype(np.int32))


def unpacked_values(data: bytes) -> np.ndarray:
    cut = 8 + int.from_bytes(data[:8], "little")
    return unpacked(data[8:cut], float)[unpacked(data[cut:], np.int32)]


class _Open:
    """A batch that still takes texts. Words of different parts have different numbers, BREAK is 0 in all."""

    def __init__(self):
        self.next = itertools.count(1).__next__
        self.words: dict[str, defaultdict] = {}
        self.texts, self.parts, self.ids, self.counted = [], [], [], []

    def add(self, part: str, item: int | None, counted: bool, words: list[bytes]) -> None:
        if part not in self.words:
            self.words[part] = defaultdict(self.next, {BREAK: 0})
        self.texts.append(np.array(list(map(self.words[part].__getitem__, words)), np.int32))
        self.parts.append(part)
        self.ids.append(item)
        self.counted.append(counted)

    def row(self, batch: int) -> dict:
        tokens = np.concatenate(self.texts)
        lengths = np.fromiter(map(len, self.texts), np.int32, len(self.texts))
        counted = tokens[np.repeat(np.array(self.counted, bool), lengths)]
        named = {0: BREAK + BREAK}
        for part, words in self.words.items():
            mark = part.encode() + BREAK
            named |= {k: mark + w for w, k in words.items() if k}
        counts = np.bincount(counted, minlength=len(named))
        n_counted = [int(counts[[k for k in words.values() if k]].sum()) for words in self.words.values()]
        return {
            "batch": batch, "n_words": len(named), "n_tokens": len(tokens), "parts": list(self.words), "n_counted": n_counted,
            "words": packed_words([named[k] for k in range(len(named))]), "counts": packed(counts), "ids": self.ids,
            "counted": self.counted, "lengths": lengths, "tokens": packed(tokens),
        }


def _batches(frames: Iterator[pa.RecordBatch], split: Callable, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    numbers = itertools.count(TaskContext.get().partitionId() << 32)
    batch, held = _Open(), 0
    for frame in frames:
        contents = frame["content"].cast(pa.binary())
        rows = zip(frame["part"].to_pylist(), frame["id"].to_pylist(), frame["counted"].to_pylist(), strict=True)
        for k, (part, item, counted) in enumerate(rows):
            content = contents[k].as_py() or b""
            batch.add(part, item, bool(counted), split(content))
            held += len(content)
            if held >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist([batch.row(next(numbers))], schema)
                batch, held = _Open(), 0
    if batch.texts:
        yield pa.RecordBatch.from_pylist([batch.row(next(numbers))], schema)


def token_batches(rows: DataFrame, split: Callable[[bytes], list[bytes]], name: str) -> DataFrame:
    """Stored batches of the texts of ``rows`` (part, id, counted, content).

    ``split`` gives the words of a text and ``BREAK`` at its end. Words of different parts
    are different: ``words`` has each as its part, BREAK and the word. ``counts`` are their
    occurrences in the texts that are counted, n_counted the sums over ``parts`` without BREAK.
    """
    schema = pa.schema(
        [
            ("batch", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64()), ("parts", pa.list_(pa.string())),
            ("n_counted", pa.list_(pa.int64())), ("words", pa.binary()), ("counts", pa.binary()), ("ids", pa.list_(pa.int64())),
            ("counted", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int32())), ("tokens", pa.binary()),
        ]
    )
    return stored(rows.mapInArrow(lambda frames: _batches(frames, split, schema), BATCH), name)


def shards_for(entries: int) -> int:
    return max(LEAST_SHARDS, -(-entries // SHARD_ENTRIES))


def word_shards(words: list[bytes], shards: int) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % shards


def in_shards(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard that occurs and the places of its entries, in their order."""
    if not len(shard):
        return
    order = np.argsort(shard, kind="stable")
    found, starts = np.unique(shard[order], return_index=True)
    yield from zip(found.tolist(), np.split(order, starts[1:]), strict=True)


_WORDS_ASKED = pa.schema([("shard", pa.int64()), ("batch", pa.int64()), ("words", pa.binary()), ("counts", pa.binary())])
_WORDS_KNOWN = pa.schema([("shard", pa.int64()), ("batch", pa.int64()), *[(k, pa.binary()) for k in ("ids", "totals", "words")]])


def _asked(frames: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    for frame in frames:
        for row in frame.to_pylist():
            words, counts = unpacked_words(row["words"]), unpacked(row["counts"], np.int64)
            out: dict[str, list] = {k: [] for k in _WORDS_ASKED.names}
            for shard, places in in_shards(word_shards(words, shards)):
                out["shard"].append(shard)
                out["batch"].append(row["batch"])
                out["words"].append(packed_words([words[k] for k in places]))
                out["counts"].append(packed(counts[places]))
            yield pa.RecordBatch.from_pydict(out, _WORDS_ASKED)


def _known(table: pa.Table, shards: int, least: int) -> pa.Table:
    """Answers to all batches, and the shard's words as a row without batch."""
    shard = table["shard"][0].as_py()
    chunks = [pa.array(unpacked_words(x.as_py()), pa.binary()) for x in table["words"]]
    counts = np.concatenate([unpacked(x.as_py(), np.int64) for x in table["counts"]])
    ends = np.cumsum(list(map(len, chunks)))[:-1]
    coded = pa.concat_arrays(chunks).dictionary_encode()
    place, words = coded.indices.to_numpy(), coded.dictionary
    totals = np.zeros(len(words), np.int64)
    np.add.at(totals, place, counts)
    order = pc.sort_indices(words).to_numpy()
    order = order[totals[order] >= least]
    ids = np.zeros(len(words), np.int64)
    ids[order] = np.arange(len(order)) * shards + shard + FIRST_ID
    answers = np.split(place, ends)
    rows = {
        "shard": [shard] * (len(answers) + 1),
        "batch": [*table["batch"].to_pylist(), None],
        "ids": [*(packed(ids[k]) for k in answers), packed(ids[order])],
        "totals": [*(packed(totals[k]) for k in answers), packed(totals[order])],
        "words": [*([None] * len(answers)), packed_words(words.take(pa.array(order)).to_pylist())],
    }
    return pa.Table.from_pydict(rows, _WORDS_KNOWN)


def word_ids(batches: DataFrame, least: int, name: str) -> tuple[DataFrame, int]:
    """What is known of the words of all batches, and the number of shards.

    Rows with a batch answer it: ids and totals of its words of that shard, in their
    order. Rows without batch are the shard's words with at least ``least`` counted
    occurrences, as the part, BREAK and the word. All other words have the id UNKNOWN.
    """
    shards = shards_for(2 * (batches.agg(F.sum("n_words")).first()[0] or 0))  # words are larger than numbers
    asked = batches.select("batch", "words", "counts")
    asked = asked.mapInArrow(lambda frames: _asked(frames, shards), WORDS_ASKED)
    known = asked.groupBy("shard").applyInArrow(lambda t: _known(t, shards, least), WORDS_KNOWN)
    return stored(known, name), shards


def answered(shard: np.ndarray, answers: dict[int, np.ndarray], kind=np.int64) -> np.ndarray:
    """Answers of all shards, put back in the order of the questions."""
    out = np.zeros(len(shard), kind)
    for at, places in in_shards(shard):
        out[places] = answers[at]
    return out
