"""Which messages hold passages of the test cases (benchmark decontamination).

The library's field-mapping cases are messages with a known answer; texts that repeat
them must not be used for training. Search is by Wu and Manber's multi-pattern
method over words: all windows of one length are searched together; a table of word
blocks tells how far the next possible window end lies, so most words are never
looked at; where the shift is zero, the block's bucket names the windows to try, and
a direct comparison confirms them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanledger.llm.rows import stored, text_key, texts

WINDOW = 10
BLOCK = 3
#: Words of test cases searched in one pass over the messages; more cases mean more passes.
PASS_WORDS = 1_000_000

SCHEMA = "id long, key long, n_words long, hits binary, items array<long>"

#: A-Z to a-z, and every other byte that is not of a word to a blank.
_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Runs of letters, digits and characters beyond ASCII; A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Patterns:
    """Windows of ``length`` words with their shift table and buckets."""

    def __init__(self, length: int, windows: dict[tuple[bytes, ...], set[int]]):
        self.length, self.block = length, min(BLOCK, length)
        self.free = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], dict[tuple[bytes, ...], set[int]]] = {}
        for window, items in windows.items():
            for at in range(self.free):
                block = window[at : at + self.block]
                left = length - self.block - at
                if left < self.shift.get(block, self.free):
                    self.shift[block] = left
            self.bucket.setdefault(window[-self.block :], {})[window] = items

    def search(self, words: list[bytes], hits: bytearray, found: set[int]) -> None:
        m, b, n = self.length, self.block, len(words)
        shift, free, bucket = self.shift, self.free, self.bucket
        end = m
        while end <= n:
            block = tuple(words[end - b : end])
            step = shift.get(block, free)
            if step:
                end += step
                continue
            items = bucket[block].get(tuple(words[end - m : end]))
            if items is not None:
                hits[end - m : end] = b"\1" * m
                found |= items
            end += 1


def patterns_of(cases: list[tuple[int, str | None]], window: int = WINDOW) -> list[Patterns]:
    """One table per window length: cases shorter than ``window`` are one window each."""
    by_length: dict[int, dict[tuple[bytes, ...], set[int]]] = {}
    for item, text in cases:
        words = words_of(text)
        if words:
            length = min(window, len(words))
            windows = by_length.setdefault(length, {})
            for at in range(len(words) - length + 1):
                windows.setdefault(tuple(words[at : at + length]), set()).add(item)
    return [Patterns(length, windows) for length, windows in sorted(by_length.items())]


def _search(patterns: list[Patterns], frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for item, key, text in zip(frame["id"], frame["key"], frame["content"], strict=True):
            words = words_of(text)
            hits, found = bytearray(len(words)), set()
            for p in patterns:
                p.search(words, hits, found)
            packed = np.packbits(np.frombuffer(hits, np.uint8)).tobytes() if found else None
            rows.append((item, key, len(words), packed, sorted(found)))
        out = pd.DataFrame(rows, columns=["id", "key", "n_words", "hits", "items"])
        out["id"] = out["id"].astype("Int64")
        yield out


def _judged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts and digest from the hit bits and items that all passes found."""
    for frame in frames:
        counts, n_items, digests = [], [], []
        for hits, items in zip(frame["hits"], frame["items"], strict=True):
            bits = [np.frombuffer(x, np.uint8) for x in hits if x is not None]
            counts.append(int(np.unpackbits(np.bitwise_or.reduce(bits)).sum()) if bits else 0)
            found = sorted({str(x) for x in items})
            n_items.append(len(found))
            digests.append(hashlib.sha256(",".join(found).encode()).hexdigest())
        out = frame[["id", "key", "n_words"]].copy()
        out["id"] = out["id"].astype("Int64")
        out["n_hit"], out["n_items"], out["items_sha256"] = counts, n_items, digests
        yield out


def find_cases(
    messages: DataFrame,
    cases: DataFrame,
    id_column: str = "id",
    content: str = "content",
    case_id: str = "id",
    message: str = "style1_msg",
    window: int = WINDOW,
) -> DataFrame:
    """One row for each message: id, key, n_words, n_hit, n_items, items_sha256, contaminated.

    ``cases`` are the test cases with an id and their message text. A word of a
    message is hit if it lies in any occurrence of a window of ``window``
    consecutive words of a case (a shorter case is one window). n_items counts the
    cases that occur, items_sha256 digests their ids, sorted as text and joined by
    commas. key stands for the text in joins.

    A null or empty text has no words and is clean; null or empty cases are never
    found; a null case id is left out; repeated cases with one id count once;
    repeated messages each get their row; without cases all messages are clean.

    The cases are a query set held against all messages in blocks of about
    ``PASS_WORDS`` words, one pass each; a block's size is its bound on what the
    tasks carry.
    """
    cases = texts(cases, case_id, message).where("id IS NOT NULL AND content IS NOT NULL")
    spread = _blocks(cases)
    docs = texts(messages, id_column, content).withColumn("key", text_key(F.col("content")))
    parts = []
    for block in spread or [[]]:
        patterns = patterns_of(block, window)
        # fmt: off
        parts.append(docs.mapInPandas(lambda frames, patterns=patterns: _search(patterns, frames), SCHEMA))
        # fmt: on
    if len(parts) == 1:
        merged = parts[0].withColumn("hits", F.array("hits"))
    else:
        marked = docs.sparkSession.createDataFrame([], SCHEMA)
        for part in parts:
            marked = marked.unionByName(part)
        # Rows with equal id and text are equal; their number is restored from the counts.
        merged = (
            marked.groupBy("id", "key")
            .agg(
                F.first("n_words").alias("n_words"),
                F.collect_set("hits").alias("hits"),
                F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
                (F.count("*") / len(parts)).cast("int").alias("copies"),
            )
            .withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
            .select("id", "key", "n_words", "hits", "items")
        )
    out = "id long, key long, n_words long, n_hit long, n_items long, items_sha256 string"
    return merged.mapInPandas(_judged, out).withColumn("contaminated", F.col("n_hit") > 0)


def _blocks(cases: DataFrame) -> list[list[tuple[int, str]]]:
    """The cases in blocks of about ``PASS_WORDS`` words, each fetched by itself."""
    sized = stored(cases.distinct().withColumn("size", F.length("content")), "test-cases")
    total = sized.agg(F.sum("size")).first()[0] or 0
    n = int(total // (PASS_WORDS * 6)) + 1
    if n == 1:
        return [[(r["id"], r["content"]) for r in sized.collect()]]
    split = sized.withColumn("block", F.pmod(F.xxhash64("id", "content"), F.lit(n)))
    return [
        [(r["id"], r["content"]) for r in split.where(F.col("block") == k).collect()] for k in range(n)
    ]
