"""The language of messages from bit-sliced Bloom filters of character n-grams.

Each language has a Bloom filter of its most frequent n-grams. They
are stored sliced: a slot holds one bit for each language, so reading a gram's slots
and joining them by AND gives all languages that contain it at once. For each
language the hits of a text are counted, freed of the false positives to be expected
of its filter, and the largest share decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanledger.llm.rows import in_small_batches, texts

GRAM = 4
#: Messages of each language that its filter is fitted on, chosen by a hash of their id.
SAMPLE = 5000
#: A language contains a gram if it uses it at least so often as the one that uses it most.
MIN_RATE = 0.25
#: Grams of each language, slots of the filters (a power of two), slots of a gram.
GRAMS, SLOTS, HASHES = 20_000, 1 << 20, 3
MAX_LANGUAGES = 64
UNKNOWN = "und"

#: For every character whether it is a letter; signs of numbers such as fractions are none.
_LETTER = np.fromiter((chr(k).isalpha() for k in range(0x110000)), bool, 0x110000)


def _words(text: str) -> np.ndarray:
    """The text's letters in lower case as codes; whatever stands between two letters is one space."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _LETTER[codes]
    ends = np.zeros(len(codes), bool)
    ends[1:] = letter[:-1] & ~letter[1:]
    words = np.where(ends, np.uint32(32), codes)[letter | ends]
    return words[:-1] if len(words) and words[-1] == 32 else words


def grams(text: str | None) -> np.ndarray:
    """Hashes of the runs of ``GRAM`` characters in the text's letters and word bounds."""
    words = _words(text or "")
    if not len(words):
        return np.zeros(0, np.uint64)
    codes = np.pad(words.astype(np.uint64), 2, constant_values=32)
    out = np.zeros(len(codes) - GRAM + 1, np.uint64)
    for k in range(GRAM):
        out = out * np.uint64(0x100000001B3) + codes[k : k + len(out)]
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def slots(hashed: np.ndarray) -> Iterator[np.ndarray]:
    step = hashed >> np.uint64(40) | np.uint64(1)
    for k in range(HASHES):
        yield (hashed + np.uint64(k) * step) & np.uint64(SLOTS - 1)


@dataclass
class Filters:
    """Bloom filters of several languages in one array of slots, a bit for each."""

    languages: list[str] = field(default_factory=list)
    sliced: np.ndarray = field(default_factory=lambda: np.zeros(SLOTS, np.uint64))

    def add(self, language: str, hashed: np.ndarray) -> None:
        bit = np.uint64(1) << np.uint64(len(self.languages))
        self.languages.append(language)
        for at in slots(hashed):
            self.sliced[at] |= bit

    def containing(self, hashed: np.ndarray) -> np.ndarray:
        """For each gram the set of languages that contain it, as bits."""
        out = np.full(len(hashed), ~np.uint64(0))
        for at in slots(hashed):
            out &= self.sliced[at]
        return out

    def false_positives(self) -> np.ndarray:
        """The chance of each filter to claim a gram that it was never given."""
        return np.array([self._set(k) ** HASHES for k in range(len(self.languages))])

    def _set(self, k: int) -> float:
        return float((self.sliced >> np.uint64(k) & np.uint64(1)).mean())


def _decide(hashed: np.ndarray, filters: Filters, chance: np.ndarray) -> tuple[str, float]:
    if not len(hashed) or not filters.languages:
        return UNKNOWN, 0.0
    masks = filters.containing(hashed)
    kinds = range(len(filters.languages))
    hits = np.array([np.count_nonzero(masks >> np.uint64(k) & np.uint64(1)) for k in kinds])
    shares = np.clip((hits / len(hashed) - chance) / (1 - chance), 0, 1)
    best = int(np.argmax(shares))
    total = float(shares.sum())
    return filters.languages[best], float(shares[best]) / total if total else 0.0


def _identify(frames: Iterator[pd.DataFrame], filters: Filters) -> Iterator[pd.DataFrame]:
    chance = filters.false_positives()
    for frame in frames:
        found = [_decide(grams(x), filters, chance) for x in frame["content"]]
        out = pd.DataFrame(found, columns=["language", "score"])
        out.insert(0, "id", frame["id"].astype("Int64").to_numpy(object))
        out["id"] = out["id"].astype("Int64")
        yield out


def _counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How often each language has each gram, for all rows of a task."""
    held: dict[str, list[np.ndarray]] = {}
    for frame in frames:
        for language, text in zip(frame["language"], frame["content"], strict=True):
            held.setdefault(language, []).append(grams(text))
        for language, parts in held.items():
            if sum(map(len, parts)) > 1 << 22:
                yield _counts(language, parts)
                held[language] = []
    for language, parts in held.items():
        if parts:
            yield _counts(language, parts)


def _counts(language: str, parts: list[np.ndarray]) -> pd.DataFrame:
    values, n = np.unique(np.concatenate(parts), return_counts=True)
    return pd.DataFrame({"language": language, "gram": values.astype(np.int64), "n": n})


def learn_languages(
    messages: DataFrame,
    id_column: str = "id",
    content: str = "content",
    language: str = "language",
    sample: int = SAMPLE,
) -> Filters:
    """Filters from at most ``sample`` messages of each language that ``language`` names.

    Rows with a null id, text or language are left out; the sample is that of the
    smallest id hashes. At most ``MAX_LANGUAGES`` languages are possible.
    """
    rows = in_small_batches(messages).select(
        messages[id_column].cast("long").alias("id"), messages[content].cast("string").alias("content"),
        messages[language].cast("string").alias("language"),
    ).where("id IS NOT NULL AND content IS NOT NULL AND language IS NOT NULL")
    names = [r[0] for r in rows.select("language").distinct().orderBy("language").limit(MAX_LANGUAGES + 1).collect()]
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    by_hash = Window.partitionBy("language").orderBy(F.xxhash64("id"), "id")
    chosen = rows.select("id", "language", F.row_number().over(by_hash).alias("k")).where(F.col("k") <= sample)
    # At most MAX_LANGUAGES * sample ids.
    picked = rows.join(F.broadcast(chosen.select("id", "language").distinct()), ["id", "language"])
    counted = picked.select("language", "content").mapInPandas(_counted, "language string, gram long, n long")
    totals = counted.groupBy("language").agg(F.sum("n").alias("total"))
    by_count = Window.partitionBy("language").orderBy(F.desc("n"), "gram")
    top = (
        counted.groupBy("language", "gram").agg(F.sum("n").alias("n")).join(F.broadcast(totals), "language")
        .withColumn("rate", F.col("n") / F.col("total"))
        .withColumn("most", F.max("rate").over(Window.partitionBy("gram")))
        .where(F.col("rate") >= MIN_RATE * F.col("most"))
        .withColumn("k", F.row_number().over(by_count)).where(F.col("k") <= GRAMS)
    )
    found = top.select("language", "gram").toPandas()  # at most MAX_LANGUAGES * GRAMS rows
    filters = Filters()
    for name in names:
        filters.add(name, found.loc[found["language"] == name, "gram"].to_numpy().astype(np.uint64))
    return filters


def identify_language(
    messages: DataFrame, filters: Filters, id_column: str = "id", content: str = "content"
) -> DataFrame:
    """id, language and score (0 to 1, its share among all languages) of each message.

    The language is ``und`` with score 0 for a null text, one without a letter, and
    where no language was learned; ties go to the language first in the alphabet. A
    null id is passed on, repeated rows are decided each, no rows give no rows.
    """
    docs = texts(messages, id_column, content)
    return docs.mapInPandas(lambda frames: _identify(frames, filters), "id long, language string, score double")
