"""Phrases of message texts whose words stand together more often than apart.

Phrases are counted in counting quotient filters. A phrase of up to three words is a
number, the ids of its words side by side; an invertible permutation scatters these
numbers evenly. The leading bits of the permuted number name a shard and a quotient,
all others are kept as the remainder, so a filter is lossless: it is a sorted multiset
in which the quotient costs about two bits. Each batch of texts makes one filter for each
shard, and a shard's filters are merged in their common order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanledger.llm.rows import in_small_batches, stored
from spanledger.llm.token_batches import (
    BREAK,
    LOWER,
    SHARD_ENTRIES,
    answered,
    packed,
    token_batches,
    unpacked,
    unpacked_words,
    word_ids,
    word_shards,
)

#: Occurrences of a candidate; phrases returned for each language.
LEAST, FIRST = 10, 2000
#: A phrase goes if a longer one that holds it has this share of its occurrences, in percent.
COVERED = 50
#: Words of the longest phrase.
LONGEST = 3

#: Separators of pieces become BREAK, the tab a blank, A-Z their lower case.
_PIECES = bytearray(LOWER)
for _c in (*b".,;:!?", *range(0x0A, 0x0E)):
    _PIECES[_c] = 0xFF
_PIECES[0x09] = 0x20
_PIECES = bytes(_PIECES)


def words_and_breaks(content: bytes) -> list[bytes]:
    """Words and BREAK between pieces and at the end."""
    found = content.translate(_PIECES).replace(BREAK, b" " + BREAK + b" ").split(b" ")
    return [*(w for w in found if w), BREAK]


class Layout:
    """Widths of the parts of a permuted phrase number, the same for all filters of a run."""

    ROUNDS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))

    def __init__(self, largest_id: int, filters: int, entries: int):
        """``entries`` are expected in all of ``filters`` filters of each shard together."""
        self.word = max(1, int(largest_id).bit_length())
        self.half = -(-self.word * LONGEST // 2)
        if self.half > 63:
            raise ValueError("word ids of more than 42 bits")
        self.shard = min(self.half, max(4, (max(1, entries) // SHARD_ENTRIES).bit_length()))
        each = max(1, entries // (max(1, filters) << self.shard))
        least = 2 * self.half - self.shard - 64
        self.quotient = min(self.half - self.shard, max(each.bit_length(), least, 3))
        self.low = self.half - self.shard - self.quotient
        self.remainder = self.low + self.half

    def _round(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x + np.uint64(1)) * key
        x = (x ^ (x >> np.uint64(31))) * self.ROUNDS[1]
        return (x ^ (x >> np.uint64(29))) & np.uint64((1 << self.half) - 1)

    def permuted(self, a, b, c) -> tuple[np.ndarray, np.ndarray]:
        """Both halves of the permuted number of words a, b and c; a is 0 for two words."""
        a, b, c = (np.asarray(x).astype(np.uint64) for x in (a, b, c))
        over = np.uint64(self.half - self.word)  # so many bits of b stand in the lower half
        left = a << (np.uint64(self.word) - over) | b >> over
        right = (b & ((np.uint64(1) << over) - np.uint64(1))) << np.uint64(self.word) | c
        for key in self.ROUNDS:
            left, right = right, left ^ self._round(right, key)
        return left, right

    def words(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The inverse of ``permuted``."""
        for key in reversed(self.ROUNDS):
            left, right = right ^ self._round(left, key), left
        over, word = np.uint64(self.half - self.word), np.uint64(self.word)
        mask = (np.uint64(1) << word) - np.uint64(1)
        b = (left << over | right >> word) & mask
        return tuple(x.astype(np.int64) for x in (left >> (word - over), b, right & mask))

    def placed(self, left, right) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shard, quotient and remainder of permuted numbers."""
        low, quotient = np.uint64(self.low), np.uint64(self.quotient)
        place = left >> low
        rest = (left & ((np.uint64(1) << low) - np.uint64(1))) << np.uint64(self.half) | right
        return place >> quotient, place & ((np.uint64(1) << quotient) - np.uint64(1)), rest

    def halves(self, shard: int, quotient, rest) -> tuple[np.ndarray, np.ndarray]:
        """The inverse of ``placed``."""
        low, half = np.uint64(self.low), np.uint64(self.half)
        place = np.uint64(shard) << np.uint64(self.quotient) | quotient
        return place << low | rest >> half, rest & ((np.uint64(1) << half) - np.uint64(1))

    def in_order(self, quotient, rest) -> np.ndarray:
        """Places of the entries in the order of a filter."""
        if self.quotient + self.remainder <= 64:
            return np.argsort(quotient << np.uint64(self.remainder) | rest, kind="stable")
        return np.lexsort((rest, quotient))


def to_filter(layout: Layout, quotient: np.ndarray, rest: np.ndarray, counts: np.ndarray) -> bytes:
    """A counting quotient filter of entries in order.

    Bits of the occupied quotients, bits at the slots that end a quotient's run, the
    remainders in as many bytes as they need, and a byte for each counter; counters from
    255 on stand in full behind these.
    """
    occupied = np.zeros(1 << layout.quotient, np.uint8)
    occupied[quotient] = 1
    ends = np.ones(len(quotient), np.uint8)
    ends[:-1] = quotient[1:] != quotient[:-1]
    width = -(-layout.remainder // 8)
    slots = np.ascontiguousarray(rest).view(np.uint8).reshape(-1, 8)[:, :width]
    parts = (
        np.array([len(rest)], np.int64), np.packbits(occupied), np.packbits(ends), slots,
        np.minimum(counts, 255).astype(np.uint8), counts[counts >= 255].astype(np.int64),
    )
    return b"".join(p.tobytes() for p in parts)


def from_filter(layout: Layout, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quotients, remainders and counts of a filter, in its order."""
    n, at = int(np.frombuffer(data, np.int64, 1)[0]), 8
    size = -(-(1 << layout.quotient) // 8)
    occupied = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, size, at)))
    at += size
    size = -(-n // 8)
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, size, at))[:n])
    at += size
    width = -(-layout.remainder // 8)
    slots = np.zeros((n, 8), np.uint8)
    slots[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
    at += n * width
    counts = np.frombuffer(data, np.uint8, n, at).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, np.int64, -1, at + n)
    quotient = np.repeat(occupied, np.diff(ends, prepend=-1)).astype(np.uint64)
    return quotient, slots.view(np.uint64).ravel(), counts


def merged(layout: Layout, filters: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quotients, remainders and added counts of several filters, in order."""
    quotient, rest, counts = (np.concatenate(x) for x in zip(*(from_filter(layout, f) for f in filters), strict=True))
    order = layout.in_order(quotient, rest)  # merges runs, as each filter is sorted
    return added(quotient[order], rest[order], counts[order])


def added(quotient, rest, counts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries in order with the counts of equal ones added."""
    if not len(rest):
        return quotient, rest, counts
    new = np.ones(len(rest), bool)
    new[1:] = (rest[1:] != rest[:-1]) | (quotient[1:] != quotient[:-1])
    starts = np.flatnonzero(new)
    return quotient[starts], rest[starts], np.add.reduceat(counts, starts)


FILTERS = "shard long, filter binary"
PHRASES = "first long, second long, third long, a long"


def _filters(row: pa.Table, answers: pa.Table, layout: Layout) -> pa.Table:
    """A batch's filter for each shard."""
    out: dict[str, list] = {"shard": [], "filter": []}
    if row.num_rows:
        one = row.to_pylist()[0]
        said = {a["shard"]: unpacked(a["ids"], np.int64) for a in answers.to_pylist()}
        ids = answered(unpacked(one["word_shard"], np.int32), said)
        ids[0] = 0  # BREAK
        ids = ids[unpacked(one["tokens"], np.int32)]
        two = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        three = two[:-1][np.diff(two) == 1]
        a, b, c = (
            np.concatenate(x)
            for x in ((np.zeros(len(two), np.int64), ids[three]), (ids[two], ids[three + 1]), (ids[two + 1], ids[three + 2]))
        )
        left, right = layout.permuted(a, b, c)
        del a, b, c
        shard, quotient, rest = layout.placed(left, right)
        order = layout.in_order(shard << np.uint64(layout.quotient) | quotient, rest) if (
            layout.shard + layout.quotient + layout.remainder <= 64
        ) else np.lexsort((rest, quotient, shard))
        shard, quotient, rest = shard[order], quotient[order], rest[order]
        cuts = np.flatnonzero(np.diff(shard)) + 1
        for s, q, r in zip(*(np.split(x, cuts) for x in (shard, quotient, rest)), strict=True):
            if len(s):
                out["shard"].append(int(s[0]))
                out["filter"].append(to_filter(layout, *added(q, r, np.ones(len(q), np.int64))))
    return pa.Table.from_pydict(out, pa.schema([("shard", pa.int64()), ("filter", pa.binary())]))


def _phrases(table: pa.Table, layout: Layout, least: int) -> pa.Table:
    """Frequent phrases of a shard, from its merged filters."""
    shard = table["shard"][0].as_py()
    quotient, rest, counts = merged(layout, table["filter"].to_pylist())
    often = counts >= least
    words = layout.words(*layout.halves(shard, quotient[often], rest[often]))
    return pa.Table.from_pydict(dict(zip(("first", "second", "third", "a"), (*words, counts[often]), strict=True)))


def _dictionary(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("word_id", pa.int64()), ("part", pa.string()), ("word", pa.string()), ("f", pa.int64())])
    for frame in frames:
        for row in frame.to_pylist():
            columns: list[list] = [[], [], [], []]
            ids, totals = (unpacked(row[k], np.int64).tolist() for k in ("ids", "totals"))
            marked = unpacked_words(row["words"]) if ids else []
            for marked, word_id, total in zip(marked, ids, totals, strict=True):
                part, word = marked.split(BREAK, 1)
                if word != BREAK:
                    for column, value in zip(columns, (word_id, part, word, total), strict=True):
                        column.append(value)
            arrays = [
                pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()).cast(pa.string()) for c in columns[1:3]),
                pa.array(columns[3], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)


def _lean(frames: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    for frame in frames:
        for row in frame.to_pylist():
            shard = packed(word_shards(unpacked_words(row["words"]), shards).astype(np.int32))
            yield pa.RecordBatch.from_pydict({"batch": [row["batch"]], "tokens": [row["tokens"]], "word_shard": [shard]})


def phrases(
    messages: DataFrame,
    content: str = "content",
    language: str = "language",
    least: int = LEAST,
    first: int = FIRST,
    covered: int = COVERED,
) -> DataFrame:
    """The first phrases of each language: language, rank, phrase, a, l, r, n and score.

    Texts are cut into pieces at ``.,;:!?`` and line ends, pieces into words at blanks
    and tabs, with A-Z in lower case. A phrase is two or three words that follow each
    other in pieces, a the number of its occurrences, at least ``least``. Cut after a
    word, l and r are the occurrences of its two parts; of the cuts of a phrase that
    with the least score floor(1000000 * a * a / (l * r)) counts, the earlier one if
    scores are equal. A phrase goes if a longer candidate holds it and has at least
    ``covered`` percent of its occurrences. rank is by score, then a, both descending,
    then by the phrase's bytes; n is the number of words of the language.

    Counts are exact and over all texts. A null language is ``und``; a null or empty
    text has no words; very long texts are batches of their own; repeated rows count
    each; an empty table gives no rows.
    """
    rows = in_small_batches(messages).select(
        F.coalesce(messages[language].cast("string"), F.lit("und")).alias("part"),
        F.lit(None).cast("long").alias("id"), F.lit(True).alias("counted"),
        messages[content].cast("string").alias("content"),
    )
    batches = token_batches(rows, words_and_breaks, "phrase-batches")
    known, n_shards = word_ids(batches, least, "phrase-words")
    words = known.where("batch IS NULL").select("words", "ids", "totals")
    words = stored(words.mapInArrow(_dictionary, "word_id long, part string, word string, f long"), "dictionary")
    largest = words.agg(F.max("word_id")).first()[0] or 1
    sizes = batches.agg(F.count("*"), F.sum("n_tokens")).first()
    layout = Layout(largest, sizes[0], 2 * (sizes[1] or 0))

    lean = batches.mapInArrow(lambda x: _lean(x, n_shards), "batch long, tokens binary, word_shard binary")
    answers = known.where("batch IS NOT NULL").select("batch", "shard", "ids")
    filters = lean.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(
        lambda row, said: _filters(row, said, layout), FILTERS
    )
    found = stored(filters.groupBy("shard").applyInArrow(lambda t: _phrases(t, layout, least), PHRASES), "phrase-counts")
    total = batches.select(F.inline(F.arrays_zip("parts", "n_counted"))).groupBy(F.col("parts").alias("part")).agg(F.sum("n_counted").alias("n"))
    return _ranked(_scored(found, words, covered), first).join(total, "part").select(
        F.col("part").alias("language"), "rank", "phrase", "a", "l", "r", "n", "score"
    )


def _score(l: str, r: str) -> F.Column:
    wide = [f"CAST({x} AS DECIMAL(19, 0))" for x in ("a", "a", l, r)]
    return F.expr("(1000000BD * {} * {}) div ({} * {})".format(*wide))


def _scored(found: DataFrame, words: DataFrame, covered: int) -> DataFrame:
    """part, phrase, a, l, r and score of the candidates that no longer one covers."""
    pairs = found.where("first = 0").select(F.col("second").alias("x"), F.col("third").alias("y"), "a")
    triples = found.where("first > 0")

    def word(side: str, key: str, *names: str) -> DataFrame:
        return words.select(F.col("word_id").alias(key), F.col("word").alias(f"{side}_word"), F.col("f").alias(f"{side}_f"), *names)

    holds = triples.select(F.explode(F.array(F.struct("first", "second"), F.struct(F.col("second").alias("first"), F.col("third").alias("second")))).alias("p"), "a")
    holds = holds.groupBy(F.col("p.first").alias("x"), F.col("p.second").alias("y")).agg(F.max("a").alias("longer"))
    two = pairs.join(holds, ["x", "y"], "left").where(f"longer IS NULL OR 100 * longer < {covered} * a")
    two = two.join(word("x", "x", "part"), "x").join(word("y", "y"), "y").select(
        "part", F.concat_ws(" ", "x_word", "y_word").alias("phrase"), "a",
        F.col("x_f").alias("l"), F.col("y_f").alias("r"), _score("x_f", "y_f").alias("score"),
    )

    front = pairs.select(F.col("x").alias("first"), F.col("y").alias("second"), F.col("a").alias("front"))
    back = pairs.select(F.col("x").alias("second"), F.col("y").alias("third"), F.col("a").alias("back"))
    three = triples.join(front, ["first", "second"]).join(back, ["second", "third"])
    three = three.join(word("x", "first", "part"), "first").join(word("y", "second"), "second").join(word("z", "third"), "third")
    one, later = _score("x_f", "back"), _score("front", "z_f")
    cuts = [
        F.struct(one.alias("score"), F.lit(1).alias("k"), F.col("x_f").alias("l"), F.col("back").alias("r")),
        F.struct(later.alias("score"), F.lit(2).alias("k"), F.col("front").alias("l"), F.col("z_f").alias("r")),
    ]
    three = three.withColumn("cut", F.least(*cuts)).select(
        "part", F.concat_ws(" ", "x_word", "y_word", "z_word").alias("phrase"), "a", "cut.l", "cut.r", "cut.score"
    )
    return two.unionByName(three)


def _ranked(scored: DataFrame, first: int) -> DataFrame:
    """The first of each part; parts of a language choose theirs before they meet."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    slices = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = scored.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(slices)))
    near = cut.withColumn("near", F.row_number().over(Window.partitionBy("part", "slice").orderBy(*order)))
    near = near.where(F.col("near") <= first)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= first)


def oracle() -> str:
    """DuckDB SQL of the query over ``documents``."""
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH p AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({low}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
), g AS (
    SELECT lang, k, array_to_string(w[i:i+k-1], ' ') AS g
    FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k))
), f AS (SELECT lang, k, g, count(*) AS f FROM g GROUP BY ALL
), n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1
), c AS (SELECT lang, k, g, f AS a, string_split(g, ' ') AS w FROM f WHERE k > 1 AND f >= {LEAST}
), u AS (
    SELECT c.*, s.c AS cut, array_to_string(w[:s.c], ' ') AS x, array_to_string(w[s.c+1:], ' ') AS y
    FROM c, (SELECT unnest([1, 2]) AS c) s WHERE s.c < k
), v AS (
    SELECT u.*, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score
    FROM u JOIN f x ON x.lang = u.lang AND x.g = u.x JOIN f y ON y.lang = u.lang AND y.g = u.y
), b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1
), h AS (
    SELECT lang, g, max(a) AS a FROM (
        SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS g FROM c WHERE k = 3) GROUP BY 1, 2
), o AS (
    SELECT b.lang, b.g AS phrase, b.a, l, r, score::BIGINT AS score,
        row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.g) AS rank
    FROM b LEFT JOIN h ON h.lang = b.lang AND h.g = b.g WHERE h.a IS NULL OR 100 * h.a < {COVERED} * b.a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang) WHERE rank <= {FIRST}"""
