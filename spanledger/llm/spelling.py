"""Spelling variants among the words of message texts.

Letters are hashed to a few symbols, so that a word has a reduced form over a small
alphabet. All forms within one edit of a reduced word are few and are generated in
full; where one of them is the reduced form of another word, the two may be one edit
apart, which the words themselves then decide. One edit of a word is one edit of its
reduced form or none, so no pair is lost.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanledger.llm.rows import in_small_batches, stored
from spanledger.llm.token_batches import LOWER

#: Letters and occurrences of a word; how many times as frequent as a variant its form is.
LETTERS, LEAST, RATIO = 6, 5, 5
#: Fewest symbols; more come with the vocabulary, see ``symbols_for``.
SYMBOLS = 4
#: Distinct words that a task holds before it hands on their counts.
HELD = 300_000

RUN = re.compile("[a-zÀ-ÿ]+")


def _counts(frames: Iterator[pa.RecordBatch], letters: int, slips: int) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def handed():
        out = pa.RecordBatch.from_pydict(
            {"word": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())}
        )
        held.clear()
        return out

    for frame in frames:
        contents = frame["content"].cast(pa.binary())
        for k, item in enumerate(frame["id"].to_pylist()):
            text = (contents[k].as_py() or b"").translate(LOWER).decode("utf-8", "replace")
            start = zlib.crc32(b":" if item is None else b"%d:" % item)
            for word, n in Counter(RUN.findall(text)).items():
                if len(word) >= letters:
                    if slips:
                        h = zlib.crc32(word.encode(), start)
                        if h % slips == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < letters:
                                continue
                    held[word] += n
            if len(held) >= HELD:
                yield handed()
    yield handed()


def message_words(
    messages: DataFrame,
    id_column: str = "id",
    content: str = "content",
    letters: int = LETTERS,
    least: int = LEAST,
    slips: int = 0,
) -> DataFrame:
    """word and n of the words of at least ``letters`` letters that occur ``least`` times.

    Words are runs of the letters A to Z and of U+00C0 to U+00FF, with A-Z in lower
    case. With ``slips``, a word of a message loses a letter where crc32 of
    ``<id>:<word>`` is divisible by it: the one at that number modulo the length; a null
    id is written as nothing. A null or empty text has no words, repeated rows count
    each, an empty table gives no rows.
    """
    rows = in_small_batches(messages).select(
        messages[id_column].cast("long").alias("id"), messages[content].cast("string").alias("content")
    )
    counted = rows.mapInArrow(lambda frames: _counts(frames, letters, slips), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def symbols_for(words: int) -> int:
    """Symbols of the reduced alphabet: a word should share its form with few others, and have few neighbours."""
    return max(SYMBOLS, math.ceil(words ** (1 / 8)))


_BASE = np.uint64(0x9E3779B97F4A7C15)


def reduced(word: str, symbols: int) -> np.ndarray:
    """The symbols 1 to ``symbols`` of the letters of a word."""
    code = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64)
    return ((code * np.uint64(0x9E3779B1) >> np.uint64(7)) % np.uint64(symbols) + np.uint64(1)).astype(np.uint64)


class _Hashes:
    """Hashes of a reduced word and of all forms one edit away, from sums over its beginning and end."""

    def __init__(self):
        self.powers = np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.powers) < n:
            more = self.powers * (self.powers[-1] * _BASE)
            self.powers = np.concatenate([self.powers, more])
        return self.powers[:n]

    def of(self, form: np.ndarray) -> np.uint64:
        # Symbol times power of its place, mixed with the length.
        return _ended(np.add.reduce(form * self.upto(len(form))), len(form))

    def neighbours(self, form: np.ndarray, symbols: int) -> np.ndarray:
        n = len(form)
        powers = self.upto(n + 1)
        terms = form * powers[:n]
        before = np.concatenate([[np.uint64(0)], np.cumsum(terms, dtype=np.uint64)])
        after = before[-1] - before
        # Beyond the edit all symbols move one place: down after a deletion, up after an insertion.
        down = np.append(np.cumsum((form[1:] * powers[: n - 1])[::-1], dtype=np.uint64)[::-1], np.uint64(0))
        deleted = _ended(before[:n] + down, n - 1)
        every = np.arange(1, symbols + 1, dtype=np.uint64)
        replaced = _ended((before[-1] - terms)[:, None] + every * powers[:n, None], n)
        inserted = _ended((before + after * _BASE)[:, None] + every * powers[:, None], n + 1)
        return np.unique(np.concatenate([deleted, replaced.ravel(), inserted.ravel()]))


def _ended(total, length: int):
    x = (np.asarray(total, np.uint64) ^ np.uint64(length)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _forms(frames: Iterator[pa.RecordBatch], symbols: int) -> Iterator[pa.RecordBatch]:
    hashes = _Hashes()
    with np.errstate(over="ignore"):
        for frame in frames:
            form = [int(hashes.of(reduced(w, symbols)).astype(np.int64)) for w in frame["word"].to_pylist()]
            yield pa.RecordBatch.from_pydict({"word": frame["word"], "n": frame["n"], "form": pa.array(form, pa.int64())})


def _neighbours(frames: Iterator[pa.RecordBatch], symbols: int) -> Iterator[pa.RecordBatch]:
    hashes = _Hashes()
    with np.errstate(over="ignore"):
        for frame in frames:
            found = [hashes.neighbours(reduced(w, symbols), symbols) for w in frame["word"].to_pylist()]
            sizes = list(map(len, found))
            for at in range(0, len(found), 200):
                own = np.repeat(frame["form"].to_numpy()[at : at + 200], sizes[at : at + 200])
                near = np.concatenate(found[at : at + 200]).view(np.int64)
                yield pa.RecordBatch.from_pydict({"form": own, "near": near})


def near_words(words: DataFrame) -> DataFrame:
    """word, n, other and other_n: words that differ by one inserted, deleted or replaced letter, each way."""
    symbols = symbols_for(words.count())
    known = stored(words.select("word", "n").mapInArrow(lambda x: _forms(x, symbols), "word string, n long, form long"), "reduced-words")
    alphabet = known.groupBy("form").agg(F.min("word").alias("word"))
    near = alphabet.select("word", "form").mapInArrow(lambda x: _neighbours(x, symbols), "form long, near long")
    # Forms that exist are joined first; only then do words meet.
    exist = known.select(F.col("form").alias("near")).distinct()
    near = near.join(exist, "near")
    others = known.select(F.col("form").alias("near"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    pairs = near.join(others, "near").join(known, "form")
    # The distance is looked at within its bound only; it counts letters, not bytes.
    return pairs.where(F.levenshtein("word", "other", 1) == 1).select("word", "n", "other", "other_n")


def spelling_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """One row for each of ``words`` (word, n): word, form, root, n, n_near and form_n.

    Near words differ by exactly one inserted, deleted or replaced letter; n_near is
    their number. form is the near word of largest n (of equal ones the first in the
    order of code points) if that n is at least ``ratio`` times the word's own, form_n its
    n. root is where the forms lead to in the end, the word itself if it has none.

    ``words`` holds each word once. Very long words have long neighbourhoods, which are
    kept as hashes; hashes choose candidates only, words decide. A null word has no near
    words and no root. An empty table gives no rows.
    """
    words = stored(words.select("word", "n"), "words")
    best = near_words(words.where("word IS NOT NULL")).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct(-F.col("other_n"), F.col("other"))).alias("best")
    )
    rows = words.join(best, "word", "left").withColumn("best_n", -F.col("best.col1"))
    has = F.col("best_n") >= ratio * F.col("n")
    rows = stored(
        rows.select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(has, F.col("best.other")).alias("form"), F.when(has, F.col("best_n")).alias("form_n"),
        ),
        "forms",
    )
    roots = _roots(rows.where("form IS NOT NULL").select("word", F.col("form").alias("root")), rows, ratio)
    return rows.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def _roots(links: DataFrame, rows: DataFrame, ratio: int) -> DataFrame:
    """Ends of chains of forms; n grows by ``ratio`` at each step, which bounds their length."""
    low, high = rows.agg(F.min("n"), F.max("n")).first()
    steps = math.log(max(1, (high or 1) / max(1, low or 1)), ratio) + 1
    links = stored(links, "roots")
    for _ in range(math.ceil(math.log2(steps)) + 1):
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = stored(links.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return links


def oracle(slips: int) -> str:
    """DuckDB SQL of the query over ``documents``."""
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH RECURSIVE t AS (
    SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
        lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), r AS (
    SELECT doc_id, r, count(*) AS n
    FROM (SELECT doc_id, unnest(regexp_extract_all({low}, '[a-z\x{{00C0}}-\x{{00FF}}]+')) AS r FROM documents) GROUP BY 1, 2
), b AS (SELECT r, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || r)) AS x FROM r WHERE length(r) >= {LETTERS}
), h AS (
    SELECT r, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
        lambda c, i: xor(c >> 8, t[(xor(c, i) & 255) + 1])), 4294967295) AS h FROM b, t
), w AS (
    SELECT CASE WHEN h % {slips} = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, sum(n)::BIGINT AS n
    FROM h GROUP BY 1 HAVING sum(n) >= {LEAST}
), v AS (SELECT word, n FROM w WHERE length(word) >= {LETTERS}
), k AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)
), e AS (
    SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM k a JOIN k b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT k.word, k.n, v.word, v.n FROM k JOIN v ON v.word = k.rest
    UNION SELECT v.word, v.n, k.word, k.n FROM k JOIN v ON v.word = k.rest
), f AS (
    SELECT word, n, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM e GROUP BY 1, 2
), g AS (
    SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= {RATIO} * v.n THEN other END AS form,
        CASE WHEN other_n >= {RATIO} * v.n THEN other_n END AS form_n FROM v LEFT JOIN f USING (word)
), c(word, root) AS (SELECT word, word FROM g UNION ALL SELECT c.word, g.form FROM c JOIN g ON g.word = c.root WHERE g.form IS NOT NULL
), z AS (SELECT c.word, c.root FROM c JOIN g ON g.word = c.root WHERE g.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM g JOIN z USING (word)"""
