"""Quality of message texts by weak supervision, in DataFrame functions only.

Each rule looks at one property of a text and votes good (1), bad (-1) or abstains
(0). How far a rule can be trusted is not given: expectation-maximisation estimates,
from the votes of all messages, the share of good texts and for each rule how often
it is right on good and on bad texts. A message is kept if its posterior probability
of being good is at least one half and it passes the fixed base limits.

Votes of all messages come in at most 3 to the power of the number of rules
patterns, so the estimate works on that bounded table of counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanledger.llm.rows import BLANKS, stored, text_key, texts

#: (rule, bad where, good where), over the counts of one text.
RULES = [
    ("symbols", "n_symbols * 20 > word_chars", "n_symbols * 100 < word_chars"),
    ("letters", "n_letters * 100 < word_chars * 92", "n_letters * 100 > word_chars * 95"),
    ("repeats", "n_repeat_words * 20 > n_words * 9", "n_repeat_words * 10 < n_words"),
    ("lines", "n_dup_lines * 2 > n_lines", "n_lines > 2 AND n_dup_lines * 10 < n_lines"),
    ("word_length", "word_chars < n_words * 3 OR word_chars > n_words * 12",
     "word_chars BETWEEN n_words * 4 AND n_words * 8"),
    ("vocabulary", "n_words >= 50 AND n_distinct_words * 5 < n_words", "n_distinct_words * 5 > n_words * 2"),
]
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
ROUNDS, START = 25, {"share": 0.9, "on_good": 0.95, "on_bad": 0.5}


def text_counts(messages: DataFrame, id_column: str = "id", content: str = "content") -> DataFrame:
    """Counts over the words (runs without blanks) and lines of each whole text.

    n_words, word_chars (code points in words), n_symbols (of ``#*$%&|<>``), n_letters
    (letters and digits), n_lines (lines with a word), n_dup_lines (of these, equal to an earlier one),
    n_repeat_words (in a three-word window that the text has twice or more) and
    n_distinct_words, all long. A null text counts as empty; repeated rows stay.
    """
    df = texts(messages, id_column, content).select(
        "id", text_key(F.col("content")).alias("key"), F.coalesce("content", F.lit("")).alias("content")
    )
    trimmed = F.btrim("content", F.lit(BLANKS))
    df = df.select(
        "id", "key",
        F.when(trimmed == "", F.array().cast("array<string>"))
        .otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
        .alias("words"),
        F.filter(F.split("content", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "").alias("lines"),
        F.length(F.regexp_replace("content", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("content", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("content", r"[^\p{L}\p{N}]+", "")).cast("long").alias("n_letters"),
    )
    df = df.select(
        "id", "key", "word_chars", "n_symbols", "n_letters",
        F.size("words").cast("long").alias("n_words"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform(
            F.slice("words", 1, F.greatest(F.size("words") - 2, F.lit(0))),
            lambda w, k: F.xxhash64(w, F.get("words", k + 1), F.get("words", k + 2)),
        ).alias("windows"),
    )
    df = df.withColumn(
        "windows",
        F.when(
            F.size(F.array_distinct("windows")) < F.size("windows"),
            F.sort_array(F.transform("windows", lambda h, k: F.struct(h.alias("h"), k.alias("k")))),
        ),
    )
    twice = F.filter(
        F.zip_with(
            "windows", F.slice("windows", 2, F.size("windows")),
            lambda a, b: F.when(a["h"] == b["h"], F.array(a["k"], b["k"])),
        ),
        lambda x: x.isNotNull(),
    )
    df = df.withColumn("windows", F.sort_array(F.array_distinct(F.flatten(twice))))
    gaps = F.zip_with("windows", F.slice("windows", 2, F.size("windows")), lambda a, b: F.least(b - a, F.lit(3)))
    covered = F.aggregate(gaps, F.lit(0), lambda n, x: n + F.coalesce(x, F.lit(3)))
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("windows")


def votes() -> list[Column]:
    return [
        F.when(F.expr(f"n_words = 0 OR ({bad})"), -1).when(F.expr(good), 1).otherwise(0).alias(f"vote_{name}")
        for name, bad, good in RULES
    ]


def _posterior(model: Column, vote: Column) -> Column:
    """Probability that a text with this array of votes is good."""

    def likelihood(side: str) -> Column:
        """Of the votes cast, where ``side`` holds each rule's chance to vote good."""
        return F.aggregate(
            F.zip_with(
                vote, model[side],
                lambda v, p: F.when(v == 1, p).when(v == -1, 1.0 - p).otherwise(F.lit(1.0)),
            ),
            F.lit(1.0), lambda a, b: a * b,
        )

    good = model["share"] * likelihood("if_good")
    return good / (good + (1.0 - model["share"]) * likelihood("if_bad"))


def _improved(model: Column, patterns: Column) -> Column:
    """One round: posteriors of all patterns, then the shares that they imply."""
    seen = F.transform(
        patterns,
        lambda p: F.struct(p["vote"].alias("vote"), p["n"].alias("n"), _posterior(model, p["vote"]).alias("good")),
    )

    def total(weight) -> Column:
        return F.aggregate(F.transform(seen, weight), F.lit(0.0), lambda a, b: a + b)

    def side(good_class: bool) -> Column:
        def mass(p):
            return p["n"] * (p["good"] if good_class else 1.0 - p["good"])

        def chance(k: int) -> Column:
            cast = total(lambda p: F.when(p["vote"][k] != 0, mass(p)).otherwise(0.0))
            for_good = total(lambda p: F.when(p["vote"][k] == 1, mass(p)).otherwise(0.0))
            return (for_good + 1.0) / (cast + 2.0)

        return F.array(*[chance(k) for k in range(len(RULES))])

    share = (total(lambda p: p["n"] * p["good"]) + 1.0) / (total(lambda p: p["n"]) + 2.0)
    return F.struct(share.alias("share"), side(True).alias("if_good"), side(False).alias("if_bad"))


def pattern_quality(voted: DataFrame) -> DataFrame:
    """The posterior of each pattern of votes in ``voted`` (columns ``vote_...``).

    At most 3 to the power of the rules' number of rows; empty if ``voted`` is.
    """
    names = [f"vote_{name}" for name, *_ in RULES]
    counted = voted.groupBy(*names).agg(F.count("*").cast("double").alias("n"))
    start = F.struct(
        F.lit(START["share"]).alias("share"),
        F.array(*[F.lit(START["on_good"])] * len(RULES)).alias("if_good"),
        F.array(*[F.lit(1.0 - START["on_bad"])] * len(RULES)).alias("if_bad"),
    )
    model = (
        counted.agg(F.sort_array(F.collect_list(F.struct(F.array(*names).alias("vote"), "n"))).alias("patterns"))
        .withColumn(
            "model",
            F.aggregate(
                F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda m, _: _improved(m, F.col("patterns"))
            ),
        )
        .select("model", F.explode("patterns").alias("p"))
    )
    return model.select(
        *[F.col("p.vote")[k].alias(name) for k, name in enumerate(names)],
        _posterior(F.col("model"), F.col("p.vote")).alias("posterior"),
    )


def judge_messages(messages: DataFrame, id_column: str = "id", content: str = "content") -> DataFrame:
    """One verdict for each row of messages.

    Returns id, key (stands for the text in joins), the counts of ``text_counts``, the vote of each rule, base_failed
    (fewer than 50 words, or over half of the words repeated), posterior and kept.
    A null or empty text has no words and fails the base; a null id is passed on;
    repeated rows each get the same verdict; an empty table gives no rows.
    """
    counted = text_counts(messages, id_column, content)
    voted = stored(counted.select("*", *votes()), "message-votes")
    quality = F.broadcast(pattern_quality(voted))  # at most 3 ** len(RULES) rows
    failed = F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words")
    return (
        voted.join(quality, [f"vote_{name}" for name, *_ in RULES])
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))
    )


def oracle(table: str = "documents", id_column: str = "doc_id", content: str = "text") -> str:
    """The verdicts of ``judge_messages`` as DuckDB SQL, rounds as a recursive query."""
    n = len(RULES)
    cast = ", ".join(
        f"CASE WHEN n_words = 0 OR ({bad}) THEN -1 WHEN {good} THEN 1 ELSE 0 END" for _, bad, good in RULES
    )

    def likelihood(side: str) -> str:
        return "*".join(
            f"(CASE p.vote[{k}] WHEN 1 THEN {side}[{k}] WHEN -1 THEN 1-{side}[{k}] ELSE 1 END)" for k in range(1, n + 1)
        )

    posterior = f"share*{likelihood('good')}/(share*{likelihood('good')}+(1-share)*{likelihood('bad')})"

    def chances(weight: str) -> str:
        return ", ".join(
            f"(coalesce(list_sum(list_transform(seen, lambda p: CASE WHEN p.vote[{k}]=1 THEN {weight} ELSE 0 END)),0)+1)"
            f"/(coalesce(list_sum(list_transform(seen, lambda p: CASE WHEN p.vote[{k}]<>0 THEN {weight} ELSE 0 END)),0)+2)"
            for k in range(1, n + 1)
        )

    return rf"""
    WITH RECURSIVE d AS (
        SELECT {id_column} AS id, coalesce({content}, '') AS t, regexp_extract_all(coalesce({content}, ''), '[^\x20\x09-\x0D]+') AS words,
            list_filter(string_split(coalesce({content}, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
        FROM {table}
    ), u AS (SELECT id, unnest(words) AS a, generate_subscripts(words, 1) AS i FROM d
    ), w AS (
        SELECT id, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM u WINDOW o AS (PARTITION BY id ORDER BY i)
    ), twice AS (
        SELECT id, i FROM w WHERE c IS NOT NULL QUALIFY count(*) OVER (PARTITION BY id, a, b, c) > 1
    ), r AS (
        SELECT id, count(DISTINCT i + k) AS n_repeat_words FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY id
    ), f AS (
        SELECT d.id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
            length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
            length(regexp_replace(t, '[^\p{{L}}\p{{N}}]+', '', 'g')) AS n_letters,
            len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
            len(list_distinct(words)) AS n_distinct_words, coalesce(n_repeat_words, 0) AS n_repeat_words
        FROM d LEFT JOIN r ON r.id = d.id
    ), v AS (SELECT *, [{cast}] AS vote FROM f
    ), counted AS (SELECT vote, count(*)::DOUBLE AS n FROM v GROUP BY vote
    ), patterns AS (SELECT list({{'vote': vote, 'n': n}} ORDER BY vote) AS pats FROM counted
    ), em AS (
        SELECT 0 AS it, {START["share"]}::DOUBLE AS share, list_value({", ".join([f"{START['on_good']}::DOUBLE"] * n)}) AS good,
            list_value({", ".join([f"{1 - START['on_bad']}::DOUBLE"] * n)}) AS bad
        UNION ALL
        SELECT it + 1, (list_sum(list_transform(seen, lambda p: p.n*p.good))+1)/(list_sum(list_transform(seen, lambda p: p.n))+2),
            list_value({chances("p.n*p.good")}), list_value({chances("p.n*(1-p.good)")})
        FROM (SELECT it, list_transform(pats, lambda p: {{'vote': p.vote, 'n': p.n, 'good': {posterior}}}) AS seen FROM em, patterns WHERE it < {ROUNDS})
    ), q AS (
        SELECT p.vote AS vote, {posterior} AS posterior FROM (SELECT unnest(pats) AS p FROM patterns), (SELECT * FROM em WHERE it = {ROUNDS})
    )
    SELECT v.id AS doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND posterior >= 0.5 AS kept
    FROM (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM v) v JOIN q ON q.vote = v.vote"""
