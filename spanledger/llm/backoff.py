"""How likely message texts are, by a Katz backoff model that is learned from some of them.

Counts of word sequences are discounted by Good and Turing's estimate; what that frees
after a context goes to the words not seen after it, in proportion to their probability
after the context without its first word. The backoff weights make the probabilities
after every context sum to one over the known words and one unknown word.

Each order is a stored table in shards of its contexts, a frequent context over several
shards. A batch of texts asks for the sequences that occur in it; from the answers it
evaluates its tokens, order by order.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanledger.llm.rows import in_small_batches, stored
from spanledger.llm.token_batches import (
    BREAK,
    FIRST_ID,
    LOWER,
    SHARD_ENTRIES,
    START,
    UNKNOWN,
    answered,
    in_shards,
    packed,
    packed_ascending,
    packed_values,
    shards_for,
    token_batches,
    unpacked,
    unpacked_ascending,
    unpacked_values,
    unpacked_words,
    word_ids,
    word_shards,
)

#: Highest order; counts above ``KEPT`` are not discounted.
ORDER, KEPT = 2, 5

LEAN = "batch long, ids array<long>, counted array<boolean>, lengths array<int>, tokens binary, word_shard binary"
ANSWER = "level int, kind string, shard long, batch long, x binary, y binary"
ASKED = "shard long, batch long, context binary, word binary, n binary, lower binary"
SCORED = "id long, training boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def words_and_end(content: bytes) -> list[bytes]:
    """Words without blanks, A-Z in lower case, and the end of the text."""
    return [*content.translate(LOWER).split(), BREAK]


def discounts(n: list[int]) -> np.ndarray:
    """Factor of each count 0 to ``KEPT`` from n, the number of types seen 1 to ``KEPT`` + 1 times.

    Where the estimate isn't between 0 and 1, as few or no types have a count, the count stays as it is.
    """
    out = np.ones(KEPT + 1)
    if n[0]:
        common = (KEPT + 1) * n[KEPT] / n[0]
        for r in range(1, KEPT + 1):
            if n[r - 1] and common < 1:
                d = ((r + 1) * n[r] / (r * n[r - 1]) - common) / (1 - common)
                if 0 < d < 1:
                    out[r] = d
    return out


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.where(c <= KEPT, d[np.minimum(c, KEPT)], 1.0) * c


def scale(total, kept):
    """What counts after a context are divided by: one more where nothing was discounted, so that some mass is free."""
    return np.where(kept >= total * (1 - 1e-12), total + 1, total)


class Unigrams:
    """Probabilities of single tokens: known words by their count, all unknown ones together what is left."""

    def __init__(self, tokens: int, types: int, n: list[int], kept: list[int], texts: int):
        self.tokens, self.types, self.texts, self.d = tokens, types, texts, discounts(n)
        total = discounted(np.arange(1, KEPT + 1), self.d) @ np.array(n[:KEPT], float) + (tokens - kept[0])
        self.scale = float(scale(tokens, total)) if tokens else 1.0
        self.unknown = 1 - total / self.scale if tokens else 1.0

    def __call__(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, discounted(c, self.d) / self.scale, self.unknown)


class Chain:
    """The tokens of one batch with what the answers so far say of them."""

    def __init__(self, row: dict, answers: dict, unigrams: Unigrams, shards: list[int]):
        self.shards, self.unigrams, self.answers = shards, unigrams, answers
        self.tokens = unpacked(row["tokens"], np.int32)
        self.lengths = np.array(row["lengths"], np.int64)
        self.counted = np.repeat(np.array(row["counted"], bool), self.lengths)
        self.first = np.zeros(len(self.tokens), bool)
        self.first[np.cumsum(self.lengths) - self.lengths] = True
        self.word_shard = unpacked(row["word_shard"], np.int32)
        ids, totals = (answered(self.word_shard, {s: a[k] for s, a in answers[1, "type"].items()}) for k in (0, 1))
        self.word, self.count = ids[self.tokens], totals[self.tokens]
        self.p = unigrams(self.count)
        self.gram, self.n = self.word, self.count
        self.level = 1
        self.asked = self.word_shard, self.tokens

    def step(self) -> None:
        """Contexts and types of the next order."""
        self.level += 1
        self.context = np.concatenate([[0], self.gram[:-1]])
        self.followed = np.concatenate([[0], self.n[:-1]])
        self.context[self.first] = START if self.level == 2 else UNKNOWN
        self.followed[self.first] = self.unigrams.texts if self.level == 2 else 0
        at = np.flatnonzero((self.context != UNKNOWN) & (self.word != UNKNOWN) & (self.followed > 0))
        contexts, own = np.unique(self.context[at], return_inverse=True)
        wide = int(self.tokens.max(initial=0)) + 1
        _, some, self.of = np.unique(own * wide + self.tokens[at], return_index=True, return_inverse=True)
        self.at, self.some = at, at[some]
        self.type_shard = spread_shards(
            self.context[self.some], self.word[self.some], self.followed[self.some], self.shards[self.level - 1]
        )

    def questions(self) -> Iterator[tuple[int, np.ndarray]]:
        """Shards and the places of their types in ``some``, in order of word and context."""
        for shard, places in in_shards(self.type_shard):
            chosen = self.some[places]
            yield shard, places[np.lexsort((self.context[chosen], self.word[chosen]))]

    def heard(self, d: np.ndarray, start: tuple[float, float]) -> None:
        """Probabilities of this order, from the answers on its types and contexts."""
        got, grams = np.zeros(len(self.some), np.int64), np.zeros(len(self.some), np.int64)
        found = self.answers.get((self.level, "type"), {})
        for shard, places in self.questions():
            got[places], grams[places] = found[shard]
        n, gram = np.zeros(len(self.tokens), np.int64), np.zeros(len(self.tokens), np.int64)
        n[self.at], gram[self.at] = got[self.of], grams[self.of]

        # Answers on contexts stand in the order of the types of the order below.
        shard, of = self.asked
        below = self.answers.get((self.level, "context"), {})
        weight, more = (answered(shard, {s: a[k] for s, a in below.items()}, float)[of] for k in (0, 1))
        if self.level > 2:
            fill = np.zeros((2, len(self.tokens)))
            fill[:, self.asked_at] = weight, more
            weight, more = fill
        weight, more = (np.concatenate([[0], x[:-1]]) for x in (weight, more))
        weight[self.first], more[self.first] = start if self.level == 2 else (0, 0)
        # A context of training is followed as often as it occurs; more is 1 above what its divisor adds to that.
        with np.errstate(divide="ignore", invalid="ignore"):
            seen = discounted(n, d) / (self.followed + more - 1)
        self.p = np.where(n > 0, seen, np.where(more > 0, weight, 1.0) * self.p)
        self.gram, self.n, self.asked_at = gram, n, self.at
        # Within a shard the types were asked in order of word and context.
        order = np.concatenate([places for _, places in self.questions()]) if len(self.some) else np.zeros(0, int)
        turn = np.empty(len(order), int)
        turn[order] = np.arange(len(order))
        self.asked = self.type_shard[order], turn[self.of]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def spread_shards(context: np.ndarray, word: np.ndarray, followed: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each type: one for a rare context, more for one that ``followed`` makes too large for one."""
    places = np.minimum(followed * 4 // SHARD_ENTRIES + 1, shards).astype(np.uint64)
    return ((_mixed(context) + _mixed(word) % places) % np.uint64(shards)).astype(np.int64)


def _chain(row: pa.Table, answers: pa.Table, unigrams, shards, heard: list) -> tuple[dict, Chain]:
    one = row.to_pylist()[0]
    said: dict = {}
    for a in answers.to_pylist():
        kind = float if a["kind"] == "context" else np.int64
        both = tuple(unpacked(a[k], kind) if a[k] is not None else None for k in ("x", "y"))
        said.setdefault((a["level"], a["kind"]), {})[a["shard"]] = both
    chain = Chain(one, said, unigrams, shards)
    for d, start in heard:
        chain.step()
        chain.heard(d, start)
    return one, chain


def _ask(row: pa.Table, answers: pa.Table, unigrams, shards, heard) -> pa.Table:
    """Questions of a batch on the types of the next order."""
    names = ("shard", "batch", "context", "word", "n", "lower")
    out: dict[str, list] = {k: [] for k in names}
    if row.num_rows:
        one, chain = _chain(row, answers, unigrams, shards, heard)
        chain.step()
        n = np.bincount(chain.of, weights=chain.counted[chain.at], minlength=len(chain.some)).astype(np.int64)
        for shard, places in chain.questions():
            chosen = chain.some[places]
            asked = (
                shard, one["batch"], packed(chain.context[chosen]), packed_ascending(chain.word[chosen]), packed(n[places]),
                packed(chain.count[chosen]) if chain.level == 2 else packed_values(chain.p[chosen]),
            )
            for name, value in zip(names, asked, strict=True):
                out[name].append(value)
    kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 4]
    return pa.Table.from_pydict(out, pa.schema(list(zip(names, kinds, strict=True))))


_TABLE = [("shard", pa.int64()), ("batch", pa.int64()), *[(k, pa.binary()) for k in ("x", "y", "context", "word", "lower")]]
COUNTED = "shard long, batch long, x binary, y binary, context binary, word binary, lower binary"


def _count(table: pa.Table, shards: int, level: int, last: bool) -> pa.Table:
    """Counts (x) and ids (y) of a shard's types: answers to the batches, and the seen ones as a row without batch."""
    rows = table.to_pylist()
    each = [unpacked(r["n"], np.int64) for r in rows]
    context = np.concatenate([unpacked(r["context"], np.int64) for r in rows])
    word = np.concatenate([unpacked_ascending(r["word"]) for r in rows])
    # A word stands for its probability by its count.
    lower = np.concatenate([(unpacked(r["lower"], np.int64) if level == 2 else unpacked_values(r["lower"])) for r in rows])
    n, sizes = np.concatenate(each), list(map(len, each))
    order = np.lexsort((word, context))
    starts = np.ones(len(order), bool)
    starts[1:] = (context[order][1:] != context[order][:-1]) | (word[order][1:] != word[order][:-1])
    type_ = np.empty(len(order), int)
    type_[order] = np.cumsum(starts) - 1
    total = np.zeros(int(starts.sum()), np.int64)
    np.add.at(total, type_, n)
    some = order[starts]
    shard = rows[0]["shard"]
    # Only a further order asks for the ids.
    ids = np.where((total > 0) & (not last), (np.cumsum(total > 0) - 1) * shards + shard + FIRST_ID, UNKNOWN)
    out: dict[str, list] = {k: [] for k, _ in _TABLE}

    def add(*values):
        for name, value in zip(out, values, strict=True):
            out[name].append(value)

    for row, of in zip(rows, np.split(type_, np.cumsum(sizes)[:-1]), strict=True):
        add(shard, row["batch"], packed(total[of]), packed(ids[of]), None, None, None)
    seen = total > 0
    some = some[seen]
    add(
        shard, None, packed(total[seen]), packed(ids[seen]), packed_ascending(context[some]), packed(word[some]),
        packed(lower[some]) if level == 2 else packed_values(lower[some]),
    )
    return pa.Table.from_pydict(out, pa.schema(_TABLE))


def _low_counts(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many types have each count up to ``KEPT`` + 1."""
    for frame in frames:
        for x in frame["x"].to_pylist():
            n = np.bincount(np.minimum(unpacked(x, np.int64), KEPT + 2), minlength=KEPT + 2)[1 : KEPT + 2]
            yield pa.RecordBatch.from_pydict({"r": np.arange(1, KEPT + 2), "n": n})


_SUMS = ["context", "total", "kept", "lower"]
SUMS = "shard long, batch long, context binary, total binary, kept binary, lower binary, ids binary"


def _sums(frames: Iterator[pa.RecordBatch], d: np.ndarray, below: int, level: int, unigrams: Unigrams) -> Iterator[pa.RecordBatch]:
    """Sums over the seen types of each context, for the shard of the context in the order below."""
    schema = pa.schema([("shard", pa.int64()), ("batch", pa.int64()), *[(k, pa.binary()) for k in (*_SUMS, "ids")]])
    for frame in frames:
        for row in frame.to_pylist():
            c, context = unpacked(row["x"], np.int64), unpacked_ascending(row["context"])
            if not len(c):
                continue
            contexts, starts = np.unique(context, return_index=True)  # in order of context already
            lower = unigrams(unpacked(row["lower"], np.int64)) if level == 2 else unpacked_values(row["lower"])
            columns = [np.add.reduceat(x, starts) for x in (c, discounted(c, d), lower)]
            out: dict[str, list] = {k: [] for k in schema.names}
            for shard, places in in_shards((contexts - FIRST_ID) % below):
                out["shard"].append(shard)
                out["batch"].append(None)
                out["ids"].append(None)
                for name, x in zip(_SUMS, (contexts, *columns), strict=True):
                    out[name].append(packed(x[places]))
            yield pa.RecordBatch.from_pydict(out, schema)


def _weights(total, kept, lower) -> tuple[np.ndarray, np.ndarray]:
    """Backoff weight of contexts by the sums over what was seen after them, and 1 above what the divisor adds to the total."""
    divisor = scale(total, kept)
    free = np.maximum(1 - lower, np.finfo(float).tiny)
    return (1 - kept / divisor) / free, divisor - total + 1.0


def _tell(table: pa.Table, level: int) -> pa.Table:
    """What ``_weights`` gives (x, y) of the contexts that batches asked for; 0 where a context was never seen."""
    rows = table.to_pylist()
    sums = [r for r in rows if r["batch"] is None]
    out: dict[str, list] = {k: [] for k in ("level", "kind", "shard", "batch", "x", "y")}
    if sums:
        context, total = (np.concatenate([unpacked(r[k], np.int64) for r in sums]) for k in ("context", "total"))
        kept, lower = (np.concatenate([unpacked(r[k], float) for r in sums]) for k in ("kept", "lower"))
        contexts, of = np.unique(context, return_inverse=True)
        sums = [np.bincount(of, weights=x, minlength=len(contexts)) for x in (total, kept, lower)]
        weight, more = _weights(*sums)
    else:
        contexts, weight, more = np.array([-1]), np.zeros(1), np.zeros(1)
    for row in rows:
        if row["batch"] is None:
            continue
        ids = unpacked(row["ids"], np.int64)
        at = np.minimum(np.searchsorted(contexts, ids), len(contexts) - 1)
        known = contexts[at] == ids
        values = (level, "context", row["shard"], row["batch"], packed(weight[at] * known), packed(more[at] * known))
        for name, value in zip(out, values, strict=True):
            out[name].append(value)
    kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return pa.Table.from_pydict(out, pa.schema(list(zip(out, kinds, strict=True))))


def _counted(asked: DataFrame, shards: int, level: int, last: bool) -> DataFrame:
    return asked.groupBy("shard").applyInArrow(lambda table: _count(table, shards, level, last), COUNTED)


def _told(both: DataFrame, level: int) -> DataFrame:
    return both.groupBy("shard").applyInArrow(lambda table: _tell(table, level), ANSWER)


def _score(row: pa.Table, answers: pa.Table, unigrams, shards, heard) -> pa.Table:
    schema = pa.schema(
        [("id", pa.int64()), ("training", pa.bool_()), *[(k, pa.int64()) for k in ("n_tokens", "n_known", "train_tokens")],
         ("base_score", pa.float64()), ("score", pa.float64())]
    )
    if not row.num_rows:
        return schema.empty_table()
    one, chain = _chain(row, answers, unigrams, shards, heard)
    starts = np.cumsum(chain.lengths) - chain.lengths
    base = np.log10((chain.count + 1) / (unigrams.tokens + 1 * (unigrams.types + 1)))
    add = lambda x: np.add.reduceat(x, starts)
    return pa.Table.from_pydict(
        {
            "id": one["ids"], "training": one["counted"], "n_tokens": chain.lengths,
            "n_known": add((chain.count > 0).astype(np.int64)), "train_tokens": np.full(len(starts), unigrams.tokens),
            "base_score": add(base), "score": add(np.log10(chain.p)),
        },
        schema,
    )


def _lean(frames: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """Batches with the shards of their words instead of the words."""
    for frame in frames:
        for row in frame.to_pylist():
            shard = word_shards(unpacked_words(row["words"]), shards).astype(np.int32)
            out = {k: [row[k]] for k in ("batch", "ids", "counted", "lengths", "tokens")}
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            out["word_shard"] = [packed(shard)]
            yield pa.RecordBatch.from_pydict(out, pa.schema(list(zip(out, kinds, strict=True))))


def _unigrams(known: DataFrame, texts: int) -> Unigrams:
    found = known.where("batch IS NULL").select(F.col("totals").alias("x"))

    def sums(frames):
        for frame in frames:
            for x in frame["x"].to_pylist():
                c = unpacked(x, np.int64)
                low = np.bincount(np.minimum(c, KEPT + 2), minlength=KEPT + 2)[1 : KEPT + 2]
                yield pa.RecordBatch.from_pydict({"tokens": [int(c.sum())], "types": [len(c)], "n": [low.tolist()]})

    sized = found.mapInArrow(sums, "tokens long, types long, n array<long>")
    counts = [F.coalesce(F.sum(F.col("n")[k]), F.lit(0)) for k in range(KEPT + 1)]
    tokens, types, *n = sized.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0)), *counts).first()
    kept = [sum((r + 1) * n[r] for r in range(KEPT))]
    return Unigrams(tokens, types, list(n), kept, texts)


def score_messages(
    messages: DataFrame,
    id_column: str = "id",
    content: str = "content",
    training: str = "training",
    order: int = ORDER,
) -> DataFrame:
    """One row for each message: id, training, n_tokens, n_known, train_tokens, base_score and score.

    Messages whose ``training`` is true are learned from, all are scored. Tokens are the
    runs without blanks of the text, A-Z in lower case, and one end. score is the sum of
    log10 of the tokens' probabilities by the model of ``order`` words; n_known counts
    the tokens seen in training, train_tokens all tokens of training, base_score adds
    one to every count instead.

    The first token has the text's beginning as its context, shorter contexts are used
    where a longer one was never seen. A null or empty text has its end only; a null
    training means false. Very long texts are batches of their own, rows that repeat an
    id are scored one by one, equal texts equally. Without training messages score and
    base_score are 0; an empty table gives no rows. All counts are exact.
    """
    rows = in_small_batches(messages).select(
        F.lit("").alias("part"),
        messages[id_column].cast("long").alias("id"),
        F.coalesce(messages[training], F.lit(False)).alias("counted"),
        messages[content].cast("string").alias("content"),
    )
    batches = token_batches(rows, words_and_end, "token-batches")
    known, n_shards = word_ids(batches, 1, "known-words")
    n_texts = batches.agg(F.sum(F.size(F.filter("counted", lambda x: x)))).first()[0] or 0
    unigrams = _unigrams(known, n_texts)
    lean = batches.mapInArrow(partial(_lean, shards=n_shards), LEAN)

    n_tokens = batches.agg(F.sum("n_tokens")).first()[0] or 0
    shards, heard = [n_shards], []
    of_batch = F.col("batch").isNotNull()
    answers = known.where(of_batch).select(
        F.lit(1).alias("level"), F.lit("type").alias("kind"), "shard", "batch", F.col("ids").alias("x"), F.col("totals").alias("y")
    )
    below = answers.select("shard", "batch", F.col("x").alias("ids"))

    def cogrouped(make, schema):
        given = unigrams, list(shards), list(heard)
        both = lean.groupBy("batch").cogroup(answers.groupBy("batch"))
        return both.applyInArrow(lambda row, said: make(row, said, *given), schema)

    for level in range(2, order + 1):
        shards.append(shards_for(n_tokens))
        asked = cogrouped(_ask, ASKED)
        counted = stored(_counted(asked, shards[-1], level, level == order), "counted-grams")
        table = counted.where("batch IS NULL")
        low = dict(table.select("x").mapInArrow(_low_counts, "r long, n long").groupBy("r").agg(F.sum("n")).collect())
        d = discounts([low.get(r, 0) for r in range(1, KEPT + 2)])
        sums = stored(table.select("x", "context", "lower").mapInArrow(partial(_sums, d=d, below=shards[-2], level=level, unigrams=unigrams), SUMS), "contexts")

        nothing = [F.lit(None).cast("binary").alias(k) for k in _SUMS]
        both = sums.unionByName(below.select("shard", "batch", *nothing, "ids"))
        told = stored(_told(both, level), "weights")
        start = (0.0, 0.0)
        if level == 2:
            start = _start(sums, shards[-2])
        heard.append((d, start))
        own = counted.where(of_batch).select(F.lit(level).alias("level"), F.lit("type").alias("kind"), "shard", "batch", "x", "y")
        answers = answers.unionByName(own).unionByName(told)
        below = own.select("shard", "batch", F.col("y").alias("ids"))
    return cogrouped(_score, SCORED)


def _start(sums: DataFrame, below: int) -> tuple[float, float]:
    """What ``_weights`` gives for the place before a text: at most one row of sums for each shard of types."""

    def of_start(frames):
        for frame in frames:
            for row in frame.to_pylist():
                at = np.flatnonzero(unpacked(row["context"], np.int64) == START)
                if len(at):
                    values = [unpacked(row[k], kind)[at[0]] for k, kind in (("total", np.int64), ("kept", float), ("lower", float))]
                    yield pa.RecordBatch.from_pydict({k: [float(v)] for k, v in zip(_SUMS[1:], values, strict=True)})

    found = sums.where(F.col("shard") == (START - FIRST_ID) % below).mapInArrow(of_start, "total double, kept double, lower double")
    total, kept, lower = found.agg(*[F.sum(k) for k in _SUMS[1:]]).first()
    if not total:
        return 0.0, 0.0
    weight, more = _weights(np.array([total]), np.array([kept]), np.array([lower]))
    return float(weight[0]), float(more[0])
