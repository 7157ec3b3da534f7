"""Offending words in messages, tagged by a linear-chain conditional random field.

Flags say only which messages are toxic. Words that occur in toxic messages of the
training sample far more often than in clean ones label the tokens there; a field
with two labels learns from these tokens by their words, beginnings and endings, so
it also knows unseen forms. The marginals of the forward-backward pass give the
offending places, and a logistic layer turns them into a score of the message.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanledger.llm.rows import texts

#: Messages of each kind that the field is fitted on, chosen by a hash of their id.
SAMPLE = 1500
THRESHOLD = 0.7
#: Tokens of a training piece, rounds of fitting, and step size.
PIECE, ROUNDS, RATE = 64, 25, 0.5
#: Pieces that are worked on together.
PIECES = 4096
#: A word part labels tokens if toxic messages hold it so much more often, and if among
#: all parts of the sample less than so many would do so by chance.
MIN_ODDS, BY_CHANCE = 20.0, 0.01

OUT = "id long, score double, spans array<struct<start:long,stop:long,probability:double>>"
_WORD = re.compile(r"\w+")


def parts(word: str) -> list[str]:
    """The features of a token: the word, its beginnings and its ending."""
    w = word.lower()
    return ["=" + w, *("^" + w[:n] for n in (4, 5) if len(w) >= n), "$" + w[-3:]]


@dataclass
class Tagger:
    """Weights of the field and of the logistic layer over its marginals."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    #: moves[a][b]: weight of label b after label a; 0 is clean, 1 offending.
    moves: tuple = ((0.0, 0.0), (0.0, 0.0))
    layer: tuple = (0.0, 0.0, 0.0)
    fitted: bool = False


def marginals(odds: np.ndarray, size: np.ndarray, moves) -> np.ndarray:
    """Probability of the offending label at each token of several messages.

    ``odds`` are the tokens' emission odds, message after message. All messages step
    forward together, the longest first, so that a step is one operation on those
    still running; the ratio of both labels is kept, which cannot overflow.
    """
    out = np.zeros(len(odds))
    order = np.argsort(-size, kind="stable")
    order = order[size[order] > 0]
    if not len(order):
        return out
    first = (np.cumsum(size) - size)[order]
    length = size[order]
    running = np.searchsorted(-length, -np.arange(1, length[0] + 1), "right")
    (m00, m01), (m10, m11) = np.exp(np.asarray(moves, float))
    p = np.zeros(len(order))  # share of the offending label so far; messages start clean
    for t, n in enumerate(running):
        at = first[:n] + t
        q = p[:n]
        ratio = odds[at] * (m01 + q * (m11 - m01)) / (m00 + q * (m10 - m00))
        out[at] = ratio
        p[:n] = ratio / (1.0 + ratio)
    back = np.ones(len(order))
    for t in range(len(running) - 2, -1, -1):
        n = running[t + 1]
        at = first[:n] + t
        s = odds[at + 1] * back[:n]
        back[:n] = (m10 + m11 * s) / (m00 + m01 * s)
        out[at] *= back[:n]
    return out / (1.0 + out)


def _summary(probability: np.ndarray) -> tuple[float, float]:
    """What the logistic layer sees of a message: its surest token and how many are likely."""
    if not len(probability):
        return -12.0, 0.0
    top = min(max(float(probability.max()), 6e-6), 1 - 6e-6)
    return float(np.log(top / (1 - top))), float(np.log1p((probability > 0.5).sum()))


def _layer(rows: np.ndarray, toxic: np.ndarray) -> tuple:
    """Logistic regression with a small ridge, by Newton steps."""
    x = np.column_stack([np.ones(len(rows)), rows])
    w = np.zeros(x.shape[1])
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.eye(x.shape[1])
        w += np.linalg.solve(step, x.T @ (toxic - p) - w)
    return tuple(w.tolist())


def _gradient(rows, labels, kind, moves):
    """Of some pieces: labels minus marginals of the real tokens, and observed minus expected moves."""
    n, real = len(rows), rows >= 0
    emit = np.ones((n, PIECE, 2))
    emit[:, :, 1] = np.exp(np.clip(np.where(real, kind[rows], 0.0), -30, 30))
    # Forward and backward over all pieces at once, labels 0 and 1; pieces start clean.
    alpha, beta, step = np.zeros((n, PIECE, 2)), np.ones((n, PIECE, 2)), np.exp(moves)
    for t in range(PIECE):
        a = emit[:, t] * (np.array([[1.0, 0.0]]) @ step if t == 0 else alpha[:, t - 1] @ step)
        alpha[:, t] = a / a.sum(axis=1, keepdims=True)
    for t in range(PIECE - 2, -1, -1):
        b = (emit[:, t + 1] * beta[:, t + 1]) @ step.T
        beta[:, t] = b / b.sum(axis=1, keepdims=True)
    p = alpha[:, :, 1] * beta[:, :, 1]
    p /= p + alpha[:, :, 0] * beta[:, :, 0]
    pair = alpha[:, :-1, :, None] * step * (emit * beta)[:, 1:, None, :]
    pair /= pair.sum(axis=(2, 3), keepdims=True)
    inner, y = real[:, 1:], labels.astype(int)
    seen = np.bincount((2 * y[:, :-1] + y[:, 1:])[inner], minlength=4).reshape(2, 2)
    return (labels - p)[real], seen - pair[inner].sum(axis=0)


def fit(messages: list[str], toxic: list[int]) -> Tagger:
    """A tagger from whole texts and their flags."""
    flags = np.array(toxic, int)
    if not len(flags) or flags.min() == flags.max():
        return Tagger()
    kinds: dict[str, int] = {}
    ids = [
        np.array([kinds.setdefault(m[0].lower(), len(kinds)) for m in _WORD.finditer(x)], np.int32) for x in messages
    ]
    names: dict[str, int] = {}
    features = [[names.setdefault(p, len(names)) for p in parts(w)] for w in kinds]
    # Near copies mostly agree in their smallest word hash, and count once.
    hashes = np.array([crc32(w.encode("utf-8", "surrogatepass")) for w in kinds])
    in_toxic, in_clean, groups = defaultdict(set), Counter(), set()
    for x, flag in zip(ids, flags, strict=True):
        words = np.unique(x)
        group = int(hashes[words].min()) if len(words) else -1
        seen = {f for k in words for f in features[k]}
        if flag:
            groups.add(group)
            for f in seen:
                in_toxic[f].add(group)
        else:
            in_clean.update(seen)
    in_toxic = {f: len(found) for f, found in in_toxic.items()}
    n_toxic, n_clean = len(groups), (1 - flags).sum()
    enough = np.log(len(names) / BY_CHANCE) / np.log(1 + n_clean / n_toxic)
    telling = {
        f for f, n in in_toxic.items()
        if n >= enough and n / n_toxic >= MIN_ODDS * (in_clean[f] + 0.5) / n_clean
    }
    offending = np.array([any(f in telling for f in fs) for fs in features], bool)

    # Pieces of equal length; a padded token has no feature and label 0.
    rows, labels = [], []
    for x, flag in zip(ids, flags, strict=True):
        for at in range(0, len(x), PIECE):
            part = x[at : at + PIECE]
            pad = PIECE - len(part)
            rows.append(np.append(part, np.full(pad, -1, np.int32)))
            labels.append(np.append(offending[part] & bool(flag), np.zeros(pad, bool)))
    if not rows:
        return Tagger()
    rows, labels = np.array(rows), np.array(labels)
    wide = np.full((len(features), 4), len(names), np.int32)
    for k, fs in enumerate(features):
        wide[k, : len(fs)] = fs
    weights, bias, moves = np.zeros(len(names) + 1), 0.0, np.zeros((2, 2))
    heat = [np.full(len(names) + 1, 1e-6), 1e-6, np.full((2, 2), 1e-6)]
    for _ in range(ROUNDS):
        kind = weights[wide].sum(axis=1) + bias
        by_kind, total, by_move = np.zeros(len(features)), 0.0, np.zeros((2, 2))
        for at in range(0, len(rows), PIECES):
            part = rows[at : at + PIECES]
            gap, move = _gradient(part, labels[at : at + PIECES], kind, moves)
            by_kind += np.bincount(part[part >= 0], gap, len(features))
            total += gap.sum()
            by_move += move
        by_name = np.bincount(wide.ravel(), np.repeat(by_kind, 4), len(names) + 1)
        by_name[-1] = 0.0
        for k, gradient in enumerate((by_name - 0.05 * weights, total, by_move)):
            heat[k] = heat[k] + gradient**2
            change = RATE * gradient / np.sqrt(heat[k])
            if k == 0:
                weights += change
            elif k == 1:
                bias += change
            else:
                moves = moves + change
    kept = {f: float(weights[k]) for f, k in names.items() if abs(weights[k]) > 0.02}
    tagger = Tagger(kept, float(bias), tuple(map(tuple, moves.tolist())), fitted=True)
    odds = np.exp(np.clip(weights[wide].sum(axis=1) + bias, -30, 30))
    found = []
    for x in ids:
        found.append(_summary(marginals(odds[x], np.array([len(x)]), tagger.moves)))
    tagger.layer = _layer(np.array(found), flags.astype(float))
    return tagger


def _probabilities(tagger: Tagger, tokens: list[list[str]], known: dict[str, float]) -> list[np.ndarray]:
    if len(known) > 600_000:
        known.clear()
    weights = tagger.weights
    for x in tokens:
        for w in x:
            if w not in known:
                score = tagger.bias + sum(weights.get(p, 0.0) for p in parts(w))
                known[w] = float(np.exp(np.clip(score, -30, 30)))
    size = np.array([len(x) for x in tokens], np.int64)
    odds = np.array([known[w] for x in tokens for w in x])
    found = marginals(odds, size, tagger.moves)
    return np.split(found, np.cumsum(size)[:-1]) if len(size) else []


def _spans(text: str, probability: np.ndarray) -> list[dict]:
    """Neighbouring offending tokens as one span of characters."""
    out, last = [], -2
    places = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    for k in np.flatnonzero(probability > 0.5).tolist():
        start, stop = places[k]
        if k == last + 1:
            out[-1]["stop"] = stop
            out[-1]["probability"] = max(out[-1]["probability"], float(probability[k]))
        else:
            out.append({"start": start, "stop": stop, "probability": float(probability[k])})
        last = k
    return out


def _tag(frames: Iterator[pd.DataFrame], tagger: Tagger) -> Iterator[pd.DataFrame]:
    known: dict[str, float] = {}
    for whole in frames:
        for at in range(0, len(whole), 500):
            frame = whole.iloc[at : at + 500]
            held = ["" if x is None else x for x in frame["content"]]
            found = _probabilities(tagger, [_WORD.findall(x) for x in held], known)
            rows = []
            for item, text, p in zip(frame["id"], held, found, strict=True):
                x = np.array([1.0, *_summary(p)]) @ np.array(tagger.layer)
                score = float(1 / (1 + np.exp(-np.clip(x, -30, 30)))) if tagger.fitted else 0.0
                rows.append((item, score, _spans(text, p) if tagger.fitted and (p > 0.5).any() else []))
            out = pd.DataFrame(rows, columns=["id", "score", "spans"])
            out["id"] = out["id"].astype("Int64")
            yield out


def train_tagger(
    messages: DataFrame,
    flags: DataFrame,
    id_column: str = "id",
    content: str = "content",
    toxic: str = "toxic",
    sample: int = SAMPLE,
) -> Tagger:
    """Fit a tagger on at most ``sample`` toxic and ``sample`` clean flagged messages.

    ``flags`` has the messages' id and ``toxic`` 0 or 1; rows with a null in either
    and messages without text are left out. The sample is that of the smallest id hashes, so it is the same on
    every run. Without messages of both kinds the tagger scores everything 0.
    """
    flags = flags.select(flags[id_column].cast("long").alias("id"), flags[toxic].cast("int").alias("toxic"))
    flags = flags.where("id IS NOT NULL AND toxic IN (0, 1)").distinct().withColumn("h", F.xxhash64("id"))
    chosen = flags.where("toxic = 1").orderBy("h", "id").limit(sample)
    chosen = chosen.unionAll(flags.where("toxic = 0").orderBy("h", "id").limit(sample)).drop("h")
    docs = texts(messages, id_column, content).where("content IS NOT NULL")
    rows = docs.join(F.broadcast(chosen), "id").orderBy("id", "content").collect()  # at most 2 * sample messages
    return fit([r["content"] for r in rows], [r["toxic"] for r in rows])


def tag_messages(
    messages: DataFrame, tagger: Tagger, id_column: str = "id", content: str = "content"
) -> DataFrame:
    """id, score (0 to 1), predicted (1 from ``THRESHOLD``) and spans for each message.

    A span has start and stop in characters of the whole text and its probability.
    A null or empty text has no token and the score of a message without offence; a
    null id is passed on; repeated rows are scored each; no rows give no rows.
    """
    docs = texts(messages, id_column, content)
    tagged = docs.mapInPandas(lambda frames: _tag(frames, tagger), OUT)
    return tagged.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
