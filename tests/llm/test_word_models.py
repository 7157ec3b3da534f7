"""Phrases, spelling variants and backoff scores against plain computations."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanledger.llm import backoff, phrases, spelling, token_batches

#: A message with further columns whose names the operators use themselves.
MESSAGES = (
    "id long, content string, training boolean, language string, batch int, part string, tokens string, words int, "
    "word string, n int, shard int, counted int"
)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def messages(spark, rows):
    """Rows of id, content, training and language as messages of three partitions."""
    rest = (7, "p", "t", 1, "w", 2, 3, 4)
    return spark.createDataFrame([(*r, *rest) for r in rows], MESSAGES).repartition(3)


def sample(seed, n):
    rng = random.Random(seed)
    words = "pier Crack bearing DECK girder slab expansion joint spall rust".split()
    rows = []
    for k in range(n):
        some = words[: rng.randint(2, len(words))]
        text = " ".join(rng.choice(some) + rng.choice(["", "", ",", ".", "\n"]) for _ in range(rng.randint(0, 60)))
        rows.append((k, text + rng.choice(["", f" note{k}"]), k % 3 > 0, rng.choice(["en", "fr", None])))
    rows += [(n, None, True, "en"), (n + 1, "", True, None), (None, "pier crack", None, "en"), (5, "pier\t\tcrack", None, "en")]
    rows += [rows[3]] * 12 + [(n + 2, "deck slab; " * 30_000, True, "fr")]
    return rows


# Scores by a backoff model


def katz(rows, order):
    """Counts of all orders in dictionaries, probabilities by the definition."""
    kept = backoff.KEPT
    texts = [[*(t or "").translate(LOWER).split(), "\xff"] for _, t, _, _ in rows]
    learned = [x for x, (_, _, f, _) in zip(texts, rows, strict=True) if f]
    counts = [None, Counter(w for x in learned for w in x)]
    for k in range(2, order + 1):
        counts.append(Counter(tuple(y[i - k : i]) for x in learned for y in [["<", *x]] for i in range(max(k, 2), len(y) + 1)))
    total, types = sum(counts[1].values()), len(counts[1])

    def factors(found):
        n = Counter(found.values())
        return backoff.discounts([n[r] for r in range(1, kept + 2)])

    d = [None] + [factors(c) for c in counts[1:]]
    less = lambda c, k: c * (d[k][c] if c <= kept else 1)
    mass = sum(less(c, 1) for c in counts[1].values())
    divisor = total if mass < total * (1 - 1e-12) else total + 1
    contexts = [None, None]

    def p(k, before, w):
        if k == 1:
            return less(counts[1][w], 1) / divisor if counts[1][w] else (1 - mass / divisor if total else 1)
        h = before[-(k - 1) :]
        if len(h) < k - 1 or h not in contexts[k]:
            return p(k - 1, before, w)
        n, weight = contexts[k][h]
        c = counts[k].get((*h, w), 0)
        return less(c, k) / n if c else weight * p(k - 1, before, w)

    for k in range(2, order + 1):
        after = defaultdict(list)
        for g, c in counts[k].items():
            after[g[:-1]].append((g[-1], c))
        contexts.append({})
        for h, seen in after.items():
            n, m = sum(c for _, c in seen), sum(less(c, k) for _, c in seen)
            n = n if m < n * (1 - 1e-12) else n + 1
            contexts[k][h] = n, (1 - m / n) / (1 - sum(p(k - 1, h[1:], w) for w, _ in seen))
        for h in contexts[k]:  # exactly normalised over the known words and one unknown word
            assert math.isclose(sum(p(k, h, w) for w in [*counts[1], "\xff?"]), 1, rel_tol=1e-9)
    out = []
    for (item, *_), x in zip(rows, texts, strict=True):
        y = ("<", *x)
        base = sum(math.log10((counts[1][w] + 1) / (total + types + 1)) for w in x)
        score = sum(math.log10(p(order, y[:i], y[i])) for i in range(1, len(y)))
        out.append((item, len(x), sum(counts[1][w] > 0 for w in x), total, round(base, 6), round(score, 6)))
    return sorted(out, key=str)


def scored(df, order):
    rows = backoff.score_messages(df, order=order).collect()
    return sorted(
        ((r.id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in rows), key=str
    )


@pytest.mark.parametrize("order", [2, 3])
def test_scores_equal_the_definition(spark, order):
    rows = sample(order, 60)
    assert scored(messages(spark, rows), order) == katz(rows, order)


def test_scores_without_training_and_without_rows(spark):
    rows = [(1, "a b", None, "en"), (2, None, False, None)]
    assert [r[3:] for r in scored(messages(spark, rows), 2)] == [(0, 0.0, 0.0)] * 2
    assert scored(messages(spark, []), 2) == []


def test_discounts_follow_good_and_turing():
    n = [1000, 300, 140, 80, 50, 36]
    d = backoff.discounts(n)
    common = 6 * 36 / 1000
    assert math.isclose(d[1], (2 * 300 / 1000 - common) / (1 - common)) and d[0] == 1
    assert math.isclose(sum(n[r - 1] * (1 - d[r]) * r for r in range(1, 6)), n[0])  # frees the mass of types seen once
    assert (backoff.discounts([0] * 6) == 1).all()


def test_hot_context_goes_to_many_shards():
    context, word = np.array([9] * 5000), np.arange(5000)
    hot = backoff.spread_shards(context, word, np.full(5000, 10**9), 64)
    assert len(set(hot.tolist())) == 64 and np.bincount(hot).max() < 200
    assert len(set(backoff.spread_shards(context, word, np.full(5000, 50), 64).tolist())) == 1


# Phrases


def mined(rows, least, first, covered):
    single, both = defaultdict(Counter), defaultdict(Counter)
    for _, text, _, language in rows:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            single[language or "und"].update(w)
            both[language or "und"].update(tuple(w[i : i + k]) for k in (2, 3) for i in range(len(w) - k + 1))
    out = []
    for part, found in both.items():
        f = {**{(w,): c for w, c in single[part].items()}, **found}
        often = {g: a for g, a in found.items() if a >= least}
        kept = []
        for g, a in often.items():
            if len(g) == 2 and any(100 * b >= covered * a for h, b in often.items() if len(h) == 3 and g in (h[:2], h[1:])):
                continue
            score, k = min((10**6 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            kept.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        n = sum(single[part].values())
        for rank, (score, a, phrase, l, r) in enumerate(sorted(kept)[:first], 1):
            out.append((part, rank, phrase.decode(), -a, l, r, n, -score))
    return sorted(out)


@pytest.mark.parametrize(("least", "first"), [(2, 40), (10, 2000)])
def test_phrases_equal_the_definition(spark, least, first):
    rows = sample(4, 150) + [(k, f"Été à Paris {k % 7} x\x0by", True, "fr") for k in range(40)]
    got = phrases.phrases(messages(spark, rows), least=least, first=first)
    got = [(r.language, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got.collect()]
    assert sorted(got) == mined(rows, least, first, 50)


def test_phrases_of_no_messages(spark):
    assert phrases.phrases(messages(spark, [])).count() == 0
    assert phrases.phrases(messages(spark, [(1, None, None, None)])).count() == 0


@pytest.mark.parametrize("largest", [1, 7, 1000, 2**20, 2**21 + 5, 2**30 + 1, 2**41])
def test_filter_is_lossless_and_merges(largest):
    rng = random.Random(largest)
    layout = phrases.Layout(largest, 3, 3000)
    keys = [tuple(rng.randint(k > 0, largest) for k in range(3)) for _ in range(500)]
    parts = [Counter(rng.choices(keys, k=900)) for _ in range(3)]
    parts[0][keys[0]] += 1_000_000
    shards = defaultdict(list)
    for part in parts:
        a, b, c = np.array(list(part), np.int64).T
        counts = np.array(list(part.values()), np.int64)
        left, right = layout.permuted(a, b, c)
        assert all((x == y).all() for x, y in zip(layout.words(left, right), (a, b, c), strict=True))
        shard, quotient, rest = layout.placed(left, right)
        for s in set(shard.tolist()):
            at = np.flatnonzero(shard == np.uint64(s))
            at = at[layout.in_order(quotient[at], rest[at])]
            data = phrases.to_filter(layout, quotient[at], rest[at], counts[at])
            for x, y in zip(phrases.from_filter(layout, data), (quotient[at], rest[at], counts[at]), strict=True):
                assert (x == y).all()
            shards[s].append(data)
    got = Counter()
    for s, filters in shards.items():
        quotient, rest, counts = phrases.merged(layout, filters)
        words = layout.words(*layout.halves(s, quotient, rest))
        got.update(dict(zip(zip(*(w.tolist() for w in words), strict=True), counts.tolist(), strict=True)))
    assert got == sum(parts, Counter())


def test_score_is_exact_beyond_64_bits(spark):
    a, l, r = 3_037_000_499_977, 4_000_000_000_037, 5_000_000_000_053
    row = spark.createDataFrame([(a, l, r)], "a long, l long, r long").select(phrases._score("l", "r")).first()
    assert row[0] == 10**6 * a * a // (l * r)


# Spelling variants


def variants(rows, slips):
    n = Counter()
    for item, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if item is None else item}:{run}".encode())
            if slips and h % slips == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}

    def close(x, y):
        if len(x) == len(y):
            return sum(p != q for p, q in zip(x, y, strict=True)) == 1
        x, y = sorted((x, y), key=len)
        return len(y) == len(x) + 1 and any(y[:k] + y[k + 1 :] == x for k in range(len(y)))

    near = {w: [v for v in n if v != w and close(w, v)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n.get(form[w], 0)) for w in n)


def test_variants_equal_the_definition(spark):
    rng = random.Random(8)
    stems = ["bearing", "abutment", "expansion", "éléments", "bearings", "q" * 400] + ["".join(rng.choices("abcdé", k=6)) for _ in range(60)]
    words = []
    for stem in stems:
        words += [stem] * rng.choice([5, 30, 200])
        for _ in range(6):
            at, letter = rng.randrange(len(stem)), rng.choice("abcdeéÿ×")
            words += [rng.choice([stem[:at] + stem[at + 1 :], stem[:at] + letter + stem[at:], stem[:at] + letter + stem[at + 1 :]])] * rng.choice([4, 5, 7, 40])
    rng.shuffle(words)
    rows = [(k, rng.choice([" ", "-", "1"]).join(words[k * 25 : (k + 1) * 25]).title(), None, None) for k in range(len(words) // 25)]
    rows += [(None, "Bearing bearing", None, None), (3, None, None, None), (4, "", None, None), rows[0], rows[0]]
    for slips in (0, 3):
        known = spelling.message_words(messages(spark, rows), slips=slips)
        got = [tuple(r) for r in spelling.spelling_variants(known.withColumn("form", F.lit(1))).select(
            "word", F.coalesce("form", F.lit("")), "root", "n", "n_near", F.coalesce("form_n", F.lit(0))).collect()]
        assert sorted(got) == variants(rows, slips)


def test_variants_of_no_words(spark):
    assert spelling.spelling_variants(spelling.message_words(messages(spark, []))).count() == 0


def test_chain_of_forms_ends_at_its_root(spark):
    chain = [("a" * (6 + k), 5 ** (k + 1)) for k in range(9)]
    words = spark.createDataFrame([*chain, (None, 9)], "word string, n long")
    got = {r.word: (r.form, r.root) for r in spelling.spelling_variants(words).collect()}
    assert got[chain[0][0]] == (chain[1][0], chain[-1][0]) and got[chain[-1][0]] == (None, chain[-1][0])
    assert got[None] == (None, None)


@pytest.mark.parametrize("symbols", [1, 4, 9])
def test_neighbourhood_is_all_forms_one_edit_away(symbols):
    hashes = spelling._Hashes()
    every = np.arange(1, symbols + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for word in ("a", "bearing", "éàüñçß", "aaaaaa"):
            form = spelling.reduced(word, symbols)
            want = {int(hashes.of(np.delete(form, k))) for k in range(len(form))}
            want |= {int(hashes.of(np.insert(form, k, s))) for k in range(len(form) + 1) for s in every}
            want |= {int(hashes.of(np.concatenate([form[:k], [s], form[k + 1 :]]))) for k in range(len(form)) for s in every}
            assert set(hashes.neighbours(form, symbols).tolist()) == want


def test_words_travel_packed():
    words = [token_batches.BREAK, b"pier", "é".encode()]
    assert token_batches.unpacked_words(token_batches.packed_words(words)) == words
    numbers = np.array([0, 5, 2**40, 2**62])
    assert (token_batches.unpacked_ascending(token_batches.packed_ascending(numbers)) == numbers).all()
    values = np.array([0.5, 0.25, 0.5])
    assert (token_batches.unpacked_values(token_batches.packed_values(values)) == values).all()
