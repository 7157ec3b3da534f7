"""The corpus pipeline and its queries on small tables, against plain computations."""

import random
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
from check import rows_of
from test_llm_operators import prose, shingles, without, words_of
from tokenizers import Tokenizer

from spanledger.llm.quality import judge_messages
from spanledger.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    got, columns = rows_of(df.columns, df.collect())
    source = "pages" if name in ("op6_archives", "op8_page_text") else "documents"
    if name not in ("op2_packing", "pipeline"):
        assert sum(got.values()) == duck.execute(f"select count(*) from {source}").fetchone()[0]
    if name in ORACLES:
        cur = duck.execute(ORACLES[name])
        want, wanted_columns = rows_of([d[0] for d in cur.description], cur.fetchall())
        assert (columns, got) == (wanted_columns, want)


def test_run_equals_the_stages_by_hand(spark, tmp_path):
    rng = random.Random(12)
    cases = [(k, prose(rng, 14)) for k in range(5)]
    shared = prose(rng, 20)
    rows = []
    for k in range(60):
        text = prose(rng, rng.randrange(60, 120))
        if k % 9 == 0:
            text += " " + shared
        if k % 13 == 0:
            text += " " + rng.choice(cases)[1]
        if k % 10 == 3:
            text = " | ".join(text.split())
        rows.append((k, text))
    rows += [(100 + k, t + " once") for k, t in rows[5:12]] + [(200, rows[1][1]), (201, None), (202, ""), (None, prose(rng, 70))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string"
    docs = spark.createDataFrame([(i, t, "en", None, len(t or ""), "x") for i, t in rows], schema)
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(cases, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()

    # Stage by stage; the verdict of the first is that of its operator, tested elsewhere.
    judged = {(r.id, r.n_words) for r in judge_messages(docs, "doc_id", "text").where("kept").collect()}
    kept = [(i, t) for i, t in rows if (i, len((t or "").split())) in judged]
    assert 201 not in dict(kept) and 3 not in dict(kept)
    sets = {i: shingles(t, 5) for i, t in kept if i is not None}
    component = {}
    for i in sorted(sets):
        near = [j for j in component if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
        component[i] = min((component[j] for j in near), default=i)
    kept = [(i, t) for i, t in kept if i is None or component[i] == i]
    kept = [
        (i, bytes(b for b, c in zip(body, cut, strict=True) if not c).decode()) for i, body, cut in without(kept, 50)
    ]
    windows = {tuple(words_of(t)[k : k + 10]) for _, t in cases for k in range(5)}
    kept = [
        (i, t) for i, t in kept
        if not any(tuple(words_of(t)[k : k + 10]) in windows for k in range(len(words_of(t)) - 9))
    ]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter({i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in kept})
    got = Counter()
    for r in packed:
        got[r.doc_id] += r.length
    assert got == want and 30 < len(got) < len(rows)


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, extra map<string,int>"
    empty = spark.createDataFrame([], schema)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    text = " ".join(f"word{k}" for k in range(90))
    some = spark.createDataFrame([(1, text, "en", "s", len(text), {"a": 1}), (2, "x " + text, None, None, 7, None)], schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, str(tmp_path)).count() == 0
        some = stage(spark, some, str(tmp_path))
        assert some.dtypes == empty.dtypes
    assert [(r.doc_id, r.text, r.n_chars, r.extra) for r in some.collect()] == [(1, text, len(text), {"a": 1})]

