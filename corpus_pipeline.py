"""The corpus pipeline: documents to training sequences in five stages.

Each stage takes the documents that its predecessor kept, written as Parquet and read
again, and applies one operator of ``spanledger.llm`` to all of them. All but the last
return the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanledger.llm.leaks import find_cases
from spanledger.llm.near_copies import near_copies
from spanledger.llm.packing import pack_messages
from spanledger.llm.passages import without_repeats
from spanledger.llm.quality import judge_messages
from spanledger.llm.rows import text_key
from spanledger.session import checkpoint_root, tune


def _kept(docs: DataFrame, verdict: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``doc_id`` and text are in ``verdict`` (doc_id, key).

    A null id matches a null id. Both sides are large, so the join shuffles at every size.
    """
    wanted = verdict.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct().hint("merge")
    same = docs["doc_id"].eqNullSafe(wanted["_id"]) & (text_key(docs["text"]) == wanted["_key"])
    return docs.join(wanted, same, "left_semi")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules take for good."""
    judged = judge_messages(docs, "doc_id", "text")
    return _kept(docs, judged.where("kept").select(F.col("id").alias("doc_id"), "key"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies."""
    found = near_copies(docs, "doc_id", "text")
    return _kept(docs, found.where("kept").select(F.col("id").alias("doc_id"), "key"))


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that one of a smaller id has already."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    left = without_repeats(docs, "doc_id", "text", others=rest)

    def column(name: str):
        if name == "n_chars":
            same = F.col("others.n_chars")
            return F.when(F.col("n_removed") > 0, F.length("content").cast(docs.schema[name].dataType)).otherwise(same)
        return F.col({"doc_id": "id", "text": "content"}.get(name, f"others.`{name}`"))

    return left.select(*[column(c).alias(c) for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    cases = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = find_cases(docs, cases, "doc_id", "text", "item_id", "text")
    return _kept(docs, found.where("NOT contaminated").select(F.col("id").alias("doc_id"), "key"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in sequences of 2048."""
    packed = pack_messages(docs, public_tokenizers.path("byte_bpe_50k.json"), "doc_id", "text")
    return packed.withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("passage_dedup", passage_dedup),
    ("decontaminate", decontaminate),
    ("packing", packing),
]

#: Suffix sorting, MinHash and token packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the last one's rows."""
    tune(spark)
    root = f"{checkpoint_root(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
