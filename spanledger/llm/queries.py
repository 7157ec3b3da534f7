"""The operators of this folder on the given tables."""

from __future__ import annotations

import public_tokenizers
from corpus_pipeline import ORACLE_SQL, run
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanledger.llm import licences, oracles, phrases, quality, spelling
from spanledger.llm.backoff import score_messages
from spanledger.llm.language import identify_language, learn_languages
from spanledger.llm.leaks import find_cases
from spanledger.llm.near_copies import near_copies
from spanledger.llm.packing import pack_messages
from spanledger.llm.page_text import page_texts
from spanledger.llm.passages import without_repeats
from spanledger.llm.quality import judge_messages
from spanledger.llm.toxicity import tag_messages, train_tagger
from spanledger.llm.warc import archive_pages
from spanledger.session import tune

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(tune(spark), sf_dir.rstrip("/"))

    run.__name__ = fn.__name__
    QUERIES[fn.__name__] = run
    return fn


def messages_of(spark: SparkSession, folder: str) -> DataFrame:
    """``documents`` as messages: doc_id is the id, text the content."""
    return spark.read.parquet(f"{folder}/documents.parquet").select(
        F.col("doc_id").alias("id"), F.col("text").alias("content")
    )


@query
def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    judged = judge_messages(messages_of(spark, folder))
    return judged.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


ORACLES["op1_quality"] = quality.oracle()
ORACLES["op3_near_copies"] = oracles.NEAR_COPIES
ORACLES["op6_archives"] = oracles.ARCHIVES
ORACLES["op9_decontamination"] = oracles.LEAKS


@query
def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = pack_messages(messages_of(spark, folder), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.withColumnRenamed("id", "doc_id")


@query
def op3_near_copies(spark: SparkSession, folder: str) -> DataFrame:
    found = near_copies(messages_of(spark, folder), words=4, percent=80)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def fold(of: int):
    """Remainder of crc32 of the id, written as text."""
    return F.crc32(F.col("doc_id").cast("string")) % of


@query
def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    messages = messages_of(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet").where(fold(3) != 1)
    tagger = train_tagger(messages, labels.select(F.col("doc_id").alias("id"), "toxic"))
    tagged = tag_messages(messages, tagger).withColumnRenamed("id", "doc_id")
    return tagged.select("doc_id", (fold(3) == 1).alias("held_out"), "score", "predicted", "spans")


@query
def op5_language(spark: SparkSession, folder: str) -> DataFrame:
    known = spark.read.parquet(f"{folder}/documents.parquet").where(fold(4) != 2)
    filters = learn_languages(known, "doc_id", "text", "lang")
    found = identify_language(messages_of(spark, folder), filters).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", (fold(4) == 2).alias("held_out"), F.col("language").alias("lang_pred"), "score")


@query
def op6_archives(spark: SparkSession, folder: str) -> DataFrame:
    found = archive_pages(spark.read.parquet(f"{folder}/pages.parquet"))
    return found.select(
        F.col("metadata.page_id").alias("page_id"), "response.payload_bytes", "response.payload_digest",
        "response.record_type", F.col("refers_to_page").alias("refers_to"),
    )


@query
def op7_licences(spark: SparkSession, folder: str) -> DataFrame:
    found = licences.licence_findings(messages_of(spark, folder))
    return found.select(
        F.col("id").alias("doc_id"), *[F.array_join(x, ",").alias(x) for x in ("sentences", "licences", "unclaimed")]
    )


ORACLES["op7_licences"] = licences.oracle()


@query
def op8_page_text(spark: SparkSession, folder: str) -> DataFrame:
    return page_texts(spark.read.parquet(f"{folder}/pages.parquet")).select("page_id", "url", "text", "n_chars")


@query
def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    cases = spark.read.parquet(f"{folder}/benchmark.parquet")
    found = find_cases(messages_of(spark, folder), cases, case_id="item_id", message="text")
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", "contaminated"
    )


@query
def op10_passages(spark: SparkSession, folder: str) -> DataFrame:
    left = without_repeats(messages_of(spark, folder))
    return left.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op11_phrases(spark: SparkSession, folder: str) -> DataFrame:
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    return phrases.phrases(documents, "text", "lang").withColumnRenamed("language", "lang")


ORACLES["op11_phrases"] = phrases.oracle()


#: One of so many words of a document loses a letter.
SLIPS = 199


@query
def op12_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(spelling.message_words(messages_of(spark, folder), slips=SLIPS))


ORACLES["op12_spelling"] = spelling.oracle(SLIPS)


@query
def op13_backoff(spark: SparkSession, folder: str) -> DataFrame:
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    scored = score_messages(documents.withColumn("training", fold(7) != 2), "doc_id", "text")
    scored = scored.withColumnRenamed("id", "doc_id")
    return scored.select(
        "doc_id", F.coalesce(fold(7) == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens",
        "base_score", "score",
    )


QUERIES["pipeline"] = run
if ORACLE_SQL:
    ORACLES["pipeline"] = ORACLE_SQL
