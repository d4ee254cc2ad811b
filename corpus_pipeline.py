"""A training-data pipeline over `documents`: five stages, each written as Parquet and
read again as the next one's input.

quality     lines that fail the line rules are removed, rejected documents go
dedup       one document of each group linked by 5-word shingles, Jaccard 0.8 or more
decontam    documents that contain a benchmark item go (an item of under six words is no
            evidence: it may be any common word)
secrets     found secrets are replaced by a mark
tokens      the texts as SentencePiece ids

All stages but the last return the columns of documents; other columns do not matter
to them. n_chars follows the text. Rows with null text are rejected by the first stage.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgate.llm import decontaminate, jaccard_join, quality, secret_scan, sentencepiece_scan
from riskgate.llm.arrow import small_batches, table
from riskgate.llm.storage import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
NEAR_DUPLICATES = jaccard_join.Rule(words=5, percent=80)


def _documents(df: DataFrame, text: str) -> DataFrame:
    """The columns of documents, with the text from another column."""
    return df.select("doc_id", F.col(text).alias("text"), "lang", "source",
                     F.char_length(text).cast("long").alias("n_chars"))


def _in_small_batches(stage):
    """The stage, whose whole texts go to Python in small batches: its executors also keep
    what the stages before have left in their memory."""
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)
    return run


@_in_small_batches
def clean_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _documents(quality.quality_rules(docs, ("doc_id", "lang", "source")).where("kept"), "clean_text")


@_in_small_batches
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs.select(*COLUMNS), NEAR_DUPLICATES)


@_in_small_batches
def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), short_items=False)


@_in_small_batches
def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secret_scan.secret_spans(docs, ("doc_id", "lang", "source"))
    return _documents(found.withColumn("redacted", secret_scan.redacted("__text", "spans")), "redacted")


@_in_small_batches
def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, n_tokens and ids, and whether the ids give the text back."""
    encoded = sentencepiece_scan.encode(docs, carry=("doc_id", "lang", "source", "n_chars"))
    return encoded.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids",
                          "round_trip")


STAGES = [("quality rules", clean_quality), ("n-gram Jaccard join", one_of_each_group),
          ("benchmark decontamination", without_benchmark), ("secret scans", without_secrets),
          ("SentencePiece encoding", as_tokens)]

#: SQL cannot express these stages; tests hold them against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
