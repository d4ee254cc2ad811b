"""The registered queries of this subpackage: each applies its operator to the whole
intended table and derives the stated columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgate.llm import (chat_repair, chosen_path, decontaminate, html_text, jaccard_join, language_id, lexical_search, quality,
                          secret_scan, sentencepiece_scan, spelling_variants, token_counts, url_filter)
from riskgate.llm.arrow import table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every whole text, decodes the ids again and compares. The ids are given as
    a digest of their comma-joined list."""
    encoded = sentencepiece_scan.encode(table(spark, sf_dir, "documents"))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                          F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), "round_trip")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality_rules(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept", "n_removed_lines", "kept_chars")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item found in it."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


URL_RULES = [url_filter.Rule("allow", "org", "/"), url_filter.Rule("block", "example.org", "/es/"),
             url_filter.Rule("block", "example.org", "/en/1"), url_filter.Rule("allow", "com", "/fr/"),
             url_filter.Rule("block", "com", "/de/")]
#: Host words of the listed sites; the list holds the canonical URLs of their pages.
LISTED_WORDS = ("casino", "pills", "bets", "spam", "adult", "ads")


def listed_urls(pages: DataFrame) -> DataFrame:
    """The list of the query: canonical URLs of all pages on hosts with a listed word."""
    words = r"(?:^|[.-])(?:" + "|".join(LISTED_WORDS) + r")(?:[.-]|$)"
    return pages.where(url_filter.url_host(F.col("url")).rlike(words)) \
        .select(url_filter.canonical(F.col("url")).alias("canonical"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    got = url_filter.filter_urls(pages, URL_RULES, listed_urls(pages))
    return got.select("page_id", "host", "path", "rule", "verdict", "listed")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = language_id.held_out()
    dictionaries = language_id.learn(docs.where(~held))
    return language_id.predict_language(docs, dictionaries, {"doc_id": F.col("doc_id"), "held_out": held})


JACCARD_RULE = jaccard_join.Rule(words=3, percent=90)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), JACCARD_RULE)
    return found.select("doc_id", "n_shingles", "component_id")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per turn; the rendered segments of a conversation, by turn, are its format."""
    done = chat_repair.repair_chats(table(spark, sf_dir, "conversations"))
    return done.select("conv_id", "turn", "new_role", "action", "inserted_before", "inserted_after", "cost", "rendered")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secret_spans(table(spark, sf_dir, "documents"))
    count = [F.size(secret_scan.of_kind("base", k)).cast("long").alias(f"n_{k}") for k in secret_scan.KINDS[:3]]
    return found.select("doc_id", *count, F.sha2(secret_scan.written("base"), 256).alias("base_sha256"),
                        secret_scan.written("spans").alias("spans"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_variants(table(spark, sf_dir, "documents"))


NEAR_RULE = chosen_path.Near(words=5, percent=85)


def op12_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(table(spark, sf_dir, "documents"), NEAR_RULE)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (
    op1_sentencepiece, op2_quality_rules, op3_token_counts, op4_decontaminate, op5_url_filter, op6_language_id,
    op7_jaccard_join, op8_chat_format, op9_secret_scan, op10_html_text, op11_spelling_variants, op12_near_duplicates,
    op13_lexical_search)}
