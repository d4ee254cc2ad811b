"""Registered file workflows (S6, S7, U2, K1, K2, J1): tables derived from the given ones are
written as a user would, read back by the sources, and compared with SQL; and the large
forms of A4 and P21."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgate.functions import judge, phrases
from riskgate.operators import evaluate as E
from riskgate.operators import joins as J
from riskgate.plans import inputs as I
from riskgate.session import checkpoint_dir
from riskgate.sinks import writers as W
from riskgate.sources import qa

#: conv_id modulo FORMS decides how a response is filed: as a line, in a document, or as a broken line.
FORMS = 5
BUCKETS = 8


def _folder(spark: SparkSession, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def _filed(spark, sf) -> DataFrame:
    """Assistant turns as response records; the question says which turn it was."""
    return I.responses(spark, sf).select(
        "conv_id", F.col("id").cast("string").alias("id"), F.concat(F.lit("item"), F.col("id").cast("string")).alias("category"), "model",
        F.concat_ws(":", "conv_id", "turn").alias("question"), "response", F.lit(None).cast("string").alias("_correct_answer_hint"))


def response_files(spark, sf):
    """Lines, documents and broken lines, read as one table with file and bad records."""
    rows, path = _filed(spark, sf), _folder(spark, "responses")
    form = F.pmod("conv_id", F.lit(FORMS))
    W.write_template(rows.where(form > 1).drop("conv_id"), f"{path}/lines")
    W.write_template_documents(rows.where(form == 1).drop("conv_id"), f"{path}/documents", ["fill in"])
    rows.where(form == 0).select(F.format_string('{"id": "%s", "question": "%s", "resp', "id", "question")).write.text(f"{path}/broken")
    got = qa.response_records(spark, [f"{path}/lines", f"{path}/documents", f"{path}/broken"])
    return got.select("question", "id", "model", F.md5("response").alias("response_md5"),
                      F.regexp_extract("source_file", "/([a-z]+)/[^/]*$", 1).alias("folder"), "bad_record")


def bank_files(spark, sf):
    """A bank in both spellings, read back as one."""
    path = _folder(spark, "bank")
    rows = I.bank(spark, sf).withColumn("id", F.col("id").cast("string"))
    first = F.pmod(F.col("id").cast("long"), F.lit(2)) == 0
    rows.where(first).select("id", "question", "risk_level", "key_facts", "red_flags").write.json(f"{path}/first")
    renamed = {new: old for old, new in qa.BANK_RENAMES.items()}
    rows.where(~first).select("id", "question", F.col("risk_level").alias(renamed["risk_level"]), F.col("key_facts").alias(renamed["key_facts"]),
                              "red_flags").write.json(f"{path}/second")
    got = qa.bank_source(spark, [f"{path}/first", f"{path}/second"])
    return got.select("id", "risk_level", F.size("key_facts").alias("n_facts"), F.size("red_flags").alias("n_flags"),
                      F.md5("question").alias("question_md5"))


def result_files(spark, sf):
    """K1, K2: templates of every question and model are written, read and filled; the results
    are written by model, and the even models a second time, which leaves the others."""
    path = _folder(spark, "results")
    bank = I.bank(spark, sf).select(F.col("id").cast("string").alias("id"), F.lit("item").alias("category"), "question",
                                    F.col("question").alias("correct_answer"))
    models = I.models(I.responses(spark, sf))
    W.write_template(W.template_rows(bank, models=models), f"{path}/template")
    template = qa.response_file(spark, f"{path}/template", only_filled=False, lines=True)
    answers = _filed(spark, sf).groupBy("id", "model").agg(F.count("*").alias("n"), F.max("response").alias("last"))
    filled = template.select("id", "model").join(answers, ["id", "model"], "left") \
        .select("id", "model", F.coalesce("n", F.lit(0)).alias("n"), F.md5("last").alias("last_md5"), F.lit(1).alias("version"))
    W.write_results(filled, f"{path}/results", fmt="parquet")
    even = F.col("model").rlike("[02468]$")
    W.rewrite_results(filled.where(even).withColumn("version", F.lit(2)), f"{path}/results")
    return spark.read.parquet(f"{path}/results").select("id", F.col("model").cast("string").alias("model"), "n", "last_md5", "version")


def bucketed(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The responses and the bank as tables in equal buckets by question."""
    path, name = _folder(spark, "buckets"), uuid.uuid4().hex
    rows = I.responses(spark, sf).select("conv_id", "turn", "id", "response")
    bank = I.bank(spark, sf).select("id", "key_facts", "red_flags", "risk_level")
    return tuple(W.write_bucketed(df, f"{kind}_{name}", "id", BUCKETS, f"{path}/{kind}") for df, kind in ((rows, "responses"), (bank, "bank")))


def bucketed_judge(spark, sf):
    """The bank join on bucketed tables, judged."""
    joined = J.attach_bank(*bucketed(spark, sf)).select(
        "conv_id", "turn", "id", judge.judge_rate("response", "key_facts", "red_flags", "risk_level").alias("j"))
    return joined.select("conv_id", "turn", "id", F.col("j.is_hallucinated").cast("int").alias("is_hallucinated"), F.col("j.severity").alias("severity"))


def judge_indexed(spark, sf):
    """The rate judge with one look-up of all phrases in a text."""
    joined = J.attach_bank(I.responses(spark, sf, spread=True), I.bank(spark, sf).select("id", "key_facts", "red_flags", "risk_level"))
    found = joined.select("conv_id", "turn", "id", judge.judge_rate(
        "response", "key_facts", "red_flags", "risk_level", count=phrases.indexed_count).alias("j"))
    return found.select("conv_id", "turn", "id", F.col("j.is_hallucinated").cast("int").alias("is_hallucinated"), F.col("j.severity").alias("severity"),
                        F.col("j.red_flags_hit").alias("red_flags_hit"), F.col("j.facts_found").alias("facts_found"))


#: Rank error that the sketches of SKETCH_K are held to.
RANK_ERROR = 0.01


def latency_sketch(spark, sf):
    """A4 on large data: a sketch per event type and hour, written, read, merged per type; the
    rank of the 95th percentile is checked against the exact one."""
    events, path = I.table(spark, sf, "events"), _folder(spark, "sketches")
    hours = events.select("event_type", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour"), "value")
    E.latency_sketches(hours, "value", ["event_type", "hour"]).write.parquet(path)
    merged = E.merged_quantile(spark.read.parquet(path), ["event_type"])
    off = E.rank_error(events, "value", merged, ["event_type"], 0.95, "p95_latency_ms")
    return merged.join(off, "event_type").select("event_type", "n", (F.col("rank_error") <= RANK_ERROR).alias("within"))


FILE_QUERIES = {f.__name__: f for f in (response_files, bank_files, result_files, bucketed_judge, judge_indexed, latency_sketch)}
