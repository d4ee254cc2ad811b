"""Sinks (K1-K3; K4 is ``RiskProbesModel.save``).

All writes are ordinary DataFrame writers: partitioned, overwrite-safe, and
written by the executors, never gathered on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgate import fixed
from riskgate.functions import text as T


def template_rows(bank: DataFrame, models: Sequence[str] | None = None,
                  model: str = fixed.TEMPLATE_DEFAULT_MODEL) -> DataFrame:
    """Response template rows (K1): id, category, model, question, placeholder
    response, hint = first 80 characters of the correct answer + '...'.
    With ``models`` one row per (question, model) is produced by a narrow
    explode of the literal model list."""
    ms = list(models) if models else [model]
    return bank.select(
        "id", "category", F.explode(F.array(*[F.lit(m) for m in ms])).alias("model"), "question",
        F.lit(fixed.RESPONSE_PLACEHOLDER).alias("response"),
        T.snippet("correct_answer", fixed.SNIPPET_HINT).alias("_correct_answer_hint"))


def write_template(rows: DataFrame, path: str) -> None:
    """Template rows as JSON lines, written by the executors (no single
    document is assembled on one task); fill in the ``response`` fields and read
    back with ``response_file(..., lines=True)``."""
    rows.write.mode("overwrite").json(path)


def write_template_documents(rows: DataFrame, path: str, instructions: Sequence[str]) -> None:
    """The template as documents {_instructions, responses}, one for each model and task
    that holds rows of it, a line each; read back with ``response_file(..., lines=True)``."""
    fields = [c for c in rows.columns]
    docs = rows.groupBy("model", F.spark_partition_id().alias("_part")).agg(
        F.collect_list(F.struct(*fields)).alias("responses"))
    docs.select(F.array(*[F.lit(i) for i in instructions]).alias("_instructions"), "responses") \
        .write.mode("overwrite").json(path)


def write_results(results: DataFrame, path: str, fmt: str = "json",
                  partition_by: Sequence[str] = ("model",)) -> None:
    """Scored result records (K2), one folder per model."""
    w = results.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.format(fmt).save(path)


def rewrite_results(results: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ("model",)) -> None:
    """Replace the folders that ``results`` has rows for and leave the others (K2): a model
    that is scored again does not touch the rest."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).format(fmt).save(path)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, path: str) -> DataFrame:
    """``df`` as a table in buckets by ``key``, one sorted file each. Two tables with the same
    number of buckets join on the key without moving a row."""
    df.repartition(buckets, key).sortWithinPartitions(key).write.mode("overwrite").option("path", path) \
        .bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    return df.sparkSession.table(table)


def write_report(report: DataFrame, path: str) -> None:
    """Benchmark report (K3): the long (method, metric, value) table as JSON.
    One file: the table has methods x metrics rows, a size fixed by the caller."""
    report.coalesce(1).write.mode("overwrite").json(path)


def long_report(wide: DataFrame, id_col: str = "method") -> DataFrame:
    """Metrics table in long form (method, metric, value)."""
    metrics = [c for c in wide.columns if c != id_col]
    stack = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"),
                                         F.col(m).cast("double").alias("value")) for m in metrics]))
    return wide.select(id_col, stack.alias("s")).select(id_col, "s.metric", "s.value")
