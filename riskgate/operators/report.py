"""Per-model reports.

Per-model groups are few and large; every aggregate here is algebraic (count,
sum, avg, count_if), so only map-side partials cross the shuffle and a hot
model needs no salting.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskgate import fixed
from riskgate.functions import judge, scoring


def model_report(scored: DataFrame, model: str = "model", index: str = "risk_index",
                 hallucinated: str = "is_hallucinated", gate_col: str = "gate") -> DataFrame:
    """Rows, mean index, hallucination rate and gate counts per model (A1)."""
    return scored.groupBy(model).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(index).alias("avg_index"),
        F.avg(F.col(hallucinated).cast("double")).alias("hal_rate"),
        F.count_if(F.col(gate_col) == "AUTO_USE").alias("n_auto"),
        F.count_if(F.col(gate_col) == "REVIEW").alias("n_review"),
        F.count_if(F.col(gate_col) == "BLOCK").alias("n_block"),
    )


def model_stats(scored: DataFrame, model: str = "model", index: str = "risk_index",
                hallucinated: str = "is_hallucinated") -> DataFrame:
    """Mean index to 2 places, rate in percent to 1, gate counts by the index
    thresholds, and the grade (A2, P24)."""
    x = F.col(index)
    rep = scored.groupBy(model).agg(
        F.round(F.avg(x), 2).alias("avg_index"),
        F.round(F.avg(F.col(hallucinated).cast("double")) * 100, 1).alias("hal_rate"),
        F.count_if(x < fixed.GATE_AUTO_USE_BELOW).alias("auto"),
        F.count_if((x >= fixed.GATE_AUTO_USE_BELOW) & (x < fixed.GATE_BLOCK_FROM)).alias("review"),
        F.count_if(x >= fixed.GATE_BLOCK_FROM).alias("block"),
    )
    return rep.withColumn("grade", scoring.grade("avg_index"))


def gate_distribution(scored: DataFrame, gate_col: str = "gate") -> DataFrame:
    """Count and share per gate; gates with no rows are kept with 0 (A3)."""
    spark = scored.sparkSession
    dim = F.broadcast(spark.createDataFrame([(g,) for g in fixed.GATES], f"{gate_col} string"))
    counts = scored.groupBy(F.col(gate_col).alias("_g")).agg(F.count(F.lit(1)).alias("n"))
    # null-safe equality: a plain '=' would make the optimizer infer
    # isnotnull(gate) and push it to the scan, re-evaluating the whole gate
    # expression there; the dimension has no null gate, so the result is equal
    out = (dim.join(counts, dim[gate_col].eqNullSafe(counts["_g"]), "left").drop("_g")
              .withColumn("n", F.coalesce("n", F.lit(0)).cast("long")))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))  # three rows only
    return out.withColumn("share", F.when(total > 0, F.col("n") / total).otherwise(F.lit(0.0)))


def mean_by_label(scored: DataFrame, label: str = "true_label", index: str = "risk_index") -> DataFrame:
    """Mean index of clean and of hallucinated rows."""
    return scored.groupBy(label).agg(F.avg(index).alias("mean_index"), F.count(F.lit(1)).alias("n"))


def models_first_seen(df: DataFrame, model: str = "model", order_col: str = "pos") -> DataFrame:
    """Distinct models with their first position and first-seen rank."""
    first = df.groupBy(model).agg(F.min(order_col).alias("first_pos"))
    # one row per model: the global window orders a small aggregated table
    return first.withColumn("model_pos", F.row_number().over(Window.orderBy("first_pos", model)))


def model_rank(report: DataFrame, model: str = "model", index: str = "avg_index") -> DataFrame:
    """Ascending mean index with an explicit rank column (O1)."""
    return report.withColumn("rank", F.rank().over(Window.orderBy(F.col(index).asc())))


def question_grid(scored: DataFrame, ids: Sequence[str], model: str, models: Sequence[str],
                  value: str, with_gate: bool = False) -> DataFrame:
    """Question by model grid of mean values (A16), optionally with the gate of
    each mean as ``<model>_gate``. The model list is given so the pivot needs no
    extra job to find it."""
    grid = scored.groupBy(*ids).pivot(model, list(models)).agg(F.avg(value))
    if with_gate:
        grid = grid.select(*ids, *[c for m in models for c in (F.col(m), scoring.gate(m).alias(f"{m}_gate"))])
    return grid


def fill_rate(responses: DataFrame, response: str = "response", by: Sequence[str] = ()) -> DataFrame:
    """Filled responses out of all (A17, with the F2 predicate)."""
    filled = judge.is_filled(response)
    g = responses.groupBy(*by) if by else responses
    return g.agg(F.count_if(filled).alias("n_filled"), F.count(F.lit(1)).alias("n_total"),
                 F.try_divide(F.count_if(filled).cast("double"),
                              F.count(F.lit(1)).cast("double")).alias("fill_rate"))


def response_detail(scored: DataFrame, model_order: DataFrame, model: str = "model",
                    cols: Sequence[str] = ("id", "category", "gate", "risk_index")) -> DataFrame:
    """One row per response with its model's first-seen position (A18). The
    per-model table (one row per model) is left to AQE's run-time size check:
    broadcast when small, a skew-split shuffle join otherwise."""
    return scored.join(model_order.select(model, "model_pos"), model, "inner") \
        .select("model_pos", model, *cols)
