"""Joins: bank lookup, risk lookup, positional zip, variant expansion,
outstanding questions, entity-position semi-join (J1-J7, F3).

Only dimensions built from literals, whose size is fixed by the code, are
broadcast by a hint. Every table read from data, banks included, is left to
Catalyst and AQE, which measure bytes at run time: small ones are broadcast, large
ones joined by sort-merge with skew splitting, without a job to count them first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgate import fixed

def literal_dimension(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small dimension table from literal rows (size fixed by the caller's code)."""
    return spark.createDataFrame(list(rows), schema=schema)


def attach_bank(responses: DataFrame, bank: DataFrame, key: str = "id") -> DataFrame:
    """Responses joined to their bank entry; unknown keys are dropped."""
    return responses.join(bank, key, "inner")


def unmatched(responses: DataFrame, bank: DataFrame, key: str = "id") -> DataFrame:
    """Responses whose key has no bank entry (F3, reported rather than lost)."""
    return responses.join(bank.select(key), key, "left_anti")


def risk_lookup(df: DataFrame, category_col: str, table: Mapping[str, int] | DataFrame,
                default: int = fixed.DEFAULT_RISK, out_col: str = "risk") -> DataFrame:
    """Left lookup of a risk level by category, default when absent."""
    if isinstance(table, Mapping):
        dim = literal_dimension(df.sparkSession, sorted(table.items()),
                                f"{category_col} string, {out_col} int")
        dim = F.broadcast(dim)
    else:
        dim = table.select(category_col, out_col)
    return (df.join(dim, category_col, "left")
              .withColumn(out_col, F.coalesce(F.col(out_col), F.lit(default)).cast("int")))


def positional_zip(left: DataFrame, right: DataFrame, pos: str = "pos") -> DataFrame:
    """i-th row of one side with the i-th of the other, stopping at the shorter
    (J3). Positions are an explicit column (``posexplode`` of a list gives it)."""
    return left.join(right, pos, "inner")


def variant_expand(bank: DataFrame, key: str, right_col: str, wrong_col: str,
                   risk_col: str,
                   wrong_per_risk: float = fixed.VARIANT_WRONG_PER_RISK,
                   right_severity: float = fixed.VARIANT_RIGHT_SEVERITY) -> DataFrame:
    """Each bank row twice: right text (label 0) and wrong text (label 1).

    A narrow ``explode`` of a two-element array: no join, no shuffle.
    """
    variants = F.array(
        F.struct(F.lit(0).alias("label"), F.col(right_col).alias("answer"),
                 F.lit(right_severity).alias("severity")),
        F.struct(F.lit(1).alias("label"), F.col(wrong_col).alias("answer"),
                 (F.col(risk_col).cast("double") * wrong_per_risk).alias("severity")),
    )
    return (bank.select(key, risk_col, F.explode(variants).alias("v"))
                .select(key, risk_col, "v.label", "v.answer", "v.severity"))


def outstanding(bank: DataFrame, responses: DataFrame, models: Sequence[str],
                key: str = "id", model_col: str = "model",
                filled_col: str | None = None) -> DataFrame:
    """(question, model) pairs of the given model list with no filled response
    (J6). No cross join: per question the set of answering models (at most
    ``len(models)`` values, aggregated map-side) is subtracted from the list."""
    r = responses
    if filled_col is not None:
        r = r.filter(F.col(filled_col))
    answered = (r.filter(F.col(model_col).isin(list(models)))
                 .groupBy(key).agg(F.collect_set(model_col).alias("_answered")))
    model_arr = F.array(*[F.lit(m) for m in models])
    empty = F.array().cast("array<string>")
    return (bank.join(answered, key, "left")
                .withColumn(model_col, F.explode(F.array_except(
                    model_arr, F.coalesce(F.col("_answered"), empty))))
                .drop("_answered"))


def entity_positions(states: DataFrame, positions: DataFrame,
                     keys: Sequence[str] = ("sample_id", "token_pos")) -> DataFrame:
    """Token states at entity positions only (J7): a semi-join, so only the
    surviving rows reach the pooling shuffle."""
    return states.join(positions.select(*keys).distinct(), list(keys), "left_semi")
