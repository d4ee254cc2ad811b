"""Skew-safe running sums and exact percentiles.

A window without a partition key sends every row to one task, and a window
partitioned by a low-cardinality key (a label, a model) sends a hot key's rows
to one task. Here the order value is cut into ranges that hold about as many
rows each: the bounds are percentiles of the data, so values crowding anywhere
are spread. Each (group, range) is summed in its own task, and the totals of the
ranges before it (groups x ranges rows) are joined back null-safely on the keys
the window already shuffled by. The result equals a single global ordering.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_RANGES = 256


def _with_range(df: DataFrame, order_col: str, ranges: int) -> DataFrame:
    """Adds ``_b``, an order-preserving range number. At most ``ranges`` bounds
    reach the driver."""
    steps = [k / ranges for k in range(1, ranges)]
    bounds = df.agg(F.percentile_approx(F.col(order_col).cast("double"), steps, 10000)).first()[0] or [0.0]
    edges = [-float("inf"), *sorted(set(bounds)), float("inf")]
    cut = Bucketizer(splits=edges, inputCol="_o", outputCol="_b", handleInvalid="keep")
    return cut.transform(df.withColumn("_o", F.col(order_col).cast("double"))).drop("_o") \
        .withColumn("_b", F.col("_b").cast("int"))


def running_sums(df: DataFrame, order_col: str, value_cols: Sequence[str],
                 descending: bool = False, ranges: int = DEFAULT_RANGES,
                 suffix: str = "_cum", by: Sequence[str] = ()) -> DataFrame:
    """Inclusive running sums of ``value_cols`` in ``order_col`` order, within
    each group of ``by`` (null is a group; without ``by`` over the whole frame);
    ``order_col`` should be unique per group (e.g. after a group-by)."""
    parts = list(by)
    base = _with_range(df, order_col, ranges)
    if descending:
        base = base.withColumn("_b", -F.col("_b"))
    order = F.col(order_col).desc() if descending else F.col(order_col).asc()
    w_in = (Window.partitionBy(*parts, "_b").orderBy(order)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    totals = base.groupBy(*parts, "_b").agg(*[F.sum(c).alias(c + "_bt") for c in value_cols])
    for c in value_cols:
        base = base.withColumn(c + "_in", F.sum(c).over(w_in))
    w_off = Window.partitionBy(*parts) if parts else Window.partitionBy(F.lit(0))
    w_off = w_off.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    for c in value_cols:  # groups x ranges rows: a small table
        totals = totals.withColumn(c + "_off", F.coalesce(F.sum(c + "_bt").over(w_off), F.lit(0)))
    totals = totals.drop(*[c + "_bt" for c in value_cols])
    same = F.col("r._b") == F.col("t._b")
    for c in parts:
        same = same & F.col(f"r.{c}").eqNullSafe(F.col(f"t.{c}"))
    out = base.alias("r").join(totals.alias("t"), same, "inner") \
        .select("r.*", *[F.col(f"t.{c}_off") for c in value_cols])
    for c in value_cols:
        out = out.withColumn(c + suffix, F.col(c + "_off") + F.col(c + "_in")).drop(c + "_off", c + "_in")
    return out.drop("_b")


def exact_percentile(df: DataFrame, value: str, q: float, by: Sequence[str] = (),
                     out: str = "percentile") -> DataFrame:
    """The ``q``-quantile with linear interpolation, per group of ``by``, from counts
    per distinct value and their running sums: no buffer grows with the values."""
    parts = list(by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*parts, F.col(value).cast("double").alias("_v")) \
        .agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_sums(counts, "_v", ["_n"], by=parts)
    total = counts.groupBy(*parts).agg(F.sum("_n").alias("_all"))
    same = F.lit(True)
    for c in parts:
        same = same & F.col(f"r.{c}").eqNullSafe(F.col(f"a.{c}"))
    if parts:
        ranked = ranked.alias("r").join(total.alias("a"), same).select("r.*", "a._all")
    else:
        ranked = ranked.withColumn("_all", F.lit(total.first()["_all"] or 0))
    place = (F.col("_all") - 1) * F.lit(q)
    low = F.min(F.when(F.col("_n_cum") > F.floor(place), F.col("_v")))
    high = F.min(F.when(F.col("_n_cum") > F.ceil(place), F.col("_v")))
    share = F.max(place - F.floor(place))
    return (ranked.groupBy(*parts) if parts else ranked).agg((low + (high - low) * share).alias(out))
