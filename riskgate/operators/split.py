"""Splits, seeded shuffle and first-n.

Stratified and group-aware splits send the rows with the lowest seeded hash
draws to test. The cut-off row of each label is found exactly inside Spark: rows
are counted by a prefix of their draw (map-side), the prefix that holds the cut-off
is refined, and only rows that share the whole 32-bit draw are put in order. What
comes of it is one cut-off per label. The group split has a single one, which goes
into the filter as a literal. Up to MAX_BROADCAST_LABELS label cut-offs are handed out
by broadcast, so the rows themselves never move; a label column with more distinct
values is joined by (label, salt), so a hot label is spread over SALTS tasks. No row
reaches the driver and no label, null included, is lost.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from riskgate import fixed
from riskgate.functions import draws

# The draw is an exact multiple of 2^-32; its 32-bit integer is refined by
# prefixes of 10, 21 and 32 bits.
PREFIX_SHIFTS = [22, 11, 0]
# Cut-offs of so many labels are collected and broadcast, a few hundred KB at most.
MAX_BROADCAST_LABELS = 10_000
SALTS = 64


def _draw_bits(seed: int, key: str, stream: str) -> Column:
    return (draws.unit_draw(seed, F.col(key), stream) * F.lit(4294967296.0)).cast("long")


def _matches(labels: Sequence[str], left: str, right: str) -> Column:
    cond = F.lit(True)
    for c in labels:
        cond = cond & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return cond


def _located(d: DataFrame, labels: Sequence[str], shift: int, cut: DataFrame | None, outer: int,
             fraction: float) -> DataFrame:
    """(labels, prefix, need): per label the prefix of ``shift`` that holds the
    cut-off row and its position inside it. ``cut`` is the same table one level
    up; without it the position is ceil(fraction * rows of the label)."""
    if cut is not None:
        inside = _matches(labels, "r", "c") & (F.shiftright(F.col("r._u"), outer) == F.col("c._p"))
        d = d.alias("r").join(cut.alias("c"), inside) \
            .select(*[F.col(f"r.{c}").alias(c) for c in labels], F.col("r._u").alias("_u"), F.col("c._need").alias("_need"))
        need = F.max("_need")
    else:
        need = None
    counts = d.groupBy(*labels, F.shiftright("_u", shift).alias("_p")).agg(
        F.count(F.lit(1)).alias("_n"), *([need.alias("_need")] if need is not None else []))
    per_label = Window.partitionBy(*labels) if labels else Window.partitionBy(F.lit(0))
    running = per_label.orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.withColumn("_upto", F.sum("_n").over(running))
    if need is None:
        counts = counts.withColumn("_need", F.ceil(F.sum("_n").over(per_label) * F.lit(fraction)))
    return counts.where((F.col("_upto") >= F.col("_need")) & (F.col("_upto") - F.col("_n") < F.col("_need"))) \
        .select(*labels, "_p", (F.col("_need") - F.col("_upto") + F.col("_n")).alias("_need"))


def _cut_offs(d: DataFrame, labels: Sequence[str], key: str, fraction: float) -> DataFrame:
    """(labels, _cut_u, _cut_key): the ceil(fraction * n)-th row of each label in
    the order of (draw, key)."""
    cut = None
    for k, shift in enumerate(PREFIX_SHIFTS):
        cut = _located(d.select(*labels, "_u"), labels, shift, cut, PREFIX_SHIFTS[k - 1] if k else 0, fraction)
    tied = d.select(*labels, "_u", F.col(key).alias("_key")).alias("r").join(
        cut.alias("c"), _matches(labels, "r", "c") & (F.col("r._u") == F.col("c._p"))) \
        .select(*[F.col(f"r.{c}").alias(c) for c in labels], "_u", "_key", "_need")
    order = Window.partitionBy(*labels, "_u").orderBy("_key")
    return tied.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") == F.col("_need")) \
        .select(*labels, F.col("_u").alias("_cut_u"), F.col("_key").alias("_cut_key"))


def _assign(d: DataFrame, key: str, out: str) -> DataFrame:
    """The side of rows that carry their draw (_u) and their label's cut-off."""
    below = (F.col("_u") < F.col("_cut_u")) | ((F.col("_u") == F.col("_cut_u")) & (
        F.col(key).isNull() | (F.col(key) <= F.col("_cut_key"))))
    return d.withColumn(out, F.when(below, F.lit("test")).otherwise(F.lit("train"))).drop("_u", "_cut_u", "_cut_key")


def _found(narrow: DataFrame, labels: Sequence[str], fraction: float) -> tuple[DataFrame, list | None]:
    """The cut-offs as a table, and as rows where there are at most MAX_BROADCAST_LABELS. The
    narrow columns are read four times, from memory or local disk."""
    kept = narrow.persist(StorageLevel.MEMORY_AND_DISK)
    rows = _cut_offs(kept, labels, "_k", fraction).limit(MAX_BROADCAST_LABELS + 1).collect()
    kept.unpersist()
    return _cut_offs(narrow, labels, "_k", fraction), rows if len(rows) <= MAX_BROADCAST_LABELS else None


def stratified_split(df: DataFrame, label: str, key: str,
                     test_fraction: float = fixed.SPLIT_TEST_FRACTION,
                     seed: int = fixed.SPLIT_SEED, out: str = "split") -> DataFrame:
    """Per label (null is one), the ceil(fraction * n) rows with the lowest seeded
    draw (ties by key) go to test (O4). Deterministic for a given seed and key,
    whatever the partitioning and the number of labels. Finding the cut-offs runs a
    small job at once."""
    bits = _draw_bits(seed, key, "split")
    cuts, rows = _found(df.select(F.col(label), F.col(key).alias("_k"), bits.alias("_u")), [label], test_fraction)
    left = df.withColumn("_u", bits)
    if rows is not None:
        small = df.sparkSession.createDataFrame(rows, cuts.schema).alias("c")
        d = left.alias("r").join(F.broadcast(small), _matches([label], "r", "c"), "left")
    else:
        salted = cuts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).alias("c")
        left = left.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
        d = left.alias("r").join(salted, _matches([label], "r", "c") & (F.col("r._salt") == F.col("c._salt")), "left")
    return _assign(d.select(*[F.col(f"r.{c}") for c in df.columns], "r._u", "c._cut_u", "c._cut_key"), key, out)


def group_split(df: DataFrame, group_col: str, test_fraction: float = fixed.SPLIT_TEST_FRACTION,
                seed: int = fixed.SPLIT_SEED, out: str = "split") -> DataFrame:
    """Whole groups go to one side (O5): rows with equal ``group_col`` (e.g. a
    text hash) never straddle the split. The ceil(fraction * groups) groups with
    the lowest seeded draw are test. One shuffle makes the groups distinct, once, when
    the split is built; the split itself is a filter expression on each row."""
    groups = df.select(F.col(group_col).alias("_k")).distinct() \
        .withColumn("_u", _draw_bits(seed, "_k", "group_split"))
    cuts, rows = _found(groups, [], test_fraction)
    cut = rows[0] if rows else {"_cut_u": None, "_cut_key": None}
    d = df.withColumn("_u", _draw_bits(seed, group_col, "group_split")) \
        .withColumn("_cut_u", F.lit(cut["_cut_u"]).cast("long")) \
        .withColumn("_cut_key", F.lit(cut["_cut_key"]).cast(cuts.schema["_cut_key"].dataType))
    return _assign(d, group_col, out)


def seeded_shuffle(df: DataFrame, key: str, seed: int = fixed.SPLIT_SEED,
                   out: str = "shuffle_key") -> DataFrame:
    """Deterministic permutation key (O3); meaningful before a limit."""
    return df.withColumn(out, F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))))


def first_n(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """First ``n`` rows by an explicit key (F4): a top-k, not a full sort."""
    return df.orderBy(*order).limit(n)


def require_rows(df: DataFrame, minimum: int = fixed.MIN_FIT_ROWS) -> int:
    """At least ``minimum`` rows or ValueError (F5). Reads at most minimum rows."""
    n = df.limit(minimum).count()
    if n < minimum:
        raise ValueError(f"Need at least {minimum} samples to fit the probes. Got {n}.")
    return n
