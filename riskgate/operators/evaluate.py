"""Evaluation metrics as aggregations.

Rank metrics group rows by score first (map-side partial counts), so only one
row per distinct score is ordered; the running sums over that table are
bucketed (see :mod:`riskgate.operators.ranking`), never a single-task window
over raw rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgate import fixed
from riskgate.functions import draws, scoring
from riskgate.operators.ranking import exact_percentile, running_sums


#: Size of a quantile sketch: a rank error of about 0.4 %.
SKETCH_K = 400


def _score_counts(df: DataFrame, label: str, score: str, by=()) -> DataFrame:
    return (df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
              .groupBy(*by, F.col(score).cast("double").alias("_s"))
              .agg(F.count_if(F.col(label) == 1).alias("_p"),
                   F.count_if(F.col(label) != 1).alias("_n")))


def rank_metrics(df: DataFrame, label: str, score: str, by=(),
                 threshold: float | None = None) -> DataFrame:
    """ROC AUC and average precision from one pass.

    Rows are first counted per distinct score (map-side partial counts); one
    descending running sum over that table gives, per score s, the positives
    p>=s and all rows a>=s at or above it. Then, with P and N the class totals
    (plain sums in the same final aggregate):
    AUC = 1 - sum_s p(s) * (n>=s - n(s) / 2) / (P * N), ties counted half;
    AP = sum_s p(s) * (p>=s / a>=s) / P, the step-wise sum over distinct scores
    (not a trapezoid area). Null when a class is absent.

    Class totals are multiplied as doubles, so they may be of any size.
    """
    by = list(by)
    counts = _score_counts(df, label, score, by).withColumn("_a", F.col("_p") + F.col("_n"))
    g = running_sums(counts, "_s", ["_p", "_n", "_a"], descending=True, by=by)
    return from_sums(g, by, threshold)


def from_sums(g: DataFrame, by=(), threshold: float | None = None) -> DataFrame:
    """The metrics of per-score counts (_s, _p, _n) with their descending running sums."""
    by = list(by)
    P, N = F.sum("_p").cast("double"), F.sum("_n").cast("double")
    tail = F.sum(F.col("_p").cast("double") * (F.col("_n_cum") - F.col("_n") * 0.5))
    ap_num = F.sum(F.col("_p") * F.try_divide(F.col("_p_cum").cast("double"), F.col("_a_cum").cast("double")))
    aggs = [(F.lit(1.0) - F.try_divide(tail, P * N)).alias("auc_roc"),
            F.try_divide(ap_num, P).alias("avg_precision")]
    if threshold is not None:
        # F1 of score > threshold from the same per-score counts
        above = F.col("_s") > threshold
        tp = F.sum(F.when(above, F.col("_p")).otherwise(F.lit(0)))
        fp = F.sum(F.when(above, F.col("_n")).otherwise(F.lit(0)))
        fn = F.sum(F.when(~above, F.col("_p")).otherwise(F.lit(0)))
        den = 2 * tp + fp + fn
        aggs.append(F.when(den > 0, (2 * tp) / den).otherwise(F.lit(0.0)).alias("f1"))
    return (g.groupBy(*by) if by else g).agg(*aggs)


def roc_auc(df: DataFrame, label: str, score: str, out: str = "auc_roc") -> DataFrame:
    """Area under the ROC curve, ties counted half (A7). Null with one class."""
    return rank_metrics(df, label, score).select(F.col("auc_roc").alias(out))


def average_precision(df: DataFrame, label: str, score: str,
                      out: str = "avg_precision") -> DataFrame:
    """Step-wise average precision."""
    return rank_metrics(df, label, score).select(F.col("avg_precision").alias(out))


def f1_at(df: DataFrame, label: str, score: str, threshold: float = fixed.PREDICT_THRESHOLD,
          out: str = "f1") -> DataFrame:
    """F1 of ``score > threshold`` against the label; 0 when undefined."""
    pred = F.col(score) > threshold
    y = F.col(label) == 1
    tp, fp, fn = F.count_if(pred & y), F.count_if(pred & ~y), F.count_if(~pred & y)
    den = 2 * tp + fp + fn
    return df.agg(F.when(den > 0, (2 * tp) / den).otherwise(F.lit(0.0)).alias(out))


def class_accuracy(df: DataFrame, predicted: str, actual: str, out: str = "accuracy") -> DataFrame:
    """Share of rows whose predicted class equals the actual one (A10)."""
    return df.agg(F.avg((F.col(predicted) == F.col(actual)).cast("double")).alias(out))


def severity_correlation(df: DataFrame, index: str, severity: str,
                         out: str = "severity_pearson_r") -> DataFrame:
    """Pearson correlation of index and severity (A5)."""
    return df.agg(F.corr(F.col(index).cast("double"), F.col(severity).cast("double")).alias(out))


def latency_summary(df: DataFrame, duration: str, by: list[str] | None = None, q: float = 0.95) -> DataFrame:
    """Mean and exact 95th percentile (linear interpolation) of a duration (A4)."""
    by = by or []
    means = (df.groupBy(*by) if by else df).agg(F.avg(duration).alias("avg_latency_ms"))
    return _combine_rows([means, exact_percentile(df, duration, q, by, "p95_latency_ms")], tuple(by))


def latency_sketches(df: DataFrame, duration: str, by: list[str], k: int = SKETCH_K) -> DataFrame:
    """One mergeable quantile sketch per group (A4 on large data): a few KB each, whatever
    the rows. Kept as a table, for example by hour, they answer for any span later."""
    return df.groupBy(*by).agg(F.kll_sketch_agg_double(F.col(duration).cast("double"), F.lit(k)).alias("sketch"))


def merged_quantile(sketches: DataFrame, by: list[str], q: float = 0.95, k: int = SKETCH_K, out: str = "p95_latency_ms") -> DataFrame:
    """(by, n, quantile) over merged sketches; the quantile's rank is off by at most about
    1.7 / k of the rows (KLL, 99 % confidence)."""
    merged = sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))
    return merged.select(*by, F.kll_sketch_get_n_double("sketch").alias("n"),
                         F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias(out))


def rank_error(df: DataFrame, duration: str, estimates: DataFrame, by: list[str], q: float, estimate: str) -> DataFrame:
    """(by, rank_error): how far the share of rows at or below the estimate is from q (0
    where q lies between the shares below and at it)."""
    value = F.col(duration).cast("double")
    shares = df.join(estimates.select(*by, estimate), by).groupBy(*by).agg(
        F.avg((value < F.col(estimate)).cast("double")).alias("_below"), F.avg((value <= F.col(estimate)).cast("double")).alias("_upto"))
    return shares.select(*by, F.greatest(F.lit(0.0), F.col("_below") - q, F.lit(q) - F.col("_upto")).alias("rank_error"))


def label_counts(df: DataFrame, label: str) -> DataFrame:
    """Hallucinated / clean counts and percent hallucinated."""
    return df.agg(F.count_if(F.col(label) == 1).alias("n_hallucinated"),
                  F.count_if(F.col(label) == 0).alias("n_clean"),
                  F.round(F.avg(F.col(label).cast("double")) * 100, 1).alias("pct_hallucinated"))


def random_baseline(df: DataFrame, key: str, seed: int = fixed.RANDOM_BASELINE_SEED,
                    out: str = "random_score") -> DataFrame:
    """Seeded uniform score per row (M10), independent of partitioning."""
    return df.withColumn(out, draws.unit_draw(seed, F.col(key), "random"))


def evaluate(scored: DataFrame, label: str = "true_label", index: str = "risk_index",
             severity: str = "true_severity", gate_col: str = "gate",
             duration: str | None = None, threshold: float = fixed.PREDICT_THRESHOLD,
             high: float = fixed.INDEX_MAX) -> DataFrame:
    """One evaluation record (M11): AUC, AP, F1 on index/25, severity r,
    latency mean/p95, gate counts, n. ``scored`` should be persisted by the
    caller; each part is one aggregation over it."""
    s = scored.withColumn("_y", scoring.normalised(index, high))
    basic = s.agg(
        F.round(F.corr(F.col(index).cast("double"), F.col(severity).cast("double")), 4)
        .alias("severity_pearson_r"),
        F.count_if(F.col(gate_col) == "AUTO_USE").alias("gate_auto_use"),
        F.count_if(F.col(gate_col) == "REVIEW").alias("gate_review"),
        F.count_if(F.col(gate_col) == "BLOCK").alias("gate_block"),
        F.count(F.lit(1)).alias("n_test"),
        *([F.round(F.avg(duration), 3).alias("avg_latency_ms")] if duration else []),
    )
    ranks = rank_metrics(s, label, "_y", threshold=threshold).select(
        F.round("auc_roc", 4).alias("auc_roc"), F.round("avg_precision", 4).alias("avg_precision"),
        F.round("f1", 4).alias("f1"))
    tail = [exact_percentile(s, duration, 0.95).select(F.round("percentile", 3).alias("p95_latency_ms"))] if duration else []
    return _combine_rows([ranks, basic, *tail])


def _combine_rows(parts: list[DataFrame], by: tuple = ()) -> DataFrame:
    """Put one-row (or one-row-per-key) results side by side without a join:
    each part fills its own columns, the rest are null; union, then take the
    single non-null value per column."""
    cols: list[str] = []
    types: dict[str, str] = {}
    for p in parts:
        for name, t in p.dtypes:
            if name not in by and name not in types:
                cols.append(name)
                types[name] = t
    aligned = [p.select(*by, *[F.col(c) if c in p.columns else F.lit(None).cast(types[c]).alias(c)
                               for c in cols]) for p in parts]
    u = aligned[0]
    for a in aligned[1:]:
        u = u.unionByName(a)
    aggs = [F.first(c, ignorenulls=True).alias(c) for c in cols]
    return (u.groupBy(*by) if by else u).agg(*aggs)


def method_compare(methods: Mapping[str, DataFrame] | Mapping[str, str], label: str,
                   score: str | None = None, threshold: float = fixed.PREDICT_THRESHOLD,
                   df: DataFrame | None = None) -> DataFrame:
    """One row per method with AUC, AP, F1 (U3), all from one grouped pass
    keyed by method.

    Either ``methods`` maps names to DataFrames holding ``label`` and ``score``
    (stacked with ``unionByName``), or ``df`` is given and ``methods`` maps names
    to its score columns: then one scan is exploded into (method, label, score)
    rows, so the input is read once whatever the number of methods.
    """
    if df is not None:
        stack = F.explode(F.array(*[F.struct(F.lit(name).alias("method"),
                                             F.col(col).cast("double").alias("_score"))
                                    for name, col in methods.items()]))
        long = df.select(F.col(label).alias("_lab"), stack.alias("m")) \
                 .select("m.method", "_lab", "m._score")
    else:
        long = None
        for name, part_df in methods.items():
            part = part_df.select(F.lit(name).alias("method"), F.col(label).alias("_lab"),
                                  F.col(score).cast("double").alias("_score"))
            long = part if long is None else long.unionByName(part)
    out = rank_metrics(long, "_lab", "_score", by=["method"], threshold=threshold)
    return out.select("method", F.round("auc_roc", 4).alias("auc_roc"),
                      F.round("avg_precision", 4).alias("avg_precision"),
                      F.round("f1", 4).alias("f1"))
