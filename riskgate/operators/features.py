"""Feature vectors: pooling, scaling statistics, projection and applying given
probe weights (A14, A15, M3, M12-M14, J7).

Vectors are ``array<float>`` at rest and ``VectorUDT`` only inside aggregation /
ML stages. Means over rows use ``Summarizer`` — one vector-valued aggregate with
map-side partial merge — so a sample with very many token states is reduced in
the tasks that read it, not shipped whole to one reducer.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskgate import fixed
from riskgate.functions import draws


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def layer_pool(states: DataFrame, sample: str = "sample_id", layer: str = "layer",
               vec: str = "vec", weights: Sequence[float] = fixed.LAYER_WEIGHTS,
               out: str = "features") -> DataFrame:
    """Mean over the token states of each layer, then the weighted sum over
    layers (A14). The first aggregate (sample, layer) combines map-side, so
    token-level rows never cross the network; the second adds at most
    ``len(weights)`` vectors per sample. A missing layer contributes nothing."""
    v = array_to_vector(F.col(vec).cast("array<double>"))
    means = states.groupBy(sample, layer).agg(Summarizer.mean(v).alias("_m"))
    w = F.array(*[F.lit(float(x)) for x in weights])
    scale = F.try_element_at(w, (F.col(layer) + 1).cast("int"))
    weighted = means.filter(scale.isNotNull()).select(
        sample, array_to_vector(F.transform(vector_to_array(F.col("_m")), lambda x: x * scale)).alias("_w"))
    pooled = weighted.groupBy(sample).agg(Summarizer.sum(F.col("_w")).alias("_s"))
    return pooled.select(sample, vector_to_array(F.col("_s")).alias(out))


def scale_stats(df: DataFrame, vec: str = "features", population: bool = True) -> DataFrame:
    """Per-dimension mean and standard deviation in one aggregate.

    ``population`` divides by n (the convention of the fitted scaler being
    reproduced); otherwise by n - 1. Output: one row per dimension.
    """
    v = array_to_vector(F.col(vec).cast("array<double>"))
    s = df.agg(Summarizer.metrics("mean", "variance", "count").summary(v).alias("s"))
    n = F.col("s.count").cast("double")
    var = vector_to_array(F.col("s.variance"))
    factor = F.when(n > 1, (n - 1) / n).otherwise(F.lit(0.0)) if population else F.lit(1.0)
    s = s.select(F.posexplode(F.arrays_zip(vector_to_array(F.col("s.mean")).alias("mean"),
                                           F.transform(var, lambda x: F.sqrt(x * factor)).alias("std")))
                 .alias("dim", "m"))
    return s.select("dim", F.col("m.mean").alias("mean"), F.col("m.std").alias("std"))


def scaler_arrays(stats: DataFrame) -> tuple[list[float], list[float]]:
    """Collect (mean, std) per dimension — size bounded by the dimension, not the
    data. A zero std becomes 1 (the column is centred, not scaled)."""
    rows = sorted(stats.collect(), key=lambda r: r["dim"])
    means = [float(r["mean"]) for r in rows]
    stds = [float(r["std"]) if r["std"] and r["std"] > 0 else 1.0 for r in rows]
    return means, stds


def linear_apply(df: DataFrame, vec: str, weights: Sequence[float], bias: float,
                 means: Sequence[float] | None = None, stds: Sequence[float] | None = None,
                 out: str = "probability") -> DataFrame:
    """sigmoid(((x - mean) / std) . w + b) for given weights (M12): a fitted scaler
    and logistic probe as one JVM-side array fold."""
    x = F.col(vec).cast("array<double>")
    if means is not None:
        m = F.array(*[F.lit(float(a)) for a in means])
        s = F.array(*[F.lit(float(a)) for a in stds])
        x = F.zip_with(F.zip_with(x, m, lambda a, b: a - b), s, lambda a, b: a / b)
    w = F.array(*[F.lit(float(a)) for a in weights])
    z = F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda acc, y: acc + y) + F.lit(float(bias))
    return df.withColumn(out, 1.0 / (1.0 + F.exp(-z)))


def expected_risk(probabilities, labels: Sequence[float] = fixed.RISK_CLASS_WEIGHTS,
                  low: float = 1.0, high: float = 5.0) -> Column:
    """sum_k p_k * weight_of_class_k, clipped to [low, high] (M3). Weights are
    by class label (the k-th probability belongs to class k), fixing D3."""
    w = F.array(*[F.lit(float(v)) for v in labels])
    s = F.aggregate(F.zip_with(_col(probabilities).cast("array<double>"), w, lambda p, c: p * c),
                    F.lit(0.0), lambda acc, y: acc + y)
    return F.greatest(F.lit(low), F.least(F.lit(high), s))


def softmax(values) -> Column:
    """Softmax of an array column (stable: the max is subtracted).

    Lambdas re-evaluate any outside expression per element, so the max and the
    normaliser are computed once by a fold and handed to every element through
    ``array_repeat`` (whose argument is evaluated once): linear in the length.
    """
    v = _col(values).cast("array<double>")
    init = F.struct(F.array_max(v).alias("m"), F.lit(0.0).alias("d"))
    stats = F.aggregate(v, init, lambda acc, x: F.struct(acc["m"].alias("m"),
                                                         (acc["d"] + F.exp(x - acc["m"])).alias("d")))
    pairs = F.arrays_zip(v.alias("x"), F.array_repeat(stats, F.size(v)).alias("s"))
    return F.transform(pairs, lambda p: F.exp(p["x"] - p["s"]["m"]) / p["s"]["d"])


def draw_matrix(seed: int, rows: int, cols: int, stream: str = "proj",
                shift: float = 0.5) -> np.ndarray:
    """A fixed (rows x cols) matrix of hash draws minus ``shift``; entry (o, d)
    uses the key "o:d". Size depends on the dimensions only."""
    return np.array([[draws.unit_draw_py(seed, f"{o}:{d}", stream) - shift
                      for d in range(cols)] for o in range(rows)])


def stacked(col: pd.Series, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that hold a vector, their vectors as one matrix). Another length than
    the weights have is an error, never a cut."""
    have = col.notna().to_numpy()
    rows = [np.asarray(a, dtype=np.float64) for a in col[have]]
    wrong = next((len(r) for r in rows if len(r) != dim), None)
    if wrong is not None:
        raise ValueError(f"a vector has {wrong} dimensions, the weights have {dim}")
    return have, np.stack(rows) if rows else np.empty((0, dim))


def spread(have: np.ndarray, values: np.ndarray) -> pd.Series:
    out = pd.Series([None] * len(have), dtype=object)
    out[have] = pd.Series(list(values), index=np.flatnonzero(have), dtype=object)
    return out


def project(df: DataFrame, vec: str, matrix: np.ndarray, out: str = "projected") -> DataFrame:
    """W @ x for a fixed matrix (M14): one matrix product per Arrow batch in a
    pandas UDF; the matrix ships once with the function (dimension-bounded). A
    null vector gives null; a vector of another length is an error."""
    w = np.asarray(matrix, dtype=np.float64)
    in_dim = w.shape[1]

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def _proj(col: pd.Series) -> pd.Series:
        have, x = stacked(col, in_dim)
        return spread(have, x @ w.T)

    return df.withColumn(out, _proj(F.col(vec)))


def relu_apply(df: DataFrame, vec: str, layers: Sequence[tuple[np.ndarray, np.ndarray]],
               means: Sequence[float] | None = None, stds: Sequence[float] | None = None,
               out: str = "probability") -> DataFrame:
    """Forward pass of an imported ReLU network with softmax output.

    ``layers`` is [(W, b), ...] with W shaped (in, out). One matrix product per
    layer per Arrow batch. A null vector gives null; another length is an error.
    """
    mats = [(np.asarray(W, dtype=np.float64), np.asarray(b, dtype=np.float64)) for W, b in layers]
    mu = None if means is None else np.asarray(means, dtype=np.float64)
    sd = None if stds is None else np.asarray(stds, dtype=np.float64)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def _fwd(col: pd.Series) -> pd.Series:
        have, h = stacked(col, mats[0][0].shape[0])
        if mu is not None:
            h = (h - mu) / sd
        for i, (W, b) in enumerate(mats):
            h = h @ W + b
            if i < len(mats) - 1:
                h = np.maximum(h, 0.0)
        e = np.exp(h - h.max(axis=1, keepdims=True, initial=-np.inf))
        return spread(have, e / e.sum(axis=1, keepdims=True))

    return df.withColumn(out, _fwd(F.col(vec)))


def to_long(df: DataFrame, key: str, vec: str, value: str = "value") -> DataFrame:
    """(key, dim, value) rows from an array column, for reports and checks."""
    return df.select(key, F.posexplode(vec).alias("dim", value))
