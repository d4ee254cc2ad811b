"""The three probes as a fit and a transform.

``RiskProbes.fit(df)`` returns a ``RiskProbesModel``; a model exists only after
fitting, so "score before fit" cannot be written (F6). Scoring is one narrow
``transform``: one pandas UDF for the three probes (matrix products per Arrow
batch) and the index expressions, no shuffle.

Objectives. A logistic probe with inverse strength C minimises C * sum(loss) +
penalty, so the mean loss is penalised by 1 / (C * n_train); the scaler divides by
the population standard deviation. The risk probe has ReLU hidden units and stops
early on a held-out tenth of the training rows. All are fitted by
:mod:`riskgate.operators.solvers`. A fitted model is a table of weights (probe,
layer, row, dim, weight), in which form it is saved, loaded and audited.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from riskgate import fixed
from riskgate.functions import draws, scoring
from riskgate.operators import evaluate as E
from riskgate.operators import features as FT
from riskgate.operators import solvers as S
from riskgate.operators.split import require_rows, stratified_split
from riskgate.session import cut_lineage


@dataclass
class ProbeParams:
    features_col: str = "features"
    label_col: str = "true_label"
    severity_col: str = "true_severity"
    key_col: str = "sample_id"
    terms_col: str | None = None
    test_fraction: float = fixed.SPLIT_TEST_FRACTION
    seed: int = fixed.SPLIT_SEED
    uncertainty_c: float = fixed.UNCERTAINTY_C
    violation_c: float = fixed.VIOLATION_C
    hidden_layers: Sequence[int] = field(default_factory=lambda: list(fixed.RISK_HIDDEN_LAYERS))
    classes: int = fixed.RISK_CLASSES
    risk_l2: float = 1e-4
    rows_per_partition: int = 200_000
    mlp_round_iter: int = 8
    mlp_max_rounds: int = 10
    mlp_patience: int = 2
    mlp_validation_fraction: float = 0.1
    min_rows: int = fixed.MIN_FIT_ROWS


Scale = tuple[np.ndarray, np.ndarray]


def _training_rows(df: DataFrame, p: ProbeParams) -> DataFrame:
    """(_x, _y, _violation, _bin, _held): what the passes of a fit read."""
    held = draws.unit_draw(p.seed, F.col(p.key_col), "mlp_validation") < p.mlp_validation_fraction
    return df.select(F.col(p.features_col).cast("array<double>").alias("_x"), F.col(p.label_col).cast("double").alias("_y"),
                     scoring.violation_label(p.severity_col).cast("double").alias("_violation"),
                     scoring.risk_bin(p.severity_col).cast("double").alias("_bin"), held.cast("double").alias("_held"))


def _scale(rows: DataFrame) -> Scale:
    means, stds = FT.scaler_arrays(FT.scale_stats(rows, "_x"))
    return np.array(means), np.array(stds)


def _kept(rows: DataFrame, n: int, p: ProbeParams) -> DataFrame:
    """The training rows in partitions of ``rows_per_partition``, checkpointed to the shared
    folder, so that a lost executor does not replay what made them, and held in memory,
    as every pass reads them."""
    parts = max(1, -(-n // p.rows_per_partition))
    return cut_lineage(rows.coalesce(parts)).persist(StorageLevel.MEMORY_AND_DISK)


def _logistic(label: str, c: float, n: int, l1: bool) -> S.Logistic:
    return S.Logistic(label, 1.0 / (c * n), l1)


def _network(rows: DataFrame, dim: int, scale: Scale, n: int, p: ProbeParams) -> S.Network:
    return S.Network(rows, "_x", "_bin", "_held", [dim, *p.hidden_layers, p.classes], scale, p.risk_l2 / n)


def stationarity(df: DataFrame, params: ProbeParams, tolerance: float = 1e-6) -> DataFrame:
    """(probe, dim, stationary): whether the fitted logistic probes satisfy the optimality
    condition of their objective in each dimension. With g the mean gradient of the loss
    and r the penalty: |g + r w| is small for L2; for L1, |g + r sign(w)| is small where w
    is not 0, and |g| is at most r elsewhere. Small is ``tolerance``, or a thousandth of r
    if that is less. The gradient is a DataFrame aggregate, apart from the solver's."""
    p = params
    rows = _training_rows(df, p).persist(StorageLevel.MEMORY_AND_DISK)
    n, scale = rows.count(), _scale(rows)
    dim = len(scale[0])
    probes = S.fit_logistic(rows, "_x", [_logistic("_y", p.uncertainty_c, n, False),
                                         _logistic("_violation", p.violation_c, n, True)], dim, n, scale)
    rows.unpersist()
    means, stds = (F.lit(v.tolist()) for v in scale)
    scaled = F.zip_with(F.zip_with("_x", means, lambda a, b: a - b), stds, lambda a, b: a / b)
    base = _training_rows(df, p).select("_y", "_violation", scaled.alias("_x"))
    parts = []
    for name, probe in zip(("uncertainty", "violation"), probes, strict=True):
        w = F.lit(probe.weights.tolist())
        z = F.aggregate(F.zip_with("_x", w, lambda a, b: a * b), F.lit(probe.intercept), lambda acc, v: acc + v)
        error = (1.0 / (1.0 + F.exp(-z)) - F.col(probe.label)).alias("e")
        by_dim = base.select("_x", error).select(F.posexplode("_x").alias("dim", "x"), "e").groupBy("dim") \
            .agg(F.avg(F.col("x") * F.col("e")).alias("g")).withColumn("w", F.element_at(w, F.col("dim") + 1))
        r = probe.penalty
        if probe.l1:
            residual = F.when(F.col("w") != 0, F.abs(F.col("g") + r * F.signum("w"))) \
                .otherwise(F.greatest(F.lit(0.0), F.abs("g") - r))
        else:
            residual = F.abs(F.col("g") + r * F.col("w"))
        parts.append(by_dim.select(F.lit(name).alias("probe"), "dim", (residual < min(tolerance, r / 1000)).alias("stationary")))
    return parts[0].unionByName(parts[1])


def risk_descent(df: DataFrame, params: ProbeParams, steps: int = 8, directions: int = 12, h: float = 1e-5) -> DataFrame:
    """(check, place, holds) of the risk probe's fit: whether the objective falls in each
    step, and whether the gradient equals central differences of the objective along
    ``directions`` seeded directions, at the start and at the end."""
    p = params
    rows = _training_rows(df, p).persist(StorageLevel.MEMORY_AND_DISK)
    n, scale = rows.count(), _scale(rows)
    net = _network(rows, len(scale[0]), scale, n, p)
    start = S.packed(S.first_layers(net.sizes, p.seed))
    path = list(S.descend(net, start, steps))
    out = [("objective falls", k, bool(path[k].loss < path[k - 1].loss)) for k in range(1, len(path))]
    draw = np.random.default_rng(p.seed + 1)
    for name, point in (("gradient at the start", path[0]), ("gradient at the end", path[-1])):
        ways = [w / np.linalg.norm(w) for w in draw.normal(size=(directions, len(start)))]
        ends = net.at(*[point.theta + sign * h * w for w in ways for sign in (1, -1)])
        for k, w in enumerate(ways):
            slope = (ends[2 * k].loss - ends[2 * k + 1].loss) / (2 * h)
            out.append((name, k, bool(abs(slope - point.gradient @ w) < 1e-4 * max(1.0, abs(slope)))))
    rows.unpersist()
    return df.sparkSession.createDataFrame(out, "check string, place int, holds boolean")


class RiskProbes:
    """Estimator for the uncertainty (L2 logistic), risk (ReLU network, 5 classes)
    and violation (L1 logistic) probes."""

    def __init__(self, **params):
        self.params = ProbeParams(**params)

    def fit(self, df: DataFrame, validation: DataFrame | None = None) -> "RiskProbesModel":
        """Fits on ``df`` and validates on ``validation``; without it, ``df`` is split
        by label first. Only the key, the labels and the vector are kept. The validation
        figures in the stats are those of ``validation``: hand in rows that no later
        figure is taken from, or none."""
        p = self.params
        t0 = time.time()
        require_rows(df, p.min_rows)
        needed = [p.key_col, p.label_col, p.severity_col, p.features_col]
        if validation is None:
            split = stratified_split(df.select(*needed), p.label_col, p.key_col, p.test_fraction, p.seed)
        else:
            split = df.select(*needed, F.lit("train").alias("split")).unionByName(
                validation.select(*needed, F.lit("test").alias("split")))
        split = split.persist(StorageLevel.MEMORY_AND_DISK)
        train, test = (split.filter(F.col("split") == side) for side in ("train", "test"))
        violation = scoring.violation_label(p.severity_col)
        counts = {r["split"]: r for r in split.groupBy("split").agg(
            F.count(F.lit(1)).alias("n"), F.countDistinct(violation).alias("nv"),
            F.count_if(F.col(p.label_col) == 1).alias("h")).collect()}
        n_train, both = int(counts["train"]["n"]), counts["train"]["nv"] > 1
        rows = _kept(_training_rows(train, p), n_train, p)
        scale = _scale(rows)
        dim = len(scale[0])
        probes = [_logistic("_y", p.uncertainty_c, n_train, False),
                  _logistic("_violation" if both else "_y", p.violation_c, n_train, True)]
        net = _network(rows, dim, scale, n_train, p)
        # the logistic probes share their passes; the network's run beside them
        with ThreadPoolExecutor(max_workers=2) as pool:
            logistic = pool.submit(S.fit_logistic, rows, "_x", probes, dim, n_train, scale)
            risk = pool.submit(S.fit_network, net, p.seed, p.mlp_round_iter, p.mlp_max_rounds, p.mlp_patience)
            (u, v), r = logistic.result(), risk.result()
        rows.unpersist()
        weights = ProbeWeights(scale, (u.weights, u.intercept), (v.weights, v.intercept), S.unpacked(r.theta, net.sizes))

        scored = test.select("*", _outputs(weights, p.features_col).alias("_out"))
        label = violation if both else F.col(p.label_col)
        long = scored.select(F.lit("c").alias("probe"), F.col(p.label_col).alias("_lab"), F.col("_out.uncertainty").alias("_s")) \
            .unionByName(scored.select(F.lit("v").alias("probe"), label.cast("int").alias("_lab"), F.col("_out.violation").alias("_s")))
        aucs = E.rank_metrics(long, "_lab", "_s", by=["probe"]).select("probe", "auc_roc")
        guess = F.array_position("_out.classes", F.array_max("_out.classes")) - 1
        acc = E.class_accuracy(scored.select(guess.cast("double").alias("_guess"), scoring.risk_bin(p.severity_col).cast("double").alias("_bin")),
                               "_guess", "_bin").select(F.lit("r").alias("probe"), F.col("accuracy").alias("auc_roc"))
        metrics = {x["probe"]: x["auc_roc"] for x in aucs.unionByName(acc).collect()}   # one action
        split.unpersist()
        total = {k: sum(int(x[k]) for x in counts.values()) for k in ("n", "h")}

        def rounded(name: str) -> float | None:
            return None if metrics.get(name) is None else round(float(metrics[name]), 4)

        stats = {"probe_c_auc": rounded("c"), "probe_r_acc": rounded("r"), "probe_v_auc": rounded("v"),
                 "train_time_s": round(time.time() - t0, 3), "n_samples": total["n"], "n_hallucinated": total["h"],
                 "n_clean": total["n"] - total["h"], "violation_label": "violation" if both else "hallucination"}
        return RiskProbesModel(p, weights, stats)


class ProbeWeights(NamedTuple):
    """All that a fit learns: scaler, (weights, intercept) of the logistic probes, and
    (matrix, intercepts) of each layer of the risk probe."""
    scale: Scale
    uncertainty: tuple[np.ndarray, float]
    violation: tuple[np.ndarray, float]
    risk: list[tuple[np.ndarray, np.ndarray]]

    def rows(self) -> Iterator[tuple[str, int, int, int, float]]:
        """(probe, layer, row, dim, weight): row is the output, dim the input, -1 for the
        constant input. The scaler has row 0 for means and row 1 for deviations."""
        for row, values in enumerate(self.scale):
            yield from (("scaler", 0, row, d, float(x)) for d, x in enumerate(values))
        for name in ("uncertainty", "violation"):
            w, b = getattr(self, name)
            yield from ((name, 0, 0, d, float(x)) for d, x in enumerate(w))
            yield name, 0, 0, -1, float(b)
        for layer, (w, b) in enumerate(self.risk):
            yield from (("risk", layer, o, d, float(w[d, o])) for d in range(w.shape[0]) for o in range(w.shape[1]))
            yield from (("risk", layer, o, -1, float(x)) for o, x in enumerate(b))

    @classmethod
    def of(cls, table: DataFrame) -> "ProbeWeights":
        """From the table, which has as many rows as the probes have weights."""
        found: dict[tuple[str, int], dict[tuple[int, int], float]] = {}
        for r in table.select("probe", "layer", "row", "dim", "weight").toLocalIterator():
            found.setdefault((r["probe"], r["layer"]), {})[r["row"], r["dim"]] = r["weight"]

        def matrix(key) -> np.ndarray:
            cells = found[key]
            rows, dims = (1 + max(k[i] for k in cells) for i in (0, 1))
            out = np.zeros((rows, dims + 1))
            for (row, dim), x in cells.items():
                out[row, dim] = x  # -1 is the last column
            return out

        scaler = matrix(("scaler", 0))[:, :-1]
        parts = [matrix((name, 0))[0] for name in ("uncertainty", "violation")]
        layers = [matrix(("risk", k)) for k in range(sum(1 for name, _ in found if name == "risk"))]
        return cls((scaler[0], scaler[1]), *[(w[:-1], float(w[-1])) for w in parts],
                   [(np.ascontiguousarray(m[:, :-1].T), m[:, -1]) for m in layers])


_OUT = "uncertainty double, violation double, classes array<double>"


def _outputs(weights: ProbeWeights, vec: str) -> Column:
    """The outputs of all three probes for a vector, in one Arrow batch function; null for a
    null vector, an error for another length."""
    (mean, std), (wu, bu), (wv, bv) = weights.scale, weights.uncertainty, weights.violation
    layers = weights.risk

    @F.pandas_udf(_OUT)
    def apply(col: pd.Series) -> pd.DataFrame:
        have, x = FT.stacked(col, len(mean))
        x = (x - mean) / std
        out = {name: 1.0 / (1.0 + np.exp(-np.clip(x @ w + b, -700, 700)))
               for name, w, b in (("uncertainty", wu, bu), ("violation", wv, bv))}
        out["classes"] = S.forward(x, layers)[1]
        return pd.DataFrame({name: FT.spread(have, values) for name, values in out.items()})

    return apply(F.col(vec))


def _with_index(df: DataFrame) -> DataFrame:
    return (df.withColumn("risk_index", scoring.risk_index("uncertainty_score", "risk_score", "causal_violation_prob"))
              .withColumn("gate", scoring.gate("risk_index")))


class RiskProbesModel:
    """Fitted probes; ``transform`` appends the score columns (M7)."""

    def __init__(self, params: ProbeParams, weights: ProbeWeights, stats: dict):
        self.params, self.weights, self.stats = params, weights, stats

    def transform(self, df: DataFrame) -> DataFrame:
        p = self.params
        x = df.withColumn("_out", _outputs(self.weights, p.features_col))
        out = _with_index(x.withColumn("uncertainty_score", F.col("_out.uncertainty"))
                          .withColumn("risk_score", F.when(F.col("_out.classes").isNotNull(), FT.expected_risk(F.col("_out.classes"))))
                          .withColumn("causal_violation_prob", F.col("_out.violation")).drop("_out"))
        out = out.withColumn("explanation", scoring.explanation("uncertainty_score", "risk_score",
                                                                "causal_violation_prob", "gate"))
        if p.terms_col and p.terms_col in df.columns:
            out = out.withColumn("entity_count", scoring.term_count(p.terms_col))
        return out

    SUMMARY_SCHEMA = ("probe_c_auc double, probe_r_acc double, probe_v_auc double, train_time_s double, "
                      "n_samples long, n_hallucinated long, n_clean long, violation_label string")
    WEIGHTS_SCHEMA = "probe string, layer int, row int, dim int, weight double"

    def summary(self, spark: SparkSession) -> DataFrame:
        """Training record as a one-row DataFrame (M8); a metric that is
        undefined (one class in the validation rows) is null."""
        names = [f.split()[0] for f in self.SUMMARY_SCHEMA.split(", ")]
        return spark.createDataFrame([tuple(self.stats.get(n) for n in names)], self.SUMMARY_SCHEMA)

    def weight_table(self, spark: SparkSession) -> DataFrame:
        """All weights as long rows (K4)."""
        return spark.createDataFrame(list(self.weights.rows()), self.WEIGHTS_SCHEMA)

    def sparse_weights(self, spark: SparkSession) -> DataFrame:
        """Non-zero weights of the violation probe (M5): (dim, weight)."""
        return self.weight_table(spark).where("probe = 'violation' and dim >= 0 and weight <> 0").select("dim", "weight")

    def save(self, path: str) -> None:
        """Write the weight table, the parameters and the training record (K4)."""
        spark = SparkSession.getActiveSession()
        self.weight_table(spark).write.mode("overwrite").parquet(os.path.join(path, "weights"))
        meta = json.dumps({"params": asdict(self.params), "stats": self.stats})
        spark.createDataFrame([(meta,)], "meta string").coalesce(1).write.mode("overwrite") \
            .text(os.path.join(path, "meta"))

    @classmethod
    def load(cls, path: str) -> "RiskProbesModel":
        spark = SparkSession.getActiveSession()
        meta = json.loads(spark.read.text(os.path.join(path, "meta")).first()[0])
        weights = ProbeWeights.of(spark.read.schema(cls.WEIGHTS_SCHEMA).parquet(os.path.join(path, "weights")))
        return cls(ProbeParams(**meta["params"]), weights, meta["stats"])


def scores_by_table(df: DataFrame, weights: DataFrame, key: str, vec: str) -> DataFrame:
    """(key, uncertainty_score, risk_score, causal_violation_prob, risk_index, gate) from a
    saved weight table alone, all in DataFrame operations: vectors become (key, dim, x)
    rows, and each layer is a join with its weights and a sum per (key, row). Rows are
    dealt by key once and the sums stay there; the weights are broadcast, as they are
    bounded by the probes' sizes. It writes out every product: an independent form for
    audits and for stores without Python, where ``transform`` is the one for scoring.
    ``key`` must be unique; a null vector has no row."""
    w = weights.select("probe", "layer", "row", "dim", "weight")
    one = df.select(F.col(key).alias("_key"), F.col(vec).cast("array<double>").alias("_x")).repartition("_key")
    raw = one.select("_key", F.posexplode("_x").alias("dim", "x"))
    scaler = w.where("probe = 'scaler'").groupBy("dim").agg(
        F.max(F.when(F.col("row") == 0, F.col("weight"))).alias("mean"), F.max(F.when(F.col("row") == 1, F.col("weight"))).alias("std"))
    constant = one.where("_x is not null").select("_key", F.lit(-1).alias("dim"), F.lit(1.0).alias("x"))
    inputs = raw.join(F.broadcast(scaler), "dim").select("_key", "dim", ((F.col("x") - F.col("mean")) / F.col("std")).alias("x"))

    def layer(rows: DataFrame, condition: str) -> DataFrame:
        own = w.where(condition).select("probe", "row", "dim", "weight")
        return rows.unionByName(constant).join(F.broadcast(own), "dim").groupBy("_key", "probe", "row") \
            .agg(F.sum(F.col("x") * F.col("weight")).alias("z"))

    def sigmoid(name: str) -> Column:
        return F.max(F.when(F.col("probe") == name, 1.0 / (1.0 + F.exp(-F.col("z")))))

    depth = w.where("probe = 'risk'").agg(F.max("layer")).first()[0]
    first = layer(inputs, "layer = 0 and probe <> 'scaler'")
    logistic = first.where("probe <> 'risk'").groupBy("_key").agg(
        sigmoid("uncertainty").alias("uncertainty_score"), sigmoid("violation").alias("causal_violation_prob"))
    hidden = first.where("probe = 'risk'")
    for k in range(1, depth + 1):
        seen = hidden.select("_key", F.col("row").alias("dim"), F.greatest(F.lit(0.0), "z").alias("x"))
        hidden = layer(seen, f"layer = {k} and probe = 'risk'")
    classes = hidden.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("row", "z"))).alias("rows"))
    risk = classes.select("_key", FT.softmax(F.transform("rows", lambda r: r["z"])).alias("p")) \
        .select("_key", FT.expected_risk("p").alias("risk_score"))
    return _with_index(logistic.join(risk, "_key")).withColumnRenamed("_key", key)


def confidence_baseline(train: DataFrame, test: DataFrame, features_col: str = "features",
                        label_col: str = "true_label", c: float = fixed.UNCERTAINTY_C,
                        out: str = "confidence_score") -> DataFrame:
    """One L2 logistic probe on the features (M9); scores ``test``."""
    rows = train.select(F.col(features_col).cast("array<double>").alias("_x"), F.col(label_col).cast("double").alias("_y")) \
        .persist(StorageLevel.MEMORY_AND_DISK)
    n, scale = rows.count(), _scale(rows)
    (probe,) = S.fit_logistic(rows, "_x", [_logistic("_y", c, n, False)], len(scale[0]), n, scale)
    rows.unpersist()
    return FT.linear_apply(test, features_col, probe.weights.tolist(), probe.intercept, *[v.tolist() for v in scale], out=out)
