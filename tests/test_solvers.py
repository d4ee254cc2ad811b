"""The solvers against dense solutions in numpy, and the fitted probes as a weight table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskgate.operators import solvers as S
from riskgate.operators.probes import ProbeParams, ProbeWeights, RiskProbes, RiskProbesModel, risk_descent, scores_by_table, stationarity
from tests.test_probes import planted


def table(spark, n=300, dim=6, seed=0, parts=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    y = (x[:, 0] - x[:, 1] + rng.normal(size=n) > 0).astype(float)
    bins = np.clip((x[:, 2] * 2 + 2.5).astype(int), 0, 4).astype(float)
    held = (rng.random(n) < 0.1).astype(float)
    rows = spark.createDataFrame([(x[k].tolist(), float(y[k]), float(bins[k]), float(held[k])) for k in range(n)],
                                 "_x array<double>, _y double, _bin double, _held double").repartition(parts)
    return rows, x, y, bins, held


def test_sums_over_more_partitions_than_the_fan_in(spark):
    rows = spark.range(5000, numPartitions=3 * S.FAN_IN + 1).select(
        F.array(F.col("id").cast("double"), F.lit(2.0)).alias("v"), F.lit(1.0).alias("w"))
    got = S.summed(rows, "v", ["w"], lambda x, w: np.array([len(w), x.reshape(len(w), -1)[:, 0].sum() if len(w) else 0.0]))
    assert got.tolist() == [5000, 5000 * 4999 / 2]
    none = S.summed(rows.limit(0), "v", ["w"], lambda x, w: np.zeros(2))
    assert none.tolist() == [0, 0]


def test_ridge_and_lasso_probes_meet_their_conditions(spark):
    rows, x, y, _, _ = table(spark)
    scale = x.mean(axis=0), x.std(axis=0)
    probes = S.fit_logistic(rows, "_x", [S.Logistic("_y", 1 / 300, False), S.Logistic("_y", 0.05, True)], 6, 300, scale)
    a = np.hstack([(x - scale[0]) / scale[1], np.ones((300, 1))])
    for probe in probes:
        g = a.T @ (1 / (1 + np.exp(-a @ probe.theta)) - y) / 300
        assert S.optimality(probe, probe.theta, g).max() < 1e-7
        assert all(b <= a + 1e-12 for a, b in zip(probe.objective, probe.objective[1:]))
        assert len(probe.objective) <= 12                   # Newton steps, not hundreds of gradient passes
    assert (probes[1].weights == 0).any() and (probes[1].weights != 0).any()


def test_separable_labels_and_a_constant_feature(spark):
    rows, x, _, _, _ = table(spark)
    rows = rows.withColumn("_y", (F.col("_x")[0] > 0).cast("double")).withColumn("_x", F.concat("_x", F.array(F.lit(1.0))))
    scale = np.append(x.mean(axis=0), 1.0), np.append(x.std(axis=0), 1.0)
    probes = S.fit_logistic(rows, "_x", [S.Logistic("_y", 1 / 300, False), S.Logistic("_y", 2 / 300, True)], 7, 300, scale)
    assert all(p.residual < 1e-6 and p.weights[6] == pytest.approx(0, abs=1e-9) for p in probes)


def test_network_gradient_is_that_of_the_objective():
    rng = np.random.default_rng(3)
    sizes = [4, 5, 3]
    x, classes, held = rng.normal(size=(40, 4)), rng.integers(0, 3, 40), (rng.random(40) < 0.2).astype(float)
    theta = S.packed(S.first_layers(sizes, 1))
    length = len(theta)
    base = S.network_sums(x, classes, held, theta, sizes)
    assert len(base) == length + 5 and base[0] + base[-3] == 40
    for k in range(length):
        step = np.zeros(length)
        step[k] = 1e-6
        up, down = (S.network_sums(x, classes, held, theta + s * step, sizes)[1] for s in (1, -1))
        assert (up - down) / 2e-6 == pytest.approx(base[2 + k], rel=1e-4, abs=1e-5)
    layers = S.unpacked(theta, sizes)
    assert np.array_equal(S.packed(layers), theta)


def test_network_descends_and_learns(spark):
    rows, x, _, bins, held = table(spark, n=600)
    net = S.Network(rows, "_x", "_bin", "_held", [6, 16, 5], (x.mean(axis=0), x.std(axis=0)), 1e-6)
    losses = [p.loss for p in S.descend(net, S.packed(S.first_layers(net.sizes, 1)), 12)]
    assert all(b < a for a, b in zip(losses, losses[1:]))
    best = S.fit_network(net, 1, 8, 12, 3)
    assert best.held_accuracy > 0.6


def test_early_stopping_without_held_out_rows(spark):
    rows, x, _, _, _ = table(spark, n=80)
    net = S.Network(rows.withColumn("_held", F.lit(0.0)), "_x", "_bin", "_held", [6, 4, 5], (x.mean(axis=0), x.std(axis=0)), 1e-6)
    point = S.fit_network(net, 1, 2, 2, 1)
    assert point.held_accuracy is None and np.isfinite(point.loss)


def test_checks_hold_and_are_not_vacuous(spark, monkeypatch):
    df = planted(spark, n=200)
    assert all(r.stationary for r in stationarity(df, ProbeParams()).collect())
    assert all(r.holds for r in risk_descent(df, ProbeParams(), steps=4).collect())
    exact = S.fit_logistic

    def off(*args, **kwargs):
        probes = exact(*args, **kwargs)
        for p in probes:
            p.theta = p.theta * 1.001
        return probes

    monkeypatch.setattr(S, "fit_logistic", off)
    assert not all(r.stationary for r in stationarity(df, ProbeParams()).collect())


@pytest.fixture(scope="module")
def model(spark):
    return RiskProbes(mlp_max_rounds=2, mlp_patience=1).fit(planted(spark, n=300))


def test_weight_table_round_trip(spark, model):
    again = ProbeWeights.of(model.weight_table(spark))
    for a, b in zip(model.weights.scale, again.scale, strict=True):
        assert np.array_equal(a, b)
    assert np.array_equal(again.uncertainty[0], model.weights.uncertainty[0]) and again.violation[1] == model.weights.violation[1]
    assert all(np.array_equal(w, v) and np.array_equal(b, c) for (w, b), (v, c) in zip(model.weights.risk, again.risk, strict=True))


def test_scores_by_the_table_equal_transform(spark, model, tmp_dir):
    df = planted(spark, n=60).unionByName(spark.createDataFrame(
        [(900, None, 0, 0.0)], "sample_id long, features array<double>, true_label int, true_severity double"))
    model.save(tmp_dir + "/m")
    saved = spark.read.schema(RiskProbesModel.WEIGHTS_SCHEMA).parquet(tmp_dir + "/m/weights")
    own = {r.sample_id: r for r in scores_by_table(df, saved, "sample_id", "features").collect()}
    got = {r.sample_id: r for r in model.transform(df).collect()}
    assert set(own) == set(got) - {900} and got[900].risk_index is None and got[900].uncertainty_score is None
    for k, r in own.items():
        for c in ("uncertainty_score", "risk_score", "causal_violation_prob", "risk_index"):
            assert r[c] == pytest.approx(got[k][c], abs=1e-10)
        assert r.gate == got[k].gate


def test_vectors_of_another_length_are_an_error(spark, model):
    short = spark.createDataFrame([(1, [1.0, 2.0])], "sample_id long, features array<double>")
    with pytest.raises(Exception, match="dimensions"):
        model.transform(short).collect()
