"""Probe fitting on a planted-signal fixture: the features are drawn first and
the labels derived from them, never the reverse."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskgate.functions import draws
from riskgate.operators import features as FT
from riskgate.operators.probes import RiskProbes, RiskProbesModel, confidence_baseline

DIM = 16


def planted(spark, n=1000, drop_bin=None):
    rows = []
    for i in range(n):
        x = [draws.unit_draw_py(5, i * 100 + d, "x") * 2 - 1 for d in range(DIM)]
        label = int(x[0] + x[1] + x[2] > 0)
        sev = min(24.9, max(0.0, (x[3] + x[4] + 2) / 4 * 25))
        if drop_bin is not None and int(sev // 5) == drop_bin:
            continue
        rows.append((i, x, label, sev))
    return spark.createDataFrame(rows, "sample_id long, features array<double>, true_label int, true_severity double")


@pytest.fixture(scope="module")
def fitted(spark):
    df = planted(spark)
    return df, RiskProbes(mlp_max_rounds=4, mlp_patience=2).fit(df)


def test_fit_quality_on_planted_signal(fitted):
    _, model = fitted
    assert model.stats["probe_c_auc"] > 0.9
    assert model.stats["probe_v_auc"] > 0.8
    assert model.stats["probe_r_acc"] > 0.3
    assert model.stats["n_samples"] == 1000


def test_scores_in_range_and_gates_agree(fitted):
    df, model = fitted
    out = model.transform(df).select("uncertainty_score", "risk_score", "causal_violation_prob", "risk_index", "gate").collect()
    for r in out:
        assert 0 <= r.uncertainty_score <= 1 and 1 <= r.risk_score <= 5 and 0 <= r.causal_violation_prob <= 1
        assert 0 <= r.risk_index <= 25
        assert r.gate == ("AUTO_USE" if r.risk_index < 5 else "REVIEW" if r.risk_index < 20 else "BLOCK")


def test_labels_do_not_leak_into_scores(fitted):
    df, model = fitted
    a = model.transform(df).select("sample_id", "risk_index")
    permuted = df.withColumn("true_label", 1 - F.col("true_label")).withColumn("true_severity", F.lit(0.0))
    b = model.transform(permuted).select("sample_id", "risk_index")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_clean_mean_below_hallucinated_mean(fitted):
    df, model = fitted
    m = {r.true_label: r.m for r in model.transform(df).groupBy("true_label").agg(F.avg("risk_index").alias("m")).collect()}
    assert m[0] < m[1]


def test_sparse_weights_prefer_signal_dims(spark, fitted):
    _, model = fitted
    w = {r.dim: abs(r.weight) for r in model.sparse_weights(spark).collect()}
    top = sorted(w, key=w.get, reverse=True)[:2]
    assert set(top) <= {3, 4}   # violation is planted in dims 3 and 4


def test_too_few_rows(spark):
    with pytest.raises(ValueError):
        RiskProbes().fit(planted(spark, n=49))


def test_save_load_round_trip(spark, fitted, tmp_dir):
    df, model = fitted
    model.save(tmp_dir + "/model")
    again = RiskProbesModel.load(tmp_dir + "/model")
    a = sorted(map(tuple, model.transform(df).select("sample_id", "risk_index").collect()))
    b = sorted(map(tuple, again.transform(df).select("sample_id", "risk_index").collect()))
    assert a == b
    assert again.stats == model.stats


def test_expected_risk_weights_by_class_label(spark):
    # probability mass on class 4 must weigh 5 even when some bins never occur (D3)
    df = spark.createDataFrame([([0.0, 0.0, 0.0, 0.0, 1.0],), ([0.5, 0.5, 0.0, 0.0, 0.0],)], "p array<double>")
    got = [r[0] for r in df.select(FT.expected_risk("p")).collect()]
    assert got == [5.0, 1.5]


def test_confidence_baseline(spark):
    df = planted(spark, n=400)
    out = confidence_baseline(df.filter("sample_id % 5 <> 0"), df.filter("sample_id % 5 = 0"))
    rows = out.select("true_label", "confidence_score").collect()
    pos = np.mean([r[1] for r in rows if r[0] == 1])
    neg = np.mean([r[1] for r in rows if r[0] == 0])
    assert pos > neg


def test_relu_apply_matches_numpy(spark):
    rng = np.random.default_rng(0)
    W1, b1 = rng.normal(size=(4, 3)), rng.normal(size=3)
    W2, b2 = rng.normal(size=(3, 5)), rng.normal(size=5)
    X = rng.normal(size=(6, 4))
    df = spark.createDataFrame([(i, X[i].tolist()) for i in range(6)], "k int, v array<double>")
    got = {r.k: r.probability for r in FT.relu_apply(df, "v", [(W1, b1), (W2, b2)]).collect()}
    h = np.maximum(X @ W1 + b1, 0) @ W2 + b2
    e = np.exp(h - h.max(axis=1, keepdims=True))
    want = e / e.sum(axis=1, keepdims=True)
    for i in range(6):
        assert np.allclose(got[i], want[i])


def test_project_and_linear_apply_match_numpy(spark):
    rng = np.random.default_rng(1)
    X = rng.normal(size=(10, 8))
    df = spark.createDataFrame([(i, X[i].tolist()) for i in range(10)], "k int, v array<double>")
    M = FT.draw_matrix(7, 3, 8)
    got = {r.k: r.projected for r in FT.project(df, "v", M).collect()}
    for i in range(10):
        assert np.allclose(got[i], M @ X[i])
    w = rng.normal(size=8)
    mu, sd = X.mean(axis=0), X.std(axis=0)
    got = {r.k: r.probability for r in FT.linear_apply(df, "v", w.tolist(), 0.3, mu.tolist(), sd.tolist()).collect()}
    want = 1 / (1 + np.exp(-(((X - mu) / sd) @ w + 0.3)))
    for i in range(10):
        assert got[i] == pytest.approx(want[i])


def test_wide_null_and_mismatched_vectors(spark):
    wide = [float(k % 7) for k in range(1500)]
    df = spark.createDataFrame([(1, wide), (2, None)], "k int, v array<double>")
    M = FT.draw_matrix(7, 3, 1500)
    assert len({M[o, d] for o in range(3) for d in range(1500)}) > 4400      # no two entries share a draw key
    got = {r.k: r.projected for r in FT.project(df, "v", M).collect()}
    assert np.allclose(got[1], M @ np.array(wide)) and got[2] is None
    W1 = np.ones((1500, 2))
    p = {r.k: r.probability for r in FT.relu_apply(df, "v", [(W1, np.zeros(2))]).collect()}
    assert np.allclose(p[1], [0.5, 0.5]) and p[2] is None
    with pytest.raises(Exception, match="1500 dimensions, the weights have 4"):
        FT.project(df, "v", np.ones((3, 4))).collect()


def test_layer_pool_matches_numpy(spark):
    rng = np.random.default_rng(2)
    rows = [(s, l, p, rng.normal(size=4).tolist()) for s in range(3) for l in range(3) for p in range(4)]
    df = spark.createDataFrame(rows, "sample_id long, layer int, token_pos int, vec array<double>")
    got = {r.sample_id: r.features for r in FT.layer_pool(df).collect()}
    for s in range(3):
        want = sum(w * np.mean([v for (ss, l, _, v) in rows if ss == s and l == li], axis=0)
                   for li, w in enumerate([0.2, 0.5, 0.3]))
        assert np.allclose(got[s], want)


def test_softmax_matches_numpy(spark):
    vals = [[1.0, 2.0, 3.0], [0.0], [-5.0, 5.0, 0.0, 1.0], [700.0, 699.0]]
    df = spark.createDataFrame([(v,) for v in vals], "v array<double>")
    got = [r.p for r in df.select(FT.softmax("v").alias("p")).collect()]
    for g, v in zip(got, vals):
        e = np.exp(np.array(v) - max(v))
        assert np.allclose(g, e / e.sum())


def _scaled_planted(spark, n=400):
    rows = planted(spark, n=n).collect()
    X = np.array([r.features for r in rows])
    y = np.array([r.true_label for r in rows], dtype=float)
    Xs = (X - X.mean(axis=0)) / X.std(axis=0, ddof=1)
    return Xs, y


def _lr_fit(spark, Xs, y, reg, l1):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors
    df = spark.createDataFrame([(Vectors.dense(x.tolist()), float(t)) for x, t in zip(Xs, y)], ["f", "y"])
    m = LogisticRegression(featuresCol="f", labelCol="y", regParam=reg, elasticNetParam=1.0 if l1 else 0.0,
                           standardization=False, tol=1e-12, maxIter=500).fit(df)
    return m.coefficients.toArray(), m.intercept


def test_l2_probe_matches_newton_solve(spark):
    Xs, y = _scaled_planted(spark)
    n, d = Xs.shape
    C = 1.0
    lam = 1.0 / (C * n)                      # the mapping used by the uncertainty probe
    w_spark, b_spark = _lr_fit(spark, Xs, y, lam, l1=False)
    A = np.hstack([Xs, np.ones((n, 1))])
    theta = np.zeros(d + 1)
    pen = np.r_[np.full(d, lam), 0.0]        # intercept not penalised
    for _ in range(50):
        p = 1 / (1 + np.exp(-A @ theta))
        g = A.T @ (p - y) / n + pen * theta
        H = (A.T * (p * (1 - p))) @ A / n + np.diag(pen)
        theta -= np.linalg.solve(H, g)
    assert np.allclose(w_spark, theta[:d], atol=1e-4)
    assert abs(b_spark - theta[d]) < 1e-4


def test_l1_probe_satisfies_kkt(spark):
    Xs, y = _scaled_planted(spark)
    n, d = Xs.shape
    lam = 1.0 / (0.5 * n)                    # C = 0.5, the violation probe's mapping
    w, b = _lr_fit(spark, Xs, y, lam, l1=True)
    p = 1 / (1 + np.exp(-(Xs @ w + b)))
    grad = Xs.T @ (p - y) / n
    assert abs(np.mean(p - y)) < 1e-4       # intercept: unpenalised stationarity
    for j in range(d):
        if abs(w[j]) > 1e-8:
            assert abs(grad[j] + lam * np.sign(w[j])) < 1e-4
        else:
            assert abs(grad[j]) <= lam + 1e-4
    assert 0 < np.sum(np.abs(w) > 1e-8) < d  # sparse but not empty


def test_large_training_set_path_checkpoints(spark):
    # rows_per_partition below the row count: the training set takes the reliable checkpoint path
    model = RiskProbes(rows_per_partition=100, mlp_max_rounds=1, mlp_patience=1).fit(planted(spark, n=400))
    assert model.stats["n_samples"] == 400 and model.stats["probe_c_auc"] > 0.9


def test_violation_falls_back_to_hallucination_label(spark):
    # every severity <= 15: one violation class in training, so the violation
    # probe is fitted on the hallucination label instead
    df = planted(spark, n=300).withColumn("true_severity", F.lit(3.0))
    model = RiskProbes(mlp_max_rounds=1, mlp_patience=1).fit(df)
    assert model.stats["violation_label"] == "hallucination"
    assert model.stats["probe_v_auc"] > 0.8          # the label is learnable from dims 0-2
