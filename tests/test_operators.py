"""Operators against brute force on small fixtures, and invariance to the
number of partitions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskgate import fixed
from riskgate.functions import draws
from riskgate.operators import evaluate as E
from riskgate.operators import joins as J
from riskgate.operators import ranking
from riskgate.operators import report as R
from riskgate.operators import split as S
from riskgate.operators.ranking import running_sums


def py_auc(y, s):
    pos = [b for a, b in zip(y, s) if a == 1]
    neg = [b for a, b in zip(y, s) if a != 1]
    tot = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def py_ap(y, s):
    P = sum(y)
    ap = 0.0
    for t in sorted(set(s), reverse=True):
        sel = [a for a, b in zip(y, s) if b >= t]
        gain = sum(a for a, b in zip(y, s) if b == t)
        ap += gain / P * (sum(sel) / len(sel))
    return ap


@pytest.fixture()
def tied(spark):
    rows = [(i, int(draws.unit_draw_py(3, i, "y") < 0.35),
             round(draws.unit_draw_py(3, i, "s") * 0.7 + 0.3 * (draws.unit_draw_py(3, i, "y") < 0.35), 1))
            for i in range(300)]
    return rows, spark.createDataFrame(rows, "k long, y int, s double")


@pytest.mark.parametrize("parts", [1, 8])
def test_auc_ap_f1_brute_force(spark, tied, parts):
    rows, df = tied
    df = df.repartition(parts)
    y = [r[1] for r in rows]
    s = [r[2] for r in rows]
    assert E.roc_auc(df, "y", "s").first()[0] == pytest.approx(py_auc(y, s), abs=1e-12)
    assert E.average_precision(df, "y", "s").first()[0] == pytest.approx(py_ap(y, s), abs=1e-12)
    tp = sum(1 for a, b in zip(y, s) if a == 1 and b > 0.5)
    fp = sum(1 for a, b in zip(y, s) if a == 0 and b > 0.5)
    fn = sum(1 for a, b in zip(y, s) if a == 1 and b <= 0.5)
    assert E.f1_at(df, "y", "s", 0.5).first()[0] == pytest.approx(2 * tp / (2 * tp + fp + fn))


def test_auc_one_class_is_null(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2)], "y int, s double")
    assert E.roc_auc(df, "y", "s").first()[0] is None


def test_running_sums_equal_prefix(spark):
    vals = [(float(i) * 0.37 % 11, i % 5) for i in range(400)]
    df = spark.createDataFrame(vals, "x double, v long").dropDuplicates(["x"])
    got = {r["x"]: r["v_cum"] for r in ranking.running_sums(df, "x", ["v"], ranges=16).collect()}
    base = sorted((r["x"], r["v"]) for r in df.collect())
    acc = 0
    for x, v in base:
        acc += v
        assert got[x] == acc


@pytest.mark.parametrize("parts", [1, 8])
def test_stratified_split_exact_counts(spark, parts):
    rows = [(i, 1 if i % 7 == 0 else 0) for i in range(1000)]
    df = spark.createDataFrame(rows, "k long, y int").repartition(parts)
    out = S.stratified_split(df, "y", "k")
    cnt = {(r.y, r.split): r["count"] for r in out.groupBy("y", "split").count().collect()}
    n1 = sum(1 for _, y in rows if y == 1)
    n0 = len(rows) - n1
    assert cnt[(1, "test")] == math.ceil(0.2 * n1)
    assert cnt[(0, "test")] == math.ceil(0.2 * n0)
    # the test rows are exactly those with the lowest draws per label
    test_keys = {r.k for r in out.filter("split = 'test'").collect()}
    for lab, n in ((1, n1), (0, n0)):
        keys = sorted((k for k, y in rows if y == lab), key=lambda k: (draws.unit_draw_py(42, k, "split"), k))
        assert set(keys[:math.ceil(0.2 * n)]) <= test_keys


def test_group_split_keeps_groups_together(spark):
    rows = [(i, f"text{i % 84}") for i in range(600)]
    df = spark.createDataFrame(rows, "k long, t string")
    out = S.group_split(df, "t")
    sides = out.groupBy("t").agg(F.countDistinct("split").alias("n")).collect()
    assert all(r.n == 1 for r in sides)
    assert out.filter("split = 'test'").select("t").distinct().count() == math.ceil(0.2 * 84)


def test_require_rows(spark):
    with pytest.raises(ValueError):
        S.require_rows(spark.range(49), 50)
    assert S.require_rows(spark.range(50), 50) == 50


def test_gate_distribution_keeps_empty_gates(spark):
    df = spark.createDataFrame([("AUTO_USE",), ("AUTO_USE",), ("REVIEW",)], "gate string")
    got = {r.gate: (r.n, r.share) for r in R.gate_distribution(df).collect()}
    assert got["BLOCK"] == (0, 0.0)
    assert got["AUTO_USE"][0] == 2 and got["AUTO_USE"][1] == pytest.approx(2 / 3)


def test_model_report_and_rank(spark):
    rows = [("m1", 1.0, True, "AUTO_USE"), ("m1", 9.0, False, "REVIEW"), ("m2", 22.0, True, "BLOCK")]
    df = spark.createDataFrame(rows, "model string, risk_index double, is_hallucinated boolean, gate string")
    rep = {r.model: r for r in R.model_report(df).collect()}
    assert rep["m1"].n == 2 and rep["m1"].avg_index == 5.0 and rep["m1"].hal_rate == 0.5
    assert (rep["m2"].n_block, rep["m2"].n_auto) == (1, 0)
    ranked = {r.model: r["rank"] for r in R.model_rank(R.model_report(df)).collect()}
    assert ranked == {"m1": 1, "m2": 2}
    st = {r.model: r for r in R.model_stats(df).collect()}
    assert st["m1"].grade == 2 and st["m2"].grade == 1 and st["m1"].hal_rate == 50.0


def test_outstanding_and_unmatched(spark):
    bank = spark.createDataFrame([("Q1", "a"), ("Q2", "b")], "id string, question string")
    resp = spark.createDataFrame([("Q1", "m1", "ok"), ("Q1", "m2", "PASTE AI RESPONSE HERE"),
                                  ("Q9", "m1", "x")], "id string, model string, response string")
    resp = resp.withColumn("filled", F.col("response") != fixed.RESPONSE_PLACEHOLDER)
    out = sorted((r.id, r.model) for r in J.outstanding(bank, resp, ["m1", "m2"], filled_col="filled").collect())
    assert out == [("Q1", "m2"), ("Q2", "m1"), ("Q2", "m2")]
    assert [r.id for r in J.unmatched(resp, bank).collect()] == ["Q9"]
    assert sorted(r.id for r in J.attach_bank(resp, bank).collect()) == ["Q1", "Q1"]


def test_positional_zip_stops_at_shorter(spark):
    q = spark.createDataFrame([(i, f"q{i}") for i in range(5)], "pos int, q string")
    r = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "pos int, r string")
    assert J.positional_zip(r, q).count() == 3


def test_variant_expand(spark):
    bank = spark.createDataFrame([(1, "right", "wrong", 4)], "k int, c string, w string, risk int")
    rows = sorted(tuple(r) for r in J.variant_expand(bank, "k", "c", "w", "risk").collect())
    assert rows == [(1, 4, 0, "right", 0.5), (1, 4, 1, "wrong", 20.0)]


def test_risk_lookup_default(spark):
    df = spark.createDataFrame([("Surgery",), ("Unknown",), (None,)], "subject string")
    got = [r.risk for r in J.risk_lookup(df, "subject", fixed.SUBJECT_RISK).orderBy("subject").collect()]
    assert sorted(got) == [3, 3, 5]


def test_data_tables_get_no_broadcast_hint(spark):
    joined = J.attach_bank(spark.range(50), spark.range(10))
    assert "broadcast" not in joined._jdf.queryExecution().logical().toString().lower()


def test_latency_percentile_linear(spark):
    df = spark.createDataFrame([(float(v),) for v in range(1, 101)], "d double")
    r = E.latency_summary(df, "d").first()
    assert r.avg_latency_ms == 50.5
    assert r.p95_latency_ms == pytest.approx(1 + 0.95 * 99)


def test_question_grid_and_first_seen(spark):
    rows = [("q1", "b", 1.0, 3), ("q1", "a", 2.0, 1), ("q2", "a", 4.0, 2)]
    df = spark.createDataFrame(rows, "id string, model string, risk_index double, pos int")
    g = {r.id: (r.a, r.b) for r in R.question_grid(df, ["id"], "model", ["a", "b"], "risk_index").collect()}
    assert g == {"q1": (2.0, 1.0), "q2": (4.0, None)}
    order = {r.model: r.model_pos for r in R.models_first_seen(df, "model", "pos").collect()}
    assert order == {"a": 1, "b": 2}


def test_hot_label_is_ranked_by_many_tasks(spark):
    rows = [(i, 0 if i % 100 else 1) for i in range(20000)]        # label 0 holds 99 % of rows
    df = spark.createDataFrame(rows, "k long, y int").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = S.stratified_split(df, "y", "k")
        parts = out.filter("y = 0").select(F.spark_partition_id().alias("p")).distinct().count()
        counts = {r.split: r["count"] for r in out.filter("y = 0").groupBy("split").count().collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert parts > 1                                    # not one task for the hot label
    assert counts["test"] == math.ceil(0.2 * 19800)


def test_bank_join_same_result_without_broadcast(spark):
    from riskgate.functions import judge
    from riskgate.plans import inputs as I
    sf = "/root/testdata/sf0.001"
    bank = I.bank(spark, sf)
    resp = I.responses(spark, sf)

    def judged(threshold):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        j = J.attach_bank(resp, bank, "id")
        return sorted((r.conv_id, r.turn, r.j.severity, r.j.facts_found) for r in
                      j.select("conv_id", "turn", judge.judge_rate("response", "key_facts", "red_flags",
                                                                   "risk_level").alias("j")).collect())
    try:
        assert judged("-1") == judged("10m")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_split_cut_offs_are_exact(spark):
    rows = [(i, i % 3) for i in range(6000)]
    df = spark.createDataFrame(rows, "k long, y int").repartition(4)
    out = {r.k: r.split for r in S.stratified_split(df, "y", "k").collect()}
    for lab in range(3):
        keys = sorted((k for k, y in rows if y == lab), key=lambda k: (draws.unit_draw_py(42, k, "split"), k))
        n_test = math.ceil(0.2 * len(keys))
        assert all(out[k] == "test" for k in keys[:n_test])
        assert all(out[k] == "train" for k in keys[n_test:])
    g = spark.createDataFrame([(i, f"t{i % 500}") for i in range(3000)], "k long, t string")
    sides = S.group_split(g, "t")
    groups = sorted({f"t{i}" for i in range(500)}, key=lambda t: (draws.unit_draw_py(42, t, "group_split"), t))
    want_test = set(groups[:100])
    got = {r.t: r.split for r in sides.collect()}
    assert {t for t, sd in got.items() if sd == "test"} == want_test


def test_percentile_by_group_keeps_the_null_group(spark):
    rows = [(None if v % 3 == 0 else f"g{v % 3}", float(v % 70)) for v in range(900)]
    df = spark.createDataFrame(rows, "g string, d double").repartition(5)
    got = {r.g: r.p95_latency_ms for r in E.latency_summary(df, "d", by=["g"]).collect()}
    for g in {r[0] for r in rows}:
        assert got[g] == pytest.approx(np.percentile([d for x, d in rows if x == g], 95))
    assert E.latency_summary(df.limit(0), "d").first().p95_latency_ms is None


def test_auc_of_class_totals_beyond_bigint_products(spark):
    counts = spark.createDataFrame([(0.2, 1, 4 * 10**9), (0.4, 3 * 10**9, 1), (0.4, 10**9, 0)], "s double, p long, n long")
    g = running_sums(counts.groupBy("s").agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
                     .select(F.col("s").alias("_s"), "_p", "_n", (F.col("_p") + F.col("_n")).alias("_a")),
                     "_s", ["_p", "_n", "_a"], descending=True)
    assert E.from_sums(g).first().auc_roc == pytest.approx(1.0)


def test_rank_metrics_keep_the_null_group(spark):
    rows = [(None if k % 2 else "m", k % 3 == 0, (k * 7 % 50) / 50) for k in range(300)]
    df = spark.createDataFrame([(m, int(y), s) for m, y, s in rows], "m string, y int, s double")
    got = {r.m: r.auc_roc for r in E.rank_metrics(df, "y", "s", by=["m"]).collect()}
    assert set(got) == {None, "m"} and all(0 < v < 1 for v in got.values())


def test_split_keeps_null_labels_among_many(spark):
    rows = [(i, None if i % 10 == 0 else i % 300) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, y int").repartition(6)
    out = S.stratified_split(df, "y", "k")
    assert out.count() == len(rows)
    assert out.where("y is null and split = 'test'").count() == math.ceil(0.2 * 300)


def test_sliding_gate_windows(spark):
    import datetime as dt
    from riskgate.streaming import gates as G
    t0 = dt.datetime(2024, 1, 1, 0, 30)
    rows = [(t0 + dt.timedelta(minutes=20 * i), float(i)) for i in range(6)]       # 00:30 .. 02:10
    df = spark.createDataFrame(rows, "event_time timestamp, risk_index double") \
        .withColumn("gate", F.lit("AUTO_USE"))
    w = G.gate_windows(df, window="1 hour", slide="30 minutes", watermark=None)
    got = {r.window.start.strftime("%H:%M"): r.n for r in w.collect()}
    # each event falls in two overlapping one-hour windows
    assert sum(got.values()) == 2 * len(rows)
    assert got["00:30"] == 3 and got["00:00"] == 2


def test_stratified_split_many_labels(spark):
    rows = [(i, i % 300) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, y int")
    out = {r.k: r.split for r in S.stratified_split(df, "y", "k").collect()}
    for lab in (0, 17, 299):
        keys = sorted((k for k, y in rows if y == lab), key=lambda k: (draws.unit_draw_py(42, k, "split"), k))
        assert [out[k] for k in keys] == ["test"] * math.ceil(0.2 * len(keys)) + \
            ["train"] * (len(keys) - math.ceil(0.2 * len(keys)))


def test_risk_lookup_from_table(spark):
    table = spark.createDataFrame([("Surgery", 5), ("Dental", 2)], "subject string, risk int")
    df = spark.createDataFrame([("Surgery",), ("Dental",), ("Other",)], "subject string")
    got = {r.subject: r.risk for r in J.risk_lookup(df, "subject", table).collect()}
    assert got == {"Surgery": 5, "Dental": 2, "Other": 3}
