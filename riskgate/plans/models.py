"""Model-stage queries (M1-M9): fitted on the embeddings table with label
"class 0 against the rest". Fits are iterative, so their scores have no SQL oracle;
their row counts and optimality conditions have one, and so have the audits and the
benchmark record with given probes."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgate.functions import draws
from riskgate.operators.probes import RiskProbes, confidence_baseline
from riskgate.operators.split import stratified_split
from riskgate.plans import inputs as I
from riskgate.session import checkpoint_dir


def samples(spark: SparkSession, sf: str) -> DataFrame:
    e = I.table(spark, sf, "embeddings")
    y = (F.col("label") == 0).cast("int")
    sev = F.when(y == 1, 15.0 + 8.0 * draws.unit_draw(I.SEED, F.col("vec_id"), "sev")) \
        .otherwise(6.0 * draws.unit_draw(I.SEED, F.col("vec_id"), "sev"))
    return e.select(F.col("vec_id").alias("sample_id"), F.col("embedding").alias("features"),
                    y.alias("true_label"), sev.alias("true_severity"))


def _fit(spark, sf):
    return RiskProbes().fit(samples(spark, sf))


def fit_score(spark, sf):
    model = _fit(spark, sf)
    s = model.transform(samples(spark, sf))
    return s.select("sample_id", F.round("risk_index", 6).alias("risk_index"), "gate")


def fit_stats(spark, sf):
    model = _fit(spark, sf)
    return model.summary(spark).drop("train_time_s")


def sparse_weights(spark, sf):
    return _fit(spark, sf).sparse_weights(spark)


def confidence_only(spark, sf):
    s = stratified_split(samples(spark, sf), "true_label", "sample_id")
    out = confidence_baseline(s.filter(F.col("split") == "train"), s.filter(F.col("split") == "test"))
    return out.select("sample_id", F.round("confidence_score", 6).alias("confidence_score"))


def benchmark_methods(spark, sf):
    """The benchmark run: group-aware split, fit, probes vs random and
    confidence-only baselines (M6, M9-M11, U3)."""
    from riskgate.plans.audit import benchmark_run
    return benchmark_run(samples(spark, sf))[0]


def audit_results(spark, sf):
    """The response audit over assistant turns and the benchmark fact bank:
    filled only, bank join, judge, terms with fallback (F2, J1, P21-P23)."""
    from riskgate.plans.audit import audit_responses
    bank = I.bank(spark, sf).withColumn("category", F.concat(F.lit("item"), F.col("id").cast("string")))
    r = audit_responses(I.responses(spark, sf, spread=True), bank)
    return r.select("id", "model", F.col("judgment.is_hallucinated").cast("int").alias("is_hallucinated"),
                    F.col("judgment.severity").alias("severity"), F.size("entities").alias("n_entities"),
                    F.md5("text").alias("text_md5"))


def _scorer(df: DataFrame) -> DataFrame:
    return I.scored(I.with_components(df, I.text_features("response_text")))


def _bank(spark, sf) -> DataFrame:
    return I.bank(spark, sf).withColumn("category", F.concat(F.lit("item"), F.col("id").cast("string")))


def scored_audit(spark, sf):
    """Judge and scores of every response by the given probes."""
    from riskgate.plans.audit import audit_responses
    r = audit_responses(I.responses(spark, sf, spread=True), _bank(spark, sf), scorer=_scorer)
    return r.select("id", "model", F.col("judgment.is_hallucinated").cast("int").alias("is_hallucinated"),
                    F.col("judgment.severity").alias("severity"), F.round("uncertainty", 4).alias("uncertainty"),
                    F.round("risk_score", 4).alias("risk_score"), F.round("violation", 4).alias("violation"),
                    F.round("risk_index", 2).alias("risk_index"), "gate", F.md5("text").alias("text_md5"))


def compare_models(spark, sf):
    """The model comparison: any-flag judge, scores, statistics, grade and rank."""
    from riskgate.plans import audit
    return audit.compare_models(I.responses(spark, sf, spread=True), _bank(spark, sf), _scorer)


def benchmark_record(spark, sf):
    """Evaluation and method table of the given probes as the long record."""
    from riskgate.plans.audit import evaluation_record
    from riskgate.plans.catalog import evaluation, method_compare
    return evaluation_record(evaluation(spark, sf), method_compare(spark, sf)) \
        .select("section", "method", "metric", F.round("value", 4).alias("value"))


def fit_counts(spark, sf):
    """Rows that the fit trains and validates on, by label."""
    s = stratified_split(samples(spark, sf), "true_label", "sample_id")
    return s.groupBy("split", "true_label").agg(F.count("*").alias("n"))


def fit_stationarity(spark, sf):
    """Whether both logistic probes meet the optimality conditions of their objectives."""
    from riskgate.operators.probes import ProbeParams, stationarity
    return stationarity(samples(spark, sf), ProbeParams())


def fit_risk_descent(spark, sf):
    """Whether the risk probe's objective falls in every step, and its gradient equals
    finite differences (M2)."""
    from riskgate.operators.probes import ProbeParams, risk_descent
    return risk_descent(samples(spark, sf), ProbeParams())


def saved_score(spark, sf):
    """Whether the scores that the saved weight table gives by joins and sums equal those of
    the model, row by row (M7, K4)."""
    from riskgate.operators.probes import RiskProbesModel, scores_by_table
    data = samples(spark, sf)
    path = os.path.join(checkpoint_dir(spark), f"saved-probes-{uuid.uuid4().hex}")
    model = _fit(spark, sf)
    model.save(path)
    table = spark.read.schema(RiskProbesModel.WEIGHTS_SCHEMA).parquet(os.path.join(path, "weights"))
    own = scores_by_table(data, table, "sample_id", "features").select(
        "sample_id", F.col("risk_index").alias("own_index"), F.col("gate").alias("own_gate"))
    both = RiskProbesModel.load(path).transform(data).join(own, "sample_id")
    return both.select("sample_id", (F.abs(F.col("risk_index") - F.col("own_index")) < 1e-9).alias("same_index"),
                       (F.col("gate") == F.col("own_gate")).alias("same_gate"))


MODEL_QUERIES = {
    "fit_risk_descent": fit_risk_descent,
    "saved_score": saved_score,
    "scored_audit": scored_audit,
    "compare_models": compare_models,
    "benchmark_record": benchmark_record,
    "fit_counts": fit_counts,
    "fit_stationarity": fit_stationarity,
    "benchmark_methods": benchmark_methods,
    "audit_results": audit_results,
    "fit_score": fit_score,
    "fit_stats": fit_stats,
    "sparse_weights": sparse_weights,
    "confidence_baseline": confidence_only,
}
