"""End-to-end plans: the response audit and the benchmark run.

Response audit: response files -> filled only (F2) -> bank join (J1, F3) ->
judge (P21, P22a) -> terms with fallback (P9, P23) -> probe scores (M7) ->
result records (K2) and per-model report (A1, O1).

Benchmark run: samples -> group-aware split (O5) -> fit (M6) -> evaluation
(M11) -> baselines (M9, M10) -> method table (U3) -> report (K3).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgate import fixed
from riskgate.functions import judge, scoring
from riskgate.functions import text as T
from riskgate.operators import custom
from riskgate.operators import evaluate as E
from riskgate.operators import joins as J
from riskgate.operators import report as R
from riskgate.operators.probes import RiskProbes, RiskProbesModel, confidence_baseline
from riskgate.operators.split import group_split


def audit_responses(responses: DataFrame, bank: DataFrame,
                    features: DataFrame | None = None,
                    model: RiskProbesModel | None = None,
                    key: str = "id", rule: str = "rate", scorer=None,
                    judge_factory: Callable[[], Callable] | None = None,
                    extractor_factory: Callable[[], Callable] | None = None) -> DataFrame:
    """Judged (and scored) result records, one per filled response. ``rule`` picks
    the judge (``rate`` or ``any_flag``); ``judge_factory`` and ``extractor_factory`` put
    functions of the user's in its place and in that of the term extraction, loaded once
    a worker (see :mod:`riskgate.operators.custom`). Scores come from a fitted model with a
    feature table keyed by ``sample_id``, or from ``scorer``, which adds
    uncertainty, risk_score, violation, risk_index and gate to rows with
    ``response_text``."""
    filled = responses.filter(judge.is_filled("response"))
    b = bank.select(key, F.col("category").alias("bank_category"), "risk_level",
                    F.col("question").alias("bank_question"), "key_facts", "red_flags",
                    F.col("entities").alias("bank_entities"))
    r = J.attach_bank(filled, b, key)
    if judge_factory is not None:
        r = custom.custom_judge(r, judge_factory)
    else:
        judged = {"rate": judge.judge_rate, "any_flag": judge.judge_any_flag}[rule]
        r = r.withColumn("judgment", judged("response", "key_facts", "red_flags", "risk_level"))
    r = custom.custom_extractor(r, extractor_factory, out="_terms") if extractor_factory is not None \
        else r.withColumn("_terms", T.extract_terms(F.col("response")))
    r = r.withColumn("entities", judge.term_fallback("_terms", F.col("bank_entities")))
    r = r.withColumn("text", T.prompt_text("bank_question", "response"))
    out = r.select(
        key, F.col("bank_category").alias("category"), "risk_level", "model",
        T.snippet("bank_question", fixed.SNIPPET_QUESTION).alias("question"),
        T.snippet("response", fixed.SNIPPET_RESPONSE).alias("response_snippet"),
        "judgment", "entities", "text", *([F.col("response").alias("response_text")] if scorer else []),
        *([F.col("sample_id")] if "sample_id" in r.columns else []))
    if model is not None and features is not None:
        scored = model.transform(out.join(features, "sample_id", "inner"))
        out = scored.select(
            *[c for c in out.columns], "gate", F.round("risk_index", 2).alias("risk_index"),
            F.round("uncertainty_score", 4).alias("uncertainty"), F.round("risk_score", 4).alias("risk_score"),
            F.round("causal_violation_prob", 4).alias("violation"),
            scoring.score_struct("uncertainty_score", "risk_score", "causal_violation_prob", "risk_index", "gate",
                                 scoring.term_count("entities"), "explanation").alias("score"))
    if scorer is not None:
        out = scorer(out)
    return out


def audit_report(results: DataFrame) -> DataFrame:
    """Per-model report with rank (A1 + O1) over audited results."""
    rep = R.model_report(results.withColumn("is_hallucinated", F.col("judgment.is_hallucinated")))
    return R.model_rank(rep)


def compare_models(responses: DataFrame, bank: DataFrame, scorer) -> DataFrame:
    """Per-model statistics and rank of responses judged by the any-flag rule, with
    terms falling back to the bank's, scored and graded (J1, P22b, P23, A2, O1)."""
    done = audit_responses(responses, bank, rule="any_flag", scorer=scorer)
    done = done.withColumn("is_hallucinated", F.col("judgment.is_hallucinated"))
    return R.model_rank(R.model_stats(done))


def benchmark_run(samples: DataFrame, test_fraction: float = fixed.SPLIT_TEST_FRACTION,
                  **probe_params) -> tuple[DataFrame, DataFrame, dict]:
    """One text-grouped split: every method is fitted on all its training rows and judged
    on its test rows. Returns the method table, the evaluation of the probes (M11) and
    the training record."""
    s = samples.withColumn("_text_key", F.md5("text")) if "text" in samples.columns \
        else samples.withColumn("_text_key", F.col("sample_id").cast("string"))
    split = group_split(s, "_text_key", test_fraction).drop("_text_key")
    train = split.filter(F.col("split") == "train").drop("split")
    test = split.filter(F.col("split") == "test").drop("split")
    model = RiskProbes(**probe_params).fit(train, validation=test)
    scored = model.transform(test).withColumn("index_score", scoring.normalised("risk_index"))
    scored = E.random_baseline(scored, "sample_id")
    conf = confidence_baseline(train, test).select("sample_id", "confidence_score")
    scored = scored.join(conf, "sample_id", "inner")
    table = E.method_compare({"random": "random_score", "confidence_only": "confidence_score",
                              "probes": "index_score"}, "true_label", df=scored)
    return table, E.evaluate(scored), model.stats


def evaluation_record(evaluation: DataFrame, table: DataFrame) -> DataFrame:
    """The evaluation and the method table as one long table (K3): section, method,
    metric, value."""
    from riskgate.sinks.writers import long_report
    head = long_report(evaluation.withColumn("method", F.lit("probes")), "method")
    return head.select(F.lit("evaluation").alias("section"), "method", "metric", "value").unionByName(
        long_report(table, "method").select(F.lit("methods").alias("section"), "method", "metric", "value"))


def benchmark_report(spark, table: DataFrame, stats: dict, config: dict) -> DataFrame:
    """The benchmark record (K3) as one long table (section, method, metric,
    value): configuration, training record and the per-method metrics."""
    from riskgate.sinks.writers import long_report
    small = [("config", "", k, float(v)) for k, v in config.items() if isinstance(v, (int, float))]
    small += [("training", "probes", k, float(v)) for k, v in stats.items()
              if isinstance(v, (int, float)) and not isinstance(v, bool)]
    head = spark.createDataFrame(small, "section string, method string, metric string, value double")
    methods = long_report(table, "method").select(F.lit("methods").alias("section"), "method", "metric", "value")
    return head.unionByName(methods)
