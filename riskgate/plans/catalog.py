"""Registered queries over the supplied tables, one per operator group of the
inventory. Each takes (spark, sf_dir) and returns a DataFrame whose column
names match the oracle SQL in :mod:`riskgate.plans.oracle`.

Outputs that are floating point are rounded to 6 places (4 where the record
format says so) so that summation order cannot change a compared value.
Arrays are reported joined with '|' or in long (key, dim, value) form.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgate import fixed
from riskgate.functions import draws, judge, options, scoring
from riskgate.functions import text as T
from riskgate.operators import evaluate as E
from riskgate.operators import features as FT
from riskgate.operators import joins as J
from riskgate.operators import report as R
from riskgate.operators import split as S
from riskgate.plans import inputs as I
from riskgate.sources import conversations as C
from riskgate.session import cut_lineage
from riskgate.sources import demo

Query = Callable[[SparkSession, str], DataFrame]


def _r6(c, name=None):
    col = F.round(F.col(c) if isinstance(c, str) else c, 6)
    return col.alias(name or (c if isinstance(c, str) else "value"))


# --------------------------------------------------------------------------- sources

def qa_pairs(spark, sf):
    p = C.qa_pairs(I.table(spark, sf, "conversations"))
    return p.select("conv_id", "turn", "answer_turn", F.md5("prompt").alias("prompt_md5"),
                    F.length("prompt").alias("prompt_chars"))


def cyclic_resample(spark, sf):
    nation = I.table(spark, sf, "nation")
    region = I.table(spark, sf, "region")
    bank = demo.nation_bank(nation, region)
    idx = I.table(spark, sf, "documents").select(F.col("doc_id").alias("i"))
    s = demo.cyclic_resample(idx, bank, n_bank=bank.count(), seed=I.SEED)
    return s.select("i", "bank_pos", "true_label", _r6("true_severity"),
                    F.md5("text").alias("text_md5"), F.size("entities").alias("n_entities"))


def union_sources(spark, sf):
    return demo.union_sources(spark, sf).select(
        "source", "key", F.length("text").alias("chars"), "true_label")


def seeded_shuffle_topn(spark, sf):
    u = demo.union_sources(spark, sf).withColumn(
        "_k", F.concat_ws(":", F.col("source"), F.col("key").cast("string")))
    shuffled = S.seeded_shuffle(u, "_k", seed=I.SEED)
    return S.first_n(shuffled, 50, ["shuffle_key"]).select("source", "key")


def _part_qa(spark, sf) -> DataFrame:
    """part rows as QA records: question = name, options = brand, type, size, name."""
    p = I.table(spark, sf, "part")
    subject = (F.when(F.pmod(F.col("p_size"), F.lit(4)) == 0, F.lit("Surgery"))
               .when(F.pmod(F.col("p_size"), F.lit(4)) == 1, F.lit("Forensic Medicine"))
               .when(F.pmod(F.col("p_size"), F.lit(4)) == 2, F.lit(None).cast("string"))
               .otherwise(F.col("p_type")))
    return p.select(F.col("p_partkey").alias("sample_id"), F.col("p_name").alias("question"),
                    F.col("p_brand").alias("opa"), F.col("p_type").alias("opb"),
                    F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("opc"),
                    F.col("p_name").alias("opd"),
                    (F.pmod(F.col("p_partkey"), F.lit(6)) - 1).cast("int").alias("cop"),
                    subject.alias("subject_name"), F.col("p_type").alias("category"),
                    F.col("p_size"))


def _sample_out(df: DataFrame) -> DataFrame:
    return df.select("sample_id", F.md5("text").alias("text_md5"),
                     F.array_join("entities", "|").alias("entities"),
                     F.size("entities").alias("n_entities"), "true_label", _r6("true_severity"), "source")


def source_option_columns(spark, sf):
    from riskgate.sources import qa
    return _sample_out(qa.option_column_source(_part_qa(spark, sf)))


def source_option_map(spark, sf):
    from riskgate.sources import qa
    d = _part_qa(spark, sf)
    keyed = F.array(*[F.struct(F.lit(k).alias("key"), F.col(c).alias("value"))
                      for k, c in zip("ABCD", ["opa", "opb", "opc", "opd"])])
    d = d.select("sample_id", "question", keyed.alias("options"),
                 F.substring(F.lit("ABCDE"), (F.pmod(F.col("sample_id"), F.lit(5)) + 1).cast("int"), 1)
                 .alias("answer_idx"))
    return _sample_out(qa.option_map_source(d))


def source_reference_answer(spark, sf):
    from riskgate.sources import qa
    d = _part_qa(spark, sf)
    incorrect = F.when(F.pmod(F.col("p_size"), F.lit(3)) == 0, F.array().cast("array<string>")) \
        .otherwise(F.array("opb", "question"))
    d = d.select("sample_id", "category", "question", F.col("opa").alias("best_answer"),
                 incorrect.alias("incorrect_answers"))
    return _sample_out(qa.reference_answer_source(d, words=I.PART_TYPE_WORDS))


# --------------------------------------------------------------------------- scalars

def term_extract(spark, sf):
    d = I.table(spark, sf, "documents", spread=True)
    t = d.select("doc_id", T.extract_terms(F.col("text")).alias("terms"))
    return t.select("doc_id", F.array_join("terms", "|").alias("terms"),
                    scoring.term_count("terms").alias("n_terms"))


def term_vocab(spark, sf):
    d = I.table(spark, sf, "documents", spread=True)
    t = d.select("doc_id", T.append_term(T.extract_terms(F.col("text"), I.CORPUS_VOCABULARY),
                                         F.col("source")).alias("terms"))
    return t.select("doc_id", F.array_join("terms", "|").alias("terms"),
                    F.size("terms").alias("n_terms"))


def content_key(spark, sf):
    d = I.table(spark, sf, "documents")
    return d.select("doc_id", T.content_key(F.col("text")).alias("content_key"))


def _part_options(p: DataFrame) -> DataFrame:
    opts = F.array("p_name", "p_brand", "p_type", F.col("p_size").cast("string"))
    keyed = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in
                      zip("ABCD", [F.col("p_name"), F.col("p_brand"), F.col("p_type"),
                                   F.col("p_size").cast("string")])])
    return p.select("p_partkey", "p_name", "p_size", opts.alias("opts"), keyed.alias("keyed"),
                    (F.pmod(F.col("p_partkey"), F.lit(6)) - 1).alias("cop"),
                    F.substring(F.lit("ABCDE"), (F.pmod(F.col("p_partkey"), F.lit(5)) + 1).cast("int"), 1)
                    .alias("answer_key"))


def option_pick(spark, sf):
    p = _part_options(I.table(spark, sf, "part"))
    return p.select("p_partkey",
                    options.right_by_index("opts", "cop").alias("right_idx"),
                    options.first_wrong_by_index("opts", "cop").alias("wrong_idx"),
                    options.right_by_key("keyed", "answer_key").alias("right_key"),
                    options.first_wrong_by_key("keyed", "answer_key").alias("wrong_key"))


def corrupt_inject(spark, sf):
    p = _part_options(I.table(spark, sf, "part"))
    key = F.col("p_partkey")
    right = options.right_by_index("opts", "cop")
    wrong = options.first_wrong_by_index("opts", "cop")
    drawn = options.corrupted(I.SEED, key)
    s = p.select("p_partkey", "p_name",
                 options.pick_output(drawn, wrong, right).alias("answer"),
                 options.used_wrong(drawn, wrong).alias("true_label"))
    s = s.withColumn("true_severity", options.severity_fixed_range(
        "true_label", I.SEED, key, fixed.SEVERITY_OPTION_MAP))
    return s.select("p_partkey", "true_label",
                    F.md5(T.prompt_text("p_name", "answer")).alias("text_md5"),
                    _r6("true_severity"),
                    scoring.risk_bin("true_severity").alias("risk_bin"),
                    scoring.violation_label("true_severity").alias("violation"))


def severity_label(spark, sf):
    p = I.table(spark, sf, "part")
    key = F.col("p_partkey")
    s = p.select("p_partkey", (F.pmod(F.col("p_size"), F.lit(5)) + 1).cast("int").alias("risk"),
                 options.corrupted(I.SEED, key).cast("int").alias("true_label"))
    s = s.withColumn("true_severity", options.severity_by_risk("true_label", "risk", I.SEED, key)) \
         .withColumn("sev_ref", options.severity_fixed_range("true_label", I.SEED, key,
                                                             fixed.SEVERITY_REFERENCE, "severity_ref"))
    return s.select("p_partkey", "risk", "true_label", _r6("true_severity"), _r6("sev_ref"),
                    scoring.risk_bin("true_severity").alias("risk_bin"),
                    scoring.violation_label("true_severity").alias("violation"))


def risk_lookup(spark, sf):
    d = I.table(spark, sf, "documents").select("doc_id", "source")
    r = J.risk_lookup(d, "source", I.SOURCE_RISK)
    return r.select("doc_id", "source", "risk", T.source_tag("docs_", F.col("source")).alias("source_tag"))


def category_filter_topn(spark, sf):
    p = I.table(spark, sf, "part")
    words = F.array(*[F.lit(w) for w in I.PART_TYPE_WORDS])
    kept = p.filter(F.exists(words, lambda w: F.contains(F.col("p_type"), w)))
    return S.first_n(kept, 100, ["p_partkey"]).select("p_partkey", "p_type")


def index_gate(spark, sf):
    s = I.scored_documents(spark, sf)
    return s.select("doc_id", F.round("uncertainty", 4).alias("uncertainty"),
                    F.round("risk_score", 4).alias("risk_score"),
                    F.round("violation", 4).alias("violation"), F.round("risk_index", 4).alias("risk_index"),
                    "gate", scoring.predicted_label(scoring.normalised("risk_index")).alias("y_pred"))


def explain(spark, sf):
    s = I.scored_documents(spark, sf, spread=True)
    return s.select("doc_id", "gate", scoring.gate_description("gate").alias("description"),
                    scoring.explanation("uncertainty", "risk_score", "violation", "gate").alias("explanation"),
                    scoring.term_count(T.extract_terms(F.col("text"))).alias("entity_count"))


# --------------------------------------------------------------------------- judge / joins

def _judged(spark, sf, rule: str) -> DataFrame:
    bank = I.bank(spark, sf)
    r = J.attach_bank(I.responses(spark, sf, spread=True), bank, "id")
    if rule == "rate":
        j = judge.judge_rate("response", "key_facts", "red_flags", "risk_level")
    else:
        j = judge.judge_any_flag("response", "key_facts", "red_flags", "risk_level")
    return r.withColumn("j", j)


def judge_rate(spark, sf):
    r = _judged(spark, sf, "rate")
    terms = judge.term_fallback(T.extract_terms(F.col("response")), F.col("entities"))
    return r.select("conv_id", "turn", "id", F.col("j.is_hallucinated").cast("int").alias("is_hallucinated"),
                    F.col("j.severity").alias("severity"), F.col("j.fact_coverage").alias("fact_coverage"),
                    F.col("j.red_flags_hit").alias("red_flags_hit"),
                    F.col("j.facts_found").alias("facts_found"),
                    F.col("j.total_key_facts").alias("total_key_facts"),
                    F.size(terms).alias("n_terms"))


def judge_any_flag(spark, sf):
    r = _judged(spark, sf, "any_flag")
    return r.select("conv_id", "turn", "id", F.col("j.is_hallucinated").cast("int").alias("is_hallucinated"),
                    F.col("j.severity").alias("severity"), F.col("j.fact_coverage").alias("fact_coverage"),
                    F.col("j.red_flags_hit").alias("red_flags_hit"))


def unmatched_responses(spark, sf):
    u = J.unmatched(I.responses(spark, sf), I.bank(spark, sf), "id")
    return u.select("conv_id", "turn", "id")


def outstanding(spark, sf):
    bank = I.bank(spark, sf).select("id", "question")
    resp = I.responses(spark, sf).withColumn("filled", judge.is_filled("response"))
    o = J.outstanding(bank, resp, I.models(resp), filled_col="filled")
    return o.select("id", "model", T.snippet("question", fixed.SNIPPET_HINT).alias("hint"),
                    F.lit(fixed.RESPONSE_PLACEHOLDER).alias("response"))


def positional_zip(spark, sf):
    q = I.table(spark, sf, "benchmark").select(F.col("item_id").alias("pos"),
                                                F.col("text").alias("question"))
    r = I.responses(spark, sf).select(F.col("conv_id").alias("pos"), "model", "response")
    z = J.positional_zip(r, q, "pos")
    return z.select("model", "pos", F.length("question").alias("q_chars"),
                    F.length("response").alias("r_chars"))


def variant_expand(spark, sf):
    p = I.table(spark, sf, "part")
    bank = p.select(F.col("p_partkey").alias("bank_pos"), F.col("p_name").alias("correct"),
                    F.col("p_brand").alias("wrong"),
                    (F.pmod(F.col("p_size"), F.lit(5)) + 1).cast("int").alias("risk"))
    v = J.variant_expand(bank, "bank_pos", "correct", "wrong", "risk")
    return v.select("bank_pos", "label", "answer", _r6("severity"))


# --------------------------------------------------------------------------- features

def _states(spark, sf) -> DataFrame:
    e = I.table(spark, sf, "embeddings")
    return e.select(F.floor(F.col("vec_id") / 10).alias("sample_id"),
                    F.pmod(F.col("vec_id"), F.lit(3)).cast("int").alias("layer"),
                    F.pmod(F.col("vec_id"), F.lit(10)).cast("int").alias("token_pos"),
                    F.col("embedding").alias("vec"))


def layer_pool(spark, sf):
    pooled = FT.layer_pool(_states(spark, sf))
    return FT.to_long(pooled, "sample_id", "features").select("sample_id", "dim", _r6("value"))


def entity_position_pool(spark, sf):
    lab = I.table(spark, sf, "labels")
    pos = lab.select(F.floor(F.col("doc_id") / 10).alias("sample_id"),
                     F.pmod(F.col("doc_id"), F.lit(10)).cast("int").alias("token_pos"))
    kept = J.entity_positions(_states(spark, sf), pos)
    pooled = FT.layer_pool(kept)
    return FT.to_long(pooled, "sample_id", "features").select("sample_id", "dim", _r6("value"))


def scale_stats(spark, sf):
    e = I.table(spark, sf, "embeddings")
    s = FT.scale_stats(e, "embedding")
    return s.select("dim", _r6("mean"), _r6("std"))


PROJ_SEED, PROJ_OUT = 7, 8
LIN_SEED, LIN_BIAS = 11, 0.1


def project(spark, sf):
    e = I.table(spark, sf, "embeddings")
    m = FT.draw_matrix(PROJ_SEED, PROJ_OUT, 64)
    p = FT.project(e, "embedding", m)
    return FT.to_long(p, "vec_id", "projected").select("vec_id", "dim", _r6("value"))


def linear_apply(spark, sf):
    e = I.table(spark, sf, "embeddings")
    means, stds = FT.scaler_arrays(FT.scale_stats(e, "embedding"))
    w = [draws.unit_draw_py(LIN_SEED, d, "w") - 0.5 for d in range(len(means))]
    out = FT.linear_apply(e, "embedding", w, LIN_BIAS, means, stds)
    return out.select("vec_id", _r6("probability"))


RELU_SEEDS, RELU_HIDDEN, RELU_OUT = (13, 17), 8, 5


def _relu(spark, sf) -> DataFrame:
    """Forward pass of an imported two-layer ReLU network with softmax output
    (M13); weights and biases are seeded draws, 64 -> 8 -> 5."""
    e = I.table(spark, sf, "embeddings")
    s1, s2 = RELU_SEEDS
    w1 = FT.draw_matrix(s1, RELU_HIDDEN, 64, "relu1").T
    b1 = [draws.unit_draw_py(s1, 9000 + h, "relu1b") - 0.5 for h in range(RELU_HIDDEN)]
    w2 = FT.draw_matrix(s2, RELU_OUT, RELU_HIDDEN, "relu2").T
    b2 = [draws.unit_draw_py(s2, 9000 + k, "relu2b") - 0.5 for k in range(RELU_OUT)]
    return FT.relu_apply(e, "embedding", [(w1, b1), (w2, b2)])


def relu_network(spark, sf):
    out = _relu(spark, sf)
    return FT.to_long(out, "vec_id", "probability").select("vec_id", "dim", _r6("value"))


def expected_risk(spark, sf):
    """Class-weighted risk of the network's five probabilities (M13 into M3)."""
    out = _relu(spark, sf)
    return out.select("vec_id", _r6(FT.expected_risk("probability"), "expected_risk"))


# --------------------------------------------------------------------------- reports

def model_report(spark, sf):
    r = R.model_report(I.scored_documents(spark, sf))
    return r.select("model", "n", _r6("avg_index"), _r6("hal_rate"), "n_auto", "n_review", "n_block")


def model_stats(spark, sf):
    return R.model_stats(I.scored_documents(spark, sf))


def gate_distribution(spark, sf):
    g = R.gate_distribution(I.scored_documents(spark, sf))
    return g.select("gate", "n", _r6("share"))


def model_rank(spark, sf):
    rep = R.model_report(I.scored_documents(spark, sf)).select("model", _r6("avg_index"))
    return R.model_rank(rep)


def models_first_seen(spark, sf):
    s = I.scored_documents(spark, sf)
    return R.models_first_seen(s, "model", "doc_id")


def _scored_responses(spark, sf, spread: bool = False) -> DataFrame:
    r = I.responses(spark, sf, spread=spread)
    return I.scored(I.with_components(r, I.text_features("response")))


def question_grid(spark, sf):
    """The grid of all questions and models of the data, one row per cell."""
    scored = _scored_responses(spark, sf)
    found = I.models(scored)
    g = R.question_grid(scored, ["id"], "model", found, "risk_index", with_gate=True)
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"`{m}`").alias("mean_index"),
                                         F.col(f"`{m}_gate`").alias("gate")) for m in found])).alias("c")
    return g.select("id", cells).select("id", "c.model", _r6("c.mean_index", "mean_index"), "c.gate")


def fill_rate(spark, sf):
    c = I.table(spark, sf, "conversations")
    f = R.fill_rate(c, "text", by=["role"])
    return f.select("role", "n_filled", "n_total", _r6("fill_rate"))


def response_detail(spark, sf):
    s = _scored_responses(spark, sf, spread=True)
    bank = I.bank(spark, sf)
    j = J.attach_bank(s, bank, "id").withColumn(
        "j", judge.judge_rate("response", "key_facts", "red_flags", "risk_level"))
    order = R.models_first_seen(s.withColumn("pos", F.struct("conv_id", "turn")),
                                "model", "pos")
    d = R.response_detail(j.withColumn("verdict", F.col("j.is_hallucinated").cast("int"))
                          .withColumn("snippet", T.snippet("response", fixed.SNIPPET_RESPONSE)),
                          order, cols=["id", "conv_id", "turn", "gate", "risk_index", "verdict", "snippet"])
    return d.select("model_pos", "model", "id", "conv_id", "turn", "gate", _r6("risk_index"), "verdict",
                    F.md5("snippet").alias("snippet_md5"))


# --------------------------------------------------------------------------- evaluation

def eval_auc(spark, sf):
    return E.roc_auc(_kept_scores(spark, sf), "true_label", "score").select(_r6("auc_roc"))


def eval_ap(spark, sf):
    return E.average_precision(_kept_scores(spark, sf), "true_label", "score") \
        .select(_r6("avg_precision"))


def eval_f1(spark, sf):
    return E.f1_at(I.labelled_scores(spark, sf), "true_label", "score", 0.5).select(_r6("f1"))


def eval_accuracy(spark, sf):
    s = I.labelled_scores(spark, sf)
    s = s.select(scoring.risk_bin("true_severity").alias("actual"),
                 scoring.risk_bin("risk_index").alias("predicted"))
    return E.class_accuracy(s, "predicted", "actual").select(_r6("accuracy"))


def eval_corr(spark, sf):
    return E.severity_correlation(I.labelled_scores(spark, sf), "risk_index", "true_severity") \
        .select(_r6("severity_pearson_r"))


def eval_latency(spark, sf):
    ev = I.table(spark, sf, "events")
    return E.latency_summary(ev, "value", by=["event_type"]).select(
        "event_type", _r6("avg_latency_ms"), _r6("p95_latency_ms"))


def label_stats(spark, sf):
    return E.label_counts(I.table(spark, sf, "labels"), "toxic")


def mean_by_label(spark, sf):
    s = I.labelled_scores(spark, sf)
    return R.mean_by_label(s, "true_label", "risk_index").select("true_label", _r6("mean_index"), "n")


def _kept_scores(spark, sf) -> DataFrame:
    """The labelled scores, a few numbers a row, computed once from the texts."""
    return cut_lineage(I.labelled_scores(spark, sf))


def evaluation(spark, sf):
    return E.evaluate(_kept_scores(spark, sf), duration="latency_ms")


def random_baseline(spark, sf):
    lab = I.table(spark, sf, "labels").select("doc_id", "toxic")
    return E.random_baseline(lab, "doc_id").select("doc_id", _r6("random_score"))


def method_compare(spark, sf):
    s = _kept_scores(spark, sf)
    s = E.random_baseline(s, "doc_id")
    s = s.withColumn("index_score", scoring.normalised("risk_index"))
    methods = {"random": "random_score", "uncertainty": "uncertainty", "index": "index_score"}
    return E.method_compare(methods, "true_label", df=s)


def stratified_split_many(spark, sf):
    """More labels than a driver-side table could hold, null among them: the length of
    the text, null where the document has no label of its own."""
    lab = I.table(spark, sf, "labels").select("doc_id", "toxic")
    d = I.table(spark, sf, "documents").select("doc_id", "n_chars").join(lab, "doc_id", "left") \
        .select("doc_id", F.when(F.col("toxic").isNotNull(), F.col("n_chars")).alias("size"))
    return S.stratified_split(d, "size", "doc_id").select("doc_id", "size", "split")


def stratified_split(spark, sf):
    lab = I.table(spark, sf, "labels").select("doc_id", "toxic")
    return S.stratified_split(lab, "toxic", "doc_id").select("doc_id", "toxic", "split")


def group_split(spark, sf):
    d = I.table(spark, sf, "documents").select("doc_id", F.md5("text").alias("text_key"))
    return S.group_split(d, "text_key").select("doc_id", "split")


# --------------------------------------------------------------------------- streaming (batch form)

def gate_windows(spark, sf):
    from riskgate.streaming import gates as G
    ev = G.as_event_time(I.table(spark, sf, "events"))
    scored = I.scored(I.with_components(ev.select("event_time", "value"), I.value_features("value")))
    w = G.gate_windows(scored, window="1 hour", watermark=None)
    return w.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                    "gate", "n", _r6("avg_index"))


# --------------------------------------------------------------------------- flagship

def qa_judge_report(spark, sf):
    """Pairs -> bank join -> judge -> index and gate -> per-model report."""
    # no spread here: the pair join already redistributes rows by (conv_id, turn)
    pairs = C.qa_pairs(I.table(spark, sf, "conversations"))
    r = pairs.select("conv_id", "turn", F.col("answer").alias("response"),
                     I.question_of("conv_id", I.question_slots(spark, sf)).alias("id"),
                     F.concat(F.lit("turn"), F.col("answer_turn").cast("string")).alias("model"))
    j = J.attach_bank(r, I.bank(spark, sf), "id").withColumn(
        "j", judge.judge_rate("response", "key_facts", "red_flags", "risk_level"))
    s = I.scored(I.with_components(
        j.select("model", F.col("j.is_hallucinated").alias("is_hallucinated"), "response"), I.text_features("response")))
    rep = R.model_report(s)
    return rep.select("model", "n", _r6("avg_index"), _r6("hal_rate"), "n_auto", "n_review", "n_block")


QUERIES: dict[str, Query] = {
    "qa_judge_report": qa_judge_report,
    "qa_pairs": qa_pairs,
    "cyclic_resample": cyclic_resample,
    "union_sources": union_sources,
    "seeded_shuffle_topn": seeded_shuffle_topn,
    "term_extract": term_extract,
    "term_vocab": term_vocab,
    "content_key": content_key,
    "option_pick": option_pick,
    "corrupt_inject": corrupt_inject,
    "severity_label": severity_label,
    "risk_lookup": risk_lookup,
    "category_filter_topn": category_filter_topn,
    "index_gate": index_gate,
    "explain": explain,
    "judge_rate": judge_rate,
    "judge_any_flag": judge_any_flag,
    "unmatched_responses": unmatched_responses,
    "outstanding": outstanding,
    "positional_zip": positional_zip,
    "variant_expand": variant_expand,
    "layer_pool": layer_pool,
    "entity_position_pool": entity_position_pool,
    "scale_stats": scale_stats,
    "project": project,
    "linear_apply": linear_apply,
    "expected_risk": expected_risk,
    "relu_network": relu_network,
    "model_report": model_report,
    "model_stats": model_stats,
    "gate_distribution": gate_distribution,
    "model_rank": model_rank,
    "models_first_seen": models_first_seen,
    "question_grid": question_grid,
    "fill_rate": fill_rate,
    "response_detail": response_detail,
    "eval_auc": eval_auc,
    "eval_ap": eval_ap,
    "eval_f1": eval_f1,
    "eval_accuracy": eval_accuracy,
    "eval_corr": eval_corr,
    "eval_latency": eval_latency,
    "label_stats": label_stats,
    "mean_by_label": mean_by_label,
    "evaluation": evaluation,
    "random_baseline": random_baseline,
    "method_compare": method_compare,
    "stratified_split": stratified_split,
    "stratified_split_many": stratified_split_many,
    "group_split": group_split,
    "gate_windows": gate_windows,
    "source_option_columns": source_option_columns,
    "source_option_map": source_option_map,
    "source_reference_answer": source_reference_answer,
}
