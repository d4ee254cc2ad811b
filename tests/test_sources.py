"""File sources and sinks on small fixtures written by the test itself."""

import json
import os

from pyspark.sql import functions as F

from riskgate import fixed
from riskgate.plans import audit
from riskgate.sinks import writers as W
from riskgate.sources import conversations as C
from riskgate.sources import qa


def _write_json_lines(path, rows):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        for r in rows:
            f.write(json.dumps(r) + "\n")


def test_option_map_source(spark, tmp_dir):
    p = os.path.join(tmp_dir, "keyed/part.json")
    rows = [{"sample_id": i, "question": f"Which paving for yard {i}?",
             "options": [{"key": "A", "value": "Granite slabs"}, {"key": "B", "value": "Cobble stones"}],
             "answer_idx": "A" if i % 2 else "Z"} for i in range(60)]
    _write_json_lines(p, rows)
    df = qa.option_map_source(spark.read.schema(qa.OPTION_MAP_SCHEMA).json(p), n=50)
    out = df.collect()
    assert len(out) == 50 and set(df.columns) == set(qa.SAMPLE_COLUMNS)
    for r in out:
        assert r.text.startswith("Q: Which paving") and "\nA: " in r.text
        assert (15 <= r.true_severity <= 25) if r.true_label else (0 <= r.true_severity <= 4)
        assert "Granite" in r.entities or "Cobble" in r.entities


def test_option_objects_without_ids(spark, tmp_dir):
    p = os.path.join(tmp_dir, "object/part.json")
    rows = [{"question": f"Which roof for house {i}?", "options": {"C": "Slate tiles", "A": "Straw thatch"},
             "answer_idx": "A"} for i in range(200)]
    _write_json_lines(p, [*rows, {"question": "Listed?", "options": [{"key": "B", "value": "Listed first"}], "answer_idx": "B"},
                          {"question": "None?", "answer_idx": "A"}])
    raw = qa.option_map_file(spark, p)
    first = raw.where("question like 'Which%'").first().options
    assert [(o.key, o.value) for o in first] == [("C", "Slate tiles"), ("A", "Straw thatch")]      # the file's order
    out = qa.option_map_source(raw).collect()
    assert len({r.sample_id for r in out}) == 202 and None not in {r.sample_id for r in out}
    out = [r for r in out if r.text is not None]                     # no option: no text
    labels = [r.true_label for r in out if "house" in r.text]
    assert 40 < sum(labels) < 120                                    # drawn record by record
    assert all(("Slate" in r.text) == (r.true_label == 1) for r in out if "house" in r.text)
    assert len({round(r.true_severity, 6) for r in out}) > 150


def test_template_documents_and_sources_of_n_each(spark, tmp_dir):
    bank = spark.createDataFrame([(f"Q{i}", "Cat", "Question?", "answer") for i in range(5)],
                                 "id string, category string, question string, correct_answer string")
    path = os.path.join(tmp_dir, "documents")
    W.write_template_documents(W.template_rows(bank, models=["a", "b"]), path, ["fill in"])
    docs = spark.read.json(path)
    assert docs.first()._instructions == ["fill in"]
    back = qa.response_file(spark, path, only_filled=False, lines=True)
    assert back.count() == 10 and back.select("model").distinct().count() == 2
    frame = spark.createDataFrame([(i, "t", [], 0, 0.0, "x") for i in range(9)], "sample_id long, text string, "
                                  "entities array<string>, true_label int, true_severity double, source string")
    both = qa.combine_sources(["one", "two"], {"one": lambda seed: frame, "two": lambda seed: frame}, n_each=4)
    assert both.count() == 8 and both.agg(F.max("sample_id")).first()[0] == 3


def test_option_column_source(spark, tmp_dir):
    p = os.path.join(tmp_dir, "columns/part.json")
    rows = [{"sample_id": i, "question": "Roof?", "opa": "Slate", "opb": "Thatch", "opc": "Copper",
             "opd": "Shingle", "cop": i % 4, "subject_name": ["Surgery", "Dental", None, "Unknown"][i % 4],
             "exp": ""} for i in range(20)]
    _write_json_lines(p, rows)
    out = qa.option_column_source(spark.read.schema(qa.OPTION_COLUMN_SCHEMA).json(p)).collect()
    by = {r.sample_id: r for r in out}
    assert by[0].source == "medmcqa_surgery" and by[0].entities[-1] == "Surgery"
    assert by[2].source == "medmcqa_medicine"                       # missing subject -> default
    assert all(r.true_severity <= 25.0 for r in out)
    assert all((r.true_severity >= 3.5 * 5) for r in out if r.true_label and r.sample_id % 4 == 0)


def test_reference_answer_source(spark, tmp_dir):
    p = os.path.join(tmp_dir, "reference/part.json")
    rows = [{"sample_id": i, "category": ["Health", "Law", "Psychology/Psychiatry", "Nutrition"][i % 4],
             "question": "Is it safe?", "best_answer": "Yes, in moderation.",
             "incorrect_answers": [] if i % 3 == 0 else ["Never"]} for i in range(40)]
    _write_json_lines(p, rows)
    out = qa.reference_answer_source(spark.read.schema(qa.REFERENCE_SCHEMA).json(p), n=20).collect()
    assert len(out) == 20                              # Law rows filtered before the first n
    for r in out:
        if r.true_label:
            assert r.text.endswith("Never") or r.text.endswith("Unknown")
            assert 10 <= r.true_severity <= 22


def test_response_files_bank_and_audit(spark, tmp_dir):
    bank_path = os.path.join(tmp_dir, "bank.json")
    _write_json_lines(bank_path, [
        {"id": "Q01", "category": "Masonry", "risk_level": 5, "question": "Mortar?",
         "correct_answer": "Lime mortar (NHL 3.5) in dry weather.", "key_facts": ["lime mortar", "NHL"],
         "red_flags": ["gypsum"], "entities": ["mortar"]},
        {"id": "Q02", "category": "Roofing", "risk": 4, "question": "Flashing?",
         "correct_facts": ["lead", "copper"], "red_flags": ["felt only"], "entities": ["Flashing"]},
    ])
    bank = qa.bank_source(spark, bank_path)
    assert {r.id: r.risk_level for r in bank.collect()} == {"Q01": 5, "Q02": 4}
    files = []
    for model, resp in (("m1", ["NHL is the binder", "Use lead and copper"]),
                        ("m2", ["gypsum", fixed.RESPONSE_PLACEHOLDER])):
        path = os.path.join(tmp_dir, f"responses_{model}.json")
        with open(path, "w") as f:
            json.dump({"_instructions": ["fill in"], "responses": [
                {"id": f"Q0{i + 1}", "category": "", "model": model, "question": "", "response": r}
                for i, r in enumerate(resp)] + [{"id": "Q99", "model": model, "response": "unknown id"}]}, f)
        files.append(path)
    responses = qa.response_file(spark, files)           # U2: two per-model files
    assert responses.count() == 5                         # placeholder dropped
    results = audit.audit_responses(responses, bank)
    got = {(r.model, r.id): r.judgment.is_hallucinated for r in results.collect()}
    assert got == {("m1", "Q01"): False, ("m1", "Q02"): False, ("m2", "Q01"): True}
    W.write_results(results.drop("judgment"), os.path.join(tmp_dir, "results"), fmt="parquet")
    back = spark.read.parquet(os.path.join(tmp_dir, "results"))
    assert sorted(r.model for r in back.select("model").distinct().collect()) == ["m1", "m2"]


def test_template_and_report_sinks(spark, tmp_dir):
    bank = spark.createDataFrame([("Q1", "Cat", "Question one?", "x" * 100)],
                                 "id string, category string, question string, correct_answer string")
    rows = W.template_rows(bank, models=["a", "b"])
    W.write_template(rows, os.path.join(tmp_dir, "tpl"))
    back = spark.read.json(os.path.join(tmp_dir, "tpl")).collect()
    assert len(back) == 2 and back[0]._correct_answer_hint == "x" * 80 + "..."
    everything = qa.response_file(spark, os.path.join(tmp_dir, "tpl"), only_filled=False, lines=True)
    assert everything.count() == 2
    assert qa.response_file(spark, os.path.join(tmp_dir, "tpl"), lines=True).count() == 0   # all placeholders
    wide = spark.createDataFrame([("random", 0.5, 0.4)], "method string, auc_roc double, f1 double")
    W.write_report(W.long_report(wide), os.path.join(tmp_dir, "report"))
    assert spark.read.json(os.path.join(tmp_dir, "report")).count() == 2


def test_qa_pairs_adjacent_only(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "q1"), (1, 2, "assistant", "a1"),
            (1, 3, "user", "q2"), (1, 4, "user", "q3"), (1, 5, "assistant", "a3")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted((r.turn, r.answer) for r in C.qa_pairs(df).collect())
    assert got == [(1, "a1"), (4, "a3")]
    assert C.qa_pairs(df).filter("turn = 1").first().prompt == "Q: q1\nA: a1"


def test_combined_union_keeps_duplicates(spark):
    a = spark.createDataFrame([(1, "t", [], 0, 0.0, "x")], "sample_id long, text string, entities array<string>, "
                              "true_label int, true_severity double, source string")
    assert qa.combined({"demo": a, "again": a}).count() == 2
    assert F is not None


def test_audit_with_model_scores_nested_records(spark, tmp_dir):
    from riskgate.operators.probes import RiskProbes
    from tests.test_probes import planted
    feats = planted(spark, n=200)
    model = RiskProbes(mlp_max_rounds=2, mlp_patience=1).fit(feats)
    bank = spark.createDataFrame(
        [("Q1", "Masonry", 5, "Mortar?", ["nhl"], ["gypsum"], ["mortar"])],
        "id string, category string, risk_level int, question string, key_facts array<string>, "
        "red_flags array<string>, entities array<string>")
    responses = spark.createDataFrame([("Q1", "m1", "NHL", 1), ("Q1", "m2", "gypsum now", 2)],
                                      "id string, model string, response string, sample_id long")
    out = audit.audit_responses(responses, bank, features=feats.select("sample_id", "features"), model=model)
    rows = {r.model: r for r in out.collect()}
    assert set(rows) == {"m1", "m2"}
    for r in rows.values():
        assert r.score.gate == r.gate and 0 <= r.score.risk_index <= 25
        assert r.score.entity_count == len(r.entities)
    W.write_results(out, os.path.join(tmp_dir, "nested"), fmt="json")
    back = spark.read.json(os.path.join(tmp_dir, "nested"))
    assert back.count() == 2 and "score" in back.columns and "judgment" in back.columns
    rep = {r.model: r for r in audit.audit_report(out).collect()}
    assert rep["m2"].hal_rate == 1.0 and rep["m1"].hal_rate == 0.0


def test_combine_sources_dispatch(spark):
    import warnings
    schema = ("sample_id long, text string, entities array<string>, true_label int, "
              "true_severity double, source string")

    def loader(tag):
        return lambda seed: spark.createDataFrame(
            [(i, f"{tag} {seed}", [], 0, 0.0, tag) for i in range(3)], schema)
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        out = qa.combine_sources(["a", "nope", "b"], {"a": loader("a"), "b": loader("b")}, seed=7)
    assert any("nope" in str(w.message) for w in caught)
    rows = out.collect()
    assert len(rows) == 6 and all(r.text.endswith(" 7") for r in rows)       # seed reaches every loader
    again = qa.combine_sources(["a", "b"], {"a": loader("a"), "b": loader("b")}, seed=7)
    order = [r.sample_id for r in out.orderBy("shuffle_key").collect()]
    assert order == [r.sample_id for r in again.orderBy("shuffle_key").collect()]


def test_demo_samples_cycle_bank_and_suffixes(spark):
    from riskgate.sources import demo
    bank = spark.createDataFrame(
        [(0, "Q-a?", "right a", "wrong a", 1, ["A"]), (1, "Q-b?", "right b", "wrong b", 5, ["B"]),
         (2, "Q-c?", "right c", "wrong c", 3, ["C"])],
        "bank_pos long, question string, correct string, wrong string, risk int, entities array<string>")
    rows = {r.i: r for r in demo.demo_samples(spark, bank, 300).collect()}
    assert len(rows) == 300
    for i, r in rows.items():
        q = ["Q-a?", "Q-b?", "Q-c?"][i % 3]
        suffix = fixed.SUFFIX_POOL[i % 6]
        assert r.text.startswith(f"Q: {q}{suffix}\nA: ")
        risk = [1, 5, 3][i % 3]
        if r.true_label:
            assert r.text.endswith("wrong " + "abc"[i % 3]) and 3.5 * risk <= r.true_severity <= min(25, 5 * risk)
        else:
            assert r.text.endswith("right " + "abc"[i % 3]) and 0 <= r.true_severity <= 0.8 * risk
    share = sum(r.true_label for r in rows.values()) / 300
    assert 0.3 < share < 0.5


def test_benchmark_report_sink(spark, tmp_dir):
    table = spark.createDataFrame([("random", 0.5, 0.4, 0.3), ("probes", 0.9, 0.8, 0.7)],
                                  "method string, auc_roc double, avg_precision double, f1 double")
    rep = audit.benchmark_report(spark, table, {"probe_c_auc": 0.91, "n_samples": 600, "violation_label": "x"},
                                 {"n": 600, "test_fraction": 0.2, "dataset": "demo"})
    W.write_report(rep, os.path.join(tmp_dir, "bench_report"))
    back = spark.read.json(os.path.join(tmp_dir, "bench_report"))
    got = {(r.section, r.method, r.metric): r.value for r in back.collect()}
    assert got[("methods", "probes", "auc_roc")] == 0.9 and got[("config", "", "n")] == 600.0
    assert got[("training", "probes", "probe_c_auc")] == 0.91 and len(got) == 2 + 2 + 6
