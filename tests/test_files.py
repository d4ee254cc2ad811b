"""File workflows, bucketed tables, sketches, the phrase index, the user's own judge and
extractor, and the plans of the splits."""

import os
import random

import pytest
from pyspark.sql import functions as F

from riskgate.functions import judge, phrases
from riskgate.operators import custom
from riskgate.operators import evaluate as E
from riskgate.operators import joins as J
from riskgate.operators import split as S
from riskgate.plans import audit, files
from riskgate.sinks import writers as W
from riskgate.sources import qa

SF = "/root/testdata/sf0.001"


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


# -- files --------------------------------------------------------------------------

def test_bad_records_are_reported_with_their_file(spark, tmp_dir):
    good = '{"id": "1", "model": "m", "response": "yes"}'
    doc = '{"_instructions": ["a"], "responses": [{"id": "2", "response": "x"}, {"id": "3"}]}'
    os.makedirs(f"{tmp_dir}/in")
    for name, lines in (("a.json", [good, "no json", doc]), ("b.json", ['{"id": "4", "resp'])):
        with open(f"{tmp_dir}/in/{name}", "w") as f:
            f.write("\n".join(lines))
    rows = qa.response_records(spark, f"{tmp_dir}/in").collect()
    assert sorted(r.id for r in rows if r.bad_record is None) == ["1", "2", "3"]
    assert sorted((r.bad_record, os.path.basename(r.source_file)) for r in rows if r.bad_record is not None) \
        == [("no json", "a.json"), ('{"id": "4", "resp', "b.json")]


def test_rewriting_one_model_leaves_the_others(spark, tmp_dir):
    first = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (1, "b", 1)], "id long, model string, v int")
    W.write_results(first, f"{tmp_dir}/r", fmt="parquet")
    for _ in range(2):  # a repeated write gives the same table
        W.rewrite_results(first.where("model = 'a' and id = 1").withColumn("v", F.lit(2)), f"{tmp_dir}/r")
    got = sorted((r.id, r.model, r.v) for r in spark.read.parquet(f"{tmp_dir}/r").collect())
    assert got == [(1, "a", 2), (1, "b", 1)]


def test_bucketed_tables_join_without_an_exchange(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        rows, bank = files.bucketed(spark, SF)
        joined = J.attach_bank(rows, bank)
        assert "Exchange" not in plan(joined) and "SortMergeJoin" in plan(joined) and joined.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


# -- sketches -------------------------------------------------------------------------

def test_merged_sketches_keep_the_rank_error(spark):
    df = spark.range(40_000).select((F.col("id") % 3).alias("k"), (F.col("id") % 7).alias("hour"),
                                    F.pow(F.rand(5), 3).alias("v"))
    df = df.withColumn("v", F.when(F.col("k") == 2, F.lit(1.0)).otherwise(F.col("v"))).cache()
    merged = E.merged_quantile(E.latency_sketches(df, "v", ["k", "hour"]), ["k"], 0.9, out="q")
    off = {r.k: r.rank_error for r in E.rank_error(df, "v", merged, ["k"], 0.9, "q").collect()}
    assert set(off) == {0, 1, 2} and max(off.values()) <= files.RANK_ERROR and off[2] == 0
    wrong = merged.withColumn("q", F.col("q") * 0.7)
    assert max(r.rank_error for r in E.rank_error(df, "v", wrong, ["k"], 0.9, "q").collect()) > files.RANK_ERROR
    df.unpersist()


# -- phrases --------------------------------------------------------------------------------

def test_phrase_index_equals_contains(spark):
    draw = random.Random(1)
    word = lambda n: "".join(draw.choice("abÄ ") for _ in range(n))
    rows = [(k, None if k == 3 else word(draw.randint(0, 60)),
             None if k == 5 else [None if draw.random() < 0.05 else word(draw.randint(0, 9)) for _ in range(draw.randint(0, 8))]) for k in range(200)]
    df = spark.createDataFrame(rows, "k int, t string, p array<string>")
    both = df.select(judge.contained_count("t", "p").alias("a"), phrases.indexed_count("t", "p").alias("b")).collect()
    assert all(r.a == r.b for r in both) and sum(r.a for r in both) > 100


def test_phrase_index_on_a_long_text():
    text = "needle " + "hay " * 200_000 + "pin"
    assert phrases.count_phrases(text, ["needle hay", "pin", "needles", "hay " * 1000, "hay " * 200_001] * 50) == 150
    data = phrases.np.frombuffer(b"abcabcab", dtype=phrases.np.uint8)
    for length in range(1, 9):
        hashes = phrases.rolling(data, length)
        assert len(hashes) == 9 - length
        assert all((hashes[a] == hashes[b]) == (data[a:a + length].tobytes() == data[b:b + length].tobytes())
                   for a in range(len(hashes)) for b in range(len(hashes)))


# -- the user's own judge and extractor ----------------------------------------------------------

def strict_judge():
    """A judge of another make: every fact must be there."""
    def judge_one(response, facts, flags, risk):
        found = sum(f in (response or "").lower() for f in facts or [])
        return {"is_hallucinated": found < len(facts or []), "severity": float(risk or 0), "fact_coverage": 1.0,
                "red_flags_hit": 0, "facts_found": found, "total_key_facts": len(facts or [])}
    return judge_one


def long_words():
    return lambda text: sorted({w for w in (text or "").split() if len(w) > 12})


def test_audit_with_a_foreign_judge_and_extractor(spark):
    responses = spark.createDataFrame([("1", "m", "alpha beta"), ("1", "n", "alpha"), ("2", "m", "extraordinarily"), ("9", "m", "x")],
                                      "id string, model string, response string")
    bank = spark.createDataFrame([("1", "c", 3, "q1", ["alpha", "beta"], ["bad"], ["term"]), ("2", "c", 5, "q2", None, None, None)],
                                 "id string, category string, risk_level int, question string, key_facts array<string>, "
                                 "red_flags array<string>, entities array<string>")
    got = {(r.id, r.model): r for r in audit.audit_responses(responses, bank, judge_factory=strict_judge, extractor_factory=long_words).collect()}
    assert {k: (r.judgment.is_hallucinated, r.judgment.severity) for k, r in got.items()} \
        == {("1", "m"): (False, 3.0), ("1", "n"): (True, 3.0), ("2", "m"): (False, 5.0)}
    assert got["2", "m"].entities == ["extraordinarily"] and got["1", "m"].entities == ["term"]


def test_a_factory_is_called_once_in_a_worker(spark):
    def factory():
        import os as system
        import uuid
        made = f"{system.getpid()}:{uuid.uuid4().hex}"
        return lambda k: made

    df = spark.range(0, 4000, numPartitions=40)
    made = [r.made for r in custom.apply_rows(df, ["id"], factory, "made", "string").select("made").distinct().collect()]
    assert len({m.split(":")[0] for m in made}) == len(made) <= 8 + 8


# -- plans of the splits -----------------------------------------------------------------------------

def labelled(spark, n=500):
    return spark.range(n).select(F.col("id").alias("k"), F.when(F.col("id") % 50 == 0, None).otherwise(F.col("id") % 3).alias("y"),
                                 F.concat(F.lit("t"), (F.col("id") % 40).cast("string")).alias("t"))


def test_splits_do_not_move_rows(spark):
    both = [S.stratified_split(labelled(spark), "y", "k"), S.group_split(labelled(spark), "t")]
    plans = [plan(df) for df in both]
    assert "BroadcastHashJoin" in plans[0] and "Join" not in plans[1]
    assert all("ShuffleExchange" not in p and "Exchange hash" not in p and "NestedLoop" not in p and "Cartesian" not in p for p in plans)


def test_many_labels_give_the_same_split_by_salts(spark, monkeypatch):
    want = sorted(map(tuple, S.stratified_split(labelled(spark), "y", "k").select("k", "split").collect()))
    monkeypatch.setattr(S, "MAX_BROADCAST_LABELS", 2)
    salted = S.stratified_split(labelled(spark), "y", "k")
    assert salted.columns == ["k", "y", "t", "split"]
    assert sorted(map(tuple, salted.select("k", "split").collect())) == want


def test_splits_of_empty_tables(spark):
    assert S.group_split(labelled(spark, 0), "t").count() == 0
    assert S.stratified_split(labelled(spark, 0), "y", "k").count() == 0


@pytest.mark.parametrize("name", sorted(files.FILE_QUERIES))
def test_file_queries_run(spark, name):
    assert files.FILE_QUERIES[name](spark, SF).count() > 0
