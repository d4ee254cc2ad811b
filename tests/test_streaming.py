"""Streams give the batch result on in-order data; late rows and repeats are
handled by the watermark."""

import datetime as dt
import os

from pyspark.sql import functions as F

from riskgate.plans import inputs as I
from riskgate.streaming import gates as G

SF = "/root/testdata/sf0.001"


def _scored(df):
    return I.scored(I.with_components(G.as_event_time(df).select("event_id", "event_time", "value"),
                                      I.value_features("value")))


def test_stream_gate_windows_equal_batch(spark, tmp_dir):
    src = os.path.join(tmp_dir, "events")
    spark.read.parquet(f"{SF}/events.parquet").repartition(4).write.parquet(src)
    schema = spark.read.parquet(src).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    agg = G.gate_windows(_scored(stream), window="1 day", watermark="1 day")
    q = (agg.writeStream.outputMode("complete").format("memory").queryName("gw_test")
         .trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = sorted((str(r.window.start), r.gate, r.n, round(r.avg_index, 9))
                 for r in spark.sql("SELECT * FROM gw_test").collect())
    batch = G.gate_windows(_scored(spark.read.parquet(src)), window="1 day", watermark=None)
    want = sorted((str(r.window.start), r.gate, r.n, round(r.avg_index, 9)) for r in batch.collect())
    assert got == want


def test_score_stream_equals_batch(spark, tmp_dir):
    src = os.path.join(tmp_dir, "events2")
    spark.read.parquet(f"{SF}/events.parquet").write.parquet(src)
    schema = spark.read.parquet(src).schema

    def scorer(df):
        return _scored(df).select("event_id", "risk_index", "gate")

    q = (G.score_stream(spark.readStream.schema(schema).parquet(src), scorer)
         .writeStream.format("memory").queryName("score_test").trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = sorted(map(tuple, spark.sql("SELECT * FROM score_test").collect()))
    want = sorted(map(tuple, scorer(spark.read.parquet(src)).collect()))
    assert got == want


def test_late_rows_dropped_and_repeats_counted_once(spark, tmp_dir):
    src = os.path.join(tmp_dir, "late")
    os.makedirs(src)
    t0 = dt.datetime(2024, 1, 10, 12, 0, 0)
    schema = "event_id long, ts timestamp, uncertainty double, risk_score double, violation double"
    first = [(1, t0, 0.1, 1.0, 0.1), (2, t0 + dt.timedelta(hours=30), 0.1, 1.0, 0.1)]
    late = [(3, t0 - dt.timedelta(hours=5), 0.9, 5.0, 0.9)]      # far behind the watermark
    repeat = [(2, t0 + dt.timedelta(hours=30), 0.1, 1.0, 0.1)]   # same response again
    base = spark.readStream.schema(schema).parquet(src)
    s = G.add_gate(base.withColumn("event_time", F.col("ts")))
    counts = G.gate_windows(s, window="1 day", watermark="1 hour")
    dedup = G.dedupe_responses(s, ["event_id"], watermark="1 hour")
    q1 = counts.writeStream.outputMode("update").format("memory").queryName("late_counts").start()
    q2 = dedup.writeStream.format("memory").queryName("dedup_rows").start()
    for batch in (first, late, repeat):
        spark.createDataFrame(batch, schema).write.mode("append").parquet(src)
        q1.processAllAvailable()
        q2.processAllAvailable()
    q1.stop()
    q2.stop()
    rows = spark.sql("SELECT * FROM late_counts").collect()
    assert rows and all(r.gate != "BLOCK" for r in rows)          # the late (BLOCK) row never counted
    assert sorted(r.event_id for r in spark.sql("SELECT * FROM dedup_rows").collect()) == [1, 2]


def test_fitted_model_scores_stream_like_batch(spark, tmp_dir):
    from riskgate.operators.probes import RiskProbes
    from tests.test_probes import planted
    df = planted(spark, n=300)
    model = RiskProbes(mlp_max_rounds=2, mlp_patience=1).fit(df)
    src = os.path.join(tmp_dir, "features")
    df.repartition(3).write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)

    def scorer(d):
        return model.transform(d).select("sample_id", "risk_index", "gate", "explanation")

    q = (G.score_stream(stream, scorer).writeStream.format("memory").queryName("model_stream")
         .trigger(availableNow=True).start())
    q.awaitTermination(180)
    got = sorted(map(tuple, spark.sql("SELECT * FROM model_stream").collect()))
    want = sorted(map(tuple, scorer(spark.read.parquet(src)).collect()))
    assert got == want and len(got) == 300


def test_run_stream_checkpoints_and_resumes(spark, tmp_dir):
    src, out = os.path.join(tmp_dir, "in"), os.path.join(tmp_dir, "out")
    schema = "event_id long, ts timestamp, uncertainty double, risk_score double, violation double"
    t0 = dt.datetime(2024, 1, 10, 12, 0, 0)
    spark.createDataFrame([(i, t0 + dt.timedelta(minutes=i), 0.5, 2.0, 0.5) for i in range(5)], schema) \
        .write.parquet(src)
    name = "resume_" + os.path.basename(tmp_dir).replace("-", "_")

    def start():
        s = spark.readStream.schema(schema).parquet(src)
        return G.run_stream(G.add_gate(s), out, name, available_now=True)

    start().awaitTermination(120)
    spark.createDataFrame([(i, t0, 0.5, 2.0, 0.5) for i in range(5, 8)], schema).write.mode("append").parquet(src)
    start().awaitTermination(120)          # resumes from the checkpoint: old files are not read again
    ids = sorted(r.event_id for r in spark.read.parquet(out).collect())
    assert ids == list(range(8))


def test_windows_with_late_rows_told_apart(spark, tmp_dir):
    schema = "event_id long, event_time timestamp, uncertainty double, risk_score double, violation double"
    t0 = dt.datetime(2024, 1, 10, 12, 0, 0)
    drops = [[(1, t0, 0.1, 1.0, 0.1)], [(2, t0 + dt.timedelta(days=5), 0.1, 1.0, 0.1)],
             [(3, t0 + dt.timedelta(hours=1), 0.1, 1.0, 0.1), (4, t0 + dt.timedelta(days=5, hours=1), 0.1, 1.0, 0.1)]]
    landing, sink = os.path.join(tmp_dir, "landing"), os.path.join(tmp_dir, "sink")
    name = "late_" + os.path.basename(tmp_dir).replace("-", "_")
    for k, rows in enumerate(drops):
        df = spark.createDataFrame(rows, schema)
        df.write.parquet(f"{landing}/drop={k}")
        windows = G.gate_windows(G.add_gate(G.read_landing(spark, df.schema, f"{landing}/*")), window="1 day", watermark="1 day")
        G.run_updates(windows, sink, name, available_now=True).awaitTermination()
    counted = G.latest(spark.read.parquet(sink), ["window", "gate"])
    landed = G.add_gate(spark.createDataFrame([r for rows in drops for r in rows], schema))
    got = {r.window.start.day: (r.n, r.n_late) for r in G.with_late(counted, landed).collect()}
    assert got == {10: (1, 1), 15: (2, 0)}


def test_dedupe_state_expires(spark, tmp_dir):
    schema = "event_id long, event_time timestamp"
    t0 = dt.datetime(2024, 1, 10, 12, 0, 0)
    landing, sink = os.path.join(tmp_dir, "landing"), os.path.join(tmp_dir, "sink")
    name = "expire_" + os.path.basename(tmp_dir).replace("-", "_")
    held = []
    for k in range(4):
        rows = [(10 * k + j, t0 + dt.timedelta(days=3 * k)) for j in range(10)] * 2
        df = spark.createDataFrame(rows, schema)
        df.write.parquet(f"{landing}/drop={k}")
        stream = G.dedupe_responses(G.read_landing(spark, df.schema, f"{landing}/*"), ["event_id"], watermark="1 day")
        q = G.run_stream(stream, sink, name, available_now=True)
        q.awaitTermination()
        held.append(max(s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]))
    assert sorted(r.event_id for r in spark.read.parquet(sink).collect()) == list(range(40))
    assert held[-1] <= 20  # keys of earlier drops are gone, not 40 held
