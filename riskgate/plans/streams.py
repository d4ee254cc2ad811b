"""Registered streams (X1-X3): the whole events table arrives in DELIVERIES file drops, some
rows one drop late, some twice, and each drop is one ``availableNow`` run that resumes
from its checkpoint. Sinks are read back and compared with the batch SQL."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgate.plans import inputs as I
from riskgate.session import checkpoint_dir
from riskgate.streaming import gates as G

DELIVERIES = 3
#: event_id modulo these: rows that arrive one drop later, and rows that arrive again in the next drop.
DELAYED, REPEATED = (7, 3), (10, 0)
WATERMARK, WINDOW, SLIDE = "2 days", "2 days", "1 day"
#: Longer than two drops: a repeated row comes while its key is still held.
DEDUPE_WATERMARK = "25 days"


def deliveries(spark: SparkSession, sf: str) -> DataFrame:
    """Every delivered event with its drop: the time span of the table in equal parts, then
    the delayed and the repeated rows."""
    ev = G.as_event_time(I.table(spark, sf, "events")).select("event_id", "event_time", "value")
    span = ev.agg(F.unix_micros(F.min("event_time")).alias("lo"), F.unix_micros(F.max("event_time")).alias("hi")).first()
    lo, hi = span["lo"] or 0, span["hi"] or 0
    part = F.floor((F.unix_micros("event_time") - lo) * DELIVERIES / F.lit(hi - lo + 1))
    late = (F.pmod("event_id", F.lit(DELAYED[0])) == DELAYED[1]).cast("long")
    again = F.pmod("event_id", F.lit(REPEATED[0])) == REPEATED[1]
    drop = part + late
    drops = F.when(again, F.array(drop, drop + 1)).otherwise(F.array(drop))
    return ev.withColumn("drop", F.explode(drops)).where(F.col("event_time").isNotNull())


def scored_events(rows: DataFrame) -> DataFrame:
    return I.scored(I.with_components(rows, I.value_features("value")))


def streamed(spark: SparkSession, sf: str, name: str, start: Callable[[DataFrame, str, str], object],
             rows: DataFrame | None = None) -> str:
    """Drops the deliveries one after the other into a landing folder and runs the stream on
    each; returns the sink's folder."""
    rows = deliveries(spark, sf) if rows is None else rows
    base = os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")
    landing, sink = f"{base}/landing", f"{base}/sink"
    schema = rows.drop("drop").schema
    for k in range(DELIVERIES + 2):
        rows.where(F.col("drop") == k).drop("drop").write.parquet(f"{landing}/drop={k}")
        query = start(G.read_landing(spark, schema, f"{landing}/*"), sink, os.path.basename(base))
        query.awaitTermination()
    return sink


def stream_scores(spark, sf):
    """Every delivered row is scored once, without state."""
    def start(stream, sink, name):
        return G.run_stream(G.score_stream(stream, scored_events), sink, name, available_now=True)

    got = spark.read.parquet(streamed(spark, sf, "stream-scores", start))
    return got.select("event_id", F.round("risk_index", 6).alias("risk_index"), "gate")


def stream_gate_windows(spark, sf):
    """Rows and mean index per sliding window and gate, kept in the state store until the
    watermark passes the window; rows that come later are counted apart."""
    def start(stream, sink, name):
        windows = G.gate_windows(scored_events(stream), window=WINDOW, slide=SLIDE, watermark=WATERMARK)
        return G.run_updates(windows, sink, name, available_now=True)

    counted = G.latest(spark.read.parquet(streamed(spark, sf, "stream-windows", start)), ["window", "gate"])
    out = G.with_late(counted, scored_events(deliveries(spark, sf)), window=WINDOW, slide=SLIDE)
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "gate", "n",
                      F.round("avg_index", 6).alias("avg_index"), "n_late")


def stream_dedupe(spark, sf):
    """A row that is delivered again counts once; a key is held until the watermark has
    passed its event time."""
    def start(stream, sink, name):
        return G.run_stream(G.dedupe_responses(stream, ["event_id"], watermark=DEDUPE_WATERMARK), sink, name, available_now=True)

    got = spark.read.parquet(streamed(spark, sf, "stream-dedupe", start))
    return got.select("event_id", "value")


STREAM_QUERIES = {"stream_scores": stream_scores, "stream_gate_windows": stream_gate_windows, "stream_dedupe": stream_dedupe}
