"""Streaming jobs (X1-X3): score a stream, gate counts per event-time window with late
rows told apart, de-duplicate redelivered responses, and sinks that survive a restart.

The same functions take batch DataFrames, which is how tests show that a
stream gives the batch result on in-order data.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from riskgate.functions import scoring


def score_stream(stream: DataFrame, scorer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Stateless scoring of each micro-batch (X1): ``scorer`` is a fitted
    model's ``transform`` or any column function chain; narrow, no state."""
    return scorer(stream)


def as_event_time(df: DataFrame, ts: str = "ts", out: str = "event_time") -> DataFrame:
    """``timestamp_ntz`` columns are rejected by watermarks: cast to timestamp
    (interpreted in the session time zone, UTC in our sessions)."""
    return df.withColumn(out, F.col(ts).cast("timestamp"))


def gate_windows(scored: DataFrame, event_time: str = "event_time", window: str = "1 day",
                 slide: str | None = None, watermark: str | None = "1 day",
                 gate_col: str = "gate", index: str = "risk_index") -> DataFrame:
    """Rows and mean index per (event-time window, gate) (X2). With a watermark,
    rows later than it are dropped and a window is final once it passes."""
    s = scored.withWatermark(event_time, watermark) if watermark else scored
    w = F.window(event_time, window, slide) if slide else F.window(event_time, window)
    return (s.groupBy(w.alias("window"), F.col(gate_col))
             .agg(F.count(F.lit(1)).alias("n"), F.avg(index).alias("avg_index")))


def dedupe_responses(stream: DataFrame, keys: Sequence[str], event_time: str = "event_time",
                     watermark: str = "1 hour") -> DataFrame:
    """The same response delivered twice counts once (X3); state for a key is
    kept until the watermark passes its event time."""
    return stream.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark(list(keys))


def add_gate(df: DataFrame, u: str = "uncertainty", r: str = "risk_score",
             v: str = "violation") -> DataFrame:
    """Index and gate from component columns."""
    return (df.withColumn("risk_index", scoring.risk_index(u, r, v))
              .withColumn("gate", scoring.gate("risk_index")))


def run_stream(df: DataFrame, sink_path: str, name: str, output_mode: str = "append",
               fmt: str = "parquet", available_now: bool = False, processing_time: str | None = None):
    """Start a streaming query whose progress survives executor or driver loss:
    the checkpoint goes under the shared folder named by spark.checkpoint.dir
    (read from the session; set only where unset, e.g. in tests)."""
    import os

    from riskgate.session import checkpoint_dir
    ckpt = os.path.join(checkpoint_dir(df.sparkSession), "streams", name)
    w = (df.writeStream.format(fmt).outputMode(output_mode).queryName(name)
           .option("checkpointLocation", ckpt).option("path", sink_path))
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    return w.start()


def read_landing(spark: SparkSession, schema: StructType, path: str) -> DataFrame:
    """A stream of the Parquet files that arrive in the folders below ``path``."""
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def run_updates(df: DataFrame, sink_path: str, name: str, available_now: bool = False):
    """Start an update-mode aggregation whose changed rows are written as Parquet, one folder
    per micro-batch. A batch that is repeated after a failure overwrites its folder, so
    nothing counts twice. Read the present state back with :func:`latest`."""
    import os

    from riskgate.session import checkpoint_dir

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink_path}/batch={batch_id}")

    w = df.writeStream.outputMode("update").queryName(name).foreachBatch(write) \
        .option("checkpointLocation", os.path.join(checkpoint_dir(df.sparkSession), "streams", name))
    return (w.trigger(availableNow=True) if available_now else w).start()


def latest(updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last update of every key: a maximum by batch, combined map-side."""
    rest = [c for c in updates.columns if c not in (*keys, "batch")]
    last = updates.groupBy(*keys).agg(F.max(F.struct("batch", *rest)).alias("_last"))
    return last.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])


def with_late(counted: DataFrame, landed: DataFrame, event_time: str = "event_time", window: str = "1 day",
              slide: str | None = None, gate_col: str = "gate") -> DataFrame:
    """Window counts beside the rows that came too late for their window: ``landed`` are all
    rows that the stream was given, as a batch. Adds n_late; a window all of whose rows
    were late has n = 0 and no mean."""
    w = F.window(event_time, window, slide) if slide else F.window(event_time, window)
    all_rows = landed.groupBy(w.alias("window"), F.col(gate_col)).agg(F.count(F.lit(1)).alias("_landed"))
    out = all_rows.join(counted, ["window", gate_col], "left")
    n = F.coalesce("n", F.lit(0))
    return out.withColumn("n", n.cast("long")).withColumn("n_late", F.col("_landed") - n).drop("_landed")
