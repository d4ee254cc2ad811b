"""Intermediate tables in the shared folder that the cluster names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from riskgate.session import checkpoint_dir


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of `df`, written as Parquet below spark.checkpoint.dir and read again.

    Cuts the lineage and survives lost executors. The folder belongs to the run, like
    Spark's own checkpoints in it, and may be emptied once the results are written;
    `dropped` gives up a table earlier."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.stored_path = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Delete tables that `stored` returned, after the results of their last readers are
    stored themselves."""
    for table in tables:
        jvm, session = table.sparkSession._jvm, table.sparkSession._jsparkSession
        path = jvm.org.apache.hadoop.fs.Path(table.stored_path)
        path.getFileSystem(session.sessionState().newHadoopConf()).delete(path, True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """`df` dealt by keys to spark.sql.shuffle.partitions tasks, for stages whose work is
    in the tasks and not in the bytes, by which adaptive execution would merge them."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
