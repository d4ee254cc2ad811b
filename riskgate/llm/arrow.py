"""Small helpers for operators that work on Arrow batches inside tasks.

Each operator gets single rows of (carried columns, text); Spark partitions the
work. Texts are handed on as UTF-8 bytes, whole and in slices of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of one output batch hold at most about so many bytes of text.
SLICE_BYTES = 4 << 20
#: Bytes of a batch from Spark under `small_batches`, about; less than a slice, so that it is not cut again.
BATCH_BYTES = 3 << 20
_BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """From now on Spark's Arrow batches in this session take about BATCH_BYTES, or are of one
    row; a limit that the session has stays. Spark's own is 64 MB, which a task holds several
    times: as vectors, as the message to Python, there, and in what malloc keeps of them.
    It stays set, as lazy results are run later; batches don't change any result."""
    if spark.conf.get(_BATCH_LIMIT, None) is None:
        spark.conf.set(_BATCH_LIMIT, str(BATCH_BYTES))


def texts_of(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, None for null."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """The batch in row ranges whose texts take about SLICE_BYTES (one row at least)."""
    sizes = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > SLICE_BYTES:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start, batch.num_rows - start)


def map_texts(df: DataFrame, carry: dict[str, Column], text: Column,
              make: Callable[[], Callable[[list[bytes | None]], dict[str, list]]],
              out: StructType) -> DataFrame:
    """One output row per input row: the carried columns, then what the function
    that `make()` builds once per task returns for the texts, as columns of `out`."""
    base = df.select(*[c.alias(n) for n, c in carry.items()], text.cast("string").alias("__text"))
    schema = StructType(base.schema.fields[:-1] + out.fields)
    names = list(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target, work = to_arrow_schema(schema), make()
        for whole in batches:
            for batch in slices(whole, len(names)):
                got = work(texts_of(batch.column(len(names))))
                columns = [batch.column(i).cast(target.field(i).type) for i in range(len(names))]
                columns += [pa.array(got[f.name], type=target.field(f.name).type) for f in out.fields]
                yield pa.RecordBatch.from_arrays(columns, schema=target)

    return base.mapInArrow(run, schema)


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def own_names(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that extra columns can't clash with an operator's."""
    return df.select(*[F.col(n) for n in names])
