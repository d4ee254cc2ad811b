"""A user's own function as a pipeline step (the judge and extractor swaps).

The user gives a factory; each Python worker calls it once and keeps what it returns (a
model, a compiled pattern, a client), and every Arrow batch goes through that. The rows
keep their partitions: one narrow ``mapInArrow``, no shuffle.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType

#: What this worker has loaded, by the step's token.
_LOADED: dict[str, object] = {}


def loaded(token: str, factory: Callable[[], object]) -> object:
    """The factory's product, made once in this worker."""
    if token not in _LOADED:
        _LOADED[token] = factory()
    return _LOADED[token]


def apply_rows(df: DataFrame, inputs: Sequence[str], factory: Callable[[], Callable], out: str, kind: DataType | str) -> DataFrame:
    """``df`` with a column ``out``: what the function that ``factory()`` returns gives for
    the input columns of a row (nulls included, as None)."""
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(kind) if isinstance(kind, str) else kind
    rows = df.withColumn(out, F.lit(None).cast(kind))
    schema, names, token = StructType(rows.schema.fields), list(inputs), uuid.uuid4().hex

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        function = loaded(token, factory)
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]
            made = pa.array([function(*row) for row in zip(*columns, strict=True)], type=target.field(out).type)
            kept = [made if f.name == out else batch.column(k).cast(f.type) for k, f in enumerate(target)]
            yield pa.RecordBatch.from_arrays(kept, schema=target)

    return rows.mapInArrow(run, schema)


JUDGMENT = "struct<is_hallucinated: boolean, severity: double, fact_coverage: double, red_flags_hit: int, facts_found: int, total_key_facts: int>"


def custom_judge(df: DataFrame, factory: Callable[[], Callable], inputs: Sequence[str] = ("response", "key_facts", "red_flags", "risk_level"),
                 out: str = "judgment") -> DataFrame:
    """A judge of the user's: a function of (response, key_facts, red_flags, risk_level) that
    returns a dict with the fields of JUDGMENT."""
    return apply_rows(df, inputs, factory, out, JUDGMENT)


def custom_extractor(df: DataFrame, factory: Callable[[], Callable], text: str = "response", out: str = "entities") -> DataFrame:
    """An extractor of the user's: a function of a text that returns a list of terms."""
    return apply_rows(df, [text], factory, out, ArrayType(StringType()))
