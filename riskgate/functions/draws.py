"""Deterministic random draws as column expressions.

``rand(seed)`` depends on how rows land in partitions, so a re-run on another
cluster (or after an executor is lost) would draw differently. A draw here is a
pure function of (seed, row key, stream name): the first 32 bits of an MD5
digest scaled to [0, 1). It is the same in Spark and in any SQL engine that has
``md5``, which is what makes sampled labels oracle-checkable.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCALE = float(2 ** 32)


def _as_col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def unit_draw(seed, key, stream: str) -> Column:
    """Uniform [0, 1) draw for ``key`` (any column) under ``seed`` and ``stream``."""
    digest = F.md5(F.concat_ws(":", _as_col(seed).cast("string"),
                               _as_col(key).cast("string"), F.lit(stream)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(_SCALE)


def uniform(seed, key, stream: str, low, high) -> Column:
    """Uniform [low, high) draw; ``low``/``high`` may be columns."""
    lo, hi = _as_col(low), _as_col(high)
    return lo + (hi - lo) * unit_draw(seed, key, stream)


def bernoulli(seed, key, stream: str, rate) -> Column:
    """True with probability ``rate``."""
    return unit_draw(seed, key, stream) < _as_col(rate)


def unit_draw_py(seed, key, stream: str) -> float:
    """The same draw in plain Python (for small parameter tables on the driver)."""
    text = f"{seed}:{key}:{stream}".encode()
    return int(hashlib.md5(text).hexdigest()[:8], 16) / _SCALE


def sql_unit_draw(seed, key_sql: str, stream: str) -> str:
    """DuckDB/ANSI-style SQL text of :func:`unit_draw` (for oracle queries)."""
    return (f"(('0x' || substr(md5(concat_ws(':', '{seed}', CAST({key_sql} AS VARCHAR), "
            f"'{stream}')), 1, 8))::UBIGINT / 4294967296.0)")
