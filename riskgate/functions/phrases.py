"""Phrase search for large banks (P21): one pass over a text for all phrases.

``contained_count`` costs one scan of the text per phrase. Here the phrases of a row are
grouped by length; a rolling hash gives every window of a length at once, the windows
whose hash is a phrase's are found by one sorted lookup, and equal bytes confirm them. So
the cost is linear in the text for each distinct phrase length, however many phrases a
bank entry has. It runs as an Arrow pandas UDF; the JVM form remains the better one for
the few phrases of a small bank.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

#: Fixed value: the odd base of the rolling hash, modulo 2**64.
_BASE = np.uint64(0x9E3779B97F4A7C15)


def rolling(data: np.ndarray, length: int) -> np.ndarray:
    """A hash of every window of so many bytes: the sum of byte * base**place within the
    window, by doubling (log2(length) passes)."""
    out, done = np.zeros(max(0, len(data) - length + 1), dtype=np.uint64), 0
    block, width, power = data.astype(np.uint64) + np.uint64(1), 1, _BASE
    while length >> done:
        if length >> done & 1:
            offset = length & ((1 << done) - 1)
            factor = np.uint64(pow(int(_BASE), offset, 1 << 64))
            out += block[offset:offset + len(out)] * factor
        done += 1
        block = block[:-width] + block[width:] * power if len(block) > width else block[:0]
        power, width = np.uint64(int(power) ** 2 & (1 << 64) - 1), 2 * width
    return out


def count_phrases(text: str | None, phrases: list[str | None] | None) -> int:
    """How many of the phrases (repeats counted) occur in the text; case is ignored, a null
    phrase occurs nowhere, an empty one everywhere."""
    wanted = [p.lower().encode() for p in (phrases if phrases is not None else []) if p is not None]
    data = np.frombuffer((text or "").lower().encode(), dtype=np.uint8)
    raw = data.tobytes()
    by_length: dict[int, dict[bytes, int]] = {}
    for p in wanted:
        group = by_length.setdefault(len(p), {})
        group[p] = group.get(p, 0) + 1
    found = sum(by_length.pop(0, {}).values())
    with np.errstate(over="ignore"):
        for length, group in by_length.items():
            if length > len(data):
                continue
            windows = rolling(data, length)
            names = list(group)
            keys = np.concatenate([rolling(np.frombuffer(p, dtype=np.uint8), length) for p in names])
            order = np.argsort(keys, kind="stable")
            at = np.minimum(np.searchsorted(keys[order], windows), len(keys) - 1)
            seen = {raw[w:w + length] for w in np.flatnonzero(keys[order][at] == windows).tolist()}
            found += sum(n for p, n in group.items() if p in seen)
    return found


@F.pandas_udf(IntegerType())
def _count(text: pd.Series, phrases: pd.Series) -> pd.Series:
    return pd.Series([count_phrases(t, p) for t, p in zip(text, phrases, strict=True)], dtype="int32")


def indexed_count(text, phrases) -> Column:
    """``contained_count`` by the phrase index; both arguments are columns or their names."""
    text, phrases = (F.col(c) if isinstance(c, str) else c for c in (text, phrases))
    return _count(F.lower(text), F.transform(phrases, F.lower))
