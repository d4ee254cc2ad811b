"""Quality rules, line first.

Every line is judged on its own by navigation, punctuation and boilerplate rules;
failing lines are removed, and a document is rejected when the removal costs it too
much of its text, or when its whole text fails the base rules. One pass over each
text, line by line: what stays in memory is one number per word and the document's
distinct words. No shuffle.

Defined results: a null or blank text has no words, so it fails the base rules and
is not kept; blank lines are neither judged nor counted, and stay out of the cleaned
text; repeated rows are judged alike, one output row each; other columns of the
input are not read. Words are runs of anything but ASCII white space.
"""

from __future__ import annotations

from array import array
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from riskgate.llm.arrow import map_texts

# Fixed values of the rules.
SYMBOLS = "#*$%&|<>"
SEPARATORS = ("|", "»", "›", "•", "·", "/", ">")
MAX_SEPARATOR_PCT = 20
DOUBLED = ("!!", "##", "$$", "%%", "&&", "**")
MAX_DOUBLED_PCT = 20
TERMINALS = (".", "!", "?", "…", ":", ";", '"', "'", "”", "’", "»", ")")
UNENDED_WORDS = 10
PHRASES = ("all rights reserved", "licensed under", "released under the", "cookie policy", "privacy policy",
           "terms of use", "terms of service", "enable javascript", "click here", "subscribe to", "sign up for",
           "lorem ipsum")
BOILERPLATE_WORDS = 25
MIN_WORDS = 50
MAX_REPEAT_PCT = 50
MIN_KEPT_PCT = 50

_SEPARATORS = frozenset(s.encode() for s in SEPARATORS)
_DOUBLED = frozenset(s.encode() for s in DOUBLED)
_TERMINALS = tuple(s.encode() for s in TERMINALS)
_PHRASES = tuple(s.encode() for s in PHRASES)
_UPPER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def line_fails(line: bytes, words: list[bytes]) -> str | None:
    """The first rule that a line with words fails, or None."""
    n = len(words)
    if any(s in line for s in _SEPARATORS) and 100 * sum(map(_SEPARATORS.__contains__, words)) >= MAX_SEPARATOR_PCT * n:
        return "navigation"
    if any(d in line for d in _DOUBLED) and 100 * sum(w[-2:] in _DOUBLED for w in words) >= MAX_DOUBLED_PCT * n:
        return "punctuation"
    if n < UNENDED_WORDS and not words[-1].endswith(_TERMINALS):
        return "punctuation"
    if n <= BOILERPLATE_WORDS:
        low = line.translate(_UPPER)
        if any(p in low for p in _PHRASES):
            return "boilerplate"
    return None


def code_points(data: bytes) -> int:
    return len(data) if data.isascii() else len(data.decode("utf-8", "replace"))


def repeated_words(ids: np.ndarray) -> int:
    """Words that lie in a 3-word window which the text holds twice or more."""
    if len(ids) < 4:
        return 0
    pairs = np.unique(ids[:-1] * (int(ids.max()) + 1) + ids[1:], return_inverse=True)[1]
    windows = pairs[:-1] * len(ids) + ids[2:]
    _, place, count = np.unique(windows, return_inverse=True, return_counts=True)
    twice = count[place] > 1
    inside = np.zeros(len(ids), dtype=bool)
    for k in range(3):
        inside[k:k + len(twice)] |= twice
    return int(inside.sum())


def judge(data: bytes) -> tuple:
    """Measures of one text, and what its lines leave over."""
    seen: set[bytes] = set()
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    ids = array("q")
    chars = dup_lines = kept_chars = removed = 0
    left: list[bytes] = []
    for line in data.split(b"\n"):
        words = line.split()
        if not words:
            continue
        if line in seen:
            dup_lines += 1
        else:
            seen.add(line)
        ids.extend(map(number.__getitem__, words))
        size = code_points(b"".join(words))
        chars += size
        if line_fails(line, words) is None:
            kept_chars += size
            left.append(line)
        else:
            removed += 1
    symbols = sum(data.count(s.encode()) for s in SYMBOLS)
    repeat = repeated_words(np.frombuffer(ids, dtype=np.int64)) if ids else 0
    n = len(ids)
    failed = n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PCT * n
    kept = not failed and 100 * kept_chars >= MIN_KEPT_PCT * chars
    return n, chars, symbols, dup_lines, repeat, failed, kept, removed, kept_chars, b"\n".join(left).decode("utf-8", "replace")


OUT = StructType([
    StructField("n_words", LongType()), StructField("word_chars", LongType()), StructField("n_symbols", LongType()),
    StructField("n_dup_lines", LongType()), StructField("n_repeat_words", LongType()),
    StructField("base_failed", BooleanType()), StructField("kept", BooleanType()),
    StructField("n_removed_lines", LongType()), StructField("kept_chars", LongType()),
    StructField("clean_text", StringType())])


def quality_rules(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Per row: the carried columns, the base measures, `base_failed`, the verdict
    `kept`, and the text without its failing lines."""
    def make():
        def work(texts):
            rows = [judge(t or b"") for t in texts]
            return {f.name: [r[i] for r in rows] for i, f in enumerate(OUT.fields)}
        return work

    return map_texts(docs, {c: F.col(c) for c in carry}, F.col(text), make, OUT)
