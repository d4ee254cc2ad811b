"""Text column functions: prompt text, term extraction, snippets, content keys.

All of them are built-in expressions (split / transform / filter / regex), so
they run inside the JVM on whole texts; no Python UDF touches a row.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskgate import fixed

# Whitespace as Python's str.split() sees it: ASCII controls, the file/group/
# record/unit separators, NEL, and every Unicode separator (Zs, Zl, Zp).
WHITESPACE_RE = r"[\t\n\x0B\f\r\x1C-\x1F \x85\p{Z}]+"
# The same set as characters, derived from str.isspace (the set ends at U+3000).
WHITESPACE_CHARS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
# Capitalised word: first letter upper case, all letters, longer than 4.
CAPITALISED_RE = r"^\p{Lu}\p{L}{%d,}$" % fixed.TERM_MIN_LENGTH_EXCLUSIVE
# "Not all upper case": at least one lower- or title-case letter.
HAS_LOWER_RE = r"[\p{Ll}\p{Lt}]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def prompt_text(question, answer, suffix=None) -> Column:
    """'Q: <question><suffix>\\nA: <answer>' (P1)."""
    parts = [F.lit("Q: "), _col(question)]
    if suffix is not None:
        parts.append(F.coalesce(_col(suffix), F.lit("")))
    parts += [F.lit("\nA: "), _col(answer)]
    return F.concat(*parts)


def words(text) -> Column:
    """Whole-text word list: ',' and '.' and every Unicode space become ' ',
    then a split on the single literal space (Java's non-regex fast path).
    Runs of separators leave empty strings, which no keep-rule accepts."""
    seps = WHITESPACE_CHARS.replace(" ", "") + fixed.TERM_SEPARATORS
    return F.split(F.translate(_col(text), seps, " " * len(seps)), " ")


def extract_terms(text, vocabulary: Iterable[str] = fixed.MEDICAL_VOCABULARY,
                  max_terms: int = fixed.TERM_MAX) -> Column:
    """Rule-based key-term extraction (P9, with O2 first-n and A13 dedupe).

    A word (after stripping brackets and punctuation from both ends) is kept if
    its lower case is in ``vocabulary``, or if it is longer than four letters,
    all letters, starts upper case and is not all upper case. Duplicates are
    dropped case-sensitively keeping first occurrence; the first ``max_terms``
    remain. A null text gives an empty list.
    """
    vocab = sorted({v.lower() for v in vocabulary})
    stripped = F.transform(words(text), lambda w: F.trim(w, F.lit(fixed.TERM_STRIP_CHARS)))

    def keep(w: Column) -> Column:
        in_vocab = F.lower(w).isin(vocab) if vocab else F.lit(False)
        first = F.substring(w, 1, 1)
        # cheap tests first: the regexes only run on long words starting with a cased capital
        capitalised = ((F.length(w) > fixed.TERM_MIN_LENGTH_EXCLUSIVE) & (first != F.lower(first))
                       & w.rlike(CAPITALISED_RE) & w.rlike(HAS_LOWER_RE))
        return in_vocab | capitalised

    kept = F.array_distinct(F.filter(stripped, keep))
    return F.coalesce(F.slice(kept, 1, max_terms), F.array().cast("array<string>"))


def append_term(terms, term) -> Column:
    """Append ``term`` when it is non-empty, without dedupe."""
    t = _col(term)
    return F.when(t.isNotNull() & (t != ""), F.array_append(_col(terms), t)).otherwise(_col(terms))


def snippet(text, n: int, tail: str = fixed.SNIPPET_TAIL) -> Column:
    """First ``n`` characters plus '...' always (P10)."""
    return F.concat(F.substring(_col(text), 1, n), F.lit(tail))


def content_key(text) -> Column:
    """First 8 hex digits of MD5(text) as an integer, mod 2^31."""
    return F.pmod(F.conv(F.substring(F.md5(_col(text)), 1, 8), 16, 10).cast("long"),
                  F.lit(2 ** 31))


def source_tag(prefix: str, category) -> Column:
    """prefix + lower-case category with spaces as underscores."""
    return F.concat(F.lit(prefix), F.lower(F.translate(_col(category), " ", "_")))
