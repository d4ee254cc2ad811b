"""Keyword judge: required facts and red flags as substring tests.

The response is lower-cased once; each bank phrase is a case-insensitive
substring test. Cost is rows x (facts + flags) substring scans of the whole text,
all inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskgate import fixed



def _empty() -> Column:
    return F.array().cast("array<string>")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def contained_count(text, phrases) -> Column:
    """How many of ``phrases`` occur in ``text``, case-insensitively.

    A null phrase list counts as empty; a null text as the empty string.
    """
    # The lowered text rides in the fold's accumulator, so it is computed once
    # per row: an expression referenced inside a lambda is re-evaluated for
    # every element, which on a long response means one lower() per phrase.
    init = F.struct(F.lower(F.coalesce(_col(text), F.lit(""))).alias("t"), F.lit(0).alias("n"))

    def step(acc, p):
        hit = F.when(F.contains(acc["t"], F.lower(p)), F.lit(1)).otherwise(F.lit(0))
        return F.struct(acc["t"].alias("t"), (acc["n"] + hit).alias("n"))

    return F.aggregate(F.coalesce(_col(phrases), _empty()), init, step, lambda acc: acc["n"])


def _size(arr) -> Column:
    return F.size(F.coalesce(_col(arr), _empty()))


def judge_rate(text, facts, flags, risk, default_risk: int = fixed.DEFAULT_RISK, count=contained_count) -> Column:
    """Rate-variant judgment struct (P22a). ``count`` says how many phrases a text holds:
    ``contained_count``, or ``phrases.indexed_count`` for banks of many phrases.

    hallucinated = coverage < 0.3 or flag rate > 0.3. Severity: any flag ->
    min(25, 4 r + 10 rate); low coverage -> min(25, 2.5 r); else
    max(0, 0.8 r (1 - coverage)). Severity rounded to 2, coverage to 3.
    """
    found = count(text, facts)
    hit = count(text, flags)
    n_facts = _size(facts)
    n_flags = _size(flags)
    coverage = found / F.greatest(n_facts, F.lit(1))
    rate = hit / F.greatest(n_flags, F.lit(1))
    r = F.coalesce(_col(risk), F.lit(default_risk)).cast("double")
    low_cov = coverage < fixed.JUDGE_COVERAGE_BELOW
    severity = (F.when(hit > 0, F.least(F.lit(fixed.SEVERITY_CAP),
                                        r * fixed.JUDGE_FLAG_PER_RISK + rate * fixed.JUDGE_FLAG_RATE_WEIGHT))
                .when(low_cov, F.least(F.lit(fixed.SEVERITY_CAP), r * fixed.JUDGE_LOW_COVERAGE_PER_RISK))
                .otherwise(F.greatest(F.lit(0.0), r * fixed.JUDGE_CLEAN_PER_RISK * (1 - coverage))))
    return F.struct(
        (low_cov | (rate > fixed.JUDGE_FLAG_RATE_ABOVE)).alias("is_hallucinated"),
        F.round(severity, 2).alias("severity"),
        F.round(coverage, 3).alias("fact_coverage"),
        hit.alias("red_flags_hit"),
        found.alias("facts_found"),
        n_facts.alias("total_key_facts"),
    )


def judge_any_flag(text, facts, flags, risk, count=contained_count) -> Column:
    """Any-flag variant (P22b): hallucinated if coverage < 0.3 or any flag.

    Severity when hallucinated min(25, 4.5 r (1 - cov) + 5 flags), else
    max(0, 0.5 r (1 - cov)); rounded to 2.
    """
    found = count(text, facts)
    hit = count(text, flags)
    coverage = found / F.greatest(_size(facts), F.lit(1))
    r = _col(risk).cast("double")
    is_hal = (coverage < fixed.JUDGE_COVERAGE_BELOW) | (hit > 0)
    severity = F.when(is_hal, F.least(F.lit(fixed.SEVERITY_CAP),
                                      r * fixed.JUDGE_B_PER_RISK * (1 - coverage) + hit * fixed.JUDGE_B_PER_FLAG)) \
        .otherwise(F.greatest(F.lit(0.0), r * fixed.JUDGE_B_CLEAN_PER_RISK * (1 - coverage)))
    return F.struct(is_hal.alias("is_hallucinated"), F.round(severity, 2).alias("severity"),
                    F.round(coverage, 3).alias("fact_coverage"), hit.alias("red_flags_hit"),
                    found.alias("facts_found"))


def term_fallback(terms, bank_terms, default: str = fixed.FALLBACK_ENTITY) -> Column:
    """Extracted terms, or the bank's when none were found."""
    t = F.coalesce(_col(terms), _empty())
    bank = F.coalesce(_col(bank_terms), F.array(F.lit(default)))
    return F.when(F.size(t) == 0, bank).otherwise(t)


def is_filled(response, placeholder: str = fixed.RESPONSE_PLACEHOLDER) -> Column:
    """Response present: not null, not the empty string, not the placeholder (F2).

    Exact comparisons, as in the reference: a blank-but-not-empty response counts
    as filled.
    """
    r = _col(response)
    return r.isNotNull() & (r != "") & (r != placeholder)
