"""Answer-option expressions and label draws.

Options are arrays (of strings, or of key/value structs when keyed), so the
order that decides "first wrong option" is explicit; a MapType has no order.
``try_element_at`` keeps the expressions safe under ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskgate import fixed
from riskgate.functions import draws


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def right_by_key(options, answer_key, default_key: str = "A") -> Column:
    """Value whose key is the answer; the first value if the key is absent."""
    opts, ans = _col(options), F.coalesce(_col(answer_key), F.lit(default_key))
    hit = F.try_element_at(F.filter(opts, lambda o: o["key"] == ans), F.lit(1))
    return F.coalesce(hit["value"], F.try_element_at(opts, F.lit(1))["value"])


def first_wrong_by_key(options, answer_key, default_key: str = "A") -> Column:
    """First value whose key is not the answer, null if none."""
    opts, ans = _col(options), F.coalesce(_col(answer_key), F.lit(default_key))
    return F.try_element_at(F.filter(opts, lambda o: o["key"] != ans), F.lit(1))["value"]


def right_by_index(options, index) -> Column:
    """0-based option; a negative index counts from the end; an index past the
    end falls back to the first option (P2b). A null index means 0."""
    opts, i = _col(options), F.coalesce(_col(index), F.lit(0)).cast("int")
    return (F.when(i >= F.size(opts), F.try_element_at(opts, F.lit(1)))
            .when(i >= 0, F.try_element_at(opts, i + 1))
            .otherwise(F.try_element_at(opts, i)))


def first_wrong_by_index(options, index) -> Column:
    """First option at a position other than ``index``."""
    opts, i = _col(options), F.coalesce(_col(index), F.lit(0)).cast("int")
    return F.try_element_at(F.filter(opts, lambda x, pos: pos != i), F.lit(1))


def corrupted(seed, key, rate=fixed.HALLUCINATION_RATE, stream: str = "label") -> Column:
    """The seeded Bernoulli(rate) corruption draw."""
    return draws.bernoulli(seed, key, stream, rate)


def pick_output(draw_col, wrong, right) -> Column:
    """Wrong text when drawn and a wrong text exists, else the right one."""
    return F.when(_col(draw_col) & _col(wrong).isNotNull(), _col(wrong)).otherwise(_col(right))


def used_wrong(draw_col, wrong) -> Column:
    """Label: 1 only when the wrong text was really used (fixes D4)."""
    return (_col(draw_col) & _col(wrong).isNotNull()).cast("int")


def severity_fixed_range(label, seed, key, ranges: dict, stream: str = "severity") -> Column:
    """Uniform severity from the 'wrong' or 'right' range by label."""
    lo_w, hi_w = ranges["wrong"]
    lo_r, hi_r = ranges["right"]
    is_wrong = _col(label) == 1
    low = F.when(is_wrong, F.lit(lo_w)).otherwise(F.lit(lo_r))
    high = F.when(is_wrong, F.lit(hi_w)).otherwise(F.lit(hi_r))
    return draws.uniform(seed, key, stream, low, high)


def severity_by_risk(label, risk, seed, key, stream: str = "severity") -> Column:
    """Risk-scaled severity (P6): wrong r*3.5..r*5, right 0..0.8 r, capped at 25."""
    r = _col(risk).cast("double")
    is_wrong = _col(label) == 1
    low = F.when(is_wrong, r * fixed.SEVERITY_RISK_WRONG[0]).otherwise(F.lit(0.0))
    high = F.when(is_wrong, r * fixed.SEVERITY_RISK_WRONG[1]).otherwise(r * fixed.SEVERITY_RISK_RIGHT)
    return F.least(F.lit(fixed.SEVERITY_CAP), draws.uniform(seed, key, stream, low, high))
