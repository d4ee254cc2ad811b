"""Index, gate and explanation expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskgate import fixed


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _valid(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x)


def risk_index(uncertainty, risk, violation, factor: float = fixed.INDEX_FACTOR,
               low: float = fixed.INDEX_MIN, high: float = fixed.INDEX_MAX) -> Column:
    """u * r * v * factor clipped to [low, high].

    A null or NaN product stays null: unguarded, ``least``/``greatest`` would
    turn it into the upper bound, i.e. BLOCK.
    """
    p = _col(uncertainty).cast("double") * _col(risk) * _col(violation) * F.lit(factor)
    return F.when(_valid(p), F.greatest(F.lit(low), F.least(F.lit(high), p)))


def gate(index, auto_below: float = fixed.GATE_AUTO_USE_BELOW,
         block_from: float = fixed.GATE_BLOCK_FROM) -> Column:
    """AUTO_USE / REVIEW / BLOCK, lower edges inclusive (P12); null stays null."""
    x = _col(index)
    return (F.when(~_valid(x), F.lit(None).cast("string"))
            .when(x < auto_below, F.lit("AUTO_USE"))
            .when(x < block_from, F.lit("REVIEW"))
            .otherwise(F.lit("BLOCK")))


def gate_description(gate_col, descriptions: dict[str, str] = fixed.GATE_DESCRIPTIONS) -> Column:
    """Sentence for each gate."""
    g = _col(gate_col)
    out = None
    for name, text in descriptions.items():
        out = (F.when(g == name, F.lit(text)) if out is None
               else out.when(g == name, F.lit(text)))
    return out


def capitalize(s) -> Column:
    """First character upper case, the rest lower case (Python str.capitalize)."""
    x = _col(s)
    return F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1 << 30)))


def explanation(uncertainty, risk, violation, gate_col,
                u_rule=fixed.EXPLAIN_UNCERTAINTY, r_rule=fixed.EXPLAIN_RISK,
                v_rule=fixed.EXPLAIN_VIOLATION, default: str = fixed.EXPLAIN_DEFAULT) -> Column:
    """'[GATE] Reason; reason.' (P14)."""
    parts = F.concat_ws(
        "; ",
        F.when(_col(uncertainty) > u_rule[0], F.lit(u_rule[1])),
        F.when(_col(risk) > r_rule[0], F.lit(r_rule[1])),
        F.when(_col(violation) > v_rule[0], F.lit(v_rule[1])),
    )
    text = F.when(parts == "", F.lit(default)).otherwise(parts)
    return F.concat(F.lit("["), _col(gate_col), F.lit("] "), capitalize(text), F.lit("."))


def risk_bin(severity, width: float = fixed.RISK_BIN_WIDTH,
             top: int = fixed.RISK_BIN_MAX) -> Column:
    """truncate(severity / width) clipped to 0..top."""
    return F.greatest(F.lit(0), F.least(F.lit(top), (_col(severity) / width).cast("int")))


def violation_label(severity, above: float = fixed.VIOLATION_SEVERITY_ABOVE) -> Column:
    """1 when severity > 15."""
    return (_col(severity) > above).cast("int")


def term_count(terms) -> Column:
    """Number of terms."""
    return F.size(F.coalesce(_col(terms), F.array().cast("array<string>")))


def normalised(index, high: float = fixed.INDEX_MAX) -> Column:
    """index / 25."""
    return _col(index) / F.lit(high)


def predicted_label(score, threshold: float = fixed.PREDICT_THRESHOLD) -> Column:
    """1 when score > threshold."""
    return (_col(score) > threshold).cast("int")


def grade(mean_index, edges=fixed.GRADE_EDGES) -> Column:
    """3 / 2 / 1 by mean index."""
    m = _col(mean_index)
    return F.when(m < edges[0], F.lit(3)).when(m < edges[1], F.lit(2)).otherwise(F.lit(1))


def score_struct(uncertainty, risk, violation, index, gate_col, entity_count,
                 explanation_col) -> Column:
    """Rounded score record, 4 places for components (P20)."""
    return F.struct(
        F.round(_col(uncertainty), 4).alias("uncertainty_score"),
        F.round(_col(risk), 4).alias("risk_score"),
        F.round(_col(violation), 4).alias("causal_violation_prob"),
        F.round(_col(index), 4).alias("risk_index"),
        _col(gate_col).alias("gate"),
        _col(entity_count).alias("entity_count"),
        _col(explanation_col).alias("explanation"),
    )
