"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Written independently of the Spark code from the operator definitions; tables
are the pre-registered views of the supplied Parquet files.
"""

from __future__ import annotations

from riskgate import fixed
from riskgate.functions.draws import sql_unit_draw
from riskgate.plans import catalog as Q
from riskgate.plans import files as FL
from riskgate.plans import inputs as I
from riskgate.plans import streams as ST

WS = r"[\t\n\x0B\f\r\x1C-\x1F \x85\p{Z}]+"
STRIP = fixed.TERM_STRIP_CHARS


def D(key: str, stream: str, seed: int = I.SEED) -> str:
    return sql_unit_draw(seed, key, stream)


def _quote(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def terms_ctes(name: str, src: str, key: str, text: str,
               vocab=fixed.MEDICAL_VOCABULARY, max_terms: int = fixed.TERM_MAX) -> str:
    """CTEs ``name(k, terms, n_terms)``: ordered, deduplicated extracted terms."""
    vocab_sql = ", ".join(_quote(v) for v in sorted({v.lower() for v in vocab}))
    t = """
NAME_w AS (
  SELECT k, trim(w, 'STRIP') AS w, pos FROM (
    SELECT k, unnest(arr) AS w, generate_subscripts(arr, 1) AS pos
    FROM (SELECT KEY AS k, regexp_split_to_array(translate(TEXT, ',.', '  '), 'WS') AS arr FROM SRC))
),
NAME_k AS (
  SELECT k, w, min(pos) AS pos FROM NAME_w
  WHERE lower(w) IN (VOCAB)
     OR (regexp_matches(w, '^\\p{Lu}\\p{L}{4,}$') AND regexp_matches(w, '[\\p{Ll}\\p{Lt}]'))
  GROUP BY k, w
),
NAME AS (
  SELECT k, string_agg(w, '|' ORDER BY pos) AS terms, count(*) AS n_terms
  FROM (SELECT k, w, pos, row_number() OVER (PARTITION BY k ORDER BY pos) AS rn FROM NAME_k)
  WHERE rn <= MAXT GROUP BY k
)"""
    return (t.replace("NAME", name).replace("STRIP", STRIP).replace("KEY", key)
             .replace("TEXT", text).replace("WS", WS).replace("SRC", src)
             .replace("VOCAB", vocab_sql).replace("MAXT", str(max_terms)))


def bank_ctes() -> str:
    lo, hi = I.FACT_LENGTHS
    return f"""
bw AS (
  SELECT item_id, lower(trim(w, '{STRIP}')) AS w
  FROM (SELECT item_id, unnest(regexp_split_to_array(translate(text, ',.', '  '), '{WS}')) AS w
        FROM benchmark)
),
bwl AS (SELECT item_id, w FROM bw WHERE regexp_matches(w, '^\\p{{L}}+$')),
bfacts AS (SELECT item_id, list(DISTINCT w) AS key_facts FROM bwl
           WHERE length(w) BETWEEN {lo} AND {hi} GROUP BY item_id),
bflags AS (SELECT item_id, list(DISTINCT w) AS red_flags FROM bwl
           WHERE length(w) BETWEEN {I.FLAG_LENGTHS[0]} AND {I.FLAG_LENGTHS[1]} GROUP BY item_id),
{terms_ctes('bterms', 'benchmark', 'item_id', 'text')},
bank AS (
  SELECT b.item_id AS id, b.text AS question, CAST(b.item_id % 3 + 3 AS DOUBLE) AS risk_level,
         coalesce(f.key_facts, []::VARCHAR[]) AS key_facts,
         coalesce(g.red_flags, []::VARCHAR[]) AS red_flags,
         coalesce(t.n_terms, 0) AS bank_n_terms
  FROM benchmark b LEFT JOIN bfacts f USING (item_id) LEFT JOIN bflags g USING (item_id)
  LEFT JOIN bterms t ON t.k = b.item_id
)"""


SLOTS = "(SELECT greatest(1, count(*) * {} // {}) FROM benchmark)".format(*I.SLOTS_PER_ROW)
RESP = (f"SELECT conv_id, turn, conv_id % {SLOTS} AS id, "
        "'turn' || CAST(turn AS VARCHAR) AS model, text AS response, conv_id * 100 + turn AS rk "
        "FROM conversations WHERE role = 'assistant'")


def text_features(text: str) -> list[str]:
    t = f"coalesce({text}, '')"
    n = f"CAST(length({t}) AS DOUBLE)"

    def share(chars: str, scale: float) -> str:
        return f"(({n} - length(translate({t}, {_quote(chars)}, ''))) * {scale} / ({n} + 1.0))"

    return [share(" ", 1.0), share(".", 20.0), share("e", 5.0), share(I.SYMBOLS, 1.0), f"(ln({n} + 1.0) / 10.0)"]


def value_features(value: str) -> list[str]:
    v = f"coalesce(abs({value}), 0.0)"
    return [f"({v} / ({v} + 100.0))", f"(({v} % 7.0) / 7.0)", f"(({v} % 3.0) / 3.0)", f"(({v} % 11.0) / 22.0)",
            f"(ln({v} + 1.0) / 10.0)"]


def components(features: list[str]) -> str:
    def linear(probe) -> str:
        bias, weights = probe
        return "(" + " + ".join([f"({bias})", *(f"({w}) * {x}" for w, x in zip(weights, features, strict=True))]) + ")"

    powers = [f"exp({linear(p)})" for p in I.RISK_PROBES]
    weighted = " + ".join(f"{w} * {p}" for w, p in zip(fixed.RISK_CLASS_WEIGHTS, powers, strict=True))
    return (f"1.0 / (1.0 + exp(-{linear(I.UNCERTAINTY_PROBE)})) AS uncertainty, "
            f"greatest(1.0, least(5.0, ({weighted}) / ({' + '.join(powers)}))) AS risk_score, "
            f"1.0 / (1.0 + exp(-{linear(I.VIOLATION_PROBE)})) AS violation")


INDEX_SQL = "greatest(0.0, least(25.0, uncertainty * risk_score * violation * 5.0))"
GATE = "CASE WHEN risk_index < 5 THEN 'AUTO_USE' WHEN risk_index < 20 THEN 'REVIEW' ELSE 'BLOCK' END"


def scored_docs_cte() -> str:
    return f"""
sd0 AS (SELECT doc_id, source AS model, text, {components(text_features('text'))} FROM documents),
sd1 AS (SELECT *, {INDEX_SQL} AS risk_index FROM sd0),
sd AS (SELECT *, {GATE} AS gate, risk_index / 25.0 > 0.5 AS hal FROM sd1)"""


def labelled_cte() -> str:
    return f"""
ls0 AS (SELECT l.doc_id, l.quality, l.toxic AS true_label,
               l.toxic * 15.0::DOUBLE + l.quality * 4.0::DOUBLE + {D('l.doc_id', 'sev')} * 6.0 AS true_severity,
               d.n_chars / 1000.0 AS latency_ms, {components(text_features('d.text'))}
        FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
ls1 AS (SELECT *, round(uncertainty, 12) AS score, {INDEX_SQL} AS risk_index FROM ls0),
ls AS (SELECT *, {GATE} AS gate FROM ls1)"""


def nation_bank_cte() -> str:
    return """
nbank AS (
  SELECT CAST(n.n_nationkey AS BIGINT) AS bank_pos,
         'Which region contains ' || n.n_name || '?' AS question,
         r.r_name AS correct, w.r_name AS wrong, CAST(n.n_regionkey + 1 AS INTEGER) AS risk,
         [n.n_name, r.r_name] AS entities
  FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
  JOIN region w ON w.r_regionkey = (n.n_regionkey + 1) % (SELECT count(*) FROM region)
)"""


def _auc_sql(src: str, y: str, score: str) -> str:
    return f"""(SELECT sum(p * (n_cum - n * 0.5))::DOUBLE / (sum(p) * sum(n))::DOUBLE FROM (
  SELECT *, sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n_cum FROM (
    SELECT CAST({score} AS DOUBLE) AS s, CAST(count_if({y} = 1) AS BIGINT) AS p, CAST(count_if({y} <> 1) AS BIGINT) AS n
    FROM {src} WHERE {score} IS NOT NULL AND {y} IS NOT NULL GROUP BY 1)))"""


def _ap_sql(src: str, y: str, score: str) -> str:
    return f"""(SELECT sum(p * p_cum::DOUBLE / a_cum) / sum(p) FROM (
  SELECT *, sum(p) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p_cum,
            sum(p + n) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a_cum
  FROM (SELECT CAST({score} AS DOUBLE) AS s, CAST(count_if({y} = 1) AS BIGINT) AS p, CAST(count_if({y} <> 1) AS BIGINT) AS n
        FROM {src} WHERE {score} IS NOT NULL AND {y} IS NOT NULL GROUP BY 1)))"""


def _f1_sql(src: str, y: str, score: str, t: float = 0.5) -> str:
    return f"""(SELECT CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END FROM (
  SELECT CAST(count_if({score} > {t} AND {y} = 1) AS BIGINT) AS tp, CAST(count_if({score} > {t} AND {y} <> 1) AS BIGINT) AS fp,
         CAST(count_if({score} <= {t} AND {y} = 1) AS BIGINT) AS fn FROM {src}))"""


def _judge_base(rule: str) -> str:
    return f"""WITH {bank_ctes()},
r AS ({RESP}),
j AS (
  SELECT r.conv_id, r.turn, r.id, r.rk, r.response, bank.risk_level AS risk, bank.bank_n_terms,
         len(list_filter(bank.key_facts, lambda f: contains(lower(coalesce(r.response, '')), f))) AS found,
         len(list_filter(bank.red_flags, lambda f: contains(lower(coalesce(r.response, '')), f))) AS hit,
         len(bank.key_facts) AS n_facts, len(bank.red_flags) AS n_flags
  FROM r JOIN bank ON bank.id = r.id),
m AS (SELECT *, found / greatest(n_facts, 1) AS cov, hit / greatest(n_flags, 1) AS rate FROM j)"""


SEV_RATE = ("round(CASE WHEN hit > 0 THEN least(25.0, risk * 4.0 + rate * 10.0) "
            "WHEN cov < 0.3 THEN least(25.0, risk * 2.5) "
            "ELSE greatest(0.0, risk * 0.8 * (1 - cov)) END, 2)")


def _sev_range(label: str, key: str, stream: str, lo_w, hi_w, lo_r, hi_r) -> str:
    return (f"(CASE WHEN {label} = 1 THEN {lo_w}::DOUBLE ELSE {lo_r}::DOUBLE END + "
            f"(CASE WHEN {label} = 1 THEN {hi_w - lo_w}::DOUBLE ELSE {hi_r - lo_r}::DOUBLE END) * {D(key, stream)})")


def _sev_risk(label: str, risk: str, key: str) -> str:
    r = f"CAST({risk} AS DOUBLE)"
    return (f"least(25.0, CASE WHEN {label} = 1 THEN {r} * 3.5 ELSE 0.0 END + "
            f"(CASE WHEN {label} = 1 THEN {r} * 5.0 ELSE {r} * 0.8 END - "
            f"CASE WHEN {label} = 1 THEN {r} * 3.5 ELSE 0.0 END) * {D(key, 'severity')})")


RIGHT_IDX = ("CASE (p_partkey % 6) - 1 WHEN -1 THEN CAST(p_size AS VARCHAR) WHEN 0 THEN p_name "
             "WHEN 1 THEN p_brand WHEN 2 THEN p_type WHEN 3 THEN CAST(p_size AS VARCHAR) ELSE p_name END")
WRONG_IDX = "CASE WHEN (p_partkey % 6) - 1 = 0 THEN p_brand ELSE p_name END"
ANSWER_KEY = "substr('ABCDE', CAST(p_partkey % 5 AS INTEGER) + 1, 1)"
RISK_BIN = "CAST(greatest(0, least(4, trunc({s} / 5.0))) AS INTEGER)"


def _sql() -> dict[str, str]:
    suffixes = "[" + ", ".join(_quote(s) for s in fixed.SUFFIX_POOL) + "]"
    risk_values = ", ".join(f"({_quote(k)}, {v})" for k, v in sorted(I.SOURCE_RISK.items()))
    desc = " ".join(f"WHEN {_quote(k)} THEN {_quote(v)}" for k, v in fixed.GATE_DESCRIPTIONS.items())
    u_t, u_m = fixed.EXPLAIN_UNCERTAINTY
    r_t, r_m = fixed.EXPLAIN_RISK
    v_t, v_m = fixed.EXPLAIN_VIOLATION
    part_words = " OR ".join(f"contains(p_type, {_quote(w)})" for w in I.PART_TYPE_WORDS)
    sev_ref = _sev_range("true_label", "p_partkey", "severity_ref", *fixed.SEVERITY_REFERENCE["wrong"],
                         *fixed.SEVERITY_REFERENCE["right"])
    sev_map = _sev_range("true_label", "p_partkey", "severity", *fixed.SEVERITY_OPTION_MAP["wrong"],
                         *fixed.SEVERITY_OPTION_MAP["right"])
    scored_resp = f"""sr0 AS (SELECT *, {components(text_features('response'))} FROM ({RESP})),
sr1 AS (SELECT *, {INDEX_SQL} AS risk_index FROM sr0),
sr AS (SELECT *, {GATE} AS gate FROM sr1)"""
    lin_w = f"{D('d', 'w', Q.LIN_SEED)} - 0.5"
    proj_w = f"{D("concat_ws(':', o, d)", 'proj', Q.PROJ_SEED)} - 0.5"

    out = {}
    out["qa_pairs"] = """
SELECT q.conv_id, q.turn, a.turn AS answer_turn,
       md5('Q: ' || q.text || chr(10) || 'A: ' || a.text) AS prompt_md5,
       CAST(length('Q: ' || q.text || chr(10) || 'A: ' || a.text) AS INTEGER) AS prompt_chars
FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1
WHERE q.role = 'user' AND a.role = 'assistant'"""

    out["cyclic_resample"] = f"""
WITH {nation_bank_cte()},
idx AS (SELECT doc_id AS i, doc_id % (SELECT count(*) FROM nation) AS bank_pos,
               {D('doc_id', 'label')} < 0.4 AS hal,
               list_extract({suffixes}, CAST(doc_id % 6 AS INTEGER) + 1) AS suffix FROM documents),
s AS (SELECT idx.*, nbank.*, CAST(hal AS INTEGER) AS true_label
      FROM idx JOIN nbank ON nbank.bank_pos = idx.bank_pos)
SELECT i, bank_pos, true_label, round({_sev_risk('true_label', 'risk', 'i')}, 6) AS true_severity,
       md5('Q: ' || question || coalesce(suffix, '') || chr(10) || 'A: ' ||
           CASE WHEN hal THEN wrong ELSE correct END) AS text_md5,
       CAST(len(entities) AS INTEGER) AS n_entities
FROM s"""

    union = """u AS (SELECT 'documents' AS source, CAST(doc_id AS VARCHAR) AS key, text FROM documents
    UNION ALL SELECT 'conversations', conv_id || ':' || turn, text FROM conversations WHERE role = 'assistant')"""
    out["union_sources"] = f"""
WITH {union}
SELECT source, key, CAST(length(text) AS INTEGER) AS chars,
       CAST({D("source || ':' || CAST(key AS VARCHAR)", 'label')} < 0.4 AS INTEGER) AS true_label
FROM u"""
    out["seeded_shuffle_topn"] = f"""
WITH {union}
SELECT source, key FROM u
ORDER BY md5(concat_ws(':', '{I.SEED}', source || ':' || CAST(key AS VARCHAR))) LIMIT 50"""

    out["term_extract"] = f"""
WITH {terms_ctes('t', 'documents', 'doc_id', 'text')}
SELECT d.doc_id, coalesce(t.terms, '') AS terms, CAST(coalesce(t.n_terms, 0) AS INTEGER) AS n_terms
FROM documents d LEFT JOIN t ON t.k = d.doc_id"""

    out["term_vocab"] = f"""
WITH {terms_ctes('t', 'documents', 'doc_id', 'text', I.CORPUS_VOCABULARY)}
SELECT d.doc_id,
       CASE WHEN d.source IS NOT NULL AND d.source <> ''
            THEN CASE WHEN coalesce(t.terms, '') = '' THEN d.source ELSE t.terms || '|' || d.source END
            ELSE coalesce(t.terms, '') END AS terms,
       CAST(coalesce(t.n_terms, 0) + CASE WHEN d.source IS NOT NULL AND d.source <> '' THEN 1 ELSE 0 END
            AS INTEGER) AS n_terms
FROM documents d LEFT JOIN t ON t.k = d.doc_id"""

    out["content_key"] = """
SELECT doc_id, CAST(('0x' || substr(md5(text), 1, 8))::UBIGINT % 2147483648 AS BIGINT) AS content_key
FROM documents"""

    out["option_pick"] = f"""
SELECT p_partkey, {RIGHT_IDX} AS right_idx, {WRONG_IDX} AS wrong_idx,
       CASE {ANSWER_KEY} WHEN 'A' THEN p_name WHEN 'B' THEN p_brand WHEN 'C' THEN p_type
            WHEN 'D' THEN CAST(p_size AS VARCHAR) ELSE p_name END AS right_key,
       CASE WHEN {ANSWER_KEY} = 'A' THEN p_brand ELSE p_name END AS wrong_key
FROM part"""

    out["corrupt_inject"] = f"""
WITH p AS (SELECT p_partkey, p_name, {RIGHT_IDX} AS r, {WRONG_IDX} AS w,
                  {D('p_partkey', 'label')} < 0.4 AS hal FROM part),
s AS (SELECT p_partkey, p_name, CASE WHEN hal AND w IS NOT NULL THEN w ELSE r END AS answer,
             CAST(hal AND w IS NOT NULL AS INTEGER) AS true_label FROM p),
t AS (SELECT *, {sev_map} AS sev FROM s)
SELECT p_partkey, true_label, md5('Q: ' || p_name || chr(10) || 'A: ' || answer) AS text_md5,
       round(sev, 6) AS true_severity, {RISK_BIN.format(s='sev')} AS risk_bin,
       CAST(sev > 15.0 AS INTEGER) AS violation
FROM t"""

    out["severity_label"] = f"""
WITH p AS (SELECT p_partkey, CAST(p_size % 5 + 1 AS INTEGER) AS risk,
                  CAST({D('p_partkey', 'label')} < 0.4 AS INTEGER) AS true_label FROM part),
t AS (SELECT *, {_sev_risk('true_label', 'risk', 'p_partkey')} AS sev, {sev_ref} AS sev_ref FROM p)
SELECT p_partkey, risk, true_label, round(sev, 6) AS true_severity, round(sev_ref, 6) AS sev_ref,
       {RISK_BIN.format(s='sev')} AS risk_bin, CAST(sev > 15.0 AS INTEGER) AS violation
FROM t"""

    out["risk_lookup"] = f"""
SELECT d.doc_id, d.source, CAST(coalesce(r.risk, 3) AS INTEGER) AS risk,
       'docs_' || lower(replace(d.source, ' ', '_')) AS source_tag
FROM documents d LEFT JOIN (VALUES {risk_values}) r(src, risk) ON r.src = d.source"""

    out["category_filter_topn"] = f"""
SELECT p_partkey, p_type FROM part WHERE {part_words} ORDER BY p_partkey LIMIT 100"""

    out["index_gate"] = f"""
WITH {scored_docs_cte()}
SELECT doc_id, round(uncertainty, 4) AS uncertainty, round(risk_score, 4) AS risk_score,
       round(violation, 4) AS violation, round(risk_index, 4) AS risk_index, gate,
       CAST(risk_index / 25.0 > 0.5 AS INTEGER) AS y_pred
FROM sd"""

    out["explain"] = f"""
WITH {scored_docs_cte()},
{terms_ctes('t', 'documents', 'doc_id', 'text')},
e AS (SELECT *, concat_ws('; ',
        CASE WHEN uncertainty > {u_t} THEN {_quote(u_m)} END,
        CASE WHEN risk_score > {r_t} THEN {_quote(r_m)} END,
        CASE WHEN violation > {v_t} THEN {_quote(v_m)} END) AS parts FROM sd),
f AS (SELECT *, CASE WHEN parts = '' THEN {_quote(fixed.EXPLAIN_DEFAULT)} ELSE parts END AS p FROM e)
SELECT f.doc_id, gate, CASE gate {desc} END AS description,
       '[' || gate || '] ' || upper(substr(p, 1, 1)) || lower(substr(p, 2)) || '.' AS explanation,
       CAST(coalesce(t.n_terms, 0) AS INTEGER) AS entity_count
FROM f LEFT JOIN t ON t.k = f.doc_id"""

    out["judge_rate"] = f"""
{_judge_base('rate')},
{terms_ctes('rt', '(' + RESP + ')', 'rk', 'response')}
SELECT conv_id, turn, id, CAST(cov < 0.3 OR rate > 0.3 AS INTEGER) AS is_hallucinated,
       {SEV_RATE} AS severity, round(cov, 3) AS fact_coverage, CAST(hit AS INTEGER) AS red_flags_hit,
       CAST(found AS INTEGER) AS facts_found, CAST(n_facts AS INTEGER) AS total_key_facts,
       CAST(CASE WHEN coalesce(rt.n_terms, 0) = 0 THEN bank_n_terms ELSE rt.n_terms END AS INTEGER) AS n_terms
FROM m LEFT JOIN rt ON rt.k = m.rk"""

    out["audit_results"] = f"""
{_judge_base('rate')},
{terms_ctes('rt', '(' + RESP + ')', 'rk', 'response')}
SELECT m.id, r.model, CAST(cov < 0.3 OR rate > 0.3 AS INTEGER) AS is_hallucinated,
       {SEV_RATE} AS severity,
       CAST(CASE WHEN coalesce(rt.n_terms, 0) = 0 THEN m.bank_n_terms ELSE rt.n_terms END AS INTEGER) AS n_entities,
       md5('Q: ' || bank.question || chr(10) || 'A: ' || m.response) AS text_md5
FROM m JOIN ({RESP}) r ON r.rk = m.rk JOIN bank ON bank.id = m.id LEFT JOIN rt ON rt.k = m.rk
WHERE m.response IS NOT NULL AND m.response <> '' AND m.response <> {_quote(fixed.RESPONSE_PLACEHOLDER)}"""

    out["scored_audit"] = f"""
{_judge_base('rate')},
{scored_resp}
SELECT m.id, sr.model, CAST(cov < 0.3 OR rate > 0.3 AS INTEGER) AS is_hallucinated, {SEV_RATE} AS severity,
       round(uncertainty, 4) AS uncertainty, round(risk_score, 4) AS risk_score, round(violation, 4) AS violation,
       round(risk_index, 2) AS risk_index, gate,
       md5('Q: ' || bank.question || chr(10) || 'A: ' || m.response) AS text_md5
FROM m JOIN sr ON sr.rk = m.rk JOIN bank ON bank.id = m.id
WHERE m.response IS NOT NULL AND m.response <> '' AND m.response <> {_quote(fixed.RESPONSE_PLACEHOLDER)}"""

    out["compare_models"] = f"""
{_judge_base('any')},
{scored_resp},
a AS (SELECT model, round(avg(risk_index), 2) AS avg_index,
             round(avg(CAST(cov < 0.3 OR hit > 0 AS DOUBLE)) * 100, 1) AS hal_rate,
             CAST(count_if(risk_index < 5) AS BIGINT) AS auto,
             CAST(count_if(risk_index >= 5 AND risk_index < 20) AS BIGINT) AS review,
             CAST(count_if(risk_index >= 20) AS BIGINT) AS block
      FROM m JOIN sr ON sr.rk = m.rk
      WHERE m.response IS NOT NULL AND m.response <> '' AND m.response <> {_quote(fixed.RESPONSE_PLACEHOLDER)}
      GROUP BY model)
SELECT *, CASE WHEN avg_index < 4 THEN 3 WHEN avg_index < 7 THEN 2 ELSE 1 END AS grade,
       CAST(rank() OVER (ORDER BY avg_index) AS INTEGER) AS rank FROM a"""

    out["fit_counts"] = f"""
WITH s AS (SELECT CAST(label = 0 AS INTEGER) AS true_label, vec_id, {D('vec_id', 'split', fixed.SPLIT_SEED)} AS d FROM embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY true_label ORDER BY d, vec_id) AS rn,
             count(*) OVER (PARTITION BY true_label) AS n FROM s)
SELECT CASE WHEN rn <= ceil(CAST(n AS DOUBLE) * 0.2) THEN 'test' ELSE 'train' END AS split, true_label, count(*) AS n
FROM r GROUP BY 1, 2"""
    out["fit_stationarity"] = """
SELECT probe, CAST(d AS INTEGER) AS dim, true AS stationary
FROM (VALUES ('uncertainty'), ('violation')) p(probe), (SELECT unnest(range(max(len(embedding)))) AS d FROM embeddings)"""

    out["fit_risk_descent"] = """
SELECT 'objective falls' AS "check", CAST(k AS INTEGER) AS place, true AS holds FROM range(1, 9) r(k)
UNION ALL SELECT name, CAST(k AS INTEGER), true
FROM (VALUES ('gradient at the start'), ('gradient at the end')) n(name), range(0, 12) r(k)"""
    out["saved_score"] = "SELECT vec_id AS sample_id, true AS same_index, true AS same_gate FROM embeddings"
    out["judge_indexed"] = f"""
{_judge_base('rate')}
SELECT conv_id, turn, id, CAST(cov < 0.3 OR rate > 0.3 AS INTEGER) AS is_hallucinated, {SEV_RATE} AS severity,
  CAST(hit AS INTEGER) AS red_flags_hit, CAST(found AS INTEGER) AS facts_found FROM m"""
    out["bucketed_judge"] = f"""
{_judge_base('rate')}
SELECT conv_id, turn, id, CAST(cov < 0.3 OR rate > 0.3 AS INTEGER) AS is_hallucinated, {SEV_RATE} AS severity FROM m"""
    out["latency_sketch"] = "SELECT event_type, count(*) AS n, true AS within FROM events GROUP BY event_type"
    out["response_files"] = f"""
WITH r AS ({RESP})
SELECT CASE WHEN form > 0 THEN question END AS question, CASE WHEN form > 0 THEN id END AS id, CASE WHEN form > 0 THEN model END AS model,
  CASE WHEN form > 0 THEN md5(response) END AS response_md5,
  CASE form WHEN 0 THEN 'broken' WHEN 1 THEN 'documents' ELSE 'lines' END AS folder,
  CASE WHEN form = 0 THEN '{{"id": "' || id || '", "question": "' || question || '", "resp' END AS bad_record
FROM (SELECT conv_id % {FL.FORMS} AS form, CAST(id AS VARCHAR) AS id, model, conv_id || ':' || turn AS question, response FROM r)"""
    out["bank_files"] = f"""
WITH {bank_ctes()}
SELECT CAST(id AS VARCHAR) AS id, CAST(risk_level AS INTEGER) AS risk_level, CAST(len(key_facts) AS INTEGER) AS n_facts,
  CAST(len(red_flags) AS INTEGER) AS n_flags, md5(question) AS question_md5 FROM bank"""
    out["result_files"] = f"""
WITH r AS ({RESP}),
models AS (SELECT DISTINCT model FROM r)
SELECT CAST(item_id AS VARCHAR) AS id, m.model, count(r.conv_id) AS n, md5(max(response)) AS last_md5,
  CASE WHEN regexp_matches(m.model, '[02468]$') THEN 2 ELSE 1 END AS version
FROM benchmark CROSS JOIN models m LEFT JOIN r ON r.id = item_id AND r.model = m.model GROUP BY item_id, m.model"""
    (dm, dr), (rm, rr) = ST.DELAYED, ST.REPEATED
    drops = f"""
WITH bounds AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events),
drops AS (
  SELECT event_id, ts, value, CAST(floor((epoch_us(ts) - lo) * {ST.DELIVERIES} / (hi - lo + 1)) AS BIGINT)
      + CAST(event_id % {dm} = {dr} AS BIGINT) + unnest(range(0, CASE WHEN event_id % {rm} = {rr} THEN 2 ELSE 1 END)) AS drop
  FROM events, bounds),
e0 AS (SELECT event_id, ts, drop, {components(value_features('value'))} FROM drops),
e1 AS (SELECT *, {INDEX_SQL} AS risk_index FROM e0),
e AS (SELECT *, {GATE} AS gate FROM e1)"""
    out["stream_scores"] = f"{drops}\nSELECT event_id, round(risk_index, 6) AS risk_index, gate FROM e"
    out["stream_gate_windows"] = f"""{drops},
marks AS (
  SELECT k, (SELECT max(date_trunc('milliseconds', ts)) FROM drops WHERE drop < k) - INTERVAL {ST.WATERMARK} AS mark
  FROM range(0, {ST.DELIVERIES + 2}) r(k)),
placed AS (
  SELECT e.*, date_trunc('day', ts) - INTERVAL 1 day * d AS w,
    mark IS NOT NULL AND date_trunc('day', ts) - INTERVAL 1 day * d + INTERVAL {ST.WINDOW} <= mark AS late
  FROM e JOIN marks ON k = drop, (VALUES (0), (1)) v(d))
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, gate, count(*) FILTER (NOT late) AS n,
  round(avg(risk_index) FILTER (NOT late), 6) AS avg_index, count(*) FILTER (late) AS n_late
FROM placed GROUP BY 1, 2"""
    out["stream_dedupe"] = "SELECT event_id, value FROM events"
    out["judge_any_flag"] = f"""
{_judge_base('any')}
SELECT conv_id, turn, id, CAST(cov < 0.3 OR hit > 0 AS INTEGER) AS is_hallucinated,
       round(CASE WHEN cov < 0.3 OR hit > 0 THEN least(25.0, risk * 4.5 * (1 - cov) + hit * 5.0)
                  ELSE greatest(0.0, risk * 0.5 * (1 - cov)) END, 2) AS severity,
       round(cov, 3) AS fact_coverage, CAST(hit AS INTEGER) AS red_flags_hit
FROM m"""

    out["unmatched_responses"] = f"""
SELECT conv_id, turn, conv_id % {SLOTS} AS id FROM conversations
WHERE role = 'assistant' AND conv_id % {SLOTS} NOT IN (SELECT item_id FROM benchmark)"""

    out["outstanding"] = f"""
WITH r AS (SELECT conv_id % {SLOTS} AS id, 'turn' || CAST(turn AS VARCHAR) AS model
           FROM conversations WHERE role = 'assistant' AND text IS NOT NULL AND text <> ''
             AND text <> {_quote(fixed.RESPONSE_PLACEHOLDER)}),
m AS (SELECT DISTINCT 'turn' || CAST(turn AS VARCHAR) AS model FROM conversations WHERE role = 'assistant')
SELECT b.item_id AS id, m.model, substr(b.text, 1, {fixed.SNIPPET_HINT}) || '...' AS hint,
       {_quote(fixed.RESPONSE_PLACEHOLDER)} AS response
FROM benchmark b CROSS JOIN m
WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.id = b.item_id AND r.model = m.model)"""

    out["positional_zip"] = """
SELECT 'turn' || CAST(c.turn AS VARCHAR) AS model, c.conv_id AS pos,
       CAST(length(b.text) AS INTEGER) AS q_chars, CAST(length(c.text) AS INTEGER) AS r_chars
FROM conversations c JOIN benchmark b ON b.item_id = c.conv_id WHERE c.role = 'assistant'"""

    out["variant_expand"] = """
WITH b AS (SELECT p_partkey AS bank_pos, p_name AS correct, p_brand AS wrong,
                  CAST(p_size % 5 + 1 AS INTEGER) AS risk FROM part)
SELECT bank_pos, 0 AS label, correct AS answer, 0.5::DOUBLE AS severity FROM b
UNION ALL
SELECT bank_pos, 1 AS label, wrong AS answer, round(CAST(risk AS DOUBLE) * 5.0, 6) AS severity FROM b"""

    pool_tail = """
x AS (SELECT sample_id, layer, CAST(unnest(embedding) AS DOUBLE) AS v,
             generate_subscripts(embedding, 1) - 1 AS dim FROM s),
m AS (SELECT sample_id, layer, dim, avg(v) AS mv FROM x GROUP BY sample_id, layer, dim)
SELECT sample_id, CAST(dim AS INTEGER) AS dim,
       round(sum(mv * CASE layer WHEN 0 THEN 0.2 WHEN 1 THEN 0.5 ELSE 0.3 END), 6) + 0.0 AS value
FROM m GROUP BY sample_id, dim"""
    out["layer_pool"] = f"""
WITH s AS (SELECT vec_id // 10 AS sample_id, vec_id % 3 AS layer, embedding FROM embeddings),
{pool_tail}"""
    out["entity_position_pool"] = f"""
WITH s AS (SELECT vec_id // 10 AS sample_id, vec_id % 3 AS layer, embedding FROM embeddings e
           WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id // 10 = e.vec_id // 10
                                                AND l.doc_id % 10 = e.vec_id % 10)),
{pool_tail}"""

    out["scale_stats"] = """
WITH x AS (SELECT CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) - 1 AS dim
           FROM embeddings)
SELECT CAST(dim AS INTEGER) AS dim, round(avg(v), 6) + 0.0 AS mean, round(stddev_pop(v), 6) AS std
FROM x GROUP BY dim"""

    out["project"] = f"""
WITH w AS (SELECT o, d, {proj_w} AS w FROM range({Q.PROJ_OUT}) t1(o), range(64) t2(d)),
x AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) - 1 AS d
      FROM embeddings)
SELECT vec_id, CAST(o AS INTEGER) AS dim, round(sum(v * w), 6) + 0.0 AS value
FROM x JOIN w USING (d) GROUP BY vec_id, o"""

    out["linear_apply"] = f"""
WITH x AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) - 1 AS d
           FROM embeddings),
st AS (SELECT d, avg(v) AS mu, CASE WHEN stddev_pop(v) > 0 THEN stddev_pop(v) ELSE 1.0 END AS sd
       FROM x GROUP BY d),
w AS (SELECT d, {lin_w} AS w FROM range(64) t(d))
SELECT vec_id, round(1.0 / (1.0 + exp(-(sum((v - mu) / sd * w) + {Q.LIN_BIAS}))), 6) AS probability
FROM x JOIN st USING (d) JOIN w USING (d) GROUP BY vec_id"""

    s1, s2 = Q.RELU_SEEDS
    relu = f"""WITH x AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) - 1 AS d
           FROM embeddings),
w1 AS (SELECT o AS h, d, {D("concat_ws(':', o, d)", 'relu1', s1)} - 0.5 AS w
       FROM range({Q.RELU_HIDDEN}) t1(o), range(64) t2(d)),
b1 AS (SELECT h, {D('9000 + h', 'relu1b', s1)} - 0.5 AS b FROM range({Q.RELU_HIDDEN}) t(h)),
h0 AS (SELECT vec_id, h, sum(v * w) AS z FROM x JOIN w1 USING (d) GROUP BY vec_id, h),
h1 AS (SELECT vec_id, h, greatest(z + b, 0.0) AS a FROM h0 JOIN b1 USING (h)),
w2 AS (SELECT o AS k, h, {D("concat_ws(':', o, h)", 'relu2', s2)} - 0.5 AS w
       FROM range({Q.RELU_OUT}) t1(o), range({Q.RELU_HIDDEN}) t2(h)),
b2 AS (SELECT k, {D('9000 + k', 'relu2b', s2)} - 0.5 AS b FROM range({Q.RELU_OUT}) t(k)),
o0 AS (SELECT vec_id, k, sum(a * w) AS z FROM h1 JOIN w2 USING (h) GROUP BY vec_id, k),
o1 AS (SELECT vec_id, k, z + b AS z FROM o0 JOIN b2 USING (k)),
m AS (SELECT vec_id, max(z) AS mz FROM o1 GROUP BY vec_id),
e AS (SELECT vec_id, k, exp(z - mz) AS e FROM o1 JOIN m USING (vec_id))"""
    out["relu_network"] = relu + """
SELECT vec_id, CAST(k AS INTEGER) AS dim, round(e / sum(e) OVER (PARTITION BY vec_id), 6) AS value FROM e"""
    out["expected_risk"] = relu + """
SELECT vec_id, round(greatest(1.0, least(5.0, sum(e * (k + 1)) / sum(e))), 6) AS expected_risk FROM e GROUP BY vec_id"""

    out["model_report"] = f"""
WITH {scored_docs_cte()}
SELECT model, count(*) AS n, round(avg(risk_index), 6) AS avg_index, round(avg(CAST(hal AS DOUBLE)), 6) AS hal_rate,
       CAST(count_if(gate = 'AUTO_USE') AS BIGINT) AS n_auto, CAST(count_if(gate = 'REVIEW') AS BIGINT) AS n_review,
       CAST(count_if(gate = 'BLOCK') AS BIGINT) AS n_block
FROM sd GROUP BY model"""

    out["model_stats"] = f"""
WITH {scored_docs_cte()},
a AS (SELECT model, round(avg(risk_index), 2) AS avg_index, round(avg(CAST(hal AS DOUBLE)) * 100, 1) AS hal_rate,
             CAST(count_if(risk_index < 5) AS BIGINT) AS auto, CAST(count_if(risk_index >= 5 AND risk_index < 20) AS BIGINT) AS review,
             CAST(count_if(risk_index >= 20) AS BIGINT) AS block FROM sd GROUP BY model)
SELECT *, CASE WHEN avg_index < 4 THEN 3 WHEN avg_index < 7 THEN 2 ELSE 1 END AS grade FROM a"""

    out["gate_distribution"] = f"""
WITH {scored_docs_cte()},
g AS (SELECT * FROM (VALUES ('AUTO_USE'), ('REVIEW'), ('BLOCK')) t(gate)),
c AS (SELECT gate, count(*) AS n FROM sd GROUP BY gate)
SELECT g.gate, coalesce(c.n, 0) AS n,
       round(coalesce(c.n, 0) / sum(coalesce(c.n, 0)) OVER (), 6) AS share
FROM g LEFT JOIN c ON c.gate = g.gate"""

    out["model_rank"] = f"""
WITH {scored_docs_cte()},
a AS (SELECT model, round(avg(risk_index), 6) AS avg_index FROM sd GROUP BY model)
SELECT model, avg_index, CAST(rank() OVER (ORDER BY avg_index) AS INTEGER) AS rank FROM a"""

    out["models_first_seen"] = """
SELECT source AS model, min(doc_id) AS first_pos,
       CAST(row_number() OVER (ORDER BY min(doc_id), source) AS INTEGER) AS model_pos
FROM documents GROUP BY source"""

    out["question_grid"] = f"""
WITH {scored_resp}
SELECT id, model, round(mean, 6) AS mean_index,
       CASE WHEN mean IS NULL THEN NULL WHEN mean < 5 THEN 'AUTO_USE' WHEN mean < 20 THEN 'REVIEW' ELSE 'BLOCK' END AS gate
FROM (SELECT DISTINCT id FROM sr) CROSS JOIN (SELECT DISTINCT model FROM sr)
LEFT JOIN (SELECT id, model, avg(risk_index) AS mean FROM sr GROUP BY id, model) USING (id, model)"""

    out["fill_rate"] = f"""
SELECT role, CAST(count_if(text IS NOT NULL AND text <> '' AND text <> {_quote(fixed.RESPONSE_PLACEHOLDER)}) AS BIGINT) AS n_filled,
       count(*) AS n_total,
       round(count_if(text IS NOT NULL AND text <> '' AND text <> {_quote(fixed.RESPONSE_PLACEHOLDER)})
             / count(*), 6) AS fill_rate
FROM conversations GROUP BY role"""

    out["response_detail"] = f"""
{_judge_base('rate')},
{scored_resp},
mo AS (SELECT model, CAST(row_number() OVER (ORDER BY min(conv_id * 1000000 + turn), model) AS INTEGER) AS model_pos
       FROM sr GROUP BY model)
SELECT mo.model_pos, sr.model, m.id, m.conv_id, m.turn, sr.gate, round(sr.risk_index, 6) AS risk_index,
       CAST(cov < 0.3 OR rate > 0.3 AS INTEGER) AS verdict,
       md5(substr(m.response, 1, {fixed.SNIPPET_RESPONSE}) || '...') AS snippet_md5
FROM m JOIN sr ON sr.rk = m.rk JOIN mo ON mo.model = sr.model"""

    out["eval_auc"] = f"WITH {labelled_cte()} SELECT round({_auc_sql('ls', 'true_label', 'score')}, 6) AS auc_roc"
    out["eval_ap"] = f"WITH {labelled_cte()} SELECT round({_ap_sql('ls', 'true_label', 'score')}, 6) AS avg_precision"
    out["eval_f1"] = f"WITH {labelled_cte()} SELECT round({_f1_sql('ls', 'true_label', 'score')}, 6) AS f1"
    out["eval_accuracy"] = f"""
WITH {labelled_cte()},
b AS (SELECT {RISK_BIN.format(s='true_severity')} AS actual,
             {RISK_BIN.format(s='risk_index')} AS predicted
      FROM ls)
SELECT round(avg(CAST(predicted = actual AS DOUBLE)), 6) AS accuracy FROM b"""
    out["eval_corr"] = f"WITH {labelled_cte()} SELECT round(corr(risk_index, true_severity), 6) + 0.0 AS severity_pearson_r FROM ls"
    out["eval_latency"] = """
SELECT event_type, round(avg(value), 6) AS avg_latency_ms, round(quantile_cont(value, 0.95), 6) AS p95_latency_ms
FROM events GROUP BY event_type"""
    out["label_stats"] = """
SELECT CAST(count_if(toxic = 1) AS BIGINT) AS n_hallucinated, CAST(count_if(toxic = 0) AS BIGINT) AS n_clean,
       round(avg(CAST(toxic AS DOUBLE)) * 100, 1) AS pct_hallucinated FROM labels"""
    out["mean_by_label"] = f"""
WITH {labelled_cte()}
SELECT true_label, round(avg(risk_index), 6) AS mean_index, count(*) AS n FROM ls GROUP BY true_label"""
    out["evaluation"] = f"""
WITH {labelled_cte()},
e AS (SELECT *, risk_index / 25.0 AS y FROM ls)
SELECT round({_auc_sql('e', 'true_label', 'y')}, 4) AS auc_roc,
       round({_ap_sql('e', 'true_label', 'y')}, 4) AS avg_precision,
       round({_f1_sql('e', 'true_label', 'y')}, 4) AS f1,
       (SELECT round(corr(risk_index, true_severity), 4) + 0.0 FROM e) AS severity_pearson_r,
       (SELECT CAST(count_if(gate = 'AUTO_USE') AS BIGINT) FROM e) AS gate_auto_use,
       (SELECT CAST(count_if(gate = 'REVIEW') AS BIGINT) FROM e) AS gate_review,
       (SELECT CAST(count_if(gate = 'BLOCK') AS BIGINT) FROM e) AS gate_block,
       (SELECT count(*) FROM e) AS n_test,
       (SELECT round(avg(latency_ms), 3) FROM e) AS avg_latency_ms,
       (SELECT round(quantile_cont(latency_ms, 0.95), 3) FROM e) AS p95_latency_ms"""
    out["random_baseline"] = f"""
SELECT doc_id, round({D('doc_id', 'random', fixed.RANDOM_BASELINE_SEED)}, 6) AS random_score FROM labels"""
    methods = {"random": D("doc_id", "random", fixed.RANDOM_BASELINE_SEED), "uncertainty": "uncertainty",
               "index": "risk_index / 25.0"}
    parts = []
    for name, expr in methods.items():
        parts.append(f"""SELECT '{name}' AS method,
       round({_auc_sql('mc', 'true_label', 'y_' + name)}, 4) AS auc_roc,
       round({_ap_sql('mc', 'true_label', 'y_' + name)}, 4) AS avg_precision,
       round({_f1_sql('mc', 'true_label', 'y_' + name)}, 4) AS f1""")
    mc_cols = ", ".join(f"{expr} AS y_{name}" for name, expr in methods.items())
    out["method_compare"] = f"""
WITH {labelled_cte()},
mc AS (SELECT *, {mc_cols} FROM ls)
""" + "\nUNION ALL\n".join(parts)
    out["benchmark_record"] = f"""
SELECT 'evaluation' AS section, 'probes' AS method, metric, round(value, 4) AS value
FROM (UNPIVOT (SELECT CAST(COLUMNS(*) AS DOUBLE) FROM ({out["evaluation"]})) ON COLUMNS(*) INTO NAME metric VALUE value)
UNION ALL
SELECT 'methods', method, metric, value
FROM (UNPIVOT ({out["method_compare"]}) ON auc_roc, avg_precision, f1 INTO NAME metric VALUE value)"""
    out["stratified_split"] = f"""
WITH s AS (SELECT doc_id, toxic, {D('doc_id', 'split')} AS d FROM labels),
r AS (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY d, doc_id) AS rn,
             count(*) OVER (PARTITION BY toxic) AS n FROM s)
SELECT doc_id, toxic, CASE WHEN rn <= ceil(CAST(n AS DOUBLE) * 0.2) THEN 'test' ELSE 'train' END AS split
FROM r"""
    out["stratified_split_many"] = f"""
WITH s AS (SELECT d.doc_id, CASE WHEN l.toxic IS NOT NULL THEN d.n_chars END AS size, {D('d.doc_id', 'split')} AS d
           FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY size ORDER BY d, doc_id) AS rn,
             count(*) OVER (PARTITION BY size) AS n FROM s)
SELECT doc_id, size, CASE WHEN rn <= ceil(CAST(n AS DOUBLE) * 0.2) THEN 'test' ELSE 'train' END AS split FROM r"""
    out["group_split"] = f"""
WITH g AS (SELECT DISTINCT md5(text) AS text_key FROM documents),
r AS (SELECT text_key, row_number() OVER (ORDER BY {D('text_key', 'group_split')}, text_key) AS rn,
             count(*) OVER () AS n FROM g)
SELECT d.doc_id, CASE WHEN rn <= ceil(CAST(n AS DOUBLE) * 0.2) THEN 'test' ELSE 'train' END AS split
FROM documents d JOIN r ON r.text_key = md5(d.text)"""
    out["qa_judge_report"] = f"""
WITH {bank_ctes()},
p AS (SELECT q.conv_id, q.turn, a.turn AS answer_turn, a.text AS response,
             q.conv_id % {SLOTS} AS id, 'turn' || CAST(a.turn AS VARCHAR) AS model,
             q.conv_id * 100 + q.turn AS rk
      FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1
      WHERE q.role = 'user' AND a.role = 'assistant'),
j AS (SELECT p.*, bank.risk_level AS risk,
             len(list_filter(bank.key_facts, lambda f: contains(lower(coalesce(p.response, '')), f))) AS found,
             len(list_filter(bank.red_flags, lambda f: contains(lower(coalesce(p.response, '')), f))) AS hit,
             len(bank.key_facts) AS n_facts, len(bank.red_flags) AS n_flags
      FROM p JOIN bank ON bank.id = p.id),
m AS (SELECT *, found / greatest(n_facts, 1) AS cov, hit / greatest(n_flags, 1) AS rate FROM j),
c AS (SELECT model, (cov < 0.3 OR rate > 0.3) AS hal, {components(text_features('response'))} FROM m),
q1 AS (SELECT *, {INDEX_SQL} AS risk_index FROM c),
q AS (SELECT *, {GATE} AS gate FROM q1)
SELECT model, count(*) AS n, round(avg(risk_index), 6) AS avg_index, round(avg(CAST(hal AS DOUBLE)), 6) AS hal_rate,
       CAST(count_if(gate = 'AUTO_USE') AS BIGINT) AS n_auto, CAST(count_if(gate = 'REVIEW') AS BIGINT) AS n_review,
       CAST(count_if(gate = 'BLOCK') AS BIGINT) AS n_block
FROM q GROUP BY model"""
    out["gate_windows"] = f"""
WITH e0 AS (SELECT ts, {components(value_features('value'))} FROM events),
e1 AS (SELECT *, {INDEX_SQL} AS risk_index FROM e0),
e AS (SELECT *, {GATE} AS gate FROM e1)
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, gate,
       count(*) AS n, round(avg(risk_index), 6) AS avg_index
FROM e GROUP BY 1, 2"""
    subj_values = ", ".join(f"({_quote(k)}, {v})" for k, v in fixed.SUBJECT_RISK.items())
    part_qa = """pq AS (
  SELECT p_partkey AS sample_id, p_name AS question, p_brand AS opa, p_type AS opb,
         'size ' || CAST(p_size AS VARCHAR) AS opc, p_name AS opd, CAST(p_partkey % 6 - 1 AS INTEGER) AS cop,
         CASE p_size % 4 WHEN 0 THEN 'Surgery' WHEN 1 THEN 'Forensic Medicine' WHEN 2 THEN NULL
              ELSE p_type END AS subject_name, p_type AS category, p_size
  FROM part)"""
    sample_out = """SELECT s.sample_id, md5('Q: ' || question || chr(10) || 'A: ' || answer) AS text_md5,
       ENTITIES AS entities, CAST(NENT AS INTEGER) AS n_entities, true_label,
       round(sev, 6) AS true_severity, SOURCE AS source
FROM s LEFT JOIN t ON t.k = s.sample_id"""
    out["source_option_columns"] = f"""
WITH {part_qa},
r AS (SELECT pq.*, coalesce(pq.subject_name, 'Medicine') AS subj FROM pq),
rr AS (SELECT r.*, coalesce(sr.risk, 3) AS base_risk FROM r LEFT JOIN (VALUES {subj_values}) sr(subject, risk)
       ON sr.subject = r.subj),
o AS (SELECT *, CASE cop WHEN -1 THEN opd WHEN 0 THEN opa WHEN 1 THEN opb WHEN 2 THEN opc WHEN 3 THEN opd
                ELSE opa END AS right_o, CASE WHEN cop = 0 THEN opb ELSE opa END AS wrong_o,
              {D('sample_id', 'label')} < 0.4 AS hal FROM rr),
s0 AS (SELECT *, CASE WHEN hal THEN wrong_o ELSE right_o END AS answer, CAST(hal AS INTEGER) AS true_label FROM o),
s AS (SELECT *, {_sev_risk('true_label', 'base_risk', 'sample_id')} AS sev,
             question || ' ' || answer AS qa_text FROM s0),
{terms_ctes('t', 's', 'sample_id', 'qa_text')}
""" + (sample_out.replace("ENTITIES", "CASE WHEN coalesce(t.terms, '') = '' THEN subj ELSE t.terms || '|' || subj END")
       .replace("NENT", "coalesce(t.n_terms, 0) + 1")
       .replace("SOURCE", f"'{fixed.SOURCE_TAG_OPTION_COLUMNS_PREFIX}' || lower(replace(subj, ' ', '_'))"))
    out["source_option_map"] = f"""
WITH {part_qa},
o AS (SELECT *, substr('ABCDE', CAST(sample_id % 5 AS INTEGER) + 1, 1) AS k,
             {D('sample_id', 'label')} < 0.4 AS hal FROM pq),
o2 AS (SELECT *, CASE k WHEN 'A' THEN opa WHEN 'B' THEN opb WHEN 'C' THEN opc WHEN 'D' THEN opd ELSE opa END
                 AS right_o, CASE WHEN k = 'A' THEN opb ELSE opa END AS wrong_o FROM o),
s0 AS (SELECT *, CASE WHEN hal THEN wrong_o ELSE right_o END AS answer, CAST(hal AS INTEGER) AS true_label FROM o2),
s AS (SELECT *, {_sev_range('true_label', 'sample_id', 'severity', *fixed.SEVERITY_OPTION_MAP['wrong'],
                            *fixed.SEVERITY_OPTION_MAP['right'])} AS sev,
             question || ' ' || answer AS qa_text FROM s0),
{terms_ctes('t', 's', 'sample_id', 'qa_text')}
""" + (sample_out.replace("ENTITIES", "coalesce(t.terms, '')").replace("NENT", "coalesce(t.n_terms, 0)")
       .replace("SOURCE", _quote(fixed.SOURCE_TAG_OPTION_MAP)))
    cat_words = " OR ".join(f"contains(category, {_quote(w)})" for w in I.PART_TYPE_WORDS)
    out["source_reference_answer"] = f"""
WITH {part_qa},
o AS (SELECT *, {D('sample_id', 'label')} < 0.4 AS hal,
             CASE WHEN p_size % 3 = 0 THEN 'Unknown' ELSE opb END AS wrong_o FROM pq
      WHERE {cat_words}),
s0 AS (SELECT *, CASE WHEN hal THEN wrong_o ELSE opa END AS answer, CAST(hal AS INTEGER) AS true_label FROM o),
s AS (SELECT *, {_sev_range('true_label', 'sample_id', 'severity', *fixed.SEVERITY_REFERENCE['wrong'],
                            *fixed.SEVERITY_REFERENCE['right'])} AS sev,
             question || ' ' || answer AS qa_text FROM s0),
{terms_ctes('t', 's', 'sample_id', 'qa_text')}
""" + (sample_out.replace("ENTITIES", "coalesce(t.terms, '')").replace("NENT", "coalesce(t.n_terms, 0)")
       .replace("SOURCE", _quote(fixed.SOURCE_TAG_REFERENCE)))
    return out


ORACLE_SQL: dict[str, str] = _sql()
