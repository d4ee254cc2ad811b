"""DuckDB SQL for the registered queries that SQL can express on whole tables.

Not here, and tested against brute force instead: token counts, compression language
id, SentencePiece, edit-distance decontamination, role repair and host-path extraction.
"""

from __future__ import annotations

import functools

from riskgate.llm import quality, queries

WORD = r"[^\x20\x09-\x0D]+"


def _strings(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP2 = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT rid, doc_id, text, regexp_extract_all(text, '{WORD}') AS w FROM docs),
windows AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM windows) WHERE n > 1),
repeats AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
lines AS (
  SELECT rid, line, w, len(w) AS n, list_sum(list_transform(w, lambda x: length(x))) AS chars FROM (
    SELECT rid, line, regexp_extract_all(line, '{WORD}') AS w
    FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM docs)) WHERE len(w) > 0),
judged AS (
  SELECT rid, line, chars,
    100 * len(list_filter(w, lambda x: x IN ({_strings(quality.SEPARATORS)}))) >= {quality.MAX_SEPARATOR_PCT} * n
    OR 100 * len(list_filter(w, lambda x: right(x, 2) IN ({_strings(quality.DOUBLED)}))) >= {quality.MAX_DOUBLED_PCT} * n
    OR (n < {quality.UNENDED_WORDS} AND right(w[n], 1) NOT IN ({_strings(quality.TERMINALS)}))
    OR (n <= {quality.BOILERPLATE_WORDS} AND len(list_filter([{_strings(quality.PHRASES)}],
          lambda p: contains(translate(line, '{_UPPER}', '{_LOWER}'), p))) > 0) AS fails
  FROM lines),
per_doc AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines, CAST(sum(chars) AS BIGINT) AS chars,
    count(*) FILTER (fails) AS n_removed_lines, CAST(coalesce(sum(chars) FILTER (NOT fails), 0) AS BIGINT) AS kept_chars
  FROM judged GROUP BY rid),
measured AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(chars, 0) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
    coalesce(n_removed_lines, 0) AS n_removed_lines, coalesce(kept_chars, 0) AS kept_chars
  FROM words LEFT JOIN per_doc USING (rid) LEFT JOIN repeats r USING (rid))
SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PCT} * n_words AS base_failed,
  NOT (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PCT} * n_words)
    AND 100 * kept_chars >= {quality.MIN_KEPT_PCT} * word_chars AS kept
FROM measured
"""


def _op5() -> str:
    rules = " ".join(
        f"WHEN (host = '{r.host}' OR suffix(host, '.{r.host}')) AND prefix(path, '{r.path}') THEN '{r.text}'"
        for r in sorted(queries.URL_RULES, key=lambda r: (-len(r.text), r.text)))
    verdicts = " ".join(f"WHEN '{r.text}' THEN '{r.verdict}'" for r in queries.URL_RULES)
    listed = "|".join(queries.LISTED_WORDS)
    return rf"""
WITH parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
    coalesce(regexp_extract(url, '://[^/?#]*[^?#]*\?([^#]*)', 1), '') AS query FROM pages),
canon AS (
  SELECT page_id, host, path, CASE WHEN site <> '' THEN site || regexp_replace(path, '/(?:index\.html?)?$', '')
    || CASE WHEN left_over <> '' THEN '?' || left_over ELSE '' END END AS canonical
  FROM (SELECT *, regexp_replace(host, '^www\.|:(?:80|443)$', '', 'g') AS site,
    regexp_replace(regexp_replace(query, '(?:^|&)(?:utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '', 'g'), '^&', '') AS left_over
    FROM parts)),
listed AS (SELECT DISTINCT canonical FROM canon WHERE regexp_matches(host, '(?:^|[.-])(?:{listed})(?:[.-]|$)')),
ruled AS (SELECT *, CASE {rules} END AS rule FROM canon)
SELECT page_id, host, path, rule,
  coalesce(CASE rule {verdicts} END, CASE WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
  rule IS NULL AND l.canonical IS NOT NULL AS listed
FROM ruled LEFT JOIN listed l USING (canonical)
"""


def _components(words: int, percent: int) -> str:
    """Documents linked by shingles of so many words, brute force: (doc_id, n_shingles, component_id)."""
    run = " || ' ' || ".join(f"w[i + {k}]" if k else "w[i]" for k in range(words))
    return rf"""
WITH RECURSIVE docs AS (
  SELECT DISTINCT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORD}') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, {run} AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {words - 2})) AS i FROM docs WHERE len(w) >= {words})
  UNION SELECT doc_id, '<' || array_to_string(w, ' ') FROM docs WHERE len(w) BETWEEN 1 AND {words - 1}),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b USING (s) WHERE a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * shared.n >= {percent} * (x.n + y.n - shared.n)),
reach AS (
  SELECT doc_id, doc_id AS other FROM docs
  UNION SELECT reach.doc_id, CASE WHEN links.a = other THEN links.b ELSE links.a END
  FROM reach JOIN links ON links.a = other OR links.b = other)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM documents LEFT JOIN sizes USING (doc_id)
JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)
"""


OP7 = _components(queries.JACCARD_RULE.words, queries.JACCARD_RULE.percent)
OP12 = f"SELECT *, doc_id = component_id AS kept FROM ({_components(queries.NEAR_RULE.words, queries.NEAR_RULE.percent)})"

#: One byte's effect on the reflected CRC-32 register, by long division.
_CRC = [functools.reduce(lambda c, _: c >> 1 ^ (c & 1) * 0xEDB88320, range(8), i) for i in range(256)]

OP11 = rf"""
WITH RECURSIVE runs AS (
  SELECT doc_id, run, count(*) AS c FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents)
  WHERE length(run) >= 5 GROUP BY doc_id, run),
hashed AS (
  SELECT run, c, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
      string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
      lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT] ELSE [195::BIGINT, ord(x)::BIGINT - 64] END))),
    lambda r, x: xor(r >> 8, ({_CRC}::BIGINT[])[xor(r & 255, x) + 1])), 4294967295) AS h FROM runs),
vocabulary AS (
  SELECT word, sum(c)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c
    FROM hashed) WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
without AS (
  SELECT word, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest
  FROM (SELECT word, unnest(range(1, length(word) + 1)) AS p FROM vocabulary)),
near AS (
  SELECT a.word, b.word AS other FROM without a JOIN without b ON a.p = b.p AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT word, rest FROM without WHERE rest IN (SELECT word FROM vocabulary)
  UNION SELECT rest, word FROM without WHERE rest IN (SELECT word FROM vocabulary)),
best AS (
  SELECT a.word, a.n, other, b.n AS other_n, count(*) OVER (PARTITION BY a.word) AS n_near,
    row_number() OVER (PARTITION BY a.word ORDER BY b.n DESC, other) AS place
  FROM near JOIN vocabulary a ON a.word = near.word JOIN vocabulary b ON b.word = near.other),
forms AS (
  SELECT word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * v.n THEN other END AS form,
    CASE WHEN other_n >= 2 * v.n THEN other_n END AS form_n
  FROM vocabulary v LEFT JOIN (SELECT * FROM best WHERE place = 1) USING (word)),
walk AS (
  SELECT word, word AS root FROM forms
  UNION ALL SELECT walk.word, form FROM walk JOIN forms ON forms.word = walk.root WHERE form IS NOT NULL)
SELECT forms.*, root FROM forms JOIN (
  SELECT walk.word, root FROM walk JOIN forms ON forms.word = walk.root WHERE form IS NULL) USING (word)
"""

_TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

OP13 = rf"""
WITH words AS (
  SELECT doc_id, row, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_TERMS}')) AS term
  FROM (SELECT doc_id, text, row_number() OVER () AS row FROM documents)),
sizes AS (SELECT row, count(*) AS n FROM words GROUP BY row),
corpus AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes),
asked AS (
  SELECT item_id, term, count(*) AS repeats FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_TERMS}')) AS term
    FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY item_id, term),
tfs AS (SELECT row, doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY row, doc_id, term),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tfs, corpus GROUP BY term),
scores AS (
  SELECT item_id, row, tfs.doc_id,
    sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN tfs USING (term) JOIN sizes USING (row), corpus
  GROUP BY item_id, row, tfs.doc_id)
SELECT item_id, rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank
      FROM scores WHERE score > 0)
WHERE rank <= 20
"""


ORACLE_SQL = {"op2_quality_rules": OP2, "op5_url_filter": _op5(), "op7_jaccard_join": OP7,
              "op11_spelling_variants": OP11, "op12_near_duplicates": OP12, "op13_lexical_search": OP13}
