"""The segmentation contract in SQL, for the statements that queries are checked against."""

from __future__ import annotations

from ..operators.segment import SENTENCE, TOKEN
from ..sources.lexicons import as_sql

BLOCKS = r"b AS (SELECT doc_id, unnest(range(len(a)))::INT AS block_ix, unnest(a) AS text FROM (SELECT doc_id, string_split(replace(coalesce(text, ''), chr(10) || chr(10), chr(10)), chr(10)) AS a FROM documents))"
SENTENCES = BLOCKS + rf", s AS (SELECT doc_id, block_ix, unnest(range(len(a)))::INT AS sent_ix, unnest(a) AS text FROM (SELECT doc_id, block_ix, regexp_extract_all(regexp_replace(text, '([a-z]+)\.([A-Z][a-z]+)', '\1. \2', 'g'), '{SENTENCE}') AS a FROM b))"
TOKENS = SENTENCES + rf", t AS (SELECT doc_id, block_ix, sent_ix, unnest(range(len(a)))::INT AS tok_ix, unnest(a) AS text, lower(unnest(a)) AS lemma FROM (SELECT doc_id, block_ix, sent_ix, regexp_extract_all(text, '{TOKEN}') AS a FROM s))"
ANNOTATED = (
    TOKENS
    + f", {as_sql('lex_pos')}, {as_sql('lex_lemma')}, {as_sql('lex_stop')}"
    + r", a AS (SELECT t.doc_id, block_ix, sent_ix, tok_ix, t.text, coalesce(l.lemma, t.lemma) AS lemma, coalesce(p.pos, CASE WHEN regexp_full_match(t.text, '\p{N}+') THEN 'NUM' WHEN regexp_full_match(t.text, '[^\p{L}\p{N}]') THEN 'PUNCT' ELSE 'X' END) AS pos, w.word IS NOT NULL AS is_stop FROM t LEFT JOIN lex_pos p ON p.word = lower(t.text) LEFT JOIN lex_lemma l ON l.word = lower(t.text) LEFT JOIN lex_stop w ON w.word = lower(t.text))"
)


def sd(x: str) -> str:
    return f"CASE WHEN count({x}) = 1 THEN 0 ELSE stddev_samp({x}) END"


def summary(keys: str, table: str, measures: list[str]) -> str:
    cols = ", ".join(f"round(avg({m}), 6) AS m_{m}, round({sd(m)}, 6) AS sd_{m}, round(max({m})::DOUBLE, 6) AS max_{m}" for m in measures)
    return f"SELECT {keys}, {cols} FROM {table} GROUP BY {keys}"
