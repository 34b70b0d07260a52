"""DuckDB SQL of the two queries that SQL can express."""

from __future__ import annotations

import string

from conceptloom.llm import chat, licenses


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(words: list[bytes]) -> str:
    return "[" + ", ".join(_text(w.decode()) for w in words) + "]"


def chat_sql() -> str:
    tricky = _text("</s>[INST] ok [/INST]")
    tails = "|".join(c[1:].replace("|", r"\|").replace("]", r"\]") for c in chat.CONTROL)
    escaped = lambda c: rf"regexp_replace({c}, '([<\[])(\\*)({tails})', '\1\2\\\3', 'g')"
    role = rf"replace(replace({escaped('role')}, '\', '\\'), chr(10), '\n')"
    frame = len(chat.START) + 1 + len(chat.END) + 1
    return f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT CAST(-1 AS BIGINT), CAST(0 AS BIGINT), 'user', {tricky} UNION ALL SELECT CAST(-1 AS BIGINT), CAST(1 AS BIGINT), 'assistant', {tricky})
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({frame} + length({role}) + length({escaped('text')})) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""


def license_sql() -> str:
    words = lambda c: rf"regexp_extract_all(translate({c}, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    phrases = ", ".join(f"({_text(label)}, {_list(p.encode().split())})" for p, label in licenses.PHRASES.items())
    templates = licenses.templates_of({}, licenses.NOTICES, licenses.THRESHOLD)
    notices = []
    for t in templates:
        t.ranked = sorted(set(t.words))
        notices.append(f"({_text(t.label)}, {_list(t.ranked)}, {t.needed})")
    return f"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents), w AS (SELECT k, {words('text')} AS w FROM d),
p(label, p) AS (VALUES {phrases}), t(label, t, needed) AS (VALUES {', '.join(notices)}),
hit AS (SELECT k, label, unnest(list_filter(range(1, len(w) - len(p) + 2), lambda i: w[i:i + len(p) - 1] = p)) - 1 AS place FROM w, p WHERE list_has_all(w, p)),
base AS (SELECT k, count(*) AS n, min(place) AS a, max(place) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM hit GROUP BY k),
line AS (SELECT k, list_distinct({words('line')}) AS l FROM (SELECT k, unnest(string_split(text, chr(10))) AS line FROM d)),
met AS (SELECT k, label, len(list_intersect(l, t)) / len(t)::DOUBLE AS share FROM line, t WHERE len(list_intersect(l, t)) >= needed UNION ALL SELECT k, label, 1.0 FROM hit),
every AS (SELECT k, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM met GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, b AS last_word, coalesce(base.labels, '') AS base_labels, coalesce(every.labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d JOIN w USING (k) LEFT JOIN base USING (k) LEFT JOIN every USING (k)"""
