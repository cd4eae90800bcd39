"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

#: Texts with A to Z lowered.
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

EXACT_DEDUP = f"""
WITH d AS (SELECT doc_id, sha256({_LOWERED}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""

CHAT = r"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
    UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), f AS (
    SELECT *, regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g') AS r,
           regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS b FROM t
), x AS (
    SELECT *, sha256(string_agg('<|im_start|>' || r || chr(10) || b || '<|im_end|>' || chr(10), '')
                     OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)) AS example FROM f
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|im_start|>') + length(r) + 1 + length(b) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars,
       count(*) FILTER (role = 'assistant') AS n_examples,
       sha256(coalesce(string_agg(example, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS examples_sha256
FROM x GROUP BY conv_id
"""

#: Up to the mix of each document; _d may be another table of documents.
MIX_STEPS = rf"""
_sized AS (
    SELECT doc_id, source, len({_WORDS})::BIGINT AS size FROM _d
), _source AS (
    SELECT source, sum(size)::BIGINT AS source_size,
           [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
    FROM _sized GROUP BY source
), _ranked AS (
    SELECT *, row_number() OVER o AS k, 3 * source_size AS cap,
           sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS free,
           sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
    FROM _source WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST)
), _level AS (
    SELECT arg_min(free::DOUBLE / rest::DOUBLE, k) FILTER (cap >= free::DOUBLE / rest::DOUBLE * weight) AS level FROM _ranked
), _target AS (
    SELECT source, source_size, cap, least(cap::DOUBLE, level * weight) AS target FROM _ranked, _level
), _want AS (
    SELECT *, least(cap, round(target)::BIGINT) AS want FROM _target
), _line AS (
    SELECT s.doc_id, s.source, s.size, w.source_size, w.target, w.want,
           sum(s.size) OVER (PARTITION BY s.source ORDER BY md5(coalesce(s.doc_id::VARCHAR, '')), s.size ROWS UNBOUNDED PRECEDING)::BIGINT AS line_end
    FROM _sized s JOIN _want w ON s.source IS NOT DISTINCT FROM w.source
), _mixed AS (
    SELECT *, CASE WHEN size = 0 THEN 0 ELSE want // source_size END AS full_copies,
           CASE WHEN size = 0 THEN 0 ELSE greatest(0, least(line_end, want % source_size) - (line_end - size)) END AS cut_words
    FROM _line
)
"""

MIXING = f"""
WITH _d AS (SELECT * FROM documents), {MIX_STEPS}
SELECT doc_id, size, source_size, target, (full_copies * size + cut_words)::BIGINT AS taken, source FROM _mixed
"""

_WORD = r"'[^\x20\x09-\x0D]+'"
_GRAMS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
_CHARS = ", ".join(f"coalesce(max(chars) FILTER (n = {n}), 0)::BIGINT AS gram{n}_chars" for n in _GRAMS)
_OVER = " OR ".join(f"gram{n}_chars / greatest(word_chars, 1) > {most}" for n, most in _GRAMS.items())
_SHOWN = ", ".join(f"coalesce(gram{n}_chars, 0)::BIGINT AS gram{n}_chars" for n in _GRAMS)
_NAMES = ", ".join(f"gram{n}_chars" for n in _GRAMS)

REPETITION = f"""
WITH w AS (
    SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS words FROM documents
), g AS (
    SELECT doc_id, n, i, array_to_string(words[i + 1 : i + n], ' ') AS gram
    FROM (SELECT doc_id, words, n, unnest(range(0, len(words) - n + 1)) AS i FROM w, (VALUES {", ".join(f"({n})" for n in _GRAMS)}) v(n))
), r AS (
    SELECT doc_id, n, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, n, gram) > 1
), c AS (
    SELECT DISTINCT doc_id, n, unnest(range(i, i + n)) AS j FROM r
), l AS (
    SELECT c.doc_id, n, count(*) AS covered, sum(length(words[j + 1])) AS chars FROM c JOIN w USING (doc_id) GROUP BY ALL
), p AS (
    SELECT doc_id, coalesce(max(covered) FILTER (n = 5), 0)::BIGINT AS n_repeat_words, {_CHARS} FROM l GROUP BY doc_id
), s AS (
    SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line) AS k,
           list_sum(list_transform(regexp_extract_all(line, {_WORD}), lambda x: length(x))) AS chars
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, {_WORD})
), q AS (
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (k > 1) AS n_dup_lines, coalesce(sum(chars) FILTER (k > 1), 0)::BIGINT AS dup_line_chars
    FROM s GROUP BY doc_id
), b AS (
    SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
           length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_lines, 0)::BIGINT AS n_lines,
           coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(dup_line_chars, 0)::BIGINT AS dup_line_chars,
           coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, {_SHOWN}
    FROM w LEFT JOIN p ON p.doc_id = w.doc_id LEFT JOIN q ON q.doc_id = w.doc_id
), f AS (
    SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (n_dup_lines > 0.3 * n_lines OR dup_line_chars > 0.2 * word_chars OR {_OVER}) AS kept, n_lines, dup_line_chars, {_NAMES} FROM f
"""

ORACLES: dict[str, str] = {
    "op4_exact_dedup": EXACT_DEDUP,
    "op7_chat_format": CHAT,
    "op8_mixing": MIXING,
    "op9_repetition": REPETITION,
}
