"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

OP1 = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item, len(w[i:i+9]) AS n, array_to_string(w[i:i+9], ' ') AS s
  FROM item_words, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM windows
), placed AS (
  SELECT doc_id, n, i, array_to_string(w[i:i+n-1], ' ') AS s FROM words, sizes, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n
), found AS (SELECT p.doc_id, p.n, p.i, q.item FROM placed p JOIN windows q USING (n, s)
), hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM found, unnest(range(i, i + n)) AS t(j) GROUP BY doc_id
), items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM found GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP2 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(24 + length(role) + length(regexp_replace(text, '<(\\*)\|im_(start|end)\|>', '<\\\1|im_\2|>', 'g'))) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""


BLANKS, WORDS, PIECES = r"[ \t\n\r]+", "[^ ]+", "(?:[^ ]*[^ eoEO.!?:;] ){0,15}[^ ]+"


def _fingerprint(t: str) -> str:
    """From the columns t and t_plain."""
    least = lambda hashes: f"array_to_string(list_sort(list_distinct({hashes}))[1:64], ',')"
    n = f"len(regexp_extract_all({t}_plain, '{PIECES}'))"
    pieces, words = (f"list_transform(regexp_extract_all({t}_plain, '{p}'), lambda p: left(md5(p), 8))" for p in (PIECES, WORDS))
    root = f"sha256(array_to_string(list_transform(string_split({t}, chr(10) || chr(10)), lambda s: sha256(array_to_string(list_transform(string_split(s, chr(10)), lambda q: sha256(q)), ''))), ''))"
    branches = f"list_transform(list_filter(string_split({t}, chr(10)), lambda p: p <> ''), lambda p: left(sha256(p), 8) || '.' || CAST(length(p) AS VARCHAR))"
    few = f"CASE WHEN {n} < 8 THEN {least(words)} ELSE '' END"
    return f"{root} || ':' || CAST({n} AS VARCHAR) || ':' || {least(branches)} || ':' || {least(pieces)} || ':' || {few}"


def _likeness(a: str, b: str) -> str:
    def shared(k: int, weight: str) -> str:
        x, y = (f"list_filter(string_split(split_part({c}, ':', {k}), ','), lambda h: h <> '')" for c in (a, b))
        least = f"list_sort(list_distinct(list_concat({x}, {y})))[1:64]"
        total = lambda hs: f"list_sum(list_transform({hs}, lambda h: {weight}))"
        both = f"list_intersect(list_intersect({x}, {y}), {least})"
        return f"coalesce(coalesce({total(both)}, 0) / nullif({total(least)}, 0), 0.0)"

    few = f"least(CAST(split_part({a}, ':', 2) AS INT), CAST(split_part({b}, ':', 2) AS INT)) < 8"
    pieces = f"CASE WHEN {few} THEN ({shared(4, '1')} + {shared(5, '1')}) / 2 ELSE {shared(4, '1')} END"
    branches = shared(3, "CAST(split_part(h, '.', 2) AS BIGINT)")
    return f"CAST(CASE WHEN {a} = {b} THEN 1.0 ELSE greatest({branches}, {pieces}) END AS DOUBLE)"


OP3_OPEN = "flatten(list_transform(list_filter({x}_sections, lambda s: NOT list_contains({y}_sections, s)), lambda s: string_split(s, chr(10))))"


OP3 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (
  SELECT doc_id, text, length(text) AS n_chars, coalesce(lead(text) OVER o, first_value(text) OVER o) AS next_text
  FROM d WINDOW o AS (ORDER BY doc_id, text)
), e AS (
  SELECT *, left(text, n_chars - n_chars // 4) || left(next_text, n_chars // 4) AS edited FROM n
), w AS MATERIALIZED (
  SELECT *, string_split(text, chr(10) || chr(10)) AS text_sections, string_split(edited, chr(10) || chr(10)) AS edited_sections,
    regexp_replace(text, '{BLANKS}', ' ', 'g') AS text_plain, regexp_replace(edited, '{BLANKS}', ' ', 'g') AS edited_plain, regexp_replace(next_text, '{BLANKS}', ' ', 'g') AS next_text_plain FROM e
), p AS MATERIALIZED (
  SELECT *, {OP3_OPEN.format(x="text", y="edited")} AS gone, {OP3_OPEN.format(x="edited", y="text")} AS new FROM w
), f AS MATERIALIZED (
  SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, CAST(len(list_distinct(list_filter(new, lambda q: NOT list_contains(gone, q)))) AS BIGINT) AS n_changed,
    {_fingerprint("text")} AS fingerprint, {_fingerprint("edited")} AS edited_fingerprint, {_fingerprint("next_text")} AS next_fingerprint
  FROM p
)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
  {_likeness("fingerprint", "edited_fingerprint")} AS near_edited, {_likeness("fingerprint", "next_fingerprint")} AS near_next, n_changed
FROM f
"""


OP6 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS g FROM words, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (SELECT doc_id AS d, doc_id AS r FROM documents UNION SELECT d, b FROM reached JOIN ways ON r = a)
SELECT doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(r) AS component_id, doc_id = min(r) AS kept
FROM reached JOIN documents ON d = doc_id LEFT JOIN sizes USING (doc_id) GROUP BY doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": OP1, "op2_chat_format": OP2, "op3_fingerprints": OP3, "op6_minhash": OP6}
