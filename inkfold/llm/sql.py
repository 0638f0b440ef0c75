"""Checking SQL of the operators that SQL can express."""

from inkfold.llm.quality_rules import RULES, STOP_WORDS

_CODES = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def _broken() -> str:
    parts = []
    for r in RULES:
        value = f"({r.measure}::DOUBLE / greatest({r.per}, 1))" if r.per else r.measure
        bad = [f"{value} < {r.low}"] * (r.low is not None) + [f"{value} > {r.high}"] * (r.high is not None)
        parts.append(f"CASE WHEN ({' OR '.join(bad)}) AND n_words >= {r.least} THEN '{r.name}' END")
    return f"array_to_string(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL), ',')"


QUALITY_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT k, doc_id, t,
         list_filter(regexp_split_to_array(t, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS words,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')) AS lines
  FROM d
), grams AS (
  SELECT k, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM w, unnest(range(1, greatest(len(words) - 1, 1))) AS u(i)
), twice AS (
  SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n FROM grams) WHERE n > 1
), covered AS (
  SELECT k, count(DISTINCT i + j) AS n FROM twice, range(3) AS r(j) GROUP BY k
), m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words,
         length(regexp_replace(t, '[ \\t\\n\\x0B\\f\\r]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines,
         coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(words, lambda x: list_contains({_CODES}, x))) AS n_stop_words
  FROM w LEFT JOIN covered USING (k)
), b AS (
  SELECT *, n_words < 50 OR n_repeat_words * 100 > n_words * 50 AS base_failed, {_broken()} AS broken FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND broken = '' AS kept, broken
FROM b
"""

CHAT_SQL = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -1, i, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(i, r)
), e AS (
  SELECT *, regexp_replace(text, '<(\\\\*)\\|', '<\\1\\\\|', 'g') AS safe,
         regexp_replace(replace(replace(role, '~', '~0'), chr(10), '~1'), '<(\\\\*)\\|', '<\\1\\\\|', 'g') AS safe_role
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), ''))
         AS loss_sha256,
       sum(length('<|im_start|>') + length(safe_role) + 1 + length(safe) + length('<|im_end|>') + 1)::BIGINT
         AS formatted_chars
FROM e GROUP BY conv_id
"""

SEARCH_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM documents
), q AS (
  SELECT j, item_id, term, count(*) AS times
  FROM (SELECT row_number() OVER () AS j, item_id, unnest(regexp_extract_all(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY ALL
), total AS (
  SELECT count(*)::BIGINT AS docs, sum(len(ws))::BIGINT AS terms FROM d WHERE len(ws) > 0
), tf AS (
  SELECT k, term, count(*) AS n FROM (SELECT k, unnest(ws) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL
), w AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight
  FROM tf, total GROUP BY term, docs
), m AS (
  SELECT k, doc_id, 75 + (25 * len(ws) * docs) // terms AS m FROM d, total WHERE len(ws) > 0
), scored AS (
  SELECT j, item_id, k, doc_id,
         sum(q.times * w.weight * ((1000000000 * tf.n) // (1000 * tf.n + 12 * m.m)))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (k) GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY j ORDER BY score DESC, doc_id NULLS LAST) AS r FROM scored WHERE score > 0
)
SELECT item_id, r::INTEGER AS rank, doc_id, score FROM ranked WHERE r <= 20
"""

AUDIT_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS words,
         min(doc_id) OVER (PARTITION BY t) AS least FROM t
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, {
    'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words),
    'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t), 'D': regexp_matches(t, '[#$%&*|]'),
    'E': coalesce(w.doc_id > least, false)} AS x
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c
), orders AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5
), cells AS (
  SELECT part, [x.A, x.B, x.C, x.D, x.E] AS x, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL
), steps AS (
  SELECT o, s, [ascii(o[i]) - 64 for i in range(1, 6)] AS p, ascii(o[s]) - 64 AS here FROM orders, range(1, 6) r(s)
), per AS (
  SELECT part, o, s, here, x, n, good, toxic, x[here] AS fails,
         len(list_filter(p[1:s - 1], lambda i: x[i])) > 0 AS before, len(list_filter(x, lambda b: b)) AS failed
  FROM cells, steps
), audit AS (
  SELECT part, o AS filter_order, s::INTEGER AS step, here,
         coalesce(sum(n) FILTER (NOT fails AND NOT before), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (fails AND NOT before), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (fails AND before), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (fails AND failed = 1), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (fails AND NOT before), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (fails AND NOT before), 0)::BIGINT AS toxic_lost
  FROM per GROUP BY part, o, s, here
)
SELECT * EXCLUDE (here), (sum(removed) OVER (PARTITION BY part, here))::BIGINT AS shapley FROM audit
"""
