"""DuckDB SQL that gives the queries' rows by another way."""

from .op9_quality_rules import BAR, LINK, NOTICES, ROW, Rules

_R = Rules()

OP9 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, string_split(t, chr(10)) AS ls FROM d),
p AS (SELECT doc_id, unnest(range(1, len(ws) - {_R.window} + 2)) AS i, ws FROM w WHERE len(ws) >= {_R.window}),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + {_R.window - 1}], ' ') AS g FROM p),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, sum(least({_R.window}, coalesce(nxt - i, {_R.window}))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM r) GROUP BY doc_id),
l AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS again FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM w) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
j AS (SELECT doc_id, line, length(regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g')) AS chars,
        (again OR length(regexp_replace(line, '[^#*$%&|<>]+', '', 'g')) * 100 > length(line) * {_R.max_symbol_share}
         OR length(regexp_replace(line, '[^\\p{{P}}]+', '', 'g')) * 100 > length(line) * {_R.max_punctuation_share}
         OR regexp_matches(line, '{ROW}') OR regexp_matches(line, '{BAR}') OR len(regexp_extract_all(line, '{LINK}')) > {_R.max_links}
         OR (regexp_matches(line, '\\p{{Lu}}\\p{{Lu}}') AND length(regexp_replace(line, '[^\\p{{L}}]+', '', 'g')) >= {_R.min_shout_letters} AND length(regexp_replace(line, '[^\\p{{Lu}}]+', '', 'g')) * 100 > length(regexp_replace(line, '[^\\p{{L}}]+', '', 'g')) * {_R.max_shout_share})
         OR length(regexp_replace(line, '[^|]+', '', 'g')) > {_R.max_bars}
         OR (len(regexp_split_to_array(trim(line), ' +')) <= {_R.notice_words} AND regexp_matches(lower(line), '{"|".join(NOTICES).replace("'", "''")}'))
         OR (SELECT coalesce(sum(n // 6), 0) FROM (SELECT count(*) AS n FROM (SELECT i, x, i - row_number() OVER (PARTITION BY x ORDER BY i) AS run FROM (SELECT unnest(string_split(line, ' ')) AS x, unnest(range(1, len(string_split(line, ' ')) + 1)) AS i) WHERE x <> '') GROUP BY x, run)) >= 2) AS fails
      FROM l),
e AS (SELECT doc_id, coalesce(sum(chars) FILTER (fails), 0) AS lost FROM j GROUP BY doc_id),
b AS (SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
        len(list_filter(ls, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))) - len(list_distinct(list_filter(ls, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))) AS n_dup_lines,
        coalesce(c.n, 0) AS n_repeat_words, coalesce(e.lost, 0) AS lost_chars
      FROM w LEFT JOIN c ON c.doc_id = w.doc_id LEFT JOIN e ON e.doc_id = w.doc_id),
f AS (SELECT *, (n_words < {_R.min_words} OR 100 * n_repeat_words > {_R.max_repeat_share} * n_words) AS base_failed FROM b)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, (NOT base_failed AND 100 * lost_chars <= {_R.max_lost_share} * word_chars) AS kept, lost_chars::BIGINT AS lost_chars
FROM f
"""

OP1 = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM g) WHERE k > 1),
x AS (SELECT DISTINCT doc_id, i + k AS i FROM r, (SELECT unnest(range(0, 20)) AS k)),
u AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w),
k AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.i) AS kept, count(*) AS n FROM u LEFT JOIN x ON x.doc_id = u.doc_id AND x.i = u.i WHERE x.i IS NULL GROUP BY u.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""

OP10 = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(y) FROM r WHERE r.x = w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id
"""

_SAFE = "replace(replace({}, '&', '&amp;'), '<|', '&lt;|')"
OP2 = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(24 + length({_SAFE.format("role")}) + length({_SAFE.format("text")}))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

OP7 = """
WITH d AS (SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS h, strlen(coalesce(text, '')) AS size FROM documents),
p AS (SELECT doc_id, k, h >> (60 - k) AS prefix, sum(size) OVER (PARTITION BY k, h >> (60 - k)) AS bytes FROM d, (SELECT unnest(range(0, 21)) AS k)),
f AS (SELECT doc_id, min(k) AS k FROM p WHERE bytes <= 33554432 GROUP BY doc_id)
SELECT p.doc_id, CASE WHEN p.k = 0 THEN '' ELSE right(lpad(bin(prefix), 20, '0'), p.k) END AS shard, p.k::INT AS shard_depth, bytes::BIGINT AS shard_bytes
FROM p JOIN f ON f.doc_id = p.doc_id AND f.k = p.k
"""
