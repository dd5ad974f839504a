"""DuckDB SQL for the corpus queries that SQL can express."""

SQL: dict[str, str] = {}

SQL["op2_mix"] = r"""
WITH d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS DOUBLE) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS ord FROM s0),
s2 AS (SELECT *, CASE ord % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, source_size * 2 AS cap FROM s1),
s3 AS (SELECT *, cap / weight AS full_at, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM s2),
s4 AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY full_at, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) /
    (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY full_at, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM s3),
lv AS (SELECT arg_min(level, full_at) AS level FROM s4 WHERE full_at > level),
t AS (SELECT source, source_size, CASE WHEN lv.level IS NULL THEN cap ELSE least(cap, weight * lv.level) END AS target FROM s4, lv),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, row_number() OVER (PARTITION BY d.source ORDER BY d.size, md5(CAST(d.doc_id AS VARCHAR)), d.doc_id) AS rk,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS r,
    CAST(('0x' || substr(md5('mix' || coalesce('=' || d.source, '')), 1, 4)) AS BIGINT) / 65536.0::DOUBLE AS u
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, CAST(floor(rk * r + u) - floor((rk - 1) * r + u) AS BIGINT) AS copies FROM r)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target, copies * size AS taken, copies FROM c
"""

SQL["op6_chat"] = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(role) + len(regexp_extract_all(role, '[<\[]\\*(\|im_start\|>|\|im_sep\|>|\|im_end\|>|/?s>|/?INST\]|</?SYS>>)')) + length(text)
  + len(regexp_extract_all(text, '[<\[]\\*(\|im_start\|>|\|im_sep\|>|\|im_end\|>|/?s>|/?INST\]|</?SYS>>)')) + length('<|im_start|><|im_sep|><|im_end|>') AS chars FROM c),
t AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id),
l AS (SELECT conv_id, CAST(sum(length(text)) AS BIGINT) AS loss_chars, sha256(string_agg(text, '' ORDER BY turn, role, text)) AS loss_sha256 FROM c WHERE role = 'assistant' GROUP BY conv_id)
SELECT t.conv_id, n_turns, turns_sha256, coalesce(loss_chars, 0) AS loss_chars, coalesce(loss_sha256, sha256('')) AS loss_sha256, formatted_chars, CAST(0 AS BIGINT) AS n_rewrites
FROM t LEFT JOIN l ON t.conv_id = l.conv_id
"""

SQL["op7_decontaminate"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
i1 AS (SELECT item, w, least(10, len(w)) AS n FROM i WHERE len(w) > 0),
i2 AS (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS ip FROM i1),
iw AS (SELECT item, ip, n, array_to_string(list_slice(w, ip, ip + n - 1), ' ') AS g FROM i2),
d1 AS (SELECT doc_id, w, s.n FROM d, (SELECT DISTINCT n FROM i1) s WHERE len(w) >= s.n),
d2 AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d1),
dw AS (SELECT doc_id, p, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS g FROM d2),
h AS (SELECT doc_id, p, dw.n, item, ip FROM dw JOIN iw ON dw.g = iw.g AND dw.n = iw.n),
hw AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS x FROM (SELECT DISTINCT doc_id, p, n FROM h)) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id),
r AS (SELECT doc_id, item, p - ip AS diagonal, n, p - row_number() OVER (PARTITION BY doc_id, item, p - ip ORDER BY p) AS island FROM h),
rl AS (SELECT doc_id, max(m) AS longest_match FROM (SELECT doc_id, count(*) + max(n) - 1 AS m FROM r GROUP BY doc_id, item, diagonal, island) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated,
  CAST(coalesce(longest_match, 0) AS BIGINT) AS longest_match
FROM d LEFT JOIN hw ON d.doc_id = hw.doc_id LEFT JOIN hi ON d.doc_id = hi.doc_id LEFT JOIN rl ON d.doc_id = rl.doc_id
"""
