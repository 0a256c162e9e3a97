"""SQL for DuckDB that gives the same rows as a query, where SQL can express it."""

from .sharding import Feistel

WORD = r"[^\x20\x09-\x0D]+"

CHAT = """
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, t, CASE t WHEN 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok' FROM range(2) x(t)),
o AS (SELECT *, left(md5(role || chr(10) || text), 3) AS h, 24 + length(replace(replace(replace(role, '&', '&amp;'), '<|', '&lt;|'), chr(10), '&nl;')) + length(replace(replace(text, '&', '&amp;'), '<|', '&lt;|')) AS chars FROM r),
c AS (SELECT *, coalesce(sum(chars) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, h, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, h, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, h, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars, count(*) FILTER (role = 'assistant') AS n_examples,
  CAST(coalesce(sum(before) FILTER (role = 'assistant'), 0) AS BIGINT) AS context_chars, count(*) FILTER (role = 'assistant') AS n_contexts
FROM c GROUP BY conv_id
"""

QUALITY = f"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{WORD}') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls FROM d),
g AS (SELECT rn, i, array_to_string(ws[i:i + 7], ' ') AS gram FROM (SELECT rn, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
c AS (SELECT rn, i, count(*) OVER (PARTITION BY rn, gram) AS n FROM g),
p AS (SELECT DISTINCT rn, unnest(range(i, i + 8)) AS at FROM c WHERE n > 1),
q AS (SELECT rn, count(*) AS n FROM p GROUP BY rn),
m AS (SELECT w.rn, doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(q.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN q ON w.rn = q.rn),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (base_failed OR n_symbols > 0.5 * n_words OR n_dup_lines > 0.05 * n_words)::DOUBLE AS f FROM b GROUP BY source),
s AS (SELECT sum(n) AS n, sum(f) / sum(n) AS mean, sum(f * f / n) AS ff, count(*) AS k FROM h),
v AS (SELECT mean, greatest(0, (ff - n * mean * mean) / n - mean * (1 - mean) * k / n) AS spread FROM s),
a AS (SELECT mean, CASE WHEN spread > 0 THEN least(1e6, greatest(1.0, mean * (1 - mean) / spread - 1)) ELSE 1e6 END AS strength FROM v),
o AS (SELECT source, (f + mean * strength) / (n + strength) <= 0.5 AS host_kept FROM h CROSS JOIN a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_kept AS kept FROM b JOIN o ON b.source IS NOT DISTINCT FROM o.source
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), d AS (SELECT page_id, strlen(html) AS n, sha1(html) AS digest FROM p),
t AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS top FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM top THEN top END AS refers_to FROM t
"""

#: Weights and schedules as in mixing.WEIGHTS and mixing.SCHEDULES: late, level, early.
MIX = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS src, source IS NULL AS lone, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
    md5(concat(coalesce(CAST(doc_id AS VARCHAR), 'null'), ':17:', md5(coalesce(text, '')))) AS h FROM documents),
s AS (SELECT src, lone, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY ALL),
k AS (SELECT *, (row_number() OVER (ORDER BY lone, src) - 1) % 3 AS kind FROM s),
w AS (SELECT *, CASE kind WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, source_size * 2.0::DOUBLE AS cap FROM k),
l AS (SELECT *, ((SELECT sum(source_size) FROM s)::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
    row_number() OVER (f) AS nth FROM w WINDOW f AS (ORDER BY cap / w, lone, src)),
o AS (SELECT level FROM l WHERE cap > w * level ORDER BY nth LIMIT 1),
t AS (SELECT src, lone, source_size, kind, least(cap, coalesce(w * (SELECT level FROM o), cap)) AS target FROM l),
p AS (SELECT d.*, t.source_size, kind, target, CAST(round(target) AS BIGINT) AS budget, CAST(floor(CASE WHEN t.source_size = 0 THEN 0 ELSE round(target) / t.source_size END) AS BIGINT) AS passes,
    CAST(coalesce(sum(size) OVER (PARTITION BY src, lone ORDER BY h, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM d JOIN t USING (src, lone)),
r AS (SELECT *, greatest(0, least(size, budget - passes * source_size - start)) AS rest FROM p),
c AS (SELECT *, CAST((CASE WHEN size > 0 THEN passes ELSE 0 END) + CAST(rest > 0 AS INT) AS INT) AS copies FROM r),
x AS (SELECT *, list_transform(range(copies), lambda i: least(greatest((source_size * i + start + size / 2.0::DOUBLE) / budget, 0), 1)) AS u FROM c)
SELECT doc_id, size, source_size, target, CAST(size * passes + rest AS BIGINT) AS taken, copies,
  array_to_string(list_transform(u, lambda v: printf('%.9f', CASE kind WHEN 0 THEN 2 * v / (0.5 + sqrt(0.25 + 2 * v)) WHEN 1 THEN v
    ELSE CASE WHEN v < 0.625 THEN 2 * v / (1.5 + sqrt(2.25 - 2 * v)) ELSE 0.5 + 2 * (v - 0.625) / (1.0 + sqrt(1.0 - 2 * (v - 0.625))) END END)), ',') AS positions
FROM x
"""

#: Rounds of sharding.Feistel under the key of sharding.shard, and the check sum of bytes by its table of 256 remainders.
SHARD = f"""
WITH RECURSIVE z AS (SELECT 18446744073709551616::UHUGEINT AS m, {[int(k) for k in Feistel(2, 2024).keys]}::UHUGEINT[] AS keys, count(*)::UHUGEINT AS n,
    (CAST(floor(log2(greatest(count(*) - 1, 1))) AS INT) + 2) // 2 AS bits0, bits0::UHUGEINT AS half FROM documents),
bits AS (SELECT i, 0 AS k, i::UBIGINT AS c FROM range(256) x(i) UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
d AS (SELECT doc_id, encode(coalesce(text, '')) AS raw, md5(concat(coalesce(CAST(doc_id AS VARCHAR), 'null'), ':', md5(coalesce(text, '')))) AS h FROM documents),
b AS (SELECT *, list_transform(regexp_extract_all(hex(raw), '..'), lambda p: CAST('0x' || p AS UBIGINT)) AS bytes FROM d),
r AS (SELECT doc_id, octet_length(raw) + 1 AS size, row_number() OVER (ORDER BY h) - 1 AS row_number,
    xor(list_reduce(bytes, lambda c, x: xor(c >> 8, t[CAST(xor(c, x) & 255 AS BIGINT) + 1]), 4294967295::UBIGINT), 4294967295::UBIGINT) AS text_crc32 FROM b CROSS JOIN crc),
g AS (SELECT row_number, 0 AS step, row_number::UHUGEINT >> half AS l, row_number::UHUGEINT & ((1::UHUGEINT << half) - 1) AS r FROM r CROSS JOIN z
  UNION ALL SELECT row_number, step + 1, r, xor(l, f & ((1::UHUGEINT << half) - 1)) FROM (
    SELECT row_number, step, l, r, half, (r + keys[step % 6 + 1]) % m AS x0, (xor(x0, x0 >> 30::UHUGEINT) * 13787848793156543929::UHUGEINT) % m AS x1,
      (xor(x1, x1 >> 27::UHUGEINT) * 10723151780598845931::UHUGEINT) % m AS x2, xor(x2, x2 >> 31::UHUGEINT) AS f FROM g CROSS JOIN z WHERE step = 0 OR step % 6 <> 0 OR ((l << half) | r) >= n)),
p AS (SELECT row_number, CAST((l << half) | r AS BIGINT) AS place FROM g CROSS JOIN z WHERE step > 0 AND step % 6 = 0 AND ((l << half) | r) < n)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(place % 8 AS INT) AS shard, place // 8 AS slot, CAST(NULL AS INT) AS grown_shard, row_number
FROM r JOIN p USING (row_number)
"""

#: Links of documents by shared shingles, then all that can be reached by links.
JOIN = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rn, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents),
g AS (SELECT rn, doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS gs FROM d),
e AS (SELECT rn, unnest(gs) AS gram FROM g), n AS (SELECT rn, doc_id, CAST(len(gs) AS BIGINT) AS n FROM g),
o AS (SELECT a.rn AS x, b.rn AS y, count(*) AS shared FROM e a JOIN e b ON a.gram = b.gram AND a.rn < b.rn GROUP BY ALL),
l AS (SELECT x, y FROM o JOIN n a ON x = a.rn JOIN n b ON y = b.rn WHERE 100 * shared >= 90 * (a.n + b.n - shared)),
t AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT rn AS x, rn AS y FROM n UNION SELECT r.x, t.y FROM r JOIN t ON r.y = t.x)
SELECT a.doc_id, any_value(a.n) AS n_shingles, min(b.doc_id) AS component_id FROM r JOIN n a ON r.x = a.rn JOIN n b ON r.y = b.rn GROUP BY r.x, a.doc_id
"""

#: Stretches of i at which words i and i + q are equal are runs of period q; of one stretch of words the least q is its period.
RUNS = f"""
WITH RECURSIVE bits AS (SELECT i, 0 AS k, i::UBIGINT AS c FROM range(256) x(i) UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
d AS (SELECT row_number() OVER () AS rn, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws, CAST(len(ws) AS BIGINT) AS n,
    CAST(xor(list_reduce(list_transform(regexp_extract_all(hex(encode(CAST(doc_id AS VARCHAR))), '..'), lambda b: CAST('0x' || b AS UBIGINT)), lambda c, x: xor(c >> 8, t[CAST(xor(c, x) & 255 AS BIGINT) + 1]), 4294967295::UBIGINT), 4294967295::UBIGINT) AS BIGINT) AS h FROM documents CROSS JOIN crc),
p AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a, 1 + (n - a) // (3 + (h // 10) % 8) AS q FROM d),
w AS (SELECT rn, doc_id, n, CASE WHEN a IS NULL THEN ws ELSE list_transform(range(n), lambda i: ws[1 + CASE WHEN i >= a THEN a + (i - a) % q ELSE i END]) END AS ws FROM p),
e AS (SELECT rn, unnest(ws) AS word, unnest(range(n)) AS i FROM w),
m AS (SELECT x.rn, y.i - x.i AS q, x.i FROM e x JOIN e y ON x.rn = y.rn AND x.word = y.word AND x.i < y.i),
s AS (SELECT rn, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY rn, q ORDER BY i) AS island FROM m) GROUP BY rn, q, island HAVING count(*) >= q AND count(*) + q >= 12),
r AS (SELECT rn, start, length, min(q) AS period FROM s GROUP BY ALL),
c AS (SELECT rn, count(*) AS n_runs, arg_min(struct_pack(s := start, l := length, p := period), [-length, start, period]) AS best, sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS runs_sha256 FROM r GROUP BY 1),
k AS (SELECT DISTINCT rn, unnest(range(start + period, start + length)) AS i FROM r),
t AS (SELECT e.rn, sha256(string_agg(word, ' ' ORDER BY e.i)) AS h FROM e ANTI JOIN k ON e.rn = k.rn AND e.i = k.i GROUP BY 1)
SELECT doc_id, n AS n_words, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.p AS period, 1000 * best.l // best.p AS exponent_milli,
  coalesce(runs_sha256, sha256('')) AS runs_sha256, coalesce(t.h, sha256('')) AS collapsed_sha256 FROM w LEFT JOIN c USING (rn) LEFT JOIN t USING (rn)
"""

SQL = {"op1_mix_sources": MIX, "op5_shard": SHARD, "op6_chat_format": CHAT, "op8_quality_rules": QUALITY, "op9_warc": WARC, "op12_ngram_join": JOIN, "op13_periodic_runs": RUNS}
