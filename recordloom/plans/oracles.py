"""SQL for DuckDB that gives the same rows as each query, on the same tables."""

from .. import vocabulary as V
from ..operators import anomaly
from .queries import AFTER, BETWEEN, label_cases, language_cases

PAIRS = """
WITH v AS (SELECT *, min(id) OVER (PARTITION BY p_brand, p_type, p_size, p_name) AS g FROM
  (SELECT p_partkey AS id, lower(trim(p_brand)) AS p_brand, lower(trim(p_type)) AS p_type, CAST(p_size AS VARCHAR) AS p_size, lower(trim(p_name)) AS p_name FROM part)),
r AS (SELECT * FROM v WHERE id = g),
t AS (SELECT a.id AS document_id, b.id AS duplicate_id, 'group' AS kind FROM r a JOIN r b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_size = b.p_size AND a.id <> b.id
  UNION SELECT a.id, b.id, 'group' FROM r a JOIN r b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_name = b.p_name AND a.id <> b.id
  UNION SELECT a.id, b.id, 'group' FROM r a JOIN r b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_name = b.p_name AND a.id <> b.id
  UNION SELECT a.id, b.id, 'group' FROM r a JOIN r b ON a.p_type = b.p_type AND a.p_size = b.p_size AND a.p_name = b.p_name AND a.id <> b.id
  UNION ALL SELECT id, g, 'member' FROM v WHERE id <> g),
m AS (SELECT t.*, CAST(a.p_brand = b.p_brand AS INT) AS k1, CAST(a.p_type = b.p_type AS INT) AS k2, CAST(a.p_size = b.p_size AS INT) AS k3, CAST(a.p_name = b.p_name AS INT) AS k4 FROM t JOIN v a ON t.document_id = a.id JOIN v b ON t.duplicate_id = b.id)
"""

EXTRACTED = """
WITH x AS (SELECT c_custkey AS document_id, CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_custkey AS VARCHAR) END AS survey_number, CASE WHEN c_custkey % 3 = 0 THEN 'K' || (c_custkey % 100) END AS khata_number,
    CASE WHEN c_custkey % 11 = 0 THEN 'nobody' ELSE upper(replace(c_name, '#', ' - ')) END AS owner_name, CASE WHEN c_custkey % 13 <> 0 THEN c_mktsegment END AS village FROM customer),
r AS (SELECT c_custkey AS ref_id, CASE WHEN c_custkey % 4 = 1 THEN 'X' ELSE '' END || c_custkey AS survey_number, CASE WHEN c_custkey % 4 = 1 THEN 'X' ELSE 'K' END || (c_custkey % 100) AS khata_number, c_name AS owner_name,
    CASE WHEN c_custkey % 6 <> 0 THEN c_mktsegment END AS village FROM customer),
l AS (SELECT x.document_id, min(r.ref_id) AS ref_id FROM x JOIN r ON (x.survey_number IS NULL OR x.survey_number = r.survey_number) AND (x.khata_number IS NULL OR x.khata_number = r.khata_number)
  AND (x.survey_number IS NOT NULL OR x.khata_number IS NOT NULL) GROUP BY 1)
"""
COMPARED = (
    EXTRACTED
    + """,
f AS (SELECT document_id, 'OWNER_NAME' AS canonical_key, owner_name AS fv FROM x UNION ALL SELECT document_id, 'VILLAGE', village FROM x UNION ALL SELECT document_id, 'OTHER', 'x' FROM x),
j AS (SELECT f.*, l.ref_id, CASE canonical_key WHEN 'OWNER_NAME' THEN r.owner_name WHEN 'VILLAGE' THEN r.village END AS rv FROM f LEFT JOIN l USING (document_id) LEFT JOIN r ON l.ref_id = r.ref_id),
s AS (SELECT document_id, canonical_key, ref_id, CASE WHEN canonical_key = 'OTHER' THEN 'NOT_VERIFIABLE' WHEN rv IS NULL THEN 'NOT_FOUND'
  WHEN trim(regexp_replace(lower(coalesce(fv, 'None')), '[\\s\\-/.,;:]+', ' ', 'g')) = trim(regexp_replace(lower(rv), '[\\s\\-/.,;:]+', ' ', 'g')) THEN 'MATCH' ELSE 'MISMATCH' END AS status FROM j)
"""
)

RECORDS = """
WITH k AS (SELECT c_custkey AS k, c_name FROM customer),
r AS (SELECT k AS record_id, ['MH', 'uttar pradesh', 'MP', 'TN', 'Telangana', 'KA', 'WB', 'ZZ'][CAST(k % 8 + 1 AS INT)] AS state,
  CASE k % 7 WHEN 0 THEN 'unknown' WHEN 1 THEN '0' WHEN 2 THEN '70000 ha' ELSE (k % 50 + 1) || ' ha' END AS area,
  CASE WHEN k % 9 <> 0 THEN CASE WHEN k % 10 = 3 THEN '12#4' ELSE CAST(k AS VARCHAR) END END AS survey_number, CASE WHEN k % 4 <> 0 THEN '77' END AS khata_number,
  CASE k % 6 WHEN 0 THEN '1234567890123456' WHEN 1 THEN '12' END AS unique_code, CASE k % 5 WHEN 0 THEN '1430 - 1431' WHEN 1 THEN '2020' END AS fasli_year,
  CASE k % 3 WHEN 0 THEN 'wet land' WHEN 1 THEN 'desert' END AS land, c_name AS owner_name, CASE WHEN k % 12 = 0 THEN ' ' || upper(c_name) ELSE '' END AS co_owner_name,
  CASE WHEN k % 2 = 0 THEN '05-03-2030' ELSE '5 Mar 2020' END AS registration_date, CASE WHEN k % 16 = 5 THEN '200000001' END AS market_value, k % 13 AS mutations FROM k),
n AS (SELECT *, TRY_CAST(nullif(regexp_extract(area, '([0-9]+(?:\\.[0-9]+)?)', 1), '') AS DOUBLE) AS a FROM r)
"""
FAILURES = """list_filter([
  CASE WHEN a IS NULL THEN 'RULE_AREA_SANITY=HIGH' WHEN a <= 0 THEN 'RULE_AREA_SANITY=CRITICAL' WHEN a > 50000 THEN 'RULE_AREA_SANITY=MEDIUM' END,
  CASE WHEN record_id % 11 = 4 AND abs(a - 3.5) > a * 0.05 + 0.01 THEN 'RULE_AREA_SUM=HIGH' END,
  CASE WHEN registration_date = '05-03-2030' THEN 'RULE_DATE_SANITY=HIGH' END,
  CASE WHEN lower(trim(owner_name)) = lower(trim(co_owner_name)) THEN 'RULE_OWNER_DUPLICATE=HIGH' END,
  CASE WHEN survey_number = '12#4' THEN 'RULE_SURVEY_FORMAT=MEDIUM' END,
  CASE WHEN state = 'MH' AND (khata_number IS NULL OR survey_number IS NULL) THEN 'RULE_MH_712=HIGH' END,
  CASE WHEN state = 'uttar pradesh' THEN CASE WHEN survey_number IS NULL THEN 'RULE_UP_KHATAUNI=HIGH' WHEN unique_code = '12' THEN 'RULE_UP_KHATAUNI=MEDIUM' WHEN fasli_year = '2020' THEN 'RULE_UP_KHATAUNI=LOW' END END,
  CASE WHEN state = 'MP' AND survey_number IS NULL THEN 'RULE_MP_KHASRA=HIGH' END,
  CASE WHEN state = 'TN' THEN CASE WHEN survey_number IS NULL THEN 'RULE_TN_PATTA=HIGH' WHEN land = 'desert' THEN 'RULE_TN_PATTA=LOW' END END,
  CASE WHEN state = 'Telangana' THEN CASE WHEN survey_number IS NULL THEN 'RULE_AP_TS_ADANGAL=HIGH' WHEN khata_number IS NULL THEN 'RULE_AP_TS_ADANGAL=MEDIUM' END END,
  CASE WHEN state = 'KA' AND survey_number IS NULL THEN 'RULE_KA_BHOOMI=HIGH' END,
  CASE WHEN state = 'WB' AND survey_number IS NULL AND khata_number IS NULL THEN 'RULE_WB_BANGLARBHUMI=HIGH' END], lambda x: x IS NOT NULL)"""

CORRECTIONS = """
WITH s AS (SELECT event_id AS seq, 'f' || (user_id % 50) AS field_name, CASE event_type WHEN 'click' THEN 'value_correction' WHEN 'view' THEN 'auto_verified' WHEN 'purchase' THEN 'field_added' ELSE 'field_deleted' END AS correction_type,
  CAST(event_id % 7 AS VARCHAR) AS original_value, CAST(event_id % 3 AS VARCHAR) AS corrected_value, CASE WHEN event_id % 4 = 0 THEN 'AREA' END AS canonical_key,
  CASE WHEN event_id % 5 <> 0 THEN 't' || (user_id % 3) END AS document_type, event_id % 10 / 10.0 AS ocr_confidence, event_id % 2 = 0 AS used FROM events),
rates AS (SELECT field_name, count(*) AS total, count(*) FILTER (correction_type = 'value_correction') AS corrected FROM s GROUP BY 1),
pen AS (SELECT *, 1 - corrected / total AS accuracy, CASE WHEN corrected > 0 AND total >= 2 THEN -0.30 * corrected / total END AS penalty FROM rates),
cm AS (SELECT field_name, original_value, arg_max(corrected_value, seq) AS corrected_value FROM s WHERE correction_type = 'value_correction' GROUP BY 1, 2),
lm AS (SELECT field_name, arg_max(canonical_key, seq) AS learned_key FROM s WHERE canonical_key IS NOT NULL GROUP BY 1),
ty AS (SELECT DISTINCT document_type, field_name FROM s WHERE document_type IS NOT NULL)
"""



def _learned(k: int) -> str:
    """What round k learns from the samples that are not set aside."""
    t = f"(SELECT * FROM s WHERE seq % 3 = {k} AND seq % 5 <> 0)"
    counted = f"(SELECT field_name, total, c, round_even(1 - c / total, 4) AS accuracy, round_even(CASE WHEN c > 0 AND total >= 2 THEN -0.30::DOUBLE * (c / total) ELSE 0 END, 4)::DOUBLE AS penalty FROM (SELECT field_name, count(*) AS total, count(*) FILTER (correction_type = 'value_correction' AND original_value <> corrected_value) AS c FROM {t} GROUP BY 1))"
    return f"""SELECT 'label_mappings' AS part, lower(field_name) AS key, arg_max(canonical_key, seq) AS value, NULL::VARCHAR[] AS fields FROM {t} WHERE canonical_key IS NOT NULL GROUP BY 2
      UNION ALL SELECT 'ocr_corrections', field_name || '::' || original_value, arg_max(corrected_value, seq), NULL FROM {t} WHERE correction_type = 'value_correction' AND original_value <> corrected_value GROUP BY 2
      UNION ALL SELECT 'doctype_fields', document_type, NULL, list_sort(list(DISTINCT field_name)) FROM {t} WHERE document_type IS NOT NULL GROUP BY 2
      UNION ALL SELECT 'confidence_adjustments', field_name, penalty::VARCHAR, NULL FROM {counted} UNION ALL SELECT 'field_accuracy_rates', field_name, accuracy::VARCHAR, NULL FROM {counted}
      UNION ALL SELECT 'correction_counts', field_name, '{{"total":' || total || ',"corrections":' || c || ',"accuracy":' || accuracy || '}}', NULL FROM {counted}"""


def _measured(k: int, p: str) -> str:
    """Mean credit of what round k sets aside under the patterns p."""
    return f"""(SELECT coalesce(avg(CASE correction_type WHEN 'auto_verified' THEN (coalesce(nullif(ocr_confidence, 0), 0.85) + coalesce(a.value::DOUBLE, 0) >= 0.5)::INT
        WHEN 'value_correction' THEN CASE WHEN o.value = corrected_value THEN 1 WHEN l.value = canonical_key THEN 0.5 ELSE 0 END WHEN 'field_added' THEN coalesce(list_contains(d.fields, field_name), false)::INT ELSE 0.5 END), 0.5)
      FROM s LEFT JOIN {p} a ON a.part = 'confidence_adjustments' AND a.key = field_name LEFT JOIN {p} o ON o.part = 'ocr_corrections' AND o.key = field_name || '::' || original_value
        LEFT JOIN {p} l ON l.part = 'label_mappings' AND l.key = lower(field_name) LEFT JOIN {p} d ON d.part = 'doctype_fields' AND d.key = document_type WHERE seq % 3 = {k} AND seq % 5 = 0)"""


def _folded(p: str, new: str) -> str:
    return f"SELECT part, key, coalesce(n.value, o.value) AS value, list_sort(list_distinct(list_concat(coalesce(o.fields, []), coalesce(n.fields, [])))) AS fields FROM {p} o FULL JOIN {new} n USING (part, key)"


CYCLES = (
    CORRECTIONS.rstrip()
    + f""",
p0 AS (SELECT '' AS part, '' AS key, '' AS value, NULL::VARCHAR[] AS fields WHERE false), l1 AS ({_learned(0)}), l2 AS ({_learned(1)}), l3 AS ({_learned(2)}),
p1 AS ({_folded('p0', 'l1')}), p2 AS ({_folded('p1', 'l2')}), m2 AS (SELECT {_measured(1, 'p1')} AS b, {_measured(1, 'p2')} AS a),
q2 AS (SELECT p2.* FROM p2 JOIN m2 ON a >= b UNION ALL SELECT p1.* FROM p1 JOIN m2 ON a < b), p3 AS ({_folded('q2', 'l3')}),
v AS (SELECT 1 AS version, 0 AS k, {_measured(0, 'p0')} AS b, {_measured(0, 'p1')} AS a UNION ALL SELECT 2, 1, b, a FROM m2 UNION ALL SELECT 3, 2, {_measured(2, 'q2')}, {_measured(2, 'p3')})
"""
)

LINE_SCORES = """
WITH f AS (SELECT l_orderkey AS document_id, l_linenumber AS seq, 'f' || l_linenumber AS field_name, least(1.0, l_discount * 9) AS score FROM lineitem),
c AS (SELECT *, CASE WHEN score >= 0.85 THEN 'HIGH' WHEN score >= 0.60 THEN 'MEDIUM' WHEN score >= 0.30 THEN 'LOW' ELSE 'UNCERTAIN' END AS class FROM f),
g AS (SELECT document_id, avg(score) AS overall, count(*) FILTER (class = 'HIGH') AS n_high, count(*) FILTER (class = 'MEDIUM') AS n_medium, count(*) FILTER (class = 'LOW') AS n_low, count(*) FILTER (class = 'UNCERTAIN') AS n_uncertain,
  coalesce(string_agg(field_name, ',' ORDER BY seq, field_name) FILTER (class IN ('LOW', 'UNCERTAIN')), '') AS flagged FROM c GROUP BY 1),
d AS (SELECT *, CASE WHEN overall >= 0.85 THEN 'HIGH' WHEN overall >= 0.60 THEN 'MEDIUM' WHEN overall >= 0.30 THEN 'LOW' ELSE 'UNCERTAIN' END AS category FROM g)
"""

BLOCKS = "WITH b AS (SELECT conv_id AS document_id, turn % 2 AS page, turn AS block, text, turn % 4 / 4.0 AS confidence, role AS engine FROM conversations)"

SCRIPTS = {"devanagari": "[\\x{0900}-\\x{097F}]", "tamil": "[\\x{0B80}-\\x{0BFF}]", "latin": "[A-z]"}


def _count(pattern: str, column: str = "t") -> str:
    return f"CAST(length({column}) - length(regexp_replace({column}, '{pattern}', '', 'g')) AS BIGINT)"


#: Convex parts of each shape; interiors of two meet unless the corners of both lie apart along the normal of some edge.
SHAPES = """
WITH k AS (SELECT p_partkey AS id, p_partkey % 50 < 2 AS same, p_partkey % 3 = 0 AS small, p_partkey AS k, p_size AS s FROM part),
v AS (SELECT id, k, same, CASE WHEN same THEN 300 WHEN small THEN 1000 + k * 13 % 100 ELSE k * 7919 % 1500 END AS x, CASE WHEN same THEN 700 WHEN small THEN 1000 + k * 31 % 100 ELSE k * 10007 % 1500 END AS y,
    CASE WHEN same THEN 11 WHEN small THEN k % 2 + 1 ELSE s END AS w, CASE WHEN same THEN 7 WHEN small THEN 2 ELSE s * 7 % 40 + 1 END AS h FROM k),
p AS (SELECT id, CASE WHEN k = 1 THEN [[[-10, -10], [4000, -10], [-10, 4000]]] WHEN k % 4 = 1 AND NOT same THEN [[[x, y], [x + w, y], [x, y + h]]]
    WHEN k % 4 = 2 AND NOT same THEN [[[x, y], [x + 2 * w, y], [x + 2 * w, y + h], [x, y + h]], [[x, y], [x + w, y], [x + w, y + 2 * h], [x, y + 2 * h]]]
    ELSE [[[x, y], [x + w, y], [x + w, y + h], [x, y + h]]] END AS parts FROM v),
g AS (SELECT id, min(id) OVER (PARTITION BY parts) AS first, parts FROM p),
c AS (SELECT id, unnest(parts) AS pts FROM g WHERE id = first),
e AS (SELECT id, pts, list_transform(range(1, len(pts) + 1), lambda i: [pts[i % len(pts) + 1][2] - pts[i][2], pts[i][1] - pts[i % len(pts) + 1][1]]) AS normals,
    list_min(list_transform(pts, lambda q: q[1])) AS x0, list_max(list_transform(pts, lambda q: q[1])) AS x1, list_min(list_transform(pts, lambda q: q[2])) AS y0, list_max(list_transform(pts, lambda q: q[2])) AS y1 FROM c),
m AS (SELECT DISTINCT a.id AS a, b.id AS b FROM e a JOIN e b ON a.id < b.id AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1
  WHERE len(list_filter(list_concat(a.normals, b.normals), lambda n: list_max(list_transform(a.pts, lambda q: q[1] * n[1] + q[2] * n[2])) <= list_min(list_transform(b.pts, lambda q: q[1] * n[1] + q[2] * n[2]))
    OR list_max(list_transform(b.pts, lambda q: q[1] * n[1] + q[2] * n[2])) <= list_min(list_transform(a.pts, lambda q: q[1] * n[1] + q[2] * n[2])))) = 0)
SELECT a, b, 'pair' AS kind FROM m UNION ALL SELECT first, id, 'member' FROM g WHERE id <> first
"""

#: Edges one by one: a ray's crossings, the two ends, and the foot on the edge's great circle if it lies between them.
NEAR = """
WITH c AS (SELECT c_custkey AS id, 73.0::DOUBLE + c_custkey % 37 / 500 AS x, 19.0::DOUBLE + c_custkey % 100 / 1000 AS y, (c_custkey % 7 + 1)::DOUBLE / 400 AS w FROM customer),
r AS (SELECT id, CASE WHEN id % 2 = 0 THEN [[x, y], [x + w, y], [x + w / 2, y + w]] ELSE [[x, y], [x + w, y], [x + w, y + w], [x + w / 2, y + w / 4], [x, y + w]] END AS ring FROM c),
e AS (SELECT id, ring[i] AS p, ring[i % len(ring) + 1] AS q FROM (SELECT id, ring, unnest(range(1, len(ring) + 1)) AS i FROM r)),
h AS (SELECT [cos(radians(19.05)) * cos(radians(73.03)), cos(radians(19.05)) * sin(radians(73.03)), sin(radians(19.05))] AS o),
u AS (SELECT id, p, q, o, [cos(radians(p[2])) * cos(radians(p[1])), cos(radians(p[2])) * sin(radians(p[1])), sin(radians(p[2]))] AS a, [cos(radians(q[2])) * cos(radians(q[1])), cos(radians(q[2])) * sin(radians(q[1])), sin(radians(q[2]))] AS b FROM e CROSS JOIN h),
d AS (SELECT *, [a[1] - o[1], a[2] - o[2], a[3] - o[3]] AS f, [b[1] - o[1], b[2] - o[2], b[3] - o[3]] AS g FROM u),
n AS (SELECT *, array_cross_product(a::DOUBLE[3], [g[1] - f[1], g[2] - f[2], g[3] - f[3]]::DOUBLE[3]) AS n FROM d),
m AS (SELECT id, (p[2] > 19.05) <> (q[2] > 19.05) AND 73.03 < p[1] + (q[1] - p[1]) * (19.05 - p[2]) / nullif(q[2] - p[2], 0) AS hit, 2 * asin(sqrt(list_dot_product(f, f)) / 2) AS corner,
    CASE WHEN list_dot_product(array_cross_product(n, a::DOUBLE[3])::DOUBLE[], f) <= 0 AND list_dot_product(array_cross_product(b::DOUBLE[3], n)::DOUBLE[], g) <= 0 THEN asin(abs(list_dot_product(n::DOUBLE[], f)) / sqrt(list_dot_product(n::DOUBLE[], n::DOUBLE[]))) END AS foot FROM n),
s AS (SELECT id, CASE WHEN count(*) FILTER (hit) % 2 = 1 THEN 0 ELSE least(min(corner), min(foot)) * 6371000.0 END AS metres FROM m GROUP BY 1)
SELECT id, round(metres, 3)::DOUBLE AS distance_m FROM s WHERE metres <= 2000
"""

NEAREST = """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, list_cosine_similarity(a.v, b.v) AS similarity FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
t AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, neighbour) AS rank FROM s QUALIFY rank <= 10)
"""


def _scores() -> str:
    """The forest's nodes as lists, walked tree by tree; it is fitted when asked for."""
    forest = anomaly.fit(anomaly.training_rows())
    trees = ", ".join(f"({k}, {t.feature.tolist()}, {t.value.tolist()}::DOUBLE[], {t.left.tolist()}, {t.rest.tolist()}::DOUBLE[])" for k, t in enumerate(forest.trees))
    return (
        RECORDS.replace("WITH k AS", "WITH RECURSIVE k AS", 1)
        + f""", m AS (SELECT *, TRY_CAST(nullif(regexp_replace(area, '[^0-9.\\-]', '', 'g'), '') AS DOUBLE) AS h FROM r),
x AS (SELECT record_id, [CASE WHEN h IS NULL THEN 0 ELSE ln(1 + h) END, 1.0, mutations, 1 - CASE WHEN h <= 0 THEN 0.5 ELSE 0 END,
  CASE WHEN h IS NULL THEN 0.3 WHEN h <= 0 THEN 1.0 WHEN h > 1000 THEN 0.9 ELSE 0 END,
  least(1.0, CASE WHEN lower(trim(owner_name)) = lower(trim(co_owner_name)) THEN 0.4 ELSE 0 END + CASE WHEN mutations > 10 THEN 0.4 ELSE 0 END)]::DOUBLE[] AS f FROM m),
t(tree, feature, split, below, rest) AS (VALUES {trees}),
w AS (SELECT record_id, f, tree, 0 AS at_node, 0 AS depth FROM x CROSS JOIN t
  UNION ALL SELECT record_id, f, w.tree, below[at_node + 1] + (f[feature[at_node + 1] + 1] >= split[at_node + 1])::INT, depth + 1 FROM w JOIN t ON w.tree = t.tree WHERE below[at_node + 1] > 0),
p AS (SELECT record_id, avg(depth + rest[at_node + 1]) AS mean FROM w JOIN t ON w.tree = t.tree WHERE below[at_node + 1] = 0 GROUP BY 1),
s AS (SELECT record_id, greatest(0.0, least(1.0, 0.5 - 1.25 * (-pow(2, -mean / {float(anomaly._depth(forest.size))!r}::DOUBLE) - ({forest.offset!r})::DOUBLE)))::DOUBLE AS score FROM p)
SELECT record_id, round(score, 6)::DOUBLE AS anomaly_score, CASE WHEN score < 0.4 THEN 'LOW' WHEN score < 0.7 THEN 'MEDIUM' ELSE 'HIGH' END AS anomaly_level, score >= 0.5 AS anomaly_flag FROM s
"""
    )


_CASES = ", ".join(f"({i}, '{kind}', {confidence}, {'NULL' if value is None else repr(value)})" for i, (_, kind, _, confidence, value) in enumerate(language_cases()))
LANGUAGES = f"""
WITH c(i, kind, confidence, value) AS (VALUES {_CASES})
SELECT c_custkey AS document_id, kind AS entity_type, coalesce(value, CAST(c_custkey AS VARCHAR)) AS value, CAST(confidence AS DOUBLE) AS confidence FROM customer JOIN c ON c_custkey % {len(language_cases())} = i
"""


def _quoted(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


_PATTERNS = ", ".join(f"('{code}', {i}, {_quoted(kind)}, {confidence}, {_quoted(pattern.replace('(?=', '(?:'))})" for code, rows in V.ENTITY_PATTERNS.items() if code != "en" for i, (kind, confidence, pattern) in enumerate(rows))
_SAID = ", ".join(f"{{'language': '{code}', 'label': {_quoted(label)}, 'said': {_quoted(value)}}}" for code, label, value in label_cases())
#: The patterns themselves, tried by another engine, which takes what comes after a value into the match.
LABELS = f"""
WITH p(language, ord, kind, confidence, pattern) AS (VALUES {_PATTERNS}),
d AS (SELECT c_custkey AS k, [{_SAID}][CAST(c_custkey % {len(label_cases())} + 1 AS INT)] AS c, [{', '.join(map(_quoted, BETWEEN))}][CAST(c_custkey // 7 % {len(BETWEEN)} + 1 AS INT)] AS b, [{', '.join(map(_quoted, AFTER))}][CAST(c_custkey // 3 % {len(AFTER)} + 1 AS INT)] AS a FROM customer),
t AS (SELECT k, c.language AS language, c.label || b || coalesce(c.said, CAST(k AS VARCHAR)) || a AS t FROM d),
m AS (SELECT k, kind, ord, confidence, trim(regexp_extract(t, pattern, 1, 'is'), ' ' || chr(10)) AS value FROM t JOIN p USING (language) WHERE kind IS NOT NULL)
SELECT k AS document_id, kind AS entity_type, value, confidence::DOUBLE AS confidence FROM m WHERE value <> '' QUALIFY row_number() OVER (PARTITION BY k, kind ORDER BY ord) = 1
"""

SQL = {
    "language_labels": LABELS,
    "content_duplicates": PAIRS
    + """SELECT document_id, duplicate_id, kind, CAST(k1 + k2 + k3 + k4 AS BIGINT) AS matched,
      array_to_string(list_filter([CASE WHEN k1 = 1 THEN 'p_brand' END, CASE WHEN k2 = 1 THEN 'p_type' END, CASE WHEN k3 = 1 THEN 'p_size' END, CASE WHEN k4 = 1 THEN 'p_name' END], lambda x: x IS NOT NULL), ',') AS matched_keys,
      round((k1 + k2 + k3 + k4) / 4, 6) AS similarity FROM m""",
    "duplicates_of_documents": PAIRS
    + """, n AS (SELECT a.id AS document_id, b.id AS duplicate_id, CAST(a.p_brand = b.p_brand AS INT) AS k1, CAST(a.p_type = b.p_type AS INT) AS k2, CAST(a.p_size = b.p_size AS INT) AS k3, CAST(a.p_name = b.p_name AS INT) AS k4 FROM v a JOIN v b ON a.id % 100 = 0 AND a.id <> b.id)
      SELECT document_id, duplicate_id, array_to_string(list_filter([CASE WHEN k1 = 1 THEN 'p_brand' END, CASE WHEN k2 = 1 THEN 'p_type' END, CASE WHEN k3 = 1 THEN 'p_size' END, CASE WHEN k4 = 1 THEN 'p_name' END], lambda x: x IS NOT NULL), ',') AS matched_keys,
        round((k1 + k2 + k3 + k4) / 4, 6) AS similarity FROM n WHERE k1 + k2 + k3 + k4 >= 3""",
    "duplicate_groups": PAIRS + "SELECT id AS document_id, g AS group_id FROM v",
    "file_duplicates": """WITH h AS (SELECT doc_id AS document_id, sha256(text) AS file_hash FROM documents)
      SELECT document_id, file_hash, min(document_id) OVER (PARTITION BY file_hash) AS duplicate_of, count(*) OVER (PARTITION BY file_hash) AS copies FROM h QUALIFY count(*) OVER (PARTITION BY file_hash) > 1""",
    "duplicate_report": PAIRS
    + """, h AS (SELECT id, sha256(p_brand || '|' || p_type || '|' || p_size) AS hash FROM v), g AS (SELECT id AS document_id, min(id) OVER (PARTITION BY hash) AS duplicate_id FROM h),
      a AS (SELECT document_id, duplicate_id FROM g WHERE document_id <> duplicate_id)
      SELECT document_id, duplicate_id, 'file_content' AS reason, 1.0::DOUBLE AS similarity FROM a UNION ALL
      SELECT document_id, duplicate_id, 'field_content', round((k1 + k2 + k3 + k4) / 4, 6) FROM m WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.document_id = m.document_id AND a.duplicate_id = m.duplicate_id)""",
    "status_kpis": """WITH n AS (SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS completed, count(*) FILTER (o_orderstatus = 'O') AS verification_required,
        count(*) FILTER (o_orderstatus NOT IN ('F', 'O', 'P')) AS failed, count(*) FILTER (o_orderstatus = 'P') AS processing FROM orders)
      SELECT *, CAST(floor(completed * 100 / greatest(total, 1) + 0.5) AS BIGINT) AS completed_pct, CAST(floor(verification_required * 100 / greatest(total, 1) + 0.5) AS BIGINT) AS verification_required_pct,
        CAST(floor(failed * 100 / greatest(total, 1) + 0.5) AS BIGINT) AS failed_pct, CAST(floor(processing * 100 / greatest(total, 1) + 0.5) AS BIGINT) AS processing_pct FROM n""",
    "group_counts": """WITH j AS (SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
      SELECT 'r_name' AS dimension, r_name AS value, count(*) AS n FROM j GROUP BY ALL UNION ALL SELECT 'n_name', n_name, count(*) FROM j GROUP BY ALL UNION ALL SELECT 'c_mktsegment', c_mktsegment, count(*) FROM j GROUP BY ALL""",
    "coverage": "SELECT round(count(*) FILTER (p_size > 25) * 100.0 / count(*), 1)::DOUBLE AS size, round(count(*) FILTER (p_partkey % 7 <> 0) * 100.0 / count(*), 1)::DOUBLE AS brand FROM part",
    "distinct_values": "SELECT DISTINCT p_brand AS value FROM part WHERE p_brand <> ''",
    "filtered_parcels": "SELECT p_partkey, p_name, p_brand FROM part WHERE lower(p_brand) = 'brand#11' AND (contains(lower(p_name), 'a') OR contains(CAST(p_partkey AS VARCHAR), 'a')) ORDER BY p_partkey LIMIT 500",
    "name_suggestions": """WITH a AS (SELECT DISTINCT n_name AS value FROM nation WHERE contains(lower(n_name), '1') ORDER BY 1 LIMIT 6), b AS (SELECT DISTINCT r_name AS value FROM region WHERE contains(lower(r_name), '1') ORDER BY 1 LIMIT 4)
      SELECT value, CAST(min(source) AS BIGINT) AS source FROM (SELECT value, 0 AS source FROM a UNION ALL SELECT value, 1 FROM b) GROUP BY 1 ORDER BY 2, 1 LIMIT 8""",
    "name_match": """SELECT n_nationkey, n_name, CAST(CASE WHEN lower(n_name) = 'nation_2' THEN 0 WHEN starts_with(lower(n_name), 'nation_2') THEN 1 ELSE 2 END AS BIGINT) AS match_rank FROM nation
      WHERE contains(lower(n_name), 'nation_2') ORDER BY match_rank, n_nationkey LIMIT 1""",
    "language_split": "SELECT count(*) FILTER (lang = 'es') AS hi, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang IS NULL OR lang NOT IN ('es', 'en')) AS other FROM documents",
    "top_corrected": "SELECT user_id, count(*) AS n FROM events WHERE user_id IS NOT NULL GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10",
    "reference_lookup": EXTRACTED + "SELECT document_id, ref_id FROM l",
    "reference_verify": COMPARED + "SELECT document_id, canonical_key, status FROM s",
    "verification_overall": COMPARED
    + """, n AS (SELECT document_id, count(*) FILTER (status = 'MATCH') AS match, count(*) FILTER (status = 'MISMATCH') AS mismatch, count(*) FILTER (status = 'NOT_FOUND') AS not_found, count(*) FILTER (status = 'NOT_VERIFIABLE') AS not_verifiable,
        bool_or(ref_id IS NOT NULL) AS has FROM s GROUP BY 1)
      SELECT document_id, match, mismatch, not_found, not_verifiable, CASE WHEN NOT has THEN 'NOT_FOUND' WHEN mismatch > 0 THEN 'MISMATCH_DETECTED' WHEN match > 0 AND not_found = 0 THEN 'VERIFIED' WHEN match > 0 THEN 'PARTIALLY_VERIFIED'
        WHEN not_found > 0 THEN 'UNVERIFIED' ELSE 'NOT_VERIFIABLE' END AS overall FROM n""",
    "registry_lookup": """WITH r AS (SELECT s_suppkey, f || s_name AS s_name, f || s_nationkey AS district FROM (SELECT *, CASE WHEN s_suppkey % 3 = 0 THEN 'former ' ELSE '' END AS f FROM supplier)),
      l AS (SELECT a.s_suppkey AS document_id, (a.s_suppkey % 2 = 0)::INT + 1 AS n, min(r.s_suppkey) AS ref_id FROM supplier a LEFT JOIN r ON CAST(a.s_nationkey AS VARCHAR) = r.district AND (a.s_suppkey % 2 <> 0 OR a.s_name = r.s_name) GROUP BY 1, 2)
      SELECT document_id, ref_id, CASE WHEN ref_id IS NULL THEN 0.0 ELSE round(least(1.0, n / 3), 2) END::DOUBLE AS match_score, CASE WHEN ref_id IS NULL THEN 'NOT_FOUND' ELSE 'MATCHED' END AS status FROM l""",
    "page_text": BLOCKS
    + """ SELECT document_id, page, sha256(coalesce(string_agg(text, chr(10) ORDER BY block) FILTER (trim(text) <> ''), '')) AS text, round(coalesce(avg(confidence) FILTER (confidence > 0), 0), 6)::DOUBLE AS avg_confidence,
      array_to_string(list_sort(list_distinct(list(engine))), ', ') AS engines FROM b GROUP BY 1, 2""",
    "page_confidence": BLOCKS
    + """, p AS (SELECT document_id, page, coalesce(avg(confidence) FILTER (confidence > 0), 0) AS a FROM b GROUP BY 1, 2), q AS (SELECT document_id, avg(a) AS by_page FROM p GROUP BY 1),
      f AS (SELECT document_id, avg(confidence) FILTER (confidence > 0) AS by_block FROM b GROUP BY 1) SELECT document_id, round(by_page, 6)::DOUBLE AS by_page, round(by_block, 6)::DOUBLE AS by_block FROM q JOIN f USING (document_id)""",
    "document_class": """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'Sale Deed' WHEN 1 THEN 'Mutation Record' WHEN 3 THEN 'Record of Rights' WHEN 4 THEN 'Registration Document' WHEN 5 THEN 'Sale Deed' ELSE 'Unknown' END AS document_type,
      round(CASE p_partkey % 6 WHEN 0 THEN 0.5 + 3 / 14 * 0.5 WHEN 1 THEN 0.5 + 2 / 6 * 0.5 WHEN 3 THEN 0.5 + 2 / 11 * 0.5 WHEN 4 THEN 0.5 + 1 / 4 * 0.5 WHEN 5 THEN 0.5 + 2 / 14 * 0.5 ELSE 0 END, 6)::DOUBLE AS score FROM part""",
    "script_counts": f"""WITH d AS (SELECT doc_id, text || CASE WHEN doc_id % 9 = 0 THEN ' गाव १२ ग्राम पत्र சர்வே' ELSE '' END AS t FROM documents),
      n AS (SELECT doc_id, t, {', '.join(f"{_count(p)} AS {s}" for s, p in SCRIPTS.items())} FROM d)
      SELECT doc_id, devanagari, tamil, latin, CASE WHEN length(trim(t, ' ' || chr(10) || chr(9) || chr(13))) < 5 THEN 'unknown' WHEN devanagari > 0 THEN 'mr' ELSE 'en' END AS language_b, CASE WHEN devanagari > 0 THEN 'hi' ELSE 'en' END AS language_c,
        CASE WHEN devanagari > latin THEN 'mr' ELSE 'en' END AS language_a, round(CASE WHEN devanagari + tamil + latin = 0 THEN 0.1 ELSE greatest(devanagari, latin) / (devanagari + tamil + latin) END, 6)::DOUBLE AS confidence FROM n""",
    "script_shares": """WITH c AS (SELECT n_nationkey, CAST(length(regexp_replace(n_name, '[^A-z]', '', 'g')) AS BIGINT) AS latin, CAST(3 * (n_nationkey % 4) AS BIGINT) AS gu FROM nation),
      u AS (SELECT n_nationkey, 'en' AS code, 'Latin' AS script, latin AS char_count FROM c UNION ALL SELECT n_nationkey, 'gu', 'Gujarati', gu FROM c WHERE gu > 0),
      r AS (SELECT *, row_number() OVER (PARTITION BY n_nationkey ORDER BY char_count DESC, script = 'Latin') - 1 AS rank FROM u) SELECT n_nationkey, rank, code, script, rank = 0 AS is_primary, char_count FROM r""",
    "reading_models": """WITH n AS (SELECT n_nationkey AS k, n_nationkey % 3 = 0 AS o, n_nationkey % 2 = 0 AS l, n_nationkey % 5 = 0 AS h FROM nation)
      SELECT k AS n_nationkey, o AS mixed, CASE WHEN o THEN 'tesseract_or' WHEN l THEN 'paddle_en' ELSE 'paddle_gu' END || CASE WHEN o THEN CASE WHEN l THEN ',paddle_en' ELSE ',paddle_gu' END ELSE '' END || CASE WHEN h THEN ',trocr' ELSE '' END AS engines FROM n""",
    "file_types": """SELECT p_partkey, ['7/12 Extract (सातबारा)', 'Khasra-Khatauni (खतौनी)', 'Patta/Chitta (பட்டா)', 'Land Revenue Deed'][CAST(p_partkey % 4 + 1 AS INT)] AS file_type,
      ['#16a34a', '#065f46', '#b45309', '#b45309'][CAST(p_partkey % 4 + 1 AS INT)] AS colour FROM part""",
    "linked_results": """SELECT o_orderkey AS document_id, 'A' AS field_name, r.id AS field_result_id FROM orders LEFT JOIN
      (SELECT l_orderkey, arg_max(l_partkey, l_partkey * 10 + l_linenumber) AS id FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) r ON l_orderkey = o_orderkey""",
    "key_values": """SELECT c_custkey AS document_id, 'Owner Name' AS field_name, c_name AS field_value, 0.88::DOUBLE AS confidence, 'person' AS data_type, 'OWNER_NAME' AS canonical_key FROM customer
      UNION ALL SELECT c_custkey, 'Village', c_mktsegment, 0.88, 'address', 'VILLAGE' FROM customer
      UNION ALL SELECT c_custkey, 'Area', (c_custkey % 90) || '.5 hectare', 0.88, 'area', 'AREA' FROM customer
      UNION ALL SELECT c_custkey, 'Ref', CAST(c_nationkey AS VARCHAR), 0.88, 'integer', NULL FROM customer""",
    "record_entities": """SELECT c_custkey AS document_id, 'SURVEY_NUMBER' AS entity_type, c_custkey || '/A' AS value, 0.90::DOUBLE AS confidence FROM customer
      UNION ALL SELECT c_custkey, 'KHATA_NUMBER', CAST(c_nationkey AS VARCHAR), 0.88 FROM customer UNION ALL SELECT c_custkey, 'AREA', '2.5', 0.85 FROM customer""",
    "table_fields": "SELECT p_partkey AS document_id, 'Brand' AS field_name, p_brand AS field_value, 0.80::DOUBLE AS confidence FROM part UNION ALL SELECT p_partkey, 'Item Type', p_type, 0.80 FROM part",
    "layout_stats": """WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\s]')) AS ls FROM documents)
      SELECT doc_id, CAST(len(ls) AS BIGINT) AS lines, CAST(len(list_filter(ls, lambda x: len(regexp_split_to_array(x, '[\\t|]+')) >= 3)) AS BIGINT) AS table_rows,
        CAST(len(list_filter(ls, lambda x: upper(x) = x AND lower(x) <> x AND length(trim(x, ' \t\r')) BETWEEN 6 AND 79)) AS BIGINT) AS headings FROM l""",
    "digits_and_terms": """WITH t AS (SELECT s_suppkey, s_suppkey % 2 = 0 AS even, translate(CAST(s_suppkey AS VARCHAR), '0123456789', '०१२३४५६७८९') AS d, CASE WHEN s_suppkey % 2 = 0 THEN ' हेक्टर' ELSE ' ગામ' END AS w FROM supplier), u AS (SELECT *, d || w AS t FROM t)
      SELECT s_suppkey, s_suppkey || w AS digits, CASE WHEN s_suppkey % 5 <> 0 THEN CASE WHEN even THEN 'Hectares' ELSE 'Village' END END AS term, d || CASE WHEN even THEN ' Hectares' ELSE ' Village' END AS inline,
        CASE WHEN length(t) <= 8 THEN repeat('*', CAST(len(t) AS INT)) ELSE substr(t, 1, 4) || '****' || right(t, 4) END AS masked FROM (SELECT *, d || w AS t FROM t)""",
    "number_parse": """WITH t AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) || '.' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') AS c, o_orderkey % 3 AS k FROM orders)
      SELECT o_orderkey, CASE WHEN k <> 2 THEN CAST(c AS DOUBLE) END AS lenient, CASE WHEN k = 0 THEN CAST(c AS DOUBLE) END AS currency, CASE WHEN k <> 2 THEN CAST(c AS DOUBLE) END AS first FROM t""",
    "date_parse": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 4 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day, o_orderkey % 5 <> 4 AND CAST(o_orderdate AS DATE) > DATE '1996-01-01' AS future FROM orders",
    "rule_engine": RECORDS + f", f AS (SELECT record_id, {FAILURES} AS x FROM n) SELECT record_id, len(x) = 0 AS is_valid, CAST(len(x) AS BIGINT) AS failed_count, array_to_string(x, ',') AS failures FROM f",
    "anomaly_features": RECORDS
    + """, m AS (SELECT *, TRY_CAST(nullif(regexp_replace(area, '[^0-9.\\-]', '', 'g'), '') AS DOUBLE) AS h FROM r)
      SELECT record_id, round(CASE WHEN h IS NULL THEN 0 ELSE ln(1 + h) END, 6)::DOUBLE AS area, 1.0::DOUBLE AS number_of_owners, mutations::DOUBLE AS mutation_frequency, round(1 - CASE WHEN h <= 0 THEN 0.5 ELSE 0 END, 6)::DOUBLE AS numeric_field_consistency,
        round(CASE WHEN h IS NULL THEN 0.3 WHEN h <= 0 THEN 1.0 WHEN h > 1000 THEN 0.9 ELSE 0 END, 6)::DOUBLE AS unusual_area_values,
        round(least(1.0, CASE WHEN lower(trim(owner_name)) = lower(trim(co_owner_name)) THEN 0.4 ELSE 0 END + CASE WHEN mutations > 10 THEN 0.4 ELSE 0 END), 6)::DOUBLE AS unusual_record_patterns FROM m""",
        "document_anomalies": RECORDS
    + f""", f AS (SELECT *, {FAILURES} AS x FROM n), y AS (SELECT record_id, list_filter([
        CASE WHEN area = '0' THEN 'area is not positive' END, CASE WHEN registration_date = '05-03-2030' THEN 'registration date is in the future' END,
        CASE WHEN (survey_number IS NULL)::INT + 2 >= 3 THEN 'three fields or more are missing' END, CASE WHEN market_value IS NOT NULL THEN 'market value is unusually high' END,
        CASE WHEN lower(trim(owner_name)) = lower(trim(co_owner_name)) THEN 'owner and co-owner are identical' END, CASE WHEN record_id % 200 < 100 THEN 'text is short' END, CASE WHEN len(x) > 0 THEN 'rules failed' END], lambda z: z IS NOT NULL) AS l FROM f)
      SELECT record_id, array_to_string(l, ';') AS anomalies, len(l) > 0 AS needs_review FROM y""",
    "confidence_report": LINE_SCORES + "SELECT document_id, round(overall, 6)::DOUBLE AS overall, category, n_high, n_medium, n_low, n_uncertain, flagged FROM d",
    "routing": LINE_SCORES
    + """SELECT CASE WHEN document_id % 17 = 0 OR document_id % 29 = 0 OR category IN ('LOW', 'UNCERTAIN') OR document_id % 31 = 0 OR document_id % 37 = 0 THEN 'VERIFICATION_REQUIRED' ELSE 'COMPLETED' END AS status, count(*) AS n FROM d GROUP BY 1""",
    "nearby": """WITH p AS (SELECT c_custkey AS id, 19.0::DOUBLE + c_custkey % 100 / 1000 AS lat, 73.0::DOUBLE + c_custkey % 37 / 500 AS lng FROM customer),
      d AS (SELECT id, 2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin((radians(lat) - radians(19.05)) / 2), 2) + cos(radians(19.05)) * cos(radians(lat)) * pow(sin(radians(lng - 73.03) / 2), 2)))) AS m FROM p)
      SELECT id, round(m, 3)::DOUBLE AS distance_m FROM d WHERE m <= 3000""",
    "parcel_overlaps": """WITH p AS (SELECT p_partkey AS id, p_partkey * 37 % 1000 AS x, p_partkey * 91 % 1000 AS y, p_size % 7 + 1 AS w, p_size % 5 + 1 AS h FROM part)
      SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.id < b.id AND a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h""",
    "transliterations": """SELECT s_suppkey, ['khasarA saMkhyA 12', 'jamAbaMdI', 'maujA jami', 'piMda zamIna', 'gAma tAluko', 'jami khAtA', 'kirAmam', 'grAmaM', 'grAma', 'grAmaM', 'Survey 10', 'pAtila ગામ'][CAST(s_suppkey % 12 + 1 AS INT)] || ' ' || s_name AS latin FROM supplier""",
    "names_within_two": """SELECT a.c_custkey AS a, b.c_custkey AS b, CAST(levenshtein(a.c_name, b.c_name) AS INT) AS distance FROM customer a JOIN customer b ON a.c_custkey < b.c_custkey WHERE levenshtein(a.c_name, b.c_name) <= 2""",
    "vector_search_exact": NEAREST + "SELECT query, rank, neighbour, round(similarity, 5)::DOUBLE AS similarity FROM t",
    "vector_search": NEAREST + "SELECT count(DISTINCT query) AS queries, count(*) AS neighbours, true AS found FROM t",
    "shape_overlaps": SHAPES,
    "parcels_near_point": NEAR,
    "parcel_areas": """WITH p AS (SELECT p_partkey AS id, p_partkey * 37 % 1000 AS x, p_partkey * 91 % 1000 AS y, p_size % 7 + 1 AS w, p_size % 5 + 1 AS h FROM part)
      SELECT id, (w * h)::DOUBLE AS area, x || ',' || y || ',' || (x + w) || ',' || (y + h) AS bbox FROM p""",
    "learning_rates": CORRECTIONS + "SELECT field_name, total, corrected, round(accuracy, 6)::DOUBLE AS accuracy, round(penalty, 6)::DOUBLE AS penalty FROM pen",
    "learning_patterns": CORRECTIONS + "SELECT * FROM cm",
    "learning_types": CORRECTIONS + "SELECT document_type, string_agg(field_name, ',' ORDER BY field_name) AS fields FROM ty GROUP BY 1",
    "learning_accuracy": CORRECTIONS
    + """SELECT round(coalesce(avg(CASE correction_type WHEN 'auto_verified' THEN CASE WHEN s.ocr_confidence::DOUBLE + coalesce(pen.penalty, 0)::DOUBLE >= 0.5 THEN 1.0 ELSE 0.0 END
        WHEN 'value_correction' THEN CASE WHEN cm.corrected_value = s.corrected_value THEN 1.0 WHEN lm.learned_key = s.canonical_key THEN 0.5 ELSE 0.0 END
        WHEN 'field_added' THEN CASE WHEN ty.field_name IS NOT NULL THEN 1.0 ELSE 0.0 END ELSE 0.5 END), 0.5), 6)::DOUBLE AS accuracy
      FROM s LEFT JOIN pen ON s.field_name = pen.field_name LEFT JOIN cm ON s.field_name = cm.field_name AND s.original_value = cm.original_value LEFT JOIN lm ON s.field_name = lm.field_name
      LEFT JOIN ty ON s.field_name = ty.field_name AND s.document_type = ty.document_type""",
    "learning_cycles": CYCLES
    + """SELECT version::BIGINT AS version, (SELECT count(*) FROM s WHERE seq % 3 = k AND seq % 5 <> 0) AS training_samples_count, (SELECT count(*) FROM s WHERE seq % 3 = k AND seq % 5 = 0) AS test_samples_count,
      round(b, 6)::DOUBLE AS accuracy_before, round(a, 6)::DOUBLE AS accuracy_after, version = 1 OR a >= b AS accepted, version = max(CASE WHEN version = 1 OR a >= b THEN version END) OVER () AS deployed FROM v""",
    "learned_patterns": CYCLES + "SELECT part, key, value, CASE WHEN part = 'doctype_fields' THEN array_to_string(fields, ',') END AS fields FROM p3",
    "learning_due": CORRECTIONS + "SELECT count(*) FILTER (NOT used) AS unused, count(*) FILTER (NOT used) >= 10 AS due FROM s",
    "latest_versions": "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(event_id) + 1 AS next_id FROM events GROUP BY 1",
    "first_fields": "SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) = 1",
    "merged_fields": """WITH f AS (SELECT l_orderkey AS document_id, l_partkey * 10 + l_linenumber AS seq, l_returnflag AS canonical_key, l_partkey AS field_value FROM lineitem)
      SELECT document_id, seq, canonical_key, field_value FROM f WHERE seq % 2 = 0 UNION ALL
      (SELECT document_id, seq, canonical_key, field_value FROM f o WHERE seq % 2 = 1 AND NOT EXISTS (SELECT 1 FROM f e WHERE e.seq % 2 = 0 AND e.document_id = o.document_id AND e.canonical_key = o.canonical_key)
        QUALIFY row_number() OVER (PARTITION BY document_id, canonical_key ORDER BY seq) = 1)""",
    "enriched_fields": """WITH f AS (SELECT l_orderkey AS document_id, l_linenumber AS seq, 'f' || l_linenumber || '_' || l_partkey || '_' || l_suppkey AS field_name, l_discount * 9 AS score, NOT (l_orderkey % 3 = 0 AND l_linenumber % 2 <> 0) AS is_valid,
        l_linenumber = 2 AND l_orderkey % 2 = 0 AS mismatch FROM lineitem)
      SELECT document_id, field_name, is_valid, CASE WHEN NOT is_valid THEN 'invalid' WHEN mismatch THEN 'mismatch' WHEN score < 0.6 THEN 'review_needed' ELSE 'valid' END AS validation_status FROM f""",
    "updated_fields": "SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 0 THEN 'new ' || c_name ELSE c_name END AS field_value, c_mktsegment AS field_name FROM customer WHERE c_custkey % 25 <> 0",
    "flagged_fields": """WITH f AS (SELECT l_orderkey AS document_id, l_linenumber AS seq, CASE l_linenumber WHEN 0 THEN 'x' WHEN 1 THEN 'owner_name' WHEN 2 THEN 'area' WHEN 3 THEN 'note' WHEN 4 THEN 'reg_date' ELSE 'total_area' END AS field_name, l_returnflag AS rf FROM lineitem),
      w AS (SELECT *, CASE WHEN contains(field_name, 'area') THEN 0 WHEN contains(field_name, 'date') THEN 1 WHEN contains(field_name, 'owner') THEN 3 ELSE 99 END AS w FROM f),
      k AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY w, seq) AS k FROM w),
      a AS (SELECT document_id, 'a' || seq AS anomaly_reason, row_number() OVER (PARTITION BY document_id ORDER BY seq) AS k FROM f WHERE rf = 'R')
      SELECT k.document_id, k.seq, k.field_name, a.anomaly_reason, a.anomaly_reason IS NOT NULL AS anomaly_flag FROM k LEFT JOIN a ON k.document_id = a.document_id AND k.k = a.k AND k.w < 99""",
    "bbox_grid": """WITH b AS (SELECT l_orderkey, l_linenumber, round_even(l_quantity / 1024 * 1000, 0) AS x0, round_even(l_linenumber / 768 * 1000, 0) AS y0, round_even(l_quantity * 30 / 1024 * 1000, 0) AS x1, l_linenumber < 7 AS ok FROM lineitem),
      c AS (SELECT *, CAST(least(1000, x0) AS INT) AS a, CAST(least(1000, y0) AS INT) AS b, CAST(least(1000, x1) AS INT) AS d FROM b)
      SELECT l_orderkey, l_linenumber, CASE WHEN ok THEN least(a, d) || ',' || least(b, 1000) || ',' || greatest(a, d) || ',' || 1000 END AS bbox FROM c""",
    "json_values": "SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS BIGINT), 0) AS k FROM events",
    "embedding_cosine": """SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5)::DOUBLE AS cosine FROM embeddings a CROSS JOIN embeddings b WHERE a.vec_id % 100 = 0""",
    "name_similarity": """SELECT r_regionkey, n_nationkey, round(1 - levenshtein(lower(r_name), lower(n_name)) / greatest(length(r_name), length(n_name)), 6)::DOUBLE AS similarity FROM region CROSS JOIN nation""",
    "change_intervals": """WITH d AS (SELECT user_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts))) / 1000000 AS s FROM events)
      SELECT user_id, count(s) AS n, CAST(sum(CAST(round(s, 0) AS BIGINT)) AS BIGINT) AS seconds FROM d GROUP BY 1""",
    "unit_areas": "SELECT p_partkey, round(p_size * CASE p_partkey % 4 WHEN 0 THEN 4046.86 WHEN 1 THEN 10000.0 WHEN 2 THEN 0.0929 END, 4)::DOUBLE AS square_metres FROM part",
    "low_blocks": "SELECT conv_id AS document_id, turn AS ord, sha256(text) AS text, (turn % 4 / 4)::DOUBLE AS confidence FROM conversations WHERE turn % 4 / 4 < 0.65 AND length(trim(text)) >= 2",
    "block_types": "SELECT p_partkey, ['unknown', 'title', 'table', 'field', 'form', 'text'][CAST(p_partkey % 6 + 1 AS INT)] AS block_type FROM part",
    "field_problems": "SELECT c_custkey, ['area is not positive', NULL, 'date is in the future', NULL, 'amount is negative', 'empty', NULL][CAST(c_custkey % 7 + 1 AS INT)] AS problem FROM customer",
    "script_votes": """WITH c AS (SELECT user_id AS document_id, event_type AS script, count(*) AS n FROM events GROUP BY 1, 2)
      SELECT document_id, arg_max(script, (n, script)) AS script, round(least(max(n) / sum(n) * 0.85 + 0.15, 0.97), 6)::DOUBLE AS confidence FROM c GROUP BY 1""",
    "map_centre": "SELECT round(avg(CASE WHEN s_suppkey % 4 <> 0 THEN 10.0 + s_suppkey % 8 END), 6)::DOUBLE AS lat, round(avg(CASE WHEN s_suppkey % 5 <> 0 THEN 70.0 + s_suppkey % 3 END), 6)::DOUBLE AS lng FROM supplier",
    "snapshot_sizes": "SELECT n_nationkey AS version, CAST(CASE WHEN n_nationkey % 2 = 0 THEN 2 ELSE 0 END AS BIGINT) AS ocr_corrections, 1::BIGINT AS label_mappings, 0::BIGINT AS confidence_adjustments FROM nation",
    "share_totals": "SELECT l_orderkey, round(sum(l_quantity), 6)::DOUBLE AS total FROM lineitem GROUP BY 1 HAVING abs(sum(l_quantity) - 100) > 0.01",
    "block_fields": """SELECT s_suppkey AS document_id, 'Owner' AS field_name, s_name AS field_value, 0.95::DOUBLE AS confidence, 'person' AS data_type, 'OWNER_NAME' AS canonical_key FROM supplier
      UNION ALL SELECT s_suppkey, 'Khata No', CAST(s_suppkey AS VARCHAR), 0.7, 'identifier', 'KHATA_NUMBER' FROM supplier""",
    "record_maps": """WITH f AS (SELECT l_orderkey AS d, l_partkey * 10 + l_linenumber AS seq, CASE WHEN l_returnflag <> 'N' THEN l_returnflag ELSE 'raw' END AS k, l_partkey AS v FROM lineitem),
      e AS (SELECT d, seq, v, unnest(list_distinct([k, lower(k)])) AS k FROM f), l AS (SELECT d, k, arg_max(v, seq) AS v FROM e GROUP BY 1, 2)
      SELECT d AS document_id, string_agg(k || '=' || v, ',' ORDER BY k) AS record FROM l GROUP BY 1""",
    "owner_counts": "SELECT n_nationkey, CAST(CASE WHEN n_nationkey % 2 = 0 THEN 3 ELSE 2 END AS BIGINT) AS owners FROM nation",
    "word_boxes": "WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS ws FROM part) SELECT p_partkey, i - 1 AS word_index, ws[i] AS word FROM (SELECT p_partkey, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)",
    "ocr_lines": "SELECT p_partkey AS document_id, p_name AS text, 0.5::DOUBLE AS confidence, 'b0' AS bbox FROM part UNION ALL SELECT p_partkey, p_brand, NULL, NULL FROM part",
    "learned_fields": CORRECTIONS
    + """SELECT s.seq AS document_id, s.field_name, coalesce(cm.corrected_value, ' ' || s.original_value) AS field_value, lm.learned_key AS canonical_key,
      round(greatest(0.0, least(1.0, 0.8 + coalesce(pen.penalty, 0))), 6)::DOUBLE AS confidence FROM s LEFT JOIN cm ON s.field_name = cm.field_name AND s.original_value = cm.original_value
      LEFT JOIN lm ON s.field_name = lm.field_name LEFT JOIN pen ON s.field_name = pen.field_name""",
    "sample_candidates": CORRECTIONS + "SELECT seq AS document_id, field_name FROM s WHERE seq % 3 = 0 AND ocr_confidence >= 0.7 AND seq % 7 <> 0 AND seq % 2 <> 0",
    "replaced_documents": """WITH n AS (SELECT l_orderkey AS document_id, -l_quantity AS value FROM lineitem WHERE l_orderkey % 5 = 0 AND l_quantity > 25)
      SELECT l_orderkey AS document_id, l_quantity AS value FROM lineitem WHERE l_orderkey NOT IN (SELECT document_id FROM n) UNION ALL SELECT * FROM n""",
    "status_changes": "SELECT o_orderkey AS document_id, CASE WHEN o_orderkey % 4 = 0 THEN 'COMPLETED' ELSE o_orderstatus END AS status FROM orders",
    "audit_rows": "SELECT 'someone' AS username, 'DELETE' AS action, 'supplier' AS resource_type, CAST(s_suppkey AS VARCHAR) AS resource_id FROM supplier WHERE s_acctbal < 0",
    "next_version": "SELECT max(event_id) + 1 AS version FROM events",
    "key_lookup": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 7",
    "badges": """SELECT CASE WHEN l_discount * 10 >= 0.8 THEN 'HIGH' WHEN l_discount * 10 >= 0.6 THEN 'MEDIUM' ELSE 'LOW' END AS badge,
      CASE WHEN l_discount * 10 >= 0.85 THEN 'HIGH' WHEN l_discount * 10 >= 0.6 THEN 'MEDIUM' WHEN l_discount * 10 >= 0.3 THEN 'LOW' ELSE 'UNCERTAIN' END AS category, count(*) AS n FROM lineitem GROUP BY 1, 2""",
    "stream_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, round(sum(value), 4)::DOUBLE AS total FROM events GROUP BY 1, 2",
    "low_blocks_of_engine": "SELECT conv_id AS document_id, turn AS ord, 'paddle_user' AS engine FROM conversations WHERE role = 'user' AND turn % 4 / 4 < 0.5 AND length(trim(text)) >= 2",
    "stream_deduplicated": "SELECT event_id, event_type, value FROM events",
    "replayed_batches": "SELECT c_custkey AS document_id, CASE WHEN c_custkey % 3 = 0 THEN 'new ' ELSE '' END || c_name AS field_value, (c_custkey % 3 = 0)::BIGINT AS batch_id FROM customer WHERE c_custkey % 5 <> 0",
    "staged_documents": "SELECT c_custkey AS document_id, 'extraction' AS stage, (c_custkey % 2 = 0)::BIGINT AS batch_id, true AS ended FROM customer",
    "reused_stages": "SELECT c_custkey AS document_id, CASE WHEN c_custkey % 2 = 0 THEN 'kept' ELSE 'fresh' END AS made FROM customer",
    "learning_trigger": """WITH c AS (SELECT 'f' || (user_id % 50) AS key, count(*) // 10 AS k FROM events WHERE event_id % 2 = 1 GROUP BY 1) SELECT key, unnest(range(1, k + 1)) AS nth, 10::BIGINT AS samples FROM c""",
    "brand_facet": "SELECT p_partkey, p_brand FROM part WHERE lower(p_brand) = 'brand#11'",
    "visible_rows": """WITH u AS (SELECT n_name AS username, n_regionkey > 1 AS officer FROM nation WHERE n_nationkey % 2 = 0)
      SELECT username, 'region' AS resource, r_regionkey::BIGINT AS key, r_name AS name FROM u CROSS JOIN region UNION ALL SELECT username, 'nation', n_nationkey::BIGINT, n_name FROM u CROSS JOIN nation WHERE NOT officer""",
    "page_entities": """WITH d AS (SELECT s_suppkey AS k, CASE s_suppkey % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'hi' WHEN 2 THEN 'bn' ELSE 'gu' END AS language, s_suppkey || '.0,1.0,2.0,3.0' AS bbox FROM supplier),
      e AS (SELECT k, language, 'SURVEY_NUMBER' AS entity_type, CASE WHEN k % 4 < 3 THEN CAST(k AS VARCHAR) ELSE '999' END AS value, 0.9 AS confidence, CASE WHEN k % 4 < 3 THEN 1 ELSE 2 END AS page, bbox FROM d
        UNION ALL SELECT k, language, 'KHATA_NUMBER', '7', 0.88, 1, bbox FROM d UNION ALL SELECT k, language, 'PLOT_NUMBER', 'P' || k, 0.85, 1, NULL FROM d UNION ALL SELECT k, language, 'MUTATION_NUMBER', '5', 0.82, 2, bbox FROM d)
      SELECT k AS document_id, entity_type, value, confidence::DOUBLE AS confidence, page::BIGINT AS page, bbox, language FROM e""",
    "page_rows": """WITH d AS (SELECT s_suppkey AS k, s_suppkey % 4 / 4.0 AS c, CASE s_suppkey % 4 WHEN 0 THEN 'Survey No: ' WHEN 1 THEN 'खसरा संख्या: ' WHEN 2 THEN 'দাগ নং: ' ELSE 'નોંધ ' END || s_suppkey AS own FROM supplier),
      p AS (SELECT k, c, CASE WHEN k % 3 = 0 THEN 7 ELSE 1 END AS page, concat_ws(chr(10), ' ', own, 'Khata No. 7', 'Plot No:', 'P' || k) AS t, [' ', NULL, own, 'Khata No. 7', 'Plot No:', 'P' || k] AS blocks FROM d
        UNION ALL SELECT k, c, 2, concat_ws(chr(10), 'Survey No: 999', 'Mutation No: 5', 'Khata No. 8'), ['Survey No: 999', 'Mutation No: 5', 'Khata No. 8'] FROM d WHERE k % 3 <> 0)
      SELECT k AS document_id, page::BIGINT AS page_number, sha256(t) AS raw_text, round(c, 6)::DOUBLE AS ocr_confidence, CASE WHEN k % 2 = 0 THEN 'paddle_hi' ELSE 'unknown' END AS ocr_engine,
        (2 + len(blocks) - 1 + list_sum(list_transform(blocks, lambda b: CASE WHEN b IS NULL THEN 0 ELSE length(b) + 10 END)) + len(blocks) * (length('{"bbox":[,1.0,2.0,3.0],"confidence":}') + length(k || '.0') + length(CAST(c::DOUBLE AS VARCHAR)) + CASE WHEN k % 2 = 0 THEN length(',"engine":"paddle_hi"') ELSE 0 END))::BIGINT AS n FROM p""",
    "serialized_fields": """SELECT c_custkey % 50 AS document_id, '{"id":"' || c_custkey || '","document_id":' || (c_custkey % 50) || ',"field_name":"a \\"name\\"","field_value":' || CASE WHEN c_custkey % 3 <> 0 THEN '"' || c_name || '"' ELSE 'null' END
      || ',"normalized_value":null,"data_type":"string","confidence":' || CAST((c_custkey % 4 / 4)::DOUBLE AS VARCHAR) || ',"page_number":null,"bounding_box":null,"source_text":null,"extraction_method":null,"canonical_key":null,"original_text":null,"normalized_text":null,"transliteration":null,"translation":null,"validated":'
      || CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END || ',"validation_status":"pending","anomaly_flag":null,"anomaly_reason":null,"created_at":null}' AS value FROM customer""",
    "second_page": "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS rank FROM orders QUALIFY rank BETWEEN 41 AND 60",
    "last_versions": "SELECT event_id AS version, event_type FROM events ORDER BY event_id DESC LIMIT 20",
    "cascaded_delete": """WITH k AS (SELECT c_custkey AS document_id FROM customer WHERE c_custkey % 4 <> 1), d AS (SELECT c_custkey FROM customer WHERE c_custkey % 4 = 1)
      SELECT document_id, 1::BIGINT AS n, 'customer' AS kept FROM k UNION ALL SELECT o_custkey, count(*), 'orders' FROM orders WHERE o_custkey NOT IN (FROM d) GROUP BY 1
      UNION ALL SELECT o_custkey, count(*), 'lines' FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey NOT IN (FROM d) GROUP BY 1""",
    "registry_source": """SELECT s_suppkey AS document_id, CASE WHEN s_nationkey IN (1, 2) THEN CAST(s_suppkey AS VARCHAR) END AS ref_id, CASE WHEN s_nationkey NOT IN (1, 2) THEN 0.0 WHEN s_suppkey % 2 = 0 THEN 0.67 ELSE 0.33 END::DOUBLE AS match_score,
      CASE WHEN s_nationkey IN (1, 2) THEN 'MATCHED' ELSE 'NOT_FOUND' END AS status FROM supplier""",
    "pdf_pages": """SELECT s_suppkey, 1::BIGINT AS page, 'Survey No: ' || s_suppkey || chr(10) || 'Owner: ' || s_name AS text FROM supplier WHERE s_suppkey % 10 <> 0
      UNION ALL SELECT s_suppkey, 2, 'page two of ' || s_suppkey || chr(10) || 'Area' FROM supplier WHERE s_suppkey % 10 <> 0""",
    "seeded_table": "SELECT n_nationkey, n_name, 'True,False' AS seeds FROM nation",
    "pixel_boxes": """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber < 7 THEN array_to_string(list_transform([l_linenumber * 10 * 1024 / 1000, l_linenumber * 20 * 768 / 1000, l_linenumber * 100 * 1024 / 1000, 900 * 768 / 1000], lambda v: CAST(round(v, 3)::DOUBLE AS VARCHAR)), ',') END AS bbox FROM lineitem""",
    "shown_dates": "SELECT o_orderkey, strftime(o_orderdate, '%d %b %Y') AS shown FROM orders",
    "area_mismatches": """WITH p AS (SELECT p_partkey AS id, p_size * 2.0 AS declared, 2.0 * (p_size % 7 + 1) * (p_size % 5 + 1) AS measured FROM part)
      SELECT id, measured::DOUBLE AS measured FROM p WHERE abs(measured - declared) > 0.05 * declared""",
    "text_and_table_fields": """SELECT p_partkey AS document_id, 'Brand' AS field_name, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'x' END AS field_value, 0.88::DOUBLE AS confidence FROM part
      UNION ALL SELECT p_partkey, 'Item Type', p_type, 0.80 FROM part""",
    "correction_samples": """SELECT c_custkey % 50 AS document_id, c_custkey AS id, 'owner' AS field_name, 'OWNER_NAME' AS canonical_key, c_name AS original_value, 'new ' || c_name AS corrected_value, 'value_correction' AS correction_type
      FROM customer WHERE c_custkey % 3 = 0""",
    "manual_rows": "SELECT c_custkey AS id, c_name AS field_value, CASE WHEN c_custkey % 2 = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS confidence, 'manual' AS extraction_method, 'valid' AS validation_status FROM customer",
    "deployments": """SELECT n_nationkey::BIGINT AS version, n_regionkey::BIGINT AS training_samples_count, n_nationkey = 23 AS deployed, 0.1::DOUBLE AS improvement_delta FROM nation
      UNION ALL SELECT max(n_nationkey) + 1, 9, true, 0.15 FROM nation UNION ALL SELECT max(n_nationkey) + 2, 9, false, -0.25 FROM nation""",
    "ordered_orders": "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 50",
    "latest_snapshots": "SELECT n_nationkey AS version, n_nationkey < 20 AS deployed FROM nation WHERE n_nationkey = (SELECT max(n_nationkey) FROM nation) OR n_nationkey = 19",
    "parcel_of_documents": """WITH d AS (SELECT p_partkey AS id, p_partkey % 3 <> 0 AS s, p_partkey % 2 = 0 AS k FROM part),
      m AS (SELECT d.id, d.s, d.k, min(r.p_partkey) AS ref_id FROM d JOIN part r ON r.p_partkey % 4 <> 0 AND (d.s OR d.k) AND (NOT d.s OR d.id = r.p_partkey) AND (NOT d.k OR d.id % 50 = r.p_partkey % 50) GROUP BY ALL)
      SELECT id AS document_id, ref_id, CASE WHEN s AND k THEN 'survey_number,khata_number' WHEN s THEN 'survey_number' ELSE 'khata_number' END AS matched, (ref_id * 37 % 1000)::DOUBLE AS x FROM m""",
    "language_entities": LANGUAGES,
    "devanagari_and_two_line_fields": """SELECT c_custkey AS document_id, 'गाव' AS field_name, c_mktsegment AS field_value, 0.88::DOUBLE AS confidence, 'VILLAGE' AS canonical_key FROM customer
      UNION ALL SELECT c_custkey, 'मूळ' || chr(10) || 'गाव', c_mktsegment, 0.85, NULL FROM customer UNION ALL SELECT c_custkey, 'मूळ', 'गाव: ' || c_mktsegment, 0.78, NULL FROM customer UNION ALL SELECT c_custkey, 'Owner Name', c_name, 0.78, 'OWNER_NAME' FROM customer""",
    "page_fields": """SELECT s_suppkey AS document_id, 1::BIGINT AS page_number, 'Owner' AS field_name, s_name AS field_value, s_suppkey || '.0,0.0,9.0,9.0' AS box FROM supplier
      UNION ALL SELECT s_suppkey, 2, 'Village', s_name, s_suppkey || '.0,0.0,9.0,9.0' FROM supplier""",
    "exported_csv": """SELECT CAST(s_suppkey AS VARCHAR) AS document_id, 'a "b", ' || s_name AS filename, 'COMPLETED' AS status, CASE WHEN s_suppkey % 2 = 0 THEN 'hi' ELSE 'auto' END AS language,
      CASE WHEN s_suppkey % 3 = 0 THEN CAST(s_suppkey AS VARCHAR) ELSE '0' END AS file_size, '2024' AS created_at FROM supplier""",
    "exported_features": "SELECT p_partkey AS id, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey * 91 % 1000 + p_size % 5 + 1 END::DOUBLE AS y FROM part",
    "feature_file": "SELECT p_partkey AS id, (p_partkey * 37 % 1000)::DOUBLE AS x FROM part ORDER BY 1 LIMIT 20",
    "stored_objects": "SELECT n_nationkey, strlen(n_name) AS length, sha256(n_name) AS file_hash FROM nation",
    "ground_truth": "SELECT CAST(n_nationkey AS VARCHAR) AS id, 'VILLAGE' AS field_name, n_name AS field_value FROM nation UNION ALL SELECT CAST(n_nationkey AS VARCHAR), 'AREA', CAST(n_regionkey AS VARCHAR) FROM nation",
}


def sql() -> dict[str, str]:
    """SQL of all queries that have one."""
    return {**SQL, "anomaly_scores": _scores()}
