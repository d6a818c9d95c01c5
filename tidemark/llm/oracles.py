"""The same results in SQL, for those operators that SQL can express: every pair that shares a shingle, every n-gram."""

#: Linked texts by counts of shared shingles, and reachability over links.
NEAR_DUPLICATES = r"""WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
n AS (SELECT r, doc_id, len(s) AS n FROM s),
e AS (SELECT r, hash(unnest(s)) AS h FROM s WHERE doc_id IS NOT NULL),
c AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM e a JOIN e b ON a.h = b.h AND a.r < b.r GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
sides AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT r AS a, r AS b FROM n UNION SELECT reach.a, sides.b FROM reach JOIN sides ON sides.a = reach.b),
least AS (SELECT reach.a AS r, min(n.doc_id) AS component_id FROM reach JOIN n ON n.r = reach.b GROUP BY reach.a)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, CASE WHEN n.doc_id IS NOT NULL THEN component_id END AS component_id, coalesce(doc_id = component_id, true) AS kept FROM n JOIN least USING (r)"""

#: Words, repeated windows and lines of each text, and the characters that later copies of n-grams and lines cover.
QUALITY_RULES = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
p AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM w),
g AS (SELECT r, n, i, hash(array_to_string(w[i:i + n - 1], ' ')) AS h FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, range(5, 11) t(n))),
k AS (SELECT r, n, i, count(*) OVER (PARTITION BY r, n, h) AS times, row_number() OVER (PARTITION BY r, n, h ORDER BY i) AS turn FROM g),
inside AS (SELECT DISTINCT r, n, i + o AS i, later FROM (SELECT r, n, i, turn > 1 AS later, unnest(range(0, n)) AS o FROM k WHERE times > 1)),
rep AS (SELECT r, count(DISTINCT i) AS n FROM inside WHERE n = 5 GROUP BY r),
tot AS (SELECT r, count(*) AS n_words, sum(length(word)) AS chars FROM p GROUP BY r),
bad AS (SELECT DISTINCT r FROM (SELECT r, n, sum(length(word)) AS c FROM inside JOIN p USING (r, i) WHERE later GROUP BY r, n) JOIN tot USING (r) WHERE c > [0.15, 0.14, 0.13, 0.12, 0.11, 0.10][n - 4]::DOUBLE * chars),
l AS (SELECT r, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS line FROM (SELECT r, string_split(text, chr(10)) AS x FROM d)),
t AS (SELECT r, line, row_number() OVER (PARTITION BY r, line ORDER BY i) > 1 AS again FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
ls AS (SELECT r, count(*) AS lines, count(*) FILTER (again) AS dup, coalesce(sum(length(line)) FILTER (again), 0) AS dup_chars, sum(length(line)) AS line_chars FROM t GROUP BY r),
o AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, CAST(coalesce(chars, 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
  coalesce(n_words, 0) < 10 OR 100 * coalesce(rep.n, 0) > 20 * n_words AS base_failed, bad.r IS NOT NULL OR coalesce(lines >= 7 AND dup > 0.3::DOUBLE * lines, false) OR coalesce(dup_chars > 0.2::DOUBLE * line_chars, false) AS own_failed
  FROM d LEFT JOIN tot USING (r) LEFT JOIN rep USING (r) LEFT JOIN bad USING (r) LEFT JOIN ls USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR own_failed) AS kept FROM o"""

#: Vector codes: every part against every entry in every round; {from} and {to} are the rounds.
_KEPT = """SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * x::DOUBLE) AS BIGINT)) AS v
FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""
_ROUND = """a{to} AS MATERIALIZED (SELECT r, p, arg_min(e, d * 256 + e) AS e, min(d) AS d FROM (SELECT r, p, e, list_sum(list_transform(list_zip(parts.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
  FROM parts JOIN b{from} b USING (p)) GROUP BY r, p),
m{to} AS (SELECT p, e, list(c ORDER BY i) AS x FROM (SELECT p, e, i, CAST(floor(sum(c) / count(*)) AS BIGINT) AS c FROM (SELECT a{to}.p, e, unnest(x) AS c, generate_subscripts(x, 1) AS i FROM a{to} JOIN parts USING (r, p)) GROUP BY p, e, i) GROUP BY p, e),
b{to} AS MATERIALIZED (SELECT p, e, coalesce(m.x, b.x) AS x FROM b{from} b LEFT JOIN m{to} m USING (p, e)),"""
VECTOR_CODES = (
    f"WITH k AS MATERIALIZED ({_KEPT}),\n"
    "parts AS MATERIALIZED (SELECT r, p, v[p * len(v) // 4 + 1 : (p + 1) * len(v) // 4] AS x FROM k, range(4) t(p)),\n"
    "b0 AS (SELECT p, r - 1 AS e, x FROM parts WHERE r <= 256),\n"
    + "\n".join(_ROUND.replace("{from}", str(k)).replace("{to}", str(k + 1)) for k in range(5))
    + """
o AS (SELECT r, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a5 GROUP BY r),
s AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b4)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM k JOIN o USING (r), s"""
)

ORACLES = {"op2_minhash_near_dedup": NEAR_DUPLICATES, "op4_quality_rules": QUALITY_RULES, "op13_vector_codes": VECTOR_CODES}
