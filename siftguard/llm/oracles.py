"""SQL counterparts of the queries that SQL can express: the contracts stated plainly, without the methods."""

from __future__ import annotations

from siftguard.llm import mixing

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_ALPHANUMERIC = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_SPACED}) AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS shingle FROM w, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY 1),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y USING (shingle) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 75 * (na.size + nb.size - common)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b)
SELECT w.doc_id, coalesce(n.size, 0) AS n_shingles, m.low AS component_id, w.doc_id = m.low AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY 1) m USING (doc_id)
"""

DECONTAMINATION = f"""
WITH b AS (SELECT item_id, regexp_extract_all({_LOWER}, {_ALPHANUMERIC}) AS ws FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(10, len(ws)) AS size, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS words
        FROM b, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) t(i) WHERE len(ws) > 0),
d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ALPHANUMERIC}) AS ws FROM documents),
cut AS (SELECT doc_id, i, size, array_to_string(ws[i:i + size - 1], ' ') AS words
        FROM d, (SELECT DISTINCT size FROM win) z, unnest(range(1, len(ws) - size + 2)) t(i)),
hit AS (SELECT doc_id, i, size, item_id FROM cut JOIN win USING (size, words)),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM hit, unnest(range(size)) t(j) GROUP BY 1),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM hit GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

TOP_K = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.r <> c.r AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

SUBSTRINGS = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS code FROM w, unnest(range(1, len(ws) - 33)) t(i)),
again AS (SELECT code FROM win GROUP BY 1 HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM win SEMI JOIN again USING (code), unnest(range(35)) t(j)),
kept AS (SELECT doc_id, string_agg(ws[i], ' ' ORDER BY i) AS words FROM (SELECT doc_id, i, ws FROM w, unnest(range(1, len(ws) + 1)) t(i)) ANTI JOIN gone USING (doc_id, i) GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

#: Equal five-word hashes q words apart, joined to stretches; the crc32 of the id is computed byte by byte.
PERIODIC_RUNS = f"""
WITH tab AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
               lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS ws,
        xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
            lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM documents, tab),
a AS (SELECT *, len(ws) AS n, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM w),
p AS (SELECT r, doc_id, n, CASE WHEN a IS NULL THEN ws ELSE list_transform(range(n), lambda i: CASE WHEN i < a THEN ws[i + 1]
        ELSE ws[a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) + 1] END) END AS ws FROM a),
g AS (SELECT r, n, i, md5(array_to_string(ws[i + 1:i + 5], ' ')) AS g FROM p, unnest(range(n - 4)) t(i)),
e AS (SELECT x.r, x.i, y.i - x.i AS q FROM g x JOIN g y ON x.r = y.r AND x.g = y.g AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
s AS (SELECT r, q, min(i) AS start, count(*) + 4 + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM e) GROUP BY r, q, island),
runs AS (SELECT r, start, length, min(q) AS period FROM s GROUP BY r, start, length HAVING length >= greatest(6, 4 * min(q))),
best AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY length::DOUBLE / period DESC, start, period) AS nth FROM runs),
listed AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS shown FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, i FROM runs, unnest(range(start + period, start + length)) t(i)),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS words FROM (SELECT r, i, ws[i + 1] AS word FROM p, unnest(range(n)) t(i)) ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start, best.length, best.period, 1000 * best.length // best.period AS exponent_milli,
       sha256(coalesce(shown, '')) AS runs_sha256, sha256(coalesce(words, '')) AS collapsed_sha256
FROM p LEFT JOIN listed USING (r) LEFT JOIN kept USING (r) LEFT JOIN best ON best.r = p.r AND best.nth = 1
"""

ORACLES = {
    "op2_minhash_near_dedup": NEAR_DUPLICATES,
    "op3_mixing_sources_to_target_weights": mixing.ORACLE,
    "op6_benchmark_decontamination": DECONTAMINATION,
    "op7_exact_top_k": TOP_K,
    "op8_substring_dedup": SUBSTRINGS,
    "op11_periodic_run_detection": PERIODIC_RUNS,
}
