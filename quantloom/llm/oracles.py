"""SQL (DuckDB) of the queries that SQL can express."""

from quantloom.llm import centroids as c
from quantloom.llm import mixing as m
from quantloom.llm import quality_rules as q

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = f"""WITH d AS (SELECT row_number() OVER () AS rid, coalesce(doc_id, -9223372036854775808) AS k, doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT rid, k, i, array_to_string(w[i:i + 19], ' ') AS g FROM (SELECT rid, k, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
firsts AS (SELECT g, min((k, i)) AS f FROM win GROUP BY g),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 20)) AS p FROM win JOIN firsts USING (g) WHERE f < (k, i)),
word AS (SELECT rid, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
kept AS (SELECT rid, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (rid, p) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)"""


def _fails(level: int) -> str:
    low, high = q.MEAN_WORD_CHARS[level]
    return f"(n_symbols * 100 > n_words * {q.MAX_SYMBOLS_PER_100_WORDS[level]} OR n_dup_lines * 100 > n_lines * {q.MAX_DUP_LINE_PERCENT[level]} OR word_chars < n_words * {low} OR word_chars > n_words * {high})"


OP2 = rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
tri AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS c FROM tri) WHERE c > 1) GROUP BY rid),
line AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup FROM (SELECT rid, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY rid),
f AS (SELECT doc_id, host, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
 coalesce(n_dup, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(rep.n, 0) AS n_repeat_words FROM d LEFT JOIN rep USING (rid) LEFT JOIN line USING (rid)),
b AS (SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words AS base_failed, {_fails(0)} AS lenient, {_fails(1)} AS strict FROM f),
h AS (SELECT host, count(*) AS n, CAST(sum(CASE WHEN base_failed OR strict THEN 1 ELSE 0 END) AS DOUBLE) AS failed FROM b GROUP BY host),
p AS (SELECT CAST(sum(n) AS DOUBLE) AS docs, count(*) - 1 AS alike, sum(failed) AS f, sum(failed) / CAST(sum(n) AS DOUBLE) AS m, sum(failed * failed / n) AS ff, CAST(sum(n * n) AS DOUBLE) AS nn FROM h),
x AS (SELECT m, CASE WHEN m > 0 AND m < 1 THEN (ff - f * f / docs) / (m * (1 - m)) - alike END AS spread, docs - nn / docs - alike AS room FROM p),
s AS (SELECT m, least(1000.0, greatest(1.0, coalesce(CASE WHEN room > 1e-6 AND spread > 1e-6 THEN 1 / least(1.0, spread / room) - 1 END, 1000.0))) AS s FROM x),
r AS (SELECT host, round((failed + m * s) / (n + s), 9) AS host_rate FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT lenient AND NOT (host_rate > {q.HOST_FAIL_RATE} AND strict) AS kept, host_rate FROM b JOIN r ON b.host IS NOT DISTINCT FROM r.host"""

OP5 = r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 3], ' ') END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a, b FROM edge UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, least(d.doc_id, coalesce(m, d.doc_id)) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) r ON r.a = d.doc_id"""

OP3 = rf"""WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(list_extract([{', '.join(map(str, m.WEIGHTS))}], 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(m.WEIGHTS)}) AS DOUBLE) AS w FROM d GROUP BY source),
c AS (SELECT *, CAST({m.MAX_EPOCHS} * source_size AS DOUBLE) AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
t AS (SELECT source, source_size, least(cap, w * (SELECT max(level) FROM l WHERE level <= cap / w)) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), {m.MAX_EPOCHS}) ELSE 0 END AS whole FROM t),
r AS (SELECT *, least(CAST(round(target) AS BIGINT) - whole * source_size, source_size * ({m.MAX_EPOCHS} - whole)) AS rest FROM e),
o AS (SELECT d.*, r.*, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5(concat_ws(':', '7', CAST(doc_id AS VARCHAR), CAST(size AS VARCHAR))), doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, rest - start)) AS BIGINT) AS taken FROM o"""


def _round(k: int) -> str:
    """CTEs of one round: the nearest centroid of every vector, the sums of its components, and the centroids moved."""
    return f"""
a{k} AS MATERIALIZED (SELECT rid, min((xx - 2 * list_inner_product(x, m) + mm, c)) AS b FROM v, c{k} GROUP BY rid),
t{k} AS (SELECT c, i, CAST(sum(z) AS HUGEINT) AS s, count(*) AS n FROM (SELECT b[2] AS c, unnest(x) AS z, unnest(range({c.SIZE})) AS i FROM a{k} JOIN v USING (rid)) GROUP BY c, i),
g{k} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY i) AS moved FROM t{k} GROUP BY c),
c{k + 1} AS MATERIALIZED (SELECT c, m, list_inner_product(m, m) AS mm FROM (SELECT c{k}.c, coalesce(moved, m) AS m FROM c{k} LEFT JOIN g{k} USING (c))),"""


OP12 = rf"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, x, list_inner_product(x, x) AS xx FROM (SELECT vec_id, [floor({c.SCALE} * CAST(e AS DOUBLE)) for e in embedding] AS x FROM embeddings
 WHERE len(embedding) = {c.SIZE} AND len(list_filter(embedding, lambda e: isfinite(e))) = {c.SIZE})),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{c.SEED}:' || vec_id) NULLS LAST, x) - 1 AS c, x AS m, xx AS mm FROM v QUALIFY c < {c.CLUSTERS}),{"".join(_round(k) for k in range(c.ROUNDS))}
f AS (SELECT vec_id, b[2] AS c, CAST(b[1] AS BIGINT) AS distance FROM (SELECT rid, min((xx - 2 * list_inner_product(x, m) + mm, c)) AS b FROM v, c{c.ROUNDS} GROUP BY rid) JOIN v USING (rid)),
h AS (SELECT c, sha256(array_to_string([CAST(y AS BIGINT) for y in m], ',')) AS centroid_sha256 FROM c{c.ROUNDS})
SELECT vec_id, CAST(c AS INT) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM f JOIN h USING (c)"""
