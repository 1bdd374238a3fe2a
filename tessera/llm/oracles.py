"""SQL for DuckDB that computes, plainly and on whole tables, what operators compute at scale."""

SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
     block AS (SELECT doc_id, k, substr(h, 2048 * k + 1, 2146) AS b FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2048 + 1)) AS k FROM d)),
     w AS (SELECT doc_id, 1024 * k + p AS p, substr(b, 2 * p + 1, 100) AS s FROM (SELECT doc_id, k, b, unnest(range(0, least(1024, length(b) // 2 - 49))) AS p FROM block)),
     low AS (SELECT s, min(doc_id) AS low FROM w GROUP BY s HAVING min(doc_id) <> max(doc_id)),
     hit AS (SELECT w.doc_id, p FROM w JOIN low USING (s) WHERE low < w.doc_id),
     new AS (SELECT *, CASE WHEN lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 >= p THEN 0 ELSE 1 END AS n FROM hit),
     run AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM new),
     span AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM run GROUP BY doc_id, k),
     gap AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM span),
     cut AS (SELECT doc_id, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS head, max(b) AS last, sum(b - a) AS removed, count(*) AS spans FROM gap JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)"""

JACCARD_JOIN = r"""
WITH RECURSIVE t AS (SELECT coalesce(text, '') AS text, min(doc_id) AS node, count(*) AS copies FROM documents GROUP BY 1),
     w AS (SELECT node, copies, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM t),
     g AS (SELECT DISTINCT node, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
           ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
     size AS (SELECT node, count(*) AS n FROM g GROUP BY node),
     pair AS (SELECT a.node AS a, b.node AS b, count(*) AS shared FROM g a JOIN g b ON a.g = b.g AND a.node < b.node GROUP BY 1, 2),
     near AS (SELECT a, b FROM pair JOIN size x ON x.node = a JOIN size y ON y.node = b WHERE shared >= 0.8 * (x.n + y.n - shared) - 1e-9),
     edge AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
     reach(node, to_) AS (SELECT node, node FROM t UNION SELECT reach.node, edge.b FROM reach JOIN edge ON reach.to_ = edge.a),
     class AS (SELECT node, min(to_) AS class_id FROM reach GROUP BY node),
     link AS (SELECT a AS node, sum(copies) AS n FROM edge JOIN t ON t.node = b GROUP BY a)
SELECT doc_id, class_id, t.node AS copy_id, copies AS n_copies, CAST(copies - 1 + coalesce(link.n, 0) AS BIGINT) AS n_links
FROM documents d JOIN t ON coalesce(d.text, '') = t.text JOIN class USING (node) LEFT JOIN link USING (node)"""

NEAREST_NEIGHBOURS = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
     u AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM v WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(c.v, q.v) / (q.n * c.n) AS score
           FROM u q JOIN u c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0 AND q.n > 0 AND c.n > 0),
     r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5"""


def _centroid_clustering(k: int = 16, rounds: int = 3) -> str:
    """Every round compares all vectors with all centroids."""
    steps = [f"""
WITH v AS (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, v) - 1 AS c, v FROM v QUALIFY c < {k})"""]
    for i in range(rounds + 1):
        steps.append(f"""
     a{i} AS (SELECT n, vec_id, v, c, d FROM (
               SELECT n, vec_id, v.v, c, list_sum(list_transform(range(1, 65), lambda i: (v.v[i] - m.v[i]) * (v.v[i] - m.v[i]))) AS d FROM v, c{i} m)
             QUALIFY row_number() OVER (PARTITION BY n ORDER BY d, c) = 1)""")
        if i < rounds:
            steps.append(f"""
     m{i} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(64)) AS i FROM a{i}) GROUP BY c, i),
     c{i + 1} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM m{i} GROUP BY c
             UNION ALL SELECT c, v FROM c{i} WHERE c NOT IN (SELECT c FROM m{i}))""")
    return ",".join(steps) + f"""
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} m USING (c)"""


CENTROID_CLUSTERING = _centroid_clustering()
