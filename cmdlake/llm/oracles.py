"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from cmdlake.llm import centroids, spelling


def centroids_sql(k: int = centroids.K, rounds: int = centroids.ROUNDS, dim: int = centroids.DIM) -> str:
    """Every round as a table of centroids and one of assignments; distances of whole numbers are exact in doubles."""
    product = lambda a, b: f"list_inner_product({a}::DOUBLE[], {b}::DOUBLE[])"
    near = f"CAST({product('v', 'v')} - 2 * {product('v', 'c')} + {product('c', 'c')} AS BIGINT)"
    tables = [
        f"k AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({centroids.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: isfinite(x))) = {dim})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS j, v AS c FROM (SELECT v, sha256('2:' || vec_id) AS h FROM k ORDER BY h LIMIT {k}))",
    ]
    for r in range(rounds + 1):
        tables.append(f"a{r} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, arg_min(j, d * 64 + j) AS j, min(d) AS d FROM (SELECT vec_id, v, j, {near} AS d FROM k CROSS JOIN c{r}) GROUP BY vec_id)")
        if r < rounds:
            mean = f"SELECT j, list(m ORDER BY i) AS c FROM (SELECT j, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS m FROM (SELECT j, unnest(v) AS x, unnest(range(1, {dim + 1})) AS i FROM a{r}) GROUP BY j, i) GROUP BY j"
            tables.append(f"c{r + 1} AS MATERIALIZED (SELECT o.j, coalesce(m.c, o.c) AS c FROM c{r} o LEFT JOIN ({mean}) m ON m.j = o.j)")
    return (
        "WITH " + ", ".join(tables) + " SELECT vec_id, CAST(j AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, "
        f"sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (j)"
    )


def spelling_sql() -> str:
    """The checksum by its table of 256 remainders, near words by leaving out one letter of either or both, roots by recursion."""
    step = "CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END"
    table = f"list_transform(range(0, 256), lambda i: list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, b: {step}))"
    octets = "list_transform(range(0, len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))"
    return (
        f"WITH RECURSIVE t AS MATERIALIZED (SELECT {table} AS tab), "
        f"r AS (SELECT doc_id, translate(run, '{spelling.UPPER}', '{spelling.LOWER}') AS run, count(*) AS m FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{spelling.RUN}')) AS run FROM documents) GROUP BY 1, 2), "
        "b AS (SELECT run, m, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS h FROM r), "
        f"c AS (SELECT run, m, xor(list_reduce(list_concat([4294967295], {octets}), lambda a, b: xor(a >> 8, tab[1 + (xor(a, b) & 255)])), 4294967295) AS crc FROM b, t), "
        f"w AS (SELECT CASE WHEN crc % {spelling.EVERY} = 0 THEN substr(run, 1, CAST(crc % length(run) AS INT)) || substr(run, CAST(crc % length(run) AS INT) + 2) ELSE run END AS word, m FROM c), "
        f"v AS MATERIALIZED (SELECT word, CAST(sum(m) AS BIGINT) AS n FROM w WHERE length(word) >= {spelling.SHORTEST} GROUP BY 1 HAVING sum(m) >= {spelling.RAREST}), "
        "q AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)), "
        "p AS (SELECT a.word, b.word AS near, b.n AS m FROM q a JOIN q b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word "
        "UNION SELECT q.word, v.word, v.n FROM q JOIN v ON v.word = q.cut UNION SELECT v.word, q.word, q.n FROM q JOIN v ON v.word = q.cut), "
        "s AS (SELECT word, count(*) AS n_near, max(m) AS m, arg_min(near, (-m, near)) AS near FROM p GROUP BY 1), "
        f"f AS MATERIALIZED (SELECT v.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {spelling.RATIO} * n THEN near END AS form, CASE WHEN m >= {spelling.RATIO} * n THEN m END AS form_n FROM v LEFT JOIN s USING (word)), "
        "z(word, tip) AS (SELECT word, form FROM f WHERE form IS NOT NULL UNION ALL SELECT z.word, f.form FROM z JOIN f ON f.word = z.tip WHERE f.form IS NOT NULL), "
        "o AS (SELECT z.word, z.tip AS root FROM z JOIN f ON f.word = z.tip WHERE f.form IS NULL) "
        "SELECT f.word, n, n_near, form, form_n, coalesce(root, f.word) AS root FROM f LEFT JOIN o USING (word)"
    )


ORACLE = {"op11_centroids": centroids_sql(), "op13_spelling": spelling_sql()}
