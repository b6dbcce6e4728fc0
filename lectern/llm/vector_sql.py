"""DuckDB SQL for product codes and for nearest neighbours, by comparing all pairs."""

from __future__ import annotations

_FINITE = "list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))"


def codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""d{k} AS MATERIALIZED (SELECT p.vec_id, p.part, min(CAST(p.sq + c.sq - 2 * list_inner_product(p.z, c.z) AS BIGINT) * 256 + c.idx) AS best
            FROM p JOIN (SELECT *, list_inner_product(z, z) AS sq FROM c{k}) c USING (part) GROUP BY ALL)""")
        if k < rounds:
            steps.append(f"""s{k} AS (SELECT part, idx, pos, sum(x) AS s, count(*) AS n FROM (SELECT part, best % 256 AS idx, unnest(z) AS x, unnest(range(len(z))) AS pos FROM p JOIN d{k} USING (vec_id, part)) GROUP BY ALL),
            m{k} AS (SELECT part, idx, list(CAST((CAST(s AS BIGINT) - (CAST(s AS BIGINT) % n + n) % n) // n AS DOUBLE) ORDER BY pos) AS z FROM s{k} GROUP BY ALL),
            c{k + 1} AS MATERIALIZED (SELECT part, c.idx, coalesce(m.z, c.z) AS z FROM c{k} c LEFT JOIN m{k} m USING (part, idx))""")
    return f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS z FROM embeddings WHERE embedding IS NOT NULL AND {_FINITE}),
     q AS (SELECT vec_id, label, unnest(range({parts})) AS part, len(z) // {parts} AS wide, z FROM v),
     p AS MATERIALIZED (SELECT vec_id, label, part, z, list_inner_product(z, z) AS sq FROM (SELECT vec_id, label, part, z[part * wide + 1 : (part + 1) * wide] AS z FROM q)),
     c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS idx, z FROM p QUALIFY idx < {entries}),
     {", ".join(steps)},
     codes AS (SELECT vec_id, string_agg(lower(right('0' || to_hex(best % 256), 2)), '' ORDER BY part) AS code, CAST(sum(best // 256) AS BIGINT) AS error FROM d{rounds} GROUP BY vec_id),
     digest AS (SELECT sha256(string_agg(t, ',' ORDER BY part, idx)) AS h FROM (SELECT part, idx, array_to_string(list_transform(z, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',') AS t FROM c{rounds}))
SELECT v.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM v JOIN codes USING (vec_id), digest"""


def neighbours_sql(every: int = 100, k: int = 10) -> str:
    return f"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND {_FINITE} AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
     d AS (SELECT q.vec_id AS query_id, v.vec_id, list_distance(q.e, v.e) AS score FROM v q JOIN v ON q.vec_id % {every} = 0 AND q.vec_id <> v.vec_id AND len(q.e) = len(v.e))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score FROM d QUALIFY rank <= {k}"""
