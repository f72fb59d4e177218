"""DuckDB SQL of the operators on embeddings: plain nearest-centre search over whole tables, a step for each round."""

from __future__ import annotations

_FINITE = "len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_DISTANCE = "list_sum(list_transform(list_zip(r.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
_FLOOR = "((s - ((s % n) + n) % n) // n)::BIGINT"


def _round(i: int, part: str, width: int) -> str:
    """Assignment ``a{i}`` to the centres ``c{i - 1}`` and the centres ``c{i}`` after it; ``part`` names the key of a codebook."""
    return f"""
    a{i} AS MATERIALIZED (SELECT r.rid, r.{part}, arg_min(c.k, {_DISTANCE} * 256 + c.k) AS k, min({_DISTANCE}) AS d FROM rows_ r JOIN c{i - 1} c USING ({part}) GROUP BY r.rid, r.{part}),
    c{i} AS MATERIALIZED (
        SELECT c.{part}, c.k, coalesce(m.v, c.v) AS v FROM c{i - 1} c LEFT JOIN (
            SELECT {part}, k, list({_FLOOR} ORDER BY j) AS v FROM (
                SELECT a.{part}, a.k, j, sum(r.v[j]) AS s, count(*) AS n FROM a{i} a JOIN rows_ r USING (rid, {part}), range(1, {width + 1}) t(j) GROUP BY ALL)
            GROUP BY {part}, k) m ON m.{part} = c.{part} AND m.k = c.k),"""


CODE_SQL = f"""
    WITH kept AS MATERIALIZED (
        SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS rid, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v
        FROM embeddings WHERE {_FINITE}),
    rows_ AS MATERIALIZED (SELECT rid, p, v[p * 8 + 1:p * 8 + 8] AS v FROM kept, range(0, 8) t(p)),
    c0 AS MATERIALIZED (SELECT p, rid - 1 AS k, v FROM rows_ WHERE rid <= 16),{"".join(_round(i, "p", 8) for i in range(1, 8))}
    books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM c6),
    coded AS (SELECT rid, string_agg(format('{{:02x}}', k), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a7 GROUP BY rid)
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (rid), books"""

CENTROID_SQL = f"""
    WITH rows_ AS MATERIALIZED (
        SELECT vec_id AS rid, 0 AS p, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND {_FINITE}),
    c0 AS MATERIALIZED (SELECT p, row_number() OVER (ORDER BY sha256('1:' || rid)) - 1 AS k, v FROM rows_ QUALIFY k < 16),{"".join(_round(i, "p", 64) for i in range(1, 5))}
    named AS (SELECT k, sha256(array_to_string(v, ',')) AS centroid_sha256 FROM c3)
    SELECT rid AS vec_id, k::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
    FROM a4 JOIN named USING (k)"""
