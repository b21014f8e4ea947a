"""The isolation forest in DuckDB SQL, for the oracles of M3, M4, M7, M9 and M10.

Written from the definition: sampling, splits and walks are one CTE per depth."""

from __future__ import annotations

TREES, SAMPLES, SEED, SHARE, DEEPEST = 100, 256, 42, 0.05, 8


def _c(n: str) -> str:
    return (f"CASE WHEN {n} <= 1 THEN 0.0 WHEN {n} = 2 THEN 1.0 "
            f"ELSE 2.0 * (ln({n} - 1) + 0.5772156649) - 2.0 * ({n} - 1) / {n} END")


def forest(name: str, source: str) -> str:
    """CTEs ``{name}_nodes`` and ``{name}_scores`` (id, score) from the relation
    ``source`` (id VARCHAR, x DOUBLE[])."""
    out = [f"""
{name}_in AS MATERIALIZED (SELECT id, x FROM {source}),
{name}_m AS MATERIALIZED (SELECT least({SAMPLES}, count(*)) AS m, ceil(log2(greatest(2, least({SAMPLES}, count(*))))) AS deep FROM {name}_in),
{name}_pool AS MATERIALIZED (SELECT * FROM {name}_in ORDER BY md5(id), id LIMIT {TREES * SAMPLES}),
{name}_long AS MATERIALIZED (SELECT id, unnest(generate_series(0, len(x) - 1)) AS f, unnest(x) AS v FROM {name}_pool),
{name}_a0 AS MATERIALIZED (
  SELECT tree, 1 AS node, id FROM (
    SELECT t.tree, p.id, row_number() OVER (PARTITION BY t.tree ORDER BY md5(p.id || ':' || t.tree), p.id) AS rn
    FROM {name}_pool p, (SELECT unnest(generate_series(0, {TREES - 1})) AS tree) t)
  WHERE rn <= (SELECT m FROM {name}_m))"""]
    for d in range(DEEPEST + 1):
        out.append(f"""
{name}_p{d} AS MATERIALIZED (
  SELECT tree, node, f, lo + ('0x' || substr(h, 1, 13))::BIGINT / 4503599627370496.0::DOUBLE * (hi - lo) AS thr, lo
  FROM (SELECT *, row_number() OVER (PARTITION BY tree, node ORDER BY f) - 1 AS k,
               count(*) OVER (PARTITION BY tree, node) AS usable,
               md5('{SEED}:' || tree || ':' || node) AS h
        FROM (SELECT tree, node, f, min(v) AS lo, max(v) AS hi FROM {name}_a{d} JOIN {name}_long USING (id)
              GROUP BY ALL HAVING max(v) > min(v)))
  WHERE k = ('0x' || substr(h, 14, 8))::BIGINT % usable AND {d} < (SELECT deep FROM {name}_m)),
{name}_n{d} AS MATERIALIZED (
  SELECT c.tree, c.node, coalesce(p.f, -1) AS feature, coalesce(p.thr, 0.0) AS threshold,
         CASE WHEN p.f IS NULL THEN -1 ELSE 2 * c.node END AS "left",
         CASE WHEN p.f IS NULL THEN -1 ELSE 2 * c.node + 1 END AS "right", {d} AS depth, c.size
  FROM (SELECT tree, node, count(*) AS size FROM {name}_a{d} GROUP BY ALL) c
  LEFT JOIN {name}_p{d} p ON p.tree = c.tree AND p.node = c.node AND p.thr > p.lo),
{name}_a{d + 1} AS MATERIALIZED (
  SELECT a.tree, 2 * a.node + (l.v >= n.threshold)::INT AS node, a.id
  FROM {name}_a{d} a JOIN {name}_n{d} n ON n.tree = a.tree AND n.node = a.node AND n.feature >= 0
  JOIN {name}_long l ON l.id = a.id AND l.f = n.feature)""")
    out.append(f"""
{name}_nodes AS MATERIALIZED (""" + " UNION ALL ".join(f"SELECT * FROM {name}_n{d}" for d in range(DEEPEST + 1)) + f"""),
{name}_w0 AS (SELECT id, x, tree, 1 AS node FROM {name}_in, (SELECT unnest(generate_series(0, {TREES - 1})) AS tree))""")
    for d in range(DEEPEST):
        out.append(f"""
{name}_w{d + 1} AS (
  SELECT w.id, w.x, w.tree, CASE WHEN n.feature < 0 THEN w.node WHEN w.x[n.feature + 1] < n.threshold THEN n."left" ELSE n."right" END AS node
  FROM {name}_w{d} w JOIN {name}_nodes n ON n.tree = w.tree AND n.node = w.node)""")
    out.append(f"""
{name}_raw AS MATERIALIZED (
  SELECT w.id, -power(2.0, -avg(n.depth + {_c("n.size")}) / any_value({_c("m")})) AS raw
  FROM {name}_w{DEEPEST} w JOIN {name}_nodes n ON n.tree = w.tree AND n.node = w.node, {name}_m GROUP BY w.id),
{name}_scores AS MATERIALIZED (
  SELECT id, least(1.0, greatest(0.0, 0.5 - (raw - (SELECT quantile_cont(raw, {SHARE}) FROM {name}_raw)))) AS score FROM {name}_raw)""")
    return ",".join(out)
