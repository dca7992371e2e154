"""SQL that gives the same rows as the registered queries, over the same tables."""

from __future__ import annotations

from cohortgraph.plans.fixture import FX

_GRID = """grid AS (SELECT subject, node FROM (SELECT DISTINCT subject FROM edges), nodes),
deg AS MATERIALIZED (SELECT g.subject, g.node, count(s.j) AS degree, coalesce(sum(s.w), 0)::DOUBLE AS strength FROM grid g LEFT JOIN sym s ON g.subject = s.subject AND g.node = s.i GROUP BY ALL),
tri AS MATERIALIZED (SELECT x.subject, x.i AS a, x.j AS b, y.j AS c, cbrt(x.w) * cbrt(y.w) * cbrt(z.w) AS t FROM edges x JOIN edges y ON x.subject = y.subject AND x.j = y.i
  JOIN edges z ON z.subject = x.subject AND z.i = x.i AND z.j = y.j),
tn AS (SELECT subject, node, sum(t) AS t FROM (SELECT subject, unnest([a, b, c]) AS node, t FROM tri) GROUP BY ALL),
clus AS MATERIALIZED (SELECT d.subject, d.node, coalesce(2 * t / nullif(degree * (degree - 1), 0), 0)::DOUBLE AS clustering FROM deg d LEFT JOIN tn USING (subject, node)),
co AS (SELECT subject, cohort, age, gender, duration FROM subjects)"""
_EV = """ev AS MATERIALIZED (SELECT s.subject, k.i, k.j, s.cohort, coalesce(e.w, 0)::DOUBLE AS value FROM (SELECT DISTINCT i, j FROM edges) k CROSS JOIN subjects s
  LEFT JOIN edges e ON e.subject = s.subject AND e.i = k.i AND e.j = k.j)"""


def _moments(rows: str, keys: str) -> str:
    return f"""SELECT {keys}, count(*) FILTER (cohort = 'patient') AS na, avg(value) FILTER (cohort = 'patient') AS ma, var_samp(value) FILTER (cohort = 'patient') AS va,
      count(*) FILTER (cohort = 'control') AS nb, avg(value) FILTER (cohort = 'control') AS mb, var_samp(value) FILTER (cohort = 'control') AS vb FROM {rows} GROUP BY {keys}"""


def _welch(rows: str, keys: str) -> str:
    return f"""SELECT {keys}, (ma - mb) / nullif(sqrt(va / na + vb / nb), 0) AS t,
      pow(va / na + vb / nb, 2) / nullif(pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1), 0) AS df FROM ({_moments(rows, keys)}) WHERE na > 1 AND nb > 1"""


def _rows(measure: str) -> str:
    table = "clus" if measure == "clustering" else "deg"
    return f"(SELECT subject, node, cohort, {measure}::DOUBLE AS value FROM {table} JOIN co USING (subject))"


def _q(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join((FX, *parts[:-1])) + "\n" + parts[-1]


_PERM = """perms AS MATERIALIZED (SELECT perm, subject, CASE WHEN row_number() OVER (PARTITION BY perm ORDER BY md5(perm || '|' || subject), subject) <= (SELECT count(*) FROM subjects WHERE cohort = 'patient')
  THEN 'patient' ELSE 'control' END AS cohort FROM (SELECT CAST(unnest(range(1, 21)) AS INT) AS perm) CROSS JOIN (SELECT subject FROM subjects))"""
_SV = "sv AS MATERIALIZED (SELECT subject, node, strength AS value FROM deg)"
_NULL = f"null_max AS MATERIALIZED (SELECT perm, max(t) AS stat FROM ({_welch('(SELECT perm, subject, node, cohort, value FROM sv JOIN perms USING (subject))', 'perm, node')}) GROUP BY perm)"
#: Both triangles with the strengths of both ends, and the whole weight of the graph's matrix.
_SYMS = "ss AS MATERIALIZED (SELECT subject, i, j, w, sum(w) OVER (PARTITION BY subject, i)::DOUBLE AS si, sum(w) OVER (PARTITION BY subject, j)::DOUBLE AS sj, sum(w) OVER (PARTITION BY subject)::DOUBLE AS whole FROM sym)"
_WEDGE = f"we AS MATERIALIZED ({_welch('ev', 'i, j')})"
_PRES = "pr AS (SELECT i, j, (SELECT count(*) FROM subjects) AS n, (SELECT count(*) FROM subjects) - count(*) AS zero FROM edges GROUP BY i, j)"


def _min_plus(edges: str, weight: str, rounds: int = 5) -> list[str]:
    parts = [f"d0 AS MATERIALIZED (SELECT subject, i, j, {weight} AS d FROM (SELECT * FROM sym WHERE {edges}))"]
    for r in range(1, rounds + 1):
        p = f"d{r - 1}"
        parts.append(f"d{r} AS MATERIALIZED (SELECT subject, i, j, min(d) AS d FROM (SELECT * FROM {p} UNION ALL SELECT a.subject, a.i, b.j, a.d + b.d FROM {p} a JOIN {p} b ON a.subject = b.subject AND a.j = b.i AND a.i <> b.j) GROUP BY subject, i, j)")
    return parts


_W, _U = _min_plus("true", "1.0::DOUBLE / w"), _min_plus("w > 2", "1")
_RESID2 = """m AS (SELECT *, avg(age) OVER k AS ma, avg(gender) OVER k AS mg, avg(value) OVER k AS mv, covar_pop(age, age) OVER k AS xx, covar_pop(age, gender) OVER k AS xz, covar_pop(gender, gender) OVER k AS zz,
  covar_pop(age, value) OVER k AS xy, covar_pop(gender, value) OVER k AS zy FROM src WINDOW k AS (PARTITION BY {keys})),
b AS (SELECT *, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS b1, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS b2 FROM m)"""
_SRC = "src AS MATERIALIZED (SELECT subject, node, strength AS value, age, gender, duration FROM deg JOIN co USING (subject))"
_LABEL = """comp AS MATERIALIZED (SELECT subject, i, min(least(i, r)) AS component FROM reach GROUP BY subject, i)"""
_G4 = """g4 AS MATERIALIZED (SELECT subject, i, j FROM sym WHERE w > 4),
reach(subject, i, r) AS (SELECT subject, i, j FROM g4 UNION SELECT reach.subject, reach.i, g4.j FROM reach JOIN g4 ON g4.subject = reach.subject AND g4.i = reach.r)"""
_FS = """f AS (SELECT vec_id AS subject, CAST(label % 2 = 0 AS INT) AS label, unnest(range(64))::INT AS feature, unnest(embedding)::DOUBLE AS value FROM embeddings),
fs AS (SELECT feature, (n1 * pow(m1 - m, 2) + n0 * pow(m0 - m, 2)) / nullif(n1 * v1 + n0 * v0, 0) AS score FROM (SELECT feature, avg(value) AS m, count(*) FILTER (label = 1) AS n1, count(*) FILTER (label = 0) AS n0,
  avg(value) FILTER (label = 1) AS m1, avg(value) FILTER (label = 0) AS m0, var_pop(value) FILTER (label = 1) AS v1, var_pop(value) FILTER (label = 0) AS v0 FROM f GROUP BY feature))"""
# Two-sided normal tail of the rank-sum test; the error function by its series, good to 1e-10 for the z that occur.
_PL = """rk AS (SELECT i, j, cohort, rank() OVER (PARTITION BY i, j ORDER BY value) + (count(*) OVER (PARTITION BY i, j, value) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY i, j, value) AS t FROM ev),
mw AS (SELECT i, j, (count(*) FILTER (cohort = 'patient'))::DOUBLE AS na, (count(*) FILTER (cohort = 'control'))::DOUBLE AS nb, sum(r) FILTER (cohort = 'patient') AS ra, sum(t * t - 1)::DOUBLE AS ties FROM rk GROUP BY i, j),
mu AS (SELECT *, ra - na * (na + 1) / 2 AS u1, na + nb AS n FROM mw),
mz AS (SELECT i, j, coalesce((greatest(u1, na * nb - u1) - na * nb / 2 - 0.5) / nullif(sqrt(na * nb / 12.0 * (n + 1 - ties / (n * (n - 1)))), 0), 0) / sqrt(2) AS x FROM mu),
pl AS MATERIALIZED (SELECT i, j, least(1.0, 1 - 2 / sqrt(pi()) * list_sum([pow(-1, k) * pow(x, 2 * k + 1) / (gamma(k + 1) * (2 * k + 1)) FOR k IN range(0, 80)])) AS p FROM mz)"""
_LG = "lg AS (SELECT i, j, least(greatest(CASE WHEN 1 - p <= 0 THEN -12.0 WHEN 1 - p >= 1 THEN 12.0 ELSE ln((1 - p) / p) END, -12.0), 12.0)::DOUBLE AS d FROM pl)"
_HITS = " UNION ALL ".join(f"SELECT node, '{m}' AS measure, {k} AS place FROM ({_welch(_rows(m), 'node')}) WHERE abs(t) > 1" for k, m in enumerate(("clustering", "degree", "strength")))

ORACLE: dict[str, str] = {
    "cohort_edges": _q("SELECT subject, i, j, w FROM edges"),
    "node_degree": _q(_GRID, "SELECT subject, node, degree FROM deg"),
    "node_strength": _q(_GRID, "SELECT subject, node, round(strength, 6) AS strength FROM deg"),
    "clustering_coefficient": _q(_GRID, "SELECT subject, node, round(clustering, 6) AS clustering FROM clus"),
    "measure_summary_by_cohort": _q(_GRID, "SELECT cohort, node, count(*) AS n, round(avg(clustering), 6) AS mean, round(stddev_pop(clustering), 6) AS std FROM clus JOIN co USING (subject) GROUP BY ALL"),
    "welch_t_by_node": _q(_GRID, f"SELECT node, round(t, 6) AS t, round(df, 6) AS df FROM ({_welch(_rows('clustering'), 'node')})"),
    "cohort_classify": _q("SELECT subject, name, CASE WHEN contains(name, 'lgp') THEN 'patient' ELSE 'control' END AS cohort FROM subjects"),
    "cohort_cap": _q("SELECT subject, name, cohort FROM subjects QUALIFY row_number() OVER (PARTITION BY cohort ORDER BY name) <= 50"),
    "exclude_subjects": _q("SELECT cohort, count(*) AS n FROM subjects WHERE subject % 7 <> 3 GROUP BY cohort"),
    "restrict_subjects": _q("SELECT subject, count(*) AS n FROM edges WHERE subject IN (SELECT subject FROM subjects WHERE cohort = 'patient' AND duration > 10) GROUP BY subject"),
    "match_ids_by_digits": _q("SELECT s.subject, s.name, 'R' || lpad(CAST(c_custkey AS VARCHAR), 5, '0') || '-x' AS other, c_custkey AS k FROM subjects s JOIN customer ON regexp_extract(name, '[0-9]+') = lpad(CAST(c_custkey AS VARCHAR), 5, '0')"),
    "qc_matrices": _q("SELECT s.subject, count(e.i) AS entries, count(e.i) AS off_diagonal, CASE WHEN count(e.i) = 0 THEN 'empty' ELSE 'ok' END AS state FROM subjects s LEFT JOIN (SELECT * FROM edges WHERE subject % 11 <> 5) e ON e.subject = s.subject GROUP BY s.subject"),
    "qc_zero_diagonal": _q("SELECT s.subject, n.node FROM subjects s CROSS JOIN nodes n WHERE NOT EXISTS (SELECT 1 FROM (SELECT subject, b FROM items GROUP BY ALL HAVING count(*) > 2) o WHERE o.subject = s.subject AND o.b = n.node)"),
    "demographics": _q("SELECT cohort, count(*) AS n, count(*) FILTER (gender = 1) AS male, count(*) FILTER (gender = 2) AS female, round(avg(age), 6) AS age_mean, round(stddev_pop(age), 6) AS age_std FROM subjects GROUP BY cohort"),
    "flag_percentages": _q("p AS (SELECT * FROM subjects WHERE cohort = 'patient'), n AS (SELECT count(*) AS n FROM subjects)", "SELECT flag, round(k * 100.0::DOUBLE / n, 6) AS percent FROM (SELECT 'a' AS flag, count(*) FILTER (subject % 2 > 0) AS k FROM p UNION ALL SELECT 'b', count(*) FILTER (subject % 5 = 0) FROM p UNION ALL SELECT 'c', count(*) FILTER (age > 40) FROM p), n"),
    "crosstab_chi2": _q("x AS (SELECT cohort, age // 20 AS band FROM subjects), o AS (SELECT a.cohort, b.band, (SELECT count(*) FROM x WHERE x.cohort = a.cohort AND x.band = b.band) AS observed, (SELECT count(*) FROM x WHERE x.cohort = a.cohort) * (SELECT count(*) FROM x WHERE x.band = b.band) / (SELECT count(*) FROM x)::DOUBLE AS expected FROM (SELECT DISTINCT cohort FROM x) a, (SELECT DISTINCT band FROM x) b)", "SELECT cohort, band, observed, round(expected, 6) AS expected, round(pow(observed - expected, 2) / expected, 6) AS part FROM o"),
    "crosstab_statistic": _q("x AS (SELECT cohort, age // 20 AS band FROM subjects), c AS (SELECT cohort, band, count(*) AS n FROM x GROUP BY ALL), a AS (SELECT cohort, count(*) AS na FROM x GROUP BY ALL), b AS (SELECT band, count(*) AS nb FROM x GROUP BY ALL), o AS (SELECT coalesce(n, 0) AS n, na * nb / (SELECT count(*) FROM x)::DOUBLE AS e FROM a CROSS JOIN b LEFT JOIN c USING (cohort, band))", "SELECT round(sum(pow(n - e, 2) / e), 6) AS chi2, (SELECT (count(DISTINCT cohort) - 1) * (count(DISTINCT band) - 1) FROM x) AS df FROM o"),
    "load_summary": _q("SELECT count(*) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM (SELECT duration / ceil(age / 10.0::DOUBLE) AS x FROM subjects WHERE cohort = 'patient')"),
    "volume_summary": _q("SELECT node, round(avg(v0), 6) AS mean, round(stddev_pop(v0), 6) AS std FROM volumes GROUP BY node"),
    "density_sum": _q("SELECT e.subject, i, j, round(w / (a.v0 + b.v0), 6) AS w FROM edges e JOIN volumes a ON a.subject = e.subject AND a.node = i JOIN volumes b ON b.subject = e.subject AND b.node = j WHERE a.v0 + b.v0 <> 0"),
    "density_mean": _q("SELECT e.subject, i, j, round(2.0::DOUBLE * w / (a.v1 + b.v1), 6) AS w FROM edges e JOIN volumes a ON a.subject = e.subject AND a.node = i JOIN volumes b ON b.subject = e.subject AND b.node = j"),
    "consensus_threshold": _q(_PRES, "SELECT subject, i, j, w FROM edges JOIN pr USING (i, j) WHERE zero < 0.42::DOUBLE * n"),
    "consensus_removed_edges": _q(_PRES, "SELECT subject, i, j, w FROM edges JOIN pr USING (i, j) WHERE zero >= 0.42::DOUBLE * n"),
    "edges_removed_per_subject": _q(_PRES, "SELECT subject, count(*) AS n_removed FROM edges JOIN pr USING (i, j) WHERE zero >= 0.42::DOUBLE * n GROUP BY subject HAVING count(*) > 50"),
    "presence_threshold": _q(_PRES, "SELECT subject, i, j, w FROM edges JOIN pr USING (i, j) WHERE zero::DOUBLE / n <= 1 - 0.55::DOUBLE"),
    "presence_dropped_edges": _q(_PRES, "SELECT i, j FROM pr WHERE zero::DOUBLE / n > 1 - 0.55::DOUBLE"),
    "filter_weights_cumulative": _q("r AS (SELECT *, sum(2 * w) OVER (PARTITION BY subject ORDER BY w DESC, i DESC, j DESC ROWS UNBOUNDED PRECEDING) AS run, sum(2 * w) OVER (PARTITION BY subject) AS total FROM edges)", "SELECT subject, i, j, w FROM r WHERE run <= 0.5 * total"),
    "threshold_edges": _q("SELECT subject, i, j, w FROM edges WHERE w > 3"),
    "isolated_nodes": _q("e3 AS (SELECT * FROM sym WHERE w > 3)", "SELECT s.subject, node FROM (SELECT DISTINCT subject FROM e3) s CROSS JOIN nodes WHERE NOT EXISTS (SELECT 1 FROM e3 WHERE e3.subject = s.subject AND e3.i = node)"),
    "graph_at_least": _q("SELECT subject, i, j, 1.0::DOUBLE AS w FROM edges WHERE w >= 2"),
    "invert_weights": _q("SELECT subject, i, j, round(1.0::DOUBLE / w, 6) AS w FROM edges"),
    "cube_root_weights": _q("SELECT subject, i, j, round(cbrt(w), 6) AS w FROM edges"),
    "log_weights": _q("SELECT subject, i, j, round(ln(w + 1), 6) AS w FROM edges"),
    "symmetrize": _q("SELECT subject, i, j, w FROM sym"),
    "adjacency": _q("SELECT DISTINCT i, j, 1::BIGINT AS w FROM edges WHERE w > 6"),
    "gather_significant_edges": _q(_EV, _WEDGE, "SELECT subject, i, j, w FROM edges JOIN we USING (i, j) WHERE abs(t) > 1.5"),
    "bounded_p_map": _q(_EV, _PL, "SELECT i, j, round(CASE WHEN p <= 0.2 THEN 1 - p ELSE 0 END, 6) AS shown FROM pl"),
    "mann_whitney_p": _q(_EV, _PL, "SELECT i, j, round(p, 6) AS p FROM pl"),
    "masked_statistics": _q(_EV, _WEDGE, "SELECT i, j, round(t, 6) AS t FROM we WHERE abs(t) > 2"),
    "union_regions": _q(_GRID, f"SELECT DISTINCT node FROM ({_HITS})"),
    "shortest_paths_weighted": _q(*_W, "SELECT subject, i, j, round(d, 6) AS d FROM d5"),
    "bfs_distance": _q(*_U, "SELECT subject, i, j, d::BIGINT AS d FROM d5"),
    "global_efficiency": _q(*_W, "SELECT subject, round(sum(1 / d) / 600, 6) AS efficiency FROM d5 GROUP BY subject"),
    "characteristic_path": _q(*_U, "SELECT subject, round(avg(d), 6) AS path_length, max(d)::BIGINT AS diameter FROM d5 GROUP BY subject"),
    "mean_weight": _q("SELECT subject, round(sum(w) * 2 / 625.0::DOUBLE, 6) AS mean_weight FROM edges GROUP BY subject"),
    "global_clustering": _q(_GRID, "SELECT subject, round(sum(clustering) / 25, 6) AS clustering FROM clus GROUP BY subject"),
    "participation_out": _q(_GRID, "k AS (SELECT subject, i AS node, j % 5 AS ci, sum(w)::DOUBLE AS k FROM edges GROUP BY ALL), p AS (SELECT subject, node, 1 - sum(k * k) / pow(sum(k), 2) AS p FROM k GROUP BY ALL)", "SELECT subject, node, round(coalesce(p, 0), 6) AS participation FROM grid LEFT JOIN p USING (subject, node)"),
    "participation_in": _q(_GRID, "k AS (SELECT subject, j AS node, i % 5 AS ci, sum(w)::DOUBLE AS k FROM edges GROUP BY ALL), p AS (SELECT subject, node, 1 - sum(k * k) / pow(sum(k), 2) AS p FROM k GROUP BY ALL)", "SELECT subject, node, round(coalesce(p, 0), 6) AS participation FROM grid LEFT JOIN p USING (subject, node)"),
    "path_length_with_diagonal": _q(*_U, "SELECT subject, round(sum(d) / (count(*) + 25)::DOUBLE, 6) AS path_length FROM d5 GROUP BY subject"),
    "participation_coef": _q(_GRID, "k AS (SELECT subject, i AS node, j % 5 AS ci, sum(w)::DOUBLE AS k FROM sym GROUP BY ALL), p AS (SELECT subject, node, 1 - sum(k * k) / pow(sum(k), 2) AS p FROM k GROUP BY ALL)", "SELECT subject, node, round(coalesce(p, 0), 6) AS participation FROM grid LEFT JOIN p USING (subject, node)"),
    "avg_neighbor_degree": _q(_GRID, "v AS (SELECT s.subject, i AS node, sum(w * degree)::DOUBLE / sum(w) AS v FROM sym s JOIN deg d ON d.subject = s.subject AND d.node = j GROUP BY ALL)", "SELECT subject, node, round(v, 6) AS neighbour_degree FROM grid LEFT JOIN v USING (subject, node)"),
    "module_graph": _q("SELECT subject, CAST(i % 5 AS INT) AS ci, CAST(j % 5 AS INT) AS cj, sum(w)::DOUBLE AS w FROM sym GROUP BY ALL"),
    "modularity_q": _q("r AS (SELECT subject, i % 5 AS ci, sum(w)::DOUBLE AS row, sum(CASE WHEN i % 5 = j % 5 THEN w ELSE 0 END)::DOUBLE AS own FROM sym GROUP BY ALL)", "SELECT subject, round(sum(own) / sum(row) - sum(row * row) / pow(sum(row), 2), 6) AS q FROM r GROUP BY subject"),
    "graph_summary": _q("e1 AS (SELECT * FROM sym WHERE w > 1), dg AS (SELECT s.subject, node, count(e1.j) AS degree FROM (SELECT DISTINCT subject FROM e1) s CROSS JOIN nodes LEFT JOIN e1 ON e1.subject = s.subject AND e1.i = node GROUP BY ALL)", "SELECT subject, count(*) AS n_nodes, (sum(degree) / 2)::BIGINT AS n_edges, max(degree) AS max_degree, min(degree) AS min_degree, round(avg(degree), 6) AS mean_degree, round(quantile_cont(degree::DOUBLE, 0.5), 6) AS median_degree FROM dg GROUP BY subject"),
    "transitivity": _q("e1 AS (SELECT * FROM sym WHERE w > 1), dg AS (SELECT s.subject, node, count(e1.j) AS k FROM (SELECT DISTINCT subject FROM e1) s CROSS JOIN nodes LEFT JOIN e1 ON e1.subject = s.subject AND e1.i = node GROUP BY ALL), t AS (SELECT x.subject, x.i AS node, count(*) / 2 AS t FROM e1 x JOIN e1 y ON y.subject = x.subject AND y.i = x.j JOIN e1 z ON z.subject = x.subject AND z.i = y.j AND z.j = x.i GROUP BY ALL), p AS (SELECT dg.subject, coalesce(t, 0) AS t, k * (k - 1) / 2.0::DOUBLE AS m FROM dg LEFT JOIN t USING (subject, node))", "SELECT subject, round(coalesce(sum(t) / nullif(sum(m), 0), 0), 6) AS transitivity, round(avg(coalesce(t / nullif(m, 0), 0)), 6) AS mean_clustering FROM p GROUP BY subject"),
    "degree_histogram": _q(_GRID, "SELECT subject, degree, count(*) AS n FROM deg GROUP BY ALL"),
    "glm_residual_2cov": _q(_GRID, _SRC, _RESID2.format(keys="node"), "SELECT subject, node, round(value - mv - b1 * (age - ma) - b2 * (gender - mg), 6) AS value FROM b"),
    "glm_adjusted_2cov": _q(_GRID, _SRC, _RESID2.format(keys="node"), "SELECT subject, node, round(value - b1 * (age - ma) - b2 * (gender - mg), 6) AS value FROM b"),
    "glm_edges": _q(_EV, "src AS MATERIALIZED (SELECT ev.subject, i, j, value, age, gender FROM ev JOIN subjects USING (subject))", _RESID2.format(keys="i, j"), "SELECT subject, i, j, round(value - mv - b1 * (age - ma) - b2 * (gender - mg), 6) AS value FROM b"),
    "glm_residual_3cov": _q(_GRID, _SRC, """m AS (SELECT *, age - avg(age) OVER k AS x, gender - avg(gender) OVER k AS z, duration - avg(duration) OVER k AS u, value - avg(value) OVER k AS y FROM src WINDOW k AS (PARTITION BY node)),
s AS (SELECT node, avg(x*x) AS a, avg(x*z) AS b, avg(x*u) AS c, avg(z*z) AS d, avg(z*u) AS e, avg(u*u) AS f, avg(x*y) AS p, avg(z*y) AS q, avg(u*y) AS r FROM m GROUP BY node),
k AS (SELECT *, a*(d*f-e*e) - b*(b*f-c*e) + c*(b*e-c*d) AS det FROM s),
g AS (SELECT node, (p*(d*f-e*e) - b*(q*f-r*e) + c*(q*e-r*d)) / det AS b1, (a*(q*f-r*e) - p*(b*f-c*e) + c*(b*r-c*q)) / det AS b2, (a*(d*r-e*q) - b*(b*r-c*q) + p*(b*e-c*d)) / det AS b3 FROM k)""", "SELECT subject, node, round(y - b1 * x - b2 * z - b3 * u, 6) AS value FROM m JOIN g USING (node)"),
    "centred_age": _q("SELECT subject, round(age - avg(age) OVER (), 6) AS age FROM subjects"),
    "pooled_t": _q(_EV, f"SELECT i, j, round(abs(coalesce((ma - mb) / nullif(sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)) * sqrt(1.0::DOUBLE / na + 1.0::DOUBLE / nb), 0), 0)), 6) AS t, na + nb - 2 AS df FROM ({_moments('ev', 'i, j')})"),
    "variance_ratio_f": _q(_EV, f"SELECT i, j, round(va / nullif(vb, 0), 6) AS f, na - 1 AS d1, nb - 1 AS d2 FROM ({_moments('ev', 'i, j')})"),
    "mann_whitney_u": _q(_EV, "r AS (SELECT *, rank() OVER (PARTITION BY i, j ORDER BY value) + (count(*) OVER (PARTITION BY i, j, value) - 1) / 2.0::DOUBLE AS rank, count(*) OVER (PARTITION BY i, j, value) AS t FROM ev), m AS (SELECT i, j, count(*) FILTER (cohort = 'patient') AS na, count(*) FILTER (cohort = 'control') AS nb, sum(rank) FILTER (cohort = 'patient') AS ra, sum(t * t - 1)::DOUBLE AS ties FROM r GROUP BY i, j)", "SELECT i, j, round(ra - na * (na + 1) / 2.0::DOUBLE, 6) AS u1, round(na * nb - ra + na * (na + 1) / 2.0::DOUBLE, 6) AS u2, round(ties, 6) AS ties FROM m"),
    "levene_w": _q(_GRID, f"v AS MATERIALIZED (SELECT * FROM {_rows('strength')}), md AS (SELECT node, cohort, quantile_cont(value, 0.5) AS mid FROM v GROUP BY ALL), z AS (SELECT node, cohort, abs(value - mid) AS value FROM v JOIN md USING (node, cohort)), m AS ({_moments('z', 'node')}), g AS (SELECT *, (na * ma + nb * mb) / (na + nb) AS grand FROM m)", "SELECT node, round((na + nb - 2) * (na * pow(ma - grand, 2) + nb * pow(mb - grand, 2)) / nullif(va * (na - 1) + vb * (nb - 1), 0), 6) AS w, na + nb - 2 AS df FROM g"),
    "outliers_iqr": _q(_GRID, "q AS (SELECT node, quantile_cont(strength, 0.25) AS q1, quantile_cont(strength, 0.75) AS q3 FROM deg JOIN co USING (subject) GROUP BY node)", "SELECT subject, node, round(strength, 6) AS value FROM deg JOIN q USING (node) WHERE strength > q3 + q3 - q1"),
    "outliers_per_subject": _q(_GRID, "q AS (SELECT node, quantile_cont(strength, 0.25) AS q1, quantile_cont(strength, 0.75) AS q3 FROM deg JOIN co USING (subject) GROUP BY node)", "SELECT subject, count(*) AS n FROM deg JOIN q USING (node) WHERE strength > q3 + q3 - q1 GROUP BY subject"),
    "normal_fit": _q(_GRID, "SELECT node, round(avg(strength), 6) AS mu, round(stddev_pop(strength), 6) AS sigma FROM deg GROUP BY node"),
    "histogram_bins": _q(_GRID, "x AS (SELECT node, strength AS v, min(strength) OVER (PARTITION BY node) AS lo, max(strength) OVER (PARTITION BY node) AS hi FROM deg)", "SELECT node, CAST(least(floor(coalesce((v - lo) * 20 / nullif(hi - lo, 0), 0)) + 1, 20) AS INT) AS bin, count(*) AS n FROM x GROUP BY ALL"),
    "bh_adjust": _q(_EV, _PL, "k AS (SELECT *, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS m FROM pl)", "SELECT i, j, round(p, 6) AS p, round(min(least(1.0, p * m / k)) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING), 6) AS q FROM k"),
    "bonferroni": _q(_EV, _PL, "SELECT i, j, round(least(1.0, p * count(*) OVER ()), 6) AS q FROM pl"),
    "event_type_tests": f"WITH e AS (SELECT CAST(extract('hour' FROM ts) AS INT) AS hour, CASE WHEN user_id % 2 = 0 THEN 'patient' ELSE 'control' END AS cohort, value FROM events) SELECT hour, round(t, 6) AS t FROM ({_welch('e', 'hour')})",
    "perm_labels": _q(_PERM, "SELECT perm, subject, cohort FROM perms"),
    "perm_welch_maxstat": _q(_GRID, _PERM, _SV, _NULL, "SELECT perm, round(stat, 6) AS stat FROM null_max"),
    "critical_value": _q(_GRID, _PERM, _SV, _NULL, "SELECT round(stat, 6) AS t_max FROM null_max ORDER BY stat DESC LIMIT 1 OFFSET 1"),
    "significant_nodes": _q(_GRID, _PERM, _SV, _NULL, f"SELECT node, round(t, 6) AS t FROM ({_welch(_rows('strength'), 'node')}) WHERE t > (SELECT stat FROM null_max ORDER BY stat DESC LIMIT 1 OFFSET 10)"),
    "perm_mwu_pvalue": _q(_GRID, _PERM, """rk AS MATERIALIZED (SELECT subject, node, cohort AS own, rank() OVER (PARTITION BY node ORDER BY value) + (count(*) OVER (PARTITION BY node, value) - 1) / 2.0::DOUBLE AS rank FROM (SELECT subject, node, strength AS value FROM deg) JOIN co USING (subject)),
al AS (SELECT 0 AS perm, node, own AS cohort, rank FROM rk UNION ALL SELECT perm, node, perms.cohort, rank FROM rk JOIN perms USING (subject)),
u AS MATERIALIZED (SELECT perm, node, count(*) FILTER (cohort = 'patient') AS na, count(*) FILTER (cohort = 'control') AS nb, sum(rank) FILTER (cohort = 'patient') AS ra FROM al GROUP BY ALL),
x AS MATERIALIZED (SELECT perm, node, least(ra - na * (na + 1) / 2.0::DOUBLE, na * nb - ra + na * (na + 1) / 2.0::DOUBLE) AS u FROM u)""", "SELECT o.node, round(o.u, 6) AS obs, round(count(*) FILTER (x.u >= o.u) / 20.0::DOUBLE, 6) AS p FROM x JOIN x o ON o.node = x.node AND o.perm = 0 WHERE x.perm > 0 GROUP BY o.node, o.u"),
    "perm_global_pvalue": _q(_PERM, "mw AS MATERIALIZED (SELECT subject, sum(w) * 2 / 625.0::DOUBLE AS value FROM edges GROUP BY subject)", f"nl AS ({_welch('(SELECT perm, cohort, value FROM mw JOIN perms USING (subject))', 'perm')}), ob AS ({_welch('(SELECT 1 AS one, cohort, value FROM mw JOIN subjects USING (subject))', 'one')})", "SELECT 'mean_weight' AS measure, round(ob.t, 6) AS obs, round(count(*) FILTER (nl.t <= -abs(ob.t) OR nl.t >= abs(ob.t)) / 20.0::DOUBLE, 6) AS p FROM nl, ob GROUP BY ob.t"),
    "first_measure_per_node": _q(_GRID, f"SELECT node, coalesce(arg_min(measure, place), 'nan') AS measure FROM nodes LEFT JOIN ({_HITS}) USING (node) GROUP BY node"),
    "suprathreshold_edges": _q(_EV, _WEDGE, "SELECT i, j, round(abs(t), 6) AS stat FROM we WHERE abs(t) > 1"),
    "connected_components": _q(_G4, _LABEL, "SELECT e.subject, e.i, e.j, component FROM edges e JOIN comp c ON c.subject = e.subject AND c.i = e.i WHERE w > 4"),
    "nbs_component_sizes": _q(_G4, _LABEL, "SELECT e.subject, component, count(*) AS size FROM edges e JOIN comp c ON c.subject = e.subject AND c.i = e.i WHERE w > 4 GROUP BY ALL"),
    "nbs_prune_isolated": _q(_EV, _WEDGE, "k AS (SELECT i, j FROM we WHERE abs(t) > 1.8), d AS (SELECT node, count(*) AS d FROM (SELECT unnest([i, j]) AS node FROM k) GROUP BY node)", "SELECT i, j FROM k JOIN d a ON a.node = i JOIN d b ON b.node = j WHERE NOT (a.d = 1 AND b.d = 1)"),
    "nbs_relabel": _q(_EV, _WEDGE, "k AS MATERIALIZED (SELECT i, j FROM we WHERE abs(t) > 1.5), s AS (SELECT i, j FROM k UNION ALL SELECT j, i FROM k), reach(i, r) AS (SELECT i, j FROM s UNION SELECT reach.i, s.j FROM reach JOIN s ON s.i = reach.r), c AS (SELECT i, min(least(i, r)) AS c FROM reach GROUP BY i), z AS (SELECT k.i, k.j, c.c, count(*) OVER (PARTITION BY c.c) AS size FROM k JOIN c ON c.i = k.i)", "SELECT i, j, dense_rank() OVER (ORDER BY c) AS component FROM z WHERE size > 1"),
    "tfnbs_ladder": _q(_EV, _WEDGE, "m AS (SELECT abs(t) AS v FROM we UNION ALL SELECT abs(t) FROM we UNION ALL SELECT 0 FROM range(625 - 2 * (SELECT count(*)::INT FROM we)) x), e AS (SELECT min(v) FILTER (v > 0) AS lo, quantile_cont(v::DOUBLE, 0.995) AS hi FROM m)", "SELECT CAST(r AS INT) AS r, round(lo + r * (hi - lo) / 100, 6) AS h FROM e, range(100) x(r)"),
    "ddt_moments": _q(_EV, _PL, _LG, "a AS (SELECT avg(d) AS e, var_pop(d) AS v FROM lg), b AS (SELECT *, greatest(2, floor(-e * e / v)) AS m FROM a), c AS (SELECT *, sqrt(greatest(e, 0) / m) AS mu FROM b)", "SELECT round(e, 6) AS e_bar, round(v, 6) AS v_bar, m::BIGINT AS m, round(mu, 6) AS mu, round(-mu * mu + sqrt(pow(mu, 4) + v / m), 6) AS sigma2 FROM c"),
    "ddt_observed_degree": _q(_EV, _PL, _LG, "SELECT node, count(x) AS degree FROM nodes LEFT JOIN (SELECT unnest([i, j]) AS x FROM lg WHERE d > 0.5) ON x = node GROUP BY node"),
    "laplacian_total": _q(_GRID, "SELECT subject, i, j, -w::DOUBLE AS v FROM sym UNION ALL SELECT subject, node, node, sum(strength) OVER (PARTITION BY subject) FROM deg"),
    "laplacian_degree": _q(_GRID, "SELECT subject, i, j, -w::DOUBLE AS v FROM sym UNION ALL SELECT subject, node, node, round(strength + 0.01, 6) FROM deg"),
    "normalized_laplacian": _q(_SYMS, "SELECT subject, i, j, round(-w / sqrt(si * sj), 6) AS v FROM ss UNION ALL SELECT subject, node, node, 1.0::DOUBLE FROM (SELECT DISTINCT subject FROM edges), nodes"),
    "laplacian_by_degrees": _q(_SYMS, "SELECT subject, i, j, round(-w / sqrt(si * sj), 6) AS v FROM ss UNION ALL SELECT subject, i, i, round(max(whole) / max(si), 6) FROM ss GROUP BY subject, i"),
    "network_degree": _q(_EV, _WEDGE, "x AS (SELECT i, j FROM we WHERE abs(t) > 1.5), e AS (SELECT i AS node FROM x UNION ALL SELECT j FROM x)", "SELECT node, count(e.node) AS degree FROM nodes LEFT JOIN e USING (node) GROUP BY node"),
    "raw_rank_statistic": _q(_EV, "r AS (SELECT *, rank() OVER (PARTITION BY i, j ORDER BY value) + (count(*) OVER (PARTITION BY i, j, value) - 1) / 2.0::DOUBLE AS rank FROM ev)", "SELECT i, j, round(sum(rank) FILTER (cohort = 'patient') - count(*) FILTER (cohort = 'patient') * (count(*) FILTER (cohort = 'patient') + 1) / 2.0::DOUBLE, 6) AS stat FROM r GROUP BY i, j"),
    "gram_matrix": _q("v AS (SELECT i, subject AS k, sum(w)::DOUBLE AS v FROM edges GROUP BY ALL)", "SELECT a.i, b.i AS j, sum(a.v * b.v) AS v FROM v a JOIN v b USING (k) WHERE a.i <= b.i GROUP BY ALL"),
    "fisher_score_rank": f"WITH {_FS} SELECT feature, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, feature) AS rank FROM fs",
    "top_features": f"WITH {_FS} SELECT feature, round(score, 6) AS score FROM fs ORDER BY fs.score DESC, feature LIMIT 20",
    "shuffle_split": _q("s AS (SELECT CAST(unnest(range(10)) AS INT) AS split), x AS (SELECT split, subject, row_number() OVER (PARTITION BY split ORDER BY md5(split || '|' || subject), subject) AS k, count(*) OVER (PARTITION BY split) AS n FROM s CROSS JOIN (SELECT subject FROM subjects))", "SELECT split, subject, CASE WHEN k <= ceil(0.03::DOUBLE * n) THEN 'test' ELSE 'train' END AS part FROM x"),
    "stratified_folds": _q("SELECT subject, CAST(cohort = 'patient' AS INT) AS label, CAST((row_number() OVER (PARTITION BY cohort ORDER BY subject) - 1) % 10 AS INT) AS fold FROM subjects"),
    "knn_predict": """WITH d AS (SELECT q.vec_id AS id, t.vec_id AS near, t.label, list_sum(list_transform(list_zip(q.embedding::DOUBLE[], t.embedding::DOUBLE[]), lambda x: pow(x[1] - x[2], 2))) AS d FROM embeddings q JOIN embeddings t ON q.vec_id <> t.vec_id WHERE q.vec_id % 100 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, near) AS r FROM d), v AS (SELECT id, label, count(*) AS n FROM k WHERE r <= 5 GROUP BY ALL)
SELECT id, label AS predicted FROM v QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, label) = 1""",
    "hard_label_auc": _q("p AS (SELECT cohort = 'patient' AS y, age > 45 AS z FROM subjects)", "SELECT round((count(*) FILTER (y AND z)::DOUBLE / count(*) FILTER (y) + count(*) FILTER (NOT y AND NOT z)::DOUBLE / count(*) FILTER (NOT y)) / 2, 6) AS auc FROM p"),
}
