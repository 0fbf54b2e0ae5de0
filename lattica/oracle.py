"""DuckDB SQL for the registered queries. Iterations are unrolled or recursive; no operator code is used."""

from __future__ import annotations

_PTS = """pts AS MATERIALIZED (
  SELECT vec_id AS id, (label % 2)::INT AS label,
         list_transform(range(1, len(embedding) + 1), lambda j: embedding[j]::DOUBLE + CASE WHEN j <= 8 AND (j - 1) % 2 = label % 2 THEN 0.3::DOUBLE ELSE 0::DOUBLE END) AS f
  FROM embeddings)"""
_D2 = "list_sum(list_transform(list_zip(a.f, b.f), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def _near(name: str, left: str, right: str, k: int) -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT src, dst, pos::INT AS pos, d2 FROM (
    SELECT src, dst, d2, row_number() OVER (PARTITION BY src ORDER BY d2, dst) AS pos
    FROM (SELECT a.id AS src, b.id AS dst, {_D2} AS d2 FROM {left} a JOIN {right} b ON a.id <> b.id)) WHERE pos <= {k})"""


_KNN = _PTS + ", " + _near("knn", "pts", "pts", 20)
_W = _KNN + ", deg AS (SELECT src, count(*) AS deg FROM knn GROUP BY src), w AS MATERIALIZED (SELECT src, dst, 1.0::DOUBLE / deg AS w FROM knn JOIN deg USING (src))"
_WALK = _W + ", p0 AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM pts) AS pi FROM pts)"
for _t in range(1, 11):
    _WALK += f", p{_t} AS MATERIALIZED (SELECT pts.id, coalesce(sum(w.w * p.pi), 0) AS pi FROM pts LEFT JOIN w ON w.dst = pts.id LEFT JOIN p{_t - 1} p ON p.id = w.src GROUP BY pts.id)"
_UP = _WALK + """, up AS MATERIALIZED (SELECT e.src, e.dst FROM knn e JOIN p10 a ON a.id = e.src JOIN p10 b ON b.id = e.dst WHERE e.pos <= 10 AND b.pi > a.pi),
links AS MATERIALIZED (SELECT src, dst FROM up UNION ALL SELECT id, id FROM p10 WHERE id NOT IN (SELECT src FROM up))"""
_CLIMB = _UP + """, climb(t, id, v) AS (
  SELECT 0, id, pi FROM p10 UNION ALL
  SELECT max(c.t) + 1, l.src, avg(c.v) FROM climb c JOIN links l ON l.dst = c.id WHERE c.t < 80 GROUP BY l.src),
expected AS MATERIALIZED (SELECT id, v FROM climb WHERE t = 80)"""
_SCORE = _CLIMB + ", score AS MATERIALIZED (SELECT p10.id, pi / (v + 1e-5) AS score FROM p10 JOIN expected USING (id))"
_RANK = _SCORE + ", ranked AS MATERIALIZED (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank, count(*) OVER () AS n FROM score)"
_CORE = _RANK + ", core AS MATERIALIZED (SELECT id FROM ranked WHERE rank <= floor(0.6 * n)), lab AS (SELECT id, label FROM pts WHERE id IN (SELECT id FROM core)), od AS MATERIALIZED (SELECT src, count(*) AS deg FROM knn GROUP BY src)"


def _votes(labels: str, mask: str, go: str = "true") -> str:
    return f"SELECT e.src AS id, l.label FROM knn e JOIN {labels} l ON l.id = e.dst JOIN od ON od.src = e.src WHERE {go} AND e.src IN ({mask}) GROUP BY e.src, l.label HAVING count(*) > 0.5 * max(od.deg)"


_REST, _OWN = "SELECT id FROM pts WHERE id NOT IN (SELECT id FROM core)", "SELECT id FROM core"
_ROUNDS = _CORE + ", l0 AS (SELECT * FROM lab), g0 AS (SELECT true AS go)"
for _t in range(1, 26):
    _ROUNDS += f""", v{_t} AS MATERIALIZED ({_votes(f"l{_t - 1}", _REST, f"(SELECT go FROM g{_t - 1})")}),
l{_t} AS MATERIALIZED (SELECT * FROM l{_t - 1} WHERE id NOT IN (SELECT id FROM v{_t}) UNION ALL SELECT id, label FROM v{_t}),
g{_t} AS MATERIALIZED (SELECT (SELECT go FROM g{_t - 1}) AND NOT ((SELECT count(*) FROM l{_t}) - (SELECT count(*) FROM l{_t - 1}) < floor(0.005 * (SELECT count(*) FROM pts)) OR (SELECT count(*) FROM l{_t - 1}) > 0.95 * (SELECT count(*) FROM pts)) AS go)"""
_ALL_ROUNDS = " UNION ALL ".join(f"SELECT id, label, {t} AS round FROM v{t}" for t in range(1, 26))

_SYM = """, a AS MATERIALIZED (SELECT row, col, sum(w) * 0.5 AS w FROM (SELECT src AS row, dst AS col, count(*)::DOUBLE AS w FROM knn GROUP BY ALL UNION ALL SELECT dst, src, count(*)::DOUBLE FROM knn GROUP BY ALL) GROUP BY row, col),
d AS MATERIALIZED (SELECT row, sum(w) AS d FROM a GROUP BY row)"""
_P = _SYM + ", p AS MATERIALIZED (SELECT a.row, a.col, a.w / (sqrt(d.d) * sqrt(e.d)) AS w FROM a JOIN d ON d.row = a.row JOIN d e ON e.row = a.col)"
_F = _CORE + _P + ", f0 AS MATERIALIZED (SELECT id, dense_rank() OVER (ORDER BY label) - 1 AS cls, 1.0::DOUBLE AS score FROM lab)"
for _t in range(1, 6):
    _F += f""", f{_t} AS MATERIALIZED (SELECT * FROM f0 UNION ALL SELECT id, cls, sum(s) FROM (
  SELECT p.row AS id, f.cls, 0.1 * p.w * f.score AS s FROM p JOIN f{_t - 1} f ON f.id = p.col WHERE p.row NOT IN (SELECT id FROM core)
  UNION ALL SELECT id, cls, 0.9 * score FROM f{_t - 1} WHERE id NOT IN (SELECT id FROM core)) GROUP BY id, cls)"""
_BEST = _F + ", best AS MATERIALIZED (SELECT id, cls, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, cls) AS k FROM f5 WHERE score > 0)"


def _conf(value: str) -> str:
    return _BEST + f""", conf AS MATERIALIZED (SELECT pts.id, coalesce(any_value(b.cls) FILTER (b.k = 1), 0)::INT AS cls, round(coalesce({value}, 0), 9) AS conf
FROM pts LEFT JOIN best b ON b.id = pts.id WHERE pts.id NOT IN (SELECT id FROM core) GROUP BY pts.id)"""


_ARGMAX = _conf("max(b.score)")
_LAYERS = _ARGMAX + """, layer AS MATERIALIZED (SELECT id, 0 AS layer FROM core UNION ALL SELECT id, ntile(5) OVER (PARTITION BY cls ORDER BY conf DESC, id)::INT FROM conf),
shown AS (SELECT r.round::INT AS round, layer.id FROM layer JOIN range(0, 6) r(round) ON layer.layer <= r.round)"""
_KERNEL = _KNN + """, far AS MATERIALIZED (SELECT src, dst, sqrt(d2) AS dist FROM knn),
rows_ AS (SELECT src, list_sort(list(dist)) AS ds FROM far GROUP BY src),
goal AS MATERIALIZED (SELECT src, ds, ds[1] AS rho, CASE WHEN len(ds) = 1 THEN 1.0::DOUBLE WHEN len(ds) <= 5 THEN 1 + len(ds)::DOUBLE / 2 ELSE log2(len(ds)::DOUBLE) END AS target FROM rows_),
bis(t, src, lo, hi) AS (SELECT 0, src, 1e-8::DOUBLE, 1e5::DOUBLE FROM goal UNION ALL
  SELECT t + 1, src, CASE WHEN s > target THEN lo ELSE mid END, CASE WHEN s > target THEN mid ELSE hi END FROM (
    SELECT b.t, b.src, b.lo, b.hi, (b.lo + b.hi) / 2 AS mid, g.target, list_sum(list_transform(g.ds, lambda x: exp(-(x - g.rho) / ((b.lo + b.hi) / 2)))) AS s
    FROM bis b JOIN goal g USING (src) WHERE b.t < 64)),
ws AS MATERIALIZED (SELECT far.src, far.dst, exp(-(dist - rho) / ((lo + hi) / 2)) AS w FROM far JOIN goal USING (src) JOIN bis ON bis.src = far.src AND bis.t = 64)"""


def _visits(seeds: str, name: str) -> str:
    out = f", {name}0 AS (SELECT id AS seed, id AS node, 1.0::DOUBLE AS p FROM ({seeds}))"
    for t in range(1, 6):
        out += f", {name}{t} AS MATERIALIZED (SELECT v.seed, w.dst AS node, sum(v.p * w.w) AS p FROM {name}{t - 1} v JOIN w ON w.src = v.node WHERE round(v.p, 12) > 1e-4 GROUP BY v.seed, w.dst)"
    return out + f", {name} AS MATERIALIZED (SELECT seed, node, sum(p) AS visits FROM (" + " UNION ALL ".join(f"SELECT * FROM {name}{t}" for t in range(1, 6)) + ") GROUP BY seed, node)"


_PR = _W + ", r0 AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM pts) AS s FROM pts)"
for _t in range(1, 11):
    _PR += f", r{_t} AS MATERIALIZED (SELECT pts.id, 0.85 * coalesce(sum(w.w * r.s), 0) + 0.15::DOUBLE / (SELECT count(*) FROM pts) AS s FROM pts LEFT JOIN w ON w.dst = pts.id LEFT JOIN r{_t - 1} r ON r.id = w.src GROUP BY pts.id)"
_THIN = _CORE + """, sd AS MATERIALIZED (SELECT src AS id, count(*) AS deg, count(*) FILTER (dst IN (SELECT id FROM core)) AS deg_sub FROM knn WHERE src IN (SELECT id FROM core) GROUP BY src),
thin AS MATERIALIZED (SELECT id, deg - deg_sub AS vacant FROM sd WHERE deg_sub < 0.75 * deg)"""
_HOPS = _UP + """, climb(t, id, v) AS (
  SELECT 0, id, 0.0::DOUBLE FROM p10 UNION ALL
  SELECT max(c.t) + 1, l.src, avg(c.v) + max(CASE WHEN l.src = l.dst THEN 0 ELSE 1 END) FROM climb c JOIN links l ON l.dst = c.id WHERE c.t < 80 GROUP BY l.src)"""
_CUT = _RANK + """, falls AS (SELECT rank, score, abs(score - lag(score) OVER (ORDER BY rank)) / greatest(score, 1e-12) AS rel, n FROM ranked),
tail AS (SELECT rank, n, CASE WHEN rank = floor(0.05 * n) + 1 THEN 0 ELSE rel END AS rel FROM falls WHERE rank > floor(0.05 * n)),
flat AS (SELECT rank, n, sum(rel) OVER (ORDER BY rank ROWS BETWEEN 25 PRECEDING AND 24 FOLLOWING) / 50 AS mean FROM tail),
cums AS (SELECT rank, score, n, sum(score) OVER (ORDER BY rank) AS cum, sum(score) OVER () AS total FROM ranked)"""

#: Diffusion of all 50 steps, every one of which may be the last, and its check every fifth step.
_LONG = _F
for _t in range(6, 51):
    _LONG += f""", f{_t} AS MATERIALIZED (SELECT * FROM f0 UNION ALL SELECT id, cls, sum(s) FROM (
  SELECT p.row AS id, f.cls, 0.1 * p.w * f.score AS s FROM p JOIN f{_t - 1} f ON f.id = p.col WHERE p.row NOT IN (SELECT id FROM core)
  UNION ALL SELECT id, cls, 0.9 * score FROM f{_t - 1} WHERE id NOT IN (SELECT id FROM core)) GROUP BY id, cls)"""
_LONG += ", moved AS (" + " UNION ALL ".join(f"SELECT {t} AS t, max(abs(coalesce(a.score, 0) - coalesce(b.score, 0))) AS delta FROM f{t} a FULL JOIN f{t - 1} b ON a.id = b.id AND a.cls = b.cls" for t in range(5, 51, 5)) + ")"
_LONG += ", last AS (SELECT coalesce(min(t) FILTER (delta < 1e-5), 50) AS t FROM moved)"
_PR_ALL = _PR
for _t in range(11, 41):
    _PR_ALL += f", r{_t} AS MATERIALIZED (SELECT pts.id, 0.85 * coalesce(sum(w.w * r.s), 0) + 0.15::DOUBLE / (SELECT count(*) FROM pts) AS s FROM pts LEFT JOIN w ON w.dst = pts.id LEFT JOIN r{_t - 1} r ON r.id = w.src GROUP BY pts.id)"
_PR_ALL += ", moved AS (" + " UNION ALL ".join(f"SELECT {t} AS t, sum(abs(a.s - b.s)) AS delta FROM r{t} a JOIN r{t - 1} b USING (id)" for t in range(1, 41)) + "), last AS (SELECT min(t) AS t FROM moved WHERE delta < 1e-6 * (SELECT count(*) FROM pts))"
#: Three made labellings of the ranked fifth, voting over the edges that the top three fifths induce.
_FINE = _CORE + """, few AS (SELECT id FROM ranked WHERE rank <= floor(0.2 * n)),
ins AS MATERIALIZED (SELECT src, dst FROM knn WHERE src IN (SELECT id FROM core) AND dst IN (SELECT id FROM core)),
iod AS (SELECT src, count(*) AS deg FROM ins GROUP BY src),
many AS (SELECT s.seed, id, CASE WHEN s.seed > 0 AND id % (9 + 2 * s.seed) = 0 THEN 1 - label ELSE label END AS label FROM lab JOIN few USING (id), range(0, 3) s(seed)),
won AS (SELECT l.seed, e.src AS id FROM ins e JOIN many l ON l.id = e.dst JOIN iod ON iod.src = e.src WHERE e.src IN (SELECT id FROM few) GROUP BY l.seed, e.src, l.label HAVING count(*) > 0.5 * max(iod.deg)),
kept AS (SELECT id FROM won GROUP BY id HAVING count(DISTINCT seed) = 3)"""
#: The core's labels as anchors: pulls by the kernel over the distances to each label's mean, whose sum is a tenth of the core.
_PULLS = _CORE + """, cells AS (SELECT label AS aid, unnest(range(0, len(f))) AS pos, unnest(f) AS v FROM pts WHERE id IN (SELECT id FROM core)),
mean_ AS (SELECT aid, list(m ORDER BY pos) AS f FROM (SELECT aid, pos, avg(v) AS m FROM cells GROUP BY aid, pos) GROUP BY aid),
far AS MATERIALIZED (SELECT a.label AS aid, a.id, sqrt(""" + _D2 + """) AS dist FROM pts a JOIN mean_ b ON b.aid = a.label WHERE a.id IN (SELECT id FROM core)),
goal AS MATERIALIZED (SELECT aid, list_sort(list(dist)) AS ds, min(dist) AS rho, 0.1 * (SELECT count(*) FROM core) AS target FROM far GROUP BY aid),
bis(t, aid, lo, hi) AS (SELECT 0, aid, 1e-8::DOUBLE, 1e5::DOUBLE FROM goal UNION ALL
  SELECT t + 1, aid, CASE WHEN s > target THEN lo ELSE mid END, CASE WHEN s > target THEN mid ELSE hi END FROM (
    SELECT b.t, b.aid, b.lo, b.hi, (b.lo + b.hi) / 2 AS mid, g.target, list_sum(list_transform(g.ds, lambda x: exp(-(x - g.rho) / ((b.lo + b.hi) / 2)))) AS s
    FROM bis b JOIN goal g USING (aid) WHERE b.t < 64)),
spot AS (SELECT label AS aid, avg(f[1]) AS ax, avg(f[2]) AS ay FROM pts WHERE id IN (SELECT id FROM core) GROUP BY label)"""


def _q(ctes: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{select}"


SQL = {
    "knn_graph": _q(_KNN, "SELECT src, dst, pos, round(d2, 9) AS d2 FROM knn"),
    "knn_truncate": _q(_KNN, "SELECT src, dst, pos FROM knn WHERE pos <= 10"),
    "bipartite_knn": _q(_PTS + ", zero AS (SELECT * FROM pts WHERE label = 0), one AS (SELECT * FROM pts WHERE label = 1), " + _near("b", "one", "zero", 5), "SELECT src, dst, pos, round(d2, 9) AS d2 FROM b"),
    "edge_list_no_loops": _q(_KNN, "SELECT src, dst FROM knn WHERE src <> dst"),
    "out_degree": _q(_KNN, "SELECT src AS id, count(*) AS deg FROM knn GROUP BY src"),
    "in_degree": _q(_KNN, "SELECT dst AS id, count(*) AS deg FROM knn GROUP BY dst"),
    "induced_edges": _q(_KNN, "SELECT src, dst, pos FROM knn WHERE src IN (SELECT id FROM pts WHERE label = 1) AND dst IN (SELECT id FROM pts WHERE label = 1)"),
    "local_ids": _q(_KNN + ", own AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM pts WHERE label = 1)", "SELECT a.k AS src, b.k AS dst, pos FROM knn JOIN own a ON a.id = src JOIN own b ON b.id = dst"),
    "complement_nodes": _q(_PTS, "SELECT id FROM pts WHERE label <> 1"),
    "subset_degree": _q(_KNN, "SELECT src AS id, count(*) AS deg, count(*) FILTER (dst IN (SELECT id FROM pts WHERE label = 1)) AS deg_sub FROM knn WHERE src IN (SELECT id FROM pts WHERE label = 1) GROUP BY src"),
    "symmetrized_adjacency": _q(_KNN + _SYM, "SELECT * FROM a"),
    "transposed_adjacency": _q(_KNN, "SELECT dst AS row, src AS col, count(*)::DOUBLE AS w FROM knn GROUP BY ALL"),
    "cosine_sorted_adjacency": _q(
        _KNN + ", c AS (SELECT src, dst, 1 - list_dot_product(a.f, b.f) / (sqrt(list_dot_product(a.f, a.f)) * sqrt(list_dot_product(b.f, b.f)) + 1e-12) AS dist FROM knn JOIN pts a ON a.id = src JOIN pts b ON b.id = dst)",
        "SELECT src, dst, (row_number() OVER (PARTITION BY src ORDER BY dist, dst))::INT AS pos, round(dist, 9) AS dist FROM c",
    ),
    "density_walk": _q(_WALK, "SELECT id, round(pi, 10) AS pi FROM p10"),
    "ascending_expectation": _q(_CLIMB, "SELECT id, round(v, 10) AS expected FROM expected", True),
    "ascending_hops": _q(_HOPS, "SELECT id, round(v, 8) AS hops FROM climb WHERE t = 80", True),
    "hops_ranking": _q(_HOPS, "SELECT id, round(-v, 8) AS score FROM climb WHERE t = 80", True),
    "flowrank": _q(_SCORE, "SELECT id, round(score, 8) AS score FROM score", True),
    "flowrank_core": _q(_RANK, "SELECT id, rank FROM ranked WHERE rank <= floor(0.2 * n)", True),
    "pagerank": _q(_PR, "SELECT id, round(s, 9) AS score FROM r10"),
    "indegree_rank": _q(_KNN, "SELECT pts.id, count(dst)::DOUBLE AS score FROM pts LEFT JOIN knn ON dst = id GROUP BY pts.id"),
    "cutoffs": _q(
        _CUT,
        "SELECT (SELECT max(n) FROM ranked) AS last_nonzero, (SELECT count(*) FROM ranked WHERE score > 1.0 / 400) AS above_eps, (SELECT min(rank) FROM cums WHERE cum >= 0.99 * total) AS cumu_mass, "
        "coalesce((SELECT min(rank) - 1 - floor(0.05 * max(n)) FROM flat WHERE mean < 0.01), (SELECT max(n) FROM ranked))::BIGINT AS flat_tail",
        True,
    ),
    "auto_core": _q(_CUT, "SELECT id FROM ranked WHERE rank <= floor(least((SELECT min(rank) FROM cums WHERE cum >= 0.99 * total), 0.25 * n))", True),
    "majority_round": _q(_CORE, _votes("lab", _REST), True),
    "recursive_majority": _q(_ROUNDS, f"SELECT id, arg_max(label, round)::INT AS label, min(round)::INT AS round FROM ({_ALL_ROUNDS}) GROUP BY id", True),
    "core_self_check": _q(_CORE, _votes("lab", _OWN), True),
    "consensus_intersection": _q(
        _CORE + ", many AS (SELECT s.seed, id, CASE WHEN s.seed > 0 AND id % (9 + 2 * s.seed) = 0 THEN 1 - label ELSE label END AS label FROM lab, range(0, 3) s(seed)), "
        "won AS (SELECT l.seed, e.src AS id FROM knn e JOIN many l ON l.id = e.dst JOIN od ON od.src = e.src WHERE e.src IN (SELECT id FROM core) GROUP BY l.seed, e.src, l.label HAVING count(*) > 0.5 * max(od.deg))",
        "SELECT id FROM won GROUP BY id HAVING count(DISTINCT seed) = 3",
        True,
    ),
    "rw_normalized": _q(_KNN + _SYM, "SELECT a.row, a.col, round(a.w / d.d, 12) AS w FROM a JOIN d ON d.row = a.row"),
    "sym_normalized": _q(_KNN + _P, "SELECT row, col, round(w, 12) AS w FROM p"),
    "diffusion_5": _q(_F, "SELECT id, cls::INT AS cls, round(score, 10) AS score FROM f5", True),
    "hard_labels": _q(_BEST, "SELECT pts.id, coalesce(b.cls, -1)::INT AS label FROM pts LEFT JOIN best b ON b.id = pts.id AND b.k = 1", True),
    "conf_argmax": _q(_ARGMAX, "SELECT * FROM conf", True),
    "conf_margin": _q(_conf("max(b.score) - coalesce(max(b.score) FILTER (b.k = 2), 0)"), "SELECT * FROM conf", True),
    "conf_entropy": _q(_conf("sum(b.score * ln(b.score + 1e-12))"), "SELECT * FROM conf", True),
    "layer_ntile": _q(_ARGMAX, "SELECT id, (ntile(5) OVER (PARTITION BY cls ORDER BY conf DESC, id) - 1)::INT AS layer FROM conf", True),
    "densify_knn_edges": _q(
        _CORE + ", own AS (SELECT * FROM pts WHERE id IN (SELECT id FROM core)), " + _near("inner_", "own", "own", 20),
        "SELECT src, dst, pos FROM knn UNION ALL SELECT i.src, i.dst, (row_number() OVER (PARTITION BY i.src ORDER BY i.pos) + 20)::INT FROM inner_ i WHERE NOT EXISTS (SELECT 1 FROM knn k WHERE k.src = i.src AND k.dst = i.dst)",
        True,
    ),
    "rw_visits": _q(_CORE + _visits("SELECT id FROM core", "z"), "SELECT seed, node, round(visits, 10) AS visits FROM z", True),
    "top_per_row": _q(
        _CORE + _visits("SELECT id FROM core", "z"),
        "SELECT seed, node FROM (SELECT seed, node, row_number() OVER (PARTITION BY seed ORDER BY round(visits, 10) DESC, node) AS k FROM z WHERE round(visits, 10) <> 0) WHERE k <= 5",
        True,
    ),
    "cutoff_knee": _q(_CUT + ", box AS (SELECT max(score) AS hi, min(score) AS lo FROM ranked)", "SELECT arg_max(rank, 1 - (rank - 1)::DOUBLE / (n - 1) - (score - lo) / (hi - lo)) AS knee FROM ranked, box", True),
    "densify_rw_edges": _q(
        _THIN + _visits("SELECT id FROM thin", "z") + """, cand AS (SELECT z.seed AS src, z.node AS dst, vacant, row_number() OVER (PARTITION BY z.seed ORDER BY round(visits, 12) DESC, node) AS k
FROM z JOIN thin ON thin.id = z.seed WHERE z.node <> z.seed AND visits > 0 AND node IN (SELECT id FROM core) AND NOT EXISTS (SELECT 1 FROM knn e WHERE e.src = z.seed AND e.dst = z.node))""",
        "SELECT src, dst, pos FROM knn UNION ALL SELECT src, dst, (k + 20)::INT FROM cand WHERE k <= vacant",
        True,
    ),
    "heat_kernel_weights": _q(_KERNEL, "SELECT src, dst, round(w, 8) AS w FROM ws", True),
    "epochs_per_sample": _q(_KERNEL, "SELECT src, dst, round(CASE WHEN w > 0 THEN (SELECT max(w) FROM ws) / w ELSE -1 END, 6) AS eps FROM ws", True),
    "cumulative_layers": _q(_LAYERS, "SELECT round, id, round(f[1], 9) AS x, round(f[2], 9) AS y FROM shown JOIN pts USING (id)", True),
    "anchor_means": _q(_PTS + ", cells AS (SELECT label AS aid, unnest(range(0, len(f))) AS pos, unnest(f) AS v FROM pts)", "SELECT aid, pos, round(avg(v), 10) AS m FROM cells GROUP BY aid, pos"),
    "axis_ranges": _q(
        _PTS + ", b AS (SELECT min(f[1]) AS a, max(f[1]) AS c, min(f[2]) AS e, max(f[2]) AS g FROM pts)",
        "SELECT round(a - 0.05 * (c - a), 9) AS x0, round(c + 0.05 * (c - a), 9) AS x1, round(e - 0.05 * (g - e), 9) AS y0, round(g + 0.05 * (g - e), 9) AS y1 FROM b",
    ),
    "trace_summary": _q(_LAYERS, "SELECT round, label, count(*) AS n FROM shown JOIN pts USING (id) GROUP BY round, label", True),
    "pagerank_tolerance": _q(_PR_ALL, "SELECT id, round(s, 9) AS score FROM (" + " UNION ALL ".join(f"SELECT {t} AS t, id, s FROM r{t}" for t in range(1, 41)) + ") JOIN last USING (t)"),
    "diffusion_tolerance": _q(_LONG, "SELECT id, cls::INT AS cls, round(score, 10) AS score FROM (" + " UNION ALL ".join(f"SELECT {t} AS t, id, cls, score FROM f{t}" for t in range(5, 51, 5)) + ") JOIN last USING (t)", True),
    "diffusion_snapshots": _q(_F, " UNION ALL ".join(f"SELECT {t}::INT AS t, id, cls::INT AS cls, round(score, 10) AS score FROM f{t}" for t in (0, 2, 4, 5)), True),
    "fine_grained_vote": _q(_FINE, "SELECT id, CASE WHEN id IN (SELECT id FROM kept) THEN 0 ELSE 1 END::INT AS layer FROM core", True),
    "anchor_pulls": _q(_PULLS, "SELECT far.id, round(ax, 9) AS ax, round(ay, 9) AS ay, round(exp(-(dist - rho) / ((lo + hi) / 2)), 8) AS w FROM far JOIN goal USING (aid) JOIN spot USING (aid) JOIN bis ON bis.aid = far.aid AND bis.t = 64", True),
    "out_adjacency": _q(_KNN, "SELECT src AS row, dst AS col, count(*)::DOUBLE AS w FROM knn GROUP BY ALL"),
}
