from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions import lineage, vectors
from lattica.operators import densify, diffusion, graph, ranking, selection


def edges_of(spark, pairs):
    pos, rows = {}, []
    for a, b in pairs:
        pos[a] = pos.get(a, 0) + 1
        rows.append((a, b, pos[a], float(pos[a])))
    return spark.createDataFrame(rows, graph.EDGES)


def nodes_of(spark, n):
    return spark.range(n).select("id")


def points_of(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, features array<double>")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("method", ["sql", "blocked"])
def test_knn_is_exact_and_breaks_ties_by_id(spark, method):
    x = np.random.default_rng(1).normal(size=(40, 3))
    x[7] = x[3]  # a repeated point: neither may drop the other, nor itself be a neighbour
    found = graph.knn_graph(points_of(spark, x), 5, method=method, **({"query_bytes": 400, "index_bytes": 500} if method == "blocked" else {}))
    d = ((x[:, None] - x) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    want = sorted((i, int(j), k + 1) for i in range(40) for k, j in enumerate(np.lexsort((np.arange(40), d[i]))[:5]))
    assert rows(found.select("src", "dst", "pos")) == want


def test_knn_of_few_points(spark):
    assert rows(graph.knn_graph(points_of(spark, [[0.0], [1.0]]), 5).select("src", "dst")) == [(0, 1), (1, 0)]
    assert graph.knn_graph(points_of(spark, [[0.0]]), 5).count() == 0
    assert graph.knn_graph(points_of(spark, [[0.0]]).limit(0), 5).count() == 0


def test_lsh_finds_most_neighbours(spark, monkeypatch):
    # Points around a far centre, a third of them close together, in buckets of a dozen that are cut into blocks of eight.
    rng = np.random.default_rng(2)
    x = 50 + np.vstack([rng.normal(size=(160, 8)) * 4, rng.normal(size=(80, 8)) * 0.1])
    monkeypatch.setattr(graph, "BUCKET_ROWS", 8)
    want = {(r.src, r.dst) for r in graph.knn_graph(points_of(spark, x), 5).collect()}
    found = graph.knn_graph(points_of(spark, x), 5, method="lsh", occupancy=16).collect()
    assert len(want & {(r.src, r.dst) for r in found}) / len(want) >= 0.9
    assert len({(r.src, r.dst) for r in found}) == len(found) == 5 * len(x)
    assert graph.knn_graph(points_of(spark, x).limit(0), 5, method="lsh").count() == 0


def test_drop_first_and_unknown_method(spark):
    p = points_of(spark, [[0.0], [1.0], [3.0]])
    assert rows(graph.bipartite_knn(p, p, 1, drop_first=True).select("src", "dst", "pos")) == [(0, 1, 1), (1, 0, 1), (2, 1, 1)]
    with pytest.raises(ValueError):
        graph.knn_graph(p, 1, method="tree")


def test_multi_edges_and_self_loops(spark):
    e = edges_of(spark, [(0, 1), (0, 1), (0, 0), (1, 2)])
    assert rows(graph.out_degree(e)) == [(0, 3), (1, 1)]
    assert rows(graph.induced(e, nodes_of(spark, 2)).select("src", "dst")) == [(0, 1), (0, 1)]
    assert rows(graph.adjacency(e, "out")) == [(0, 0, 1.0), (0, 1, 2.0), (1, 2, 1.0)]
    assert rows(graph.adjacency(e, "sym")) == [(0, 0, 1.0), (0, 1, 1.0), (1, 0, 1.0), (1, 2, 0.5), (2, 1, 0.5)]
    assert rows(densify.subset_degree(e, nodes_of(spark, 1))) == [(0, 3, 1)]
    with pytest.raises(ValueError):
        graph.adjacency(e, "both")


def test_walk_on_a_sink_loses_mass(spark):
    e = edges_of(spark, [(0, 1)])
    assert rows(ranking.density_walk(e, nodes_of(spark, 2), 1)) == [(0, 0.0), (1, 0.5)]
    assert rows(ranking.density_walk(e, nodes_of(spark, 2), 2)) == [(0, 0.0), (1, 0.0)]


def test_climbing_a_chain_and_a_diamond(spark):
    init = spark.createDataFrame([(i, 0.1 * (i + 1)) for i in range(4)], "id long, pi double")
    chain = edges_of(spark, [(0, 1), (1, 2), (2, 3), (3, 0)])
    assert [h for _, h in rows(ranking.ascending_hops(chain, init))] == [3.0, 2.0, 1.0, 0.0]
    assert [round(v, 9) for _, v in rows(ranking.ascending_value(chain, init))] == [0.4] * 4
    diamond = edges_of(spark, [(0, 1), (0, 2), (1, 3)])
    assert [round(v, 9) for _, v in rows(ranking.ascending_value(diamond, init))] == [0.35, 0.4, 0.3, 0.4]


def test_pagerank_with_a_sink(spark):
    e = edges_of(spark, [(0, 1), (1, 2), (2, 0), (0, 3)])
    got = dict(rows(ranking.pagerank(e, nodes_of(spark, 4))))
    m = np.array([[0, 0, 1, 0.25], [0.5, 0, 0, 0.25], [0, 1, 0, 0.25], [0.5, 0, 0, 0.25]])
    x = np.full(4, 0.25)
    for _ in range(200):
        x = 0.85 * m @ x + 0.15 / 4
    assert np.allclose([got[i] for i in range(4)], x, atol=1e-5)


def test_ranks_and_cutoffs(spark):
    v = np.random.default_rng(4).exponential(size=300)
    v[10] = v[20]
    s = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "id long, score double")
    order = np.lexsort((np.arange(300), -v))
    assert [i for _, i in sorted((r["rank"], r.id) for r in selection.ranked(s).collect())] == order.tolist()
    c = selection.cutoffs(s).first()
    desc = v[order]
    assert c.above_eps == (v > 1 / 400).sum() and c.last_nonzero == 300
    assert c.cumu_mass == np.flatnonzero(np.cumsum(desc) >= 0.99 * v.sum())[0] + 1
    tail = desc[15:]
    rel = np.concatenate([[0], np.abs(np.diff(tail))]) / np.maximum(tail, 1e-12)
    mean = np.convolve(rel, np.ones(50) / 50, "same")
    assert c.flat_tail == (np.flatnonzero(mean < 0.01)[0] if (mean < 0.01).any() else 300)
    assert selection.select_core(s, 0.1).count() == 30
    assert selection.select_core(s, auto=True).count() == min(c.cumu_mass, 75)


def test_trailing_zeros(spark):
    s = spark.createDataFrame([(0, 1.0), (1, 0.0), (2, 0.0)], "id long, score double")
    assert selection.cutoffs(s).first().last_nonzero == 1
    zeros = spark.createDataFrame([(0, 0.0), (1, 0.0)], "id long, score double")
    assert selection.cutoffs(zeros).first().last_nonzero == 2


def test_diffusion_reaches_and_leaves_out(spark):
    e = edges_of(spark, [(0, 1), (1, 0), (2, 2)])
    labels = spark.createDataFrame([(0, 5)], "id long, label int")
    p = diffusion.normalize(graph.adjacency(e), "sym")
    found = diffusion.diffuse(p, labels, 1.0, 50)
    assert rows(found) == [(0, 0, 1.0), (1, 0, 1.0)]
    assert rows(diffusion.hard_labels(found, nodes_of(spark, 3))) == [(0, 0), (1, 0), (2, -1)]
    assert rows(diffusion.confidence(found, nodes_of(spark, 3), "margin")) == [(0, 0, 1.0), (1, 0, 1.0), (2, 0, 0.0)]
    assert diffusion.diffuse(p, labels.limit(0)).count() == 0
    kept = diffusion.diffuse(p, labels, 0.5, 7, 0.0, save_every=5)
    assert {r.t for r in kept.select("t").distinct().collect()} == {0, 5, 7}
    with pytest.raises(ValueError):
        diffusion.propagate(e, nodes_of(spark, 3), nodes_of(spark, 0), labels)
    with pytest.raises(ValueError):
        diffusion.confidence(found, nodes_of(spark, 3), "best")


def test_diffusion_matches_numpy(spark):
    rng = np.random.default_rng(5)
    pairs = [(i, int(j)) for i in range(30) for j in rng.choice(30, 4, replace=False) if i != j]
    a = np.zeros((30, 30))
    for i, j in pairs:
        a[i, j] += 1
    a = (a + a.T) / 2
    d = a.sum(1)
    p = a / np.sqrt(d)[:, None] / np.sqrt(d)
    f = np.zeros((30, 2))
    f[:4] = [[1, 0], [0, 1], [1, 0], [0, 1]]
    hold = f.copy()
    for _ in range(8):
        f = 0.7 * f + 0.3 * p @ f
        f[:4] = hold[:4]
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "id long, label int")
    got = {(r.id, r.cls): r.score for r in diffusion.diffuse(diffusion.normalize(graph.adjacency(edges_of(spark, pairs))), labels, 0.3, 8, 0.0).collect()}
    assert all(abs(got.get((i, c), 0.0) - f[i, c]) < 1e-12 for i in range(30) for c in range(2))


def test_bins(spark):
    conf = spark.createDataFrame([(i, 0, 1.0 - i / 10) for i in range(7)] + [(10 + i, 1, 0.5) for i in range(3)], "id long, cls int, conf double")
    got = dict(rows(diffusion.bin_layers(conf)))
    assert [got[i] for i in range(7)] == [0, 0, 1, 1, 2, 3, 4] and [got[10 + i] for i in range(3)] == [0, 1, 2]


def test_walk_visits_and_densifiers(spark):
    e = edges_of(spark, [(0, 1), (0, 5), (1, 2), (2, 0), (5, 2)])
    seeds = nodes_of(spark, 1)
    assert rows(densify.random_walk_visits(e, seeds, 1)) == [(0, 1, 0.5), (0, 5, 0.5)]
    assert rows(densify.random_walk_visits(e, seeds, 1, visit_lag=True)) == [(0, 0, 1.0)]
    more = densify.densify_rw(e, nodes_of(spark, 3))
    assert (0, 2, 3) in rows(more.select("src", "dst", "pos"))
    assert not [1 for s, t in rows(more.select("src", "dst")) if s == t]
    p = points_of(spark, [[0.0], [1.0], [2.0], [9.0], [9.5], [5.0]])
    assert (0, 2) in rows(densify.densify_knn(p, e, nodes_of(spark, 3)).select("src", "dst"))
    assert densify.densify_rw(e, nodes_of(spark, 0)).count() == e.count()


def test_ranks_and_cutoffs_do_not_depend_on_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    score = np.concatenate([rng.exponential(size=300), np.zeros(40), np.full(100, 0.5)]).round(3)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(score)], "id long, score double").repartition(4)
    conf = df.select("id", (F.col("id") % 3).cast("int").alias("cls"), F.col("score").alias("conf"))
    whole = rows(selection.ranked(df).select("id", "rank")), selection.cutoffs(df).first(), rows(diffusion.bin_layers(conf, 5))
    monkeypatch.setitem(selection.ordered.__kwdefaults__, "block_rows", 37)
    monkeypatch.setattr(selection, "BLOCK_ROWS", 100)
    assert (rows(selection.ranked(df).select("id", "rank")), selection.cutoffs(df).first(), rows(diffusion.bin_layers(conf, 5))) == whole
    order = np.lexsort((np.arange(len(score)), -score))
    assert [i for _, i in sorted((k, i) for i, k in whole[0])] == order.tolist()


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "yarn"
        _jsc = SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isEmpty=lambda: True)))

        def getConf(self):
            return {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        lineage.shared_folder(Context())


def test_clip(spark):
    got = spark.createDataFrame([(-9.0,), (0.5,), (4.5,)], "x double").select(vectors.clip(F.col("x")))
    assert [r[0] for r in got.collect()] == [-4.0, 0.5, 4.0]


def test_densifying_walks_are_whole(spark):
    """more than a thousand nodes move on, and only the lighter ones lead back into the subset."""
    heavy, light = range(1, 1001), range(1001, 1501)
    pairs = [(0, i) for i in heavy for _ in range(2)] + [(0, i) for i in light] + [(i, 3000) for i in heavy] + [(i, 2000) for i in light]
    e, part = edges_of(spark, pairs), spark.createDataFrame([(0,), (2000,)], "id long")
    for held in (10**6, 0):
        more = densify.densify_rw(e, part, held_edges=held).select("src", "dst", "pos")
        assert rows(more.where("src = 0 and dst >= 2000").select("src", "dst")) == [(0, 2000)]
        assert not rows(densify.densify_rw(e, part, cap=1000, held_edges=held).where("src = 0 and dst >= 2000").select("src", "dst"))


def test_walks_in_tasks_equal_walks_by_joins(spark):
    rng = np.random.default_rng(3)
    e = edges_of(spark, [(int(a), int(b)) for a, b in rng.integers(0, 60, (400, 2)) if a < 50])
    seeds = spark.createDataFrame([(i,) for i in (0, 3, 3, 7, 55, 99)], "id long")  # one twice, one without out-edges, one not in the graph
    for cap, lag in ((None, False), (None, True), (5, False)):
        got, want = ({(r.seed, r.node): r.visits for r in densify.random_walk_visits(e, seeds, 4, 1e-3, cap, lag, held).collect()} for held in (10**6, 0))
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    part = nodes_of(spark, 30)
    assert rows(densify.densify_rw(e, part).select("src", "dst", "pos")) == rows(densify.densify_rw(e, part, held_edges=0).select("src", "dst", "pos"))


def test_walks_need_no_shuffle_of_visits(spark):
    """what a walk visits is as much as seeds times nodes, and was dealt out at every step."""
    e = edges_of(spark, [(i, (i + k) % 40) for i in range(40) for k in (1, 2, 3)])
    plan = densify.random_walk_visits(e, nodes_of(spark, 40))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "HashAggregate" not in plan


def test_top_per_row_with_ties_null_and_nan(spark):
    rng = np.random.default_rng(5)
    table = [(int(r) if r else None, i, [None, float("nan"), *map(float, range(6))][int(v)]) for i, (r, v) in enumerate(zip(rng.integers(0, 4, 3000), rng.integers(0, 8, 3000), strict=True))]
    df = spark.createDataFrame(table, "r long, c long, v double").repartition(3)
    for k in (1, 4, 400, 2000):
        want = {}
        for r, c, v in table:
            want.setdefault(r, []).append(((0 if v is None else 2 if v != v else 1), v if v is not None and v == v else 0.0, -c))
        want = sorted(((-1 if r is None else r), -x[2]) for r, xs in want.items() for x in sorted(xs, reverse=True)[:k])
        assert sorted((-1 if x.r is None else x.r, x.c) for x in densify.top_per_row(df, "r", "c", "v", k).collect()) == want


def test_descent_in_slices(monkeypatch):
    """forces are summed by counts over slices of edges; the result is that of the definition, edge by edge."""
    from lattica.functions import kernels

    rng, n, a, b = np.random.default_rng(2), 30, 1.579, 0.895
    src, dst, w, xy = rng.integers(0, n, 200), rng.integers(0, n, 200), rng.random(200), rng.normal(size=(30, 2))
    w[0] = 1.0
    monkeypatch.setattr(kernels, "SLICE", 7)
    got = kernels.descend(xy, src, dst, w, np.empty(0, int), np.empty((0, 2)), np.empty(0), 5, epochs=6)
    draw, due, at = np.random.default_rng(5), w.max() / w, xy.copy()
    for epoch in range(6):
        use, move, uses = np.flatnonzero(due <= epoch), np.zeros((n, 2)), np.zeros(n)
        due[use] += w.max() / w[use]
        for e, far in zip(use, draw.integers(0, n, (len(use), 5)), strict=True):
            gap = at[src[e]] - at[dst[e]]
            d2 = gap @ gap
            force = np.clip(-2 * a * b * d2 ** (b - 1) / (a * d2 + 1) * gap, -4, 4) if d2 > 0 else np.zeros(2)
            move[src[e]] += force
            move[dst[e]] -= force
            uses[src[e]] += 1
            uses[dst[e]] += 1
            for o in far:
                gap = at[src[e]] - at[o]
                d2 = gap @ gap
                if d2 > 0:
                    move[src[e]] += np.clip(2 * b / ((0.001 + d2) * (a * d2**b + 1)) * gap, -4, 4)
        at += (1 - epoch / 6) * move / np.sqrt(np.maximum(uses, 1))[:, None]
    assert np.abs(got - at).max() < 1e-9


def test_visits_of_a_seed_come_heaviest_first(spark):
    """F2 of r02: the result's files are smaller where equal visits lie side by side."""
    rng = np.random.default_rng(4)
    e = edges_of(spark, [(int(a), int(b)) for a, b in rng.integers(0, 60, (300, 2))])
    of = {}
    for r in densify.random_walk_visits(e, nodes_of(spark, 60)).collect():
        of.setdefault(r.seed, []).append(r.visits)
    assert max(map(len, of.values())) > 20 and all(v == sorted(v, reverse=True) for v in of.values())


def test_held_graphs_give_what_joins_give(spark):
    """small graphs took a job of shuffles for every few steps of walks, ascents and diffusion."""
    rng = np.random.default_rng(8)
    e = edges_of(spark, [(i, int(j)) for i in range(60) for j in rng.choice(70, 5, replace=False) if i != j and i % 11])
    nodes = nodes_of(spark, 65)
    walks = [dict(rows(ranking.density_walk(e, nodes, 7, held).select("id", "pi"))) for held in (10**6, 0)]
    assert walks[0].keys() == walks[1].keys() and all(abs(walks[0][k] - walks[1][k]) < 1e-12 for k in walks[0])
    init = spark.createDataFrame([(i, float(v)) for i, v in enumerate(rng.permutation(65) // 3)], "id long, pi double")
    for start, add in ((F.col("pi"), 0.0), (F.lit(0.0), 1.0)):
        a, b = (dict(rows(ranking._climb(e, init, 4, start, add, held))) for held in (10**6, 0))
        assert a.keys() == b.keys() and len(a) == 65 and all(abs(a[k] - b[k]) < 1e-12 for k in a)
    with pytest.raises(RuntimeError):
        ranking._climb(e, init.unionAll(init), 4, F.col("pi"), 0.0)
    p = diffusion.normalize(graph.adjacency(e), "sym")
    labels = spark.createDataFrame([(0, 3), (1, 7), (2, 3), (3, -1), (4, 9)], "id long, label int")
    for alpha, tol, every in ((0.1, 1e-3, None), (1.0, 0.0, None), (0.3, 0.0, 4), (0.3, 1e-2, 3)):
        a, b = (diffusion.diffuse(p, labels, alpha, 13, tol, every, held) for held in (10**6, 0))
        key = (["t"] if every else []) + ["id", "cls"]
        a, b = ({tuple(r[k] for k in key): r.score for r in x.collect()} for x in (a, b))
        assert a.keys() == b.keys() and len(a) > 60 and all(abs(a[k] - b[k]) < 1e-12 for k in a)
