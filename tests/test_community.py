import numpy as np
import pytest
from pyspark.sql import functions as F
from test_graph import edges_of, nodes_of, points_of, rows

from lattica.functions import kernels, lineage
from lattica.operators import community, graph, layout
from lattica.plans.config import Config
from lattica.plans.layered_map import PALETTE, LayeredMap, figure_spec
from lattica.plans.model import CorePeriphery
from lattica.sources.points import as_points, gaussian_pair, read_points, write_results


def cliques(sizes, bridge=True):
    pairs, at = [], 0
    for n in sizes:
        pairs += [(at + i, at + j) for i in range(n) for j in range(n) if i != j]
        at += n
    return pairs + ([(0, sizes[0])] if bridge else [])


def test_leiden_finds_cliques_and_beats_trivial_cuts():
    pairs = np.array(cliques([6, 5, 4]))
    for seed in range(5):
        label = kernels.leiden(15, pairs[:, 0], pairs[:, 1], 1.0, seed)
        assert label.tolist() == [0] * 6 + [1] * 5 + [2] * 4
    g = kernels.graph(15, pairs[:, 0], pairs[:, 1], np.ones(len(pairs)))
    assert kernels.quality(g, label, 1.0) > max(kernels.quality(g, np.zeros(15, int), 1.0), kernels.quality(g, np.arange(15), 1.0))


def test_leiden_table_is_the_same_each_time(spark):
    e = edges_of(spark, cliques([4, 4]))
    a, b = (rows(community.leiden(e, nodes_of(spark, 8), 1.0, (3, 9))) for _ in range(2))
    assert a == b and len(a) == 16
    alone = rows(community.leiden(edges_of(spark, [(0, 1), (1, 0)]), nodes_of(spark, 3), 1.0, (0,)))
    assert len({label for _, _, label in alone}) == 2  # a node without edges is a community of its own


def test_votes(spark):
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 1)], "id long, label int")
    tie = edges_of(spark, [(0, 1), (0, 2), (0, 3), (0, 4)])
    half = edges_of(spark, [(0, 1), (0, 2), (0, 8), (0, 9)])
    more = edges_of(spark, [(0, 1), (0, 2), (0, 8)])
    mask = nodes_of(spark, 1)
    assert rows(community.majority_round(tie, labels, mask)) == []
    assert rows(community.majority_round(half, labels, mask)) == []
    assert rows(community.majority_round(more, labels, mask)) == [(0, 0)]


def test_rounds_and_consensus(spark):
    e = edges_of(spark, [(1, 0), (2, 1), (3, 2)])
    labels = spark.createDataFrame([(0, 0, 7), (1, 0, 7)], "seed int, id long, label int")
    found = community.recursive_majority(e, labels, nodes_of(spark, 4).where("id > 0"), 4)
    assert rows(found.where("seed = 0")) == [(0, 1, 7, 1), (0, 2, 7, 2), (0, 3, 7, 3)]
    assert rows(community.consensus(found, 2)) == [(1,), (2,), (3,)]
    assert community.consensus(found, 3).count() == 0


def test_mixtures():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(0, 1, (60, 3)), rng.normal(8, 1, (60, 3))])
    m = kernels.choose_mixture(x)
    assert len(m.weights) == 2 and abs(m.weights[0] - 0.5) < 0.05
    assert len(kernels.choose_mixture(rng.normal(size=(50, 3))).weights) == 1
    p = m.membership(x)
    assert np.allclose(p.sum(1), 1) and (p[:60].argmax(1) == p[0].argmax()).all()


def test_a_larger_mixture_is_taken_for_any_fall_of_bic(monkeypatch):
    class Fake:
        def __init__(self, k, bic):
            self.weights, self.k, self._bic = np.full(k, 1 / k), k, bic

        def bic(self, n):
            return self._bic

    def chosen(*bics):
        monkeypatch.setattr(kernels, "diagonal_mixture", lambda x, k, seed: Fake(k, bics[k - 1]))
        return kernels.choose_mixture(np.zeros((200, 2)), 1, len(bics) + 1).k

    assert chosen(765.1, 758.8) == 2  # lower, by less than growing on needs
    assert chosen(765.1, 758.8, 1.0) == 2  # but the search ends there
    assert chosen(765.1, 766.0, 1.0) == 1
    assert chosen(765.1, 700.0, 650.0) == 3


def test_fine_votes_are_on_the_induced_graph(spark):
    # Node 0 has two neighbours in the core and three outside the stable core: a majority of the induced edges only.
    e = edges_of(spark, [(0, 1), (0, 2), (0, 7), (0, 8), (0, 9), (1, 0), (1, 2), (2, 0), (2, 1), (3, 4), (4, 3), (4, 7), (7, 8)])
    p = points_of(spark, [[float(i)] for i in range(10)])
    stable, core = nodes_of(spark, 5), nodes_of(spark, 4)
    labels = spark.createDataFrame([(s, i, 0 if i < 3 else 1) for s in (0, 1) for i in range(4)], "seed int, id long, label int")
    found = community.confirmed_layers(p, graph.induced(e, stable), stable, core, seeds=(0, 1), labels=labels)
    assert rows(found) == [(0, 0), (1, 0), (2, 0), (3, 1), (4, 1)]


def test_voting_equals_a_plain_model(spark):
    rng = np.random.default_rng(5)
    n, pairs = 60, [(i, int(j)) for i in range(60) for j in rng.choice(60, 6, replace=False) if i != j]
    out = {}
    for i, j in pairs:
        out.setdefault(i, []).append(j)
    start = {i: int(i < 15) for i in range(30)}
    mask, label, rounds, kept = set(range(30, 60)), dict(start), 0, {}
    while True:
        before, won = len(label), {}
        for i in sorted(mask):
            votes = [label[j] for j in out.get(i, ()) if j in label]
            for c in set(votes):
                if votes.count(c) > 0.5 * len(out[i]):
                    won[i] = c
        changed = {i for i, c in won.items() if label.get(i) != c}
        label.update(won)
        kept.update(won)
        rounds += 1
        if len(label) - before < int(0.005 * n) or before > 0.95 * n or not changed:
            break
    labels = spark.createDataFrame(list(start.items()), "id long, label int")
    found = community.recursive_majority(edges_of(spark, pairs), labels, nodes_of(spark, n).where("id >= 30"), n)
    assert rows(found.select("id", "label")) == sorted(kept.items()) and found.agg({"round": "max"}).first()[0] <= rounds


def test_stages_are_timed(caplog):
    with caplog.at_level("INFO", "lattica"), lineage.timed("ranking"):
        pass
    assert [r.message.split(":")[0] for r in caplog.records] == ["ranking", "ranking"]


def test_descent_pulls_towards_anchors():
    xy = np.random.default_rng(0).normal(size=(6, 2)) * 2
    none = np.empty(0, int)
    pulled = kernels.descend(xy, none, none, np.empty(0), np.arange(6), np.tile([3.0, 3.0], (6, 1)), np.ones(6), seed=1, epochs=100)
    assert (np.linalg.norm(pulled - 3, axis=1) < np.linalg.norm(xy - 3, axis=1)).all()
    args = (np.array([0, 1]), np.array([1, 2]), np.ones(2), np.arange(6), np.tile([3.0, 3.0], (6, 1)), np.ones(6))
    a, b = kernels.descend(xy, *args, seed=1, epochs=60), kernels.descend(xy, *args, seed=1, epochs=60)
    assert (a == b).all() and np.isfinite(a).all()
    still = kernels.descend(xy, np.array([0]), np.array([1]), np.ones(1), none, np.empty((0, 2)), np.empty(0), seed=1, epochs=1)
    assert (still == xy).all()  # the heaviest edge is due in epoch 1
    assert kernels.epochs_per_sample(np.array([2.0, 1.0, 0.0])).tolist() == [1.0, 2.0, -1.0]


def test_spectral_start_parts_two_groups(spark):
    pairs = np.array(cliques([12, 9]))
    xy = kernels.spectral(21, pairs[:, 0], pairs[:, 1], np.ones(len(pairs)))
    assert len(set(np.sign(xy[:12, 0]))) == len(set(np.sign(xy[12:, 0]))) == 1 and xy[0, 0] * xy[15, 0] < 0 and np.abs(xy).max() <= 10.01
    dense = np.zeros((21, 21))
    np.add.at(dense, (pairs[:, 0], pairs[:, 1]), 0.5)
    dense += dense.T.copy()
    d = dense.sum(1)
    second = np.linalg.eigh(dense / np.sqrt(d[:, None] * d))[1][:, -2]
    assert abs(np.corrcoef(second, xy[:, 0])[0, 1]) > 0.999
    e = edges_of(spark, [*map(tuple, pairs.tolist()), (30, 0)]).withColumn("w", F.lit(1.0))
    got = layout.spectral_embedding(e, spark.range(22))
    assert [r.id for r in got.orderBy("id").collect()] == list(range(22))  # edges to others are left out, lone nodes stay
    assert layout.spectral_embedding(e, spark.range(0)).count() == 0


def test_colours_are_many():
    assert len(set(PALETTE)) == len(PALETTE) == 120


def test_config():
    c = Config(q=40, r=15, core_frac=0.3, granularity=0.7, resolution=0.4, densify="knn").configure()
    assert (c.flowrank.q, c.flowrank.r, c.stable.core_frac, c.fine.core_frac) == (40, 15, 0.3, 0.3)
    assert (c.stable.resolution, c.fine.starting_resolution, c.cluster.resolution) == (0.7, 0.7, 0.4)
    assert c.cluster.densification == c.fine.second_densification == "knn"
    c.stable.densification = "rw"
    c.densify = False
    assert c.configure().stable.densification is False and c.summary()["stable"]["core_frac"] == 0.3
    with pytest.raises(ValueError):
        Config(densify=True).configure()


def test_model_separates_two_gaussians(spark):
    truth = gaussian_pair(spark, 240, gamma=2.0)
    p = truth.select("id", "features")
    config = Config(q=15, r=8, core_frac=0.4, granularity=0.5, resolution=0.5)
    model = CorePeriphery(p, **config.unpack(), seeds=(0, 1))
    with pytest.raises(ValueError):
        model.stable_core()
    with pytest.raises(ValueError):
        model.update_config("graph", q=3)
    assert model.run(fine_grained=True) is model
    label = dict(rows(model.labels_))
    layer = dict(rows(model.layers_))
    assert len(label) == len(layer) == 240 and set(layer.values()) == set(range(6))
    want = {r.id: r.label for r in truth.collect()}
    groups: dict = {}
    for i, c in label.items():
        if c >= 0:
            groups.setdefault(c, []).append(want[i])
    assert sum(max(g.count(0), g.count(1)) for g in groups.values()) / sum(map(len, groups.values())) > 0.95
    quick = LayeredMap(model, fast_view=True, epochs=20)
    full = LayeredMap(model, quick.embedding_, fast_view=False, epochs=20)
    shown = {k: full.layout_.where(f"round = {k}").count() for k in range(6)}
    assert shown[5] == 240 and list(shown.values()) == sorted(shown.values())
    spec = figure_spec(quick, model.labels_)
    assert len(spec["layout"]["sliders"][0]["steps"]) == 6 and spec["layout"]["title"] == "Layer 0"
    assert sum(len(t["x"]) for t in spec["data"] if t["visible"]) == layer_count(layer, 0)
    for k, step in enumerate(spec["layout"]["sliders"][0]["steps"]):
        shown = [t for t, on in zip(spec["data"], step["args"][0]["visible"], strict=True) if on]
        assert sum(len(t["x"]) for t in shown) == sum(layer_count(layer, j) for j in range(k + 1)) and len({t["name"] for t in shown}) == len(shown)
    with pytest.raises(ValueError):
        figure_spec(quick, model.labels_, most=10)


def layer_count(layer, k):
    return sum(v == k for v in layer.values())


def test_sources(spark, tmp_path):
    p = points_of(spark, [[1.0], [2.0]])
    write_results(str(tmp_path), points=p)
    assert rows(read_points(spark, str(tmp_path / "points")).select("id")) == [(0,), (1,)]
    assert as_points(p.unionByName(spark.createDataFrame([(None, [1.0]), (5, None)], p.schema))).count() == 2
    with pytest.raises(ValueError):
        as_points(p, "key")


def test_seeds_have_tasks_of_their_own(spark):
    """dealt by hash, ten seeds met in a few tasks."""
    e = edges_of(spark, cliques([5, 5]))
    plan = community.leiden(e, nodes_of(spark, 10), 1.0)._jdf.queryExecution().toString()
    assert "rangepartitioning(seed" in plan and len(rows(community.leiden(e, nodes_of(spark, 10), 1.0))) == 100


def test_map_is_made_beside_the_model_and_finds_communities_once(spark, monkeypatch):
    """the embedding waited for the whole model, and the core's communities were found again for the anchors."""
    from lattica.plans import layered_map

    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(0, 0.5, (30, 4)), rng.normal(3, 0.5, (30, 4))])
    points = points_of(spark, x.tolist())
    new = lambda: CorePeriphery(points, **Config(q=6, r=3, core_frac=0.6, granularity=0.5, resolution=0.5).unpack(), seeds=(0, 1))
    apart = LayeredMap(new().run(), fast_view=False, epochs=20)
    found = []
    monkeypatch.setattr(layout, "leiden", lambda *a, f=layout.leiden: found.append(1) or f(*a))
    beside = layered_map.run_with_map(new(), fast_view=False, epochs=20)
    assert not found and rows(beside.layout_) == rows(apart.layout_) and beside.layout_.count() >= 60
    model = new().run()
    assert model.communities(0.5, 0) is not None and model.communities(0.7, 0) is None and model.communities(0.5, 1) is None
