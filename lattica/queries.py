"""Registered queries of the graph operators, over the embeddings table, with DuckDB SQL where SQL can express them.

The points are the embeddings with 0.3 added to those of the first eight dimensions whose parity is the label's, so that
neighbourhoods have structure; q = 20 neighbours, r = 10 for ascents. The ranked core is the top fifth; voting, diffusion
and what builds on them start from the top 60 %, as a smaller core of these points confirms next to nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.lineage import checkpoint
from .functions.vectors import squared_distance
from .operators import community, densify, diffusion, graph, layout, ranking, selection
from .plans import layered_map
from .plans.config import Config
from .plans.model import CorePeriphery
from .sources.points import gaussian_pair as gaussian_points

Q, R, FRAC, WIDE, RESOLUTION = 20, 10, 0.2, 0.6, 0.5


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    lifted = F.transform(F.col("embedding").cast("array<double>"), lambda x, j: x + F.when((j < 8) & (j % 2 == F.col("label") % 2), 0.3).otherwise(0.0))
    return raw.select(F.col("vec_id").alias("id"), lifted.alias("features"), (F.col("label") % 2).cast("int").alias("label"))


def _edges(spark, sf_dir, k: int = Q) -> tuple[DataFrame, DataFrame]:
    p = points(spark, sf_dir)
    return p, checkpoint(graph.knn_graph(p, k))


def _scored(spark, sf_dir):
    p, e = _edges(spark, sf_dir)
    return p, e, checkpoint(ranking.flowrank(e, p, R))


def _cored(spark, sf_dir):
    p, e, s = _scored(spark, sf_dir)
    return p, e, checkpoint(selection.select_core(s, WIDE).select("id"))


def knn_graph(spark, d):
    return graph.knn_graph(points(spark, d), Q).withColumn("d2", F.round("d2", 9))


def knn_truncate(spark, d):
    return graph.truncate(_edges(spark, d)[1], R).select("src", "dst", "pos")


def bipartite_knn(spark, d):
    p = points(spark, d)
    return graph.bipartite_knn(p.where("label = 0"), p.where("label = 1"), 5).withColumn("d2", F.round("d2", 9))


def edge_list_no_loops(spark, d):
    e = _edges(spark, d)[1].select("src", "dst")
    return graph.drop_self_loops(e.unionByName(e.select("src", F.col("src").alias("dst"))))


def out_degree(spark, d):
    return graph.out_degree(_edges(spark, d)[1])


def in_degree(spark, d):
    return graph.in_degree(_edges(spark, d)[1])


def induced_edges(spark, d):
    p, e = _edges(spark, d)
    return graph.induced(e, p.where("label = 1")).select("src", "dst", "pos")


def local_ids(spark, d):
    p, e = _edges(spark, d)
    return graph.local_ids(e, p.where("label = 1")).select("src", "dst", "pos")


def complement_nodes(spark, d):
    p = points(spark, d)
    return graph.complement(p, p.where("label = 1"))


def subset_degree(spark, d):
    p, e = _edges(spark, d)
    return densify.subset_degree(e, p.where("label = 1"))


def symmetrized_adjacency(spark, d):
    return graph.adjacency(_edges(spark, d)[1], "sym")


def transposed_adjacency(spark, d):
    return graph.adjacency(_edges(spark, d)[1], "in")


def cosine_sorted_adjacency(spark, d):
    p, e = _edges(spark, d)
    return graph.sorted_adjacency(e, p, "cosine").withColumn("dist", F.round("dist", 9))


def density_walk(spark, d):
    p, e = _edges(spark, d)
    return ranking.density_walk(e, p).select("id", F.round("pi", 10).alias("pi"))


def _walked(spark, d):
    p, e = _edges(spark, d)
    return e, checkpoint(ranking.density_walk(e, p))


def ascending_expectation(spark, d):
    return ranking.ascending_value(*_walked(spark, d), R).select("id", F.round("expected", 10).alias("expected"))


def ascending_hops(spark, d):
    return ranking.ascending_hops(*_walked(spark, d), R).select("id", F.round("hops", 8).alias("hops"))


def flowrank(spark, d):
    return _scored(spark, d)[2].select("id", F.round("score", 8).alias("score"))


def flowrank_core(spark, d):
    return selection.select_core(_scored(spark, d)[2], FRAC).select("id", F.col("rank").cast("long").alias("rank"))


def pagerank(spark, d):
    p, e = _edges(spark, d)
    return ranking.pagerank(e, p, tol=None, max_iter=10).select("id", F.round("score", 9).alias("score"))


def pagerank_tolerance(spark, d):
    p, e = _edges(spark, d)
    return ranking.pagerank(e, p).select("id", F.round("score", 9).alias("score"))


def out_adjacency(spark, d):
    return graph.adjacency(_edges(spark, d)[1], "out")


def indegree_rank(spark, d):
    p, e = _edges(spark, d)
    return ranking.indegree_rank(e, p)


def cutoffs(spark, d):
    return selection.cutoffs(_scored(spark, d)[2]).select("last_nonzero", "above_eps", "cumu_mass", "flat_tail")


def auto_core(spark, d):
    return selection.select_core(_scored(spark, d)[2], auto=True).select("id")


def _labelled(spark, d):
    p, e, core = _cored(spark, d)
    return p, e, core, p.join(core, "id", "left_semi").select("id", "label")


def majority_round(spark, d):
    p, e, core, labels = _labelled(spark, d)
    return community.majority_round(e, labels, graph.complement(p, core))


def recursive_majority(spark, d):
    p, e, core, labels = _labelled(spark, d)
    return community.recursive_majority(e, labels, graph.complement(p, core), p.count())


def core_self_check(spark, d):
    p, e, core, labels = _labelled(spark, d)
    return community.recursive_majority(e, labels, core, p.count()).select("id", "label")


def _turned(labels):
    """Three deterministic labellings that stand for three seeds: the label, and it with every 11th or 13th id turned."""
    seeds = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("seed")
    turned = F.when(F.col("seed") == 0, F.col("label")).when(F.col("id") % (9 + 2 * F.col("seed")) == 0, 1 - F.col("label")).otherwise(F.col("label"))
    return labels.select(seeds, "id", "label").select("seed", "id", turned.alias("label"))


def consensus_intersection(spark, d):
    p, e, core, labels = _labelled(spark, d)
    return community.consensus(community.recursive_majority(e, _turned(labels), core, p.count()), 3)


def fine_grained_vote(spark, d):
    p, e, s = _scored(spark, d)
    stable, few = (checkpoint(selection.select_core(s, share).select("id")) for share in (WIDE, FRAC))
    labels = _turned(p.join(few, "id", "left_semi").select("id", "label"))
    return community.confirmed_layers(p, checkpoint(graph.induced(e, stable)), stable, few, seeds=(0, 1, 2), labels=labels)


def rw_normalized(spark, d):
    return diffusion.normalize(graph.adjacency(_edges(spark, d)[1]), "rw").withColumn("w", F.round("w", 12))


def sym_normalized(spark, d):
    return diffusion.normalize(graph.adjacency(_edges(spark, d)[1]), "sym").withColumn("w", F.round("w", 12))


def _diffused(spark, d):
    p, e, core, labels = _labelled(spark, d)
    return p, core, checkpoint(diffusion.diffuse(diffusion.normalize(graph.adjacency(e), "sym"), labels, 0.1, 5, 0.0))


def diffusion_5(spark, d):
    return _diffused(spark, d)[2].select("id", "cls", F.round("score", 10).alias("score"))


def diffusion_tolerance(spark, d):
    _, e, _, labels = _labelled(spark, d)
    return diffusion.diffuse(diffusion.normalize(graph.adjacency(e), "sym"), labels, 0.1).select("id", "cls", F.round("score", 10).alias("score"))


def diffusion_snapshots(spark, d):
    _, e, _, labels = _labelled(spark, d)
    return diffusion.diffuse(diffusion.normalize(graph.adjacency(e), "sym"), labels, 0.1, 5, 0.0, save_every=2).select("t", "id", "cls", F.round("score", 10).alias("score"))


def hard_labels(spark, d):
    p, _, found = _diffused(spark, d)
    return diffusion.hard_labels(found, p)


def _confidence(spark, d, method):
    p, core, found = _diffused(spark, d)
    return diffusion.confidence(found, graph.complement(p, core), method).select("id", "cls", F.round("conf", 9).alias("conf"))


def conf_argmax(spark, d):
    return _confidence(spark, d, "argmax_conf")


def conf_margin(spark, d):
    return _confidence(spark, d, "margin")


def conf_entropy(spark, d):
    return _confidence(spark, d, "entropy")


def layer_ntile(spark, d):
    return diffusion.bin_layers(_confidence(spark, d, "argmax_conf"), 5)


def densify_knn_edges(spark, d):
    p, e, core = _cored(spark, d)
    return densify.densify_knn(p, e, core).select("src", "dst", "pos")


def rw_visits(spark, d):
    _, e, core = _cored(spark, d)
    # As F.round, which goes by decimal numbers and takes longer than the walks do.
    return densify.random_walk_visits(e, core).select("seed", "node", (F.rint(F.col("visits") * 1e10) / 1e10).alias("visits"))


def densify_rw_edges(spark, d):
    _, e, core = _cored(spark, d)
    return densify.densify_rw(e, core).select("src", "dst", "pos")


def heat_kernel_weights(spark, d):
    p, e = _edges(spark, d)
    return layout.layout_edges(e, p).select("src", "dst", F.round("w", 8).alias("w"))


def epochs_per_sample(spark, d):
    p, e = _edges(spark, d)
    return layout.epochs_per_sample(layout.layout_edges(e, p)).select("src", "dst", F.round("eps", 6).alias("eps"))


def _layers(spark, d):
    p, core, found = _diffused(spark, d)
    rest = graph.complement(p, core)
    # Ranks are of rounded confidences, so that the last bits of sums don't decide.
    conf = diffusion.confidence(found, rest).withColumn("conf", F.round("conf", 9))
    return p, core.select("id", F.lit(0).alias("layer")).unionByName(diffusion.bin_layers(conf, 5, 1))


def _flat(p):
    return p.select("id", F.col("features")[0].alias("x"), F.col("features")[1].alias("y"))


def cumulative_layers(spark, d):
    p, layers = _layers(spark, d)
    return layout.cumulative_layers(layers, _flat(p)).select("round", "id", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


def anchor_means(spark, d):
    p = points(spark, d)
    return layout.anchor_means(p.select(F.col("label").alias("aid"), "features")).select("aid", F.posexplode("mean").alias("pos", "m")).select("aid", F.col("pos").cast("long").alias("pos"), F.round("m", 10).alias("m"))


def axis_ranges(spark, d):
    found = layered_map.axis_ranges(_flat(points(spark, d)))
    return found.select(*[F.round(c, 9).alias(c) for c in found.columns])


def trace_summary(spark, d):
    p, layers = _layers(spark, d)
    return layered_map.traces(layout.cumulative_layers(layers, _flat(p)), p).select("round", "label", "n")


def leiden_core(spark, d):
    _, e, core = _cored(spark, d)
    return community.leiden(e, core, RESOLUTION)


def stable_core(spark, d):
    p, e, s = _scored(spark, d)
    return community.stable_core(p, e, s, WIDE, resolution=RESOLUTION)[0]


def fine_grained_core(spark, d):
    p, e, s = _scored(spark, d)
    core, e = community.stable_core(p, e, s, WIDE, resolution=RESOLUTION)
    return community.fine_grained_core(p, e, core, FRAC, starting_resolution=RESOLUTION)[0]


def gmm_anchors(spark, d):
    p, e, core = _cored(spark, d)
    return layout.find_anchors(p, e, core, "smoothed", RESOLUTION)


def gmm_anchors_default(spark, d):
    p, e, core = _cored(spark, d)
    return layout.find_anchors(p, e, core, "default", RESOLUTION)


def anchor_pulls(spark, d):
    p, _, core, labels = _labelled(spark, d)
    own = labels.withColumnRenamed("label", "aid").join(p.select("id", "features"), "id")
    far = F.sqrt(squared_distance(F.col("features"), F.col("mean")))
    anchors = checkpoint(own.join(layout.anchor_means(own), "aid").select("aid", "id", far.alias("dist"), F.lit(None).cast("double").alias("prob")))
    return layout.anchor_edges(anchors, _flat(p)).select("id", *[F.round(c, r).alias(c) for c, r in (("ax", 9), ("ay", 9), ("w", 8))])


def cluster_core(spark, d):
    p, e, core = _cored(spark, d)
    return community.cluster_core(p, e, core, RESOLUTION)


def choose_resolution(spark, d):
    p, e, core = _cored(spark, d)
    found = community.choose_resolution(e, p, core, start=RESOLUTION)
    return spark.range(1).select(F.lit(found).alias("resolution"))


def cutoff_knee(spark, d):
    return selection.cutoffs(_scored(spark, d)[2]).select("knee")


def knn_lsh(spark, d):
    return graph.knn_graph(points(spark, d), Q, method="lsh").select("src", "dst", "pos")


def knn_lsh_recall(spark, d):
    """The share of the exact graph's edges that the approximate one has, with buckets of about 64 points."""
    p, exact = _edges(spark, d)
    found = graph.knn_graph(p, Q, method="lsh", occupancy=64)
    return exact.join(found.select("src", "dst", F.lit(1).alias("hit")), ["src", "dst"], "left").agg((F.count("hit") / F.count("*")).alias("recall"))


def top_per_row(spark, d):
    return densify.top_per_row(rw_visits(spark, d), "seed", "node", "visits", 5, nonzero=True).select("seed", "node")


def pca_embedding(spark, d):
    return layout.pca_embedding(points(spark, d))


def spectral_embedding(spark, d):
    p, e = _edges(spark, d)
    return layout.spectral_embedding(layout.layout_edges(e, p), p)


def gaussian_pair(spark, d):
    return gaussian_points(spark, 1000)


def hops_ranking(spark, d):
    return ranking.hops_ranking(points(spark, d), Q, R).select("id", F.round("score", 8).alias("score"))


def _model(spark, d) -> CorePeriphery:
    config = Config(q=Q, r=R, core_frac=WIDE, granularity=RESOLUTION, resolution=RESOLUTION)
    return CorePeriphery(points(spark, d).select("id", "features"), **config.unpack())


def full_pipeline(spark, d):
    m = _model(spark, d).run()
    return m.labels_.join(m.layers_, "id").join(m.scores_, "id").select("id", "label", "layer", "score")


def anchored_layout(spark, d):
    return layered_map.run_with_map(_model(spark, d), fast_view=False).layout_


_ALL = (
    knn_graph, knn_truncate, bipartite_knn, edge_list_no_loops, out_degree, in_degree, induced_edges, local_ids, complement_nodes, subset_degree,
    symmetrized_adjacency, transposed_adjacency, cosine_sorted_adjacency, density_walk, ascending_expectation, ascending_hops, flowrank,
    flowrank_core, pagerank, indegree_rank, hops_ranking, cutoffs, auto_core, majority_round, recursive_majority, core_self_check, consensus_intersection,
    rw_normalized, sym_normalized, diffusion_5, hard_labels, conf_argmax, conf_margin, conf_entropy, layer_ntile, densify_knn_edges, rw_visits,
    densify_rw_edges, heat_kernel_weights, epochs_per_sample, cumulative_layers, anchor_means, axis_ranges, trace_summary, leiden_core, stable_core,
    fine_grained_core, gmm_anchors, full_pipeline, anchored_layout, cluster_core, choose_resolution, cutoff_knee, knn_lsh, top_per_row, pca_embedding, gaussian_pair,
    knn_lsh_recall, pagerank_tolerance, out_adjacency, diffusion_tolerance, diffusion_snapshots, fine_grained_vote, gmm_anchors_default, anchor_pulls, spectral_embedding,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    from .oracle import SQL

    return dict(SQL)
