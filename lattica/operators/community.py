"""Communities, majority voting and consensus: the stable core."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.lineage import checkpoint
from .densify import densify_knn, densify_rw
from .graph import complement, induced, out_degree
from .ranking import flowrank
from .selection import select_core

SEEDS = tuple(range(10))
#: Shares of n: a round that adds fewer nodes ends the voting; so does a labelled share this large before a round.
TOLERANCE, ENOUGH, MAX_ROUNDS = 0.005, 0.95, 500


def leiden(edges: DataFrame, nodes: DataFrame, resolution: float = 1.0, seeds: Sequence[int] = SEEDS) -> DataFrame:
    """seed, id, label: communities of the induced graph, once per seed; labels count from 0 by falling size.

    Each seed is one task, which holds the induced graph of the nodes: the core, not the whole table.
    """
    # A self-loop for each node, so that nodes without edges are there too.
    inside = induced(edges, nodes).select("src", "dst").unionAll(nodes.select(F.col("id").alias("src"), F.col("id").alias("dst")))
    each = F.explode(F.array(*[F.lit(int(s)) for s in seeds]))
    # By hash, several seeds would meet in one task while others have none.
    dealt = checkpoint(inside).withColumn("seed", each).repartitionByRange(len(seeds), "seed") if len(seeds) > 1 else inside.withColumn("seed", each)

    def run(t: pa.Table) -> pa.Table:
        src, dst = t.column("src").to_numpy(), t.column("dst").to_numpy()
        order = np.lexsort((dst, src))
        ids, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
        seed = t.column("seed")[0].as_py()
        label = kernels.leiden(len(ids), at[: len(src)][order], at[len(src) :][order], resolution, seed)
        return pa.table({"seed": pa.array([seed] * len(ids), pa.int32()), "id": ids, "label": pa.array(label, pa.int32())})

    return dealt.groupBy("seed").applyInArrow(run, "seed int, id long, label int")


def majority_round(edges: DataFrame, labels: DataFrame, mask: DataFrame, degree: DataFrame | None = None) -> DataFrame:
    """[seed,] id, label: nodes of mask(id) of whose out-edges more than half lead to one label.

    All out-edges count below the line, unlabelled ends and repeats too. A vote is on the labels as given.
    """
    key = [c for c in ("seed",) if c in labels.columns]
    degree = degree if degree is not None else out_degree(edges)
    votes = edges.select("src", "dst").join(labels.withColumnRenamed("id", "dst"), "dst").groupBy(*key, F.col("src").alias("id"), "label").agg(F.count("*").alias("votes"))
    # A strict majority is unique, so no ranking of labels is needed.
    won = votes.join(degree, "id").where(F.col("votes") > 0.5 * F.col("deg"))
    return won.join(mask.select("id"), "id", "left_semi").select(*key, "id", "label")


def recursive_majority(edges: DataFrame, labels: DataFrame, mask: DataFrame, n: int, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """[seed,] id, label, round: nodes of mask that voting labels, in rounds, each on the labels of all before.

    A run (per seed) ends after a round that adds fewer than int(0.005 n) nodes, or that began with over 0.95 n labelled.
    Nodes already labelled vote again each round; those that lose or change their majority keep their latest label.
    """
    own = labels if "seed" in labels.columns else labels.withColumn("seed", F.lit(0))
    degree = checkpoint(out_degree(edges))
    edges = checkpoint(edges.select("src", "dst"))
    tolerance = int(TOLERANCE * n)
    state = checkpoint(own.select("seed", "id", "label"))
    found = state.limit(0).select("seed", "id", "label", F.lit(0).alias("round"))
    size = {r.seed: r.n for r in state.groupBy("seed").agg(F.count("*").alias("n")).collect()}  # a handful of seeds
    running, ended = list(size), set()
    for number in range(1, max_rounds + 3):
        if not running:
            break
        here = state.where(F.col("seed").isin(running))
        won = majority_round(edges, here, mask, degree)
        won = checkpoint(won.join(here.withColumnRenamed("label", "old"), ["seed", "id"], "left").select("seed", "id", "label", "old"))
        told = {r.seed: r for r in won.groupBy("seed").agg(F.expr("count_if(old is null)").alias("new"), F.expr("count_if(old is null or old <> label)").alias("changed")).collect()}
        for s in running:
            new, changed = (told[s].new, told[s].changed) if s in told else (0, 0)
            if new < tolerance or size[s] > ENOUGH * n or (tolerance == 0 and not changed):
                ended.add(s)
            size[s] += new
        won = won.drop("old")
        state = checkpoint(state.join(won, ["seed", "id"], "left_anti").unionByName(won))
        found = found.unionByName(won.withColumn("round", F.lit(number)))
        running = [s for s in running if s not in ended]
    latest = Window.partitionBy("seed", "id").orderBy(F.desc("round"))
    first = Window.partitionBy("seed", "id")
    out = found.withColumn("k", F.row_number().over(latest)).withColumn("first", F.min("round").over(first)).where("k = 1")
    out = out.select("seed", "id", "label", F.col("first").alias("round"))
    return out if "seed" in labels.columns else out.drop("seed")


def consensus(found: DataFrame, n_seeds: int) -> DataFrame:
    """id of the nodes that are in every seed's set."""
    return found.groupBy("id").agg(F.count_distinct("seed").alias("n")).where(F.col("n") == n_seeds).select("id")


def consensus_core(edges: DataFrame, nodes: DataFrame, core: DataFrame, mask: DataFrame | None, resolution: float, seeds: Sequence[int] = SEEDS, labels: DataFrame | None = None) -> DataFrame:
    """id: nodes of mask (all but the core if None) that voting labels under every seed's communities of the core."""
    labels = labels if labels is not None else checkpoint(leiden(edges, core, resolution, seeds))
    mask = mask if mask is not None else complement(nodes, core)
    return consensus(recursive_majority(edges, labels, mask, nodes.count()), len(seeds))


def _densified(points: DataFrame, edges: DataFrame, part: DataFrame, how: bool | str) -> DataFrame:
    if not how:
        return edges
    if how in ("knn", "k-nn"):
        return densify_knn(points, edges, part)
    if how in ("rw", "random-walk"):
        return densify_rw(edges, part)
    raise ValueError(f"densification {how!r} is not False, knn or rw")


def stable_core(points: DataFrame, edges: DataFrame, scores: DataFrame, core_frac: float = 0.15, auto: bool = False, resolution: float = 1.0, densification: bool | str = False, seeds: Sequence[int] = SEEDS) -> tuple[DataFrame, DataFrame]:
    """(id of the stable core, edges, densified if asked): what consensus absorbs of the rest, and what it confirms of the core."""
    core = checkpoint(select_core(scores, core_frac, auto).select("id"))
    edges = checkpoint(_densified(points, edges, core, densification))
    labels = checkpoint(leiden(edges, core, resolution, seeds))
    rest = consensus_core(edges, points, core, None, resolution, seeds, labels)
    own = consensus_core(edges, points, core, core, resolution, seeds, labels)
    return checkpoint(rest.unionByName(own).distinct()), edges


def fine_grained_core(points: DataFrame, edges: DataFrame, stable: DataFrame, core_frac: float = 0.2, auto: bool = False, starting_resolution: float = 1.5, densification: bool | str = False, second_densification: bool | str = False, r: int = 10, seeds: Sequence[int] = SEEDS) -> tuple[DataFrame, DataFrame]:
    """(layers(id, layer): the confirmed part of the stable core's core is 0, its rest 1; edges, densified if asked).

    Ranking, second densification and votes are on the graph that the stable core induces. The core's size is a fraction of all
    points, so it may take in the whole stable core.
    """
    edges = checkpoint(_densified(points, edges, stable, densification))
    inside = checkpoint(induced(edges, stable))
    scores = checkpoint(flowrank(inside, stable, r))
    core = checkpoint(select_core(scores, core_frac, auto, points.count()).select("id"))
    return confirmed_layers(points, inside, stable, core, starting_resolution, second_densification, seeds), edges


def confirmed_layers(points: DataFrame, inside: DataFrame, stable: DataFrame, core: DataFrame, resolution: float = 1.5, densification: bool | str = False, seeds: Sequence[int] = SEEDS, labels: DataFrame | None = None) -> DataFrame:
    """layers(id, layer) of the stable core: 0 for the nodes of `core` that every seed's votes over the induced edges confirm, else 1.

    labels(seed, id, label), if given, stand for the communities."""
    own_points = points.join(stable.select("id"), "id", "left_semi")
    graph = checkpoint(_densified(own_points, inside, core, densification))
    own = checkpoint(consensus_core(graph, stable, core, core, resolution, seeds, labels))
    rest = complement(stable, own)
    return checkpoint(own.withColumn("layer", F.lit(0)).unionByName(rest.withColumn("layer", F.lit(1))))


def choose_resolution(edges: DataFrame, nodes: DataFrame, core: DataFrame, threshold: float = 0.95, start: float = 0.5, step: float = 0.25, most: float = 5.0, seeds: Sequence[int] = SEEDS) -> float:
    """Raise the resolution until voting confirms at most `threshold` of the core, or `most` is reached; 0.5 below where it stopped."""
    n0, t = core.count(), start
    while True:
        kept = consensus_core(edges, nodes, core, core, t, seeds).count()
        t += step
        if kept <= threshold * n0 or t >= most:
            return t - 0.5


def cluster_core(points: DataFrame, edges: DataFrame, core: DataFrame, resolution: float = 1.0, auto_resolution: bool = False, densification: bool | str = False, seed: int = 0, seeds: Sequence[int] = SEEDS) -> DataFrame:
    """labels(id, label) of the core's nodes."""
    edges = checkpoint(_densified(points, edges, core, densification))
    if auto_resolution:
        resolution = choose_resolution(edges, points, core, start=resolution, seeds=seeds)
    return leiden(edges, core, resolution, (seed,)).select("id", "label")
