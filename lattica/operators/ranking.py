"""Rankings of graph nodes: density walk, relative density along ascents, hops, PageRank."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import checkpoint
from .graph import in_degree, knn_graph, out_degree, truncate

#: Keeps the ratio finite; it also biases scores once a node's mass, about 1/n, comes near it.
EPS = 1e-5
#: Steps planned together between two checkpoints.
UNROLL = 6
#: Edges up to which one task holds the graph, which spares shuffles at every step; larger graphs go by joins.
HELD_EDGES = 4_000_000


def _held(edges: DataFrame, nodes: DataFrame, run, name: str) -> DataFrame:
    """id and what run(own, v, n, src, dst, w) gives for each row of nodes(id, v); nodes are numbered from 0 to n. null is left out."""
    rows = nodes.select("id", F.lit(None).cast("long").alias("to"), "v").unionByName(edges.select(F.col("src").alias("id"), F.col("dst").alias("to"), F.col("w").alias("v")))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if not parts:
            return
        t = pa.Table.from_batches(parts).sort_by([("id", "ascending"), ("to", "ascending")])
        edge = t.column("to").is_valid().to_numpy()
        e, own = t.filter(pa.array(edge)), t.filter(pa.array(~edge))
        ids, at = np.unique(np.concatenate([own.column("id").to_numpy(), e.column("id").to_numpy(), e.column("to").to_numpy()]), return_inverse=True)
        at, src, dst = np.split(at, [own.num_rows, own.num_rows + e.num_rows])
        found = run(at, own.column("v").to_numpy(), len(ids), src, dst, e.column("v").to_numpy())
        keep = ~np.isnan(found)
        yield pa.RecordBatch.from_arrays([pa.array(ids[at[keep]]), pa.array(found[keep])], ["id", name])

    return rows.coalesce(1).mapInArrow(task, f"id long, {name} double")


def _weighted(edges: DataFrame) -> DataFrame:
    """src, dst, w: each edge's share of its node's out-edges; repeated edges are summed first."""
    degree = out_degree(edges).withColumnRenamed("id", "src")
    return edges.groupBy("src", "dst").agg(F.count("*").alias("n")).join(degree, "src").select("src", "dst", (F.col("n") / F.col("deg")).alias("w"))


def _walked(own: np.ndarray, v: np.ndarray, n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray, steps: int) -> np.ndarray:
    pi = np.bincount(own, v, n)
    for _ in range(steps):
        pi = np.bincount(dst, w * pi[src], n)
    return pi[own]


def _climbed(own: np.ndarray, v: np.ndarray, n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray, add: float) -> np.ndarray:
    value, up = np.full(n, np.nan), np.bincount(src, minlength=n)
    top = up[own] == 0
    value[own[top]] = v[top]
    while len(src):
        known = ~np.isnan(value[dst])
        ready = np.bincount(src[known], minlength=n) == up
        ready &= np.isnan(value) & (up > 0)
        if not ready.any():
            break
        here = ready[src]
        value[ready] = np.bincount(src[here], value[dst[here]], n)[ready] / up[ready] + add
        src, dst = src[~here], dst[~here]
    return value[own]


def density_walk(edges: DataFrame, nodes: DataFrame, steps: int = 10, held_edges: int = HELD_EDGES) -> DataFrame:
    """id, pi: mass of a uniform start after `steps` steps over all out-edges; nodes without out-edges lose theirs."""
    ids = nodes.select("id")
    n = ids.count()
    w = checkpoint(_weighted(edges))
    if w.count() <= held_edges:
        return _held(w, ids.withColumn("v", F.lit(1.0 / max(n, 1))), lambda *rows: _walked(*rows, steps), "pi")
    pi = ids.withColumn("pi", F.lit(1.0 / max(n, 1)))
    for t in range(steps):
        pi = w.join(pi, F.col("src") == F.col("id")).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("w") * F.col("pi")).alias("pi"))
        if t % UNROLL == UNROLL - 1:
            pi = checkpoint(pi)
    return ids.join(pi, "id", "left").select("id", F.coalesce("pi", F.lit(0.0)).alias("pi"))


def _climb(edges: DataFrame, init: DataFrame, r: int, start, add: float, held_edges: int = HELD_EDGES) -> DataFrame:
    """id, value: at local maxima `start`, elsewhere `add` plus the mean over the strictly higher ones of the first r neighbours.

    Values settle level by level, the maxima first, as strict ascents have no cycles.
    """
    a = init.select(F.col("id").alias("src"), F.col("pi").alias("from"))
    b = init.select(F.col("id").alias("dst"), F.col("pi").alias("to"))
    up = truncate(edges, r).select("src", "dst").join(a, "src").join(b, "dst").where("to > from").select("src", "dst")
    ends = RuntimeError("an ascent does not end: node ids repeat")
    if edges.count() <= held_edges:
        held = checkpoint(_held(up.withColumn("w", F.lit(0.0)), init.select("id", start.alias("v")), lambda *rows: _climbed(*rows, add), "value"))
        if held.select("id").distinct().count() != init.count():
            raise ends
        return held
    up = checkpoint(up.join(up.groupBy("src").agg(F.count("*").alias("n")), "src"))
    tops = checkpoint(init.join(up.select(F.col("src").alias("id")).distinct(), "id", "left_anti").select("id", start.alias("value")))
    now, total, done = tops, init.count(), tops.count()
    while done < total:
        for _ in range(UNROLL):
            # A node is settled once all its higher neighbours are.
            met = up.join(now.select(F.col("id").alias("dst"), "value"), "dst").groupBy(F.col("src").alias("id")).agg((F.avg("value") + add).alias("value"), F.count("*").alias("k"), F.max("n").alias("n"))
            now = tops.unionByName(met.where("k = n").select("id", "value"))
        now = checkpoint(now)
        before, done = done, now.count()
        if done == before:
            raise ends
    return now


def ascending_value(edges: DataFrame, init: DataFrame, r: int = 10) -> DataFrame:
    """id, expected: the exact mean, over uniform strict ascents, of the mass at the local maximum reached."""
    return _climb(edges, init, r, F.col("pi"), 0.0).withColumnRenamed("value", "expected")


def ascending_hops(edges: DataFrame, init: DataFrame, r: int = 10) -> DataFrame:
    """id, hops: the exact mean length of such ascents."""
    return _climb(edges, init, r, F.lit(0.0), 1.0).withColumnRenamed("value", "hops")


def relative_density(init: DataFrame, expected: DataFrame, eps: float = EPS) -> DataFrame:
    return init.join(expected, "id").select("id", F.col("pi").alias("init"), "expected", (F.col("pi") / (F.col("expected") + eps)).alias("score"))


def flowrank(edges: DataFrame, nodes: DataFrame, r: int = 10, eps: float = EPS, steps: int = 10) -> DataFrame:
    """id, init, expected, score: density over all edges, against the peaks that ascents over the first r reach."""
    init = checkpoint(density_walk(edges, nodes, steps))
    return relative_density(init, ascending_value(edges, init, r), eps)


def hops_ranking(points: DataFrame, q: int = 40, r: int = 20, steps: int = 10, **knn) -> DataFrame:
    """id, score: minus the mean hops to a peak, on the q-neighbour graph's density and the r-neighbour graph's ascents."""
    edges = checkpoint(knn_graph(points, max(q, r), **knn))
    init = checkpoint(density_walk(truncate(edges, q), points, steps))
    return ascending_hops(edges, init, r).select("id", (-F.col("hops")).alias("score"))


def pagerank(edges: DataFrame, nodes: DataFrame, alpha: float = 0.85, tol: float | None = 1e-6, max_iter: int = 100) -> DataFrame:
    """id, score: damped walk; the mass of nodes without out-edges is spread evenly; stops at an L1 change below n * tol.

    tol None: exactly max_iter steps.
    """
    ids = checkpoint(nodes.select("id"))
    n = ids.count()
    w = checkpoint(_weighted(edges))
    sinks = checkpoint(ids.join(w.select(F.col("src").alias("id")).distinct(), "id", "left_anti"))
    x = ids.withColumn("score", F.lit(1.0 / max(n, 1)))
    for _ in range(max_iter):
        lost = x.join(sinks, "id", "left_semi").agg(F.coalesce(F.sum("score"), F.lit(0.0))).first()[0]
        got = w.join(x, F.col("src") == F.col("id")).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("w") * F.col("score")).alias("in"))
        new = checkpoint(ids.join(got, "id", "left").select("id", (alpha * F.coalesce("in", F.lit(0.0)) + F.lit((alpha * lost + 1 - alpha) / max(n, 1))).alias("score")))
        if tol is None:
            x = new
            continue
        change = new.join(x.withColumnRenamed("score", "old"), "id").agg(F.sum(F.abs(F.col("score") - F.col("old")))).first()[0]
        x = new
        if change is None or change < n * tol:
            return x
    if tol is None:
        return x
    raise RuntimeError(f"no convergence in {max_iter} iterations")


def indegree_rank(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return nodes.select("id").join(in_degree(edges), "id", "left").select("id", F.coalesce("deg", F.lit(0)).cast("double").alias("score"))
