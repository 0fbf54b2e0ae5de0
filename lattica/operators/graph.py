"""Neighbour graphs and edge tables."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import checkpoint
from ..functions.vectors import cosine_distance, squared_distance
from .selection import ordered

EDGES = "src long, dst long, pos int, d2 double"
#: Bytes of a block of queries and of index points: each is sent once to every block of the other side, so that the index, which
#: meets more blocks, comes in the larger ones.
QUERY_BYTES, INDEX_BYTES = 8 << 20, 32 << 20
#: Products that a task holds at once; index points that a bucket should hold; rows of a block of a bucket that holds many more.
PRODUCTS, OCCUPANCY, BUCKET_ROWS = 1 << 21, 1024, 8192


def graph_width(q: int = 20, r: int = 10, ng_num: int = 10) -> int:
    """Neighbours a graph needs so that every later stage finds its own."""
    return max(q, r, ng_num)


def _nearest(own: np.ndarray, ids: np.ndarray, other: np.ndarray, other_ids: np.ndarray, k: int, skip_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of `other` for each row of `own`, ordered by (distance, id); distances from direct differences."""
    rough = (own**2).sum(1)[:, None] + (other**2).sum(1) - 2 * own @ other.T
    take = min(k + 1 + 16, len(other))  # some more, as rounding may swap close ones
    near = np.argpartition(rough, take - 1, axis=1)[:, :take] if take < len(other) else np.tile(np.arange(len(other)), (len(own), 1))
    d2 = ((own[:, None, :] - other[near]) ** 2).sum(2)
    if skip_self:
        d2 = np.where(other_ids[near] == ids[:, None], np.inf, d2)
    order = np.lexsort((other_ids[near], d2), axis=1)[:, :k]
    d2 = np.take_along_axis(d2, order, 1)
    row, col = np.nonzero(np.isfinite(d2))
    return ids[row], other_ids[np.take_along_axis(near, order, 1)[row, col]], d2[row, col]


def _searched(q: np.ndarray, qi: np.ndarray, p: np.ndarray, pi: np.ndarray, k: int, skip_self: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    step = max(1, PRODUCTS // max(len(pi), 1))
    for at in range(0, len(qi), step):
        yield _nearest(q[at : at + step], qi[at : at + step], p, pi, k, skip_self)


def _blocked(index: DataFrame, queries: DataFrame, k: int, skip_self: bool, query_bytes: int, index_bytes: int) -> DataFrame:
    """Exact nearest neighbours by pairs of blocks of points. Every pair is one task's product of two matrices; only its
    k best rows a query leave it. Work is quadratic by nature; no table is broadcast or gathered."""
    head = index.select(F.size("features").alias("d")).first()
    width = 8 * max(head.d if head else 1, 1)

    def blocks(points: DataFrame, name: str, size: int) -> tuple[DataFrame, int]:
        count = max(1, math.ceil(points.count() * width / size))

        def pack(t: pa.Table) -> pa.Table:
            x = np.stack(t.column("features").combine_chunks().to_numpy(zero_copy_only=False)).astype(float)
            return pa.table({name: t.column("b")[:1], f"{name}_ids": [t.column("id").to_numpy().astype(np.int64).tobytes()], f"{name}_x": [x.tobytes()]})

        dealt = points.select("id", F.col("features").cast("array<double>").alias("features"), F.pmod(F.xxhash64("id"), F.lit(count)).cast("int").alias("b"))
        return dealt.groupBy("b").applyInArrow(pack, f"{name} int, {name}_ids binary, {name}_x binary"), count

    cores = index.sparkSession.sparkContext.defaultParallelism
    # Fewer rows than cores could share come in smaller blocks.
    total = queries.count() * width
    left, many = blocks(queries, "q", max(1, min(query_bytes, -(-total // cores))))
    right, count = blocks(index, "p", index_bytes)
    pairs = left.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).join(right, "p")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                qi, pi = np.frombuffer(r.q_ids, np.int64), np.frombuffer(r.p_ids, np.int64)
                q, p = np.frombuffer(r.q_x).reshape(len(qi), -1), np.frombuffer(r.p_x).reshape(len(pi), -1)
                for src, dst, d2 in _searched(q, qi, p, pi, k, skip_self):
                    yield pd.DataFrame({"src": src, "dst": dst, "d2": d2})

    found = pairs.repartition(min(many * count, 4096), "q", "p").mapInPandas(search, "src long, dst long, d2 double")
    return _ranked(found, k)


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("src").orderBy("d2", "dst")
    return pairs.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= k).select("src", "dst", "pos", "d2")


def _hashed(index: DataFrame, queries: DataFrame, k: int, skip_self: bool, tables: int, probes: int, occupancy: int, seed: int = 42) -> DataFrame:
    """Approximate: a query is compared with the index points of its bucket, the signs of random projections from the index's mean,
    and of the buckets across its `probes` nearest planes, in every table. Planes follow the index's size, so buckets don't grow with it.
    Buckets with many rows on either side are cut into blocks; each returns the k best of a query only."""
    n = index.count()
    means = [r.m for r in index.select(F.posexplode("features")).groupBy("pos").agg(F.avg("col").alias("m")).orderBy("pos").collect()]  # a row a dimension
    width = max(0, math.floor(math.log2(max(n, 1) / occupancy))) if n > occupancy else 0
    centre, planes = np.array(means), np.random.default_rng(seed).standard_normal((len(means), tables * width))
    bit = 1 << np.arange(width, dtype=np.int64)

    def deal(side: int, probes: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = np.stack(batch.column("features").to_numpy(zero_copy_only=False)).astype(float)
                far = ((x - centre) @ planes).reshape(len(x), tables, width)
                keys = [((far > 0) @ bit).astype(np.int64)]
                near = np.argsort(np.abs(far), axis=2, kind="stable")
                keys += [keys[0] ^ bit[near[:, :, j]] for j in range(min(probes, width))]
                ids, raw = batch.column("id").to_numpy(), [v.tobytes() for v in x]
                for key in keys:
                    for t in range(tables):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(key[:, t]), pa.array(np.full(len(x), side, np.int32)), pa.array(ids), pa.array(raw, pa.binary())], ["t", "key", "side", "id", "x"])

        return run

    shape = "t int, key long, side int, id long, x binary"
    feed = lambda p: p.select(F.col("id").cast("long").alias("id"), F.col("features").cast("array<double>").alias("features"))
    met = feed(index).mapInArrow(deal(0, 0), shape).unionAll(feed(queries).mapInArrow(deal(1, probes), shape))
    full = met.groupBy("t", "key", "side").agg(F.count("*").alias("rows")).groupBy("t", "key").agg(*(F.max(F.when(F.col("side") == i, F.ceil(F.col("rows") / BUCKET_ROWS))).cast("int").alias(c) for i, c in ((0, "cs"), (1, "ds"))))
    full = checkpoint(full.where("cs > 1 or ds > 1"))  # hot buckets only
    dealt = met.join(full, ["t", "key"], "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("cs", "ds")})
    own = lambda count: F.array(F.pmod(F.xxhash64("id"), F.col(count)).cast("int"))
    every = lambda count: F.sequence(F.lit(0), F.col(count) - 1)
    dealt = dealt.withColumn("c", F.explode(F.when(F.col("side") == 0, own("cs")).otherwise(every("cs"))))
    dealt = dealt.withColumn("d", F.explode(F.when(F.col("side") == 1, own("ds")).otherwise(every("ds"))))

    def search(bucket: pa.Table) -> pa.Table:
        side, ids = bucket.column("side").to_numpy(), bucket.column("id").to_numpy()
        x = np.frombuffer(b"".join(bucket.column("x").to_pylist())).reshape(len(ids), -1)
        p, q = side == 0, side == 1
        found = list(_searched(x[q], ids[q], x[p], ids[p], k, skip_self)) if p.any() and q.any() else []
        src, dst, d2 = (np.concatenate(c) for c in zip(*found, strict=True)) if found else ([], [], [])
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64()), "d2": pa.array(d2, pa.float64())})

    found = dealt.select("t", "key", "c", "d", "side", "id", "x").groupBy("t", "key", "c", "d").applyInArrow(search, "src long, dst long, d2 double")
    return _ranked(found.groupBy("src", "dst").agg(F.min("d2").alias("d2")), k)


def bipartite_knn(index: DataFrame, queries: DataFrame, k: int = 15, drop_first: bool = False, method: str = "blocked", query_bytes: int = QUERY_BYTES, index_bytes: int = INDEX_BYTES, tables: int = 12, probes: int = 3, occupancy: int = OCCUPANCY, _skip_self: bool = False) -> DataFrame:
    """Nearest index points of each query: src (query), dst, pos, d2. drop_first leaves the nearest out, as for queries that are in the index."""
    k = k + 1 if drop_first else k
    if method == "sql":
        a = queries.select(F.col("id").alias("src"), F.col("features").alias("x"))
        b = index.select(F.col("id").alias("dst"), F.col("features").alias("y"))
        pairs = a.crossJoin(b) if not _skip_self else a.join(b, F.col("src") != F.col("dst"))
        found = _ranked(pairs.select("src", "dst", squared_distance(F.col("x"), F.col("y")).alias("d2")), k)
    elif method == "blocked":
        found = _blocked(index, queries, k, _skip_self, query_bytes, index_bytes)
    elif method == "lsh":
        found = _hashed(index, queries, k, _skip_self, tables, probes, occupancy)
    else:
        raise ValueError(f"method {method!r} is not blocked, sql or lsh")
    return found.where("pos > 1").withColumn("pos", F.col("pos") - 1) if drop_first else found


def knn_graph(points: DataFrame, k: int = 15, method: str = "blocked", **options) -> DataFrame:
    """edges(src, dst, pos, d2): the k nearest other points of each, by squared Euclidean distance, then id.

    method: blocked (exact, matrix products), sql (exact, a plain self-join, for small tables) or lsh (approximate, the
    choice for tables where all pairs are too many).
    """
    return bipartite_knn(points, points, k, method=method, _skip_self=True, **options)


def truncate(edges: DataFrame, r: int) -> DataFrame:
    return edges.where(F.col("pos") <= r)


def drop_self_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in nodes(id), self-loops dropped, repeated edges kept."""
    own = nodes.select("id")
    return drop_self_loops(edges).join(own, F.col("src") == F.col("id"), "left_semi").join(own, F.col("dst") == F.col("id"), "left_semi")


def local_ids(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Induced edges with ends renumbered from 0 in the order of the nodes' ids: src, dst and the other columns."""
    named = ordered(nodes.select("id").distinct(), F.asc("id")).select("id", (F.col("rank") - 1).alias("local"))
    a = named.select(F.col("id").alias("src"), F.col("local").alias("a"))
    b = named.select(F.col("id").alias("dst"), F.col("local").alias("b"))
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return induced(edges, nodes).join(a, "src").join(b, "dst").select(F.col("a").cast("long").alias("src"), F.col("b").cast("long").alias("dst"), *rest)


def out_degree(edges: DataFrame) -> DataFrame:
    """id, deg: all out-edges count, self-loops and repeats too."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("deg"))


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("deg"))


def complement(nodes: DataFrame, part: DataFrame) -> DataFrame:
    return nodes.select("id").join(part.select("id"), "id", "left_anti")


def sorted_adjacency(edges: DataFrame, points: DataFrame, metric: str = "euclidean") -> DataFrame:
    """src, dst, pos, dist: each node's edges by distance (not squared), then id. Metrics: euclidean, cosine."""
    if metric not in ("euclidean", "cosine"):
        raise ValueError(f"metric {metric!r} is not euclidean or cosine")
    a = points.select(F.col("id").alias("src"), F.col("features").alias("x"))
    b = points.select(F.col("id").alias("dst"), F.col("features").alias("y"))
    x, y = F.col("x"), F.col("y")
    far = F.sqrt(squared_distance(x, y)) if metric == "euclidean" else cosine_distance(x, y)
    found = edges.select("src", "dst").join(a, "src").join(b, "dst").select("src", "dst", far.alias("dist"))
    return found.select("src", "dst", F.row_number().over(Window.partitionBy("src").orderBy("dist", "dst")).alias("pos"), "dist")


def adjacency(edges: DataFrame, connectivity: str = "sym") -> DataFrame:
    """Sparse matrix (row, col, w): repeated edges add up. sym: half of A plus its transpose; in: transpose; out: A."""
    ones = edges.groupBy(F.col("src").alias("row"), F.col("dst").alias("col")).agg(F.count("*").cast("double").alias("w"))
    turned = ones.select(F.col("col").alias("row"), F.col("row").alias("col"), "w")
    if connectivity == "out":
        return ones
    if connectivity == "in":
        return turned
    if connectivity == "sym":
        return ones.unionByName(turned).groupBy("row", "col").agg((F.sum("w") * 0.5).alias("w"))
    raise ValueError(f"connectivity {connectivity!r} is not sym, in or out")


