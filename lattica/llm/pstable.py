"""Embedding near-duplicates: Euclidean locality-sensitive hashing with p-stable (Gaussian) projections, then exact cosines.

Normalised vectors with cosine c lie sqrt(2 - 2c) apart. In each of L tables a vector's bucket is the tuple of k
quantised projections floor((a.v + b) / w). k follows the number of vectors, L the recall wanted for pairs that lie
exactly at the threshold; closer pairs are found with higher probability. Buckets hold ids and sketches of 128 signs, not vectors:
only the rows of a bucket that some sketch comes near to fetch theirs, for the cosines. A pair is counted in the first table where it
meets, which both vectors' bucket keys tell, so counts need no list of pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, in_blocks, per_batch, stored
from .components import connected_components
from .simhash import merge

SEED = 42
#: Quantisation step, chance to find a pair at the threshold, vectors that a bucket should hold by chance, rows of one block of a bucket.
STEP, RECALL, OCCUPANCY, BLOCK = 2.0, 0.9995, 2000, 2048
#: Chance to lose a pair at the threshold by its sketch.
MISS = 1e-6


def collision(distance: float, step: float = STEP) -> float:
    """Chance that one quantised projection is equal for two vectors so far apart (Datar et al., 2004)."""
    t = step / distance
    return math.erf(t / math.sqrt(2)) - math.sqrt(2 / math.pi) / t * (1 - math.exp(-t * t / 2))


def plan(total: int, cosine: float, recall: float = RECALL, step: float = STEP, occupancy: int = OCCUPANCY) -> tuple[int, int]:
    """Projections per table and tables, for `total` vectors."""
    far, near = collision(math.sqrt(2), step), collision(math.sqrt(max(2 - 2 * cosine, 1e-12)), step)
    k = max(2, math.ceil(math.log(max(total, 1) / occupancy) / -math.log(far))) if total > occupancy else 2
    return k, max(1, math.ceil(math.log(1 - recall) / math.log(1 - near**k)))


def _exact(x: np.ndarray) -> np.ndarray:
    """Multiples of 2^-22: sums of their products with others are exact in double precision, so equal in whatever order they are added."""
    return np.round(x * (1 << 22)) / (1 << 22)


def bucket_keys(unit: np.ndarray, k: int, tables: int, step: float = STEP, seed: int = SEED) -> np.ndarray:
    """Bucket key of each row in each table, the same in whatever batch a row comes; vectors of another length have other projections."""
    rng = np.random.default_rng([seed, unit.shape[1]])
    cells = np.floor((_exact(unit) @ _exact(rng.standard_normal((unit.shape[1], k * tables))) + _exact(rng.uniform(0, step, k * tables))) / step).astype(np.int64)
    odd = rng.integers(1, 1 << 62, k * tables) * 2 + 1
    mixed = (cells * odd).reshape(len(unit), tables, k).sum(2)
    return mixed ^ (mixed >> 29) ^ (unit.shape[1] * 0x9E3779B97F4A7)


def sketches(unit: np.ndarray, seed: int = SEED) -> np.ndarray:
    """The signs of 128 projections of each row, as two 64-bit integers."""
    rng = np.random.default_rng([seed, unit.shape[1], 1])
    signs = _exact(unit) @ _exact(rng.standard_normal((unit.shape[1], 128))) > 0
    return np.packbits(signs, axis=1, bitorder="little").view("<u8").astype(np.uint64)


def sketch_bound(cosine: float, miss: float = MISS) -> int:
    """The fewest differing signs of 128 that a pair at the threshold exceeds with a chance of at most `miss`."""
    p = math.acos(max(-1.0, min(1.0, cosine))) / math.pi
    rest, at = 1.0, 0
    while at < 128:
        rest -= math.comb(128, at) * p**at * (1 - p) ** (128 - at)
        if rest <= miss:
            break
        at += 1
    return at


def promising(sketch: np.ndarray, right: np.ndarray | None, most: int) -> np.ndarray:
    """Which rows have another one (of the other side of the mask `right`, if given) within `most` differing signs."""
    found = np.zeros(len(sketch), bool)
    left = np.arange(len(sketch)) if right is None else np.flatnonzero(~right)
    other = left if right is None else np.flatnonzero(right)
    own = np.arange(len(left))
    for at in range(0, len(left), 256):
        rows = left[at : at + 256]
        far = np.bitwise_count(sketch[rows, None, 0] ^ sketch[None, other, 0])
        far += np.bitwise_count(sketch[rows, None, 1] ^ sketch[None, other, 1])
        near = far <= most
        if right is None:
            near[own[: len(rows)], own[at : at + len(rows)]] = False
        found[rows] |= near.any(1)
        found[other] |= near.any(0)
    return found


def normalised(rows: np.ndarray) -> np.ndarray:
    x = rows.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _valid(v: Column) -> Column:
    fine = F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return v.isNotNull() & fine & F.exists(v, lambda x: x != 0)


def block_links(x: np.ndarray, keys: np.ndarray, weight: np.ndarray, right: np.ndarray | None, table: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each row to rows it has not met in an earlier table (weighted), and each row's smallest linked member.

    right: None to compare all rows with each other; else a mask, and rows outside are compared with rows inside.
    """
    links, label = np.zeros(len(x), np.int64), np.arange(len(x))
    left = np.arange(len(x)) if right is None else np.flatnonzero(~right)
    other = left if right is None else np.flatnonzero(right)
    for at in range(0, len(left), 256):
        rows = left[at : at + 256]
        i, j = np.nonzero(x[rows] @ x[other].T >= cosine)
        a, b = rows[i], other[j]
        if right is None:
            a, b = a[a < b], b[a < b]
        merge(label, a, b)
        for t in range(table):
            new = keys[a, t] != keys[b, t]
            a, b = a[new], b[new]
        np.add.at(links, a, weight[b])
        np.add.at(links, b, weight[a])
    return links, label


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Vectors that are null, zero or hold null or non-finite components link with nothing: n_links 0, component_id their
    own id, kept. Equal vectors collapse to one class before hashing and count as links of each other. Vectors of unequal
    lengths never link. Rows with a null id count as partners; their own component_id is their class's. An empty table
    gives no rows. Buckets of more than `block` rows are compared block by block in separate tasks.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    kind = "f8" if "double" in dict(rows.dtypes)["v"] else "f4"
    wide = rows.select("vec_id", F.when(_valid(F.col("v")), F.col("v").cast("array<double>" if kind == "f8" else "array<float>")).alias("v"))
    classes = checkpoint(wide.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")))
    total = classes.count()
    k, tables = plan(total, cosine, recall)

    def grouped(batch: pa.RecordBatch, keys: bool = True):
        """The batch's vectors by length: index, raw matrix, keys if asked for."""
        v = batch.column("v")
        sizes = np.diff(v.offsets.to_numpy())
        flat, starts = v.values.to_numpy(zero_copy_only=False), v.offsets.to_numpy()
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            raw = np.stack([flat[starts[i] : starts[i] + size] for i in at])
            yield at, raw, bucket_keys(normalised(raw), k, tables) if keys else None

    def keyed(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[str, list[np.ndarray]] = {c: [] for c in ("t", "key", "rep", "s0", "s1")}
        rep = batch.column("rep").to_numpy(zero_copy_only=False)
        for at, raw, keys in grouped(batch):
            out["t"].append(np.tile(np.arange(tables, dtype=np.int32), len(at)))
            out["key"].append(keys.ravel())
            out["rep"].append(np.repeat(rep[at], tables))
            for c, x in zip(("s0", "s1"), sketches(normalised(raw)).T, strict=True):
                out[c].append(np.repeat(x.view(np.int64), tables))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out.values()], list(out))

    def sift(bucket: pa.Table) -> pa.Table:
        """The rows of a bucket that another one's sketch comes near to."""
        c, d = bucket.column("c")[0].as_py(), bucket.column("d")[0].as_py()
        sketch = np.stack([bucket.column(x).to_numpy().astype(np.int64).view(np.uint64) for x in ("s0", "s1")], 1)
        right = None if c == d else bucket.column("own").to_numpy() == d
        return bucket.select(["t", "key", "c", "d", "own", "rep"]).filter(pa.array(promising(sketch, right, most)))

    def search(bucket: pa.Table) -> pa.Table:
        c, d = bucket.column("c")[0].as_py(), bucket.column("d")[0].as_py()
        raw = np.frombuffer(b"".join(bucket.column("vec").to_pylist()), kind).reshape(bucket.num_rows, -1)
        x = normalised(raw)
        rep, weight = bucket.column("rep").to_numpy(), bucket.column("n").to_numpy()
        right = None if c == d else bucket.column("own").to_numpy() == d
        links, label = block_links(x, bucket_keys(x, k, tables), weight, right, bucket.column("t")[0].as_py(), cosine)
        at = np.flatnonzero((links > 0) | (label != np.arange(len(label))))
        return pa.table({"rep": rep[at], "links": links[at], "to": rep[label[at]]})

    def as_bytes(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[bytes] = [b""] * batch.num_rows
        for at, raw, _ in grouped(batch, False):
            for i, row in zip(at, raw.astype(kind), strict=True):
                out[i] = row.tobytes()
        return pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("n"), pa.array(out, pa.binary())], ["rep", "n", "vec"])

    named = classes.where("rep is not null").select("rep", "n", "v")
    most = sketch_bound(cosine)
    met = in_blocks(named.select("rep", "v").mapInArrow(per_batch(keyed), "t int, key long, rep long, s0 long, s1 long"), ["t", "key"], "rep", block)
    open_ = stored(met.groupBy("t", "key", "c", "d").applyInArrow(sift, "t int, key long, c int, d int, own int, rep long"))
    carried = named.mapInArrow(per_batch(as_bytes), "rep long, n long, vec binary")
    found = checkpoint(open_.join(carried, "rep").groupBy("t", "key", "c", "d").applyInArrow(search, "rep long, links long, to long"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("rep").alias("a"), F.col("to").alias("b")))
    of = classes.join(links, "rep", "left").join(parts, F.col("rep") == F.col("node"), "left")
    of = of.select("v", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    shown = lambda rows: rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    alone = wide.where("v is null").withColumns({"n_links": F.lit(0), "component_id": F.col("vec_id")})  # no join: they would all have one key
    out = shown(wide.where("v is not null").join(of, "v", "left")).unionAll(shown(alone))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
