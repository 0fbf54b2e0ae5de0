"""Near-duplicates by the Jaccard similarity of sets of word shingles, exactly: SimHash fingerprints first, prefix filtering for the rest.

Texts whose fingerprints are equal or within the radius, which vantage-point trees find, are compared first. Similar sets may differ in more
bits than that, so the other links come from prefix filtering. In any one order of all shingles, two sets of the similarity share a shingle among the first n - ceil(s n) + 1 of each.
The order puts what is frequent in a bounded sample last, so buckets are small; it shapes the work only, not the result.
Before that, texts with equal bands of least hashes are compared with one of them, which joins most near copies.
A bucket's texts are first compared with some of them; only pairs that are still in different groups are compared after
that, so large groups of near copies don't cost the square of their size. Every link is checked on the whole sets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, per_batch, release, stored, tidy, unused
from .components import connected_components
from .simhash import RADIUS, linked, merge, shingle_hashes, voted

#: Texts among which frequent shingles are counted. Frequent shingles that are put last, at most; rounds before all open pairs, the first with one text a bucket.
SAMPLE, FREQUENT, STARS = 32_768, 500_000, 3
#: Texts, about, with which later rounds compare the others of a larger bucket: a text may be similar to a few in a hundred of its group only.
SOME = 64
#: Bands by which near copies are found before the prefix filter, the values of each, and an odd factor for every value.
BANDS, ROWS = 8, 4
FACTORS = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
#: Different texts of a round's pairs up to which their ids are broadcast, so that only these texts are dealt out.
HELD = 2_000_000
#: Links up to which their groups are found on the driver (16 bytes each), not by rounds of jobs.
FEW_LINKS = 500_000


def shingle_set(text: str | None, width: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, width), np.uint64))


def _often(of: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    if not len(frequent):
        return np.zeros(len(of), np.int64)
    at = np.minimum(np.searchsorted(frequent, of), len(frequent) - 1)
    return np.where(frequent[at] == of, counts[at], 0)


def prefix(own: np.ndarray, similarity: float, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles, in the order, of which a set of the similarity shares one; an empty set has one place of its own, zero."""
    if not len(own):
        return np.zeros(1, np.uint64)
    n = len(own) - math.ceil(similarity * len(own) - 1e-9) + 1
    return own[np.lexsort((own, _often(own, frequent, counts)))[:n]]


def bands(own: np.ndarray) -> np.ndarray:
    """A hash for each band of least values of the set under multiplications: two sets have one in common with probability J ** ROWS a band."""
    if not len(own):
        return np.empty(0, np.uint64)
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 4096):
        least = np.minimum(least, (own[at : at + 4096, None] * FACTORS).min(0))
    return ((least >> np.uint64(7)) * np.roll(FACTORS, 1)).reshape(BANDS, ROWS).sum(1, dtype=np.uint64)


def _frequent(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that three or more of about SAMPLE different texts have, sorted, and how many have them."""
    total = texts.count()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(x, width) for x in batch.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64))], ["t"])

    some = texts.where(F.pmod(F.xxhash64("node"), F.lit(max(1, total // SAMPLE))) == 0).dropDuplicates(["node"]).select("text")
    found = some.mapInArrow(per_batch(run), "t long").groupBy("t").count().where("count >= 3").orderBy(F.desc("count"), "t").limit(FREQUENT).toArrow()
    t, n = found.column("t").to_numpy().astype(np.int64).view(np.uint64), found.column("count").to_numpy()
    order = np.argsort(t)
    return t[order], n[order]


def _joined(pairs: DataFrame, rows: DataFrame, function) -> DataFrame:
    """The pairs (a, b) of nodes for which function(row of a, row of b) holds; rows has node and two more columns."""
    _, n, v = rows.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, y, m, k = (batch.column(i) for i in range(2, 6))
        keep = [function((c.as_py(), e), (d.as_py(), f)) for c, d, e, f in zip(x, y, m.to_pylist(), k.to_pylist(), strict=True)]
        return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = rows.select(F.col("node").alias("a"), F.col(n).alias("x"), F.col(v).alias("vx")), rows.select(F.col("node").alias("b"), F.col(n).alias("y"), F.col(v).alias("vy"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y", "vx", "vy").mapInArrow(per_batch(run), "a long, b long")


def _enough(shared: int, x: int, y: int, similarity: float) -> bool:
    return shared * (1 + similarity) >= similarity * (x + y) - 1e-9


def _grouped(links: DataFrame) -> DataFrame:
    """(node, component) of the links (a, b); few links take one job instead of two for each of several rounds."""
    if links.count() > FEW_LINKS:
        return stored(connected_components(links))
    t = links.select("a", "b").toArrow()
    ids, at = np.unique(np.concatenate([t.column(c).to_numpy() for c in "ab"]).astype(np.int64), return_inverse=True)
    label = np.arange(len(ids))
    merge(label, at[: t.num_rows], at[t.num_rows :])
    found = pa.table({"node": pa.array(ids, pa.int64()), "component": pa.array(ids[label], pa.int64())})
    return stored(links.sparkSession.createDataFrame(found, "node long, component long"))


def similar_groups(texts: DataFrame, width: int, similarity: float, radius: int = RADIUS) -> DataFrame:
    """(node, component) for nodes linked to others; texts has node (which stands for the text) and text, rows may repeat."""
    held = texts.sparkSession.sparkContext.broadcast(_frequent(texts, width))

    def first(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Size, fingerprint, prefix and bands."""
        release()  # what operators before left in this worker
        hashes = [np.array(shingle_hashes(x, width), np.uint64) for x in batch.column(1).to_pylist()]
        fps, sets = np.array([voted(x) for x in hashes], np.uint64).view(np.int64), [np.unique(x) for x in hashes]
        lists = [pa.array([f(x).view(np.int64) for x in sets], pa.list_(pa.int64())) for f in (lambda x: prefix(x, similarity, *held.value), bands)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(fps), *lists], ["node", "n", "fp", "heads", "bands"])

    def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(x, width) for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.astype("<u8").tobytes() for x in sets], pa.binary())], ["node", "n", "sh"])

    def possible(x: tuple, y: tuple) -> bool:
        """Of the prefix that ends first no shingle is in the other set but those in its prefix."""
        (n, a), (m, b) = ((k, np.array(h, np.int64).view(np.uint64)) for k, h in (x, y))
        ends = [(int(_often(h[-1:], *held.value)[0]), int(h[-1])) for h in (a, b)]
        left = n - len(a) if ends[0] <= ends[1] else m - len(b)
        return _enough(len(np.intersect1d(a, b, assume_unique=True)) + left, n, m, similarity)

    def similar(x: tuple, y: tuple) -> bool:
        (n, a), (m, b) = ((k, np.frombuffer(h, "<u8")) for k, h in (x, y))
        return _enough(len(np.intersect1d(a, b, assume_unique=True)), n, m, similarity)

    heads = stored(texts.mapInArrow(per_batch(first), "node long, n long, fp long, heads array<long>, bands array<long>").dropDuplicates(["node"]))
    tidy(texts.sparkSession)
    near = F.least("n", "m") >= F.lit(similarity) * F.greatest("n", "m") - F.lit(1e-9)
    # All that two sets share lies at or after the first shingle that they share, so from one bucket of a pair on both must have enough left.
    left = F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) * (1 + similarity) >= similarity * (F.col("n") + F.col("m")) - 1e-9

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("node", "to").alias("a"), F.greatest("node", "to").alias("b")).distinct()

    def starred(rows: DataFrame, some: int, lot: int, where: Column | None = None) -> DataFrame:
        """The pairs of the rows (t, node, n, i, c) of each t with one of them, or where they are more than `some` with about as many, by lot."""
        if some == 1:
            drawn = rows.groupBy("t").agg(F.min(F.struct(F.xxhash64("node", F.lit(lot)).alias("h"), "node", "n", "i", "c")).alias("r")).select("t", "r.*")
        else:
            share = F.ceil(F.col("rows") / some)
            drawn = rows.join(rows.groupBy("t").agg(F.count("*").alias("rows")).where(F.col("rows") > some), "t").where(F.pmod(F.xxhash64("node", F.lit(lot)), share) == 0)
        other = drawn.select("t", F.col("node").alias("to"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("c").alias("d"))
        met = rows.join(other, "t").where((F.col("c") != F.col("d")) & near)
        return ordered(met if where is None else met.where(where))

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs whose whole sets are similar."""
        open_ = stored(_joined(pairs, heads.select("node", "n", "heads"), possible))
        need = stored(open_.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        wanted = texts.join(F.broadcast(need) if need.count() <= HELD else need, "node", "left_semi").dropDuplicates(["node"]).select("node", "text")
        return _joined(open_, wanted.mapInArrow(per_batch(whole), "node long, n long, sh binary"), similar)

    # Texts of equal fingerprints with one of them, those with texts whose fingerprints are near, and texts of equal bands with one of them.
    reps = stored(heads.groupBy("fp").agg(F.min("node").alias("rep")).select("rep", "fp"))
    alike = heads.join(reps, "fp").where("node <> rep").select(F.least("node", "rep").alias("a"), F.greatest("node", "rep").alias("b"))
    ends = linked(reps, radius).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    banded = heads.select(F.explode("bands").alias("t"), "node", "n", F.lit(0).alias("i"), F.col("node").alias("c"))
    seen = stored(alike.unionAll(ends).unionAll(starred(banded, 1, 0)).distinct())
    links = stored(verified(seen))
    groups = _grouped(links)
    tidy(texts.sparkSession)
    places = heads.select("node", "n", F.posexplode("heads").alias("i", "t"))
    # Shingles of the same texts give the same pairs: the first of them in the order is enough.
    shared = places.groupBy("t").agg(F.count("*").alias("k"), F.bit_xor(F.xxhash64("node")).alias("x"), F.sum("i").alias("s")).where("k > 1").groupBy("k", "x").agg(F.min_by("t", "s").alias("t")).select("t")
    now = stored(places.join(shared, "t").join(groups, "node", "left").select("t", "node", "n", "i", F.coalesce("component", "node").alias("c")))
    tidy(texts.sparkSession)
    for k in range(STARS + 1):
        if k < STARS:
            pairs = starred(now, SOME if k else 1, k, left)
        else:  # all pairs in the buckets that still hold several groups
            other = now.select(F.col("t").alias("u"), F.col("node").alias("to"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("c").alias("d"))
            pairs = ordered(now.join(other, (F.col("t") == F.col("u")) & (F.col("node") < F.col("to")) & (F.col("c") != F.col("d")) & near & left))
        pairs = stored(stored(pairs).join(seen, ["a", "b"], "left_anti"))  # stored, or Spark drops the seen ones before equal ones
        seen = seen.unionAll(pairs)
        links = stored(links.unionAll(verified(pairs)))
        groups = _grouped(links)
        tidy(texts.sparkSession)
        if k < STARS:
            now = now.drop("c").join(groups, "node", "left").select("t", "node", "n", "i", F.coalesce("component", "node").alias("c"))
            split = now.groupBy("t").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("t")
            now = stored(now.join(split, "t"))
            if now.isEmpty():
                break
    return groups


def drop_similar(docs: DataFrame, id_col: str, text_col: str, width: int, similarity: float, radius: int = RADIUS) -> DataFrame:
    """Of each group of linked texts the row with the smallest id, once if it repeats; rows with a null id all stay."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    named = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("node"), text.alias("text")).where("id is not null")
    groups = similar_groups(named.select("node", "text"), width, similarity, radius)
    rows = named.groupBy("id", "node").agg(F.count("*").alias("rows"))
    return drop_components(docs, id_col, text_col, rows.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node")))


def drop_components(docs: DataFrame, id_col: str, text_col: str, rows: DataFrame) -> DataFrame:
    """The docs of the smallest (id, node) of each component, once if the row repeats, and all with a null id; rows has id, node (the hash of
    the text), rows (how many docs they are) and component."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keep = rows.groupBy("component").agg(F.min(F.struct("id", "node", "rows")).alias("k"))
    keep = checkpoint(keep.select(F.col("k.id").alias("__id"), F.col("k.node").alias("__node"), F.col("k.rows").alias("__rows")))
    match = lambda k: docs.join(k, (docs[id_col].cast("long") == k["__id"]) & (F.xxhash64(text) == k["__node"]), "left_semi")
    once, several = keep.where("__rows = 1"), keep.where("__rows > 1")
    name = unused(docs, "__text")
    again = match(several).withColumn(name, F.xxhash64(text)).dropDuplicates([id_col, name]).drop(name)
    return match(once).unionByName(again).unionByName(docs.where(F.col(id_col).isNull()))
