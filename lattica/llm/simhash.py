"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked exactly within a Hamming radius by vantage-point trees.

A small tree, fitted on a bounded sample, cuts the fingerprints into shards: each node has a vantage point and cuts by
Hamming distance to it into shells wider than the radius. Every fingerprint has one home shard; it also visits the
shards that the triangle inequality cannot exclude, in one direction at the node where homes part. So each pair within
the radius meets in the home shard of one of the two. A shard with many visits is cut further: of radius + 1 bands of bits
two fingerprints within the radius agree on one, so the shard is dealt out once for each band, by as many of its bits as keep
the parts' sizes alike at every size of the table. What equal bits still heap up is cut into blocks, each pair of which is
a task. Inside a part vantage points prune the comparisons again.
The sample shapes the shards only: which pairs are found does not depend on it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, in_blocks, per_batch
from .components import connected_components

WIDTH, SEED, RADIUS = 4, 42, 4
#: Fingerprints from which the tree is fitted, at most.
SAMPLE = 8192
#: Visits that a part of a shard should hold, about; rows beyond which it is cut into blocks.
SHARD_ROWS, BLOCK = 2048, 8192
MAX_DEPTH = 2


def shingle_hashes(text: str | None, width: int = WIDTH, seed: int = SEED) -> list[int]:
    """A-Z lower-cased, words between space and \\t-\\r, shingles with repeats; a shorter text is one shingle, an empty one none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return [digest(joined, seed)]
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    starts = [0, *(e + 1 for e in ends)]
    return [digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :], strict=False)]


def fingerprint(text: str | None, width: int = WIDTH, seed: int = SEED) -> int:
    """The 64 bits of the text's shingles: a bit is set if over half the hashes set it."""
    return voted(shingle_hashes(text, width, seed))


def voted(hashes: list[int] | np.ndarray) -> int:
    """The bits that over half the hashes set; zero for none."""
    if not len(hashes):
        return 0
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 18):
        part = np.array(hashes[at : at + (1 << 18)], np.uint64)
        votes += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, keep: str | None = None) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long), and a column of longs to keep, for every row; null text counts as empty, whose
    fingerprint is zero."""
    kept = [keep] if keep else []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(x, width) for x in batch.column(1).to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), *batch.columns[2:]], ["doc_id", "fp", *kept])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *kept)
    return rows.mapInArrow(per_batch(run), ", ".join(["doc_id long", "fp long", *(f"{c} long" for c in kept)]))


def hamming(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b)


@dataclass
class Node:
    """A leaf has a shard number and the bits of a band by which it is dealt out; an inner node a vantage point, and for each child
    its shell's last distance."""

    shard: int = -1
    bits: int = 0
    vantage: int = 0
    last: tuple[int, ...] = ()
    children: tuple["Node", ...] = ()


def fit_tree(sample: np.ndarray, total: int, radius: int = RADIUS, shard_rows: int = SHARD_ROWS, seed: int = SEED) -> Node:
    """The tree for `total` fingerprints of which `sample` is a random part."""
    rng = np.random.default_rng(seed)
    share, leaves = shard_rows / max(total, 1), []

    def grow(own: np.ndarray, depth: int) -> Node:
        part = len(own) / max(len(sample), 1)
        if part > share and depth < MAX_DEPTH and len(own) >= 64:
            best: tuple[float, int, list[int]] | None = None
            for candidate in [*rng.choice(own, 3), *rng.integers(0, 1 << 63, 3, np.uint64) * np.uint64(2)]:
                d = hamming(own, candidate)
                middle, step = int(np.median(d)), radius + 1
                cuts = [middle + k * step for k in range(-(64 // step) - 1, 64 // step + 2)]
                counts = np.histogram(d, [-99, *(c + 0.5 for c in cuts), 199])[0] / len(d)
                last, held = [], 0.0
                for cut, x in zip(cuts, counts, strict=False):
                    held += x
                    if held >= 0.04:
                        last.append(cut)
                        held = 0.0
                if last and (1 - sum(counts[: cuts.index(last[-1]) + 1])) < 0.04:
                    last.pop()
                last.append(64)
                most = max(np.histogram(d, [-99, *(c + 0.5 for c in last)])[0]) / len(d)
                if best is None or most < best[0]:
                    best = (most, int(candidate), last)
            if best[0] < 0.8:
                d, low, children = hamming(own, np.uint64(best[1])), -1, []
                for high in best[2]:
                    children.append(grow(own[(d > low) & (d <= high)], depth + 1))
                    low = high
                return Node(vantage=best[1], last=tuple(best[2]), children=tuple(children))
        leaves.append(Node(shard=len(leaves)))
        return leaves[-1]

    root = grow(sample, 0)
    visits = np.bincount(route(root, sample, radius)[1] >> 32, minlength=len(leaves)) * (total / max(len(sample), 1))
    for leaf in leaves:
        parts = visits[leaf.shard] / shard_rows
        leaf.bits = min(int(np.ceil(np.log2(parts))), 64 // (radius + 1), 24) if parts > 1 else 0
    return root


def route(root: Node, codes: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every visit: index into codes, key of the shard's part, whether the shard is its home."""
    index, keys, homes = [], [], []

    def put(leaf: Node, at: np.ndarray, home: bool) -> None:
        width = np.uint64(64 // (radius + 1))
        for band in range(radius + 1 if leaf.bits else 1):
            value = codes[at] >> np.uint64(band) * width & np.uint64((1 << leaf.bits) - 1)
            index.append(at)
            keys.append((leaf.shard << 32 | band << 24) + value.astype(np.int64))
            homes.append(np.full(len(at), home))

    def visit(node: Node, own: np.ndarray, guests: np.ndarray) -> None:
        if not len(own) and not len(guests):
            return
        if not node.children:
            put(node, own, True)
            put(node, guests, False)
            return
        d, g = (hamming(codes[x], np.uint64(node.vantage)).astype(np.int16) for x in (own, guests))
        low = -1
        for high, child in zip(node.last, node.children, strict=True):
            near = guests[(g > low - radius) & (g <= high + radius)]
            visit(child, own[(d > low) & (d <= high)], np.concatenate([near, own[(d > high) & (d <= high + radius)]]))
            low = high

    visit(root, np.arange(len(codes)), np.empty(0, np.int64))
    if not index:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    return np.concatenate(index), np.concatenate(keys), np.concatenate(homes)


def _hits(homes: np.ndarray, probes: np.ndarray, radius: int, pivots: list[np.uint64]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (home, probe) within the radius; the next pivot prunes while the product is large."""
    if not len(homes) or not len(probes):
        return
    if pivots and len(homes) * len(probes) > 1 << 18:
        dh, dp = hamming(homes, pivots[0]), hamming(probes, pivots[0])
        oh, op = np.argsort(dh, kind="stable"), np.argsort(dp, kind="stable")
        sh, sp = dh[oh].astype(np.int16), dp[op].astype(np.int16)
        for d in np.unique(sp):
            p = op[np.searchsorted(sp, d) : np.searchsorted(sp, d, "right")]
            h = oh[np.searchsorted(sh, d - radius) : np.searchsorted(sh, d + radius, "right")]
            for a, b in _hits(homes[h], probes[p], radius, pivots[1:]):
                yield h[a], p[b]
        return
    step = max(1, (1 << 21) // len(homes))
    for at in range(0, len(probes), step):
        b, a = np.nonzero(hamming(probes[at : at + step, None], homes[None, :]) <= radius)
        if len(a):
            yield a, b + at


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the groups of a[i] and b[i] in place; label holds each node's smallest known member."""
    while True:
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            return
        a, b = a[open_], b[open_]
        least = np.minimum(la[open_], lb[open_])
        np.minimum.at(label, la[open_], least)
        np.minimum.at(label, lb[open_], least)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def shard_links(codes: np.ndarray, home: np.ndarray, radius: int = RADIUS, right: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (as index pairs) of the links between a part's homes and all that visit it.

    right: None, or a mask, and rows outside are compared with rows inside only.
    """
    label = np.arange(len(codes))
    every = np.arange(len(codes))
    sides = [(every, every)] if right is None else [(every[~right], every[right]), (every[right], every[~right])]
    for mine, others in sides:
        at = mine[home[mine]]
        if len(at) and len(others):
            pivots = [codes[at[0]], ~codes[at[len(at) // 2]] ^ np.uint64(0x5555555555555555), codes[at[-1]] ^ np.uint64(0x00FF00FF00FF00FF)]
            for a, b in _hits(codes[at], codes[others], radius, pivots):
                merge(label, at[a], others[b])
    moved = np.flatnonzero(label != every)
    return moved, label[moved]


def linked(fps: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS, block: int = BLOCK) -> DataFrame:
    """Distinct (rep, fp) rows to the edges (a, b), between reps, of a spanning forest of all links within the radius."""
    total = fps.count()
    order = F.xxhash64("fp", F.lit(SEED))
    sample = np.array([r.fp for r in fps.select("fp").orderBy(order).limit(SAMPLE).collect()], np.int64).view(np.uint64)
    tree = fit_tree(sample, total, radius, shard_rows)

    def dealt(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = batch.column(1).to_numpy(zero_copy_only=False)
        index, keys, homes = route(tree, fp.view(np.uint64), radius)
        rep = batch.column(0).to_numpy(zero_copy_only=False)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(rep[index]), pa.array(fp[index]), pa.array(homes)], ["shard", "rep", "fp", "home"])

    def search(shard: pa.Table) -> pa.Table:
        rep, d = shard.column("rep").to_numpy(), shard.column("d")[0].as_py()
        right = None if shard.column("c")[0].as_py() == d else shard.column("own").to_numpy() == d
        a, b = shard_links(shard.column("fp").to_numpy().astype(np.int64).view(np.uint64), shard.column("home").to_numpy(), radius, right)
        return pa.table({"a": pa.array(rep[a], pa.int64()), "b": pa.array(rep[b], pa.int64())})

    visits = fps.select("rep", "fp").mapInArrow(per_batch(dealt), "shard long, rep long, fp long, home boolean")
    return in_blocks(visits, ["shard"], "rep", block).groupBy("shard", "c", "d").applyInArrow(search, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, width: int = WIDTH) -> DataFrame:
    """doc_id, fp, component_id for every row: the smallest id reachable over links of `radius` or fewer differing bits.

    Equal fingerprints collapse before the search, so groups of copies cost one row. Null text counts as empty; empty
    texts link with each other. Rows with a null id keep their fingerprint, join no others and get the component of
    their fingerprint, or null if no row with an id has it. Equal rows all stay; an empty table gives no rows.
    """
    own = checkpoint(fingerprints(docs, id_col, text_col, width))
    reps = own.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"))
    reps = checkpoint(reps)
    found = connected_components(linked(reps, radius))
    classes = reps.join(found, reps.rep == found.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return own.join(classes, "fp", "left").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, width: int = WIDTH, similarity: float | None = None) -> DataFrame:
    """Keep the document with the smallest id of each component, once if its row repeats; rows with a null id all stay.

    With a similarity, links are pairs of texts whose sets of `width`-word shingles have that Jaccard similarity or more: fingerprints
    within `radius` give the first candidates, a prefix filter those that differ in more bits; without one, links are fingerprints within `radius`. Rows go by id and text, so unlike texts under one id stay apart.
    """
    from .shingles import drop_components, drop_similar  # they use this module's hashes

    if similarity is not None:
        return drop_similar(docs, id_col, text_col, width, similarity, radius)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    named = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("node"))
    own = checkpoint(fingerprints(named, "id", "text", width, "node").where("doc_id is not null").groupBy(F.col("doc_id").alias("id"), "node", "fp").agg(F.count("*").alias("rows")))
    reps = checkpoint(own.select(F.col("fp").alias("rep"), "fp").distinct())
    found = connected_components(linked(reps, radius))
    of = reps.join(found, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component"))
    return drop_components(docs, id_col, text_col, own.join(of, "fp").select("id", "node", "rows", "component"))
