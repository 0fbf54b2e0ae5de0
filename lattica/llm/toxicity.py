"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al., 2017), in numpy.

The classifier is linear over which hashed words, beginnings of words and five-letter pieces a text holds. It is trained from confirmed toxic texts and unlabelled
ones: with class prior p, the risk of calling unlabelled texts toxic minus p times that of the positives estimates the
risk on clean texts; where that estimate falls below zero the model has begun to fit noise, and its gradient is turned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import resident, sliced, texts

BITS = 20
#: Texts of either kind from which the model is fitted, at most: the first by a hash of their ids.
MAX_POSITIVE, MAX_UNLABELLED = 2000, 6000
SEED, STEPS, RATE, SPARSITY = 7, 300, 0.05, 3e-4
#: Standard errors by which a feature's share among positives must differ from that among unlabelled texts.
SCREEN = 3.0
#: Characters handled at once.
SLICE = 1 << 17


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def _mixers(count: int) -> np.ndarray:
    return np.random.default_rng(SEED).integers(1, 1 << 62, count, np.uint64) * np.uint64(2) + np.uint64(1)


class Buckets:
    """Hashed features of texts, lower-cased, each once a text: per word (a run of letters, digits and underscores) the word, its
    beginnings of 4 to 7 letters, and the runs of 5 letters in it, edges marked; and that 2 or 4 different words of the
    text share their first four letters. Hashes are polynomials over code points, computed for many texts at once."""

    def __init__(self, bits: int = BITS):
        self.bits, self.mix = bits, _mixers(96)
        word = re.compile(r"\w")
        self.word = np.zeros(0x110000, bool)
        self.word[[c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and word.match(chr(c))]] = True

    def _bucket(self, h: np.ndarray, salt: int) -> np.ndarray:
        return ((h ^ (h >> np.uint64(29))) * self.mix[80 + salt] >> np.uint64(64 - self.bits)).astype(np.int64)

    def _slice(self, parts: list[tuple[int, str]], keep: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a few texts: keys of text and bucket; and per word its text and head, and its hash."""
        joined = " " + "  ".join(t for _, t in parts) + "  "
        c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = self.word[c]
        c = np.where(inside, c, 0).astype(np.uint64)
        start = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
        end = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
        none = np.empty(0, np.int64)
        if not len(start):
            return none, none, none.astype(np.uint64)
        first = np.cumsum([1, *(len(t) + 2 for _, t in parts)])
        owner = np.array([d for d, _ in parts])
        of = lambda at: owner[np.searchsorted(first, at, "right") - 1] << np.int64(self.bits)
        window = lambda at, n: sum(c[at + k] * self.mix[k] for k in range(n))
        runs = np.flatnonzero(inside[1:-3] & inside[2:-2] & inside[3:-1])  # three letters, each end a letter or an edge
        found = [(runs + 1, self._bucket(window(runs, 5), 0))]
        length = end - start
        head = None
        for n in range(4, 8):
            long = start[length >= n]
            found.append((long, self._bucket(window(long - 1, n + 1), n - 3)))
        short = np.minimum(start + 3, len(c) - 1)
        head = self._bucket(c[start] * self.mix[0] + c[np.minimum(start + 1, end - 1)] * self.mix[1] + c[np.minimum(start + 2, end - 1)] * self.mix[2] + c[np.minimum(short, end - 1)] * self.mix[3], 5)
        at = np.flatnonzero(inside)
        place = np.minimum(at - np.repeat(start, length), 63)
        whole = np.add.reduceat(c[at] * self.mix[8 + place], np.concatenate([[0], np.cumsum(length)[:-1]]))
        found.append((start, self._bucket(whole, 6)))
        keys = []
        for where, bucket in found:
            if keep is not None:
                use = keep[bucket]
                where, bucket = where[use], bucket[use]
            keys.append(of(where) | bucket)
        groups, words = of(start) | head, whole
        if keep is not None:
            use = keep[self._several(head, 2)] | keep[self._several(head, 4)]
            groups, words = groups[use], words[use]
        return np.concatenate(keys), groups, words

    def _several(self, head: np.ndarray, n: int) -> np.ndarray:
        return (head * 31 + n) & ((1 << self.bits) - 1)

    def of(self, texts: list[str], keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(text index, bucket) of every feature of every text, sorted; keep: a mask of the buckets asked for."""
        found, waiting, size = [], [], 0
        for i, text in enumerate(texts):
            text, at = text.lower(), 0
            while at < len(text):
                stop = len(text)
                if stop - at > SLICE:
                    stop = text.rfind(" ", at, at + SLICE) + 1 or at + SLICE
                    stop = stop if stop > at else at + SLICE
                waiting.append((i, text[at:stop]))
                size += stop - at
                at = stop
                if size >= SLICE:
                    found.append(self._slice(waiting, keep))
                    waiting, size = [], 0
        if waiting:
            found.append(self._slice(waiting, keep))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        keys, groups, words = (np.concatenate(x) for x in zip(*found, strict=True))
        if len(groups):
            order = np.lexsort((words, groups))
            groups, words = groups[order], words[order]
            new = np.concatenate([[True], (groups[1:] != groups[:-1]) | (words[1:] != words[:-1])])
            group, count = np.unique(groups[new], return_counts=True)
            base = np.int64((1 << self.bits) - 1)
            for n in (2, 4):
                many = group[count >= n]
                several = (many & ~base) | self._several(many & base, n)
                keys = np.concatenate([keys, several if keep is None else several[keep[several & base]]])
        keys = np.unique(keys)
        return keys >> np.int64(self.bits), keys & np.int64((1 << self.bits) - 1)


def _buckets() -> Buckets:
    return resident((Buckets,), Buckets)


def fold(id_col: str) -> Column:
    """crc32 of the id as text, modulo 5; 0 marks the rows held out."""
    return F.crc32(F.col(id_col).cast("string")) % 5


def slope(f: np.ndarray, n_pos: int, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk, with logistic loss, of scores f of which the first n_pos are positives', and its slope by each score;
    where the risk's clean part is negative, the slope that raises this part alone."""
    p, negative = 1 / (1 + np.exp(-f)), np.logaddexp(0, f)  # loss of calling a text toxic if it is clean
    clean = negative[n_pos:].mean() - prior * negative[:n_pos].mean()
    g, n = np.empty(len(f)), len(f)
    if clean >= 0:  # the positives' two terms add up to a constant
        g[:n_pos] = -prior / n_pos
        g[n_pos:] = p[n_pos:] / (n - n_pos)
    else:
        g[:n_pos] = prior * p[:n_pos] / n_pos
        g[n_pos:] = -p[n_pos:] / (n - n_pos)
    return float(prior * np.logaddexp(0, -f[:n_pos]).mean() + max(clean, 0.0)), g


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, bits: int = BITS, steps: int = STEPS, rate: float = RATE, sparsity: float = SPARSITY, screen: float = SCREEN) -> Model:
    """Full-batch Adam on the non-negative risk with logistic loss and an L1 proximal step; deterministic.

    Without texts of either kind the model is zero and its bias says the prior.
    """
    weights = np.zeros(1 << bits, np.float32)
    prior = min(max(prior, 1e-3), 0.999)
    start = float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled:
        return Model(weights, start)
    # Only features that stand out among the positives can say something; most are noise, and dropped before the fit.
    counts = [np.zeros(1 << bits, np.int32) for _ in range(2)]
    for count, group in zip(counts, (positive, unlabelled), strict=True):
        for x in group:
            count[x] += 1
    q, r = counts[0] / len(positive), counts[1] / len(unlabelled)
    both = (counts[0] + counts[1]) / (len(positive) + len(unlabelled))
    error = np.sqrt(both * (1 - both) * (1 / len(positive) + 1 / len(unlabelled)))
    seen = np.flatnonzero((np.abs(q - r) > screen * error) & (counts[0] + counts[1] >= 3))
    place = np.full(1 << bits, -1, np.int32)
    place[seen] = np.arange(len(seen))
    kept = [p[p >= 0] for p in (place[x] for x in (*positive, *unlabelled))]
    cols, rows = np.concatenate(kept), np.repeat(np.arange(len(kept)), [len(x) for x in kept])
    n, d, n_pos = len(kept), len(seen), len(positive)
    w, b = np.zeros(d), start
    m, v, mb, vb = np.zeros(d), np.zeros(d), 0.0, 0.0
    for t in range(1, steps + 1):
        f = np.bincount(rows, w[cols], n) + b
        g = slope(np.clip(f, -30, 30), n_pos, prior)[1]
        gw, gb = np.bincount(cols, g[rows], d), g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        step = rate / (np.sqrt(v / c2) + 1e-8)
        w = w - step * m / c1
        w = np.sign(w) * np.maximum(np.abs(w) - np.minimum(step * sparsity, 1.0), 0)
        b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    weights[seen] = w
    return Model(weights, float(b))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """Learn from the rows of fold 1 to 4: labels' toxic = 1 are the positives, any documents the unlabelled, the labels' mean the prior.

    Null ids, null labels and rows of fold 0 are left out; repeated labels of an id count once.
    """
    spark = docs.sparkSession
    known = labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull() & (fold(id_col) != 0)).groupBy(F.col(id_col).alias("id")).agg(F.max("toxic").alias("toxic"))
    ids = docs.where(F.col(id_col).isNotNull() & (fold(id_col) != 0)).select(F.col(id_col).alias("id")).distinct()
    order = F.xxhash64("id", F.lit(SEED))
    prior = known.agg(F.avg("toxic")).first()[0]
    positive = ids.join(known.where("toxic = 1"), "id", "left_semi").orderBy(order, "id").limit(max_positive).collect()
    unlabelled = ids.orderBy(order, "id").limit(max_unlabelled).collect()
    if prior is None or not positive:
        return fit_nnpu([], [], prior or 0.0)
    chosen = spark.createDataFrame([(r.id, 1) for r in positive] + [(r.id, 0) for r in unlabelled], "id long, kind int")
    chosen = F.broadcast(chosen.groupBy("id").agg(F.max("kind").alias("pos"), F.min("kind").alias("unl")))  # at most the two bounds' sum of rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _buckets()
        for batch in sliced(batches):
            own = texts(batch, "text")
            where, bucket = buckets.of(own)
            found = [x.astype(np.int32).tobytes() for x in np.split(bucket, np.searchsorted(where, np.arange(1, len(own))))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("pos"), batch.column("unl"), pa.array(found, pa.binary())], ["id", "pos", "unl", "b"])

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(chosen, "id")
    found = picked.mapInArrow(run, "id long, pos int, unl int, b binary").toArrow().combine_chunks()
    kinds = [found.column(c).to_numpy() for c in ("id", "pos", "unl")]
    features = [np.frombuffer(x.as_buffer(), np.int32) for x in found.column("b").combine_chunks()] if found.num_rows else []
    order = sorted(range(len(features)), key=lambda i: (kinds[0][i], features[i].tobytes()))  # rows come in any order
    pos, unl = [features[i] for i in order if kinds[1][i] == 1], [features[i] for i in order if kinds[2][i] == 0]
    return fit_nnpu(pos, unl, float(prior))


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """Add column `out` (0 to 1) to every row, from its whole text; null text counts as empty. An existing column of the name is replaced."""
    weights, bias = docs.sparkSession.sparkContext.broadcast(model.weights), model.bias
    kept = docs.drop(out)
    schema = StructType([*kept.schema.fields, StructField(out, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, w = _buckets(), weights.value
        keep = w != 0
        for batch in sliced(batches):
            where, bucket = buckets.of(texts(batch, text_col), keep)
            f = np.bincount(where, w[bucket].astype(np.float64), batch.num_rows) + bias
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(f, -500, 500))))], [*batch.schema.names, out])

    return kept.mapInArrow(run, schema)
