"""Chroma audio fingerprints: pitch-class frames, integral-image filters, packed integers, alignment by offsets and bit errors.

A recording's power spectrum is folded into 12 pitch classes per frame. Sixteen filters compare the sums of rectangles
in the (time, class) image, which an integral image gives in four look-ups; each comparison is quantised to two bits,
so a window of frames makes one 32-bit integer. Two recordings are aligned by the histogram of offsets at which they
share integers, and judged by the bit errors over the overlap at the best offset.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, stored, tidy

FILTERS = 16


@dataclass(frozen=True)
class Params:
    """Samples a second of the recordings (unsigned 8-bit mono or WAV), samples of a frame and of a hop, frames of a window."""

    rate: int = 11025
    frame: int = 4096
    hop: int = 1365
    window: int = 16
    low: float = 28.0
    high: float = 3520.0


@dataclass(frozen=True)
class Align:
    """Shared integers that an offset needs, integers of overlap, and the share of bits that may differ."""

    votes: int = 3
    overlap: int = 8
    errors: float = 0.2


def filter_shapes(window: int) -> list[tuple[int, int, int, int]]:
    """Kind, first class, classes, frames of each filter, by rule: kinds in turn, over ever larger rectangles."""
    return [(i % 6, (5 * i) % 12, 2 + i % 5 * 2, max(2, window * (1 + i // 4) // 4)) for i in range(FILTERS)]


def decode(data: bytes) -> np.ndarray:
    """Samples between -1 and 1 of a RIFF WAV file (8 or 16 bits, channels are averaged), or of raw unsigned 8-bit samples."""
    if data[:4] == b"RIFF" and data[8:12] == b"WAVE":
        import io
        import wave

        try:
            with wave.open(io.BytesIO(data)) as f:
                raw, size, channels = f.readframes(f.getnframes()), f.getsampwidth(), f.getnchannels()
            if size in (1, 2):
                x = np.frombuffer(raw[: len(raw) // (size * channels) * size * channels], np.uint8 if size == 1 else "<i2").astype(np.float64)
                return ((x - 128) / 128 if size == 1 else x / 32768).reshape(-1, channels).mean(1)
        except (wave.Error, EOFError):
            pass  # a broken head: taken as raw samples
    return (np.frombuffer(data, np.uint8).astype(np.float64) - 128) / 128


def pitch_classes(p: Params) -> np.ndarray:
    """Matrix from spectrum bins to the 12 classes, for the bins between low and high."""
    hertz = np.arange(p.frame // 2 + 1) * p.rate / p.frame
    out = np.zeros((len(hertz), 12))
    use = np.flatnonzero((hertz >= p.low) & (hertz <= p.high))
    out[use, np.round(12 * np.log2(hertz[use] / 440)).astype(int) % 12] = 1
    return out


def chroma(samples: np.ndarray, p: Params) -> np.ndarray:
    """Frames x 12 whole numbers from 0 to 65535: each frame's classes, scaled to length one; silence is zero."""
    if len(samples) < p.frame:
        return np.zeros((0, 12), np.int64)
    frames = np.lib.stride_tricks.sliding_window_view(samples, p.frame)[:: p.hop]
    classes, hann, out = pitch_classes(p), np.hanning(p.frame), []
    for at in range(0, len(frames), 2048):
        power = np.abs(np.fft.rfft(frames[at : at + 2048] * hann, axis=1)) ** 2
        c = power @ classes
        norm = np.sqrt((c * c).sum(1, keepdims=True))
        out.append(np.round(65535 * c / np.maximum(norm, 1e-9)).astype(np.int64) * (norm > 1e-6))
    return np.concatenate(out)


def _rectangles(kind: int, first: int, classes: int, frames: int) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int, int, int]]]:
    """The two sets of rectangles (t0, t1, c0, c1) that a filter compares."""
    t, h = frames, min(classes, 12 - first)
    a, b, c = first, first + h, first + max(1, h // 2)
    m = max(1, t // 2)
    if kind == 0:
        return [(0, t, a, b)], []
    if kind == 1:
        return [(0, t, c, b)], [(0, t, a, c)]
    if kind == 2:
        return [(m, t, a, b)], [(0, m, a, b)]
    if kind == 3:
        return [(0, m, c, b), (m, t, a, c)], [(0, m, a, c), (m, t, c, b)]
    if kind == 4:
        x, y = a + max(1, h // 3), b - max(1, h // 3)
        return [(0, t, x, max(x, y))], [(0, t, a, x), (0, t, max(x, y), b)]
    x, y = max(1, t // 3), t - max(1, t // 3)
    return [(x, max(x, y), a, b)], [(0, x, a, b), (max(x, y), t, a, b)]


def fingerprint(image: np.ndarray, starts: np.ndarray, p: Params) -> np.ndarray:
    """The integers of the windows that begin at the frames `starts` of a chroma image."""
    integral = np.zeros((len(image) + 1, 13), np.int64)
    integral[1:, 1:] = image.cumsum(0).cumsum(1)
    total = lambda boxes: sum((integral[starts + t1, c1] - integral[starts + t0, c1] - integral[starts + t1, c0] + integral[starts + t0, c0] for t0, t1, c0, c1 in boxes), np.zeros(len(starts), np.int64))
    out = np.zeros(len(starts), np.uint32)
    for i, shape in enumerate(filter_shapes(p.window)):
        more, less = _rectangles(*shape)
        if less:
            area = lambda boxes: max(1, sum((t1 - t0) * (c1 - c0) for t0, t1, c0, c1 in boxes))
            x = np.log((1 + total(more) / area(more)) / (1 + total(less) / area(less)))
            cuts = (-0.4, 0.0, 0.4)
        else:
            area = sum((t1 - t0) * (c1 - c0) for t0, t1, c0, c1 in more)
            x, cuts = total(more) / area / 65535, (0.12, 0.2, 0.28)
        level = np.searchsorted(np.array(cuts), x, side="right").astype(np.uint32)
        out |= (level ^ (level >> 1)) << np.uint32(2 * i)  # Gray code: neighbouring levels differ in one bit
    return out


def fingerprint_all(recordings: list[bytes], p: Params) -> list[np.ndarray]:
    """The integers of each recording; shorter ones than a window of frames have none."""
    images = [chroma(decode(x), p) for x in recordings]
    counts = np.array([max(0, len(x) - p.window + 1) for x in images])
    first = np.cumsum([0, *(len(x) for x in images)])
    if not counts.sum():
        return [np.empty(0, np.uint32)] * len(images)
    starts = np.concatenate([np.arange(n) + a for n, a in zip(counts, first, strict=False)])
    return np.split(fingerprint(np.concatenate(images), starts, p), np.cumsum(counts)[:-1])


def fingerprints(media: DataFrame, id_col: str, media_col: str, p: Params = Params()) -> DataFrame:
    """id, n_samples_bytes, ints (binary, little-endian unsigned 32-bit) for every row; null media count as empty, without integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            data = [x or b"" for x in part.column(1).to_pylist()]
            found = [x.astype("<u4").tobytes() for x in fingerprint_all(data, p)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in data], pa.int64()), pa.array(found, pa.binary())], ["id", "n_bytes", "ints"])

    return media.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).cast("binary").alias("m")).mapInArrow(run, "id long, n_bytes long, ints binary")


class Catalogue:
    """An index of recordings' integers: align(x) lists the recordings that x aligns with."""

    def __init__(self, ids: list[int], ints: list[np.ndarray], align: Align):
        self.ids, self.ints, self.rules = ids, ints, align
        flat = np.concatenate(ints) if ints else np.empty(0, np.uint32)
        who = np.repeat(np.arange(len(ints)), [len(x) for x in ints])
        where = np.concatenate([np.arange(len(x)) for x in ints]) if ints else np.empty(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.values, self.who, self.where = flat[order], who[order], where[order]

    def align(self, x: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(id, offset, overlap, bit errors): the recording's frame k lies at frame k + offset of x."""
        low, high = np.searchsorted(self.values, x), np.searchsorted(self.values, x, "right")
        n = high - low
        if not n.any():
            return []
        # Histogram of (recording, offset), in slices so that common integers don't fill the memory.
        votes: dict[int, int] = {}
        cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(n) >> 21)) + 1).tolist(), len(n)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = n[a:b]
            at = np.repeat(low[a:b] - np.cumsum(part) + part, part) + np.arange(part.sum())
            keys, counts = np.unique((self.who[at].astype(np.int64) << 32) + (np.repeat(np.arange(a, b), part) - self.where[at] + (1 << 31)), return_counts=True)
            for k, c in zip(keys.tolist(), counts.tolist(), strict=True):
                votes[k] = votes.get(k, 0) + c
        best: dict[int, tuple[int, int]] = {}
        for k, c in votes.items():
            if c >= self.rules.votes:
                q, offset = k >> 32, (k & 0xFFFFFFFF) - (1 << 31)
                if q not in best or (c, -abs(offset), -offset) > (best[q][0], -abs(best[q][1]), -best[q][1]):
                    best[q] = (c, offset)
        out = []
        for q, (_, offset) in best.items():
            y = self.ints[q]
            a, b = max(0, offset), min(len(x), len(y) + offset)
            if b - a >= self.rules.overlap:
                errors = int(np.bitwise_count(x[a:b] ^ y[a - offset : b - offset]).sum())
                if errors <= self.rules.errors * 32 * (b - a):
                    out.append((self.ids[q], offset, b - a, errors))
        return out


def search(prints: DataFrame, queries: DataFrame, align: Align = Align(), block_ints: int = 4_000_000) -> DataFrame:
    """Align every recording of `prints` (key, ints) with every one of `queries` (key, rep, ints), those of its own key excepted.

    Returns one row per key that aligns with a query: key, n_links, and of its best link (fewest bit errors a bit, then
    most overlap, then smallest rep) to, offset, overlap, errors. Recordings of one key are equal. Queries are held in blocks of about
    `block_ints` integers, one broadcast each, so memory does not grow with their number; a pass reads all prints.
    """
    spark = prints.sparkSession
    total = queries.agg(F.sum(F.length("ints")).alias("n")).first().n or 0
    blocks = max(1, -(-int(total) // (4 * block_ints)))
    found = None
    for k in range(blocks):
        rows = sorted(queries.where(F.pmod(F.xxhash64("rep"), F.lit(blocks)) == k).select("rep", "key", "ints").collect())
        held = spark.sparkContext.broadcast(([r.rep for r in rows], [bytes(r.ints) for r in rows], {bytes(r.key): r.rep for r in rows}))

        def run(batches: Iterator[pa.RecordBatch], held=held, k=k) -> Iterator[pa.RecordBatch]:
            ids, raw, own = held.value
            catalogue = Catalogue(ids, [np.frombuffer(x, "<u4") for x in raw], align)
            for batch in batches:
                out = []
                for key, ints in dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)).items():
                    links = sorted((e / (32 * o), -o, q, off, e) for q, off, o, e in catalogue.align(np.frombuffer(ints, "<u4")) if q != own.get(key))
                    if links:
                        rate, overlap, q, offset, errors = links[0]
                        out.append((key, k, len(links), rate, q, offset, -overlap, errors))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["key", "block", "n_links", "rate", "to", "offset", "overlap", "errors"])

        part = prints.select("key", "ints").mapInArrow(run, "key binary, block long, n_links long, rate double, to long, offset long, overlap long, errors long")
        found = part if found is None else found.unionAll(part)
    best = F.min(F.struct("rate", (-F.col("overlap")).alias("less"), "to", "offset", "errors")).alias("b")
    found = found.groupBy("key", "block").agg(F.max("n_links").alias("n_links"), best)  # of each block once, however often a recording repeats
    found = found.groupBy("key").agg(F.sum("n_links").alias("n_links"), F.min("b").alias("b"))
    return found.select("key", "n_links", F.col("b.to").alias("to"), F.col("b.offset").alias("offset"), (-F.col("b.less")).alias("overlap"), F.col("b.errors").alias("errors"))


def match_recordings(media: DataFrame, id_col: str, media_col: str, query_modulo: int = 100, p: Params = Params(), align: Align = Align(), block_ints: int = 4_000_000) -> DataFrame:
    """Fingerprint all recordings and align each with the query recordings, whose id is divisible by query_modulo.

    One row per input row: id, n_ints, ints, class_id (smallest id with equal integers), is_query, n_links (classes of
    queries, other than its own, that it aligns with), best_to, best_offset, best_overlap, best_errors (null without
    links). Equal fingerprints of a batch are searched once. Rows without integers (null, empty or too short media) are each a class of
    their own and link with nothing; rows with a null id share their class's links, and are a class of id null if no other row has
    their fingerprint. An empty table gives no rows.
    """
    own = stored(fingerprints(media, id_col, media_col, p))
    known = F.length("ints") > 0
    # Equal integers meet by a digest, so that their integers are stored once and dealt out once, with the result; rows without integers need no join.
    full = own.where(known).withColumn("key", F.unhex(F.sha2("ints", 256)))
    is_query = F.coalesce(F.pmod(F.col("id"), F.lit(query_modulo)) == 0, F.lit(False))
    classes = stored(full.groupBy("key").agg(F.min("id").alias("rep")))
    asked = stored(full.where(is_query).groupBy("key").agg(F.first("ints").alias("ints")).join(classes, "key"))
    links = stored(search(full.where("id is not null"), asked, align, block_ints))
    tidy(media.sparkSession)
    of = classes.join(links, "key", "left").select("key", F.col("rep").alias("class_id"), "n_links", F.col("to").alias("best_to"), F.col("offset").alias("best_offset"), F.col("overlap").alias("best_overlap"), F.col("errors").alias("best_errors"))
    shown = lambda rows: rows.select(
        "id", "n_bytes", (F.length("ints") / 4).cast("long").alias("n_ints"), "ints", "class_id",
        is_query.alias("is_query"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "best_to", "best_offset", "best_overlap", "best_errors",
    )
    none = {c: F.lit(None).cast("long") for c in ("n_links", "best_to", "best_offset", "best_overlap", "best_errors")}
    return shown(full.join(of, "key", "left")).unionAll(shown(own.where(~known).withColumns({"class_id": F.col("id"), **none})))
