"""Token ids in files of fixed-width bit packing, with random access.

File: magic; the blocks (block_ids ids each, the last one shorter, each id in `bits` bits from the lowest up, blocks
padded to bytes); the index, which is the blocks' offsets (n_blocks + 1), the documents' ids (signed) and their lengths;
last bits, block_ids, n_ids, n_docs and the index's place. All of these are little-endian 64-bit integers. The bits are
the fewest that hold the vocabulary's largest id. A manifest table lists the files, in the order of document ids; a file
counts only if it is listed, so what a lost or repeated task wrote is never read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, shared_dir, sliced
from .tokens import encoder

MAGIC, BLOCK_IDS = b"LATBITS1", 65536


def width(largest: int) -> int:
    return max(1, int(largest).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if bits % 8 == 0:  # whole bytes are the same layout
        return raw[:, : bits // 8].tobytes()
    return np.packbits(np.unpackbits(raw, axis=1, bitorder="little")[:, :bits], bitorder="little").tobytes()


def unpack_bits(data: bytes, count: int, bits: int) -> np.ndarray:
    if bits % 8 == 0:
        out = np.zeros((count, 4), np.uint8)
        out[:, : bits // 8] = np.frombuffer(data, np.uint8, count * bits // 8).reshape(count, bits // 8)
    else:
        out = np.zeros((count, 32), np.uint8)
        out[:, :bits] = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
        out = np.packbits(out, axis=1, bitorder="little")
    return out.view("<u4").ravel()


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


class Writer:
    def __init__(self, uri: str, bits: int, block_ids: int = BLOCK_IDS):
        self.system, self.path = filesystem(uri)
        self.bits, self.block_ids = bits, block_ids
        self.out = self.system.open_output_stream(f"{self.path}.part")
        self.out.write(MAGIC)
        self.left: list[bytes] = []
        self.waiting = self.total = 0
        self.at, self.offsets, self.docs, self.lengths = 8, [8], [], []

    def add(self, doc: int, ids: bytes) -> None:
        self.docs.append(doc)
        self.lengths.append(len(ids) // 4)
        self.left.append(ids)
        self.waiting += len(ids) // 4
        if self.waiting >= self.block_ids:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.left), "<u4")
        stop = len(ids) if last else len(ids) - len(ids) % self.block_ids
        for a in range(0, stop, self.block_ids):
            part = pack_bits(ids[a : min(stop, a + self.block_ids)], self.bits)
            self.out.write(part)
            self.at += len(part)
            self.offsets.append(self.at)
        self.total += stop
        self.left, self.waiting = [ids[stop:].tobytes()], len(ids) - stop

    def close(self) -> None:
        self._flush(True)
        for x, kind in ((self.offsets, "<u8"), (self.docs, "<i8"), (self.lengths, "<u8")):
            self.out.write(np.array(x, kind).tobytes())
        self.out.write(np.array([self.bits, self.block_ids, self.total, len(self.docs), self.at], "<u8").tobytes())
        self.out.close()
        self.system.move(f"{self.path}.part", self.path)


class Reader:
    """Random access to a file: ids(start, stop) reads only the blocks that hold them."""

    def __init__(self, uri: str):
        system, path = filesystem(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        if self.file.read_at(8, 0) != MAGIC:
            raise ValueError(f"{uri} is not a packed id file")
        self.bits, self.block_ids, self.n_ids, self.n_docs, at = (int(x) for x in np.frombuffer(self.file.read_at(40, size - 40), "<u8"))
        index = self.file.read_at(size - 40 - at, at)
        blocks = -(-self.n_ids // self.block_ids)
        self.offsets = np.frombuffer(index, "<u8", blocks + 1).astype(np.int64)
        self.docs = np.frombuffer(index, "<i8", self.n_docs, 8 * (blocks + 1))
        self.lengths = np.frombuffer(index, "<u8", self.n_docs, 8 * (blocks + 1 + self.n_docs)).astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def block(self, k: int) -> np.ndarray:
        count = min(self.block_ids, self.n_ids - k * self.block_ids)
        return unpack_bits(self.file.read_at(int(self.offsets[k + 1] - self.offsets[k]), int(self.offsets[k])), count, self.bits)

    def ids(self, start: int, stop: int) -> np.ndarray:
        if not 0 <= start <= stop <= self.n_ids:
            raise IndexError(f"{start}:{stop} of {self.n_ids} ids")
        if start == stop:
            return np.empty(0, "<u4")
        first, last = start // self.block_ids, (stop - 1) // self.block_ids
        found = np.concatenate([self.block(k) for k in range(first, last + 1)])
        return found[start - first * self.block_ids : stop - first * self.block_ids]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k] + self.lengths[k]))


def write_ids(docs: DataFrame, path: str, pattern: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, vocabulary: int = 50257, files: int | None = None) -> DataFrame:
    """Encode the documents and write their ids, each followed by end_id, in ascending order of id; return the manifest.

    Manifest: file (its order), path, n_docs, n_ids, base (ids in the files before). Null text counts as empty. Rows with
    a null id have no place in the order and are left out; equal ids are ordered by text. An empty table gives none.
    """
    spark: SparkSession = docs.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(folder or f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}")
    folder = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()  # a bare path is the default store's
    system, place = filesystem(folder)
    system.create_dir(place)
    bits = width(max(vocabulary - 1, end_id))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, writer, first = encoder(path, pattern).encode_all, None, 0
        for part in sliced(batches, 1024):
            for doc, ids in zip(part.column(0).to_pylist(), encode(part.column(1)), strict=True):
                if writer is None:
                    name, first = f"{folder}/{uuid.uuid4().hex}.ids", doc
                    writer = Writer(name, bits)
                writer.add(doc, ids + end)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"first": [first], "path": [name], "n_docs": [len(writer.docs)], "n_ids": [writer.total]})

    clean = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where("doc_id is not null")
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Ties of ids across files would make the order ambiguous, so the text is part of the key only within a partition.
    dealt = clean.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")
    manifest = checkpoint(dealt.mapInArrow(run, "first long, path string, n_docs long, n_ids long"))
    order = Window.orderBy("first", "path")  # a row per file
    return manifest.select((F.row_number().over(order) - 1).alias("file"), "path", "n_docs", "n_ids", F.coalesce(F.sum("n_ids").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))


def read_ids(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids before it in all files), n_tokens, ids (little-endian unsigned 32-bit) from a manifest's files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                r = Reader(path)
                for a in range(0, r.n_docs, 512):
                    b = min(a + 512, r.n_docs)
                    low, n = int(r.starts[a]), r.lengths[a:b]
                    flat = r.ids(low, int(r.starts[b - 1] + r.lengths[b - 1])).tobytes()
                    cuts = ((r.starts[a:b] - low) * 4).tolist()
                    parts = [flat[c : c + 4 * m] for c, m in zip(cuts, n.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(r.docs[a:b]), pa.array(r.starts[a:b] + base), pa.array(n), pa.array(parts, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    tasks = max(1, manifest.count())
    return manifest.select("path", "base").repartition(tasks).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
