"""Session, storage and Arrow helpers shared by the operators of this package."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import checkpoint, shared_folder

T = TypeVar("T")


#: Of the Arrow batches by which an executor hands rows to its workers.
BATCHES, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table. Also bounds the session's Arrow batches, unless it has set a bound of its own: an executor holds each in its JVM and in
    a worker, beside whatever its heap has grown to."""
    if spark.conf.get(BATCHES, None) is None:
        spark.conf.set(BATCHES, str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file; every operator also takes the path itself."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    """The pattern by which the byte-level tokenizers cut texts."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def shared_dir(spark: SparkSession) -> str:
    """This application's folder under spark.checkpoint.dir, which all machines share."""
    return shared_folder(spark.sparkContext)


def clear(spark: SparkSession) -> None:
    """Remove what this application has checkpointed and stored; results that were not written elsewhere go with it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for found in files.listStatus(path):
        files.delete(found.getPath(), True)


def stored(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: smaller than a checkpoint for wide rows."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs whose results are stored: it does so when the driver collects its garbage, which may be
    long after."""
    gc.collect()
    spark._jvm.System.gc()


#: Rows, and bytes but for a single row, that a function works on at once, so that a worker holds few texts beside its input.
ROWS, BYTES = 512, 4 << 20


def sliced(batches: Iterator[pa.RecordBatch], rows: int = ROWS, size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most `rows` rows and about `size` bytes; a longer row is a slice of its own."""
    for batch in batches:
        if batch.nbytes <= size:
            ends = []
        else:
            wide = [pc.fill_null(pc.binary_length(x), 0).to_numpy(zero_copy_only=False) for x in batch.columns if pa.types.is_binary(x.type) or pa.types.is_string(x.type)]
            wide += [8 * pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False) for x in batch.columns if pa.types.is_list(x.type)]
            ends = np.cumsum(sum(x.astype(np.int64) for x in wide) + 64) if wide else []
        at = 0
        while at < batch.num_rows:
            stop = min(at + rows, batch.num_rows)
            if len(ends):
                stop = min(stop, max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right"))))
            yield batch.slice(at, stop - at)
            at = stop
    trim()


_resident: dict = {}


def resident(key: tuple, make: Callable[[], T]) -> T:
    """What `make` returns, kept in this worker until another key is asked for: workers serve one operator after the other,
    and what one needs must not stay while the next one works."""
    if key not in _resident:
        if _resident:
            release()
        _resident[key] = make()
    return _resident[key]


def release() -> None:
    """Give up what resident() holds."""
    if not _resident:
        return
    _resident.clear()
    gc.unfreeze()
    gc.collect()
    trim()


def trim() -> None:
    """Give freed memory back to the system, which allocators do late or never: a worker outlives its task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def per_batch(function: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """mapInArrow function that applies `function` to slices of the batches."""
    return lambda batches: map(function, sliced(batches))


def unused(df: DataFrame, name: str) -> str:
    """The name, lengthened until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def texts(batch: pa.RecordBatch, column: int | str) -> list[str]:
    """The column's texts; null counts as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


#: Groups cut into blocks that are broadcast; where there are more, a join finds them.
FEW = 10_000


def in_blocks(rows: DataFrame, keys: list[str], by: str, block: int) -> DataFrame:
    """Rows with own, c, d, to be grouped by `keys`, c, d: groups of more than `block` rows are cut into blocks by a hash of `by`, so
    that each two rows of a group meet where c, d are their blocks; c = d holds one block, c < d two. own is the row's block.

    A row of a group of n blocks comes n times. `rows` is read twice, the first time for its keys only.
    """
    full = rows.groupBy(*keys).agg(F.count("*").alias("blocks")).where(F.col("blocks") > block)
    full = checkpoint(full.withColumn("blocks", F.ceil(F.col("blocks") / block).cast("int")))
    if full.count() <= FEW:
        full = F.broadcast(full)
    dealt = rows.join(full, keys, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64(by), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select(*rows.columns, "own", F.least("own", "with").alias("c"), F.greatest("own", "with").alias("d"))
