"""Cutting the lineage of iterative plans, and timing of stages."""

from __future__ import annotations

import logging
import tempfile
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import SparkContext
from pyspark.sql import DataFrame

log = logging.getLogger("lattica")


def shared_folder(context: SparkContext) -> str:
    """The folder of spark.checkpoint.dir, which all machines share. A temporary one is made only where none is set and all runs in
    one process, as in tests; elsewhere that is an error, as other machines could not read it."""
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
            folder = tempfile.mkdtemp(prefix="lattica-")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, so that lost executors cost a read, not a recomputation."""
    shared_folder(df.sparkSession.sparkContext)
    return df.checkpoint(eager=True)


@contextmanager
def timed(stage: str) -> Iterator[None]:
    """Log when a stage begins and how long it took."""
    log.info("%s: begins", stage)
    began = time.perf_counter()
    yield
    log.info("%s: %.2f s", stage, time.perf_counter() - began)
