"""Python workers that serve many tasks hand back the memory that a task leaves behind."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

Batches = Iterator[pa.RecordBatch]
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of a batch that goes to a worker, unless the session sets its own; texts have any length, so rows are no bound.
BATCH_BYTES = 4 << 20


def lean(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run`` for ``mapInArrow``; what it allocated goes back to the system when the task ends, however it ends.

    An executor keeps its workers for later stages, whose memory would else add up to that of the largest ones. The
    session's limit on the bytes of a batch is set where it has none.
    """
    session = SparkSession.getActiveSession()
    if session is not None and BATCH not in session.conf.getAll:
        session.conf.set(BATCH, str(BATCH_BYTES))

    def kept(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # absent outside glibc
            if trim is not None:
                trim(0)

    return kept
