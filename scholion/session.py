"""Session helpers shared by the whole library."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table that ``hinted`` lets Spark broadcast.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the session names none, as in tests, a temporary folder of this machine becomes the checkpoint folder.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        folder = tempfile.mkdtemp(prefix="scholion-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and that no later step reads."""
    for t in tables:
        path = getattr(t, "stored_at", None)
        if path is not None:
            hadoop = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(hadoop, True)


def hinted(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, with a broadcast hint if it has no more than ``rows`` rows and ``BROADCAST_BYTES`` bytes in its strings.

    Larger tables are returned as they are, so that the join shuffles. Pass tables that are cheap to count
    (materialized or aggregated ones).
    """
    strings = [F.sum(F.octet_length(c)) for c, kind in df.dtypes if kind in ("string", "binary")]
    n, *sizes = df.limit(rows + 1).agg(F.count("*"), *strings).first()
    return F.broadcast(df) if n <= rows and sum(x or 0 for x in sizes) <= BROADCAST_BYTES else df


def null_safe(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Join condition: the named columns are equal, null matching null."""
    cond = F.lit(True)
    for n in names:
        cond = cond & left[n].eqNullSafe(right[n])
    return cond
