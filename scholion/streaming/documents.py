"""Per-document operators on streams of documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def stream_documents(spark: SparkSession, path: str, schema: str = "doc_id long, text string, lang string, source string, n_chars long") -> DataFrame:
    """A stream of the documents that arrive as Parquet files in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def run_batches(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Apply an operator to each micro-batch and append its result to a folder, a subfolder for each batch.

    Operators that work within a document run unchanged. A batch that is run again replaces its own subfolder, so each
    document's result is written once.
    """

    def write(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
