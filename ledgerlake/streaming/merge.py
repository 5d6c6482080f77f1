"""An extension: incremental merge as a file stream. Each micro-batch of bronze rows is merged into
the silver folder; a batch that is run again gives the same state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def merge_stream(spark: SparkSession, inbox: str, schema: StructType, checkpoint: str, merge: Callable[[DataFrame], None], once: bool = True) -> StreamingQuery:
    """Follow a folder of Parquet files; merge(batch) takes each batch into the table."""
    stream = spark.readStream.schema(schema).parquet(inbox)
    writer = stream.writeStream.foreachBatch(lambda batch, _: merge(batch)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
