"""Search over a stream of patterns: each micro-batch is matched against the same
texts, or stored texts, and appended, with its batch number, to a Parquet table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.approx import match


def search_stream(patterns: DataFrame, texts, k: int, path: str, checkpoint: str,
                  strategy: str = "pigeon", available_now: bool = True) -> StreamingQuery:
    """Starts the query. A batch that is repeated after a failure replaces its own
    part of the table, so each match is there once."""

    def each(batch: DataFrame, number: int) -> None:
        found = match(texts, batch.select("pattern_id", "pattern"), k, strategy)
        (found.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path))

    writer = patterns.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
