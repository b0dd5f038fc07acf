"""Resumable appends as Structured Streaming: a file source, a step, and exactly-once parts by checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def append_stream(spark: SparkSession, source: str, schema: StructType | str, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, key: str, source_format: str = "json", files: int | None = None) -> StreamingQuery:
    """Runs ``step`` over new files of ``source`` and appends its rows to Parquet in ``out``, a folder a batch.

    A batch that ran before an interruption is overwritten by its repetition, so each row is there once; rows whose key
    another batch has written are left out. Stops when all files there are done; start it again for more.
    """
    reader = spark.readStream.format(source_format).schema(schema)
    if files is not None:
        reader = reader.option("maxFilesPerTrigger", files)

    def write(batch: DataFrame, number: int) -> None:
        from ..sources.jsonl import exists

        rows = step(batch).dropDuplicates([key])
        if exists(spark, out):
            old = spark.read.parquet(out).where(F.col("batch") != number).select(key).distinct()
            rows = rows.join(old, key, "left_anti")
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return reader.load(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_events(events: DataFrame, ts: str = "ts", watermark: str = "10 minutes", window: str = "5 minutes", by: str = "event_type") -> DataFrame:
    """Counts and sums in event-time windows; on a stream, rows later than the watermark are dropped. An extension: the
    workload this library was built for has no event time."""
    w = events.withWatermark(ts, watermark).groupBy(F.window(ts, window).alias("w"), by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("w.start").alias("window_start"), by, "n", "total")
