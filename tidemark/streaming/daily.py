"""An extension: daily rollups over a stream of facts, with the three days of overlap as a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_stream(events: DataFrame, delay: str = "3 days") -> DataFrame:
    """events (ts, event_type, value) by day and type; a day is final when the watermark has passed its end."""
    day = F.window("ts", "1 day")
    return events.withWatermark("ts", delay).groupBy(day, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.to_date("window.start").alias("date"), "event_type", "n", "value")


def append_final_days(events: DataFrame, path: str, checkpoint: str) -> None:
    """Runs daily_stream() over all that is there and appends its final days to the table at path, each once: a file sink
    keeps a log of the batches that are whole."""
    run = daily_stream(events).writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()


def sync_stream(rows: DataFrame, write, checkpoint: str):
    """Starts a stream that hands each micro-batch to write(df, epoch), for an idempotent sink such as replace_days()."""
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
