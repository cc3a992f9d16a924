"""Resumable page work as a stream: every run takes what has arrived and is not done yet, and stops."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def convert_arrived(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], key: str = "line_id") -> StreamingQuery:
    """Apply ``work`` to the rows that arrived since the last run and append the result to ``out``.

    The source's progress is in the checkpoint folder, so a run that was stopped goes on where it stopped. A batch writes
    to its own folder, which a repeated batch replaces: every row comes out once although a batch may run twice.
    """

    def batch(df: DataFrame, n: int) -> None:
        work(df.dropDuplicates([key])).write.mode("overwrite").parquet(f"{out}/batch={n}")

    rows = spark.readStream.schema(schema).parquet(source)
    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, size: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """window_start, event_type, n, value over tumbling windows; events later than ``late`` are left out of a stream.

    ``ts`` without a time zone is taken as UTC, as watermarks need an instant.
    """
    df = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = df.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "value")


def late_references(spark: SparkSession, labels: DataFrame, waiting_path: str, resolved_path: str, chapters: DataFrame, n: int) -> None:
    """One batch of late binding: references that wait are joined with the labels that exist now; those that resolve
    are appended to the resolved table, the rest replaces the waiting table under a new batch number."""
    from vellumspark.operators.xref import resolve_pending

    waiting = spark.read.parquet(f"{waiting_path}/{n}")
    done, rest = resolve_pending(waiting, chapters, labels)
    done.write.mode("overwrite").parquet(f"{resolved_path}/batch={n}")
    rest.write.mode("overwrite").parquet(f"{waiting_path}/{n + 1}")
