"""Structured Streaming: incremental ingest behind a content cache, and windows over change feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.hashing import content_id


def windowed_counts(events: DataFrame, time: str, kind: str, length: str, late: str | None = None) -> DataFrame:
    """``window_start, kind, n`` of tumbling windows; with ``late`` the stream's watermark."""
    rows = events.withWatermark(time, late) if late else events
    counts = rows.groupBy(F.window(time, length).alias("w"), kind).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), kind, "n")


def session_counts(events: DataFrame, time: str, key: str, gap: str, late: str) -> DataFrame:
    """Sessions of each key that a gap ends."""
    rows = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return rows.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def first_seen(chunks: DataFrame, time: str, payload: str, late: str) -> DataFrame:
    """Chunks whose payload no earlier one within the watermark had."""
    return chunks.withColumn("id", content_id(F.col(payload))).withWatermark(time, late).dropDuplicatesWithinWatermark(["id"])


def ingest(chunks: DataFrame, store: str, checkpoint: str, payload: str = "payload", available_now: bool = True) -> StreamingQuery:
    """Append to the table ``store`` what it does not hold yet, micro-batch by micro-batch.

    A batch that is tried again finds its ids there and adds nothing, so the result is the same.
    """

    def add(batch: DataFrame, _: int) -> None:
        spark: SparkSession = batch.sparkSession
        rows = batch.withColumn("id", content_id(F.col(payload))).dropDuplicates(["id"]).select("id", F.col(payload).alias("body"), F.octet_length(payload).alias("raw_len"))
        try:
            known = spark.read.parquet(store).select("id")
        except Exception as e:  # the first batch: no table yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            known = rows.select("id").limit(0)
        rows.join(known, "id", "left_anti").write.mode("append").parquet(store)

    writer = chunks.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
