"""Event-time windows over streams, on the same plans as the batch operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, folder: str, schema: str, *, files: int = 1) -> DataFrame:
    """A stream over the Parquet files of a folder, a few a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def windowed(stream: DataFrame, ts: str, size: str, aggs: dict[str, Column], *, slide: str | None = None, late: str = "10 minutes", by: tuple[str, ...] = ()) -> DataFrame:
    """Aggregates by window and keys; state older than the watermark is dropped."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    out = stream.withWatermark(ts, late).groupBy(w.alias("w"), *by).agg(*[c.alias(n) for n, c in aggs.items()])
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, *aggs)


def sessions(stream: DataFrame, ts: str, gap: str, aggs: dict[str, Column], *, late: str = "10 minutes", by: tuple[str, ...] = ()) -> DataFrame:
    """Aggregates by session: events of a key no more than a gap apart."""
    out = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *by).agg(*[c.alias(n) for n, c in aggs.items()])
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *by, *aggs)


def deduplicated(stream: DataFrame, keys: list[str], ts: str, late: str = "10 minutes") -> DataFrame:
    """Each key once within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
