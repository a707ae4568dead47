"""Guardrails over event streams: the batch checks as windowed aggregates with a watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillgrid.operators.metrics import warnings


def windowed(events: DataFrame, *, ts: str = "ts", positive: Column, empty: Column, fallback: Column, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rates and warnings of each tumbling window; the same for a stream and for a table.

    Rows later than the watermark are dropped by a stream. The state is one row
    for each open window.
    """
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    src = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if events.isStreaming else events
    g = src.groupBy(F.window(ts, width).alias("w")).agg(F.count("*").alias("total"), share(positive).alias("p"), share(empty).alias("e"), share(fallback).alias("f"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "total", F.round("p", 6).alias("positive_rate"), F.round("e", 6).alias("empty_rate"), F.round("f", 6).alias("fallback_rate"), warnings(F.col("p"), F.col("e"), F.col("f")).alias("warnings"))


def by_sequence(events: DataFrame, number: str, size: int, *, positive: Column, empty: Column, fallback: Column) -> DataFrame:
    """Rates of every ``size`` rows by a sequence number, which a stream can group by without an order."""
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    g = events.groupBy((F.floor(F.col(number) / size) + 1).cast("int").alias("chunk")).agg(F.count("*").alias("total"), share(positive).alias("p"), share(empty).alias("e"), share(fallback).alias("f"))
    return g.select("chunk", "total", F.round("p", 6).alias("positive_rate"), F.round("e", 6).alias("empty_rate"), F.round("f", 6).alias("fallback_rate"), warnings(F.col("p"), F.col("e"), F.col("f")).alias("warnings"))


def start(df: DataFrame, path: str, checkpoint: str, mode: str = "append", **trigger) -> StreamingQuery:
    """Write closed windows as Parquet, exactly once; the checkpoint lets a query go on after a loss."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(**(trigger or {"availableNow": True})).start()
