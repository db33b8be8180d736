"""Streaming counterparts (beyond what batch queries need): windowed counts over event time with late data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.terms import term_counts


def windowed_counts(events: DataFrame, at: str = "ts", by: list[str] = ("event_type",), window: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Events of each window and group; rows later than ``late`` behind the newest are dropped by the watermark. Works on batches, too."""
    w = F.window(at, window, slide) if slide else F.window(at, window)
    out = events.withWatermark(at, late).groupBy(w, *by).agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n")


def streaming_terms(articles: DataFrame, terms: dict[str, list[str]], text: Column, at: str = "loaded_at", window: str = "1 day", late: str = "7 days") -> DataFrame:
    """Term counts by loading window of a stream of articles; an id that comes again within the watermark counts once."""
    once = articles.withWatermark(at, late).dropDuplicatesWithinWatermark(["id"])
    return term_counts(once, terms, text, "id", at).groupBy(F.window(at, window), "category", "term").agg(F.sum("n").alias("n")).select(F.col("window.start").alias("start"), "category", "term", "n")


def write_stream(df: DataFrame, path: str, checkpoint: str, mode: str = "append", **trigger):
    """A Parquet sink with its checkpoint in the shared folder; ``trigger`` as for ``DataStreamWriter.trigger``."""
    return df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
