"""Vectors and clusters: distances, centroids, scaling, quality scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def centroids(df: DataFrame, label: str, vector: str, size: int) -> DataFrame:
    """``label, center``: means by position, one partial aggregate for each dimension and no explode."""
    v = F.col(vector)
    agg = df.groupBy(label).agg(*(F.avg(v[i].cast("double")).alias(f"c{i}") for i in range(size)))
    return agg.select(label, F.array(*(F.col(f"c{i}") for i in range(size))).alias("center"))


def scale_in_cluster(df: DataFrame, label: str, value: str, limit: float = 0.8) -> DataFrame:
    """``scaled`` to [0, 1] within each cluster (0 where all are equal), ``is_anomaly`` beyond the limit, ``intensity``.

    Least and greatest are aggregated first and joined, so a cluster with most of the rows isn't gathered in one task.
    """
    ends = df.groupBy(label).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    s = F.coalesce(F.try_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))
    return df.join(ends, label).withColumn("scaled", s).drop("_lo", "_hi").withColumn("is_anomaly", F.col("scaled") > limit).withColumn("intensity", 1 - F.col("scaled"))


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group with their ``rank``; Spark limits each partition before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
