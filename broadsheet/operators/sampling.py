"""Samples that are the same on every run and at every partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def random_rows(df: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` rows in the order of a seeded hash of all columns."""
    return df.orderBy(F.xxhash64(F.lit(seed), *df.columns), *df.columns).limit(n)


def systematic(df: DataFrame, key: str, n: int) -> DataFrame:
    """Every ``len // n``-th row in the order of ``key``, ``n`` of them.

    Ranks are made in two steps, so no task holds all rows: rows are sorted by range, counted by partition, and a
    partition's offset is added to the rank within it.
    """
    from ..session import materialize

    s = materialize(df.repartitionByRange(key).sortWithinPartitions(key).withColumn("_p", F.spark_partition_id()), "sample")
    sizes = s.groupBy("_p").agg(F.count("*").alias("c")).orderBy("_p").collect()  # one row a partition
    total, offset, before = sum(r["c"] for r in sizes), {}, 0
    for r in sizes:
        offset[r["_p"]] = before
        before += r["c"]
    if not total:
        return df.limit(0)
    step = max(1, total // n)
    w = Window.partitionBy("_p").orderBy(key)
    off = F.element_at(F.create_map(*(F.lit(v) for kv in offset.items() for v in kv)), F.col("_p"))
    k = off + F.row_number().over(w) - 1
    return s.withColumn("_k", k).filter((F.col("_k") % step == 0) & (F.floor(F.col("_k") / step) < n)).drop("_p", "_k")


def stratified(df: DataFrame, key: str, by: str, n: int, seed: int) -> DataFrame:
    """About ``n`` rows in the proportions of ``by``, at least one of each."""
    sizes = df.groupBy(by).agg(F.count("*").alias("_c"))
    total = sizes.agg(F.sum("_c").alias("_t"))
    quota = sizes.join(F.broadcast(total)).select(by, F.greatest(F.lit(1), F.round(F.col("_c") / F.col("_t") * n)).cast("int").alias("_q"))
    w = Window.partitionBy(by).orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)
    # At most n rows of a group can be in the sample: that limit is applied in each partition before the shuffle.
    return df.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= n).join(F.broadcast(quota), by).filter(F.col("_k") <= F.col("_q")).drop("_k", "_q")


def split(df: DataFrame, key: str, by: str, share: float, seed: int) -> DataFrame:
    """``part`` train or test by a hash of key and seed; each class is cut at its own quantile, so its shares hold."""
    h = df.withColumn("_h", F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1_000_000)))
    cut = h.groupBy(by).agg(F.percentile_approx("_h", share, 10_000).alias("_q"))
    return h.join(F.broadcast(cut), by).withColumn("part", F.when(F.col("_h") <= F.col("_q"), "train").otherwise("test")).drop("_h", "_q")
