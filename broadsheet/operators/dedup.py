"""Exact and near duplicates by the digest of an article's beginning and its date."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import normalize_ws, seq_ratio
from ..session import materialize
from . import sequences
from .graphs import connected_components
from .sequences import common_subsequence, places  # noqa: F401


def exact_groups(df: DataFrame) -> DataFrame:
    """``h, first, n`` of the digests (``id, h``) that more than one article has."""
    return df.filter("h <> ''").groupBy("h").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1")


def remove_exact(df: DataFrame) -> DataFrame:
    """Articles without those whose digest a smaller id has; articles without text stay.

    The first of each digest is found by aggregation with map-side combine and joined back, so a text copied into a third
    of all rows isn't gathered in one task.
    """
    first = df.filter("h <> ''").groupBy("h").agg(F.min("id").alias("first"))
    return df.join(first, "h", "left").filter((F.col("h") == "") | (F.col("id") == F.col("first"))).drop("first")


def links_within(df: DataFrame, days: int) -> DataFrame:
    """``id, links``: how many other articles of equal digest are at most ``days`` from it (``d``); those without any are left out.

    Articles are counted by digest and day first, and days are compared, not articles: a text copied into a third of all
    rows costs as many entries as it has days.
    """
    b = df.filter("h <> '' and d is not null").select("id", "d", "h")
    n = b.groupBy("h", "d").agg(F.count("*").alias("n"))
    near = n.select("h", F.explode(F.sequence(F.date_sub("d", days), F.date_add("d", days))).alias("d"), "n").groupBy("h", "d").agg((F.sum("n") - 1).alias("links"))
    return b.join(near, ["h", "d"]).filter("links > 0").select("id", "links")


def day_copies(df: DataFrame, text: str = "content") -> DataFrame:
    """``id, rep``: articles with equal normalised text and date stand for one another; the least id represents them."""
    k = materialize(df.select("id", "d", F.md5(normalize_ws(F.col(text))).alias("h")).filter(F.col("d").isNotNull()), "digests")
    return k.join(k.groupBy("h", "d").agg(F.min("id").alias("rep")), ["h", "d"]).select("id", "rep")


#: Letters of a cell of days that is compared in one piece, and of one that is still not divided.
CELL, MOST = 120_000, 8_000_000
#: Texts of a cell that is not divided.
MOST_TEXTS = 32_000


def near_duplicates(df: DataFrame, text: str = "content", days: int = 3, ratio: float = 0.85) -> DataFrame:
    """Pairs ``id_a, id_b, ratio`` at most ``days`` apart whose normalised texts have a sequence ratio of at least ``ratio``.

    Pairs are between representatives: articles with the same text on the same day are one (``day_copies``). Texts meet in
    cells of consecutive days, as many as have about ``CELL`` letters; the first ``days`` of each are in the cell before as
    well, each pair counting in one cell only. Within a cell an index finds the pairs that can reach the ratio
    (``sequences.candidates``), and only these are compared. Cells over ``MOST`` letters are divided into parts, and
    every two parts meet.
    """
    n = normalize_ws(F.col(text))
    base = df.select("id", "d", n.alias("t")).filter("t <> '' and d is not null")
    base = base.groupBy(F.md5("t").alias("h"), "d").agg(F.min("id").alias("id"), F.first("t").alias("t")).filter("id is not null")
    base = materialize(base.select("id", F.datediff("d", F.lit("1900-01-01").cast("date")).alias("day"), F.length("t").alias("n"), "t"), "near")
    days = max(0, days)
    dense = base.agg(F.sum("n"), F.count_distinct("day")).first()
    width = max(days, 1, CELL * (dense[1] or 1) // (dense[0] or 1))
    cell = F.floor(F.col("day") / width)
    cells = F.when(F.pmod("day", F.lit(width)) < days, F.array(cell, cell - 1)).otherwise(F.array(cell))
    met = base.select("id", "day", "n", "t", cell.alias("home"), F.explode(cells).alias("cell"))
    parts = F.greatest(F.ceil(F.sum("n") / (MOST // 2)), F.ceil(F.count("*") / (MOST_TEXTS // 2)))
    big = met.groupBy("cell").agg(F.when((F.sum("n") > MOST) | (F.count("*") > MOST_TEXTS), parts).otherwise(1).alias("k")).filter("k > 1")
    met = met.join(F.broadcast(big), "cell", "left").withColumn("part", F.when(F.col("k").isNull(), 0).otherwise(F.pmod(F.xxhash64("id"), "k")).cast("int"))
    met = met.withColumn("with", F.explode(F.sequence(F.lit(0), F.coalesce("k", F.lit(1)).cast("int") - 1)))
    met = met.select("cell", F.least("part", "with").alias("p"), F.greatest("part", "with").alias("q"), "id", "day", (F.col("home") == F.col("cell")).alias("own"), "part", "t")
    schema = T.StructType([T.StructField(k, base.schema["id"].dataType) for k in ("id_a", "id_b")] + [T.StructField("ratio", T.DoubleType())])
    kind = to_arrow_type(base.schema["id"].dataType)

    def compare(x: pa.Table) -> pa.Table:
        p, q = x["p"][0], x["q"][0]
        if p != q and pc.count_distinct(x["part"]).as_py() < 2:
            return pa.table([pa.array([], kind), pa.array([], kind), pa.array([], pa.float64())], ["id_a", "id_b", "ratio"])
        a, b, r = sequences.similar(x["id"].to_pylist(), x["t"].to_pylist(), x["day"].to_numpy(), x["own"].to_numpy(), x["part"].to_numpy(), days, ratio)
        return pa.table([pa.array(a, kind), pa.array(b, kind), pa.array(r, pa.float64())], ["id_a", "id_b", "ratio"])

    # Few bytes with much work: partitions that AQE doesn't put together.
    met = met.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "cell", "p", "q")
    return met.groupBy("cell", "p", "q").applyInArrow(compare, schema)


def merge_groups(pairs: DataFrame, copies: DataFrame | None = None) -> DataFrame:
    """``id, kept``: the least id of everything linked directly or through others, and of the copies (``id, rep``).

    The links are written first: the components read them several times, and texts must be compared only once.
    """
    links = pairs.select("id_a", "id_b")
    if copies is not None:
        links = links.unionByName(copies.filter("id <> rep").select(F.col("rep").alias("id_a"), F.col("id").alias("id_b")))
    return connected_components(materialize(links, "links"), "id_a", "id_b").select(F.col("node").alias("id"), F.col("component").alias("kept"))


def fix_content(df: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Content that has drifted from the text as first read is replaced by that; the old one is kept as ``backup``."""
    r = seq_ratio(normalize_ws(F.col("content")), normalize_ws(F.col("original_content")))
    out = df.withColumn("ratio", F.when(F.col("original_content").isNotNull() & F.col("content").isNotNull(), r))
    bad = F.col("ratio") < threshold
    return out.withColumn("backup", F.when(bad, F.col("content"))).withColumn("content", F.when(bad, F.col("original_content")).otherwise(F.col("content"))).withColumn("fixed", F.coalesce(bad, F.lit(False)))
