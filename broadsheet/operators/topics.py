"""The relational side of topic models: dominant topics, membership, filters, coherence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def argmax(dist: Column) -> Column:
    """Index from 0 of the largest entry, the first of equals; null for an empty list."""
    return F.when(F.size(dist) > 0, F.array_position(dist, F.array_max(dist)) - 1).cast("int")


def dominant(stored: Column, dist: Column, threshold: float = 0.2) -> Column:
    """The stored topic, else the largest if it reaches the threshold."""
    return F.coalesce(stored, F.when(F.array_max(dist) >= threshold, argmax(dist)))


def belongs(topic: int, threshold: float) -> Column:
    return F.coalesce((F.col("dominant_topic") == topic) | (F.try_element_at("topic_distribution", F.lit(topic + 1)) >= threshold), F.lit(False))


def filter_documents(topics: DataFrame, include: list[int] = (), exclude: list[int] = (), threshold: float = 0.5, legacy_empty_passthrough: bool = False) -> DataFrame:
    """Documents of any included topic and of no excluded one; an include list that matches nothing gives nothing."""
    out = topics
    if include:
        wanted = reduce(lambda a, b: a | b, (belongs(t, threshold) for t in include))
        out = out.filter(wanted)
        if legacy_empty_passthrough and out.isEmpty():
            out = topics
    for t in exclude:
        out = out.filter(~belongs(t, threshold))
    return out


def u_mass(doc_words: DataFrame, topic_words: DataFrame) -> DataFrame:
    """Mean u_mass coherence by topic of ``topic, rank, word``, from distinct ``doc, word`` pairs."""
    words = topic_words.select("word").distinct()
    pairs = topic_words.alias("x").join(topic_words.alias("y"), (F.col("x.topic") == F.col("y.topic")) & (F.col("x.rank") < F.col("y.rank"))).select(F.col("x.topic").alias("topic"), F.col("x.word").alias("w"), F.col("y.word").alias("v"))
    kept = doc_words.join(F.broadcast(words), "word", "left_semi")
    df = kept.groupBy("word").agg(F.count("*").alias("n"))
    both = kept.withColumnRenamed("word", "w").join(kept.withColumnRenamed("word", "v"), "doc").join(F.broadcast(pairs.select("w", "v").distinct()), ["w", "v"], "left_semi").groupBy("w", "v").agg(F.count("*").alias("both"))
    scored = pairs.join(df.select(F.col("word").alias("w"), "n"), "w").join(both, ["w", "v"], "left")
    return scored.groupBy("topic").agg(F.avg(F.log((F.coalesce("both", F.lit(0)) + 1) / F.col("n"))).alias("u_mass"))
