"""Aggregates over mentions of entities (``id, text, label``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def frequency(mentions: DataFrame, label: str | None = None) -> DataFrame:
    m = mentions.filter(F.col("label") == label) if label else mentions
    return m.groupBy("text").agg(F.count("*").alias("n"))


def cooccurrence(mentions: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """Unordered pairs of the distinct (text, label) of each document; equal texts with two labels make a pair.

    A document's pairs are made from its own list of entities, so nothing but the pairs' partial counts is shuffled.
    """
    m = mentions.filter(F.col("label").isin(labels)) if labels else mentions
    per = m.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("text", "label"))).alias("e"))
    pair = F.flatten(F.transform("e", lambda x, i: F.transform(F.slice("e", i + 2, F.size("e")), lambda y: F.struct(F.least(x["text"], y["text"]).alias("a"), F.greatest(x["text"], y["text"]).alias("b")))))
    return per.select(F.inline(pair)).groupBy("a", "b").agg(F.count("*").alias("n"))


def summary(mentions: DataFrame) -> DataFrame:
    """By label: mentions, documents, and the mentions of a document that has any."""
    return mentions.groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("id").alias("docs"))


#: Two or more words with capitals, as names of persons, organisations and places are written.
NAME = r"\p{Lu}[\p{L}\p{M}]{2,}(?:[ -]\p{Lu}[\p{L}\p{M}]{2,})+"


def spans(df: DataFrame, key: str, text: Column, pattern: str = NAME) -> DataFrame:
    """``key, text, start, end`` of every match of ``pattern``, in characters from 0; blank and null texts have none.

    Offsets are running sums over the matches and the gaps between them; only these are shuffled, not the texts.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    x = df.select(key, found.alias("f"), F.split(text, pattern, -1).alias("g")).select(key, F.posexplode(F.arrays_zip(F.col("f"), F.slice("g", 1, F.size("f")).alias("g"))).alias("k", "x"))
    w = Window.partitionBy(key).orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = x.select(key, F.col("x.f").alias("text"), F.sum(F.length("x.f") + F.length("x.g")).over(w).cast("int").alias("end"))
    return out.select(key, "text", (F.col("end") - F.length("text")).alias("start"), "end")


def gazetteer(mentions: DataFrame) -> DataFrame:
    """``text, label``: each known name with its most frequent label."""
    n = mentions.filter("text is not null").groupBy("text", "label").agg(F.count("*").alias("n"))
    w = Window.partitionBy("text").orderBy(F.desc("n"), "label")
    return n.withColumn("r", F.row_number().over(w)).filter("r = 1").select("text", "label")


def labelled(found: DataFrame, names: DataFrame, other: str = "MISC", targets: tuple[str, ...] = ("PER", "ORG", "LOC", "MISC")) -> DataFrame:
    """Spans with a label; a model's output takes the place of ``names`` where there is one."""
    return found.join(names, "text", "left").withColumn("label", F.coalesce("label", F.lit(other))).filter(F.col("label").isin(*targets))
