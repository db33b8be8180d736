"""Sinks: files by format, by class, and term counts with their statistics."""

from __future__ import annotations

import json
from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_text(spark, path: str, text: str) -> None:
    """A small text as one file of exactly this name, on whatever file system the path is."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_csv(df: DataFrame, path: str, metadata: dict | None = None) -> None:
    """With ``metadata`` also a file beside it, ``<path without .csv>.meta.json``."""
    df.write.mode("overwrite").option("header", True).csv(path)
    if metadata is not None:
        write_text(df.sparkSession, path.rstrip("/").removesuffix(".csv") + ".meta.json", json.dumps(metadata, ensure_ascii=False, indent=2))


def write_similar_terms(similar: DataFrame, path: str, metadata: dict | None = None) -> None:
    """``term, period, word, similarity`` with their rank in term and period, the most similar first, as CSV with metadata beside it."""
    w = Window.partitionBy("term", "period").orderBy(F.desc("similarity"), "word")
    write_csv(similar.select("term", "period", F.row_number().over(w).alias("rank"), "word", "similarity"), path, metadata)


def write_gexf(edges: DataFrame, path: str, most: int = 100_000) -> None:
    """``a, b, weight`` as one GEXF file, for graphs a drawing program can open: at most ``most`` edges, else an error (write Parquet then)."""
    got = edges.select("a", "b", "weight").limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} edges")
    names = sorted({x for r in got for x in (r["a"], r["b"])})
    at = {x: k for k, x in enumerate(names)}
    nodes = "".join(f'<node id="{k}" label={quoteattr(x)}/>' for x, k in at.items())
    links = "".join(f'<edge id="{k}" source="{at[r["a"]]}" target="{at[r["b"]]}" weight="{r["weight"]}"/>' for k, r in enumerate(sorted(got)))
    write_text(edges.sparkSession, path, f'<?xml version="1.0" encoding="UTF-8"?><gexf xmlns="http://www.gexf.net/1.2draft" version="1.2"><graph mode="static" defaultedgetype="undirected"><nodes>{nodes}</nodes><edges>{links}</edges></graph></gexf>')


def write_parquet(df: DataFrame, path: str, by: str | None = None) -> None:
    """One folder for each value of ``by``; rows of a value come from many tasks, so a frequent value is no bottleneck."""
    w = df.write.mode("overwrite")
    (w.partitionBy(by) if by else w).parquet(path)


def term_table(counts: DataFrame, key: str, terms: list[str]) -> DataFrame:
    """Counts ``key, term, n`` as one column for each term, null where it doesn't occur."""
    return counts.groupBy(key).pivot("term", terms).agg(F.sum("n"))


def term_statistics(counts: DataFrame, key: str = "id") -> DataFrame:
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_occurrences"), F.count_distinct(key).alias("articles_with_terms"))


def convert_to_parquet(spark, source: str, target: str) -> None:
    """A CSV or JSON file as Parquet."""
    read = spark.read.option("header", True).csv if source.endswith(".csv") else spark.read.option("multiLine", True).json
    read(source).write.mode("overwrite").parquet(target)
