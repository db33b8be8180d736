"""The registry's decorator and the corpus views that queries start from, each with its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import parse_date
from ..session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def latest(df: DataFrame, key: str, at: str) -> DataFrame:
    """One row for each key, the last loaded. Select what is needed first: only that is shuffled."""
    w = Window.partitionBy(key).orderBy(F.desc(at))
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


class Corpus:
    """The corpus's tables with repeated rows resolved."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.dir, name)

    @cached_property
    def articles(self) -> DataFrame:
        """The last loaded row of every id, with the parsed date ``d``."""
        return latest(self.raw("articles"), "id", "loaded_at").withColumn("d", parse_date(F.col("date")))

    @cached_property
    def runs(self) -> DataFrame:
        return latest(self.raw("entity_recognition"), "id", "run_at")

    @cached_property
    def mentions(self) -> DataFrame:
        """``id, text, label, start, end`` of every mention."""
        return self.runs.select("id", F.inline("entities"))

    @cached_property
    def biblio(self) -> DataFrame:
        return self.raw("biblio_enriched").distinct()

    @cached_property
    def sentiment(self) -> DataFrame:
        return self.raw("sentiment_scores")

    @cached_property
    def topics(self) -> DataFrame:
        return self.raw("doc_topics")


DATE = "CAST(try_strptime(date, ['%Y-%m-%d', '%Y/%m/%d', '%d/%m/%Y', '%d-%m-%Y', '%Y']) AS DATE)"
WITH = f"""WITH a AS (SELECT *, {DATE} AS d FROM articles QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) = 1),
r AS (SELECT * FROM entity_recognition QUALIFY row_number() OVER (PARTITION BY id ORDER BY run_at DESC) = 1),
m AS (SELECT id, e.text AS text, e.label AS label, e."start" AS s, e."end" AS e FROM (SELECT id, unnest(entities) AS e FROM r)),
b AS (SELECT DISTINCT * FROM biblio_enriched)
"""


def query(slug: str, sql: str | None = None):
    """Register ``f(corpus)`` under ``slug``; ``sql`` may use the views a, r, m and b above."""

    def register(f: Callable[[Corpus], DataFrame]):
        if slug in QUERIES:
            raise ValueError(f"two queries named {slug}")
        QUERIES[slug] = lambda spark, sf_dir: f(Corpus(spark, sf_dir))
        if sql is not None:
            ORACLE[slug] = WITH + sql
        return f

    return register
