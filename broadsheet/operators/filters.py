"""Filters over articles. Each takes and returns a DataFrame; Catalyst merges chains of them into one scan filter."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import article_year, parse_date
from ..functions.text import accent_fold, clean_journal_name, journal_base_name, journal_from_id, non_empty, whole_word_count, year_from_id


def date_range(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Both ends included; rows without a date go as soon as a bound is given."""
    d = parse_date(F.col("date"))
    if start:
        df = df.filter(d >= F.lit(start).cast("date"))
    return df.filter(d <= F.lit(end).cast("date")) if end else df


def newspaper_contains(df: DataFrame, name: str, col: str = "newspaper") -> DataFrame:
    return df.filter(F.contains(F.lower(col), F.lit(name.lower())))


def equals(df: DataFrame, col: str, value) -> DataFrame:
    return df.filter(F.col(col) == value)


def topic_tag(df: DataFrame, topic: str) -> DataFrame:
    return df.filter(F.exists("topics", lambda t: F.lower(t) == topic.lower()))


def word_count(df: DataFrame, least: int | None = None, most: int | None = None) -> DataFrame:
    """A missing count is 0."""
    n = F.coalesce("word_count", F.lit(0))
    if least is not None:
        df = df.filter(n >= least)
    return df.filter(n <= most) if most is not None else df


def in_cluster(df: DataFrame, clusters: DataFrame, cluster: str) -> DataFrame:
    """Rows whose id or base id has the cluster; two semi-joins, since one with OR would be a nested loop."""
    ids = clusters.filter(F.col("cluster").cast("string") == cluster).select(F.col("id").alias("_c")).distinct()
    by_id = df.join(ids, df["id"] == ids["_c"], "left_semi")
    by_base = df.join(ids, df["base_id"] == ids["_c"], "left_semi")
    return by_id.unionByName(by_base.join(by_id.select("id"), "id", "left_anti"))


def apply_all(df: DataFrame, start=None, end=None, newspaper=None, canton=None, topic=None, least=None, most=None) -> DataFrame:
    df = date_range(df, start, end)
    df = newspaper_contains(df, newspaper) if newspaper else df
    df = equals(df, "canton", canton) if canton else df
    df = topic_tag(df, topic) if topic else df
    return word_count(df, least, most)


def years(df: DataFrame, first: int, last: int) -> DataFrame:
    return df.withColumn("y", article_year(F.col("date"), F.col("id"))).filter(F.col("y").between(first, last))


def grouping_newspaper() -> Column:
    """The source; if there is none the newspaper; if the source is empty the id's part; else ``unknown``."""
    return F.coalesce(F.when(F.col("source").isNull(), non_empty(F.col("newspaper"))), non_empty(F.col("source")), journal_from_id(F.col("id")), F.lit("unknown"))


def newspapers(df: DataFrame, names: list[str]) -> DataFrame:
    return df.filter(grouping_newspaper().isin(names))


def journals_base(df: DataFrame, names: list[str]) -> DataFrame:
    """The name as it stands or without its issue number."""
    return df.filter(F.col("newspaper").isin(names) | journal_base_name(F.col("newspaper")).isin(names))


def text_chain(*cols: str) -> Column:
    """The first of the columns that isn't empty."""
    return F.coalesce(*(non_empty(F.col(c)) for c in cols))


def keywords(df: DataFrame, words: list[str], mode: str = "any", text: Column | None = None) -> DataFrame:
    """``any``, ``all`` or ``none`` of the words as substrings, whatever the case; rows without text go in every mode."""
    t = F.lower(text if text is not None else text_chain("content", "cleaned_text"))
    has = [F.contains(t, F.lit(w.lower())) for w in words]
    any_, all_ = reduce(lambda a, b: a | b, has), reduce(lambda a, b: a & b, has)
    return df.filter(t.isNotNull() & {"any": any_, "all": all_, "none": ~any_}[mode])


def words_in(text: Column) -> Column:
    return F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != ""))


def length(df: DataFrame, least: int, most: int) -> DataFrame:
    """By ``word_count``, or if that is none or 0 by counting."""
    n = F.coalesce(F.when(F.col("word_count") != 0, F.col("word_count")), words_in(F.col("content")))
    return df.filter(n.between(least, most))


def year_slider(df: DataFrame, first: int, last: int) -> DataFrame:
    return df.filter(F.substring("date", 1, 4).try_cast("int").between(first, last))


def topics_any(df: DataFrame, topics: list[str]) -> DataFrame:
    return df.filter(F.arrays_overlap("topics", F.array(*map(F.lit, topics))))


def topics_all(df: DataFrame, topics: list[str]) -> DataFrame:
    return df.filter(F.size(F.array_except(F.array(*map(F.lit, topics)), "topics")) == 0)


def regex(df: DataFrame, pattern: str, col: str = "content") -> DataFrame:
    return df.filter(F.col(col).rlike(f"(?iu){pattern}"))


def point_lookup(df: DataFrame, key: str) -> DataFrame:
    return df.filter((F.col("id") == key) | (F.col("base_id") == key)).orderBy("id").limit(1)


def fuzzy_lookup(df: DataFrame, key: str) -> DataFrame:
    """Best of: the id, the base id, the first id that contains the key."""
    rank = F.when(F.col("id") == key, 0).when(F.col("base_id") == key, 1).when(F.contains("id", F.lit(key)), 2)
    return df.withColumn("rank", rank).filter("rank is not null").orderBy("rank", "id").limit(1)


def term_period(df: DataFrame, term: str, year: int | None = None, journal: str | None = None) -> DataFrame:
    """Articles with a proper id, of a year and a journal as the id has them, that hold a term as a whole word."""
    df = df.filter(F.col("id").startswith("article_"))
    df = df.filter(year_from_id(F.col("id")) == year) if year else df
    df = df.filter(journal_from_id(F.col("id")) == journal) if journal else df
    return df.filter(whole_word_count(text_chain("content", "cleaned_text"), term) > 0)


def mediation(df: DataFrame, term: str, first: int, last: int, journal: str | None = None, canton: str | None = None) -> DataFrame:
    df = df.filter(F.contains(F.lower("content"), F.lit(term.lower())) & year_from_id(F.col("id")).between(first, last))
    if journal:
        a, b = accent_fold(clean_journal_name(F.col("newspaper"))), accent_fold(F.lit(journal))
        df = df.filter(F.contains(a, b) | F.contains(b, a))
    return df.filter(F.col("canton") == canton) if canton else df


def has_entity(df: DataFrame, text: str | None = None, label: str | None = None) -> DataFrame:
    def hit(e: Column) -> Column:
        c = F.lit(True)
        c = c & (e["text"] == text) if text else c
        return c & (e["label"] == label) if label else c

    return df.filter(F.exists("entities", hit))


def criteria(df: DataFrame, kind: str, value, term: str | None = None) -> DataFrame:
    """Articles by one criterion; the sentiment limits here count their ends in."""
    c = F.col
    tests = {
        "year": lambda: article_year(c("date"), c("id")) == int(value), "journal": lambda: c("newspaper") == value, "date": lambda: c("date") == value, "article_id": lambda: c("id") == value,
        "sentiment": lambda: {"positive": c("compound") >= 0.05, "negative": c("compound") <= -0.05, "neutral": (c("compound") > -0.05) & (c("compound") < 0.05)}[value],
        "sentiment_score": lambda: F.abs(c("compound") - value) <= 0.1, "topic": lambda: F.array_contains("topics", value),
        "entity_type": lambda: F.exists("entities", lambda e: e["label"] == value), "entity_text": lambda: F.exists("entities", lambda e: e["text"] == value),
    }
    df = df.filter(tests[kind]())
    return df.filter(whole_word_count(c("content"), term) > 0) if term else df


def click_filter(chart: str, point: dict, index: str | None = None) -> tuple[str | None, object, object]:
    """``(filter type, value, term)`` of a point of a chart; nothing for charts that filter nothing."""
    label = point.get("label") or point.get("x")
    if chart in ("sentiment-by-newspaper", "sentiment-by-topic"):
        return chart.rsplit("-", 1)[1], label, label
    if chart == "sentiment-by-date":
        return "date", point.get("x"), point.get("x")
    if chart in ("sentiment-pie", "sentiment-histogram") and "label" in point:
        return "sentiment_category", point["label"].lower(), None
    if chart in ("sentiment-distribution", "sentiment-pie", "sentiment-histogram"):
        return "sentiment_score", point.get("x"), None
    if chart in ("sentiment-top-positive", "sentiment-top-negative"):
        return "sentiment_category", "positif" if chart.endswith("positive") else "négatif", None
    if chart == "entity-distribution":
        return "entity_type", point.get("label"), point.get("label")
    if chart.startswith("entity-frequency-"):
        return "entity", point.get("x"), point.get("x")
    return ("article_id", index, None) if chart == "entity-top-articles" else (None, None, None)
