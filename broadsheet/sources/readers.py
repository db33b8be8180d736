"""Readers of the layouts the corpus's files come in; all give DataFrames of one schema."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARTICLES = (
    "id string, base_id string, doc_id string, title string, date string, newspaper string, source string, journal string, canton string, topics array<string>, content string, text string, "
    "cleaned_text string, original_content string, original_cleaned_content string, word_count int, url string, year int"
)


def read_json(spark: SparkSession, path: str, schema: str = ARTICLES) -> DataFrame:
    """A JSON array of articles; what lacks is null, what is malformed is in ``_corrupt_record``."""
    return spark.read.schema(schema + ", _corrupt_record string").option("multiLine", True).json(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """One document for each non-blank line; ``doc_id`` is ``doc_`` and the line's number in the file."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "text"))
    return lines.filter(F.trim("text") != "").select(F.concat(F.lit("doc_"), F.col("line").cast("string")).alias("doc_id"), "text")


def read_csv(spark: SparkSession, path: str, numbers: tuple[str, ...] = ()) -> DataFrame:
    """A CSV with a header, all strings; columns named in ``numbers`` become doubles, 0 for what is none."""
    df = spark.read.option("header", True).csv(path)
    return df.withColumns({c: F.coalesce(F.expr(f"try_cast(`{c}` as double)"), F.lit(0.0)) for c in numbers})


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """``category, term`` of a term file: a list (category ``default``) or lists by category. A small dimension."""
    import json

    raw = "".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    data = json.loads(raw)
    data = data if isinstance(data, dict) else {"default": data}
    return spark.createDataFrame([(c, t) for c, ts in data.items() for t in ts], "category string, term string")


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).filter("word <> ''").distinct()


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("id")).filter("id <> ''").distinct()


def rows_of_arrays(df: DataFrame, keys: str, values: str, key: str, value: str) -> DataFrame:
    """Parallel arrays as rows; nothing where a list lacks or their lengths differ."""
    ok = df.filter(F.col(keys).isNotNull() & F.col(values).isNotNull() & (F.size(keys) == F.size(values)))
    return ok.select(F.explode(F.arrays_zip(F.col(keys).alias("k"), F.col(values).alias("v"))).alias("z")).select(F.col("z.k").alias(key), F.col("z.v").alias(value))


def read_doc_topics(spark: SparkSession, path: str) -> DataFrame:
    """``id, topic_distribution, dominant_topic`` of any layout of a document-topic file.

    Layouts: ``{doc_topic_matrix: [{doc_id, topic_distribution}]}``, ``{doc_topics: {id: {topic_distribution, dominant_topic}}}``,
    ``[{doc_id, topic_distribution}]`` and ``[[...]]`` (ids ``doc_<n>``).
    """
    raw = spark.read.text(path, wholetext=True)
    item = "struct<doc_id:string,id:string,topic_distribution:array<double>,dominant_topic:int>"
    matrix = raw.select(F.explode(F.from_json("value", f"struct<doc_topic_matrix:array<{item}>>")["doc_topic_matrix"]).alias("x")).select(F.coalesce("x.doc_id", "x.id").alias("id"), "x.topic_distribution", "x.dominant_topic")
    mapped = raw.select(F.explode(F.from_json("value", f"struct<doc_topics:map<string,{item}>>")["doc_topics"]).alias("id", "x")).select("id", "x.topic_distribution", "x.dominant_topic")
    listed = raw.filter(r"value rlike '^\\s*\\[\\s*\\{'").select(F.posexplode(F.from_json("value", f"array<{item}>")).alias("n", "x")).select(F.coalesce("x.doc_id", "x.id", F.concat(F.lit("doc_"), F.col("n").cast("string"))).alias("id"), "x.topic_distribution", "x.dominant_topic")
    bare = raw.filter(r"value rlike '^\\s*\\[\\s*\\['").select(F.posexplode(F.from_json("value", "array<array<double>>")).alias("n", "topic_distribution")).select(F.concat(F.lit("doc_"), F.col("n").cast("string")).alias("id"), "topic_distribution", F.lit(None).cast("int").alias("dominant_topic"))
    return matrix.unionByName(mapped).unionByName(listed).unionByName(bare)


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, cluster`` of any layout: parallel arrays, a list of clusters, or ids by cluster."""
    raw = spark.read.text(path, wholetext=True)
    s = F.from_json("value", "struct<doc_ids:array<string>,labels:array<int>,document_ids:array<string>,document_clusters:array<struct<id:string,cluster:int>>>")
    one = rows_of_arrays(raw.select(s.alias("s")).select("s.doc_ids", "s.labels"), "doc_ids", "labels", "doc_id", "cluster")
    two = raw.select(F.explode(F.from_json("value", "struct<clusters:array<struct<id:int,articles:array<string>>>>")["clusters"]).alias("c")).filter("c.articles is not null").select(F.explode("c.articles").alias("doc_id"), F.col("c.id").alias("cluster"))
    three = raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("k", "v")).filter("k rlike '^[0-9]+$'").select(F.explode(F.from_json("v", "array<string>")).alias("doc_id"), F.col("k").cast("int").alias("cluster"))
    four = raw.select(F.explode(s["document_clusters"]).alias("c")).select(F.col("c.id").alias("doc_id"), F.col("c.cluster").alias("cluster"))
    return one.unionByName(two).unionByName(three).unionByName(four)


def newest(spark: SparkSession, pattern: str) -> str | None:
    """The file last written among those that a pattern names, or none; the listing is the driver's, the files stay where they are."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    best = max(found, key=lambda s: (s.getModificationTime(), s.getPath().toString()), default=None)
    return best.getPath().toString() if best else None


def find_documents(df: DataFrame, where=None, columns: list[str] | None = None, order: list[str] | None = None, skip: int = 0, limit: int | None = None) -> DataFrame:
    """Query by example: filter, projection, order, skip and limit; all but the order is pushed to the scan."""
    df = df.filter(where) if where is not None else df
    df = df.orderBy(*order) if order else df
    df = df.offset(skip) if skip else df
    df = df.limit(limit) if limit is not None else df
    return df.select(*columns) if columns else df


def newest_clusters(spark: SparkSession, folder: str) -> str | None:
    """The last written file of clusters in a folder, ``doc_clusters_k<number>[_...].json``; none without a number."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/doc_clusters_k*.json")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    good = [s for s in found if re.fullmatch(r"doc_clusters_k\d+(?:[_.].*)?\.json|doc_clusters_k\d+\.json", s.getPath().getName())]
    best = max(good, key=lambda s: (s.getModificationTime(), s.getPath().toString()), default=None)
    return best.getPath().toString() if best else None


def base_source(config: dict, custom: dict | None = None, root: str = ".") -> str:
    """The articles' file: the custom source where one is set, else the one the configuration names."""
    if custom and custom.get("main_source"):
        return custom["main_source"]
    data = config.get("data", {})
    return f"{root}/{data['processed_dir']}/{data.get('files', {}).get('articles', 'articles.json')}"


def article_sources(spark: SparkSession, config: dict, results: str | None = None, root: str = ".") -> list[str]:
    """Where articles may lie, in the order in which they are tried: the results file, the articles that belong to a
    summary of entities, the newest articles with entities, the newest with sentiment, the base articles."""
    out = [results] if results else []
    if results and "entity_summary" in results:
        out.append(results.replace("entity_summary", "articles_with_entities"))
    for folder, stem in (("entity_recognition", "articles_with_entities"), ("sentiment_analysis", "articles_with_sentiment")):
        out.append(newest(spark, f"{root}/data/results/{folder}/{stem}_*.json"))
    return [x for x in [*out, f"{root}/{config['data']['processed_dir']}/articles.json"] if x]


def resolve_articles(spark: SparkSession, config: dict, results: str | None = None, root: str = ".") -> DataFrame:
    """The articles of the first source that can be read; an empty table if there is none."""
    for path in article_sources(spark, config, results, root):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            df = spark.read.schema(ARTICLES).option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(path)
            if not df.filter("id is not null").isEmpty():
                return df
    return spark.createDataFrame([], ARTICLES)


def read_table(spark: SparkSession, stem: str) -> DataFrame:
    """``<stem>.parquet``, or ``<stem>.csv`` where there is no such file."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{stem}.parquet")
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.read.parquet(f"{stem}.parquet")
    return read_csv(spark, f"{stem}.csv")
