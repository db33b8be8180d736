"""Set operations, reshaping, sampling, deduplication and sources."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.dates import parse_date
from ..functions.text import content_hash, year_from_id
from ..operators import dedup, sampling
from .aggregating import TC, TERMS, counts
from .base import query
from .filtering import SIM, similar
from .strings import NORM, YEAR_ID, rows

HASH = f"(SELECT id, CASE WHEN {NORM} = '' THEN '' ELSE md5(substring({NORM}, 1, 1000)) END AS h FROM a)"


def topic1(c):
    return c.topics.filter("dominant_topic = 1").select("id")


def cluster3(c):
    return c.biblio.filter("cluster = '3'").select(F.col("id_article").alias("id"))


T1, C3 = "SELECT id FROM doc_topics WHERE dominant_topic = 1", "SELECT id_article AS id FROM b WHERE cluster = '3'"


@query("union_ids", f"{T1} UNION {C3}")
def _(c):
    return topic1(c).union(cluster3(c)).distinct()


@query("intersect_ids", f"{T1} INTERSECT {C3}")
def _(c):
    return topic1(c).intersect(cluster3(c))


@query("except_ids", f"{T1} EXCEPT {C3}")
def _(c):
    return topic1(c).subtract(cluster3(c))


@query("vocab_intersection", r"SELECT DISTINCT w FROM (SELECT unnest(regexp_extract_all(lower(content), '\p{L}+')) AS w FROM a WHERE d < DATE '1975-01-01') SEMI JOIN (SELECT unnest(regexp_extract_all(lower(content), '\p{L}+')) AS w FROM a WHERE d >= DATE '1975-01-01') y USING (w)")
def _(c):
    w = rows(c, parse_date(F.col("date")).alias("d"), F.regexp_extract_all(F.lower("content"), F.lit(r"\p{L}+"), F.lit(0)).alias("t")).select((F.col("d") < F.lit("1975-01-01").cast("date")).alias("early"), F.explode("t").alias("w"))
    return w.filter("early is not null").groupBy("w").agg(F.bool_or("early").alias("x"), F.bool_or(~F.col("early")).alias("y")).filter("x and y").select("w")


@query("union_batches", "SELECT 'content' AS field, count(content) AS n FROM a UNION ALL SELECT 'title', count(title) FROM a")
def _(c):
    df = rows(c, F.col("content").isNotNull().alias("x"), F.col("title").isNotNull().alias("y")).agg(F.count_if("x").alias("content"), F.count_if("y").alias("title"))
    return df.unpivot([], ["content", "title"], "field", "n")


@query("melt", "SELECT id, k AS variable, v AS value FROM (UNPIVOT (SELECT id, negative, neutral, positive FROM sentiment_scores) ON negative, neutral, positive INTO NAME k VALUE v)")
def _(c):
    return c.sentiment.select("id", "negative", "neutral", "positive").unpivot("id", ["negative", "neutral", "positive"], "variable", "value").filter("value is not null")


@query("pivot", f", {TC} SELECT id, " + ", ".join(f"CAST(sum(n) FILTER (WHERE category = '{k}') AS BIGINT) AS {k}" for k in TERMS) + " FROM tc GROUP BY id")
def _(c):
    return counts(c).groupBy("id").pivot("category", list(TERMS)).agg(F.sum("n"))


@query("transpose", f", {TC} SELECT term, " + ", ".join(f"CAST(sum(n) FILTER (WHERE {YEAR_ID} = {y}) AS BIGINT) AS y{y}" for y in (1980, 1981, 1982)) + " FROM tc GROUP BY term")
def _(c):
    wide = counts(c).withColumn("y", year_from_id(F.col("id"))).groupBy("term").pivot("y", [1980, 1981, 1982]).agg(F.sum("n"))
    return wide.select("term", *(F.col(str(y)).alias(f"y{y}") for y in (1980, 1981, 1982)))


@query("stacking", f", {TC} SELECT y, category, CAST(sum(n) OVER (PARTITION BY y ORDER BY category) AS BIGINT) AS top FROM (SELECT {YEAR_ID} AS y, category, sum(n) AS n FROM tc GROUP BY 1, 2)")
def _(c):
    s = counts(c).groupBy(year_from_id(F.col("id")).alias("y"), "category").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("y").orderBy("category").rowsBetween(Window.unboundedPreceding, 0)
    return s.select("y", "category", F.sum("n").over(w).alias("top"))


@query("sample_random")
def _(c):
    return sampling.random_rows(rows(c).select("id"), 50, 7)


@query("sample_systematic", "SELECT id FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k, count(*) OVER () AS t FROM a) WHERE k % greatest(1, t // 50) = 0 AND k // greatest(1, t // 50) < 50")
def _(c):
    return sampling.systematic(rows(c).select("id"), "id", 50)


@query("sample_stratified_cluster")
def _(c):
    return sampling.stratified(c.biblio.filter("cluster is not null").select("id_article", "cluster"), "id_article", "cluster", 200, 42)


@query("train_test_split")
def _(c):
    return sampling.split(c.topics.select("id", "dominant_topic"), "id", "dominant_topic", 0.8, 42)


@query("exact_dups", f"SELECT h, min(id) AS first, count(*) AS n FROM {HASH} WHERE h <> '' GROUP BY h HAVING count(*) > 1")
def _(c):
    return dedup.exact_groups(rows(c, content_hash(F.col("content")).alias("h")))


@query("remove_dups", f"SELECT id FROM (SELECT id, h, row_number() OVER (PARTITION BY h ORDER BY id) AS k FROM {HASH}) WHERE k = 1 OR h = ''")
def _(c):
    return dedup.remove_exact(rows(c, content_hash(F.col("content")).alias("h"))).select("id")


@query("near_dups")
def _(c):
    return dedup.near_duplicates(rows(c, parse_date(F.col("date")).alias("d"), "content"))


@query("merge_groups")
def _(c):
    df = rows(c, parse_date(F.col("date")).alias("d"), "content")
    return dedup.merge_groups(dedup.near_duplicates(df), dedup.day_copies(df.filter("content is not null and trim(content) <> ''")))


@query("fix_content")
def _(c):
    return dedup.fix_content(rows(c, "content", "original_content")).select("id", "ratio", "fixed")


@query("semantic_network", f", {SIM} SELECT least(x.word, y.word) AS a, greatest(x.word, y.word) AS b, round(max((x.similarity + y.similarity) / 2), 6) AS w FROM sim x JOIN sim y ON x.term = y.term AND x.period = y.period AND x.word < y.word WHERE (x.similarity + y.similarity) / 2 >= 0.2 GROUP BY 1, 2")
def _(c):
    # An edge's weight is a mean, so one end reaches half the limit and more: others can't be an end of any kept edge.
    s = similar(c).filter("similarity >= 0.2 * 2 - 1")
    x = s.select("term", "period", F.col("word").alias("wx"), F.col("similarity").alias("sx"))
    y = s.select("term", "period", F.col("word").alias("wy"), F.col("similarity").alias("sy"))
    p = x.join(y, ["term", "period"]).filter("wx < wy").withColumn("w", (F.col("sx") + F.col("sy")) / 2).filter("w >= 0.2")
    return p.groupBy(F.col("wx").alias("a"), F.col("wy").alias("b")).agg(F.round(F.max("w"), 6).alias("w"))


@query("similar_network", f", {SIM} SELECT DISTINCT term, word, period FROM sim WHERE similarity >= 0.2")
def _(c):
    return similar(c).filter("similarity >= 0.2").select("term", "word", "period").distinct()


@query("scan_json", "SELECT id, title, year FROM articles")
def _(c):
    """Written as JSON files and read again by the articles' schema, of which only these columns are parsed."""
    from ..session import shared_dir
    from ..sources import readers, sinks

    path = f"{shared_dir(c.spark)}/articles-{uuid.uuid4().hex}"
    sinks.write_json(c.raw("articles").select("id", "title", "year", "topics", "content"), path)
    return c.spark.read.schema(readers.ARTICLES).json(path).select("id", "title", "year")


@query("src07", "SELECT id, canton FROM a WHERE canton = 'VD' ORDER BY id LIMIT 30 OFFSET 10")
def _(c):
    from ..sources.readers import find_documents

    return find_documents(rows(c, "canton"), F.col("canton") == "VD", ["id", "canton"], ["id"], 10, 30)


@query("src08", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, coalesce(text, '') AS text FROM documents")
def _(c):
    return c.raw("documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


@query("src05", "SELECT id_article, coalesce(TRY_CAST(replace(score_topic, '%', '') AS DOUBLE), 0) AS score FROM b")
def _(c):
    """Written as CSV and read again, the scores as they stand in the file."""
    from ..session import shared_dir
    from ..sources import readers, sinks

    path = f"{shared_dir(c.spark)}/biblio-{uuid.uuid4().hex}"
    sinks.write_csv(c.biblio.select("id_article", "titre", "score_topic", "cluster"), path)
    return readers.read_csv(c.spark, path).select("id_article", F.coalesce(F.regexp_replace("score_topic", "%", "").try_cast("double"), F.lit(0.0)).alias("score"))


@query("src06", "SELECT vec_id, label FROM embeddings")
def _(c):
    """Parquet where it can be read, else the CSV of the same name."""
    from ..session import shared_dir
    from ..sources import readers, sinks

    path = f"{shared_dir(c.spark)}/vectors-{uuid.uuid4().hex}"
    sinks.write_csv(c.raw("embeddings").select("vec_id", "label"), f"{path}.csv")
    return readers.read_table(c.spark, path).select(F.col("vec_id").cast(c.raw("embeddings").schema["vec_id"].dataType).alias("vec_id"), F.col("label").cast(c.raw("embeddings").schema["label"].dataType).alias("label"))


@query("snk04", f", {TC} SELECT CAST(sum(n) AS BIGINT) AS total_occurrences, count(DISTINCT id) AS articles_with_terms FROM tc")
def _(c):
    from ..sources.sinks import term_statistics

    return term_statistics(counts(c))


@query("dominant_topic", "SELECT id, CAST(list_position(topic_distribution, list_max(topic_distribution)) - 1 AS BIGINT) AS topic FROM doc_topics")
def _(c):
    from ..operators.topics import argmax

    return c.topics.select("id", argmax(F.col("topic_distribution")).cast("long").alias("topic"))


@query("dominant_threshold", "SELECT id, CAST(coalesce(dominant_topic, CASE WHEN list_max(topic_distribution) >= 0.2 THEN list_position(topic_distribution, list_max(topic_distribution)) - 1 END) AS BIGINT) AS topic FROM doc_topics")
def _(c):
    from ..operators.topics import dominant

    return c.topics.select("id", dominant(F.col("dominant_topic"), F.col("topic_distribution")).cast("long").alias("topic"))


@query("docs_by_topic", "SELECT id FROM doc_topics WHERE dominant_topic = 3 OR topic_distribution[4] >= 0.3")
def _(c):
    from ..operators.topics import belongs

    return c.topics.filter(belongs(3, 0.3)).select("id")


@query("topic_name_lookup", "SELECT DISTINCT dominant_topic AS topic, CASE dominant_topic WHEN 0 THEN 'Politique' WHEN 1 THEN 'Internet' WHEN 2 THEN 'Informatique' WHEN 3 THEN 'Culture' ELSE concat('Topic ', dominant_topic) END AS name FROM doc_topics WHERE dominant_topic IS NOT NULL")
def _(c):
    from .joining import topic_names

    t = c.topics.filter("dominant_topic is not null").select(F.col("dominant_topic").alias("topic")).distinct()
    return t.join(F.broadcast(topic_names(c)), "topic", "left").select("topic", F.coalesce("name", F.concat(F.lit("Topic "), F.col("topic").cast("string"))).alias("name"))
