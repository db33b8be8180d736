"""Queries through files: written to the shared folder and read again by the readers of each layout."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import labelling, models
from ..session import shared_dir
from ..sources import readers, sinks
from .aggregating import TC, TERMS, counts
from .base import Corpus, query
from .modeling import by_period, tokens
from .strings import rows


def folder(c: Corpus) -> str:
    return f"{shared_dir(c.spark)}/files-{uuid.uuid4().hex}"


@query("src02", "SELECT id, title FROM a")
def _(c):
    p = folder(c)
    sinks.write_json(rows(c, "title"), p)
    return c.spark.read.schema(readers.ARTICLES).json(p).select("id", "title")


@query("scan_text", "SELECT trim(title) AS text, count(*) AS n FROM a WHERE trim(title) <> '' GROUP BY 1")
def _(c):
    p = folder(c)
    rows(c, F.regexp_replace("title", r"\s+", " ").alias("title")).filter("title is not null").select(F.trim("title").alias("value")).write.text(p)
    return c.spark.read.text(p).filter(F.trim("value") != "").groupBy(F.trim("value").alias("text")).agg(F.count("*").alias("n"))


@query("src04", f", {TC} SELECT id, CAST(sum(n) FILTER (WHERE term = 'tunnel') AS DOUBLE) AS tunnel FROM tc WHERE term IN ('tunnel', 'pont') GROUP BY id")
def _(c):
    p = folder(c)
    sinks.write_csv(sinks.term_table(counts(c).filter(F.col("term").isin("tunnel", "pont")), "id", ["tunnel", "pont"]), p)
    return readers.read_csv(c.spark, p).select("id", F.col("tunnel").try_cast("double").alias("tunnel"))


@query("src09", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{t}')" for k, ts in TERMS.items() for t in ts) + ") v(category, term)")
def _(c):
    import json

    p = folder(c)
    c.spark.createDataFrame([(json.dumps(TERMS, ensure_ascii=False),)], "value string").coalesce(1).write.text(p)
    return readers.read_terms(c.spark, p)


@query("src10", "SELECT DISTINCT lower(trim(word)) AS word FROM common_words WHERE trim(word) <> ''")
def _(c):
    p = folder(c)
    c.raw("common_words").select(F.upper("word").alias("value")).filter("value is not null").write.text(p)
    return readers.read_word_list(c.spark, p)


@query("src11", "SELECT id FROM a WHERE id IN (SELECT id_article FROM b WHERE sentiment < -0.5)")
def _(c):
    p = folder(c)
    c.biblio.filter("sentiment < -0.5").select(F.col("id_article").alias("value")).write.text(p)
    return rows(c).join(readers.read_ids(c.spark, p), "id", "left_semi")


@query("snk07", "SELECT id_article, titre, cluster, sentiment FROM b")
def _(c):
    p = folder(c)
    c.biblio.write.option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(p)
    got = c.spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(p)
    return got.select("id_article", "titre", "cluster", F.col("sentiment").cast("double").alias("sentiment"))


@query("snk11", "SELECT dominant_topic AS topic, count(*) AS n FROM doc_topics WHERE dominant_topic IS NOT NULL GROUP BY 1")
def _(c):
    p = folder(c)
    sinks.write_parquet(c.topics.filter("dominant_topic is not null").select("id", F.col("dominant_topic").alias("topic")), p, "topic")
    return c.spark.read.parquet(p).groupBy(F.col("topic").cast("int").alias("topic")).agg(F.count("*").alias("n"))


@query("prepare_dataset", r"SELECT id, CAST(len(list_filter(regexp_split_to_array(trim(t), '\s+'), lambda x: x <> '')) AS BIGINT) AS word_count, CAST(CASE WHEN canton = 'VD' THEN 1 ELSE 0 END AS INTEGER) AS label FROM (SELECT id, canton, coalesce(nullif(content, ''), nullif(cleaned_text, '')) AS t FROM a WHERE canton IN ('VD', 'GE')) WHERE t IS NOT NULL")
def _(c):
    df = rows(c, "canton", "content", "cleaned_text")
    return labelling.prepare_dataset(df.filter("canton = 'VD'"), df.filter("canton = 'GE'")).select("id", "word_count", "label")


@query("apply_classifier", r"SELECT id, CASE WHEN len(list_filter(regexp_split_to_array(trim(content), '\s+'), lambda x: x <> '')) < 80 THEN 'COURT' WHEN contains(lower(content), 'tunnel') THEN 'ML' ELSE 'ARTICLE' END AS class FROM a WHERE content <> ''")
def _(c):
    predict = lambda df: df.withColumn("prediction", F.contains(F.lower("content"), F.lit("tunnel")).cast("int"))
    return labelling.apply_classifier(rows(c, "content"), predict, text="content")


def by_words(text: str) -> str:
    """A stand-in for a labelling service: the same questions and answers, by a rule."""
    return "\n".join(f"Texte {line.split(' : ')[0].split()[-1]} : {'OUI' if 'vendre' in line else 'NON'}" for line in text.split("\n") if line.startswith("Texte "))


@query("llm_ads")
def _(c):
    return labelling.label_batches(rows(c, F.regexp_replace("content", r"\s+", " ").alias("text")), by_words)


def by_kind(text: str) -> str:
    kinds = {"vendre": "ADS", "TV": "PROGRAMMETV", "emploi": "OFFREEMPLOI"}
    return "\n".join(f"Texte {line.split(' : ')[0].split()[-1]} : {next((k for w, k in kinds.items() if w in line), 'ARTICLE')}" for line in text.split("\n") if line.startswith("Texte "))


@query("llm_categories")
def _(c):
    return labelling.label_batches(rows(c, F.regexp_replace("content", r"\s+", " ").alias("text")), by_kind, chars=500, default="ARTICLE")


@query("cls12")
def _(c):
    return labelling.label_batches(rows(c, F.regexp_replace("content", r"\s+", " ").alias("text")), by_words, batch=1)


@query("topic_naming")
def _(c):
    return labelling.topic_names(models.lda(tokens(c), "id")[1])


@query("llm02")
def _(c):
    """Names from representative documents: the class-weighted words of each dominant topic."""
    from pyspark.sql import Window

    t = tokens(c).join(c.topics.select("id", "dominant_topic"), "id")
    w = models.class_tfidf(t, "dominant_topic", "tokens").withColumn("rank", F.row_number().over(Window.partitionBy("dominant_topic").orderBy(F.desc("weight"), "w")))
    return labelling.topic_names(w.select(F.col("dominant_topic").alias("topic"), "rank", F.col("w").alias("word")))


@query("gensim_lda")
def _(c):
    return models.lda(tokens(c), "id", k=6, iterations=10)[0].select("id", F.size("topic_distribution").alias("k"), "dominant_topic")


@query("hdp")
def _(c):
    """The number of topics with weight: a generous LDA whose unused topics are left out, in place of a non-parametric model."""
    docs = models.lda(tokens(c), "id", k=12, iterations=10)[0]
    return docs.groupBy("dominant_topic").agg(F.count("*").alias("n"))


@query("topic_words")
def _(c):
    return models.lda(tokens(c), "id")[1].select("topic", "word", F.round("weight", 6).alias("weight"))


@query("spacy_docs")
def _(c):
    t = models.token_column(F.coalesce(F.col("cleaned_text"), F.col("content")), [])
    return rows(c, t.alias("t")).select("id", F.size("t").alias("n"))


@query("procrustes")
def _(c):
    from pyspark.ml.functions import vector_to_array

    from ..session import materialize

    t, periods = by_period(c)
    v = [materialize(models.word_vectors(t.filter(F.col("period") == p), 8).getVectors().select("word", vector_to_array("vector").alias("vector")), "w2v") for p in periods[:2]]
    rotation, error = models.procrustes(v[1], v[0])
    return c.spark.createDataFrame([(i, [float(x) for x in r], error) for i, r in enumerate(rotation)], "i int, rotation array<double>, error double")


@query("windowed_events", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(c):
    from ..streaming.windows import windowed_counts

    return windowed_counts(c.raw("events")).select("start", "event_type", "n")
