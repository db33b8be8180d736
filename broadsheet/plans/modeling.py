"""Models: rows-only in the driver's check, invariants in the tests."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ..functions.dates import article_year, decade
from ..operators import models, rules
from ..session import materialize
from .base import Corpus, query
from .strings import STOP, rows


def tokens(c: Corpus):
    return materialize(rows(c, models.token_column(F.col("content"), STOP, 4).alias("tokens")).filter(F.size("tokens") > 0), "tokens")


@query("spacy_tokens")
def _(c):
    return rows(c, models.token_column(F.col("content"), STOP).alias("tokens")).select("id", F.size("tokens").alias("n"), F.array_join("tokens", " ").alias("tokens"))


@query("lda_sklearn")
def _(c):
    return models.lda(tokens(c), "id")[0].select("id", "dominant_topic")


@query("top_terms_topic")
def _(c):
    return models.lda(tokens(c), "id")[1].select("topic", "rank", "word", F.round("weight", 6).alias("weight"))


@query("nmf")
def _(c):
    return models.nmf(tokens(c), "id", k=4, min_df=20, iterations=5)


@query("coherence")
def _(c):
    from ..operators.topics import u_mass

    t = tokens(c)
    _, words = models.lda(t, "id")
    pairs = t.select(F.col("id").alias("doc"), F.explode(F.array_distinct("tokens")).alias("word"))
    return u_mass(pairs, words.select("topic", "rank", "word"))


@query("auto_k_topics")
def _(c):
    from functools import reduce

    from ..operators.topics import u_mass

    t = tokens(c)
    pairs = t.select(F.col("id").alias("doc"), F.explode(F.array_distinct("tokens")).alias("word"))
    out = [u_mass(pairs, models.lda(t, "id", k, iterations=5)[1].select("topic", "rank", "word")).agg(F.lit(k).alias("k"), F.avg("u_mass").alias("u_mass")) for k in (3, 5, 7)]
    return reduce(lambda a, b: a.unionByName(b), out)


@query("bertopic")
def _(c):
    return models.embedding_topics(c.raw("embeddings"), "vec_id", "embedding", 8)


@query("kmeans")
def _(c):
    return models.kmeans(c.topics, "id", "topic_distribution", 6)


@query("auto_k")
def _(c):
    x = materialize(c.topics.select("id", array_to_vector("topic_distribution").alias("features")), "vectors")
    return models.auto_k(x, [2, 4, 6, 8])


@query("cluster_metrics")
def _(c):
    k = materialize(models.kmeans(c.topics, "id", "topic_distribution", 6).join(c.topics, "id"), "labels")
    return models.calinski_davies(k, "cluster", "topic_distribution", 8)


@query("map_projection")
def _(c):
    return models.projection(c.topics, "id", "topic_distribution")


@query("class_tfidf")
def _(c):
    t = rows(c, models.token_column(F.col("content"), STOP).alias("tokens")).join(c.topics.select("id", "dominant_topic"), "id")
    return models.class_tfidf(t, "dominant_topic", "tokens").select("dominant_topic", "w", F.round("weight", 6).alias("weight"))


def by_period(c: Corpus):
    t = rows(c, models.token_column(F.col("content"), STOP, 4).alias("tokens"), "date").withColumn("period", decade(article_year(F.col("date"), F.col("id")))).filter("period is not null and size(tokens) > 0")
    t = materialize(t.select("id", "period", "tokens"), "periods")
    return t, sorted(r[0] for r in t.groupBy("period").count().filter("count >= 50").collect())


@query("w2v_per_period")
def _(c):
    from functools import reduce

    t, periods = by_period(c)
    out = [models.word_vectors(t.filter(F.col("period") == p), 20).getVectors().select(F.lit(p).alias("period"), "word") for p in periods]
    return reduce(lambda a, b: a.unionByName(b), out)


@query("semantic_drift")
def _(c):
    from pyspark.ml.functions import vector_to_array

    t, periods = by_period(c)
    vectors = {p: materialize(models.word_vectors(t.filter(F.col("period") == p), 10).getVectors().select("word", vector_to_array("vector").alias("vector")), "w2v") for p in periods}
    return models.semantic_drift(vectors, ["tunnel", "pont", "commission", "ordinateur"])


@query("train_classifier")
def _(c):
    """Programmes and small ads against the rest, by the rules' labels, with scores on held-out rows."""
    from ..operators.sampling import split

    df = rows(c, "content", "title").filter("content <> ''").select("id", (rules.classify(F.col("title"), F.col("content")) != "normal").cast("double").alias("label"), models.token_column(F.col("content"), STOP).alias("tokens"), *rules.features(F.col("content")))
    df = split(materialize(models.balanced(df), "labelled"), "id", "label", 0.8, 42)
    out = models.text_classifier().fit(df.filter("part = 'train'")).transform(df.filter("part = 'test'"))
    return out.groupBy("label", "prediction").agg(F.count("*").alias("n"))


@query("best_model_pick", "SELECT dominant_topic AS k, round(avg(topic_distribution[dominant_topic + 1]), 6) AS score FROM doc_topics WHERE dominant_topic IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def _(c):
    """Of candidates with a mean score the best, of equals the first."""
    t = c.topics.filter("dominant_topic is not null")
    scores = t.groupBy(F.col("dominant_topic").alias("k")).agg(F.round(F.avg(F.try_element_at("topic_distribution", F.col("dominant_topic") + 1)), 6).alias("score"))
    return models.best_pick(scores, "score", "k")


@query("model_round_trip")
def _(c):
    """Topics of documents by a model that was saved and loaded again."""
    import uuid

    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer

    from ..session import shared_dir

    t = materialize(rows(c, models.token_column(F.col("content"), STOP, 4).alias("tokens")).filter("size(tokens) > 0"), "tokens")
    cv = CountVectorizer(inputCol="tokens", outputCol="features", minDF=5, vocabSize=models.VOCABULARY).fit(t)
    x = cv.transform(t)
    path = f"{shared_dir(c.spark)}/model-{uuid.uuid4().hex}"
    models.save_model(LDA(k=5, seed=42, maxIter=5).fit(x), path)
    d = models.vector_to_array("topicDistribution")
    return models.load_model(path).transform(x).select("id", F.array_position(d, F.array_max(d)).cast("int").alias("topic"))
