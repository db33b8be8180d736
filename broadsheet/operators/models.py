"""Models on pyspark.ml: topics, clusters, word vectors, classifiers. All seeded."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import LDA, BisectingKMeans, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import IDF, PCA, CountVectorizer, NGram, VectorAssembler, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import materialize


#: Words that a model's vocabulary can hold: above any language's.
VOCABULARY = 1 << 24


def token_column(text: Column, stop: list[str], least: int = 3) -> Column:
    words = F.array(*map(F.lit, stop))
    return F.filter(tokens(text, r"\p{L}+"), lambda w: (F.length(w) >= least) & ~F.array_contains(words, w))


def lda(df: DataFrame, key: str, k: int = 5, min_df: float = 5, max_df: float = 0.7, iterations: int = 10, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """``key, topic_distribution, dominant_topic`` of documents (``tokens``) and ``topic, rank, word, weight`` of the topics."""
    cv = CountVectorizer(inputCol="tokens", outputCol="features", minDF=min_df, maxDF=max_df, vocabSize=VOCABULARY).fit(df)
    x = cv.transform(df)
    model = LDA(k=k, seed=seed, maxIter=iterations, optimizer="online").fit(x)
    d = vector_to_array("topicDistribution")
    docs = model.transform(x).select(key, d.alias("topic_distribution")).withColumn("dominant_topic", F.expr("cast(array_position(topic_distribution, array_max(topic_distribution)) - 1 as int)"))
    vocab = F.array(*map(F.lit, cv.vocabulary)) if len(cv.vocabulary) <= 5000 else None
    top = model.describeTopics(10).select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("rank", "z"))
    if vocab is not None:
        words = top.select("topic", F.col("rank") + 1, F.element_at(vocab, F.col("z.termIndices") + 1), "z.termWeights")
    else:
        names = df.sparkSession.createDataFrame(list(enumerate(cv.vocabulary)), "i int, word string")
        words = top.join(names, F.col("z.termIndices") == F.col("i")).select("topic", F.col("rank") + 1, "word", "z.termWeights")
    return docs, words.toDF("topic", "rank", "word", "weight")


def numbered(keys: DataFrame, key: str, name: str, parts: int = 1024) -> DataFrame:
    """``key`` with a number of its own from 0 on, without gaps: places within ``parts`` hash partitions after these partitions' counts."""
    p = keys.select(key).distinct().withColumn("_p", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
    counts, start = dict(p.groupBy("_p").count().collect()), {}
    total = 0
    for k in sorted(counts):
        start[k] = total
        total += counts[k]
    first = F.create_map(*(F.lit(x) for kv in start.items() for x in kv)) if start else F.create_map(F.lit(0), F.lit(0))
    return p.withColumn(name, (F.element_at(first, F.col("_p")) + F.row_number().over(Window.partitionBy("_p").orderBy(key)) - 1).cast("int")).drop("_p")


def nmf(df: DataFrame, key: str, k: int = 5, min_df: float = 5, iterations: int = 10, seed: int = 42) -> DataFrame:
    """Non-negative factors of the tf-idf matrix by alternating least squares: ``key, topic, weight``.

    The matrix is rows of document, word and value from counts, never a vector as wide as the vocabulary; documents and
    words are numbered without collisions.
    """
    from pyspark.ml.recommendation import ALS

    tf = df.select(key, F.explode("tokens").alias("w")).groupBy(key, "w").agg(F.count("*").alias("tf"))
    words = tf.groupBy("w").agg(F.count("*").alias("df")).filter(F.col("df") >= min_df)
    n = df.select(key).distinct().count()
    ids, places = materialize(numbered(df, key, "doc"), "nmf_documents"), materialize(numbered(words, "w", "word"), "nmf_words")
    x = tf.join(words, "w").withColumn("v", F.col("tf") * F.log((F.lit(n) + 1.0) / (F.col("df") + 1.0))).filter("v > 0")
    cells = x.join(places, "w").join(ids, key).select("doc", "word", F.col("v").cast("float").alias("v"))
    model = ALS(rank=k, nonnegative=True, maxIter=iterations, userCol="doc", itemCol="word", ratingCol="v", seed=seed).fit(cells)
    return model.userFactors.withColumnRenamed("id", "doc").join(ids, "doc").select(key, F.posexplode("features").alias("topic", "weight"))


def best_pick(scores: DataFrame, score: str, order: str, highest: bool = True) -> DataFrame:
    """The one row with the best score, of equals the first in ``order``."""
    return scores.orderBy(F.desc(score) if highest else F.asc(score), order).limit(1)


def save_model(model, path: str) -> None:
    """A fitted pyspark.ml model or pipeline at ``path``, in place of what is there."""
    model.write().overwrite().save(path)


def load_model(path: str):
    """A model saved by ``save_model``, whatever its class."""
    from pyspark.ml.util import DefaultParamsReader
    from pyspark.sql import SparkSession

    meta = DefaultParamsReader.loadMetadata(path, SparkSession.active())
    kind = meta["class"].replace("org.apache.spark.ml", "pyspark.ml")
    module, name = kind.rsplit(".", 1)
    import importlib

    while module and not hasattr(m := importlib.import_module(module), name):  # the JVM's packages are deeper than Python's modules
        module = module.rsplit(".", 1)[0]
    return getattr(m, name).load(path)


def auto_k(df: DataFrame, ks: list[int], vector: str = "features", seed: int = 42) -> DataFrame:
    """``k, silhouette, cost`` for each number of clusters; the driver only loops over the candidates."""
    rows = []
    for k in ks:
        m = KMeans(k=k, seed=seed, featuresCol=vector).fit(df)
        rows.append((k, float(ClusteringEvaluator(featuresCol=vector).evaluate(m.transform(df))), float(m.summary.trainingCost)))
    return df.sparkSession.createDataFrame(rows, "k int, silhouette double, cost double")


def kmeans(df: DataFrame, key: str, vector: str, k: int, seed: int = 42) -> DataFrame:
    x = df.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    return KMeans(k=k, seed=seed).fit(x).transform(x).select(key, F.col("prediction").alias("cluster"))


def calinski_davies(df: DataFrame, label: str, vector: str, size: int) -> DataFrame:
    """Calinski-Harabasz and Davies-Bouldin scores of given labels, by aggregation."""
    from .clusters import centroids, distance

    c = centroids(df, label, vector, size)
    d = df.join(F.broadcast(c), label).withColumn("_d", distance(F.col(vector).cast("array<double>"), F.col("center")))
    per = d.groupBy(label).agg(F.count("*").alias("n"), F.avg("_d").alias("s"), F.sum(F.col("_d") * F.col("_d")).alias("w"), F.first("center").alias("center"))
    rows = per.collect()  # one row a cluster
    n, k = sum(r["n"] for r in rows), len(rows)
    m = np.array([r["center"] for r in rows])
    mean = np.average(m, 0, [r["n"] for r in rows])
    between = sum(r["n"] * ((x - mean) ** 2).sum() for r, x in zip(rows, m, strict=True))
    within = sum(r["w"] for r in rows)
    gap = np.linalg.norm(m[:, None] - m[None], axis=2)
    s = np.array([r["s"] for r in rows])
    db = np.mean([max((s[i] + s[j]) / gap[i, j] for j in range(k) if j != i) for i in range(k)]) if k > 1 else 0.0
    return df.sparkSession.createDataFrame([(float(between / (k - 1) / (within / (n - k))) if k > 1 and n > k and within else 0.0, float(db))], "calinski_harabasz double, davies_bouldin double")


def projection(df: DataFrame, key: str, vector: str) -> DataFrame:
    x = df.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    p = vector_to_array("p")
    return PCA(k=2, inputCol="features", outputCol="p").fit(x).transform(x).select(key, p[0].alias("x"), p[1].alias("y"))


def embedding_topics(df: DataFrame, key: str, vector: str, k: int, seed: int = 42) -> DataFrame:
    """Topics from document embeddings: principal components, then bisecting k-means."""
    x = df.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("raw"))
    x = PCA(k=8, inputCol="raw", outputCol="features").fit(x).transform(x)
    return BisectingKMeans(k=k, seed=seed).fit(x).transform(x).select(key, F.col("prediction").alias("topic"))


def class_tfidf(df: DataFrame, label: str, words: str) -> DataFrame:
    """c-TF-IDF of words by class: share within the class times log(1 + average class size / frequency of the word)."""
    tf = df.select(label, F.explode(words).alias("w")).groupBy(label, "w").agg(F.count("*").alias("n"))
    size = tf.groupBy(label).agg(F.sum("n").alias("size"))
    freq = tf.groupBy("w").agg(F.sum("n").alias("f"))
    mean = size.agg(F.avg("size").alias("mean"))
    return tf.join(F.broadcast(size), label).join(freq, "w").join(F.broadcast(mean)).select(label, "w", (F.col("n") / F.col("size") * F.log(1 + F.col("mean") / F.col("f"))).alias("weight"))


def word_vectors(df: DataFrame, size: int = 50, min_count: int = 5, window: int = 5, seed: int = 42):
    """Skip-gram word vectors of ``tokens``."""
    return Word2Vec(vectorSize=size, minCount=min_count, windowSize=window, inputCol="tokens", outputCol="v", seed=seed, maxIter=1).fit(df)


def procrustes(source: DataFrame, target: DataFrame, least: int = 10) -> tuple[np.ndarray, float]:
    """The rotation that brings ``word, vector`` of one model nearest to another's, and the mean error.

    Only the cross-covariance of the shared words, size by size, is aggregated and sent to the driver. With fewer than
    ``least`` shared words: no rotation, infinite error.
    """
    j = source.select("word", F.col("vector").alias("a")).join(target.select("word", F.col("vector").alias("b")), "word")
    first = j.agg(F.count("*").alias("n"), F.max(F.size("a")).alias("d")).first()
    d = first["d"] or 0
    if first["n"] < least:
        return np.eye(d), float("inf")
    m = j.agg(*(F.sum(F.col("a")[i] * F.col("b")[k]).alias(f"m{i}_{k}") for i in range(d) for k in range(d)), F.sum(F.aggregate("a", F.lit(0.0), lambda s, x: s + x * x)).alias("aa"), F.sum(F.aggregate("b", F.lit(0.0), lambda s, x: s + x * x)).alias("bb")).first()
    c = np.array([[m[f"m{i}_{k}"] for k in range(d)] for i in range(d)])
    u, s, v = np.linalg.svd(c)
    return u @ v, float(max(0.0, m["aa"] + m["bb"] - 2 * s.sum()) / first["n"])


def semantic_drift(models: dict[str, DataFrame], terms: list[str], reference: str | None = None) -> DataFrame:
    """``term, period, semantic_distance``: cosine distance of each period's aligned vector to the reference period's."""
    from functools import reduce

    from .clusters import cosine

    reference = reference or min(models)
    base = models[reference].filter(F.col("word").isin(terms)).select("word", F.col("vector").alias("r"))
    out = []
    for period, m in sorted(models.items()):
        if period == reference:
            out.append(base.select(F.col("word").alias("term"), F.lit(period).alias("period"), F.lit(0.0).alias("semantic_distance")))
            continue
        rot, _ = procrustes(m, models[reference])
        d = len(rot)
        turned = F.array(*(sum((F.col("vector")[i] * float(rot[i, k]) for i in range(d)), F.lit(0.0)) for k in range(d)))
        x = m.filter(F.col("word").isin(terms)).select("word", turned.alias("v")).join(base, "word")
        out.append(x.select(F.col("word").alias("term"), F.lit(period).alias("period"), (1 - cosine(F.col("v"), F.col("r"))).alias("semantic_distance")))
    return reduce(lambda a, b: a.unionByName(b), out)


def text_classifier(seed: int = 42) -> Pipeline:
    """TF-IDF of one to three words beside surface features, logistic regression with balanced classes (column ``weight``)."""
    stages, cols = [], []
    for n in (1, 2, 3):
        stages += [NGram(n=n, inputCol="tokens", outputCol=f"g{n}"), CountVectorizer(inputCol=f"g{n}", outputCol=f"c{n}", minDF=2, maxDF=0.9, vocabSize=1700), IDF(inputCol=f"c{n}", outputCol=f"i{n}")]
        cols.append(f"i{n}")
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=[*cols, "n_chars", "n_words", "digits", "capitals"], outputCol="features"), LogisticRegression(weightCol="weight", maxIter=30, regParam=0.01)])


def balanced(df: DataFrame, label: str = "label") -> DataFrame:
    n = df.groupBy(label).agg(F.count("*").alias("_c"))
    total = n.agg(F.sum("_c").alias("_t"), F.count("*").alias("_k"))
    return df.join(F.broadcast(n.join(F.broadcast(total)).select(label, (F.col("_t") / (F.col("_k") * F.col("_c"))).alias("weight"))), label)
