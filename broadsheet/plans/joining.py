"""Joins and enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import parse_date
from ..functions.text import content_hash, percent
from ..operators import filters as f
from ..operators.clusters import distance
from .base import Corpus, query
from .strings import NORM, rows

NAMES = {0: "Politique", 1: "Internet", 2: "Informatique", 3: "Culture"}


def topic_names(c: Corpus):
    return c.spark.createDataFrame(list(NAMES.items()), "topic int, name string")


NAMES_SQL = "(VALUES " + ", ".join(f"({k}, '{v}')" for k, v in NAMES.items()) + ") names(topic, name)"


def enriched(c: Corpus):
    """Articles with topic, score of the dominant topic, cluster, sentiment and number of entities; all joins by id."""
    t = c.topics.select("id", "dominant_topic", F.try_element_at("topic_distribution", F.col("dominant_topic") + 1).alias("score_topic"))
    k = c.biblio.groupBy(F.col("id_article").alias("id")).agg(F.max("cluster").alias("cluster"))
    e = c.runs.select("id", F.size("entities").cast("long").alias("n_entities"))
    df = rows(c, "title", "newspaper").join(t, "id", "left").join(k, "id", "left").join(c.sentiment.select("id", "compound"), "id", "left").join(e, "id", "left")
    return df.join(F.broadcast(topic_names(c)), F.col("dominant_topic") == F.col("topic"), "left")


ENRICHED = f"""(SELECT a.id, title, newspaper, dominant_topic, topic_distribution[dominant_topic + 1] AS score_topic, k.cluster, compound, CAST(len(entities) AS BIGINT) AS n_entities, name FROM a LEFT JOIN doc_topics t ON a.id = t.id
LEFT JOIN (SELECT id_article, max(cluster) AS cluster FROM b GROUP BY 1) k ON a.id = k.id_article LEFT JOIN sentiment_scores s ON a.id = s.id LEFT JOIN r ON a.id = r.id LEFT JOIN {NAMES_SQL} ON dominant_topic = names.topic)"""


@query("enrich_articles", f"SELECT id, dominant_topic, score_topic, cluster, compound, n_entities, CASE WHEN dominant_topic IS NOT NULL THEN coalesce(name, concat('Topic ', dominant_topic)) END AS topic_name FROM {ENRICHED}")
def _(c):
    name = F.when(F.col("dominant_topic").isNotNull(), F.coalesce("name", F.concat(F.lit("Topic "), F.col("dominant_topic").cast("string"))))
    return enriched(c).select("id", "dominant_topic", "score_topic", "cluster", "compound", "n_entities", name.alias("topic_name"))


@query("biblio_export", """SELECT a.id AS id_article, title AS titre, date, newspaper AS journal, (SELECT string_agg(t, ', ' ORDER BY t) FROM (SELECT DISTINCT text AS t FROM m WHERE m.id = a.id)) AS entities, (SELECT string_agg(t, ', ' ORDER BY t) FROM (SELECT DISTINCT text AS t FROM m WHERE m.id = a.id AND label = 'ORG')) AS entities_org,
(SELECT string_agg(t, ', ' ORDER BY t) FROM (SELECT DISTINCT text AS t FROM m WHERE m.id = a.id AND label = 'LOC')) AS entities_loc, (CAST(round(CAST(topic_distribution[dominant_topic + 1] * 100 AS DECIMAL(20, 6)), 2) AS VARCHAR) || '%') AS score_topic, compound AS sentiment FROM a LEFT JOIN doc_topics t ON a.id = t.id LEFT JOIN sentiment_scores s ON a.id = s.id""")
def _(c):
    def names(label: str | None = None):
        e = F.col("entities") if label is None else F.filter("entities", lambda x: x["label"] == label)
        joined = F.array_join(F.array_sort(F.array_distinct(F.transform(e, lambda x: x["text"]))), ", ")
        return F.when(F.size(e) > 0, joined)

    df = rows(c, "title", "date", "newspaper").join(c.runs.select("id", "entities"), "id", "left").join(c.topics, "id", "left").join(c.sentiment.select("id", "compound"), "id", "left")
    score = percent(F.try_element_at("topic_distribution", F.col("dominant_topic") + 1))
    return df.select(
        F.col("id").alias("id_article"), F.col("title").alias("titre"), "date", F.col("newspaper").alias("journal"), names().alias("entities"), names("ORG").alias("entities_org"), names("LOC").alias("entities_loc"),
        F.when(F.col("dominant_topic").isNotNull() & F.col("topic_distribution").isNotNull(), score).alias("score_topic"), F.col("compound").alias("sentiment"),
    )


@query("topic_browser", "SELECT t.id, coalesce(a.title, x.title, 'Titre non disponible') AS title, coalesce(a.newspaper, x.newspaper, 'Journal non disponible') AS newspaper FROM doc_topics t LEFT JOIN a ON t.id = a.id LEFT JOIN (SELECT base_id, min(title) AS title, min(newspaper) AS newspaper FROM a WHERE base_id IS NOT NULL GROUP BY base_id) x ON split_part(t.id, '_mistral', 1) = x.base_id")
def _(c):
    a = rows(c, "base_id", "title", "newspaper")
    x = a.filter("base_id is not null").groupBy("base_id").agg(F.min("title").alias("t2"), F.min("newspaper").alias("n2"))
    df = c.topics.select("id").join(a.drop("base_id"), "id", "left").join(x, F.split("id", "_mistral")[0] == F.col("base_id"), "left")
    return df.select("id", F.coalesce("title", "t2", F.lit("Titre non disponible")).alias("title"), F.coalesce("newspaper", "n2", F.lit("Journal non disponible")).alias("newspaper"))


@query("latest_clusters", "SELECT id_article AS doc_id, cluster FROM b WHERE cluster IS NOT NULL")
def _(c):
    from ..sources.readers import rows_of_arrays

    wide = c.biblio.filter("cluster is not null").groupBy(F.expr("pmod(hash(id_article), 64)").alias("part")).agg(F.collect_list(F.struct("id_article", "cluster")).alias("x")).select(F.col("x.id_article").alias("doc_ids"), F.col("x.cluster").alias("labels"))
    return rows_of_arrays(wide, "doc_ids", "labels", "doc_id", "cluster")


@query("cluster_assign", "SELECT a.id, cluster FROM a JOIN b ON a.id = b.id_article WHERE cluster IS NOT NULL")
def _(c):
    return rows(c).join(c.biblio.filter("cluster is not null").select(F.col("id_article").alias("id"), "cluster"), "id")


@query("topic_info_attach", f"SELECT t.id, dominant_topic, coalesce(name, concat('Topic ', dominant_topic)) AS topic_name, cluster FROM doc_topics t LEFT JOIN {NAMES_SQL} ON dominant_topic = names.topic LEFT JOIN b ON t.id = b.id_article")
def _(c):
    df = c.topics.select("id", "dominant_topic").join(F.broadcast(topic_names(c)), F.col("dominant_topic") == F.col("topic"), "left").join(c.biblio.select(F.col("id_article").alias("id"), "cluster"), "id", "left")
    return df.select("id", "dominant_topic", F.coalesce("name", F.concat(F.lit("Topic "), F.col("dominant_topic").cast("string"))).alias("topic_name"), "cluster")


@query("topic_weight_semi", "SELECT a.id FROM a JOIN doc_topics t ON a.id = t.id WHERE topic_distribution[2] >= 0.5")
def _(c):
    return rows(c).join(c.topics.filter(F.try_element_at("topic_distribution", F.lit(2)) >= 0.5).select("id"), "id", "left_semi")


@query("topic_weight_semi_dict", "SELECT a.id FROM a JOIN doc_topics t ON a.id = t.id WHERE topic_distribution[3] >= 0.5")
def _(c):
    weights = c.topics.select("id", F.col("topic_distribution").alias("w"))
    return rows(c).join(weights.filter(F.try_element_at("w", F.lit(3)) >= 0.5).select("id"), "id", "left_semi")


@query("term_category", "SELECT term, category FROM (VALUES ('ordinateur', 'machines'), ('réseau', 'liens'), ('puce', 'machines'), ('tunnel', 'voies')) t(term, category)")
def _(c):
    t = c.spark.createDataFrame([(0, "ordinateur", "outils"), (1, "ordinateur", "machines"), (2, "réseau", "liens"), (3, "puce", "machines"), (4, "tunnel", "voies")], "k int, term string, category string")
    return t.groupBy("term").agg(F.max_by("category", "k").alias("category"))


FREQ = "(SELECT CAST(year(d) AS INTEGER) AS period, canton AS term, count(*) AS n FROM a WHERE d IS NOT NULL AND canton IS NOT NULL GROUP BY 1, 2)"
DRIFT = "(SELECT CAST(year(d) AS INTEGER) + 1 AS period, canton AS term, round(avg(word_count), 10) AS drift FROM a WHERE d IS NOT NULL AND canton IS NOT NULL GROUP BY 1, 2)"


@query("freq_drift_merge", f"SELECT period, term, n, drift FROM {FREQ} x FULL OUTER JOIN {DRIFT} y USING (period, term)")
def _(c):
    base = rows(c, F.year(parse_date(F.col("date"))).alias("period"), F.col("canton").alias("term"), "word_count").filter("period is not null and term is not null")
    x = base.groupBy("period", "term").agg(F.count("*").alias("n"))
    y = base.groupBy((F.col("period") + 1).alias("period"), "term").agg(F.round(F.avg("word_count"), 10).alias("drift"))
    return x.join(y, ["period", "term"], "full_outer").select("period", "term", "n", "drift")


@query("id_newspaper", "SELECT s.id, coalesce(newspaper, 'Inconnu') AS newspaper FROM sentiment_scores s LEFT JOIN a ON s.id = a.id")
def _(c):
    return c.sentiment.select("id").join(rows(c, "newspaper"), "id", "left").select("id", F.coalesce("newspaper", F.lit("Inconnu")).alias("newspaper"))


@query("id_list_semi", "SELECT id FROM a WHERE id IN (SELECT id_article FROM b WHERE sentiment > 0.5)")
def _(c):
    return rows(c).join(c.biblio.filter("sentiment > 0.5").select(F.col("id_article").alias("id")), "id", "left_semi")


@query("near_dup_range", f"""SELECT x.id, count(*) AS links FROM (SELECT id, d, CASE WHEN {NORM} = '' THEN '' ELSE md5(substring({NORM}, 1, 1000)) END AS h FROM a) x JOIN (SELECT id, d, CASE WHEN {NORM} = '' THEN '' ELSE md5(substring({NORM}, 1, 1000)) END AS h FROM a) y ON x.h = y.h AND x.h <> '' AND x.id <> y.id AND abs(date_diff('day', x.d, y.d)) <= 3 GROUP BY x.id""")
def _(c):
    from ..operators.dedup import links_within

    return links_within(rows(c, parse_date(F.col("date")).alias("d"), content_hash(F.col("content")).alias("h")), 3)


@query("fuzzy_substring", "SELECT x, min(y) AS y FROM (SELECT DISTINCT source AS x FROM a WHERE source IS NOT NULL) JOIN (SELECT DISTINCT newspaper AS y FROM a WHERE newspaper IS NOT NULL) ON contains(y, x) OR contains(x, y) GROUP BY x")
def _(c):
    # Two dimensions of names, distinct before they meet; the theta join is theirs, not the articles'.
    df = rows(c, "source", "newspaper")
    x, y = df.select(F.col("source").alias("x")).dropna().distinct(), df.select(F.col("newspaper").alias("y")).dropna().distinct()
    return x.join(y, F.contains("y", "x") | F.contains("x", "y")).groupBy("x").agg(F.min("y").alias("y"))


@query("doc_vector_join", "SELECT a.id, CAST(len(topic_distribution) AS BIGINT) AS dims FROM a JOIN doc_topics t ON a.id = t.id")
def _(c):
    return rows(c).join(c.topics.select("id", F.size("topic_distribution").cast("long").alias("dims")), "id")


CENTROIDS = "(SELECT label, k, avg(x) AS c FROM (SELECT label, vec_id, unnest(range(1, 65)) AS k, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings) GROUP BY label, k)"


def with_centers(c: Corpus):
    from ..operators.clusters import centroids

    e = c.raw("embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    return e.join(F.broadcast(centroids(e, "label", "v", 64)), "label")


@query("centroid_distance", f"SELECT vec_id, round(sqrt(sum((x - c) * (x - c))), 4) AS dist FROM (SELECT label, vec_id, unnest(range(1, 65)) AS k, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings) JOIN {CENTROIDS} USING (label, k) GROUP BY vec_id")
def _(c):
    return with_centers(c).select("vec_id", F.round(distance(F.col("v"), F.col("center")), 4).alias("dist"))


@query("cluster_center_join", "SELECT vec_id, e.label, n FROM embeddings e JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY label) USING (label)")
def _(c):
    e = c.raw("embeddings").select("vec_id", "label")
    return e.join(F.broadcast(e.groupBy("label").agg(F.count("*").alias("n"))), "label").select("vec_id", "label", "n")


@query("mediation_details", "SELECT s.id, compound, title, date FROM sentiment_scores s LEFT JOIN a ON s.id = a.id")
def _(c):
    return c.sentiment.select("id", "compound").join(rows(c, "title", "date"), "id", "left")


@query("topic_debug_join", "SELECT dominant_topic, a.id, title FROM doc_topics t JOIN a ON t.id = a.id")
def _(c):
    return c.topics.select("id", "dominant_topic").join(rows(c, "title"), "id").select("dominant_topic", "id", "title")


@query("entity_lookup", "SELECT DISTINCT id FROM m WHERE label = 'ORG'")
def _(c):
    return f.has_entity(c.runs.select("id", "entities"), label="ORG").select("id")


@query("cluster_vs_sentiment", "SELECT count(*) AS n, round(avg(compound), 10) AS mean FROM sentiment_scores WHERE id IN (SELECT id_article FROM b WHERE cluster = '2')")
def _(c):
    ids = c.biblio.filter("cluster = '2'").select(F.col("id_article").alias("id"))
    return c.sentiment.join(ids, "id", "left_semi").agg(F.count("*").alias("n"), F.round(F.avg("compound"), 10).alias("mean"))


@query("cluster_vs_entities", "SELECT label, count(*) AS n, count(DISTINCT id) AS docs FROM m WHERE id IN (SELECT id_article FROM b WHERE cluster = '2') GROUP BY label")
def _(c):
    from ..operators.entities import summary

    ids = c.biblio.filter("cluster = '2'").select(F.col("id_article").alias("id"))
    return summary(c.mentions.join(ids, "id", "left_semi"))


@query("term_topic_cluster_filter", "SELECT id FROM a WHERE (id IN (SELECT id FROM doc_topics WHERE dominant_topic = 1) OR id IN (SELECT id_article FROM b WHERE cluster = '3')) AND id NOT IN (SELECT id FROM doc_topics WHERE dominant_topic = 4)")
def _(c):
    t = c.topics
    ids = t.filter("dominant_topic = 1").select("id").union(c.biblio.filter("cluster = '3'").select("id_article")).distinct()
    return rows(c).join(ids, "id", "left_semi").join(t.filter("dominant_topic = 4").select("id"), "id", "left_anti")
