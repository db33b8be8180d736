"""Rankings, top-k reports, sorting and pages. A total order breaks every tie."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import parse_date
from ..functions.text import clean_journal_name
from ..operators import graphs, lexical
from ..operators.clusters import distance, scale_in_cluster, top_per_group
from ..operators.dedup import exact_groups
from .aggregating import CL, SC, TC, TERMS, canton_scores, clustered, counts
from .base import Corpus, query
from .filtering import SIM, similar
from .joining import CENTROIDS, with_centers
from .strings import CLEAN_J, STOP, rows


def ranked(sql: str, part: str, order: str, n: int, cols: str) -> str:
    return f"SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY {order}) AS rank FROM {sql}) WHERE rank <= {n}"


ENT = "(SELECT label, text, count(*) AS n FROM m GROUP BY 1, 2)"


@query("topk_entities_per_type", ranked(ENT, "label", "n DESC, text", 10, "label, text, n"))
def _(c):
    return top_per_group(c.mentions.groupBy("label", "text").agg(F.count("*").alias("n")), ["label"], [F.desc("n"), F.col("text")], 10).drop("rank")


@query("ner_topn", ranked("(SELECT label, text, count(*) AS n FROM m WHERE label IN ('PER', 'ORG') GROUP BY 1, 2)", "label", "n DESC, text", 15, "label, text, n"))
def _(c):
    m = c.mentions.filter(F.col("label").isin("PER", "ORG"))
    return top_per_group(m.groupBy("label", "text").agg(F.count("*").alias("n")), ["label"], [F.desc("n"), F.col("text")], 15).drop("rank")


TOPW = rf"""(SELECT id, w, count(*) AS n, min(p) AS f FROM (SELECT id, unnest(t) AS w, unnest(range(0, len(t))) AS p FROM (SELECT id, list_filter(regexp_extract_all(lower(content), '\p{{L}}+'), lambda v: v NOT IN ({", ".join(f"'{w}'" for w in STOP)})) AS t FROM a WHERE content IS NOT NULL)) GROUP BY 1, 2)"""


@query("top5_words_per_doc", ranked(TOPW, "id", "n DESC, f", 5, "id, w, n, rank"))
def _(c):
    return lexical.top_words(rows(c, "content"), "id", F.col("content"), STOP).select("id", "w", "n", F.col("rank").cast("long").alias("rank"))


@query("top20_words", f"SELECT w, CAST(sum(n) AS BIGINT) AS n FROM ({ranked(TOPW, 'id', 'n DESC, f', 5, 'id, w, n')}) GROUP BY w ORDER BY 2 DESC, w LIMIT 20")
def _(c):
    return lexical.top_words(rows(c, "content"), "id", F.col("content"), STOP).groupBy("w").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "w").limit(20)


@query("top20_articles", f", {TC} SELECT id, term, n FROM tc WHERE id IN (SELECT id FROM tc GROUP BY id ORDER BY sum(n) DESC, id LIMIT 20)")
def _(c):
    t = counts(c)
    top = t.groupBy("id").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "id").limit(20)
    return t.join(top, "id", "left_semi").select("id", "term", "n")


@query("extremes_sentiment", "SELECT * FROM (SELECT 'negative' AS side, id, compound FROM sentiment_scores WHERE compound IS NOT NULL ORDER BY compound, id LIMIT 5) UNION ALL SELECT * FROM (SELECT 'positive', id, compound FROM sentiment_scores WHERE compound IS NOT NULL ORDER BY compound DESC, id LIMIT 5)")
def _(c):
    s = c.sentiment.filter("compound is not null").select("id", "compound")
    return s.orderBy("compound", "id").limit(5).select(F.lit("negative").alias("side"), "id", "compound").unionByName(s.orderBy(F.desc("compound"), "id").limit(5).select(F.lit("positive").alias("side"), "id", "compound"))


@query("topk_articles_by_entities", "SELECT id, CAST(len(entities) AS BIGINT) AS n FROM r ORDER BY len(entities) DESC NULLS LAST, id LIMIT 10")
def _(c):
    return c.runs.select("id", F.when(F.col("entities").isNotNull(), F.size("entities")).cast("long").alias("n")).orderBy(F.desc_nulls_last("n"), "id").limit(10)


DOM = "(SELECT id, dominant_topic, list_max(topic_distribution) AS p FROM doc_topics)"


@query("representative_docs", ranked(DOM, "dominant_topic", "p DESC, id", 3, "dominant_topic, id, p"))
def _(c):
    t = c.topics.select("id", "dominant_topic", F.array_max("topic_distribution").alias("p"))
    return top_per_group(t, ["dominant_topic"], [F.desc("p"), F.col("id")], 3).drop("rank")


@query("topic_articles_threshold", ranked("(SELECT id, k, p FROM (SELECT id, unnest(range(0, 8)) AS k, unnest(topic_distribution) AS p FROM doc_topics) WHERE p > 0.5)", "k", "p DESC, id", 10, "k, id, p"))
def _(c):
    t = c.topics.select("id", F.posexplode("topic_distribution").alias("k", "p")).filter("p > 0.5").withColumn("k", F.col("k").cast("long"))
    return top_per_group(t, ["k"], [F.desc("p"), F.col("id")], 10).drop("rank")


@query("topic_digest", "SELECT dominant_topic, id, p, n FROM (SELECT *, row_number() OVER (PARTITION BY dominant_topic ORDER BY p DESC, id) AS rank, count(*) OVER (PARTITION BY dominant_topic) AS n FROM " + DOM + ") WHERE rank <= 10")
def _(c):
    t = c.topics.select("id", "dominant_topic", F.array_max("topic_distribution").alias("p"))
    n = t.groupBy("dominant_topic").agg(F.count("*").alias("n"))
    return top_per_group(t, ["dominant_topic"], [F.desc("p"), F.col("id")], 10).join(F.broadcast(n), "dominant_topic").select("dominant_topic", "id", "p", "n")


@query("topn_similar", f", {SIM} " + ranked("sim", "term", "similarity DESC, word", 10, "term, word, similarity"))
def _(c):
    return top_per_group(similar(c), ["term"], [F.desc("similarity"), F.col("word")], 10).select("term", "word", "similarity")


@query("rank_emit", f", {SIM} " + ranked("sim", "term, period", "similarity DESC, word", 5, "term, period, rank, word, similarity"))
def _(c):
    return top_per_group(similar(c), ["term", "period"], [F.desc("similarity"), F.col("word")], 5).select("term", "period", F.col("rank").cast("long").alias("rank"), "word", "similarity")


DIST = f"(SELECT label, vec_id, sqrt(sum((x - c) * (x - c))) AS dist FROM (SELECT label, vec_id, unnest(range(1, 65)) AS k, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings) JOIN {CENTROIDS} USING (label, k) GROUP BY 1, 2)"


@query("minmax_scale_in_cluster", f"SELECT vec_id, label, round(s, 4) AS scaled, round(1 - s, 4) AS intensity FROM (SELECT *, (dist - min(dist) OVER w) / (max(dist) OVER w - min(dist) OVER w) AS s FROM {DIST} WINDOW w AS (PARTITION BY label))")
def _(c):
    d = with_centers(c).select("vec_id", "label", distance(F.col("v"), F.col("center")).alias("dist"))
    return scale_in_cluster(d, "label", "dist").select("vec_id", "label", F.round("scaled", 4).alias("scaled"), F.round("intensity", 4).alias("intensity"))


@query("top_topic_diffs", ranked(f"(SELECT vec_id, k - 1 AS k, round(abs(x - c), 4) AS diff, x > c AS above FROM (SELECT label, vec_id, unnest(range(1, 65)) AS k, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings) JOIN {CENTROIDS} USING (label, k))", "vec_id", "diff DESC, k", 3, "vec_id, diff"))
def _(c):
    diff = F.zip_with("v", "center", lambda x, m: F.round(F.abs(x - m), 4))
    return with_centers(c).select("vec_id", F.explode(F.slice(F.sort_array(diff, asc=False), 1, 3)).alias("diff"))


EDGES = "(SELECT least(x.text, y.text) AS a, greatest(x.text, y.text) AS b, count(*) AS n FROM (SELECT DISTINCT id, text FROM m) x JOIN (SELECT DISTINCT id, text FROM m) y ON x.id = y.id AND x.text < y.text GROUP BY 1, 2)"


def edges(c: Corpus):
    from ..operators.entities import cooccurrence

    return cooccurrence(c.mentions.select("id", "text", F.lit("").alias("label")))


@query("top_degree_subgraph", f"SELECT node, count(*) AS degree FROM (SELECT a AS node FROM {EDGES} WHERE n >= 2 UNION ALL SELECT b FROM {EDGES} WHERE n >= 2) GROUP BY node ORDER BY 2 DESC, node LIMIT 50")
def _(c):
    return graphs.top_degree(graphs.edge_filter(edges(c), 2, "n"), 50, "a", "b")


@query("top_edges", f"SELECT a, b, n FROM {EDGES} ORDER BY n DESC, a, b LIMIT 10")
def _(c):
    return edges(c).orderBy(F.desc("n"), "a", "b").limit(10)


@query("edge_filter", f"SELECT a, b, n FROM {EDGES} WHERE n >= 2")
def _(c):
    return graphs.edge_filter(edges(c), 2, "n")


@query("largest_component", None)
def _(c):
    return graphs.largest_component(graphs.edge_filter(edges(c), 2, "n").withColumnsRenamed({"a": "src", "b": "dst"}))


@query("first_n_per_term", ranked("(SELECT t AS topic, id, d FROM (SELECT unnest(topics) AS t, id, d FROM a) WHERE d IS NOT NULL)", "topic", "d, id", 5, "topic, id, d"))
def _(c):
    t = rows(c, parse_date(F.col("date")).alias("d"), "topics").filter("d is not null").select(F.explode("topics").alias("topic"), "id", "d")
    return top_per_group(t, ["topic"], [F.col("d"), F.col("id")], 5).drop("rank")


@query("canton_extremes", f", {SC} SELECT 'negative' AS side, canton, id FROM (SELECT *, row_number() OVER (PARTITION BY canton ORDER BY negative DESC NULLS LAST, id) AS k FROM cs) WHERE k <= 5 UNION ALL SELECT 'positive', canton, id FROM (SELECT *, row_number() OVER (PARTITION BY canton ORDER BY positive DESC NULLS LAST, id) AS k FROM cs) WHERE k <= 5")
def _(c):
    s = canton_scores(c)
    side = lambda k: top_per_group(s, ["canton"], [F.desc_nulls_last(k), F.col("id")], 5).select(F.lit(k).alias("side"), "canton", "id")
    return side("negative").unionByName(side("positive"))


@query("sort_browser", "SELECT id, topic_distribution[2] AS w FROM doc_topics ORDER BY topic_distribution[2] DESC, id")
def _(c):
    return c.topics.select("id", F.try_element_at("topic_distribution", F.lit(2)).alias("w")).orderBy(F.desc("w"), "id")


@query("pagination", "SELECT id FROM a ORDER BY id LIMIT 20 OFFSET 40")
def _(c):
    return rows(c).select("id").orderBy("id").offset(40).limit(20)


@query("limit_head", "SELECT id FROM a ORDER BY id LIMIT 20")
def _(c):
    return rows(c).select("id").orderBy("id").limit(20)


@query("latest_analyses", "SELECT id, run_at FROM r ORDER BY run_at DESC, id LIMIT 50")
def _(c):
    return c.runs.select("id", "run_at").orderBy(F.desc("run_at"), "id").limit(50)


@query("top_entities_plot", "SELECT text, count(*) AS n FROM m GROUP BY text ORDER BY 2 DESC, text LIMIT 20")
def _(c):
    return c.mentions.groupBy("text").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "text").limit(20)


@query("min_weight_edges", f"SELECT a, b, n FROM {EDGES} WHERE n >= 3")
def _(c):
    return graphs.edge_filter(edges(c), 3, "n")


@query("top10_by_compound", f", {CL} " + ranked("(SELECT cluster, cl.id, compound FROM cl JOIN sentiment_scores s ON cl.id = s.id WHERE compound IS NOT NULL)", "cluster", "compound DESC, id", 10, "cluster, id, compound"))
def _(c):
    t = clustered(c).join(c.sentiment.filter("compound is not null").select("id", "compound"), "id")
    return top_per_group(t, ["cluster"], [F.desc("compound"), F.col("id")], 10).select("cluster", "id", "compound")


_ = (clean_journal_name, CLEAN_J, TERMS, exact_groups)
