"""Aggregations and roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import article_year, decade, five_year_range, parse_date
from ..functions.text import clean_journal_name, year_from_id
from ..operators import entities, lexical
from ..operators.filters import grouping_newspaper
from ..operators.rules import sentiment_category
from ..operators.terms import term_counts
from .base import Corpus, latest, query
from .filtering import GROUP_NEWS, SIM, YEAR, similar
from .joining import with_centers
from .strings import CLEAN_J, STOP, YEAR_ID, rows

TERMS = {"machines": ["ordinateur", "puce", "modem", "calculatrice"], "voies": ["tunnel", "pont", "route"], "liens": ["réseau", "téléphone"]}
TERM_ROWS = "(VALUES " + ", ".join(f"('{c}', '{t}')" for c, ts in TERMS.items() for t in ts) + ") terms(category, term)"
WORDS = r"regexp_extract_all(lower(content), '[\p{L}\p{N}_]+')"
TC = f"tc AS (SELECT id, category, x.term, count(*) AS n FROM (SELECT id, unnest({WORDS}) AS term FROM a) x JOIN {TERM_ROWS} ON x.term = terms.term GROUP BY 1, 2, 3)"


def counts(c: Corpus):
    """Term counts of the last loaded row of each article: counted before the rows are compared, so texts aren't shuffled."""
    t = c.raw("articles").select("id", "loaded_at", "content")
    per = term_counts(t, TERMS, F.col("content"), "id", "loaded_at")
    last = t.groupBy("id").agg(F.max("loaded_at").alias("loaded_at"))
    return per.join(last, ["id", "loaded_at"], "left_semi").groupBy("id", "category", "term").agg(F.max("n").alias("n"))


def described(c: Corpus):
    """Year, month, canton and paper of every article."""
    d = parse_date(F.col("date"))
    return rows(c, d.alias("d"), "date", "canton", "newspaper", "source", "word_count").withColumn("y", F.coalesce(F.year("d"), year_from_id(F.col("id"))))


DESC = f"x AS (SELECT id, d, date, canton, newspaper, source, word_count, {YEAR} AS y FROM a)"


@query("term_counts", f", {TC} SELECT id, term, n FROM tc")
def _(c):
    return counts(c).select("id", "term", "n")


@query("terms_by_year", f", {TC} SELECT {YEAR} AS y, category, CAST(sum(n) AS BIGINT) AS n FROM tc JOIN a USING (id) WHERE {YEAR} IS NOT NULL GROUP BY 1, 2")
def terms_by_year(c):
    return counts(c).join(described(c).select("id", "y"), "id").filter("y is not null").groupBy("y", "category").agg(F.sum("n").alias("n"))


@query("terms_by_newspaper", f", {TC} SELECT coalesce(newspaper, source, 'unknown') AS newspaper, category, CAST(sum(n) AS BIGINT) AS n FROM tc JOIN a USING (id) GROUP BY 1, 2")
def _(c):
    return counts(c).join(described(c).select("id", F.coalesce("newspaper", "source", F.lit("unknown")).alias("newspaper")), "id").groupBy("newspaper", "category").agg(F.sum("n").alias("n"))


@query("year_distribution", f"SELECT {YEAR} AS y, count(*) AS n FROM a WHERE {YEAR} IS NOT NULL GROUP BY 1")
def _(c):
    return rows(c, "date").groupBy(article_year(F.col("date"), F.col("id")).alias("y")).agg(F.count("*").alias("n")).filter("y is not null")


@query("newspaper_distribution", f"SELECT {GROUP_NEWS} AS newspaper, count(*) AS n FROM a GROUP BY 1")
def _(c):
    return rows(c, "source", "newspaper").groupBy(grouping_newspaper().alias("newspaper")).agg(F.count("*").alias("n"))


@query("sentiment_summary", "SELECT count(compound) AS n, round(avg(compound), 10) AS mean, round(median(compound), 10) AS median, round(stddev_pop(compound), 10) AS std, min(compound) AS lo, max(compound) AS hi, count(*) FILTER (WHERE compound > 0.05) AS positive, count(*) FILTER (WHERE compound BETWEEN -0.05 AND 0.05) AS neutral, count(*) FILTER (WHERE compound < -0.05) AS negative FROM sentiment_scores")
def _(c):
    k = F.col("compound")
    r = lambda x: F.round(x, 10)
    return c.sentiment.agg(F.count(k).alias("n"), r(F.avg(k)).alias("mean"), r(F.percentile(k, F.lit(0.5))).alias("median"), r(F.stddev_pop(k)).alias("std"), F.min(k).alias("lo"), F.max(k).alias("hi"), F.count_if(k > 0.05).alias("positive"), F.count_if(k.between(-0.05, 0.05)).alias("neutral"), F.count_if(k < -0.05).alias("negative"))


CATEGORY = "CASE WHEN compound IS NULL THEN 'Unknown' WHEN compound > 0.05 THEN 'Positif' WHEN compound < -0.05 THEN 'Négatif' ELSE 'Neutre' END"


@query("sentiment_by_newspaper", f"SELECT {CLEAN_J} AS newspaper, {CATEGORY} AS category, count(*) AS n FROM sentiment_scores s JOIN a ON s.id = a.id GROUP BY 1, 2")
def _(c):
    j = rows(c, clean_journal_name(F.col("newspaper")).alias("newspaper"))
    return c.sentiment.select("id", sentiment_category(F.col("compound")).alias("category")).join(j, "id").groupBy("newspaper", "category").agg(F.count("*").alias("n"))


@query("entity_type_counts", "SELECT id, label, count(*) AS n FROM m GROUP BY 1, 2")
def _(c):
    return c.mentions.groupBy("id", "label").agg(F.count("*").alias("n"))


@query("entity_frequency", "SELECT text, count(*) AS n FROM m WHERE label = 'PER' GROUP BY 1")
def _(c):
    return entities.frequency(c.mentions, "PER")


@query("entity_summary", "SELECT label, count(*) AS n, count(DISTINCT id) AS docs FROM m GROUP BY 1")
def _(c):
    return entities.summary(c.mentions)


@query("entity_cooccurrence", "SELECT least(x.text, y.text) AS a, greatest(x.text, y.text) AS b, count(*) AS n FROM (SELECT DISTINCT id, text, label FROM m) x JOIN (SELECT DISTINCT id, text, label FROM m) y ON x.id = y.id AND (x.text < y.text OR x.text = y.text AND x.label < y.label) GROUP BY 1, 2")
def _(c):
    return entities.cooccurrence(c.mentions)


@query("cooc_window", r"""SELECT least(x.w, y.w) AS a, greatest(x.w, y.w) AS b, count(*) AS n FROM (SELECT id, unnest(t) AS w, unnest(range(1, len(t) + 1)) AS p FROM (SELECT id, list_filter(regexp_extract_all(lower(content), '\p{L}+'), lambda v: v NOT IN ('le', 'la', 'de', 'du', 'l', 'un', 'une', 'pour')) AS t FROM a WHERE content IS NOT NULL)) x
JOIN (SELECT id, unnest(t) AS w, unnest(range(1, len(t) + 1)) AS p FROM (SELECT id, list_filter(regexp_extract_all(lower(content), '\p{L}+'), lambda v: v NOT IN ('le', 'la', 'de', 'du', 'l', 'un', 'une', 'pour')) AS t FROM a WHERE content IS NOT NULL)) y ON x.id = y.id AND y.p - x.p BETWEEN 1 AND 3 AND x.w <> y.w GROUP BY 1, 2 HAVING count(*) >= 2""")
def _(c):
    return lexical.window_cooccurrence(rows(c, "content"), F.col("content"), ["le", "la", "de", "du", "l", "un", "une", "pour"])


@query("cooc_matrix", r"""SELECT x.w AS a, y.w AS b, CAST(sum(x.n * y.n) AS BIGINT) AS n FROM k x JOIN k y ON x.id = y.id AND x.w < y.w GROUP BY 1, 2""".replace("FROM k x JOIN k y", "FROM kept x JOIN kept y"))
def _(c):
    return lexical.cooccurrence_matrix(rows(c, "content"), "id", F.col("content"))


from .base import ORACLE, WITH  # noqa: E402

ORACLE["cooc_matrix"] = WITH + r""", k AS (SELECT id, w, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(lower(content), '\p{L}+')) AS w FROM a) GROUP BY 1, 2), kept AS (SELECT * FROM k WHERE w IN (SELECT w FROM k GROUP BY w HAVING count(*) >= 5))
SELECT x.w AS a, y.w AS b, CAST(sum(x.n * y.n) AS BIGINT) AS n FROM kept x JOIN kept y ON x.id = y.id AND x.w < y.w GROUP BY 1, 2"""

LEX = r"""lw AS (SELECT id, regexp_extract_all(lower(content), '\p{L}+') AS w, greatest(1, len(regexp_extract_all(content, '[.!?]+'))) AS s FROM a WHERE content IS NOT NULL),
lc AS (SELECT id, x, count(*) AS k FROM (SELECT id, unnest(w) AS x FROM lw) GROUP BY 1, 2),
le AS (SELECT id, sum(k) AS n, count(*) AS types, sum(k * length(x)) AS letters, sum(k * log2(k)) AS kl FROM lc GROUP BY 1),
lex AS (SELECT id, CAST(s AS BIGINT) AS num_sentences, CAST(n AS BIGINT) AS num_tokens, CAST(types AS BIGINT) AS num_types, round(types / n, 6) AS ttr, round(log2(n) - kl / n, 4) AS entropy, round(letters / n, 6) AS avg_word_length, round(n / s, 6) AS avg_sent_length FROM le JOIN lw USING (id))"""


def lex(c: Corpus):
    return lexical.statistics(rows(c, "content"), "id", F.col("content"))


@query("lexical_stats", f", {LEX} SELECT * FROM lex")
def _(c):
    return lex(c)


STOPPED = ", ".join(f"'{w}'" for w in STOP)
TOP_STRING = rf"""tw AS (SELECT id, w, count(*) AS n, min(p) AS f FROM (SELECT id, unnest(t) AS w, unnest(range(0, len(t))) AS p FROM (SELECT id, list_filter(regexp_extract_all(lower(content), '\p{{L}}+'), lambda v: v NOT IN ({STOPPED})) AS t FROM a WHERE content IS NOT NULL)) GROUP BY 1, 2),
ts AS (SELECT id, string_agg(w || ':' || n, ',' ORDER BY r) AS top_words FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, f) AS r FROM tw QUALIFY r <= 5) GROUP BY id)"""


@query("lexical_stats_bulk", f", {LEX}, {TOP_STRING} SELECT lex.*, coalesce(top_words, '') AS top_words FROM lex LEFT JOIN ts USING (id)")
def _(c):
    """All but the ratios of parts of speech, which ``lexical.tag_ratios`` takes from a tagger."""
    df = rows(c, "content")
    return lex(c).join(lexical.top_words_string(df, "id", F.col("content"), STOP), "id", "left").withColumn("top_words", F.coalesce("top_words", F.lit("")))


METRICS = ["num_sentences", "num_tokens", "num_types", "ttr", "avg_word_length"]


@query("lexical_global", f", {LEX} " + " UNION ALL ".join(f"SELECT '{m}' AS metric, round(avg({m}), 10) AS mean, CAST(min({m}) AS DOUBLE) AS lo, CAST(max({m}) AS DOUBLE) AS hi FROM lex" for m in METRICS))
def _(c):
    s = lex(c).agg(*(x for m in METRICS for x in (F.round(F.avg(m), 10).alias(f"{m}_a"), F.min(m).cast("double").alias(f"{m}_l"), F.max(m).cast("double").alias(f"{m}_h"))))
    return s.select(F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"{m}_a").alias("mean"), F.col(f"{m}_l").alias("lo"), F.col(f"{m}_h").alias("hi")) for m in METRICS))))


@query("lexical_corr", f", {LEX} SELECT " + ", ".join(f"round(corr({x}, {y}), 4) AS {x}__{y}" for i, x in enumerate(METRICS) for y in METRICS[i + 1 :]) + " FROM lex")
def _(c):
    return lex(c).agg(*(F.round(F.corr(x, y), 4).alias(f"{x}__{y}") for i, x in enumerate(METRICS) for y in METRICS[i + 1 :]))


@query("ttr_histogram", f", {LEX} SELECT floor(ttr * 50) / 50 AS bin, count(*) AS n FROM lex GROUP BY 1")
def _(c):
    return lex(c).groupBy((F.floor(F.col("ttr") * 50) / 50).alias("bin")).agg(F.count("*").alias("n"))


@query("box_stats", f", {LEX} SELECT round(quantile_cont(ttr, 0.25), 6) AS q1, round(quantile_cont(ttr, 0.5), 6) AS q2, round(quantile_cont(ttr, 0.75), 6) AS q3 FROM lex")
def _(c):
    q = lex(c).agg(F.percentile("ttr", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    return q.select(*(F.round(F.col("q")[i], 6).alias(f"q{i + 1}") for i in range(3)))


def by(c: Corpus, *group: str):
    return counts(c).join(described(c), "id").groupBy(*group)


@query("terms_year_sum", f", {TC}, {DESC} SELECT y, CAST(coalesce(sum(n) FILTER (WHERE term = 'tunnel'), 0) AS BIGINT) AS tunnel, CAST(coalesce(sum(n) FILTER (WHERE term = 'pont'), 0) AS BIGINT) AS pont FROM tc JOIN x USING (id) WHERE y IS NOT NULL GROUP BY y")
def _(c):
    return by(c, "y").agg(*(F.coalesce(F.sum(F.when(F.col("term") == t, F.col("n"))), F.lit(0)).alias(t) for t in ("tunnel", "pont"))).filter("y is not null")


@query("terms_journal_sum", f", {TC} SELECT {CLEAN_J} AS journal, term, CAST(sum(n) AS BIGINT) AS n FROM tc JOIN a USING (id) WHERE term IN ('tunnel', 'pont') GROUP BY 1, 2")
def _(c):
    j = described(c).select("id", clean_journal_name(F.col("newspaper")).alias("journal"))
    wide = counts(c).filter(F.col("term").isin("tunnel", "pont")).join(j, "id").groupBy("journal").pivot("term", ["tunnel", "pont"]).agg(F.sum("n"))
    return wide.unpivot(["journal"], ["tunnel", "pont"], "term", "n").filter("n is not null")


@query("term_totals", f", {TC}, {DESC} SELECT CAST(sum(n) AS BIGINT) AS total, count(DISTINCT id) AS articles, count(DISTINCT newspaper) AS journals, min(d) AS first, max(d) AS last FROM tc JOIN x USING (id)")
def _(c):
    return counts(c).join(described(c), "id").agg(F.sum("n").alias("total"), F.count_distinct("id").alias("articles"), F.count_distinct("newspaper").alias("journals"), F.min("d").alias("first"), F.max("d").alias("last"))


@query("terms_month_sum", f", {TC}, {DESC} SELECT strftime(d, '%Y-%m') AS month, CAST(sum(n) AS BIGINT) AS n FROM tc JOIN x USING (id) WHERE d IS NOT NULL GROUP BY 1")
def _(c):
    return by(c, F.date_format("d", "yyyy-MM").alias("month")).agg(F.sum("n").alias("n")).filter("month is not null")


YEARS = list(range(1980, 1985))


@query("calendar_pivot", f", {TC}, {DESC} SELECT CAST(month(d) AS INTEGER) AS month, " + ", ".join(f'CAST(sum(n) FILTER (WHERE y = {y}) AS BIGINT) AS "{y}"' for y in YEARS) + " FROM tc JOIN x USING (id) WHERE d IS NOT NULL GROUP BY 1")
def _(c):
    return by(c, F.month("d").alias("month")).pivot("y", YEARS).agg(F.sum("n")).filter("month is not null")


DRIFTS = ", dr AS (SELECT term, period, round(avg(1 - similarity), 10) AS dist FROM sim GROUP BY 1, 2)"


def drifts(c: Corpus):
    return similar(c).groupBy("term", "period").agg(F.round(F.avg(1 - F.col("similarity")), 10).alias("dist"))


@query("drift_pivot", f", {SIM}{DRIFTS} SELECT term, " + ", ".join(f'max(dist) FILTER (WHERE period = {p}) AS "{p}"' for p in range(10)) + " FROM dr GROUP BY term")
def _(c):
    return drifts(c).groupBy("term").pivot("period", list(range(10))).agg(F.max("dist"))


@query("drift_stats", f", {SIM}{DRIFTS} SELECT count(DISTINCT term) AS terms, round(avg(dist), 10) AS mean, max(dist) AS hi, arg_max(term, dist) AS term, arg_max(period, dist) AS period FROM dr")
def _(c):
    return drifts(c).agg(F.count_distinct("term").alias("terms"), F.round(F.avg("dist"), 10).alias("mean"), F.max("dist").alias("hi"), F.max_by("term", "dist").alias("term"), F.max_by("period", "dist").alias("period"))


@query("drift_avg_term", f", {SIM}{DRIFTS} SELECT term, round(avg(dist), 10) AS mean FROM dr GROUP BY term")
def _(c):
    return drifts(c).groupBy("term").agg(F.round(F.avg("dist"), 10).alias("mean"))


@query("drift_avg_period", f", {SIM}{DRIFTS} SELECT period, round(avg(dist), 10) AS mean FROM dr GROUP BY period")
def _(c):
    return drifts(c).groupBy("period").agg(F.round(F.avg("dist"), 10).alias("mean"))


@query("similar_pivot", f", {SIM} SELECT concat(term, ' (', period, ')') AS key, " + ", ".join(f'max(similarity) FILTER (WHERE k = {k}) AS "r{k}"' for k in range(1, 6)) + " FROM (SELECT *, row_number() OVER (PARTITION BY term, period ORDER BY similarity DESC, word) AS k FROM sim) WHERE k <= 5 GROUP BY 1")
def _(c):
    from ..operators.clusters import top_per_group

    top = top_per_group(similar(c), ["term", "period"], [F.desc("similarity"), F.col("word")], 5)
    wide = top.groupBy(F.concat(F.col("term").cast("string"), F.lit(" ("), F.col("period").cast("string"), F.lit(")")).alias("key")).pivot("rank", [1, 2, 3, 4, 5]).agg(F.max("similarity"))
    return wide.select("key", *(F.col(str(k)).alias(f"r{k}") for k in range(1, 6)))


CL = "cl AS (SELECT DISTINCT id_article AS id, cluster FROM b WHERE cluster IS NOT NULL)"


def clustered(c: Corpus):
    return c.biblio.filter("cluster is not null").select(F.col("id_article").alias("id"), "cluster").distinct()


@query("cluster_profile", f", {CL} SELECT cluster, count(*) AS n, round(avg(word_count), 10) AS words, min(d) AS first, max(d) AS last, round(avg(compound), 10) AS sentiment, CAST(sum(len(entities)) AS BIGINT) AS entities FROM cl JOIN a USING (id) LEFT JOIN sentiment_scores s ON a.id = s.id LEFT JOIN r ON a.id = r.id GROUP BY cluster")
def _(c):
    df = clustered(c).join(described(c).select("id", "d", "word_count"), "id").join(c.sentiment.select("id", "compound"), "id", "left").join(c.runs.select("id", F.size("entities").cast("long").alias("e")), "id", "left")
    return df.groupBy("cluster").agg(F.count("*").alias("n"), F.round(F.avg("word_count"), 10).alias("words"), F.min("d").alias("first"), F.max("d").alias("last"), F.round(F.avg("compound"), 10).alias("sentiment"), F.sum("e").alias("entities"))


@query("cluster_summary", f", {CL} SELECT cluster, count(*) AS n, round(count(*) / sum(count(*)) OVER () * 100, 4) AS share FROM cl GROUP BY cluster")
def _(c):
    n = clustered(c).groupBy("cluster").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("t"))
    return n.join(F.broadcast(total)).select("cluster", "n", F.round(F.col("n") / F.col("t") * 100, 4).alias("share"))


@query("cluster_stats", f", {CL} SELECT cluster, count(*) AS n, round(avg({YEAR_ID}), 10) AS year, arg_max(j, (k, j)) AS journal FROM (SELECT cluster, id, split_part(id, '_', 3) AS j, count(*) OVER (PARTITION BY cluster, split_part(id, '_', 3)) AS k FROM cl) GROUP BY cluster")
def _(c):
    df = clustered(c).select("cluster", "id", F.split("id", "_")[2].alias("j"), year_from_id(F.col("id")).alias("y"))
    per = df.groupBy("cluster", "j").agg(F.count("*").alias("k"), F.sum("y").alias("ys"), F.count("y").alias("yn"))
    return per.groupBy("cluster").agg(F.sum("k").alias("n"), F.round(F.sum("ys") / F.sum("yn"), 10).alias("year"), F.max_by("j", F.struct("k", "j")).alias("journal"))


@query("cluster_topic_mean", f", {CL} SELECT cluster, " + ", ".join(f"round(avg(topic_distribution[{i + 1}]), 10) AS t{i}" for i in range(8)) + " FROM cl JOIN doc_topics USING (id) GROUP BY cluster")
def _(c):
    return clustered(c).join(c.topics, "id").groupBy("cluster").agg(*(F.round(F.avg(F.try_element_at("topic_distribution", F.lit(i + 1))), 10).alias(f"t{i}") for i in range(8)))


@query("cluster_detail", f", {CL} SELECT cluster, round(avg(length(content)), 10) AS mean, CAST(min(length(content)) AS BIGINT) AS lo, CAST(max(length(content)) AS BIGINT) AS hi, round(quantile_cont(length(content), 0.8), 4) AS p80 FROM cl JOIN a USING (id) GROUP BY cluster")
def _(c):
    n = clustered(c).join(rows(c, F.length("content").alias("len")), "id")
    return n.groupBy("cluster").agg(F.round(F.avg("len"), 10).alias("mean"), F.min("len").cast("long").alias("lo"), F.max("len").cast("long").alias("hi"), F.round(F.percentile("len", F.lit(0.8)), 4).alias("p80"))


ARGMAX = "list_position(topic_distribution, list_max(topic_distribution)) - 1"


@query("topic_counts", f"SELECT CAST({ARGMAX} AS BIGINT) AS topic, count(*) AS n, round(count(*) / sum(count(*)) OVER () * 100, 4) AS share FROM doc_topics GROUP BY 1")
def _(c):
    from ..operators.topics import argmax

    n = c.topics.groupBy(argmax(F.col("topic_distribution")).cast("long").alias("topic")).agg(F.count("*").alias("n"))
    return n.join(F.broadcast(n.agg(F.sum("n").alias("t")))).select("topic", "n", F.round(F.col("n") / F.col("t") * 100, 4).alias("share"))


@query("topic_summary", "SELECT dominant_topic AS topic, count(*) AS n FROM doc_topics GROUP BY 1")
def _(c):
    return c.topics.groupBy(F.col("dominant_topic").alias("topic")).agg(F.count("*").alias("n"))


@query("cluster_counts", f", {CL} SELECT cluster, count(*) AS n FROM cl GROUP BY 1")
def _(c):
    return clustered(c).groupBy("cluster").agg(F.count("*").alias("n"))


@query("topic_prevalence", "SELECT k, round(p / sum(p) OVER (), 5) AS share FROM (SELECT k, sum(v) AS p FROM (SELECT unnest(range(0, 8)) AS k, unnest(topic_distribution) AS v FROM doc_topics) GROUP BY k)")
def _(c):
    s = c.topics.agg(*(F.sum(F.try_element_at("topic_distribution", F.lit(i + 1))).alias(f"s{i}") for i in range(8)))
    total = sum((F.col(f"s{i}") for i in range(1, 8)), F.col("s0"))
    return s.select(F.inline(F.array(*(F.struct(F.lit(i).cast("long").alias("k"), F.round(F.col(f"s{i}") / total, 5).alias("share")) for i in range(8)))))


@query("bertopic_prevalence", "SELECT dominant_topic AS topic, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM doc_topics WHERE dominant_topic >= 0 GROUP BY 1")
def _(c):
    n = c.topics.filter("dominant_topic >= 0").groupBy(F.col("dominant_topic").alias("topic")).agg(F.count("*").alias("n"))
    return n.join(F.broadcast(n.agg(F.sum("n").alias("t")))).select("topic", F.round(F.col("n") / F.col("t"), 6).alias("share"))


@query("mediation_year_mean", f", {TC} SELECT {YEAR_ID} AS y, term, round(avg(n), 10) AS mean FROM tc GROUP BY 1, 2")
def _(c):
    return counts(c).groupBy(year_from_id(F.col("id")).alias("y"), "term").agg(F.round(F.avg("n"), 10).alias("mean"))


@query("mediation_canton_sum", f", {TC} SELECT canton, term, CAST(sum(n) AS BIGINT) AS n FROM tc JOIN a USING (id) WHERE canton IS NOT NULL GROUP BY 1, 2")
def _(c):
    return by(c, "canton", "term").agg(F.sum("n").alias("n")).filter("canton is not null")


@query("mediation_journal_sum", f", {TC} SELECT {CLEAN_J} AS journal, term, CAST(sum(n) AS BIGINT) AS n FROM tc JOIN a USING (id) WHERE {CLEAN_J} <> 'inconnu' GROUP BY 1, 2")
def _(c):
    return by(c, clean_journal_name(F.col("newspaper")).alias("journal"), "term").agg(F.sum("n").alias("n")).filter("journal <> 'inconnu'")


@query("timeline_year_sum", f", {TC} SELECT {YEAR_ID} AS y, CAST(sum(n) AS BIGINT) AS n FROM tc GROUP BY 1")
def _(c):
    return counts(c).groupBy(year_from_id(F.col("id")).alias("y")).agg(F.sum("n").alias("n"))


@query("filtered_doc_freq", f"SELECT {YEAR_ID} AS y, nullif(count(*) FILTER (WHERE contains(lower(content), 'tunnel')), 0) AS n FROM a WHERE canton = 'VD' GROUP BY 1")
def _(c):
    df = rows(c, "canton", F.contains(F.lower("content"), F.lit("tunnel")).alias("hit")).filter("canton = 'VD'")
    return df.groupBy(year_from_id(F.col("id")).alias("y")).agg(F.nullif(F.count_if("hit"), F.lit(0)).alias("n"))


@query("trend_insights", f", {TC}, s AS (SELECT term, {YEAR_ID} AS y, CAST(sum(n) AS BIGINT) AS n FROM tc GROUP BY 1, 2) SELECT term, CAST(sum(n) AS BIGINT) AS total, arg_max(y, (n, -y)) AS peak, arg_min(n, y) AS first, arg_max(n, y) AS last, CASE WHEN arg_max(n, y) > arg_min(n, y) THEN 'hausse' WHEN arg_max(n, y) < arg_min(n, y) THEN 'baisse' ELSE 'stable' END AS trend FROM s GROUP BY term")
def _(c):
    s = counts(c).groupBy("term", year_from_id(F.col("id")).alias("y")).agg(F.sum("n").alias("n"))
    t = s.groupBy("term").agg(F.sum("n").alias("total"), F.max_by("y", F.struct(F.col("n"), -F.col("y"))).alias("peak"), F.min_by("n", "y").alias("first"), F.max_by("n", "y").alias("last"))
    return t.withColumn("trend", F.when(F.col("last") > F.col("first"), "hausse").when(F.col("last") < F.col("first"), "baisse").otherwise("stable"))


@query("canton_totals", f", {TC} SELECT canton, CAST(sum(n) AS BIGINT) AS n FROM tc JOIN a USING (id) WHERE canton IS NOT NULL AND term IN ('tunnel', 'pont') GROUP BY 1")
def _(c):
    return counts(c).filter(F.col("term").isin("tunnel", "pont")).join(described(c).select("id", "canton"), "id").filter("canton is not null").groupBy("canton").agg(F.sum("n").alias("n"))


@query("journal_totals", f", {TC} SELECT {CLEAN_J} AS journal, CAST(sum(n) AS BIGINT) AS n FROM tc JOIN a USING (id) WHERE term IN ('tunnel', 'pont') GROUP BY 1")
def _(c):
    return counts(c).filter(F.col("term").isin("tunnel", "pont")).join(described(c).select("id", clean_journal_name(F.col("newspaper")).alias("journal")), "id").groupBy("journal").agg(F.sum("n").alias("n"))


JT = f", {TC}, {DESC}, j AS (SELECT {CLEAN_J} AS journal, CAST(sum(n) AS BIGINT) AS n FROM tc JOIN x USING (id) WHERE y BETWEEN 1960 AND 1990 GROUP BY 1)"


def journal_totals(c: Corpus):
    d = described(c).filter("y between 1960 and 1990").select("id", clean_journal_name(F.col("newspaper")).alias("journal"))
    return counts(c).join(d, "id").groupBy("journal").agg(F.sum("n").alias("n"))


@query("journal_top10", f"{JT} SELECT * FROM j ORDER BY n DESC, journal LIMIT 10")
def _(c):
    return journal_totals(c).orderBy(F.desc("n"), "journal").limit(10)


@query("journal_pie_other", f"{JT} SELECT CASE WHEN k <= 9 THEN journal ELSE 'Autres' END AS journal, CAST(sum(n) AS BIGINT) AS n FROM (SELECT *, row_number() OVER (ORDER BY n DESC, journal) AS k FROM j) GROUP BY 1")
def _(c):
    j = journal_totals(c)
    top = j.orderBy(F.desc("n"), "journal").limit(9).select("journal", F.lit(True).alias("top"))
    return j.join(top, "journal", "left").groupBy(F.when(F.col("top"), F.col("journal")).otherwise("Autres").alias("journal")).agg(F.sum("n").alias("n"))


@query("journal_stacked", f", {TC} SELECT {CLEAN_J} AS journal, " + ", ".join(f"CAST(sum(n) FILTER (WHERE category = '{k}') AS BIGINT) AS {k}" for k in TERMS) + " FROM tc JOIN a USING (id) GROUP BY 1")
def _(c):
    return by(c, clean_journal_name(F.col("newspaper")).alias("journal")).pivot("category", list(TERMS)).agg(F.sum("n"))


def canton_scores(c: Corpus):
    return c.sentiment.join(rows(c, "canton"), "id").withColumn("y", year_from_id(F.col("id"))).filter("canton is not null")


SC = f"cs AS (SELECT s.*, canton, {YEAR_ID.replace('(id', '(s.id')} AS y FROM sentiment_scores s JOIN a ON s.id = a.id WHERE canton IS NOT NULL)"
FOUR = ("negative", "neutral", "positive", "compound")
RANGE = "CASE WHEN y BETWEEN 1960 AND 2000 THEN concat(CASE WHEN y = 2000 THEN 1995 ELSE CAST(floor((y - 1960) / 5) * 5 + 1960 AS INTEGER) END, '-', CASE WHEN y = 2000 THEN 2000 ELSE CAST(floor((y - 1960) / 5) * 5 + 1965 AS INTEGER) END) END"


@query("canton_sentiment", f", {SC} SELECT canton, count(*) AS n, " + ", ".join(f"round(avg(coalesce({k}, 0)), 10) AS {k}" for k in FOUR) + " FROM cs GROUP BY canton")
def _(c):
    return canton_scores(c).groupBy("canton").agg(F.count("*").alias("n"), *(F.round(F.avg(F.coalesce(k, F.lit(0.0))), 10).alias(k) for k in FOUR))


@query("canton_period_sentiment", f", {SC} SELECT canton, {RANGE} AS period, count(*) AS n, round(avg(coalesce(compound, 0)), 10) AS compound FROM cs WHERE {RANGE} IS NOT NULL GROUP BY 1, 2")
def _(c):
    return canton_scores(c).groupBy("canton", five_year_range(F.col("y")).alias("period")).agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("compound", F.lit(0.0))), 10).alias("compound")).filter("period is not null")


@query("canton_display", f", {SC} SELECT canton, round(avg(coalesce(positive, 0)), 10) AS value FROM cs WHERE {RANGE} = '1980-1985' GROUP BY 1")
def _(c):
    return canton_scores(c).filter(five_year_range(F.col("y")) == "1980-1985").groupBy("canton").agg(F.round(F.avg(F.coalesce("positive", F.lit(0.0))), 10).alias("value"))


@query("entity_trend", f"SELECT {YEAR_ID} AS y, count(DISTINCT id) AS n FROM m WHERE text = 'Ormeval' GROUP BY 1")
def _(c):
    return c.mentions.filter("text = 'Ormeval'").groupBy(year_from_id(F.col("id")).alias("y")).agg(F.count_distinct("id").alias("n"))


@query("entity_year_range", f"SELECT label, min({YEAR_ID}) AS first, max({YEAR_ID}) AS last FROM m GROUP BY label")
def _(c):
    y = year_from_id(F.col("id"))
    return c.mentions.groupBy("label").agg(F.min(y).alias("first"), F.max(y).alias("last"))


@query("topic_affinity", ", ctr AS (SELECT label, k, avg(x) AS v FROM (SELECT label, unnest(range(0, 8)) AS k, unnest(CAST(embedding AS DOUBLE[])[1:8]) AS x FROM embeddings) GROUP BY 1, 2) SELECT x.k AS i, y.k AS j, round(sum(x.v * y.v), 4) AS w FROM ctr x JOIN ctr y ON x.label = y.label AND x.k <= y.k GROUP BY 1, 2")
def _(c):
    from ..operators.clusters import centroids

    ctr = centroids(c.raw("embeddings"), "label", "embedding", 8).select("label", F.posexplode("center").alias("k", "v"))
    x, y = ctr.select("label", F.col("k").alias("i"), F.col("v").alias("vi")), ctr.select("label", F.col("k").alias("j"), F.col("v").alias("vj"))
    return x.join(y, "label").filter("i <= j").groupBy(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")).agg(F.round(F.sum(F.col("vi") * F.col("vj")), 4).alias("w"))


@query("similar_word_mean", f", {SIM} SELECT word, round(avg(similarity), 10) AS mean FROM sim GROUP BY word")
def _(c):
    return similar(c).groupBy("word").agg(F.round(F.avg("similarity"), 10).alias("mean"))


@query("corpus_meta", "SELECT count(*) AS n, min(d) AS first, max(d) AS last, count(DISTINCT newspaper) AS journals FROM a")
def _(c):
    return described(c).agg(F.count("*").alias("n"), F.min("d").alias("first"), F.max("d").alias("last"), F.count_distinct("newspaper").alias("journals"))


@query("token_stats", f"SELECT CAST(min(n) AS BIGINT) AS lo, CAST(max(n) AS BIGINT) AS hi, round(avg(n), 10) AS mean, count(*) FILTER (WHERE n = 0) AS empty FROM (SELECT len(coalesce({WORDS}, [])) AS n FROM a)")
def _(c):
    from ..functions.text import tokens

    n = rows(c, F.size(tokens(F.col("content"))).cast("long").alias("n"))
    return n.agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.round(F.avg("n"), 10).alias("mean"), F.count_if(F.col("n") == 0).alias("empty"))


@query("ad_stats", "SELECT count(*) AS n, count(*) FILTER (WHERE regexp_matches(lower(title), 'annonce|publicité|à vendre|à louer|promotion|soldes|ad | ad')) AS ads, round(count(*) FILTER (WHERE regexp_matches(lower(title), 'annonce|publicité|à vendre|à louer|promotion|soldes|ad | ad')) / count(*) * 100, 4) AS share FROM a")
def _(c):
    from ..operators.rules import is_ad

    ads = F.count_if(is_ad(F.col("title")))
    return rows(c, "title").agg(F.count("*").alias("n"), ads.alias("ads"), F.round(ads / F.count("*") * 100, 4).alias("share"))


@query("mongo_count", "SELECT count(*) AS n FROM a WHERE canton = 'VD'")
def _(c):
    return rows(c, "canton").filter("canton = 'VD'").agg(F.count("*").alias("n"))


@query("mongo_distinct", "SELECT DISTINCT unnest(topics) AS value FROM a")
def _(c):
    return rows(c, "topics").select(F.explode("topics").alias("value")).distinct()


@query("distinct_topics", "SELECT DISTINCT unnest(topics) AS topic FROM a ORDER BY topic")
def _(c):
    return rows(c, "topics").select(F.explode("topics").alias("topic")).distinct().orderBy("topic")


@query("distinct_journals_grouped", r"SELECT DISTINCT CASE WHEN v >= 2 THEN base ELSE newspaper END AS journal FROM (SELECT newspaper, base, count(DISTINCT newspaper) OVER (PARTITION BY base) AS v FROM (SELECT newspaper, regexp_replace(newspaper, '\s+\d+\.?$', '') AS base FROM a WHERE newspaper IS NOT NULL))".replace("count(DISTINCT newspaper) OVER (PARTITION BY base)", "len(list_distinct(list(newspaper) OVER (PARTITION BY base)))"))
def _(c):
    from ..functions.text import journal_base_name

    n = rows(c, "newspaper").filter("newspaper is not null").select("newspaper", journal_base_name(F.col("newspaper")).alias("base")).distinct()
    v = n.groupBy("base").agg(F.count("*").alias("v"))
    return n.join(v, "base").select(F.when(F.col("v") >= 2, F.col("base")).otherwise(F.col("newspaper")).alias("journal")).distinct()


@query("years_present", f"SELECT {YEAR} AS y FROM a WHERE {YEAR} BETWEEN 1800 AND 2100 ORDER BY y")
def _(c):
    return described(c).select("y").filter("y between 1800 and 2100").orderBy("y")


@query("cluster_options", f", {CL} SELECT CAST(k AS VARCHAR) AS cluster, count(cl.id) AS n FROM (SELECT unnest(range(0, 15)) AS k) LEFT JOIN cl ON cl.cluster = CAST(k AS VARCHAR) GROUP BY 1")
def _(c):
    k = c.spark.range(15).select(F.col("id").cast("string").alias("cluster"))
    return F.broadcast(k).join(clustered(c).groupBy("cluster").agg(F.count("*").alias("n")), "cluster", "left").select("cluster", F.coalesce("n", F.lit(0)).alias("n"))


@query("collection_counts", "SELECT nom_du_topic AS collection, count(*) AS n FROM b WHERE nom_du_topic IS NOT NULL GROUP BY 1")
def _(c):
    return c.biblio.filter("nom_du_topic is not null").groupBy(F.col("nom_du_topic").alias("collection")).agg(F.count("*").alias("n"))


@query("histograms", "SELECT CAST(least(19, floor((compound + 1) / 0.1)) AS BIGINT) AS bin, count(*) AS n FROM sentiment_scores WHERE compound IS NOT NULL GROUP BY 1")
def _(c):
    return c.sentiment.filter("compound is not null").groupBy(F.least(F.lit(19), F.floor((F.col("compound") + 1) / 0.1)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query("zero_filled_series", f", {TC} SELECT CAST(ys.y AS INTEGER) AS y, t.term, CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM (SELECT unnest(range(1980, 1990)) AS y) ys CROSS JOIN (VALUES ('tunnel'), ('pont')) t(term) LEFT JOIN (SELECT *, {YEAR_ID} AS y FROM tc) q ON q.y = ys.y AND q.term = t.term GROUP BY 1, 2")
def _(c):
    grid = c.spark.range(1980, 1990).select(F.col("id").cast("int").alias("y"), F.explode(F.array(F.lit("tunnel"), F.lit("pont"))).alias("term"))
    s = counts(c).groupBy(year_from_id(F.col("id")).alias("y"), "term").agg(F.sum("n").alias("n"))
    return F.broadcast(grid).join(s, ["y", "term"], "left").select("y", "term", F.coalesce("n", F.lit(0)).alias("n"))


@query("score_mean", "SELECT round(avg(compound), 10) AS mean FROM sentiment_scores")
def _(c):
    return c.sentiment.agg(F.round(F.avg("compound"), 10).alias("mean"))


@query("distinct_options", "SELECT 'canton' AS facet, canton AS value FROM a WHERE canton IS NOT NULL UNION SELECT 'source', source FROM a WHERE source IS NOT NULL")
def _(c):
    df = rows(c, "canton", "source")
    return df.select(F.inline(F.array(F.struct(F.lit("canton").alias("facet"), F.col("canton").alias("value")), F.struct(F.lit("source").alias("facet"), F.col("source").alias("value"))))).filter("value is not null").distinct()


@query("avg_entities_per_doc", "SELECT round(sum(len(entities)) / count(*), 6) AS mean FROM r")
def _(c):
    return c.runs.agg(F.round(F.try_divide(F.sum(F.size("entities")), F.count("*")), 6).alias("mean"))


@query("periodize", f"SELECT concat(CAST(floor(y / 10) * 10 AS INTEGER), 's') AS period, count(*) AS n FROM (SELECT {YEAR} AS y FROM a) WHERE y IS NOT NULL GROUP BY 1 HAVING count(*) >= 50")
def _(c):
    return described(c).filter("y is not null").groupBy(decade(F.col("y")).alias("period")).agg(F.count("*").alias("n")).filter("n >= 50")


@query("mark_special", r"""SELECT id, CAST(p AS BIGINT) AS p, w, regexp_full_match(w, '[A-Z]{2,}') AS acronym, lower(w) IN ('ordinateur', 'puce', 'modem', 'serveur') AS technical FROM (SELECT id, unnest(t) AS w, unnest(range(0, len(t))) AS p FROM (SELECT id, regexp_extract_all(content, '\p{L}+') AS t FROM a WHERE content IS NOT NULL)) WHERE regexp_full_match(w, '[A-Z]{2,}') OR lower(w) IN ('ordinateur', 'puce', 'modem', 'serveur')""")
def _(c):
    t = rows(c, "content").filter("content is not null").select("id", F.posexplode(F.regexp_extract_all("content", F.lit(r"\p{L}+"), F.lit(0))).alias("p", "w"))
    flagged = t.select("id", F.col("p").cast("long").alias("p"), "w", F.col("w").rlike("^[A-Z]{2,}$").alias("acronym"), F.lower("w").isin("ordinateur", "puce", "modem", "serveur").alias("technical"))
    return flagged.filter("acronym or technical")


@query("mark_special_fast", r"""SELECT id, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(content, '\p{L}+')) AS w FROM a) WHERE length(w) > 1 AND regexp_full_match(w, '[A-Z]{2,}') GROUP BY id""")
def _(c):
    t = rows(c, F.size(F.filter(F.regexp_extract_all("content", F.lit(r"\p{L}+"), F.lit(0)), lambda w: w.rlike("^[A-Z]{2,}$"))).cast("long").alias("n"))
    return t.filter("n > 0")


@query("extract_entities", rf""", sp AS (SELECT id, unnest(f) AS text, unnest(range(1, len(f) + 1)) AS k, g FROM (SELECT id, regexp_extract_all(content, '{entities.NAME}') AS f, regexp_split_to_array(content, '{entities.NAME}') AS g FROM a WHERE content IS NOT NULL)),
pl AS (SELECT id, text, CAST(sum(length(g[k]) + length(text)) OVER (PARTITION BY id ORDER BY k) AS BIGINT) AS stop FROM sp),
gz AS (SELECT text, label FROM (SELECT text, label, count(*) AS n FROM m GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY text ORDER BY n DESC, label) = 1)
SELECT id, text, coalesce(label, 'MISC') AS label, stop - length(text) AS start, stop AS end_ FROM pl LEFT JOIN gz USING (text)""")
def _(c):
    """Names by their capitals, with offsets; labels by the names known so far, MISC for new ones."""
    found = entities.spans(rows(c, "content"), "id", F.col("content"))
    return entities.labelled(found, entities.gazetteer(c.mentions)).select("id", "text", "label", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end_"))


@query("late_articles", "SELECT source, count(*) AS n, count(*) FILTER (WHERE loaded_at > (SELECT min(loaded_at) + INTERVAL 30 DAY FROM articles)) AS late FROM a GROUP BY source")
def _(c):
    df = latest(c.raw("articles").select("id", "loaded_at", "source"), "id", "loaded_at")
    first = c.raw("articles").agg((F.min("loaded_at") + F.expr("interval 30 day")).alias("limit"))
    return df.join(F.broadcast(first)).groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("loaded_at") > F.col("limit")).alias("late"))


_ = with_centers
