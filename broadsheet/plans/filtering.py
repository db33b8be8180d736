"""Filters and predicates as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import year_from_id
from ..operators import filters as f
from .base import Corpus, latest, query
from .strings import CLEAN_J, YEAR_ID, rows

FOLD = "translate(lower({}), 'àâäáãåçéèêëíìîïñóòôöõúùûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')"
YEAR = f"coalesce(CAST(year(d) AS INTEGER), {YEAR_ID})"


@query("filter_date_range", "SELECT id, date FROM a WHERE d BETWEEN DATE '1970-01-01' AND DATE '1979-12-31'")
def _(c):
    return f.date_range(rows(c, "date"), "1970-01-01", "1979-12-31")


@query("filter_newspaper", "SELECT id, newspaper FROM a WHERE contains(lower(newspaper), 'gazette')")
def _(c):
    return f.newspaper_contains(rows(c, "newspaper"), "Gazette")


@query("filter_canton", "SELECT id, canton FROM a WHERE canton = 'VD'")
def _(c):
    return f.equals(rows(c, "canton"), "canton", "VD")


@query("filter_topic_tag", "SELECT id FROM a WHERE len(list_filter(topics, lambda t: lower(t) = 'informatique')) > 0")
def _(c):
    return f.topic_tag(rows(c, "topics"), "Informatique").select("id")


@query("filter_word_count", "SELECT id, word_count FROM a WHERE coalesce(word_count, 0) BETWEEN 50 AND 120")
def _(c):
    return f.word_count(rows(c, "word_count"), 50, 120)


@query("filter_cluster", "SELECT id FROM a WHERE id IN (SELECT id_article FROM b WHERE cluster = '3') OR base_id IN (SELECT id_article FROM b WHERE cluster = '3')")
def _(c):
    return f.in_cluster(rows(c, "base_id"), c.biblio.select(F.col("id_article").alias("id"), "cluster"), "3").select("id")


@query("apply_all_filters", "SELECT id FROM a WHERE d BETWEEN DATE '1960-01-01' AND DATE '1989-12-31' AND contains(lower(newspaper), 'le') AND canton = 'VD' AND len(list_filter(topics, lambda t: lower(t) = 'informatique')) > 0 AND coalesce(word_count, 0) >= 30")
def _(c):
    return f.apply_all(rows(c, "date", "newspaper", "canton", "topics", "word_count"), "1960-01-01", "1989-12-31", "le", "VD", "Informatique", 30).select("id")


@query("filter_summary", "SELECT count(*) AS original, count(*) FILTER (WHERE canton = 'VD') AS filtered, round((1 - count(*) FILTER (WHERE canton = 'VD') / count(*)) * 100, 2) AS reduction FROM a")
def _(c):
    n, k = F.count("*"), F.count_if(F.col("canton") == "VD")
    return rows(c, "canton").agg(n.alias("original"), k.alias("filtered"), F.round((1 - k / n) * 100, 2).alias("reduction"))


@query("filter_years", f"SELECT id, {YEAR} AS y FROM a WHERE {YEAR} BETWEEN 1980 AND 1985")
def _(c):
    return f.years(rows(c, "date"), 1980, 1985).select("id", "y")


GROUP_NEWS = "coalesce(CASE WHEN source IS NULL THEN nullif(newspaper, '') END, nullif(source, ''), nullif(split_part(id, '_', 3), ''), 'unknown')"


@query("filter_newspapers", f"SELECT id FROM a WHERE {GROUP_NEWS} IN ('Solidaires', 'Le Relais')")
def _(c):
    return f.newspapers(rows(c, "source", "newspaper"), ["Solidaires", "Le Relais"]).select("id")


@query("filter_journals_base", r"SELECT id FROM a WHERE newspaper IN ('Solidaires', 'Le Relais') OR regexp_replace(newspaper, '\s+\d+\.?$', '') IN ('Solidaires', 'Le Relais')")
def _(c):
    return f.journals_base(rows(c, "newspaper"), ["Solidaires", "Le Relais"]).select("id")


@query("filter_keywords", """SELECT id, 'any' AS mode FROM t WHERE contains(x, 'tunnel') OR contains(x, 'musée') UNION ALL SELECT id, 'all' FROM t WHERE contains(x, 'tunnel') AND contains(x, 'musée') UNION ALL SELECT id, 'none' FROM t WHERE NOT (contains(x, 'tunnel') OR contains(x, 'musée'))""".replace("FROM t", "FROM (SELECT id, lower(coalesce(nullif(content, ''), nullif(cleaned_text, ''))) AS x FROM a)"))
def _(c):
    t = F.lower(f.text_chain("content", "cleaned_text"))
    has = [F.contains(t, F.lit(w)) for w in ("tunnel", "musée")]
    modes = F.array_compact(F.array(F.when(has[0] | has[1], "any"), F.when(has[0] & has[1], "all"), F.when(~(has[0] | has[1]), "none")))
    return rows(c, F.when(t.isNotNull(), modes).alias("m")).select("id", F.explode("m").alias("mode"))


@query("filter_length", r"SELECT id FROM a WHERE coalesce(nullif(word_count, 0), len(list_filter(regexp_split_to_array(trim(content), '\s+'), lambda x: x <> ''))) BETWEEN 60 AND 90")
def _(c):
    return f.length(rows(c, "word_count", "content"), 60, 90).select("id")


@query("filter_year_slider", "SELECT id, date FROM a WHERE TRY_CAST(substring(date, 1, 4) AS INTEGER) BETWEEN 1965 AND 1975")
def _(c):
    return f.year_slider(rows(c, "date"), 1965, 1975)


@query("filter_topics_any", "SELECT id FROM a WHERE list_has_any(topics, ['Sport', 'Culture'])")
def _(c):
    return f.topics_any(rows(c, "topics"), ["Sport", "Culture"]).select("id")


@query("filter_clusters_multi", "SELECT DISTINCT a.id FROM a JOIN b ON a.id = b.id_article WHERE cluster IN ('1', '5', '7')")
def _(c):
    ids = c.biblio.filter(F.col("cluster").isin("1", "5", "7")).select(F.col("id_article").alias("id"))
    return rows(c).join(ids, "id", "left_semi")


CRITERIA = [("year", "1980"), ("journal", "Solidaires"), ("date", "1961-05-23"), ("sentiment", "positive"), ("entity_type", "ORG"), ("topic", "Sport")]


@query("criteria_filter", f"""SELECT 'year' AS kind, id FROM a WHERE {YEAR} = 1980 UNION ALL SELECT 'journal', id FROM a WHERE newspaper = 'Solidaires' UNION ALL SELECT 'date', id FROM a WHERE date = '1961-05-23'
UNION ALL SELECT 'sentiment', a.id FROM a JOIN sentiment_scores s ON a.id = s.id WHERE compound >= 0.05 UNION ALL SELECT DISTINCT 'entity_type', a.id FROM a JOIN m ON a.id = m.id WHERE label = 'ORG' UNION ALL SELECT 'topic', id FROM a WHERE list_contains(topics, 'Sport')""")
def _(c):
    df = rows(c, "date", "newspaper", "topics").join(c.sentiment.select("id", "compound"), "id", "left").join(c.runs.select("id", "entities"), "id", "left")
    return _union([f.criteria(df, k, v).select(F.lit(k).alias("kind"), "id") for k, v in CRITERIA])


def _union(dfs):
    from functools import reduce

    return reduce(lambda a, b: a.unionByName(b), dfs)


@query("term_period_filter", rf"SELECT id FROM a WHERE starts_with(id, 'article_') AND {YEAR_ID} = 1980 AND list_contains(regexp_extract_all(lower(coalesce(nullif(content, ''), nullif(cleaned_text, ''))), '[\p{{L}}\p{{N}}_]+'), 'commission')")
def _(c):
    return f.term_period(rows(c, "content", "cleaned_text"), "commission", 1980).select("id")


@query("mediation_article_filter", f"SELECT id FROM a WHERE contains(lower(content), 'tunnel') AND {YEAR_ID} BETWEEN 1960 AND 1990 AND (contains({FOLD.format(CLEAN_J)}, 'le reveil') OR contains('le reveil', {FOLD.format(CLEAN_J)}))")
def _(c):
    return f.mediation(rows(c, "content", "newspaper", "canton"), "tunnel", 1960, 1990, "Le Réveil").select("id")


@query("flt20", "SELECT id, date FROM a WHERE d >= DATE '1950-01-01'")
def _(c):
    return f.date_range(rows(c, "date"), "1950-01-01")


@query("library_filters", "SELECT id_article FROM b WHERE nom_du_topic IN ('Sport', 'Culture') AND cluster IN ('1', '2', '3') AND regexp_matches(lower(entities), 'sàrl|assurances')")
def _(c):
    return c.biblio.filter(F.col("nom_du_topic").isin("Sport", "Culture") & F.col("cluster").isin("1", "2", "3") & F.lower("entities").rlike("sàrl|assurances")).select("id_article")


@query("mongo_range", "SELECT id, date FROM a WHERE date >= '1960-01-01' AND date <= '1969-12-31'")
def _(c):
    return rows(c, "date").filter(F.col("date").between("1960-01-01", "1969-12-31"))


@query("mongo_topics", "SELECT id, 'in' AS mode FROM a WHERE list_has_any(topics, ['Sport', 'Culture']) UNION ALL SELECT id, 'all' FROM a WHERE list_has_all(topics, ['Sport', 'Culture'])")
def _(c):
    df = rows(c, "topics")
    return f.topics_any(df, ["Sport", "Culture"]).select("id", F.lit("in").alias("mode")).unionByName(f.topics_all(df, ["Sport", "Culture"]).select("id", F.lit("all").alias("mode")))


@query("flt24", "SELECT id FROM a WHERE newspaper = 'Solidaires'")
def _(c):
    return f.equals(rows(c, "newspaper"), "newspaper", "Solidaires").select("id")


@query("flt25", "SELECT id FROM a WHERE canton = 'GE'")
def _(c):
    return f.equals(rows(c, "canton"), "canton", "GE").select("id")


@query("mongo_regex", "SELECT id FROM a WHERE regexp_matches(content, '(?i)ordinateur|machine')")
def _(c):
    return f.regex(rows(c, "content"), "ordinateur|machine").select("id")


@query("mongo_combined", "SELECT id FROM a WHERE date >= '1960-01-01' AND date <= '1989-12-31' AND list_has_any(topics, ['Sport', 'Informatique']) AND canton = 'VD' AND regexp_matches(content, '(?i)ordinateur|machine')")
def _(c):
    df = rows(c, "date", "topics", "canton", "content").filter(F.col("date").between("1960-01-01", "1989-12-31"))
    return f.regex(f.equals(f.topics_any(df, ["Sport", "Informatique"]), "canton", "VD"), "ordinateur|machine").select("id")


@query("point_lookup", "SELECT id, title FROM a WHERE id = (SELECT min(id) FROM a) OR base_id = (SELECT min(id) FROM a) ORDER BY id LIMIT 1")
def _(c):
    least = c.raw("articles").agg(F.min("id").alias("k"))
    return rows(c, "base_id", "title").join(F.broadcast(least), (F.col("id") == F.col("k")) | (F.col("base_id") == F.col("k")), "left_semi").select("id", "title")


@query("fuzzy_lookup", "SELECT id FROM a WHERE contains(id, 'solidaires') ORDER BY id LIMIT 1")
def _(c):
    return f.fuzzy_lookup(rows(c, "base_id"), "solidaires").select("id")


@query("topic_filter", "SELECT id FROM doc_topics WHERE (dominant_topic IN (1, 2) OR topic_distribution[2] >= 0.2 OR topic_distribution[3] >= 0.2) AND NOT (dominant_topic = 5 OR topic_distribution[6] >= 0.2)")
def _(c):
    from ..operators.topics import filter_documents

    return filter_documents(c.topics, include=[1, 2], exclude=[5], threshold=0.2).select("id")


@query("event_keyword_search", "SELECT id FROM a WHERE len(list_filter(topics, lambda k: contains(lower(k), 'port'))) > 0")
def _(c):
    return rows(c, "topics").filter(F.exists("topics", lambda k: F.contains(F.lower(k), F.lit("port")))).select("id")


SIM = """sim AS (SELECT e.label AS period, e.vec_id AS term, f.vec_id AS word, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(f.embedding AS DOUBLE[])), 4) AS similarity FROM embeddings e JOIN embeddings f ON e.label = f.label AND f.vec_id <> e.vec_id WHERE e.vec_id % 50 = 0)"""


def similar(c: Corpus):
    """Cosine similarities of the vectors whose id is divisible by 50, the query set, with all of their label."""
    from ..operators.clusters import cosine

    e = c.raw("embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("term"), F.col("label").alias("period"), F.col("v").alias("q"))
    return e.join(q, (F.col("label") == F.col("period")) & (F.col("vec_id") != F.col("term"))).select("period", "term", F.col("vec_id").alias("word"), F.round(cosine(F.col("q"), F.col("v")), 4).alias("similarity"))


@query("similar_terms_filter", f", {SIM} SELECT * FROM sim WHERE term = 100 AND similarity >= 0.1")
def _(c):
    return similar(c).filter("term = 100 and similarity >= 0.1")


@query("entity_articles", "SELECT DISTINCT a.id, d FROM a JOIN m ON a.id = m.id WHERE text = 'Ormeval' AND label = 'LOC'")
def _(c):
    hit = f.has_entity(c.runs.select("id", "entities"), "Ormeval", "LOC").select("id")
    return latest(c.raw("articles").select("id", "loaded_at", "date"), "id", "loaded_at").join(hit, "id", "left_semi").select("id", _d().alias("d"))


def _d():
    from ..functions.dates import parse_date

    return parse_date(F.col("date"))


@query("flt34", f"SELECT id FROM a WHERE canton = 'GE' AND {CLEAN_J} = 'Solidaires'")
def _(c):
    from ..functions.text import clean_journal_name

    return rows(c, "canton", "newspaper").filter((F.col("canton") == "GE") & (clean_journal_name(F.col("newspaper")) == "Solidaires")).select("id")


@query("flt35", "SELECT id FROM a WHERE canton = 'VS' AND (contains(lower(content), 'tunnel') OR contains(lower(content), 'musée')) ORDER BY id LIMIT 20")
def _(c):
    return f.keywords(f.equals(rows(c, "canton", "content"), "canton", "VS"), ["tunnel", "musée"], text=F.col("content")).select("id").orderBy("id").limit(20)


@query("dominant_topic_articles", "SELECT a.id, d FROM a JOIN doc_topics t ON a.id = t.id WHERE dominant_topic = 2")
def _(c):
    return rows(c, _d().alias("d")).join(c.topics.filter("dominant_topic = 2").select("id"), "id", "left_semi")


@query("timeline_window", f"SELECT y, CAST(sum(coalesce(word_count, 0)) AS BIGINT) AS n FROM (SELECT {YEAR_ID} AS y, word_count FROM a) WHERE y BETWEEN 1950 AND 2010 GROUP BY y")
def _(c):
    return rows(c, "word_count").withColumn("y", year_from_id(F.col("id"))).filter("y between 1950 and 2010").groupBy("y").agg(F.sum(F.coalesce("word_count", F.lit(0))).alias("n"))


@query("tag_any_exact", "SELECT id FROM a WHERE list_has_any(topics, ['informatique', 'internet'])")
def _(c):
    return f.topics_any(rows(c, "topics"), ["informatique", "internet"]).select("id")


@query("click_to_filter", "SELECT id FROM a WHERE newspaper = 'La Gazette d''Ormeval' UNION ALL SELECT id FROM sentiment_scores WHERE compound > 0.05")
def _(c):
    """Articles behind two clicked points: a newspaper's bar and a slice of the sentiment pie."""
    from ..operators import rules
    from ..operators.filters import click_filter

    kind, value, _ = click_filter("sentiment-by-newspaper", {"x": "La Gazette d'Ormeval"})
    mood = click_filter("sentiment-pie", {"label": "Positif"})[1]
    return rows(c, "newspaper").filter(F.col(kind) == value).select("id").unionByName(c.sentiment.filter(F.lower(rules.sentiment_category(F.col("compound"))) == mood).select("id"))
