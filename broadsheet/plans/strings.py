"""String functions, projections and scalar rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import rules
from .base import Corpus, latest, query

STOP = ["les", "des", "est", "une", "dans", "pour", "que", "qui", "sur", "par", "the", "and", "und", "der", "die", "das"]
IN_STOP = ", ".join(f"'{w}'" for w in STOP)


def rows(c: Corpus, *cols):
    """The last loaded row of every article, with only these columns shuffled."""
    return latest(c.raw("articles").select("id", "loaded_at", *cols), "id", "loaded_at").drop("loaded_at")


@query("normalize_unicode")
def _(c):
    return rows(c, "title").select("id", text.nfkd("title").alias("title_nfkd"))


@query("strip_special", r"""SELECT id, regexp_replace(title, '[^a-zA-Z0-9\s.,!?;:\-''"]', ' ', 'g') AS t FROM a""")
def _(c):
    return rows(c, "title").select("id", text.strip_special(F.col("title")).alias("t"))


@query("fix_ocr", r"""SELECT id, replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, '(^|[^\p{L}\p{N}_])0($|[^\p{L}\p{N}_])', '\1O\2', 'g'), '(^|[^\p{L}\p{N}_])0($|[^\p{L}\p{N}_])', '\1O\2', 'g'), '(^|[^\p{L}\p{N}_])1($|[^\p{L}\p{N}_])', '\1I\2', 'g'), '(^|[^\p{L}\p{N}_])1($|[^\p{L}\p{N}_])', '\1I\2', 'g'), 'vv', 'w'), 'rn', 'm') AS t FROM a""")
def _(c):
    return rows(c, text.fix_ocr(F.col("content")).alias("t"))


@query("tokenize", r"""SELECT id, CAST(len(coalesce(regexp_extract_all(lower(content), '[\p{L}\p{N}_]+'), [])) AS BIGINT) AS n, coalesce(array_to_string(regexp_extract_all(lower(content), '[\p{L}\p{N}_]+'), ' '), '') AS t FROM a""")
def _(c):
    t = text.tokens(F.col("content"))
    return rows(c, F.size(t).cast("long").alias("n"), F.array_join(t, " ").alias("t"))


@query("filter_tokens", rf"""SELECT id, array_to_string(list_filter(coalesce(regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}_]+'), []), lambda x: length(x) >= 3 AND x NOT IN ({IN_STOP})), ' ') AS t FROM a""")
def _(c):
    return rows(c, F.array_join(text.filter_tokens(text.tokens(F.col("content")), STOP), " ").alias("t"))


@query("clean_text", rf"""SELECT id, array_to_string(list_filter(coalesce(regexp_extract_all(lower(regexp_replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, '(^|[^\p{{L}}\p{{N}}_])0($|[^\p{{L}}\p{{N}}_])', '\1O\2', 'g'), '(^|[^\p{{L}}\p{{N}}_])0($|[^\p{{L}}\p{{N}}_])', '\1O\2', 'g'), '(^|[^\p{{L}}\p{{N}}_])1($|[^\p{{L}}\p{{N}}_])', '\1I\2', 'g'), '(^|[^\p{{L}}\p{{N}}_])1($|[^\p{{L}}\p{{N}}_])', '\1I\2', 'g'), 'vv', 'w'), 'rn', 'm'), '[^a-zA-Z0-9\s.,!?;:\-''"]', ' ', 'g')), '[a-z0-9]+'), []), lambda x: length(x) >= 3 AND x NOT IN ({IN_STOP})), ' ') AS t FROM a""")
def _(c):
    return rows(c, text.clean_text(F.col("content"), STOP).alias("t"))


@query("str07", "SELECT id, content IS NOT NULL AS has_text, CAST(coalesce(length(content), 0) AS BIGINT) AS n FROM a")
def _(c):
    return rows(c, F.col("content").isNotNull().alias("has_text"), F.coalesce(F.length("content"), F.lit(0)).cast("long").alias("n"))


NORM = r"coalesce(trim(regexp_replace(lower(content), '[ \t\r\n]+', ' ', 'g')), '')"


@query("normalize_ws", f"SELECT id, {NORM} AS t FROM a")
def _(c):
    return rows(c, text.normalize_ws(F.col("content")).alias("t"))


@query("content_hash", f"SELECT id, CASE WHEN {NORM} = '' THEN '' ELSE md5(substring({NORM}, 1, 1000)) END AS h FROM a")
def _(c):
    return rows(c, text.content_hash(F.col("content")).alias("h"))


@query("seq_ratio")
def _(c):
    df = rows(c, "content", "original_content").filter("content is not null and original_content is not null")
    return df.select("id", text.seq_ratio(text.normalize_ws(F.col("content")), text.normalize_ws(F.col("original_content"))).alias("ratio"))


@query("is_redundant", r"""SELECT x, y, contains(x, y) OR contains(y, x) OR contains(replace(replace(x, ' ', ''), '-', ''), replace(replace(y, ' ', ''), '-', '')) OR contains(replace(replace(y, ' ', ''), '-', ''), replace(replace(x, ' ', ''), '-', ''))
 OR len(list_filter(range(1, least(length(x), length(y)) + 1), lambda i: substring(x, i, 1) = substring(y, i, 1))) / greatest(length(x), length(y)) > 0.7 AS redundant
FROM (SELECT DISTINCT lower(journal_base) AS x FROM b WHERE journal_base <> '') JOIN (SELECT DISTINCT lower(nom_du_topic) AS y FROM b WHERE nom_du_topic <> '') ON substring(x, 1, 1) = substring(y, 1, 1)""")
def _(c):
    x = c.raw("biblio_enriched").filter("journal_base <> ''").select(F.lower("journal_base").alias("x")).distinct()
    y = c.raw("biblio_enriched").filter("nom_du_topic <> ''").select(F.lower("nom_du_topic").alias("y")).distinct()
    return x.join(y, F.substring("x", 1, 1) == F.substring("y", 1, 1)).select("x", "y", text.is_redundant(F.col("x"), F.col("y")).alias("redundant"))


@query("w2v_tokens", r"""SELECT id, array_to_string(coalesce(regexp_extract_all(lower(content), '[\p{L}\p{N}_]+'), []), ' ') AS t FROM a""")
def _(c):
    return rows(c, F.array_join(text.tokens(F.col("content")), " ").alias("t"))


@query("excerpt", r"""SELECT id, CASE WHEN p > 0 THEN regexp_replace(concat(CASE WHEN s > 1 THEN '...' ELSE '' END, substring(content, s, e - s), CASE WHEN e <= length(content) THEN '...' ELSE '' END), '(?i)(commission)', '**\1**', 'g')
 ELSE concat(substring(content, 1, 300), CASE WHEN length(content) > 300 THEN '...' ELSE '' END) END AS t
FROM (SELECT id, content, p, greatest(1, p - 100) AS s, least(length(content) + 1, p + 110) AS e FROM (SELECT id, content, strpos(lower(content), 'commission') AS p FROM a WHERE content IS NOT NULL))""")
def _(c):
    return rows(c, "content").filter("content is not null").select("id", text.excerpt(F.col("content"), "commission").alias("t"))


@query("str13b", r"""SELECT id, concat(substring(content, 1, 200), CASE WHEN length(content) > 200 THEN '...' ELSE '' END) AS t FROM a WHERE content IS NOT NULL AND strpos(lower(content), 'zzzz') = 0""")
def _(c):
    return rows(c, "content").filter("content is not null").select("id", text.excerpt(F.col("content"), "zzzz", fallback=200).alias("t"))


@query("str13c", r"""SELECT id, CASE WHEN p > 0 THEN substring(content, greatest(1, p - 100), p + 200 - greatest(1, p - 100)) ELSE substring(content, 1, 300) END AS t
FROM (SELECT id, content, strpos(translate(lower(content), 'àâäáãåçéèêëíìîïñóòôöõúùûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), 'reseau') AS p FROM a WHERE content IS NOT NULL)""")
def _(c):
    at = F.locate("reseau", text.accent_fold(F.col("content")))
    start = F.greatest(F.lit(1), at - 100)
    return rows(c, "content").filter("content is not null").select("id", F.when(at > 0, F.substr(F.col("content"), start, at + 200 - start)).otherwise(F.substring("content", 1, 300)).alias("t"))


@query("highlight", r"""SELECT id, regexp_replace(title, '(^|[^\p{L}\p{N}_])(tunnel)($|[^\p{L}\p{N}_])', '\1<mark>\2</mark>\3', 'gi') AS t FROM a""")
def _(c):
    return rows(c, text.highlight(F.col("title"), ["tunnel"]).alias("t"))


@query("year_from_date", r"""SELECT id, CASE WHEN contains(date, '-') THEN TRY_CAST(split_part(date, '-', 1) AS INTEGER) WHEN contains(date, '/') THEN CASE WHEN length(split_part(date, '/', -1)) = 4 THEN TRY_CAST(split_part(date, '/', -1) AS INTEGER) ELSE TRY_CAST(split_part(date, '/', 1) AS INTEGER) END END AS y FROM a""")
def _(c):
    return rows(c, dates.year_from_date(F.col("date")).alias("y"))


YEAR_ID = r"TRY_CAST(coalesce(nullif(regexp_extract(id, '(\d{4})-\d{2}-\d{2}', 1), ''), nullif(regexp_extract(id, '_(\d{4})_', 1), '')) AS INTEGER)"


@query("year_from_id", f"SELECT id, {YEAR_ID} AS y FROM a")
def _(c):
    return rows(c).select("id", text.year_from_id(F.col("id")).alias("y"))


@query("journal_from_id", "SELECT id, nullif(split_part(id, '_', 3), '') AS j FROM a")
def _(c):
    return rows(c).select("id", text.journal_from_id(F.col("id")).alias("j"))


@query("id_metadata", f"SELECT id, CASE WHEN starts_with(id, 'article_') THEN split_part(id, '_', 2) ELSE 'Date inconnue' END AS date_part, CASE WHEN starts_with(id, 'article_') THEN split_part(id, '_', 3) ELSE 'Journal inconnu' END AS journal_part, coalesce(CAST({YEAR_ID} AS VARCHAR), 'Année inconnue') AS year_part FROM a")
def _(c):
    ok = F.col("id").startswith("article_")
    return rows(c).select("id", F.when(ok, text.id_part(F.col("id"), 2)).otherwise("Date inconnue").alias("date_part"), F.when(ok, text.id_part(F.col("id"), 3)).otherwise("Journal inconnu").alias("journal_part"), F.coalesce(text.year_from_id(F.col("id")).cast("string"), F.lit("Année inconnue")).alias("year_part"))


@query("str18b", f"SELECT id, coalesce(CAST({YEAR_ID} AS VARCHAR), 'Inconnu') AS y, coalesce(nullif(split_part(id, '_', 3), ''), 'Inconnu') AS j FROM a")
def _(c):
    return rows(c).select("id", F.coalesce(text.year_from_id(F.col("id")).cast("string"), F.lit("Inconnu")).alias("y"), F.coalesce(text.journal_from_id(F.col("id")), F.lit("Inconnu")).alias("j"))


@query("normalize_article_id", "SELECT id, split_part(regexp_replace(id, '^article_', ''), '_mistral', 1) AS n FROM a")
def _(c):
    return rows(c).select("id", text.normalize_article_id(F.col("id")).alias("n"))


@query("journal_base_name", r"SELECT id, regexp_replace(newspaper, '\s+\d+\.?$', '') AS j FROM a")
def _(c):
    return rows(c, text.journal_base_name(F.col("newspaper")).alias("j"))


@query("str20b", r"SELECT id, CASE WHEN regexp_matches(j, '(?i)^la gazette') THEN 'La Gazette' WHEN regexp_matches(j, '(?i)^le courrier') THEN 'Le Courrier' ELSE j END AS j FROM (SELECT id, regexp_replace(newspaper, '\s*\d+\s*$', '') AS j FROM a)")
def _(c):
    j = F.regexp_replace("newspaper", r"\s*\d+\s*$", "")
    return rows(c, F.when(j.rlike("(?i)^la gazette"), "La Gazette").when(j.rlike("(?i)^le courrier"), "Le Courrier").otherwise(j).alias("j"))


CLEAN_J = r"coalesce(nullif(trim(regexp_replace(regexp_replace(newspaper, '\s+\d+\.?\s*$', ''), '\.+$', '')), ''), 'inconnu')"


@query("str20c", f"SELECT id, {CLEAN_J} AS j FROM a")
def _(c):
    return rows(c, text.clean_journal_name(F.col("newspaper")).alias("j"))


@query("accent_fold", "SELECT id, translate(lower(title), 'àâäáãåçéèêëíìîïñóòôöõúùûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy') AS t FROM a")
def _(c):
    return rows(c, text.accent_fold(F.col("title")).alias("t"))


@query("str22", "SELECT id, CASE WHEN length(title) > 50 THEN concat(substring(title, 1, 50), '...') ELSE title END AS t50, CASE WHEN length(title) > 40 THEN concat(substring(title, 1, 40), '...') ELSE title END AS t40 FROM a")
def _(c):
    return rows(c, text.truncate(F.col("title"), 50).alias("t50"), text.truncate(F.col("title"), 40).alias("t40"))


@query("str23", "SELECT id, concat(CAST(round(CAST(list_max(topic_distribution) * 100 AS DECIMAL(20, 6)), 2) AS VARCHAR), '%') AS p FROM doc_topics")
def _(c):
    return c.topics.select("id", text.percent(F.array_max("topic_distribution")).alias("p"))


@query("top_words_parse", """SELECT w, CAST(sum(TRY_CAST(n AS BIGINT)) AS BIGINT) AS n FROM (SELECT split_part(p, ':', 1) AS w, split_part(p, ':', 2) AS n FROM (SELECT unnest(regexp_extract_all(lower(label) || ':' || CAST(s AS VARCHAR), '[^:,]+:[0-9]+')) AS p FROM m)) GROUP BY w""")
def _(c):
    line = F.concat(F.lower("label"), F.lit(":"), F.col("start").cast("string"))
    p = c.mentions.select(F.explode(F.regexp_extract_all(line, F.lit("[^:,]+:[0-9]+"), F.lit(0))).alias("p"))
    return p.select(F.split("p", ":")[0].alias("w"), F.split("p", ":")[1].cast("long").alias("n")).groupBy("w").agg(F.sum("n").alias("n"))


@query("str25", "SELECT lang, count(DISTINCT lower(word)) AS n FROM common_words GROUP BY lang")
def _(c):
    return c.raw("common_words").groupBy("lang").agg(F.count_distinct(F.lower("word")).alias("n"))


# Projections


@query("topic_input", "SELECT coalesce(id, base_id) AS doc_id, content AS text, date, newspaper, title FROM a WHERE content IS NOT NULL")
def _(c):
    return rows(c, "base_id", "content", "date", "newspaper", "title").filter("content is not null").select(F.coalesce("id", "base_id").alias("doc_id"), F.col("content").alias("text"), "date", "newspaper", "title")


@query("id_to_string", "SELECT CAST(doc_id AS VARCHAR) AS id, lang FROM documents")
def _(c):
    return c.raw("documents").select(F.col("doc_id").cast("string").alias("id"), "lang")


@query("cluster_article_digest", "SELECT a.id, coalesce(title, 'Sans titre') AS title, coalesce(date, 'Inconnue') AS date, coalesce(newspaper, 'Inconnu') AS newspaper, coalesce(compound, 0) AS sentiment FROM a LEFT JOIN sentiment_scores s ON a.id = s.id")
def _(c):
    df = rows(c, "title", "date", "newspaper").join(c.sentiment.select("id", "compound"), "id", "left")
    return df.select("id", F.coalesce("title", F.lit("Sans titre")).alias("title"), F.coalesce("date", F.lit("Inconnue")).alias("date"), F.coalesce("newspaper", F.lit("Inconnu")).alias("newspaper"), F.coalesce("compound", F.lit(0.0)).alias("sentiment"))


@query("topic_article_digest", "SELECT a.id, concat(substring(content, 1, 500), '...') AS excerpt, title, date, list_max(topic_distribution) AS topic_value FROM a JOIN doc_topics t ON a.id = t.id WHERE content IS NOT NULL")
def _(c):
    return rows(c, F.concat(F.substring("content", 1, 500), F.lit("...")).alias("excerpt"), "title", "date").filter("excerpt is not null").join(c.topics.select("id", F.array_max("topic_distribution").alias("topic_value")), "id")


@query("key_sniff_rename", "SELECT k, CASE WHEN length(k) > 20 THEN 'Article ID' WHEN regexp_full_match(k, '[0-9]+') THEN 'Année' ELSE 'Journal' END AS kind FROM (SELECT DISTINCT id AS k FROM a UNION SELECT DISTINCT CAST(year AS VARCHAR) FROM a WHERE year IS NOT NULL UNION SELECT DISTINCT source FROM a WHERE source IS NOT NULL)")
def _(c):
    df = rows(c, "year", "source")
    k = df.select(F.col("id").alias("k")).union(df.filter("year is not null").select(F.col("year").cast("string"))).union(df.filter("source is not null").select("source")).distinct()
    return k.select("k", F.when(F.length("k") > 20, "Article ID").when(F.col("k").rlike("^[0-9]+$"), "Année").otherwise("Journal").alias("kind"))


@query("cluster_row_from_id", "SELECT id_article AS article_id, coalesce(nullif(split_part(id_article, '_', 2), ''), 'N/A') AS date, coalesce(nullif(split_part(id_article, '_', 3), ''), 'N/A') AS journal FROM b")
def _(c):
    k = F.col("id_article")
    return c.biblio.select(k.alias("article_id"), F.coalesce(text.id_part(k, 2), F.lit("N/A")).alias("date"), F.coalesce(text.id_part(k, 3), F.lit("N/A")).alias("journal"))


@query("preview_text", "SELECT id, CASE WHEN length(content) > 200 THEN concat(substring(content, 1, 200), '...') ELSE content END AS t FROM a")
def _(c):
    return rows(c, text.truncate(F.col("content"), 200).alias("t"))


@query("wide_matrix", "SELECT id, " + ", ".join(f'topic_distribution[{i + 1}] AS "Topic {i}"' for i in range(8)) + " FROM doc_topics")
def _(c):
    return c.topics.select("id", *(F.try_element_at("topic_distribution", F.lit(i + 1)).alias(f"Topic {i}") for i in range(8)))


@query("mediation_row", f"SELECT id, {YEAR_ID} AS y, date, {CLEAN_J} AS newspaper, coalesce(canton, 'unknown') AS canton, coalesce(TRY_CAST(word_count AS DOUBLE), 0) AS n FROM a")
def _(c):
    df = rows(c, "date", text.clean_journal_name(F.col("newspaper")).alias("newspaper"), F.coalesce("canton", F.lit("unknown")).alias("canton"), F.coalesce(F.col("word_count").cast("double"), F.lit(0.0)).alias("n"))
    return df.select("id", text.year_from_id(F.col("id")).alias("y"), "date", "newspaper", "canton", "n")


# Rules


@query("star_map", """SELECT id, star, CASE star WHEN 1 THEN s WHEN 2 THEN 0.7 * s ELSE 0 END AS negative, CASE star WHEN 2 THEN 0.3 * s WHEN 3 THEN s WHEN 4 THEN 0.3 * s ELSE 0 END AS neutral, CASE star WHEN 4 THEN 0.7 * s WHEN 5 THEN s ELSE 0 END AS positive, CASE star WHEN 1 THEN -s WHEN 2 THEN -0.5 * s WHEN 4 THEN 0.5 * s WHEN 5 THEN s ELSE 0 END AS compound
FROM (SELECT id, CAST(1 + CAST(floor((compound + 1) * 2) AS INTEGER) AS INTEGER) AS star, neutral AS s FROM sentiment_scores WHERE compound IS NOT NULL AND neutral IS NOT NULL)""")
def _(c):
    df = c.sentiment.filter("compound is not null and neutral is not null").select("id", (F.floor((F.col("compound") + 1) * 2) + 1).cast("int").alias("star"), F.col("neutral").alias("s"))
    return df.select("id", "star", *rules.star_scores(F.col("star"), F.col("s")))


@query("sen03", r"""SELECT id, coalesce(trim(content), '') = '' AS blank, CAST(least(512, len(list_filter(regexp_split_to_array(trim(coalesce(content, '')), '\s+'), lambda x: x <> ''))) AS BIGINT) AS words FROM a""")
def _(c):
    w = F.slice(F.filter(F.split(F.trim(F.coalesce("content", F.lit(""))), r"\s+"), lambda x: x != ""), 1, 512)
    return rows(c, (F.trim(F.coalesce("content", F.lit(""))) == "").alias("blank"), F.size(w).cast("long").alias("words"))


@query("classify_sentiment", "SELECT id, CASE WHEN compound IS NULL THEN 'Unknown' WHEN compound > 0.05 THEN 'Positif' WHEN compound < -0.05 THEN 'Négatif' ELSE 'Neutre' END AS category FROM sentiment_scores")
def _(c):
    return c.sentiment.select("id", rules.sentiment_category(F.col("compound")).alias("category"))


@query("amplify", "SELECT id, greatest(-1, least(1, compound * 3)) AS compound, greatest(0, least(1, positive * 3)) AS positive FROM sentiment_scores WHERE compound IS NOT NULL AND positive IS NOT NULL")
def _(c):
    return c.sentiment.filter("compound is not null and positive is not null").select("id", rules.amplify(F.col("compound"), -1).alias("compound"), rules.amplify(F.col("positive"), 0).alias("positive"))


# The twins of the rules below are put together from the rules' fixed values; hand-worked tests check the values themselves.
BOTH = "lower(concat(coalesce(title, ''), ' ', coalesce(content, '')))"
QUOTED = lambda ws: ", ".join("'" + w.replace("'", "''") + "'" for w in ws)
HITS = lambda ws: " + ".join(f"CAST(contains({BOTH}, '" + w.replace("'", "''") + "') AS INTEGER)" for w in ws)
TIMES = "len(list_distinct(flatten([" + ", ".join(f"regexp_extract_all({BOTH}, '{p}')" for p in rules.TIMES) + "])))"
IS_AD = f"coalesce(regexp_matches(lower(title), '{rules.AD_TITLES}'), false)"
IS_TV = f"({HITS(rules.CHANNELS)}) >= 1 AND {TIMES} >= 5"
IS_JOB = f"({HITS(rules.JOB_WORDS)}) >= 3"
IS_NOISE = "(" + " OR ".join(f"regexp_matches(t, '{p}')" for p in rules.NOISE) + f" OR len(regexp_extract_all(t, '{rules.SPECIAL}')) / length(t) > 0.15)"
NOISE_TEXT = "coalesce(nullif(content, ''), nullif(original_content, ''))"

STEPS = " + ".join(f"CASE WHEN b{d} IN ({QUOTED(rules.BOOSTERS)}) THEN {rules.BOOST * f} WHEN b{d} IN ({QUOTED(rules.DAMPERS)}) THEN {-rules.BOOST * f} ELSE 0 END" for d, f in enumerate(rules.FADE))
TURNED = " OR ".join(f"b{d} IN ({QUOTED(rules.NEGATIONS)})" for d in range(3))


@query("vader", rf""", vw AS (SELECT id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM (SELECT id, regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}_]+') AS w FROM a WHERE content IS NOT NULL)),
vl AS (SELECT * FROM (VALUES {", ".join(f"('{w}', {v})" for w, v in rules.VALENCES.items())}) l(x, v)),
vb AS (SELECT id, p, x, coalesce(lag(x, 1) OVER o, '') AS b0, coalesce(lag(x, 2) OVER o, '') AS b1, coalesce(lag(x, 3) OVER o, '') AS b2 FROM vw WINDOW o AS (PARTITION BY id ORDER BY p)),
vs AS (SELECT id, (v + sign(v) * ({STEPS})) * CASE WHEN {TURNED} THEN {rules.NEGATE} ELSE 1 END AS s FROM vb JOIN vl USING (x)),
vt AS (SELECT a.id, coalesce(t.n, 0) AS n, coalesce(s.pos, 0) AS pos, coalesce(s.neg, 0) AS neg, coalesce(s.total, 0) AS total, coalesce(t.n, 0) - coalesce(s.k, 0) AS neu FROM a
 LEFT JOIN (SELECT id, count(*) AS n FROM vw GROUP BY id) t USING (id) LEFT JOIN (SELECT id, sum(CAST(CASE WHEN s > 0 THEN s + 1 ELSE 0 END AS DOUBLE)) AS pos, sum(CAST(CASE WHEN s < 0 THEN 1 - s ELSE 0 END AS DOUBLE)) AS neg, sum(CAST(s AS DOUBLE)) AS total, count(*) FILTER (WHERE s <> 0) AS k FROM vs GROUP BY id) s USING (id) WHERE content IS NOT NULL)
SELECT id, round(CASE WHEN pos + neg + neu > 0 THEN neg / (pos + neg + neu) ELSE 0 END, 6) AS negative, round(CASE WHEN pos + neg + neu > 0 THEN neu / (pos + neg + neu) ELSE 0 END, 6) AS neutral, round(CASE WHEN pos + neg + neu > 0 THEN pos / (pos + neg + neu) ELSE 0 END, 6) AS positive, round(total / sqrt(total * total + {rules.ALPHA}), 6) AS compound FROM vt""")
def _(c):
    return rows(c, text.tokens(F.col("content")).alias("w"), F.col("content").isNull().alias("none")).filter("not none").select("id", *rules.lexicon_scores(F.col("w")))


@query("ad_rule", f"SELECT id, {IS_AD} AS is_ad FROM a WHERE title IS NOT NULL")
def _(c):
    return rows(c, "title").filter("title is not null").select("id", rules.is_ad(F.col("title")).alias("is_ad"))


@query("noise_rule", f"SELECT id, {IS_NOISE} AS is_noise FROM (SELECT id, {NOISE_TEXT} AS t FROM a) WHERE t IS NOT NULL")
def _(c):
    from ..operators.filters import text_chain

    return rows(c, text_chain("content", "original_content").alias("t")).filter("t is not null").select("id", rules.is_noise(F.col("t")).alias("is_noise"))


@query("tv_rule", f"SELECT id, {IS_TV} AS is_tv FROM a")
def _(c):
    return rows(c, "title", "content").select("id", rules.is_tv(F.col("title"), F.col("content")).alias("is_tv"))


@query("job_rule", f"SELECT id, {IS_JOB} AS is_job FROM a")
def _(c):
    return rows(c, "title", "content").select("id", rules.is_job(F.col("title"), F.col("content")).alias("is_job"))


@query("classify_rules", f"SELECT id, CASE WHEN {IS_AD} THEN 'ad' WHEN {IS_TV} THEN 'tv' WHEN {IS_JOB} THEN 'job' WHEN coalesce({IS_NOISE}, false) THEN 'noise' ELSE 'normal' END AS class FROM (SELECT id, title, content, {NOISE_TEXT} AS t FROM a)")
def _(c):
    return rows(c, "content", "title", "original_content").select("id", rules.classify(F.col("title"), F.col("content"), F.col("original_content")).alias("class"))


@query("text_features", r"""SELECT id, CAST(length(content) AS BIGINT) AS n_chars, CAST(len(list_filter(regexp_split_to_array(trim(content), '\s+'), lambda x: x <> '')) AS BIGINT) AS n_words, round(len(regexp_extract_all(content, '\p{Nd}')) / length(content), 6) AS digits, round(len(regexp_extract_all(content, '\p{Lu}')) / length(content), 6) AS capitals FROM a WHERE content <> ''""")
def _(c):
    return rows(c, "content").filter("content <> ''").select("id", *rules.features(F.col("content")))


@query("classify_short", r"""SELECT id, CASE WHEN len(list_filter(regexp_split_to_array(trim(t), '\s+'), lambda x: x <> '')) < 80 THEN 'COURT' ELSE 'ML' END AS branch FROM (SELECT id, coalesce(nullif(content, ''), nullif(cleaned_text, ''), nullif(original_content, '')) AS t FROM a) WHERE t IS NOT NULL""")
def _(c):
    from ..operators.filters import text_chain, words_in

    t = text_chain("content", "cleaned_text", "original_content")
    return rows(c, t.alias("t")).filter("t is not null").select("id", F.when(words_in(F.col("t")) < 80, "COURT").otherwise("ML").alias("branch"))
