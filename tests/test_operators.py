"""Micro-fixtures: edges that the test tables don't reach."""

import difflib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from broadsheet.functions import dates, text
from broadsheet.operators import clusters, dedup, entities, filters, graphs, labelling, lexical, models, rules, sampling, terms, topics


def col(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize("x,y", [("1990-02-13", 1990), ("1990/02/13", 1990), ("13/02/1990", 1990), ("1990", None), ("", None), ("n/a", None), (None, None)])
def test_year_from_date(spark, x, y):
    assert col(spark, x, dates.year_from_date) == y


@pytest.mark.parametrize("x,d", [("1990-02-13", "1990-02-13"), ("1990/02/13", "1990-02-13"), ("13/02/1990", "1990-02-13"), ("13-02-1990", "1990-02-13"), ("1990", "1990-01-01"), ("", None), ("n/a", None), ("1990-02-31", None)])
def test_parse_date(spark, x, d):
    got = col(spark, x, dates.parse_date)
    assert (str(got) if got else None) == d


@pytest.mark.parametrize("x,base,clean", [("L'Impartial 12", "L'Impartial", "L'Impartial"), ("L'Impartial 12.", "L'Impartial", "L'Impartial"), ("Solidarité", "Solidarité", "Solidarité"), ("", "", "inconnu"), ("Le Pays..", "Le Pays..", "Le Pays")])
def test_journal_names(spark, x, base, clean):
    assert col(spark, x, text.journal_base_name) == base and col(spark, x, text.clean_journal_name) == clean


def test_whole_words(spark):
    count = lambda t, w: col(spark, t, lambda c: text.whole_word_count(c, w))
    assert count("Été été étéx", "été") == 2 and count("mot mot", "mot") == 2 and count("un c++ et c++", "c++") == 2 and count("micro-ordinateur d'ordinateur", "ordinateur") == 2


def test_redundant_terms(spark):
    df = spark.createDataFrame([("ordinateur", "ordinateurs"), ("micro-ordinateur", "microordinateur"), ("abcdefghij", "abcdefgxyz"), ("abcdefghij", "abcdefghxy"), ("chat", "rien")], "a string, b string")
    assert [r[0] for r in df.select(text.is_redundant(F.col("a"), F.col("b"))).collect()] == [True, True, False, True, False]


def test_sentiment_edges(spark):
    rows = [(-0.05,), (-0.0500001,), (0.05,), (0.0500001,), (None,)]
    df = spark.createDataFrame(rows, "x double")
    assert [r[0] for r in df.select(rules.sentiment_category(F.col("x"))).collect()] == ["Neutre", "Négatif", "Neutre", "Positif", "Unknown"]


def test_class_priority(spark):
    tv = "TSR 1\n" + "\n".join(f"1{k}h05 film" for k in range(6))
    rows = [("Petite annonce", tv), ("x", tv), ("x", "Candidature, recrutement : CDI"), ("x", "!!!!!! voilà"), ("x", "Le conseil se réunit."), (None, "Le conseil se réunit.")]
    df = spark.createDataFrame(rows, "t string, c string")
    assert [r[0] for r in df.select(rules.classify(F.col("t"), F.col("c"))).collect()] == ["ad", "tv", "job", "noise", "normal", "normal"]


def test_grouping_newspaper_chain(spark):
    rows = [("article_1990-01-01_b_x_mistral", "S", "N"), ("article_1990-01-01_b_x_mistral", "", "N"), ("article_1990-01-01_b_x_mistral", None, "N"), ("x", None, None)]
    df = spark.createDataFrame(rows, "id string, source string, newspaper string")
    assert [r[0] for r in df.select(filters.grouping_newspaper()).collect()] == ["S", "b", "N", "unknown"]


def test_keywords_none_needs_text(spark):
    df = spark.createDataFrame([("a", "Un tunnel", None), ("b", "", "rien ici"), ("c", None, None)], "id string, content string, cleaned_text string")
    assert [r.id for r in filters.keywords(df, ["tunnel"], "none").collect()] == ["b"]


def test_topic_filter_that_matches_nothing(spark):
    df = spark.createDataFrame([("a", [0.6, 0.4], 0), ("b", [0.1, 0.9], None), ("c", None, 1)], "id string, topic_distribution array<double>, dominant_topic int")
    ids = lambda d: {r.id for r in d.collect()}
    assert ids(topics.filter_documents(df, [7])) == set() and ids(topics.filter_documents(df, [7], legacy_empty_passthrough=True)) == {"a", "b", "c"}
    assert ids(topics.filter_documents(df, [1])) == {"b", "c"} and ids(topics.filter_documents(df, [0, 1], [0])) == {"b", "c"}
    assert [r[0] for r in df.select(topics.dominant(F.col("dominant_topic"), F.col("topic_distribution"))).collect()] == [0, 1, 1]


def test_term_counts(spark):
    df = spark.createDataFrame([("a", "Le pont, le Pont et le grand tunnel. Un grand tunnel"), ("b", None), ("c", "ponts")], "id string, content string")
    got = {(r.id, r.category, r.term, r.n) for r in terms.term_counts(df, {"x": ["pont", "tunnel"], "y": ["grand tunnel", "Pont"]}, F.col("content"), "id").collect()}
    assert got == {("a", "y", "pont", 2), ("a", "x", "tunnel", 2), ("a", "y", "grand tunnel", 2)}


def test_entity_pairs(spark):
    df = spark.createDataFrame([("a", "X", "PER"), ("a", "X", "ORG"), ("a", "Y", "LOC"), ("a", "Y", "LOC"), ("b", "Y", "LOC")], "id string, text string, label string")
    assert {(r.a, r.b, r.n) for r in entities.cooccurrence(df).collect()} == {("X", "X", 1), ("X", "Y", 2)}


def test_window_pairs(spark):
    df = spark.createDataFrame([("a b c d e a",), ("a b",), (None,)], "t string")
    got = {(r.a, r.b): r.n for r in lexical.window_cooccurrence(df, F.col("t"), [], 4, 1).collect()}
    assert got["a", "b"] == 2 and got["a", "d"] == 2 and ("a", "a") not in got and got["b", "e"] == 1


def test_lexical_statistics(spark):
    df = spark.createDataFrame([("a", "Un chat. Un chien !"), ("b", ""), ("c", None)], "id string, content string")
    (r,) = lexical.statistics(df, "id", F.col("content")).collect()
    assert (r.num_sentences, r.num_tokens, r.num_types, r.entropy) == (2, 4, 3, 1.5)


def test_components(spark):
    rng = random.Random(1)
    edges = [(f"a{k:03}", f"a{k + 1:03}") for k in range(60)] + [("b", "c"), ("c", "b"), ("d", "d"), (None, "x"), ("hub", "z0")] + [("hub", f"z{k}") for k in range(40)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in graphs.connected_components(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert {got[f"a{k:03}"] for k in range(61)} == {"a000"} and got["c"] == "b" and got["d"] == "d" and {got[f"z{k}"] for k in range(40)} == {"hub"} and None not in got and "x" not in got
    assert graphs.connected_components(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_duplicates(spark):
    base = " ".join(f"mot{k}" for k in range(60))
    rows = [("a", "1990-01-01", base), ("b", "1990-01-04", base + " fin"), ("c", "1990-01-05", base), ("d", "1990-01-02", "autre chose"), ("e", None, base), ("f", "1990-01-02", None), ("g", "1990-01-04", base.upper())]
    df = spark.createDataFrame(rows, "id string, date string, content string").withColumn("d", dates.parse_date(F.col("date")))
    h = df.withColumn("h", text.content_hash(F.col("content")))
    assert {(r.id, r.links) for r in dedup.links_within(h, 3).collect()} == {("a", 1), ("c", 1), ("g", 2)}
    assert {r.id for r in dedup.remove_exact(h.select("id", "h")).collect()} == {"a", "b", "d", "f"}
    near = {(r.id_a, r.id_b) for r in dedup.near_duplicates(df).collect()}
    assert near == {("a", "b"), ("a", "g"), ("b", "c"), ("b", "g"), ("c", "g")}
    assert {r.id: r.kept for r in dedup.merge_groups(dedup.near_duplicates(df)).collect()} == dict.fromkeys("abcg", "a")
    more = df.unionByName(df.filter("id in ('a', 'd')").withColumn("id", F.concat(F.lit("z"), "id")))
    assert {r.id: r.kept for r in dedup.merge_groups(dedup.near_duplicates(more), dedup.day_copies(more.filter("content is not null"))).collect()} == dict.fromkeys(["a", "b", "c", "g", "za"], "a") | {"d": "d", "zd": "d"}


def test_sequence_ratio(spark):
    df = spark.createDataFrame([("abcd", "bcde"), ("", ""), (None, "a")], "a string, b string")
    assert [r[0] for r in df.select(text.seq_ratio("a", "b")).collect()] == [difflib.SequenceMatcher(None, "abcd", "bcde").ratio(), 1.0, None]


def test_samples(spark):
    df = spark.range(1000).withColumn("c", F.when(F.col("id") < 900, "x").otherwise("y")).repartition(7)
    assert [r.id for r in sampling.systematic(df, "id", 10).orderBy("id").collect()] == list(range(0, 1000, 100))
    s = sampling.stratified(df, "id", "c", 100, 42)
    assert {r.c: r["count"] for r in s.groupBy("c").count().collect()} == {"x": 90, "y": 10}
    assert s.orderBy("id").collect() == sampling.stratified(df.repartition(3), "id", "c", 100, 42).orderBy("id").collect()
    p = sampling.split(df, "id", "c", 0.8, 1).groupBy("c", "part").count().collect()
    assert all(abs(r["count"] - {"x": 900, "y": 100}[r.c] * {"train": 0.8, "test": 0.2}[r.part]) < 25 for r in p)
    assert sampling.systematic(df.limit(0), "id", 5).count() == 0


def test_cluster_scaling(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0)], "label string, d double")
    assert sorted((r.label, r.scaled, r.is_anomaly) for r in clusters.scale_in_cluster(df, "label", "d").collect()) == [("a", 0.0, False), ("a", 1.0, True), ("b", 0.0, False)]


def test_rotation_is_found(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(30, 4))
    q, _ = np.linalg.qr(rng.normal(size=(4, 4)))
    frame = lambda x: spark.createDataFrame([(f"w{k}", [float(v) for v in r]) for k, r in enumerate(x)], "word string, vector array<double>")
    r, error = models.procrustes(frame(m), frame(m @ q))
    assert np.allclose(r, q, atol=1e-6) and error < 1e-6
    assert models.procrustes(frame(m[:5]), frame(m[:5]))[1] == float("inf")
    drift = {(x.term, x.period): x.semantic_distance for x in models.semantic_drift({"1970": frame(m), "1980": frame(m @ q)}, ["w1", "w2"]).collect()}
    assert drift["w1", "1970"] == 0 and abs(drift["w2", "1980"]) < 1e-6


def test_answers_are_keyed_by_number():
    assert labelling.parse_answers("Texte 2 : OUI\nTexte 4 : non", 4, "NON") == ["NON", "OUI", "NON", "NON"]
    assert labelling.parse_title("TITRE: Les ponts\nRÉSUMÉ: Deux\nlignes") == ("Les ponts", "Deux\nlignes")
    calls = []

    def ask(t):
        calls.append(t)
        raise OSError("down")

    with pytest.raises(OSError):
        labelling.ask_with_retries(ask, "x", 3, 0)
    assert len(calls) == 3


def test_near_duplicates_without_a_common_run(spark):
    long = [f"mot{k}" for k in range(60)]
    edited = [w if k % 4 else "n" + w[1:] for k, w in enumerate(long)]
    rows = [("a", "1990-01-01", "le conseil approuve le budget annuel de la piscine"), ("b", "1990-01-03", "le conseil approuve la budget annuel de la piscine"), ("c", "1990-01-02", " ".join(long)), ("d", "1990-01-04", " ".join(edited)), ("e", "1990-01-01", "un mot"), ("f", "1990-01-02", "un mut"), ("g", "1990-01-09", " ".join(long))]
    df = spark.createDataFrame(rows, "id string, date string, content string").withColumn("d", dates.parse_date(F.col("date")))
    near = sorted((r.id_a, r.id_b) for r in dedup.near_duplicates(df, ratio=0.8).collect())
    assert near == [(x[0], y[0]) for x in rows for y in rows if x < y and abs(int(x[1][-2:]) - int(y[1][-2:])) <= 3 and difflib.SequenceMatcher(None, x[2], y[2]).ratio() >= 0.8]
    assert {("a", "b"), ("e", "f")} <= set(near)
    rng = random.Random(3)
    for _ in range(50):
        x, y = ("".join(rng.choice("abcd ") for _ in range(rng.randint(1, 70))) for _ in range(2))
        row = [0] * (len(y) + 1)
        for c in x:
            new = [0]
            for k, e in enumerate(y):
                new.append(row[k] + 1 if c == e else max(row[k + 1], new[k]))
            row = new
        assert dedup.common_subsequence(x, dedup.places(y), len(y)) == row[-1]


def test_rules_by_hand(spark):
    times = "9.05 puis 10:30, 11h, 12h30, à 13 h 15 et 14 heures"
    rows = [
        ("Soirée", f"Sur TF1 : {times}", True, False), ("TSR 1", f"{times}", True, False), ("Radio", f"tv radio canal chaîne {times}", False, False), ("M6", "9.05 et encore 9.05, 10:30", False, False), (None, None, False, False),
        ("Recrutement", "Envoyez votre candidature, CDI", False, True), ("x", "emploi poste salaire engage contrat", False, False), ("Offre d'emploi", "poste à pourvoir", False, False), ("Temps plein", "cdd, embauche", False, True),
    ]
    df = spark.createDataFrame(rows, "t string, c string, tv boolean, job boolean")
    got = df.select("tv", "job", rules.is_tv(F.col("t"), F.col("c")).alias("a"), rules.is_job(F.col("t"), F.col("c")).alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [(r.tv, r.job) for r in got]
    noisy = [("(voir p. 3) - oui ! non ?", False), ("§§§§§ a b c d e f g h i j k l m n o p q", True), ("a#b#c#d", True), ("a,b;c:d!", False), ("un....; deux", True), ("a\n \n\n\t\n\nb", True), ("a\n\n\n\nb", False), ("prix : 3 francs      oui", False)]
    df = spark.createDataFrame(noisy, "c string, want boolean")
    assert all(r.want == r.got for r in df.select("want", rules.is_noise(F.col("c")).alias("got")).collect())
    ads = [("Annonces", True), ("ad", True), ("Head of", True), ("Le grand soir", False), ("À vendre", False)]
    assert [r[0] for r in spark.createDataFrame(ads, "t string, w boolean").select(rules.is_ad(F.col("t"))).collect()] == [w for _, w in ads]
    chain = spark.createDataFrame([("", "#" * 9), (None, None)], "c string, o string").select(rules.classify(F.lit("x"), F.col("c"), F.col("o")))
    assert [r[0] for r in chain.collect()] == ["noise", "normal"]


def test_valences(spark):
    say = lambda s: spark.createDataFrame([(s.split(),)], "w array<string>").select(*rules.lexicon_scores(F.col("w"), {"bon": 2.0, "panne": -1.5})).first()
    norm = lambda s: round(s / (s * s + 15) ** 0.5, 6)
    assert say("le repas bon").compound == norm(2.0) and say("le repas très bon").compound == norm(2.293) and say("très le bon").compound == norm(2.0 + 0.293 * 0.95)
    assert say("pas très bon").compound == norm(2.293 * -0.74) and say("peu bon").compound == norm(2 - 0.293) and say("très panne").compound == norm(-1.793)
    r = say("bon panne rien")
    assert (r.positive, r.negative, r.neutral) == (round(3 / 6.5, 6), round(2.5 / 6.5, 6), round(1 / 6.5, 6))
    e = spark.createDataFrame([([],)], "w array<string>").select(*rules.lexicon_scores(F.col("w"))).first()
    assert tuple(e) == (0.0, 0.0, 0.0, 0.0)


def test_entity_spans(spark):
    t = "Élodie Zanbruvay vit à Grand Val, près d’Élodie Zanbruvay. Été ici."
    df = spark.createDataFrame([(1, t), (2, None), (3, " "), (4, "Rien ici")], "id int, c string")
    got = entities.labelled(entities.spans(df, "id", F.col("c")), spark.createDataFrame([("Élodie Zanbruvay", "PER")], "text string, label string")).collect()
    assert all(t[r.start : r.end] == r.text for r in got)
    assert sorted((r.text, r.label, r.start) for r in got) == [("Grand Val", "MISC", 23), ("Élodie Zanbruvay", "PER", 0), ("Élodie Zanbruvay", "PER", 41)]
    g = entities.gazetteer(spark.createDataFrame([("A B", "ORG"), ("A B", "PER"), ("A B", "PER"), (None, "PER")], "text string, label string"))
    assert [tuple(r) for r in g.collect()] == [("A B", "PER")]


def test_lexical_counts_and_tag_ratios(spark):
    df = spark.createDataFrame([(1, "Le chat et le chien. Le chat dort !"), (2, None), (3, "123")], "id int, t string")
    r = lexical.statistics(df, "id", F.col("t")).collect()
    import math

    n = [3, 2, 1, 1, 1]
    assert [(x.id, x.num_tokens, x.num_types, x.num_sentences) for x in r] == [(1, 8, 5, 2)] and abs(r[0].entropy - -sum(k / 8 * math.log2(k / 8) for k in n)) < 1e-4
    assert {x.id: x.top_words for x in lexical.top_words_string(df, "id", F.col("t"), ["le"], 2).collect()} == {1: "chat:2,et:1"}
    tagger = lambda texts: [["NOUN" if w[0] == "c" else "DET" for w in t.split()] for t in texts]
    got = {x.id: (x.lexical_density, x.pos_NOUN, x.pos_ADV) for x in lexical.tag_ratios(df, "id", "t", tagger).collect()}
    assert got == {1: (3 / 9, 3 / 9, 0.0), 2: (0.0, 0.0, 0.0), 3: (0.0, 0.0, 0.0)}


def test_numbers_without_gaps_and_best_pick(spark):
    df = spark.createDataFrame([(f"k{i % 700}",) for i in range(1500)], "k string")
    got = [r.n for r in models.numbered(df, "k", "n", parts=16).collect()]
    assert sorted(got) == list(range(700))
    s = spark.createDataFrame([(3, 0.5), (2, 0.9), (5, 0.9), (4, None)], "k int, score double")
    assert models.best_pick(s, "score", "k").first().k == 2 and models.best_pick(s.filter("score is not null"), "score", "k", highest=False).first().k == 3


def test_clicks():
    click = filters.click_filter
    assert click("sentiment-by-newspaper", {"x": "A", "label": "B"}) == ("newspaper", "B", "B") and click("sentiment-by-date", {"x": "1990"}) == ("date", "1990", "1990")
    assert click("sentiment-pie", {"label": "Positif"}) == ("sentiment_category", "positif", None) and click("sentiment-histogram", {"x": 0.3}) == ("sentiment_score", 0.3, None)
    assert click("entity-frequency-PER", {"x": "A"}) == ("entity", "A", "A") and click("entity-top-articles", {}, "id1") == ("article_id", "id1", None) and click("other", {}) == (None, None, None)
