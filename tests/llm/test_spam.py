from broadsheet.llm import spam

SPAM = {
    "keywords": "montre pas cher Valdorne, montre promo Ormeval, montre soldes Grandchêne, montre avis Fenalpe, " * 6, "repeat": "MONTRE BON MARCHÉ MONTRE BON MARCHÉ MONTRE " * 20,
    "links": "\n".join(f"Voyance promo - shop.site{k}.example" for k in range(20)), "urls": "\n".join(f"http://www.page{k}.test/montre/{k}" for k in range(20)), "tags": " ".join(f"#montre{w} +voyage{w}" for w in "promo soldes avis neuf rapide".split() * 6),
    "captions": "Page 3 > Accueil > Liens montre > Top 9 > Partenaires > Accueil > Liens montre > Partenaires > Annuaire > " * 5,
    "sentences": "Pour une montre montre, voyez la montre et encore la montre. Qui dit montre dit montre, et la montre est une montre. " * 8,
}
HONEST = {
    "weather": "\n".join(f"Valdorne\t{k}\t{k + 9}\tsoleil" for k in range(25)), "programme": "\n".join(f"1{k % 10}h05 La séance communale, série" for k in range(25)), "ads": "\n".join(f"À vendre piano, état neuf, Fr. {k}20.—, tél. 021 4{k}" for k in range(20)),
    "csv": "\n".join(f"19{k};5{k}80;1.{k};oui" for k in range(10, 40)), "names": ", ".join(f"{a}. {b}" for a, b in zip("ABCDEFGHIJKLMNOP", "Belregaz Corvanet Dalfombre Esternay Falquemont Gorlanie Hastierre Imbervaux Jolimontet Karsenval Lombardin Mirecourtin Novelange Orbessan Pralognier Quintavel".split())),
    "index": "\n".join(f"* Le projet de la commune p. {k}" for k in range(20)),
}


def docs(spark, prose):
    texts = [" ".join(prose[12 + k : 20 + k]) for k in range(0, 230)]
    rows = [(k, x) for k, x in enumerate(texts)] + [(1000 + k, x) for k, x in enumerate(SPAM.values())] + [(2000 + k, x) for k, x in enumerate(HONEST.values())]
    rows += [(3000, None), (3001, ""), (3002, "  "), (3003, "Fin"), (3004, SPAM["repeat"]), (3005, " ".join(prose[12:15]) + "\n" + SPAM["keywords"]), (3006, " ".join(prose[12:72]) + "\n" + SPAM["links"][:200]), (3007, texts[0] + " (voir http://www.un.test/page)"), (3008, "123 456"), (3009, "...")]
    return spark.createDataFrame([(a, b, "fr", 1.0) for a, b in rows], "doc_id long, text string, lang string, ratio double")


def test_spam_is_told_from_lists_and_prose(spark, common, prose):
    out = spam.judge(docs(spark, prose), common)
    assert out.count() == len({r.doc_id for r in out.select("doc_id").collect()})
    got = {r.doc_id for r in out.filter("is_spam").collect()}
    assert got == {1000 + k for k in range(len(SPAM))} | {3004, 3005}


def test_empty_and_long(spark, common):
    assert spam.judge(spark.createDataFrame([], "doc_id long, text string"), common).count() == 0
    df = spark.createDataFrame([(1, SPAM["repeat"] * 300), (2, "x" * 400_000), (None, "Le chat est là.")], "doc_id long, text string")
    assert {r.doc_id: r.is_spam for r in spam.judge(df, common).collect()} == {1: True, 2: False, None: False}


def test_verdicts_do_not_depend_on_the_size_of_the_table(spark, common, prose):
    few = docs(spark, prose)
    many = few.selectExpr("explode(sequence(0, 9)) as copy", "*").selectExpr("doc_id + 10000 * copy as doc_id", "text")
    one = {r.doc_id: (r.is_spam, round(r.redundancy, 9)) for r in spam.judge(few, common).collect()}
    ten = spam.judge(many, common).collect()
    assert len(ten) == 10 * len(one)
    assert all((r.is_spam, round(r.redundancy, 9)) == one[r.doc_id % 10000] for r in ten)


def test_no_verdict_without_redundancy(spark, common, prose):
    assert all(r.redundancy > 3 for r in spam.judge(docs(spark, prose), common).filter("is_spam").collect())


def test_spam_among_prose_does_not_move_the_line(spark, common, prose):
    stuffed = [" ".join(f"{s} voyance" if k % 2 else s.replace(" ", " voyance ", 3) for k, s in enumerate(prose[at : at + 8])) for at in range(12, 92)]
    rows = [(k, " ".join(prose[12 + k : 20 + k])) for k in range(230)] + [(5000 + k, x) for k, x in enumerate(stuffed)]
    got = {r.doc_id: r.is_spam for r in spam.judge(spark.createDataFrame(rows, "doc_id long, text string"), common).collect()}
    assert sum(v for k, v in got.items() if k >= 5000) >= 0.95 * len(stuffed) and not any(v for k, v in got.items() if k < 5000)


def test_keywords_of_several_words_and_captions(spark, common, prose):
    phrase = "Achetez votre cours de langue ici, car notre cours de langue est un cours de langue. Qui dit cours de langue dit cours de langue. " * 6
    captions = "\n".join("Accueil|Partenaires|Annuaire Valdorne|Page 4|Liens montre|Cliquez ici|Accueil|Top 9|Annuaire Fenalpe|Partenaires|Accueil|Liens taxi|Page 12|Cliquez ici".split("|") * 2)
    refrain = "Le soir tombe sur la vallée et la cloche du village sonne encore. " + " ".join(prose[30:34])
    rows = [(k, " ".join(prose[12 + k : 20 + k])) for k in range(230)] + [(1000, phrase), (1001, captions), (1002, refrain * 5)]
    got = {r.doc_id for r in spam.judge(spark.createDataFrame(rows, "doc_id long, text string"), common).filter("is_spam").collect()}
    assert got == {1000, 1001}
