from broadsheet.llm import quality
from broadsheet.llm.prose import is_prose, sentences

LISTS = [
    "\n".join(f"Valdorne\t{k}\t{k + 9}\tsoleil" for k in range(12)), "\n".join(f"1{k}h05 La séance communale, série" for k in range(9)), "xkcd qwrt zzgh vbnm " * 20,
    "\n".join(f"Banloreron ............ {k}10.42" for k in range(12)), "D898 888552A6 69 40D4 43C621 " * 8, ";:<(* -_/ >|.," * 30,
]


def articles(spark, prose):
    rows = [(f"p{k}", " ".join(prose[k : k + 5]), None) for k in range(0, 200)] + [(f"x{k}", t, "fr") for k, t in enumerate(LISTS)]
    rows += [("short", "\n".join(prose[0].split(" ")), None), ("mixed", " ".join(prose[:8]) + "\nTotal 12\nReste 3", None), ("blank", " \n ", None), ("none", None, None), ("p1", " ".join(prose[1:6]), None), (None, prose[3], None)]
    return spark.createDataFrame(rows, "id string, content string, lang string")


def test_lists_tables_and_junk_are_told_from_prose(spark, common, prose):
    out = quality.assess(articles(spark, prose), common)
    rows = {r.id: r for r in out.collect()}
    assert {k for k, r in rows.items() if r.verdict == "not prose"} == {f"x{k}" for k in range(len(LISTS))}
    assert "blank" not in rows and "none" not in rows and None in rows and out.filter("id = 'p1'").count() == 1
    for r in rows.values():
        assert abs(sum(r[f"from_{s}"] for s in quality.STATS) - r.distance) < 1e-6, "contributions add up to the distance"
    assert rows["p5"].lang == "fr" and rows["x0"].distance > quality.LIMIT


def test_figures_of_a_text():
    n, mean, symbols, ends, common, inside, lang = quality.measure("Le chat dort.\nLa nuit ?\nrien", frozenset({"le", "la"}), {"fr": frozenset({"le", "la"})})
    assert (n, lang) == (6, "fr") and abs(mean - 20 / 6) < 1e-9 and abs(ends - 2 / 3) < 1e-9 and abs(common - 1 / 3) < 1e-9 and abs(symbols - 2 / 22) < 1e-9
    assert quality.measure("123 456", frozenset(), {})[0] == 0


def test_sentences():
    t = "A. Galtiernex paie Fr. 12.— et rentre. « Il faut voir », dit la dame. Puis rien"
    parts = [t[a:b].strip() for a, b, _ in sentences(t)]
    assert len(parts) == 3 and [e for _, _, e in sentences(t)] == [True, True, False]
    assert not is_prose("Voici la liste de la semaine", frozenset({"la", "de"}), ended=False)


def test_empty_and_long(spark, common):
    assert quality.assess(spark.createDataFrame([], "id string, content string"), common).count() == 0
    one = spark.createDataFrame([("long", "Le conseil est dans la ville. " * 40_000), ("run", "x" * 500_000)], "id string, content string")
    assert {r.id: r.verdict for r in quality.assess(one, common).collect()} == {"long": "prose", "run": "not prose"}
    assert quality.assess(one, spark.createDataFrame([], "lang string, word string")).count() == 2


def test_the_distance_alone_decides(spark, common, prose):
    out = quality.assess(articles(spark, prose), common).collect()
    assert {r.id for r in out if r.distance > quality.LIMIT} == {r.id for r in out if r.verdict == "not prose"}


def test_a_third_of_lists_and_a_copied_list_do_not_move_the_model(spark, common, prose):
    rows = [(f"p{k}", " ".join(prose[k : k + 5])) for k in range(200)]
    rows += [(f"x{k}", f"{LISTS[0]}\nle {k} la") for k in range(60)] + [(f"y{k}", "Total le 12 la 3 une 44 est\n" * 9) for k in range(40)]
    got = {r.id: r.verdict for r in quality.assess(spark.createDataFrame(rows, "id string, content string"), common).collect()}
    assert {k for k, v in got.items() if v == "not prose"} == {k for k in got if k[0] in "xy"}


def test_verdicts_do_not_depend_on_the_size_of_the_table(spark, common, prose):
    few = articles(spark, prose).filter("id is not null")
    many = few.selectExpr("explode(sequence(0, 9)) as copy", "*").selectExpr("concat(copy, id) as id", "content")
    one = {r.id: r.verdict for r in quality.assess(few, common).collect()}
    ten = quality.assess(many, common).collect()
    assert len(ten) == 10 * sum(1 for _ in quality.assess(few, common).collect()) and all(r.verdict == one[r.id[1:]] for r in ten)
