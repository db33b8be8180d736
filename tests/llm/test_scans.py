import pytest

from broadsheet.llm import scans

PAPER = "La Gazette d'Ormeval"


def noisy(prose):
    p = [" ".join([*prose[:3], *prose[12 + k : 16 + k]]) for k in range(0, 200, 4)]
    bad = {
        "break": p[0].replace("piscine", "pis-\ncine", 1), "gone": p[1].replace("budget", "bud- get", 1), "soft": p[2].replace("conseil", "con\xad\nseil", 1), "not": p[3].replace("commune", "com¬ mune", 1),
        "sign": p[4].replace("budget", "bud9et", 1), "dagger": p[5].replace("tunnel", "†unnel", 1), "rn": p[6].replace("commune", "cornmune", 1), "cap": p[7] + " Le 5oir est là.", "head": p[8] + "\nLA GAZETTE D'ORMEVAL   12\n" + p[9],
        "page": p[10].replace(" la ", " la p. 5 / 24 ", 1), "dash": p[11] + "\n— 12 —\n" + p[12], "dated": p[13] + f"\n| {PAPER} |  1 décembre 1986\n21\n" + p[14], "across": p[15].replace("budget", "bud-\nPage 59\nget", 1),
    }
    good = {
        "ref": p[16] + " Le tarif est dans le plan (lire en page 9).", "see": p[17] + " La carte est là ; voir aussi p. 12.", "type": p[18] + " Un TM370XL est dans la salle.", "lines": p[19].replace(" ", "\n"), "sub": p[20] + "\nLA FÊTE DE LA VALLÉE\n" + p[21],
        "compound": p[22] + " Le porte-\nparole est là.", "name": p[23] + " Odile Bortiremet est la dame.", "year": p[24] + " En 1986, 12 enfants sont là.",
    }
    return p, bad, good


@pytest.fixture(scope="module")
def data(spark, prose):
    p, bad, good = noisy(prose)
    rows = [(f"p{k}", x + " Le soir est là. Le porte-parole est Odile Bortiermet.", None, PAPER) for k, x in enumerate(p)]
    rows += [(k, x, None, PAPER) for k, x in {**bad, **good}.items()] + [("both", p[0], bad["sign"], None), ("list", "\n".join(f"bud9et {k}" for k in range(30)), None, PAPER), ("none", None, " ", None), ("sign", bad["sign"], None, PAPER)]
    return p, bad, spark.createDataFrame(rows, "id string, content string, original_content string, source string")


FIELDS = ["content", "original_content"]


def test_noise_is_found_and_what_looks_like_it_is_not(data, common):
    _, bad, df = data
    got = sorted((r.id, r.field) for r in scans.find(df, common, FIELDS).collect())
    assert got == sorted([*((k, "content") for k in bad), ("both", "original_content")])


def test_repairs(data, common):
    p, bad, df = data
    got = {(r.id, r.field): r for r in scans.find(df, common, FIELDS, restore=True).collect()}
    for k, i in (("break", 0), ("gone", 1), ("soft", 2), ("not", 3), ("sign", 4), ("dagger", 5), ("rn", 6), ("page", 10), ("across", 15)):
        assert got[k, "content"].repaired == p[i], k
    assert got["cap", "content"].repaired.endswith("Le soir est là.") and "GAZETTE" not in got["head", "content"].repaired and "1986" not in got["dated", "content"].repaired
    joined = {(r.id, r.field): r.repaired for r in scans.find(df, common, FIELDS, restore=True, most=0).collect()}
    assert joined == {k: r.repaired for k, r in got.items()}


def test_weighted_distance():
    assert scans.misreading("cornmune", "commune") == pytest.approx(0.4) and scans.misreading("esserta11es", "essertalles") == pytest.approx(0.8)
    assert scans.misreading("commune", "communs") is None and scans.misreading("piscme", "piscine") == pytest.approx(0.4)
    assert "abc" in scans.deletes("abxc") and "ac" in scans.deletes("abxc") and "ab" in scans.deletes("ab")


def test_context_decides(spark, common, prose):
    p = " ".join(prose[:12])
    rows = [(f"a{k}", f"{p} La pâte molle est là. Une patte de chat est dans la salle.", PAPER) for k in range(30)]
    # "tcte" can be "tete" or "téte": the words beside it decide.
    rows += [(f"b{k}", f"{p} La belle lecture est là. Un bel éclat est là.", PAPER) for k in range(40)] + [(f"c{k}", f"{p} Un vieux lccture est là.", PAPER) for k in range(1)]
    df = spark.createDataFrame(rows, "id string, content string, source string")
    out = scans.find(df, common, ["content"], restore=True).collect()
    assert [r.id for r in out] == ["c0"] and "Un vieux lecture" in out[0].repaired
    r = scans.Repairer([], frozenset(), {"tcte": [("tete", 0.4, 50), ("téte", 0.4, 60)]}, set(), {"une\ttcte\thaute": "tete"})
    assert r.choose("tcte", "une", "haute") == "tete" and r.choose("tcte", "la", "basse") == "téte"


def test_empty_and_long(spark, common, prose):
    assert scans.find(spark.createDataFrame([], "id string, content string, source string"), common, ["content"]).count() == 0
    x = " ".join(prose) + " "
    df = spark.createDataFrame([("l", x * 20 + "Le con¬\nseil est là. " + x * 20, None), (None, "y" * 300_000, None)], "id string, content string, source string")
    assert [r.id for r in scans.find(df, common, ["content"]).collect()] == ["l"]


def test_occurrences_are_judged_not_tokens(spark, common, prose):
    rows = [(f"a{k}", f"{prose[0]} Entre nous, le journal est là. La commune est entre le budget et la piscine.", PAPER) for k in range(150)]
    rows += [("cap", f"{prose[0]} Entrc nous, le tunnel est dans la salle.", PAPER), ("mixed", f"{prose[0]} Un joiirnal est dans la salle.", PAPER), ("first", f"{prose[0]} Joiirnal et tunnel dans la salle.", PAPER)]
    # A name as frequent as that leaves the words beside the lower-case form to decide; the name itself stays.
    rows += [(f"n{k}", f"{prose[0]} Le maître est Odile Piscme avec elle.", PAPER) for k in range(40)] + [("low", f"{prose[0]} Le budget de la piscme avec prudence.", PAPER)]
    got = {r.id: r.repaired for r in scans.find(spark.createDataFrame(rows, "id string, content string, source string"), common, ["content"], restore=True).collect()}
    assert set(got) == {"cap", "mixed", "first", "low"}
    assert "Entre nous" in got["cap"] and "Un journal" in got["mixed"] and "Journal et" in got["first"] and "la piscine avec" in got["low"]


def test_short_words_need_their_neighbours(spark, common, prose):
    rows = [(f"a{k}", f"{prose[0]} Il va chez elle avec toi en juin.", PAPER) for k in range(440)]
    rows += [("avcc", f"{prose[0]} Il va chez elle avcc toi en juin.", PAPER), ("jum", f"{prose[0]} Il va chez elle avec toi en jum.", PAPER), ("cap", f"{prose[0]} Il va Chcz elle avec toi en juin.", PAPER), ("cn", f"{prose[0]} Il va chez elle avec toi cn juin.", PAPER)]
    rows += [("own", f"{prose[0]} Il achète jum pour la salle.", PAPER)]
    got = {r.id: r.repaired for r in scans.find(spark.createDataFrame(rows, "id string, content string, source string"), common, ["content"], restore=True).collect()}
    assert got == dict.fromkeys(["avcc", "jum", "cn"], rows[0][1]) | {"cap": rows[0][1].replace("chez", "Chez")}


def test_broken_and_misread_words_in_both_ways(spark, common, prose):
    rows = [(f"a{k}", f"{prose[0]} Le gouvernement approuve la lecture avec nous.", PAPER) for k in range(120)] + [(f"g{k}", f"{prose[0]} Le gouvemement est là.", PAPER) for k in range(3)]
    rows += [("x", f"{prose[0]} Le gouve-\nmement approuve la lccture avec nous.", PAPER), ("y", f"{prose[0]} Le gouver-\nnement approuve la lccture avcc nous.", PAPER)]
    df = spark.createDataFrame(rows, "id string, content string, source string")
    got, joined = ({r.id: (r.repaired, r.n_broken, r.n_misread) for r in scans.find(df, common, ["content"], restore=True, **m).collect()} for m in ({}, {"most": 0}))
    assert got == joined and "Le gouvernement approuve la lecture" in got["x"][0] and got["x"][1:] == (1, 2) and "Le gouvernement approuve la lecture" in got["y"][0]


def test_long_words_short_papers_and_rows_without_a_paper(spark, common, prose):
    long = "donaudampfschifffahrtsgesellschaftskapitaenswitwenrente"
    assert scans.index_keys(long.replace("m", "rn", 1), False) & scans.index_keys(long, True) and scans.index_keys(long, False) & scans.index_keys(long + "rn", True)
    assert not scans.index_keys("x" * 60, False) & scans.index_keys(long, True)
    rows = [(f"article_1950-01-0{k}_le_24_{k}a_mistral", f"{prose[0]} La {long} est dans la salle.", "24H") for k in range(5)]
    rows += [("article_1950-01-09_le_24_9a_mistral", f"{prose[0]}\n24H   7\n{prose[12]}", None), ("article_1950-01-09_autre_9b_mistral", f"{prose[0]} Il est 24H dans la salle.", None), ("long", f"{prose[0]} La {long.replace('m', 'rn', 1)} est dans la salle.", "x")]
    rows += [(f"m{k}", f"{prose[0]} La {long} est dans la salle.", "x") for k in range(20)]
    df = spark.createDataFrame(rows, "id string, content string, source string")
    got = {r.id: r for r in scans.find(df, common, ["content"], restore=True).collect()}
    assert set(got) == {"article_1950-01-09_le_24_9a_mistral", "long"} and long in got["long"].repaired and "24H" not in got["article_1950-01-09_le_24_9a_mistral"].repaired
    assert {r.id for r in scans.find(df, common, ["content"], most=0).collect()} == set(got)
