import difflib

import pytest

from broadsheet.llm import encoding

CLEAN = ["L’été dernier, la société a réglé le marché à Genève.", "Le théâtre présente une pièce : « Où êtes-vous ? » dès février.", "Un vétérinaire étranger a été engagé, voilà l’idée.", "Die Brücke über den Fluß wird geprüft.", "À peine arrivée, l’ingénieure défend l’hôpital — déjà coûteux."]
FOREIGN = ["Le poète Łukrěz Žďárov décrit 48 m², 30° et 2½ mois.", "Arne Ødegård-Nyström a chanté « ¿Qué más? »", "La règle √9 = 3 et le signe ± ; prix £ 300 © 1980", "quoi? rien? pourquoi?oui"]


def garble(text, chain):
    steps = chain.split(" > ")
    if chain == "> ascii":
        return text.encode("ascii", "replace").decode()
    if chain == "cp1252 > utf-8":
        return text.encode("cp1252").decode("utf-8", "replace")
    for a, b in zip(steps[::2], steps[1::2]):
        text = encoding.misread(text.encode(a), b)
    return text


CHAINS = ["utf-8 > cp1252", "utf-8 > latin-1", "utf-8 > mac_roman", "utf-8 > cp437", "utf-8 > cp850", "utf-8 > cp1250", "utf-8 > cp1251", "utf-8 > cp1252 > utf-8 > cp1252", "cp1252 > mac_roman", "cp1252 > cp850", "mac_roman > cp1252", "cp1252 > utf-8", "> ascii"]


def corpus(spark):
    rows = [(f"c{k}", t, t.upper(), "x") for k, t in enumerate(CLEAN)] + [(f"r{k}_{j}", t, None, "x") for k, t in enumerate(CLEAN) for j in range(40)] + [(f"f{k}", t, "", None) for k, t in enumerate(FOREIGN)]
    # One word alone, and one that only garbling makes unique.
    rows += [(f"g{k}", garble(CLEAN[k % 3], c), "Le prix", "x") for k, c in enumerate(CHAINS)] + [("one", "Il a réglé le prix", garble("société", "utf-8 > mac_roman"), "x"), ("name", garble("Zoé Brülé-Hêtier", "utf-8 > cp1252"), None, "x"), ("none", None, None, None), ("one", "Il a réglé le prix", garble("société", "utf-8 > mac_roman"), "x")]
    return spark.createDataFrame(rows, "id string, content string, title string, key string")


@pytest.fixture(scope="module")
def restored(spark):
    out = encoding.find(corpus(spark), ["content", "title"], restore=True).collect()
    return {(r.id, r.field): r for r in out}


def test_all_chains_are_found_and_clean_text_is_not(restored):
    assert set(restored) == {(f"g{k}", "content") for k in range(len(CHAINS))} | {("one", "title"), ("name", "content")}


def test_originals_come_back(restored):
    for k, c in enumerate(CHAINS):
        got = restored[f"g{k}", "content"].restored
        if c not in ("> ascii",):
            assert got == CLEAN[k % 3].replace(" ", " "), c
        else:
            assert difflib.SequenceMatcher(None, got, CLEAN[k % 3]).ratio() > 0.9
    assert restored["one", "title"].restored == "société" and restored["name", "content"].restored == "Zoé Brülé-Hêtier"


def test_large_tables_are_joined_instead(spark, restored):
    out = {(r.id, r.field): r.restored for r in encoding.find(corpus(spark), ["content", "title"], restore=True, most=0).collect()}
    assert out == {k: r.restored for k, r in restored.items()}


def test_final_loss(spark):
    df = spark.createDataFrame([("a", "Zq�xw dit non"), ("b", "tout va bien")], "id string, content string")
    (r,) = encoding.find(df, ["content"], restore=True).collect()
    assert (r.id, r.n_garbled, r.n_lost) == ("a", 1, 1)


def test_empty_and_long(spark):
    none = spark.createDataFrame([], "id string, content string, title string")
    assert encoding.find(none, ["content", "title"]).count() == 0
    long = spark.createDataFrame([("l", "été " * 100_000 + "Ã©" * 50_000), (None, "Ã©")], "id string, content string")
    assert {r.id for r in encoding.find(long, ["content"]).collect()} == {"l", None}


def test_every_clean_word_counts_once_seen_long_or_with_many_letters_to_lose(spark):
    many, long = "dégénérée-éméchée", "é".join("abcdefghij" * 25)
    rows = [(f"c{k}", f"la {many} et {long} reste") for k in range(3)] + [("one", "le mot Vôtré seul")]
    rows += [("part", f"la {many.replace('é', '?', 5)} va"), ("single", "le " + garble("Vôtré", "cp850 > cp1252") + " va"), ("long", "le " + garble(long, "utf-8 > cp1252") + " va"), ("plain", "le mot quoi?rien reste")]
    out = {r.id: r.restored for r in encoding.find(spark.createDataFrame(rows, "id string, content string"), ["content"], restore=True).collect()}
    assert out == {"part": f"la {many} va", "single": "le Vôtré va", "long": f"le {long} va"}
