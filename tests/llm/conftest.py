import pytest

WORDS = [("fr", w) for w in "le la les de du des un une et est a au en que qui dans pour par sur avec ne pas ce il elle sont ont".split()] + [("de", w) for w in "der die das und ist in den von mit zu".split()] + [("en", w) for w in "the a of and to in is for on".split()]


@pytest.fixture(scope="session")
def common(spark):
    return spark.createDataFrame([*WORDS, (None, None), ("fr", "le")], "lang string, word string")


@pytest.fixture(scope="session")
def prose():
    """Sentences with many nouns, enough for statistics of the language; the first twelve name fixed things."""
    import random

    rng = random.Random(11)
    nouns = ["".join(rng.choice(["ba", "ro", "ti", "ler", "man", "cou", "vil", "sen", "dor", "pla", "gri", "mur", "lan", "fo"]) for _ in range(3)) for _ in range(400)]
    forms = ["Le {} approuve la {} de la {} avec {}.", "La {} refuse le {} pour le {} et la {}.", "Une {} est dans le {} que la {} a pour {}.", "Il ne prépare pas le {} sur la {} en {} par {}.", "Elle achète un {} dans la {} avec le {} de {}."]
    fixed = ["Le conseil approuve le budget de la piscine avec prudence.", "La commune refuse le tunnel pour le conseil et la piscine.", "Une commune est dans le budget que la piscine a pour conseil."] * 4
    return fixed + [rng.choice(forms).format(*(rng.choice(nouns) for _ in range(4))) for _ in range(260)]
