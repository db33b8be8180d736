"""Rules over single values: sentiment scores and classes, advertisements, noise, programmes, job offers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the reference's rules: words and channels looked for, as they are.
JOB_WORDS = (
    "offre d'emploi", "poste à pourvoir", "nous recrutons", "candidature", "cv et lettre", "recrutement", "recherche", "embauche", "postuler", "candidat",
    "expérience requise", "profil recherché", "cdi", "cdd", "temps plein", "temps partiel",
)
CHANNELS = (
    "tf1", "france 2", "france 3", "m6", "canal+", "c8", "tsr 1", "tsr2", "télévision suisse romande", "tv5", "tv5monde", "w9", "nrj12", "6ter", "rtl9",
    "france 5", "rts un", "rts deux", "fr3", "antenne 2",
)
AD_TITLES = "advertisement|advertisements|ad | ad|^ad$|ads | ads|^ads$|publicité|publicites|annonce|annonces"
TIMES = (r"[0-9]{1,2}[.:][0-9]{2}", r"[0-9]{1,2}h[0-9]{0,2}", r"[0-9]{1,2}[\s\p{Z}]*h[\s\p{Z}]*[0-9]{0,2}", r"[0-9]{1,2}[\s\p{Z}]*heures?[\s\p{Z}]*[0-9]{0,2}")
#: Signs that are neither letters, digits, white space nor usual punctuation.
SPECIAL = r"[^\p{L}\p{N}_\s\p{Z}.,;:!?()\-]"
NOISE = (SPECIAL + "{5,}", r"(?:\n[\s\p{Z}]*){5,}", "[.,;:!?]{5,}")

# Fixed values of the published valence scoring: what a word before does, by its distance, and the normalising constant.
BOOST, NEGATE, FADE, ALPHA = 0.293, -0.74, (1.0, 0.95, 0.9), 15.0
NEGATIONS = ("pas", "ne", "jamais", "rien", "aucun", "aucune", "sans", "ni", "guère", "not", "never", "no", "without", "nicht", "kein", "keine", "non", "senza")
BOOSTERS = ("très", "trop", "extrêmement", "vraiment", "fort", "si", "tout", "very", "really", "extremely", "sehr", "molto")
DAMPERS = ("peu", "presque", "assez", "plutôt", "légèrement", "slightly", "almost", "kaum", "poco")
#: A small lexicon, word to valence from -4 to 4; a real one is passed as a table.
VALENCES = {
    "bon": 1.9, "bonne": 1.9, "excellent": 2.7, "excellente": 2.7, "soutient": 1.2, "soutenu": 1.2, "approuve": 1.5, "satisfait": 2.0, "satisfaite": 2.0, "ravi": 2.6, "gagner": 2.0, "succès": 2.5, "espère": 1.4,
    "soulagé": 1.6, "optimiste": 1.8, "heureux": 2.5, "réussi": 2.0, "paix": 2.2, "good": 1.9, "great": 3.1, "gut": 1.9, "buono": 1.9,
    "panne": -1.6, "incendie": -2.0, "refuse": -1.3, "détruit": -2.6, "critique": -1.2, "perplexe": -1.0, "malades": -1.7, "dégâts": -2.0, "craignent": -1.8, "inquiet": -1.6, "inquiète": -1.6, "déçu": -1.8,
    "résigné": -1.2, "grève": -0.9, "accident": -2.1, "mort": -2.9, "guerre": -2.9, "crise": -2.0, "bad": -2.5, "schlecht": -2.4, "cattivo": -2.4,
}


def sentiment_category(score: Column) -> Column:
    return F.when(score.isNull(), "Unknown").when(score > 0.05, "Positif").when(score < -0.05, "Négatif").otherwise("Neutre")


def amplify(x: Column, low: int) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(1.0), x * 3))


def star_scores(star: Column, s: Column) -> list[Column]:
    """negative, neutral, positive and compound of a rating of one to five stars with its probability."""
    pick = lambda v: reduce(lambda c, kv: F.when(star == kv[0], s * kv[1]).otherwise(c), v.items(), F.lit(0.0))
    return [pick({1: 1.0, 2: 0.7}).alias("negative"), pick({2: 0.3, 3: 1.0, 4: 0.3}).alias("neutral"), pick({4: 0.7, 5: 1.0}).alias("positive"), pick({1: -1.0, 2: -0.5, 4: 0.5, 5: 1.0}).alias("compound")]


def lexicon_scores(words: Column, valences: dict[str, float] | None = None) -> list[Column]:
    """``negative, neutral, positive, compound`` of a list of words in lower case, by valences.

    Of the three words before one with a valence, each that intensifies adds to it, less the farther it is (dampers take
    away), and a negation turns it. ``compound`` is s / sqrt(s^2 + 15) of their sum; the shares count each word with its
    valence and one more, neutral ones as one.
    """
    v = valences or VALENCES
    of = F.create_map(*(F.lit(x) for kv in v.items() for x in kv))
    at = lambda i: F.try_element_at(of, F.get(words, i))

    def score(i: Column) -> Column:
        base = at(i)
        sign = F.when(base > 0, 1.0).otherwise(-1.0)
        before = [F.coalesce(F.when(i > d, F.get(words, i - d - 1)), F.lit("")) for d in range(3)]
        steps = sum((F.when(w.isin(*BOOSTERS), BOOST * f).when(w.isin(*DAMPERS), -BOOST * f).otherwise(0.0) for w, f in zip(before, FADE, strict=True)), F.lit(0.0))
        turned = before[0].isin(*NEGATIONS) | before[1].isin(*NEGATIONS) | before[2].isin(*NEGATIONS)
        return (base + sign * steps) * F.when(turned, NEGATE).otherwise(1.0)

    places = F.filter(F.sequence(F.lit(0), F.size(words)), lambda i: at(i).isNotNull())
    scores = F.transform(places, score)
    add = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda s, x: s + f(x))
    total = add(scores, lambda x: x)
    pos, neg = add(scores, lambda x: F.when(x > 0, x + 1).otherwise(0.0)), add(scores, lambda x: F.when(x < 0, 1 - x).otherwise(0.0))
    neutral = (F.size(words) - F.size(F.filter(scores, lambda x: x != 0))).cast("double")
    whole = pos + neg + neutral
    share = lambda x: F.round(F.when(whole > 0, x / whole).otherwise(0.0), 6)
    return [share(neg).alias("negative"), share(neutral).alias("neutral"), share(pos).alias("positive"), F.round(total / F.sqrt(total * total + ALPHA), 6).alias("compound")]


def is_ad(title: Column, pattern: str = AD_TITLES) -> Column:
    return F.lower(title).rlike(pattern)


def is_noise(c: Column, most: float = 0.15) -> Column:
    return reduce(lambda a, b: a | b, (c.rlike(p) for p in NOISE)) | (F.regexp_count(c, F.lit(SPECIAL)) / F.length(c) > most)


def title_and_text(title: Column, content: Column) -> Column:
    """What programmes and job offers are looked for in."""
    return F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(content, F.lit(""))))


def times(c: Column) -> Column:
    """The different times of day a text names, in four ways of writing."""
    return F.array_distinct(F.concat(*(F.regexp_extract_all(c, F.lit(p), F.lit(0)) for p in TIMES)))


def is_tv(title: Column, content: Column, channels: int = 1, least: int = 5) -> Column:
    c = title_and_text(title, content)
    return (reduce(lambda a, b: a + b, (F.contains(c, F.lit(w)).cast("int") for w in CHANNELS)) >= channels) & (F.size(times(c)) >= least)


def is_job(title: Column, content: Column, least: int = 3) -> Column:
    c = title_and_text(title, content)
    return reduce(lambda a, b: a + b, (F.contains(c, F.lit(w)).cast("int") for w in JOB_WORDS)) >= least


def classify(title: Column, content: Column, original: Column | None = None) -> Column:
    """ad, tv, job, noise or normal: the first that holds; ``original`` is looked at for noise where ``content`` is empty."""
    text = F.coalesce(F.nullif(content, F.lit("")), original) if original is not None else content
    return (
        F.when(F.coalesce(is_ad(title), F.lit(False)), "ad").when(is_tv(title, content), "tv").when(is_job(title, content), "job")
        .when(F.coalesce(is_noise(text), F.lit(False)), "noise").otherwise("normal")
    )


def features(c: Column) -> list[Column]:
    from .filters import words_in

    share = lambda p: F.round(F.regexp_count(c, F.lit(p)) / F.length(c), 6)
    return [F.length(c).cast("long").alias("n_chars"), words_in(c).cast("long").alias("n_words"), share(r"\p{Nd}").alias("digits"), share(r"\p{Lu}").alias("capitals")]
