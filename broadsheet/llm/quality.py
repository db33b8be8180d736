"""Per-document text quality statistics and a verdict prose / not prose (problem 1).

Method: for every language the robust centre and covariance of the statistics are estimated from all its documents:
medians and MADs first, then, twice reweighted, mean and covariance of what lies near the centre in all statistics
together. Prose being the bulk of every language, they are prose's; nothing but the distance itself selects it. A
document's squared Mahalanobis distance from its language's prose, and what each statistic contributes to it, say how far
it is from prose and why. The distance alone decides: a document beyond ``limit`` is not prose.

Statistics: ``word_count`` (runs of letters), ``mean_word_length``, ``symbol_ratio`` (of the solid characters, those that
are neither letters nor digits), ``line_end_ratio`` (of the non-blank lines, those that end in punctuation),
``common_ratio`` (of the words, those in the list of common words), ``sentence_ratio`` (of the characters, those inside
sentences).

Defined results: null and blank texts have no row; rows that are equal in id and statistics are one row; texts are read
whole; a text without words has ratios 0; ``lang`` is that of most of its common words, null unless it has two different
ones of two letters or more (figures and single letters have no language), and such a document is measured against all
documents' prose together; a language with next to no documents shares that model; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .prose import WORD, is_prose, sentences

STATS = ("word_count", "mean_word_length", "symbol_ratio", "line_end_ratio", "common_ratio", "sentence_ratio")
ENDS = frozenset(".!?…:;»”\"")
DIGITS = "0123456789"
#: Least spread of a statistic (word_count as a logarithm): what differs less than this doesn't count as far.
FLOOR = (0.25, 0.25, 0.01, 0.10, 0.03, 0.05)
#: 99.9 % point of chi-square with 6 degrees of freedom: what lies nearer counts for the centre and the covariance.
NEAR = 22.46
#: Not prose beyond this squared distance, 13 deviations: prose with scan noise, figures or wrong encoding has longer tails than
#: a normal distribution; on a table of 118,303 articles it reaches 164, and lists and tables begin at 200.
LIMIT = 170.0
#: Share of all documents' prose that every language's model takes in besides its own.
POOLED = 0.002


def measure(text: str, common: frozenset[str], langs: dict[str, frozenset[str]]) -> tuple:
    """The statistics of one text, and its language."""
    words = WORD.findall(text.lower())
    n, letters = len(words), sum(map(len, words))
    solid = len("".join(text.split()))
    digits = sum(map(text.count, DIGITS))
    lines = [x[-1] for x in map(str.rstrip, text.splitlines()) if x]
    usual = {w: c for w, c in Counter(words).items() if w in common}
    hits = sum(usual.values())
    by = {k: [c for w, c in usual.items() if w in v and len(w) > 1] for k, v in langs.items()} if hits else {}
    lang = max(sorted(by), key=lambda k: sum(by[k])) if by else None
    lang = lang if lang is not None and len(by[lang]) >= 2 else None
    inside = sum(e - b for b, e, ended in sentences(text) if is_prose(text[b:e], common, ended))
    return (n, letters / n if n else 0.0, max(0, solid - letters - digits) / solid if solid else 0.0, sum(map(ENDS.__contains__, lines)) / len(lines) if lines else 0.0, hits / n if n else 0.0, inside / len(text), lang)


def common_words(words: DataFrame) -> dict[str, frozenset[str]]:
    """The table of common words, a dimension of a few hundred rows, by language."""
    out: dict[str, set[str]] = {}
    for r in words.select("lang", "word").filter("word is not null").distinct().collect():
        out.setdefault(r[0] or "", set()).add(r[1].lower())
    return {k: frozenset(v) for k, v in out.items()}


def statistics(docs: DataFrame, words: DataFrame, key: str = "id", text: str = "content") -> DataFrame:
    """``key``, the six statistics and ``lang`` of every non-blank text; no shuffle but for the repeated rows."""
    langs = common_words(words)
    common = frozenset().union(*langs.values()) if langs else frozenset()
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, rows = [], []
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if x and not x.isspace():
                    keys.append(k)
                    rows.append(measure(x, common, langs))
            c = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(0).type), pa.array(c[0], pa.int32()), *(pa.array(x, pa.float64()) for x in c[1:6]), pa.array(c[6], pa.string())], ["key", *STATS, "lang"])

    out = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).filter("text is not null").mapInArrow(run, f"key {kind}, word_count int, " + ", ".join(f"{s} double" for s in STATS[1:]) + ", lang string")
    return out.distinct().withColumnRenamed("key", key)


def _vector(s: str) -> Column:
    return F.log1p(F.col(s).cast("double")) if s == "word_count" else F.col(s)


def _by_lang(spark, values: dict[str, np.ndarray], name: str) -> DataFrame:
    """A row for each language (a handful) with the numbers ``name0``, ``name1``, ...; joined by broadcast."""
    n = len(next(iter(values.values())))
    return spark.createDataFrame([(k, *map(float, v)) for k, v in values.items()], "lang string, " + ", ".join(f"{name}{i} double" for i in range(n)))


def prose_model(stats: DataFrame, near: float = 4.0, rounds: int = 2) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Robust mean and covariance by language, ``*`` for all together; ``3 + rounds`` aggregations over all documents.

    Nothing is preselected: medians and MADs hold out against what isn't prose up to half of a language's documents.
    """
    spark, every = stats.sparkSession, range(6)
    v = stats.select("lang", *(_vector(s).alias(f"v{i}") for i, s in enumerate(STATS)))
    v = v.filter("lang is not null").unionByName(v.withColumn("lang", F.lit("*")))
    mid = {r["lang"]: np.array([r[f"m{i}"] for i in every]) for r in v.groupBy("lang").agg(*(F.percentile_approx(f"v{i}", 0.5, 1000).alias(f"m{i}") for i in every)).collect()}
    if not mid:
        return {}
    off = v.join(F.broadcast(_by_lang(spark, mid, "m")), "lang").select("lang", *((F.col(f"v{i}") - F.col(f"m{i}")).alias(f"o{i}") for i in every))
    mad = off.groupBy("lang").agg(*(F.percentile_approx(F.abs(f"o{i}"), 0.5, 1000).alias(f"o{i}") for i in every))
    scale = {r["lang"]: near * np.maximum(1.4826 * np.array([r[f"o{i}"] for i in every]), FLOOR) for r in mad.collect()}
    pairs = [(i, j) for i in every for j in range(i, 6)]

    def moments(kept: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """Mean and covariance of each language's rows, with their share of all rows' mixed in."""
        got = {}
        for r in kept.groupBy("lang").agg(F.count("*").alias("n"), *(F.avg(f"o{i}").alias(f"a{i}") for i in every), *(F.avg(F.col(f"o{i}") * F.col(f"o{j}")).alias(f"p{i}{j}") for i, j in pairs)).collect():
            a, c = np.array([r[f"a{i}"] for i in every]), np.zeros((6, 6))
            for i, j in pairs:
                c[i, j] = c[j, i] = r[f"p{i}{j}"] - a[i] * a[j]
            got[r["lang"]] = r["n"], mid[r["lang"]] + a, c
        out, pool = {}, got.get("*", (1, mid["*"], np.zeros((6, 6))))
        for k in mid:
            n, m, c = got.get(k, (0, pool[1], pool[2]))
            w = POOLED * pool[0] / (n + POOLED * pool[0])
            d = pool[1] - m
            out[k] = m + w * d, (1 - w) * c + w * pool[2] + w * (1 - w) * np.outer(d, d) + np.diag(np.square(FLOOR))
        return out

    kept = off.join(F.broadcast(_by_lang(spark, scale, "s")), "lang")
    for i in every:
        kept = kept.filter(F.abs(f"o{i}") <= F.col(f"s{i}"))
    model = moments(kept)
    for _ in range(rounds):
        flat = {k: np.concatenate([m - mid[k], np.linalg.inv(c).ravel()]) for k, (m, c) in model.items()}
        z = [F.col(f"o{i}") - F.col(f"q{i}") for i in every]
        far = sum((z[i] * z[j] * F.col(f"q{6 + 6 * i + j}") for i in every for j in every), F.lit(0.0))
        model = moments(off.join(F.broadcast(_by_lang(spark, flat, "q")), "lang").filter(far <= NEAR))
    return model


def assess(docs: DataFrame, words: DataFrame, key: str = "id", text: str = "content", limit: float = LIMIT) -> DataFrame:
    """Statistics, ``distance`` (squared), ``from_<statistic>`` (its part of the distance) and ``verdict`` of every non-blank text."""
    stats = materialize(statistics(docs, words, key, text), "quality")
    model = prose_model(stats)
    if "*" not in model:
        model["*"] = np.array([5.0, 5.0, 0.05, 0.8, 0.4, 1.0]), np.diag(np.square(FLOOR))
    flat = {k: np.concatenate([m, np.linalg.inv(c).ravel()]) for k, (m, c) in model.items()}
    known = F.when(F.col("lang").isin(*flat), F.col("lang")).otherwise(F.lit("*"))
    params = _by_lang(stats.sparkSession, flat, "p").withColumnRenamed("lang", "_group")
    z = [_vector(s) - F.col(f"p{i}") for i, s in enumerate(STATS)]
    joined = stats.withColumn("_group", known).join(F.broadcast(params), "_group")
    part = [z[i] * sum((z[j] * F.col(f"p{6 + 6 * i + j}") for j in range(6)), F.lit(0.0)) for i in range(6)]
    out = joined.select(*stats.columns, *(p.alias(f"from_{s}") for p, s in zip(part, STATS, strict=True)))
    out = out.withColumn("distance", sum((F.col(f"from_{s}") for s in STATS), F.lit(0.0)))
    return out.withColumn("verdict", F.when(F.col("distance") > limit, F.lit("not prose")).otherwise(F.lit("prose")))
