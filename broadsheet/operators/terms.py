"""Whole-word term counts and their roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WORD, whole_word_count


def term_counts(df: DataFrame, terms: dict[str, list[str]], text: Column, *keep: str) -> DataFrame:
    """``<keep>, category, term, n`` for every term that occurs in a text, whatever the case.

    Terms of one word are looked up in the text's tokens, once per text whatever their number; phrases are counted by
    pattern. No shuffle: the terms are a parameter, and the last of equal terms gives the category.
    """
    of = {t.lower(): c for c, ts in terms.items() for t in ts}
    single = sorted(t for t in of if __import__("re").fullmatch(r"\w+", t))
    phrases = sorted(t for t in of if t not in set(single))
    tok = F.filter(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), lambda x: x.isin(*single)) if single else F.array().cast("array<string>")
    counted = df.select(*keep, tok.alias("_t"), *(whole_word_count(text, p).alias(f"_p{k}") for k, p in enumerate(phrases)))
    distinct = F.transform(F.array_distinct("_t"), lambda w: F.struct(w.alias("term"), F.size(F.filter("_t", lambda x: x == w)).cast("long").alias("n")))
    found = F.concat(distinct, *(F.filter(F.array(F.struct(F.lit(p).alias("term"), F.col(f"_p{k}").cast("long").alias("n"))), lambda s: s["n"] > 0) for k, p in enumerate(phrases)))
    category = F.element_at(F.create_map(*(F.lit(x) for kv in of.items() for x in kv)), F.col("term"))
    return counted.select(*keep, F.inline(found)).withColumn("category", category)
