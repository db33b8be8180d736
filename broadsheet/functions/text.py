"""Scalar text functions as Columns: they stay in the JVM and inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[\p{L}\p{N}_]+"
ACCENTED = "àâäáãåçéèêëíìîïñóòôöõúùûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def non_empty(c: Column) -> Column:
    """Null for what is empty, so that coalesce falls through as the truthiness chains do."""
    return F.when(c != "", c)


def strip_special(c: Column) -> Column:
    return F.regexp_replace(c, r"""[^a-zA-Z0-9\s.,!?;:\-'"]""", " ")


def fix_ocr(c: Column) -> Column:
    """Ordered letter repairs: a lone 0 and 1, then vv and rn."""
    for seen, meant in ((r"\b0\b", "O"), (r"\b1\b", "I"), ("vv", "w"), ("rn", "m")):
        c = F.regexp_replace(c, seen, meant)
    return c


def tokens(c: Column, pattern: str = WORD) -> Column:
    """Words in order; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def filter_tokens(t: Column, stop: list[str], least: int = 3) -> Column:
    """Tokens of at least ``least`` letters that are no stop words; repeated ones stay."""
    words = F.array(*map(F.lit, sorted(stop)))
    return F.filter(t, lambda x: (F.length(x) >= least) & ~F.array_contains(words, x))


def clean_text(c: Column, stop: list[str]) -> Column:
    return F.array_join(filter_tokens(tokens(strip_special(fix_ocr(c)), "[a-z0-9]+"), stop), " ")


def normalize_ws(c: Column) -> Column:
    """Lower case, runs of white space as one blank, trimmed; empty for null."""
    return F.coalesce(F.trim(F.regexp_replace(F.lower(c), r"[ \t\r\n]+", " ")), F.lit(""))


def content_hash(c: Column, chars: int = 1000) -> Column:
    """Digest of the normalised beginning, a feature of this hash; empty for empty."""
    n = F.substring(normalize_ws(c), 1, chars)
    return F.when(n == "", "").otherwise(F.md5(n))


def is_redundant(term: Column, other: Column, threshold: float = 0.7) -> Column:
    """One contains the other (also without blanks and hyphens), or they agree position by position in more than ``threshold``."""
    a, b = F.lower(term), F.lower(other)
    x, y = (F.regexp_replace(v, "[ -]", "") for v in (a, b))
    n, m = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    same = F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), F.lit(0), lambda s, i: s + F.when(F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1)), 1).otherwise(0))
    return F.contains(a, b) | F.contains(b, a) | F.contains(x, y) | F.contains(y, x) | (same / m > threshold)


def excerpt(c: Column, term: str, around: int = 100, fallback: int = 300) -> Column:
    """The first match with what stands around it, matches marked; the beginning if there is none."""
    at = F.locate(term.lower(), F.lower(c))
    start = F.greatest(F.lit(1), at - around)
    stop = F.least(F.length(c) + 1, at + len(term) + around)
    cut = F.concat(F.when(start > 1, "...").otherwise(""), F.substr(c, start, stop - start), F.when(stop <= F.length(c), "...").otherwise(""))
    import re

    marked = F.regexp_replace(cut, f"(?iu)({re.escape(term)})", "**$1**")
    return F.when(at > 0, marked).otherwise(F.concat(F.substring(c, 1, fallback), F.when(F.length(c) > fallback, "...").otherwise("")))


def highlight(c: Column, terms: list[str]) -> Column:
    import re

    alt = "|".join(re.escape(t) for t in sorted(terms, key=len, reverse=True))
    return F.regexp_replace(c, rf"(?iu)(?<![\p{{L}}\p{{N}}_])({alt})(?![\p{{L}}\p{{N}}_])", "<mark>$1</mark>")


def journal_base_name(c: Column) -> Column:
    """The name without a trailing issue number."""
    return F.regexp_replace(c, r"\s+\d+\.?$", "")


def clean_journal_name(c: Column) -> Column:
    """Without issue number and final dots, trimmed; ``inconnu`` for none."""
    return F.coalesce(non_empty(F.trim(F.regexp_replace(F.regexp_replace(c, r"\s+\d+\.?\s*$", ""), r"\.+$", ""))), F.lit("inconnu"))


def accent_fold(c: Column) -> Column:
    return F.translate(F.lower(c), ACCENTED, PLAIN)


def truncate(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def percent(x: Column) -> Column:
    """A share as a percentage with two decimals, halves rounded up in decimal arithmetic."""
    return F.concat(F.round((x * 100).cast("decimal(20,6)"), 2).cast("string"), F.lit("%"))


def id_part(c: Column, n: int) -> Column:
    """The n-th part (from 1) of an id cut at ``_``; null if it has fewer."""
    return F.try_element_at(F.split(c, "_"), F.lit(n))


def journal_from_id(c: Column) -> Column:
    return id_part(c, 3)


def year_from_id(c: Column) -> Column:
    a = non_empty(F.regexp_extract(c, r"(\d{4})-\d{2}-\d{2}", 1))
    return F.coalesce(a, non_empty(F.regexp_extract(c, r"_(\d{4})_", 1))).try_cast("int")


def normalize_article_id(c: Column) -> Column:
    return F.split(F.regexp_replace(c, "^article_", ""), "_mistral")[0]


def whole_word_count(c: Column, term: str) -> Column:
    """Occurrences of a term with no letter, digit or underscore beside it, whatever the case."""
    import re

    return F.regexp_count(c, F.lit(rf"(?iu)(?<![\p{{L}}\p{{N}}_]){re.escape(term)}(?![\p{{L}}\p{{N}}_])"))


@F.pandas_udf(T.StringType())
def nfkd(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Unicode compatibility decomposition, for which Spark has no function."""
    import unicodedata

    for s in batches:
        yield s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x))


@F.pandas_udf(T.DoubleType())
def seq_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two texts, as difflib has it; no built-in equals it."""
    import difflib

    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")
