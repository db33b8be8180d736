"""Lexical statistics and co-occurrence of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens


def words(text: Column) -> Column:
    """Alphabetic tokens in lower case."""
    return tokens(text, r"\p{L}+")


def statistics(df: DataFrame, key: str, text: Column) -> DataFrame:
    """Sentences, tokens, types, their ratio, entropy in bits, mean word and sentence length of every text with words."""
    base = df.select(key, words(text).alias("w"), F.greatest(F.lit(1), F.regexp_count(text, F.lit(r"[.!?]+"))).alias("num_sentences")).filter(F.size("w") > 0)
    n = F.size("w")
    # The words in order, and where in it another one begins: counts without comparing every word with every other.
    base = base.withColumn("o", F.sort_array("w"))
    base = base.withColumn("p", F.filter(F.sequence(F.lit(0), n), lambda i: (i == 0) | (i == n) | (F.get("o", i) != F.get("o", i - 1))))
    counts = F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.get("p", i) - F.get("p", i - 1))
    entropy = F.aggregate("c", F.lit(0.0), lambda s, k: s - k / n * F.log2(k / n))
    letters = F.aggregate("w", F.lit(0), lambda s, x: s + F.length(x))
    out = base.withColumn("c", counts)
    return out.select(
        key, F.col("num_sentences").cast("long").alias("num_sentences"), n.cast("long").alias("num_tokens"), F.size("c").cast("long").alias("num_types"), F.round(F.size("c") / n, 6).alias("ttr"),
        F.round(entropy, 4).alias("entropy"), F.round(letters / n, 6).alias("avg_word_length"), F.round(n / F.col("num_sentences"), 6).alias("avg_sent_length"),
    )


def window_cooccurrence(df: DataFrame, text: Column, stop: list[str], window: int = 4, least: int = 2) -> DataFrame:
    """Pairs of words at most ``window - 1`` apart, without pairs of equals, counted over all texts; shifted lists instead of a self-join."""
    stopped = F.array(*map(F.lit, stop)) if stop else F.array().cast("array<string>")
    base = df.select(F.filter(words(text), lambda x: ~F.array_contains(stopped, x)).alias("w"))
    pairs = F.flatten(F.array(*(F.when(F.size("w") > d, F.arrays_zip(F.slice("w", 1, F.size("w") - d).alias("a"), F.slice("w", d + 1, F.size("w")).alias("b"))).otherwise(F.array().cast("array<struct<a:string,b:string>>")) for d in range(1, window))))
    p = base.select(F.inline(pairs)).filter("a <> b")
    return p.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def cooccurrence_matrix(df: DataFrame, key: str, text: Column, min_df: int = 5) -> DataFrame:
    """Products of the counts of two words summed over documents (X'X without the diagonal), for words of ``min_df`` documents.

    A document's own words are paired inside its row, after the frequent words are known.
    """
    per = df.select(key, F.explode(words(text)).alias("w")).groupBy(key, "w").agg(F.count("*").alias("n"))
    kept = per.groupBy("w").agg(F.count("*").alias("df")).filter(F.col("df") >= min_df).select("w")
    lists = per.join(kept, "w").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("w", "n"))).alias("e"))
    pair = F.flatten(F.transform("e", lambda x, i: F.transform(F.slice("e", i + 2, F.size("e")), lambda y: F.struct(x["w"].alias("a"), y["w"].alias("b"), (x["n"] * y["n"]).alias("p")))))
    return lists.select(F.inline(pair)).groupBy("a", "b").agg(F.sum("p").alias("n"))


def top_words(df: DataFrame, key: str, text: Column, stop: list[str], k: int = 5) -> DataFrame:
    """The ``k`` most frequent words of each text, ties in order of first occurrence."""
    stopped = F.array(*map(F.lit, stop))
    base = df.select(key, F.posexplode(F.filter(words(text), lambda x: ~F.array_contains(stopped, x))).alias("pos", "w"))
    counted = base.groupBy(key, "w").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    w = Window.partitionBy(key).orderBy(F.desc("n"), "first")
    return counted.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(key, "w", "n", "rank")


def top_words_string(df: DataFrame, key: str, text: Column, stop: list[str], k: int = 5) -> DataFrame:
    """``key, top_words``: the ``k`` most frequent words of each text as ``word:n,...``."""
    top = top_words(df, key, text, stop, k).select(key, F.struct("rank", F.concat_ws(":", "w", F.col("n").cast("string")).alias("x")).alias("x"))
    return top.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["x"]), ",").alias("top_words"))


def tag_ratios(df: DataFrame, key: str, text: str, tagger, tags: tuple[str, ...] = ("NOUN", "VERB", "ADJ", "ADV")) -> DataFrame:
    """``key, lexical_density`` and the share of each tag among the words of every text.

    ``tagger`` takes a list of texts and returns for each the tags of its words; it runs in the tasks, on Arrow batches.
    A text without words has shares 0.
    """
    import pyarrow as pa

    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            tagged = [list(x) for x in tagger([x or "" for x in b.column(1).to_pylist()])]
            shares = [[x.count(t) / len(x) if x else 0.0 for t in tags] for x in tagged]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sum(x) for x in shares], pa.float64()), *(pa.array([x[i] for x in shares], pa.float64()) for i in range(len(tags)))], [key, "lexical_density", *(f"pos_{t}" for t in tags)])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, lexical_density double, " + ", ".join(f"pos_{t} double" for t in tags))
