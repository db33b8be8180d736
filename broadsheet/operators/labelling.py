"""Labels from outside: an injectable batch classifier (a service, a model) in the place the LLM calls have, and naming of topics.

Answers are keyed by the number printed before each text, so a text the service leaves out can't shift the others'.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ANSWER = re.compile(r"Texte\s+(\d+)\s*:\s*([A-ZÀ-Ý_]+)", re.I)


def prompt(texts: list[str], chars: int) -> str:
    """The numbered texts, each cut to ``chars``: what a service is asked is a feature of that service."""
    return "\n".join(f"Texte {k} : {t[:chars]}" for k, t in enumerate(texts, 1))


def parse_answers(answer: str, n: int, default: str) -> list[str]:
    """The label given to each number; ``default`` where none is."""
    given = {int(k): v.upper() for k, v in ANSWER.findall(answer or "")}
    return [given.get(k, default) for k in range(1, n + 1)]


def ask_with_retries(ask: Callable[[str], str], text: str, tries: int = 3, wait: float = 1.0) -> str:
    """Up to ``tries`` attempts with doubled waits; the last failure is raised, never returned as an answer."""
    for k in range(tries):
        try:
            return ask(text)
        except Exception:
            if k == tries - 1:
                raise
            time.sleep(wait * 2**k)
    raise AssertionError


def label_batches(df: DataFrame, ask: Callable[[str], str], key: str = "id", text: str = "text", batch: int = 10, chars: int = 1000, default: str = "NON", tries: int = 3, wait: float = 1.0) -> DataFrame:
    """``key, label`` of every non-empty text; ``ask`` runs in the tasks, a batch at a time."""
    kind = df.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for k in range(0, len(f), batch):
                part = f.iloc[k : k + batch]
                answer = ask_with_retries(ask, prompt(part["text"].tolist(), chars), tries, wait)
                yield pd.DataFrame({"key": part["key"], "label": parse_answers(answer, len(part), default)})

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("text <> ''")
    return rows.mapInPandas(run, f"key {kind}, label string").withColumnRenamed("key", key)


def parse_title(answer: str) -> tuple[str, str]:
    """Title and summary of an answer that marks them TITRE: and RÉSUMÉ:."""
    title = re.search(r"TITRE\s*:\s*(.+)", answer or "")
    summary = re.search(r"R[ÉE]SUM[ÉE]\s*:\s*(.+)", answer or "", re.S)
    return (title[1].strip() if title else "", summary[1].strip() if summary else "")


def topic_names(topic_words: DataFrame, n: int = 3) -> DataFrame:
    """``topic, name`` without a service: the topic's first words."""
    best = topic_words.filter(F.col("rank") <= n).groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("rank", "word"))).alias("w"))
    return best.select("topic", F.array_join(F.transform("w", lambda x: x["word"]), ", ").alias("name"))


def prepare_dataset(positive: DataFrame, negative: DataFrame, key: str = "id") -> DataFrame:
    """``id, text, word_count, label`` of two labelled sets; rows without text are left out."""
    from .filters import text_chain, words_in

    def one(df: DataFrame, label: int) -> DataFrame:
        cols = [c for c in ("content", "cleaned_text", "text", "original_content") if c in df.columns]
        t = df.select(F.col(key).alias("id"), text_chain(*cols).alias("text")).filter("text is not null")
        return t.select("id", "text", words_in(F.col("text")).cast("long").alias("word_count"), F.lit(label).alias("label"))

    return one(positive, 1).unionByName(one(negative, 0))


def apply_classifier(df: DataFrame, predict: Callable[[DataFrame], DataFrame], key: str = "id", text: str = "text", least_words: int = 80) -> DataFrame:
    """``key, class``: ``COURT`` under ``least_words`` words, else what ``predict`` (adds ``prediction``) says; no text, no row."""
    from .filters import words_in

    rows = df.filter(F.col(text) != "").withColumn("_short", words_in(F.col(text)) < least_words)
    short = rows.filter("_short").select(key, F.lit("COURT").alias("class"))
    long = predict(rows.filter("not _short")).select(key, F.when(F.col("prediction") == 1, "ML").otherwise("ARTICLE").alias("class"))
    return short.unionByName(long)
