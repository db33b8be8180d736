"""Keyword-stuffed pages, link lists and product tags (problem 8).

Method: every document is read in blocks, runs of sentences or of what is none. What a block says (its words without
function words; addresses and tags stand as one sign each) is compressed by an adaptive word model: a new word costs its
spelling, a word seen before what its share so far makes it cost. This is the length that an ideal coder with a growing
dictionary reaches, without the headers that make real ones useless on short blocks. The ratio is compared with that of
prose blocks of the same language and length: a line is fitted, by language, to the logarithms of ratio and length over
all prose blocks of the corpus, robustly, so that spam among them doesn't move it. A block that lies more than ``far``
deviations above its line is extremely redundant; no block counts without that. Few sentence ends, function words and
figures confirm it, or, whatever its form, one keyword that takes too many of its words. A document is spam when more than
half of its characters lie in such blocks.

A sentence that returns word for word counts once, so refrains aren't redundant. The lines are fitted to shares of the
corpus alone: a table repeated ten times gives the same verdicts.

Defined results: null, empty and blank texts and texts without words are no spam; every row is judged on its own, so exact
copies fare alike; texts are read whole; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .prose import is_prose, sentences
from .quality import common_words

ADDRESS = re.compile(r"(?:https?:)?//[^\s\]\)>]+|\bwww\.[^\s\]\)>]+|\b[\w-]+(?:\.[\w-]+)*\.[a-z]{2,}(?:/[^\s\]\)>]*)?(?![\w.])")
TAG = re.compile(r"(?<!\S)[#+@][^\W\d_][\w-]*")
TOKEN = re.compile(r"[^\W\d_]{2,}|\d+")
#: Without any of these a block has no address; most prose has none.
DOTTED = re.compile(r"//|\.[\w-]")
#: Characters of a block: long enough to compress, short enough to find spam beside prose.
BLOCK = 1200
#: What a new word costs (bits of its spelling), and how ready the model is for new words.
SPELLING, FRESH = 40.0, 8.0
#: Share of all prose blocks that every language's line takes in besides its own.
POOLED = 0.002
#: One keyword takes too many of a block's words.
KEYWORD = "keyword >= 0.10 + 2.5 / greatest(units, 1)"
SCHEMA = "lang string, prose boolean, chars int, units int, ratio double, ends double, common double, figures double, links double, keyword double"


def compression(counts: Counter) -> float:
    """Bits of the words' spellings over bits under the adaptive word model; the order of the words plays no part."""
    n = sum(counts.values())
    if not n:
        return 1.0
    again = lgamma(FRESH + n) - lgamma(FRESH) - len(counts) * log(FRESH) - sum(lgamma(c) for c in counts.values() if c > 2)
    return SPELLING * n / (SPELLING * len(counts) + again / log(2))


def blocks(text: str, common: frozenset[str]) -> list[tuple[int, int, bool, list[str]]]:
    """``(start, end, made of sentences, its sentences)`` of the text's blocks in order."""
    out: list[tuple[int, int, bool, list[str]]] = []
    start, kind, end, held = 0, None, 0, []
    for b, e, ended in sentences(text):
        s = text[b:e]
        prose = is_prose(s, common, ended)
        if kind is not None and (prose != kind or e - start > BLOCK):
            out.append((start, end, kind, held))
            start, held = end, []
        kind, end = prose, e
        held.append(s.strip())
        while not prose and end - start > 2 * BLOCK:
            cut = max(text.rfind("\n", start, start + BLOCK), text.rfind(" ", start, start + BLOCK))
            cut = cut if cut > start else start + BLOCK
            out.append((start, cut, False, []))
            start = cut
    if kind is not None and end > start:
        out.append((start, end, kind, held))
    return out


def measure(text: str, common: frozenset[str], langs: dict[str, frozenset[str]]) -> list[tuple]:
    """A row of figures for each block."""
    out, seen = [], set()
    for start, end, prose, held in blocks(text, common):
        body = block = text[start:end]
        if prose:
            body = " ".join(s for s in dict.fromkeys(held) if s not in seen)
            seen.update(held)
        rest, n_address = ADDRESS.subn(" ", body) if DOTTED.search(body) else (body, 0)
        rest, n_tag = TAG.subn(" ", rest) if "#" in rest or "+" in rest or "@" in rest else (rest, 0)
        counts = Counter(TOKEN.findall(rest.lower()))
        n_figures = sum(counts.pop(w) for w in [w for w in counts if w[0].isdecimal()])
        usual_words = {w: counts.pop(w) for w in common.intersection(counts)}
        n, n_common = sum(counts.values()), sum(usual_words.values())
        keyword = max(counts.values(), default=0) / max(1, n)
        units = max(1, n + n_common + n_address + n_tag)
        if not prose:  # beside sentences an address is a reference
            counts.update({k: v for k, v in (("//", n_address), ("#", n_tag)) if v > 1})
        by = {k: sum(c for w, c in usual_words.items() if w in v) for k, v in langs.items()} if usual_words else {}
        ends = block.count(". ") + block.count("! ") + block.count("? ") + (block.rstrip()[-1:] in ".!?»”")
        out.append((max(sorted(by), key=by.get) if by else "", prose, end - start, sum(counts.values()), compression(counts), ends / units, n_common / units, n_figures / units, (n_address + n_tag) / units, keyword))
    return out


def block_figures(docs: DataFrame, words: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    langs = common_words(words)
    common = frozenset().union(*langs.values()) if langs else frozenset()
    kind = docs.schema[key].dataType.simpleString()
    names = ["key", "row", *(x.split()[0] for x in SCHEMA.split(", "))]
    types = [pa.string(), pa.bool_(), pa.int32(), pa.int32(), *[pa.float64()] * 6]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, ids, rows = [], [], []
            for k, r, x in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                for row in measure(x, common, langs):
                    keys.append(k)
                    ids.append(r)
                    rows.append(row)
            c = list(zip(*rows, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(0).type), pa.array(ids, pa.int64()), *(pa.array(x, t) for x, t in zip(c, types, strict=True))], names)

    return docs.select(F.col(f"`{key}`").alias("key"), F.monotonically_increasing_id().alias("row"), F.col(f"`{text}`").alias("text")).filter("trim(text) <> ''").mapInArrow(run, f"key {kind}, row long, {SCHEMA}")


def _median(x: np.ndarray, w: np.ndarray) -> float:
    order = np.argsort(x, kind="stable")
    c = np.cumsum(w[order])
    return float(x[order][np.searchsorted(c, c[-1] / 2)])


def line(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float, float]:
    """Slope, height and spread of ``y`` over ``x`` with weights ``w``: through the medians at each length first, then by what lies near."""
    at, of = np.unique(np.round(x * 2), return_inverse=True)
    mid = np.array([_median(y[of == k], w[of == k]) for k in range(len(at))])
    heavy = np.array([w[of == k].sum() for k in range(len(at))])
    slope, height = np.polyfit(at / 2, mid, 1, w=np.sqrt(heavy)) if len(at) > 1 else (0.0, float(mid[0]))
    spread = 0.0
    for _ in range(4):
        off = y - slope * x - height
        m = _median(off, w)
        spread = max(0.05, 1.4826 * _median(np.abs(off - m), w))
        near = np.abs(off - m) <= 3 * spread
        if len(np.unique(x[near])) < 2:
            return float(slope), float(height + m), spread
        slope, height = np.polyfit(x[near], y[near], 1, w=np.sqrt(w[near]))
    return float(slope), float(height), spread


def usual(figures: DataFrame) -> dict[str, tuple[float, float, float]]:
    """The line of each language's prose blocks, ``""`` for all together.

    Blocks with one keyword throughout don't enter: where spam has a length of its own it would be measured against itself.
    From a table of how many blocks have which language, length and ratio (in hundredths of its logarithm): its size is
    bounded by the length of a block, some thousands of rows whatever the corpus.
    """
    got = figures.filter(f"prose and units >= 8 and not ({KEYWORD})").groupBy("lang", F.log2("units").alias("x"), F.expr("round(log2(ratio), 2)").alias("y")).count().toPandas()
    if not len(got):
        return {"": (0.0, 0.0, 0.08)}
    x, y, n = (got[c].to_numpy(float) for c in ("x", "y", "count"))
    return {k: line(x, y, n * (POOLED if k else 1.0) + np.where(got["lang"] == k, n, 0.0)) for k in sorted({"", *got["lang"]})}


def judge(docs: DataFrame, words: DataFrame, key: str = "doc_id", text: str = "text", far: float = 3.0) -> DataFrame:
    """``key``, ``spam_share`` of the characters, ``redundancy`` of the worst block (in deviations) and ``is_spam``, for every non-blank text."""
    b = materialize(block_figures(docs, words, key, text), "blocks")
    lines = usual(b)
    of = F.create_map(*(v for k, p in lines.items() for v in (F.lit(k), F.array(*map(F.lit, p)))))
    p = F.coalesce(F.element_at(of, F.col("lang")), F.array(*map(F.lit, lines[""])))
    b = b.withColumn("redundancy", (F.log2("ratio") - p[0] * F.log2(F.greatest(F.lit(8), "units")) - p[1]) / p[2])
    listed = F.expr("not prose and ends < 0.4 and common < 0.25 and figures < 0.4")
    stuffed = F.expr(f"figures < 0.12 and {KEYWORD}")
    bad = (F.col("redundancy") > far) & (F.col("units") >= 6) & (listed | stuffed)
    out = b.groupBy("row").agg(F.first("key").alias(key), (F.sum(F.when(bad, F.col("chars")).otherwise(0)) / F.sum("chars")).alias("spam_share"), F.max("redundancy").alias("redundancy"))
    return out.select(key, "spam_share", "redundancy", (F.col("spam_share") > 0.5).alias("is_spam"))
