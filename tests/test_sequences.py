"""Pairs that can reach a sequence ratio: none is lost, few others are compared, whatever the cells and parts."""

import difflib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from broadsheet.operators import dedup, sequences


def versions(rng, letters, size, n):
    """A text and versions of it, each with some runs of letters replaced, left out, put in or moved."""
    first = "".join(rng.choices(letters, range(len(letters), 0, -1), k=size))
    out = [first]
    for _ in range(n):
        t = rng.choice(out)
        for _ in range(rng.randint(0, max(1, size // 12))):
            k, w = rng.randint(0, len(t)), rng.randint(0, 5)
            t = t[:k] + "".join(rng.choices(letters, k=rng.randint(0, 4))) + t[k + w :]
        out.append(t or "a")
    return out


def reaching(texts, ratio):
    pairs = ((x, y, difflib.SequenceMatcher(None, texts[x], texts[y])) for y in range(len(texts)) for x in range(y))
    return {(x, y): s.ratio() for x, y, s in pairs if s.real_quick_ratio() >= ratio and s.quick_ratio() >= ratio and s.ratio() >= ratio}


@pytest.mark.parametrize("letters", ["ab", "abcdefgh ", "etaoinsrhldcumfpgwybvkxjqz éà’.", "🙂é\U0001f600x"])
def test_no_pair_is_lost(letters):
    rng = random.Random(7)
    texts = [t for size in (3, 4, 5, 9, 40, 150, 199, 230, 300, 600) for t in versions(rng, letters, size, 7)]
    day = np.array([rng.randint(0, 4) for _ in texts])
    for ratio in (0.7, 0.85, 0.95, 1.0):
        want = {(x, y) for x, y in reaching(texts, ratio) if abs(day[x] - day[y]) <= 3}
        got = [(int(x), int(y)) for xs, ys in sequences.candidates(texts, day, 3, ratio) for x, y in zip(xs, ys, strict=True)]
        assert len(got) == len(set(got)) and want <= set(got)
    a, b, r = sequences.similar(list(range(len(texts))), texts, day, day >= 0, 0 * day, 9, 0.85)
    assert dict(zip(zip(a, b, strict=True), r, strict=True)) == reaching(texts, 0.85)
    assert [len(x) for x in sequences.similar([], [], day[:0], day[:0] > 0, day[:0], 3, 0.85)] == [0, 0, 0]


def test_few_pairs_of_unlike_texts_are_compared():
    rng = random.Random(5)
    words = ["".join(rng.choices("esaitnrulodcpmévqfbghjàxèyêzwk", range(60, 0, -2), k=rng.randint(2, 9))) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=rng.randint(110, 140))) for _ in range(300)]
    texts.append(texts[0] + " fin")
    n = sum(len(x) for x, _ in sequences.candidates(texts, np.zeros(len(texts), int), 3, 0.85))
    assert 1 <= n < 0.02 * 300 * 299 / 2


@pytest.mark.parametrize("cell,most,most_texts", [(120_000, 8_000_000, 32_000), (1, 2_000, 32_000), (5_000, 8_000_000, 10), (10**9, 3_000, 8)])
def test_cells_and_parts_give_the_same_rows(spark, monkeypatch, cell, most, most_texts):
    for k, v in (("CELL", cell), ("MOST", most), ("MOST_TEXTS", most_texts)):
        monkeypatch.setattr(dedup, k, v)
    rng = random.Random(11)
    texts = [t for size in (20, 120, 260, 400) for t in versions(rng, "etaoinsrhl dcumfpg", size, 24)]
    rows = sorted((f"a{rng.randint(0, 10**6):06}", rng.choice([-5, -1, 0, 1, 2, 3, 4, 7, 9]), t.strip()) for t in sorted(set(texts)) if t.strip())
    df = spark.createDataFrame([*rows, (None, 1, rows[0][2] + " x"), ("n", None, rows[0][2]), ("v", 1, " ")], "id string, k int, content string").withColumn("d", F.date_add(F.lit("1990-01-01").cast("date"), F.col("k")))
    keys = [" ".join(t.split()) for _, _, t in rows]
    want = {(rows[x][0], rows[y][0]): q for (x, y), q in reaching(keys, 0.85).items() if abs(rows[x][1] - rows[y][1]) <= 3}
    got = [((r.id_a, r.id_b), r.ratio) for r in dedup.near_duplicates(df).collect()]
    assert len(got) == len(want) > 20 and dict(got) == want
    close = {p for p in want if dict((i, k) for i, k, _ in rows)[p[0]] == dict((i, k) for i, k, _ in rows)[p[1]]}
    assert {(r.id_a, r.id_b) for r in dedup.near_duplicates(df, days=0).collect()} == close
    number = df.withColumn("id", F.expr("try_cast(substring(id, 2) as int)"))
    assert {(r.id_a, r.id_b) for r in dedup.near_duplicates(number).collect()} == {(int(a[1:]), int(b[1:])) for a, b in want}


def test_links_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    pairs = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.9), ("x", "y", 1.0)], "id_a string, id_b string, ratio double").mapInArrow(count, "id_a string, id_b string, ratio double")
    copies = spark.createDataFrame([("z", "x"), ("x", "x")], "id string, rep string")
    assert {r.id: r.kept for r in dedup.merge_groups(pairs, copies).collect()} == dict.fromkeys("abc", "a") | dict.fromkeys("xyz", "x")
    assert seen.value == 3
