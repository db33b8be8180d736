import random
import re
from itertools import combinations

import numpy as np
import pytest

from broadsheet.llm import neardup


def brute(rows, size, t):
    """Pairs linked directly or through others, by comparing all texts."""
    sets = {}
    for k, x in rows:
        if x and x.strip():
            w = re.findall(r"[^\W_]+", x.lower())
            sets[k] = frozenset(zip(*(w[i:] for i in range(size)))) or (" ".join(w) or x.strip())
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        same = x == y if isinstance(x, str) or isinstance(y, str) else len(x & y) >= t * len(x | y)
        if same:
            parent[root(b)] = root(a)
    return {(a, b) for a, b in combinations(sorted(sets), 2) if root(a) == root(b)}


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocab = [f"mot{k}" for k in range(400)]
    rows = []
    for g in range(n):
        base = [rng.choice(vocab) for _ in range(rng.randrange(30, 160))]
        for v in range(rng.choice([1, 1, 2, 3, 5])):
            x = list(base)
            for _ in range(rng.randrange(0, 5)):
                k = rng.randrange(len(x))
                x[k : k + rng.choice([0, 1])] = [rng.choice(vocab)] * rng.choice([0, 1, 2])
            if rng.random() < 0.3:
                cut = rng.randrange(len(x))
                x = x[cut:] + x[:cut]
            rows.append((f"d{g:03}_{v}", " ".join(x)))
    return rows


@pytest.mark.parametrize("size,t", [(3, 0.5), (5, 0.8)])
def test_groups_equal_brute_force(spark, size, t):
    rows = corpus(size)
    rows += [("e1", "bref"), ("e2", "Bref !"), ("e3", "autre"), ("s1", "??? !"), ("s2", "??? !"), ("n", None), ("b", "  "), ("d000_0", rows[0][1]), ("copy", rows[0][1])]
    df = spark.createDataFrame([(k, x, "key") for k, x in rows], "id string, content string, h string")
    got = {(r.id_a, r.id_b) for r in neardup.pairs(neardup.groups(df, size=size, threshold=t)).collect()}
    assert got == brute(dict(rows).items(), size, t)


def test_hot_families_are_split_and_starred(spark):
    rng = random.Random(1)
    base = [f"w{k}" for k in range(70)]
    rows = [(f"h{k:03}", " ".join([*base[:-1], f"v{rng.random()}"])) for k in range(150)] + corpus(9, 15)
    df = spark.createDataFrame(rows, "id string, content string")
    want = brute(rows, 3, 0.5)
    for hot, big in ((30, 10), (512, 20), (512, 1000)):
        g = neardup.groups(df, size=3, threshold=0.5, hot=hot, big=big)
        assert {(r.id_a, r.id_b) for r in neardup.pairs(g).collect()} == want


def test_traversal_prunes_nothing_similar():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 2**63, rng.integers(20, 90), dtype=np.uint64)) for _ in range(60)]
    sets += [np.unique(np.r_[s[3:], rng.integers(0, 2**63, 3, dtype=np.uint64)]) for s in sets]
    order = np.argsort([len(s) for s in sets], kind="stable")
    sets = [sets[k] for k in order]
    n = np.array([len(s) for s in sets])
    a, b = neardup.traverse(np.zeros(len(sets), int), n, np.stack([neardup.bitmap(s) for s in sets]), 0.5)
    left = set(zip(a.tolist(), b.tolist()))
    real = {(i, j) for i, j in combinations(range(len(sets)), 2) if len(np.intersect1d(sets[i], sets[j])) >= 0.5 * len(np.union1d(sets[i], sets[j]))}
    assert real <= left and len(left) < 0.5 * len(sets) * (len(sets) - 1) / 2 and len(real) >= 60


def test_empty_and_long(spark):
    assert neardup.groups(spark.createDataFrame([], "id string, content string")).count() == 0
    long = " ".join(f"m{k}" for k in range(60_000))
    df = spark.createDataFrame([("a", long), ("b", long + " fin"), (None, long), ("c", "tout autre chose que cela")], "id string, content string")
    assert {(r.id_a, r.id_b) for r in neardup.pairs(neardup.groups(df)).collect()} == {("a", "b")}


def test_boilerplate_does_not_pair_all_with_all(spark):
    rng = random.Random(4)
    boiler = " ".join(f"b{k}" for k in range(45))
    own = [" ".join(f"u{rng.randrange(10**6)}" for _ in range(60)) for _ in range(240)]
    rows = [(f"p{k:03}", f"{boiler} {x}") for k, x in enumerate(own)] + [(f"q{k:03}", f"{boiler} {x} suite {k}") for k, x in enumerate(own[:12])] + [(f"c{k}", f"{boiler} {own[20]}") for k in range(30)]
    df = spark.createDataFrame(rows, "id string, content string")
    got = neardup.groups(df, size=3, threshold=0.5, hot=20)
    assert {(r.id_a, r.id_b) for r in neardup.pairs(got).collect()} == brute(rows, 3, 0.5)
    table = neardup.signatures(df, "id", "content", 3, 48, 3)
    routes = neardup.rare_routes(table, table.select("h").distinct(), 0.5)
    assert routes.groupBy("route").count().agg({"count": "max"}).first()[0] < 20, "what is common to all is no route"
