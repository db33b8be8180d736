import random

from broadsheet.llm import packing


def check(out, sizes, kinds):
    for kind, capacity in kinds.items():
        placed = {}
        for r in out:
            if r.container_kind == kind:
                assert r.capacity == capacity and r.used == sum(i.tokens for i in r["items"]) <= capacity
                for i in r["items"]:
                    placed.setdefault(i.doc_id, []).append((i.piece, i.tokens))
        assert {k: sum(t for _, t in v) for k, v in placed.items()} == {k: t for k, t in sizes if t}
        for k, t in sizes:
            if t and t <= capacity:
                assert len(placed[k]) == 1, "an item that fits is never cut"
            elif t:
                assert [x for _, x in sorted(placed[k])][:-1] == [capacity] * ((t - 1) // capacity)
    assert len({(r.container_kind, r.container_id) for r in out}) == len(out)


def test_every_item_is_placed_once(spark):
    rng = random.Random(3)
    sizes = [(k, rng.choice([0, 1, 3, 60, 64, 65, 200, rng.randrange(1, 64)])) for k in range(3000)]
    df = spark.createDataFrame(sizes, "doc_id long, n_tokens int").repartition(9)
    out = packing.pack(df, {"s": 64, "l": 150}, windows=8, fan_in=2).collect()
    check(out, sizes, {"s": 64, "l": 150})
    for kind, capacity in {"s": 64, "l": 150}.items():
        free = []  # first fit, the largest first: all items at hand at once
        for t in sorted((x for _, n in sizes for x in [capacity] * (n // capacity) + [n % capacity] if x), reverse=True):
            k = next((k for k, f in enumerate(free) if f >= t), None)
            free.append(capacity - t) if k is None else free.__setitem__(k, free[k] - t)
        assert sum(r.container_kind == kind for r in out) <= 1.05 * len(free)


def test_windows_best_fit_and_emission():
    w = packing.Windows(10, 2)
    assert w.put([("a", 0, 6)], 6) == [] and w.put([("b", 0, 7)], 7) == []
    assert w.put([("c", 0, 3)], 3) == [(10, [("b", 0, 7), ("c", 0, 3)])], "the container it fills best"
    assert w.put([("d", 0, 5)], 5) == []
    assert w.put([("e", 0, 8)], 8) == [(6, [("a", 0, 6)])], "the fullest goes when none fits"


def test_empty_and_odd(spark):
    none = spark.createDataFrame([], "doc_id long, n_tokens int")
    assert packing.pack(none, {"s": 8}).count() == 0
    named = spark.createDataFrame([("a", 5), ("b", 3), (None, 2)], "doc_id string, n_tokens int")
    assert sorted((i.doc_id or "") for r in packing.pack(named, {"s": 8}).collect() for i in r["items"]) == ["", "a", "b"]
    zeros = spark.createDataFrame([(1, 0), (2, None), (3, 4)], "doc_id long, n_tokens int")
    assert [r.used for r in packing.pack(zeros, {"s": 8, "none": 0}).collect()] == [4]


def test_documents(spark):
    docs = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (3, "Le conseil de la ville. " * 40, None), (4, "court", "k")], "doc_id long, text string, container_kind string")
    kinds = spark.createDataFrame([("court", 50), ("court", 50), (None, 3), ("vide", None)], "container_kind string, capacity_tokens int")
    out = packing.pack_documents(docs, kinds).collect()
    assert {r.container_kind for r in out} == {"court"} and {i.doc_id for r in out for i in r["items"]} == {3, 4}
