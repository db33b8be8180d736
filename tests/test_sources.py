"""Readers of every layout, sinks, catalogue, configuration and streams."""

import json
import time

from pyspark.sql import functions as F

from broadsheet.catalog import Catalog, cache_key
from broadsheet.config import substitute
from broadsheet.sources import readers, sinks
from broadsheet.streaming import windows


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_json_and_texts(spark, tmp_path):
    p = put(tmp_path / "a.json", json.dumps([{"id": "1", "topics": ["a"], "word_count": 3}, {"title": "t"}]))
    assert [(r.id, r.topics, r.title) for r in readers.read_json(spark, p).collect()] == [("1", ["a"], None), (None, None, "t")]
    t = put(tmp_path / "t.txt", "un\n\n  \ndeux\r\ntrois")
    assert [(r.doc_id, r.text) for r in readers.read_texts(spark, t).collect()] == [("doc_0", "un"), ("doc_3", "deux"), ("doc_4", "trois")]
    c = put(tmp_path / "c.csv", "k,n\na,1.5\nb,x\n")
    assert [(r.k, r.n) for r in readers.read_csv(spark, c, ("n",)).collect()] == [("a", 1.5), ("b", 0.0)]


def test_term_files(spark, tmp_path):
    a, b = put(tmp_path / "a.json", '["x", "y"]'), put(tmp_path / "b.json", '{"c": ["x"], "d": []}')
    assert [(r.category, r.term) for r in readers.read_terms(spark, a).collect()] == [("default", "x"), ("default", "y")]
    assert [(r.category, r.term) for r in readers.read_terms(spark, b).collect()] == [("c", "x")]


def test_topic_layouts(spark, tmp_path):
    d = {"topic_distribution": [0.2, 0.8]}
    for k, (layout, ids) in enumerate([({"doc_topic_matrix": [{"doc_id": "a", **d}]}, ["a"]), ({"doc_topics": {"a": {**d, "dominant_topic": 1}}}, ["a"]), ([d, {"doc_id": "z", **d}], ["doc_0", "z"]), ([[0.2, 0.8]], ["doc_0"])]):
        rows = readers.read_doc_topics(spark, put(tmp_path / f"{k}.json", json.dumps(layout))).collect()
        assert [r.id for r in rows] == ids and all(r.topic_distribution == [0.2, 0.8] for r in rows)


def test_cluster_layouts(spark, tmp_path):
    layouts = [{"doc_ids": ["a", "b"], "labels": [0, 1]}, {"clusters": [{"id": 0, "articles": ["a"]}, {"id": 1, "articles": ["b"]}]}, {"0": ["a"], "1": ["b"]}, {"document_clusters": [{"id": "a", "cluster": 0}, {"id": "b", "cluster": 1}]}]
    for k, layout in enumerate(layouts):
        assert sorted((r.doc_id, r.cluster) for r in readers.read_clusters(spark, put(tmp_path / f"{k}.json", json.dumps(layout))).collect()) == [("a", 0), ("b", 1)], k
    assert readers.read_clusters(spark, put(tmp_path / "x.json", '{"doc_ids": ["a"], "labels": [0, 1]}')).count() == 0


def test_newest(spark, tmp_path):
    put(tmp_path / "r1.json", "1")
    time.sleep(1.1)
    put(tmp_path / "r2.json", "2")
    assert readers.newest(spark, f"{tmp_path}/r*.json").endswith("r2.json") and readers.newest(spark, f"{tmp_path}/q*") is None


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 3)], "id string, term string, n long")
    wide = {r.id: (r.x, r.y) for r in sinks.term_table(df, "id", ["x", "y"]).collect()}
    assert wide == {"a": (1, 2), "b": (3, None)}
    assert sinks.term_statistics(df).first() == (6, 2)
    sinks.write_parquet(df, f"{tmp_path}/p", "term")
    assert spark.read.parquet(f"{tmp_path}/p/term=x").count() == 2
    sinks.write_csv(df, f"{tmp_path}/c.csv")
    sinks.convert_to_parquet(spark, f"{tmp_path}/c.csv", f"{tmp_path}/q")
    assert spark.read.parquet(f"{tmp_path}/q").count() == 3


def test_catalog(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "cat"))
    assert c.analyses().count() == 0
    c.create_collection("one", "first")
    k = c.save(spark.range(3).toDF("x"), "terms", "T", "one", terms=["a"])
    d = c.save(spark.range(2).toDF("x"), "topics", "U")
    assert [r.id for r in c.analyses().collect()] == [d, k] and c.load(k).count() == 3
    assert [(r.name, r.n) for r in c.collections().collect()] == [("one", 1)] and c.export("one", str(tmp_path / "out")) == 1
    c.delete(d)
    assert [(r.kind, r.n) for r in c.available().collect()] == [("terms", 1)]
    assert cache_key("a", {"k": 1}) == cache_key("a", {"k": 1}) != cache_key("a", {"k": 2})


def test_config():
    assert substitute("x: ${A}, y: ${B}", {"A": "1"}) == "x: 1, y: ${B}"


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    rows = [(1, "2024-01-01 00:05:00", "a"), (2, "2024-01-01 00:50:00", "a"), (3, "2024-01-01 01:10:00", "b"), (4, "2024-01-01 09:00:00", "a")]
    df = spark.createDataFrame(rows, "event_id int, t string, event_type string").select("event_id", F.to_timestamp("t").alias("ts"), "event_type")
    df.write.parquet(str(src))
    stream = spark.readStream.schema(df.schema).parquet(str(src))
    q = windows.write_stream(windows.windowed_counts(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    got = {(r.start.hour, r.event_type): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(0, "a"): 2, (1, "b"): 1}, "the last window waits for its watermark"


def test_where_articles_come_from(spark, tmp_path):
    import json
    import os

    config = {"data": {"processed_dir": "data/processed", "files": {"articles": "all.json"}}}
    assert readers.base_source(config, {"main_source": "/x.json"}) == "/x.json" and readers.base_source(config, {}, "/r") == "/r/data/processed/all.json"
    put = lambda p, ids: (p.parent.mkdir(parents=True, exist_ok=True), p.write_text(json.dumps([{"id": i, "title": "t"} for i in ids])))
    root = str(tmp_path)
    ids = lambda **k: {r.id for r in readers.resolve_articles(spark, config, root=root, **k).collect()}
    assert ids() == set()
    put(tmp_path / "data/processed/articles.json", ["base"])
    assert ids() == {"base"}
    put(tmp_path / "data/results/sentiment_analysis/articles_with_sentiment_1.json", ["sentiment"])
    assert ids() == {"sentiment"}
    put(tmp_path / "data/results/entity_recognition/articles_with_entities_1.json", ["old"])
    put(tmp_path / "data/results/entity_recognition/articles_with_entities_0.json", ["new"])
    os.utime(tmp_path / "data/results/entity_recognition/articles_with_entities_1.json", (1, 1))
    assert ids() == {"new"}
    put(tmp_path / "s/articles_with_entities_9.json", ["sibling"])
    assert ids(results=str(tmp_path / "s/entity_summary_9.json")) == {"sibling"}
    put(tmp_path / "r.json", ["given"])
    assert ids(results=str(tmp_path / "r.json")) == {"given"}
    for name, at in (("doc_clusters_k5.json", 10), ("doc_clusters_k12_vaud.json", 30), ("doc_clusters_kx.json", 90), ("other_k3.json", 95)):
        put(tmp_path / "c" / name, [])
        os.utime(tmp_path / "c" / name, (at, at))
    assert readers.newest_clusters(spark, f"{root}/c").endswith("doc_clusters_k12_vaud.json") and readers.newest_clusters(spark, f"{root}/none") is None


def test_sidecar_graph_and_steps(spark, tmp_path):
    import json
    from xml.etree import ElementTree

    import pytest

    from broadsheet.catalog import StepCache

    s = spark.createDataFrame([("a", "1950s", "x", 0.5), ("a", "1950s", "y", 0.9), ("b", "1960s", "x", 0.1)], "term string, period string, word string, similarity double")
    sinks.write_similar_terms(s, f"{tmp_path}/similar.csv", {"model": "é", "n": 3})
    assert json.loads((tmp_path / "similar.meta.json").read_text()) == {"model": "é", "n": 3}
    assert {(r.term, r.word, r["rank"]) for r in readers.read_csv(spark, f"{tmp_path}/similar.csv").collect()} == {("a", "y", "1"), ("a", "x", "2"), ("b", "x", "1")}
    e = spark.createDataFrame([("é & <", "b", 2), ("b", "c", 1)], "a string, b string, weight int")
    sinks.write_gexf(e, f"{tmp_path}/g.gexf")
    tree = ElementTree.parse(tmp_path / "g.gexf")
    assert {n.get("label") for n in tree.iter("{http://www.gexf.net/1.2draft}node")} == {"é & <", "b", "c"} and len(list(tree.iter("{http://www.gexf.net/1.2draft}edge"))) == 2
    with pytest.raises(ValueError):
        sinks.write_gexf(e, f"{tmp_path}/h.gexf", most=1)
    made = []
    cache = StepCache(spark, f"{tmp_path}/cache")
    make = lambda: made.append(1) or s
    for settings in ({"pos": ["NOUN"]}, {"pos": ["NOUN"]}, {"pos": ["VERB"]}):
        assert cache.get("articles.json", settings, 3, "t0", make).count() == 3
    assert len(made) == 2 and cache.inventory().count() == 2 and all(v > 0 for v in cache.sizes().values())


def test_no_local_tables_on_a_cluster(monkeypatch):
    import types

    import pytest

    from broadsheet import session

    far = types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda k, d=None: d), sparkContext=types.SimpleNamespace(applicationId="app-x", master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        session.shared_dir(far)


def test_tables_can_be_cleared(spark):
    import os

    from broadsheet import session

    assert session.materialize(spark.range(3).toDF("n"), "small").count() == 3
    folder = session.working_dir(spark).removeprefix("file://")
    assert os.path.isdir(folder)
    session.clear(spark)
    assert not os.path.exists(folder)
