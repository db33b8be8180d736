import random
from array import array

import pytest

from broadsheet.llm import tokens

ODD = ["", " ", "a", "l’été à Noël, déjà vu !", "１２３ ½ Ⅷ ②", "日本語のテキスト", "🙂🖥️ emoji", "a\x1cb\x1dc \x85 x", "don't we've I'll 'd", "   lead  and   trail   ", "x" * 5000, "é" * 700 + " fin", "​​zero", "العربية نص", "un_deux__trois", "\n\n\n\t\t x", "é combining", "<|endoftext|> as text"]


@pytest.fixture(scope="module")
def enc():
    return tokens.encoder()


def ids(enc, text):
    return array("i", enc.encode(text)).tolist()


def test_ids_are_the_librarys(enc):
    rng = random.Random(5)
    alphabet = "abcéè ’'.,12½ⅧßΩж中🙂\n\t _-\x1f　"
    for t in ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(400)]:
        assert ids(enc, t) == enc.enc.encode_ordinary(t), repr(t[:50])


def test_decoding_is_exact(enc):
    for t in ODD:
        assert enc.decode(ids(enc, t)) == t


@pytest.mark.parametrize("chunk,overlap", [(7, 3), (40, 12), (200, 50)])
def test_stitching_equals_whole(enc, chunk, overlap):
    rng = random.Random(chunk)
    texts = ["".join(rng.choice("abc é1’ \n") for _ in range(900)) for _ in range(30)] + ["a" * 900, " " * 500 + "x", "ab " * 300, "1" * 450 + "'re" * 100]
    for t in texts:
        chunks = [(k, t[k : k + chunk + overlap]) for k in range(0, len(t), chunk)]
        assert "".join(tokens.stitch(enc, chunks)) == t
        assert tokens.stitch(enc, chunks) == enc.pieces(t)


def test_rows(spark, enc):
    long = "Le conseil approuve le budget. " * 3000
    rows = [(1, None, "x"), (2, "", "x"), (3, " ", None), (4, long, "y"), (5, "Été", "y"), (5, "Été", "y"), (None, "z", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string")
    out = tokens.encode(df, chunk_chars=1000, overlap=60)
    assert out.columns == ["doc_id", "ids"]
    got = sorted(((r.doc_id, r.ids) for r in out.collect()), key=str)
    assert got == sorted(((k, ids(enc, t or "")) for k, t, _ in rows), key=str)
    back = {r.doc_id: r.text for r in tokens.decode(out).collect()}
    assert back[4] == long and back[1] == ""


def test_empty_table(spark):
    assert tokens.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("chunk,overlap", [(60, 12), (200, 50)])
def test_chunks_meet_or_become_one(spark, enc, chunk, overlap):
    rng = random.Random(chunk)
    texts = ["".join(rng.choice("abc é1’ \n") for _ in range(1500)) for _ in range(6)] + ["a" * 900, " " * 500 + "x", "ab " * 300, "1" * 450 + "'re" * 100, "le conseil " * 60 + "x" * 700 + " puis la ville" * 60 + "9" * 333 + " fin", "\n" * 301, "🙂" * 400 + "mot " * 90]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.ids for r in tokens.encode(df, chunk_chars=chunk, overlap=overlap).collect()}
    assert all(got[k] == enc.enc.encode_ordinary(t) for k, t in enumerate(texts)) and len(got) == len(texts)
    sizes = {r.doc_id: r.n_tokens for r in tokens.encode(df, chunk_chars=chunk, overlap=overlap, counts=True).collect()}
    assert sizes == {k: len(v) for k, v in got.items()}


def test_one_long_text_is_spread_over_tasks(spark, enc):
    text = "Le conseil de la ville approuve le budget, dit-on. " * 12_000
    df = spark.createDataFrame([(1, text)], "row long, text string").selectExpr("row", "row as key", "text")
    chunks = tokens._chunks(df, 16_384, 256, 8)
    filled = [r for r in chunks.selectExpr("spark_partition_id() as p").groupBy("p").count().collect()]
    assert len(filled) == 8 and max(r["count"] for r in filled) < 0.5 * chunks.count()
    got = tokens.encode(df, key="key").first().ids
    assert got == enc.enc.encode_ordinary(text)
