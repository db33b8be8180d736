"""Encoding of whole corpora with a public byte-level BPE tokenizer (problem 6).

Method: overlapping chunk encoding. A text longer than ``chunk_chars`` is cut into chunks that overlap. Each chunk is
pre-tokenised and its pieces encoded on its own, in tasks that chunks are spread over evenly, whatever text they come
from. Of two neighbours only the pre-token boundaries in their overlap are exchanged: at the first that both have, they
are stitched (from an equal position over equal text the pre-tokeniser goes on equally), each giving the ids between its
two meeting points. Where one run of characters fills an overlap there is no common boundary; such neighbours are made
one chunk and encoded again, until all meet. A piece's ids depend on the piece alone, so they are kept in a bounded table.
Decoding concatenates bytes.

The vocabulary is read by the driver and broadcast (a file of at most some MB); executors need no such file.

Defined results: a null and an empty text have an empty list; every input row gives one row, repeated ids included;
other columns, whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
import sys
import unicodedata
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, tasks

#: Where the tokenizers' files lie, unless a parameter says otherwise.
TOKENIZERS = "/opt/tokenizers"
#: The published pre-tokenisation pattern of the 50k byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A chunk's last characters can be matched differently when more text follows; boundaries this near its end don't count.
TAIL = 3
#: Characters from here on are left to the full pattern.
CHECKED = 0x3000
#: Pieces whose ids are kept in a worker.
KEPT = 400_000


class Encoder(dict):
    """Piece of text -> its ids as the bytes of int32."""

    def __init__(self, vocabulary: bytes):
        super().__init__()
        import regex
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line.strip())}
        self.enc = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.full = regex.compile(PATTERN)
        # Python's own engine is faster but has no \p classes; it serves texts without characters on which \w, \d and \s differ from them.
        odd = [c for c in map(chr, range(CHECKED)) if self._differs(c)]
        self.differs = re.compile("[" + _ranges(odd) + f"\\U{CHECKED:08x}-\\U{sys.maxunicode:08x}]")
        self.quick = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+")

    @staticmethod
    def _differs(c: str) -> bool:
        kind = unicodedata.category(c)
        word, digit, space = c.isalnum() or c == "_", c.isdecimal(), c.isspace()
        letter, number = kind[0] == "L", kind[0] == "N"
        return (
            letter != (word and not digit and c != "_")
            or number != digit
            or kind in ("Cn", "Cs")
            or (space and (c < " " and c not in "\t\n\x0b\x0c\r"))
        )

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= KEPT:
            self.clear()
        ids = self[piece] = array("i", self.enc._core_bpe.encode_single_piece(piece.encode("utf-8", "replace"))).tobytes()
        return ids

    def pieces(self, text: str) -> list[str]:
        return (self.full if self.differs.search(text) else self.quick).findall(text)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.pieces(text)))

    def decode(self, ids) -> str:
        return self.enc.decode(list(ids))


def _ranges(chars: list[str]) -> str:
    out, codes = [], [ord(c) for c in chars]
    k = 0
    while k < len(codes):
        j = k
        while j + 1 < len(codes) and codes[j + 1] == codes[j] + 1:
            j += 1
        out.append(f"\\U{codes[k]:08x}-\\U{codes[j]:08x}")
        k = j + 1
    return "".join(out)


def vocabulary(tokenizers: str = TOKENIZERS, name: str = "byte_bpe_50k") -> bytes:
    with open(f"{tokenizers}/{name}.tiktoken", "rb") as f:
        return f.read()


@lru_cache(maxsize=4)
def encoder_of(data: bytes) -> Encoder:
    """One encoder for each vocabulary and worker."""
    return Encoder(data)


def encoder(tokenizers: str = TOKENIZERS, name: str = "byte_bpe_50k") -> Encoder:
    return encoder_of(vocabulary(tokenizers, name))


def _ids_column(blobs: list[bytes]) -> pa.Array:
    ends, n = array("i", [0]), 0
    for b in blobs:
        n += len(b) // 4
        ends.append(n)
    flat = pa.Array.from_buffers(pa.int32(), n, [None, pa.py_buffer(b"".join(blobs))])
    return pa.ListArray.from_arrays(pa.Array.from_buffers(pa.int32(), len(ends), [None, pa.py_buffer(ends.tobytes())]), flat)


def stitch(enc: Encoder, chunks: list[tuple[int, str]]) -> list[str]:
    """The pre-tokens of the text whose overlapping ``(start, chunk)`` these are, in order."""
    out: list[str] = []
    start, text = chunks[0]
    left = enc.pieces(text)
    for at, more in chunks[1:]:
        bounds, p = [], start
        for piece in left:
            bounds.append(p)
            p += len(piece)
        sure = start + len(text) - TAIL
        right, q, meet = enc.pieces(more), at, None
        for k, piece in enumerate(right):
            j = bisect_left(bounds, q)
            if j < len(bounds) and bounds[j] == q and q <= sure:
                meet = j, k
                break
            if q > sure:
                break
            q += len(piece)
        if meet:
            out += left[: meet[0]]
            start, text, left = q, more[q - at :], right[meet[1] :]
        else:  # one run of characters fills the overlap: go on from the left's last sure boundary
            j = max(0, bisect_left(bounds, sure) - 1)
            out += left[:j]
            text = text[bounds[j] - start :] + more[start + len(text) - at :]
            start, left = bounds[j], enc.pieces(text)
    return out + left


def _chunks(texts: DataFrame, size: int, overlap: int, n_tasks: int) -> DataFrame:
    """``row, key, at, stop, last, chunk``, spread evenly; of the whole of each text, or of its ``spans`` (at, stop) if the column is there."""
    kind = texts.schema["key"].dataType.simpleString()
    spans = "spans" in texts.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                text = b.column(2)[k].as_py()
                n = len(text)
                if spans:
                    at = [(x["at"], x["stop"]) for x in b.column(3)[k].as_py()]
                else:
                    at = [(p, min(n, p + size + overlap)) for p in range(0, max(1, n - overlap), size)]
                for j in range(0, len(at), 64):
                    part = at[j : j + 64]
                    m = len(part)
                    yield pa.RecordBatch.from_arrays(
                        [pa.repeat(b.column(0)[k], m), pa.repeat(b.column(1)[k], m), pa.array([p for p, _ in part], pa.int64()), pa.array([q for _, q in part], pa.int64()), pa.array([q >= n for _, q in part], pa.bool_()), pa.array([text[p:q] for p, q in part], pa.string())],
                        ["row", "key", "at", "stop", "last", "chunk"],
                    )

    cols = ["row", "key", "text", *(["spans"] if spans else [])]
    return texts.select(*cols).mapInArrow(cut, f"row long, key {kind}, at long, stop long, last boolean, chunk string").repartition(n_tasks, "row", "at")


def _encoded(chunks: DataFrame, shared: Broadcast, overlap: int, counts: bool) -> DataFrame:
    """Each chunk's ids (unless ``counts``), and its boundaries in both overlaps, with how many ids lie before each."""
    kind = chunks.schema["key"].dataType.simpleString()
    places = [f"{side}_{what}" for side in ("head", "tail") for what in ("pos", "ids")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder_of(shared.value)
        for b in batches:
            got: list[list] = [[] for _ in places]
            blobs, sizes = [], []
            for at, stop, last, chunk in zip(*(b.column(k).to_pylist() for k in range(2, 6)), strict=True):
                pieces = enc.pieces(chunk)
                parts = list(map(enc.__getitem__, pieces))
                blob = b"".join(parts)
                n = len(blob) // 4
                p, done, head, tail = at, 0, [], []
                for piece, ids in zip(pieces, parts, strict=True):
                    if p >= at + overlap:
                        break
                    head.append((p, done))
                    p, done = p + len(piece), done + len(ids) // 4
                p, left = stop, n
                for piece, ids in zip(reversed(pieces), reversed(parts), strict=True):
                    p, left = p - len(piece), left - len(ids) // 4
                    if last or p < stop - overlap:
                        break
                    if p <= stop - TAIL:
                        tail.append((p, left))
                for out, x in zip(got, (*_sides(head), *_sides(tail)), strict=True):
                    out.append(x)
                blobs.append(blob)
                sizes.append(n)
            ids = [] if counts else [_ids_column(blobs)]
            names = [*b.schema.names[:5], "n", *places, *(["ids"] if ids else [])]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sizes, pa.int32()), *(pa.array(g, pa.list_(pa.int64() if k % 2 == 0 else pa.int32())) for k, g in enumerate(got)), *ids], names)

    schema = f"row long, key {kind}, at long, stop long, last boolean, n int, " + ", ".join(f"{x} array<{'bigint' if x.endswith('pos') else 'int'}>" for x in places)
    return chunks.mapInArrow(run, schema + ("" if counts else ", ids array<int>"))


def _sides(pairs: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    return [p for p, _ in pairs], [n for _, n in pairs]


def _met(parts: DataFrame) -> DataFrame:
    """With ``meet``, the first boundary that a chunk shares with the one before it; null where there is none."""
    by = Window.partitionBy("row").orderBy("at")
    meet = F.array_min(F.array_intersect("head_pos", F.lag("tail_pos").over(by)))
    return parts.withColumn("meet", F.when(F.col("at") == 0, F.lit(0).cast("long")).otherwise(meet))


def _long(texts: DataFrame, shared: Broadcast, size: int, overlap: int, counts: bool) -> DataFrame:
    """``key`` and ids (or their number) of the texts (``row, key, text``), by chunks."""
    texts = materialize(texts, "long_texts")
    chars = texts.agg(F.sum("n")).first()[0] or 0
    parts = materialize(_encoded(_chunks(texts, size, overlap, max(tasks(texts.sparkSession), -(-chars // (64 * size)))), shared, overlap, counts), "chunks")
    while True:
        places = _met(parts.select("row", "at", "stop", "head_pos", "tail_pos"))
        apart = places.filter("meet is null").select("row").distinct()
        if apart.isEmpty():
            break
        # Chunks that don't meet the one before become one with it.
        by = Window.partitionBy("row").orderBy("at")
        chains = places.join(apart, "row", "left_semi").withColumn("chain", F.sum(F.when(F.col("meet").isNull(), 0).otherwise(1)).over(by)).groupBy("row", "chain").agg(F.min("at").alias("at"), F.max("stop").alias("stop"), F.count("*").alias("links"))
        chains = materialize(chains.filter("links > 1").select("row", "at", "stop"), "chains")
        spans = chains.groupBy("row").agg(F.collect_list(F.struct("at", "stop")).alias("spans"))
        again = _encoded(_chunks(texts.join(spans, "row"), size, overlap, tasks(texts.sparkSession)), shared, overlap, counts)
        inside = chains.select("row", F.col("at").alias("a"), F.col("stop").alias("z"))
        rest = parts.join(inside, (parts["row"] == inside["row"]) & (parts["at"] >= inside["a"]) & (parts["stop"] <= inside["z"]), "left_anti")
        parts = materialize(rest.unionByName(again), "chunks")
    by = Window.partitionBy("row").orderBy("at")
    m = _met(parts).withColumn("next", F.lead("meet").over(by))
    begin = F.when(F.col("at") == 0, 0).otherwise(F.element_at("head_ids", F.array_position("head_pos", F.col("meet")).cast("int")))
    end = F.when(F.col("next").isNull(), F.col("n")).otherwise(F.element_at("tail_ids", F.array_position("tail_pos", F.col("next")).cast("int")))
    if counts:
        return m.select("row", "key", (end - begin).alias("n")).groupBy("row").agg(F.first("key").alias("key"), F.sum("n").cast("int").alias("n_tokens")).select("key", "n_tokens")
    m = m.select("row", "key", "at", F.slice("ids", begin + 1, end - begin).alias("part"))
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]))
    return m.groupBy("row").agg(F.first("key").alias("key"), whole.alias("ids")).select("key", "ids")


def encode(
    df: DataFrame, key: str = "doc_id", text: str = "text", tokenizers: str = TOKENIZERS, name: str = "byte_bpe_50k", chunk_chars: int = 16_384, overlap: int = 256, counts: bool = False
) -> DataFrame:
    """``key`` and ``ids`` (array<int>) of every row's text, without special tokens; with ``counts`` also ``n_tokens`` instead of ids.

    Short texts are encoded where they are read, without a shuffle; only the chunks of long ones are shuffled.
    """
    if overlap <= TAIL or chunk_chars < overlap:
        raise ValueError("the overlap must be longer than its unsure tail and no longer than a chunk")
    kind = df.schema[key].dataType.simpleString()
    cols = df.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    value, sql = ("n_tokens", "int") if counts else ("ids", "array<int>")
    shared = df.sparkSession.sparkContext.broadcast(vocabulary(tokenizers, name))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder_of(shared.value)
        for b in batches:
            for k in range(0, b.num_rows, 2000):
                part = b.slice(k, 2000)
                blobs = [enc.encode(x) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // 4 for x in blobs], pa.int32()) if counts else _ids_column(blobs)], ["key", value])

    n = F.length("text")
    out = cols.filter(n <= chunk_chars).mapInArrow(short, f"key {kind}, {value} {sql}")
    long = cols.filter(n > chunk_chars).select(F.monotonically_increasing_id().alias("row"), "key", "text", n.cast("long").alias("n"))
    return out.unionByName(_long(long, shared, chunk_chars, overlap, counts)).withColumnRenamed("key", key)


def decode(df: DataFrame, key: str = "doc_id", ids: str = "ids", tokenizers: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """The texts of lists of ids: the bytes of all ids, put together, read as UTF-8."""
    kind = df.schema[key].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(vocabulary(tokenizers, name))

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder_of(shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else enc.decode(x) for x in b.column(1).to_pylist()], pa.string())], ["key", "text"])

    return df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{ids}`").alias("ids")).mapInArrow(back, f"key {kind}, text string").withColumnRenamed("key", key)
