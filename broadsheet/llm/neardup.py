"""Groups of records whose texts are versions of one another (problem 2).

Method: signature trees. A node holds the OR of its texts' token bitmaps and the range of their sizes; two trees are
traversed together and a pair of nodes is left as soon as the largest overlap their bitmaps and sizes allow is too small
for the threshold. One tree over a whole archive can't prune, since the OR of unlike texts fills up; so the upper levels
are laid out by min-hash bands: texts that agree in ``rows`` min-hashes of any of ``bands`` bands share a subtree, and
subtrees are traversed with themselves in parallel. Two texts of similarity s miss each other in all bands with
probability (1 - s^rows)^bands: 0.0016 at s = 0.5, 0.0003 at 0.55, under 0.00002 from 0.62 on with the numbers used here
(and then only if no third version links them). Whatever the traversal leaves is verified by the true Jaccard similarity.

Texts with equal sets of shingles are one text throughout and only come apart in the result, so a text copied a million
times costs one entry. Texts of a band's bucket with more than ``hot`` different ones, as boilerplate makes them, are laid
out by their rarest shingles instead, as many as any pair of the threshold's similarity needs to share one (exact). Only
where more than ``hot`` texts share even a rare shingle are they split into blocks, of which each pair is a subtree of its
own in another task; of a block pair only links between different groups so far are kept.

Defined results: null and blank texts have no row; a text of fewer words than a shingle equals only texts with the same
words (or, without any word, the same signs); titles and other columns play no part; rows of equal key are one record;
every record with text has a class of its own or one with others, named by its least key.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graphs import connected_components
from ..session import materialize

WORD = re.compile(r"[^\W_]+")
BITS = 512
FAN = 8
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class WordHash(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        v = self[word] = xxhash.xxh64_intdigest(word)
        return v


def shingles(text: str, size: int, known: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``size`` words; of all words together if there are fewer."""
    words = WORD.findall(text.lower())
    w = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if len(w) < size:
        return np.zeros(0, np.uint64)
    n = len(w) - size + 1
    s = w[:n].copy()
    for k in range(1, size):
        s = (s * _A) ^ (s >> np.uint64(31))
        s += w[k : k + n] * _B
    s ^= s >> np.uint64(29)
    return np.unique(s * _A)


def bitmap(s: np.ndarray) -> np.ndarray:
    bits = np.zeros(BITS, np.uint8)
    bits[(s >> np.uint64(40)).astype(np.int64) % BITS] = 1
    return np.packbits(bits)


def signatures(docs: DataFrame, key: str, text: str, size: int, bands: int, rows: int) -> DataFrame:
    """``key, h`` (of the set of shingles), ``n`` (its size), ``tokens`` (int32 each), ``bits``, ``routes`` (one a band) for every text."""
    kind = docs.schema[key].dataType.simpleString()
    rng = np.random.default_rng(20)
    mult = rng.integers(1, 2**63, bands * rows, dtype=np.uint64) | np.uint64(1)
    mix = rng.integers(1, 2**63, (1, bands * rows), dtype=np.uint64) | np.uint64(1)
    salt = np.arange(1, bands + 1, dtype=np.uint64) * _B

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        known = WordHash()
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                keys, hs, ns, tokens, bits, routes = [], [], [], [], [], []
                for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if not x or x.isspace():
                        continue
                    s = shingles(x, size, known)
                    keys.append(k)
                    short = np.unique((s >> np.uint64(32)).astype(np.uint32))
                    ns.append(len(short))
                    if len(s):
                        hs.append(xxhash.xxh64_intdigest(s.tobytes()) - 2**63)
                        low = (s[:, None] * mult[None, :]).min(0)
                        r = (low[None, :] * mix).reshape(bands, rows).sum(1, dtype=np.uint64) + salt
                        r ^= r >> np.uint64(32)
                        routes.append((r * _A).view(np.int64))
                        tokens.append(short.tobytes())
                        bits.append(bitmap(s).tobytes())
                    else:
                        hs.append(xxhash.xxh64_intdigest(" ".join(WORD.findall(x.lower())) or "\0" + x.strip()) - 2**63)
                        tokens.append(b"")
                        bits.append(b"")
                        routes.append(np.zeros(0, np.int64))
                ends = np.cumsum([0, *map(len, routes)]).astype(np.int32)
                flat = np.concatenate(routes) if routes else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, b.schema.field(0).type), pa.array(hs, pa.int64()), pa.array(ns, pa.int32()), pa.array(tokens, pa.binary()), pa.array(bits, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                    ["key", "h", "n", "tokens", "bits", "routes"],
                )

    cols = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).filter("text is not null")
    return cols.mapInArrow(run, f"key {kind}, h long, n int, tokens binary, bits binary, routes array<long>")


def traverse(tree: np.ndarray, sizes: np.ndarray, bits: np.ndarray, t: float, other: np.ndarray | None = None, part: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Dual traversal of a forest with itself: pairs of rows that may reach similarity ``t``.

    ``tree`` names each row's subtree (rows of one subtree lie together, by size); only rows of one subtree are paired.
    ``other`` marks a row's side where only pairs across sides are wanted; rows of equal ``part`` (but 0) are linked
    already. All subtrees go down level by level together.
    """
    part = np.zeros(len(sizes), np.int64) if part is None else part
    words = np.ascontiguousarray(bits).view(np.uint64).reshape(len(sizes), -1)
    excess = sizes - np.bitwise_count(words).sum(1)
    levels = [(words, sizes, sizes, excess, tree, part, np.arange(len(sizes) + 1))]
    while True:  # upwards: nodes of at most FAN children of one subtree
        w, lo, hi, ex, own, of, _ = levels[-1]
        change = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        rank = np.arange(len(own)) - np.repeat(change, np.diff(np.r_[change, len(own)]))
        first = np.flatnonzero(rank % FAN == 0)
        if len(first) == len(own):
            break
        levels.append((np.bitwise_or.reduceat(w, first, 0), np.minimum.reduceat(lo, first), np.maximum.reduceat(hi, first), np.maximum.reduceat(ex, first), own[first], np.where(np.minimum.reduceat(of, first) == np.maximum.reduceat(of, first), of[first], 0), np.r_[first, len(own)]))
    n = len(levels[-1][4])
    a = b = np.arange(n)
    for depth in range(len(levels) - 1, -1, -1):
        w, lo, hi, ex, _, of, _ = levels[depth]
        keep = []
        for k in range(0, len(a), 200_000):
            i, j = a[k : k + 200_000], b[k : k + 200_000]
            fits = (hi[i] >= t * lo[j]) & (hi[j] >= t * lo[i]) & ((of[i] == 0) | (of[i] != of[j]))
            most = np.bitwise_count(w[i] & w[j]).sum(1) + np.minimum(ex[i], ex[j])
            most = np.minimum(most, np.minimum(hi[i], hi[j]))
            fits &= most * (1 + t) >= t * (lo[i] + lo[j]) - 1e-9
            keep.append(fits)
        fits = np.concatenate(keep) if keep else np.zeros(0, bool)
        a, b = a[fits], b[fits]
        if depth == 0:
            break
        starts = levels[depth][6]
        na, nb = starts[a + 1] - starts[a], starts[b + 1] - starts[b]
        every = na * nb
        which = np.repeat(np.arange(len(a)), every)
        k = np.arange(len(which)) - np.repeat(np.cumsum(every) - every, every)
        a, b = starts[a[which]] + k // nb[which], starts[b[which]] + k % nb[which]
        ok = a <= b
        a, b = a[ok], b[ok]
    ok = a < b
    if other is not None:
        ok &= (other[a] == 0) | (other[a] != other[b])
    return a[ok], b[ok]


def heads(tree: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars: each row of a subtree with its first; of a pair of blocks the two first ones."""
    first = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]]) if len(tree) else np.zeros(0, int)
    a = np.repeat(first, np.diff(np.r_[first, len(tree)]))
    b = np.arange(len(tree))
    plain = (side[a] == 0) & (a != b)
    across = side[a] != side[b]
    across[np.flatnonzero(across)[1:][np.diff(a[across]) == 0]] = False
    keep = plain | across
    return a[keep], b[keep]


def rare_routes(table: DataFrame, texts: DataFrame, t: float) -> DataFrame:
    """``h, n, route`` of the texts of crowded buckets: a route for each of their rarest shingles.

    Of two texts of similarity ``t`` or more each has more than ``1 - t`` of its shingles' number to look through, the rarest
    first, to meet one they share; so texts that share only what is common to many don't meet, and no pair is lost.
    """
    sets = table.filter("n > 0").join(texts, "h", "left_semi").groupBy("h").agg(F.first("tokens").alias("tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [np.frombuffer(x, np.uint32) for x in b.column(1).to_pylist()]
            n = np.array([len(x) for x in parts], np.int64)
            at = np.repeat(np.arange(len(parts)), n)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(n[at], pa.int32()), pa.array(np.concatenate(parts).astype(np.int64) if parts else [], pa.int64())], ["h", "n", "token"])

    tokens = materialize(sets.mapInArrow(run, "h long, n int, token long"), "crowded_tokens")
    often = tokens.groupBy("token").agg(F.count("*").alias("texts"))
    ranked = tokens.join(often, "token").groupBy("h", "n").agg(F.sort_array(F.collect_list(F.struct("texts", "token"))).alias("x"))
    first = F.slice("x", F.lit(1), F.col("n") - F.ceil(F.col("n") * F.lit(t) - 1e-9).cast("int") + 1)
    return ranked.select("h", "n", F.explode(first).alias("x")).filter("x.texts > 1").select("h", "n", F.xxhash64(F.lit("rare"), "x.token").alias("route"))


def candidates(table: DataFrame, t: float, bands: int, hot: int, cell_rows: int, big: int) -> tuple[DataFrame, DataFrame | None]:
    """``a, b`` of the texts (by ``h``) that a traversal leaves, each pair once; and the verified links of the stars, if any."""
    texts = table.filter("n > 0").select("h", "n", "routes").groupBy("h").agg(F.first("n").alias("n"), F.first("routes").alias("routes"))
    routes = texts.select("h", "n", F.explode("routes").alias("route")).withColumn("side", F.lit(0)).withColumn("tree", F.col("route"))
    n_rows = max(1, table.filter("n > 0").count() * bands)
    # Buckets with many different texts: found by a coarse count of all rows (64k sums), then counted exactly.
    coarse = table.filter("n > 0").select(F.explode("routes").alias("route")).groupBy(F.expr("pmod(route, 65536)").alias("part")).count()
    full = [r[0] for r in coarse.filter(F.col("count") > hot + n_rows / 65536 + 6 * (n_rows / 65536) ** 0.5).select("part").collect()]
    if full:
        sizes = routes.filter(F.expr("pmod(route, 65536)").isin(full)).groupBy("route").count().filter(F.col("count") > hot)
        crowded = materialize(sizes.select("route"), "hot")
        rare = materialize(rare_routes(table, routes.join(crowded, "route", "left_semi").select("h").distinct(), t), "rare_routes")
        # What even rare shingles have in common with many is split into blocks, each pair a subtree of its own.
        sizes = rare.groupBy("route").count().filter(F.col("count") > hot)
        sizes = materialize(sizes.select("route", F.ceil(F.col("count") / hot).cast("int").alias("blocks")), "hot")
        split = rare.join(sizes, "route", "left").withColumn("block", F.when(F.col("blocks").isNotNull(), F.expr("cast(pmod(xxhash64(h), blocks) as int)")))
        single = split.filter("blocks is null").select("h", "n", "route", F.lit(0).alias("side"), F.col("route").alias("tree"))
        hots = split.filter("blocks is not null").select("h", "n", "route", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
        hots = hots.select("h", "n", "route", F.when(F.col("block") == F.col("with"), 0).when(F.col("block") < F.col("with"), 1).otherwise(2).alias("side"), F.xxhash64("route", F.least("block", "with"), F.greatest("block", "with")).alias("tree"))
        routes = routes.join(crowded, "route", "left_anti").select("h", "n", "route", "side", "tree").unionByName(single).unionByName(hots)
    cells = max(1, -(-n_rows // cell_rows))

    def shared(group: pa.Table) -> pa.Table:
        tree = group["tree"].to_numpy()
        order = np.argsort(tree, kind="stable")
        s = tree[order]
        same = np.r_[False, s[1:] == s[:-1]]
        kept = np.sort(order[same | np.r_[same[1:], False]]) if len(s) else order
        out = group.take(pa.array(kept)).select(["tree", "h", "n", "side"])
        _, of, m = np.unique(out["tree"].to_numpy(), return_inverse=True, return_counts=True)
        return out.append_column("m", pa.array(m[of] if len(m) else m, pa.int32()))

    met = routes.withColumn("cell", F.expr(f"pmod(xxhash64(tree), {cells})")).repartition(cells, "cell").groupBy("cell").applyInArrow(shared, "tree long, h long, n int, side int, m int")
    met = materialize(met, "buckets")
    bits = table.select("h", "bits").join(met.select("h").distinct(), "h", "left_semi").groupBy("h").agg(F.first("bits").alias("bits"))
    cells = max(1, -(-4 * met.count() // cell_rows))  # a quarter of the rows: they carry bitmaps and spread out into pairs of nodes

    def walk(stars: bool):
        def run(group: pa.Table) -> pa.Table:
            tree, n, h, side, part = (group[c].to_numpy() for c in ("tree", "n", "h", "side", "part"))
            order = np.lexsort((h, n, tree))
            raw = np.frombuffer(b"".join(group["bits"].to_pylist()), np.uint8).reshape(len(h), BITS // 8)[order]
            tree, n, h, side, part = tree[order], n[order].astype(np.int64), h[order], side[order], part[order]
            if stars:
                i, j = heads(tree, side)
                w = raw.view(np.uint64)
                pop = n - np.bitwise_count(w).sum(1)
                most = np.minimum(np.bitwise_count(w[i] & w[j]).sum(1) + np.minimum(pop[i], pop[j]), np.minimum(n[i], n[j]))
                ok = most * (1 + t) >= t * (n[i] + n[j]) - 1e-9
                i, j = i[ok], j[ok]
            else:
                i, j = traverse(tree, n, raw, t, side, part)
            pairs = np.unique(np.stack([np.minimum(h[i], h[j]), np.maximum(h[i], h[j])], 1), axis=0)
            pairs = pairs[pairs[:, 0] != pairs[:, 1]]
            return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

        return run

    def over(rows: DataFrame, stars: bool) -> DataFrame:
        rows = rows.join(bits, "h").withColumn("cell", F.expr(f"pmod(xxhash64(tree), {cells})")).repartition(cells, "cell")
        return rows.groupBy("cell").applyInArrow(walk(stars), "a long, b long").distinct()

    wide = met.filter(F.col("m") > big)
    if wide.isEmpty():
        return over(met.withColumn("part", F.lit(0).cast("long")), False), None
    first = materialize(verified(table, over(wide.withColumn("part", F.lit(0).cast("long")), True), t), "stars")
    part = connected_components(first, "a", "b").select(F.col("node").alias("h"), F.col("component").alias("part"))
    return over(met.join(part, "h", "left").withColumn("part", F.coalesce("part", F.lit(0).cast("long"))), False), first


def verified(table: DataFrame, pairs: DataFrame, t: float) -> DataFrame:
    """The pairs whose sets of shingles have a Jaccard similarity of at least ``t``, with it."""
    wanted = pairs.select(F.col("a").alias("h")).union(pairs.select("b")).distinct()
    sets = table.select("h", "tokens").join(wanted, "h", "left_semi").groupBy("h").agg(F.first("tokens").alias("tokens"))
    joined = pairs.join(sets.select(F.col("h").alias("a"), F.col("tokens").alias("ta")), "a").join(sets.select(F.col("h").alias("b"), F.col("tokens").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                both = len(np.intersect1d(p, q, assume_unique=True))
                out.append(both / (len(p) + len(q) - both))
            s = pa.array(out, pa.float64())
            kept = pa.array([v >= t for v in out], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), s], ["a", "b", "similarity"]).filter(kept)

    return joined.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, similarity double")


def groups(
    docs: DataFrame, key: str = "id", text: str = "content", size: int = 5, threshold: float = 0.8, bands: int = 48, rows: int = 3, hot: int = 512, cell_rows: int = 200_000, big: int = 64
) -> DataFrame:
    """``key``, ``class`` (the least key of the group) and ``members`` (records in it) of every record with text."""
    table = materialize(signatures(docs, key, text, size, bands, rows), "signatures")
    found, stars = candidates(table, threshold, bands, hot, cell_rows, big)
    links = verified(table, found, threshold)
    links = materialize(links if stars is None else links.unionByName(stars), "links")
    parts = connected_components(links, "a", "b").select(F.col("node").alias("h"), "component")
    of = table.select("key", "h").distinct().join(parts, "h", "left").groupBy("key").agg(F.min(F.coalesce("component", "h")).alias("c"))
    least = of.groupBy("c").agg(F.min("key").alias("class"), F.count("*").alias("members"))
    return of.join(least, "c").select(F.col("key").alias(key), "class", "members")


def pairs(members: DataFrame, key: str = "id") -> DataFrame:
    """All pairs ``<key>_a < <key>_b`` of records of one class; their number is the size of the result itself."""
    m = members.filter("members > 1").select(F.col(key), "class")
    other = m.select(F.col(key).alias(f"{key}_b"), "class")
    return m.withColumnRenamed(key, f"{key}_a").join(other, "class").filter(F.col(f"{key}_a") < F.col(f"{key}_b")).select(f"{key}_a", f"{key}_b")
