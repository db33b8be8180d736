"""Variant spellings of persons and organisations (problem 3).

Method: metric-space partitioning. The parts of all distinct names (family and given names, coined words, trades) lie in
the metric space of the unrestricted Damerau-Levenshtein distance, over whole words of any script. Pivots, as many as the
square root of the parts, are spread over a bounded sample of them; every part belongs to the cell of its nearest pivot
and is copied to each cell whose pivot is at most twice the radius farther: by the triangle inequality no pair within the
radius is lost. Cells with too many parts are divided again by pivots of their own. Each cell runs an exact radius join,
in which the distances to the pivot, the lengths and the letters sort out most pairs before the true distance is computed.
Parts of less than four letters are compared for equality only: one edit makes most of them others.

Names whose anchor (a family name, an organisation's coined word, the initials of a descriptive name) lies in one
component of such pairs are then compared with each other: reordered parts, capitals, lost accents, initials, familiar
forms of first names, legal forms, abbreviated or left-out trades and acronyms link them. Persons need the same first name,
so namesakes of one family stay apart; an initial or a familiar form that fits two of them is linked with neither.

Defined results: null and blank names are left out; names are compared as stored, so two strings that differ in case are
two names of one entity; a name without a second spelling has a class of its own; repeated names count once.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graphs import connected_components
from ..session import materialize, tasks

#: Legal forms of companies, as they stand at the end of a name.
LEGAL = re.compile(r"(?:\s+|^)(?:S\.\s?A\.?|SA|AG|S\.?à\.?r\.?l\.?|Sarl|SARL|SÀRL|GmbH|GMBH|SNC|&\s?Cie\.?|et\s+Cie\.?|& CIE|Holding|HOLDING)(?=\s|$)")
#: Words that join the parts of a descriptive name.
JOINING = frozenset("de des du d la le les l et pour en von der die und di del della e of the and".split())
INITIALS = r"[^\W\d_a-zà-ÿ](?:\.?\s?-\s?[^\W\d_a-zà-ÿ])?"
FIRST_INITIAL = re.compile(rf"^({INITIALS})(?:\.\s*|\s+)(?=[^\W\d_]{{3}})(.+)$")
LAST_INITIAL = re.compile(rf"^(.+[^\W\d_]{{2}}),?\s+({INITIALS})\.?$")
ACRONYM = re.compile(r"^(?:(?:[^\W\d_a-zß-ÿ]\.){2,8}|[^\W\d_a-zß-ÿ]{3,8})$")
#: What being listed as a first name counts, in different parts beside it.
LISTED = 20
#: Distances beyond this count as this.
FAR = 16
PIECE = re.compile(r"[^\W\d_]+\.?")


def fold(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", s.lower().replace("œ", "oe").replace("æ", "ae").replace("ß", "ss")) if not unicodedata.combining(c))


def damerau(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Unrestricted Damerau-Levenshtein distances of row pairs of code points (padded with 0), of any script and length.

    What is farther than ``FAR`` counts as ``FAR``, which leaves it a metric and needs only a band of the table.
    """
    n, m, k = len(la), a.shape[1], b.shape[1]
    letters, of = np.unique(np.concatenate([a.ravel(), b.ravel()]), return_inverse=True)
    a, b = of[: n * m].reshape(n, m), of[n * m :].reshape(n, k)
    at = np.arange(n)
    h = np.full((m + 2, k + 2, n), m + k, np.int16)
    h[1:, 1, :] = np.arange(m + 1)[:, None]
    h[1, 1:, :] = np.arange(k + 1)[:, None]
    last = np.zeros((len(letters), n), np.int16)
    for i in range(1, m + 1):
        db = np.zeros(n, np.int16)
        for j in range(max(1, i - FAR), min(k, i + FAR) + 1):
            i1, j1 = last[b[:, j - 1], at], db
            same = a[:, i - 1] == b[:, j - 1]
            swap = h[i1, j1, at] + (i - i1 - 1) + 1 + (j - j1 - 1)
            h[i + 1, j + 1] = np.minimum(np.minimum(h[i, j] + ~same, swap), np.minimum(h[i + 1, j], h[i, j + 1]) + 1)
            db = np.where(same, j, db).astype(np.int16)
        last[a[:, i - 1], at] = i
    return np.minimum(h[la + 1, lb + 1, at], FAR)


def codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The words' code points, padded with 0 to the longest, and their lengths."""
    n = np.fromiter(map(len, words), np.int16, len(words))
    out = np.zeros((len(words), max(1, int(n.max(initial=0)))), np.int32)
    out[np.arange(out.shape[1])[None] < n[:, None]] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.int32)
    return out, n


def _distances(x: tuple[np.ndarray, np.ndarray], i: np.ndarray, y: tuple[np.ndarray, np.ndarray], j: np.ndarray) -> np.ndarray:
    """Distances of the words ``i`` of ``x`` from the words ``j`` of ``y``, in portions of bounded memory, long words apart."""
    out = np.minimum(np.abs(x[1][i] - y[1][j]), FAR).astype(np.int16)
    same = np.flatnonzero(out == 0)
    if len(same):
        w = min(x[0].shape[1], y[0].shape[1])
        equal = [same[s : s + 100_000][(x[0][i[same[s : s + 100_000]], :w] == y[0][j[same[s : s + 100_000]], :w]).all(1)] for s in range(0, len(same), 100_000)]
        same = np.concatenate(equal)
    longest = np.maximum(x[1][i], y[1][j])
    order = np.setdiff1d(np.flatnonzero(out < FAR), same, assume_unique=True)  # the rest is known
    order = order[np.argsort(longest[order], kind="stable")]
    signs = len(np.unique(x[0])) + len(np.unique(y[0]))
    s = 0
    while s < len(order):
        step = max(1, min(20_000, 20_000_000 // max(1, signs), 6_000_000 // (int(longest[order[min(len(order) - 1, s + 20_000)]]) + 2) ** 2))
        at = order[s : s + step]
        la, lb = x[1][i[at]], y[1][j[at]]
        out[at] = damerau(x[0][i[at]][:, : max(1, la.max())], y[0][j[at]][:, : max(1, lb.max())], la, lb)
        s += step
    return out


def spread(words: list[str], n: int) -> list[str]:
    """Up to ``n`` of the words, far from each other."""
    if not words:
        return []
    x = codes(words)
    chosen = [0]
    near = _distances(x, np.arange(len(words)), x, np.zeros(len(words), int))
    while len(chosen) < min(n, len(words)):
        k = int(near.argmax())
        if near[k] == 0:
            break
        chosen.append(k)
        near = np.minimum(near, _distances(x, np.arange(len(words)), x, np.full(len(words), k)))
    return [words[k] for k in chosen]


def _placed(words: list[str], centres: list[str], radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``word, centre, home, distance``: each word at its nearest centre and at all that are at most twice the radius farther."""
    n, p = len(words), len(centres)
    d = _distances(codes(words), np.repeat(np.arange(n), p), codes(centres), np.tile(np.arange(p), n)).reshape(n, p)
    i, q = np.nonzero(d <= d.min(1)[:, None] + 2 * radius)
    return i, q, d.argmin(1)[i] == q, d[i, q]


CELL = "cell string, unit string, home boolean, d int"


def cells(units: DataFrame, radius: int, sample: int, most: int, n_pivots: int | None = None, rounds: int = 2) -> DataFrame:
    """``cell, unit, home, d``: the parts by pivots, cells of more than ``most`` rows again by pivots of their own.

    The number of pivots grows with that of the parts: its square root in the first round (chosen among ``sample`` parts
    that a hash picks from all), then as many as cells of half the bound need, up to 64 a round (among 512 of the cell's
    own parts). Copies multiply with every round, so there are at most ``rounds`` of them, and a cell that isn't halved, since
    its parts are all equally far from each other, stays as it is: ``radius_join`` takes it in blocks.
    """
    n = units.count()
    got = [r[0] for r in units.select("unit").orderBy(F.xxhash64("unit")).limit(sample).collect()]
    centres = spread(got, n_pivots or max(8, int(n**0.5)))
    n_tasks = tasks(units.sparkSession)

    def rows(cell: list[str], words: list[str], home: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(cell, pa.string()), pa.array(words, pa.string()), pa.array(home, pa.bool_()), pa.array(d, pa.int32())], ["cell", "unit", "home", "d"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 1000):
                words = b.column(0).slice(s, 1000).to_pylist()
                i, q, home, d = _placed(words, centres, radius)
                yield rows([str(k) for k in q], [words[k] for k in i], home, d)

    placed = materialize(units.select("unit").repartition(n_tasks).mapInArrow(first, CELL), "cells")
    done = None
    for _ in range(rounds):
        sizes = placed.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > most)
        sizes = materialize(sizes, "big_cells")
        if sizes.isEmpty():
            break
        by = Window.partitionBy("cell").orderBy(F.xxhash64("unit"))
        picked = placed.join(sizes, "cell").withColumn("rank", F.row_number().over(by)).filter("rank <= 512")

        def choose(group: pa.Table) -> pa.Table:
            n = -(-2 * group["n"][0].as_py() // most)
            return pa.table({"cell": group["cell"].slice(0, 1), "n": group["n"].slice(0, 1), "centres": pa.array([spread(sorted(group["unit"].to_pylist()), min(64, max(4, n)))], pa.list_(pa.string()))})

        centre_sets = picked.groupBy("cell").applyInArrow(choose, "cell string, n long, centres array<string>")
        small = placed.join(sizes.select("cell"), "cell", "left_anti")
        done = small if done is None else done.unionByName(small)

        def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cell, words, home = (b.column(k).to_pylist() for k in range(3))
                for c in sorted(set(cell)):
                    at = [k for k, x in enumerate(cell) if x == c]
                    for s in range(0, len(at), 1000):
                        some = at[s : s + 1000]
                        i, q, nearest, d = _placed([words[k] for k in some], b.column(3)[some[0]].as_py(), radius)
                        yield rows([f"{c}.{k}" for k in q], [words[some[k]] for k in i], nearest & np.array([home[some[k]] for k in i], bool), d)

        split = materialize(placed.join(centre_sets, "cell").select("cell", "unit", "home", "centres").mapInArrow(again, CELL), "cells")
        # What a split doesn't halve isn't split again.
        parent = F.regexp_replace("cell", r"\.\d+$", "")
        grown = split.groupBy("cell").agg(F.count("*").alias("m")).join(sizes.withColumnRenamed("cell", "parent"), parent == F.col("parent")).filter("m * 2 > n").select("cell")
        stuck = split.join(grown, "cell", "left_semi")
        done = done.unionByName(stuck)
        placed = materialize(split.join(grown, "cell", "left_anti"), "cells")
    return placed if done is None else materialize(done.unionByName(placed), "cells")


def radius_join(units: DataFrame, radius: int = 1, n_pivots: int | None = None, sample: int = 2000, most: int = 8192, block: int = 2048) -> DataFrame:
    """``a < b, distance`` of all parts (column ``unit``, distinct) within ``radius`` of each other: exact."""
    placed = cells(units, radius, sample, most, n_pivots)
    # A cell's own parts are taken in blocks, each against the cell, so that no task holds more than one block's pairs.
    homes = placed.filter("home").groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("k"))
    both = placed.join(homes, "cell")
    own = both.filter("home").select("cell", F.expr("cast(pmod(hash(unit), k) as int)").alias("block"), "unit", "d", F.lit(True).alias("home"))
    every = both.select("cell", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("block"), "unit", "d", F.lit(False).alias("home"))

    def join(group: pa.Table) -> pa.Table:
        home = group["home"].to_numpy(zero_copy_only=False)
        words = group["unit"].to_pylist()
        d = group["d"].to_numpy()
        left, right = np.flatnonzero(home), np.flatnonzero(~home)
        x = codes(words)
        bag = np.zeros((len(words), 64), np.int16)
        for col in range(x[0].shape[1]):
            np.add.at(bag, (np.arange(len(words)), x[0][:, col] % 64), (x[0][:, col] > 0).astype(np.int16))
        name = np.array(words, object)
        out = []
        for k in range(0, len(left), 64):
            i = left[k : k + 64]
            close = (np.abs(x[1][i][:, None] - x[1][right][None]) <= radius) & (np.abs(d[i][:, None] - d[right][None]) <= radius)
            p, q = np.nonzero(close)
            p, q = i[p], right[q]
            diff = bag[p] - bag[q]
            ok = (np.maximum(diff, 0).sum(1) <= radius) & (np.maximum(-diff, 0).sum(1) <= radius)
            p, q = p[ok], q[ok]
            ok = name[p] != name[q]
            p, q = p[ok], q[ok]
            got = _distances(x, p, x, q)
            out += [(min(name[r], name[s]), max(name[r], name[s]), int(v)) for r, s, v in zip(p, q, got, strict=True) if v <= radius]
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table({"a": pa.array(cols[0], pa.string()), "b": pa.array(cols[1], pa.string()), "distance": pa.array(cols[2], pa.int32())})

    work = materialize(own.unionByName(every), "cell_blocks").repartition(tasks(units.sparkSession), "cell", "block")
    return work.groupBy("cell", "block").applyInArrow(join, "a string, b string, distance int").distinct()


def parse(name: str) -> tuple[str, str, list[str]]:
    """``(kind, style, parts)``: kinds ``acronym``, ``long`` (a descriptive name), ``initial`` (parts: anchor, initial), ``two`` (parts in
    order), ``one``; style ``comma``, ``caps`` (the first of two), ``legal`` or empty. Parts are folded."""
    s = " ".join(name.replace("’", "'").split()).strip(" ,;")
    if ACRONYM.match(s.replace(" ", "")) and (s.isupper()):
        letters = "".join(c for c in fold(s) if c.isalpha())
        if "." in s or len(letters) <= 6 and " " not in s:
            return "acronym", "", ["".join(sorted(letters))]
    bare = LEGAL.sub(" ", s)
    bare = LEGAL.sub(" ", " ".join(bare.split()))
    legal = "legal" if bare != s else ""
    bare = " ".join(bare.split()).strip(" ,;&") or s
    if not legal:
        m = FIRST_INITIAL.match(bare)
        if m and not LAST_INITIAL.match(m.group(2)) and " " not in m.group(2).strip():
            return "initial", "first", [fold(m.group(2)).strip(), fold("".join(c for c in m.group(1) if c.isalpha()))]
        m = LAST_INITIAL.match(bare)
        if m and " " not in m.group(1).strip():
            return "initial", "last", [fold(m.group(1)).strip(" ,"), fold("".join(c for c in m.group(2) if c.isalpha()))]
    words = [w for w in PIECE.findall(bare.replace("-", " ")) if fold(w).strip(".") not in JOINING]
    if len(words) >= 3 and (len(words) >= 4 or re.search(r"\b(?:de|des|du|pour|et)\b|\bd'", bare.lower())):
        return "long", "", [fold(w) for w in words]
    if not legal and "," in bare:
        a, _, b = bare.partition(",")
        return "two", "comma", [fold(a).strip(), fold(b).strip().replace(" ", "-")]
    tokens = bare.split()
    if len(tokens) == 1 and "-" in tokens[0] and "." not in tokens[0]:
        tokens = tokens[0].split("-", 1)
    if len(tokens) == 3:
        caps = [t.isupper() and len(t) > 1 for t in tokens]
        tokens = [tokens[0], f"{tokens[1]}-{tokens[2]}"] if caps[0] and not any(caps[1:]) else [f"{tokens[0]}-{tokens[1]}", tokens[2]]
    if len(tokens) == 2:
        up = [t.isupper() and len(t) > 2 for t in tokens]
        return "two", legal or ("caps" if up == [True, False] else ""), [fold(t) for t in tokens]
    return "one", legal, [fold(" ".join(tokens))]


def contracted(short: str, full: str) -> bool:
    """Whether ``short`` abbreviates ``full``: its beginning, or its first and last letters with some between."""
    s = short.strip(".")
    if not s or s[0] != full[0] or len(s) >= len(full):
        return False
    if full.startswith(s):
        return short.endswith(".") or len(s) <= 2
    it = iter(full)
    return len(s) <= 5 and s[-1] == full[-1] and all(c in it for c in s)


def near(a: str, b: str) -> bool:
    """Whether two words differ as by slips of the hand: one edit, two from eight letters on."""
    if a == b:
        return True
    most = 1 if min(len(a), len(b)) < 9 else 2
    if abs(len(a) - len(b)) > most or min(len(a), len(b)) < 4:
        return False
    x, y = codes([a]), codes([b])
    return int(damerau(x[0][:, : x[1][0]], y[0][:, : y[1][0]], x[1], y[1])[0]) <= most


def alike(a: list[str], b: list[str]) -> bool:
    """Whether two descriptive names have the same words, in any order, whole, abbreviated or misspelt."""
    if len(a) != len(b):
        return False
    rest = list(b)
    for w in sorted(a, key=len, reverse=True):
        for test in (lambda u: u.strip(".") == w.strip("."), lambda u: contracted(w, u) or contracted(u, w), lambda u: near(w.strip("."), u.strip("."))):  # noqa: B023
            hit = next((u for u in rest if test(u)), None)
            if hit is not None:
                rest.remove(hit)
                break
        else:
            return False
    return True


class Union:
    def __init__(self, n: int):
        self.p = list(range(n))

    def find(self, x: int) -> int:
        while self.p[x] != x:
            self.p[x] = self.p[self.p[x]]
            x = self.p[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.p[max(a, b)] = min(a, b)


def resolve(rows: list[dict], close: set[tuple[str, str]], formal: dict[str, set[str]], known: int = 5) -> list[int]:
    """Classes of the names of one component: ``rows`` have kind, anchor, part, org, parts; ``close`` are the pairs of anchors."""
    u = Union(len(rows))
    by: dict[tuple[str, str], list[int]] = defaultdict(list)
    for k, r in enumerate(rows):
        by[r["kind"], r["anchor"]].append(k)
    beside: dict[str, set[str]] = defaultdict(set)
    for a, b in close:
        beside[a].add(b)
        beside[b].add(a)
    # Whole names: equal anchor and part; then close anchors with an equal part.
    whole: dict[tuple[str, str], int] = {}
    for k, r in enumerate(rows):
        if r["kind"] == "two":
            j = whole.setdefault((r["anchor"], r["part"]), k)
            u.join(j, k)
    for (a, p), k in whole.items():
        for b in beside[a]:
            if (b, p) in whole:
                u.join(k, whole[b, p])
    of_anchor: dict[str, list[tuple[str, int]]] = defaultdict(list)
    for (a, p), k in whole.items():
        of_anchor[a].append((p, k))
    # Slips in the part, and its beginning for the whole, unless both are names of their own.
    for a, found in of_anchor.items():
        for x, (p, k) in enumerate(found):
            for q, j in found[:x]:
                rare, other = (p, q) if rows[k]["weight"] <= rows[j]["weight"] else (q, p)
                if min(rows[k]["weight"], rows[j]["weight"]) < known and rare not in formal and (near(p, q) or (len(rare) >= 3 and other.startswith(rare) and "-" not in other)):
                    u.join(k, j)

    def around(a: str) -> list[tuple[str, int]]:
        return of_anchor[a] + [x for b in sorted(beside[a]) for x in of_anchor[b]]

    def only(k: int, found: list[int]) -> bool:
        classes = {u.find(j) for j in found}
        if len(classes) == 1:
            u.join(k, classes.pop())
            return True
        return False

    # Familiar forms: of the first names they stand for, the one that this family has.
    for (a, p), k in whole.items():
        if p in formal:
            full = [j for q, j in of_anchor[a] if q in formal[p]] or [j for q, j in around(a) if q in formal[p]]
            if full:
                only(k, full)
            else:  # two familiar forms of one first name
                only(k, [j for q, j in of_anchor[a] if q != p and q in formal and formal[q] & formal[p]])
    # Abbreviated parts: initials and shortened trades.
    short: dict[tuple[str, str], int] = {}
    for k, r in enumerate(rows):
        if r["kind"] in ("initial", "short"):
            u.join(short.setdefault((r["anchor"], r["part"]), k), k)

    def fits(p: str, q: str) -> bool:
        if "-" in q and len(p) == 2:
            return "".join(x[:1] for x in q.split("-")) == p
        return q.startswith(p.strip("."))

    settled: dict[tuple[str, str], bool] = {}
    for (a, p), k in short.items():
        own = [j for q, j in of_anchor[a] if fits(p, q)]
        settled[a, p] = only(k, own or [j for q, j in around(a) if fits(p, q)]) if own or around(a) else False
    for (a, p), k in short.items():
        if not settled[a, p] and not any(fits(p, q) for q, _ in around(a)):
            for b in beside[a]:
                if (b, p) in short:
                    u.join(k, short[b, p])
    # A coined word alone, with or without a legal form: the one organisation of that word.
    for k, r in enumerate(rows):
        if r["kind"] == "one":
            same = [j for j in by["one", r["anchor"]] if j < k]
            if same:
                u.join(k, same[0])
            own = of_anchor[r["anchor"]] or around(r["anchor"])
            if own:
                only(k, [j for _, j in own])
            else:
                only(k, [j for (a, _), j in short.items() if a == r["anchor"]])
    for a in {r["anchor"] for r in rows if r["kind"] == "one"}:
        for b in beside[a]:
            if by["one", b] and not around(a) and not around(b):
                u.join(by["one", a][0], by["one", b][0])
    # Descriptive names, and the acronyms of those that are alone with their initials.
    long = [k for k, r in enumerate(rows) if r["kind"] == "long"]
    for x, k in enumerate(long):
        for j in long[:x]:
            if u.find(j) != u.find(k) and alike(rows[k]["parts"], rows[j]["parts"]):
                u.join(j, k)
    for k, r in enumerate(rows):
        if r["kind"] == "acronym":
            u.join(by["acronym", r["anchor"]][0], k)
            only(k, [j for j in long if rows[j]["anchor"] == r["anchor"]])
    return [u.find(k) for k in range(len(rows))]


def distinct_names(entities: DataFrame, biblio: DataFrame) -> DataFrame:
    """``name, n``: texts of PER and ORG entities as stored, and the parts of ``entities_org``, split and trimmed."""
    e = entities.select(F.explode("entities").alias("e")).filter("e.label in ('PER', 'ORG')").select(F.col("e.text").alias("name"))
    b = biblio.select(F.explode(F.split("entities_org", "[,;]")).alias("x")).select(F.trim("x").alias("name"))
    return e.unionByName(b).filter("trim(name) <> ''").groupBy("name").agg(F.count("*").alias("n"))


def classes(names: DataFrame, given: DataFrame, radius: int = 1, known: int = 5) -> DataFrame:
    """``name, class`` for every distinct name of ``names`` (columns name, n); the class is its least name.

    ``known``: a part that stands beside so many different others is a first name or a trade, not a family or a coined word.
    """
    spark = names.sparkSession
    familiar: dict[str, set[str]] = defaultdict(set)
    formal_names: set[str] = set()
    for r in given.select("given_name", "familiar_form").filter("given_name is not null and familiar_form is not null").distinct().collect():
        familiar[fold(r[1])].add(fold(r[0]))
        formal_names.add(fold(r[0]))
    familiar = dict(familiar)

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [parse(x) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.list_(pa.string()))], ["name", "n", "kind", "style", "parts"])

    table = materialize(names.select("name", F.col("n").cast("long")).mapInArrow(parsed, "name string, n long, kind string, style string, parts array<string>"), "names")
    two = table.filter("kind = 'two'")
    seen = two.select(F.col("parts")[0].alias("unit"), F.col("parts")[1].alias("other")).unionByName(two.select(F.col("parts")[1].alias("unit"), F.col("parts")[0].alias("other")))
    partners = seen.groupBy("unit").agg(F.count_distinct("other").alias("partners"))
    units = partners.unionByName(table.filter("kind in ('initial', 'one')").select(F.col("parts")[0].alias("unit"), F.lit(0).cast("long").alias("partners")))
    listed = spark.createDataFrame([(x, LISTED) for x in sorted(formal_names | set(familiar))], "unit string, partners long")
    units = units.unionByName(listed)
    units = materialize(units.groupBy("unit").agg(F.max("partners").alias("partners")).filter("length(unit) >= 2"), "units")
    close = materialize(radius_join(units.filter("length(unit) >= 4"), radius), "close")
    # A rare part beside a known first name or trade is a slip for it; what it stands for is its canonical form.
    p = units.select("unit", "partners")
    both = close.select("a", "b").unionByName(close.select(F.col("b").alias("a"), F.col("a").alias("b")))
    slips = (
        both.join(p.select(F.col("unit").alias("a"), F.col("partners").alias("pa")), "a").join(p.select(F.col("unit").alias("b"), F.col("partners").alias("pb")), "b")
        .filter((F.col("pb") >= known) & (F.col("pa") * 4 <= F.col("pb"))).groupBy("a").agg(F.max_by("b", F.struct("pb", "b")).alias("canon"), F.max("pb").alias("weight"))
    )
    slips = slips.filter(~F.col("a").endswith(".") & ~F.col("canon").endswith("."))
    # How many others a part or one within the radius stands beside: tells first names and trades, slips included, from the rest.
    beside = both.join(p.select(F.col("unit").alias("b"), "partners"), "b").groupBy("a").agg(F.max("partners").alias("beside"))
    canon = units.join(slips, units["unit"] == slips["a"], "left").select("unit", F.coalesce("canon", "unit").alias("canon"), F.coalesce("weight", "partners").alias("weight"))
    canon = canon.join(beside, canon["unit"] == beside["a"], "left").select("unit", "canon", "weight", F.greatest("weight", F.coalesce("beside", F.lit(0))).alias("wide"))

    # What stands alone, before a comma, in capitals before a first name or beside an initial is an anchor.
    sure = table.filter("kind in ('initial', 'one') or kind = 'two' and style in ('comma', 'caps')").select(F.col("parts")[0].alias("unit"), F.lit(True).alias("sure")).distinct()
    canon = canon.join(sure, "unit", "left")

    def look(col: str, at: int) -> DataFrame:
        return canon.select(F.coalesce("sure", F.lit(False)).alias(f"s{at}"), F.col("unit").alias(f"u{at}"), F.col("canon").alias(f"c{at}"), F.col("weight").alias(f"w{at}"), F.col("wide").alias(f"x{at}"))

    t = table.withColumn("u0", F.col("parts")[0]).withColumn("u1", F.when(F.size("parts") > 1, F.col("parts")[1]))
    t = t.join(look("u0", 0), "u0", "left").join(look("u1", 1), "u1", "left").select("name", "n", "kind", "style", "parts", "u0", "u1", "c0", "c1", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("w0", "w1", "x0", "x1")), *(F.coalesce(c, F.lit(False)).alias(c) for c in ("s0", "s1")))

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                kind, anchor, part = r["kind"], r["u0"], None
                if kind == "long":
                    anchor = "*" + "".join(sorted(w[0] for w in r["parts"]))
                elif kind == "acronym":
                    anchor = "*" + r["parts"][0]
                elif kind == "initial":
                    part = r["parts"][1]
                elif kind == "two":
                    is_given = [x in formal_names or x in familiar for x in (r["c0"], r["c1"])]
                    if r["style"] in ("comma", "caps"):
                        first = False
                    elif r["u0"].endswith(".") != r["u1"].endswith("."):
                        first = r["u0"].endswith(".")
                    elif is_given[0] != is_given[1] and max(r["x0"], r["x1"]) < known:
                        first = is_given[0]
                    elif r["s0"] != r["s1"] and max(r["x0"], r["x1"]) < known:
                        first = r["s1"]
                    elif r["x0"] == r["x1"]:
                        first = r["style"] != "legal"
                    else:
                        first = r["x0"] > r["x1"]
                    anchor, part = (r["u1"], r["c0"]) if first else (r["u0"], r["c1"])
                    if part.endswith("."):
                        kind = "short"
                weight = min(r["w0"], r["w1"]) if kind == "two" and part not in (r["c0"], r["c1"]) else (r["w0"] if part == r["c0"] else r["w1"])
                out.append((r["name"], r["n"], kind, anchor or "", part, r["parts"], weight, r["style"] == "legal"))
            c = list(zip(*out, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.string()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.string()), pa.array(c[3], pa.string()), pa.array(c[4], pa.string()), pa.array(c[5], pa.list_(pa.string())), pa.array(c[6], pa.int64()), pa.array(c[7], pa.bool_())], ["name", "n", "kind", "anchor", "part", "parts", "weight", "legal"])

    t = materialize(t.mapInArrow(anchored, "name string, n long, kind string, anchor string, part string, parts array<string>, weight long, legal boolean"), "anchored")
    # Familiar forms that the table lacks: first names that stand beside the same other one in most of their families.
    firsts = t.filter("kind = 'two' and not legal").select("anchor", "part").distinct()
    families = firsts.groupBy("part").agg(F.count("*").alias("families"))
    met = firsts.join(firsts.select("anchor", F.col("part").alias("q")), "anchor").filter("part <> q").groupBy("part", "q").agg(F.count("*").alias("n")).filter("n >= 2")
    learned = met.join(families, "part").join(families.select(F.col("part").alias("q"), F.col("families").alias("fq")), "q").filter("n * 2 >= families and fq > families and (substr(part, 1, 1) = substr(q, 1, 1) or substr(part, -3) = substr(q, -3))")
    learned = learned.groupBy("part").agg(F.collect_set("q").alias("forms"))
    listed_forms = frozenset(familiar)
    pairs = close.join(t.select(F.col("anchor").alias("a")).distinct(), "a").join(t.select(F.col("anchor").alias("b")).distinct(), "b").select("a", "b")
    pairs = materialize(pairs, "anchor_pairs")
    part_of = materialize(connected_components(pairs, "a", "b"), "anchor_components")
    t = t.join(part_of.select(F.col("node").alias("anchor"), "component"), "anchor", "left").withColumn("component", F.coalesce("component", "anchor"))
    t = materialize(t.join(learned, "part", "left").select("component", "name", "kind", "anchor", "part", "parts", "weight", "forms"), "to_settle")
    edges = materialize(pairs.join(part_of.select(F.col("node").alias("a"), "component"), "a").select("component", "a", "b"), "component_pairs")

    def settle(group: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        if not len(group):
            return pd.DataFrame({"name": [], "class": []})
        group = group.sort_values("name").reset_index(drop=True)
        formal = dict(familiar)
        for p, forms in zip(group["part"], group["forms"], strict=True):
            if forms is not None and p not in formal_names and p not in listed_forms:
                formal[p] = {f for f in forms if f not in listed_forms}
        of = resolve(group[["kind", "anchor", "part", "parts", "weight"]].to_dict("records"), set(zip(links["a"], links["b"], strict=True)), {k: v for k, v in formal.items() if v}, known)
        return pd.DataFrame({"name": group["name"], "class": group["name"].to_numpy()[of]})

    # Few bytes but much work: both sides are read from tables and cut into a fixed number of partitions, which isn't fitted to their size.
    n_tasks = tasks(spark)
    left, right = t.repartition(n_tasks, "component"), edges.repartition(n_tasks, "component")
    return left.groupBy("component").cogroup(right.groupBy("component")).applyInPandas(settle, "name string, class string")


def variants(entities: DataFrame, biblio: DataFrame, given: DataFrame) -> DataFrame:
    return classes(distinct_names(entities, biblio), given)


def pairs_of(members: DataFrame) -> DataFrame:
    """All pairs ``name_a < name_b`` of different spellings of one class."""
    m = members.select(F.col("name").alias("name_a"), "class")
    return m.join(members.select(F.col("name").alias("name_b"), "class"), "class").filter("name_a < name_b").select("name_a", "name_b")
