"""Scan noise: words broken at line ends, misread letters, running headers and page numbers (problem 5).

Method: symmetric-delete index over the corpus's frequency lexicon. All words of all texts are counted; every lexicon word
and every odd or rare token is entered under all strings it becomes by deleting up to two of the letters that a confusion
pair of scanning can touch, and a hash join of these gives the candidates. A weighted edit distance in which confusion pairs of scanning cost little (rn for m, 1 for l)
and any other edit too much keeps those that can be a misreading; among several, counts of the bigrams with the words
beside the token decide. Broken words are joined where the lexicon has the whole; headers are the name of the text's own
paper in capitals or beside a date, page numbers the forms they take on a line of their own or between words.

Defined results: null and blank fields have no row; texts of which less than half is sentences are no case and stay as
they are; rows equal in key and text give one row; texts are read whole; papers without a name give no headers.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import combinations

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, tasks
from .prose import is_prose, sentences
from .quality import common_words

#: What scanning makes of letters, as (seen, meant).
CONFUSIONS = (
    ("1", "l"), ("1", "i"), ("|", "l"), ("|", "i"), ("0", "o"), ("5", "s"), ("6", "é"), ("6", "b"), ("8", "b"), ("9", "g"), ("9", "q"), ("3", "e"),
    ("@", "a"), ("†", "t"), ("ν", "v"), ("c", "e"), ("c", "é"), ("e", "c"), ("rn", "m"), ("m", "rn"), ("m", "in"), ("in", "m"), ("ii", "u"), ("li", "h"), ("cl", "d"), ("d", "cl"),
    ("vv", "w"), ("im", "nn"), ("e'", "é"), ("e'", "è"), ("ê", "è"), ("é", "ê"), ("è", "ê"), ("u'", "û"),
)
MEANT: dict[str, list[str]] = {}
for _seen, _meant in CONFUSIONS:
    MEANT.setdefault(_seen, []).append(_meant)
#: Single letters and pairs of the seen sides, and of the meant ones.
SIDES = {side: tuple(frozenset(x[side] for x in CONFUSIONS if len(x[side]) == n) for n in (1, 2)) for side in (False, True)}
#: What is misread for fewer letters than it has.
LONGER = [seen for seen, meant in CONFUSIONS if len(seen) > len(meant)]
SIGNS = "0135689@|†ν"
EDGES = " .,;:!?«»()\"“”„[]…*\t\n\r"
ELISION = re.compile(r"^(?:[cdjlmnst]|qu|jusqu|lorsqu|puisqu|presqu|quelqu|aujourd|un|all|dell|nell|dall|sull)['’](?=[^\W_@|†])", re.I)
ODD = re.compile(rf"[^\W\d_][{SIGNS}]|[{SIGNS}][^\W\d_]|[^\W\d_]'[^\W\d_]")
#: Letters up to which all deletions are entered.
LONG = 40
#: Marks the entry of a plain word's occurrences with capitals.
CAPITAL = "\x02"
PLAIN = re.compile(r"[^\W\d_]{2,}")
#: A broken word; a page's number can have come between its pieces.
BREAK = re.compile(r"(?<![^\W\d_])([^\W\d_]{2,})(-|–|¬|\xad)([ \t]*\r?\n\s*|[ \t]+)(?:\d{1,4}[ \t]*\s)?([^\W\d_]{2,})")
PAGE = re.compile(
    r"(?m)^[ \t]*(?:Page \d{1,4}|p\. ?\d{1,4} / \d{1,4}|[-–—] ?\d{1,4} ?[-–—]|\[\d{1,4}\])[ \t]*$"
    r"|(?<!\S)(?:(?<!Suite )(?<!suite )Page \d{1,4}(?=\s|$)|p\. \d{1,4} / \d{1,4}(?!\S)|(?:— \d{1,4} —|- \d{1,4} -)(?!\S)|\[\d{1,4}\](?!\S))"
)
#: Without the first no word is broken, without the second there is no page number: what most texts are spared.
MARK = re.compile(r"[-–¬\xad]\s")
NUMBERED = re.compile(r"[Pp](?:age |\. ?)\d|[-–—\[] ?\d")
DATE = r"\d{1,2}(?:er|\.)? [^\W\d_]{3,9} \d{4}"


def core(token: str) -> str:
    """A token without signs at its edges and without an elided word before it, in lower case."""
    t = token.strip(EDGES)
    m = ELISION.match(t)
    return (t[m.end() :] if m else t).lower()


def is_word(c: str) -> bool:
    return bool(PLAIN.fullmatch(c)) and (len(c) > 3 or not ODD.search(c)) or "-" in c


def entry(token: str, c: str) -> str:
    """Where the misreadings of a token of core ``c`` are kept: plain words in lower case and with capitals apart."""
    return c if c in token or not is_word(c) else c + CAPITAL


class Cores(dict):
    """Core and entry of each token, worked out once; emptied when it has grown large."""

    def __missing__(self, token: str) -> tuple[str, str]:
        if len(self) > 200_000:
            self.clear()
        c = core(token)
        self[token] = out = c, entry(token, c)
        return out


class Furniture:
    """Headers and page numbers. ``papers`` are names of papers to look for in texts whose own paper isn't known."""

    def __init__(self, papers: list[str] = ()):
        self.papers = sorted({p.strip() for p in papers if p and p.strip()}, key=lambda p: (-len(p), p))
        self.made: dict[str, re.Pattern] = {}

    def pattern(self, paper: str) -> re.Pattern:
        if paper not in self.made:
            if len(self.made) > 5000:
                self.made.clear()
            p, up = re.escape(paper), re.escape(paper.upper())
            self.made[paper] = re.compile(
                rf"(?<!\S){up}(?:[ \t]+\d{{1,4}})?(?=\s|$)|\|[ \t]*{p}[ \t]*\|[ \t]*{DATE}(?:\s+\d{{1,4}}(?=\s|$))?|(?<!\S){p} — {DATE}(?:\s+\d{{1,4}}(?=\s|$))?|(?<!\S){DATE}, {p}(?:\s+\d{{1,4}}(?=\s|$))?(?!\w)"
            )
        return self.made[paper]

    def strip(self, text: str, paper: str | None = None) -> tuple[str, int]:
        """The text without furniture, of its own ``paper``, and how many pieces of it there were."""
        n = 0
        for p in [paper] if paper else self.papers:
            if p in text or p.upper() in text:
                text, k = self.pattern(p).subn("\x00", text)
                n += k
        if NUMBERED.search(text):
            text, k = PAGE.subn("\x00", text)
            n += k
        if n:
            # Numbers left beside what was taken out belong to it.
            text = re.sub(r"\x00(?:\s*\x00|[ \t]*\r?\n[ \t]*\d{1,3}[ \t]*(?=\r?\n|$))*", "\x00", text)
            text = re.sub(r"[ \t]*\r?\n?[ \t]*\x00[ \t]*(?:\r?\n)?", lambda m: "\n" if "\n" in m.group() else " ", text)
        return text, n


def deletes(word: str, most: int = 2, at: list[int] | None = None) -> set[str]:
    """The word without up to ``most`` of its letters, or of those at ``at``."""
    n = len(word)
    out = {word}
    for d in range(1, min(most, n - 1) + 1):
        for gone in combinations(range(n) if at is None else at, d):
            out.add("".join([c for k, c in enumerate(word) if k not in gone]))
    return out


def open_places(word: str, meant: bool) -> list[int]:
    """Where a confusion pair's seen (or meant) side stands in a word: no other letters differ between a word and its misreading."""
    ones, pairs = SIDES[meant]
    twos = [k for k in range(len(word) - 1) if word[k : k + 2] in pairs]
    return sorted({k for k, c in enumerate(word) if c in ones} | set(twos) | {k + 1 for k in twos})


def meanings(seen: str, most: int = 3) -> set[str]:
    """All strings that ``seen`` can be a misreading of, by at most ``most`` confusions."""
    out, now = set(), {("", 0)}
    for _ in range(most):
        then = set()
        for done, i in now:
            for j in range(i, len(seen)):
                for w in (1, 2):
                    for m in MEANT.get(seen[j : j + w], ()) if j + w <= len(seen) else ():
                        then.add((done + seen[i:j] + m, j + w))
        out.update(done + seen[i:] for done, i in then)
        now = then
    return out - {seen}


def index_keys(word: str, meant: bool, slack: int = 3) -> set[str]:
    """The strings under which a word is entered: what deletions make of it and, of long words, quarters with their place.

    Of words under five letters deletions leave too little: they are entered under all that they can be misreadings of,
    as are somewhat longer ones for meant words under four letters; meant words of that length stand under themselves.
    """
    n, out = len(word), set()
    if (4 if meant else 5) <= n <= LONG + (slack if meant else 0):
        out = {x for x in deletes(word, at=open_places(word, meant)) if len(x) > 2}
    if not meant and (n < 5 or n < 4 + slack and sum(map(word.count, LONGER)) >= n - 3):
        out.update(f"={x}" for x in meanings(word) if n < 5 or len(x) < 4)
    if meant and n < 5 + slack:
        out.add(f"={word}")
    if not meant and n > LONG:
        out.update(f"{n} {k} {word[k * n // 4 : (k + 1) * n // 4]}" for k in range(4))
    if meant:
        for m in range(max(LONG + 1, n - slack), n + slack + 1):
            for k in range(4):
                a, z = k * m // 4, (k + 1) * m // 4
                out.update(f"{m} {k} {word[a + d : z + d]}" for d in range(-slack, slack + 1) if a + d >= 0)
    return out


def misreading(seen: str, meant: str, price: float = 0.4, limit: float = 1.3) -> float | None:
    """Cost of taking ``meant`` for ``seen`` by confusion pairs alone; None beyond ``limit``."""
    best = [None] * (len(seen) + 1)
    best[0] = {0: 0.0}
    for i in range(len(seen)):
        for j, cost in list((best[i] or {}).items()):
            steps = []
            if j < len(meant) and seen[i] == meant[j]:
                steps.append((1, 1, 0.0))
            for w in (1, 2):
                for m in MEANT.get(seen[i : i + w], ()) if i + w <= len(seen) else ():
                    if meant.startswith(m, j):
                        steps.append((w, len(m), price))
            for di, dj, c in steps:
                if cost + c <= limit:
                    row = best[i + di] = best[i + di] or {}
                    row[j + dj] = min(row.get(j + dj, 9.0), cost + c)
    return (best[len(seen)] or {}).get(len(meant))


def with_paper(docs: DataFrame, fields: list[str], key: str, paper: str, most: int) -> DataFrame:
    """``key, p, f0, f1, ...``: the fields and the name of each row's own paper.

    Where it is missing, it is the most frequent one of the journal in the key (``<kind>_<date>_<journal>_<hash>_<suffix>``).
    The table of journals, an entry for each title of the archive, is broadcast up to ``most`` rows.
    """
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.nullif(F.trim(F.col(f"`{paper}`")), F.lit("")).alias("p"), *(F.col(f"`{f}`").alias(f"f{k}") for k, f in enumerate(fields)))
    if docs.schema[key].dataType.simpleString() != "string":
        return rows
    rows = rows.withColumn("journal", F.regexp_extract("key", r"^[^_]*_[^_]*_(.+)_[^_]*_[^_]*$", 1))
    known = rows.filter("p is not null and journal <> ''").groupBy("journal", "p").agg(F.count("*").alias("n"))
    known = materialize(known.groupBy("journal").agg(F.max_by("p", F.struct("n", "p")).alias("usual")), "journals")
    rows = rows.join(F.broadcast(known) if known.count() <= most else known, "journal", "left")
    return rows.select("key", F.coalesce("p", "usual").alias("p"), *(f"f{k}" for k in range(len(fields))))


def _texts(b: pa.RecordBatch) -> Iterator[tuple[str | None, list[str]]]:
    """The paper and the different texts of each row."""
    cols = {n: c.to_pylist() for n, c in zip(b.schema.names, b.columns, strict=True)}
    for p, *row in zip(cols["p"], *(cols[f"f{k}"] for k in range(sum(n[0] == "f" for n in cols))), strict=True):
        yield p, list({x for x in row if x})


def counts(texts: DataFrame) -> DataFrame:
    """``kind, a, b, n``: words (kind w), odd tokens (o) and broken words (b: the two pieces) of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        furniture = Furniture()
        for batch in batches:
            words: Counter = Counter()
            pieces: Counter = Counter()
            for p, x in ((p, x) for p, xs in _texts(batch) for x in xs):
                x, _ = furniture.strip(x, p)
                if MARK.search(x):
                    found = BREAK.findall(x)
                    if found:
                        pieces.update((a.lower(), b.lower()) for a, _, _, b in found)
                        x = BREAK.sub(" ", x)
                words.update(x.split())
            w: Counter = Counter()
            o: Counter = Counter()
            for t, n in words.items():
                c = core(t)
                if is_word(c):
                    # Occurrences with capitals are kept apart from those in lower case.
                    w[c, "N" if entry(t, c) != c else ""] += n
                elif len(c) > 2 and ODD.search(c):
                    o[c, ""] += n
            rows = [("w", *k, n) for k, n in w.items()] + [("o", *k, n) for k, n in o.items()] + [("b", *k, n) for k, n in pieces.items()]
            c = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.string()), pa.array(c[1], pa.string()), pa.array(c[2], pa.string()), pa.array(c[3], pa.int64())], ["kind", "a", "b", "n"])

    return texts.drop("key").mapInArrow(run, "kind string, a string, b string, n long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))


def corrections(table: DataFrame) -> DataFrame:
    """``token, meant, cost, n, strict`` of every entry that can be a misreading of a lexicon word.

    Occurrences in lower case are judged by their own count, so that capitals elsewhere don't keep them; where the token
    with its capitals is too frequent for a slip (a name), the candidate is ``strict``: only the words beside it can decide
    for it. Occurrences with capitals are judged by the whole count, as a word begins sentences in any form. Words under
    five letters are like too many others: their candidates are 200 times as frequent, and strict. Words over ``LONG``
    letters, which have too many strings to become by deletions, are entered under their quarters instead: of four one is
    untouched where three letters or pairs at most are misread, and stands in the meant word at most three places off.
    """
    words = table.filter("kind = 'w'").groupBy("a").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("b") == "", F.col("n")).otherwise(0)).alias("lower"))
    lexicon = words.filter("n >= 3 and instr(a, '-') = 0").select("a", "n")
    plain = words.filter("length(a) >= 2 and instr(a, '-') = 0").select("a", "n", "lower", F.lit(False).alias("odd"))
    odd = table.filter("kind = 'o' and length(a) >= 3").select("a", "n", F.col("n").alias("lower"), F.lit(True).alias("odd"))

    def entries(meant: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import xxhash

            for b in batches:
                for s in range(0, b.num_rows, 4000):
                    part = b.slice(s, 4000)
                    keys, at = [], []
                    for k, w in enumerate(part.column(0).to_pylist()):
                        d = [xxhash.xxh64_intdigest(x) - 2**63 for x in index_keys(w, meant)]
                        keys += d
                        at += [k] * len(d)
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *(c.take(pa.array(at, pa.int32())) for c in part.columns)], ["key", *part.schema.names])

        return run

    n_tasks = tasks(table.sparkSession)
    right = lexicon.repartition(n_tasks).mapInArrow(entries(True), "key long, a string, n long").select("key", F.col("a").alias("meant"), F.col("n").alias("m"))
    left = plain.unionByName(odd).repartition(n_tasks).mapInArrow(entries(False), "key long, a string, n long, lower long, odd boolean")
    m, n, low = F.col("m"), F.col("n"), F.col("lower")
    short = ~F.col("odd") & (F.length("a") < 5) | (F.length("meant") < 4)
    ratio = F.when(short, 200).otherwise(20)
    met = left.join(right, "key").filter((F.col("a") != F.col("meant")) & (F.col("odd") & ~short & (m >= n) | (~F.col("odd") | short) & (m >= 10) & (m >= ratio * F.when(low > 0, low).otherwise(n)))).drop("key").distinct()
    small = met.filter(F.col("odd") | (low > 0)).select("a", "meant", "m", F.col("a").alias("token"), (short | ~F.col("odd") & (m < 20 * n)).alias("strict"))
    capitals = met.filter(~F.col("odd") & (n > low) & (m >= ratio * n)).select("a", "meant", "m", F.concat("a", F.lit(CAPITAL)).alias("token"), short.alias("strict"))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cost = [misreading(x, y) for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            keep = pa.array([c is not None for c in cost], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(3), b.column(1), pa.array(cost, pa.float64()), b.column(2), b.column(4)], ["token", "meant", "cost", "n", "strict"]).filter(keep)

    return small.unionByName(capitals).mapInArrow(weigh, "token string, meant string, cost double, n long, strict boolean")


def joins(table: DataFrame) -> DataFrame:
    """``a, b`` of the broken words whose whole the lexicon has, more often than their compound with a hyphen."""
    words = table.filter("kind = 'w'").groupBy("a").agg(F.sum("n").alias("n"))
    b = table.filter("kind = 'b'").select(F.col("a").alias("left"), F.col("b").alias("right"))
    whole = b.join(words.select(F.col("a").alias("w"), F.col("n").alias("whole")), F.concat("left", "right") == F.col("w"))
    return whole.join(words.select(F.col("a").alias("c"), F.col("n").alias("compound")), F.concat_ws("-", "left", "right") == F.col("c"), "left").filter("whole > coalesce(compound, 0)").select(F.concat_ws(" ", "left", "right").alias("token"))


def with_breaks(texts: DataFrame, broken: DataFrame, most: int) -> tuple[DataFrame, Broadcast | None]:
    """The texts and the broken words for the tasks; over ``most`` of these, each row gets its own as ``broken`` by a join."""
    if broken.count() <= most:
        return texts, texts.sparkSession.sparkContext.broadcast({r[0] for r in broken.collect()})
    cols = ["p", *(c for c in texts.columns if re.fullmatch(r"f\d+", c))]
    texts = texts.withColumn("h", F.xxhash64(*texts.columns)) if "h" not in texts.columns else texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        furniture = Furniture()
        for b in batches:
            got = []
            for h, p, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                got += [(h, t) for t in {f"{m[0].lower()} {m[3].lower()}" for x in {x for x in row if x} for m in BREAK.findall(furniture.strip(x, p)[0])}]
            c = list(zip(*got, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.string())], ["h", "token"])

    own = texts.select("h", *cols).mapInArrow(run, "h long, token string").join(broken, "token").groupBy("h").agg(F.collect_set("token").alias("broken"))
    return texts.join(own, "h", "left").select(*texts.columns, "broken"), None


def _broken_rows(b: pa.RecordBatch, r: Repairer, pieces: Broadcast | None) -> Iterator[tuple[str | None, str]]:
    """The paper and the different texts of each row; ``r`` knows the broken words of the row meanwhile."""
    if pieces:
        r.broken = pieces.value
    own = [()] * b.num_rows if pieces else b.column("broken").to_pylist()
    for parts, (p, xs) in zip(own, _texts(b), strict=True):
        if not pieces:
            r.broken = set(parts or ())
        for x in xs:
            yield p, x


def decisions(texts: DataFrame, fixes: DataFrame, broken: DataFrame, most: int) -> DataFrame:
    """``key, meant`` for every context of a token with several candidates; the key is the word before, the token, the word after.

    A candidate's score is what its misreading costs less what the corpus's bigrams with the words beside it are worth; one
    that is strict needs both. The words whose contexts (tokens) and bigrams (candidates) are counted are known to the
    tasks up to ``most`` of them; beyond, all are counted and joined. Contexts are those of the texts after broken words
    are joined, as the repair meets them.
    """
    several = materialize(fixes.filter((F.size("found") > 1) | F.exists("found", lambda x: x["strict"])), "several")
    options = several.select("token", F.inline("found"))
    wanted = several.select(F.lit("t").alias("kind"), F.col("token").alias("w")).unionByName(options.select(F.explode(F.array(F.lit("l"), F.lit("r"))).alias("kind"), F.col("meant").alias("w"))).distinct()
    known = texts.sparkSession.sparkContext.broadcast({k: frozenset(r[1] for r in got if r[0] == k) for got in [wanted.collect()] for k in "tl"}) if wanted.count() <= most else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, cores = Repairer([], frozenset(), {}, set(), {}), Cores()
        tokens, meant = (known.value["t"], known.value["l"]) if known else (None, None)
        for b in batches:
            seen: Counter = Counter()
            bigrams: Counter = Counter()
            for p, x in _broken_rows(b, r, pieces):
                x, _, _ = r.whole(x, p)
                both = [cores[t] for t in x.split()]
                t = ["", *(c for c, _ in both), ""]
                for k in range(len(both)) if tokens is None else [k for k, ce in enumerate(both) if ce[1] in tokens]:
                    seen["t", t[k], both[k][1], t[k + 2]] += 1
                bigrams.update(zip(t, t[1:], strict=False))
            for (u, v), n in bigrams.items():
                if v and (meant is None or v in meant):
                    seen["l", u, v, ""] += n
                if u and (meant is None or u in meant):
                    seen["r", "", u, v] += n
            c = list(zip(*((*k, n) for k, n in seen.items()), strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.string()) for x in c[:4]), pa.array(c[4], pa.int64())], ["kind", "before", "w", "after", "n"])

    texts, pieces = with_breaks(texts.drop("key"), broken, most)
    seen = texts.mapInArrow(run, "kind string, before string, w string, after string, n long")
    seen = seen if known else seen.join(wanted, ["kind", "w"], "left_semi")
    seen = materialize(seen.groupBy("kind", "before", "w", "after").agg(F.sum("n").alias("n")), "contexts")
    left = seen.filter("kind = 'l'").select("before", F.col("w").alias("meant"), F.col("n").alias("n_before"))
    right = seen.filter("kind = 'r'").select(F.col("w").alias("meant"), "after", F.col("n").alias("n_after"))
    rows = seen.filter("kind = 't'").select("before", F.col("w").alias("token"), "after").join(options, "token")
    rows = rows.join(left, ["before", "meant"], "left").join(right, ["meant", "after"], "left")
    rows = rows.filter("not strict or n_before > 0 and n_after > 0")
    score = 0.3 * (F.coalesce("n_before", F.lit(0)) > 0).cast("double") + 0.3 * (F.coalesce("n_after", F.lit(0)) > 0).cast("double") - F.col("cost")
    return rows.groupBy(F.concat_ws("\t", "before", "token", "after").alias("key")).agg(F.max_by("meant", F.struct(score.alias("s"), "n", "meant")).alias("meant"))


class Repairer:
    """Finds and repairs noise: ``fixes`` entry -> [(meant, cost, n, strict)], ``broken`` pairs ``left right`` that are one word."""

    def __init__(self, papers: list[str], common: frozenset[str], fixes: dict[str, list[tuple]], broken: set[str], decided: dict[str, str]):
        self.furniture, self.common, self.fixes, self.broken, self.decided = Furniture(papers), common, fixes, broken, decided
        self.cores = Cores()

    def choose(self, token: str, before: str, after: str) -> str | None:
        """What the token means here; None where only the words beside it could decide for a candidate and don't."""
        found = self.fixes[token]
        if len(found) > 1 or any(found[0][3:]):
            meant = self.decided.get(f"{before}\t{token}\t{after}")
            if meant:
                return meant
        return max((f for f in found if not any(f[3:])), key=lambda f: (-f[1], f[2], f[0]), default=(None,))[0]

    def is_broken(self, m: re.Match) -> bool:
        a, mark, _, b = m.groups()
        if mark in "¬\xad":
            return a[1:].islower() or a.isupper()
        return b[0].islower() == (not a.isupper()) and f"{a.lower()} {b.lower()}" in self.broken

    def whole(self, text: str, paper: str | None = None) -> tuple[str, int, int]:
        """The text without furniture and with its broken words joined; pieces of furniture, broken words."""
        x, furniture = self.furniture.strip(text, paper)
        breaks = 0

        def join(m: re.Match) -> str:
            nonlocal breaks
            if not self.is_broken(m):
                return m.group()
            breaks += 1
            return m.group(1) + m.group(4)

        if MARK.search(x):
            x = BREAK.sub(join, x)
        return x, furniture, breaks

    def repair(self, text: str, paper: str | None = None) -> tuple[str, int, int, int] | None:
        """``(text, broken words, misread words, pieces of furniture)``; None for what is no prose."""
        x, furniture, breaks = self.whole(text, paper)
        both = [self.cores[t] for t in x.split()]
        found, fixes = {}, self.fixes
        for k in [k for k, ce in enumerate(both) if ce[1] in fixes]:
            c, e = both[k]
            new = self.choose(e, both[k - 1][0] if k else "", both[k + 1][0] if k + 1 < len(both) else "")
            if new:
                found[k] = c, new
        if not (furniture or breaks or found):
            return (text, 0, 0, 0)
        if sum(e - b for b, e, ended in sentences(x) if is_prose(x[b:e], self.common, ended)) < 0.5 * len(x):
            return None
        parts = re.split(r"(\s+)", x) if found else [x]
        words = [k for k in range(0, len(parts), 2) if parts[k]]
        for at, (c, new) in found.items():
            k = words[at]
            low = parts[k].lower()
            s = low.rfind(c)
            old = parts[k][s : s + len(c)]
            letter = next((y for y in old if y.isalpha()), "a")
            new = new.upper() if sum(map(str.isupper, old)) > 1 and not any(map(str.islower, old)) else new.capitalize() if letter.isupper() and old[0] in (letter, *SIGNS) else new
            parts[k] = parts[k][:s] + new + parts[k][s + len(c) :]
        letters = len(found)
        x = "".join(parts)
        return (self.paragraphs(x), breaks, letters, furniture)

    @staticmethod
    def paragraphs(text: str) -> str:
        """Printed lines run together; blank lines, and ends of sentences before a short line's end, part paragraphs."""
        out = []
        for block in re.split(r"\n\s*\n", text):
            lines = [x for x in (" ".join(y.split()) for y in block.split("\n")) if x]
            width = max(map(len, lines), default=0)
            para = ""
            for line in lines:
                if para and (para[-1] not in ".!?…»" or width < 75 and len(line_before) > 0.8 * width):
                    para += " " + line
                else:
                    if para:
                        out.append(para)
                    para = line
                line_before = line
            if para:
                out.append(para)
        return "\n\n".join(out)


def find(docs: DataFrame, words: DataFrame, fields: list[str], key: str = "id", paper: str = "source", restore: bool = False, most: int = 400_000) -> DataFrame:
    """``key, field`` of the fields with noise, one row each; with ``restore`` also ``repaired`` and what was found.

    The tables of misread and broken words go to the tasks that read the texts as long as they have at most ``most`` rows
    (tens of MB); larger ones are joined with the tokens by shuffle, so that each text gets its part of them.
    """
    spark = docs.sparkSession
    rows = with_paper(docs, fields, key, paper, most)
    common = frozenset().union(*common_words(words).values())
    table = materialize(counts(rows), "scan_counts")
    fixes = materialize(corrections(table).groupBy("token").agg(F.collect_list(F.struct("meant", "cost", "n", "strict")).alias("found")), "fixes")
    broken = materialize(joins(table).distinct(), "broken")
    decided = materialize(decisions(rows, fixes, broken, most), "decided")
    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, field string" + (", repaired string, n_broken int, n_misread int, n_furniture int" if restore else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def emit(rows: list[tuple], first: pa.DataType) -> pa.RecordBatch:
        c = list(zip(*rows, strict=True)) or [()] * len(names)
        kinds = [first, pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, kinds, strict=False)], names)

    def judge(repairer: Repairer, k, p: str | None, texts: list) -> list[tuple]:
        out, done = [], {}
        for f, x in zip(fields, texts, strict=True):
            if x and not x.isspace():
                if x not in done:
                    done[x] = repairer.repair(x, p)
                r = done[x]
                if r and sum(r[1:]):
                    out.append((k, f, *r) if restore else (k, f))
        return out

    if fixes.count() + broken.count() + decided.count() <= most:
        shared = spark.sparkContext.broadcast(({r[0]: [tuple(x) for x in r[1]] for r in fixes.collect()}, {r[0] for r in broken.collect()}, {r[0]: r[1] for r in decided.collect()}))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            r = Repairer([], common, *shared.value)
            for b in batches:
                out = []
                for k, p, *texts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    out += judge(r, k, p, texts)
                yield emit(out, b.schema.field(0).type)

        return rows.mapInArrow(run, schema).distinct().withColumnRenamed("key", key)

    cols = ["p", *(f"f{k}" for k in range(len(fields)))]
    rows = rows.withColumn("h", F.xxhash64("key", *cols))
    rows, pieces = with_breaks(rows, broken, most)
    extra = [] if pieces else ["broken"]

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, cores = Repairer([], frozenset(), {}, set(), {}), Cores()
        if pieces:
            r.broken = pieces.value
        for b in batches:
            got = []
            own = [()] * b.num_rows if pieces else b.column("broken").to_pylist()
            for h, parts, p, *texts in zip(b.column("h").to_pylist(), own, *(b.column(c).to_pylist() for c in cols), strict=True):
                if not pieces:
                    r.broken = set(parts or ())
                found = set()
                for x in {x for x in texts if x}:
                    # Tokens and contexts as the repair meets them, after broken words are joined.
                    both = [cores[t] for t in r.whole(x, p)[0].split()]
                    t, e = ["", *(c for c, _ in both), ""], [e for _, e in both]
                    found.update(e)
                    found.update(map("\t".join, zip(t, e, t[2:], strict=False)))
                got += [(h, t) for t in found]
            c = list(zip(*got, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.string())], ["h", "token"])

    none = F.lit(None).cast(fixes.schema["found"].dataType).alias("found")
    both = fixes.select("token", "found", F.lit(None).cast("string").alias("meant")).unionByName(decided.select(F.col("key").alias("token"), none, "meant"))
    parts = rows.select("h", *cols, *extra).mapInArrow(tokens, "h long, token string").join(both, "token").groupBy("h").agg(F.collect_list(F.struct("token", "found", "meant")).alias("t"))

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Repairer([], common, {}, set(), {})
        for b in batches:
            out = []
            own = [()] * b.num_rows if pieces else b.column("broken").to_pylist()
            for k, t, parts, p, *texts in zip(b.column("key").to_pylist(), b.column("t").to_pylist(), own, *(b.column(c).to_pylist() for c in cols), strict=True):
                r.fixes = {x["token"]: [(y["meant"], y["cost"], y["n"], y["strict"]) for y in x["found"]] for x in t or () if x["found"] is not None}
                r.broken = pieces.value if pieces else set(parts or ())
                r.decided = {x["token"]: x["meant"] for x in t or () if x["meant"] is not None}
                out += judge(r, k, p, texts)
            yield emit(out, b.schema.field(0).type)

    return rows.join(parts, "h", "left").select("key", *cols, "t", *extra).mapInArrow(run_joined, schema).distinct().withColumnRenamed("key", key)
