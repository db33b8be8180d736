"""Text that was decoded with the wrong character encoding (problem 4).

Method: the corpus's distinct words with other than ASCII letters are counted over all texts; every clean one is sent
through all encoding chains (bytes of one encoding read as another, once or twice, also with final loss), which gives a
table garbled form -> original; the tokens of the corpus are hash-joined with it. A match is verified by counts: the
original must be the more frequent by far, unless the garbled form holds signs no word has. Tokens that garbling made
unique (names, figures) are restored from the same table made of the single characters of the clean words, where a
character's form has at least two signs and can't be read otherwise.

Defined results: null and empty texts are clean; a field whose loss is final is found, and restored where a clean word
fits; rows equal in key and texts give one row; rightly written foreign letters stay; the texts are read whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Letters of which every choice to lose is listed; words with more are compared letter by letter.
FEW = 4
LOST = "�"
#: Encodings in which the bytes of UTF-8 were misread, and single-byte encodings taken for one another.
READ_AS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "iso8859_15")
WRITTEN = ("cp1252", "mac_roman", "cp850", "cp437")
EDGES = " .,;:!\"'()[]<>*/|-=+_"
SPACE = re.compile(r"[ \t\r\n\x0b\x0c]+")
SOLID = re.compile(r"[^ \t\r\n\x0b\x0c]+")
QUESTION = re.compile(r"(?<![^\W\d_]{1})\?(?=[^\W\d_]{2})|(?<=[^\W\d_])\?(?=[^\W\d_])")
DIGITS = str.maketrans("123456789", "000000000")
#: Signs besides letters that clean words and figures have.
SIGNS = frozenset("’‘“”„«»–—…•°²³½¼¾§№€£©®±×·  ")


@lru_cache(maxsize=32)
def reading(encoding: str) -> dict[int, str]:
    """Byte -> character; bytes without one stand for themselves, as browsers have it."""
    return {b: c for b in range(128, 256) if (c := bytes([b]).decode(encoding, "ignore") or chr(b)) != chr(b)}


def misread(data: bytes, encoding: str) -> str:
    return data.decode("latin-1").translate(reading(encoding))


def chains(word: str) -> dict[str, str]:
    """Garbled form -> the chain that makes it, for every chain that the word can go through."""
    out: dict[str, str] = {}
    raw = word.encode()
    for d in READ_AS:
        once = misread(raw, d)
        out.setdefault(once, f"utf-8 > {d}")
        if d in ("cp1252", "latin-1"):
            for e in ("cp1252", "latin-1"):
                out.setdefault(misread(once.encode(), e), f"utf-8 > {d} > utf-8 > {e}")
    for s in WRITTEN:
        try:
            data = word.encode(s)
        except UnicodeEncodeError:
            continue
        for d in READ_AS[:-1]:
            if d != s:
                out.setdefault(misread(data, d), f"{s} > {d}")
        if s == "cp1252":
            out.setdefault(data.decode("utf-8", "replace"), "cp1252 > utf-8")
    # Letters are lost one by one, too: every choice of them; of more than FEW only all, ``lost_letters`` finds the others.
    wide = [k for k, c in enumerate(word) if not c.isascii()]
    for m in range(1, 1 << len(wide)) if len(wide) <= FEW else ((1 << len(wide)) - 1,):
        gone = {k for j, k in enumerate(wide) if m >> j & 1}
        out.setdefault("".join("?" if k in gone else c for k, c in enumerate(word)), "> ascii")
    spaced = {SPACE.sub(" ", g.replace(" ", " ")).strip(EDGES): c for g, c in out.items() if " " in g}
    for g, c in spaced.items():
        if g and " " not in g:
            out.setdefault(g, c)
    return {g: c for g, c in out.items() if g != word and g.strip(EDGES)}


def forms_of(token: str) -> list[str]:
    """The forms a token is looked up by: a question mark at its end can be a lost letter or a mark."""
    kept = token.strip(EDGES).translate(DIGITS)
    bare = kept.rstrip("?")
    return [kept] if kept == bare else [kept, bare]


def looks_clean(word: str) -> bool:
    """Whether a word has no signs but letters of European languages and usual typography."""
    return all(c < "ɐ" and (c.isalnum() or c in "'’-.&") or c in SIGNS for c in word) and not any("\x80" <= c <= "\x9f" for c in word)


def all_letters(word: str) -> bool:
    """Whether a form could be a word of some language as it stands."""
    return all(c.isascii() or c == "’" or (c < "ɐ" and c.isalpha()) for c in word) and "?" not in word


def marked(text: str) -> Counter:
    """The tokens of a text that can be garbled: with other than ASCII characters, or a question mark inside."""
    return Counter(t for t in text.encode("utf-8", "replace").split() if not t.isascii() or b"?" in t[:-1])


def words_of(tokens: Counter) -> Counter:
    out: Counter = Counter()
    for t, n in tokens.items():
        t = t.decode()
        if t.isascii() and not QUESTION.search(t):
            continue
        for w in forms_of(t):
            if w:
                out[w] += n
    return out


def vocabulary(docs: DataFrame, fields: list[str]) -> DataFrame:
    """``word, n`` over all texts; counted in the tasks that read them before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens: Counter = Counter()
            for col in b.columns:
                for x in col.to_pylist():
                    if x and (not x.isascii() or "?" in x):
                        tokens.update(marked(x))
            w = words_of(tokens)
            yield pa.RecordBatch.from_arrays([pa.array(list(w), pa.string()), pa.array(list(w.values()), pa.int64())], ["word", "n"])

    return docs.select(*(F.col(f"`{f}`") for f in fields)).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def garbled_forms(vocab: DataFrame) -> DataFrame:
    """``garbled, original, chain, n`` for every clean word and its capitals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if w.isascii() or not looks_clean(w):
                    continue
                for form in {w, w.upper()}:
                    rows += [(g, form, c, n) for g, c in chains(form).items()]
            c = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.string()), pa.array(c[1], pa.string()), pa.array(c[2], pa.string()), pa.array(c[3], pa.int64())], ["garbled", "original", "chain", "n"])

    return vocab.mapInArrow(run, "garbled string, original string, chain string, n long")


def lost_letters(vocab: DataFrame) -> DataFrame:
    """``garbled, original, chain, n_garbled, n`` of the tokens that are a word with more than ``FEW`` letters beyond ASCII, some of them lost.

    Word and token meet in the form in which all such letters are lost; then each sign must be the word's or lost.
    """
    wide = F.length(F.regexp_replace("word", r"[\x00-\x7f]", "")) > FEW
    every = F.regexp_replace("word", r"[^\x00-\x7f]", "?").alias("form")
    clean = vocab.filter(wide).filter("instr(word, '?') = 0")
    clean = clean.unionByName(clean.select(F.upper("word").alias("word"), "n")).distinct().select(every, F.col("word").alias("original"), "n")
    seen = vocab.filter("instr(word, '?') > 0").select(every, F.col("word").alias("garbled"), F.col("n").alias("n_garbled"))
    fits = F.forall(F.sequence(F.lit(1), F.length("original")), lambda k: (F.substring("garbled", k, F.lit(1)) == "?") | (F.substring("garbled", k, F.lit(1)) == F.substring("original", k, F.lit(1))))
    return seen.join(clean, "form").filter((F.length("garbled") == F.length("original")) & fits).select("garbled", "original", F.lit("> ascii").alias("chain"), "n_garbled", "n")


def repairs(docs: DataFrame, fields: list[str]) -> tuple[DataFrame, list[tuple[str, str]]]:
    """The verified table ``garbled, original, chain``, and the forms of single characters, longest first."""
    vocab = materialize(vocabulary(docs, fields), "words")

    def plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g, o, ng, no = (b.column(i).to_pylist() for i in (0, 1, 3, 4))
            keep = [y >= (30 * x if all_letters(a) else x if "?" not in a and LOST not in a else 2 * x) for a, _, x, y in zip(g, o, ng, no, strict=True)]
            yield b.filter(pa.array(keep, pa.bool_()))

    seen = vocab.select(F.col("word").alias("garbled"), F.col("n").alias("n_garbled"))
    forms = garbled_forms(vocab).join(seen, "garbled").select("garbled", "original", "chain", "n_garbled", "n")
    forms = forms.unionByName(lost_letters(vocab)).distinct().mapInArrow(plausible, forms.schema)
    best = forms.groupBy("garbled").agg(F.max_by(F.struct("original", "chain"), F.struct("n", "original")).alias("b")).select("garbled", "b.original", "b.chain")
    # The alphabet is bounded by Unicode, not by the corpus: distinct characters of clean words.
    letters = vocab.filter("n >= 5").select(F.explode(F.split("word", "")).alias("c"), "n").filter("c > '\u007f'").groupBy("c").agg(F.sum("n").alias("n")).filter("n >= 5").select("c").collect()
    return best, units([r[0] for r in letters])


def units(letters: list[str]) -> list[tuple[str, str]]:
    """Forms of single characters that have at least two signs and don't read as letters, longest first."""
    out: dict[str, str] = {}
    for c in sorted(letters):
        if not looks_clean(c) or c in "  ©®":
            continue
        for g, chain in chains(c).items():
            if len(g) < 2 or not chain.startswith("utf-8") or g.isascii() or LOST in g:
                continue
            if unicodedata.category(g[-1]) in ("Lu", "Ll") and unicodedata.category(g[0])[0] == "L" and not (g[0] in "ÃÂâÅĂĹГВРЁАБ" and not g[1:].islower()):
                continue
            out.setdefault(g, c)
    return sorted(out.items(), key=lambda x: (-len(x[0]), x[0]))


class Restorer:
    """Restores texts by the table of words, then by that of characters."""

    def __init__(self, table: dict[str, str], chars: list[tuple[str, str]]):
        self.table, self.chars = table, dict(chars)
        self.unit = re.compile("|".join(re.escape(g) for g, _ in chars)) if chars else re.compile(r"(?!)")

    def token(self, t: str) -> str | None:
        """The restored token; None if it isn't garbled; itself if the loss is final."""
        if t.isascii() and not QUESTION.search(t):
            return None
        w = next((w for w in forms_of(t) if w in self.table), None)
        if w is not None:
            o = self.table[w]
            k = t.translate(DIGITS).find(w)
            head, body, tail = t[:k], t[k : k + len(w)], t[k + len(w) :]
            figures = iter(c for c in body if c.isdecimal() and c.isascii())
            return head + "".join(next(figures, c) if c == "0" else c for c in o) + tail
        new = self.unit.sub(lambda m: self.chars[m.group()], t)
        if new != t:
            return new
        return t if LOST in t else None

    def text(self, x: str) -> tuple[str, int, int]:
        """``(restored text, garbled tokens, of them lost for good)``."""
        found = lost = 0

        def one(m: re.Match) -> str:
            nonlocal found, lost
            new = self.token(m.group())
            if new is None:
                return m.group()
            found += 1
            lost += LOST in new
            return new

        return SOLID.sub(one, x), found, lost

    def is_garbled(self, x: str) -> bool:
        return any(self.token(t.decode()) is not None for t in marked(x))


def find(docs: DataFrame, fields: list[str], key: str = "id", restore: bool = False, most: int = 300_000) -> DataFrame:
    """``key, field`` of the garbled fields, one row each; with ``restore`` also ``restored``, ``n_garbled`` and ``n_lost``.

    The table of verified forms goes to the tasks that read the texts as long as it has at most ``most`` rows (some tens
    of MB); a larger one is joined with the tokens by shuffle, and only the texts with a match get their part of it.
    """
    best, chars = repairs(docs, fields)
    best = materialize(best, "repairs")
    kind = docs.schema[key].dataType.simpleString()
    long = docs.select(F.col(f"`{key}`").alias("key"), F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").alias("text")) for f in fields))).alias("x")).select("key", "x.field", "x.text")
    long = long.filter("text <> ''")
    schema = f"key {kind}, field string" + (", restored string, n_garbled int, n_lost int" if restore else "")

    def emit(rows: list[tuple], types: pa.Schema) -> pa.RecordBatch:
        c = list(zip(*rows, strict=True)) or [()] * (5 if restore else 2)
        names = ["key", "field", "restored", "n_garbled", "n_lost"][: len(c)]
        kinds = [types.field(0).type, pa.string(), pa.string(), pa.int32(), pa.int32()][: len(c)]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, kinds, strict=True)], names)

    def judge(r: Restorer, k, f: str, x: str) -> tuple | None:
        if x.isascii() and "?" not in x or not r.is_garbled(x):
            return None
        return (k, f, *r.text(x)) if restore else (k, f)

    if best.count() <= most:
        table = spark_broadcast(docs, {r[0]: r[1] for r in best.select("garbled", "original").collect()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            r = Restorer(table.value, chars)
            for b in batches:
                rows = [judge(r, *x) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
                yield emit([x for x in rows if x], b.schema)

        out = long.mapInArrow(run, schema)
    else:
        rows = long.withColumn("h", F.xxhash64("key", "field", "text"))

        def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = [(h, w) for h, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for w in words_of(marked(x))]
                c = list(zip(*got, strict=True)) or [(), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.string())], ["h", "garbled"])

        parts = rows.select("h", "text").mapInArrow(tokens, "h long, garbled string").join(best, "garbled").groupBy("h").agg(F.map_from_entries(F.collect_set(F.struct("garbled", "original"))).alias("t"))

        def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = [judge(Restorer(dict(t or ()), chars), k, f, x) for k, f, x, t in zip(*(c.to_pylist() for c in b.columns), strict=True)]
                yield emit([x for x in got if x], b.schema)

        out = rows.join(parts, "h", "left").select("key", "field", "text", "t").mapInArrow(run_joined, schema)
    return out.distinct().withColumnRenamed("key", key)


def spark_broadcast(df: DataFrame, value):
    return df.sparkSession.sparkContext.broadcast(value)
