"""Pairs of texts that can reach a sequence ratio, found by the short sequences they share; nothing is estimated."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np

#: Letters of a sequence, and the percentage of those beyond the least number that are looked up as well: more of them leave fewer pairs to compare.
GRAM, MORE = 5, 60
#: Pairs of one block, and entries of the index looked up at once.
BLOCK = 1 << 21


def common_subsequence(a: str, masks: dict[str, int], m: int, least: float = 0) -> int:
    """Length of the longest common subsequence of ``a`` and a text of ``m`` letters, whose places by letter are ``masks``.

    -1 as soon as so many letters of ``a`` are left over that it can't be ``least``.
    """
    full = (1 << m) - 1
    v = full
    for start in range(0, len(a), 32):
        part = a[start : start + 32]
        for c in part:
            u = v & masks.get(c, 0)
            v = (v + u | v - u) & full
        if start + len(part) - (m - v.bit_count()) > len(a) - least:
            return -1
    return m - v.bit_count()


def places(text: str) -> dict[str, int]:
    """For each letter the places where the text has it, as bits."""
    out: dict[str, bytearray] = {}
    size = len(text) // 8 + 1
    for k, c in enumerate(text):
        if c not in out:
            out[c] = bytearray(size)
        out[c][k >> 3] |= 1 << (k & 7)
    return {c: int.from_bytes(x, "little") for c, x in out.items()}


def starts(ordered: np.ndarray) -> np.ndarray:
    """Where a new value begins."""
    return np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)


def rare_letters(codes: np.ndarray, doc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """How many letters of each text a matching block can begin from: in texts of 200 letters difflib leaves out those that are over a hundredth."""
    key = doc << np.uint64(32) | codes
    key.sort()
    at = starts(key)
    n = np.diff(np.append(at, len(key)))
    whose = (key[at] >> np.uint64(32)).astype(np.int64)
    most = np.where(length < 200, length, length // 100 + 1)
    return np.bincount(whose, weights=np.where(n <= most[whose], n, 0), minlength=len(length)).astype(np.int64)


def candidates(texts: list[str], day: np.ndarray, days: int, ratio: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places ``x < y`` of all pairs at most ``days`` apart that can reach ``ratio``; at most 65,535 texts.

    The matching blocks of a pair of this ratio have M = ratio * (m + n) / 2 letters together, and each block but one at
    the very beginning has a rare letter of the second text. Of its n - GRAM + 1 sequences of GRAM letters, then, no more
    than n - M + (GRAM - 1) * rare letters are not in the first text. Each text looks up its least frequent sequences, more
    than that number; equal hashes of unlike sequences only add pairs.
    """
    count = len(texts)
    length = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(count, dtype=np.uint64), length)
    cuts = (GRAM - 1) * rare_letters(codes, doc, length)
    last = max(0, len(codes) - GRAM + 1)
    h = codes[:last].astype(np.uint64)
    for k in range(1, GRAM):
        h *= np.uint64(0x100000001B3)
        h += codes[k : last + k]
    h *= np.uint64(0x9E3779B97F4A7C15)
    key = (h >> np.uint64(16) << np.uint64(16) | doc[:last])[doc[:last] == doc[len(doc) - last :]]
    del h, codes, doc
    key.sort()
    key = key[starts(key)]
    holder = (key & np.uint64(0xFFFF)).astype(np.int64)
    key >>= np.uint64(16)
    first = starts(key)
    spread = np.diff(np.append(first, len(key)))
    gram = np.repeat(np.arange(len(first)), spread)
    distinct = np.bincount(holder, minlength=count)
    del key
    # Sequences that only one text has come before all others of it and find nothing.
    shared = spread[gram] > 1
    e = holder[shared].astype(np.uint64) << np.uint64(48) | spread[gram[shared]].astype(np.uint64) << np.uint64(32) | gram[shared].astype(np.uint64)
    e.sort()
    whose, gram = (e >> np.uint64(48)).astype(np.int64), (e & np.uint64(0xFFFFFFFF)).astype(np.int64)
    del e, shared
    n = np.bincount(whose, minlength=count)
    rank = np.arange(len(whose)) - (np.cumsum(n) - n)[whose] + (distinct - n)[whose]
    shortest = np.ceil(length * ratio / (2 - ratio) - 1e-6)
    away = np.floor(length - ratio / 2 * (length + shortest) + cuts + 1e-6).astype(np.int64)
    used = np.minimum(distinct, away + 1 + np.maximum(0, distinct - away - 1) * MORE // 100)
    taken = rank < used[whose]
    whose, gram = whose[taken], gram[taken]
    size = spread[gram]
    at = np.concatenate([[0], np.cumsum(np.bincount(whose, minlength=count))])
    work = np.concatenate([[0], np.cumsum(np.bincount(whose, weights=size, minlength=count))])
    least = used - length - cuts + ratio / 2 * length - 1e-6
    other = ratio / 2 * length
    lo = 0
    while lo < count:
        hi = min(max(int(np.searchsorted(work, work[lo] + BLOCK, "right")) - 1, lo + 1), lo + max(1, BLOCK // count), count)
        s = slice(at[lo], at[hi])
        ends = np.cumsum(size[s])
        x = holder[np.repeat(first[gram[s]] - ends + size[s], size[s]) + np.arange(ends[-1] if len(ends) else 0)]
        met = np.bincount(np.repeat(whose[s] - lo, size[s]) * count + x, minlength=(hi - lo) * count).reshape(hi - lo, count)
        y, x = np.nonzero(met - other >= least[lo:hi, None])
        y += lo
        keep = (x < y) & (np.abs(day[x] - day[y]) <= days) & (2 * np.minimum(length[x], length[y]) >= ratio * (length[x] + length[y]))
        yield x[keep], y[keep]
        lo = hi


def similar(ids: list, texts: list[str], day: np.ndarray, own: np.ndarray, part: np.ndarray, days: int, ratio: float) -> tuple[list, list, list]:
    """``id_a, id_b, ratio`` of the pairs of at least ``ratio``, one of them ``own``; of unlike ``part`` where there are two parts.

    Longest common subsequences, which no matching blocks exceed, come before the ratio itself.
    """
    order = sorted(range(len(ids)), key=ids.__getitem__)
    ids, texts = [ids[k] for k in order], [texts[k] for k in order]
    day, own, part = day[order], own[order], part[order]
    across = len(np.unique(part)) > 1
    a, b, r = [], [], []
    for xs, ys in candidates(texts, day, days, ratio):
        keep = own[xs] | own[ys]
        if across:
            keep &= part[xs] != part[ys]
        seen, masks = -1, {}
        for x, y in zip(xs[keep].tolist(), ys[keep].tolist(), strict=True):
            if ids[x] == ids[y]:
                continue
            if y != seen:
                seen, masks = y, places(texts[y])
            least = ratio * (len(texts[x]) + len(texts[y])) / 2 - 1e-6
            if common_subsequence(texts[x], masks, len(texts[y]), least) < least:
                continue
            q = difflib.SequenceMatcher(None, texts[x], texts[y]).ratio()
            if q >= ratio:
                a.append(ids[x])
                b.append(ids[y])
                r.append(q)
    return a, b, r
