"""What of a text is sentences of a language: shared by the quality statistics, the scan repair and the spam filter."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\W\d_]+")
#: A sentence's end: a mark, closing quotes, then space and something that can open a sentence.
END = re.compile(r"(?<![.\s])(?:[.!?…]|[.!?] ?[»”\"])[)”\"’]*(?=\s+(?:[«“\"„(–—-]\s*)?[^\W\d_a-zà-öø-ÿ]|\s*$)")
INITIAL = re.compile(r"(?:^|[\s.\-(«])[^\W\d_]{1,2}\.$|(?:^|\s)(?:Fr|St|Ste|Dr|Me|Mme|tél|réf|av|ch)\.$")


def sentences(text: str) -> list[tuple[int, int, bool]]:
    """``(start, end, ended)`` of the text's stretches up to each sentence's end; ``ended`` is false for a rest without one."""
    out, start = [], 0
    for m in END.finditer(text):
        stop = m.end()
        if text[m.start()] == "." and INITIAL.search(text, max(start, m.start() - 6), m.start() + 1):
            continue
        out.append((start, stop, True))
        start = stop
    if text[start:].strip():
        out.append((start, len(text), False))
    return out


def is_prose(stretch: str, common: frozenset[str], ended: bool = True, least: float = 0.17) -> bool:
    """Whether a stretch reads as a sentence: ended, of usual length, with function words, few digits and symbols."""
    if not ended:
        return False
    words = WORD.findall(stretch.lower())
    n = len(words)
    if not 3 <= n <= 90:
        return False
    letters = sum(map(len, words))
    solid = len("".join(stretch.split()))
    if letters < 0.6 * solid:
        return False
    return sum(map(common.__contains__, words)) >= least * n
