"""Vectorised splitting of text into the matches of the public tokenizers' pattern.

The pattern's alternatives are decided per character class (letter, number,
white space, other) with array operations. Libraries follow different Unicode
versions, so each character's class is asked of the library itself (``Classes``)
the first time that the character turns up.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

import numpy as np
import regex

from .textbytes import distinct_spans, span_hashes

SPACE, LETTER, NUMBER, OTHER, BREAK = range(5)


@cache
def unicode_classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        table[[ord(c) for c in regex.findall(pattern, every)]] = kind
    return table


class Classes:
    """Character classes as one library has them.

    ``joins(lead, characters)`` says for each character whether the library
    keeps ``lead + character`` together. Without it the ``regex`` module decides.
    """

    def __init__(self, joins: Callable[[str, list[str]], list[bool]] | None = None):
        self.table = unicode_classes().copy()
        self.joins = joins
        self.known = np.zeros(0x110000, bool)
        self.known[: 0x110000 if joins is None else 0x80] = True

    def of(self, points: np.ndarray) -> np.ndarray:
        new = points[~self.known[points]]
        if len(new):
            fresh = np.unique(new)
            characters = list(map(chr, fresh))
            kind = np.full(len(fresh), SPACE, np.uint8)
            for lead, value in ((".", OTHER), ("1", NUMBER), ("a", LETTER)):
                kind[np.array(self.joins(lead, characters), bool)] = value
            self.table[fresh] = kind
            self.known[fresh] = True
        return self.table[points]


@dataclass
class PreTokens:
    """Pre-tokens of several texts: byte spans in ``data`` and the first of each text."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)

    def distinct(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One occurrence of each different pre-token, and each occurrence's place among these."""
        return distinct_spans(self.data, self.starts, self.ends, hashes)

    def words(self, at: np.ndarray) -> list[bytes]:
        """The bytes of some pre-tokens."""
        raw = self.data.tobytes()
        return [raw[a:b] for a, b in zip(self.starts[at].tolist(), self.ends[at].tolist(), strict=True)]


def split(texts: list[str], classes: Classes) -> PreTokens:
    joined = "\0".join(texts) + "\0"
    data = np.frombuffer(joined.encode(), np.uint8)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    n = len(points)
    stops = np.cumsum(np.array([len(t) for t in texts] or [0], np.int64) + 1) - 1
    kind = classes.of(points)
    kind[stops] = BREAK
    start = np.empty(n + 4, bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:n])
    start[n:] = True
    start[stops] = True
    # The last character of a white-space run before other text stands alone, or leads that text if it is a plain space.
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & (kind[1:] != BREAK))
    start[last] = True
    start[last[points[last] == 32] + 1] = False
    # Contractions, where an apostrophe starts a match and a letter follows.
    quote = np.flatnonzero((points[:-1] == 39) & start[: n - 1] & (kind[1:] == LETTER))
    one = points[quote + 1]
    two = points[np.minimum(quote + 2, n - 1)]
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    start[quote[short | long] + 1] = False
    start[quote[short] + 2] = True
    start[quote[long] + 3] = True
    begin = np.flatnonzero(start[:n])
    end = np.append(begin[1:], n)
    real = kind[begin] != BREAK
    begin, end = begin[real], end[real]
    first = np.concatenate([[0], np.searchsorted(begin, stops[: len(texts)])])
    byte_of = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    return PreTokens(data, byte_of[begin], byte_of[end], first)
