"""Brute-force versions in plain Python, and small tables with the odd cases."""

import math
import random
from collections import Counter, defaultdict

import xxhash

#: Extra columns whose names occur inside the operators.
EXTRA = ["id", "th", "g", "h", "fp", "cls", "item", "covered", "bound", "n"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)


def docs(spark, rows):
    """Documents of ``(doc_id, text, lang)``, with null sources and clashing extra columns."""
    return spark.createDataFrame([(i, t, g, None, None, *EXTRA) for i, t, g in rows], SCHEMA).repartition(3)


def words(n, seed):
    r = random.Random(seed)
    parts = ["the", "of", "and", "ere", "tion", "an", "ing", "ou", "st", "é", "le"]
    return " ".join("".join(r.choices(parts, k=r.randint(1, 3))) for _ in range(n))


LONG = "\n".join(words(60, k) for k in range(400))


def odd_rows():
    """Null, empty, blank, very long, repeated and copied texts, and a row without an id."""
    rows = [(k, words(40 + k, k) + "\n" + words(30, k + 500), ["en", "fr", None][k % 3]) for k in range(24)]
    rows += [(100, None, "en"), (101, "", "en"), (102, " \n\t ", "en"), (103, LONG, "fr"), (104, rows[3][1], "en"), (105, rows[3][1], None), (None, rows[5][1], "en"), (106, "two words", "en")]
    return rows + [(7, rows[7][1], rows[7][2])]


def fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_components(rows):
    """Smallest id reachable for each row, by comparing all pairs of fingerprints."""
    prints = [fingerprint(t) for _, t, _ in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2 and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [a if g == b else g for g in group]
    ids = defaultdict(list)
    for g, (i, _, _) in zip(group, rows, strict=True):
        ids[g].append(i)
    return [(r[0], f"{p:016x}", min((x for x in ids[g] if x is not None), default=None)) for r, p, g in zip(rows, prints, group, strict=True)]


def one_of_each(rows):
    """The rows of ``(doc_id, text, ...)`` that stay, by their place: every pair of rows is compared, and of each group that
    comes of it the row with the least id (none last), then text hashes, then other columns stays."""
    prints = [fingerprint(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2 and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [a if g == b else g for g in group]

    def order(k):
        i, t, *others = rows[k]
        return (i is None, i or 0, hash_of(t), hash_of(t, hash_of("text")), [(x is not None, x or "") for x in others])

    return sorted(min((k for k in range(len(rows)) if group[k] == g), key=order) for g in set(group))


def dedup_lines(rows):
    """Texts without the later occurrences of three-line windows. Rows equal in id and text count once."""
    seen, cover = {}, defaultdict(set)
    keys = sorted({(i is not None, i if i is not None else 0, hash_of(t), t) for i, t, _ in rows if t is not None}, key=lambda k: k[:3])
    for some, i, _, t in keys:
        lines = t.split("\n")
        for k in range(len(lines) - 2):
            w = tuple(lines[k : k + 3])
            if "".join(w).strip(" ") and seen.setdefault(w, (some, i, t, k)) != (some, i, t, k):
                cover[some, i, t] |= {k, k + 1, k + 2}
    return [(i, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in cover[i is not None, i if i is not None else 0, t]), g) for i, t, g in rows]


def hash_of(text, seed=42):
    """The text hash that orders rows of one id, signed as in the engine; a null passes the seed on."""
    if text is None:
        return seed
    h = xxhash.xxh64_intdigest(text.encode(), seed & (1 << 64) - 1)
    return h - (1 << 64) if h >> 63 else h


def thue_morse(n):
    """Two words of n (a power of two) letters that sums with powers of a base cannot tell apart."""
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def contained(rows, items):
    """``(doc_id, text, item_id, shared, size)`` by comparing every document with every item."""
    grams = lambda t: {" ".join(w[k : k + 5]) for w in [[x for x in split(t) if x]] for k in range(len(w) - 4)}
    split = lambda t: (t or "").lower().translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ")
    out = set()
    for i, t, _ in rows:
        own = grams(t)
        for item, text in items:
            g = grams(text)
            if g and 5 * len(own & g) >= 4 * len(g):
                out.add((i, t, item, len(own & g), len(g)))
    return out


class Kneser:
    """Interpolated modified Kneser-Ney over bytes, from dictionaries: the classes' own counts above ``shared`` bytes, those of all below."""

    def __init__(self, texts, order, discounts, own=None, shared=None):
        """``texts`` of all classes; ``own`` those of the class whose model this is (all of them by default)."""
        own, shared = texts if own is None else own, order - 1 if shared is None else shared
        self.order = order
        every, top = ({g for t in x for g in self.grams(t)} for x in (texts, own))
        self.levels = {order: dict(Counter(g for t in own for g in self.grams(t)))}
        for k in range(order - 1, 0, -1):
            types = {g[-(k + 1) :] for g in (every if k <= shared else top)}
            self.levels[k] = dict(Counter(g[1:] for g in types))
        self.d = {k: discounts(dict(Counter(min(c, 5) for c in v.values()))) for k, v in self.levels.items()}
        self.contexts = {}
        for k, v in self.levels.items():
            for g, c in v.items():
                total, left = self.contexts.get((k, g[:-1]), (0, 0.0))
                self.contexts[k, g[:-1]] = total + c, left + self.d[k][min(c, 3) - 1]

    def grams(self, text):
        b = b"\0" * (self.order - 1) + text.encode()
        return [b[i : i + self.order] for i in range(len(b) - self.order + 1)]

    def p(self, g):
        if not g:
            return 1 / 256
        low, k = self.p(g[1:]), len(g)
        if (k, g[:-1]) not in self.contexts:
            return low
        total, left = self.contexts[k, g[:-1]]
        c = self.levels[k].get(g, 0)
        kept = c - self.d[k][min(c, 3) - 1] if c else 0
        return kept / total + left / total * low

    def perplexity(self, text):
        g = self.grams(text or "")
        return math.exp(-sum(math.log(self.p(x)) for x in g) / len(g)) if g else None
