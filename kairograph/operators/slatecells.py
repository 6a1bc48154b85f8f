"""Arrays of cells whose rows come one after another, each in order of its positions."""

from __future__ import annotations

TINY = 1e-12


class Rows:
    """The rows of cells: where each starts, how wide it is, and the row of each cell."""

    def __init__(self, row_id):
        import numpy as np

        self.start = np.flatnonzero(np.append(True, row_id[1:] != row_id[:-1])) if len(row_id) else np.zeros(0, np.int64)
        self.width = np.diff(np.append(self.start, len(row_id)))
        self.of = np.repeat(np.arange(len(self.start)), self.width)

    def most(self, value):
        import numpy as np

        return np.maximum.reduceat(value, self.start) if len(self.start) else value[:0]

    def least(self, value):
        import numpy as np

        return np.minimum.reduceat(value, self.start) if len(self.start) else value[:0]

    def total(self, value):
        import numpy as np

        return np.add.reduceat(value.astype(np.int64) if value.dtype == bool else value, self.start) if len(self.start) else np.zeros(0, np.int64)

    def first_where(self, mask):
        """The first cell of each row that the mask holds, -1 where there is none."""
        import numpy as np

        out, at = np.full(len(self.start), -1), np.flatnonzero(mask)[::-1]
        out[self.of[at]] = at  # of several the one that is written last, which is the first
        return out

    def top_two(self, score):
        """The best two cells of each row, ties to the earlier; -1 where there is no second."""
        import numpy as np

        first = self.first_where(score == self.most(score)[self.of])
        rest = score.copy()
        rest[first] = -np.inf
        other = rest == self.most(rest)[self.of]
        other[first] = False
        return first, self.first_where(other)

    def max_normalised(self, value):
        """As ``scores.row_max_normalise``."""
        import numpy as np

        low, high = self.least(value), self.most(value)
        span = high - low
        up, flat = (high > TINY)[self.of], (span <= TINY)[self.of]
        by = np.where(high > TINY, high, np.where(span > TINY, span, 1.0))[self.of]
        return np.where(up, value / by, np.where(flat, 0.5, (value - low[self.of]) / by))


def promoted(rows: Rows, score, chosen):
    """The chosen cells lifted above their rows, as ``scores.promoted_value``, and all rows max-normalised."""
    import numpy as np

    low, high = rows.least(score), rows.most(score)
    return rows.max_normalised(np.where(chosen, (high + np.maximum(high - low, 1.0) + 1.0)[rows.of], score))


def recurrences(src, cand):
    """How many cells have the (source, candidate) of each; a source's cells come one after another."""
    import numpy as np

    if not len(src):
        return np.zeros(0, np.int64)
    order = np.lexsort((cand, src))
    s, c = src[order], cand[order]
    first = np.flatnonzero(np.append(True, (s[1:] != s[:-1]) | (c[1:] != c[:-1])))
    n = np.diff(np.append(first, len(s)))
    out = np.empty(len(src), np.int64)
    out[order] = np.repeat(n, n)
    return out
