"""Rules about neighbouring rows over cells that come by blocks of rows: a worker has a block and the rows around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from ..sources.stored import Stored, entries, groups_in_order, spans, weights_at
from ..sources.tables import ROWS
from . import rules

#: Rows on both sides of a block's edge that a worker sees at first; doubled until nothing that goes on over an edge is longer.
EDGE = 32


def _block(row_id: Column) -> Column:
    return F.floor(row_id / ROWS)


def _edges(cells: DataFrame, edge: int) -> tuple[Stored, Stored]:
    """``[1 or 0 for no src, src, candidates]`` and the time of the rows near the blocks' edges."""
    at = F.pmod(F.col("row_id"), F.lit(ROWS))
    near = cells.where((at < edge) | (at >= ROWS - edge)).groupBy(F.col("row_id").alias("id")).agg(F.max(F.col("told").cast("long")).alias("told"), F.max("src").alias("src"), F.first("time").alias("time"), F.sort_array(F.collect_list("cand")).alias("cands"))
    n = cells.where((at < edge) | (at >= ROWS - edge)).count() + 1
    return Stored(near.select("id", F.concat(F.array("told", "src"), "cands").alias("values")), n), Stored(near.select("id", F.array("time").alias("values")), n)


class _Around:
    """The rows of some blocks with those around them, and the runs of their warm candidates."""

    def __init__(self, near, warm, edge: int, block, row_id, told, src, time, cand):
        import numpy as np

        blocks = np.unique(block)
        asked = (blocks[:, None] * ROWS + np.r_[-edge:0, ROWS : ROWS + edge]).ravel()
        tag = np.repeat(blocks, 2 * edge)
        parts = [(block, row_id, told, src, time, cand, np.arange(len(cand)))]
        times = np.full(len(asked), np.nan)
        for flat, own, starts, _ in near[1].find(asked):
            times[own] = flat[starts]
        for flat, own, starts, sizes in near[0].find(asked):
            at, owner = spans(starts + 2, sizes - 2)
            which = own[owner]
            parts.append((tag[which], asked[which], flat[starts][owner] == 1, flat[starts + 1][owner], times[which], flat[at], np.full(len(at), -1)))
        block, row_id, told, src, time, cand, cell = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((row_id, block))
        block, row_id, told, src, time, cand, cell = (x[order] for x in (block, row_id, told, src, time, cand, cell))
        new = np.append(True, (row_id[1:] != row_id[:-1]) | (block[1:] != block[:-1]))
        of = np.cumsum(new) - 1
        self.time, told, src, number, part = time[new] + 0.0, told[new].astype(bool), src[new], row_id[new], block[new]
        n = len(number)
        # Whether the next row follows at once, at the same time.
        goes_on = np.append((number[1:] == number[:-1] + 1) & (part[1:] == part[:-1]) & (self.time[1:] == self.time[:-1]), False)
        known = np.flatnonzero(warm(cand))
        order = known[np.lexsort((of[known], cand[known]))]
        c, r = cand[order], of[order]
        new = np.append(True, (c[1:] != c[:-1]) | (r[1:] != r[:-1])) if len(c) else np.zeros(0, bool)
        #: Candidate and row of each warm (row, candidate), and the run it is in; runs are consecutive.
        self.cand, self.row = c[new], r[new]
        entry = np.cumsum(new) - 1
        follows = np.append(False, (self.cand[1:] == self.cand[:-1]) & (self.row[1:] == self.row[:-1] + 1) & goes_on[self.row[:-1]])[: len(self.cand)]
        self.first = np.flatnonzero(~follows)
        self.size = np.diff(np.append(self.first, len(self.cand)))
        self.run = np.cumsum(~follows) - 1
        self.own = (number >= part * ROWS) & (number < (part + 1) * ROWS)
        #: The cells of the blocks themselves that are warm, with their (row, candidate).
        mine = cell[order] >= 0
        self.cell, self.entry = cell[order][mine], entry[mine]
        # Three rows of three sources that share one candidate only.
        e = np.flatnonzero(follows[1:-1] & follows[2:]) if len(follows) > 2 else np.zeros(0, np.int64)
        r = self.row[e]
        e = e[told[r] & told[r + 1] & told[r + 2] & (src[r] != src[r + 1]) & (src[r + 1] != src[r + 2]) & (src[r] != src[r + 2])]
        r = self.row[e]
        alone = np.bincount(r, minlength=n) == 1
        e = e[alone[r]]
        votes = np.full((3, n + 2), -1)
        for k in range(3):
            votes[k, self.row[e] + k] = e
        votes = votes[:, :n]
        named = np.where(votes >= 0, self.cand[votes] if len(self.cand) else 0, 0)
        top = np.where(votes >= 0, named, np.iinfo(np.int64).min).max(0)
        low = np.where(votes >= 0, named, np.iinfo(np.int64).max).min(0)
        #: The candidate that a row's triples agree on.
        self.labelled, self.label = top == low, top


def _warm(known: Stored):
    import numpy as np

    ids = np.concatenate([np.zeros(0, np.int64), *(x[0] for x in known.load().values())])
    low, high = (int(ids.min()), int(ids.max())) if len(ids) else (0, -1)
    if high - low < 1 << 27:
        bits = np.zeros(high - low + 2, bool)
        bits[ids - low] = True
        return lambda c: bits[np.where((c >= low) & (c <= high), c - low, high - low + 1)]
    return lambda c: np.isin(c, ids)


def _reach(cells: DataFrame, known: Stored) -> tuple[int, tuple[Stored, Stored]] | None:
    """How many rows around an edge hold all that goes on over it, and these rows; nothing if a block does not."""
    edge = EDGE
    while edge <= ROWS // 2:
        near = _edges(cells, edge)
        tops = cells.agg(F.min("row_id"), F.max("row_id")).first()
        if tops[0] is None:
            return edge, near
        lowest, highest = tops[0] // ROWS, tops[1] // ROWS

        def longer(batches, edge=edge, near=near):
            import numpy as np
            import pyarrow as pa

            warm = _warm(known)
            for batch in batches:
                bad = []
                for b in batch.column(0).to_numpy():
                    found = _linked(near, warm, b * ROWS + np.arange(-edge, edge))
                    if found[edge] and (found[1 : edge + 1].all() or found[edge + 1 :].all()):
                        bad.append(b)
                yield pa.RecordBatch.from_arrays([pa.array(bad, pa.int64())], names=["b"])

        if not cells.sparkSession.range(lowest, highest + 1).mapInArrow(longer, "b long").limit(1).count():
            return edge, near
        edge *= 2
    return None


def _linked(near, warm, wanted):
    """Of consecutive row ids, which go on from the row before: at the same time, with a common warm candidate."""
    import numpy as np

    times, lists = np.full(len(wanted), np.nan), [np.zeros(0, np.int64)] * len(wanted)
    for flat, own, starts, _s in near[1].find(wanted):
        times[own] = flat[starts]
    for flat, own, starts, sizes in near[0].find(wanted):
        for k, a, n in zip(own, starts, sizes, strict=True):
            x = flat[a + 2 : a + n]
            lists[k] = x[warm(x)]
    return np.array([False] + [bool(times[k] == times[k - 1] and len(np.intersect1d(lists[k], lists[k - 1]))) for k in range(1, len(wanted))])


def run_exclusion(cells: DataFrame, log: DataFrame, min_run: int = 2, dealt: bool = False) -> DataFrame:
    """``(row_id, pos, level)`` as ``rules.run_exclusion``, with the rows' own triple labels protected.

    ``dealt`` says that cells come dealt by blocks of ``tables.ROWS`` rows and in order of
    ``row_id`` and ``pos``; they are not shuffled then. The rows around a block's edges
    are stored, as many as hold every run that goes on over an edge. Only the longest
    runs of each time and candidate, of two or more rows, are shuffled and stored.
    """
    known = Stored(log.where("dst IS NOT NULL").select("dst").distinct().select(F.col("dst").alias("id"), F.array("dst").alias("values")), log.count())
    told = cells.where("cand IS NOT NULL AND time IS NOT NULL").select(_block(F.col("row_id")).alias("block"), "row_id", "pos", F.col("src").isNotNull().alias("told"), F.coalesce("src", F.lit(0)).alias("src"), "time", "cand")
    reach = _reach(told, known)
    if reach is None:  # a run of thousands of rows: by joins
        return rules.run_exclusion(cells, log, rules.triple_rule(rules.slate_sets(cells, log)), min_run)
    edge, near = reach
    if not dealt:
        told = told.repartition("block").sortWithinPartitions("block", "row_id", "pos")

    def around(batches):
        warm = _warm(known)
        for block, row_id, pos, told, src, time, cand in groups_in_order(batches, 7, order=3):
            yield row_id, pos, _Around(near, warm, edge, block, row_id, told, src, time, cand)

    def longest(batches):
        import numpy as np
        import pyarrow as pa

        for _, _, a in around(batches):
            own = np.zeros(len(a.first), bool)
            own[a.run[a.own[a.row]]] = True
            own &= a.size >= max(2, min_run)
            at, n = a.first[own], a.size[own]
            yield pa.RecordBatch.from_arrays([pa.array(a.cand[at]), pa.array(a.time[a.row[at]].view(np.int64)), pa.array(n)], names=["cand", "at", "n"])

    most = told.mapInArrow(longest, "cand long, at long, n long").groupBy("cand", "at").agg(F.max("n").alias("n"))
    most = written(most, "runs")
    tops = Stored(entries(most, "cand", "at", "n"), 2 * most.count())

    def short(batches):
        import numpy as np
        import pyarrow as pa

        for row_id, pos, a in around(batches):
            top = weights_at(tops, a.cand, a.time[a.row].view(np.int64))
            out = (a.size[a.run] < top) & ~(a.labelled[a.row] & (a.label[a.row] == a.cand))
            cell = a.cell[out[a.entry]]
            yield pa.RecordBatch.from_arrays([pa.array(row_id[cell]), pa.array(pos[cell]), pa.array(np.ones(len(cell), np.int32))], names=["row_id", "pos", "level"])

    return told.mapInArrow(short, "row_id long, pos long, level int")
