"""Score rules over cells that come source by source: a worker has all slates of a source and looks the rest up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stored import Stored, groups_in_order, holds
from .slatecells import Rows, promoted, recurrences


def _known(cells: DataFrame, log: DataFrame) -> tuple[Stored, Stored]:
    """Sorted destinations of each source in the log, and sorted candidates of each source in the slates."""
    pairs = log.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst")
    hist = Stored(pairs.repartition("src").groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_set("dst")).alias("values")), pairs.count())

    def exposed(batches):
        import numpy as np
        import pyarrow as pa

        for src, cand in groups_in_order(batches, 2):
            order = np.lexsort((cand, src))
            s, c = src[order], cand[order]
            new = np.append(True, (s[1:] != s[:-1]) | (c[1:] != c[:-1]))
            s, c = s[new], c[new]
            first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
            lists = pa.LargeListArray.from_arrays(pa.array(np.append(first, len(s))), pa.array(c)).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(s[first]), lists], names=["id", "values"])

    pool = cells.select("src", "cand").mapInArrow(exposed, "id long, values array<long>")
    # At most one entry for each cell; how many there are decides the number of blocks only.
    return hist, Stored(pool, cells.count())


def ds1_chain(cells: DataFrame, log: DataFrame, dealt: bool = False) -> DataFrame:
    """``(row_id, pos, score)``: the promotion of recurring candidates, then that of reciprocal ones, as in ``rules``.

    ``dealt`` says that cells come dealt by ``src`` and in order of ``src``, ``row_id``
    and ``pos``, as ``tables.slates`` deals them; they are not shuffled then. What other
    sources' slates expose, and the log, are stored once and looked up by the workers.
    """
    told = cells.where("src IS NOT NULL AND cand IS NOT NULL").select("src", "row_id", "pos", "cand", "score")
    if not dealt:
        told = told.repartition("src").sortWithinPartitions("src", "row_id", "pos")
    hist, pool = _known(told, log)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for src, row_id, pos, cand, score in groups_in_order(batches, 5, order=3):
            rows = Rows(row_id)
            old = holds(hist, src, cand)
            recur = recurrences(src, cand) - 1
            # The candidate that recurs most among those outside the history.
            best = rows.most(np.where(old, -1, recur))
            like = ~old & (recur == best[rows.of])
            first, _ = rows.top_two(score)
            act = ~old[first] & (rows.total(like) == 1) & (best >= 2)
            chosen = act[rows.of] & like
            chosen[first] = False
            score = promoted(rows, score, chosen)
            # The second candidate, if only it names the source in its own slates.
            first, second = rows.top_two(score)
            ask = np.flatnonzero(second >= 0)
            ask = ask[~old[first[ask]] & ~old[second[ask]]]
            ask = ask[holds(pool, cand[second[ask]], src[second[ask]])]
            ask = ask[~holds(pool, cand[first[ask]], src[first[ask]])]
            chosen = np.zeros(len(src), bool)
            chosen[second[ask]] = True
            yield pa.RecordBatch.from_arrays([pa.array(row_id), pa.array(pos), pa.array(promoted(rows, score, chosen))], names=["row_id", "pos", "score"])

    return told.mapInArrow(run, "row_id long, pos long, score double")
