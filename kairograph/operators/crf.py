"""Equality chain model: rows of one time, near to each other, push the warm candidates that they share.

Two rows at most ``width`` apart are coupled if they have one time, different
sources and a warm candidate in common. Rows are cut into islands, the longest
stretches that some coupling spans; messages never leave an island. Only islands of
two or more rows go to Python workers; all other rows are a softmax in SQL. An
island is a sequence by nature, so one task holds a whole one: about 100 bytes a
cell, 100 MB for 10,000 rows of 100 candidates.

With ``width`` 1 an island is a chain and the two passes are its exact marginals;
beyond, each row multiplies the messages of all rows within the band, once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import row_softmax
from ..sources.shared import written
from .rules import adjacent_shared, candidate_factors, slate_sets

#: Islands that start within so many rows of each other are handed over together; rows whose islands are numbered by one task.
TOGETHER, BLOCK = 256, 4096


def _message(belief, own, other, boost, strength: float, power: float):
    """What the row next to it, with ``belief``, tells a row: more for shared candidates (``own`` here, ``other`` there) that it believes in."""
    import numpy as np

    message = np.ones(len(boost))
    message[own] = 1.0 + strength * boost[own] * (belief[other] / belief.sum()) ** power
    return message


def infer_island(candidates: list, scores: list, warm: list, tau: float, strength: float, sources: list | None = None, boosts: list | None = None, width: int = 1, power: float = 1.0) -> list:
    """Beliefs of an island's rows: softmax times the messages from before and from behind.

    Rows are consecutive. ``boosts`` weighs the strength by cell. A candidate
    that a slate holds twice is met at its last place.
    """
    import numpy as np

    n = len(candidates)
    sources = list(range(n)) if sources is None else sources
    boosts = [np.ones(len(c)) for c in candidates] if boosts is None else [np.asarray(b, float) for b in boosts]
    prior = [np.exp((np.asarray(s) - np.max(s)) / tau) for s in scores]
    prior = [e / e.sum() for e in prior]
    last = [{c: i for i, c in enumerate(row)} for row in candidates]

    def shared(a: int, b: int):
        """Places of candidates of row b in row a, before it: ``(in b, in a)``."""
        if sources[a] == sources[b]:
            return []
        return [(j, last[a][c]) for j, (c, w) in enumerate(zip(candidates[b], warm[b], strict=True)) if w and c in last[a]]

    ahead, behind = [np.ones(len(p)) for p in prior], [np.ones(len(p)) for p in prior]
    for out, order, step in ((ahead, range(n), 1), (behind, range(n - 1, -1, -1), -1)):
        now = [p.copy() for p in prior]
        for k in order:
            for d in range(1, width + 1):
                other = k - step * d
                if not 0 <= other < n:
                    break
                places = shared(other, k) if step > 0 else list({i: j for j, i in shared(k, other)}.items())
                if places:
                    own, there = (np.array(x) for x in zip(*places, strict=True))
                    out[k] = out[k] * _message(now[other], own, there, boosts[k], strength, power)
            now[k] = prior[k] * out[k]
    return [p * f * b for p, f, b in zip(prior, ahead, behind, strict=True)]


def islands(sets: DataFrame, width: int = 1) -> DataFrame:
    """``(row_id, island, n)``: the first row of each row's island, and the island's rows.

    Rows are numbered in blocks of ``BLOCK``; only the blocks' last island starts,
    one row per block, are put in order by one task.
    """
    spans = [adjacent_shared(sets, d).where(F.size("common") > 0).select(F.explode(F.sequence(F.col("row_id") + 1, F.col("row_id") + d)).alias("row_id")) for d in range(1, width + 1)]
    inner = spans[0]
    for s in spans[1:]:
        inner = inner.union(s)
    rows = sets.select("row_id").join(inner.distinct().withColumn("inner", F.lit(True)), "row_id", "left")
    marked = rows.select("row_id", F.when(F.col("inner").isNull(), F.col("row_id")).alias("start"), F.floor(F.col("row_id") / BLOCK).alias("block"))
    within = F.max("start").over(Window.partitionBy("block").orderBy("row_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    carry = marked.groupBy("block").agg(F.max("start").alias("s")).select("block", F.max("s").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("carry"))
    placed = written(marked.withColumn("within", within).join(carry, "block").select("row_id", F.coalesce("within", "carry").alias("island")), "islands")
    sizes = placed.groupBy("island").agg(F.count(F.lit(1)).alias("n"))
    return placed.join(sizes, "island").select("row_id", "island", "n")


def equality_crf(cells: DataFrame, log: DataFrame, tau: float = 0.20, strength: float = 70.0, width: int = 1, power: float = 1.0, eta: float = 0.0) -> DataFrame:
    """``cells`` with ``score`` replaced by the belief; with ``eta`` the strength is weighed by the candidates' reliability."""
    sets = written(slate_sets(cells, log), "sets")
    met = cells.join(islands(sets, width), "row_id").join(sets.select("row_id", F.col("warm").alias("known")), "row_id")
    names = ["row_id", "src", "time", "pos", "cand", "score"]
    alone = met.where("n = 1").withColumn("score", row_softmax(F.col("score"), tau)).select(*names)
    chained = met.where("n > 1").withColumn("warm", F.array_contains("known", F.col("cand"))).select(*names, "warm", "island")
    if eta:
        chained = chained.join(candidate_factors(cells, sets, eta), "cand").withColumnRenamed("factor", "boost")
    else:
        chained = chained.withColumn("boost", F.lit(1.0))

    import numpy as np

    def infer(pdf):
        pdf = pdf.sort_values(["row_id", "pos"], ignore_index=True)
        row, island, src = pdf["row_id"].to_numpy(), pdf["island"].to_numpy(), pdf["src"].to_numpy()
        cand, warm, boost, score = pdf["cand"].to_numpy(), pdf["warm"].to_numpy(), pdf["boost"].to_numpy(), pdf["score"].to_numpy().copy()
        edges = [0, *(np.flatnonzero(np.diff(row)) + 1).tolist(), len(row)]
        spans = list(zip(edges[:-1], edges[1:], strict=True))
        firsts = [k for k in range(len(spans)) if k == 0 or island[spans[k][0]] != island[spans[k - 1][0]]]
        for k, end in zip(firsts, [*firsts[1:], len(spans)], strict=True):
            own = spans[k:end]
            found = infer_island([cand[x:y].tolist() for x, y in own], [score[x:y] for x, y in own], [warm[x:y].tolist() for x, y in own], tau, strength, [src[x] for x, _ in own], [boost[x:y] for x, y in own], width, power)
            for (x, y), f in zip(own, found, strict=True):
                score[x:y] = f
        return pdf.assign(score=score)[names]

    groups = chained.groupBy(F.floor(F.col("island") / TOGETHER).alias("part"))
    return alone.union(groups.applyInPandas(infer, "row_id long, src long, time double, pos long, cand long, score double"))
