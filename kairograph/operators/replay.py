"""Replay of the past: positives after a cut, negatives from the source's own pool, folds and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NEGATIVES = 99


def _order(*parts: str) -> Column:
    return F.md5(F.concat_ws("-", *[F.col(p).cast("string") for p in parts]))


def replay_positives(after: DataFrame, pool: DataFrame) -> DataFrame:
    """Interactions after the cut whose source has a candidate pool."""
    return after.join(pool.select("src").distinct(), "src", "left_semi")


def replay_negatives(queries: DataFrame, pool: DataFrame, n: int = NEGATIVES, salt: int | None = None) -> DataFrame:
    """``(qid, cand)``: up to ``n`` of the pool without the answer and the source, in an order given by a hash (another one for each ``salt``)."""
    met = queries.select("qid", "src", "dst").join(pool, "src").where("cand <> dst AND cand <> src")
    salted = met if salt is None else met.withColumn("salt", F.lit(salt))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(_order("qid", "cand", *(["salt"] if salt is not None else [])), "cand"))
    return salted.withColumn("place", place).where(F.col("place") <= n).select("qid", "cand")


def with_positions(queries: DataFrame, negatives: DataFrame) -> DataFrame:
    """``(qid, src, time, pos, cand, label)``: negatives by candidate, the positive last."""
    own = negatives.join(queries.select("qid", "src", "time"), "qid")
    both = own.select("qid", "src", "time", "cand", F.lit(0).alias("label")).union(queries.select("qid", "src", "time", F.col("dst").alias("cand"), F.lit(1).alias("label")))
    pos = F.row_number().over(Window.partitionBy("qid").orderBy("label", "cand")) - 1
    return both.withColumn("pos", pos.cast("long")).select("qid", "src", "time", "pos", "cand", "label")


def replay_queries(after: DataFrame, pool: DataFrame, n: int = NEGATIVES) -> DataFrame:
    """``(qid, src, time, pos, cand, label)`` of the positives and their negatives. ``after`` has ``row_id``."""
    q = replay_positives(after, pool).withColumnRenamed("row_id", "qid")
    return with_positions(q, replay_negatives(q, pool, n))


def source_folds(log: DataFrame) -> DataFrame:
    """``(src, fold)``: two folds of sources by a hash."""
    return log.select("src").distinct().select("src", (F.conv(F.substring(F.md5(F.col("src").cast("string")), 1, 8), 16, 10).cast("long") % 2).alias("fold"))


def query_subsample(queries: DataFrame, n: int) -> DataFrame:
    """``n`` queries in an order given by a hash."""
    return queries.orderBy(_order("qid"), "qid").limit(n)


def mrr(cells: DataFrame, together: bool = False) -> DataFrame:
    """``(n_rows, mrr)``: the positive's rank counts every other cell that scores at least as much.

    With ``together`` the cells of a row must come one after another in one
    partition; they are then ranked where they are, and only counts are shuffled.
    """
    if together:
        counts = cells.select("row_id", F.col("label").cast("int").alias("label"), F.col("score").cast("double").alias("score")).mapInArrow(_ranks, "rank long, n long").groupBy("rank").agg(F.sum("n").alias("n"))
    else:
        own = F.max(F.when(F.col("label") == 1, F.col("score"))).over(Window.partitionBy("row_id"))
        ranks = cells.withColumn("own", own).groupBy("row_id").agg((F.count_if(F.col("score") >= F.col("own")) - F.count_if((F.col("label") == 1) & (F.col("score") >= F.col("own"))) + 1).alias("rank"), F.max("label").alias("has"))
        counts = ranks.where("has = 1").groupBy("rank").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.sum("n").alias("n_rows"), F.round(F.sum(F.col("n") / F.col("rank")) / F.sum("n"), 6).alias("mrr"))


def _ranks(batches):
    """Ranks of the positives of rows whose cells come one after another, and how often each occurs."""
    import numpy as np
    import pyarrow as pa

    counts, rest = {}, [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0)]

    def count(row_id, label, score):
        if not len(row_id):
            return
        start = np.flatnonzero(np.append(True, row_id[1:] != row_id[:-1]))
        row = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(row_id))))
        own = np.maximum.reduceat(np.where(label == 1, score, -np.inf), start)
        above = np.bincount(row[(label != 1) & (score >= own[row])], minlength=len(start)) + 1
        found, n = np.unique(above[np.maximum.reduceat(label, start) == 1], return_counts=True)
        for k, x in zip(found.tolist(), n.tolist(), strict=True):
            counts[k] = counts.get(k, 0) + x

    for batch in batches:
        row_id, label, score = (np.concatenate([x, batch.column(k).to_numpy(zero_copy_only=False)]) for k, x in enumerate(rest))
        changes = np.flatnonzero(row_id[1:] != row_id[:-1])
        whole = int(changes[-1]) + 1 if len(changes) else 0  # the last row may go on
        count(row_id[:whole], label[:whole], score[:whole])
        rest = [row_id[whole:], label[whole:], score[whole:]]
    count(*rest)
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["rank", "n"])


def top1_disagreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Share of rows on which two score tables' best cells differ."""
    from ..functions.scores import stable_rank

    tops = lambda d, n: stable_rank(d).where("rank = 1").select("row_id", F.col("pos").alias(n))
    joined = tops(a, "x").join(tops(b, "y"), "row_id")
    return joined.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("x") != F.col("y")).alias("differ")).select("n_rows", "differ", F.round(F.col("differ") / F.col("n_rows"), 6).alias("rate"))
