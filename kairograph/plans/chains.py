"""Chains of models and rules: the three-pass ranker with feedback, bagged arms, evaluation on real candidates, self-training."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import feedback, models, popularity, replay, rules
from ..sources import tables as T
from ..sources.shared import written


def three_pass(cells: DataFrame, log: DataFrame, features: DataFrame, names: list[str], rounds: int = 50, passes: int = 3, **tree) -> DataFrame:
    """``(row_id, pos, cand, label, score)``: each pass fits on two source-disjoint folds, and its scores feed the next.

    Scores of a fold come from the model of the other one. Between passes the
    other rows of a basket say, in item profiles, what they prefer. Every pass is
    written to the shared folder.
    """
    folds = replay.source_folds(cells)
    sets = rules.slate_sets(cells, log)
    labels = written(rules.structural_labels(sets).select("row_id", "cand"), "labels")
    base = written(features.join(cells.select("row_id", "pos", "src", "time"), ["row_id", "pos"]).join(folds, "src"), "features")
    told, used, scored = None, list(names), None
    last = max(1, passes) - 1
    for turn in range(last + 1):
        rows = base if told is None else base.join(told, ["row_id", "pos"])
        rows = rows.withColumnRenamed("row_id", "qid")
        parts = []
        for fold in (0, 1):
            model = models.lambdamart(rows.where(F.col("fold") == 1 - fold).select("qid", "pos", "label", *used), used, rounds=rounds, **tree)
            parts.append(model(rows.where(F.col("fold") == fold)).select(F.col("qid").alias("row_id"), "src", "time", "pos", "cand", "label", F.col("prediction").alias("score")))
        scored = written(parts[0].unionByName(parts[1]), "scores")
        if turn < last:  # nobody reads what the last pass would say
            told = written(feedback.basket_feedback(scored, log, labels), "feedback", instead_of=told)
        used = [*names, "fb_max", "fb_mean"]
    return scored.select("row_id", "pos", "cand", "label", "score")


def bagged_arms(rows: DataFrame, arms: dict[str, list[str]], bags: int = 4, rounds: int = 50, **tree) -> DataFrame:
    """``(arm, n_rows, mrr, wins, verdict)``: each arm's features, bagged over Poisson weights of queries, against the first arm.

    A query of weight w is learnt from w times; an arm's score is the mean of its
    bags. ``wins`` counts the bags in which the arm alone is better than the first
    arm's bag of the same weights; the verdict is ``better`` or ``worse`` if all
    bags agree and the mean does too, else ``open``.
    """
    keys = ["qid", "pos", "cand", "label"]
    weights = bootstrap_weights(rows.select("qid"), bags)
    found: dict[str, list[float]] = {}
    totals = []
    for arm, names in arms.items():
        each = []
        for bag in range(bags):
            times = weights.where((F.col("bag") == bag) & (F.col("weight") > 0)).select("qid", F.explode(F.sequence(F.lit(1), "weight")).alias("copy"))
            drawn = rows.join(times, "qid").withColumn("qid", F.struct("qid", "copy"))
            model = models.lambdamart(drawn.select("qid", "pos", "label", *names), names, rounds=rounds, **tree)
            each.append(written(model(rows).select(*keys, F.col("prediction").alias(f"s{bag}")), "bag"))
        scored = each[0]
        for more in each[1:]:
            scored = scored.join(more, keys)
        scored = written(scored.withColumnRenamed("qid", "row_id"), "arm")
        mean = sum((F.col(f"s{k}") for k in range(1, bags)), F.col("s0")) / bags
        tables = [scored.withColumn("score", F.col(f"s{k}")) for k in range(bags)] + [scored.withColumn("score", mean)]
        rates = [replay.mrr(t).first() for t in tables]  # one row each
        found[arm] = [r["mrr"] for r in rates]
        totals.append((arm, rates[-1]["n_rows"], rates[-1]["mrr"]))
    first = found[next(iter(arms))]
    out = []
    for arm, n, rate in totals:
        own = found[arm]
        wins, losses = sum(x > y for x, y in zip(own[:-1], first[:-1], strict=True)), sum(x < y for x, y in zip(own[:-1], first[:-1], strict=True))
        verdict = "better" if wins == bags and own[-1] > first[-1] else "worse" if losses == bags and own[-1] < first[-1] else "open"
        out.append((arm, n, rate, wins, verdict))
    return rows.sparkSession.createDataFrame(out, "arm string, n_rows long, mrr double, wins int, verdict string")


def real_candidate_eval(log: DataFrame, pool: DataFrame, score: Callable[[DataFrame, DataFrame], DataFrame], runs: int = 3, negatives: int = replay.NEGATIVES, uniform: int = 0) -> DataFrame:
    """``(run, n_rows, mrr)`` of every run, and their mean as run -1.

    Each source's last interaction is the answer, the rest is what ``score(cells,
    log)`` may know. Negatives come from the source's pool in an order given by a
    hash of run, query and candidate, or are ``uniform`` ids of the whole id space.
    """
    tail = T.numbered(popularity.tail_split(log)).drop("rn")
    known = popularity.before_tail(log)
    top = F.broadcast(log.agg((F.greatest(F.max("src"), F.max("dst")) + 1).alias("n_ids")))
    parts = []
    for run in range(runs):
        if uniform:
            drawn = tail.select(F.col("row_id").alias("qid"), "src", "dst").join(top).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2 * uniform))))
            drawn = drawn.select("qid", "src", "dst", "k", F.pmod(F.xxhash64(F.lit(run), "qid", "k"), F.col("n_ids")).alias("cand")).where("cand <> dst AND cand <> src")
            once = drawn.groupBy("qid", "cand").agg(F.min("k").alias("k"))
            place = F.row_number().over(Window.partitionBy("qid").orderBy("k"))
            chosen = once.withColumn("place", place).where(F.col("place") <= uniform).select("qid", "cand")
            own = tail.withColumnRenamed("row_id", "qid")
        else:
            own = replay.replay_positives(tail, pool).withColumnRenamed("row_id", "qid")
            chosen = replay.replay_negatives(own, pool, negatives, salt=run)
        cells = replay.with_positions(own, chosen).withColumnRenamed("qid", "row_id")
        parts.append(replay.mrr(score(cells, known)).select(F.lit(run).alias("run"), "n_rows", "mrr"))
    each = reduce(DataFrame.union, parts)
    return each.union(each.agg(F.lit(-1).alias("run"), F.max("n_rows").alias("n_rows"), F.round(F.avg("mrr"), 6).alias("mrr")))


def bootstrap_weights(queries: DataFrame, bags: int) -> DataFrame:
    """``(qid, bag, weight)``: Poisson(1) weights from a hash of query and bag, so every run draws alike."""
    u = F.conv(F.substring(F.md5(F.concat_ws("-", "qid", "bag")), 1, 8), 16, 10).cast("double") / 4294967296
    steps, term, total = [], 0.36787944117144233, 0.0
    for k in range(8):
        total += term
        steps.append((total, k))
        term /= k + 1
    weight = F.lit(8)
    for bound, k in reversed(steps):
        weight = F.when(u < bound, k).otherwise(weight)
    return queries.select("qid").distinct().withColumn("bag", F.explode(F.sequence(F.lit(0), F.lit(bags - 1)))).withColumn("weight", weight)


def self_training(log: DataFrame, score: Callable[[DataFrame], DataFrame], rounds: int = 2, windows: list[float] | None = None) -> DataFrame:
    """``(src, dst, w)``: the log's pair weights with confident new edges added, round by round.

    ``score(weights)`` gives scored cells. With ``windows`` round k harvests only
    from cells up to the time ``windows[k]``, so that near slates teach before far ones.
    """
    weights, edges = popularity.virtual_edge_union(log, log.select("src", "dst").limit(0)), None
    for k in range(rounds):
        cells = score(weights)
        if windows is not None:
            cells = cells.where(F.col("time") <= windows[min(k, len(windows) - 1)])
        found = rules.virtual_edge_harvest(cells, log)
        edges = written(found if edges is None else edges.union(found).distinct(), "virtual", instead_of=edges)
        weights = popularity.virtual_edge_union(log, edges)
    return weights
