"""Feature tables of the two rankers, the blends, and the score chains: plans over the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import row_minmax, rownorm
from ..operators import bystretch, feedback, history, popularity

#: Blend weights of the two scenarios.
WEIGHTS_DS1 = {"collab": 0.5, "rpop": 1.25, "icf_mean": 2.0, "icf_top3": 1.2, "cooc": 0.3, "dot": 9.0, "history": 16.0}
WEIGHTS_DS2 = {"collab": 0.25, "rpop": 1.25, "icf_mean": 0.5, "icf_top3": 1.0, "dot": 0.7}


def with_candidates(cells: DataFrame, log: DataFrame) -> DataFrame:
    """Popularity columns by candidate; unseen candidates get zeros."""
    pop = popularity.dst_popularity(log).withColumnRenamed("dst", "cand")
    rpop = popularity.recent_popularity(log).withColumnRenamed("dst", "cand")
    win = popularity.popularity_windows(log).withColumnRenamed("dst", "cand").drop("pop_diff")
    gr = popularity.graph_recency(log).withColumnRenamed("dst", "cand")
    by_cand = pop.join(rpop, "cand", "left").join(win, "cand").join(gr, "cand")
    freq = popularity.candidate_frequency(cells)
    out = cells.join(by_cand, "cand", "left").join(freq, "cand")
    zero = F.lit(0.0)
    return out.select(
        *cells.columns,
        F.col("pop").isNotNull().cast("int").alias("seen"),
        F.coalesce("pop", F.lit(1)).alias("pop"),
        F.coalesce("pop_log", F.log1p(F.lit(1.0))).alias("pop_log"),
        *[F.coalesce(c, zero).alias(c) for c in ("rpop", "pop_short", "pop_long", "recency")],
        "freq",
        "freq_log",
    )


def with_pairs(cells: DataFrame, log: DataFrame, vectors: DataFrame, neighbours: DataFrame, cooc: bool) -> DataFrame:
    """Columns by (source, candidate). Each is scored once per distinct pair, then joined back."""
    wanted = cells.select("src", "cand").distinct()
    half = vectors.select("id", F.slice("vec", 1, 32).alias("vec"))
    pairs = history.item_cf(wanted, log, vectors)
    pairs = pairs.join(history.dot_score(wanted, vectors).withColumnRenamed("dot", "dot_a"), ["src", "cand"])
    pairs = pairs.join(history.dot_score(wanted, half).withColumnRenamed("dot", "dot_b"), ["src", "cand"])
    pairs = pairs.join(history.user_cf(wanted, neighbours, log), ["src", "cand"])
    if cooc:
        pairs = pairs.join(history.cooc_cf(wanted, log), ["src", "cand"])
    pairs = pairs.join(history.pair_weights(log).select("src", F.col("dst").alias("cand"), F.col("w").alias("n_hist")), ["src", "cand"], "left").na.fill(0, ["n_hist"])
    return cells.join(pairs, ["src", "cand"])


def _base(cells: DataFrame, log: DataFrame, vectors: DataFrame, cooc: bool) -> DataFrame:
    neighbours = history.similar_users_topk(cells, vectors)
    sized = log.groupBy("src").agg(F.count(F.lit(1)).alias("hist_len"))
    out = with_pairs(with_candidates(cells, log), log, vectors, neighbours, cooc).join(sized, "src", "left").na.fill(0, ["hist_len"])
    c = F.col
    normed = {f"f_{n}": rownorm(c(n)) for n in ("collab", "rpop", "icf_mean", "icf_top3", "pop_short", "pop_long", "freq_log", *(["cooc"] if cooc else []))}
    normed["f_dot"] = (rownorm(c("dot_a")) + rownorm(c("dot_b"))) / 2
    normed["f_ratio"] = rownorm(c("pop") / (c("freq") + 1))
    return out.withColumns(normed)


def features_ds1(cells: DataFrame, log: DataFrame, vectors: DataFrame) -> DataFrame:
    """21 columns per cell, for repeat-dominated logs."""
    gap = popularity.source_last_gap(cells.select("row_id", "src", "time").distinct(), log)
    freeze = log.agg(F.max("time").alias("freeze"))
    out = _base(cells, log, vectors, True).join(gap, "row_id").join(F.broadcast(freeze))
    c = F.col
    new = F.when(c("n_hist") > 0, 0.0).otherwise(rownorm(c("dot_b")))
    width = F.count(F.lit(1)).over(_row())
    columns = {"f_collab": c("f_collab"), "f_rpop": c("f_rpop"), "f_icf_mean": c("f_icf_mean"), "f_icf_top3": c("f_icf_top3"), "f_dot": c("f_dot"), "f_cooc": c("f_cooc"), "recency": c("recency"), "pop_log": c("pop_log"), "hist_len": c("hist_len"), "in_hist": (c("n_hist") > 0).cast("int"), "n_hist": c("n_hist"), "seen": c("seen"), "time_gap": (c("time") - c("freeze")) / popularity.YEAR_DAYS, "width": width, "f_short": c("f_pop_short"), "f_long": c("f_pop_long"), "f_diff": c("f_pop_short") - c("f_pop_long"), "f_freq": c("f_freq_log"), "f_ratio": c("f_ratio"), "last_gap": c("last_gap"), "f_new": new}
    return out.select("row_id", "pos", "cand", "label", *[v.alias(k) for k, v in columns.items()])


def features_ds2(cells: DataFrame, log: DataFrame, vectors: DataFrame) -> DataFrame:
    """18 columns per cell, for basket logs; cells of a source, and in it of a row, come one after another.

    What is known of candidates, sources and pairs is stored once and looked up by the
    workers, so cells that come dealt by ``src`` are not shuffled.
    """
    from ..operators.dealt import NAMES_DS2, features

    freeze = log.agg(F.max("time").alias("freeze"))
    out = features(cells, log, vectors, WEIGHTS_DS2).join(F.broadcast(freeze))
    columns = {n: (F.col("time") - F.col("freeze")) / popularity.YEAR_DAYS if n == "time_gap" else F.col(n) for n in NAMES_DS2}
    return out.select("row_id", "pos", "cand", "label", *[v.alias(k) for k, v in columns.items()])


def _row():
    from ..functions.scores import row

    return row()


def linear_blend_ds1(features: DataFrame) -> DataFrame:
    """``score`` of the repeat-dominated scenario: history occurrences weigh most."""
    c, w = F.col, WEIGHTS_DS1
    score = w["history"] * c("n_hist") + w["collab"] * c("f_collab") + w["rpop"] * c("f_rpop") + w["icf_mean"] * c("f_icf_mean") + w["icf_top3"] * c("f_icf_top3") + w["cooc"] * c("f_cooc") + w["dot"] * c("f_dot")
    return features.select("row_id", "pos", "cand", "label", score.alias("score"))


def linear_blend_ds2(features: DataFrame) -> DataFrame:
    """``score`` of the basket scenario: history candidates are masked to 0."""
    return features.select("row_id", "pos", "cand", "label", F.when(F.col("in_hist") == 1, 0.0).otherwise(F.col("blend")).alias("score"))


def simple_blend(cells: DataFrame, log: DataFrame) -> DataFrame:
    """The smallest whole path: 16 times the history count plus 1.25 times the normalised recent popularity."""
    rpop = popularity.recent_popularity(log).withColumnRenamed("dst", "cand")
    out = history.history_count(cells, log).join(rpop, "cand", "left").na.fill(0.0, ["rpop"])
    return out.withColumn("score", 16 * F.col("n_hist") + 1.25 * rownorm(F.col("rpop"))).select(*cells.columns, "score")


def consensus_blend(members: list[DataFrame]) -> DataFrame:
    """Mean of the members' row-min-max scores."""
    parts = [m.select("row_id", "pos", row_minmax(F.col("score")).alias(f"m{i}")) for i, m in enumerate(members)]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, ["row_id", "pos"])
    total = sum((F.col(f"m{i}") for i in range(1, len(members))), F.col("m0"))
    return out.select("row_id", "pos", (total / len(members)).alias("score"))


def ds2_chain(cells: DataFrame, log: DataFrame) -> DataFrame:
    """Chain model, min-max, triple promotion, demotions (an existing level is kept), cross-time decoding: ``cells`` with these scores."""
    names = ["row_id", "src", "time", "pos", "cand"]
    return cells.select(*names).join(bystretch.ds2_chain(cells, log), ["row_id", "pos"]).select(*names, "score")


def with_feedback(cells: DataFrame, log: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    return cells.join(feedback.basket_feedback(cells, log, labels), ["row_id", "pos"])
