"""Deterministic rules on slates: structural labels, exclusions, promotions and decoding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import demoted, promoted_value, row, row_max_normalise, row_minmax, stable_rank
from ..sources.shared import written
from .history import history_mask, reverse_edge, warm_flag
from .popularity import slate_recurrence


#: Row ids of one block in which a candidate's runs are numbered.
RUN_BLOCK = 4096


def slate_sets(cells: DataFrame, log: DataFrame) -> DataFrame:
    """``(row_id, src, time, warm array)``: each row's distinct warm candidates, sorted."""
    flagged = warm_flag(cells, log)
    return flagged.groupBy("row_id", "src", "time").agg(F.sort_array(F.collect_set(F.when(F.col("warm"), F.col("cand")))).alias("warm"))


def following(rows: DataFrame, columns: list[str], steps: int) -> DataFrame:
    """Columns of the next rows (by ``row_id``) as ``name_1``, ``name_2``...; joined on the row number, so no task sees all rows."""
    out = rows
    for d in range(1, steps + 1):
        out = out.join(rows.select((F.col("row_id") - d).alias("row_id"), *[F.col(c).alias(f"{c}_{d}") for c in columns]), "row_id", "left")
    return out


def _agreed(votes: DataFrame) -> DataFrame:
    """Rows whose votes name one candidate only."""
    return votes.groupBy("row_id").agg(F.min("cand").alias("cand"), F.max("cand").alias("other")).where("cand = other").drop("other")


def triple_rule(sets: DataFrame) -> DataFrame:
    """``(row_id, cand)``: three consecutive rows of one time and three sources share just one warm candidate."""
    w = following(sets, ["src", "time", "warm"], 2)
    same = (F.col("time") == F.col("time_1")) & (F.col("time") == F.col("time_2"))
    three = (F.col("src") != F.col("src_1")) & (F.col("src") != F.col("src_2")) & (F.col("src_1") != F.col("src_2"))
    hits = w.where(same & three).select("row_id", F.array_intersect(F.array_intersect("warm", "warm_1"), "warm_2").alias("common")).where(F.size("common") == 1)
    return _agreed(hits.select(F.explode(F.array(*[F.col("row_id") + k for k in range(3)])).alias("row_id"), F.get("common", F.lit(0)).alias("cand")))


def adjacent_shared(sets: DataFrame, distance: int = 1) -> DataFrame:
    """``(row_id, common)``: a row and the one ``distance`` rows on, of one time and different sources, with the warm candidates they share."""
    columns = ["src", "time", "warm"]
    other = sets.select((F.col("row_id") - distance).alias("row_id"), *[F.col(c).alias(f"{c}_1") for c in columns])
    return sets.join(other, "row_id").where("time = time_1 AND src <> src_1").select("row_id", F.array_intersect("warm", "warm_1").alias("common"))


def band_shared(sets: DataFrame, width: int) -> DataFrame:
    """``(row_id, distance, cand)``: each warm candidate that a row shares with a coupled row up to ``width`` rows on."""
    parts = [adjacent_shared(sets, d).select("row_id", F.lit(d).alias("distance"), F.explode("common").alias("cand")) for d in range(1, width + 1)]
    return reduce(DataFrame.union, parts)


def pair_labels(sets: DataFrame, triples: DataFrame) -> DataFrame:
    """``(row_id, cand)``: adjacent rows that share just one warm candidate, neither labelled by a triple."""
    marked = triples.select("row_id").withColumn("t", F.lit(True))
    pairs = adjacent_shared(sets).where(F.size("common") == 1)
    free = pairs.join(marked, "row_id", "left_anti").join(marked.select((F.col("row_id") - 1).alias("row_id")), "row_id", "left_anti")
    return _agreed(free.select(F.explode(F.array(F.col("row_id"), F.col("row_id") + 1)).alias("row_id"), F.get("common", F.lit(0)).alias("cand")))


def answer_labels(triples: DataFrame, pairs: DataFrame) -> DataFrame:
    """Labels of both kinds; a triple's wins."""
    return triples.alias("t").join(pairs.alias("p"), "row_id", "full").select("row_id", F.coalesce("t.cand", "p.cand").alias("cand"), F.col("t.cand").isNotNull().alias("from_triple"))


def top_two(cells: DataFrame) -> DataFrame:
    """``(row_id, src, time, c1, c2, p1, p2, s1, s2, margin)`` of the best two cells."""
    best = stable_rank(cells).where("rank <= 2")
    pick = lambda c, k: F.max(F.when(F.col("rank") == k, F.col(c)))
    got = best.groupBy("row_id", "src", "time").agg(pick("cand", 1).alias("c1"), pick("cand", 2).alias("c2"), pick("pos", 1).alias("p1"), pick("pos", 2).alias("p2"), pick("score", 1).alias("s1"), pick("score", 2).alias("s2"))
    return got.withColumn("margin", F.col("s1") - F.col("s2"))


def pair_promotion(cells: DataFrame, sets: DataFrame, triples: DataFrame) -> DataFrame:
    """``(row_id, cand)``: the giver's top candidate is shared with the adjacent target and is not the target's own."""
    tops = top_two(cells).select("row_id", "c1")
    joined = adjacent_shared(sets).join(tops, "row_id").join(tops.select((F.col("row_id") - 1).alias("row_id"), F.col("c1").alias("d1")), "row_id")
    gifts = joined.select("common", F.explode(F.array(F.struct((F.col("row_id") + 1).alias("row_id"), F.col("c1").alias("cand"), F.col("d1").alias("own")), F.struct("row_id", F.col("d1").alias("cand"), F.col("c1").alias("own")))).alias("g"))
    ok = gifts.where(F.array_contains("common", F.col("g.cand")) & (F.col("g.cand") != F.col("g.own"))).select("g.row_id", "g.cand")
    return _agreed(ok.join(triples.select("row_id"), "row_id", "left_anti"))


def structural_labels(sets: DataFrame, orig: str = "row_id") -> DataFrame:
    """Triple and pair labels over rows that are consecutive by ``orig``; triples override."""
    rows = sets.withColumn("row_id", F.col(orig))
    triples = triple_rule(rows)
    return answer_labels(triples, pair_labels(rows, triples))


def zero_repeat_exclusion(cells: DataFrame, labels: DataFrame, triples: DataFrame) -> DataFrame:
    """``(row_id, pos)``: cells that hold the source's answer of another time; a row's own triple label is spared."""
    rows = cells.select("row_id", "src", "time").distinct()
    answers = labels.select("row_id", F.col("cand")).join(rows, "row_id").select("src", "cand", F.col("time").alias("at")).distinct()
    met = cells.select("row_id", "src", "time", "pos", "cand").join(answers, ["src", "cand"]).where("time <> at").select("row_id", "pos", "cand").distinct()
    return met.join(triples, ["row_id", "cand"], "left_anti").select("row_id", "pos")


def duplicate_cells(cells: DataFrame, triples: DataFrame) -> DataFrame:
    """``(row_id, pos)``: cells whose candidate occurs more than once in the slate; counted before anything is joined."""
    places = cells.groupBy("row_id", "cand").agg(F.collect_list("pos").alias("places")).where(F.size("places") > 1)
    return places.join(triples, ["row_id", "cand"], "left_anti").select("row_id", F.explode("places").alias("pos"))


def zero_repeat_demotions(cells: DataFrame, labels: DataFrame, triples: DataFrame) -> DataFrame:
    """``(row_id, pos, level)``: 2 for excluded answers, 1 for duplicates; the higher level stays."""
    two = zero_repeat_exclusion(cells, labels, triples).withColumn("level", F.lit(2))
    one = duplicate_cells(cells, triples).withColumn("level", F.lit(1))
    return two.union(one).groupBy("row_id", "pos").agg(F.max("level").alias("level"))


def run_exclusion(cells: DataFrame, log: DataFrame, protected: DataFrame, min_run: int = 2) -> DataFrame:
    """``(row_id, pos, level)``: of a warm candidate's runs of consecutive rows within one time, all but the longest.

    A run starts where the row before does not hold the candidate. Rows of one
    candidate are numbered in blocks of ``RUN_BLOCK`` row ids, and only the blocks'
    last starts are put in order, so a popular candidate's rows are not one task.
    """
    warm = written(warm_flag(cells, log).where("warm").select("row_id", "time", "pos", "cand"), "warm")
    rows = warm.select("row_id", "time", "cand").distinct()
    before = rows.select((F.col("row_id") + 1).alias("row_id"), "time", "cand", F.lit(True).alias("goes_on"))
    marked = rows.join(before, ["row_id", "time", "cand"], "left").select("row_id", "time", "cand", F.floor(F.col("row_id") / RUN_BLOCK).alias("block"), F.when(F.col("goes_on").isNull(), F.col("row_id")).alias("start"))
    key = ["time", "cand"]
    within = F.max("start").over(Window.partitionBy(*key, "block").orderBy("row_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    carry = marked.groupBy(*key, "block").agg(F.max("start").alias("s")).select(*key, "block", F.max("s").over(Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("carry"))
    runs = written(marked.withColumn("within", within).join(carry, [*key, "block"]).select("row_id", *key, F.coalesce("within", "carry").alias("run")), "runs")
    sizes = runs.groupBy(*key, "run").agg(F.count(F.lit(1)).alias("n"))
    longest = sizes.groupBy(*key).agg(F.max("n").alias("top"))
    short = runs.join(sizes.join(longest, key).where((F.col("top") >= min_run) & (F.col("n") < F.col("top"))), [*key, "run"]).select("row_id", "cand")
    free = short.join(protected, ["row_id", "cand"], "left_anti")
    return warm.join(free, ["row_id", "cand"]).select("row_id", "pos", F.lit(1).alias("level"))


def apply_demotions(cells: DataFrame, demotions: DataFrame) -> DataFrame:
    """Rows with any demotion are squeezed above their demoted cells; other rows stay."""
    joined = cells.join(demotions, ["row_id", "pos"], "left")
    touched = F.max(F.col("level").isNotNull()).over(row())
    return joined.withColumn("score", F.when(touched, demoted(F.col("score"), F.col("level"))).otherwise(F.col("score"))).drop("level")


def _promoted(cells: DataFrame, chosen: Column) -> DataFrame:
    lifted = cells.withColumn("score", F.when(chosen, promoted_value(F.col("score"))).otherwise(F.col("score")))
    return lifted.withColumn("score", row_max_normalise(F.col("score")))


def source_slate_recurrence(cells: DataFrame, log: DataFrame) -> DataFrame:
    """Promotes the candidate that recurs most in its source's slates, where it is the only such one.

    The row's top candidate must not be history; eligible are candidates outside
    history; the winner recurs at least twice, alone at the maximum, and is not on
    top already. ``acted`` marks the promoted cells; all rows are max-normalised.
    """
    flagged = stable_rank(slate_recurrence(history_mask(cells, log)))
    eligible = F.when(~F.col("in_history"), F.col("recur"))
    best = F.max(eligible).over(row())
    alone = F.sum(F.when(eligible == best, 1).otherwise(0)).over(row()) == 1
    gate = F.max(F.when(F.col("rank") == 1, F.col("in_history"))).over(row())
    chosen = ~gate & alone & (best >= 2) & F.coalesce(eligible == best, F.lit(False)) & (F.col("rank") != 1)
    return _promoted(flagged.withColumn("acted", chosen), F.col("acted")).select(*cells.columns, "acted")


def graph_reciprocity(cells: DataFrame, log: DataFrame) -> DataFrame:
    """Promotes the second candidate if only it has a reverse edge among the slates, and neither of the two is history."""
    flagged = stable_rank(reverse_edge(history_mask(cells, log)))
    at = lambda c, k: F.max(F.when(F.col("rank") == k, F.col(c))).over(row())
    act = ~at("in_history", 1) & ~at("in_history", 2) & at("is_reverse", 2) & ~at("is_reverse", 1)
    chosen = F.coalesce(act, F.lit(False)) & (F.col("rank") == 2)
    return _promoted(flagged.withColumn("acted", chosen), F.col("acted")).select(*cells.columns, "acted")


def _clusters(cells: DataFrame) -> DataFrame:
    """Top-two rows with their (source, top) group's clusters by time: the keeper has the largest margin, ties to the smallest time."""
    tops = top_two(cells)
    clusters = tops.groupBy("src", "c1", "time").agg(F.max("margin").alias("top_margin"), F.count(F.lit(1)).alias("size"))
    group = Window.partitionBy("src", "c1")
    ranked = clusters.withColumn("place", F.row_number().over(group.orderBy(F.desc("top_margin"), F.asc("time")))).withColumn("times", F.count(F.lit(1)).over(group))
    return tops.join(ranked, ["src", "c1", "time"])


def cross_time_exclusivity(cells: DataFrame) -> DataFrame:
    """Swaps the best two scores of rows whose top candidate belongs to another time of their source. One pass."""
    acts = _clusters(cells).where("times >= 2 AND place > 1").select("row_id", "p1", "p2", "s1", "s2")
    joined = cells.join(acts, "row_id", "left")
    swapped = F.when(F.col("pos") == F.col("p1"), F.col("s2")).when(F.col("pos") == F.col("p2"), F.col("s1")).otherwise(F.col("score"))
    return joined.withColumn("score", swapped).withColumn("acted", F.col("p1").isNotNull()).select(*cells.columns, "acted")


def exclusivity_census(cells: DataFrame) -> DataFrame:
    """One row of statistics of the (source, top) groups; groups are aggregated before they are summed."""
    rows = _clusters(cells)
    groups = rows.groupBy("src", "c1").agg(F.count(F.lit(1)).alias("n"), F.max("times").alias("times"), F.max("size").alias("largest"), F.count_if(F.col("place") == 1).alias("keepers"))
    bad = F.col("times") >= 2
    total = lambda c: F.coalesce(F.sum(F.when(bad, F.col(c))), F.lit(0))
    return groups.agg(
        F.sum("n").alias("n_rows"),
        F.count(F.lit(1)).alias("src_top1_groups"),
        F.count_if(F.col("n") >= 2).alias("groups_multirow"),
        F.count_if((F.col("n") >= 2) & (F.col("times") == 1)).alias("groups_multirow_same_time_only"),
        F.count_if(bad).alias("violation_groups"),
        total("n").alias("rows_in_violation_groups"),
        (total("n") - total("largest")).alias("guaranteed_wrong"),
        (total("n") - total("keepers")).alias("planned_action_rows"),
        total("keepers").alias("keeper_rows"),
        F.coalesce(F.max(F.when(bad, F.col("n"))), F.lit(0)).alias("max_violation_group_size"),
    )


def history_mask_demote(cells: DataFrame, log: DataFrame) -> DataFrame:
    """History candidates fall below the row's minimum, then the row is min-max normalised."""
    flagged = history_mask(cells, log)
    low = flagged.withColumn("score", F.when(F.col("in_history"), F.min("score").over(row()) - 1.0).otherwise(F.col("score")))
    return low.withColumn("score", row_minmax(F.col("score"))).select(*cells.columns)


def virtual_edge_harvest(cells: DataFrame, log: DataFrame, k: int = 2, least: float = 0.97) -> DataFrame:
    """``(src, dst)``: confident top candidates that are no pair of the log yet."""
    best = stable_rank(cells).where((F.col("rank") <= k) & (F.col("score") > least)).select("src", F.col("cand").alias("dst")).distinct()
    return best.join(log.select("src", "dst").distinct(), ["src", "dst"], "left_anti")


def _reliability(cells: DataFrame, sets: DataFrame, eta: float, bins: int, off: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The table of bins, the one row of their edges, and ``(cand, f)``."""
    freq = cells.groupBy("cand").agg(F.count(F.lit(1)).alias("f"))

    def shared(d: int) -> tuple[DataFrame, DataFrame]:
        met = adjacent_shared(sets, d)
        one = met.where(F.size("common") == 1).select(F.get("common", F.lit(0)).alias("cand"))
        return met.agg(F.count(F.lit(1)).alias("e")), one.join(freq, "cand").select("f")

    e1, f1 = shared(1)
    e5, f5 = shared(off)
    edges = f1.agg(F.percentile("f", F.array(*[F.lit(i / bins) for i in range(1, bins)])).alias("edges"))

    def binned(f: DataFrame, name: str) -> DataFrame:
        return f.join(F.broadcast(edges)).groupBy(_bin().alias("bin")).agg(F.count(F.lit(1)).alias(name))

    all_bins = cells.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    n = all_bins.join(binned(f1, "n1"), "bin", "left").join(binned(f5, "n5"), "bin", "left").na.fill(0)
    met = n.join(F.broadcast(e1.withColumnRenamed("e", "e1"))).join(F.broadcast(e5.withColumnRenamed("e", "e5")))
    raw = 1 - (F.col("n5") / F.nullif(F.col("e5"), F.lit(0))) / F.greatest(F.col("n1") / F.nullif(F.col("e1"), F.lit(0)), F.lit(1e-12))
    p = met.withColumn("p", F.least(F.greatest(F.coalesce(raw, F.lit(1.0)), F.lit(0.02)), F.lit(0.995)))
    logit = p.withColumn("lo", F.log(F.col("p") / (1 - F.col("p"))))
    mean = logit.agg((F.sum(F.col("lo") * F.col("n1")) / F.nullif(F.sum("n1"), F.lit(0))).alias("mean"))
    factor = F.least(F.greatest(F.exp(eta * (F.col("lo") - F.coalesce("mean", F.lit(0.0)))), F.lit(0.3)), F.lit(3.0))
    return logit.join(F.broadcast(mean)).select("bin", "n1", "n5", "p", factor.alias("factor")), edges, freq


def _bin() -> Column:
    return F.size(F.filter("edges", lambda e: e <= F.col("f")))


def reliability_bins(cells: DataFrame, sets: DataFrame, eta: float = 1.0, bins: int = 5, off: int = 5) -> DataFrame:
    """``(bin, n1, n5, p, factor)``: how often a candidate shared by adjacent rows is more than chance, by slate frequency.

    Pairs at distance 1 and a placebo at distance ``off`` share just one warm
    candidate; bins are quantiles of the frequency of the former.
    """
    return _reliability(cells, sets, eta, bins, off)[0]


def candidate_factors(cells: DataFrame, sets: DataFrame, eta: float = 1.0, bins: int = 5, off: int = 5) -> DataFrame:
    """``(cand, factor)``: the reliability of each candidate's bin; all are 1 where no pair shares just one."""
    table, edges, freq = _reliability(cells, sets, eta, bins, off)
    placed = freq.join(F.broadcast(edges)).select("cand", _bin().alias("bin"))
    return placed.join(F.broadcast(table), "bin", "left").select("cand", F.coalesce("factor", F.lit(1.0)).alias("factor"))


def census_faults(census: dict, expected: dict) -> list[str]:
    """What differs between a census and what was recorded of it, and what contradicts itself; nothing if it holds."""
    faults = [f"{k}: {census.get(k)} instead of {v}" for k, v in sorted(expected.items()) if census.get(k) != v]
    c = {k: v or 0 for k, v in census.items()}
    laws = {
        "a group has at least one row": c["n_rows"] >= c["src_top1_groups"],
        "groups of several rows are of one time or of several": c["groups_multirow"] == c["groups_multirow_same_time_only"] + c["violation_groups"],
        "a row in a violating group is kept or acted on": c["rows_in_violation_groups"] == c["planned_action_rows"] + c["keeper_rows"],
        "a violating group keeps at least one row and acts on one": c["violation_groups"] <= min(c["keeper_rows"], c["planned_action_rows"]),
        "no more rows are surely wrong than are in violating groups": 0 <= c["guaranteed_wrong"] <= c["rows_in_violation_groups"],
        "no group is larger than all of them": c["max_violation_group_size"] <= c["rows_in_violation_groups"],
    }
    return faults + [f"broken: {law}" for law, holds in laws.items() if not holds]
