"""Aggregates of the log and of the slates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

YEAR_DAYS = 365.0


def dedup_interactions(log: DataFrame) -> DataFrame:
    return log.dropDuplicates(["src", "dst", "time"])


def dst_popularity(log: DataFrame) -> DataFrame:
    n = log.groupBy("dst").agg(F.count(F.lit(1)).alias("n"))
    return n.select("dst", (F.col("n") + 1).alias("pop"), F.log1p((F.col("n") + 1).cast("double")).alias("pop_log"))


def recent_popularity(log: DataFrame, quantile: float = 0.8) -> DataFrame:
    """``log1p(count)`` of the interactions from the exact time quantile on."""
    from_ = log.agg(F.percentile("time", F.lit(quantile)).alias("from_time"))
    return log.join(F.broadcast(from_)).where("time >= from_time").groupBy("dst").agg(F.log1p(F.count(F.lit(1)).cast("double")).alias("rpop"))


def popularity_windows(log: DataFrame, short: float = 0.05, long: float = 0.40) -> DataFrame:
    """``log1p`` of counts in trailing fractions of the time span, and their difference; one pass for both."""
    span = log.agg(F.min("time").alias("lo"), F.max("time").alias("hi"))
    each = log.join(F.broadcast(span))
    counts = each.groupBy("dst").agg(*[F.log1p(F.count_if(F.col("time") >= F.col("hi") - f * (F.col("hi") - F.col("lo"))).cast("double")).alias(name) for f, name in ((short, "pop_short"), (long, "pop_long"))])
    return counts.select("dst", "pop_short", "pop_long", (F.col("pop_short") - F.col("pop_long")).alias("pop_diff"))


def graph_recency(log: DataFrame) -> DataFrame:
    """``(latest(dst) - first) / (freeze - first)`` with the log's own last time as freeze."""
    span = log.agg(F.min("time").alias("lo"), F.max("time").alias("hi"))
    last = log.groupBy("dst").agg(F.max("time").alias("last"))
    return last.join(F.broadcast(span)).select("dst", ((F.col("last") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))).alias("recency"))


def source_last_gap(rows: DataFrame, log: DataFrame) -> DataFrame:
    """Years since the source's last interaction; since the log's first time for unknown sources."""
    span = log.agg(F.min("time").alias("lo"))
    last = log.groupBy("src").agg(F.max("time").alias("last"))
    joined = rows.select("row_id", "src", "time").join(last, "src", "left").join(F.broadcast(span))
    return joined.select("row_id", ((F.col("time") - F.coalesce("last", "lo")) / YEAR_DAYS).alias("last_gap"))


def candidate_frequency(cells: DataFrame) -> DataFrame:
    n = cells.groupBy("cand").agg(F.count(F.lit(1)).alias("freq"))
    return n.select("cand", "freq", F.log1p(F.col("freq").cast("double")).alias("freq_log"))


def popularity_ratio(cells: DataFrame, log: DataFrame) -> DataFrame:
    pop = log.groupBy(F.col("dst").alias("cand")).agg(F.count(F.lit(1)).alias("n"))
    joined = candidate_frequency(cells).join(pop, "cand", "left")
    return joined.select("cand", ((F.coalesce("n", F.lit(0)) + 1) / (F.col("freq") + 1)).alias("ratio"))


def slate_recurrence(cells: DataFrame) -> DataFrame:
    """``recur``: cells of the same (src, cand) other than this one; counted on the map side, then joined back."""
    counts = cells.groupBy("src", "cand").agg((F.count(F.lit(1)) - 1).alias("recur"))
    return cells.join(counts, ["src", "cand"]).select(*cells.columns, "recur")


def candidate_pool(cells: DataFrame) -> DataFrame:
    return cells.select("src", "cand").distinct()


def graph_profile(log: DataFrame) -> DataFrame:
    """One row of counts, ranges, overlap and the graph's type; ids are compared by one distinct union."""
    counts = log.agg(F.count(F.lit(1)).alias("rows"), F.min("time").alias("min_time"), F.max("time").alias("max_time"), F.count_if(F.col("src") == F.col("dst")).alias("self_loops"))
    sides = log.select(F.col("src").alias("id"), F.lit(1).alias("side")).union(log.select("dst", F.lit(2))).distinct()
    each = sides.groupBy("id").agg(F.sum("side").alias("sides"))
    ids = each.agg(F.count_if(F.col("sides") != 2).alias("n_src"), F.count_if(F.col("sides") != 1).alias("n_dst"), F.count_if(F.col("sides") == 3).alias("n_both"))
    return counts.join(F.broadcast(ids)).withColumn("bipartite", F.col("n_both") == 0)


def repeat_rate(log: DataFrame) -> DataFrame:
    """Rows, rows that repeat an earlier pair, and their share."""
    pairs = log.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    return pairs.agg(F.sum("n").alias("rows"), F.sum(F.col("n") - 1).alias("repeats")).select("rows", "repeats", (F.col("repeats") / F.col("rows")).alias("rate"))


def reciprocity_rate(log: DataFrame) -> DataFrame:
    """Distinct pairs, those whose reverse is a pair too, and their share; one aggregation by unordered pair."""
    pairs = log.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.when(F.col("src") < F.col("dst"), 1).otherwise(2).alias("way")).distinct()
    both = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("ways"))
    return both.agg(F.sum("ways").alias("pairs"), F.coalesce(F.sum(F.when(F.col("ways") == 2, 2).otherwise(0)), F.lit(0)).alias("reciprocal")).select("pairs", "reciprocal", (F.col("reciprocal") / F.col("pairs")).alias("rate"))


def _running(weights: DataFrame, key: str, weight: str) -> DataFrame:
    """``cdf``: the running share of weight by key.

    Keys are dealt into ranges, each range sums on its own, and only the ranges'
    totals are summed in order.
    """
    size = 1024
    parts = weights.withColumn("part", F.floor(F.col(key) / size))
    sums = parts.groupBy("part").agg(F.sum(weight).alias("s"))
    before = sums.select("part", (F.sum("s").over(Window.orderBy("part")) - F.col("s")).alias("before"), F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    within = F.sum(weight).over(Window.partitionBy("part").orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return parts.withColumn("within", within).join(before, "part").withColumn("cdf", (F.col("before") + F.col("within")) / F.col("total"))


def recency_cdf(log: DataFrame, fraction: float = 0.25) -> DataFrame:
    """Running share, by time, of the weight ``exp(-(last - time) / tau)`` with tau a fraction of the span."""
    span = log.agg(F.min("time").alias("lo"), F.max("time").alias("hi"))
    days = log.groupBy("time").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(span))
    weights = days.withColumn("wt", F.col("n") * F.exp(-(F.col("hi") - F.col("time")) / (fraction * (F.col("hi") - F.col("lo")))))
    return _running(weights, "time", "wt").select("time", "n", "cdf")


def degree_cdf(log: DataFrame) -> DataFrame:
    """Running share, by destination, of ``(count + 1) ** 0.75``."""
    weights = log.groupBy("dst").agg(F.pow(F.count(F.lit(1)) + 1, F.lit(0.75)).alias("wt"))
    return _running(weights, "dst", "wt").select("dst", "cdf")


def first_occurrence(log: DataFrame) -> DataFrame:
    """The first interaction of every pair."""
    return log.groupBy("src", "dst").agg(F.min("time").alias("time"))


def bidirectional_edges(log: DataFrame) -> DataFrame:
    return log.select("src", "dst").union(log.select(F.col("dst"), F.col("src")))


def virtual_edge_union(log: DataFrame, virtual: DataFrame) -> DataFrame:
    """Multiplicities with a weight of 1 added for every virtual edge."""
    real = log.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w"))
    return real.union(virtual.select("src", "dst", F.lit(1.0))).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def dense_group_ids(df: DataFrame, *keys: str, block: int = 1024) -> DataFrame:
    """``gid``: numbers of the distinct keys in their order.

    Distinct keys are ranked within blocks of ``block`` values of the first key,
    and each block starts after the groups of all smaller ones; one row per block is
    put in order by one task.
    """
    first = keys[0]
    distinct = df.select(*keys).distinct().withColumn("__block", F.floor(F.col(first) / block))
    sizes = distinct.groupBy("__block").count()
    before = sizes.select("__block", (F.sum("count").over(Window.orderBy("__block")) - F.col("count")).alias("__before"))
    ids = distinct.withColumn("__within", F.row_number().over(Window.partitionBy("__block").orderBy(*keys)) - 1).join(before, "__block")
    return ids.select(*keys, (F.col("__before") + F.col("__within")).alias("gid"))


def tail_split(log: DataFrame) -> DataFrame:
    """Each source's last interaction, by (time, dst)."""
    return log.groupBy("src").agg(F.max(F.struct("time", "dst")).alias("last")).select("src", "last.dst", "last.time")


def before_tail(log: DataFrame) -> DataFrame:
    """``(src, dst, time)``: what ``tail_split`` leaves; of interactions equal to a source's last one, one is taken away."""
    counts = log.groupBy("src", "dst", "time").agg(F.count(F.lit(1)).alias("n"))
    gone = tail_split(log).withColumn("gone", F.lit(1))
    left = counts.join(gone, ["src", "dst", "time"], "left").withColumn("n", F.col("n") - F.coalesce("gone", F.lit(0))).where("n > 0")
    return left.select("src", "dst", "time", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("i")).drop("i")


def clip_ids(df: DataFrame, column: str, n: int) -> DataFrame:
    """``column`` clipped to the ids 0 to ``n`` - 1."""
    return df.withColumn(column, F.least(F.greatest(F.col(column), F.lit(0).cast("long")), F.lit(n - 1).cast("long")))


def tie_baseline(width: int) -> float:
    """The mean reciprocal rank of a positive placed at random among ``width`` cells: the harmonic number over the width."""
    return sum(1.0 / k for k in range(1, width + 1)) / width
