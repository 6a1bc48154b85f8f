"""Operators that look candidates up in the interaction log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import dot, l2_normalise
from ..sources.shared import written
from ..sources.stored import EXPANDED, Stored, entries, looked_up, parts, places, rows_of, spans, whole_groups


def pair_weights(log: DataFrame) -> DataFrame:
    """``(src, dst, w)``: multiplicity of every pair."""
    return log.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w"))


def history_mask(cells: DataFrame, log: DataFrame) -> DataFrame:
    """``in_history``: the directed edge (src, cand) is in the log."""
    pairs = log.select("src", F.col("dst").alias("cand")).distinct().withColumn("hit", F.lit(True))
    return cells.join(pairs, ["src", "cand"], "left").withColumn("in_history", F.coalesce("hit", F.lit(False))).drop("hit")


def history_count(cells: DataFrame, log: DataFrame) -> DataFrame:
    """``n_hist``: occurrences of (src, cand) in the log."""
    pairs = pair_weights(log).withColumnRenamed("dst", "cand")
    return cells.join(pairs, ["src", "cand"], "left").withColumn("n_hist", F.coalesce("w", F.lit(0))).drop("w")


def history_before_time(rows: DataFrame, log: DataFrame) -> DataFrame:
    """``(row_id, hist)``: the source's destinations strictly before the row's time, in order of (time, dst).

    A source's history is collected once and cut for each of its rows: rows of a busy
    source share it, and no row meets the log's rows one by one.
    """
    asked = rows.select("src").distinct()
    whole = log.join(asked, "src", "left_semi").groupBy("src").agg(F.sort_array(F.collect_list(F.struct(F.col("time").alias("at"), "dst"))).alias("h"))
    met = rows.select("row_id", "src", "time").join(whole, "src")
    earlier = F.filter("h", lambda e: e["at"] < F.col("time"))
    return met.select("row_id", F.transform(earlier, lambda e: e["dst"]).alias("hist")).where(F.size("hist") > 0)


def reverse_edge(cells: DataFrame) -> DataFrame:
    """``is_reverse``: the slates also expose (cand, src)."""
    exposed = cells.select(F.col("cand").alias("src"), F.col("src").alias("cand")).distinct().withColumn("hit", F.lit(True))
    return cells.join(exposed, ["src", "cand"], "left").withColumn("is_reverse", F.coalesce("hit", F.lit(False))).drop("hit")


def warm_flag(cells: DataFrame, log: DataFrame) -> DataFrame:
    """``warm``: the candidate is a destination of the log."""
    known = log.select(F.col("dst").alias("cand")).distinct().withColumn("hit", F.lit(True))
    return cells.join(known, "cand", "left").withColumn("warm", F.coalesce("hit", F.lit(False))).drop("hit")


def cooc_cf(pairs_wanted: DataFrame, log: DataFrame, by: str | None = None) -> DataFrame:
    """``(src, cand, cooc)`` of the wanted pairs.

    ``sum_u sum_d w(src, d) w(u, d) w(u, cand) / sqrt(count(cand) + 1)`` over other
    sources u. The triple product is taken in the cheaper order: by sources (pairs of
    sources that share a destination) or by destinations (pairs of destinations that
    share a source), whichever has the smaller sum of squared degrees, counted first.
    All terms are whole numbers, so both orders give the same sums. By sources, a worker
    looks both sides of the log up and sums one source at a time, so no pair of sources
    is shuffled; wanted pairs that come dealt by ``src`` are not shuffled either.
    """
    wanted = pairs_wanted.select("src", "cand").distinct()
    w = pair_weights(log)
    if by is None:
        w = written(w, "weights")
        squares = lambda key: w.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0
        by = "dst" if squares("src") <= squares("dst") else "src"
    if by == "src":
        return _cooc_by_source(wanted, w)
    own = w.join(wanted.select("src").distinct(), "src", "left_semi")
    # Only destinations that some wanted pair names meet the others, and a source's own part is taken off again.
    named = w.join(wanted.select(F.col("cand").alias("dst")).distinct(), "dst", "left_semi").select("src", F.col("dst").alias("cand"), F.col("w").alias("wc"))
    met = w.join(named, "src").groupBy("dst", "cand").agg(F.sum(F.col("w") * F.col("wc")).alias("m"))
    norms = own.groupBy("src").agg(F.sum(F.col("w") * F.col("w")).alias("norm"))
    self_part = own.select("src", F.col("dst").alias("cand"), F.col("w").alias("wc")).join(norms, "src").select("src", "cand", (-F.col("norm") * F.col("wc")).alias("s"))
    full = wanted.join(own, "src").join(met, ["dst", "cand"]).select("src", "cand", (F.col("w") * F.col("m")).alias("s"))
    sums = full.union(self_part).groupBy("src", "cand").agg(F.sum("s").alias("s"))
    pop = log.groupBy(F.col("dst").alias("cand")).agg((F.count(F.lit(1)) + 1).alias("pop"))
    return wanted.join(sums, ["src", "cand"], "left").join(pop, "cand", "left").select("src", "cand", (F.coalesce("s", F.lit(0)) / F.sqrt(F.coalesce("pop", F.lit(1)))).alias("cooc"))


def _cooc_by_source(wanted: DataFrame, w: DataFrame) -> DataFrame:
    n = 2 * w.count()
    of_source, of_dst = Stored(entries(w, "src", "dst"), n), Stored(entries(w, "dst", "src"), n)
    pops = Stored(w.where("dst IS NOT NULL").groupBy(F.col("dst").alias("id")).agg(F.array(F.sum("w")).alias("values")), n)
    order = Window.partitionBy("src").orderBy("cand")
    known = F.col("src").isNotNull() & F.col("cand").isNotNull()
    told = wanted.select((F.row_number().over(order) == 1).alias("first"), F.coalesce("src", F.lit(0)).alias("s"), F.coalesce("cand", F.lit(0)).alias("c"), known.alias("known"), F.col("src").isNull().alias("no_src"), F.col("cand").isNull().alias("no_cand"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for first, src, cand, known, no_src, no_cand in whole_groups(batches, 6):
            known = known.astype(bool)
            found = np.zeros(len(src))
            start = np.flatnonzero(first)
            start = start[known[start] | ~no_src[start].astype(bool)]
            ends = np.searchsorted(np.flatnonzero(first), start, "right")
            ends = np.append(np.flatnonzero(first), len(src))[ends]
            found[:] = _cooc(src, cand, known, start, ends, of_source, of_dst, pops)
            yield pa.RecordBatch.from_arrays([pa.array(src, mask=no_src.astype(bool)), pa.array(cand, mask=no_cand.astype(bool)), pa.array(found)], names=["src", "cand", "cooc"])

    return told.mapInArrow(run, "src long, cand long, cooc double")


def _cooc(src, cand, known, start, ends, of_source, of_dst, pops):
    """Co-occurrence of some whole sources' candidates; source i has the rows ``start[i]`` to ``ends[i]`` - 1."""
    import numpy as np

    # A source's weight for each other source: over its destinations, the product of both weights.
    s, d, wd = looked_up(of_source, src[start])
    ds, d = np.unique(d, return_inverse=True)
    first = np.searchsorted(s, np.arange(len(start) + 1))
    # Candidates' sources are looked up once for each distinct candidate.
    cs, c = np.unique(cand, return_inverse=True)
    c_of, cu, cw = looked_up(of_dst, cs)
    c_first = np.searchsorted(c_of, np.arange(len(cs) + 1))
    pop = rows_of(pops, cs, 1, [0])[:, 0]
    d_of, du, dw = looked_up(of_dst, ds)
    d_first = np.searchsorted(d_of, np.arange(len(ds) + 1))
    low, span = (int(du.min()), int(du.max()) - int(du.min()) + 1) if len(du) else (0, 1)
    own = src[start]
    if span > 1 << 24:  # ids too far apart for a table: their places instead
        us = np.unique(du)
        low, span, du, cu, own = 0, len(us), places(us, du), places(us, cu), places(us, own)
    else:
        du, cu, own = du - low, np.where((cu >= low) & (cu < low + span), cu - low, -1), own - low
    own = np.where((own >= 0) & (own < span), own, -1)
    x = np.zeros(span + 1)  # the last place is for sources that are met by none
    sums = np.zeros(len(src))
    for i in range(len(start)):
        a, b = first[i], first[i + 1]
        if a == b:
            continue
        e = d[a:b]
        at, owner = spans(d_first[e], d_first[e + 1] - d_first[e])
        met = du[at]
        np.add.at(x, met, dw[at] * wd[a:b][owner].astype(float))
        x[own[i]] = 0.0
        rows = slice(start[i], ends[i])
        k = c[rows]
        sizes = c_first[k + 1] - c_first[k]
        for y, z in parts(sizes, EXPANDED):
            at, owner = spans(c_first[k[y:z]], sizes[y:z])
            sums[start[i] + y : start[i] + z] = np.bincount(owner, x[cu[at]] * cw[at], minlength=z - y)
        x[met] = 0.0
    return np.where(known, sums / np.sqrt(pop[c] + 1), 0.0)


def unit_vectors(vectors: DataFrame) -> DataFrame:
    return vectors.select("id", l2_normalise(F.col("vec")).alias("vec"))


def item_cf(pairs_wanted: DataFrame, log: DataFrame, vectors: DataFrame) -> DataFrame:
    """``(src, cand, icf_mean, icf_top3)``: cosine of a candidate to the source's history rows, before row normalisation.

    The history is reduced to distinct destinations with multiplicities: the mean
    is weighted by them, and the best three rows are those whose cumulative
    multiplicity, best first, has not reached three. Ids without a vector count
    as vectors of zeros. Sources without history give zeros.
    """
    unit = unit_vectors(vectors)
    wanted = pairs_wanted.select("src", "cand").distinct()
    hist = pair_weights(log).join(wanted.select("src").distinct(), "src", "left_semi").join(unit, F.col("dst") == F.col("id"), "left").select("src", "dst", "w", F.col("vec").alias("hv"))
    cands = wanted.join(unit.select(F.col("id").alias("cand"), F.col("vec").alias("cv")), "cand")  # the others' cosines are all 0
    sims = cands.join(hist, "src").select("src", "cand", "dst", "w", F.coalesce(F.when(F.col("hv").isNotNull(), F.round(dot(F.col("cv"), F.col("hv")), 12)), F.lit(0.0)).alias("sim"))
    best = Window.partitionBy("src", "cand").orderBy(F.desc("sim"), F.asc("dst"))
    run = F.sum("w").over(best.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    part = F.greatest(F.lit(0), F.least(F.col("w"), 3 - (run - F.col("w"))))
    found = sims.withColumn("part", part).groupBy("src", "cand").agg((F.sum(F.col("sim") * F.col("w")) / F.sum("w")).alias("m"), (F.sum(F.col("sim") * F.col("part")) / F.sum("part")).alias("t"))
    zero = F.lit(0.0)
    return wanted.join(found, ["src", "cand"], "left").select("src", "cand", F.greatest(F.coalesce("m", zero), zero).alias("icf_mean"), F.greatest(F.coalesce("t", zero), zero).alias("icf_top3"))


def dot_score(pairs_wanted: DataFrame, vectors: DataFrame, scale: float = 1.0) -> DataFrame:
    """``(src, cand, dot)``: ``max(e_cand . e_src, 0)``; ids without a vector give 0."""
    a = vectors.select(F.col("id").alias("src"), F.col("vec").alias("sv"))
    b = vectors.select(F.col("id").alias("cand"), F.col("vec").alias("cv"))
    joined = pairs_wanted.select("src", "cand").distinct().join(a, "src", "left").join(b, "cand", "left")
    return joined.select("src", "cand", F.coalesce(F.greatest(dot(F.col("sv"), F.col("cv")) * scale, F.lit(0.0)), F.lit(0.0)).alias("dot"))


def user_cf(pairs_wanted: DataFrame, neighbours: DataFrame, log: DataFrame) -> DataFrame:
    """``(src, cand, collab)``: sum over neighbours of weight times the neighbour's multiplicity of the candidate."""
    wanted = pairs_wanted.select("src", "cand").distinct()
    w = pair_weights(log).select(F.col("src").alias("nbr"), F.col("dst").alias("cand"), "w")
    met = wanted.join(neighbours.select("src", "nbr", "weight"), "src").join(w, ["nbr", "cand"])
    sums = met.groupBy("src", "cand").agg(F.sum(F.col("weight") * F.col("w")).alias("collab"))
    return wanted.join(sums, ["src", "cand"], "left").select("src", "cand", F.coalesce("collab", F.lit(0.0)).alias("collab"))


def similar_users_topk(sources: DataFrame, vectors: DataFrame, k: int = 20, band: int = 5, block: int = 1024) -> DataFrame:
    """``(src, nbr, rank, weight)``: exact cosine neighbours, by blocks.

    Sources and vectors are dealt into blocks of bounded size; each pair of
    blocks is one matrix product in a worker, which returns the best ``k`` of the
    block for each source, so what is shuffled next is bounded by ``k`` rows per
    source and block. A source's similarity to itself is 0; weights are the
    similarity up to rank ``band`` and a fifth of it beyond; ties go to the
    smaller id.
    """
    import numpy as np
    import pandas as pd

    unit = unit_vectors(vectors)
    n = unit.count()
    blocks = max(1, -(-n // block))
    members = unit.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    right = members.groupBy("b").agg(F.collect_list(F.struct("id", "vec")).alias("right"))
    left = members.join(sources.select(F.col("src").alias("id")).distinct(), "id", "left_semi").groupBy(F.col("b").alias("a")).agg(F.collect_list(F.struct("id", "vec")).alias("left"))
    pairs = left.select("left", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b")).join(right, "b")

    def product(batches):
        for pdf in batches:
            for own, other in zip(pdf["left"], pdf["right"], strict=True):
                ids, others = np.array([x["id"] for x in own]), np.array([x["id"] for x in other])
                sims = np.array([x["vec"] for x in own]) @ np.array([x["vec"] for x in other]).T
                sims = np.where(ids[:, None] == others[None, :], 0.0, np.round(sims, 9))
                take = min(k, len(others))
                order = np.lexsort((np.broadcast_to(others, sims.shape), -sims), axis=1)[:, :take]
                yield pd.DataFrame({"src": np.repeat(ids, take), "nbr": others[order].ravel(), "sim": np.take_along_axis(sims, order, axis=1).ravel()})

    best = pairs.mapInPandas(product, "src long, nbr long, sim double")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("sim"), F.asc("nbr"))).cast("long")).where(F.col("rank") <= k)
    weight = F.when(F.col("rank") <= band, F.col("sim")).otherwise(F.col("sim") * 0.2)
    return ranked.select("src", "nbr", "rank", F.when(F.abs(weight) < 1e-8, 0.0).otherwise(weight).alias("weight"))
