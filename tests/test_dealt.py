"""Operators at size: what is dealt by source is not shuffled again, and the results are those of plain loops."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kairograph.functions.scores import promote_in_unit, row, row_minmax
from kairograph.operators import byblock, bysource, bystretch, crf, history, replay, rules
from kairograph.plans import features, registry
from kairograph.sources import stored
from kairograph.sources.shared import written

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("far", [1, 1 << 40])
def test_cooccurrence_by_source_shuffles_no_pairs(spark, far):
    """Sources far apart and near, one without history, null ids; neither cells nor pairs of sources are joined or shuffled."""
    edges = [(s * far, d, 0.0) for s in range(7) for d in range(9) if (s * 5 + d * 3) % 4 < 2 for _ in range(1 + (s + d) % 2)] + [(None, 3, 0.0), (2 * far, None, 0.0)]
    log = spark.createDataFrame(edges, "src long, dst long, time double")
    asked = [(s * far, c) for s in range(8) for c in range(11)] + [(None, 1), (far, None)]
    wanted = spark.createDataFrame(asked * 2, "src long, cand long").repartition(4, "src")
    out = history.cooc_cf(wanted, log, "src")
    assert "Join" not in plan(out) and plan(out).count("Exchange hashpartitioning") == 1
    w, total = Counter((a, b) for a, b, _ in edges if a is not None and b is not None), Counter(b for _, b, _ in edges)
    found = {(r.src, r.cand): r.cooc for r in out.collect()}
    assert found.keys() == set(asked)
    for (s, c), v in found.items():
        own = sum(w[s, d] * w[u * far, d] * w[u * far, c] for u in range(7) if u * far != s for d in range(9)) if s is not None and c is not None else 0
        assert v == pytest.approx(own / (total[c] + 1) ** 0.5)


def test_features_by_source_shuffle_no_cells(spark):
    """Cells that come dealt by source go through one shuffle, the one that dealt them, and give the rows of the undealt ones."""
    inputs = registry.Inputs(spark, DATA, "orders")
    log, cells = written(inputs.train, "log"), written(inputs.slates, "cells")
    dealt = features.features_ds2(cells.repartition(4, "src"), log, inputs.vectors)
    assert plan(dealt).count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan(dealt)
    rows = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    assert rows(dealt) == rows(features.features_ds2(cells, log, inputs.vectors))


def test_rank_metric_of_rows_that_stay_together(spark):
    """Ranks counted where the cells are, over batches that cut rows, are those by windows."""
    r = random.Random(4)
    cells = [(row, p, int(p == row % 9), r.randrange(5) / 4) for row in range(3000) for p in range(9 if row % 7 else 1) if p or row % 5]
    df = spark.createDataFrame(cells, "row_id long, pos long, label int, score double").repartition(3, "row_id").sortWithinPartitions("row_id", "pos")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        found = replay.mrr(df, together=True)
        assert plan(found).count("Exchange hashpartitioning") == 2 and found.collect() == replay.mrr(df).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_the_chain_by_source_shuffles_no_cells_and_gives_what_its_rules_give(spark, monkeypatch):
    """Few ids, so that everything happens; batches cut rows and sources; cells out of order are refused."""
    r = random.Random(8)
    slates = [(k, r.randrange(12), float(k // 40), [r.randrange(14) for _ in range(1 + k % 6)]) for k in range(400)]
    cells = spark.createDataFrame([(k, s, t, p, c, r.randrange(40) / 40 - (k % 5 == 0)) for k, s, t, x in slates for p, c in enumerate(x)] + [(400, None, 0.0, 0, 1, 0.5)], "row_id long, src long, time double, pos long, cand long, score double")
    log = spark.createDataFrame([(r.randrange(12), r.randrange(10), 0.0) for _ in range(30)] + [(None, 1, 0.0), (2, None, 0.0)], "src long, dst long, time double")
    want, lifts = cells, []
    for rule in (rules.source_slate_recurrence, rules.graph_reciprocity):
        want = rule(want, log)
        lifts.append(want.where("acted").count())
        want = want.drop("acted")
    assert min(lifts) > 3
    monkeypatch.setattr(stored, "BLOCK", 300)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    try:
        dealt = cells.repartition(3, "src").sortWithinPartitions("src", "row_id", "pos")
        found = bysource.ds1_chain(dealt, log, dealt=True)
        assert "Join" not in plan(found) and plan(found).count("Exchange hashpartitioning") == 1
        rows = lambda df: {(x.row_id, x.pos): pytest.approx(x.score, abs=1e-12) for x in df.collect()}
        assert rows(found) == rows(want) == rows(bysource.ds1_chain(cells, log))
        with pytest.raises(Exception, match="in order"):
            bysource.ds1_chain(cells.repartition(1).sortWithinPartitions("pos"), log, dealt=True).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_groups_are_whole_in_every_slice():
    import pyarrow as pa

    keys = sorted(random.Random(1).choices(range(40), k=900)) + [50] * 300
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[k : k + 70]), pa.array(range(k, min(k + 70, 1200)))], names=["a", "b"]) for k in range(0, 1200, 70)]
    found = [(a.tolist(), b.tolist()) for a, b in stored.groups_in_order(batches, 2, order=2, size=100)]
    assert sum((a for a, _ in found), []) == keys and sum((b for _, b in found), []) == list(range(1200)) and len(found) > 3
    assert all(not set(found[k][0]) & set(found[k + 1][0]) for k in range(len(found) - 1))


@pytest.mark.parametrize("first, last", [(4050, 4150), (1000, 6500)])
def test_runs_by_block_shuffle_no_cells_and_are_those_by_joins(spark, first, last):
    """Rows around the edges of blocks, one run over an edge that is longer than what is seen at first, and one of thousands of rows."""
    r = random.Random(5)
    rows = [(k, r.randrange(9), 0.0 if first <= k <= last else 1.0 + k // 300, [r.randrange(25) for _ in range(3)] + [7] * (first <= k <= last)) for k in range(8300) if k % 1000]
    cells = spark.createDataFrame([(k, s, t, p, c) for k, s, t, x in rows for p, c in enumerate(x)] + [(8300, None, 3.0, 0, 1), (8301, 1, 3.0, 0, None)], "row_id long, src long, time double, pos long, cand long")
    cells = written(cells.withColumn("block", F.floor(F.col("row_id") / byblock.ROWS)), "cells").repartition(4, "block").sortWithinPartitions("block", "row_id", "pos").drop("block")
    log = spark.createDataFrame([(1, d, 0.0) for d in range(20)] + [(1, None, 0.0)], "src long, dst long, time double")
    want = rules.run_exclusion(cells, log, rules.triple_rule(rules.slate_sets(cells, log)))
    found = byblock.run_exclusion(cells, log, dealt=True)
    if last - first < byblock.ROWS // 2:
        assert "Join" not in plan(found) and plan(found).count("Exchange hashpartitioning") == 1
    pick = lambda df: sorted((x.row_id, x.pos, x.level) for x in df.collect())
    got = pick(found)
    assert got == pick(want) and len(got) > 500


def chain_by_rules(cells, log):
    """The chain, step by step, by joins; and how many cells each step acts on."""
    sets = written(rules.slate_sets(cells, log), "sets")
    triples = written(rules.triple_rule(sets), "triples")
    labels = written(rules.answer_labels(triples, rules.pair_labels(sets, triples)), "labels")
    scored = crf.equality_crf(cells, log).withColumn("score", row_minmax(F.col("score")))
    marked = scored.join(triples.select("row_id", F.col("cand").alias("answer")), "row_id", "left")
    first = F.min(F.when(F.col("cand") == F.col("answer"), F.col("pos"))).over(row())
    promoted = marked.withColumn("score", promote_in_unit(F.col("score"), F.coalesce(F.col("pos") == first, F.lit(False)))).drop("answer")
    hard = rules.zero_repeat_demotions(cells, labels, triples)
    runs = rules.run_exclusion(cells, log, triples).join(hard, ["row_id", "pos"], "left_anti")
    out = rules.cross_time_exclusivity(rules.apply_demotions(promoted, hard.union(runs).dropDuplicates(["row_id", "pos"])))
    return out, [triples.count(), labels.where("NOT from_triple").count(), hard.where("level = 2").count(), hard.where("level = 1").count(), runs.count(), out.where("acted").count()]


def test_the_basket_chain_by_stretches_shuffles_no_cells_and_gives_what_its_rules_give(spark, monkeypatch):
    """Small blocks, a stretch longer than a block, gaps, doubles and nulls; batches cut rows; ties of margins go to the smallest time."""
    r = random.Random(3)
    slates = []
    for k in range(700):
        long_ = 220 <= k <= 400
        slate = [r.randrange(60) for _ in range(1 + k % 6)] + [100 + k // 4] * (k % 4 < 3) + [7] * long_
        slates.append((k, r.randrange(9), 50.5 if long_ else float(k // 40), slate))
    slates = [x for x in slates if x[0] % 211 != 5]
    cells = [(k, s, t, p, c, r.randrange(40) / 40 - (k % 5 == 0)) for k, s, t, x in slates for p, c in enumerate(x)]
    cells += [(700, None, 17.0, p, c, v) for p, (c, v) in enumerate([(None, None), (1, 0.5), (None, None), (7, 0.25), (1, 0.25)])]
    cells += [(701, None, 17.0, 0, None, None), (702, 2, None, 0, 7, 0.5), (703, 2, None, 0, 7, 0.5), (704, 2, -3.0, 0, 7, 0.5), (705, 3, -3.0, 0, 7, 0.5), (705, 3, -3.0, 1, None, 0.75)]
    names = "row_id long, src long, time double, pos long, cand long, score double"
    cells = written(spark.createDataFrame(cells, names), "cells")
    log = spark.createDataFrame([(1, d, 0.0) for d in [*range(40), *range(100, 275)]] + [(None, 1, 0.0), (2, None, 0.0)], "src long, dst long, time double")
    top_two = rules.top_two
    monkeypatch.setattr(rules, "top_two", lambda c: top_two(c).withColumn("margin", F.round("margin", 12)))
    want, acts = chain_by_rules(cells, log)
    assert min(acts) > 5
    plans = {}
    monkeypatch.setattr(bystretch, "written", lambda df, name: plans.update({name: plan(df)}) or written(df, name))
    monkeypatch.setattr(stored, "BLOCK", 300)
    for module in (byblock, bystretch):
        monkeypatch.setattr(module, "ROWS", 64)
    monkeypatch.setattr(bystretch, "EDGE", 4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    try:
        block = F.floor(F.col("row_id") / 64)
        blocks = cells.withColumn("block", block).repartition(3, "block").sortWithinPartitions("block", "row_id", "pos").drop("block")
        seen = []

        def deal(place):
            out = place(cells)
            seen.extend(x.n for x in out.groupBy("part").agg(F.count_distinct("row_id").alias("n")).collect())
            return out.repartition(3, "part").sortWithinPartitions("part", "row_id", "pos")

        found = bystretch.ds2_chain(blocks, log, deal)
        assert max(seen) > 128 and len(seen) > 6
        assert all("Join" not in plans[n] and plans[n].count("Exchange hashpartitioning") == 1 for n in ("seen", "rows")) and "Exchange" not in plan(found)
        rows = lambda df: {(x.row_id, x.pos): x.score if x.score is None else pytest.approx(x.score, abs=1e-11) for x in df.collect()}
        assert rows(found) == rows(want)
        whole = features.ds2_chain(cells, log)
        assert whole.columns == cells.columns and rows(whole) == rows(want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
