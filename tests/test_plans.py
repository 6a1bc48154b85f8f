"""Readers and writers, stages and their reasons, models, and queries against their SQL."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kairograph.operators import embedding, models
from kairograph.plans import chains, registry, stages
from kairograph.sources import matrices

DATA = "/root/testdata/sf0.001"


def test_slates_from_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text("src,time,c10,c2,c1\n1,5,30,20,10\n2,6,31,21,11\n")
    out = matrices.read_slates(spark, str(tmp_path / "t.csv")).orderBy("row_id", "pos").collect()
    assert [(r.row_id, r.src, r.pos, r.cand) for r in out] == [(0, 1, 0, 10), (0, 1, 1, 20), (0, 1, 2, 30), (1, 2, 0, 11), (1, 2, 1, 21), (1, 2, 2, 31)]
    with pytest.raises(ValueError):
        matrices.candidate_columns(["src", "cx"])


def test_matrix_round_trip_and_refusals(spark, tmp_path):
    cells = spark.createDataFrame([(r, p, r / 10 + p / 100) for r in range(7) for p in range(3)], "row_id long, pos long, score double").repartition(3)
    matrices.write_score_matrix(cells, f"{tmp_path}/m")
    raw = b"".join(open(f"{tmp_path}/m/{n}", "rb").read() for n in sorted(os.listdir(f"{tmp_path}/m")) if n.startswith("part"))
    assert raw.startswith(b"0.000000,0.010000,0.020000\r\n") and raw.count(b"\r\n") == 7
    back = matrices.read_score_matrix(spark, f"{tmp_path}/m", 3)
    assert {(r.row_id, r.pos): r.score for r in back.collect()} == {(r.row_id, r.pos): pytest.approx(r.score) for r in cells.collect()}
    with pytest.raises(ValueError):
        matrices.read_score_matrix(spark, f"{tmp_path}/m", 4)
    (tmp_path / "bad.csv").write_text("1,2\nnan,3\n")
    with pytest.raises(ValueError):
        matrices.read_score_matrix(spark, str(tmp_path / "bad.csv"), 2)


def test_vectors_edges_and_archives(spark, tmp_path):
    (tmp_path / "v.csv").write_text("node,a,b\n0,1.5,2\n1,3,4\n")
    v = matrices.read_vectors(spark, str(tmp_path / "v.csv"), 2)
    assert {r.id: r.vec for r in v.collect()} == {0: [1.5, 2.0], 1: [3.0, 4.0]}
    with pytest.raises(ValueError):
        matrices.read_vectors(spark, str(tmp_path / "v.csv"), 3)
    assert matrices.read_virtual_edges(spark, None).count() == 0
    a, b = str(tmp_path / "a.zip"), str(tmp_path / "b.zip")
    for p in (a, b):
        matrices.write_archive(p, {"x.csv": b"1\r\n", "y.csv": b"2"})
    assert open(a, "rb").read() == open(b, "rb").read()
    assert matrices.read_archive_member(a, "x.csv") == b"1\r\n"


def one(spark, config):
    return spark.range(config["n"])


def test_a_stage_is_kept_until_something_that_made_it_changes(spark, tmp_path):
    stage = stages.Stage("one", f"{tmp_path}/one", one, (), {"n": 5}, lambda df: {"rows": df.count()})
    assert stages.outlook(stage, spark) == stages.Outlook("build")
    assert stages.complete(stage, spark).count() == 5
    assert stages.outlook(stage, spark).what == "keep" and stages.complete(stage, spark).count() == 5
    other = stages.Stage("one", stage.output, one, (), {"n": 6})
    assert stages.outlook(other, spark) == stages.Outlook("halt", ("config",))
    with pytest.raises(RuntimeError, match="one: config"):
        stages.complete(other, spark)
    spark.range(7).write.mode("overwrite").parquet(stage.output)
    assert stages.outlook(stage, spark).because == ("table",)
    slot = stages.set_aside(spark, f"{tmp_path}/aside", stage, "a test")
    assert slot.endswith("001") and sorted(os.listdir(slot)) == sorted(x for x in os.listdir(slot) if x.strip(".crc") and x) and os.path.isdir(f"{slot}/table")
    assert stages.outlook(stage, spark).what == "build"


def test_anything_half_done_halts(spark, tmp_path):
    """Of all that may lie about, only nothing, and a table with its note, go on."""
    import itertools

    for k, there in enumerate(itertools.product([False, True], repeat=3)):
        stage = stages.Stage("s", f"{tmp_path}/s{k}", one, (), {"n": 2})
        if there[2]:
            stages.Store(spark).write(stage.place("note"), "{}")
        for thing in [t for t, some in zip(stages.THINGS, there, strict=True) if some and t != "note"]:
            spark.range(1).write.parquet(stage.place(thing))
        found = stages.outlook(stage, spark)
        assert found.what == ("halt" if any(there) else "build")
        if there == (False, True, True):
            assert "cannot be read" in found.because[0]
        elif any(there):
            assert [x.endswith("there") for x in found.because] == list(there)


def test_a_changed_operator_halts_the_stage(spark, tmp_path, monkeypatch):
    """The builder stays as it is, but a module of the package that it reaches is another one."""
    stage = stages.ranking_stages(str(tmp_path), DATA)[0]
    stages.complete(stage, spark)
    assert stages.outlook(stage, spark).what == "keep"
    assert {"kairograph.operators.rules", "kairograph.sources.tables", "kairograph.functions.scores"} <= set(stages.modules_of(stage.build))
    real = stages.inspect.getsource
    monkeypatch.setattr(stages.inspect, "getsource", lambda x: real(x) + ("# new" if getattr(x, "__name__", "") == "kairograph.operators.rules" else ""))
    assert stages.outlook(stage, spark) == stages.Outlook("halt", ("module kairograph.operators.rules",))


def test_a_failed_check_leaves_nothing(spark, tmp_path):
    def refuse(df):
        raise ValueError("no")

    stage = stages.Stage("bad", f"{tmp_path}/bad", one, (), {"n": 5}, refuse)
    with pytest.raises(ValueError, match="no"):
        stages.complete(stage, spark)
    assert stages.outlook(stage, spark).what == "build"


def test_the_ranking_stages_run_once(spark, tmp_path):
    plan = stages.ranking_stages(str(tmp_path), DATA)
    found = stages.run(plan, spark)
    assert 0 < found["metric"].first().mrr <= 1 and 0 < found["chain_metric"].first().mrr <= 1
    assert [o.what for _, o in stages.preview(plan, spark)] == ["keep"] * len(plan)


def test_score_files_are_verified(spark, tmp_path):
    cells = spark.createDataFrame([(r, p, r / 7 + p) for r in range(9) for p in range(3)], "row_id long, pos long, score double").repartition(3)
    assert matrices.write_score_file(cells, f"{tmp_path}/f.csv") == {"rows": 9, "fields": 27}
    raw = open(f"{tmp_path}/f.csv", "rb").read()
    assert raw == b"".join(b",".join(b"%.6f" % (r / 7 + p) for p in range(3)) + b"\r\n" for r in range(9))
    for bad in (raw[:-2] + b"\n", raw.replace(b"1.000000", b"1.0", 1), raw + raw[:29], raw.replace(b"1.000000", b"nan", 1)):
        (tmp_path / "bad.csv").write_bytes(bad)
        with pytest.raises(ValueError, match="expected 9 lines"):
            matrices.verify_score_file(spark, f"{tmp_path}/bad.csv", 9, 3)
    with pytest.raises(ValueError):
        matrices.write_score_file(cells.where("row_id <> 1 OR pos <> 1"), f"{tmp_path}/g.csv")
    assert not [n for n in os.listdir(tmp_path) if n.startswith("g.csv")]


@pytest.mark.parametrize("kind", ["<f4", "<f8", "<i8"])
def test_arrays_are_read_by_ranges(spark, tmp_path, kind, monkeypatch):
    monkeypatch.setattr(matrices, "NPY_BLOCK", 100)
    values = np.arange(60).reshape(12, 5).astype(kind)
    np.save(tmp_path / "a.npy", values)
    np.savez(tmp_path / "a.npz", x=values, y=values[0])
    for found in (matrices.read_npy(spark, f"file://{tmp_path}/a.npy"), matrices.read_npz(spark, str(tmp_path / "a.npz"), "x")):
        assert {r.id: r.vec for r in found.collect()} == {i: row for i, row in enumerate(values.astype(float).tolist())}
    matrices.check_vectors(matrices.read_npy(spark, f"file://{tmp_path}/a.npy"), 12, 5)
    with pytest.raises(ValueError):
        matrices.check_vectors(spark.createDataFrame([(0, [1.0, float("nan")])], "id long, vec array<double>"), 1, 2)
    for wrong in (lambda: matrices.read_npz(spark, str(tmp_path / "a.npz"), "y"), lambda: matrices.read_npz(spark, str(tmp_path / "a.npz"), "z")):
        with pytest.raises(ValueError):
            wrong()


def test_archives_pass_members_through(tmp_path):
    base, out = str(tmp_path / "a.zip"), str(tmp_path / "b.zip")
    matrices.write_archive(base, {"x": b"1\r\n", "y": b"2"})
    matrices.repack(out, base, {"y": b"3"})
    assert (matrices.read_archive_member(out, "x"), matrices.read_archive_member(out, "y")) == (b"1\r\n", b"3")
    with pytest.raises(ValueError):
        matrices.repack(out, base, {"z": b""})


def test_geometry_is_orthogonal(spark):
    log = spark.createDataFrame([(s, d, 0.0) for s in range(30) for d in range(12) if (s * 7 + d * 5) % 4 == 0], "src long, dst long, time double")
    vecs = np.array([r.vec for r in models.svd_geometry(log, 4).orderBy("id").collect()])
    norms = np.linalg.norm(vecs, axis=1)
    assert vecs.shape == (12, 4) and np.all((np.abs(norms - 1) < 1e-6) | (norms < 1e-6))


def auc(good, bad):
    return np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])


@pytest.mark.parametrize("kind", ["bpr", "line"])
def test_embeddings_rank_unseen_edges_first_in_one_part_and_in_many(spark, kind):
    """Ids beyond 32 bits, on either side; a part of the edges is held back and ranked above pairs of other groups."""
    high = 1 << 40
    edges = [(s, high + d) for s in range(40) for d in range(40) if s % 4 == d % 4]
    held, known = [e for e in edges if (e[0] * 7 + e[1]) % 5 == 0], [e for e in edges if (e[0] * 7 + e[1]) % 5]
    log = spark.createDataFrame([(s, d, float(s % 3)) for s, d in known] + [(777, 778, 99.0)], "src long, dst long, time double")
    names = None
    for bounds in ({}, {"part_bytes": 4_000 if kind == "bpr" else 10_000}):
        given = embedding.settings(kind, dim=8)
        assert (embedding.parts_for(82, 2 * len(known), given, **bounds) > 1) == bool(bounds)
        found = {r.id: np.array(r.vec) for r in embedding.train_embedding(log, kind, dim=8, epochs=8, rate=0.05, batch=32, until=50.0, **bounds).collect()}
        assert names is None or set(found) == names
        names = set(found)
        assert names == {s for s, _ in known} | {d for _, d in known} | {777, 778}
        assert all(len(v) == (16 if kind == "line" else 8) and np.isfinite(v).all() for v in found.values())
        score = lambda s, d: found[s][:8] @ found[d][:8]
        assert auc([score(*e) for e in held], [score(s, high + d) for s in range(0, 40, 3) for d in range(40) if s % 4 != d % 4]) > 0.8


def test_negatives_are_drawn_until_they_are_no_edges():
    r = np.random.default_rng(3)
    u, v = np.array([0] * 8 + [1] * 3 + [2] * 10), np.array([*range(10, 18), 10, 11, 12, *range(10, 20)])
    part, degree = np.array([0] * 10 + [1] * 10), np.ones(20)
    q, ok = embedding.draw_negatives(u, v, part, degree, embedding.settings("line"), r)
    seen = set(zip(u.tolist(), v.tolist(), strict=True))
    assert q.shape == (21, 5) and (part[q] == 1).all()
    for i, s in enumerate(u.tolist()):
        assert all((s, int(x)) not in seen for x, good in zip(q[i], ok[i], strict=True) if good)
    assert ok[u < 2].all() and not ok[u == 2].any()  # id 2 is joined to the whole part


@pytest.mark.parametrize("kind", ["bpr", "line"])
def test_gradients_are_those_of_differences(kind):
    r = np.random.default_rng(0)
    given = embedding.settings(kind, dim=3, negatives=2)
    x = r.normal(size=(6, 3 * given.tables))
    u, v, q, ok = np.array([0, 1, 0]), np.array([3, 4, 4]), np.array([[5, 2], [5, 5], [2, 3]]), np.array([[True, True], [False, True], [True, True]])
    rows, grad, _ = embedding.gradients(x, u, v, q, ok, given)
    for i, j in ((0, 0), (2, 1), (4, 2), (5, x.shape[1] - 1)):
        step = np.zeros_like(x)
        step[i, j] = 1e-5
        want = (embedding.gradients(x + step, u, v, q, ok, given)[2] - embedding.gradients(x - step, u, v, q, ok, given)[2]) / 2e-5
        assert grad[list(rows).index(i), j] == pytest.approx(want, abs=1e-6)


def test_the_loss_falls():
    r = np.random.default_rng(1)
    ids, given = np.arange(30), embedding.settings("line", dim=4)
    u, v = r.integers(0, 15, 200), r.integers(15, 30, 200)
    state = np.concatenate([r.uniform(-0.3, 0.3, (30, 12)), np.zeros((30, 25))], axis=1)
    losses = [embedding.train_block(ids, np.zeros(30, int), np.ones(30), state, u, v, np.ones(200), 200, given, np.random.default_rng(k)) for k in range(12)]
    assert losses[-1] < 0.9 * losses[0]


def ranked_rows(spark):
    r = np.random.default_rng(0)
    rows = [(q, p, 100 * q + p, int(p == 0), float(r.normal() + 2 * (p == 0)), float(r.normal())) for q in range(60) for p in range(6)]
    return spark.createDataFrame(rows, "qid long, pos long, cand long, label int, x1 double, x2 double")


def test_bagged_arms_tell_a_good_feature_from_noise(spark):
    arms = {r.arm: r for r in chains.bagged_arms(ranked_rows(spark), {"noise": ["x2"], "signal": ["x1"]}, bags=2, rounds=2, rate=0.5, depth=2, least=5).collect()}
    assert arms["signal"].verdict == "better" and arms["signal"].wins == 2 and arms["signal"].mrr > arms["noise"].mrr and arms["noise"].verdict == "open"


def test_three_passes_leave_no_fold_its_own_model(spark):
    r = np.random.default_rng(2)
    rows = [(k, k % 8, float(k // 4), p, int(r.integers(0, 30)), float(r.normal()), int(p == 0)) for k in range(40) for p in range(5)]
    cells = spark.createDataFrame([(*x[:5], x[6]) for x in rows], "row_id long, src long, time double, pos long, cand long, label int")
    features = spark.createDataFrame([(x[0], x[3], x[4], x[6], x[5] + 2.0 * x[6]) for x in rows], "row_id long, pos long, cand long, label int, x double")
    log = spark.createDataFrame([(k % 8, k % 30, float(-k)) for k in range(60)], "src long, dst long, time double")
    out = chains.three_pass(cells, log, features, ["x"], rounds=1, passes=2, rate=0.5, depth=2, least=5).collect()
    assert len(out) == len(rows) and np.isfinite([x.score for x in out]).all()
    assert np.mean([x.score for x in out if x.label]) > np.mean([x.score for x in out if not x.label])


def test_evaluation_on_real_candidates(spark):
    """A perfect scorer is always right; one that knows nothing ranks last among its pool; the mean is that of the runs."""
    log = spark.createDataFrame([(s, 100 + k, float(k)) for s in range(6) for k in range(s + 2)], "src long, dst long, time double")
    pool = spark.createDataFrame([(s, 200 + k) for s in range(5) for k in range(7)], "src long, cand long")
    seen = []
    perfect = chains.real_candidate_eval(log, pool, lambda cells, known: seen.append(known.count()) or cells.withColumn("score", F.col("label").cast("double")), runs=2, negatives=4).collect()
    assert [(r.run, r.n_rows, r.mrr) for r in sorted(perfect, key=lambda r: r.run)] == [(-1, 5, 1.0), (0, 5, 1.0), (1, 5, 1.0)]
    assert seen == [log.count() - 6] * 2
    flat = chains.real_candidate_eval(log, pool, lambda cells, known: cells.withColumn("score", F.lit(0.0)), runs=1, negatives=4).collect()
    assert {r.mrr for r in flat} == {0.2}
    uniform = chains.real_candidate_eval(log, pool, lambda cells, known: cells.withColumn("score", F.lit(0.0)), runs=1, uniform=3).collect()
    assert {(r.n_rows, r.mrr) for r in uniform} == {(6, 0.25)}


def test_self_training_harvests_by_windows(spark):
    log = spark.createDataFrame([(1, 5, 0.0)], "src long, dst long, time double")
    cells = spark.createDataFrame([(0, 1, 10.0, 0, 7, 0.99), (1, 1, 20.0, 0, 8, 0.99)], "row_id long, src long, time double, pos long, cand long, score double")
    asked = []
    out = chains.self_training(log, lambda weights: asked.append(weights.count()) or cells, rounds=2, windows=[15.0, 25.0])
    assert {(r.src, r.dst): r.w for r in out.collect()} == {(1, 5): 1.0, (1, 7): 1.0, (1, 8): 1.0} and asked == [1, 2]


def test_the_ranker_learns(spark):
    r = np.random.default_rng(0)
    rows = [(q, p, int(p == 0), float(r.normal() + 2 * (p == 0)), float(r.normal())) for q in range(120) for p in range(6)]
    df = spark.createDataFrame(rows, "qid long, pos long, label int, x1 double, x2 double")
    out = models.lambdamart(df, ["x1", "x2"], rounds=4, rate=0.5, depth=3, least=10)(df)
    best = out.groupBy("qid").agg(F.max_by("label", "prediction").alias("hit")).agg(F.avg("hit")).first()[0]
    assert best > 0.6


def test_bootstrap_weights_are_poisson(spark):
    w = chains.bootstrap_weights(spark.range(4000).select(F.col("id").alias("qid")), 2)
    row = w.agg(F.avg("weight"), F.variance("weight"), F.count("weight")).first()
    assert row[2] == 8000 and abs(row[0] - 1) < 0.05 and abs(row[1] - 1) < 0.1


@pytest.fixture(scope="module")
def engine():
    c = duckdb.connect()
    for n in os.listdir(DATA):
        c.execute(f"CREATE VIEW {n.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{n}')")
    return c


@pytest.mark.parametrize("name", ["mrr", "graph_profile", "exclusivity_census", "reliability_bins", "recency_cdf", "cooc_cf", "source_slate_recurrence", "basket_feedback", "features_ds1", "cooc_cf_events", "run_exclusion", "dense_group_ids", "before_tail", "band_shared_candidates", "history_before_time", "score_matrix_scan"])
def test_queries_are_their_sql(spark, engine, name):
    got = registry.QUERIES[name](spark, DATA)
    want = engine.sql(registry.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda found: sorted([tuple(round(v, 5) if isinstance(v, float) else int(v) if isinstance(v, bool) else v for v in r) for r in found], key=repr)
    a, b = rows(got.select(*columns).collect()), rows(want.select(", ".join(columns)).fetchall())
    assert len(a) == len(b)
    assert all(x == pytest.approx(y, abs=2e-5) for x, y in zip(a, b, strict=True))


def test_the_entry_works_without_the_text_operators(spark, monkeypatch):
    import importlib
    import importlib.util

    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name == "corpus_pipeline" else real(name, *a))
    entry = importlib.reload(importlib.import_module("__spark_entry__"))
    assert set(entry.queries()) == set(registry.QUERIES) and set(entry.oracle_sql()) == set(registry.ORACLES)
    assert entry.entry(spark).count() == 1
    monkeypatch.undo()
    importlib.reload(entry)
