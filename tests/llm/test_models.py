"""Kneser-Ney models against plain Python, and what the two classifiers make of them."""

import math

import pytest

from kairograph.llm import kneser, quality, toxicity

from .helpers import LONG, Kneser, docs, odd_rows, words


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("limit", [kneser.BROADCAST_GRAMS, 0])
def test_perplexity_is_that_of_plain_counts(spark, limit):
    rows = odd_rows()
    marks = [(k, 1, 0) for k in range(12)] + [(3, 1, 0), (4, 0, 0), (None, 1, 0), (102, 1, None)]
    found = quality.classify(docs(spark, rows), labels(spark, marks), limit=limit).collect()
    trusted = [t for i, t, _ in rows if i is not None and (i < 12 and i != 4 or i == 102)]
    model = Kneser(trusted, quality.ORDER, kneser.discounts)
    assert len(found) == len(rows)
    for r in found:
        want = model.perplexity(r.text)
        assert (r.perplexity is None) == (want is None)
        if want is not None:
            assert r.perplexity == pytest.approx(want, rel=1e-4)
        else:
            assert not r.kept
    assert found[0].g == "g" and found[0].bound == "bound"


def test_kept_by_the_quantile_of_each_language(spark):
    rows = odd_rows() + [(300 + k, words(20 + k, 900 + k), ["en", "fr", "de", None][k % 4]) for k in range(60)]
    rows += [(400 + k, "#%& " * (3 + k) + words(k, k), ["en", "xx", None][k % 3]) for k in range(40)]
    marks = labels(spark, [(k, 1, 0) for k in (*range(24), *range(300, 360))])
    trusted = [(t, g) for i, t, g in rows if i is not None and (i < 24 or 300 <= i < 360)]
    model = Kneser([t for t, _ in trusted], quality.ORDER, kneser.discounts)

    def bound(ps):
        return sorted(ps)[math.ceil(0.99 * len(ps)) - 1] * 1.1 if ps else None

    every = bound([model.perplexity(t) for t, _ in trusted])
    own = {g: bound([model.perplexity(t) for t, x in trusted if x == g]) for g in ("en", "fr", "de")}
    found = quality.classify(docs(spark, rows), marks).collect()
    near = 0
    for r in found:
        p, limit = model.perplexity(r.text), own.get(r.lang, every)
        if p is not None and abs(p / limit - 1) < 1e-3:
            near += 1
        else:
            assert r.kept == (p is not None and p <= limit)
    assert len(found) == len(rows) and near < 3 and 20 < sum(r.kept for r in found) < len(rows) - 10


def test_bounds_do_not_depend_on_the_order_of_rows(spark):
    import numpy as np

    values = np.random.default_rng(7).normal(1.6, 0.1, 30_000).round(12)
    langs = [["en", "fr", None][k % 3] for k in range(len(values))]
    rows = list(zip(langs, values.tolist(), strict=True)) + [("en", float("nan")), ("none", float("nan"))]
    table = spark.createDataFrame(rows, "lang string, surprise double")
    got = [{(r.every, r.lang): r.bound for r in quality.bounds(t).collect()} for t in (table.repartition(2), table.orderBy("surprise").repartition(23))]
    assert got[0] == got[1] and set(got[0]) == {(True, None), (False, "en"), (False, "fr")}
    for every, lang in got[0]:
        own = sorted(v for g, v in zip(langs, values, strict=True) if every or g == lang)
        exact = own[math.ceil(0.99 * len(own)) - 1]
        assert exact <= math.log(got[0][every, lang]) + 1e-9 <= exact + quality.STEP + 2e-9


def test_discounts():
    assert kneser.discounts({1: 4, 2: 2, 3: 1, 4: 1}) == pytest.approx((0.5, 1.25, 1.0))
    assert kneser.discounts({1: 4}) == kneser.PLAIN


def test_quality_without_labels_or_rows(spark):
    none = labels(spark, [])
    kept = {r.doc_id: r.kept for r in quality.classify(docs(spark, odd_rows()), none).collect()}
    assert kept[1] and kept[103] and not kept[100] and not kept[101]
    assert quality.classify(docs(spark, []), none).count() == 0


def test_quality_rejects_what_is_unlike(spark):
    rows = [(k, words(80, k), "en") for k in range(40)] + [(900, "ZZ## QQ!! " * 30, "en"), (901, "ZZ## QQ!! " * 30, None)]
    found = {r.doc_id: r.kept for r in quality.classify(docs(spark, rows), labels(spark, [(k, 1, 0) for k in range(40)])).collect()}
    assert not found[900] and not found[901] and sum(found[k] for k in range(40)) >= 39


def test_lookup_finds_every_key():
    import numpy as np

    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 40, 50_000))
    table = kneser.Lookup(keys, np.arange(len(keys), dtype=np.float32))
    assert (table(keys[::-1]) == np.arange(len(keys))[::-1]).all()
    with pytest.raises(KeyError):
        kneser.Lookup(keys[:3], np.zeros(3, np.float32))(np.array([-5]))


@pytest.mark.parametrize("limit", [kneser.BROADCAST_GRAMS, 0])
def test_toxicity_on_held_out_rows(spark, limit):
    rows = [(k, words(30, k) + (" you vile zork " if k % 4 == 0 else " ") + words(30, k + 999), "en") for k in range(240)]
    rows += [(1000, None, None), (1001, "", "en"), (None, "zork", "en"), (8, rows[8][1], "en")]
    marks = labels(spark, [(k, 1, int(k % 4 == 0)) for k in range(240)] + [(5, 1, None)])
    found = toxicity.train_and_score(docs(spark, rows), marks, limit=limit).collect()
    import zlib

    assert len(found) == len(rows)
    held = [r for r in found if r.held_out]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    right = [r.predicted == int(r.doc_id % 4 == 0) for r in held if r.doc_id < 240]
    assert sum(right) >= 0.95 * len(right)


def test_toxicity_without_labels_or_rows(spark):
    none = labels(spark, [])
    assert all(r.predicted == 0 for r in toxicity.train_and_score(docs(spark, odd_rows()), none).collect())
    assert toxicity.train_and_score(docs(spark, []), none).count() == 0


def test_toxicity_of_one_class_or_a_sample_of_one(spark):
    rows = [(k, words(20, k) + (" vile zork " * 3 if k % 2 else " "), "en") for k in range(60)] + [(900, None, None), (901, LONG, "fr")]
    toxic = toxicity.train_and_score(docs(spark, rows), labels(spark, [(k, 1, 1) for k in range(60)])).collect()
    assert all(r.predicted == 1 and 0.5 < r.score <= 1 for r in toxic) and len(toxic) == len(rows)
    ordinary = toxicity.train_and_score(docs(spark, rows), labels(spark, [(k, 1, 0) for k in range(60)])).collect()
    assert all(r.predicted == 0 for r in ordinary)
    # No id is left for the regression: the two models decide by themselves.
    found = toxicity.train_and_score(docs(spark, rows), labels(spark, [(k, 1, k % 2) for k in range(60)]), sample=0).collect()
    right = [r.predicted == r.doc_id % 2 for r in found if r.doc_id < 60]
    assert sum(right) >= 0.9 * len(right)


def test_class_models_are_those_of_plain_counts(spark):
    """Every byte's two likelihoods against dictionaries: own counts above two bytes, shared ones below."""
    from pyspark.sql import functions as F

    texts = [(words(30, k) + (" vile zork" if k % 3 == 0 else ""), int(k % 3 == 0)) for k in range(30)]
    table = spark.createDataFrame(texts, "text string, cls int")
    model = kneser.fit(table, toxicity.ORDER, 2, toxicity.SHARED)
    fresh = words(25, 999) + " zork Q"
    scored = [t for t, _ in texts[:3]] + [fresh]
    wanted = kneser.distinct_grams(spark.createDataFrame([(t,) for t in scored], "text string"), toxicity.ORDER)
    got = {r.g: (r.v0, r.v1) for r in kneser.values(model, wanted).select("g", *[F.col(f"v{c}") for c in (0, 1)]).collect()}
    plain = [Kneser([t for t, _ in texts], toxicity.ORDER, kneser.discounts, [t for t, c in texts if c == k], toxicity.SHARED) for k in (0, 1)]
    grams = {g for t in scored for g in plain[0].grams(t)}
    assert len(got) == len(grams)
    for g in grams:
        assert got[int.from_bytes(g, "big")] == pytest.approx(tuple(math.log(m.p(g)) for m in plain), rel=1e-4, abs=1e-4)


def test_toxicity_of_very_long_and_odd_rows(spark):
    rows = odd_rows() + [(500, "vile zork " * 20_000, "en")]
    marks = labels(spark, [(k, 1, int(k % 2)) for k in range(24)] + [(500, 1, 1)])
    found = toxicity.train_and_score(docs(spark, rows), marks).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    assert len({r.score for r in found if r.doc_id in (100, 101)}) == 1


def test_toxicity_counts_all_that_the_bounded_sample_leaves(spark, monkeypatch):
    import zlib

    counted, fit = [], kneser.fit
    monkeypatch.setattr(kneser, "fit", lambda rows, *a: counted.extend(r.text for r in rows.collect()) or fit(rows, *a))
    fold = {k: zlib.crc32(str(k).encode()) % 5 for k in range(400)}
    says = {k: " vile zork " if fold[k] < 2 else " grim blag " for k in fold}
    rows = [(k, words(20, k) + (says[k] if k % 2 else " ") + words(20, k + 999), "en") for k in fold]
    found = toxicity.train_and_score(docs(spark, rows), labels(spark, [(k, 1, k % 2) for k in fold]), sample=20).collect()
    learnt = [t for k, t, _ in rows if fold[k]]
    assert len(counted) == len(learnt) - 20 and set(counted) <= set(learnt)
    held = [r.predicted == r.doc_id % 2 for r in found if r.held_out]
    assert sum(held) >= 0.95 * len(held)
