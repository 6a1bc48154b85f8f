"""The pipeline, stage by stage as the checks run it, against plain Python."""

import hashlib
import math

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from kairograph.llm import bpe, kneser, quality, queries

from .helpers import Kneser, contained, dedup_lines, docs, odd_rows, one_of_each, words


def test_run_is_that_of_plain_python(spark, tmp_path):
    rows = odd_rows() + [(400 + k, words(70, 900 + k), "en") for k in range(20)] + [(600, "## QQ " * 40, "en"), (601, words(40, 3000) + " " + words(200, 11), "fr")]
    items = [(1, words(40, 3000)), (2, None)]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    marks = [(i, 1, 0) for i, _, _ in rows if i is not None and i != 600]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    model = Kneser([t for i, t, _ in rows if i is not None and i != 600 and t is not None], 5, kneser.discounts)
    score = {t: model.perplexity(t) for _, t, _ in rows}
    assert score[rows[-2][1]] > 3 * score[rows[-1][1]]
    found = corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()
    kept = {(r.doc_id, r.text) for r in found}
    trusted = [(g, score[t]) for i, t, g in rows if i is not None and i != 600 and score[t] is not None]

    def bound(lang):
        """The rank-based quantile of the language's trusted perplexities, or of all, and the allowance above it."""
        own = sorted(p for g, p in trusted if g == lang and lang is not None) or sorted(p for _, p in trusted)
        return quality.MARGIN * own[math.ceil(quality.QUANTILE * len(own)) - 1]

    assert kept == {(i, t) for i, t, g in rows if score[t] is not None and score[t] <= bound(g) * (1 + 1e-6)}
    assert (600, rows[-2][1]) not in kept and len(kept) >= len(rows) - 8

    now = [r for r in rows if (r[0], r[1]) in kept]
    now = dedup_lines(now)
    now = [now[k] for k in one_of_each(now)]
    gone = {(i, t) for i, t, _, _, _ in contained(now, items)}
    now = [r for r in now if (r[0], r[1]) not in gone]
    assert 601 in {i for i, _ in gone}
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = sorted(((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t, _ in now for ids in [encoding.encode_ordinary(t)]), key=repr)

    out = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = out.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out, str(tmp_path)).write.parquet(f"{tmp_path}/stage{k}")
        out = spark.read.parquet(f"{tmp_path}/stage{k}")
        assert k == 4 or out.columns == columns
    assert sorted(map(tuple, out.collect()), key=repr) == want
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()), key=repr) == want


def test_every_operator_is_registered():
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{n}" for n in range(1, 11)}


def test_stages_of_nothing(spark, tmp_path):
    docs(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_near_dedup_goes_by_rows(spark):
    """Rows that only share an id, or have none, are no copies; of repeated rows one stays."""
    a, b, c, d = (words(60, 7000 + k) for k in range(4))
    rows = [(1, a, "en"), (5, a, "en"), (5, b, "en"), (None, a, None), (None, c, "en"), (9, d, "en"), (9, d, "en"), (None, None, "en"), (8, "", "fr"), (3, " ", None)]
    found = corpus_pipeline.near_dedup(spark, docs(spark, rows), "").collect()
    assert sorted(((r.doc_id, r.text, r.lang) for r in found), key=repr) == sorted([rows[k] for k in one_of_each(rows)], key=repr)
    assert sorted(((r.doc_id, r.text) for r in found), key=repr) == sorted([(1, a), (3, " "), (5, b), (9, d), (None, c)], key=repr)
    assert found[0].fp == "fp" and len(found[0]) == 15
