"""Toxicity by class-conditional Kneser-Ney models (operator 6).

Two models, toxic and ordinary, have their own counts of byte n-grams and share
those of at most ``SHARED`` bytes as back-off, so an expression that one class
never shows is still smoothed by what both show. Each byte gets the difference of
its two log-likelihoods. A document is described by length-normalised
differences: the mean over all its bytes, and the largest means over windows of
``WINDOWS`` bytes, which a few toxic words in a long document raise as much as
in a short one. A logistic regression of these numbers gives the score; it is
fitted on a bounded sample of the labelled training rows that the models were
not counted from (``SAMPLE`` ids; the bound is a parameter). The counts cover
all other labelled training rows.

Only rows with ``crc32(id as text) mod FOLDS <> 0`` are learnt from. Of the ids with
that remainder 1, the first ``SAMPLE`` by hash fit the regression, so that it meets
texts as unknown as those scored later; all other rows are counted.

Defined cases: null and empty texts score as the prior of the fitted rows allows
(all differences zero); where the sample has not both classes, the models' mean
difference and the labels' prior decide, and with labels of one class only every
text gets that class (without labels: the ordinary one); contradicting labels of
one id count as toxic; texts of any length are read whole; repeated rows give
repeated results; an empty table gives an empty one; null ids are never held out
and never learnt from; other columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kneser
from .session import small, table

ORDER, SHARED = 5, 2
FOLDS = 5
SAMPLE = 20_000
WINDOWS = (12, 48, 192)
#: Bytes that a text's mean difference stands for where no regression can be fitted.
EVIDENCE = 100.0
FEATURES = ["mean", *(f"top{w}" for w in WINDOWS)]


def describe(values: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Mean difference, and the largest window mean of each width (shorter texts: over the width all the same)."""
    sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    begin, end = offsets[:-1], offsets[1:]
    n = end - begin
    out = [np.where(n > 0, (sums[end] - sums[begin]) / np.maximum(n, 1), 0.0)]
    owner = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(values))
    for width in WINDOWS:
        start = np.maximum(place + 1 - width, begin[owner])
        mean = (sums[place + 1] - sums[start]) / width
        top = np.zeros(len(n))
        some = n > 0
        if some.any():
            top[some] = np.maximum.reduceat(mean, begin[some])
        out.append(top)
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, scales and weights (the intercept first) of a ridge logistic regression by Newton's method."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 0, scale, 1.0)
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        weight = p * (1 - p) + 1e-9
        step = np.linalg.solve((z * weight[:, None]).T @ z / len(z) + ridge * np.eye(len(w)), z.T @ (y - p) / len(z) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return mean, scale, w


def without_sample(labelled: dict[int, int]) -> np.ndarray:
    """Weights where no regression can be fitted, from the numbers of learnt labels by class.

    With both classes the models decide alone: the mean difference per byte, weighed as
    ``EVIDENCE`` bytes, on the labels' prior odds. With one class that class is certain;
    without labels, the ordinary one.
    """
    toxic, ordinary = labelled.get(1, 0), labelled.get(0, 0)
    if toxic and ordinary:
        return np.array([np.log(toxic / ordinary), EVIDENCE] + [0.0] * (len(FEATURES) - 1))
    return np.array([30.0 if toxic else -30.0] + [0.0] * len(FEATURES))


def _remainder(id_col: str):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(FOLDS))


def train_and_score(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, limit: int = kneser.BROADCAST_GRAMS) -> DataFrame:
    """``(id, held_out, score, predicted)``, one row per row of ``docs``."""
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("cls"))
    learn = marks.withColumn("fold", _remainder("__id")).where("fold <> 0")
    chosen = learn.where("fold = 1").orderBy(F.xxhash64("__id"), "__id").limit(sample).select("__id", F.lit(True).alias("fits"))
    learn = learn.join(F.broadcast(chosen), "__id", "left").select("__id", "cls", F.coalesce("fits", F.lit(False)).alias("fits"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = texts.join(small(learn), F.col("id") == F.col("__id")).select("id", "text", "cls", "fits")
    model = kneser.fit(known.where("NOT fits").select("text", "cls"), ORDER, 2, SHARED)
    scorer = kneser.Scorer(texts, model, lambda v: v.select("g", (F.col("v1") - F.col("v0")).cast("float").alias("v")), limit=limit)
    fitting = scorer.score(known.where("fits").select("id", "text", "cls"), describe, FEATURES, text=False).select("id", "cls", *FEATURES)
    rows = fitting.orderBy(F.xxhash64("id"), "id").toPandas()
    y = rows["cls"].to_numpy(np.float64)
    mean, scale = np.zeros(len(FEATURES)), np.ones(len(FEATURES))
    if len(set(y)) == 2:
        mean, scale, w = fit_logistic(rows[FEATURES].to_numpy(np.float64), y)
    else:
        w = without_sample({r.cls: r.n for r in learn.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).collect()})  # two rows
    scored = scorer.score(texts, describe, FEATURES, text=False)
    z = F.lit(float(w[0]))
    for name, m, s, v in zip(FEATURES, mean, scale, w[1:], strict=True):
        z = z + (F.col(name) - float(m)) / float(s) * float(v)
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))
    out = scored.select(F.col("id").alias(id_col), F.coalesce(_remainder("id") == 0, F.lit(False)).alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return train_and_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
