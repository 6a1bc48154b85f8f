"""Quality classifier by n-gram perplexity (operator 1).

An interpolated modified Kneser-Ney model over byte n-grams is trained on all
trusted text (every document whose labels all say quality 1). Sharded count joins
give the value of every n-gram of the scored documents; a document's perplexity
is exp of its mean negative log probability per byte. A document is kept if its
perplexity is at most ``MARGIN`` times a quantile of the trusted documents'
perplexities in its own language. The quantile is the nearest rank over all of them,
counted in steps of ``STEP`` nats a byte, so neither the order of rows nor the number
of partitions moves it.

Defined cases: null and empty texts have no perplexity and are rejected; a null
language, or one with no trusted document, takes the quantile of all trusted
documents; without any trusted document every text is kept; documents with
contradicting labels are not trusted; texts of any length are read whole; repeated
rows give repeated results; an empty table gives an empty one; other columns pass
through, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kneser
from .session import small, stored, table

ORDER = 5
#: The quantile of trusted perplexities per language, and the allowance above it.
QUANTILE, MARGIN = 0.99, 1.1
#: Nats a byte that are counted together, rounded up: a hundredth of a percent of a perplexity. A byte's surprise is
#: some 20 nats at most, so a language has about 200,000 steps at any size.
STEP = 1e-4


def _mean_surprise(values: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    n = np.diff(offsets)
    with np.errstate(invalid="ignore", divide="ignore"):
        return [np.where(n > 0, -(sums[offsets[1:]] - sums[offsets[:-1]]) / n, np.nan)]


def trusted_ids(labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """Ids whose labels are all 1."""
    agreed = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__trusted")).agg(F.min(label_col).alias("a"), F.max(label_col).alias("b"))
    return small(agreed.where("a = 1 AND b = 1").select("__trusted"))


def bounds(sample: DataFrame) -> DataFrame:
    """``(every, lang, bound)`` of ``sample(lang, surprise)``: the quantile's perplexity of each language, and of all rows."""
    step = F.ceil(F.col("surprise") / STEP).alias("step")
    counts = stored(sample.where(~F.isnan("surprise")).groupBy("lang", step).agg(F.count(F.lit(1)).alias("n")), "quality-steps")
    every = counts.groupBy("step").agg(F.sum("n").alias("n")).select(F.lit(True).alias("every"), F.lit(None).cast(counts.schema["lang"].dataType).alias("lang"), "step", "n")
    levels = counts.where("lang IS NOT NULL").select(F.lit(False).alias("every"), "lang", "step", "n").union(every)
    rows = Window.partitionBy("every", "lang")
    ranked = levels.select("every", "lang", "step", F.sum("n").over(rows.orderBy("step")).alias("upto"), F.sum("n").over(rows).alias("total"))
    reached = ranked.where(F.col("upto") >= F.ceil(F.col("total") * QUANTILE))
    return reached.groupBy("every", "lang").agg(F.exp(F.min("step") * STEP).alias("bound"))


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", kept_col: str = "kept", perplexity_col: str = "perplexity", text: bool = True, limit: int = kneser.BROADCAST_GRAMS) -> DataFrame:
    """``docs``, without the text if that is not wanted, with ``perplexity`` and ``kept``; columns of those names are replaced."""
    trusted = docs.join(trusted_ids(labels, id_col=id_col), F.col(f"`{id_col}`") == F.col("__trusted"), "left_semi")
    model = kneser.fit(trusted.select(F.col(text_col).alias("text"), F.lit(0).alias("cls")), ORDER)
    scorer = kneser.Scorer(docs, model, lambda v: v.select("g", F.col("v0").alias("v")), text_col=text_col, limit=limit)
    perplexity = F.when(~F.isnan("__surprise"), F.exp("__surprise"))
    sample = scorer.score(trusted.select(id_col, text_col, lang_col), _mean_surprise, ["__surprise"], text=False)
    # One row per language and one for all; languages number few, but the join is left to the optimizer all the same.
    found = stored(bounds(sample.select(F.col(lang_col).alias("lang"), F.col("__surprise").alias("surprise"))), "quality-bounds")
    overall = found.where("every").agg(F.max("bound")).first()[0]
    own = found.where("NOT every").select(F.col("lang").alias("__lang"), F.col("bound").alias("__bound"))
    scored = scorer.score(docs, _mean_surprise, ["__surprise"], text=text).join(own, F.col(lang_col) == F.col("__lang"), "left")
    bound = F.coalesce("__bound", F.lit(overall).cast("double")) * MARGIN
    kept = F.when(perplexity.isNull(), False).otherwise(F.coalesce(perplexity <= bound, F.lit(True)))
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (kept_col, perplexity_col) and (text or c != text_col)]
    return scored.select(*others, perplexity.alias(perplexity_col), kept.alias(kept_col))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return classify(docs, table(spark, sf_dir, "labels"), text=False).select("doc_id", "lang", "perplexity", "kept")
