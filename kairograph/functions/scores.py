"""Score functions over the cells of a row: windows on ``row_id``, so cells of a row stay together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TINY = 1e-12


def row() -> Window:
    return Window.partitionBy("row_id")


def rownorm(value: Column) -> Column:
    """``v / max(v)`` where the row's maximum is positive, else ``v``."""
    top = F.max(value).over(row())
    return F.when(top > TINY, value / F.when(top > TINY, top)).otherwise(value)


def row_minmax(value: Column) -> Column:
    """Min-max to [0, 1]; a constant row becomes 0.5."""
    low, high = F.min(value).over(row()), F.max(value).over(row())
    return F.when(high - low > TINY, (value - low) / F.when(high - low > TINY, high - low)).otherwise(F.lit(0.5))


def row_max_normalise(value: Column) -> Column:
    """Divide by the row's maximum; rows without a positive one are shifted by their minimum first."""
    low, high = F.min(value).over(row()), F.max(value).over(row())
    span = high - low
    shifted = F.when(span > TINY, (value - low) / F.when(span > TINY, span)).otherwise(F.lit(0.5))
    return F.when(high > TINY, value / F.when(high > TINY, high)).otherwise(shifted)


def promoted_value(value: Column) -> Column:
    """A value above the whole row: ``max + max(range, 1) + 1``."""
    low, high = F.min(value).over(row()), F.max(value).over(row())
    return high + F.greatest(high - low, F.lit(1.0)) + 1.0


def row_softmax(value: Column, temperature: float = 1.0) -> Column:
    e = F.exp((value - F.max(value).over(row())) / temperature)
    return e / F.sum(e).over(row())


def promote_in_unit(value: Column, chosen: Column) -> Column:
    """Puts the chosen cell on top within [0, 1]: just above the maximum, or by rescaling the row."""
    high = F.max(value).over(row())
    any_ = F.max(chosen.cast("int")).over(row()) == 1
    room = high + 1e-4 <= 1.0
    rescaled = value * (0.9998 / F.when(high > 0, high))
    return F.when(~any_, value).when(room, F.when(chosen, high + 1e-4).otherwise(value)).otherwise(F.when(chosen, F.lit(0.9999)).otherwise(rescaled))


def demoted(value: Column, level: Column) -> Column:
    """The demotion map: kept cells to [0.01, 0.9999], demoted ones to a thousandth per level."""
    return F.when(level.isNull(), 0.01 + 0.9899 * value).otherwise(0.001 * level)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def l2_normalise(vec: Column, floor: float = 1e-8) -> Column:
    norm = F.greatest(F.sqrt(dot(vec, vec)), F.lit(floor))
    return F.transform(vec, lambda v: v / norm)


def stable_rank(df: DataFrame, score: str = "score") -> DataFrame:
    """``rank``: score descending, position ascending."""
    return df.withColumn("rank", F.row_number().over(row().orderBy(F.desc(score), F.asc("pos"))).cast("long"))
