"""Reports on score matrices, and the gates that refuse bad ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import row, stable_rank


def matrix_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: what changed from ``a`` to ``b``, by cell, row, order and top cell.

    Strict inversions and collapsed pairs are counted within rows, whose width
    is that of a slate.
    """
    old, new = stable_rank(a).select("row_id", "pos", F.col("score").alias("x"), F.col("rank").alias("rx")), stable_rank(b).select("row_id", "pos", F.col("score").alias("y"), F.col("rank").alias("ry"))
    cells = old.join(new, ["row_id", "pos"])
    lists = cells.groupBy("row_id").agg(F.count_if(F.col("x") != F.col("y")).alias("changed"), F.count_if((F.col("rx") == 1) & (F.col("ry") != 1)).alias("top"), F.count_if(F.col("rx") != F.col("ry")).alias("moved"), F.collect_list(F.struct("x", "y")).alias("v"))

    def pairs(test):
        each = F.transform("v", lambda p: F.size(F.filter("v", lambda q: test(p, q))))
        return F.aggregate(each, F.lit(0), lambda s, n: s + n)

    inverted = pairs(lambda p, q: (p["x"] > q["x"]) & (p["y"] < q["y"]))
    collapsed = pairs(lambda p, q: (p["x"] > q["x"]) & (p["y"] == q["y"]))
    per_row = lists.select("changed", "top", "moved", inverted.alias("inverted"), collapsed.alias("collapsed"))
    return per_row.agg(F.count_if(F.col("changed") > 0).alias("changed_rows"), F.sum("changed").alias("changed_cells"), F.sum("top").alias("top1_changes"), F.count_if(F.col("moved") > 0).alias("order_changed_rows"), F.sum("inverted").cast("long").alias("strict_inversions"), F.sum("collapsed").cast("long").alias("collapsed_pairs"))


def matrix_profile(cells: DataFrame) -> DataFrame:
    """One row: size, range, values that are not finite, degenerate rows, rows that peak at 1, tied tops."""
    v = F.col("score")
    odd = F.isnan(v) | v.isNull() | (F.abs(v) == float("inf"))
    rows = cells.withColumn("top", F.max("score").over(row())).groupBy("row_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(odd).alias("odd"), F.min("score").alias("lo"), F.max("score").alias("hi"), F.count_if(v == F.col("top")).alias("tops"))
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n").alias("n_cells"), F.sum("odd").alias("not_finite"), F.min("lo").alias("lowest"), F.max("hi").alias("highest"), F.count_if(F.col("lo") == F.col("hi")).alias("degenerate_rows"), F.count_if(F.col("hi") == 1.0).alias("rows_at_one"), F.count_if(F.col("tops") > 1).alias("tied_top_rows"))


def validate_matrix(cells: DataFrame, n_rows: int, width: int) -> None:
    """Raises unless the table has ``n_rows`` rows of ``width`` finite cells in [0, 1]. Never repairs."""
    found = matrix_profile(cells).first()
    ragged = cells.groupBy("row_id").count().where(F.col("count") != width).limit(1).count()
    if found["n_rows"] != n_rows or ragged:
        raise ValueError(f"expected {n_rows} rows of {width} cells, found {found['n_rows']} rows{' of differing widths' if ragged else ''}")
    if n_rows and found["not_finite"]:
        raise ValueError(f"{found['not_finite']} cells are not finite")
    if n_rows and not 0 <= found["lowest"] <= found["highest"] <= 1:
        raise ValueError(f"cells range from {found['lowest']} to {found['highest']}")


def geometry(slates: DataFrame, log: DataFrame) -> DataFrame:
    """One row: slate rows and width, and the size of the id space of the whole log."""
    shape = slates.groupBy("row_id").count().agg(F.count(F.lit(1)).alias("n_rows"), F.max("count").alias("width"))
    ids = log.agg((F.greatest(F.max("src"), F.max("dst")) + 1).alias("num_entity"))
    return shape.join(F.broadcast(ids))


def epochs_from_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """The largest N of ``epoch N/M`` in lines of text."""
    found = lines.select(F.explode(F.regexp_extract_all(column, F.lit(r"epoch (\d+)/\d+"), 1)).alias("n"))
    return found.agg(F.max(F.col("n").cast("long")).alias("epochs"))


def content_digest(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``(key, digest)``: SHA-256 of a row's columns, joined by commas."""
    return df.select(key, F.sha2(F.concat_ws(",", *[F.col(c).cast("string") for c in columns]), 256).alias("digest"))


def token_swap(lines: DataFrame, swaps: DataFrame) -> DataFrame:
    """``(row_id, line)`` with two comma-separated tokens of some rows exchanged, as text; line ends are kept.

    ``swaps`` is ``(row_id, c1, c2)`` with columns counted from 0.
    """
    joined = lines.join(swaps, "row_id", "left")
    body, end = F.regexp_extract("line", r"^([^\r\n]*)([\r\n]*)$", 1), F.regexp_extract("line", r"^([^\r\n]*)([\r\n]*)$", 2)
    tokens = F.split(body, ",", -1)
    swapped = F.transform(tokens, lambda t, i: F.when(i == F.col("c1"), F.get(tokens, F.col("c2"))).when(i == F.col("c2"), F.get(tokens, F.col("c1"))).otherwise(t))
    return joined.select("row_id", F.when(F.col("c1").isNull(), F.col("line")).otherwise(F.concat(F.array_join(swapped, ","), end)).alias("line"))
