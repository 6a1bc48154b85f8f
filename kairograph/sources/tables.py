"""Adapters from the star-schema tables to the data model: logs, slates, scores and vectors.

A log is ``(src, dst, time)`` with ``time`` in days; a slate table is long,
``(row_id, src, time, pos, cand, label)``; a score table adds ``score``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Candidates of a generated slate: twenty, and one that no log knows.
WIDTH = 21
QUANTILE = 0.75


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _day(column: str):
    return F.floor(F.unix_micros(F.col(column).cast("timestamp")) / 86_400_000_000).cast("double")


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and the key of their event's properties: many pairs recur."""
    events = table(spark, sf_dir, "events")
    return events.select(F.col("user_id").alias("src"), F.get_json_object("props", "$.k").cast("long").alias("dst"), _day("ts").alias("time"))


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and the parts that they ordered: baskets of one time."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("dst"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("src"), _day("o_orderdate").alias("time"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("src", "dst", "time")


def cut_time(log: DataFrame) -> DataFrame:
    """One row: the exact quantile of time that separates training from test."""
    return log.agg(F.percentile("time", F.lit(QUANTILE)).alias("cut"))


def train_part(log: DataFrame) -> DataFrame:
    return log.join(F.broadcast(cut_time(log))).where("time <= cut").drop("cut")


def test_part(log: DataFrame) -> DataFrame:
    return log.join(F.broadcast(cut_time(log))).where("time > cut").drop("cut")


#: Row ids of one block of slates.
ROWS = 4096
#: Destinations of one block in which a time's rows are numbered.
BLOCK = 1024


def numbered(rows: DataFrame) -> DataFrame:
    """Distinct rows numbered by (time, dst, src): ``row_id`` over all, ``rn`` within the time.

    Rows are numbered within a time and ``BLOCK`` destinations, and each block starts
    after the rows of all earlier ones. Only the blocks' sizes, not their rows, are
    summed in order, so a busy time is no task of its own.
    """
    distinct = rows.select("src", "dst", "time").distinct().withColumn("block", F.floor(F.col("dst") / BLOCK))
    sizes = distinct.groupBy("time", "block").count()
    ordered = Window.orderBy("time", "block")
    placed = sizes.withColumn("before", F.sum("count").over(ordered) - F.col("count"))
    before = placed.select("time", "block", "before", F.min("before").over(Window.partitionBy("time")).alias("start"))
    within = distinct.withColumn("n", F.row_number().over(Window.partitionBy("time", "block").orderBy("dst", "src")).cast("long") - 1)
    found = within.join(before, ["time", "block"]).withColumn("row_id", F.col("before") + F.col("n"))
    return found.select("time", "src", "dst", (F.col("row_id") - F.col("start")).alias("rn"), "row_id")


def slates(log: DataFrame, by: str | None = None, rows: DataFrame | None = None) -> DataFrame:
    """Generated slates for the interactions after the cut; see the survey for their shape.

    With ``by`` the rows, and so their cells, are dealt by that column (``block``: ``ROWS`` row ids; else one of ``rows``), and sorted: plans that group by it need no
    shuffle of cells. Parts are four times as many, as a row becomes ``WIDTH`` cells. ``rows`` are the numbered
    interactions after the cut, where they are at hand.
    """
    top = log.agg((F.max("dst") + 1).alias("n_dst"))
    rows = (numbered(test_part(log)) if rows is None else rows).join(F.broadcast(top))
    if by == "block":
        rows = rows.withColumn("block", F.floor(F.col("row_id") / ROWS))
    if by:
        rows = rows.repartition(4 * int(log.sparkSession.conf.get("spark.sql.shuffle.partitions")), by).sortWithinPartitions(by, "row_id")
    j, row, src = F.col("pos"), F.col("row_id"), F.col("src")
    day = F.col("time").cast("long")
    cand = (
        F.when(j == row % 20, F.col("dst"))
        .when(j == WIDTH - 1, F.col("n_dst") + src % 50)
        .when(j == (row + 1) % 20, F.pmod(day * 7 + F.expr("rn div 3") * 5, F.col("n_dst")))
        .otherwise((src * 37 + j * j * 13 + (row % 4) * 11 * j) % F.col("n_dst"))
    )
    long = rows.withColumn("pos", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(WIDTH - 1).cast("long"))))
    return long.select("row_id", "src", "time", "pos", cand.alias("cand"), (j == row % 20).cast("int").alias("label"))


def scored(cells: DataFrame) -> DataFrame:
    """Slates with a score in [0, 1] that depends on the cell only."""
    return cells.withColumn("score", ((F.col("cand") * 7919 + F.col("row_id") * 1047 + F.col("pos") * 37) % 1009) / 1008.0)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, vec array<double>)`` of the embeddings table."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
