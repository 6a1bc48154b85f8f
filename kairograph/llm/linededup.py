"""Line deduplication by overlapping three-line windows (operator 10).

Every window of three consecutive lines is hashed (128 bits). A window that
occurs more than once in the whole table keeps its first occurrence, in the
order of (document id, text hash, line); every later occurrence covers its three
lines, and the union of the covered lines is removed. Only windows' hashes and
positions are shuffled for the search. Counting a window is pre-aggregated on
the map side; the join that marks later occurrences has one row per window on
one side, so the adaptive skew join can split a hot window's rows; it is not
salted.

Defined cases: a null text stays null and has no line; an empty text is one
empty line; a text of fewer than three lines has no window and stays as it is;
windows of three blank lines are ignored; rows equal in id and text are one
document and come out alike; null ids sort first; a text whose lines are all
covered becomes empty; texts of any length are read whole; an empty table gives an
empty one. Other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import table

SIZE = 3


def _windows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    lines = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th"), F.split(F.col(text_col), "\n", -1).alias("lines"))
    each = F.transform(
        F.sequence(F.lit(0), F.size("lines") - SIZE),
        lambda i: F.struct(
            i.alias("line"),
            F.concat_ws("\n", *[F.get("lines", i + k) for k in range(SIZE)]).alias("w"),
        ),
    )
    return (
        lines.where(F.size("lines") >= SIZE)
        .select("id", "th", F.explode(each).alias("e"))
        .where(F.trim(F.translate("e.w", "\n", " ")) != "")
        .select("id", "th", F.col("e.line").alias("line"), F.xxhash64("e.w").alias("h1"), F.xxhash64(F.lit("line window"), "e.w").alias("h2"))
    )


def covered_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, th, covered array<int>)``: the lines to remove from each document that has any."""
    windows = _windows(docs, id_col, text_col)
    here = F.struct("id", "th", "line")
    repeated = windows.groupBy("h1", "h2").agg(F.min(here).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = windows.join(repeated, ["h1", "h2"]).where(~here.eqNullSafe(F.col("first")))
    starts = later.groupBy("id", "th").agg(F.collect_set("line").alias("starts"))
    return starts.select("id", "th", F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + (SIZE - 1))))).alias("covered"))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", counts: bool = True) -> DataFrame:
    """``docs`` with the covered lines removed, and ``n_lines`` and ``n_removed`` if ``counts``."""
    found = covered_lines(docs, id_col=id_col, text_col=text_col).select(F.struct(F.col("id").alias("i"), F.col("th").alias("t")).alias("__covered_key"), F.col("covered").alias("__covered"))
    key = F.struct(F.col(id_col).alias("i"), F.xxhash64(F.col(text_col)).alias("t"))
    joined = docs.join(found, key.eqNullSafe(F.col("__covered_key")), "left")
    lines = F.split(F.col(text_col), "\n", -1)
    n = F.coalesce(F.size(lines), F.lit(0))
    n_lines = F.when(F.col(text_col).isNull(), 0).otherwise(n).cast("long")
    removed = F.when(F.col("__covered").isNull(), 0).otherwise(F.size("__covered")).cast("long")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__covered"))
    text = F.when(F.col("__covered").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    columns = [text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*columns, *([n_lines.alias("n_lines"), removed.alias("n_removed")] if counts else []))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


OP10_SQL = """
WITH lines AS (
  SELECT doc_id, line_no, line FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents WHERE text IS NOT NULL)
), windows AS (
  SELECT doc_id, line_no, line || chr(10) || lead(line, 1) OVER d || chr(10) || lead(line, 2) OVER d AS w
  FROM lines WINDOW d AS (PARTITION BY doc_id ORDER BY line_no)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id, line_no) AS nth FROM windows WHERE w IS NOT NULL AND trim(replace(w, chr(10), ' ')) <> ''
), covered AS (
  SELECT DISTINCT doc_id, line_no + k AS line_no FROM ranked, (VALUES (0), (1), (2)) AS v(k) WHERE nth > 1
), kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(c.line_no) AS n_removed,
    coalesce(string_agg(l.line, chr(10) ORDER BY l.line_no) FILTER (WHERE c.line_no IS NULL), '') AS text
  FROM lines l LEFT JOIN covered c ON c.doc_id = l.doc_id AND c.line_no = l.line_no GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed, sha256(k.text) AS text_sha256
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
