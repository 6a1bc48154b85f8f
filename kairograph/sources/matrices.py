"""Readers and writers of logs, slates, score matrices, vectors and archives in text form."""

from __future__ import annotations

import io
import re
import zipfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LOG_SCHEMA = "src long, dst long, time double"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A log from CSV with a header."""
    return spark.read.schema(LOG_SCHEMA).csv(path, header=True)


def candidate_columns(columns: list[str]) -> list[str]:
    """Columns named ``c<digits>`` in the order of their numbers; an error if there is none."""
    found = sorted((c for c in columns if re.fullmatch(r"c\d+", c)), key=lambda c: int(c[1:]))
    if not found:
        raise ValueError("no candidate column")
    return found


def unpivot(wide: DataFrame) -> DataFrame:
    """``(row_id, src, time, pos, cand)`` from a wide slate table that has ``row_id``."""
    names = candidate_columns(wide.columns)
    return wide.select("row_id", "src", "time", F.posexplode(F.array(*names)).alias("pos", "cand")).withColumn("pos", F.col("pos").cast("long"))


def _in_file_order(df: DataFrame, name: str = "row_id") -> DataFrame:
    """The rows of a text source with their number, in the order of files and lines.

    Rows are numbered within a block of a file, and each block starts after all earlier
    ones; one row per block is put in order by one task.
    """
    block = [F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start")]
    marked = df.select(*[F.col(f"`{c}`") for c in df.columns], *block, F.monotonically_increasing_id().alias("_line"))
    order = ["_path", "_start"]
    sizes = marked.groupBy(*order).count()
    before = sizes.select(*order, (F.sum("count").over(Window.orderBy(*order)) - F.col("count")).alias("_before"))
    within = marked.withColumn("_within", F.row_number().over(Window.partitionBy(*order).orderBy("_line")) - 1)
    return within.join(F.broadcast(before), order).select((F.col("_before") + F.col("_within")).alias(name), *[F.col(f"`{c}`") for c in df.columns])


def read_slates(spark: SparkSession, path: str) -> DataFrame:
    """Wide slates from CSV, with the files' row order as ``row_id``."""
    text = spark.read.csv(path, header=True, inferSchema=False)
    names = candidate_columns(text.columns)
    rows = _in_file_order(text)
    return unpivot(rows.select("row_id", F.col("src").cast("long").alias("src"), F.col("time").cast("double").alias("time"), *[F.col(c).cast("long").alias(c) for c in names]))


def read_score_matrix(spark: SparkSession, path: str, width: int) -> DataFrame:
    """``(row_id, pos, score)`` from a headerless matrix; refuses other widths and values that are not finite."""
    cells = _in_file_order(spark.read.text(path).withColumnRenamed("value", "line")).select("row_id", F.split(F.regexp_replace("line", r"\r$", ""), ",", -1).alias("t"))
    scores = cells.select("row_id", F.size("t").alias("n"), F.posexplode(F.transform("t", lambda v: v.try_cast("double"))).alias("pos", "score"))
    bad = scores.where((F.col("n") != width) | F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf"))).limit(1).count()
    if bad:
        raise ValueError(f"not a matrix of {width} finite columns")
    return scores.select("row_id", F.col("pos").cast("long").alias("pos"), "score")


def score_lines(cells: DataFrame) -> DataFrame:
    """``(row_id, line)``: six decimals, separated by commas, in the order of positions."""
    lists = cells.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("pos", "score"))).alias("v"))
    return lists.select("row_id", F.array_join(F.transform("v", lambda c: F.format_string("%.6f", c["score"])), ",").alias("line"))


def write_score_matrix(cells: DataFrame, path: str) -> None:
    """Text parts in the order of rows, with CRLF line ends; sorted by ranges, so no task writes all rows."""
    score_lines(cells).orderBy("row_id").select("line").write.option("lineSep", "\r\n").text(path)


def write_score_file(cells: DataFrame, path: str) -> dict:
    """One text file of the matrix: its parts are put together under a temporary name, verified, and renamed; its line and field counts."""
    from ..plans.stages import Store

    spark = cells.sparkSession
    store, draft, parts = Store(spark), f"{path}.part", f"{path}.parts"
    for old in (draft, parts):
        if store.exists(old):
            store.remove(old)
    try:
        write_score_matrix(cells, parts)
        store.concatenate([f"{parts}/{n}" for n in sorted(store.names(parts)) if n.startswith("part-")], draft)
        shape = cells.groupBy("row_id").count().agg(F.count(F.lit(1)).alias("rows"), F.max("count").alias("width"), F.min("count").alias("least")).first()
        found = verify_score_file(spark, draft, shape["rows"], shape["width"] or 0)
    except BaseException:
        if store.exists(draft):
            store.remove(draft)
        raise
    finally:
        store.remove(parts)
    if store.exists(path):
        store.remove(path)
    store.rename(draft, path)
    return found


def verify_score_file(spark: SparkSession, path: str, rows: int, width: int) -> dict:
    """Raises unless the file has ``rows`` lines of ``width`` numbers of six decimals, each line with CRLF at its end."""
    lines = spark.read.option("lineSep", "\n").text(path)
    token = r"-?[0-9]+[.][0-9]{6}"
    whole = F.col("value").rlike(rf"^{token}(,{token})*\r$")
    found = lines.agg(F.count(F.lit(1)).alias("rows"), F.count_if(~whole).alias("odd"), F.count_if(F.size(F.split("value", ",")) != width).alias("ragged")).first().asDict()
    if found["rows"] != rows or found["odd"] or found["ragged"]:
        raise ValueError(f"expected {rows} lines of {width} fields, found {found}")
    return {"rows": rows, "fields": rows * width}


def read_vectors(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """``(id, vec)`` from CSV with an id column and numeric columns; optionally of an expected number of rows."""
    wide = spark.read.csv(path, header=True, inferSchema=False)
    out = wide.select(F.col(wide.columns[0]).cast("long").alias("id"), F.array(*[F.col(c).cast("double") for c in wide.columns[1:]]).alias("vec"))
    if rows is not None:
        check_vectors(out, rows, len(wide.columns) - 1)
    return out


def check_vectors(vectors: DataFrame, rows: int, width: int) -> None:
    """Raises unless there are ``rows`` vectors of ``width`` finite values, one for each id."""
    odd = F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    found = vectors.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.count_if(F.col("id").isNull() | (F.size("vec") != width) | odd).alias("odd")).first()
    if (found["n"], found["ids"], found["odd"]) != (rows, rows, 0):
        raise ValueError(f"expected {rows} vectors of {width} finite values, found {found['n']} with {found['ids']} ids, {found['odd']} of them odd")


def write_vectors(vectors: DataFrame, path: str) -> None:
    """Vectors of six decimals, under a temporary name first."""
    from ..plans.stages import Store

    store = Store(vectors.sparkSession)
    vectors.select("id", F.transform("vec", lambda v: F.round(v, 6)).alias("vec")).write.parquet(f"{path}.part")
    store.rename(f"{path}.part", path)


#: Bytes of an array that one task reads.
NPY_BLOCK = 64 << 20


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """``(id, vec array<double>)`` of a two-dimensional ``.npy`` array; every task reads its own rows of the file."""
    import numpy as np
    import pyarrow as pa
    from pyarrow import fs

    files, place = fs.FileSystem.from_uri(path)
    with files.open_input_file(place) as file:
        header = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}[np.lib.format.read_magic(file)]
        shape, fortran, kind = header(file)
        start = file.tell()
    if len(shape) != 2 or fortran or kind.hasobject:
        raise ValueError("not a two-dimensional array of numbers in the order of rows")
    rows, width = shape
    step = max(1, NPY_BLOCK // max(1, width * kind.itemsize))

    def run(batches):
        files, place = fs.FileSystem.from_uri(path)
        with files.open_input_file(place) as file:
            for batch in batches:
                for first in batch.column(0).to_pylist():
                    n = min(step, rows - first)
                    file.seek(start + first * width * kind.itemsize)
                    values = np.frombuffer(file.read(n * width * kind.itemsize), kind).astype(np.float64)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, max(1, width))[: n + 1], pa.int32()), pa.array(values))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + n)), lists], names=["id", "vec"])

    blocks = -(-rows // step)
    return spark.range(0, rows, step, max(1, min(blocks, 10_000))).mapInArrow(run, "id long, vec array<double>")


def read_npz(spark: SparkSession, path: str, name: str) -> DataFrame:
    """``(id, vec)`` of one two-dimensional member of an NPZ file, which is inflated by the driver: a cache of bounded size."""
    import numpy as np

    with np.load(path, allow_pickle=False) as found:
        if name not in found:
            raise ValueError(f"no member {name}")
        values = found[name].astype(np.float64)
    if values.ndim != 2:
        raise ValueError("not a two-dimensional array")
    return spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(values)], "id long, vec array<double>")


def read_virtual_edges(spark: SparkSession, path: str | None) -> DataFrame:
    """``(src, dst)`` from CSV; no path means no edges."""
    if path is None:
        return spark.createDataFrame([], "src long, dst long")
    return spark.read.schema("src long, dst long").csv(path, header=True)


def write_archive(path: str, members: dict[str, bytes]) -> None:
    """A ZIP archive with fixed header fields, so equal members give equal bytes; reopened and compared."""
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED, compresslevel=9) as z:
        for name in sorted(members):
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type, info.external_attr = zipfile.ZIP_DEFLATED, 0o644 << 16
            z.writestr(info, members[name])
    with open(path, "wb") as out:
        out.write(buffer.getvalue())
    with zipfile.ZipFile(path) as z:
        if z.testzip() or {n: z.read(n) for n in z.namelist()} != members:
            raise ValueError("the archive does not read back")


def read_archive_member(path: str, name: str) -> bytes:
    with zipfile.ZipFile(path) as z:
        return z.read(name)


def repack(path: str, base: str, replaced: dict[str, bytes]) -> None:
    """The archive ``base`` with some members replaced; every other member keeps its bytes, which is verified."""
    with zipfile.ZipFile(base) as z:
        members = {n: z.read(n) for n in z.namelist()}
    if missing := replaced.keys() - members.keys():
        raise ValueError(f"{base} has no member {sorted(missing)}")
    write_archive(path, members | replaced)
    for name in members.keys() - replaced.keys():
        if read_archive_member(path, name) != members[name]:
            raise ValueError(f"{name} was not passed through")
