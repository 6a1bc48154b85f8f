"""Tables written to the folder that the driver and all executors share, to cut lineage."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application under ``spark.checkpoint.dir``; a local session without it gets a temporary one."""
    context = spark.sparkContext
    app = context.applicationId
    if app not in _folders:
        base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not base:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="kairograph-")
        _folders[app] = f"{base.rstrip('/')}/tables-{app}"
        atexit.register(_clear, spark, _folders[app])
    return _folders[app]


def _clear(spark: SparkSession, folder: str) -> None:
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session has ended before; the folder stays
        return


def freed(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files that nobody reads any more; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame, name: str, by: str | None = None, instead_of: DataFrame | None = None) -> DataFrame:
    """``df`` written as Parquet, in a folder per value of ``by`` if given, and read again; the table that it replaces is deleted."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    freed(spark)
    if (old := getattr(instead_of, "_written_at", None)) is not None:
        _clear(spark, old)
    return out
