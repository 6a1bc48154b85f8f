"""The shared folder of a session, and tables written there to cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_roots: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A folder for this application under ``spark.checkpoint.dir``.

    A local session that leaves the setting open, as in tests, gets a folder of
    its own. On a cluster it must be set: executors share no local folder.
    """
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not base:
            base = "file://" + tempfile.mkdtemp(prefix="kairograph-")
        # The full form names the file system, for readers that do not know Spark's default one.
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
        full = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
        full = full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full
        _roots[app] = f"{full.rstrip('/')}/kairograph-{app}"
        atexit.register(_remove, spark, _roots[app])
    return _roots[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is gone already; the folder then stays
        return


_scopes: dict[str, list[str]] = {}


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``stored`` writes inside are deleted at the end: results must have been written or collected by then."""
    app = spark.sparkContext.applicationId
    outer, _scopes[app] = _scopes.get(app), []
    try:
        yield
    finally:
        for path in _scopes[app]:
            _remove(spark, path)
        if outer is None:
            del _scopes[app]
        else:
            _scopes[app] = outer


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _scopes.get(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of keys that are broadcast at most (about 50 MB as a hash table).
SMALL_ROWS = 500_000


def small(ids: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``ids`` marked for broadcast if it has few rows, counted first; else left to a shuffle join."""
    from pyspark.sql import functions as F

    ids = stored(ids, "ids")
    return F.broadcast(ids) if ids.count() <= rows else ids
