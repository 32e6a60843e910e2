"""The cluster's shared folder and tables written to it."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_scratch: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset
    a temporary folder is made and set if driver and executors are one machine (a local
    master); on a cluster that is an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    app = sc.applicationId
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="terrakin-shared-")
        sc.setCheckpointDir(_own[app])
    return _own[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session is gone: the folder's own retention applies
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; everything below this run's folder goes at exit."""
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        _scratch[app] = f"{shared_dir(spark).rstrip('/')}/terrakin-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _scratch[app])
    return f"{_scratch[app]}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, and a lost
    executor costs only the tasks it ran. ``options`` are those of the Parquet writer."""
    path = scratch(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(df: DataFrame | None) -> None:
    """Remove what ``materialize`` wrote for ``df``, once nothing reads it any more."""
    path = getattr(df, "__dict__", {}).get("_written_to")
    if path:
        _remove(df.sparkSession, path)
