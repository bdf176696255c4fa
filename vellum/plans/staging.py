"""Intermediate tables in the folder that all executors share.

``spark.checkpoint.dir`` names that folder on a cluster. Where it is unset (a
single machine, tests) a temporary folder of this process is used. A staged
table cuts lineage like ``checkpoint()`` but is columnar and compressed, so a
lost executor costs nothing but the tasks it was running.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
_staged: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder: the session's setting, else one of our own for local sessions."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="vellum-")
        atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
    return "file://" + _local[app]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; runs the plan once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _staged.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def unstage(df: DataFrame) -> None:
    """Delete the files of a staged table once nothing will read it again."""
    for file in df.inputFiles()[:1]:
        _delete(df.sparkSession, file.rpartition("/")[0])


def clear(spark: SparkSession) -> None:
    """Delete all staged tables of this application; call it when their results are written."""
    for path in _staged.pop(spark.sparkContext.applicationId, []):
        _delete(spark, path)
