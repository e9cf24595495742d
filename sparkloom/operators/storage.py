"""Materialized tables on storage that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..errors import LoomError

_LOCAL: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only for a local master that names none."""
    value = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if value:
        return value.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise LoomError("NoSharedFolder", "set spark.checkpoint.dir to a folder that the driver and all executors reach")
    if not _LOCAL:
        folder = tempfile.mkdtemp(prefix="loom_")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _LOCAL.append("file://" + folder)
    return _LOCAL[0]


def delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone at exit
        pass


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once and read it back: lineage is cut, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex[:12]}"
    schema = df.schema
    df.write.parquet(path)
    atexit.register(delete, spark, path)
    return spark.read.schema(schema).parquet(path)
