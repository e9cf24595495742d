"""Shared storage for intermediate tables.

Lineage is cut by writing Parquet to the folder that every executor and the
driver share (``spark.checkpoint.dir``).  Parquet is used rather than
``DataFrame.checkpoint`` because it is columnar and compressed: the tables
written here hold hashes and ids of a whole corpus.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..errors import LoomError
from ..shipping import ship

_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one only for a local master that names none."""
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


def bound_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Send at most ``rows`` texts to a Python worker at once, for the session: texts can be long.

    Every operator that runs Python starts here, so the workers also get the package.
    """
    ship(spark)
    now = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"))
    if not 0 < now <= rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


class Scratch:
    """Tables of one operator run, under one folder of the shared directory."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        atexit.register(self.drop)
        bound_batches(spark)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return a DataFrame that reads it back."""
        path = f"{self.root}/{name}"
        # Not Snappy: its writers hold direct buffers until some later collection.
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        self.release()
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Let Spark delete shuffle files of plans that nothing refers to any more."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, name: str = "") -> None:
        """Delete one table, or the whole folder."""
        try:
            jvm = self.spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session may be gone at exit; a leftover folder is harmless
            pass
