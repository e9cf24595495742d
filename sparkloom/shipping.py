"""The package on Python workers that don't find it by themselves."""

from __future__ import annotations

import atexit
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_DONE: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the application's workers, once, unless their path already leads to it.

    Spark's driver serves the archive; workers need no shared folder.
    """
    context = spark.sparkContext
    if context.applicationId in _DONE:
        return
    _DONE.add(context.applicationId)
    package = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(package)
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or (context.master.startswith("local[") and os.getcwd() == root):
        return
    handle, path = tempfile.mkstemp(suffix=".zip", prefix="sparkloom-")
    os.close(handle)
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, root))
    context.addPyFile(path)
    atexit.register(lambda: os.path.exists(path) and os.remove(path))
