"""COPY: a query's rows as files.

Spark writes a folder of parts in parallel; a path that names a file by its
extension gets one file, moved into place by the file system.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..errors import LoomError
from .readers import FORMATS, detect


def write_file(df: DataFrame, path: str, format: str | None, json_columns: set[str], ordered: bool) -> int:
    """Write ``df`` to ``path`` and return the number of rows.

    One file is written by one task; the query itself runs in parallel before
    that, unless its rows have an order to keep.
    """
    spark = df.sparkSession
    kind = FORMATS.get(format, format) if format else detect(path)
    if kind not in ("csv", "tsv", "jsonl", "json", "parquet"):
        raise LoomError("UnsupportedFeature", f"format {format}")
    one = "." in path.rstrip("/").rsplit("/", 1)[-1]
    target = path + ".parts" if one else path
    seen = Observation()
    out = (df.coalesce(1) if ordered else df.repartition(1)) if one else df
    out = out.observe(seen, F.count(F.lit(1)).alias("n"))
    if kind == "parquet":
        out.write.mode("overwrite").parquet(target)
    elif kind in ("csv", "tsv"):
        out.write.mode("overwrite").options(header=True, sep="," if kind == "csv" else "\t", quote='"', escape='"', nullValue="", emptyValue='""', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, timestampNTZFormat="yyyy-MM-dd HH:mm:ss[.SSSSSS]").csv(target)
    else:
        line = _json_line(out, json_columns)
        out.select(line.alias("value")).write.mode("overwrite").text(target)
    count = seen.get["n"]
    if one:
        _single(spark, target, path)
    return count


def _json_line(df: DataFrame, json_columns: set[str]):
    """An object of each row: NULLs stay, NaN and infinities are null, JSON columns keep their text."""
    parts = []
    for name, kind in df.dtypes:
        col = F.col(f"`{name}`")
        if name in json_columns:
            value = F.coalesce(col, F.lit("null"))
        elif kind in ("double", "float"):
            bad = F.isnan(col) | (F.abs(col) == float("inf"))
            value = F.when(col.isNull() | bad, "null").otherwise(col.cast("string"))
        elif kind in ("string", "date") or kind.startswith("time"):
            text = F.to_json(F.struct(col.cast("string").alias("v")))
            value = F.when(col.isNull(), "null").otherwise(F.regexp_replace(text, r'(?s)^\{"v":(.*)\}$', "$1"))
        elif kind == "binary":
            value = F.when(col.isNull(), "null").otherwise(F.concat(F.lit('"'), F.hex(col), F.lit('"')))
        else:
            value = F.coalesce(col.cast("string"), F.lit("null"))
        key = '"' + name.replace("\\", "\\\\").replace('"', '\\"') + '":'
        parts += [F.lit(("," if parts else "{") + key), value]
    return F.concat(*parts, F.lit("}"))


def _single(spark, folder: str, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = next(s.getPath() for s in fs.listStatus(p) if s.getPath().getName().startswith("part-"))
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs.delete(target, True)
    fs.rename(part, target)
    fs.delete(p, True)
