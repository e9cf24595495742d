"""SUMMARIZE: a row of statistics for each column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summarize(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """One aggregate over the input, then one row per column."""
    spark, out = df.sparkSession, []
    numeric = ("TINYINT", "SMALLINT", "INTEGER", "BIGINT", "HUGEINT", "FLOAT", "DOUBLE", "UTINYINT", "USMALLINT", "UINTEGER", "UBIGINT")
    for k, c in enumerate(df.columns):
        col = F.col(f"`{c}`")
        number = types[c] in numeric or types[c].startswith("DECIMAL")
        x = col.cast("double") if number else F.lit(None).cast("double")
        stats = [
            F.min(col).cast("string").alias("min"), F.max(col).cast("string").alias("max"), F.approx_count_distinct(col).alias("approx_unique"),
            F.avg(x).alias("avg"), F.stddev_samp(x).alias("std"), F.percentile(x, F.lit(0.25)).alias("q25"), F.percentile(x, F.lit(0.5)).alias("q50"), F.percentile(x, F.lit(0.75)).alias("q75"),
            F.count("*").alias("count"), (100.0 * F.count_if(col.isNull()) / F.greatest(F.count("*"), F.lit(1))).alias("null_percentage"),
        ]
        out += [s.alias(f"_{k}_{j}") for j, s in enumerate(stats)]
    row = df.agg(*out)
    names = ["min", "max", "approx_unique", "avg", "std", "q25", "q50", "q75", "count", "null_percentage"]
    structs = [F.struct(F.lit(c).alias("column_name"), F.lit(types[c]).alias("column_type"), *[F.col(f"_{k}_{j}").alias(n) for j, n in enumerate(names)]) for k, c in enumerate(df.columns)]
    return row.select(F.inline(F.array(*structs)))
