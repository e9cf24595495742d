"""Mixing sources to target weights by capped water-filling.

All of it is DataFrame code: word counts, the water level, and the sampling.

The level is found in closed form.  With sources in order of the level at which
their cap fills, ``(total - caps before) / (weights before taken off)`` rises
while sources must be clamped and falls afterwards, so its maximum is the level
at which clamping and proportional redistribution have come to rest.

A document is repeated whole times, and the fractional rest is spread evenly
over the source's documents in order of a seeded hash bucket and size, which
keeps a source's taken words within about a document of its target for every
bucket.  Buckets hold about ``BUCKET`` documents of one source, so a source with
a third of all rows is ranked by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import Scratch

BUCKET, SMALL, SALTS = 1024, 100_000, 32


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def cyclic_weights(sources: DataFrame, cycle: tuple[float, ...]) -> DataFrame:
    """``source, weight``: sources by code point, null last, take the weights in turn."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(cycle)))
    return sources.select("source").distinct().withColumn("weight", F.element_at(F.array(*[F.lit(float(c)) for c in cycle]), turn + 1))


def water_fill(sources: DataFrame, share: float, epochs: float) -> DataFrame:
    """Adds ``target`` to ``source, source_size, weight``: one row for each source.

    The targets sum to ``share`` times all sizes, in proportion to the positive
    weights, but none is above ``epochs`` times its source's size.
    """
    cap = F.col("source_size") * F.lit(float(epochs))
    every = Window.partitionBy()
    before = Window.orderBy("_fill", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    filled = sources.withColumn("_cap", cap).withColumn("_fill", F.col("_cap") / F.col("weight"))
    zero = F.lit(0.0)
    level = (F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(before), zero)) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), zero)
    )
    leveled = filled.withColumn("_level", level).withColumn("_level", F.max("_level").over(every))
    return leveled.withColumn("target", F.least("_cap", F.col("weight") * F.col("_level"))).drop("_cap", "_fill", "_level")


def _with_source(rows: DataFrame, sources: DataFrame, many: bool) -> DataFrame:
    """Left rows with their source's columns; a hot source never goes to one task."""
    sources = sources.withColumnRenamed("source", "_source")
    same = F.col("source").eqNullSafe(F.col("_source"))
    if not many:  # checked: at most SMALL rows
        return rows.join(F.broadcast(sources), same).drop("_source")
    salt = F.pmod(F.xxhash64("doc_id", "size"), F.lit(SALTS))
    copies = sources.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rows.withColumn("_salt", salt).join(copies, same & (F.col("_salt") == F.col("_copy"))).drop("_source", "_salt", "_copy")


def mix_sources(sized: DataFrame, weights: DataFrame | tuple[float, ...], share: float = 1.5, epochs: float = 2.0, seed: int = 17, tie: str | None = None) -> DataFrame:
    """``sized`` (``doc_id, source, size`` and any others) with ``source_size, target, copies``.

    ``weights`` is a table ``source, weight`` with a positive weight for every
    source, or a tuple for ``cyclic_weights``.  ``copies`` is how often the mix
    takes the document, at most ``epochs`` rounded up.  A null source is a source
    of its own; null and repeated ids are documents like others; sizes of 0 give
    0 copies only if the whole source has size 0.  The same input, seed and
    parameters give the same result, whatever the partitions; ``tie`` names a
    column that tells rows of one id and size apart, if there are such.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_docs"))
    if isinstance(weights, tuple):
        weights = cyclic_weights(per, weights)
    weights = weights.select(F.col("source").alias("_s"), F.col("weight").cast("double").alias("weight"))
    per = per.join(weights, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    per = Scratch(sized.sparkSession, "mix").save(water_fill(per, share, epochs), "sources")
    many = per.limit(SMALL + 1).count() > SMALL
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = _with_source(sized, per, many).withColumn("_h", digest)
    bucket = F.pmod(F.conv(F.substring("_h", 1, 8), 16, 10).cast("long"), F.ceil(F.col("_docs") / BUCKET))
    rows = rows.withColumn("_b", bucket)
    # A source as a key that is never null, so that ranking and joining share one partitioning.
    key = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source")))
    rows = rows.withColumn("_k", key)
    inside = Window.partitionBy("_k", "_b").orderBy(F.desc("size"), "_h", *([tie] if tie else []))
    counts = _with_source(sized.select("doc_id", "source", "size"), per, many).withColumn("_h", digest)
    counts = counts.select(key.alias("_k"), bucket.alias("_b")).groupBy("_k", "_b").agg(F.count("*").alias("_c"))
    # Documents in the buckets before, by groups of buckets, so that no task sees all buckets of a hot source.
    counts = counts.withColumn("_g", F.floor(F.col("_b") / BUCKET))
    before = (Window.unboundedPreceding, -1)
    groups = counts.groupBy("_k", "_g").agg(F.sum("_c").alias("_c"))
    groups = groups.select("_k", "_g", F.coalesce(F.sum("_c").over(Window.partitionBy("_k").orderBy("_g").rowsBetween(*before)), F.lit(0)).alias("_first"))
    inside_group = F.coalesce(F.sum("_c").over(Window.partitionBy("_k", "_g").orderBy("_b").rowsBetween(*before)), F.lit(0))
    counts = counts.withColumn("_in", inside_group).join(groups, ["_k", "_g"]).select("_k", "_b", (F.col("_first") + F.col("_in")).alias("_ahead"))
    ranked = rows.withColumn("_r", F.row_number().over(inside) - 1)
    ranked = ranked.join(counts, ["_k", "_b"]).withColumn("_r", F.col("_r") + F.col("_ahead"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    part = rate - F.floor(rate)
    extra = F.floor((F.col("_r") + 1) * part + 0.5) - F.floor(F.col("_r") * part + 0.5)
    return ranked.withColumn("copies", (F.floor(rate) + extra).cast("int")).drop("_docs", "weight", "_h", "_k", "_b", "_ahead", "_r")


def mixed_documents(docs: DataFrame, weights: DataFrame | tuple[float, ...], share: float = 1.5, epochs: float = 2.0, seed: int = 17) -> DataFrame:
    """The rows of ``docs`` (with ``doc_id, text, source``), each as often as the mix takes it.

    Other columns stay, whatever their names.
    """
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("_text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    mixed = mix_sources(rows, weights, share, epochs, seed, "_text").where("copies > 0")
    return mixed.withColumn("_copy", F.explode(F.expr("sequence(1, copies)"))).select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
