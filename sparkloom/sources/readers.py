"""Files as DataFrames: format detection, schemas, Hive partitions, globs."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import LoomError

#: Extensions and the formats they name; anything else is Parquet.
FORMATS = {"csv": "csv", "tsv": "tsv", "tab": "tsv", "jsonl": "jsonl", "ndjson": "jsonl", "json": "json", "parquet": "parquet"}
#: Rows of a text file whose values decide the columns' types, unless all are asked for.
SAMPLE = 1000
#: What no cell holds: only cells without any character are NULL, quoted empty ones are empty.
NO_VALUE = "\0null"


#: The column with a JSON record's text while its members are taken out.
VALUE = "\0value"


def detect(path: str) -> str:
    bare = re.sub(r"[?#].*$", "", path) if "://" in path else path
    return FORMATS.get(bare.rstrip("/").rsplit(".", 1)[-1].lower(), "parquet")


#: Columns that tell a row's place: file of the list, path below a folder or glob, row of the file.
PLACE = ("_loom_list", "_loom_path", "_loom_row")


def _placed(df: DataFrame, k: int) -> DataFrame:
    at = df.metadataColumn("_metadata")
    return df.select("*", *[c.alias(n) for c, n in zip((F.lit(k), at["file_path"], at["row_index"]), PLACE)])


def read_files(spark: SparkSession, paths: list[str], format: str | None = None, sample: int | None = SAMPLE, place: bool = False) -> DataFrame:
    """One table of files whose columns have the same names in the same order.

    ``a+b`` names several files.  Types are unified pairwise.  Keys and types of
    text files come from the first ``sample`` records, or from all with None:
    then no value is lost, at the price of one more pass.  ``place`` adds PLACE,
    which only Parquet files can tell.
    """
    paths = [p for given in paths for p in (given.split("+") if "+" in given else [given])]
    frames = [_read(spark, p, format if format and format != "json" else detect(p) if format != "json" else ("jsonl" if detect(p) == "jsonl" else "json"), sample) for p in paths]
    if place:
        frames = [_placed(f, k) for k, f in enumerate(frames)]
    names = [c.lower() for c in frames[0].columns]
    if any([c.lower() for c in f.columns] != names for f in frames):
        raise LoomError("TypeMismatch", "files with other columns")
    if len({str(f.schema.jsonValue()) for f in frames}) > 1:
        kinds = [_wider([f.schema[k].dataType for f in frames]) for k in range(len(names))]
        first = frames[0].columns
        frames = [f.select(*[F.col(f"`{c}`").cast(t).alias(n) for c, t, n in zip(f.columns, kinds, first)]) for f in frames]
    return reduce(lambda a, b: a.union(b), frames)


_NUMBERS = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType(), T.FloatType(), T.DoubleType()]


def _wider(kinds: list[T.DataType]) -> T.DataType:
    out = kinds[0]
    for t in kinds[1:]:
        if t == out:
            continue
        if t in _NUMBERS and out in _NUMBERS:
            out = _NUMBERS[max(_NUMBERS.index(t), _NUMBERS.index(out))]
            out = T.DoubleType() if out == T.FloatType() else out
        elif {type(t), type(out)} == {T.DateType, T.TimestampNTZType}:
            out = T.TimestampNTZType()
        else:
            raise LoomError("TypeMismatch", f"{out.simpleString()} and {t.simpleString()}")
    return out


def _read(spark: SparkSession, path: str, kind: str, sample: int | None) -> DataFrame:
    reader = spark.read
    if "=" in path:
        base = re.split(r"/(?=[^/]*(?:=|\*))", path, maxsplit=1)[0]
        reader = reader.option("basePath", base)
    if "**" in path:  # any depth: from the folder before the stars, files by the last part's pattern
        root, _, rest = path.partition("**")
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", rest.rsplit("/", 1)[-1] or "*")
        if kind == "parquet":
            return reader.parquet(root.rstrip("/") or "/")
        path = path.replace("**/", "*/")
    if kind == "parquet":
        return reader.parquet(path)
    if kind in ("csv", "tsv"):
        return _delimited(spark, path, "," if kind == "csv" else "\t", sample)
    return _json(spark, path, kind == "json", sample)


def _infer(values: Column) -> dict[str, Column]:
    """Whether all non-empty values fit, by type."""
    v = F.trim(values)
    fits = {
        "boolean": F.lower(v).isin("true", "false"),
        "bigint": v.rlike(r"^[+-]?\d+$") & v.try_cast("bigint").isNotNull(),
        "double": v.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"),
        "date": v.rlike(r"^\d{4}-\d{2}-\d{2}$") & v.try_cast("date").isNotNull(),
        "timestamp_ntz": v.rlike(r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?$") & v.try_cast("timestamp_ntz").isNotNull(),
    }
    return {k: F.coalesce(F.bool_and(f | values.isNull() | (v == "")), F.lit(True)) for k, f in fits.items()}


def _choose(got: dict[str, bool], some: bool) -> str:
    if not some:
        return "string"
    if got["bigint"]:
        return "bigint"
    return next((k for k in ("boolean", "double", "date", "timestamp_ntz") if got[k]), "string")


def _delimited(spark: SparkSession, path: str, sep: str, sample: int | None) -> DataFrame:
    """The first record names the columns; other values than those of the types chosen are NULL.

    Files are split over tasks, unless a line with an odd number of quotes shows
    that a record goes on after its line's end.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    open_ended = not spark.read.text(path).where(quotes % 2 == 1).isEmpty()
    raw = spark.read.options(header=True, sep=sep, quote='"', escape='"', multiLine=open_ended, nullValue=NO_VALUE, emptyValue="", inferSchema=False, enforceSchema=True).csv(path)
    names = []
    for k, c in enumerate(raw.columns):
        names.append(c if not re.fullmatch(r"_c\d+", c) else f"column{k}")
    raw = raw.toDF(*names)
    return _typed(raw, names, sample)


def _typed(raw: DataFrame, names: list[str], first: int | None) -> DataFrame:
    sample = raw.limit(first) if first else raw
    checks = [[*_infer(F.col(f"`{c}`")).values(), F.count_if(F.col(f"`{c}`") != "") > 0] for c in names]
    row = sample.agg(*[x.alias(f"_{k}_{j}") for k, parts in enumerate(checks) for j, x in enumerate(parts)]).first()
    keys, out = ("boolean", "bigint", "double", "date", "timestamp_ntz"), []
    for k, c in enumerate(names):
        kind = _choose({key: row[f"_{k}_{j}"] for j, key in enumerate(keys)}, row[f"_{k}_5"])
        col = F.col(f"`{c}`")
        out.append((col if kind == "string" else F.trim(col).try_cast(kind)).alias(c))
    return raw.select(*out)


def _json(spark: SparkSession, path: str, whole: bool, sample: int | None) -> DataFrame:
    """JSON lines, or one document: an array of objects is rows, an object one row, an array of scalars a column ``json``.

    Nested values keep their text; columns come in order of first appearance.
    """
    if whole:
        text = spark.read.option("wholetext", True).text(path)
        lines = text.select(F.explode(F.when(F.trim("value").startswith("["), F.expr("loom_elements(value)")).otherwise(F.array(F.trim("value")))).alias("value"))
    else:
        lines = spark.read.text(path).where(F.trim("value") != "")
    # A row for each key: where it comes first, and what its values start with.
    head = (lines.limit(sample) if sample else lines).select(F.monotonically_increasing_id().alias("at"), F.posexplode(F.expr("loom_heads(value)")).alias("p", "m"))
    found = head.groupBy("m.k").agg(F.min(F.struct("at", "p")).alias("first"), F.collect_set("m.c").alias("starts")).orderBy("first").collect()
    keys = [r["k"] for r in found]
    if not keys:
        return lines.select(F.col("value").alias("json"))
    schema = T.StructType([T.StructField(k, T.StringType()) for k in keys])
    parsed = lines.select(F.from_json("value", schema).alias("r"), F.col("value").alias(VALUE)).select("r.*", VALUE)
    # Nested values and quoted numbers stay text: only plain ones decide the type.
    flat = [r["k"] for r in found if not set(r["starts"]) & {"[", "{", '"'}]
    typed = _typed(parsed, flat, sample) if flat else None
    kinds = dict(typed.dtypes) if typed is not None else {}
    nested = {r["k"] for r in found if set(r["starts"]) & {"[", "{"}}

    def column(k: str) -> Column:
        if k in kinds:
            return F.col(f"`{k}`").try_cast(kinds[k])
        if k not in nested:
            return F.col(f"`{k}`")
        raw = F.call_function("loom_json_path", F.col(VALUE), F.lit('$."' + k.replace("\\", "\\\\").replace('"', '\\"') + '"'))
        return F.call_function("loom_json_string", raw)

    return parsed.select(*[column(k).alias(k) for k in keys])


def flatten(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Struct leaves as ``a.b`` columns, lists and maps as JSON text; and which columns are JSON."""
    out, types = [], {}

    def holds_list(t: T.DataType) -> bool:
        return isinstance(t, (T.ArrayType, T.MapType)) or (isinstance(t, T.StructType) and any(holds_list(f.dataType) for f in t.fields))

    def leaves(col: Column, name: str, t: T.DataType):
        if isinstance(t, T.StructType) and not holds_list(t):
            for f in t.fields:
                leaves(col.getField(f.name), f"{name}.{f.name}", f.dataType)
        elif isinstance(t, T.ArrayType) and isinstance(t.elementType, (T.FloatType, T.DoubleType, T.IntegerType, T.LongType, T.ShortType, T.BooleanType)):
            out.append(F.transform(col, lambda x: F.coalesce(x.cast("string"), F.lit("null"))).alias(name))
            types[name] = "list"
        elif isinstance(t, (T.StructType, T.ArrayType, T.MapType)):
            out.append(F.to_json(_entries(col, t), {"ignoreNullFields": "false"}).alias(name))
            types[name] = "json"
        else:
            out.append(col.alias(name))

    if not any(isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) for f in df.schema.fields):
        return df, types
    for f in df.schema.fields:
        leaves(F.col(f"`{f.name}`"), f.name, f.dataType)
    return df.select(*out), types


def _entries(col: Column, t: T.DataType) -> Column:
    """Maps, at any depth, as arrays of ``{"key", "value"}``."""
    if isinstance(t, T.MapType):
        return F.transform(F.map_entries(col), lambda e: F.struct(e["key"].alias("key"), _entries(e["value"], t.valueType).alias("value")))
    if isinstance(t, T.ArrayType):
        return F.transform(col, lambda e: _entries(e, t.elementType))
    if isinstance(t, T.StructType):
        return F.when(col.isNotNull(), F.struct(*[_entries(col.getField(f.name), f.dataType).alias(f.name) for f in t.fields]))
    return col
