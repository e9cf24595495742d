"""Scalar and aggregate functions of the dialect as Spark SQL text.

A compiled expression is an ``Sql``: text and a type.  Types are Spark type names,
with a few of the dialect's own: ``json`` (JSON text in a string), ``list`` (an
``array<string>`` whose elements are JSON text), ``uuid``, ``interval`` and the
unsigned integers, which Spark holds in the next wider type.
"""

from __future__ import annotations

import re
from typing import NamedTuple

INTEGERS = ("tinyint", "smallint", "int", "bigint")
UNSIGNED = {"utinyint": ("smallint", 255), "usmallint": ("int", 65535), "uinteger": ("bigint", 4294967295), "ubigint": ("decimal(20,0)", 18446744073709551615)}


class Sql(NamedTuple):
    text: str
    type: str


def is_int(t: str) -> bool:
    return t in INTEGERS or t in UNSIGNED or t == "decimal(38,0)" or t == "decimal(20,0)"


def decimal_of(t: str) -> tuple[int, int] | None:
    m = re.fullmatch(r"decimal\((\d+),(\d+)\)", t)
    return (int(m[1]), int(m[2])) if m else {"tinyint": (3, 0), "smallint": (5, 0), "int": (10, 0), "bigint": (19, 0), "utinyint": (3, 0), "usmallint": (5, 0), "uinteger": (10, 0)}.get(t)


def is_numeric(t: str) -> bool:
    return decimal_of(t) is not None or t in ("float", "double", "ubigint")


def is_time(t: str) -> bool:
    return t in ("date", "timestamp", "timestamp_ntz")


def quote(value: str) -> str:
    """A Spark string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def spark_type(t: str) -> str:
    """The Spark type that holds values of ``t``."""
    return {"json": "string", "uuid": "string", "list": "array<string>", "interval": "interval"}.get(t, UNSIGNED.get(t, (t, 0))[0])


def unify(types: list[str]) -> str:
    """The common type of branches, arms and set operations."""
    from ..errors import LoomError

    kinds = [t for t in dict.fromkeys(types) if t != "void"]
    if not kinds:
        return "void"
    out = kinds[0]
    for t in kinds[1:]:
        if t == out:
            continue
        if is_numeric(t) and is_numeric(out):
            if "double" in (t, out) or "float" in (t, out):
                out = "double"
            elif t in INTEGERS and out in INTEGERS:
                out = max(t, out, key=INTEGERS.index)
            else:
                (p, s), (q, r) = decimal_of(spark_type(out)), decimal_of(spark_type(t))
                if "decimal(38,0)" in (t, out) or (s == 0 and r == 0 and max(p, q) > 19):
                    out = "decimal(38,0)"
                elif (is_int(t) and is_int(out)) and max(p, q) <= 19:
                    out = "bigint"
                else:
                    scale = max(s, r)
                    out = f"decimal({min(38, max(p - s, q - r) + scale + (0 if s == 0 or r == 0 else 1))},{scale})"
        elif is_time(t) and is_time(out):
            out = "timestamp" if "timestamp" in (t, out) else "timestamp_ntz"
        elif {t, out} <= {"json", "list"}:
            out = "json"
        elif {t, out} == {"string", "binary"}:
            out = "binary"
        elif "string" in (t, out) and {t, out} & {"json", "list", "uuid"}:
            out = "string"
        else:
            raise LoomError("TypeMismatch", f"{out} and {t}")
    return out
