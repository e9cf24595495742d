"""Casts: a value that can't be converted is NULL, except for JSON."""

from __future__ import annotations

from ..errors import LoomError
from . import INTEGERS, UNSIGNED, Sql, decimal_of, is_int, is_numeric, is_time

TYPE_NAMES = {
    "boolean": "BOOLEAN", "tinyint": "TINYINT", "smallint": "SMALLINT", "int": "INTEGER", "bigint": "BIGINT", "decimal(38,0)": "HUGEINT", "float": "FLOAT", "double": "DOUBLE",
    "string": "VARCHAR", "binary": "BLOB", "date": "DATE", "time(6)": "TIME", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE",
    "interval": "INTERVAL", "json": "JSON", "list": "JSON", "uuid": "UUID", "void": "\"NULL\"",
    "utinyint": "UTINYINT", "usmallint": "USMALLINT", "uinteger": "UINTEGER", "ubigint": "UBIGINT",
}


def type_name(t: str) -> str:
    return TYPE_NAMES.get(t) or t.upper()


def as_json_text(e: Sql) -> str:
    """The JSON text of a scalar; NULL becomes ``null``."""
    x = e.text
    if e.type == "list":
        return f"coalesce({list_text(e)}, 'null')"
    if e.type == "json":
        return f"coalesce({x}, 'null')"
    if e.type == "void":
        return "'null'"
    if e.type in ("string", "uuid"):
        return f"coalesce({json_string(x)}, 'null')"
    if e.type in ("float", "double"):
        return f"case when {x} is null or isnan({x}) or abs({x}) = double('infinity') then 'null' else cast({x} as string) end"
    if is_numeric(e.type) or e.type == "boolean":
        return f"coalesce(cast({x} as string), 'null')"
    if is_time(e.type) or e.type.startswith("time"):
        return f"coalesce(concat('\"', cast({x} as string), '\"'), 'null')"
    raise LoomError("TypeMismatch", f"{type_name(e.type)} as JSON")


def json_string(x: str) -> str:
    """A string as quoted JSON text."""
    return f"substring(to_json(named_struct('s', {x})), 6, length(to_json(named_struct('s', {x}))) - 6)"


def double_text(x: str) -> str:
    """The dialect's text of a DOUBLE: plain from 1e-4 to below 1e16, else an exponent of two digits or more."""
    power = "cast(substring_index(s, 'E', -1) as int)"
    plain = "regexp_replace(regexp_replace(cast(cast(s as decimal(38,20)) as string), '0+$', ''), '[.]$', '.0')"
    bare = "regexp_replace(substring_index(s, 'E', 1), '[.]?0+$', '')"
    short = f"concat({bare}, if({power} < 0, 'e-', 'e+'), if(abs({power}) < 10, '0', ''), abs({power}))"
    arms = "when s = 'NaN' then 'nan' when s = 'Infinity' then 'inf' when s = '-Infinity' then '-inf' when not contains(s, 'E') then s"
    # Java writes some numbers with more digits than they need, or with another last one; with 15 at most only denormal ones.
    many = "length(substring_index(replace(cast(v as string), '-', ''), 'E', 1)) > 16 or abs(v) between 4.9e-324D and 2.3e-308D"
    text = f"case when {many} then concat(if(v < 0, '-', ''), {_shortest('abs(v)')}) else cast(v as string) end"
    return f"transform(transform(array({x}), v -> {text}), s -> case {arms} when {power} between -4 and 15 then {plain} else {short} end)[0]"


def _shortest(a: str) -> str:
    """``d.ddd0E<power>`` with the fewest digits that read as the DOUBLE ``a`` > 0, of these the nearest.

    Digits come from the whole number that ``a`` is from 2^53 on, as far as decimals reach, else from Java's text.
    """
    high = f"floor({a} / 9223372036854775808D)"
    whole = f"cast(cast({high} as decimal(20,0)) * 9223372036854775808BD + cast(cast({a} - {high} * 9223372036854775808D as bigint) as decimal(19,0)) as string)"
    java = f"format_string('%.16e', {a})"
    parts = f"case when {a} between 9007199254740992D and 8.5e37D then struct(concat({whole}, '00') as d, length({whole}) - 1 as e) else struct(concat(replace(substring_index({java}, 'e', 1), '.', ''), '00') as d, cast(substring_index({java}, 'e', -1) as int) as e) end"
    near = lambda p, k: f"concat(cast(substring(t.d, 1, {p}) as bigint) + if(substring(t.d, {p} + 1, 1) >= '5', {k}, {1 - k}), 'E', t.e - {p} + 1)"
    tries = " ".join(f"when cast({c} as double) = {a} then {c}" for c in (near(15, 1), near(16, 1), near(16, 0)))
    denormal = f"filter(flatten(transform(sequence(1, 17), p -> array({near('p', 1)}, {near('p', 0)}))), c -> cast(c as double) = {a})[0]"
    found = f"case when {a} < 2.3e-308D then {denormal} {tries} else {near(17, 1)} end"
    dotted = "concat(substring(c, 1, 1), '.', substring(substring_index(c, 'E', 1), 2), '0E', cast(substring_index(c, 'E', -1) as int) + length(substring_index(c, 'E', 1)) - 1)"
    return f"transform(transform(array({parts}), t -> {found}), c -> {dotted})[0]"


def list_text(e: Sql) -> str:
    return f"concat('[', array_join({e.text}, ','), ']')"


def cast(e: Sql, to: str, soft: bool = False) -> Sql:
    """``CAST`` and ``TRY_CAST``; pairs without a conversion raise, or are NULL with ``soft``."""
    x, t = e.text, e.type
    if t == to:
        return e
    if t == "void":
        from . import spark_type

        return Sql(f"cast(null as {spark_type(to)})" if to != "interval" else "cast(null as interval)", to)
    if to in UNSIGNED:
        holder, top = UNSIGNED[to]
        wide = cast(e, "decimal(38,0)", soft).text
        return Sql(f"cast(case when {wide} between 0 and {top} then {wide} end as {holder})", to)
    if t in UNSIGNED:
        return cast(Sql(x, UNSIGNED[t][0]), to, soft)
    if to in INTEGERS or decimal_of(to):
        if t in ("float", "double"):
            return Sql(f"try_cast(rint({x}) as {to})" if is_int(to) else f"try_cast({x} as {to})", to)
        if t in ("string", "json"):
            # Exponents go through DOUBLE; fractions round half away from zero.
            if is_int(to):
                return Sql(f"try_cast(round(coalesce(try_cast(trim({x}) as decimal(38,10)), try_cast(trim({x}) as decimal(38,0)))) as {to})", to)
            return Sql(f"try_cast(trim({x}) as {to})", to)
        if is_numeric(t) or t == "boolean":
            if is_int(to) and (decimal_of(t) or (0, 0))[1]:
                return Sql(f"try_cast(round({x}) as {to})", to)
            return Sql(f"try_cast({x} as {to})", to)
    elif to in ("float", "double"):
        if t in ("string", "json") or is_numeric(t) or t == "boolean":
            return Sql(f"try_cast({'trim(' + x + ')' if t == 'string' else x} as {to})", to)
    elif to == "boolean":
        if t == "string":
            low = f"lower(trim({x}))"
            return Sql(f"case when {low} in ('true', 't', 'yes', 'y') then true when {low} in ('false', 'f', 'no', 'n') then false else try_cast({x} as double) <> 0 end", to)
        if is_numeric(t):
            return Sql(f"({x} <> 0)", to)
    elif to == "string":
        if t == "list":
            return Sql(list_text(e), to)
        if t in ("float", "double"):
            return Sql(double_text(x), to)
        if t == "boolean" or is_numeric(t) or t in ("json", "uuid", "date", "interval") or t.startswith("time"):
            return Sql(x if t in ("json", "uuid") else f"cast({x} as string)", to)
        if t == "binary":
            return Sql(f"cast({x} as string)", to)
    elif to == "json":
        if t == "list":
            return Sql(list_text(e), to)
        if t == "string":
            bad = "null" if soft else "raise_error('InvalidCast')"
            return Sql(f"case when {x} is null then null when try_parse_json({x}) is not null then trim({x}) else {bad} end", to)
    elif to == "list" and t in ("json", "string"):
        return Sql(f"loom_elements({x})", to)
    elif to == "date" and (is_time(t) or t == "string"):
        return Sql(f"try_cast({x} as date)", to)
    elif to in ("timestamp_ntz", "timestamp") and (is_time(t) or t == "string"):
        return Sql(f"try_cast({x} as {to})", to)
    elif to.startswith("time") and (t == "string" or t.startswith("time")):
        return Sql(f"try_cast({x} as time(6))", to)
    elif to == "binary" and t == "string":
        return Sql(f"cast({x} as binary)", to)
    elif to == "uuid" and t == "string":
        bare = f"lower(regexp_replace({x}, '[-{{}}]', ''))"
        parts = ", ".join(f"substring({bare}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
        return Sql(f"case when {bare} rlike '^[0-9a-f]{{32}}$' then concat_ws('-', {parts}) end", to)
    elif to == "interval" and t == "string":
        return Sql(f"try_cast({x} as interval)", to)
    if soft:
        from . import spark_type

        return Sql(f"cast(null as {spark_type(to)})", to)
    raise LoomError("InvalidCast", f"{type_name(t)} to {type_name(to)}")
