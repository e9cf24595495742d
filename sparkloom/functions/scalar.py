"""The scalar functions: each takes compiled arguments and gives compiled text."""

from __future__ import annotations

import re
from collections.abc import Callable

from ..errors import LoomError
from . import Sql, is_int, is_numeric, quote
from .casts import as_json_text, cast, json_string, list_text, type_name

FUNCTIONS: dict[str, tuple[int, int, Callable[..., Sql]]] = {}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def define(names: str, low: int, high: int | None = None):
    """Register a function under ``names`` for ``low`` to ``high`` arguments (-1: any number)."""

    def add(f):
        for n in names.split():
            FUNCTIONS[n] = (low, low if high is None else high, f)
        return f

    return add


def call(name: str, args: list[Sql]) -> Sql:
    if name not in FUNCTIONS:
        raise LoomError("FunctionNotFound", name)
    low, high, f = FUNCTIONS[name]
    if len(args) < low or (high >= 0 and len(args) > high):
        raise LoomError("WrongArgCount", name)
    return f(*args)


def text(e: Sql) -> str:
    """As a string; only strings and NULL qualify, as elsewhere types don't mix."""
    return e.text if e.type in ("string", "json", "uuid") else cast(e, "string").text


def big(e: Sql) -> str:
    return e.text if e.type == "bigint" else cast(e, "bigint").text


def dbl(e: Sql) -> str:
    return e.text if e.type == "double" else cast(e, "double").text


def stamp(e: Sql) -> str:
    return e.text if e.type == "timestamp_ntz" else cast(e, "timestamp_ntz").text


def constant(e: Sql) -> str:
    """The value of a string literal."""
    m = re.fullmatch(r"'((?:[^'\\]|\\.)*)'", e.text, re.S)
    if not m:
        raise LoomError("UnsupportedFeature", "a constant is needed")
    return re.sub(r"\\(.)", r"\1", m[1], flags=re.S)


def simple(names: str, n: int, template: str, result: str, kinds: str = "") -> None:
    """A function by template; ``kinds`` says how to convert each argument (t, b, d, or . for as it is)."""
    turn = {"t": text, "b": big, "d": dbl, ".": lambda e: e.text, "s": stamp}

    def f(*args: Sql) -> Sql:
        return Sql(template.format(*(turn[k](a) for k, a in zip(kinds or "t" * n, args))), result)

    define(names, n)(f)


# -- strings -----------------------------------------------------------------
simple("upper ucase", 1, f"translate({{0}}, '{_LOWER}', '{_UPPER}')", "string")
simple("lower lcase", 1, f"translate({{0}}, '{_UPPER}', '{_LOWER}')", "string")
simple("reverse", 1, "reverse({0})", "string")
simple("repeat", 2, "repeat({0}, cast({1} as int))", "string", "tb")
simple("ascii unicode ord", 1, "cast(case when {0} = '' then 0 else conv(hex(encode(substring({0}, 1, 1), 'UTF-32')), 16, 10) end as bigint)", "bigint")
simple("chr", 1, "decode(unhex(lpad(hex({0}), 8, '0')), 'UTF-32')", "string", "b")
simple("length len char_length character_length", 1, "cast(length({0}) as bigint)", "bigint")
simple("strpos instr", 2, "cast(instr({0}, {1}) as bigint)", "bigint")
simple("position", 2, "cast(instr({0}, {1}) as bigint)", "bigint")
simple("starts_with prefix", 2, "startswith({0}, {1})", "boolean")
simple("ends_with suffix", 2, "endswith({0}, {1})", "boolean")
simple("contains", 2, "contains({0}, {1})", "boolean")
simple("replace", 3, "case when {1} = '' then {0} else replace({0}, {1}, {2}) end", "string")
simple("lpad", 3, "lpad({0}, cast({1} as int), {2})", "string", "tbt")
simple("rpad", 3, "rpad({0}, cast({1} as int), {2})", "string", "tbt")
simple("left", 2, "case when {1} >= 0 then substring({0}, 1, cast({1} as int)) else substring({0}, 1, greatest(0, length({0}) + cast({1} as int))) end", "string", "tb")
simple("right", 2, "case when {1} >= 0 then right({0}, cast({1} as int)) else right({0}, greatest(0, length({0}) + cast({1} as int))) end", "string", "tb")
simple("split_part", 3, "case when {2} = 0 then '' else split_part({0}, {1}, cast(nullif({2}, 0) as int)) end", "string", "ttb")
simple("unhex from_hex", 1, "unhex({0})", "binary")
simple("regexp_matches", 2, "({0} rlike {1})", "boolean")
simple("regexp_full_match", 2, "({0} rlike concat('^(?:', {1}, ')$'))", "boolean")


@define("hex to_hex", 1)
def _hex(e):
    return Sql(f"hex({e.text if is_int(e.type) or e.type == 'binary' else text(e)})", "string")


@define("trim", 1, 2)
def _trim(s, chars=None):
    return Sql(f"trim(BOTH {text(chars) if chars else quote(' ')} FROM {text(s)})", "string")


@define("ltrim", 1, 2)
def _ltrim(s, chars=None):
    return Sql(f"trim(LEADING {text(chars) if chars else quote(' ')} FROM {text(s)})", "string")


@define("rtrim", 1, 2)
def _rtrim(s, chars=None):
    return Sql(f"trim(TRAILING {text(chars) if chars else quote(' ')} FROM {text(s)})", "string")


@define("substr substring", 2, 3)
def _substring(s, start, size=None):
    x, b = text(s), big(start)
    begin = f"(case when {b} < 0 then length({x}) + {b} + 1 else {b} end)"
    if size is None:
        return Sql(f"substring({x}, cast(greatest({begin}, 1) as int))", "string")
    n = big(size)
    low, high = f"(case when {n} < 0 then {begin} + {n} else {begin} end)", f"(case when {n} < 0 then {begin} else {begin} + {n} end)"
    return Sql(f"substring({x}, cast(greatest({low}, 1) as int), cast(greatest({high} - greatest({low}, 1), 0) as int))", "string")


@define("concat", 1, -1)
def _concat(*args):
    return Sql(f"concat_ws('', {', '.join(text(a) for a in args)})", "string")


@define("concat_ws", 2, -1)
def _concat_ws(sep, *args):
    return Sql(f"concat_ws({text(sep)}, {', '.join(text(a) for a in args)})", "string")


@define("regexp_extract", 2, 3)
def _regexp_extract(s, pattern, group=Sql("0", "int")):
    number = int(group.text)
    if number > 9:
        raise LoomError("ValueOutOfRange", "regexp_extract group")
    groups = re.compile(constant(pattern)).groups if pattern.text.startswith("'") else 9
    if number > groups:
        return Sql(f"case when {text(s)} is not null then '' end", "string")
    return Sql(f"regexp_extract({text(s)}, {text(pattern)}, {number})", "string")


@define("regexp_replace", 3, 4)
def _regexp_replace(s, pattern, by, flags=None):
    every = flags is not None and "g" in constant(flags)
    # ``\\1`` in the dialect is ``$1`` in Java; a match wrapped in a group moves the others by one.
    target = re.sub(r"\\(\d)|([$\\])", lambda m: f"${int(m[1]) + (not every)}" if m[1] else "\\" + m[2], constant(by))
    if every:
        return Sql(f"regexp_replace({text(s)}, {text(pattern)}, {quote(target)})", "string")
    # Only the first match: what follows it is captured and put back.
    groups = re.compile(constant(pattern)).groups
    return Sql(f"regexp_replace({text(s)}, concat('(?s)(?-s:(', {text(pattern)}, '))(.*)$'), {quote(target + f'${groups + 2}')})", "string")


@define("string_split str_split string_to_array split", 2)
def _split(s, sep):
    x, d = text(s), text(sep)
    raw = f"case when {d} = '' then array({x}) else split({x}, concat('\\\\Q', {d}, '\\\\E')) end"
    return Sql(f"transform({raw}, e -> {json_string('e')})", "list")


@define("printf", 1, -1)
def _printf(fmt, *args):
    parts = [a.text if is_int(a.type) or a.type in ("double", "string") else dbl(a) if is_numeric(a.type) else text(a) for a in args]
    return Sql(f"format_string({', '.join([text(fmt), *parts])})", "string")


@define("format", 1, -1)
def _format(fmt, *args):
    out, at, given = [], 0, constant(fmt)
    for m in re.finditer(r"\{\{|\}\}|\{(\d*)\}|[^{}]+", given):
        if m.group() in ("{{", "}}"):
            out.append(quote(m.group()[0]))
        elif m.group().startswith("{"):
            k = int(m[1]) if m[1] else at
            at += not m[1]
            if k >= len(args):
                raise LoomError("WrongArgCount", "format")
            out.append(text(args[k]))
        else:
            out.append(quote(m.group()))
    return Sql(f"concat({', '.join(out) or quote('')})", "string")


@define("like_escape", 3)
def _like_escape(s, p, c):
    return Sql(f"({text(s)} like {text(p)} escape {text(c)})", "boolean")


@define("glob", 2)
def _glob(s, p):
    if not p.text.startswith("'"):
        return Sql(f"loom_glob({text(s)}, {text(p)})", "boolean")
    from .texts import glob_regex

    return Sql(f"({text(s)} rlike {quote(glob_regex(constant(p)))})", "boolean")


@define("typeof", 1)
def _typeof(e):
    return Sql(quote(type_name(e.type)), "string")


# -- numbers -------------------------------------------------------------------
def _wide(e: Sql) -> str:
    """The type of a rounded number: whole numbers are BIGINT, all others DOUBLE."""
    return "bigint" if is_int(e.type) and e.type not in ("decimal(38,0)", "ubigint") else "double"


def _rounded(names: str, ints: str, doubles: str) -> None:
    def f(e: Sql) -> Sql:
        kind = _wide(e)
        return Sql((ints if kind == "bigint" else doubles).format(cast(e, kind).text), kind)

    define(names, 1)(f)


_rounded("abs", "case when {0} = (-9223372036854775807L - 1L) then null else abs({0}) end", "abs({0})")
_rounded("sign", "cast(sign({0}) as bigint)", "sign({0})")
_rounded("ceil ceiling", "{0}", "(case when abs({0}) < 9e15 then cast(ceil({0}) as double) else {0} end)")
_rounded("floor", "{0}", "(case when abs({0}) < 9e15 then cast(floor({0}) as double) else {0} end)")
_rounded("trunc", "{0}", "(case when abs({0}) < 9e15 then cast(cast({0} as bigint) as double) else {0} end)")


@define("round", 1, 2)
def _round(e, digits=Sql("0", "int")):
    kind = _wide(e)
    x = cast(e, kind).text
    if not re.fullmatch(r"-?\d+|\(-?\d+\)", digits.text):
        power = f"pow(10D, {digits.text})"
        return Sql(f"(sign({x}) * floor(abs({x}) * {power} + 0.5D) / {power})", "double")
    return Sql(f"round({x}, {digits.text})", kind)


@define("mod", 2)
def _mod(a, b):
    kind = "bigint" if _wide(a) == _wide(b) == "bigint" else "double"
    return Sql(f"({cast(a, kind).text} % nullif({cast(b, kind).text}, 0))", kind)


for _name, _t in {
    "sqrt": "case when {0} < 0 then null else sqrt({0}) end", "cbrt": "cbrt({0})", "exp": "exp({0})", "ln": "ln({0})", "log10": "log10({0})", "log2": "log2({0})",
    "radians": "radians({0})", "degrees": "degrees({0})",
}.items():
    simple(_name, 1, _t, "double", "d")
for _name in "sin cos tan asin acos atan sinh cosh tanh".split():
    simple(_name, 1, _name + "({0})", "double", "d")
simple("pow power", 2, "pow({0}, {1})", "double", "dd")
simple("atan2", 2, "atan2({0}, {1})", "double", "dd")


@define("log", 1, 2)
def _log(a, b=None):
    return Sql(f"log10({dbl(a)})" if b is None else f"(ln({dbl(b)}) / nullif(ln({dbl(a)}), 0D))", "double")


define("pi", 0)(lambda: Sql("pi()", "double"))
simple("isnan", 1, "case when {0} is not null then isnan({0}) end", "boolean", "d")
simple("isinf", 1, "(abs({0}) = double('infinity'))", "boolean", "d")
simple("isfinite", 1, "(not isnan({0}) and abs({0}) <> double('infinity') and {0} is not null or cast(null as boolean) and {0} is null)", "boolean", "d")


def _euclid(a: str, b: str) -> str:
    """The greatest common divisor; 92 steps are enough for 64 bits."""
    start = f"named_struct('a', cast(abs({a}) as decimal(20,0)), 'b', cast(abs({b}) as decimal(20,0)))"
    step = "(s, i) -> case when s.b = 0 then s else named_struct('a', s.b, 'b', cast(s.a % nullif(s.b, 0) as decimal(20,0))) end"
    return f"(case when {a} is not null and {b} is not null then cast(aggregate(sequence(1, 92), {start}, {step}, s -> s.a) as bigint) end)"


@define("gcd greatest_common_divisor", 2)
def _gcd(a, b):
    return Sql(_euclid(big(a), big(b)), "bigint")


@define("lcm least_common_multiple", 2)
def _lcm(a, b):
    x, y = big(a), big(b)
    return Sql(f"(case when {x} = 0 or {y} = 0 then 0L else try_cast(abs(cast({x} as decimal(20,0)) * ({y} div nullif({_euclid(x, y)}, 0))) as bigint) end)", "bigint")


simple("bit_count", 1, "cast(bit_count({0}) as bigint)", "bigint", "b")
for _name, _op in (("xor", "^"), ("bit_and", "&"), ("bit_or", "|")):
    simple(_name, 2, f"({{0}} {_op} {{1}})", "bigint", "bb")
simple("bit_not", 1, "(~{0})", "bigint", "b")
simple("bit_shift_left", 2, "case when {1} between 0 and 63 then shiftleft({0}, cast({1} as int)) end", "bigint", "bb")
simple("bit_shift_right", 2, "case when {1} between 0 and 63 then shiftright({0}, cast({1} as int)) end", "bigint", "bb")


@define("factorial", 1)
def _factorial(n):
    import math

    if not is_int(n.type) and n.type != "void":
        raise LoomError("TypeMismatch", "factorial")
    x = big(n)
    values = ", ".join(f"cast('{math.factorial(k)}' as decimal(38,0))" for k in range(34))
    return Sql(f"case when {x} is null then null when {x} < 0 then cast(1 as decimal(38,0)) when {x} > 33 then raise_error('ValueOutOfRange') else element_at(array({values}), cast(greatest(least({x}, 33), 0) as int) + 1) end", "decimal(38,0)")


# -- conditional -----------------------------------------------------------------
def _common(name: str, args: tuple[Sql, ...], function: str) -> Sql:
    from . import unify

    kind = unify([a.type for a in args])
    if kind == "void":
        return Sql("null", "void")
    parts = [cast(a, kind).text for a in args]
    return Sql(parts[0] if len(parts) == 1 else f"{function}({', '.join(parts)})", kind)


define("greatest", 1, -1)(lambda *a: _common("greatest", a, "greatest"))
define("least", 1, -1)(lambda *a: _common("least", a, "least"))
define("coalesce", 1, -1)(lambda *a: _common("coalesce", a, "coalesce"))
define("ifnull nvl", 2)(lambda *a: _common("ifnull", a, "coalesce"))


@define("nullif", 2)
def _nullif(a, b):
    from . import unify

    kind = unify([a.type, b.type])
    return Sql(f"case when {cast(a, kind).text} = {cast(b, kind).text} then null else {a.text} end", a.type)


@define("if iif", 3)
def _if(c, a, b):
    from . import unify

    kind = unify([a.type, b.type])
    return Sql(f"case when {c.text} then {cast(a, kind).text} else {cast(b, kind).text} end", kind)


# -- dates and times --------------------------------------------------------------
_PARTS = {
    "year": "year({0})", "years": "year({0})", "quarter": "quarter({0})", "month": "month({0})", "months": "month({0})", "week": "weekofyear({0})", "day": "day({0})", "days": "day({0})",
    "dayofmonth": "day({0})", "hour": "hour({0})", "hours": "hour({0})", "minute": "minute({0})", "minutes": "minute({0})", "second": "second({0})", "seconds": "second({0})",
    "dow": "(dayofweek({0}) - 1)", "dayofweek": "(dayofweek({0}) - 1)", "weekday": "(dayofweek({0}) - 1)", "isodow": "(weekday({0}) + 1)", "doy": "dayofyear({0})", "dayofyear": "dayofyear({0})",
    "epoch": "floor(unix_micros(cast({0} as timestamp)) / 1000000)", "millisecond": "(pmod(unix_micros(cast({0} as timestamp)), 60000000) div 1000)", "milliseconds": "(pmod(unix_micros(cast({0} as timestamp)), 60000000) div 1000)",
    "microsecond": "pmod(unix_micros(cast({0} as timestamp)), 60000000)", "microseconds": "pmod(unix_micros(cast({0} as timestamp)), 60000000)",
    "century": "((year({0}) + 99) div 100)", "decade": "(year({0}) div 10)", "isoyear": "extract(yearofweek from {0})",
}


def date_part(part: str, e: Sql) -> Sql:
    if part.lower() not in _PARTS:
        raise LoomError("UnsupportedFeature", f"date part {part}")
    return Sql(f"cast({_PARTS[part.lower()].format(stamp(e) if e.type != 'date' else e.text if 'timestamp' not in _PARTS[part.lower()] and 'hour' not in part.lower() and 'minute' not in part.lower() and 'second' not in part.lower() else stamp(e))} as bigint)", "bigint")


define("date_part datepart extract", 2)(lambda part, e: date_part(constant(part), e))
for _name in "year quarter month week day dayofmonth hour minute second dayofweek dayofyear epoch millisecond microsecond isodow century decade".split():
    define(_name, 1)(lambda e, p=_name: date_part(p, e))


def truncated(part: str, x: str) -> str:
    part = part.lower().rstrip("s") if part.lower() not in ("s",) else part
    if part in ("century", "decade", "millennium"):
        n = {"decade": 10, "century": 100, "millennium": 1000}[part]
        first = f"(year({x}) - pmod(year({x}) - {0 if n == 10 else 1}, {n}))"
        return f"cast(make_date({first}, 1, 1) as timestamp_ntz)"
    return f"cast(date_trunc('{part}', {x}) as timestamp_ntz)"


@define("date_trunc datetrunc", 2)
def _date_trunc(part, e):
    return Sql(truncated(constant(part), stamp(e)), "timestamp_ntz")


@define("date_diff datediff", 3)
def _date_diff(part, a, b):
    p, x, y = constant(part).lower().rstrip("s"), stamp(a), stamp(b)
    if p in ("year", "quarter", "month", "decade", "century"):
        number = {"year": "year({0})", "decade": "(year({0}) div 10)", "century": "((year({0}) + 99) div 100)", "quarter": "(year({0}) * 4 + quarter({0}))", "month": "(year({0}) * 12 + month({0}))"}[p]
        return Sql(f"cast({number.format(y)} - {number.format(x)} as bigint)", "bigint")
    if p in ("day", "week"):
        days = f"cast(datediff({y}, {x}) as bigint)"
        return Sql(days if p == "day" else f"({days} div 7)", "bigint")
    unit = {"hour": 3600000000, "minute": 60000000, "second": 1000000, "millisecond": 1000, "microsecond": 1}.get(p)
    if unit is None:
        raise LoomError("UnsupportedFeature", f"date part {p}")
    tick = "floor(unix_micros(cast({0} as timestamp)) / {1})"
    return Sql(f"cast({tick.format(y, unit)} - {tick.format(x, unit)} as bigint)", "bigint")


@define("date_add", 2, 3)
def _date_add(part, n, e=None):
    if e is None:  # (date, interval)
        return Sql(f"({stamp(part)} + {n.text})", "timestamp_ntz")
    p = constant(part).lower().rstrip("s")
    unit = {"quarter": ("month", 3), "decade": ("year", 10), "century": ("year", 100)}.get(p, (p, 1))
    return Sql(f"timestampadd({unit[0].upper()}, cast({big(n)} * {unit[1]} as int), {stamp(e)})", "timestamp_ntz")


simple("last_day", 1, "last_day({0})", "date", ".")
simple("dayname", 1, "date_format({0}, 'EEEE')", "string", "s")
simple("monthname", 1, "date_format({0}, 'MMMM')", "string", "s")
simple("make_date", 3, "make_date(cast({0} as int), cast({1} as int), cast({2} as int))", "date", "bbb")
simple("make_timestamp", 6, "try_make_timestamp_ntz(cast({0} as int), cast({1} as int), cast({2} as int), cast({3} as int), cast({4} as int), cast({5} as decimal(16,6)))", "timestamp_ntz", "bbbbb.")
simple("epoch_ms", 1, "floor(unix_micros(cast({0} as timestamp)) / 1000)", "bigint", "s")
simple("epoch_us", 1, "unix_micros(cast({0} as timestamp))", "bigint", "s")
simple("epoch_ns", 1, "try_cast(cast(unix_micros(cast({0} as timestamp)) as decimal(38,0)) * 1000 as bigint)", "bigint", "s")
simple("to_date", 1, "case when {0} rlike '^\\\\d{{4}}-\\\\d{{2}}-\\\\d{{2}}$' then try_cast({0} as date) end", "date")
simple("to_timestamp", 1, "case when {0} rlike '^\\\\d{{4}}-\\\\d{{2}}-\\\\d{{2}}([ T]\\\\d{{2}}:\\\\d{{2}}(:\\\\d{{2}}([.]\\\\d+)?)?)?$' then try_cast({0} as timestamp_ntz) end", "timestamp_ntz")


@define("strftime", 2)
def _strftime(e, fmt):
    # The conversions of the dialect; anything else stands for itself.
    known = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss"}
    out, literal = [], ""

    def plain() -> list[str]:  # one literal: two side by side would read as an escaped quote
        return ["'" + literal.replace("'", "''") + "'"] if literal else []

    for m in re.finditer(r"%(.)|([^%]+|%$)", constant(fmt), re.S):
        if m[1] and m[1] in known:
            out += [*plain(), known[m[1]]]
            literal = ""
        else:
            literal += "%" if m[1] == "%" else m.group()
    return Sql(f"date_format({stamp(e)}, {quote(''.join([*out, *plain()]))})", "string")


define("current_date today", 0)(lambda: Sql("current_date()", "date"))
define("current_time", 0)(lambda: Sql("current_time()", "time(6)"))
define("current_timestamp now get_current_timestamp", 0)(lambda: Sql("current_timestamp()", "timestamp"))


# -- JSON and lists -------------------------------------------------------------------
def elements(e: Sql) -> str:
    """The elements of a list as an array of JSON texts; NULL if it isn't one."""
    return e.text if e.type == "list" else "cast(null as array<string>)" if e.type == "void" else f"loom_elements({text(e)})"


def whole(e: Sql) -> str:
    return list_text(e) if e.type == "list" else text(e)


def _length(e: Sql) -> str:
    """How many elements a list has; 0 for other JSON."""
    n = f"size({e.text})" if e.type == "list" else f"coalesce(json_array_length({text(e)}), 0)"
    return f"case when {e.text} is not null then cast({n} as bigint) end"


simple("json_array_length array_length list_length", 1, "", "bigint")
FUNCTIONS["json_array_length"] = FUNCTIONS["array_length"] = FUNCTIONS["list_length"] = (1, 1, lambda e: Sql(_length(e), "bigint"))


@define("json_extract", 2)
def _json_extract(e, path):
    return Sql(f"loom_json_path({whole(e)}, {text(path) if path.type == 'string' else text(path)})", "json")


@define("json_extract_string", 2)
def _json_extract_string(e, path):
    return Sql(f"loom_json_string(loom_json_path({whole(e)}, {text(path)}))", "string")


@define("json_type", 1, 2)
def _json_type(e, path=None):
    x = whole(e) if path is None else _json_extract(e, path).text
    first = f"substring({x}, 1, 1)"
    kinds = {"{": "OBJECT", "[": "ARRAY", '"': "VARCHAR", "t": "BOOLEAN", "f": "BOOLEAN", "n": "NULL"}
    arms = " ".join(f"when {first} = '{k}' then '{v}'" for k, v in kinds.items())
    return Sql(f"case {arms} when {x} rlike '[.eE]' then 'DOUBLE' when {x} is not null then 'BIGINT' end", "string")


@define("to_json", 1)
def _to_json(e):
    return Sql(f"case when {e.text} is not null then {as_json_text(e)} end", "json")


@define("json_object", 2, -1)
def _json_object(*args):
    if len(args) % 2:
        raise LoomError("WrongArgCount", "json_object")
    parts = [f"{json_string(text(k))}, ':', {as_json_text(v)}" for k, v in zip(args[::2], args[1::2])]
    return Sql("concat('{', " + ", ',', ".join(parts) + ", '}')", "json")


@define("json_array list_value", 0, -1)
def _json_array(*args):
    return Sql(f"array({', '.join(as_json_text(a) for a in args)})" if args else "cast(array() as array<string>)", "list")


@define("list_extract array_extract", 2)
def _list_extract(e, i):
    if e.type == "string":
        return Sql(f"substring({text(e)}, cast({big(i)} as int), 1)", "string")
    x, n = elements(e), big(i)
    if re.fullmatch(r"[1-9]\d*", i.text):
        return Sql(f"get({x}, {int(i.text) - 1})", "json")
    return Sql(f"get({x}, cast(case when {n} > 0 then {n} - 1 when {n} < 0 then size({x}) + {n} else -1 end as int))", "json")


@define("list_slice array_slice", 3)
def _list_slice(e, low, high):
    x = elements(e)
    size = f"size({x})"
    a = "1" if low.type == "void" else f"(case when {big(low)} < 0 then {size} + {big(low)} + 1 else {big(low)} end)"
    b = size if high.type == "void" else f"(case when {big(high)} < 0 then {size} + {big(high)} + 1 else {big(high)} end)"
    return Sql(f"slice({x}, cast(greatest({a}, 1) as int), cast(greatest(least({b}, {size}) - greatest({a}, 1) + 1, 0) as int))", "list")


@define("map_extract", 2)
def _map_extract(e, k):
    return Sql(f"loom_map_get({whole(e)}, {text(k)})", "json")


@define("list_contains array_contains list_has array_has", 2)
def _list_contains(e, v):
    return Sql(f"case when {_null(v)} then null else array_contains({elements(e)}, {as_json_text(v)}) end", "boolean")


@define("list_position list_indexof array_position array_indexof", 2)
def _list_position(e, v):
    return Sql(f"case when {_null(v)} then null else nullif(cast(array_position({elements(e)}, {as_json_text(v)}) as bigint), 0) end", "bigint")


def _null(e: Sql) -> str:
    return f"({e.text} is null)"


@define("list_sort array_sort", 1)
def _list_sort(e):
    rank = "case when {0} = 'null' then 5 when {0} like '{{%' then 4 when {0} like '[%' then 3 when {0} in ('true', 'false') then 2 when {0} like '\"%' then 1 else 0 end"
    l, r = rank.format("l"), rank.format("r")
    cmp = f"case when {l} <> {r} then {l} - {r} when {l} = 0 then cast(sign(cast(l as double) - cast(r as double)) as int) when l < r then -1 when l > r then 1 else 0 end"
    return Sql(f"array_sort({elements(e)}, (l, r) -> {cmp})", "list")


define("list_distinct array_distinct", 1)(lambda e: Sql(f"filter(array_distinct({elements(e)}), x -> x <> 'null')", "list"))
define("list_reverse array_reverse", 1)(lambda e: Sql(f"reverse({elements(e)})", "list"))


@define("list_concat list_cat array_concat array_cat", 1, -1)
def _list_concat(*args):
    parts = [f"case when {a.text} is null then cast(array() as array<string>) else {elements(a)} end" for a in args if a.type != "void"]
    return Sql(f"concat({', '.join(parts)})" if parts else "cast(array() as array<string>)", "list")
