"""Runs statements from the command line: ``python -m sparkloom.cli [-f FORMAT] [NAME=PATH ...] SQL``."""

from __future__ import annotations

import csv
import io
import json
import sys
from collections.abc import Iterable

FORMATS = ("box", "csv", "tsv", "json", "jsonlines", "line", "list", "markdown", "insert", "trash")


def plain(v) -> str:
    return "" if v is None else str(v).lower() if isinstance(v, bool) else str(v)


def render(names: list[str], rows: Iterable[tuple], form: str = "box") -> str:
    """Rows as text in one of ``FORMATS``."""
    rows = list(rows)
    if form == "trash":
        return ""
    if form in ("csv", "tsv"):
        out = io.StringIO()
        writer = csv.writer(out, delimiter="," if form == "csv" else "\t", lineterminator="\n")
        writer.writerow(names)
        writer.writerows([plain(v) for v in r] for r in rows)
        return out.getvalue()
    if form in ("json", "jsonlines"):
        items = [json.dumps(dict(zip(names, r)), default=str, ensure_ascii=False) for r in rows]
        return "".join(i + "\n" for i in items) if form == "jsonlines" else "[" + ",\n".join(items) + "]\n"
    if form == "line":
        wide = max(map(len, names), default=0)
        return "\n".join("".join(f"{n:>{wide}} = {plain(v)}\n" for n, v in zip(names, r)) for r in rows)
    if form == "list":
        return "".join("|".join(map(plain, r)) + "\n" for r in [tuple(names), *rows])
    if form == "insert":

        def literal(v) -> str:
            return "NULL" if v is None else plain(v) if isinstance(v, (bool, int, float)) else "'" + str(v).replace("'", "''") + "'"

        return "".join(f"INSERT INTO \"table\" VALUES({','.join(map(literal, r))});\n" for r in rows)
    cells = [[plain(v) for v in r] for r in [tuple(names), *rows]]
    wide = [max(len(c[k]) for c in cells) for k in range(len(names))]
    lines = ["| " + " | ".join(f"{v:<{w}}" for v, w in zip(c, wide)) + " |" for c in cells]
    rule = "|" + "|".join("-" * (w + 2) for w in wide) + "|"
    if form == "markdown":
        return "\n".join([lines[0], rule, *lines[1:]]) + "\n"
    edge = rule.replace("|", "+")
    return "\n".join([edge, lines[0], edge, *lines[1:], edge]) + "\n"


def main(args: list[str]) -> int:
    from pyspark.sql import SparkSession

    from . import Engine, LoomError

    form = "box"
    if args[:1] == ["-f"]:
        form, args = args[1], args[2:]
    if not args or form not in FORMATS:
        print(__doc__, file=sys.stderr)
        return 2
    engine = Engine(SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate())
    try:
        for given in args[:-1]:
            name, _, path = given.partition("=")
            engine.register(name, path)
        df = engine.sql(args[-1])
        print(render(df.columns, (tuple(r) for r in df.toLocalIterator()), form), end="")
    except LoomError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
