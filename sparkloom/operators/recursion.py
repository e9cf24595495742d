"""Recursive common table expressions.

``UNION ALL`` uses Spark's own recursive CTE, whose limits the engine lifts.
``UNION`` removes rows met in any earlier step; Spark has no form of that, so the
driver runs one step after another, each over the rows that the last one found,
with every step's rows on shared storage.
"""

from __future__ import annotations

import uuid
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import LoomError
from ..functions import ident
from .storage import materialize

LIMIT, SHORT = 100_000, 100_000


def _met(found: DataFrame, seen: DataFrame) -> DataFrame:
    """The rows of ``seen`` that are in ``found``, or all; a short ``found`` comes to ``seen``, which then isn't shuffled."""
    if found.limit(SHORT + 1).count() > SHORT:
        return seen
    given = found.toDF(*[f"_f{k}" for k in range(len(found.columns))])
    same = [F.col(f"`{c}`").eqNullSafe(F.col(f"_f{k}")) for k, c in enumerate(seen.columns)]
    return seen.join(F.broadcast(given), reduce(and_, same), "left_semi")  # checked: at most SHORT rows


def recursive_view(engine, translator, cte, known: dict):
    """Registers the result and returns its view and columns."""
    body = cte.query.body
    if body.op != "UNION":
        raise LoomError("UnsupportedFeature", "only UNION recurs")
    anchor, columns = translator.body(body.left, None, known)
    names = list(cte.columns or []) + [n for n, _ in columns[len(cte.columns or []) :]]
    columns = [(n, t) for n, (_, t) in zip(names, columns)]
    view = f"_loom_{uuid.uuid4().hex[:12]}"
    listed = ", ".join(ident(n) for n in names)
    if body.all:
        inner = dict(known) | {cte.name.lower(): (ident(view), columns)}
        step, have = translator.body(body.right, None, inner)
        if len(have) != len(columns):
            raise LoomError("ColumnCountMismatch", cte.name)
        step = translator.conform(step, have, columns)
        base = translator.conform(anchor, [(f"_{k}", t) for k, (_, t) in enumerate(columns)], columns)
        text = f"with recursive {ident(view)} ({listed}) as ({base} union all {step}) select * from {ident(view)}"
        engine.spark.sql(text).createOrReplaceTempView(view + "_r")
        return view + "_r", columns
    frontier = materialize(engine.spark.sql(f"select distinct * from ({anchor})").toDF(*names))
    seen, every = frontier, [frontier]
    for _ in range(LIMIT):
        frontier.createOrReplaceTempView(view)
        step, have = translator.body(body.right, None, dict(known) | {cte.name.lower(): (ident(view), columns)})
        if len(have) != len(columns):
            raise LoomError("ColumnCountMismatch", cte.name)
        found = materialize(engine.spark.sql(translator.conform(step, have, columns)).toDF(*names).distinct())
        frontier = materialize(found.subtract(_met(found, seen)))
        if not frontier.limit(1).count():
            break
        every.append(frontier)
        seen = every[0]
        for e in every[1:]:
            seen = seen.unionByName(e)
        if len(every) >= 16:  # few files to read, however many steps
            seen = materialize(seen)
            every = [seen]
    else:
        raise LoomError("RecursionLimitExceeded", cte.name)
    seen.createOrReplaceTempView(view + "_r")
    return view + "_r", columns
