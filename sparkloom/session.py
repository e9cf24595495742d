"""The engine: names, statements, and the Spark session they run in."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import LoomError
from .functions import Sql, ident, spark_type
from .functions.casts import cast, type_name
from .functions.texts import register as register_functions
from .operators.recursion import recursive_view
from .operators.storage import materialize
from .operators.summarize import summarize
from .plans.parser import Node, parse
from .plans.translator import Scope, Translator
from .shipping import ship
from .sources.readers import PLACE, SAMPLE, detect, flatten, read_files
from .sources.writers import write_file

#: Parts that INSERT statements add to a table before it is written as one.
PARTS = 32
#: Semantics that the dialect needs from Spark.
SETTINGS = {
    "spark.sql.ansi.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.timeType.enabled": "true",
    "spark.sql.caseSensitive": "false",
    "spark.sql.crossJoin.enabled": "true",
    "spark.sql.cteRecursionLevelLimit": "100000",
    "spark.sql.cteRecursionRowLimit": "-1",
}


def logical_type(t: str) -> str:
    """The dialect's type for a Spark type name."""
    return {"timestamp_ntz": "timestamp_ntz", "array<string>": "list"}.get(t, "json" if t.startswith(("array", "struct", "map")) else "string" if t.startswith(("varchar", "char")) else t)


class Engine:
    """Registers files and answers SQL with DataFrames.

    Each engine has its own Spark session state (``spark.newSession()``), so its
    settings and views don't reach the caller's session.
    """

    def __init__(self, spark: SparkSession):
        ship(spark)
        self.spark = spark.newSession()
        for key, value in SETTINGS.items():
            try:
                self.spark.conf.set(key, value)
            except Exception:  # a setting that this version doesn't know
                pass
        register_functions(self.spark)
        self.files: dict[str, tuple[str, list[tuple[str, str]]]] = {}
        self.memory: dict[str, tuple[DataFrame, list[tuple[str, str, bool]]]] = {}
        self.parts: dict[str, int] = {}  # INSERT statements by table
        self.views: dict[str, Node] = {}
        self._depth = 0
        self._paths: dict[tuple, tuple[str, list]] = {}
        self._sources: dict[str, tuple[list[str], str | None]] = {}  # paths and format by view
        self._placed: dict[str, tuple[str, list[str]] | None] = {}

    # -- registration -----------------------------------------------------------
    def register(self, name: str, *paths: str, format: str | None = None, sample: int | None = SAMPLE) -> None:
        """One table of one or more files, globs or directories with the same columns.

        ``sample`` records of a text file decide its keys and types; None: all.
        """
        self.register_frame(name, read_files(self.spark, list(paths), format, sample))
        self._sources[self.files[name.lower()][0]] = list(paths), format

    def register_frame(self, name: str, df: DataFrame) -> None:
        """Any DataFrame as a read-only table; nested columns are flattened or become JSON."""
        df, types = flatten(df)
        self.files[name.lower()] = self._view(df, types)

    def _view(self, df: DataFrame, types: dict[str, str]) -> tuple[str, list[tuple[str, str]]]:
        view = f"_loom_{uuid.uuid4().hex[:12]}"
        if df.sparkSession is self.spark:
            df.createOrReplaceTempView(view)
            name = ident(view)
        else:  # a frame of another session of the same application
            df.createOrReplaceGlobalTempView(view)
            name = f"global_temp.{ident(view)}"
        return name, [(n, types.get(n) or logical_type(t)) for n, t in df.dtypes]

    # -- what the translator asks for ------------------------------------------------
    def relation(self, name: str, translator: Translator) -> tuple[str, list[tuple[str, str]]]:
        key = name.lower()
        if key in self.files:
            return self.files[key]
        if key in self.memory:
            df, columns = self.memory[key]
            view, _ = self._view(df, {})
            return view, [(n, t) for n, t, _ in columns]
        if key in self.views:
            if self._depth >= 16:
                raise LoomError("RecursionLimitExceeded", name)
            self._depth += 1
            try:
                text, columns = Translator(self).query(self.views[key])
            finally:
                self._depth -= 1
            return f"({text})", columns
        if re.search(r"[./*]", name):
            return self.file(name, None)
        raise LoomError("TableNotFound", name)

    def file(self, path: str, format: str | None) -> tuple[str, list[tuple[str, str]]]:
        if (path, format) not in self._paths:
            df, types = flatten(read_files(self.spark, [path], format))
            self._paths[path, format] = self._view(df, types)
            self._sources[self._paths[path, format][0]] = [path], format
        return self._paths[path, format]

    def placed(self, view: str) -> tuple[str, list[str]] | None:
        """A view of the same rows with their places, and the columns that order them; None where rows have no order."""
        if view in self._sources and view not in self._placed:
            paths, format = self._sources[view]
            self._placed[view] = None
            if all((format or detect(p)) == "parquet" for given in paths for p in given.split("+")):
                df, types = flatten(read_files(self.spark, paths, format, place=True))
                several = (len(paths) > 1 or "+" in paths[0], len(df.inputFiles()) > 1, True)
                self._placed[view] = self._view(df, types)[0], [c for c, s in zip(PLACE, several) if s]
        return self._placed.get(view)

    def recursive(self, translator: Translator, cte: Node, known: dict):
        return recursive_view(self, translator, cte, known)

    def frame(self, text: str) -> DataFrame:
        return self.spark.sql(text)

    # -- SQL --------------------------------------------------------------------------
    def sql(self, query: str, params: list | None = None) -> DataFrame:
        """Run one statement. Queries are lazy; statements with effects act at once."""
        node = parse(query)
        return getattr(self, "_" + node.kind)(node, Translator(self, params))

    def rows(self, query: str, params: list | None = None) -> list[dict]:
        """All rows of a result, for results that fit the driver."""
        return [r.asDict() for r in self.sql(query, params).collect()]

    def stream(self, query: str, params: list | None = None, size: int = 2048):
        """The rows of a result in lists of at most ``size``, a partition at a time."""
        batch: list[dict] = []
        for r in self.sql(query, params).toLocalIterator():
            batch.append(r.asDict())
            if len(batch) == size:
                yield batch
                batch = []
        if batch:
            yield batch

    def text(self, query: str, params: list | None = None) -> str:
        """The Spark SQL that a query compiles to."""
        return Translator(self, params).query(parse(query).query)[0]

    def columns(self, query: str) -> list[tuple[str, str]]:
        """Output names and dialect types of a query."""
        return [(n, type_name(t)) for n, t in Translator(self).query(parse(query).query)[1]]

    def _result(self, query: Node, tr: Translator) -> tuple[DataFrame, list[tuple[str, str]]]:
        text, columns = tr.query(query) if query.kind != "table_ref" else tr.body(query, None, {})
        df = self.spark.sql(text)
        plain = [t in ("interval",) for _, t in columns]
        if any(plain):
            df = df.select(*[F.col(f"`{c}`").cast("string").alias(c) if p else F.col(f"`{c}`") for c, p in zip(df.columns, plain)])
        return df, columns

    def _query(self, node, tr):
        return self._result(node.query, tr)[0]

    def _explain(self, node, tr):
        df, _ = self._result(node.query, tr)
        plan = df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return self.spark.createDataFrame([(line,) for line in plan.split("\n")], "plan string")

    def _describe(self, node, tr):
        _, columns = self.relation(node.table, tr)
        required = {n for n, _, r in self.memory.get(node.table.lower(), (None, []))[1] if r}
        rows = [(n, type_name(t), "NO" if n in required else "YES") for n, t in columns]
        return self.spark.createDataFrame(rows, "column_name string, column_type string, null string")

    def _show(self, node, tr):
        names = sorted({*self.files, *self.memory, *self.views})
        return self.spark.createDataFrame([(n,) for n in names], "name string")

    def _summarize(self, node, tr):
        df, columns = self._result(node.query, tr)
        return summarize(df, {n: type_name(t) for n, t in columns})

    def _copy(self, node, tr):
        df, columns = self._result(node.query, tr)
        count = write_file(df, node.path, node.format, {n for n, t in columns if t == "json"}, bool(node.query.order) if node.query.kind != "table_ref" else False)
        return self._count(count)

    def _count(self, n: int) -> DataFrame:
        return self.spark.createDataFrame([(n,)], "Count bigint")

    # -- tables in memory ---------------------------------------------------------------
    def _free(self, name: str, replace: bool, quiet: bool, view: bool = False) -> bool:
        """Whether ``name`` may be created; False: leave what is there."""
        key = name.lower()
        if key in self.files:
            raise LoomError("DuplicateTable", name)
        if key in self.memory or key in self.views:
            if quiet:
                return False
            if not replace:
                raise LoomError("DuplicateTable", name)
        return True

    def _table(self, name: str) -> tuple[DataFrame, list[tuple[str, str, bool]]]:
        key = name.lower()
        if key in self.files or key in self.views:
            raise LoomError("ReadOnlyTable", name)
        if key not in self.memory:
            raise LoomError("TableNotFound", name)
        return self.memory[key]

    def _store(self, name: str, df: DataFrame, columns: list[tuple[str, str, bool]]) -> None:
        names = [n.lower() for n, _, _ in columns]
        if len(set(names)) < len(names):
            raise LoomError("DuplicateColumn", name)
        required = [n for n, _, r in columns if r]
        df = materialize(df)
        self._complete(name, df, required)
        self.views.pop(name.lower(), None)  # a view that OR REPLACE takes the place of
        self.memory[name.lower()] = (df, columns)

    def _complete(self, name: str, df: DataFrame, required: list[str]) -> None:
        if required and df.where(" or ".join(f"{ident(n)} is null" for n in required)).limit(1).count():
            raise LoomError("NotNullViolation", name)

    def _create_table(self, node, tr):
        if not self._free(node.name, node.replace, node.quiet):
            return self._count(0)
        if node.query is not None:
            df, columns = self._result(node.query, tr)
            self._store(node.name, df, [(n, t, False) for n, t in columns])
            return self._count(self.memory[node.name.lower()][0].count())
        schema = ", ".join(f"{ident(n)} {spark_type(t) if t != 'interval' else 'string'}" for n, t, _ in node.columns)
        self._store(node.name, self.spark.createDataFrame([], schema), node.columns)
        return self._count(0)

    def _create_view(self, node, tr):
        self._free(node.name, node.replace, False)
        tr.query(node.query)  # must bind now
        self.memory.pop(node.name.lower(), None)
        self.views[node.name.lower()] = node.query
        return self._count(0)

    def _drop(self, node, tr):
        kind = self.views if node.view else self.memory
        if node.name.lower() in self.files:
            raise LoomError("ReadOnlyTable", node.name)
        if node.name.lower() not in kind:
            if node.quiet:
                return self._count(0)
            raise LoomError("TableNotFound", node.name)
        del kind[node.name.lower()]
        return self._count(0)

    def _literal(self, e: Node, kind: str, tr: Translator) -> str:
        return cast(tr.expr(e, Scope()), kind).text

    def _alter_add(self, node, tr):
        df, columns = self._table(node.name)
        if node.required and node.default is None and df.limit(1).count():
            raise LoomError("NotNullViolation", node.column)
        value = self._literal(node.default if node.default is not None else Node("null"), node.type, tr)
        if node.column.lower() in {n.lower() for n, _, _ in columns}:
            raise LoomError("DuplicateColumn", node.column)
        self._store(node.name, df.withColumn(node.column, F.expr(value)), [*columns, (node.column, node.type, node.required)])
        return self._count(0)

    def _column_at(self, columns, name: str) -> int:
        for k, (n, _, _) in enumerate(columns):
            if n.lower() == name.lower():
                return k
        raise LoomError("ColumnNotFound", name)

    def _alter_drop(self, node, tr):
        df, columns = self._table(node.name)
        k = self._column_at(columns, node.column)
        self._store(node.name, df.drop(columns[k][0]), columns[:k] + columns[k + 1 :])
        return self._count(0)

    def _alter_column(self, node, tr):
        df, columns = self._table(node.name)
        k = self._column_at(columns, node.column)
        if node.to.lower() in {n.lower() for j, (n, _, _) in enumerate(columns) if j != k}:
            raise LoomError("DuplicateColumn", node.to)
        self._store(node.name, df.withColumnRenamed(columns[k][0], node.to), [*columns[:k], (node.to, *columns[k][1:]), *columns[k + 1 :]])
        return self._count(0)

    def _alter_rename(self, node, tr):
        self._table(node.name)
        self._free(node.to, False, False)
        self.memory[node.to.lower()] = self.memory.pop(node.name.lower())
        return self._count(0)

    def _insert(self, node, tr):
        df, columns = self._table(node.name)
        chosen = [columns[self._column_at(columns, c)] for c in node.columns] if node.columns else columns
        if node.rows is not None:
            parts = []
            for row in node.rows:
                if len(row) != len(chosen):
                    raise LoomError("ColumnCountMismatch", node.name)
                parts.append("select " + ", ".join(f"{self._literal(e, t, tr)} as {ident(n)}" for e, (n, t, _) in zip(row, chosen)))
            new = self.spark.sql(" union all ".join(parts))
        else:
            source, have = self._result(node.query, tr)
            if len(have) != len(chosen):
                raise LoomError("ColumnCountMismatch", node.name)
            new = source.toDF(*[f"_{k}" for k in range(len(have))])
            new = new.selectExpr(*[f"{cast(Sql(f'_{k}', a), t).text} as {ident(n)}" for k, ((_, a), (n, t, _)) in enumerate(zip(have, chosen))])
        given = {n for n, _, _ in chosen}
        new = new.selectExpr(*[ident(n) if n in given else f"cast(null as {spark_type(t)}) as {ident(n)}" for n, t, _ in columns])
        new = materialize(new)
        self._complete(node.name, new, [n for n, _, r in columns if r])
        count = new.count()
        key, whole = node.name.lower(), df.unionByName(new)
        self.parts[key] = self.parts.get(key, 0) + 1
        if self.parts[key] % PARTS == 0:  # few files to read, however many statements
            whole = materialize(whole)
        self.memory[key] = (whole, columns)
        return self._count(count)

    def _changes(self, node, tr, df, columns):
        view, _ = self._view(df, {})
        scope = Scope([_relation(node.name, columns)])
        test = f"coalesce({tr.expr(node.where, scope).text}, false)" if node.where is not None else "true"
        return f"{view} as {ident(node.name)}", scope, test

    def _update(self, node, tr):
        df, columns = self._table(node.name)
        source, scope, test = self._changes(node, tr, df, columns)
        new = {}
        for name, e in node.sets:
            n, t, _ = columns[self._column_at(columns, name)]
            new[n] = cast(tr.expr(e, scope), t).text
        items = [f"case when {test} then {new[n]} else {ident(n)} end as {ident(n)}" if n in new else ident(n) for n, _, _ in columns]
        count = self.spark.sql(f"select count(*) from {source} where {test}").first()[0]
        self._store(node.name, self.spark.sql(f"select {', '.join(items)} from {source}"), columns)
        return self._count(count)

    def _delete(self, node, tr):
        df, columns = self._table(node.name)
        source, _, test = self._changes(node, tr, df, columns)
        count = self.spark.sql(f"select count(*) from {source} where {test}").first()[0]
        self._store(node.name, self.spark.sql(f"select * from {source} where not {test}"), columns)
        return self._count(count)


def _relation(name: str, columns):
    from .plans.translator import Relation

    return Relation(name, [(n, t) for n, t, _ in columns])
