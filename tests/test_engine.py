"""Statements, sources, sinks and errors of the engine."""

import pytest

from sparkloom import Engine, LoomError


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark)


def rows(df):
    return [tuple(r) for r in df.collect()]


def code(f, *args):
    with pytest.raises(LoomError) as e:
        f(*args)
    return e.value.code


def test_tables_in_memory(engine):
    q = engine.sql
    q("CREATE TABLE t (a INTEGER NOT NULL, b VARCHAR)")
    assert rows(q("INSERT INTO t VALUES (1, 'x'), (2, NULL), ('3', 'z')")) == [(3,)]
    assert rows(q("SELECT * FROM t ORDER BY a")) == [(1, "x"), (2, None), (3, "z")]
    assert rows(q("UPDATE t SET b = 'q', a = a + 10 WHERE b <> 'x'")) == [(1,)]
    assert rows(q("DELETE FROM t WHERE b IS NULL")) == [(1,)]
    assert rows(q("SELECT a, b FROM t ORDER BY a")) == [(1, "x"), (13, "q")]
    q("ALTER TABLE t ADD COLUMN c DOUBLE DEFAULT 1.5")
    q("ALTER TABLE t RENAME COLUMN b TO name")
    q("ALTER TABLE t DROP COLUMN c")
    q("ALTER TABLE t RENAME TO u")
    assert rows(q("DESCRIBE u")) == [("a", "INTEGER", "NO"), ("name", "VARCHAR", "YES")]
    assert code(q, "INSERT INTO u (name) VALUES ('no a')") == "NotNullViolation"
    assert rows(q("SELECT count(*) FROM u")) == [(2,)]
    assert code(q, "CREATE TABLE u AS SELECT 1 AS x") == "DuplicateTable"
    q("CREATE OR REPLACE TABLE u AS SELECT a * 2 AS d FROM u")
    assert rows(q("SELECT d FROM u ORDER BY d")) == [(2,), (26,)]
    q("DROP TABLE u")
    assert code(q, "SELECT * FROM u") == "TableNotFound"


def test_views_are_bound_each_time(engine):
    q = engine.sql
    q("CREATE TABLE base AS SELECT 1 AS x")
    q("CREATE VIEW v AS SELECT x + 1 AS y FROM base")
    q("INSERT INTO base VALUES (5)")
    assert rows(q("SELECT y FROM v ORDER BY y")) == [(2,), (6,)]
    assert ("v",) in rows(q("SHOW TABLES"))
    q("DROP VIEW v")
    q("DROP TABLE base")


def test_parameters_and_semantics(engine):
    q = engine.sql
    assert rows(q("SELECT ? + 1 AS a, ? AS b, ? AS c", [41, "it's", None])) == [(42, "it's", None)]
    assert rows(q("SELECT 7 / 2 AS i, 7 % 0 AS z, -1::VARCHAR AS s, CAST('1e2' AS DOUBLE) AS d, 'a\\b' LIKE 'a\\b' AS l")) == [(3, None, "-1", 100.0, True)]
    assert rows(q("SELECT substr('hello', 0, 3) AS a, substr('hello', -3, 2) AS b, left('hello', -2) AS c, split_part('a.b', '.', 0) AS d")) == [("he", "ll", "hel", "")]
    assert rows(q("SELECT CAST('nan' AS DOUBLE) = CAST('nan' AS DOUBLE) AS e, CAST('nan' AS DOUBLE) <> 1.0 AS n")) == [(False, True)]
    assert rows(q("SELECT json_extract('{\"a\": [1, {\"b\": \"x\"}]}', '$.a[-1].b') AS j, '[1, 2]'::JSON || [3] AS l")) == [('"x"', "[1,2,3]")]
    assert rows(q("SELECT list_sort(['b', 2, NULL, true]) AS s, map_extract('{\"k\": 7}'::JSON, 'k') AS m, list_reduce([1, 2], (a, x) -> a * x, 10) AS r")) == [('[2,"b",true,null]', "7", "20")]
    assert rows(q("SELECT regexp_replace('aXbX', 'X', '-') AS f, regexp_replace('aXbX', '(X)', '<\\1>', 'g') AS g")) == [("a-bX", "a<X>b<X>")]


def test_errors(engine):
    q = engine.sql
    q("CREATE TABLE e AS SELECT 1 AS a, 'x' AS b")
    assert code(q, "SELECT nope FROM e") == "ColumnNotFound"
    assert code(q, "SELECT a + b FROM e") == "TypeMismatch"
    assert code(q, "SELECT nofunc(a) FROM e") == "FunctionNotFound"
    assert code(q, "SELECT upper() FROM e") == "WrongArgCount"
    assert code(q, "SELECT a FROM e, (SELECT 1 AS a) f") == "AmbiguousColumn"
    assert code(q, "SELECT a FROM e UNION SELECT a, b FROM e") == "ColumnCountMismatch"
    assert code(q, "SELEC 1") == "SyntaxError"
    assert code(q, "SELECT range FROM range(1, 2, 0)") == "DivideByZero"
    q("DROP TABLE e")


def test_round_trip_files(engine, tmp_path):
    q = engine.sql
    q("CREATE TABLE src AS SELECT range AS id, CASE WHEN range % 2 = 0 THEN 'a,\"' || range END AS s, range * 0.5 AS d, json_array(range, 'x') AS j FROM range(5)")
    want = rows(q("SELECT id, s, CAST(d AS DOUBLE) AS d FROM src ORDER BY id"))
    for kind in ("parquet", "csv", "tsv", "jsonl"):
        path = f"{tmp_path}/out.{kind}"
        assert rows(q(f"COPY (SELECT id, s, CAST(d AS DOUBLE) AS d, j FROM src) TO '{path}'")) == [(5,)]
        assert rows(q(f"SELECT id, s, CAST(d AS DOUBLE) AS d FROM '{path}' ORDER BY id")) == want, kind
    assert rows(q(f"SELECT j FROM '{tmp_path}/out.jsonl' WHERE id = 2")) == [('[2,"x"]',)]
    q("DROP TABLE src")


def test_csv_and_json_rules(engine, tmp_path):
    (tmp_path / "q.csv").write_text('a,b,c\n1,"x ""y""\nz",1.5\n2,"",\n')
    assert rows(engine.sql(f"SELECT * FROM read_csv('{tmp_path}/q.csv') ORDER BY a")) == [(1, 'x "y"\nz', 1.5), (2, "", None)]
    (tmp_path / "p.csv").write_text('a,b\n1,"x, y"\n2,\n,""\n')
    assert rows(engine.sql(f"SELECT * FROM '{tmp_path}/p.csv' ORDER BY a")) == [(1, "x, y"), (2, None), (None, "")]
    (tmp_path / "d.json").write_text('[{"id": 1, "tags": ["a", 1], "n": {"k": 2}}, {"id": 2, "x": true}]')
    assert rows(engine.sql(f"SELECT id, tags, n, x FROM '{tmp_path}/d.json' ORDER BY id")) == [(1, '["a", 1]', '{"k": 2}', None), (2, None, None, True)]
    (tmp_path / "l.jsonl").write_text("".join(f'{{"id": {k}, "v": {k}}}\n' for k in range(1200)) + '{"id": 1200, "v": "late", "new": [1,  2]}\n')
    engine.register("early", f"{tmp_path}/l.jsonl")
    assert [n for n, _ in engine.columns("SELECT * FROM early")] == ["id", "v"]
    assert rows(engine.sql("SELECT v FROM early WHERE id = 1200")) == [(None,)]
    engine.register("every", f"{tmp_path}/l.jsonl", sample=None)
    assert rows(engine.sql("SELECT * FROM every WHERE id = 1200")) == [(1200, "late", "[1,  2]")]
    (tmp_path / "l.csv").write_text("a\n" + "1\n" * 1200 + "x\n")
    engine.register("late", f"{tmp_path}/l.csv", sample=None)
    assert rows(engine.sql("SELECT count(a) AS n, max(a) AS m FROM late")) == [(1201, "x")]
    (tmp_path / "s.json").write_text("[1, 2, 3]")
    assert len(rows(engine.sql(f"SELECT json FROM '{tmp_path}/s.json'"))) == 3


def test_nested_hive_and_many_files(engine, spark, tmp_path):
    nested = spark.sql("select 1 as id, named_struct('city', 'X', 'zip', 7) as address, array(1, null) as xs, map('k', 2) as m")
    engine.register_frame("nested", nested)
    assert [n for n, _ in engine.columns("SELECT * FROM nested")] == ["id", "address.city", "address.zip", "xs", "m"]
    assert rows(engine.sql("SELECT address.city, xs, m FROM nested")) == [("X", "[1,null]", '[{"key":"k","value":2}]')]
    spark.range(6).selectExpr("id", "id % 2 as part").write.partitionBy("part").parquet(f"{tmp_path}/hive")
    engine.register("hive", f"{tmp_path}/hive")
    assert rows(engine.sql("SELECT part, count(*) FROM hive GROUP BY part ORDER BY part")) == [(0, 3), (1, 3)]
    for k in range(2):
        spark.range(k, k + 2).write.parquet(f"{tmp_path}/m{k}.parquet")
    engine.register("many", f"{tmp_path}/m0.parquet", f"{tmp_path}/m1.parquet")
    assert rows(engine.sql("SELECT sum(id) FROM many"))[0][0] == 4
    spark.range(2).selectExpr("id as other").write.parquet(f"{tmp_path}/m2.parquet")
    assert code(engine.register, "bad", f"{tmp_path}/m0.parquet", f"{tmp_path}/m2.parquet") == "TypeMismatch"


def test_summarize_explain(engine):
    engine.sql("CREATE TABLE s AS SELECT range AS n FROM range(101)")
    (r,) = engine.sql("SUMMARIZE s").collect()
    assert (r.column_name, r.column_type, r["min"], r["max"], r.q50, r["count"]) == ("n", "BIGINT", "0", "100", 50.0, 101)
    assert any("Range" in line or "Scan" in line for (line,) in rows(engine.sql("EXPLAIN SELECT n FROM s WHERE n > 5")))
    engine.sql("DROP TABLE s")


def test_filters_reach_the_scan(engine):
    engine.register("li", "/root/testdata/sf0.001/lineitem.parquet")
    plan = "\n".join(line for (line,) in rows(engine.sql("EXPLAIN SELECT l_orderkey FROM li WHERE l_quantity > 40.0 AND l_linenumber = 2")))
    assert "PushedFilters: [" in plan and "EqualTo(l_linenumber,2)" in plan
    assert "l_comment" not in plan and "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double>" in plan


def test_recursion(engine):
    assert rows(engine.sql("WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 300) SELECT count(*), max(n) FROM t")) == [(300, 300)]
    got = rows(engine.sql("WITH RECURSIVE t(n) AS (SELECT 0 UNION SELECT (n + 7) % 12 FROM t) SELECT count(*) FROM t"))
    assert got == [(12,)]


def test_rows_stream_and_formats(engine):
    from sparkloom.cli import render

    assert engine.rows("SELECT 1 AS a, NULL AS b") == [{"a": 1, "b": None}]
    assert [len(b) for b in engine.stream("SELECT range FROM range(5)", size=2)] == [2, 2, 1]
    names, data = ["a", "b"], [(1, "x,y"), (None, "it's")]
    assert render(names, data, "csv") == 'a,b\n1,"x,y"\n,it\'s\n'
    assert render(names, data, "insert").splitlines()[1] == "INSERT INTO \"table\" VALUES(NULL,'it''s');"
    assert render(names, data, "markdown").splitlines()[:2] == ["| a | b    |", "|---|------|"]
    assert render(names, data, "jsonlines").splitlines()[0] == '{"a": 1, "b": "x,y"}'
    assert render(names, data, "list") == "a|b\n1|x,y\n|it's\n" and render(names, data, "trash") == ""


def test_globs(engine, spark, tmp_path):
    for k in range(3):
        spark.range(2).write.parquet(f"{tmp_path}/d{k}/deep{k}/f.parquet")
    assert engine.rows(f"SELECT count(*) AS n FROM '{tmp_path}/*/*/f.parquet'") == [{"n": 6}]
    assert engine.rows(f"SELECT count(*) AS n FROM '{tmp_path}/**/*.parquet'") == [{"n": 6}]


def test_arg_of_equal_keys_is_the_first_rows(engine, spark, tmp_path):
    def part(path, *values):
        spark.createDataFrame([(k, v, x, {"n": k}) for k, v, x in values], "k int, v string, x double, m map<string,int>").coalesce(1).write.parquet(f"{tmp_path}/{path}")

    part("t/a.parquet", (1, "b", 2.0), (1, "a", 2.0), (1, "c", 2.0), (1, "d", 1.0), (1, "e", 1.0), (2, None, 9.0), (2, "z", 9.0), (2, "y", None))
    text = "SELECT k, arg_max(v, x) AS hi, arg_min(v, x) AS lo FROM {} GROUP BY k ORDER BY k"
    want = [(1, "b", "d"), (2, "z", "z")]
    engine.register("ties", f"{tmp_path}/t/a.parquet")
    assert rows(engine.sql(text.format("ties"))) == want
    assert rows(engine.sql(text.format("ties AS x"))) == want
    assert rows(engine.sql(text.format(f"'{tmp_path}/t/a.parquet'"))) == want
    assert rows(engine.sql("SELECT arg_max(v, x) AS hi, max_by(v, x) FILTER (WHERE v > 'b') AS f FROM ties WHERE k = 1")) == [("b", "c")]
    assert rows(engine.sql("SELECT k FROM ties GROUP BY k HAVING arg_max(v, x) = 'b'")) == [(1,)]
    assert rows(engine.sql("SELECT k, arg_max(v, x) AS hi FROM ties GROUP BY GROUPING SETS ((k), ()) ORDER BY k")) == [(1, "b"), (2, "z"), (None, "z")]
    # Spark reads large files first, and the order of names is the files' order.
    part("t/b.parquet", *[(1, f"w{j}", 2.0) for j in range(3000)])
    engine.register("two", f"{tmp_path}/t/*.parquet")
    assert rows(engine.sql(text.format("two"))) == want
    engine.register("listed", f"{tmp_path}/t/b.parquet", f"{tmp_path}/t/a.parquet")
    assert rows(engine.sql(text.format("listed"))) == [(1, "w0", "d"), (2, "z", "z")]
    assert [n for n, _ in engine.columns("SELECT * FROM ties")] == ["k", "v", "x", "m"]


def test_double_text_is_the_shortest(engine, spark):
    values = [5.9035e20, 5.9041e20, 1e23, 2e23, 4.73e21, 1.2225760738274004e18, 2.1909452266626132e18, -5.8824334018909e17, 1.9650714483381724e25, 2.0**129, 2.0**-921, 5e-324, 8e-323, 1.012e-320]
    values += [0.1, -0.0, 1e15, 1e16, 9007199254740993.0, 1.7976931348623157e308, 2.2250738585072014e-308, 1.2345678901234567e-4, float("inf"), None]
    engine.register_frame("doubles", spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double"))
    got = [t for _, t in rows(engine.sql("SELECT k, CAST(v AS VARCHAR) AS t FROM doubles ORDER BY k"))]
    assert got == [None if v is None else repr(v) for v in values]
    assert rows(engine.sql("SELECT CAST(CAST('nan' AS DOUBLE) AS VARCHAR) AS n")) == [("nan",)]
