from sparkloom import Engine
from sparkloom.streaming import run_on_batches


def test_micro_batches(spark, tmp_path):
    spark.range(10).selectExpr("id", "id % 3 as k").repartition(2).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, k long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = []
    query = run_on_batches(Engine(spark), stream, "s", "SELECT k, count(*) AS n FROM s GROUP BY k", lambda df, n: got.append({r.k: r.n for r in df.collect()}), f"{tmp_path}/cp")
    query.awaitTermination(120)
    assert len(got) == 2 and sum(sum(b.values()) for b in got) == 10
