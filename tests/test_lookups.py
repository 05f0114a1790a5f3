"""Id lists of any length, the query guard, and the hash sample."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinwatch.functions import scalars, shared
from skeinwatch.operators import evaluate, profile, traces
from skeinwatch.sources import tables


def test_long_id_lists_are_joined_behind_pushed_bounds(spark):
    path = shared.new_folder(spark, "ids")
    hexed = F.lpad(F.lower(F.hex("id")), 32, "0")
    spark.range(300_000).select(F.unhex(hexed).alias("trace_id"), "id").write.parquet(path)
    held = spark.read.parquet(path)
    asked = [f"{i:032X}" for i in range(100_000, 200_000)]
    got = traces.with_ids(held, asked)
    plan = got._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(trace_id" in plan.split("PushedFilters")[1] and "LeftSemi" in plan and len(plan) < 20_000
    assert got.agg(F.count("*"), F.min("id"), F.max("id")).first()[:] == (100_000, 100_000, 199_999)
    few = traces.with_ids(held, asked[:3])
    assert "LeftSemi" not in few._jdf.queryExecution().toString() and [r["id"] for r in few.orderBy("id").collect()] == [100_000, 100_001, 100_002]
    table = spark.range(10, 400_000, 100_000).select(hexed.alias("trace_id"), F.lit("x").alias("id"))
    assert sorted(r["id"] for r in traces.with_ids(held, table).collect()) == [10, 100_010, 200_010]
    assert traces.with_ids(held, []).count() == traces.with_ids(held, table.where("false")).count() == 0
    numbers = spark.range(1000).withColumnRenamed("id", "trace_id")
    assert traces.trace_filters(numbers, trace_ids=list(range(5, 900))).count() == 895


@pytest.mark.parametrize(
    "sql",
    ["SELECT 1 AS a, 'x' AS set FROM range(1)", "SELECT id AS cache FROM range(2) t", "WITH drop AS (SELECT 1 AS x) SELECT x FROM drop;", "SELECT ';' AS a -- ; DROP TABLE x", "select 1 /* insert into y */"],
)
def test_queries_that_only_read(spark, sql):
    rows, more = tables.query(spark, sql)
    assert rows.count() >= 1 and not more


@pytest.mark.parametrize(
    "sql",
    ["DROP TABLE x", "SELECT 1; SELECT 2", "INSERT INTO x SELECT 1", "WITH a AS (SELECT 1) INSERT INTO x SELECT * FROM a", "SET a = 1", "CREATE TABLE t AS SELECT 1", "CACHE TABLE x",
     "SHOW TABLES", "BEGIN SELECT 1; END", "EXECUTE IMMEDIATE 'DROP TABLE x'", "FROM x INSERT INTO y SELECT 1", "", "SELEC 1"],
)
def test_statements_that_do_more(spark, sql):
    with pytest.raises(ValueError):
        tables.query(spark, sql)


def test_a_sample_is_the_same_each_time_and_of_its_size(spark):
    df = spark.range(50_000).withColumn("key", F.col("id").cast("string"))
    once, again = ({r["id"] for r in scalars.sample_records(d, 0.1, "key").collect()} for d in (df, df.repartition(7).orderBy(F.desc("id"))))
    assert once == again and abs(len(once) - 5000) < 300
    wider = {r["id"] for r in scalars.sample_records(df, 0.3, "key").collect()}
    assert once < wider
    assert scalars.sample_records(df, 0.0, "key").count() == 0 and scalars.sample_records(df, 1.0, "key").count() == 50_000
    assert scalars.sample_records(df.withColumn("key", F.lit(None).cast("string")), 1.0, "key").count() == 50_000


def test_the_result_matrix_holds_embedding_scores(spark):
    rows = spark.createDataFrame([(i, "t", i % 2 == 0) for i in range(30)], "record_id long, task_id string, passed boolean")
    vectors = [(i, [1.0 * i, 1.0, -2.0], [1.0, 0.5 * i, 0.0]) for i in range(20)]
    held = spark.createDataFrame([*vectors, (20, [1.0], [1.0, 2.0])], "record_id long, a array<double>, b array<double>")
    matrix = evaluate.result_matrix(rows, ["t"], embeddings=held, targets=["a", "b"])
    assert matrix.columns == ["record_id", "t", "a_mean", "b_mean", "a_b_cosine", "b_a_cosine"]
    got = {r["record_id"]: r for r in matrix.collect()}
    cosine = [np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) for _, a, b in vectors]
    for i, (_, a, b) in enumerate(vectors):
        assert got[i]["a_mean"] == pytest.approx(np.mean(a)) and got[i]["b_mean"] == pytest.approx(np.mean(b)) and got[i]["a_b_cosine"] == pytest.approx(cosine[i])
    assert got[20]["a_b_cosine"] is None and got[25]["a_mean"] is None and got[24]["t"] == 1
    bins = profile.histogram(matrix, ["a_b_cosine"], 5).orderBy("bin").collect()
    assert [r["count"] for r in bins] == np.histogram(cosine, 5)[0].tolist()
