from pyspark.sql import functions as F

from ripplescope.plans import bindings, queries
from ripplescope.sources import coverage

from .conftest import rows


def test_tasks_grow_with_the_table(spark):
    assert [bindings.tasks_for(spark.range(n), 10) for n in (0, 9, 10, 95)] == [1, 1, 2, 10]


def test_hotspots_tasks_follow_the_lines(spark, tmp_path, monkeypatch):
    asked = []
    monkeypatch.setattr(queries, "tasks_for", lambda df, n: asked.append(df.count()) or 3)
    spark.range(40).select((F.col("id") % 8).alias("l_orderkey"), F.col("id").alias("l_suppkey")).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(5).withColumnRenamed("id", "o_orderkey").write.parquet(str(tmp_path / "orders.parquet"))
    assert rows(queries.QUERIES["hotspots"](spark, str(tmp_path))) == [(i, 5, 5, 10) for i in range(5)] and asked == [40]


def test_istanbul_statements_meet_by_file_before_lines_are_made(spark):
    text = '{"/r/a.ts": {"statementMap": {"0": {"start": {"line": 1}, "end": {"line": 3}}, "1": {"start": {"line": 3}}}, "s": {"0": 2, "1": 5}}}'
    found = coverage.istanbul_lines(spark.createDataFrame([("head", text), ("base", text)], "tree string, text string"), "/r", 5)
    assert found.rdd.getNumPartitions() == 5
    assert rows(found) == [(t, "a.ts", line, hits) for t in ("base", "head") for line, hits in ((1, 2), (2, 2), (3, 5))]
    constant = coverage.istanbul_lines(spark.createDataFrame([(text,)], "text string").select(F.lit("head").alias("tree"), "text"), "/r", 5)
    assert constant.rdd.getNumPartitions() == 5 and constant.count() == 3


def test_lcov_records_meet_by_file_once(spark):
    texts = [("SF:/r/a.ts\nDA:1,9\nend_of_record\nSF:/r/b.ts\nDA:2,1\nSF:/r/a.ts\nDA:1,3\nDA:4,0",)]
    found = coverage.lcov_lines(spark.createDataFrame(texts, "text string").select(F.lit("head").alias("tree"), "text"), "/r", 5)
    assert found.rdd.getNumPartitions() == 5
    assert rows(found) == [("head", "a.ts", 1, 3), ("head", "a.ts", 4, 0), ("head", "b.ts", 2, 1)]
