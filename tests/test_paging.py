"""A skip without a take passes its rows through many tasks, and gives what OFFSET gives."""

import pytest
from pyspark.sql import functions as F

from quillon.operators.paging import rows_after
from quillon.operators.query import Query
from quillon.plans import catalogue, dialect
from quillon.plans.dialect import translate


@pytest.fixture
def many_parts(spark):
    """Tables this small would be put together in one partition."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_no_task_holds_the_whole_page(spark, many_parts):
    """F2 of round 3: OFFSET passed all rows through one task."""
    spark.range(40_000).select(((F.col("id") * 7919) % 40_000).alias("id")).createOrReplaceTempView("many")
    pages = [dialect.run(spark, "SELECT `id` FROM `many` ORDER BY `id` SKIP 14"), Query(spark.table("many")).order_by("id").skip(14).df]
    for page in pages:
        assert [r.id for r in page.collect()] == list(range(14, 40_000))
        sizes = [r["count"] for r in page.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) > 2 and max(sizes) < 20_000
    for name in ("dialect_skip", "skip_only"):
        assert catalogue.queries()[name](spark, "/root/testdata/sf0.1").rdd.getNumPartitions() > 1


def test_pages_of_any_length(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").alias("place__")).orderBy("k", F.desc("place__"))
    want = [tuple(r) for r in df.collect()]
    for n in (0, 1, 33, 34, 66, 67, 99, 100, 10**12):
        page = rows_after(df, n)
        assert [tuple(r) for r in page.collect()] == want[n:] and page.columns == ["k", "place__"]
    assert rows_after(spark.range(0), 3).count() == 0
    twice = rows_after(df.select("k", "k").orderBy("k"), 90)
    assert [tuple(r) for r in twice.collect()] == [(2, 2)] * 10


def test_dialect_skips_where_the_statement_ends(spark):
    spark.range(10).createOrReplaceTempView("ten")
    ids = lambda sql, args=None: [r[0] for r in dialect.run(spark, sql, args).collect()]
    assert ids("SELECT `id` FROM `ten` ORDER BY `id` DESC SKIP @n", {"n": 7}) == [2, 1, 0] and ids("SELECT -`id` AS `v` FROM `ten` ORDER BY `id` SKIP 8;") == [-8, -9]
    assert ids("SELECT TOP 2 `id` FROM `ten` ORDER BY `id` SKIP 7") == [7, 8] and len(ids("SELECT `id` FROM `ten` SKIP 4")) == 6 and len(ids("SELECT `id` FROM `ten` SKIP 0")) == 10
    assert ids("SELECT `id` FROM `ten` WHERE `id` IN (SELECT `id` FROM `ten` ORDER BY `id` SKIP 6) ORDER BY `id` SKIP 1") == [7, 8, 9]
    assert sorted(ids("SELECT `id` FROM (SELECT `id` FROM `ten` ORDER BY `id` SKIP 6) AS `x`")) == [6, 7, 8, 9]
    assert ids("SELECT `id` FROM `ten` UNION SELECT 10 + `id` FROM `ten` ORDER BY `id` SKIP 17") == [17, 18, 19]
    assert translate("SELECT `id` FROM `ten` ORDER BY `id` SKIP 3").endswith(" OFFSET 3")


def test_steps_after_a_skip(spark):
    q = Query(spark.range(10)).alias("o").order_by("o.id").skip(4)
    assert [r.id for r in q.where("o.id % 2 = 1").df.collect()] == [5, 7, 9] and q.count().df.first().value == 6
    assert [r.id for r in q.skip(3).df.collect()] == [7, 8, 9] and [r.v for r in q.select(v=F.col("o.id")).df.collect()] == [4, 5, 6, 7, 8, 9]
    assert [r.id for r in q.order_by_desc("id").take(2).df.collect()] == [9, 8] and [r.id for r in q.take(2).df.collect()] == [4, 5]
    assert [r.id for r in q.skip(2).take(2).df.collect()] == [6, 7] and q.element_at(1).df.first().id == 5
