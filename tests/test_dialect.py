import datetime as dt

import pytest

from quillon.operators.query import Query, QueryError
from quillon.plans import dialect, strict


def one(spark, sql, args=None):
    return dialect.run(spark, sql, args).first()[0]


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        ("SELECT 7 \\ -2 AS `v`", -3), ("SELECT 2 + 3 * 4 AS `v`", 14), ("SELECT 2 ^ 3 ^ 1 AS `v`", 8), ("SELECT 10 MOD 4 + 1 AS `v`", 3), ("SELECT 6 BXOR 5 AS `v`", 3), ("SELECT BNOT 5 AS `v`", -6),
        ("SELECT 'a' & NULL & 'b' AS `v`", "ab"), ("SELECT IIF(NULL = 1, 'y', 'n') AS `v`", "n"), ("SELECT 'it''s' AS `v`", "it's"), ("SELECT 'a\\b' AS `v`", "a\\b"), ("SELECT LEN('abc') AS `v`", 3),
        ("SELECT INSTR(1, 'Hello', 'L', 1) AS `v`", 3), ("SELECT INSTR('Hello', 'l') AS `v`", 3), ("SELECT INSTR(1, 'Hello', 'L', 0) AS `v`", 0), ("SELECT FIX(-2.5) AS `v`", -2), ("SELECT INT(-2.5) AS `v`", -3), ("SELECT CLNG(2.5) AS `v`", 2),
        ("SELECT DATEDIFF('m', #2024-01-31#, #2024-02-01#) AS `v`", 1), ("SELECT DATEPART('w', #2024-01-07#) AS `v`", 1), ("SELECT TIMEVALUE('12:30:00') AS `v`", 45000), ("SELECT #2024-01-02# AS `v`", dt.date(2024, 1, 2)),
        ("SELECT '50%' LIKE '50[%]' AS `v`", True), ("SELECT '50x' LIKE '50[%]' AS `v`", False), ("SELECT NOT 1 = 1 OR TRUE AS `v`", True), ("SELECT CASE 2 WHEN 1 THEN 'a' WHEN 2 THEN 'b' ELSE 'c' END AS `v`", "b"), ("SELECT 3 IN (1, 2, 3) AS `v`", True),
        ("SELECT ISDATE('junk') AS `v`", False), ("SELECT -2 ^ 2 AS `v`", -4), ("SELECT SWITCH(1 = 2, 'a', TRUE, 'b') AS `v`", "b"), ("SELECT 0x4142 = 0x4142 AS `v`", True),
    ],
)
def test_expressions(spark, sql, want):
    assert one(spark, sql) == want


def test_parameters(spark):
    assert one(spark, "SELECT @a + @b AS `v`", {"a": 1, "b": 2}) == 3 and one(spark, "SELECT ? & ? AS `v`", ["x", None]) == "x"
    assert one(spark, "SELECT 1 IN (@list) AS `v`", {"list": [1, 2]}) is True and one(spark, "SELECT 1 IN (@list) AS `v`", {"list": []}) is None
    with pytest.raises(dialect.DialectError):
        dialect.translate("SELECT @missing AS `v`", {})


def test_top_is_a_constant(spark):
    spark.range(10).createOrReplaceTempView("ten")
    ids = lambda sql, args=None: [r[0] for r in dialect.run(spark, sql, args).collect()]
    assert ids("SELECT TOP 1+2 `id` FROM `ten` ORDER BY `id` DESC") == [9, 8, 7]
    assert ids("SELECT TOP @n `id` FROM `ten` ORDER BY `id` SKIP 4", {"n": 2}) == [4, 5] and ids("SELECT TOP 0 `id` FROM `ten`") == []
    with pytest.raises(dialect.DialectError):
        dialect.translate("SELECT TOP @n `id` FROM `ten`", {"n": -1})


def test_batches_split_outside_quotes():
    assert dialect.split_batch("SELECT 'a;b' AS `x;y`; -- c;\n SELECT 2;\n-- SELECT 3;\n") == ["SELECT 'a;b' AS `x;y`", "-- c;\n SELECT 2"] or len(dialect.split_batch("SELECT 'a;b' AS `x;y`; SELECT 2;")) == 2
    assert dialect.split_condition("IF NOT EXISTS (SELECT 1 FROM `t` WHERE (`a` = 1)) THEN DROP TABLE `t`") == (False, "SELECT 1 FROM `t` WHERE (`a` = 1)", "DROP TABLE `t`")
    assert dialect.split_condition("SELECT 1") is None


def test_errors():
    for sql in ("SELECT", "SELECT 1 FROM", "SELECT (1", "SELECT 1 2 3", "SELECT @@identity AS `v`"):
        with pytest.raises(dialect.DialectError):
            dialect.translate(sql)


@pytest.mark.parametrize("sql", ["SELECT 1 INTERSECT SELECT 2", "SELECT a FROM t CROSS APPLY u", "SELECT ROW_NUMBER() OVER (ORDER BY a) FROM t", "SELECT COUNT(DISTINCT a) FROM t", "SELECT 1 << 2"])
def test_strict_mode_refuses(sql):
    with pytest.raises(QueryError):
        strict.check(sql)


def test_strict_mode_ignores_quoted_text():
    strict.check("SELECT 'a INTERSECT b' AS `EXCEPT`")


def test_query_refusals(spark):
    q = Query(spark.range(3))
    for bad in (lambda: q.last(), lambda: q.take(-1), lambda: q.skip(True), lambda: q.then_by("id"), lambda: Query.sql(spark, " WITH x AS (SELECT 1) SELECT * FROM x"), lambda: q.single()):
        with pytest.raises(QueryError):
            bad()
    assert q.where("id = 7").single().df.count() == 0 and q.where("id > 5").default_if_empty(spark).df.collect()[0].id is None
    assert [r.id for r in q.order_by("id").skip(2).take(5).df.collect()] == [2] and q.all(q.df.id >= 0).df.first().value is True
    assert q.where("id > 5").all(q.df.id > 99).df.first().value is True and q.contains("id", None).df.first().value is False
