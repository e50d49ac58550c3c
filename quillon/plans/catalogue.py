"""Registered queries and the SQL that gives the same rows.

A query reads the tables it needs from ``sf_dir``; every computed column has a name. Sums of doubles are rounded, as their last digits depend on the
order of addition.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import binary, convert, logic, stats, temporal, text
from quillon.functions import math as m
from quillon.operators import model
from quillon.operators.query import Query, prepared
from quillon.plans import dialect
from quillon.sources.files import read_table

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder. Two of the same session and folder are equal, so prepared queries find their plans."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Tables) and (self.spark, self.sf_dir) == (other.spark, other.sf_dir)

    def __hash__(self) -> int:
        return hash((id(self.spark), self.sf_dir))

    def __getattr__(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    def q(self, name: str) -> Query:
        return Query(getattr(self, name))


def query(sql: str | None = None):
    def add(f: Callable[[Tables], DataFrame | Query]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(Tables(spark, sf_dir))
            return out.df if isinstance(out, Query) else out

        _QUERIES[f.__name__] = run
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def in_dialect(name: str, text_: str, sql: str, *tables: str, args: dict | list | None = None) -> None:
    """A query written in the dialect."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return dialect.run(spark, text_, args, **{t: read_table(spark, sf_dir, t) for t in tables})

    _QUERIES[name], _SQL[name] = run, sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from quillon.plans import catalogue_more  # noqa: F401  registers its queries

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from quillon.plans import catalogue_more  # noqa: F401

    return dict(_SQL)


c = F.col
DAY = dt.datetime(1998, 9, 2)


# projection, filters, predicates


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base,
 round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 6) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
 FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(t: Tables):
    rows = t.q("lineitem").where(c("l_shipdate") <= F.lit(DAY))
    return rows.group_by("l_returnflag", "l_linestatus").aggregate(
        sum_qty=F.round(stats.total(c("l_quantity")), 2), sum_base=F.round(stats.total(c("l_extendedprice")), 2),
        sum_disc=F.round(stats.total(c("l_extendedprice") * (1 - c("l_discount"))), 2),
        avg_qty=F.round(stats.average(c("l_quantity")), 6), avg_disc=F.round(stats.average(c("l_discount")), 6), n=stats.count(),
    )


@query("SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 1000 AND c_acctbal <= 5000 AND NOT c_mktsegment = 'BUILDING' OR c_custkey < 5")
def where_compare(t: Tables):
    return t.q("customer").where((c("c_acctbal") > 1000) & (c("c_acctbal") <= 5000) & ~(c("c_mktsegment") == "BUILDING") | (c("c_custkey") < 5)).select("c_custkey", "c_name")


@query("""WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS a, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'F' END AS b FROM orders)
 SELECT o_orderkey, a IS NOT DISTINCT FROM b AS same, a IS DISTINCT FROM b AS other, a IS NULL AS none FROM x""")
def where_null_semantics(t: Tables):
    rows = t.q("orders").select("o_orderkey", a=F.when(c("o_orderkey") % 3 != 0, c("o_orderstatus")), b=F.when(c("o_orderkey") % 4 != 0, F.lit("F")))
    return rows.select("o_orderkey", same=logic.equal(c("a"), c("b")), other=logic.not_equal(c("a"), c("b")), none=c("a").isNull())


@query("SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 5, 9) AND p_brand NOT IN ('Brand#11', 'Brand#12')")
def in_list(t: Tables):
    return t.q("part").where(logic.in_list(c("p_size"), [1, 5, 9]) & logic.not_in_list(c("p_brand"), ["Brand#11", "Brand#12"])).select("p_partkey", "p_size")


@query("SELECT count(*) AS n FROM part WHERE false")
def in_empty_list(t: Tables):
    return t.q("part").where(logic.in_list(c("p_size"), [])).aggregate(n=stats.count())


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def in_subquery(t: Tables):
    return t.q("customer").in_query("c_custkey", t.q("orders").where(c("o_totalprice") > 300000), "o_custkey").select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45 AND l_partkey > 10)")
def exists(t: Tables):
    return t.q("orders").exists_in(t.q("lineitem").where((c("l_quantity") > 45) & (c("l_partkey") > 10)), c("l_orderkey") == c("o_orderkey")).select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def not_exists(t: Tables):
    return t.q("customer").not_exists_in(t.q("orders").where("o_orderstatus = 'P'"), c("o_custkey") == c("c_custkey")).select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_extendedprice > o_totalprice)")
def theta_exists(t: Tables):
    return t.q("orders").exists_in(t.q("lineitem"), (c("l_orderkey") == c("o_orderkey")) & (c("l_extendedprice") > c("o_totalprice"))).select("o_orderkey")


@query("""SELECT p_partkey, p_name LIKE '%1%' AS a, p_type LIKE '_%A%' AS b, starts_with(p_brand, 'Brand') AS s, contains(p_name, '%') AS w, NOT p_name LIKE '%2%' AS n FROM part""")
def like_patterns(t: Tables):
    return t.q("part").select("p_partkey", a=logic.like(c("p_name"), "%1%"), b=logic.like(c("p_type"), "_%A%"), s=text.starts_with(c("p_brand"), "Brand"), w=text.like_literal(c("p_name"), "%"), n=~logic.like(c("p_name"), "%2%"))


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'some' ELSE 'rich' END AS tier,
 CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS b FROM customer""")
def iif_case(t: Tables):
    return t.q("customer").select("c_custkey", tier=logic.switch((c("c_acctbal") < 0, "debt"), (c("c_acctbal") < 5000, "some"), default="rich"), b=logic.iif(c("c_mktsegment") == "BUILDING", 1, 0))


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END, 'none') AS v FROM orders")
def coalesce_chain(t: Tables):
    return t.q("orders").select("o_orderkey", v=logic.coalesce(F.when(c("o_orderkey") % 2 == 0, c("o_orderstatus")), F.when(c("o_orderkey") % 3 == 0, c("o_orderpriority")), "none"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey AS a, CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey END AS b, l_orderkey AS d FROM lineitem),
 y AS (SELECT *, CASE WHEN a > b THEN a ELSE b END AS g, CASE WHEN a < b THEN a ELSE b END AS l FROM x)
 SELECT l_orderkey, l_linenumber, a, CASE WHEN g > d THEN g ELSE d END AS high, CASE WHEN l < d THEN l ELSE d END AS low FROM y""")
def greatest_least_iif(t: Tables):
    rows = t.q("lineitem").select("l_orderkey", "l_linenumber", a=c("l_partkey"), b=F.when(c("l_linenumber") % 2 == 0, c("l_suppkey")))
    return rows.select("l_orderkey", "l_linenumber", "a", high=logic.greatest(c("a"), c("b"), c("l_orderkey")), low=logic.least(c("a"), c("b"), c("l_orderkey")))


@query("SELECT p_partkey, p_size & 12 AS a, p_size | 3 AS o, xor(p_size, 5) AS x, ~p_size AS n, (p_size & 4) = 4 AS f FROM part")
def bitwise_ops(t: Tables):
    return t.q("part").select("p_partkey", a=logic.band(c("p_size"), 12), o=logic.bor(c("p_size"), 3), x=logic.bxor(c("p_size"), 5), n=logic.bnot(c("p_size")), f=logic.has_flag(c("p_size"), 4))


@query("SELECT l_orderkey, l_linenumber, (l_partkey - 100) // 7 AS d, (l_partkey - 100) % 7 AS r, -l_linenumber AS neg, l_quantity / 4 AS q FROM lineitem")
def int_div_mod(t: Tables):
    return t.q("lineitem").select("l_orderkey", "l_linenumber", d=m.int_div(c("l_partkey") - 100, 7), r=m.mod(c("l_partkey") - 100, 7), neg=-c("l_linenumber"), q=c("l_quantity") / 4)


@query("SELECT 1 AS a, 'x' AS b, CAST(NULL AS INTEGER) AS n")
def no_table(t: Tables):
    return Query.one(t.spark, a=1, b="x", n=logic.typed_null("int"))


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey >= 3")
def raw_sql_composed(t: Tables):
    t.nation.createOrReplaceTempView("nation_raw")
    return Query.sql(t.spark, "SELECT * FROM nation_raw WHERE n_nationkey >= :low", {"low": 3}).select("n_nationkey", "n_name")


@query("SELECT r_regionkey, r_name FROM region WHERE r_name NOT LIKE 'A%'")
def global_filter(t: Tables):
    return model.Model(region=t.region).filter("region", ~c("r_name").startswith("A")).read("region")


# joins


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0")
def inner_join(t: Tables):
    return t.q("orders").join(t.q("customer").where(c("c_acctbal") > 0), {"o_custkey": "c_custkey"}).select("o_orderkey", "c_name")


@query("SELECT a.l_orderkey, a.l_linenumber, b.l_suppkey FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber WHERE a.l_quantity > 40")
def composite_join(t: Tables):
    right = t.q("lineitem").select(k1=c("l_orderkey"), k2=c("l_linenumber"), supp=c("l_suppkey"))
    return t.q("lineitem").where(c("l_quantity") > 40).join(right, {"l_orderkey": "k1", "l_linenumber": "k2"}).select("l_orderkey", "l_linenumber", l_suppkey=c("supp"))


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def left_join(t: Tables):
    return t.q("customer").left_join(t.q("orders"), {"c_custkey": "o_custkey"}).select("c_custkey", "o_orderkey")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 200000) o ON c_custkey = o_custkey")
def left_join_filtered_right(t: Tables):
    return t.q("customer").left_join(t.q("orders").where(c("o_totalprice") > 200000), {"c_custkey": "o_custkey"}).select("c_custkey", "o_orderkey")


@query("SELECT n_name, s_suppkey FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey")
def right_join(t: Tables):
    return t.q("supplier").right_join(t.q("nation"), {"s_nationkey": "n_nationkey"}).select("n_name", "s_suppkey")


@query("SELECT a.r_name AS a, b.n_name AS b FROM region a, nation b")
def cross_join(t: Tables):
    return t.q("region").cross(t.q("nation")).select(a=c("r_name"), b=c("n_name"))


@query("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def self_join(t: Tables):
    right = t.q("nation").select(k=c("n_nationkey"), r=c("n_regionkey"), b=c("n_name"))
    return t.q("nation").join(right, (c("n_regionkey") == c("r")) & (c("n_nationkey") < c("k"))).select("b", a=c("n_name"))


@query("""SELECT r_name, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
 JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def join_chain(t: Tables):
    q = t.q("lineitem").join(t.q("orders"), {"l_orderkey": "o_orderkey"}).join(t.q("customer"), {"o_custkey": "c_custkey"})
    return q.join(t.q("nation"), {"c_nationkey": "n_nationkey"}).join(t.q("region"), {"n_regionkey": "r_regionkey"}).group_by("r_name").aggregate(n=stats.count())


@query("SELECT c_custkey, count(o_orderkey) AS n, coalesce(max(o_orderkey), 0) AS last FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def group_join(t: Tables):
    q = t.q("customer").group_join(t.q("orders"), "c_custkey", "o_custkey", "mine")
    return q.select("c_custkey", n=F.size("mine").cast("long"), last=F.coalesce(F.array_max(F.col("mine.o_orderkey")), F.lit(0)))


@query("SELECT s_suppkey, n_nationkey FROM supplier FULL JOIN nation ON s_nationkey = n_nationkey AND n_regionkey = 1")
def full_join_ext(t: Tables):
    return t.supplier.join(t.nation.where("n_regionkey = 1").select("n_nationkey"), c("s_nationkey") == c("n_nationkey"), "full").unionByName(
        t.nation.where("n_regionkey <> 1").select("n_nationkey").withColumn("s_suppkey", F.lit(None).cast("long")), allowMissingColumns=True
    ).select("s_suppkey", "n_nationkey")


# groups and aggregates


@query("SELECT l_returnflag, sum(l_linenumber)::BIGINT AS s, min(l_shipdate)::DATE AS lo, max(l_shipdate)::DATE AS hi, round(avg(l_linenumber), 6) AS a FROM lineitem GROUP BY 1")
def group_sum_min_max_avg(t: Tables):
    return t.q("lineitem").group_by("l_returnflag").aggregate(s=stats.total(c("l_linenumber")), lo=F.to_date(stats.low("l_shipdate")), hi=F.to_date(stats.high("l_shipdate")), a=F.round(stats.average(c("l_linenumber")), 6))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def group_composite(t: Tables):
    return t.q("orders").group_by("o_orderstatus", "o_orderpriority").aggregate(n=stats.count())


@query("SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1")
def group_expr(t: Tables):
    return t.q("orders").group_by(temporal.date_part("yyyy", c("o_orderdate")).cast("long").alias("y")).aggregate(n=stats.count())


@query("SELECT 7 AS k, count(*) AS n FROM orders")
def group_const(t: Tables):
    return t.q("orders").group_by(F.lit(7).alias("k")).aggregate(n=stats.count())


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12")
def having_count(t: Tables):
    return t.q("orders").group_by("o_custkey").aggregate(having=c("n") > 12, n=stats.count())


@query("SELECT o_orderpriority, count(*) FILTER (o_totalprice > 100000) AS big, sum((o_orderstatus = 'F')::INT)::BIGINT AS done FROM orders GROUP BY 1")
def count_if(t: Tables):
    return t.q("orders").group_by("o_orderpriority").aggregate(big=stats.count_if(c("o_totalprice") > 100000), done=stats.sum_bool(c("o_orderstatus") == "F"))


@query("SELECT coalesce(sum(l_quantity), 0) AS s, count(*) AS n, max(l_quantity) AS hi FROM lineitem WHERE l_quantity < 0")
def sum_empty_zero(t: Tables):
    return t.q("lineitem").where(c("l_quantity") < 0).aggregate(s=stats.total(c("l_quantity")), n=stats.count(), hi=stats.high("l_quantity"))


@query("SELECT p_brand, round(avg(p_size::DOUBLE), 6) AS a FROM part GROUP BY 1")
def avg_int_double(t: Tables):
    return t.q("part").group_by("p_brand").aggregate(a=F.round(stats.average(c("p_size")), 6))


@query("""SELECT p_brand, round(stddev_samp(p_retailprice), 4) AS s, round(stddev_pop(p_retailprice), 4) AS sp, round(var_samp(p_size), 4) AS v, round(var_pop(p_size), 4) AS vp FROM part GROUP BY 1""")
def stdev_var(t: Tables):
    return t.q("part").group_by("p_brand").aggregate(s=F.round(stats.stdev("p_retailprice"), 4), sp=F.round(stats.stdevp("p_retailprice"), 4), v=F.round(stats.var("p_size"), 4), vp=F.round(stats.varp("p_size"), 4))


@query("SELECT count(*) AS n FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders)")
def distinct_count_subquery(t: Tables):
    return t.q("orders").select("o_custkey", "o_orderstatus").distinct().aggregate(n=stats.count())


@query("SELECT round(sum(o_totalprice), 2) AS s, count(*) AS n FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 100)")
def agg_over_take(t: Tables):
    return t.q("orders").order_by("o_orderkey").take(100).aggregate(s=F.round(stats.total(c("o_totalprice")), 2), n=stats.count())


@query("SELECT n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS n FROM nation")
def scalar_subquery_agg(t: Tables):
    counts = t.q("customer").group_by(c("c_nationkey").alias("k")).aggregate(n=stats.count())
    return t.q("nation").left_join(counts, {"n_nationkey": "k"}).select("n_name", n=F.coalesce(c("n"), F.lit(0)))


@query("SELECT (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS orders, count(*) AS customers FROM customer c GROUP BY 1")
def group_by_subquery_key(t: Tables):
    counts = t.q("orders").group_by(c("o_custkey").alias("k")).aggregate(n=stats.count())
    keyed = t.q("customer").left_join(counts, {"c_custkey": "k"}).select(orders=F.coalesce(c("n"), F.lit(0)))
    return keyed.group_by("orders").aggregate(customers=stats.count())


@query("SELECT EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 1000) AS value")
def any_rows(t: Tables):
    return t.q("orders").any(c("o_totalprice") > 1000)


@query("SELECT NOT EXISTS (SELECT 1 FROM orders WHERE NOT o_totalprice > 0) AS value")
def all_rows(t: Tables):
    return t.q("orders").all(c("o_totalprice") > 0)


@query("SELECT o_orderstatus, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1")
def count_distinct_ext(t: Tables):
    return t.q("orders").group_by("o_orderstatus").aggregate(n=F.countDistinct("o_custkey"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (1, 2)")
def rollup_ext(t: Tables):
    return t.orders.rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


# order and paging


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_n(t: Tables):
    return t.q("orders").order_by_desc("o_totalprice").then_by("o_orderkey").take(10).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders WHERE false")
def top_zero(t: Tables):
    return t.q("orders").take(0).select("o_orderkey")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 40")
def skip_take(t: Tables):
    return t.q("orders").order_by("o_orderkey").skip(40).take(20).select("o_orderkey")


@query("SELECT c_custkey FROM customer ORDER BY c_custkey OFFSET 100")
def skip_only(t: Tables):
    return t.q("customer").order_by("c_custkey").skip(100).select("c_custkey")


@query("(SELECT 'first' AS w, o_orderkey FROM orders ORDER BY o_orderkey LIMIT 1) UNION ALL (SELECT 'last', o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 1)")
def first_last(t: Tables):
    rows = t.q("orders").order_by("o_orderkey")
    return rows.first().select("o_orderkey", w="first").concat(rows.last().select("o_orderkey", w="last"))


@query("SELECT n_name FROM nation WHERE n_nationkey = 7")
def single(t: Tables):
    return t.q("nation").where(c("n_nationkey") == 7).single().select("n_name")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 1 OFFSET 5")
def element_at(t: Tables):
    return t.q("orders").order_by("o_orderdate").then_by("o_orderkey").element_at(5).select("o_orderkey")


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has FROM customer ORDER BY 2, 1 LIMIT 30")
def order_by_exists(t: Tables):
    flags = t.q("orders").select(k=c("o_custkey")).distinct()
    rows = t.q("customer").left_join(flags, {"c_custkey": "k"}).select("c_custkey", has=c("k").isNotNull())
    return rows.order_by("has").then_by("c_custkey").take(30)


@query("SELECT p_partkey, p_size > 25 AS big FROM part ORDER BY 2 DESC, 1 LIMIT 15")
def order_by_bool(t: Tables):
    return t.q("part").select("p_partkey", big=c("p_size") > 25).order_by_desc("big").then_by("p_partkey").take(15)


@query("SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS best FROM customer")
def scalar_subquery_top(t: Tables):
    best = t.q("orders").group_by(c("o_custkey").alias("k")).aggregate(best=F.max("o_totalprice"))
    return t.q("customer").left_join(best, {"c_custkey": "k"}).select("c_custkey", "best")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) r FROM orders) WHERE r <= 2")
def top_per_group_ext(t: Tables):
    return t.q("orders").group_by("o_custkey").top(2, c("o_totalprice").desc(), c("o_orderkey")).select("o_custkey", "o_orderkey")


@query("SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders")
def window_lag_ext(t: Tables):
    return t.orders.select("o_orderkey", F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("before"))


# sets


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(t: Tables):
    return t.q("customer").select(k=c("c_nationkey")).union(t.q("supplier").select(k=c("s_nationkey")))


@query("SELECT c_name AS n, 'c' AS w FROM customer UNION ALL SELECT s_name, 's' FROM supplier")
def concat_all(t: Tables):
    return t.q("customer").select(n=c("c_name"), w="c").concat(t.q("supplier").select(n=c("s_name"), w="s"))


@query("SELECT * FROM (SELECT c_custkey AS k FROM customer UNION SELECT s_suppkey FROM supplier) ORDER BY k LIMIT 10 OFFSET 5")
def union_paged(t: Tables):
    return t.q("customer").select(k=c("c_custkey")).union(t.q("supplier").select(k=c("s_suppkey"))).order_by("k").skip(5).take(10)


@query("SELECT DISTINCT * FROM (VALUES (1, 'a'), (2, 'b'), (1, 'a'), (3, NULL)) v(i, s)")
def inline_values_dedup(t: Tables):
    return Query.values(t.spark, [(1, "a"), (2, "b"), (1, "a"), (3, None)], "i int, s string")


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect_ext(t: Tables):
    return t.q("customer").select(k=c("c_nationkey")).intersect(t.q("supplier").select(k=c("s_nationkey")))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def except_ext(t: Tables):
    return t.q("customer").select(k=c("c_custkey")).except_(t.q("orders").where("o_orderstatus = 'P'").select(k=c("o_custkey")))


# text


@query("SELECT p_partkey, lower(p_type) AS lo, upper(p_name) AS up, length(p_name)::INT AS n, trim('  ' || p_brand || ' ') AS t, ltrim('  ' || p_brand) AS l, rtrim(p_brand || '  ') AS r FROM part")
def str_case_trim_len(t: Tables):
    pad = F.concat(F.lit("  "), c("p_brand"))
    return t.q("part").select("p_partkey", lo=text.lower(c("p_type")), up=text.upper(c("p_name")), n=text.length(c("p_name")), t=text.trim(F.concat(pad, F.lit(" "))), l=text.trim_start(pad), r=text.trim_end(F.concat(c("p_brand"), F.lit("  "))))


@query("SELECT p_partkey, (instr(lower(p_type), 'a') - 1)::INT AS a, (instr(lower(p_name), lower(p_brand)) - 1)::INT AS b, 0 AS e FROM part")
def str_indexof(t: Tables):
    return t.q("part").select("p_partkey", a=text.index_of(c("p_type"), "A"), b=text.index_of(c("p_name"), c("p_brand")), e=text.index_of(c("p_name"), ""))


@query("SELECT c_custkey, contains(lower(c_name), lower(substr(c_mktsegment, 1, 1))) AS has, contains(c_name, 'Customer') AS lit FROM customer")
def str_contains_column(t: Tables):
    return t.q("customer").select("c_custkey", has=text.contains(c("c_name"), text.first_char(c("c_mktsegment"))), lit=text.contains(c("c_name"), "Customer"))


@query("SELECT p_partkey, starts_with(p_name, substr(p_name, 1, 3)) AS s, ends_with(p_name, p_brand) AS e, ends_with(p_brand, '1') AS l FROM part")
def str_starts_ends(t: Tables):
    return t.q("part").select("p_partkey", s=text.starts_with(c("p_name"), F.substr(c("p_name"), F.lit(1), F.lit(3))), e=text.ends_with(c("p_name"), c("p_brand")), l=text.ends_with(c("p_brand"), "1"))


@query("SELECT p_partkey, replace(p_brand, '#', '-') AS r, replace(p_name, p_brand, '') AS q FROM part")
def str_replace(t: Tables):
    return t.q("part").select("p_partkey", r=text.replace(c("p_brand"), "#", "-"), q=text.replace(c("p_name"), c("p_brand"), ""))


@query("SELECT p_partkey, substr(p_name, 3) AS a, substr(p_name, 2, 4) AS b, substr(p_name, 1, 2) AS d FROM part")
def str_substring(t: Tables):
    return t.q("part").select("p_partkey", a=text.substring(c("p_name"), 2), b=text.substring(c("p_name"), 1, 4), d=text.substring(c("p_name"), -1, 2))


@query("SELECT c_custkey, substr(c_name, 1, 1) AS f, right(c_name, 1) AS l FROM customer")
def str_first_last(t: Tables):
    return t.q("customer").select("c_custkey", f=text.first_char(c("c_name")), l=text.last_char(c("c_name")))


@query("WITH x AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN ' ' ELSE 'v' END AS s FROM orders) SELECT o_orderkey, s IS NULL OR s = '' AS e, s IS NULL OR trim(s) = '' AS w FROM x")
def str_null_or_empty(t: Tables):
    k = c("o_orderkey") % 4
    rows = t.q("orders").select("o_orderkey", s=F.when(k == 1, "").when(k == 2, " ").when(k == 3, "v"))
    return rows.select("o_orderkey", e=text.is_null_or_empty(c("s")), w=text.is_null_or_whitespace(c("s"), strict=True))


@query("SELECT o_orderkey, concat_ws('|', coalesce(o_orderstatus, ''), coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END, ''), 'x') AS j, o_orderstatus || '/' || o_orderpriority AS p FROM orders")
def str_join(t: Tables):
    return t.q("orders").select("o_orderkey", j=text.join_values("|", c("o_orderstatus"), F.when(c("o_orderkey") % 2 == 0, c("o_orderpriority")), "x"), p=text.concat(c("o_orderstatus"), "/", c("o_orderpriority")))


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN 'True' ELSE 'False' END AS b, coalesce(CASE WHEN p_size % 2 = 0 THEN p_size END::VARCHAR, '') AS s, CASE WHEN p_brand < p_type THEN -1 WHEN p_brand = p_type THEN 0 ELSE 1 END AS k FROM part")
def to_string_bool(t: Tables):
    return t.q("part").select("p_partkey", b=text.to_text(c("p_size") > 25, boolean=True), s=text.to_text(F.when(c("p_size") % 2 == 0, c("p_size"))), k=text.compare(c("p_brand"), c("p_type")))


# mathematics


@query("SELECT s_suppkey, abs(s_acctbal) AS a, round(pow(s_suppkey, 1.5), 4) AS p, round(exp(s_nationkey / 10.0), 6) AS e, round(sqrt(s_suppkey), 6) AS q, sign(s_acctbal)::INT AS g, round(sin(s_suppkey), 6) AS s, round(cos(s_suppkey), 6) AS co, round(tan(s_nationkey), 6) AS t, round(atan(s_suppkey), 6) AS at FROM supplier")
def math_direct(t: Tables):
    k, n = c("s_suppkey"), c("s_nationkey")
    return t.q("supplier").select(
        "s_suppkey", a=m.absolute(c("s_acctbal")), p=F.round(m.power(k, 1.5), 4), e=F.round(m.exp(n / 10.0), 6), q=F.round(m.sqrt(k), 6), g=m.sign(c("s_acctbal")),
        s=F.round(m.sin(k), 6), co=F.round(m.cos(k), 6), t=F.round(m.tan(n), 6), at=F.round(m.atan(k), 6),
    )


@query("WITH x AS (SELECT s_suppkey, s_nationkey / 26.0 - 0.4 AS v FROM supplier) SELECT s_suppkey, round(acos(v), 6) AS ac, round(asin(v), 6) AS an, round(acos(v), 6) AS af, round(asin(v), 6) AS nf, round(atan(v / 2), 6) AS r, round(atan2(v, -2), 6) AS q FROM x")
def math_trig_inverse(t: Tables):
    rows = t.q("supplier").select("s_suppkey", v=c("s_nationkey") / 26.0 - 0.4)
    v = c("v")
    return rows.select("s_suppkey", ac=F.round(m.acos(v), 6), an=F.round(m.asin(v), 6), af=F.round(m.acos_formula(v), 6), nf=F.round(m.asin_formula(v), 6), r=F.round(m.atan_ratio(v, F.lit(2.0)), 6), q=F.round(m.atan2(v, F.lit(-2.0)), 6))


@query("SELECT p_partkey, round(ln(p_retailprice), 6) AS l, round(log10(p_retailprice), 6) AS t, round(ln(p_retailprice) / ln(3), 6) AS b FROM part")
def math_logs(t: Tables):
    p = c("p_retailprice")
    return t.q("part").select("p_partkey", l=F.round(m.log(p), 6), t=F.round(m.log10(p), 6), b=F.round(m.log(p, 3), 6))


@query("SELECT c_custkey, trunc(c_acctbal) AS x, CASE WHEN trunc(c_acctbal) = c_acctbal THEN trunc(c_acctbal) ELSE trunc(c_acctbal) + 1 END AS up, floor(c_acctbal)::BIGINT AS f, ceil(c_acctbal)::BIGINT AS k FROM customer")
def math_fix_floor_ceil(t: Tables):
    a = c("c_acctbal")
    return t.q("customer").select("c_custkey", x=m.fix_floor(a), up=m.fix_ceiling(a), f=m.floor(a), k=m.ceil(a))


@query("SELECT p_partkey, round_even(p_size / 2.0, 0)::DOUBLE AS h, round_even(p_size / 8.0::DOUBLE, 2)::DOUBLE AS d FROM part")
def math_round_even(t: Tables):
    return t.q("part").select("p_partkey", h=m.round_even(c("p_size") / 2), d=m.round_even(c("p_size") / 8, 2))


@query("SELECT p_partkey, round(radians(p_size), 8) AS r, round(degrees(p_size), 6) AS d FROM part")
def deg_rad(t: Tables):
    return t.q("part").select("p_partkey", r=F.round(m.radians(c("p_size")), 8), d=F.round(m.degrees(c("p_size")), 6))


@query("SELECT count(*) AS n, true AS ok FROM nation")
def random_range(t: Tables):
    return t.q("nation").select(r=m.random()).aggregate(n=stats.count(), ok=F.every((c("r") >= 0) & (c("r") < 1)))


# dates and times


@query("SELECT o_orderkey, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS mo, day(o_orderdate)::INT AS d, dayofyear(o_orderdate)::INT AS dy, hour(o_orderdate)::INT AS h, minute(o_orderdate)::INT AS mi, second(o_orderdate)::INT AS s FROM orders")
def date_parts(t: Tables):
    parts = {"y": "yyyy", "mo": "m", "d": "d", "dy": "y", "h": "h", "mi": "n", "s": "s"}
    return t.q("orders").select("o_orderkey", **{k: temporal.date_part(p, c("o_orderdate")) for k, p in parts.items()})


@query("SELECT o_orderkey, dayofweek(o_orderdate)::INT AS w FROM orders")
def day_of_week(t: Tables):
    return t.q("orders").select("o_orderkey", w=temporal.day_of_week(c("o_orderdate")))


def _show(x):
    return F.date_format(x, "yyyy-MM-dd HH:mm:ss")


@query("""SELECT event_id, strftime(ts + INTERVAL 1 YEAR, '%Y-%m-%d %H:%M:%S') AS y, strftime(ts + INTERVAL 1 MONTH, '%Y-%m-%d %H:%M:%S') AS mo, strftime(ts + INTERVAL 5 DAY, '%Y-%m-%d %H:%M:%S') AS d,
 strftime(ts + INTERVAL 7 HOUR, '%Y-%m-%d %H:%M:%S') AS h, strftime(ts - INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M:%S') AS mi, strftime(ts + INTERVAL 30 SECOND, '%Y-%m-%d %H:%M:%S') AS s FROM events""")
def date_add(t: Tables):
    steps = {"y": ("yyyy", 1), "mo": ("m", 1), "d": ("d", 5), "h": ("h", 7), "mi": ("n", -90), "s": ("s", 30)}
    return t.q("events").select("event_id", **{k: _show(temporal.date_add(p, n, c("ts"))) for k, (p, n) in steps.items()})


@query("""SELECT event_id, date_diff('year', TIMESTAMP '2023-12-31 23:59:59', ts)::BIGINT AS y, date_diff('month', TIMESTAMP '2023-12-31 23:59:59', ts)::BIGINT AS mo, date_diff('day', TIMESTAMP '2023-12-31 23:59:59', ts)::BIGINT AS d,
 date_diff('hour', TIMESTAMP '2023-12-31 23:59:59', ts)::BIGINT AS h, date_diff('minute', TIMESTAMP '2023-12-31 23:59:59', ts)::BIGINT AS mi, date_diff('second', TIMESTAMP '2023-12-31 23:59:59', ts)::BIGINT AS s FROM events""")
def datediff_boundaries(t: Tables):
    start = F.lit(dt.datetime(2023, 12, 31, 23, 59, 59))
    return t.q("events").select("event_id", **{k: temporal.date_diff(p, start, c("ts")).cast("long") for k, p in {"y": "yyyy", "mo": "m", "d": "d", "h": "h", "mi": "n", "s": "s"}.items()})


@query("SELECT o_orderkey, o_orderdate::DATE AS d, date_diff('day', DATE '0001-01-01', o_orderdate::DATE)::INT AS n, strftime(o_orderdate::DATE + INTERVAL 2 MONTH, '%Y-%m-%d') AS m2, make_date(year(o_orderdate), 1, 1) AS j FROM orders")
def date_only(t: Tables):
    d = temporal.date_only(c("o_orderdate"))
    return t.q("orders").select("o_orderkey", d=d, n=temporal.day_number(c("o_orderdate")), m2=F.date_format(temporal.date_add("m", 2, d.cast("timestamp")), "yyyy-MM-dd"), j=temporal.date_serial(F.year(c("o_orderdate")), 1, 1))


@query("WITH x AS (SELECT event_id, hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS s FROM events) SELECT event_id, s::INT AS s, (s // 3600)::INT AS h, (s // 60 % 60)::INT AS mi, ((s + 7200) % 86400)::INT AS later FROM x")
def time_of_day(t: Tables):
    s = temporal.time_of_day(c("ts"))
    return t.q("events").select("event_id", s=s, h=temporal.time_part("h", s), mi=temporal.time_part("n", s), later=temporal.time_add("h", 2, s))


@query("SELECT event_id, hour(ts) >= 9 AND hour(ts) < 17 AS work FROM events")
def time_is_between(t: Tables):
    return t.q("events").select("event_id", work=temporal.time_between(temporal.time_of_day(c("ts")), temporal.seconds("09:00:00"), temporal.seconds("17:00:00")))


@query("SELECT event_id, floor(epoch(ts))::BIGINT AS s, floor(epoch_us(ts) / 1000.0)::BIGINT AS ms FROM events")
def unix_time(t: Tables):
    return t.q("events").select("event_id", s=temporal.unix_seconds(c("ts")), ms=temporal.unix_millis(c("ts")))


@query("SELECT o_orderkey, o_orderkey % 3 = 0 AS ok FROM orders")
def is_date(t: Tables):
    k = c("o_orderkey") % 3
    return t.q("orders").select("o_orderkey", ok=temporal.is_date(F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, "no date")))


# conversions, bytes


@query("""SELECT l_orderkey, l_linenumber, round_even(l_discount * 100, 0)::INT AS i, l_quantity <> 0 AS b, l_tax::FLOAT::DOUBLE AS f, l_orderkey::VARCHAR AS s, round(l_extendedprice, 2)::DECIMAL(18,2) AS d FROM lineitem""")
def casts(t: Tables):
    return t.q("lineitem").select("l_orderkey", "l_linenumber", i=convert.clng(c("l_discount") * 100), b=convert.cbool(c("l_quantity")), f=convert.csng(c("l_tax")).cast("double"), s=convert.cstr(c("l_orderkey")), d=convert.cdec(F.round(c("l_extendedprice"), 2)))


@query("""WITH x AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '12' WHEN 1 THEN 'junk' END AS s FROM orders) SELECT o_orderkey, try_cast(s AS INT) AS i, try_cast(s AS DOUBLE) AS d,
 CASE WHEN try_cast(s AS INT) BETWEEN 0 AND 255 THEN try_cast(s AS SMALLINT) END AS b FROM x""")
def casts_null_guard(t: Tables):
    k = c("o_orderkey") % 3
    rows = t.q("orders").select("o_orderkey", s=F.when(k == 0, "12").when(k == 1, "junk"))
    return rows.select("o_orderkey", i=convert.clng(c("s")), d=convert.cdbl(c("s")), b=convert.cbyte(c("s")))


@query("SELECT p_partkey, octet_length(encode(p_name))::INT AS n, ascii(substr(p_name, 1, 1))::INT AS f, ascii(substr(p_name, 3, 1))::INT AS k, contains(p_name, 'a') AS has FROM part")
def bytes_index_contains(t: Tables):
    x = c("p_name").cast("binary")
    return t.q("part").select("p_partkey", n=binary.byte_length(x), f=binary.first_byte(x), k=binary.byte_at(x, 2), has=binary.contains_byte(x, ord("a")))


# shapes of models


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'purchase')")
def of_type(t: Tables):
    return model.of_type(t.events, "event_type", "click", "purchase").select("event_id", "event_type")


@query("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, 'customer' AS type_tag FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, 'supplier' FROM supplier")
def per_concrete_type(t: Tables):
    a = t.customer.select(c("c_custkey").alias("id"), c("c_name").alias("name"), c("c_mktsegment").alias("segment"))
    return model.per_concrete_type(customer=a, supplier=t.supplier.select(c("s_suppkey").alias("id"), c("s_name").alias("name")))


@query("""SELECT p_partkey, CASE WHEN p_size > 40 THEN 'large' WHEN p_size > 20 THEN 'medium' END AS type_tag, CASE WHEN p_size > 20 THEN p_brand END AS brand, CASE WHEN p_size > 40 THEN p_type END AS kind FROM part""")
def per_type(t: Tables):
    medium = t.part.where("p_size > 20").select("p_partkey", c("p_brand").alias("brand"))
    large = t.part.where("p_size > 40").select("p_partkey", c("p_type").alias("kind"))
    return model.per_type(t.part.select("p_partkey"), "p_partkey", medium=medium, large=large)


@query("SELECT r_regionkey, count(n_nationkey) AS n, min(n_name) AS first FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def include_children(t: Tables):
    out = model.include(t.region, t.nation.select("n_name", "n_regionkey"), "r_regionkey", "n_regionkey", "nations")
    return out.select("r_regionkey", F.size("nations").cast("long").alias("n"), F.array_min("nations.n_name").alias("first"))


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%')")
def split_include(t: Tables):
    return model.split_include(t.region.where("r_name like 'A%'"), t.nation, "r_regionkey", "n_regionkey")[1].select("n_nationkey", "n_name")


@query("SELECT DISTINCT s_suppkey, p_partkey FROM supplier LEFT JOIN (lineitem JOIN part ON l_partkey = p_partkey) ON s_suppkey = l_suppkey WHERE s_nationkey < 5")
def many_to_many(t: Tables):
    link = t.lineitem.select("l_suppkey", "l_partkey").distinct()
    return model.through(t.supplier.where("s_nationkey < 5"), link, t.part, ("s_suppkey", "l_suppkey"), ("l_partkey", "p_partkey")).select("s_suppkey", "p_partkey")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def entity_fragments(t: Tables):
    return model.fragments("c_custkey", t.customer.select("c_custkey", "c_name"), t.customer.select("c_custkey", "c_acctbal"))


@query("SELECT p_partkey, p_brand, p_type FROM part")
def owned_flattened(t: Tables):
    return model.flat(model.owned(t.part.select("p_partkey", "p_brand", "p_type"), "kind", ["p_brand", "p_type"]), "kind")


_by_segment = prepared(lambda t, segment: t.q("customer").where(c("c_mktsegment") == segment).select("c_custkey"))


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def prepared_query(t: Tables):
    return _by_segment(t, "BUILDING")


# the dialect


in_dialect(
    "dialect_select",
    "SELECT TOP @n `c`.`c_custkey`, IIF(`c`.`c_acctbal` < 0, 'debt', 'ok') AS `s`, LEN([c].[c_name]) AS `n` FROM `customer` AS `c` WHERE `c`.`c_custkey` MOD 2 = 0 AND NOT (`c`.`c_mktsegment` = 'BUILDING') ORDER BY `c`.`c_custkey` DESC",
    "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'ok' END AS s, length(c_name)::INT AS n FROM customer WHERE c_custkey % 2 = 0 AND NOT c_mktsegment = 'BUILDING' ORDER BY c_custkey DESC LIMIT 25",
    "customer", args={"n": 25},
)
in_dialect(
    "dialect_joins",
    "-- a tag\nSELECT `n`.`n_name` AS `name`, COUNT(*) AS `k`, IIF(SUM(`c`.`c_acctbal`) IS NULL, 0, ROUND(SUM(`c`.`c_acctbal`), 2)) AS `total` FROM (`nation` AS `n` INNER JOIN `region` AS `r` ON `n`.`n_regionkey` = `r`.`r_regionkey`) LEFT JOIN `customer` AS `c` ON `n`.`n_nationkey` = `c`.`c_nationkey` WHERE `r`.`r_name` LIKE 'A%' GROUP BY `n`.`n_name` HAVING COUNT(*) > 1",
    "SELECT n_name AS name, count(*) AS k, coalesce(round(sum(c_acctbal), 2), 0) AS total FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON n_nationkey = c_nationkey WHERE r_name LIKE 'A%' GROUP BY 1 HAVING count(*) > 1",
    "nation", "region", "customer",
)
in_dialect(
    "dialect_operators",
    r"SELECT `p_partkey`, `p_brand` & '/' & `p_size` AS `t`, `p_size` \ 4 AS `d`, `p_size` MOD 4 AS `r`, `p_size` BAND 5 AS `a`, `p_size` BOR 8 AS `o`, `p_size` BXOR 3 AS `x`, `p_size` ^ 2 AS `q`, INSTR(1, `p_name`, 'A', 1) AS `i`, MID(`p_name`, 2, 3) AS `m`, FIX(-`p_retailprice`) AS `f` FROM `part`",
    "SELECT p_partkey, p_brand || '/' || p_size AS t, p_size // 4 AS d, p_size % 4 AS r, p_size & 5 AS a, p_size | 8 AS o, xor(p_size, 3) AS x, pow(p_size, 2) AS q, instr(lower(p_name), 'a')::INT AS i, substr(p_name, 2, 3) AS m, trunc(-p_retailprice) AS f FROM part",
    "part",
)
in_dialect(
    "dialect_dates",
    "SELECT `o_orderkey`, DATEPART('yyyy', `o_orderdate`) AS `y`, DATEDIFF('m', #1995-01-31#, `o_orderdate`) AS `d`, DATEPART('w', DATEADD('d', 1, `o_orderdate`)) AS `w` FROM `orders` WHERE `o_orderdate` >= #1995-06-01 00:00:00#",
    "SELECT o_orderkey, year(o_orderdate)::INT AS y, date_diff('month', DATE '1995-01-31', o_orderdate::DATE)::INT AS d, (dayofweek(o_orderdate + INTERVAL 1 DAY) + 1)::INT AS w FROM orders WHERE o_orderdate >= TIMESTAMP '1995-06-01'",
    "orders",
)
in_dialect(
    "dialect_subqueries",
    "SELECT `c`.`c_custkey` AS `k`, (SELECT COUNT(*) FROM `orders` AS `o` WHERE `o`.`o_custkey` = `c`.`c_custkey`) AS `n` FROM `customer` AS `c` WHERE EXISTS (SELECT 1 FROM `orders` AS `o` WHERE `o`.`o_custkey` = `c`.`c_custkey` AND `o`.`o_totalprice` > 100000) AND `c`.`c_nationkey` IN (SELECT `n_nationkey` FROM `nation` WHERE `n_regionkey` < 3)",
    "SELECT c_custkey AS k, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000) AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)",
    "customer", "orders", "nation",
)
in_dialect(
    "dialect_union",
    "SELECT `u`.`k` FROM (SELECT `c_nationkey` AS `k` FROM `customer` UNION SELECT `s_nationkey` FROM `supplier`) AS `u` WHERE `u`.`k` BETWEEN 2 AND 9",
    "SELECT k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) WHERE k BETWEEN 2 AND 9",
    "customer", "supplier",
)
in_dialect("dialect_dual", "SELECT ? + 1 AS `a`, 'it''s' AS `b`, TRUE AS `c` FROM #Dual", "SELECT 42 AS a, 'it''s' AS b, true AS c", args=[41])
in_dialect("dialect_skip", "SELECT `o_orderkey` FROM `orders` ORDER BY `o_orderkey` SKIP 14", "SELECT o_orderkey FROM orders ORDER BY 1 OFFSET 14", "orders")


# changes of tables


def _store(t: Tables, name: str):
    from quillon.sources.store import Store

    root = t.spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        import tempfile

        root = "file://" + tempfile.mkdtemp(prefix="quillon-store-")
    import uuid

    return Store(t.spark, f"{root.rstrip('/')}/stores/{name}-{uuid.uuid4().hex}", create=True)


@query("SELECT c_custkey AS id, c_acctbal * CASE WHEN n_regionkey = 1 THEN 2 ELSE 1 END AS bal FROM customer JOIN nation ON c_nationkey = n_nationkey")
def update_join(t: Tables):
    s = _store(t, "update")
    s.create_table("c", {"id": "bigint", "bal": "double", "nation": "integer"}, ["id"])
    s.insert("c", t.customer.select(c("c_custkey").alias("id"), c("c_acctbal").alias("bal"), c("c_nationkey").alias("nation")))
    s.update("c", {"bal": c("bal") * 2}, c("region") == 1, t.nation.select(c("n_nationkey").alias("nation"), c("n_regionkey").alias("region")), ["nation"])
    return s.table("c").select("id", "bal")


@query("SELECT c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def delete_exists(t: Tables):
    s = _store(t, "delete")
    s.create_table("c", {"id": "bigint"})
    s.insert("c", t.customer.select(c("c_custkey").alias("id")))
    s.delete("c", keys=t.orders.where("o_totalprice > 200000").select(c("o_custkey").alias("id")), on=["id"])
    return s.table("c")


@query("SELECT (10 + 5 * (row_number() OVER (ORDER BY n_name) - 1))::INT AS id, n_name AS name, 'new' AS state FROM nation")
def insert_identity(t: Tables):
    s = _store(t, "insert")
    s.create_table("n", {"id": "counter(10,5)", "name": "varchar(40) NOT NULL", "state": "varchar(10) DEFAULT 'new'"}, ["id"])
    s.insert("n", t.nation.select(c("n_name").alias("name")))
    return s.table("n")


@query("SELECT * FROM (VALUES ('b', 'id', 0, false), ('b', 'note', 1, true)) v(TABLE_NAME, COLUMN_NAME, ORDINAL_POSITION, IS_NULLABLE)")
def info_schema_columns(t: Tables):
    s = _store(t, "catalog")
    s.execute("CREATE TABLE `a` (`x` integer); CREATE TABLE `b` (`id` counter NOT NULL, `note` memo, CONSTRAINT `PK` PRIMARY KEY (`id`))")
    return s.query("SELECT `TABLE_NAME`, `COLUMN_NAME`, `ORDINAL_POSITION`, `IS_NULLABLE` FROM `INFORMATION_SCHEMA.COLUMNS` WHERE `TABLE_NAME` = 'b' ORDER BY `ORDINAL_POSITION`")
