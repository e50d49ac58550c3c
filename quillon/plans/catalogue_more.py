"""More registered queries: the rest of the functions, the store's statements and views, and options."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon import options
from quillon.functions import binary, convert, logic, registry, stats, temporal, text
from quillon.functions import math as m
from quillon.operators import model
from quillon.operators.query import Query, QueryError
from quillon.plans.catalogue import Tables, _store, c, in_dialect, query
from quillon.plans.statements import database
from quillon.sources import files
from quillon.sources.store import ConcurrencyError, Store, StoreError
from quillon.types import conform

# sources and results


@query("SELECT round(max(o_totalprice), 2) AS best FROM orders")
def scalar_sql(t: Tables):
    t.orders.createOrReplaceTempView("orders_raw")
    return Query.sql(t.spark, "SELECT round(max(o_totalprice), 2) AS best FROM orders_raw")


@query("SELECT n_nationkey, n_name FROM nation")
def csv_round_trip(t: Tables):
    path = _store(t, "csv").root + "/nation"
    files.write(t.nation.select("n_nationkey", "n_name"), path, "csv", header="true")
    return files.read(t.spark, path, "csv", "n_nationkey int, n_name string", header="true")


@query("SELECT CASE WHEN p_partkey <> 7 THEN p_partkey END AS p_partkey, p_size % 3 <> 0 AS flag, CASE WHEN p_size <> 7 THEN p_size END AS size, coalesce(CASE WHEN p_size % 2 = 0 THEN p_brand END, '') AS brand FROM part")
def result_reader(t: Tables):
    rows = t.part.select("p_partkey", (c("p_size") % 3).alias("flag"), c("p_size").alias("size"), F.when(c("p_size") % 2 == 0, c("p_brand")).alias("brand"))
    wanted = T.StructType([T.StructField("p_partkey", T.LongType()), T.StructField("flag", T.BooleanType()), T.StructField("size", T.IntegerType()), T.StructField("brand", T.StringType(), False)])
    return conform(rows, wanted, fill_defaults=True, null_integer=7)


@query("SELECT event_id, floor(epoch_us(ts) / 1000 + 0.5)::BIGINT AS ms FROM events")
def milliseconds_option(t: Tables):
    rows = conform(t.events.select("event_id", "ts"), T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType())]), precision="ms")
    return rows.select("event_id", F.unix_millis("ts").alias("ms"))


@query("SELECT c_custkey AS k, n_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 0 UNION ALL SELECT s_suppkey, NULL FROM supplier")
def union_null_integer(t: Tables):
    a = t.customer.join(t.nation, c("c_nationkey") == c("n_nationkey")).select(c("c_custkey").alias("k"), c("n_regionkey").alias("r")).where("r <> 0")
    b = t.supplier.select(c("s_suppkey").alias("k"), F.lit(-1).alias("r"))
    return conform(a.unionByName(b), T.StructType([T.StructField("k", T.LongType()), T.StructField("r", T.IntegerType())]), null_integer=-1)


# joins, groups, order


@query("SELECT r_name, n_name, c_custkey FROM region CROSS JOIN nation LEFT JOIN customer ON c_nationkey = n_nationkey AND n_regionkey = r_regionkey WHERE n_nationkey < 6")
def left_after_cross(t: Tables):
    return t.q("region").cross(t.q("nation").where("n_nationkey < 6")).left_join(t.q("customer"), [c("c_nationkey") == c("n_nationkey"), c("n_regionkey") == c("r_regionkey")]).select("r_name", "n_name", "c_custkey")


@query("SELECT r_name, c_custkey FROM region JOIN (customer JOIN nation ON c_nationkey = n_nationkey) ON TRUE WHERE r_regionkey = 1 AND n_regionkey = 2")
def join_not_on_first(t: Tables):
    return t.q("region").where("r_regionkey = 1").cross(t.q("customer").join(t.q("nation").where("n_regionkey = 2"), {"c_nationkey": "n_nationkey"})).select("r_name", "c_custkey")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 12")
def order_by_aggregate(t: Tables):
    return t.q("orders").group_by("o_custkey").aggregate(n=stats.count()).order_by_desc("n").then_by("o_custkey").take(12)


@query("SELECT p_brand, sum(round_even(p_retailprice / 100, 0)) AS r, sum(trunc(p_retailprice / 7)) AS t FROM part GROUP BY 1")
def sum_rounded(t: Tables):
    return t.q("part").group_by("p_brand").aggregate(r=stats.total(m.round_even(c("p_retailprice") / 100)), t=stats.total(m.fix_floor(c("p_retailprice") / 7)))


@query("SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, avg(o_totalprice) AS mean, count(*) AS n FROM orders WHERE o_orderkey < 0")
def empty_extremes(t: Tables):
    return t.q("orders").where(c("o_orderkey") < 0).aggregate(lo=stats.low("o_totalprice"), hi=stats.high("o_totalprice"), mean=stats.average(c("o_totalprice")), n=stats.count())


@query("SELECT o_orderkey FROM (SELECT * FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 40) ORDER BY o_orderkey DESC LIMIT 9)")
def stacked_limits(t: Tables):
    return t.q("orders").order_by("o_orderkey").take(40).order_by_desc("o_orderkey").take(9).select("o_orderkey")


@query("SELECT EXISTS (SELECT 1 FROM part WHERE p_size = 10) AS value")
def contains_value(t: Tables):
    return t.q("part").contains("p_size", 10)


in_dialect("top_parameters", "SELECT TOP @a + @b `o_orderkey` FROM `orders` ORDER BY `o_orderkey`", "SELECT o_orderkey FROM orders ORDER BY 1 LIMIT 11", "orders", args={"a": 4, "b": 7})
in_dialect("top_sum", "SELECT TOP 3+4 `o_orderkey` FROM `orders` ORDER BY `o_orderkey` DESC", "SELECT o_orderkey FROM orders ORDER BY 1 DESC LIMIT 7", "orders")
in_dialect(
    "like_classes",
    "SELECT `p_partkey`, IIF(`p_name` LIKE '%[0-4]', 1, 0) AS `a`, IIF(`p_name` LIKE '%[!0-4]', 1, 0) AS `b`, IIF(`p_brand` LIKE 'Brand[#]_[135]', 1, 0) AS `d` FROM `part`",
    "SELECT p_partkey, regexp_full_match(p_name, '.*[0-4]')::INT AS a, regexp_full_match(p_name, '.*[^0-4]')::INT AS b, regexp_full_match(p_brand, 'Brand#.[135]')::INT AS d FROM part",
    "part",
)
in_dialect(
    "byte_range",
    "SELECT `p_partkey`, CBYTE(`p_size` * 8) AS `b`, CBYTE(`p_size` / 4) AS `h` FROM `part`",
    "SELECT p_partkey, CASE WHEN p_size * 8 BETWEEN 0 AND 255 THEN p_size * 8 END::SMALLINT AS b, round_even(p_size / 4.0, 0)::SMALLINT AS h FROM part",
    "part",
)
in_dialect(
    "date_parameters",
    "SELECT `o_orderkey`, DATEDIFF('d', @start, `o_orderdate`) AS `n` FROM `orders` WHERE `o_orderdate` >= @start AND `o_orderdate` < @stop",
    "SELECT o_orderkey, date_diff('day', DATE '1996-01-01', o_orderdate::DATE)::INT AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-03-01'",
    "orders",
    args={"start": dt.datetime(1996, 1, 1), "stop": dt.datetime(1996, 3, 1)},
)
in_dialect("guid_literal", "SELECT `n_nationkey`, {01234567-89ab-cdef-0123-456789abcdef} AS `g` FROM `nation`", "SELECT n_nationkey, '01234567-89ab-cdef-0123-456789abcdef' AS g FROM nation", "nation")
in_dialect(
    "wildcards_in_data",
    "SELECT `x`.`k`, IIF(`x`.`s` LIKE '%[%]%', 1, 0) AS `p`, IIF(`x`.`s` LIKE '%[_]%', 1, 0) AS `u` FROM (SELECT `n_nationkey` AS `k`, IIF(`n_nationkey` MOD 3 = 0, '10%', IIF(`n_nationkey` MOD 3 = 1, 'a_b', 'ab')) AS `s` FROM `nation`) AS `x`",
    "SELECT n_nationkey AS k, (n_nationkey % 3 = 0)::INT AS p, (n_nationkey % 3 = 1)::INT AS u FROM nation",
    "nation",
)


# text, numbers, bytes, collections


@query("SELECT p_partkey, (CASE WHEN instr(substr(lower(p_type), 4), 'a') = 0 THEN -1 ELSE instr(substr(lower(p_type), 4), 'a') + 2 END)::INT AS i FROM part")
def str_indexof_from(t: Tables):
    return t.q("part").select("p_partkey", i=text.index_of(c("p_type"), "a", 3))


@query("SELECT p_partkey, round(sqrt(p_retailprice::FLOAT)::DOUBLE, 2) AS q, abs((-p_size)::FLOAT) AS a, (p_size::FLOAT / 2)::FLOAT AS h FROM part")
def math_single(t: Tables):
    return t.q("part").select("p_partkey", q=F.round(m.sqrt(convert.csng(c("p_retailprice"))).cast("double"), 2), a=m.absolute(convert.csng(-c("p_size"))), h=(convert.csng(c("p_size")) / 2).cast("float"))


@query("SELECT 36 AS length, 1 AS kinds, true AS ascending")
def guids(t: Tables):
    made = convert.sequential_guids(50, start=7)
    rows = t.q("nation").select(g=convert.new_guid())
    return rows.aggregate(length=F.max(F.length("g")), kinds=F.countDistinct("g").cast("int"), ascending=F.lit(made == sorted(made)))


@query("SELECT p_partkey, p_brand = 'Brand#11' AS same FROM part")
def bytes_sequence_equal(t: Tables):
    return t.q("part").select("p_partkey", same=binary.sequence_equal(c("p_brand").cast("binary"), b"Brand#11"))


@query("SELECT p_partkey, ((2 > p_size)::INT + (20 > p_size)::INT + (40 > p_size)::INT)::INT AS n FROM part WHERE ((2 > p_size)::INT + (20 > p_size)::INT + (40 > p_size)::INT) >= 1")
def inline_count(t: Tables):
    n = logic.count_in([2, 20, 40, None], lambda v: v > c("p_size"))
    return t.q("part").select("p_partkey", n=n).where("n >= 1")


@query("SELECT n_nationkey, '[' || n_regionkey || ',' || (n_regionkey + 1) || ']' AS all_of, n_regionkey = 2 AS same FROM nation")
def collection_whole(t: Tables):
    held = F.concat(F.lit("["), c("n_regionkey"), F.lit(","), c("n_regionkey") + 1, F.lit("]"))
    return t.q("nation").select("n_nationkey", all_of=held).extend(same=logic.collection_equal(c("all_of"), [2, 3])).select("n_nationkey", "all_of", "same")


@query("SELECT p_partkey, CASE WHEN p_size > 20 THEN 'large' ELSE 'small' END || '/' || p_size AS label FROM part")
def user_function(t: Tables):
    registry.define(t.spark, "size_label", {"n": "int"}, "string", "IIF(`n` > 20, 'large', 'small') & '/' & `n`")
    return t.q("part").select("p_partkey", label=F.call_function("size_label", c("p_size")))


# times


@query("WITH x AS (SELECT event_id, hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS s FROM events) SELECT event_id, (s // 3600 - 9)::BIGINT AS h, (s // 60 - 570)::BIGINT AS n, (s - 34200)::BIGINT AS s FROM x")
def span_diffs(t: Tables):
    s, start = temporal.time_of_day(c("ts")), F.lit(temporal.seconds("09:30:00"))
    return t.q("events").select("event_id", h=temporal.span_diff("h", start, s), n=temporal.span_diff("n", start, s), s=temporal.span_diff("s", start, s))


@query("SELECT event_id, hour(ts)::INT AS h, minute(ts)::INT AS mi, second(ts)::INT AS s, ((hour(ts) * 3600 + minute(ts) * 60 + second(ts) + 5400) % 86400)::INT AS later, ((hour(ts) * 3600 + minute(ts) * 60 + second(ts) + 79200) % 86400)::INT AS earlier FROM events")
def time_parts(t: Tables):
    s = temporal.time_of_day(c("ts"))
    return t.q("events").select("event_id", h=temporal.time_part("h", s), mi=temporal.time_part("n", s), s=temporal.time_part("s", s), later=temporal.time_add("n", 90, s), earlier=temporal.time_add("h", -2, s))


@query("SELECT o_orderkey, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS mo, day(o_orderdate)::INT AS d, dayofyear(o_orderdate)::INT AS dy, date_diff('day', DATE '0001-01-01', o_orderdate::DATE)::INT AS number FROM orders")
def date_only_parts(t: Tables):
    d = temporal.date_only(c("o_orderdate"))
    return t.q("orders").select("o_orderkey", y=temporal.date_part("yyyy", d), mo=temporal.date_part("m", d), d=temporal.date_part("d", d), dy=temporal.date_part("y", d), number=temporal.day_number(d))


@query("SELECT o_orderkey, (o_orderdate::DATE + INTERVAL 1 YEAR)::DATE AS y, (o_orderdate::DATE + INTERVAL 3 MONTH)::DATE AS mo, (o_orderdate::DATE - INTERVAL 10 DAY)::DATE AS d FROM orders")
def date_only_add(t: Tables):
    d = temporal.date_only(c("o_orderdate"))
    return t.q("orders").select("o_orderkey", y=temporal.date_only_add("yyyy", 1, d), mo=temporal.date_only_add("m", 3, d), d=temporal.date_only_add("d", -10, d))


@query("SELECT o_orderkey, strftime(o_orderdate::DATE + INTERVAL 34215 SECOND, '%Y-%m-%d %H:%M:%S') AS at FROM orders")
def date_and_time(t: Tables):
    at = temporal.to_datetime(temporal.date_only(c("o_orderdate")), temporal.seconds("09:30:15"))
    return t.q("orders").select("o_orderkey", at=F.date_format(at, "yyyy-MM-dd HH:mm:ss"))


@query("SELECT true AS now_is_late, true AS utc_is_near, true AS today_is_date")
def clock(t: Tables):
    return Query.one(
        t.spark, now_is_late=temporal.now() > F.lit(dt.datetime(2020, 1, 1)), utc_is_near=F.abs(temporal.unix_seconds(temporal.utc_now()) - F.unix_seconds(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()))) < 5,
        today_is_date=temporal.today() == F.to_date(temporal.now()),
    )


@query("SELECT DATE '2024-02-29' AS d, 34215 AS s, TIMESTAMP '2024-02-29 09:30:15' AS at")
def date_constants(t: Tables):
    d, s = temporal.date_serial(2024, 2, 29), temporal.seconds("09:30:15")
    return Query.one(t.spark, d=d, s=s, at=temporal.to_datetime(d, s))


@query("SELECT -1500 AS a, -1 AS b, -2 AS s")
def unix_time_before_1970(t: Tables):
    x = lambda text_: F.lit(text_).cast("timestamp")
    return Query.one(t.spark, a=temporal.unix_millis(x("1969-12-31 23:59:58.500 UTC")).cast("int"), b=temporal.unix_millis(x("1969-12-31 23:59:59.9995 UTC")).cast("int"), s=temporal.unix_seconds(x("1969-12-31 23:59:58.500 UTC")).cast("int"))


# statements and views of a store

_SHOP = (
    "CREATE TABLE `C` (`id` integer NOT NULL, `name` varchar(40) NOT NULL DEFAULT 'none', `bal` double, CONSTRAINT `PK` PRIMARY KEY (`id`));"
    "CREATE TABLE `O` (`id` integer PRIMARY KEY, `cust` integer, `status` varchar(4), CONSTRAINT `FK` FOREIGN KEY (`cust`) REFERENCES `C` (`id`) ON DELETE CASCADE, CONSTRAINT `CK` CHECK (`id` >= 0));"
    "CREATE INDEX `IX` ON `O` (`cust`, `status`)"
)


def _shop(t: Tables, name: str, rows: bool = True) -> Store:
    s = _store(t, name)
    s.execute(_SHOP)
    if rows:
        s.insert("C", t.customer.select(c("c_custkey").alias("id"), c("c_name").alias("name"), c("c_acctbal").alias("bal")))
        s.insert("O", t.orders.select(c("o_orderkey").alias("id"), c("o_custkey").alias("cust"), c("o_orderstatus").alias("status")))
    return s


def _view(name: str, columns: str, sql: str) -> None:
    def run(t: Tables):
        return _shop(t, name, rows=False).query(f"SELECT {columns} FROM `INFORMATION_SCHEMA.{name.removeprefix('info_schema_').upper()}`")

    run.__name__ = name
    query(sql)(run)


_view("info_schema_tables", "`TABLE_NAME`, `TABLE_TYPE`", "SELECT * FROM (VALUES ('C', 'BASE TABLE'), ('O', 'BASE TABLE')) v(TABLE_NAME, TABLE_TYPE)")
_view("info_schema_indexes", "`TABLE_NAME`, `INDEX_NAME`, `INDEX_TYPE`, `IS_UNIQUE`", "SELECT * FROM (VALUES ('C', 'PrimaryKey', 'PRIMARY', true), ('O', 'PrimaryKey', 'PRIMARY', true), ('O', 'IX', 'INDEX', false)) v(TABLE_NAME, INDEX_NAME, INDEX_TYPE, IS_UNIQUE)")
_view("info_schema_index_columns", "*", "SELECT * FROM (VALUES ('C', 'PrimaryKey', 0, 'id'), ('O', 'PrimaryKey', 0, 'id'), ('O', 'IX', 0, 'cust'), ('O', 'IX', 1, 'status')) v(TABLE_NAME, INDEX_NAME, ORDINAL_POSITION, COLUMN_NAME)")
_view("info_schema_relations", "*", "SELECT 'FK' AS RELATION_NAME, 'O' AS REFERENCING_TABLE_NAME, 'C' AS PRINCIPAL_TABLE_NAME, 'CASCADE' AS ON_DELETE")
_view("info_schema_relation_columns", "*", "SELECT 'FK' AS RELATION_NAME, 'cust' AS REFERENCING_COLUMN_NAME, 'id' AS PRINCIPAL_COLUMN_NAME, 0 AS ORDINAL_POSITION")
_view("info_schema_check_constraints", "*", "SELECT 'O' AS TABLE_NAME, 'CK' AS CONSTRAINT_NAME, '`id` >= 0' AS CHECK_CLAUSE")


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey = 7")
def exec_stored_query(t: Tables):
    s = _shop(t, "exec")
    s.procedures["ById"] = "SELECT `id`, `name` FROM `C` WHERE `id` = ?"
    return s.execute("EXEC `ById` @k", {"k": 7})


@query("SELECT o_orderkey AS id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def delete_cascades(t: Tables):
    s = _shop(t, "cascade")
    s.execute("DELETE FROM `C` WHERE `bal` < 0")
    return s.table("O").select("id")


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def delete_subquery(t: Tables):
    s = _shop(t, "subquery")
    s.execute("DELETE FROM `C` WHERE EXISTS (SELECT 1 FROM `O` AS `o` WHERE `o`.`cust` = `C`.`id` AND `o`.`status` = 'P')")
    return s.table("C").select("id")


@query("SELECT o_orderkey AS id FROM orders ORDER BY 1 OFFSET 25")
def delete_page(t: Tables):
    s = _shop(t, "page")
    s.execute("DELETE FROM `O` WHERE `id` IN (SELECT `x`.`id` FROM (SELECT TOP 25 `id` FROM `O` ORDER BY `id`) AS `x`)")
    return s.table("O").select("id")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus NOT IN ('F', 'P')")
def delete_union(t: Tables):
    s = _shop(t, "union")
    s.execute("DELETE FROM `O` WHERE `id` IN (SELECT `x`.`id` FROM (SELECT `id` FROM `O` WHERE `status` = 'F' UNION SELECT DISTINCT `id` FROM `O` WHERE `status` = 'P') AS `x`)")
    return s.table("O").select("id")


@query("SELECT * FROM (VALUES (1, NULL), (2, 4)) v(id, owner)")
def delete_sets_null(t: Tables):
    s = _store(t, "setnull")
    s.execute("CREATE TABLE `S` (`id` integer PRIMARY KEY, `boss` integer); CREATE TABLE `D` (`id` integer PRIMARY KEY, `owner` integer, CONSTRAINT `FD` FOREIGN KEY (`owner`) REFERENCES `S` (`id`) ON DELETE SET NULL)")
    s.insert("S", [{"id": 1, "boss": None}, {"id": 2, "boss": 1}, {"id": 3, "boss": 2}, {"id": 4, "boss": None}])
    s.insert("D", [{"id": 1, "owner": 3}, {"id": 2, "owner": 4}])
    s.add_foreign_key("FB", "S", ["boss"], "S", ["id"], "CASCADE")
    s.execute("DELETE FROM `S` WHERE `id` = 1")
    return s.table("D")


@query("SELECT o_orderkey AS id, CASE WHEN c_acctbal > 0 AND n_regionkey < 2 THEN 'x' ELSE o_orderstatus END AS status, o_custkey::INT AS cust FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def update_joins(t: Tables):
    s = _shop(t, "joins")
    s.create_table("N", {"c": "integer", "region": "integer"})
    s.insert("N", t.customer.join(t.nation, c("c_nationkey") == c("n_nationkey")).select(c("c_custkey").alias("c"), c("n_regionkey").alias("region")))
    s.execute("UPDATE `O` AS `o` INNER JOIN `C` AS `k` ON `o`.`cust` = `k`.`id` INNER JOIN `N` AS `n` ON `n`.`c` = `k`.`id` SET `o`.`status` = 'x' WHERE `k`.`bal` > 0 AND `n`.`region` < 2")
    return s.table("O").select("id", "status", "cust")


@query("SELECT 'key' AS what, true AS refused UNION ALL SELECT 'concurrency', true UNION ALL SELECT 'check', true UNION ALL SELECT 'null', true UNION ALL SELECT 'parent', true UNION ALL SELECT 'duplicate', true")
def refused_changes(t: Tables):
    s = _shop(t, "refused")
    tries = {
        "key": lambda: s.execute("UPDATE `C` SET `id` = `id` + 1000000"),
        "concurrency": lambda: s.update("C", {"name": F.lit("x")}, "id = -1", expect=1),
        "check": lambda: s.execute("INSERT INTO `O` (`id`) VALUES (-5)"),
        "null": lambda: s.execute("UPDATE `C` SET `name` = NULL"),
        "parent": lambda: s.execute("INSERT INTO `O` (`id`, `cust`) VALUES (99000000, 98000000)"),
        "duplicate": lambda: s.execute("INSERT INTO `C` (`id`) VALUES (1)"),
    }
    out = []
    for what, change in tries.items():
        try:
            change()
            out.append((what, False))
        except (StoreError, ConcurrencyError):
            out.append((what, True))
    return t.spark.createDataFrame(out, "what string, refused boolean")


@query("SELECT * FROM (VALUES (1, 'a;b', 3), (2, 'none', 3)) v(id, name, last)")
def batch_statements(t: Tables):
    s = _store(t, "batch")
    s.execute(
        "-- a tag; with a semicolon\nCREATE TABLE `B` (`id` counter(1,1) NOT NULL, `name` varchar(9) DEFAULT 'none', CONSTRAINT `PK` PRIMARY KEY (`id`));"
        "INSERT INTO `B` (`name`) VALUES ('a;b'); INSERT INTO `B` (`id`) VALUES (2); INSERT INTO `B` (`name`) VALUES ('z');"
        "IF NOT EXISTS (SELECT * FROM `INFORMATION_SCHEMA.TABLES` WHERE `TABLE_NAME` = 'B') THEN DROP TABLE `B`; IF EXISTS (SELECT * FROM `B` WHERE `name` = 'z') THEN DELETE FROM `B` WHERE `name` = 'z'"
    )
    return s.table("B").withColumn("last", F.lit(s.identity))


@query("SELECT n_nationkey AS id, n_name AS title, 7 AS years FROM nation")
def schema_changes(t: Tables):
    s = _store(t, "schema")
    s.create_table("A", {"id": "integer", "name": "varchar(40)", "junk": "integer"}, ["id"])
    s.insert("A", t.nation.select(c("n_nationkey").alias("id"), c("n_name").alias("name")))
    s.execute(
        "ALTER TABLE `A` ADD COLUMN `age` integer; ALTER TABLE `A` ALTER COLUMN `age` integer NOT NULL DEFAULT 7; ALTER TABLE `A` DROP COLUMN `junk`; RENAME COLUMN `A`.`age` TO `years`;"
        "RENAME COLUMN `A`.`name` TO `title`; CREATE UNIQUE INDEX `IX` ON `A` (`title`); DROP INDEX `IX` ON `A`; RENAME TABLE `A` TO `B`"
    )
    return s.table("B")


@query("SELECT * FROM (VALUES ('B', 'id', 'PrimaryKey'), ('B', 'a', 'U')) v(TABLE_NAME, COLUMN_NAME, INDEX_NAME)")
def key_changes(t: Tables):
    s = _store(t, "keys")
    s.execute("CREATE TABLE `A` (`id` integer PRIMARY KEY); CREATE TABLE `B` (`id` integer, `a` integer)")
    s.execute("ALTER TABLE `B` ADD CONSTRAINT `PrimaryKey` PRIMARY KEY (`id`); ALTER TABLE `B` ADD CONSTRAINT `F` FOREIGN KEY (`a`) REFERENCES `A` (`id`) ON DELETE RESTRICT; CREATE UNIQUE INDEX `U0` ON `B` (`a`)")
    s.rename_index("B", "U0", "U")
    s.execute("ALTER TABLE `B` DROP CONSTRAINT `F`; DROP TABLE `A`")
    return s.query("SELECT `TABLE_NAME`, `COLUMN_NAME`, `INDEX_NAME` FROM `INFORMATION_SCHEMA.INDEX_COLUMNS`")


@query("SELECT n_nationkey AS x, n_nationkey * 2 AS y, 2 AS steps, 0 AS again FROM nation")
def migrations(t: Tables):
    s = _store(t, "migrate")
    steps = [
        ("one", lambda x: (x.create_table("M", {"x": "integer"}), x.insert("M", t.nation.select(c("n_nationkey").alias("x"))))),
        ("two", lambda x: (x.add_column("M", "y", "integer"), x.execute("UPDATE `M` SET `y` = `x` * 2"))),
    ]
    first, again = s.migrate(steps), s.migrate(steps)
    return s.table("M").select("x", "y", F.lit(len(first)).alias("steps"), F.lit(len(again)).alias("again"))


@query("SELECT * FROM (VALUES ('C', 'id', 'int', false, true, ''), ('C', 'name', 'string', false, false, ''), ('C', 'bal', 'double', true, false, ''), ('O', 'id', 'int', false, true, ''), ('O', 'cust', 'int', true, false, 'C'), ('O', 'status', 'string', true, false, '')) v(t, col, kind, nullable, key, refers)")
def reverse_engineering(t: Tables):
    out = []
    for name, e in _shop(t, "scaffold", rows=False).scaffold().items():
        refers = {k: f["principal"] for f in e["foreign_keys"].values() for k in f["columns"]}
        out += [(name, x["name"], x["type"], x["nullable"], x["name"] in e["primary_key"], refers.get(x["name"], "")) for x in e["columns"]]
    return t.spark.createDataFrame(out, "t string, col string, kind string, nullable boolean, key boolean, refers string")


@query("SELECT true AS made, true AS again_refused, false AS left_over")
def database_statements(t: Tables):
    root = _store(t, "database").root + "-db"
    made = database(t.spark, f"CREATE DATABASE '{root}'").exists()
    try:
        database(t.spark, f"CREATE DATABASE '{root}'")
        refused = False
    except StoreError:
        refused = True
    store = Store(t.spark, root)
    database(t.spark, f"DROP DATABASE '{root}'")
    return t.spark.createDataFrame([(made, refused, store.exists())], "made boolean, again_refused boolean, left_over boolean")


# models and options


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 3")
def parameterised_filter(t: Tables):
    return model.Model(nation=t.nation).filter("nation", lambda region: c("n_regionkey") == region).read("nation", region=3).select("n_nationkey", "n_name")


@query("SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def keyless_view(t: Tables):
    t.customer.join(t.nation, c("c_nationkey") == c("n_nationkey")).createOrReplaceTempView("customer_nation")
    return Query.sql(t.spark, "SELECT n_name, count(*) AS n FROM customer_nation GROUP BY n_name")


@query("SELECT r_name, 'report' AS tag FROM region")
def query_tags(t: Tables):
    with model.tagged(t.spark, "report"):
        tag = t.spark.sparkContext.getLocalProperty("spark.job.description")
    return t.q("region").select("r_name", tag=tag)


@query("SELECT true AS refused, 5 AS paged, 255 AS short, 3 AS tries")
def option_switches(t: Tables):
    rows = t.q("orders").order_by("o_orderkey")
    with options.options(skip_alone=False):
        paged = rows.skip(3).take(5).df.count()
        try:
            _ = rows.skip(3).df
            refused = False
        except QueryError:
            refused = True
    from quillon.types import store_type

    with options.options(short_text=True):
        short = store_type("varchar").length
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("busy")

    with options.options(retries=2):
        options.retrying(flaky, lambda e: isinstance(e, OSError), 0.0)
    return t.spark.createDataFrame([(refused, paged, short, len(tries))], "refused boolean, paged int, short int, tries int")
