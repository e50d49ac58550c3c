"""A store: a folder of tables with their definitions, changed by whole new versions.

The definitions are ``<root>/_store-<n>.json``; the largest n holds.  A table is a list of parts (Parquet folders under ``<root>/<table>``): an insert adds
a part, other changes replace the list.  A change writes its parts first and then one new file of definitions, however many tables it touches, so
readers see either the old or the new store, a failed job changes nothing and two writers cannot both win.  Parts that a change replaces are removed by
the table's next change.  The root may be any file system that Spark can write.  Keys, foreign keys and checks are validated as sets when they are
added or a statement changes rows.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.plans import dialect
from quillon.types import IDENTITY, default_of, store_type


class StoreError(ValueError):
    pass


class ConcurrencyError(StoreError):
    """A statement touched another number of rows than expected."""


def _matching(rows: DataFrame, keys: DataFrame, on: list[str], how: str, null_safe: bool = False) -> DataFrame:
    """Rows that (``left_semi``) stand in ``keys`` by the columns ``on``, or (``left_anti``) do not."""
    named = keys.select(*[F.col(f"`{c}`").alias(f"key__{i}") for i, c in enumerate(on)])
    pairs = [(F.col(f"`{c}`"), F.col(f"key__{i}")) for i, c in enumerate(on)]
    return rows.join(named, [a.eqNullSafe(b) if null_safe else a == b for a, b in pairs], how)


class Store:
    """``CREATE``/``ALTER``/``DROP``, ``INSERT``/``UPDATE``/``DELETE``, queries and catalog views over one root."""

    def __init__(self, spark: SparkSession, root: str, create: bool = False) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.identity: int | None = None
        self.rowcount = 0
        self.procedures: dict[str, str] = {}
        if create:
            if self.exists():
                raise StoreError(f"{root} exists")
            self._save({"tables": {}, "relations": {}, "history": []})
        elif not self.exists():
            raise StoreError(f"{root} does not exist")

    # files

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _remove(self, *paths: str) -> None:
        for path in paths:
            fs, p = self._fs(path)
            fs.delete(p, True)

    def _numbers(self) -> list[int]:
        fs, p = self._fs(self.root)
        if not fs.exists(p):
            return []
        found = (re.fullmatch(r"_store-(\d+)\.json", s.getPath().getName()) for s in fs.listStatus(p))
        return sorted(int(m[1]) for m in found if m)

    def exists(self) -> bool:
        return bool(self._numbers())

    def drop(self) -> None:
        self._remove(self.root)

    def _state(self) -> dict:
        number = self._numbers()[-1]
        fs, p = self._fs(f"{self.root}/_store-{number}.json")
        stream = fs.open(p)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text) | {"number": number}

    def _save(self, state: dict) -> None:
        """The next file of definitions; the one before stays for readers that have just found it."""
        number = state.get("number", 0) + 1
        fs, p = self._fs(f"{self.root}/_store-{number}.json")
        _, new = self._fs(f"{self.root}/_new-{uuid.uuid4().hex}")
        stream = fs.create(new, True)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        if fs.exists(p) or not fs.rename(new, p):
            fs.delete(new, False)
            raise StoreError("another writer changed the store")
        state["number"] = number
        self._remove(*[f"{self.root}/_store-{n}.json" for n in self._numbers() if n < number - 1])

    # tables

    def tables(self) -> list[str]:
        return sorted(self._state()["tables"])

    def table(self, name: str) -> DataFrame:
        return self._rows(self._state(), name)

    def _rows(self, state: dict, name: str) -> DataFrame:
        entry = self._entry(state, name)
        schema = _schema(entry)
        if not entry["parts"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{p}" for p in entry["parts"]])

    def _entry(self, state: dict, name: str) -> dict:
        if name not in state["tables"]:
            raise StoreError(f"no table {name}")
        return state["tables"][name]

    def _part(self, state: dict, name: str, rows: DataFrame) -> str:
        """Rows written as a new part of a table that no definitions name yet."""
        part = f"{name}/{uuid.uuid4().hex}"
        schema = _schema(self._entry(state, name))
        rows.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in schema.fields]).write.parquet(f"{self.root}/{part}")
        return part

    def _write(self, state: dict, changes: dict[str, DataFrame], check: bool = True) -> None:
        """New contents of some tables, as one change."""
        replaced: list[str] = []
        for name, rows in changes.items():
            entry = self._entry(state, name)
            part = self._part(state, name, rows)
            replaced += entry.get("replaced", [])
            entry["replaced"], entry["parts"] = entry["parts"], [part]
        if check:
            for name in changes:
                rows = self._rows(state, name)
                self._validate(state, name, rows, rows)
                self._unreferenced(state, name, rows)
        self._save(state)
        self._remove(*[f"{self.root}/{p}" for p in replaced])

    def _validate(self, state: dict, name: str, rows: DataFrame, new: DataFrame, old: DataFrame | None = None) -> None:
        """The constraints of ``name``, whose rows are ``rows``; only ``new`` ones can break them. ``old``: the others, if known."""
        entry = state["tables"][name]
        for c in entry["columns"]:
            if not c["nullable"] and new.where(F.col(f"`{c['name']}`").isNull()).limit(1).count():
                raise StoreError(f"{name}.{c['name']} has nulls")
        for index, i in entry["indexes"].items():
            if i["unique"] and new.groupBy(*[f"`{c}`" for c in i["columns"]]).count().where("count > 1").limit(1).count():
                raise StoreError(f"{index} has duplicate keys")
            if i["unique"] and old is not None and _matching(new, old, i["columns"], "left_semi", True).limit(1).count():
                raise StoreError(f"{index} has duplicate keys")
        for check, text in entry["checks"].items():
            if new.where(~F.coalesce(F.expr(dialect.translate_expression(text)), F.lit(True))).limit(1).count():
                raise StoreError(f"rows break {check}")
        for rel, r in state["relations"].items():
            if r["table"] == name:
                parent = rows if r["principal"] == name else self._rows(state, r["principal"])
                parent = parent.select(*[F.col(f"`{p}`").alias(c) for p, c in zip(r["principal_columns"], r["columns"], strict=True)])
                if _matching(new.dropna(subset=r["columns"]), parent, r["columns"], "left_anti").limit(1).count():
                    raise StoreError(f"rows break {rel}")

    def _unreferenced(self, state: dict, name: str, rows: DataFrame) -> None:
        """No row of another table refers to a key that ``name`` no longer holds."""
        for rel, r in state["relations"].items():
            if r["principal"] == name and r["table"] != name:
                child = self._rows(state, r["table"]).select(*[F.col(f"`{c}`").alias(p) for c, p in zip(r["columns"], r["principal_columns"], strict=True)]).dropna()
                if _matching(child, rows, r["principal_columns"], "left_anti").limit(1).count():
                    raise StoreError(f"rows are referenced by {rel}")

    # definitions

    def create_table(self, name: str, columns: dict[str, str], primary_key: list[str] | None = None) -> None:
        """``columns``: name to definition, as ``counter(1,1)``, ``varchar(40) NOT NULL DEFAULT 'x'``."""
        state = self._state()
        if name in state["tables"]:
            raise StoreError(f"{name} exists")
        entry = {"columns": [_column(c, d) for c, d in columns.items()], "parts": [], "indexes": {}, "checks": {}}
        state["tables"][name] = entry
        if primary_key:
            entry["indexes"]["PrimaryKey"] = {"columns": primary_key, "unique": True, "primary": True}
            for c in entry["columns"]:
                c["nullable"] = c["nullable"] and c["name"] not in primary_key
        self._save(state)

    def rename_table(self, name: str, new: str) -> None:
        """Only the definitions change: parts keep their place."""
        state = self._state()
        entry = self._entry(state, name)
        if new in state["tables"]:
            raise StoreError(f"{new} exists")
        state["tables"][new] = entry
        del state["tables"][name]
        for r in state["relations"].values():
            r["table"] = new if r["table"] == name else r["table"]
            r["principal"] = new if r["principal"] == name else r["principal"]
        self._save(state)

    def drop_table(self, name: str) -> None:
        state = self._state()
        entry = self._entry(state, name)
        if any(r["principal"] == name and r["table"] != name for r in state["relations"].values()):
            raise StoreError(f"{name} is referenced")
        del state["tables"][name]
        state["relations"] = {k: r for k, r in state["relations"].items() if r["table"] != name}
        self._save(state)
        self._remove(*[f"{self.root}/{p}" for p in entry["parts"] + entry.get("replaced", [])])

    def add_column(self, table: str, name: str, definition: str) -> None:
        state = self._state()
        rows = self._rows(state, table)
        c = _column(name, definition)
        self._entry(state, table)["columns"].append(c)
        fill = F.expr(dialect.translate_expression(c["default"])) if c["default"] else F.lit(None) if c["nullable"] else default_of(store_type(c["type"]))
        if c["identity"]:
            stage, rows = self._numbered(rows, name, *c["identity"])
            self._write(state, {table: rows})
            self._remove(stage)
        else:
            self._write(state, {table: rows.withColumn(name, fill)})

    def alter_column(self, table: str, name: str, definition: str) -> None:
        """Another type; a column that becomes NOT NULL has its nulls filled with the default first."""
        state = self._state()
        rows = self._rows(state, table)
        c = _column(name, definition)
        entry = self._entry(state, table)
        i = [x["name"] for x in entry["columns"]].index(name)
        entry["columns"][i] = c
        value = F.col(f"`{name}`").cast(store_type(c["type"]))
        if not c["nullable"]:
            value = F.coalesce(value, F.expr(dialect.translate_expression(c["default"])) if c["default"] else default_of(store_type(c["type"])))
        self._write(state, {table: rows.withColumn(name, value)})

    def drop_column(self, table: str, name: str) -> None:
        state = self._state()
        rows, entry = self._rows(state, table), self._entry(state, table)
        if any(name in i["columns"] for i in entry["indexes"].values()):
            raise StoreError(f"{name} is indexed")
        entry["columns"] = [c for c in entry["columns"] if c["name"] != name]
        self._write(state, {table: rows.drop(name)})

    def rename_column(self, table: str, name: str, new: str) -> None:
        state = self._state()
        rows, entry = self._rows(state, table), self._entry(state, table)
        swap = lambda names: [new if x == name else x for x in names]
        for c in entry["columns"]:
            c["name"] = new if c["name"] == name else c["name"]
        for i in entry["indexes"].values():
            i["columns"] = swap(i["columns"])
        for r in state["relations"].values():
            r["columns"] = swap(r["columns"]) if r["table"] == table else r["columns"]
            r["principal_columns"] = swap(r["principal_columns"]) if r["principal"] == table else r["principal_columns"]
        self._write(state, {table: rows.withColumnRenamed(name, new)})

    def create_index(self, table: str, name: str, columns: list[str], unique: bool = False, primary: bool = False) -> None:
        state = self._state()
        entry = self._entry(state, table)
        entry["indexes"][name] = {"columns": columns, "unique": unique or primary, "primary": primary}
        rows = self._rows(state, table)
        self._validate(state, table, rows, rows)
        self._save(state)

    def drop_index(self, table: str, name: str) -> None:
        state = self._state()
        if self._entry(state, table)["indexes"].pop(name, None) is None:
            raise StoreError(f"no index {name}")
        self._save(state)

    def rename_index(self, table: str, name: str, new: str) -> None:
        state = self._state()
        indexes = self._entry(state, table)["indexes"]
        indexes[new] = indexes.pop(name)
        self._save(state)

    def add_check(self, table: str, name: str, condition: str) -> None:
        state = self._state()
        self._entry(state, table)["checks"][name] = condition
        rows = self._rows(state, table)
        self._validate(state, table, rows, rows)
        self._save(state)

    def add_foreign_key(self, name: str, table: str, columns: list[str], principal: str, principal_columns: list[str], on_delete: str = "NO ACTION") -> None:
        """RESTRICT is NO ACTION; CASCADE and SET NULL act when a principal row is deleted."""
        state = self._state()
        self._entry(state, principal)
        action = " ".join({"RESTRICT": "NO ACTION"}.get(on_delete.strip().upper(), on_delete.upper()).split())
        if action not in ("NO ACTION", "CASCADE", "SET NULL"):
            raise StoreError(f"no action {on_delete}")
        state["relations"][name] = {"table": table, "columns": columns, "principal": principal, "principal_columns": principal_columns, "on_delete": action}
        rows = self._rows(state, table)
        self._validate(state, table, rows, rows)
        self._save(state)

    def drop_foreign_key(self, name: str) -> None:
        state = self._state()
        if state["relations"].pop(name, None) is None:
            raise StoreError(f"no relation {name}")
        self._save(state)

    def model(self) -> dict[str, T.StructType]:
        """Tables as Spark schemas, with nullability."""
        return {n: T.StructType([T.StructField(c["name"], store_type(c["type"]), c["nullable"]) for c in e["columns"]]) for n, e in self._state()["tables"].items()}

    def scaffold(self) -> dict[str, dict]:
        """The model that the store's definitions describe: columns, keys, indexes, relations and the navigations that these give."""
        state = self._state()
        out = {}
        for name, entry in state["tables"].items():
            mine = {k: r for k, r in state["relations"].items() if r["table"] == name}
            theirs = {k: r for k, r in state["relations"].items() if r["principal"] == name}
            unique = {tuple(i["columns"]) for i in entry["indexes"].values() if i["unique"]}
            out[name] = {
                "columns": [{"name": c["name"], "store_type": c["type"], "type": store_type(c["type"]).simpleString(), "nullable": c["nullable"], "default": c["default"], "identity": c["identity"], "size": c["size"]} for c in entry["columns"]],
                "primary_key": next((i["columns"] for i in entry["indexes"].values() if i["primary"]), None),
                "indexes": {k: {"columns": i["columns"], "unique": i["unique"]} for k, i in entry["indexes"].items() if not i["primary"]},
                "foreign_keys": {k: {"columns": r["columns"], "principal": r["principal"], "principal_columns": r["principal_columns"], "on_delete": r["on_delete"]} for k, r in mine.items()},
                "references": {k: r["principal"] for k, r in mine.items()},
                "collections": {k: r["table"] for k, r in theirs.items() if tuple(r["columns"]) not in {tuple(i["columns"]) for i in state["tables"][r["table"]]["indexes"].values() if i["unique"]}},
                "one_to_one": sorted(k for k, r in mine.items() if tuple(r["columns"]) in unique),
                "checks": entry["checks"],
            }
        return out

    # rows

    def _numbered(self, rows: DataFrame, name: str, seed: int, step: int) -> tuple[str, DataFrame]:
        """Rows with an identity by their own order of values, and the folder they were staged in.

        Rows are sorted by ranges and written with their position in a partition; an identity is that plus the sizes of the partitions before, so no task holds all.
        """
        stage = f"{self.root}/_stage-{uuid.uuid4().hex}"
        keys = [F.col(f"`{c}`") for c in rows.columns]
        place = F.monotonically_increasing_id()
        (rows.orderBy(*keys) if keys else rows).withColumn("place__", place).write.parquet(stage)
        staged = self.spark.read.parquet(stage)
        part = F.shiftright("place__", 33)
        sizes = {r[0]: r[1] for r in staged.groupBy(part.alias("part")).count().collect()}
        before, starts = 0, []
        for p in sorted(sizes):
            starts.append((p, before))
            before += sizes[p]
        offsets = self.spark.createDataFrame(starts, "part__ long, before__ long")
        joined = staged.join(F.broadcast(offsets), part == F.col("part__"))
        number = F.lit(seed) + (F.col("before__") + F.col("place__").bitwiseAND((1 << 33) - 1)) * step
        return stage, joined.withColumn(name, number).select(*keys, f"`{name}`")

    def insert(self, table: str, rows: DataFrame | list[dict]) -> int:
        """Appends rows as a new part; identities and defaults are filled. ``identity`` is the last one given, ``rowcount`` the rows added."""
        state = self._state()
        entry = self._entry(state, table)
        schema = _schema(entry)
        if isinstance(rows, list):
            names = [f.name for f in schema.fields if any(f.name in r for r in rows)]
            kinds = T.StructType([T.StructField(n, schema[n].dataType) for n in names])
            rows = self.spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], kinds) if names else self.spark.range(len(rows)).select()
        old = self._rows(state, table)
        stages = []
        for c in sorted(entry["columns"], key=lambda c: c["identity"] is None):
            if c["name"] in rows.columns:
                continue
            if c["identity"]:
                seed, step = c["identity"]
                top = old.agg(F.max(f"`{c['name']}`")).first()[0]
                stage, rows = self._numbered(rows, c["name"], seed if top is None else top + step, step)
                stages.append(stage)
            else:
                rows = rows.withColumn(c["name"], F.expr(dialect.translate_expression(c["default"])) if c["default"] else F.lit(None).cast(store_type(c["type"])))
        part = self._part(state, table, rows)
        self._remove(*stages)
        new = self.spark.read.schema(schema).parquet(f"{self.root}/{part}")
        entry["parts"] = [*entry["parts"], part]
        try:
            self._validate(state, table, self._rows(state, table), new, old)
        except StoreError:
            self._remove(f"{self.root}/{part}")
            raise
        key = next((c["name"] for c in entry["columns"] if c["identity"]), None)
        row = new.agg(F.count(F.lit(1)), F.max(f"`{key}`") if key else F.lit(None)).first()
        self._save(state)
        self.rowcount = row[0]
        if key and row[0]:
            self.identity = row[1]
        return row[0]

    def identity_columns(self, state: dict, table: str) -> list[str]:
        """The columns that tell a row: the primary key's, or all."""
        entry = self._entry(state, table)
        return next((i["columns"] for i in entry["indexes"].values() if i["primary"]), None) or [c["name"] for c in entry["columns"]]

    def delete(self, table: str, condition: Column | str | None = None, keys: DataFrame | None = None, on: list[str] | None = None, expect: int | None = None, null_safe: bool = False) -> int:
        """Rows for which the condition is true, or whose ``on`` columns stand in ``keys``, go.

        Rows that refer to them go too (CASCADE), lose the reference (SET NULL) or forbid the change, to any depth and also within one table; all
        tables change at once.
        """
        state = self._state()
        rows = self._rows(state, table)
        if keys is not None:
            hit = _matching(rows, keys, on, "left_semi", null_safe)
        else:
            hit = rows.where(F.lit(True) if condition is None else F.coalesce(F.expr(condition) if isinstance(condition, str) else condition, F.lit(False)))
        stages: list[str] = []

        def staged(df: DataFrame) -> DataFrame:
            stages.append(f"{self.root}/_stage-{uuid.uuid4().hex}")
            df.write.parquet(stages[-1])
            return self.spark.read.schema(df.schema).parquet(stages[-1])

        try:
            hit = staged(hit)
            n = hit.count()
            self._expect(n, expect)
            self.rowcount = n
            if not n:
                return 0
            gone: dict[str, list[DataFrame]] = {table: [hit]}
            queue = [(table, hit)]
            while queue:
                parent, lost = queue.pop()
                for r in state["relations"].values():
                    if r["principal"] == parent and r["on_delete"] == "CASCADE":
                        child = r["table"]
                        found = _matching(self._rows(state, child), _keys_of(lost, r), r["columns"], "left_semi")
                        for known in gone.get(child, []):
                            found = _matching(found, known, self.identity_columns(state, child), "left_anti", True)
                        found = staged(found)
                        if found.limit(1).count():
                            gone.setdefault(child, []).append(found)
                            queue.append((child, found))
            kept = {t: reduce(lambda df, lost, t=t: _matching(df, lost, self.identity_columns(state, t), "left_anti", True), lost, self._rows(state, t)) for t, lost in gone.items()}
            for rel, r in state["relations"].items():
                if r["principal"] not in gone or r["on_delete"] == "CASCADE":
                    continue
                lost = reduce(DataFrame.unionByName, [_keys_of(x, r) for x in gone[r["principal"]]]).distinct()
                child = kept.get(r["table"], self._rows(state, r["table"]))
                if r["on_delete"] == "SET NULL":
                    marked = lost.select(*[F.col(f"`{c}`").alias(f"key__{i}") for i, c in enumerate(r["columns"])], F.lit(True).alias("lost__"))
                    on = [F.col(f"`{c}`") == F.col(f"key__{i}") for i, c in enumerate(r["columns"])]
                    joined = child.join(marked, on, "left")
                    kept[r["table"]] = joined.select(*[F.when(F.col("lost__"), F.lit(None)).otherwise(F.col(f"`{c}`")).alias(c) if c in r["columns"] else F.col(f"`{c}`") for c in child.columns])
                elif _matching(child, lost, r["columns"], "left_semi").limit(1).count():
                    raise StoreError(f"rows are referenced by {rel}")
            nulled = [t for t in kept if t not in gone]
            self._write(state, kept, check=bool(nulled))
            return n
        finally:
            self._remove(*stages)

    def update(self, table: str, setters: dict[str, Any], condition: Column | str | None = None, source: DataFrame | None = None, on: list[str] | None = None, expect: int | None = None) -> int:
        """Sets columns where the condition holds; with ``source``, of rows that it matches on ``on`` (its other columns may be used).

        A row that several source rows match takes one of them, the least.  A key that other rows refer to cannot change.
        """
        state = self._state()
        rows = self._rows(state, table)
        names = rows.columns
        hit = F.lit(True) if condition is None else F.coalesce(F.expr(condition) if isinstance(condition, str) else condition, F.lit(False))
        if source is not None:
            others = [c for c in source.columns if c not in on]
            once = source.groupBy(*on).agg(F.min(F.struct(F.lit(True).alias("match__"), *others)).alias("source__"))
            rows = rows.join(once, on, "left").select(*[f"`{c}`" for c in names], *[F.col(f"source__.{c}").alias(c) for c in others], F.coalesce("source__.match__", F.lit(False)).alias("match__"))
            hit = hit & F.col("match__")
        rows = rows.withColumn("hit__", hit)
        n = rows.where("hit__").count()
        self._expect(n, expect)
        value = lambda v: F.expr(v) if isinstance(v, str) else v if isinstance(v, Column) else F.lit(v)
        out = [F.when(F.col("hit__"), value(setters[c])).otherwise(F.col(f"`{c}`")).alias(c) if c in setters else F.col(f"`{c}`") for c in names]
        self._write(state, {table: rows.select(*out)})
        self.rowcount = n
        return n

    @staticmethod
    def _expect(n: int, expect: int | None) -> None:
        if expect is not None and n != expect:
            raise ConcurrencyError(f"expected {expect} rows, found {n}")

    # history of changes

    def migrate(self, steps: list[tuple[str, Callable[[Store], None]]], stale_seconds: int = 3600) -> list[str]:
        """Runs the steps that the history lacks, in order, and notes each. The lock is a file that one caller can make; one older than ``stale_seconds`` is broken."""
        fs, lock = self._fs(f"{self.root}/_migration.lock")
        if fs.exists(lock):
            age = self.spark.sparkContext._jvm.System.currentTimeMillis() - fs.getFileStatus(lock).getModificationTime()
            if age > 1000 * stale_seconds:
                fs.delete(lock, False)
        if not fs.createNewFile(lock):
            raise StoreError("another migration runs")
        done = []
        try:
            for name, step in steps:
                if name not in self._state()["history"]:
                    step(self)
                    state = self._state()
                    state["history"].append(name)
                    self._save(state)
                    done.append(name)
        finally:
            fs.delete(lock, False)
        return done

    # SQL

    def query(self, sql: str, args: dict | list | None = None) -> DataFrame:
        view = re.search(r"[`\[]?INFORMATION_SCHEMA\.(\w+)[`\]]?", sql, re.I)
        if view:
            from quillon.sources.catalog import view_of

            sql = sql.replace(view[0], f"`catalog_{view[1].lower()}`")
            view_of(self, view[1].lower()).createOrReplaceTempView(f"catalog_{view[1].lower()}")
        self.register()
        return dialect.rows(self.spark, sql, args)

    def register(self) -> None:
        """The tables as views of the session."""
        state = self._state()
        for name in state["tables"]:
            self._rows(state, name).createOrReplaceTempView(name)

    def execute(self, sql: str, args: dict | list | None = None) -> DataFrame | int | None:
        """A batch of statements; the last one's rows or row count."""
        out: DataFrame | int | None = None
        for statement in dialect.split_batch(sql):
            branch = dialect.split_condition(statement)
            if branch:
                wanted, probe, statement = branch
                if (self.query(probe, args).limit(1).count() > 0) != wanted:
                    continue
            out = self._statement(statement, args)
        return out

    def _statement(self, sql: str, args: dict | list | None) -> DataFrame | int | None:
        word = sql.split(None, 1)[0].upper()
        if word in ("SELECT", "("):
            m = re.fullmatch(r"SELECT\s+@@(IDENTITY|ROWCOUNT)\s*", sql, re.I)
            if m:
                return self.spark.createDataFrame([(self.identity if m[1].upper() == "IDENTITY" else self.rowcount,)], "value long")
            return self.query(sql, args)
        if word == "EXEC":
            name, *values = [x.strip() for x in re.split(r"[\s,]+", sql[4:].strip())]
            template = self.procedures[name.strip("`[]")]
            return self.query(template, [_constant(v, args) for v in values])
        from quillon.plans.statements import run

        return run(self, sql, args)


def _keys_of(parent: DataFrame, relation: dict) -> DataFrame:
    """A relation's principal keys under the names of the columns that refer to them."""
    return parent.select(*[F.col(f"`{p}`").alias(c) for p, c in zip(relation["principal_columns"], relation["columns"], strict=True)])


def _constant(text: str, args: Any) -> Any:
    if text.startswith("@") and isinstance(args, dict):
        return args[text[1:]]
    if text.startswith("'"):
        return text[1:-1].replace("''", "'")
    return float(text) if "." in text else int(text)


def _column(name: str, definition: str) -> dict:
    m = re.fullmatch(r"\s*([a-z][a-z0-9 ]*?(?:\s*\([\d\s,]+\))?)\s*(NOT\s+NULL|NULL)?\s*(?:DEFAULT\s+(.+?))?\s*(NOT\s+NULL|NULL)?\s*", definition, re.I | re.S)
    if not m:
        raise StoreError(f"not a column definition: {definition!r}")
    kind = m[1].strip()
    base = re.match(r"[a-z0-9 ]+", kind.lower())[0].strip()
    numbers = [int(x) for x in re.findall(r"\d+", kind.partition("(")[2])]
    store_type(kind)
    identity = ([*numbers, *[1, 1][len(numbers) :]] if base in IDENTITY else None)
    no_null = any(x and x.upper().startswith("NOT") for x in (m[2], m[4]))
    return {"name": name, "type": kind, "nullable": not no_null, "default": m[3], "identity": identity, "size": numbers[0] if numbers and "char" in base else None}


def _schema(entry: dict) -> T.StructType:
    return T.StructType([T.StructField(c["name"], store_type(c["type"]), True) for c in entry["columns"]])
