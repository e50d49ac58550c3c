"""Catalog views of a store, as DataFrames to filter and order."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame

from quillon.types import store_type

if TYPE_CHECKING:
    from quillon.sources.store import Store

#: Columns of the views.
VIEWS = {
    "tables": "TABLE_NAME string, TABLE_TYPE string, VALIDATION_RULE string, VALIDATION_TEXT string",
    "columns": "TABLE_NAME string, COLUMN_NAME string, ORDINAL_POSITION int, DATA_TYPE string, IS_NULLABLE boolean, CHARACTER_MAXIMUM_LENGTH int, NUMERIC_PRECISION int, NUMERIC_SCALE int, COLUMN_DEFAULT string, IDENTITY_SEED int, IDENTITY_INCREMENT int",
    "indexes": "TABLE_NAME string, INDEX_NAME string, INDEX_TYPE string, IS_UNIQUE boolean",
    "index_columns": "TABLE_NAME string, INDEX_NAME string, ORDINAL_POSITION int, COLUMN_NAME string",
    "relations": "RELATION_NAME string, REFERENCING_TABLE_NAME string, PRINCIPAL_TABLE_NAME string, ON_DELETE string",
    "relation_columns": "RELATION_NAME string, REFERENCING_COLUMN_NAME string, PRINCIPAL_COLUMN_NAME string, ORDINAL_POSITION int",
    "check_constraints": "TABLE_NAME string, CONSTRAINT_NAME string, CHECK_CLAUSE string",
}


def view_of(store: Store, name: str) -> DataFrame:
    if name not in VIEWS:
        raise KeyError(f"no catalog view {name}")
    state = store._state()
    tables, relations = sorted(state["tables"].items()), sorted(state["relations"].items())
    rows: list[tuple] = []
    if name == "tables":
        rows = [(t, "BASE TABLE", None, None) for t, _ in tables]
    elif name == "columns":
        for t, e in tables:
            for i, c in enumerate(e["columns"]):
                kind = store_type(c["type"])
                seed, step = c["identity"] or (None, None)
                rows.append((t, c["name"], i, c["type"], c["nullable"], c["size"], getattr(kind, "precision", None), getattr(kind, "scale", None), c["default"], seed, step))
    elif name == "indexes":
        rows = [(t, n, "PRIMARY" if i["primary"] else "UNIQUE" if i["unique"] else "INDEX", i["unique"]) for t, e in tables for n, i in e["indexes"].items()]
    elif name == "index_columns":
        rows = [(t, n, k, c) for t, e in tables for n, i in e["indexes"].items() for k, c in enumerate(i["columns"])]
    elif name == "relations":
        rows = [(n, r["table"], r["principal"], r["on_delete"]) for n, r in relations]
    elif name == "relation_columns":
        rows = [(n, a, b, k) for n, r in relations for k, (a, b) in enumerate(zip(r["columns"], r["principal_columns"], strict=True))]
    else:
        rows = [(t, n, c) for t, e in tables for n, c in e["checks"].items()]
    return store.spark.createDataFrame(rows, VIEWS[name])
