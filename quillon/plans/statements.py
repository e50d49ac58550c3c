"""Definition and change statements of the dialect, run on a store."""

from __future__ import annotations

import re
from typing import TYPE_CHECKING, Any

from pyspark.sql import functions as F

from quillon.plans import dialect

if TYPE_CHECKING:
    from quillon.sources.store import Store

NAME = r"(`[^`]+`|\[[^\]]+\]|\w+)"


def _name(text: str) -> str:
    return text.strip().strip("`[]")


def _parts(text: str) -> list[str]:
    """Pieces between commas outside parentheses and quotes."""
    out, depth, current = [], 0, ""
    for m in dialect._TOKEN.finditer(text):
        t = m[0]
        depth += {"(": 1, ")": -1}.get(t, 0) if m.lastgroup == "op" else 0
        if t == "," and not depth and m.lastgroup == "op":
            out.append(current.strip())
            current = ""
        else:
            current += t
    return [*out, current.strip()] if current.strip() else out


def _setters(text: str, args: Any) -> dict[str, str]:
    out = {}
    for part in _parts(text):
        name, _, value = part.partition("=")
        out[_name(name.split(".")[-1])] = dialect.translate_expression(value, args)
    return out


def run(store: Store, sql: str, args: Any = None) -> int | None:
    for pattern, action in _STATEMENTS:
        m = re.fullmatch(pattern, sql.strip(), re.I | re.S)
        if m:
            return action(store, m, args)
    raise dialect.DialectError(f"not a statement: {sql[:60]!r}")


def _create_table(store: Store, m: re.Match, args: Any) -> None:
    columns, key, uniques, foreign, checks = {}, None, [], [], []
    for part in _parts(m[2]):
        c = re.fullmatch(rf"CONSTRAINT\s+{NAME}\s+(.*)", part, re.I | re.S)
        name, body = (_name(c[1]), c[2]) if c else ("PrimaryKey", part)
        if k := re.fullmatch(r"PRIMARY\s+KEY\s*\((.*)\)", body, re.I | re.S):
            key = [_name(x) for x in k[1].split(",")]
        elif k := re.fullmatch(r"UNIQUE\s*\((.*)\)", body, re.I | re.S):
            uniques.append((name, [_name(x) for x in k[1].split(",")]))
        elif k := re.fullmatch(rf"FOREIGN\s+KEY\s*\(([^)]*)\)\s*REFERENCES\s+{NAME}\s*\(([^)]*)\)\s*(?:ON\s+DELETE\s+(.*))?", body, re.I | re.S):
            foreign.append((name, [_name(x) for x in k[1].split(",")], _name(k[2]), [_name(x) for x in k[3].split(",")], k[4] or "NO ACTION"))
        elif k := re.fullmatch(r"CHECK\s*\((.*)\)", body, re.I | re.S):
            checks.append((name, k[1]))
        else:
            d = re.fullmatch(rf"{NAME}\s+(.*?)(\s+PRIMARY\s+KEY)?", part, re.I | re.S)
            columns[_name(d[1])] = d[2]
            key = [_name(d[1])] if d[3] else key
    table = _name(m[1])
    store.create_table(table, columns, key)
    for name, cols in uniques:
        store.create_index(table, name, cols, unique=True)
    for name, cols, principal, pcols, action in foreign:
        store.add_foreign_key(name, table, cols, principal, pcols, action)
    for name, text in checks:
        store.add_check(table, name, text)


def _insert_values(store: Store, m: re.Match, args: Any) -> int:
    names = [_name(x) for x in m[2].split(",")]
    values = [dialect.translate_expression(x, args) for x in _parts(m[3])]
    return store.insert(_name(m[1]), store.spark.range(1).select(*[F.expr(v).alias(n) for n, v in zip(names, values, strict=True)]))


def _insert_query(store: Store, m: re.Match, args: Any) -> int:
    names = [_name(x) for x in m[2].split(",")]
    rows = store.query(m[3], args)
    return store.insert(_name(m[1]), rows.toDF(*names))


def _delete(store: Store, m: re.Match, args: Any) -> int:
    table = _name(m[1])
    if not m[2]:
        return store.delete(table)
    condition = dialect.translate_expression(m[2], args)
    if not re.search(r"\bSELECT\b", m[2], re.I):
        return store.delete(table, condition)
    #: Subqueries decide by the columns that tell a row.
    store.register()
    on = store.identity_columns(store._state(), table)
    gone = store.spark.sql(f"SELECT * FROM `{table}` WHERE {condition}").select(*[f"`{c}`" for c in on]).distinct()
    return store.delete(table, keys=gone, on=on, null_safe=True)


def _update(store: Store, m: re.Match, args: Any) -> int:
    return store.update(_name(m[1]), _setters(m[2], args), dialect.translate_expression(m[3], args) if m[3] else None)


def _update_join(store: Store, m: re.Match, args: Any) -> int:
    """UPDATE a INNER|LEFT JOIN b [AS c] ON condition ... SET a.c = expression [WHERE condition]: any joins and conditions over one changed table.

    The joined rows give each row of the table its new values by the columns that tell a row; of several the least is taken.
    """
    table, alias = _name(m[1]), _name(m[2]) if m[2] else _name(m[1])
    store.register()
    on = store.identity_columns(store._state(), table)
    setters = {}
    for part in _parts(m[4]):
        name, _, value = part.partition("=")
        setters[_name(name.split(".")[-1])] = value
    columns = ", ".join([*[f"`{alias}`.`{c}`" for c in on], *[f"{v} AS `set__{i}`" for i, v in enumerate(setters.values())]])
    where = f" WHERE {m[5]}" if m[5] else ""
    source = store.query(f"SELECT {columns} FROM `{table}` AS `{alias}` {m[3]}{where}", args)
    return store.update(table, {c: F.col(f"set__{i}") for i, c in enumerate(setters)}, source=source, on=on)


def database(spark: Any, sql: str) -> Store | None:
    """CREATE DATABASE 'root' gives the new store; DROP DATABASE 'root' removes one."""
    from quillon.sources.store import Store

    m = re.fullmatch(r"\s*(CREATE|DROP)\s+DATABASE\s+(?:'([^']+)'|`([^`]+)`|(\S+?))\s*;?\s*", sql, re.I)
    if not m:
        raise dialect.DialectError(f"not a database statement: {sql[:60]!r}")
    root = m[2] or m[3] or m[4]
    if m[1].upper() == "CREATE":
        return Store(spark, root, create=True)
    Store(spark, root).drop()
    return None


_STATEMENTS = (
    (rf"CREATE\s+TABLE\s+{NAME}\s*\((.*)\)", _create_table),
    (rf"DROP\s+TABLE\s+{NAME}", lambda s, m, a: s.drop_table(_name(m[1]))),
    (rf"RENAME\s+TABLE\s+{NAME}\s+TO\s+{NAME}", lambda s, m, a: s.rename_table(_name(m[1]), _name(m[2]))),
    (rf"RENAME\s+COLUMN\s+{NAME}\.{NAME}\s+TO\s+{NAME}", lambda s, m, a: s.rename_column(_name(m[1]), _name(m[2]), _name(m[3]))),
    (rf"ALTER\s+TABLE\s+{NAME}\s+ADD\s+CONSTRAINT\s+{NAME}\s+PRIMARY\s+KEY\s*\((.*)\)", lambda s, m, a: s.create_index(_name(m[1]), _name(m[2]), [_name(x) for x in m[3].split(",")], primary=True)),
    (rf"ALTER\s+TABLE\s+{NAME}\s+ADD\s+CONSTRAINT\s+{NAME}\s+FOREIGN\s+KEY\s*\(([^)]*)\)\s*REFERENCES\s+{NAME}\s*\(([^)]*)\)\s*(?:ON\s+DELETE\s+(.*))?",
     lambda s, m, a: s.add_foreign_key(_name(m[2]), _name(m[1]), [_name(x) for x in m[3].split(",")], _name(m[4]), [_name(x) for x in m[5].split(",")], m[6] or "NO ACTION")),
    (rf"ALTER\s+TABLE\s+{NAME}\s+ADD\s+CONSTRAINT\s+{NAME}\s+CHECK\s*\((.*)\)", lambda s, m, a: s.add_check(_name(m[1]), _name(m[2]), m[3])),
    (rf"ALTER\s+TABLE\s+{NAME}\s+DROP\s+CONSTRAINT\s+{NAME}", lambda s, m, a: s.drop_foreign_key(_name(m[2])) if _name(m[2]) in s._state()["relations"] else s.drop_index(_name(m[1]), _name(m[2]))),
    (rf"ALTER\s+TABLE\s+{NAME}\s+ADD\s+(?:COLUMN\s+)?{NAME}\s+(.*)", lambda s, m, a: s.add_column(_name(m[1]), _name(m[2]), m[3])),
    (rf"ALTER\s+TABLE\s+{NAME}\s+ALTER\s+(?:COLUMN\s+)?{NAME}\s+(.*)", lambda s, m, a: s.alter_column(_name(m[1]), _name(m[2]), m[3])),
    (rf"ALTER\s+TABLE\s+{NAME}\s+DROP\s+(?:COLUMN\s+)?{NAME}", lambda s, m, a: s.drop_column(_name(m[1]), _name(m[2]))),
    (rf"CREATE\s+(UNIQUE\s+)?INDEX\s+{NAME}\s+ON\s+{NAME}\s*\(([^)]*)\).*", lambda s, m, a: s.create_index(_name(m[3]), _name(m[2]), [_name(x.split()[0]) for x in m[4].split(",")], unique=bool(m[1]))),
    (rf"DROP\s+INDEX\s+{NAME}\s+ON\s+{NAME}", lambda s, m, a: s.drop_index(_name(m[2]), _name(m[1]))),
    (rf"INSERT\s+INTO\s+{NAME}\s*\(([^)]*)\)\s*VALUES\s*\((.*)\)", _insert_values),
    (rf"INSERT\s+INTO\s+{NAME}\s*\(([^)]*)\)\s*(SELECT.*)", _insert_query),
    (rf"DELETE\s+(?:\*\s+)?FROM\s+{NAME}(?:\s+WHERE\s+(.*))?", _delete),
    (rf"UPDATE\s+{NAME}(?:\s+AS\s+{NAME})?\s+((?:INNER|LEFT)\s+JOIN\s+.*?)\s+SET\s+(.*?)(?:\s+WHERE\s+(.*))?", _update_join),
    (rf"UPDATE\s+{NAME}\s+SET\s+(.*?)(?:\s+WHERE\s+(.*))?", _update),
)
