"""Store types, literals, and the one place where results are coerced (``conform``)."""

from __future__ import annotations

import datetime as dt
import re
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.options import current

#: Store type names by the type that holds them.
NAMES: dict[type[T.DataType] | T.DataType, tuple[str, ...]] = {
    T.BooleanType(): ("bit", "boolean", "logical", "logical1", "yesno"),
    T.IntegerType(): ("counter", "identity", "autoincrement", "integer", "long", "int", "integer4"),
    T.ShortType(): ("byte", "tinyint", "integer1", "smallint", "short", "integer2"),
    T.LongType(): ("bigint",),
    T.FloatType(): ("single", "real", "float4", "ieeesingle"),
    T.DoubleType(): ("double", "float", "float8", "ieeedouble", "number"),
    T.DecimalType(18, 0): ("decimal", "numeric", "dec"),
    T.DecimalType(19, 4): ("currency", "money"),
    T.TimestampNTZType(): ("datetime",),
    T.DateType(): ("date",),
    T.StringType(): (
        "char", "alphanumeric", "character", "nchar", "national char", "national character", "varchar", "string", "char varying", "character varying",
        "nvarchar", "longchar", "longtext", "memo", "note", "ntext", "text", "guid", "uniqueidentifier",
    ),
    T.BinaryType(): ("binary", "varbinary", "binary varying", "bit varying", "longbinary", "general", "image", "oleobject", "timestamp"),
}
#: Seconds of the day; Spark has no time of day.
TIME = ("time",)
_BY_NAME = {n: t for t, names in NAMES.items() for n in names}
IDENTITY = {"counter", "identity", "autoincrement"}
ZERO_DATE = dt.datetime(1899, 12, 30)


def store_type(text: str) -> T.DataType:
    """``decimal(10,2)``, ``varchar(40)``, ``counter(1,1)``, ... as a Spark type."""
    m = re.fullmatch(r"\s*([a-z][a-z0-9 ]*?)\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?\s*", text.lower())
    if not m:
        raise ValueError(f"not a store type: {text!r}")
    name, a, b = m[1], m[2], m[3]
    if name in TIME:
        return T.IntegerType()
    if name not in _BY_NAME:
        raise ValueError(f"unknown store type: {name!r}")
    if name in ("decimal", "numeric", "dec") and a:
        return T.DecimalType(int(a), int(b or 0))
    if name in ("varchar", "string", "char varying", "character varying", "nvarchar") and not a and current().short_text:
        return T.VarcharType(255)
    return _BY_NAME[name]


def literal(value: object) -> str:
    """A Python value as a dialect literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, dt.datetime):
        return f"#{value:%Y-%m-%d %H:%M:%S}#"
    if isinstance(value, dt.date):
        return f"#{value:%Y-%m-%d}#"
    if isinstance(value, dt.time):
        return f"TIMEVALUE('{value:%H:%M:%S}')"
    if isinstance(value, (bytes, bytearray)):
        return "0x" + bytes(value).hex().upper()
    if isinstance(value, (int, float, Decimal)):
        return repr(value) if not isinstance(value, Decimal) else str(value)
    return "'" + str(value).replace("'", "''") + "'"


def conform(df: DataFrame, schema: T.StructType, precision: str = "s", fill_defaults: bool = False, null_integer: int | None = None) -> DataFrame:
    """``df`` with the columns and types of ``schema``.

    Bool reads any number but 0 and any text but '0' and 'false' as true; dates are cut to seconds (``precision='ms'`` rounds to milliseconds, halves away
    from zero); ``fill_defaults`` puts a type's default where a non-nullable column is null; ``null_integer`` is an integer that reads as null.
    """
    out = []
    for field in schema.fields:
        c, have = F.col(f"`{field.name}`"), df.schema[field.name].dataType
        kind = field.dataType
        if isinstance(kind, T.BooleanType) and not isinstance(have, T.BooleanType):
            c = ~F.lower(F.trim(c)).isin("0", "false", "") if isinstance(have, T.StringType) else c != 0
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            c = c.cast("timestamp")
            c = F.date_trunc("SECOND", c) if precision == "s" else F.timestamp_millis(F.round(F.unix_micros(c) / 1000).cast("long"))
            c = c.cast(kind)
        elif isinstance(kind, T.IntegralType) and isinstance(have, T.StringType):
            c = F.try_to_number(c, F.lit("S999999999999999999")).cast(kind)
        else:
            c = c.cast(kind)
        if null_integer is not None and isinstance(kind, T.IntegralType):
            c = F.when(c != null_integer, c)
        if fill_defaults and not field.nullable:
            c = F.coalesce(c, default_of(kind))
        out.append(c.alias(field.name, metadata=field.metadata))
    return df.select(*out)


def default_of(kind: T.DataType):
    if isinstance(kind, T.BooleanType):
        return F.lit(False)
    if isinstance(kind, T.StringType):
        return F.lit("")
    if isinstance(kind, T.BinaryType):
        return F.lit(b"")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.lit(ZERO_DATE).cast(kind)
    return F.lit(0).cast(kind)
