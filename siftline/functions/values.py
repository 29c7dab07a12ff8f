"""Typed columns and the conversions between the language's types."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.functions import dates

STRING, LONG, INTEGER, DOUBLE, DATE, BOOLEAN = "STRING", "LONG", "INTEGER", "DOUBLE", "DATE", "BOOLEAN"
NUMBERS = (LONG, INTEGER, DOUBLE, BOOLEAN)
TYPES = (STRING, LONG, INTEGER, DOUBLE, DATE, BOOLEAN)


@dataclass(frozen=True)
class Val:
    """A column with its type; layout: of a date's text; raw: that text where it is known; literal: a constant's value."""

    col: Column
    kind: str
    layout: str | None = None
    raw: Column | None = None
    literal: object = None


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType)):
        return INTEGER
    if isinstance(data_type, T.LongType):
        return LONG
    if isinstance(data_type, (T.DoubleType, T.FloatType, T.DecimalType)):
        return DOUBLE
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return DATE
    return BOOLEAN if isinstance(data_type, T.BooleanType) else STRING


def common(a: str, b: str) -> str:
    """The type both convert to: STRING absorbs, then DOUBLE, LONG, INTEGER, BOOLEAN; dates only meet dates."""
    if a == b:
        return a
    if STRING in (a, b) or DATE in (a, b):
        return STRING
    return next(k for k in (DOUBLE, LONG, INTEGER, BOOLEAN) if k in (a, b))


def number_text(col: Column) -> Column:
    """A double as text: whole numbers without a point."""
    whole = (col == F.floor(col)) & (F.abs(col) < 1e15)
    return F.when(whole, col.cast("long").cast("string")).otherwise(col.cast("string"))


def text(v: Val) -> Column:
    if v.raw is not None:
        return v.raw
    if v.kind == STRING:
        return v.col
    if v.kind == DATE:
        return dates.shown(v.col, v.layout)
    if v.kind == DOUBLE:
        return number_text(v.col)
    return v.col.cast("int").cast("string") if v.kind == BOOLEAN else v.col.cast("string")


def number(v: Val) -> Column:
    if v.kind == DATE:
        return F.unix_timestamp(v.col).cast("double")
    if v.kind == STRING:
        return F.trim(v.col).try_cast("double")
    return v.col.cast("double")


def whole(v: Val) -> Column:
    """A long; null for values that are not whole numbers."""
    if v.kind in (LONG, INTEGER, BOOLEAN):
        return v.col.cast("long")
    if v.kind == STRING:
        return F.trim(v.col).try_cast("long")
    return F.when(number(v) == F.floor(number(v)), F.floor(number(v)))


def stamp(v: Val) -> Column:
    if v.kind == DATE:
        return v.col
    if isinstance(v.literal, str):
        layout = dates.detect(v.literal)
        return dates.parsed(F.lit(v.literal), layout) if layout else F.lit(None).cast("timestamp")
    return dates.recognised(text(v))


def layout_of(v: Val) -> str | None:
    if v.layout or not isinstance(v.literal, str):
        return v.layout
    return dates.detect(v.literal)


def typed(v: Val, kind: str) -> Column:
    if kind == STRING:
        return text(v)
    if kind == DATE:
        return stamp(v)
    if kind in (LONG, INTEGER):
        return whole(v).cast("int" if kind == INTEGER else "long")
    return number(v) if kind == DOUBLE else v.col.cast("boolean")


def constant(value) -> Val:
    if isinstance(value, str):
        return Val(F.lit(value), STRING, literal=value)
    if isinstance(value, float):
        return Val(F.lit(value), DOUBLE, literal=value)
    return Val(F.lit(value).cast("long"), LONG, literal=value)
