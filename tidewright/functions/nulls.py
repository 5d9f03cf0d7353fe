"""What counts as missing, and small numeric helpers shared by all operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts that stand for a missing value.
NULL_VALUES = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "n/a", "nan", "null"]


def let(value: Column, make: Callable[[Column], Column]) -> Column:
    """make(value) with value computed once, however often make uses it."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def is_time(kind: T.DataType) -> bool:
    return isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType))


def is_null(c: Column) -> Column:
    """Null, or a text that stands for it."""
    return c.isNull() | c.cast("string").isin(NULL_VALUES)


def to_null(c: Column) -> Column:
    """c as a text, with null for all that stands for it."""
    return F.when(~is_null(c), c.cast("string"))


def real(c: Column) -> Column:
    """A number as double; NaN is missing."""
    d = c.cast("double")
    return F.when(~F.isnan(d), d)


def finite(c: Column) -> Column:
    """real() without infinities."""
    d = real(c)
    return F.when(F.abs(d) < float("inf"), d)


def as_text(c: Column, kind: T.DataType) -> Column:
    """A value as the text it is counted by; nested ones as JSON."""
    return F.to_json(c) if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)) else c.cast("string")
