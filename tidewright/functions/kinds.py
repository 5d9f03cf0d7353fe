"""Semantic types of columns, which decide how a column is profiled."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .nulls import is_numeric, is_time, real


class Kind(Enum):
    NOMINAL = "Nominal"
    GEOGRAPHY = "GeoGraphy"
    CONTINUOUS = "Continuous"
    SMALL = "SmallCardNum"
    TIME = "DateTime"
    GEOPOINT = "GeoPoint"


def kinds(df: DataFrame, overrides: dict[str, Kind] | None = None, small: int = 10, head: int = 100) -> dict[str, Kind]:
    """The kind of each column: by Spark type, and for numbers by whether there are fewer than small distinct values (one job for all columns).

    Texts are GeoGraphy if over 80 % of the first head values are countries, GeoPoint if they are coordinates.
    """
    from ..operators import country, latlong

    found = dict(overrides or {})
    numeric = [f.name for f in df.schema if is_numeric(f.dataType) and f.name not in found]
    texts = [f.name for f in df.schema if f.dataType.simpleString() == "string" and f.name not in found]
    distinct = df.agg(*[F.approx_count_distinct(real(F.col(f"`{c}`"))).alias(c) for c in numeric]).first().asDict() if numeric else {}
    rates = {}
    if texts:
        first = df.select(*[F.col(f"`{c}`") for c in texts]).limit(head)
        flags = [F.avg(country.is_country(F.col(f"`{c}`")).cast("double")).alias(f"{c}\0country") for c in texts]
        flags += [F.avg(latlong.is_coordinates(F.col(f"`{c}`")).cast("double")).alias(f"{c}\0point") for c in texts]
        rates = first.agg(*flags).first().asDict()
    for f in df.schema:
        if f.name in found:
            continue
        if f.name in numeric:
            found[f.name] = Kind.SMALL if distinct[f.name] < small else Kind.CONTINUOUS
        elif is_time(f.dataType):
            found[f.name] = Kind.TIME
        elif (rates.get(f"{f.name}\0country") or 0) > 0.8:
            found[f.name] = Kind.GEOGRAPHY
        elif (rates.get(f"{f.name}\0point") or 0) > 0.8:
            found[f.name] = Kind.GEOPOINT
        else:
            found[f.name] = Kind.NOMINAL
    return found
