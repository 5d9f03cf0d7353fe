"""Coordinates in decimal degrees, or in degrees, minutes and seconds with a hemisphere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import let

#: What may stand beside the numbers of a side: units and brackets.
MARKS = "°dms'′\"″:() \t"
FORMATS = ("dd", "ddh", "dm", "dms")


def _sides(c: Column) -> tuple[Column, Column]:
    """The two halves of a text: parted at a comma or semicolon, else after the first N or S, else at the only space."""
    t = F.trim(c.cast("string"))
    letter = F.regexp_instr(t, F.lit("[NS]"))
    space = F.when(F.size(F.split(t, r"\s+")) == 2, F.regexp_instr(t, F.lit(r"\s")))
    at = F.coalesce(F.nullif(F.regexp_instr(t, F.lit("[,;]")), F.lit(0)), F.nullif(letter, F.lit(0)), space, F.lit(0))
    head = F.substring(t, F.lit(1), at)
    return F.regexp_replace(head, "[,;]$", ""), F.substring(t, at + 1, F.lit(200))


def _side(side: Column, limit: int, letters: str) -> Column:
    """Degrees of a half: one to three numbers, then at most one of two hemisphere letters (the second is negative)."""
    numbers = F.regexp_extract_all(side, F.lit(r"[-+]?\d+(?:\.\d+)?"), F.lit(0))
    rest = F.translate(F.regexp_replace(side, r"[-+]?\d+(?:\.\d+)?", ""), MARKS, "")
    return let(F.struct(numbers.alias("numbers"), rest.alias("rest")), lambda x: _degrees(x["numbers"], x["rest"], limit, letters))


def _degrees(numbers: Column, rest: Column, limit: int, letters: str) -> Column:
    n = lambda k: F.coalesce(F.get(numbers, F.lit(k)).try_cast("double"), F.lit(0.0))
    whole = F.abs(n(0)) + n(1) / 60 + n(2) / 3600
    signed = F.when(F.get(numbers, F.lit(0)).startswith("-") | (rest == letters[1]), -whole).otherwise(whole)
    ok = F.size(numbers).between(1, 3) & rest.isin("", *letters) & n(1).between(0, 59.999999999) & n(2).between(0, 59.999999999) & (whole <= limit)
    return F.when(ok, F.round(signed, 4))


def parsed(c: Column) -> Column:
    """struct(lat, long), or null."""
    first, second = _sides(c)
    both = F.struct(_side(first, 90, "NS").alias("lat"), _side(second, 180, "EW").alias("long"))
    return let(both, lambda x: F.when(x["lat"].isNotNull() & x["long"].isNotNull(), x))


def formatted(degrees: Column, letters: str, output_format: str) -> Column:
    """Degrees as text: decimal (dd), with a hemisphere (ddh), with minutes (dm), or with minutes and seconds (dms)."""
    size, side = F.abs(degrees), F.when(degrees < 0, letters[1]).otherwise(letters[0])
    whole = F.floor(size)
    minutes = F.round((size - whole) * 60, 4)
    text = lambda x: F.call_function("format_number", x.cast("double"), F.lit("0.####"))
    seconds = F.round((minutes - F.floor(minutes)) * 60, 2)
    return {
        "dd": text(degrees), "ddh": F.concat(text(size), F.lit("° "), side), "dm": F.concat(whole, F.lit("° "), text(minutes), F.lit("′ "), side),
        "dms": F.concat(whole, F.lit("° "), F.floor(minutes), F.lit("′ "), text(seconds), F.lit("″ "), side),
    }[output_format]


def is_coordinates(c: Column) -> Column:
    return F.coalesce(c.rlike("[,;]") & parsed(c).isNotNull(), F.lit(False))


def clean_lat_long(df: DataFrame, column: str | tuple[str, str], split: bool = False, output_format: str | None = None) -> DataFrame:
    """Adds <column>_clean, or latitude and longitude; a pair of columns is taken as one, and output_format (see formatted) gives texts."""
    if isinstance(column, tuple):
        lat, long = (_side(F.trim(F.col(f"`{x}`").cast("string")), limit, sides) for x, limit, sides in zip(column, (90, 180), ("NS", "EW"), strict=True))
        p, column = F.when(lat.isNotNull() & long.isNotNull(), F.struct(lat.alias("lat"), long.alias("long"))), "_".join(column)
    else:
        p = parsed(F.col(f"`{column}`"))
    if output_format:
        p = F.when(p.isNotNull(), F.struct(formatted(p["lat"], "NS", output_format).alias("lat"), formatted(p["long"], "EW", output_format).alias("long")))
    return df.withColumns({"latitude": p["lat"], "longitude": p["long"]}) if split else df.withColumn(f"{column}_clean", p)
