"""What a plot or a report shows, as named DataFrames; and those as JSON or a plain HTML page."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import is_numeric, is_time
from . import profile, relations

Artefacts = dict[str, DataFrame]


def kind_of(df: DataFrame, column: str) -> str:
    """number, time or text: how a column is shown."""
    kind = df.schema[column].dataType
    return "number" if is_numeric(kind) else "time" if is_time(kind) else "text"


def plot(df: DataFrame, x: str, y: str | None = None, z: str | None = None) -> Artefacts:
    """What there is to show of one, two or three columns, by their kinds, in whatever order they are given; three are a time, a text and a number."""
    columns = [c for c in (x, y, z) if c is not None]
    by_kind = {kind_of(df, c): c for c in columns}
    if len(columns) == 1:
        return _single(df, x)
    if len(columns) == 3:
        if set(by_kind) != {"number", "time", "text"}:
            raise ValueError("three columns must be a time, a text and a number")
        t, v, g = by_kind["time"], by_kind["number"], by_kind["text"]
        return {"series": profile.time_series(df, t, profile.auto_unit(df, t), v, by=g)}
    if set(by_kind) == {"number"}:
        return {"boxes": profile.numeric_boxes(df, x, y), "regression": relations.regression(df, x, y)}
    if set(by_kind) == {"text"}:
        return {"counts": profile.pair_counts(df, x, y)}
    if set(by_kind) == {"text", "number"}:
        return {"groups": profile.group_numeric(df, by_kind["text"], by_kind["number"])}
    if "time" not in by_kind or len(by_kind) == 1:
        raise ValueError(f"columns of kinds {sorted(by_kind)} have no common plot")
    unit = profile.auto_unit(df, by_kind["time"])
    if "number" in by_kind:
        return {"series": profile.time_series(df, by_kind["time"], unit, by_kind["number"]), "boxes": profile.time_boxes(df, by_kind["time"], by_kind["number"], unit)}
    return {"counts": profile.time_pairs(df, by_kind["time"], by_kind["text"], unit)}


def _single(df: DataFrame, column: str) -> Artefacts:
    kind = kind_of(df, column)
    if kind == "number":
        return {"stats": profile.numeric_profile(df, [column]), "histogram": profile.histogram(df, column), "box": profile.box(df, column), "quantiles": profile.normal_quantiles(df, column)}
    if kind == "time":
        return {"stats": profile.time_profile(df, column), "series": profile.time_series(df, column, profile.auto_unit(df, column))}
    return {"stats": profile.nominal_profile(df, column), "values": profile.value_counts(df, column, 10), "lengths": profile.length_histogram(df, column), "words": profile.word_counts(df, column)}


def memory_estimate(df: DataFrame) -> DataFrame:
    """(column, bytes): an estimate, of texts by their bytes in UTF-8 and of other values by the width of their type; one aggregate."""
    widths = {"tinyint": 1, "boolean": 1, "smallint": 2, "int": 4, "float": 4, "date": 4}
    cells = []
    for f in df.schema:
        kind = f.dataType.simpleString()
        c = profile.as_text(profile._c(f.name), f.dataType)
        size = F.sum(F.octet_length(c)) if kind not in widths and not is_numeric(f.dataType) and not is_time(f.dataType) else F.count("*") * widths.get(kind, 8)
        cells.append(F.struct(F.lit(f.name).alias("column"), F.coalesce(size.cast("long"), F.lit(0)).alias("bytes")))
    return df.agg(F.array(*cells).alias("cells")).select(F.explode("cells").alias("x")).select("x.*")


def create_report(df: DataFrame) -> Artefacts:
    """Overview, variables, correlations and missing values of a frame. Nothing runs but what each artefact is asked for."""
    numbers = [c for c in df.columns if kind_of(df, c) == "number"]
    out = {"overview": profile.overview(df), "memory": memory_estimate(df)}
    if numbers:
        out["variables: numbers"] = profile.numeric_profile(df, numbers)
    for c in df.columns:
        kind = kind_of(df, c)
        if kind != "number":
            out[f"variables: {c}"] = profile.time_profile(df, c) if kind == "time" else profile.value_counts(df, c, 10)
    if len(numbers) > 1:
        out["correlations"] = relations.pearson(df, numbers)
    return out | {"missing": relations.missing_bars(df), "missing: totals": relations.missing_stats(df)}


def create_diff_report(frames: dict[str, DataFrame]) -> Artefacts:
    """Two to five frames against one another: statistics, and of each column of the first what the others have, by its kind."""
    first = next(iter(frames.values()))
    show = {"number": relations.diff_histogram, "text": relations.diff_bars, "time": relations.diff_times}
    common = [c for c in first.columns if all(c in f.columns for f in frames.values())]
    return {"statistics": relations.diff_stats(frames)} | {f"variables: {c}": show[kind_of(first, c)](frames, c) for c in common}


def display(x: object, digits: int = 5) -> str:
    """A value as reports show it: numbers to a few significant digits, whole ones in full, null as nothing."""
    if x is None:
        return ""
    if isinstance(x, bool) or not isinstance(x, (int, float)):
        return str(x)
    return f"{x:,}" if isinstance(x, int) else f"{x:.{digits}g}"


def to_json(artefacts: Artefacts, rows: int = 1000) -> str:
    """The artefacts as one JSON object of lists of rows; of each at most rows, as a report shows no more."""
    return json.dumps({name: [json.loads(r) for r in found.limit(rows).toJSON().collect()] for name, found in artefacts.items()}, ensure_ascii=False)


def to_html(artefacts: Artefacts, title: str = "Report", rows: int = 100) -> str:
    """A page with a table for each artefact, of at most rows."""
    parts = []
    for name, found in artefacts.items():
        head = "".join(f"<th>{html.escape(c)}</th>" for c in found.columns)
        body = "".join("<tr>" + "".join(f"<td>{html.escape(display(v))}</td>" for v in r) + "</tr>" for r in found.limit(rows).collect())
        parts.append(f"<section><h2>{html.escape(name)}</h2><table><tr>{head}</tr>{body}</table></section>")
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>{''.join(parts)}</body></html>"
