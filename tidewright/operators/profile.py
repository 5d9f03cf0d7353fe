"""Profiles of one, two or three columns and of whole frames, as tidy DataFrames. Aggregates of one frame share one job."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import distributions as D
from ..functions.nulls import as_text, finite, is_numeric, is_time, let, real

QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)


def _c(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def numeric_aggregates(c: Column) -> dict[str, Column]:
    """The moments and counts of a number that need no look at distinct values; NaN is missing, infinities count but take no part in the rest."""
    r, x = real(c), finite(c)
    return {
        "count": F.count(r), "missing": F.count("*") - F.count(r), "infinite": F.count(r) - F.count(x), "min": F.min(x), "max": F.max(x), "mean": F.avg(x),
        "std": F.stddev_samp(x), "variance": F.var_samp(x), "skewness": F.skewness(x), "kurtosis": F.kurtosis(x), "sum": F.avg(x) * F.count(r), "zeros": F.count_if(x == 0), "negatives": F.count_if(x < 0),
    }


#: Into how many ranges of about equal size the values of a column are dealt to be ranked.
RANGES = 64


def counted_values(df: DataFrame, columns: list[str], by: list[str] = ()) -> DataFrame:
    """(i, g, x, n): each distinct finite number of each column, and of each group, with its frequency, by one shuffle of partial counts for all columns.

    g is a struct, so that null groups are equal to one another in joins.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("i"), (finite(_c(c)) + 0.0).alias("x")) for i, c in enumerate(columns)])
    group = F.struct(*[_c(b).alias(b) for b in by]) if by else F.struct(F.lit(0).alias("all"))
    return df.select(group.alias("g"), F.explode(cells).alias("v")).select("v.i", "g", "v.x").where("x is not null").groupBy("i", "g", "x").agg(F.count("*").alias("n"))


def value_splits(df: DataFrame, columns: list[str]) -> list[list[float]]:
    """For each column, values that cut its finite numbers into RANGES ranges of about equal size; one aggregate, which gives RANGES numbers a column.

    They are approximate and differ from run to run, so they are fetched once: all that is placed by them is placed by the same ones.
    """
    cuts = [k / RANGES for k in range(1, RANGES)]
    row = df.agg(*[F.approx_percentile(finite(_c(c)) + 0.0, cuts, 1000).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    return [sorted(set(s or [])) for s in row]


def below_splits(x: Column, splits: Column) -> Column:
    """How many of the ascending splits are below x, by halving: places beyond the end are null, which is not below."""
    step, found = 1 << (RANGES.bit_length() - 1), F.lit(0)
    while step:
        found = let(found, _advance(x, splits, step))
        step >>= 1
    return found


def _advance(x: Column, splits: Column, step: int) -> Callable[[Column], Column]:
    return lambda i: i + F.when(F.get(splits, i + (step - 1)) < x, step).otherwise(0)


def splits_of(splits: list[list[float]], i: Column) -> Column:
    """The splits of the i-th column."""
    return F.get(F.array(*[F.array(*[F.lit(x) for x in s]).cast("array<double>") for s in splits]), i)


def placed_values(counted: DataFrame, splits: list[list[float]]) -> DataFrame:
    """counted values (i, g, x, n) with below, the number of smaller ones of the same column and group, and the group's total.

    Values are dealt into ranges common to all groups of a column (a group large enough to matter has its share in all of them), ranges are summed,
    and values are placed within their range only: no task or buffer holds a column.
    """
    dealt = counted.withColumn("range", below_splits(F.col("x"), splits_of(splits, F.col("i"))))
    sums = dealt.groupBy("i", "g", "range").agg(F.sum("n").alias("s"))
    group = W.partitionBy("i", "g")
    before = F.coalesce(F.sum("s").over(group.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("i", "g", "range", before.alias("before"), F.sum("s").over(group).alias("total"))  # RANGES rows for each group at most
    inside = F.coalesce(F.sum("n").over(W.partitionBy("i", "g", "range").orderBy("x").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return dealt.join(sums, ["i", "g", "range"]).withColumn("below", F.col("before") + inside).drop("range", "before")


def exact_quantiles(counted: DataFrame, splits: list[list[float]], probabilities: tuple[float, ...] = QUANTILES) -> DataFrame:
    """(i, g, p, value): interpolated quantiles of counted values (i, g, x, n), ranked within the ranges between splits."""
    wanted = F.array(*[F.struct(F.lit(p).alias("p"), (F.lit(p) * (F.col("total") - 1)).alias("at")) for p in probabilities])
    up_to = F.col("below") + F.col("n")
    asked = placed_values(counted, splits).withColumn("w", F.explode(F.filter(wanted, lambda w: (F.ceil(w["at"]) >= F.col("below")) & (F.floor(w["at"]) < up_to))))
    holds = lambda rank: F.max(F.when((rank >= F.col("below")) & (rank < up_to), F.col("x")))
    found = asked.groupBy("i", "g", F.col("w.p").alias("p")).agg(F.first("w.at").alias("at"), holds(F.floor("w.at")).alias("low"), holds(F.ceil("w.at")).alias("high"))
    return found.select("i", "g", "p", (F.col("low") + (F.col("high") - F.col("low")) * (F.col("at") - F.floor("at"))).alias("value"))


def median(df: DataFrame, x: Column) -> DataFrame:
    """(median): one row, null without finite values."""
    rows = df.select(x.alias("x"))
    found = exact_quantiles(counted_values(rows, ["x"]), value_splits(rows, ["x"]), (0.5,))
    return found.agg(F.max("value").alias("median"))


def numeric_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, metric, value) for numeric columns: one aggregate for moments, and counted values for what needs distinct ones."""
    columns = columns or [f.name for f in df.schema if is_numeric(f.dataType)]
    made = {c: numeric_aggregates(_c(c)) for c in columns}
    row = df.agg(*[F.struct(*[v.cast("double").alias(k) for k, v in made[c].items()]).alias(f"c{i}") for i, c in enumerate(columns)])
    items = [F.struct(F.lit(i).alias("i"), F.lit(k).alias("metric"), F.col(f"c{i}")[k].alias("value")) for i, c in enumerate(columns) for k in made[c]]
    moments = row.select(F.explode(F.array(*items)).alias("x")).select("x.*")
    counted = counted_values(df, columns)
    has = lambda c, x: F.coalesce(F.bool_or(real(_c(c)) == x), F.lit(False)).cast("long")
    infinite = F.array(*[has(c, float("inf")) + has(c, float("-inf")) for c in columns])
    names = F.array(*[F.lit(c) for c in columns])
    kinds = F.broadcast(df.agg(infinite.alias("k")).select(F.posexplode("k").alias("i", "k")))  # a row for each column
    distinct = kinds.join(counted.groupBy("i").agg(F.count("*").alias("d")), "i", "left").select("i", F.lit("distinct").alias("metric"), (F.coalesce("d", F.lit(0)) + F.col("k")).cast("double").alias("value"))
    every = df.sparkSession.range(len(columns)).select(F.col("id").cast("int").alias("i"), F.explode(F.array(*[F.lit(p) for p in QUANTILES])).alias("p"))
    quantiles = F.broadcast(every).join(exact_quantiles(counted, value_splits(df, columns)).drop("g"), ["i", "p"], "left").select("i", F.concat(F.lit("q"), F.lpad(F.round(F.col("p") * 100).cast("int").cast("string"), 2, "0")).alias("metric"), "value")
    return moments.union(distinct).union(quantiles).select(F.get(names, F.col("i")).alias("column"), "metric", "value")


def value_counts(df: DataFrame, column: str, top: int | None = None, largest: bool = True) -> DataFrame:
    """(value, count, share of the rows with a value); the most frequent first, ties by value."""
    kind = df.schema[column].dataType
    counted = df.select(as_text(_c(column), kind).alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("count"))
    total = df.agg(F.count(_c(column)).alias("total"))
    counted = counted.join(F.broadcast(total), how="cross").select("value", "count", (F.col("count") / F.col("total")).alias("share"))  # one row
    order = [F.desc("count") if largest else F.asc("count"), F.asc("value")]
    return counted.orderBy(*order).limit(top) if top else counted.orderBy(*order)


def top_groups(df: DataFrame, column: str, k: int) -> DataFrame:
    """(value, count) of the k most frequent values and of those as frequent as the last of them."""
    counted = df.select(as_text(_c(column), df.schema[column].dataType).alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("count"))
    least = counted.orderBy(F.desc("count")).limit(k).agg(F.min("count").alias("least"))
    return counted.join(F.broadcast(least), F.col("count") >= F.col("least")).select("value", "count")  # one row


def joined_values(df: DataFrame, by: str, column: str, separator: str = ",", most: int = 10_000) -> DataFrame:
    """(value, joined): the distinct values of column in each group, joined in order; a group of more than most values raises an error."""
    kind = df.schema[by].dataType
    pairs = df.select(as_text(_c(by), kind).alias("value"), _c(column).cast("string").alias("v")).where("v is not null").distinct()
    grouped = pairs.groupBy("value").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("v")).alias("vs"))
    return grouped.select("value", F.when(F.col("n") > most, F.raise_error(F.lit("too many values to join"))).otherwise(F.array_join("vs", separator)).alias("joined"))


def time_profile(df: DataFrame, column: str) -> DataFrame:
    """count, missing, distinct, first and last day of a date or time column."""
    c = _c(column)
    day = lambda x: F.date_format(x, "yyyy-MM-dd")
    return df.agg(F.count("*").alias("count"), (F.count("*") - F.count(c)).alias("missing"), F.count_distinct(c).alias("distinct"), day(F.min(c)).alias("first"), day(F.max(c)).alias("last"))


def nominal_profile(df: DataFrame, column: str) -> DataFrame:
    """(metric, value): counts, lengths and letters of a text column, from its value counts."""
    kind = df.schema[column].dataType
    groups = df.groupBy(as_text(_c(column), kind).alias("v")).agg(F.count("*").alias("n"))
    v, n = F.col("v"), F.col("n")
    size = F.char_length(v)
    has = v.isNotNull()
    weighted = lambda pattern: F.sum(F.when(has, n * F.regexp_count(v, F.lit(pattern))))
    mean = F.sum(F.when(has, n * size)) / F.sum(F.when(has, n))
    aggs = {
        "count": F.sum(F.when(has, n)), "missing": F.sum(F.when(~has, n)), "distinct": F.count(v), "length_mean": mean, "length_min": F.min(size), "length_max": F.max(size),
        "length_median": F.percentile(size, F.lit(0.5), F.when(has, n).otherwise(0)), "lower": weighted(r"\p{Ll}"), "upper": weighted(r"\p{Lu}"), "spaces": weighted(r"\s"), "dashes": weighted("-"), "digits": weighted(r"\p{Nd}"),
    }
    row = groups.agg(*[F.coalesce(a.cast("double"), F.lit(0.0)).alias(k) for k, a in aggs.items()])
    return row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in aggs])).alias("x")).select("x.*")


def length_histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    return histogram(df.select(F.char_length(_c(column)).alias("length")), "length", bins)


def word_counts(df: DataFrame, column: str, stopwords: list[str] = (), top: int | None = 30) -> DataFrame:
    """(word, count): words of letters, digits and +, lower-cased; stop words go before lowering. Words are split once for each distinct text."""
    groups = df.groupBy(_c(column).alias("v")).agg(F.count("*").alias("n")).where("v is not null")
    if stopwords:
        groups = groups.withColumn("v", F.array_join(F.filter(F.split("v", r"\s+"), lambda w: ~w.isin(list(stopwords))), " "))
    words = groups.select("n", F.explode(F.split(F.lower(F.regexp_replace("v", r"(?U)[^\w+ ]", " ")), " +")).alias("word")).where("word != ''")
    counted = words.groupBy("word").agg(F.sum("n").alias("count")).orderBy(F.desc("count"), "word")
    return counted.limit(top) if top else counted


def bin_of(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Bins of equal width, closed on the left, the last closed on both sides; one bin if lo = hi."""
    return F.when(hi == lo, F.lit(0)).otherwise(F.least(F.floor((x - lo) / (hi - lo) * bins), F.lit(bins - 1))).cast("int")


def histogram(df: DataFrame, column: str, bins: int = 50, by: str | None = None, limits: tuple[float, float] | None = None) -> DataFrame:
    """(bin, lower, upper, count), empty bins included; with by, one histogram for each group over common bins."""
    x = finite(_c(column)).alias("x")
    rows = df.select(x, *([_c(by).alias("group")] if by else [])).where("x is not null")
    edge = rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi")) if limits is None else df.sparkSession.createDataFrame([limits], "lo double, hi double")
    keys = (["group"] if by else []) + ["bin"]
    binned = rows.join(F.broadcast(edge), how="cross").where("x between lo and hi").withColumn("bin", bin_of(F.col("x"), F.col("lo"), F.col("hi"), bins))  # one row of edges
    counted = binned.groupBy(*keys).agg(F.count("*").alias("count"))
    frame = edge.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")).where("lo is not null")
    if by:
        frame = rows.select("group").distinct().join(F.broadcast(frame), how="cross")  # bins of each group
    width = (F.col("hi") - F.col("lo")) / bins
    full = frame.join(counted, keys, "left")
    return full.select(*keys, (F.col("lo") + F.col("bin") * width).alias("lower"), F.when(F.col("bin") == bins - 1, F.col("hi")).otherwise(F.col("lo") + (F.col("bin") + 1) * width).alias("upper"), F.coalesce("count", F.lit(0)).alias("count"))


def box(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """q1, median, q3, whiskers (the extremes within 1.5 IQR of the quartiles) and the number of outliers, for each group; all from counted values."""
    by = by or []
    counted = counted_values(df, [column], by)
    at = lambda p: F.max(F.when(F.col("p") == p, F.col("value")))
    q = exact_quantiles(counted, value_splits(df, [column]), (0.25, 0.5, 0.75)).groupBy("g").agg(at(0.25).alias("q1"), at(0.5).alias("median"), at(0.75).alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    inside = F.col("x").between(F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr)
    low, high = F.min(F.when(inside, F.col("x"))), F.max(F.when(inside, F.col("x")))
    outliers = F.coalesce(F.sum(F.when(~inside, F.col("n"))), F.lit(0))
    out = counted.join(q, "g").groupBy("g", "q1", "median", "q3").agg(low.alias("low"), high.alias("high"), outliers.alias("outliers"))
    return out.select(*[F.col("g")[b].alias(b) for b in by], "q1", "median", "q3", "low", "high", "outliers")


def sample(df: DataFrame, n: int, keys: list[str], seed: int = 0) -> DataFrame:
    """n rows, the same whatever the partitioning: those of the smallest seeded hash of keys."""
    return df.orderBy(F.xxhash64(F.lit(seed), *[_c(k) for k in keys]), *[_c(k) for k in keys]).limit(n)


def kde(df: DataFrame, column: str, points: int = 50, n: int = 1000) -> DataFrame:
    """(x, density) from a seeded sample of n values."""
    rows = sample(df.select(finite(_c(column)).alias("x")).where("x is not null"), n, ["x"])
    values = [r[0] for r in rows.collect()]
    made = D.kde(values, points, min(values), max(values)) if values else []
    return df.sparkSession.createDataFrame(made, "x double, density double")


def normal_quantiles(df: DataFrame, column: str) -> DataFrame:
    """(p, actual, expected): quantiles at 1..99 % against those of the normal distribution of the same mean and deviation."""
    from statistics import NormalDist

    ps = [k / 100 for k in range(1, 100)]
    x = finite(_c(column))
    moments = df.agg(F.avg(x).alias("m"), F.stddev_samp(x).alias("s"))
    z = F.element_at(F.array(*[F.lit(NormalDist().inv_cdf(p)) for p in ps]), F.round(F.col("p") * 100).cast("int"))
    found = exact_quantiles(counted_values(df, [column]), value_splits(df, [column]), tuple(ps))
    return found.join(F.broadcast(moments), how="cross").select("p", F.col("value").alias("actual"), (F.col("m") + F.col("s") * z).alias("expected"))  # one row


def overview(df: DataFrame) -> DataFrame:
    """(metric, value) of a whole frame: rows, columns, cells, missing cells, distinct and duplicate rows, and how many columns of each type."""
    cols = df.columns
    missing = reduce(lambda a, b: a + b, [(real(_c(f.name)).isNull() if is_numeric(f.dataType) else _c(f.name).isNull()).cast("long") for f in df.schema])
    base = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(missing), F.lit(0)).alias("missing_cells"))
    distinct = df.groupBy(*[_c(c) for c in cols]).agg(F.lit(1)).agg(F.count("*").alias("distinct_rows"))
    numeric, times = sum(is_numeric(f.dataType) for f in df.schema), sum(is_time(f.dataType) for f in df.schema)
    row = base.join(F.broadcast(distinct), how="cross")  # one row each
    values = {"rows": F.col("rows"), "columns": F.lit(len(cols)), "cells": F.col("rows") * len(cols), "missing_cells": F.col("missing_cells"), "distinct_rows": F.col("distinct_rows"), "duplicate_rows": F.col("rows") - F.col("distinct_rows"), "numeric_columns": F.lit(numeric), "time_columns": F.lit(times), "nominal_columns": F.lit(len(cols) - numeric - times)}
    return row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("long").alias("value")) for k, v in values.items()])).alias("x")).select("x.*")


def ks_pairs(df: DataFrame, columns: list[str], n: int = 1000, seed: int = 0) -> DataFrame:
    """(a, b, d, p): the two-sample Kolmogorov-Smirnov test of each pair of numeric columns, on a seeded sample of n rows."""
    import numpy as np

    got = sample(df.select(*[finite(_c(c)).alias(c) for c in columns]), n, columns, seed).toPandas()
    rows = []
    for i, a in enumerate(columns):
        for b in columns[:i]:
            x, y = np.sort(got[a].dropna().to_numpy()), np.sort(got[b].dropna().to_numpy())
            if len(x) and len(y):
                both = np.concatenate([x, y])
                d = float(np.abs(np.searchsorted(x, both, "right") / len(x) - np.searchsorted(y, both, "right") / len(y)).max())
                rows.append((a, b, d, D.ks_sf(d, len(x), len(y))))
    return df.sparkSession.createDataFrame(rows, "a string, b string, d double, p double")


def pair_counts(df: DataFrame, x: str, y: str, top_x: int = 10, top_y: int = 5, others: bool = True) -> DataFrame:
    """(x, y, count, share within x) for the most frequent values of both; the rest of y counts as Others if asked for."""
    rows = df.select(_c(x).cast("string").alias("x"), _c(y).cast("string").alias("y")).where("x is not null and y is not null")
    counted = rows.groupBy("x", "y").agg(F.count("*").alias("count"))
    first = lambda c, k: counted.groupBy(c).agg(F.sum("count").alias("n")).orderBy(F.desc("n"), c).limit(k).select(c, F.lit(True).alias(f"top_{c}"))
    kept = counted.join(F.broadcast(first("x", top_x)), "x", "left_semi").join(F.broadcast(first("y", top_y)), "y", "left")  # at most top_x and top_y rows
    kept = kept.withColumn("y", F.when(F.col("top_y"), F.col("y")).otherwise("Others")) if others else kept.where("top_y")
    out = kept.groupBy("x", "y").agg(F.sum("count").alias("count"))
    return out.withColumn("share", F.col("count") / F.sum("count").over(W.partitionBy("x")))


def group_numeric(df: DataFrame, group: str, column: str, top: int = 15) -> DataFrame:
    """Box, mean and count of a number for the most frequent groups."""
    groups = value_counts(df, group, top).select(F.col("value").alias("g"))
    rows = df.select(_c(group).cast("string").alias("group"), finite(_c(column)).alias("x")).where("x is not null").join(F.broadcast(groups), F.col("group") == F.col("g"), "left_semi")
    return box(rows, "x", ["group"]).join(rows.groupBy("group").agg(F.avg("x").alias("mean"), F.count("*").alias("count")), "group")


def numeric_boxes(df: DataFrame, x: str, y: str, bins: int = 50) -> DataFrame:
    """Boxes of y in bins of x of equal width, closed on the right, the first closed on both sides."""
    rows = df.select(finite(_c(x)).alias("x"), finite(_c(y)).alias("y")).where("x is not null and y is not null")
    edge = rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    b = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(F.greatest(F.ceil((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins) - 1, F.lit(0))).cast("int")
    return box(rows.join(F.broadcast(edge), how="cross").withColumn("bin", F.least(b, F.lit(bins - 1))), "y", ["bin"])  # one row of edges


def hexbins(df: DataFrame, x: str, y: str, size: float) -> DataFrame:
    """(q, r, count): counts in hexagons of the given size, in axial coordinates."""
    rows = df.select(finite(_c(x)).alias("x"), finite(_c(y)).alias("y")).where("x is not null and y is not null")
    q, r = (F.col("x") * (3**0.5 / 3) - F.col("y") / 3) / size, F.col("y") * 2 / 3 / size
    rows = rows.select(q.alias("fq"), r.alias("fr")).select("fq", "fr", (-F.col("fq") - F.col("fr")).alias("fs"))
    rows = rows.select("*", F.rint("fq").alias("q"), F.rint("fr").alias("r"), F.rint("fs").alias("s"))
    dq, dr, ds = (F.abs(F.col(a) - F.col(f"f{a}")) for a in "qrs")
    fixed_q = F.when((dq > dr) & (dq > ds), -F.col("r") - F.col("s")).otherwise(F.col("q"))
    fixed_r = F.when((dq <= dr) & (dr > ds) | (dq <= ds) & (dr > ds) & (dr >= dq), -F.col("q") - F.col("s")).otherwise(F.col("r"))
    return rows.select(fixed_q.cast("int").alias("q"), fixed_r.cast("int").alias("r")).groupBy("q", "r").agg(F.count("*").alias("count"))


UNITS = ("year", "quarter", "month", "week", "day", "hour", "minute", "second")
AGGREGATES = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count, "median": lambda c: F.percentile(c, F.lit(0.5)), "std": F.stddev_samp}


def bucket(ts: Column, unit: str) -> Column:
    """The start of a time unit; weeks start on Sunday."""
    day = F.expr("INTERVAL 1 DAY")
    return F.date_trunc("week", ts + day) - day if unit == "week" else F.date_trunc(unit, ts)


def auto_unit(df: DataFrame, ts: str, want: int = 10) -> str:
    """The unit that cuts the range of ts into about want buckets."""
    lo, hi = df.agg(F.min(_c(ts).cast("timestamp")), F.max(_c(ts).cast("timestamp"))).first()
    if lo is None:
        return "day"
    seconds = max((hi - lo).total_seconds(), 1)
    sizes = dict(zip(UNITS, (31_557_600, 7_889_400, 2_629_800, 604_800, 86_400, 3600, 60, 1), strict=True))
    return min(UNITS, key=lambda u: abs(seconds / sizes[u] - want))


def time_series(df: DataFrame, ts: str, unit: str, value: str | None = None, agg: str = "mean", by: str | None = None, top: int = 10, running: bool = False) -> DataFrame:
    """(bucket, value[, group][, running]) for every bucket between the first and the last; without a value column, row counts."""
    rows = df.select(bucket(_c(ts).cast("timestamp"), unit).alias("bucket"), *([finite(_c(value)).alias("v")] if value else []), *([_c(by).cast("string").alias("group")] if by else [])).where("bucket is not null")
    if by:
        rows = rows.join(F.broadcast(value_counts(rows, "group", top).select(F.col("value").alias("g"))), F.col("group") == F.col("g"), "left_semi")
    keys = ["bucket", "group"] if by else ["bucket"]
    made = rows.groupBy(*keys).agg((AGGREGATES[agg]("v") if value else F.count("*")).alias("value"))
    step = {"quarter": "3 month"}.get(unit, f"1 {unit}")
    calendar = rows.agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi")).where("lo is not null").select(F.explode(F.expr(f"sequence(lo, hi, interval {step})")).alias("bucket"))
    if by:
        calendar = calendar.join(F.broadcast(rows.select("group").distinct()), how="cross")  # at most top groups
    out = calendar.join(made, keys, "left")
    if not value:
        out = out.withColumn("value", F.coalesce("value", F.lit(0)))
    if running:
        w = W.partitionBy("group") if by else W.partitionBy(F.lit(0))
        out = out.withColumn("running", F.sum("value").over(w.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)))
    return out


def time_boxes(df: DataFrame, ts: str, column: str, unit: str) -> DataFrame:
    return box(df.withColumn("__bucket", bucket(_c(ts).cast("timestamp"), unit)).where("__bucket is not null"), column, ["__bucket"]).withColumnRenamed("__bucket", "bucket")


def time_pairs(df: DataFrame, ts: str, column: str, unit: str, top: int = 10) -> DataFrame:
    """(bucket, value, count): a text over time, all but its most frequent values as Others."""
    rows = df.select(bucket(_c(ts).cast("timestamp"), unit).alias("bucket"), _c(column).cast("string").alias("value")).where("bucket is not null and value is not null")
    first = value_counts(rows, "value", top).select(F.col("value").alias("t"))
    rows = rows.join(F.broadcast(first), F.col("value") == F.col("t"), "left").withColumn("value", F.coalesce("t", F.lit("Others")))  # at most top rows
    return rows.groupBy("bucket", "value").agg(F.count("*").alias("count"))


#: From which share, or number, on a finding is told.
THRESHOLDS = {"duplicates": 0.01, "missing": 0.01, "zeros": 0.05, "negatives": 0.01, "infinity": 0.01, "high_cardinality": 50, "constant": 1, "skewed": 1e-5, "uniform": 0.999, "normal": 0.99, "similar_distribution": 0.05}


def _binned(df: DataFrame, columns: dict[int, tuple[str, float, float]], bins: int = 50) -> dict[int, list[int]]:
    """Counts by bins of equal width between the given limits of each numeric column; one pass for all columns."""
    found = {i: [0] * bins for i in columns}
    if columns:
        cells = F.array(*[F.struct(F.lit(i).alias("i"), bin_of(finite(_c(c)), F.lit(lo), F.lit(hi), bins).alias("bin")) for i, (c, lo, hi) in columns.items()])
        cells = df.select(F.explode(cells).alias("v")).select("v.*")
        for r in cells.where("bin is not null").groupBy("i", "bin").agg(F.count("*").alias("n")).collect():  # bins rows for each column at most
            found[r["i"]][r["bin"]] = r["n"]
    return found


def insights(df: DataFrame, thresholds: dict[str, float] = THRESHOLDS) -> DataFrame:
    """(kind, column, value): what stands out in a frame, from one aggregate over all columns, the count of distinct rows and one pass for all 50-bin histograms."""
    t = thresholds
    aggs = [F.count("*").alias("rows")]
    for i, f in enumerate(df.schema):
        c = _c(f.name)
        if is_numeric(f.dataType):
            x, r = finite(c), real(c)
            aggs += [F.count(r).alias(f"n{i}"), F.count_distinct(r).alias(f"d{i}"), F.count_if(x == 0).alias(f"z{i}"), F.count_if(x < 0).alias(f"g{i}"), (F.count(r) - F.count(x)).alias(f"i{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
        else:
            shown = as_text(c, f.dataType)
            aggs += [F.count(c).alias(f"n{i}"), F.count_distinct(shown).alias(f"d{i}"), F.min(F.char_length(shown)).alias(f"short{i}"), F.max(F.char_length(shown)).alias(f"long{i}")]
    row = df.agg(*aggs).first()
    n, out = row["rows"], []
    if not n:
        return df.sparkSession.createDataFrame([], "kind string, column string, value double")
    numbers = [i for i, f in enumerate(df.schema) if is_numeric(f.dataType) and row[f"lo{i}"] is not None]
    binned = _binned(df, {i: (df.columns[i], row[f"lo{i}"], row[f"hi{i}"]) for i in numbers})
    distinct = df.distinct().count()
    if 1 - distinct / n > t["duplicates"]:
        out.append(("duplicates", None, 1 - distinct / n))
    for i, f in enumerate(df.schema):
        here = row[f"n{i}"]
        if 1 - here / n > t["missing"]:
            out.append(("missing", f.name, 1 - here / n))
        if row[f"d{i}"] == t["constant"]:
            out.append(("constant", f.name, 1.0))
        if is_numeric(f.dataType):
            for kind, k in (("zeros", "z"), ("negatives", "g"), ("infinity", "i")):
                if row[f"{k}{i}"] / n > t[kind]:
                    out.append((kind, f.name, row[f"{k}{i}"] / n))
            counts = binned.get(i, [])
            if counts and row[f"d{i}"] > 1:
                if D.chi_square_uniform(counts)[1] > t["uniform"]:
                    out.append(("uniform", f.name, D.chi_square_uniform(counts)[1]))
                if D.normal_test(counts)[1] > t["normal"]:
                    out.append(("normal", f.name, D.normal_test(counts)[1]))
                if D.skew_test(counts)[1] < t["skewed"]:
                    out.append(("skewed", f.name, D.skew_test(counts)[1]))
        elif not is_time(f.dataType) and here:
            if row[f"d{i}"] > t["high_cardinality"]:
                out.append(("high_cardinality", f.name, float(row[f"d{i}"])))
            if row[f"short{i}"] == row[f"long{i}"]:
                out.append(("constant_length", f.name, float(row[f"long{i}"])))
            if row[f"d{i}"] == here:
                out.append(("unique", f.name, float(here)))
    return df.sparkSession.createDataFrame(out, "kind string, column string, value double")


#: The order in which findings are shown.
SHOWN = ("uniform", "similar_distribution", "missing", "skewed", "infinity", "duplicates", "normal", "high_cardinality", "constant", "constant_length", "unique", "negatives", "zeros")


def insight_pages(found: DataFrame, size: int = 10) -> DataFrame:
    """Findings in the order of their kinds, then of the columns' names, with the page each is on; there are a few for each column of a frame."""
    place = F.array_position(F.array(*[F.lit(k) for k in SHOWN]), F.col("kind"))
    row = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.when(place > 0, place).otherwise(len(SHOWN) + 1), "kind", "column"))
    return found.withColumn("page", F.ceil(row / size).cast("int"))
