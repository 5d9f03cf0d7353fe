"""Correlation, regression, missing values, comparison of frames, and outliers."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import distributions as D
from ..functions.nulls import finite, is_numeric, real
from .profile import RANGES, _c, auto_unit, below_splits, box, bucket, histogram, median, placed_values, splits_of, value_counts, value_splits


def _corr(a: Column, b: Column) -> Column:
    """The correlation of two columns that are null together; null if one is constant."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def _pairs(df: DataFrame, columns: list[str] | None) -> tuple[list[str], list[tuple[str, str]]]:
    columns = columns or [f.name for f in df.schema if is_numeric(f.dataType)]
    return columns, [(a, b) for i, a in enumerate(columns) for b in columns[:i]]


def _long(row: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    items = [F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"p{k}").alias("correlation")) for k, (a, b) in enumerate(pairs)]
    return row.select(F.explode(F.array(*items)).alias("z")).select("z.*")


def pearson(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(x, y, correlation) below the diagonal, each pair over the rows that have both; one aggregate for all pairs."""
    _, pairs = _pairs(df, columns)
    return _long(df.agg(*[_corr(F.when(finite(_c(b)).isNotNull(), finite(_c(a))), F.when(finite(_c(a)).isNotNull(), finite(_c(b)))).alias(f"p{k}") for k, (a, b) in enumerate(pairs)]), pairs)


def _counted_pairs(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(i, u, v, n): each distinct pair of values of the i-th pair of columns with its frequency."""
    cells = [F.struct(F.lit(i).alias("i"), (real(_c(a)) + 0.0).alias("u"), (real(_c(b)) + 0.0).alias("v")) for i, (a, b) in enumerate(pairs)]
    rows = df.select(F.explode(F.array(*cells)).alias("z")).select("z.*").where("u is not null and v is not null")
    return rows.groupBy("i", "u", "v").agg(F.count("*").alias("n"))


def _side_splits(df: DataFrame, columns: list[str], pairs: list[tuple[str, str]]) -> list[list[list[float]]]:
    """For the first and the second column of all pairs, the values that cut it."""
    cuts = dict(zip(columns, value_splits(df, columns), strict=True))
    return [[cuts[pair[side]] for pair in pairs] for side in (0, 1)]


def _named(found: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """found (i, correlation) by the names of the i-th pair."""
    names = F.get(F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in pairs]), F.col("i"))
    return found.select(names["x"].alias("x"), names["y"].alias("y"), "correlation")


def _ranks(counted: DataFrame, side: str, splits: list[list[float]]) -> DataFrame:
    """(i, side, rank from the middle of all, n): average ranks, counted from 0 at the mean rank."""
    values = counted.groupBy("i", F.col(side).alias("x")).agg(F.sum("n").alias("n")).withColumn("g", F.struct(F.lit(0).alias("all")))
    rank = F.col("below") + (F.col("n") + 1) / 2 - (F.col("total") + 1) / 2
    return placed_values(values, splits).select("i", F.col("x").alias(side), rank.alias(f"r{side}"))


def spearman(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(x, y, correlation) of average ranks, for each pair over the rows that have both; null if one column is constant. Ranks come from counted values."""
    columns, pairs = _pairs(df, columns)
    counted, (su, sv) = _counted_pairs(df, pairs), _side_splits(df, columns, pairs)
    ranked = counted.join(_ranks(counted, "u", su), ["i", "u"]).join(_ranks(counted, "v", sv), ["i", "v"])
    weighted = lambda a, b: F.sum(F.col("n") * F.col(a) * F.col(b))
    found = ranked.groupBy("i").agg(F.try_divide(weighted("ru", "rv"), F.sqrt(weighted("ru", "ru")) * F.sqrt(weighted("rv", "rv"))).alias("correlation"))
    return _named(found, pairs)


def inversions(u: np.ndarray, v: np.ndarray, n: np.ndarray) -> float:
    """The weight of pairs with u below and v above: sum of n_a * n_b over u_a < u_b and v_a > v_b.

    Points are put in the order of u, equal ones by v. For each bit of v's rank, from the highest on, points that share all higher bits
    stay in that order together, and ones before zeros among them are inversions.
    """
    order = np.lexsort((v, u))
    rank, w = np.unique(v[order], return_inverse=True)[1], n[order].astype(float)
    total = 0.0
    for bit in range(int(rank.max(initial=0)).bit_length() - 1, -1, -1):
        block = rank >> (bit + 1)
        by_block = np.argsort(block, kind="stable")
        ones, weight, block = (rank[by_block] >> bit) & 1, w[by_block], block[by_block]
        seen = np.cumsum(weight * ones)
        start = np.searchsorted(block, block)
        before = seen - np.where(start > 0, seen[start - 1], 0.0)
        total += float((weight * before)[ones == 0].sum())
    return total


def _inverted(points: DataFrame, by: list[str], u: str, v: str) -> DataFrame:
    """(i, d): the weight of inversions within each group of points."""

    def one(key, pdf):
        return pd.DataFrame({"i": [key[0]], "d": [inversions(pdf["u"].to_numpy(), pdf["v"].to_numpy(), pdf["n"].to_numpy())]})

    return points.select(*by, F.col(u).cast("double").alias("u"), F.col(v).cast("double").alias("v"), "n").groupBy(*by).applyInPandas(one, "i int, d double")


def kendall(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(x, y, correlation): tau-b of each pair of columns, over the rows that have both; null if one column is constant.

    Discordant pairs are counted by ranges: u and v are cut into ranges of about equal size, with a range of its own for each value that cuts. Two points lie
    in the same range of u (counted there), else in the same range of v (counted there, by the ranges of u), else in neither (counted
    from the table of ranges). Points of one value never invert, so no task holds more than about one range, whatever value is frequent.
    """
    columns, pairs = _pairs(df, columns)
    counted, (su, sv) = _counted_pairs(df, pairs), _side_splits(df, columns, pairs)
    range_of = lambda x, splits: below_splits(F.col(x), splits) * 2 + F.array_contains(splits, F.col(x)).cast("int")
    dealt = counted.withColumns({"ru": range_of("u", splits_of(su, F.col("i"))), "rv": range_of("v", splits_of(sv, F.col("i")))})
    same_u = _inverted(dealt.where("ru % 2 = 0"), ["i", "ru"], "u", "v")
    same_v = _inverted(dealt.where("rv % 2 = 0").groupBy("i", "rv", "ru", "v").agg(F.sum("n").alias("n")), ["i", "rv"], "ru", "v")
    apart = _inverted(dealt.groupBy("i", "ru", "rv").agg(F.sum("n").alias("n")), ["i"], "ru", "rv")  # at most (2 * RANGES) ** 2 points
    against = same_u.union(same_v).union(apart).groupBy("i").agg(F.sum("d").alias("against"))
    n = F.col("n").cast("double")
    tied = lambda *by: counted.groupBy("i", *by).agg(F.sum("n").alias("n")).groupBy("i").agg(F.sum(n * (n - 1) / 2).alias("t" + "".join(by)))
    sums = tied().join(tied("u"), "i").join(tied("v"), "i").join(tied("u", "v"), "i").join(against, "i", "left")
    score = F.col("t") - F.col("tu") - F.col("tv") + F.col("tuv") - 2 * F.coalesce("against", F.lit(0.0))
    return _named(sums.select("i", F.try_divide(score, F.sqrt(F.col("t") - F.col("tu")) * F.sqrt(F.col("t") - F.col("tv"))).alias("correlation")), pairs)


def strongest(correlations: DataFrame, k: int | None = None, limits: tuple[float, float] | None = None) -> DataFrame:
    """The k pairs of the largest absolute value (with ties), or those within limits."""
    if k is not None:
        correlations = correlations.withColumn("__r", F.rank().over(W.partitionBy(F.lit(0)).orderBy(F.desc(F.abs("correlation"))))).where(f"__r <= {k}").drop("__r")
    return correlations.where(F.col("correlation").between(*limits)) if limits else correlations


def against_all(correlations: DataFrame, column: str) -> DataFrame:
    """(column, correlation): the correlations of one column with every other."""
    one = (F.col("x") == column) | (F.col("y") == column)
    return correlations.where(one).select(F.when(F.col("x") == column, F.col("y")).otherwise(F.col("x")).alias("column"), "correlation")


def missing_impact_all(df: DataFrame, column: str) -> DataFrame:
    """(column, before, after): how many values of every other column there are, and remain once rows without column are dropped; one aggregate."""
    others = [c for c in df.columns if c != column]
    left = F.col(f"`{column}`").isNotNull()
    row = df.agg(*[F.struct(F.count(F.col(f"`{c}`")).alias("before"), F.count(F.when(left, F.col(f"`{c}`"))).alias("after")).alias(f"c{i}") for i, c in enumerate(others)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{i}.before").alias("before"), F.col(f"c{i}.after").alias("after")) for i, c in enumerate(others)])).alias("x")).select("x.*")


def regression(df: DataFrame, x: str, y: str) -> DataFrame:
    """Slope and intercept of y on x, their correlation and the number of rows."""
    a, b = finite(_c(x)), finite(_c(y))
    return df.agg(F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"), _corr(F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)).alias("correlation"), F.count(F.when(a.isNotNull() & b.isNotNull(), 1)).alias("count"))


def influence(df: DataFrame, x: str, y: str, keys: list[str], k: int = 10) -> DataFrame:
    """The k rows whose removal changes the correlation of x and y most, by the closed form for leaving one out."""
    rows = df.select(*[_c(c).alias(c) for c in keys], finite(_c(x)).alias("u"), finite(_c(y)).alias("v")).where("u is not null and v is not null")
    s = rows.agg(F.count("*").alias("n"), F.avg("u").alias("mu"), F.avg("v").alias("mv"), F.var_pop("u").alias("su"), F.var_pop("v").alias("sv"), F.covar_pop("u", "v").alias("c"))
    n = F.col("n")
    du, dv = F.col("u") - F.col("mu"), F.col("v") - F.col("mv")
    f = n / (n - 1)
    left = (n * F.col("c") - f * du * dv) / F.sqrt((n * F.col("su") - f * du * du) * (n * F.col("sv") - f * dv * dv))
    joined = rows.join(F.broadcast(s), how="cross").withColumn("influence", F.col("c") / F.sqrt(F.col("su") * F.col("sv")) - left)  # one row of sums
    return joined.select(*keys, "influence").orderBy(F.desc(F.abs("influence")), *keys).limit(k)


def _missing(df: DataFrame) -> dict[str, object]:
    return {f.name: (real(_c(f.name)).isNull() if is_numeric(f.dataType) else _c(f.name).isNull()) for f in df.schema}


def missing_bars(df: DataFrame) -> DataFrame:
    """(column, present, missing)."""
    m = _missing(df)
    row = df.agg(F.count("*").alias("rows"), *[F.count_if(v).alias(f"m{i}") for i, v in enumerate(m.values())])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), (F.col("rows") - F.col(f"m{i}")).alias("present"), F.col(f"m{i}").alias("missing")) for i, c in enumerate(m)])).alias("z")).select("z.*")


def missing_stats(df: DataFrame) -> DataFrame:
    """Missing cells, rows and columns, and the averages for each row and column."""
    m = _missing(df)
    per_row = sum((v.cast("long") for v in m.values()), F.lit(0))
    row = df.select(per_row.alias("__k"), *[v.alias(f"m{i}") for i, v in enumerate(m.values())])
    out = row.agg(F.count("*").alias("rows"), F.sum("__k").alias("missing_cells"), F.count_if(F.col("__k") > 0).alias("missing_rows"), *[F.max(f"m{i}").alias(f"m{i}") for i in range(len(m))])
    columns = sum((F.col(f"m{i}").cast("long") for i in range(len(m))), F.lit(0))
    return out.select("rows", "missing_cells", "missing_rows", columns.alias("missing_columns"), (F.col("missing_cells") / F.col("rows")).alias("per_row"), (F.col("missing_cells") / len(m)).alias("per_column"))


def most_missing(df: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    """(kind, name, missing): of columns and of rows, named by their keys, the first k of those that lack most; none if nothing is missing."""
    columns = missing_bars(df).where("missing > 0").select(F.lit("column").alias("kind"), F.col("column").alias("name"), "missing")
    cells = sum((v.cast("long") for v in _missing(df).values()), F.lit(0))
    rows = df.select(F.lit("row").alias("kind"), F.concat_ws(",", *[_c(c).cast("string") for c in keys]).alias("name"), cells.alias("missing")).where("missing > 0")
    first = lambda found: found.orderBy(F.desc("missing"), "name").limit(k)
    return first(columns).union(first(rows))


def _key_splits(df: DataFrame, key: str) -> list:
    """Values in order that cut the rows by a key of any type into RANGES ranges of about equal size.

    They come from chance rows and differ from run to run, so they are fetched once: all that is placed by them is placed by the same ones.
    """
    some = df.select(_c(key).alias("k")).where("k is not null").orderBy(F.rand()).limit(RANGES * 64).agg(F.sort_array(F.collect_list("k")).alias("k"))
    cuts = F.transform(F.sequence(F.lit(1), F.lit(RANGES - 1)), lambda j: F.get("k", F.floor(j * F.size("k") / RANGES).cast("int")))
    return some.select(F.array_distinct(F.filter(cuts, lambda x: x.isNotNull()))).first()[0]


def _with_range(rows: DataFrame, key: str, splits: list) -> DataFrame:
    """rows with __range, how many of the splits are below the key, by nested conditions, which are compiled.

    Splits are literals, but for types that Python may give back in another order, such as times in clock changes, one row that is joined.
    """
    kind = rows.schema[key].dataType
    if isinstance(kind, (T.NumericType, T.StringType, T.BooleanType, T.DateType)):
        split = lambda j: F.lit(splits[j])
    else:
        made = rows.sparkSession.createDataFrame([(splits,)], T.StructType([T.StructField("s", T.ArrayType(kind))]))
        rows = rows.join(F.broadcast(made.select(F.sort_array("s").alias("__splits"))), how="cross")  # one row
        split = lambda j: F.get("__splits", F.lit(j))

    def found(lo: int, hi: int) -> Column:
        middle = (lo + hi) // 2
        return F.lit(lo) if lo == hi else F.when(split(middle) < F.col(key), found(middle + 1, hi)).otherwise(found(lo, middle))

    return rows.withColumn("__range", found(0, len(splits))).drop("__splits")


def missing_spectrum(df: DataFrame, order: str, bins: int = 20) -> DataFrame:
    """(bin, column, missing, rows): contiguous bins of rows in the order of a key, rows of one key in the order of what they lack.

    Rows are counted by ranges of the key, which gives their number before each range. In ranges that lie in one bin only the masks count; in the others
    rows alike in key and masks are counted, and numbered within their range. Nothing depends on the partitions rows are in, which may differ each time
    the plan is run.
    """
    m = _missing(df)
    masks = [f"m{i}" for i in range(len(m))]
    rows = df.select(_c(order).alias("__key"), *[v.cast("long").alias(k) for k, v in zip(masks, m.values())])
    rows = _with_range(rows, "__key", _key_splits(df, order))
    held = dict(rows.groupBy("__range").count().collect())  # RANGES rows at most
    before = [0, *itertools.accumulate(held.get(r, 0) for r in range(RANGES))]
    n = before[-1]
    size = max(1, n // max(1, min(bins, n - 1)))
    several = [r for r, k in held.items() if before[r] // size != (before[r] + k - 1) // size]
    alike = rows.withColumn("__key", F.when(F.col("__range").isin(several), F.col("__key"))).groupBy("__range", "__key", *masks).agg(F.count("*").alias("__n"))
    inside = F.coalesce(F.sum("__n").over(W.partitionBy("__range").orderBy("__key", *masks).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = alike.withColumn("__from", F.get(F.array(*[F.lit(k).cast("long") for k in before]), F.col("__range")) + inside).withColumn("__to", F.col("__from") + F.col("__n"))
    at = lambda row: F.floor(row / size).cast("int")
    cut = placed.withColumn("bin", F.explode(F.sequence(at(F.col("__from")), at(F.col("__to") - 1))))
    start = F.col("bin").cast("long") * size
    cut = cut.withColumn("__k", F.least("__to", start + size) - F.greatest("__from", start))
    made = cut.groupBy("bin").agg(F.sum("__k").alias("rows"), *[F.sum(F.col(k) * F.col("__k")).alias(k) for k in masks])
    return made.select("bin", "rows", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(k).alias("missing")) for k, c in zip(masks, m)])).alias("z")).select("bin", "z.column", "z.missing", "rows")


def missing_heatmap(df: DataFrame) -> DataFrame:
    """(x, y, correlation) of being missing, for columns that are so in part."""
    m = {c: v.cast("double") for c, v in _missing(df).items()}
    row = df.agg(*[_corr(m[a], m[b]).alias(f"p{k}") for k, (a, b) in enumerate(itertools.combinations(m, 2))])
    return _long(row, list(itertools.combinations(m, 2))).where("correlation is not null and not isnan(correlation)")


def missing_dendrogram(df: DataFrame) -> list[tuple[int, int, float, int]]:
    """Average linkage of columns by the Euclidean distance of their masks; the distances come from one aggregate."""
    m = list(_missing(df).values())
    pairs = list(itertools.combinations(range(len(m)), 2))
    if not pairs:
        return []
    row = df.agg(*[F.count_if(m[a] != m[b]).alias(f"p{k}") for k, (a, b) in enumerate(pairs)]).first()
    d = np.zeros((len(m), len(m)))
    for k, (a, b) in enumerate(pairs):
        d[a, b] = d[b, a] = row[f"p{k}"] ** 0.5
    return D.average_linkage(d)


def missing_impact(df: DataFrame, x: str, y: str, bins: int = 50) -> DataFrame:
    """The distribution of y before and after dropping rows without x: (bin or value, before, after)."""
    gone = _missing(df)[x]
    if is_numeric(df.schema[y].dataType):
        lo, hi = df.agg(F.min(finite(_c(y))), F.max(finite(_c(y)))).first()
        before = histogram(df, y, bins, limits=(lo, hi)).withColumnRenamed("count", "before")
        return before.join(histogram(df.where(~gone), y, bins, limits=(lo, hi)).select("bin", F.col("count").alias("after")), "bin")
    rows = df.select(_c(y).cast("string").alias("value"), gone.alias("gone")).where("value is not null")
    return rows.groupBy("value").agg(F.count("*").alias("before"), F.count_if(~F.col("gone")).alias("after"))


def labelled(frames: dict[str, DataFrame]) -> DataFrame:
    """Several frames below one another, with their label in _src."""
    if not 2 <= len(frames) <= 5:
        raise ValueError("2 to 5 frames can be compared")
    out = None
    for name, df in frames.items():
        df = df.withColumn("_src", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def diff_stats(frames: dict[str, DataFrame]) -> DataFrame:
    """(_src, column, rows, missing, distinct, mean) for every column of every frame."""
    both = labelled(frames)
    cols = [f for f in both.schema if f.name != "_src"]
    aggs = []
    for i, f in enumerate(cols):
        c = real(_c(f.name)) if is_numeric(f.dataType) else _c(f.name)
        mean = F.avg(finite(_c(f.name))) if is_numeric(f.dataType) else F.lit(None).cast("double")
        aggs.append(F.struct(F.count("*").alias("rows"), (F.count("*") - F.count(c)).alias("missing"), F.count_distinct(c).alias("distinct"), mean.alias("mean")).alias(f"s{i}"))
    row = both.groupBy("_src").agg(*aggs)
    return row.select("_src", F.explode(F.array(*[F.struct(F.lit(f.name).alias("column"), F.col(f"s{i}.rows"), F.col(f"s{i}.missing"), F.col(f"s{i}.distinct"), F.col(f"s{i}.mean")) for i, f in enumerate(cols)])).alias("z")).select("_src", "z.*")


def diff_histogram(frames: dict[str, DataFrame], column: str, bins: int = 50) -> DataFrame:
    """Histograms of one column of all frames over common bins."""
    return histogram(labelled(frames), column, bins, by="_src").withColumnRenamed("group", "_src")


def diff_bars(frames: dict[str, DataFrame], column: str, top: int = 10) -> DataFrame:
    """(value, _src, count) for the first frame's most frequent values."""
    first = next(iter(frames.values()))
    keep = value_counts(first, column, top).select(F.col("value").alias("v"))
    rows = labelled(frames).select("_src", _c(column).cast("string").alias("value"))
    return rows.join(F.broadcast(keep), F.col("value") == F.col("v"), "left_semi").groupBy("value", "_src").agg(F.count("*").alias("count"))


def diff_times(frames: dict[str, DataFrame], column: str, unit: str | None = None) -> DataFrame:
    """(_src, bucket, count): the rows of each frame over time; the unit is that which suits the whole range, if none is given."""
    both = labelled(frames)
    unit = unit or auto_unit(both, column)
    rows = both.select("_src", bucket(_c(column).cast("timestamp"), unit).alias("bucket")).where("bucket is not null")
    return rows.groupBy("_src", "bucket").agg(F.count("*").alias("count"))


def diff_boxes(frames: dict[str, DataFrame], column: str) -> DataFrame:
    return box(labelled(frames), column, ["_src"])


def numeric_outliers(df: DataFrame, column: str, limit: float = 3.5, two_sided: bool = True) -> DataFrame:
    """The rows whose modified z-score, 0.6745 * (x - median) / MAD, is over limit."""
    x = finite(_c(column))
    middle = median(df, x).withColumnRenamed("median", "__median")
    rows = df.withColumn("__x", x).join(F.broadcast(middle), how="cross")  # one row
    mad = median(rows, F.abs(F.col("__x") - F.col("__median"))).withColumnRenamed("median", "__mad")
    z = F.try_divide(0.6745 * (F.col("__x") - F.col("__median")), F.col("__mad"))
    out = rows.join(F.broadcast(mad), how="cross").withColumn("z", z)
    return out.where((F.abs("z") if two_sided else F.col("z")) > limit).drop("__x", "__median", "__mad")


def rare_values(df: DataFrame, column: str, at_most: int = 1) -> DataFrame:
    return value_counts(df, column).where(F.col("count") <= at_most).select("value", "count")
