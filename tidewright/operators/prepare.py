"""Whole-frame cleaning, preparation for learning, and clustering of near-equal values."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.nulls import is_null, is_numeric, to_null
from .profile import counted_values, exact_quantiles, value_splits
from .text import clean_headers


def standardise_nulls(df: DataFrame) -> DataFrame:
    """Texts that stand for a missing value become null."""
    return df.select(*[to_null(F.col(f"`{f.name}`")).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f"`{f.name}`") for f in df.schema])


def downcast(df: DataFrame) -> DataFrame:
    """Whole numbers in the smallest type that holds the column's range, doubles as float; one aggregate for all columns."""
    whole = [f.name for f in df.schema if f.dataType.simpleString() in ("smallint", "int", "bigint")]
    if not whole:
        return df
    r = df.agg(*[F.min(f"`{c}`").alias(f"lo{i}") for i, c in enumerate(whole)], *[F.max(f"`{c}`").alias(f"hi{i}") for i, c in enumerate(whole)]).first()
    to = {}
    for i, c in enumerate(whole):
        lo, hi = r[f"lo{i}"], r[f"hi{i}"]
        to[c] = next((k for k, b in (("tinyint", 2**7), ("smallint", 2**15), ("int", 2**31)) if lo is not None and -b <= lo and hi < b), "bigint")
    return df.select(*[F.col(f"`{c}`").cast(to[c]).alias(c) if c in to else F.col(f"`{c}`") for c in df.columns])


def clean_df(df: DataFrame, headers: bool = True, missing: str = "fill", duplicates: bool = False, memory: bool = False) -> DataFrame:
    df = clean_headers(df) if headers else df
    if missing != "ignore":
        df = standardise_nulls(df)
    if missing == "remove":
        df = df.na.drop()
    df = df.dropDuplicates() if duplicates else df
    return downcast(df) if memory else df


def fingerprint(c: Column) -> Column:
    t = F.regexp_replace(F.lower(F.trim(c)), r"[\p{Punct}\p{Cntrl}]", "")
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(t, r"\s+"), lambda w: w != ""))), " ")


def ngram_fingerprint(c: Column, n: int = 2) -> Column:
    t = F.regexp_replace(F.lower(c), r"[\p{Punct}\p{Cntrl}\s]", "")
    grams = F.when(F.char_length(t) >= n, F.transform(F.sequence(F.lit(1), F.char_length(t) - n + 1), lambda i: F.substring(t, i, F.lit(n)))).otherwise(F.array(t))
    return F.array_join(F.array_sort(F.array_distinct(grams)), "")


def cluster_by_key(df: DataFrame, column: str, key: Column) -> DataFrame:
    """(key, members: array of (value, count), the most frequent first, size) for keys of several values; distinct values are grouped, not rows."""
    values = df.where(F.col(f"`{column}`").isNotNull()).groupBy(F.col(f"`{column}`").alias("value")).agg(F.count("*").alias("count"))
    grouped = values.withColumn("key", key).groupBy("key").agg(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("less"), "value"))).alias("m"))
    return grouped.where(F.size("m") > 1).select("key", F.transform("m", lambda x: F.struct(x["value"].alias("value"), (-x["less"]).alias("count"))).alias("members"), F.size("m").alias("size"))


def near_values(df: DataFrame, column: str, radius: int = 2, block: int = 6) -> DataFrame:
    """(a, b, distance): pairs of distinct values that share a run of block characters and are within radius edits.

    An edit changes block runs at most, so of two near values each has a shared run among its radius * block + 1 rarest: only those are joined on.
    """
    values = df.select(F.col(f"`{column}`").alias("v")).where("v is not null").distinct()
    runs = F.when(F.char_length("v") > block, F.transform(F.sequence(F.lit(1), F.char_length("v") - block + 1), lambda i: F.substring(F.col("v"), i, F.lit(block)))).otherwise(F.array(F.col("v")))
    blocks = values.select("v", F.explode(F.array_distinct(runs)).alias("g"))
    often = blocks.groupBy("g").agg(F.count("*").alias("n")).where("n > 1")
    rarest = F.row_number().over(W.partitionBy("v").orderBy("n", "g"))  # as many runs as the value has
    shared = blocks.join(often, "g").withColumn("k", rarest)
    kept = shared.where(F.col("k") <= radius * block + 1).select("v", "g")
    other = kept.select(F.col("v").alias("b"), "g")
    near = (F.col("a") < F.col("b")) & (F.abs(F.char_length("a") - F.char_length("b")) <= radius)
    pairs = kept.withColumnRenamed("v", "a").join(other, "g").where(near).select("a", "b").distinct()
    return pairs.withColumn("distance", F.levenshtein("a", "b", radius)).where("distance >= 0")


def star_clusters(df: DataFrame, column: str, radius: int = 2, block: int = 6) -> DataFrame:
    """(cluster, value): each value that has near ones is the centre of a cluster of itself and them; equal clusters are given once, named by their first centre.

    Clusters overlap and aren't closed by chains. They are told apart by two hashes of their members and their size, so that none is gathered.
    """
    pairs = near_values(df, column, radius, block).select("a", "b")
    either = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    members = either.union(either.select("a", F.col("a").alias("b")).distinct()).select(F.col("a").alias("centre"), F.col("b").alias("value"))
    marks = [F.bit_xor(F.xxhash64("value")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(1), "value")).alias("h2"), F.count("*").alias("size")]
    centres = members.groupBy("centre").agg(*marks).groupBy("h1", "h2", "size").agg(F.min("centre").alias("centre")).select("centre")
    return members.join(centres, "centre").select(F.col("centre").alias("cluster"), "value")


def merge_values(df: DataFrame, column: str, mapping: dict[str, str]) -> DataFrame:
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return df.withColumn(column, F.coalesce(F.element_at(F.create_map(*pairs), F.col(f"`{column}`")), F.col(f"`{column}`"))) if pairs else df


class Prepare:
    """Imputation, encoding, variance threshold and scaling, fitted by aggregates over the training rows; only what the options ask for is computed.

    One-hot encoding holds a column's values in its plan, as one literal; those of a column of more than categories values are read again from the training rows, where the column is used.
    """

    def __init__(self, target: str, cat_imputation: str = "constant", fill: str = "missing_value", num_imputation: str = "mean", cat_encoding: str = "one_hot", variance: float | None = None, num_scaling: str = "standardize", categories: int = 10_000) -> None:
        self.target, self.cat, self.fill, self.num, self.encoding, self.variance, self.scaling = target, cat_imputation, fill, num_imputation, cat_encoding, variance, num_scaling
        self.categories = categories
        self.columns: dict[str, Column | None] = {}

    def fit(self, df: DataFrame) -> Prepare:
        numbers = [f.name for f in df.schema if is_numeric(f.dataType) and f.name != self.target]
        texts = [f.name for f in df.schema if f.dataType.simpleString() == "string" and f.name != self.target]
        x = lambda c: F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double"))
        seen = lambda c: [F.count(c).alias("n"), F.count("*").alias("rows")]
        aggs = [F.struct(*seen(x(c)), *([F.avg(x(c)).alias("mean")] if self.num == "mean" else [])).alias(f"n{i}") for i, c in enumerate(numbers)]
        aggs += [F.struct(*seen(to_null(F.col(f"`{c}`")))).alias(f"t{i}") for i, c in enumerate(texts)]
        row = {k: v.asDict() for k, v in df.agg(*aggs).first().asDict().items()} if aggs else {}
        self._fit_counted(df, numbers, texts, row)
        filled = {}
        for i, c in enumerate(numbers):
            s = row[f"n{i}"]
            filled[c] = None if self.num == "drop" and s["n"] < s["rows"] else F.coalesce(x(c), F.lit(s[self.num] if self.num != "drop" else None))
        kept = [c for c in numbers if filled[c] is not None]
        second = df.agg(*[F.struct(F.avg(filled[c]).alias("mean"), F.stddev_samp(filled[c]).alias("std"), F.min(filled[c]).alias("lo"), F.max(filled[c]).alias("hi"), F.var_samp(filled[c]).alias("var")).alias(f"n{i}") for i, c in enumerate(kept)]).first() if kept else None
        for i, c in enumerate(kept):
            s, v = second[f"n{i}"], filled[c]
            if self.variance is not None and not (s["var"] or 0) > self.variance:
                self.columns[c] = None
                continue
            scale = {"standardize": ((v - F.lit(s["mean"])), s["std"]), "minmax": (v - F.lit(s["lo"]), (s["hi"] or 0) - (s["lo"] or 0)), "maxabs": (v, max(abs(s["lo"] or 0), abs(s["hi"] or 0))), "none": (v, 1.0)}[self.scaling]
            self.columns[c] = F.try_divide(scale[0], F.lit(float(scale[1] or 0)))
        for c in numbers:
            self.columns.setdefault(c, None)
        for i, c in enumerate(texts):
            s = row[f"t{i}"]
            if self.cat == "drop" and s["n"] < s["rows"]:
                self.columns[c] = None
                continue
            fill = s["most_frequent"] if self.cat == "most_frequent" else self.fill
            v = F.coalesce(to_null(F.col(f"`{c}`")), F.lit(fill))
            if self.encoding != "one_hot":
                self.columns[c] = v
                continue
            also = [fill] if s["n"] < s["rows"] and fill is not None else []
            # one literal for all values: with an expression for each, Spark takes minutes to resolve 10,000, even where the column isn't used
            values = self._values(df, c, also) if s["values"] is None else F.from_json(F.lit(json.dumps(sorted({*s["values"], *also}))), "array<string>")
            size, at = F.size(values), F.array_position(values, v).cast("int")  # Spark takes no subquery in transform()
            found = F.concat(F.array_repeat(F.lit(0.0), at - 1), F.array(F.lit(1.0)), F.array_repeat(F.lit(0.0), size - at))
            self.columns[c] = F.when(at > 0, found).otherwise(F.array_repeat(F.when(v.isNotNull(), 0.0), size))
        return self

    @staticmethod
    def _values(df: DataFrame, c: str, also: list[str]) -> Column:
        """The values of a text column in order, as one array: a subquery, which Spark only runs if its result is used."""
        found = df.select(to_null(F.col(f"`{c}`")).alias("x")).where("x is not null").distinct().agg(F.collect_list("x").alias("values"))
        return found.select(F.array_sort(F.array_union("values", F.array(*[F.lit(x) for x in also]).cast("array<string>")))).scalar()

    def _fit_counted(self, df: DataFrame, numbers: list[str], texts: list[str], row: dict[str, dict]) -> None:
        """Adds to row what only some options need, from counted values: medians, most frequent values, and the values of each text column."""
        if self.num == "median" and numbers:
            found = {r["i"]: r["value"] for r in exact_quantiles(counted_values(df, numbers), value_splits(df, numbers), (0.5,)).collect()}  # a row for each column
            for i in range(len(numbers)):
                row[f"n{i}"]["median"] = found.get(i)
        if self.num == "most_frequent" and numbers:
            self._most_frequent(counted_values(df, numbers).drop("g"), row, "n")
        if texts and (self.encoding == "one_hot" or self.cat == "most_frequent"):
            cells = F.array(*[F.struct(F.lit(i).alias("i"), to_null(F.col(f"`{c}`")).alias("x")) for i, c in enumerate(texts)])
            counted = df.select(F.explode(cells).alias("v")).select("v.*").where("x is not null").groupBy("i", "x").agg(F.count("*").alias("n"))
            if self.cat == "most_frequent":
                self._most_frequent(counted, row, "t")
            if self.encoding == "one_hot":
                many = [r["i"] for r in counted.groupBy("i").agg(F.count("*").alias("k")).where(F.col("k") > self.categories).collect()]  # a row for each column at most
                for i in range(len(texts)):
                    row[f"t{i}"]["values"] = None if i in many else []
                for r in counted.where(~F.col("i").isin(many)).select("i", "x").collect():  # at most categories rows for each column
                    row[f"t{r['i']}"]["values"].append(r["x"])

    @staticmethod
    def _most_frequent(counted: DataFrame, row: dict[str, dict], kind: str) -> None:
        for key in row:
            if key[0] == kind:
                row[key]["most_frequent"] = None
        for r in counted.groupBy("i").agg(F.min_by("x", F.struct(-F.col("n"), "x")).alias("x")).collect():  # a row for each column
            row[f"{kind}{r['i']}"]["most_frequent"] = r["x"]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select(*[self.columns[c].alias(c) if self.columns.get(c) is not None else F.col(f"`{c}`") for c in df.columns if c not in self.columns or self.columns[c] is not None])


def has_null(df: DataFrame, column: str) -> bool:
    return not df.where(is_null(F.col(f"`{column}`"))).isEmpty()
