"""Tables from files and databases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def read_sql(spark: SparkSession, url: str, query: str | list[str], partition_on: str | None = None, partition_range: tuple[int, int] | None = None, partition_num: int = 8, **options: str) -> DataFrame:
    """A query, or several below one another, over JDBC; cut into ranges of a column if one is named."""
    frames = None
    for q in [query] if isinstance(query, str) else query:
        reader = spark.read.format("jdbc").options(url=url, dbtable=f"({q}) q", **options)
        if partition_on:
            lo, hi = partition_range or reader.options(dbtable=f"(SELECT min({partition_on}) AS lo, max({partition_on}) AS hi FROM ({q}) q) b").load().first()
            reader = reader.options(dbtable=f"({q}) q", partitionColumn=partition_on, lowerBound=lo, upperBound=hi, numPartitions=partition_num)
        df = reader.load()
        frames = df if frames is None else frames.unionByName(df)
    return frames


def catalog_report(spark: SparkSession) -> DataFrame:
    """(database, table, column, type, nullable) of the session's catalog."""
    rows = [(d.name, t.name, c.name, c.dataType, c.nullable) for d in spark.catalog.listDatabases() for t in spark.catalog.listTables(d.name) for c in spark.catalog.listColumns(f"`{d.name}`.`{t.name}`" if not t.isTemporary else t.name)]
    return spark.createDataFrame(rows, "database string, table string, column string, type string, nullable boolean")
