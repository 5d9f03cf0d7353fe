"""What the corpus operators share: tables that cut lineage, checked broadcasts and row identity."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a table may weigh to be broadcast, by weight(): its values and 24 bytes a row for the hash table over them.
BROADCAST_BYTES = 32 << 20
#: Arrow batches stay this small in rows and bytes, so that very long texts don't pile up in a Python worker.
BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20
#: Whether Spark removes the shuffle files of a query when it ends; otherwise they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a folder of this machine where that is unset and all runs here (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidewright-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes as well as by rows for this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def new_path(spark: SparkSession, what: str) -> str:
    """A fresh folder below the shared one, removed when the driver ends."""
    path = f"{shared_dir(spark)}/tidewright/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_remove)
    _written.append((spark, path))
    return path


def _delete(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def _remove() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone; then the cluster's own cleaning takes the folder
            return


def table(df: DataFrame, what: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: cuts lineage, outlives executors, and has a known size. The write's own shuffle files go with its end."""
    path = new_path(df.sparkSession, what)
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def drop(*tables: DataFrame | None) -> None:
    """Removes written tables that nothing reads any more, before the driver ends."""
    for t in tables:
        path = getattr(t, "_written_path", None)
        if path is not None:
            _delete(t.sparkSession, path)
            _written[:] = [x for x in _written if x[1] != path]


def drop_since(mark: int) -> None:
    """Removes all tables written since mark, a former result of written()."""
    for spark, path in _written[mark:]:
        _delete(spark, path)
    del _written[mark:]


def written() -> int:
    return len(_written)


def _bytes(value: Column, kind: T.DataType) -> Column:
    """About the bytes that a value takes in a row."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, T.StructType):
        return sum((_bytes(value[f.name], f.dataType) for f in kind.fields), F.lit(16))
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.StructType, T.ArrayType)):
            return F.coalesce(F.aggregate(value, F.lit(0), lambda acc, x: acc + _bytes(x, kind.elementType).cast("int")), F.lit(0)) + 24
        return F.coalesce(F.size(value), F.lit(0)) * 8 + 24
    return F.lit(8)


def weight(df: DataFrame) -> int:
    """About the bytes that df takes as the hash table of a broadcast join; one aggregate."""
    each = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(24))
    return df.agg(F.sum(each.cast("long"))).first()[0] or 0


def fits(df: DataFrame) -> bool:
    """Whether df, whose size is measured first, may be broadcast."""
    return weight(df) <= BROADCAST_BYTES


def maybe_broadcast(written: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if its measured bytes are few enough; otherwise as it is, to be joined by shuffle."""
    return F.broadcast(written) if fits(written) else written


def text_of(col: str | Column = "text") -> Column:
    """A text with null as the empty string."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def same_row(a: DataFrame, b: DataFrame, keys: tuple[str, ...]) -> Column:
    """Null-safe equality on keys of two frames."""
    on = F.lit(True)
    for k in keys:
        on = on & a[k].eqNullSafe(b[k])
    return on


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
