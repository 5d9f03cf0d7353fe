"""Near-duplicate documents by circulant MinHash, banding and exact verification.

A document's set holds the distinct runs of five lower-cased words. Two permutations give all signature coordinates: one scatters the set, the other is
shifted around by one place for each coordinate. 24 bands of 6 coordinates propose pairs: a pair at the link threshold of 0.85 is missed by all bands
with a chance of about 1e-5, one at 0.9 with 1e-8. For lower thresholds 30 bands of 5 propose: a pair at 0.8 is missed with a chance of about 7e-6. Full
sets decide.

Defined cases: null and empty texts, and texts of white space, have empty sets and link with nothing. A row with a null doc_id links with nothing, has a
null component_id and is kept. Rows that share a doc_id are one document: they get one component. Equal rows get equal results, one for each row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textsets as X
from .common import maybe_broadcast, small_batches, table, text_of
from .neardup import components, link

COORDINATES, BANDS, WIDTH, PERCENT = 144, 24, 5, 85
#: Coordinates and bands for thresholds below PERCENT.
LOOSE = 150, 30


def _sketch(parts: Iterator[pa.RecordBatch], coordinates: int, bands: int) -> Iterator[pa.RecordBatch]:
    circulant = X.Circulant(coordinates, bands)
    for part in parts:
        texts = part.column(1).to_pylist()
        for a, b in X.batches(texts):
            s = X.shingle_sets(X.words(texts[a:b]), WIDTH)
            yield pa.RecordBatch.from_arrays([part.column(0).slice(a, b - a), pa.array(s.sizes, pa.int64()), pa.array(X.digests(s), pa.binary()), pa.array(circulant.band_keys(s), pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "digest", "bands"])
    X.tidy()


def _sets(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        texts = part.column(1).to_pylist()
        for a, b in X.batches(texts):
            s = X.shingle_sets(X.words(texts[a:b]), WIDTH)
            items = pa.ListArray.from_arrays(pa.array(s.first, pa.int32()), pa.array(s.items.view("int64"), pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0).slice(a, b - a), items], names=["node", "items"])
    X.tidy()


def sketches(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, digest (of the set; null if empty) and bands of each row, in one pass over the texts."""
    small_batches(docs.sparkSession)
    coordinates, bands = (COORDINATES, BANDS) if percent >= PERCENT else LOOSE
    sketch = partial(_sketch, coordinates=coordinates, bands=bands)
    return docs.select(F.col("doc_id").cast("long"), text_of().cast("binary").alias("text")).mapInArrow(sketch, "doc_id long, n_shingles long, digest binary, bands array<long>")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs (doc_id, text)."""
    seen = table(sketches(docs, percent), "sketches")
    known = seen.where("doc_id is not null and digest is not null")
    classes = table(known.groupBy("digest").agg(F.min("doc_id").alias("node"), F.min("bands").alias("bands")), "classes")

    def sets_of(nodes: DataFrame) -> DataFrame:
        wanted = maybe_broadcast(table(nodes, "nodes"))
        picked = docs.select(F.col("doc_id").cast("long").alias("node"), text_of().cast("binary").alias("text")).join(wanted, "node", "left_semi")
        return picked.mapInArrow(_sets, "node long, items array<long>").where("size(items) > 0")

    links, comps = link(classes, sets_of, percent)
    named = classes.select("digest", "node")
    shared = known.groupBy("digest", "doc_id").count().groupBy("doc_id").count().where("count > 1").select("doc_id")
    tied = table(known.join(shared, "doc_id", "left_semi").join(named, "digest").where("node != doc_id").select(F.col("node").alias("a"), F.col("doc_id").alias("b")), "tied")
    if not tied.isEmpty():  # rows of one id but of several texts tie those texts' classes together
        comps = components(links.select("a", "b").union(tied))
    named = named.join(comps, "node", "left").select("digest", F.coalesce("comp", "node").alias("component_id"))
    return _finish(seen.join(named, "digest", "left"))


def _finish(df: DataFrame) -> DataFrame:
    own = F.coalesce("component_id", "doc_id")
    return df.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs without all but the first document of each near-duplicate group; of equal doc_ids all rows stay or go together."""
    gone = near_duplicates(docs, percent).where("not kept").select("doc_id").distinct()
    return docs.join(maybe_broadcast(table(gone, "gone")), "doc_id", "left_anti").select(*docs.columns)
