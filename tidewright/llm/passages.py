"""Substring dedup: paragraphs that repeat across documents, by MinHash banding, exact Jaccard and connected components.

A text is laid out in paragraphs of two kinds. A layout paragraph is a line of MIN_WORDS words or more, or a run of shorter lines of as many in all; it is
banded for high recall (BANDS bands of ROWS coordinates: a pair at Jaccard 0.8 collides with a chance of 99.8 %). A content-defined paragraph is a window
of PASSAGE words: of each AMONG consecutive windows the one of the smallest hash is picked, so that two copies of a passage of PASSAGE + AMONG - 1 = 50
words or more have a paragraph in common wherever they stand (W_BANDS bands of W_ROWS coordinates; two windows are near if they are equal but for a word at
either end, which collide with a chance of 97 %; equal ones always do). Paragraphs of either kind that share a bucket over several documents are joined and
verified on their full sets of five-word shingles; near ones are clustered by connected components.

In a cluster over several documents the copy of the smallest doc_id stays. The paragraphs of a document that share one keeper are merged to runs, and a run
is extended word by word to both sides as far as the keeper's text is the same (AMONG words at most: further ones hold another picked window). Runs
that at most WIDTH edited words part are one. Runs of fewer than MIN_RUN words are left alone. The words of the others are removed.

Defined cases: null and empty texts and null doc_ids have no paragraphs. Rows that share a doc_id are one document, so what repeats among them stays, but
each of its texts has its own spans; equal rows count once and are cut alike. Columns of docs other than doc_id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textsets as X
from .common import drop, maybe_broadcast, small_batches, table, text_of
from .neardup import link

MIN_WORDS, PASSAGE, AMONG, WIDTH, PERCENT, MIN_RUN = 20, 20, 31, 5, 80, 50
BANDS, ROWS, W_BANDS, W_ROWS = 12, 4, 3, 3
KEYS = ["doc_id", "row_hash"]
#: Bands are dealt over so many columns, whose buckets are worked off one after the other.
PARTS = 3
BANDS_OF = [f"bands_{k}" for k in range(PARTS)]


def layout(w: X.Words, newlines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges of words of the layout paragraphs of joined texts; newlines: where lines, and so texts, end."""
    edge = np.concatenate([[0], np.searchsorted(w.starts, newlines)])
    low, n = edge[:-1], np.diff(edge)
    short = (n > 0) & (n < MIN_WORDS)
    new = np.ones(len(n), bool)
    new[1:] = ~(short[1:] & short[:-1]) | np.isin(low[1:], w.first)  # a short line goes on where the line before is short and of the same text
    begin = np.flatnonzero(new)
    high = np.append(low[begin[1:]], edge[-1]) if len(begin) else begin
    long_enough = high - low[begin] >= MIN_WORDS
    return low[begin][long_enough], high[long_enough]


def picked_windows(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Start words of the picked windows of PASSAGE words, over the joined word hashes of several texts (first: where each begins)."""
    w = X.sequence_hash(h, PASSAGE)
    starts = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        v = w[a : max(a, b - PASSAGE + 1)]
        if not len(v):
            continue
        if len(v) < AMONG:
            starts.append(np.array([a + int(v.argmin())]))
        else:
            least = np.lib.stride_tricks.sliding_window_view(v, AMONG).argmin(1) + np.arange(len(v) - AMONG + 1)
            starts.append(a + np.unique(least))
    return np.concatenate(starts) if starts else np.zeros(0, np.int64)


def _names(s: X.Sets) -> list[int]:
    """64 bits that stand for each set; of n different ones, two share them with a chance of n * n / 2**65."""
    return [int.from_bytes(d[:8], "little", signed=True) for d in X.digests(s) if d is not None]


def _lists(rows: np.ndarray) -> pa.ListArray:
    """A list for each row of a matrix."""
    n, m = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * m, pa.int32()), pa.array(rows.ravel(), pa.int64()))


def _paragraphs(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    of_layout, of_windows = X.Circulant(BANDS * ROWS, BANDS), X.Circulant(W_BANDS * W_ROWS, W_BANDS, seed=11)
    for part in parts:
        texts = part.column(2).to_pylist()
        for a, b in X.batches(texts):
            w = X.words(texts[a:b])
            low, high = layout(w, np.flatnonzero(np.frombuffer(b"\n".join(texts[a:b]) + b"\n", np.uint8) == 10))
            start = picked_windows(w.hashes, w.first)
            for sketch, lo, hi, s in ((of_layout, low, high, X.range_sets(w.hashes, low, high, WIDTH)), (of_windows, start, start + PASSAGE, X.window_sets(w.hashes, start, PASSAGE, WIDTH))):
                of = np.searchsorted(w.first, lo, side="right") - 1
                from_text = w.first[of]
                names = pa.array(_names(s), pa.int64())
                bands = [_lists(part) for part in np.split(sketch.keys(s), PARTS, axis=1)]
                at = pa.array(of + a)
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(lo - from_text, pa.int32()), pa.array(hi - from_text, pa.int32()), names, *bands], names=[*KEYS, "start", "end", "node", *BANDS_OF])
    X.tidy()


def _paragraph_sets(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of wanted paragraphs (start, end, node) of texts."""
    for part in parts:
        texts, wanted = part.column(0).to_pylist(), part.column(1).to_pylist()
        for a, b in X.batches(texts):
            w = X.words(texts[a:b])
            asked = [(int(w.first[k]) + x["start"], int(w.first[k]) + x["end"], x["node"]) for k in range(b - a) for x in wanted[a + k]]
            low, high, node = (np.array(c, np.int64) for c in zip(*asked, strict=True))
            s = X.range_sets(w.hashes, low, high, WIDTH)
            items = pa.ListArray.from_arrays(pa.array(s.first, pa.int32()), pa.array(s.items.view("int64"), pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), items], names=["node", "items"])
    X.tidy()


def _around(h: np.ndarray, places: list[int], side: int) -> pa.ListArray:
    """Of each place the hashes of the AMONG words before it (side -1, nearest first) or from it on (side 1)."""
    return pa.array([h[max(0, p - AMONG) : p][::-1] if side < 0 else h[p : p + AMONG] for p in places], pa.list_(pa.int32()))


def _contexts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is wanted of each text, ranges of words (start, end, and what else) or places (place), with the words before and from there on."""
    for part in parts:
        texts, wanted = part.column(2).to_pylist(), part.column(3)
        for k, text in enumerate(texts):
            h = (X.words([text]).hashes >> X.U(32)).astype(np.uint32).view(np.int32)
            asked = wanted[k].values
            names = [f.name for f in asked.type]
            low, high = (asked.field(c).to_pylist() for c in (("place", "place") if "place" in names else ("start", "end")))
            at = pa.array(np.full(len(low), k))
            yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), *asked.flatten(), _around(h, low, -1), _around(h, high, 1)], names=[*KEYS, *names, "before", "after"])
    X.tidy()


def _alike(a: str, b: str) -> Column:
    """How many words two contexts have in common from their begin on."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y) & x.isNotNull())
    start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("on"))
    return F.aggregate(same, start, lambda acc, x: F.struct((acc["n"] + F.when(acc["on"] & x, 1).otherwise(0)).alias("n"), (acc["on"] & x).alias("on")), lambda acc: acc["n"])


def _of_texts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """texts joined with what is wanted of each, by their keys; a list of it is bounded by the one text."""
    return texts.join(maybe_broadcast(table(wanted, "wanted")), KEYS)


def clusters(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """The distinct texts of docs (doc_id, row_hash, text) and their paragraphs (doc_id, row_hash, start, end, cluster) that are in a cluster over several documents, with
    the place of the cluster's first copy (keeper, k_hash, k_start, k_end)."""
    small_batches(docs.sparkSession)
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.xxhash64(text_of()).alias("row_hash"), text_of().cast("binary").alias("text"))
    seen = table(texts.mapInArrow(_paragraphs, "doc_id long, row_hash long, start int, end int, node long, " + ", ".join(f"{b} array<long>" for b in BANDS_OF)), "paragraphs")

    often = table(seen.groupBy("node").agg(F.min("doc_id").alias("at"), F.max("doc_id").alias("last")).where("at < last").select("node"), "repeated")

    banded, seen = seen, None

    def narrow() -> None:
        nonlocal seen
        seen = table(banded.drop(*BANDS_OF), "paragraphs")
        drop(banded)

    def sets_of(nodes: DataFrame) -> DataFrame:
        wanted = maybe_broadcast(table(nodes, "nodes"))
        first = seen.join(wanted, "node", "left_semi").groupBy("node").agg(F.min(F.struct(*KEYS, "start", "end")).alias("p"))
        asked = first.groupBy("p.doc_id", "p.row_hash").agg(F.collect_list(F.struct("p.start", "p.end", "node")).alias("wanted"))
        picked = _of_texts(texts.dropDuplicates(KEYS) if repeated_rows else texts, asked).select("text", "wanted")
        return picked.mapInArrow(_paragraph_sets, "node long, items array<long>")

    rows = docs.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).count().where("count > 1")
    repeated_rows = not rows.isEmpty()
    _, comps = link(banded.select("node", F.col("doc_id").alias("owner"), *BANDS_OF), sets_of, percent, done=narrow)
    named = comps.select("node", F.col("comp").alias("cluster")).union(often.join(comps, "node", "left_anti").select("node", F.col("node").alias("cluster")))
    found = seen.distinct() if repeated_rows else seen
    found = table(found.join(maybe_broadcast(table(named, "named")), "node").drop("node"), "members")
    drop(seen)
    first = F.min(F.struct(*KEYS, "start", "end"))
    keep = found.groupBy("cluster").agg(first.alias("k"), F.max("doc_id").alias("last")).where("k.doc_id < last")
    keep = keep.select("cluster", F.col("k.doc_id").alias("keeper"), F.col("k.row_hash").alias("k_hash"), F.col("k.start").alias("k_start"), F.col("k.end").alias("k_end"))
    members = found.join(maybe_broadcast(table(keep, "keepers")), "cluster")
    return (texts.dropDuplicates(KEYS) if repeated_rows else texts), table(members, "clusters")


def repeats(docs: DataFrame, percent: int = PERCENT, min_run: int = MIN_RUN) -> DataFrame:
    """(doc_id, row_hash, start, end, keeper, k_hash): runs of words, counted from 0, that a document shares with the one of a smaller doc_id that keeps them."""
    texts, members = clusters(docs, percent)
    per_run = ["keeper", "k_hash", *KEYS]
    runs = _runs(members.where("doc_id != keeper"), per_run, 0).agg(F.min(F.struct("start", "k_start")).alias("l"), F.max(F.struct("end", "k_end")).alias("r"))
    runs = table(runs.select(*per_run, "l.start", "l.k_start", "r.end", "r.k_end"), "runs")

    # a run takes along the words about it; those about the keeper's places, which many runs may share, are joined
    ends = ["start", "end", "keeper", "k_hash", "k_start", "k_end"]
    asked = runs.groupBy(*KEYS).agg(F.collect_list(F.struct(*ends)).alias("wanted"))
    out = _of_texts(texts, asked).select(*KEYS, "text", "wanted").mapInArrow(_contexts, "doc_id long, row_hash long, start int, end int, keeper long, k_hash long, k_start int, k_end int, before array<int>, after array<int>")
    out = table(out, "contexts")
    place = lambda p, side: runs.select(F.col("keeper").alias("doc_id"), F.col("k_hash").alias("row_hash"), F.col(p).alias("place"), F.lit(side).alias("side"))
    places = place("k_start", -1).union(place("k_end", 1)).groupBy(*KEYS, "place").agg(F.min("side").alias("least"), F.max("side").alias("most"))
    asked = places.groupBy(*KEYS).agg(F.collect_list(F.struct("place", "least", "most")).alias("wanted"))
    kept = _of_texts(texts, asked).select(*KEYS, "text", "wanted").mapInArrow(_contexts, "doc_id long, row_hash long, place int, least int, most int, before array<int>, after array<int>")
    kept = table(kept, "kept")
    for edge, own, side in (("start", "before", "least = -1"), ("end", "after", "most = 1")):  # one side's words are let go before the other's are joined
        near = kept.where(side).select(F.col("doc_id").alias("keeper"), F.col("row_hash").alias("k_hash"), F.col("place").alias(f"k_{edge}"), F.col(own).alias("kept"))
        out = table(out.join(maybe_broadcast(near), ["keeper", "k_hash", f"k_{edge}"]).withColumn(f"more_{edge}", _alike(own, "kept")).drop(own, "kept"), f"{edge}s")
    out = out.select(*per_run, (F.col("start") - F.col("more_start")).alias("start"), (F.col("end") + F.col("more_end")).alias("end"))
    out = _runs(out, per_run, WIDTH).agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return out.where(F.col("end") - F.col("start") >= min_run).drop("run")


def _runs(spans: DataFrame, keys: list[str], gap: int):
    """spans (keys, start, end), grouped to runs of such as overlap or lie at most gap words apart; bounded by one document."""
    order = W.partitionBy(*keys).orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    new = F.when(F.col("start") <= reached + gap, 0).otherwise(1)
    return spans.withColumn("new", new).withColumn("run", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0))).groupBy(*keys, "run")


def _merged(spans: str) -> str:
    """SQL for the union of sorted spans, as an array of (start, end)."""
    last = "element_at(acc, -1)"
    grown = f"concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', {last}.start, 'end', greatest({last}.end, x.end))))"
    return f"aggregate({spans}, cast(array() as array<struct<start: int, end: int>>), (acc, x) -> if(size(acc) > 0 and x.start <= {last}.end, {grown}, concat(acc, array(x))))"


def document_repeats(docs: DataFrame, percent: int = PERCENT, min_run: int = MIN_RUN) -> DataFrame:
    """One row for each text of a document that shares a passage with another document: doc_id, row_hash, removed_words, removed (spans of words, merged) and keepers.

    A document whose every shared passage stays in it has no spans.
    """
    found = table(repeats(docs, percent, min_run), "repeats")
    kept = found.select(F.col("keeper").alias("doc_id"), F.col("k_hash").alias("row_hash"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), "keeper").distinct()
    both = found.select(*KEYS, "start", "end", "keeper").union(kept)
    gone = F.when(F.col("start").isNotNull(), F.struct("start", "end"))
    per_doc = both.groupBy(*KEYS).agg(F.array_sort(F.collect_set(gone)).alias("spans"), F.array_sort(F.collect_set("keeper")).alias("keepers"))  # bounded by the one document
    merged = per_doc.select(*KEYS, F.expr(_merged("spans")).alias("removed"), "keepers")
    words = F.aggregate("removed", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return merged.select(*KEYS, words.alias("removed_words"), "removed", "keepers")


def cut_repeats(docs: DataFrame, percent: int = PERCENT, min_run: int = MIN_RUN) -> DataFrame:
    """docs without the removed words, with the white space after each; all rows and columns stay."""
    spans = document_repeats(docs, percent, min_run).where("removed_words > 0").select(F.col("doc_id").alias("__doc_id"), F.col("row_hash").alias("__row_hash"), F.col("removed").alias("__removed"))
    spans = maybe_broadcast(table(spans, "spans"))
    joined = docs.join(spans, (docs["doc_id"].cast("long") == F.col("__doc_id")) & (F.xxhash64(text_of(docs["text"])) == F.col("__row_hash")), "left")

    @F.arrow_udf("string")
    def cut(text: pa.Array, removed: pa.Array) -> pa.Array:
        return pa.array([_without(t, r) for t, r in zip(text.to_pylist(), removed.to_pylist(), strict=True)], pa.string())

    new_text = F.when(F.col("__removed").isNull(), docs["text"]).otherwise(cut(text_of(docs["text"]).cast("binary"), F.col("__removed")))
    return joined.select(*(new_text.alias(c) if c == "text" else docs[c] for c in docs.columns))


def _without(text: bytes, removed: list[dict] | None) -> str:
    if removed:
        w = X.words([text])
        edge = [*w.starts.tolist(), len(text)]
        out, at = [], 0
        for s in removed:
            out.append(text[at : edge[s["start"]]])
            at = edge[s["end"]]
        text = b"".join([*out, text[at:]])
    return text.decode("utf-8", "replace")
