"""Line dedup by a log-template tree of fixed depth.

A line's leaf is its token count and its first DEPTH tokens, tokens with digits standing as one variable field. In a leaf that lines of MIN_DOCS documents
share, a token is constant if at its place it occurs in MIN_DOCS lines of the leaf; other tokens are variable fields too. Constant tokens in their places
are the template. A template of at least CONSTANT constant tokens (as a share) that lines of MIN_DOCS documents share is recurring: its lines are dropped,
but for the first, by doc_id and place, so that nothing vanishes altogether.

All steps are counts by key with partial sums; only the leaves, tokens and templates that recur are joined back. Texts are shuffled to meet their cuts
only where the cuts' measured bytes are too many to be broadcast.

Defined cases: null and empty texts have no lines. Lines of fewer than min_tokens tokens are left alone: MIN_TOKENS
by default, none in op3_lines and the pipeline, which ask for 1; a leaf of fewer than DEPTH tokens is all of them. Rows that share doc_id and text are one document
and are cut alike; a null doc_id is a value of its own and comes first in order. Columns of docs may have any names; all of them stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import maybe_broadcast, table, text_of

DEPTH, MIN_TOKENS, MIN_DOCS, CONSTANT = 3, 5, 10, 0.5
KEYS = ["doc_id", "row_hash"]


def _lines(docs: DataFrame, min_tokens: int) -> DataFrame:
    rows = docs.select("doc_id", F.xxhash64(text_of()).alias("row_hash"), F.posexplode(F.split(text_of(), "\n", -1)).alias("line", "content"))
    spaced = F.replace(F.replace(F.col("content"), F.lit("\t"), F.lit(" ")), F.lit("\r"), F.lit(" "))
    tokens = F.array_remove(F.split(spaced, " "), "")
    rows = rows.select(*KEYS, "line", tokens.alias("tokens")).where(F.size("tokens") >= min_tokens)
    field = lambda t: F.when(t.rlike(r"\d"), F.lit("<*>")).otherwise(t)
    return rows.withColumn("leaf", F.xxhash64(F.size("tokens"), F.transform(F.slice("tokens", 1, DEPTH), field)))


def dropped_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """(doc_id, row_hash, line) of every line that goes, and its template's key."""
    rows = _lines(docs, min_tokens)
    per_doc = rows.select("leaf", *KEYS).distinct()
    leaves = maybe_broadcast(table(per_doc.groupBy("leaf").agg(F.count("*").alias("docs")).where(f"docs >= {min_docs}").select("leaf"), "leaves"))
    hot = table(rows.join(leaves, "leaf").dropDuplicates([*KEYS, "line"]), "hot-lines")  # of equal rows one counts
    token = F.when(F.col("raw").rlike(r"\d"), F.lit(None)).otherwise(F.col("raw"))
    spread = hot.select(*KEYS, "line", "leaf", F.size("tokens").alias("n"), F.posexplode("tokens").alias("place", "raw")).withColumn("token", token)
    often = spread.where("token is not null").groupBy("leaf", "place", "token").agg(F.count("*").alias("seen")).where(f"seen >= {min_docs}").withColumn("seen", F.lit(1))
    marked = spread.join(maybe_broadcast(table(often, "constant-tokens")), ["leaf", "place", "token"], "left")
    part = F.when(F.col("seen") == 1, F.xxhash64("leaf", "place", "token"))
    part2 = F.when(F.col("seen") == 1, F.hash("token", "place", "leaf").cast("long") * 0x9E3779B1)
    made = marked.groupBy(*KEYS, "line", "leaf", "n").agg(F.bit_xor(part).alias("x"), F.bit_xor(part2).alias("y"), F.count("seen").alias("constant"))
    made = table(made.where(F.col("constant") >= CONSTANT * F.col("n")).withColumn("template", F.struct("leaf", "x", "y")), "templates")
    per_doc = made.select("template", *KEYS).distinct().groupBy("template").agg(F.count("*").alias("docs")).where(f"docs >= {min_docs}").select("template")
    first = made.groupBy("template").agg(F.min(F.struct(*KEYS, "line")).alias("first"))
    recurring = per_doc.join(first, "template")
    out = made.join(maybe_broadcast(table(recurring, "recurring")), "template").where(~F.struct(*KEYS, "line").eqNullSafe(F.col("first")))
    return out.select(*KEYS, "line", F.xxhash64("template").alias("template"))


def _cut_table(docs: DataFrame, min_docs: int, min_tokens: int) -> DataFrame:
    gone = dropped_lines(docs, min_docs, min_tokens).groupBy(*KEYS).agg(F.collect_set("line").alias("cut lines"))  # as many at most as the one document has lines
    return gone.select(F.col("doc_id").alias("cut doc_id"), F.col("row_hash").alias("cut row_hash"), "cut lines")


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """docs with recurring lines cut from text; all columns and rows stay."""
    joined, new_text, _ = _joined(docs, min_docs, min_tokens)
    return joined.select(*(new_text.alias(c) if c == "text" else docs[c] for c in docs.columns))


def _joined(docs: DataFrame, min_docs: int, min_tokens: int):
    cuts = maybe_broadcast(table(_cut_table(docs, min_docs, min_tokens), "cuts"))
    joined = docs.join(cuts, docs["doc_id"].eqNullSafe(F.col("cut doc_id")) & (F.xxhash64(text_of(docs["text"])) == F.col("cut row_hash")), "left")
    joined = joined.withColumn("cut parts", F.when(F.col("cut lines").isNotNull(), F.split(docs["text"], "\n", -1)))  # a column, so that no lambda splits anew
    parts = F.col("cut parts")
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("cut lines"))
    new_text = F.when(F.col("cut lines").isNull(), docs["text"]).otherwise(F.array_join(F.transform(stay, lambda i: F.element_at(parts, i + 1)), "\n"))
    return joined, new_text, F.coalesce(F.size("cut lines"), F.lit(0))


def deduplicated(docs: DataFrame, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """doc_id, n_lines, n_dropped and text_sha256 (of what stays) for every row of docs."""
    joined, new_text, gone = _joined(docs, min_docs, min_tokens)
    lines = F.when(F.coalesce(docs["text"], F.lit("")) == "", 0).otherwise(F.size(F.split(docs["text"], "\n", -1))).cast("long")
    return joined.select(docs["doc_id"], lines.alias("n_lines"), F.greatest(gone, F.lit(0)).cast("long").alias("n_dropped"), F.sha2(text_of(new_text), 256).alias("text_sha256"))
