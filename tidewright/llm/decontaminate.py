"""Benchmark decontamination with DataFrame functions only: a broadcast set of hashed test n-grams, a scan of all training windows, an exact check of hits.

A text's words are runs of a-z (A-Z lowered), digits and non-ASCII characters. A window of an item is any 8 consecutive words of it; an item of fewer, but
not none, is one window. A word of a document inside any occurrence of a window is hit.

Defined cases: null and empty texts have no words and no hits. Items without words or with a null item_id take no part. Rows that repeat an item_id are
one item. A row of documents is known by its doc_id (null is a value of its own) and its text, so repeated rows get equal results, one for each row.
The set is broadcast only if its measured bytes stay under a bound; beyond that the hashes of windows, without their texts, are joined by shuffle, and
only the texts that a hash was found in are looked at again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fits, maybe_broadcast, same_row, table, text_of

WINDOW, ITEMS = 8, 2
#: Stands for a row as a whole among the hashes of its windows.
MARK = -0x5E3A_77C1_0D2B_4F69
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A word before lowering: A-Z belong to it. Only texts that are cut need it.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
KEYS = ("doc_id", "row_hash")


def lowered(text: Column) -> Column:
    """text with A-Z, and nothing else, in lower case; the fast built-in serves pure ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    return F.filter(F.split(lowered(text), SEPARATORS), lambda w: w != "")


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, length, gram: array of words, gram_hash), one row for each distinct window of an item."""
    w = F.col("words")
    starts = F.when(F.size(w) > size, F.sequence(F.lit(1), F.size(w) - size + 1)).otherwise(F.array(F.lit(1)))
    items = benchmark.where("item_id is not null").select("item_id", words(text_of()).alias("words")).where("size(words) > 0")
    grams = items.select("item_id", F.least(F.size(w), F.lit(size)).alias("length"), "words", F.explode(starts).alias("start"))
    grams = grams.select("item_id", "length", F.slice(w, F.col("start"), F.col("length")).alias("gram")).distinct()
    return grams.withColumn("gram_hash", F.xxhash64(F.transform("gram", lambda x: F.xxhash64(x))))


def hits(docs: DataFrame, grams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row_hash, start, length, gram_hash, gram), every occurrence of a window in a document, start counted from 0; and
    (doc_id, row_hash, n_words), a row for each row of docs. Both come from one scan of the texts, and are written.

    grams: the written result of windows(). Before a row's windows goes a mark that the set holds too, so that each row passes the join once.
    """
    lengths = sorted(r[0] for r in grams.select("length").distinct().collect())  # at most WINDOW numbers
    wanted = table(grams.select("gram_hash", "length", "gram").dropDuplicates(["gram_hash", "gram"]), "grams")
    scanned = docs.select("doc_id", F.xxhash64(text_of()).alias("row_hash"), words(text_of()).alias("words"))
    if not lengths or not fits(wanted):
        return _hits_by_shuffle(scanned, wanted, lengths), table(scanned.select(*KEYS, F.size("words").cast("long").alias("n_words")), "word-counts")
    scanned = scanned.withColumn("hashes", F.transform("words", lambda x: F.xxhash64(x)))
    found: DataFrame | None = None
    for k, n in enumerate(lengths):
        of_n = wanted.where(F.col("length") == n).select("gram_hash", "gram")
        if k == 0:
            of_n = of_n.union(docs.sparkSession.range(1).select(F.lit(MARK), F.lit(None).cast("array<string>")))
        of_n = table(of_n, "grams")
        seen = scanned.select(*KEYS, "words", F.posexplode(F.concat(F.array(F.lit(MARK)), _spots(n))).alias("at", "gram_hash"))
        same = F.when(F.col("gram").isNull(), F.col("at") == 0).otherwise((F.col("at") > 0) & (F.slice("words", F.greatest("at", F.lit(1)), n) == F.col("gram")))
        sure = seen.join(F.broadcast(of_n), "gram_hash").where(same)  # of_n is a part of what fits
        sure = sure.select(*KEYS, (F.col("at") - 1).alias("start"), F.lit(n).alias("length"), "gram_hash", "gram", F.when(F.col("gram").isNull(), F.size("words")).cast("long").alias("n_words"))
        found = sure if found is None else found.union(sure)
    found = table(found, "hits")
    return found.where("gram is not null").drop("n_words"), found.where("gram is null").select(*KEYS, "n_words")


def _spots(n: int) -> Column:
    """The hashes of all windows of n words of `words`, made of those in `hashes`."""
    spots = F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), lambda i: F.xxhash64(F.slice("hashes", i, n)))
    return F.when(F.size("words") >= n, spots).otherwise(F.array().cast("array<long>"))


def _hits_by_shuffle(scanned: DataFrame, wanted: DataFrame, lengths: list[int]) -> DataFrame:
    """The hits of hits() for a set too large to be broadcast."""
    hashed = scanned.withColumn("hashes", F.transform("words", lambda x: F.xxhash64(x)))
    spots: DataFrame | None = None
    for n in lengths:
        of_n = hashed.select(*KEYS, F.posexplode(_spots(n)).alias("start", "gram_hash"), F.lit(n).alias("length"))
        spots = of_n if spots is None else spots.union(of_n)
    if spots is None:
        spots = hashed.select(*KEYS, F.lit(0).alias("start"), F.lit(0).cast("long").alias("gram_hash"), F.lit(0).alias("length")).limit(0)
    may = spots.distinct().join(wanted.select("gram_hash", "length").distinct(), ["gram_hash", "length"], "left_semi")
    may = table(may.groupBy(*KEYS).agg(F.collect_list(F.struct("start", "length", "gram_hash")).alias("may")).withColumnsRenamed({k: f"k_{k}" for k in KEYS}), "candidates")  # as many at most as the one document has words
    looked = scanned.join(maybe_broadcast(may), scanned["doc_id"].eqNullSafe(F.col("k_doc_id")) & (F.col("row_hash") == F.col("k_row_hash")))
    looked = looked.select(*KEYS, "words", F.explode("may").alias("m")).select(*KEYS, "m.*", F.slice("words", F.col("m.start") + 1, F.col("m.length")).alias("gram"))
    return table(looked.join(wanted.select("gram_hash", "gram"), ["gram_hash", "gram"]).select(*KEYS, "start", "length", "gram_hash", "gram"), "hits")


def hit_words(found: DataFrame) -> DataFrame:
    """(doc_id, row_hash, word): the distinct places of hit words."""
    return found.select(*KEYS, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("word")).distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, least_items: int = ITEMS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for every row of docs."""
    grams = table(windows(benchmark, size), "windows")
    found, base = hits(docs, grams)
    covered = hit_words(found).groupBy(*KEYS).agg(F.count("*").alias("n_hit"))
    of = maybe_broadcast(grams.select(F.col("item_id").cast("string").alias("item_id"), "gram_hash", "gram").distinct())
    items = found.select(*KEYS, "gram_hash", "gram").distinct().join(of, ["gram_hash", "gram"]).select(*KEYS, "item_id").distinct()
    items = items.groupBy(*KEYS).agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item_id")), ",").alias("items"))
    told = table(covered.join(items, same_row(covered, items, KEYS)).select(*(covered[k].alias(f"k_{k}") for k in KEYS), "n_hit", "n_items", "items"), "hit-counts")
    told = maybe_broadcast(told)
    out = base.join(told, base["doc_id"].eqNullSafe(told["k_doc_id"]) & (base["row_hash"] == told["k_row_hash"]), "left")
    n_items = F.coalesce("n_items", F.lit(0))
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), n_items.alias("n_items"), F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), (n_items >= least_items).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, least_items: int = ITEMS) -> DataFrame:
    """docs without the rows that hold windows of least_items items or more, and without the hit words, with what follows each up to the next word, in the others."""
    grams = table(windows(benchmark, size), "windows")
    found, _ = hits(docs, grams)
    of = maybe_broadcast(grams.select("item_id", "gram_hash", "gram").distinct())
    items = found.select(*KEYS, "gram_hash", "gram").distinct().join(of, ["gram_hash", "gram"]).select(*KEYS, "item_id").distinct().groupBy(*KEYS).agg(F.count("*").alias("__n_items"))
    places = hit_words(found).groupBy(*KEYS).agg(F.collect_list("word").alias("__hit"))  # as many at most as the one document has words
    told = table(items.join(places, same_row(items, places, KEYS)).select(items["doc_id"].alias("__doc_id"), items["row_hash"].alias("__row_hash"), "__n_items", "__hit"), "cuts")
    told = maybe_broadcast(told)
    joined = docs.join(told, docs["doc_id"].eqNullSafe(F.col("__doc_id")) & (F.xxhash64(text_of(docs["text"])) == F.col("__row_hash")), "left").where(F.coalesce("__n_items", F.lit(0)) < least_items)
    text = F.when(F.col("__hit").isNotNull(), text_of(docs["text"]))
    joined = joined.withColumns({"__own": F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), "__between": F.split(text, WORD, -1)})  # columns, so that no lambda computes them anew
    own, between = F.col("__own"), F.col("__between")
    stay = F.array_except(F.sequence(F.lit(0), F.size(own) - 1), F.col("__hit"))
    cut = F.concat(F.element_at(between, 1), F.array_join(F.transform(stay, lambda i: F.concat(F.element_at(own, i + 1), F.element_at(between, i + 2))), ""))
    new_text = F.when(F.col("__hit").isNull(), docs["text"]).otherwise(cut)
    return joined.select(*(new_text.alias(c) if c == "text" else docs[c] for c in docs.columns))
