"""Quality classifier: a sparse rule ensemble over text statistics, compiled into Spark column expressions.

Statistics of the whole text are computed once for each row (vectorised, Arrow). Shallow boosted trees over a bounded sample of labelled rows give paths;
each path is a rule, a conjunction of threshold tests. A lasso logistic regression weighs the rules and drops most. The rest becomes one column expression.

The fit uses at most SAMPLE labelled rows, those with the smallest xxhash64(doc_id), so documents that repeat a labelled doc_id count within it; scores cover all rows. Label, language, source and id are no inputs.

Defined cases: null and empty texts have statistics of 0 and get a score like all others. Labels that are null or have no document are not used. Without
usable labels all scores are 0.5; with labels of one class only, all are that class's smoothed share. Rows that repeat a doc_id each get their own score.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textsets as X
from .common import maybe_broadcast, small_batches, table, text_of

SAMPLE, TREES, DEPTH, RATE, BINS, PENALTY = 20_000, 40, 3, 0.2, 32, 2e-3
STATS = ("log_bytes", "log_words", "word_length", "upper", "digits", "stops", "symbols", "shouts", "bars", "spaces", "lines", "non_ascii", "distinct", "again", "top_word", "distinct_threes")
_KIND = T.StructType([T.StructField(s, T.DoubleType()) for s in STATS])

_CLASS = np.zeros(256, np.uint8)  # 1 upper, 2 lower, 3 digit, 4 stops, 5 symbols, 6 !, 7 |, 8 space, 9 newline, 10 beyond ASCII
for _k, _bytes in enumerate((b"", bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789", b".,;:?'\"-()", b"#$%&*+/<=>@[\\]^_`{}~", b"!", b"|", b" \t\r", b"\n", bytes(range(128, 256)))):
    _CLASS[list(_bytes)] = _k


def _counts(kinds: np.ndarray) -> np.ndarray:
    return sum((np.bincount(kinds[i : i + X.CHUNK], minlength=11) for i in range(0, len(kinds), X.CHUNK)), np.zeros(11, np.int64))


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of STATS for each text."""
    out = np.zeros((len(texts), len(STATS)))
    for a, b in X.batches(texts):
        w = X.words(texts[a:b])
        threes = X.sequence_hash(w.hashes, 3)
        buf = np.frombuffer(b"\n".join(texts[a:b]) + b"\n", np.uint8)
        kinds = _CLASS[buf]
        for k in range(b - a):
            n = w.offsets[k + 1] - w.offsets[k] - 1
            i, j = w.first[k], w.first[k + 1]
            if n <= 0 or j <= i:
                out[a + k, 0] = np.log1p(max(n, 0))
                continue
            c = _counts(kinds[w.offsets[k] : w.offsets[k] + n])
            h, m = w.hashes[i:j], j - i
            _, counts = np.unique(h, return_counts=True)
            t = threes[i : max(i, j - 2)]
            solid = max(n - c[8] - c[9], 1)
            out[a + k] = (
                np.log1p(n), np.log1p(m), solid / m, c[1] / solid, c[3] / solid, c[4] / m, c[5] / m, c[6] / m, c[7] / m, c[8] / m, (c[9] + 1) / m, c[10] / solid,
                len(counts) / m, (h[1:] == h[:-1]).mean() if m > 1 else 0.0, counts.max() / m, len(np.unique(t)) / len(t) if len(t) else 1.0,
            )
    return out


@F.arrow_udf(_KIND)
def text_statistics(text: pa.Array) -> pa.Array:
    rows = statistics(text.to_pylist())
    return pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(len(STATS))], names=list(STATS))


class Test(NamedTuple):
    """statistic > cut, or <= cut."""

    stat: int
    above: bool
    cut: float


class Model(NamedTuple):
    """log-odds = bias + the weights of the rules that hold."""

    bias: float
    rules: tuple[tuple[tuple[Test, ...], float], ...]

    def odds(self, stats: np.ndarray) -> np.ndarray:
        out = np.full(len(stats), self.bias)
        for rule, weight in self.rules:
            out += weight * _holds(rule, stats)
        return out


def _holds(rule: tuple[Test, ...], x: np.ndarray) -> np.ndarray:
    on = np.ones(len(x), bool)
    for t in rule:
        on &= (x[:, t.stat] > t.cut) == t.above
    return on


def _tree(x: np.ndarray, codes: np.ndarray, cuts: list[np.ndarray], gradient: np.ndarray, weight: np.ndarray) -> list[tuple[tuple[Test, ...], np.ndarray, float]]:
    """The nodes of one tree below its root, as (path, rows, value); the leaves' values move the odds."""
    nodes, leaves = [], []
    todo = [((), np.arange(len(x)), 0)]
    while todo:
        path, rows, depth = todo.pop()
        g, w = gradient[rows], weight[rows]
        best = (1e-6, None)
        base = g.sum() ** 2 / (w.sum() + 1)
        if depth < DEPTH and len(rows) >= 40:
            for s in range(x.shape[1]):
                gs, ws = (np.bincount(codes[rows, s], v, BINS + 1).cumsum() for v in (g, w))
                for_cut = gs[: len(cuts[s])] ** 2 / (ws[: len(cuts[s])] + 1) + (gs[-1] - gs[: len(cuts[s])]) ** 2 / (ws[-1] - ws[: len(cuts[s])] + 1) - base
                if len(for_cut) and for_cut.max() > best[0] + 1e-9:
                    best = (for_cut.max(), (s, int(for_cut.argmax())))
        if best[1] is None:
            leaves.append((path, rows, g.sum() / (w.sum() + 1)))
            continue
        s, c = best[1]
        over = codes[rows, s] > c
        for above in (False, True):
            test = Test(s, above, float(cuts[s][c]))
            nodes.append((*path, test))
            todo.append(((*path, test), rows[over == above], depth + 1))
    return nodes, leaves


def fit(stats: np.ndarray, labels: np.ndarray) -> Model:
    """The rule ensemble for rows of STATS and their 0/1 labels."""
    if not len(labels):
        return Model(0.0, ())
    share = (labels.sum() + 1) / (len(labels) + 2)
    bias = float(np.log(share / (1 - share)))
    if labels.min() == labels.max():
        return Model(bias, ())
    cuts = [np.unique(np.quantile(stats[:, s], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for s in range(stats.shape[1])]
    codes = np.stack([np.searchsorted(c, stats[:, s], side="left") for s, c in enumerate(cuts)], 1)
    odds, paths = np.full(len(labels), bias), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-odds))
        nodes, leaves = _tree(stats, codes, cuts, labels - p, p * (1 - p))
        for path in nodes:
            paths.setdefault(tuple(sorted(path)), None)
        for _path, rows, value in leaves:
            odds[rows] += RATE * value
    rules = list(paths)
    r = np.stack([_holds(rule, stats) for rule in rules], 1).astype(float)
    share_on = r.mean(0)
    keep = (share_on > 0.002) & (share_on < 0.998)
    rules, r = [rule for rule, k in zip(rules, keep, strict=True) if k], r[:, keep]
    scale = np.sqrt(r.mean(0) * (1 - r.mean(0)))
    middle = r.mean(0)
    z = (r - middle) / scale
    step = 4 * len(z) / np.linalg.norm(z, 2) ** 2
    weights, b = np.zeros(z.shape[1]), bias
    ahead, t = weights.copy(), 1.0
    for _ in range(400):  # accelerated proximal gradient for the lasso
        p = 1 / (1 + np.exp(-(z @ ahead + b)))
        new = ahead - step * (z.T @ (p - labels)) / len(z)
        new = np.sign(new) * np.maximum(np.abs(new) - step * PENALTY, 0)
        b -= 4 * (p - labels).mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, weights, t = new + (t - 1) / t2 * (new - weights), new, t2
    on = np.flatnonzero(weights)
    final = b - (weights[on] * middle[on] / scale[on]).sum()
    return Model(float(final), tuple((rules[k], float(weights[k] / scale[k])) for k in on))


def compiled(model: Model, stats: Column) -> Column:
    """The score as a column expression over the struct of statistics."""
    odds = F.lit(model.bias)
    for rule, weight in model.rules:
        on = F.lit(True)
        for t in rule:
            s = stats[STATS[t.stat]]
            on = on & (s > t.cut if t.above else s <= t.cut)
        odds = odds + F.when(on, F.lit(weight)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on the labelled documents outside the held-out third."""
    small_batches(docs.sparkSession)
    usable = labels.where("quality in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id"))).select("doc_id", "quality")
    drawn = table(usable.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample), "labels")
    rows = docs.select("doc_id", text_of().cast("binary").alias("text")).join(maybe_broadcast(drawn), "doc_id").select("doc_id", "quality", text_statistics("text").alias("s"))
    rows = rows.select("doc_id", "quality", "s.*").orderBy(F.xxhash64("doc_id"), "doc_id", "quality", *STATS).limit(sample)  # doc_ids may repeat
    got = rows.toPandas().sort_values(["doc_id", "quality", *STATS])
    return fit(got[list(STATS)].to_numpy(float), got["quality"].to_numpy(float))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs."""
    model = trained(docs, labels)
    rows = docs.select("doc_id", text_statistics(text_of().cast("binary")).alias("s"))
    score = compiled(model, F.col("s"))
    out = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs with a score of 0.5 or more."""
    model = trained(docs, labels)
    free = "s"
    while free in docs.columns:
        free += "_"
    rows = docs.withColumn(free, text_statistics(text_of(docs["text"]).cast("binary")))
    return rows.where(compiled(model, F.col(free)) >= 0.5).select(*docs.columns)
