"""Each stage of the pipeline on its own input against a brute-force version, and on nulls, repeats and an empty table."""

import collections
import random
import re

import corpus_pipeline
import pytest
from tokenizers import Tokenizer

from tidewright.llm import quality
from tidewright.llm.queries import tokenizer_path

from .test_operators import LOW, components, frame, prose

rng = random.Random(77)


def line_dedup(rows, min_docs=10):
    """Texts without recurring lines, by the definition of the template tree; doc_ids are told apart."""
    digit = lambda t: any(c.isdigit() for c in t)
    found = []
    for doc, text in dict(rows).items():
        for k, line in enumerate((text or "").split("\n")):
            tokens = [t for t in re.split("[ \t\r]", line) if t]
            if tokens:
                found.append((doc, k, tokens, (len(tokens), *("<*>" if digit(t) else t for t in tokens[:3]))))
    docs = collections.defaultdict(set)
    for doc, _, _, leaf in found:
        docs[leaf].add(doc)
    found = [f for f in found if len(docs[f[3]]) >= min_docs]
    seen = collections.Counter((leaf, p, t) for _, _, tokens, leaf in found for p, t in enumerate(tokens) if not digit(t))
    made = collections.defaultdict(list)
    for doc, k, tokens, leaf in found:
        constant = frozenset((p, t) for p, t in enumerate(tokens) if seen[leaf, p, t] >= min_docs)
        if 2 * len(constant) >= len(tokens):
            made[leaf, constant].append((doc, k))
    gone = set()
    for places in made.values():
        if len({d for d, _ in places}) >= min_docs:
            gone |= set(places) - {min(places)}
    return [(d, "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone)) for d, t in rows]


def test_line_dedup_against_brute_force(spark):
    notes = ["Posted by user {n} on our board", "Page {n} of {m}", "All rights reserved", "{n}", "Share this: {w} {v}", "Read more about {w} here", "{w} {v} {w}"]
    rows = []
    for i in range(40):
        lines = [rng.choice(notes).format(n=rng.randrange(99), m=rng.randrange(99), w=rng.choice("abcdefgh"), v=rng.choice("klmnop")) for _ in range(rng.randrange(9))]
        lines.insert(rng.randrange(len(lines) + 1), prose(12))
        rows.append((i, "\n".join(lines)))
    rows += rows[:3]
    got = sorted((r.doc_id, r.text) for r in corpus_pipeline.line_dedup(spark, frame(spark, rows), "").collect())
    assert got == sorted(line_dedup(rows)) and got != sorted(rows)


def test_near_dedup_against_brute_force(spark):
    rows = []
    for k in range(30):
        base = prose(60).split()
        for j in range(3):
            w = list(base)
            for _ in range(rng.randrange(3)):
                w[rng.randrange(60)] = f"edit{rng.randrange(9)}"
            rows.append((10 * k + j, " ".join(w)))
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, frame(spark, rows), "").collect())
    want = components(rows, 80)
    assert got == sorted({want[i] for i in want})


def test_decontamination_against_brute_force(spark, tmp_path):
    item = lambda t: [m.span() for m in re.finditer("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", t)]
    bench = [(k, prose(15)) for k in range(6)]
    spark.createDataFrame(bench, "item_id int, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    grams = collections.defaultdict(set)
    for k, t in bench:
        w = [t[a:b].translate(LOW) for a, b in item(t)]
        for s in range(len(w) - 7):
            grams[tuple(w[s : s + 8])].add(k)
    rows = [(i, prose(20) + ", " + " ".join(bench[rng.randrange(6)][1] for _ in range(i % 4)) + ". " + prose(5)) for i in range(24)]
    want = []
    for i, t in rows:
        spans = item(t)
        w = [t[a:b].translate(LOW) for a, b in spans]
        hit, items = set(), set()
        for s in range(len(w) - 7):
            if tuple(w[s : s + 8]) in grams:
                hit |= set(range(s, s + 8))
                items |= grams[tuple(w[s : s + 8])]
        if len(items) < 2:
            edges = [a for a, _ in spans] + [len(t)]
            want.append((i, t[: edges[0]] + "".join(t[edges[k] : edges[k + 1]] for k in range(len(w)) if k not in hit)))
    got = sorted((r.doc_id, r.text) for r in corpus_pipeline.decontamination(spark, frame(spark, rows), str(tmp_path)).collect())
    assert got == want and len(got) < len(rows)


def test_quality_and_encoding_against_brute_force(spark, tmp_path):
    rows = [(k, prose(40) + ".") for k in range(150)] + [(k, "WIN!!! $$$ " * 20) for k in range(150, 300)]
    labels = spark.createDataFrame([(k, int(k < 150)) for k in range(300)], "doc_id long, quality int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = frame(spark, rows)
    kept = sorted(r.doc_id for r in corpus_pipeline.quality(spark, docs, str(tmp_path)).collect())
    assert kept == sorted(r.doc_id for r in quality.scored(docs, labels).collect() if r.score >= 0.5) == list(range(150))
    own = Tokenizer.from_file(tokenizer_path())
    got = {r.doc_id: r.n_tokens for r in corpus_pipeline.encoding(spark, docs, "").collect()}
    assert got == {i: len(own.encode(t, add_special_tokens=False).ids) for i, t in rows}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_nulls_repeats_and_empty_tables(spark, tmp_path, name):
    spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([("a", prose(12))], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = frame(spark, [(1, None), (2, ""), (None, "x y"), (3, prose(30)), (3, prose(30)), (4, "one"), (4, "one")])
    out = stage(spark, docs, str(tmp_path))
    assert out.count() <= 7 and stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    if name != "encoding":
        assert out.columns == docs.columns
