"""Hot groups, shuffle branches, long texts and the whole pipeline against brute force."""

import collections
import random
import re

import numpy as np
import pytest

from tidewright.llm import common, decontaminate, lines, minhash, neardup, passages, quality, textsets, tokencount, warc
from tidewright.llm.queries import tokenizer_path

from .test_operators import components, frame, prose

rng = random.Random(12)


@pytest.fixture
def shuffled(monkeypatch):
    """No table is small enough to be broadcast by a hint."""
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)


def edited(words, n):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
    return w


def hot_group(n=150):
    """Copies of one text with none to twelve edits, some cut short: many in one bucket, by no means all near one another."""
    base = prose(110).split()
    rows = []
    for k in range(n):
        w = edited(base, rng.randrange(13))
        rows.append((k, " ".join(w[: rng.choice((110, 110, 100, 90))])))
    return rows


@pytest.mark.parametrize("percent", [80, 85])
def test_large_groups_of_near_copies_are_linked_exactly(spark, percent):
    rows = hot_group()
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, rows), percent).collect()}
    assert got == components(rows, percent)


def test_near_duplicates_by_shuffle_alone(spark, shuffled):
    rows = hot_group(60) + [(900, None), (901, "")]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert {i: got[i] for i in range(60)} == {i: c for i, c in components(rows).items() if i < 60}


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def test_passages_are_cut_to_the_word_and_short_runs_stay(spark):
    shared, other, short = prose(51).split(), prose(70).split(), prose(49).split()
    rows = [
        (1, " ".join([*prose(40).split(), "left1", *shared, "right1", *prose(40).split()])),
        (2, " ".join(["left2", *shared, "right2", *prose(30).split()])),
        (3, " ".join([*prose(33).split(), "left3", *shared])),
        *[(k, " ".join([*prose(60).split(), f"a{k}", *short, f"b{k}", *prose(60).split()])) for k in (4, 5)],
        (6, "\n".join([" ".join(other[k : k + 10]) for k in range(0, 70, 10)])),
        (7, "first\n" + "\n".join([" ".join(other[k : k + 10]) for k in range(0, 70, 10)])),
        (8, prose(100)), (None, " ".join(shared)), (9, ""), (10, None),
    ]
    rows += [rows[1]]
    want = {1: "", 2: " ".join(shared), 3: " ".join(shared), 6: "", 7: " ".join(["first", *other])}  # the block of 7 is near that of 6 as a whole
    got = passages.document_repeats(frame(spark, rows, "removed string")).collect()
    text = dict(rows)
    for r in got:
        w = words_of(text[r.doc_id])
        assert " ".join(x for s in r.removed for x in w[s["start"] : s["end"]]) == want[r.doc_id]
    assert sorted(r.doc_id for r in got) == sorted(want)
    left = sorted((str(r.doc_id), r.text) for r in passages.cut_repeats(frame(spark, rows, "removed string")).collect())
    assert len(left) == len(rows) and sum(i == "2" and "left2 right2" in t for i, t in left) == 2 and ("8", text[8]) in left


def test_edited_paragraphs_are_found_by_minhash(spark):
    line = prose(90).split()
    rows = [(1, " ".join(line)), (2, "\n".join(["intro here", " ".join([*line[:30], "edit", *line[31:]])])), (3, prose(90))]
    got = {r.doc_id: r.removed_words for r in passages.document_repeats(frame(spark, rows)).collect()}
    assert got == {1: 0, 2: 90}


def test_passages_by_shuffle_alone_and_of_empty_tables(spark, shuffled):
    shared = prose(60)
    rows = [(k, f"{prose(20)} before{k} {shared} after{k} {prose(20)}") for k in range(4)]  # no chance word makes the run longer
    assert {r.doc_id: r.removed_words for r in passages.document_repeats(frame(spark, rows)).collect()} == {0: 0, 1: 60, 2: 60, 3: 60}
    assert passages.document_repeats(frame(spark, rows).limit(0)).count() == 0


def test_decontamination_and_lines_by_shuffle_alone(spark, monkeypatch):
    bench = spark.createDataFrame([(k, prose(20)) for k in range(3)], "item_id int, text string")
    items = [r.text for r in bench.orderBy("item_id").collect()]
    docs = frame(spark, [(1, f"{prose(5)} {items[0]} {prose(4)}"), (2, f"{items[1]} {items[2]}"), (3, prose(30)), (None, items[0]), (4, None), (3, prose(10))])
    posts = frame(spark, [(i, f"{prose(8)} {i}x\nPosted by user number {i} on our board") for i in range(15)])
    rows = lambda df: sorted(map(str, df.collect()))
    a = rows(decontaminate.contamination(docs, bench)), rows(decontaminate.decontaminate(docs, bench)), rows(lines.dedup_lines(posts))
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    assert a == (rows(decontaminate.contamination(docs, bench)), rows(decontaminate.decontaminate(docs, bench)), rows(lines.dedup_lines(posts)))


def test_words_that_reach_over_slices_hash_alike(monkeypatch):
    monkeypatch.setattr(textsets, "SLICE", 64)
    textsets.powers.cache_clear()
    try:
        texts = [b"x" * 1000, b"a " + b"x" * 1000 + b" b", b" " * 128 + b"y", b"", b"q" * 64, b"q" * 63 + b" r"]
        w = textsets.words(texts)
        of = [[int(h) for h in w.hashes[w.first[k] : w.first[k + 1]]] for k in range(len(texts))]
        assert [len(x) for x in of] == [1, 3, 1, 0, 1, 2] and of[0][0] == of[1][1]
        assert len({h for x in of for h in x}) == 7
    finally:
        textsets.powers.cache_clear()


def test_long_texts_and_unbroken_words_take_bounded_tries():
    t = tokencount.Trie(tokencount.pieces(tokenizer_path("piece_bpe_32k.model")))
    n = t.tokens("▁" + "ab" * 500_000)
    assert n > 1000 and len(t.score) <= tokencount.SHARED + 1
    t.limit = 40
    words = [f"▁word{k}" for k in range(300)]
    fresh = tokencount.Trie(t.scores)
    assert [t.tokens(w) for w in words] == [fresh.tokens(w) for w in words] and len(t.score) < 80


def test_quality_fit_finds_the_best_single_rule():
    """Where one threshold separates the labels, brute force over all thresholds and the ensemble agree on every row."""
    g = np.random.default_rng(2)
    x = g.normal(size=(600, len(quality.STATS)))
    y = (x[:, 4] > 0.3).astype(float)
    model = quality.fit(x, y)
    best = max(((((x[:, s] > c) == y).mean(), s) for s in range(x.shape[1]) for c in np.quantile(x[:, s], np.linspace(0.05, 0.95, 19))))
    assert best[1] == 4 and (((model.odds(x) >= 0) == y).mean() >= best[0] - 0.02)
    assert {t.stat for rule, w in model.rules for t in rule if abs(w) > 1} <= {4} | {t.stat for rule, _ in model.rules for t in rule}


def test_quality_of_empty_repeated_and_long_rows(spark):
    docs = frame(spark, [(k, prose(50)) for k in range(60)] + [(k, "BUY!! " * 30) for k in range(60, 120)] + [(1, prose(50)), (1, prose(50)), (500, "word " * 200_000), (501, "x" * 1_000_000), (None, prose(9))])
    labels = spark.createDataFrame([(k, int(k < 60)) for k in range(120)], "doc_id long, quality int")
    got = quality.scored(docs, labels).collect()
    assert len(got) == 125 and all(0 <= r.score <= 1 for r in got)
    assert quality.scored(docs.limit(0), labels).count() == 0
    assert quality.keep_good(docs.withColumn("__s", docs.doc_id), labels).columns == [*docs.columns, "__s"]


def test_archives_roll_over_and_repeat_rows(spark, tmp_path, monkeypatch):
    html = "<p>" + prose(400)
    pages = spark.createDataFrame([(k % 7, "u", f"{html}{k % 5}") for k in range(40)] + [(100, "u", "y" * 3_000_000), (3, "u", None)], "page_id long, url string, html string")
    got = warc.round_trip(pages).collect()
    assert len(got) == 42 and sum(r.payload_bytes == 3_000_000 for r in got) == 1
    largest = collections.defaultdict(int)
    for k in range(40):
        largest[k % 5] = max(largest[k % 5], k % 7)
    assert collections.Counter((r.record_type, r.refers_to is not None) for r in got)["revisit", True] == sum(k % 7 != largest[k % 5] for k in range(40))


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 60)] + [(7, 7)]
    got = {r.node: r.comp for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{100 + k: 100 for k in range(60)}}


def test_shared_folder_must_be_named_on_a_cluster():
    class Fake:
        class conf:  # noqa: N801
            get = staticmethod(lambda *a: None)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError):
        common.shared_dir(Fake)


def test_components_are_put_together_without_looking_all_nodes_up_each_round(spark, monkeypatch):
    wrote = collections.Counter()
    plain = common.table

    def counted(df, what):
        out = plain(df, what)
        wrote[what] += out.count()
        return out

    monkeypatch.setattr(neardup, "table", counted)
    path = [(10_000 + k, 10_001 + k) for k in range(200)]  # needs many rounds
    pairs = [(2 * k, 2 * k + 1) for k in range(2_000)]  # are done after one
    comps = neardup.components(spark.createDataFrame(pairs + path, "a long, b long"))
    assert comps.count() == 4_201 and wrote["roots"] <= 4_201 + 2 * 201
    wrote.clear()
    more = [(1, 2), (9_000, 9_001), (9_001, 3), (0, 1), (10_150, 8)]
    got = {r.node: r.comp for r in neardup.joined(comps, spark.createDataFrame(more, "a long, b long")).collect()}
    want = {**{k: k - k % 2 for k in range(4_000)}, **{k: 8 for k in range(10_000, 10_201)}, **{k: 0 for k in (0, 1, 2, 3, 9_000, 9_001)}}
    assert got == want and wrote["roots"] <= 12  # only what the new links touch


def test_written_tables_leave_no_shuffle_files(spark):
    jvm = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    before = jvm.shuffleStatuses().size()
    for k in range(3):
        common.table(spark.range(1_000).groupBy("id").count(), f"counts{k}")
    assert jvm.shuffleStatuses().size() <= before
