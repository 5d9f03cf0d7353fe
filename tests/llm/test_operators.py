"""Each operator against brute force on small fixtures with nulls, empty and long texts, ties, repeated rows and clashing column names."""

import collections
import hashlib
import itertools
import math
import random
import re
import textwrap

import numpy as np
import pytest

from tidewright.llm import decontaminate, licences, lines, minhash, passages, quality, textsets, tokencount, topk, warc
from tidewright.llm.queries import tokenizer_path

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
rng = random.Random(5)
VOCAB = [a + b for a in ("ba", "Ke", "li", "mo", "Éru", "ta") for b in ("n", "s", "rik", "lo", "m")]


def prose(n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def frame(spark, rows, extra="score string"):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], f"doc_id long, text string, {extra}")


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOW))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(rows, percent=85):
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, s), (j, t) in itertools.combinations([(i, shingles(t)) for i, t in rows if i is not None], 2):
        if s and t and 100 * len(s & t) >= percent * len(s | t):
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    return {i: root(i) for i in parent}


def near_copies():
    base, rows = prose(120).split(), []
    for k in range(60):
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(40)}"
        rows.append((k * 3 + 1, " ".join(w)))
    return rows


def test_near_duplicates_are_the_exact_components(spark):
    rows = [*near_copies(), *[(1000 + k, prose(60)) for k in range(30)], (500, ""), (501, None), (502, " \t\n "), (503, "Two words"), (504, "two WORDS"), (505, "É two"), (506, "é two"), (None, prose(9)), (700, prose(20_000))]
    rows += [(800, rows[0][1]), (800, rows[0][1])]
    got = minhash.near_duplicates(frame(spark, rows, "component_id string")).collect()
    want = components(rows)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    sizes = {r.doc_id: r.n_shingles for r in got}
    assert all(sizes[i] == len(shingles(t)) for i, t in rows)
    assert minhash.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_rows_of_one_id_tie_their_texts(spark):
    a, b = prose(40), prose(40)
    got = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(frame(spark, [(5, a), (2, a), (5, b), (9, b), (7, prose(40))])).collect()}
    assert got == {(5, 2), (2, 2), (9, 2), (7, 7)}


def test_near_dedup_stage_links_from_80_percent_on(spark):
    import corpus_pipeline

    rows = [(1000 + k, prose(60)) for k in range(10)]
    for k in range(20):  # one word changed of 54 to 60: Jaccard 45 / 55 to 51 / 61
        w = prose(54 + k % 7).split()
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join([*w[:25], f"edit{k}", *w[26:]]))]
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, frame(spark, rows), "").collect())
    want = components(rows, 80)
    assert got == sorted(i for i in want if want[i] == i) and len(got) == 30
    assert len(set(components(rows, 85).values())) == 50 == minhash.keep_one(frame(spark, rows)).count()


def test_circulant_signatures_estimate_jaccard():
    a, b = prose(400).split(), prose(400).split()
    texts = [" ".join(a).encode(), " ".join(a[:300] + b[300:]).encode()]
    s = textsets.shingle_sets(textsets.words(texts))
    m = textsets.Circulant(144, 24).signature(s)
    x, y = set(s.items[: s.first[1]].tolist()), set(s.items[s.first[1] :].tolist())
    assert abs((m[0] == m[1]).mean() - len(x & y) / len(x | y)) < 0.15


def test_quality_learns_what_the_statistics_show(spark):
    good, bad = [(i, prose(80) + ".") for i in range(300)], [(i, "SPAM!! " * 40) for i in range(300, 450)]
    docs = frame(spark, [*good, *bad, (900, None), (901, "")], "predicted string")
    labels = spark.createDataFrame([(i, int(i < 300)) for i in range(450)] + [(5, None), (99999, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.scored(docs, labels).collect()}
    held = [r for r in got.values() if r.held_out and r.doc_id < 450]
    assert held and sum(r.predicted == int(r.doc_id < 300) for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values()) and len(got) == 452
    assert quality.scored(docs, labels.limit(0)).first().score == 0.5
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_compiled_rules_score_like_the_model(spark):
    x = quality.statistics([prose(k).encode() for k in range(1, 60)])
    model = quality.fit(x, (np.arange(len(x)) > 30).astype(float))
    rows = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{s} double" for s in quality.STATS))
    from pyspark.sql import functions as F

    got = [r[0] for r in rows.select(quality.compiled(model, F.struct(*quality.STATS))).collect()]
    assert np.allclose(got, 1 / (1 + np.exp(-model.odds(x))))


def test_lines_of_recurring_templates_go_but_for_the_first(spark):
    rows = [(i, f"{prose(8)} {i}x\nPosted by user number {i} on our board\nshort line\n{prose(9)} y{i}") for i in range(20)] + [(50, None), (51, ""), (None, "Posted by user number 7 on our board")]
    got = {r.doc_id: r.text for r in lines.dedup_lines(frame(spark, rows, "line string")).collect()}
    assert len(got) == len(rows) and got[50] is None and got[51] == ""
    assert got[None] == "Posted by user number 7 on our board"  # the first in order
    for i in range(20):
        kept = rows[i][1].split("\n")
        assert got[i] == "\n".join([kept[0], kept[2], kept[3]])
    counts = lines.deduplicated(frame(spark, rows)).collect()
    assert sum(r.n_dropped for r in counts) == 20


def test_lines_of_repeated_rows_count_once(spark):
    rows = [(i, f"Posted by user number {i} on our board\nOne of the " + " ".join(chr(97 + i) + c for c in "vwxyz")) for i in range(12)]
    got = sorted((r.doc_id, r.text) for r in lines.dedup_lines(frame(spark, rows * 2)).collect())
    assert got == sorted((i, t if i == 0 else t.split("\n")[1]) for i, t in rows * 2)


def test_lines_of_half_variable_tokens_go_and_those_of_fewer_constant_ones_stay(spark):
    tail = lambda i: " ".join(chr(97 + i) + c for c in "vwxy")
    rows = [(i, f"Posted by u{i} on 2020-01-{i + 10}\nPage {i} of {i + 9} in total\nOne of the {tail(i)}\n{tail(i)} | x | y") for i in range(12)]
    got = {r.doc_id: r.text for r in lines.dedup_lines(frame(spark, rows)).collect()}
    assert got == {i: "\n".join(t.split("\n")[2:]) if i else t for i, t in rows}


def test_short_lines_go_in_the_query_and_the_stage(spark, tmp_path):
    import corpus_pipeline
    from tidewright.llm.queries import QUERIES

    rows = [(i, f"own{chr(97 + i)}\nLes.\nOf, edti oner.\n{i}\n\nAll rights reserved now.") for i in range(12)]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted((r.doc_id, r.n_dropped) for r in QUERIES["op3_lines"](spark, str(tmp_path)).collect()) == [(i, 3 if i else 0) for i in range(12)]
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, frame(spark, rows), "").collect()}
    assert got == {i: f"own{chr(97 + i)}\n{i}\n" if i else t for i, t in rows}


def test_licences_against_brute_force_and_inheritance(spark):
    idf, vectors = licences.weights(licences.TEMPLATES)
    unknown = licences.unknown_weight(licences.TEMPLATES)

    def best(text):
        out = (2, 0, None)
        low = (text or "").lower()
        for unit in [*low.split("\n"), *re.split(licences.SENTENCES, low)]:
            n = collections.Counter(t for t in re.split("[^a-z0-9]+", unit) if t and t not in licences.COMMON)
            norm = math.sqrt(sum((k * idf.get(t, unknown)) ** 2 for t, k in n.items()))
            for (name, _), v in sorted(vectors.items()):
                c = round(sum(k * idf.get(t, unknown) * v.get(t, 0) for t, k in n.items()) / norm, 9) if norm else 0
                if c >= licences.THRESHOLD and len(n.keys() & v.keys()) >= min(len(v), licences.SHARED):
                    out = min(out, (name in licences.WEAK, -c, name))
        return out[2]

    every = [t for texts in licences.TEMPLATES.values() for t in texts]
    texts = [*every, "Released under the MIT License, see below", "the license", prose(50), "All rights reserved. " + prose(30), None, "", "x\n\nLicensed under CC BY-NC 4.0.\ny", "Copyright 2020 Jane Doe. Released under the MIT License."]
    texts += ["\n".join(textwrap.wrap(t, 40)) for t in every] + ["MIT License\n\nCopyright (c) 2020 Jane Doe. All rights reserved.\n\n" + "\n".join(textwrap.wrap(licences.TEMPLATES["MIT"][3], 60)), "# This program is free software; you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation; either version 3 of the License, or\n# (at your option) any later version.", prose(20_000), "mit " * 3000, "Mit.\nund mit"]
    files = spark.createDataFrame([(k, f"a/b/{k}", t) for k, t in enumerate(texts)], "file_key long, path string, text string")
    got = {r.file_key: r.licence for r in licences.unit_matches(files).collect()}
    assert {k: got.get(k) for k in range(len(texts))} == {k: best(t) for k, t in enumerate(texts)}
    assert got[len(texts) - 5] == "MIT" and got[len(texts) - 4] == "GPL-3.0"
    assert licences.unit_matches(files.limit(0)).count() == 0
    doubled = licences.scan_documents(frame(spark, [(1, "MIT License"), (1, "MIT License"), (None, "MIT License"), (2, None)], "source string, licence string, cosine string"[:13]))
    assert sorted((str(r.doc_id), r.licence, r.licence_source) for r in doubled.collect()) == [("1", "MIT", "own"), ("1", "MIT", "own"), ("2", "MIT", "inherited"), ("None", "MIT", "own")]
    tree = spark.createDataFrame([(1, "r/LICENSE", "Released under the MIT License"), (2, "r/a/b/c.py", "code"), (3, "r/a/LICENSE", "All rights reserved"), (4, "q/x", "code"), (5, None, "code")], "file_key long, path string, text string")
    from pyspark.sql import functions as F

    out = {r.file_key: (r.licence, r.licence_source) for r in licences.scan(tree, F.col("path").endswith("LICENSE")).collect()}
    assert out == {1: ("MIT", "own"), 2: ("Proprietary", "inherited"), 3: ("Proprietary", "own"), 4: (None, None), 5: (None, None)}


def test_token_counts_against_plain_dynamic_programming(spark):
    path = tokenizer_path("piece_bpe_32k.model")
    scores = tokencount.pieces(path)
    missing = -math.log(2 * len(scores) + 2)
    longest = max(map(len, scores))

    def plain(word):
        best = [(0.0, 0)]
        for k in range(1, len(word) + 1):
            ways = [(best[k - 1][0] + missing, best[k - 1][1] + 1)]
            ways += [(best[j][0] + scores[word[j:k]], best[j][1] + 1) for j in range(max(0, k - longest), k) if word[j:k] in scores]
            top = max(s for s, _ in ways)
            best.append((top, min(n for s, n in ways if s > top - 1e-9)))
        return best[-1][1]

    texts = ["hello world", prose(30), "日本語 naïve", None, "", "x" * 300, "unbelievable internationalization"]
    got = {r.doc_id: r for r in tokencount.token_counts(frame(spark, list(enumerate(texts)), "n_tokens string"), path).collect()}
    for k, t in enumerate(texts):
        words = (t or "").split()
        assert (got[k].n_pretokens, got[k].n_tokens) == (len(words), sum(plain("▁" + w) for w in words))


def test_top_k_with_ties_gaps_and_bad_rows(spark):
    g = np.random.default_rng(3)
    rows = [(i, g.normal(0, 0.2, 8).round(1).tolist()) for i in range(300)] + [(400, None), (450, [0.0] * 8), (451, [float("nan")] * 8), (452, [None] * 8), (500, rows_of := [0.5] * 8), (501, rows_of), (None, rows_of), (550, [0.1] * 4), (551, [0.2] * 4)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    got = collections.defaultdict(list)
    for r in topk.nearest(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    ok = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    for q in [i for i in ok if i % 50 == 0]:
        want = sorted(((-sum(a * b for a, b in zip(ok[q], v, strict=True)), i) for i, v in ok.items() if i != q and len(v) == len(ok[q])))[:5]
        assert got[q] == [(i, -s) for s, i in want]
    assert topk.nearest(df.limit(0)).count() == 0


def test_top_k_of_huge_components(spark):
    g = np.random.default_rng(4)
    rows = [(i, (g.integers(-9, 10, 6) * 2.0**18).tolist()) for i in range(120)] + [(200, [2.0**23, 0.0, 0.0, 0.0, 0.0, 0.0])]
    near = [(i, [x * 2 for x in v]) for i, v in rows]  # sums of products are near the end of the longs
    for given in (rows, near):
        got = collections.defaultdict(list)
        for r in topk.nearest(spark.createDataFrame(given, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.vec_id, r.score))
        whole = {i: [math.floor(256 * x) for x in v] for i, v in given}
        for q in (0, 50, 100, 200):
            want = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q)[:5]
            assert got[q] == [(i, -s) for s, i in want]
    for value in (2.0**31, 1e38):  # a score that is no long; a component that is none
        with pytest.raises(Exception, match="no long|too large"):
            topk.nearest(spark.createDataFrame([(0, [value]), (1, [value])], "vec_id long, embedding array<double>")).collect()


def test_passages_repeated_across_documents_are_found(spark):
    passage, line = prose(60), prose(60)
    near = line.split()
    near[20] = "changed"
    rows = [(1, prose(50) + " before1 " + passage + " after1 " + prose(30)), (2, prose(35) + " before2 " + passage), (3, prose(80)), (4, prose(10) + "\n" + line), (5, line), (6, " ".join(near) + "\n" + prose(12)), (7, None), (8, ""), (None, passage), (9, prose(5) + " " + prose(30))]
    got = {r.doc_id: r for r in passages.document_repeats(frame(spark, rows)).collect()}
    assert set(got) == {1, 2, 4, 5, 6} and got[1].removed_words == 0 and got[4].removed_words == 0
    assert got[2].removed_words == 60 and got[5].removed_words == 60 and got[2].keepers == [1]
    left = {r.doc_id: r.text for r in passages.cut_repeats(frame(spark, rows)).collect()}
    assert left[3] == rows[2][1] and left[5] == "" and len(left) == len(rows)


def test_decontamination_against_brute_force(spark):
    item = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOW))
    bench = [("a", prose(20)), ("b", "Only three words"), ("c", ""), ("d", None), (None, prose(10)), ("e", prose(12))]
    docs = [(1, prose(9) + " " + bench[0][1].upper().replace("É", "É") + ". " + prose(9)), (2, "well, ONLY three words!"), (3, bench[0][1] + " only three words"), (4, prose(50)), (5, None), (6, ""), (None, bench[5][1]), (1, prose(20)), (2, "well, ONLY three words!")]
    table = spark.createDataFrame(bench, "item_id string, text string")
    got = collections.Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.contamination(frame(spark, docs, "n_hit string"), table).collect())
    want = collections.Counter()
    for i, t in docs:
        w, hit, items = item(t), set(), set()
        for k, b in bench:
            v = item(b)
            n = min(8, len(v))
            for s in range(len(w) - n + 1) if v and k is not None else ():
                if any(w[s : s + n] == v[j : j + n] for j in range(len(v) - n + 1)):
                    hit |= set(range(s, s + n))
                    items.add(k)
        want[i, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), len(items) >= 2] += 1
    assert got == want
    left = sorted((str(r.doc_id), r.text) for r in decontaminate.decontaminate(frame(spark, docs), table).collect())
    assert ("2", "well, ") in left and all("three" not in (t or "") for _, t in left) and ("4", docs[3][1]) in left and len(left) == len(docs) - 1
    assert decontaminate.contamination(frame(spark, docs), table.limit(0)).count() == len(docs)


def test_archives_come_back_whole_and_bad_ones_are_refused(spark, tmp_path):
    big = "<p>" + prose(300) + "é" * 10
    pages = [(1, "http://a/x y", big), (2, None, big), (3, "http://b\r\n", "small"), (4, "u", "small"), (5, "u", None), (None, "u", big), (7, "u", ""), (8, "u", "z" * 1000)]
    df = spark.createDataFrame([(*p, "q") for p in pages], "page_id long, url string, html string, record_type string")
    got = {r.page_id: r for r in warc.round_trip(df).collect()}
    for i, _, html in pages:
        data = (html or "").encode()
        revisit = i == 1
        assert tuple(got[i])[1:] == (len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", 2 if revisit else None)
    good = warc.record(1, "u", b"abc", None)
    assert warc.parsed(good)[:2] == (1, 3)
    for bad in (good[:-1], good.replace(b"abc", b"abd"), b"HTTP" + good, good.replace(b"Content-Length: 3", b"Content-Length: 4")):
        with pytest.raises((ValueError, KeyError)):
            warc.parsed(bad)
    payloads = {r.page_id: r.payload for r in warc.read_archives(warc.write_archives(df, str(tmp_path / "w")), str(tmp_path / "w"), payloads=True).collect()}
    assert payloads[2] == big.encode() and payloads[1] is None
    assert warc.round_trip(df.limit(0)).count() == 0


def test_pipeline_keeps_columns_and_runs_all_stages(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "encoding"]
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert 0 < out.count() <= spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
