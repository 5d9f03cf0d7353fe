import http.server
import json
import threading
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from tidewright import catalogue
from tidewright.functions import distributions as D
from tidewright.functions.examples import VALID
from tidewright.operators import country, identifiers, latlong, prepare, profile, relations, report, semantic, text
from tidewright.plans import lineage
from tidewright.sources.rest import RestSource
from tidewright.streaming.counters import windowed_counts

def test_valid_identifiers_pass_and_changed_ones_fail(spark):
    rows = [(n, v, v[:-1] + ("0" if v[-1] != "0" else "1")) for n, v in VALID.items()]
    df = spark.createDataFrame(rows, "name string, good string, bad string")
    picked = lambda c: F.coalesce(*[F.when(F.col("name") == n, identifiers.validate(n, F.col(c))) for n in VALID])
    got = df.select("name", picked("good").alias("good"), picked("bad").alias("bad")).collect()
    assert [r.name for r in got if not r.good] == []
    assert [r.name for r in got if r.bad] == []


def test_every_identifier_runs_and_refuses_nonsense(spark):
    df = spark.createDataFrame([("hello",), ("NULL",), (None,), ("",)], "x string")
    row = df.agg(*[F.max(identifiers.validate(n, F.col("x"))).alias(n) for n in identifiers.IDENTIFIERS]).first()
    assert [n for n in identifiers.IDENTIFIERS if row[n]] == []


def test_identifiers_with_birth_dates(spark):
    given = {"mx_curp": [("BOXW310820HNERXN09", True), ("BOXW310820HNERXN08", False), ("BOXW311320HNERXN09", False)],
             "it_codicefiscale": [("RCCMNL83S18D969H", True), ("RCCMNL 83S18 D969H", True), ("RCCMNL83S18D969", False), ("RCCMNL83S18D969G", False), ("00743110157", True), ("00743110158", False)]}
    for name, cases in given.items():
        df = spark.createDataFrame(cases, "x string, want boolean").select("want", identifiers.validate(name, F.col("x")).alias("got"))
        assert [r.got for r in df.collect()] == [want for _, want in cases], name


def test_text_steps(spark):
    def run(given, op, /, **params):
        df = spark.createDataFrame([(given,)], "t string")
        return text.clean_text(df, "t", [{"operator": op, "parameters": params}]).first()[0]

    assert run("NULL", "fillna") is None
    assert run("o'neil foo-bar", "title_case") == "O'Neil Foo-Bar"
    assert run("Simón ñandú", "remove_accents") == "Simon nandu"
    assert run("a (b) [c]", "remove_bracketed", brackets="round") == "a  [c]"
    assert run("the Cat is ON a mat", "remove_stopwords") == "Cat mat"
    assert run("Film film", "replace_text", value={"film": "movie"}) == "movie movie"
    assert run("#tag word", "remove_prefixed", prefix="#") == " word"


def test_sentence_case_of_all_letters_equals_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    letters = [(i, x) for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000 for x in (chr(i),) if x.upper() != x or x.lower() != x or 0xA7C0 < i < 0xA7E0 or 0x1C80 < i < 0x1C90 or 0x10D40 < i < 0x10D90]
    rows = [(2 * i, x + "aB") for i, x in letters] + [(2 * i + 1, "aB" + x + " " + x + "\n.") for i, x in letters] + [(-1, "ßHEIT, ẞ"), (-2, "xΑΣ ΣΑΣ"), (-3, ""), (-4, None), (-5, "ﬁN"), (-6, "İİ"), (-7, "日Σ😀É")]
    df = spark.createDataFrame(rows, "i long, t string")
    got = {r.i: r.t for r in text.clean_text(df, "t", [{"operator": "sentence_case"}]).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i BIGINT, text VARCHAR)")
    con.execute("INSERT INTO t SELECT unnest($1::BIGINT[]), unnest($2::VARCHAR[])", [[i for i, _ in rows], [x for _, x in rows]])
    want = dict(con.execute("SELECT i, upper(substr(text, 1, 1)) || lower(substr(text, 2)) FROM t").fetchall())
    assert len(got) == len(rows) and {i: (x, want[i]) for i, x in got.items() if x != want[i]} == {}
    assert got[-1] == "ẞheit, ß" and got[-2] == "Xασ σασ"


def test_headers(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], ["bookTitle", "__Author", "Publication (year)", "Number_Of_Pages"])
    assert text.clean_headers(df).columns == ["book_title", "author", "publication_year", "number_of_pages"]
    assert text.clean_headers(df, "camel").columns == ["bookTitle", "author", "publicationYear", "numberOfPages"]


def test_semantic_cleaners(spark):
    df = spark.createDataFrame([("Yi@gmali.com", "https://a.b.com/x?token=1&q=2", "3232235777", "555-234-5678 ext. 9", "NO", "41.5; -81.0")], "m string, u string, i string, p string, c string, l string")
    r = df.select(semantic.email(F.col("m")).alias("m"), semantic.url(F.col("u"), True).alias("u"), semantic.ipv4(F.col("i")).alias("i"), semantic.phone(F.col("p")).alias("p"), country.convert(F.col("c")).alias("c"), latlong.parsed(F.col("l")).alias("l")).first()
    assert r.m == "yi@gmali.com" and r.u.queries == {"q": "2"} and r.i == "192.168.1.1" and r.p == "555-234-5678 ext. 9" and r.c == "Norway" and tuple(r.l) == (41.5, -81.0)


def test_days_first_is_a_property_of_the_column(spark):
    df = spark.createDataFrame([("03/04/2020",), ("25/12/2019",), ("hello",)], "d string")
    assert [r.d_clean for r in semantic.clean_date(df, "d", "yyyy-MM-dd").collect()] == ["2020-04-03", "2019-12-25", None]


def test_distributions_against_known_values():
    assert abs(D.chi2_sf(3.841459, 1) - 0.05) < 1e-6
    assert abs(D.normal_sf(1.959964) - 0.025) < 1e-6
    assert abs(D.ks_sf(0.5, 20, 20) - 0.0135) < 5e-3
    import numpy as np

    assert [m[:2] for m in D.average_linkage(np.array([[0, 1, 5.0], [1, 0, 5.0], [5.0, 5.0, 0]]))] == [(0, 1), (2, 3)]


def test_rank_correlations_against_all_pairs(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(profile, "RANGES", 5)  # several ranges, of which some hold one frequent value
    rng = np.random.default_rng(1)
    x = np.where(rng.random(400) < 0.4, 7.0, rng.integers(0, 40, 400).astype(float))
    y = np.where(rng.random(400) < 0.3, -0.5, np.round(x / 3 + rng.normal(0, 4, 400), 1))
    s = np.sign(x[:, None] - x[None]) * np.sign(y[:, None] - y[None])
    tau = s.sum() / np.sqrt((np.sign(x[:, None] - x[None]) ** 2).sum() * (np.sign(y[:, None] - y[None]) ** 2).sum())
    ranks = lambda v: (v[:, None] > v[None]).sum(1) + (v[:, None] == v[None]).sum(1) / 2
    rho = np.corrcoef(ranks(x), ranks(y))[0, 1]
    rows = [(float(a), float(b), 1.0) for a, b in zip(x, y, strict=True)] + [(None, 1.0, 1.0), (float("nan"), 2.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, same double")
    assert abs(relations.kendall(df, ["a", "b"]).first().correlation - tau) < 1e-9
    assert abs(relations.spearman(df, ["a", "b"]).first().correlation - rho) < 1e-9
    assert relations.kendall(df, ["a", "same"]).first().correlation is None and relations.spearman(df, ["a", "same"]).first().correlation is None
    assert relations.kendall(df.limit(0), ["a", "b"]).count() == 0


def test_inversions():
    import numpy as np

    rng = np.random.default_rng(2)
    u, v, n = rng.integers(0, 9, 70), rng.integers(0, 9, 70), rng.integers(1, 5, 70)
    want = sum(n[i] * n[j] for i in range(70) for j in range(70) if u[i] < u[j] and v[i] > v[j])
    assert relations.inversions(u, v, n) == want


def test_boxes_and_outliers_of_groups(spark):
    rows = [(g, float(v)) for g, vs in {"a": [1, 2, 3, 4, 100], None: [5, 5, 5], "c": [7]}.items() for v in vs] + [("d", None), ("c", float("inf"))]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: tuple(r)[1:] for r in profile.box(df, "x", ["g"]).collect()}
    assert got == {"a": (2, 3, 4, 1, 4, 1), None: (5, 5, 5, 5, 5, 0), "c": (7, 7, 7, 7, 7, 0)}
    assert profile.box(df.limit(0), "x").count() == 0
    assert [r.x for r in relations.numeric_outliers(df, "x").collect()] == [100.0]
    assert [round(r.actual, 6) for r in profile.normal_quantiles(df.where("g = 'a'"), "x").orderBy("p").collect()][49] == 3


def test_near_values_against_all_pairs(spark):
    words = ["kitten", "kittens", "mitten", "sitting", "kit", "kitt", "abcdefgh", "abcdefg", "abxdefgh", "abcdefghij", None, "kitten"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    runs = lambda w: {w[i : i + 3] for i in range(len(w) - 2)} if len(w) > 3 else {w}
    got = {(r.a, r.b) for r in prepare.near_values(df, "w", 2, 3).collect()}
    every = spark.createDataFrame([(a, b) for a in set(words) - {None} for b in set(words) - {None} if a < b and runs(a) & runs(b)], "a string, b string")
    assert got == {(r.a, r.b) for r in every.where(F.levenshtein("a", "b") <= 2).collect()} and got


def test_profiles_of_odd_columns(spark):
    df = spark.createDataFrame([(None, float("nan")), (1.0, float("inf")), (1.0, 2.0)], "a double, b double")
    got = {(r.column, r.metric): r.value for r in profile.numeric_profile(df).collect()}
    assert got["a", "count"] == 2 and got["b", "infinite"] == 1 and got["b", "mean"] == 2 and got["b", "missing"] == 1
    assert [r["count"] for r in profile.histogram(df, "a", 4).orderBy("bin").collect()] == [2, 0, 0, 0]
    assert relations.missing_stats(df).first().missing_cells == 2
    assert relations.pearson(df).first().correlation is None


def test_missing_spectrum_against_sorted_rows(spark):
    key = {"bigint": F.col("id"), "string": F.concat(F.lit("k"), F.col("id") % 300), "date": F.date_add(F.lit("1970-01-01").cast("date"), (F.col("id") % 9).cast("int")), "boolean": F.col("id") < 30_000, "timestamp": F.timestamp_seconds(1_761_400_000 + F.col("id") * 7 % 40_000), "decimal": (F.col("id") * 3 % 40_000).cast("decimal(12,2)"), "struct": F.struct((F.col("id") % 50).alias("a"), F.lit("b").alias("b"))}
    for kind, c in key.items():
        df = spark.range(0, 40_000, 1, 8).select(F.when(F.col("id") % 11 != 5, c).alias("k"), F.when(F.col("id") * 31 % 7 != 0, 1.5).alias("p"))
        rows = sorted(((r.k is not None, r.k if r.k is not None else 0, r.p is None) for r in df.collect()), key=lambda r: (r[0], r[1] if r[0] else 0, r[2]))
        parts = [rows[i : i + 5_714] for i in range(0, 40_000, 5_714)]  # seven bins of 40,000 // 7, and two rows beyond
        want = {(b, "k", sum(not r[0] for r in x), len(x)) for b, x in enumerate(parts)} | {(b, "p", sum(r[2] for r in x), len(x)) for b, x in enumerate(parts)}
        assert sorted(map(tuple, relations.missing_spectrum(df, "k", 7).collect())) == sorted(want), kind
    few = spark.createDataFrame([(2, None), (1, 1.0)], "k int, p double")
    assert sorted(map(tuple, relations.missing_spectrum(few, "k").collect())) == [(0, "k", 0, 2), (0, "p", 1, 2)]
    assert relations.missing_spectrum(few.where("k > 2"), "k").collect() == []


def test_preparation(spark):
    df = spark.createDataFrame([(1.0, "a", 0), (3.0, None, 1), (None, "b", 1)], "n double, c string, y int")
    out = prepare.Prepare("y", num_scaling="minmax").fit(df).transform(df).collect()
    assert [r.n for r in out] == [0.0, 1.0, 0.5] and [list(r.c) for r in out] == [[1, 0, 0], [0, 0, 1], [0, 1, 0]]
    names = spark.createDataFrame([("New York",), ("york new",), ("Paris",)], "v string")
    assert prepare.cluster_by_key(names, "v", prepare.fingerprint(F.col("value"))).first().size == 2


def test_scaling_beside_a_column_of_many_values(spark):
    df = spark.createDataFrame([(i, float(i), None if i == 3 else f"name {9 - i}") for i in range(5)], "k int, n double, c string")
    of = lambda **given: prepare.Prepare("k", num_scaling="minmax", **given).fit(df).transform(df)
    assert [r.n for r in of(categories=2).select("k", "n").orderBy("k").collect()] == [0.0, 0.25, 0.5, 0.75, 1.0]
    for given in ({}, {"cat_imputation": "most_frequent"}, {"fill": "a"}, {"fill": None}):  # both ways give the same columns, whatever fills the gaps
        assert of(categories=2, **given).orderBy("k").collect() == of(**given).orderBy("k").collect()
    fitted = prepare.Prepare("k", categories=2).fit(df)
    assert [list(r.c) for r in fitted.transform(df.where("k = 0").withColumn("c", F.lit("name 8"))).collect()] == [[0, 0, 0, 1, 0]]


def test_registered_scaling_of_more_suppliers_than_categories(spark, tmp_path):
    rows = spark.range(10_001).select(F.col("id").alias("s_suppkey"), F.concat(F.lit("Supplier#"), F.col("id")).alias("s_name"), F.lit(1).alias("s_nationkey"), F.col("id").cast("double").alias("s_acctbal"))
    rows.write.parquet(f"{tmp_path}/supplier.parquet")
    got = {r.s_suppkey: r.s_acctbal for r in catalogue.QUERIES["ml_scale"](spark, str(tmp_path)).collect()}
    std = (10_001 * 10_002 / 12) ** 0.5
    assert len(got) == 10_001 and all(abs(got[k] - (k - 5_000) / std) < 1e-6 for k in range(10_001))


def test_registered_scaling_needs_no_expression_for_each_supplier(spark, tmp_path):
    rows = spark.range(2_000).select(F.col("id").alias("s_suppkey"), F.concat(F.lit("Supplier#"), F.col("id")).alias("s_name"), F.lit(1).alias("s_nationkey"), F.col("id").cast("double").alias("s_acctbal"))
    rows.write.parquet(f"{tmp_path}/supplier.parquet")
    plan, found = catalogue.QUERIES["ml_scale"](spark, str(tmp_path))._jdf.queryExecution().analyzed(), 0
    listed = lambda s: [s.apply(i) for i in range(min(s.size(), 1_000))]
    while plan is not None:
        todo = listed(plan.expressions())
        while todo and found < 1_000:
            found += 1
            todo += listed(todo.pop().children())
        plan = plan.children().apply(0) if plan.children().size() else None
    assert 20 < found < 1_000


def test_one_hot_of_odd_texts(spark):
    texts = ["a", "A", "a ", "\u00e9", "e\u0301", "\U0001f600", "\uffff", '"', "\\", "\\n", "\n", "\x00", "[]", "{", "'", ",", None]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, c string")
    names = sorted({*texts[:-1], "missing_value"})
    want = [[float(x == (t or "missing_value")) for x in names] for t in texts]
    assert [list(r.c) for r in prepare.Prepare("k").fit(df).transform(df).orderBy("k").collect()] == want
    assert [list(r.c) for r in prepare.Prepare("k", fill=None).fit(df).transform(df.where("k > 14")).orderBy("k").collect()] == [[float(x == ",") for x in names if x != "missing_value"], [None] * 16]
    assert prepare.Prepare("k", fill=None).fit(df.where("c is null")).transform(df.where("c is null")).first().c == []


def test_lineage(spark):
    spark.createDataFrame([(1, 2)], "a int, b int").createOrReplaceTempView("base")
    got = lineage.of_sql(spark, {"v2": "CREATE VIEW v2 AS SELECT s + 1 AS t FROM v1", "v1": "SELECT a + b AS s, a FROM base"})
    assert got["v1"]["s"] == ["base.a", "base.b"] and got["v1"]["a"] == ["base.a"] and list(got) == ["v1", "v2"]


def test_rest_source(spark):
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            q = parse_qs(urlparse(self.path).query)
            at, n = int(q["offset"][0]), int(q["limit"][0])
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"data": [{"id": i, "ok": "false", "in": {"x": i / 2}} for i in range(at, at + n)]}).encode())

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(RestSource)
    df = spark.read.format("tidewright_rest").schema("id long, ok boolean, `in.x` double").options(url=f"http://127.0.0.1:{server.server_port}/", rows="data", count="25", page_size="10", scheme="offset").load()
    got = sorted(df.collect())
    server.shutdown()
    assert len(got) == 25 and got[3] == (3, False, 1.5)


def test_rest_source_by_tokens_and_its_parameters(spark):
    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            q = parse_qs(urlparse(self.path).query)
            asked.append(q)
            at = int(q.get("after", q.get("page_token", q.get("offset", ["0"])))[0])
            ids = [i for i in range(at, at + int(q["limit"][0])) if i < 7]
            body = {"data": [{"id": i, "next": i + 1} for i in ids], "more": at + len(ids) if at + len(ids) < 7 else None}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(RestSource)

    def got(**options):
        asked.clear()
        reader = spark.read.format("tidewright_rest").schema("id long")
        return sorted(r.id for r in reader.options(url=f"http://127.0.0.1:{server.server_port}/", rows="data", count="30", page_size="3", **options).load().collect())

    assert got(scheme="token", token_path="more", offset_key="page_token") == list(range(7)) and len(asked) == 3
    assert got(scheme="seek", seek_path="next", offset_key="after") == list(range(7)) and len(asked) == 4
    assert got(scheme="offset", tasks="1") == list(range(7)) and len(asked) == 4
    with pytest.raises(Exception, match="unknown parameters: q"):
        got(scheme="offset", params="lang", **{"param.q": "1"})
    server.shutdown()


def test_countries_of_the_whole_table(spark):
    table = country.iso_countries(spark)
    assert len(table) > 240 and {len(row) for row in table} == {4}
    df = spark.createDataFrame([("IS",), ("isl",), ("Iceland",), ("Norway",), ("578",), ("nowhere",), (None,)], "c string")
    got = [r.c_clean for r in country.clean_country(df, "c", "alpha-3", table=table).collect()]
    assert got == ["ISL", "ISL", "ISL", "NOR", "NOR", None, None]
    with pytest.raises(Exception, match="not a country: nowhere"):
        country.clean_country(df, "c", errors="raise", table=table).collect()


def test_reports(spark):
    rows = [(1, "a", 2.5, "2024-01-01"), (2, "<b>", None, "2024-01-02"), (3, None, 4.0, None), (4, "a", 4.0, "2024-02-01")]
    df = spark.createDataFrame(rows, "id int, name string, x double, d string").withColumn("d", F.to_date("d"))
    made = report.create_report(df)
    assert {"overview", "memory", "variables: numbers", "variables: name", "variables: d", "correlations", "missing", "missing: totals"} == set(made)
    got = json.loads(report.to_json(made))
    assert {r["column"]: r["missing"] for r in got["missing"]} == {"id": 0, "name": 1, "x": 1, "d": 1}
    assert {r["column"]: r["bytes"] for r in got["memory"]} == {"id": 16, "name": 5, "x": 32, "d": 16}
    page = report.to_html({"values": made["variables: name"]}, "A & B")
    assert "A &amp; B" in page and "&lt;b&gt;" in page and "<b>" not in page
    diff = report.create_diff_report({"one": df, "two": df.where("id > 1")})
    assert {(r._src, r["count"]) for r in diff["variables: name"].where("value = 'a'").collect()} == {("one", 2), ("two", 1)}
    assert sum(r["count"] for r in diff["variables: d"].collect()) == 5
    assert set(report.plot(df, "name", "x")) == {"groups"} and set(report.plot(df, "x", "d")) == {"series", "boxes"}
    assert set(report.plot(df, "x")) == {"stats", "histogram", "box", "quantiles"} and set(report.plot(df, "d", "x", "name")) == {"series"}
    with pytest.raises(ValueError):
        report.plot(df, "d", "d")
    assert [report.display(x) for x in (None, 12345678, 0.123456789, "t", True)] == ["", "12,345,678", "0.12346", "t", "True"]
    assert [tuple(r) for r in relations.most_missing(df.select("id", "name", "x"), ["id"]).where("kind = 'row'").collect()] == [("row", "2", 1), ("row", "3", 1)]


def test_insights_in_order(spark):
    df = spark.createDataFrame([(f"k{i:02}", "same", float(i % 2)) for i in range(60)], "a string, b string, c double")
    got = profile.insights(df)
    kinds = {(r.kind, r.column) for r in got.collect()}
    assert {("high_cardinality", "a"), ("unique", "a"), ("constant_length", "a"), ("constant", "b"), ("constant_length", "b"), ("zeros", "c")} <= kinds
    pages = profile.insight_pages(got, 3).collect()
    assert {r.page for r in pages} == set(range(1, -(-len(kinds) // 3) + 1)) and max(r.page for r in pages if r.kind == "zeros") == max(r.page for r in pages)
    assert profile.insights(df.limit(0)).count() == 0


def test_streaming_counts(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:20:00", "a"), ("2024-01-01 02:00:00", None)], "t string, v string").withColumn("t", F.col("t").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("t timestamp, v string").parquet(str(tmp_path / "in"))
    q = windowed_counts(stream, "t", "v").writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.value, r["count"], r.missing) for r in spark.table("counts").collect()} == {("a", 2, 0), (None, 1, 1)}


def test_a_raise_policy_raises(spark):
    with pytest.raises(Exception, match="not a valid"):
        identifiers.clean(spark.createDataFrame([("x1",)], "v string"), "v", "iban", errors="raise").collect()


def test_dates_in_all_shapes(spark):
    cases = [("2020-03-04", "2020-03-04 00:00:00"), ("4 March 2020 at noon", None), ("March 4th, 2020 3:07 PM", "2020-03-04 15:07:00"), ("Wed, 4 Mar 2020 12:05 am", "2020-03-04 00:05:00"), ("2020-03-04T05:06:07", "2020-03-04 05:06:07"), ("3/4/2020 5 pm", "2020-03-04 17:00:00"), ("2020-13-04", None), ("20200304", "2020-03-04 00:00:00"), (None, None), ("", None), ("2020", None)]
    df = spark.createDataFrame(cases, "t string, want string")
    got = semantic.clean_date(df, "t").collect()
    assert [(r.t, r.t_clean) for r in got] == cases
    filled = semantic.clean_date(spark.createDataFrame([("2020",), ("March 2021",), ("2021-7",)], "t string"), "t", "yyyy-MM-dd", fix_missing="minimum").collect()
    assert [r.t_clean for r in filled] == ["2020-01-01", "2021-03-01", "2021-07-01"]
    with pytest.raises(ValueError):
        semantic.clean_date(df, "t", "YYYY-jj")


def test_addresses_of_both_ip_versions(spark):
    cases = [("::", "::"), ("::1", "::1"), ("2001:0db8:0:0:1:0:0:1", "2001:db8::1:0:0:1"), ("fe80::1:2:3:4:5:6:7:8", None), ("1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8"), ("1:2:3", None), ("g::1", None), (":::", None), ("12345::", None)]
    df = spark.createDataFrame(cases, "t string, want string")
    assert [r[0] for r in df.select(semantic.ipv6(F.col("t"))).collect()] == [w for _, w in cases]


def test_e_mails_by_their_parts(spark):
    good = ["a@b.co", "first.last+tag@sub.example-host.org", "X_1@EXAMPLE.COM"]
    bad = ["a@b", "a..b@c.org", ".a@c.org", "a@-c.org", "a@c-.org", "a b@c.org", "a@b@c.org", "@c.org", "a@", "x" * 65 + "@c.org", None, ""]
    df = spark.createDataFrame([(x,) for x in good + bad], "t string")
    assert [r[0] for r in df.select(semantic.validate(F.col("t"), "email")).collect()] == [True] * len(good) + [False] * len(bad)


def test_coordinates_of_many_forms(spark):
    cases = [("41.5, -81.0", (41.5, -81.0)), ("41.5; -81", (41.5, -81.0)), ("41° 30′ 0″ N, 81° 0′ 0″ W", (41.5, -81.0)), ("41.5 N 81.0 W", (41.5, -81.0)), ("(41.5,-81.0)", (41.5, -81.0)), ("91, 0", None), ("41° 75′ N, 81 W", None), ("hello", None), ("1 2 3", None), (None, None), ("-81.0", None)]
    got = latlong.clean_lat_long(spark.createDataFrame([(t,) for t, _ in cases], "t string"), "t").collect()
    assert [tuple(r.t_clean) if r.t_clean else None for r in got] == [w for _, w in cases]


def test_quantiles_of_counted_values_equal_the_exact_ones(spark):
    import numpy as np

    g = np.random.default_rng(8)
    a, b = g.normal(size=3000), g.integers(0, 5, 3000).astype(float)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b, strict=True)] + [(None, float("nan")), (float("inf"), 1.0)], "a double, b double")
    got = {(r.column, r.metric): r.value for r in profile.numeric_profile(df).collect()}
    for p in profile.QUANTILES:
        assert abs(got["a", f"q{round(100 * p):02d}"] - np.quantile(a, p)) < 1e-9 and got["b", f"q{round(100 * p):02d}"] == np.quantile(np.append(b, 1.0), p)
    assert got["a", "distinct"] == 3001 and got["b", "distinct"] == 5 and got["a", "infinite"] == 1
    empty = {(r.column, r.metric): r.value for r in profile.numeric_profile(df.limit(0)).collect()}
    assert empty["a", "count"] == 0 and empty["a", "q50"] is None and empty["b", "distinct"] == 0
