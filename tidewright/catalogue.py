"""All registered queries of the library proper, with the SQL they are checked against. Every query covers its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.examples import VALID
from .functions.nulls import NULL_VALUES
from .operators import country, identifiers, latlong, prepare, profile, relations, report, semantic, text

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _add(name: str, table: str, make: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: make(_read(spark, sf_dir, table))
    if sql:
        ORACLES[name] = sql


def _rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(f.name, places).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in df.schema])


_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _num_sql(c: str) -> str:
    m = f"(SELECT avg({c}) FROM lineitem)"
    parts = {
        "count": f"count({c})", "missing": f"count(*) - count({c})", "distinct": f"count(DISTINCT {c})", "infinite": "count(*) - count(*)", "min": f"min({c})", "max": f"max({c})", "mean": f"avg({c})", "std": f"stddev_samp({c})", "variance": f"var_samp({c})",
        "skewness": f"avg(pow({c} - {m}, 3)) / pow(avg(pow({c} - {m}, 2)), 1.5)", "kurtosis": f"avg(pow({c} - {m}, 4)) / pow(avg(pow({c} - {m}, 2)), 2) - 3", "sum": f"avg({c}) * count({c})", "zeros": f"count(*) FILTER ({c} = 0)", "negatives": f"count(*) FILTER ({c} < 0)",
        "q05": f"quantile_cont({c}, 0.05)", "q25": f"quantile_cont({c}, 0.25)", "q50": f"quantile_cont({c}, 0.5)", "q75": f"quantile_cont({c}, 0.75)", "q95": f"quantile_cont({c}, 0.95)",
    }
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{k}' AS metric, round(CAST({v} AS DOUBLE), 4) + 0.0 AS value FROM lineitem" for k, v in parts.items())


_add("num_profile", "lineitem", lambda d: _rounded(profile.numeric_profile(d, _NUM), 4).withColumn("value", F.col("value") + 0.0), " UNION ALL ".join(_num_sql(c) for c in _NUM))
_add("overview_stats", "lineitem", profile.overview, """
WITH s AS (SELECT count(*) AS n FROM lineitem), d AS (SELECT count(*) AS k FROM (SELECT DISTINCT * FROM lineitem))
SELECT * FROM (SELECT 'rows' AS metric, n AS value FROM s UNION ALL SELECT 'columns', 11 FROM s UNION ALL SELECT 'cells', n * 11 FROM s UNION ALL SELECT 'missing_cells', 0 FROM s UNION ALL SELECT 'distinct_rows', k FROM d
UNION ALL SELECT 'duplicate_rows', n - k FROM s, d UNION ALL SELECT 'numeric_columns', 8 FROM s UNION ALL SELECT 'time_columns', 1 FROM s UNION ALL SELECT 'nominal_columns', 2 FROM s)""")
_add("value_counts", "part", lambda d: _rounded(profile.value_counts(d, "p_brand")), "SELECT p_brand AS value, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM part GROUP BY 1")
_add("top_values", "customer", lambda d: profile.value_counts(d, "c_nationkey", 10).select("value", "count"), "SELECT CAST(c_nationkey AS VARCHAR) AS value, count(*) AS count FROM customer GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
_add("nom_profile", "customer", lambda d: _rounded(profile.nominal_profile(d, "c_name")), """
WITH v AS (SELECT c_name AS v FROM customer)
SELECT metric, round(CAST(value AS DOUBLE), 6) AS value FROM (SELECT 'count' AS metric, CAST(count(v) AS DOUBLE) AS value FROM v UNION ALL SELECT 'missing', count(*) - count(v) FROM v UNION ALL SELECT 'distinct', count(DISTINCT v) FROM v
UNION ALL SELECT 'length_mean', avg(length(v)) FROM v UNION ALL SELECT 'length_min', min(length(v)) FROM v UNION ALL SELECT 'length_max', max(length(v)) FROM v UNION ALL SELECT 'length_median', quantile_cont(length(v), 0.5) FROM v
UNION ALL SELECT 'lower', sum(len(regexp_extract_all(v, '[a-z]'))) FROM v UNION ALL SELECT 'upper', sum(len(regexp_extract_all(v, '[A-Z]'))) FROM v UNION ALL SELECT 'spaces', sum(len(regexp_extract_all(v, '\\s'))) FROM v
UNION ALL SELECT 'dashes', sum(len(regexp_extract_all(v, '-'))) FROM v UNION ALL SELECT 'digits', sum(len(regexp_extract_all(v, '[0-9]'))) FROM v)""")
_HIST = """
WITH e AS (SELECT min({c}) AS lo, max({c}) AS hi FROM {t}), h AS (SELECT CAST(least(floor(({c} - lo) / (hi - lo) * 50), 49) AS INTEGER) AS bin, count(*) AS n FROM {t}, e GROUP BY 1)
SELECT b.bin, round(lo + b.bin * ((hi - lo) / 50), 6) AS lower, round(CASE WHEN b.bin = 49 THEN hi ELSE lo + (b.bin + 1) * ((hi - lo) / 50) END, 6) AS upper, coalesce(n, 0) AS count
FROM (SELECT CAST(unnest(range(50)) AS INTEGER) AS bin) b, e LEFT JOIN h ON b.bin = h.bin"""
_add("histogram_50", "orders", lambda d: _rounded(profile.histogram(d, "o_totalprice")), _HIST.format(c="o_totalprice", t="orders").replace("b, e LEFT JOIN h", "b CROSS JOIN e LEFT JOIN h"))
_BOX = """
WITH q AS (SELECT {g} AS g, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.75) AS q3 FROM {t} GROUP BY 1)
SELECT {o} round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(min({c}) FILTER ({c} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS low,
round(max({c}) FILTER ({c} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS high, count(*) FILTER (NOT {c} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers FROM {t} JOIN q ON q.g IS NOT DISTINCT FROM {g} GROUP BY {k} q1, median, q3"""
_add("box_stats", "supplier", lambda d: _rounded(profile.box(d, "s_acctbal")), _BOX.format(g="1", c="s_acctbal", t="supplier", o="", k=""))
_add("group_box", "lineitem", lambda d: _rounded(profile.box(d, "l_extendedprice", ["l_returnflag"])), _BOX.format(g="l_returnflag", c="l_extendedprice", t="lineitem", o="l_returnflag,", k="l_returnflag,"))
_add("group_histogram", "lineitem", lambda d: profile.histogram(d, "l_quantity", 10, by="l_returnflag").select("group", "bin", "count"), """
WITH e AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem), h AS (SELECT l_returnflag AS g, CAST(least(floor((l_quantity - lo) / (hi - lo) * 10), 9) AS INTEGER) AS bin, count(*) AS n FROM lineitem, e GROUP BY 1, 2)
SELECT f.g AS "group", b.bin, coalesce(n, 0) AS count FROM (SELECT DISTINCT l_returnflag AS g FROM lineitem) f CROSS JOIN (SELECT CAST(unnest(range(10)) AS INTEGER) AS bin) b LEFT JOIN h ON h.g = f.g AND h.bin = b.bin""")
_add("group_mean", "lineitem", lambda d: _rounded(profile.group_numeric(d, "l_returnflag", "l_quantity").select("group", "mean", "count")), "SELECT l_returnflag AS \"group\", round(avg(l_quantity), 6) AS mean, count(*) AS count FROM lineitem GROUP BY 1")
_add("pair_counts", "part", lambda d: _rounded(profile.pair_counts(d, "p_brand", "p_type", 10, 3)), """
WITH c AS (SELECT p_brand AS x, p_type AS y, count(*) AS n FROM part GROUP BY 1, 2), tx AS (SELECT x FROM c GROUP BY x ORDER BY sum(n) DESC, x LIMIT 10), ty AS (SELECT y FROM c GROUP BY y ORDER BY sum(n) DESC, y LIMIT 3),
r AS (SELECT x, CASE WHEN y IN (SELECT y FROM ty) THEN y ELSE 'Others' END AS y, sum(n) AS n FROM c WHERE x IN (SELECT x FROM tx) GROUP BY 1, 2)
SELECT x, y, CAST(n AS BIGINT) AS count, round(n / sum(n) OVER (PARTITION BY x), 6) AS share FROM r""")
_SIZE_BINS = """
WITH e AS (SELECT min(p_size) AS lo, max(p_size) AS hi FROM part),
r AS (SELECT CAST(least(greatest(ceil((p_size - lo) / CAST(hi - lo AS DOUBLE) * 10) - 1, 0), 9) AS INTEGER) AS bin, p_retailprice AS y FROM part, e), q AS"""
_add("numeric_boxes", "part", lambda d: _rounded(profile.numeric_boxes(d, "p_size", "p_retailprice", 10)), _BOX.format(g="bin", c="y", t="r", o="bin,", k="bin,").replace("WITH q AS", _SIZE_BINS))
_add("hexbins", "part", lambda d: profile.hexbins(d, "p_size", "p_retailprice", 50.0), """
WITH f AS (SELECT (p_size * (sqrt(3) / 3) - p_retailprice / 3) / 50 AS fq, p_retailprice * 2 / 3 / 50 AS fr FROM part), h AS (SELECT fq, fr, -fq - fr AS fs FROM f),
n AS (SELECT *, round_even(fq, 0) AS q, round_even(fr, 0) AS r, round_even(fs, 0) AS s FROM h), d AS (SELECT *, abs(q - fq) AS dq, abs(r - fr) AS dr, abs(s - fs) AS ds FROM n)
SELECT CAST(CASE WHEN dq > dr AND dq > ds THEN -r - s ELSE q END AS INTEGER) AS q, CAST(CASE WHEN NOT (dq > dr AND dq > ds) AND dr > ds THEN -q - s ELSE r END AS INTEGER) AS r, count(*) AS count FROM d GROUP BY 1, 2""")
_TS = """
WITH b AS (SELECT date_trunc('week', {c} + INTERVAL 1 DAY) - INTERVAL 1 DAY AS bucket, {v} AS v FROM {t}), m AS (SELECT bucket, {a} AS value FROM b GROUP BY 1),
k AS (SELECT unnest(generate_series((SELECT min(bucket) FROM b), (SELECT max(bucket) FROM b), INTERVAL 7 DAY)) AS bucket)
SELECT k.bucket, {o} FROM k LEFT JOIN m ON k.bucket = m.bucket"""
_add("ts_freq_week", "orders", lambda d: profile.time_series(d, "o_orderdate", "week"), _TS.format(c="o_orderdate", v="1", t="orders", a="count(*)", o="coalesce(value, 0) AS value"))
_add("ts_mean_week", "orders", lambda d: _rounded(profile.time_series(d, "o_orderdate", "week", "o_totalprice")), _TS.format(c="o_orderdate", v="o_totalprice", t="orders", a="avg(v)", o="round(value, 6) AS value"))
_add("ts_running_total", "events", lambda d: _rounded(profile.time_series(d, "ts", "day", "value", "sum", running=True), 4), """
WITH m AS (SELECT date_trunc('day', ts) AS bucket, sum(value) AS v FROM events GROUP BY 1), k AS (SELECT unnest(generate_series((SELECT min(bucket) FROM m), (SELECT max(bucket) FROM m), INTERVAL 1 DAY)) AS bucket)
SELECT k.bucket, round(v, 4) AS value, round(sum(v) OVER (ORDER BY k.bucket), 4) AS running FROM k LEFT JOIN m ON k.bucket = m.bucket""")
_add("ts_by_category", "events", lambda d: _rounded(profile.time_series(d, "ts", "day", "value", "mean", by="event_type", top=3)), """
WITH t AS (SELECT event_type FROM events GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3), r AS (SELECT * FROM events WHERE event_type IN (SELECT event_type FROM t)), m AS (SELECT date_trunc('day', ts) AS bucket, event_type, avg(value) AS v FROM r GROUP BY 1, 2),
k AS (SELECT unnest(generate_series((SELECT min(bucket) FROM m), (SELECT max(bucket) FROM m), INTERVAL 1 DAY)) AS bucket)
SELECT k.bucket, t.event_type AS "group", round(v, 6) AS value FROM k CROSS JOIN t LEFT JOIN m ON k.bucket = m.bucket AND t.event_type = m.event_type""")
_add("time_pairs", "events", lambda d: profile.time_pairs(d, "ts", "event_type", "day", 2), """
WITH t AS (SELECT event_type FROM events GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 2) SELECT date_trunc('day', ts) AS bucket, CASE WHEN event_type IN (SELECT event_type FROM t) THEN event_type ELSE 'Others' END AS value, count(*) AS count FROM events GROUP BY 1, 2""")
_add("corr_pearson", "lineitem", lambda d: _rounded(relations.pearson(d, _NUM)), " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) AS correlation FROM lineitem" for i, a in enumerate(_NUM) for b in _NUM[:i]))
_add("corr_spearman", "part", lambda d: _rounded(relations.spearman(d, ["p_size", "p_retailprice"])), """
WITH r AS (SELECT rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS a, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS b FROM part)
SELECT 'p_retailprice' AS x, 'p_size' AS y, round(corr(a, b), 6) AS correlation FROM r""")
_add("corr_kendall", "part", lambda d: _rounded(relations.kendall(d, ["p_size", "p_retailprice"])), """
WITH s AS (SELECT sum(sign(a.p_size - b.p_size) * sign(a.p_retailprice - b.p_retailprice)) AS k, sum(abs(sign(a.p_size - b.p_size))) AS u, sum(abs(sign(a.p_retailprice - b.p_retailprice))) AS v FROM part a, part b)
SELECT 'p_retailprice' AS x, 'p_size' AS y, round(k / sqrt(CAST(u AS DOUBLE) * v), 6) AS correlation FROM s""")
_add("regression", "lineitem", lambda d: _rounded(relations.regression(d, "l_quantity", "l_extendedprice")), "SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 6) AS intercept, round(corr(l_extendedprice, l_quantity), 6) AS correlation, count(*) AS count FROM lineitem")
_add("influence", "part", lambda d: _rounded(relations.influence(d, "p_size", "p_retailprice", ["p_partkey"]), 9), """
WITH s AS (SELECT count(*) AS n, avg(p_size) AS mu, avg(p_retailprice) AS mv, var_pop(p_size) AS su, var_pop(p_retailprice) AS sv, covar_pop(p_size, p_retailprice) AS c FROM part),
i AS (SELECT p_partkey, c / sqrt(su * sv) - (n * c - n / (n - 1) * (p_size - mu) * (p_retailprice - mv)) / sqrt((n * su - n / (n - 1) * pow(p_size - mu, 2)) * (n * sv - n / (n - 1) * pow(p_retailprice - mv, 2))) AS influence FROM part, s)
SELECT p_partkey, round(influence, 9) AS influence FROM i ORDER BY abs(i.influence) DESC, p_partkey LIMIT 10""")


def _holes(d: DataFrame) -> DataFrame:
    return d.select("l_orderkey", "l_linenumber", F.when(F.col("l_orderkey") % 7 != 0, F.col("l_discount")).alias("a"), F.when(F.col("l_orderkey") % 5 != 0, F.col("l_tax")).alias("b"), F.when(F.col("l_linenumber") != 3, F.col("l_returnflag")).alias("c"))


_HOLES = "WITH d AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 7 <> 0 THEN l_discount END AS a, CASE WHEN l_orderkey % 5 <> 0 THEN l_tax END AS b, CASE WHEN l_linenumber <> 3 THEN l_returnflag END AS c FROM lineitem) "
_add("missing_bars", "lineitem", lambda d: relations.missing_bars(_holes(d)), _HOLES + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS present, count(*) - count({c}) AS missing FROM d" for c in ("l_orderkey", "l_linenumber", "a", "b", "c")))
_add("missing_stats", "lineitem", lambda d: _rounded(relations.missing_stats(_holes(d))), _HOLES + """, k AS (SELECT (a IS NULL)::INT + (b IS NULL)::INT + (c IS NULL)::INT AS k FROM d)
SELECT count(*) AS rows, CAST(sum(k) AS BIGINT) AS missing_cells, count(*) FILTER (k > 0) AS missing_rows, CAST(3 AS BIGINT) AS missing_columns, round(sum(k) / count(*), 6) AS per_row, round(sum(k) / 5, 6) AS per_column FROM k""")
_add("missing_heatmap", "lineitem", lambda d: _rounded(relations.missing_heatmap(_holes(d))), _HOLES + " UNION ALL ".join(f"SELECT '{x}' AS x, '{y}' AS y, round(corr(({x} IS NULL)::INT, ({y} IS NULL)::INT), 6) AS correlation FROM d" for x, y in (("a", "b"), ("a", "c"), ("b", "c"))))
_add("missing_spectrum", "orders", lambda d: relations.missing_spectrum(d.select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("p")), "o_orderkey"), """
WITH d AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS p, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders), b AS (SELECT *, CAST(i // (n // 20) AS INTEGER) AS bin FROM d)
SELECT bin, 'o_orderkey' AS "column", CAST(0 AS BIGINT) AS missing, count(*) AS rows FROM b GROUP BY bin UNION ALL SELECT bin, 'p', count(*) - count(p), count(*) FROM b GROUP BY bin""")
_add("missing_impact", "lineitem", lambda d: relations.missing_impact(_holes(d), "a", "c"), _HOLES + "SELECT c AS value, count(*) AS before, count(a) AS after FROM d WHERE c IS NOT NULL GROUP BY 1")


def _by_flag(d: DataFrame) -> dict[str, DataFrame]:
    return {x: d.where(F.col("l_returnflag") == x).select("l_quantity", "l_linestatus") for x in ("A", "N", "R")}


_add("diff_stats", "lineitem", lambda d: _rounded(relations.diff_stats(_by_flag(d))), """
SELECT l_returnflag AS _src, 'l_quantity' AS "column", count(*) AS rows, CAST(0 AS BIGINT) AS missing, count(DISTINCT l_quantity) AS distinct, round(avg(l_quantity), 6) AS mean FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R') GROUP BY 1
UNION ALL SELECT l_returnflag, 'l_linestatus', count(*), 0, count(DISTINCT l_linestatus), NULL FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R') GROUP BY 1""")
_add("diff_bars", "lineitem", lambda d: relations.diff_bars(_by_flag(d), "l_linestatus"), "SELECT l_linestatus AS value, l_returnflag AS _src, count(*) AS count FROM lineitem WHERE l_linestatus IN (SELECT l_linestatus FROM lineitem WHERE l_returnflag = 'A') AND l_returnflag IN ('A', 'N', 'R') GROUP BY 1, 2")
_add("outlier_mad", "customer", lambda d: _rounded(relations.numeric_outliers(d, "c_acctbal", 1.0).select("c_custkey", "z")), """
WITH m AS (SELECT quantile_cont(c_acctbal, 0.5) AS m FROM customer), a AS (SELECT quantile_cont(abs(c_acctbal - m), 0.5) AS a FROM customer, m), z AS (SELECT c_custkey, 0.6745 * (c_acctbal - m) / a AS z FROM customer, m, a)
SELECT c_custkey, round(z, 6) AS z FROM z WHERE abs(z.z) > 1.0""")
_add("outlier_rare", "orders", lambda d: relations.rare_values(d, "o_custkey", 2), "SELECT CAST(o_custkey AS VARCHAR) AS value, count(*) AS count FROM orders GROUP BY 1 HAVING count(*) <= 2")
_add("word_counts", "conversations", lambda d: profile.word_counts(d, "text"), """
WITH w AS (SELECT unnest(string_split_regex(lower(regexp_replace(text, '[^\\p{L}\\p{M}\\p{N}\\p{Pc}+ ]', ' ', 'g')), ' +')) AS word FROM conversations)
SELECT word, count(*) AS count FROM w WHERE word <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30""")


def _cut(step: str, **params) -> Callable[[DataFrame], DataFrame]:
    return lambda d: text.clean_text(d.select("doc_id", "text"), "text", [{"operator": step, "parameters": params}]).select("doc_id", F.md5("text").alias("digest"))


_WORD = "string_split_regex(trim({}), '\\s+')"
_STOPPED = ", ".join("'" + w.replace("'", "''") + "'" for w in text.STOPWORDS)
_T = "SELECT doc_id, md5({}) AS digest FROM documents"
_add("text_lowercase", "documents", _cut("lowercase"), _T.format("lower(text)"))
_add("text_remove_html", "documents", _cut("remove_html"), _T.format("regexp_replace(text, '<[A-Za-z/][^>]*>|&(?:[a-z0-9]+|#[0-9]{1,6}|#x[0-9a-f]{1,6});', '', 'g')"))
_add("text_remove_punctuation", "documents", _cut("remove_punctuation"), _T.format("regexp_replace(text, '[!-/:-@\\[-`{-~]', ' ', 'g')"))
_add("text_remove_urls", "documents", _cut("remove_urls"), _T.format("regexp_replace(text, '(?:https?://|www\\.)\\S+', '', 'g')"))
_add("text_remove_whitespace", "documents", _cut("remove_whitespace"), _T.format("trim(regexp_replace(text, '[\\n\\t]| {2,}', ' ', 'g'), ' ')"))
_add("text_replace_digits", "documents", _cut("replace_digits", value="#", block=False), _T.format("regexp_replace(text, '\\p{Nd}+', '#', 'g')"))
_add("text_remove_bracketed", "documents", _cut("remove_bracketed", brackets="round"), _T.format("regexp_replace(text, '\\([^()]*\\)', '', 'g')"))
_add("text_uppercase", "part", lambda d: text.clean_text(d.select("p_partkey", "p_type"), "p_type", [{"operator": "lowercase"}, {"operator": "uppercase"}]), "SELECT p_partkey, upper(p_type) AS p_type FROM part")
_add("text_sentence_case", "documents", _cut("sentence_case"), _T.format("upper(substr(text, 1, 1)) || lower(substr(text, 2))"))
_add("text_fillna", "documents", lambda d: text.clean_text(d.select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.lit("kept")).otherwise(F.lit("N/A")).alias("t")), "t", [{"operator": "fillna", "parameters": {"value": "none"}}]), "SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN 'kept' ELSE 'none' END AS t FROM documents")
_add("text_remove_prefixed", "documents", _cut("remove_prefixed", prefix="@"), _T.format("regexp_replace(text, '@\\S+', '', 'g')"))
_add("text_replace_text", "customer", lambda d: text.clean_text(d.select("c_custkey", F.concat(F.lit("the "), F.lower("c_mktsegment"), F.lit(" of furniture makers")).alias("t")), "t", [{"operator": "replace_text", "parameters": {"value": {"furniture": "chair", "make": "x"}}}]), "SELECT c_custkey, 'the ' || replace(lower(c_mktsegment), 'furniture', 'chair') || ' of chair makers' AS t FROM customer")
_add("text_remove_stopwords", "conversations", lambda d: text.clean_text(d.select("conv_id", "turn", "text"), "text", [{"operator": "remove_stopwords"}]).select("conv_id", "turn", F.md5("text").alias("digest")), f"SELECT conv_id, turn, md5(array_to_string(list_filter({_WORD.format('text')}, lambda w: lower(w) NOT IN ({_STOPPED})), ' ')) AS digest FROM conversations")
_add("text_user_function", "customer", lambda d: text.clean_text(d.select("c_custkey", "c_name"), "c_name", [{"operator": lambda c, k: F.right(c, F.lit(k)), "parameters": {"k": 3}}]), "SELECT c_custkey, right(c_name, 3) AS c_name FROM customer")
_NULLS = ", ".join(f"'{x}'" for x in NULL_VALUES)
_add("text_default", "documents", lambda d: text.clean_text(d, "text").select("doc_id", F.md5("text").alias("digest")), f"""
WITH a AS (SELECT doc_id, lower(CASE WHEN text NOT IN ({_NULLS}) THEN text END) AS t FROM documents), b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '\\p{{Nd}}+', '', 'g'), '{text.HTML}', '', 'g') AS t FROM a),
c AS (SELECT doc_id, regexp_replace(regexp_replace(t, '{text.URL}', '', 'g'), '[!-/:-@\\[-`{{-~]', ' ', 'g') AS t FROM b),
d AS (SELECT doc_id, regexp_replace(translate(t, '{text.ACCENTED}', '{text.PLAIN}'), '[^\\x00-\\x7F]', '', 'g') AS t FROM c),
e AS (SELECT doc_id, array_to_string(list_filter({_WORD.format('t')}, lambda w: lower(w) NOT IN ({_STOPPED})), ' ') AS t FROM d)
SELECT doc_id, md5(trim(regexp_replace(t, '[\\n\\t]| {{2,}}', ' ', 'g'), ' ')) AS digest FROM e""")
_add("clean_url", "pages", lambda d: semantic.clean_url(d, "url", split=True).select("page_id", "scheme", "host", "url_clean"), "SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS scheme, regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host, regexp_extract(url, '^(https?://[^?#]*)', 1) AS url_clean FROM pages")
_MAIL = lambda: F.concat(
    F.lit("User"), F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 3 == 0, F.lit(" at ")).otherwise(F.lit("@")), F.lit("Example.COM"))
_add("clean_email", "customer", lambda d: semantic.clean_email(d.select("c_custkey", _MAIL().alias("m")), "m").select("c_custkey", "m_clean"), "SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN 'user' || c_custkey || '@example.com' END AS m_clean FROM customer")
_add("clean_phone", "customer", lambda d: d.select("c_custkey", semantic.phone(F.concat(F.lit("(555) "), F.lpad((F.col("c_custkey") % 1000).cast("string"), 3, "0"), F.lit("-0199")), "e164").alias("p")), "SELECT c_custkey, '+1555' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') || '0199' AS p FROM customer")
_add("clean_ip", "events", lambda d: d.select("event_id", *[semantic.ipv4(F.col("event_id").cast("string"), f).alias(f) for f in ("compressed", "hexa", "integer")]), "SELECT event_id, (event_id >> 24) || '.' || ((event_id >> 16) & 255) || '.' || ((event_id >> 8) & 255) || '.' || (event_id & 255) AS compressed, '0x' || lower(to_hex(event_id)) AS hexa, CAST(event_id AS VARCHAR) AS integer FROM events")
_add("clean_country", "nation", lambda d: country.clean_country(d.select("n_nationkey", F.element_at(F.array(*[F.lit(x) for x in ("NO", "deu", "France", "840", "Atlantis")]), F.col("n_nationkey") % 5 + 1).alias("c")), "c").select("n_nationkey", "c_clean"), "SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'Norway' WHEN 1 THEN 'Germany' WHEN 2 THEN 'France' WHEN 3 THEN 'United States' END AS c_clean FROM nation")
_add("clean_lat_long", "customer", lambda d: latlong.clean_lat_long(d.select("c_custkey", F.concat((F.col("c_custkey") % 100).cast("string"), F.lit(".5, "), (-(F.col("c_custkey") % 170)).cast("string"), F.lit(".25")).alias("p")), "p", split=True).select("c_custkey", "latitude", "longitude"), """
SELECT c_custkey, CASE WHEN c_custkey % 100 < 90 THEN c_custkey % 100 + 0.5::DOUBLE END AS latitude, CASE WHEN c_custkey % 100 < 90 THEN CASE WHEN c_custkey % 170 = 0 THEN 0.25 ELSE -(c_custkey % 170) - 0.25 END::DOUBLE END AS longitude FROM customer""")
_add("clean_amount", "supplier", lambda d: d.select("s_suppkey", semantic.amount(F.concat(F.lit("$"), F.format_number("s_acctbal", 2))).alias("a")), "SELECT s_suppkey, round(s_acctbal, 2) AS a FROM supplier")
_add("clean_date", "orders", lambda d: semantic.clean_date(d.select("o_orderkey", F.date_format("o_orderdate", "d/M/yyyy").alias("t")), "t", "yyyy-MM-dd").select("o_orderkey", "t_clean"), "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS t_clean FROM orders")
_when = lambda pattern: lambda d: d.select("o_orderkey", F.date_format("o_orderdate", pattern).alias("t"))
_add("clean_date_am_pm", "orders", lambda d: semantic.clean_date(d.select("o_orderkey", F.concat(F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit(" 3:07 pm")).alias("t")), "t").select("o_orderkey", "t_clean"), "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || ' 15:07:00' AS t_clean FROM orders")
_add("clean_date_missing_parts", "orders", lambda d: semantic.clean_date(_when("yyyy-M")(d), "t", "yyyy-MM-dd", fix_missing="minimum").select("o_orderkey", "t_clean"), "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') || '-01' AS t_clean FROM orders")
_add("clean_date_zone", "orders", lambda d: semantic.clean_date(_when("yyyy-MM-dd'T'HH:mm:ss")(d), "t", input_timezone="UTC", output_timezone="Asia/Tokyo").select("o_orderkey", "t_clean"), "SELECT o_orderkey, strftime(CAST(date_trunc('second', CAST(o_orderdate AS TIMESTAMP)) AS TIMESTAMP) + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') AS t_clean FROM orders")
_add("validate_date", "orders", lambda d: d.select("o_orderkey", semantic.validate(F.concat_ws("-", F.lit("2023"), (F.col("o_orderkey") % 14).cast("string"), F.lit("10")), "date").alias("ok")), "SELECT o_orderkey, o_orderkey % 14 BETWEEN 1 AND 12 AS ok FROM orders")
_add("validate_email", "customer", lambda d: d.select("c_custkey", semantic.validate(F.concat(F.lit("a."), F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 4 == 0, ".").otherwise(""), F.lit("@host."), F.when(F.col("c_custkey") % 5 == 0, "-x").otherwise("org")), "email").alias("ok")), "SELECT c_custkey, c_custkey % 4 <> 0 AND c_custkey % 5 <> 0 AS ok FROM customer")
_add("validate_url", "pages", lambda d: d.select("page_id", semantic.validate(F.concat(F.when(F.col("page_id") % 3 == 0, "ftp").otherwise("https"), F.lit("://example.org/"), F.col("page_id").cast("string")), "url").alias("ok")), "SELECT page_id, page_id % 3 <> 0 AS ok FROM pages")
_add("validate_ip", "events", lambda d: d.select("event_id", semantic.validate(F.concat(F.lit("10.0."), (F.col("event_id") % 300).cast("string"), F.lit(".7")), "ip").alias("ok")), "SELECT event_id, event_id % 300 < 256 AS ok FROM events")
_add("clean_ipv6", "events", lambda d: d.select("event_id", *[semantic.ipv6(F.concat(F.lit("2001:0DB8::"), F.hex(F.col("event_id") % 65536), F.lit(":1")), f).alias(f) for f in ("compressed", "full")]), "SELECT event_id, '2001:db8::' || CASE WHEN event_id % 65536 = 0 THEN '1' ELSE lower(to_hex(event_id % 65536)) || ':1' END AS compressed, '2001:0db8:0000:0000:0000:0000:' || lpad(lower(to_hex(event_id % 65536)), 4, '0') || ':0001' AS full FROM events")
_add("validate_phone", "customer", lambda d: d.select("c_custkey", semantic.validate(F.concat((F.col("c_custkey") % 9 + 1).cast("string"), F.lit("55-123-4567")), "phone").alias("ok")), "SELECT c_custkey, c_custkey % 9 >= 1 AS ok FROM customer")
_add("lat_long_minutes", "customer", lambda d: latlong.clean_lat_long(d.select("c_custkey", F.concat((F.col("c_custkey") % 80).cast("string"), F.lit("° 30′ N, "), (F.col("c_custkey") % 170).cast("string"), F.lit("° 15′ W")).alias("p")), "p", output_format="ddh").select("c_custkey", F.col("p_clean.lat").alias("lat"), F.col("p_clean.long").alias("long")), "SELECT c_custkey, (c_custkey % 80) || '.5° N' AS lat, (c_custkey % 170) || '.25° W' AS long FROM customer")
_add("lat_long_two_columns", "customer", lambda d: latlong.clean_lat_long(d.select("c_custkey", (F.col("c_custkey") % 120).cast("string").alias("a"), F.lit("-7.5").alias("b")), ("a", "b"), split=True).select("c_custkey", "latitude", "longitude"), "SELECT c_custkey, CASE WHEN c_custkey % 120 <= 90 THEN (c_custkey % 120)::DOUBLE END AS latitude, CASE WHEN c_custkey % 120 <= 90 THEN -7.5::DOUBLE END AS longitude FROM customer")
_add("flatten_json", "events", lambda d: semantic.flattened_json(d.select("event_id", "props"), "props", "k long").select("event_id", "k"), "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
_add("dedupe_fingerprint", "part", lambda d: d.select(prepare.fingerprint(F.col("p_name")).alias("f")).groupBy("f").agg(F.count("*").alias("n")), "SELECT array_to_string(list_sort(list_distinct(list_filter(string_split_regex(regexp_replace(lower(trim(p_name)), '[[:punct:][:cntrl:]]', '', 'g'), '\\s+'), lambda w: w <> ''))), ' ') AS f, count(*) AS n FROM part GROUP BY 1")
_add("near_values", "part", lambda d: prepare.near_values(d, "p_name", 3, 3), "WITH v AS (SELECT DISTINCT p_name AS v FROM part) SELECT a.v AS a, b.v AS b, CAST(levenshtein(a.v, b.v) AS INTEGER) AS distance FROM v a JOIN v b ON a.v < b.v WHERE levenshtein(a.v, b.v) <= 3 AND len(list_intersect(list_transform(generate_series(1, greatest(length(a.v) - 2, 1)), lambda i: substr(a.v, i, 3)), list_transform(generate_series(1, greatest(length(b.v) - 2, 1)), lambda i: substr(b.v, i, 3)))) > 0")
_add("clean_duplication", "part", lambda d: prepare.cluster_by_key(d.select(F.concat("p_type", F.when(F.col("p_partkey") % 2 == 0, ".").otherwise("")).alias("t")), "t", prepare.ngram_fingerprint(F.col("value"))).select("key", "size"), """
WITH p AS (SELECT p_type || CASE WHEN p_partkey % 2 = 0 THEN '.' ELSE '' END AS p FROM part), v AS (SELECT DISTINCT p AS v, regexp_replace(lower(p), '[[:punct:][:cntrl:]\\s]', '', 'g') AS t FROM p),
k AS (SELECT v, CASE WHEN len(t) < 2 THEN t ELSE array_to_string(list_sort(list_distinct(list_transform(generate_series(1, len(t) - 1), lambda i: t[i:i + 1]))), '') END AS key FROM v)
SELECT key, CAST(count(*) AS INTEGER) AS size FROM k GROUP BY 1 HAVING count(*) > 1""")
_add("ml_scale", "supplier", lambda d: _rounded(prepare.Prepare("s_suppkey").fit(d).transform(d).select("s_suppkey", "s_acctbal")), "SELECT s_suppkey, round((s_acctbal - avg(s_acctbal) OVER ()) / stddev_samp(s_acctbal) OVER (), 6) AS s_acctbal FROM supplier")
_add("ml_minmax", "supplier", lambda d: _rounded(prepare.Prepare("s_suppkey", num_scaling="minmax").fit(d).transform(d).select("s_suppkey", "s_acctbal")), "SELECT s_suppkey, round((s_acctbal - min(s_acctbal) OVER ()) / (max(s_acctbal) OVER () - min(s_acctbal) OVER ()), 6) AS s_acctbal FROM supplier")
_gaps = lambda d: d.select("s_suppkey", F.when(F.col("s_suppkey") % 4 != 0, F.col("s_acctbal")).alias("v"), F.when(F.col("s_suppkey") % 4 == 1, "b").when(F.col("s_suppkey") % 4 > 1, "a").alias("w"), F.lit(1.0).alias("flat"))
_add("ml_impute_median", "supplier", lambda d: _rounded(prepare.Prepare("s_suppkey", num_imputation="median", num_scaling="none").fit(_gaps(d)).transform(_gaps(d)).select("s_suppkey", "v")), "WITH g AS (SELECT s_suppkey, CASE WHEN s_suppkey % 4 <> 0 THEN s_acctbal END AS v FROM supplier) SELECT s_suppkey, round(coalesce(v, (SELECT quantile_cont(v, 0.5) FROM g)), 6) AS v FROM g")
_add("ml_impute_mode", "supplier", lambda d: prepare.Prepare("s_suppkey", cat_imputation="most_frequent", cat_encoding="none").fit(_gaps(d)).transform(_gaps(d)).select("s_suppkey", "w"), "SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 1 THEN 'b' ELSE 'a' END AS w FROM supplier")
_add("ml_variance", "supplier", lambda d: d.sparkSession.createDataFrame([(c,) for c in prepare.Prepare("s_suppkey", variance=0.0).fit(_gaps(d)).transform(_gaps(d)).columns], "kept string"), "SELECT unnest(['s_suppkey', 'v', 'w']) AS kept")
_add("merge_values", "customer", lambda d: prepare.merge_values(d.select("c_custkey", "c_mktsegment"), "c_mktsegment", {"BUILDING": "HOUSE"}), "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'HOUSE' ELSE c_mktsegment END AS c_mktsegment FROM customer")
_add("ml_one_hot", "customer", lambda d: prepare.Prepare("c_custkey").fit(d.select("c_custkey", "c_mktsegment")).transform(d.select("c_custkey", "c_mktsegment")).select("c_custkey", F.array_join(F.transform("c_mktsegment", lambda x: x.cast("int").cast("string")), "").alias("c")), """
WITH v AS (SELECT list_sort(list(DISTINCT c_mktsegment)) AS v FROM customer) SELECT c_custkey, array_to_string(list_transform(v, lambda x: CASE WHEN x = c_mktsegment THEN '1' ELSE '0' END), '') AS c FROM customer, v""")
_add("corr_top", "lineitem", lambda d: _rounded(relations.strongest(relations.pearson(d.select(*_NUM)), 2)), "WITH c AS (" + " UNION ALL ".join(f"SELECT '{y}' AS x, '{x}' AS y, corr({x}, {y}) AS correlation FROM lineitem" for i, x in enumerate(_NUM) for y in _NUM[i + 1 :]) + ") SELECT x, y, round(correlation, 6) AS correlation FROM c ORDER BY abs(correlation) DESC LIMIT 2")
_add("corr_range", "lineitem", lambda d: _rounded(relations.strongest(relations.pearson(d.select(*_NUM)), limits=(0.5, 1.0))), "WITH c AS (" + " UNION ALL ".join(f"SELECT '{y}' AS x, '{x}' AS y, corr({x}, {y}) AS correlation FROM lineitem" for i, x in enumerate(_NUM) for y in _NUM[i + 1 :]) + ") SELECT x, y, round(correlation, 6) AS correlation FROM c WHERE correlation BETWEEN 0.5 AND 1")
_add("corr_one_to_all", "lineitem", lambda d: _rounded(relations.against_all(relations.pearson(d.select(*_NUM)), "l_tax")), " UNION ALL ".join(f"SELECT '{x}' AS \"column\", round(corr(l_tax, {x}), 6) AS correlation FROM lineitem" for x in _NUM if x != "l_tax"))
_add("time_profile", "orders", lambda d: profile.time_profile(d, "o_orderdate"), "SELECT count(*) AS count, count(*) - count(o_orderdate) AS missing, count(DISTINCT o_orderdate) AS distinct, CAST(min(o_orderdate) AS VARCHAR)[1:10] AS first, CAST(max(o_orderdate) AS VARCHAR)[1:10] AS last FROM orders")
_add("top_groups_with_ties", "customer", lambda d: profile.top_groups(d, "c_nationkey", 3), "WITH c AS (SELECT CAST(c_nationkey AS VARCHAR) AS value, count(*) AS count FROM customer GROUP BY 1), r AS (SELECT *, rank() OVER (ORDER BY count DESC) AS r FROM c) SELECT value, count FROM r WHERE r <= 3")
_add("joined_values", "nation", lambda d: profile.joined_values(d, "n_regionkey", "n_name"), "SELECT CAST(n_regionkey AS VARCHAR) AS value, string_agg(n_name, ',' ORDER BY n_name) AS joined FROM (SELECT DISTINCT n_regionkey, n_name FROM nation) GROUP BY 1")
_add("missing_impact_all", "lineitem", lambda d: _rounded(relations.missing_impact_all(_holes(d), "a")), _HOLES + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS before, count({c}) FILTER (a IS NOT NULL) AS after FROM d" for c in ("l_orderkey", "l_linenumber", "b", "c")))
_add("star_clusters", "part", lambda d: prepare.star_clusters(d, "p_name", 3, 3), """
WITH v AS (SELECT DISTINCT p_name AS v FROM part), g AS (SELECT v, CASE WHEN len(v) > 3 THEN list_distinct(list_transform(generate_series(1, len(v) - 2), lambda i: v[i:i + 2])) ELSE [v] END AS g FROM v),
n AS (SELECT a.v AS centre, b.v AS value FROM g a JOIN g b ON a.v <> b.v AND levenshtein(a.v, b.v) <= 3 AND len(list_intersect(a.g, b.g)) > 0), m AS (SELECT * FROM n UNION SELECT centre, centre FROM n),
c AS (SELECT centre, list_sort(list(value)) AS members FROM m GROUP BY 1) SELECT cluster, unnest(members) AS value FROM (SELECT min(centre) AS cluster, members FROM c GROUP BY members)""")
_add("most_missing", "lineitem", lambda d: relations.most_missing(_holes(d), ["l_orderkey", "l_linenumber"]), _HOLES + """, m AS (SELECT l_orderkey || ',' || l_linenumber AS name, CAST((a IS NULL)::INT + (b IS NULL)::INT + (c IS NULL)::INT AS BIGINT) AS missing FROM d),
r AS (SELECT 'row' AS kind, name, missing FROM m WHERE missing > 0 ORDER BY missing DESC, name LIMIT 5) SELECT * FROM r UNION ALL SELECT 'column', 'a', count(*) - count(a) FROM d UNION ALL SELECT 'column', 'b', count(*) - count(b) FROM d UNION ALL SELECT 'column', 'c', count(*) - count(c) FROM d""")
_add("diff_times", "orders", lambda d: relations.diff_times({x: d.where(F.col("o_orderstatus") == x) for x in ("F", "O")}, "o_orderdate", "month"), "SELECT o_orderstatus AS _src, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS bucket, count(*) AS count FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1, 2")
_add("memory_estimate", "customer", lambda d: report.memory_estimate(d.select("c_name", "c_acctbal")), "SELECT 'c_name' AS \"column\", CAST(sum(strlen(c_name)) AS BIGINT) AS bytes FROM customer UNION ALL SELECT 'c_acctbal', 8 * count(*) FROM customer")
_add("plot_text_and_text", "orders", lambda d: report.plot(d, "o_orderpriority", "o_orderstatus")["counts"].select("x", "y", "count"), "SELECT o_orderpriority AS x, o_orderstatus AS y, count(*) AS count FROM orders GROUP BY 1, 2")
_add("plot_number_and_number", "lineitem", lambda d: _rounded(report.plot(d, "l_quantity", "l_extendedprice")["regression"]), ORACLES["regression"])
_add("plot_three", "events", lambda d: _rounded(report.plot(d.withColumn("ts", F.date_trunc("day", "ts")), "value", "event_type", "ts")["series"].groupBy("group").agg(F.count("value").alias("buckets"))), """
WITH e AS (SELECT date_trunc('day', ts) AS d, event_type, value FROM events), u AS (SELECT epoch(max(d)) - epoch(min(d)) AS s FROM e),
w AS (SELECT unit FROM (VALUES ('year', 31557600, 1), ('quarter', 7889400, 2), ('month', 2629800, 3), ('week', 604800, 4), ('day', 86400, 5), ('hour', 3600, 6), ('minute', 60, 7), ('second', 1, 8)) AS t(unit, size, k), u ORDER BY abs(greatest(s, 1) / size - 10), k LIMIT 1),
t AS (SELECT event_type FROM e GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10)
SELECT event_type AS "group", count(DISTINCT CASE (SELECT unit FROM w) WHEN 'week' THEN date_trunc('week', d + INTERVAL 1 DAY) ELSE date_trunc((SELECT unit FROM w), d) END) AS buckets FROM e WHERE value IS NOT NULL AND event_type IN (SELECT event_type FROM t) GROUP BY 1""")
_add("report_missing", "lineitem", lambda d: report.create_report(_holes(d))["missing"], ORACLES["missing_bars"])
_add("diff_report", "lineitem", lambda d: _rounded(report.create_diff_report(_by_flag(d))["statistics"]), ORACLES["diff_stats"])
_add("drop_duplicates", "documents", lambda d: d.select("text").distinct().select(F.md5("text").alias("digest")), "SELECT DISTINCT md5(text) AS digest FROM documents")
_add("downcast", "lineitem", lambda d: prepare.downcast(d.select("l_linenumber", "l_orderkey")).agg(F.max(F.typeof("l_linenumber")).alias("a"), F.sum("l_linenumber").alias("s")), "SELECT 'tinyint' AS a, CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem")
_add("insights", "lineitem", profile.insights)


def _ident(name: str, made: Callable[[], Column], sql: str) -> None:
    _add(f"id_{name}", "orders", lambda d: d.select("o_orderkey", identifiers.validate(name, made()).alias("ok")), sql)


def _changed(number: str) -> str:
    return number[:-1] + ("0" if number[-1] != "0" else "1")


_CASES = [(n, x) for n, v in VALID.items() for x in (v, _changed(v))]
_add(
    "id_examples", "region",
    lambda d: d.limit(1).select(F.explode(F.array(*[F.struct(F.lit(n).alias("kind"), F.lit(x).alias("number"), identifiers.validate(n, F.lit(x)).alias("ok")) for n, x in _CASES])).alias("c")).select("c.*"),
    "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{x}', {str(x == VALID[n]).lower()})" for n, x in _CASES) + ") AS t(kind, number, ok)",
)
_N16 = lambda: F.lpad(
    (F.col("o_orderkey") * 7919 + 40000000000000).cast("string"), 15, "0")
_ident("imei", _N16, """
WITH n AS (SELECT o_orderkey, lpad(CAST(o_orderkey * 7919 + 40000000000000 AS VARCHAR), 15, '0') AS c FROM orders)
SELECT o_orderkey, list_sum(list_transform(generate_series(1, 15), lambda i: CASE WHEN i % 2 = 1 THEN CAST(c[i] AS INT) ELSE (CAST(c[i] AS INT) * 2) // 10 + (CAST(c[i] AS INT) * 2) % 10 END)) % 10 = 0 AS ok FROM n""")
_ident("ean", lambda: F.lpad((F.col("o_orderkey") * 7919 + 4000000000000).cast("string"), 13, "0"), """
WITH n AS (SELECT o_orderkey, lpad(CAST(o_orderkey * 7919 + 4000000000000 AS VARCHAR), 13, '0') AS c FROM orders)
SELECT o_orderkey, list_sum(list_transform(generate_series(1, 13), lambda i: CAST(c[i] AS INT) * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END)) % 10 = 0 AS ok FROM n""")
_ident("be_vat", lambda: F.lpad((F.col("o_orderkey") * 37 + 400000000).cast("string"), 10, "0"), """
WITH n AS (SELECT o_orderkey, lpad(CAST(o_orderkey * 37 + 400000000 AS VARCHAR), 10, '0') AS c FROM orders) SELECT o_orderkey, 97 - CAST(c[1:8] AS BIGINT) % 97 = CAST(c[9:10] AS BIGINT) AS ok FROM n""")
_ident("iban", lambda: F.concat(F.lit("DE"), F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0"), F.lpad((F.col("o_orderkey") * 104729).cast("string"), 18, "0")), """
WITH n AS (SELECT o_orderkey, lpad(CAST(o_orderkey * 104729 AS VARCHAR), 18, '0') || '1314' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') AS c FROM orders) SELECT o_orderkey, CAST(c AS HUGEINT) % 97 = 1 AS ok FROM n""")
_ident("issn", lambda: F.lpad((F.col("o_orderkey") * 13).cast("string"), 8, "0"), """
WITH n AS (SELECT o_orderkey, lpad(CAST(o_orderkey * 13 AS VARCHAR), 8, '0') AS c FROM orders) SELECT o_orderkey, list_sum(list_transform(generate_series(1, 8), lambda i: CAST(c[i] AS INT) * (9 - i))) % 11 = 0 AS ok FROM n""")

