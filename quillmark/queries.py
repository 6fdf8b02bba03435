"""Queries over the driver's tables, one or more for each operator, and their SQL.

Stand-ins: a lineitem is an observation (section p_type, topic p_brand, year of shipping, difficulty by return flag, confidence from its discount); orders by
priority and year are series; a user's events are a paper; documents are question texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import fixed, matching as mt, normalize as nz, text as tx
from .operators import allocate as al
from .operators import evaluate as ev
from .operators import extract as ex
from .operators import features as ft
from .operators import frequency as fq
from .operators import mining as mn
from .operators import rank as rk
from .operators import sequence as sq
from .operators import similarity as sm
from .operators import trend as tr
from .plans import models as pm
from .plans import study as st
from .sources import readers as rd
from .sources import writers as wr
from .streaming import live

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Register the decorated (spark, sf_dir) -> DataFrame under its own name, with its SQL if it has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """obs_id, section, topic, year, difficulty, confidence."""
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    level = F.when(F.col("l_returnflag") == "A", "easy").when(F.col("l_returnflag") == "N", "medium").otherwise("hard")
    return j.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("obs_id"), F.col("p_type").alias("section"), F.col("p_brand").alias("topic"), F.year("l_shipdate").alias("year"), level.alias("difficulty"), (F.lit(1.0) - F.col("l_discount")).alias("confidence"))


OBS = """WITH obs AS (SELECT l_orderkey * 10 + l_linenumber AS obs_id, p_type AS section, p_brand AS topic, year(l_shipdate) AS year,
 CASE l_returnflag WHEN 'A' THEN 'easy' WHEN 'N' THEN 'medium' ELSE 'hard' END AS difficulty, 1.0 - l_discount AS confidence FROM lineitem JOIN part ON l_partkey = p_partkey) """


def order_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """topic (priority), year, cnt of orders."""
    o = table(spark, sf_dir, "orders")
    return fq.counts(o.select(F.col("o_orderpriority").alias("topic"), F.year("o_orderdate").alias("year")), "topic", "year")


SERIES = "WITH series AS (SELECT o_orderpriority AS topic, year(o_orderdate) AS year, count(*) AS cnt FROM orders GROUP BY ALL) "


def customer_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """topic (nation), year, cnt: 25 series."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return fq.counts(o.select(F.col("c_nationkey").alias("topic"), F.year("o_orderdate").alias("year")), "topic", "year")


NATION = "WITH series AS (SELECT c_nationkey AS topic, year(o_orderdate) AS year, count(*) AS cnt FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) "
GRID = ", grid AS (SELECT t.topic, y.year, coalesce(s.cnt, 0) AS cnt FROM (SELECT DISTINCT topic FROM series) t CROSS JOIN (SELECT DISTINCT year FROM series) y LEFT JOIN series s ON s.topic = t.topic AND s.year = y.year) "


def paper_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, qnum (by time), section (event type), confidence (k / 100), page."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("qnum"), F.col("event_type").alias("section"), (k / 100.0).alias("confidence"), F.col("event_id"))


PAPER = "WITH paper AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS qnum, event_type AS section, CAST(json_extract_string(props, '$.k') AS INT) / 100.0 AS confidence, event_id FROM events) "


def r(df: DataFrame, *columns: str, n: int = 6) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.round(c, n))
    return df


# --- counts and shares ---
@query(OBS + """, c AS (SELECT section, topic, year, count(*) AS cnt FROM obs GROUP BY ALL),
s AS (SELECT section, topic, year, cnt * 100.0 / sum(cnt) OVER (PARTITION BY year) AS share FROM c)
SELECT section, topic, count(*) AS n, round(regr_slope(share, year), 8) AS slope, round(avg(share), 8) AS mean_share FROM s GROUP BY section, topic HAVING count(*) >= 3 ORDER BY slope DESC, section, topic LIMIT 10""")
def topic_trend_linreg(spark, sf_dir):
    s = fq.share(fq.counts(observations(spark, sf_dir), "section", "topic", "year"), "cnt", ["year"])
    g = s.groupBy("section", "topic").agg(F.count("*").alias("n"), F.round(F.regr_slope("share", "year"), 8).alias("slope"), F.round(F.avg("share"), 8).alias("mean_share")).filter("n >= 3")
    return rk.latest(g, [F.desc("slope"), F.col("section"), F.col("topic")], 10)


@query(OBS + "SELECT year, topic, count(*) AS cnt FROM obs GROUP BY ALL")
def count_by_year_topic(spark, sf_dir):
    return fq.counts(observations(spark, sf_dir), "year", "topic")


@query(OBS + "SELECT section, topic, count(*) AS cnt FROM obs GROUP BY ALL")
def count_by_section_topic(spark, sf_dir):
    return fq.counts(observations(spark, sf_dir), "section", "topic")


@query(OBS + "SELECT year, section, topic, count(*) AS cnt FROM obs GROUP BY ALL")
def prediction_format(spark, sf_dir):
    return fq.counts(observations(spark, sf_dir), "year", "section", "topic")


@query(OBS + ", l AS (SELECT topic, arg_max(section, obs_id) AS section FROM obs GROUP BY topic) SELECT o.topic, o.year, l.section, count(*) AS cnt FROM obs o JOIN l USING (topic) GROUP BY ALL")
def topic_years_last_section(spark, sf_dir):
    return fq.topic_years(observations(spark, sf_dir), "topic", "year", "section", "obs_id")


@query(OBS + "SELECT topic, year, count(*) AS cnt, round(avg(CASE difficulty WHEN 'easy' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END), 10) AS avg_level FROM obs GROUP BY topic, year")
def topic_history_avg_level(spark, sf_dir):
    return r(fq.level_history(observations(spark, sf_dir), ["topic", "year"], F.col("difficulty")), "avg_level", n=10)


@query(OBS + "SELECT topic, section, count(*) AS cnt, round(avg(confidence), 10) AS avg_confidence FROM obs GROUP BY ALL")
def topic_list_confidence(spark, sf_dir):
    return r(fq.topic_list(observations(spark, sf_dir), "topic", "section", "confidence"), "avg_confidence", n=10)


@query(OBS + """SELECT CASE grouping_id(difficulty, section) WHEN 3 THEN 'all' WHEN 1 THEN 'difficulty' ELSE 'section' END AS part, CASE grouping_id(difficulty, section) WHEN 1 THEN difficulty WHEN 2 THEN section END AS value,
count(*) AS cnt, count(DISTINCT topic) AS n_topics, count(DISTINCT year) AS n_years FROM obs GROUP BY GROUPING SETS ((), (difficulty), (section))""")
def bank_statistics_grouping_sets(spark, sf_dir):
    return fq.bank_statistics(observations(spark, sf_dir), "topic", "year", "difficulty", "section")


@query(OBS + "SELECT d.difficulty, coalesce(c.cnt, 0) AS cnt FROM (VALUES ('easy'), ('medium'), ('hard'), ('unknown')) d(difficulty) LEFT JOIN (SELECT difficulty, count(*) AS cnt FROM obs GROUP BY 1) c USING (difficulty)")
def difficulty_zero_filled(spark, sf_dir):
    return fq.filled_counts(observations(spark, sf_dir), "difficulty", ["easy", "medium", "hard", "unknown"])


@query(OBS + """, p AS (SELECT section, topic, count(*) AS cnt, count(*) FILTER (difficulty = 'easy') AS n_easy, count(*) FILTER (difficulty = 'medium') AS n_medium, count(*) FILTER (difficulty = 'hard') AS n_hard FROM obs GROUP BY ALL),
f AS (SELECT section, topic, obs_id, row_number() OVER (PARTITION BY section, topic ORDER BY obs_id) AS rn FROM obs), s AS (SELECT section, topic, string_agg(CAST(obs_id AS VARCHAR), '|' ORDER BY rn) AS samples FROM f WHERE rn <= 3 GROUP BY ALL)
SELECT * FROM p JOIN s USING (section, topic)""")
def difficulty_pivot_first3_samples(spark, sf_dir):
    return fq.simple_format(observations(spark, sf_dir), ["section", "topic"], "difficulty", ["easy", "medium", "hard"], "obs_id", F.col("obs_id").cast("string"))


@query(OBS + ", c AS (SELECT difficulty, count(*) AS cnt FROM obs GROUP BY 1) SELECT difficulty, cnt, round(cnt * 100.0 / sum(cnt) OVER (), 1) AS pct FROM c")
def percent_distribution(spark, sf_dir):
    return fq.percentages(observations(spark, sf_dir), "difficulty")


@query(OBS + ", c AS (SELECT difficulty, count(*) AS cnt, avg(confidence) AS a FROM obs GROUP BY 1) SELECT difficulty, coalesce(cnt, 0) AS cnt, round(coalesce(a, 0), 10) AS avg_confidence, round(coalesce(cnt, 0) * 100.0 / sum(cnt) OVER (), 6) AS pct FROM (VALUES ('easy'), ('medium'), ('hard'), ('none')) d(difficulty) LEFT JOIN c USING (difficulty)")
def difficulty_statistics(spark, sf_dir):
    return r(fq.level_statistics(observations(spark, sf_dir), "difficulty", "confidence", ["easy", "medium", "hard", "none"]), "pct").withColumn("avg_confidence", F.round("avg_confidence", 10))


@query(OBS + ", c AS (SELECT year, topic, count(*) AS cnt FROM obs GROUP BY ALL), s AS (SELECT topic, cnt * 100.0 / sum(cnt) OVER (PARTITION BY year) AS share FROM c) SELECT topic, round(avg(share), 8) AS mean_share FROM s GROUP BY topic ORDER BY mean_share DESC, topic LIMIT 10")
def share_per_100_top10(spark, sf_dir):
    s = fq.share(fq.counts(observations(spark, sf_dir), "year", "topic"), "cnt", ["year"])
    return r(fq.mean_share_top(s, "topic", "share"), "mean_share", n=8)


@query(OBS + "SELECT year, count(*) AS cnt, greatest(1, CAST(round_even(count(*) / 100, 0) AS INT)) AS shifts, round(count(*) / greatest(1, CAST(round_even(count(*) / 100, 0) AS INT)), 2) AS per_shift FROM obs GROUP BY year")
def est_shifts(spark, sf_dir):
    return fq.estimated_shifts(observations(spark, sf_dir), "year")


@query(OBS + "SELECT min(year) AS first_year, max(year) AS last_year, count(DISTINCT year) AS n_years FROM obs")
def year_range(spark, sf_dir):
    return fq.year_range(observations(spark, sf_dir), "year")


@query("SELECT min(doc_id) AS doc_id, count(*) AS n_copies FROM documents GROUP BY md5(trim(regexp_replace(lower(text), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')))")
def md5_dedupe(spark, sf_dir):
    return fq.distinct_questions(table(spark, sf_dir, "documents").select("doc_id", "text"), tx.text_key(F.col("text")), "doc_id").select("doc_id", "n_copies")


@query("SELECT item_id FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.text = b.text)")
def new_questions_anti(spark, sf_dir):
    return fq.new_questions(table(spark, sf_dir, "documents").select("text"), table(spark, sf_dir, "benchmark"), lambda x: F.md5(x["text"])).select("item_id")


# --- series ---
@query(SERIES + """, o AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY year DESC) AS b, count(*) OVER (PARTITION BY topic) AS n FROM series),
g AS (SELECT topic, sum(cnt) AS total, avg(cnt) AS a, max(year) AS last_year, avg(cnt) FILTER (b <= 2) AS r, avg(cnt) FILTER (b > 2) AS o, max(n) AS n, count(*) AS streak FROM o GROUP BY topic),
h AS (SELECT *, CASE WHEN n >= 3 AND o > 0 THEN (r - o) / o ELSE 0.0 END AS t FROM g)
SELECT topic, CAST(total AS BIGINT) AS total, round(a, 6) AS avg, last_year, round(t, 6) AS trend_ratio, CASE WHEN t > 0.15 THEN 'rising' WHEN t < -0.15 THEN 'declining' ELSE 'stable' END AS trend, CAST(streak AS INT) AS streak FROM h""")
def series_stats(spark, sf_dir):
    return r(ft.series_stats(order_series(spark, sf_dir), ["topic"]), "avg", "trend_ratio")


@query(NATION + GRID + "SELECT * FROM grid")
def dense_series(spark, sf_dir):
    return fq.dense(customer_series(spark, sf_dir), ["topic"])


@query(NATION + """, o AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY year) - 1 AS x, row_number() OVER (PARTITION BY topic ORDER BY year DESC) AS b FROM series WHERE year >= 1992),
g AS (SELECT topic, avg(cnt) AS a, avg(cnt) FILTER (b <= 2) AS r, regr_slope(cnt, x) AS s, count(*) AS n, max(year) AS ly, stddev_pop(cnt) AS sd, max(cnt) AS hi, min(cnt) AS lo, list(cnt ORDER BY year) FILTER (b <= 5) AS v FROM o GROUP BY topic)
SELECT topic, round(a, 6) AS avg, round(r, 6) AS recent, round(CASE WHEN n >= 3 THEN s ELSE 0 END, 6) AS trend, 2002 - ly AS since_last, CAST(n AS INT) AS streak, round(sd, 6) AS std, hi, lo, coalesce(v[1], 0) AS last1, coalesce(v[2], 0) AS last2, coalesce(v[3], 0) AS last3, coalesce(v[4], 0) AS last4, coalesce(v[5], 0) AS last5 FROM g""")
def features13_sparse(spark, sf_dir):
    return r(ft.features13(customer_series(spark, sf_dir), ["topic"], 2002, slope=True), "avg", "recent", "trend", "std")


@query(NATION + """, sh AS (SELECT topic, year, cnt * 100.0 / sum(cnt) OVER (PARTITION BY year) AS share FROM series), o AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY year DESC) AS b, year - row_number() OVER (PARTITION BY topic ORDER BY year) AS i FROM sh),
ru AS (SELECT topic, arg_max(n, e) AS run FROM (SELECT topic, i, count(*) AS n, max(year) AS e FROM o GROUP BY ALL) GROUP BY topic),
g AS (SELECT topic, avg(share) AS a, avg(share) FILTER (b <= 2) AS r, regr_slope(share, year) AS s, regr_slope(share, year) FILTER (b <= 3) AS l, count(*) AS n, max(year) AS ly, stddev_pop(share) AS sd, max(share) AS hi, min(share) AS lo, list(share ORDER BY year) FILTER (b <= 4) AS v FROM o GROUP BY topic),
h AS (SELECT *, CASE WHEN n >= 2 THEN coalesce(s, 0) ELSE 0 END AS os FROM g), k AS (SELECT *, CASE WHEN n >= 3 THEN coalesce(l, 0) ELSE os END AS ls FROM h)
SELECT topic, round(a, 6) AS avg, round(r, 6) AS recent, round(os, 6) AS slope, 2002 - ly AS since_last, run, round(sd, 6) AS std, round(hi, 6) AS hi, round(lo, 6) AS lo, round(ls, 6) AS late_slope, round(ls - os, 6) AS acceleration, n AS n_years, round(coalesce(v[1], 0), 6) AS last1, round(coalesce(v[2], 0), 6) AS last2, round(coalesce(v[3], 0), 6) AS last3, round(coalesce(v[4], 0), 6) AS last4 FROM k JOIN ru USING (topic)""")
def features15_norm(spark, sf_dir):
    s = fq.share(customer_series(spark, sf_dir), "cnt", ["year"])
    return r(ft.features15(s, ["topic"], 2002), "avg", "recent", "slope", "std", "hi", "lo", "late_slope", "acceleration", "last1", "last2", "last3", "last4")


@query(NATION + GRID + """, o AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY year) - 1 AS x, row_number() OVER (PARTITION BY topic ORDER BY year DESC) AS b FROM grid)
SELECT topic, round(avg(cnt), 6) AS avg, round(avg(cnt) FILTER (b <= 2), 6) AS recent, round(regr_slope(cnt, x), 6) AS slope, round(stddev_pop(cnt), 6) AS std, max(cnt) AS hi, min(cnt) AS lo, count(*) FILTER (cnt > 0) AS n_present, round((arg_max(cnt, year) - arg_min(cnt, year)) / greatest(arg_min(cnt, year), 1), 6) AS growth FROM o GROUP BY topic""")
def features8_dense(spark, sf_dir):
    return r(ft.features8(fq.dense(customer_series(spark, sf_dir), ["topic"]), ["topic"]), "avg", "recent", "slope", "std", "growth")


@query(NATION + GRID + """, o AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY year) - 1 AS x, row_number() OVER (PARTITION BY topic ORDER BY year DESC) AS b, count(*) OVER (PARTITION BY topic) AS n FROM grid)
SELECT topic, round(regr_slope(cnt, x), 6) AS slope, round(avg(cnt) FILTER (b <= 3), 6) AS ma3, round(sum(cnt * CASE WHEN x = 0 THEN pow(0.7, n - 1) ELSE 0.3 * pow(0.7, n - 1 - x) END), 6) AS ema, round(abs(avg(cnt) FILTER (x % 2 = 0) - avg(cnt) FILTER (x % 2 = 1)), 6) AS alternation, arg_max(cnt, year) AS last, count(*) AS n FROM o GROUP BY topic""")
def temporal_features(spark, sf_dir):
    return r(ft.temporal_features(fq.dense(customer_series(spark, sf_dir), ["topic"]), ["topic"]), "slope", "ma3", "ema", "alternation")


@query(SERIES + "SELECT topic, year, cnt, round(avg(cnt) OVER (PARTITION BY topic ORDER BY year ROWS 2 PRECEDING), 6) AS ma3 FROM series")
def moving_avg3(spark, sf_dir):
    return r(ft.moving_mean(order_series(spark, sf_dir), ["topic"]), "ma3")


@query(NATION + ", o AS (SELECT topic, year, year - row_number() OVER (PARTITION BY topic ORDER BY year) AS i FROM series), g AS (SELECT topic, i, count(*) AS n, max(year) AS e FROM o GROUP BY ALL) SELECT topic, arg_max(n, e) AS run FROM g GROUP BY topic")
def consecutive_year_run(spark, sf_dir):
    return ft.calendar_run(customer_series(spark, sf_dir), ["topic"])


# --- trends and forecasts ---
PVALUE = """, m AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY year) - 1 AS x FROM {src}), g AS (SELECT topic, count(*) AS n, regr_slope(cnt, x) AS slope, regr_sxx(cnt, x) AS sxx, regr_syy(cnt, x) AS syy, regr_sxy(cnt, x) AS sxy FROM m GROUP BY topic HAVING count(*) = 7),
a AS (SELECT *, atan(abs(slope) / sqrt(greatest(syy - sxy * sxy / sxx, 0) / 5 / sxx) / sqrt(5)) AS th FROM g), p AS (SELECT topic, n, slope, greatest(0, 1 - 2 / pi() * (th + sin(th) * (cos(th) + 2.0 / 3 * pow(cos(th), 3)))) AS p FROM a) """


@query(NATION + GRID + PVALUE.format(src="grid") + "SELECT topic, n, round(slope, 6) AS slope, round(p, 6) AS p, CASE WHEN p < 0.05 AND slope > 0.1 THEN 'rising' WHEN p < 0.05 AND slope < -0.1 THEN 'declining' ELSE 'stable' END AS trend FROM p")
def slope_pvalue(spark, sf_dir):
    return r(tr.trend_test(fq.dense(customer_series(spark, sf_dir), ["topic"]), ["topic"]), "slope", "p")


@query(NATION + "SELECT topic, count(*) AS n, round(regr_slope(cnt, year), 6) AS slope, round(regr_intercept(cnt, year), 4) AS intercept, round(CASE WHEN var_pop(cnt) = 0 THEN 0 ELSE regr_r2(cnt, year) END, 6) AS r2 FROM series GROUP BY topic HAVING count(*) >= 3")
def linear_trend_calendar(spark, sf_dir):
    return r(r(tr.linear_trend(customer_series(spark, sf_dir), ["topic"], x="year"), "slope", "r2"), "intercept", n=4)


@query(NATION + GRID + """, m AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY year) - 1 AS x FROM grid), g AS (SELECT topic, count(*) AS n, avg(cnt) AS mean, count(*) FILTER (x % 2 = 0) AS n0, count(*) FILTER (x % 2 = 1) AS n1, avg(cnt) FILTER (x % 2 = 0) AS m0, avg(cnt) FILTER (x % 2 = 1) AS m1, var_samp(cnt) FILTER (x % 2 = 0) AS v0, var_samp(cnt) FILTER (x % 2 = 1) AS v1 FROM m GROUP BY topic),
t AS (SELECT *, v0 * (n0 - 1) + v1 * (n1 - 1) AS ss FROM g), a AS (SELECT *, CASE WHEN ss > 0 THEN atan(abs(m0 - m1) / sqrt(ss / 5 * (1.0 / n0 + 1.0 / n1)) / sqrt(5)) END AS th FROM t), p AS (SELECT *, CASE WHEN ss = 0 THEN CASE WHEN m0 <> m1 THEN 0.0 END ELSE greatest(0, 1 - 2 / pi() * (th + sin(th) * (cos(th) + 2.0 / 3 * pow(cos(th), 3)))) END AS p FROM a)
SELECT topic, n, round(p, 6) AS p, round(abs(m0 - m1) / (mean + 0.01), 6) AS strength, coalesce(p < 0.05, false) AS alternates FROM p""")
def alternation_ttest(spark, sf_dir):
    return r(tr.alternation(fq.dense(customer_series(spark, sf_dir), ["topic"]), ["topic"]), "p", "strength")


@query(NATION + GRID + """, m AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY year) - 1 AS x FROM grid), sp AS (SELECT a.topic, a.x AS k, a.year AS y, count(*) FILTER (b.x < a.x) AS n1, count(*) FILTER (b.x >= a.x) AS n2, avg(b.cnt) FILTER (b.x < a.x) AS m1, avg(b.cnt) FILTER (b.x >= a.x) AS m2, var_samp(b.cnt) FILTER (b.x < a.x) AS v1, var_samp(b.cnt) FILTER (b.x >= a.x) AS v2, avg(b.cnt) AS mean FROM m a JOIN m b ON a.topic = b.topic GROUP BY ALL),
t AS (SELECT *, v1 * (n1 - 1) + v2 * (n2 - 1) AS ss FROM sp WHERE n1 + n2 >= 6 AND k >= 2 AND k <= n1 + n2 - 3), a AS (SELECT *, CASE WHEN ss > 1e-9 THEN atan(abs(m1 - m2) / sqrt(ss / 5 * (1.0 / n1 + 1.0 / n2)) / sqrt(5)) END AS th FROM t),
p AS (SELECT *, CASE WHEN th IS NULL THEN CASE WHEN m1 <> m2 THEN 0.0 END ELSE 1 - 2 / pi() * (th + sin(th) * (cos(th) + 2.0 / 3 * pow(cos(th), 3))) END AS p, round(abs(m2 - m1) / (mean + 0.01), 9) AS change FROM a),
b AS (SELECT topic, max(change) FILTER (p < 0.05) AS c, arg_max(y, (change, -k)) FILTER (p < 0.05) AS y FROM p GROUP BY topic)
SELECT topic, coalesce(c > 0.3, false) AS detected, CASE WHEN c > 0.3 THEN y END AS break_year, round(coalesce(c, 0), 6) AS magnitude FROM b""")
def structural_break(spark, sf_dir):
    return r(tr.structural_break(fq.dense(customer_series(spark, sf_dir), ["topic"]), ["topic"]), "magnitude")


@query(NATION + GRID + """, m AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY year) - 1 AS x, row_number() OVER (PARTITION BY topic ORDER BY year DESC) AS b FROM grid),
g AS (SELECT topic, count(*) AS n, avg(cnt) AS mean, stddev_pop(cnt) AS sd, avg(cnt) FILTER (b <= 3) AS m3, stddev_pop(cnt) FILTER (b <= 3) AS s3, regr_slope(cnt, x) AS sl, regr_intercept(cnt, x) AS ic, regr_sxx(cnt, x) AS sxx, regr_syy(cnt, x) AS syy, regr_sxy(cnt, x) AS sxy FROM m GROUP BY topic),
e AS (SELECT topic, sum(cnt * CASE WHEN x = 0 THEN pow(0.7, nn - 1) ELSE 0.3 * pow(0.7, nn - 1 - x) END) AS ema FROM (SELECT *, count(*) OVER (PARTITION BY topic) AS nn FROM m) GROUP BY topic),
h AS (SELECT *, ic + sl * n AS line, sqrt(greatest(syy - sxy * sxy / sxx, 0) / (n - 2) / sxx) * sqrt(n) AS sp FROM g JOIN e USING (topic))
SELECT topic, round(mean, 6) AS f_mean, round(greatest(mean - 1.96 * sd, 0), 6) AS mean_low, round(mean + 1.96 * sd, 6) AS mean_high, round(m3, 6) AS f_ma3, round(ema, 6) AS f_ema, round(greatest(ema - 1.96 * s3, 0), 6) AS ema_low, round(ema + 1.96 * s3, 6) AS ema_high, round(line, 6) AS f_line, round(greatest(line - 1.96 * sp, 0), 6) AS line_low, round(line + 1.96 * sp, 6) AS line_high FROM h""")
def forecast_methods(spark, sf_dir):
    out = tr.forecasts(fq.dense(customer_series(spark, sf_dir), ["topic"]), ["topic"])
    return r(out, *out.columns[1:])


HOT = NATION + GRID + PVALUE.format(src="grid") + ", h AS (SELECT topic, slope, CASE WHEN p < 0.9 AND slope > 0.1 THEN 'rising' WHEN p < 0.9 AND slope < -0.1 THEN 'declining' ELSE 'stable' END AS trend FROM p), w AS (SELECT topic, avg(cnt) AS predicted FROM grid GROUP BY topic) "


@query(HOT + "SELECT topic, round(slope, 6) AS slope, round(predicted, 6) AS predicted, round(predicted * (1 + abs(slope)), 6) AS heat FROM h JOIN w USING (topic) WHERE trend = 'rising' ORDER BY predicted * (1 + abs(slope)) DESC, topic LIMIT 10")
def hot_topics(spark, sf_dir):
    d = fq.dense(customer_series(spark, sf_dir), ["topic"])
    rep = tr.trend_test(d, ["topic"], alpha=0.9).join(d.groupBy("topic").agg(F.avg("cnt").alias("predicted")), "topic")
    return r(tr.hot_topics(rep, ["topic"], "predicted"), "slope", "predicted", "heat").select("topic", "slope", "predicted", "heat")


@query(HOT + "SELECT topic, round(slope, 6) AS slope, trend FROM h WHERE trend = 'declining' ORDER BY abs(slope) DESC, topic LIMIT 5")
def cold_topics(spark, sf_dir):
    d = fq.dense(customer_series(spark, sf_dir), ["topic"])
    return r(tr.cold_topics(tr.trend_test(d, ["topic"], alpha=0.9), ["topic"]), "slope").select("topic", "slope", "trend")


@query(NATION + """, g AS (SELECT topic, avg(cnt) FILTER (year >= 1999) AS r, avg(cnt) FILTER (year BETWEEN 1995 AND 1998) AS o, max(year) AS last_seen, count(DISTINCT year) AS n_years, string_agg(year || ':' || cnt, ',' ORDER BY year) AS history FROM series GROUP BY topic),
p AS (SELECT *, CASE WHEN o > 0 THEN (coalesce(r, 0) - o) / o * 100 WHEN r > 0 THEN 100.0 ELSE 0.0 END AS pct FROM g)
SELECT topic, round(pct, 6) AS pct_change, CASE WHEN pct > 30 THEN 'rising' WHEN pct < -30 THEN 'declining' ELSE 'stable' END AS trend, n_years, last_seen, history FROM p""")
def recent_vs_old_pct(spark, sf_dir):
    return r(tr.recent_against_old(customer_series(spark, sf_dir), ["topic"], 1999, (1995, 1998)), "pct_change")


@query(NATION + GRID + ", o AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY year) AS a, row_number() OVER (PARTITION BY topic ORDER BY year DESC) AS b FROM grid), g AS (SELECT topic, avg(cnt) FILTER (a <= 2) AS f, avg(cnt) FILTER (b <= 2) AS l FROM o GROUP BY topic) SELECT topic, round(f, 6) AS first2, round(l, 6) AS last2, round(CASE WHEN f > 0 THEN least((l - f) / f * 100, 500) WHEN l > 0 THEN 100 ELSE 0 END, 6) AS growth FROM g")
def growth_first_last(spark, sf_dir):
    return r(tr.growth_ends(fq.dense(customer_series(spark, sf_dir), ["topic"]), ["topic"]), "first2", "last2", "growth")


@query(NATION + ", o AS (SELECT *, pow(0.5, row_number() OVER (PARTITION BY topic ORDER BY year DESC) - 1) AS w, lag(cnt) OVER (PARTITION BY topic ORDER BY year) AS p FROM series), g AS (SELECT topic, sum(cnt * w) / sum(w) AS h, avg(cnt) AS s, arg_max(cnt - coalesce(p, cnt), year) AS d FROM o GROUP BY topic) SELECT topic, round(h, 6) AS weighted, round(s, 6) AS simple, round(h * CASE WHEN d > 0 THEN 1.1 WHEN d < 0 THEN 0.9 ELSE 1 END, 6) AS adjusted FROM g")
def halflife_weighted(spark, sf_dir):
    return r(tr.half_life_mean(customer_series(spark, sf_dir), ["topic"]), "weighted", "simple", "adjusted")


@query(NATION + ", o AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY year DESC) AS b FROM series), w AS (SELECT *, pow(row_number() OVER (PARTITION BY topic ORDER BY year), 2) AS w FROM o WHERE b <= 5) SELECT topic, round(sum(cnt * w) / sum(w), 6) AS base, round(sum(cnt * w) / sum(w) * 1.1 * 1.05, 6) AS predicted FROM w GROUP BY topic")
def quadratic_weighted(spark, sf_dir):
    return r(tr.quadratic_mean(customer_series(spark, sf_dir), ["topic"], F.lit(1.1), F.lit(0.05)), "base", "predicted")


@query(SERIES + ", g AS (SELECT topic, max(year) AS last_year FROM series WHERE cnt > 3 GROUP BY topic) SELECT topic, last_year FROM g WHERE 2002 - last_year >= 1")
def dormant_topics(spark, sf_dir):
    return tr.dormant(order_series(spark, sf_dir).filter("cnt > 3").groupBy("topic").agg(F.max("year").alias("last_year")), 2002, 1)


# --- filters, names, orders ---
@query("SELECT o_orderkey, o_orderpriority, o_orderstatus FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus IN ('F')")
def filter_in_lists(spark, sf_dir):
    return rk.in_lists(table(spark, sf_dir, "orders"), o_orderpriority=["1-URGENT", "2-HIGH"], o_orderstatus=["F"], o_custkey=[]).select("o_orderkey", "o_orderpriority", "o_orderstatus")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY year(o_orderdate) DESC, o_orderkey DESC LIMIT 25")
def latest_rows(spark, sf_dir):
    return rk.latest(table(spark, sf_dir, "orders"), [F.desc(F.year("o_orderdate")), F.desc("o_orderkey")], 25).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderpriority, o_orderkey, rank FROM (SELECT o_orderpriority, o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS rank FROM orders) WHERE rank BETWEEN 3 AND 7")
def section_topn(spark, sf_dir):
    return rk.top_per_group(table(spark, sf_dir, "orders"), ["o_orderpriority"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3, 7).select("o_orderpriority", "o_orderkey", "rank")


@query("SELECT event_type, count(*) AS cnt FROM events GROUP BY 1 ORDER BY cnt DESC, min(event_id) LIMIT 3")
def most_common_first_seen(spark, sf_dir):
    return rk.most_common(table(spark, sf_dir, "events"), "event_type", "event_id", 3)


@query("SELECT c_custkey FROM customer ORDER BY md5(c_custkey || ':42'), c_custkey LIMIT 50")
def seeded_sample(spark, sf_dir):
    return rk.seeded_sample(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 50)


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 30 DAY AND ts <= (SELECT max(ts) FROM events)")
def recent_cutoff(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return rk.within_months(e, "ts", F.lit(e.agg(F.max("ts")).first()[0]).cast("timestamp_ntz"), 1).select("event_id")


@query("SELECT event_type, event_id, category_place FROM (SELECT event_type, event_id, coalesce(nullif(list_position(['purchase', 'signup', 'click'], event_type), 0), 4) AS category_place, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn <= 5")
def category_digest(spark, sf_dir):
    return rk.digest(table(spark, sf_dir, "events"), "event_type", "value", "event_id", ["purchase", "signup", "click"], 5).select("event_type", "event_id", F.col("category_place").cast("int").alias("category_place"))


@query("SELECT event_id, value FROM events WHERE value >= 50 ORDER BY value DESC, event_id")
def min_probability(spark, sf_dir):
    return rk.at_least(table(spark, sf_dir, "events"), "value", 50.0, "event_id").select("event_id", "value")


@query("""SELECT p_partkey, CASE WHEN contains(lower(p_name), 'red') THEN 'C_RED' WHEN contains(lower(p_name), 'blue') THEN 'C_BLUE' WHEN contains(lower(p_name), 'e') THEN 'C_E' ELSE 'X_' || upper(substr(p_name, 1, 10)) END AS code FROM part""")
def first_substring_code(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", nz.first_code(F.col("p_name"), [("red", "C_RED"), ("blue", "C_BLUE"), ("e", "C_E")], F.lit("X")).alias("code"))


@query("""WITH a(raw, name) AS (VALUES ('building', 'Construction'), ('AUTOMOBILE', 'Cars'), ('Machinery', 'Machines')) SELECT c_custkey, CASE WHEN c_mktsegment IS NULL OR trim(c_mktsegment) = '' THEN 'Unknown' ELSE coalesce(x.name, l.name, c_mktsegment) END AS topic_name FROM customer LEFT JOIN a x ON x.raw = c_mktsegment LEFT JOIN a l ON lower(l.raw) = lower(trim(c_mktsegment))""")
def alias_normalise_two_level(spark, sf_dir):
    names = spark.createDataFrame([("building", "Construction"), ("AUTOMOBILE", "Cars"), ("Machinery", "Machines")], "raw string, name string")
    return nz.alias_topics(table(spark, sf_dir, "customer"), names, "c_mktsegment").select("c_custkey", "topic_name")


@query("SELECT c_custkey, coalesce(code, 'MISC') AS code FROM customer LEFT JOIN (VALUES ('BUILDING', 'B1'), ('MACHINERY', 'M1')) d(topic, code) ON topic = c_mktsegment")
def topic_code_default(spark, sf_dir):
    codes = spark.createDataFrame([("BUILDING", "B1"), ("MACHINERY", "M1")], "topic string, code string")
    return nz.with_codes(table(spark, sf_dir, "customer"), codes, "c_mktsegment", "c_mktsegment", F.lit("MISC")).select("c_custkey", "code")


@query("SELECT url, coalesce(CAST(nullif(regexp_extract(url, '(20[0-9]{2})', 1), '') AS INT), 2020) AS year, regexp_extract(url, '([0-9]+)', 1) AS n FROM pages")
def year_from_name(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("url", nz.year_in(F.col("url"), default=2020).alias("year"), F.regexp_extract("url", "([0-9]+)", 1).alias("n"))


@query("SELECT p_partkey, CASE WHEN contains(s, 'Verbal') AND NOT contains(s, 'Reasoning') THEN 'Verbal Ability' WHEN contains(s, 'Reasoning') THEN 'Reasoning' WHEN contains(s, 'Numerical') OR contains(s, 'Quant') THEN 'Numerical Ability' WHEN contains(s, 'General') OR contains(s, 'Awareness') THEN 'General Awareness' ELSE 'Unknown' END AS section FROM (SELECT p_partkey, ['Verbal Reasoning', 'Verbal', 'Quant x', 'General', 'other'][(p_partkey % 5) + 1] AS s FROM part)")
def section_standard(spark, sf_dir):
    s = F.get(F.array(*map(F.lit, ("Verbal Reasoning", "Verbal", "Quant x", "General", "other"))), (F.col("p_partkey") % 5).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", nz.standard_section(s).alias("section"))


@query("SELECT p_partkey, coalesce(m['Brand'], 'GA') AS a, CASE split_part(p_brand, '#', 1) WHEN 'Brand' THEN 'B' ELSE p_brand END AS b FROM (SELECT *, MAP {'x': 'y'} AS m FROM part)")
def map_and_prefix(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", nz.by_prefix(F.col("p_brand"), {"Brand": "VA"}, "GA").alias("a"), nz.mapped(F.substring_index("p_brand", "#", 1), {"Brand": "B"}).alias("b"))


@query("SELECT c.n_nationkey, n_users, CASE WHEN n_users >= 80 THEN 'full' WHEN n_users <= 40 THEN 'single_section' WHEN n_users >= 60 THEN 'full' ELSE 'single_section' END AS paper_type FROM nation c JOIN (SELECT c_nationkey, count(*) AS n_users FROM customer GROUP BY 1) k ON k.c_nationkey = c.n_nationkey")
def paper_type(spark, sf_dir):
    k = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n_users"))
    return k.select(F.col("c_nationkey").alias("n_nationkey"), "n_users", rk.paper_type(F.col("n_users")).alias("paper_type"))


@query("SELECT 'customer' AS kind, c_nationkey AS nation FROM customer UNION ALL SELECT 'supplier', s_nationkey FROM supplier")
def union_all_sources(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_nationkey").alias("nation"))
    return c.unionByName(table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_nationkey").alias("nation")))


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def except_missing_keys(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey").subtract(table(spark, sf_dir, "orders").select("o_custkey"))


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AS boosted FROM customer")
def semi_flag(spark, sf_dir):
    u = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("b")).distinct()
    return table(spark, sf_dir, "customer").join(u, "c_custkey", "left").select("c_custkey", F.coalesce("b", F.lit(False)).alias("boosted"))


# --- allocation ---
@query(NATION + """, g AS (SELECT topic, CAST(topic % 5 AS BIGINT) AS section, sum(cnt) AS total, avg(cnt) AS a FROM series GROUP BY topic) SELECT topic, section, round(a * 1.2 * (3 * 0.8 - 0.2) / greatest(0.5, 0.1), 6) AS roi FROM g ORDER BY a DESC, topic LIMIT 15""")
def roi_priorities(spark, sf_dir):
    g = customer_series(spark, sf_dir).groupBy("topic").agg(F.avg("cnt").alias("a")).select("topic", (F.col("topic") % 5).cast("long").alias("section"), al.roi(F.col("a"), F.lit("rising"), F.lit(0.8), F.lit(0.5)).alias("roi"))
    return r(rk.latest(g, [F.desc("roi"), F.col("topic")], 15), "roi")


PRED = NATION + ", g AS (SELECT topic, CAST(topic % 5 AS BIGINT) AS section, avg(cnt) AS v, CAST(10 + 5 * (topic % 5) AS BIGINT) AS quota, CAST(sum(cnt) AS BIGINT) AS want FROM series GROUP BY topic) "


def predictions(spark, sf_dir):
    """topic, section, v, quota, want."""
    t = F.col("topic") % 5
    return customer_series(spark, sf_dir).groupBy("topic").agg(F.avg("cnt").alias("v"), F.sum("cnt").alias("want")).select("topic", t.cast("long").alias("section"), "v", (10 + 5 * t).cast("long").alias("quota"), "want")


@query(PRED + "SELECT topic, section, round(v * quota / sum(v) OVER (PARTITION BY section), 6) AS scaled FROM g")
def quota_scale(spark, sf_dir):
    return r(al.to_quota(predictions(spark, sf_dir), "v", "section", "quota"), "scaled").select("topic", "section", "scaled")


@query(PRED + ", s AS (SELECT *, sum(v) OVER (PARTITION BY section) AS t FROM g) SELECT topic, section, round(CASE WHEN abs(t - quota) > 2 AND t > 0 THEN least(v * quota / t, 6.0) ELSE v END, 6) AS balanced FROM s")
def section_balance_caps(spark, sf_dir):
    return r(al.balance(predictions(spark, sf_dir), "v", "section", "quota", F.lit(6.0)), "balanced").select("topic", "section", "balanced")


@query(PRED + "SELECT topic, section, greatest(1, CAST(round_even(v * quota / sum(v) OVER (PARTITION BY section), 0) AS INT)) AS n FROM g")
def proportional_round(spark, sf_dir):
    return al.proportional(predictions(spark, sf_dir), "v", ["section"], F.col("quota")).select("topic", "section", "n")


@query(PRED + """, x AS (SELECT *, v * quota / sum(v) OVER (PARTITION BY section) AS x FROM g), f AS (SELECT *, CAST(floor(round(x, 9)) AS BIGINT) AS f FROM x), k AS (SELECT *, quota - sum(f) OVER (PARTITION BY section) AS rest, row_number() OVER (PARTITION BY section ORDER BY round(x - f, 9) DESC, topic) AS rn FROM f) SELECT topic, section, CAST(f + CASE WHEN rn <= rest THEN 1 ELSE 0 END AS BIGINT) AS n FROM k""")
def largest_remainder(spark, sf_dir):
    return al.largest_remainder(predictions(spark, sf_dir), "v", ["section"], F.col("quota"), ["topic"]).select("topic", "section", "n")


@query(OBS + "SELECT n, round(e, 6) AS r_easy, round(m, 6) AS r_medium, round(h, 6) AS r_hard, round(e - 0.45, 6) AS d_easy, round(m - 0.35, 6) AS d_medium, round(h - 0.2, 6) AS d_hard, round((abs(e - 0.45) + abs(m - 0.35) + abs(h - 0.2)) / 3, 6) AS bias_score, CAST(floor(n * 0.3 / 0.7) AS BIGINT) AS n_missing FROM (SELECT count(*) AS n, avg(CASE WHEN difficulty = 'easy' THEN 1.0 ELSE 0 END) AS e, avg(CASE WHEN difficulty = 'medium' THEN 1.0 ELSE 0 END) AS m, avg(CASE WHEN difficulty = 'hard' THEN 1.0 ELSE 0 END) AS h FROM obs)")
def bias_metrics(spark, sf_dir):
    out = al.bias_metrics(observations(spark, sf_dir), "difficulty", {"easy": 0.45, "medium": 0.35, "hard": 0.20})
    return r(out, *(c for c in out.columns if c not in ("n", "n_missing")))


@query(PRED + ", c AS (SELECT *, v * CASE WHEN topic IN (SELECT s_nationkey FROM supplier GROUP BY 1 HAVING avg(s_acctbal) > 4500) THEN 1.15 ELSE 0.85 END AS w FROM g) SELECT topic, section, round(w * quota / sum(w) OVER (PARTITION BY section), 6) AS corrected FROM c")
def bias_correction(spark, sf_dir):
    p = predictions(spark, sf_dir)
    hard = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("topic")).agg(F.avg("s_acctbal").alias("a")).filter("a > 4500").select("topic")
    return r(al.recall_corrected(p, "v", "topic", hard, "section", F.col("quota")), "corrected").select("topic", "section", "corrected")


@query(PRED + ", y AS (SELECT DISTINCT unnest([n_nationkey, n_nationkey + 20]) AS topic FROM nation) SELECT topic, round(v, 6) AS v, false AS imputed FROM g UNION ALL SELECT topic, round((SELECT avg(v) * 0.5 FROM g), 6), true FROM y WHERE topic NOT IN (SELECT topic FROM g)")
def impute_missing_topics(spark, sf_dir):
    syllabus = table(spark, sf_dir, "nation").select(F.explode(F.array(F.col("n_nationkey"), F.col("n_nationkey") + 20)).alias("topic"))
    return r(al.impute_missing(predictions(spark, sf_dir), syllabus, "topic", "v"), "v")


@query(PRED + ", b AS (SELECT *, coalesce(sum(want) OVER (PARTITION BY section ORDER BY want DESC, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g) SELECT topic, section, want, CAST(before AS BIGINT) AS before FROM b WHERE before < 170")
def budget_cutoff_170(spark, sf_dir):
    return al.take_until(predictions(spark, sf_dir), "want", ["section"], [F.desc("want"), "topic"], 170).select("topic", "section", "want", "before")


@query(PRED + ", b AS (SELECT *, coalesce(sum(want) OVER (PARTITION BY section ORDER BY topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g) SELECT topic, section, CAST(greatest(0, least(want, 200 - before)) AS BIGINT) AS given FROM b")
def greedy_quota_fill(spark, sf_dir):
    return al.greedy_fill(predictions(spark, sf_dir), "want", ["section"], ["topic"], F.lit(200)).select("topic", "section", F.col("given").cast("long").alias("given"))


@query(PRED + "SELECT topic, section, round(v * 200 / sum(v) OVER (), 1) AS hours FROM g")
def hours_by_share(spark, sf_dir):
    return al.hours_by_share(predictions(spark, sf_dir), "v", [], 200.0).select("topic", "section", "hours")


@query(PRED + ", h AS (SELECT section, sum(want) AS hours, count(*) AS n_topics FROM g GROUP BY section) SELECT section, CAST(hours AS BIGINT) AS hours, n_topics, round(hours * 100 / sum(hours) OVER (), 1) AS pct, CAST(ceil(hours / 6.0) AS BIGINT) AS days FROM h")
def study_totals(spark, sf_dir):
    return al.study_totals(predictions(spark, sf_dir), "section", "want")


@query(PRED + "SELECT topic, CASE WHEN v >= 4 THEN 'HIGH' WHEN v >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS band, CASE WHEN v >= 4 THEN 8 WHEN v >= 2 THEN 5 ELSE 2 END AS hours, CASE WHEN v / 10 > 0.7 THEN 'medium' WHEN v / 10 > 0.5 THEN 'hard' ELSE 'easy' END AS level FROM g")
def priority_bands(spark, sf_dir):
    v = F.col("v")
    return predictions(spark, sf_dir).select("topic", al.priority_band(v).alias("band"), al.study_hours(v).alias("hours"), al.generation_level(v / 10).alias("level"))


@query(PRED + ", l AS (SELECT s_nationkey AS topic, CAST(count(*) AS DOUBLE) AS most FROM supplier GROUP BY 1) SELECT topic, round(least(v * 2, CASE WHEN most IS NOT NULL THEN least(most * 1.2, most + 2) ELSE 5.0 END, 8.0), 6) AS capped FROM (SELECT g.topic, v, most FROM g LEFT JOIN l USING (topic))")
def historic_cap(spark, sf_dir):
    limits = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("topic")).agg(F.count("*").alias("most"))
    p = predictions(spark, sf_dir).withColumn("v", F.col("v") * 2)
    return r(al.historic_cap(p, "v", limits, "topic", F.lit(5.0), F.lit(8.0)), "capped").select("topic", "capped")


@query(PRED.replace("WITH ", "WITH RECURSIVE ", 1) + """, o AS (SELECT section, topic, round(v, 6) AS v, row_number() OVER (PARTITION BY section ORDER BY topic) AS i FROM g),
w AS (SELECT section, topic, v, i, 1 AS week, CASE WHEN v >= 14 THEN 2 ELSE 1 END AS nw, CASE WHEN v >= 14 THEN 0.0 ELSE v END AS s FROM o WHERE i = 1
UNION ALL SELECT o.section, o.topic, o.v, o.i, w.nw, CASE WHEN w.s + o.v >= 14 THEN w.nw + 1 ELSE w.nw END, CASE WHEN w.s + o.v >= 14 THEN 0.0 ELSE w.s + o.v END FROM w JOIN o ON o.section = w.section AND o.i = w.i + 1)
SELECT section, topic, v, CAST(week AS INT) AS week FROM w""")
def pack_weeks(spark, sf_dir):
    return al.pack_weeks(r(predictions(spark, sf_dir), "v"), "v", ["section"], ["topic"], 14.0)


# --- sequences ---
@query(PAPER + ", e AS (SELECT *, list_position(['click', 'view', 'purchase', 'signup', 'logout'], section) - 1 AS rank FROM paper), m AS (SELECT *, coalesce(max(CASE WHEN confidence >= 0.9 THEN rank END) OVER (PARTITION BY user_id ORDER BY qnum ROWS UNBOUNDED PRECEDING), 0) AS enforced FROM e) SELECT event_id, CAST(enforced AS INT) AS enforced, coalesce(rank <> enforced, true) AS changed FROM m")
def sequential_enforcement(spark, sf_dir):
    rank = F.nullif(F.array_position(F.array(*map(F.lit, ("click", "view", "purchase", "signup", "logout"))), F.col("section")), F.lit(0)) - 1
    return sq.enforce_order(paper_rows(spark, sf_dir), ["user_id"], ["qnum"], rank.cast("int"), "confidence").select("event_id", "enforced", "changed")


RUNS = PAPER + ", i AS (SELECT *, qnum - row_number() OVER (PARTITION BY user_id, section ORDER BY qnum) AS g FROM paper), r AS (SELECT user_id, section, g, count(*) AS length, min(qnum) AS first_at, max(qnum) AS last_at FROM i GROUP BY ALL) "


@query(RUNS + "SELECT user_id, section, length, first_at, last_at FROM r WHERE length >= 2")
def run_detection(spark, sf_dir):
    return sq.runs(paper_rows(spark, sf_dir), ["user_id"], ["qnum"], "section", "qnum", 2).drop("island")


@query(RUNS + ", f AS (SELECT user_id, section, min(first_at) AS starts FROM r WHERE length >= 2 GROUP BY ALL) SELECT user_id, section, starts, CAST(row_number() OVER (PARTITION BY user_id ORDER BY starts, section) AS INT) AS place FROM f")
def section_order(spark, sf_dir):
    return sq.section_order(paper_rows(spark, sf_dir), ["user_id"], ["qnum"], "section", "confidence", "qnum", least=2, sure=0.0)


@query(RUNS + ", l AS (SELECT user_id, section, max(first_at) AS first_at FROM r GROUP BY ALL) SELECT user_id, section, first_at, last_at, length FROM r JOIN l USING (user_id, section, first_at)")
def boundaries(spark, sf_dir):
    return sq.boundaries(paper_rows(spark, sf_dir), ["user_id"], ["qnum"], "section", "qnum")


@query("WITH c AS (SELECT conv_id, turn * 2 + 1 AS n FROM conversations), m AS (SELECT conv_id, max(n) AS m FROM c GROUP BY 1) SELECT conv_id, CAST(k AS INT) AS n FROM (SELECT conv_id, unnest(range(1, m + 1)) AS k FROM m) x WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.conv_id = x.conv_id AND c.n = x.k)")
def missing_turns_anti(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") * 2 + 1).alias("n"))
    return sq.missing_numbers(c, ["conv_id"], "n")


@query("WITH t AS (SELECT conv_id, turn * (1 + conv_id % 5) AS turn FROM conversations), c AS (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nx FROM t) SELECT conv_id, turn AS after, nx AS before, unnest(range(turn + 1, nx)) AS missing FROM c WHERE nx - turn BETWEEN 2 AND 4")
def gap_spans(spark, sf_dir):
    return sq.gaps(table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") * (1 + F.col("conv_id") % 5)).alias("turn")), ["conv_id"], "turn")


@query("WITH c AS (SELECT conv_id, turn, CASE WHEN role <> 'assistant' THEN role END AS v FROM conversations) SELECT conv_id, turn, CASE WHEN v IS NULL AND lag(v) OVER w = lead(v) OVER w THEN lag(v) OVER w ELSE v END AS filled FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def neighbour_fill(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") != "assistant", F.col("role")).alias("v"))
    return sq.fill_between(c, ["conv_id"], ["turn"], "v", "filled").select("conv_id", "turn", "filled")


@query("""WITH c AS (SELECT conv_id, turn, turn // 3 AS page, CASE WHEN role <> 'assistant' THEN role END AS v, contains(text, 'z') AS nv FROM conversations),
n AS (SELECT *, lag(v) OVER w AS p, lead(v) OVER w AS n, lag(page) OVER w AS pp, lead(page) OVER w AS np, lag(turn) OVER w AS pt, lead(turn) OVER w AS nt FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
s AS (SELECT *, round(CASE WHEN p IS NOT NULL AND n IS NOT NULL THEN 0.15 ELSE 0 END + CASE WHEN pp = page OR np = page THEN 0.2 ELSE 0 END + CASE WHEN pt = turn - 1 THEN 0.075 ELSE 0 END + CASE WHEN nt = turn + 1 THEN 0.075 ELSE 0 END
+ CASE WHEN p = n THEN 0.3 WHEN p IS NOT NULL OR n IS NOT NULL THEN 0.15 ELSE 0 END + CASE WHEN nv THEN 0.1 ELSE 0 END, 6) AS score FROM n)
SELECT conv_id, turn, score, CASE WHEN v IS NULL AND score >= 0.3 THEN coalesce(p, n) ELSE v END AS inferred, v IS NULL AND score >= 0.3 AND coalesce(p, n) IS NOT NULL AS was_inferred FROM s""")
def neighbour_inference(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.floor(F.col("turn") / 3).alias("page"), F.when(F.col("role") != "assistant", F.col("role")).alias("v"), F.col("text").contains("z").alias("nv"))
    return sq.neighbour_inference(c, ["conv_id"], ["turn"], "turn", "page", "v", "nv").select("conv_id", "turn", "score", "inferred", "was_inferred")


@query(PAPER + "SELECT event_id, zone, CASE WHEN zone IS NOT NULL AND section <> zone AND confidence < 0.9 THEN zone ELSE section END AS final_section FROM (SELECT *, CASE WHEN qnum BETWEEN 1 AND 3 THEN 'click' WHEN qnum BETWEEN 4 AND 9 THEN 'view' END AS zone FROM paper)")
def zone_range_join(spark, sf_dir):
    zones = spark.createDataFrame([("click", 1, 3), ("view", 4, 9)], "zone string, lo int, hi int")
    return sq.zone_enforced(sq.in_zone(paper_rows(spark, sf_dir), zones, "qnum"), "section", F.col("confidence")).select("event_id", "zone", "final_section")


@query(PAPER + "SELECT event_id, CASE WHEN zone IS NOT NULL AND section <> zone AND confidence >= 0.4 THEN 'kept' WHEN zone IS NOT NULL AND section <> zone THEN 'forced' ELSE 'same' END AS action FROM (SELECT *, CASE WHEN qnum BETWEEN 1 AND 3 THEN 'click' WHEN qnum BETWEEN 4 AND 9 THEN 'view' END AS zone FROM paper)")
def zone_quality_gate(spark, sf_dir):
    zones = spark.createDataFrame([("click", 1, 3), ("view", 4, 9)], "zone string, lo int, hi int")
    return sq.reassigned(sq.in_zone(paper_rows(spark, sf_dir), zones, "qnum"), "section", F.col("confidence")).select("event_id", "action")


@query("SELECT e.event_id, o.event_id AS last_purchase FROM events e ASOF LEFT JOIN (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase') o ON e.user_id = o.user_id AND e.ts >= o.ts")
def asof_span(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return sq.in_span(e.drop("event_type"), e.filter("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("last_purchase")), ["user_id"], "ts", "ts", "last_purchase").select("event_id", "last_purchase")


@query(PAPER + "SELECT user_id, qnum, coalesce(lead(qnum) OVER (PARTITION BY user_id ORDER BY qnum), 9999) AS segment_end FROM paper WHERE section = 'purchase'")
def segments_lead(spark, sf_dir):
    return sq.segments(paper_rows(spark, sf_dir).filter("section = 'purchase'"), ["user_id"], "qnum", F.lit(9999)).select("user_id", "qnum", "segment_end")


@query("WITH RECURSIVE " + PAPER.removeprefix("WITH ") + """, p AS (SELECT user_id, qnum, qnum + event_id % 4 + 1 AS "to" FROM paper),
k AS (SELECT user_id, qnum, "to" FROM p WHERE qnum = 1 UNION ALL SELECT p.user_id, p.qnum, p."to" FROM k JOIN p ON p.user_id = k.user_id AND p.qnum = k."to")
SELECT * FROM k""")
def overlap_removal(spark, sf_dir):
    p = paper_rows(spark, sf_dir).withColumn("to", F.col("qnum") + (F.col("event_id") % 4) + 1)
    return sq.without_overlap(p, ["user_id"], "qnum", "to")


@query(PAPER + ", b AS (SELECT *, CASE WHEN section = 'click' THEN NULL ELSE qnum END AS n FROM paper), f AS (SELECT user_id, k, row_number() OVER (PARTITION BY user_id ORDER BY k) AS i FROM (SELECT user_id, unnest(range(1, CAST(count(*) + max(n) - count(n) + 1 AS BIGINT))) AS k FROM b WHERE n IS NOT NULL GROUP BY user_id) x WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.user_id = x.user_id AND b.n = x.k)), z AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM b WHERE n IS NULL) SELECT event_id, CAST(n AS INT) AS n FROM b WHERE n IS NOT NULL UNION ALL SELECT z.event_id, CAST(f.k AS INT) FROM z LEFT JOIN f USING (user_id, i)")
def renumber_missing(spark, sf_dir):
    p = paper_rows(spark, sf_dir).select("user_id", "event_id", F.when(F.col("section") == "click", None).otherwise(F.col("qnum")).cast("int").alias("n"))
    return sq.renumber(p, ["user_id"], ["event_id"], "n").select("event_id", "n")


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def first_of_number(spark, sf_dir):
    return sq.first_of_number(table(spark, sf_dir, "events"), ["user_id"], "event_type", ["event_id"]).select("user_id", "event_type", "event_id")


@query("WITH l AS (SELECT c_nationkey AS nation, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i FROM customer), r AS (SELECT s_nationkey AS nation, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS j, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier) SELECT nation, c_custkey, s_suppkey FROM l JOIN r USING (nation) WHERE i % n = j")
def round_robin_join(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey")
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey")
    return sq.round_robin(c, s, ["nation"], ["c_custkey"], ["s_suppkey"])


@query(PAPER + ", c AS (SELECT user_id, section, count(*) AS cnt, min(qnum) AS f FROM paper GROUP BY ALL) SELECT user_id, arg_max(section, (cnt, -f)) AS majority, max(cnt) AS cnt FROM c GROUP BY 1")
def majority_section(spark, sf_dir):
    return sq.majority(paper_rows(spark, sf_dir), ["user_id"], "section", "qnum")


# --- text ---
@query("SELECT doc_id, length(text) AS n_chars2, len(regexp_extract_all(text, '[0-9]+')) AS n_numbers, len(list_filter(string_split_regex(text, '[.!?]'), lambda s: trim(regexp_replace(s, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) <> '')) AS n_sentences FROM documents")
def text_stats(spark, sf_dir):
    s = tx.text_stats(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", s["n_chars"].cast("long").alias("n_chars2"), s["n_numbers"].cast("long").alias("n_numbers"), s["n_sentences"].cast("long").alias("n_sentences"))


CUES = " OR ".join("regexp_matches(l, '" + c.replace("'", "''") + "')" for c in fixed.DIRECTIVE_CUES)
SCORE = f"""WITH d AS (SELECT doc_id, text, lower(text) AS l, length(trim(text)) AS n, regexp_matches(lower(text), '{fixed.OPTION_MARK}') AS o FROM benchmark_or_docs), q AS (SELECT *, CASE WHEN o THEN 0.3 ELSE 0 END + CASE WHEN contains(text, '?') THEN 0.15 ELSE 0 END + CASE WHEN n > 50 THEN 0.2 WHEN n > 30 THEN 0.15 WHEN n > 15 THEN 0.1 ELSE 0 END + CASE WHEN {CUES} THEN 0.2 ELSE 0 END + 0.15 * 0.7 AS score FROM d) """


@query(SCORE.replace("benchmark_or_docs", "documents") + "SELECT doc_id, round(score, 6) AS score FROM q")
def quality_score(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.round(tx.quality_score(F.col("text"), F.lit(0), F.lit(0.7)), 6).alias("score"))


@query(SCORE.replace("benchmark_or_docs", "documents") + "SELECT doc_id, (" + " OR ".join(f"contains(l, '{m}')" for m in fixed.PLACEHOLDER_MARKERS) + ") OR score < 0.35 OR (length(text) < 15 AND NOT o) AS placeholder FROM q")
def placeholder_predicate(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", tx.is_placeholder(F.col("text"), F.lit(0)).alias("placeholder"))


def _holds(words):
    return "(" + " OR ".join(f"contains(l, '{w}')" for w in words) + ")"


_W = fixed.SECTION_WORDS
SECTION_SQL = f"""WITH d AS (SELECT doc_id, text, lower(text) AS l, len(regexp_extract_all(text, '[0-9]')) AS dg FROM documents),
s AS (SELECT *, CASE WHEN {_holds(_W['numerical_ability'][0])} THEN 3 ELSE 0 END + CASE WHEN {_holds(_W['numerical_ability'][1])} THEN 2 ELSE 0 END + CASE WHEN regexp_matches(text, '\\d+\\s*[+\\-×÷*/=<>%]\\s*\\d+') THEN 4 ELSE 0 END + CASE WHEN regexp_matches(text, '\\d+\\s*:\\s*\\d+') THEN 3 ELSE 0 END + CASE WHEN dg > 8 THEN 2 WHEN dg > 4 THEN 1 ELSE 0 END AS na,
CASE WHEN {_holds(_W['verbal_ability'][0])} THEN 4 ELSE 0 END + CASE WHEN {_holds(_W['verbal_ability'][1])} THEN 2 ELSE 0 END + CASE WHEN regexp_matches(l, '{fixed.PASSAGE}') THEN 5 ELSE 0 END AS va,
CASE WHEN {_holds(_W['reasoning'][0])} THEN 4 ELSE 0 END + CASE WHEN {_holds(_W['reasoning'][1])} THEN 2 ELSE 0 END + CASE WHEN regexp_matches(l, '{fixed.FIGURE}') THEN 2 ELSE 0 END AS re,
CASE WHEN {_holds(_W['general_awareness'][0])} THEN 4 ELSE 0 END + CASE WHEN {_holds(_W['general_awareness'][1])} THEN 2 ELSE 0 END + CASE WHEN regexp_matches(text, '{fixed.YEAR}') THEN 1 ELSE 0 END AS ga FROM d)
SELECT doc_id, CASE WHEN regexp_matches(l, '{fixed.VERBAL_GUARD}') OR regexp_matches(text, '_ _|___|\\[\\s*\\]') THEN 'verbal_ability' WHEN greatest(na, va, re, ga) < 2 THEN CASE WHEN regexp_matches(l, '{fixed.ASKING}') THEN 'general_awareness' WHEN dg > 0 AND length(text) < 200 THEN 'numerical_ability' ELSE 'general_awareness' END
WHEN na = greatest(na, va, re, ga) THEN 'numerical_ability' WHEN va = greatest(na, va, re, ga) THEN 'verbal_ability' WHEN re = greatest(na, va, re, ga) THEN 'reasoning' ELSE 'general_awareness' END AS section FROM s"""


@query(SECTION_SQL)
def section_scorer(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.section_of(F.col("text")).alias("section"))


def _type_score(k):
    return " + ".join([f"CASE WHEN regexp_matches(l, '{p}') THEN 2 ELSE 0 END" for p in fixed.TYPE_PATTERNS[k]] + [f"CASE WHEN contains(l, '{w}') THEN 1 ELSE 0 END" for w in fixed.TYPE_KEYWORDS[k]])


@query("WITH d AS (SELECT doc_id, lower(text) AS l FROM documents), s AS (SELECT doc_id, " + ", ".join(f"{_type_score(k)} AS {k}" for k in fixed.TYPE_PATTERNS) + " FROM d), g AS (SELECT *, greatest(calculation, conceptual, factual, application) AS b, calculation + conceptual + factual + application AS t FROM s) SELECT doc_id, CASE WHEN b = 0 THEN 'unknown' WHEN calculation = b THEN 'calculation' WHEN conceptual = b THEN 'conceptual' WHEN factual = b THEN 'factual' ELSE 'application' END AS kind, round(CASE WHEN b > 0 THEN b / t ELSE 0 END, 6) AS confidence FROM g")
def type_classifier(spark, sf_dir):
    kind, sure = tx.question_type(F.lower("text"))
    return table(spark, sf_dir, "documents").select("doc_id", kind.alias("kind"), F.round(sure, 6).alias("confidence"))


@query("WITH d AS (SELECT doc_id, text, lower(text) AS l FROM documents) SELECT doc_id, CASE " + " ".join("WHEN " + " OR ".join(f"regexp_matches(l, '{p}')" for p in ps) + f" THEN '{k}'" for k, ps in fixed.STARTERS.items()) + " WHEN contains(text, '?') AND regexp_matches(l, 'how (?:much|many|long)') THEN 'calculation' ELSE 'unknown' END AS kind FROM d")
def starter_types(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.starter_type(F.col("text")).alias("kind"))


_NEWS = {k: " + ".join(f"CASE WHEN contains(l, '{w}') THEN 1 ELSE 0 END" for w in ws) for k, ws in fixed.NEWS_WORDS.items()}


@query("WITH d AS (SELECT doc_id, lower(text) AS l FROM documents), s AS (SELECT doc_id, " + ", ".join(f"{v} AS {k}" for k, v in _NEWS.items()) + f" FROM d), g AS (SELECT *, greatest({', '.join(_NEWS)}) AS b FROM s), c AS (SELECT *, CASE " + " ".join(f"WHEN {k} = b THEN '{k}'" for k in _NEWS) + " END AS k FROM g) SELECT doc_id, CASE WHEN b = 0 THEN 'General' ELSE CASE k " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.NEWS_NAMES.items()) + " END END AS category, round(CASE WHEN b > 0 THEN least(b / 5, 1.0) ELSE 0.1 END, 6) AS relevance, round(CASE WHEN b > 0 THEN least(b / 5, 1.0) * CASE WHEN k IN ('defense', 'sports', 'awards') THEN 1.0 ELSE 0.7 END ELSE 0.1 END, 6) AS probability FROM c")
def news_keywords(spark, sf_dir):
    return r(table(spark, sf_dir, "documents").select("doc_id", tx.news_class(F.col("text")).alias("c")).select("doc_id", "c.*"), "relevance", "probability")


@query("WITH c AS (SELECT CASE WHEN contains(lower(text), 'un') THEN 'International' ELSE 'General' END AS category, length(text) / 10000.0 AS p FROM documents) SELECT category, count(*) AS cnt, count(*) FILTER (p >= 0.7) AS n_strong FROM c GROUP BY 1")
def category_distribution(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.when(F.lower("text").contains("un"), "International").otherwise("General").alias("category"), (F.length("text") / 10000.0).alias("p"))
    return d.groupBy("category").agg(F.count("*").alias("cnt"), F.count_if(F.col("p") >= 0.7).alias("n_strong"))


@query("WITH t AS (SELECT lang, unnest(string_split_regex(lower(text), '[^a-z]+')) AS term FROM documents), c AS (SELECT lang, term, count(*) AS cnt FROM t WHERE length(term) >= 3 AND term NOT IN (" + ", ".join(f"'{w}'" for w in fixed.STOPWORDS) + ") GROUP BY ALL) SELECT lang, term, cnt, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY cnt DESC, term) AS rank FROM c) WHERE rank <= 30")
def keyword_topn_by_lang(spark, sf_dir):
    return mn.keywords(table(spark, sf_dir, "documents"), "doc_id", "lang", "text")


@query("WITH w AS (SELECT lang, list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: length(x) > 0) AS w FROM documents), g AS (SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS phrase FROM w), c AS (SELECT lang, phrase, count(*) AS cnt FROM g GROUP BY ALL HAVING count(*) >= 2) SELECT lang, phrase, cnt, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY cnt DESC, phrase) AS rank FROM c) WHERE rank <= 15")
def bigram_counts(spark, sf_dir):
    return mn.phrases(table(spark, sf_dir, "documents"), "doc_id", "lang", "text", 2)


@query("WITH t AS (SELECT p_type AS g, p_partkey, regexp_replace(p_brand, '[0-9]+(\\.[0-9]+)?', 'N', 'g') AS template FROM part), c AS (SELECT g, template, count(*) AS cnt, min(p_partkey) AS first_id FROM t GROUP BY ALL), n AS (SELECT g, count(*) AS n_templates FROM c GROUP BY 1) SELECT g, template, cnt, first_id, n_templates, CAST(row_number() OVER (PARTITION BY g ORDER BY cnt DESC, first_id) AS INT) AS rank FROM c JOIN n USING (g) WHERE cnt >= 2 OR n_templates < 5 QUALIFY rank <= 10")
def template_digits_to_n(spark, sf_dir):
    return mn.templates(table(spark, sf_dir, "part").withColumnRenamed("p_type", "g"), "g", "p_brand", "p_partkey")


@query("WITH v AS (SELECT p_type AS g, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) AS v FROM part) SELECT g, count(*) AS cnt, count(DISTINCT v) AS n_distinct, min(v) AS lo, max(v) AS hi, concat_ws(',', CASE WHEN avg(CASE WHEN v % 5 = 0 THEN 1 ELSE 0 END) > 0.5 THEN '5' END, CASE WHEN avg(CASE WHEN v % 10 = 0 THEN 1 ELSE 0 END) > 0.5 THEN '10' END, CASE WHEN avg(CASE WHEN v % 2 = 0 THEN 1 ELSE 0 END) > 0.5 THEN '2' END, CASE WHEN avg(CASE WHEN v % 3 = 0 THEN 1 ELSE 0 END) > 0.5 THEN '3' END) AS divisors FROM v GROUP BY g")
def number_stats(spark, sf_dir):
    return mn.number_profile(table(spark, sf_dir, "part").withColumnRenamed("p_type", "g"), "g", "p_brand", "([0-9]+)")


@query("SELECT page_id, pos - 1 AS pos, trim(regexp_replace(regexp_replace(cells[pos], '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS cell FROM (SELECT page_id, cells, unnest(range(1, len(cells) + 1)) AS pos FROM (SELECT page_id, regexp_extract_all(html, '(?is)<p[^>]*>(.*?)</p>', 1) AS cells FROM pages))")
def html_cells_scrape(spark, sf_dir):
    return rd.html_cells(table(spark, sf_dir, "pages"), "page_id", "html", "p").select("page_id", F.col("pos").cast("long").alias("pos"), "cell")


# --- similarity ---
@query("""WITH d AS (SELECT doc_id, source AS g, text FROM documents), t AS (SELECT doc_id, g, unnest(string_split_regex(lower(text), '[^a-z]+')) AS term FROM d), tk AS (SELECT * FROM t WHERE length(term) >= 2 AND term NOT IN (""" + ", ".join(f"'{w}'" for w in fixed.STOPWORDS) + """)), tf AS (SELECT g, doc_id, term, count(*) AS tf FROM tk GROUP BY ALL), n AS (SELECT g, count(DISTINCT doc_id) AS n FROM tk GROUP BY g),
v AS (SELECT g, term, count(*) AS df, row_number() OVER (PARTITION BY g ORDER BY sum(tf) DESC, term) AS rn FROM tf GROUP BY g, term), w AS (SELECT tf.g, doc_id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN v USING (g, term) JOIN n ON n.g = tf.g WHERE rn <= 500), x AS (SELECT g, doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY g, doc_id)) AS w FROM w)
SELECT a.g, a.doc_id AS a, b.doc_id AS b, round(sum(a.w * b.w), 6) AS cosine FROM x a JOIN x b ON a.g = b.g AND a.term = b.term AND a.doc_id < b.doc_id GROUP BY ALL HAVING sum(a.w * b.w) > 0.7""")
def tfidf_cosine_pairs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumnRenamed("source", "g")
    v = sm.tfidf(sm.terms(d, "doc_id", "g", "text", fixed.STOPWORDS), "doc_id", "g")
    return r(sm.cosine_pairs(v, "doc_id", "g"), "cosine")


@query("""WITH t AS (SELECT conv_id, turn, list_distinct(string_split(lower(trim(text)), '')) AS s, CAST(nullif(regexp_extract(lower(trim(text)), '[0-9]+'), '') AS DOUBLE) AS n FROM conversations WHERE trim(text) <> ''),
p AS (SELECT a.conv_id, len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) AS j, CASE WHEN abs(a.n - b.n) <= greatest(a.n, b.n) * 0.2 THEN 0.8 END AS k FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn < b.turn),
u AS (SELECT conv_id, unnest([j, k]) AS x FROM p) SELECT c.conv_id, round(coalesce(avg(x), 0), 6) AS similarity FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN u USING (conv_id) GROUP BY 1""")
def option_jaccard(spark, sf_dir):
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list("text").alias("o"))
    return r(g.select("conv_id", tx.option_similarity(F.col("o")).alias("similarity")), "similarity")


@query("WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST((SELECT e FROM q) AS DOUBLE[])), 6) AS cosine FROM embeddings), o AS (SELECT * FROM s ORDER BY cosine DESC, vec_id LIMIT 20) SELECT * FROM o WHERE label = (SELECT label FROM embeddings WHERE vec_id = 0) ORDER BY cosine DESC, vec_id LIMIT 10")
def embedding_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    first = e.filter("vec_id = 0").first()
    return sm.nearest(e, first["embedding"], "vec_id", "embedding", 10, F.col("label") == first["label"]).select("vec_id", "label", "cosine")


TOPICS = [("t1", "a", "the", 1.5, 1), ("t1", "a", "and", 1.5, 1), ("t2", "b", "la", 0.3, 2), ("t2", "b", "de", 0.3, 2), ("RM_NV_t3", "b", "und", 0.6, 3), ("RM_NV_t3", "b", "s.", 0.6, 3)]
OLD_TOPICS = [("old1", "a", "re", 1.0, 1), ("old1", "a", "zq", 1.0, 1), ("old2", "b", "tion", 1.0, 2)]
KEYWORD_SQL = """WITH k(topic, section, keyword, weight, ord) AS (VALUES {new}), o(topic, section, keyword, weight, ord) AS (VALUES {old}), d AS (SELECT doc_id, lower(text) AS l, regexp_matches(lower(text), 'figure|shape') AS nv FROM documents),
h AS (SELECT doc_id, nv, 1 AS old, topic, section, weight, ord, keyword, l FROM d, o UNION ALL SELECT doc_id, nv, 0, topic, section, weight, ord, keyword, l FROM d, k),
p AS (SELECT *, CASE WHEN contains(l, keyword) THEN CASE WHEN regexp_matches(l, CASE WHEN regexp_matches(keyword, '^[a-z]') THEN '(?:^|[^\\p{{L}}\\p{{N}}_])' ELSE '[\\p{{L}}\\p{{N}}_]' END || replace(keyword, '.', '\\.') || CASE WHEN regexp_matches(keyword, '[a-z]$') THEN '(?:$|[^\\p{{L}}\\p{{N}}_])' ELSE '[\\p{{L}}\\p{{N}}_]' END) THEN 1.5 ELSE 1 END ELSE 0 END AS hit FROM h),
s AS (SELECT doc_id, old, ord, topic, section, least(sum(hit) / count(*) * 2 * any_value(weight), 1) AS plain, any_value(nv) AS nv FROM p GROUP BY doc_id, old, ord, topic, section),
b AS (SELECT doc_id, old, ord, topic, section, round(CASE WHEN nv AND old = 0 AND starts_with(topic, 'RM_NV_') THEN least(plain * 1.3, 1) ELSE plain END, 9) AS score FROM s),
r AS (SELECT doc_id, old, list(topic ORDER BY score DESC, ord) FILTER (score > 0) AS t, list(section ORDER BY score DESC, ord) FILTER (score > 0) AS c, max(score) AS top FROM b GROUP BY ALL),
w AS (SELECT n.doc_id, CASE WHEN n.top < 0.1 AND x.top > n.top THEN x ELSE n END AS z FROM r n JOIN r x ON n.doc_id = x.doc_id AND n.old = 0 AND x.old = 1)
SELECT doc_id, coalesce(z.t[1], 'unknown') AS topic, coalesce(z.c[1], 'unknown') AS topic_section, CAST(z.top AS DOUBLE) AS topic_score, coalesce(array_to_string(z.t[2:4], ','), '') AS alternates FROM w"""


@query(KEYWORD_SQL.format(new=", ".join(map(str, TOPICS)), old=", ".join(map(str, OLD_TOPICS))))
def keyword_topic_scorer(spark, sf_dir):
    new, old = (spark.createDataFrame(t, "topic string, section string, keyword string, weight double, ord int") for t in (TOPICS, OLD_TOPICS))
    figures = F.lower("text").rlike("figure|shape")
    return sm.keyword_topics(table(spark, sf_dir, "documents"), new, F.col("text"), boost=figures, fallback=old).select("doc_id", "topic", "topic_section", "topic_score", "alternates")


# --- evaluation ---
TRUTH = "WITH p AS (SELECT doc_id, CASE WHEN n_chars > 800 THEN 1 ELSE 0 END AS quality FROM documents) "


@query(TRUTH + "SELECT l.quality AS truth, count(*) AS n, count(p.quality) AS matched, count(*) FILTER (l.quality = p.quality) AS right, round(count(*) FILTER (l.quality = p.quality) / count(*), 6) AS accuracy FROM labels l LEFT JOIN p USING (doc_id) GROUP BY 1")
def accuracy_by_section(spark, sf_dir):
    p = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") > 800, 1).otherwise(0).alias("quality"))
    return r(ev.accuracy(table(spark, sf_dir, "labels"), p, "doc_id", "quality"), "accuracy")


@query(TRUTH + "SELECT l.quality AS truth, p.quality AS said, count(*) AS cnt FROM labels l JOIN p USING (doc_id) WHERE l.quality <> p.quality GROUP BY ALL ORDER BY cnt DESC, truth, said LIMIT 10")
def confusion(spark, sf_dir):
    p = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") > 800, 1).otherwise(0).alias("quality"))
    return ev.confusions(table(spark, sf_dir, "labels"), p, "doc_id", "quality")


@query(TRUTH + "SELECT p.quality AS level, count(*) AS n, round(1 - 0.5 * (1 - avg(CASE WHEN l.quality = p.quality THEN 1.0 ELSE 0.0 END)), 6) AS factor FROM labels l JOIN p USING (doc_id) GROUP BY 1")
def calibration_factor(spark, sf_dir):
    p = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") > 800, 1).otherwise(0).alias("level"))
    return r(ev.calibration(table(spark, sf_dir, "labels").join(p, "doc_id"), "level", F.col("quality") == F.col("level")), "factor")


@query("SELECT p_type AS g, round(quantile_cont(p_retailprice, 0.9), 6) AS p90, round(quantile_cont(p_retailprice, 0.95), 6) AS p95, round(avg(p_retailprice), 6) AS mean, round(stddev_pop(p_retailprice), 6) AS std, max(p_retailprice) AS most FROM part GROUP BY 1")
def percentile_limits(spark, sf_dir):
    return r(ev.limits(table(spark, sf_dir, "part").withColumnRenamed("p_type", "g"), ["g"], "p_retailprice"), "p90", "p95", "mean", "std")


@query("SELECT round(avg(abs(a - p)), 6) AS mae, round(sqrt(avg((a - p) * (a - p))), 6) AS rmse, round(1 - sum((a - p) * (a - p)) / (var_pop(a) * count(*)), 6) AS r2 FROM (SELECT l_extendedprice AS a, l_quantity * 1500 AS p FROM lineitem)")
def ensemble_metrics(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("a"), (F.col("l_quantity") * 1500).alias("p"))
    return r(ev.regression_metrics(d, "a", "p"), "mae", "rmse", "r2")


@query("SELECT round(avg(p_retailprice), 6) AS mean, round(median(p_retailprice), 6) AS median, round(stddev_pop(p_retailprice), 6) AS std, min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part")
def prediction_statistics(spark, sf_dir):
    return r(ev.prediction_statistics(table(spark, sf_dir, "part"), "p_retailprice"), "mean", "median", "std")


@query(PRED + "SELECT section, round(sum(v), 6) AS actual, max(quota) AS quota, round(100 * (1 - abs(sum(v) - max(quota)) / max(quota)), 6) AS accuracy FROM g GROUP BY section")
def quota_accuracy(spark, sf_dir):
    return r(ev.quota_accuracy(predictions(spark, sf_dir), "section", "v", "quota"), "actual", "accuracy")


@query(SERIES + ", y AS (SELECT topic, count(DISTINCT year) AS n_years FROM series GROUP BY 1) SELECT n_years, count(*) AS n_topics FROM y GROUP BY 1")
def coverage_histogram(spark, sf_dir):
    return ev.coverage(order_series(spark, sf_dir), "topic", "year")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL OR trim(CAST({c} AS VARCHAR)) = '') AS n_missing, count(DISTINCT {c}) AS n_distinct, count(*) AS n_rows FROM documents" for c in ("doc_id", "text", "lang", "source")))
def null_profile(spark, sf_dir):
    return ev.null_profile(table(spark, sf_dir, "documents"), ["doc_id", "text", "lang", "source"])


@query(NATION + "SELECT topic, year, cnt, round(m, 6) AS group_mean FROM (SELECT *, avg(cnt) OVER (PARTITION BY topic) AS m FROM series) WHERE cnt > 1.2 * m")
def anomalies(spark, sf_dir):
    return r(ev.anomalies(customer_series(spark, sf_dir), ["topic"], "cnt", 1.2), "group_mean")


@query("SELECT count(*) FILTER (l_quantity > 6) AS over_6, count(*) FILTER (l_quantity > 8) AS over_8 FROM lineitem")
def unrealistic_counts(spark, sf_dir):
    return ev.over(table(spark, sf_dir, "lineitem"), "l_quantity", [6, 8])


@query("SELECT unnest(json_keys(props)) AS key, count(*) AS cnt FROM events GROUP BY 1")
def json_key_profile(spark, sf_dir):
    return ev.json_keys(table(spark, sf_dir, "events"), "props")


@query(PAPER + "SELECT count(*) FILTER (confidence > 0.8) AS high, count(*) FILTER (confidence >= 0.6 AND confidence <= 0.8) AS medium, count(*) FILTER (confidence < 0.6) AS low, round(avg(confidence), 6) AS mean_confidence FROM paper")
def confidence_buckets(spark, sf_dir):
    return r(ev.confidence_buckets(paper_rows(spark, sf_dir), "confidence"), "mean_confidence")


SECDIFF = OBS + ", s AS (SELECT section, count(*) AS cnt, (count(*) FILTER (difficulty = 'hard') + 0.5 * count(*) FILTER (difficulty = 'medium')) / count(*) AS score FROM obs GROUP BY 1), l AS (SELECT *, CASE WHEN score > 0.6 THEN 'difficult' WHEN score > 0.4 THEN 'moderate' ELSE 'easy' END AS label FROM s), g AS (SELECT *, CAST(floor(round(25 * CASE label WHEN 'difficult' THEN 0.55 WHEN 'moderate' THEN 0.7 ELSE 0.85 END, 6)) AS BIGINT) AS good_attempts FROM l) "


@query(SECDIFF + "SELECT section, cnt, round(score, 6) AS score, label, good_attempts FROM g")
def section_difficulty(spark, sf_dir):
    return r(ev.section_difficulty(observations(spark, sf_dir), "section", "difficulty", 25), "score")


@query(SECDIFF + "SELECT round(avg(score), 6) AS score, CAST(sum(good_attempts) AS BIGINT) AS good_attempts, CAST(sum(cnt) AS BIGINT) AS cnt, CASE WHEN sum(good_attempts) / sum(cnt) >= 0.75 THEN 'easy' WHEN sum(good_attempts) / sum(cnt) >= 0.6 THEN 'moderate' ELSE 'difficult' END AS label FROM g")
def paper_difficulty(spark, sf_dir):
    return r(ev.paper_difficulty(ev.section_difficulty(observations(spark, sf_dir), "section", "difficulty", 25)), "score")


@query("WITH a AS (SELECT n_name AS feature, n_nationkey / 10.0 AS m FROM nation WHERE n_nationkey < 15), b AS (SELECT n_name AS feature, n_nationkey / 5.0 AS m FROM nation WHERE n_nationkey > 10) SELECT coalesce(a.feature, b.feature) AS feature, coalesce(a.m, 0) AS m0, coalesce(b.m, 0) AS m1, round((coalesce(a.m, 0) + coalesce(b.m, 0)) / 2, 6) AS mean_importance FROM a FULL JOIN b ON a.feature = b.feature")
def importance_full_outer(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    of = lambda cond, d: n.filter(cond).select(F.col("n_name").alias("feature"), (F.col("n_nationkey") / d).alias("importance"))
    return r(ev.mean_importance([of("n_nationkey < 15", 10.0), of("n_nationkey > 10", 5.0)]), "mean_importance")


# --- plans, models, streams ---


@query("WITH g AS (SELECT o_custkey, o_orderkey, year(o_orderdate) AS y FROM orders WHERE o_totalprice > 100000), c AS (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n FROM g) SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY y DESC, o_orderkey) AS INT) AS rank FROM c WHERE n >= 3 QUALIFY rank <= 5")
def practice_set(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("y", F.year("o_orderdate"))
    return st.practice_set(o, "o_custkey", "y", "o_orderkey", F.col("o_totalprice") > 100000).select("o_custkey", "o_orderkey", "rank")


@query()
def gbt_rf_ensemble(spark, sf_dir):
    f = ft.features13(customer_series(spark, sf_dir), ["topic"], 2001).fillna(0.0)
    model = pm.Ensemble(["avg", "recent", "trend", "std"], "hi", trees=3).fit(f.withColumn("hi", F.col("hi").cast("double")))
    return r(model.predict(f), "predicted").select("topic", "hi", "predicted")


@query()
def rf_importance(spark, sf_dir):
    f = ft.features13(customer_series(spark, sf_dir), ["topic"], 2001).fillna(0.0).withColumn("hi", F.col("hi").cast("double"))
    return r(pm.Ensemble(["avg", "recent", "trend", "std"], "hi", trees=3).fit(f).importances(spark), "importance")


@query("SELECT time_bucket(INTERVAL '7 days', ts, TIMESTAMP '1970-01-01') AS week_start, event_type, count(*) AS cnt, max(value) AS best, count(*) FILTER (value >= 0.7) AS n_strong FROM events GROUP BY ALL")
def weekly_digest(spark, sf_dir):
    return live.weekly_digest(table(spark, sf_dir, "events"), "ts", "event_type", "value").withColumn("week_start", F.col("week_start").cast("timestamp_ntz"))


@query("SELECT event_id, CAST(unnest([0, 1]) AS INT) AS pos, props AS value FROM events")
def json_recover(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("junk {"), F.col("props"), F.lit(", [1, "), F.col("props"), F.lit("] tail")).alias("text"))
    return rd.recover_json(e, "text", ["event_id"])


@query("SELECT doc_id, CAST(3 + CASE WHEN length(text) < 15 THEN 1 ELSE 0 END + CASE WHEN " + " OR ".join(f"regexp_matches(text, '{p}')" for p in fixed.FORMULAS) + " THEN 1 ELSE 0 END + CASE WHEN regexp_matches(lower(text), 'figure|diagram|table|graph|chart|above|below|given') THEN 1 ELSE 0 END AS BIGINT) AS n_issues FROM documents")
def review_issues(spark, sf_dir):
    issues = tx.review_issues(F.col("text"), F.lit(0), F.lit("unknown"), F.lit(0.1), F.lit(0.9))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(issues).cast("long").alias("n_issues"))


@query("SELECT p_partkey, '1) ' || p_brand || ' | 2) ' || p_type AS choices_text FROM part")
def training_format(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    q = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"), F.col("p_type").alias("section"), F.col("p_brand").alias("topic_code"), F.lit("easy").alias("difficulty"), F.array("p_brand", "p_type").alias("options"))
    return wr.training_rows(q).select(F.col("id").alias("p_partkey"), "choices_text")


@query("SELECT DISTINCT p_brand, p_type FROM part ORDER BY 1, 2")
def distinct_topics(spark, sf_dir):
    return rk.distinct_sorted(table(spark, sf_dir, "part"), "p_brand", "p_type")


@query("SELECT c_custkey, round(coalesce(m, c_acctbal), 6) AS capped FROM customer LEFT JOIN (SELECT o_custkey, min(o_totalprice) AS m FROM orders GROUP BY 1) o ON o_custkey = c_custkey")
def default_own_value(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("c_acctbal"))
    return r(rk.with_default(table(spark, sf_dir, "customer"), o, "c_custkey", "c_acctbal", "capped"), "capped").select("c_custkey", "capped")


@query("SELECT c_custkey, round(c_acctbal * CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 1.5 ELSE 1.0 END, 6) AS c_acctbal FROM customer")
def rising_boost(spark, sf_dir):
    chosen = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return r(rk.boosted(table(spark, sf_dir, "customer"), chosen, "c_custkey", "c_acctbal"), "c_acctbal").select("c_custkey", "c_acctbal")


@query("SELECT doc_id FROM documents WHERE trim(coalesce(lang, '')) <> '' AND upper(trim(lang)) <> 'UNKNOWN' AND trim(coalesce(source, '')) <> '' AND upper(trim(source)) <> 'UNKNOWN' AND length(trim(text)) >= 400 AND NOT contains(lower(text), 'placeholder')")
def valid_questions(spark, sf_dir):
    return rk.valid_rows(table(spark, sf_dir, "documents"), "text", "lang", "source", 400).select("doc_id")


@query(PRED + "SELECT topic, round(least(0.6 + 0.05 * want, 0.85), 6) AS simple, round(least(0.65 + 0.05 * want, 0.9), 6) AS weighted, round(least(0.6 + 0.05 * want + 0.1 * (1 - least(abs(v / 100), 0.5)), 0.9), 6) AS trend FROM g")
def confidence_formulas(spark, sf_dir):
    p = predictions(spark, sf_dir)
    return p.select("topic", *(F.round(rk.confidence(F.col("want"), F.col("v") / 100, k), 6).alias(k) for k in ("simple", "weighted", "trend")))


@query("WITH s AS (SELECT CASE l_returnflag WHEN 'A' THEN 'easy' ELSE 'medium' END AS difficulty, count(*) * 1.0 / (SELECT count(*) FROM lineitem) AS share FROM lineitem GROUP BY 1) SELECT d.difficulty, round(coalesce(share, d.x), 6) AS share FROM (VALUES ('easy', 0.3), ('medium', 0.5), ('hard', 0.2)) d(difficulty, x) LEFT JOIN s USING (difficulty)")
def default_shares(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_returnflag") == "A", "easy").otherwise("medium").alias("difficulty"))
    s = fq.share(fq.counts(li, "difficulty"), "cnt", [], "share", 1.0)
    return r(rk.or_default_shares(s, "difficulty", "share", {"easy": 0.3, "medium": 0.5, "hard": 0.2}), "share")


@query("WITH c AS (SELECT event_type, count(*) AS cnt, count(*) FILTER (value >= 0.7) AS n_strong FROM events GROUP BY 1) SELECT * FROM c")
def category_counts(spark, sf_dir):
    return rk.category_counts(table(spark, sf_dir, "events"), "event_type", "value")


@query("SELECT p_partkey, instr(p_brand, regexp_extract(p_brand, '[0-9]+')) - 1 AS start, instr(p_brand, regexp_extract(p_brand, '[0-9]+')) - 1 + length(regexp_extract(p_brand, '[0-9]+')) AS \"end\", regexp_extract(p_brand, '[0-9]+') AS match FROM part")
def match_places(spark, sf_dir):
    return mt.match_places(table(spark, sf_dir, "part"), "p_partkey", "p_brand", "[0-9]+")


from . import queries_files, queries_models, queries_papers, queries_text, queries_vectors  # noqa: E402, F401  (they register themselves)
