"""Queries over papers made of parts, and over small texts: extraction, templates, plans, injected models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import fixed, matching as mt, text as tx
from .operators import allocate as al
from .operators import evaluate as ev
from .operators import extract as ex
from .operators import features as ft
from .operators import frequency as fq
from .operators import mining as mn
from .operators import rank as rk
from .operators import trend as tr
from .plans import models as pm
from .plans import study as st
from .queries import NATION, OBS, ORACLES, PRED, SERIES, customer_series, observations, order_series, predictions, query, r, table


def listed(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


# --- papers: 60 parts each, numbered 1, 4, 5, 8, 9, .. in one of three forms ---
def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """paper, n, mark, ask, opts, section, p_partkey."""
    k, j = F.col("p_partkey"), F.col("p_partkey") % 60
    n = (2 * j + 1 + j % 2).cast("int")
    paper = F.floor(k / 60)
    p = table(spark, sf_dir, "part").select("p_partkey", paper.alias("paper"), n.alias("n"), F.col("p_type").alias("section"), "p_brand", "p_name", "p_size")
    mark = F.when(paper % 3 == 0, F.concat(F.lit("Q"), n, F.lit(". "))).when(paper % 3 == 1, F.concat(n, F.lit(". "))).otherwise(F.concat(F.lit("("), n, F.lit(") ")))
    ask = F.when(k % 6 == 0, F.concat(F.lit("Match the column of "), "p_brand", F.lit(" and "), "p_name")).when(k % 5 == 0, F.concat(F.lit("Which figure is "), "p_name")).otherwise(F.concat(F.lit("What is the "), "p_name", F.lit(" of "), "p_brand"))
    opts = F.concat(F.lit("(a) "), "section", F.lit(" (b) "), "p_size", F.lit(" (c) red (d) blue"))
    return p.select("p_partkey", "paper", "n", "section", mark.alias("mark"), F.concat(ask, F.lit("?")).alias("ask"), opts.alias("opts"), "p_size")


ASKED = """WITH q AS (SELECT p_partkey, p_partkey // 60 AS paper, CAST(2 * (p_partkey % 60) + 1 + p_partkey % 60 % 2 AS INT) AS n, p_type AS section, p_size,
CASE WHEN p_partkey % 6 = 0 THEN 'Match the column of ' || p_brand || ' and ' || p_name WHEN p_partkey % 5 = 0 THEN 'Which figure is ' || p_name ELSE 'What is the ' || p_name || ' of ' || p_brand END || '?' AS ask, '(a) ' || p_type || ' (b) ' || p_size || ' (c) red (d) blue' AS opts FROM part),
m AS (SELECT *, CASE paper % 3 WHEN 0 THEN 'Q' || n || '. ' WHEN 1 THEN n || '. ' ELSE '(' || n || ') ' END AS mark FROM q),
t AS (SELECT paper, string_agg(mark || ask || chr(10) || opts || chr(10), chr(10) ORDER BY n) AS text FROM m GROUP BY paper) """


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """paper, text."""
    q = questions(spark, sf_dir).select("paper", "n", F.concat("mark", "ask", F.lit("\n"), "opts", F.lit("\n")).alias("t"))
    return q.groupBy("paper").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "t"))), lambda x: x["t"]), "\n").alias("text"))


@query(ASKED + "SELECT paper, n AS qnum, section || '|' || p_size || '|red|blue' AS options, ask AS question, 1.0::DOUBLE AS confidence FROM m")
def mcq_extract(spark, sf_dir):
    q = ex.extract_paper(papers(spark, sf_dir), "paper", "text")
    return q.select("paper", "qnum", F.array_join("options", "|").alias("options"), ex.clean_body(F.col("body")).alias("question"), "confidence")


@query("WITH p AS (SELECT doc_id, unnest(string_split_regex(trim(text, chr(32) || chr(9) || chr(10) || chr(13)), '\\n\\s*\\n')) AS b FROM documents WHERE NOT regexp_matches(text, '(?m)^\\s*(Q(uestion)?\\.?\\s*\\d{1,3}\\s*[.):-]|\\d{1,3}\\s*[.)]\\s+\\S|\\(\\d{1,3}\\)\\s+\\S)')) SELECT doc_id, count(*) AS n_blocks, max(0.4::DOUBLE) AS most FROM p WHERE trim(b, chr(32) || chr(9) || chr(10) || chr(13)) <> '' GROUP BY doc_id HAVING count(*) > 0")
def unnumbered_blocks(spark, sf_dir):
    """Documents without question marks are cut at blank lines."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    q = ex.split_questions(d, "doc_id", "text").filter("qnum IS NULL")
    return q.groupBy("doc_id").agg(F.count("*").alias("n_blocks"), F.max(F.greatest("confidence", F.lit(0.4))).alias("most"))


@query(ASKED + "SELECT paper, n AS qnum, CAST(greatest(strpos(t.text, m.mark || m.ask) - 2, 0) AS INT) AS start FROM m JOIN t USING (paper)")
def question_places(spark, sf_dir):
    return ex.boundaries(papers(spark, sf_dir), "paper", "text").select("paper", "qnum", "start")


@query(ASKED + "SELECT paper, n AS qnum, md5(mark || ask || chr(10) || opts || chr(10)) AS body FROM m WHERE paper % 3 < 2")
def line_states(spark, sf_dir):
    return ex.line_states(papers(spark, sf_dir), "paper", "text").select("paper", "qnum", F.md5("body").alias("body"))


@query(ASKED + "SELECT paper, CAST(3 * (row_number() OVER (PARTITION BY paper ORDER BY n) - 1) AS INT) AS line, true AS has_options FROM m QUALIFY regexp_matches(lower(ask), 'figure|pattern|shape|rotat')")
def figure_candidates(spark, sf_dir):
    return ex.figure_candidates(papers(spark, sf_dir), "paper", "text").select("paper", "line", "has_options")


@query(ASKED + "SELECT paper, CAST(row_number() OVER (PARTITION BY paper ORDER BY n) - 1 AS INT) AS pos, ask || chr(10) || opts AS block FROM m WHERE starts_with(ask, 'Match')")
def match_blocks(spark, sf_dir):
    return ex.match_blocks(papers(spark, sf_dir), "paper", "text")


ZONES = " CASE WHEN k BETWEEN 1 AND 30 THEN 'verbal_ability' WHEN k BETWEEN 31 AND 55 THEN 'general_awareness' WHEN k BETWEEN 56 AND 80 THEN 'reasoning' WHEN k BETWEEN 81 AND 100 THEN 'numerical_ability' END "


@query(ASKED + f"SELECT paper, CAST(k AS INT) AS n, {ZONES} AS section, CASE WHEN k < most THEN 0.2 ELSE 0.1 END::DOUBLE AS confidence FROM (SELECT paper, max(n) AS most, unnest(range(1, 126)) AS k FROM m GROUP BY paper) x WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.paper = x.paper AND m.n = x.k)")
def placeholders(spark, sf_dir):
    zones = spark.createDataFrame(fixed.ZONES, "zone string, lo int, hi int")
    return ex.placeholders(questions(spark, sf_dir).select("paper", "n"), zones, ["paper"], "n", 125).select("paper", "n", "section", "confidence")


@query(ASKED + """, c AS (SELECT paper, section, count(*) AS c FROM m GROUP BY ALL), z AS (SELECT paper, arg_min(section, (-c, section)) AS main, sum(c) AS n_rows FROM c GROUP BY paper)
SELECT p_partkey, CASE WHEN n_rows < 80 THEN main ELSE section END AS section, CASE WHEN n_rows < 80 AND section <> main THEN 'Inferred ' || main ELSE 'own' END AS topic, CASE WHEN n_rows < 80 AND section <> main THEN 0.35 ELSE 0.6 END::DOUBLE AS confidence FROM m JOIN z USING (paper)""")
def relabelled_small_papers(spark, sf_dir):
    q = questions(spark, sf_dir).select("p_partkey", "paper", "section", F.lit("own").alias("topic"), F.lit(0.6).alias("confidence"))
    return ex.with_relabelled_small_papers(q, ["paper"], "section", "confidence").select("p_partkey", "section", "topic", "confidence")


@query(ASKED + r"""SELECT paper, CASE WHEN len(regexp_extract_all(h, '(?m)^\s*Q\.?\s*\d+')) > 10 THEN 'q_numbered' WHEN len(regexp_extract_all(h, '(?m)^\s*\d{1,3}\s*\.')) > 10 THEN 'dot_numbered' WHEN len(regexp_extract_all(h, '(?m)^\s*\d{1,3}\s*\)')) > 10 THEN 'paren_numbered' WHEN regexp_matches(h, '(?i)section\s*[-:]?\s*[a-d1-4]') THEN 'sectioned' ELSE 'unknown' END AS format FROM (SELECT paper, substr(text, 1, 5000) AS h FROM t)""")
def paper_format(spark, sf_dir):
    return papers(spark, sf_dir).select("paper", ex.paper_format(F.col("text")).alias("format"))


@query(ASKED + "SELECT section, n, unnest(['similar values', 'common mistakes']) AS kind FROM (SELECT section, count(*) AS n FROM m WHERE paper % 2 = 0 GROUP BY section HAVING count(*) >= 3)")
def distractors(spark, sf_dir):
    q = questions(spark, sf_dir).withColumn("options", F.when(F.col("paper") % 2 == 0, F.split("opts", r" \(")).otherwise(F.array(F.lit("x"))))
    return mn.distractors(q, "section", "options")


# --- small texts ---
def trains(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    t = F.concat(F.lit("A train x goes "), s, F.lit(" km in "), k % 50 + 51, F.lit(" hours for Rs. "), s + 200, F.lit(" at "), k % 9 + 301, F.lit("% off, 3/4 = 7:"), k % 5 + 1, F.lit(" pi"))
    return table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size", t.alias("t"))


TRAINS = "WITH t AS (SELECT p_partkey, p_type, p_size, 'A train x goes ' || p_size || ' km in ' || (p_partkey % 50 + 51) || ' hours for Rs. ' || (p_size + 200) || ' at ' || (p_partkey % 9 + 301) || '% off, 3/4 = 7:' || (p_partkey % 5 + 1) || ' pi' AS t FROM part) "


@query(TRAINS + "SELECT p_partkey, replace(replace(t, ' x ', ' × '), 'pi', 'π') AS notation, true AS formula, 'division|percentage' AS operations, lower(regexp_replace(p_type, '[^a-zA-Z0-9]+', '_', 'g')) AS slug, concat_ws('|', p_size || '.0', (p_partkey % 50 + 51) || '.0', (p_size + 200) || '.0', (p_partkey % 9 + 301) || '.0', '0.75', '7.0', (p_partkey % 5 + 1) || '.0') AS numbers FROM t")
def text_values(spark, sf_dir):
    t = F.col("t")
    told = F.array_join(F.transform(tx.numbers(t), lambda x: x.cast("string")), "|")
    return trains(spark, sf_dir).select("p_partkey", tx.math_notation(t).alias("notation"), tx.has_formula(t).alias("formula"), F.array_join(tx.operations(t), "|").alias("operations"), tx.slug(F.col("p_type")).alias("slug"), told.alias("numbers"))


@query(TRAINS + """, u AS (SELECT p_type AS g, unnest([{'u': 'distance', 'v': p_size}, {'u': 'time', 'v': p_partkey % 50 + 51}, {'u': 'money', 'v': p_size + 200}, {'u': 'percentage', 'v': p_partkey % 9 + 301}, {'u': 'ratio', 'v': 7}, {'u': 'ratio', 'v': p_partkey % 5 + 1}]) AS x FROM t),
c AS (SELECT g, x.u AS unit, CAST(x.v AS DOUBLE) AS v, count(*) AS cnt FROM u GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY g, unit ORDER BY cnt DESC, v) AS rn FROM c)
SELECT g, unit, CAST(sum(cnt) AS BIGINT) AS cnt, count(*) AS n_distinct, min(v) AS lo, max(v) AS hi, string_agg(CAST(v AS VARCHAR), '|' ORDER BY rn) FILTER (rn <= 5) AS common FROM k GROUP BY g, unit""")
def unit_numbers(spark, sf_dir):
    u = mn.unit_numbers(trains(spark, sf_dir).withColumnRenamed("p_type", "g"), "g", "t")
    return u.withColumn("common", F.array_join(F.transform("common", lambda x: x.cast("string")), "|"))


@query("SELECT p_partkey, 'A train goes 1_distance km in 1_time hours for Rs. Rs. {1_amount and 2_time days' AS template FROM part")
def typed_templates(spark, sf_dir):
    k = F.col("p_partkey")
    t = F.concat(F.lit("A train goes "), F.col("p_size"), F.lit(" km in "), k + 1_000_000, F.lit(" hours for Rs. "), k + 3_000_000, F.lit(" and 7777777 days"))
    return table(spark, sf_dir, "part").select("p_partkey", mt.template_of(t).alias("template"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey BETWEEN 1 AND 20 THEN CAST(n_nationkey AS INT) END AS roman FROM nation")
def roman_numbers(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", tx.roman_number(F.get(F.array(*map(F.lit, ["", *fixed.ROMAN, "xxi", "abc"])), F.col("n_nationkey").cast("int"))).alias("roman"))


@query("SELECT c_custkey, 'Date: 12 March ' || (2000 + c_custkey % 25) || '|' || (c_custkey % 90 + 1) || ' crore|Name: Brave Pilot|Name: New Town' AS facts FROM customer")
def key_facts(spark, sf_dir):
    k = F.col("c_custkey")
    t = F.concat(F.lit("On 12 March "), F.lit(2000) + k % 25, F.lit(" the Brave Pilot paid "), k % 90 + 1, F.lit("crore in New Town to the Brave Pilot"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(tx.key_facts(t), "|").alias("facts"))


@query("SELECT p_partkey, CASE WHEN p_brand IN ('Brand#11', 'Brand#12') THEN 'hard' WHEN p_brand = 'Brand#21' THEN 'easy' WHEN p_type LIKE 'S%' THEN 'hard' ELSE 'medium' END AS rule, CASE WHEN p_size >= 3 THEN 'high' WHEN p_size = 2 THEN 'medium' WHEN p_size = 1 THEN 'low' ELSE 'none' END AS priority, CASE WHEN p_size >= 3 THEN 0 WHEN p_size = 2 THEN 1 WHEN p_size = 1 THEN 2 ELSE 3 END AS place FROM part")
def rules_and_priorities(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    kind = F.substring("p_type", 1, 1)
    priority = tx.review_priority(F.col("p_size"))
    return p.select("p_partkey", ev.rule_difficulty(F.col("p_brand"), kind, ["Brand#11", "Brand#12"], ["Brand#21"], {"S": "hard"}).alias("rule"), priority.alias("priority"), rk.severity_order(priority).alias("place"))


@query("WITH p AS (SELECT conv_id, turn // 3 AS page, string_agg(role, chr(10) ORDER BY turn) AS t FROM conversations GROUP BY ALL) SELECT conv_id, string_agg('--- page ' || page || ' ---' || chr(10) || t, chr(10) ORDER BY page) AS full_text FROM p GROUP BY conv_id")
def page_text(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", F.floor(F.col("turn") / 3).cast("int").alias("page"), F.col("turn").alias("y"), F.lit(0).alias("x"), F.col("role").alias("t"))
    return rk.page_text(c, ["conv_id"], "page", "y", "x", "t")


@query("SELECT doc_id, round(score, 6) AS score, CASE WHEN score < 0.35 THEN 'easy' WHEN score < 0.6 THEN 'medium' ELSE 'hard' END AS level, CASE WHEN score < 0.25 OR score > 0.7 THEN 0.85 WHEN score < 0.35 OR score > 0.6 THEN 0.75 ELSE 0.65 END::DOUBLE AS confidence FROM (SELECT doc_id, round(CASE WHEN w > 50 THEN 0.2 WHEN w > 30 THEN 0.15 WHEN w > 15 THEN 0.1 ELSE 0.05 END + least(CASE WHEN ops >= 4 THEN 0.25 WHEN ops >= 2 THEN 0.15 WHEN ops >= 1 THEN 0.1 ELSE 0 END + CASE WHEN nums >= 6 THEN 0.1 WHEN nums >= 3 THEN 0.05 ELSE 0 END, 0.25) + CASE WHEN steps THEN 0.15 ELSE 0 END + 0.35 * 0.5 + least(hits * 2.0 / greatest(n, 1), 0.1), 9) AS score FROM (SELECT doc_id, CASE WHEN trim(x) = '' THEN 0 ELSE len(string_split(trim(x), ' ')) END AS w, len(regexp_extract_all(text, '[+\\-×÷*/^%=<>]')) AS ops, len(regexp_extract_all(text, '[0-9]+')) AS nums, " + " OR ".join(f"contains(lower(text), '{s}')" for s in fixed.STEP_WORDS) + " AS steps, len(ws) AS n, len(list_filter(ws, lambda y: regexp_replace(y, '^[.,!?;:]+|[.,!?;:]+$', '', 'g') IN (" + listed(fixed.COMPLEX_WORDS) + "))) AS hits FROM (SELECT doc_id, text, regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g') AS x, list_filter(string_split_regex(lower(text), '[ \\t\\n\\x0B\\f\\r]+'), lambda y: y <> '') AS ws FROM documents)))")
def difficulty_levels(spark, sf_dir):
    score, level, sure = tx.difficulty(F.col("text"), F.array().cast("array<string>"), F.lit(0.5))
    return table(spark, sf_dir, "documents").select("doc_id", F.round(score, 6).alias("score"), level.alias("level"), sure.alias("confidence"))


@query(f"""WITH kw AS (SELECT lang, string_agg(term, ',' ORDER BY rank) AS keywords FROM ({ORACLES['keyword_topn_by_lang']}) GROUP BY 1), ph AS (SELECT lang, string_agg(phrase, ',' ORDER BY rank) AS phrases FROM ({ORACLES['bigram_counts']}) GROUP BY 1),
x AS (SELECT lang, regexp_replace(text, '[0-9]+(\\.[0-9]+)?', 'N', 'g') AS template, count(*) AS cnt, min(doc_id) AS first_id FROM documents GROUP BY ALL), y AS (SELECT *, count(*) OVER (PARTITION BY lang) AS n FROM x), z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY cnt DESC, first_id) AS rn FROM y WHERE cnt >= 2 OR n < 5),
tm AS (SELECT lang, md5(string_agg(template, '|' ORDER BY rn)) AS templates FROM z WHERE rn <= 10 GROUP BY lang), s AS (SELECT lang, kind, count(*) AS c FROM documents JOIN ({ORACLES['starter_types']}) USING (doc_id) GROUP BY ALL), k AS (SELECT lang, '{{' || string_agg('"' || kind || '":' || c, ',' ORDER BY kind) || '}}' AS kinds, CAST(sum(c) AS BIGINT) AS n_texts FROM s GROUP BY lang)
SELECT lang, kinds, n_texts, keywords, phrases, templates FROM k LEFT JOIN kw USING (lang) LEFT JOIN ph USING (lang) LEFT JOIN tm USING (lang)""")
def topic_bundle(spark, sf_dir):
    b = mn.topic_bundle(table(spark, sf_dir, "documents"), "doc_id", "lang", "text")
    return b.select("lang", F.to_json("kinds").alias("kinds"), "n_texts", F.array_join("keywords", ",").alias("keywords"), F.array_join("phrases", ",").alias("phrases"), F.md5(F.array_join("templates", "|")).alias("templates"))


# --- plans ---
@query(f"""SELECT topic, trend, slope, p, alternates, strength, detected, break_year, f_line, line_low, line_high FROM ({ORACLES['slope_pvalue']}) FULL JOIN (SELECT topic, alternates, strength FROM ({ORACLES['alternation_ttest']})) USING (topic) LEFT JOIN ({ORACLES['structural_break']}) USING (topic) JOIN ({ORACLES['forecast_methods']}) USING (topic)""")
def trend_report(spark, sf_dir):
    return tr.trend_report(fq.dense(customer_series(spark, sf_dir), ["topic"]), ["topic"])


@query(f"SELECT topic, trend_ratio FROM ({ORACLES['series_stats']}) WHERE trend = 'stable'")
def trend_filter(spark, sf_dir):
    return r(tr.trend_filter(ft.series_stats(order_series(spark, sf_dir), ["topic"]), "stable", "trend_ratio"), "trend_ratio").select("topic", "trend_ratio")


@query(PRED + """, p AS (SELECT 's' || section AS section, topic, v, (row_number() OVER (PARTITION BY section ORDER BY v DESC, topic) - 1) // 2 AS rd FROM g WHERE section < 4), d AS (SELECT CAST(range AS INT) AS day, 's' || ((range - 1) % 4) AS section, (range - 1) // 4 AS rd FROM range(1, 21))
SELECT d.day, d.section, p.topic, round(p.v, 6) AS v, CAST((d.day - 1) * 4 // 20 + 1 AS INT) AS phase FROM d LEFT JOIN p USING (section, rd)""")
def study_plan_20day(spark, sf_dir):
    p = predictions(spark, sf_dir).withColumn("section", F.concat(F.lit("s"), "section"))
    return r(st.cycle_plan(p, "section", "topic", "v", ["s0", "s1", "s2", "s3"]), "v")


@query("""WITH c AS (SELECT p_type AS section, p_brand AS topic, count(*) AS supply, length(p_brand) AS place FROM part GROUP BY ALL), b AS (SELECT *, least(2, supply) AS w FROM c), f AS (SELECT *, greatest(0, least(w, 20 - coalesce(sum(w) OVER (PARTITION BY section ORDER BY place, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS given FROM b),
d AS (SELECT p_partkey, p_type AS section, p_brand AS topic, row_number() OVER (PARTITION BY p_type, p_brand ORDER BY md5(p_partkey || ':42'), p_partkey) AS d FROM part)
SELECT p_partkey, section, topic, CAST(place AS INT) AS place, CAST(row_number() OVER (PARTITION BY section ORDER BY place, topic, d) AS INT) AS number FROM d JOIN f USING (section, topic) WHERE d <= given""")
def mock_blueprint(spark, sf_dir):
    pool = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("section"), F.col("p_brand").alias("topic"))
    wants = pool.select("section", "topic").distinct().withColumn("want", F.lit(2)).withColumn("place", F.length("topic"))
    return st.mock_test(pool, wants, "topic", "section", F.lit(20), "p_partkey").select("p_partkey", "section", "topic", "place", "number")


@query(OBS + ", c AS (SELECT section, topic, count(*) AS cnt FROM obs GROUP BY ALL), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY section ORDER BY cnt DESC, topic) AS INT) AS rank FROM c QUALIFY rank <= 10), n AS (SELECT *, count(*) FILTER (cnt >= 2) OVER (PARTITION BY section) AS n FROM k) SELECT section, topic, cnt, rank FROM n WHERE cnt >= 2 OR (n = 0 AND rank <= 5)")
def certain_topics(spark, sf_dir):
    return st.certain_topics(fq.counts(observations(spark, sf_dir), "section", "topic"), "section", "topic", "cnt")


STATS = """, o AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY year DESC) AS b, count(*) OVER (PARTITION BY topic) AS n FROM series), g AS (SELECT topic, sum(cnt) AS total, avg(cnt) AS a, avg(cnt) FILTER (b <= 2) AS r, avg(cnt) FILTER (b > 2) AS q, max(n) AS n, sum(cnt * pow(0.5, b - 1)) / sum(pow(0.5, b - 1)) AS x FROM o GROUP BY topic),
h AS (SELECT *, CASE WHEN n >= 3 AND q > 0 THEN (r - q) / q ELSE 0.0 END AS c FROM g), s AS (SELECT *, CASE WHEN c > 0.15 THEN 'rising' WHEN c < -0.15 THEN 'declining' ELSE 'stable' END AS trend, topic % 5 AS section FROM h) """


@query(NATION + STATS + "SELECT section, count(*) AS n_topics, round(avg(a), 6) AS mean_avg, CAST(sum(total) AS BIGINT) AS total, arg_min(topic, (-total, topic)) AS top_topic, coalesce(string_agg(CAST(topic AS VARCHAR), ',' ORDER BY CAST(topic AS VARCHAR)) FILTER (trend = 'rising'), '') AS rising, coalesce(string_agg(CAST(topic AS VARCHAR), ',' ORDER BY CAST(topic AS VARCHAR)) FILTER (trend = 'declining'), '') AS declining FROM s GROUP BY section")
def section_statistics(spark, sf_dir):
    s = ft.series_stats(customer_series(spark, sf_dir), ["topic"]).withColumn("section", F.col("topic") % 5)
    s = s.withColumn("name", F.col("topic").cast("string"))
    out = fq.section_statistics(s.drop("topic").withColumnRenamed("name", "topic"), "section", "topic", "trend")
    best = s.groupBy("section").agg(F.min_by("topic", F.struct(-F.col("total"), F.col("topic"))).alias("best"))
    return r(out.drop("top_topic").join(best.withColumnRenamed("best", "top_topic"), "section"), "mean_avg")


@query(NATION + STATS + """, p AS (SELECT *, CASE section WHEN 0 THEN 'numerical_ability' WHEN 1 THEN 'general_awareness' ELSE 'reasoning' END AS sec FROM s), f AS (SELECT *, CASE sec WHEN 'numerical_ability' THEN 0.6 WHEN 'general_awareness' THEN 0.4 ELSE 0.5 END AS hard FROM p),
z AS (SELECT *, round(a * CASE trend WHEN 'rising' THEN 1.2 WHEN 'declining' THEN 0.8 ELSE 1 END * (3 * (1 - hard) - hard), 2) AS roi FROM f)
SELECT topic, sec AS section, round(greatest(x * (1 + c), 0), 1) AS predicted, round(least(0.6 + 0.05 * n + 0.1 * (1 - least(abs(c), 0.5)), 0.9), 2)::DOUBLE AS confidence, trend, roi, CASE WHEN hard > 0.55 THEN 'high' WHEN hard < 0.45 THEN 'low' ELSE 'medium' END AS difficulty, round(CASE WHEN roi > 0 THEN 200 * roi / sum(greatest(roi, 0)) OVER () ELSE 0 END, 1) AS hours FROM z ORDER BY roi DESC, topic LIMIT 15""")
def roi_study_plan(spark, sf_dir):
    s = customer_series(spark, sf_dir)
    section = F.when(F.col("topic") % 5 == 0, "numerical_ability").when(F.col("topic") % 5 == 1, "general_awareness").otherwise("reasoning")
    return st.roi_plan(s.withColumn("pos", F.col("topic")).withColumn("section", section)).drop("pos")


@query(PRED + "SELECT section, round(sum(v), 6) AS total, round(avg(want / 1000.0), 6) AS mean_confidence, string_agg(topic || ':' || rank || ':s' || topic || '/t' || topic, ',' ORDER BY rank) AS topics FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY v DESC, topic) AS rank FROM g) GROUP BY section")
def final_predictions(spark, sf_dir):
    p = predictions(spark, sf_dir).select("section", "topic", F.col("v").alias("predicted"), (F.col("want") / 1000.0).alias("confidence"))
    samples = p.select("section", "topic", F.explode(F.array(F.concat(F.lit("t"), "topic"), F.concat(F.lit("s"), "topic"))).alias("sample"))
    told = F.array_join(F.transform("topics", lambda t: F.concat_ws(":", t["topic"], t["rank"], F.array_join(t["samples"], "/"))), ",")
    return st.final_predictions(p, samples, "section", "topic").select("section", "total", "mean_confidence", told.alias("topics"))


@query(PRED + "SELECT topic, CASE WHEN section = 0 AND v >= 3 THEN 'Focus: many questions and rising' WHEN section = 0 THEN 'Prepare: rising' WHEN v >= 3 THEN 'Core topic: keep in practice' WHEN topic % 4 >= 2 THEN 'Revise briefly: dormant' ELSE 'Cover the basics' END AS advice FROM g")
def study_advice(spark, sf_dir):
    trend = F.when(F.col("section") == 0, "rising").otherwise("stable")
    return predictions(spark, sf_dir).select("topic", al.advice(trend, F.col("v"), F.col("topic") % 4).alias("advice"))


# --- injected models ---
@query("SELECT doc_id, CASE WHEN length(text) >= 400 THEN 'long' WHEN length(text) % 2 = 0 THEN 'even' ELSE 'start' END AS label, CASE WHEN length(text) >= 400 THEN 0.9 WHEN length(text) % 2 = 0 THEN 0.7 ELSE 0.5 END::DOUBLE AS confidence FROM documents")
def model_cascade(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.lit("start").alias("label"), F.lit(0.5).alias("confidence"))
    steps = [(0.6, lambda ts: [("even", 0.7) if len(t) % 2 == 0 else ("odd", 0.4) for t in ts]), (0.8, lambda ts: [("long", 0.9) if len(t) >= 400 else ("short", 0.2) for t in ts])]
    return pm.cascade(d, "doc_id", "text", "label", "confidence", steps).select("doc_id", "label", "confidence")


@query("SELECT doc_id, 'unknown' AS said, 0.0::DOUBLE AS said_confidence FROM documents")
def silent_model(spark, sf_dir):
    return pm.call_model(table(spark, sf_dir, "documents"), "doc_id", "text", pm.silent)


@query("""WITH w AS (SELECT p_type AS section, p_brand AS topic, count(*) AS want, list(p_name ORDER BY p_name)[1:3] AS s FROM part GROUP BY ALL)
SELECT section, topic, 'Write ' || want || ' questions on ' || topic || ' for ' || section || '.' || chr(10) || 'Examples:' || chr(10) || array_to_string(s, chr(10)) || chr(10) || 'Answer with JSON: {"question": .., "options": [..], "answer": "A"}' AS prompt FROM w""")
def generation_prompts(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_type").alias("section"), F.col("p_brand").alias("topic"), F.col("p_name").alias("sample"))
    return pm.prompts(p.groupBy("section", "topic").agg(F.count("*").alias("want")), p, "section", "topic")


@query("SELECT p_partkey, 'q ' || p_name AS question, CASE WHEN p_partkey % 5 = 4 THEN NULL WHEN p_partkey % 5 = 3 AND p_partkey % 3 = 0 THEN NULL ELSE ['a', 'b', 'c', 'd'][p_partkey % 5 + 1] END AS right_option, p_partkey % 3 <> 0 AND p_partkey % 5 < 4 AS valid FROM part")
def parsed_answers(spark, sf_dir):
    k = F.col("p_partkey")
    options = F.when(k % 3 == 0, '"(A) a", "(B) b", "(C) c"').otherwise('"(A) a", "(B) b", "(C) c", "(D) d"')
    answer = F.concat(F.lit('Sure:\n```json\n{"question": "q '), "p_name", F.lit('", "options": ['), options, F.lit('], "answer": "'), F.get(F.array(*map(F.lit, "AbCdE")), (k % 5).cast("int")), F.lit('"}\n```'))
    return pm.parsed_answers(table(spark, sf_dir, "part").select("p_partkey", "p_name", answer.alias("said")), "said").select("p_partkey", "question", "right_option", "valid")


@query("SELECT p_partkey, true AS in_range FROM part")
def filled_templates(spark, sf_dir):
    """Templates filled with numbers by hash: every one lies in its range."""
    got = pm.filled_template(F.lit("N men dig N m in N days"), F.col("p_partkey"), 10, 40)
    parts = F.regexp_extract_all(got, F.lit(r"^(\d+) men dig (\d+) m in (\d+) days$"), F.lit(0))
    return table(spark, sf_dir, "part").select("p_partkey", ((F.size(parts) == 1) & F.forall(tx.numbers(got), lambda x: x.between(10, 40)) & (F.size(tx.numbers(got)) == 3)).alias("in_range"))


@query("SELECT count(*) AS n_rows, 0::BIGINT AS n_both, true AS near_80 FROM orders")
def hash_split(spark, sf_dir):
    a, b = pm.hash_split(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
    both = a.withColumn("side", F.lit(1)).unionByName(b.withColumn("side", F.lit(2))).groupBy("o_orderkey").agg(F.count("*").alias("n"), F.min("side").alias("side"))
    return both.agg(F.sum("n").alias("n_rows"), F.count_if(F.col("n") > 1).alias("n_both"), F.avg((F.col("side") == 1).cast("int")).between(0.75, 0.85).alias("near_80"))


@query()
def permutation_importances(spark, sf_dir):
    f = ft.features13(customer_series(spark, sf_dir), ["topic"], 2001).fillna(0.0).withColumn("hi", F.col("hi").cast("double"))
    model = pm.Ensemble(["avg", "recent"], "hi", trees=2).fit(f)
    return spark.createDataFrame([(k, round(float(v), 6)) for k, v in pm.permutation_importance(model, f, "topic").items()], "feature string, rise double")


@query()
def difficulty_model(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("label"), F.year("l_shipdate").cast("double").alias("year"), "l_quantity", "l_discount")
    model = pm.difficulty_classifier(d, ["year", "l_quantity", "l_discount"], "label", folds=2)
    return model.transform(d.withColumn("__w", F.lit(1.0))).groupBy("label").agg(F.count("*").alias("n"), F.avg((F.col("__y") == F.col("prediction")).cast("int")).alias("right"))
