"""Queries over whole papers, made of parts in every form of marks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import fixed
from .operators import papers as pp
from .queries import query, table

#: 25 parts a paper, in one of eight forms: `n.`, `Q.n`, `(n)`, 18 in roman numbers and the rest without, 15 by `n.` and the others by `[n]`, `n.` with texts that go
#: on in the next line, 76 to 80 by `n.` and 81 on by `n` alone, and `n.` with every fifth mark broken.
FORMS = 8


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """paper, form, j, n, mark, ask, opts, t (the part's lines)."""
    k = F.col("p_partkey")
    paper, j = F.floor(k / 25), k % 25
    form = paper % FORMS
    n = F.when(form == 6, j + 76).otherwise(j + 1).cast("int")
    told = {
        0: F.concat(n, F.lit(". ")), 1: F.concat(F.lit("Q."), n, F.lit(" ")), 2: F.concat(F.lit("("), n, F.lit(") ")),
        3: F.when(j < 18, F.concat(F.element_at(F.array(*map(F.lit, fixed.ROMAN)), (F.least(j, F.lit(17)) + 1).cast("int")), F.lit(". "))).otherwise(""),
        4: F.when(j < 15, F.concat(n, F.lit(". "))).otherwise(F.concat(F.lit("["), n, F.lit("] "))),
        5: F.concat(n, F.lit(". Say\n")), 6: F.when(n <= 80, F.concat(n, F.lit(". "))).otherwise(F.concat(n, F.lit(" "))), 7: F.when(j % 5 == 3, F.concat(n, F.lit("~ "))).otherwise(F.concat(n, F.lit(". "))),
    }
    mark = F.coalesce(*(F.when(form == i, m) for i, m in told.items()))
    ask = F.concat(F.lit("What is the "), "p_name", F.when(k % 2 == 0, F.concat(F.lit(" of brand "), "p_brand")).otherwise(""), F.lit("?"))
    opts = F.concat(F.lit("(a) "), "p_type", F.lit(" (b) "), "p_size", F.lit(" (c) red (d) blue"))
    p = table(spark, sf_dir, "part").select(paper.alias("paper"), form.alias("form"), j.alias("j"), n.alias("n"), mark.alias("mark"), ask.alias("ask"), opts.alias("opts"))
    return p.withColumn("t", F.concat("mark", "ask", F.lit("\n"), "opts"))


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = asked(spark, sf_dir).groupBy("paper").agg(F.array_sort(F.collect_list(F.struct("j", "t"))).alias("ts"))
    return q.select("paper", F.array_join(F.transform("ts", lambda x: x["t"]), "\n").alias("text"))


PAPERS = f"""WITH p AS (SELECT p_partkey // 25 AS paper, p_partkey // 25 % {FORMS} AS form, p_partkey % 25 AS j, 'What is the ' || p_name || CASE WHEN p_partkey % 2 = 0 THEN ' of brand ' || p_brand ELSE '' END || '?' AS ask, p_type || '|' || p_size || '|red|blue' AS options,
 '(a) ' || p_type || ' (b) ' || p_size || ' (c) red (d) blue' AS opts, CAST(CASE p_partkey // 25 % {FORMS} WHEN 6 THEN p_partkey % 25 + 76 ELSE p_partkey % 25 + 1 END AS INT) AS n FROM part),
c AS (SELECT *, count(*) OVER (PARTITION BY paper) AS size, count(*) FILTER (j < 18) OVER (PARTITION BY paper) AS n_roman, max(n) OVER (PARTITION BY paper) AS most FROM p) """


@query(PAPERS + """SELECT paper, n AS qnum, CAST(CASE form WHEN 3 THEN 1 WHEN 5 THEN 3 WHEN 6 THEN CASE WHEN n > 80 THEN 2 ELSE 0 END ELSE 0 END AS INT) AS kind, CASE form WHEN 5 THEN 'Say ' || ask ELSE ask END AS question, options,
round(CASE WHEN form = 3 THEN 0.8 WHEN form = 5 THEN 0.6 + CASE WHEN length(ask) + 4 >= 30 THEN 0.15 ELSE 0 END WHEN form = 6 AND n > 80 THEN 0.65 ELSE 0.75 + CASE WHEN length(ask) >= 30 THEN 0.25 ELSE 0 END END, 6)::DOUBLE AS confidence
FROM c WHERE (form <> 3 OR j < 18) AND (form <> 7 OR j % 5 <> 3) AND (form <> 6 OR n <= 80 OR most >= 80)""")
def extraction_cascade(spark, sf_dir):
    """[E4] Papers of all forms: one in roman numbers, one of two forms, one that only its lines give, one with relaxed marks from 81 on."""
    q = pp.cascade(papers(spark, sf_dir), "paper", "text")
    return q.select("paper", "qnum", "kind", "question", F.array_join("options", "|").alias("options"), "confidence")


@query(PAPERS + """SELECT paper, n AS qnum, 'verbal_ability' AS section, 'verbal_inferred' AS question_type, substr('[RESCUED VERBAL Q' || n || '] ' || n || '~ ' || ask || chr(10) || opts, 1, 200 + length('[RESCUED VERBAL Q' || n || '] ')) AS question, options, 0.35::DOUBLE AS confidence
FROM c WHERE form = 7 AND j % 5 = 3 AND n < most""")
def rescued_questions(spark, sf_dir):
    """[E9] Marks that no form knows: the text between the neighbours is the question's."""
    docs = papers(spark, sf_dir)
    return pp.rescued(pp.cascade(docs, "paper", "text"), docs, fixed.ZONES, "paper", "text").withColumn("options", F.array_join("options", "|"))


FIGURES = """WITH p AS (SELECT p_partkey // 20 AS paper, p_partkey % 20 AS j, CAST(p_partkey % 20 + 1 AS INT) AS n, p_partkey % 6 AS way, p_name, p_size FROM part) """


@query(FIGURES + """SELECT paper, n AS qnum, CASE way WHEN 0 THEN 'minimal_text' WHEN 3 THEN 'short_text' ELSE 'keyword' END AS method,
CASE way WHEN 0 THEN '[FIGURE QUESTION - non verbal reasoning pattern/diagram]' WHEN 3 THEN 'Tile ' || p_size || ' [LIKELY FIGURE - incomplete text]' WHEN 1 THEN 'Which mirror image fits the ' || p_name || ' [FIGURE/DIAGRAM BASED]' ELSE 'Which one fits the ' || p_name || ' in the given figure [FIGURE/DIAGRAM BASED]' END AS question,
p_size || '|2' || CASE WHEN way = 0 THEN '|3' ELSE '' END AS options, CASE way WHEN 0 THEN 0.5 WHEN 3 THEN 0.4 ELSE 0.7 END::DOUBLE AS confidence FROM p WHERE way < 4""")
def figure_strategies(spark, sf_dir):
    """[E6] Each strategy alone decides some rows: a bare number with options, figures told on the line or the one after it, a short text; others are no figures."""
    k = F.col("p_partkey")
    n, way = (k % 20 + 1).cast("int"), k % 6
    head = F.concat(n, F.lit("."))
    told = [
        F.concat(head, F.lit("\n(a) "), "p_size", F.lit("\n(b) 2\n(c) 3\n")), F.concat(head, F.lit(" Which mirror image fits the "), "p_name", F.lit("\n(a) "), "p_size", F.lit("\n(b) 2\n")),
        F.concat(head, F.lit(" Which one fits the "), "p_name", F.lit("\nin the given figure\n(a) "), "p_size", F.lit("\n(b) 2\n")), F.concat(head, F.lit(" Tile "), "p_size", F.lit("\n(a) "), "p_size", F.lit("\n(b) 2\n")),
        F.concat(head, F.lit(" What is the "), "p_name", F.lit("?\n(a) "), "p_size", F.lit("\n(b) 2\n")), F.concat(head, F.lit(" Tile "), "p_size", F.lit("\n(a) "), "p_size", F.lit("\n")),
    ]
    p = table(spark, sf_dir, "part").select(F.floor(k / 20).alias("paper"), (k % 20).alias("j"), F.concat(F.coalesce(*(F.when(way == i, t) for i, t in enumerate(told))), F.lit("\n" * 8)).alias("t"))
    docs = p.groupBy("paper").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("j", "t"))), lambda x: x["t"]), "").alias("text"))
    q = pp.figure_questions(docs, "paper", "text")
    return q.select("paper", "qnum", "method", "question", F.array_join("options", "|").alias("options"), "confidence")
