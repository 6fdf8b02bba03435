"""What a topic's texts have in common: keywords, phrases, templates, numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text as tx
from .rank import top_per_group
from .similarity import terms


def keywords(docs: DataFrame, doc: str, group: str, text: str, n: int = 30, letters: tuple[int, int] = (3, 1 << 20)) -> DataFrame:
    """[A55] A group's most frequent words of a-z; equals by name."""
    t = terms(docs, doc, group, text, fixed.STOPWORDS, letters[0]).filter(F.length("term") <= letters[1])
    return top_per_group(t.groupBy(group, "term").agg(F.count("*").alias("cnt")), [group], [F.desc("cnt"), "term"], 1, n)


def phrases(docs: DataFrame, doc: str, group: str, text: str, n: int, least: int = 2, top: int = 15) -> DataFrame:
    """[A56] n-grams within a text, found twice or more in the group."""
    words = F.filter(F.split(F.lower(text), "[^a-z]+"), lambda w: F.length(w) > 0)
    d = docs.select(group, words.alias("w")).filter(F.size("w") >= n)
    grams = d.select(group, F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.concat_ws(" ", *(F.get("w", i + j - 1) for j in range(n))))).alias("phrase"))
    return top_per_group(grams.groupBy(group, "phrase").agg(F.count("*").alias("cnt")).filter(F.col("cnt") >= least), [group], [F.desc("cnt"), "phrase"], 1, top)


def templates(docs: DataFrame, group: str, text: str, order: str, least: int = 2, top: int = 10) -> DataFrame:
    """[A57] Texts with numbers as N: how often, and the first of each. Under five different ones, single ones count too.

    Templates are told apart by SHA-256; whole ones are read again for those that are told, so no text is shuffled for the others."""
    t = docs.select(group, order, tx.digits_template(F.col(text)).alias("template")).withColumn("__h", F.unhex(F.sha2("template", 256)))
    g = t.groupBy(group, "__h").agg(F.count("*").alias("cnt"), F.min(order).alias("first_id"))
    n = g.groupBy(group).agg(F.count("*").alias("n_templates"))
    best = top_per_group(g.join(n, group).filter((F.col("cnt") >= least) | (F.col("n_templates") < 5)), [group], [F.desc("cnt"), "first_id"], 1, top)
    told = best.select(F.col(group).alias("__g"), F.col("__h").alias("__k"), F.col("first_id").alias("__first"))
    same = (F.col(group) == F.col("__g")) & F.col("__h").eqNullSafe(F.col("__k")) & F.col(order).eqNullSafe(F.col("__first"))
    whole = t.join(told, same, "left_semi").groupBy(F.col(group).alias("__g"), F.col("__h").alias("__k")).agg(F.first("template").alias("template"))
    columns = [group, "template", *(c for c in best.columns if c not in (group, "__h"))]
    return best.join(whole, (F.col(group) == F.col("__g")) & F.col("__h").eqNullSafe(F.col("__k"))).select(*columns)


def number_profile(docs: DataFrame, group: str, text: str, pattern: str) -> DataFrame:
    """[A58] Of a group's whole numbers: how many, different ones, range, and the divisors (5, 10, 2, 3) of over half of them."""
    v = docs.select(group, F.explode(F.regexp_extract_all(text, F.lit(pattern), 1)).alias("__s")).select(group, F.col("__s").cast("long").alias("v"))
    over = lambda d: F.when(F.avg((F.col("v") % d == 0).cast("int")) > 0.5, F.lit(str(d)))
    return v.groupBy(group).agg(F.count("*").alias("cnt"), F.countDistinct("v").alias("n_distinct"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.array_join(F.array_compact(F.array(over(5), over(10), over(2), over(3))), ",").alias("divisors"))


def unit_numbers(docs: DataFrame, group: str, text: str) -> DataFrame:
    """[A58, F7] Per group and unit: numbers, different ones, range, the five most common."""
    u = docs.select(group, F.explode(tx.numbers_by_unit(F.col(text))).alias("unit", "vs")).select(group, "unit", F.explode("vs").alias("v"))
    c = u.groupBy(group, "unit", "v").agg(F.count("*").alias("cnt"))
    top = top_per_group(c, [group, "unit"], [F.desc("cnt"), "v"], 1, 5).groupBy(group, "unit").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "v"))), lambda x: x["v"]).alias("common"))
    return c.groupBy(group, "unit").agg(F.sum("cnt").alias("cnt"), F.count("*").alias("n_distinct"), F.min("v").alias("lo"), F.max("v").alias("hi")).join(top, [group, "unit"])


def distractors(rows: DataFrame, group: str, options: str, least: int = 3) -> DataFrame:
    """[A75] Two fixed kinds of wrong options for groups with `least` rows of four options."""
    kinds = F.explode(F.array(F.lit("similar values"), F.lit("common mistakes")))
    return rows.groupBy(group).agg(F.count_if(F.size(options) >= 4).alias("n")).filter(F.col("n") >= least).select(group, "n", kinds.alias("kind"))


def topic_bundle(docs: DataFrame, doc: str, group: str, text: str) -> DataFrame:
    """[A59, X4] One row a group: keywords, phrases, templates, kinds of question in percent."""
    listed = lambda d, c, name: d.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", c))), lambda x: x[c]).alias(name))
    kinds = docs.select(group, tx.starter_type(F.col(text)).alias("kind")).groupBy(group, "kind").agg(F.count("*").alias("cnt"))
    kinds = kinds.groupBy(group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "cnt")))).alias("kinds"), F.sum("cnt").alias("n_texts"))
    out = kinds.join(listed(keywords(docs, doc, group, text), "term", "keywords"), group, "left")
    out = out.join(listed(phrases(docs, doc, group, text, 2), "phrase", "phrases"), group, "left")
    return out.join(listed(templates(docs, group, text, doc), "template", "templates"), group, "left")
