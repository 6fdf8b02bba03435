"""Questions out of running text: boundaries, splitting, line states, match-the-following blocks, placeholders, confidence."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from .sequence import in_zone, missing_numbers

#: How a question's number may be written, surest first.
FORMS = [r"(?m)^\s*Q(?:uestion)?\.?\s*(\d{1,3})\s*[.):-]", r"(?m)^\s*(\d{1,3})\s*\.\s+(?=\S)", r"(?m)^\s*(\d{1,3})\s*\)\s+(?=\S)", r"(?m)^\s*\((\d{1,3})\)\s+(?=\S)"]
ROMAN_FORM = r"(?mi)^\s*\(?(x{0,1}(?:ix|iv|v?i{1,3}|v)|x{1,2})[.)]\s+(?=\S)"


def question_marks(text: str, forms: list[str] = FORMS, most: int = 200) -> list[tuple[int, int, int]]:
    """(number, start of the mark, end of the mark), by place, none inside another; a number's surest form wins."""
    found = []
    for rank, form in enumerate(forms):
        found += [(m.start(), rank, m.end(), int(m[1])) for m in re.finditer(form, text) if 1 <= int(m[1]) <= most]
    found.sort()
    out, last, seen = [], -1, set()
    for start, _, end, n in found:
        if start >= last and n not in seen:
            out.append((n, start, end))
            seen.add(n)
            last = end
    return out


def boundaries(docs: DataFrame, key: str, text: str) -> DataFrame:
    """[E1] key, qnum, start, end of each question's mark."""
    import pandas as pd

    schema = T.StructType([docs.schema[key], *(T.StructField(c, T.IntegerType()) for c in ("qnum", "start", "end"))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, *m) for k, t in b[[key, text]].itertuples(index=False) for m in question_marks(t or "")]
            yield pd.DataFrame(rows, columns=[key, "qnum", "start", "end"])

    return docs.select(key, text).mapInPandas(run, schema)


def split_questions(docs: DataFrame, key: str, text: str) -> DataFrame:
    """[E2, E4, E11, W16, F9] key, qnum, body, options, confidence: from each mark to the next; a text without marks by blank lines, with qnum null."""
    marks = boundaries(docs, key, text)
    nxt = F.lead("start").over(Window.partitionBy(key).orderBy("start"))
    cut = marks.withColumn("__to", nxt).join(docs.select(key, text), key)
    body = tx.strip(F.substring(F.col(text), F.col("end") + 1, F.coalesce("__to", F.length(text)) - F.col("end")))
    numbered = cut.select(key, "qnum", body.alias("body"))
    bare = docs.join(marks.select(key).distinct(), key, "left_anti").select(key, F.lit(None).cast("int").alias("qnum"), F.explode(F.filter(F.transform(F.split(text, r"\n\s*\n"), tx.strip), lambda p: p != "")).alias("body"))
    both = numbered.unionByName(bare)
    options = tx.options_of(F.col("body"))
    return both.withColumn("options", F.transform(options, lambda o: o["option"])).withColumn("confidence", extraction_confidence(F.col("qnum"), F.col("body"), F.size("options")))


def extraction_confidence(qnum: Column, body: Column, n_options: Column) -> Column:
    """[E11] .5, and .25 each for options and for a text of 20 characters; .4 at most without a number."""
    c = F.lit(0.5) + F.when(n_options >= 2, 0.25).otherwise(0.0) + F.when(F.length(body) >= 20, 0.25).otherwise(0.0)
    return F.when(qnum.isNull(), F.least(c, F.lit(0.4))).otherwise(c)


def clean_body(body: Column) -> Column:
    """The question without its options."""
    return F.trim(F.regexp_replace(body, r"(?is)\s*[(\[]?\b[a-e][)\].]\s+.*$", ""))


def line_states(docs: DataFrame, key: str, text: str) -> DataFrame:
    """[E5] Lines belong to the last numbered line before them: key, qnum, body."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("line", "t"))
    number = F.nullif(F.regexp_extract("t", r"^\s*(?:Q\.?\s*)?(\d{1,3})\s*[.)]\s", 1), F.lit("")).cast("int")
    lines = lines.withColumn("__n", number).withColumn("qnum", F.last("__n", ignorenulls=True).over(Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0))).filter("qnum IS NOT NULL")
    return lines.groupBy(key, "qnum").agg(F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "t"))), lambda x: x["t"]), "\n")).alias("body"))


def figure_candidates(docs: DataFrame, key: str, text: str, within: int = 7) -> DataFrame:
    """[E6, F29] Lines that speak of a figure, and whether an option mark follows within some lines."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("line", "t"))
    w = Window.partitionBy(key).orderBy("line").rowsBetween(1, within)
    mark = F.max(F.lower("t").rlike(r"^\s*[(\[]?[a-d][)\].]").cast("int")).over(w)
    return lines.withColumn("has_options", F.coalesce(mark, F.lit(0)) > 0).filter(non_verbal(F.col("t")))


def non_verbal(text: Column) -> Column:
    """Speaks of figures, mirrors, folded papers and the like."""
    return F.lower(text).rlike(r"figure|mirror image|water image|embedded|paper fold|folded|punched|venn|dice|\bcube|pattern|odd one|complete the series|shape|rotat|dot situation|answer fig")


def match_blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """[E7] Blocks that start with `match` and `list` or `column`, up to a blank line."""
    found = F.regexp_extract_all(text, F.lit(r"(?is)(match\s+(?:the|list|column).*?)(?=\n\s*\n|$)"), 1)
    return docs.select(key, F.posexplode(found).alias("pos", "block"))


def placeholders(rows: DataFrame, zones: DataFrame, group: list[str], number: str, total: int) -> DataFrame:
    """[E8, J13, P35, P36] Rows for missing numbers: the zone's section, confidence .2 up to the largest number seen, .1 after it."""
    most = rows.groupBy(*group).agg(F.max(number).alias("__most"))
    gone = missing_numbers(rows, group, number, F.lit(total)).join(most, group)
    z = in_zone(gone, zones, number)
    return z.select(*group, number, F.col("zone").alias("section"), F.lit("placeholder").alias("body"), F.when(F.col(number) < F.col("__most"), 0.2).otherwise(0.1).alias("confidence"))


def with_relabelled_small_papers(rows: DataFrame, group: list[str], section: str, confidence: str, label: str = "topic") -> DataFrame:
    """[P36] Papers of under 80 rows are of one section, their commonest: others are relabelled with confidence .35 at most."""
    n = F.count("*").over(Window.partitionBy(*group))
    c = rows.groupBy(*group, section).agg(F.count("*").alias("__c"))
    main = c.groupBy(*group).agg(F.min_by(section, F.struct(-F.col("__c"), F.col(section))).alias("__main"))
    r = rows.withColumn("__n", n).join(main, group)
    move = (F.col("__n") < 80) & (F.col(section) != F.col("__main"))
    return r.withColumn(label, F.when(move, F.concat(F.lit("Inferred "), "__main")).otherwise(F.col(label))).withColumn(confidence, F.when(move, F.least(F.col(confidence), F.lit(0.35))).otherwise(F.col(confidence))).withColumn(section, F.when(move, F.col("__main")).otherwise(F.col(section))).drop("__n", "__main")


def paper_format(text: Column) -> Column:
    """[P31] By what the first 5,000 characters show, in this order."""
    head = F.substring(text, 1, 5000)
    return (
        F.when(F.regexp_count(head, F.lit(r"(?m)^\s*Q\.?\s*\d+")) > 10, "q_numbered")
        .when(F.regexp_count(head, F.lit(r"(?m)^\s*\d{1,3}\s*\.")) > 10, "dot_numbered")
        .when(F.regexp_count(head, F.lit(r"(?m)^\s*\d{1,3}\s*\)")) > 10, "paren_numbered")
        .when(head.rlike(r"(?i)section\s*[-:]?\s*[a-d1-4]"), "sectioned")
        .otherwise("unknown")
    )


def extract_paper(docs: DataFrame, key: str, text: str) -> DataFrame:
    """[E13] Clean, split, classify: one call over all papers."""
    cleaned = docs.withColumn(text, tx.clean_lines(F.col(text)))
    q = split_questions(cleaned, key, text)
    kind, sure = tx.question_type(F.col("body"))
    return q.withColumn("section", tx.section_of(F.col("body"))).withColumn("question_type", kind).withColumn("type_confidence", sure).withColumn("has_formula", tx.has_formula(F.col("body")))
