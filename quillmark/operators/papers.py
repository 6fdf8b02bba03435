"""Whole papers: an ordered cascade of question marks, figure questions by three strategies, and the text between found questions rescued.

A paper is one row of text. One pass of regular expressions gives the places of all marks of all forms; which of them count is decided by windows over a paper's
marks, never by a loop over forms.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed, text as tx
from .extract import clean_body

#: A paper whose marks give this many questions needs no weaker form.
ENOUGH = 20
#: Kinds of marks, strongest first; the eight plain forms are ranked among themselves.
PLAIN, ROMAN, RELAXED, LINES = range(4)
_BASE = [0.5, 0.6, 0.45, 0.4]


def _rules() -> list[tuple[int, re.Pattern]]:
    """(kind, expression) of each form in order: group 1 is the number, group 2 the text on the mark's line."""
    marks = [(PLAIN, m) for m in fixed.QUESTION_MARKS] + [(ROMAN, fixed.ROMAN_MARK)] + [(RELAXED, m) for m in fixed.RELAXED_MARKS]
    return [(kind, re.compile(rf"(?im)^\s*{mark}\s*(\S.*?)(?={OPTION_A if ends else ''}$)")) for kind, (mark, ends) in marks]


OPTION_A = r"\s*\(a\)|"


def marks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, kind, form, qnum, at, start, stop, to: of each mark its place, the begin and end of the text on its line, and where the form's next mark is."""
    schema = T.StructType([docs.schema[key], *(T.StructField(c, T.IntegerType()) for c in ("kind", "form", "qnum", "at", "start", "stop", "to"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, roman = _rules(), {r: i + 1 for i, r in enumerate(fixed.ROMAN)}
        for b in batches:
            rows, owner = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                for form, (kind, rule) in enumerate(rules):
                    found = list(rule.finditer(t or ""))
                    nexts = [m.start() for m in found[1:]] + [len(t or "")]
                    for m, to in zip(found, nexts):
                        n = roman.get(m[1].lower()) if kind == ROMAN else int(m[1])
                        if n is not None:
                            rows.append((kind, form, n, m.start(), m.start(2), m.end(2), to))
                            owner.append(i)
            columns = list(zip(*rows)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner, pa.int64())), *(pa.array(c, pa.int32()) for c in columns)], schema.names)

    return docs.select(key, text).mapInArrow(run, schema)


def _chosen(found: DataFrame, key: str, least: int) -> DataFrame:
    """The marks that count, one a number. Plain forms are taken in order until there are ENOUGH; roman ones if there are fewer; relaxed ones (81 to 100) where a
    number of 80 or more was found. A number keeps its first place of its strongest form."""
    place = F.struct("form", "at", "start", "stop", "to")
    one = found.filter(F.col("stop") - F.col("start") >= least).groupBy(key, "qnum", "kind").agg(F.min(place).alias("p")).select(key, "qnum", "kind", "p.*")
    paper = Window.partitionBy(key)
    # How many questions the forms up to this one give, and this one alone.
    upto = F.sum((F.col("kind") == PLAIN).cast("int")).over(paper.orderBy("form").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    own = F.count("*").over(Window.partitionBy(key, "form"))
    one = one.withColumn("__before", upto - F.when(F.col("kind") == PLAIN, own).otherwise(0)).filter((F.col("kind") != PLAIN) | (F.col("__before") < ENOUGH))
    plain = F.sum((F.col("kind") == PLAIN).cast("int")).over(paper)
    one = one.withColumn("__n", plain).filter((F.col("kind") != ROMAN) | (F.col("__n") < ENOUGH))
    one = one.withColumn("__kind", F.min("kind").over(Window.partitionBy(key, "qnum"))).filter("kind = __kind")
    most = F.max(F.when(F.col("kind") < RELAXED, F.col("qnum"))).over(paper)
    return one.withColumn("__most", most).filter((F.col("kind") != RELAXED) | (F.col("__most") >= 80)).drop("__before", "__n", "__kind", "__most")


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, line, t (stripped), at (its place in the text), page (markers are no lines, the first page is 0)."""
    raw = docs.select(key, F.posexplode(F.split(text, "\n")).alias("line", "raw"))
    order = Window.partitionBy(key).orderBy("line")
    at = F.coalesce(F.sum(F.length("raw") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    page = F.nullif(F.regexp_extract(tx.strip(F.col("raw")), fixed.PAGE_MARK, 1), F.lit("")).cast("int")
    told = raw.select(key, "line", tx.strip(F.col("raw")).alias("t"), (F.length("raw") + at).alias("end"), at.alias("at"), page.alias("__page"))
    return told.withColumn("page", F.coalesce(F.last("__page", ignorenulls=True).over(order) - 1, F.lit(0))).filter("__page IS NULL").drop("__page")


def _line_questions(docs: DataFrame, found: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """key, qnum, kind, form, start, stop, question, body of papers with fewer than ENOUGH found: a numbered line opens a question, the lines up to the next
    numbered one belong to it. Numbers that were found stay as they were; a number's first question of fair length counts."""
    mark = F.regexp_extract("t", fixed.LINE_MARK, 0)
    lines = _lines(docs.join(found.groupBy(key).agg(F.count("*").alias("__n")).filter(F.col("__n") >= ENOUGH), key, "left_anti"), key, text).filter("t <> ''")
    lines = lines.withColumn("__n", F.nullif(F.regexp_extract(mark, r"\d+", 0), F.lit("")).cast("int"))
    order = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    opened = lines.withColumn("__open", F.last(F.when(F.col("__n").isNotNull(), F.struct(F.col("line").alias("l"), F.col("__n").alias("n"))), ignorenulls=True).over(order)).filter("__open IS NOT NULL")
    rest = F.when(F.col("__n").isNull(), F.col("t")).otherwise(tx.strip(F.regexp_replace("t", fixed.LINE_MARK, "")))
    told = opened.groupBy(key, "__open").agg(F.min("at").alias("start"), F.max("end").alias("stop"), F.array_sort(F.collect_list(F.struct("line", rest.alias("t")))).alias("ts"))
    body = F.array_join(F.filter(F.transform("ts", lambda x: x["t"]), lambda t: t != ""), " ")
    told = told.select(key, F.col("__open.n").alias("qnum"), "start", "stop", body.alias("body")).filter(F.length("body") >= least).join(found.select(key, "qnum"), [key, "qnum"], "left_anti")
    first = told.groupBy(key, "qnum").agg(F.min(F.struct("start", "stop", "body")).alias("p")).select(key, "qnum", "p.*")
    return first.select(key, "qnum", F.lit(LINES).alias("kind"), F.lit(None).cast("int").alias("form"), "start", "stop", F.col("body").alias("question"), "body")


def confidence_of(kind: Column, question: Column, n_options: Column) -> Column:
    """[E11] Plain marks .5, with .25 for two options and .25 for 30 characters; roman .6 and .2 for options; relaxed .45 and .2; lines .4, .2 and .15."""
    options, length = n_options >= 2, F.length(question) >= 30
    told = [F.when(options, o).otherwise(0.0) + F.when(length, n).otherwise(0.0) + b for b, o, n in zip(_BASE, (0.25, 0.2, 0.2, 0.2), (0.25, 0.0, 0.0, 0.15))]
    return F.round(F.when(kind == PLAIN, told[0]).when(kind == ROMAN, told[1]).when(kind == RELAXED, told[2]).otherwise(told[3]), 6)


def own_options(body: Column) -> Column:
    """The body up to its first block of option lines, if another block follows: that one is a question's whose mark no form knows."""
    first = F.regexp_extract(body, r"(?s)^(.*?(?:\n\s*[(\[]?[a-eA-E][)\].][^\n]*)+)", 1)
    return F.when(F.regexp_count(body, F.lit(r"\n\s*[(\[]?[aA][)\].]")) > 1, first).otherwise(body)


def cascade(docs: DataFrame, key: str, text: str, least: int = 10) -> DataFrame:
    """[E4, E11, F10] key, qnum, kind, form, start, stop, question, options, confidence: each number of a paper once.

    Eight forms of marks in order, until they give 20 questions; roman numbers for papers with fewer; 81 to 100 in relaxed forms for papers that reach 80; at
    last, for papers that still have fewer than 20, line by line. A text under `least` characters is none. start and stop are the text's place in code points.
    Null and empty texts give no rows; equal keys are one paper's pages only if the caller has joined them.
    """
    found = _chosen(marks(docs, key, text), key, least)
    found = found.withColumn("to", F.least("to", F.lead("at").over(Window.partitionBy(key).orderBy("at", "qnum"))))
    body = docs.select(key, F.col(text).alias("__text"))
    plain = found.join(body, key).select(key, "qnum", "kind", "form", "start", "stop", F.expr("substring(__text, start + 1, stop - start)").alias("question"), F.expr("substring(__text, at + 1, to - at)").alias("body"))
    both = plain.unionByName(_line_questions(docs, found, key, text, least))
    options = F.transform(tx.options_of(own_options(F.col("body"))), lambda o: o["option"])
    cleaned = F.regexp_replace(tx.strip(clean_body(F.col("question"))), r"\s+", " ")
    q = both.select(key, "qnum", "kind", "form", "start", "stop", cleaned.alias("question"), options.alias("options")).filter("question <> ''")
    return q.withColumn("confidence", confidence_of(F.col("kind"), F.col("question"), F.size("options")))


def gap_texts(found: DataFrame, docs: DataFrame, key: str, text: str, most: int = 3, least: int = 16) -> DataFrame:
    """[E9, J18] key, after, before, between: the text between two found questions (key, qnum, start, stop) whose numbers are 1 to `most` numbers apart.

    The complement of the found spans in order of numbers: from the end of the one to the beginning of the next, without the option lines right after the one
    and the next one's own mark. Spans out of order leave nothing between them, nor do texts under `least` characters.
    """
    order = Window.partitionBy(key).orderBy("qnum")
    told = found.select(key, F.col("qnum").alias("after"), "stop", F.lead("qnum").over(order).alias("before"), F.lead("start").over(order).alias("__to"))
    told = told.filter((F.col("before") - F.col("after") > 1) & (F.col("before") - F.col("after") <= most + 1) & (F.col("__to") > F.col("stop")))
    raw = told.join(docs.select(key, F.col(text).alias("__text")), key).withColumn("between", F.expr("substring(__text, stop + 1, __to - stop)"))
    own_options = r"^(?:\s*[(\[]?[a-eA-E][)\].][^\n]*(?:\n|$))+"
    next_mark = r"(?i)\n\s*[(\[]?(?:Q(?:ues(?:tion)?)?\.?\s*)?(?:\d+|[ivx]+)\s*[.):\]]*\s*$"
    cut = tx.strip(F.regexp_replace(F.regexp_replace("between", own_options, ""), next_mark, ""))
    return raw.select(key, "after", "before", cut.alias("between")).filter(F.length("between") >= least)


def rescued(found: DataFrame, docs: DataFrame, zones: list[tuple[str, int, int]], key: str, text: str) -> DataFrame:
    """[E9] key, qnum, section, question_type, question, options, confidence: a row for each number missing in a gap, with the text between its neighbours.

    Numbers of one gap share its text, as nothing tells which part is whose. The text is read again for options and cut to 200 characters; the number's zone gives
    label and type (numbers in none: the first zone's); confidence .35.
    """
    gaps = gap_texts(found, docs, key, text)
    each = gaps.withColumn("qnum", F.explode(F.sequence(F.col("after") + 1, F.col("before") - 1)))
    zone = F.coalesce(*(F.when(F.col("qnum").between(lo, hi), F.lit(z)) for z, lo, hi in zones), F.lit(zones[0][0]))
    label = F.create_map(*(F.lit(x) for kv in fixed.RESCUE_LABELS.items() for x in kv))[F.col("section")]
    kind = F.when(F.col("section") == "reasoning", "non_verbal_figure").when(F.col("section") == "numerical_ability", "math_inferred").when(F.col("section") == "general_awareness", "ga_inferred").otherwise("verbal_inferred")
    told = F.concat(F.lit("[RESCUED "), label, F.lit(" Q"), F.col("qnum"), F.lit("] "), F.substring("between", 1, 200))
    options = F.transform(tx.options_of(F.col("between")), lambda o: o["option"])
    return each.withColumn("section", zone).select(key, "qnum", "section", kind.alias("question_type"), told.alias("question"), options.alias("options"), F.lit(0.35).alias("confidence"))


def figure_questions(docs: DataFrame, key: str, text: str) -> DataFrame:
    """[E6, F29] key, qnum, method, first_line, last_line, question, options, confidence: questions that are figures by one of three strategies, in this order.

    minimal_text (.5): a line of a number alone, with three option lines or more among the next seven, up to the next numbered line. keyword (.7): a numbered line
    that with up to three lines more, until a blank one or an option, speaks of figures. short_text (.4): under 15 characters without an asking word, and two
    option lines or more. Each number once: by the first strategy, then by its first line. Lines count from 0; the span ends with the last line looked at.
    """
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("line", "raw")).select(key, "line", tx.strip(F.col("raw")).alias("t"))
    nexts = F.collect_list("t").over(Window.partitionBy(key).orderBy("line").rowsBetween(1, 7))
    number = F.regexp_extract("t", r"^(?:Q\.?\s*)?(\d{1,3})\s*(?:[.)]|(?:[.)]?(?:\s*[A-Da-d][.)]?)?)$)", 1)
    lines = lines.withColumn("nexts", nexts).withColumn("__n", F.nullif(number, F.lit(""))).filter("__n IS NOT NULL")

    def until(lines_: Column, rule: str) -> Column:
        """Lines before the first that the rule matches."""
        at = F.array_position(F.transform(lines_, lambda x: x.rlike(rule)), True)
        return F.when(at > 0, F.slice(lines_, 1, F.greatest(at - 1, F.lit(0)).cast("int"))).otherwise(lines_)

    def options(lines_: Column) -> Column:
        own = F.filter(lines_, lambda x: x.rlike(r"^[(\[]?[A-Da-d][)\].:-]?"))
        return F.transform(own, lambda x: tx.strip(F.regexp_replace(x, r"^[(\[]?[A-Da-d][)\].:-]?\s*", "")))

    numbered = until(F.col("nexts"), r"^(?:Q\.?\s*)?\d{1,3}\s*[.)]")
    asked = F.regexp_extract("t", r"^(?:Q\.?\s*)?\d{1,3}\s*[.)]\s*(.+)$", 1)
    more = until(F.slice("nexts", 1, 3), r"^$|^[(\[]?[A-Da-d1-4][)\].:-]")
    whole = F.concat_ws(" ", asked, F.array_join(more, " "))
    told = lines.withColumn("own", options(numbered)).withColumn("all", options(F.col("nexts"))).withColumn("asked", asked).withColumn("whole", tx.strip(whole)).withColumn("n_more", F.size(more)).withColumn("n_own", F.size(numbered))
    alone = F.col("t").rlike(r"^(?:Q\.?\s*)?\d{1,3}\s*[.)]?(?:\s*[A-Da-d][.)]?)?$") & (F.size("own") >= 3)
    keyword = (F.col("asked") != "") & F.lower("whole").rlike("|".join(f"(?:{p})" for p in fixed.FIGURE_PATTERNS))
    short = (F.col("asked") != "") & (F.length("asked") < 15) & ~F.lower("asked").rlike(fixed.FIGURE_ASKING) & (F.size("own") >= 2)
    ways = [
        ("minimal_text", alone, F.lit("[FIGURE QUESTION - non verbal reasoning pattern/diagram]"), "own", F.col("n_own"), 0.5),
        ("keyword", keyword, F.concat("whole", F.lit(" [FIGURE/DIAGRAM BASED]")), "all", F.greatest("n_more", F.when(F.size("all") > 0, F.size("nexts")).otherwise(0)), 0.7),
        ("short_text", short, F.concat("asked", F.lit(" [LIKELY FIGURE - incomplete text]")), "own", F.col("n_own"), 0.4),
    ]
    one = [F.when(test, F.struct(F.lit(i).alias("way"), F.lit(name).alias("method"), q.alias("question"), F.slice(o, 1, 4).alias("options"), (F.col("line") + n).cast("int").alias("last_line"), F.lit(c).alias("confidence"))) for i, (name, test, q, o, n, c) in enumerate(ways)]
    found = told.select(key, F.col("__n").cast("int").alias("qnum"), F.col("line").alias("first_line"), F.explode(F.filter(F.array(*one), lambda x: x.isNotNull())).alias("x"))
    best = found.groupBy(key, "qnum").agg(F.min(F.struct(F.col("x.way").alias("way"), "first_line", F.col("x").alias("x"))).alias("b"))
    return best.select(key, "qnum", "b.x.method", "b.first_line", "b.x.last_line", "b.x.question", "b.x.options", "b.x.confidence")


def read_paper(docs: DataFrame, zones: list[tuple[str, int, int]], key: str, text: str) -> DataFrame:
    """[E4, E6, E9] key, qnum, source, question, options, confidence: the cascade's questions, figures where it has none, and rescued texts where neither has."""
    found = cascade(docs, key, text)
    own = found.select(key, "qnum", F.lit("marks").alias("source"), "question", "options", "confidence")
    figures = figure_questions(docs, key, text).select(key, "qnum", F.lit("figure").alias("source"), "question", "options", "confidence").join(own.select(key, "qnum"), [key, "qnum"], "left_anti")
    gone = rescued(found, docs, zones, key, text).select(key, "qnum", F.lit("rescue").alias("source"), "question", "options", "confidence")
    return own.unionByName(figures).unionByName(gone.join(own.unionByName(figures).select(key, "qnum"), [key, "qnum"], "left_anti"))
