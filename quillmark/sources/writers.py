"""Sinks. Tables are written by Spark, partitioned; only reports of a stated number of rows are put together on the driver."""

from __future__ import annotations

import html as _html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import numbered_options, shorten


def write_json(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """[K1, K13]"""
    rows.write.mode(mode).json(path)


def write_csv(rows: DataFrame, path: str, columns: list[str], mode: str = "overwrite") -> None:
    """[K2] Fixed columns; commas and line breaks of texts are scrubbed, arrays are JSON."""
    kind = dict(rows.dtypes)
    tidy = lambda c: F.to_json(c) if kind[c].startswith(("array", "map", "struct")) else F.regexp_replace(F.replace(F.col(c), F.lit(","), F.lit(";")), r"\s*[\r\n]+\s*", " ") if kind[c] == "string" else F.col(c)
    rows.select(*(tidy(c).alias(c) for c in columns)).write.mode(mode).option("header", True).csv(path)


def append_new(bank_path: str, incoming: DataFrame, key, order: str) -> int:
    """[K3, D3] Add the questions whose key the bank lacks; returns how many. All columns are kept."""
    from pyspark.errors import AnalysisException

    from ..operators.frequency import distinct_questions, new_questions

    rows = distinct_questions(incoming, key(incoming), order).drop("n_copies")
    try:
        rows = new_questions(incoming.sparkSession.read.parquet(bank_path), rows, key)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    rows = rows.persist()
    n = rows.count()
    if n:
        rows.write.mode("append").parquet(bank_path)
    rows.unpersist()
    return n


def clear(bank_path: str, like: DataFrame) -> None:
    """[K4]"""
    like.limit(0).write.mode("overwrite").parquet(bank_path)


def write_by(rows: DataFrame, path: str, column: str) -> None:
    """[K5] A folder for each value; rows of a value are dealt together first, so that it has few files."""
    rows.repartition(column).write.mode("overwrite").partitionBy(column).json(path)


def paper_rows(questions: DataFrame, paper: list[str], order: str) -> DataFrame:
    """[K6] A row a paper: its questions in order, counts by section."""
    by_section = questions.groupBy(*paper, "section").agg(F.count("*").alias("n")).groupBy(*paper).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("section", "n")))).alias("section_breakdown"))
    rest = [c for c in questions.columns if c not in (*paper, order)]
    return questions.groupBy(*paper).agg(F.count("*").alias("total_questions"), F.array_sort(F.collect_list(F.struct(order, *rest))).alias("questions")).join(by_section, paper)


def as_json(rows: DataFrame, *columns: str) -> DataFrame:
    """[K7, K14]"""
    return rows.select(F.to_json(F.struct(*(columns or rows.columns))).alias("json"))


def training_rows(questions: DataFrame) -> DataFrame:
    """[K11] id, text, section, topic_code, difficulty, choices_text, correct_answer, explanation."""
    have = set(questions.columns)
    return questions.select("id", "text", "section", "topic_code", "difficulty", numbered_options(F.col("options")).alias("choices_text"), *(F.col(c) if c in have else F.lit("").alias(c) for c in ("correct_answer", "explanation")))


def short_rows(questions: DataFrame, n: int = 200, options: int = 4) -> DataFrame:
    """[K14]"""
    return questions.withColumn("text", shorten(F.col("text"), n)).withColumn("options", F.slice("options", 1, options))


def html_rows(rows: DataFrame, *order: str) -> DataFrame:
    """[K8, K10] A table row of HTML for each row, by these columns; nulls are empty."""
    cell = lambda c: F.concat(F.lit("<td>"), F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit("</td>"))
    return rows.orderBy(*order).select(F.concat(F.lit("<tr>"), *map(cell, rows.columns), F.lit("</tr>")).alias("html"))


def write_html(rows: DataFrame, path: str, *order: str) -> None:
    """[K8, K10] All rows as HTML table rows, in files whose order is theirs, with a head in `head.html`'s folder: a page of any length."""
    head = "".join(f"<th>{_html.escape(c)}</th>" for c in rows.columns)
    rows.sparkSession.createDataFrame([(f"<table><tr>{head}</tr>",)], "html string").coalesce(1).write.mode("overwrite").text(f"{path}/head")
    html_rows(rows, *order).write.mode("overwrite").text(f"{path}/rows")


def html_report(rows: DataFrame, title: str, most: int = 500) -> str:
    """[K8, K10] A page with a table of the first `most` rows, which tells how many there are if there are more; write_html has them all."""
    head = "".join(f"<th>{_html.escape(c)}</th>" for c in rows.columns)
    found = rows.limit(most + 1).collect()
    body = "".join("<tr>" + "".join(f"<td>{_html.escape(str(v))}</td>" for v in r) + "</tr>" for r in found[:most])
    more = f"<p>{most} of {rows.count()} rows</p>" if len(found) > most else ""
    return f"<!doctype html><title>{_html.escape(title)}</title><h1>{_html.escape(title)}</h1><table><tr>{head}</tr>{body}</table>{more}"


def script_bundle(name: str, parts: dict[str, DataFrame], most: int = 2000) -> str:
    """[K9] `const name = {...};` of all rows of each part. A part of over `most` rows is an error: write it with write_json."""
    told = {}
    for k, df in parts.items():
        told[k] = as_json(df).limit(most + 1).collect()
        if len(told[k]) > most:
            raise ValueError(f"{k} has over {most} rows, too many for a script")
    return f"const {name} = {{{','.join(f'{chr(34)}{k}{chr(34)}:[{chr(44).join(r[0] for r in v)}]' for k, v in told.items())}}};"


def rename_plan(files: DataFrame, mapping: DataFrame) -> DataFrame:
    """[K15, U2, U5] Each file or mapped name: rename, missing or unmapped."""
    j = files.select(F.col("name").alias("file")).join(mapping, F.col("file") == F.col("old"), "full")
    status = F.when(F.col("file").isNull(), "missing").when(F.col("old").isNull(), "unmapped").otherwise("rename")
    return j.select(F.coalesce("file", "old").alias("name"), F.col("new").alias("new_name"), status.alias("status"))



def write_importances(rows: DataFrame, path: str) -> None:
    """[K12] One file each, JSON and CSV: a row a feature."""
    one = rows.coalesce(1)
    one.write.mode("overwrite").json(f"{path}/json")
    one.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
