"""Scans: question files in several shapes, damaged JSON, HTML cells, data inside scripts, binary papers."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.normalize import first_filled, year_in

QUESTION = "id string, year int, shift int, section string, topic string, subtopic string, text string, options array<string>, correct_answer string, difficulty string, source string"


def read_questions_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """[S1] (questions, rejects): a file is an array of questions or an object with a `questions` array. Rows without a needed field are rejects."""
    inner = T._parse_datatype_string(QUESTION)
    schema = T.StructType([*inner.fields, T.StructField("questions", T.ArrayType(inner)), T.StructField("_corrupt_record", T.StringType())])
    raw = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    nested = raw.filter("questions IS NOT NULL").select(F.explode("questions").alias("q")).select("q.*")
    rows = raw.filter("questions IS NULL").select(*(f.name for f in inner.fields), "_corrupt_record").unionByName(nested, allowMissingColumns=True)
    good = F.col("_corrupt_record").isNull()
    for c in ("id", "year", "section", "topic"):
        good = good & F.col(c).isNotNull()
    filled = rows.withColumn("shift", F.coalesce("shift", F.lit(1))).withColumn("difficulty", F.coalesce("difficulty", F.lit("medium")))
    return filled.filter(good).drop("_corrupt_record"), rows.filter(~good)


def read_questions_csv(spark: SparkSession, path: str) -> DataFrame:
    """[S2] Header, lenient casts, section as snake case, ids and shifts by default; rows without a year are dropped."""
    raw = spark.read.option("header", True).option("escape", '"').csv(path)
    have = set(raw.columns)
    col = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    return raw.select(
        F.coalesce(F.nullif(col("id"), F.lit("")), F.concat(F.lit("q"), F.monotonically_increasing_id())).alias("id"), col("year").try_cast("int").alias("year"),
        F.coalesce(col("shift").try_cast("int"), F.lit(1)).alias("shift"), F.replace(F.lower(F.trim(col("section"))), F.lit(" "), F.lit("_")).alias("section"),
        *(col(c).alias(c) for c in ("topic", "subtopic", "text", "correct_answer", "difficulty", "source")), F.from_json(col("options"), "array<string>").alias("options"),
    ).filter("year IS NOT NULL")


def read_question_folder(spark: SparkSession, folder: str) -> DataFrame:
    """[S3, U1] All *.json and *.csv of a folder, as one table; a kind that isn't there adds nothing."""
    from pyspark.errors import AnalysisException

    parts = []
    for load, pattern in ((lambda p: read_questions_json(spark, p)[0], "*.json"), (lambda p: read_questions_csv(spark, p), "*.csv")):
        try:
            parts.append(load(f"{folder}/{pattern}"))
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    out = spark.createDataFrame([], QUESTION)
    for p in parts:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def read_analyses(spark: SparkSession, folder: str) -> DataFrame:
    """[S4, D2] The questions of all *_analysis.json, with their paper's year and shift where they have none."""
    q = "question_number int, text string, options array<string>, section string, topic string, topic_label string, subtopic string, question_type string, difficulty string, confidence_scores struct<topic:double,type:double,difficulty:double>, has_formula boolean, has_diagram_reference boolean, confidence double, page_number int, year int, shift int"
    raw = spark.read.schema(f"source_file string, year int, shift int, questions array<struct<{','.join(_fields(q))}>>").option("multiLine", True).option("pathGlobFilter", "*_analysis.json").json(folder)
    rows = raw.select("source_file", F.col("year").alias("paper_year"), F.col("shift").alias("paper_shift"), F.explode("questions").alias("q")).select("source_file", "paper_year", "paper_shift", "q.*")
    return rows.withColumn("year", F.coalesce("year", "paper_year")).withColumn("shift", F.coalesce("shift", "paper_shift")).drop("paper_year", "paper_shift")


def _fields(ddl: str) -> list[str]:
    return [f"{f.name}:{f.dataType.simpleString()}" for f in T._parse_datatype_string(ddl).fields]


def first_path(spark: SparkSession, paths: list[str]) -> str | None:
    """[S5] The first path that exists, by the session's own file systems."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return next((p for p in paths if (at := hadoop(p)).getFileSystem(conf).exists(at)), None)


def standard_columns(raw: DataFrame) -> DataFrame:
    """[S6, S8] Variant keys to one schema; blanks count as missing; the year also from the file name."""
    have = {c.lower(): c for c in raw.columns}
    pick = lambda *names: first_filled(*(F.col(c) for c in raw.columns if c.lower() in names)) if any(n in have for n in names) else F.lit(None).cast("string")
    return raw.select(
        pick("topic_name", "topic").alias("topic"), pick("subject", "section").alias("section"),
        F.coalesce(F.nullif(pick("year").try_cast("int"), F.lit(0)), year_in(pick("file_name"))).alias("year"),
        pick("question_text", "question", "text").alias("text"), pick("answer", "correct_answer").alias("correct_answer"), pick("difficulty").alias("difficulty"),
    )


def recover_objects(text: str) -> list[str]:
    """Every JSON object that decodes, however damaged what lies between them; lists are gone into."""
    decoder, at, out = json.JSONDecoder(), 0, []

    def take(x) -> None:
        if isinstance(x, dict):
            out.append(json.dumps(x, ensure_ascii=False, sort_keys=True))
        elif isinstance(x, list):
            for y in x:
                take(y)

    while True:
        starts = [i for i in (text.find("{", at), text.find("[", at)) if i >= 0]
        if not starts:
            return out
        at = min(starts)
        try:
            value, at = decoder.raw_decode(text, at)
            take(value)
        except ValueError:
            at += 1


def embedded_value(text: str, name: str) -> str | None:
    """The object or array assigned to a name in a script, by balanced brackets outside of strings."""
    i = text.find(name)
    if i < 0 or (eq := text.find("=", i)) < 0:
        return None
    starts = [j for j in (text.find("{", eq), text.find("[", eq)) if j >= 0]
    if not starts:
        return None
    depth, quote, k = 0, "", min(starts)
    for j in range(k, len(text)):
        c = text[j]
        if quote:
            if c == quote and text[j - 1] != "\\":
                quote = ""
        elif c in "\"'`":
            quote = c
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
            if not depth:
                return text[k : j + 1]
    return None


def _per_text(df: DataFrame, column: str, rows_of: Callable[[str], list[str]], keep: list[str]) -> DataFrame:
    import pandas as pd

    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("pos", T.IntegerType()), T.StructField("value", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(*ids, i, v) for *ids, t in b[[*keep, column]].itertuples(index=False) for i, v in enumerate(rows_of(t or ""))]
            yield pd.DataFrame(found, columns=[*keep, "pos", "value"])

    return df.select(*keep, column).mapInPandas(run, schema)


def recover_json(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """[S7] A row for each object of damaged JSON text."""
    return _per_text(df, column, recover_objects, keep)


def script_values(df: DataFrame, column: str, name: str, keep: list[str]) -> DataFrame:
    """[S17]"""
    return _per_text(df, column, lambda t: [v] if (v := embedded_value(t, name)) is not None else [], keep)


def strip_tags(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"<[^>]+>", " "), r"\s+", " "))


def html_cells(pages: DataFrame, key: str, html: str, tag: str = "td") -> DataFrame:
    """[S16] The text of each element of a kind, by page and place."""
    found = F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}[^>]*>(.*?)</{tag}>"), 1)
    return pages.select(key, F.posexplode(found).alias("pos", "cell")).select(key, "pos", strip_tags(F.col("cell")).alias("cell"))


def series_from_config(spark: SparkSession, counts: dict[str, list[int]], first_year: int, sections: dict[str, str], default: str = "general_awareness") -> DataFrame:
    """[S9, J2] topic, section, year, cnt from lists by topic."""
    return series_from_arrays(spark.createDataFrame([(t, sections.get(t, default), v) for t, v in counts.items()], "topic string, section string, v array<int>"), "v", first_year)


def series_from_arrays(lists: DataFrame, values: str, first_year: int) -> DataFrame:
    """[S9] topic, section, year, cnt from a table with a list of counts a topic, from the first year on."""
    each = lists.select("topic", "section", F.posexplode(values).alias("i", "cnt"))
    return each.select("topic", "section", (F.col("i") + first_year).alias("year"), F.col("cnt").cast("long").alias("cnt"))


def read_papers(spark: SparkSession, folder: str, extract: Callable[[bytes], Iterable[tuple[int, str]]], pattern: str = "*.pdf") -> DataFrame:
    """[S11, S12, S13, X17, E12] Binary files through an injected extractor: path, year of the name, page, text, error. One bad file is a row with an error.

    A task holds the pages of one file at a time and hands them on in slices."""
    import pandas as pd

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in b.itertuples(index=False):
                try:
                    rows = [(path, int(n), t, None) for n, t in extract(content)]
                except Exception as e:
                    rows = [(path, None, None, f"{type(e).__name__}: {e}")]
                for i in range(0, len(rows), 4096):
                    yield pd.DataFrame(rows[i : i + 4096], columns=["path", "page", "text", "error"]).astype({"page": "Int32"})

    return files.mapInPandas(run, "path string, page int, text string, error string").withColumn("year", year_in(F.col("path")))


def read_importances(spark: SparkSession, path: str) -> DataFrame:
    """[S18] feature, importance from CSV with a header."""
    return spark.read.option("header", True).schema("feature string, importance double").csv(path)


NEWS = "title string, content string, source string, published string, url string"

#: What read_news gives without a fetcher.
SAMPLE_NEWS = [
    ("Air force receives new missile", "The Indian Air Force and DRDO tested a missile on 12 March 2025.", "desk", "2025-03-12", "u1"),
    ("Chess champion wins medal", "The champion won a medal and a trophy at the world cup.", "desk", "2025-02-01", "u2"),
    ("Budget raises research", "The budget gives 500 crore for research and trade.", "wire", "2025-01-20", "u3"),
    ("Summit ends with treaty", "A summit of ministers signed a bilateral treaty.", "wire", "2024-11-05", "u4"),
    ("Local fair opens", "A fair opened downtown.", "desk", "2024-06-01", "u5"),
]


def read_news(spark: SparkSession, fetch: Callable[[dict], list[dict]] | None = None, requests: DataFrame | None = None) -> DataFrame:
    """[S14, S19] title, content, source, published, url: what an injected fetcher answers to each row of requests, on the executors; keys that an article lacks are
    null. A fetcher speaks to its service and must be safe to call again, as tasks are repeated. Without one, five rows for tests and offline use."""
    if fetch is None:
        rows = spark.createDataFrame(SAMPLE_NEWS, NEWS)
    else:
        import pyarrow as pa

        names = [f.name for f in T._parse_datatype_string(NEWS).fields]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [a for request in b.to_pylist() for a in fetch(request)]
                yield pa.RecordBatch.from_arrays([pa.array([a.get(n) for a in found], pa.string()) for n in names], names)

        rows = requests.mapInArrow(run, NEWS)
    return rows.withColumn("published", F.to_timestamp_ntz("published"))


def read_bank(spark: SparkSession, path: str) -> DataFrame:
    """[S10, X18] The question bank as it was appended, columns of later versions too."""
    return spark.read.option("mergeSchema", True).parquet(path)
