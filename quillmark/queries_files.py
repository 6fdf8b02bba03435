"""Queries over sources and sinks: the driver's tables are written in a shape that a reader expects, and read back."""

from __future__ import annotations

import json
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import normalize as nz, text as tx
from .operators.lineage import scratch
from .queries import query, table
from .sources import bank as bk
from .sources import json_ranges as jr
from .sources import pages as pg
from .sources import readers as rd
from .sources import writers as wr


def part_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as questions: every seventh has no topic, every fifth no shift, every third no difficulty."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("p"), k).alias("id"), (F.lit(2000) + F.col("p_size") % 20).cast("int").alias("year"), F.when(k % 5 != 0, (k % 4).cast("int")).alias("shift"), F.col("p_type").alias("section"),
        F.when(k % 7 != 0, F.col("p_brand")).alias("topic"), F.col("p_name").alias("text"), F.array("p_type", "p_brand").alias("options"), F.when(k % 3 != 0, F.lit("hard")).alias("difficulty"),
    )


PARTS = """WITH q AS (SELECT 'p' || p_partkey AS id, CAST(2000 + p_size % 20 AS INT) AS year, CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_partkey % 4 AS INT) END AS shift, p_type AS section, CASE WHEN p_partkey % 7 <> 0 THEN p_brand END AS topic, p_name AS text, [p_type, p_brand] AS options, CASE WHEN p_partkey % 3 <> 0 THEN 'hard' END AS difficulty FROM part) """


def json_files(spark: SparkSession, sf_dir: str, wrapped: bool = False) -> str:
    """A file for each year: an array of its questions, or an object that holds it."""
    at = scratch(spark, "questions")
    g = part_questions(spark, sf_dir).groupBy("year").agg(F.collect_list(F.struct("id", "year", "shift", "section", "topic", "text", "options", "difficulty")).alias("questions"))
    g.select(F.to_json(F.struct("questions") if wrapped else F.col("questions"))).write.option("maxRecordsPerFile", 1).text(at)
    return at


# --- sources ---
@query(PARTS + "SELECT id, year, coalesce(shift, 1) AS shift, section, topic, text, array_to_string(options, '|') AS options, coalesce(difficulty, 'medium') AS difficulty FROM q WHERE topic IS NOT NULL")
def scan_questions_json(spark, sf_dir):
    good, _ = rd.read_questions_json(spark, json_files(spark, sf_dir))
    return good.select("id", "year", "shift", "section", "topic", "text", F.array_join("options", "|").alias("options"), "difficulty")


@query(PARTS + "SELECT id, year, section FROM q WHERE topic IS NULL")
def scan_question_rejects(spark, sf_dir):
    _, bad = rd.read_questions_json(spark, json_files(spark, sf_dir, wrapped=True))
    return bad.select("id", "year", "section")


@query(PARTS + "SELECT id, year, coalesce(shift, 1) AS shift, replace(lower(trim(section)), ' ', '_') AS section, topic, text, array_to_string(options, '|') AS options FROM q")
def scan_questions_csv(spark, sf_dir):
    at = scratch(spark, "csv")
    part_questions(spark, sf_dir).withColumn("options", F.to_json("options")).write.option("header", True).option("escape", '"').csv(at)
    got = rd.read_questions_csv(spark, at)
    return got.select("id", "year", "shift", "section", "topic", "text", F.array_join("options", "|").alias("options"))


@query(PARTS + "SELECT kind, year, count(*) AS cnt, count(topic) AS n_topics FROM (SELECT 'json' AS kind, year, topic FROM q WHERE topic IS NOT NULL UNION ALL SELECT 'csv', year, topic FROM q) GROUP BY ALL")
def scan_question_folder(spark, sf_dir):
    at = scratch(spark, "folder")
    q = part_questions(spark, sf_dir)
    q.withColumn("options", F.to_json("options")).withColumn("source", F.lit("csv")).write.option("header", True).option("escape", '"').csv(f"{at}/a.csv")
    g = q.withColumn("source", F.lit("json")).groupBy("year").agg(F.collect_list(F.struct("*")).alias("questions"))
    g.select(F.to_json("questions")).write.option("maxRecordsPerFile", 1).text(f"{at}/b.json")
    return rd.read_question_folder(spark, at).groupBy(F.col("source").alias("kind"), "year").agg(F.count("*").alias("cnt"), F.count("topic").alias("n_topics"))


@query("""SELECT 'u' || user_id AS source_file, CAST(event_id AS INT) AS question_number, event_type AS section, CASE WHEN event_id % 2 = 0 THEN 2019 ELSE 2010 + user_id % 10 END AS year, CAST(user_id % 3 AS INT) AS shift, round(value, 6) AS topic_confidence FROM events""")
def scan_analyses(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    question = F.struct(
        F.col("event_id").cast("int").alias("question_number"), F.col("event_type").alias("section"), F.struct(F.round("value", 6).alias("topic")).alias("confidence_scores"), F.when(F.col("event_id") % 2 == 0, 2019).alias("year")
    )
    g = e.groupBy("user_id").agg(F.collect_list(question).alias("questions")).select(F.concat(F.lit("u"), "user_id").alias("source_file"), (F.lit(2010) + F.col("user_id") % 10).alias("year"), (F.col("user_id") % 3).alias("shift"), "questions")
    at = scratch(spark, "analyses")
    # Files hold lists of 50 papers: one file a paper is a call of the driver a paper.
    lists = g.groupBy(F.floor(F.monotonically_increasing_id() / 50)).agg(F.collect_list(F.struct("*")).alias("papers"))
    lists.select(F.to_json("papers")).write.option("maxRecordsPerFile", 1).text(at)
    # Spark names its files itself; readers of papers look for *_analysis.json.
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    fs = files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for f in fs.listStatus(files):
        if f.getPath().getName().startswith("part-"):
            fs.rename(f.getPath(), f.getPath().suffix("_analysis.json"))
    got = rd.read_analyses(spark, at)
    return got.select("source_file", "question_number", "section", F.col("year").cast("long").alias("year"), "shift", F.col("confidence_scores.topic").alias("topic_confidence"))


@query("SELECT 'part' AS found, (SELECT count(*) FROM part) AS n_rows")
def scan_first_path(spark, sf_dir):
    at = rd.first_path(spark, [f"{sf_dir}/nowhere.parquet", f"{sf_dir}/part.parquet", f"{sf_dir}/orders.parquet"])
    return spark.read.parquet(at).agg(F.count("*").alias("n_rows")).withColumn("found", F.lit(at.rsplit("/", 1)[-1].split(".")[0]))


@query("""SELECT c_name AS topic, c_mktsegment AS section, CASE WHEN c_custkey % 3 = 0 THEN 2000 + CAST(c_custkey % 20 AS INT) WHEN c_custkey % 3 = 1 THEN 2015 END AS year, CASE WHEN c_custkey % 2 = 0 THEN 'q' || c_custkey ELSE 't' || c_custkey END AS text, CAST(c_nationkey AS VARCHAR) AS correct_answer, NULL::VARCHAR AS difficulty FROM customer""")
def variant_keys(spark, sf_dir):
    k = F.col("c_custkey")
    raw = table(spark, sf_dir, "customer").select(
        F.lit("").alias("Topic_Name"), F.col("c_name").alias("topic"), F.col("c_mktsegment").alias("Subject"), F.when(k % 3 == 0, (F.lit(2000) + k % 20).cast("string")).when(k % 3 == 1, "0").otherwise("n.d.").alias("year"),
        F.when(k % 3 == 1, "AFC_2015_1.pdf").otherwise("paper.pdf").alias("file_name"), F.when(k % 2 == 0, F.concat(F.lit("q"), k)).alias("question_text"), F.concat(F.lit("t"), k).alias("text"), F.col("c_nationkey").alias("answer"),
    )
    return rd.standard_columns(raw)


@query("SELECT b.p_brand AS topic, NULL AS section, CAST(2000 + y AS INT) AS year, (SELECT count(*) FROM part p WHERE p.p_brand = b.p_brand AND p.p_size % 8 = y) AS cnt FROM (SELECT DISTINCT p_brand FROM part) b, range(8) r(y)")
def series_from_lists(spark, sf_dir):
    """[S9] Brands' lists of counts for eight years, written as JSON and read as series."""
    at = scratch(spark, "config")
    one = table(spark, sf_dir, "part").groupBy("p_brand").agg(*(F.count_if(F.col("p_size") % 8 == y).alias(f"y{y}") for y in range(8)))
    one.select(F.col("p_brand").alias("topic"), F.array(*(f"y{y}" for y in range(8))).alias("counts")).write.json(at)
    lists = spark.read.schema("topic string, section string, counts array<int>").json(at)
    return rd.series_from_arrays(lists, "counts", 2000)


PAGES = "WITH p AS (SELECT doc_id, unnest(string_split(text, '. ')) AS text, unnest(range(1, len(string_split(text, '. ')) + 1)) AS page FROM documents) "


@query(PAGES + "SELECT md5(text) AS text, page, count(*) AS cnt FROM p GROUP BY ALL UNION ALL SELECT 'ValueError: no pages', NULL, (SELECT count(*) FROM region)")
def scan_papers(spark, sf_dir):
    """Files of documents, a line each, whose pages an extractor tells; and one bad file a region, of which each is a row with an error."""
    at = scratch(spark, "papers")
    table(spark, sf_dir, "documents").select(F.to_json(F.struct("text")).alias("value")).write.option("maxRecordsPerFile", 1000).text(f"{at}/good")
    table(spark, sf_dir, "region").select(F.concat(F.lit("bad"), "r_name").alias("value")).write.option("maxRecordsPerFile", 1).text(f"{at}/bad")

    def pages(content: bytes) -> list[tuple[int, str]]:
        import json

        lines = content.decode().splitlines()
        if any(x.startswith("bad") for x in lines):
            raise ValueError("no pages")
        return [(i, t) for x in lines for i, t in enumerate(json.loads(x).get("text", "").split(". "), 1)]

    got = rd.read_papers(spark, at, pages, "*.txt")
    return got.select(F.coalesce("error", F.md5("text")).alias("text"), F.col("page").cast("long").alias("page")).groupBy("text", "page").agg(F.count("*").alias("cnt"))


@lru_cache(1)
def sentences(content: bytes) -> list[str]:
    """Of a file with an object a line; the last file is kept, as each of its pages asks for them."""
    return [t for x in content.decode().split("\n") if x for t in json.loads(x)["text"].split(". ")]


@query("""WITH p AS (SELECT unnest(string_split(coalesce(text, ''), '. ')) AS t FROM documents), q AS (SELECT t, regexp_replace(t, '^\\s+|\\s+$', '', 'g') AS s FROM p)
SELECT CASE WHEN length(s) > 40 THEN 'native' WHEN contains(t, 'z') THEN 'steady' ELSE 'shaky' END AS engine, CASE WHEN length(s) > 40 THEN t WHEN s = '' THEN '' WHEN contains(t, 'z') THEN 'again ' || t ELSE t || '@300' END AS text, count(*) AS cnt, count(*) FILTER (length(s) <= 40 AND contains(t, 'z')) AS n_errors FROM q GROUP BY ALL""")
def scan_pages_by_engines(spark, sf_dir):
    """Documents' sentences as pages: long ones have their text, of the others one engine reads those without a z, the next one the rest."""
    at = scratch(spark, "pages")
    table(spark, sf_dir, "documents").select(F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("text"))).alias("value")).write.option("maxRecordsPerFile", 50).text(at)

    def shaky(picture: str) -> list[tuple]:
        if "z" in picture:
            raise ValueError("a z")
        return [(f"{picture}@300" if picture.strip() else "", 0.9, (0, 0, 1, 1))]

    got = pg.read_pages(spark, at, lambda c: ({"text": t} for t in sentences(c)), lambda c, page, dpi: sentences(c)[page], [("shaky", lambda: shaky), ("steady", lambda: lambda p: [(f"again {p}", 0.5, (0, 0, 1, 1))])], "*.txt", least=40, together=256)
    told = got.select("engine", F.coalesce(F.get("lines", 0)["text"], F.lit("")).alias("text"), F.size("errors").alias("n"))
    return told.groupBy("engine", "text").agg(F.count("*").alias("cnt"), F.sum("n").cast("long").alias("n_errors"))


@query("SELECT o_orderkey, o_orderpriority, round(o_totalprice, 2) AS o_totalprice FROM orders WHERE o_orderkey % 7 <> 3")
def scan_damaged_json(spark, sf_dir):
    """Orders as objects in one list that is never closed, every seventh of them cut; many ranges a file."""
    at, k = scratch(spark, "damaged"), F.col("o_orderkey")
    told = F.to_json(F.struct("o_orderkey", "o_orderpriority", F.round("o_totalprice", 2).alias("o_totalprice"), F.struct(F.lit("a {quoted} mark").alias("note")).alias("more")))
    lines = F.concat(F.when(k % 5 == 0, F.lit('{"questions": [')).otherwise(F.lit("")), F.when(k % 7 == 3, F.expr("substring(t, 1, 20)")).otherwise(F.col("t")), F.when(k % 2 == 0, F.lit(", ")).otherwise(F.lit(" junk }")))
    table(spark, sf_dir, "orders").withColumn("t", told).select(lines).write.option("lineSep", " ").text(at)
    got = jr.read_damaged(spark, at, "o_orderkey long, o_orderpriority string, o_totalprice double", split=1 << 20, longest=4096)
    return got.filter("o_orderkey IS NOT NULL").select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("SELECT url, '{' || chr(34) || 'id' || chr(34) || ': [' || page_id || ', ' || chr(34) || '}' || chr(34) || ']}' AS value FROM pages")
def script_values(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("url", F.concat(F.lit('var other = 1; const data = {"id": ['), "page_id", F.lit(', "}"]}; data.more = {};')).alias("script"))
    return rd.script_values(p, "script", "const data", ["url"]).select("url", "value")


# --- sinks ---
@query("SELECT o_orderkey, o_orderpriority, round(o_totalprice, 2) AS o_totalprice FROM orders")
def json_sink(spark, sf_dir):
    at, o = scratch(spark, "json"), table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.round("o_totalprice", 2).alias("o_totalprice"))
    wr.write_json(o, at)
    return spark.read.schema(o.schema).json(at)


@query("SELECT doc_id, regexp_replace(replace(lang || ',' || chr(10) || ' x', ',', ';'), '\\s*[\\r\\n]+\\s*', ' ', 'g') AS text, '[' || chr(34) || source || chr(34) || ']' AS tags FROM documents")
def csv_sink(spark, sf_dir):
    at = scratch(spark, "csv")
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat("lang", F.lit(",\n x")).alias("text"), F.array("source").alias("tags"), "n_chars")
    wr.write_csv(d, at, ["doc_id", "text", "tags"])
    return spark.read.option("header", True).schema("doc_id long, text string, tags string").option("escape", "\\").csv(at)


@query("WITH d AS (SELECT doc_id, md5(trim(regexp_replace(lower(text), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS k FROM documents), g AS (SELECT min(doc_id) FILTER (doc_id % 2 = 0) AS even, min(doc_id) AS first FROM d GROUP BY k) SELECT coalesce(even, first) AS doc_id, CASE WHEN even IS NOT NULL THEN 1 ELSE 2 END AS round FROM g")
def bank_append(spark, sf_dir):
    """Documents of even ids go into an empty bank, then all the others: a text that the bank has is not added again."""
    at, d = scratch(spark, "bank"), table(spark, sf_dir, "documents").select("doc_id", "text")
    key = lambda x: tx.text_key(x["text"])
    for round_, rest in ((1, 0), (2, 1)):
        wr.append_new(at, d.filter(F.col("doc_id") % 2 == rest).withColumn("round", F.lit(round_)), key, "doc_id")
    return rd.read_bank(spark, at).select("doc_id", "round")


@query("WITH d AS (SELECT doc_id, md5(trim(regexp_replace(lower(text), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS k FROM documents), g AS (SELECT min(doc_id) FILTER (doc_id % 2 = 0) AS even, min(doc_id) AS first FROM d GROUP BY k) SELECT coalesce(even, first) AS doc_id, CASE WHEN even IS NOT NULL THEN 1 ELSE 2 END AS round FROM g")
def bank_commits(spark, sf_dir):
    """[K3] Two writers at once: the odd ids' writer has written before the even ids' one commits, finds itself too late, and takes out the texts that came in; both
    then repeat their work, which adds nothing."""
    at, d = scratch(spark, "commits"), table(spark, sf_dir, "documents").select("doc_id", "text")
    key = lambda x: tx.text_key(x["text"])

    def add(round_: int, rest: int, **more) -> int:
        return bk.append_unique(at, d.filter(F.col("doc_id") % 2 == rest).withColumn("round", F.lit(round_)), key, "doc_id", **more)

    once = []
    add(2, 1, batch="odd", before_commit=lambda: once or once.append(add(1, 0)))
    add(1, 0)
    add(2, 1, batch="odd")
    return bk.read_committed(spark, at).select("doc_id", "round")


@query("SELECT (SELECT count(*) FROM region) AS before, 0 AS after")
def bank_clear(spark, sf_dir):
    at, d = scratch(spark, "bank"), table(spark, sf_dir, "region")
    d.write.parquet(at)
    before = spark.read.parquet(at).count()
    wr.clear(at, d)
    return rd.read_bank(spark, at).agg(F.lit(before).cast("long").alias("before"), F.count("*").cast("int").alias("after"))


@query("SELECT o_orderpriority, count(*) AS cnt, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1")
def write_by_priority(spark, sf_dir):
    at = scratch(spark, "by")
    wr.write_by(table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey"), at, "o_orderpriority")
    return spark.read.schema("o_orderkey long, o_orderpriority string").json(at).groupBy("o_orderpriority").agg(F.count("*").alias("cnt"), F.sum("o_orderkey").alias("keys"))


@query("SELECT user_id, count(*) AS total_questions, string_agg(event_id || ':' || event_type, ',' ORDER BY event_id) AS questions, (SELECT string_agg(t || '=' || n, ',' ORDER BY t) FROM (SELECT event_type AS t, count(*) AS n FROM events x WHERE x.user_id = e.user_id GROUP BY 1)) AS sections FROM events e GROUP BY user_id")
def paper_files(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("section"))
    p = wr.paper_rows(e, ["user_id"], "event_id")
    told = F.array_join(F.transform("questions", lambda q: F.concat_ws(":", q["event_id"], q["section"])), ",")
    by = F.array_join(F.transform(F.array_sort(F.map_entries("section_breakdown")), lambda x: F.concat_ws("=", x["key"], x["value"])), ",")
    return p.select("user_id", "total_questions", told.alias("questions"), by.alias("sections"))


@query("SELECT '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS json FROM nation")
def json_strings(spark, sf_dir):
    return wr.as_json(table(spark, sf_dir, "nation").withColumn("n_nationkey", F.col("n_nationkey").cast("long")), "n_nationkey", "n_name")


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS text, 4 AS n_options FROM documents")
def short_rows(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.array(*(F.lit(c) for c in "abcde")).alias("options"))
    return wr.short_rows(d).select("doc_id", "text", F.size("options").alias("n_options"))


@query("SELECT '<tr><td>' || n_nationkey || '</td><td>a&lt;' || n_name || '&amp;&gt;</td><td></td></tr>' AS html FROM nation ORDER BY n_nationkey")
def html_table(spark, sf_dir):
    at = scratch(spark, "html")
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("a<"), "n_name", F.lit("&>")).alias("name"), F.lit(None).cast("string").alias("none"))
    wr.write_html(n, at, "n_nationkey")
    return spark.read.text(f"{at}/rows").select(F.col("value").alias("html"))


@query("SELECT 'const data = {\"r\":[' || (SELECT string_agg('{\"r_name\":\"' || r_name || '\"}', ',' ORDER BY r_name) FROM region) || '],\"n\":[' || (SELECT string_agg('{\"n_name\":\"' || n_name || '\"}', ',' ORDER BY n_name) FROM nation) || ']};' AS script")
def script_bundle(spark, sf_dir):
    parts = {"r": table(spark, sf_dir, "region").select("r_name").orderBy("r_name"), "n": table(spark, sf_dir, "nation").select("n_name").orderBy("n_name")}
    return spark.createDataFrame([(wr.script_bundle("data", parts),)], "script string")


@query("SELECT coalesce(s.name, c.name) AS name, c.name AS new_name, CASE WHEN s.name IS NULL THEN 'missing' WHEN c.name IS NULL THEN 'unmapped' ELSE 'rename' END AS status FROM (SELECT 'k' || s_suppkey AS name FROM supplier) s FULL JOIN (SELECT 'k' || c_custkey AS name FROM customer) c ON s.name = c.name")
def rename_plan(spark, sf_dir):
    files = table(spark, sf_dir, "supplier").select(F.concat(F.lit("k"), "s_suppkey").alias("name"))
    mapping = table(spark, sf_dir, "customer").select(F.concat(F.lit("k"), "c_custkey").alias("old")).withColumn("new", F.col("old"))
    return wr.rename_plan(files, mapping)


@query("SELECT n_name AS feature, n_nationkey / 8.0 AS importance FROM nation")
def importance_files(spark, sf_dir):
    at = scratch(spark, "importances")
    wr.write_importances(table(spark, sf_dir, "nation").select(F.col("n_name").alias("feature"), (F.col("n_nationkey") / 8.0).alias("importance")), at)
    return rd.read_importances(spark, f"{at}/csv")


@query("SELECT 'order ' || o_orderkey AS title, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def news_rows(spark, sf_dir):
    """[S19] An article an order, as an offline source tells them."""
    asked = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    told = rd.read_news(spark, lambda at: [{"title": f"order {at['o_orderkey']}", "published": at["day"]}], asked)
    return told.select("title", F.date_format("published", "yyyy-MM-dd").alias("day"))


@query("SELECT 'u' || page_id AS url, substr(html, 1, 40) AS title FROM pages")
def news_fetched(spark, sf_dir):
    """Articles from an injected fetcher, a request a page of the source."""
    return rd.read_news(spark, lambda at: [{"title": at["html"][:40], "content": "", "source": "desk", "published": "2025-01-02T03:04:05", "url": f"u{at['page_id']}"}], table(spark, sf_dir, "pages").select("page_id", "html")).select("url", "title")


@query("SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'missing text' WHEN p_partkey % 7 = 0 THEN 'missing section' WHEN p_partkey % 5 = 0 THEN 'missing options' END AS reject_reason, CASE WHEN p_partkey % 3 = 0 THEN 'general' ELSE p_brand END AS topic, CASE WHEN p_partkey % 2 = 0 THEN 'Medium' ELSE 'Hard' END AS difficulty FROM part")
def checked_rows(spark, sf_dir):
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(
        "p_partkey", F.when(k % 11 == 0, " ").otherwise(F.col("p_name")).alias("text"), F.when(k % 7 != 0, F.col("p_type")).alias("section"), F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array("p_brand")).alias("options"),
        F.when(k % 3 == 0, "").otherwise(F.col("p_brand")).alias("topic"), F.when(k % 2 == 1, "hard").alias("difficulty"),
    )
    return nz.checked_rows(p).select("p_partkey", "reject_reason", "topic", "difficulty")
