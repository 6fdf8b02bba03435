"""Small literal frames: known values, ties, nulls, order of rows."""

import random

import pytest
from pyspark.sql import functions as F

from quillmark.functions import fixed, normalize as nz, stats, text as tx
from quillmark.operators import allocate as al
from quillmark.operators import evaluate as ev
from quillmark.operators import extract as ex
from quillmark.operators import features as ft
from quillmark.operators import frequency as fq
from quillmark.operators import rank as rk
from quillmark.operators import sequence as sq
from quillmark.operators import similarity as sm
from quillmark.operators import trend as tr
from quillmark.plans import models as pm
from quillmark.plans import study as st
from quillmark.sources import readers as rd
from quillmark.sources import writers as wr
from quillmark.streaming import live

SERIES = {"alt": [3, 4, 3, 4, 3, 4], "late": [0, 0, 0, 0, 1, 1], "flat": [2] * 6, "up": [1, 2, 3, 4, 5, 6], "drop": [6, 6, 6, 1, 1, 2]}

# Counts by topic for six years, in the order of the list that the golden plan was made from.
TOPICS = {
    "numerical_ability": {"speed_time_distance": "343434", "time_and_work": "232333", "profit_loss": "223223", "simple_compound_interest": "212212", "ratio_proportion": "221222", "percentage": "222122", "average": "122211", "decimal_fractions": "223222", "clocks": "010111", "probability": "000011"},
    "verbal_ability": {"reading_comprehension": "434434", "cloze_test": "565656", "synonyms": "455555", "antonyms": "344344", "error_spotting": "334334", "idioms_phrases": "343433", "sentence_completion": "323232", "one_word_substitution": "222222", "para_jumbles": "212222"},
    "reasoning": {"spatial_ability": "565656", "dot_situation": "232323", "venn_diagrams": "233232", "analogy": "445445", "series": "333333", "coding_decoding": "222222", "blood_relations": "212121", "direction_sense": "121212", "odd_one_out": "212221"},
    "general_awareness": {"defense": "554545", "current_affairs": "677677", "history": "343433", "geography": "334334", "polity": "222222", "science": "222332", "sports": "334343", "static_gk": "222222"},
}


@pytest.fixture(scope="module")
def series(spark):
    return spark.createDataFrame([(k, 2020 + i, v) for k, vs in SERIES.items() for i, v in enumerate(vs)], "topic string, year int, cnt long").repartition(5)


def by(df, key, *columns):
    return {r[key]: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


def near(a, b, e=1e-5):
    return (a is None and b is None) or abs(a - b) < e


def test_series_values(series):
    t = by(tr.trend_test(series, ["topic"]), "topic", "slope", "p")
    for k, slope, p in (("alt", 0.085714, 0.573392), ("late", 0.228571, 0.041795), ("flat", 0, 1), ("up", 1, 0), ("drop", -1.142857, 0.041795)):
        assert near(t[k][0], slope) and near(t[k][1], p), k
    a = by(tr.alternation(series, ["topic"]), "topic", "p", "strength")
    for k, p, s in (("alt", 0, 0.284900), ("late", 1, 0), ("flat", None, 0), ("up", 0.573392, 0.284900), ("drop", 0.587050, 0.362647)):
        assert near(a[k][0], p) and near(a[k][1], s), k
    b = by(tr.structural_break(series, ["topic"]), "topic", "detected", "break_year", "magnitude")
    assert not b["alt"][0] and not b["late"][0] and not b["flat"][0]
    assert b["up"][:2] == (True, 2022) and near(b["up"][2], 0.855, 1e-3)
    assert b["drop"][:2] == (True, 2023) and near(b["drop"][2], 1.269, 1e-3)
    f = by(ft.temporal_features(series, ["topic"]), "topic", "ema")
    for k, e in (("alt", 3.519030), ("late", 0.51), ("flat", 2), ("up", 4.058830), ("drop", 3.015)):
        assert near(f[k], e), k
    assert near(by(tr.linear_trend(series, ["topic"], x="year"), "topic", "r2")["flat"], 0)


def test_fixed_break_year(series):
    b = by(tr.structural_break(series, ["topic"], at_year=2023), "topic", "break_year")
    assert b["drop"] == 2023 and b["up"] == 2023 and b["flat"] is None


def test_t_pvalue(spark):
    got = [r.p for r in spark.createDataFrame([(12.7062047, 1), (4.30265273, 2), (3.18244631, 3), (2.77644511, 4), (2.57058184, 5), (2.22813885, 10), (None, 3)], "t double, df int").select(stats.t_pvalue(F.col("t"), F.col("df")).alias("p")).collect()]
    assert all(near(p, 0.05, 1e-8) for p in got[:-1]) and got[-1] is None


def test_streak_and_padding(spark):
    s = spark.createDataFrame([("a", 2020, 1), ("a", 2021, 0), ("a", 2022, 2), ("a", 2023, 3)], "topic string, year int, cnt long")
    assert by(ft.series_stats(s, ["topic"]), "topic", "streak")["a"] == 2
    r = ft.features13(s, ["topic"], 2024).first()
    assert [r[f"last{i}"] for i in range(1, 6)] == [1, 0, 2, 3, 0]
    assert by(ft.calendar_run(spark.createDataFrame([("a", y, 1) for y in (2010, 2012, 2013, 2014)], "topic string, year int, cnt long"), ["topic"]), "topic", "run")["a"] == 3


def test_roi_plan_golden(spark):
    rows, pos = [], 0
    for section, topics in TOPICS.items():
        for topic, v in topics.items():
            rows += [(pos, topic, section, 2020 + i, int(c)) for i, c in enumerate(v)]
            pos += 1
    plan = st.roi_plan(spark.createDataFrame(rows, "pos int, topic string, section string, year int, cnt long").repartition(7)).collect()
    got = [(r.topic, r.predicted, r.confidence, r.trend, r.roi, r.difficulty, r.hours) for r in plan]
    assert got == [
        ("current_affairs", 7.4, 0.9, "stable", 9.33, "low", 17.7), ("defense", 4.4, 0.9, "stable", 6.53, "low", 12.4), ("cloze_test", 5.7, 0.9, "stable", 5.5, "medium", 10.5),
        ("spatial_ability", 5.7, 0.9, "stable", 5.5, "medium", 10.5), ("synonyms", 5.2, 0.9, "stable", 4.83, "medium", 9.2), ("history", 2.7, 0.9, "stable", 4.67, "low", 8.9),
        ("geography", 3.8, 0.9, "stable", 4.67, "low", 8.9), ("sports", 3.6, 0.9, "stable", 4.67, "low", 8.9), ("analogy", 4.8, 0.9, "stable", 4.33, "medium", 8.2),
        ("reading_comprehension", 3.5, 0.9, "stable", 3.67, "medium", 7.0), ("antonyms", 4.4, 0.9, "stable", 3.67, "medium", 7.0), ("error_spotting", 3.8, 0.9, "stable", 3.33, "medium", 6.3),
        ("idioms_phrases", 2.7, 0.9, "stable", 3.33, "medium", 6.3), ("science", 2.6, 0.9, "stable", 3.27, "low", 6.2), ("series", 3.0, 0.9, "stable", 3.0, "medium", 5.7),
    ]


def test_enforcement_fixture_and_loop(spark):
    names = ["VA", "GA", "NA", "RM"]
    rank = F.nullif(F.array_position(F.array(*map(F.lit, names)), F.col("s")), F.lit(0)) - 1
    seq = [("VA", 0.95), ("GA", 0.5), ("GA", 0.92), ("VA", 0.99), ("unknown", 0.0), ("RM", 0.8), ("NA", 0.95), ("GA", 0.95)]
    rng = random.Random(1)
    cases = [seq] + [[(rng.choice([*names, "unknown"]), rng.choice([0.5, 0.9, 0.95])) for _ in range(rng.randrange(1, 20))] for _ in range(60)]
    df = spark.createDataFrame([(g, i, s, c) for g, x in enumerate(cases) for i, (s, c) in enumerate(x)], "g int, q int, s string, c double").repartition(6)
    got = {(r.g, r.q): r.enforced for r in sq.enforce_order(df, ["g"], ["q"], rank.cast("int"), "c").collect()}
    for g, x in enumerate(cases):
        at = 0
        for i, (s, c) in enumerate(x):
            if s in names and c >= 0.9:
                at = max(at, names.index(s))
            assert got[g, i] == at
    assert [names[got[0, i]] for i in range(8)] == "VA VA GA GA GA GA NA NA".split()


def test_gap_fill_quota_and_budget(spark):
    y = spark.createDataFrame([(i, v) for i, v in enumerate([2020, None, 2020, None, None, 2021, None])], "i int, y int").withColumn("g", F.lit(1))
    assert [r.f for r in sq.fill_between(y, ["g"], ["i"], "y", "f").orderBy("i").collect()] == [2020, 2020, 2020, None, None, 2021, None]
    w = spark.createDataFrame([(1, i, 4) for i in range(4)], "g int, i int, want int")
    assert [r.given for r in al.greedy_fill(w, "want", ["g"], ["i"], F.lit(10)).orderBy("i").collect()] == [4, 4, 2, 0]
    m = spark.createDataFrame([(1, i, v) for i, v in enumerate([60, 60, 60, 30])], "g int, i int, m int")
    assert al.take_until(m, "m", ["g"], ["i"], 170).count() == 3
    assert {r.n for r in al.largest_remainder(spark.createDataFrame([(1, t, 1.0) for t in "abc"], "g int, t string, v double"), "v", ["g"], 10, ["t"]).collect()} == {3, 4}


def test_share_of_zero_total(spark):
    z = spark.createDataFrame([("a", 0), ("a", 0)], "g string, v long")
    assert [r.share for r in fq.share(z, "v", ["g"]).collect()] == [None, None]
    assert [r.n for r in al.largest_remainder(z.withColumn("t", F.lit("x")), "v", ["g"], 1, ["t"]).orderBy("n").collect()] == [0, 1]


def test_diagnostics_fixture(spark):
    rows = [(1, n, 0.8 if n <= 70 else 0.5) for n in range(1, 92)]
    df = spark.createDataFrame(rows, "p int, q int, c double")
    assert sorted(r.q for r in sq.missing_numbers(df, ["p"], "q", F.lit(100)).collect()) == list(range(92, 101))
    b = ev.confidence_buckets(df, "c").first()
    assert (b.high, b.medium, b.low) == (0, 70, 21)


def test_names(spark):
    one = spark.range(1)
    code = nz.first_code(F.lit("speed_time_distance"), [("time", "NA_TW"), ("speed", "NA_SP")], F.lit("NA"))
    assert one.select(code).first()[0] == "NA_TW"
    assert one.select(nz.first_code(F.lit("blood relations"), [("time", "X")], F.lit("RM"))).first()[0] == "RM_BLOOD RELA"
    assert one.select(tx.text_key(F.lit("  A  b ")) == tx.text_key(F.lit("a B"))).first()[0]
    assert one.select(nz.year_in(F.lit("paper_2022_1.pdf"))).first()[0] == 2022 and one.select(nz.year_in(F.lit("x"))).first()[0] is None
    r = spark.createDataFrame([("q", "va", ["x"], None, None), (None, "va", ["x"], "t", "hard"), ("q", " ", ["x"], "t", "hard"), ("q", "va", [], "t", "hard")], "text string, section string, options array<string>, topic string, difficulty string")
    assert [x.reject_reason for x in nz.checked_rows(r).collect()] == [None, "missing text", "missing section", "missing options"]


def test_shift_table(spark):
    n = {2011: 100, 2012: 200, 2020: 105, 2022: 320, 2023: 205, 2024: 491, 2025: 437}
    obs = spark.createDataFrame([(y,) for y, k in n.items() for _ in range(k)], "year int")
    assert by(fq.estimated_shifts(obs, "year"), "year", "shifts") == {2011: 1, 2012: 2, 2020: 1, 2022: 3, 2023: 2, 2024: 5, 2025: 4}


def test_text_functions(spark):
    one = spark.range(1)
    v = lambda c: one.select(c).first()[0]
    assert v(tx.numbers(F.lit("x 3/4 and -2.5, 1/0"))) == [0.75, -2.5]
    assert v(tx.operations(F.lit("2 + 3% of √9"))) == ["addition", "percentage", "root"]
    assert v(tx.numbers_by_unit(F.lit("ratio 3:4 at Rs. 50"))) == {"money": [50.0], "ratio": [3.0, 4.0]}
    assert [(o.letter, o.option) for o in v(tx.options_of(F.lit("Pick (b) two (a) one (c) three")))] == [("a", "one"), ("b", "two"), ("c", "three")]
    assert v(tx.roman_number(F.lit("XIV"))) == 14 and v(tx.roman_number(F.lit("abc"))) is None
    assert v(tx.starter_type(F.lit("Find the value of x"))) == "calculation" and v(tx.starter_type(F.lit("tell"))) == "unknown"
    assert v(tx.section_of(F.lit("Choose the synonym of big"))) == "verbal_ability"
    assert v(tx.section_of(F.lit("A train at 60 km/hr covers 120 km"))) == "numerical_ability"
    assert v(tx.math_notation(F.lit("2 x 3 ** pi"))) == "2 × 3 ^ π"
    assert near(v(tx.option_similarity(F.array(F.lit("10"), F.lit("11")))), (0.5 + 0.8) / 2)
    assert v(tx.option_similarity(F.array(F.lit("a")))) == 0.0
    q = tx.quality_score(F.lit("What is the capital of the country (a) x (b) y here and there?"), F.lit(4), F.lit(1.0))
    assert near(v(q), 1.0)
    assert v(tx.is_placeholder(F.lit("[ga placeholder 12]"), F.lit(0)))
    assert v(tx.right_option(F.array(F.lit("x"), F.lit("y")), F.lit("b"))) == "y" and v(tx.right_option(F.array(F.lit("x")), F.lit("D"))) is None
    assert v(tx.numbered_options(F.array(F.lit("p"), F.lit("q")))) == "1) p | 2) q"
    assert v(tx.shorten(F.lit("abcdef"), 3)) == "abc..." and v(tx.shorten(F.lit("abc"), 3)) == "abc"
    assert v(tx.news_class(F.lit("IAF missile and army exercise")))["category"] == "Defense & Military"
    assert v(tx.key_facts(F.lit("On 12 March 2025 Asha Rao gave 500 crore")))[:2] == ["Date: 12 March 2025", "500 crore"]


def test_issues_and_difficulty(spark):
    one = spark.range(1)
    got = one.select(tx.review_issues(F.lit("short"), F.lit(0), F.lit("unknown"), F.lit(0.1), F.lit(0.9))).first()[0]
    assert got == ["low_topic_confidence", "unknown_topic", "question_too_short", "insufficient_options"]
    score, level, sure = tx.difficulty(F.lit("What is 2?"), F.array().cast("array<string>"), F.lit(0.5))
    assert one.select(score, level, sure).first()[:] == (0.225, "easy", 0.85)
    assert len(fixed.COMPLEX_WORDS) == 21 and len(fixed.DIRECTIVE_CUES) == 15


def test_sequences(spark):
    rows = [("p", i, s) for i, s in enumerate("aabba", 1)]
    df = spark.createDataFrame(rows, "g string, q int, s string").repartition(3)
    b = {r.s: (r.first_at, r.last_at) for r in sq.boundaries(df, ["g"], ["q"], "s", "q").collect()}
    assert b == {"a": (5, 5), "b": (3, 4)}
    assert by(sq.majority(df, ["g"], "s", "q"), "g", "majority")["p"] == "a"
    spans = spark.createDataFrame([("p", 0, 5), ("p", 3, 8), ("p", 5, 6)], "g string, s int, e int")
    assert [(r.s, r.e) for r in sq.without_overlap(spans, ["g"], "s", "e").orderBy("s").collect()] == [(0, 5), (5, 6)]
    num = spark.createDataFrame([("p", "a", 1), ("p", "b", None), ("p", "c", 3), ("p", "d", None)], "g string, o string, n int")
    assert {r.o: r.n for r in sq.renumber(num, ["g"], ["o"], "n", F.lit(4)).collect()} == {"a": 1, "b": 2, "c": 3, "d": 4}
    assert {r.o: r.n for r in sq.renumber(num, ["g"], ["o"], "n").collect()}["d"] is None


def test_majority_tie_is_first_seen(spark):
    df = spark.createDataFrame([("p", 1, "z"), ("p", 2, "a")], "g string, q int, s string")
    assert sq.majority(df, ["g"], "s", "q").first().majority == "z"


def test_extraction(spark):
    text = "1. What is 2 + 2 in total here? (A) 3 (B) 4 (C) 5 (D) 6\n2. Capital of the country named above? (A) x (B) y\n3. Last one"
    d = spark.createDataFrame([(1, text), (2, "no marks\n\nhere"), (3, None), (4, "")], "id int, text string")
    q = {(r.id, r.qnum): r for r in ex.split_questions(d, "id", "text").collect()}
    assert list(q[1, 1].options) == ["3", "4", "5", "6"] and q[1, 1].confidence == 1.0 and (1, 3) in q and (2, None) in q
    zones = spark.createDataFrame(fixed.ZONES, "zone string, lo int, hi int")
    p = ex.placeholders(spark.createDataFrame([(1, 1), (1, 3)], "id int, n int"), zones, ["id"], "n", 5)
    assert {r.n: r.confidence for r in p.collect()} == {2: 0.2, 4: 0.1, 5: 0.1}
    assert by(ex.line_states(spark.createDataFrame([(1, "1. a\nmore\n2. b")], "id int, text string"), "id", "text"), "qnum", "body") == {1: "1. a\nmore", 2: "2. b"}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": "1", "year": 2020, "section": "s", "topic": "t", "text": "x", "options": ["p"]}, {"id": "2"}]')
    (tmp_path / "b.csv").write_text("id,year,shift,section,topic,text\n3,2021,,General Awareness,t,y\n4,bad,1,s,t,z\n")
    good, bad = rd.read_questions_json(spark, str(tmp_path / "a.json"))
    assert good.count() == 1 and bad.count() == 1
    both = rd.read_question_folder(spark, str(tmp_path))
    assert sorted((r.id, r.section, r.shift) for r in both.collect()) == [("1", "s", 1), ("3", "general_awareness", 1)]
    assert rd.recover_objects('x {"a": 1} {bad [ {"b": 2}, {"a": 1}] ') == ['{"a": 1}', '{"b": 2}', '{"a": 1}']
    assert rd.embedded_value('var q; const data = {"a": "}"};', "data") == '{"a": "}"}'
    pages = spark.createDataFrame([(1, "<table><tr><td> a <b>b</b></td><td>c</td></tr></table>")], "id int, html string")
    assert [r.cell for r in rd.html_cells(pages, "id", "html").orderBy("pos").collect()] == ["a b", "c"]
    (tmp_path / "x.pdf").write_bytes(b"ok")
    (tmp_path / "y_2023.pdf").write_bytes(b"bad")

    def extract(content):
        if content == b"bad":
            raise ValueError("no text")
        return [(1, content.decode())]

    got = {r.path.rsplit("/", 1)[1]: (r.text, r.error, r.year) for r in rd.read_papers(spark, str(tmp_path), extract).collect()}
    assert got == {"x.pdf": ("ok", None, None), "y_2023.pdf": (None, "ValueError: no text", 2023)}
    bank = str(tmp_path / "bank")
    rows = spark.createDataFrame([(1, "A b"), (2, "a  B"), (3, "c")], "id int, text string")
    key = lambda d: tx.text_key(d["text"])
    assert wr.append_new(bank, rows, key, "id") == 2 and wr.append_new(bank, rows, key, "id") == 0
    assert spark.read.parquet(bank).count() == 2
    assert "<td>3</td>" in wr.html_report(rows, "t") and wr.script_bundle("d", {"r": rows}).startswith('const d = {"r":[')
    files = spark.createDataFrame([("a",), ("b",)], "name string")
    plan = wr.rename_plan(files, spark.createDataFrame([("a", "x"), ("z", "y")], "old string, new string"))
    assert by(plan, "name", "status") == {"a": "rename", "b": "unmapped", "z": "missing"}


def test_cosine_pairs_equal_all_pairs(spark):
    rng = random.Random(3)
    words = [f"w{'abcdefghij'[i]}" for i in range(10)]
    docs = [(i, "g", " ".join(rng.choice(words) for _ in range(rng.randrange(1, 8)))) for i in range(40)]
    v = sm.tfidf(sm.terms(spark.createDataFrame(docs, "id int, g string, text string"), "id", "g", "text", []), "id", "g").cache()
    got = {(r.a, r.b) for r in sm.cosine_pairs(v, "id", "g").collect()}
    full = v.alias("x").join(v.alias("y"), (F.col("x.term") == F.col("y.term")) & (F.col("x.id") < F.col("y.id"))).groupBy(F.col("x.id").alias("a"), F.col("y.id").alias("b")).agg(F.sum(F.col("x.weight") * F.col("y.weight")).alias("c")).filter("c > 0.7")
    assert got == {(r.a, r.b) for r in full.collect()} and got


def test_models(spark):
    rows = spark.createDataFrame([(i, f"text {i}", "a", 0.2 if i % 2 else 0.9) for i in range(6)], "id int, text string, label string, c double")
    out = by(pm.cascade(rows, "id", "text", "label", "c", [(0.5, lambda ts: [("b", 0.6)] * len(ts)), (0.3, pm.silent)]), "id", "label", "c")
    assert out[1] == ("b", 0.6) and out[0] == ("a", 0.9) and len(out) == 6
    a, b = pm.hash_split(rows, "id")
    assert a.count() + b.count() == 6
    ans = spark.createDataFrame([('```json\n{"question": "q", "options": ["(A) 1", "2", "3", "4"], "answer": "A"}\n```',), ("nothing",)], "answer string")
    got = pm.parsed_answers(ans, "answer").collect()
    assert [(r.valid, r.right_option) for r in got] == [(True, "1"), (False, None)]
    filled = spark.range(1).select(pm.filled_template(F.lit("N men in N days"), F.col("id"), 5, 5)).first()[0]
    assert filled == "5 men in 5 days"


def test_empty_frames(spark):
    e = spark.createDataFrame([], "topic string, year int, cnt long")
    for df in (tr.trend_report(e, ["topic"]), ft.features13(e, ["topic"], 2020), fq.dense(e, ["topic"]), tr.forecasts(e, ["topic"]), tr.structural_break(e, ["topic"])):
        assert df.count() == 0
    assert rk.most_common(e, "topic", "year", 3).count() == 0


def test_streaming_digest(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.sql("SELECT timestamp '2024-01-01 00:00:00' AS ts, 'a' AS k, 0.9D AS v UNION ALL SELECT timestamp '2024-01-02 00:00:00', 'a', 0.1D").write.parquet(src)
    s = spark.readStream.schema("ts timestamp, k string, v double").parquet(src)
    q = live.weekly_digest(s, "ts", "k", "v").writeStream.format("memory").queryName("digest_out").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.cnt, r.best, r.n_strong) for r in spark.table("digest_out").collect()] == [(2, 0.9, 1)]
    u = live.first_seen(s, "ts", F.col("k")).writeStream.format("memory").queryName("first_out").trigger(availableNow=True).start()
    u.awaitTermination(120)
    assert spark.table("first_out").count() == 1


def test_typed_template_and_places(spark):
    from quillmark.functions import matching as mt

    # Units are looked for as they stand, so the m of "more" is one.
    assert mt.typed_template("A train goes 60 km in 2 hours, 5 more") == "A train goes 1_distance km in 1_time hours, 2_distance more"
    assert mt.typed_template("7 of 9") == "{num1} of {num2}"
    d = spark.createDataFrame([(1, "é12 x3"), (2, None)], "id int, t string")
    assert [(r.id, r.start, r.end, r.match) for r in mt.match_places(d, "id", "t", r"\d+").collect()] == [(1, 1, 3, "12"), (1, 5, 6, "3")]


def test_command_line(capsys):
    from quillmark.cli import main

    assert main([]) == 0 and "topic_trend_linreg" in capsys.readouterr().out


def test_many_zones(spark):
    from quillmark.operators import sequence

    zones = spark.createDataFrame([(f"z{i}", 10 * i, 10 * i + 8) for i in range(1500)] + [("late", 5, 12)], "zone string, lo int, hi int")
    rows = spark.createDataFrame([(n,) for n in (0, 9, 10, 14995, 14999, 15000, 11)], "n int")
    got = {r.n: r.zone for r in sequence.in_zone(rows, zones, "n").collect()}
    assert got == {0: "z0", 9: "late", 10: "late", 14995: "z1499", 14999: None, 15000: None, 11: "late"}


def test_many_keywords(spark):
    from quillmark.operators import similarity

    k = spark.createDataFrame([(f"t{i // 3}", "s", f"word{i}x", 1.0, i // 3) for i in range(12_000)], "topic string, section string, keyword string, weight double, ord int")
    rows = spark.createDataFrame([(1, "a word11999x here"), (2, "none"), (3, "WORD3x word4x, aword5xb word0x"), (4, None)], "id long, text string")
    got = {r.id: (r.topic, round(r.topic_score, 6), r.alternates) for r in similarity.keyword_topics(rows, k, F.col("text")).collect()}
    # 3: both topics reach the cap of 1, and the first by ord is told.
    assert got == {1: ("t3999", 1.0, ""), 2: ("unknown", 0.0, ""), 3: ("t0", 1.0, "t1"), 4: ("unknown", 0.0, "")}


def test_reports_tell_what_they_leave_out(spark, tmp_path):
    from quillmark.sources import writers

    rows = spark.range(30).withColumnRenamed("id", "n")
    assert "<p>10 of 30 rows</p>" in writers.html_report(rows, "t", 10) and "<p>" not in writers.html_report(rows, "t", 30)
    with pytest.raises(ValueError, match="over 10 rows"):
        writers.script_bundle("x", {"a": rows}, 10)
    writers.write_html(rows, f"file://{tmp_path}/h", "n")
    assert spark.read.text(f"file://{tmp_path}/h/rows").count() == 30
