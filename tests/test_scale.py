"""Operators whose method is there for long groups, many keywords or many vectors, against plain loops."""

import bisect
import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.operators import allocate, automaton, greedy, sequence, similarity, vectors


# --- walks ---
def kept_spans(spans):
    out, last = [], None
    for s, e in sorted(spans):
        if last is None or s >= last:
            out.append((s, e))
            last = e
    return out


def weeks_of(hours, per_week):
    week, total, out = 1, Decimal(0), []
    for h in hours:
        total += Decimal(str(max(h or 0.0, 0.0)))
        out.append(week)
        if total >= per_week:
            week, total = week + 1, Decimal(0)
    return out


@pytest.mark.parametrize("block", [7, 1 << 16])
def test_walks_equal_folds(spark, block):
    r = random.Random(3)
    spans = [(g, s, s + r.choice([0, 0, 1, 3, 20, -2])) for g, n in (("a", 400), ("b", 60), (None, 50)) for s in (r.randint(-50, 500) for _ in range(n))]
    d = spark.createDataFrame([*spans, ("a", None, 3)], "g string, s long, e long")
    want = sorted(((g, *x) for g in ("a", "b", None) for x in kept_spans([(s, e) for h, s, e in spans if h == g])), key=repr)
    assert sorted(map(tuple, sequence.without_overlap(d, ["g"], "s", "e").collect()), key=repr) == want
    assert sorted(map(tuple, greedy.spans_apart(d, ["g"], "s", "e", block).collect()), key=repr) == want
    assert sorted(map(tuple, sequence.without_overlap(d, ["g"], "s", "e", crowd=55).collect()), key=repr) == want
    assert sequence.without_overlap(d.limit(0), ["g"], "s", "e", crowd=0).collect() == []


@pytest.mark.parametrize("block", [5, 1 << 16])
def test_weeks_by_walk_equal_folds(spark, block):
    r = random.Random(4)
    rows = [(g, i, r.choice([None, -1.0, 0.0, 0.1, 0.2, 2.5, 30.0])) for g, n in (("x", 300), ("y", 1), ("z", 40)) for i in range(n)]
    d = spark.createDataFrame(rows, "g string, i int, h double")
    want = {(g, i): w for g in "xyz" for (i, w) in zip([x[1] for x in rows if x[0] == g], weeks_of([x[2] for x in rows if x[0] == g], Decimal(3)))}
    for got in (allocate.pack_weeks(d, "h", ["g"], ["i"], 3.0), allocate.pack_weeks(d, "h", ["g"], ["i"], 3.0, crowd=0), greedy.filled_weeks(d, "h", ["g"], ["i"], 3.0, block)):
        assert {(x.g, x.i): x.week for x in got.collect()} == want


def test_one_long_group_over_many_tasks(spark):
    """100,000 spans of one group: the walk of a plain loop, and no task that holds the group."""
    n = 100_000
    d = spark.range(n).select(F.lit("g").alias("g"), (F.pmod(F.xxhash64("id"), F.lit(10**7))).alias("s")).withColumn("e", F.col("s") + F.pmod(F.xxhash64("s"), F.lit(900)))
    spans = [(x.s, x.e) for x in d.select("s", "e").collect()]
    got = greedy.spans_apart(d, ["g"], "s", "e", 1 << 14)
    assert sorted((x.s, x.e) for x in got.collect()) == kept_spans(spans)


# --- keywords ---
def whole(text, word):
    import re

    return re.search(r"\b" + re.escape(word) + r"\b", text) is not None


def test_hits_in_cells_equal_one_shard(spark):
    r = random.Random(5)
    words = sorted({"".join(r.choices("ab c.é_1", k=r.randint(1, 4))) for _ in range(150)} | {""})
    texts = ["".join(r.choices("ab c.é_1", k=r.randint(0, 60))) for _ in range(120)] + ["", None]
    t = spark.createDataFrame(list(enumerate(texts)), "key long, text string").repartition(3)
    w = spark.createDataFrame([(x, [x, x + "!"]) for x in words], "word string, tags array<string>")
    want = {(i, x + end, whole(x_, x)) for i, x_ in enumerate(texts) if x_ for x in words if x and x in x_ for end in ("", "!")}
    for got in (automaton.keyword_hits(t, w), automaton.keyword_hits(t, w, shard=20, chunk=500)):
        assert sorted(map(tuple, got.collect())) == sorted(want)
    assert automaton.keyword_hits(t, w.limit(0)).collect() == [] and automaton.keyword_hits(t.limit(0), w, shard=20).collect() == []


def test_a_million_keywords(spark):
    k = spark.range(1_000_000).select(F.concat(F.lit("t"), F.floor(F.col("id") / 2)).alias("topic"), F.lit("s").alias("section"), F.concat(F.lit("word"), "id", F.lit("x")).alias("keyword"), F.lit(1.0).alias("weight"), F.floor(F.col("id") / 2).cast("int").alias("ord"))
    rows = spark.createDataFrame([(1, "a word999999x here"), (2, "none"), (3, "WORD4x and word5x, aword7xb"), (4, None), (5, "a word999999x here")], "id long, text string")
    got = {r.id: (r.topic, round(r.topic_score, 6), r.alternates) for r in similarity.keyword_topics(rows, k, F.col("text")).collect()}
    assert got == {1: ("t499999", 1.0, ""), 2: ("unknown", 0.0, ""), 3: ("t2", 1.0, "t3"), 4: ("unknown", 0.0, ""), 5: ("t499999", 1.0, "")}


# --- zones ---
def test_zones_of_any_length(spark):
    zones = [("long", 10.0**6, 10.0**12), ("short", 1.0, 3.0), ("point", 3.5, 3.5), ("tiny", 3.7, 3.7 + 1e-9), ("crossed", 9.0, 8.0), ("below", float("-inf"), -(10.0**15)), ("null", None, 5.0), ("again", 1.0, 3.0)]
    z = spark.createDataFrame(zones, "zone string, lo double, hi double")
    numbers = [3.7, 3.0, 3.0001, 1.0, 0.999, 3.5, 10.0**12, 10.0**12 + 1, 5 * 10.0**8, 8.5, -(10.0**16), float("-inf"), float("nan"), None, 10.0**300]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(numbers)], "i int, n double")

    def of(n):
        held = sorted((lo, hi, name) for name, lo, hi in zones if lo is not None and n is not None and n == n and lo <= n <= hi)
        return held[0][2] if held else None

    assert {r.i: r.zone for r in sequence.in_zone(rows, z, "n").collect()} == {i: of(n) for i, n in enumerate(numbers)}
    assert {r.zone for r in sequence.in_zone(rows, z.limit(0), "n").collect()} == {None}


def test_random_zones(spark):
    r = random.Random(6)
    zones = [(f"z{i}", a := round(r.uniform(-100, 100), 3), a + r.choice([0, 0.01, 1, 7.5, 64, 150])) for i in range(80)]
    numbers = [round(r.uniform(-120, 300), 3) for _ in range(400)] + [z[1] for z in zones]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(numbers)], "i int, n double")
    got = {x.i: x.zone for x in sequence.in_zone(rows, spark.createDataFrame(zones, "zone string, lo double, hi double"), "n").collect()}
    assert got == {i: min(((lo, hi, z) for z, lo, hi in zones if lo <= n <= hi), default=(0, 0, None))[2] for i, n in enumerate(numbers)}


# --- vectors ---
def test_neighbours_by_lists_and_exactly(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((1500, 12)) + 1.5 * rng.standard_normal((10, 12))[rng.integers(0, 10, 1500)]
    rows = [(i, list(map(float, v))) for i, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 12), (5002, [None] * 12), (5003, list(map(float, x[0])))]
    d = spark.createDataFrame(rows, "id long, v array<double>").repartition(4)
    y = np.vstack([x, x[:1]])
    ids = [*range(1500), 5003]
    y = y / np.linalg.norm(y, axis=1, keepdims=True)
    want = {}
    for i, q in zip(ids, y):
        near = sorted((-round(float(c), 9), j) for j, c in zip(ids, y @ q) if j != i)[:5]
        want[i] = [j for _, j in near]
    of = lambda f: {q: [k for _, k in sorted((r.rank, r.key) for r in g)] for q, g in _grouped(f.collect()).items()}
    exact = of(vectors.nearest_many(d, d, "id", "v", 5, exact=True, lists=vectors.Lists(block=300, chunk=200)))
    assert sum(exact[q] == want[q] for q in want) >= len(want) - 2 and exact.keys() == want.keys()  # a cosine may round either way
    found = of(vectors.nearest_many(d, d, "id", "v", 5, lists=vectors.Lists(length=100, members=40)))
    assert sum(len(set(found[q]) & set(want[q])) for q in want) >= 0.95 * 5 * len(want)
    assert vectors.nearest_many(d, d.limit(0), "id", "v").collect() == [] and vectors.nearest_many(d.limit(0), d, "id", "v").collect() == []


def _grouped(rows):
    out = {}
    for r in rows:
        out.setdefault(r["query"], []).append(r)
    return out


def test_bisect_is_what_pointers_ask(spark):
    r = random.Random(9)
    vs = sorted(r.randint(0, 60) for _ in range(200))
    d = spark.createDataFrame([("g", v, r.randint(-5, 70), i) for i, v in enumerate(vs)], "g string, v long, a long, i int")
    got = greedy.first_at_least(greedy.numbered(d, ["g"], ["v", "i"]), ["g"], "v", "a", "to").collect()
    assert len(got) == 200 and all(x["__pos"] == x.i for x in got)
    assert all(x.to == (p if (p := bisect.bisect_left(vs, x.a)) < 200 else None) for x in got)


# --- the bank ---
def test_interleaved_and_repeated_appends(spark, tmp_path):
    from quillmark.sources import bank

    at, key = f"file://{tmp_path}/bank", lambda d: F.lower(F.trim("text"))
    rows = lambda *xs: spark.createDataFrame(list(xs), "id int, text string")
    texts = lambda: sorted((r.id, r.text) for r in bank.read_committed(spark, at).collect())
    assert bank.read_committed(spark, at) is None
    assert bank.append_unique(at, rows((1, "A"), (2, "a "), (3, None)), key, "id", batch="one") == 1
    assert bank.append_unique(at, rows((9, "z")), key, "id", batch="one") == 0 and texts() == [(1, "A")]
    # The second writer commits while the first has written and not yet committed; a third does so when the first tries again.
    others = [lambda: bank.append_unique(at, rows((10, "b"), (11, "c")), key, "id"), lambda: bank.append_unique(at, rows((12, "d")), key, "id")]
    assert bank.append_unique(at, rows((4, "B"), (5, "D"), (6, "e")), key, "id", before_commit=lambda: others and others.pop(0)()) == 1
    assert texts() == [(1, "A"), (6, "e"), (10, "b"), (11, "c"), (12, "d")]
    # The same batch by two workers at once counts once.
    again = [lambda: bank.append_unique(at, rows((20, "x")), key, "id", batch="two")]
    assert bank.append_unique(at, rows((20, "x")), key, "id", batch="two", before_commit=lambda: again and again.pop()()) == 0
    assert bank.append_unique(at, rows((4, "B")), key, "id") == 0 and bank.append_unique(at, rows((7, None)), key, "id") == 0
    assert [t for _, t in texts()].count("x") == 1
    # New columns are kept; earlier versions stay readable.
    assert bank.append_unique(at, rows((30, "y")).withColumn("more", F.lit("m")), key, "id") == 1
    assert {r.more for r in bank.read_committed(spark, at).collect()} == {None, "m"} and bank.read_committed(spark, at, 1).count() == 1


@pytest.mark.parametrize("hot", [3, 10, 2000])
def test_pairs_of_cells_equal_all_pairs(spark, hot):
    rng = random.Random(hot)
    words = "abcdefghijkl"
    docs = [(i, "gh"[i % 3 == 0], " ".join(rng.choices(words, weights=[40, 20] + [2] * 10, k=rng.randrange(1, 7)))) for i in range(160)] + [(200 + i, "g", "a a a b") for i in range(12)]
    v = similarity.tfidf(similarity.terms(spark.createDataFrame(docs, "id int, g string, text string"), "id", "g", "text", [], least=1), "id", "g").cache()
    rows: dict = {}
    for r in v.collect():
        rows.setdefault((r.g, r.id), {})[r.term] = r.weight
    dot = {(g, a, b): sum(w * y.get(t, 0.0) for t, w in x.items()) for (g, a), x in rows.items() for (h, b), y in rows.items() if g == h and a < b}
    for least in (0.3, 0.7, 0.95):
        got = similarity.cosine_pairs(v, "id", "g", least, hot).collect()
        want = {k: c for k, c in dot.items() if c > least + 1e-9}
        assert {(r.g, r.a, r.b) for r in got} >= set(want) and all(dot[r.g, r.a, r.b] > least - 1e-9 for r in got)
        assert len(got) == len({(r.g, r.a, r.b) for r in got}) and all(abs(r.cosine - dot[r.g, r.a, r.b]) < 1e-9 for r in got)


def test_terms_are_counted_once(spark):
    """What follows reads the written counts: the texts and their words are not in its plan."""
    d = spark.createDataFrame([(1, "g", "aa bb aa"), (2, "g", "bb"), (3, None, "cc")], "id int, g string, text string")
    seen = spark.sparkContext.accumulator(0)

    def told(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    v = similarity.tfidf(similarity.terms(d.mapInArrow(told, d.schema), "id", "g", "text", []), "id", "g")
    assert {(r.id, r.term) for r in v.collect()} == {(1, "aa"), (1, "bb"), (2, "bb")} and seen.value == 3


def test_a_term_of_all_documents(spark):
    """20,000 documents share a term that weighs much in each, but not enough by itself: no pair is formed for it, only for the words that two documents share."""
    n = 20_000
    i = F.col("id")
    words = [(F.concat(F.lit("own"), i.cast("string")), F.lit(0.6)), (F.lit("all"), F.lit(0.77)), (F.concat(F.lit("two"), F.floor(i / 2).cast("string")), F.lit(0.217))]
    v = spark.range(n).select("id", F.lit("g").alias("g"), F.explode(F.array(*(F.struct(t.alias("term"), w.alias("weight")) for t, w in words))).alias("x")).select("id", "g", "x.term", "x.weight")
    got = similarity.candidate_pairs(v, "id", "g", 0.62).collect()
    assert len(got) == n // 2 and all(r.b == r.a + 1 for r in got)
    assert similarity.cosine_pairs(v, "id", "g", 0.62).count() == n // 2 and similarity.cosine_pairs(v, "id", "g", 0.65).count() == 0


def test_queries_go_once_to_a_block(spark):
    """A query that reads many lists is one row, in slices of bounded size, and what is shuffled of n rows grows no faster than n."""
    x = np.random.default_rng(2).normal(size=(300, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = vectors._dealt(rows, x[:200], 150).collect()
    assert len(got) == 300 and all(len(set(r.lists)) == 150 for r in got)
    s = vectors.Lists()
    assert all(-(-n // s.sized(n, s.chunk)) <= 16 and -(-n // s.sized(n, s.block)) <= 16 for n in (1, 5000, 60_000, 600_000, 2_000_000))
    exact = {(r.query, r.key) for r in vectors.nearest_many(rows, rows, "id", "v", 5, exact=True).collect()}
    lists = vectors.Lists(length=20, members=10, block=50, chunk=70)
    found = {(r.query, r.key) for r in vectors.nearest_many(rows, rows, "id", "v", 5, lists=lists).collect()}
    assert len(found) == len(exact) == 1500 and len(found & exact) > 0.9 * len(exact)


def test_most_products_are_dropped_unmeasured(monkeypatch):
    """What single precision can tell is not measured; the k best are those of brute force, with ties of copies, rows without k others, and parts met in any order."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((6000, 16))
    x[3000:3040] = x[:40] * (1 + 1e-9 * rng.standard_normal((40, 16)))
    x, ids = vectors.unit(np.vstack([x, x[:5], x[:5]])), rng.permutation(6010)
    measured, put = [], vectors.Best._put
    monkeypatch.setattr(vectors.Best, "_put", lambda self, a, b: (measured.append(len(a)), put(self, a, b))[1])
    cosine = np.round(x[:200] @ x.T, 9)
    cosine[ids[:200, None] == ids] = -2
    want = [np.lexsort((ids, -c))[:10].tolist() for c in cosine]
    for cuts in ([0, 6010], [0, 7, 300, 301, 2500, 6010]):
        best = vectors.Best(x[:200], x, ids[:200], ids, 10, True)
        for i in rng.permutation(len(cuts) - 1):
            best.meet(np.arange(200), np.arange(cuts[i], cuts[i + 1]))
        assert best.at.tolist() == want
    assert sum(measured) < 0.05 * 2 * cosine.size
    few = vectors.Best(x[:3], x[:3], ids[:3], ids[:3], 10, True)
    few.meet(np.arange(3), np.arange(3))
    assert (few.at >= 0).sum() == 6


def test_blocks_of_lists_are_visited_once():
    """Lists 0 and 1 share block 0, list 2 has blocks 1 to 3, list 3 is empty."""
    got = vectors._visits(np.array([[0, 1], [2, 0], [3, 3], [3, 2]]), np.array([0, 0, 1, 0]), np.array([1, 1, 3, 0]))
    assert got.to_pylist() == [[0], [0, 1, 2, 3], [], [1, 2, 3]]


def test_rows_alike_are_learnt_as_few(spark, monkeypatch):
    """A thousand rows alike enter the fit as 64, and weigh as much as the thousand."""
    from quillmark.plans import models

    class Seen(Exception):
        pass

    def seen(df, name):
        raise Seen(df.groupBy("label").agg(F.count("*").alias("n"), F.sum("__k").alias("k"), F.sum("__w").alias("w")).orderBy("label").collect())

    monkeypatch.setattr(models, "written", seen)
    rows = spark.range(1010).select(F.when(F.col("id") < 1000, "a").otherwise("b").alias("label"), F.lit(1.0).alias("x"))
    with pytest.raises(Seen) as got:
        models.difficulty_classifier(rows, ["x"], "label")
    assert [(r.label, r.n, round(r.k, 6), round(r.w, 6)) for r in got.value.args[0]] == [("a", 64, 1000.0, 505.0), ("b", 10, 10.0, 505.0)]


def test_templates_compile_nothing_a_text(monkeypatch):
    """Numbers are put one by one as a pattern would, without a pattern for each."""
    import re

    from quillmark.functions import matching

    for t in ("12 km 12, 12", "a12b 12\n", "12%12.", "", "1212 12 x", "12"):
        for n in ("12", "1", "2", ""):
            assert matching._put(t, n, "N") == re.sub(re.escape(n) + r"(?=\s|$|[,.])", lambda _: "N", t, count=1)
    monkeypatch.setattr(re, "escape", lambda _: pytest.fail("a pattern for a number"))
    assert matching.typed_template("A train goes 40 km in 3 hours").startswith("A train goes 1_distance km")
