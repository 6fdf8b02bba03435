"""Filter interaction audit: what each filter removes in every order of five filters, from one CUBE.

Documents are counted by their five failure flags and part. CUBE over these six columns gives a row for every choice of them; where the chosen flags are all
false, its count is what survives that subset of filters. A step of an order goes from one subset to the one with its filter more, so every figure is
a difference of two rows, and the 120 orders share 80 such pairs.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import WORD, join_hot, least_of, materialize

FILTERS = "ABCDE"
COUNTS = ("n", "good", "toxic")
ALL = (1 << len(FILTERS)) - 1


def text_flags(text: Column) -> list[Column]:
    """[A, B, C, D]: whether a text (null: empty) has under 100 words, under 80 % distinct words, over 10 % of A-Z, any of #$%&*|."""
    t = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(t, F.lit(f"({WORD})"), 1)
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    return [n < 100, 100 * distinct < 80 * n, 100 * F.length(F.regexp_replace(t, "[^A-Z]+", "")) > 10 * F.length(t), t.rlike(r"[#$%&*|]")]


def flags(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, part, A, B, C, D, E, good, toxic: one row for each of docs' rows.

    part is lang (null: empty). E: the same text stands under a smaller doc_id; a null doc_id is no smaller than any, nor is any smaller than it. Texts are
    told apart by SHA-256. good and toxic are 1 if any row of labels with that doc_id says quality 1, or toxic 1; without such a row, and for a null doc_id, 0.
    """
    t = F.coalesce("text", F.lit(""))
    told = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), *(c.alias(n) for c, n in zip(text_flags(F.col("text")), FILTERS)), F.unhex(F.sha2(t, 256)).alias("digest"))
    # Written once, as both of its uses below would read every text again.
    rows = least_of(materialize(told, "audit-flags"), "digest", "doc_id", "first", F.col("doc_id"))
    said = labels.groupBy("doc_id").agg(*(F.max((F.col(c) == 1).cast("int")).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))))
    both = join_hot(rows, said, "doc_id", F.col("digest"), "left")
    return both.select("doc_id", "part", *FILTERS[:4], F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("E"), *(F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS[1:]))


def survivors(rows: DataFrame) -> DataFrame:
    """part, chosen (bit i: filter i is in the subset), n, good, toxic: what a subset of filters keeps, where it keeps any. The rows whose part is null are of
    all parts together. rows as flags() has them."""
    each = rows.groupBy("part", *FILTERS).agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    cube = each.cube("part", *FILTERS).agg(*(F.sum(c).alias(c) for c in COUNTS), *(F.grouping(f).alias(f"not_{f}") for f in FILTERS))
    passed = cube.filter(" and ".join(f"(not_{f} = 1 or not {f})" for f in FILTERS))
    chosen = sum(((1 - F.col(f"not_{f}").cast("int")) * (1 << i) for i, f in enumerate(FILTERS)), F.lit(0))
    return passed.select("part", chosen.alias("chosen"), *COUNTS)


def _pairs() -> list[tuple[int, int, str, int]]:
    """(subset, the same with one filter more, that filter, in how many orders this is a step)."""
    n = len(FILTERS)
    return [(s, s | 1 << i, f, factorial(s.bit_count()) * factorial(n - 1 - s.bit_count())) for s in range(1 << n) for i, f in enumerate(FILTERS) if not s >> i & 1]


def _steps() -> list[tuple[str, int, str, int]]:
    """(order, step from 1, its filter, the subset before it)."""
    orders = map("".join, permutations(FILTERS))
    return [(o, k + 1, o[k], sum(1 << FILTERS.index(f) for f in o[:k])) for o in orders for k in range(len(o))]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: 600 rows for each part of docs, zeros included.

    Null texts are empty, parts and labels as in flags(); repeated rows count each; other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    known = survivors(flags(docs, labels)).filter("part is not null")
    # A subset that keeps nothing has no row in the cube: every part gets all 32.
    parts = known.filter("chosen = 0").select("part", F.explode(F.sequence(F.lit(0), F.lit(ALL))).alias("chosen"))
    whole = materialize(parts.join(known, ["part", "chosen"], "left").select("part", "chosen", *(F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS)), "audit-subsets")
    pairs = spark.createDataFrame(_pairs(), "chosen int, after int, filter string, orders int")
    steps = spark.createDataFrame(_steps(), "filter_order string, step int, filter string, chosen int")
    one = whole.select("part", "chosen", *(F.col(c).alias(f"{c}_before") for c in COUNTS)).join(F.broadcast(pairs), "chosen")  # 80 rows
    two = whole.select("part", F.col("chosen").alias("after"), *(F.col(c).alias(f"{c}_after") for c in COUNTS))
    moved = one.join(two, ["part", "after"]).select("part", "filter", "chosen", F.col("n_after").alias("kept"), *((F.col(f"{c}_before") - F.col(f"{c}_after")).alias(c) for c in COUNTS), "orders")
    # A filter fails alone what it removes last of all, and fails at all what it removes first.
    bit = F.element_at(F.create_map(*(F.lit(x) for i, f in enumerate(FILTERS) for x in (f, 1 << i))), F.col("filter"))
    by_filter = moved.groupBy("part", "filter").agg(
        F.max(F.when(F.col("chosen") == 0, F.col("n"))).alias("fails"), F.max(F.when(F.col("chosen") + bit == ALL, F.col("n"))).alias("unique_fails"), F.sum(F.col("n") * F.col("orders")).alias("shapley")
    )
    out = moved.join(by_filter, ["part", "filter"]).join(F.broadcast(steps), ["chosen", "filter"])  # 600 rows
    return out.select("part", "filter_order", "step", "kept", F.col("n").alias("removed"), (F.col("fails") - F.col("n")).alias("redundant"), "unique_fails", F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley")
