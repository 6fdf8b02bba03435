"""Mixing sources to target weights along a time-varying curriculum. [native: DataFrame functions only]

Each source has a weight (how many words of the mix are its own) and a schedule (when in training it is used). The schedule, a piecewise-linear
weight over training time 0..1, is integrated to cumulative demand; a document's place in its source's word order is a demand, and inverting the
integral there gives its training position. Documents are then range-sorted by position.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import WORD, materialize

Knots = tuple[tuple[float, float], ...]


@dataclass(frozen=True)
class Curriculum:
    """weights and schedules go round the sources in code-point order, null last. Knots are (time, weight), times rising from 0 to 1, weights
    not negative and not all zero. repeats: the most times that a source may be used. buckets: hex digits of a document's order key that split
    a source into parts of which each is summed by one task; raise it where a source has over 10^9 documents."""

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    schedules: tuple[Knots, ...] = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.25), (0.5, 0.75), (1.0, 2.25)))
    repeats: int = 3
    buckets: int = 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _segments(knots: Knots) -> Column:
    """Literal array of (d0, d1, t0, w0, a): demand at both ends, start, weight there and half the slope, with total demand 1."""
    total = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))
    out, d = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        d1 = d + (t1 - t0) * (w0 + w1) / 2 / total
        out.append(F.struct(*(F.lit(float(v)).alias(k) for k, v in (("d0", d), ("d1", d1), ("t0", t0), ("w0", w0 / total), ("a", (w1 - w0) / 2 / (t1 - t0) / total)))))
        d = d1
    return F.array(*out)


def invert_demand(u: Column, knots: Knots) -> Column:
    """The time at which the share u (0..1) of a source's demand has been met."""
    at = F.element_at(F.filter(_segments(knots), lambda s: (s["d1"] >= u) | (s["d1"] >= F.lit(1.0 - 1e-12))), 1)
    x = u - at["d0"]
    root = at["w0"] + F.sqrt(F.greatest(at["w0"] * at["w0"] + 4 * at["a"] * x, F.lit(0.0)))
    return at["t0"] + F.when(root > 0, 2 * x / root).otherwise(0.0)


def source_key(source: Column) -> Column:
    """Never null; null sorts last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def running(rows: DataFrame, by: list[Column], sums: list[str]) -> DataFrame:
    """Adds rn (from 1) and, for each of sums, its total before the row, `<sum>_before`, in the order `by`, which leaves no ties.

    Rows are range-partitioned and numbered within their parts; only a row a part is summed in one place.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(rows.repartitionByRange(n, *by).withColumn("part", F.spark_partition_id()), "mix-order")
    totals = placed.groupBy("part").agg(F.count("*").alias("rn_part"), *(F.sum(c).alias(f"{c}_part") for c in sums))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", *(F.coalesce(F.sum(f"{c}_part").over(earlier), F.lit(0)).alias(f"{c}_part") for c in ("rn", *sums)))
    own = Window.partitionBy("part").orderBy(*by)
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    out = placed.join(totals, "part").withColumn("rn", F.col("rn_part") + F.row_number().over(own))
    for c in sums:
        out = out.withColumn(f"{c}_before", F.col(f"{c}_part") + F.coalesce(F.sum(c).over(before), F.lit(0)))
    return out.drop("part", *(f"{c}_part" for c in ("rn", *sums)))


def targets(sources: DataFrame, c: Curriculum) -> DataFrame:
    """(skey, source_size) -> adds cls (place in the cycle of weights), target: shares of the total by weight, none above repeats x its size.

    Sources in ascending size/weight are full until the rate at which the rest can be shared is below their ratio. The table has a row a source; three
    numbers of it reach the driver.
    """
    w = F.element_at(F.array(*(F.lit(float(x)) for x in c.weights)), (F.col("cls") + 1).cast("int"))
    s = running(sources.select("skey", "source_size"), [F.col("skey")], []).withColumn("cls", (F.col("rn") - 1) % len(c.weights)).drop("rn")
    s = s.withColumn("w", w).withColumn("full", F.col("source_size") * c.repeats)
    s = running(s, [F.col("full") / F.col("w"), F.col("skey")], ["full", "w"])
    size, weight = s.agg(F.sum("source_size"), F.sum("w")).first()
    rate = (F.lit(size) - F.col("full_before")) / (F.lit(weight) - F.col("w_before"))
    level = s.filter(rate <= F.col("full") / F.col("w")).agg(F.min_by(rate, "rn")).first()[0]
    full = F.col("full").cast("double")
    return s.select("skey", "source_size", F.col("cls").cast("int").alias("cls"), (full if level is None else F.least(full, F.lit(level) * F.col("w"))).alias("target"))


def mix(docs: DataFrame, sizes: DataFrame, c: Curriculum = Curriculum()) -> DataFrame:
    """Adds size, source_size, target, taken, copies, cls, before to docs.

    docs has doc_id, source, size (long) and any other columns; sizes holds the same rows' (source, doc_id, size) and is read for the sums alone.
    Words are taken in the order of md5(doc_id): all of a source floor(target / size) times, then the remainder from the start of that order, the
    last document in part. taken is in words; copies = ceil(taken / size); before is the number of words before the document in its source's order.
    Null sources are one source, the last; null doc_ids come first in order; repeated rows are taken one by one; documents without words have size and
    taken 0. Empty tables give no rows. Running sums go by (source, bucket of the order key), so that a hot source is spread over all tasks.
    """
    order_key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    keyed = lambda d: d.withColumn("skey", source_key(F.col("source"))).withColumn("okey", order_key).withColumn("bucket", F.substring("okey", 1, c.buckets))
    parts = keyed(sizes).groupBy("skey", "bucket").agg(F.sum("size").alias("n"))
    per_source = targets(parts.groupBy("skey").agg(F.sum("n").alias("source_size")), c)
    up_to = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("base", F.coalesce(F.sum("n").over(up_to), F.lit(0))).drop("n").join(per_source, "skey")
    within = Window.partitionBy("skey", "bucket").orderBy("okey", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = keyed(docs).join(parts, ["skey", "bucket"]).withColumn("before", F.col("base") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    total = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(total / F.col("source_size"))).otherwise(0).cast("long")
    rest = total - whole * F.col("source_size")
    taken = whole * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("before")))
    rows = rows.withColumn("taken", taken).withColumn("copies", F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0).cast("long"))
    return rows.drop("skey", "okey", "bucket", "base")


def words_of_use(use: Column) -> Column:
    """How many words of a row of mix its use-th use takes: all, but for the last one."""
    return F.least(F.col("size"), F.col("taken") - (use - 1) * F.col("size"))


def position(use: Column, c: Curriculum) -> Column:
    """The training time of a row's use-th use: where its source's schedule, integrated, has asked for the words of all uses before it and half of its own.

    A source's uses go round its documents, so the words before are those of (use - 1) whole rounds and those before the document in this one.
    """
    demand = (use - 1) * F.col("source_size") + F.col("before") + words_of_use(use) / 2
    share = F.least(F.lit(1.0), demand / F.greatest(F.col("target"), F.lit(1.0)))
    return F.coalesce(*(F.when(F.col("cls") == i, invert_demand(share, c.schedules[i % len(c.schedules)])) for i in range(len(c.weights))))


def uses(mixed: DataFrame, c: Curriculum = Curriculum()) -> DataFrame:
    """A row for each use of a row of mix: adds use (from 1), n_words that it takes, and its position; in no order. Rows that nothing is taken of give none."""
    each = mixed.filter("taken > 0").withColumn("use", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.withColumn("n_words", words_of_use(F.col("use"))).withColumn("position", position(F.col("use"), c)).drop("cls", "before")


def mix_digest(docs: DataFrame, c: Curriculum = Curriculum()) -> DataFrame:
    """The query's columns, copies, and the training positions of the first and the last use; range-sorted by the first (documents not taken come first)."""
    sized = materialize(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "mix-sizes")
    at = lambda use: F.when(F.col("taken") > 0, F.round(position(use, c), 9))
    out = mix(sized, sized, c).select("doc_id", "size", "source_size", "target", "taken", "copies", at(F.lit(1)).alias("position"), at(F.col("copies")).alias("last_position"))
    n = int(out.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.repartitionByRange(n, "position", "doc_id").sortWithinPartitions("position", "doc_id")


def mixed_documents(docs: DataFrame, c: Curriculum = Curriculum()) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each time that a document is used, a partial use cut after its share of words. In training order:
    range-sorted by the position of each use.

    docs' rows travel as one struct, so that no name of theirs clashes. Documents without words are never used; null sources are one source, the last; null and
    repeated doc_ids are rows like any other; an empty table gives no rows.
    """
    columns = docs.columns
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.struct(*columns).alias("row"))
    each = uses(mix(sized, materialize(sized.select("doc_id", "source", "size"), "mix-sizes"), c), c)
    text, part = F.col("row.text"), F.col("n_words") < F.col("size")
    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]*)"), 1)
    cut = F.rtrim(F.concat(F.regexp_extract(text, r"\A[\x20\x09-\x0D]*", 0), F.array_join(F.slice(words, 1, F.col("n_words").cast("int")), "")))
    made = {"text": F.when(part, cut).otherwise(text)} | ({"n_chars": F.when(part, F.length(cut)).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in columns else {})
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = each.repartitionByRange(n, "position", "doc_id", "use").sortWithinPartitions("position", "doc_id", "use")
    return ordered.select(*(made[k].alias(k) if k in made else F.col("row")[k].alias(k) for k in columns))
