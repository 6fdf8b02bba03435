"""Ordered rows of a paper (or any group): enforcement, runs, boundaries, gaps, neighbours, zones. All by windows; a group may be long."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import greedy


def in_order(group: list[str], order: list[str]):
    return Window.partitionBy(*group).orderBy(*order)


def enforce_order(rows: DataFrame, group: list[str], order: list[str], rank: Column, confidence: str, least: float = 0.9) -> DataFrame:
    """[W11] The section's rank never falls: a running maximum over sure rows (confidence >= least), 0 before the first. Unknown ranks (null) inherit.

    Adds enforced (rank) and changed (whether the row's own rank differs from it)."""
    w = in_order(group, order).rowsBetween(Window.unboundedPreceding, 0)
    r = rows.withColumn("enforced", F.coalesce(F.max(F.when(F.col(confidence) >= least, rank)).over(w), F.lit(0)))
    return r.withColumn("changed", F.coalesce(rank != F.col("enforced"), F.lit(True)))


def islands(rows: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """Adds island: a number for each run of equal values."""
    w = in_order(group, order)
    new = F.coalesce(~F.col(value).eqNullSafe(F.lag(value).over(w)), F.lit(True)) | (F.row_number().over(w) == 1)
    return rows.withColumn("__new", new.cast("int")).withColumn("island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def runs(rows: DataFrame, group: list[str], order: list[str], value: str, at: str, least: int = 1) -> DataFrame:
    """[W8] Runs of `least` rows or more: group, value, island, length, first and last `at`. Filter rows by confidence beforehand."""
    g = islands(rows, group, order, value).groupBy(*group, value, "island").agg(F.count("*").alias("length"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))
    return g.filter(F.col("length") >= least)


def section_order(rows: DataFrame, group: list[str], order: list[str], section: str, confidence: str, at: str, least: int = 5, sure: float = 0.6) -> DataFrame:
    """[W8] Where each section's first long run of sure rows starts, and its place among the sections."""
    good = rows.filter(F.col(confidence) >= sure)
    first = runs(good, group, order, section, at, least).groupBy(*group, section).agg(F.min("first_at").alias("starts"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy("starts", section)))


def boundaries(rows: DataFrame, group: list[str], order: list[str], section: str, at: str) -> DataFrame:
    """[W12] First and last `at` of each section's last run: a section that comes back overwrites its earlier run."""
    r = runs(rows, group, order, section, at)
    last = r.groupBy(*group, section).agg(F.max("island").alias("island"))
    return r.join(last, [*group, section, "island"]).select(*group, section, "first_at", "last_at", "length")


def missing_numbers(rows: DataFrame, group: list[str], number: str, upto: Column | None = None) -> DataFrame:
    """[J13, U2] Numbers from 1 to the group's largest (or `upto`) that have no row."""
    g = rows.groupBy(*group).agg((F.max(number) if upto is None else upto).alias("__n"))
    every = g.filter(F.col("__n") >= 1).select(*group, F.explode(F.sequence(F.lit(1), F.col("__n").cast("int"))).alias(number))
    return every.join(rows.select(*group, F.col(number).cast("int").alias(number)).distinct(), [*group, number], "left_anti")


def gaps(rows: DataFrame, group: list[str], number: str, sizes: tuple[int, int] = (2, 4)) -> DataFrame:
    """[J18, E9] Between neighbours that are sizes[0]..sizes[1] apart: each number in between, and its neighbours."""
    nxt = F.lead(number).over(in_order(group, [number]))
    g = rows.withColumn("__next", nxt).filter((F.col("__next") - F.col(number)).between(*sizes))
    return g.select(*group, F.col(number).alias("after"), F.col("__next").alias("before"), F.explode(F.sequence(F.col(number) + 1, F.col("__next") - 1)).alias("missing"))


def fill_between(rows: DataFrame, group: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """[W6, J17] A null takes its neighbours' value where both agree; filled values don't spread."""
    w = in_order(group, order)
    return rows.withColumn(out, F.when(F.col(value).isNull() & (F.lag(value).over(w) == F.lead(value).over(w)), F.lag(value).over(w)).otherwise(F.col(value)))


def neighbour_inference(rows: DataFrame, group: list[str], order: list[str], number: str, page: str, section: str, non_verbal: str, apply_at: float = 0.3) -> DataFrame:
    """[W7] A section for rows without one from the rows beside them: .15 for having both, .2 for one page, .075 for each consecutive number,
    .3 if both agree (.15 for one alone), .1 if the row is non-verbal; applied from `apply_at` on, confidence = that score."""
    w = in_order(group, order)
    p, n = F.lag(section).over(w), F.lead(section).over(w)
    pp, np_ = F.lag(page).over(w), F.lead(page).over(w)
    pn, nn = F.lag(number).over(w), F.lead(number).over(w)
    score = (
        F.when(p.isNotNull() & n.isNotNull(), 0.15).otherwise(0.0)
        + F.when((pp == F.col(page)) | (np_ == F.col(page)), 0.2).otherwise(0.0)
        + F.when(pn == F.col(number) - 1, 0.075).otherwise(0.0)
        + F.when(nn == F.col(number) + 1, 0.075).otherwise(0.0)
        + F.when(p == n, 0.3).when(p.isNotNull() | n.isNotNull(), 0.15).otherwise(0.0)
        + F.when(F.col(non_verbal), 0.1).otherwise(0.0)
    )
    r = rows.withColumn("score", F.round(score, 6)).withColumn("__guess", F.coalesce(p, n))
    on = F.col(section).isNull() & (F.col("score") >= apply_at)
    return r.withColumn("inferred", F.when(on, F.col("__guess")).otherwise(F.col(section))).withColumn("was_inferred", on & F.col("__guess").isNotNull()).drop("__guess")


#: Widths of bins are powers of two; zones shorter than the least one share its bins.
NARROWEST, WIDEST = -20, 62


def in_zone(rows: DataFrame, zones: DataFrame, number: str, how: str = "left") -> DataFrame:
    """[J5, P32] zones (zone, lo, hi): the zone that holds the number, both ends included; of several, the first by lo, hi and name.

    A range join by bins: a zone goes to the one or two bins that cover it, of the least width that is at least its length; a number to its bin of each width
    that zones have (one small list reaches the driver). Numbers and bounds may be fractions and zones of any length; what the bins join is checked
    exactly. Each different number is looked up once. Null and NaN numbers are in no zone; nor does anything lie in a zone whose bounds are null or crossed.
    """
    lo, hi = F.col("lo").cast("double"), F.col("hi").cast("double")
    level = F.ceil(F.log2(F.greatest(F.least(hi - lo, F.lit(2.0**WIDEST)), F.lit(2.0**NARROWEST)))).cast("int")
    far = 2.0**WIDEST  # what lies farther out, infinite bounds too, shares the outermost bins
    bin_of = lambda x, width: F.floor(F.greatest(F.lit(-far), F.least(F.lit(far), x)) / F.pow(F.lit(2.0), width))
    z = zones.filter(lo <= hi).withColumn("__level", level)
    z = z.withColumn("__bin", F.explode(F.sequence(bin_of(lo, F.col("__level")), bin_of(hi, F.col("__level")))))
    widths = sorted(r[0] for r in z.select("__level").distinct().collect())
    numbers = rows.select(F.col(number).alias("__number")).distinct().filter(F.col("__number").isNotNull() & ~F.isnan(F.col("__number").cast("double")))
    at = numbers.withColumn("__level", F.explode(F.array(*map(F.lit, widths)).cast("array<int>")))
    at = at.withColumn("__bin", bin_of(F.col("__number").cast("double"), F.col("__level")))
    held = at.join(z.select("__level", "__bin", "lo", "hi", "zone"), ["__level", "__bin"]).filter(F.col("__number").cast("double").between(lo, hi))
    first = held.groupBy("__number").agg(F.min(F.struct("lo", "hi", "zone"))["zone"].alias("zone"))
    return rows.join(first, F.col(number) == F.col("__number"), how).drop("__number")


def zone_enforced(rows: DataFrame, section: str, confidence: Column, mode: str = "flex", sure: float = 0.9) -> DataFrame:
    """[P33] strict: always the zone's section; flex: unless the row is sure; off: never. Unknown topics become inferred_<zone>."""
    force = {"strict": F.lit(True), "flex": confidence < sure, "off": F.lit(False)}[mode]
    move = F.col("zone").isNotNull() & (F.col(section) != F.col("zone")) & force
    return rows.withColumn("final_section", F.when(move, F.col("zone")).otherwise(F.col(section))).withColumn("zone_forced", F.coalesce(move, F.lit(False)))


def reassigned(rows: DataFrame, section: str, quality: Column, least: float = 0.4) -> DataFrame:
    """[P34] Rows outside their zone: good ones keep their section and are logged, poor ones move."""
    off = F.col("zone").isNotNull() & (F.col(section) != F.col("zone"))
    action = F.when(off & (quality >= least), "kept").when(off, "forced").otherwise("same")
    return rows.withColumn("action", action).withColumn("final_section", F.when(action == "forced", F.col("zone")).otherwise(F.col(section)))


def in_span(points: DataFrame, starts: DataFrame, group: list[str], at: str, start: str, label: str) -> DataFrame:
    """[J6] The last start at or before each point: an as-of join as one sorted pass over both, without pairs."""
    p = points.withColumn("__at", F.col(at)).withColumn("__kind", F.lit(1)).withColumn("__label", F.lit(None).cast(starts.schema[label].dataType))
    s = starts.select(*group, F.col(start).alias("__at"), F.lit(0).alias("__kind"), F.col(label).alias("__label"))
    both = p.unionByName(s, allowMissingColumns=True)
    w = Window.partitionBy(*group).orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(label, F.last("__label", ignorenulls=True).over(w)).filter("__kind = 1").drop("__at", "__kind", "__label")


def segments(rows: DataFrame, group: list[str], start: str, end: Column) -> DataFrame:
    """[W16] From each start to the next one; the last to `end`."""
    return rows.withColumn("segment_end", F.coalesce(F.lead(start).over(in_order(group, [start])), end))


def without_overlap(rows: DataFrame, group: list[str], start: str, end: str, crowd: int = greedy.CROWD) -> DataFrame:
    """[W17] Greedy, first come: a span stays if it starts at or after the end of the last one kept. Groups up to `crowd` spans are a fold, larger ones a walk by
    pointers over many tasks, with the same result. Spans with a null bound stay out."""
    rows = rows.select(*group, F.col(start).cast("long").alias(start), F.col(end).cast("long").alias(end)).filter(F.col(start).isNotNull() & F.col(end).isNotNull())
    few, many = greedy.crowded(rows, group, crowd)
    g = few.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(F.col(start).alias("s"), F.col(end).alias("e")))).alias("p"))
    zero = F.struct(F.lit(-(2**63)).cast("long").alias("last"), F.array().cast("array<struct<s:bigint,e:bigint>>").alias("kept"))
    step = lambda a, x: F.when(x["s"] >= a["last"], F.struct(x["e"].alias("last"), F.concat(a["kept"], F.array(x)).alias("kept"))).otherwise(a)
    folded = g.select(*group, F.explode(F.aggregate("p", zero, step, lambda a: a["kept"])).alias("z")).select(*group, F.col("z.s").alias(start), F.col("z.e").alias(end))
    return folded if many is None else folded.unionByName(greedy.spans_apart(many, group, start, end))


def renumber(rows: DataFrame, group: list[str], order: list[str], number: str, upto: Column | None = None) -> DataFrame:
    """[W18, E3] Rows without a number take the missing ones of 1..upto (by default the largest number), in order; those left over stay null."""
    free = missing_numbers(rows.filter(F.col(number).isNotNull()), group, number, upto)
    free = free.withColumn("__k", F.row_number().over(Window.partitionBy(*group).orderBy(number))).withColumnRenamed(number, "__free")
    bare = rows.filter(F.col(number).isNull()).withColumn("__k", F.row_number().over(in_order(group, order))).join(free, [*group, "__k"], "left").withColumn(number, F.col("__free")).drop("__k", "__free")
    return rows.filter(F.col(number).isNotNull()).unionByName(bare)


def first_of_number(rows: DataFrame, group: list[str], number: str, order: list[str]) -> DataFrame:
    """[W20] The first row of each number; rows by pattern, then place."""
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*group, number).orderBy(*order))).filter("__rn = 1").drop("__rn")


def round_robin(left: DataFrame, right: DataFrame, group: list[str], left_order: list[str], right_order: list[str]) -> DataFrame:
    """[J16] The i-th left row of a group goes with the (i mod n)-th of its n right rows."""
    r = right.withColumn("__i", F.row_number().over(in_order(group, right_order)) - 1)
    n = right.groupBy(*group).agg(F.count("*").alias("__n"))
    le = left.join(n, group).withColumn("__i", ((F.row_number().over(in_order(group, left_order)) - 1) % F.col("__n")).cast("int")).drop("__n")
    return le.join(r, [*group, "__i"]).drop("__i")


def majority(rows: DataFrame, group: list[str], value: str, at: str) -> DataFrame:
    """[A54, P37] The most frequent value of a group; of equals, the one seen first."""
    c = rows.groupBy(*group, value).agg(F.count("*").alias("cnt"), F.min(at).alias("__first"))
    return c.groupBy(*group).agg(F.max_by(value, F.struct("cnt", -F.col("__first"))).alias("majority"), F.max("cnt").alias("cnt"))
