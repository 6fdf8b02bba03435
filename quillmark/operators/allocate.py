"""Quotas, caps and budgets: values scaled to totals, whole numbers that respect limits, greedy fills as running sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import greedy


def roi(questions: Column, trend: Column, p: Column, time: Column) -> Column:
    """[A41, F28] Expected marks for the time: q x trend x (3 p - (1 - p)) / max(time, .1)."""
    factor = F.when(trend == "rising", 1.2).when(trend == "declining", 0.8).otherwise(1.0)
    return questions * factor * (3 * p - (1 - p)) / F.greatest(time, F.lit(0.1))


def to_quota(rows: DataFrame, value: str, section: str, quota: str, out: str = "scaled", rounds: bool = False) -> DataFrame:
    """[A42, W3] value x quota / sum over the section; rounds: to one decimal before and after, as the sum of rounded values is what counts then."""
    v = F.round(value, 1) if rounds else F.col(value)
    x = F.try_divide(v * F.col(quota), F.sum(v).over(Window.partitionBy(section)))
    return rows.withColumn(out, F.round(x, 1) if rounds else x)


def balance(rows: DataFrame, value: str, section: str, quota: str, cap: Column, out: str = "balanced", slack: float = 2.0) -> DataFrame:
    """[A43, P22] Sections that miss their quota by more than `slack` are scaled to it, then capped. No lower bound after scaling."""
    total = F.sum(value).over(Window.partitionBy(section))
    off = F.abs(total - F.col(quota)) > slack
    return rows.withColumn(out, F.when(off & (total > 0), F.least(F.col(value) * F.col(quota) / total, cap)).otherwise(F.col(value).cast("double")))


def historic_cap(rows: DataFrame, value: str, limits: DataFrame, key: str, p90: Column, absolute: Column) -> DataFrame:
    """[P23, J20] At most 1.2 x and 2 above the most ever seen; unseen keys at most p90; never above an absolute cap."""
    joined = rows.join(limits.select(F.col(key), F.col("most").alias("__most")), key, "left")
    own = F.when(F.col("__most").isNotNull(), F.least(F.col("__most") * 1.2, F.col("__most") + 2)).otherwise(p90)
    return joined.withColumn("capped", F.least(F.col(value).cast("double"), own, absolute)).drop("__most")


def proportional(rows: DataFrame, value: str, over: list[str], n: int | Column, out: str = "n") -> DataFrame:
    """[A44] max(1, half-even n x share): may miss the total."""
    total = F.sum(value).over(Window.partitionBy(*over))
    return rows.withColumn(out, F.greatest(F.lit(1), F.bround(F.try_divide(F.col(value) * n, total)).cast("int")))


def largest_remainder(rows: DataFrame, value: str, over: list[str], n: int | Column, order: list[str], out: str = "n") -> DataFrame:
    """[A44] Whole numbers that meet the total: floors, then one more for the largest remainders."""
    w = Window.partitionBy(*over)
    x = F.col("__x")
    r = rows.withColumn("__x", F.coalesce(F.try_divide(F.col(value) * n, F.sum(value).over(w)), F.lit(0.0))).withColumn("__f", F.floor(F.round("__x", 9)))
    r = r.withColumn("__left", F.lit(n) - F.sum("__f").over(w)) if isinstance(n, int) else r.withColumn("__left", n - F.sum("__f").over(w))
    rank = F.row_number().over(w.orderBy(F.desc(F.round(x - F.col("__f"), 9)), *order))
    return r.withColumn(out, (F.col("__f") + (rank <= F.col("__left")).cast("int")).cast("long")).drop("__x", "__f", "__left")


def bias_metrics(obs: DataFrame, difficulty: str, expected: dict[str, float], recall: float = 0.7) -> DataFrame:
    """[A45] Observed ratios, their distance from the expected ones, a score (mean distance), questions missing at this recall."""
    ratios = [F.avg((F.col(difficulty) == k).cast("double")).alias(f"r_{k}") for k in expected]
    g = obs.agg(F.count("*").alias("n"), *ratios)
    off = [(F.col(f"r_{k}") - e).alias(f"d_{k}") for k, e in expected.items()]
    score = sum((F.abs(F.col(f"r_{k}") - e) for k, e in expected.items()), F.lit(0.0)) / len(expected)
    return g.select("n", *(f"r_{k}" for k in expected), *off, score.alias("bias_score"), (F.col("n") * (1 - recall) / recall).cast("long").alias("n_missing"))


def recall_corrected(rows: DataFrame, value: str, topic: str, hard: DataFrame, section: str, expected: Column, up: float = 1.15, down: float = 0.85, out: str = "corrected") -> DataFrame:
    """[A46] Hard topics are under-reported (x up), the rest over (x down); then scaled to the section's expected total."""
    j = rows.join(hard.select(F.col(topic), F.lit(True).alias("__hard")).distinct(), topic, "left")
    j = j.withColumn("__v", F.col(value) * F.when(F.col("__hard"), up).otherwise(down))
    return j.withColumn(out, F.try_divide(F.col("__v") * expected, F.sum("__v").over(Window.partitionBy(section)))).drop("__hard", "__v")


def impute_missing(observed: DataFrame, syllabus: DataFrame, topic: str, value: str) -> DataFrame:
    """[A71, J13, U2] Topics of the syllabus that were not seen get half the mean of those that were."""
    mean = observed.agg((F.avg(value) * 0.5).alias(value))
    absent = syllabus.select(topic).distinct().join(observed.select(topic), topic, "left_anti").crossJoin(F.broadcast(mean))
    return observed.select(topic, F.col(value).cast("double").alias(value), F.lit(False).alias("imputed")).unionByName(absent.select(topic, value, F.lit(True).alias("imputed")))


def take_until(rows: DataFrame, value: str, over: list[str], order: list, limit: float) -> DataFrame:
    """[W13] Rows while the sum of those before is under the limit."""
    before = Window.partitionBy(*over).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("before", F.coalesce(F.sum(value).over(before), F.lit(0))).filter(F.col("before") < limit)


def greedy_fill(rows: DataFrame, want: str, over: list[str], order: list, quota: Column, supply: Column | None = None, out: str = "given") -> DataFrame:
    """[W14] Each takes what it wants of what is left; with a supply, no more than that. A running sum stands for the loop."""
    w = F.col(want) if supply is None else F.least(F.col(want), supply)
    r = rows.withColumn("__w", w)
    before = F.coalesce(F.sum("__w").over(Window.partitionBy(*over).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return r.withColumn(out, F.greatest(F.lit(0), F.least(F.col("__w"), quota - before))).drop("__w")


def pack_weeks(rows: DataFrame, hours: str, over: list[str], order: list[str], per_week: float, crowd: int = greedy.CROWD) -> DataFrame:
    """[W15, X13] Week numbers: hours add up, in decimal to nine places, until a week is full, then start anew. Groups up to `crowd` rows are a fold over the ordered
    plan, larger ones a walk by pointers over many tasks, with the same result. Null and negative hours count as none."""
    few, many = greedy.crowded(rows.select(*over, *order, F.col(hours).cast("double").alias(hours)), over, crowd)
    number, full_at = "decimal(28,9)", F.lit(per_week).cast("decimal(28,9)")
    g = few.groupBy(*over).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(hours).alias("__h")))).alias("p"))
    zero = F.struct(F.lit(1).alias("week"), F.lit(0).cast(number).alias("sum"), F.array().cast("array<int>").alias("weeks"))

    def step(a, x):
        now = (a["sum"] + F.greatest(F.coalesce(x["__h"], F.lit(0.0)), F.lit(0.0)).cast(number)).cast(number)
        return F.struct((a["week"] + (now >= full_at).cast("int")).alias("week"), F.when(now >= full_at, F.lit(0).cast(number)).otherwise(now).alias("sum"), F.concat(a["weeks"], F.array(a["week"])).alias("weeks"))

    g = g.withColumn("w", F.aggregate("p", zero, step, lambda a: a["weeks"]))
    folded = g.select(*over, F.explode(F.arrays_zip("p", "w")).alias("z")).select(*over, *(F.col(f"z.p.{c}").alias(c) for c in order), F.col("z.p.__h").alias(hours), F.col("z.w").alias("week"))
    return folded if many is None else folded.unionByName(greedy.filled_weeks(many, hours, over, order, per_week))


def hours_by_share(rows: DataFrame, value: str, over: list[str], total: float, out: str = "hours") -> DataFrame:
    """[A69] value / sum x total, one decimal."""
    return rows.withColumn(out, F.round(F.try_divide(F.col(value) * total, F.sum(value).over(Window.partitionBy(*over))), 1))


def study_totals(plan: DataFrame, section: str, hours: str, per_day: float = 6.0) -> DataFrame:
    """[A70] Hours, percent and days by section."""
    g = plan.groupBy(section).agg(F.sum(hours).alias("hours"), F.count("*").alias("n_topics"))
    return g.withColumn("pct", F.round(F.col("hours") * 100 / F.sum("hours").over(Window.partitionBy()), 1)).withColumn("days", F.ceil(F.col("hours") / per_day).cast("long"))


def priority_band(count: Column) -> Column:
    """[P26]"""
    return F.when(count >= 4, "HIGH").when(count >= 2, "MEDIUM").otherwise("LOW")


def study_hours(count: Column) -> Column:
    """[P26]"""
    return F.when(count >= 4, 8).when(count >= 2, 5).otherwise(2)


def advice(trend: Column, predicted: Column, since_last: Column) -> Column:
    """[P27]"""
    return (
        F.when((trend == "rising") & (predicted >= 3), "Focus: many questions and rising")
        .when(trend == "rising", "Prepare: rising")
        .when(predicted >= 3, "Core topic: keep in practice")
        .when(since_last >= 2, "Revise briefly: dormant")
        .otherwise("Cover the basics")
    )


def generation_level(confidence: Column) -> Column:
    """[P28]"""
    return F.when(confidence > 0.7, "medium").when(confidence > 0.5, "hard").otherwise("easy")
