"""Study plans and mock tests: calendars, quotas, samples by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.allocate import greedy_fill
from ..operators.rank import top_per_group


def cycle_plan(topics: DataFrame, section: str, topic: str, value: str, sections: list[str], days: int = 20, per_day: int = 2) -> DataFrame:
    """[X10] Days take the sections in turn; each day has the next topics of its section by value. Four phases of equal length."""
    spark = topics.sparkSession
    n = len(sections)
    place = F.row_number().over(Window.partitionBy(section).orderBy(F.desc(value), topic)) - 1
    days_df = spark.range(1, days + 1).select(F.col("id").cast("int").alias("day"), F.element_at(F.array(*(F.lit(s) for s in sections)), (((F.col("id") - 1) % n) + 1).cast("int")).alias(section), F.floor((F.col("id") - 1) / n).cast("int").alias("round"))
    t = topics.filter(F.col(section).isin(*sections)).withColumn("round", F.floor(place / per_day).cast("int"))
    plan = days_df.join(t.select(section, "round", topic, value), [section, "round"], "left")
    return plan.withColumn("phase", (F.floor((F.col("day") - 1) * 4 / days) + 1).cast("int")).drop("round")


def roi_plan(series: DataFrame, hours: float = 200.0, n: int = 15) -> DataFrame:
    """[X10, A38, A41, A69, O11, J2] series (pos, topic, section, year, cnt): half-life means adjusted by the trend, ROI from plain means, the n best, hours in
    proportion to rounded ROI among all topics that have any. Ties keep the order of pos."""
    from ..operators.allocate import roi
    from ..operators.features import but_last, last_n, mean_of, values_in_order

    weight = F.pow(F.lit(0.5), F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("year"))) - 1)
    g = series.withColumn("__w", weight).groupBy("pos", "topic", "section").agg((F.sum(F.col("cnt") * F.col("__w")) / F.sum("__w")).alias("x"), F.count("*").alias("n"), F.avg("cnt").alias("avg"), values_in_order().alias("v"))
    recent, rest = mean_of(last_n(F.col("v"), 2)), mean_of(but_last(F.col("v"), 2))
    g = g.withColumn("c", F.when((F.col("n") >= 3) & (rest > 0), (recent - rest) / rest).otherwise(0.0))
    g = g.withColumn("trend", F.when(F.col("c") > 0.15, "rising").when(F.col("c") < -0.15, "declining").otherwise("stable"))
    hard = F.when(F.col("section") == "numerical_ability", 0.6).when(F.col("section") == "general_awareness", 0.4).otherwise(0.5)
    g = g.select(
        "pos", "topic", "section", F.round(F.greatest(F.col("x") * (1 + F.col("c")), F.lit(0.0)), 1).alias("predicted"),
        F.round(F.least(0.6 + 0.05 * F.col("n") + 0.1 * (1 - F.least(F.abs("c"), F.lit(0.5))), F.lit(0.9)), 2).alias("confidence"), "trend",
        F.round(roi(F.col("avg"), F.col("trend"), 1 - hard, F.lit(1.0)), 2).alias("roi"), F.when(hard > 0.55, "high").when(hard < 0.45, "low").otherwise("medium").alias("difficulty"),
    )
    total = F.sum(F.greatest("roi", F.lit(0.0))).over(Window.partitionBy())
    g = g.withColumn("hours", F.round(F.when(F.col("roi") > 0, hours * F.col("roi") / total).otherwise(0.0), 1))
    return g.orderBy(F.desc("roi"), "pos").limit(n)


def mock_test(pool: DataFrame, wants: DataFrame, topic: str, section: str, quota: Column, key: str, seed: int = 42) -> DataFrame:
    """[X11, J11, O10, W14, W19] wants (section, topic, want, place): each topic takes what is wanted, available and left of the quota, in order of place;
    questions are drawn by a hash of key and seed and numbered through."""
    supply = pool.groupBy(section, topic).agg(F.count("*").alias("supply"))
    given = greedy_fill(wants.join(supply, [section, topic], "left").fillna(0, ["supply"]), "want", [section], ["place", topic], quota, F.col("supply"))
    draw = Window.partitionBy(section, topic).orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), key)
    picked = pool.withColumn("__d", F.row_number().over(draw)).join(given.select(section, topic, "place", "given"), [section, topic]).filter(F.col("__d") <= F.col("given"))
    return picked.withColumn("number", F.row_number().over(Window.partitionBy(section).orderBy("place", topic, "__d"))).drop("__d", "given")


def certain_topics(series: DataFrame, section: str, topic: str, count: str) -> DataFrame:
    """[A61] Of a section's ten most frequent topics, those with two questions, or the first five if there are none."""
    top = top_per_group(series, [section], [F.desc(count), topic], 1, 10)
    n = F.count_if(F.col(count) >= 2).over(Window.partitionBy(section))
    return top.withColumn("__n", n).filter((F.col(count) >= 2) | ((F.col("__n") == 0) & (F.col("rank") <= 5))).drop("__n")


def practice_set(rows: DataFrame, topic: str, year: str, key: str, valid: Column, least: int = 3, n: int = 5) -> DataFrame:
    """[A64] The n latest valid rows of topics with at least `least`."""
    good = rows.filter(valid).withColumn("__n", F.count("*").over(Window.partitionBy(topic))).filter(F.col("__n") >= least).drop("__n")
    return top_per_group(good, [topic], [F.desc(year), F.col(key)], 1, n)


def final_predictions(predictions: DataFrame, samples: DataFrame, section: str, topic: str) -> DataFrame:
    """[X12, A17] A row a section: total, mean confidence, its topics by rank, each with its sample questions."""
    s = samples.groupBy(section, topic).agg(F.array_sort(F.collect_list("sample")).alias("samples"))
    p = predictions.join(s, [section, topic], "left").withColumn("rank", F.row_number().over(Window.partitionBy(section).orderBy(F.desc("predicted"), topic)))
    return p.groupBy(section).agg(F.round(F.sum("predicted"), 6).alias("total"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.array_sort(F.collect_list(F.struct("rank", topic, "predicted", "samples"))).alias("topics"))
