"""Counts, shares, breakdowns and bank statistics over observations (section, topic, year, difficulty, ...). Column names are parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts(obs: DataFrame, *by: str, name: str = "cnt") -> DataFrame:
    """[A1, A2, A11, A72, K13] Rows of each group."""
    return obs.groupBy(*by).agg(F.count("*").alias(name))


def topic_years(obs: DataFrame, topic: str, year: str, section: str, order: str) -> DataFrame:
    """[A3] topic, year, cnt, section: the section of the topic's last row by `order`."""
    last = obs.groupBy(topic).agg(F.max_by(section, order).alias("section"))
    return counts(obs, topic, year).join(last, topic)


def dense(series: DataFrame, keys: list[str], year: str = "year", value: str = "cnt") -> DataFrame:
    """[J14, U4] Every key in every year that occurs, 0 where it has no row. Years are few: their list is attached as an array, not joined."""
    years = series.agg(F.array_sort(F.collect_set(year)).alias("__years"))
    grid = series.select(*keys).distinct().crossJoin(F.broadcast(years)).withColumn(year, F.explode("__years")).drop("__years")
    return grid.join(series.select(*keys, year, value), [*keys, year], "left").fillna(0, [value])


def share(rows: DataFrame, value: str, over: list[str], out: str = "share", scale: float = 100.0) -> DataFrame:
    """[A12, A27, A42, W3] A value's part of its group's total; null where the total is 0."""
    total = F.sum(value).over(Window.partitionBy(*over))
    return rows.withColumn(out, F.try_divide(F.col(value) * scale, total))


def level_history(obs: DataFrame, by: list[str], level: Column) -> DataFrame:
    """[A5] Per topic and year: rows and the mean level, 1 easy, 2 medium, 3 anything else, null too."""
    return obs.groupBy(*by).agg(F.count("*").alias("cnt"), F.avg(F.when(level == "easy", 1).when(level == "medium", 2).otherwise(3)).alias("avg_level"))


def topic_list(obs: DataFrame, topic: str, section: str, confidence: str) -> DataFrame:
    """[A6]"""
    return obs.groupBy(topic, section).agg(F.count("*").alias("cnt"), F.avg(confidence).alias("avg_confidence")).orderBy(F.desc("cnt"), topic, section)


def bank_statistics(obs: DataFrame, topic: str, year: str, difficulty: str, section: str) -> DataFrame:
    """[A7] One pass of grouping sets: the whole, by difficulty, by section. `part` says which."""
    sets = obs.groupingSets([[], [difficulty], [section]], difficulty, section).agg(F.grouping_id().alias("g"), F.count("*").alias("cnt"), F.countDistinct(topic).alias("n_topics"), F.countDistinct(year).alias("n_years"))
    part = F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "difficulty").otherwise("section")
    return sets.select(part.alias("part"), F.when(F.col("g") == 1, F.col(difficulty)).when(F.col("g") == 2, F.col(section)).alias("value"), "cnt", "n_topics", "n_years")


def filled_counts(obs: DataFrame, column: str, levels: list[str]) -> DataFrame:
    """[A8, A13] A row for every level, 0 where none."""
    every = obs.sparkSession.createDataFrame([(x,) for x in levels], f"{column} string")
    return every.join(counts(obs, column), column, "left").fillna(0, ["cnt"])


def simple_format(obs: DataFrame, by: list[str], difficulty: str, levels: list[str], order: str, sample: Column, n: int = 3) -> DataFrame:
    """[A9, A10, K2] Counts per group and difficulty, and the first n samples by `order`. The window keeps n rows a group before any list is made."""
    pivot = obs.groupBy(*by).agg(F.count("*").alias("cnt"), *(F.count_if(F.col(difficulty) == x).alias(f"n_{x.lower()}") for x in levels))
    first = obs.withColumn("__rn", F.row_number().over(Window.partitionBy(*by).orderBy(order))).filter(F.col("__rn") <= n)
    samples = first.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__rn", sample.alias("s")))), lambda x: x["s"]), "|").alias("samples"))
    return pivot.join(samples, by)


def percentages(obs: DataFrame, column: str, whole: bool = False) -> DataFrame:
    """[A12] Percent of rows by value, one decimal or cut to whole numbers."""
    c = counts(obs, column).withColumn("pct", F.col("cnt") * 100.0 / F.sum("cnt").over(Window.partitionBy()))
    return c.withColumn("pct", F.col("pct").cast("long") if whole else F.round("pct", 1))


def level_statistics(obs: DataFrame, difficulty: str, confidence: str, levels: list[str]) -> DataFrame:
    """[A13]"""
    g = obs.groupBy(difficulty).agg(F.count("*").alias("cnt"), F.avg(confidence).alias("avg_confidence"))
    every = obs.sparkSession.createDataFrame([(x,) for x in levels], f"{difficulty} string")
    return share(every.join(g, difficulty, "left").fillna(0, ["cnt"]).fillna(0.0, ["avg_confidence"]), "cnt", [], "pct")


def distinct_questions(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """[A14, J12, K3] The first row of each key by `order`, with how many rows the key had. Aggregated before the shuffle: no window over copies."""
    keyed = rows.withColumn("__key", key)
    first = keyed.groupBy("__key").agg(F.min(order).alias(order), F.count("*").alias("n_copies"))
    return keyed.join(first, ["__key", order], "inner").drop("__key")


def new_questions(bank: DataFrame, incoming: DataFrame, key) -> DataFrame:
    """[J11, J12, K3, U2] Incoming rows whose key the bank lacks."""
    return incoming.withColumn("__key", key(incoming)).join(bank.select(key(bank).alias("__key")).distinct(), "__key", "left_anti").drop("__key")


def section_statistics(series: DataFrame, section: str, topic: str, trend: str) -> DataFrame:
    """[A16, A17] series (section, topic, total, avg, trend): topics, mean of means, the topic with most (first by name), rising and declining ones."""
    names = lambda label: F.array_join(F.array_sort(F.collect_set(F.when(F.col(trend) == label, F.col(topic)))), ",")
    return series.groupBy(section).agg(
        F.count("*").alias("n_topics"), F.avg("avg").alias("mean_avg"), F.sum("total").alias("total"),
        F.min_by(topic, F.struct(-F.col("total"), F.col(topic))).alias("top_topic"), names("rising").alias("rising"), names("declining").alias("declining"),
    )


def estimated_shifts(obs: DataFrame, year: str, per_shift: int = 100) -> DataFrame:
    """[A26] Questions of a year, shifts max(1, half-even n / 100), questions a shift."""
    c = counts(obs, year).withColumn("shifts", F.greatest(F.lit(1), F.bround(F.col("cnt") / per_shift).cast("int")))
    return c.withColumn("per_shift", F.round(F.col("cnt") / F.col("shifts"), 2))


def mean_share_top(shares: DataFrame, topic: str, value: str, n: int = 10) -> DataFrame:
    """[A28]"""
    return shares.groupBy(topic).agg(F.avg(value).alias("mean_share")).orderBy(F.desc("mean_share"), topic).limit(n)


def year_range(obs: DataFrame, year: str) -> DataFrame:
    """[A72]"""
    return obs.agg(F.min(year).alias("first_year"), F.max(year).alias("last_year"), F.countDistinct(year).alias("n_years"))
