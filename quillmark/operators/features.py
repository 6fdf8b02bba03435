"""Series features per topic: sparse and dense variants, streaks, moving and exponential means. series is (keys, year, cnt), one row a key and year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered(keys: list[str], year: str = "year", desc: bool = False):
    return Window.partitionBy(*keys).orderBy(F.desc(year) if desc else F.col(year))


def ema(values: Column, alpha: float = 0.3) -> Column:
    """[W5, A25] Exponential mean of an array in order: e0 = v0, e = alpha v + (1 - alpha) e."""
    v = F.transform(values, lambda x: x.cast("double"))
    return F.aggregate(F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))), F.get(v, 0), lambda e, x: alpha * x + (1 - alpha) * e)


def values_in_order(year: str = "year", value: str = "cnt") -> Column:
    """A series is tens of years: its array is small."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(year).alias("y"), F.col(value).alias("v")))), lambda p: p["v"])


def mean_of(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a))


def last_n(a: Column, n: int) -> Column:
    return F.slice(a, F.greatest(F.size(a) - n + 1, F.lit(1)), n)


def but_last(a: Column, n: int) -> Column:
    return F.slice(a, 1, F.greatest(F.size(a) - n, F.lit(0)))


def trailing_streak(a: Column) -> Column:
    """[W9] Values at the end that are not zero."""
    zero = F.struct(F.lit(0).alias("n"))
    return F.aggregate(a, zero, lambda s, x: F.struct(F.when(x > 0, s["n"] + 1).otherwise(0).alias("n")), lambda s: s["n"])


def series_stats(series: DataFrame, keys: list[str], year: str = "year", value: str = "cnt") -> DataFrame:
    """[A4, P25] total, avg, last_year, ratio trend (mean of the last two against the rest), label at 15 %, streak. Under three values the trend is 0."""
    g = series.groupBy(*keys).agg(values_in_order(year, value).alias("v"), F.max(year).alias("last_year"))
    recent, rest = mean_of(last_n(F.col("v"), 2)), mean_of(but_last(F.col("v"), 2))
    ratio = F.when((F.size("v") >= 3) & (rest > 0), (recent - rest) / rest).otherwise(0.0)
    return g.select(*keys, F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), mean_of(F.col("v")).alias("avg"), "last_year", ratio.alias("trend_ratio"), F.when(ratio > 0.15, "rising").when(ratio < -0.15, "declining").otherwise("stable").alias("trend"), trailing_streak(F.col("v")).alias("streak"))


def padded(a: Column, n: int) -> list[Column]:
    """The last n values from the left, zeros at the end."""
    return [F.coalesce(F.get(last_n(a, n), i), F.lit(0)) for i in range(n)]


def features13(series: DataFrame, keys: list[str], target: int, lookback: int = 10, year: str = "year", value: str = "cnt", slope: bool = False) -> DataFrame:
    """[A20, A21, A24, A68] Thirteen features over the years when a topic occurs. slope: the OLS slope over places takes the ratio's column."""
    s = series.filter(F.col(year) >= target - lookback)
    s = s.withColumn("__x", F.row_number().over(ordered(keys, year)) - 1)
    g = s.groupBy(*keys).agg(values_in_order(year, value).alias("v"), F.max(year).alias("__last"), F.stddev_pop(value).alias("std"), F.max(value).alias("hi"), F.min(value).alias("lo"), F.regr_slope(F.col(value), F.col("__x")).alias("__slope"))
    recent, rest = mean_of(last_n(F.col("v"), 2)), mean_of(but_last(F.col("v"), 2))
    trend = F.when(F.size("v") >= 3, F.col("__slope")).otherwise(0.0) if slope else F.when((F.size("v") >= 3) & (rest > 0), (recent - rest) / rest).otherwise(0.0)
    return g.select(*keys, mean_of(F.col("v")).alias("avg"), recent.alias("recent"), trend.alias("trend"), (F.lit(target) - F.col("__last")).alias("since_last"), trailing_streak(F.col("v")).alias("streak"), "std", "hi", "lo", *(c.alias(f"last{i + 1}") for i, c in enumerate(padded(F.col("v"), 5))))


def calendar_run(series: DataFrame, keys: list[str], year: str = "year") -> DataFrame:
    """[W10] Length of the run of consecutive calendar years that ends a series: islands of year - row_number."""
    s = series.select(*keys, year).distinct().withColumn("__island", F.col(year) - F.row_number().over(ordered(keys, year)))
    return s.groupBy(*keys, "__island").agg(F.count("*").alias("run"), F.max(year).alias("__end")).groupBy(*keys).agg(F.max_by("run", "__end").alias("run"))


def features15(shares: DataFrame, keys: list[str], target: int, year: str = "year", value: str = "share") -> DataFrame:
    """[A22] Fifteen features of shares: slopes on calendar years, of all and of the last three, and their difference as acceleration."""
    s = shares.withColumn("__back", F.row_number().over(ordered(keys, year, desc=True)))
    late = F.col("__back") <= 3
    g = s.groupBy(*keys).agg(
        values_in_order(year, value).alias("v"), F.max(year).alias("__last"), F.stddev_pop(value).alias("std"), F.max(value).alias("hi"), F.min(value).alias("lo"),
        F.regr_slope(F.col(value), F.col(year)).alias("__slope"), F.regr_slope(F.when(late, F.col(value)), F.when(late, F.col(year))).alias("__late"), F.count("*").alias("n_years"),
    ).join(calendar_run(shares, keys, year), keys)
    overall = F.when(F.col("n_years") >= 2, F.coalesce("__slope", F.lit(0.0))).otherwise(0.0)
    recent = F.when(F.col("n_years") >= 3, F.coalesce("__late", F.lit(0.0))).otherwise(overall)
    return g.select(*keys, mean_of(F.col("v")).alias("avg"), mean_of(last_n(F.col("v"), 2)).alias("recent"), overall.alias("slope"), (F.lit(target) - F.col("__last")).alias("since_last"), "run", "std", "hi", "lo", recent.alias("late_slope"), (recent - overall).alias("acceleration"), "n_years", *(c.alias(f"last{i + 1}") for i, c in enumerate(padded(F.col("v"), 4))))


def features8(dense: DataFrame, keys: list[str], year: str = "year", value: str = "cnt") -> DataFrame:
    """[A23] Eight features over every year, zeros too. growth: last against first, of first or 1."""
    s = dense.withColumn("__x", F.row_number().over(ordered(keys, year)) - 1)
    g = s.groupBy(*keys).agg(F.avg(value).alias("avg"), F.regr_slope(F.col(value), F.col("__x")).alias("slope"), F.stddev_pop(value).alias("std"), F.max(value).alias("hi"), F.min(value).alias("lo"), F.count_if(F.col(value) > 0).alias("n_present"), values_in_order(year, value).alias("v"))
    first, last = F.get("v", 0), F.element_at("v", -1)
    return g.select(*keys, "avg", mean_of(last_n(F.col("v"), 2)).alias("recent"), F.coalesce("slope", F.lit(0.0)).alias("slope"), "std", "hi", "lo", "n_present", ((last - first) / F.greatest(first, F.lit(1))).alias("growth"))


def temporal_features(dense: DataFrame, keys: list[str], year: str = "year", value: str = "cnt") -> DataFrame:
    """[A25] slope, mean of the last three, exponential mean, alternation (odd places against even ones), last value, n."""
    s = dense.withColumn("__x", F.row_number().over(ordered(keys, year)) - 1)
    even, odd = F.col("__x") % 2 == 0, F.col("__x") % 2 == 1
    g = s.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope(F.col(value), F.col("__x")).alias("slope"), values_in_order(year, value).alias("v"), F.avg(F.when(even, F.col(value))).alias("e"), F.avg(F.when(odd, F.col(value))).alias("o"))
    enough = F.col("n") >= 3
    return g.select(*keys, F.when(enough, F.col("slope")).otherwise(0.0).alias("slope"), mean_of(last_n(F.col("v"), 3)).alias("ma3"), ema(F.col("v")).alias("ema"), F.when(enough, F.abs(F.col("e") - F.col("o"))).otherwise(0.0).alias("alternation"), F.element_at("v", -1).alias("last"), "n")


def moving_mean(series: DataFrame, keys: list[str], k: int = 3, year: str = "year", value: str = "cnt") -> DataFrame:
    """[W4]"""
    return series.withColumn(f"ma{k}", F.avg(value).over(ordered(keys, year).rowsBetween(-k + 1, 0)))
