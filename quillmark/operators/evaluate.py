"""Quality of data and of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def accuracy(truth: DataFrame, predicted: DataFrame, key: str, label: str) -> DataFrame:
    """[J1, A53] Per true label: rows of the truth, matched, right; the denominator is all of the truth."""
    j = truth.select(key, F.col(label).alias("truth")).join(predicted.select(key, F.col(label).alias("said")), key, "left")
    g = j.groupBy("truth").agg(F.count("*").alias("n"), F.count("said").alias("matched"), F.count_if(F.col("truth") == F.col("said")).alias("right"))
    return g.withColumn("accuracy", F.col("right") / F.col("n"))


def confusions(truth: DataFrame, predicted: DataFrame, key: str, label: str, n: int = 10) -> DataFrame:
    """[A53] The most frequent wrong pairs."""
    j = truth.select(key, F.col(label).alias("truth")).join(predicted.select(key, F.col(label).alias("said")), key).filter("truth != said")
    return j.groupBy("truth", "said").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "truth", "said").limit(n)


def regression_metrics(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    """[A47] MAE, RMSE, R2 (null if the actual values don't vary)."""
    d = F.col(actual) - F.col(predicted)
    g = rows.agg(F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), F.sum(d * d).alias("__s"), (F.var_pop(actual) * F.count(actual)).alias("__t"))
    return g.select("mae", "rmse", (1 - F.try_divide(F.col("__s"), F.col("__t"))).alias("r2"))


def prediction_statistics(rows: DataFrame, value: str) -> DataFrame:
    """[A48]"""
    return rows.agg(F.avg(value).alias("mean"), F.median(value).alias("median"), F.stddev_pop(value).alias("std"), F.min(value).alias("lo"), F.max(value).alias("hi"))


def quota_accuracy(rows: DataFrame, section: str, value: str, quota: str) -> DataFrame:
    """[A48] 100 (1 - |actual - quota| / quota)."""
    return rows.groupBy(section).agg(F.sum(value).alias("actual"), F.max(quota).alias("quota")).withColumn("accuracy", 100 * (1 - F.abs(F.col("actual") - F.col("quota")) / F.col("quota")))


def coverage(series: DataFrame, topic: str, year: str) -> DataFrame:
    """[A48] How many topics occur in how many years."""
    return series.groupBy(topic).agg(F.countDistinct(year).alias("n_years")).groupBy("n_years").agg(F.count("*").alias("n_topics"))


def limits(series: DataFrame, group: list[str], value: str) -> DataFrame:
    """[A49] Exact p90 and p95 (interpolated), mean, deviation, largest."""
    return series.groupBy(*group).agg(F.percentile(value, F.lit(0.9)).alias("p90"), F.percentile(value, F.lit(0.95)).alias("p95"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.max(value).alias("most"))


def null_profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """[A50] A row a column: nulls or blanks, different values. One pass over the rows."""
    one = rows.agg(*(f for c in columns for f in (F.count_if(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")).alias(f"{c}__n"), F.countDistinct(c).alias(f"{c}__d"))), F.count("*").alias("n_rows"))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"{c}__n").alias("n_missing"), F.col(f"{c}__d").alias("n_distinct"), "n_rows") for c in columns))).alias("z")).select("z.*")


def anomalies(series: DataFrame, group: list[str], value: str, times: float = 3.0) -> DataFrame:
    """[A50, P39] Values over `times` their group's mean."""
    m = F.avg(value).over(Window.partitionBy(*group))
    return series.withColumn("group_mean", m).filter(F.col(value) > times * F.col("group_mean"))


def over(rows: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """[P39] Counts of values over each bound."""
    return rows.agg(*(F.count_if(F.col(value) > b).alias(f"over_{b:g}".replace(".", "_")) for b in bounds))


def json_keys(rows: DataFrame, json: str) -> DataFrame:
    """[A51] How often each top-level key occurs."""
    return rows.select(F.explode(F.json_object_keys(json)).alias("key")).groupBy("key").agg(F.count("*").alias("cnt"))


def confidence_buckets(rows: DataFrame, confidence: str, group: list[str] | None = None) -> DataFrame:
    """[A52] high over .8, medium .6 to .8, low under."""
    c = F.col(confidence)
    return rows.groupBy(*(group or [])).agg(F.count_if(c > 0.8).alias("high"), F.count_if((c >= 0.6) & (c <= 0.8)).alias("medium"), F.count_if(c < 0.6).alias("low"), F.avg(c).alias("mean_confidence"))


def calibration(rows: DataFrame, level: str, right: Column) -> DataFrame:
    """[A67] 1 - half the error rate of each level."""
    return rows.groupBy(level).agg(F.count("*").alias("n"), (1 - 0.5 * (1 - F.avg(right.cast("double")))).alias("factor"))


def section_difficulty(rows: DataFrame, section: str, difficulty: str, n: int | Column) -> DataFrame:
    """[A18, P29] (hard + half the medium) / n, a label, good attempts int(n x ratio)."""
    g = rows.groupBy(section).agg(F.count("*").alias("cnt"), ((F.count_if(F.col(difficulty) == "hard") + 0.5 * F.count_if(F.col(difficulty) == "medium")) / F.count("*")).alias("score"))
    g = g.withColumn("label", F.when(F.col("score") > 0.6, "difficult").when(F.col("score") > 0.4, "moderate").otherwise("easy"))
    ratio = F.when(F.col("label") == "difficult", 0.55).when(F.col("label") == "moderate", 0.70).otherwise(0.85)
    return g.withColumn("good_attempts", F.floor(F.round(F.lit(n) * ratio if isinstance(n, int) else n * ratio, 6)).cast("long"))


def paper_difficulty(sections: DataFrame) -> DataFrame:
    """[A19] The paper's mean over its sections, and its band."""
    g = sections.agg(F.avg("score").alias("score"), F.sum("good_attempts").alias("good_attempts"), F.sum("cnt").alias("cnt"))
    rate = F.col("good_attempts") / F.col("cnt")
    return g.withColumn("label", F.when(rate >= 0.75, "easy").when(rate >= 0.60, "moderate").otherwise("difficult"))


def mean_importance(frames: list[DataFrame], feature: str = "feature", value: str = "importance", fill: bool = True) -> DataFrame:
    """[A66, J15] A full outer join of models' importances and their mean; missing ones are 0, or left out of the mean."""
    out = None
    for i, f in enumerate(frames):
        f = f.select(feature, F.col(value).alias(f"m{i}"))
        out = f if out is None else out.join(f, feature, "full")
    cols = [F.col(f"m{i}") for i in range(len(frames))]
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0))
    n = F.lit(len(cols)) if fill else sum((c.isNotNull().cast("int") for c in cols), F.lit(0))
    return out.select(feature, *(F.coalesce(c, F.lit(0.0)).alias(f"m{i}") if fill else c for i, c in enumerate(cols)), (total / n).alias("mean_importance"))


def rule_difficulty(topic: Column, section: Column, hard: list[str], easy: list[str], base: dict[str, str]) -> Column:
    """[P20] By lists of topics, else by section, else medium."""
    out = F.when(topic.isin(*hard), "hard").when(topic.isin(*easy), "easy")
    for k, v in base.items():
        out = out.when(section == k, v)
    return out.otherwise("medium")
