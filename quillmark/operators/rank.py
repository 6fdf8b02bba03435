"""Filters, orders and limits. Ties always end in a key, so results don't depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_lists(rows: DataFrame, **lists: list | None) -> DataFrame:
    """[P1, P2, P38] column = list of allowed values; an empty or missing list allows all. Pushed down to the scan."""
    for c, values in lists.items():
        if values:
            rows = rows.filter(F.col(c).isin(*values))
    return rows


def latest(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """[O1, O2, O5] ORDER BY .. LIMIT, as one top-n pass."""
    return rows.orderBy(*order).limit(n)


def top_per_group(rows: DataFrame, group: list[str], order: list, first: int, last: int, out: str = "rank") -> DataFrame:
    """[W1, W2, O6, O8, A61, A64] Places first..last of each group. Spark limits each partition before the shuffle (WindowGroupLimit)."""
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col(out).between(first, last))


def most_common(rows: DataFrame, value: str, first_at: str, n: int, group: list[str] | None = None) -> DataFrame:
    """[O4] Values by count, those seen first before their equals."""
    g = group or []
    c = rows.groupBy(*g, value).agg(F.count("*").alias("cnt"), F.min(first_at).alias("__at"))
    order = [F.desc("cnt"), F.col("__at"), F.col(value)]
    return (top_per_group(c, g, order, 1, n).drop("rank") if g else c.orderBy(*order).limit(n)).drop("__at")


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """[O10] n rows by a hash of key and seed: the same rows each time, whatever the partitions."""
    return rows.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), key).limit(n)


def within_months(rows: DataFrame, ts: str, as_of: Column, months: int) -> DataFrame:
    """[P5] Not older than months x 30 days before as_of."""
    return rows.filter(F.col(ts) >= as_of - F.make_dt_interval(F.lit(30 * months)))


def at_least(rows: DataFrame, value: str, least: float, key: str) -> DataFrame:
    """[P6]"""
    return rows.filter(F.col(value) >= least).orderBy(F.desc(value), key)


def severity_order(priority: Column) -> Column:
    """[O7]"""
    return F.when(priority == "high", 0).when(priority == "medium", 1).when(priority == "low", 2).otherwise(3)


def paper_type(n: Column) -> Column:
    """[P30]"""
    return F.when(n >= 80, "full").when(n <= 40, "single_section").when(n >= 60, "full").otherwise("single_section")


def page_text(lines: DataFrame, group: list[str], page: str, y: str, x: str, text: str) -> DataFrame:
    """[O9] Lines in reading order, a marker before each page."""
    pages = lines.groupBy(*group, page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(y, x, F.col(text).alias("t")))), lambda r: r["t"]), "\n").alias("__text"))
    told = F.transform(F.array_sort(F.collect_list(F.struct(page, "__text"))), lambda r: F.concat(F.lit("--- page "), r[page].cast("string"), F.lit(" ---\n"), r["__text"]))
    return pages.groupBy(*group).agg(F.array_join(told, "\n").alias("full_text"))


def digest(rows: DataFrame, category: str, score: str, key: str, order: list[str], n: int) -> DataFrame:
    """[A62] The best n of each category, categories in a fixed order, others last."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*(F.lit(x) for x in order)), F.col(category)), F.lit(0)), F.lit(len(order) + 1))
    return top_per_group(rows, [category], [F.desc(score), key], 1, n).withColumn("category_place", place)


def distinct_sorted(rows: DataFrame, *columns: str) -> DataFrame:
    """[A15] Different values, in order."""
    return rows.select(*columns).distinct().orderBy(*columns)


def valid_rows(rows: DataFrame, text: str, topic: str, section: str, least: int = 10) -> DataFrame:
    """[P7] Rows with a known topic and section, a text of `least` characters and no placeholder in it."""
    known = lambda c: F.coalesce(F.upper(F.trim(F.col(c))), F.lit("")).isin("", "UNKNOWN")
    return rows.filter(~known(topic) & ~known(section) & (F.length(F.trim(F.col(text))) >= least) & ~F.lower(text).contains("placeholder"))


def with_default(rows: DataFrame, other: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """[J4] The other table's value, or the row's own; the first by value where a key repeats."""
    o = other.groupBy(key).agg(F.min(value).alias("__v"))
    return rows.join(o, key, "left").withColumn(out, F.coalesce("__v", value)).drop("__v")


def boosted(rows: DataFrame, chosen: DataFrame, key: str, value: str, factor: float = 1.5) -> DataFrame:
    """[J10] Values of chosen keys times the factor."""
    c = chosen.select(key).distinct().withColumn("__c", F.lit(factor))
    return rows.join(c, key, "left").withColumn(value, F.col(value) * F.coalesce("__c", F.lit(1.0))).drop("__c")


def category_counts(rows: DataFrame, category: str, score: str, strong: float = 0.7) -> DataFrame:
    """[A63]"""
    return rows.groupBy(category).agg(F.count("*").alias("cnt"), F.count_if(F.col(score) >= strong).alias("n_strong"))


def confidence(n: Column, trend: Column, how: str = "simple") -> Column:
    """[P24] From the number of years: .6 + .05 n up to .85, .65 + .05 n up to .9, or with up to .1 for a steady trend."""
    base = {"simple": (0.6, 0.85), "weighted": (0.65, 0.90), "trend": (0.6, 0.90)}[how]
    steady = 0.1 * (1 - F.least(F.abs(trend), F.lit(0.5))) if how == "trend" else F.lit(0.0)
    return F.least(base[0] + 0.05 * n + steady, F.lit(base[1]))


def or_default_shares(shares: DataFrame, difficulty: str, share: str, defaults: dict[str, float]) -> DataFrame:
    """[P40] Shares by difficulty; a fixed share where there are no rows."""
    every = shares.sparkSession.createDataFrame(list(defaults.items()), f"{difficulty} string, __d double")
    return every.join(shares, difficulty, "left").select(difficulty, F.coalesce(share, "__d").alias(share))
