"""Trends, alternation, breaks and forecasts of series (keys, year, cnt)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import pooled_t_pvalue, t_pvalue
from .features import ema, last_n, mean_of, ordered, values_in_order


def placed(series: DataFrame, keys: list[str], year: str = "year") -> DataFrame:
    return series.withColumn("x", F.row_number().over(ordered(keys, year)) - 1)


def linear_trend(series: DataFrame, keys: list[str], x: str = "x", value: str = "cnt", least: int = 3) -> DataFrame:
    """[A29, A30] slope, intercept, r2 for series of `least` points with different x. A constant series has r2 0."""
    g = series.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope(F.col(value), F.col(x)).alias("slope"), F.regr_intercept(F.col(value), F.col(x)).alias("intercept"), F.regr_r2(F.col(value), F.col(x)).alias("r2"), F.var_pop(value).alias("__v"))
    return g.filter((F.col("n") >= least) & F.col("slope").isNotNull()).withColumn("r2", F.when(F.col("__v") == 0, 0.0).otherwise(F.col("r2"))).drop("__v")


def trend_test(series: DataFrame, keys: list[str], value: str = "cnt", alpha: float = 0.05, steep: float = 0.1) -> DataFrame:
    """[A33, P25] Slope over places, its two-sided p, and a label: significant and steeper than `steep`. Four points at least."""
    g = placed(series, keys).groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope(F.col(value), F.col("x")).alias("slope"), F.regr_sxx(F.col(value), F.col("x")).alias("sxx"), F.regr_syy(F.col(value), F.col("x")).alias("syy"), F.regr_sxy(F.col(value), F.col("x")).alias("sxy"))
    rest = F.greatest(F.col("syy") - F.col("sxy") ** 2 / F.col("sxx"), F.lit(0.0))
    exact = rest <= 1e-12 * F.greatest(F.col("syy"), F.lit(1.0))
    t = F.col("slope") / F.sqrt(rest / (F.col("n") - 2) / F.col("sxx"))
    p = F.when(exact, F.when(F.abs("slope") < 1e-12, 1.0).otherwise(0.0)).otherwise(t_pvalue(t, F.col("n") - 2))
    g = g.filter("n >= 4").withColumn("p", p)
    label = F.when((F.col("p") < alpha) & (F.col("slope") > steep), "rising").when((F.col("p") < alpha) & (F.col("slope") < -steep), "declining").otherwise("stable")
    return g.select(*keys, "n", "slope", "p", label.alias("trend"))


def alternation(series: DataFrame, keys: list[str], value: str = "cnt", alpha: float = 0.05) -> DataFrame:
    """[A34] Even places against odd ones: p of a pooled t test, strength |difference of means| / (mean + .01)."""
    even, odd = F.col("x") % 2 == 0, F.col("x") % 2 == 1
    v = lambda on: F.when(on, F.col(value))
    g = placed(series, keys).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(value).alias("m"), *(f(v(on)).alias(name + side) for on, side in ((even, "0"), (odd, "1")) for f, name in ((F.count, "n"), (F.avg, "m"), (F.var_samp, "v")))
    )
    p = pooled_t_pvalue(F.col("n0"), F.col("m0"), F.col("v0"), F.col("n1"), F.col("m1"), F.col("v1"))
    return g.filter("n >= 4").select(*keys, "n", p.alias("p"), (F.abs(F.col("m0") - F.col("m1")) / (F.col("m") + 0.01)).alias("strength"), F.coalesce(p < alpha, F.lit(False)).alias("alternates"))


def structural_break(series: DataFrame, keys: list[str], value: str = "cnt", year: str = "year", alpha: float = 0.05, least: float = 0.3, at_year: int | None = None) -> DataFrame:
    """[A35, A73] The split (two points or more on either side) with the largest relative change of means among those that are significant; the earliest
    of equals. detected if the change is over `least`. Six points. at_year fixes the split. Moments before and after each split are running sums."""
    w = ordered(keys, year)
    done, whole = w.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys)
    v = F.col(value).cast("double")
    s = placed(series, keys, year).select(*keys, year, "x", F.count("*").over(whole).alias("n"), F.sum(v).over(whole).alias("t"), F.sum(v * v).over(whole).alias("tt"), F.coalesce(F.sum(v).over(done), F.lit(0.0)).alias("a"), F.coalesce(F.sum(v * v).over(done), F.lit(0.0)).alias("aa"))
    n1, n2 = F.col("x"), F.col("n") - F.col("x")
    m1, m2 = F.col("a") / n1, (F.col("t") - F.col("a")) / n2
    v1 = F.greatest(F.col("aa") - n1 * m1 * m1, F.lit(0.0)) / (n1 - 1)
    v2 = F.greatest(F.col("tt") - F.col("aa") - n2 * m2 * m2, F.lit(0.0)) / (n2 - 1)
    tidy = lambda c: F.when(c < 1e-9, 0.0).otherwise(c)
    s = s.filter((F.col("n") >= 6) & (F.col("x") >= 2) & (F.col("x") <= F.col("n") - 2 - (0 if at_year else 1)))
    if at_year is not None:
        s = s.filter(F.col(year) == at_year)
    s = s.withColumn("p", pooled_t_pvalue(n1, m1, tidy(v1), n2, m2, tidy(v2))).withColumn("change", F.round(F.abs(m2 - m1) / (F.col("t") / F.col("n") + 0.01), 9))
    good = F.when(F.col("p") < alpha, F.struct(F.col("change"), (-F.col("x")).alias("early"), F.col(year).alias("at")))
    best = s.groupBy(*keys).agg(F.max(good).alias("b"))
    return best.select(*keys, F.coalesce(F.col("b.change") > least, F.lit(False)).alias("detected"), F.when(F.col("b.change") > least, F.col("b.at")).alias("break_year"), F.coalesce("b.change", F.lit(0.0)).alias("magnitude"))


def forecasts(series: DataFrame, keys: list[str], value: str = "cnt", year: str = "year") -> DataFrame:
    """[A36] Four ways with a range of 1.96 deviations, not under 0: mean, mean of three, exponential mean, line; each from the values it uses."""
    g = placed(series, keys, year).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), values_in_order(year, value).alias("v"), F.regr_slope(F.col(value), F.col("x")).alias("b"), F.regr_intercept(F.col(value), F.col("x")).alias("a"), F.regr_sxx(F.col(value), F.col("x")).alias("sxx"), F.regr_syy(F.col(value), F.col("x")).alias("syy"), F.regr_sxy(F.col(value), F.col("x")).alias("sxy"))
    three = last_n(F.col("v"), 3)
    m3 = mean_of(three)
    sd3 = F.sqrt(F.aggregate(three, F.lit(0.0), lambda s, x: s + (x - m3) * (x - m3)) / F.size(three))
    se = F.sqrt(F.greatest(F.col("syy") - F.col("sxy") ** 2 / F.col("sxx"), F.lit(0.0)) / (F.col("n") - 2) / F.col("sxx"))
    line = F.when(F.col("n") >= 3, F.col("a") + F.col("b") * F.col("n")).otherwise(F.element_at("v", -1).cast("double"))
    e = ema(F.col("v"))
    low, high = (lambda c, d: F.greatest(c - 1.96 * d, F.lit(0.0))), (lambda c, d: c + 1.96 * d)
    spread = F.when(F.col("n") >= 3, se * F.sqrt("n")).otherwise(0.0)
    return g.select(*keys, F.col("mean").alias("f_mean"), low(F.col("mean"), F.col("sd")).alias("mean_low"), high(F.col("mean"), F.col("sd")).alias("mean_high"), m3.alias("f_ma3"), e.alias("f_ema"), low(e, sd3).alias("ema_low"), high(e, sd3).alias("ema_high"), line.alias("f_line"), low(line, spread).alias("line_low"), high(line, spread).alias("line_high"))


def trend_report(series: DataFrame, keys: list[str]) -> DataFrame:
    """[A37] Trend, alternation, break and the linear forecast of each series, rounded; series too short for a part have nulls there."""
    r = lambda *names: [F.round(n, 6).alias(n) for n in names]
    out = trend_test(series, keys).select(*keys, "trend", *r("slope", "p"))
    out = out.join(alternation(series, keys).select(*keys, "alternates", *r("strength")), keys, "full")
    out = out.join(structural_break(series, keys).select(*keys, "detected", "break_year"), keys, "left")
    return out.join(forecasts(series, keys).select(*keys, *r("f_line", "line_low", "line_high")), keys)


def hot_topics(report: DataFrame, keys: list[str], predicted: str, n: int = 10) -> DataFrame:
    """[O3, A74] Rising ones by predicted x (1 + |slope|)."""
    return report.filter("trend = 'rising'").withColumn("heat", F.col(predicted) * (1 + F.abs("slope"))).orderBy(F.desc("heat"), *keys).limit(n)


def cold_topics(report: DataFrame, keys: list[str], n: int = 5) -> DataFrame:
    """[O3, A74] Declining ones by |slope|."""
    return report.filter("trend = 'declining'").orderBy(F.desc(F.abs("slope")), *keys).limit(n)


def recent_against_old(series: DataFrame, keys: list[str], recent: int, old: tuple[int, int], year: str = "year", value: str = "cnt") -> DataFrame:
    """[A31, P25] Mean since `recent` against the mean of years old[0]..old[1] in percent, label at 30, share of years present, last year, history."""
    v = F.col(value)
    g = series.groupBy(*keys).agg(F.avg(F.when(F.col(year) >= recent, v)).alias("r"), F.avg(F.when(F.col(year).between(*old), v)).alias("o"), F.max(year).alias("last_seen"), F.countDistinct(year).alias("n_years"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(year).alias("y"), v.alias("v")))), lambda p: F.concat_ws(":", p["y"], p["v"])), ",").alias("history"))
    pct = F.when(F.col("o") > 0, (F.coalesce("r", F.lit(0.0)) - F.col("o")) / F.col("o") * 100).otherwise(F.when(F.col("r") > 0, 100.0).otherwise(0.0))
    return g.select(*keys, pct.alias("pct_change"), F.when(pct > 30, "rising").when(pct < -30, "declining").otherwise("stable").alias("trend"), "n_years", "last_seen", "history")


def growth_ends(dense: DataFrame, keys: list[str], cap: float = 500.0, year: str = "year", value: str = "cnt") -> DataFrame:
    """[A32] Mean of the last two years against that of the first two, in percent, at most `cap`."""
    a, b = F.row_number().over(ordered(keys, year)), F.row_number().over(ordered(keys, year, desc=True))
    g = dense.withColumn("__a", a).withColumn("__b", b).groupBy(*keys).agg(F.avg(F.when(F.col("__a") <= 2, F.col(value))).alias("first2"), F.avg(F.when(F.col("__b") <= 2, F.col(value))).alias("last2"))
    pct = F.when(F.col("first2") > 0, F.least((F.col("last2") - F.col("first2")) / F.col("first2") * 100, F.lit(cap))).otherwise(F.when(F.col("last2") > 0, 100.0).otherwise(0.0))
    return g.withColumn("growth", pct)


def half_life_mean(series: DataFrame, keys: list[str], year: str = "year", value: str = "cnt") -> DataFrame:
    """[A38, A40] Mean with weights that halve with each step back; also plain, and times 1.1 or .9 by the trend of the last two values."""
    s = series.withColumn("__w", F.pow(F.lit(0.5), F.row_number().over(ordered(keys, year, desc=True)) - 1))
    g = s.groupBy(*keys).agg((F.sum(F.col(value) * F.col("__w")) / F.sum("__w")).alias("weighted"), F.avg(value).alias("simple"), values_in_order(year, value).alias("v"))
    d = F.element_at("v", -1) - F.coalesce(F.try_element_at(F.col("v"), F.lit(-2)), F.element_at("v", -1))
    return g.select(*keys, "weighted", "simple", (F.col("weighted") * F.when(d > 0, 1.1).when(d < 0, 0.9).otherwise(1.0)).alias("adjusted"))


def quadratic_mean(series: DataFrame, keys: list[str], trend: Column, bonus: Column, k: int = 5, year: str = "year", value: str = "cnt") -> DataFrame:
    """[A39] Last k values, weights 1, 4, 9, .. from the oldest, times a trend factor and (1 + bonus)."""
    s = series.withColumn("__b", F.row_number().over(ordered(keys, year, desc=True))).filter(F.col("__b") <= k)
    s = s.withColumn("__w", F.pow(F.row_number().over(ordered(keys, year)), 2))
    return s.groupBy(*keys).agg((F.sum(F.col(value) * F.col("__w")) / F.sum("__w")).alias("base")).withColumn("predicted", F.col("base") * trend * (1 + bonus))


def trend_filter(rows: DataFrame, label: str, by: str, section: str | None = None) -> DataFrame:
    """[P3] Rows with a trend (and section), strongest first."""
    rows = rows.filter(F.col("trend") == label)
    return (rows if section is None else rows.filter(F.col("section") == section)).orderBy(F.desc(F.abs(by)))


def dormant(rows: DataFrame, as_of: int, k: int, last: str = "last_year") -> DataFrame:
    """[P4]"""
    return rows.filter(F.lit(as_of) - F.col(last) >= k)
