"""What must hold of trained models whatever their trees: rows, ranges, sums; each has SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import features as ft
from .plans import models as pm
from .queries import NATION, customer_series, query, table


def _nations(spark, sf_dir):
    return ft.features13(customer_series(spark, sf_dir), ["topic"], 2001).fillna(0.0).withColumn("hi", F.col("hi").cast("double"))


@query(NATION + "SELECT count(DISTINCT topic) AS n_topics, true AS near_labels, true AS better_than_mean, 1.0::DOUBLE AS importances, 4 AS n_features FROM series")
def ensemble_checks(spark, sf_dir):
    """[X6, X9] A prediction for each topic, within a tenth of the labels' range around it and nearer than their mean; importances add up to one."""
    f = _nations(spark, sf_dir)
    model = pm.Ensemble(["avg", "recent", "trend", "std"], "hi", trees=5).fit(f)
    told = model.predict(f)
    lo, hi, p = F.min("hi"), F.max("hi"), F.col("predicted")
    error, spread = F.avg((p - F.col("hi")) ** 2), F.var_pop("hi")
    one = told.agg(F.count("*").alias("n_topics"), ((F.min(p) >= lo - (hi - lo) / 10) & (F.max(p) <= hi + (hi - lo) / 10)).alias("near_labels"), (error <= spread).alias("better_than_mean"))
    shares = model.importances(spark).filter("importance >= 0").agg(F.round(F.sum("importance"), 6).alias("importances"), F.count("*").cast("int").alias("n_features"))
    return one.join(shares)  # one row each


@query("SELECT * FROM (VALUES ('avg', true), ('recent', true)) t(feature, told) WHERE EXISTS (SELECT 1 FROM orders)")
def permutation_checks(spark, sf_dir):
    """[A65] A finite rise of the error for each feature."""
    model = pm.Ensemble(["avg", "recent"], "hi", trees=2).fit(f := _nations(spark, sf_dir))
    rise = pm.permutation_importance(model, f, "topic")
    return spark.createDataFrame([(k, v == v and abs(v) != float("inf")) for k, v in rise.items()], "feature string, told boolean")


@query("SELECT l_returnflag AS label, count(*) AS n, true AS known_class FROM lineitem GROUP BY 1")
def difficulty_checks(spark, sf_dir):
    """[X7] A class of the labels' for each row, labelled or not."""
    d = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("label"), F.year("l_shipdate").cast("double").alias("year"), "l_quantity", "l_discount")
    model = pm.difficulty_classifier(d, ["year", "l_quantity", "l_discount"], "label", folds=2)
    told = model.transform(d.withColumn("__w", F.lit(1.0)))
    k = d.select("label").distinct().count()
    return told.groupBy("label").agg(F.count("*").alias("n"), F.min((F.col("prediction") % 1 == 0) & F.col("prediction").between(0, k - 1)).alias("known_class"))
