"""Models: tree ensembles of pyspark.ml, and injected callables for language models, which are never called from here by name."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.lineage import written

#: So many rows stand for all that are alike, where there are more.
PIECES = 64


def hash_split(rows: DataFrame, key: str, percent: int = 80, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """[X8] The same split each time, whatever the partitions."""
    at = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(100))
    return rows.filter(at < percent), rows.filter(at >= percent)


class Ensemble:
    """[X6, D1] Two boosted models and a forest, weighted .40, .35, .25; a model that is missing adds nothing."""

    def __init__(self, features: list[str], label: str, weights: tuple[float, ...] = (0.40, 0.35, 0.25), trees: int = 20, seed: int = 42):
        self.features, self.label, self.weights, self.trees, self.seed, self.models = features, label, weights, trees, seed, []

    def _vector(self, rows: DataFrame) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler

        return VectorAssembler(inputCols=self.features, outputCol="__x", handleInvalid="keep").transform(rows.fillna(0, self.features))

    def fit(self, rows: DataFrame) -> Ensemble:
        from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

        common = {"featuresCol": "__x", "labelCol": self.label, "seed": self.seed}
        makers = [
            GBTRegressor(maxIter=self.trees, maxDepth=5, stepSize=0.1, predictionCol="__p0", **common),
            GBTRegressor(maxIter=self.trees, maxDepth=3, stepSize=0.1, subsamplingRate=0.8, predictionCol="__p1", **common),
            RandomForestRegressor(numTrees=self.trees, maxDepth=10, predictionCol="__p2", **common),
        ]
        x = self._vector(rows).persist()
        self.models = [m.fit(x) for m in makers]
        x.unpersist()
        return self

    def predict(self, rows: DataFrame, out: str = "predicted") -> DataFrame:
        x = self._vector(rows)
        for m in self.models:
            x = m.transform(x)
        return x.withColumn(out, sum((F.col(f"__p{i}") * w for i, w in enumerate(self.weights[: len(self.models)])), F.lit(0.0))).drop("__x", *(f"__p{i}" for i in range(len(self.models))))

    def importances(self, spark) -> DataFrame:
        """[A65, X9] feature, importance of the forest."""
        return spark.createDataFrame([(f, float(v)) for f, v in zip(self.features, self.models[-1].featureImportances.toArray())], "feature string, importance double")


def permutation_importance(model: Ensemble, rows: DataFrame, key: str, seed: int = 42) -> dict[str, float]:
    """[A65] How much the mean squared error rises when one feature's values are dealt anew, by a hash order."""
    from pyspark.sql import Window

    mse = lambda d: model.predict(d).agg(F.avg((F.col("predicted") - F.col(model.label)) ** 2)).first()[0]
    base, out = mse(rows), {}
    for f in model.features:
        # Bucketed row numbers keep the deal spread over tasks.
        b = F.pmod(F.xxhash64(F.col(key)), F.lit(64))
        one = rows.withColumn("__b", b).withColumn("__i", F.row_number().over(Window.partitionBy("__b").orderBy(key)))
        other = one.select("__b", F.row_number().over(Window.partitionBy("__b").orderBy(F.xxhash64(F.col(key), F.lit(seed)))).alias("__i"), F.col(f).alias("__v"))
        out[f] = mse(one.join(other, ["__b", "__i"]).withColumn(f, F.col("__v")).drop("__b", "__i", "__v")) - base
    return out


def difficulty_classifier(rows: DataFrame, features: list[str], label: str, folds: int = 3, least: int = 10, seed: int = 42):
    """[X7] A forest with classes weighted to be equal, chosen by weighted F1; None under `least` labelled rows: use the rules then.

    Rows alike in label and features are learnt from as PIECES rows at most, which weigh as much as all of them: every row counts, in the trees and in F1, and what a fit
    reads grows with the different rows, not with their copies. Bootstraps and folds deal out these pieces.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    counts = rows.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("__c"))
    n, k = counts.agg(F.coalesce(F.sum("__c"), F.lit(0)), F.count("*")).first()
    if n < least or k < 2:
        return None
    alike = rows.groupBy(label, *features).agg(F.count("*").alias("__n")).join(counts, label)
    pieces = F.least(F.col("__n"), F.lit(PIECES))
    each = alike.withColumn("__k", F.col("__n") / pieces).withColumn("__w", F.lit(float(n)) / (F.lit(k) * F.col("__c")) * F.col("__k"))
    weighted = written(each.select(label, *features, "__k", "__w", F.explode(F.sequence(F.lit(1).cast("long"), pieces)).alias("__i")).drop("__i"), "alike")
    forest = RandomForestClassifier(featuresCol="__x", labelCol="__y", weightCol="__w", numTrees=30, seed=seed)
    stages = Pipeline(stages=[StringIndexer(inputCol=label, outputCol="__y"), VectorAssembler(inputCols=features, outputCol="__x"), forest])
    judge = MulticlassClassificationEvaluator(labelCol="__y", weightCol="__k", metricName="weightedFMeasure")
    return CrossValidator(estimator=stages, estimatorParamMaps=ParamGridBuilder().addGrid(forest.maxDepth, [5, 10]).build(), evaluator=judge, numFolds=folds, seed=seed).fit(weighted)


def call_model(rows: DataFrame, key: str, text: str, model: Callable[[list[str]], list[tuple[str, float]]]) -> DataFrame:
    """[X1, X2, S15] key, said, said_confidence from an injected function over batches of texts."""
    import pandas as pd

    schema = T.StructType([rows.schema[key], T.StructField("said", T.StringType()), T.StructField("said_confidence", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            said = model([t or "" for t in b[text]])
            yield pd.DataFrame({key: b[key], "said": [s for s, _ in said], "said_confidence": [float(c) for _, c in said]})

    return rows.select(key, text).mapInPandas(run, schema)


def cascade(rows: DataFrame, key: str, text: str, label: str, confidence: str, steps: list[tuple[float, Callable]]) -> DataFrame:
    """[X1, D5, D6] Rows under a step's bound, and those alone, go to its model; an answer counts if it is surer. Rows keep their order of steps."""
    for bound, model in steps:
        low = rows.filter(F.col(confidence) < bound)
        said = call_model(low, key, text, model)
        better = F.col("said_confidence") > F.col(confidence)
        asked = low.join(said, key).withColumn(label, F.when(better, F.col("said")).otherwise(F.col(label))).withColumn(confidence, F.when(better, F.col("said_confidence")).otherwise(F.col(confidence))).drop("said", "said_confidence")
        rows = rows.filter(~(F.col(confidence) < bound) | F.col(confidence).isNull()).unionByName(asked)
    return rows


def silent(texts: list[str]) -> list[tuple[str, float]]:
    """The default model: says nothing, surely."""
    return [("unknown", 0.0)] * len(texts)


def prompts(wants: DataFrame, samples: DataFrame, section: str, topic: str, n: int = 3) -> DataFrame:
    """[X3, O8] A prompt for each topic, with up to n sample questions."""
    from ..operators.rank import top_per_group

    s = top_per_group(samples, [section, topic], ["sample"], 1, n).groupBy(section, topic).agg(F.array_sort(F.collect_list("sample")).alias("s"))
    told = F.concat(F.lit("Write "), F.col("want").cast("string"), F.lit(" questions on "), F.col(topic), F.lit(" for "), F.col(section), F.lit(".\nExamples:\n"), F.coalesce(F.array_join("s", "\n"), F.lit("none")), F.lit('\nAnswer with JSON: {"question": .., "options": [..], "answer": "A"}'))
    return wants.join(s, [section, topic], "left").select(section, topic, told.alias("prompt"))


def parsed_answers(answers: DataFrame, answer: str) -> DataFrame:
    """[X3, F23, F26] question, options, right_option; valid needs four options and a letter among them."""
    from ..functions.text import clean_option, fenced_json, right_option

    d = answers.withColumn("__j", fenced_json(F.col(answer), "question string, options array<string>, answer string"))
    options = F.transform("__j.options", clean_option)
    d = d.withColumn("question", F.col("__j.question")).withColumn("options", options).withColumn("right_option", right_option(options, F.col("__j.answer")))
    return d.withColumn("valid", F.coalesce((F.size("options") == 4) & F.col("right_option").isNotNull() & (F.length("question") > 0), F.lit(False))).drop("__j")


def filled_template(template: Column, key: Column, lo: int, hi: int, seed: int = 42) -> Column:
    """Each N becomes a number of lo..hi, by a hash of key, seed and place."""
    parts = F.split(template, r"\bN\b", -1)
    return F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.struct(F.get(parts, 0).alias("s"), F.lit(0).alias("i")), lambda a, p: F.struct(F.concat(a["s"], (F.pmod(F.xxhash64(key, a["i"], F.lit(seed)), F.lit(hi - lo + 1)) + lo).cast("string"), p).alias("s"), (a["i"] + 1).alias("i")), lambda a: a["s"])
