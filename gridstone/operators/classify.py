"""Classifiers over a grid of settings, chosen by cross-validated log loss, on Spark ML."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml import Pipeline
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import log_loss
from ..sources.facts import stored

#: Settings by family: the estimators of a grid, by name.
GRID: dict[str, dict[str, Callable]] = {
    "logistic": {f"penalty {p:g}": (lambda p=p: LogisticRegression(regParam=p, maxIter=50, featuresCol="scaled")) for p in (0.001, 0.01, 0.1, 1.0)},
    "forest": {f"depth {k}": (lambda k=k: RandomForestClassifier(maxDepth=k, numTrees=20, seed=7, featuresCol="scaled")) for k in (3, 6)},
}


def grid_losses(df: DataFrame, features: list[str], label: str, fold: str, grid: dict[str, dict[str, Callable]] = GRID) -> DataFrame:
    """family, setting, fold, rows, loss: mean log loss of every setting on each fold, fitted on the others. Means for missing values and scales are those of the training rows. Settings and folds are few; each fit is a Spark job over all rows."""
    rows = stored(df.select(*(F.col(f).cast("double").alias(f) for f in features), F.col(label).cast("double").alias("label"), F.col(fold).cast("int").alias("__fold")).filter("label is not null"), "grid-rows")
    folds = sorted(r[0] for r in rows.select("__fold").distinct().collect())
    parts = []
    for k in folds:
        train, test = rows.filter(F.col("__fold") != k), rows.filter(F.col("__fold") == k)
        before = Pipeline(stages=[Imputer(inputCols=features, outputCols=features), VectorAssembler(inputCols=features, outputCol="features"), StandardScaler(withMean=True, inputCol="features", outputCol="scaled")]).fit(train)
        ready, held = before.transform(train), before.transform(test)
        for family, settings in grid.items():
            for name, make in settings.items():
                p = make().fit(ready).transform(held).select(F.get(vector_to_array("probability"), F.col("label").cast("int")).alias("p"))
                parts.append(p.agg(F.count(F.lit(1)).alias("rows"), F.avg(log_loss(F.col("p"))).alias("loss")).select(F.lit(family).alias("family"), F.lit(name).alias("setting"), F.lit(k).alias("fold"), "rows", "loss"))
    return reduce(DataFrame.unionByName, parts)


def chosen_settings(losses: DataFrame) -> DataFrame:
    """family, setting, loss (over all rows of all folds) and whether it is the family's least; ties to the first name."""
    total = losses.groupBy("family", "setting").agg((F.sum(F.col("loss") * F.col("rows")) / F.sum("rows")).alias("loss"))
    best = total.groupBy("family").agg(F.min_by("setting", F.struct(F.round("loss", 9), "setting")).alias("__best"))
    return total.join(best, "family").withColumn("picked", F.col("setting") == F.col("__best")).drop("__best")
