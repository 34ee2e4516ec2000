"""Models on tables, with Spark's own learners."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def balanced(rows: DataFrame, label: str) -> DataFrame:
    """rows with weight n / (2 rows of the class)."""
    counts = rows.groupBy(label).agg(F.count("*").alias("k"))
    n = counts.agg(F.sum("k").alias("n"))
    weights = counts.join(F.broadcast(n)).select(label, (F.col("n") / (2 * F.col("k"))).alias("weight"))
    return rows.join(F.broadcast(weights), label)  # a row a class


def learner(features: Sequence[str], label: str, kind: str = "logistic", seed: int = 1) -> Pipeline:
    """Median imputation, then for the logistic model scaling and an L2 penalty; or a forest
    or boosted trees."""
    filled = [f"{f}__filled" for f in features]
    steps = [Imputer(strategy="median", inputCols=list(features), outputCols=filled), VectorAssembler(inputCols=filled, outputCol="raw")]
    if kind == "logistic":
        steps += [StandardScaler(inputCol="raw", outputCol="features", withMean=True), LogisticRegression(labelCol=label, weightCol="weight", regParam=0.1)]
    elif kind == "forest":
        steps += [RandomForestClassifier(labelCol=label, weightCol="weight", featuresCol="raw", numTrees=100, minInstancesPerNode=4, seed=seed)]
    elif kind == "boosted":
        steps += [GBTClassifier(labelCol=label, weightCol="weight", featuresCol="raw", maxIter=50, seed=seed)]
    else:
        raise ValueError(kind)
    return Pipeline(stages=steps)


def prior_scores(rows: DataFrame, group: str, id_col: str, label: str) -> DataFrame:
    """id, group, label, score: the share of positives among the rows of other groups, which any
    model has to beat; null where there are none. Null labels don't count, a null group is a
    group. Sums of the groups taken from the whole: no fit, no loop."""
    sums = rows.groupBy(F.col(group).alias("__g")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label).isin(0, 1)).alias("n"))
    whole = sums.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    others = sums.join(F.broadcast(whole)).select("__g", ((F.col("all_p") - F.col("p")) / F.nullif(F.col("all_n") - F.col("n"), F.lit(0))).alias("score"))
    return rows.join(others, F.col(group).eqNullSafe(F.col("__g"))).select(id_col, group, label, "score")


def leave_one_group_out(rows: DataFrame, group: str, id_col: str, features: Sequence[str], label: str, kind: str = "logistic", most: int = 500) -> DataFrame:
    """id, group, label, score of every row, from a model that saw no row of its group.
    The driver loops over the groups, a fit each: sites of a benchmark, not data. More than
    `most` of them are an error before the first fit: bring them into folds then."""
    groups = [g for (g,) in rows.where(F.col(group).isNotNull()).select(group).distinct().limit(most + 1).collect()]
    if len(groups) > most:
        raise ValueError(f"more than {most} groups; fit by folds of groups")
    out = None
    for g in sorted(groups):
        model = learner(features, label, kind).fit(balanced(rows.where(F.col(group) != g), label))
        held = model.transform(rows.where(F.col(group) == g)).select(id_col, group, label, F.round(vector_to_array("probability")[1], 6).alias("score"))
        out = held if out is None else out.union(held)
    return out if out is not None else rows.select(id_col, group, label, F.lit(0.0).alias("score")).limit(0)
