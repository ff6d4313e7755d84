"""Purchase, churn and lifetime-value models on Spark ML."""

from __future__ import annotations

import json
import random

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noteworks.functions.rules import cut_risk_level, cut_risk_segment, cut_value_segment
from noteworks.operators import features as X
from noteworks.operators.ranking import global_index, quartile_segment
from noteworks.session import cut_lineage


def split(rows: DataFrame, key: str = "client_id", test: float = 0.2, seed: int = 42, label: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by a hash of the key, stable under repartitioning. With ``label`` the share is exact
    within every label (to the nearest row); keys must be unique then."""
    if label is not None:
        marked = rows.join(stratified_marks(rows, key, label, test, seed), key)
        return marked.where(~F.col("_test")).drop("_test"), marked.where("_test").drop("_test")
    bucket = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(10_000)) / 10_000
    return rows.where(bucket >= test), rows.where(bucket < test)


def stratified_marks(rows: DataFrame, key: str, label: str, test: float, seed: int) -> DataFrame:
    """``key, _test``: the first ``test`` of every label in the order of a hash of the key.

    Places come from one global order of label and hash, so a label that holds most rows spreads over tasks.
    """
    hashed = rows.select(key, F.col(label).alias("_label"), F.xxhash64(key, F.lit(seed)).alias("_hash"))
    placed = global_index(hashed, ["_label", "_hash", key], "_at")
    sizes = placed.groupBy("_label").agg(F.count("*").alias("_n"), F.min("_at").alias("_first")).withColumnRenamed("_label", "_l")
    own = placed.join(sizes, F.col("_label").eqNullSafe(F.col("_l")))
    return cut_lineage(own.select(key, (F.col("_at") - F.col("_first") < F.round(F.col("_n") * test)).alias("_test")))


def ordered(rows: DataFrame, key: str = "client_id") -> DataFrame:
    """Range-partitioned and sorted by key, so that a seeded fit sees the same rows in the same order."""
    return rows.repartitionByRange(key).sortWithinPartitions(key)


def balanced_weights(rows: DataFrame, label: str) -> DataFrame:
    """Add ``weight`` = n / (classes * n of the class)."""
    counts = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count("*").alias("n")).collect()}  # one row per class
    total, k = sum(counts.values()), max(1, len(counts))
    weight = F.lit(1.0)
    for value, n in counts.items():
        weight = F.when(F.col(label) == value, total / (k * n)).otherwise(weight)
    return rows.withColumn("weight", weight)


def _pipeline(estimator) -> Pipeline:
    # Not centred: sparse vectors stay sparse, trees do not care, and the intercept of a linear model absorbs it.
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=False, withStd=True)
    return Pipeline(stages=[scaler, estimator])


def classification_metrics(scored: DataFrame, label: str) -> dict[str, float]:
    out = {}
    for name, metric in (("accuracy", "accuracy"), ("precision", "weightedPrecision"), ("recall", "weightedRecall"), ("f1", "f1")):
        out[name] = MulticlassClassificationEvaluator(labelCol=label, predictionCol="prediction", metricName=metric).evaluate(scored)
    out["auc"] = BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="probability").evaluate(scored)
    return out


def regression_metrics(scored: DataFrame, label: str) -> dict[str, float]:
    return {m: RegressionEvaluator(labelCol=label, predictionCol="prediction", metricName=m).evaluate(scored) for m in ("rmse", "r2")}


def _importances(model: PipelineModel, top: int = 10) -> list[tuple[int, float]]:
    values = model.stages[-1].featureImportances
    return sorted(((int(i), float(v)) for i, v in zip(values.indices, values.values)), key=lambda p: (-p[1], p[0]))[:top]


def train_purchase(rows: DataFrame, trees: int = 100, depth: int = 10, label: str = "purchased", seed: int = 42) -> tuple[PipelineModel, dict]:
    train, test = split(rows, label=label)
    forest = RandomForestClassifier(featuresCol="scaled", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed)
    model = _pipeline(forest).fit(ordered(train))
    return model, {**classification_metrics(model.transform(test), label), "importances": _importances(model)}


def train_churn(rows: DataFrame, trees: int = 100, depth: int = 10, label: str = "churned", seed: int = 42) -> tuple[PipelineModel, dict]:
    train, test = split(rows, label=label)
    forest = RandomForestClassifier(featuresCol="scaled", labelCol=label, weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed)
    model = _pipeline(forest).fit(ordered(balanced_weights(train, label)))
    return model, classification_metrics(model.transform(test), label)


def train_clv(rows: DataFrame, trees: int = 100, depth: int = 10, label: str = "lifetime_value", seed: int = 42) -> tuple[PipelineModel, dict]:
    train, test = split(rows)
    forest = RandomForestRegressor(featuresCol="scaled", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed)
    model = _pipeline(forest).fit(ordered(train))
    return model, regression_metrics(model.transform(test), label)


def positive_probability(scored: DataFrame) -> Column:
    return F.get(vector_to_array(F.col("probability")), F.lit(1))


def _vote(models: list[PipelineModel], rows: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """Mean of ``value`` over the models, computed row by row without a join."""
    out = rows
    for i, model in enumerate(models):
        scored = model.transform(out).withColumn(f"_m{i}", value)
        out = scored.drop("scaled", "rawPrediction", "probability", "prediction")
    mean = sum((F.col(f"_m{i}") for i in range(len(models))), F.lit(0.0)) / len(models)
    return out.withColumn(name, mean).drop(*[f"_m{i}" for i in range(len(models))])


def ensemble_classifier(rows: DataFrame, label: str, trees: int = 100, depth: int = 10, seed: int = 42) -> tuple[list[PipelineModel], dict]:
    """Forest, boosted trees and logistic regression; the vote averages their probabilities."""
    train, test = split(rows, label=label)
    data = ordered(train)
    kinds = [
        RandomForestClassifier(featuresCol="scaled", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed),
        GBTClassifier(featuresCol="scaled", labelCol=label, maxIter=max(5, trees // 5), maxDepth=min(5, depth), seed=seed),
        LogisticRegression(featuresCol="scaled", labelCol=label, maxIter=100),
    ]
    models = [_pipeline(k).fit(data) for k in kinds]
    voted = vote_classes(models, test)
    auc = BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="probability_mean").evaluate(voted)
    right = voted.agg(F.avg((F.col("prediction") == F.col(label)).cast("double")).alias("a")).first()["a"]
    return models, {"accuracy": right, "auc": auc}


def vote_classes(models: list[PipelineModel], rows: DataFrame, key: str = "client_id") -> DataFrame:
    value = F.get(vector_to_array(F.col("probability")), F.lit(1))
    voted = _vote(models, rows, key, value, "probability_mean")
    return voted.withColumn("prediction", (F.col("probability_mean") > 0.5).cast("double"))


def ensemble_regressor(rows: DataFrame, label: str, trees: int = 100, depth: int = 10, seed: int = 42) -> tuple[list[PipelineModel], dict]:
    """Forest, boosted trees and ridge; the vote averages their predictions."""
    train, test = split(rows)
    data = ordered(train)
    kinds = [
        RandomForestRegressor(featuresCol="scaled", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed),
        GBTRegressor(featuresCol="scaled", labelCol=label, maxIter=max(5, trees // 5), maxDepth=min(5, depth), seed=seed),
        LinearRegression(featuresCol="scaled", labelCol=label, regParam=1.0, elasticNetParam=0.0),
    ]
    models = [_pipeline(k).fit(data) for k in kinds]
    return models, regression_metrics(vote_values(models, test), label)


def vote_values(models: list[PipelineModel], rows: DataFrame, key: str = "client_id") -> DataFrame:
    return _vote(models, rows, key, F.col("prediction"), "mean_prediction").withColumnRenamed("mean_prediction", "prediction")


def model_search(rows: DataFrame, label: str, draws: int = 10, folds: int = 3, seed: int = 42) -> tuple[str, PipelineModel, dict[str, dict]]:
    """Random draws of parameters per model family, cross-validated; the best family by AUC wins."""
    rng = random.Random(seed)
    train, test = split(rows, label=label)
    data = ordered(train)
    forest = RandomForestClassifier(featuresCol="scaled", labelCol=label, seed=seed)
    boosted = GBTClassifier(featuresCol="scaled", labelCol=label, seed=seed)
    logistic = LogisticRegression(featuresCol="scaled", labelCol=label)
    spaces = {
        "forest": (forest, lambda: {forest.numTrees: rng.choice([50, 100, 200]), forest.maxDepth: rng.choice([5, 10, 15])}),
        "boosted": (boosted, lambda: {boosted.maxIter: rng.choice([10, 20, 40]), boosted.maxDepth: rng.choice([3, 5])}),
        "logistic": (logistic, lambda: {logistic.regParam: rng.choice([0.0, 0.01, 0.1, 1.0])}),
    }
    metric = BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="probability")
    found: dict[str, PipelineModel] = {}
    metrics: dict[str, dict] = {}
    for name, (estimator, draw) in spaces.items():
        grid = [draw() for _ in range(draws)]
        fitted = CrossValidator(estimator=_pipeline(estimator), estimatorParamMaps=grid, evaluator=metric, numFolds=folds, seed=seed, parallelism=2).fit(data)
        found[name] = fitted.bestModel
        metrics[name] = classification_metrics(fitted.bestModel.transform(test), label)
    best = max(metrics, key=lambda n: metrics[n]["auc"])
    return best, found[best], metrics


def predict(features: DataFrame, purchase: PipelineModel, churn: PipelineModel, clv: PipelineModel) -> DataFrame:
    """All three predictions with their bands, in one pass over the feature rows."""
    drop = ("scaled", "rawPrediction", "probability", "prediction")
    p = purchase.transform(features)
    p = p.withColumn("purchase_prob", positive_probability(p)).drop(*drop)
    c = churn.transform(p)
    c = c.withColumn("churn_risk", positive_probability(c)).drop(*drop)
    v = clv.transform(c).withColumn("predicted_clv", F.col("prediction")).drop(*drop)
    return v.select(
        *[x for x in features.columns if x != "features"], "purchase_prob", (F.col("purchase_prob") > 0.5).cast("int").alias("will_purchase"),
        "churn_risk", (F.col("churn_risk") > 0.5).cast("int").alias("will_churn"), "predicted_clv",
        cut_value_segment(F.col("predicted_clv")).alias("value_segment"), cut_risk_segment(F.col("churn_risk")).alias("risk_segment"),
        cut_risk_level(F.col("churn_risk")).alias("risk_level"),
    )


def merge_predictions(profiles: DataFrame, predictions: DataFrame) -> DataFrame:
    return profiles.join(predictions, "client_id", "left")


def value_quartiles(predictions: DataFrame) -> DataFrame:
    return quartile_segment(predictions, "predicted_clv", name="quartile")


def append_predictions(rows: DataFrame, text: str, key: str, purchase: PipelineModel, churn: PipelineModel, clv: PipelineModel) -> DataFrame:
    """Predictions for any table with a text column. The models must be trained on ``text_features``."""
    table = X.text_features(rows, text, key)
    columns = [c for c in table.columns if c != "client_id"]
    made = VectorAssembler(inputCols=columns, outputCol="features").transform(table).select("client_id", "features")
    scored = predict(made, purchase, churn, clv).withColumnRenamed("client_id", key)
    return rows.join(scored, key)


def collect_labels(predicted: DataFrame, actual: DataFrame) -> DataFrame:
    """Predictions beside outcomes, and whether they agree."""
    return predicted.join(actual, "client_id").withColumn(
        "purchase_right", (F.col("will_purchase") == F.col("purchased_actual")).cast("int")
    ).withColumn("churn_right", (F.col("will_churn") == F.col("churned_actual")).cast("int"))


def prediction_accuracy(collected: DataFrame) -> DataFrame:
    return collected.agg(
        F.count("*").alias("rows"), F.round(F.avg("purchase_right"), 4).alias("purchase_accuracy"), F.round(F.avg("churn_right"), 4).alias("churn_accuracy")
    )


def incremental_update(old: PipelineModel, new_rows: DataFrame, label: str, trees: int = 50, depth: int = 10, seed: int = 42) -> list[tuple[PipelineModel, int]]:
    """A delta forest grown on the new rows beside the old one, each weighing as many votes as it has trees."""
    forest = RandomForestClassifier(featuresCol="scaled", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed)
    delta = _pipeline(forest).fit(ordered(new_rows))
    return [(old, old.stages[-1].getNumTrees), (delta, trees)]


def vote_forests(forests: list[tuple[PipelineModel, int]], rows: DataFrame) -> DataFrame:
    out = rows
    total = sum(n for _, n in forests)
    mean = F.lit(0.0)
    for i, (model, n) in enumerate(forests):
        scored = model.transform(out)
        out = scored.withColumn(f"_f{i}", positive_probability(scored)).drop("scaled", "rawPrediction", "probability", "prediction")
        mean = mean + F.col(f"_f{i}") * (n / total)
    voted = out.withColumn("probability_mean", mean).drop(*[f"_f{i}" for i in range(len(forests))])
    return voted.withColumn("prediction", (F.col("probability_mean") > 0.5).cast("double"))


def full_retrain(rows: DataFrame, target: str, trees: int = 250, depth: int = 20, seed: int = 42) -> tuple[PipelineModel, dict]:
    """Refit one target from scratch on all rows, 80/20."""
    train_one = {"purchased": train_purchase, "churned": train_churn, "lifetime_value": train_clv}[target]
    model, metrics = train_one(rows, trees=trees, depth=depth, seed=seed)
    return model, {**metrics, "samples": rows.count()}


def save_version(model: PipelineModel, name: str, version: str, metrics: dict, folder: str, spark: SparkSession) -> None:
    """Write the model and append a row to the history table."""
    model.write().overwrite().save(f"{folder}/models/{name}/{version}")
    score = metrics.get("accuracy", metrics.get("r2"))
    row = [(name, version, float(score), json.dumps({k: v for k, v in metrics.items() if isinstance(v, (int, float))}))]
    spark.createDataFrame(row, "name string, version string, score double, metrics string").coalesce(1).write.mode("append").parquet(f"{folder}/history")


def training_history(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/history")


def best_model(history: DataFrame) -> DataFrame:
    return history.groupBy("name").agg(F.max_by(F.struct("version", "score"), F.struct("score", "version")).alias("b")).select("name", "b.version", "b.score")


def compare_models(old: PipelineModel, new: PipelineModel, rows: DataFrame, label: str, regression: bool = False) -> dict[str, float | bool]:
    """Both models on the same rows; improvement in percent."""
    def score(model: PipelineModel) -> float:
        scored = model.transform(rows)
        return regression_metrics(scored, label)["r2"] if regression else classification_metrics(scored, label)["accuracy"]

    before, after = score(old), score(new)
    change = (after - before) / abs(before) * 100 if before else 0.0
    return {"old": before, "new": after, "improvement_pct": change, "better": after > before}


def train_sensitive_head(rows: DataFrame, layers: tuple[int, ...] = (128, 64), seed: int = 42) -> PipelineModel:
    """Perceptron over phrase embeddings ``(features, category)``."""
    size = len(rows.select(vector_to_array("features").alias("f")).first()["f"])
    indexer = StringIndexer(inputCol="category", outputCol="label", stringOrderType="alphabetAsc").fit(rows)
    head = MultilayerPerceptronClassifier(layers=[size, *layers, len(indexer.labels)], seed=seed, maxIter=100)
    return Pipeline(stages=[indexer, head]).fit(rows)
