"""Fit, score and apply a supervised model with Spark ML."""

from __future__ import annotations

import uuid

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from fathomline.functions import values as V
from fathomline.operators.aggregate import confusion_pairs
from fathomline.session import scratch_folder

REGRESSORS = {
    "linear_regression": lambda: LinearRegression(),
    "ridge": lambda: LinearRegression(elasticNetParam=0.0),
    "random_forest_regressor": lambda: RandomForestRegressor(numTrees=100, seed=42),
    "gradient_boosting_regressor": lambda: GBTRegressor(maxIter=100, maxDepth=3, seed=42),
}
CLASSIFIERS = {
    "logistic_regression": lambda: LogisticRegression(maxIter=1000),
    "random_forest_classifier": lambda: RandomForestClassifier(numTrees=100, seed=42),
    "decision_tree_classifier": lambda: DecisionTreeClassifier(seed=42),
}
LEAST_ROWS = 5
# Parameter names users bring, and what Spark calls them.
KNOWN_AS = {
    "max_depth": "maxDepth", "max_iter": "maxIter", "learning_rate": "stepSize", "n_estimators": "numTrees",
}


def _parameters(algorithm: str, given: dict, rows: int) -> dict:
    """Spark's parameters. Penalties weigh against a sum over rows, Spark's against a mean."""
    out = dict(given)
    if algorithm == "ridge" and "regParam" not in out:
        out |= {"regParam": float(out.pop("alpha", 1.0)) / max(rows, 1), "standardization": False}
    if algorithm == "logistic_regression" and "regParam" not in out:
        out |= {"regParam": 1.0 / (float(out.pop("C", 1.0)) * max(rows, 1)), "standardization": False}
    trees = "maxIter" if algorithm.startswith("gradient") else "numTrees"
    return {(trees if k == "n_estimators" else KNOWN_AS.get(k, k)): v for k, v in out.items()}


def _frame(df: DataFrame, features: list[str], target: str | None = None) -> DataFrame:
    """Rows with every feature readable (and the target present)."""
    V.need(df, *features, *([target] if target else []))
    numbers = {f"_f{i}": V.number(df, f) for i, f in enumerate(features)}
    rows = df.withColumns(numbers)
    whole = V.every([F.col(n).isNotNull() for n in numbers])
    if target:
        whole = whole & V.col(df, target).isNotNull()
    return rows.where(whole)


def train(
    df: DataFrame,
    *,
    algorithm: str,
    target: str,
    features,
    test_size: float = 0.2,
    random_state: int = 42,
    hyperparameters: dict | None = None,
) -> tuple[PipelineModel, dict]:
    wanted = V.names(features)
    V.one_of("algorithm", algorithm, [*REGRESSORS, *CLASSIFIERS])
    if not 0 < test_size < 1:
        raise ValueError("test_size must lie between 0 and 1")
    regression = algorithm in REGRESSORS
    rows = _frame(df, wanted, target)
    if regression:
        rows = rows.withColumn("_label", V.number(df, target)).where("_label IS NOT NULL")
    else:
        rows = rows.withColumn("_class", V.col(df, target).cast("string"))
    fitting, testing = rows.randomSplit([1 - test_size, test_size], seed=random_state)
    n_fit, n_test = fitting.count(), testing.count()
    if n_fit + n_test < LEAST_ROWS:
        raise ValueError(f"training needs at least {LEAST_ROWS} complete rows")
    assemble = VectorAssembler(inputCols=[f"_f{i}" for i in range(len(wanted))], outputCol="_x")
    estimator = (REGRESSORS | CLASSIFIERS)[algorithm]()
    estimator = estimator.setParams(
        featuresCol="_x", labelCol="_label",
        predictionCol="prediction" if regression else "_guess",
        **_parameters(algorithm, hyperparameters or {}, n_fit),
    )
    if regression:
        stages = [assemble, estimator]
    else:
        labels = StringIndexer(
            inputCol="_class", outputCol="_label", handleInvalid="keep", stringOrderType="alphabetAsc"
        ).fit(fitting)
        back = IndexToString(inputCol="_guess", outputCol="prediction", labels=labels.labels + [""])
        stages = [labels, assemble, estimator, back]
    model = Pipeline(stages=stages).fit(fitting)
    scored = model.transform(testing)
    metrics = {"train_rows": n_fit, "test_rows": n_test}
    if regression:
        for name in ("r2", "rmse", "mae"):
            judge = RegressionEvaluator(labelCol="_label", predictionCol="prediction", metricName=name)
            metrics[name] = round(judge.evaluate(scored), 6)
    else:
        metrics |= _class_scores(scored)
    return model, metrics


def _class_scores(scored: DataFrame) -> dict:
    """Accuracy and macro F1 from the confusion counts, which are one row per pair."""
    pairs = confusion_pairs(scored, actual="_class", predicted="prediction")
    real = pairs.groupBy(F.col("actual").alias("class")).agg(F.sum("count").alias("real"))
    said = pairs.groupBy(F.col("predicted").alias("class")).agg(F.sum("count").alias("said"))
    hit = pairs.where("actual = predicted").select(F.col("actual").alias("class"), F.col("count").alias("hit"))
    per = real.join(said, "class", "full").join(hit, "class", "left").na.fill(0, ["real", "said", "hit"])
    row = per.agg(
        (F.sum("hit") / F.sum("real")).alias("accuracy"),
        F.avg(2 * F.col("hit") / (F.col("real") + F.col("said"))).alias("f1"),
    ).first()
    return {"accuracy": round(row["accuracy"] or 0.0, 6), "f1_macro": round(row["f1"] or 0.0, 6)}


def predict(df: DataFrame, model: PipelineModel | str, *, features) -> DataFrame:
    """Adds `prediction`; rows without every feature are left out."""
    if isinstance(model, str):
        model = PipelineModel.load(model)
    wanted = V.names(features)
    rows = _frame(df, wanted)
    applied = rows
    for stage in model.stages:
        # The stage that reads the true class is only needed while fitting.
        if stage.hasParam("inputCol") and stage.isSet("inputCol") and stage.getInputCol() == "_class":
            continue
        applied = stage.transform(applied)
    return applied.select(*[V.col(df, c) for c in df.columns], "prediction")


def train_model(
    df: DataFrame, *, algorithm: str, target: str, features, test_size: float = 0.2, random_state: int = 42,
    hyperparameters: dict | None = None,
) -> DataFrame:
    """One row for a composed plan: the folder that the fitted model was written to, its features and scores."""
    wanted = V.names(features)
    model, scores = train(
        df, algorithm=algorithm, target=target, features=wanted, test_size=test_size, random_state=random_state,
        hyperparameters=hyperparameters,
    )
    path = f"{scratch_folder(df.sparkSession)}/model-{uuid.uuid4().hex}"
    model.write().save(path)
    row = (path, algorithm, wanted, {k: float(v) for k, v in scores.items()})
    return df.sparkSession.createDataFrame(
        [row], "model string, algorithm string, features array<string>, scores map<string,double>"
    )


def apply_model(df: DataFrame, trained: DataFrame) -> DataFrame:
    """Predictions of a model that `train_model` wrote; `trained` is its one row."""
    rows = trained.select("model", "features").take(2)
    if len(rows) != 1:
        raise ValueError("apply_model takes the one row of train_model")
    return predict(df, rows[0]["model"], features=rows[0]["features"])


def skipped(df: DataFrame, *, features) -> DataFrame:
    wanted = V.names(features)
    unread = ~V.every([V.number(df, f).isNotNull() for f in wanted])
    return df.agg(F.count_if(~unread).alias("rows_predicted"), F.count_if(unread).alias("rows_skipped"))
