"""Scalers, regressors, classifiers and forecasters.

Scalers are window formulas.  Estimators over all entities are ``pyspark.ml``
pipelines.  Boosted trees have one model for each entity and learn for all of them
in one plan; with a registry they are kept and used again.  Small linear models of
one entity are numpy fits within a grouped map.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.catalog import Context, listed, operator
from tidewell.functions.scalars import micros
from tidewell.operators.anomaly import kde_density
from tidewell.operators.boosting import Boosting, fit_boosting, score_boosting
from tidewell.operators.registry import LifeCycle, ModelRegistry, estimate


def _names(features, predictions, suffix: str) -> list[str]:
    return listed(predictions) or [f"{f}_{suffix}" for f in listed(features)]


@operator("Standard_Scaler", inputs=("features",), outputs=("predictions",))
def standard_scaler(df, ctx, features, targets=None, predictions=None):
    """Per entity mean 0 and population standard deviation 1; constants become 0."""
    w = Window.partitionBy(ctx.entity)
    scaled = lambda c: F.when(F.col(c).isNotNull(), F.coalesce((F.col(c) - F.avg(c).over(w)) / F.nullif(F.stddev_pop(c).over(w), F.lit(0.0)), F.lit(0.0)))
    return df.withColumns({n: scaled(c) for c, n in zip(listed(features), _names(features, predictions, "scaled"))})


@operator("MinMax_Scaler", inputs=("features",), outputs=("predictions",))
def minmax_scaler(df, ctx, features, targets=None, predictions=None):
    w = Window.partitionBy(ctx.entity)
    scaled = lambda c: F.when(F.col(c).isNotNull(), F.coalesce((F.col(c) - F.min(c).over(w)) / F.nullif(F.max(c).over(w) - F.min(c).over(w), F.lit(0.0)), F.lit(0.0)))
    return df.withColumns({n: scaled(c) for c, n in zip(listed(features), _names(features, predictions, "scaled"))})


@operator("Robust_Scaler", inputs=("features",), outputs=("predictions",))
def robust_scaler(df, ctx, features, targets=None, predictions=None):
    """Per entity distance from the median in interquartile ranges."""
    items = listed(features)
    stats = df.groupBy(ctx.entity).agg(*(F.percentile(c, [0.25, 0.5, 0.75]).alias(f"_q_{c}") for c in items))
    out = df.join(stats, ctx.entity, "left")
    scaled = lambda c: F.when(F.col(c).isNotNull(), F.coalesce((F.col(c) - F.col(f"_q_{c}")[1]) / F.nullif(F.col(f"_q_{c}")[2] - F.col(f"_q_{c}")[0], F.lit(0.0)), F.lit(0.0)))
    return out.withColumns({n: scaled(c) for c, n in zip(items, _names(features, predictions, "scaled"))}).drop(*(f"_q_{c}" for c in items))


# numpy models of one entity


@dataclass
class BayesRidge:
    """Bayesian ridge regression; noise and weight precision by evidence maximisation."""

    mean: np.ndarray
    spread: np.ndarray
    offset: float
    weights: np.ndarray
    covariance: np.ndarray
    noise: float

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, rounds: int = 300) -> BayesRidge:
        mean, spread = x.mean(axis=0), x.std(axis=0)
        spread[spread == 0] = 1.0
        z, offset = (x - mean) / spread, float(y.mean())
        n, (u, s, vt) = len(y), np.linalg.svd(z, full_matrices=False)
        alpha, lam, r = 1.0 / max(y.var(), 1e-12), 1.0, u.T @ (y - offset)
        w = np.zeros(z.shape[1])
        for _ in range(rounds):
            new = vt.T @ (s / (s**2 + lam / alpha) * r)
            gamma = float((alpha * s**2 / (lam + alpha * s**2)).sum())
            lam = (gamma + 2e-6) / ((new**2).sum() + 2e-6)
            alpha = (n - gamma + 2e-6) / (((y - offset - z @ new) ** 2).sum() + 2e-6)
            if np.abs(new - w).sum() < 1e-6:
                w = new
                break
            w = new
        covariance = np.linalg.inv(alpha * z.T @ z + lam * np.eye(z.shape[1]))
        return cls(mean, spread, offset, w, covariance, 1.0 / alpha)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = (x - self.mean) / self.spread
        return z @ self.weights + self.offset, np.sqrt(np.einsum("ij,jk,ik->i", z, self.covariance, z) + self.noise)


def polynomial(x: np.ndarray, degree: int) -> np.ndarray:
    """All products of columns up to ``degree``."""
    columns, last = [x], [(x[:, j], j) for j in range(x.shape[1])]
    for _ in range(degree - 1):
        last = [(c * x[:, k], k) for c, j in last for k in range(j, x.shape[1])]
        columns.append(np.column_stack([c for c, _ in last]))
    return np.column_stack(columns)


def per_entity(df: DataFrame, ctx, features: list[str], targets: list[str], outputs: list[str], run) -> DataFrame:
    """``run(x, y) -> arrays of outputs`` on each entity's rows in time order, joined back by key.

    Null features count as 0; rows with a null target are predicted, not learned from.
    """
    rows = df.select(F.col(ctx.entity).alias("_e"), F.col(ctx.timestamp).alias("_t"), *(F.col(c).cast("double").alias(f"_f{i}") for i, c in enumerate([*features, *targets])))
    n, names = len(features), [f"_f{i}" for i in range(len(features) + len(targets))]

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_t", kind="stable").drop_duplicates("_t")
        x, y = pdf[names[:n]].fillna(0.0).to_numpy(float), pdf[names[n:]].to_numpy(float)
        out = pdf[["_e", "_t"]].copy()
        for name, values in zip(outputs, run(x, y)):
            out[name] = values
        return out

    schema = f"_e {rows.schema['_e'].dataType.simpleString()}, _t {rows.schema['_t'].dataType.simpleString()}, " + ", ".join(f"`{o}` double" for o in outputs)
    found = rows.groupBy("_e").applyInPandas(group, schema)
    return df.join(found, (F.col(ctx.entity) == F.col("_e")) & (F.col(ctx.timestamp) == F.col("_t")), "left").drop("_e", "_t")


def _bayes(degree: int):
    def run(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        x = polynomial(x, degree)
        means, spreads = [], []
        for j in range(y.shape[1]):
            known = np.isfinite(y[:, j])
            if known.sum() < 3:
                means.append(np.full(len(x), np.nan))
                spreads.append(np.full(len(x), np.nan))
                continue
            m, s = BayesRidge.fit(x[known], y[known, j]).predict(x)
            means.append(m)
            spreads.append(s)
        return means + spreads

    return run


@operator("BayesRidgeRegressor", inputs=("features", "targets"), outputs=("predictions", "deviations"))
def bayes_ridge(df, ctx, features, targets, predictions=None, deviations=None, degree=1):
    names = _names(targets, predictions, "predicted"), _names(targets, deviations, "deviation")
    return per_entity(df, ctx, listed(features), listed(targets), [*names[0], *names[1]], _bayes(degree))


operator("BayesRidgeRegressorExt", inputs=("features", "targets"), outputs=("predictions", "deviations"))(lambda df, ctx, features, targets, predictions=None, deviations=None, degree=3: bayes_ridge(df, ctx, features, targets, predictions, deviations, degree))


@operator("KDEAnomalyScore", inputs=("features", "targets"), outputs=("predictions",))
def kde_score(df, ctx, features, targets, threshold=0.01, predictions=None):
    """Density of each row's (features, targets) among its entity's, and whether it is under the threshold."""
    names = _names(targets, predictions, "density")[:1]

    def run(x, y):
        points = np.column_stack((x, np.nan_to_num(y)))
        return [kde_density(points, points) if len(points) > points.shape[1] + 1 else np.full(len(points), np.nan)]

    return per_entity(df, ctx, listed(features), listed(targets), names, run)


def auto_regression(x: np.ndarray, order: int = 3, ahead: int = 0) -> np.ndarray:
    """One-step predictions by least squares on the ``order`` values before; the first rows as they are.

    ``ahead`` more values follow, each predicted from those before it.
    """
    if len(x) <= 2 * order + 1:
        return np.concatenate((x, np.full(ahead, x[-1] if len(x) else np.nan)))
    past = np.column_stack([np.ones(len(x) - order), *(x[order - k - 1 : len(x) - k - 1] for k in range(order))])
    beta, *_ = np.linalg.lstsq(past, x[order:], rcond=None)
    known = list(x)
    for _ in range(ahead):
        known.append(float(beta[0] + beta[1:] @ known[: -order - 1 : -1]))
    return np.concatenate((x[:order], past @ beta, known[len(x) :]))


@operator("ARIMAForecaster", inputs=("input_item",), outputs=("output_item",))
def autoregressive_forecast(df, ctx, input_item, output_item, n_forecast=1, order=3):
    """The item moved back by ``n_forecast`` rows, and on the last rows its forecast: each row has the value that many rows on."""

    def run(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        n = min(n_forecast, len(x))
        return [np.concatenate((x[n:, 0], auto_regression(x[:, 0], order, n)[len(x) :]))]

    return per_entity(df, ctx, [input_item], [], [output_item], run)


# estimators over all entities


@dataclass
class Model:
    """A fitted pipeline with its scores and its shelf life."""

    name: str
    pipeline: PipelineModel
    features: list[str]
    target: str
    metric: str
    score: float
    fitted: datetime = field(default_factory=datetime.now)
    shelf_life_days: float | None = None

    @property
    def expired(self) -> bool:
        return self.shelf_life_days is not None and datetime.now() > self.fitted + timedelta(days=self.shelf_life_days)

    def predict(self, df: DataFrame, name: str) -> DataFrame:
        out = self.pipeline.transform(df.fillna(0.0, self.features)).withColumnRenamed("prediction", name)
        return out.select(*df.columns, name)

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(path)


def _assembled(features: list[str], stage) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="keep"), stage])


#: Candidates by name, made for a target, the number of features and, for classifiers, of classes.
REGRESSORS = {
    "gbt": lambda target, width, classes: GBTRegressor(featuresCol="_features", labelCol=target, seed=1),
    "linear": lambda target, width, classes: LinearRegression(featuresCol="_features", labelCol=target),
}
CLASSIFIERS = {
    "forest": lambda target, width, classes: RandomForestClassifier(featuresCol="_features", labelCol=target, seed=1),
    "perceptron": lambda target, width, classes: MultilayerPerceptronClassifier(featuresCol="_features", labelCol=target, layers=[width, 50, classes], seed=1),
    "logistic": lambda target, width, classes: LogisticRegression(featuresCol="_features", labelCol=target),
}


def correlated_features(df: DataFrame, features: list[str], target: str, least: float = 0.0) -> list[str]:
    """Features whose absolute correlation with the target reaches ``least``, in one pass."""
    if least <= 0:
        return features
    row = df.agg(*(F.corr(f, target).alias(f) for f in features)).first()
    return [f for f in features if row[f] is not None and abs(row[f]) >= least] or features


def fit(df: DataFrame, features: list[str], target: str, kind: str = "regressor", candidates: list[str] | None = None, metric: str | None = None, least_correlation: float = 0.0, grid: dict | None = None, **options) -> Model:
    """The best candidate on a fifth of the rows that is held back, by a fixed seed; options go to candidates that have them."""
    table = REGRESSORS if kind == "regressor" else CLASSIFIERS
    metric = metric or ("r2" if kind == "regressor" else "f1")
    rows = df.where(F.col(target).isNotNull()).select(*features, F.col(target).cast("double").alias(target)).fillna(0.0, features)
    used = correlated_features(rows, features, target, least_correlation)
    evaluator = (RegressionEvaluator if kind == "regressor" else MulticlassClassificationEvaluator)(labelCol=target, metricName=metric)
    rows, best = rows.persist(), None
    try:
        classes = 0 if kind == "regressor" else int(rows.agg(F.max(target)).first()[0] or 0) + 1
        for name in candidates or list(table):
            stage = table[name](target, len(used), max(2, classes))
            for p, value in options.items():
                if stage.hasParam(p):
                    stage.set(stage.getParam(p), value)
            builder = ParamGridBuilder()
            for p, values in (grid or {}).items():
                if stage.hasParam(p):
                    builder = builder.addGrid(stage.getParam(p), values)
            found = TrainValidationSplit(estimator=_assembled(used, stage), estimatorParamMaps=builder.build(), evaluator=evaluator, trainRatio=0.8, seed=1).fit(rows)
            score = max(found.validationMetrics)
            if best is None or score > best.score:
                best = Model(name, found.bestModel, used, target, metric, score)
    finally:
        rows.unpersist()
    return best


def _estimator(name: str, kind: str, candidates: list[str]) -> None:
    """An estimator with one model over all entities."""

    @operator(name, inputs=("features", "targets"), outputs=("predictions",))
    def run(df, ctx, features, targets, predictions=None, n_estimators=20, max_depth=None, least_correlation=0.0):
        options = {"maxIter": n_estimators, "numTrees": n_estimators} | ({} if max_depth is None else {"maxDepth": max_depth})
        out = df
        for target, prediction in zip(listed(targets), _names(targets, predictions, "predicted")):
            out = fit(df, listed(features), target, kind, candidates, least_correlation=least_correlation, **options).predict(out, prediction)
        return out


_estimator("BaseRegressor", "regressor", ["gbt", "linear"])
_estimator("AutoRegScore", "regressor", ["linear"])
_estimator("BaseClassifier", "classifier", ["forest", "perceptron"])
_estimator("SimpleClassifier", "classifier", ["forest"])
_estimator("SimpleBinaryClassifier", "classifier", ["forest"])


# boosted trees by entity


def _numbers(features: list[str]) -> Column:
    """Features as an array; null and NaN count as 0."""
    return F.array(*(F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in features))


def _lagged(ctx: Context, features: list[str], lags: list[int]) -> Column:
    """Each feature's values so many rows before, as an array; null and NaN are null."""
    order = Window.partitionBy(ctx.entity).orderBy(ctx.timestamp)
    value = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    return F.array(*(F.lag(value(c), lag).over(order) if lag else value(c) for c in features for lag in lags))


def boosted(df: DataFrame, ctx: Context, names: list[str], targets: list[str], predictions: list[str], learn: Column, use: Column, options: Boosting, registry=None, life: LifeCycle | None = None, name: str = "boosting") -> DataFrame:
    """``df`` with a prediction for each target by its entity's trees, learned from ``learn`` and applied to ``use``.

    Both are arrays; rows where one holds a null are not learned from or get null.
    With a ``registry`` (or its path) models are kept by its life cycle; without one
    they are learned from all rows of this run.
    """
    whole = lambda c: ~F.exists(c, lambda v: v.isNull())
    out = df.drop(*predictions)
    for target, prediction in zip(targets, predictions):
        y = F.nanvl(F.col(target).cast("double"), F.lit(None).cast("double"))
        both = out.withColumns({"_e": F.col(ctx.entity).cast("string"), "_lx": learn, "_x": use})
        known = both.where(F.col("_e").isNotNull() & whole("_lx") & y.isNotNull()).select("_e", F.col(ctx.timestamp).alias("_t"), F.col("_lx").alias("_x"), y.alias("_y"))
        ready = both.drop("_lx").withColumn("_ok", whole("_x")).withColumn("_x", F.transform("_x", lambda v: F.coalesce(v, F.lit(0.0))))
        if registry is None:
            scored = score_boosting(ready, fit_boosting(known, options), prediction)
        else:
            models = ModelRegistry(df.sparkSession, registry) if isinstance(registry, str) else registry
            scored = estimate(ready, known, models, name, target, names, lambda rows: fit_boosting(rows, options), score_boosting, life or LifeCycle(), ctx.launch or datetime.now(), prediction)
        out = scored.withColumn(prediction, F.when(F.col("_ok"), F.col(prediction))).drop("_ok", "_e")
    return out


def _boosting(n_estimators: int, learning_rate: float, max_depth: int | None, least_rows: int) -> Boosting:
    return Boosting(n_estimators, max_depth if max_depth and max_depth > 0 else 5, learning_rate, least_rows=least_rows)


@operator("GBMRegressor", inputs=("features", "targets"), outputs=("predictions",))
def gbm_regressor(df, ctx, features, targets, predictions=None, n_estimators=20, learning_rate=0.2, max_depth=-1, lags=None, least_rows=20, registry=None, life=None):
    """Boosted trees over the features, or with ``lags`` over their values so many rows before.

    With lags the least of them is how far the prediction looks: a row gets the value
    of the target that many rows on.
    """
    used, names = listed(features), _names(targets, predictions, "predicted")
    options, life = _boosting(n_estimators, learning_rate, max_depth, least_rows), life or LifeCycle(stop_improving_at=-2.0, least_correlation=0.0)
    if not lags:
        return boosted(df, ctx, used, listed(targets), names, _numbers(used), _numbers(used), options, registry, life, "GBMRegressor")
    columns = [f"{c}_{lag}" for c in used for lag in lags]
    learn, use = _lagged(ctx, used, lags), _lagged(ctx, used, [lag - min(lags) for lag in lags])
    return boosted(df, ctx, columns, listed(targets), names, learn, use, options, registry, life, "GBMRegressor")


def with_future(df: DataFrame, ctx: Context, steps: int, flag: str) -> DataFrame:
    """``df`` and, for each entity with two times or more, ``steps`` rows after its last one, as far apart as its rows mostly are."""
    order = Window.partitionBy("_e").orderBy("_t")
    times = df.select(F.col(ctx.entity).alias("_e"), F.col(ctx.timestamp).cast("timestamp_ntz").alias("_t")).where("_e is not null and _t is not null").distinct()
    gaps = times.withColumn("_g", micros(F.col("_t")) - micros(F.lag("_t").over(order)))
    usual = gaps.groupBy("_e").agg(F.max("_t").alias("_last"), F.percentile_approx("_g", 0.5, 10_000).alias("_gap")).where("_gap is not null")
    ahead = usual.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    at = F.expr("timestampadd(MICROSECOND, _gap * _k, _last)").cast(df.schema[ctx.timestamp].dataType)
    future = ahead.select(F.col("_e").alias(ctx.entity), at.alias(ctx.timestamp), F.lit(True).alias(flag))
    return df.withColumn(flag, F.lit(False)).unionByName(future, allowMissingColumns=True)


@operator("GBMForecaster", inputs=("features", "targets"), outputs=("predictions",), kind="source")
def gbm_forecaster(df, ctx, features, targets, predictions=None, lags=None, n_estimators=20, learning_rate=0.2, max_depth=-1, least_rows=20, registry=None, life=None):
    """Direct forecasts: the frame and, after each entity's last row, as many rows as the least lag.

    The target is learned from the features ``lags`` rows before, so all that a new
    row needs is known.  Rows without all their lags get null.
    """
    lags, used, names = list(lags or [1]), listed(features), _names(targets, predictions, "predicted")
    if min(lags) < 1:
        raise ValueError("lags are 1 or more")
    longer = with_future(df, ctx, min(lags), "_future").drop("_future")
    options, life = _boosting(n_estimators, learning_rate, max_depth, least_rows), life or LifeCycle(stop_improving_at=-2.0, least_correlation=0.0)
    past = _lagged(ctx, used, lags)
    return boosted(longer, ctx, [f"{c}_{lag}" for c in used for lag in lags], listed(targets), names, past, past, options, registry, life, "GBMForecaster")


@operator("SimpleRegressor", inputs=("features", "targets"), outputs=("predictions",))
def simple_regressor(df, ctx, features, targets, predictions=None, n_estimators=20, learning_rate=0.1, max_depth=3, least_rows=5, registry=None, life=None):
    used = listed(features)
    return boosted(df, ctx, used, listed(targets), _names(targets, predictions, "predicted"), _numbers(used), _numbers(used), _boosting(n_estimators, learning_rate, max_depth, least_rows), registry, life or LifeCycle(least_correlation=0.0), "SimpleRegressor")


@operator("SimpleAnomaly", inputs=("features", "targets"), outputs=("predictions", "alerts"))
def simple_anomaly(df, ctx, features, targets, threshold, predictions=None, alerts=None, n_estimators=20, learning_rate=0.1, max_depth=3, least_rows=5, registry=None, life=None):
    """An alert where an entity's own regression is off by more than the threshold."""
    names = _names(targets, predictions, "predicted")
    out = simple_regressor(df, ctx, features, targets, names, n_estimators, learning_rate, max_depth, least_rows, registry, life)
    flags = _names(targets, alerts, "alert")
    return out.withColumns({a: F.when(F.abs(F.col(t) - F.col(p)) > threshold, F.lit(True)) for t, p, a in zip(listed(targets), names, flags)})


def index_labels(df: DataFrame, column: str, name: str):
    """Texts as class numbers, most frequent first."""
    return StringIndexer(inputCol=column, outputCol=name, handleInvalid="keep").fit(df).transform(df)


def score_with(df: DataFrame, inputs: list[str], schema: str, call) -> DataFrame:
    """``call(frame of inputs) -> frame`` on batches: a model served elsewhere, one request a batch."""

    def run(batches):
        for pdf in batches:
            yield pd.concat((pdf.reset_index(drop=True), call(pdf[inputs]).reset_index(drop=True)), axis=1)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(run, f"{fields}, {schema}")


operator("InvokeServedModel", inputs=("input_items",), outputs=("output_items",))(lambda df, ctx, input_items, output_items, call: score_with(df, listed(input_items), ", ".join(f"`{o}` double" for o in listed(output_items)), call))
operator("InvokeServedClassifier", inputs=("input_items",), outputs=("output_items", "confidence"))(lambda df, ctx, input_items, output_items, confidence, call: score_with(df, listed(input_items), ", ".join([*(f"`{o}` string" for o in listed(output_items)), f"`{confidence}` double"]), call))
