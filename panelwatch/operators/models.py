"""Forecast models on Spark ML: leave-one-place-out evaluation and a neighbour-aware forecaster."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwatch import constants as C

#: Training rows that one task of a fit takes.
ROWS_PER_TASK = 50_000


def assemble(df: DataFrame, features=C.MODEL_FEATURES) -> DataFrame:
    """Feature vector column ``raw_features``."""
    return VectorAssembler(inputCols=list(features), outputCol="raw_features").transform(df)


def standardize(train: DataFrame, df: DataFrame | None = None, features=C.MODEL_FEATURES) -> DataFrame:
    """``features`` vector centred and scaled by the deviation of ``train`` only."""
    scaler = StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True)
    model = scaler.fit(assemble(train, features))
    return model.transform(assemble(train if df is None else df, features))


def standardized_columns(df: DataFrame, features=C.MODEL_FEATURES) -> DataFrame:
    """The standardised features as columns again."""
    out = standardize(df, features=features).withColumn("_a", vector_to_array("features"))
    return out.withColumns({f"std_{c}": F.col("_a")[i] for i, c in enumerate(features)}).drop(
        "_a", "features", "raw_features"
    )


def forest(trees: int = 200, depth: int = 10, seed: int = 42, label: str = "monthly_cases") -> RandomForestRegressor:
    return RandomForestRegressor(
        featuresCol="features", labelCol=label, predictionCol="predicted_cases", numTrees=trees, maxDepth=depth,
        minInstancesPerNode=3, featureSubsetStrategy="all", seed=seed,
    )


def boosting(rounds: int = 200, depth: int = 5, rate: float = 0.05, seed: int = 42,
             label: str = "monthly_cases") -> GBTRegressor:
    return GBTRegressor(
        featuresCol="features", labelCol=label, predictionCol="predicted_cases", maxIter=rounds, maxDepth=depth,
        stepSize=rate, seed=seed,
    )


def fold_of(key: str, folds: int) -> Column:
    """Stable fold number of an entity; all its rows share it."""
    return F.pmod(F.xxhash64(key), F.lit(folds)).cast("int")


def leave_out_predict(df: DataFrame, estimator, key: str = "county", features=C.MODEL_FEATURES,
                      folds: int | None = None, parallel: int = 4) -> DataFrame:
    """Prediction for every row by a model that never saw the row's entity.

    Without ``folds`` every entity is left out by itself, however many there are:
    one fit an entity. With ``folds`` entities share that many folds, always.
    The scaler is part of each fit, and ``parallel`` fits run at a time. Every
    fit writes its predictions, so the result is one table however many entities
    there are. ``df`` is held in memory (or on disk) while the fits run, in tasks of
    about ``ROWS_PER_TASK`` rows, because every round of a fit is a job of its own.
    """
    from panelwatch.session import scratch_path

    if folds is None:
        entities = [r[0] for r in df.select(key).distinct().collect()]
        tests = [F.col(key).eqNullSafe(F.lit(e)) for e in sorted(entities, key=str)]
    else:
        used = [r[0] for r in df.select(fold_of(key, folds).alias("fold")).distinct().collect()]
        tests = [fold_of(key, folds) == i for i in sorted(used)]
    if len(tests) < 2:
        raise ValueError("leaving one out needs at least two entities")

    path = scratch_path(df.sparkSession, "leave-out")
    df = df.coalesce(max(1, -(-df.count() // ROWS_PER_TASK))).persist(StorageLevel.MEMORY_AND_DISK)

    def one_fold(numbered: tuple[int, Column]) -> None:
        number, held_out = numbered
        pipeline = Pipeline(stages=[
            VectorAssembler(inputCols=list(features), outputCol="raw_features"),
            StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True),
            estimator,
        ])
        model = pipeline.fit(df.filter(~held_out))
        out = model.transform(df.filter(held_out)).drop("raw_features", "features")
        out.write.parquet(f"{path}/fold={number}")

    with ThreadPool(min(parallel, len(tests))) as pool:
        pool.map(inheritable_thread_target(df.sparkSession)(one_fold), list(enumerate(tests)))
    df.unpersist()
    return df.sparkSession.read.parquet(path).drop("fold")


def leave_out_report(predictions: DataFrame, key: str = "county", actual: str = "monthly_cases",
                     predicted: str = "predicted_cases") -> DataFrame:
    """One row: rows, entities, RMSE, MAE and R² of held-out predictions, the RMSE and MAE of the same test with the
    mean of the other entities as prediction, and whether the model's errors are below those.

    The mean of the others comes from one sum and count per entity.
    """
    from panelwatch.session import one_row

    per = predictions.groupBy(key).agg(F.sum(actual).alias("_s"), F.count(actual).alias("_n"))
    whole = one_row(per.agg(F.sum("_s").alias("total"), F.sum("_n").alias("rows")))
    others = F.nullif(F.lit(whole["rows"]) - F.col("_n"), F.lit(0))
    rest = per.select(key, ((F.lit(whole["total"]) - F.col("_s")) / others).alias("_mean"))
    e, m = F.col(actual) - F.col(predicted), F.col(actual) - F.col("_mean")
    spread = F.var_pop(actual) * F.count(e)
    return predictions.join(rest, key).agg(
        F.count(e).alias("n"), F.count_distinct(key).alias("entities"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"), F.when(spread > 0, 1 - F.sum(e * e) / spread).alias("r2"),
        F.sqrt(F.avg(m * m)).alias("mean_rmse"), F.avg(F.abs(m)).alias("mean_mae"),
    ).withColumn("better_than_mean", (F.col("rmse") < F.col("mean_rmse")) & (F.col("mae") < F.col("mean_mae")))


def feature_importance(df: DataFrame, estimator, features=C.MODEL_FEATURES, top: int = 10) -> DataFrame:
    """Fit on all rows and list the ``top`` features by importance."""
    model = estimator.fit(standardize(df, features=features))
    rows = [(name, float(v)) for name, v in zip(features, model.featureImportances.toArray())]
    ranked = df.sparkSession.createDataFrame(rows, "feature string, importance double")
    return ranked.orderBy(F.desc("importance"), "feature").limit(top)


def with_residual(df: DataFrame, actual: str = "monthly_cases", predicted: str = "predicted_cases") -> DataFrame:
    return df.withColumn("residual", F.col(actual) - F.col(predicted))


def normalize_target(df: DataFrame, target: str, reference: DataFrame | None = None) -> DataFrame:
    """``target_norm`` by global mean and population deviation, kept beside it for the way back."""
    from panelwatch.operators.index import Stats

    stats = Stats(df if reference is None else reference, [target])
    return df.withColumn("y_mean", stats(target, "mean")).withColumn("y_std", stats(target, "std_pop")).withColumn(
        "target_norm", F.when(F.col("y_std") > 0, (F.col(target) - F.col("y_mean")) / F.col("y_std"))
    )


def denormalize(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.withColumn(name, F.col(column) * F.col("y_std") + F.col("y_mean"))


def graph_forecast(panel: DataFrame, weights: DataFrame, features: list[str], target: str = "monthly_cases",
                   key: str = "county", t: str = "t", window: int = 6, share: float = 0.8,
                   estimator=None) -> DataFrame:
    """Next-step forecast from the last ``window`` steps of a node and of its neighbours.

    Own and neighbour features are both used, so nodes with equal neighbour
    lists still differ. Scaling and target statistics come from the training
    steps only. Returns the test rows with actual, predicted and residual.
    """
    from panelwatch.operators.graph import neighbor_features
    from panelwatch.operators.panel import sliding_windows, temporal_split
    from panelwatch.session import materialize

    near = neighbor_features(weights, panel, features, key, t)
    wide = panel.select(key, t, target, *features).join(near, [key, t], "left").na.fill(0.0)
    used = [*features, *[f"nb_{c}" for c in features]]
    windows = temporal_split(
        materialize(sliding_windows(wide, used, target, window, (key,), (t,)), "windows"), share, t
    )
    flat = [f"{c}_{i}" for i in range(window) for c in used]
    rows = materialize(windows.select(
        key, t, "split", "test_sample", F.col("target").alias(target),
        *[F.col("window")[i][c].alias(f"{c}_{i}") for i in range(window) for c in used],
    ), "windows-split")
    train = rows.filter(F.col("split") == "train")
    ready = normalize_target(rows, target, reference=train)
    estimator = estimator or LinearRegression(
        featuresCol="features", labelCol="target_norm", predictionCol="pred_norm", regParam=0.1
    )
    pipeline = Pipeline(stages=[
        VectorAssembler(inputCols=flat, outputCol="raw_features"),
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True),
        estimator,
    ])
    model = pipeline.fit(ready.filter(F.col("split") == "train"))
    out = denormalize(model.transform(ready.filter(F.col("split") == "test")), "pred_norm", "predicted_cases")
    return out.select(
        key, "test_sample", F.col(target).alias("actual_cases"), "predicted_cases",
        (F.col(target) - F.col("predicted_cases")).alias("residual"),
    )


def forecast_chain(monthly: DataFrame, weights: DataFrame, features: list[str], last_year: int,
                   target: str = "monthly_cases", key: str = "county", window: int = 6, share: float = 0.8,
                   estimator=None) -> DataFrame:
    """The whole way from months to rated forecasts.

    Dense panel (missing cells 0), cut at the last month of ``last_year``, sliding
    windows with neighbour features, forecast of the last steps, and tier and score
    of each forecast by the place's own quartiles of the actual test values. One row
    per place and test step.
    """
    from panelwatch.operators.index import case_percentile_index
    from panelwatch.operators.panel import cut_at_last_valid, dense_panel
    from panelwatch.session import materialize

    dense = materialize(dense_panel(monthly, [*features, target], key), "dense")
    known = cut_at_last_valid(dense, last_year)
    rows = materialize(graph_forecast(known, weights, features, target, key, "t", window, share, estimator), "forecast")
    return case_percentile_index(rows, rows, key)
