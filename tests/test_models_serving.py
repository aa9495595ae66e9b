"""Models and serving queries on small panels."""

import random

import pytest
from pyspark.sql import functions as F

from panelwatch import constants as C
from panelwatch.operators import graph, models, quality
from panelwatch.plans import serving

PRED = ("county string, year int, month int, monthly_cases double, predicted_cases double, gpot double, erisk double, "
        "risk_score double, predicted_risk string")


def training(spark, places=4, steps=40):
    rng = random.Random(2)
    rows = []
    for p in range(places):
        for t in range(steps):
            x, z = rng.random(), rng.random()
            rows.append((f"p{p}", t, x, z, 10 * x + 3 * z + rng.gauss(0, 0.1)))
    return spark.createDataFrame(rows, "county string, t int, x double, z double, monthly_cases double")


@pytest.mark.parametrize("folds", [None, 2])
def test_leave_out_predicts_every_row_and_beats_the_mean(spark, folds):
    df = training(spark).cache()
    out = models.leave_out_predict(df, models.forest(trees=8, depth=5), features=["x", "z"], folds=folds).collect()
    assert len(out) == 160 and len({(r.county, r.t) for r in out}) == 160
    mean = sum(r.monthly_cases for r in out) / len(out)
    mae = sum(abs(r.monthly_cases - r.predicted_cases) for r in out) / len(out)
    assert mae < 0.5 * sum(abs(r.monthly_cases - mean) for r in out) / len(out)


def test_held_out_entity_is_never_trained_on(spark):
    # the odd place has targets far off; a model that saw it would reproduce them
    df = training(spark, 3).withColumn("monthly_cases", F.when(F.col("county") == "p0", F.lit(1e6)).otherwise(F.col("monthly_cases")))
    out = models.leave_out_predict(df.cache(), models.forest(trees=5, depth=4), features=["x", "z"]).filter("county = 'p0'")
    assert out.agg(F.max("predicted_cases")).first()[0] < 100


def test_importance_ranks_the_driver_first(spark):
    rows = models.feature_importance(training(spark), models.forest(trees=10, depth=4), ["x", "z"]).collect()
    assert rows[0].feature == "x" and sum(r.importance for r in rows) == pytest.approx(1.0)


def test_graph_forecast_covers_the_test_steps(spark):
    edges = spark.createDataFrame([("p0", "p1"), ("p1", "p2"), ("p2", "p3")], "src string, dst string")
    out = models.graph_forecast(training(spark), graph.normalized_adjacency(edges), ["x", "z"]).collect()
    steps = 40 - 6
    assert len(out) == 4 * (steps - int(0.8 * steps)) and min(r.test_sample for r in out) == 0
    assert all(r.residual == pytest.approx(r.actual_cases - r.predicted_cases) for r in out)


def predictions(spark):
    rows = [("Kern", 2024, m, float(m), float(m) + 1, 0.5, 0.5, 25.0, "Very High") for m in range(1, 13)]
    rows += [("Kings", 2023, m, 0.0, 1.25, None, None, None, "Low") for m in range(1, 9)]
    return spark.createDataFrame(rows, PRED)


def test_forecast_future_rows_or_last_six(spark):
    cases = spark.createDataFrame([("Kern", 0, 1.0, 2.0, -1.0, 3.0, "Low")],
                                  "county string, test_sample int, actual_cases double, predicted_cases double, residual double, risk_score double, predicted_risk string")
    out = serving.forecast(predictions(spark), cases, 2024, 11).collect()
    first = [r for r in out if r.model == "random_forest"]
    assert sorted((r.county, r.month) for r in first) == [("Kern", 11), ("Kern", 12)] + [("Kings", m) for m in range(3, 9)]
    second, = [r for r in out if r.model == "graph_temporal"]
    assert second.score_method == "case_percentile" and second.test_sample == 0


def test_latest_and_history(spark):
    meta = spark.createDataFrame([(c, f, la, lo) for c, f, la, lo in C.COUNTY_META], "county string, fips string, lat double, lon double")
    latest = {r.county: r for r in serving.latest_risk(predictions(spark), meta).collect()}
    assert latest["Kern"].month == 12 and latest["Kern"].fips == "06029"
    assert latest["Kings"].risk_score == 1.0 and latest["Kings"].predicted_cases == 1.3  # tier number where no score is stored
    assert serving.risk_history(predictions(spark), "Kern", 2024, 2024).count() == 12


def test_summary_rules(spark):
    df = spark.createDataFrame([
        ("a", "Very High", 25.4, 51.0, 36.0, 0.0), ("b", "Low", 0.0, 0.0, 0.0, 3.0), ("c", None, 9.0, 19.0, 26.0, 6.0), ("d", "High", None, None, None, None),
    ], "county string, risk_level string, wind_speed_kmh double, pm10_ugm3 double, temperature_c double, precipitation_mm double")
    got = {r.county: r for r in serving.risk_summary(df).collect()}
    t = C.SUMMARY_TEXTS
    assert got["a"].summary == [t["wind_high"] % 25.4, t["pm10_high"] % 51, t["temp_extreme"] % 36, t["dry"], t["tier_very_high"]]
    assert got["b"].summary == [t["default"]] and got["b"].advice == C.ADVICE_TEXTS["other"]
    assert got["c"].summary == [t["wind_low"] % 9, t["pm10_low"] % 19, t["temp_warm"] % 26, t["rain"]]
    assert got["d"].summary == [t["tier_high"]] and got["d"].advice == C.ADVICE_TEXTS["High"]


def test_chart_series_cut(spark):
    rows = predictions(spark).withColumn("risk_score", F.coalesce("risk_score", F.lit(1.0)))
    got = serving.chart_series(rows)
    assert {(r.county, r.cut_label) for r in got.select("county", "cut_label").distinct().collect()} == {("Kern", "Dec'24"), ("Kings", None)}
    assert got.filter("county = 'Kings' AND actual IS NOT NULL").count() == 0
    assert serving.chart_series(predictions(spark)).filter("county = 'Kings'").count() == 0


def test_insight_sentences(spark):
    rows = predictions(spark).filter("county = 'Kern'")
    text, = [r.insights for r in serving.insights(rows).collect()]
    assert text[0] == C.INSIGHT_TEXTS["peak"] % ("Kern", "Dec")
    assert text[2] == C.INSIGHT_TEXTS["trend"] % (2022, "nan", 2024, "7", "similar level")


def test_checks_report_missing_rows_and_scale(spark):
    df = spark.sql("SELECT 'Kern' county, date'2024-01-01' date, 10L case_count, 0.5D G_pot, 0.5D E_risk, 25D risk_score")
    assert quality.score_identity(df).first().ok and not quality.score_identity(df.withColumn("risk_score", F.lit(0.25))).first().ok
    missing = quality.dominant_floor(df, "Kern", 2023, 1).first()
    assert not missing.ok and missing.detail == "missing"
    present = {r.check: r.ok for r in quality.cases_present(df).collect()}
    assert present == {"cases_present:Kern:2023": False, "cases_present:Kern:2024": True}
    flag = quality.passed(quality.validate(df, 1, (2024,), ("Kern", 2024, 10), ["case_count"])).first()
    assert flag.passed and flag.issues == 0


def test_repeated_index_rows_take_one_match(spark):
    from panelwatch.plans.serving import index_rows

    rows = [("a", 2001, 1, 5.0, 0.2, None), ("a", 2001, 1, 3.0, 0.9, 0.1), ("a", 2001, 1, 5.0, 0.2, None), ("a", 2001, 2, None, None, None)]
    schema = "county string, year int, month int, risk_score double, gpot double, erisk double"
    for order in (rows, rows[::-1]):
        got = sorted(tuple(r) for r in index_rows(spark.createDataFrame(order, schema)).collect())
        assert got == [("a", 2001, 1, 3.0, 0.9, 0.1), ("a", 2001, 2, None, None, None)]
