"""Index variants, tiers, quantiles and metrics: golden rows and hand-computed values."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwatch import constants as C
from panelwatch.operators import index, quantiles, stats

# fixed values: month, actual, predicted, score and tier of one place's test months
GOLDEN = [
    (0, 27.0, 30.378610440907956, 1.84, "Low"),
    (1, 36.0, 37.05051350774066, 2.25, "Low"),
    (2, 45.0, 31.34247531634055, 1.9, "Low"),
    (3, 54.0, 34.99142123437284, 2.12, "Low"),
    (4, 63.00000000000001, 44.98092928585109, 2.73, "Low"),
    (5, 72.0, 54.93131883629577, 4.21, "Moderate"),
    (6, 108.0, 79.93931990328483, 9.37, "High"),
    (7, 126.00000000000001, 98.00372963416356, 12.49, "High"),
    (8, 135.0, 123.27046771405361, 15.96, "Very High"),
    (9, 117.0, 137.20371000296126, 17.2, "Very High"),
    (10, 81.0, 47.22936604108143, 2.86, "Low"),
]


def golden_frame(spark):
    return spark.createDataFrame([("Fresno", *row[:3]) for row in GOLDEN],
                                 "county string, test_sample int, actual_cases double, predicted_cases double")


def test_case_percentile_golden(spark):
    df = golden_frame(spark)
    got = {r.test_sample: (r.risk_score, r.predicted_risk) for r in index.case_percentile_index(df, df).collect()}
    assert got == {row[0]: (row[3], row[4]) for row in GOLDEN}


def test_metrics_match_numpy(spark):
    y, p = np.array([r[1] for r in GOLDEN]), np.array([r[2] for r in GOLDEN])
    row = stats.regression_metrics(golden_frame(spark)).first()
    assert row.rmse == pytest.approx(np.sqrt(np.mean((y - p) ** 2)))
    assert row.mae == pytest.approx(np.mean(np.abs(y - p)))
    assert row.r2 == pytest.approx(1 - np.sum((y - p) ** 2) / np.sum((y - y.mean()) ** 2))


def test_tier_bounds_belong_to_the_next_tier(spark):
    df = spark.createDataFrame([(2.999,), (3.0,), (7.999,), (8.0,), (15.0,), (None,)], "s double")
    assert [r[0] for r in df.select(index.tier(F.col("s"))).collect()] == [
        "Low", "Moderate", "Moderate", "High", "Very High", None]


def test_tiers_never_fall_as_the_score_grows(spark):
    rows = spark.range(0, 400).select((F.col("id") / 10).alias("s")).select(index.tier(F.col("s")).alias("t")).collect()
    order = [C.TIERS.index(r.t) for r in rows]
    assert order == sorted(order)


def test_index_fixed_by_hand(spark):
    df = spark.createDataFrame(
        [(0.24, 25.0, 100.0, 75.0, 0.03, 30.0, 45.0), (None,) * 7],
        "sm_lag6 double, tmax_lag6 double, precip_lag18 double, pm10_lag1 double, soil_moisture_m3m3 double, "
        "wind_speed_kmh double, tmax_approx_c double")
    full, empty = index.index_fixed(df).collect()
    g, e = 0.35 * 0.5 + 0.20 * 0.5 + 0.30 * 0.5, 0.25 * 0.5 + 0.15 * 1 + 0.05 * 0.5 + 0.20 * 1
    assert (full.gpot, full.erisk, full.risk_score) == (round(g, 4), round(e, 4), round(g * e * 100, 2))
    assert (empty.gpot, empty.erisk, empty.risk_level) == (0.425, 0.325, "High")


def test_index_daily_counts_missing_terms_as_zero(spark):
    cols = ["n_sm_lag6mo", "n_tmax_lag6mo", "n_precip_lag1p5y", "n_pm10_lag1mo", "n_soil_aridity", "n_wind_speed_kmh", "n_tmax_lag1mo"]
    df = spark.createDataFrame([(1.0,) * 7, (None,) * 7], ", ".join(f"{c} double" for c in cols))
    full, empty = index.index_daily(df).collect()
    assert full.risk_score == pytest.approx(0.85 * 0.65 * 100) and full.risk_color == "red"
    assert empty.risk_score == 0.0 and empty.risk_level == "Low"


def test_index_monthly_spans_zero_to_hundred_and_flat_ranges(spark):
    cols = index.INDEX_MONTHLY_INPUTS
    schema = ", ".join(f"{c} double" for c in cols)
    low = tuple(1.0 if c == "soil_moisture_m3m3" else 0.0 for c in cols)
    high = tuple(0.0 if c == "soil_moisture_m3m3" else 1.0 for c in cols)
    scores = [r.risk_score for r in index.index_monthly(spark.createDataFrame([low, high, (None,) * 7], schema)).collect()]
    assert scores == [0.0, 100.0, 25.0]
    flat = index.index_monthly(spark.createDataFrame([(0.5,) * 7], schema)).first()
    assert flat.gpot == 0.5 and flat.erisk == 0.5


def test_scaling_flat_and_empty_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (1.0, 4.0, None)], "a double, b double, c double")
    z = index.zscore(df, ["a", "b", "c"]).collect()
    n = index.minmax(df, ["a", "b", "c"]).collect()
    assert [r.z_a for r in z] == [0.0, 0.0] and [r.z_c for r in z] == [0.0, 0.0]
    assert sorted(r.z_b for r in z) == pytest.approx([-0.5 ** 0.5, 0.5 ** 0.5])
    assert sorted(r.n_b for r in n) == [0.0, 1.0] and [r.n_a for r in n] == [0.0, 0.0]


@pytest.mark.parametrize("few", [True, False])
def test_exact_quantiles_on_skewed_groups(spark, few):
    rng = random.Random(3)
    rows = [("hot", round(rng.expovariate(0.01), 3)) for _ in range(4000)] + [("hot", 5.0)] * 2000
    rows += [("cold", rng.gauss(0, 1)) for _ in range(37)] + [("one", 3.5), ("one", None)] + [("tail", 1e12), ("tail", 1.0), ("tail", 2.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = {(r.k, r.prob): r.value for r in quantiles.exact_quantiles(df, "v", probs, ["k"], buckets=16, max_rows=40, few_keys=few).collect()}
    for k in ("hot", "cold", "one", "tail"):
        values = [v for key, v in rows if key == k and v is not None]
        for p in probs:
            assert got[(k, p)] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-12)


def test_exact_quantiles_without_keys(spark):
    values = [float(i * i % 997) for i in range(1001)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for limit in (10, 100_000):
        row = quantiles.exact_quantiles(df, "v", [0.5], buckets=8, max_rows=limit).first()
        assert row.value == np.median(values)


def test_exact_quantiles_with_negative_and_far_values(spark):
    values = [-1e300, -5.0, -5.0, -0.25, 0.0, 1e-9, 2e-9, 7.0, 1e300] + [float(i) for i in range(-50, 50)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r.value for r in quantiles.exact_quantiles(df, "v", [0.1, 0.5, 0.75], buckets=4, max_rows=2).orderBy("prob").collect()]
    assert got == pytest.approx([np.quantile(values, p) for p in (0.1, 0.5, 0.75)])


def test_trend_falls_back_to_the_base_year(spark):
    df = spark.createDataFrame([("up", 2022, 1, 10.0), ("up", 2024, 1, 12.1), ("flat", 2022, 1, 10.0), ("flat", 2024, 1, 12.0),
                                ("absent", 2022, 1, 10.0)], "county string, year int, month int, monthly_cases double")
    got = {r.county: (r.year_mean, r.increase) for r in stats.trend(df).collect()}
    assert got == {"up": (12.1, True), "flat": (12.0, False), "absent": (10.0, False)}


def test_optional_columns_and_flags(spark):
    old = spark.createDataFrame([("High",), ("Odd",)], "predicted_risk string")
    assert [r[0] for r in old.select(index.legacy_score(old)).collect()] == [3.0, None]
    assert old.select(index.optional_column(old, "gpot")).first()[0] is None
    df = spark.createDataFrame([(15.0, 36.0, None, 0.0), (15.1, None, 35.0, None)],
                               "wind_speed_kmh double, pm10_ugm3 double, temperature_c double, precip_week_mm double")
    got = [(r.warn_wind, r.warn_pm10, r.warn_temp, r.warn_dry) for r in index.warn_flags(df).collect()]
    assert got == [(False, True, False, True), (True, False, False, False)]
    pop = spark.createDataFrame([(None,), (0,), (4000,), (50000,)], "p int")
    assert [r[0] for r in pop.select(index.zone_radius(F.col("p"))).collect()] == [5.0, 5.0, 6.0, 11.0]
