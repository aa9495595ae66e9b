"""Both flows end to end from CSV files over the fixed places."""

import datetime as dt
import math

import pandas as pd
import pytest

from panelwatch import constants as C
from panelwatch.operators import index, quality
from panelwatch.plans import pipeline, serving
from panelwatch.sources import places, readers, writers
from panelwatch.sources.schemas import AIR, WEATHER

DAYS = 800


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Weather with gaps for eight places, dust for seven of them."""
    weather, air = [], []
    for i, (county, *_) in enumerate(C.COUNTY_META):
        for d in range(DAYS):
            day = dt.date(2022, 11, 1) + dt.timedelta(days=d)
            wave = math.sin(d / 58 + i)
            weather.append((day, county, max(0.0, 3 * wave), None if d % 7 == i % 7 else 0.2 + 0.1 * wave,
                            None if d % 5 == 0 else 15 + 5 * wave, 25 - 12 * wave))
            if county != "Madera" and d % 3:
                air.append((day, county, 60 + 30 * wave + i))
    folder = tmp_path_factory.mktemp("csv")
    writers.write_csv(spark.createDataFrame(weather, WEATHER), str(folder / "weather"))
    writers.write_csv(spark.createDataFrame(air, AIR), str(folder / "air"))
    meta = spark.createDataFrame(C.COUNTY_META, "county string, fips string, lat double, lon double")
    return (readers.read_weather(spark, str(folder / "weather")), readers.read_air(spark, str(folder / "air")),
            places.known_cases(spark), meta)


def test_daily_flow_against_pandas(tables):
    master = pipeline.daily_master(*tables)
    scored = pipeline.daily_index(master).toPandas().sort_values(["county", "date"]).reset_index(drop=True)
    want = master.toPandas().sort_values(["county", "date"]).reset_index(drop=True)
    by = want.groupby("county")
    want["soil_moisture_m3m3"] = by.soil_moisture_m3m3.transform(lambda s: s.ffill().bfill())
    for c in ("wind_speed_kmh", "tmax_approx_c", "pm10_ugm3"):
        want[c] = by[c].transform(lambda s: s.interpolate(limit_direction="both"))
        want[c] = want[c].fillna(want[c].median())
    for new, c, n in C.DAILY_LAGS:
        want[new] = want.groupby("county")[c].shift(n)
    share = {c: (want[c] - want[c].min()) / (want[c].max() - want[c].min()) for c in C.SCALED_COLUMNS}
    term = {c: s.fillna(0) for c, s in share.items()}
    g = 0.35 * term["sm_lag6mo"] + 0.20 * term["tmax_lag6mo"] + 0.30 * term["precip_lag1p5y"]
    e = (0.25 * term["pm10_lag1mo"] + 0.15 * (1 - share["soil_moisture_m3m3"]).fillna(0) + 0.05 * term["wind_speed_kmh"]
         + 0.20 * term["tmax_lag1mo"])
    pd.testing.assert_series_equal(scored.risk_score, g * e * 100, check_names=False, rtol=1e-9, atol=1e-9)
    assert set(scored.fips) == {row[1] for row in C.COUNTY_META}
    assert set(scored.risk_level) >= {"Low", "Moderate"}


def test_daily_checks_pass(spark, tables):
    scored = pipeline.daily_index(pipeline.daily_master(*tables))
    report = quality.validate(scored)
    assert [r.check for r in report.filter("NOT ok").collect()] == []
    assert quality.passed(report).first().passed


def test_monthly_flow_and_serving(tables):
    months = pipeline.monthly_master(*tables)
    scored = pipeline.monthly_index(months, drop_incomplete=False).cache()
    assert scored.count() == months.count() == 8 * 27
    rows = scored.collect()
    tier = {"Low": (0, 3), "Moderate": (3, 8), "High": (8, 15), "Very High": (15, 101)}
    for r in rows:
        low, high = tier[r.predicted_risk]
        assert low <= r.risk_score < high and r.risk_score == round(r.risk_score, 2)
    kept = pipeline.monthly_index(months)
    assert kept.count() < scored.count()
    predicted = scored.withColumn("predicted_cases", scored.monthly_cases)
    latest = {r.county: r for r in serving.latest_risk(predicted, tables[3]).collect()}
    assert len(latest) == 8 and {(r.year, r.month) for r in latest.values()} == {(2025, 1)}
    assert latest["Kern"].monthly_cases == pytest.approx(1800 * 0.04)


def test_index_needs_no_reference_rows_beyond_its_own(spark, tables):
    months = pipeline.monthly_master(*tables)
    features = pipeline.panel.monthly_features(pipeline.panel.seasonal_cases(months), False)
    train = features.filter("year < 2024")
    a = index.index_monthly(features.filter("year >= 2024"), reference=train)
    assert a.filter("risk_score IS NULL OR risk_score < 0 OR risk_score > 100").count() == 0
