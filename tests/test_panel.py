"""Fills, lags, rolls and frames against pandas, with edge-case rows."""

import datetime as dt
import random

import pandas as pd
import pytest

from panelwatch import constants as C
from panelwatch.operators import panel

DAY = dt.date(2024, 1, 1)


def frame(seed: int = 7, days: int = 40) -> pd.DataFrame:
    rng = random.Random(seed)
    rows = []
    for county in ("gaps", "lead", "trail", "none", "one"):
        for d in range(1 if county == "one" else days):
            value = rng.uniform(0, 10)
            hole = (county == "none" or (county == "gaps" and rng.random() < 0.4) or (county == "lead" and d < 5)
                    or (county == "trail" and d > 30))
            rows.append((county, DAY + dt.timedelta(days=d), None if hole else value))
    return pd.DataFrame(rows, columns=["county", "date", "x"])


def spark_frame(spark, pdf):
    return spark.createDataFrame(
        [(c, d, None if pd.isna(x) else x) for c, d, x in pdf.itertuples(index=False)],
        "county string, date date, x double",
    ).repartition(3)


def collected(df, column: str = "x") -> dict:
    return {(r["county"], r["date"]): r[column] for r in df.collect()}


def assert_same(got: dict, want: pd.DataFrame, column: str = "x"):
    assert len(got) == len(want)
    for row in want.itertuples():
        expected, value = getattr(row, column), got[(row.county, row.date)]
        if pd.isna(expected):
            assert value is None
        else:
            assert value == pytest.approx(expected, abs=1e-9)


def test_fill_hold_is_ffill_then_bfill(spark):
    pdf = frame()
    want = pdf.assign(x=pdf.groupby("county").x.transform(lambda s: s.ffill().bfill()))
    assert_same(collected(panel.fill_hold(spark_frame(spark, pdf), ["x"])), want)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_fill_linear_is_interpolation_with_held_ends(spark, seed):
    pdf = frame(seed)
    want = pdf.assign(x=pdf.groupby("county").x.transform(lambda s: s.interpolate(limit_direction="both")))
    assert_same(collected(panel.fill_linear(spark_frame(spark, pdf), ["x"])), want)


def test_fill_median_uses_all_entities_and_skips_full_columns(spark):
    pdf = frame()
    want = pdf.assign(x=pdf.x.fillna(pdf.x.median()))
    assert_same(collected(panel.fill_median(spark_frame(spark, pdf), ["x"])), want)
    full = spark_frame(spark, want)
    assert_same(collected(panel.fill_median(full, ["x"])), want)


def test_rolling_mean_needs_every_value(spark):
    pdf = frame()
    want = pdf.assign(r=pdf.groupby("county").x.transform(lambda s: s.rolling(3).mean()))
    assert_same(collected(panel.add_rolls(spark_frame(spark, pdf), [("r", "x", 3)], order=("date",)), "r"), want, "r")


def test_row_lag_and_calendar_lag_differ_on_missing_days(spark):
    pdf = frame().query("county == 'trail'").drop(index=frame().query("county == 'trail'").index[10])
    df = spark_frame(spark, pdf)
    want = pdf.assign(l=pdf.x.shift(3))
    assert_same(collected(panel.add_lags(df, [("l", "x", 3)]), "l"), want, "l")
    by_day = {d: x for d, x in zip(pdf.date, pdf.x)}
    calendar = pdf.assign(l=[by_day.get(d - dt.timedelta(days=3)) for d in pdf.date])
    assert_same(collected(panel.add_calendar_lags(df, [("l", "x", 3)]), "l"), calendar, "l")


def test_clip_keeps_nulls(spark):
    df = spark.createDataFrame([(-5.0,), (5.0,), (500.0,), (None,)], "precip_mm double")
    got = [r[0] for r in panel.clip_outliers(df, {"precip_mm": (0.0, 380.0)}).collect()]
    assert got == [0.0, 5.0, 380.0, None]


def test_unique_steps_keeps_last_load_with_nulls(spark):
    df = spark.createDataFrame(
        [("a", 1, 1, 5.0), ("a", 1, 2, None), ("a", 2, 1, 7.0), ("b", 1, 3, 1.0), ("b", 1, 2, 2.0)],
        "county string, date int, load_id int, v double",
    )
    got = {(r.county, r.date): (r.load_id, r.v) for r in panel.unique_steps(df, ["county", "date"], ["load_id"]).collect()}
    assert got == {("a", 1): (2, None), ("a", 2): (1, 7.0), ("b", 1): (3, 1.0)}


def test_monthly_rollup_first_is_first_known(spark):
    rows = [("a", DAY, None, 1.0, None, 3), ("a", DAY + dt.timedelta(days=1), "01", 2.0, 4.0, 3),
            ("a", DAY + dt.timedelta(days=2), "02", None, 6.0, 3)]
    df = spark.createDataFrame(rows, "county string, date date, fips string, precip_mm double, wind_speed_kmh double, case_count long")
    for c in ("lat", "lon", "soil_moisture_m3m3", "pm10_ugm3", "tmax_approx_c"):
        df = df.selectExpr("*", f"CAST(NULL AS DOUBLE) AS {c}")
    row = panel.monthly_rollup(df).first()
    assert (row.fips, row.precip_mm, row.wind_speed_kmh, row.pm10_ugm3, row.case_count) == ("01", 3.0, 5.0, None, 3)


def test_all_missing_rain_sums_to_zero(spark):
    df = spark.createDataFrame([("a", DAY, None)], "county string, date date, precip_mm double")
    for c in ("soil_moisture_m3m3", "wind_speed_kmh"):
        df = df.selectExpr("*", f"CAST(NULL AS DOUBLE) AS {c}")
    air = spark.createDataFrame([], "county string, date date, pm10_ugm3 double")
    row = panel.serving_rollup(df, air).first()
    assert row.precip_mm == 0.0 and row.pm10 is None


def test_temporal_split_matches_int_of_share(spark):
    df = spark.createDataFrame([("a", t) for t in range(54)] + [("b", t) for t in range(54)], "county string, t int")
    out = panel.temporal_split(df).filter("split = 'test'").collect()
    assert {r.test_sample for r in out} == set(range(11)) and len(out) == 22


def test_dense_panel_fills_missing_cells_with_zero(spark):
    df = spark.createDataFrame([("a", 2024, 1, 1.0), ("b", 2024, 12, 2.0)], "county string, year int, month int, v double")
    got = {(r.county, r.year, r.month): r.v for r in panel.dense_panel(df, ["v"]).collect()}
    assert got == {("a", 2024, 1): 1.0, ("a", 2024, 12): 0.0, ("b", 2024, 1): 0.0, ("b", 2024, 12): 2.0}


def test_seasonal_weights_sum_to_one():
    assert sum(C.SEASONAL_WEIGHTS.values()) == pytest.approx(1.0)
    assert sum(C.SEASONAL_WEIGHTS[m] for m in (8, 9, 10, 11)) == pytest.approx(0.54)
