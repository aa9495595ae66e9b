"""The two pipelines: daily master with index, monthly features with index."""

from __future__ import annotations

from pyspark.sql import DataFrame

from panelwatch import constants as C
from panelwatch.operators import index, panel
from panelwatch.session import materialize


def daily_master(weather: DataFrame, air: DataFrame, cases: DataFrame, meta: DataFrame) -> DataFrame:
    """Joined daily panel in master column order."""
    joined = panel.attach_cases(panel.join_air(weather, air), cases)
    return panel.order_columns(panel.attach_meta(joined, meta))


def monthly_master(weather: DataFrame, air: DataFrame, cases: DataFrame, meta: DataFrame) -> DataFrame:
    """The monthly rollup of the daily master.

    Case counts and place data are the same on every day of a year, so they are
    joined to the months instead of the days: the days are shuffled once less
    and the rollup holds numbers only.
    """
    months = panel.monthly_rollup(panel.join_air(weather, air))
    return panel.attach_meta(panel.attach_cases(months, cases).drop("cases_source"), meta)


def daily_index(master: DataFrame, thresholds=C.TIER_THRESHOLDS, fill_missing_entities: bool = True) -> DataFrame:
    """Fill, clip, lag, scale and score the daily master.

    The lagged panel is written once, because scaling reads it twice: for the
    statistics and for the rows.
    """
    filled = panel.impute(master)
    if fill_missing_entities:
        filled = panel.fill_median(filled, ["pm10_ugm3", "soil_moisture_m3m3", "wind_speed_kmh", "tmax_approx_c"])
    lagged = panel.add_lags(panel.clip_outliers(filled), C.DAILY_LAGS)
    return index.index_daily(index.scale_all(materialize(lagged, "daily-lagged")), thresholds)


def monthly_index(months: DataFrame, thresholds=C.TIER_THRESHOLDS, drop_incomplete: bool = True,
                  rounded: bool = True) -> DataFrame:
    """Build features on the monthly master and score."""
    features = panel.monthly_features(panel.seasonal_cases(months), drop_incomplete)
    return index.index_monthly(materialize(features, "monthly-features"), thresholds, rounded)
