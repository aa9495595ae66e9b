"""Queries on the panel: joins, fills, lags, frames, rollups, scaling, index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwatch import constants as C
from panelwatch.functions.numeric import half_up
from panelwatch.functions.text import month_label
from panelwatch.operators import index, panel, quantiles, stats
from panelwatch.plans import pipeline, serving
from panelwatch.plans.oracle import clamp_share, r, tier_case
from panelwatch.plans.registry import query
from panelwatch.session import materialize
from panelwatch.sources.standins import STANDIN_THRESHOLDS, Standins

W = "OVER (PARTITION BY county ORDER BY date)"
FWD = "OVER (PARTITION BY county ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
BWD = "OVER (PARTITION BY county ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
BOUNDS = STANDIN_THRESHOLDS
RAW = "precip_mm:f6 soil_moisture_m3m3:f6 wind_speed_kmh:f6 pm10_ugm3:f6 tmax_approx_c:f6"


# --- joins ------------------------------------------------------------------

@query("joi1_weather_air", "county:s date:d precip_mm:f6 pm10_ugm3:f6", "weather air",
       "SELECT w.county, w.date, precip_mm, pm10_ugm3 FROM weather w LEFT JOIN air a "
       "ON w.county = a.county AND w.date = a.date")
def joi1(s: Standins) -> DataFrame:
    return panel.join_air(s.weather(), s.air())


@query("joi2_attach_cases", "county:s date:d case_count:l cases_source:s", "weather cases",
       "SELECT w.county, w.date, coalesce(case_count, 0) AS case_count, coalesce(cases_source, 'no_data') AS cases_source "
       "FROM weather w LEFT JOIN cases c ON w.county = c.county AND year(w.date) = c.year")
def joi2(s: Standins) -> DataFrame:
    return panel.attach_cases(s.weather(), s.cases())


@query("joi3_monthly_weather_air", "county:s year:i month:i precip_mm:f6 soil_moisture:f6 wind_speed:f6 pm10:f6",
       "env", "SELECT * FROM env")
def joi3(s: Standins) -> DataFrame:
    return s.env()


@query("joi4_env_with_index", "county:s year:i month:i precip_mm:f6 risk_score:f6 gpot:f6 erisk:f6", "env predictions",
       "SELECT e.county, e.year, e.month, e.precip_mm, p.risk_score, p.gpot, p.erisk FROM env e "
       "LEFT JOIN predictions p USING (county, year, month)")
def joi4(s: Standins) -> DataFrame:
    s = s.shared()
    return s.env().join(serving.index_rows(s.predictions()), ["county", "year", "month"], "left")


@query("joi5_tracked_only", "county:s date:d pm10_ugm3:f6", "air",
       "SELECT * FROM air WHERE county IN (SELECT n_name FROM nation WHERE n_regionkey < 2)")
def joi5(s: Standins) -> DataFrame:
    tracked = s.table("nation").filter("n_regionkey < 2").select(F.col("n_name").alias("county"))
    return panel.keep_tracked(s.air(), tracked, "county")


@query("prj1_master_columns", "date:d county:s fips:s lat:f6 lon:f6 " + RAW + " case_count:l cases_source:s", "master",
       "SELECT * FROM master")
def prj1(s: Standins) -> DataFrame:
    return s.master()


@query("prj2_year_month", "county:s date:d year:i month:i", "weather",
       "SELECT county, date, year(date) AS year, month(date) AS month FROM weather")
def prj2(s: Standins) -> DataFrame:
    return s.weather().select("county", "date", F.year("date").alias("year"), F.month("date").alias("month"))


@query("prj3_attach_meta", "county:s date:d fips:s lat:f6 lon:f6", "weather meta",
       "SELECT w.county, date, coalesce(m.fips, '') AS fips, m.lat, m.lon FROM weather w "
       "LEFT JOIN (SELECT * FROM meta WHERE ord % 6 <> 5) m ON w.county = m.county")
def prj3(s: Standins) -> DataFrame:
    return panel.attach_meta(s.weather(), s.meta().filter("ord % 6 <> 5"))


@query("prj4_aridity", "county:s date:d soil_aridity:f6", "weather",
       "SELECT county, date, 1 - soil_moisture_m3m3 AS soil_aridity FROM weather")
def prj4(s: Standins) -> DataFrame:
    return panel.add_aridity(s.weather())


@query("prj5_legacy_score", "county:s year:i month:i risk_score:f6 gpot:f6", "predictions",
       "SELECT county, year, month, CASE predicted_risk WHEN 'Low' THEN 1e0 WHEN 'Moderate' THEN 2e0 WHEN 'High' THEN 3e0 "
       "WHEN 'Very High' THEN 4e0 END AS risk_score, CAST(NULL AS DOUBLE) AS gpot FROM predictions")
def prj5(s: Standins) -> DataFrame:
    old = s.predictions().drop("risk_score", "gpot", "erisk")
    return old.select("county", "year", "month", index.legacy_score(old).alias("risk_score"),
                      index.optional_column(old, "gpot"))


@query("prj6_month_label", "county:s year:i month:i label:s", "monthly",
       "SELECT county, year, month, strftime(make_date(year, month, 1), '%b''%y') AS label FROM monthly")
def prj6(s: Standins) -> DataFrame:
    return s.monthly().select("county", "year", "month", month_label(F.col("year"), F.col("month")).alias("label"))


@query("prj7_record_rounding", "county:s year:i month:i risk_score:f2 gpot:f4 monthly_cases:f1 precip_mm:f2 residual:f1",
       "predictions env", "SELECT p.county, p.year, p.month, risk_score, gpot, monthly_cases, e.precip_mm, residual "
       "FROM predictions p JOIN env e USING (county, year, month)")
def prj7(s: Standins) -> DataFrame:
    s = s.shared()
    rain = s.env().select("county", "year", "month", "precip_mm")
    joined = s.predictions().join(rain, ["county", "year", "month"])
    return joined.select("county", "year", "month", half_up(F.col("risk_score"), 2).alias("risk_score"),
                         half_up(F.col("gpot"), 4).alias("gpot"), half_up(F.col("monthly_cases"), 1).alias("monthly_cases"),
                         half_up(F.col("precip_mm"), 2).alias("precip_mm"), half_up(F.col("residual"), 1).alias("residual"))


# --- filters ----------------------------------------------------------------

@query("flt2_drop_all_null", "county:s date:d soil_moisture_m3m3:f6 wind_speed_kmh:f6", "weather",
       "SELECT * FROM weather WHERE soil_moisture_m3m3 IS NOT NULL OR wind_speed_kmh IS NOT NULL")
def flt2(s: Standins) -> DataFrame:
    return s.weather().dropna("all", subset=["soil_moisture_m3m3", "wind_speed_kmh"])


@query("flt3_drop_any_null", "county:s year:i month:i precip_lag18:f6 wind_roll3:f6 pm10_lag1:f6", "features",
       "SELECT * FROM features")
def flt3(s: Standins) -> DataFrame:
    return s.features()


# --- fills ------------------------------------------------------------------

@query("win6_zero_fill", "county:s date:d pm10_ugm3:f6 cases_source:s", "weather air cases",
       "SELECT w.county, w.date, coalesce(pm10_ugm3, 0) AS pm10_ugm3, coalesce(cases_source, 'no_data') AS cases_source "
       "FROM weather w LEFT JOIN air a ON w.county = a.county AND w.date = a.date "
       "LEFT JOIN cases c ON w.county = c.county AND year(w.date) = c.year")
def win6(s: Standins) -> DataFrame:
    return panel.fill_zero(panel.attach_cases(panel.join_air(s.weather(), s.air()), s.cases()), ["pm10_ugm3"])


@query("win4_fill_hold", "county:s date:d soil_moisture_m3m3:f6", "weather",
       f"SELECT county, date, coalesce(last_value(soil_moisture_m3m3 IGNORE NULLS) {FWD}, "
       f"first_value(soil_moisture_m3m3 IGNORE NULLS) {BWD}) AS soil_moisture_m3m3 FROM weather")
def win4(s: Standins) -> DataFrame:
    return panel.fill_hold(s.weather(), ["soil_moisture_m3m3"])


def _linear_sql(c: str, source: str) -> str:
    return f"""
      SELECT county, date, CASE WHEN {c} IS NOT NULL THEN {c} WHEN pv IS NULL THEN nv WHEN nv IS NULL THEN pv
             ELSE pv + (nv - pv) * (CAST(rn - pr AS DOUBLE) / (nr - pr)) END AS {c}
      FROM (SELECT *, last_value({c} IGNORE NULLS) {FWD} AS pv, first_value({c} IGNORE NULLS) {BWD} AS nv,
                   last_value(CASE WHEN {c} IS NOT NULL THEN rn END IGNORE NULLS) {FWD} AS pr,
                   first_value(CASE WHEN {c} IS NOT NULL THEN rn END IGNORE NULLS) {BWD} AS nr
            FROM (SELECT *, row_number() {W} AS rn FROM {source}))"""


@query("win5_fill_linear", "county:s date:d wind_speed_kmh:f6", "weather", _linear_sql("wind_speed_kmh", "weather"))
def win5(s: Standins) -> DataFrame:
    return panel.fill_linear(s.weather(), ["wind_speed_kmh"])


@query("agg4_median_fill", "county:s date:d soil_moisture_m3m3:f6 wind_speed_kmh:f6", "weather",
       "SELECT county, date, coalesce(soil_moisture_m3m3, (SELECT median(soil_moisture_m3m3) FROM weather)) AS "
       "soil_moisture_m3m3, coalesce(wind_speed_kmh, (SELECT median(wind_speed_kmh) FROM weather)) AS wind_speed_kmh FROM weather")
def agg4(s: Standins) -> DataFrame:
    return panel.fill_median(s.weather(), ["soil_moisture_m3m3", "wind_speed_kmh"])


@query("agg4_exact_median", "value:f6", "",
       "SELECT quantile_cont(l_extendedprice, p) AS value FROM lineitem, (VALUES (0.1), (0.5), (0.99)) v(p) GROUP BY p".replace(
           "quantile_cont(l_extendedprice, p)", "CASE p WHEN 0.1 THEN quantile_cont(l_extendedprice, 0.1) WHEN 0.5 THEN "
           "quantile_cont(l_extendedprice, 0.5) ELSE quantile_cont(l_extendedprice, 0.99) END"))
def agg4_exact(s: Standins) -> DataFrame:
    return quantiles.exact_quantiles(s.table("lineitem"), "l_extendedprice", [0.1, 0.5, 0.99])


@query("agg5_entity_quantiles", "county:s p25:f6 p50:f6 p75:f6", "monthly",
       "SELECT county, quantile_cont(monthly_cases, 0.25) AS p25, quantile_cont(monthly_cases, 0.5) AS p50, "
       "quantile_cont(monthly_cases, 0.75) AS p75 FROM monthly GROUP BY county")
def agg5(s: Standins) -> DataFrame:
    return quantiles.small_group_quantiles(s.monthly(), "monthly_cases", [0.25, 0.5, 0.75], ["county"], ["p25", "p50", "p75"])


@query("idx11_clip", "county:s date:d " + RAW, "weather air",
       "SELECT w.county, w.date, " + ", ".join(
           f"CASE WHEN {c} IS NOT NULL THEN greatest({lo}e0, least({hi}e0, {c})) END AS {c}"
           for c, (lo, hi) in C.CLIP_BOUNDS.items())
       + " FROM weather w LEFT JOIN air a ON w.county = a.county AND w.date = a.date")
def idx11(s: Standins) -> DataFrame:
    return panel.clip_outliers(panel.join_air(s.weather(), s.air()))


# --- lags and frames --------------------------------------------------------

@query("win1_daily_lags", "county:s date:d sm_lag6mo:f6 tmax_lag6mo:f6 precip_lag1p5y:f6 pm10_lag1mo:f6 tmax_lag1mo:f6",
       "master", "SELECT county, date, " + ", ".join(f"lag({c}, {n}) {W} AS {new}" for new, c, n in C.DAILY_LAGS)
       + " FROM master")
def win1(s: Standins) -> DataFrame:
    return panel.add_lags(s.master(), C.DAILY_LAGS)


@query("win1_calendar_lags", "county:s date:d rain_30:f6 heat_183:f6", "weather",
       "SELECT w.county, w.date, a.precip_mm AS rain_30, b.tmax_approx_c AS heat_183 FROM weather w "
       "LEFT JOIN weather a ON w.county = a.county AND a.date = w.date - 30 "
       "LEFT JOIN weather b ON w.county = b.county AND b.date = w.date - 183")
def win1_calendar(s: Standins) -> DataFrame:
    return panel.add_calendar_lags(s.weather(), [("rain_30", "precip_mm", 30), ("heat_183", "tmax_approx_c", 183)])


@query("win2_monthly_lags", "county:s year:i month:i precip_lag3:f6 precip_lag6:f6 precip_lag18:f6 sm_lag6:f6 pm10_lag1:f6 "
       "tmax_lag1:f6 tmax_lag6:f6", "features_all", "SELECT * FROM features_all")
def win2(s: Standins) -> DataFrame:
    return panel.add_lags(s.monthly(), C.MONTHLY_LAGS, order=("year", "month"))


@query("win3_rolling_mean", "county:s year:i month:i wind_roll3:f6 pm10_roll3:f6", "features_all", "SELECT * FROM features_all")
def win3(s: Standins) -> DataFrame:
    return panel.add_rolls(s.monthly(), C.MONTHLY_ROLLS, order=("year", "month"))


@query("win7_latest_row", "county:s year:i month:i risk_score:f6", "predictions",
       "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY county ORDER BY year DESC, month DESC) AS rn "
       "FROM predictions) WHERE rn = 1")
def win7(s: Standins) -> DataFrame:
    return panel.latest_row(s.predictions(), ["county"], ["year", "month"])


@query("win8_last_rows", "county:s year:i month:i precip_mm:f6", "env",
       "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY county ORDER BY year DESC, month DESC) AS rn "
       "FROM env) WHERE rn <= 6")
def win8(s: Standins) -> DataFrame:
    return panel.last_rows(s.env(), 6, ["county"], ["year", "month"])


@query("win9_sliding_windows", "county:s t:i lag6:f6 lag1:f6 target:f6", "monthly",
       "SELECT * FROM (SELECT county, year*12 + month AS t, lag(precip_mm, 6) OVER w AS lag6, lag(precip_mm, 1) OVER w AS lag1, "
       "monthly_cases AS target, row_number() OVER w AS rn FROM monthly WINDOW w AS (PARTITION BY county ORDER BY year, month)) "
       "WHERE rn > 6")
def win9(s: Standins) -> DataFrame:
    steps = s.monthly().withColumn("t", F.col("year") * 12 + F.col("month"))
    return panel.sliding_windows(steps, ["precip_mm", "tmax_approx_c"], "monthly_cases").select(
        "county", "t", F.col("window")[0]["precip_mm"].alias("lag6"), F.col("window")[5]["precip_mm"].alias("lag1"), "target"
    )


@query("win10_dense_panel", "county:s year:i month:i precip_mm:f6 monthly_cases:f6", "monthly",
       "SELECT c.county, p.year, p.month, coalesce(m.precip_mm, 0) AS precip_mm, coalesce(m.monthly_cases, 0) AS monthly_cases "
       "FROM (SELECT DISTINCT county FROM monthly) c CROSS JOIN (SELECT DISTINCT year, month FROM monthly) p "
       "LEFT JOIN monthly m ON m.county = c.county AND m.year = p.year AND m.month = p.month")
def win10(s: Standins) -> DataFrame:
    return panel.dense_panel(s.monthly_table(), ["precip_mm", "monthly_cases"])


_STEPS = ("SELECT county, year*12 + month AS t, dense_rank() OVER (ORDER BY year*12 + month) - 1 AS step, "
          "(SELECT count(DISTINCT year*12 + month) FROM monthly) AS n FROM monthly")


@query("win11_temporal_split", "county:s t:i split:s", "monthly",
       f"SELECT county, t, CASE WHEN step < floor(0.8e0 * n) THEN 'train' ELSE 'test' END AS split FROM ({_STEPS})")
def win11(s: Standins) -> DataFrame:
    return panel.temporal_split(s.monthly_table().withColumn("t", F.col("year") * 12 + F.col("month")))


@query("win12_test_sample", "county:s t:i test_sample:l", "monthly",
       f"SELECT county, t, step - floor(0.8e0 * n) AS test_sample FROM ({_STEPS}) WHERE step >= floor(0.8e0 * n)")
def win12(s: Standins) -> DataFrame:
    steps = s.monthly_table().withColumn("t", F.col("year") * 12 + F.col("month"))
    return panel.temporal_split(steps).filter(F.col("split") == "test")


@query("win15_last_valid_cut", "county:s year:i month:i monthly_cases:f6", "monthly",
       "SELECT * FROM monthly WHERE year*12 + month <= (SELECT max(year*12 + month) FROM monthly WHERE year <= 1999)")
def win15(s: Standins) -> DataFrame:
    steps = s.monthly_table().withColumn("t", F.col("year") * 12 + F.col("month"))
    return panel.cut_at_last_valid(steps, 1999)


# --- rollups ----------------------------------------------------------------

@query("agg1_monthly_rollup", "county:s year:i month:i fips:s lat:f6 lon:f6 " + RAW + " case_count:l", "monthly",
       "SELECT * FROM monthly")
def agg1(s: Standins) -> DataFrame:
    return panel.monthly_rollup(s.master())


@query("agg2_serving_rollup", "county:s year:i month:i precip_mm:f4 soil_moisture:f6 wind_speed:f6 pm10:f6", "env", "SELECT * FROM env")
def agg2(s: Standins) -> DataFrame:
    return panel.serving_rollup(s.weather(), s.air())


@query("idx12_seasonal_cases", "county:s year:i month:i monthly_cases:f6", "monthly", "SELECT * FROM monthly")
def idx12(s: Standins) -> DataFrame:
    return s.monthly()


# --- scaling ----------------------------------------------------------------

SCALE = ["precip_mm", "soil_moisture_m3m3", "wind_speed_kmh", "pm10_ugm3", "case_count"]


@query("agg3_column_stats", "column:s mean:f6 std:f6 std_pop:f6 lo:f6 hi:f6", "master",
       " UNION ALL ".join(f"SELECT '{c}' AS \"column\", avg({c}) AS mean, stddev_samp({c}) AS std, stddev_pop({c}) AS std_pop, "
                          f"min({c}) AS lo, max({c}) AS hi FROM master" for c in SCALE))
def agg3(s: Standins) -> DataFrame:
    row = index.column_stats(s.master(), SCALE)
    return row.select(F.explode(F.array(*[F.struct(
        F.lit(c).alias("column"), F.col(f"{c}_mean").alias("mean"), F.col(f"{c}_std").alias("std"),
        F.col(f"{c}_std_pop").alias("std_pop"), F.col(f"{c}_min").cast("double").alias("lo"),
        F.col(f"{c}_max").cast("double").alias("hi"),
    ) for c in SCALE])).alias("x")).select("x.*")


@query("idx1_zscore", "county:s date:d " + " ".join(f"z_{c}:f6" for c in SCALE), "master",
       "SELECT county, date, " + ", ".join(f"({c} - m_{c}) / s_{c} AS z_{c}" for c in SCALE) + " FROM master, (SELECT "
       + ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in SCALE) + " FROM master)")
def idx1(s: Standins) -> DataFrame:
    return index.zscore(materialize(s.master(), "master"), SCALE)


@query("idx2_minmax", "county:s date:d " + " ".join(f"n_{c}:f6" for c in SCALE), "master",
       "SELECT county, date, " + ", ".join(f"({c} - l_{c}) / (h_{c} - l_{c}) AS n_{c}" for c in SCALE) + " FROM master, (SELECT "
       + ", ".join(f"CAST(min({c}) AS DOUBLE) AS l_{c}, CAST(max({c}) AS DOUBLE) AS h_{c}" for c in SCALE) + " FROM master)")
def idx2(s: Standins) -> DataFrame:
    return index.minmax(materialize(s.master(), "master"), SCALE)


@query("idx3_clamped_minmax", "county:s year:i month:i s_precip_lag18:f6 s_wind_roll3:f6", "features_all",
       "SELECT county, year, month, " + ", ".join(clamp_share(c, f"l_{c}", f"h_{c}") + f" AS s_{c}" for c in ("precip_lag18", "wind_roll3"))
       + " FROM features_all, (SELECT " + ", ".join(f"min({c}) AS l_{c}, max({c}) AS h_{c}" for c in ("precip_lag18", "wind_roll3"))
       + " FROM features_all)")
def idx3(s: Standins) -> DataFrame:
    return index.clamped_minmax(materialize(s.features(False), "features"), ["precip_lag18", "wind_roll3"])


@query("idx4_fixed_range", "county:s date:d sm:f6 tmax:f6 precip:f6 pm10:f6 wind:f6", "master",
       "SELECT county, date, " + ", ".join(clamp_share(c, f"{C.NORM_RANGES[k][0]}e0", f"{C.NORM_RANGES[k][1]}e0") + f" AS {k}" for k, c in (
           ("sm", "soil_moisture_m3m3"), ("tmax", "tmax_approx_c"), ("precip", "precip_mm"), ("pm10", "pm10_ugm3"),
           ("wind", "wind_speed_kmh"))) + " FROM master")
def idx4(s: Standins) -> DataFrame:
    from panelwatch.functions.numeric import clamped_share

    use = {"sm": "soil_moisture_m3m3", "tmax": "tmax_approx_c", "precip": "precip_mm", "pm10": "pm10_ugm3", "wind": "wind_speed_kmh"}
    return s.master().select("county", "date", *[
        clamped_share(F.col(c), F.lit(C.NORM_RANGES[k][0]), F.lit(C.NORM_RANGES[k][1])).alias(k) for k, c in use.items()
    ])


# --- index ------------------------------------------------------------------

def _daily_index_sql() -> tuple[str, dict[str, str]]:
    def held(c):
        return f"coalesce(last_value({c} IGNORE NULLS) {FWD}, first_value({c} IGNORE NULLS) {BWD})"

    extra = {"soiled": f"SELECT *, {held('soil_moisture_m3m3')} AS soil FROM master"}
    for name, c in (("w", "wind_speed_kmh"), ("t", "tmax_approx_c"), ("p", "pm10_ugm3")):
        extra[f"lin_{name}"] = _linear_sql(c, "master")
    bound = {c: f"greatest({lo}e0, least({hi}e0, {{x}}))" for c, (lo, hi) in C.CLIP_BOUNDS.items()}
    med = "coalesce({c}, (SELECT median({c}) FROM {t}))"
    extra["filled"] = (
        f"SELECT county, date, case_count, {bound['precip_mm'].format(x='precip_mm')} AS precip_mm, "
        f"{bound['soil_moisture_m3m3'].format(x=med.format(c='soil', t='soiled'))} AS soil_moisture_m3m3, "
        f"{bound['wind_speed_kmh'].format(x=med.format(c='w.wind_speed_kmh', t='lin_w w'))} AS wind_speed_kmh, "
        f"{bound['pm10_ugm3'].format(x=med.format(c='p.pm10_ugm3', t='lin_p p'))} AS pm10_ugm3, "
        f"{bound['tmax_approx_c'].format(x=med.format(c='t.tmax_approx_c', t='lin_t t'))} AS tmax_approx_c "
        "FROM (SELECT county, date, case_count, precip_mm, soil FROM soiled) JOIN lin_w w USING (county, date) "
        "JOIN lin_t t USING (county, date) JOIN lin_p p USING (county, date)"
    )
    extra["lagged"] = "SELECT *, " + ", ".join(f"lag({c}, {n}) {W} AS {new}" for new, c, n in C.DAILY_LAGS) + " FROM filled"
    cols = ["sm_lag6mo", "tmax_lag6mo", "precip_lag1p5y", "pm10_lag1mo", "soil_moisture_m3m3", "wind_speed_kmh", "tmax_lag1mo"]
    n = {c: f"coalesce(({c} - l_{c}) / (h_{c} - l_{c}), 0e0)" for c in cols}
    arid = "coalesce(1 - (soil_moisture_m3m3 - l_soil_moisture_m3m3) / (h_soil_moisture_m3m3 - l_soil_moisture_m3m3), 0e0)"
    g = f"0.35e0*{n['sm_lag6mo']} + 0.20e0*{n['tmax_lag6mo']} + 0.30e0*{n['precip_lag1p5y']}"
    e = f"0.25e0*{n['pm10_lag1mo']} + 0.15e0*{arid} + 0.05e0*{n['wind_speed_kmh']} + 0.20e0*{n['tmax_lag1mo']}"
    extra["scored_daily"] = (
        f"SELECT *, {tier_case('risk_score', ('3', '8', '15'))} AS risk_level FROM (SELECT *, \"G_pot\"*\"E_risk\"*100 AS risk_score "
        f"FROM (SELECT county, date, case_count, {g} AS \"G_pot\", {e} AS \"E_risk\" FROM lagged, (SELECT "
        + ", ".join(f"min({c}) AS l_{c}, max({c}) AS h_{c}" for c in cols) + " FROM lagged)))"
    )
    return ("SELECT *, CASE risk_level WHEN 'Low' THEN 'green' WHEN 'Moderate' THEN 'yellow' WHEN 'High' THEN 'orange' ELSE 'red' END "
            "AS risk_color FROM scored_daily"), extra


DAILY_SQL, DAILY_EXTRA = _daily_index_sql()


@query("idx5_index_daily", "county:s date:d G_pot:f6 E_risk:f6 risk_score:f6 risk_level:s", "master", DAILY_SQL, DAILY_EXTRA)
def idx5(s: Standins) -> DataFrame:
    return pipeline.daily_index(s.master())


@query("idx6_index_monthly", "county:s year:i month:i gpot:f6 erisk:f6 risk_score:f6 predicted_risk:s", "scored", "SELECT * FROM scored")
def idx6(s: Standins) -> DataFrame:
    return s.scored()


@query("idx6_index_monthly_all_rows", "county:s year:i month:i gpot:f6 erisk:f6 risk_score:f6 predicted_risk:s", "scored_all",
       "SELECT * FROM scored_all")
def idx6_all(s: Standins) -> DataFrame:
    return s.scored(drop_incomplete=False)


def _fixed_sql() -> str:
    def share(c, kind):
        lo, hi = C.NORM_RANGES[kind]
        return clamp_share(c, f"{lo}e0", f"{hi}e0")

    g = f"0.35e0*({share('sm_lag6', 'sm')}) + 0.20e0*({share('tmax_lag6', 'tmax')}) + 0.30e0*({share('precip_lag18', 'precip')})"
    e = (f"0.25e0*({share('pm10_lag1', 'pm10')}) + 0.15e0*(1 - ({share('soil_moisture_m3m3', 'sm')})) + "
         f"0.05e0*({share('wind_speed_kmh', 'wind')}) + 0.20e0*({share('tmax_approx_c', 'tmax')})")
    return (f"SELECT *, {tier_case('risk_score')} AS risk_level FROM (SELECT *, gpot*erisk*100 AS risk_score FROM "
            f"(SELECT county, year, month, {g} AS gpot, {e} AS erisk FROM features_all))")


@query("idx7_index_fixed", "county:s year:i month:i gpot:f6 erisk:f6 risk_score:f6 risk_level:s", "features_all", _fixed_sql())
def idx7(s: Standins) -> DataFrame:
    return index.index_fixed(s.features(False), BOUNDS, rounded=False)


@query("idx8_tiers", "doc:l tier:s", "", "SELECT l_orderkey*10 + l_linenumber AS doc, "
       + tier_case("l_quantity", ("3", "8", "15")) + " AS tier FROM lineitem")
def idx8(s: Standins) -> DataFrame:
    return s.table("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("doc"),
                                      index.tier(F.col("l_quantity")).alias("tier"))


@query("idx9_tier_color", "county:s year:i month:i color:s", "scored_all",
       "SELECT county, year, month, CASE predicted_risk WHEN 'Low' THEN 'green' WHEN 'Moderate' THEN 'yellow' WHEN 'High' THEN 'orange' "
       "WHEN 'Very High' THEN 'red' END AS color FROM scored_all")
def idx9(s: Standins) -> DataFrame:
    return s.scored(drop_incomplete=False).withColumn("color", index.tier_color(F.col("predicted_risk")))


@query("idx10_case_percentile", "county:s test_sample:l actual_cases:f6 predicted_cases:f6 risk_score:f2 predicted_risk:s score_method:s",
       "case_predictions", "SELECT * FROM case_predictions")
def idx10(s: Standins) -> DataFrame:
    return s.case_predictions()


@query("idx13_elevated", "county:s year:i month:i elevated:b", "scored_all",
       "SELECT county, year, month, coalesce(risk_score >= 20, FALSE) OR coalesce(predicted_risk IN ('High', 'Very High'), FALSE) AS elevated "
       "FROM scored_all")
def idx13(s: Standins) -> DataFrame:
    rows = s.scored(drop_incomplete=False)
    return rows.withColumn("elevated", index.elevated(F.col("risk_score"), F.col("predicted_risk"), 20.0))


@query("idx14_warn_flags", "county:s date:d warn_wind:b warn_pm10:b warn_temp:b warn_dry:b gauge:f6 radius:f6", "master",
       "SELECT county, date, coalesce(wind_speed_kmh > 15, FALSE) AS warn_wind, coalesce(pm10_ugm3 > 35, FALSE) AS warn_pm10, "
       "coalesce(tmax_approx_c > 35, FALSE) AS warn_temp, coalesce(precip_mm - 20 = 0, FALSE) AS warn_dry, "
       "coalesce(least(1e0, wind_speed_kmh / 25), 0) AS gauge, "
       "greatest(5e0, least(11e0, 4 + CAST(CASE WHEN case_count = 0 THEN 1000 ELSE case_count*100 END AS DOUBLE) / 2000)) AS radius FROM master")
def idx14(s: Standins) -> DataFrame:
    rows = s.master().withColumn("temperature_c", F.col("tmax_approx_c")).withColumn("precip_week_mm", F.col("precip_mm") - 20)
    return index.warn_flags(rows).withColumn("gauge", index.gauge_share(F.col("wind_speed_kmh"))).withColumn(
        "radius", index.zone_radius(F.col("case_count") * 100))


# --- aggregates -------------------------------------------------------------

@query("agg10_yearly_totals", "year:i total_cases:l", "cases", "SELECT year, sum(case_count) AS total_cases FROM cases GROUP BY year")
def agg10(s: Standins) -> DataFrame:
    return stats.yearly_totals(s.cases())


@query("agg11_tier_distribution", "tier:s n:l percent:f6", "scored_all",
       "SELECT t.tier, count(s.county) AS n, count(s.county) * 100e0 / (SELECT count(*) FROM scored_all) AS percent FROM "
       "(VALUES ('Low'), ('Moderate'), ('High'), ('Very High'), ('Unheard')) t(tier) LEFT JOIN scored_all s ON s.predicted_risk = t.tier GROUP BY 1")
def agg11(s: Standins) -> DataFrame:
    return stats.tier_distribution(s.scored(drop_incomplete=False), "predicted_risk", [*C.TIERS, "Unheard"])


@query("agg12_null_profile", "column:s nulls:l percent:f6", "master",
       " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls, (count(*) - count({c})) * 100e0 / count(*) AS percent FROM master"
                          for c in C.MEASURES))
def agg12(s: Standins) -> DataFrame:
    return stats.null_profile(s.master(), C.MEASURES)


@query("agg13_clip_report", "column:s below:l above:l", "master",
       " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} < {lo}) AS below, count(*) FILTER ({c} > {hi}) AS above FROM master"
                          for c, (lo, hi) in {"precip_mm": (30, 200), "wind_speed_kmh": (20, 30)}.items()))
def agg13(s: Standins) -> DataFrame:
    return stats.clip_report(s.master(), {"precip_mm": (30, 200), "wind_speed_kmh": (20, 30)})


@query("agg16_panel_summary", "n_rows:l n_counties:l n_years:l first_date:d last_date:d", "weather",
       "SELECT count(*) AS n_rows, count(DISTINCT county) AS n_counties, count(DISTINCT year(date)) AS n_years, min(date) AS first_date, "
       "max(date) AS last_date FROM weather")
def agg16(s: Standins) -> DataFrame:
    return stats.panel_summary(s.weather())


# --- sort and sets ----------------------------------------------------------

@query("srt1_multi_key_sort", "county:s date:d precip_mm:f6", "weather", "SELECT * FROM weather ORDER BY county, date DESC")
def srt1(s: Standins) -> DataFrame:
    return s.weather().orderBy("county", F.desc("date"))


@query("set1_union_all", "county:s date:d v:f6", "weather air",
       "SELECT county, date, precip_mm AS v FROM weather UNION ALL SELECT county, date, pm10_ugm3 AS v FROM air")
def set1(s: Standins) -> DataFrame:
    return s.weather().select("county", "date", F.col("precip_mm").alias("v")).unionByName(
        s.air().select("county", "date", F.col("pm10_ugm3").alias("v")))


@query("set2_keep_last", "county:s date:d load_id:l v:f2", "",
       "SELECT CAST(l_suppkey AS VARCHAR) AS county, CAST(l_shipdate AS DATE) AS date, l_orderkey*10 + l_linenumber AS load_id, "
       "l_extendedprice AS v FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, CAST(l_shipdate AS DATE) "
       "ORDER BY l_orderkey*10 + l_linenumber DESC, l_extendedprice DESC) = 1")
def set2(s: Standins) -> DataFrame:
    loads = s.table("lineitem").select(
        F.col("l_suppkey").cast("string").alias("county"), F.to_date("l_shipdate").alias("date"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("load_id"), F.col("l_extendedprice").alias("v"))
    return panel.unique_steps(loads, ["county", "date"], ["load_id", "v"])


@query("set3_distinct", "county:s year:i", "weather", "SELECT DISTINCT county, year(date) AS year FROM weather")
def set3(s: Standins) -> DataFrame:
    return s.weather().select("county", F.year("date").alias("year")).distinct()


@query("mth1_scalar_math", "id:l clamped:f6 magnitude:f6 root:f6 rounded:f6 filled:f6", "",
       "SELECT c_custkey AS id, greatest(0e0, least(5000e0, c_acctbal)) AS clamped, abs(c_acctbal) AS magnitude, sqrt(abs(c_acctbal)) AS root, "
       f"{r('c_acctbal', 1)} AS rounded, coalesce(nullif(c_acctbal, 0), 0.5e0) AS filled FROM customer")
def mth1(s: Standins) -> DataFrame:
    from panelwatch.functions.numeric import clamp

    x = F.col("c_acctbal")
    return s.table("customer").select(
        F.col("c_custkey").alias("id"), clamp(x, 0.0, 5000.0).alias("clamped"), F.abs(x).alias("magnitude"),
        F.sqrt(F.abs(x)).alias("root"), half_up(x, 1).alias("rounded"), F.coalesce(F.nullif(x, F.lit(0)), F.lit(0.5)).alias("filled"))


@query("dat1_date_parts", "id:l day:d year:i month:i next_day:d", "",
       "SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, year(o_orderdate) AS year, month(o_orderdate) AS month, "
       "CAST(o_orderdate AS DATE) + 1 AS next_day FROM orders")
def dat1(s: Standins) -> DataFrame:
    day = F.to_date(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return s.table("orders").select(F.col("o_orderkey").alias("id"), day.alias("day"), F.year(day).alias("year"),
                                    F.month(day).alias("month"), F.date_add(day, 1).alias("next_day"))
