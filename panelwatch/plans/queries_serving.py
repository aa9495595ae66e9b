"""Serving queries: history, forecast, insights, lookups, texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwatch import constants as C
from panelwatch.functions import text
from panelwatch.functions.numeric import half_up
from panelwatch.operators import geo, graph, models, quality, stats
from panelwatch.plans import serving
from panelwatch.plans.oracle import r
from panelwatch.plans.pipeline import daily_index
from panelwatch.plans.queries_panel import DAILY_EXTRA
from panelwatch.plans.registry import query
from panelwatch.session import materialize, scratch_path
from panelwatch.sources.readers import current_conditions, read_polygons
from panelwatch.sources.standins import FORECAST_NOW, STANDIN_INTENTS, Standins
from panelwatch.streaming import reports as rep

RISK = "risk_score:f2 gpot:f4 erisk:f4 predicted_cases:f1 monthly_cases:f1"


def _latest(s: Standins) -> DataFrame:
    return serving.latest_risk(s.predictions(), s.meta())


# --- risk views -------------------------------------------------------------

@query("qry1_latest_risk", f"county:s fips:s lat:f6 lon:f6 year:i month:i risk_level:s {RISK}", "latest", "SELECT * FROM latest")
def qry1(s: Standins) -> DataFrame:
    return _latest(s)


_HISTORY = (f"SELECT county, year, month, coalesce(predicted_risk, 'Low') AS predicted_risk, {r('risk_score', 2)} AS risk_score, "
            f"{r('gpot', 4)} AS gpot, {r('erisk', 4)} AS erisk, {r('predicted_cases', 1)} AS predicted_cases, "
            f"{r('monthly_cases', 1)} AS monthly_cases FROM predictions WHERE ")


@query("qry2_risk_history", f"county:s year:i month:i predicted_risk:s {RISK}", "predictions", _HISTORY + "year BETWEEN 1997 AND 1999")
def qry2(s: Standins) -> DataFrame:
    return serving.risk_history(s.predictions(), None, 1997, 1999)


@query("flt1_place_and_years", f"county:s year:i month:i predicted_risk:s {RISK}", "predictions",
       _HISTORY + "county = 'NATION_3' AND year BETWEEN 1996 AND 1998 ORDER BY year, month")
def flt1(s: Standins) -> DataFrame:
    return serving.risk_history(s.predictions(), "NATION_3", 1996, 1998).orderBy("year", "month")


@query("flt4_place_key", "id:l county:s", "", "SELECT c_custkey AS id, CASE WHEN c_nationkey < 20 THEN 'NATION_' || CAST(c_nationkey AS VARCHAR) "
       "ELSE 'nowhere ' || CAST(c_nationkey AS VARCHAR) END AS county FROM customer")
def flt4(s: Standins) -> DataFrame:
    typed = s.table("customer").select(F.col("c_custkey").alias("id"), F.when(
        F.col("c_nationkey") < 20, F.concat(F.lit(" na_TION"), F.lit("_ "), F.col("c_nationkey").cast("string"))
    ).otherwise(F.concat(F.lit("nowhere "), F.col("c_nationkey").cast("string"))).alias("county"))
    places = s.table("nation").select(F.col("n_name").alias("county"))
    return rep.resolve_place(typed, places)


@query("flt5_future_rows", "county:s year:i month:i predicted_cases:f6", "predictions",
       f"SELECT * FROM predictions WHERE year > {FORECAST_NOW[0]} OR (year = {FORECAST_NOW[0]} AND month >= {FORECAST_NOW[1]})")
def flt5(s: Standins) -> DataFrame:
    return serving.future_rows(s.predictions(), *FORECAST_NOW)


_MONTH_LABEL = "strftime(make_date(year, month, 1), '%b''%y')"


@query("flt6_chart_rows", "county:s label:s risk_score:f6 actual:l", "predictions",
       f"SELECT county, {_MONTH_LABEL} AS label, risk_score, CASE WHEN monthly_cases > 0 THEN CAST({r('monthly_cases', 0)} AS BIGINT) END AS actual "
       "FROM predictions WHERE risk_score IS NOT NULL")
def flt6(s: Standins) -> DataFrame:
    return serving.chart_series(s.predictions())


@query("win13_cut_label", "county:s cut_label:s", "predictions",
       f"SELECT county, arg_max({_MONTH_LABEL}, year*12 + month) AS cut_label FROM predictions WHERE monthly_cases > 0 AND risk_score IS NOT NULL GROUP BY county")
def win13(s: Standins) -> DataFrame:
    return serving.chart_series(s.predictions()).select("county", "cut_label").distinct()


@query("qry8_chart_series", "county:s t:i label:s risk_score:f6 actual:l cut_label:s", "predictions",
       f"SELECT county, year*12 + month AS t, {_MONTH_LABEL} AS label, risk_score, CASE WHEN monthly_cases > 0 THEN "
       f"CAST({r('monthly_cases', 0)} AS BIGINT) END AS actual, arg_max({_MONTH_LABEL}, year*12 + month) FILTER (monthly_cases > 0) "
       "OVER (PARTITION BY county) AS cut_label FROM predictions WHERE risk_score IS NOT NULL")
def qry8(s: Standins) -> DataFrame:
    return serving.chart_series(s.predictions())


_NOW = FORECAST_NOW[0] * 12 + FORECAST_NOW[1]


@query("qry3_forecast", "county:s year:i month:i test_sample:i actual_cases:f1 predicted_cases:f1 residual:f1 risk_level:s risk_score:f2 "
       "gpot:f4 score_method:s model:s", "predictions case_predictions", f"""
       SELECT county, year, month, NULL AS test_sample, NULL AS actual_cases, predicted_cases, NULL AS residual, predicted_risk AS risk_level,
              risk_score, gpot, 'gpot_erisk' AS score_method, 'random_forest' AS model FROM (
         SELECT *, year*12 + month AS t, row_number() OVER (PARTITION BY county ORDER BY year DESC, month DESC) AS rn,
                max(year*12 + month) OVER (PARTITION BY county) AS newest
         FROM (SELECT * REPLACE (CASE WHEN county IN ('NATION_1', 'NATION_2') THEN year - 1 ELSE year END AS year) FROM predictions))
       WHERE CASE WHEN newest >= {_NOW} THEN t >= {_NOW} ELSE rn <= 6 END
       UNION ALL SELECT county, NULL, NULL, test_sample, actual_cases, predicted_cases, residual, predicted_risk, risk_score, NULL,
              score_method, 'graph_temporal' FROM case_predictions""")
def qry3(s: Standins) -> DataFrame:
    """Two places are a year behind, so that they have no month from now on."""
    late = F.col("county").isin("NATION_1", "NATION_2")
    s = s.shared()
    rows = s.predictions().withColumn("year", F.when(late, F.col("year") - 1).otherwise(F.col("year")))
    return serving.forecast(rows, s.case_predictions(), *FORECAST_NOW)


@query("qry4_env_history", "county:s year:i month:i label:s precip_mm:f2 soil_moisture:f4 wind_speed:f1 pm10:f1 risk_score:f2 gpot:f4 erisk:f4",
       "env predictions", f"""
       SELECT e.county, e.year, e.month, strftime(make_date(e.year, e.month, 1), '%b''%y') AS label, e.precip_mm, soil_moisture, wind_speed, pm10,
              risk_score, gpot, erisk FROM
       (SELECT *, row_number() OVER (PARTITION BY county ORDER BY year DESC, month DESC) AS rn FROM env) e
       LEFT JOIN predictions p ON e.county = p.county AND e.year = p.year AND e.month = p.month WHERE rn <= 24""")
def qry4(s: Standins) -> DataFrame:
    s = s.shared()
    return serving.env_history(s.env(), s.predictions(), 24)


@query("qry4_first_load_wins", "county:s year:i month:i risk_score:f6 gpot:f6 erisk:f6", "predictions", """
       SELECT county, year, month, risk_score + CASE WHEN month % 3 = 0 THEN 5 ELSE 0 END AS risk_score, gpot, erisk FROM predictions""")
def qry4_loads(s: Standins) -> DataFrame:
    """Every month was loaded again with lower values; the first load stands, here with 5 more in every third month."""
    rows = s.predictions()
    raised = F.col("risk_score") + F.when(F.col("month") % 3 == 0, 5).otherwise(0)
    first = rows.withColumn("risk_score", raised).withColumn("load_id", F.lit(1))
    again = rows.withColumn("risk_score", F.col("risk_score") - 1).withColumn("load_id", F.lit(2))
    return serving.index_rows(again.unionByName(first))


# --- insights ---------------------------------------------------------------

_YEARLY = ("SELECT county, year, avg(monthly_cases) AS avg_cases, max(monthly_cases) AS peak_cases, count(*) FILTER (risk_score >= 20) "
           "AS high_risk_months FROM predictions GROUP BY county, year")
_RECORD = ("SELECT county, year AS peak_year, month AS peak_month, monthly_cases AS record_cases FROM predictions "
           "QUALIFY row_number() OVER (PARTITION BY county ORDER BY monthly_cases DESC, year, month) = 1")


@query("agg6_yearly_insight", "county:s year:i avg_cases:f6 peak_cases:f6 high_risk_months:l", "predictions", _YEARLY)
def agg6(s: Standins) -> DataFrame:
    return stats.yearly_insight(s.predictions(), 20.0)


@query("agg7_peak_record", "county:s peak_year:i peak_month:i peak_cases:f6", "predictions",
       f"SELECT county, peak_year, peak_month, record_cases AS peak_cases FROM ({_RECORD})")
def agg7(s: Standins) -> DataFrame:
    return stats.peak_record(s.predictions())


_PEAK_MONTH = ("SELECT county, month AS peak_month FROM (SELECT county, month, round(avg(monthly_cases), 9) AS m FROM predictions GROUP BY 1, 2) "
               "QUALIFY row_number() OVER (PARTITION BY county ORDER BY m DESC, month) = 1")


@query("agg8_peak_calendar_month", "county:s peak_month:i", "predictions", _PEAK_MONTH)
def agg8(s: Standins) -> DataFrame:
    return stats.peak_calendar_month(s.predictions())


_TREND = ("SELECT county, avg(monthly_cases) FILTER (year = 1996) AS base_mean, CASE WHEN count(*) FILTER (year = 2000 AND county <> 'NATION_4') > 0 "
          "THEN avg(monthly_cases) FILTER (year = 2000 AND county <> 'NATION_4') ELSE avg(monthly_cases) FILTER (year = 1996) END AS year_mean, "
          "avg(monthly_cases) AS overall_mean FROM predictions GROUP BY county")


def _no_2000(s: Standins) -> DataFrame:
    """Predictions in which one place lacks the compared year: its months of 2000 count as 1999."""
    moved = (F.col("year") == 2000) & (F.col("county") == "NATION_4")
    return s.predictions().withColumn("year", F.when(moved, 1999).otherwise(F.col("year")))


@query("agg9_trend", "county:s base_mean:f6 year_mean:f6 increase:b", "predictions",
       f"SELECT *, coalesce(year_mean > base_mean * 1.02e0, FALSE) AS increase FROM ({_TREND})")
def agg9(s: Standins) -> DataFrame:
    return stats.trend(_no_2000(s), 1996, 2000, 1.02)


_HIST = ", ".join(f"avg({c}) FILTER (rn <= 6) AS recent_{c}, avg({c}) AS hist_{c}" for c in C.ANOMALY_FLOORS)
_ANOM = ", ".join(f"(recent_{c} - hist_{c}) / greatest(hist_{c}, {f}e0) * 100 AS {c}_anomaly" for c, f in C.ANOMALY_FLOORS.items())
ANOMALY_SQL = (f"SELECT *, {_ANOM} FROM (SELECT county, {_HIST} FROM (SELECT *, row_number() OVER (PARTITION BY county ORDER BY year DESC, month DESC) "
               "AS rn FROM env) GROUP BY county)")


@query("win14_anomalies", "county:s " + " ".join(f"recent_{c}:f6 hist_{c}:f6 {c}_anomaly:f6" for c in C.ANOMALY_FLOORS), "env", ANOMALY_SQL)
def win14(s: Standins) -> DataFrame:
    return stats.anomalies(s.env())


def _signed(x: str) -> str:
    whole = f"CAST(CAST({r(x, 0)} AS BIGINT) AS VARCHAR)"
    return f"CASE WHEN {r(x, 0)} >= 0 THEN '+' || {whole} ELSE {whole} END || '%'"


@query("str5_number_text", "county:s precip_mm_text:s soil_moisture_text:s pm10_text:s", "env",
       "SELECT county, " + ", ".join(f"{_signed(c + '_anomaly')} AS {c}_text" for c in C.ANOMALY_FLOORS) + f" FROM ({ANOMALY_SQL})")
def str5(s: Standins) -> DataFrame:
    return serving.anomaly_text(s.env())


def _whole(x: str) -> str:
    return f"CAST(CAST({r(x, 0)} AS BIGINT) AS VARCHAR)"


_MONTHS = "[" + ", ".join(f"'{m}'" for m in C.MONTH_NAMES) + "]"


@query("qry5_insights", "county:s insights:a", "predictions", f"""
       SELECT t.county, [
         'Historically, ' || t.county || ' sees peak Valley Fever risk around ' || list_extract({_MONTHS}, peak_month) || ' due to dry summer conditions.',
         'The 1995–2001 dataset shows cases averaging ' || {_whole('overall_mean')} || '/month for this county.',
         'Year-over-year trend: 1996 averaged ' || {_whole('base_mean')} || ' cases/month vs 2000''s ' || {_whole('year_mean')} || ' — a ' ||
         CASE WHEN coalesce(year_mean > base_mean * 1.2e0, FALSE) THEN 'significant increase' ELSE 'similar level' END || '.'] AS insights
       FROM ({_TREND}) t JOIN (SELECT county, month AS peak_month FROM (SELECT county, month, round(avg(monthly_cases), 9) AS m FROM predictions GROUP BY 1, 2)
         QUALIFY row_number() OVER (PARTITION BY county ORDER BY m DESC, month) = 1) p USING (county)""")
def qry5(s: Standins) -> DataFrame:
    rows = materialize(_no_2000(s), "predictions")
    return serving.insights(rows, 1995, 2001, 1996, 2000)


@query("qry5_insight_rows", "county:s year:i line:s peak_year:i peak_month:i", "predictions", f"""
       SELECT y.county, y.year, CAST(y.year AS VARCHAR) || ': avg ' || {_whole('avg_cases')} || ' cases/mo, peak ' || {_whole('peak_cases')} ||
              ', high-risk months: ' || CAST(high_risk_months AS VARCHAR) AS line, peak_year, peak_month
       FROM (SELECT county, year, avg(monthly_cases) AS avg_cases, max(monthly_cases) AS peak_cases, count(*) FILTER (risk_score >= 8) AS high_risk_months
             FROM predictions GROUP BY county, year) y JOIN ({_RECORD}) USING (county)""")
def qry5_rows(s: Standins) -> DataFrame:
    return serving.insight_rows(materialize(s.predictions(), "predictions"))


# --- forecast quality -------------------------------------------------------

_E = "(actual_cases - predicted_cases)"
_METRICS = (f"count(*) AS n, sqrt(sum({_E}*{_E}) / count(*)) AS rmse, avg(abs({_E})) AS mae, "
            f"CASE WHEN var_pop(actual_cases) > 0 THEN 1 - sum({_E}*{_E}) / (var_pop(actual_cases) * count(*)) END AS r2")


@query("agg14_regression_metrics", "n:l rmse:f6 mae:f6 r2:f6", "case_steps", f"SELECT {_METRICS} FROM case_steps")
def agg14(s: Standins) -> DataFrame:
    return stats.regression_metrics(s.case_steps())


@query("agg15_entity_performance", "county:s mean_actual:f6 mean_predicted:f6 mae:f6", "case_steps",
       f"SELECT county, avg(actual_cases) AS mean_actual, avg(predicted_cases) AS mean_predicted, avg(abs({_E})) AS mae FROM case_steps GROUP BY county")
def agg15(s: Standins) -> DataFrame:
    return stats.entity_performance(s.case_steps())


@query("ml5_prediction_table", "county:s year:i month:i monthly_cases:f6 lat:f6 lon:f6 predicted_cases:f6 residual:f6 gpot:f4 erisk:f4 risk_score:f2 "
       "predicted_risk:s", "predictions", "SELECT * FROM predictions")
def ml5(s: Standins) -> DataFrame:
    return models.with_residual(s.predictions().drop("residual"))


@query("ml7_target_scaling", "county:s year:i month:i target_norm:f6 back:f6", "monthly",
       "SELECT county, year, month, (monthly_cases - m) / sd AS target_norm, monthly_cases AS back FROM monthly, "
       "(SELECT avg(monthly_cases) AS m, stddev_pop(monthly_cases) AS sd FROM monthly)")
def ml7(s: Standins) -> DataFrame:
    return models.denormalize(models.normalize_target(s.monthly_table(), "monthly_cases"), "target_norm", "back")


# --- text rules -------------------------------------------------------------

def _overview(s: Standins) -> DataFrame:
    s = s.shared()
    return serving.place_overview(_latest(s), s.master())


_OVERVIEW = """SELECT l.county, l.fips, l.year, l.month, l.risk_level, l.risk_score, e.wind_speed_kmh, e.pm10_ugm3, e.tmax_approx_c AS temperature_c,
       e.precip_mm AS precipitation_mm FROM latest l LEFT JOIN (SELECT * FROM master QUALIFY row_number() OVER
       (PARTITION BY county ORDER BY date DESC) = 1) e ON l.county = e.county"""


@query("joi11_place_overview", "county:s fips:s year:i month:i risk_level:s risk_score:f2 wind_speed_kmh:f6 pm10_ugm3:f6 temperature_c:f6 "
       "precipitation_mm:f6", "latest master", _OVERVIEW)
def joi11(s: Standins) -> DataFrame:
    return _overview(s)


def _summary_sql(source: str) -> str:
    t = C.SUMMARY_TEXTS

    def told(key, x):
        before, after = t[key].split("%.0f")
        return f"'{before}' || {_whole(x)} || '{after}'"

    def two(x, hi, lo, a, b):
        return f"CASE WHEN {x} <> 0 AND {x} > {hi} THEN {told(a, x)} WHEN {x} <> 0 AND {x} {lo} THEN {told(b, x)} END"

    bullets = ", ".join([
        two("wind_speed_kmh", 20, "< 10", "wind_high", "wind_low"), two("pm10_ugm3", 50, "< 20", "pm10_high", "pm10_low"),
        two("temperature_c", 35, "> 25", "temp_extreme", "temp_warm"),
        f"CASE WHEN precipitation_mm > 5 THEN '{t['rain']}' WHEN precipitation_mm = 0 THEN '{t['dry']}' END",
        f"CASE WHEN risk_level = 'Very High' THEN '{t['tier_very_high']}' WHEN risk_level = 'High' THEN '{t['tier_high']}' END",
    ])
    advice = "CASE risk_level " + " ".join(
        f"WHEN '{k}' THEN [" + ", ".join(f"'{a}'" for a in v) + "]" for k, v in C.ADVICE_TEXTS.items() if k != "other"
    ) + f" ELSE ['{C.ADVICE_TEXTS['other'][0]}'] END"
    return (f"SELECT county, risk_level, CASE WHEN len(b) = 0 THEN ['{t['default']}'] ELSE b END AS summary, {advice} AS advice FROM "
            f"(SELECT *, list_filter([{bullets}], lambda z: z IS NOT NULL) AS b FROM ({source}))")


@query("qry7_risk_summary", "county:s risk_level:s summary:a advice:a", "latest master", _summary_sql(_OVERVIEW))
def qry7(s: Standins) -> DataFrame:
    return serving.risk_summary(_overview(s))


_DAY_READINGS = ("SELECT county || ' ' || CAST(date AS VARCHAR) AS county, CASE WHEN wind_speed_kmh > 20 THEN wind_speed_kmh ELSE 0 END AS wind_speed_kmh, "
                 "pm10_ugm3, tmax_approx_c - 5 AS temperature_c, precip_mm - 20 AS precipitation_mm, "
                 "CASE CAST(day(date) % 5 AS INTEGER) WHEN 0 THEN 'Low' WHEN 1 THEN 'Moderate' WHEN 2 THEN 'High' WHEN 3 THEN 'Very High' END AS risk_level FROM master")


@query("str3_bullets", "county:s risk_level:s summary:a advice:a", "master", _summary_sql(_DAY_READINGS))
def str3(s: Standins) -> DataFrame:
    levels = F.array(*[F.lit(t) for t in C.TIERS])
    rows = s.master().select(
        F.concat_ws(" ", "county", F.col("date").cast("string")).alias("county"),
        F.when(F.col("wind_speed_kmh") > 20, F.col("wind_speed_kmh")).otherwise(F.lit(0.0)).alias("wind_speed_kmh"), "pm10_ugm3",
        (F.col("tmax_approx_c") - 5).alias("temperature_c"), (F.col("precip_mm") - 20).alias("precipitation_mm"),
        F.try_element_at(levels, F.day("date") % 5 + 1).alias("risk_level"))
    return serving.risk_summary(rows)


@query("str1_names", "id:l key:s title:s", "", "SELECT p_partkey AS id, replace(replace(lower(p_name), ' ', ''), '_', '') AS \"key\", "
       "upper(p_name[1]) || p_name[2:position(' ' IN p_name)] || upper(p_name[position(' ' IN p_name)+1]) || p_name[position(' ' IN p_name)+2:] AS title FROM part")
def str1(s: Standins) -> DataFrame:
    name = F.col("p_name")
    return s.table("part").select(F.col("p_partkey").alias("id"), text.entity_key(F.upper(name)).alias("key"),
                                  text.title_name(F.concat(F.lit("  "), F.upper(name), F.lit(" "))).alias("title"))


_HIT = {w: f"contains(lower(text), '{w}')" for w in ("ir", "hein", "qu", "un", "sh")}


@query("str2_intent_router", "conv_id:l turn:l intent:s needs_search:b", "messages",
       f"SELECT conv_id, turn, CASE WHEN {_HIT['ir']} THEN 'ir' WHEN {_HIT['hein']} OR {_HIT['qu']} THEN 'hein_qu' WHEN {_HIT['un']} THEN 'un' "
       f"WHEN {_HIT['sh']} THEN 'sh' ELSE 'default' END AS intent, {_HIT['ir']} OR {_HIT['sh']} AS needs_search FROM messages")
def str2(s: Standins) -> DataFrame:
    return s.messages().select("conv_id", "turn", text.route_intent(F.col("text"), STANDIN_INTENTS).alias("intent"),
                               text.needs_search(F.col("text"), ["ir", "sh", "ER"]).alias("needs_search"))


_REPLY_INTENTS = list(zip(["medication", "protection", "symptom", "clinic"], [["ir"], ["hein", "qu"], ["un"], ["sh"]]))
_REPLY_SQL = "CASE intent " + " ".join("WHEN '" + k + "' THEN '" + v.replace("'", "''") + "'" for k, v in C.REPLY_TEXTS.items()) + " END"
_CAUTION_SQL = "replace(replace('" + C.REPLY_CAUTION + "', '{county}', m.county), '{risk_level}', l.risk_level)"


@query("str2_replies", "conv_id:l turn:l county:s intent:s reply:s", "messages latest", f"""
       SELECT conv_id, turn, m.county, intent, {_REPLY_SQL} || CASE WHEN intent = 'protection' AND l.risk_level IN ('High', 'Very High') THEN {_CAUTION_SQL} ELSE '' END AS reply
       FROM (SELECT conv_id, turn, CASE WHEN conv_id % 7 <> 0 THEN 'NATION_' || CAST(conv_id % 25 AS VARCHAR) END AS county,
                    CASE WHEN {_HIT['ir']} THEN 'medication' WHEN {_HIT['hein']} OR {_HIT['qu']} THEN 'protection' WHEN {_HIT['un']} THEN 'symptom'
                    WHEN {_HIT['sh']} THEN 'clinic' ELSE 'default' END AS intent FROM messages) m LEFT JOIN latest l ON l.county = m.county""")
def str2_replies(s: Standins) -> DataFrame:
    """Stand-in keywords choose among the fixed replies; one conversation in seven names no place."""
    place = F.when(F.col("conv_id") % 7 != 0, F.concat(F.lit("NATION_"), (F.col("conv_id") % 25).cast("string")))
    return serving.rule_replies(s.messages().withColumn("county", place), _latest(s), _REPLY_INTENTS)


@query("str2_default_keywords", "doc_id:l intent:s needs_search:b", "", "SELECT doc_id, CASE "
       + " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + f" THEN '{name}'" for name, words in C.INTENT_KEYWORDS)
       + " ELSE 'default' END AS intent, " + " OR ".join(f"contains(lower(text), '{w}')" for w in C.SEARCH_KEYWORDS) + " AS needs_search FROM documents")
def str2_default(s: Standins) -> DataFrame:
    return s.table("documents").select("doc_id", text.route_intent(F.col("text")).alias("intent"),
                                       text.needs_search(F.col("text")).alias("needs_search"))


def _template_sql(values: dict[str, str]) -> str:
    out = "CASE language " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.ALERT_LANGUAGES.items()) + " END"
    for name, value in values.items():
        out = f"replace({out}, '{{{name}}}', {value})"
    return out


@query("str4_template_fill", "phone:s county:s message:s", "subs",
       "SELECT phone, county, " + _template_sql({"risk_level": "'High'", "county": "county", "advice": "phone"}) + " AS message FROM subs")
def str4(s: Standins) -> DataFrame:
    subs = rep.subscriptions(s.subscription_requests(), places=s.meta())
    template = F.element_at(text.literal_map(C.ALERT_LANGUAGES), F.col("language"))
    return subs.select("phone", "county", text.fill_template(template, {
        "risk_level": F.lit("High"), "county": F.col("county"), "advice": F.col("phone")}).alias("message"))


# --- arrays and nested records ----------------------------------------------

_PAY = ("SELECT county, date_trunc('month', date) AS m, list(CAST(date AS VARCHAR) ORDER BY date) AS times, "
        "list(CASE WHEN total >= 20 THEN total END ORDER BY date) AS rain, list(top ORDER BY date) AS top FROM user_days GROUP BY 1, 2")


@query("arr1_first_and_total", "county:s m:d first_top:f6 total_rain:f1", "user_days",
       f"SELECT county, m, coalesce(top[1], -1) AS first_top, coalesce(list_sum(list_filter(rain, lambda z: z IS NOT NULL)), 0) AS total_rain FROM ({_PAY})")
def arr1(s: Standins) -> DataFrame:
    d = s.weather_payload()
    return d.select("county", F.trunc(F.to_date(F.col("daily.time")[0]), "month").alias("m"),
                    text.first_or(F.col("daily.wind_speed_10m_max"), F.lit(-1.0)).alias("first_top"),
                    text.array_total(F.col("daily.precipitation_sum")).alias("total_rain"))


@query("agg17_week_rain", "county:s date:d week_rain:f1", "weather",
       "SELECT county, date, coalesce(sum(CASE WHEN precip_mm >= 30 THEN precip_mm END) OVER (PARTITION BY county ORDER BY date ROWS BETWEEN 6 PRECEDING "
       "AND CURRENT ROW), 0) AS week_rain FROM weather")
def agg17(s: Standins) -> DataFrame:
    from pyspark.sql import Window

    week = Window.partitionBy("county").orderBy("date").rowsBetween(-6, 0)
    days = s.weather().withColumn("precip_mm", F.when(F.col("precip_mm") >= 30, F.col("precip_mm")))
    return days.select("county", "date", half_up(F.coalesce(F.sum("precip_mm").over(week), F.lit(0.0)), 1).alias("week_rain"))


@query("arr2_latest_with_value", "county:s m:d latest:s", "user_days",
       "SELECT county, date_trunc('month', date) AS m, CAST(max(date) FILTER (total >= 20) AS VARCHAR) AS latest FROM user_days GROUP BY 1, 2")
def arr2(s: Standins) -> DataFrame:
    d = s.weather_payload()
    return d.select("county", F.trunc(F.to_date(F.col("daily.time")[0]), "month").alias("m"),
                    text.latest_with_value(F.col("daily.time"), F.col("daily.precipitation_sum")).alias("latest"))


@query("jsn1_nested_fields", "county:s temperature_c:f6 temp_max_c:f6 precip_week_mm:f1 pm10_ugm3:f6 source:s", "user_days", f"""
       SELECT county || ' ' || CAST(CAST(m AS DATE) AS VARCHAR) AS county, CASE WHEN len(top) > 4 THEN top[1] END AS temperature_c, top[1] AS temp_max_c,
              coalesce(list_sum(list_filter(rain, lambda z: z IS NOT NULL)), 0) AS precip_week_mm, top[2] AS pm10_ugm3,
              CASE WHEN len(top) > 4 THEN 'live' ELSE 'unavailable' END AS source FROM ({_PAY})""")
def jsn1(s: Standins) -> DataFrame:
    from panelwatch.sources import schemas

    top = F.col("daily.wind_speed_10m_max")
    nested = s.weather_payload().select(
        F.concat_ws(" ", "county", F.trunc(F.to_date(F.col("daily.time")[0]), "month").cast("string")).alias("county"),
        F.when(F.size(top) > 4, F.struct(top[0].alias("temperature_2m"))).alias("current"),
        F.struct(top.alias("temperature_2m_max"), F.col("daily.precipitation_sum").alias("precipitation_sum")).alias("daily"),
        F.struct(F.try_element_at(top, F.lit(2)).alias("pm10")).alias("air"))
    path = scratch_path(s.spark, "current-json")
    nested.write.json(path)
    return current_conditions(s.spark.read.schema(schemas.CURRENT_PAYLOAD).json(path))


# --- geography --------------------------------------------------------------

@query("joi7_box_join", "id:l box_county:s", "located", "SELECT id, box_county FROM located")
def joi7(s: Standins) -> DataFrame:
    return geo.box_lookup(s.points(), geo.fixed_boxes(s.spark))


@query("joi7_box_join_grid", "id:l box_county:s", "located", "SELECT id, box_county FROM located")
def joi7_grid(s: Standins) -> DataFrame:
    return geo.box_lookup(s.points(), geo.fixed_boxes(s.spark), short_limit=0)


@query("joi8_nearest_center", "id:l near_county:s county:s", "located", "SELECT id, near_county, county FROM located")
def joi8(s: Standins) -> DataFrame:
    return geo.locate(s.points(), geo.fixed_boxes(s.spark), geo.fixed_centers(s.spark))


@query("joi8_nearest_center_grid", "id:l near_county:s", "located", "SELECT id, near_county FROM located")
def joi8_grid(s: Standins) -> DataFrame:
    return geo.nearest_center(s.points(), geo.fixed_centers(s.spark), short_limit=0)


_EDGE_ROWS = [
    (0, "tri", 0, [(-121.5, 35.0), (-119.0, 35.2), (-120.2, 37.4), (-121.5, 35.0)]),
    (1, "concave", 0, [(-120.5, 36.0), (-118.0, 36.0), (-118.0, 38.0), (-119.2, 36.6), (-120.5, 38.0), (-120.5, 36.0)]),
    (2, "two", 0, [(-121.7, 37.6), (-120.9, 37.6), (-120.9, 38.4), (-121.7, 38.4), (-121.7, 37.6)]),
    (2, "two", 1, [(-118.2, 34.6), (-117.6, 34.6), (-117.6, 35.4), (-118.2, 35.4), (-118.2, 34.6)]),
]
_EDGES = "VALUES " + ", ".join(
    f"({o}, '{n}', {k}, {ring[i][0]}e0, {ring[i][1]}e0, {ring[i - 1][0]}e0, {ring[i - 1][1]}e0)"
    for o, n, k, ring in _EDGE_ROWS for i in range(len(ring)))


@query("joi9_point_in_polygon", "id:l area:s status:s county:s", "points", f"""
       SELECT p.id, h.area, CASE WHEN h.area IN ('tri', 'two') THEN 'in-range' ELSE 'out-of-range' END AS status,
              CASE WHEN h.area IN ('tri', 'two') THEN h.area END AS county FROM points p LEFT JOIN (
         SELECT id, arg_min(name, ord) AS area FROM (
           SELECT id, ord, name, ring, count(*) FILTER (((yi > lat) <> (yj > lat)) AND lon < (xj - xi) * (lat - yi) / nullif(yj - yi, 0) + xi) % 2 AS odd
           FROM points, ({_EDGES}) e(ord, name, ring, xi, yi, xj, yj) GROUP BY 1, 2, 3, 4) WHERE odd = 1 GROUP BY id) h USING (id)""")
def joi9(s: Standins) -> DataFrame:
    path = scratch_path(s.spark, "polygons")
    s.polygons().write.json(path)
    return geo.polygon_lookup(s.points(), geo.polygon_rings(read_polygons(s.spark, path)), ["tri", "two"])


@query("agg19_ring_center", "name:s lat:f6 lon:f6", "points",
       "SELECT 'ring' || CAST(id AS VARCHAR) AS name, (lat + lat + lat + 0.3e0 + lat) / 4 AS lat, (lon + lon + 0.5e0 + lon + lon) / 4 AS lon FROM points")
def agg19(s: Standins) -> DataFrame:
    lat, lon = F.col("lat"), F.col("lon")
    ring = F.array(F.array(lon, lat), F.array(lon + 0.5, lat), F.array(lon, lat + 0.3), F.array(lon, lat))
    return geo.ring_center(s.points().select(F.concat(F.lit("ring"), F.col("id").cast("string")).alias("name"),
                                             F.array(ring).alias("rings")))


@query("qry6_risk_at_points", "id:l county:s risk_level:s risk_score:f2", "located latest", """
       SELECT id, 'NATION_' || CAST(CASE county WHEN 'Fresno' THEN 0 WHEN 'Kern' THEN 1 WHEN 'Kings' THEN 2 WHEN 'Madera' THEN 3 WHEN 'Merced' THEN 4
              WHEN 'San Joaquin' THEN 5 WHEN 'Stanislaus' THEN 6 ELSE 7 END AS VARCHAR) AS county, l.risk_level, l.risk_score
       FROM located p LEFT JOIN latest l ON l.county = 'NATION_' || CAST(CASE p.county WHEN 'Fresno' THEN 0 WHEN 'Kern' THEN 1 WHEN 'Kings' THEN 2
              WHEN 'Madera' THEN 3 WHEN 'Merced' THEN 4 WHEN 'San Joaquin' THEN 5 WHEN 'Stanislaus' THEN 6 ELSE 7 END AS VARCHAR)""".replace(
           "SELECT id, 'NATION_' || CAST(CASE county", "SELECT id, 'NATION_' || CAST(CASE p.county"))
def qry6(s: Standins) -> DataFrame:
    names = text.literal_map({row[0]: f"NATION_{i}" for i, row in enumerate(C.COUNTY_META)})
    boxes = geo.fixed_boxes(s.spark).withColumn("county", F.element_at(names, F.col("county")))
    centers = geo.fixed_centers(s.spark).withColumn("county", F.element_at(names, F.col("county")))
    return serving.risk_at(s.points(), boxes, centers, _latest(s))


# --- graph ------------------------------------------------------------------

_BOTH = ("SELECT DISTINCT src, dst FROM (SELECT src, dst FROM {e} UNION ALL SELECT dst, src FROM {e} UNION ALL SELECT src, src FROM {e} "
         "UNION ALL SELECT dst, dst FROM {e})")


def _graph_extra(edges: str) -> dict[str, str]:
    return {
        "sym": _BOTH.format(e=edges), "deg": "SELECT src AS node, count(*) AS degree FROM sym GROUP BY 1",
        "weights": "SELECT s.src, s.dst, 1 / sqrt(CAST(a.degree * b.degree AS DOUBLE)) AS w FROM sym s JOIN deg a ON a.node = s.src JOIN deg b ON b.node = s.dst",
    }


@query("agg18_degree", "node:s degree:l", "trade_edges", "SELECT * FROM deg", _graph_extra("trade_edges"))
def agg18(s: Standins) -> DataFrame:
    return graph.degrees(s.trade_edges())


@query("grf1_adjacency", "src:s dst:s w:f6", "trade_edges", "SELECT * FROM weights", _graph_extra("trade_edges"))
def grf1(s: Standins) -> DataFrame:
    return graph.normalized_adjacency(s.trade_edges())


@query("grf2_neighbor_features", "county:s t:i nb_precip_mm:f6 nb_pm10_ugm3:f6", "monthly nation_edges",
       "SELECT w.src AS county, m.year*12 + m.month AS t, coalesce(sum(w*precip_mm), 0) AS nb_precip_mm, coalesce(sum(w*pm10_ugm3), 0) AS nb_pm10_ugm3 "
       "FROM weights w JOIN monthly m ON m.county = w.dst GROUP BY 1, 2", _graph_extra("nation_edges"))
def grf2(s: Standins) -> DataFrame:
    steps = s.monthly().withColumn("t", F.col("year") * 12 + F.col("month"))
    return graph.neighbor_features(graph.normalized_adjacency(s.nation_edges()), steps, ["precip_mm", "pm10_ugm3"])


@query("joi10_customer_neighbors", "county:s t:i nb_value:f6", "trade_edges",
       "SELECT w.src AS county, 0 AS t, sum(w * bal) AS nb_value FROM weights w JOIN (SELECT 'c' || CAST(c_custkey AS VARCHAR) AS node, c_acctbal AS bal "
       "FROM customer UNION ALL SELECT 's' || CAST(s_suppkey AS VARCHAR), s_acctbal FROM supplier) n ON n.node = w.dst GROUP BY 1", _graph_extra("trade_edges"))
def joi10(s: Standins) -> DataFrame:
    nodes = s.table("customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("county"), F.col("c_acctbal").alias("value")).unionByName(
        s.table("supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("county"), F.col("s_acctbal").alias("value")))
    return graph.neighbor_features(graph.normalized_adjacency(s.trade_edges()), nodes.withColumn("t", F.lit(0)), ["value"])


# --- quality ----------------------------------------------------------------

@query("dq1_entity_count", "check:s ok:b detail:s", "master", "SELECT 'entity_count' AS \"check\", count(DISTINCT county) = 25 AS ok, "
       "CAST(count(DISTINCT county) AS VARCHAR) || ' of 25' AS detail FROM master")
def dq1(s: Standins) -> DataFrame:
    return quality.entity_count(s.master(), 25)


_CRITICAL = [*C.MEASURES, "case_count"]


@query("dq2_no_nulls", "check:s ok:b detail:s", "master", " UNION ALL ".join(
    f"SELECT 'no_nulls:{c}' AS \"check\", count(*) = count({c}) AS ok, CAST(count(*) - count({c}) AS VARCHAR) || ' nulls' AS detail FROM master" for c in _CRITICAL))
def dq2(s: Standins) -> DataFrame:
    return quality.no_nulls(s.master())


_PRESENT = ("SELECT 'cases_present:' || c.county || ':' || CAST(y.year AS VARCHAR) AS \"check\", coalesce(m.cases, 0) > 0 AS ok, "
            "CAST(coalesce(m.cases, 0) AS VARCHAR) || ' cases' AS detail FROM (SELECT DISTINCT county FROM master) c, (VALUES (2000), (2001)) y(year) "
            "LEFT JOIN (SELECT county, year(date) AS year, max(case_count) AS cases FROM master GROUP BY 1, 2) m ON m.county = c.county AND m.year = y.year")


@query("dq3_cases_present", "check:s ok:b detail:s", "master", _PRESENT)
def dq3(s: Standins) -> DataFrame:
    return quality.cases_present(s.master(), (2000, 2001))


_FLOOR = ("SELECT 'dominant_floor' AS \"check\", coalesce(max(case_count) >= 10, FALSE) AS ok, coalesce(CAST(max(case_count) AS VARCHAR) || ' cases', 'missing') "
          "AS detail FROM master WHERE county = 'NATION_7' AND year(date) = 2000")


@query("dq4_dominant_floor", "check:s ok:b detail:s", "master", _FLOOR)
def dq4(s: Standins) -> DataFrame:
    return quality.dominant_floor(s.master(), "NATION_7", 2000, 10)


_IDENTITY = ("SELECT 'score_identity' AS \"check\", max(abs(risk_score - \"G_pot\"*\"E_risk\"*100)) <= 0.01 AS ok, CASE WHEN "
             "max(abs(risk_score - \"G_pot\"*\"E_risk\"*100)) <= 0.01 THEN 'within tolerance' ELSE 'differs' END AS detail FROM scored_daily")


@query("dq5_score_identity", "check:s ok:b detail:s", "master", _IDENTITY, DAILY_EXTRA)
def dq5(s: Standins) -> DataFrame:
    return quality.score_identity(daily_index(s.master()))


@query("dq6_validation_report", "check:s ok:b detail:s", "master", " UNION ALL ".join([
    "SELECT 'entity_count' AS \"check\", count(DISTINCT county) = 8 AS ok, CAST(count(DISTINCT county) AS VARCHAR) || ' of 8' AS detail FROM filled",
    *[f"SELECT 'no_nulls:{c}', count(*) = count({c}), CAST(count(*) - count({c}) AS VARCHAR) || ' nulls' FROM filled" for c in _CRITICAL],
    _PRESENT, _FLOOR, _IDENTITY]), DAILY_EXTRA)
def dq6(s: Standins) -> DataFrame:
    scored = materialize(daily_index(s.master()), "daily-scored")
    return quality.validate(scored, 8, (2000, 2001), ("NATION_7", 2000, 10))


@query("dq6_pass_flag", "passed:b issues:l checks:l", "master",
       "SELECT bool_and(ok) AS passed, count(*) FILTER (NOT ok) AS issues, count(*) AS checks FROM (" + " UNION ALL ".join(
           f"SELECT count(*) = count({c}) AS ok FROM master" for c in _CRITICAL) + ")")
def dq6_flag(s: Standins) -> DataFrame:
    return quality.passed(quality.no_nulls(s.master()))
