"""User-level queries as tables over all places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwatch import constants as C
from panelwatch.functions.numeric import half_up, truthy
from panelwatch.functions.text import fill_template, literal_map, month_index, month_label, route_intent, signed_percent, whole_text
from panelwatch.operators.index import legacy_score, optional_column
from panelwatch.operators.panel import last_rows
from panelwatch.operators.stats import anomalies, peak_calendar_month, peak_record, trend, yearly_insight


def _reported(df: DataFrame) -> list[Column]:
    return [
        half_up(legacy_score(df), 2).alias("risk_score"),
        half_up(optional_column(df, "gpot"), 4).alias("gpot"),
        half_up(optional_column(df, "erisk"), 4).alias("erisk"),
        half_up(F.col("predicted_cases"), 1).alias("predicted_cases"),
        half_up(F.col("monthly_cases"), 1).alias("monthly_cases"),
    ]


def latest_risk(predictions: DataFrame, meta: DataFrame) -> DataFrame:
    """Newest month of every place with its code and coordinates."""
    cols = [c for c in predictions.columns if c not in ("county", "lat", "lon", "fips")]
    newest = predictions.groupBy("county").agg(
        F.max_by(F.struct(*cols), month_index(F.col("year"), F.col("month"))).alias("_r")
    ).select("county", "_r.*")
    return newest.join(meta.select("county", "fips", "lat", "lon"), "county").select(
        "county", "fips", "lat", "lon", "year", "month", F.col("predicted_risk").alias("risk_level"),
        *_reported(newest),
    )


def risk_history(predictions: DataFrame, county: str | None, start_year: int = 2021, end_year: int = 2026) -> DataFrame:
    """Monthly history of one place (or of all), years included; callers sort at the sink."""
    rows = predictions.filter(F.col("year").between(start_year, end_year))
    if county is not None:
        rows = rows.filter(F.col("county") == county)
    return rows.select(
        "county", "year", "month", F.coalesce("predicted_risk", F.lit(C.TIERS[0])).alias("predicted_risk"),
        *_reported(rows),
    )


def future_rows(predictions: DataFrame, year: int, month: int) -> DataFrame:
    """Rows of the given month or later."""
    return predictions.filter(month_index(F.col("year"), F.col("month")) >= year * 12 + month)


def forecast(predictions: DataFrame, case_predictions: DataFrame, year: int, month: int,
             fallback_rows: int = C.RECENT_MONTHS) -> DataFrame:
    """Per place the months from now on, or its last rows if it has none, with the second model's rows.

    One window gives both the rank from the end and the future flag of the whole
    place (the newest month decides it), so the table is read once.
    """
    t = month_index(F.col("year"), F.col("month"))
    place = Window.partitionBy("county")
    ranked = (
        predictions.withColumn("_t", t)
        .withColumn("_rn", F.row_number().over(place.orderBy(F.desc("_t"))))
        .withColumn("_newest", F.max("_t").over(place))
    )
    now = year * 12 + month
    chosen = ranked.filter(
        F.when(F.col("_newest") >= now, F.col("_t") >= now).otherwise(F.col("_rn") <= fallback_rows)
    )
    first = chosen.select(
        "county", "year", "month", half_up(F.col("predicted_cases"), 1).alias("predicted_cases"),
        F.col("predicted_risk").alias("risk_level"), half_up(F.col("risk_score"), 2).alias("risk_score"),
        half_up(optional_column(chosen, "gpot"), 4).alias("gpot"),
        half_up(optional_column(chosen, "erisk"), 4).alias("erisk"),
        F.lit(C.INDEX_SCORE_METHOD).alias("score_method"), F.lit("random_forest").alias("model"),
    )
    second = case_predictions.select(
        "county", F.col("test_sample").cast("int").alias("test_sample"),
        half_up(F.col("actual_cases"), 1).alias("actual_cases"),
        half_up(F.col("predicted_cases"), 1).alias("predicted_cases"),
        half_up(F.col("residual"), 1).alias("residual"), half_up(F.col("risk_score"), 2).alias("risk_score"),
        F.col("predicted_risk").alias("risk_level"),
        optional_column(case_predictions, "score_method", "string"), F.lit("graph_temporal").alias("model"),
    ).withColumn("score_method", F.coalesce("score_method", F.lit(C.CASE_SCORE_METHOD)))
    return first.unionByName(second, allowMissingColumns=True)


def index_rows(predictions: DataFrame, load: str = "load_id") -> DataFrame:
    """Index values of each place and month, once: of repeated rows the first loaded one.

    The load order is the column ``load`` where the table has it; rows of one load
    (or of a table without loads) are told apart by their values in column order.
    """
    values = F.struct(*[optional_column(predictions, c).alias(c) for c in ("risk_score", "gpot", "erisk")])
    order = F.struct(F.col(load), values) if load in predictions.columns else values
    return predictions.groupBy("county", "year", "month").agg(F.min_by(values, order).alias("_v")).select("county", "year", "month", "_v.*")


def rule_replies(messages: DataFrame, latest: DataFrame, intents=C.INTENT_KEYWORDS, texts=C.REPLY_TEXTS,
                 tiers=C.ALERT_TIERS) -> DataFrame:
    """Reply of each message by its intent; the protection reply adds a caution where the message's place is at risk.

    ``messages``: ``text`` and ``county`` (null if none was named) and any other
    columns; ``latest``: one row per place.
    """
    named = messages.withColumn("intent", route_intent(F.col("text"), intents))
    at_risk = latest.filter(F.col("risk_level").isin(list(tiers))).select("county", "risk_level")
    caution = F.when((F.col("intent") == C.CAUTION_INTENT) & F.col("risk_level").isNotNull(), fill_template(
        F.lit(C.REPLY_CAUTION), {"county": F.col("county"), "risk_level": F.col("risk_level")}))
    reply = F.element_at(literal_map(texts), F.col("intent"))
    return named.join(at_risk, "county", "left").withColumn("reply", F.concat(reply, F.coalesce(caution, F.lit(""))))


def env_history(env: DataFrame, predictions: DataFrame, months: int = 24) -> DataFrame:
    """Last months of environment per place with the matching index values."""
    recent = last_rows(env, months, ["county"], ["year", "month"])
    return recent.join(index_rows(predictions), ["county", "year", "month"], "left").select(
        "county", "year", "month", month_label(F.col("year"), F.col("month")).alias("label"),
        half_up(F.col("precip_mm"), 2).alias("precip_mm"), half_up(F.col("soil_moisture"), 4).alias("soil_moisture"),
        half_up(F.col("wind_speed"), 1).alias("wind_speed"), half_up(F.col("pm10"), 1).alias("pm10"),
        half_up(F.col("risk_score"), 2).alias("risk_score"), half_up(F.col("gpot"), 4).alias("gpot"),
        half_up(F.col("erisk"), 4).alias("erisk"),
    )


def insights(predictions: DataFrame, first_year: int = 2021, last_year: int = 2026, base_year: int = 2022,
             year: int = 2024, texts=C.INSIGHT_TEXTS) -> DataFrame:
    """Three sentences per place: peak month, mean, trend. A missing mean reads ``nan``."""
    months = F.array(*[F.lit(m) for m in C.MONTH_NAMES])
    name = F.element_at(months, F.col("peak_month"))
    both = trend(predictions, base_year, year).join(peak_calendar_month(predictions), "county")
    word = F.when(F.col("increase"), F.lit(texts["trend_up"])).otherwise(F.lit(texts["trend_flat"]))
    return both.select("county", F.array(
        F.format_string(texts["peak"], "county", name),
        F.format_string(texts["mean"], F.lit(first_year), F.lit(last_year), whole_text(F.col("overall_mean"))),
        F.format_string(texts["trend"], F.lit(base_year), whole_text(F.col("base_mean")), F.lit(year),
                        whole_text(F.col("year_mean")), word),
    ).alias("insights"))


def insight_rows(predictions: DataFrame) -> DataFrame:
    """Yearly rollup with its sentence and the month of record."""
    rows = yearly_insight(predictions).join(peak_record(predictions).withColumnRenamed("peak_cases", "record_cases"), "county")
    return rows.withColumn("line", F.format_string(
        "%d: avg %s cases/mo, peak %s, high-risk months: %d",
        "year", whole_text(F.col("avg_cases")), whole_text(F.col("peak_cases")), "high_risk_months",
    ))


def anomaly_text(env: DataFrame) -> DataFrame:
    """Recent-versus-history anomalies with signed percent texts."""
    out = anomalies(env)
    return out.withColumns({
        f"{c}_text": signed_percent(half_up(F.col(f"{c}_anomaly"), 0)) for c in C.ANOMALY_FLOORS
    })


def risk_at(points: DataFrame, boxes: DataFrame, centers: DataFrame, latest: DataFrame, id: str = "id") -> DataFrame:
    """Current risk at each point."""
    from panelwatch.operators.geo import locate

    place = locate(points, boxes, centers).select(id, "county")
    return place.join(latest, "county", "left")


def place_overview(latest: DataFrame, env: DataFrame) -> DataFrame:
    """Current risk and newest environment of each place in one row."""
    newest = env.groupBy("county").agg(
        F.max_by(F.struct(
            "wind_speed_kmh", "pm10_ugm3", F.col("tmax_approx_c").alias("temperature_c"),
            F.col("precip_mm").alias("precipitation_mm"),
        ), F.col("date")).alias("_e")
    ).select("county", "_e.*")
    return latest.join(newest, "county", "left")


def risk_summary(overview: DataFrame, texts=C.SUMMARY_TEXTS, advice=C.ADVICE_TEXTS) -> DataFrame:
    """Rule bullets and advice per place; a reading of 0 counts as missing, except rain."""
    wind, pm10, temp = F.col("wind_speed_kmh"), F.col("pm10_ugm3"), F.col("temperature_c")
    rain, level = F.col("precipitation_mm"), F.col("risk_level")

    def told(key: str, value: Column) -> Column:
        return F.format_string(texts[key], half_up(value, 0))

    candidates = F.array(
        F.when(truthy(wind) & (wind > 20), told("wind_high", wind)).when(truthy(wind) & (wind < 10), told("wind_low", wind)),
        F.when(truthy(pm10) & (pm10 > 50), told("pm10_high", pm10)).when(truthy(pm10) & (pm10 < 20), told("pm10_low", pm10)),
        F.when(truthy(temp) & (temp > 35), told("temp_extreme", temp)).when(truthy(temp) & (temp > 25), told("temp_warm", temp)),
        F.when(rain > 5, F.lit(texts["rain"])).when(rain == 0, F.lit(texts["dry"])),
        F.when(level == "Very High", F.lit(texts["tier_very_high"])).when(level == "High", F.lit(texts["tier_high"])),
    )
    bullets = F.filter(candidates, lambda b: b.isNotNull())
    lists = {t: F.array(*[F.lit(a) for a in items]) for t, items in advice.items()}
    chosen = lists["other"]
    for t in ("Moderate", "High", "Very High"):
        chosen = F.when(level == t, lists[t]).otherwise(chosen)
    return overview.select(
        "county", "risk_level",
        F.when(F.size(bullets) == 0, F.array(F.lit(texts["default"]))).otherwise(bullets).alias("summary"),
        chosen.alias("advice"),
    )


def chart_series(history: DataFrame) -> DataFrame:
    """Chart points with a score, whole actual cases, and the last label with actuals per place."""
    actual = F.when(F.col("monthly_cases") > 0, half_up(F.col("monthly_cases"), 0).cast("long"))
    rows = history.filter(F.col("risk_score").isNotNull()).select(
        "county", month_index(F.col("year"), F.col("month")).alias("t"),
        month_label(F.col("year"), F.col("month")).alias("label"), "risk_score", actual.alias("actual"),
    )
    last = F.max(F.when(F.col("actual").isNotNull(), F.struct("t", "label"))).over(Window.partitionBy("county"))
    return rows.withColumn("cut_label", last["label"])
