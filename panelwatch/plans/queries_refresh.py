"""Refresh, report, subscription and model queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwatch import constants as C
from panelwatch.functions import text
from panelwatch.operators import graph, models, panel, stats
from panelwatch.plans import serving
from panelwatch.plans.registry import query
from panelwatch.session import materialize, one_row, scratch_path, small_table
from panelwatch.sources.standins import REPORT_NOW, Standins
from panelwatch.streaming import late, refresh, reports


# --- refresh ----------------------------------------------------------------

def _available(s: Standins) -> DataFrame:
    def rows(source: str, table: str, ts: str) -> DataFrame:
        return s.table(table).select(F.lit(source).alias("source"), F.to_date(ts).alias("date"))

    return rows("weather", "orders", "o_orderdate").unionByName(rows("air_quality", "lineitem", "l_shipdate")).unionByName(
        rows("cases", "events", "ts"))


def _state(s: Standins) -> DataFrame:
    """Stored state with one source never loaded."""
    rows = [
        ("weather", "2001-01-01", "2024-01-29 12:00:00", "2024-01-29 00:00:00"),
        ("air_quality", "2010-01-01", "2024-01-01 00:00:00", "2024-01-28 00:00:00"),
        ("cases", None, None, None),
    ]
    return small_table(s.spark, rows, "source string, d string, c string, r string").select(
        "source", F.col("d").cast("date").alias("last_date"), F.col("c").cast("timestamp").alias("last_check"),
        F.col("r").cast("timestamp").alias("last_run"))


_STATE = ("(VALUES ('weather', DATE '2001-01-01', TIMESTAMP '2024-01-29 12:00:00', TIMESTAMP '2024-01-29 00:00:00'), "
          "('air_quality', DATE '2010-01-01', TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-28 00:00:00'), "
          "('cases', NULL, NULL, NULL)) st(source, last_date, last_check, last_run)")
_AVAILABLE = ("SELECT 'weather' AS source, max(CAST(o_orderdate AS DATE)) AS latest FROM orders UNION ALL SELECT 'air_quality', "
              "max(CAST(l_shipdate AS DATE)) FROM lineitem UNION ALL SELECT 'cases', max(CAST(ts AS DATE)) FROM events")


@query("inc1_high_water", "source:s latest_available:d our_latest:d has_new_data:b", "",
       f"SELECT a.source, latest AS latest_available, last_date AS our_latest, last_date IS NULL OR latest > last_date AS has_new_data FROM ({_AVAILABLE}) a "
       f"LEFT JOIN {_STATE} ON st.source = a.source")
def inc1(s: Standins) -> DataFrame:
    return refresh.high_water(_available(s), _state(s))


@query("inc2_due_sources", "county:s due:b", "cases", """
       SELECT county || ':' || CAST(year AS VARCHAR) AS county, CASE WHEN case_count % 7 = 0 THEN TRUE ELSE (CASE CAST(case_count % 3 AS INTEGER) WHEN 0 THEN 12 WHEN 1 THEN 168 ELSE 720 END)
       < case_count * 4 END AS due FROM cases""")
def inc2(s: Standins) -> DataFrame:
    """One state row per place and year; the last check lies four hours back per case."""
    now = F.lit(REPORT_NOW).cast("timestamp")
    kinds = F.array(*[F.lit(k) for k in C.REFRESH_CADENCE_HOURS])
    state = s.cases().select(
        F.concat_ws(":", "county", "year").alias("county"), kinds[(F.col("case_count") % 3).cast("int")].alias("source"),
        F.when(F.col("case_count") % 7 != 0, now - F.make_dt_interval(hours=(F.col("case_count") * 4).cast("int"))).alias("last_check"))
    return refresh.due_sources(state, now)


def _loads(s: Standins) -> tuple[DataFrame, DataFrame]:
    days = s.weather().select("county", "date", "precip_mm")
    stored = days.filter("date <= '1999-12-31'").withColumn("load_id", F.lit(1).cast("long"))
    fresh = days.filter("date >= '1999-12-15'").withColumn("precip_mm", F.col("precip_mm") + 1).withColumn("load_id", F.lit(2).cast("long"))
    return stored, fresh


@query("inc3_append_after_mark", "county:s date:d precip_mm:f6", "weather",
       "SELECT county, date, precip_mm FROM weather WHERE date BETWEEN DATE '2000-01-01' AND DATE '2001-06-30'")
def inc3(s: Standins) -> DataFrame:
    return refresh.next_load(s.weather(), F.lit("1999-12-31").cast("date"), F.lit("2001-06-30").cast("date"))


@query("inc3_upsert", "county:s date:d precip_mm:f6 load_id:l", "weather",
       "SELECT county, date, CASE WHEN date >= DATE '1999-12-15' THEN precip_mm + 1 ELSE precip_mm END AS precip_mm, "
       "CASE WHEN date >= DATE '1999-12-15' THEN 2 ELSE 1 END AS load_id FROM weather")
def inc3_upsert(s: Standins) -> DataFrame:
    return refresh.upsert(*_loads(s))


@query("inc4_replace_years", "county:s date:d precip_mm:f6 load_id:l", "weather",
       "SELECT county, date, precip_mm, 1 AS load_id FROM weather WHERE year(date) <= 1998 UNION ALL "
       "SELECT county, date, precip_mm + 1, 2 FROM weather WHERE date >= DATE '1999-12-15'")
def inc4(s: Standins) -> DataFrame:
    return refresh.replace_years(*_loads(s))


@query("joi6_anti_join_years", "county:s date:d precip_mm:f6", "weather",
       "SELECT county, date, precip_mm FROM weather WHERE date <= DATE '1999-12-31' AND year(date) NOT IN (SELECT year(date) FROM weather WHERE date >= DATE '1999-12-15')")
def joi6(s: Standins) -> DataFrame:
    stored, fresh = _loads(s)
    return refresh.replace_years(stored, fresh).filter("load_id = 1")


@query("inc4_years_to_fetch", "year:i", "air",
       "SELECT y AS year FROM range(1993, 2004) r(y) WHERE y NOT IN (SELECT year(date) FROM air) OR y >= 2002")
def inc4_years(s: Standins) -> DataFrame:
    return refresh.years_to_fetch(s.air(), 1993, 2003)


@query("inc4_partition_overwrite", "county:s date:d precip_mm:f6 load_id:l", "weather",
       "SELECT county, date, precip_mm, 1 AS load_id FROM weather WHERE year(date) <= 1998 UNION ALL "
       "SELECT county, date, precip_mm + 1, 2 FROM weather WHERE date >= DATE '1999-12-15'")
def inc4_overwrite(s: Standins) -> DataFrame:
    from panelwatch.sources.writers import replace_years

    path = scratch_path(s.spark, "by-year")
    for load in _loads(s):
        replace_years(load, path)
    return s.spark.read.parquet(path)


@query("inc5_yearly_files", "year_available:i has_new_data:b", "air",
       "SELECT CASE WHEN count(*) FILTER (year(date) = 2001) > 0 THEN 2001 WHEN count(*) FILTER (year(date) = 2000) > 0 THEN 2000 END AS year_available, TRUE AS has_new_data FROM air")
def inc5(s: Standins) -> DataFrame:
    """Year folders of a partitioned table stand for the yearly files."""
    path = scratch_path(s.spark, "yearly")
    s.air().withColumn("year", F.year("date")).write.partitionBy("year").parquet(path)
    files = s.spark.read.parquet(path).select("year").distinct()
    return refresh.yearly_file_freshness(files, F.lit("2000-06-30").cast("date"), 2001)


@query("inc6_cases_freshness", "has_new_data:b reason:s max_year:i", "cases",
       "SELECT max(year) > 1999 AS has_new_data, 'new_year' AS reason, max(year) AS max_year FROM cases")
def inc6(s: Standins) -> DataFrame:
    return refresh.cases_freshness(s.cases(), 1999)


_FILE_STATES = """SELECT county, CASE WHEN ord % 4 <> 3 THEN make_date(CAST(1998 + ord % 4 AS INTEGER), 1, 1) + CAST(ord AS INTEGER) END AS last_date FROM meta"""
_FILE_YEARS = "SELECT DISTINCT a.county, year(a.date) AS year FROM air a JOIN meta m ON a.county = m.county WHERE year(a.date) < 1999 + m.ord % 3"


@query("inc5_file_states", "county:s last_date:d year_available:i has_new_data:b", "air meta", f"""
       SELECT *, year_available IS NOT NULL AND (last_date IS NULL OR last_date < make_date(year_available, 1, 1)) AS has_new_data FROM (
         SELECT s.county, s.last_date, CAST(CASE WHEN bool_or(f.year = 2000) THEN 2000 WHEN bool_or(f.year = 1999) THEN 1999 END AS INTEGER) AS year_available
         FROM ({_FILE_STATES}) s LEFT JOIN ({_FILE_YEARS}) f ON s.county = f.county GROUP BY 1, 2)""")
def inc5_states(s: Standins) -> DataFrame:
    """One state per place: loaded to different days or never; some have this year's file, some last year's, some neither."""
    k = F.col("ord").cast("int")
    state = s.meta().select("county", F.when(k % 4 != 3, F.date_add(F.make_date(1998 + k % 4, F.lit(1), F.lit(1)), k)).alias("last_date"))
    files = (s.air().select("county", F.year("date").alias("year")).distinct().join(s.meta().select("county", "ord"), "county")
             .filter(F.col("year") < 1999 + F.col("ord") % 3).select("county", "year"))
    return refresh.yearly_files(state, files, 2000, "county")


_CASE_FILES = ("SELECT county, sha256(string_agg(lpad(CAST(year AS VARCHAR), 4, '0') || ':' || CAST(case_count AS VARCHAR), chr(10) ORDER BY year)) AS hash, "
               "max(year) AS max_year FROM cases GROUP BY county")


@query("inc6_case_files", "county:s reason:s has_new_data:b max_year:i", "cases meta", f"""
       SELECT county, reason, reason <> 'none' AS has_new_data, max_year FROM (
         SELECT m.county, CASE WHEN m.ord % 5 = 4 THEN NULL ELSE f.max_year END AS max_year,
                CASE WHEN m.ord % 5 = 4 OR f.hash IS NULL THEN 'missing' WHEN m.ord % 5 = 3 THEN 'modified'
                     WHEN m.ord % 5 = 2 AND f.max_year > 1999 THEN 'new_year' ELSE 'none' END AS reason
         FROM meta m LEFT JOIN ({_CASE_FILES}) f ON f.county = m.county)""")
def inc6_files(s: Standins) -> DataFrame:
    """Stored hashes are today's, but for one place in five; one in five has an older stored year, one in five no table yet."""
    order = s.meta().select("county", "ord")
    files = materialize(refresh.case_files(s.cases()), "case-files")
    state = order.join(files, "county", "left").select(
        "county", F.when(F.col("ord") % 5 == 3, F.lit("before")).otherwise(F.col("hash")).alias("stored_hash"),
        F.when(F.col("ord") % 5 == 2, 1999).when(F.col("ord") % 5 == 1, F.lit(0)).otherwise(F.col("max_year")).alias("stored_year"))
    there = files.join(order, "county").filter(F.col("ord") % 5 != 4).drop("ord")
    return refresh.case_file_freshness(state, there)


_LATE = "county <> 'NATION_7' AND date BETWEEN DATE '1998-03-20' AND DATE '1998-04-10' AND (day(date) + length(county)) % 3 <> 0"
_FEATURE_COLUMNS = ("precip_mm:f6 soil_moisture_m3m3:f6 wind_speed_kmh:f6 pm10_ugm3:f6 monthly_cases:f6 precip_lag3:f6 precip_lag18:f6 "
                    "sm_lag6:f6 tmax_lag6:f6 wind_roll3:f6 pm10_roll3:f6 soil_aridity:f6")


def _late_load(s: Standins) -> tuple[DataFrame, DataFrame]:
    """Days as first stored, and the later load that corrects them: a third of the late days was missing, a third wrong."""
    kind = (F.day("date") + F.length("county")) % 3
    late = (F.col("county") != "NATION_7") & F.col("date").between("1998-03-20", "1998-04-10")
    days = s.weather()
    stored = days.filter(~(late & (kind == 1))).withColumn("precip_mm", F.when(late & (kind == 2), F.col("precip_mm") * 3 + 1).otherwise(F.col("precip_mm")))
    return stored, days.filter(late)


def _late_tables(s: Standins) -> tuple[Standins, DataFrame, DataFrame]:
    shared = s.shared()
    stored, incoming = _late_load(shared)
    return shared, stored, incoming


@query("inc3_late_features", f"county:s year:i month:i recomputed:b {_FEATURE_COLUMNS}", "features_all weather", f"""
       SELECT f.*, coalesce(f.year * 12 + f.month >= r.restart, FALSE) AS recomputed FROM features_all f LEFT JOIN
         (SELECT county, min(year(date) * 12 + month(date)) AS restart FROM weather WHERE {_LATE} GROUP BY county) r ON r.county = f.county""")
def inc3_late(s: Standins) -> DataFrame:
    """Stored tables are built on the wrong days; the late load leaves them as if all days had been right from the start."""
    s, stored, incoming = _late_tables(s)
    others = s.air(), s.cases(), s.meta()
    days = materialize(stored.withColumn("load_id", F.lit(1).cast("long")), "days")
    months = materialize(late.roll_up(days.drop("load_id"), *others), "months")
    features = materialize(panel.monthly_features(months, drop_incomplete=False), "features")
    done = late.apply_late(days, months, features, incoming.withColumn("load_id", F.lit(2).cast("long")), *others)
    t = F.col("year") * 12 + F.col("month")
    return done.features.join(done.restart, "county", "left").withColumn("recomputed", F.coalesce(t >= F.col("restart"), F.lit(False)))


@query("inc3_late_features_stream", f"county:s year:i month:i {_FEATURE_COLUMNS}", "features_all", "SELECT * FROM features_all")
def inc3_late_stream(s: Standins) -> DataFrame:
    """The stored days arrive as the first batch, the late ones as the second."""
    s, stored, incoming = _late_tables(s)
    inbox, path = scratch_path(s.spark, "late-inbox"), refresh.stream_table(s.spark, "late")
    for load in (stored, incoming):
        load.write.mode("append").parquet(inbox)
        stream = s.spark.readStream.schema(load.schema).parquet(inbox)
        refresh.run_to_end(late.stream_late(stream, path, s.air(), s.cases(), s.meta()))
    return late.current_features(s.spark, path)


@query("stmf_status", "last_pipeline_run:t weather_last_check:t air_quality_last_check:t cases_last_check:t weather_through:d air_quality_through:d cases_through:d",
       "", f"""SELECT max(last_run) AS last_pipeline_run, max(last_check) FILTER (st.source = 'weather') AS weather_last_check,
       max(last_check) FILTER (st.source = 'air_quality') AS air_quality_last_check, max(last_check) FILTER (st.source = 'cases') AS cases_last_check,
       max(latest) FILTER (st.source = 'weather') AS weather_through, max(latest) FILTER (st.source = 'air_quality') AS air_quality_through,
       max(latest) FILTER (st.source = 'cases') AS cases_through FROM {_STATE} JOIN ({_AVAILABLE}) a ON a.source = st.source""")
def stmf(s: Standins) -> DataFrame:
    """State after a load: dates move to what is available."""
    marks = refresh.high_water(_available(s), _state(s)).select("source", F.col("latest_available").alias("last_date"))
    return refresh.status(_state(s).drop("last_date").join(marks, "source"))


# --- reports and subscriptions ----------------------------------------------

def _places(s: Standins) -> DataFrame:
    return small_table(s.spark, [(row[0],) for row in C.COUNTY_META], "county string")


def _reports(s: Standins) -> DataFrame:
    """Reports with typed place names resolved and severities in range."""
    return reports.ingest(s.reports_raw(), places=_places(s))


@query("stma_report_ingest", "id:l county:s severity:i reporter_id:s created_at:t", "reports", "SELECT * FROM reports")
def stma(s: Standins) -> DataFrame:
    return _reports(s)


_BADGES = ("SELECT reporter_id, count(*) AS badge_count, max(created_at) AS last_report_at, count(*) >= 3 AS community_shield FROM reports GROUP BY 1")


@query("stmb_badges", "reporter_id:s badge_count:l last_report_at:t community_shield:b", "reports", _BADGES)
def stmb(s: Standins) -> DataFrame:
    return reports.badges(s.reports_raw())


@query("stmb_badge_awards", "reporter_id:s report_id:l awarded_at:t", "reports",
       "SELECT reporter_id, id AS report_id, created_at AS awarded_at FROM reports QUALIFY row_number() OVER (PARTITION BY reporter_id ORDER BY created_at, id) = 3")
def stmb_awards(s: Standins) -> DataFrame:
    return reports.badge_awards(s.reports_raw())


_TRAILING = f"created_at > TIMESTAMP '{REPORT_NOW}' - INTERVAL 24 HOUR"


@query("stmc_recent_reports", "county:s id:l severity:i created_at:t position:i listed:l", "reports",
       f"SELECT *, count(*) OVER (PARTITION BY county) AS listed FROM (SELECT county, id, severity, created_at, row_number() OVER (PARTITION BY county "
       f"ORDER BY created_at DESC, id DESC) AS position FROM reports WHERE {_TRAILING}) WHERE position <= 5")
def stmc(s: Standins) -> DataFrame:
    return reports.recent_reports(_reports(s), F.lit(REPORT_NOW).cast("timestamp"), 24, 5)


@query("dat2_trailing_hours", "id:l created_at:t", "reports", f"SELECT id, created_at FROM reports WHERE {_TRAILING}")
def dat2(s: Standins) -> DataFrame:
    return reports.within_hours(s.reports_raw(), F.lit(REPORT_NOW).cast("timestamp"), 24)


@query("srt2_latest_reports", "id:l county:s created_at:t", "reports", "SELECT * FROM reports ORDER BY created_at DESC, id DESC LIMIT 20")
def srt2(s: Standins) -> DataFrame:
    return reports.latest_reports(_reports(s))


@query("srt3_first_three", "county:s id:l position:i", "reports",
       "SELECT county, id, position FROM (SELECT county, id, row_number() OVER (PARTITION BY county ORDER BY created_at DESC, id DESC) AS position FROM reports) WHERE position <= 3")
def srt3(s: Standins) -> DataFrame:
    return reports.recent_reports(_reports(s), F.lit(REPORT_NOW).cast("timestamp"), 24 * 365, 3)


@query("stmd_subscriptions", "phone:s county:s language:s", "subs", "SELECT * FROM subs")
def stmd(s: Standins) -> DataFrame:
    return _subscriptions(s)


def _subscriptions(s: Standins) -> DataFrame:
    return reports.subscriptions(s.subscription_requests(), places=s.meta())


@query("stme_alert_messages", "phone:s county:s language:s risk_level:s message:s", "subs latest",
       "SELECT phone, county, language, risk_level, replace(replace(replace(CASE language " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.ALERT_LANGUAGES.items())
       + " END, '{risk_level}', risk_level), '{county}', county), '{advice}', CASE risk_level WHEN 'High' THEN '" + C.ADVICE_TEXTS["High"][0]
       + "' ELSE '" + C.ADVICE_TEXTS["Very High"][0] + "' END) AS message FROM subs JOIN latest USING (county) WHERE risk_level IN ('High', 'Very High')")
def stme(s: Standins) -> DataFrame:
    latest = serving.latest_risk(s.predictions(), s.meta())
    return reports.alert_messages(_subscriptions(s), latest)


# --- the same on streams ----------------------------------------------------

def _report_stream(s: Standins) -> DataFrame:
    """Error events as a file stream, shaped like the batch reports."""
    events = s.table("events")
    stream = s.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 8).parquet(s.path("events")[:-1] + "[t]")
    return s.reports_raw(stream)


@query("stma_report_ingest_stream", "id:l county:s severity:i reporter_id:s created_at:t", "reports", "SELECT * FROM reports")
def stma_stream(s: Standins) -> DataFrame:
    path = refresh.stream_table(s.spark, "ingest")
    refresh.run_to_end(reports.stream_ingest(_report_stream(s), path, places=_places(s)))
    return s.spark.read.parquet(f"{path}/data")


@query("stmb_badges_stream", "reporter_id:s badge_count:l last_report_at:t community_shield:b", "reports", _BADGES)
def stmb_stream(s: Standins) -> DataFrame:
    path = refresh.stream_table(s.spark, "badges")
    refresh.run_to_end(reports.stream_badges(_report_stream(s), path))
    return refresh.read_latest(s.spark, path, ["reporter_id"])


_WINDOWS = ("SELECT county, w AS window_start, w + INTERVAL 24 HOUR AS window_end, count(*) AS reports, max(severity) AS max_severity FROM reports, "
            "range(0, 24) o(h), LATERAL (SELECT date_trunc('hour', created_at) - to_hours(CAST(h AS INTEGER)) AS w) GROUP BY 1, 2, 3")


@query("stmc_window_counts", "county:s window_start:t window_end:t reports:l max_severity:i", "reports", _WINDOWS)
def stmc_windows(s: Standins) -> DataFrame:
    return reports.windowed_counts_of_table(_reports(s))


@query("stmc_window_counts_stream", "county:s window_start:t window_end:t reports:l max_severity:i", "reports",
       f"SELECT * FROM ({_WINDOWS}) WHERE window_end <= (SELECT max(created_at) FROM reports) - INTERVAL 2 HOUR")
def stmc_stream(s: Standins) -> DataFrame:
    """Only windows the watermark has closed are written."""
    path = refresh.stream_table(s.spark, "windows")
    refresh.run_to_end(reports.stream_windowed_counts(reports.ingest(_report_stream(s), places=_places(s)), path))
    return s.spark.read.parquet(f"{path}/data")


@query("inc3_upsert_stream", "county:s date:d precip_mm:f6", "weather",
       "SELECT county, date, CASE WHEN date >= DATE '1999-12-15' THEN precip_mm + 1 ELSE precip_mm END AS precip_mm FROM weather")
def inc3_stream(s: Standins) -> DataFrame:
    """Two loads arrive as two batches; the later one wins."""
    inbox, path = scratch_path(s.spark, "inbox"), refresh.stream_table(s.spark, "weather")
    for load in _loads(s):
        load.drop("load_id").write.mode("append").parquet(inbox)
        stream = s.spark.readStream.schema("county string, date date, precip_mm double").parquet(inbox)
        refresh.run_to_end(refresh.stream_upsert(stream, path))
    return refresh.read_latest(s.spark, path, ["county", "date"])


# --- models -----------------------------------------------------------------

def _region_features(s: Standins) -> DataFrame:
    return materialize(s.features(False).fillna(0.0), "features")


@query("ml1_standardize", "county:s year:i month:i std_precip_mm:f6 std_sm_lag6:f6 std_month:f6", "features_all",
       "SELECT county, year, month, " + ", ".join(f"(x_{c} - m_{c}) / s_{c} AS std_{c}" for c in ("precip_mm", "sm_lag6", "month"))
       + " FROM (SELECT county, year, month, precip_mm AS x_precip_mm, coalesce(sm_lag6, 0) AS x_sm_lag6, month AS x_month FROM features_all), (SELECT "
       + ", ".join(f"avg(coalesce({c}, 0)) AS m_{c}, stddev_samp(coalesce({c}, 0)) AS s_{c}" for c in ("precip_mm", "sm_lag6", "month")) + " FROM features_all)")
def ml1(s: Standins) -> DataFrame:
    return models.standardized_columns(_region_features(s))


_HELD_OUT = ("SELECT county, year, month, monthly_cases, TRUE AS predicted, (SELECT count(*) FROM features_all) AS n, "
             "(SELECT count(DISTINCT county) FROM features_all) AS places, TRUE AS better_than_mean FROM features_all")
_HELD_OUT_COLUMNS = "county:s year:i month:i monthly_cases:f6 predicted:b n:l places:l better_than_mean:b"


def _held_out(s: Standins, estimator) -> DataFrame:
    """Every month with whether it has a prediction by a model without its place, and the report over all of them.

    SQL gives no predicted values; their errors are compared with those of the other places' mean.
    """
    rows = models.leave_out_predict(_region_features(s), estimator, parallel=8)
    report = one_row(models.leave_out_report(rows))
    x = F.col("predicted_cases")
    return rows.select("county", "year", "month", "monthly_cases", (x.isNotNull() & ~F.isnan(x)).alias("predicted"),
                       *[F.lit(report[k]).alias(n) for k, n in (("n", "n"), ("entities", "places"), ("better_than_mean", "better_than_mean"))])


@query("ml2_forest_leave_out", _HELD_OUT_COLUMNS, "features_all", _HELD_OUT)
def ml2(s: Standins) -> DataFrame:
    """A fit of 200 trees of depth 10 for each place."""
    return _held_out(s, models.forest())


@query("ml3_boosting_leave_out", _HELD_OUT_COLUMNS, "features_all", _HELD_OUT)
def ml3(s: Standins) -> DataFrame:
    """A fit of 20 rounds of depth 5 for each place: rounds follow one another, and the default of 200 takes ten times as long."""
    return _held_out(s, models.boosting(rounds=20))


@query("ml4_feature_importance", "ranked:l known:b falling:b within_one:b", "features_all",
       f"SELECT least(10, {len(C.MODEL_FEATURES)}) AS ranked, TRUE AS known, TRUE AS falling, count(*) > 0 AS within_one FROM features_all")
def ml4(s: Standins) -> DataFrame:
    """The ten most important of the model's features over all rows: names, order and sum are checked, no SQL gives the values."""
    top = models.feature_importance(_region_features(s), models.forest())
    listed = F.array_agg(F.struct("importance", "feature"))
    ordered = F.reverse(F.array_sort(F.transform(listed, lambda x: x["importance"])))
    return top.agg(
        F.count("*").alias("ranked"), F.bool_and(F.col("feature").isin(list(C.MODEL_FEATURES))).alias("known"),
        (F.transform(listed, lambda x: x["importance"]) == ordered).alias("falling"),
        (F.sum("importance").between(0.0, 1.0 + 1e-9)).alias("within_one"))


# the first six steps only fill windows; four fifths of the others are for training
_TEST_CELLS = """
       SELECT c.county, p.step - 6 - p.n * 4 // 5 AS test_sample, coalesce(m.monthly_cases, 0) AS actual_cases
       FROM (SELECT DISTINCT county FROM monthly) c
       CROSS JOIN (SELECT year, month, row_number() OVER (ORDER BY year, month) - 1 AS step, count(*) OVER () - 6 AS n
                   FROM (SELECT DISTINCT year, month FROM monthly WHERE year <= 1999)) p
       LEFT JOIN monthly m ON m.county = c.county AND m.year = p.year AND m.month = p.month
       WHERE p.step - 6 >= p.n * 4 // 5"""


def _chain(s: Standins) -> DataFrame:
    months = s.monthly_table().fillna(0.0, C.MEASURES)
    return materialize(models.forecast_chain(months, graph.normalized_adjacency(s.nation_edges()), C.MEASURES, 1999), "chain")


@query("ml6_graph_forecast", "county:s test_sample:l actual_cases:f6 has_prediction:b residual_fits:b tier_fits:b score_method:s", "monthly",
       f"SELECT *, TRUE AS has_prediction, TRUE AS residual_fits, TRUE AS tier_fits, 'case_percentile' AS score_method FROM ({_TEST_CELLS})")
def ml6(s: Standins) -> DataFrame:
    """Everything but the predicted values, which no SQL gives: those are checked against the rest of their row.

    The tiers' limits are scores of 3, 8 and 15 (a score may reach the next limit by rounding).
    """
    score, x = F.col("risk_score"), F.col("predicted_cases")
    low = F.element_at(text.literal_map(dict(zip(C.TIERS, (0.0, 3.0, 8.0, 15.0)))), F.col("predicted_risk"))
    high = F.element_at(text.literal_map(dict(zip(C.TIERS, (3.0, 8.0, 15.0, 25.0)))), F.col("predicted_risk"))
    return _chain(s).select(
        "county", "test_sample", "actual_cases", (x.isNotNull() & ~F.isnan(x)).alias("has_prediction"),
        (F.abs(F.col("actual_cases") - x - F.col("residual")) < 1e-6).alias("residual_fits"), score.between(low, high).alias("tier_fits"), "score_method")


@query("ml6_forecast_report", "county:s n:l mean_actual:f6 has_errors:b", "monthly",
       f"SELECT county, count(*) AS n, avg(actual_cases) AS mean_actual, TRUE AS has_errors FROM ({_TEST_CELLS}) GROUP BY county "
       f"UNION ALL SELECT 'all', count(*), avg(actual_cases), TRUE FROM ({_TEST_CELLS})")
def ml6_report(s: Standins) -> DataFrame:
    """Errors of the forecast per place and over all."""
    chain = _chain(s)
    each = chain.select("county", "actual_cases", "predicted_cases").unionByName(chain.select(F.lit("all").alias("county"), "actual_cases", "predicted_cases"))
    metrics = stats.regression_metrics(each, keys=["county"])
    fits = (F.col("rmse") >= F.col("mae") - 1e-9) & (F.abs(F.col("mae") - F.col("place_mae")) < 1e-9) & (F.coalesce("r2", F.lit(0.0)) <= 1)
    return metrics.join(stats.entity_performance(each).withColumnRenamed("mae", "place_mae"), "county").select("county", "n", "mean_actual", fits.alias("has_errors"))
