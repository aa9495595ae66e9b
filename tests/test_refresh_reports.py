"""Refresh rules, reports, badges, subscriptions; batch and stream agree."""

import datetime as dt

from pyspark.sql import functions as F

from panelwatch import constants as C
from panelwatch.streaming import refresh, reports

UTC = dt.timezone.utc
T0 = dt.datetime(2024, 1, 30, 12, 0, tzinfo=UTC)
REPORTS = "id long, county string, severity int, description string, reporter_id string, created_at timestamp"


def report_rows(n=30):
    return [(i, "Kern" if i % 3 else "Kings", i % 6 - 1, f"d{i}", f"r{i % 7}", T0 - dt.timedelta(hours=i)) for i in range(n)]


def test_severity_is_clamped(spark):
    got = {r.severity for r in reports.ingest(spark.createDataFrame(report_rows(), REPORTS)).collect()}
    assert got == {1, 2, 3}


def test_badge_at_exactly_three(spark):
    rows = [(1, "Kern", 1, "", "two", T0), (2, "Kern", 1, "", "two", T0)]
    rows += [(10 + i, "Kern", 1, "", "four", T0 + dt.timedelta(minutes=i)) for i in range(4)]
    df = spark.createDataFrame(rows, REPORTS)
    got = {r.reporter_id: (r.badge_count, r.community_shield) for r in reports.badges(df).collect()}
    assert got == {"two": (2, False), "four": (4, True)}
    awards = reports.badge_awards(df).collect()
    assert [(r.reporter_id, r.report_id) for r in awards] == [("four", 12)]


def test_recent_reports_window_limit_and_count(spark):
    df = spark.createDataFrame(report_rows(200), REPORTS)
    got = reports.recent_reports(df, F.lit("2024-01-30 12:00:00").cast("timestamp"), 24, 5).collect()
    kern = sorted((r.position, r.id) for r in got if r.county == "Kern")
    assert kern == [(1, 1), (2, 2), (3, 4), (4, 5), (5, 7)] and {r.listed for r in got} == {5}
    edge = reports.within_hours(df, F.lit("2024-01-30 12:00:00").cast("timestamp"), 24)
    assert edge.count() == 24  # a report of exactly 24 hours ago is out


def test_hot_place_keeps_whole_counts(spark):
    hot = spark.range(5000).selectExpr("id", "if(id % 3 = 0, 'cold', 'hot') county", "1 severity", "'' description",
                                       "concat('r', if(id % 2 = 0, 0, id)) reporter_id", "timestamp_seconds(1700000000 + id) created_at")
    got = {r.reporter_id: r.badge_count for r in reports.badges(hot).filter("reporter_id = 'r0'").collect()}
    assert got == {"r0": 2500}
    assert reports.badge_awards(hot).first().report_id == 4


def test_subscription_upsert(spark):
    rows = [("1", "Kern", "English", T0, 1), ("1", "Kern", "SPANISH", T0, 2), ("1", "Kings", "klingon", T0, 3)]
    df = spark.createDataFrame(rows, "phone string, county string, language string, requested_at timestamp, request_id long")
    got = {(r.phone, r.county): r.language for r in reports.subscriptions(df).collect()}
    assert got == {("1", "Kern"): "spanish", ("1", "Kings"): "english"}


def test_alerts_only_for_high_tiers(spark):
    subs = spark.createDataFrame([("1", "Kern", "english"), ("2", "Kings", "spanish")], "phone string, county string, language string")
    latest = spark.createDataFrame([("Kern", "Very High"), ("Kings", "Moderate")], "county string, risk_level string")
    row, = reports.alert_messages(subs, latest).collect()
    assert row.message == ("Alert: Very High Valley Fever risk in Kern County. " + C.ADVICE_TEXTS["Very High"][0] + " Stay safe.")


def test_place_names_are_resolved_or_kept(spark):
    df = spark.createDataFrame([("san_joaquin",), ("Elsewhere",)], "county string")
    known = spark.createDataFrame([("San Joaquin",)], "county string")
    assert [r.county for r in reports.resolve_place(df, known).collect()] == ["San Joaquin", "Elsewhere"]
    assert [r.county for r in reports.resolve_place(df, known, keep_unknown=False).collect()] == ["San Joaquin"]


def state(spark):
    return spark.createDataFrame([
        ("weather", dt.date(2024, 1, 10), T0 - dt.timedelta(hours=12), None), ("air_quality", None, T0 - dt.timedelta(days=8), None),
        ("cases", dt.date(2024, 1, 1), None, None),
    ], "source string, last_date date, last_check timestamp, last_run timestamp")


def test_due_is_strict(spark):
    got = {r.source: r.due for r in refresh.due_sources(state(spark), F.lit("2024-01-30 12:00:00").cast("timestamp")).collect()}
    assert got == {"weather": False, "air_quality": True, "cases": True}


def test_high_water(spark):
    available = spark.createDataFrame([("weather", dt.date(2024, 1, 10)), ("weather", dt.date(2024, 1, 9)), ("air_quality", dt.date(2020, 1, 1)),
                                       ("cases", dt.date(2024, 1, 2))], "source string, date date")
    got = {r.source: r.has_new_data for r in refresh.high_water(available, state(spark)).collect()}
    assert got == {"weather": False, "air_quality": True, "cases": True}


def test_next_load_needs_start_before_end(spark):
    days = spark.sql("SELECT explode(sequence(date'2024-01-01', date'2024-01-10')) date")
    mark = F.lit("2024-01-04").cast("date")
    assert refresh.next_load(days, mark, F.lit("2024-01-07").cast("date")).count() == 3
    assert refresh.next_load(days, mark, F.lit("2024-01-05").cast("date")).count() == 0


def test_upsert_is_idempotent(spark):
    schema = "county string, date date, v double, load_id long"
    old = spark.createDataFrame([("a", dt.date(2024, 1, 1), 1.0, 9), ("a", dt.date(2024, 1, 2), 2.0, 9)], schema)
    new = spark.createDataFrame([("a", dt.date(2024, 1, 2), 5.0, 1), ("a", dt.date(2024, 1, 3), 6.0, 1)], schema)
    once = refresh.upsert(old, new)
    assert sorted((r.date.day, r.v) for r in once.collect()) == [(1, 1.0), (2, 5.0), (3, 6.0)]
    assert sorted(refresh.upsert(once, new).collect()) == sorted(once.collect())


def test_yearly_files_and_cases_freshness(spark):
    files = spark.createDataFrame([(2023,), (2022,)], "year int")
    none = F.lit(None).cast("date")
    row = refresh.yearly_file_freshness(files, none, 2024).first()
    assert (row.year_available, row.has_new_data) == (2023, True)
    assert refresh.yearly_file_freshness(files, F.lit("2023-01-01").cast("date"), 2024).first().has_new_data is False
    assert refresh.yearly_file_freshness(files, none, 2030).first().has_new_data is False
    cases = spark.createDataFrame([(2024,)], "year int")
    assert refresh.cases_freshness(cases, 2024, F.lit("x"), "x").first().reason == "none"
    assert refresh.cases_freshness(cases, 2024, F.lit("y"), "x").first().reason == "modified"
    assert refresh.cases_freshness(cases, 2023).first().reason == "new_year"
    assert refresh.cases_freshness(cases, None).first().has_new_data is False
    assert refresh.cases_freshness(None, 2024, spark=spark).first().has_new_data is True


def test_stream_badges_equal_batch_over_several_runs(spark, tmp_path):
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.createDataFrame(report_rows(60), REPORTS)
    for part in range(3):
        df.filter(F.col("id") % 3 == part).coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(df.schema).parquet(inbox)
        refresh.run_to_end(reports.stream_badges(stream, out))
    columns = ["reporter_id", "badge_count", "last_report_at", "community_shield"]
    assert sorted(refresh.read_latest(spark, out, ["reporter_id"]).select(columns).collect()) == sorted(reports.badges(df).select(columns).collect())


def test_stream_upsert_takes_late_corrections(spark, tmp_path):
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "county string, date date, v double"
    loads = [[("a", dt.date(2024, 1, 1), 1.0), ("b", dt.date(2024, 1, 1), 2.0)], [("a", dt.date(2024, 1, 1), 9.0)]]
    for rows in loads:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)
        refresh.run_to_end(refresh.stream_upsert(spark.readStream.schema(schema).parquet(inbox), out))
    assert sorted((r.county, r.v) for r in refresh.read_latest(spark, out, ["county", "date"]).collect()) == [("a", 9.0), ("b", 2.0)]
    refresh.compact(spark, out, str(tmp_path / "small"), ["county", "date"])
    small = refresh.read_latest(spark, str(tmp_path / "small"), ["county", "date"])
    assert sorted((r.county, r.v) for r in small.collect()) == [("a", 9.0), ("b", 2.0)]


def test_repeated_batch_writes_the_same_rows(spark, tmp_path):
    write = refresh.append_batch(str(tmp_path))
    batch = spark.createDataFrame([("a", 1.0)], "county string, v double")
    for batch_id in (0, 1, 1):
        write(batch, batch_id)
    assert spark.read.parquet(str(tmp_path / "data")).count() == 2
