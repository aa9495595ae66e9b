"""Late and corrected days, freshness tables, replies and place names on small rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelwatch import constants as C
from panelwatch.operators import panel
from panelwatch.operators.quantiles import FEW_KEYS, exact_quantiles
from panelwatch.plans import serving
from panelwatch.session import drop_scratch, held, materialize, read_if_there, scratch_mark, scratch_path
from panelwatch.streaming import late, refresh, reports

DAYS = "county string, date date, precip_mm double, soil_moisture_m3m3 double, wind_speed_kmh double, tmax_approx_c double"


def day_rows(county, first, count, change=lambda i: 0.0):
    start = dt.date.fromisoformat(first)
    return [(county, start + dt.timedelta(days=9 * i), i % 7 + change(i), 0.2 + i % 3 / 10, 10.0 + i % 5, 20.0 + i % 4) for i in range(count)]


@pytest.fixture(scope="module")
def others(spark):
    air = spark.createDataFrame([(c, d, 5.0 + len(c)) for c, d, *_ in day_rows("A", "2020-01-01", 150) + day_rows("Bb", "2020-01-01", 150)],
                                "county string, date date, pm10_ugm3 double")
    cases = spark.createDataFrame([("A", y, 10 * y % 70, "reported") for y in range(2020, 2024)], "county string, year int, case_count long, cases_source string")
    meta = spark.createDataFrame([("A", "06001", 1.0, 2.0), ("Bb", "06002", 3.0, 4.0)], "county string, fips string, lat double, lon double")
    return air, cases, meta


def scratch(days, others):
    return panel.monthly_features(late.roll_up(days, *others), drop_incomplete=False)


def rows_of(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(sorted(df.columns)).collect()), key=repr)


LATE_LOADS = {
    "corrected_day": [("A", dt.date(2021, 3, 25), 99.0, None, 1.0, 2.0)],
    "new_days_of_two_places": [("A", dt.date(2022, 1, 2), 1.0, 0.5, 1.0, 2.0), ("Bb", dt.date(2020, 5, 3), 7.0, 0.1, 3.0, 4.0)],
    "new_place": [("New", dt.date(2021, 1, 2), 1.0, 0.5, 1.0, 2.0)],
    "month_before_all": [("A", dt.date(2019, 11, 2), 1.0, 0.5, 1.0, 2.0)],
    "same_as_stored": day_rows("A", "2020-01-01", 150)[40:45],
    "nothing": [],
}


@pytest.mark.parametrize("name", LATE_LOADS)
def test_late_load_equals_scratch(spark, others, name):
    days = spark.createDataFrame(day_rows("A", "2020-01-01", 150) + day_rows("Bb", "2020-01-01", 150), DAYS)
    incoming = spark.createDataFrame(LATE_LOADS[name], DAYS)
    stored = days.withColumn("load_id", F.lit(1).cast("long"))
    months = late.roll_up(days, *others)
    done = late.apply_late(stored, months, scratch(days, others), incoming.withColumn("load_id", F.lit(2).cast("long")), *others)
    merged = refresh.upsert(stored, incoming.withColumn("load_id", F.lit(2).cast("long"))).drop("load_id")
    assert rows_of(done.features) == rows_of(scratch(merged, others))
    restart = {r.county: r.restart for r in done.restart.collect()}
    changed = {} if name in ("same_as_stored", "nothing") else {c: min(d.year * 12 + d.month for k, d, *_ in LATE_LOADS[name] if k == c) for c, *_ in LATE_LOADS[name]}
    assert restart == changed


def test_late_stream_and_replayed_batch(spark, others):
    days = spark.createDataFrame(day_rows("A", "2020-01-01", 150) + day_rows("Bb", "2020-01-01", 150), DAYS)
    path = scratch_path(spark, "late-test")
    write = late.late_batch(path, *others)
    write(days, 0)
    merged = days
    for batch, name in enumerate(["corrected_day", "new_days_of_two_places", "same_as_stored"], 1):
        incoming = spark.createDataFrame(LATE_LOADS[name], DAYS)
        write(incoming, batch)
        write(incoming, batch)  # repeated after a failure
        stamped = merged.withColumn("load_id", F.lit(0)), incoming.withColumn("load_id", F.lit(1))
        merged = refresh.upsert(*stamped).drop("load_id")
        assert rows_of(late.current_features(spark, path)) == rows_of(scratch(merged, others))
    loads = {(r.load_id, r.county) for r in spark.read.parquet(f"{path}/features").select("load_id", "county").distinct().collect()}
    assert loads == {(0, "A"), (0, "Bb"), (1, "A"), (2, "A"), (2, "Bb")}


def test_only_touched_months_are_rolled_up(spark, others):
    days = spark.createDataFrame(day_rows("A", "2020-01-01", 150), DAYS)
    incoming = spark.createDataFrame(LATE_LOADS["corrected_day"], DAYS)
    touched = late.touched_months(late.changed_days(days, incoming))
    assert [tuple(r) for r in touched.collect()] == [("A", 2021, 3)]
    assert {(r.date.year, r.date.month) for r in late.days_of(days, touched).collect()} == {(2021, 3)}
    months = late.roll_up(days, *others)
    features = late.features_from(months, late.restart_points(touched))
    assert features.agg(F.min(F.col("year") * 12 + F.col("month"))).first()[0] == 2021 * 12 + 3


def test_place_names(spark):
    places = spark.createDataFrame([("San Joaquin",), ("NATION_1",), ("Kern",), ("KERN",)], "county string")
    typed = spark.createDataFrame([(i, n) for i, n in enumerate([" san_joaquin", "SANJOAQUIN", "nation 1", "kern", "Nowhere", None])], "id int, county string")
    got = {r.id: r.county for r in reports.resolve_place(typed, places).collect()}
    assert got == {0: "San Joaquin", 1: "San Joaquin", 2: "NATION_1", 3: "KERN", 4: "Nowhere", 5: None}
    assert {r.id for r in reports.resolve_place(typed, places, keep_unknown=False).collect()} == {0, 1, 2, 3}
    requests = spark.createDataFrame([("1", "Kern", "English", 1, 1), ("1", " k_ern", "HMONG", 2, 2)], "phone string, county string, language string, requested_at int, request_id int")
    assert [tuple(r) for r in reports.subscriptions(requests, places=places).collect()] == [("1", "KERN", "hmong")]


def test_replies(spark):
    latest = spark.createDataFrame([("A", "Very High"), ("B", "Low")], "county string, risk_level string")
    texts = ["Which MASK protects?", "fluconazole and a mask", "I cough", "Hospital near me", "hello", None]
    messages = spark.createDataFrame([(i, c, t) for i, t in enumerate(texts) for c in ("A", "B", None)], "id int, county string, text string")
    got = {(r.id, r.county): (r.intent, r.reply) for r in serving.rule_replies(messages, latest).collect()}
    assert [got[i, "A"][0] for i in range(6)] == ["protection", "medication", "symptom", "clinic", "default", "default"]
    assert got[0, "A"][1] == C.REPLY_TEXTS["protection"] + "\n⚠️ A County is currently at Very High risk — extra caution advised."
    assert got[0, "B"][1] == got[0, None][1] == C.REPLY_TEXTS["protection"] and got[1, "A"][1] == C.REPLY_TEXTS["medication"]


def test_case_file_freshness(spark):
    cases = spark.createDataFrame([(c, y, n) for c in "abcd" for y, n in ((2022, 5), (2023, 7))], "county string, year int, case_count long")
    files = refresh.case_files(cases)
    known = {r.county: r.hash for r in files.collect()}
    assert len(set(known.values())) == 1
    state = spark.createDataFrame([("a", known["a"], 2023), ("b", "old", 2023), ("c", known["c"], 2022), ("d", known["d"], None), ("e", None, None)],
                                  "county string, stored_hash string, stored_year int")
    got = {r.county: (r.reason, r.has_new_data) for r in refresh.case_file_freshness(state, files).collect()}
    assert got == {"a": ("none", False), "b": ("modified", True), "c": ("new_year", True), "d": ("none", False), "e": ("missing", True)}


def test_yearly_files(spark):
    state = spark.createDataFrame([(n, d) for n, d in (("new", None), ("old", dt.date(2023, 5, 1)), ("current", dt.date(2024, 1, 1)), ("prior", dt.date(2022, 12, 31)), ("none", None))],
                                  "source string, last_date date")
    files = spark.createDataFrame([("new", 2024), ("old", 2024), ("old", 2023), ("current", 2024), ("prior", 2023), ("none", 2020)], "source string, year int")
    got = {r.source: (r.year_available, r.has_new_data) for r in refresh.yearly_files(state, files, 2024).collect()}
    assert got == {"new": (2024, True), "old": (2024, True), "current": (2024, False), "prior": (2023, True), "none": (None, False)}


def test_first_load_wins(spark):
    rows = [("A", 2024, 1, 5.0, 0.5, None, 2), ("A", 2024, 1, 9.0, 0.1, 1.0, 1), ("A", 2024, 1, 8.0, 0.1, 1.0, 1)]
    df = spark.createDataFrame(rows, "county string, year int, month int, risk_score double, gpot double, erisk double, load_id int")
    assert [tuple(r) for r in serving.index_rows(df).collect()] == [("A", 2024, 1, 8.0, 0.1, 1.0)]
    assert [tuple(r) for r in serving.index_rows(df.drop("load_id")).collect()] == [("A", 2024, 1, 5.0, 0.5, None)]


def test_bounds_are_checked(spark):
    with pytest.raises(ValueError, match="few_keys"):
        exact_quantiles(spark.range(FEW_KEYS + 1).selectExpr("id AS k", "double(id) AS v"), "v", [0.5], ["k"], few_keys=True).collect()
    with pytest.raises(ValueError, match="more than 3 rows"):
        held(spark.range(4), 3)
    assert held(spark.range(3), 3).count() == 3 and read_if_there(spark, scratch_path(spark, "nothing")) is None


def test_scratch_tables_are_removed(spark):
    first = materialize(spark.range(3), "kept")
    mark = scratch_mark(spark)
    path = scratch_path(spark, "gone")
    spark.range(2).write.parquet(path)
    assert read_if_there(spark, path) is not None and drop_scratch(spark, mark) == 1
    assert read_if_there(spark, path) is None and first.count() == 3
