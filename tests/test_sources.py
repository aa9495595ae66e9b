"""Readers on small files written by the tests."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from panelwatch.functions import text
from panelwatch.operators.stats import yearly_totals
from panelwatch.sources import places, readers, schemas, writers


def test_known_cases_totals(spark):
    cases = places.known_cases(spark)
    assert cases.count() == 48 and cases.filter("cases_source = 'provisional'").count() == 8
    assert {r.year: r.total_cases for r in yearly_totals(cases).collect()} == {
        2020: 3911, 2021: 4198, 2022: 3452, 2023: 4427, 2024: 6289, 2025: 3379}


def test_fixed_places(spark):
    assert places.facilities(spark).count() == 33 and places.zones(spark).count() == 50
    kern = readers.items_of(places.facilities(spark), "Kern").collect()
    assert len(kern) == 5 and kern[0].phone == "(661) 326-2000"
    assert readers.items_of(places.zones(spark), "Nowhere").count() == 0


def test_weather_csv_keeps_types_and_gaps(spark, tmp_path):
    path = tmp_path / "weather.csv"
    path.write_text("date,county,precip_mm,soil_moisture_m3m3,wind_speed_kmh,tmax_approx_c\n2024-01-02,Kern,1.5,,3,-2.5\n")
    row = readers.read_weather(spark, str(path)).first()
    assert (row.date, row.soil_moisture_m3m3, row.wind_speed_kmh) == (dt.date(2024, 1, 2), None, 3.0)


def test_master_codes_stay_text_through_csv(spark, tmp_path):
    df = spark.createDataFrame([(dt.date(2024, 1, 1), "Kern", "06029", 1.0, 2.0, 0.0, None, 1.0, 2.0, 3.0, 5, "x")], schemas.MASTER)
    writers.write_csv(df, str(tmp_path / "m"))
    assert readers.read_master(spark, str(tmp_path / "m")).collect() == df.collect()


def test_payload_rows_and_soil(spark, tmp_path):
    weather = {"county": "Kern", "daily": {"time": ["2024-01-01", "2024-01-02", "2024-01-03"], "precipitation_sum": [1.0, None, None],
                                           "wind_speed_10m_max": [5.0, 6.0, None], "temperature_2m_max": [20.0, None, None]}}
    soil = {"county": "Kern", "hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00", "2024-01-03T05:00"],
                                         "soil_moisture_0_to_7cm": [0.1, 0.3, None]}}
    (tmp_path / "w.json").write_text(json.dumps(weather))
    (tmp_path / "s.json").write_text(json.dumps(soil))
    days = readers.weather_rows(readers.read_weather_payload(spark, str(tmp_path / "w.json")))
    joined = readers.join_soil(days, readers.soil_days(readers.read_soil_payload(spark, str(tmp_path / "s.json"))))
    got = {r.date.day: (r.precip_mm, r.wind_speed_kmh, r.soil_moisture_m3m3) for r in joined.collect()}
    assert got[1] == (1.0, 5.0, pytest.approx(0.2)) and got[2] == (None, 6.0, None) and got[3] == (None, None, None)
    assert {r.date.day for r in readers.drop_empty_days(joined).collect()} == {1, 2}
    assert readers.join_soil(days, None).filter("soil_moisture_m3m3 IS NOT NULL").count() == 0


def test_pm10_bulk(spark, tmp_path):
    rows = ["State Code,County Code,Site,Parameter Code,Date Local,Arithmetic Mean",
            "06,029,1,81102,2024-01-01,10", "06,029,2,81102,2024-01-01,20", "06,029,1,81102,2024-01-02,1500",
            "06,029,1,81102,2024-01-03,1500.1", "06,029,1,81102,2024-01-03,-1", "06,029,1,81102,2024-01-03,bad",
            "06,001,1,81102,2024-01-01,10", "32,029,1,81102,2024-01-01,10", "06,029,1,44201,2024-01-01,10"]
    (tmp_path / "bulk.csv").write_text("\n".join(rows) + "\n")
    codes = spark.createDataFrame([("029", "Kern")], "code string, county string")
    readings = readers.pm10_readings(readers.read_pm10_bulk(spark, str(tmp_path / "bulk.csv")), codes)
    got = {r.date.day: r.pm10_ugm3 for r in readers.daily_monitor_mean(readings).collect()}
    assert got == {1: 15.0, 2: 1500.0}


def test_official_file_with_messy_header(spark):
    raw = spark.createDataFrame([(" san joaquin ", "2024", "239")], "` County` string, `YEAR ` string, `Case Count` string")
    row = readers.official_cases(raw).first()
    assert (row.county, row.year, row.case_count, row.cases_source) == ("San Joaquin", 2024, 239, "cdph_official")


def test_current_conditions_defaults(spark, tmp_path):
    full = {"county": "a", "current": {"temperature_2m": 30.0, "time": "t"}, "air": {"pm10": 12.0},
            "daily": {"temperature_2m_max": [35.0, 36.0], "precipitation_sum": [1.04, None, 2.0], "wind_speed_10m_max": []}}
    (tmp_path / "c.json").write_text(json.dumps(full) + "\n" + json.dumps({"county": "b"}) + "\n")
    rows = readers.current_conditions(spark.read.schema(schemas.CURRENT_PAYLOAD).json(str(tmp_path / "c.json")))
    a, b = rows.orderBy("county").collect()
    assert (a.temp_max_c, a.wind_max_kmh, a.precip_week_mm, a.pm10_ugm3, a.source) == (35.0, None, 3.0, 12.0, "live")
    assert (b.temperature_c, b.temp_max_c, b.precip_week_mm, b.source) == (None, None, 0.0, "unavailable")


def test_file_hashes_change_with_content(spark, tmp_path):
    import hashlib

    (tmp_path / "f.csv").write_bytes(b"a,b\n1,2\n")
    row = readers.content_hashes(readers.read_files(spark, str(tmp_path), "*.csv")).first()
    assert row.hash == hashlib.sha256(b"a,b\n1,2\n").hexdigest()


def test_text_helpers(spark):
    df = spark.createDataFrame([("San_Joaquin ",)], "n string")
    assert df.select(text.entity_key(F.col("n"))).first()[0] == "sanjoaquin"
    messages = spark.createDataFrame([("Any MASK or doctor?",), ("which doctor",), ("fluconazole mask",), ("hello ER",), ("cough",)], "t string")
    got = [(r[0], r[1]) for r in messages.select(text.route_intent(F.col("t")), text.needs_search(F.col("t"))).collect()]
    assert got == [("protection", True), ("clinic", True), ("medication", True), ("default", False), ("symptom", False)]
    filled = df.select(text.fill_template(F.lit("{a}-{b}-{a}"), {"a": F.lit("x"), "b": F.lit(None).cast("string")})).first()[0]
    assert filled == "x--x"
    label = spark.range(1).select(text.month_label(F.lit(2024), F.lit(1))).first()[0]
    assert label == "Jan'24"
