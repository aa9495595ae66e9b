"""Source queries: files are written from the given tables and read back through the readers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwatch.plans.registry import query
from panelwatch.session import scratch_path
from panelwatch.sources import readers, schemas, writers
from panelwatch.sources.standins import Standins

WEATHER = "county:s date:d precip_mm:f6 soil_moisture_m3m3:f6 wind_speed_kmh:f6 tmax_approx_c:f6"


def _csv(df: DataFrame, name: str) -> str:
    path = scratch_path(df.sparkSession, name)
    writers.write_csv(df, path)
    return path


@query("src1_weather_csv", WEATHER, "weather", "SELECT * FROM weather")
def src1(s: Standins) -> DataFrame:
    columns = [c.split()[0] for c in schemas.WEATHER.split(", ")]
    return readers.read_weather(s.spark, _csv(s.weather().select(*columns), "weather-csv"))


@query("src2_cases_csv", "county:s year:i case_count:l cases_source:s", "cases", "SELECT * FROM cases")
def src2(s: Standins) -> DataFrame:
    return readers.read_cases(s.spark, _csv(s.cases(), "cases-csv"))


@query("snk1_master_csv", "date:d county:s fips:s lat:f6 lon:f6 precip_mm:f6 pm10_ugm3:f6 case_count:l cases_source:s", "master",
       "SELECT * FROM master")
def snk1(s: Standins) -> DataFrame:
    return readers.read_master(s.spark, _csv(s.master(), "master-csv"))


@query("src3_weather_payload", "county:s date:d precip_mm:f6 wind_speed_kmh:f6 tmax_approx_c:f6", "user_days",
       "SELECT county, date, CASE WHEN total >= 20 THEN total END AS precip_mm, top AS wind_speed_kmh, low AS tmax_approx_c FROM user_days")
def src3(s: Standins) -> DataFrame:
    path = scratch_path(s.spark, "weather-json")
    s.weather_payload().write.json(path)
    return readers.weather_rows(readers.read_weather_payload(s.spark, path))


@query("src4_soil_daily", "county:s date:d precip_mm:f6 soil_moisture_m3m3:f6", "user_days user_hours", """
       SELECT d.county, d.date, CASE WHEN total >= 20 THEN total END AS precip_mm, soil AS soil_moisture_m3m3 FROM user_days d LEFT JOIN
       (SELECT county, CAST(h AS DATE) AS date, avg(v) AS soil FROM user_hours WHERE day(h) % 4 <> 0 GROUP BY 1, 2) USING (county, date)""")
def src4(s: Standins) -> DataFrame:
    path = scratch_path(s.spark, "soil-json")
    s.soil_payload().write.json(path)
    hourly = readers.read_soil_payload(s.spark, path)
    known = readers.soil_days(hourly).filter(F.day("date") % 4 != 0)
    return readers.join_soil(readers.weather_rows(s.weather_payload()), known)


def _pm10_bulk(s: Standins) -> DataFrame:
    """Lines as all-text bulk rows with other states, other parameters and bad values among them."""
    key = F.col("l_orderkey")
    value = F.when(key % 11 == 0, F.lit("n/a")).otherwise((F.floor(F.col("l_extendedprice") / 50) + 0.25).cast("string"))
    return s.table("lineitem").select(
        F.when(key % 4 == 0, F.lit("32")).otherwise(F.lit("06")).alias("State Code"),
        F.lpad((F.col("l_suppkey") % 40).cast("string"), 3, "0").alias("County Code"),
        F.when(key % 5 == 0, F.lit("44201")).otherwise(F.lit("81102")).alias("Parameter Code"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("Date Local"), F.lit("ug/m3").alias("Units of Measure"),
        value.alias("Arithmetic Mean"))


def _codes(s: Standins) -> DataFrame:
    return s.table("nation").select(F.lpad(F.col("n_nationkey").cast("string"), 3, "0").alias("code"), F.col("n_name").alias("county"))


_PM10 = ("SELECT n_name AS county, CAST(l_shipdate AS DATE) AS date, floor(l_extendedprice / 50) + 0.25e0 AS pm10_ugm3 FROM lineitem "
         "JOIN nation ON l_suppkey % 40 = n_nationkey WHERE l_orderkey % 4 <> 0 AND l_orderkey % 5 <> 0 AND l_orderkey % 11 <> 0 "
         "AND floor(l_extendedprice / 50) + 0.25e0 BETWEEN 0 AND 1500")


@query("src5_pm10_bulk", "county:s date:d pm10_ugm3:f2", "", _PM10)
def src5(s: Standins) -> DataFrame:
    bulk = readers.read_pm10_bulk(s.spark, _csv(_pm10_bulk(s), "pm10-csv"))
    return readers.pm10_readings(bulk, _codes(s))


@query("src6_monitor_mean", "county:s date:d pm10_ugm3:f6", "", f"SELECT county, date, avg(pm10_ugm3) AS pm10_ugm3 FROM ({_PM10}) GROUP BY 1, 2")
def src6(s: Standins) -> DataFrame:
    return readers.daily_monitor_mean(readers.pm10_readings(_pm10_bulk(s), _codes(s)))


@query("src7_official_cases", "county:s year:i case_count:l cases_source:s", "cases",
       "SELECT replace(county, 'NATION', 'Nation') AS county, year, case_count, 'cdph_official' AS cases_source FROM cases")
def src7(s: Standins) -> DataFrame:
    raw = s.cases().select(F.concat(F.lit(" "), F.lower("county"), F.lit("  ")).alias(" County "), F.col("year").alias("YEAR"),
                           F.col("case_count").alias("Case Count"))
    path = scratch_path(s.spark, "official-csv")
    raw.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return readers.official_cases(s.spark.read.option("header", True).csv(path))


@query("src8_nested_cases", "county:s year:i case_count:l cases_source:s", "cases", """
       SELECT replace(county, 'NATION', 'Nation') AS county, year, case_count, cases_source FROM cases
       UNION ALL SELECT replace(county, 'NATION', 'Nation'), 2001, sum(case_count), 'provisional' FROM cases GROUP BY county""")
def src8(s: Standins) -> DataFrame:
    cases = s.cases()
    nested = cases.groupBy("county").agg(  # one entry per year and place
        F.first("cases_source").alias("cases_source"), F.map_from_entries(F.collect_list(F.struct("year", "case_count"))).alias("by_year"))
    return readers.nested_cases(nested, cases.groupBy("county").agg(F.sum("case_count").alias("case_count")), 2001)


@query("src9_name_clean", "id:l county:s", "", "SELECT s_suppkey AS id, 'Supplier#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') || ' Of Nation_' || "
       "CAST(s_nationkey AS VARCHAR) AS county FROM supplier")
def src9(s: Standins) -> DataFrame:
    from panelwatch.functions.text import title_name

    raw = F.concat(F.lit("  "), F.upper("s_name"), F.lit(" of nation_"), F.col("s_nationkey").cast("string"), F.lit(" "))
    return s.table("supplier").select(F.col("s_suppkey").alias("id"), title_name(raw).alias("county"))


@query("src10_flatten_items", "county:s name:s type:s lat:f2", "facilities", "SELECT * FROM facilities")
def src10(s: Standins) -> DataFrame:
    return readers.flatten_items(s.facilities_nested())


@query("src11_items_of_place", "county:s name:s type:s", "facilities", "SELECT * FROM facilities WHERE county = 'NATION_3'")
def src11(s: Standins) -> DataFrame:
    return readers.items_of(s.facilities(), "NATION_3")


@query("src11_items_of_all", "county:s name:s has_items:b", "facilities",
       "SELECT n_name AS county, f.name, f.name IS NOT NULL AS has_items FROM nation LEFT JOIN (SELECT * FROM facilities WHERE type = 'hospital') f "
       "ON f.county = n_name")
def src11_all(s: Standins) -> DataFrame:
    places = s.table("nation").select(F.col("n_name").alias("county"))
    return readers.attach_items(places, s.facilities().filter("type = 'hospital'"), "name")


@query("src12_prediction_tables", "county:s year:i month:i monthly_cases:f6 predicted_cases:f6 risk_score:f6 predicted_risk:s", "predictions",
       "SELECT * FROM predictions")
def src12(s: Standins) -> DataFrame:
    columns = [c.split()[0] for c in schemas.INDEX_PREDICTIONS.split(", ")]
    path = scratch_path(s.spark, "predictions")
    writers.write_table(s.predictions().select(*columns), path)
    return readers.read_predictions(s.spark, path)


@query("hsh1_content_hash", "doc_id:l hash:s", "", "SELECT doc_id, sha256(text) AS hash FROM documents")
def hsh1(s: Standins) -> DataFrame:
    return readers.content_hashes(s.table("documents"), "text", ("doc_id",))


_BLOCKS = ("SELECT o_orderkey // 1000 AS block, count(*) AS rows, sha256(string_agg(CAST(o_orderkey AS VARCHAR) || '|' || CAST(o_custkey AS VARCHAR) || '|' || {status}, "
           "chr(10) ORDER BY o_orderkey)) AS hash FROM orders GROUP BY 1")


@query("hsh1_block_hash", "block:l rows:l hash:s", "", _BLOCKS.format(status="o_orderstatus"))
def hsh1_blocks(s: Standins) -> DataFrame:
    return readers.block_hashes(s.table("orders"), "o_orderkey", ["o_orderkey", "o_custkey", "o_orderstatus"], 1000)


@query("hsh1_changed_blocks", "block:l", "", "SELECT DISTINCT o_orderkey // 1000 AS block FROM orders WHERE o_orderkey % 1777 = 0")
def hsh1_changed(s: Standins) -> DataFrame:
    """Blocks that hold an order whose status was changed."""
    orders, columns = s.table("orders"), ["o_orderkey", "o_custkey", "o_orderstatus"]
    other = orders.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 1777 == 0, "X").otherwise(F.col("o_orderstatus")))
    return readers.changed_blocks(readers.block_hashes(orders, "o_orderkey", columns, 1000), readers.block_hashes(other, "o_orderkey", columns, 1000))


@query("hsh1_file_hash", "path:s hash:s")
def hsh1_files(s: Standins) -> DataFrame:
    """Files of the cases table, hashed as written."""
    path = scratch_path(s.spark, "hash-csv")
    writers.write_csv(s.cases(), path)
    return readers.content_hashes(readers.read_files(s.spark, path, "*.csv"))
