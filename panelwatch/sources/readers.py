"""Readers and source normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from panelwatch import constants as C
from panelwatch.functions.text import clean_header, title_name
from panelwatch.sources import schemas as S


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and ISO dates under an explicit schema."""
    return spark.read.schema(schema).option("header", True).option("dateFormat", "yyyy-MM-dd").csv(path)


def read_weather(spark, path: str) -> DataFrame:
    return read_csv(spark, path, S.WEATHER)


def read_air(spark, path: str) -> DataFrame:
    return read_csv(spark, path, S.AIR)


def read_cases(spark, path: str) -> DataFrame:
    return read_csv(spark, path, S.CASES)


def read_master(spark, path: str) -> DataFrame:
    """Daily master; codes stay text, so leading zeros survive."""
    return read_csv(spark, path, S.MASTER)


def read_predictions(spark, path: str, schema: str = S.INDEX_PREDICTIONS) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def read_predictions_csv(spark, path: str, schema: str = S.CASE_PREDICTIONS) -> DataFrame:
    return read_csv(spark, path, schema)


def read_polygons(spark, path: str) -> DataFrame:
    """One JSON feature per line; coordinates are kept as text until the type is known."""
    return spark.read.schema(S.POLYGONS).json(path)


# --- weather payloads -------------------------------------------------------

def read_weather_payload(spark, path: str) -> DataFrame:
    return spark.read.schema(S.WEATHER_PAYLOAD).json(path)


def read_soil_payload(spark, path: str) -> DataFrame:
    return spark.read.schema(S.SOIL_PAYLOAD).json(path)


def weather_rows(payload: DataFrame) -> DataFrame:
    """Parallel arrays of a payload as one row per day."""
    zipped = F.arrays_zip(
        F.col("daily.time").alias("time"), F.col("daily.precipitation_sum").alias("precip_mm"),
        F.col("daily.wind_speed_10m_max").alias("wind_speed_kmh"),
        F.col("daily.temperature_2m_max").alias("tmax_approx_c"),
    )
    return payload.select("county", F.inline(zipped)).select(
        F.to_date("time").alias("date"), "county", "precip_mm", "wind_speed_kmh", "tmax_approx_c"
    )


def soil_days(payload: DataFrame) -> DataFrame:
    """Hourly soil readings as daily means."""
    zipped = F.arrays_zip(
        F.col("hourly.time").alias("time"), F.col("hourly.soil_moisture_0_to_7cm").alias("soil")
    )
    return payload.select("county", F.inline(zipped)).groupBy("county", F.to_date("time").alias("date")).agg(
        F.avg("soil").alias("soil_moisture_m3m3")
    )


def join_soil(weather: DataFrame, soil: DataFrame | None) -> DataFrame:
    """Weather days with soil moisture; no soil payload gives a null column."""
    if soil is None:
        out = weather.withColumn("soil_moisture_m3m3", F.lit(None).cast("double"))
    else:
        out = weather.join(soil, ["county", "date"], "left")
    return out.select("date", "county", "precip_mm", "soil_moisture_m3m3", "wind_speed_kmh", "tmax_approx_c")


def drop_empty_days(weather: DataFrame) -> DataFrame:
    """Drop days beyond the archive: rows with none of the three daily readings."""
    return weather.dropna("all", subset=["precip_mm", "wind_speed_kmh", "tmax_approx_c"])


def current_conditions(payload: DataFrame) -> DataFrame:
    """Present readings of a nested forecast payload with first-day values and the week's rain."""
    from panelwatch.functions.text import array_total, first_or

    none = F.lit(None).cast("double")
    return payload.select(
        "county",
        F.col("current.temperature_2m").alias("temperature_c"),
        F.col("current.wind_speed_10m").alias("wind_speed_kmh"),
        F.col("current.precipitation").alias("precipitation_mm"),
        first_or(F.col("daily.temperature_2m_max"), none).alias("temp_max_c"),
        first_or(F.col("daily.wind_speed_10m_max"), none).alias("wind_max_kmh"),
        first_or(F.col("daily.precipitation_sum"), none).alias("precip_daily_mm"),
        array_total(F.col("daily.precipitation_sum")).alias("precip_week_mm"),
        F.col("air.pm10").alias("pm10_ugm3"),
        F.when(F.col("current").isNull(), F.lit("unavailable")).otherwise(F.lit("live")).alias("source"),
        F.col("current.time").alias("timestamp"),
    )


# --- dust -------------------------------------------------------------------

def read_pm10_bulk(spark, path: str) -> DataFrame:
    """Unpacked yearly bulk files, all columns as text; only five columns are parsed."""
    wanted = StructType.fromDDL(S.PM10_BULK).fieldNames()
    return spark.read.option("header", True).csv(path).select(*[F.col(f"`{c}`") for c in wanted])


def pm10_readings(bulk: DataFrame, codes: DataFrame, state: str = C.PM10_STATE_CODE,
                  parameter: str = C.PM10_PARAMETER_CODE, valid=C.PM10_VALID_RANGE) -> DataFrame:
    """Valid readings of tracked counties; ``codes`` has ``code, county``."""
    return (
        bulk.filter((F.col("State Code") == state) & (F.col("Parameter Code") == parameter))
        .join(codes.select(F.col("code").alias("County Code"), "county"), "County Code")
        .select(F.to_date("Date Local").alias("date"), "county",
                F.col("Arithmetic Mean").try_cast("double").alias("pm10_ugm3"))
        .filter(F.col("pm10_ugm3").between(*valid))
    )


def daily_monitor_mean(readings: DataFrame) -> DataFrame:
    """Mean over the monitors of a place and day."""
    return readings.groupBy("date", "county").agg(F.avg("pm10_ugm3").alias("pm10_ugm3"))


# --- cases ------------------------------------------------------------------

def official_cases(raw: DataFrame, tag: str = C.OFFICIAL_CASES_SOURCE) -> DataFrame:
    """Official file in any header spelling, tagged with its source."""
    return finish_cases(clean_header(raw).withColumn("cases_source", F.lit(tag)))


def nested_cases(nested: DataFrame, provisional: DataFrame, provisional_year: int) -> DataFrame:
    """Long rows from ``county, cases_source, by_year map`` plus one provisional year ``county, case_count``."""
    known = nested.select("county", "cases_source", F.explode("by_year").alias("year", "case_count"))
    extra = provisional.select(
        "county", F.lit(C.PROVISIONAL_CASES_SOURCE).alias("cases_source"),
        F.lit(provisional_year).alias("year"), "case_count",
    )
    return finish_cases(known.unionByName(extra))


def finish_cases(cases: DataFrame) -> DataFrame:
    """Clean place names and keep the four case columns."""
    return cases.select(
        title_name(F.col("county")).alias("county"), F.col("year").cast("int").alias("year"),
        F.col("case_count").cast("long").alias("case_count"), "cases_source",
    )


# --- dimensions -------------------------------------------------------------

def flatten_items(nested: DataFrame, column: str = "items") -> DataFrame:
    """``map<county, array<struct>>`` rows as one row per item with its county."""
    entries = nested.select(F.explode(column).alias("county", "_items"))
    return entries.select("county", F.inline("_items"))


def items_of(items: DataFrame, county: str) -> DataFrame:
    """Items of one place; an unknown place gives no rows."""
    return items.filter(F.col("county") == county)


def attach_items(places: DataFrame, items: DataFrame, *columns: str) -> DataFrame:
    """Each place with its items, one row per item; places without items keep one row with ``has_items`` false."""
    marked = items.select("county", *columns, F.lit(True).alias("has_items"))
    return places.join(marked, "county", "left").na.fill({"has_items": False})


# --- files ------------------------------------------------------------------

def content_hashes(files: DataFrame, content: str = "content", keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """SHA-256 of each content value, for change detection."""
    return files.select(*keep, F.sha2(F.col(content).cast("binary"), 256).alias("hash"))


def block_hashes(df: DataFrame, key: str, columns: list[str], block: int = 10_000) -> DataFrame:
    """``block, rows, hash``: SHA-256 over the sorted rows of each block of ``block`` key values.

    The hash of a table of any size in parts that fit in a task; it does not depend
    on files or on the order of rows. Nulls read as empty.
    """
    line = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    rows = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), line.alias("line"))))
    return df.groupBy(F.floor(F.col(key) / block).alias("block")).agg(
        F.count("*").alias("rows"), F.sha2(F.array_join(F.transform(rows, lambda r: r["line"]), "\n"), 256).alias("hash"))


def changed_blocks(before: DataFrame, after: DataFrame) -> DataFrame:
    """Blocks whose hash is new, other than before, or gone."""
    old = before.select("block", F.col("hash").alias("_old"))
    return after.select("block", "hash").join(old, "block", "full").filter(~F.col("hash").eqNullSafe(F.col("_old"))).select("block")


def read_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Files as ``path, modificationTime, length, content``; a file must fit in one task."""
    reader = spark.read.format("binaryFile")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path)


