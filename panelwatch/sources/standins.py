"""Panel tables derived from the given star-schema tables.

The library works on weather, dust, case and report tables. These views give
every query such tables at the size of the given data: nations stand for
counties, order days for weather days, ship days for dust days, error events for
reports, customers for points and phones. Whole-number sums keep results free
of the order of addition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from panelwatch import constants as C
from panelwatch.operators import index, panel
from panelwatch.plans import pipeline
from panelwatch.session import materialize, small_table

# Thresholds at which the derived scores fall into all four tiers.
STANDIN_THRESHOLDS = (18.0, 22.0, 26.0)
FORECAST_NOW = (2001, 3)
REPORT_NOW = "2024-01-30 00:00:00"

STANDIN_INTENTS = [("ir", ["ir"]), ("hein_qu", ["hein", "qu"]), ("un", ["un"]), ("sh", ["sh"])]

POLYGON_ROWS = [
    (0, "tri", "Polygon", "[[[-121.5,35.0],[-119.0,35.2],[-120.2,37.4],[-121.5,35.0]]]"),
    (1, "concave", "Polygon",
     "[[[-120.5,36.0],[-118.0,36.0],[-118.0,38.0],[-119.2,36.6],[-120.5,38.0],[-120.5,36.0]]]"),
    (2, "two", "MultiPolygon",
     "[[[[-121.7,37.6],[-120.9,37.6],[-120.9,38.4],[-121.7,38.4],[-121.7,37.6]]],"
     "[[[-118.2,34.6],[-117.6,34.6],[-117.6,35.4],[-118.2,35.4],[-118.2,34.6]]]]"),
]


def _cents(name: str) -> Column:
    """Amount in hundredths: whole numbers add up exactly in any order."""
    return F.rint(F.col(name) * 100).cast("long")


def _amount(cents: Column) -> Column:
    return cents / F.lit(100.0)


def typed_name(name: Column, number: Column) -> Column:
    """A place name as people type it; one in eleven is a place nobody knows."""
    return (
        F.when(number % 11 == 0, F.concat(F.lit("Old Town_"), (number % 4).cast("string")))
        .when(number % 3 == 0, F.upper(F.replace(name, F.lit(" "), F.lit("_"))))
        .when(number % 3 == 1, F.concat(F.lit(" "), F.lower(F.replace(name, F.lit(" "), F.lit("")))))
        .otherwise(name)
    )


class Standins:
    """Derived views over the parquet tables in one folder; all of them are lazy plans."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._schemas: dict[str, StructType] = {}

    def table(self, name: str) -> DataFrame:
        """A given table; its schema is read from the files once per object."""
        path = self.path(name)
        if path not in self._schemas:
            self._schemas[path] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(self._schemas[path]).parquet(path)

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    # --- dimensions

    def meta(self) -> DataFrame:
        k = F.col("n_nationkey")
        return self.table("nation").select(
            F.col("n_name").alias("county"), F.concat(F.lit("06"), F.lpad(k.cast("string"), 3, "0")).alias("fips"),
            (F.lit(34.5) + k * F.lit(0.15)).alias("lat"), (F.lit(-121.8) + k * F.lit(0.17)).alias("lon"),
            k.alias("ord"),
        )

    # --- daily tables

    def weather(self) -> DataFrame:
        """Order days per nation. Tables are joined as they are and summed by nation and day at once:
        every task sends one row per nation and day, whichever nation is largest."""
        lines = self.table("lineitem").select(
            F.col("l_orderkey").alias("o_orderkey"), _cents("l_quantity").alias("q"), _cents("l_discount").alias("d"),
            _cents("l_tax").alias("x"),
        )
        orders = self.table("orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("date"))
        customers = self.table("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
        per_day = (
            lines.join(orders, "o_orderkey").join(customers, "o_custkey").groupBy("n_nationkey", "date")
            .agg(_amount(F.sum("q")).alias("q"), _amount(F.sum("d")).alias("d"), _amount(F.sum("x")).alias("x"),
                 F.count(F.lit(1)).alias("n"))
        )
        k, day = F.col("n_nationkey"), F.day("date")
        return per_day.join(self.table("nation").select("n_nationkey", "n_name"), "n_nationkey").select(
            "date", F.col("n_name").alias("county"), F.col("q").alias("precip_mm"),
            F.when((k * 7 + day) % 5 != 0, F.col("d") / F.col("n") * 4).alias("soil_moisture_m3m3"),
            F.when((k * 3 + day) % 6 != 0, F.col("q") / F.col("n")).alias("wind_speed_kmh"),
            (F.col("x") / F.col("n") * 500).alias("tmax_approx_c"),
        )

    def air(self) -> DataFrame:
        """Ship days per supplier nation."""
        lines = self.table("lineitem").select(
            F.col("l_suppkey").alias("s_suppkey"), F.to_date("l_shipdate").alias("date"), _cents("l_extendedprice").alias("p")
        )
        suppliers = self.table("supplier").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey"))
        nations = self.table("nation").select("n_nationkey", F.col("n_name").alias("county"))
        return (
            lines.join(suppliers, "s_suppkey").groupBy("n_nationkey", "date")
            .agg(_amount(F.sum("p")).alias("p"), F.count(F.lit(1)).alias("n"))
            .join(nations, "n_nationkey")
            .select("date", "county", (F.col("p") / F.col("n") / 500).alias("pm10_ugm3"))
        )

    def cases(self) -> DataFrame:
        """Orders per nation and year; the last, incomplete year counts as 1994, so that the panel has a year without cases."""
        year = F.year("o_orderdate")
        orders = self.table("orders").select(F.col("o_custkey").alias("c_custkey"), F.when(year > 2000, 1994).otherwise(year).alias("year"))
        customers = self.table("customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
        nations = self.table("nation").select("n_nationkey", F.col("n_name").alias("county"))
        return (
            orders.join(customers, "c_custkey").groupBy("n_nationkey", "year")
            .agg(F.count(F.lit(1)).alias("case_count")).join(nations, "n_nationkey")
            .select("county", "year", "case_count", F.lit("reported").alias("cases_source"))
        )

    def master(self) -> DataFrame:
        return pipeline.daily_master(self.weather(), self.air(), self.cases(), self.meta())

    # --- monthly tables

    def monthly(self) -> DataFrame:
        return panel.seasonal_cases(
            pipeline.monthly_master(self.weather(), self.air(), self.cases(), self.meta())
        )

    def monthly_table(self) -> DataFrame:
        """The monthly panel written once, for queries that read it several times."""
        return materialize(self.monthly(), "monthly")

    def features(self, drop_incomplete: bool = True) -> DataFrame:
        return panel.monthly_features(self.monthly(), drop_incomplete)

    def scored(self, drop_incomplete: bool = True, rounded: bool = False) -> DataFrame:
        return index.index_monthly(
            materialize(self.features(drop_incomplete), "features"), STANDIN_THRESHOLDS, rounded
        )

    def predictions(self) -> DataFrame:
        """Index table with a simple stand-in forecast."""
        forecast = F.col("monthly_cases") * 0.9 + F.col("precip_mm") * 0.01
        return self.scored(drop_incomplete=False).select(
            "county", "year", "month", "monthly_cases", "lat", "lon", forecast.alias("predicted_cases"),
            (F.col("monthly_cases") - forecast).alias("residual"), "gpot", "erisk", "risk_score", "predicted_risk",
        )

    def env(self) -> DataFrame:
        return panel.serving_rollup(self.weather(), self.air())

    def case_steps(self) -> DataFrame:
        """Monthly actuals with a simple stand-in forecast on the last fifth of the months."""
        steps = materialize(self.monthly().select(
            "county", (F.col("year") * 12 + F.col("month")).alias("t"), F.col("monthly_cases").alias("actual_cases"),
            (F.col("monthly_cases") * 0.8 + F.col("precip_mm") * 0.01).alias("predicted_cases"),
        ), "case-steps")
        return panel.temporal_split(steps).filter(F.col("split") == "test")

    def case_predictions(self) -> DataFrame:
        steps = materialize(self.case_steps(), "case-test")
        return index.case_percentile_index(steps, steps).select(
            "county", "test_sample", "actual_cases", "predicted_cases",
            (F.col("actual_cases") - F.col("predicted_cases")).alias("residual"),
            "risk_score", "predicted_risk", "score_method",
        )

    def shared(self) -> Standins:
        """The same views with weather, dust and cases written once, for queries that use them several times."""
        return _Shared(self)

    # --- points, graph, people

    def points(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.table("customer").select(
            k.alias("id"), (F.lit(34.5) + (k * 37 % 400) / 100).alias("lat"),
            (F.lit(-121.8) + (k * 53 % 440) / 100).alias("lon"),
        )

    def trade_edges(self) -> DataFrame:
        """Customer to supplier pairs that share an order line."""
        lines = self.table("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
        orders = self.table("orders").select("o_orderkey", "o_custkey")
        return lines.join(orders, "o_orderkey").select(
            F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"),
            F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"),
        ).distinct()

    def nation_edges(self) -> DataFrame:
        """Each nation with the next one and with the fifth after it."""
        n = self.table("nation").select("n_nationkey", "n_name")
        steps = n.select(F.col("n_name").alias("src"), F.explode(F.array(
            F.col("n_nationkey") + 1, F.col("n_nationkey") + 5
        )).alias("n_nationkey"))
        return steps.join(n, "n_nationkey").select("src", F.col("n_name").alias("dst"))

    def reports_raw(self, events: DataFrame | None = None) -> DataFrame:
        names = F.array(*[F.lit(r[0]) for r in C.COUNTY_META])
        u = F.col("user_id")
        events = self.table("events") if events is None else events
        known = F.element_at(names, (u % 8 + 1).cast("int"))
        return events.select(
            F.col("event_id").alias("id"), typed_name(known, u).alias("county"),
            (F.col("event_id") % 5).cast("int").alias("severity"), F.col("props").alias("description"),
            (u * 100 + F.day("ts")).cast("string").alias("reporter_id"), F.col("ts").cast("timestamp").alias("created_at"),
        )

    def subscription_requests(self) -> DataFrame:
        """One request per order; a customer's later order changes the language."""
        langs = F.array(*[F.lit(x) for x in ("english", "spanish", "Hmong", "punjabi", "klingon")])
        customers = self.table("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
        nations = self.table("nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("county"))
        return self.table("orders").join(customers, "o_custkey").join(nations, "c_nationkey").select(
            F.col("o_custkey").cast("string").alias("phone"), typed_name(F.col("county"), F.col("o_orderkey")).alias("county"),
            F.element_at(langs, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("language"),
            F.col("o_orderdate").alias("requested_at"), F.col("o_orderkey").alias("request_id"),
        )

    def messages(self) -> DataFrame:
        return self.table("conversations").select("conv_id", "turn", "text")

    def polygons(self) -> DataFrame:
        return small_table(self.spark, POLYGON_ROWS, "ord int, name string, type string, coordinates string")

    # --- payload files

    def user_days(self) -> DataFrame:
        """Events per user and day, the grain of the payloads."""
        return self.table("events").groupBy(F.col("user_id").cast("string").alias("county"), F.to_date("ts").alias("date")).agg(
            _amount(F.sum(_cents("value"))).alias("total"), F.max("value").alias("top"), F.min("value").alias("low"),
        )

    def weather_payload(self) -> DataFrame:
        """Parallel arrays per user and month: at most 31 days each, sorted by day."""
        days = F.array_sort(F.collect_list(F.struct("date", "total", "top", "low")))
        return (
            self.user_days().groupBy("county", F.trunc("date", "month").alias("_m")).agg(days.alias("d"))
            .select("county", F.struct(
                F.transform("d", lambda x: x["date"].cast("string")).alias("time"),
                F.transform("d", lambda x: F.when(x["total"] >= 20, x["total"])).alias("precipitation_sum"),
                F.transform("d", lambda x: x["top"]).alias("wind_speed_10m_max"),
                F.transform("d", lambda x: x["low"]).alias("temperature_2m_max"),
            ).alias("daily"))
        )

    def soil_payload(self) -> DataFrame:
        """Hourly arrays per user and day: at most 24 entries each."""
        hourly = self.table("events").groupBy(
            F.col("user_id").cast("string").alias("county"), F.date_trunc("hour", "ts").alias("h")
        ).agg(F.max("value").alias("v"))
        hours = F.array_sort(F.collect_list(F.struct("h", "v")))
        return hourly.groupBy("county", F.to_date("h").alias("_d")).agg(hours.alias("x")).select(
            "county", F.struct(
                F.transform("x", lambda p: F.date_format(p["h"], "yyyy-MM-dd'T'HH:mm")).alias("time"),
                F.transform("x", lambda p: p["v"] / 1000).alias("soil_moisture_0_to_7cm"),
            ).alias("hourly")
        )

    def facilities_nested(self) -> DataFrame:
        """``map<county, array<item>>`` rows with at most 100 suppliers each."""
        s, n = self.table("supplier"), self.table("nation").select("n_nationkey", "n_name")
        item = F.struct(F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 3 == 0, F.lit("hospital")).otherwise(
            F.lit("clinic")).alias("type"), F.col("s_acctbal").alias("lat"))
        return (
            s.join(n, s["s_nationkey"] == n["n_nationkey"])
            .groupBy("n_name", F.floor(F.col("s_suppkey") / 100).alias("_chunk"))
            .agg(F.collect_list(item).alias("_items"))
            .select(F.create_map("n_name", "_items").alias("items"))
        )

    def facilities(self) -> DataFrame:
        from panelwatch.sources.readers import flatten_items

        return flatten_items(self.facilities_nested())


class _Shared(Standins):
    """Stand-ins whose daily tables are read from files after their first use."""

    def __init__(self, base: Standins):
        super().__init__(base.spark, base.folder)
        self._schemas, self._written = base._schemas, {}

    def _once(self, name: str, build) -> DataFrame:
        if name not in self._written:
            self._written[name] = materialize(build(), name)
        return self._written[name]

    def weather(self) -> DataFrame:
        return self._once("weather", super().weather)

    def air(self) -> DataFrame:
        return self._once("air", super().air)

    def cases(self) -> DataFrame:
        return self._once("cases", super().cases)
