"""Aggregates: distributions, profiles, forecast metrics, yearly views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwatch import constants as C


def tier_distribution(df: DataFrame, column: str, tiers=C.TIERS) -> DataFrame:
    """Count and percent per tier in fixed order; absent tiers give 0.

    The rows are one count per tier when the share is taken.
    """
    counted = df.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col(column) == t).alias(f"c{i}") for i, t in enumerate(tiers)],
    )
    cells = F.explode(F.array(*[
        F.struct(F.lit(i).alias("tier_order"), F.lit(t).alias("tier"), F.col(f"c{i}").alias("n"))
        for i, t in enumerate(tiers)
    ])).alias("x")
    return counted.select("total", cells).select(
        "x.tier_order", "x.tier", "x.n",
        F.when(F.col("total") > 0, F.col("x.n") * 100.0 / F.col("total")).alias("percent"),
    )


def _per_column(df: DataFrame, columns: list[str], measures: dict) -> DataFrame:
    """One pass over the table, one output row per column."""
    row = df.agg(
        F.count(F.lit(1)).alias("_n"),
        *[fn(c).alias(f"{name}__{c}") for c in columns for name, fn in measures.items()],
    )
    cells = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), *[F.col(f"{name}__{c}").alias(name) for name in measures])
        for c in columns
    ])).alias("x")
    return row.select("_n", cells).select("_n", "x.*")


def null_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null count and percent per column."""
    return _per_column(df, columns, {"nulls": lambda c: F.count_if(F.col(c).isNull())}).select(
        "column", "nulls", F.when(F.col("_n") > 0, F.col("nulls") * 100.0 / F.col("_n")).alias("percent")
    )


def clip_report(df: DataFrame, bounds=C.CLIP_BOUNDS) -> DataFrame:
    """Rows below and above the bounds per column."""
    return _per_column(df, list(bounds), {
        "below": lambda c: F.count_if(F.col(c) < bounds[c][0]),
        "above": lambda c: F.count_if(F.col(c) > bounds[c][1]),
    }).drop("_n")


def panel_summary(df: DataFrame) -> DataFrame:
    """Rows, distinct places and years, first and last day."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("county").alias("n_counties"),
        F.count_distinct(F.year("date")).alias("n_years"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
    )


def regression_metrics(df: DataFrame, actual: str = "actual_cases", predicted: str = "predicted_cases",
                       keys: list[str] | None = None) -> DataFrame:
    """RMSE, MAE and R2 in one pass, for the whole table or per key."""
    e = F.col(actual) - F.col(predicted)
    sse, n = F.sum(e * e), F.count(e)
    spread = F.var_pop(actual) * n
    return df.groupBy(*(keys or [])).agg(
        n.alias("n"), F.sqrt(sse / n).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        F.when(spread > 0, 1 - sse / spread).alias("r2"),
    )


def entity_performance(df: DataFrame, actual: str = "actual_cases", predicted: str = "predicted_cases",
                       key: str = "county") -> DataFrame:
    """Mean actual, mean predicted and MAE per entity."""
    return df.groupBy(key).agg(
        F.avg(actual).alias("mean_actual"), F.avg(predicted).alias("mean_predicted"),
        F.avg(F.abs(F.col(actual) - F.col(predicted))).alias("mae"),
    )


def yearly_totals(cases: DataFrame) -> DataFrame:
    return cases.groupBy("year").agg(F.sum("case_count").alias("total_cases"))


def yearly_insight(predictions: DataFrame, bound: float = C.ELEVATED_SCORE) -> DataFrame:
    """Mean, peak and number of elevated months per place and year."""
    return predictions.groupBy("county", "year").agg(
        F.avg("monthly_cases").alias("avg_cases"), F.max("monthly_cases").alias("peak_cases"),
        F.count_if(F.col("risk_score") >= bound).alias("high_risk_months"),
    )


def peak_record(predictions: DataFrame) -> DataFrame:
    """Month with the most cases per place; the earliest one on ties."""
    t = F.col("year") * 12 + F.col("month")
    best = F.max_by(F.struct("year", "month", "monthly_cases"), F.struct(F.col("monthly_cases"), -t))
    return predictions.filter(F.col("monthly_cases").isNotNull()).groupBy("county").agg(best.alias("b")).select(
        "county", F.col("b.year").alias("peak_year"), F.col("b.month").alias("peak_month"),
        F.col("b.monthly_cases").alias("peak_cases"),
    )


def peak_calendar_month(predictions: DataFrame, digits: int = 9) -> DataFrame:
    """Calendar month with the highest mean; the earliest one on ties.

    Means are compared at ``digits`` places so that equal means stay equal
    whatever the order of addition.
    """
    means = predictions.groupBy("county", "month").agg(F.round(F.avg("monthly_cases"), digits).alias("mean_cases"))
    return means.groupBy("county").agg(
        F.max_by("month", F.struct(F.col("mean_cases"), -F.col("month"))).alias("peak_month")
    )


def trend(predictions: DataFrame, base_year: int = 2022, year: int = 2024, factor: float = C.TREND_FACTOR) -> DataFrame:
    """Whether ``year`` exceeds ``base_year`` by ``factor``; a missing ``year`` falls back to the base."""
    def mean_of(y: int) -> Column:
        return F.avg(F.when(F.col("year") == y, F.col("monthly_cases")))

    return predictions.groupBy("county").agg(
        mean_of(base_year).alias("base_mean"),
        F.when(F.count_if(F.col("year") == year) > 0, mean_of(year)).otherwise(mean_of(base_year)).alias("year_mean"),
        F.avg("monthly_cases").alias("overall_mean"),
    ).withColumn("increase", F.coalesce(F.col("year_mean") > F.col("base_mean") * factor, F.lit(False)))


def anomalies(env: DataFrame, recent: int = C.RECENT_MONTHS, floors=C.ANOMALY_FLOORS) -> DataFrame:
    """Recent months against the whole history, in percent of the history."""
    newest = Window.partitionBy("county").orderBy(F.desc("year"), F.desc("month"))
    flagged = env.withColumn("_recent", F.row_number().over(newest) <= recent)
    means = flagged.groupBy("county").agg(*[
        agg for c in floors for agg in (
            F.avg(F.when(F.col("_recent"), F.col(c))).alias(f"recent_{c}"), F.avg(c).alias(f"hist_{c}"),
        )
    ])
    return means.withColumns({
        f"{c}_anomaly": (F.col(f"recent_{c}") - F.col(f"hist_{c}"))
        / F.when(F.col(f"hist_{c}").isNotNull(), F.greatest(F.col(f"hist_{c}"), F.lit(floor))) * 100
        for c, floor in floors.items()
    })
