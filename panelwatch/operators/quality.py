"""Data checks; each gives one row ``check, ok, detail`` and runs as an aggregate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwatch import constants as C


def _row(df: DataFrame, name: str, ok: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(name).alias("check"), F.coalesce(ok, F.lit(False)).alias("ok"), detail.alias("detail"))


def entity_count(panel: DataFrame, expected: int = C.EXPECTED_ENTITIES, key: str = "county") -> DataFrame:
    found = panel.agg(F.count_distinct(key).alias("n"))
    return _row(found, "entity_count", F.col("n") == expected, F.format_string("%d of %d", "n", F.lit(expected)))


def no_nulls(panel: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per critical column, from one pass."""
    from panelwatch.operators.stats import null_profile

    columns = columns or [*C.MEASURES, "case_count"]
    return null_profile(panel, columns).select(
        F.concat(F.lit("no_nulls:"), "column").alias("check"), (F.col("nulls") == 0).alias("ok"),
        F.format_string("%d nulls", "nulls").alias("detail"),
    )


def cases_present(panel: DataFrame, years=C.CASE_YEARS_REQUIRED) -> DataFrame:
    """One row per place and required year; no row counts as no cases."""
    seen = panel.groupBy("county", F.year("date").alias("year")).agg(F.max("case_count").alias("cases"))
    wanted = panel.select("county").distinct().withColumn(
        "year", F.explode(F.array(*[F.lit(y) for y in years]))
    )
    joined = wanted.join(seen, ["county", "year"], "left")
    return joined.select(
        F.concat_ws(":", F.lit("cases_present"), "county", "year").alias("check"),
        (F.coalesce("cases", F.lit(0)) > 0).alias("ok"),
        F.format_string("%d cases", F.coalesce("cases", F.lit(0))).alias("detail"),
    )


def dominant_floor(panel: DataFrame, county: str, year: int, floor: int) -> DataFrame:
    """A given place and year reaches a floor; a missing row is an issue."""
    found = panel.filter((F.col("county") == county) & (F.year("date") == year)).agg(
        F.max("case_count").alias("cases")
    )
    return _row(found, "dominant_floor", F.col("cases") >= floor,
                F.when(F.col("cases").isNull(), "missing").otherwise(F.format_string("%d cases", "cases")))


def score_identity(scored: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Score equals growth x exposure x 100 on every row."""
    found = scored.agg(F.max(F.abs(F.col("risk_score") - F.col("G_pot") * F.col("E_risk") * 100)).alias("d"))
    return _row(found, "score_identity", F.col("d") <= tolerance,
                F.when(F.col("d") <= tolerance, F.lit("within tolerance")).otherwise(F.lit("differs")))


def validate(scored: DataFrame, expected: int = C.EXPECTED_ENTITIES, years=C.CASE_YEARS_REQUIRED,
             dominant=C.DOMINANT_ENTITY, columns: list[str] | None = None) -> DataFrame:
    """All checks of the daily master in one table."""
    checks = [
        entity_count(scored, expected), no_nulls(scored, columns), cases_present(scored, years),
        dominant_floor(scored, *dominant), score_identity(scored),
    ]
    return reduce(DataFrame.unionByName, checks)


def passed(checks: DataFrame) -> DataFrame:
    """Pass flag with the number of issues and their names."""
    return checks.agg(
        (F.count_if(~F.col("ok")) == 0).alias("passed"), F.count_if(~F.col("ok")).alias("issues"),
        F.count(F.lit(1)).alias("checks"),
    )
