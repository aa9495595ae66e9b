"""Scaling, the three two-phase indices, tiers and flags, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwatch import constants as C
from panelwatch.functions.numeric import clamped_share, half_up
from panelwatch.functions.text import literal_map
from panelwatch.session import one_row


# --- whole-table statistics -------------------------------------------------

def column_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row with mean, sample and population deviation, min and max of every column, in one pass."""
    aggs = []
    for c in columns:
        aggs += [
            F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"),
            F.stddev_pop(c).alias(f"{c}_std_pop"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"),
        ]
    return df.agg(*aggs)


class Stats:
    """Statistics of some columns as constant columns."""

    def __init__(self, df: DataFrame, columns: list[str]):
        self._values = one_row(column_stats(df, columns))

    def __call__(self, column: str, what: str) -> Column:
        """``what`` is mean, std, std_pop, min or max."""
        value = self._values[f"{column}_{what}"]
        return F.lit(None if value is None else float(value)).cast("double")

    def zscore(self, c: str) -> Column:
        std = self(c, "std")
        return F.when(std > 0, (F.col(c) - self(c, "mean")) / std).otherwise(F.lit(0.0))

    def minmax(self, c: str) -> Column:
        lo, hi = self(c, "min"), self(c, "max")
        return F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(F.lit(0.0))

    def clamped(self, c: str, missing: float = 0.5) -> Column:
        """Share of the observed range in 0..1; a flat range counts as 0..1."""
        lo, hi = self(c, "min"), self(c, "max")
        flat = ~F.coalesce(hi > lo, F.lit(False))
        return clamped_share(F.col(c), F.when(flat, 0.0).otherwise(lo), F.when(flat, 1.0).otherwise(hi), missing)


def zscore(df: DataFrame, columns=C.SCALED_COLUMNS) -> DataFrame:
    """``z_*`` columns by sample deviation; a constant or empty column gives 0.

    Like all scalings it reads ``df`` twice: pass a written table.
    """
    stats = Stats(df, list(columns))
    return df.withColumns({f"z_{c}": stats.zscore(c) for c in columns})


def minmax(df: DataFrame, columns=C.SCALED_COLUMNS) -> DataFrame:
    """``n_*`` columns on the observed range; a flat column gives 0."""
    stats = Stats(df, list(columns))
    return df.withColumns({f"n_{c}": stats.minmax(c) for c in columns})


def scale_all(df: DataFrame, columns=C.SCALED_COLUMNS) -> DataFrame:
    """Both scalings and the scaled aridity from one statistics pass."""
    stats = Stats(df, list(columns))
    return df.withColumns(
        {f"z_{c}": stats.zscore(c) for c in columns} | {f"n_{c}": stats.minmax(c) for c in columns}
    ).withColumn("n_soil_aridity", 1 - F.col("n_soil_moisture_m3m3"))


def clamped_minmax(df: DataFrame, columns: list[str], missing: float = 0.5, prefix: str = "s_") -> DataFrame:
    """Share of the observed range kept in 0..1, ``missing`` for nulls."""
    stats = Stats(df, columns)
    return df.withColumns({f"{prefix}{c}": stats.clamped(c, missing) for c in columns})


# --- the index --------------------------------------------------------------

def growth(soil_past: Column, heat_past: Column, rain_past: Column, weights=C.GROWTH_WEIGHTS) -> Column:
    return (
        weights["soil_past"] * soil_past + weights["heat_past"] * heat_past + weights["rain_past"] * rain_past
    )


def exposure(dust_past: Column, aridity: Column, wind: Column, heat_recent: Column,
             weights=C.EXPOSURE_WEIGHTS) -> Column:
    return (
        weights["dust_past"] * dust_past + weights["aridity"] * aridity
        + weights["wind"] * wind + weights["heat_recent"] * heat_recent
    )


def tier(score: Column, thresholds=C.TIER_THRESHOLDS, tiers=C.TIERS) -> Column:
    """Tier name by upper bounds; a score equal to a bound belongs to the next tier."""
    out = F.lit(tiers[-1])
    for bound, name in reversed(list(zip(thresholds, tiers))):
        out = F.when(score < bound, F.lit(name)).otherwise(out)
    return F.when(score.isNotNull(), out)


def tier_color(level: Column, colors=C.TIER_COLORS) -> Column:
    return F.try_element_at(literal_map(colors), level)


def index_daily(df: DataFrame, thresholds=C.TIER_THRESHOLDS) -> DataFrame:
    """Variant 1: daily, observed min-max, missing terms count 0, phases not rescaled."""
    def term(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0.0))

    g = growth(term("n_sm_lag6mo"), term("n_tmax_lag6mo"), term("n_precip_lag1p5y"))
    e = exposure(term("n_pm10_lag1mo"), term("n_soil_aridity"), term("n_wind_speed_kmh"), term("n_tmax_lag1mo"))
    return (
        df.withColumn("G_pot", g).withColumn("E_risk", e)
        .withColumn("risk_score", F.col("G_pot") * F.col("E_risk") * 100)
        .withColumn("risk_level", tier(F.col("risk_score"), thresholds))
        .withColumn("risk_color", tier_color(F.col("risk_level")))
    )


INDEX_MONTHLY_INPUTS = [
    "sm_lag6", "tmax_lag6", "precip_lag18", "pm10_lag1", "soil_moisture_m3m3", "wind_roll3", "tmax_lag1",
]


def index_monthly(df: DataFrame, thresholds=C.TIER_THRESHOLDS, rounded: bool = True,
                  reference: DataFrame | None = None) -> DataFrame:
    """Variant 2: monthly, clamped observed range, missing 0.5, phases rescaled to 0..1.

    The tier follows the score as reported: rounded to 2 places when ``rounded``.
    """
    share = Stats(df if reference is None else reference, INDEX_MONTHLY_INPUTS).clamped
    g = growth(share("sm_lag6"), share("tmax_lag6"), share("precip_lag18")) / C.GROWTH_TOTAL
    e = exposure(
        share("pm10_lag1"), 1 - share("soil_moisture_m3m3"), share("wind_roll3"), share("tmax_lag1")
    ) / C.EXPOSURE_TOTAL
    scored = df.withColumn("gpot", g).withColumn("erisk", e).withColumn(
        "risk_score", F.col("gpot") * F.col("erisk") * 100
    )
    if rounded:
        scored = scored.withColumns({
            "risk_score": half_up(F.col("risk_score"), 2),
            "gpot": half_up(F.col("gpot"), 4), "erisk": half_up(F.col("erisk"), 4),
        })
    return scored.withColumn("predicted_risk", tier(F.col("risk_score"), thresholds))


def index_fixed(df: DataFrame, thresholds=C.TIER_THRESHOLDS, ranges=C.NORM_RANGES, rounded: bool = True,
                columns: dict[str, str] | None = None) -> DataFrame:
    """Variant 3: fixed ranges, missing 0.5, phases not rescaled, current heat."""
    use = {
        "sm_lag6": "sm_lag6", "t_lag6": "tmax_lag6", "p_lag18": "precip_lag18", "pm10": "pm10_lag1",
        "sm_now": "soil_moisture_m3m3", "wind": "wind_speed_kmh", "tmax": "tmax_approx_c", **(columns or {}),
    }

    def share(name: str, kind: str) -> Column:
        lo, hi = ranges[kind]
        return clamped_share(F.col(use[name]), F.lit(lo), F.lit(hi))

    g = growth(share("sm_lag6", "sm"), share("t_lag6", "tmax"), share("p_lag18", "precip"))
    e = exposure(share("pm10", "pm10"), 1 - share("sm_now", "sm"), share("wind", "wind"), share("tmax", "tmax"))
    scored = df.withColumn("gpot", g).withColumn("erisk", e).withColumn(
        "risk_score", F.col("gpot") * F.col("erisk") * 100
    )
    if rounded:
        scored = scored.withColumns({
            "risk_score": half_up(F.col("risk_score"), 2),
            "gpot": half_up(F.col("gpot"), 4), "erisk": half_up(F.col("erisk"), 4),
        })
    return scored.withColumn("risk_level", tier(F.col("risk_score"), thresholds))


def case_percentile_index(predictions: DataFrame, reference: DataFrame, key: str = "county",
                          predicted: str = "predicted_cases", actual: str = "actual_cases") -> DataFrame:
    """Tier and 0-25 score of a case forecast against each entity's own case quartiles.

    ``reference`` holds one value per entity and time step (calendar-bounded).
    """
    from panelwatch.operators.quantiles import small_group_quantiles

    quartiles = small_group_quantiles(reference, actual, list(C.CASE_PERCENTILES), [key], ["p25", "p50", "p75"])
    x, p25, p50, p75 = F.col(predicted), F.col("p25"), F.col("p50"), F.col("p75")

    def floor(c: Column) -> Column:
        return F.greatest(c, F.lit(0.1))

    score = (
        F.when(x < p25, x / floor(p25) * 3)
        .when(x < p50, 3 + (x - p25) / floor(p50 - p25) * 5)
        .when(x < p75, 8 + (x - p50) / floor(p75 - p50) * 7)
        .otherwise(15 + F.least((x - p75) / floor(p75) * 10, F.lit(10.0)))
    )
    level = (
        F.when(x < p25, F.lit(C.TIERS[0])).when(x < p50, F.lit(C.TIERS[1]))
        .when(x < p75, F.lit(C.TIERS[2])).otherwise(F.lit(C.TIERS[3]))
    )
    return (
        predictions.join(quartiles, key)
        .withColumn("risk_score", half_up(F.greatest(F.lit(0.0), score), 2))
        .withColumn("predicted_risk", level)
        .withColumn("score_method", F.lit(C.CASE_SCORE_METHOD))
        .drop("p25", "p50", "p75")
    )


# --- flags ------------------------------------------------------------------

def elevated(score: Column, level: Column, bound: float = C.ELEVATED_SCORE) -> Column:
    return F.coalesce(score >= bound, F.lit(False)) | F.coalesce(level.isin(C.ALERT_TIERS), F.lit(False))


def warn_flags(df: DataFrame, wind="wind_speed_kmh", pm10="pm10_ugm3", temp="temperature_c",
               rain="precip_week_mm") -> DataFrame:
    """Reading warnings; a missing reading never warns."""
    def flag(cond: Column) -> Column:
        return F.coalesce(cond, F.lit(False))

    return df.withColumns({
        "warn_wind": flag(F.col(wind) > C.WARN_WIND_KMH),
        "warn_pm10": flag(F.col(pm10) > C.WARN_PM10),
        "warn_temp": flag(F.col(temp) > C.WARN_TEMP_C),
        "warn_dry": flag(F.col(rain) == 0),
    })


def gauge_share(score: Column) -> Column:
    """Fill share of a gauge that is full at 25; a missing score gives 0."""
    return F.coalesce(F.least(F.lit(1.0), score / C.GAUGE_FULL_SCORE), F.lit(0.0))


def zone_radius(population: Column) -> Column:
    """Marker radius by population, 5..11; a missing or zero population counts as 1000."""
    people = F.when(population.isNull() | (population == 0), F.lit(1000)).otherwise(population)
    return F.greatest(F.lit(5.0), F.least(F.lit(11.0), 4 + people / 2000))


def legacy_score(df: DataFrame) -> Column:
    """``risk_score`` where the table has one, else 1..4 from the tier name."""
    legacy = F.try_element_at(literal_map(C.LEGACY_TIER_SCORES), F.col("predicted_risk"))
    if "risk_score" not in df.columns:
        return legacy
    return F.coalesce(F.when(~F.isnan("risk_score"), F.col("risk_score")), legacy)


def optional_column(df: DataFrame, name: str, kind: str = "double") -> Column:
    """The column if the table has it, else a null of the given type."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind).alias(name)
