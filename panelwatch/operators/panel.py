"""Daily and monthly panel operators: join, fill, clip, lag, roll, frame.

Every windowed operator needs one row per entity and time step (``unique_steps``
or a preceding ``groupBy`` gives it). A window partition then holds at most one
entity's calendar, e.g. 36,525 rows for a century of days, however many raw
readings stood behind it; raw readings are always aggregated before a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwatch import constants as C
from panelwatch.functions.numeric import clamp
from panelwatch.functions.text import month_index
from panelwatch.operators.quantiles import exact_quantiles
from panelwatch.session import materialize, one_row


def _forward(key: list[str], order: list[str]):
    return Window.partitionBy(*key).orderBy(*order)


# --- joins ------------------------------------------------------------------

def join_air(weather: DataFrame, air: DataFrame) -> DataFrame:
    """Weather days with the dust reading of the same place and day, if any."""
    return weather.join(air, ["county", "date"], "left")


def attach_cases(panel: DataFrame, cases: DataFrame) -> DataFrame:
    """Yearly case count on every row of that place and year; none gives 0 / ``no_data``."""
    dated = panel if "year" in panel.columns else panel.withColumn("year", F.year("date"))
    return (
        dated.join(cases, ["county", "year"], "left")
        .na.fill({"case_count": 0, "cases_source": C.NO_CASES_SOURCE})
    )


def attach_meta(panel: DataFrame, meta: DataFrame) -> DataFrame:
    """Code and coordinates of each place; unknown places get an empty code."""
    return panel.join(meta.select("county", "fips", "lat", "lon"), "county", "left").na.fill({"fips": ""})


def order_columns(panel: DataFrame) -> DataFrame:
    """Column set and order of the daily master."""
    return panel.select(
        "date", "county", "fips", "lat", "lon", "precip_mm", "soil_moisture_m3m3",
        "wind_speed_kmh", "pm10_ugm3", "tmax_approx_c", "case_count", "cases_source",
    )


def keep_tracked(df: DataFrame, tracked: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` is in the tracked list (semi-join)."""
    return df.join(tracked.select(key), key, "left_semi")


def unique_steps(df: DataFrame, key: list[str], load_order: list[str]) -> DataFrame:
    """Keep the row loaded last for each key.

    ``max_by`` combines on the map side, so a key with very many copies leaves
    each task as one row.
    """
    rest = [c for c in df.columns if c not in key]
    newest = F.max_by(F.struct(*rest), F.struct(*load_order))
    return df.groupBy(*key).agg(newest.alias("_row")).select(*key, *[F.col("_row")[c].alias(c) for c in rest])


# --- filling ----------------------------------------------------------------

def fill_zero(panel: DataFrame, columns: list[str]) -> DataFrame:
    """Missing means none, e.g. no rain."""
    return panel.na.fill(0.0, columns)


def fill_hold(panel: DataFrame, columns: list[str], key=("county",), order=("date",)) -> DataFrame:
    """Last known value carried forward; leading gaps take the first known value.

    After the forward pass only leading gaps are left, and for those the next
    value is the entity's first one, so one whole-partition value replaces a
    backward frame.
    """
    ordered = _forward(list(key), list(order))
    running = ordered.rowsBetween(Window.unboundedPreceding, 0)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return panel.withColumns({
        c: F.coalesce(F.last(c, ignorenulls=True).over(running), F.first(c, ignorenulls=True).over(whole))
        for c in columns
    })


def fill_linear(panel: DataFrame, columns: list[str], key=("county",), order=("date",)) -> DataFrame:
    """Straight line between the known neighbours by row position; ends are held.

    The next known value comes from a running frame over the reversed order,
    which is linear in the partition size; a frame from the current row to the
    end would be quadratic.
    """
    key, order = list(key), list(order)
    ahead = _forward(key, order).rowsBetween(Window.unboundedPreceding, 0)
    behind = Window.partitionBy(*key).orderBy(*[F.desc(o) for o in order]).rowsBetween(Window.unboundedPreceding, 0)
    numbered = panel.withColumn("_rn", F.row_number().over(_forward(key, order)))

    def known(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.struct(F.col("_rn").alias("rn"), F.col(c).alias("v")))

    framed = numbered.withColumns({f"_prev_{c}": F.last(known(c), ignorenulls=True).over(ahead) for c in columns})
    framed = framed.withColumns({f"_next_{c}": F.last(known(c), ignorenulls=True).over(behind) for c in columns})
    filled = {}
    for c in columns:
        prev, nxt = F.col(f"_prev_{c}"), F.col(f"_next_{c}")
        share = (F.col("_rn") - prev["rn"]) / (nxt["rn"] - prev["rn"])
        filled[c] = (
            F.when(F.col(c).isNotNull(), F.col(c))
            .when(prev.isNull(), nxt["v"])
            .when(nxt.isNull(), prev["v"])
            .otherwise(prev["v"] + (nxt["v"] - prev["v"]) * share)
        )
    helpers = ["_rn"] + [f"_{side}_{c}" for c in columns for side in ("prev", "next")]
    return framed.withColumns(filled).drop(*helpers)


def fill_median(panel: DataFrame, columns: list[str]) -> DataFrame:
    """Entities without any value take the exact median over all entities.

    The panel is written once. Columns without gaps cost one counting pass; for
    the others the medians come from a few passes over just those columns.
    """
    panel = materialize(panel, "median-input")
    gaps = one_row(panel.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]))
    open_columns = [c for c in columns if gaps[c]]
    if not open_columns:
        return panel
    tall = panel.select(*open_columns).unpivot([], open_columns, "column", "v")
    medians = exact_quantiles(tall, "v", [0.5], ["column"], few_keys=True)
    middle = one_row(medians.agg(*[
        F.max(F.when(F.col("column") == c, F.col("value"))).alias(c) for c in open_columns
    ]))
    return panel.withColumns({c: F.coalesce(F.col(c), F.lit(middle[c]).cast("double")) for c in open_columns})


def impute(panel: DataFrame) -> DataFrame:
    """Reference fill: rain 0, soil held, wind / dust / heat linear (medians follow separately)."""
    filled = fill_hold(fill_zero(panel, ["precip_mm"]), ["soil_moisture_m3m3"])
    return fill_linear(filled, ["wind_speed_kmh", "tmax_approx_c", "pm10_ugm3"])


def clip_outliers(panel: DataFrame, bounds=C.CLIP_BOUNDS) -> DataFrame:
    """Cap readings at their physical limits."""
    return panel.withColumns({c: clamp(F.col(c), lo, hi) for c, (lo, hi) in bounds.items()})


# --- lags and frames --------------------------------------------------------

def add_lags(panel: DataFrame, lags, key=("county",), order=("date",)) -> DataFrame:
    """Values ``n`` rows back; all lags share one sort."""
    ordered = _forward(list(key), list(order))
    return panel.withColumns({new: F.lag(c, n).over(ordered) for new, c, n in lags})


def add_calendar_lags(panel: DataFrame, lags, key=("county",), date: str = "date") -> DataFrame:
    """Values exactly ``n`` days back, unaffected by missing days."""
    days = F.unix_date(date)
    ordered = Window.partitionBy(*key).orderBy(days)
    return panel.withColumns({new: F.first(c).over(ordered.rangeBetween(-n, -n)) for new, c, n in lags})


def add_rolls(panel: DataFrame, rolls, key=("county",), order=("date",)) -> DataFrame:
    """Mean of the last ``n`` rows; null unless all ``n`` values are present."""
    ordered = _forward(list(key), list(order))
    out = {}
    for new, c, n in rolls:
        frame = ordered.rowsBetween(1 - n, 0)
        out[new] = F.when(F.count(c).over(frame) == n, F.avg(c).over(frame))
    return panel.withColumns(out)


def add_aridity(panel: DataFrame, source: str = "soil_moisture_m3m3", name: str = "soil_aridity") -> DataFrame:
    return panel.withColumn(name, 1 - F.col(source))


def last_rows(df: DataFrame, n: int, key: list[str], order: list[str]) -> DataFrame:
    """Last ``n`` rows of each entity.

    The row-number limit is applied within each task before the shuffle, so a
    hot entity sends at most ``n`` rows per task.
    """
    newest = Window.partitionBy(*key).orderBy(*[F.desc(o) for o in order])
    return df.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= n).drop("_rn")


def latest_row(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Newest row of each entity."""
    return unique_steps(df, key, order)


def sliding_windows(df: DataFrame, features: list[str], target: str, size: int = 6,
                    key=("county",), order=("t",)) -> DataFrame:
    """For each step the ``size`` rows before it, as an array, with the step's own target."""
    frame = _forward(list(key), list(order)).rowsBetween(-size, -1)
    return (
        df.withColumn("window", F.collect_list(F.struct(*features)).over(frame))
        .filter(F.size("window") == size)
        .select(*key, *order, "window", F.col(target).alias("target"))
    )


def dense_panel(monthly: DataFrame, values: list[str], key: str = "county") -> DataFrame:
    """One row per entity and time step that occurs anywhere; missing cells are 0.

    The distinct steps travel as an array constant and are exploded per entity.
    """
    cells = monthly.select(key, month_index(F.col("year"), F.col("month")).alias("t"), *values)
    grid = monthly.select(key).distinct().select(key, F.explode(F.lit(time_steps(cells))).alias("t"))
    return (
        grid.join(cells, [key, "t"], "left").na.fill(0.0, values)
        .select(key, "t", F.floor((F.col("t") - 1) / 12).cast("int").alias("year"),
                ((F.col("t") - 1) % 12 + 1).cast("int").alias("month"), *values)
    )


def cut_at_last_valid(df: DataFrame, last_year: int, year: str = "year", t: str = "t") -> DataFrame:
    """Rows up to the last step of ``last_year`` or earlier that occurs in the data."""
    last = one_row(df.agg(F.max(F.when(F.col(year) <= last_year, F.col(t))).alias("last")))["last"]
    return df.filter(F.col(t) <= F.lit(last))


def time_steps(df: DataFrame, t: str = "t") -> list:
    """The distinct time steps in order: at most one per month or day of the calendar."""
    return one_row(df.agg(F.array_sort(F.collect_set(t)).alias("steps")))["steps"]


def _position(steps: list, t: str) -> Column:
    return (F.array_position(F.lit(steps), F.col(t)) - 1).cast("long")


def temporal_split(df: DataFrame, share: float = 0.8, t: str = "t") -> DataFrame:
    """Mark the first ``int(share * n)`` time steps as training, the rest as test.

    ``test_sample`` numbers the test steps from 0. ``df`` is read for the steps
    first: pass a written table.
    """
    steps = time_steps(df, t)
    ahead = _position(steps, t) - int(share * len(steps))
    return df.withColumn("split", F.when(ahead < 0, F.lit("train")).otherwise(F.lit("test"))).withColumn(
        "test_sample", F.when(ahead >= 0, ahead)
    )


# --- rollup -----------------------------------------------------------------

def monthly_rollup(daily: DataFrame) -> DataFrame:
    """Daily panel to months: rain summed, other measures averaged, the rest (where present) first known."""
    def first_known(c: str) -> Column:
        return F.min_by(c, F.when(F.col(c).isNotNull(), F.col("date"))).alias(c)

    return (
        daily.groupBy("county", F.year("date").alias("year"), F.month("date").alias("month"))
        .agg(
            F.coalesce(F.sum("precip_mm"), F.lit(0.0)).alias("precip_mm"),
            *[F.avg(c).alias(c) for c in C.MEASURES if c != "precip_mm"],
            *[first_known(c) for c in ("fips", "lat", "lon", "case_count") if c in daily.columns],
        )
    )


def serving_rollup(weather: DataFrame, air: DataFrame) -> DataFrame:
    """Monthly environment history: weather totals and means with mean dust."""
    by_month = ["county", F.year("date").alias("year"), F.month("date").alias("month")]
    w = weather.groupBy(*by_month).agg(
        F.coalesce(F.sum("precip_mm"), F.lit(0.0)).alias("precip_mm"),
        F.avg("soil_moisture_m3m3").alias("soil_moisture"),
        F.avg("wind_speed_kmh").alias("wind_speed"),
    )
    a = air.groupBy(*by_month).agg(F.avg("pm10_ugm3").alias("pm10"))
    return w.join(a, ["county", "year", "month"], "left")


def seasonal_cases(monthly: DataFrame, weights=C.SEASONAL_WEIGHTS) -> DataFrame:
    """Yearly cases spread over the months by fixed weights."""
    share = F.element_at(F.create_map(*[F.lit(x) for p in weights.items() for x in p]), F.col("month"))
    return monthly.withColumn("monthly_cases", F.col("case_count") * share)


def monthly_features(monthly: DataFrame, drop_incomplete: bool = True) -> DataFrame:
    """Lag, roll and aridity columns; rows with any gap are dropped unless told otherwise."""
    order = ("year", "month")
    out = add_rolls(add_lags(monthly, C.MONTHLY_LAGS, order=order), C.MONTHLY_ROLLS, order=order)
    out = add_aridity(out)
    return out.dropna("any") if drop_incomplete else out
