"""Late and corrected days: recompute the months and features that depend on them, and leave the rest alone.

A changed day changes its own month, and through lags and rolling means the months after it. So the months that hold a
changed day are rolled up again, and the features of a place are computed again from its first such month on, with as
many months before it as the longest lag looks back. All other rows are kept as stored. The result equals a computation
from scratch on the corrected days.

Sizes: only days of touched months are read again, and only the places with a change; restart points are one row per
place. In stream form every table is a folder of loads, and a repeated batch overwrites its own load.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwatch import constants as C
from panelwatch.functions.text import month_index
from panelwatch.operators import panel
from panelwatch.plans.pipeline import monthly_master
from panelwatch.session import materialize, read_if_there
from panelwatch.streaming.refresh import upsert

#: Months before a restart point that the longest lag or rolling mean needs.
REACH = max([n for *_, n in C.MONTHLY_LAGS] + [n - 1 for *_, n in C.MONTHLY_ROLLS])

_MONTH = ["county", "year", "month"]


class Refreshed(NamedTuple):
    """The tables after a late load, and where the features of each changed place start anew."""

    days: DataFrame
    months: DataFrame
    features: DataFrame
    restart: DataFrame


def changed_days(stored: DataFrame, incoming: DataFrame, key=("county", "date")) -> DataFrame:
    """Keys of incoming rows that are new or differ from the stored row in any value; nulls are compared as values."""
    values = [c for c in incoming.columns if c not in (*key, "load_id")]
    before = stored.select(*key, F.struct(*values).alias("_before"))
    same = F.struct(*values).eqNullSafe(F.col("_before"))
    return incoming.join(before, list(key), "left").filter(~same).select(*key).distinct()


def touched_months(changed: DataFrame) -> DataFrame:
    """(county, year, month) that hold a changed day."""
    return changed.select("county", F.year("date").alias("year"), F.month("date").alias("month")).distinct()


def restart_points(touched: DataFrame) -> DataFrame:
    """(county, restart): the first touched month of each place on one running axis."""
    return touched.groupBy("county").agg(F.min(month_index(F.col("year"), F.col("month"))).alias("restart"))


def days_of(days: DataFrame, touched: DataFrame) -> DataFrame:
    """Days of the touched months."""
    dated = days.withColumn("year", F.year("date")).withColumn("month", F.month("date"))
    return dated.join(touched, _MONTH, "left_semi").drop("year", "month")


def roll_up(days: DataFrame, air: DataFrame, cases: DataFrame, meta: DataFrame) -> DataFrame:
    """Monthly rows of the given days."""
    return panel.seasonal_cases(monthly_master(days, air, cases, meta))


def replace_months(stored: DataFrame, fresh: DataFrame, touched: DataFrame) -> DataFrame:
    """Stored months that were not touched, and the fresh ones."""
    return stored.join(touched, _MONTH, "left_anti").unionByName(fresh)


def features_from(months: DataFrame, restart: DataFrame, reach: int = REACH) -> DataFrame:
    """Features of the changed places from their restart month on."""
    t = month_index(F.col("year"), F.col("month"))
    ahead = t >= F.col("restart")
    newest = Window.partitionBy("county", ahead).orderBy(F.desc(t))
    needed = months.join(restart, "county").withColumn("_rn", F.row_number().over(newest)).filter(ahead | (F.col("_rn") <= reach))
    return panel.monthly_features(needed.drop("_rn"), drop_incomplete=False).filter(ahead).drop("restart")


def replace_features(stored: DataFrame, fresh: DataFrame, restart: DataFrame) -> DataFrame:
    """Stored rows before each place's restart, and the fresh ones."""
    t = month_index(F.col("year"), F.col("month"))
    kept = stored.join(restart, "county", "left").filter(F.col("restart").isNull() | (t < F.col("restart"))).drop("restart")
    return kept.unionByName(fresh)


def apply_late(days: DataFrame, months: DataFrame, features: DataFrame, incoming: DataFrame, air: DataFrame,
               cases: DataFrame, meta: DataFrame) -> Refreshed:
    """Take ``incoming`` days (newest load wins) into the stored tables.

    ``days`` and ``incoming`` carry a ``load_id``; the stored tables should be written ones.
    """
    touched = materialize(touched_months(changed_days(days, incoming)), "late-months")
    merged = upsert(days, incoming)
    fresh = materialize(roll_up(days_of(merged.drop("load_id"), touched), days_of(air, touched), cases, meta), "late-rollup")
    all_months = replace_months(months, fresh, touched)
    restart = restart_points(touched)
    return Refreshed(merged, all_months, replace_features(features, features_from(all_months, restart), restart), restart)


# --- streams ----------------------------------------------------------------

def _stored(spark, path: str, schema, before: int, key: list[str], years: list[int] | None = None) -> DataFrame:
    """Newest row per key over the loads before ``before``; empty if there is no load yet."""
    rows = read_if_there(spark, path)
    if rows is None:
        return spark.createDataFrame([], schema)
    rows = rows.filter(F.col("load_id") < before)
    if years is not None:
        rows = rows.filter(F.col("year").isin(years))
    return panel.unique_steps(rows, key, ["load_id"]).select(*schema.names)


def _append(rows: DataFrame, path: str, load: int) -> None:
    """Store a load; the same load again replaces just itself."""
    (rows.withColumn("load_id", F.lit(load).cast("long")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("load_id", "year").parquet(path))


def late_batch(path: str, air: DataFrame, cases: DataFrame, meta: DataFrame):
    """``foreachBatch`` writer that keeps the tables ``days``, ``months`` and ``features`` below ``path`` current.

    Days are read again by year: only the years that hold a change.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        own = materialize(batch.withColumn("year", F.year("date")), "late-batch")
        years = [r[0] for r in own.select("year").distinct().collect()]  # bounded by the calendar
        days = _stored(spark, f"{path}/days", own.schema, batch_id, ["county", "date"], years)
        newest = panel.unique_steps(own, ["county", "date"], [c for c in own.columns if c not in ("county", "date")])
        touched = materialize(touched_months(changed_days(days, newest)), "late-months")
        merged = upsert(days.withColumn("load_id", F.lit(0)), newest.select(*own.columns).withColumn("load_id", F.lit(1)))
        fresh = materialize(roll_up(days_of(merged.drop("load_id", "year"), touched), days_of(air, touched), cases, meta), "late-rollup")
        months = _stored(spark, f"{path}/months", fresh.schema, batch_id, _MONTH)
        restart = restart_points(touched)
        features = features_from(replace_months(months, fresh, touched), restart)
        _append(features, f"{path}/features", batch_id)
        _append(fresh, f"{path}/months", batch_id)
        _append(newest, f"{path}/days", batch_id)

    return write


def stream_late(source: DataFrame, path: str, air: DataFrame, cases: DataFrame, meta: DataFrame, trigger: dict | None = None):
    """Run :func:`late_batch` on a stream of days; :func:`current_features` reads the result."""
    return (
        source.writeStream.foreachBatch(late_batch(path, air, cases, meta)).option("checkpointLocation", f"{path}/_checkpoint")
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def current_features(spark, path: str) -> DataFrame:
    """The newest features of each place and month."""
    rows = spark.read.parquet(f"{path}/features")
    return panel.unique_steps(rows, _MONTH, ["load_id"]).drop("load_id")
