"""Freshness and incremental refresh, batch and stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwatch import constants as C
from panelwatch.operators.panel import unique_steps
from panelwatch.session import scratch_path


def high_water(available: DataFrame, state: DataFrame) -> DataFrame:
    """Per source the newest available date against the stored one.

    ``available`` is ``source, date`` rows; only one maximum per source and task
    is shuffled.
    """
    newest = available.groupBy("source").agg(F.max("date").alias("latest_available"))
    joined = newest.join(state.select("source", F.col("last_date").alias("our_latest")), "source", "left")
    return joined.withColumn("has_new_data", F.coalesce(
        F.col("our_latest").isNull() & F.col("latest_available").isNotNull()
        | (F.col("latest_available") > F.col("our_latest")), F.lit(False),
    ))


def due_sources(state: DataFrame, now: Column, cadence=C.REFRESH_CADENCE_HOURS) -> DataFrame:
    """Whether each source's check is due: never checked, or longer ago than its cadence."""
    hours = F.try_element_at(F.create_map(*[F.lit(x) for p in cadence.items() for x in p]), F.col("source"))
    return state.withColumn(
        "due", F.coalesce(F.col("last_check") + F.make_dt_interval(hours=hours) < now, F.lit(True))
    )


def next_load(incoming: DataFrame, last_date: Column, end: Column) -> DataFrame:
    """Incoming rows from the day after the stored date up to ``end``.

    Nothing is loaded unless that start lies before ``end``.
    """
    start = F.date_add(last_date, 1)
    return incoming.filter((F.col("date") >= start) & (F.col("date") <= end) & (start < end))


def upsert(existing: DataFrame, incoming: DataFrame, key=("county", "date")) -> DataFrame:
    """Union in which the later load wins per key; within a load its ``load_id`` decides."""
    both = existing.withColumn("_load", F.lit(0)).unionByName(incoming.withColumn("_load", F.lit(1)))
    return unique_steps(both, list(key), ["_load", "load_id"]).drop("_load")


def years_to_fetch(existing: DataFrame, first_year: int, current_year: int) -> DataFrame:
    """Years that are missing, plus the current and the prior one, which are always read again.

    The calendar is one short sequence; stored years arrive as one array.
    """
    stored = existing.agg(F.collect_set(F.year("date")).alias("years")).select(
        F.explode(F.sequence(F.lit(first_year), F.lit(current_year))).alias("year"), "years"
    )
    missing = ~F.array_contains("years", F.col("year"))
    return stored.filter(missing | (F.col("year") >= current_year - 1)).select("year")


def replace_years(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Existing rows of years not fetched again, plus all new rows."""
    fetched = new.select(F.year("date").alias("_year")).distinct()
    kept = existing.withColumn("_year", F.year("date")).join(fetched, "_year", "left_anti").drop("_year")
    return kept.unionByName(new)


def yearly_file_freshness(files: DataFrame, last_date: Column, current_year: int) -> DataFrame:
    """One row: the file year to load, if this year's file (else the prior one) is newer than the data.

    ``files`` has one ``year`` per listed file.
    """
    this = F.count_if(F.col("year") == current_year) > 0
    prior = F.count_if(F.col("year") == current_year - 1) > 0
    year = F.when(this, F.lit(current_year)).when(prior, F.lit(current_year - 1))
    first_day = F.make_date(F.col("year_available"), F.lit(1), F.lit(1))
    return files.agg(year.alias("year_available")).withColumn(
        "has_new_data",
        F.col("year_available").isNotNull() & F.coalesce(last_date < first_day, F.lit(True)),
    )


def cases_freshness(cases: DataFrame | None, stored_year: int | None, current_hash: Column | None = None,
                    stored_hash: str | None = None, spark=None) -> DataFrame:
    """One row ``has_new_data, reason``: changed file, newer year, or no table yet."""
    if cases is None:
        return spark.createDataFrame([(True, "missing")], "has_new_data boolean, reason string")
    changed = F.lit(False) if current_hash is None else ~current_hash.eqNullSafe(F.lit(stored_hash))
    newer = F.lit(False) if not stored_year else F.coalesce(F.col("max_year") > stored_year, F.lit(False))
    reason = F.when(changed, F.lit("modified")).when(newer, F.lit("new_year")).otherwise(F.lit("none"))
    return cases.agg(F.max("year").alias("max_year")).select(
        (changed | newer).alias("has_new_data"), reason.alias("reason"), "max_year"
    )


def yearly_files(state: DataFrame, files: DataFrame, current_year: int, key: str = "source") -> DataFrame:
    """:func:`yearly_file_freshness` for every row of a state table.

    ``state``: key and ``last_date``; ``files``: key and ``year`` of each listed
    file. Two flags per key are all that is shuffled.
    """
    listed = files.groupBy(key).agg(
        (F.count_if(F.col("year") == current_year) > 0).alias("_this"),
        (F.count_if(F.col("year") == current_year - 1) > 0).alias("_prior"),
    )
    year = F.when(F.col("_this"), F.lit(current_year)).when(F.col("_prior"), F.lit(current_year - 1))
    first_day = F.make_date(F.col("year_available"), F.lit(1), F.lit(1))
    return state.join(listed, key, "left").withColumn("year_available", year).withColumn(
        "has_new_data",
        F.col("year_available").isNotNull() & F.coalesce(F.col("last_date") < first_day, F.lit(True)),
    ).drop("_this", "_prior")


def case_files(cases: DataFrame, key: str = "county", version: tuple[str, ...] = ("year", "case_count")) -> DataFrame:
    """Content hash and last year of the case table of each key: what a stored state is compared with.

    A key holds one row per year, so its sorted rows are bounded by the calendar.
    """
    rows = F.array_sort(F.collect_list(F.concat_ws(":", F.lpad(F.col(version[0]).cast("string"), 4, "0"), *[F.col(c).cast("string") for c in version[1:]])))
    return cases.groupBy(key).agg(F.sha2(F.array_join(rows, "\n"), 256).alias("hash"), F.max("year").alias("max_year"))


def case_file_freshness(state: DataFrame, files: DataFrame, key: str = "county") -> DataFrame:
    """Per expected case table whether to load it, and why: ``missing``, ``modified``, ``new_year`` or ``none``.

    ``state``: key, ``stored_hash`` and ``stored_year``; ``files``: what
    :func:`case_files` gives for the tables that exist. A table that is not there
    needs its first load; a changed one is loaded whatever its years.
    """
    joined = state.join(files, key, "left")
    changed = ~F.col("hash").eqNullSafe(F.col("stored_hash"))
    newer = (F.col("stored_year") != 0) & (F.col("max_year") > F.col("stored_year"))
    reason = (F.when(F.col("hash").isNull(), F.lit("missing")).when(changed, F.lit("modified"))
              .when(F.coalesce(newer, F.lit(False)), F.lit("new_year")).otherwise(F.lit("none")))
    return joined.withColumn("reason", reason).withColumn("has_new_data", F.col("reason") != "none")


def status(state: DataFrame) -> DataFrame:
    """One row: last run, last checks and the date each source is loaded through."""
    sources = list(C.REFRESH_CADENCE_HOURS)
    return state.agg(
        F.max("last_run").alias("last_pipeline_run"),
        *[F.max(F.when(F.col("source") == s, F.col("last_check"))).alias(f"{s}_last_check") for s in sources],
        *[F.max(F.when(F.col("source") == s, F.col("last_date"))).alias(f"{s}_through") for s in sources],
    )


# --- streams ----------------------------------------------------------------

def append_batch(path: str):
    """``foreachBatch`` writer that stores each batch as its own ``load_id`` partition.

    The work per batch follows the batch, not the table. A batch that is
    repeated after a failure overwrites just its own partition.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        (
            batch.withColumn("load_id", F.lit(batch_id).cast("long")).write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic").partitionBy("load_id").parquet(f"{path}/data")
        )

    return write


def stream_upsert(source: DataFrame, path: str, trigger: dict | None = None):
    """Collect the loads of a file stream; ``read_latest`` gives the newest row per key."""
    return (
        source.writeStream.foreachBatch(append_batch(path)).option("checkpointLocation", f"{path}/_checkpoint")
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def read_latest(spark, path: str, key: list[str], within: tuple[str, ...] = ()) -> DataFrame:
    """Newest row per key; ``within`` orders repeats inside one load."""
    return unique_steps(spark.read.parquet(f"{path}/data"), key, ["load_id", *within])


def compact(spark, path: str, target: str, key: list[str], within: tuple[str, ...] = ()) -> None:
    """Write the newest rows as the first load of a new table, so that reads stay short."""
    latest = read_latest(spark, path, key, within).withColumn("load_id", F.lit(-1).cast("long"))
    latest.write.partitionBy("load_id").parquet(f"{target}/data")


def run_to_end(query) -> None:
    """Wait for an available-now query and raise its error, if any."""
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def stream_table(spark, name: str) -> str:
    """Fresh folder for a stream's table and checkpoint."""
    return scratch_path(spark, name)
