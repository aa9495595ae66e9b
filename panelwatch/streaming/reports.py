"""Community reports, badges, subscriptions and alerts, batch and stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwatch import constants as C
from panelwatch.functions.text import entity_key, fill_template, literal_map


def resolve_place(df: DataFrame, places: DataFrame, column: str = "county", keep_unknown: bool = True) -> DataFrame:
    """Spelled place names to known ones, whatever their case, blanks and underscores.

    Unknown ones stay as typed or are dropped. ``places`` has one row per known
    ``county``; of names that differ in spelling only the first one counts.
    Works on streams: the places are the static side.
    """
    known = places.groupBy(entity_key(F.col("county")).alias("_key")).agg(F.min("county").alias("_known"))
    out = df.withColumn("_key", entity_key(F.col(column))).join(known, "_key", "left" if keep_unknown else "inner")
    return out.withColumn(column, F.coalesce("_known", column)).drop("_key", "_known")


def ingest(reports: DataFrame, limits=C.SEVERITY_RANGE, places: DataFrame | None = None) -> DataFrame:
    """Reports with the severity kept in range and, given ``places``, the typed place resolved; batches and streams."""
    named = reports if places is None else resolve_place(reports, places)
    return named.withColumn("severity", F.greatest(F.lit(limits[0]), F.least(F.lit(limits[1]), F.col("severity"))))


def badges(reports: DataFrame, needed: int = C.BADGE_REPORTS) -> DataFrame:
    """Reports per reporter, the last time, and whether the badge is earned; works on streams too."""
    return reports.groupBy("reporter_id").agg(
        F.count(F.lit(1)).alias("badge_count"), F.max("created_at").alias("last_report_at")
    ).withColumn("community_shield", F.col("badge_count") >= needed)


def badge_awards(reports: DataFrame, needed: int = C.BADGE_REPORTS) -> DataFrame:
    """The report that earned each badge: a reporter's ``needed``-th one.

    The row-number limit runs inside each task before the shuffle, so a reporter
    with very many reports sends ``needed`` rows per task.
    """
    oldest = Window.partitionBy("reporter_id").orderBy("created_at", "id")
    return (
        reports.select("reporter_id", "created_at", "id").withColumn("_rn", F.row_number().over(oldest))
        .filter(F.col("_rn") <= needed).filter(F.col("_rn") == needed)
        .select("reporter_id", F.col("id").alias("report_id"), F.col("created_at").alias("awarded_at"))
    )


def recent_reports(reports: DataFrame, now: Column, hours: int = C.REPORT_HOURS,
                   limit: int = C.REPORT_LIST_LIMIT) -> DataFrame:
    """Newest reports of the trailing hours per place, with the number listed there."""
    newest = Window.partitionBy("county").orderBy(F.desc("created_at"), F.desc("id"))
    listed = (
        within_hours(reports, now, hours).select("county", "id", "severity", "description", "created_at")
        .withColumn("position", F.row_number().over(newest)).filter(F.col("position") <= limit)
    )
    return listed.withColumn("listed", F.count(F.lit(1)).over(Window.partitionBy("county")))


def latest_reports(reports: DataFrame, limit: int = C.REPORT_LIST_LIMIT) -> DataFrame:
    """Newest reports overall; each task keeps ``limit`` rows."""
    return reports.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def within_hours(df: DataFrame, now: Column, hours: int, ts: str = "created_at") -> DataFrame:
    return df.filter(F.col(ts) > now - F.make_dt_interval(hours=F.lit(hours)))


def subscriptions(requests: DataFrame, languages=C.ALERT_LANGUAGES, default: str = C.DEFAULT_LANGUAGE,
                  places: DataFrame | None = None) -> DataFrame:
    """Current language per phone and place: the last request wins, unknown languages become the default.

    Given ``places``, typed names are resolved first, so two spellings of a place are one subscription.
    """
    lang = F.lower("language")
    known = F.when(lang.isin(list(languages)), lang).otherwise(F.lit(default))
    named = requests if places is None else resolve_place(requests, places)
    return named.groupBy("phone", "county").agg(
        F.max_by(known, F.struct("requested_at", "request_id")).alias("language")
    )


def alert_messages(subs: DataFrame, latest: DataFrame, templates=C.ALERT_LANGUAGES, advice=C.ADVICE_TEXTS,
                   tiers=C.ALERT_TIERS) -> DataFrame:
    """One message per subscription of a place in an alert tier.

    ``latest`` has one row per place; a place with very many subscribers is
    split by the adaptive skew join.
    """
    hot = latest.filter(F.col("risk_level").isin(tiers)).select("county", "risk_level")
    first_advice = F.element_at(literal_map({t: advice[t][0] for t in tiers}), F.col("risk_level"))
    template = F.element_at(literal_map(templates), F.col("language"))
    return subs.join(hot, "county").select(
        "phone", "county", "language", "risk_level",
        fill_template(template, {
            "risk_level": F.col("risk_level"), "county": F.col("county"), "advice": first_advice,
        }).alias("message"),
    )


# --- streams ----------------------------------------------------------------

def stream_ingest(reports: DataFrame, path: str, trigger: dict | None = None, places: DataFrame | None = None):
    """Append ingested reports to a table."""
    return (
        ingest(reports, places=places).writeStream.format("parquet").option("path", f"{path}/data")
        .option("checkpointLocation", f"{path}/_checkpoint").outputMode("append")
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def stream_badges(reports: DataFrame, path: str, trigger: dict | None = None):
    """Running badge table: every batch stores the reporters it changed (see ``read_latest``)."""
    from panelwatch.streaming.refresh import append_batch

    return (
        badges(reports).writeStream.outputMode("update").foreachBatch(append_batch(path))
        .option("checkpointLocation", f"{path}/_checkpoint").trigger(**(trigger or {"availableNow": True})).start()
    )


def windowed_counts(reports: DataFrame, length: str = "24 hours", slide: str = "1 hour",
                    late: str = "2 hours") -> DataFrame:
    """Reports per place in sliding windows; rows later than the watermark are dropped by a stream."""
    return (
        reports.withWatermark("created_at", late)
        .groupBy("county", F.window("created_at", length, slide).alias("w"))
        .agg(F.count(F.lit(1)).alias("reports"), F.max("severity").alias("max_severity"))
        .select("county", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                "reports", "max_severity")
    )


def windowed_counts_of_table(reports: DataFrame, hours: int = 24) -> DataFrame:
    """:func:`windowed_counts` with hourly steps for a table: reports are counted by hour first.

    What is multiplied by ``hours`` is one row per place and hour, not every report.
    """
    hour = F.date_trunc("hour", "created_at")
    hourly = reports.groupBy("county", hour.alias("_hour")).agg(F.count(F.lit(1)).alias("_n"), F.max("severity").alias("_s"))
    back = F.explode(F.sequence(F.lit(0), F.lit(hours - 1))).alias("_back")
    length = F.make_dt_interval(hours=F.lit(hours))
    return (
        hourly.select("*", back).withColumn("window_start", F.col("_hour") - F.make_dt_interval(hours=F.col("_back")))
        .groupBy("county", "window_start").agg(F.sum("_n").alias("reports"), F.max("_s").alias("max_severity"))
        .select("county", "window_start", (F.col("window_start") + length).alias("window_end"), "reports", "max_severity")
    )


def stream_windowed_counts(reports: DataFrame, path: str, trigger: dict | None = None, **window):
    """Append closed windows to a table."""
    return (
        windowed_counts(reports, **window).writeStream.outputMode("append").format("parquet")
        .option("path", f"{path}/data").option("checkpointLocation", f"{path}/_checkpoint")
        .trigger(**(trigger or {"availableNow": True})).start()
    )
