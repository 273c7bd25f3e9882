"""Sources and their synchronisation history."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderwatch import schemas as S
from tenderwatch.functions import scoring as C


def active_sources(sources: DataFrame) -> DataFrame:
    return sources.where("active")


def source_by_name(sources: DataFrame, name: str) -> DataFrame:
    return sources.where(F.col("name") == name)


def due_sources(sources: DataFrame, now: datetime | str | Column) -> DataFrame:
    """Active sources never synchronised, or not for at least their frequency in whole days."""
    moment = now if isinstance(now, Column) else F.lit(str(now)).cast("timestamp")
    elapsed = C.elapsed_days(F.col("last_sync"), moment)
    return sources.where(
        F.col("active") & (F.col("last_sync").isNull() | (elapsed >= F.col("every_days")))
    )


def history_by_source(history: DataFrame, source_id: int | None = None) -> DataFrame:
    """History, newest first; of one source if given."""
    rows = history.where(F.col("source_id") == source_id) if source_id is not None else history
    return rows.orderBy(F.desc("started_at"), "id")


def with_source_name(history: DataFrame, sources: DataFrame) -> DataFrame:
    names = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    return history.join(names, "source_id", "left")


def with_duration(history: DataFrame) -> DataFrame:
    return history.withColumn("seconds", C.seconds_between(F.col("started_at"), F.col("ended_at")))


def duplicate_rate(history: DataFrame) -> DataFrame:
    seen = F.col("inserted") + F.col("duplicates")
    return history.withColumn("duplicate_rate", C.pct(F.col("duplicates"), seen))


def watermarks(sources: DataFrame, history: DataFrame) -> DataFrame:
    """Sources with ``last_sync`` moved to the latest successful end, and the next first day."""
    latest = (
        history.where(F.col("state") == S.SYNC_OK)
        .groupBy(F.col("source_id").alias("id"))
        .agg(F.max("ended_at").alias("ended_at"))
    )
    return (
        sources.join(latest, "id", "left")
        .withColumn("last_sync", F.coalesce("ended_at", "last_sync"))
        .withColumn("next_from", F.coalesce(F.to_date("last_sync"), F.lit(S.FIRST_DAY).cast("date")))
        .drop("ended_at")
    )


def latest_sync_per_source(history: DataFrame) -> DataFrame:
    """Newest history row per source, flagged when it failed; one aggregate, no window."""
    newest = F.max_by(F.struct("id", "started_at", "state"), F.struct("started_at", "id"))
    return (
        history.groupBy("source_id")
        .agg(newest.alias("last"))
        .select("source_id", "last.*", (F.col("last.state") == S.SYNC_ERROR).alias("failed"))
    )


def _per_source(history: DataFrame) -> DataFrame:
    return history.groupBy(F.col("source_id").alias("id")).agg(
        F.count("*").alias("n_syncs"),
        F.max_by("state", F.struct("started_at", "id")).alias("last_state"),
        F.sum("fetched").alias("fetched"),
        F.sum("inserted").alias("inserted"),
        F.sum("duplicates").alias("duplicates"),
    )


def source_history(sources: DataFrame, history: DataFrame) -> DataFrame:
    """Every source with its number of syncs, also those without any.

    The history is aggregated before the join: a source with a third of all rows is one row.
    """
    joined = sources.select("id", "name").join(_per_source(history), "id", "left")
    return joined.select("id", "name", F.coalesce("n_syncs", F.lit(0)).cast("long").alias("n_syncs"), "last_state")


def sync_comparison(sources: DataFrame, history: DataFrame) -> DataFrame:
    """Totals, last state and duplicate rate per source."""
    joined = sources.select("id", "name").join(_per_source(history), "id", "left")
    totals = joined.select(
        "id",
        "name",
        "last_state",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("fetched", "inserted", "duplicates")],
    )
    return duplicate_rate(totals)


def sync_status_counts(history: DataFrame) -> DataFrame:
    """Rows per state, states without rows included, and the total."""
    counts = [F.count_if(F.col("state") == s).alias(s) for s in S.SYNC_STATES]
    pairs = ", ".join(f"'{s}', {s}" for s in S.SYNC_STATES)
    return history.agg(*counts, F.count("*").alias("total")).selectExpr(
        f"stack({len(S.SYNC_STATES)}, {pairs}) AS (state, n)", "total"
    )


def recent_syncs(history: DataFrame, rows: int = 5) -> DataFrame:
    return history_by_source(history).limit(rows)


def source_kpis(sources: DataFrame) -> DataFrame:
    return sources.agg(
        F.count("*").alias("n_sources"),
        F.count_if("active").alias("n_active"),
        F.count_if(~F.col("active")).alias("n_inactive"),
        F.max("last_sync").alias("last_sync"),
    )
