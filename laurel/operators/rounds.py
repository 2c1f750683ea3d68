"""Round targets: merge of discoveries, retirement, lookups and metadata messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laurel.functions.times import is_collectable, overlaps
from laurel.operators.grouping import attach_lookup


def refresh_rounds(existing: DataFrame, found: DataFrame, start: Column, end: Column) -> DataFrame:
    """Round targets after a discovery.

    Found rounds are active and take the found attributes (a retired one becomes discovered
    again); rounds of the window that were not found again are retired; others stay.
    """
    attributes = [c for c in found.columns if c != "round_id"]
    new = found.select("round_id", F.struct(*attributes).alias("_new"))
    joined = existing.join(new, "round_id", "full_outer")
    seen = F.col("_new").isNotNull()
    relevant = overlaps("competition_start", "competition_end", start, end)
    retired = ~seen & F.coalesce(relevant, F.lit(False))
    status = (
        F.when(seen & (F.col("status").isNull() | (F.col("status") == "retired")), "discovered")
        .when(retired, "retired")
        .otherwise(F.col("status"))
    )
    active = F.when(seen, True).when(retired, False).otherwise(F.col("active"))
    return joined.select(
        "round_id",
        *[
            F.when(seen, F.col("_new")[a]).otherwise(F.col(a)).alias(a) if a in existing.columns
            else F.col("_new")[a].alias(a)
            for a in attributes
        ],
        status.alias("status"),
        active.alias("active"),
    )


def rounds_without_format(rounds: DataFrame) -> DataFrame:
    """Rounds whose number of attempts is unknown; refreshing them must fail."""
    return rounds.where(F.col("expected_attempts").isNull())


def merge_discovery(existing: DataFrame, found: DataFrame, as_of: Column, grace_minutes: int = 720) -> DataFrame:
    """Competition targets after a discovery.

    * a found row whose detail could not be verified only records the error;
    * a ready row replaces the target and is active while collectable, else pending;
    * a row that is not ready yet keeps a known live id and only refreshes the description;
    * a target that was not listed, or is past its end and grace period, is retired.
    """
    new = found.select("slug", F.struct(*[c for c in found.columns if c != "slug"]).alias("_f"))
    joined = existing.join(new, "slug", "full_outer")
    f, listed = F.col("_f"), F.col("_f").isNotNull()
    known = F.col("status").isNotNull()
    verified = listed & f["detail_verified"]
    ready = verified & f["live_id"].isNotNull()
    kept = known | verified

    def described(name: str) -> Column:
        return F.when(verified, F.coalesce(f[name], F.col(name))).otherwise(F.col(name))

    end = described("end_date")
    active_now = F.coalesce("active", F.lit(False)) | verified & (ready | ~known)
    expired = active_now & (~listed | ~is_collectable(end, as_of, grace_minutes))
    status = (
        F.when(expired, "retired")
        .when(ready, F.when(is_collectable(f["end_date"], as_of, grace_minutes), "active").otherwise("pending"))
        .when(known, F.col("status"))
        .otherwise("pending")
    )
    live_id = F.when(ready, f["live_id"]).otherwise(F.col("live_id"))
    return joined.where(kept).select(
        "slug",
        live_id.alias("live_id"),
        described("official_id").alias("official_id"),
        described("name").alias("name"),
        described("start_date").alias("start_date"),
        end.alias("end_date"),
        status.alias("status"),
        (active_now & ~expired).alias("active"),
        F.when(listed, f["error"]).otherwise(F.col("last_error")).alias("last_error"),
        (active_now & ~expired & live_id.isNotNull() & is_collectable(end, as_of, grace_minutes)).alias(
            "collectable"
        ),
    )


def retire_missing_rounds(existing: DataFrame, found: DataFrame) -> DataFrame:
    """Rounds of rediscovered competitions that are gone become inactive."""
    key = ["slug", "event_id", "round_id"]
    merged = existing.join(
        found.select(*key, F.lit(True).alias("_seen")).distinct(), key, "full_outer"
    ).join(found.select("slug", F.lit(True).alias("_listed")).distinct(), "slug", "left")
    active = F.when(F.col("_seen"), True).when(F.col("_listed"), False).otherwise(F.col("active"))
    return merged.withColumn("active", active).drop("_seen", "_listed")


def find_rounds(rows: DataFrame, rounds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with their active round, and rows without one for quarantine."""
    key = ["competition_id", "event_id", "round_id"]
    extra = [c for c in rounds.columns if c not in (*key, "active")]
    table = rounds.where("active").select(*key, *extra, F.lit(True).alias("_found"))
    joined = attach_lookup(rows, table, key)
    return (
        joined.where(F.col("_found")).drop("_found"),
        joined.where(F.col("_found").isNull()).select(*rows.columns, F.lit("unknown round").alias("error")),
    )


def apply_round_messages(rounds: DataFrame, messages: DataFrame) -> DataFrame:
    """Round attributes after status messages; absent fields keep their value.

    ``messages``: key, ``seq`` and nullable ``source_status, format, cutoff, time_limit,
    round_name``.
    """
    key = ["competition_id", "event_id", "round_id"]
    fields = [c for c in messages.columns if c not in (*key, "seq")]
    last = messages.groupBy(*key).agg(
        *[
            F.max_by(f, F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f"_{f}")
            for f in fields
        ]
    )
    rows = attach_lookup(rounds, last, key)
    return rows.withColumns({f: F.coalesce(f"_{f}", f) for f in fields}).drop(*[f"_{f}" for f in fields])


def ordered_rounds(rounds: DataFrame) -> DataFrame:
    return rounds.orderBy("event_id", "round_number", "round_id")


def latest_round_times(frames: DataFrame) -> DataFrame:
    """Last message and last snapshot per round; an unchanged snapshot advances both."""
    return frames.groupBy("round_id").agg(
        F.max("observed_at").alias("last_message_at"),
        F.max(F.when(F.col("type") == "snapshot", F.col("observed_at"))).alias("last_snapshot_at"),
    )
