"""Retention of raw frames and one-off conversions of older data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laurel.functions.status import is_trusted
from laurel.operators.feed import level_rank
from laurel.operators.grouping import attach_group


def expire_frames(frames: DataFrame, days: int, as_of: Column, at: str = "observed_at") -> DataFrame:
    """Frames to keep: those not older than ``days``; 0 or less keeps everything."""
    if days <= 0:
        return frames
    return frames.where(F.col(at) >= as_of - F.make_dt_interval(days=F.lit(days)))


def unlink_expired(observations: DataFrame, kept: DataFrame) -> DataFrame:
    """Normalized rows survive their raw frame; only the link is cleared."""
    ids = kept.select(F.col("frame_id").alias("raw_id"), F.lit(True).alias("_kept"))
    rows = observations.join(ids, "raw_id", "left")
    return rows.withColumn("raw_id", F.when(F.col("_kept"), F.col("raw_id"))).drop("_kept")


def claims_to_results(detections: DataFrame) -> DataFrame:
    """Canonical results from old per-claim rows.

    The key loses its level suffix; the first claim describes the result and a trusted claim, the
    last one, settles value and validation.
    """
    suffix = F.concat(F.lit("|"), F.col("level"))
    key = F.when(
        F.col("comparison_key").endswith(suffix),
        F.substr("comparison_key", F.lit(1), F.length("comparison_key") - F.length(suffix)),
    ).otherwise(F.col("comparison_key"))
    order = F.struct("detected_at", "detection_id")
    trusted = is_trusted("method")
    first = F.min_by(F.struct("value", "status", "method"), order)
    last = F.max_by(F.struct("value", "detection_id"), F.when(trusted, order))
    rows = detections.withColumn("identity_key", key).groupBy("identity_key").agg(
        first.alias("_first"), last.alias("_trusted"), F.min("detected_at").alias("first_observed_at")
    )
    backed = F.col("_trusted").isNotNull()
    return rows.select(
        "identity_key",
        F.coalesce("_trusted.value", "_first.value").alias("value"),
        F.when(F.col("_first.status") == "withdrawn", "retracted").otherwise("active").alias("status"),
        F.when(backed, "verified").otherwise("pending").alias("validation_status"),
        F.when(backed, "trusted_source_observation")
        .otherwise("untrusted_source_only")
        .alias("validation_reason"),
        "first_observed_at",
    )


def visible_achievements(achievements: DataFrame) -> DataFrame:
    """Only the highest active level of a result is shown and announced."""
    best = F.min(F.when(F.col("status") == "active", level_rank())).alias("_best")
    rows = attach_group(achievements, ["identity_key"], [best])
    shown = (F.col("status") == "active") & (level_rank() == F.col("_best"))
    return rows.withColumns(
        {
            "shown": F.coalesce(shown, F.lit(False)),
            "reason": F.when(shown, "eligible").otherwise("superseded_by_higher_achievement"),
        }
    ).drop("_best")


FAMILY = ["competition_id", "person_id", "event_id", "round_number", "kind"]


def retire_attempt_results(results: DataFrame) -> DataFrame:
    """Retract old attempt-level results for which a finalized result exists."""
    legacy = F.col("identity_key").contains("|attempt:") | F.col("identity_key").endswith("|aggregate")
    complete = (F.col("competition_id") != "") & (F.col("person_id") != "") & F.col("round_number").isNotNull()
    final = (
        results.where(F.col("status").isin("active", "corrected") & ~legacy & complete)
        .select(*FAMILY, F.lit(True).alias("_final"))
        .distinct()
    )
    rows = results.join(final, FAMILY, "left")
    retired = legacy & complete & F.coalesce("_final", F.lit(False))
    return rows.withColumns(
        {
            "status": F.when(retired, "retracted").otherwise(F.col("status")),
            "validation_status": F.when(retired, "pending").otherwise(F.col("validation_status")),
            "validation_reason": F.when(retired, "superseded_by_finalized_result").otherwise(
                F.col("validation_reason")
            ),
        }
    ).drop("_final")


def first_revisions(results: DataFrame) -> DataFrame:
    """One initial revision per existing canonical result."""
    action = (
        F.when(F.col("status") == "retracted", "retracted")
        .when(F.col("status") == "corrected", "corrected")
        .otherwise("active")
    )
    return results.withColumn("action", action)


