"""Which methods detected a record, when, and how far apart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laurel.functions import fixed
from laurel.functions.text import source_label
from laurel.functions.times import seconds_between
from laurel.operators.grouping import attach_lookup


def _first_per_method(detections: DataFrame, key: str) -> DataFrame:
    """Earliest detection per (key, method), as one map per key; a key has few methods."""
    first = F.min_by(F.struct("detected_at", "status"), F.struct("detected_at", "detection_id"))
    per_method = detections.groupBy(key, "method").agg(first.alias("_first"))
    entry = F.struct("method", F.col("_first.detected_at").alias("detected_at"), "_first.status")
    return per_method.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("_entries"))


def _timestamps(entries: Column) -> Column:
    return F.map_from_entries(F.transform(entries, lambda e: F.struct(e["method"], e["detected_at"])))


def comparison(detections: DataFrame, key: str = "comparison_key") -> DataFrame:
    """One row per record: earliest detection per method and delays to the earliest."""
    rows = _first_per_method(detections, key)
    entries = F.col("_entries")
    stamps = _timestamps(entries)
    earliest = F.array_min(F.transform(entries, lambda e: e["detected_at"]))
    polled = F.try_element_at(stamps, F.lit(fixed.POLLED))
    subscribed = F.try_element_at(stamps, F.lit(fixed.SUBSCRIBED))
    return rows.select(
        key,
        (F.size(entries) > 1).alias("matched"),
        F.transform(entries, lambda e: e["method"]).alias("methods"),
        stamps.alias("detected_at"),
        F.map_from_entries(
            F.transform(
                entries, lambda e: F.struct(e["method"], seconds_between(e["detected_at"], earliest))
            )
        ).alias("seconds_after_earliest"),
        F.map_from_entries(F.transform(entries, lambda e: F.struct(e["method"], e["status"]))).alias("status"),
        seconds_between(polled, subscribed).alias("polled_minus_subscribed_seconds"),
    )


def comparison_by_key(detections: DataFrame, key: str = "comparison_key") -> DataFrame:
    """``comparison`` in the order of its key, as it is shown."""
    return comparison(detections, key).orderBy(key)


def comparison_table(detections: DataFrame, key: str, methods: Sequence[str]) -> DataFrame:
    """The same as flat columns for a fixed list of methods."""
    aggregates = [
        F.min(F.when(F.col("method") == m, F.col("detected_at"))).alias(f"{m}_at") for m in methods
    ]
    rows = detections.groupBy(key).agg(*aggregates)
    earliest = F.least(*[F.col(f"{m}_at") for m in methods])
    found = sum(F.col(f"{m}_at").isNotNull().cast("int") for m in methods)
    return rows.select(
        "*",
        (found > 1).alias("matched"),
        *[seconds_between(f"{m}_at", earliest).alias(f"{m}_delay") for m in methods],
    )


def detection_matches(detections: DataFrame, key: str = "comparison_key") -> DataFrame:
    """Each detection with the other methods' first detections of the same record."""
    rows = attach_lookup(detections, _first_per_method(detections, key), [key])
    others = F.filter("_entries", lambda e: e["method"] != F.col("method"))
    other_first = F.array_min(F.transform(others, lambda e: e["detected_at"]))
    own = F.struct(F.col("method"), F.col("detected_at"))
    other_stamps = F.transform(others, lambda e: F.struct(e["method"], e["detected_at"]))
    return rows.select(
        *detections.columns,
        source_label("method").alias("source_name"),
        (F.size(others) > 0).alias("matched_elsewhere"),
        other_first.alias("other_detected_at"),
        seconds_between("detected_at", other_first).alias("difference_seconds"),
        F.transform(others, lambda e: e["method"]).alias("matching_methods"),
        F.map_from_entries(F.concat(F.array(own), other_stamps)).alias("timestamps"),
        F.map_from_entries(
            F.transform(
                others,
                lambda e: F.struct(e["method"], seconds_between(F.col("detected_at"), e["detected_at"])),
            )
        ).alias("deltas_seconds"),
    )
