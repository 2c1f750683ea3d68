"""Validation of results against official record benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laurel.functions import fixed
from laurel.functions.status import is_trusted
from laurel.functions.values import is_complete
from laurel.operators.grouping import attach_lookup

KEY = ["level", "event_id", "kind", "region"]


def regions(continent="continent", records_name="records_name") -> Column:
    """(level, region) pairs a result is checked against; unknown places are left out."""

    def pair(level: str, region: Column) -> Column:
        return F.struct(F.lit(level).alias("level"), region.alias("region"))

    continent, country = F.nullif(F.col(continent), F.lit("")), F.nullif(F.col(records_name), F.lit(""))
    return F.array_compact(
        F.array(
            pair("WR", F.lit("")),
            F.when(continent.isNotNull(), pair("CR", F.concat(F.lit("_"), continent))),
            F.when(country.isNotNull(), pair("NR", country)),
        )
    )


def validations(results: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """Verdict per (result, level) that has a benchmark.

    ``results`` are complete heads whose value the second source reports, with ``continent`` and
    ``records_name``. Meeting a benchmark includes equalling it.
    """
    asked = results.where(is_complete("value")).select("*", F.inline(regions()))
    meets = F.col("value") <= F.col("benchmark")
    table = benchmarks.select(*KEY, F.col("value").alias("benchmark"))
    return (
        attach_lookup(asked, table, KEY)
        .where(F.col("benchmark").isNotNull())
        .withColumns(
            {
                "validation": F.when(meets, "verified").otherwise("rejected"),
                "reason": F.when(meets, "meets_official_wca_record_benchmark").otherwise(
                    "does_not_meet_official_wca_record_benchmark"
                ),
            }
        )
    )


def head_validation(heads: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Validation of heads without trusted evidence, from their verdicts.

    Heads keep their status when trusted evidence has their value, when trusted sources disagree,
    or when they are not checked at all (``checked`` is false).
    """
    best = verdicts.groupBy("canonical_id").agg(
        F.bool_or(F.col("validation") == "verified").alias("_any")
    )
    rows = attach_lookup(heads, best, ["canonical_id"])
    open_head = (
        F.col("checked")
        & ~F.col("trusted")
        & (F.col("validation_reason") != "trusted_source_disagreement")
    )
    verified = F.coalesce("_any", F.lit(False))
    return rows.withColumns(
        {
            "validation_status": F.when(
                open_head, F.when(verified, "verified").otherwise("pending")
            ).otherwise(F.col("validation_status")),
            "validation_reason": F.when(
                open_head,
                F.when(verified, "wca_records_api_record_match").otherwise(
                    "wca_records_api_no_record_match"
                ),
            ).otherwise(F.col("validation_reason")),
        }
    ).drop("_any")


def evidence_flags(heads: DataFrame, observations: DataFrame) -> DataFrame:
    """Flags ``checked`` (second source reports the value) and ``trusted`` (a trusted one does)."""
    active = observations.where(F.col("status") == "active")
    per_value = active.groupBy("canonical_id", "value").agg(
        F.bool_or(F.col("source") == fixed.SECOND_SOURCE).alias("_second"),
        F.bool_or(is_trusted("method")).alias("_trusted"),
    )
    rows = attach_lookup(heads, per_value, ["canonical_id", "value"])
    return rows.withColumns(
        {
            "checked": F.coalesce("_second", F.lit(False)) & is_complete("value"),
            "trusted": F.coalesce("_trusted", F.lit(False)),
        }
    ).drop("_second", "_trusted")


def weakest_per_country(benchmarks: DataFrame, countries: DataFrame) -> DataFrame:
    """Weakest applicable benchmark per (event, kind, country code); meeting it meets one."""
    places = countries.select("country_code", F.inline(regions()))
    return (
        places.join(benchmarks, ["level", "region"])
        .groupBy("event_id", "kind", "country_code")
        .agg(F.max("value").alias("value"))
    )


def distinct_snapshots(snapshots: DataFrame) -> DataFrame:
    """Snapshots by content hash with first and last fetch time."""
    return snapshots.groupBy("payload_hash").agg(
        F.min("fetched_at").alias("first_fetched_at"),
        F.max("fetched_at").alias("last_fetched_at"),
        F.min("snapshot_id").alias("snapshot_id"),
    )


def latest_snapshot(records: DataFrame) -> DataFrame:
    """Rows of the last fetched snapshot (``fetched_at, snapshot_id`` per row)."""
    last = records.agg(F.max(F.struct("fetched_at", "snapshot_id")).alias("_last")).select("_last.*")
    return records.join(F.broadcast(last), ["fetched_at", "snapshot_id"])


def changed_scopes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(event, kind) of benchmarks added, removed or changed."""
    joined = before.select(*KEY, F.col("value").alias("_old")).join(
        after.select(*KEY, F.col("value").alias("_new")), KEY, "full_outer"
    )
    return joined.where(~F.col("_old").eqNullSafe(F.col("_new"))).select("event_id", "kind").distinct()


def relevant_results(heads: DataFrame, observations: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Heads with active second-source evidence or an existing verdict."""
    evidence = (
        observations.where((F.col("status") == "active") & (F.col("source") == fixed.SECOND_SOURCE))
        .select("canonical_id")
        .unionByName(verdicts.select("canonical_id"))
        .distinct()
    )
    return heads.join(evidence, "canonical_id", "left_semi")


def refresh(
    before: DataFrame, after: DataFrame, heads: DataFrame, observations: DataFrame, verdicts: DataFrame
) -> DataFrame:
    """Heads to check again after a new snapshot: relevant ones in changed or current scopes."""
    scopes = changed_scopes(before, after).unionByName(after.select("event_id", "kind")).distinct()
    relevant = relevant_results(heads, observations, verdicts)
    return relevant.join(scopes, ["event_id", "kind"], "left_semi")


