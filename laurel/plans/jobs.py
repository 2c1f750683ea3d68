"""Batch jobs: refresh from the bulk export, and rebuild from provider state."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laurel.functions import fixed
from laurel.operators import alerts, baseline, detections, evidence, grouping, history, quality, timeline
from laurel.session import stage
from laurel.sources import export, payloads, publish


def refresh_from_export(
    spark: SparkSession, folder: str, root: str, heads: DataFrame, as_of: datetime, source: str = ""
) -> str:
    """Check and read an unpacked export, then publish baseline, facts, live cells and metadata at once.

    ``heads`` are the head revisions of live results, with the columns of ``timeline.classify``; those that
    are retracted, rejected, incomplete or absorbed by the export take no part in live cells. All tables
    are written and checked before the release counts.
    """
    manifest = export.inspect(spark, folder, as_of)
    tables = export.read_export(spark, manifest)
    cells = stage(baseline.export_baseline(tables))
    absorbed = stage(baseline.absorbed_competitions(tables["results"]))
    live = timeline.live_cells(timeline.live_members(heads, absorbed), cells)
    facts = history.historical_facts(tables["result_attempts"], tables["results"], tables["competitions"])
    report = export.load_report(tables, manifest, source).withColumn("absorbed_competitions", F.lit(absorbed.count()))
    return publish.publish(
        spark,
        root,
        {
            "baseline_cells": publish.Table(cells, _has_rows),
            "live_cells": publish.Table(live),
            "absorbed_competitions": publish.Table(absorbed),
            "historical_facts": publish.Table(facts, quality.require_publishable, ("event_id", "kind")),
        },
        report,
    )


def _has_rows(df: DataFrame) -> None:
    if df.isEmpty():
        raise ValueError("The baseline has no cells")


def ingest_polls(polled: DataFrame, rounds: DataFrame) -> dict[str, DataFrame]:
    """Poll batches of record claims: ``polled`` has poll_id, seq, observed_at and payload.

    Malformed payloads are set aside. A payload that came before, in whatever poll, changes nothing. The
    rest, with zones filled from known ``rounds``, gives detections (a claim of another level withdraws the
    former), changes of the result log (claims that are not final take back what was observed), and
    statistics for each poll.
    """
    parsed = payloads.recent_records(polled.withColumn("payload_hash", F.sha2("payload", 256)))
    parsed = stage(parsed.withColumn("method", F.lit(fixed.POLLED)))
    good, aside = quality.quarantine(parsed)
    claims = grouping.first_per_key(good, ["method", "payload_hash"], ["seq"])
    claims = stage(detections.with_round_zone(claims, rounds))
    return {
        "quarantine": aside,
        "detections": detections.detections(claims),
        "log": detections.claimed_facts(claims),
        "statistics": detections.poll_statistics(parsed),
    }


def rebuild(
    log: DataFrame, countries: DataFrame, cells: DataFrame, absorbed: DataFrame, benchmarks: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Revisions and level rows from the whole observation log, in replay order."""
    revisions = stage(evidence.revision_log(log, benchmarks))
    known, _ = quality.split_unsupported(revisions)
    placed = known.join(countries.select("country_code", "country", "continent"), "country_code", "left")
    return revisions, timeline.classify(placed, cells, absorbed)


def backfill(
    states: DataFrame, log_columns: list[str], deliveries: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Finalized observations of the active provider state, and deliveries with open ones cancelled.

    State rows without round metadata stop the job before anything is derived.
    """
    active = states.where("active")
    if active.where("expected_attempts IS NULL").limit(1).count():
        raise ValueError("Active state rows have no round format metadata; refresh round targets first")
    planned = evidence.round_observations(active)
    cancelled = alerts.cancel_open(
        deliveries, "canonical_backfill", "Superseded by finalized-result backfill"
    )
    return planned.select(*[c for c in log_columns if c in planned.columns]), cancelled
