"""From changes of round snapshots to result revisions, and on to live timelines.

``revisions`` takes one trusted source at its word; ``observations`` makes the changes of several sources
evidence, which ``streaming.evidence`` weighs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laurel.functions.finalize import all_attempts_entered, is_final
from laurel.operators.grouping import attach_lookup, global_rank
from laurel.session import stage, staging
from laurel.sources.payloads import FRAME_ROW
from laurel.streaming.evidence import EvidenceStore
from laurel.streaming.live import LiveCells, LiveTimelines


def _observed(row: Column, kind: str) -> Column:
    """The value that a final row states for a kind; null where it states none."""
    final = is_final(row["attempts"], F.col("expected_attempts"), F.col("cutoff_attempts"), F.col("cutoff_value"))
    value = row["best"] if kind == "single" else row["average"]
    stated = final if kind == "single" else final & all_attempts_entered(row["attempts"], F.col("expected_attempts"))
    return F.when(row.isNotNull() & stated & (F.coalesce(value, F.lit(0)) != 0), value)


def _stated(changes: DataFrame, rounds: DataFrame) -> DataFrame:
    """A row for each kind that a change's row states a value for, or did before it (``_k``: kind, new, old)."""
    known = attach_lookup(changes.where("change <> 'rejected'"), rounds.withColumn("_known", F.lit(True)), ["round_id"]).where("_known")
    rows = known.withColumns({"_new": F.from_json("row", FRAME_ROW), "_old": F.from_json("before", FRAME_ROW)})

    def kind(name: str) -> Column:
        return F.struct(F.lit(name).alias("kind"), _observed(F.col("_new"), name).alias("new"), _observed(F.col("_old"), name).alias("old"))

    each = rows.withColumn("_k", F.explode(F.array(kind("single"), kind("average"))))
    return each.where("_k.new IS NOT NULL OR _k.old IS NOT NULL")


def revisions(changes: DataFrame, rounds: DataFrame, places: DataFrame) -> DataFrame:
    """Result revisions that snapshot ``changes`` stand for.

    ``rounds`` (one row for each round_id: event, number, competition, format, cutoff) describes what the
    rows are results of; changes of unknown rounds wait nowhere, so refresh rounds first. A row that is
    final states a value for each kind; a change that takes a stated value away, a removal too, retracts
    it. The revision number is the frame's sequence number.
    """
    each = _stated(changes, rounds)
    gone, first = F.col("_k.new").isNull(), F.col("_k.old").isNull()
    row = F.coalesce("_new", "_old")
    flat = each.select(
        F.xxhash64("round_id", "result_id", "_k.kind").alias("canonical_id"),
        F.col("seq").cast("long").alias("revision"),
        F.when(gone, "retracted").when(first, "created").otherwise("corrected").alias("action"),
        F.when(gone, "retracted").otherwise("active").alias("status"),
        F.lit("verified").alias("validation_status"),
        F.coalesce(row["entered_at"], "observed_at").alias("entered_at"),
        F.col("observed_at").alias("first_observed_at"),
        "event_id",
        F.col("_k.kind").alias("kind"),
        F.coalesce("_k.new", "_k.old").alias("value"),
        row["person_id"].alias("person_id"),
        row["country"].alias("country"),
        "competition_id",
        "competition_name",
        "round_id",
        "round_number",
    ).withColumn("local_date", F.to_date("entered_at"))
    continents = places.select("country", "continent")
    return attach_lookup(flat, continents, ["country"]).withColumn("continent", F.coalesce("continent", F.lit("")))


def timeline_sink(state: LiveTimelines | LiveCells, rounds: DataFrame, places: DataFrame) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that brings snapshot changes to live timelines or cells."""

    def write(changes: DataFrame, number: int) -> None:
        # The diff's output is read once: what a batch changes is staged before it is looked into.
        with staging(state.spark):
            state.write(stage(revisions(changes, rounds, places).select(*state.head_schema.names)), number)

    return write


# What a batch's numbers begin with; a batch has fewer observations.
_BATCH = 2**40


def observations(changes: DataFrame, rounds: DataFrame, number: int) -> DataFrame:
    """The log rows of ``operators.evidence`` that the ``changes`` of micro-batch ``number`` stand for.

    ``changes`` has the columns of a snapshot change and its ``source`` and ``method``. A stated value is
    observed, one that a change takes away retracted. Rows are numbered in order of observation time, after
    those of all earlier batches.
    """
    each = _stated(changes, rounds)
    row, gone = F.coalesce("_new", "_old"), F.col("_k.new").isNull()
    blank, no_date = F.lit(""), F.lit(None).cast("date")
    log = each.select(
        F.col("seq").alias("_frame"),
        F.when(gone, "retract").otherwise("observe").alias("op"),
        "source",
        "method",
        F.concat_ws("/", "round_id", "result_id").alias("source_identity"),
        F.col("_k.kind").alias("kind"),
        F.coalesce("_k.new", "_k.old").alias("value"),
        row["entered_at"].alias("entered_at"),
        "observed_at",
        F.col("competition_id").alias("source_competition_id"),
        F.coalesce(row["person_id"], blank).alias("source_competitor_id"),
        "competition_id",
        "competition_name",
        blank.alias("competition_country"),
        no_date.alias("competition_start"),
        no_date.alias("competition_end"),
        blank.alias("competition_timezone"),
        no_date.alias("local_date"),
        "round_id",
        "round_number",
        blank.alias("round_name"),
        "event_id",
        blank.alias("event_name"),
        F.coalesce(row["person_name"], blank).alias("person_name"),
        F.coalesce(row["person_id"], blank).alias("person_id"),
        F.coalesce(row["country"], blank).alias("country_code"),
        blank.alias("source_url"),
    )
    ranked = global_rank(log, ["observed_at", "_frame", "source", "method", "source_identity", "kind"], "seq")
    return ranked.withColumn("seq", F.col("seq") + F.lit(number * _BATCH)).select("seq", *[c for c in log.columns if c != "_frame"])


def evidence_sink(store: EvidenceStore, rounds: DataFrame) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that brings the snapshot changes of all sources to the evidence store."""

    def write(changes: DataFrame, number: int) -> None:
        with staging(store.spark):
            store.write(observations(changes, rounds, number), number)

    return write


def weighed_revisions(changed: DataFrame, places: DataFrame) -> DataFrame:
    """What an evidence store announces, as revisions for live timelines.

    Rows of ``evidence_sink`` are numbered in order of arrival, so no revision is ever gone.
    """
    dated = changed.where("NOT gone").withColumns({"entered_at": F.coalesce("entered_at", "first_observed_at"), "country": F.col("country_code")})
    dated = dated.withColumns({"revision": F.col("revision").cast("long"), "local_date": F.coalesce("local_date", F.to_date("entered_at"))})
    placed = attach_lookup(dated, places.select("country", "continent"), ["country"])
    return placed.withColumn("continent", F.coalesce("continent", F.lit("")))


def to_timelines(state: LiveTimelines, places: DataFrame) -> Callable[[DataFrame, int], None]:
    """The ``then`` of an evidence store that brings its revisions to live timelines."""

    def write(changed: DataFrame, number: int) -> None:
        state.write(weighed_revisions(changed, places).select(*state.head_schema.names), number)

    return write
