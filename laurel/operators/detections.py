"""Record detections claimed by sources: active or withdrawn, first detection kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laurel.functions import fixed
from laurel.functions.keys import comparison_key
from laurel.functions.values import format_result, is_complete
from laurel.operators.grouping import attach_lookup
from laurel.operators.scan import number_buckets, previous_row

RESULT = ["stable_identity", "kind", "method"]


def claims_of_rounds(results: DataFrame) -> DataFrame:
    """One claim per kind of a round result row, with blank level when it claims nothing.

    A claim needs a known record tag and a complete value.
    """

    def claim(kind: str, value: str, tag: str):
        claimed = F.col(tag).isin(*fixed.CLAIM_LEVELS) & is_complete(value)
        return F.struct(
            F.lit(kind).alias("kind"),
            F.col(value).cast("long").alias("value"),
            F.when(F.coalesce(claimed, F.lit(False)), F.col(tag)).otherwise("").alias("level"),
        )

    rest = [c for c in results.columns if c not in ("kind", "value", "level")]
    return results.select(
        *rest,
        F.inline(
            F.array(
                claim("single", "best", "single_tag"), claim("average", "average", "average_tag")
            )
        ),
    )


def changed_claims(claims: DataFrame) -> DataFrame:
    """Only claims that differ from the result's previous claim and involve a record tag."""
    rows = previous_row(claims, RESULT, ["seq"], number_buckets("seq"), ["value", "level"])
    before_value, before_level = F.col("previous.value"), F.coalesce("previous.level", F.lit(""))
    same = before_value.eqNullSafe(F.col("value")) & (before_level == F.col("level"))
    return rows.where(~same & ((F.col("level") != "") | (before_level != ""))).drop("previous")


def detections(claims: DataFrame) -> DataFrame:
    """State of every (result, kind, method, level) ever claimed.

    ``detected_at`` is the first claim and survives corrections. A level is active while it is the
    latest claim of its result; it was withdrawn by the claim following its own last one.
    """
    rows = previous_row(
        claims, RESULT, ["seq"], number_buckets("seq"), ["level", "observed_at"], "_next", following=True
    )
    last = F.max_by(
        F.struct("value", "observed_at", F.col("_next.observed_at").alias("withdrawn_at")), "seq"
    )
    states = (
        rows.where(F.col("level") != "")
        .groupBy(*RESULT, "level")
        .agg(F.min("observed_at").alias("detected_at"), last.alias("_last"))
    )
    withdrawn = F.col("_last.withdrawn_at")
    return states.select(
        *RESULT,
        "level",
        F.col("_last.value").alias("value"),
        "detected_at",
        F.coalesce(withdrawn, "_last.observed_at").alias("last_observed_at"),
        withdrawn.alias("withdrawn_at"),
        F.when(withdrawn.isNull(), "active").otherwise("withdrawn").alias("status"),
    )


def described(detected: DataFrame, candidates: DataFrame) -> DataFrame:
    """Detections with the context, key and display text of their result."""
    rows = detected.join(candidates, ["stable_identity"], "left")
    return rows.withColumns(
        {
            "comparison_key": comparison_key(
                "competition_id",
                "person_id",
                "event_id",
                "round_number",
                "kind",
                "level",
                "source",
                "source_result_id",
                "stable_identity",
            ),
            "formatted": format_result("event_id", "kind", "value"),
        }
    )


def round_candidates(results: DataFrame, rounds: DataFrame) -> DataFrame:
    """Round result rows with their round descriptor (format, cutoff, zone, competition)."""
    return results.join(rounds, ["round_id"])


def with_round_zone(records: DataFrame, rounds: DataFrame) -> DataFrame:
    """Fill a missing competition zone from the stored round of the same competition."""
    zones = rounds.where(F.col("competition_timezone") != "").groupBy(
        "round_id", "competition_id"
    ).agg(F.min("competition_timezone").alias("_zone"))
    rows = attach_lookup(records, zones, ["round_id", "competition_id"])
    return rows.withColumn(
        "competition_timezone",
        F.coalesce(F.nullif("competition_timezone", F.lit("")), "_zone", F.lit("")),
    ).drop("_zone")


def claimed_facts(claims: DataFrame) -> DataFrame:
    """Changes of the result log that record claims stand for, with ``op`` observe or retract.

    A final claim is an observation of its result. A claim that is not final (any more) takes back what
    was observed before; where nothing was, it changes nothing.
    """
    rows = claims.withColumn("op", F.when(F.col("final"), "observe").otherwise("retract"))
    rows = previous_row(rows, RESULT, ["seq"], number_buckets("seq"), ["op"])
    known = F.coalesce(F.col("previous.op") == "observe", F.lit(False))
    return rows.where((F.col("op") == "observe") | known).drop("previous")


def poll_statistics(polled: DataFrame) -> DataFrame:
    """Per poll: records found, new, duplicate and malformed.

    ``polled`` has ``poll_id, seq, error`` and the detection key; a record is new the first time
    its key appears in any poll.
    """
    key = ["stable_identity", "kind", "level"]
    good = polled.where(F.col("error").isNull())
    firsts = good.groupBy(*key).agg(F.min_by("poll_id", "seq").alias("poll_id"))
    new = firsts.groupBy("poll_id").agg(F.count(F.lit(1)).alias("_new"))
    totals = polled.groupBy("poll_id").agg(
        F.count(F.lit(1)).alias("records_found"),
        F.count_if(F.col("error").isNotNull()).alias("malformed"),
    )
    new_count = F.coalesce("_new", F.lit(0))
    return totals.join(new, "poll_id", "left").select(
        "poll_id",
        "records_found",
        new_count.alias("new_observations"),
        (F.col("records_found") - F.col("malformed") - new_count).alias("duplicates_ignored"),
        "malformed",
    )


def relink(detected: DataFrame, observations: DataFrame) -> DataFrame:
    """Attach the canonical result found through (identity, method, kind)."""
    links = observations.groupBy(
        F.col("source_identity").alias("stable_identity"), "method", "kind"
    ).agg(F.max_by("canonical_id", "seq").alias("canonical_id"))
    return attach_lookup(detected.drop("canonical_id"), links, RESULT)


def raw_links(observations: DataFrame) -> DataFrame:
    """Last raw frame per (source, method, identity)."""
    return (
        observations.where(F.col("raw_id").isNotNull())
        .groupBy("source", "method", "source_identity")
        .agg(F.max_by("raw_id", "seq").alias("raw_id"))
    )
