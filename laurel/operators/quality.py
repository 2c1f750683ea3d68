"""Data-quality gates: publication checks, quarantine and state comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laurel.functions import fixed
from laurel.functions.status import supported_event


def _blank(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) == ""


def invalid_fact() -> Column:
    """A historical fact that must not be published."""
    kind, attempt = F.col("kind"), F.col("attempt_number")
    bad_shape = (
        ~F.coalesce(kind.isin("single", "average"), F.lit(False))
        | ((kind == "single") & ~F.coalesce(attempt.between(1, 5), F.lit(False)))
        | ((kind == "average") & attempt.isNotNull())
    )
    blanks = [
        _blank(c)
        for c in (
            "result_id",
            "person_id",
            "event_id",
            "country_id",
            "competition_id",
            "round_type_id",
            "achieved_date",
        )
    ]
    bad = (F.coalesce(F.col("value"), F.lit(0)) <= 0) | bad_shape
    for blank in blanks:
        bad = bad | blank
    return bad


def historical_gate(facts: DataFrame) -> DataFrame:
    """One row with counts per kind, invalid rows and duplicated logical rows.

    Counts and the duplicate probe share one pass: rows are first combined per logical key.
    """
    per_key = facts.groupBy("result_id", "kind", "attempt_number").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(invalid_fact()).alias("_bad")
    )
    total = F.coalesce(F.sum("_n"), F.lit(0))

    def of_kind(kind: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("_n"))), F.lit(0))

    return per_key.agg(
        of_kind("single").alias("singles"),
        of_kind("average").alias("averages"),
        total.alias("total"),
        F.coalesce(F.sum("_bad"), F.lit(0)).alias("invalid"),
        F.count_if(F.col("_n") > 1).alias("duplicates"),
    )


def require_publishable(facts: DataFrame) -> dict[str, int]:
    """Counts of a table that may be published; raises otherwise."""
    counts = historical_gate(facts).first().asDict()
    if counts["total"] <= 0:
        raise ValueError("Historical results replacement is empty")
    if counts["invalid"]:
        raise ValueError(f"Historical results contain {counts['invalid']} invalid rows")
    if counts["duplicates"]:
        raise ValueError("Historical results contain duplicate logical rows")
    return counts


def quarantine(rows: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """Good rows and malformed rows; one bad record never stops the others."""
    return rows.where(F.col(error).isNull()).drop(error), rows.where(F.col(error).isNotNull())


def split_unsupported(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of supported events, and the rest for quarantine."""
    known = supported_event("event_id", "kind")
    return rows.where(known), rows.where(~known)


def unknown_tags(rows: DataFrame, tag: str = "record_tag") -> DataFrame:
    """Tags kept in state that never become detections, with their counts."""
    return (
        rows.where((F.col(tag) != "") & ~F.col(tag).isin(*fixed.CLAIM_LEVELS))
        .groupBy(tag)
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def trusted_disagreements(observations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys whose trusted, active observations disagree on the value."""
    from laurel.functions.status import is_trusted

    trusted = observations.where(is_trusted("method"))
    low, high = F.min("value").alias("low"), F.max("value").alias("high")
    return trusted.groupBy(*keys).agg(low, high).where(F.col("low") != F.col("high"))


def state_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows present on one side only, with multiplicity; empty when both states agree."""
    columns = left.columns
    sides = left.withColumn("_n", F.lit(1)).unionByName(right.select(*columns).withColumn("_n", F.lit(-1)))
    surplus = sides.groupBy(*columns).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    side = F.when(F.col("_n") > 0, "left").otherwise("right").alias("side")
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.abs("_n"))).alias("_copy")
    return surplus.select(*columns, side, copies).drop("_copy")
