"""The record feed: verified rows, highest level, search, pages, top lists and API documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laurel.functions import fixed
from laurel.functions.keys import blank_to_null
from laurel.functions.text import event_search_terms, events_matching, split_native_name
from laurel.operators.grouping import attach_group, attach_lookup, top_per_group

_RANK = {level: i for i, level in enumerate(fixed.LEVELS)}
SEARCH_COLUMNS = (
    "person_name",
    "event_id",
    "event_name",
    "country_code",
    "competition_id",
    "competition_name",
    "kind",
)
COUNTRY_COLUMNS = ("country_display_name", "country", "continent")


def level_rank(level="level") -> Column:
    return F.when(F.col(level) == "WR", 0).when(F.col(level) == "CR", 1).when(
        F.col(level) == "NR", 2
    ).otherwise(3)


def trusted_result() -> Column:
    return (F.col("validation_status") == "verified") & (
        F.col("validation_reason") == "trusted_source_observation"
    )


def mark_verified(levels: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Flag ``independently_verified``: a verified verdict for this result, level and value."""
    verified = (
        verdicts.where(F.col("validation") == "verified")
        .select("canonical_id", "level", "value", F.lit(True).alias("independently_verified"))
        .distinct()
    )
    rows = attach_lookup(levels, verified, ["canonical_id", "level", "value"])
    return rows.withColumn(
        "independently_verified", F.coalesce("independently_verified", F.lit(False))
    )


def mark_highest(levels: DataFrame) -> DataFrame:
    """Flag ``has_higher``: the same revision has a recognized record at a higher level."""
    counts = (F.col("outcome") != "none") & (F.col("recognition") == "recognized")
    best = F.min(F.when(counts, level_rank())).alias("_best")
    rows = attach_group(levels, ["canonical_id", "revision"], [best])
    return rows.withColumn(
        "has_higher", F.coalesce(F.col("_best") < level_rank(), F.lit(False))
    ).drop("_best")


def search(rows: DataFrame, text: str) -> DataFrame:
    """Comma-separated terms, all of which must match some column, country or event group."""
    for term in (t.strip() for t in (text or "").split(",")):
        if not term:
            continue
        wanted = F.lit(term.lower())
        columns = [c for c in (*SEARCH_COLUMNS, *COUNTRY_COLUMNS) if c in rows.columns]
        match = F.lit(False)
        for column in columns:
            match = match | F.coalesce(F.lower(F.col(column)).contains(wanted), F.lit(False))
        events = events_matching(term)
        if events:
            match = match | F.col("event_id").isin(*events)
        rows = rows.where(match)
    return rows


def record_feed(
    levels: DataFrame,
    verdicts: DataFrame,
    level: str | None = None,
    text: str = "",
    include_history: bool = False,
) -> DataFrame:
    """Rows of the public feed, not yet ordered."""
    rows = levels.where(F.col("outcome") != "none")
    if level and not include_history:
        rows = mark_highest(rows)
    rows = mark_verified(rows, verdicts)
    if not include_history:
        rows = rows.where(
            F.col("is_valid")
            & (F.col("recognition") == "recognized")
            & (trusted_result() | F.col("independently_verified"))
        )
    if level:
        rows = rows.where(F.col("level") == level.upper())
        if not include_history:
            rows = rows.where(~F.col("has_higher")).drop("has_higher")
    return search(rows, text)


def newest_first() -> list[Column]:
    return [F.col("at").desc(), F.col("canonical_id").desc(), level_rank().desc()]


def page(rows: DataFrame, number: int, order: list[Column], size: int = fixed.PAGE_SIZE) -> DataFrame:
    """Page ``number`` (from 1) of the ordered rows."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def page_after(rows: DataFrame, last: dict | None, size: int = fixed.PAGE_SIZE) -> DataFrame:
    """The newest rows after ``last`` (at, canonical_id and level of the last row shown; None: the first page).

    Every task keeps one page's rows, however deep the page; ``page`` keeps all pages before it too.
    """
    if last is not None:
        shown = fixed.LEVELS.index(last["level"])
        rank, at = level_rank(), F.lit(last["at"])
        same = F.col("at") == at
        same_result = same & (F.col("canonical_id") == last["canonical_id"])
        rows = rows.where((F.col("at") < at) | (same & (F.col("canonical_id") < last["canonical_id"])) | (same_result & (rank < shown)))
    return rows.orderBy(*newest_first()).limit(size)


def page_with_total(rows: DataFrame, number: int, order: list[Column], size: int = fixed.PAGE_SIZE) -> DataFrame:
    """``page`` with the count of all rows, ``total_count``, on every row."""
    total = rows.agg(F.count(F.lit(1)).alias("total_count"))  # one row
    return page(rows, number, order, size).crossJoin(F.broadcast(total))


def newest_detections_first() -> list[Column]:
    return [F.col("detected_at").desc(), F.col("detection_id").desc()]


def level_top_lists(rows: DataFrame) -> DataFrame:
    """Newest rows of each level, as many as the overview shows."""
    return top_per_group(rows, "level", fixed.LEVEL_ROW_LIMITS, newest_first())


def filter_detections(
    rows: DataFrame,
    source: str | None = None,
    level: str | None = None,
    status: str | None = "active",
    text: str | None = None,
) -> DataFrame:
    """Detections by method, level, status (active by default) and simple text."""
    if source:
        rows = rows.where(F.col("method") == source)
    if level:
        rows = rows.where(F.col("level") == level.upper())
    if status:
        rows = rows.where(F.col("status") == status)
    if text:
        wanted, match = F.lit(text.lower()), F.lit(False)
        for column in ("person_name", "person_id", "event_name", "competition_name"):
            match = match | F.coalesce(F.lower(F.col(column)).contains(wanted), F.lit(False))
        rows = rows.where(match)
    return rows


def alert_eligible() -> Column:
    return (
        F.col("is_valid")
        & (trusted_result() | F.col("independently_verified"))
        & F.col("level").isin(*fixed.CLAIM_LEVELS)
        & (F.col("recognition") == "recognized")
        & (F.col("outcome") != "none")
    )


def explain_alerts(rows: DataFrame) -> DataFrame:
    eligible = alert_eligible()
    return rows.withColumns(
        {
            "alert_eligible": eligible,
            "alert_reason": F.when(eligible, "eligible").otherwise(F.col("recognition")),
        }
    )


def claims_per_result(observations: DataFrame) -> DataFrame:
    """Methods and sorted claims per canonical result, one entry per observation."""
    claim = F.struct(
        F.col("method").alias("pipeline"),
        "observation_id",
        blank_to_null("source_tag").alias("record_tag"),
        "trusted",
        "entered_at",
        "first_observed_at",
        "last_observed_at",
    )
    return observations.groupBy("canonical_id").agg(
        F.array_sort(F.collect_set("method")).alias("methods"),
        F.array_sort(F.collect_list(claim)).alias("claims"),
    )


def documents(rows: DataFrame, claims: DataFrame) -> DataFrame:
    """One nested document per level row; blank text becomes null."""
    rows = attach_lookup(explain_alerts(rows), claims, ["canonical_id"])
    names = split_native_name("person_name")

    def text(name: str, alias: str | None = None) -> Column:
        return blank_to_null(name).alias(alias or name)

    document = F.struct(
        F.struct(
            F.col("canonical_id").alias("id"),
            F.col("identity_key").alias("key"),
            F.struct(F.col("revision").alias("number")).alias("revision"),
        ).alias("canonical_result"),
        F.struct(
            "level",
            text("scope"),
            "outcome",
            "recognition",
            F.col("incumbent").alias("incumbent_value"),
            F.struct(
                F.col("currently_holds").alias("current"),
                "shared_tie",
                text("ceased_reason"),
                "ceased_by",
                "superseded_by",
            ).alias("holding"),
        ).alias("achievement"),
        F.struct(
            F.col("person_name").alias("name"),
            names["romanized_name"].alias("romanized_name"),
            names["native_name"].alias("native_name"),
            text("person_id", "wca_id"),
            text("country_code"),
            text("country_display_name"),
            text("country", "country_wca_name"),
            text("continent"),
        ).alias("competitor"),
        F.struct(
            text("competition_id", "wca_id"),
            F.col("competition_name").alias("name"),
            text("competition_timezone", "timezone"),
            "local_date",
            F.struct(F.col("zone_status").alias("status"), text("zone_reason", "reason")).alias(
                "timezone_resolution"
            ),
        ).alias("competition"),
        F.struct(
            F.col("event_id").alias("id"),
            F.col("event_name").alias("name"),
            event_search_terms("event_id").alias("other_search_terms"),
        ).alias("event"),
        F.struct(
            text("round_id", "id"), F.col("round_number").alias("number"), text("round_name", "name")
        ).alias("round"),
        F.struct(
            "kind",
            F.col("value").alias("raw"),
            F.col("formatted"),
            F.col("is_valid").alias("valid"),
            text("invalidity_reason"),
        ).alias("result"),
        F.struct("entered_at", "first_observed_at", "last_observed_at").alias("timestamps"),
        F.struct(
            F.col("validation_status").alias("status"), text("validation_reason", "reason")
        ).alias("validation"),
        F.struct(
            text("source_url", "url"),
            F.coalesce("methods", F.array().cast("array<string>")).alias("pipelines"),
            "claims",
        ).alias("sources"),
        F.struct(
            F.col("alert_eligible").alias("eligible"), F.col("alert_reason").alias("reason")
        ).alias("notification"),
    )
    return rows.select(
        "canonical_id",
        "revision",
        "level",
        F.to_json(document, {"ignoreNullFields": "false"}).alias("document"),
    )
