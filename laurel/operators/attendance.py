"""Who competes in a window: merged sources, accepted rows and the ranked list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laurel.functions import fixed
from laurel.functions.keys import blank_to_null, competition_source_key, valid_person_id
from laurel.functions.text import folded_name
from laurel.functions.times import overlaps
from laurel.operators.grouping import attach_lookup, global_rank, latest_per_key

OFFICIAL = "wca"


def match_official(listed: DataFrame, official: DataFrame) -> DataFrame:
    """Fill a missing official id when exactly one official competition has the same folded name
    and both dates."""
    key = ["_name", "start_date", "end_date"]
    candidates = (
        official.withColumn("_name", folded_name("name"))
        .groupBy(*key)
        .agg(F.count(F.lit(1)).alias("_matches"), F.min("official_id").alias("_official"))
    )
    rows = attach_lookup(listed.withColumn("_name", folded_name("name")), candidates, key)
    found = F.when(F.col("_matches") == 1, F.col("_official"))
    return rows.withColumn(
        "official_id", F.coalesce(blank_to_null("official_id"), found)
    ).select(*listed.columns)


def _preferred_order(position: str) -> Column:
    """The official source wins; among equals the later official or the earlier other row."""
    official = F.col("source") == OFFICIAL
    return F.struct(
        official.cast("int").alias("official"),
        F.when(official, F.col(position)).otherwise(-F.col(position)).alias("position"),
    )


def merge_competitions(listed: DataFrame) -> DataFrame:
    """One row per source key with the preferred source's attributes and all source names."""
    keyed = listed.withColumn(
        "source_key", competition_source_key("official_id", "source", "source_id")
    )
    rest = [c for c in keyed.columns if c not in ("source_key", "source", "position")]
    return keyed.groupBy("source_key").agg(
        F.array_sort(F.collect_set("source")).alias("sources"),
        F.max_by(F.struct(*rest), _preferred_order("position")).alias("_best"),
    ).select("source_key", "sources", "_best.*")


def merge_registrations(registered: DataFrame, keys: tuple[str, ...] = ("source_key", "person_id")) -> DataFrame:
    """One row per key: union of sources, attributes of the preferred one.

    Rows without a valid person id (first-timers) are left out.
    """
    rows = registered.where(valid_person_id("person_id")).withColumns(
        {
            "person_id": F.upper(F.trim("person_id")),
            "name": F.trim("name"),
            "country_code": F.upper(F.trim("country_code")),
        }
    )
    best = F.max_by(F.struct("name", "country_code", "continent"), _preferred_order("position"))
    return rows.groupBy(*keys).agg(
        F.array_sort(F.collect_set("source")).alias("sources"), best.alias("_best")
    ).select(*keys, "sources", "_best.*")


def sync_attendance(existing: DataFrame, merged: DataFrame, refreshed: DataFrame, observed_at: Column) -> DataFrame:
    """Attendance after a sync of the ``refreshed`` competitions.

    Seen rows are accepted; rows of refreshed competitions no longer seen stay but are not
    accepted; rows of other competitions do not change.
    """
    key = ["person_id", "source_key"]
    none = F.array().cast("array<string>")
    seen = merged.select(
        *key, F.lit(True).alias("is_accepted"), "sources", observed_at.alias("observed_at")
    )
    old = existing.join(seen.select(*key), key, "left_anti")
    marks = refreshed.select("source_key", F.lit(True).alias("_refreshed")).distinct()
    gone = F.coalesce("_refreshed", F.lit(False))
    kept = attach_lookup(old, marks, ["source_key"]).select(
        *key,
        (F.col("is_accepted") & ~gone).alias("is_accepted"),
        F.when(gone, none).otherwise(F.col("sources")).alias("sources"),
        "observed_at",
    )
    return kept.unionByName(seen)


def update_competitors(existing: DataFrame, profiles: DataFrame) -> DataFrame:
    """Profiles replace stored attributes unless blank."""
    fields = ("name", "country_code", "continent")
    new = profiles.select("person_id", *[F.col(f).alias(f"_{f}") for f in fields])
    joined = existing.join(new, "person_id", "full_outer")
    return joined.select(
        "person_id",
        *[F.coalesce(blank_to_null(f"_{f}"), F.col(f), F.lit("")).alias(f) for f in fields],
    )


def in_window(attendance: DataFrame, competitions: DataFrame, start: Column, end: Column) -> DataFrame:
    """Accepted rows of competitions that touch the closed window."""
    inside = competitions.where(overlaps("start_date", "end_date", start, end))
    return attendance.where("is_accepted").join(inside, "source_key")


def competing_list(rows: DataFrame, continent: str = "") -> DataFrame:
    """One ranked row per competitor with competitions sorted by start and folded name.

    ``rows`` come from ``in_window`` with the competitor's name, country and continent.
    """
    if continent and continent not in fixed.CONTINENTS:
        raise ValueError(f"Unknown continent {continent!r}; use one of {', '.join(fixed.CONTINENTS)}")
    if continent:
        rows = rows.where(F.col("continent") == continent)
    entry = F.struct(
        "start_date",
        folded_name("competition_name").alias("folded"),
        F.col("source_key").alias("id"),
        F.col("competition_name").alias("name"),
        "end_date",
    )
    # Attendance is unique per competition, but a competitor may be listed by several sources.
    once = rows.dropDuplicates(["person_id", "source_key"])
    people = once.groupBy("person_id").agg(
        F.min(F.struct("name", "country_code", "continent")).alias("_p"),
        F.array_sort(F.collect_list(entry)).alias("competitions"),
    )
    named = people.select(
        "person_id", "_p.*", "competitions", folded_name("_p.name").alias("folded_name")
    )
    return global_rank(named, ["folded_name", "person_id"])


def sync_statistics(competitions: DataFrame, registrations: DataFrame) -> DataFrame:
    """Competitions per source, distinct competitors and attendance rows, as one row."""
    listed = competitions.agg(
        F.count_if(F.array_contains("sources", OFFICIAL)).alias("official_competitions"),
        F.count_if(F.array_contains("sources", fixed.SECOND_SOURCE)).alias("other_competitions"),
        F.count(F.lit(1)).alias("competitions"),
        F.lit(0).alias("_one"),
    )
    people = registrations.groupBy("person_id").agg(F.count(F.lit(1)).alias("_rows"))
    counts = people.agg(
        F.count(F.lit(1)).alias("competitors"),
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("attendance_rows"),
        F.lit(0).alias("_one"),
    )
    return listed.join(counts, "_one").drop("_one")


def last_pages(pages: DataFrame, key: str = "source_id", page: str = "page") -> DataFrame:
    """Listing pages merged by id; a later page wins."""
    return latest_per_key(pages, [key], [page])


def featured_competitors(competitors: DataFrame, featured: DataFrame) -> DataFrame:
    """Competitors with their featured flag (absent without a profile)."""
    return competitors.join(
        featured.select("person_id", F.col("is_active").alias("featured")), "person_id", "left"
    )


def attendance_table(attendance: DataFrame, competitors: DataFrame, competitions: DataFrame) -> DataFrame:
    """Attendance with its competitor and competition as nested rows."""
    people = competitors.select("person_id", F.struct(*competitors.columns).alias("competitor"))
    events = competitions.select("source_key", F.struct(*competitions.columns).alias("competition"))
    return attendance.join(people, "person_id").join(events, "source_key")


def competition_table(competitions: DataFrame) -> DataFrame:
    return competitions.orderBy("start_date", "name")

