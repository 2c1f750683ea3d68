"""Best value per record cell from a rank export, and competitions it already contains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laurel.functions import fixed

CELL = ("level", "event_id", "kind", "scope")
_MAX_INT = 2_147_483_647


def people_scopes(persons: DataFrame, countries: DataFrame, continents: DataFrame) -> DataFrame:
    """Country and continent name per person, from the primary row of each person only."""
    c = countries.select(
        F.col("id").alias("_country"),
        F.coalesce(F.nullif("name", F.lit("")), "id", F.lit("")).alias("_country_name"),
        F.col("continent_id").alias("_continent"),
    )
    k = continents.select(F.col("id").alias("_continent"), F.col("name").alias("_continent_name"))
    return (
        persons.where(F.col("sub_id") == "1")
        .select(F.upper("wca_id").alias("person_id"), F.col("country_id").alias("_country"))
        .join(c, "_country", "left")
        .join(k, "_continent", "left")
        .select(
            "person_id",
            F.coalesce("_country_name", F.lit("")).alias("country"),
            F.coalesce(
                F.nullif("_continent_name", F.lit("")), F.ltrim("_continent", F.lit("_")), F.lit("")
            ).alias("continent"),
        )
    )


def digits_value(text, low: int = 0, high: int = _MAX_INT) -> Column:
    """Number of an all-digit text inside (low, high]; null otherwise."""
    text = F.col(text) if isinstance(text, str) else text
    number = F.when(text.rlike(r"^[0-9]+\z"), text.try_cast("decimal(38,0)"))
    return F.when((number > low) & (number <= high), number.cast("long"))


def ranked_values(ranks: DataFrame, people: DataFrame, kind: str, events: Sequence[str]) -> DataFrame:
    """Valid rank rows with the scopes of their person."""
    return (
        ranks.where(F.col("event_id").isin(*events))
        .select(F.upper("person_id").alias("person_id"), "event_id", digits_value("best").alias("value"))
        .where(F.col("value").isNotNull())
        .join(people, "person_id", "left")
        .select(
            F.lit(kind).alias("kind"),
            "event_id",
            "value",
            "person_id",
            F.coalesce("country", F.lit("")).alias("country"),
            F.coalesce("continent", F.lit("")).alias("continent"),
        )
    )


def level_scopes(continent="continent", country="country", person="person_id") -> Column:
    """The four (level, scope) pairs of a row; a missing scope is blank."""

    def pair(level: str, scope: Column) -> Column:
        return F.struct(
            F.lit(level).alias("level"), F.coalesce(scope.cast("string"), F.lit("")).alias("scope")
        )

    return F.array(
        pair("WR", F.lit("World")),
        pair("CR", F.col(continent)),
        pair("NR", F.col(country)),
        pair("PR", F.upper(F.col(person).cast("string"))),
    )


def explode_levels(df: DataFrame, **columns: str) -> DataFrame:
    return df.select("*", F.inline(level_scopes(**columns)))


def baseline_cells(values: DataFrame, **columns: str) -> DataFrame:
    """Best value per (level, event, kind, scope): one pass, combined before the shuffle."""
    return (
        explode_levels(values.where(F.col("value") > 0), **columns)
        .where(F.col("scope") != "")
        .groupBy(*CELL)
        .agg(F.min("value").alias("value"))
    )


def wide_cells(cells: DataFrame, kind: str, events: Sequence[str], prefix: str = "event_") -> DataFrame:
    """One row per record holder with a column per event (a fixed list, so no extra pass)."""
    return (
        cells.where(F.col("kind") == kind)
        .groupBy(F.col("scope").alias("record_holder"), F.col("level").alias("record_type"))
        .agg(
            *[
                F.min(F.when(F.col("event_id") == event, F.col("value"))).alias(f"{prefix}{event}")
                for event in events
            ]
        )
    )


def export_baseline(tables: dict[str, DataFrame]) -> DataFrame:
    """Long baseline cells of both kinds from the export tables."""
    people = people_scopes(tables["persons"], tables["countries"], tables["continents"])
    singles = ranked_values(tables["ranks_single"], people, "single", fixed.SINGLE_EVENTS)
    averages = ranked_values(tables["ranks_average"], people, "average", fixed.AVERAGE_EVENTS)
    return baseline_cells(singles.unionByName(averages))


def absorbed_competitions(results: DataFrame) -> DataFrame:
    """Competitions the export already contains: those with result rows."""
    return (
        results.where(F.coalesce("competition_id", F.lit("")) != "")
        .select("competition_id")
        .distinct()
    )


def without_absorbed(rows: DataFrame, absorbed: DataFrame) -> DataFrame:
    """Drop rows of absorbed competitions; rows without a competition id always stay."""
    return rows.join(absorbed.select("competition_id"), "competition_id", "left_anti")


def mark_absorbed(rows: DataFrame, absorbed: DataFrame, name: str = "absorbed") -> DataFrame:
    ids = absorbed.select("competition_id", F.lit(True).alias(name))
    return rows.join(ids, "competition_id", "left").withColumn(
        name, F.coalesce(F.col(name) & (F.col("competition_id") != ""), F.lit(False))
    )
