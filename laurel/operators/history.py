"""Historical facts: single attempts and averages of the export with their date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laurel.operators.baseline import digits_value

_MAX_LONG = 9_223_372_036_854_775_807
COLUMNS = (
    "result_id",
    "kind",
    "attempt_number",
    "value",
    "person_id",
    "event_id",
    "country_id",
    "competition_id",
    "round_id",
    "round_type_id",
    "achieved_date",
)


def historical_facts(attempts: DataFrame, results: DataFrame, competitions: DataFrame) -> DataFrame:
    """Positive attempts as singles and positive averages as averages; text columns in.

    Results meet their competition once; attempts then join the slim result rows by result id.
    """
    round_id = F.nullif("round_id", F.lit("")) if "round_id" in results.columns else F.lit(None)
    ends = competitions.select(
        F.col("id").alias("competition_id"),
        F.make_date(
            F.col("end_year").cast("int"), F.col("end_month").cast("int"), F.col("end_day").cast("int")
        ).alias("achieved_date"),
    )
    dated = (
        results.where(F.col("id").rlike(r"^[1-9][0-9]*\z"))
        .withColumn("result_id", digits_value("id", 0, _MAX_LONG))
        .where(F.col("result_id").isNotNull())
        .join(ends, "competition_id")
        .select(
            "id",
            "result_id",
            "average",
            "person_id",
            "event_id",
            F.col("person_country_id").alias("country_id"),
            "competition_id",
            round_id.cast("string").alias("round_id"),
            "round_type_id",
            "achieved_date",
        )
    )
    tries = (
        attempts.where(F.col("attempt_number").rlike(r"^[1-5]\z"))
        .select(
            F.col("result_id").alias("id"),
            F.col("attempt_number").cast("int").alias("attempt_number"),
            digits_value("value").alias("value"),
        )
        .where(F.col("value").isNotNull())
    )
    singles = tries.join(dated, "id").withColumn("kind", F.lit("single")).select(*COLUMNS)
    averages = (
        dated.withColumns(
            {
                "kind": F.lit("average"),
                "attempt_number": F.lit(None).cast("int"),
                "value": digits_value("average"),
            }
        )
        .where(F.col("value").isNotNull())
        .select(*COLUMNS)
    )
    return singles.unionByName(averages)
