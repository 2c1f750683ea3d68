"""Time zones as a dimension: which names can be resolved, and local dates of those that can."""

from __future__ import annotations

import zoneinfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laurel.functions.times import local_date, zone_resolution


def zone_dimension(spark: SparkSession) -> DataFrame:
    """``zone``: the names of the time zone database, a few hundred rows."""
    return spark.createDataFrame([(z,) for z in sorted(zoneinfo.available_timezones())], "zone string")


def with_local_date(rows: DataFrame, zones: DataFrame, instant: str, zone: str, name: str = "local_date") -> DataFrame:
    """Add the local date (null where the zone is not one of ``zones``) and how the zone was resolved."""
    known = F.broadcast(zones.select(F.col("zone").alias("_zone")).distinct())
    joined = rows.join(known, F.col(zone) == F.col("_zone"), "left")
    dated = joined.withColumn(name, local_date(instant, zone, F.col("_zone").isNotNull()))
    return dated.withColumn("zone_resolution", zone_resolution(zone, name)).drop("_zone")
