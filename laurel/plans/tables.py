"""The given tables read as inputs of the operators.

Orders stand for results: customer = person, nation/region = country/continent, priority = event,
month = competition, week = local day. Rows before 1996 form the baseline export, later rows arrive live.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laurel.operators import timeline
from laurel.operators.baseline import baseline_cells, explode_levels
from laurel.operators.scan import instant_buckets
from laurel.session import stage, tune

BASELINE_END = "1996-01-01"
EVENTS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")

RES = """
res AS (
  SELECT o_orderkey AS canonical_id, CAST(c_custkey AS VARCHAR) AS person_id, n_name AS country,
         r_name AS continent, o_orderpriority AS event_id,
         CASE WHEN o_orderstatus = 'P' THEN 'average' ELSE 'single' END AS kind,
         CAST(floor(o_totalprice / 4000) AS BIGINT) + 1 AS value, o_orderdate AS tm,
         CAST(date_trunc('week', o_orderdate) AS DATE) AS local_date, strftime(o_orderdate, '%Y%m') AS competition_id,
         o_orderkey % 3 + 1 AS round_number
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
LEVELS = (
    RES
    + """,
lv AS (
  SELECT 'WR' AS level, 'World' AS scope, * FROM res
  UNION ALL SELECT 'CR', continent, * FROM res
  UNION ALL SELECT 'NR', country, * FROM res
  UNION ALL SELECT 'PR', person_id, * FROM res),
base AS (
  SELECT level, event_id, kind, scope, min(value) AS base FROM lv
  WHERE tm < TIMESTAMP '1996-01-01' GROUP BY ALL),
mem AS (SELECT * FROM lv WHERE tm >= TIMESTAMP '1996-01-01')"""
)
REPLAY = (
    LEVELS
    + """,
rep AS (
  SELECT mem.*, least(base, min(value) OVER (
      PARTITION BY level, event_id, kind, scope ORDER BY tm, canonical_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS incumbent
  FROM mem LEFT JOIN base USING (level, event_id, kind, scope)),
oc AS (
  SELECT *, CASE WHEN incumbent IS NULL OR value < incumbent THEN 'broken'
                 WHEN value = incumbent THEN 'tied' ELSE 'none' END AS outcome FROM rep)"""
)
JUDGED = (
    REPLAY
    + """,
q AS (
  SELECT *, min(value) OVER r AS rb, min(value) OVER d AS db,
         count(*) OVER v AS sharing, min(value) OVER t AS final
  FROM oc WHERE outcome <> 'none'
  WINDOW r AS (PARTITION BY level, event_id, kind, scope, competition_id, round_number),
         d AS (PARTITION BY level, event_id, kind, scope, local_date),
         v AS (PARTITION BY level, event_id, kind, scope, value),
         t AS (PARTITION BY level, event_id, kind, scope)),
j AS (
  SELECT *, CASE WHEN value > rb THEN 'superseded_same_round'
                 WHEN value > db THEN 'superseded_same_day' ELSE 'recognized' END AS recognition
  FROM q),
rw AS (
  SELECT level, event_id, kind, scope, competition_id, round_number,
         min({'a': tm, 'c': canonical_id}).c AS round_winner
  FROM q WHERE value = rb GROUP BY ALL),
dw AS (
  SELECT level, event_id, kind, scope, local_date, min({'a': tm, 'c': canonical_id}).c AS day_winner
  FROM q WHERE value = db GROUP BY ALL),
first_rows AS (
  SELECT level, event_id, kind, scope, value,
         min({'a': tm, 'c': canonical_id, 'p': person_id, 'k': competition_id}) AS f
  FROM j WHERE recognition = 'recognized' GROUP BY ALL),
br AS (
  SELECT *, lead(f) OVER (PARTITION BY level, event_id, kind, scope ORDER BY value DESC) AS nxt
  FROM first_rows)"""
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{folder}/{name}.parquet")


def results(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as results with the scopes of their person."""
    nation = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    people = table(spark, folder, "customer").join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")
    )
    day = F.col("o_orderdate")
    return (
        table(spark, folder, "orders")
        .join(people, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("o_orderkey").alias("canonical_id"),
            F.lit(1).alias("revision"),
            F.col("c_custkey").cast("string").alias("person_id"),
            F.col("n_name").alias("country"),
            F.col("r_name").alias("continent"),
            F.col("o_orderpriority").alias("event_id"),
            F.when(F.col("o_orderstatus") == "P", "average").otherwise("single").alias("kind"),
            (F.floor(F.col("o_totalprice") / 4000) + 1).cast("long").alias("value"),
            day.cast("timestamp").alias("at"),
            F.date_trunc("week", day).cast("date").alias("local_date"),
            F.date_format(day, "yyyyMM").alias("competition_id"),
            F.lit("").alias("competition_name"),
            F.lit("").alias("round_id"),
            (F.col("o_orderkey") % 3 + 1).cast("int").alias("round_number"),
        )
    )


def _cut():
    return F.lit(BASELINE_END).cast("timestamp")


def baseline(spark: SparkSession, folder: str) -> DataFrame:
    return baseline_cells(results(spark, folder).where(F.col("at") < _cut()))


def live_results(spark: SparkSession, folder: str) -> DataFrame:
    return results(spark, folder).where(F.col("at") >= _cut())


def members(spark: SparkSession, folder: str) -> DataFrame:
    return explode_levels(live_results(spark, folder))


def replayed(spark: SparkSession, folder: str) -> DataFrame:
    """Live level rows with incumbent and outcome; their instants are whole days."""
    levels = explode_levels(stage(results(spark, folder)))
    return timeline.replay_since(levels, _cut(), instant_buckets("at", "canonical_id"))


def events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
