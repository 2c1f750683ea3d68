"""Attendance, window and round-target queries.

An order is an entry of its customer in a three-day competition that starts on the order date; its
priority says which source listed it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from laurel.functions import times
from laurel.operators import attendance as att
from laurel.operators import rounds, upkeep
from laurel.plans.catalog import query
from laurel.plans.tables import events, results, table


def _entries(spark, folder):
    """One registration row per order; urgent ones come from the official source."""
    official = F.col("o_orderpriority") == "1-URGENT"
    orders = table(spark, folder, "orders")
    people = table(spark, folder, "customer")
    return orders.join(people, F.col("o_custkey") == F.col("c_custkey")).select(
        F.date_format("o_orderdate", "yyyyMM").alias("source_key"),
        F.format_string("2000ABCD%02d", F.pmod("o_custkey", F.lit(100))).alias("person_id"),
        F.col("c_name").alias("name"),
        F.col("c_nationkey").cast("string").alias("country_code"),
        F.col("c_mktsegment").alias("continent"),
        F.when(official, "wca").otherwise("cubingchina").alias("source"),
        F.col("o_orderkey").alias("position"),
    )


_ENTRIES = """en AS (SELECT strftime(o_orderdate, '%Y%m') AS source_key, printf('2000ABCD%02d', o_custkey % 100) AS person_id,
  c_name AS name, o_orderpriority = '1-URGENT' AS off, o_orderkey AS position
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


@query(
    "attendance_merge",
    f"""WITH {_ENTRIES} SELECT source_key, person_id, list_aggregate(list_sort(list(DISTINCT CASE WHEN off THEN 'wca' ELSE 'cubingchina' END)), 'string_agg', ',') AS sources,
      coalesce(arg_max(name, position) FILTER (WHERE off), arg_min(name, position)) AS name FROM en GROUP BY ALL""",
)
def attendance_merge(spark, folder):
    """Registrations of both sources merged; the official row describes the person."""
    return att.merge_registrations(_entries(spark, folder)).select(
        "source_key", "person_id", F.array_join("sources", ",").alias("sources"), "name"
    )


@query(
    "attendance_statistics",
    f"""WITH {_ENTRIES}, m AS (SELECT source_key, person_id FROM en GROUP BY ALL),
    c AS (SELECT source_key, bool_or(off) AS o, bool_or(NOT off) AS n FROM en GROUP BY ALL)
    SELECT (SELECT count(*) FILTER (WHERE o) FROM c) AS official_competitions,
      (SELECT count(*) FILTER (WHERE n) FROM c) AS other_competitions, (SELECT count(*) FROM c) AS competitions,
      count(DISTINCT person_id) AS competitors, count(*) AS attendance_rows FROM m""",
)
def attendance_statistics(spark, folder):
    entries = _entries(spark, folder)
    competitions = entries.groupBy("source_key").agg(F.collect_set("source").alias("sources"))
    return att.sync_statistics(competitions, att.merge_registrations(entries))


@query(
    "unaccept_vanished",
    f"""WITH {_ENTRIES}, seen AS (SELECT DISTINCT source_key, person_id FROM en WHERE off),
    ref AS (SELECT DISTINCT source_key FROM en WHERE off AND source_key < '199701')
    SELECT e.source_key, e.person_id, s.person_id IS NOT NULL OR r.source_key IS NULL AS is_accepted
    FROM (SELECT DISTINCT source_key, person_id FROM en) e LEFT JOIN seen s USING (source_key, person_id)
    LEFT JOIN ref r ON r.source_key = e.source_key""",
)
def unaccept_vanished(spark, folder):
    """A sync of the 1995/96 competitions sees only the official rows."""
    entries = _entries(spark, folder)
    existing = entries.select("person_id", "source_key").distinct().withColumns(
        {
            "is_accepted": F.lit(True),
            "sources": F.array(F.lit("wca")),
            "observed_at": F.lit("2001-01-01").cast("timestamp"),
        }
    )
    official = entries.where(F.col("source") == "wca")
    refreshed = official.where(F.col("source_key") < "199701").select("source_key").distinct()
    synced = att.sync_attendance(
        existing,
        att.merge_registrations(official),
        refreshed,
        F.lit("2002-01-01").cast("timestamp"),
    )
    return synced.select("source_key", "person_id", "is_accepted")


@query(
    "attendance_rank",
    f"""WITH {_ENTRIES}, p AS (SELECT person_id, min(name) AS name, count(DISTINCT source_key) AS competitions,
        min(source_key) AS first_competition FROM en GROUP BY ALL)
    SELECT person_id, name, competitions, first_competition,
      row_number() OVER (ORDER BY lower(name), person_id) AS rank FROM p""",
)
def attendance_rank(spark, folder):
    """Competitors with their competitions, in one global order by folded name."""
    rows = _entries(spark, folder).withColumns(
        {"competition_name": F.col("source_key"), "start_date": F.col("source_key"), "end_date": F.col("source_key")}
    )
    # The person's first name in order stands for all rows of that id.
    names = rows.groupBy("person_id").agg(F.min("name").alias("name"))
    listed = att.competing_list(rows.drop("name").join(names, "person_id"))
    return listed.select(
        "person_id",
        "name",
        F.size("competitions").cast("long").alias("competitions"),
        F.get("competitions", F.lit(0))["id"].alias("first_competition"),
        "rank",
    )


@query(
    "overlap_join",
    """SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS start_date FROM orders
    WHERE CAST(o_orderdate AS DATE) <= DATE '1998-07-14' AND CAST(o_orderdate AS DATE) + 2 >= DATE '1998-07-08'
      AND o_orderstatus <> 'P'""",
)
def overlap_join(spark, folder):
    """Accepted entries of competitions touching the week of 8 July 1998."""
    orders = table(spark, folder, "orders")
    start = F.col("o_orderdate").cast("date")
    competitions = orders.select(
        F.col("o_orderkey").alias("source_key"), start.alias("start_date"), F.date_add(start, 2).alias("end_date")
    )
    rows = orders.select(
        F.col("o_orderkey").alias("source_key"),
        "o_custkey",
        (F.col("o_orderstatus") != "P").alias("is_accepted"),
    )
    window = times.weekend_window(F.lit("1998-07-10").cast("date"))
    found = att.in_window(rows, competitions, window["start"], window["end"])
    return found.select(F.col("source_key").alias("o_orderkey"), "o_custkey", "start_date")


@query(
    "official_match",
    """WITH n AS (SELECT s_suppkey, s_name, s_nationkey FROM supplier),
    c AS (SELECT lower('Nation ' || s_nationkey) AS k, count(*) AS m, min(s_name) AS official FROM n GROUP BY ALL)
    SELECT c_custkey, CASE WHEN m = 1 THEN official END AS official_id
    FROM customer LEFT JOIN c ON lower('NATION ' || c_nationkey) = k""",
)
def official_match(spark, folder):
    """Listings matched by folded name and dates when exactly one official row fits."""
    day = F.lit("2026-08-08").cast("date")
    official = table(spark, folder, "supplier").select(
        F.col("s_name").alias("official_id"),
        F.concat(F.lit("Nation "), F.col("s_nationkey").cast("string")).alias("name"),
        day.alias("start_date"),
        day.alias("end_date"),
    )
    listed = table(spark, folder, "customer").select(
        "c_custkey",
        F.lit("").alias("official_id"),
        F.concat(F.lit("NATION "), F.col("c_nationkey").cast("string")).alias("name"),
        day.alias("start_date"),
        day.alias("end_date"),
    )
    return att.match_official(listed, official).select("c_custkey", "official_id")


@query(
    "listing_pages_merged",
    "SELECT l_partkey AS source_id, max(l_orderkey * 10 + l_linenumber) AS page FROM lineitem GROUP BY ALL",
)
def listing_pages_merged(spark, folder):
    pages = table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("source_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("page"),
        "l_suppkey",
    )
    return att.last_pages(pages).select("source_id", "page")


@query(
    "round_targets_refreshed",
    """WITH r AS (SELECT o_orderkey AS round_id, CAST(o_orderdate AS DATE) AS d, o_orderstatus AS s FROM orders)
    SELECT round_id, CASE WHEN s = 'F' AND NOT (d <= DATE '1997-06-30' AND d >= DATE '1997-01-01') THEN 'subscribed'
        WHEN s = 'F' THEN 'retired' WHEN s = 'P' THEN 'discovered' ELSE 'subscribed' END AS status,
      NOT (s = 'F' AND d <= DATE '1997-06-30' AND d >= DATE '1997-01-01') AS active FROM r""",
)
def round_targets_refreshed(spark, folder):
    """Open (O) rounds are found again, partial (P) ones are new, filled (F) ones are missing."""
    day = F.col("o_orderdate").cast("date")
    base = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("round_id"),
        day.alias("competition_start"),
        day.alias("competition_end"),
        "o_orderstatus",
    )
    existing = base.where(F.col("o_orderstatus") != "P").drop("o_orderstatus").withColumns(
        {"status": F.lit("subscribed"), "active": F.lit(True)}
    )
    found = base.where(F.col("o_orderstatus") != "F").drop("o_orderstatus")
    start, end = F.lit("1997-01-01").cast("date"), F.lit("1997-06-30").cast("date")
    return rounds.refresh_rounds(existing, found, start, end).select("round_id", "status", "active")


@query(
    "round_messages_applied",
    """WITH m AS (SELECT user_id, event_type, arg_max(CASE WHEN event_type <> 'view' THEN value END, CASE WHEN event_type <> 'view' THEN event_id END) AS v FROM events GROUP BY ALL)
    SELECT user_id, event_type, coalesce(v, -1.0) AS cutoff FROM m""",
)
def round_messages_applied(spark, folder):
    """Cutoffs of (user, type) rounds after all messages; views carry none."""
    rows = events(spark, folder)
    key = [F.lit("c").alias("competition_id"), F.col("event_type").alias("event_id"), F.col("user_id").alias("round_id")]
    targets = rows.select(*key).distinct().withColumn("cutoff", F.lit(-1.0))
    messages = rows.select(
        *key,
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") != "view", F.col("value")).alias("cutoff"),
    )
    return rounds.apply_round_messages(targets, messages).select(
        F.col("round_id").alias("user_id"), F.col("event_id").alias("event_type"), "cutoff"
    )


@query(
    "retention",
    "SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-21 00:00:00'",
)
def retention(spark, folder):
    as_of = F.lit("2024-01-31").cast("timestamp")
    return upkeep.expire_frames(events(spark, folder), 10, as_of, "ts").select("event_id", "user_id")


@query(
    "attempt_results_retired",
    """WITH r AS (SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%Y%m') AS c, o_orderstatus = 'P' AS legacy FROM orders),
    f AS (SELECT DISTINCT o_custkey, c FROM r WHERE NOT legacy)
    SELECT o_orderkey, CASE WHEN legacy AND f.c IS NOT NULL THEN 'retracted' ELSE 'active' END AS status
    FROM r LEFT JOIN f USING (o_custkey, c)""",
)
def attempt_results_retired(spark, folder):
    """Partial orders stand for old attempt-level results of a (person, month)."""
    legacy = F.col("o_orderstatus") == "P"
    rows = table(spark, folder, "orders").select(
        "o_orderkey",
        F.date_format("o_orderdate", "yyyyMM").alias("competition_id"),
        F.col("o_custkey").cast("string").alias("person_id"),
        F.lit("333").alias("event_id"),
        F.lit(1).alias("round_number"),
        F.lit("single").alias("kind"),
        F.concat(F.lit("k"), F.when(legacy, "|aggregate").otherwise("|final")).alias("identity_key"),
        F.lit("active").alias("status"),
        F.lit("verified").alias("validation_status"),
        F.lit("").alias("validation_reason"),
    )
    return upkeep.retire_attempt_results(rows).select("o_orderkey", "status")


@query(
    "competition_list",
    """SELECT DISTINCT strftime(o_orderdate, '%Y%m') AS name, min(CAST(o_orderdate AS DATE)) AS start_date FROM orders GROUP BY 1""",
)
def competition_list(spark, folder):
    rows = (
        results(spark, folder)
        .groupBy(F.col("competition_id").alias("name"))
        .agg(F.min(F.to_date("at")).alias("start_date"))
    )
    return att.competition_table(rows)
