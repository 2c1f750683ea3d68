"""Queries for conversions, lookups, filters and totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from laurel.functions import fixed, status
from laurel.operators import attendance as att
from laurel.operators import benchmarks, detections, evidence, feed, health, quality, rounds, upkeep
from laurel.plans.catalog import query
from laurel.plans.evidence import _LOG, observation_log
from laurel.plans.serving import _CLAIMS, _claims
from laurel.plans.tables import RES, baseline, events, results, table


def _old_detections(spark, folder):
    """Events as old per-claim rows of their user; errors are withdrawn claims."""
    level = F.when(F.col("event_type") == "purchase", "WR").otherwise("NR")
    return events(spark, folder).select(
        F.concat(F.col("user_id").cast("string"), F.lit("|"), level).alias("comparison_key"),
        level.alias("level"),
        F.when(F.col("event_type").isin("purchase", "signup"), fixed.POLLED).otherwise(fixed.SOCKET).alias("method"),
        F.when(F.col("event_type") == "error", "withdrawn").otherwise("active").alias("status"),
        F.col("ts").alias("detected_at"),
        F.col("event_id").alias("detection_id"),
        (F.floor("value") + 1).cast("long").alias("value"),
    )


@query(
    "claims_to_results",
    """SELECT CAST(user_id AS VARCHAR) AS identity_key,
      coalesce(arg_max(CAST(floor(value) AS BIGINT) + 1, event_id) FILTER (WHERE event_type IN ('purchase', 'signup')), arg_min(CAST(floor(value) AS BIGINT) + 1, event_id)) AS value,
      CASE WHEN arg_min(event_type, event_id) = 'error' THEN 'retracted' ELSE 'active' END AS status,
      CASE WHEN bool_or(event_type IN ('purchase', 'signup')) THEN 'verified' ELSE 'pending' END AS validation_status
    FROM events GROUP BY ALL""",
)
def claims_to_results(spark, folder):
    return upkeep.claims_to_results(_old_detections(spark, folder)).select(
        "identity_key", "value", "status", "validation_status"
    )


@query(
    "visible_achievements",
    """WITH a AS (SELECT event_id, user_id, event_type <> 'error' AS act, CASE WHEN event_type = 'purchase' THEN 0 ELSE 2 END AS rk FROM events)
    SELECT event_id, act AND rk = min(rk) FILTER (WHERE act) OVER (PARTITION BY user_id) AS shown FROM a""",
)
def visible_achievements(spark, folder):
    rows = _old_detections(spark, folder).withColumn(
        "identity_key", F.substring_index("comparison_key", "|", 1)
    )
    return upkeep.visible_achievements(rows).select(F.col("detection_id").alias("event_id"), "shown")


@query(
    "fact_changes",
    f"""WITH {_LOG}, a AS (SELECT user_id, method, arg_max(value, seq) AS v FROM log WHERE ts < TIMESTAMP '2024-01-16' AND op = 'observe' GROUP BY ALL),
    b AS (SELECT user_id, method, arg_max(value, seq) AS v FROM log WHERE ts >= TIMESTAMP '2024-01-16' AND op = 'observe' GROUP BY ALL)
    SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.method, b.method) AS method, CASE WHEN b.v IS NULL THEN 'retract' ELSE 'observe' END AS op
    FROM a FULL JOIN b ON a.user_id = b.user_id AND a.method = b.method WHERE a.v IS DISTINCT FROM b.v""",
)
def fact_changes(spark, folder):
    """Facts of the first half of the month brought to those of the second half."""
    log = observation_log(spark, folder).where("op = 'observe'")
    half = F.lit("2024-01-16").cast("timestamp")

    def state(part):
        return part.groupBy(*evidence.OBSERVATION).agg(F.max_by("value", "seq").alias("value"))

    changed = evidence.fact_changes(
        state(log.where(F.col("observed_at") < half)), state(log.where(F.col("observed_at") >= half)), ("value",)
    )
    return changed.select(F.col("source_identity").cast("long").alias("user_id"), "method", "op")


@query(
    "round_lookup",
    """SELECT l_orderkey, l_linenumber, CASE WHEN o_orderstatus = 'O' THEN 'found' ELSE 'unknown round' END AS outcome
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def round_lookup(spark, folder):
    """Lines look up the order as their round; only open orders are active rounds."""
    targets = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("round_id"),
        F.lit("333").alias("event_id"),
        F.lit("c").alias("competition_id"),
        (F.col("o_orderstatus") == "O").alias("active"),
        F.col("o_orderpriority").alias("format"),
    )
    rows = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("round_id"), "l_linenumber", F.lit("333").alias("event_id"), F.lit("c").alias("competition_id")
    )
    found, lost = rounds.find_rounds(rows, targets)
    both = found.select("round_id", "l_linenumber", F.lit("found").alias("outcome")).unionByName(
        lost.select("round_id", "l_linenumber", F.col("error").alias("outcome"))
    )
    return both.withColumnRenamed("round_id", "l_orderkey")


@query(
    "round_zone_filled",
    """SELECT event_id, CASE WHEN event_type = 'view' THEN 'Asia/Tokyo' WHEN z.user_id IS NOT NULL THEN 'Europe/Paris' ELSE '' END AS zone
    FROM events LEFT JOIN (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup') z USING (user_id)""",
)
def round_zone_filled(spark, folder):
    """Records without a zone take the one stored for their round."""
    rows = events(spark, folder)
    stored = rows.where(F.col("event_type") == "signup").select(
        F.col("user_id").alias("round_id"), F.lit("c").alias("competition_id"), F.lit("Europe/Paris").alias("competition_timezone")
    )
    records = rows.select(
        "event_id",
        F.col("user_id").alias("round_id"),
        F.lit("c").alias("competition_id"),
        F.when(F.col("event_type") == "view", "Asia/Tokyo").otherwise("").alias("competition_timezone"),
    )
    return detections.with_round_zone(records, stored).select("event_id", F.col("competition_timezone").alias("zone"))


@query(
    "raw_links",
    """SELECT event_type AS method, user_id, arg_max(event_id, event_id) AS raw_id FROM events WHERE value > 5 GROUP BY ALL""",
)
def raw_links(spark, folder):
    """Last raw frame per observation; small events lost theirs."""
    rows = events(spark, folder).select(
        F.lit("s").alias("source"),
        F.col("event_type").alias("method"),
        F.col("user_id").alias("source_identity"),
        F.when(F.col("value") > 5, F.col("event_id")).alias("raw_id"),
        F.col("event_id").alias("seq"),
    )
    return detections.raw_links(rows).select("method", F.col("source_identity").alias("user_id"), "raw_id")


@query(
    "relinked_detections",
    f"""WITH {_CLAIMS}, d AS (SELECT DISTINCT user_id, level FROM cl WHERE level <> '')
    SELECT d.user_id, d.level, l.canonical_id FROM d LEFT JOIN (SELECT user_id, max(event_id) AS canonical_id FROM events WHERE event_type = 'signup' GROUP BY ALL) l USING (user_id)""",
)
def relinked_detections(spark, folder):
    links = events(spark, folder).where(F.col("event_type") == "signup").select(
        F.col("user_id").alias("source_identity"),
        F.lit(fixed.SUBSCRIBED).alias("method"),
        F.lit("single").alias("kind"),
        F.col("event_id").alias("canonical_id"),
        F.col("event_id").alias("seq"),
    )
    found = detections.relink(detections.detections(_claims(spark, folder)), links)
    return found.select(F.col("stable_identity").alias("user_id"), "level", "canonical_id")


@query(
    "filtered_detections",
    f"""WITH {_CLAIMS}, n AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY seq) AS nxt FROM cl)
    SELECT user_id, level FROM n WHERE level = 'NR' GROUP BY ALL HAVING arg_max_null(nxt, seq) IS NOT NULL""",
)
def filtered_detections(spark, folder):
    """Withdrawn national claims of one method."""
    rows = detections.detections(_claims(spark, folder))
    found = feed.filter_detections(rows, fixed.SUBSCRIBED, "nr", "withdrawn")
    return found.select(F.col("stable_identity").alias("user_id"), "level")


@query(
    "unknown_tags",
    "SELECT upper(event_type) AS record_tag, count(*) AS rows FROM events GROUP BY ALL",
)
def unknown_tags(spark, folder):
    return quality.unknown_tags(events(spark, folder).select(F.upper("event_type").alias("record_tag")))


@query(
    "unsupported_events",
    f"""WITH {RES}, e AS (SELECT CASE event_id WHEN '1-URGENT' THEN '333' WHEN '2-HIGH' THEN '333mbf' ELSE event_id END AS event_id, kind FROM res)
    SELECT event_id, kind, event_id = '333' OR (event_id = '333mbf' AND kind = 'single') AS known, count(*) AS rows FROM e GROUP BY ALL""",
)
def unsupported_events(spark, folder):
    """Two priorities stand for official events, one of them without averages; the others are set aside."""
    named = F.when(F.col("event_id") == "1-URGENT", "333").when(F.col("event_id") == "2-HIGH", "333mbf").otherwise(F.col("event_id"))
    known, aside = quality.split_unsupported(results(spark, folder).withColumn("event_id", named))
    both = known.withColumn("known", F.lit(True)).unionByName(aside.withColumn("known", F.lit(False)))
    return both.groupBy("event_id", "kind", "known").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "planned_backfill",
    f"""WITH {_LOG} SELECT 'stream' AS source, 'single' AS kind, count(*) AS planned FROM log
    UNION ALL SELECT 'stream', 'missing_metadata', count(*) FROM log WHERE op = 'retract'""",
)
def planned_backfill(spark, folder):
    log = observation_log(spark, folder)
    states = log.select(
        "source", F.lit(True).alias("active"), F.when(F.col("op") == "observe", 5).alias("expected_attempts")
    )
    return health.planned_backfill(log, states)


@query(
    "record_totals",
    """SELECT 'source_observations' AS measure, count(*) AS rows FROM events
    UNION ALL SELECT 'result_observations', count(*) FROM lineitem
    UNION ALL SELECT 'canonical_results', count(*) FROM orders
    UNION ALL SELECT 'pending_validations', count(*) FROM orders WHERE o_orderstatus = 'P'
    UNION ALL SELECT 'rejected_validations', count(*) FROM orders WHERE o_orderstatus = 'F'
    UNION ALL SELECT 'processed_results', count(*) FROM customer
    UNION ALL SELECT 'classified_levels', count(*) FROM part WHERE p_type <> 'ECONOMY'""",
)
def record_totals(spark, folder):
    state = F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "F", "rejected").otherwise("verified")
    return health.record_totals(
        table(spark, folder, "events"),
        table(spark, folder, "lineitem"),
        table(spark, folder, "orders").select(state.alias("validation_status")),
        table(spark, folder, "customer"),
        table(spark, folder, "part").select(F.when(F.col("p_type") == "ECONOMY", "none").otherwise("broken").alias("outcome")),
    )


@query(
    "round_counts",
    """SELECT count(*) FILTER (WHERE o_orderstatus <> 'F') AS discovered,
      count(*) FILTER (WHERE o_orderstatus <> 'F' AND o_orderpriority = '1-URGENT') AS subscribed,
      count(*) FILTER (WHERE o_orderstatus <> 'F' AND o_orderpriority = '5-LOW') AS errors FROM orders""",
)
def round_counts(spark, folder):
    state = F.when(F.col("o_orderpriority") == "1-URGENT", "subscribed").when(F.col("o_orderpriority") == "5-LOW", "error").otherwise("discovered")
    return health.round_counts(
        table(spark, folder, "orders").select((F.col("o_orderstatus") != "F").alias("active"), state.alias("status"))
    )


@query(
    "queue_summary",
    """SELECT CAST(sum(greatest(user_id - 20, 0)) AS BIGINT) AS queue_size, max(user_id) AS peak_queue_size, epoch_us(max(ts)) AS captured,
      coalesce(arg_min(event_type, event_id) FILTER (WHERE event_type = 'error'), '') AS last_error FROM events""",
)
def queue_summary(spark, folder):
    """Queue sizes arrive as text; negative and unreadable ones count as zero."""
    rows = events(spark, folder).select(
        F.when(F.col("event_type") == "never", "x").otherwise((F.col("user_id") - 20).cast("string")).alias("queue_size"),
        F.col("user_id").cast("string").alias("peak_queue_size"),
        F.col("ts").alias("captured_at"),
        F.to_date("ts").alias("start_date"),
        F.col("event_id").alias("slug"),
        F.when(F.col("event_type") == "error", "error").otherwise("").alias("last_error"),
    )
    return health.queue_summary(rows).select(
        "queue_size", "peak_queue_size", F.unix_micros("captured_at").alias("captured"), "last_error"
    )


@query(
    "round_times",
    """SELECT user_id AS round_id, epoch_us(max(ts)) AS last_message, epoch_us(max(ts) FILTER (WHERE event_type = 'view')) AS last_snapshot FROM events GROUP BY ALL""",
)
def round_times(spark, folder):
    rows = events(spark, folder).select(
        F.col("user_id").alias("round_id"),
        F.col("ts").alias("observed_at"),
        F.when(F.col("event_type") == "view", "snapshot").otherwise("update").alias("type"),
    )
    return rounds.latest_round_times(rows).select(
        "round_id", F.unix_micros("last_message_at").alias("last_message"), F.unix_micros("last_snapshot_at").alias("last_snapshot")
    )


@query(
    "merged_preferences",
    """SELECT c_custkey, true AS record_wr, c_mktsegment <> 'BUILDING' AS record_cr, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'newsletter' ELSE '' END AS unknown FROM customer""",
)
def merged_preferences(spark, folder):
    """Explicit choices over defaults; an unknown alert type is reported and dropped."""
    chosen = F.create_map(
        F.when(F.col("c_mktsegment") == "MACHINERY", "newsletter").otherwise("record_cr"),
        F.col("c_mktsegment") != "BUILDING",
    )
    merged = status.merged_preferences(chosen)
    return table(spark, folder, "customer").select(
        "c_custkey",
        merged["record_wr"].alias("record_wr"),
        merged["record_cr"].alias("record_cr"),
        F.array_join(status.unknown_preferences(chosen), ",").alias("unknown"),
    )


@query(
    "featured_competitors",
    """SELECT c_custkey AS person_id, s_acctbal > 0 AS featured FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey""",
)
def featured_competitors(spark, folder):
    people = table(spark, folder, "customer").select(F.col("c_custkey").alias("person_id"))
    profiles = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("person_id"), (F.col("s_acctbal") > 0).alias("is_active"))
    return att.featured_competitors(people, profiles)


@query(
    "results_to_revalidate",
    f"""WITH {RES}, b AS (SELECT event_id, kind, min(value) AS v FROM res WHERE tm < TIMESTAMP '1996-01-01' GROUP BY ALL)
    SELECT canonical_id FROM res JOIN b USING (event_id, kind) WHERE round_number <> 2""",
)
def results_to_revalidate(spark, folder):
    """Heads in listed scopes with second-source evidence (round 1) or a verdict (round 3)."""
    heads = results(spark, folder)
    after = baseline(spark, folder).where(F.col("level") == "WR").withColumnRenamed("scope", "region")
    observations = heads.select(
        "canonical_id",
        F.when(F.col("round_number") == 1, fixed.SECOND_SOURCE).otherwise(fixed.FIRST_SOURCE).alias("source"),
        F.lit("active").alias("status"),
    )
    verdicts = heads.where(F.col("round_number") == 3).select("canonical_id")
    return benchmarks.refresh(after, after, heads, observations, verdicts).select("canonical_id")
