"""Baseline, timeline and history queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from laurel.operators import baseline as cells
from laurel.operators import quality, timeline
from laurel.operators.history import historical_facts
from laurel.plans.catalog import query
from laurel.plans.tables import (
    EVENTS,
    JUDGED,
    LEVELS,
    REPLAY,
    RES,
    baseline,
    live_results,
    members,
    replayed,
    results,
    table,
)

_CELL = "level, event_id, kind, scope"


@query(
    "baseline_long",
    f"WITH {LEVELS} SELECT {_CELL}, base AS value FROM base",
)
def baseline_long(spark, folder):
    return baseline(spark, folder)


_WIDE = ", ".join(
    f"min(base) FILTER (WHERE event_id = '{e}') AS \"event_{e}\"" for e in EVENTS
)


@query(
    "baseline_wide",
    f"WITH {LEVELS} SELECT scope AS record_holder, level AS record_type, {_WIDE} "
    "FROM base WHERE kind = 'single' GROUP BY ALL",
)
def baseline_wide(spark, folder):
    return cells.wide_cells(baseline(spark, folder), "single", EVENTS)


@query(
    "scope_grouping_sets",
    f"""WITH {RES} SELECT CASE WHEN grouping(person_id) = 0 THEN 'PR' WHEN grouping(country) = 0 THEN 'NR'
      WHEN grouping(continent) = 0 THEN 'CR' ELSE 'WR' END AS level, event_id, kind,
      coalesce(person_id, country, continent, 'World') AS scope, min(value) AS value, count(*) AS results
    FROM res GROUP BY GROUPING SETS ((event_id, kind), (event_id, kind, continent),
      (event_id, kind, country), (event_id, kind, person_id))""",
)
def scope_grouping_sets(spark, folder):
    """The four scopes as one exploded pass instead of grouping sets."""
    return (
        cells.explode_levels(results(spark, folder))
        .groupBy(*cells.CELL)
        .agg(F.min("value").alias("value"), F.count(F.lit(1)).alias("results"))
    )


@query(
    "absorbed_competitions",
    f"WITH {RES} SELECT DISTINCT competition_id FROM res WHERE tm < TIMESTAMP '1996-01-01'",
)
def absorbed_competitions(spark, folder):
    return cells.absorbed_competitions(
        results(spark, folder).where(F.col("at") < F.lit("1996-01-01").cast("timestamp"))
    )


@query(
    "absorbed_exclusion",
    """SELECT o_orderpriority AS event_id, count(*) AS results FROM orders o WHERE NOT EXISTS (
         SELECT 1 FROM orders b WHERE b.o_orderdate < TIMESTAMP '1996-01-01'
         AND strftime(b.o_orderdate, '%m') = strftime(o.o_orderdate, '%m')
         AND b.o_orderpriority = '1-URGENT' AND b.o_custkey = o.o_custkey) GROUP BY ALL""",
)
def absorbed_exclusion(spark, folder):
    """Results outside the (person, month) pairs the first year already contains."""
    rows = table(spark, folder, "orders").withColumn(
        "competition_id", F.concat_ws("-", "o_custkey", F.date_format("o_orderdate", "MM"))
    )
    first_year = rows.where(
        (F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz"))
        & (F.col("o_orderpriority") == "1-URGENT")
    )
    kept = cells.without_absorbed(rows, cells.absorbed_competitions(first_year))
    return kept.groupBy(F.col("o_orderpriority").alias("event_id")).agg(
        F.count(F.lit(1)).alias("results")
    )


_OUTCOMES = f"WITH {REPLAY} SELECT {_CELL}, canonical_id, value, incumbent, outcome FROM oc"
_OUTCOME_COLUMNS = [*cells.CELL, "canonical_id", "value", "incumbent", "outcome"]


@query("timeline_outcomes", _OUTCOMES)
def timeline_outcomes(spark, folder):
    return replayed(spark, folder).select(*_OUTCOME_COLUMNS)


@query("timeline_outcomes_by_window", _OUTCOMES)
def timeline_outcomes_by_window(spark, folder):
    """Against baseline cells, with one window per timeline and minute; the form for exact instants."""
    return timeline.replay(members(spark, folder), baseline(spark, folder)).select(*_OUTCOME_COLUMNS)


@query(
    "live_cells",
    f"""WITH {LEVELS} SELECT {_CELL}, least(min(base), min(value)) AS value
    FROM base FULL JOIN mem USING ({_CELL}) GROUP BY ALL""",
)
def live_cells(spark, folder):
    return timeline.live_cells(members(spark, folder), baseline(spark, folder))


def _judged(spark, folder):
    rows = replayed(spark, folder)
    return timeline.adjudicate(rows)


def _qualifying(spark, folder):
    from laurel.session import stage

    rows = replayed(spark, folder)
    return timeline.adjudicate_qualifying(stage(rows.where(F.col("outcome") != "none")))


@query(
    "record_levels",
    f"""WITH {JUDGED} SELECT oc.level, oc.event_id, oc.kind, oc.scope, oc.canonical_id, oc.outcome,
      coalesce(recognition, 'not_applicable') AS recognition,
      coalesce(sharing > 1, false) AS shared_tie,
      coalesce(recognition = 'recognized' AND j.value = final, false) AS currently_holds
    FROM oc LEFT JOIN j USING (level, event_id, kind, scope, canonical_id)""",
)
def record_levels(spark, folder):
    return _judged(spark, folder).select(
        *cells.CELL, "canonical_id", "outcome", "recognition", "shared_tie", "currently_holds"
    )


@query(
    "same_round",
    f"""WITH {JUDGED} SELECT {_CELL}, canonical_id, round_winner AS superseded_by FROM j
    JOIN rw USING (level, event_id, kind, scope, competition_id, round_number)
    WHERE recognition = 'superseded_same_round'""",
)
def same_round(spark, folder):
    return (
        _qualifying(spark, folder)
        .where(F.col("recognition") == "superseded_same_round")
        .select(*cells.CELL, "canonical_id", "superseded_by")
    )


@query(
    "same_day",
    f"""WITH {JUDGED} SELECT {_CELL}, canonical_id, day_winner AS superseded_by FROM j
    JOIN dw USING (level, event_id, kind, scope, local_date)
    WHERE recognition = 'superseded_same_day'""",
)
def same_day(spark, folder):
    return (
        _qualifying(spark, folder)
        .where(F.col("recognition") == "superseded_same_day")
        .select(*cells.CELL, "canonical_id", "superseded_by")
    )


@query(
    "shared_ties",
    f"""WITH {JUDGED} SELECT {_CELL}, canonical_id, value, outcome FROM j WHERE sharing > 1""",
)
def shared_ties(spark, folder):
    return (
        _qualifying(spark, folder)
        .where("shared_tie")
        .select(*cells.CELL, "canonical_id", "value", "outcome")
    )


@query(
    "ceased_holding",
    f"""WITH {JUDGED} SELECT {_CELL}, j.canonical_id, nxt.c AS ceased_by,
      CASE WHEN nxt.k = competition_id AND nxt.p = person_id THEN 'broken_by_self_later_round'
           WHEN nxt.k = competition_id THEN 'broken_by_other_later_round'
           WHEN nxt.p = person_id THEN 'broken_by_self_other_competition'
           ELSE 'broken_by_other_other_competition' END AS ceased_reason
    FROM j JOIN br USING ({_CELL}, value)
    WHERE recognition = 'recognized' AND value <> final AND nxt IS NOT NULL""",
)
def ceased_holding(spark, folder):
    return (
        _qualifying(spark, folder)
        .where(F.col("ceased_by").isNotNull())
        .select(*cells.CELL, "canonical_id", "ceased_by", "ceased_reason")
    )


@query(
    "current_holders",
    f"""WITH {JUDGED} SELECT {_CELL}, canonical_id, person_id, country, value, outcome,
      epoch_us(tm) AS at_micros FROM j WHERE recognition = 'recognized' AND value = final""",
)
def current_holders(spark, folder):
    """Results after the baseline that broke or tied a record and hold it now."""
    return (
        _qualifying(spark, folder)
        .where("currently_holds")
        .select(
            *cells.CELL,
            "canonical_id",
            "person_id",
            "country",
            "value",
            "outcome",
            F.unix_micros("at").alias("at_micros"),
        )
    )


@query(
    "out_of_order",
    f"""WITH {RES} SELECT canonical_id, event_id, kind,
      max({{'a': tm, 'c': canonical_id}}) OVER (PARTITION BY event_id, kind) > {{'a': tm, 'c': canonical_id}} AS out_of_order
    FROM res""",
)
def out_of_order(spark, folder):
    world = results(spark, folder).withColumns({"level": F.lit("WR"), "scope": F.lit("World")})
    return timeline.out_of_order(world).select("canonical_id", "event_id", "kind", "out_of_order")


def _month_revisions(spark, folder):
    """Each (person, event, kind) is one canonical result; its orders in id order are revisions."""
    rows = results(spark, folder)
    ident = F.xxhash64("person_id", "event_id", "kind")
    return rows.select(
        ident.alias("canonical_id"),
        F.col("canonical_id").alias("revision"),
        F.when(F.col("round_number") == 1, "retracted").otherwise("corrected").alias("action"),
        F.when(F.col("round_number") == 1, "retracted").otherwise("active").alias("status"),
        F.lit("verified").alias("validation_status"),
        "person_id",
        "event_id",
        "kind",
        "value",
        F.col("at").alias("entered_at"),
        F.col("at").alias("first_observed_at"),
    )


@query(
    "replacement_chain",
    f"""WITH {RES}, r AS (SELECT *, round_number <> 1 AS own,
        lead(canonical_id) OVER w AS nxt, lead(round_number) OVER w AS nxt_round
      FROM res WINDOW w AS (PARTITION BY person_id, event_id, kind ORDER BY canonical_id))
    SELECT person_id, event_id, kind, canonical_id AS revision, own AND nxt IS NULL AS is_valid,
      CASE WHEN own AND nxt IS NOT NULL THEN CASE WHEN nxt_round = 1 THEN 'retracted_result' ELSE 'corrected_result' END
           WHEN NOT own THEN 'retracted_result' ELSE '' END AS invalidity_reason,
      CASE WHEN own THEN nxt END AS replacement
    FROM r""",
)
def replacement_chain(spark, folder):
    return timeline.process_revisions(_month_revisions(spark, folder)).select(
        "person_id", "event_id", "kind", "revision", "is_valid", "invalidity_reason", "replacement"
    )


_CLASSIFIED = f"""WITH {LEVELS},
h AS (SELECT *, competition_id < '199602' AS absorbed FROM lv WHERE tm >= TIMESTAMP '1996-01-01'),
rep AS (
  SELECT h.*, base, least(base, min(value) FILTER (WHERE NOT absorbed) OVER w) AS live_inc,
         least(base, min(value) OVER w) AS all_inc
  FROM h LEFT JOIN base USING (level, event_id, kind, scope)
  WINDOW w AS (PARTITION BY level, event_id, kind, scope ORDER BY tm, canonical_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
x AS (SELECT *, CASE WHEN absorbed THEN all_inc ELSE live_inc END AS incumbent FROM rep)
SELECT level, event_id, kind, scope, canonical_id, absorbed, incumbent,
  CASE WHEN incumbent IS NULL OR value < incumbent THEN 'broken' WHEN value = incumbent THEN 'tied' ELSE 'none' END AS outcome
FROM x"""


@query("classified_history", _CLASSIFIED)
def classified_history(spark, folder):
    """Live results with the first live month already absorbed by the export."""
    rows = live_results(spark, folder).withColumns(
        {
            "action": F.lit("active"),
            "status": F.lit("active"),
            "validation_status": F.lit("verified"),
            "entered_at": F.col("at"),
            "first_observed_at": F.col("at"),
        }
    )
    absorbed = (
        table(spark, folder, "orders")
        .select(F.date_format("o_orderdate", "yyyyMM").alias("competition_id"))
        .where(F.col("competition_id") < "199602")
        .distinct()
    )
    return timeline.classify(rows, baseline(spark, folder), absorbed).select(
        *cells.CELL, "canonical_id", "absorbed", "incumbent", "outcome"
    )


@query(
    "repaired_timelines",
    f"""WITH {REPLAY} SELECT level, event_id, kind, scope, canonical_id, incumbent, outcome FROM oc
    WHERE (level, event_id, kind, scope) IN (
      SELECT (level, event_id, kind, scope) FROM lv WHERE tm >= TIMESTAMP '2001-07-01')""",
)
def repaired_timelines(spark, folder):
    """Replay of only the timelines touched by the results since July 2001."""
    changed = live_results(spark, folder).where(
        F.col("at") >= F.lit("2001-07-01").cast("timestamp")
    )
    touched = timeline.affected_timelines(changed, changed)
    return timeline.replay(
        members(spark, folder).join(touched, list(cells.CELL), "left_semi"),
        baseline(spark, folder).join(touched, list(cells.CELL), "left_semi"),
    ).select(*cells.CELL, "canonical_id", "incumbent", "outcome")


_FACTS = """facts AS (
  SELECT l_orderkey AS result_id, 'single' AS kind, l_linenumber AS attempt_number,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS value, o_custkey AS person_id,
         o_orderpriority AS event_id, strftime(o_orderdate, '%Y%m') AS competition_id,
         CAST(o_orderdate AS DATE) AS achieved_date
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber BETWEEN 1 AND 5
  UNION ALL
  SELECT o_orderkey, 'average', NULL, CAST(round(o_totalprice * 100) AS BIGINT), o_custkey,
         o_orderpriority, strftime(o_orderdate, '%Y%m'), CAST(o_orderdate AS DATE) FROM orders)"""


def _facts(spark, folder):
    orders = table(spark, folder, "orders")
    month = F.date_format("o_orderdate", "yyyyMM")
    attempts = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("result_id"),
        F.col("l_linenumber").cast("string").alias("attempt_number"),
        F.round(F.col("l_extendedprice") * 100).cast("long").cast("string").alias("value"),
    )
    # Order 0 is a valid order but not a valid result id, so ids are shifted by one here.
    shifted = (F.col("o_orderkey") + 1).cast("string")
    rows = orders.select(
        shifted.alias("id"),
        F.round(F.col("o_totalprice") * 100).cast("long").cast("string").alias("average"),
        F.concat_ws("-", month, F.date_format("o_orderdate", "dd")).alias("competition_id"),
        F.col("o_custkey").cast("string").alias("person_id"),
        F.when(F.col("o_orderkey") % 97 == 0, "").otherwise("X").alias("person_country_id"),
        F.col("o_orderpriority").alias("event_id"),
        F.lit("f").alias("round_type_id"),
    )
    days = orders.select("o_orderdate").distinct()
    competitions = days.select(
        F.concat_ws("-", month, F.date_format("o_orderdate", "dd")).alias("id"),
        F.year("o_orderdate").cast("string").alias("end_year"),
        F.month("o_orderdate").cast("string").alias("end_month"),
        F.dayofmonth("o_orderdate").cast("string").alias("end_day"),
    ).distinct()
    attempts = attempts.withColumn("result_id", (F.col("result_id").cast("long") + 1).cast("string"))
    return historical_facts(attempts, rows, competitions)


@query(
    "historical_facts",
    f"WITH {_FACTS} SELECT result_id, kind, attempt_number, value, CAST(person_id AS VARCHAR) AS person_id, "
    "event_id, competition_id, achieved_date FROM facts",
)
def historical(spark, folder):
    return _facts(spark, folder).select(
        (F.col("result_id") - 1).alias("result_id"),
        "kind",
        "attempt_number",
        "value",
        "person_id",
        "event_id",
        F.substring("competition_id", 1, 6).alias("competition_id"),
        "achieved_date",
    )


@query(
    "historical_gate",
    f"""WITH {_FACTS} SELECT count(*) FILTER (WHERE kind = 'single') AS singles,
      count(*) FILTER (WHERE kind = 'average') AS averages, count(*) AS total,
      count(*) FILTER (WHERE result_id % 97 = 0) AS invalid,
      (SELECT count(*) FROM (SELECT 1 FROM facts GROUP BY result_id, kind, attempt_number HAVING count(*) > 1)) AS duplicates
    FROM facts""",
)
def historical_gate(spark, folder):
    """Facts of one order in 97 have no country and must not be published."""
    return quality.historical_gate(_facts(spark, folder))
