"""Record timelines: outcomes, supersession, ties, current holders and ceased records.

A timeline is every result of one (level, event, kind, scope). The world level has one scope, so
one timeline may hold a large part of all rows; nothing here sorts or collects a timeline in one
task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from laurel.functions.status import invalidity_reason, revision_is_valid
from laurel.functions.times import classification_instant
from laurel.functions.values import outcome
from laurel.operators.baseline import CELL, explode_levels, mark_absorbed
from laurel.operators.grouping import attach_group, attach_lookup
from laurel.operators.scan import in_groups, long_groups, number_buckets, prefix_scan, previous_row, time_buckets
from laurel.session import stage

TIMELINE = list(CELL)
ORDER = ["at", "canonical_id", "revision"]
_BEFORE_ALL = "0001-01-01 00:00:00"


# A sort compares the first eight bytes of its first column cheaply: a hash tells timelines apart there,
# the level (four values) does not.
_MARKED = ["_timeline", *TIMELINE]


def _marked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_timeline", F.xxhash64(*TIMELINE))


def replay(
    members: DataFrame, baseline: DataFrame, buckets: list[Column] | None = None, groups: list[int] | None = None
) -> DataFrame:
    """Incumbent and outcome of every member row.

    The incumbent is the least of the baseline and all earlier members. Baseline cells enter the
    scan as rows before everything else, so the (hot) timelines need no join with them.
    ``members`` needs the timeline columns, ``ORDER`` and ``value``. ``buckets`` says how a
    timeline is cut (see ``scan``); the default is by minute. ``groups`` are the ``long_groups`` of the
    members, for callers that know them.
    """
    seeds = baseline.select(
        *TIMELINE,
        F.lit(_BEFORE_ALL).cast("timestamp").alias("at"),
        F.lit(-1).cast("long").alias("canonical_id"),
        F.lit(0).cast("int").alias("revision"),
        F.col("value").cast("long").alias("value"),
        F.lit(True).alias("_seed"),
    )
    rows = members.withColumn("value", F.col("value").cast("long")).withColumn("_seed", F.lit(False))
    both = rows.unionByName(seeds, allowMissingColumns=True)
    scanned = prefix_scan(
        _marked(both),
        _MARKED,
        ORDER,
        buckets or time_buckets("at"),
        {"incumbent": ("min", F.col("value"))},
        within=(TIMELINE, long_groups(both, TIMELINE) if groups is None else groups),
    )
    return (
        scanned.where(~F.col("_seed"))
        .withColumn("outcome", outcome("value", "incumbent"))
        .drop("_seed", "_timeline")
    )


def replay_since(rows: DataFrame, cut: Column, buckets: list[Column] | None = None) -> DataFrame:
    """``replay`` of the rows from ``cut`` on against all rows before them.

    ``rows`` are all level rows of the timelines, read several times. What lies before the cut is reduced
    to cells, map-side, so only later rows are scanned.
    """
    seeds = rows.where(F.col("at") < cut).groupBy(*TIMELINE).agg(F.min("value").alias("value"))
    return replay(rows.where(F.col("at") >= cut), seeds, buckets)


def replay_by_window(members: DataFrame, baseline: DataFrame) -> DataFrame:
    """The same result with one window per timeline; for timelines known to be short."""
    earlier = (
        Window.partitionBy(*TIMELINE).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    )
    base = baseline.select(*TIMELINE, F.col("value").cast("long").alias("_base"))
    return (
        members.join(base, TIMELINE, "left")
        .withColumn("value", F.col("value").cast("long"))
        .withColumn("incumbent", F.least("_base", F.min("value").over(earlier)))
        .withColumn("outcome", outcome("value", "incumbent"))
        .drop("_base")
    )


def live_cells(members: DataFrame, baseline: DataFrame) -> DataFrame:
    """Current value of every record cell: least of baseline and members."""
    cast = F.col("value").cast("long").alias("value")
    return (
        baseline.select(*TIMELINE, cast)
        .unionByName(members.select(*TIMELINE, cast))
        .groupBy(*TIMELINE)
        .agg(F.min("value").alias("value"))
    )


def adjudicate(replayed: DataFrame) -> DataFrame:
    """Recognition, shared ties, current holders and ceased records of replayed rows.

    Needs ``competition_id, competition_name, round_id, round_number, person_id, local_date``
    (blank or null when unknown) next to the replay columns. Returns one row per input row.
    """
    replayed = stage(replayed)
    judged = adjudicate_qualifying(replayed.where(F.col("outcome") != "none"))
    return judged.unionByName(not_judged(replayed.where(F.col("outcome") == "none")))


def replay_and_adjudicate(members: DataFrame, baseline: DataFrame) -> DataFrame:
    """``adjudicate`` of the replay of ``members``, which are read twice.

    Where no timeline is long, rows are shuffled once: the windows of adjudication follow the scan in place.
    """
    groups = long_groups(members, TIMELINE)
    replayed = replay(members, baseline, groups=groups)
    if groups:
        return adjudicate(replayed)
    judged = _adjudicate_short(replayed.where(F.col("outcome") != "none"))
    return judged.unionByName(not_judged(replayed.where(F.col("outcome") == "none")))


def adjudicate_qualifying(qualifying: DataFrame) -> DataFrame:
    """``adjudicate`` for rows that broke or tied a record; read several times, so stage them."""
    groups = long_groups(qualifying, TIMELINE)
    if not groups:
        return _adjudicate_short(qualifying)
    cut = in_groups(TIMELINE, groups)
    return _adjudicate_short(qualifying.where(~cut)).unionByName(_adjudicate_long(qualifying.where(cut)))


def _units(qualifying: DataFrame) -> DataFrame:
    """Adds the competition, round and day that a record counts once in."""
    return qualifying.withColumns(
        {
            "_competition": F.coalesce(
                F.nullif("competition_id", F.lit("")), "competition_name", F.lit("")
            ),
            "_round": F.coalesce(
                F.nullif("round_id", F.lit("")), F.col("round_number").cast("string"), F.lit("")
            ),
            "_day": F.coalesce("local_date", F.lit("0001-01-01").cast("date")),
        }
    )


def _recognition(rows: DataFrame) -> DataFrame:
    """Adds recognition and the winner of the round or day, whose best rows are known."""
    by_round = F.col("value") > F.col("_round_best.value")
    by_day = F.col("local_date").isNotNull() & (F.col("value") > F.col("_day_best.value"))
    rows = rows.withColumn(
        "recognition",
        F.when(by_round, "superseded_same_round")
        .when(by_day, "superseded_same_day")
        .otherwise("recognized"),
    ).withColumn(
        "_winner",
        F.when(by_round, F.col("_round_best")).when(by_day, F.col("_day_best")),
    )
    return rows.drop("_competition", "_round", "_day", "_round_best", "_day_best")


_FIRST_ROW = [*ORDER, "person_id", "competition_id", "competition_name"]


def _adjudicate_short(qualifying: DataFrame) -> DataFrame:
    """For timelines short enough for windows, which need one shuffle."""
    best = F.min(F.struct("value", *ORDER))
    rows = _marked(_units(qualifying)).repartition(*_MARKED)
    rows = rows.withColumn("_round_best", best.over(Window.partitionBy(*_MARKED, "_competition", "_round")))
    rows = _recognition(rows.withColumn("_day_best", best.over(Window.partitionBy(*_MARKED, "_day"))))
    smaller = Window.partitionBy(*_MARKED).orderBy("value").rangeBetween(Window.unboundedPreceding, -1)
    first = F.when(F.col("recognition") == "recognized", F.struct(*_FIRST_ROW))
    rows = rows.withColumns(
        {
            "_smaller": F.min("value").over(smaller),
            "_breaker": F.min(first).over(smaller),
            "_sharing": F.count(F.lit(1)).over(Window.partitionBy(*_MARKED, "value")),
        }
    )
    return _holding(rows, qualifying.columns)


def _adjudicate_long(qualifying: DataFrame) -> DataFrame:
    """For timelines of any length: aggregates and lookups instead of windows."""
    best = F.min(F.struct("value", *ORDER))
    rows = _units(qualifying)
    rows = attach_group(rows, TIMELINE + ["_competition", "_round"], [best.alias("_round_best")])
    rows = attach_group(rows, TIMELINE + ["_day"], [best.alias("_day_best")])
    rows = stage(_recognition(rows))

    # Qualifying values never rise along a timeline, so the first later recognized row with a
    # smaller value is the earliest one among all smaller values. That is a scan over the
    # distinct values of a timeline in rising order, cut by value. A value without any smaller
    # one is the current record.
    recognized = F.col("recognition") == "recognized"
    first_row = F.struct(*_FIRST_ROW)
    values = rows.groupBy(*TIMELINE, "value").agg(
        F.count(F.lit(1)).alias("_sharing"),
        F.min(F.when(recognized, first_row)).alias("_first"),
    )
    values = prefix_scan(
        values,
        TIMELINE,
        ["value"],
        number_buckets("value"),
        {"_smaller": ("min", F.col("value")), "_breaker": ("min", F.col("_first"))},
    ).drop("_first")
    return _holding(attach_lookup(rows, values, TIMELINE + ["value"]), qualifying.columns)


def _holding(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Current holders and ceased records, by the smaller values of a row's timeline."""
    recognized = F.col("recognition") == "recognized"
    holds = recognized & F.col("_smaller").isNull()
    breaker = F.col("_breaker")
    ceased = recognized & ~holds & breaker.isNotNull()
    person = F.nullif("person_id", F.lit(""))
    same_person = F.coalesce(person == breaker["person_id"], F.lit(False))
    own, other = F.nullif("competition_id", F.lit("")), F.nullif(breaker["competition_id"], F.lit(""))
    same_competition = F.when(own.isNotNull() & other.isNotNull(), own == other).otherwise(
        F.col("competition_name").eqNullSafe(breaker["competition_name"])
    )
    reason = (
        F.when(same_competition & same_person, "broken_by_self_later_round")
        .when(same_competition, "broken_by_other_later_round")
        .when(same_person, "broken_by_self_other_competition")
        .otherwise("broken_by_other_other_competition")
    )
    return rows.select(
        *columns,
        "recognition",
        (F.col("_sharing") > 1).alias("shared_tie"),
        holds.alias("currently_holds"),
        F.when(ceased, reason).otherwise("").alias("ceased_reason"),
        F.when(ceased, breaker["canonical_id"]).alias("ceased_by"),
        F.when(ceased, breaker["revision"]).alias("ceased_by_revision"),
        F.col("_winner.canonical_id").alias("superseded_by"),
        F.col("_winner.revision").alias("superseded_by_revision"),
    )


def not_judged(rows: DataFrame) -> DataFrame:
    """Rows outside adjudication, with the columns ``adjudicate`` adds."""
    revision = F.lit(None).cast(rows.schema["revision"].dataType)
    return rows.select(
        "*",
        F.lit("not_applicable").alias("recognition"),
        F.lit(False).alias("shared_tie"),
        F.lit(False).alias("currently_holds"),
        F.lit("").alias("ceased_reason"),
        F.lit(None).cast("long").alias("ceased_by"),
        revision.alias("ceased_by_revision"),
        F.lit(None).cast("long").alias("superseded_by"),
        revision.alias("superseded_by_revision"),
    )


def out_of_order(members: DataFrame) -> DataFrame:
    """Flag rows that have a later row in one of their timelines."""
    last = F.max(F.struct(*ORDER)).alias("_last")
    return (
        attach_group(members, TIMELINE, [last])
        .withColumn("out_of_order", F.col("_last") > F.struct(*ORDER))
        .drop("_last")
    )


# --- revisions -------------------------------------------------------------------------------


def process_revisions(revisions: DataFrame) -> DataFrame:
    """Validity of every revision and, for replaced ones, the revision that replaced them."""
    rows = revisions.withColumns(
        {
            "at": classification_instant("entered_at", "first_observed_at"),
            "_own_valid": revision_is_valid("action", "status", "validation_status", "value"),
        }
    )
    rows = previous_row(
        rows,
        ["canonical_id"],
        ["revision"],
        number_buckets("revision"),
        ["revision", "action"],
        name="_next",
        following=True,
    )
    replaced = F.col("_own_valid") & F.col("_next").isNotNull()
    return rows.withColumns(
        {
            "is_head": F.col("_next").isNull(),
            "is_valid": F.col("_own_valid") & F.col("_next").isNull(),
            "invalidity_reason": F.when(
                replaced,
                F.when(F.col("_next.action") == "retracted", "retracted_result").otherwise(
                    "corrected_result"
                ),
            ).otherwise(invalidity_reason("action", "_own_valid")),
            "replacement": F.when(replaced, F.col("_next.revision")),
        }
    ).drop("_next")


def classify(revisions: DataFrame, baseline: DataFrame, absorbed: DataFrame) -> DataFrame:
    """Four level rows for every revision, by replay order.

    Head revisions that are valid and not absorbed form the live timelines and are adjudicated.
    Older and absorbed revisions are compared with the baseline and all earlier complete
    revisions, and never hold a record. ``revisions`` needs the columns used by
    ``process_revisions`` and ``adjudicate`` plus ``continent`` and ``country``.
    """
    processed = stage(mark_absorbed(process_revisions(revisions), absorbed))
    levels = explode_levels(processed)
    scoped = F.col("scope") != ""
    live = F.col("is_head") & F.col("is_valid") & ~F.col("absorbed")
    heads = replay_and_adjudicate(levels.where(live & scoped), baseline)

    past = ~F.col("is_head") | F.col("absorbed")
    everything = levels.where(scoped & (F.col("value") > 0))
    replayed = replay(everything, baseline).where(past)
    history = not_judged(
        replayed.withColumn(
            "outcome", F.when(F.col("_own_valid"), F.col("outcome")).otherwise("none")
        )
    ).withColumn(
        "recognition",
        F.when(F.col("outcome") != "none", "recognized").otherwise(F.col("recognition")),
    )
    rest = not_judged(
        levels.where(~scoped | (~live & ~(past & (F.col("value") > 0))))
        .withColumn("value", F.col("value").cast("long"))
        .withColumn("incumbent", F.lit(None).cast("long"))
        .withColumn("outcome", F.lit("none"))
    )
    return heads.unionByName(history).unionByName(rest).drop("_own_valid")


def classify_live(revisions: DataFrame, baseline: DataFrame, absorbed: DataFrame) -> DataFrame:
    """Of ``classify``, the level rows of live timelines alone, with the columns of ``MEMBER``."""
    processed = mark_absorbed(process_revisions(revisions), absorbed)
    processed = processed.where(F.col("is_head") & F.col("is_valid") & ~F.col("absorbed"))
    levels = explode_levels(processed).where(F.col("scope") != "").select(*MEMBER)
    return replay_and_adjudicate(stage(levels.withColumn("value", F.col("value").cast("long"))), baseline)


# What replay and adjudication read of a level row.
MEMBER = [
    *TIMELINE, *ORDER, "value", "person_id", "competition_id", "competition_name", "round_id", "round_number", "local_date"
]


def live_members(heads: DataFrame, absorbed: DataFrame) -> DataFrame:
    """Level rows of the heads that take part in live timelines: valid, complete and not absorbed."""
    valid = revision_is_valid("action", "status", "validation_status", "value")
    rows = heads.withColumn("at", classification_instant("entered_at", "first_observed_at")).where(valid)
    rows = mark_absorbed(rows, absorbed).where(~F.col("absorbed")).drop("absorbed")
    return explode_levels(rows).where(F.col("scope") != "").withColumn("value", F.col("value").cast("long"))


def adjudicated_schema(members: DataFrame) -> StructType:
    """The schema of ``adjudicate`` over replayed ``members``."""
    replayed = members.withColumns({"incumbent": F.lit(None).cast("long"), "outcome": F.lit("")})
    return not_judged(replayed).schema


def affected_timelines(changed: DataFrame, previous: DataFrame) -> DataFrame:
    """Timelines touched by changed rows: their scopes now and before the change."""
    pick = lambda df: explode_levels(df).where(F.col("scope") != "").select(*TIMELINE)
    return pick(changed).unionByName(pick(previous)).distinct()


def repair(
    levels: DataFrame, members: DataFrame, baseline: DataFrame, affected: DataFrame
) -> DataFrame:
    """Recompute only the affected timelines; the other level rows are kept as they are."""
    redone = adjudicate(
        replay(
            members.join(affected, TIMELINE, "left_semi"),
            baseline.join(affected, TIMELINE, "left_semi"),
        )
    )
    kept = levels.join(affected, TIMELINE, "left_anti")
    return kept.unionByName(redone.select(*levels.columns))
