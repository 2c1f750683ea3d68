"""Status summaries: counts, queues, workers, rates and discovery statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laurel.functions import fixed
from laurel.functions import times
from laurel.functions.status import non_negative_int, queue_state
from laurel.operators.grouping import attach_lookup
from laurel.operators.scan import previous_row, time_buckets


def counts_by_status(rows: DataFrame, statuses: Sequence[str], column: str = "status") -> DataFrame:
    """A count for every known status, zero where none occurs."""
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    known = _literal_rows(rows.sparkSession, column, statuses)
    return known.join(counts, column, "left").select(
        column, F.coalesce("_n", F.lit(0)).alias("count")
    )


def _literal_rows(spark: SparkSession, column: str, values: Sequence[str]) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(v) for v in values])).alias(column))


def delivery_health(deliveries: DataFrame, as_of: Column) -> DataFrame:
    """Queued and due deliveries, the oldest queued one and the last sent one."""
    queued = F.col("status").isin("pending", "retry")
    due = queued & F.coalesce(F.col("next_attempt_at") <= as_of, F.lit(True))
    oldest = F.min(F.when(queued, F.col("created_at")))
    return deliveries.agg(
        F.count_if(queued).alias("queued"),
        F.count_if(due).alias("due"),
        oldest.alias("oldest_queued_at"),
        F.greatest(
            F.coalesce(times.seconds_between(as_of, oldest), F.lit(0.0)), F.lit(0.0)
        ).alias("oldest_queue_seconds"),
        F.max(F.when(F.col("status") == "sent", F.col("sent_at"))).alias("last_sent_at"),
        F.count_if(F.col("created_at") >= as_of - F.expr("INTERVAL 24 HOURS")).alias("last_day"),
    )


def record_totals(
    frames: DataFrame, observations: DataFrame, heads: DataFrame, processed: DataFrame, levels: DataFrame
) -> DataFrame:
    """Row counts along the way from raw frames to classified levels."""

    def counted(df: DataFrame, **counts: Column) -> DataFrame:
        named = [value.alias(name) for name, value in counts.items()]
        pairs = [F.struct(F.lit(n).alias("measure"), F.col(n).alias("rows")) for n in counts]
        return df.agg(*named).select(F.inline(F.array(*pairs)))

    every = F.count(F.lit(1))
    status = F.col("validation_status")
    return (
        counted(frames, source_observations=every)
        .unionByName(counted(observations, result_observations=every))
        .unionByName(
            counted(
                heads,
                canonical_results=every,
                pending_validations=F.count_if(status == "pending"),
                rejected_validations=F.count_if(status == "rejected"),
            )
        )
        .unionByName(counted(processed, processed_results=every))
        .unionByName(counted(levels, classified_levels=F.count_if(F.col("outcome") != "none")))
    )


def backlog(work: DataFrame, as_of: Column) -> DataFrame:
    """Unfinished work: counts per state, age of the oldest, last completion."""
    open_row = F.col("status").isin("pending", "processing", "failed")
    oldest = F.min(F.when(open_row, F.col("created_at")))
    return work.agg(
        F.count_if(open_row).alias("pending"),
        F.count_if(F.col("status") == "processing").alias("claimed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        oldest.alias("oldest_created_at"),
        F.greatest(
            F.coalesce(times.seconds_between(as_of, oldest), F.lit(0.0)), F.lit(0.0)
        ).alias("oldest_seconds"),
        F.max("completed_at").alias("last_completed_at"),
    )


def round_counts(rounds: DataFrame) -> DataFrame:
    active = F.col("active")
    return rounds.agg(
        F.count_if(active).alias("discovered"),
        F.count_if(active & (F.col("status") == "subscribed")).alias("subscribed"),
        F.count_if(active & (F.col("status") == "error")).alias("errors"),
    )


def competition_health(competitions: DataFrame, rounds: DataFrame) -> DataFrame:
    """Active competitions with their number of active rounds, by start date and slug."""
    active = rounds.where("active").groupBy("slug").agg(F.count(F.lit(1)).alias("_rounds"))
    return (
        competitions.where("active")
        .join(active, "slug", "left")
        .withColumn("active_rounds", F.coalesce("_rounds", F.lit(0)))
        .drop("_rounds")
        .orderBy("start_date", "slug")
    )


def summed_counters(rows: DataFrame, counters: str = "counters") -> DataFrame:
    """Sum of each counter over all rows."""
    return (
        rows.select(F.explode(counters).alias("counter", "_value"))
        .groupBy("counter")
        .agg(F.sum("_value").alias("total"))
    )


def queue_summary(rows: DataFrame) -> DataFrame:
    """Total and peak queue size, last capture and the first error by start date."""
    size = non_negative_int("queue_size")
    peak = non_negative_int("peak_queue_size")
    error = F.when(F.col("last_error") != "", F.struct("start_date", "slug", "last_error"))
    return rows.agg(
        F.sum(size).alias("queue_size"),
        F.max(peak).alias("peak_queue_size"),
        F.max("captured_at").alias("captured_at"),
        F.coalesce(F.min(error)["last_error"], F.lit("")).alias("last_error"),
    )


def worker_status(workers: DataFrame, detections: DataFrame, as_of: Column) -> DataFrame:
    """Each ingestion method with its state and number of detections."""
    methods = _literal_rows(workers.sparkSession, "method", list(fixed.EVIDENCE_RANK))
    found = detections.groupBy("method").agg(F.count(F.lit(1)).alias("_n"))
    rows = attach_lookup(attach_lookup(methods, workers, ["method"]), found, ["method"])
    return rows.withColumns(
        {
            "state": times.worker_state("is_running", "heartbeat_at", "last_stopped_at", "method", as_of),
            "observations": F.coalesce("_n", F.lit(0)),
            "connected": F.when(
                F.col("method") != fixed.POLLED, F.coalesce("connected", F.lit(False))
            ),
        }
    ).drop("_n")


def stale_workers(heartbeats: DataFrame, as_of: Column) -> DataFrame:
    """Last heartbeat per worker and whether it is stale."""
    last = heartbeats.groupBy("worker", "method").agg(F.max("at").alias("last_at"))
    age = times.seconds_between(as_of, "last_at")
    return last.withColumn("stale", age > times.stale_after_seconds("method"))


def counter_rates(samples: DataFrame, keys: Sequence[str], value: str, at: str = "at") -> DataFrame:
    """Increase per second between consecutive samples; 0 for the first one and after a reset."""
    rows = previous_row(samples, keys, [at], time_buckets(at), [value, at])
    elapsed = F.greatest(times.seconds_between(at, F.col("previous")[at]), F.lit(0.001))
    grown = F.col(value) - F.col("previous")[value]
    rate = F.when(F.coalesce(grown >= 0, F.lit(False)), grown / elapsed).otherwise(0.0)
    return rows.withColumn("rate", rate).drop("previous")


def queue_series(samples: DataFrame, width: str = "1 hour") -> DataFrame:
    """Largest queue size per window with its state."""
    rows = samples.groupBy(F.window("at", width).alias("_w")).agg(
        F.max("queue_size").alias("queue_size"), F.bool_or("connected").alias("connected")
    )
    return rows.select(
        F.col("_w.start").alias("window_start"),
        "queue_size",
        queue_state("connected", "queue_size").alias("state"),
    )


def snapshot_statistics(changes: DataFrame, rows: DataFrame, detections: DataFrame, frame: str) -> DataFrame:
    """Per frame: rows, additions, changes, removals, detections and withdrawals."""
    kinds = changes.groupBy(frame).agg(
        *[
            F.count_if(F.col("change") == kind).alias(f"{kind}s")
            for kind in ("addition", "change", "removal")
        ]
    )
    seen = detections.groupBy(frame).agg(
        F.count_if(F.col("status") == "active").alias("detected"),
        F.count_if(F.col("status") == "withdrawn").alias("withdrawn"),
    )
    total = rows.groupBy(frame).agg(F.count(F.lit(1)).alias("rows"))
    joined = total.join(kinds, frame, "full_outer").join(seen, frame, "left")
    return joined.na.fill(0)


def discovery_statistics(discovered: DataFrame, start: Column, end: Column) -> DataFrame:
    """Competitions fetched, overlapping, ready, pending and failed, and rounds found."""
    relevant = times.overlaps("start_date", "end_date", start, end)
    official = F.coalesce("official_id", F.lit("")) != ""
    failed = F.coalesce("detail_failed", F.lit(False))
    rounds = F.coalesce("round_count", F.lit(0))
    return discovered.agg(
        F.count(F.lit(1)).alias("fetched"),
        F.count_if(relevant).alias("overlapping"),
        F.count_if(relevant & official).alias("official"),
        F.count_if(relevant & ~failed & official & (rounds > 0)).alias("ready"),
        F.count_if(relevant & ~failed & official & (rounds == 0)).alias("pending"),
        F.count_if(relevant & failed).alias("failures"),
        F.coalesce(F.sum(F.when(relevant & ~failed, rounds)), F.lit(0)).alias("rounds"),
    )


def planned_backfill(observations: DataFrame, states: DataFrame) -> DataFrame:
    """Planned observations per (source, kind), and state rows without round metadata."""
    planned = observations.groupBy("source", "kind").agg(F.count(F.lit(1)).alias("planned"))
    missing = (
        states.where(F.col("active") & F.col("expected_attempts").isNull())
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("planned"))
        .withColumn("kind", F.lit("missing_metadata"))
    )
    return planned.unionByName(missing)
