"""Full snapshots of a round: what was added, changed or removed between two of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from laurel.functions.keys import content_hash
from laurel.operators.grouping import first_per_key


def with_hash(rows: DataFrame, fields: Sequence[str], name: str = "meaningful_hash") -> DataFrame:
    return rows.withColumn(name, content_hash(fields))


def diff(before: DataFrame, after: DataFrame, keys: Sequence[str], mark: str = "meaningful_hash") -> DataFrame:
    """Change per key between two snapshots; row order never matters."""
    old = before.select(*keys, F.col(mark).alias("_old"))
    new = after.select(*keys, F.col(mark).alias("_new"))
    change = (
        F.when(F.col("_old").isNull(), "addition")
        .when(F.col("_new").isNull(), "removal")
        .when(F.col("_old") != F.col("_new"), "change")
        .otherwise("unchanged")
    )
    return old.join(new, list(keys), "full_outer").select(*keys, change.alias("change"))


def snapshot_series(rows: DataFrame, keys: Sequence[str], step: str, mark: str) -> DataFrame:
    """Changes between consecutive snapshots ordered by ``step``, which may have gaps.

    Every snapshot is compared with the one of the step that exists before it, by one full outer join
    of the series with itself. The step before the first one counts as empty; removals after the last
    snapshot are not reported. The steps are a table of one row each.
    """
    later = Window.orderBy(step)
    steps = rows.select(step).distinct().withColumn("_after", F.lead(step).over(later))
    now = rows.select(*keys, step, F.col(mark).alias("_new"))
    before = (
        rows.join(steps, step)
        .where(F.col("_after").isNotNull())
        .select(*keys, F.col("_after").alias(step), F.col(mark).alias("_old"))
    )
    change = (
        F.when(F.col("_old").isNull(), "addition")
        .when(F.col("_new").isNull(), "removal")
        .when(F.col("_old") != F.col("_new"), "change")
    )
    return (
        now.join(before, [*keys, step], "full_outer")
        .withColumn("change", change)
        .where(F.col("change").isNotNull())
        .select(*keys, step, "change")
    )


def change_counts(changes: DataFrame, group: str) -> DataFrame:
    """Additions, changes and removals per snapshot."""
    return changes.groupBy(group).agg(
        *[
            F.count_if(F.col("change") == kind).alias(f"{kind}s")
            for kind in ("addition", "change", "removal")
        ]
    )


def distinct_frames(frames: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first frame of each content; ``keys`` name the source, method and content hash."""
    return first_per_key(frames, keys, order)


def distinct_runs(frames: DataFrame, stream: Sequence[str], mark: str, order: str) -> DataFrame:
    """Frames that differ from the frame before them, so a return to old content counts."""
    from laurel.operators.scan import number_buckets, previous_row

    rows = previous_row(frames, stream, [order], number_buckets(order), [mark])
    return rows.where(~F.col(mark).eqNullSafe(F.col(f"previous.{mark}"))).drop("previous")
