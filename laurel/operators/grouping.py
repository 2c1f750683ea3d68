"""Per-group values for every row, latest rows and global ranks, all safe for hot groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laurel.session import stage


def attach_lookup(df: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left-join ``table``, which has one row per ``keys``.

    A hot key is skewed on the left side only. Adaptive execution splits such a partition of the
    left side and pairs every piece with the single right row (``session.RUNTIME_SETTINGS``), and
    it broadcasts ``table`` only when its measured size is below the broadcast threshold.
    """
    return df.join(table, list(keys), "left")


def attach_group(df: DataFrame, keys: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    """Add group aggregates to every row: combined map-side, then looked up.

    Unlike a window over ``keys`` this never sorts a whole group in one task. Keys must not be
    null.
    """
    return attach_lookup(df, df.groupBy(*keys).agg(*aggregates), keys)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the greatest ``order`` per key, by a map-side combined ``max_by``."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def upsert(
    current: DataFrame,
    incoming: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    first_seen: str | None = None,
) -> DataFrame:
    """Merge rows by key: the latest row wins, the earliest ``first_seen`` is kept."""
    both = current.unionByName(incoming)
    rest = [c for c in both.columns if c not in keys]
    aggregates = [F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")]
    if first_seen:
        aggregates.append(F.min(first_seen).alias("_first"))
    merged = both.groupBy(*keys).agg(*aggregates).select(*keys, "_row.*", *(["_first"] if first_seen else []))
    if first_seen:
        merged = merged.withColumn(first_seen, F.col("_first")).drop("_first")
    return merged.select(*both.columns)


def global_rank(
    df: DataFrame, order: Sequence[str], name: str = "rank", partitions: int | None = None
) -> DataFrame:
    """1-based position in one global order without a single-task sort.

    Rows are staged (their ranges are sampled first, which must not make them twice), then
    range-partitioned and staged again, so partition numbers are fixed; each partition is
    numbered on its own and shifted by the rows of the partitions before it (a table with one
    row per partition). ``order`` must be unique.
    """
    count = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stage(
        stage(df).repartitionByRange(count, *order).withColumn("_part", F.spark_partition_id())
    )
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, (inside + F.col("_offset")).cast("long"))
        .drop("_part", "_offset")
    )


def top_per_group(
    df: DataFrame, group: str, limits: dict[str, int], order: Sequence[Column]
) -> DataFrame:
    """The first ``limits[g]`` rows of each group ``g``.

    Each group is one top-k (a bounded result from every task), so no group is sorted whole.
    """
    parts = [
        df.where(F.col(group) == value).orderBy(*order).limit(limit)
        for value, limit in limits.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    inside = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return out.withColumn("position", inside.cast("long"))
