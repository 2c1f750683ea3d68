"""Ordered scans that never put one key's rows into one task.

``prefix_scan`` gives every row an aggregate over the *earlier* rows of its key (running
minimum, running sum, last non-null value). A plain window would sort a whole key in one task;
here a long key is cut into buckets that follow the order, buckets are pre-aggregated map-side, the
carry into each bucket is computed on the small bucket table, and only the rows of one finest
bucket meet in a task. The rows themselves are shuffled once. Short keys need no buckets: a window
over one of them meets at most ``SHORT`` rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_EARLIER = (Window.unboundedPreceding, -1)
# Keys are counted in this many hash groups; a group with more rows than ``SHORT`` is cut into buckets.
_GROUPS = 1 << 14
SHORT = 1 << 18


def _group(keys: Sequence[str]) -> Column:
    return F.pmod(F.hash(*keys), F.lit(_GROUPS))


def long_groups(df: DataFrame, keys: Sequence[str]) -> list[int]:
    """The hash groups of ``keys`` that hold more than ``SHORT`` rows of ``df``: at most one per ``SHORT`` rows.

    Counts all rows at once, combined map-side; the driver gets only the groups found.
    """
    counts = df.groupBy(_group(keys).alias("_g")).agg(F.count(F.lit(1)).alias("_n"))
    return sorted(r["_g"] for r in counts.where(F.col("_n") > SHORT).select("_g").collect())


def in_groups(keys: Sequence[str], groups: Sequence[int]) -> Column:
    return _group(keys).isin(*groups) if groups else F.lit(False)


def time_buckets(at: str) -> list[Column]:
    """One bucket per minute: a key has at most 525,600 buckets a year, however many rows."""
    return [F.date_trunc("minute", F.col(at))]


def instant_buckets(at: str, ident: str) -> list[Column]:
    """For coarse instants (such as whole days): months, then 2^20 ids inside one instant."""
    return [
        F.date_trunc("month", F.col(at)),
        F.struct(F.col(at), F.shiftright(F.col(ident).cast("long"), 20)),
    ]


def number_buckets(column: str) -> list[Column]:
    """Blocks of 65,536 consecutive numbers, so neither a block nor a key's blocks grow large."""
    return [F.shiftright(F.col(column).cast("long"), 16)]


def _partial(kind: str, value: Column, order: Column, descending: bool) -> Column:
    if kind == "min":
        return F.min(value)
    if kind == "max":
        return F.max(value)
    if kind == "sum":
        return F.sum(value)
    if kind == "last":
        pick = F.min_by if descending else F.max_by
        return pick(value, F.when(value.isNotNull(), order))
    raise ValueError(f"Unknown scan kind {kind!r}")


def _within(kind: str, value: Column, window) -> Column:
    if kind == "last":
        return F.last(value, ignorenulls=True).over(window)
    return {"min": F.min, "max": F.max, "sum": F.sum}[kind](value).over(window)


def _combine(kind: str, outer: Column, inner: Column) -> Column:
    if kind == "last":
        return F.coalesce(inner, outer)
    if kind == "sum":
        return F.coalesce(outer, F.lit(0)) + F.coalesce(inner, F.lit(0))
    return F.least(outer, inner) if kind == "min" else F.greatest(outer, inner)


def prefix_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    buckets: Sequence[Column],
    carry: Mapping[str, tuple[str, Column]],
    descending: bool = False,
    within: tuple[Sequence[str], Sequence[int]] | None = None,
) -> DataFrame:
    """Add, for each ``carry`` entry ``name: (kind, value)``, its value over earlier rows.

    ``order`` must be a total order within ``keys`` and every bucket must rise with it. With
    ``descending`` the scan runs from the last row, so "earlier" means later rows. Keys and
    buckets must not be null.

    ``within`` is some or all of ``keys`` and their ``long_groups`` in ``df``, for callers that scan
    the same rows several times; otherwise the rows are counted here.
    """
    keys = list(keys)
    names = [f"_b{i}" for i in range(len(buckets))]
    inputs = {f"_v_{name}": value for name, (_, value) in carry.items()}
    kinds = {name: kind for name, (kind, _) in carry.items()}

    def directed(columns: Sequence[str]) -> list[Column]:
        return [F.col(c).desc() if descending else F.col(c).asc() for c in columns]

    counted, groups = within or (keys, long_groups(df, keys))
    if not groups:
        window = Window.partitionBy(*keys).orderBy(*directed(order)).rowsBetween(*_EARLIER)
        out = {name: _within(kind, value, window) for name, (kind, value) in carry.items()}
        out |= {name: F.coalesce(out[name], F.lit(0)) for name, kind in kinds.items() if kind == "sum"}
        return df.select(*df.columns, *[value.alias(name) for name, value in out.items()])

    # Only long keys have buckets; the rows of a short one share the null bucket, which nothing is carried into.
    cut = in_groups(counted, groups)
    rows = df.withColumns({**{n: F.when(cut, b) for n, b in zip(names, buckets)}, **inputs})
    row_order = F.struct(*order)
    finest = rows.where(cut).groupBy(*keys, *names).agg(
        *[
            _partial(kind, F.col(f"_v_{name}"), row_order, descending).alias(f"_p_{name}")
            for name, kind in kinds.items()
        ]
    )
    tables = [finest]
    for depth in range(len(names) - 1, 0, -1):
        tables.insert(
            0,
            tables[0]
            .groupBy(*keys, *names[:depth])
            .agg(
                *[
                    _partial(
                        kind, F.col(f"_p_{name}"), F.col(names[depth]), descending
                    ).alias(f"_p_{name}")
                    for name, kind in kinds.items()
                ]
            ),
        )

    carried: DataFrame | None = None
    for depth, table in enumerate(tables):
        group = keys + names[:depth]
        window = (
            Window.partitionBy(*group).orderBy(*directed([names[depth]])).rowsBetween(*_EARLIER)
        )
        if carried is not None:
            table = table.join(carried, group, "left")
        columns = []
        for name, kind in kinds.items():
            inner = _within(kind, F.col(f"_p_{name}"), window)
            if carried is not None:
                inner = _combine(kind, F.col(f"_c_{name}"), inner)
            columns.append(inner.alias(f"_c_{name}"))
        carried = table.select(*group, names[depth], *columns)

    # What is carried into a bucket comes as a row before all of its rows, so they meet in one shuffle.
    group = keys + names
    window = Window.partitionBy(*group).orderBy(F.col("_carried").desc(), *directed(order)).rowsBetween(*_EARLIER)
    carries = carried.select(*group, *[F.col(f"_c_{name}").alias(f"_v_{name}") for name in kinds], F.lit(True).alias("_carried"))
    rows = rows.withColumn("_carried", F.lit(False)).unionByName(carries, allowMissingColumns=True)
    out = {name: _within(kind, F.col(f"_v_{name}"), window) for name, kind in kinds.items()}
    out |= {name: F.coalesce(out[name], F.lit(0)) for name, kind in kinds.items() if kind == "sum"}
    scanned = rows.select(*df.columns, "_carried", *[value.alias(name) for name, value in out.items()])
    return scanned.where(~F.col("_carried")).drop("_carried")


def previous_row(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    buckets: Sequence[Column],
    columns: Sequence[str],
    name: str = "previous",
    following: bool = False,
    within: tuple[Sequence[str], Sequence[int]] | None = None,
) -> DataFrame:
    """Add a struct of ``columns`` from the previous (or following) row of the key."""
    return prefix_scan(
        df,
        keys,
        order,
        buckets,
        {name: ("last", F.struct(*columns))},
        descending=following,
        within=within,
    )
