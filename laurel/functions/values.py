"""Encoded results: validity, order, decoding and display text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MULTI_EVENT = "333mbf"
MOVES_EVENT = "333fm"


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def is_complete(value) -> Column:
    return F.coalesce(_col(value) > 0, F.lit(False))


def comparison_key(value) -> Column:
    """Sortable key: incomplete results come last, lower positive values first."""
    value = _col(value)
    done = is_complete(value)
    return F.struct(
        F.when(done, 0).otherwise(1).alias("incomplete"),
        F.when(done, value).otherwise(0).alias("value"),
    )


def is_better(candidate, incumbent) -> Column:
    candidate, incumbent = _col(candidate), _col(incumbent)
    return is_complete(candidate) & (~is_complete(incumbent) | (candidate < incumbent))


def outcome(value, incumbent) -> Column:
    value, incumbent = _col(value), _col(incumbent)
    return (
        F.when(incumbent.isNull() | (value < incumbent), "broken")
        .when(value == incumbent, "tied")
        .otherwise("none")
    )


def _div(value: Column, by: int) -> Column:
    """Integer division of a non-negative long."""
    return F.call_function("div", value, F.lit(by))


def decode_multi(value) -> Column:
    """Packed multi-attempt value as solved, attempted and centiseconds."""
    value = _col(value).cast("long")
    missed = value % 100
    seconds = _div(value, 100) % 100_000
    points = F.lit(99) - _div(value, 10_000_000) % 100
    valid = value > 0
    return F.struct(
        F.when(valid, points + missed).otherwise(0).cast("int").alias("solved"),
        F.when(valid, points + missed * 2).otherwise(0).cast("int").alias("attempted"),
        F.when(valid & (seconds != 99_999), seconds * 100).cast("int").alias("centiseconds"),
    )


def clock(centiseconds) -> Column:
    value = _col(centiseconds).cast("long")
    hours, rest = _div(value, 360_000), value % 360_000
    minutes, rest = _div(rest, 6_000), rest % 6_000
    seconds, hundredths = _div(rest, 100), rest % 100
    return (
        F.when(value.isNull(), "")
        .when(
            hours > 0, F.format_string("%d:%02d:%02d.%02d", hours, minutes, seconds, hundredths)
        )
        .when(minutes > 0, F.format_string("%d:%02d.%02d", minutes, seconds, hundredths))
        .otherwise(F.format_string("%d.%02d", seconds, hundredths))
    )


def _moves_average(value: Column) -> Column:
    whole, part = _div(value, 100), value % 100
    return (
        F.when(part == 0, F.format_string("%d.0", whole))
        .when(part % 10 == 0, F.format_string("%d.%d", whole, _div(part, 10)))
        .otherwise(F.format_string("%d.%02d", whole, part))
    )


def format_result(event_id, kind, value) -> Column:
    event_id, kind, value = _col(event_id), _col(kind), _col(value).cast("long")
    multi = decode_multi(value)
    multi_clock = F.regexp_replace(clock(multi["centiseconds"]), r"\.00$", "")
    return (
        F.when(value.isNull() | (value == 0), "")
        .when(value == -1, "DNF")
        .when(value == -2, "DNS")
        .when(value < 0, "Invalid")
        .when(
            event_id == MULTI_EVENT,
            F.trim(F.format_string("%d/%d %s", multi["solved"], multi["attempted"], multi_clock)),
        )
        .when((event_id == MOVES_EVENT) & (kind == "average"), _moves_average(value))
        .when(event_id == MOVES_EVENT, value.cast("string"))
        .otherwise(clock(value))
    )
