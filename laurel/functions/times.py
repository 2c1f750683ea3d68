"""Dates, zones, windows, ages and strict parsing."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from laurel.functions.values import _col


def classification_instant(entered_at, first_observed_at) -> Column:
    return F.coalesce(_col(entered_at), _col(first_observed_at))


def local_date(instant, zone, zone_known) -> Column:
    """Calendar date in ``zone``; null unless ``zone_known`` (an unknown zone would raise)."""
    safe = F.when(_col(zone_known), _col(zone)).otherwise("UTC")
    return F.when(_col(zone_known), F.to_date(F.from_utc_timestamp(_col(instant), safe)))


def zone_resolution(zone, resolved_date) -> Column:
    """How the competition zone was resolved, as status and reason."""
    missing = F.coalesce(_col(zone), F.lit("")) == ""
    invalid = _col(resolved_date).isNull()
    return F.struct(
        F.when(missing | invalid, "unresolved").otherwise("resolved").alias("status"),
        F.when(missing, "missing_or_ambiguous_source_timezone")
        .when(invalid, "invalid_source_timezone")
        .otherwise("provider_supplied_iana_timezone")
        .alias("reason"),
    )


def weekend_window(day) -> Column:
    """Wednesday to Tuesday around ``day``."""
    day = _col(day)
    start = F.date_sub(day, F.pmod(F.weekday(day) - 2, F.lit(7)))
    return F.struct(start.alias("start"), F.date_add(start, 6).alias("end"))


def weekend_window_of_instant(instant, zone: str) -> Column:
    return weekend_window(F.to_date(F.from_utc_timestamp(_col(instant), zone)))


def resolve_weekend_window(start: str, end: str, day) -> Column:
    """An explicit pair of ISO dates, or the rolling window when both are empty."""
    if bool(start) != bool(end):
        raise ValueError("weekend start and end must both be provided")
    if not start:
        return weekend_window(day)
    first, last = date.fromisoformat(start), date.fromisoformat(end)
    if last < first:
        raise ValueError("weekend end must be on or after start")
    return F.struct(F.lit(first).alias("start"), F.lit(last).alias("end"))


def overlaps(start, end, window_start, window_end) -> Column:
    return (_col(start) <= _col(window_end)) & (_col(end) >= _col(window_start))


def lookback_start(window_start, days: int) -> Column:
    return F.date_sub(_col(window_start), max(days, 0))


def discovery_window(as_of, lookback_days: int = 1, lookahead_days: int = 7) -> Column:
    return F.struct(
        F.date_sub(_col(as_of), max(lookback_days, 0)).alias("start"),
        F.date_add(_col(as_of), max(lookahead_days, 0)).alias("end"),
    )


def collectable_until(end_date, grace_minutes: int = 720) -> Column:
    """Midnight after the last day plus a grace period."""
    midnight = F.date_add(_col(end_date), 1).cast("timestamp")
    return midnight + F.make_dt_interval(mins=F.lit(grace_minutes))


def is_collectable(end_date, as_of, grace_minutes: int = 720) -> Column:
    return _col(as_of) <= collectable_until(end_date, grace_minutes)


def compact_date_range(text) -> Column:
    """``2026-08-09``, ``2026-08-09~10``, ``2026-08-30~09-02`` or two full dates."""
    text = _col(text)
    cut = F.instr(text, "~")
    first, last = F.trim(F.substring_index(text, "~", 1)), F.when(cut > 0, F.trim(F.substr(text, cut + 1)))
    full = (
        F.when(last.isNull(), first)
        .when(last.rlike(r"^\d{2}$"), F.concat(F.substring(first, 1, 8), last))
        .when(last.rlike(r"^\d{2}-\d{2}$"), F.concat(F.substring(first, 1, 5), last))
        .otherwise(last)
    )
    return F.struct(first.try_cast("date").alias("start"), full.try_cast("date").alias("end"))


def seconds_between(later, earlier) -> Column:
    """Difference in seconds with microsecond precision."""
    return (F.unix_micros(_col(later)) - F.unix_micros(_col(earlier))) / F.lit(1_000_000.0)


def _whole(seconds: Column, unit: int) -> Column:
    return F.call_function("div", seconds, F.lit(unit))


def _age_seconds(at, as_of) -> Column:
    micros = F.unix_micros(_col(as_of)) - F.unix_micros(_col(at))
    return F.greatest(F.call_function("div", micros, F.lit(1_000_000)), F.lit(0).cast("long"))


def age_text(at, as_of) -> Column:
    """Minutes, then hours with minutes below six hours, then hours, then days with hours."""
    seconds = _age_seconds(at, as_of)
    minutes, hours = _whole(seconds, 60), _whole(seconds, 3600)
    return (
        F.when(minutes < 60, F.format_string("%dm ago", minutes))
        .when(hours < 6, F.format_string("%dh%dm ago", hours, minutes % 60))
        .when(hours < 24, F.format_string("%dh ago", hours))
        .otherwise(F.format_string("%dd%dh ago", _whole(hours, 24), hours % 24))
    )


def compact_age_text(at, as_of) -> Column:
    seconds = _age_seconds(at, as_of)
    days = _whole(seconds, 86_400)
    return (
        F.when(seconds < 60, F.format_string("%ds ago", seconds))
        .when(seconds < 3_600, F.format_string("%dm ago", _whole(seconds, 60)))
        .when(seconds < 86_400, F.format_string("%dh ago", _whole(seconds, 3_600)))
        .when(days < 7, F.format_string("%dd ago", days))
        .otherwise(F.format_string("%dw ago", _whole(days, 7)))
    )


def is_recent(at, as_of, hours: int = 96) -> Column:
    return seconds_between(as_of, at) < hours * 3600


def freshness(finished_at, as_of, stale_hours: int) -> Column:
    finished = _col(finished_at)
    return (
        F.when(finished.isNull(), "not_yet_synchronised")
        .when(seconds_between(as_of, finished) > stale_hours * 3600, "stale")
        .otherwise("fresh")
    )


def stale_after_seconds(method, poll_interval_seconds: int = 60) -> Column:
    from laurel.functions.fixed import POLLED

    return F.when(_col(method) == POLLED, max(poll_interval_seconds * 3, 180)).otherwise(90)


def worker_state(is_running, heartbeat_at, stopped_at, method, as_of) -> Column:
    fresh = F.coalesce(
        seconds_between(as_of, heartbeat_at) <= stale_after_seconds(method), F.lit(False)
    )
    running = F.coalesce(_col(is_running), F.lit(False))
    return (
        F.when(~running & _col(stopped_at).isNotNull(), "stopped")
        .when(running & fresh, "running")
        .otherwise("unknown")
    )


_OFFSET = r"(Z|[+-]\d{2}(:?\d{2})?)$"


def strict_instant(text) -> Column:
    """Timestamp of an ISO text that names its offset; null for blank or invalid text."""
    text = _col(text)
    return F.when(text.rlike(_OFFSET), F.try_to_timestamp(text))


def instant_is_invalid(text) -> Column:
    text = F.coalesce(_col(text), F.lit(""))
    return (text != "") & strict_instant(text).isNull()


def iso_date(text) -> Column:
    text = _col(text)
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))


def single_venue_zone(venues) -> Column:
    """Only a single venue settles the zone of a competition."""
    venues = _col(venues)
    return F.coalesce(F.when(F.size(venues) == 1, F.get(venues, F.lit(0))["timezone"]), F.lit(""))
