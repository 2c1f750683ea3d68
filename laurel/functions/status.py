"""Trust, validity and delivery states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from laurel.functions import fixed
from laurel.functions.text import looked_up
from laurel.functions.values import _col, is_complete


def trust_rank(method) -> Column:
    return F.coalesce(looked_up(fixed.EVIDENCE_RANK, method), F.lit(0))


def is_trusted(method) -> Column:
    return _col(method).isin(*fixed.TRUSTED_METHODS)


def supported_event(event_id, kind) -> Column:
    event_id = _col(event_id)
    return F.coalesce(
        F.when(_col(kind) == "single", event_id.isin(*fixed.SINGLE_EVENTS)).otherwise(
            event_id.isin(*fixed.AVERAGE_EVENTS)
        ),
        F.lit(False),
    )


def revision_is_valid(action, status, validation_status, value) -> Column:
    return (
        (_col(action) != "retracted")
        & (_col(status) != "retracted")
        & (_col(validation_status) != "rejected")
        & is_complete(value)
    )


def invalidity_reason(action, valid) -> Column:
    return (
        F.when(_col(action) == "retracted", "retracted_result")
        .when(~_col(valid), "invalid_canonical_result")
        .otherwise("")
    )


def evidence_status(trusted_low, trusted_high) -> Column:
    """Validation from the lowest and highest value among trusted, active observations."""
    low, high = _col(trusted_low), _col(trusted_high)
    return F.struct(
        F.when(low != high, "rejected").when(low.isNotNull(), "verified").otherwise("pending").alias("status"),
        F.when(low != high, "trusted_source_disagreement")
        .when(low.isNotNull(), "trusted_source_observation")
        .otherwise("untrusted_source_only")
        .alias("reason"),
    )


def delivery_outcome(http_status) -> Column:
    """Class of a push response; a null status means the request could not be built."""
    code = _col(http_status)
    return (
        F.when(code.between(200, 299), "success")
        .when(code.isin(404, 410), "permanent_endpoint_failure")
        .when((code == 429) | code.between(500, 599), "transient_failure")
        .when(code.isin(401, 403, 413), "application_failure")
        .when(code.between(400, 499), "permanent_endpoint_failure")
        .otherwise("application_failure")
    )


def delivery_error(http_status) -> Column:
    code = _col(http_status)
    return (
        F.when(code.between(200, 299), "")
        .when(code.between(400, 599), F.concat(F.lit("http_"), code.cast("string")))
        .otherwise("webpush_configuration")
    )


def retry_delay_seconds(attempt, schedule: tuple[int, ...] = fixed.RETRY_DELAYS_SECONDS) -> Column:
    """Delay before the next try (without random jitter); the last step repeats."""
    delays = F.array(*[F.lit(s) for s in (schedule or (60,))])
    position = F.least(F.greatest(_col(attempt), F.lit(1)), F.size(delays))
    return F.element_at(delays, position.cast("int"))


def attempts_exhausted(attempt, maximum: int = fixed.MAX_DELIVERY_ATTEMPTS) -> Column:
    return _col(attempt) >= maximum


def competition_country(explicit, venues) -> Column:
    venue = F.get(_col(venues), F.lit(0))["country"]["iso2"]
    return F.coalesce(F.nullif(_col(explicit), F.lit("")), venue, F.lit(""))


def merged_preferences(explicit) -> Column:
    """Explicit choices over the defaults; unknown alert types are dropped."""
    given = _col(explicit)
    return F.map_from_entries(
        F.array(
            *[
                F.struct(F.lit(name), F.coalesce(F.try_element_at(given, F.lit(name)), F.lit(default)))
                for name, default in fixed.DEFAULT_PREFERENCES.items()
            ]
        )
    )


def unknown_preferences(explicit) -> Column:
    known = F.array(*[F.lit(n) for n in fixed.DEFAULT_PREFERENCES])
    return F.array_sort(F.array_except(F.map_keys(_col(explicit)), known))


def non_negative_int(text) -> Column:
    return F.greatest(F.coalesce(_col(text).try_cast("long"), F.lit(0).cast("long")), F.lit(0).cast("long"))


def queue_state(connected, size) -> Column:
    size = F.coalesce(_col(size), F.lit(0))
    return (
        F.when(~F.coalesce(_col(connected), F.lit(False)), "neutral")
        .when(size >= 100, "critical")
        .when(size >= 25, "warning")
        .otherwise("healthy")
    )
