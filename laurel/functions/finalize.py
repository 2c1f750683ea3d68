"""Is a round result final, and which attempts a format expects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from laurel.functions.values import MOVES_EVENT, _col


def attempt_entered(attempt: Column) -> Column:
    """Unfinished positions are missing or 0; failed attempts are negative and count."""
    return F.coalesce(attempt != 0, F.lit(False))


def all_attempts_entered(attempts, expected) -> Column:
    attempts, expected = _col(attempts), F.coalesce(_col(expected), F.lit(0))
    count = F.greatest(expected, F.lit(1))
    first = F.slice(F.coalesce(attempts, F.array().cast("array<long>")), F.lit(1), count)
    return (expected > 0) & (F.size(first) == expected) & F.forall(first, attempt_entered)


def is_final(attempts, expected, cutoff_attempts, cutoff_value) -> Column:
    """No further attempt can legitimately be entered for this result."""
    expected = F.coalesce(_col(expected), F.lit(0))
    tries, limit = _col(cutoff_attempts), _col(cutoff_value)
    count = F.greatest(expected, F.lit(1))
    given = F.coalesce(_col(attempts).cast("array<long>"), F.array().cast("array<long>"))
    padded = F.slice(
        F.concat(given, F.array_repeat(F.lit(0).cast("long"), count)), F.lit(1), count
    )
    has_cutoff = F.coalesce(
        (tries > 0) & (tries < expected) & (limit > 0), F.lit(False)
    )
    safe_tries = F.when(has_cutoff, tries).otherwise(F.lit(1))
    opening = F.slice(padded, F.lit(1), safe_tries)
    rest = F.slice(padded, safe_tries + 1, count)
    missed_cutoff = (
        F.forall(opening, attempt_entered)
        & ~F.exists(opening, lambda a: (a > 0) & (a < limit))
        & ~F.exists(rest, attempt_entered)
    )
    return (expected > 0) & (
        F.forall(padded, attempt_entered) | (has_cutoff & F.coalesce(missed_cutoff, F.lit(False)))
    )


def expected_attempts(round_format) -> Column:
    """``a`` means five attempts, ``m`` three, a number itself; anything else none."""
    given = _col(round_format)
    text = F.lower(F.trim(F.when(F.coalesce(given, F.lit("")) == "", "a").otherwise(given)))
    return (
        F.when(text == "a", 5)
        .when(text == "m", 3)
        .otherwise(F.coalesce(text.try_cast("int"), F.lit(0)))
    )


def cutoff_rule(round_format, cutoff, event_id) -> Column:
    """Expected attempts and cutoff of the second source, whose cutoffs are in seconds."""
    given = F.coalesce(_col(round_format), F.lit(""))
    seconds = F.coalesce(_col(cutoff).cast("long"), F.lit(0).cast("long"))
    limit = F.when(seconds > 0, F.when(_col(event_id) == MOVES_EVENT, seconds).otherwise(seconds * 100))
    tries = F.when(F.lower(given).isin("", "a"), 2).otherwise(1)
    return F.struct(
        expected_attempts(round_format).alias("expected_attempts"),
        F.when(limit.isNotNull(), tries).alias("cutoff_attempts"),
        limit.alias("cutoff_value"),
    )


def claim_is_final(kind, value, attempts, expected, cutoff_attempts, cutoff_value, best, average) -> Column:
    """A polled claim counts when its row is final and its value is the final value."""
    kind = _col(kind)
    final_value = F.when(kind == "single", _col(best)).otherwise(_col(average))
    return F.coalesce(
        is_final(attempts, expected, cutoff_attempts, cutoff_value)
        & ((kind != "average") | all_attempts_entered(attempts, expected))
        & (final_value != 0)
        & (_col(value) == final_value),
        F.lit(False),
    )
