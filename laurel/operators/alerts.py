"""Record alerts: which level to announce, to whom, and what became of each delivery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laurel.functions import fixed
from laurel.functions import status as st
from laurel.functions.text import alert_icon, alert_type, level_label, looked_up
from laurel.operators.feed import alert_eligible, level_rank
from laurel.operators.grouping import attach_group, attach_lookup

# An announced fact counts as corrected when one of these changes.
ANNOUNCED = (
    "level",
    "event_id",
    "formatted",
    "person_name",
    "country_code",
    "competition_name",
    "competition_country",
    "kind",
)


def first_eligible_level(levels: DataFrame) -> DataFrame:
    """The highest eligible level row per revision; only heads are announced."""
    chosen = (
        levels.where(F.col("is_head") & alert_eligible())
        .withColumn("_rank", level_rank())
    )
    rest = [c for c in levels.columns if c not in ("canonical_id", "revision")]
    return (
        chosen.groupBy("canonical_id", "revision")
        .agg(F.min_by(F.struct(*rest), "_rank").alias("_row"))
        .select("canonical_id", "revision", "_row.*")
        .select(*levels.columns)
    )


def deduplication_key(prefix: str = "record") -> Column:
    return F.concat_ws(
        ":",
        F.lit(prefix),
        F.lit("processed"),
        F.col("canonical_id").cast("string"),
        F.col("revision").cast("string"),
        F.col("level"),
    )


def payloads(rows: DataFrame, target_url: str = "/", test: bool = False) -> DataFrame:
    """Alert rows with key, type, title, body, tag and icon.

    ``rows`` carry ``continent, country_display_name`` of the competitor and
    ``competition_country_name`` of the place.
    """
    if not target_url.startswith("/") or target_url.startswith("//"):
        raise ValueError("Notification target must be a same-origin relative path")
    name = F.coalesce(looked_up(fixed.EVENT_SHORT_NAMES, "event_id"), "event_name")
    label = level_label("level", "continent")
    country = F.coalesce(F.nullif("country_display_name", F.lit("")), "country_code")
    place = F.coalesce(F.nullif("competition_country_name", F.lit("")), "competition_country")
    prefix = F.lit("[TEST] " if test else "")
    keyed = rows.withColumn("deduplication_key", deduplication_key("test" if test else "record"))
    return keyed.withColumns(
        {
            "alert_type": alert_type("level"),
            "title": F.concat(prefix, name, F.lit(" "), label, F.lit(" "), "kind", F.lit(": "), "formatted"),
            "body": F.concat(
                F.lit("By "),
                "person_name",
                F.lit(" from "),
                country,
                F.lit(" at "),
                "competition_name",
                F.lit(" in "),
                place,
            ),
            "target_url": F.lit(target_url),
            "tag": F.concat(F.lit("record:"), F.substring(F.sha2("deduplication_key", 256), 1, 32)),
            "icon": alert_icon("level", "continent"),
            "badge": F.lit("/icons/badge-96.png"),
        }
    )


def eligible_endpoints(endpoints: DataFrame, preferences: DataFrame) -> DataFrame:
    """(endpoint, alert type) pairs that want the alert.

    A user's explicit choice beats the endpoint's, which beats the default. ``preferences`` rows
    are owned by exactly one of ``user_id`` and ``endpoint_id``.
    """
    defaults = F.array(
        *[
            F.struct(F.lit(name).alias("alert_type"), F.lit(default).alias("_default"))
            for name, default in fixed.DEFAULT_PREFERENCES.items()
        ]
    )
    asked = endpoints.where("active").select("*", F.inline(defaults))

    def choices(owner: str, name: str) -> DataFrame:
        owned = preferences.where(F.col(owner).isNotNull())
        return owned.groupBy(owner, "alert_type").agg(F.bool_or("enabled").alias(name))

    rows = attach_lookup(asked, choices("user_id", "_by_user"), ["user_id", "alert_type"])
    rows = attach_lookup(rows, choices("endpoint_id", "_by_endpoint"), ["endpoint_id", "alert_type"])
    return rows.where(F.coalesce("_by_user", "_by_endpoint", "_default")).select(
        *endpoints.columns, "alert_type"
    )


RECIPIENTS_PER_CUT = 50_000


def fan_out(alerts: DataFrame, recipients: DataFrame, existing: DataFrame) -> DataFrame:
    """New deliveries: recipients active by the time of the alert and not yet served.

    Both sides are cut by a salt of the recipient, so the few alert types do not decide the
    parallelism: a type with many recipients has many cuts, over which its recipients are split and
    its alerts are repeated.
    """
    cuts = recipients.groupBy("alert_type").agg(
        (F.floor(F.count(F.lit(1)) / RECIPIENTS_PER_CUT) + 1).alias("_cuts")
    )
    many = attach_lookup(recipients, cuts, ["alert_type"])
    many = many.withColumn("_cut", F.pmod(F.xxhash64("endpoint_id"), "_cuts")).drop("_cuts")
    few = alerts.join(cuts, "alert_type")
    few = few.withColumn("_cut", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_cuts") - 1))).drop("_cuts")
    pairs = few.join(many, ["alert_type", "_cut"]).where(
        F.col("activated_at") <= F.col("created_at")
    )
    return (
        pairs.select("alert_id", "endpoint_id")
        .join(existing.select("alert_id", "endpoint_id"), ["alert_id", "endpoint_id"], "left_anti")
    )


def fold_outbox(published: DataFrame) -> DataFrame:
    """One outbox row per deduplication key from all publications of it, in ``seq`` order.

    Publishing the same fact again changes nothing. A changed fact replaces the payload; it
    counts as a correction when some delivery had been sent by then (``sent_before``).
    """
    from laurel.functions.keys import canonical_json
    from laurel.operators.scan import number_buckets, previous_row

    rows = previous_row(
        published.withColumn("_fact", canonical_json(ANNOUNCED)),
        ["deduplication_key"],
        ["seq"],
        number_buckets("seq"),
        ["_fact"],
    )
    changed = F.col("previous").isNotNull() & (F.col("previous._fact") != F.col("_fact"))
    late = changed & F.col("sent_before")
    rest = [c for c in published.columns if c not in ("deduplication_key", "seq", "sent_before")]
    return rows.groupBy("deduplication_key").agg(
        F.min("seq").alias("created_seq"),
        F.max_by(F.struct(*rest), "seq").alias("_row"),
        F.count_if(late).alias("correction_count"),
        F.max(F.when(late, F.col("seq"))).alias("last_correction_seq"),
    ).select("deduplication_key", "created_seq", "_row.*", "correction_count", "last_correction_seq")


def fold_deliveries(attempts: DataFrame, maximum: int = fixed.MAX_DELIVERY_ATTEMPTS) -> DataFrame:
    """State of each delivery after all its attempts.

    ``attempts``: ``seq, delivery_id, endpoint_id, at, http_status``. The first permanent failure
    closes an endpoint: later attempts do not happen and unsent deliveries fail with its error.
    """
    rows = attempts.withColumns(
        {"_class": st.delivery_outcome("http_status"), "_error": st.delivery_error("http_status")}
    )
    permanent = F.col("_class") == "permanent_endpoint_failure"
    rows = attach_group(
        rows,
        ["endpoint_id"],
        [F.min(F.when(permanent, F.struct("seq", F.col("_error").alias("error")))).alias("_closed")],
    )
    # Deliveries whose every attempt came after the closing were still open and fail with it.
    happened = F.coalesce(F.col("seq") <= F.col("_closed.seq"), F.lit(True))
    last = F.max_by(F.struct("_class", "_error", "at"), F.when(happened, F.col("seq")))
    folded = rows.groupBy("delivery_id", "endpoint_id").agg(
        F.count_if(happened).alias("attempts"),
        last.alias("_last"),
        F.bool_or(happened & (F.col("_class") == "success")).alias("_sent"),
        F.min("_closed").alias("_closed"),
    )
    exhausted = st.attempts_exhausted("attempts", maximum)
    state = (
        F.when(F.col("_sent"), "sent")
        .when(F.col("_closed").isNotNull() | exhausted, "permanently_failed")
        .otherwise("retry")
    )
    delay = F.make_dt_interval(secs=st.retry_delay_seconds("attempts"))
    return folded.select(
        "delivery_id",
        "endpoint_id",
        state.alias("status"),
        "attempts",
        F.when(F.col("_sent"), "")
        .when(F.col("_closed").isNotNull(), F.col("_closed.error"))
        .when(exhausted, "maximum_attempts")
        .otherwise(F.col("_last._error"))
        .alias("last_error"),
        F.when(state == "retry", F.col("_last.at") + delay).alias("next_attempt_at"),
    )


def fold_endpoints(attempts: DataFrame) -> DataFrame:
    """Failure streak, last success and closing of each endpoint."""
    rows = attempts.withColumn("_class", st.delivery_outcome("http_status"))
    success = F.col("_class") == "success"
    permanent = F.col("_class") == "permanent_endpoint_failure"
    rows = attach_group(
        rows, ["endpoint_id"], [F.min(F.when(permanent, F.col("seq"))).alias("_closed")]
    ).where(F.coalesce(F.col("seq") <= F.col("_closed"), F.lit(True)))
    rows = attach_group(
        rows, ["endpoint_id"], [F.max(F.when(success, F.col("seq"))).alias("_won")]
    )
    return rows.groupBy("endpoint_id").agg(
        F.count_if(F.col("seq") > F.coalesce("_won", F.lit(-1))).alias("failure_streak"),
        F.max(F.when(success, F.col("at"))).alias("last_success_at"),
        F.max(F.when(~success, F.col("at"))).alias("last_failure_at"),
        (F.max("_closed").isNull()).alias("active"),
        F.max(F.when(F.col("seq") == F.col("_closed"), st.delivery_error("http_status"))).alias(
            "deactivation_reason"
        ),
    )


def cancel_open(deliveries: DataFrame, error: str, message: str) -> DataFrame:
    """Cancel deliveries that are not final, at a recovery boundary."""
    open_row = F.col("status").isin(*fixed.OPEN_DELIVERY_STATUSES)
    return deliveries.withColumns(
        {
            "status": F.when(open_row, "cancelled").otherwise(F.col("status")),
            "last_error": F.when(open_row, error).otherwise(F.col("last_error")),
            "last_message": F.when(open_row, message).otherwise(F.col("last_message")),
        }
    )
