"""Alert, delivery and health queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from laurel.functions import fixed
from laurel.operators import alerts as al
from laurel.operators import health
from laurel.plans.catalog import query
from laurel.plans.tables import events, table

_AS_OF = "2024-01-31 00:00:00"


def _as_of():
    return F.lit(_AS_OF).cast("timestamp")


def _endpoints(spark, folder):
    """Each customer is an endpoint of the user with their nation's number."""
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("endpoint_id"),
        F.col("c_nationkey").alias("user_id"),
        (F.col("c_acctbal") > 0).alias("active"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=F.pmod("c_custkey", F.lit(720)).cast("int"))).alias("activated_at"),
    )


def _preferences(spark, folder):
    """Customers choose by segment; the users 0 to 9 chose for themselves."""
    own = table(spark, folder, "customer").where(
        F.col("c_mktsegment").isin("BUILDING", "MACHINERY")
    ).select(
        F.lit(None).cast("int").alias("user_id"),
        F.col("c_custkey").alias("endpoint_id"),
        F.lit("record_nr").alias("alert_type"),
        (F.col("c_mktsegment") == "BUILDING").alias("enabled"),
    )
    users = table(spark, folder, "nation").where(F.col("n_nationkey") < 10).select(
        F.col("n_nationkey").alias("user_id"),
        F.lit(None).cast("long").alias("endpoint_id"),
        F.lit("record_nr").alias("alert_type"),
        (F.col("n_nationkey") % 2 == 0).alias("enabled"),
    )
    return own.unionByName(users)


_RECIPIENTS = """rc AS (
  SELECT c_custkey AS endpoint_id, t.alert_type, TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (c_custkey % 720) AS activated_at
  FROM customer, (VALUES ('record_wr'), ('record_cr'), ('record_nr')) t(alert_type)
  WHERE c_acctbal > 0 AND (t.alert_type <> 'record_nr' OR coalesce(
    CASE WHEN c_nationkey < 10 THEN c_nationkey % 2 = 0 END,
    CASE c_mktsegment WHEN 'BUILDING' THEN true WHEN 'MACHINERY' THEN false END, true)))"""


@query("recipients", f"WITH {_RECIPIENTS} SELECT endpoint_id, alert_type FROM rc")
def recipients(spark, folder):
    return al.eligible_endpoints(_endpoints(spark, folder), _preferences(spark, folder)).select(
        "endpoint_id", "alert_type"
    )


_TYPE_SQL = "CASE event_type WHEN 'purchase' THEN 'record_wr' WHEN 'signup' THEN 'record_cr' ELSE 'record_nr' END"


@query(
    "delivery_fanout",
    f"""WITH {_RECIPIENTS}, al AS (SELECT min(event_id) AS alert_id, max(ts) AS created_at, {_TYPE_SQL} AS alert_type
        FROM events GROUP BY CAST(ts AS DATE), event_type)
    SELECT alert_id, count(*) AS deliveries, CAST(sum(endpoint_id) AS BIGINT) AS checksum FROM al JOIN rc USING (alert_type)
    WHERE activated_at <= created_at AND endpoint_id <> alert_id GROUP BY ALL""",
)
def delivery_fanout(spark, folder):
    """One alert per day and event type, to every recipient active by then and not yet served."""
    kind = (
        F.when(F.col("event_type") == "purchase", "record_wr")
        .when(F.col("event_type") == "signup", "record_cr")
        .otherwise("record_nr")
    )
    alerts = (
        events(spark, folder)
        .groupBy(F.to_date("ts"), "event_type")
        .agg(F.min("event_id").alias("alert_id"), F.max("ts").alias("created_at"))
        .select("alert_id", "created_at", kind.alias("alert_type"))
    )
    wanted = al.eligible_endpoints(_endpoints(spark, folder), _preferences(spark, folder))
    served = alerts.select("alert_id", F.col("alert_id").alias("endpoint_id"))
    return (
        al.fan_out(alerts, wanted, served)
        .groupBy("alert_id")
        .agg(F.count(F.lit(1)).alias("deliveries"), F.sum("endpoint_id").cast("long").alias("checksum"))
    )


@query(
    "alert_payloads",
    """SELECT o_orderkey, 'record:' || substr(sha256('record:processed:' || o_orderkey || ':1:CR'), 1, 32) AS tag,
      '3x3 ' || CASE r_name WHEN 'AFRICA' THEN 'AfR' WHEN 'ASIA' THEN 'AsR' WHEN 'EUROPE' THEN 'ER' ELSE 'CR' END || ' single: ' || o_orderstatus AS title,
      'By ' || c_name || ' from ' || n_name || ' at Open in ' || n_name AS body,
      CASE r_name WHEN 'AFRICA' THEN '/notification_icons/notification_icon_AfR.png' WHEN 'ASIA' THEN '/notification_icons/notification_icon_AsR.png'
        WHEN 'EUROPE' THEN '/notification_icons/notification_icon_ER.png' ELSE '/icons/icon-192.png' END AS icon
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
def alert_payloads(spark, folder):
    nation = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    rows = (
        table(spark, folder, "orders")
        .join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            "o_orderkey",
            F.col("o_orderkey").alias("canonical_id"),
            F.lit(1).alias("revision"),
            F.lit("CR").alias("level"),
            F.lit("333").alias("event_id"),
            F.lit("").alias("event_name"),
            F.lit("single").alias("kind"),
            F.col("o_orderstatus").alias("formatted"),
            F.col("c_name").alias("person_name"),
            F.initcap("r_name").alias("continent"),
            F.lit("").alias("country_display_name"),
            F.col("n_name").alias("country_code"),
            F.lit("Open").alias("competition_name"),
            F.lit("").alias("competition_country_name"),
            F.col("n_name").alias("competition_country"),
        )
    )
    return al.payloads(rows).select("o_orderkey", "tag", "title", "body", "icon")


def _attempts(spark, folder):
    """Events as push attempts: user = endpoint, (user, day) = delivery, type = response."""
    status = (
        F.when(F.col("event_type") == "purchase", 201)
        .when(F.col("event_type") == "view", 503)
        .when(F.col("event_type") == "click", 429)
        .when(F.col("event_type") == "signup", 403)
        .otherwise(F.when(F.col("value") > 60, 410).otherwise(500))
    )
    return events(spark, folder).select(
        F.col("event_id").alias("seq"),
        F.concat_ws("|", F.col("user_id").cast("string"), F.date_format("ts", "dd")).alias("delivery_id"),
        F.col("user_id").alias("endpoint_id"),
        F.col("ts").alias("at"),
        status.alias("http_status"),
    )


_ATTEMPTS = """at0 AS (SELECT event_id AS seq, user_id || '|' || strftime(ts, '%d') AS delivery_id, user_id AS endpoint_id, ts,
    CASE event_type WHEN 'purchase' THEN 201 WHEN 'view' THEN 503 WHEN 'click' THEN 429 WHEN 'signup' THEN 403
      ELSE CASE WHEN value > 60 THEN 410 ELSE 500 END END AS code FROM events),
cl AS (SELECT endpoint_id, min(seq) AS closed FROM at0 WHERE code = 410 GROUP BY ALL),
hp AS (SELECT a.*, closed, closed IS NULL OR seq <= closed AS happened FROM at0 a LEFT JOIN cl USING (endpoint_id)),
fd AS (SELECT delivery_id, endpoint_id, any_value(closed) AS closed, count(*) FILTER (WHERE happened) AS attempts,
    coalesce(bool_or(code = 201) FILTER (WHERE happened), false) AS sent,
    arg_max(code, seq) FILTER (WHERE happened) AS code, max(ts) FILTER (WHERE happened) AS last_ts FROM hp GROUP BY ALL)"""


@query(
    "delivery_fold",
    f"""WITH {_ATTEMPTS} SELECT delivery_id, endpoint_id, attempts,
      CASE WHEN sent THEN 'sent' WHEN closed IS NOT NULL OR attempts >= 5 THEN 'permanently_failed' ELSE 'retry' END AS status,
      CASE WHEN sent THEN '' WHEN closed IS NOT NULL THEN 'http_410' WHEN attempts >= 5 THEN 'maximum_attempts' ELSE 'http_' || code END AS last_error,
      CASE WHEN NOT sent AND closed IS NULL AND attempts < 5 THEN epoch_us(last_ts) + CAST(1000000 AS BIGINT) * CASE least(attempts, 4) WHEN 1 THEN 60 WHEN 2 THEN 300 WHEN 3 THEN 1800 ELSE 7200 END END AS next_attempt
    FROM fd""",
)
def delivery_fold(spark, folder):
    return al.fold_deliveries(_attempts(spark, folder)).select(
        "delivery_id",
        "endpoint_id",
        "attempts",
        "status",
        "last_error",
        F.unix_micros("next_attempt_at").alias("next_attempt"),
    )


@query(
    "endpoint_fold",
    f"""WITH {_ATTEMPTS}, h AS (SELECT *, max(CASE WHEN code = 201 THEN seq END) OVER (PARTITION BY endpoint_id) AS won FROM hp WHERE happened)
    SELECT endpoint_id, count(*) FILTER (WHERE seq > coalesce(won, -1)) AS failure_streak, max(closed) IS NULL AS active,
      CASE WHEN max(closed) IS NOT NULL THEN 'http_410' END AS deactivation_reason,
      epoch_us(max(ts) FILTER (WHERE code = 201)) AS last_success FROM h GROUP BY ALL""",
)
def endpoint_fold(spark, folder):
    return al.fold_endpoints(_attempts(spark, folder)).select(
        "endpoint_id",
        "failure_streak",
        "active",
        "deactivation_reason",
        F.unix_micros("last_success_at").alias("last_success"),
    )


@query(
    "outbox_fold",
    """WITH p AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events)
    SELECT user_id, min(event_id) AS created_seq, arg_max(event_type, event_id) AS formatted,
      count(*) FILTER (WHERE b IS NOT NULL AND b <> event_type AND value > 10) AS correction_count FROM p GROUP BY ALL""",
)
def outbox_fold(spark, folder):
    """Publications per user: repeats change nothing, changed facts after a send are corrections."""
    same = {c: F.lit("") for c in al.ANNOUNCED if c != "formatted"}
    rows = events(spark, folder).select(
        F.col("user_id").alias("deduplication_key"),
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("formatted"),
        (F.col("value") > 10).alias("sent_before"),
    ).withColumns(same | {"event_id": F.lit("333")})
    return al.fold_outbox(rows).select(
        F.col("deduplication_key").alias("user_id"), "created_seq", "formatted", "correction_count"
    )


@query(
    "status_counts_zero_fill",
    """SELECT s.status, count(e.event_type) AS count FROM (VALUES ('click'), ('view'), ('refund'), ('error'), ('signup'), ('purchase'), ('chargeback')) s(status)
    LEFT JOIN events e ON e.event_type = s.status GROUP BY ALL""",
)
def status_counts_zero_fill(spark, folder):
    rows = events(spark, folder).withColumnRenamed("event_type", "status")
    return health.counts_by_status(
        rows, ("click", "view", "refund", "error", "signup", "purchase", "chargeback")
    )


_QUEUE_STATUS = "CASE event_type WHEN 'view' THEN 'sent' WHEN 'click' THEN 'pending' WHEN 'error' THEN 'retry' ELSE 'cancelled' END"


@query(
    "delivery_health",
    f"""WITH d AS (SELECT *, {_QUEUE_STATUS} AS status FROM events)
    SELECT count(*) FILTER (WHERE status IN ('pending', 'retry')) AS queued,
      count(*) FILTER (WHERE status IN ('pending', 'retry') AND ts + INTERVAL 1 DAY <= TIMESTAMP '{_AS_OF}') AS due,
      epoch_us(min(ts) FILTER (WHERE status IN ('pending', 'retry'))) AS oldest,
      (epoch_us(TIMESTAMP '{_AS_OF}') - epoch_us(min(ts) FILTER (WHERE status IN ('pending', 'retry')))) / 1000000.0 AS oldest_queue_seconds,
      epoch_us(max(ts) FILTER (WHERE status = 'sent')) AS last_sent,
      count(*) FILTER (WHERE ts >= TIMESTAMP '{_AS_OF}' - INTERVAL 24 HOURS) AS last_day FROM d""",
)
def delivery_health(spark, folder):
    status = (
        F.when(F.col("event_type") == "view", "sent")
        .when(F.col("event_type") == "click", "pending")
        .when(F.col("event_type") == "error", "retry")
        .otherwise("cancelled")
    )
    rows = events(spark, folder).select(
        status.alias("status"),
        F.col("ts").alias("created_at"),
        F.col("ts").alias("sent_at"),
        (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("next_attempt_at"),
    )
    summary = health.delivery_health(rows, _as_of())
    return summary.select(
        "queued",
        "due",
        F.unix_micros("oldest_queued_at").alias("oldest"),
        "oldest_queue_seconds",
        F.unix_micros("last_sent_at").alias("last_sent"),
        "last_day",
    )


@query(
    "work_backlog",
    f"""WITH w AS (SELECT *, CASE event_type WHEN 'view' THEN 'completed' WHEN 'click' THEN 'pending' WHEN 'error' THEN 'failed' ELSE 'processing' END AS status FROM events)
    SELECT count(*) FILTER (WHERE status <> 'completed') AS pending, count(*) FILTER (WHERE status = 'processing') AS claimed,
      count(*) FILTER (WHERE status = 'failed') AS failed, epoch_us(max(ts) FILTER (WHERE status = 'completed')) AS last_completed FROM w""",
)
def work_backlog(spark, folder):
    status = (
        F.when(F.col("event_type") == "view", "completed")
        .when(F.col("event_type") == "click", "pending")
        .when(F.col("event_type") == "error", "failed")
        .otherwise("processing")
    )
    rows = events(spark, folder).select(
        status.alias("status"),
        F.col("ts").alias("created_at"),
        F.when(status == "completed", F.col("ts")).alias("completed_at"),
    )
    return health.backlog(rows, _as_of()).select(
        "pending", "claimed", "failed", F.unix_micros("last_completed_at").alias("last_completed")
    )


@query(
    "counter_rate",
    """WITH h AS (SELECT user_id, date_trunc('hour', ts) AS at_hour, count(*) AS n FROM events GROUP BY ALL),
    p AS (SELECT *, lag(n) OVER w AS pn, lag(at_hour) OVER w AS pt FROM h WINDOW w AS (PARTITION BY user_id ORDER BY at_hour))
    SELECT user_id, epoch_us(at_hour) AS at_micros, n, CASE WHEN pn IS NOT NULL AND n >= pn
      THEN (n - pn) / greatest((epoch_us(at_hour) - epoch_us(pt)) / 1000000.0, 0.001) ELSE 0.0 END AS rate FROM p""",
)
def counter_rate(spark, folder):
    samples = (
        events(spark, folder)
        .groupBy("user_id", F.date_trunc("hour", "ts").alias("at"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return health.counter_rates(samples, ["user_id"], "n").select(
        "user_id", F.unix_micros("at").alias("at_micros"), "n", "rate"
    )


@query(
    "queue_series",
    """SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_micros, max(user_id) AS queue_size,
      CASE WHEN NOT bool_or(event_type <> 'error') THEN 'neutral' WHEN max(user_id) >= 100 THEN 'critical' WHEN max(user_id) >= 25 THEN 'warning' ELSE 'healthy' END AS state
    FROM events GROUP BY 1""",
)
def queue_series(spark, folder):
    samples = events(spark, folder).select(
        F.col("ts").alias("at"),
        F.col("user_id").alias("queue_size"),
        (F.col("event_type") != "error").alias("connected"),
    )
    return health.queue_series(samples).select(
        F.unix_micros("window_start").alias("start_micros"), "queue_size", "state"
    )


@query(
    "stale_workers",
    f"""SELECT user_id AS worker, event_type AS method, epoch_us(max(ts)) AS last_micros,
      (epoch_us(TIMESTAMP '{_AS_OF}') - epoch_us(max(ts))) / 1000000.0 > 90 AS stale FROM events GROUP BY ALL""",
)
def stale_workers(spark, folder):
    beats = events(spark, folder).select(
        F.col("user_id").alias("worker"), F.col("event_type").alias("method"), F.col("ts").alias("at")
    )
    return health.stale_workers(beats, _as_of()).select(
        "worker", "method", F.unix_micros("last_at").alias("last_micros"), "stale"
    )


@query(
    "worker_status",
    f"""WITH m AS (SELECT *, CASE event_type WHEN 'purchase' THEN 'api_polling' WHEN 'signup' THEN 'graphql_subscription' WHEN 'view' THEN 'cubingchina_websocket' END AS method FROM events)
    SELECT method, 'unknown' AS state, count(*) AS observations, epoch_us(max(ts)) AS heartbeat FROM m WHERE method IS NOT NULL GROUP BY ALL""",
)
def worker_status(spark, folder):
    method = (
        F.when(F.col("event_type") == "purchase", fixed.POLLED)
        .when(F.col("event_type") == "signup", fixed.SUBSCRIBED)
        .when(F.col("event_type") == "view", fixed.SOCKET)
    )
    rows = events(spark, folder).withColumn("method", method).where(F.col("method").isNotNull())
    workers = rows.groupBy("method").agg(
        F.max("ts").alias("heartbeat_at"),
        F.lit(True).alias("is_running"),
        F.lit(None).cast("timestamp").alias("last_stopped_at"),
        F.lit(True).alias("connected"),
    )
    late = F.lit("2024-03-01").cast("timestamp")
    return health.worker_status(workers, rows, late).select(
        "method", "state", "observations", F.unix_micros("heartbeat_at").alias("heartbeat")
    )


@query(
    "summed_counters",
    """SELECT event_type AS counter, CAST(sum(user_id) AS BIGINT) AS total FROM events GROUP BY ALL""",
)
def summed_counters(spark, folder):
    rows = events(spark, folder).select(F.create_map("event_type", "user_id").alias("counters"))
    return health.summed_counters(rows)


@query(
    "competition_health",
    """SELECT strftime(o_orderdate, '%Y%m') AS slug, count(*) FILTER (WHERE o_orderstatus = 'O') AS active_rounds FROM orders GROUP BY ALL""",
)
def competition_health(spark, folder):
    orders = table(spark, folder, "orders").withColumn("slug", F.date_format("o_orderdate", "yyyyMM"))
    competitions = orders.groupBy("slug").agg(F.min("o_orderdate").alias("start_date")).withColumn("active", F.lit(True))
    targets = orders.select("slug", (F.col("o_orderstatus") == "O").alias("active"))
    return health.competition_health(competitions, targets).select("slug", "active_rounds")


@query(
    "discovery_statistics",
    """WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + 2 AS e, o_orderstatus = 'P' AS failed,
        o_orderpriority <> '5-LOW' AS official, CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE 2 END AS rounds FROM orders),
    r AS (SELECT *, s <= DATE '1998-12-31' AND e >= DATE '1998-01-01' AS rel FROM d)
    SELECT count(*) AS fetched, count(*) FILTER (WHERE rel) AS overlapping, count(*) FILTER (WHERE rel AND official) AS official,
      count(*) FILTER (WHERE rel AND official AND NOT failed AND rounds > 0) AS ready,
      count(*) FILTER (WHERE rel AND official AND NOT failed AND rounds = 0) AS pending,
      count(*) FILTER (WHERE rel AND failed) AS failures,
      CAST(sum(rounds) FILTER (WHERE rel AND NOT failed) AS BIGINT) AS rounds FROM r""",
)
def discovery_statistics(spark, folder):
    day = F.col("o_orderdate").cast("date")
    rows = table(spark, folder, "orders").select(
        day.alias("start_date"),
        F.date_add(day, 2).alias("end_date"),
        F.when(F.col("o_orderpriority") != "5-LOW", "X").otherwise("").alias("official_id"),
        (F.col("o_orderstatus") == "P").alias("detail_failed"),
        F.when(F.col("o_orderpriority") == "1-URGENT", 0).otherwise(2).alias("round_count"),
    )
    start, end = F.lit("1998-01-01").cast("date"), F.lit("1998-12-31").cast("date")
    return health.discovery_statistics(rows, start, end)
