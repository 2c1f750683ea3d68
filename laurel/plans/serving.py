"""Feed, comparison, validation, value and snapshot queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from laurel.functions import finalize, fixed, keys, times, values
from laurel.functions.text import record_tag, split_native_name
from laurel.operators import benchmarks, compare, detections, feed, snapshots, timeline
from laurel.operators.baseline import baseline_cells
from laurel.operators.grouping import latest_per_key, upsert
from laurel.plans.catalog import query
from laurel.plans.tables import JUDGED, LEVELS, RES, baseline, events, live_results, members, replayed, results, table
from laurel.session import stage

# --- feed -------------------------------------------------------------------------------------

_FEED = (
    JUDGED
    + """,
lvls AS (
  SELECT *, CASE level WHEN 'WR' THEN 0 WHEN 'CR' THEN 1 WHEN 'NR' THEN 2 ELSE 3 END AS rk FROM j),
ok AS (
  SELECT *, round_number <> 3 OR value <= 20 AS verified FROM lvls)"""
)


def _levels(spark, folder):
    """Judged level rows; rounds 1 and 2 are trusted, round 3 needs an independent verdict."""
    rows = replayed(spark, folder)
    judged = timeline.adjudicate_qualifying(stage(rows.where(F.col("outcome") != "none")))
    trusted = F.col("round_number") != 3
    return judged.withColumns(
        {
            "is_valid": F.lit(True),
            "is_head": F.lit(True),
            "validation_status": F.when(trusted, "verified").otherwise("pending"),
            "validation_reason": F.when(trusted, "trusted_source_observation").otherwise(
                "untrusted_source_only"
            ),
        }
    )


def _verdicts(spark, folder):
    """Independent verdicts: values up to 20 are confirmed at every level."""
    return members(spark, folder).select(
        "canonical_id",
        "level",
        "value",
        F.when(F.col("value") <= 20, "verified").otherwise("rejected").alias("validation"),
    )


def _feed_rows(spark, folder, level=None, text=""):
    return feed.record_feed(_levels(spark, folder), _verdicts(spark, folder), level, text)


_NATIONAL = """
  SELECT n.canonical_id, n.event_id, n.kind, n.scope, n.value, n.outcome FROM ok n
  WHERE n.level = 'NR' AND n.recognition = 'recognized' AND n.verified AND NOT EXISTS (
    SELECT 1 FROM ok h WHERE h.canonical_id = n.canonical_id AND h.rk < n.rk AND h.recognition = 'recognized')"""


@query("record_feed", f"WITH {_FEED} {_NATIONAL}")
def record_feed(spark, folder):
    """National records shown once, at their highest level."""
    return _feed_rows(spark, folder, "NR").select(
        "canonical_id", "event_id", "kind", "scope", "value", "outcome"
    )


@query(
    "record_feed_all_levels",
    f"""WITH {_FEED} SELECT canonical_id, level, scope, value FROM ok
    WHERE recognition = 'recognized' AND verified""",
)
def record_feed_all_levels(spark, folder):
    return _feed_rows(spark, folder).select("canonical_id", "level", "scope", "value")


@query(
    "highest_level",
    f"""WITH {_FEED} SELECT canonical_id, arg_min(level, rk) AS level FROM ok
    WHERE recognition = 'recognized' AND verified AND level <> 'PR' GROUP BY ALL""",
)
def highest_level(spark, folder):
    """The level to announce per result: the highest one that is eligible."""
    from laurel.operators.alerts import first_eligible_level

    rows = feed.mark_verified(_levels(spark, folder), _verdicts(spark, folder))
    return first_eligible_level(rows).select("canonical_id", "level")


@query(
    "feed_topk",
    f"""WITH {_FEED} SELECT level, position, canonical_id FROM (
      SELECT level, canonical_id, row_number() OVER (PARTITION BY level ORDER BY tm DESC, canonical_id DESC) AS position
      FROM ok WHERE recognition = 'recognized' AND verified AND level <> 'PR')
    WHERE position <= CASE level WHEN 'NR' THEN 13 ELSE 6 END""",
)
def feed_topk(spark, folder):
    rows = stage(
        _feed_rows(spark, folder).select("level", "canonical_id", "at")
    )
    return feed.level_top_lists(rows).select("level", "position", "canonical_id")


@query(
    "feed_page",
    f"""WITH {_FEED} SELECT canonical_id, level, value FROM ok WHERE recognition = 'recognized' AND verified
    ORDER BY tm DESC, canonical_id DESC, rk DESC LIMIT 50 OFFSET 50""",
)
def feed_page(spark, folder):
    return feed.page(_feed_rows(spark, folder), 2, feed.newest_first()).select(
        "canonical_id", "level", "value"
    )


@query(
    "feed_page_after",
    f"""WITH {_FEED} SELECT canonical_id, level, value FROM ok WHERE recognition = 'recognized' AND verified
    ORDER BY tm DESC, canonical_id DESC, rk DESC LIMIT 50 OFFSET 50""",
)
def feed_page_after(spark, folder):
    """The second page, asked for by the last row of the first."""
    rows = stage(_feed_rows(spark, folder).select("at", "canonical_id", "level", "value"))
    shown = feed.page_after(rows, None).collect()  # one page
    if not shown:
        return rows.select("canonical_id", "level", "value")
    return feed.page_after(rows, shown[-1].asDict()).select("canonical_id", "level", "value")


@query(
    "feed_search",
    """SELECT p_partkey, p_name, p_brand FROM part
    WHERE (p_name ILIKE '%ring%' OR p_brand ILIKE '%ring%' OR p_type ILIKE '%ring%')
      AND (p_name ILIKE '%econ%' OR p_brand ILIKE '%econ%' OR p_type ILIKE '%econ%')""",
)
def feed_search(spark, folder):
    """Comma terms are ANDed, columns are ORed."""
    rows = table(spark, folder, "part").withColumns(
        {
            "person_name": F.col("p_name"),
            "event_name": F.col("p_brand"),
            "competition_name": F.col("p_type"),
            "event_id": F.lit("333"),
        }
    )
    return feed.search(rows, "ring, ECON").select("p_partkey", "p_name", "p_brand")


@query(
    "feed_search_by_country_and_group",
    """SELECT o_orderkey, n_name FROM orders JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE (n_name ILIKE '%asia%' OR r_name ILIKE '%asia%') AND o_orderstatus = 'F'""",
)
def feed_search_by_country_and_group(spark, folder):
    """A continent name and an event group name as search terms."""
    rows = results(spark, folder).select("canonical_id", "country", "continent")
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("canonical_id"),
        F.when(F.col("o_orderstatus") == "F", "444").otherwise("clock").alias("event_id"),
    )
    found = feed.search(rows.join(orders, "canonical_id"), "asia, big cubes")
    return found.select(F.col("canonical_id").alias("o_orderkey"), F.col("country").alias("n_name"))


@query(
    "api_documents",
    f"""WITH {JUDGED} SELECT canonical_id, level, outcome, recognition, CAST(value AS VARCHAR) AS raw,
      CAST(value = final AND recognition = 'recognized' AS VARCHAR) AS current,
      CASE WHEN recognition = 'recognized' AND round_number <> 3 AND level <> 'PR' THEN 'eligible' ELSE recognition END AS reason
    FROM j""",
)
def api_documents(spark, folder):
    rows = _levels(spark, folder)
    blank = F.lit("")
    missing = {
        c: blank
        for c in (
            "identity_key",
            "person_name",
            "country_code",
            "country_display_name",
            "competition_timezone",
            "zone_status",
            "zone_reason",
            "event_name",
            "round_name",
            "formatted",
            "invalidity_reason",
            "source_url",
        )
    }
    no_time = F.lit(None).cast("timestamp")
    rows = rows.withColumns(missing).withColumns(
        {
            "independently_verified": F.lit(False),
            "entered_at": F.col("at"),
            "first_observed_at": F.col("at"),
            "last_observed_at": F.col("at"),
        }
    )
    claims = feed.claims_per_result(
        results(spark, folder).select(
            "canonical_id",
            F.lit(fixed.POLLED).alias("method"),
            F.col("canonical_id").alias("observation_id"),
            F.lit("").alias("source_tag"),
            F.lit(True).alias("trusted"),
            no_time.alias("entered_at"),
            F.col("at").alias("first_observed_at"),
            F.col("at").alias("last_observed_at"),
        )
    )
    documents = feed.documents(rows, claims)

    def part(path):
        return F.get_json_object("document", path)

    return documents.select(
        "canonical_id",
        "level",
        part("$.achievement.outcome").alias("outcome"),
        part("$.achievement.recognition").alias("recognition"),
        part("$.result.raw").alias("raw"),
        part("$.achievement.holding.current").alias("current"),
        part("$.notification.reason").alias("reason"),
    )


# --- benchmark validation -----------------------------------------------------------------------


@query(
    "benchmark_validation",
    f"""WITH {LEVELS} SELECT canonical_id, level, event_id, kind, scope AS region, base AS benchmark,
      CASE WHEN value <= base THEN 'verified' ELSE 'rejected' END AS validation
    FROM mem JOIN base USING (level, event_id, kind, scope) WHERE level <> 'PR'""",
)
def benchmark_validation(spark, folder):
    """Live results against the records of the first year."""
    records = baseline(spark, folder).where(F.col("level") != "PR")
    region = (
        F.when(F.col("level") == "WR", "")
        .when(F.col("level") == "CR", F.concat(F.lit("_"), "scope"))
        .otherwise(F.col("scope"))
    )
    heads = live_results(spark, folder).withColumn("records_name", F.col("country"))
    verdicts = benchmarks.validations(heads, records.withColumn("region", region))
    plain = F.when(F.col("level") == "WR", "World").otherwise(F.regexp_replace("region", "^_", ""))
    return verdicts.select(
        "canonical_id", "level", "event_id", "kind", plain.alias("region"), "benchmark", "validation"
    )


@query(
    "head_validation",
    f"""WITH {LEVELS}, v AS (SELECT canonical_id, bool_or(value <= base) AS verified
        FROM mem JOIN base USING (level, event_id, kind, scope) WHERE level <> 'PR' GROUP BY ALL)
    SELECT canonical_id, CASE WHEN round_number <> 1 THEN 'verified' WHEN verified THEN 'verified' ELSE 'pending' END AS validation_status,
      CASE WHEN round_number <> 1 THEN 'trusted_source_observation' WHEN verified THEN 'wca_records_api_record_match'
           ELSE 'wca_records_api_no_record_match' END AS validation_reason
    FROM res LEFT JOIN v USING (canonical_id) WHERE tm >= TIMESTAMP '1996-01-01'""",
)
def head_validation(spark, folder):
    """Round 1 comes from the untrusted source and needs an official benchmark."""
    records = baseline(spark, folder).where(F.col("level") != "PR")
    region = (
        F.when(F.col("level") == "WR", "")
        .when(F.col("level") == "CR", F.concat(F.lit("_"), "scope"))
        .otherwise(F.col("scope"))
    )
    untrusted = F.col("round_number") == 1
    heads = live_results(spark, folder).withColumns(
        {
            "records_name": F.col("country"),
            "checked": untrusted,
            "trusted": ~untrusted,
            "validation_status": F.when(untrusted, "pending").otherwise("verified"),
            "validation_reason": F.when(untrusted, "untrusted_source_only").otherwise(
                "trusted_source_observation"
            ),
        }
    )
    verdicts = benchmarks.validations(heads.where("checked"), records.withColumn("region", region))
    return benchmarks.head_validation(heads, verdicts).select(
        "canonical_id", "validation_status", "validation_reason"
    )


@query(
    "changed_scopes",
    f"""WITH {LEVELS}, a AS (SELECT level, event_id, kind, scope, min(value) AS v FROM lv WHERE year(tm) = 1995 GROUP BY ALL),
    b AS (SELECT level, event_id, kind, scope, min(value) AS v FROM lv WHERE year(tm) <= 1996 GROUP BY ALL)
    SELECT DISTINCT event_id, kind FROM a FULL JOIN b USING (level, event_id, kind, scope)
    WHERE a.v IS DISTINCT FROM b.v""",
)
def changed_scopes(spark, folder):
    rows = results(spark, folder)

    def until(year):
        cells = baseline_cells(rows.where(F.year("at") <= year))
        return cells.withColumnRenamed("scope", "region")

    return benchmarks.changed_scopes(until(1995), until(1996))


# --- comparison of methods ----------------------------------------------------------------------

_KINDS = ("click", "error", "purchase", "signup", "view")


def _detections(spark, folder):
    day = F.date_format("ts", "yyyy-MM-dd")
    return events(spark, folder).select(
        F.concat_ws("|", F.col("user_id").cast("string"), day).alias("comparison_key"),
        F.col("event_type").alias("method"),
        F.col("ts").alias("detected_at"),
        F.lit("active").alias("status"),
        F.col("event_id").alias("detection_id"),
    )


_DET = """det AS (SELECT user_id || '|' || strftime(ts, '%Y-%m-%d') AS comparison_key, event_type AS method,
  ts AS detected_at, event_id AS detection_id FROM events)"""
_DELAYS = ", ".join(
    f"(epoch_us({m}_at) - epoch_us(earliest)) / 1000000.0 AS {m}_delay" for m in _KINDS
)
_STAMPS = ", ".join(f"epoch_us({m}_at) AS {m}_at" for m in _KINDS)


@query(
    "detection_comparison",
    f"""WITH {_DET}, g AS (SELECT comparison_key, {", ".join(f"min(detected_at) FILTER (WHERE method = '{m}') AS {m}_at" for m in _KINDS)},
      min(detected_at) AS earliest, count(DISTINCT method) > 1 AS matched FROM det GROUP BY ALL)
    SELECT comparison_key, matched, {_STAMPS}, {_DELAYS} FROM g""",
)
def detection_comparison(spark, folder):
    rows = compare.comparison_table(_detections(spark, folder), "comparison_key", _KINDS)
    return rows.withColumns({f"{m}_at": F.unix_micros(f"{m}_at") for m in _KINDS})


@query(
    "detection_matches",
    f"""WITH {_DET}, f AS (SELECT comparison_key, method, min(detected_at) AS first_at FROM det GROUP BY ALL)
    SELECT d.detection_id, count(f.method) > 0 AS matched_elsewhere, epoch_us(min(f.first_at)) AS other_micros,
      (epoch_us(d.detected_at) - epoch_us(min(f.first_at))) / 1000000.0 AS difference_seconds,
      coalesce(string_agg(f.method, ',' ORDER BY f.method), '') AS methods
    FROM det d LEFT JOIN f ON f.comparison_key = d.comparison_key AND f.method <> d.method
    GROUP BY d.detection_id, d.detected_at""",
)
def detection_matches(spark, folder):
    return compare.detection_matches(_detections(spark, folder)).select(
        "detection_id",
        "matched_elsewhere",
        F.unix_micros("other_detected_at").alias("other_micros"),
        "difference_seconds",
        F.array_join("matching_methods", ",").alias("methods"),
    )


@query(
    "comparison_documents",
    f"""WITH {_DET}, f AS (SELECT comparison_key, method, min(detected_at) AS first_at FROM det GROUP BY ALL)
    SELECT comparison_key, count(*) > 1 AS matched, string_agg(method, ',' ORDER BY method) AS methods,
      max((epoch_us(first_at) - epoch_us(e)) / 1000000.0) AS longest_delay
    FROM (SELECT *, min(first_at) OVER (PARTITION BY comparison_key) AS e FROM f) GROUP BY ALL""",
)
def comparison_documents(spark, folder):
    rows = compare.comparison_by_key(_detections(spark, folder))
    return rows.select(
        "comparison_key",
        "matched",
        F.array_join("methods", ",").alias("methods"),
        F.array_max(F.map_values("seconds_after_earliest")).alias("longest_delay"),
    )


_CLAIMS = """cl AS (SELECT event_id AS seq, user_id, CASE event_type WHEN 'purchase' THEN 'WR' WHEN 'signup' THEN 'CR'
  WHEN 'click' THEN 'NR' ELSE '' END AS level, CAST(floor(value / 10) AS BIGINT) + 1 AS value, ts FROM events)"""


def _claims(spark, folder):
    level = (
        F.when(F.col("event_type") == "purchase", "WR")
        .when(F.col("event_type") == "signup", "CR")
        .when(F.col("event_type") == "click", "NR")
        .otherwise("")
    )
    return events(spark, folder).select(
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("stable_identity"),
        F.lit("single").alias("kind"),
        F.lit(fixed.SUBSCRIBED).alias("method"),
        level.alias("level"),
        (F.floor(F.col("value") / 10) + 1).cast("long").alias("value"),
        F.col("ts").alias("observed_at"),
    )


@query(
    "detections",
    f"""WITH {_CLAIMS}, n AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY seq) AS nxt FROM cl)
    SELECT user_id AS stable_identity, level, arg_max(value, seq) AS value, epoch_us(min(ts)) AS detected,
      epoch_us(arg_max_null(nxt, seq)) AS withdrawn,
      CASE WHEN arg_max_null(nxt, seq) IS NULL THEN 'active' ELSE 'withdrawn' END AS status
    FROM n WHERE level <> '' GROUP BY ALL""",
)
def detection_states(spark, folder):
    return detections.detections(_claims(spark, folder)).select(
        "stable_identity",
        "level",
        "value",
        F.unix_micros("detected_at").alias("detected"),
        F.unix_micros("withdrawn_at").alias("withdrawn"),
        "status",
    )


@query(
    "changed_claims",
    f"""WITH {_CLAIMS}, p AS (SELECT *, coalesce(lag(level) OVER w, '') AS pl, lag(value) OVER w AS pv FROM cl
        WINDOW w AS (PARTITION BY user_id ORDER BY seq))
    SELECT seq, user_id AS stable_identity, level FROM p
    WHERE NOT (pv IS NOT DISTINCT FROM value AND pl = level) AND (pl <> '' OR level <> '')""",
)
def changed_claims(spark, folder):
    return detections.changed_claims(_claims(spark, folder)).select("seq", "stable_identity", "level")


@query(
    "poll_statistics",
    """WITH p AS (SELECT CAST(ts AS DATE) AS poll_id, event_id, user_id, event_type, value < 1 AS bad FROM events),
    f AS (SELECT user_id, event_type, arg_min(poll_id, event_id) AS poll_id FROM p WHERE NOT bad GROUP BY ALL),
    n AS (SELECT poll_id, count(*) AS new_observations FROM f GROUP BY ALL)
    SELECT poll_id, count(*) AS records_found, coalesce(any_value(new_observations), 0) AS new_observations,
      count(*) FILTER (WHERE bad) AS malformed,
      count(*) FILTER (WHERE NOT bad) - coalesce(any_value(new_observations), 0) AS duplicates_ignored
    FROM p LEFT JOIN n USING (poll_id) GROUP BY ALL""",
)
def poll_statistics(spark, folder):
    polled = events(spark, folder).select(
        F.to_date("ts").alias("poll_id"),
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("stable_identity"),
        F.lit("single").alias("kind"),
        F.col("event_type").alias("level"),
        F.when(F.col("value") < 1, "malformed").alias("error"),
    )
    return detections.poll_statistics(polled)


# --- values, keys and times ----------------------------------------------------------------------


def _packed(spark, folder):
    """Packed multi-attempt values 0DDTTTTTMM derived from each order."""
    key = F.col("o_orderkey")
    packed = (
        (F.lit(99) - key % 60) * 10_000_000
        + F.floor(F.col("o_totalprice")).cast("long") % 100_000 * 100
        + key % 7
    )
    return table(spark, folder, "orders").select("o_orderkey", packed.cast("long").alias("packed"))


_PACKED = """pk AS (SELECT o_orderkey, CAST((99 - o_orderkey % 60) * 10000000
  + CAST(floor(o_totalprice) AS BIGINT) % 100000 * 100 + o_orderkey % 7 AS BIGINT) AS packed FROM orders),
dc AS (SELECT *, packed % 100 AS missed, (packed // 100) % 100000 AS secs, 99 - (packed // 10000000) % 100 AS points FROM pk)"""


@query(
    "decode_packed",
    f"""WITH {_PACKED} SELECT o_orderkey, CAST(points + missed AS INTEGER) AS solved,
      CAST(points + 2 * missed AS INTEGER) AS attempted,
      CAST(CASE WHEN secs <> 99999 THEN secs * 100 END AS INTEGER) AS centiseconds FROM dc""",
)
def decode_packed(spark, folder):
    return _packed(spark, folder).select("o_orderkey", F.inline(F.array(values.decode_multi("packed"))))


@query(
    "format_result",
    """WITH v AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 11 = 0 THEN -(o_orderkey % 4)
        ELSE CAST(floor(o_totalprice) AS BIGINT) END AS v FROM orders),
    s AS (SELECT *, v // 360000 AS h, (v % 360000) // 6000 AS m, (v % 6000) // 100 AS sec, v % 100 AS c FROM v)
    SELECT o_orderkey, CASE WHEN v = 0 THEN '' WHEN v = -1 THEN 'DNF' WHEN v = -2 THEN 'DNS' WHEN v < 0 THEN 'Invalid'
      WHEN o_orderstatus = 'P' THEN CASE WHEN c = 0 THEN printf('%d.0', v // 100)
           WHEN c % 10 = 0 THEN printf('%d.%d', v // 100, c // 10) ELSE printf('%d.%02d', v // 100, c) END
      WHEN h > 0 THEN printf('%d:%02d:%02d.%02d', h, m, sec, c)
      WHEN m > 0 THEN printf('%d:%02d.%02d', m, sec, c) ELSE printf('%d.%02d', sec, c) END AS text FROM s""",
)
def format_result(spark, folder):
    key = F.col("o_orderkey")
    value = F.when(key % 11 == 0, -(key % 4)).otherwise(F.floor("o_totalprice").cast("long"))
    moves = F.col("o_orderstatus") == "P"
    return table(spark, folder, "orders").select(
        "o_orderkey",
        values.format_result(
            F.when(moves, "333fm").otherwise("333"),
            F.when(moves, "average").otherwise("single"),
            value,
        ).alias("text"),
    )


def _tries(spark, folder):
    """Each order as a round result: attempts by line number, 0 where a line is missing."""
    lines = table(spark, folder, "lineitem").where(F.col("l_linenumber") <= 5)
    columns = [
        F.coalesce(
            F.max(F.when(F.col("l_linenumber") == n, F.floor("l_extendedprice").cast("long"))),
            F.lit(0).cast("long"),
        ).alias(f"a{n}")
        for n in range(1, 6)
    ]
    return (
        lines.groupBy("l_orderkey")
        .agg(*columns)
        .select("l_orderkey", F.array(*[f"a{n}" for n in range(1, 6)]).alias("attempts"))
    )


_TRIES = "tr AS (SELECT l_orderkey, " + ", ".join(
    f"coalesce(max(CAST(floor(l_extendedprice) AS BIGINT)) FILTER (WHERE l_linenumber = {n}), 0) AS a{n}"
    for n in range(1, 6)
) + " FROM lineitem WHERE l_linenumber <= 5 GROUP BY ALL)"


@query(
    "finalization_gate",
    f"""WITH {_TRIES} SELECT l_orderkey,
      (a1 <> 0 AND a2 <> 0 AND a3 <> 0 AND a4 <> 0 AND a5 <> 0) OR
      (a1 <> 0 AND a2 <> 0 AND a1 >= 40000 AND a2 >= 40000 AND a3 = 0 AND a4 = 0 AND a5 = 0) AS final,
      (a1 <> 0 AND a2 <> 0 AND a3 <> 0 AND a4 <> 0 AND a5 <> 0) AS complete FROM tr""",
)
def finalization_gate(spark, folder):
    return _tries(spark, folder).select(
        "l_orderkey",
        finalize.is_final("attempts", F.lit(5), F.lit(2), F.lit(40000)).alias("final"),
        finalize.all_attempts_entered("attempts", F.lit(5)).alias("complete"),
    )


@query(
    "cutoff_rule",
    """SELECT l_returnflag, l_linenumber,
      CASE l_returnflag WHEN 'A' THEN 5 WHEN 'N' THEN 0 ELSE 3 END AS expected_attempts,
      CASE WHEN cut > 0 THEN CASE WHEN l_returnflag = 'A' THEN 2 ELSE 1 END END AS cutoff_attempts,
      CASE WHEN cut > 0 THEN CASE WHEN l_linestatus = 'F' THEN cut ELSE cut * 100 END END AS cutoff_value,
      count(*) AS lines
    FROM (SELECT *, CAST(floor(l_quantity) AS BIGINT) - 25 AS cut FROM lineitem) GROUP BY ALL""",
)
def cutoff_rule(spark, folder):
    rule = finalize.cutoff_rule(
        F.when(F.col("l_returnflag") == "R", "m").otherwise(F.col("l_returnflag")),
        F.floor("l_quantity").cast("long") - 25,
        F.when(F.col("l_linestatus") == "F", "333fm").otherwise("333"),
    )
    return (
        table(spark, folder, "lineitem")
        .select("l_returnflag", "l_linenumber", F.inline(F.array(rule)))
        .groupBy("l_returnflag", "l_linenumber", "expected_attempts", "cutoff_attempts", "cutoff_value")
        .agg(F.count(F.lit(1)).alias("lines"))
    )


@query(
    "identity_keys",
    f"""WITH {RES} SELECT canonical_id,
      'wca|' || competition_id || '|' || person_id || '|' || event_id || '|' || round_number || '|' || kind AS natural_key,
      'orders|api_polling|' || canonical_id || '|' || kind || '|final' AS observation_key,
      sha256('orders|api_polling|' || canonical_id || '|' || kind || '|final') AS hash FROM res""",
)
def identity_keys(spark, folder):
    observation = keys.observation_key(
        F.lit("orders"), F.lit(fixed.POLLED), F.col("canonical_id").cast("string"), "kind"
    )
    return results(spark, folder).select(
        "canonical_id",
        keys.natural_key("competition_id", "person_id", "event_id", "round_number", "kind").alias(
            "natural_key"
        ),
        observation.alias("observation_key"),
        F.sha2(observation, 256).alias("hash"),
    )


@query(
    "local_date",
    """SELECT event_id, CAST(timezone(zone, timezone('UTC', ts)) AS DATE) AS local_date,
      CASE WHEN known THEN 'resolved' ELSE 'unresolved' END AS status
    FROM (SELECT event_id, ts, CASE event_type WHEN 'view' THEN 'Asia/Tokyo' WHEN 'click' THEN 'America/New_York'
      WHEN 'error' THEN NULL ELSE 'Europe/Amsterdam' END AS zone, event_type <> 'error' AS known FROM events)""",
)
def local_date(spark, folder):
    zone = (
        F.when(F.col("event_type") == "view", "Asia/Tokyo")
        .when(F.col("event_type") == "click", "America/New_York")
        .when(F.col("event_type") == "error", "Nowhere/Land")
        .otherwise("Europe/Amsterdam")
    )
    rows = events(spark, folder).withColumns(
        {"zone": zone, "known": F.col("event_type") != "error"}
    )
    day = times.local_date("ts", "zone", "known")
    return rows.withColumn("local_date", day).select(
        "event_id", "local_date", times.zone_resolution("zone", "local_date")["status"].alias("status")
    )


@query(
    "weekend_window",
    """SELECT o_orderkey, start AS window_start, start + 6 AS window_end FROM (
      SELECT o_orderkey, CAST(o_orderdate AS DATE) - CAST((isodow(o_orderdate) + 4) % 7 AS INTEGER) AS start FROM orders)""",
)
def weekend_window(spark, folder):
    window = times.weekend_window(F.col("o_orderdate").cast("date"))
    return table(spark, folder, "orders").select(
        "o_orderkey", window["start"].alias("window_start"), window["end"].alias("window_end")
    )


@query(
    "ages",
    """SELECT event_id, CASE WHEN s < 60 THEN s || 's ago' WHEN s < 3600 THEN (s // 60) || 'm ago'
        WHEN s < 86400 THEN (s // 3600) || 'h ago' WHEN s < 604800 THEN (s // 86400) || 'd ago'
        ELSE (s // 604800) || 'w ago' END AS compact,
      CASE WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 21600 THEN (s // 3600) || 'h' || (s // 60 % 60) || 'm ago'
        WHEN s < 86400 THEN (s // 3600) || 'h ago' ELSE (s // 86400) || 'd' || (s // 3600 % 24) || 'h ago' END AS long_text,
      us < 345600000000 AS recent
    FROM (SELECT event_id, greatest(us // 1000000, 0) AS s, us FROM (SELECT event_id, epoch_us(TIMESTAMP '2024-01-30 12:00:00') - epoch_us(ts) AS us FROM events))""",
)
def ages(spark, folder):
    as_of = F.lit("2024-01-30 12:00:00").cast("timestamp")
    return events(spark, folder).select(
        "event_id",
        times.compact_age_text("ts", as_of).alias("compact"),
        times.age_text("ts", as_of).alias("long_text"),
        times.is_recent("ts", as_of).alias("recent"),
    )


@query(
    "name_split",
    """SELECT c_custkey, CASE c_custkey % 3 WHEN 2 THEN c_name || ' (' || c_mktsegment ELSE c_name END AS romanized_name,
      CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS native_name,
      CASE WHEN c_nationkey % 4 = 0 THEN 'CR' ELSE ['', 'WR', 'NR', 'PB'][c_nationkey % 4 + 1] END AS tag FROM customer""",
)
def name_split(spark, folder):
    """Names with, without and with half a native part, and tags of all kinds, split and normalised."""
    kind = F.col("c_custkey") % 3
    native = F.concat(F.lit(" ("), "c_mktsegment")
    whole = F.when(kind == 0, F.concat("c_name", native, F.lit(") "))).when(kind == 1, F.col("c_name")).otherwise(F.concat("c_name", native))
    tags = F.array(F.lit(" asr "), F.lit("wr"), F.lit("NR "), F.lit("pb"))
    return table(spark, folder, "customer").select(
        "c_custkey", F.inline(F.array(split_native_name(whole))), record_tag(F.get(tags, F.col("c_nationkey") % 4)).alias("tag")
    )


# --- frames and snapshots -------------------------------------------------------------------------


@query(
    "frame_dedup",
    """SELECT user_id, event_type, props, min(event_id) AS event_id FROM events GROUP BY ALL""",
)
def frame_dedup(spark, folder):
    """First frame of each content, by content hash."""
    rows = events(spark, folder).withColumn(
        "payload_hash", keys.content_hash(["user_id", "event_type", "props"])
    )
    return snapshots.distinct_frames(rows, ["payload_hash"], ["event_id"]).select(
        "user_id", "event_type", "props", "event_id"
    )


@query(
    "frame_runs",
    """SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events)
    WHERE b IS DISTINCT FROM event_type""",
)
def frame_runs(spark, folder):
    """Frames that differ from the one before them in their stream."""
    return snapshots.distinct_runs(
        events(spark, folder), ["user_id"], "event_type", "event_id"
    ).select("event_id", "user_id", "event_type")


def daily_snapshots(spark, folder):
    """Each day is one full snapshot: per user the best value of the day."""
    rows = events(spark, folder).groupBy(
        F.dayofyear("ts").cast("long").alias("day"), "user_id"
    ).agg(F.min(F.floor(F.col("value") / 5).cast("long")).alias("best"))
    return snapshots.with_hash(rows, ["user_id", "best"])


_DAILY = """dy AS (SELECT dayofyear(ts) AS day, user_id, min(CAST(floor(value / 5) AS BIGINT)) AS best FROM events GROUP BY ALL),
ch AS (SELECT coalesce(n.day, o.day + 1) AS day, coalesce(n.user_id, o.user_id) AS user_id,
         CASE WHEN o.day IS NULL THEN 'addition' WHEN n.day IS NULL THEN 'removal' WHEN n.best <> o.best THEN 'change' END AS change
       FROM dy n FULL JOIN dy o ON n.user_id = o.user_id AND n.day = o.day + 1)"""
_CHANGES = f"WITH {_DAILY} SELECT user_id, day, change FROM ch WHERE change IS NOT NULL AND day <= (SELECT max(day) FROM dy)"


@query("snapshot_diff", _CHANGES)
def snapshot_diff(spark, folder):
    rows = daily_snapshots(spark, folder)
    return snapshots.snapshot_series(rows, ["user_id"], "day", "meaningful_hash")


@query(
    "snapshot_statistics",
    f"""SELECT day, count(*) FILTER (WHERE change = 'addition') AS additions,
      count(*) FILTER (WHERE change = 'change') AS changes, count(*) FILTER (WHERE change = 'removal') AS removals
    FROM ({_CHANGES}) GROUP BY ALL""",
)
def snapshot_statistics(spark, folder):
    rows = daily_snapshots(spark, folder)
    changes = snapshots.snapshot_series(rows, ["user_id"], "day", "meaningful_hash")
    return snapshots.change_counts(changes, "day")


@query(
    "two_snapshots",
    """WITH a AS (SELECT user_id, max(event_type) AS m FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY ALL),
    b AS (SELECT user_id, max(event_type) AS m FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY ALL)
    SELECT user_id, CASE WHEN a.m IS NULL THEN 'addition' WHEN b.m IS NULL THEN 'removal'
      WHEN a.m <> b.m THEN 'change' ELSE 'unchanged' END AS change FROM a FULL JOIN b USING (user_id)""",
)
def two_snapshots(spark, folder):
    half = F.lit("2024-01-16").cast("timestamp")
    rows = events(spark, folder)

    def state(part):
        best = part.groupBy("user_id").agg(F.max("event_type").alias("m"))
        return snapshots.with_hash(best, ["user_id", "m"])

    return snapshots.diff(
        state(rows.where(F.col("ts") < half)), state(rows.where(F.col("ts") >= half)), ["user_id"]
    )


@query(
    "upsert",
    """SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value,
      epoch_us(min(ts)) AS first_seen FROM events GROUP BY ALL""",
)
def upserted(spark, folder):
    """The second half of the month merged into the first, first sight kept."""
    half = F.lit("2024-01-16").cast("timestamp")
    rows = events(spark, folder).select(
        "user_id", "event_type", "event_id", "value", F.col("ts").alias("first_seen")
    )
    old = latest_per_key(
        rows.where(F.col("first_seen") < half).drop("first_seen"), ["user_id", "event_type"], ["event_id"]
    ).join(
        rows.where(F.col("first_seen") < half).groupBy("user_id", "event_type").agg(F.min("first_seen").alias("first_seen")),
        ["user_id", "event_type"],
    )
    merged = upsert(
        old, rows.where(F.col("first_seen") >= half), ["user_id", "event_type"], ["event_id"], "first_seen"
    )
    return merged.withColumn("first_seen", F.unix_micros("first_seen"))
