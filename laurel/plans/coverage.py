"""Queries of single conversions, lookups and parsers over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from laurel.functions import finalize, fixed, keys, status, text, times, values
from laurel.operators import attendance, benchmarks, detections, evidence, feed, grouping, health, rounds, snapshots, upkeep, zones
from laurel.plans.catalog import query
from laurel.plans.serving import _CHANGES, _CLAIMS, _claims, daily_snapshots
from laurel.plans.tables import RES, events, results, table, tune
from laurel.sources import export, payloads


@query(
    "better_values",
    """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN -1 ELSE CAST(floor(o_totalprice) AS BIGINT) END AS c,
      CASE o_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE CAST(o_custkey * 100 AS BIGINT) END AS i FROM orders)
    SELECT o_orderkey, coalesce(c > 0, false) AND (NOT coalesce(i > 0, false) OR c < i) AS better, CASE WHEN c > 0 THEN 0 ELSE 1 END AS incomplete FROM o""",
)
def better_values(spark, folder):
    """Totals against another value that may be missing or incomplete."""
    rows = table(spark, folder, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 5 == 0, -1).otherwise(F.floor("o_totalprice")).cast("long").alias("c"),
        F.when(F.col("o_custkey") % 4 == 1, 0).when(F.col("o_custkey") % 4 != 0, F.col("o_custkey") * 100).cast("long").alias("i"),
    )
    return rows.select("o_orderkey", values.is_better("c", "i").alias("better"), values.comparison_key("c")["incomplete"].alias("incomplete"))


@query(
    "observation_keys",
    """SELECT event_id, 'events|' || event_type || '|' || user_id || '|single|final' AS observation_key,
      'source|events|' || CASE WHEN user_id % 2 = 0 THEN '' ELSE 'C' || user_id END || '|' || event_id || '|333|single|final' AS source_key FROM events""",
)
def observation_keys(spark, folder):
    rows = events(spark, folder)
    place = F.when(F.col("user_id") % 2 != 0, F.concat(F.lit("C"), "user_id"))
    return rows.select(
        "event_id",
        keys.observation_key(F.lit("events"), "event_type", "user_id", F.lit("single")).alias("observation_key"),
        keys.source_key(F.lit("events"), place, "event_id", F.lit("333"), F.lit("single")).alias("source_key"),
    )


@query(
    "zone_dates",
    """SELECT event_id, CASE user_id % 4 WHEN 0 THEN CAST(ts + INTERVAL 9 HOUR AS DATE) WHEN 1 THEN CAST(ts - INTERVAL 5 HOUR AS DATE) END AS local_date,
      CASE WHEN user_id % 4 < 2 THEN 'resolved' ELSE 'unresolved' END AS status,
      CASE user_id % 4 WHEN 2 THEN 'invalid_source_timezone' WHEN 3 THEN 'missing_or_ambiguous_source_timezone' ELSE 'provider_supplied_iana_timezone' END AS reason FROM events""",
)
def zone_dates(spark, folder):
    """Dates in two zones that exist, one that does not, and without a zone."""
    names = F.array(F.lit("Etc/GMT-9"), F.lit("Etc/GMT+5"), F.lit("Nowhere/Atall"), F.lit(""))
    rows = events(spark, folder).withColumn("zone", F.get(names, (F.col("user_id") % 4).cast("int")))
    found = zones.with_local_date(rows, zones.zone_dimension(spark), "ts", "zone")
    return found.select("event_id", "local_date", "zone_resolution.status", "zone_resolution.reason")


@query(
    "collection_windows",
    """WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)
    SELECT o_orderkey, d - 7 AS lookback, d - 1 AS first_day, d + 7 AS last_day,
      epoch_us(CAST(d + 1 AS TIMESTAMP) + INTERVAL 12 HOUR) AS until_micros,
      TIMESTAMP '1998-06-01 09:00:00' <= CAST(d + 1 AS TIMESTAMP) + INTERVAL 12 HOUR AS collectable FROM d""",
)
def collection_windows(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    window = times.discovery_window("d")
    as_of = F.lit("1998-06-01 09:00:00").cast("timestamp")
    return rows.select(
        "o_orderkey",
        times.lookback_start("d", 7).alias("lookback"),
        window["start"].alias("first_day"),
        window["end"].alias("last_day"),
        F.unix_micros(times.collectable_until("d")).alias("until_micros"),
        times.is_collectable("d", as_of).alias("collectable"),
    )


@query(
    "alert_targets",
    """SELECT page_id, url LIKE '/%' AND url NOT LIKE '//%' AS whole, true AS path,
      false AS double_slash FROM pages""",
)
def alert_targets(spark, folder):
    """A page's address, its path, and the path with one more slash, as targets of an alert."""
    path = F.concat(F.lit("/"), F.regexp_replace("url", "^[a-z]+://[^/]*/*|^/+", ""))
    return table(spark, folder, "pages").select(
        "page_id",
        text.is_relative_target("url").alias("whole"),
        text.is_relative_target(path).alias("path"),
        text.is_relative_target(F.concat(F.lit("/"), path)).alias("double_slash"),
    )


@query(
    "retry_plan",
    f"""SELECT o_orderkey, o_orderkey % 12 >= {fixed.MAX_DELIVERY_ATTEMPTS} AS exhausted,
      [{", ".join(map(str, fixed.RETRY_DELAYS_SECONDS))}][CAST(least(greatest(o_orderkey % 12, 1), {len(fixed.RETRY_DELAYS_SECONDS)}) AS INTEGER)] AS delay FROM orders""",
)
def retry_plan(spark, folder):
    attempt = (F.col("o_orderkey") % 12).cast("int")
    return table(spark, folder, "orders").select(
        "o_orderkey", status.attempts_exhausted(attempt).alias("exhausted"), status.retry_delay_seconds(attempt).alias("delay")
    )


def _competitions(spark, folder):
    """Months as competitions of two venues, with all their events and rounds."""
    rows = results(spark, folder).groupBy("competition_id").agg(F.collect_set(F.struct("event_id", "round_number")).alias("found"))
    venue = lambda name, zone: F.struct(F.lit(name).alias("name"), F.lit(zone).alias("timezone"), F.struct(F.lit("JP").alias("iso2")).alias("country"))
    event = F.array_distinct(F.transform("found", lambda f: f["event_id"]))

    def held_rounds(name):
        own = F.filter("found", lambda f: f["event_id"] == name)
        return F.transform(own, lambda f: F.struct(
            F.concat_ws("-", F.lit("r"), name, f["round_number"]).alias("id"), f["round_number"].alias("number"),
            F.struct(F.lit("a").alias("id"), F.lit(5).alias("numberOfAttempts")).alias("format")))

    payload = F.struct(
        F.col("competition_id").alias("id"), F.col("competition_id").alias("wcaId"), F.lit("Open").alias("name"),
        F.lit("2026-08-08").alias("startDate"), F.lit("2026-08-09").alias("endDate"),
        F.array(venue("a", "Asia/Tokyo"), venue("b", "Asia/Seoul")).alias("venues"),
        F.transform(event, lambda e: F.struct(F.struct(e.alias("id"), e.alias("name")).alias("event"), held_rounds(e).alias("rounds"))).alias("competitionEvents"),
    )
    # Round 1 is held at the first venue, round 2 at the second, round 3 at both, three activities deep.
    activity = lambda f: F.struct(F.lit("other").alias("activityCode"), F.array(F.struct(F.lit("misc").alias("activityCode"), F.array(F.struct(
        F.concat(F.replace(f["event_id"], F.lit("-"), F.lit("_")), F.lit("-r"), f["round_number"].cast("string"), F.lit("-g1")).alias("activityCode"))).alias("childActivities"))).alias("childActivities"))
    held = lambda zone, other: F.struct(F.lit(zone).alias("timezone"), F.array(F.struct(
        F.transform(F.filter("found", lambda f: f["round_number"] != other), activity).alias("activities"))).alias("rooms"))
    schedule = F.struct(F.struct(F.array(held("Asia/Tokyo", 2), held("Asia/Seoul", 1)).alias("venues")).alias("schedule"))
    return rows.select("competition_id", F.to_json(payload).alias("payload"), F.to_json(schedule).alias("schedule"))


@query(
    "round_targets_parsed",
    f"""WITH {RES} SELECT DISTINCT competition_id, event_id, CAST(round_number AS INTEGER) AS round_number, 'r-' || event_id || '-' || round_number AS round_id,
      5 AS expected_attempts, CASE round_number WHEN 1 THEN 'Asia/Tokyo' WHEN 2 THEN 'Asia/Seoul' ELSE '' END AS competition_timezone FROM res""",
)
def round_targets_parsed(spark, folder):
    """Rounds of competition payloads, with the zone that their schedules settle."""
    rows = _competitions(spark, folder)
    settled = payloads.schedule_zones(rows.select("competition_id", F.col("schedule").alias("payload")))
    # Activity codes have no dash inside an event's name.
    names = results(spark, folder).select("event_id").distinct().select(F.replace("event_id", F.lit("-"), F.lit("_")).alias("_n"), F.col("event_id").alias("_e"))
    settled = settled.join(names, F.col("event_id") == F.col("_n")).select("competition_id", F.col("_e").alias("event_id"), "round_number", "zone")
    found = payloads.round_targets(rows.select("payload"), settled)
    return found.select("competition_id", "event_id", "round_number", "round_id", "expected_attempts", "competition_timezone")


@query(
    "listed_competitions_parsed",
    """SELECT CAST(s_suppkey AS VARCHAR) AS source_id, s_name AS name, CASE WHEN s_suppkey % 5 = 0 THEN 'incomplete competition' END AS error FROM supplier""",
)
def listed_competitions_parsed(spark, folder):
    """Suppliers as entries of listing pages, ten to a page; one in five has no country."""
    entry = F.struct(
        F.col("s_suppkey").cast("string").alias("id"), F.concat(F.lit(" "), "s_name").alias("name"),
        F.lit("2026-08-08").alias("start_date"), F.lit("2026-08-09").alias("end_date"),
        F.when(F.col("s_suppkey") % 5 != 0, "jp").alias("country_iso2"), F.lit("City").alias("city"))
    pages = table(spark, folder, "supplier").groupBy(F.expr("s_suppkey DIV 10").alias("page")).agg(F.to_json(F.collect_list(entry)).alias("payload"))
    return payloads.listed_competitions(pages).select("source_id", "name", "error")


@query(
    "listed_registrations_parsed",
    """SELECT n_nationkey, printf('2010ABCD%02d', c_custkey % 100) AS person_id, c_name AS name, 'Asia' AS continent,
      CASE WHEN c_custkey % 7 = 0 THEN 'incomplete competitor' END AS error FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 3 <> 0""",
)
def listed_registrations_parsed(spark, folder):
    """Customers as registrations in lists of twenty; one in three is a first-timer, some have no country."""
    user = F.struct(
        F.when(F.col("c_custkey") % 3 != 0, F.format_string("2010abcd%02d", F.col("c_custkey") % 100)).alias("wca_id"),
        F.col("c_name").alias("name"),
        F.when(F.col("c_custkey") % 7 != 0, F.struct(F.lit("jp").alias("iso2"), F.lit("_Asia").alias("continent_id"))).otherwise(
            F.struct(F.lit("").alias("iso2"), F.lit("_Asia").alias("continent_id"))).alias("country"))
    lists = table(spark, folder, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey"), F.expr("c_custkey DIV 20").alias("part"))
    pages = lists.agg(F.to_json(F.collect_list(F.struct(user.alias("user")))).alias("payload"))
    return payloads.listed_registrations(pages).select("n_nationkey", "person_id", "name", "continent", "error")


@query(
    "merged_competitions",
    """WITH l AS (SELECT CASE WHEN p_size % 3 = 0 THEN 'cubingchina' ELSE 'wca' END AS source, p_size % 7 AS g, p_partkey, p_name FROM part)
    SELECT CASE WHEN g = 0 THEN source || ':' || p_partkey ELSE 'wca:' || g || '-' || p_partkey % 50 END AS source_key,
      string_agg(DISTINCT source, ',' ORDER BY source) AS sources,
      coalesce(arg_max(p_name, p_partkey) FILTER (WHERE source = 'wca'), arg_min(p_name, p_partkey)) AS name FROM l GROUP BY 1""",
)
def merged_competitions(spark, folder):
    """Parts as listed competitions of two sources; some name no official one."""
    group = F.col("p_size") % 7
    listed = table(spark, folder, "part").select(
        F.when(F.col("p_size") % 3 == 0, "cubingchina").otherwise("wca").alias("source"),
        F.col("p_partkey").cast("string").alias("source_id"),
        F.when(group != 0, F.concat_ws("-", group, F.col("p_partkey") % 50)).alias("official_id"),
        F.col("p_name").alias("name"),
        F.col("p_partkey").alias("position"),
    )
    merged = attendance.merge_competitions(listed)
    return merged.select("source_key", F.array_join("sources", ",").alias("sources"), "name")


@query(
    "round_rows_described",
    f"""WITH {RES} SELECT canonical_id, competition_id, CASE round_number WHEN 1 THEN 3 ELSE 5 END AS expected_attempts FROM res WHERE round_number <> 3""",
)
def round_rows_described(spark, folder):
    """Result rows with the descriptor of their round; rounds that are not known are left out."""
    rows = results(spark, folder).withColumn("round_id", F.concat_ws("/", "competition_id", "round_number"))
    known = rows.where("round_number <> 3").select("round_id", F.when(F.col("round_number") == 1, 3).otherwise(5).alias("expected_attempts")).distinct()
    return detections.round_candidates(rows, known).select("canonical_id", "competition_id", "expected_attempts")


@query(
    "country_lookup",
    """SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN '' ELSE upper(substr(n_name, 1, 2)) || n_nationkey END AS country_code,
      CASE WHEN c_custkey % 9 = 0 THEN '' ELSE r_name END AS continent
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
def country_lookup(spark, folder):
    """Country names in other spacing and case to codes, and codes to continents; some are unknown."""
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    countries = nation.select(
        F.col("n_name").alias("id"), F.col("n_name").alias("name"), F.concat(F.lit("_"), "n_regionkey").alias("continent_id"),
        F.concat(F.upper(F.substring("n_name", 1, 2)), "n_nationkey").alias("iso2"))
    places = export.country_dimension(countries, region.select(F.concat(F.lit("_"), "r_regionkey").alias("id"), F.col("r_name").alias("name")))
    named = table(spark, folder, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    spaced = F.concat(F.lit("  "), F.replace(F.lower("n_name"), F.lit(" "), F.lit("   ")), F.lit(" "))
    rows = named.select("c_custkey", F.when(F.col("c_custkey") % 9 == 0, "Atlantis").otherwise(spaced).alias("region"))
    found = export.with_continent(export.country_codes(rows, places, "region"), places)
    return found.select("c_custkey", "country_code", "continent")


@query(
    "claims_per_result",
    """SELECT user_id AS canonical_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS methods, count(*) AS claims,
      arg_min(CASE WHEN event_id % 3 = 0 THEN '' ELSE 'WR' END, (event_type, event_id)) AS first_tag FROM events GROUP BY user_id""",
)
def claims_per_result(spark, folder):
    rows = events(spark, folder).select(
        F.col("user_id").alias("canonical_id"), F.col("event_type").alias("method"), F.col("event_id").alias("observation_id"),
        F.when(F.col("event_id") % 3 == 0, "").otherwise("WR").alias("source_tag"), F.lit(True).alias("trusted"),
        F.col("ts").alias("entered_at"), F.col("ts").alias("first_observed_at"), F.col("ts").alias("last_observed_at"))
    found = feed.claims_per_result(rows)
    return found.select("canonical_id", F.array_join("methods", ",").alias("methods"), F.size("claims").cast("long").alias("claims"),
                        F.coalesce(F.get("claims", F.lit(0))["record_tag"], F.lit("")).alias("first_tag"))


@query(
    "snapshot_statistics_full",
    f"""WITH ch AS ({_CHANGES}), s AS (SELECT dayofyear(ts) AS day, user_id, event_type, event_id FROM events),
    t AS (SELECT day, count(DISTINCT user_id) AS rows, count(DISTINCT CASE WHEN event_type <> 'error' THEN user_id END) AS detected,
          count(DISTINCT CASE WHEN event_type = 'error' THEN user_id END) AS withdrawn FROM s GROUP BY day),
    k AS (SELECT day, count(*) FILTER (WHERE change = 'addition') AS additions, count(*) FILTER (WHERE change = 'change') AS changes,
          count(*) FILTER (WHERE change = 'removal') AS removals FROM ch GROUP BY day)
    SELECT sum(rows) AS rows, sum(coalesce(additions, 0)) AS additions, sum(coalesce(changes, 0)) AS changes, sum(coalesce(removals, 0)) AS removals,
      sum(detected) AS detected, sum(withdrawn) AS withdrawn FROM t FULL JOIN k USING (day)""",
)
def snapshot_statistics_full(spark, folder):
    """All six counts of the daily snapshots, summed."""
    rows = daily_snapshots(spark, folder)
    changes = snapshots.snapshot_series(rows, ["user_id"], "day", "meaningful_hash")
    state = events(spark, folder).select(
        F.dayofyear("ts").cast("long").alias("day"), "user_id",
        F.when(F.col("event_type") == "error", "withdrawn").otherwise("active").alias("status")).distinct()
    counts = health.snapshot_statistics(changes, rows, state, "day")
    names = ("rows", "additions", "changes", "removals", "detected", "withdrawn")
    return counts.agg(*[F.sum(n).alias(n) for n in names])


@query(
    "snapshot_diff_gaps",
    """WITH dy AS (SELECT dayofyear(ts) AS day, user_id, min(CAST(floor(value / 5) AS BIGINT)) AS best FROM events WHERE dayofyear(ts) % 3 <> 0 GROUP BY ALL),
    st AS (SELECT day, lead(day) OVER (ORDER BY day) AS nxt FROM (SELECT DISTINCT day FROM dy)),
    o AS (SELECT nxt AS day, user_id, best FROM dy JOIN st USING (day) WHERE nxt IS NOT NULL)
    SELECT user_id, day, CASE WHEN o.best IS NULL THEN 'addition' WHEN dy.best IS NULL THEN 'removal' ELSE 'change' END AS change
    FROM dy FULL JOIN o USING (user_id, day) WHERE o.best IS DISTINCT FROM dy.best""",
)
def snapshot_diff_gaps(spark, folder):
    """Snapshots of two days in three; each is compared with the one before it that exists."""
    rows = daily_snapshots(spark, folder).where("day % 3 <> 0")
    return snapshots.snapshot_series(rows, ["user_id"], "day", "meaningful_hash")


@query(
    "round_facts",
    """WITH a AS (SELECT l_orderkey, l_suppkey, list(CASE WHEN l_linenumber = 3 AND l_returnflag = 'R' THEN 0 ELSE l_partkey END ORDER BY l_linenumber, l_partkey, l_extendedprice) AS v, min(l_partkey) AS best
      FROM lineitem GROUP BY ALL),
    f AS (SELECT *, len(v) >= 2 AND coalesce(v[1], 0) <> 0 AND coalesce(v[2], 0) <> 0 AS full_ FROM a)
    SELECT 'single' AS kind, count(*) AS facts, CAST(sum(best) AS BIGINT) AS total FROM f WHERE full_
    UNION ALL SELECT 'average', count(*), CAST(sum(best + 1) AS BIGINT) FROM f WHERE full_ AND len(v) <> 0""",
)
def round_facts(spark, folder):
    """Lines of an order and supplier as attempts of a two-attempt result; a zero is not entered yet."""
    line = F.struct("l_linenumber", "l_partkey", "l_extendedprice", F.when((F.col("l_linenumber") == 3) & (F.col("l_returnflag") == "R"), 0).otherwise(F.col("l_partkey")).alias("v"))
    rows = table(spark, folder, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.array_sort(F.collect_list(line)).alias("_l"), F.min("l_partkey").alias("best"))
    rows = rows.select(
        "l_orderkey", "l_suppkey", F.transform("_l", lambda x: x["v"].cast("long")).alias("attempts"), "best", (F.col("best") + 1).alias("average"),
        F.lit("").alias("single_tag"), F.lit("").alias("average_tag"), F.lit(2).alias("expected_attempts"),
        F.lit(None).cast("int").alias("cutoff_attempts"), F.lit(None).cast("int").alias("cutoff_value"))
    found = evidence.round_observations(rows)
    return found.groupBy("kind").agg(F.count(F.lit(1)).alias("facts"), F.sum("value").alias("total"))


@query(
    "newest_detections",
    f"""WITH {_CLAIMS}, d AS (SELECT user_id, level, min(ts) AS detected_at FROM cl WHERE level <> '' GROUP BY ALL),
    o AS (SELECT *, row_number() OVER (ORDER BY detected_at DESC, user_id DESC, level DESC) AS position, count(*) OVER () AS total_count FROM d)
    SELECT position, user_id, level, total_count FROM o WHERE position BETWEEN 21 AND 40""",
)
def newest_detections(spark, folder):
    """The second page of twenty detections, newest first, with the count of all."""
    rows = detections.detections(_claims(spark, folder)).select("stable_identity", "level", "detected_at")
    rows = rows.withColumn("detection_id", F.struct(F.col("stable_identity"), F.col("level")))
    found = feed.page_with_total(rows, 2, feed.newest_detections_first(), 20)
    from pyspark.sql import Window

    place = F.row_number().over(Window.orderBy(*feed.newest_detections_first())) + 20  # of one page
    return found.select(place.cast("long").alias("position"), F.col("stable_identity").alias("user_id"), "level", "total_count")


@query(
    "final_attempts",
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 5 WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 0 END AS expected FROM orders""",
)
def final_attempts(spark, folder):
    """Attempts that formats expect."""
    formats = F.array(F.lit(""), F.lit(" M "), F.lit("2"), F.lit("?"))
    return table(spark, folder, "orders").select(
        "o_orderkey", finalize.expected_attempts(F.get(formats, (F.col("o_orderkey") % 4).cast("int"))).cast("int").alias("expected")
    )


@query(
    "benchmark_first_last",
    """SELECT event_type AS payload_hash, min(event_id) AS first_seen, max(event_id) AS last_seen FROM events GROUP BY ALL""",
)
def benchmark_first_last(spark, folder):
    """First and last fetch of each content."""
    tune(spark)
    rows = events(spark, folder).select(F.col("event_type").alias("payload_hash"), "event_id")
    first = grouping.first_per_key(rows, ["payload_hash"], ["event_id"]).withColumnRenamed("event_id", "first_seen")
    last = grouping.latest_per_key(rows, ["payload_hash"], ["event_id"]).withColumnRenamed("event_id", "last_seen")
    return first.join(last, "payload_hash")


@query(
    "snapshots_by_content",
    """SELECT event_type AS payload_hash, epoch_us(min(ts)) AS first_micros, epoch_us(max(ts)) AS last_micros, min(event_id) AS snapshot_id FROM events GROUP BY ALL""",
)
def snapshots_by_content(spark, folder):
    rows = events(spark, folder).select(F.col("event_type").alias("payload_hash"), F.col("ts").alias("fetched_at"), F.col("event_id").alias("snapshot_id"))
    found = benchmarks.distinct_snapshots(rows)
    return found.select("payload_hash", F.unix_micros("first_fetched_at").alias("first_micros"), F.unix_micros("last_fetched_at").alias("last_micros"), "snapshot_id")


@query(
    "latest_snapshot_rows",
    """WITH s AS (SELECT event_id, date_trunc('day', ts) AS d, user_id % 5 AS n FROM events)
    SELECT event_id FROM s WHERE (d, n) = (SELECT (d, n) FROM s ORDER BY d DESC, n DESC LIMIT 1)""",
)
def latest_snapshot_rows(spark, folder):
    """Rows of the last snapshot of the last day."""
    rows = events(spark, folder).select("event_id", F.date_trunc("day", "ts").alias("fetched_at"), (F.col("user_id") % 5).alias("snapshot_id"))
    return benchmarks.latest_snapshot(rows).select("event_id")


@query(
    "weakest_benchmarks",
    f"""WITH {RES}, b AS (SELECT 'WR' AS level, '' AS region, event_id, kind, min(value) AS value FROM res GROUP BY ALL
      UNION ALL SELECT 'CR', '_' || continent, event_id, kind, min(value) FROM res GROUP BY ALL
      UNION ALL SELECT 'NR', country, event_id, kind, min(value) FROM res WHERE canonical_id % 2 = 0 GROUP BY ALL),
    p AS (SELECT n_nationkey AS code, CASE WHEN n_nationkey % 3 <> 0 THEN n_name END AS name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)
    SELECT event_id, kind, 'N' || code AS country_code, max(value) AS value FROM p JOIN b
      ON level = 'WR' OR (level = 'CR' AND region = '_' || r_name) OR (level = 'NR' AND region = name) GROUP BY ALL""",
)
def weakest_benchmarks(spark, folder):
    """The easiest benchmark of each country; some countries have no name in the records list."""
    rows = results(spark, folder)

    def best(level, region, of=rows):
        return of.groupBy("event_id", "kind", region.alias("region")).agg(F.min("value").alias("value")).withColumn("level", F.lit(level))

    national = best("NR", F.col("country"), rows.where("canonical_id % 2 = 0"))
    listed = best("WR", F.lit("")).unionByName(best("CR", F.concat(F.lit("_"), "continent"))).unionByName(national)
    places = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.concat(F.lit("N"), "n_nationkey").alias("country_code"), F.col("r_name").alias("continent"),
        F.when(F.col("n_nationkey") % 3 != 0, F.col("n_name")).alias("records_name"))
    return benchmarks.weakest_per_country(listed, places)


@query(
    "evidence_flags",
    f"""WITH o AS (SELECT l_orderkey, l_linenumber AS value, bool_or(l_suppkey % 2 = 0) AS second, bool_or(l_partkey % 3 = 0) AS trusted
      FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL)
    SELECT o_orderkey AS canonical_id, coalesce(second, false) AND o_orderkey % 7 > 0 AS checked, coalesce(trusted, false) AS trusted
    FROM orders LEFT JOIN o ON l_orderkey = o_orderkey AND value = o_orderkey % 7""",
)
def evidence_flags(spark, folder):
    """Order numbers as values, lines as observations of them by two sources and methods."""
    heads = table(spark, folder, "orders").select(F.col("o_orderkey").alias("canonical_id"), (F.col("o_orderkey") % 7).alias("value"))
    seen = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("canonical_id"), F.col("l_linenumber").cast("long").alias("value"),
        F.when(F.col("l_returnflag") == "R", "retracted").otherwise("active").alias("status"),
        F.when(F.col("l_suppkey") % 2 == 0, fixed.SECOND_SOURCE).otherwise("other").alias("source"),
        F.when(F.col("l_partkey") % 3 == 0, fixed.POLLED).otherwise(fixed.SOCKET).alias("method"))
    return benchmarks.evidence_flags(heads, seen).select("canonical_id", "checked", "trusted")


@query(
    "unlinked_frames",
    """SELECT event_id, CASE WHEN ts >= TIMESTAMP '2024-01-20' - INTERVAL 5 DAY THEN event_id END AS raw_id FROM events""",
)
def unlinked_frames(spark, folder):
    """Observations keep their row when retention drops the raw frame."""
    rows = events(spark, folder)
    kept = upkeep.expire_frames(rows.select(F.col("event_id").alias("frame_id"), F.col("ts").alias("observed_at")), 5, F.lit("2024-01-20").cast("timestamp"))
    return upkeep.unlink_expired(rows.select("event_id", F.col("event_id").alias("raw_id")), kept).select("event_id", "raw_id")


@query(
    "first_revision_actions",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'retracted' WHEN 'P' THEN 'corrected' ELSE 'active' END AS action FROM orders""",
)
def first_revision_actions(spark, folder):
    state = F.when(F.col("o_orderstatus") == "F", "retracted").when(F.col("o_orderstatus") == "P", "corrected").otherwise("pending")
    return upkeep.first_revisions(table(spark, folder, "orders").select("o_orderkey", state.alias("status"))).select("o_orderkey", "action")


@query(
    "rounds_rediscovered",
    """WITH e AS (SELECT o_custkey % 50 AS slug, o_orderpriority AS event_id, o_orderkey AS round_id, o_orderkey % 4 <> 0 AS active FROM orders WHERE o_orderkey % 3 <> 0),
    f AS (SELECT o_custkey % 50 AS slug, o_orderpriority AS event_id, o_orderkey AS round_id FROM orders WHERE o_orderkey % 5 = 0 AND o_custkey % 50 < 20),
    l AS (SELECT DISTINCT slug, true AS listed FROM f)
    SELECT slug, event_id, round_id, CASE WHEN f.round_id IS NOT NULL THEN true WHEN listed THEN false ELSE e.active END AS active
    FROM e FULL JOIN f USING (slug, event_id, round_id) LEFT JOIN l USING (slug)""",
)
def rounds_rediscovered(spark, folder):
    rows = table(spark, folder, "orders").select(
        (F.col("o_custkey") % 50).alias("slug"), F.col("o_orderpriority").alias("event_id"), F.col("o_orderkey").alias("round_id"))
    existing = rows.where("round_id % 3 <> 0").withColumn("active", F.col("round_id") % 4 != 0)
    return rounds.retire_missing_rounds(existing, rows.where("round_id % 5 = 0 AND slug < 20")).select("slug", "event_id", "round_id", "active")


@query(
    "targets_discovered",
    """WITH o AS (SELECT o_orderkey AS slug, CAST(o_orderdate AS DATE) AS d FROM orders),
    e AS (SELECT slug, slug + 1000000 AS live_id, d AS end_date FROM o WHERE slug % 2 = 0),
    f AS (SELECT slug, CASE WHEN slug % 5 <> 0 THEN slug + 2000000 END AS live_id, d + 1 AS end_date, slug % 7 <> 0 AS ok FROM o WHERE slug % 3 = 0),
    j AS (SELECT coalesce(e.slug, f.slug) AS slug, e.slug IS NOT NULL AS known, f.slug IS NOT NULL AS listed, coalesce(ok, false) AS ok, e.live_id AS old_id, f.live_id AS new_id,
      CASE WHEN coalesce(ok, false) THEN f.end_date ELSE e.end_date END AS fin, f.end_date AS fend FROM e FULL JOIN f ON e.slug = f.slug),
    c AS (SELECT *, ok AND new_id IS NOT NULL AS ready, TIMESTAMP '1998-06-01' <= CAST(fin + 1 AS TIMESTAMP) + INTERVAL 12 HOUR AS due FROM j WHERE known OR ok),
    a AS (SELECT *, known OR ok AS act FROM c)
    SELECT slug, CASE WHEN ready THEN new_id ELSE old_id END AS live_id,
      CASE WHEN act AND (NOT listed OR NOT due) THEN 'retired' WHEN ready THEN CASE WHEN due THEN 'active' ELSE 'pending' END WHEN known THEN 'active' ELSE 'pending' END AS status,
      act AND NOT (NOT listed OR NOT due) AS active FROM a""",
)
def targets_discovered(spark, folder):
    """Orders as known and listed targets: some not listed, not ready or not verified."""
    rows = table(spark, folder, "orders").select(F.col("o_orderkey").alias("slug"), F.col("o_orderdate").cast("date").alias("d"))
    text_ = lambda name: F.lit("").alias(name)
    existing = rows.where("slug % 2 = 0").select(
        "slug", (F.col("slug") + 1_000_000).alias("live_id"), text_("official_id"), text_("name"), F.col("d").alias("start_date"),
        F.col("d").alias("end_date"), F.lit("active").alias("status"), F.lit(True).alias("active"), text_("last_error"))
    found = rows.where("slug % 3 = 0").select(
        "slug", F.when(F.col("slug") % 5 != 0, F.col("slug") + 2_000_000).alias("live_id"), text_("official_id"), text_("name"),
        F.col("d").alias("start_date"), F.date_add("d", 1).alias("end_date"), text_("error"), (F.col("slug") % 7 != 0).alias("detail_verified"))
    merged = rounds.merge_discovery(existing, found, F.lit("1998-06-01").cast("timestamp"))
    return merged.select("slug", "live_id", "status", "active")


@query(
    "detections_described",
    f"""WITH {_CLAIMS}, d AS (SELECT user_id, level, arg_max(value, seq) AS value FROM cl WHERE level <> '' GROUP BY ALL)
    SELECT user_id, level, CASE WHEN user_id % 2 = 0 THEN 'wca|OPEN|P' || user_id || '|333|1|single|' ELSE 'stream:R' || user_id || '|single|' END || level AS comparison_key,
      CASE WHEN value < 100 THEN '0.' || lpad(CAST(value AS VARCHAR), 2, '0') ELSE (value // 100) || '.' || lpad(CAST(value % 100 AS VARCHAR), 2, '0') END AS formatted FROM d""",
)
def detections_described(spark, folder):
    """Detections with the key and text of their result; odd users have no competition."""
    found = detections.detections(_claims(spark, folder)).withColumn("stable_identity", F.col("stable_identity").cast("string"))
    own = F.col("stable_identity")
    candidates = events(spark, folder).select(F.col("user_id").cast("string").alias("stable_identity")).distinct().select(
        "stable_identity", F.when(own.cast("long") % 2 == 0, "OPEN").alias("competition_id"), F.concat(F.lit("P"), own).alias("person_id"),
        F.lit("333").alias("event_id"), F.lit(1).alias("round_number"), F.lit("stream").alias("source"), F.concat(F.lit("R"), own).alias("source_result_id"))
    rows = detections.described(found, candidates)
    return rows.select(own.cast("long").alias("user_id"), "level", "comparison_key", "formatted")


@query(
    "attendance_nested",
    """SELECT o_orderkey, c_name AS competitor, n_name AS competition FROM orders JOIN customer ON o_custkey = c_custkey
    JOIN nation ON o_orderkey % 30 = n_nationkey""",
)
def attendance_nested(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("person_id"), (F.col("o_orderkey") % 30).alias("source_key"))
    people = table(spark, folder, "customer").select(F.col("c_custkey").alias("person_id"), F.col("c_name").alias("name"))
    places = table(spark, folder, "nation").select(F.col("n_nationkey").alias("source_key"), F.col("n_name").alias("name"))
    found = attendance.attendance_table(rows, people, places)
    return found.select("o_orderkey", F.col("competitor.name").alias("competitor"), F.col("competition.name").alias("competition"))


@query(
    "competition_countries",
    """SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'JP' WHEN 1 THEN 'N' || s_nationkey ELSE '' END AS country, s_suppkey % 4 = 0 AS no_format FROM supplier""",
)
def competition_countries(spark, folder):
    """Countries stated, taken from the first venue, or unknown; and rounds without a format."""
    kind = F.col("s_suppkey") % 3
    venue = F.struct(F.struct(F.concat(F.lit("N"), "s_nationkey").alias("iso2")).alias("country"))
    venues = F.when(kind == 1, F.array(venue)).otherwise(F.array().cast("array<struct<country:struct<iso2:string>>>"))
    rows = table(spark, folder, "supplier").select(
        "s_suppkey", status.competition_country(F.when(kind == 0, "JP").otherwise(""), venues).alias("country"),
        F.when(F.col("s_suppkey") % 4 != 0, 5).alias("expected_attempts"))
    open_ = rounds.rounds_without_format(rows).select("s_suppkey", F.lit(True).alias("_open"))
    return rows.join(open_, "s_suppkey", "left").select("s_suppkey", "country", F.coalesce("_open", F.lit(False)).alias("no_format"))
