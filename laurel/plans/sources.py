"""Source queries: text export, JSON payloads and HTML pages made from the given tables."""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import functions as F

from laurel.operators import baseline as cells
from laurel.plans import jobs
from laurel.plans.catalog import query
from laurel.plans.tables import RES, events, results, table, tune
from laurel.session import shared_folder
from laurel.sources import export, html_pages, payloads, publish

_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@query(
    "table_row_counts",
    " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in _TABLES),
)
def table_row_counts(spark, folder):
    return export.row_counts({t: table(spark, folder, t) for t in _TABLES})


@query(
    "json_flatten",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""",
)
def json_flatten(spark, folder):
    return events(spark, folder).select(
        "event_id", F.from_json("props", "struct<k:bigint>")["k"].alias("k")
    )


def _official(column):
    names = {"1-URGENT": "222", "2-HIGH": "333", "3-MEDIUM": "444", "4-NOT SPECIFIED": "555", "5-LOW": "666"}
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.col(column))


def _write_export(spark, folder, root, rows):
    """An unpacked export whose ranks and results are ``rows``; its tables are folders of text parts."""
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    ranks = rows.select("person_id", _official("event_id").alias("event_id"), F.col("value").alias("best"), "kind")
    dates = rows.select("competition_id", F.date_trunc("month", "at").alias("_m")).distinct()
    tables = {
        "continents": region.select(F.concat(F.lit("_"), "r_regionkey").alias("id"), F.col("r_name").alias("name")),
        "countries": nation.select(
            F.col("n_nationkey").alias("id"),
            F.col("n_name").alias("name"),
            F.concat(F.lit("_"), "n_regionkey").alias("continent_id"),
        ),
        "persons": table(spark, folder, "customer").select(
            F.col("c_custkey").alias("wca_id"), F.lit("1").alias("sub_id"), F.col("c_nationkey").alias("country_id")
        ),
        "ranks_single": ranks.where("kind = 'single'").drop("kind"),
        "ranks_average": ranks.where("kind = 'average'").drop("kind"),
        "competitions": dates.select(
            F.col("competition_id").alias("id"),
            F.year("_m").alias("end_year"),
            F.month("_m").alias("end_month"),
            F.lit(28).alias("end_day"),
        ),
        "results": rows.select(
            (F.col("canonical_id") + 1).alias("id"),
            F.when(F.col("kind") == "average", F.col("value")).otherwise(-1).alias("average"),
            "competition_id",
            F.lit("X").alias("person_country_id"),
            "person_id",
            _official("event_id").alias("event_id"),
            F.lit("f").alias("round_type_id"),
        ),
        "result_attempts": rows.where("kind = 'single'").select(
            "value", F.lit(1).alias("attempt_number"), (F.col("canonical_id") + 1).alias("result_id")
        ),
    }
    for name, df in tables.items():
        export.write_tsv(df, f"{root}/{name}.tsv")
    metadata = spark.range(1).select(F.lit("v2.0").alias("export_format_version"), F.lit("1996-01-01 00:00:00 UTC").alias("export_date"))
    metadata.coalesce(1).write.json(f"{root}/metadata.json")


@query(
    "export_baseline",
    f"""WITH {RES}, lv AS (SELECT 'WR' AS level, 'World' AS scope, * FROM res UNION ALL SELECT 'CR', continent, * FROM res
      UNION ALL SELECT 'NR', country, * FROM res UNION ALL SELECT 'PR', person_id, * FROM res)
    SELECT level, CASE event_id WHEN '1-URGENT' THEN '222' WHEN '2-HIGH' THEN '333' WHEN '3-MEDIUM' THEN '444' WHEN '4-NOT SPECIFIED' THEN '555' ELSE '666' END AS event_id,
      kind, scope, min(value) AS value FROM lv GROUP BY ALL""",
)
def export_baseline(spark, folder):
    """The tables written as a text export, read back and projected to record cells."""
    tune(spark)
    root = f"{shared_folder(spark)}/export-{uuid.uuid4().hex}"
    _write_export(spark, folder, root, results(spark, folder))
    names = ("continents", "countries", "persons", "ranks_single", "ranks_average")
    return cells.export_baseline({name: export.read_tsv(spark, f"{root}/{name}.tsv") for name in names})


_EVENT_ID = "CASE event_id WHEN '1-URGENT' THEN '222' WHEN '2-HIGH' THEN '333' WHEN '3-MEDIUM' THEN '444' WHEN '4-NOT SPECIFIED' THEN '555' ELSE '666' END"


@query(
    "published_live_cells",
    f"""WITH {RES}, kept AS (
      SELECT * FROM res WHERE tm < TIMESTAMP '1996-01-01' OR (canonical_id % 5 <> 0 AND canonical_id % 7 <> 0)),
    lv AS (SELECT 'WR' AS level, 'World' AS scope, * FROM kept UNION ALL SELECT 'CR', continent, * FROM kept
      UNION ALL SELECT 'NR', country, * FROM kept UNION ALL SELECT 'PR', person_id, * FROM kept)
    SELECT level, {_EVENT_ID} AS event_id, kind, scope, min(value) AS value FROM lv GROUP BY ALL""",
)
def published_live_cells(spark, folder):
    """A refresh is published, a second one fails its check, and the first one is what readers get."""
    tune(spark)
    root = f"{shared_folder(spark)}/refresh-{uuid.uuid4().hex}"
    rows = results(spark, folder)
    old = rows.where(F.col("at") < F.lit("1996-01-01").cast("timestamp"))
    _write_export(spark, folder, f"{root}/good", old)
    # Heads of all results: those of the export are absorbed, some others retracted or incomplete.
    retracted = (F.col("canonical_id") % 5 == 0) & (F.col("at") >= F.lit("1996-01-01").cast("timestamp"))
    heads = rows.withColumns(
        {
            "event_id": _official("event_id"),
            "action": F.when(retracted, "retracted").otherwise("created"),
            "status": F.lit("active"),
            "validation_status": F.lit("verified"),
            "entered_at": F.col("at"),
            "first_observed_at": F.col("at"),
            "value": F.when(F.col("canonical_id") % 7 == 0, -1).otherwise(F.col("value")).cast("long"),
        }
    )
    as_of = datetime(1996, 1, 1, tzinfo=UTC)
    jobs.refresh_from_export(spark, f"{root}/good", f"{root}/releases", heads, as_of)
    _write_export(spark, folder, f"{root}/bad", old.limit(0))
    try:
        jobs.refresh_from_export(spark, f"{root}/bad", f"{root}/releases", heads, as_of)
    except Exception as refused:  # noqa: BLE001 - a task's error arrives as one of several classes
        if "empty" not in str(refused) and "no cells" not in str(refused):
            raise
    else:
        raise AssertionError("An empty export was published")
    return publish.published(spark, f"{root}/releases", "live_cells")


def _record_payload(tag, second, zone="Europe/Amsterdam"):
    """A result row as a nested record claim with this tag and second attempt."""
    s = F.struct
    venue = s(
        F.lit("Hall").alias("name"),
        F.lit(zone).alias("timezone"),
        s(F.lit("NL").alias("iso2")).alias("country"),
    )
    competition = s(
        F.col("competition_id").alias("id"),
        F.col("competition_id").alias("wcaId"),
        F.lit("Open").alias("name"),
        F.date_format("at", "yyyy-MM-dd").alias("startDate"),
        F.date_format("at", "yyyy-MM-dd").alias("endDate"),
        F.array(venue).alias("venues"),
    )
    rnd = s(
        F.date_format("at", "yyyyMM").alias("id"),
        F.col("round_number").alias("number"),
        s(F.lit(2).alias("numberOfAttempts")).alias("format"),
        s(
            s(F.col("event_id").alias("id"), F.col("event_id").alias("name")).alias("event"),
            competition.alias("competition"),
        ).alias("competitionEvent"),
    )
    return F.to_json(s(
        F.col("canonical_id").cast("string").alias("id"),
        F.col("kind").alias("type"),
        tag.alias("tag"),
        F.col("value").alias("attemptResult"),
        s(
            F.col("canonical_id").cast("string").alias("id"),
            F.array(s(F.col("value").alias("result")), s(second.alias("result"))).alias("attempts"),
            F.col("value").alias("best"),
            F.col("value").alias("average"),
            F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("enteredAt"),
            s(F.col("person_id").alias("id"), F.col("person_id").alias("wcaId")).alias("person"),
            rnd.alias("round"),
        ).alias("result"),
    ))


@query(
    "recent_records_parsed",
    f"""WITH {RES} SELECT CAST(canonical_id AS VARCHAR) AS stable_identity, competition_id, person_id, event_id, kind, value,
      'WR' AS level, CAST(round_number AS INTEGER) AS round_number, 'Europe/Amsterdam' AS competition_timezone, epoch_us(tm) AS entered,
      round_number <> 1 AS final FROM res""",
)
def recent_records_parsed(spark, folder):
    """Each result as a nested record payload, parsed back; round 1 has an unfinished attempt."""
    second = F.when(F.col("round_number") == 1, 0).otherwise(F.col("value"))
    payload = _record_payload(F.lit("wr"), second)
    frames = results(spark, folder).select(payload.alias("payload"))
    return payloads.recent_records(frames).where(F.col("error").isNull()).select(
        "stable_identity",
        "competition_id",
        "person_id",
        "event_id",
        "kind",
        "value",
        "level",
        "round_number",
        "competition_timezone",
        F.unix_micros("entered_at").alias("entered"),
        "final",
    )


@query(
    "poll_batches",
    f"""WITH {RES}, c AS (
      SELECT canonical_id AS id, canonical_id AS seq, 'WR' AS level, round_number <> 1 AS fin, canonical_id % 13 = 0 AS bad, false AS dup FROM res
      UNION ALL SELECT canonical_id, canonical_id + 1000000000, 'WR', round_number <> 1, canonical_id % 13 = 0, true FROM res WHERE canonical_id % 9 = 0
      UNION ALL SELECT canonical_id, canonical_id + 2000000000, 'NR', true, false, false FROM res WHERE canonical_id % 6 = 0
      UNION ALL SELECT canonical_id, canonical_id + 3000000000, 'WR', false, false, round_number = 1 AND canonical_id % 13 <> 0 FROM res WHERE canonical_id % 10 = 0),
    k AS (SELECT *, lead(level) OVER w AS nxt, lag(fin) OVER w AS before FROM c WHERE NOT bad AND NOT dup WINDOW w AS (PARTITION BY id ORDER BY seq)),
    d AS (SELECT id, level, arg_max(nxt IS NULL, seq) AS active FROM k GROUP BY ALL)
    SELECT 'found' AS measure, count(*) AS rows FROM c UNION ALL SELECT 'malformed', count(*) FROM c WHERE bad
    UNION ALL SELECT 'new', count(*) FROM d UNION ALL SELECT 'ignored', (SELECT count(*) FROM c WHERE NOT bad) - (SELECT count(*) FROM d)
    UNION ALL SELECT level || CASE WHEN active THEN ' active' ELSE ' withdrawn' END, count(*) FROM d GROUP BY 1
    UNION ALL SELECT 'observe', count(*) FROM k WHERE fin UNION ALL SELECT 'retract', count(*) FROM k WHERE NOT fin AND before
    UNION ALL SELECT 'zone filled', count(*) FROM k WHERE fin""",
)
def poll_batches(spark, folder):
    """Claims of all results polled in four rounds: first claims, repeats, other levels, unfinished ones."""
    rows = results(spark, folder)
    own, poll = F.col("canonical_id"), F.col("poll_id")
    every = F.array(*[F.struct(F.lit(n).alias("poll"), F.lit(e).alias("every")) for n, e in enumerate((1, 9, 6, 10))])
    asked = F.transform(F.filter(every, lambda c: own % c["every"] == 0), lambda c: c["poll"])
    # A payload is made for a claim that is polled only, by as many tasks as a shuffle has: a table of one file is read by few.
    claims = rows.withColumn("poll_id", F.explode(asked)).repartition("canonical_id", "poll_id")
    open_ = F.when(F.col("round_number") == 1, 0).otherwise(F.col("value"))
    second = F.when(poll == 3, 0).when(poll == 2, F.col("value")).otherwise(open_).cast("long")
    payload = _record_payload(F.when(poll == 2, "nr").otherwise("wr"), second, "")
    polled = claims.select(
        "poll_id",
        (own + poll.cast("long") * 1_000_000_000).alias("seq"),
        F.col("at").alias("observed_at"),
        F.when((own % 13 == 0) & (poll < 2), "{}").otherwise(payload).alias("payload"),
    )
    rounds = rows.select(F.col("competition_id").alias("round_id"), "competition_id", F.lit("Asia/Tokyo").alias("competition_timezone")).distinct()
    out = jobs.ingest_polls(polled, rounds)
    totals = out["statistics"].agg(
        *[F.sum(c).alias(n) for c, n in (("records_found", "found"), ("malformed", "malformed"), ("new_observations", "new"), ("duplicates_ignored", "ignored"))]
    )
    counts = totals.unpivot([], ["found", "malformed", "new", "ignored"], "measure", "rows")
    states = out["detections"].groupBy(F.concat_ws(" ", "level", "status").alias("measure")).agg(F.count(F.lit(1)).alias("rows"))
    ops = out["log"].groupBy(F.col("op").alias("measure")).agg(F.count(F.lit(1)).alias("rows"))
    zones = out["log"].where("op = 'observe' AND competition_timezone = 'Asia/Tokyo'").agg(F.count(F.lit(1)).alias("rows"))
    return counts.unionByName(states).unionByName(ops).unionByName(zones.select(F.lit("zone filled").alias("measure"), "rows"))


# An order's lines make this many documents (by part), each of all its lines.
PAGES_PER_ORDER = 2
_LINES = f"""ln AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, CAST(floor(l_extendedprice) AS BIGINT) AS price,
  l_returnflag, l_partkey % {PAGES_PER_ORDER} AS page FROM lineitem)"""


def _order_lines(spark, folder):
    """Documents of an order's lines, in a fixed order; line numbers may repeat in one document."""
    line = F.struct("l_linenumber", "l_suppkey", "l_partkey", F.floor("l_extendedprice").cast("long").alias("price"), "l_returnflag")
    pages = table(spark, folder, "lineitem").select("l_orderkey", (F.col("l_partkey") % PAGES_PER_ORDER).alias("page"), line.alias("line"))
    return pages.groupBy("l_orderkey", "page").agg(F.sort_array(F.collect_list("line")).alias("lines"))


@query(
    "round_snapshots_parsed",
    f"""WITH {_LINES}, d AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, page, l_linenumber ORDER BY l_suppkey DESC, l_partkey DESC, price DESC, l_returnflag DESC) AS n FROM ln)
    SELECT l_orderkey, page, CAST(l_linenumber AS VARCHAR) AS result_id, price AS best,
      CASE l_returnflag WHEN 'R' THEN 'NR' WHEN 'A' THEN 'CR' ELSE '' END AS single_tag FROM d WHERE n = 1""",
)
def round_snapshots_parsed(spark, folder):
    """Each document as a round snapshot with a result per line; a repeated id takes the last row."""
    tag = lambda l: F.when(l["l_returnflag"] == "R", "nr").when(l["l_returnflag"] == "A", "cr")  # noqa: E731, E741
    rows = F.transform(
        "lines",
        lambda l: F.struct(  # noqa: E741
            l["l_linenumber"].cast("string").alias("id"),
            F.array(F.struct(l["price"].alias("result"))).alias("attempts"),
            l["price"].alias("best"),
            tag(l).alias("singleRecordTag"),
            F.struct(l["l_suppkey"].cast("string").alias("id")).alias("person"),
        ),
    )
    frames = _order_lines(spark, folder).select(
        "l_orderkey",
        "page",
        F.to_json(F.struct(F.col("l_orderkey").cast("string").alias("id"), rows.alias("results"))).alias("payload"),
    )
    parsed = payloads.round_results(frames).where(F.col("error").isNull())
    return parsed.select("l_orderkey", "page", "result_id", F.col("best").cast("long").alias("best"), "single_tag")


@query(
    "compact_rows_parsed",
    f"""WITH {_LINES} SELECT l_orderkey, CAST(l_partkey AS VARCHAR) AS result_id, l_suppkey AS competitor_number,
      'Supplier ' || l_suppkey AS person_name, CASE l_returnflag WHEN 'R' THEN 'CR' ELSE 'WR' END AS single_tag,
      CASE WHEN l_returnflag = 'N' THEN 'result belongs to an unexpected event' END AS error FROM ln""",
)
def compact_rows_parsed(spark, folder):
    """Lines as compact rows with a roster; rows with flag N name another event."""
    rows = F.transform(
        "lines",
        lambda l: F.struct(  # noqa: E741
            l["l_partkey"].alias("i"),
            F.lit(7).alias("c"),
            l["l_suppkey"].alias("n"),
            F.when(l["l_returnflag"] == "N", "444").otherwise("333").alias("e"),
            F.lit("1").alias("r"),
            F.lit("a").alias("f"),
            l["price"].alias("b"),
            F.array(l["price"]).alias("v"),
            F.when(l["l_returnflag"] == "R", " AsR ").otherwise("wr").alias("sr"),
        ),
    )
    users = F.map_from_entries(
        F.array_distinct(
            F.transform(
                "lines",
                lambda l: F.struct(  # noqa: E741
                    l["l_suppkey"].cast("string"),
                    F.struct(F.concat(F.lit("Supplier "), l["l_suppkey"].cast("string")).alias("name")),
                ),
            )
        )
    )
    frames = _order_lines(spark, folder).select(
        "l_orderkey",
        F.to_json(rows).alias("payload"),
        F.to_json(users).alias("users"),
        F.lit(7).alias("expected_competition"),
        F.lit("333").alias("expected_event"),
        F.lit("1").alias("expected_round"),
    )
    return payloads.compact_results(frames).select(
        "l_orderkey", "result_id", "competitor_number", "person_name", "single_tag", "error"
    )


@query(
    "record_list_parsed",
    """WITH c AS (SELECT n_name, r_name, o_orderpriority AS event_id, CASE WHEN o_orderstatus = 'P' THEN 'average' ELSE 'single' END AS kind,
        CAST(floor(o_totalprice) AS BIGINT) + 1 AS v FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
    SELECT 'WR' AS level, event_id, kind, '' AS region, min(v) AS value FROM c GROUP BY ALL
    UNION ALL SELECT 'CR', event_id, kind, '_' || r_name, min(v) FROM c GROUP BY ALL
    UNION ALL SELECT 'NR', event_id, kind, n_name, min(v) FROM c GROUP BY ALL""",
)
def record_list_parsed(spark, folder):
    """Best values as one nested record list (its size is set by places and events), parsed back."""
    nation = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    rows = (
        table(spark, folder, "orders")
        .join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.inline(
                F.array(
                    F.struct(F.lit("W").alias("l"), F.lit("").alias("region")),
                    F.struct(F.lit("C").alias("l"), F.concat(F.lit("_"), "r_name").alias("region")),
                    F.struct(F.lit("N").alias("l"), F.col("n_name").alias("region")),
                )
            ),
            F.col("o_orderpriority").alias("e"),
            F.when(F.col("o_orderstatus") == "P", "average").otherwise("single").alias("k"),
            (F.floor("o_totalprice").cast("int") + 1).alias("v"),
        )
    )

    def nested(df, keys, name, value):
        entries = F.map_from_entries(F.collect_list(F.struct(name, value)))
        return df.groupBy(*keys).agg(entries.alias("m"))

    best = rows.groupBy("l", "region", "e", "k").agg(F.min("v").alias("v"))
    per_event = nested(best, ["l", "region", "e"], "k", "v")
    per_region = nested(per_event, ["l", "region"], "e", "m")
    places = nested(per_region, ["l"], "region", "m")
    pick = lambda level: F.max(F.when(F.col("l") == level, F.to_json("m")))
    whole = places.agg(pick("W").alias("w"), pick("C").alias("c"), pick("N").alias("n"))
    world = F.to_json(F.from_json("w", "map<string,map<string,map<string,int>>>")[""])
    payload = F.concat(
        F.lit('{"world_records":'), world, F.lit(',"continental_records":'), "c", F.lit(',"national_records":'), "n", F.lit("}")
    )
    parsed = payloads.record_benchmarks(whole.select(payload.alias("payload")))
    return parsed.select("level", "event_id", "kind", "region", "value")


@query(
    "html_registrations",
    f"""WITH {_LINES} SELECT l_orderkey, printf('2000ABCD%02d', l_suppkey % 100) AS person_id, 'Supplier ' || l_suppkey AS name, 'Chinese Taipei' AS region
    FROM ln WHERE l_returnflag <> 'N'""",
)
def html_registrations(spark, folder):
    """Registration pages with a row per line; flag N is a first-timer."""
    row = lambda l: F.format_string(  # noqa: E731, E741
        '<tr><td>%d</td><td><a href="/results/person/%s">Supplier %d</a></td><td> Chinese  Taipei </td></tr>',
        l["l_linenumber"],
        F.when(l["l_returnflag"] == "N", "").otherwise(
            F.format_string("2000ABCD%02d", l["l_suppkey"] % 100)
        ),
        l["l_suppkey"],
    )
    page = F.concat(
        F.lit('<html><table><tr><td>menu</td></tr></table><table><thead><tr><th>No.</th><th class="header-username">Name</th><th class="header-region">Region</th></tr></thead><tbody>'),
        F.array_join(F.transform("lines", row), ""),
        F.lit("</tbody></table></html>"),
    )
    pages = _order_lines(spark, folder).select("l_orderkey", page.alias("html"))
    rows = html_pages.registrations(html_pages.page_tables(pages)).where(F.col("error").isNull())
    return rows.select("l_orderkey", "person_id", "name", F.regexp_replace("region", r"\s+", " ").alias("region"))


@query(
    "html_competition_index",
    """SELECT l_orderkey, 'slug-' || l_partkey AS source_id, CAST(l_shipdate AS DATE) AS start_date,
      CASE l_returnflag WHEN 'R' THEN 'TW' ELSE 'CN' END AS country_code FROM lineitem""",
)
def html_competition_index(spark, folder):
    """Index pages of an order's lines, listing a competition each."""
    row = F.format_string(
        '<tr><td>%s~%s</td><td><a href="https://x/competition/slug-%d?lang=en">C &amp; %d</a></td><td>%s</td><td>City</td><td>-</td></tr>',
        F.date_format("l_shipdate", "yyyy-MM-dd"),
        F.date_format("l_shipdate", "dd"),
        "l_partkey",
        "l_partkey",
        F.when(F.col("l_returnflag") == "R", "Chinese Taipei").otherwise("Sichuan"),
    )
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey", (F.col("l_partkey") % PAGES_PER_ORDER).alias("page"))
    pages = lines.agg(F.array_join(F.collect_list(row), "").alias("rows")).select(
        "l_orderkey",
        F.concat(
            F.lit("<table><thead><tr><th>Date</th><th>Competition Name</th></tr></thead><tbody>"),
            "rows",
            F.lit("</tbody></table>"),
        ).alias("html"),
    )
    found = html_pages.competition_index(html_pages.page_tables(pages)).where(F.col("error").isNull())
    return found.select("l_orderkey", "source_id", "start_date", "country_code")


@query(
    "html_live_rounds",
    f"""WITH {_LINES} SELECT l_orderkey, page, CAST(l_partkey AS VARCHAR) AS round_id, l_returnflag AS format,
      row_number() OVER (PARTITION BY l_orderkey, page ORDER BY l_linenumber, l_suppkey, l_partkey, price, l_returnflag) AS round_number FROM ln""",
)
def html_live_rounds(spark, folder):
    """Live pages whose container lists a round per line; a round's number is its place."""
    rounds = F.transform(
        "lines",
        lambda l: F.struct(l["l_partkey"].cast("string").alias("i"), l["l_returnflag"].alias("f")),  # noqa: E741
    )
    event = F.array(F.struct(F.lit("333").alias("i"), rounds.alias("rs")))
    attribute = F.replace(F.to_json(event), F.lit('"'), F.lit("&quot;"))
    page = F.concat(
        F.lit('<html><div id="live-container" data-c="7" data-type="WCA" data-events="'), attribute, F.lit('"></div></html>')
    )
    pages = _order_lines(spark, folder).select("l_orderkey", "page", page.alias("html"))
    found = html_pages.live_rounds(pages).where(F.col("error").isNull())
    return found.select("l_orderkey", "page", "round_id", "format", F.col("round_number").cast("long").alias("round_number"))


@query(
    "html_pages_checked",
    """SELECT CASE page_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'page cannot be read' ELSE 'live container was not found' END AS outcome,
      count(*) AS pages FROM pages GROUP BY ALL""",
)
def html_pages_checked(spark, folder):
    """Raw pages tried as live pages: some have a live container added, some are broken, the rest say so."""
    number = F.col("page_id") % 4
    live = '<div id="live-container" data-c="7" data-type="WCA" data-events="[{&quot;i&quot;:&quot;333&quot;,&quot;rs&quot;:[{&quot;i&quot;:&quot;1&quot;}]}]"></div>'
    pages = table(spark, folder, "pages").withColumn("html", F.when(number == 0, F.concat(F.lit(live), "html")).when(number == 1, F.concat(F.lit("<![foo bar]>"), "html")).otherwise(F.col("html")))
    tabled = html_pages.registrations(html_pages.page_tables(pages.where(number == 1)))
    broken = tabled.select("page_id", F.substring_index("error", ":", 1).alias("outcome"))
    found = html_pages.live_rounds(pages.where(number != 1))
    once = found.select("page_id", F.coalesce("error", F.lit("ok")).alias("outcome")).unionByName(broken).distinct()
    return once.groupBy("outcome").agg(F.count(F.lit(1)).alias("pages"))
