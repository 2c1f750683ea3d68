"""JSON payloads of the result sources as flat rows; malformed ones keep an ``error``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laurel.functions import finalize, times
from laurel.functions.keys import content_hash, valid_person_id
from laurel.functions.text import plain_continent, record_tag
from laurel.functions.times import single_venue_zone

_VENUES = "array<struct<name:string,timezone:string,country:struct<iso2:string>>>"
_PERSON = "struct<id:string,wcaId:string,name:string,country:struct<iso2:string>>"
_ATTEMPTS = "array<struct<result:int>>"
RECENT_RECORD = (
    "struct<id:string,type:string,tag:string,attemptResult:int,result:struct<id:string,"
    f"attempts:{_ATTEMPTS},best:int,average:int,enteredAt:string,person:{_PERSON},"
    "round:struct<id:string,number:int,name:string,"
    "format:struct<id:string,shortName:string,numberOfAttempts:int,sortBy:string>,"
    "cutoff:struct<attemptResult:int,numberOfAttempts:int>,"
    "competitionEvent:struct<event:struct<id:string,name:string>,"
    "competition:struct<id:string,wcaId:string,name:string,startDate:string,endDate:string,"
    f"venues:{_VENUES}>>>>>"
)
ROUND_SNAPSHOT = (
    f"struct<id:string,results:array<struct<id:string,ranking:int,attempts:{_ATTEMPTS},best:int,"
    f"average:int,singleRecordTag:string,averageRecordTag:string,enteredAt:string,person:{_PERSON}>>>"
)
COMPACT_ROW = (
    "struct<i:bigint,c:bigint,n:bigint,e:string,r:string,f:string,b:bigint,a:bigint,"
    "v:array<bigint>,sr:string,ar:string>"
)
ROSTER = "map<string,struct<number:int,name:string,wcaid:string,region:string>>"
RECORDS = (
    "struct<world_records:map<string,map<string,int>>,"
    "continental_records:map<string,map<string,map<string,int>>>,"
    "national_records:map<string,map<string,map<string,int>>>>"
)
COMPETITION = (
    f"struct<id:string,wcaId:string,name:string,startDate:string,endDate:string,venues:{_VENUES},"
    "competitionEvents:array<struct<event:struct<id:string,name:string>,rounds:array<struct<id:string,"
    "number:int,name:string,format:struct<id:string,numberOfAttempts:int,sortBy:string>,"
    "cutoff:struct<attemptResult:int,numberOfAttempts:int>>>>>>"
)


# Venues stay JSON texts: their activities nest to any depth.
SCHEDULE = "struct<schedule:struct<venues:array<string>>>"
COMPETITIONS = (
    "array<struct<id:string,name:string,start_date:string,end_date:string,country_iso2:string,"
    "city:string,url:string>>"
)
REGISTRATIONS = (
    "array<struct<user:struct<wca_id:string,name:string,country_iso2:string,"
    "country:struct<iso2:string,continent_id:string>>>>"
)


def _blank(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def _error(*checks: tuple[Column, str]) -> Column:
    """The first failing check's message, else null."""
    out = None
    for failing, message in checks:
        out = F.when(failing, message) if out is None else out.when(failing, message)
    return out


def recent_records(payloads: DataFrame, json: str = "payload") -> DataFrame:
    """Polled record claims as flat candidates; other columns are kept."""
    p = F.col("_p")
    rows = payloads.withColumn("_p", F.from_json(json, RECENT_RECORD))
    result = p["result"]
    rnd, person = result["round"], result["person"]
    competition, event = rnd["competitionEvent"]["competition"], rnd["competitionEvent"]["event"]
    venues = competition["venues"]
    flat = rows.select(
        *payloads.columns,
        result["id"].alias("stable_identity"),
        _blank(competition["id"]).alias("source_competition_id"),
        competition["wcaId"].alias("competition_id"),
        competition["name"].alias("competition_name"),
        _blank(F.get(venues, F.lit(0))["country"]["iso2"]).alias("competition_country"),
        single_venue_zone(venues).alias("competition_timezone"),
        times.iso_date(competition["startDate"]).alias("competition_start"),
        times.iso_date(competition["endDate"]).alias("competition_end"),
        _blank(rnd["id"]).alias("round_id"),
        rnd["number"].alias("round_number"),
        _blank(rnd["name"]).alias("round_name"),
        event["id"].alias("event_id"),
        event["name"].alias("event_name"),
        _blank(person["name"]).alias("person_name"),
        _blank(person["wcaId"]).alias("person_id"),
        _blank(person["id"]).alias("source_competitor_id"),
        _blank(person["country"]["iso2"]).alias("country_code"),
        F.lower(p["type"]).alias("kind"),
        p["attemptResult"].cast("long").alias("value"),
        F.upper(p["tag"]).alias("level"),
        times.strict_instant(result["enteredAt"]).alias("entered_at"),
        F.transform(
            F.coalesce(result["attempts"], F.array().cast(_ATTEMPTS)),
            lambda a: F.coalesce(a["result"], F.lit(0)).cast("long"),
        ).alias("attempts"),
        result["best"].alias("best"),
        result["average"].alias("average"),
        rnd["format"]["numberOfAttempts"].alias("expected_attempts"),
        rnd["cutoff"]["numberOfAttempts"].alias("cutoff_attempts"),
        rnd["cutoff"]["attemptResult"].alias("cutoff_value"),
        times.instant_is_invalid(result["enteredAt"]).alias("_bad_time"),
    )
    required = ("stable_identity", "competition_id", "competition_name", "event_id", "event_name", "kind", "value", "level")
    absent = F.lit(False)
    for name in required:
        absent = absent | F.col(name).isNull()
    no_dates = F.col("competition_start").isNull() | F.col("competition_end").isNull()
    return flat.withColumns(
        {
            "final": finalize.claim_is_final(
                "kind", "value", "attempts", "expected_attempts", "cutoff_attempts", "cutoff_value", "best", "average"
            ),
            "error": _error(
                (absent, "missing field"),
                (no_dates, "invalid date"),
                (F.col("_bad_time"), "invalid timezone-aware datetime"),
            ),
        }
    ).drop("_bad_time")


_MEANINGFUL = (
    "result_id",
    "source_competitor_id",
    "person_id",
    "person_name",
    "country_code",
    "attempts",
    "best",
    "average",
    "single_tag",
    "average_tag",
    "entered_text",
)


def _last_of_each(rows: Column, ident) -> Column:
    """The last element of each id of an array, in the order of ids; null ids count as one."""
    marked = F.transform(rows, lambda r, i: F.struct(ident(r).alias("id"), i.alias("at"), r.alias("row")))

    def last(ordered: Column) -> Column:
        follows = lambda i: F.get(ordered, i + 1)["id"]
        kept = F.filter(ordered, lambda x, i: (i + 1 >= F.size(ordered)) | ~follows(i).eqNullSafe(x["id"]))
        return F.transform(kept, lambda x: x["row"])

    return _once(F.sort_array(marked), last)


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once; inside an inner lambda it would be for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _found(table: Column, key: Column) -> Column:
    """The user of a key in ``entries`` sorted by key, by binary search; a lookup in a map reads it from its start."""
    at = F.aggregate(
        table["steps"],
        F.lit(0),
        lambda low, step: F.when(F.get(table["entries"], low + step - 1)["key"] < key, low + step).otherwise(low),
    )
    entry = F.get(table["entries"], at)
    return F.when(entry["key"] == key, entry["value"])


def _rostered(frames: DataFrame, rows: str, roster: str) -> DataFrame:
    """Adds ``_rows``: the compact rows (``r``), each with its competitor (``user``) from the roster."""
    parsed = frames.withColumns({"_users": F.from_json(roster, ROSTER), "_rows": F.from_json(rows, f"array<{COMPACT_ROW}>")})
    # Of equal keys the first counts.
    entries = F.transform(F.map_entries("_users"), lambda e, i: F.struct(e["key"].alias("key"), i.alias("at"), e["value"].alias("value")))
    steps = F.filter(F.array(*[F.lit(1 << k) for k in range(30, -1, -1)]), lambda step: step <= F.size("_users"))
    table = F.struct(F.sort_array(entries).alias("entries"), steps.alias("steps"))
    paired = _once(
        table, lambda t: F.transform("_rows", lambda r: F.struct(r.alias("r"), _found(t, r["n"].cast("string")).alias("user")))
    )
    return parsed.withColumn("_rows", paired).drop("_users")


def round_results(snapshots: DataFrame, json: str = "payload") -> DataFrame:
    """Rows of full round snapshots of the first source; the last row of an id wins.

    An empty snapshot still gives one row (with null ``result_id``), because it removes results. The
    payload itself is left out.
    """
    kept = [c for c in snapshots.columns if c != json]
    rows = snapshots.withColumn("_p", F.from_json(json, ROUND_SNAPSHOT))
    rows = rows.select(*kept, F.col("_p.id").alias("payload_round_id"), F.col("_p.results").alias("_results"))
    items = rows.select(
        *kept,
        "payload_round_id",
        F.explode_outer(_last_of_each(F.col("_results"), lambda r: r["id"])).alias("_r"),
        F.col("_results").isNull().alias("_broken"),
    )
    r = F.col("_r")
    return items.select(
        *kept,
        r["id"].alias("result_id"),
        "payload_round_id",
        r["person"]["id"].alias("source_competitor_id"),
        _blank(r["person"]["wcaId"]).alias("person_id"),
        _blank(r["person"]["name"]).alias("person_name"),
        _blank(r["person"]["country"]["iso2"]).alias("country_code"),
        F.transform(
            F.coalesce(r["attempts"], F.array().cast(_ATTEMPTS)), lambda a: a["result"].cast("long")
        ).alias("attempts"),
        r["best"].alias("best"),
        r["average"].alias("average"),
        F.upper(_blank(r["singleRecordTag"])).alias("single_tag"),
        F.upper(_blank(r["averageRecordTag"])).alias("average_tag"),
        r["enteredAt"].alias("entered_text"),
        times.strict_instant(r["enteredAt"]).alias("entered_at"),
        _error(
            (F.col("_broken"), "snapshot has no results"),
            (r.isNotNull() & (r["id"].isNull() | r["person"]["id"].isNull()), "missing field"),
            (times.instant_is_invalid(r["enteredAt"]), "invalid timezone-aware datetime"),
        ).alias("error"),
    ).withColumn("meaningful_hash", content_hash(_MEANINGFUL))


def compact_results(frames: DataFrame, rows: str = "payload", roster: str = "users") -> DataFrame:
    """Rows of the second source with their competitor from the roster.

    ``frames`` carry ``expected_competition, expected_event, expected_round``; a row of another
    competition, event or round is an error.
    """
    # In a step of its own the roster is read once; beside the explode it would be read for every row.
    items = frames.withColumn("_users", F.from_json(roster, ROSTER))
    items = items.withColumn("_r", F.explode(F.from_json(rows, f"array<{COMPACT_ROW}>")))
    r = F.col("_r")
    user = F.try_element_at("_users", r["n"].cast("string"))
    return items.select(
        *frames.columns,
        r["i"].cast("string").alias("result_id"),
        F.concat_ws(":", F.lit("cubingchina"), r["c"].cast("string"), r["i"].cast("string")).alias("stable_identity"),
        r["n"].alias("competitor_number"),
        _blank(user["name"]).alias("person_name"),
        F.upper(_blank(user["wcaid"])).alias("person_id"),
        _blank(user["region"]).alias("region"),
        r["e"].alias("event_id"),
        r["r"].alias("round_id"),
        _blank(r["f"]).alias("format"),
        F.coalesce(r["v"], F.array().cast("array<bigint>")).alias("attempts"),
        r["b"].alias("best"),
        r["a"].alias("average"),
        record_tag(r["sr"]).alias("single_tag"),
        record_tag(r["ar"]).alias("average_tag"),
        _error(
            (r["i"].isNull() | r["c"].isNull() | r["n"].isNull() | r["e"].isNull() | r["r"].isNull(), "missing field"),
            (r["c"] != F.col("expected_competition"), "result belongs to an unexpected competition"),
            (r["e"] != F.col("expected_event"), "result belongs to an unexpected event"),
            (r["r"] != F.col("expected_round"), "result belongs to an unexpected round"),
        ).alias("error"),
    )


FRAME_ROW = (
    "struct<result_id:string,person_id:string,person_name:string,country:string,attempts:array<bigint>,"
    "best:bigint,average:bigint,single_tag:string,average_tag:string,entered_at:timestamp>"
)
FRAME_ROWS = "array<struct<result_id:string,mark:string,entered_at:timestamp,row:string>>"


def _frame_rows(rows: Column) -> Column:
    """Normalised result rows with a mark of their content; null stays null."""
    return F.transform(
        rows,
        lambda r: F.struct(
            r["result_id"].alias("result_id"),
            F.sha2(F.to_json(r, {"ignoreNullFields": "false"}), 256).alias("mark"),
            r["entered_at"].alias("entered_at"),
            F.to_json(r).alias("row"),
        ),
    )


def first_source_frames(frames: DataFrame, json: str = "payload") -> DataFrame:
    """Raw frames of the first source with ``rows`` in place of the payload, for ``SnapshotDiff``.

    Works row by row, so on streams too. A payload that is no snapshot has null rows.
    """
    results = F.from_json(json, ROUND_SNAPSHOT)["results"]
    last = _last_of_each(results, lambda r: r["id"])
    rows = F.transform(
        last,
        lambda r: F.struct(
            r["id"].alias("result_id"),
            _blank(r["person"]["wcaId"]).alias("person_id"),
            _blank(r["person"]["name"]).alias("person_name"),
            _blank(r["person"]["country"]["iso2"]).alias("country"),
            F.transform(F.coalesce(r["attempts"], F.array().cast(_ATTEMPTS)), lambda a: a["result"].cast("bigint")).alias("attempts"),
            r["best"].cast("bigint").alias("best"),
            r["average"].cast("bigint").alias("average"),
            F.upper(_blank(r["singleRecordTag"])).alias("single_tag"),
            F.upper(_blank(r["averageRecordTag"])).alias("average_tag"),
            times.strict_instant(r["enteredAt"]).alias("entered_at"),
        ),
    )
    return frames.withColumn("rows", _frame_rows(rows)).drop(json)


def second_source_frames(frames: DataFrame, json: str = "payload", roster: str = "users") -> DataFrame:
    """The same for compact rows with a roster; the frame's time stands in for the time of entry."""
    parsed = _rostered(frames, json, roster)
    last = _last_of_each(F.col("_rows"), lambda x: x["r"]["i"].cast("string"))

    def normal(item: Column) -> Column:
        r, user = item["r"], item["user"]
        return F.struct(
            r["i"].cast("string").alias("result_id"),
            F.upper(_blank(user["wcaid"])).alias("person_id"),
            _blank(user["name"]).alias("person_name"),
            _blank(user["region"]).alias("country"),
            F.coalesce(r["v"], F.array().cast("array<bigint>")).alias("attempts"),
            r["b"].alias("best"),
            r["a"].alias("average"),
            record_tag(r["sr"]).alias("single_tag"),
            record_tag(r["ar"]).alias("average_tag"),
            F.lit(None).cast("timestamp").alias("entered_at"),
        )

    return parsed.withColumn("rows", _frame_rows(F.transform(last, normal))).drop("_rows", json, roster)


def record_benchmarks(payloads: DataFrame, json: str = "payload") -> DataFrame:
    """Official records as long (level, event, kind, region, value) rows.

    A value that is not positive, or another kind, fails the job: a bad list must not be stored.
    """
    rows = payloads.withColumn("_p", F.from_json(json, RECORDS))
    keep = list(payloads.columns)

    def kinds(df: DataFrame, level: str) -> DataFrame:
        values = df.select(*keep, "region", "event_id", F.explode("_e").alias("kind", "value"))
        good = F.col("kind").isin("single", "average") & F.coalesce(F.col("value") > 0, F.lit(False))
        checked = F.when(good, F.col("value").cast("long")).otherwise(
            F.raise_error(F.concat(F.lit("Invalid record value for "), "event_id", F.lit("/"), "kind")).cast("long")
        )
        return values.select(*keep, F.lit(level).alias("level"), "event_id", "kind", "region", checked.alias("value"))

    world = rows.select(*keep, F.lit("").alias("region"), F.explode("_p.world_records").alias("event_id", "_e"))
    out = kinds(world, "WR")
    for field, level in (("continental_records", "CR"), ("national_records", "NR")):
        regions = rows.select(*keep, F.explode(f"_p.{field}").alias("region", "_v"))
        events = regions.select(*keep, "region", F.explode("_v").alias("event_id", "_e"))
        out = out.unionByName(kinds(events, level))
    return out


def round_targets(competitions: DataFrame, zones: DataFrame | None = None, json: str = "payload") -> DataFrame:
    """Rounds of competition payloads; ``zones`` fills what a single venue does not settle."""
    rows = competitions.withColumn("_p", F.from_json(json, COMPETITION))
    events = rows.select("_p", F.explode("_p.competitionEvents").alias("_e"))
    found = events.select("_p", "_e.event", F.explode("_e.rounds").alias("_r"))
    p, r = F.col("_p"), F.col("_r")
    flat = found.select(
        r["id"].alias("round_id"),
        p["id"].alias("source_competition_id"),
        p["wcaId"].alias("competition_id"),
        p["name"].alias("competition_name"),
        _blank(F.get(p["venues"], F.lit(0))["country"]["iso2"]).alias("competition_country"),
        single_venue_zone(p["venues"]).alias("competition_timezone"),
        times.iso_date(p["startDate"]).alias("competition_start"),
        times.iso_date(p["endDate"]).alias("competition_end"),
        F.col("event.id").alias("event_id"),
        F.col("event.name").alias("event_name"),
        r["number"].alias("round_number"),
        _blank(r["name"]).alias("round_name"),
        _blank(r["format"]["id"]).alias("format_id"),
        _blank(r["format"]["sortBy"]).alias("format_sort_by"),
        r["format"]["numberOfAttempts"].alias("expected_attempts"),
        r["cutoff"]["numberOfAttempts"].alias("cutoff_attempts"),
        r["cutoff"]["attemptResult"].alias("cutoff_value"),
    )
    if zones is None:
        return flat
    settled = zones.select("competition_id", "event_id", "round_number", F.col("zone").alias("_zone"))
    joined = flat.join(settled, ["competition_id", "event_id", "round_number"], "left")
    return joined.withColumn(
        "competition_timezone",
        F.coalesce(F.nullif("competition_timezone", F.lit("")), "_zone", F.lit("")),
    ).drop("_zone")


def schedule_zones(schedules: DataFrame, json: str = "payload") -> DataFrame:
    """Venue zone per (competition, event, round) where all its activities agree, however deep they are."""
    rows = schedules.withColumn("_p", F.from_json(json, SCHEDULE))
    venues = rows.select("competition_id", F.explode("_p.schedule.venues").alias("_v"))
    quoted = F.regexp_extract_all("_v", F.lit(r'"activityCode"\s*:\s*("(?:[^"\\]|\\.)*")'), F.lit(1))
    codes = venues.select(
        "competition_id", F.get_json_object("_v", "$.timezone").alias("zone"), F.explode(quoted).alias("_q")
    ).withColumn("code", F.from_json(F.concat(F.lit('{"c":'), "_q", F.lit("}")), "struct<c:string>")["c"])
    pattern = r"^([^-]+)-r(\d+)(?:-|$)"
    return (
        codes.where(F.col("code").rlike(pattern) & (_blank(F.col("zone")) != ""))
        .groupBy(
            "competition_id",
            F.regexp_extract("code", pattern, 1).alias("event_id"),
            F.regexp_extract("code", pattern, 2).cast("int").alias("round_number"),
        )
        .agg(F.min("zone").alias("zone"), F.max("zone").alias("_other"))
        .where(F.col("zone") == F.col("_other"))
        .drop("_other")
    )


def listed_competitions(payloads: DataFrame, json: str = "payload") -> DataFrame:
    """Competitions of the official listing; incomplete ones carry an error."""
    c = F.col("_c")
    rows = payloads.select("*", F.explode(F.from_json(json, COMPETITIONS)).alias("_c"))
    start, end = times.iso_date(c["start_date"]), times.iso_date(c["end_date"])
    absent = c["id"].isNull() | c["name"].isNull() | c["country_iso2"].isNull() | start.isNull() | end.isNull()
    return rows.select(
        F.lit("wca").alias("source"),
        c["id"].alias("source_id"),
        c["id"].alias("official_id"),
        F.trim(c["name"]).alias("name"),
        start.alias("start_date"),
        end.alias("end_date"),
        F.upper(c["country_iso2"]).alias("country_code"),
        F.trim(_blank(c["city"])).alias("city"),
        F.when(absent, "incomplete competition").alias("error"),
    )


def listed_registrations(payloads: DataFrame, json: str = "payload") -> DataFrame:
    """Registrations of returning competitors; first-timers are dropped, gaps are errors."""
    u = F.col("_u")
    keep = [c for c in payloads.columns if c != json]
    rows = payloads.select(*keep, F.posexplode(F.from_json(json, REGISTRATIONS)).alias("position", "_item"))
    rows = rows.withColumn("_u", F.col("_item.user")).where(valid_person_id(u["wca_id"]))
    name = F.trim(_blank(u["name"]))
    code = F.upper(F.coalesce(F.nullif(u["country"]["iso2"], F.lit("")), u["country_iso2"], F.lit("")))
    continent = plain_continent(u["country"]["continent_id"])
    return rows.select(
        *keep,
        F.upper(F.trim(u["wca_id"])).alias("person_id"),
        name.alias("name"),
        code.alias("country_code"),
        continent.alias("continent"),
        F.lit("wca").alias("source"),
        "position",
        F.when((name == "") | (code == "") | (continent == ""), "incomplete competitor").alias("error"),
    )
