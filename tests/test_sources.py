import json
import random
from concurrent.futures import ThreadPoolExecutor
from datetime import UTC, date, datetime

import pytest
from pyspark.sql import functions as F

from laurel.functions import fixed
from laurel.operators import baseline, history, quality
from laurel.sources import export, html_pages, payloads, publish

TABLES = {
    "continents": (["id", "name", "record_name"], [["_Asia", "Asia", "AsR"]]),
    "countries": (["id", "name", "continent_id", "iso2"], [["Japan", "Japan", "_Asia", "JP"], ["Nowhere", "", "_None", "NN"]]),
    "persons": (["wca_id", "sub_id", "name", "country_id", "gender"],
                [["2017sato03", "1", 'Aiko "A" Sato', "Japan", "f"], ["2017SATO03", "2", "Earlier Name", "Nowhere", "f"], ["2019LIMB02", "1", "Lim", "Nowhere", "m"]]),
    "ranks_single": (["person_id", "event_id", "best", "world_rank"],
                     [["2017SATO03", "pyram", "412", "1"], ["2019LIMB02", "pyram", "455", "2"], ["2001LOST01", "pyram", "377", "3"],
                      ["2017SATO03", "pyram", "0", "1"], ["2017SATO03", "pyram", "88888888888", "1"], ["2017SATO03", "kilominx", "7", "1"]]),
    "ranks_average": (["person_id", "event_id", "best"], [["2017SATO03", "pyram", "530"], ["2017SATO03", "333mbf", "4"], ["person_id", "event_id", "best"]]),
    "competitions": (["id", "name", "end_year", "end_month", "end_day"], [["OsakaSpring2025", "Osaka Spring", "2025", "4", "13"]]),
    "results": (["id", "pos", "best", "average", "competition_id", "round_type_id", "event_id", "person_id", "person_country_id"],
                [["71", "1", "412", "530", "OsakaSpring2025", "f", "pyram", "2017SATO03", "Japan"],
                 ["72", "2", "-1", "-1", "OsakaSpring2025", "f", "pyram", "2019LIMB02", "Nowhere"]]),
    "result_attempts": (["value", "attempt_number", "result_id"],
                        [["412", "1", "71"], ["560", "2", "71"], ["498", "3", "71"], ["601", "4", "71"], ["532", "5", "71"],
                         ["-2", "1", "72"], ["-1", "2", "72"], ["0", "3", "72"], ["NULL", "4", "72"]]),
}
AS_OF = datetime(2025, 5, 1, tzinfo=UTC)


def write_export(folder, version="v2.1", tables=None, date="2025-04-20 03:15:00 UTC"):
    folder.mkdir(exist_ok=True)
    for name, (columns, rows) in (tables or TABLES).items():
        lines = ["\t".join(columns), *["\t".join(r) for r in rows]]
        (folder / f"{fixed.EXPORT_PREFIXES[0].upper()}{name}.tsv").write_text("\n".join(lines) + "\n", encoding="utf-8")
    (folder / "metadata.json").write_text(json.dumps({"export_format_version": version, "export_date": date}))
    return str(folder)


def load(spark, folder):
    manifest = export.inspect(spark, folder, AS_OF)
    return manifest, export.read_export(spark, manifest)


def test_export_baseline_and_report(spark, tmp_path):
    manifest, tables = load(spark, write_export(tmp_path / "e"))
    assert manifest.generated_at == datetime(2025, 4, 20, 3, 15, tzinfo=UTC)
    cells = {(r.level, r.event_id, r.kind, r.scope): r.value for r in baseline.export_baseline(tables).collect()}
    assert cells == {
        ("WR", "pyram", "single", "World"): 377, ("CR", "pyram", "single", "Asia"): 412, ("NR", "pyram", "single", "Japan"): 412,
        ("CR", "pyram", "single", "None"): 455, ("NR", "pyram", "single", "Nowhere"): 455, ("PR", "pyram", "single", "2017SATO03"): 412,
        ("PR", "pyram", "single", "2019LIMB02"): 455, ("PR", "pyram", "single", "2001LOST01"): 377,
        ("WR", "pyram", "average", "World"): 530, ("CR", "pyram", "average", "Asia"): 530,
        ("NR", "pyram", "average", "Japan"): 530, ("PR", "pyram", "average", "2017SATO03"): 530,
    }
    assert tables["persons"].where("sub_id = '1' AND country_id = 'Japan'").first()["name"] == 'Aiko "A" Sato'
    assert tables["countries"].where("id = 'Nowhere'").first()["name"] == ""
    assert tables["result_attempts"].where("value IS NULL").count() == 1
    # A data line that looks like the header is data.
    assert tables["ranks_average"].where("best = 'best'").count() == 1
    report = export.load_report(tables, manifest, "x").first()
    assert report.row_counts["result_attempts"] == 9 and report.version == "v2.1:" + report.content_hash
    changed = {**TABLES, "continents": (TABLES["continents"][0], [["_Asia", "Azia", "AsR"]])}
    other, more = load(spark, write_export(tmp_path / "f", tables=changed, date="yesterday"))
    assert other.generated_at == AS_OF
    assert export.load_report(more, other, "x").first().content_hash != report.content_hash


def test_historical_sample(spark, tmp_path):
    _, tables = load(spark, write_export(tmp_path / "e"))
    facts = history.historical_facts(tables["result_attempts"], tables["results"], tables["competitions"])
    assert quality.require_publishable(facts) == {"singles": 5, "averages": 1, "total": 6, "invalid": 0, "duplicates": 0}
    assert {r.achieved_date for r in facts.collect()} == {date(2025, 4, 13)}


def test_all_violations_are_named(spark, tmp_path):
    broken = {k: v for k, v in TABLES.items() if k != "persons"}
    broken |= {"results": (["id", "pos", "pos"], [["1", "1", "1"]]), "odd-name": (["a b"], [["1"]])}
    folder = write_export(tmp_path / "a", version="v1.9", tables=broken)
    found = {(r.rule, r.subject.rsplit("/", 1)[-1]) for r in export.violations(export.listing(spark, folder)).collect()}
    assert found == {
        ("format", "v1.9"), ("table is not there", "persons"), ("column given twice", "results.pos"),
        ("table name", f"{fixed.EXPORT_PREFIXES[0].upper()}odd-name.tsv"), ("column name", "odd-name.a b"),
        *[("column is not there", f"results.{c}") for c in fixed.REQUIRED_EXPORT_COLUMNS["results"] if c != "id"]}
    with pytest.raises(ValueError, match="persons.*results.pos|results.pos.*persons"):
        export.inspect(spark, folder, AS_OF)
    (tmp_path / "a" / "metadata.json").unlink()
    assert ("number of metadata members", "0") in {(r.rule, r.subject) for r in export.violations(export.listing(spark, folder)).collect()}


def test_a_release_switches_all_tables_or_none(spark, tmp_path):
    def release(rows, check=lambda df: None, note="n"):
        tables = {"first": publish.Table(spark.range(rows)), "second": publish.Table(spark.range(rows), check)}
        return publish.publish(spark, str(tmp_path), tables, spark.createDataFrame([(note,)], "note string"))

    def refuse(df):
        raise ValueError("no")

    release(3)
    with pytest.raises(ValueError):
        release(9, refuse)
    assert [publish.published(spark, str(tmp_path), t).count() for t in ("first", "second")] == [3, 3]
    paths = [release(n, note=f"n{n}") for n in (4, 5, 6)]
    assert publish.published(spark, str(tmp_path), "second").count() == 6
    assert publish.metadata(spark, str(tmp_path), "note string").first().asDict() == {"number": 4, "note": "n6"}
    # The last two releases stay.
    assert [(tmp_path / p.rsplit("/", 1)[-1]).exists() for p in paths] == [False, True, True]


def test_two_publishers_never_take_one_number(spark, tmp_path):
    def release(n):
        rows = {"rows": publish.Table(spark.range(n))}
        return publish.publish(spark, str(tmp_path), rows, spark.createDataFrame([(n,)], "n int"), keep=9)

    with ThreadPoolExecutor(4) as pool:
        paths = list(pool.map(release, range(1, 7)))
    found = {r.path: r.number for r in publish.releases(spark, str(tmp_path)).collect()}
    assert sorted(found) == sorted(paths) and sorted(found.values()) == [1, 2, 3, 4, 5, 6]
    newest = max(found, key=found.get)
    assert publish.published(spark, str(tmp_path), "rows").count() == paths.index(newest) + 1


def test_a_taken_number_is_left_to_its_owner(spark, tmp_path, monkeypatch):
    """The second publisher has read the list before the first one's commit."""
    root = str(tmp_path)
    before = publish.releases(spark, root)
    assert publish.commit(spark, root, "first", "{}") == 1
    monkeypatch.setattr(publish, "releases", lambda *_: before)
    assert publish.commit(spark, root, "second", "{}") == 2
    monkeypatch.undo()
    assert {r.number: r.path for r in publish.releases(spark, root).collect()} == {1: "first", 2: "second"}


def test_refresh_publishes_only_valid_heads(spark, tmp_path):
    from laurel.plans import jobs
    from laurel.plans.streams import _REVISIONS

    def head(i, value, action="created", validation="verified", competition="Later2025"):
        at = datetime(2025, 4, 25)
        return (i, 1, action, "active", validation, at, at, "pyram", "single", value, "2019LIMB02", "Nowhere", "None", competition, "", "", 1, at.date())

    heads = [head(1, 370), head(2, -1), head(3, 300, "retracted"), head(4, 301, validation="rejected"), head(5, 302, competition="OsakaSpring2025")]
    frame = spark.createDataFrame(heads, _REVISIONS)
    root = str(tmp_path / "root")
    jobs.refresh_from_export(spark, write_export(tmp_path / "e"), root, frame, AS_OF)
    world = publish.published(spark, root, "live_cells").where("level = 'WR' AND kind = 'single'").first()
    assert world.value == 370
    empty = {**TABLES, "result_attempts": (TABLES["result_attempts"][0], [])}
    with pytest.raises(Exception, match="empty"):
        jobs.refresh_from_export(spark, write_export(tmp_path / "f", tables=empty), root, frame, AS_OF)
    assert publish.published(spark, root, "historical_facts").count() == 6
    found = publish.metadata(spark, root, "absorbed_competitions long, row_counts map<string,long>").first()
    assert (found.number, found.absorbed_competitions, found.row_counts["results"]) == (1, 1, 2)


def test_bad_records_are_set_aside(spark):
    good = {"id": "r", "type": "single", "tag": "wr", "attemptResult": 326, "result": {
        "id": "9", "attempts": [{"result": 326}, {"result": 400}, {"result": 420}], "best": 326, "average": 382,
        "enteredAt": "2026-08-08T10:00:00Z", "person": {"id": "1", "wcaId": "2020TEST01", "name": "T", "country": {"iso2": "NL"}},
        "round": {"id": "r1", "number": 1, "name": "Final", "format": {"id": "m", "numberOfAttempts": 3}, "cutoff": None,
                  "competitionEvent": {"event": {"id": "333", "name": "3x3"}, "competition": {
                      "id": "5", "wcaId": "Open2026", "name": "Open", "startDate": "2026-08-08", "endDate": "2026-08-09",
                      "venues": [{"name": "h", "timezone": "Europe/Amsterdam", "country": {"iso2": "NL"}}]}}}}}
    naive = json.loads(json.dumps(good))
    naive["result"]["enteredAt"] = "2026-08-08T10:00:00"
    frames = spark.createDataFrame([(json.dumps(good),), (json.dumps(naive),), ("{}",), ("not json",)], "payload string")
    kept, aside = quality.quarantine(payloads.recent_records(frames))
    row = kept.collect()
    assert len(row) == 1 and aside.count() == 3
    assert (row[0].level, row[0].final, row[0].competition_timezone) == ("WR", True, "Europe/Amsterdam")


def test_schedule_zones_need_agreement(spark):
    def venue(zone, *codes):
        return {"timezone": zone, "rooms": [{"activities": [{"activityCode": codes[0], "childActivities": [{"activityCode": c} for c in codes[1:]]}]}]}

    plan = {"schedule": {"venues": [venue("Europe/Paris", "333-r1", "222-r1-g1"), venue("Asia/Tokyo", "333-r1", "444-r2")]}}
    frame = spark.createDataFrame([("C", json.dumps(plan))], "competition_id string, payload string")
    assert {(r.event_id, r.round_number, r.zone) for r in payloads.schedule_zones(frame).collect()} == {
        ("222", 1, "Europe/Paris"), ("444", 2, "Asia/Tokyo")}


def test_schedule_zones_look_at_any_depth(spark):
    def nested(depth, code):
        activity = {"activityCode": code, "name": 'a "activityCode": "999-r9" quote'}
        for _ in range(depth):
            activity = {"activityCode": "other", "childActivities": [activity]}
        return activity

    plan = {"schedule": {"venues": [
        {"timezone": "Europe/Oslo", "rooms": [{"activities": [nested(9, "333-r1-g2"), nested(40, "pyram-r2")]}]},
        {"timezone": "Asia/Seoul", "rooms": [{"activities": [nested(25, "333-r1")]}]}]}}
    frame = spark.createDataFrame([("C", json.dumps(plan))], "competition_id string, payload string")
    assert [(r.event_id, r.round_number, r.zone) for r in payloads.schedule_zones(frame).collect()] == [("pyram", 2, "Europe/Oslo")]


def test_unreadable_page_is_an_error_row(spark):
    pages = spark.createDataFrame([(1, "<![foo bar]>"), (2, "<table></table>")], "id int, html string")
    kept, aside = quality.quarantine(html_pages.registrations(html_pages.page_tables(pages)))
    assert kept.count() == 0
    assert {r.id: r.error.split(":")[0] for r in aside.collect()} == {1: "page cannot be read", 2: "table was not found"}


def test_repeated_ids_of_a_snapshot_take_the_last_row(spark):
    row = lambda i, best: {"id": i, "best": best, "person": {"id": "p"}}
    frames = [(1, json.dumps({"id": "r", "results": [row("b", 1), row("a", 2), row("b", 3), row(None, 4), row(None, 5)]})),
              (2, json.dumps({"id": "r", "results": []})), (3, "{}")]
    found = payloads.round_results(spark.createDataFrame(frames, "frame int, payload string"))
    assert "payload" not in found.columns
    got = {(r.frame, r.result_id, r.best, r.error) for r in found.collect()}
    assert got == {(1, "a", 2, None), (1, "b", 3, None), (1, None, 5, "missing field"), (2, None, None, None), (3, None, None, "snapshot has no results")}


def test_record_list_rejects_bad_values(spark):
    def parse(value):
        body = {"world_records": {"333": {"single": value}}, "continental_records": {"_Europe": {"333": {"single": 9}}}, "national_records": {}}
        return payloads.record_benchmarks(spark.createDataFrame([(json.dumps(body),)], "payload string")).select("level", "region", "value").collect()

    assert sorted(tuple(r) for r in parse(5)) == [("CR", "_Europe", 9), ("WR", "", 5)]
    with pytest.raises(Exception, match="Invalid record value"):
        parse(0)


def test_pages_without_the_table_say_so(spark):
    pages = spark.createDataFrame([(1, "<p>none</p>")], "id int, html string")
    assert html_pages.registrations(html_pages.page_tables(pages)).first().error == "table was not found"
    assert html_pages.live_rounds(pages).first().error == "live container was not found"
    linked = spark.createDataFrame([('<a href="https://www.worldcubeassociation.org/competitions/Open2026?x=1">o</a>',), ("",)], "html string")
    assert [r.official_id for r in html_pages.competition_detail(linked).collect()] == ["Open2026", None]


def test_country_codes(spark, tmp_path):
    _, tables = load(spark, write_export(tmp_path / "e"))
    places = export.country_dimension(tables["countries"], tables["continents"])
    rows = spark.createDataFrame([(" Chinese  Taipei ",), ("japan",), ("Elsewhere",)], "region string")
    assert [r.country_code for r in export.country_codes(rows, places, "region").collect()] == ["TW", "JP", ""]
    with pytest.raises(Exception, match="Unknown country name: Elsewhere"):
        export.require_country_codes(rows, places, "region").collect()
    known = rows.where("region <> 'Elsewhere'")
    assert [r.country_code for r in export.require_country_codes(known, places, "region").collect()] == ["TW", "JP"]
    assert [r.continent for r in export.with_continent(spark.createDataFrame([("jp",), ("XX",)], "country_code string"), places).collect()] == ["Asia", ""]
    assert len(fixed.AVERAGE_EVENTS) == 19 and len(fixed.SINGLE_EVENTS) == 21


def test_frames_of_large_rounds_are_read_in_one_pass(spark):
    import json
    import time

    n = 6000
    person = lambda i: {"id": f"p{i}", "wcaId": f"W{i}", "country": {"iso2": "NL"}}
    first = [{"id": str(i % n), "attempts": [{"result": i}], "best": i, "average": 0, "person": person(i)} for i in range(n + 5)]
    second = [{"i": i % n, "c": 1, "n": i, "e": "333", "r": "f", "v": [i], "b": i, "a": 0} for i in range(n + 5)]
    roster = {str(i): {"number": i, "name": f"N{i}", "wcaid": f"w{i}", "region": "NL"} for i in range(0, n, 2)}
    frame = spark.createDataFrame(
        [("r", json.dumps({"id": "r", "results": first}), json.dumps(second), json.dumps(roster)), ("q", "{", "{", None), ("s", '{"results":[]}', "[]", "{}")],
        "round_id string, one string, two string, users string")
    started = time.monotonic()
    one = {r.round_id: r.rows for r in payloads.first_source_frames(frame, "one").collect()}
    two = {r.round_id: r.rows for r in payloads.second_source_frames(frame.drop("one"), "two").collect()}
    assert time.monotonic() - started < 60
    assert (one["q"], two["q"], one["s"], two["s"]) == (None, None, [], [])
    assert len(one["r"]) == len(two["r"]) == n and [r.result_id for r in one["r"]] == sorted(str(i) for i in range(n))
    rows = {r.result_id: json.loads(r.row) for r in one["r"]}
    assert rows["3"]["best"] == n + 3 and rows["7"]["best"] == 7  # the last row of an id wins
    rows = {r.result_id: json.loads(r.row) for r in two["r"]}
    assert (rows["6"]["person_id"], rows["7"]["person_id"], rows["4"]["person_id"]) == ("W6", "", "")


_PIECES = (
    "<table>", "</table>", "<thead>", "<tbody>", "<tr>", "</tr>", "<td>", "</td>", "<TD class='x' hidden>", "<td/>", '<th class="a b">', "</th >",
    '<a href="/r?x=1&amp;y=2">', "<a href=b>", "<a href>", '<A\tHREF="q">', "</a>", "<br />", "text", " a &amp; b ", "&nbsp;", "&", ">",
    "<!-- c -->", "<!doctype html>", "<script>a && b</script>", "<title>T &lt; x</title>",
)
_ODD_PIECES = (
    "<", "<!-->", "<!-- a -- b -->", "<script>if (a < b) {}</script>", "<script/>", "</td x>", '<a href="a>b">', "<td x=1/2>", "<a href = c>",
    "<title>", "<textarea>", '<a href="1"class="y">', "</>", "<td", "<t\x00d>",
)


def test_regular_pages_read_as_by_the_parser():
    """Random pages: what is cut at the tags equals what the standard library's parser finds."""
    draw, regular = random.Random(3), 0
    for number in range(4000):
        pieces = _PIECES if number % 2 else _PIECES + _ODD_PIECES
        page = "<table>" * (number % 3 == 0) + "".join(draw.choice(pieces) for _ in range(draw.randrange(14)))
        cut = html_pages._regular(page)
        regular += cut is not None
        assert cut is None or _merged(cut) == _merged(html_pages._parsed(page)), page
    assert regular > 2000


def _merged(steps):
    return [(code, tuple(value) if isinstance(value, list) else value) for code, value in steps]


def test_an_index_of_regular_rows_needs_no_parser(spark):
    row = '<tr><td>1996-01-02~ 03</td><td><a href="https://x/competition/slug-7?lang=en">C &amp; D</a></td><td>Sichuan</td><td>City</td><td>-</td></tr>'
    page = f"<!doctype html><script>a()</script><table><thead><tr><th>Date</th><th>Competition Name</th></tr></thead><tbody>{row * 3}</tbody></table>"
    assert html_pages._regular(page) is not None
    found = html_pages.competition_index(html_pages.page_tables(spark.createDataFrame([(page,), (None,)], "html string"))).collect()
    assert [r.source_id for r in found if r.error is None] == ["slug-7"] * 3
    assert {(r.name, str(r.start_date), str(r.end_date)) for r in found if r.error is None} == {("C & D", "1996-01-02", "1996-01-03")}
    assert [r.error for r in found if r.error] == ["table was not found"]


def test_a_roster_is_read_once_for_its_rows(spark):
    rows = json.dumps([{"i": i, "c": 7, "n": i % 3, "e": "333", "r": "1", "v": [5]} for i in range(9)])
    users = json.dumps({str(n): {"name": f"P{n}"} for n in range(3)})
    frames = spark.createDataFrame([(rows, users, 7, "333", "1")], "payload string, users string, expected_competition int, expected_event string, expected_round string")
    parsed = payloads.compact_results(frames)
    plan = str(parsed._jdf.queryExecution().optimizedPlan())
    assert plan.index("Generate explode") < plan.index("from_json(MapType")
    assert [r.person_name for r in parsed.orderBy(F.col("result_id").cast("int")).collect()] == ["P0", "P1", "P2"] * 3


def test_polled_payloads_do_not_depend_on_the_files_of_the_table(spark, monkeypatch):
    from laurel.plans import jobs, sources

    class Seen(Exception):
        pass

    def ingest(polled, rounds):
        raise Seen(polled)

    monkeypatch.setattr(jobs, "ingest_polls", ingest)
    try:
        sources.poll_batches(spark, "/root/testdata/sf0.001")
    except Seen as seen:
        polled = seen.args[0]
    # Payloads are made above a shuffle, and only those that are polled.
    plan = polled._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("payload") < plan.index("RepartitionByExpression")
    assert "payload" not in plan[plan.index("RepartitionByExpression"):]
