from datetime import datetime, timedelta
from pathlib import Path

from pyspark.sql import functions as F

from laurel.operators import alerts, rounds
from laurel.streaming import frames, snapshot_state

START = datetime(2026, 8, 8, 10)
FRAME = "round_id string, seq long, observed_at timestamp, type string, rows array<struct<result_id:string,mark:string,entered_at:timestamp,row:string>>"


def changes(spark, tmp_path, batches, catchup):
    source = tmp_path / "frames"
    for batch in batches:
        spark.createDataFrame(batch, FRAME).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(FRAME).parquet(str(source))
        frames.run_to_parquet(snapshot_state.snapshot_changes(stream, catchup), str(tmp_path / "out"), str(tmp_path / "check"))
    rows = spark.read.schema(snapshot_state.OUTPUT).parquet(str(tmp_path / "out")).collect()
    return sorted(((r.round_id, r.seq, r.result_id, r.change, r.evaluate) for r in rows), key=repr)


def test_snapshots_updates_and_restart(spark, tmp_path):
    old, new = START - timedelta(hours=3), START - timedelta(minutes=5)
    row = lambda name, mark, at: (name, mark, at, name + mark)
    first = [("r", 1, START, "snapshot", [row("a", "1", old), row("b", "1", new)]), ("q", 1, START, "snapshot", [])]
    second = [
        ("r", 2, START, "snapshot", [row("b", "1", new), row("a", "1", old)]),
        ("r", 3, START, "update", [row("a", "2", old)]),
        ("r", 4, START, "snapshot", [row("a", "2", old), row("c", "1", new)]),
        ("r", 5, START, "snapshot", None),  # cannot be read: nothing is removed
        ("r", 6, START, "snapshot", []),
        ("q", 2, START, "snapshot", [row("z", "1", old)]),  # an empty snapshot does not end the catch-up
        ("p", 1, START, "update", [row("x", "1", old)]),  # after an update a snapshot is not the first
        ("p", 2, START, "snapshot", [row("x", "1", old), row("y", "1", old)]),
    ]
    found = changes(spark, tmp_path, [first, second], 60)
    assert [f for f in found if f[0] != "r"] == [
        ("p", 1, "x", "addition", True), ("p", 2, "y", "addition", True), ("q", 2, "z", "addition", False)]
    assert [f for f in found if f[0] == "r" and f[3] != "rejected"] == [
        ("r", 1, "a", "addition", False),
        ("r", 1, "b", "addition", True),
        ("r", 3, "a", "change", True),
        ("r", 4, "b", "removal", True),
        ("r", 4, "c", "addition", True),
        ("r", 6, "a", "removal", True),
        ("r", 6, "c", "removal", True),
    ]
    assert [f[1] for f in found if f[3] == "rejected"] == [5]
    stored = spark.read.schema(snapshot_state.OUTPUT).parquet(str(tmp_path / "out")).where("round_id = 'r' AND result_id = 'a'")
    assert sorted((r.seq, r.before, r.row) for r in stored.collect()) == [(1, None, "a1"), (3, "a1", "a2"), (6, "a2", None)]


def test_live_timelines_follow_corrections(spark, tmp_path):
    from laurel.operators import timeline
    from laurel.operators.quality import state_difference
    from laurel.plans.streams import _REVISIONS, no_competitions
    from laurel.streaming.live import LiveTimelines

    def row(i, revision, minutes, value, event="333", place=("NL", "Europe"), action="created"):
        at = START + timedelta(minutes=minutes)
        status = "retracted" if action == "retracted" else "active"
        return (i, revision, action, status, "verified", at, at, event, "single", value, f"P{i % 2}", *place, "Open", "Open", "", i % 3, at.date())

    cells = spark.createDataFrame([("WR", "333", "single", "World", 1000)], "level string, event_id string, kind string, scope string, value long")
    batches = [
        [row(1, 1, 60, 880), row(2, 1, 70, 700), row(3, 1, 5, 700, "222"), row(4, 2, 80, 690, action="corrected")],
        [row(5, 1, 0, 900), row(2, 2, 70, 950, action="corrected"), row(4, 1, 80, 100)],  # late, corrected, an older revision
        [row(3, 2, 5, 700, "222", ("JP", "Asia"), "corrected"), row(4, 3, 80, 690, action="retracted"), row(6, 1, 90, -1)],
        [],
    ]
    state = LiveTimelines(cells, no_competitions(spark), str(tmp_path / "state"), _REVISIONS, buckets=16)
    columns = ["canonical_id", "revision", "level", "scope", "outcome", "recognition", "currently_holds", "incumbent"]
    seen = []
    for number, batch in enumerate(batches):
        seen += batch
        for _ in range(2 if number == 1 else 1):  # a batch may be repeated
            state.write(spark.createDataFrame(batch, _REVISIONS), number)
        log = spark.createDataFrame(seen, _REVISIONS)
        rebuilt = timeline.classify(log, cells, no_competitions(spark)).where("is_head AND is_valid AND scope <> ''")
        assert state_difference(rebuilt.select(columns), state.level_rows(number).select(columns)).count() == 0
        heads = timeline.live_members(log.groupBy("canonical_id").agg(F.max_by(F.struct(*log.columns[1:]), "revision").alias("r")).select("canonical_id", "r.*"), no_competitions(spark))
        assert state_difference(timeline.live_cells(heads, cells), state.cell_values(number)).count() == 0
    # Only touched buckets were written: an empty batch wrote none.
    assert 3 not in state.levels.written(3).values()
    world = state.cell_values(3).where("level = 'WR' AND event_id = '333'").first()
    assert world.value == 880


def test_level_rows_are_written_once_and_judgements_beside_them(spark, tmp_path):
    from laurel.plans.streams import _REVISIONS, no_competitions
    from laurel.streaming.live import LiveTimelines

    def row(i, value):
        at = START + timedelta(minutes=i)
        return (i, 1, "created", "active", "verified", at, at, "333", "single", value, f"P{i}", "NL", "Europe", "Open", "Open", "", i, at.date())

    cells = spark.createDataFrame([], "level string, event_id string, kind string, scope string, value long")
    state = LiveTimelines(cells, no_competitions(spark), str(tmp_path / "state"), _REVISIONS, buckets=4)
    state.write(spark.createDataFrame([row(1, 700), row(2, 800), row(3, 900)], _REVISIONS), 0)
    # Three timelines with one record each, and three of one person; the other six rows are not judged.
    assert state.levels.read(0, state.level_schema).count() == 12
    assert state.judged.read(0, state.judged_schema).count() == 6
    assert "country" not in state.level_schema.names and "recognition" not in state.level_schema.names
    rows = state.level_rows(0)
    assert rows.count() == 12 and rows.where("recognition = 'not_applicable' AND incumbent = 700").count() == 6


def test_discovery_keeps_known_targets(spark):
    as_of = F.lit("2026-08-10 09:00:00").cast("timestamp")
    target = "slug string, live_id long, official_id string, name string, start_date date, end_date date, status string, active boolean, last_error string"
    day = START.date()
    existing = spark.createDataFrame(
        [("known", 7, "K", "Known", day, day + timedelta(days=3), "active", True, ""),
         ("gone", 8, "G", "Gone", day, day + timedelta(days=3), "active", True, ""),
         ("over", 9, "O", "Over", day, day, "active", True, ""),
         ("fails", 5, "F", "Fails", day, day + timedelta(days=3), "active", True, "")], target)
    found = spark.createDataFrame(
        [("known", None, "K", "Known 2", day, day + timedelta(days=4), "no live page", True),
         ("over", 9, "O", "Over", day, day, "", True), ("new", 3, "N", "New", day, day + timedelta(days=2), "", True),
         ("fails", None, "", "Fails", day, day + timedelta(days=3), "timeout", False)],
        "slug string, live_id long, official_id string, name string, start_date date, end_date date, error string, detail_verified boolean")
    merged = {r.slug: r for r in rounds.merge_discovery(existing, found, as_of).collect()}
    assert (merged["known"].live_id, merged["known"].name, merged["known"].collectable) == (7, "Known 2", True)
    assert (merged["gone"].status, merged["gone"].active) == ("retired", False)
    assert merged["over"].status == "retired"
    assert (merged["new"].status, merged["new"].collectable) == ("active", True)
    assert (merged["fails"].status, merged["fails"].last_error, merged["fails"].collectable) == ("active", "timeout", True)


def test_closed_endpoint_fails_its_open_deliveries(spark):
    rows = [(1, "d1", 1, START, 201), (2, "d2", 1, START, 503), (3, "d3", 1, START, 410), (4, "d2", 1, START, 201), (5, "e1", 2, START, 503)]
    frame = spark.createDataFrame(rows, "seq long, delivery_id string, endpoint_id int, at timestamp, http_status int")
    states = {r.delivery_id: (r.status, r.last_error, r.attempts) for r in alerts.fold_deliveries(frame).collect()}
    assert states == {"d1": ("sent", "", 1), "d2": ("permanently_failed", "http_410", 1), "d3": ("permanently_failed", "http_410", 1), "e1": ("retry", "http_503", 1)}
    ends = {r.endpoint_id: (r.active, r.failure_streak) for r in alerts.fold_endpoints(frame).collect()}
    assert ends == {1: (False, 2), 2: (True, 1)}


def test_frames_without_a_type_reach_the_others(spark):
    rows = [("result.new",), ("round.all",), ("users",), (None,), ("hello",)]
    routed = frames.route(spark.createDataFrame(rows, "type string"))
    assert [r.type for r in routed["results"].collect()] == ["result.new"]
    assert sorted(str(r.type) for r in routed["others"].collect()) == ["None", "hello", "round.all", "users"]


def test_series_with_gaps_compares_existing_steps(spark):
    from laurel.operators.snapshots import snapshot_series

    rows = [("a", 1, "x"), ("b", 1, "y"), ("a", 3, "x"), ("c", 7, "z"), ("a", 7, "w")]
    found = snapshot_series(spark.createDataFrame(rows, "user string, day int, mark string"), ["user"], "day", "mark")
    assert sorted(tuple(r) for r in found.collect()) == [
        ("a", 1, "addition"), ("a", 7, "change"), ("b", 1, "addition"), ("b", 3, "removal"), ("c", 7, "addition")]


def test_workers_import_the_package_from_what_was_shipped(spark):
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    code = (
        "import sys; from pyspark.sql import SparkSession; "
        "s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate(); "
        f"sys.path.insert(0, {str(root)!r}); "
        "from laurel.session import tune; from laurel.sources import html_pages; tune(s); "
        "print('tables', html_pages.page_tables(s.createDataFrame([('<p>',)], 'html string')).count())"
    )
    env = {k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH" and not k.startswith("SPARK_CONNECT")}
    ran = subprocess.run([sys.executable, "-c", code], env=env, cwd="/", capture_output=True, text=True, timeout=240)
    assert "tables 1" in ran.stdout, ran.stderr[-2000:]


def test_the_outbox_merge_equals_the_fold_of_all_publications(spark, tmp_path):
    import random

    from laurel.operators import alerts
    from laurel.streaming.outbox import Outbox

    draw = random.Random(2)
    blank = {c: "" for c in alerts.ANNOUNCED}
    rows = [
        {"deduplication_key": f"k{draw.choice([0, 0, 0, *range(12)])}", "seq": i, "sent_before": draw.random() < 0.5, "note": f"n{i}", **blank, "formatted": draw.choice("ab")}
        for i in range(300)
    ]
    schema = "deduplication_key string, seq long, sent_before boolean, note string, " + ", ".join(f"{c} string" for c in alerts.ANNOUNCED)
    every = spark.createDataFrame([tuple(r[f.split()[0]] for f in schema.split(", ")) for r in rows], schema)
    box = Outbox(spark, str(tmp_path), every.schema, buckets=4)
    # The second batch begins with the end of the first; the third comes twice, as after a failure.
    for number, (low, high) in enumerate([(0, 120), (100, 200), (200, 300)]):
        box.write(every.where(f"seq >= {low} AND seq < {high}"), number)
    box.write(every.where("seq >= 200 AND seq < 300"), 2)
    box.write(every.limit(0), 3)
    want = alerts.fold_outbox(every)
    got = box.rows(3).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert sum(r.correction_count for r in got.collect()) > 10


def test_what_a_batch_stages_is_deleted_with_it(spark):
    from laurel.session import stage, staging

    outer = stage(spark.range(4))
    with staging(spark):
        inner = stage(spark.range(3))
        assert inner.count() == 3
        [*files] = inner.inputFiles()
    assert files and not any(Path(f.removeprefix("file://")).exists() for f in files)
    assert outer.count() == 4
