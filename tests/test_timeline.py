"""Record timelines against a sequential fold written from the rules."""

import random
from datetime import datetime, timedelta

from laurel.operators import timeline
from laurel.operators.quality import state_difference

START = datetime(2026, 8, 8, 10)
SCHEMA = (
    "level string, event_id string, kind string, scope string, canonical_id long, revision int, "
    "at timestamp, value long, competition_id string, competition_name string, round_id string, "
    "round_number int, person_id string, local_date date"
)
CELLS = "level string, event_id string, kind string, scope string, value long"


def random_rows(seed, count, timelines):
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        at = START + timedelta(minutes=rng.randrange(0, 60 * 24 * 4))
        scope = f"s{min(rng.randrange(timelines), rng.randrange(timelines))}"
        rows.append(
            ("NR", "333", "single", scope, i, 1, at, rng.randrange(1, 200), rng.choice(["", "A", "B"]),
             rng.choice(["Open", "Cup"]), rng.choice(["", "r1"]), rng.randrange(1, 3),
             rng.choice(["", "p1", "p2", "p3"]), rng.choice([None, at.date()]))
        )
    return rows


def fold(rows, base):
    """One timeline after another, one row after another."""
    out = {}
    timelines = {}
    for r in rows:
        timelines.setdefault(r[3], []).append(r)
    for scope, members in timelines.items():
        members.sort(key=lambda r: (r[6], r[4], r[5]))
        incumbent, qualifying = base.get(scope), []
        for r in members:
            result = "broken" if incumbent is None or r[7] < incumbent else "tied" if r[7] == incumbent else "none"
            out[r[4]] = {"incumbent": incumbent, "outcome": result}
            if result == "broken":
                incumbent = r[7]
            if result != "none":
                qualifying.append(r)
        final = incumbent

        def group(key):
            groups = {}
            for r in qualifying:
                if key(r) is not None:
                    groups.setdefault(key(r), []).append(r)
            return {k: min(v, key=lambda r: (r[7], r[6], r[4])) for k, v in groups.items()}

        def round_key(r):
            return (r[8] or r[9], r[10] or r[11])

        def day_key(r):
            return r[13]

        best_round, best_day = group(round_key), group(day_key)
        recognized = []
        for r in qualifying:
            judged = out[r[4]]
            judged["by"] = None
            if r[7] > best_round[round_key(r)][7]:
                judged["recognition"], judged["by"] = "superseded_same_round", best_round[round_key(r)][4]
            elif day_key(r) is not None and r[7] > best_day[day_key(r)][7]:
                judged["recognition"], judged["by"] = "superseded_same_day", best_day[day_key(r)][4]
            else:
                judged["recognition"] = "recognized"
                recognized.append(r)
            judged["tie"] = sum(q[7] == r[7] for q in qualifying) > 1
        for r in recognized:
            judged = out[r[4]]
            judged["holds"] = r[7] == final
            if judged["holds"]:
                continue
            later = [q for q in recognized if (q[6], q[4]) > (r[6], r[4]) and q[7] < r[7]]
            if later:
                b = later[0]
                person = bool(r[12]) and r[12] == b[12]
                same = r[8] == b[8] if r[8] and b[8] else r[9] == b[9]
                judged["ceased"] = (
                    b[4],
                    "broken_by_" + ("self" if person else "other") + "_" + ("later_round" if same else "other_competition"),
                )
    return out


def test_scan_and_adjudication_match_a_sequential_fold(spark):
    for seed, buckets in ((1, None), (2, "month")):
        rows = random_rows(seed, 1500, 6)
        base = {"s0": 120, "s1": 60, "s9": 5}
        members = spark.createDataFrame(rows, SCHEMA)
        cells = spark.createDataFrame([("NR", "333", "single", s, v) for s, v in base.items()], CELLS)
        from laurel.operators.scan import instant_buckets

        cut = instant_buckets("at", "canonical_id") if buckets else None
        judged = timeline.adjudicate(timeline.replay(members, cells, cut)).collect()
        expected = fold(rows, base)
        assert len(judged) == len(rows)
        for r in judged:
            want = expected[r.canonical_id]
            assert (r.incumbent, r.outcome) == (want["incumbent"], want["outcome"])
            assert r.recognition == want.get("recognition", "not_applicable")
            assert r.superseded_by == want.get("by")
            assert r.shared_tie == want.get("tie", False)
            assert r.currently_holds == want.get("holds", False)
            reason = {"broken_by_self_other_competition": "broken_by_self_other_competition"}
            by, why = want.get("ceased", (None, ""))
            why = {"broken_by_other_other_competition": why}.get(why, reason.get(why, why))
            assert (r.ceased_by, r.ceased_reason) == (by, why)


def test_repair_equals_rebuild(spark):
    rows = random_rows(5, 600, 5)
    cells = spark.createDataFrame([("NR", "333", "single", "s0", 100)], CELLS)
    old = spark.createDataFrame(rows[:500], SCHEMA)
    everything = spark.createDataFrame(rows, SCHEMA)
    before = timeline.adjudicate(timeline.replay(old, cells))
    touched = spark.createDataFrame(rows[500:], SCHEMA).select(*timeline.TIMELINE).distinct()
    repaired = timeline.repair(before, everything, cells, touched)
    rebuilt = timeline.adjudicate(timeline.replay(everything, cells))
    assert state_difference(repaired, rebuilt).count() == 0


REVISIONS = (
    "canonical_id long, revision int, action string, status string, validation_status string, "
    "value long, entered_at timestamp, first_observed_at timestamp, person_id string, event_id string, "
    "kind string, country string, continent string, competition_id string, competition_name string, "
    "round_id string, round_number int, local_date date"
)


def revision(ident, number, value, minutes, action="active", country="Netherlands", continent="Europe", comp="Open2026", person="2020TEST01"):
    at = START + timedelta(minutes=minutes)
    return (ident, number, action, action, "verified", value, at, at, person, "333", "single", country,
            continent, comp, "Open", "r1", 1, START.date())


def classified(spark, rows, absorbed=()):
    cells = spark.createDataFrame(
        [("WR", "333", "single", "World", 1000), ("CR", "333", "single", "Europe", 1000),
         ("NR", "333", "single", "Netherlands", 1000), ("PR", "333", "single", "2020TEST01", 1000)],
        CELLS,
    )
    gone = spark.createDataFrame([(a,) for a in absorbed], "competition_id string")
    levels = timeline.classify(spark.createDataFrame(rows, REVISIONS), cells, gone)
    return {(r.canonical_id, r.revision, r.level): r for r in levels.collect()}


def test_slower_correction_keeps_invalid_history(spark):
    levels = classified(spark, [revision(1, 1, 900, 0), revision(1, 2, 1100, 0, "corrected")])
    assert len(levels) == 8
    old, new = levels[(1, 1, "WR")], levels[(1, 2, "WR")]
    assert (old.is_valid, old.invalidity_reason, old.outcome, old.currently_holds) == (False, "corrected_result", "broken", False)
    assert old.replacement == 2
    assert (new.is_valid, new.outcome, new.recognition) == (True, "none", "not_applicable")


def test_retraction_reinstates_the_earlier_result(spark):
    rows = [
        revision(1, 1, 950, 0),
        revision(2, 1, 920, 1, person="2020BOBB01"),
        revision(2, 2, 920, 1, "retracted", person="2020BOBB01"),
    ]
    levels = classified(spark, rows)
    alice = levels[(1, 1, "WR")]
    assert (alice.recognition, alice.currently_holds) == ("recognized", True)
    assert levels[(2, 2, "WR")].invalidity_reason == "retracted_result"
    assert levels[(2, 1, "WR")].invalidity_reason == "retracted_result"


def test_absorbed_results_stay_out_of_live_timelines(spark):
    rows = [revision(1, 1, 900, 0, comp="Old2025"), revision(2, 1, 950, 5, person="2020BOBB01")]
    levels = classified(spark, rows, absorbed=["Old2025"])
    assert (levels[(1, 1, "WR")].outcome, levels[(1, 1, "WR")].currently_holds) == ("broken", False)
    live = levels[(2, 1, "WR")]
    assert (live.incumbent, live.outcome, live.currently_holds) == (1000, "broken", True)
    assert levels[(2, 1, "PR")].incumbent is None


def test_unknown_scope_is_not_classified(spark):
    levels = classified(spark, [revision(1, 1, 900, 0, country="", continent="")])
    assert (levels[(1, 1, "NR")].outcome, levels[(1, 1, "NR")].incumbent) == ("none", None)
    assert levels[(1, 1, "WR")].outcome == "broken"
