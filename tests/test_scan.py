from pyspark.sql import functions as F

from laurel.operators import scan, timeline
from laurel.operators.quality import state_difference


def _rows(spark, n=4000):
    # One key holds half of all rows.
    key = F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("id") % 97)
    return spark.range(n).select(F.col("id").alias("seq"), key.alias("k"), F.pmod(F.xxhash64("id"), F.lit(50)).alias("v"))


def _scanned(rows, descending=False):
    v = F.col("v")
    last = F.when(v > 10, F.struct("v", "seq"))
    carry = {"low": ("min", v), "high": ("max", v), "total": ("sum", v), "latest": ("last", last)}
    return scan.prefix_scan(rows, ["k"], ["seq"], [F.shiftright("seq", 4)], carry, descending)


def _joins(df):
    return str(df._jdf.queryExecution().optimizedPlan()).count("Aggregate"), df._jdf.queryExecution().sparkPlan().toString().count("Join")


def test_short_keys_are_scanned_by_one_window(spark, monkeypatch):
    rows = _rows(spark)
    short = _scanned(rows)
    assert _joins(short) == (0, 0)
    for descending in (False, True):
        want = _scanned(rows, descending)
        for limit in (0, 60, 1000):  # every key long; all but the longest are short
            monkeypatch.setattr(scan, "SHORT", limit)
            assert state_difference(want, _scanned(rows, descending)).count() == 0
            monkeypatch.undo()


def test_only_long_keys_are_cut(spark, monkeypatch):
    monkeypatch.setattr(scan, "SHORT", 1000)
    rows = _rows(spark)
    groups = scan.long_groups(rows, ["k"])
    assert len(groups) == 1
    assert [r.k for r in rows.where(scan.in_groups(["k"], groups)).select("k").distinct().collect()] == [0]


def test_short_and_long_timelines_are_adjudicated_alike(spark, monkeypatch):
    n = F.col("id")
    rows = spark.range(3000).select(
        F.lit("WR").alias("level"), F.when(n % 3 == 0, "a").otherwise(F.concat(F.lit("e"), n % 40)).alias("event_id"), F.lit("single").alias("kind"),
        F.lit("World").alias("scope"), n.alias("canonical_id"), F.lit(1).alias("revision"),
        F.timestamp_seconds(n * 7000).alias("at"), F.to_date(F.timestamp_seconds(n * 7000)).alias("local_date"),
        (F.lit(60) - F.floor(n / 60) + F.pmod(F.xxhash64("id"), F.lit(9))).cast("long").alias("value"),
        F.concat(F.lit("p"), n % 11).alias("person_id"), F.concat(F.lit("c"), F.floor(n / 30)).alias("competition_id"),
        F.lit("").alias("competition_name"), F.lit("").alias("round_id"), (n % 4).cast("int").alias("round_number"))
    none = rows.limit(0).select(*timeline.TIMELINE, "value")

    def judged():
        return timeline.adjudicate(timeline.replay(rows, none))

    short = judged().localCheckpoint()
    assert {r.recognition for r in short.select("recognition").distinct().collect()} == {
        "recognized", "not_applicable", "superseded_same_round", "superseded_same_day"}
    assert short.where("ceased_by IS NOT NULL").count() > 0 and short.where("shared_tie").count() > 0
    for limit in (0, 100):
        monkeypatch.setattr(scan, "SHORT", limit)
        assert state_difference(short, judged()).count() == 0
        monkeypatch.undo()


def test_carries_of_long_keys_need_no_join_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(scan, "SHORT", 1000)
    assert _joins(_scanned(_rows(spark)))[1] == 0


def test_state_difference_counts_copies_and_nulls(spark):
    left = spark.createDataFrame([(1, None), (1, None), (2, "b")], "a int, b string")
    right = spark.createDataFrame([(1, None), (3, None), (3, None)], "a int, b string")
    found = state_difference(left, right)
    # Both sides meet in one pass.
    assert _joins(found) == (1, 0)
    assert sorted((r.a, r.b, r.side) for r in found.collect()) == [(1, None, "left"), (2, "b", "left"), (3, None, "right"), (3, None, "right")]
