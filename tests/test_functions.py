from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from laurel.functions import finalize, keys, status, text, times, values


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("event", "kind", "value", "shown"),
    [
        ("444", "single", 1187, "11.87"),
        ("333", "single", -1, "DNF"),
        ("333", "single", -2, "DNS"),
        ("333", "single", -3, "Invalid"),
        ("333", "single", 0, ""),
        ("555", "single", 7215, "1:12.15"),
        ("333mbf", "single", 940271003, "8/11 45:10"),
        ("333mbf", "single", 929999900, "7/7"),
        ("333fm", "single", 31, "31"),
        ("333fm", "average", 2867, "28.67"),
        ("333fm", "average", 2740, "27.4"),
        ("333fm", "average", 3100, "31.0"),
    ],
)
def test_display_text(spark, event, kind, value, shown):
    assert one(spark, values.format_result(F.lit(event), F.lit(kind), F.lit(value))) == shown


def test_order_of_values(spark):
    rows = spark.createDataFrame([(v,) for v in (None, -1, 742, 741, 0)], "v long")
    ordered = rows.orderBy(values.comparison_key("v"), F.desc_nulls_last("v")).collect()
    assert [r.v for r in ordered] == [741, 742, 0, -1, None]
    assert one(spark, values.is_better(F.lit(742), F.lit(-1)))
    assert not one(spark, values.is_better(F.lit(-1), F.lit(742)))


@pytest.mark.parametrize(
    ("attempts", "rule", "final"),
    [
        ([600, 620, 610, 590], (5, None, None), False),
        ([600, 620, 610, 590, -1], (5, None, None), True),
        ([1500, 1600, 0, 0, 0], (5, 2, 1400), True),
        ([1500, 1300, 0, 0, 0], (5, 2, 1400), False),
        ([1500, 1400], (5, 2, 1400), True),
        ([1500, 0], (5, 2, 1400), False),
        ([1500, 1600, 1200, 0, 0], (5, 2, 1400), False),
        ([-1, -1], (5, 2, 1400), True),
        ([], (0, None, None), False),
        ([700, 0, 0], (3, 3, 600), False),
    ],
)
def test_final_results(spark, attempts, rule, final):
    frame = spark.createDataFrame(
        [(attempts, *rule)], "a array<long>, e int, t int, v int"
    )
    assert frame.select(finalize.is_final("a", "e", "t", "v").alias("x")).first().x is final


def test_second_source_rule(spark):
    def rule(fmt, cutoff, event):
        return tuple(one(spark, finalize.cutoff_rule(F.lit(fmt), F.lit(cutoff), F.lit(event))))

    assert rule("a", 20, "333") == (5, 2, 2000)
    assert rule("", 20, "333") == (5, 2, 2000)
    assert rule("m", 30, "333fm") == (3, 1, 30)
    assert rule("2", 0, "333") == (2, None, None)
    assert rule("x", 0, "333") == (0, None, None)


def test_keys(spark):
    natural = keys.natural_key(F.lit("Open2026"), F.lit("2020test01"), F.lit("333"), F.lit(1), F.lit("single"))
    assert one(spark, natural) == "wca|OPEN2026|2020TEST01|333|1|single"
    missing = keys.natural_key(F.lit(""), F.lit("2020TEST01"), F.lit("333"), F.lit(1), F.lit("single"))
    assert one(spark, missing) is None
    assert one(spark, keys.valid_person_id(F.lit(" 2020test01 ")))
    assert not one(spark, keys.valid_person_id(F.lit("2020TEST01x")))
    assert one(spark, keys.competition_source_key(F.lit(""), F.lit("a"), F.lit("s"))) == "a:s"


def test_windows(spark):
    for day, start, end in (
        ("2026-08-12", date(2026, 8, 12), date(2026, 8, 18)),
        ("2026-08-18", date(2026, 8, 12), date(2026, 8, 18)),
        ("2026-08-19", date(2026, 8, 19), date(2026, 8, 25)),
    ):
        assert tuple(one(spark, times.weekend_window(F.lit(day).cast("date")))) == (start, end)
    late = F.lit("2026-08-11 22:30:00").cast("timestamp")
    assert one(spark, times.weekend_window_of_instant(late, "Europe/Amsterdam")).start == date(2026, 8, 12)
    with pytest.raises(ValueError):
        times.resolve_weekend_window("2026-08-01", "", F.current_date())
    with pytest.raises(ValueError):
        times.resolve_weekend_window("2026-08-02", "2026-08-01", F.current_date())


@pytest.mark.parametrize(
    ("given", "start", "end"),
    [
        ("2026-08-09", date(2026, 8, 9), date(2026, 8, 9)),
        ("2026-08-09~10", date(2026, 8, 9), date(2026, 8, 10)),
        ("2026-08-30 ~ 09-02", date(2026, 8, 30), date(2026, 9, 2)),
        ("2026-12-30~2027-01-02", date(2026, 12, 30), date(2027, 1, 2)),
    ],
)
def test_compact_dates(spark, given, start, end):
    assert tuple(one(spark, times.compact_date_range(F.lit(given)))) == (start, end)


def test_strict_instants(spark):
    assert one(spark, times.strict_instant(F.lit("2026-08-08T10:00:00+02:00"))) == datetime(2026, 8, 8, 8, 0)
    assert one(spark, times.strict_instant(F.lit("2026-08-08T10:00:00"))) is None
    assert one(spark, times.instant_is_invalid(F.lit("2026-08-08T10:00:00")))
    assert not one(spark, times.instant_is_invalid(F.lit("")))


def test_text(spark):
    rows = spark.createDataFrame([("Éric Ångström",), ("ALICE",), ("Straße",), (None,)], "n string")
    assert [r.x for r in rows.select(text.folded_name("n").alias("x")).collect()] == [
        "eric angstrom",
        "alice",
        "strasse",
        None,
    ]
    assert tuple(one(spark, text.split_native_name(F.lit(" Li Wei (李伟) ")))) == ("Li Wei", "李伟")
    assert tuple(one(spark, text.split_native_name(F.lit("Li Wei ()")))) == ("Li Wei ()", None)
    assert one(spark, text.record_tag(F.lit(" asr "))) == "CR"
    assert one(spark, text.plain_continent(F.lit("_Europe"))) == "Europe"
    assert one(spark, text.level_label(F.lit("CR"), F.lit("Asia"))) == "AsR"
    assert text.events_matching("big bld") == ["444bf", "555bf"]


def test_delivery_states(spark):
    outcomes = {
        201: "success",
        404: "permanent_endpoint_failure",
        410: "permanent_endpoint_failure",
        429: "transient_failure",
        503: "transient_failure",
        401: "application_failure",
        413: "application_failure",
        400: "permanent_endpoint_failure",
        None: "application_failure",
    }
    for code, expected in outcomes.items():
        assert one(spark, status.delivery_outcome(F.lit(code).cast("int"))) == expected
    delays = [one(spark, status.retry_delay_seconds(F.lit(n))) for n in (0, 1, 2, 3, 4, 9)]
    assert delays == [60, 60, 300, 1800, 7200, 7200]
    merged = status.merged_preferences(F.create_map(F.lit("record_cr"), F.lit(False), F.lit("x"), F.lit(True)))
    assert one(spark, merged) == {"record_wr": True, "record_cr": False, "record_nr": True}
