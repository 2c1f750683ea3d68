import helpers
from pyspark.sql import functions as F

from laurel.llm import mixing


def test_targets_are_shared_anew_until_none_is_above(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 100), ("c", 1000), (None, 1)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    # Weights 1, 2, 3, 1: a, b and null stop at three times their size, c takes the rest.
    assert got == {"a": 30.0, "b": 300.0, "c": 1111 - 30 - 300 - 3.0, None: 3.0}


def test_sources_come_near_their_targets(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 40)), "en", f"s{i % 5}") for i in range(900)]
    docs = helpers.documents(spark, rows)
    taken = mixing.plan(docs).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("t"), F.first("target").alias("g"), F.max("copies").alias("m"))
    for r in taken.collect():
        assert abs(r.t - r.g) <= 2 * 40 and r.m <= 3
    first, again = (helpers.plain(mixing.plan(docs).select("doc_id", "copies").collect()) for _ in range(2))
    assert first == again


def test_awkward_rows(spark):
    docs = helpers.documents(spark, helpers.AWKWARD)
    got = mixing.plan(docs)
    rows = got.collect()
    assert len(rows) == len(helpers.AWKWARD)
    assert sorted(r["size"] for r in rows) == sorted(len(helpers.words(r[1])) for r in helpers.AWKWARD)
    assert all(0 <= r.copies <= 3 for r in rows)
    out = mixing.mixed(docs, got)
    assert out.columns == docs.columns
    assert out.count() == sum(r.copies for r in rows)
    assert mixing.plan(docs.limit(0)).count() == 0
    blank = mixing.plan(docs.where("doc_id IN (2, 3)")).collect()
    assert [(r.source_size, r.target, r.copies) for r in blank] == [(0, 0.0, 0)] * 2
