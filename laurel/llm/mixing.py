"""Mixing sources to target weights by systematic sampling.

Every document of a source expects the same number of copies, its source's target over its source's
size. Documents are put in order within their source; the prefix sum of the expected copies, moved by
one offset per source, crosses an integer boundary as often as the document is emitted. The order is
by size (then by a hash), so the copies are spread evenly over long and short documents and the words
taken stay within a few long documents of the target.

A hot source is no hot task: documents are range-partitioned on (source, size, hash), each range is
numbered on its own, and ranges are shifted by the rows before them. Only the table of sources, one
row each, is ordered as a whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from laurel.llm.tables import prepare, read, staged

WEIGHTS = (1.0, 2.0, 3.0)
MOST_COPIES = 3
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_COPIES, share: float = 1.0
) -> DataFrame:
    """Each source's target from ``sizes`` (source, source_size, ...): one row per source.

    Sources in code point order, null last, have the ``weights`` in turn. Targets are ``level`` times
    the weight, but ``most`` times the source's size at the highest; the level is such that all
    targets make up ``share`` of all sizes. That is where sharing the excess anew, by weight, ends.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int") + 1)
    rows = sizes.withColumn("weight", weight).withColumn("_cap", (most * F.col("source_size")).cast("double"))
    # Sources are capped in the order of cap / weight; the first that is not gives the level.
    order = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    left = F.sum("source_size").over(whole) * F.lit(share) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    rows = rows.withColumn("_level", left / open_weight)
    level = F.min(F.when(F.col("_level") * F.col("weight") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("weight"), "_level"))).over(whole)
    return rows.withColumn("target", F.least("_cap", F.coalesce(level["_level"] * F.col("weight"), F.col("_cap")))).drop("_cap", "_level")


def plan(
    docs: DataFrame,
    size: Column | None = None,
    weights: Sequence[float] = WEIGHTS,
    most: int = MOST_COPIES,
    share: float = 1.0,
    seed: int = 0,
) -> DataFrame:
    """How often each row of ``docs`` (doc_id, text, source) is taken.

    Returns doc_id, source, size, source_size, target, copies and text_hash, one row per input row. Null and
    empty texts have size 0; a source without words has target 0 and no copies; null sources are
    one source. Rows that are equal in all of doc_id, source and size are interchangeable: which of
    them gets a copy cannot be told apart. Other columns are ignored. An empty table gives none.
    """
    spark = prepare(docs.sparkSession)
    size = word_count(F.col("text")) if size is None else size
    slim = docs.select("doc_id", "source", size.alias("size"), F.xxhash64("text").alias("text_hash"))
    slim = slim.withColumn("_at", F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))))
    order = [F.col("source").asc_nulls_last(), F.col("size"), F.col("_at"), F.col("doc_id")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = staged(
        staged(slim, "sizes").repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ordered"
    )
    per_range = placed.groupBy("_part", "source").agg(F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_words"))
    per_range = staged(per_range, "ranges")
    sizes = per_range.groupBy("source").agg(F.sum("_words").alias("source_size"))
    # A source's rows in earlier ranges: a source has a row for each range that holds some of it.
    earlier = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = per_range.select("_part", "source", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))))
    offset = F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    goal = targets(sizes, weights, most, share).withColumn("_offset", offset)
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    table = shifts.join(goal.withColumn("_each", each).withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    table = table.withColumnsRenamed({"_part": "_p", "source": "_s"})
    inside = F.row_number().over(Window.partitionBy("_part", "source").orderBy("size", "_at", "doc_id"))
    numbered = placed.withColumn("_row", inside)
    rows = numbered.join(table, (F.col("_part") == F.col("_p")) & F.col("source").eqNullSafe(F.col("_s")))
    rank = F.col("_before") + F.col("_row")
    crossed = F.floor(rank * F.col("_each") + F.col("_offset")) - F.floor((rank - 1) * F.col("_each") + F.col("_offset"))
    copies = F.least(crossed, F.ceil("_each")).cast("long")
    return rows.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), "text_hash")


def mixed(docs: DataFrame, copies: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as ``copies``, their plan, says; the columns are those of ``docs``.

    Rows equal in doc_id, source and text are one row that is taken as often as all of them.
    """
    key = ["_laurel_id", "_laurel_source", "_laurel_hash"]
    taken = copies.groupBy(F.col("doc_id").alias("_laurel_id"), F.col("source").alias("_laurel_source"), F.col("text_hash").alias("_laurel_hash"))
    taken = taken.agg(F.sum("copies").alias("_laurel_copies"), F.count(F.lit(1)).alias("_laurel_rows")).where("_laurel_copies > 0")
    same = F.col("doc_id").eqNullSafe(F.col("_laurel_id")) & F.col("source").eqNullSafe(F.col("_laurel_source")) & (F.xxhash64("text") == F.col("_laurel_hash"))
    rows = docs.join(taken, same)
    rows = rows.where("_laurel_rows = 1").unionByName(rows.where("_laurel_rows > 1").dropDuplicates(key))
    rows = rows.withColumn("_laurel_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_laurel_copies"))))
    return rows.select(*docs.columns)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = plan(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('0:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS at FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight,
         CAST(3 * source_size AS DOUBLE) AS cap FROM s),
l AS (
  SELECT *, ((SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER e, 0))
            / ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER e, 0)) AS lev
  FROM w WINDOW e AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size,
         least(cap, coalesce((SELECT lev FROM l WHERE lev * weight <= cap ORDER BY cap / weight, lev LIMIT 1) * weight, cap)) AS target,
         CAST(('0x' || substr(md5('0:' || coalesce('s' || source, 'null')), 1, 8)) AS BIGINT) / 4294967296.0 AS shift
  FROM l),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.shift,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS each,
         row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.at, d.doc_id) AS k
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (
  SELECT *, CAST(least(floor(k * each + shift) - floor((k - 1) * each + shift), ceil(each)) AS BIGINT) AS copies FROM r)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM c
"""
