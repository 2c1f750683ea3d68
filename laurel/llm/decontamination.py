"""Benchmark decontamination by SimHash windows; DataFrame and SQL functions only.

Texts are lower-cased words; a shingle is five consecutive words, or the whole text where it has fewer.
For each length of a benchmark item (in shingles) windows of that length are taken from the documents.
A window that holds no shingle of the item has similarity 0, and of the windows that hold the same item
shingles one starts with one of them (or ends with the text), so only those windows are fingerprinted.

Every shingle of a window adds its weight, how often it occurs, to the 64 counters of a SimHash. The
counters are kept three to a number. Fingerprints are cut into 8 blocks of 8 bits; if two differ in at
most 23 bits, some block differs in at most 2. Each item is indexed under all values within 2 bits of
each of its blocks, so looking up a window's 8 blocks finds all items within the radius. Two texts of
similarity 0.8 differ in 10 bits on average (standard deviation 3); over 23 is a chance of about 2 in a
million. Candidates within the radius are verified by their shingles' exact weighted similarity,
the sum of the smaller weights over the sum of the larger ones.

Documents are shuffled once, to meet their windows; benchmark tables are broadcast only up to
``BROADCAST_ROWS`` rows and otherwise joined like any other table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laurel.llm.tables import prepare, read, staged

SHINGLE = 5
SIMILARITY = 80  # per cent
RADIUS = 23
BLOCKS = 8
BLOCK_BITS = 8
BLOCK_RADIUS = RADIUS // BLOCKS
LANE_BITS = 20  # counters up to 2**20 - 1: items of up to a million shingles
LANES = 3
BROADCAST_ROWS = 500_000
SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a lower-cased text; none for null or blank texts."""
    bare = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE, -1))


def shingles(found: str) -> Column:
    """Hashes of all shingles of the array column ``found``, in order."""
    w = F.col(found)
    several = F.transform(
        F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*[w[i + j] for j in range(SHINGLE)])
    )
    few = F.when(F.size(w) > 0, F.array(F.xxhash64(F.concat_ws(" ", w), F.size(w)))).otherwise(F.array().cast("array<bigint>"))
    return F.when(F.size(w) >= SHINGLE, several).otherwise(few)


def small(table: DataFrame) -> DataFrame:
    """``table`` with a broadcast hint if its row count allows that."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def fingerprints(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and the SimHash ``print`` of the shingle arrays ``hashes``; ``keys`` name a row."""
    each = rows.select(*keys, F.size("hashes").alias("_n"), F.explode("hashes").alias("_h"))
    sums = []
    for first in range(0, 64, LANES):
        lanes = [
            F.shiftleft(F.shiftrightunsigned("_h", bit).bitwiseAND(F.lit(1).cast("long")), LANE_BITS * (bit - first))
            for bit in range(first, min(64, first + LANES))
        ]
        total = lanes[0]
        for lane in lanes[1:]:
            total = total + lane
        sums.append(F.sum(total).alias(f"_s{first}"))
    counted = each.groupBy(*keys, "_n").agg(*sums)
    mask = F.lit((1 << LANE_BITS) - 1).cast("long")
    value = F.lit(0).cast("long")
    for bit in range(64):
        first = bit - bit % LANES
        count = F.shiftrightunsigned(f"_s{first}", LANE_BITS * (bit - first)).bitwiseAND(mask)
        signed = (1 << bit) - (1 << 64 if bit == 63 else 0)
        value = value.bitwiseOR(F.when(2 * count > F.col("_n"), F.lit(signed).cast("long")).otherwise(F.lit(0).cast("long")))
    return counted.select(*keys, value.alias("print"))


def _block(number: Column) -> Column:
    return F.expr(f"CAST(shiftrightunsigned(print, CAST(block * {BLOCK_BITS} AS INT)) & {(1 << BLOCK_BITS) - 1} AS INT)")


def blocks(prints: DataFrame) -> DataFrame:
    """A row for each block of each fingerprint: block and value."""
    rows = prints.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))))
    return rows.withColumn("value", _block(F.col("block")))


def probes(prints: DataFrame) -> DataFrame:
    """``blocks`` with every value within the block radius."""
    near = [m for m in range(1 << BLOCK_BITS) if m.bit_count() <= BLOCK_RADIUS]
    masks = F.explode(F.array(*[F.lit(m) for m in near])).alias("_mask")
    rows = blocks(prints).select("*", masks)
    return rows.withColumn("value", F.col("value").bitwiseXOR(F.col("_mask"))).drop("_mask")


def found(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Where ``docs`` (doc_id, text) hold items of ``benchmark`` (item_id, text).

    Returns doc_id, text_hash, item_id, similarity (0.8 to 1, of the best window) and start, the first
    such window's first word, one row for each different text and item. Null, empty and blank texts and
    items match nothing; texts of fewer than five words match only items with the same words. Rows
    equal in doc_id and text count once; a null doc_id is a value like others. Other columns are ignored.
    """
    prepare(docs.sparkSession)
    items = benchmark.where("item_id IS NOT NULL").select("item_id", words(F.col("text")).alias("_w"))
    items = items.select("item_id", shingles("_w").alias("hashes")).where("size(hashes) > 0").distinct()
    items = staged(items.withColumn("n", F.size("hashes")), "items")
    lengths = items.select("n", F.explode("hashes").alias("_h")).distinct()

    # The key of a different text: ids may be null, so they are compared as text.
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.xxhash64("text"))
    texts = docs.select(F.col("doc_id"), F.xxhash64("text").alias("text_hash"), key.alias("key"), "text")
    placed = texts.select("key", words(F.col("text")).alias("_w")).select("key", F.posexplode(shingles("_w")).alias("at", "_h"))
    anchors = placed.join(small(lengths), "_h").groupBy("key").agg(F.collect_set(F.struct("n", "at")).alias("anchors"))

    # Item-sized windows that start at an anchor, or end with the text.
    hit = texts.dropDuplicates(["key"]).join(anchors, "key").withColumn("_w", words(F.col("text")))
    hit = hit.select("doc_id", "text_hash", "key", "anchors", shingles("_w").alias("_h"))
    place = F.transform(
        "anchors", lambda a: F.struct(a["n"].alias("n"), F.greatest(F.lit(0), F.least(a["at"], F.size("_h") - a["n"])).alias("start"))
    )
    cut = F.transform(
        F.array_distinct(place), lambda p: F.struct(p["n"].alias("n"), p["start"].alias("start"), F.slice(F.col("_h"), p["start"] + 1, p["n"]).alias("hashes"))
    )
    windows = staged(hit.select("doc_id", "text_hash", "key", F.inline(cut)), "windows")

    prints = fingerprints(windows, ["key", "n", "start"])
    index = small(probes(fingerprints(items, ["item_id", "n"])).withColumnRenamed("print", "item_print"))
    near = blocks(prints).join(index, ["n", "block", "value"])
    near = near.where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS)
    candidates = near.select("key", "n", "start", "item_id").distinct()

    # Exact weights: how often a shingle occurs.
    asked = candidates.groupBy("key", "n", "start").agg(F.collect_list("item_id").alias("_items"))
    weights = windows.join(asked, ["key", "n", "start"])
    weights = weights.select("doc_id", "text_hash", "key", "n", "start", F.size("hashes").alias("size"), "_items", F.explode("hashes").alias("_h"))
    window = ["doc_id", "text_hash", "key", "n", "start", "size"]
    weights = weights.groupBy(*window, "_items", "_h").agg(F.count(F.lit(1)).alias("_w")).withColumn("item_id", F.explode("_items"))
    item_weights = items.select("item_id", F.explode("hashes").alias("_h")).groupBy("item_id", "_h").agg(F.count(F.lit(1)).alias("_i"))
    common = weights.join(small(item_weights), ["item_id", "_h"]).groupBy(*window, "item_id").agg(F.sum(F.least("_w", "_i")).alias("common"))
    union = F.col("size") + F.col("n") - F.col("common")
    similar = common.withColumn("union", union).where(100 * F.col("common") >= SIMILARITY * F.col("union"))
    similar = similar.withColumn("similarity", F.col("common") / F.col("union"))
    best = similar.groupBy("doc_id", "text_hash", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("_s"))).alias("_best"))
    return best.select("doc_id", "text_hash", "item_id", "_best.similarity", (-F.col("_best._s")).alias("start"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item."""
    dirty = found(docs, benchmark).select(F.col("doc_id").alias("_laurel_id"), F.col("text_hash").alias("_laurel_hash")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_laurel_id")) & (F.xxhash64("text") == F.col("_laurel_hash"))
    return docs.join(dirty, same, "left_anti")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = found(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "item_id", "similarity", "start")


ORACLE = r"""
WITH dw AS (
  SELECT doc_id AS id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
iw AS (
  SELECT item_id AS id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
both_ AS (SELECT 'd' AS side, * FROM dw UNION ALL SELECT 'i', * FROM iw),
sh AS (
  SELECT side, id, CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)]
                        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM both_),
ex AS (SELECT side, id, len(s) AS n, unnest(s) AS h, generate_subscripts(s, 1) - 1 AS pos FROM sh),
it AS (SELECT id AS item_id, n, h, count(*) AS c FROM ex WHERE side = 'i' GROUP BY ALL),
d AS (SELECT id AS doc_id, n AS len, h, pos FROM ex WHERE side = 'd'),
win AS (
  SELECT DISTINCT d.doc_id, it.item_id, it.n, greatest(0, least(d.pos, d.len - it.n)) AS start, least(d.len, it.n) AS size
  FROM d JOIN it ON d.h = it.h),
wc AS (
  SELECT win.doc_id, win.item_id, win.n, win.start, win.size, d.h, count(*) AS c
  FROM win JOIN d ON d.doc_id = win.doc_id AND d.pos >= win.start AND d.pos < win.start + win.size GROUP BY ALL),
cm AS (
  SELECT wc.doc_id, wc.item_id, wc.n, wc.start, wc.size, CAST(sum(least(wc.c, it.c)) AS BIGINT) AS common
  FROM wc JOIN it ON it.item_id = wc.item_id AND it.h = wc.h GROUP BY ALL),
ok AS (
  SELECT doc_id, item_id, CAST(common AS DOUBLE) / (size + n - common) AS similarity, CAST(start AS INT) AS start
  FROM cm WHERE 100 * common >= 80 * (size + n - common))
SELECT doc_id, item_id, similarity, start FROM ok
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1
"""
