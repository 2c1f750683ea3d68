"""Quality by importance resampling: what resembles the target is drawn more often.

Two bag models over hashed n-grams (words without marks, marks after a word, pairs of words) are
counted: one on the target documents, one on all documents. A document's log weight is the mean log
ratio of its n-grams times ``EVIDENCE``, so that long documents are not judged on their length. Gumbel
noise, fixed by a hash of the document, is added, and the documents with the largest sums are the
sample: drawing without replacement with chances in proportion to the weights.

The models have ``BUCKETS`` places whatever the size of the corpus, but every n-gram of every document
is counted. The k-th largest sum is found by ranges that are numbered on their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laurel.llm.labelled import LABELLED, sample
from laurel.llm.order import running
from laurel.llm.tables import prepare, read, staged
from laurel.llm.words import Slab, grams, mix, slabs, span_hashes, trimmed

BUCKETS = 1 << 17
EVIDENCE = 50.0
SHARE = 0.8
SMOOTHING = 1.0


def ngrams(slab: Slab) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all texts and the number of the text that each is from."""
    starts, ends = trimmed(slab)
    doc = slab.doc_of_word()
    core = span_hashes(slab.data, starts, ends)
    tail = np.flatnonzero(ends < slab.ends)
    marks = mix(span_hashes(slab.data, ends[tail], slab.ends[tail]) + np.uint64(1))
    pairs = grams(core, 2)
    inside = doc[1:] == doc[:-1]
    found = np.concatenate([core, marks, pairs[inside] if len(pairs) else pairs])
    of = np.concatenate([doc, doc[tail], doc[:-1][inside] if len(pairs) else doc[:0]])
    return (found & np.uint64(BUCKETS - 1)).astype(np.int64), of


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        target = batch.column("target").to_numpy(zero_copy_only=False)
        for slab in slabs(batch.column("text")):
            found, of = ngrams(slab)
            counts[0] += np.bincount(found, minlength=BUCKETS)
            counts[1] += np.bincount(found[target[slab.rows][of]], minlength=BUCKETS)
    own = np.flatnonzero(counts[0])
    yield pa.RecordBatch.from_pydict({"bucket": own, "n_raw": counts[0][own], "n_target": counts[1][own]})


def marked(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, text and whether the row is of the ``target`` (``_id`` only, broadcast)."""
    ids = F.broadcast(target.select("_id", F.lit(True).alias("_hit")))
    rows = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("_id"), "left")
    return rows.select("doc_id", "text", F.coalesce("_hit", F.lit(False)).alias("target"))


def bag_counts(rows: DataFrame) -> np.ndarray:
    """Counts by bucket of all rows and of target rows; ``BUCKETS`` rows at most come to the driver."""
    sums = rows.select("text", "target").mapInArrow(_count, "bucket long, n_raw long, n_target long").groupBy("bucket")
    got = sums.agg(F.sum("n_raw").alias("n_raw"), F.sum("n_target").alias("n_target")).toArrow()
    counts = np.zeros((2, BUCKETS))
    for i, name in enumerate(("n_raw", "n_target")):
        counts[i][got.column("bucket").to_numpy()] = got.column(name).to_numpy()
    return counts


def log_weights(counts: np.ndarray, found: np.ndarray, of: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's log weight and number of n-grams.

    A text's own n-grams are taken out of the counts, else target documents would resemble the target
    the more for being in it. Expected counts, ``SMOOTHING`` times the size of a model and spread
    evenly, are added, so an n-gram that nothing else has says nothing.
    """
    texts = len(target)
    key, back, own = np.unique(of * BUCKETS + found, return_inverse=True, return_counts=True)
    own = own[back]
    logs = []
    for count, minus in ((counts[1], own * target[of]), (counts[0], own)):
        size = count.sum()
        logs.append(np.log((count[found] - minus + SMOOTHING * size / BUCKETS) / size) if size else np.zeros(len(found)))
    ratio = logs[0] - logs[1] if counts[1].any() else np.zeros(len(found))
    n = np.bincount(of, minlength=texts)
    return EVIDENCE * np.bincount(of, ratio, minlength=texts) / np.maximum(n, 1), n


def _weigher(model):
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = model.value
        for batch in batches:
            target = batch.column("target").to_numpy(zero_copy_only=False)
            parts = [log_weights(counts, *ngrams(slab), target[slab.rows]) for slab in slabs(batch.column("text"))]
            weight = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0)
            n = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
            columns = {"doc_id": batch.column("doc_id"), "n_grams": pa.array(n), "log_weight": pa.array(weight, mask=n == 0)}
            yield pa.RecordBatch.from_pydict(columns)

    return weigh


def resampled(docs: DataFrame, target: DataFrame, share: float = SHARE, seed: int = 0) -> DataFrame:
    """Which ``share`` of ``docs`` (doc_id, text) to keep so that they resemble ``target`` (``_id``).

    Returns doc_id, n_grams, log_weight, sum (with the noise), place (1 is first) and kept, a row for
    each row. Null and empty texts have no n-grams and no weight (null); they come last. Equal rows get
    equal sums; which of them comes first is arbitrary. Without target documents all weights are 1. An
    empty table gives an empty one. Other columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    rows = marked(docs, target)
    model = spark.sparkContext.broadcast(bag_counts(rows))
    rows = rows.mapInArrow(_weigher(model), "doc_id long, n_grams long, log_weight double")
    unit = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    rows = rows.withColumn("sum", F.col("log_weight") - F.log(-F.log(unit)))
    rows = staged(rows.withColumn("_down", F.coalesce(-F.col("sum"), F.lit(float("inf")))), "weights")
    ranked = rows.withColumns({"place": F.lit(1).cast("long"), "_all": F.lit(0)})
    ranked = running(ranked, "_all", ["_down", "doc_id"], adds=["place"], name="ranked").drop("_down", "_all", "_number")
    return ranked.withColumn("kept", F.col("place") <= round(share * rows.count()))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = sample(read(spark, sf_dir, "labels"), "quality", LABELLED)
    return resampled(read(spark, sf_dir, "documents"), marks.where("quality = 1").select("_id"))
