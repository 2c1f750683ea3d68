"""The alert outbox as a keyed merge: one row for each deduplication key, kept up by micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from laurel.functions.keys import canonical_json
from laurel.operators.alerts import ANNOUNCED
from laurel.operators.scan import number_buckets, previous_row
from laurel.session import staging
from laurel.streaming.store import BucketStore

KEY = "deduplication_key"


class Outbox:
    """Publications merged into the outbox, as a ``foreachBatch`` sink.

    A publication names its fact by the announced fields. The stored row of its key is compared with it:
    the same fact again changes nothing; another one replaces the payload and counts as a correction if
    some delivery had been sent by then (``sent_before``). A key's publications are taken in ``seq`` order,
    also those of one batch; one at or below the newest number that its key has seen is a repeat, so a
    batch that comes again, whole or in part, changes nothing. Only touched buckets are read and written,
    and a key with very many publications in a batch is spread over tasks by its numbers.
    """

    def __init__(self, spark: SparkSession, root: str, published: StructType, buckets: int = 64):
        """``published``: the stream's columns, with the key, seq, sent_before and the announced fields."""
        self.spark = spark
        self.rest = [f for f in published if f.name not in (KEY, "seq", "sent_before")]
        counted = [StructField(n, LongType()) for n in ("correction_count", "last_correction_seq", "last_seq")]
        self.schema = StructType([published[KEY], StructField("created_seq", LongType()), *self.rest, *counted, StructField("_fact", StringType())])
        self.store = BucketStore(spark, f"{root}/outbox", [KEY], buckets)

    def write(self, batch: DataFrame, number: int) -> None:
        with staging(self.spark):
            self._merge(batch, number)

    def _merge(self, batch: DataFrame, number: int) -> None:
        names = [f.name for f in self.rest]
        arrived = batch.select(KEY, F.col("seq").cast("long").alias("seq"), "sent_before", *names).dropDuplicates([KEY, "seq"]).persist()
        buckets = self.store.touched(arrived)
        stored = self.store.read(number - 1, self.schema, buckets)
        news = arrived.join(stored.select(KEY, "last_seq"), KEY, "left").where("last_seq IS NULL OR seq > last_seq").drop("last_seq")
        news = news.withColumns({"_fact": canonical_json(ANNOUNCED), "_stored": F.lit(False)}).persist()
        keys = news.select(KEY).distinct()
        # What is stored comes before the batch, as the row to compare the key's first publication with.
        known = stored.join(keys, KEY, "left_semi").select(
            KEY, F.col("last_seq").alias("seq"), F.lit(False).cast(BooleanType()).alias("sent_before"), *names, "_fact", F.lit(True).alias("_stored")
        )
        rows = previous_row(known.unionByName(news), [KEY], ["seq"], number_buckets("seq"), ["_fact"]).where("NOT _stored")
        changed = F.col("previous").isNotNull() & (F.col("previous._fact") != F.col("_fact"))
        late = changed & F.col("sent_before")
        folded = rows.groupBy(KEY).agg(
            F.min("seq").alias("_first"),
            F.max_by(F.struct(*names, "_fact"), "seq").alias("_row"),
            F.count_if(late).alias("_corrections"),
            F.max(F.when(late, F.col("seq"))).alias("_corrected"),
            F.max("seq").alias("_last"),
        )
        before = stored.select(KEY, "created_seq", "correction_count", "last_correction_seq")
        merged = folded.join(before, KEY, "left").select(
            KEY,
            F.coalesce("created_seq", "_first").alias("created_seq"),
            *(F.col("_row")[n].alias(n) for n in names),
            (F.coalesce("correction_count", F.lit(0)) + F.col("_corrections")).cast("long").alias("correction_count"),
            F.coalesce("_corrected", "last_correction_seq").alias("last_correction_seq"),
            F.col("_last").alias("last_seq"),
            F.col("_row._fact").alias("_fact"),
        )
        untouched = stored.join(keys, KEY, "left_anti")
        self.store.write(number, untouched.unionByName(merged.select(*self.schema.names)), buckets)
        news.unpersist()
        arrived.unpersist()

    def rows(self, batch: int) -> DataFrame:
        """The outbox as of ``batch``, with the columns of ``alerts.fold_outbox``."""
        return self.store.read(batch, self.schema).drop("last_seq", "_fact")

    def run(self, stream: DataFrame, checkpoint: str) -> int | None:
        """Merge everything available; returns the number of the last batch, or none if there was nothing."""
        query = stream.writeStream.foreachBatch(self.write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return query.lastProgress["batchId"] if query.lastProgress else None
