"""Incremental record state per micro-batch, right under corrections, retractions and late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from laurel.operators import timeline
from laurel.operators.scan import long_groups
from laurel.session import stage, staging
from laurel.streaming.store import BucketStore


class _Heads:
    """The head of each result: its revision with the highest number, whenever it arrives."""

    def __init__(self, baseline: DataFrame, absorbed: DataFrame, root: str, revisions: str, buckets: int = 256):
        """``revisions``: the schema of the stream, with the columns that ``timeline.classify`` needs."""
        self.spark: SparkSession = baseline.sparkSession
        # Staged, it has a size by which joins with it are planned.
        self.baseline, self.absorbed = baseline, stage(absorbed)
        self.heads = BucketStore(self.spark, f"{root}/heads", ["canonical_id"], buckets)
        self.head_schema = self.spark.createDataFrame([], revisions).schema

    def write(self, batch: DataFrame, number: int) -> None:
        with staging(self.spark):
            names = self.head_schema.names
            arrived = stage(batch.select(*names))
            buckets = self.heads.touched(arrived)
            stored = self.heads.read(number - 1, self.head_schema, buckets).select(*names, F.lit(True).alias("_stored"))
            # Stored heads and arrivals meet in one shuffle; of the same revision the stored one stays.
            newest = Window.partitionBy("canonical_id").orderBy(F.desc("revision"), F.desc("_stored"))
            both = stored.unionByName(arrived.withColumn("_stored", F.lit(False)))
            both = both.withColumn("_head", F.row_number().over(newest) == 1)
            both = stage(both.where(F.col("_head") | F.col("_stored")))
            news, replaced = both.where("_head AND NOT _stored"), both.where("_stored AND NOT _head")
            self._apply(*(timeline.live_members(df.select(*names), self.absorbed) for df in (news, replaced)), number)
            # The heads go last: as long as they are not written, a repeated batch sees the same change.
            self.heads.write(number, both.where("_head").select(*names), buckets)

    def _apply(self, own: DataFrame, old: DataFrame, number: int) -> None:
        """Bring in the members ``own`` of a batch's heads, and take out those of the heads they replace."""
        raise NotImplementedError

    def run(self, stream: DataFrame, checkpoint: str) -> int:
        """Process everything available; returns the number of the last batch."""
        writer = stream.writeStream.foreachBatch(self.write).option("checkpointLocation", checkpoint)
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
        return query.lastProgress["batchId"]


class LiveTimelines(_Heads):
    """Heads and level rows of a stream of result revisions, as a ``foreachBatch`` sink.

    Level rows are written once, straight from the replay, with incumbent and outcome. Of the few that broke or tied
    a record the judgement is kept beside them.

    A batch touches the timelines of the heads it brings and of the heads these replace, so a result that
    is corrected, retracted or moved to another scope leaves the timelines it was in. Only their buckets are
    read, replayed and written. The members of a timeline are its level rows, so they are stored once; they hold
    ``timeline.MEMBER``, any other field of a result is in its head.
    """

    def __init__(self, baseline: DataFrame, absorbed: DataFrame, root: str, revisions: str, buckets: int = 256):
        super().__init__(baseline, absorbed, root, revisions, buckets)
        self.levels = BucketStore(self.spark, f"{root}/levels", timeline.TIMELINE, buckets)
        members = timeline.live_members(self.spark.createDataFrame([], self.head_schema), absorbed)
        members = members.select(*timeline.MEMBER)
        self.judged = BucketStore(self.spark, f"{root}/judged", timeline.TIMELINE, buckets)
        self.level_schema = members.withColumns({"incumbent": F.lit(None).cast("long"), "outcome": F.lit("")}).schema
        self.judged_schema = timeline.adjudicated_schema(members)

    def _apply(self, own: DataFrame, old: DataFrame, number: int) -> None:
        touched = own.select(*timeline.TIMELINE).unionByName(old.select(*timeline.TIMELINE))
        buckets = self.levels.touched(touched)
        own = own.select(*timeline.MEMBER)
        stored = self.levels.read(number - 1, self.level_schema, buckets).select(*timeline.MEMBER)
        groups = long_groups(stored.unionByName(own), timeline.TIMELINE)
        replaced = old.select("canonical_id").distinct()
        members = stored.join(replaced, "canonical_id", "left_anti").select(*timeline.MEMBER).unionByName(own)
        # The scan reads what has long timelines twice.
        members = stage(members) if groups else members
        seeds = self.baseline.where(self.levels.bucket().isin(buckets))
        replayed = timeline.replay(members, seeds, groups=groups).select(*self.level_schema.names)
        self.levels.write(number, replayed, buckets)
        qualifying = self.levels.read(number, self.level_schema, buckets).where("outcome <> 'none'")
        judged = timeline.adjudicate_qualifying(qualifying)
        self.judged.write(number, judged.select(*self.judged_schema.names), buckets)

    def level_rows(self, batch: int) -> DataFrame:
        others = self.levels.read(batch, self.level_schema).where("outcome = 'none'")
        return self.judged.read(batch, self.judged_schema).unionByName(timeline.not_judged(others))

    def cell_values(self, batch: int) -> DataFrame:
        """Current value of every record cell."""
        return timeline.live_cells(self.levels.read(batch, self.level_schema), self.baseline)


class LiveCells(_Heads):
    """Record cells alone, for streams that need no level rows.

    A cell is the least value that its timeline holds, so it is enough to count how many members hold each
    value: a batch adds the members of its heads and takes off those of the heads these replace.
    """

    def __init__(self, baseline: DataFrame, absorbed: DataFrame, root: str, revisions: str, buckets: int = 256):
        super().__init__(baseline, absorbed, root, revisions, buckets)
        self.counts = BucketStore(self.spark, f"{root}/counts", timeline.TIMELINE, buckets)
        members = timeline.live_members(self.spark.createDataFrame([], self.head_schema), absorbed)
        self.count_schema = members.select(*timeline.TIMELINE, "value", F.lit(0).cast("long").alias("n")).schema

    def _apply(self, own: DataFrame, old: DataFrame, number: int) -> None:
        key = [*timeline.TIMELINE, "value"]
        signed = [df.select(*key, F.lit(n).cast("long").alias("n")) for df, n in ((own, 1), (old, -1))]
        change = stage(signed[0].unionByName(signed[1]).groupBy(*key).agg(F.sum("n").alias("n")).where("n <> 0"))
        buckets = self.counts.touched(change)
        both = self.counts.read(number - 1, self.count_schema, buckets).unionByName(change)
        self.counts.write(number, both.groupBy(*key).agg(F.sum("n").alias("n")).where("n > 0"), buckets)

    def cell_values(self, batch: int) -> DataFrame:
        """Current value of every record cell."""
        return timeline.live_cells(self.counts.read(batch, self.count_schema), self.baseline)


def heartbeats(stream: DataFrame) -> DataFrame:
    """Latest heartbeat per worker, for update or complete output."""
    return stream.groupBy("worker", "method").agg(F.max("at").alias("last_at"))


def queue_windows(stream: DataFrame, delay: str = "10 minutes", width: str = "1 minute") -> DataFrame:
    """Queue depth per tumbling window of a sample stream."""
    from laurel.operators.health import queue_series

    return queue_series(stream.withWatermark("at", delay), width)


def distinct_publications(stream: DataFrame) -> DataFrame:
    """Alert publications without exact repeats; ``alerts.fold_outbox`` folds what is left."""
    from laurel.functions.keys import canonical_json
    from laurel.operators.alerts import ANNOUNCED

    marked = stream.withColumn("_fact", F.sha2(canonical_json(ANNOUNCED), 256))
    return marked.dropDuplicates(["deduplication_key", "_fact"]).drop("_fact")
