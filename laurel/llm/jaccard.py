"""Joining documents whose word shingles are similar: size-banded tiles with bitmap signatures.

A document's set is its distinct five-word shingles. Documents meet in tiles, one for a shingle, sorted by
size, in which a document is compared with the following ones as long as the size band allows. In a tile
bitmaps are compared first. A bit of one bitmap that the other lacks stands for at least one shingle that the
other lacks, so counting such bits bounds the overlap from above; only what the bound leaves is a candidate.
Candidates are verified by exact intersection of their sorted shingle arrays. No link is missed:

* Posted shingles: a set of size n posts its ``posted(n)`` first shingles in hash order. Two sets of similarity
  0.8 or more, of any sizes, have ``needed(n)`` of these in common or more (prefix lemma, with the overlap of
  0.8 n that any partner of a set of n needs). Sets with fewer shingles that others post as well have no partner.
* Tiles: of its posted shingles a set takes those that fewest post first, but for the last ``needed(n)`` - 1;
  partners share one of these (the same lemma, in another order). So what many documents have in common makes
  tiles only for documents that consist of it. Shingles with the same members are one tile.
* Tiles of more than ``COMMON`` classes are not compared in one task: their classes are tied to one of them,
  as possible candidates. Tied classes are verified like all candidates, in blocks over many tasks.
* Equal sets are one class, so exact copies are never paired. What leaves a tile is a spanning forest of
  its candidates. Candidate components hold all true links; sets are built once more for their documents.
* A component is verified in blocks of ``BLOCK`` classes, each together with the component's first
  class. Only classes that are not linked to that one meet the other blocks, so a group of very many near
  copies costs as much as it has members.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laurel.llm.components import components, forest
from laurel.llm.tables import prepare, read, remove, staged, staged_at
from laurel.llm.words import Slab, grams, mix, slabs

SHINGLE = 5
SIMILARITY = 80  # per cent
COMMON = 1000
BITS = 1024
BLOCK = 512
CHUNK_ROWS = 16_384
SEEN = 1 << 20  # classes that a task remembers to have posted; others may be posted again
MEMBER_BITS = (1 << 16, 1 << 27)  # of the filter of members: least and most, by their number
_U = np.uint64


def sets(slab: Slab) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of all texts, one after the other, and where each begins."""
    words, doc = slab.hashes(), slab.doc_of_word()
    texts = len(slab.counts)
    whole = grams(words, SHINGLE)
    at = doc[: len(whole)]
    inside = at == doc[SHINGLE - 1 :] if len(whole) else np.zeros(0, bool)
    found, of = [whole[inside]], [at[inside]]
    for size in range(1, SHINGLE):  # short texts are one shingle
        own = np.flatnonzero(slab.counts == size)
        if len(own):
            first = slab.first[own]
            found.append(mix(sum((words[first + j] * _U(2 * j + 3) for j in range(size)), np.zeros(len(own), np.uint64)) + _U(size)))
            of.append(own)
    h, of = np.concatenate(found), np.concatenate(of)
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.append(True, (h[1:] != h[:-1]) | (of[1:] != of[:-1]))[: len(h)]
    h, of = h[new], of[new]
    return h, np.searchsorted(of, np.arange(texts + 1))


def bitmaps(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row of ``BITS / 64`` words for each set."""
    out = np.zeros((len(first) - 1, BITS), bool)
    out[np.repeat(np.arange(len(first) - 1), np.diff(first)), (mix(h) & _U(BITS - 1)).astype(np.int64)] = True
    return np.packbits(out, axis=1, bitorder="little").view(np.uint64)


def _fixed(rows: np.ndarray) -> pa.Array:
    """Rows of 64-bit words as binary values."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * (8 * rows.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _lists(values: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values.view(np.int64)))


PRINTS = "doc_id long, n long, s1 long, s2 long, bits binary, lead array<bigint>"


def posted(n: np.ndarray) -> np.ndarray:
    """How many shingles a set of ``n`` posts."""
    return n // 4 + 1


def needed(n: Column) -> Column:
    """How many of the shingles that a set of ``n`` posts any partner posts as well, at least.

    A set of n has 0.8 n in common with a partner, so at most n // 5 of its own are elsewhere. Among its first
    n // 5 + l and the partner's (likewise) l are common; posted(n) gives l > n / 20. The smaller set of a pair
    has 0.8 of the larger one's size or more, so more than n / 25 holds for both.
    """
    return F.floor(n / 25) + 1


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for batch in batches:
        for slab in slabs(batch.column("text"), lower=True):
            h, first = sets(slab)
            n = np.diff(first)
            total = np.concatenate([[_U(0)], np.cumsum(h)])
            other = np.concatenate([[_U(0)], np.cumsum(mix(h + _U(1)))])
            s1 = (total[first[1:]] - total[first[:-1]]).view(np.int64)
            # Copies of what this task has posted need no bitmap and no shingles.
            usable = np.flatnonzero((n > 0) & batch.column("doc_id")[slab.rows.start : slab.rows.stop].is_valid().to_numpy(zero_copy_only=False))
            new = np.zeros(len(n), bool)
            for i in usable[np.unique(s1[usable], return_index=True)[1]]:
                new[i] = int(s1[i]) not in seen
            seen.update(s1[new].tolist())
            seen = seen if len(seen) <= SEEN else set()
            # Sets are sorted, so a set's first hashes are its smallest.
            lead = np.where(new, posted(n), 0)
            bounds = np.concatenate([[0], np.cumsum(lead)])
            at = np.repeat(first[:-1] - bounds[:-1], lead) + np.arange(bounds[-1])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id")[slab.rows.start : slab.rows.stop],
                    pa.array(n),
                    pa.array(s1),
                    pa.array((other[first[1:]] - other[first[:-1]]).view(np.int64)),
                    pc.if_else(pa.array(new), _fixed(bitmaps(h, first)), pa.scalar(None, pa.binary())),
                    _lists(h[at], bounds),
                ],
                names=["doc_id", "n", "s1", "s2", "bits", "lead"],
            )


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = CHUNK_ROWS) -> Iterator[pa.Table]:
    """Tables of at least ``rows`` rows, but for the last, that cut no run of equal ``keys``."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        table = pa.Table.from_batches(held)
        last = np.ones(count, bool)
        for key in keys:
            column = table.column(key).to_numpy()
            last &= column == column[-1]
        cut = count - int(np.argmin(last[::-1])) if not last.all() else 0
        if cut:
            yield table.slice(0, cut)
            held = table.slice(cut).combine_chunks().to_batches()
            count -= cut
    if held:
        yield pa.Table.from_batches(held)


def _words(column: pa.ChunkedArray) -> np.ndarray:
    """Binary values of one length as rows of 64-bit words."""
    column = column.combine_chunks()
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(np.uint64).reshape(len(column), -1)


def may_link(n: np.ndarray, bits: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the overlap that bit counts allow is enough."""
    out = np.zeros(len(a), bool)
    for at in range(0, len(a), 65536):
        i, j = a[at : at + 65536], b[at : at + 65536]
        only_i = np.bitwise_count(bits[i] & ~bits[j]).sum(axis=1, dtype=np.int64)
        only_j = np.bitwise_count(bits[j] & ~bits[i]).sum(axis=1, dtype=np.int64)
        most = np.minimum(n[i] - only_i, n[j] - only_j)
        out[at : at + 65536] = 100 * most >= SIMILARITY * (n[i] + n[j] - most)
    return out


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in whole_groups(batches, ["key"]):
        key, n = table.column("key").to_numpy(), table.column("n").to_numpy()
        bits = _words(table.column("bits"))
        ids, node = np.unique(table.column("class").to_numpy(), return_inverse=True)
        root = np.arange(len(ids))
        active, step = np.arange(len(key)), 0
        while len(active):
            step += 1
            active = active[active + step < len(key)]
            # Sorted by size: once the band ends it stays so.
            active = active[(key[active + step] == key[active]) & (100 * n[active] >= SIMILARITY * n[active + step])]
            i = active[root[node[active]] != root[node[active + step]]]
            i = i[may_link(n, bits, i, i + step)]
            if len(i):
                again = forest(root[node[i]], root[node[i + step]], len(ids))
                root = again[root]
        own = np.flatnonzero(root != np.arange(len(ids)))
        yield pa.RecordBatch.from_pydict({"a": ids[own], "b": ids[root[own]]})


def exact(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted arrays of distinct values are similar enough."""
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    common = int((y[at] == x).sum())
    return 100 * common >= SIMILARITY * (len(x) + len(y) - common)


def _slot(ids: np.ndarray, slots: int) -> np.ndarray:
    return (mix(ids.astype(np.uint64)) & _U(slots - 1)).astype(np.int64)


def _member_words(slots: int):
    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = _slot(batch.column("rep").to_numpy(), slots)
            yield pa.RecordBatch.from_pydict({"word": slot >> 6, "marks": np.left_shift(1, slot & 63)})

    return words


def member_filter(members: DataFrame) -> np.ndarray:
    """A bit for each slot of the ids ``rep``: 16 for each of them, 16 MB at most whatever their number."""
    slots = 1 << max(16 * members.count(), 1).bit_length()
    slots = min(max(slots, MEMBER_BITS[0]), MEMBER_BITS[1])
    got = members.select("rep").mapInArrow(_member_words(slots), "word long, marks long").groupBy("word").agg(F.bit_or("marks").alias("marks")).toArrow()
    out = np.zeros(slots >> 6, np.int64)
    out[got.column("word").to_numpy()] = got.column("marks").to_numpy()
    return out


def _set_rows(marks):
    """The shingle arrays, as binary, of the documents whose id's slot is marked."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = marks.value
        for batch in batches:
            slot = _slot(batch.column("doc_id").to_numpy(), 64 * len(words))
            batch = batch.filter(pa.array((words[slot >> 6] >> (slot & 63)) & 1 == 1))
            for slab in slabs(batch.column("text"), lower=True):
                h, first = sets(slab)
                total = np.concatenate([[_U(0)], np.cumsum(h)])
                hashes = pa.Array.from_buffers(pa.large_binary(), len(first) - 1, [None, pa.py_buffer(8 * first.astype(np.int64)), pa.py_buffer(h)])
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id")[slab.rows.start : slab.rows.stop],
                        "s1": (total[first[1:]] - total[first[:-1]]).view(np.int64),
                        "hashes": hashes.cast(pa.binary()),
                    }
                )

    return build


def _arrays(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
    arrays = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
    sizes = np.array([len(x) for x in arrays])
    first = np.concatenate([[0], np.cumsum(sizes)])
    return arrays, bitmaps(np.concatenate(arrays) if arrays else np.zeros(0, np.uint64), first)


def _find(root: dict, x):
    while root[x] != x:
        root[x] = root[root[x]]
        x = root[x]
    return x


def _verified(groups: list[str], two_sided: bool) -> Callable:
    """Links inside each group, or between its sides 0 and 1; a spanning forest of them."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, groups, BLOCK):
            table = table.combine_chunks()
            n, ids = table.column("n").to_numpy(), table.column("rep").to_numpy()
            arrays, bits = _arrays(table)
            codes = np.zeros(len(ids), np.int64)
            for g in groups:
                codes = codes * 1_000_003 + np.unique(table.column(g).to_numpy(), return_inverse=True)[1]
            edges = np.append(np.flatnonzero(np.append(True, codes[1:] != codes[:-1])), len(codes))
            side = table.column("side").to_numpy() if two_sided else None
            label = table.column("label").to_numpy() if two_sided else ids
            root = {int(x): int(x) for x in np.unique(label)}
            links: list[tuple[int, int]] = []
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                rows = np.arange(low, high)
                for i in rows:
                    # Every pair meets once: with earlier rows, or side 0 with side 1.
                    j = rows[side[low:high] == 1] if two_sided and side[i] == 0 else rows[: i - low] if not two_sided else rows[:0]
                    j = j[(100 * np.minimum(n[i], n[j]) >= SIMILARITY * np.maximum(n[i], n[j])) & (ids[j] != ids[i])]
                    for k in j[may_link(n, bits, np.full(len(j), i), j)]:
                        a, b = _find(root, int(label[i])), _find(root, int(label[k]))
                        if a != b and exact(arrays[i], arrays[k]):
                            root[max(a, b)] = min(a, b)
                            links.append((int(ids[i]), int(ids[k])))
            yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return verify


def _candidates(prints: DataFrame) -> DataFrame:
    """a, b: links that join all classes (by s1) that may be similar."""
    spark = prints.sparkSession
    usable = prints.where("bits IS NOT NULL")
    postings = usable.select(F.col("s1").alias("class"), F.explode("lead").alias("key"))
    # Copies that several tasks have posted count more than once: any number orders the shingles, if all use the same.
    counted = postings.groupBy("key").agg(F.count(F.lit(1)).alias("count"), F.min("class").alias("_low"), F.max("class").alias("_high"))
    shared = counted.where("_low <> _high").select("key", F.least("count", F.lit(COMMON + 1)).cast("int").alias("count"))
    found = postings.join(shared, "key").distinct()
    own = found.groupBy("class").agg(F.sort_array(F.collect_list(F.struct("count", "key"))).alias("_found"))
    payload = usable.select(F.col("s1").alias("class"), "n", "bits").dropDuplicates(["class"])
    left = F.size("_found") - needed(F.col("n")) + 1
    rows = own.join(payload, "class").where(left > 0)
    rows, rows_path = staged_at(rows.select("class", "n", "bits", F.slice(F.col("_found")["key"], F.lit(1), left.cast("int")).alias("keys")), "prefixes")

    tiles = rows.select("class", F.explode("keys").alias("key"))
    members = [F.count(F.lit(1)).alias("size"), F.min("class").alias("head"), F.bit_xor(F.xxhash64("class")).alias("x"), F.bit_xor(F.xxhash64("class", F.lit(1))).alias("y")]
    same = tiles.groupBy("key").agg(*members).where("size > 1").groupBy("size", "head", "x", "y").agg(F.min("key").alias("key"))
    same, same_path = staged_at(same, "tiles")
    few = tiles.join(same.where(F.col("size") <= COMMON).select("key"), "key", "left_semi").join(rows.select("class", "n", "bits"), "class")
    few = few.select("key", "class", "n", "bits").repartition("key").sortWithinPartitions("key", "n", "class")
    many = tiles.join(same.where(F.col("size") > COMMON).select("key", "head"), "key").select(F.col("class").alias("a"), F.col("head").alias("b"))
    out = staged(few.mapInArrow(_tiles, "a long, b long").unionByName(many.distinct()), "candidates")
    remove(spark, rows_path)
    remove(spark, same_path)
    return out


def similar(docs: DataFrame) -> DataFrame:
    """Groups of ``docs`` (doc_id long, text) that links of similarity 0.8 or more make.

    Returns a row for each row: doc_id, n_shingles (set size) and component_id (smallest doc_id that links
    reach). Null and blank texts have an empty set and no links. Rows without an id have no links and no
    component. Rows of one doc_id with several texts link whatever any of them links. Other columns are
    ignored; an empty table gives none.
    """
    spark = prepare(docs.sparkSession)
    texts = docs.select("doc_id", "text")
    prints = staged(texts.mapInArrow(_prints, PRINTS), "prints")
    reps = prints.where("doc_id IS NOT NULL AND n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"))
    reps = staged(reps, "classes")
    reached = components(_candidates(prints))

    both = reached.unionByName(reached.select(F.col("component").alias("id"), "component")).distinct()
    members = reps.select("rep", "n", "s1").join(both.select(F.col("id").alias("s1"), F.col("component").alias("comp")), "s1")
    members = staged(members, "members")
    sizes = members.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    dealt = members.join(sizes, "comp").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks"))
    # A filter of bounded size tells which texts may be asked for, so the other texts are not shuffled.
    marks = spark.sparkContext.broadcast(member_filter(members))
    built = texts.where("doc_id IS NOT NULL").mapInArrow(_set_rows(marks), "doc_id long, s1 long, hashes binary")
    built = built.dropDuplicates(["doc_id", "s1"]).withColumnsRenamed({"doc_id": "rep"})
    built = built.join(dealt.drop("blocks"), ["rep", "s1"]).select("rep", (F.col("s1") == F.col("comp")).alias("first"), "comp", "block", "n", "hashes")
    built, built_path = staged_at(built, "sets")
    marks.destroy()

    # In every block of a divided component its first class takes part as well.
    large = staged(sizes.where("blocks > 1"), "large")
    guests = built.where("first").join(large, "comp").withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    guests = guests.where("_b <> block").select("rep", "first", "comp", F.col("_b").alias("block"), "n", "hashes")
    inside = built.unionByName(guests).repartition("comp", "block").sortWithinPartitions("comp", "block", "n", "rep")
    links = staged(inside.mapInArrow(_verified(["comp", "block"], False), "a long, b long"), "links")
    if large.count():
        links = links.unionByName(_across(built.join(large.select("comp"), "comp"), links))
    found = components(links).select(F.col("id").alias("rep"), "component")
    remove(spark, built_path)
    classes = staged(reps.join(found, "rep", "left").select("s1", "s2", F.coalesce("component", "rep").alias("component")), "found")
    rows = prints.select("doc_id", F.col("n").alias("n_shingles"), "s1", "s2").join(classes, ["s1", "s2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component).alias("component_id")
    return rows.select("doc_id", "n_shingles", component)


def _across(built: DataFrame, links: DataFrame) -> DataFrame:
    """Links between blocks: classes that are not linked to their component's first meet all blocks."""
    reached = components(links).select(F.col("id").alias("rep"), F.col("component").alias("_c"))
    rows = built.join(reached, "rep", "left").withColumn("label", F.coalesce("_c", "rep")).drop("_c")
    rows = staged(rows, "labels")
    main = rows.where("first").select("comp", F.col("label").alias("_main"))
    rest = rows.join(main, "comp").where("label <> _main")
    parts = rest.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    rest = rest.join(parts, "comp").withColumn("part", F.pmod(F.xxhash64("rep", F.lit(5)), "parts"))
    blocks = rows.select("comp", "block").distinct()
    pairs = rest.select("comp", "part").distinct().join(blocks, "comp")
    left = rest.join(pairs, ["comp", "part"]).select("comp", "part", pairs["block"].alias("block"), F.lit(0).alias("side"), "rep", "label", "n", "hashes")
    right = rows.join(pairs, ["comp", "block"]).select("comp", "part", "block", F.lit(1).alias("side"), "rep", "label", "n", "hashes")
    work = left.unionByName(right).repartition("comp", "part", "block").sortWithinPartitions("comp", "part", "block", "side", "n")
    return staged(work.mapInArrow(_verified(["comp", "part", "block"], True), "a long, b long"), "across")


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose component has a smaller doc_id, and with one of the rows of an id and text.

    Rows without an id are in no component; of those with the same text one stays as well.
    """
    dropped = similar(docs).where("component_id < doc_id").select(F.col("doc_id").alias("_laurel_id")).distinct()
    kept = docs.join(dropped, F.col("doc_id") == F.col("_laurel_id"), "left_anti")
    repeated = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_laurel_rows")).where("_laurel_rows > 1").select(F.col("doc_id").alias("_laurel_id"))
    repeated = staged(repeated, "repeated")
    if repeated.isEmpty():
        return kept
    same = F.col("doc_id").eqNullSafe(F.col("_laurel_id"))
    return kept.join(repeated, same, "left_anti").unionByName(kept.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(read(spark, sf_dir, "documents"))
