"""Substring deduplication by recompression: long repeats are removed but for their first occurrence.

A repeat is a window of 20 words whose words also start earlier. Texts are parsed into symbols in three
rounds. Each round gives every symbol a side by its name; where a left symbol is followed by a right one,
the two get one name made of both. Names depend on what they stand for only, so they agree in the whole
corpus, and whether two neighbours are joined depends on them alone: at the edge of a repeat a round can
lose one symbol, of at most 1, 2 and 4 words. Of the symbols of a 20-word repeat the first boundary that
all its occurrences share is therefore at most 7 words from its start. A name for the 13 words from each
boundary ("cut") on is equal in all of them. Equal neighbours are never joined; the equal names that a run
of one word has at all its cuts are one name.

1. Texts are gathered in blocks, written once. Each block sends its different names, by hash, to buckets;
   a bucket tells each block which of them other blocks have too.
2. Windows around the cuts that are named more than once are named by their own 20 words. Each block
   sends the names with the document of its first occurrence; a bucket finds the block that has the
   first one of all and tells the others.
3. Each block removes the words of all windows but the first occurrences.

A name leaves a block once however often it occurs there, so a passage in a third of all documents sends
one row from each block. What a bucket holds is what the number of shuffle partitions makes of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laurel.llm.jaccard import whole_groups
from laurel.llm.tables import prepare, read, staged
from laurel.llm.words import Slab, grams, mix, slabs, span_hashes

WINDOW = 20
ROUNDS = 3
LOST = 2**ROUNDS - 1  # words from a repeat's start to the first shared boundary
CUT_WORDS = WINDOW - LOST
BLOCK_BYTES = 4 << 20
CUT_BYTES = 5  # of a cut's name that are sent: a chance agreement costs a look at a window, no more
_U = np.uint64

BLOCKS = "block long, size long, lengths array<int>, doc_ids array<bigint>, data binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, number = TaskContext.get().partitionId(), 0
    for batch in batches:
        for slab in slabs(batch.column("text"), size=BLOCK_BYTES):
            ids = batch.column("doc_id")[slab.rows.start : slab.rows.stop].to_pylist()
            row = {
                "block": pa.array([(part << 32) + number]),
                "size": pa.array([len(slab.data)]),
                "lengths": pa.array([np.diff(slab.offsets).astype(np.int32)], pa.list_(pa.int32())),
                "doc_ids": pa.array([ids], pa.list_(pa.int64())),
                "data": pa.array([pa.compress(np.ascontiguousarray(slab.data).tobytes(), "zstd", asbytes=True)], pa.binary()),
            }
            number += 1
            yield pa.RecordBatch.from_pydict(row)


class Block:
    """The words of a block's texts."""

    def __init__(self, row: dict):
        data = pa.decompress(row["data"], row["size"], "zstd", asbytes=True) if row["size"] else b""
        offsets = np.concatenate([[0], np.cumsum(row["lengths"])]).astype(np.int64)
        texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        self.slab: Slab = next(slabs(texts.cast(pa.large_string()), size=max(1, len(data))))
        self.doc_ids = row["doc_ids"]
        self.words = self.slab.hashes()
        self.doc = self.slab.doc_of_word()

    def inside(self, at: np.ndarray, size: int) -> np.ndarray:
        """Whether ``size`` words from each of the places ``at`` on are of one text."""
        end = at + size - 1
        ok = end < len(self.words)
        ok[ok] = self.doc[at[ok]] == self.doc[end[ok]]
        return ok

    def cuts(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of the cuts and their names."""
        name, start, doc = self.words, np.arange(len(self.words)), self.doc
        for number in range(ROUNDS):
            left = (mix(name + _U(number + 1)) & _U(1)).astype(bool)
            join = left[:-1] & ~left[1:] & (doc[:-1] == doc[1:])
            first, second = np.flatnonzero(join), np.flatnonzero(join) + 1
            name = name.copy()
            name[first] = mix(name[first] * _U(3) + name[second] * _U(5) + _U(number))
            keep = np.ones(len(name), bool)
            keep[second] = False
            name, start, doc = name[keep], start[keep], doc[keep]
        start = start[self.inside(start, CUT_WORDS)]
        return start, grams(self.words, CUT_WORDS)[start]

    def windows(self, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows around cuts and their names."""
        near = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(near, np.maximum(cuts - LOST, 0), 1)
        np.add.at(near, cuts + 1, -1)
        start = np.flatnonzero(np.cumsum(near[:-1]) > 0)
        start = start[self.inside(start, WINDOW)]
        return start, grams(self.words, WINDOW)[start] if len(start) else np.zeros(0, np.uint64)

    def order(self) -> np.ndarray:
        """The texts' rank: null ids first, by id, then by the text's hash."""
        return np.argsort(np.lexsort((self.text_hashes(), self.ids(), self.known())))

    def ids(self) -> np.ndarray:
        return np.array([0 if x is None else x for x in self.doc_ids], np.int64)

    def known(self) -> np.ndarray:
        return np.array([x is not None for x in self.doc_ids], np.int64)

    def text_hashes(self) -> np.ndarray:
        out = np.zeros(len(self.doc_ids), np.uint64)
        some = np.flatnonzero(np.diff(self.slab.offsets))
        out[some] = span_hashes(self.slab.data, self.slab.offsets[some], self.slab.offsets[some + 1])
        return out.view(np.int64)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _short(names: np.ndarray, buckets: int) -> np.ndarray:
    """What of a name is sent, given its bucket."""
    return (names // _U(buckets)) & _U((1 << (8 * CUT_BYTES)) - 1)


def _dealt(names: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different names in the order of bucket and name, each bucket's first, and each name's place."""
    different, back = np.unique(names, return_inverse=True)
    bucket = (different % _U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return different[order], np.searchsorted(bucket[order], np.arange(buckets + 1)), place[back]


def _send_cuts(buckets: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            _, names = Block(row).cuts()
            names, first, _ = _dealt(names, buckets)
            short = _short(names, buckets).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :CUT_BYTES].tobytes()
            own = np.flatnonzero(np.diff(first))
            yield pa.RecordBatch.from_pydict(
                {
                    "bucket": pa.array(own),
                    "block": pa.array(np.full(len(own), row["block"])),
                    "names": pa.array([short[CUT_BYTES * first[b] : CUT_BYTES * first[b + 1]] for b in own], pa.binary()),
                }
            )

    return send


def _reply(bucket: int, block: np.ndarray, place: np.ndarray, names: list[int]) -> pa.RecordBatch:
    """For each block the places of the names, among those it sent, that are told to it."""
    order = np.lexsort((place, block))
    block, place = block[order], place[order].astype("<u4")
    edges = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1]))[: len(block)], len(block))
    spans = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
    return pa.RecordBatch.from_pydict(
        {
            "block": pa.array([names[block[a]] for a, _ in spans], pa.int64()),
            "bucket": pa.array([bucket] * len(spans), pa.int64()),
            "places": pa.array([place[a:b].tobytes() for a, b in spans], pa.binary()),
        }
    )


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    for table in whole_groups(batches, ["bucket"], 1):
        bucket = table.column("bucket").to_numpy()
        edges = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
        for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            yield int(bucket[low]), table.slice(low, high - low)


def _shared_cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for bucket, table in _buckets(batches):
        blocks, sent = table.column("block").to_pylist(), table.column("names").to_pylist()
        counts = np.array([len(x) // CUT_BYTES for x in sent])
        wide = np.zeros((int(counts.sum()), 8), np.uint8)
        wide[:, :CUT_BYTES] = np.frombuffer(b"".join(sent), np.uint8).reshape(-1, CUT_BYTES)
        names = wide.view("<u8")[:, 0]
        order = np.argsort(names, kind="stable")
        same = names[order][1:] == names[order][:-1]
        twice = np.append(same, False) | np.append(False, same)
        own = order[twice[: len(order)]]
        block = np.searchsorted(np.cumsum(counts), own, "right")
        yield _reply(bucket, block, own - (np.cumsum(counts) - counts)[block], blocks)


def _told(replies: list | None, first: np.ndarray) -> np.ndarray:
    """Which of a block's names, in sent order, replies are about."""
    out = np.zeros(int(first[-1]), bool)
    for reply in replies or []:
        out[first[reply["bucket"]] + np.frombuffer(reply["places"], "<u4")] = True
    return out


def _repeated_windows(block: Block, replies: list | None, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows around the cuts whose name another block or another cut of the block has too."""
    cuts, names = block.cuts()
    different, first, place = _dealt(names, buckets)
    told = _told(replies, first)
    told |= np.bincount(place, minlength=len(different)) > 1
    return block.windows(cuts[told[place]])


def _send_windows(buckets: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            block = Block(row)
            start, names = _repeated_windows(block, row["cuts"], buckets)
            if not len(start):
                continue
            different, first, place = _dealt(names, buckets)
            rank = block.order()
            earliest = np.full(len(different), len(rank), np.int64)
            np.minimum.at(earliest, place, rank[block.doc[start]])
            doc = np.argsort(rank)[earliest]
            ids, known, texts = block.ids(), block.known(), block.text_hashes()
            own = np.flatnonzero(np.diff(first))
            columns: dict[str, list] = {"bucket": [], "names": [], "docs": [], "table": []}
            for b in own.tolist():
                part = slice(first[b], first[b + 1])
                used, at = np.unique(doc[part], return_inverse=True)
                columns["bucket"].append(b)
                columns["names"].append(different[part].astype("<u8").tobytes())
                columns["docs"].append(at.astype("<u4" if len(used) > 65535 else "<u2").tobytes())
                columns["table"].append(np.stack([known[used], ids[used], texts[used], used]).astype("<i8").tobytes())
            kinds = {"bucket": pa.int64(), "names": pa.binary(), "docs": pa.binary(), "table": pa.binary()}
            arrays = {n: pa.array(v, kinds[n]) for n, v in columns.items()}
            yield pa.RecordBatch.from_pydict(arrays | {"block": pa.array(np.full(len(own), row["block"]))})

    return send


def _later_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for bucket, table in _buckets(batches):
        blocks = table.column("block").to_pylist()
        names = [np.frombuffer(x, "<u8") for x in table.column("names").to_pylist()]
        counts = np.array([len(x) for x in names])
        docs, base = [], 0
        tables = [np.frombuffer(x, "<i8").reshape(4, -1) for x in table.column("table").to_pylist()]
        for x, n, t in zip(table.column("docs").to_pylist(), counts, tables, strict=True):
            docs.append(np.frombuffer(x, f"<u{len(x) // n}").astype(np.int64) + base)
            base += t.shape[1]
        known, ids, texts, index = np.concatenate(tables, axis=1)
        of = np.repeat(np.arange(len(tables)), [t.shape[1] for t in tables])
        block_id = np.array(blocks)[of]
        rank = np.argsort(np.lexsort((index, block_id, texts, ids, known)))
        names, rank = np.concatenate(names), rank[np.concatenate(docs)]
        order = np.lexsort((rank, names))
        later = np.append(False, names[order][1:] == names[order][:-1])[: len(order)]
        own = order[later]
        block = np.searchsorted(np.cumsum(counts), own, "right")
        yield _reply(bucket, block, own - (np.cumsum(counts) - counts)[block], blocks)


def _cleaned(buckets: int):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            block = Block(row)
            slab, size = block.slab, len(block.words)
            start, names = _repeated_windows(block, row["cuts"], buckets)
            cover = np.zeros(size + 1, np.int64)
            if len(start):
                _, first, place = _dealt(names, buckets)
                rank = block.order()[block.doc[start]]
                # The first occurrence in the block stays if no other block has an earlier one.
                order = np.lexsort((start, rank, place))
                leader = np.append(True, place[order][1:] != place[order][:-1])
                stays = np.zeros(len(start), bool)
                stays[order[leader]] = True
                stays &= ~_told(row["windows"], first)[place]
                np.add.at(cover, start[~stays], 1)
                np.add.at(cover, start[~stays] + WINDOW, -1)
            kept = np.cumsum(cover[:-1]) == 0
            # Kept words, each followed by a blank; a text's last blank is left out.
            words = np.flatnonzero(kept)
            lengths = slab.ends[words] - slab.starts[words] + 1
            ends = np.cumsum(lengths)
            place = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - lengths, lengths)
            source = np.repeat(slab.starts[words], lengths) + place
            data = np.append(slab.data, np.uint8(0x20))[np.minimum(source, len(slab.data))]
            data[ends - 1] = 0x20
            doc = block.doc[words]
            last = np.append(doc[1:] != doc[:-1], True)[: len(doc)]
            body = np.ones(len(data), bool)
            body[ends[last] - 1] = False
            sizes = np.bincount(doc, lengths, minlength=len(block.doc_ids)).astype(np.int64) - (np.bincount(doc, minlength=len(block.doc_ids)) > 0)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            texts = pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data[body])])
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array(block.doc_ids, pa.int64()),
                    "text": texts.cast(pa.string()),
                    "n_words": pa.array(slab.counts.astype(np.int64)),
                    "n_removed": pa.array(np.bincount(block.doc, ~kept, minlength=len(block.doc_ids)).astype(np.int64)),
                }
            )

    return clean


def _by_block(replies: DataFrame, name: str) -> DataFrame:
    return replies.groupBy("block").agg(F.collect_list(F.struct("bucket", "places")).alias(name))


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) without the words of repeated windows but for their first occurrence.

    Earlier is what has the smaller doc_id (null first), among rows of one id the smaller text hash, among
    equal rows any, and within a text the smaller start. Windows are judged on the input. Returns a row
    for each row: doc_id, text (kept words, joined by one blank), n_words and n_removed. Null and empty
    texts have no words; texts of fewer than 20 words lose nothing. Words are runs of anything but ASCII
    white space and are not changed. Other columns are ignored; an empty table gives none.
    """
    spark = prepare(docs.sparkSession)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = staged(docs.select("doc_id", "text").mapInArrow(_blocks, BLOCKS), "blocks")
    sent = blocks.mapInArrow(_send_cuts(buckets), "bucket long, block long, names binary")
    fields = "block long, bucket long, places binary"
    # Buckets are numbered by hash, so a partition may have several; each is taken as a whole.
    shared = sent.repartition("bucket").sortWithinPartitions("bucket", "block").mapInArrow(_shared_cuts, fields)
    cuts = staged(_by_block(shared, "cuts"), "cuts")
    asked = blocks.join(cuts, "block", "left")
    sent = asked.mapInArrow(_send_windows(buckets), "bucket long, names binary, docs binary, table binary, block long")
    later = sent.repartition("bucket").sortWithinPartitions("bucket", "block").mapInArrow(_later_windows, fields)
    windows = staged(_by_block(later, "windows"), "later")
    answered = asked.join(windows, "block", "left")
    return answered.mapInArrow(_cleaned(buckets), "doc_id long, text string, n_words long, n_removed long")


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = without_repeats(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
