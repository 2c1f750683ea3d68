"""Token-ID files in patched frame-of-reference blocks.

A file holds the token ids of some documents, one after the other, in blocks of 128 values. A block
keeps its minimum, the differences packed at the width that fits nine tenths of them, and a list of
exceptions (place and difference) for the rest. An index has the byte at which every block starts, so a
reader decodes only the blocks it needs; a document table has every document's id and first value.

Layout, little-endian: the 8-byte magic; documents, values, blocks (3 x uint64); document ids (int64);
nulls among them (bytes); first value of each document (uint64); block starts (uint64, one beyond the
last); the blocks: minimum (uint32), width (uint8), pad (uint8), exceptions (uint16), packed words
(uint64), exception differences (uint32), exception places (uint8).
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from laurel.llm.tables import prepare, read, scratch, staged
from laurel.llm.words import span_hashes, text_buffers

MAGIC = b"TOKPFOR1"
BLOCK = 128
FIT = 0.9  # share of a block's values that its width must hold
END_ID = 2
TOKENIZER = "byte_bpe_50k.json"
VALUES_PER_FILE = 8 << 20
SLAB_BYTES = 4 << 20
SLOTS = 1 << 21  # of a worker's table of known pieces; half of them may be filled


def _words(width: int) -> int:
    return 2 * width  # 128 values of some bits are that many 64-bit words


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of 128 values below ``2**width`` as rows of 64-bit words."""
    out = np.zeros((len(values), _words(width)), np.uint64)
    values = values.astype(np.uint64)
    for lane in range(BLOCK if width else 0):
        word, shift = divmod(lane * width, 64)
        out[:, word] |= values[:, lane] << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= values[:, lane] >> np.uint64(64 - shift)
    return out


def _unpack(packed: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(packed), BLOCK), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for lane in range(BLOCK if width else 0):
        word, shift = divmod(lane * width, 64)
        out[:, lane] = packed[:, word] >> np.uint64(shift)
        if shift + width > 64:
            out[:, lane] |= packed[:, word + 1] << np.uint64(64 - shift)
    return (out & mask).astype(np.uint32)


def encode_file(values: np.ndarray, doc_ids: list[int | None], first: np.ndarray) -> bytes:
    """The bytes of a file with these token ids (uint32) of these documents."""
    blocks = -(-len(values) // BLOCK)
    padded = np.full(blocks * BLOCK, values[-1] if len(values) else 0, np.uint32)
    padded[: len(values)] = values
    padded = padded.reshape(blocks, BLOCK)
    low = padded.min(axis=1, keepdims=True, initial=0xFFFFFFFF) if blocks else np.zeros((0, 1), np.uint32)
    rest = padded - low
    fits = np.sort(rest, axis=1)[:, int(np.ceil(FIT * BLOCK)) - 1] if blocks else np.zeros(0, np.uint32)
    width = np.ceil(np.log2(fits.astype(np.float64) + 1)).astype(np.int64)
    over = rest >= (np.uint64(1) << width.astype(np.uint64))[:, None]
    exceptions = over.sum(axis=1)
    sizes = 8 + 8 * 2 * width + 5 * exceptions
    starts = np.zeros(blocks + 1, np.uint64)
    starts[1:] = np.cumsum(sizes)
    body = np.zeros(int(starts[-1]), np.uint8)
    at = starts[:-1].astype(np.int64)
    head = np.zeros((blocks, 8), np.uint8)
    head[:, :4] = low.astype("<u4").view(np.uint8).reshape(blocks, 4)
    head[:, 4] = width
    head[:, 6:] = exceptions.astype("<u2").view(np.uint8).reshape(blocks, 2)
    body[at[:, None] + np.arange(8)] = head
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        packed = _pack(np.where(over[own], 0, rest[own]), int(w)).astype("<u8").view(np.uint8).reshape(len(own), -1)
        body[at[own, None] + 8 + np.arange(packed.shape[1])] = packed
    block, place = np.nonzero(over)
    nth = np.arange(len(block)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
    base = at[block] + 8 + 16 * width[block]
    body[(base + 4 * nth)[:, None] + np.arange(4)] = rest[block, place].astype("<u4").view(np.uint8).reshape(-1, 4)
    body[base + 4 * exceptions[block] + nth] = place
    ids = np.array([0 if x is None else x for x in doc_ids], "<i8")
    nulls = np.array([x is None for x in doc_ids], np.uint8)
    sizes = np.array([len(doc_ids), len(values), blocks], "<u8")
    return b"".join(
        x if isinstance(x, bytes) else x.tobytes()
        for x in (MAGIC, sizes, ids, nulls, first.astype("<u8"), starts.astype("<u8"), body)
    )


class TokenFile:
    """Reads a file's documents or any range of its values."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("Not a token file")
        self.bytes = np.frombuffer(data, np.uint8)
        docs, self.values, blocks = (int(x) for x in np.frombuffer(data, "<u8", 3, 8))
        at = 32
        ids = np.frombuffer(data, "<i8", docs, at)
        nulls = np.frombuffer(data, np.uint8, docs, at + 8 * docs)
        self.doc_ids = [None if n else int(x) for x, n in zip(ids, nulls, strict=True)]
        at += 9 * docs
        self.first = np.append(np.frombuffer(data, "<u8", docs, at).astype(np.int64), self.values)
        at += 8 * docs
        self.starts = np.frombuffer(data, "<u8", blocks + 1, at).astype(np.int64)
        self.body = at + 8 * (blocks + 1)

    def read(self, start: int, end: int) -> np.ndarray:
        """The values from ``start`` to ``end``: only the blocks that hold them are decoded."""
        if end <= start:
            return np.zeros(0, np.uint32)
        own = np.arange(start // BLOCK, -(-end // BLOCK))
        at = self.body + self.starts[own]
        head = self.bytes[at[:, None] + np.arange(8)]
        low = np.ascontiguousarray(head[:, :4]).view("<u4")
        width = head[:, 4].astype(np.int64)
        exceptions = np.ascontiguousarray(head[:, 6:]).view("<u2")[:, 0].astype(np.int64)
        out = np.zeros((len(own), BLOCK), np.uint32)
        for w in np.unique(width):
            rows = np.flatnonzero(width == w)
            packed = self.bytes[at[rows, None] + 8 + np.arange(8 * _words(int(w)))]
            out[rows] = _unpack(packed.view("<u8").reshape(len(rows), -1), int(w)) if w else 0
        block = np.repeat(np.arange(len(own)), exceptions)
        nth = np.arange(len(block)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
        base = at[block] + 8 + 16 * width[block]
        place = self.bytes[base + 4 * exceptions[block] + nth]
        out[block, place] = self.bytes[(base + 4 * nth)[:, None] + np.arange(4)].view("<u4")[:, 0]
        return (out + low).reshape(-1)[start - own[0] * BLOCK : end - own[0] * BLOCK]


class Encoder:
    """Token ids of whole texts.

    A text is cut where its pre-tokenizer certainly cuts it too: before a blank or line break that
    follows a character which is no white space, after a single line break, and between a letter and a
    following mark. The ids of the pieces are then the ids of the text. Each different piece goes
    through the tokenizer once; pieces are known by a 64-bit hash.
    """

    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        path = tokenizer if "/" in tokenizer else public_tokenizers.path(tokenizer)
        self.tokenizer = Tokenizer.from_file(path)
        self.reset()

    def reset(self) -> None:
        self.hash = np.zeros(SLOTS, np.uint64)
        self.entry = np.full(SLOTS, -1, np.int32)
        self.known = 0
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.start = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of every key, or -1."""
        slot = (keys & np.uint64(SLOTS - 1)).astype(np.int64)
        found = self.entry[slot]
        open_ = np.flatnonzero((self.hash[slot] != keys) & (found >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) % SLOTS
            found[open_] = self.entry[slot[open_]]
            open_ = open_[(self.hash[slot[open_]] != keys[open_]) & (found[open_] >= 0)]
        return found

    def _insert(self, keys: np.ndarray, entries: np.ndarray) -> None:
        slot = (keys & np.uint64(SLOTS - 1)).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            free = left[self.entry[slot[left]] < 0]
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.hash[slot[put]], self.entry[slot[put]] = keys[put], entries[put]
            left = left[self.entry[slot[left]] != entries[left]]
            slot[left] = (slot[left] + 1) % SLOTS

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        encoded = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        ids = [x.ids for x in encoded]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.uint32, int(lengths.sum()))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        have = self.known
        while have + len(ids) > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.length = np.concatenate([self.length, np.zeros_like(self.length)])
        self.pool[self.used : self.used + len(flat)] = flat
        self.start[have : have + len(ids)] = self.used + np.cumsum(lengths) - lengths
        self.length[have : have + len(ids)] = lengths
        self.used += len(flat)
        self.known += len(ids)
        self._insert(keys, np.arange(have, have + len(ids), dtype=np.int32))

    def _entries(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The entries of at most ``SLOTS // 2`` pieces; new ones are learned, in an empty table if need be."""
        missing = np.flatnonzero(self._find(keys) < 0)
        new, one = np.unique(keys[missing], return_index=True)
        rows = missing[one]
        if self.known + len(new) > SLOTS // 2:
            self.reset()
            new, rows = np.unique(keys, return_index=True)
        raw = memoryview(data)
        for at in range(0, len(new), SLOTS // 8):
            some = rows[at : at + SLOTS // 8]
            pieces = [str(raw[a:b], "utf-8") for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True)]
            self._learn(new[at : at + SLOTS // 8], pieces)
        return self._find(keys)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, an end id after each, and the number of ids of each text.

        Pieces are taken in runs that the table can hold, so a text may have any number of them.
        """
        texts = len(offsets) - 1
        starts = _cuts(data, offsets)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        keys = span_hashes(data, starts, ends)
        ids, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for at in range(0, len(keys), SLOTS // 2):
            some = slice(at, at + SLOTS // 2)
            piece = self._entries(keys[some], data, starts[some], ends[some])
            length = self.length[piece]
            before = np.cumsum(length) - length
            where = np.repeat(self.start[piece] - before, length) + np.arange(int(length.sum()))
            ids.append(self.pool[where])
            lengths.append(length)
        total = np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
        per_text = np.diff(total[np.searchsorted(starts, offsets)])
        out = np.full(int(total[-1]) + texts, END_ID, np.uint32)
        own = np.ones(len(out), bool)
        own[np.cumsum(per_text + 1) - 1] = False
        out[own] = np.concatenate(ids)
        return out, per_text + 1


def _cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces start."""
    kind = _KIND[data]
    last = np.zeros_like(kind)
    last[1:] = kind[:-1]
    accent = np.zeros(len(data), bool)  # the second byte of a letter from U+00C0 to U+00FF
    accent[1:] = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    after = np.zeros(len(data), bool)
    after[1:] = accent[:-1]
    solid = (last >= _MARK) & (last < _OTHER) | after
    letter = (last == _LETTER) | after
    cut = (kind <= _BREAK) & solid | (kind == _MARK) & letter
    # A line break between two characters that are no white space is a token of its own.
    lone = np.flatnonzero((data == 0x0A) & solid)
    lone = lone[lone + 1 < len(data)]
    follows = kind[lone + 1]
    lone = lone[(follows == _MARK) | (follows == _LETTER) | (data[lone + 1] == 0xC3)]
    cut[lone + 1] = True
    cut[offsets[offsets < len(data)]] = True
    return np.flatnonzero(cut)


# Kinds of bytes: blank, line break, mark, letter or digit, anything else. An apostrophe is of the last
# kind, as it may belong to what follows, and so are bytes that are not ASCII.
_BREAK, _MARK, _LETTER, _OTHER = 1, 2, 3, 4
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[0x20], _KIND[0x0A] = 0, _BREAK
_KIND[[ord(x) for x in ".,;:!?%$&*#()"]] = _MARK
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER


_encoders: dict[str, Encoder] = {}


def encoder(tokenizer: str) -> Encoder:
    """This worker's encoder: what it has learned serves later tasks too."""
    if tokenizer not in _encoders:
        _encoders[tokenizer] = Encoder(tokenizer)
    return _encoders[tokenizer]


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _writer(folder: str, tokenizer: str, limit: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, root = _filesystem(folder)
        fs.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        own, held, ids, counts, number = encoder(tokenizer), [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal held, ids, counts, number
            values, sizes = np.concatenate(held), np.concatenate(counts)
            # An attempt that fails leaves a file that no manifest names.
            name = f"{part:06d}-{number:06d}-{uuid.uuid4().hex}.tok"
            with fs.open_output_stream(f"{root}/{name}") as out:
                out.write(encode_file(values, ids, np.cumsum(sizes) - sizes))
            row = {"part": [part], "number": [number], "file": [name], "documents": [len(ids)], "values": [len(values)]}
            held, ids, counts, number = [], [], [], number + 1
            return pa.RecordBatch.from_pydict(row, MANIFEST)

        size = 0
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            docs, row = batch.column("doc_id").to_pylist(), 0
            while row < len(docs):
                end = int(np.searchsorted(offsets, offsets[row] + min(SLAB_BYTES, limit), "right")) - 1
                end = min(len(docs), max(end, row + 1))
                values, sizes = own.encode(data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row])
                held.append(values)
                counts.append(sizes)
                ids += docs[row:end]
                row, size = end, size + len(values)
                if size >= limit:
                    yield flush()
                    size = 0
        if ids:
            yield flush()

    return write


MANIFEST = pa.schema(
    [("part", pa.int64()), ("number", pa.int64()), ("file", pa.string()), ("documents", pa.int64()), ("values", pa.int64())]
)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, limit: int = VALUES_PER_FILE) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write token files to ``folder``, in ascending doc_id order.

    Returns the manifest: part, number, file, documents, values and start, the number of ids in all
    files before. Null texts are empty; a document without text has the end id only. Null ids come
    first, rows of equal ids follow the hash of their text. Other columns are ignored. An empty
    table writes no file. ``folder`` must be open to every executor; it is best in the shared folder.
    A file ends with the document that brings it to
    ``limit`` ids or more (or with a few more of them: texts are taken in slabs).
    """
    prepare(docs.sparkSession)
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order)
    schema = "part long, number long, file string, documents long, values long"
    manifest = staged(rows.mapInArrow(_writer(folder, tokenizer, limit), schema), "manifest")
    # One row per file is ordered here, nothing of the documents.
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("values").over(before), F.lit(0)))


def _reader(folder: str):
    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(folder)
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with fs.open_input_stream(f"{root}/{name}") as source:
                    file = TokenFile(source.read())
                doc, docs = 0, len(file.doc_ids)
                while doc < docs:
                    end = int(np.searchsorted(file.first, file.first[doc] + (1 << 20), "right")) - 1
                    end = min(docs, max(end, doc + 1))
                    ids = file.read(int(file.first[doc]), int(file.first[end])).astype("<u4")
                    inner = file.first[doc : end + 1] - file.first[doc]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(file.doc_ids[doc:end], pa.int64()),
                            "start": pa.array(start + file.first[doc:end]),
                            "ids": pa.Array.from_buffers(
                                pa.large_binary(), end - doc, [None, pa.py_buffer((4 * inner).astype(np.int64)), pa.py_buffer(ids)]
                            ).cast(pa.binary()),
                        }
                    )
                    doc = end

    return load


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """The documents of the files: doc_id, start and ids (binary, little-endian unsigned 32 bit)."""
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    files = manifest.select("file", "start").repartition(parts, "file")
    return files.mapInArrow(_reader(folder), "doc_id long, start long, ids binary")


def digest(read_back: DataFrame) -> DataFrame:
    return read_back.select(
        "doc_id",
        "start",
        F.expr("CAST(octet_length(ids) DIV 4 AS LONG)").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


def encoded(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Write ``docs`` to token files in the shared folder and describe what reading them gives."""
    folder = scratch(docs.sparkSession, "tokens")
    return digest(read_token_files(write_token_files(docs, folder, tokenizer), folder))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(read(spark, sf_dir, "documents"))



