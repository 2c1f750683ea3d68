"""Words of texts as numpy arrays, for use inside Spark tasks.

A word is a run of bytes other than ASCII white space (0x20, 0x09-0x0D), which for UTF-8 text is the
pattern ``[^\\x20\\x09-\\x0D]+``. Texts are taken in slabs of bounded size, so a task's memory does
not grow with its partition; one text is never cut.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLAB_BYTES = 2 << 20
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BYTE = np.random.Generator(np.random.PCG64(20)).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_STEP = _U(0x9E3779B97F4A7C15 | 5)  # odd, and 5 modulo 8: powers stay far apart modulo 2**64
_powers = {}


def powers(count: int) -> np.ndarray:
    """The first ``count`` powers of the step modulo 2**64."""
    have = _powers.get("up")
    if have is None or len(have) < count:
        size = 1 << max(12, int(count).bit_length())
        have = np.ones(size, np.uint64)
        have[1:] = _STEP
        _powers["up"] = have = np.multiply.accumulate(have)
    return have[:count]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


@dataclass
class Slab:
    """Some whole texts: their bytes, the words in them and the words' hashes.

    ``first`` has, for every text and one beyond the last, the number of its first word.
    """

    rows: slice
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, prefix: int | None = None) -> np.ndarray:
        """A 64-bit hash of every word, or of its first ``prefix`` bytes."""
        ends = self.ends if prefix is None else np.minimum(self.ends, self.starts + prefix)
        return span_hashes(self.data, self.starts, ends)


def is_space(data: np.ndarray) -> np.ndarray:
    return _SPACE[data]


# Bytes hashed at once: hashing takes about 32 bytes of memory for each.
HASHED_BYTES = 4 << 20


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes from every start to its end (at least one byte each)."""
    lengths = ends - starts
    if not len(lengths):
        return np.zeros(0, np.uint64)
    before = np.cumsum(lengths) - lengths
    cuts = np.unique(np.append(np.searchsorted(before, np.arange(0, before[-1] + 1, HASHED_BYTES)), len(lengths)))
    parts = []
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        own, first = lengths[low:high], before[low:high] - before[low]
        place = np.arange(int(own.sum())) - np.repeat(first, own)
        value = _BYTE[data[np.repeat(starts[low:high], own) + place]]
        value *= powers(int(own.max()))[place]
        parts.append(mix(np.add.reduceat(value, first)))
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


_MARK = np.zeros(256, bool)
_MARK[[ord(x) for x in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]] = True


def is_mark(data: np.ndarray) -> np.ndarray:
    return _MARK[data]


def trimmed(slab: Slab) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words without the marks around them; a word of marks keeps one."""
    starts, ends = slab.starts.copy(), slab.ends.copy()
    for edge, step in ((ends, -1), (starts, 1)):
        rows = np.arange(len(starts))
        while len(rows):
            at = edge[rows] - 1 if step < 0 else edge[rows]
            rows = rows[(ends[rows] - starts[rows] > 1) & _MARK[slab.data[at]]]
            edge[rows] += step
    return starts, ends


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of every ``k`` consecutive values of ``words`` (also across texts)."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - k + 1, np.uint64)
    for j, p in enumerate(powers(k)):
        out += words[j : len(words) - k + 1 + j] * p
    return mix(out)


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of string values and their offsets; a null is an empty text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and each text's first word; no word goes over a text's end."""
    word = ~_SPACE[data]
    begin, last = word.copy(), word.copy()
    begin[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begin[edges] = word[edges]
    last[edges - 1] = word[edges - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return freed memory to the system: Python workers live on, beside each other and the executor."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def slabs(texts: pa.Array, lower: bool = False, size: int = SLAB_BYTES) -> Iterator[Slab]:
    """The texts of an Arrow column, whole, in slabs of about ``size`` bytes."""
    data, offsets = text_buffers(texts)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1
        end = min(rows, max(end, row + 1))
        part = data[offsets[row] : offsets[end]]
        if lower:
            part = _LOWER[part]
        inner = offsets[row : end + 1] - offsets[row]
        yield Slab(slice(row, end), part, inner, *spans(part, inner))
        row = end
    give_back()
