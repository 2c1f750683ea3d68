"""Toxicity scores from two class-conditional Kneser-Ney models.

An expression is a word's path through a tree of prefixes (4, 6, 8 and 11 bytes, then all of the word;
marks around the word and case do not count). A longer run is cut at the marks inside it, and a part that
is still longer than the prefixes also gives windows: from each of its characters on, a path of 4, 6 and
8 bytes in a tree of their own. So texts without blanks count to their last byte. Each class has its own counts for every step of a path: for every word
below it the documents with that word, as Kneser-Ney counts contexts, not tokens. A step's probability is the
discounted class count plus the discounted mass times the probability that the counts of both classes
together give, so rare steps fall back to shared counts and differ little between the classes.

A document is scored by its toxic minus its ordinary log-likelihood, per word. Steps into what a class
has hardly seen make small ratios that add up over long texts, so a word counts with what its ratio
exceeds a margin by. Two margins give two figures; the plain difference, with all that speaks for
ordinary text, is the third. A logistic fit on held-back labels turns them into a probability. Words are
taken one by one: their order does not count. The models are then counted on all labels that may be learned from.

Counts are gathered by Spark over every labelled document of the sample. A task gets the models as sorted
arrays of whole 64-bit nodes, as many as the sample's texts have, so no node stands for another one. They pass
the driver in parts of bounded size, one after the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laurel.llm.labelled import FOLDS, LABELLED, fold, sample
from laurel.llm.tables import prepare, read, remove, staged_at
from laurel.llm.words import Slab, is_mark, mix, slabs, span_hashes, trimmed

LEVELS = (4, 6, 8, 11)
WINDOW = (4, 6, 8)  # bytes of the steps of a window in a part longer than the last of ``LEVELS``
WINDOW_WEIGHT = 0.25  # of a window beside a word's 1, as windows overlap
WINDOWS_ROOT = 1
DISCOUNT = 0.75
FLOOR = 1e-3  # probability of a step that neither class has seen, below a known place
MARGINS = (3.0, 1.0)
FIGURES = len(MARGINS) + 1
PART = 1 << 20  # ratios that the driver sends at once
SHORT = 20  # expressions added to a text's length, so that few words prove little


def runs(slab: Slab) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and texts of all words; words beyond the last prefix are cut at the marks in them."""
    starts, ends = trimmed(slab)
    doc = slab.doc_of_word()
    long = ends - starts > LEVELS[-1]
    size = (ends - starts)[long]
    if not len(size):
        return starts, ends, doc
    word = np.repeat(np.flatnonzero(long), size)
    at = starts[word] + np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
    mark = is_mark(slab.data[at])
    edge = np.append(True, word[1:] != word[:-1])
    begin = ~mark & (edge | np.append(True, mark[:-1]))
    end = ~mark & (np.append(edge[1:], True) | np.append(mark[1:], True))
    short = ~long
    return (
        np.concatenate([starts[short], at[begin]]),
        np.concatenate([ends[short], at[end] + 1]),
        np.concatenate([doc[short], doc[word[begin]]]),
    )


def paths(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For every word its node at each level (signed 64 bit) and the number of its last step."""
    length = ends - starts
    nodes = []
    for level, size in enumerate(LEVELS):
        h = span_hashes(data, starts, np.minimum(ends, starts + size))
        whole = (length <= size).astype(np.uint64)
        nodes.append(mix(h + np.uint64(2 * level) + whole).view(np.int64))
    nodes.append(mix(span_hashes(data, starts, ends) + np.uint64(2 * len(LEVELS))).view(np.int64))
    return nodes, np.searchsorted(LEVELS, length)


def windows(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of words beyond the last prefix: their bytes as a number, their lengths and their words."""
    own = np.flatnonzero(ends - starts > LEVELS[-1])
    size = (ends - starts)[own]
    word = np.repeat(own, size)
    at = starts[word] + np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
    head = (data[at] & 0xC0) != 0x80  # not inside a character
    word, at = word[head], at[head]
    length = np.minimum(ends[word] - at, WINDOW[-1])
    value = np.zeros(len(at), np.uint64)
    for j in range(WINDOW[-1]):
        inside = np.flatnonzero(length > j)
        value[inside] |= data[at[inside] + j].astype(np.uint64) << np.uint64(8 * j)
    return value, length, word


def window_paths(value: np.ndarray, length: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """As ``paths``, of windows."""
    nodes = []
    for level, size in enumerate(WINDOW):
        kept = value & np.uint64((1 << 8 * size) - 1)
        nodes.append(mix(mix(kept) + np.uint64(2 * (len(LEVELS) + 1 + level))).view(np.int64))
    return nodes, np.searchsorted(WINDOW, length)


COUNTED = pa.schema(
    [("level", pa.int32()), ("node", pa.int64()), ("parent", pa.int64()), ("part", pa.int32()), ("n", pa.int64())]
)


def _steps(nodes: list[np.ndarray], last: np.ndarray, counts: np.ndarray, base: int, root: int) -> Iterator[pa.RecordBatch]:
    """Rows of the steps of paths that come ``counts`` (a column for each part) times."""
    for level, node in enumerate(nodes):
        own = np.flatnonzero(last >= level)
        if not len(own):
            continue
        own = own[np.argsort(node[own])]
        at = node[own]
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        sums = np.add.reduceat(counts[own], first, axis=0)
        row, of = np.nonzero(sums)
        parent = nodes[level - 1][own[first]] if level else np.full(len(first), root, np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(row), base + level, np.int32)),
                pa.array(at[first][row]),
                pa.array(parent[row]),
                pa.array(of.astype(np.int32)),
                pa.array(sums[row, of]),
            ],
            schema=COUNTED,
        )


def _by_part(item: np.ndarray, doc: np.ndarray, part: np.ndarray, items: int) -> np.ndarray:
    """The texts of each part with each item."""
    item, doc = np.divmod(np.unique(item * len(part) + doc), len(part))
    return np.bincount(item * 4 + part[doc], minlength=4 * items).reshape(-1, 4)


def _distinct(slab: Slab) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the distinct words, and for each word its number among them and its text."""
    starts, ends, doc = runs(slab)
    _, one, word = np.unique(span_hashes(slab.data, starts, ends), return_index=True, return_inverse=True)
    return starts[one], ends[one], word, doc


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Steps by part (class and fold), each word once for each document, summed over a slab."""
    for batch in batches:
        part = batch.column("part").to_numpy()
        for slab in slabs(batch.column("text"), lower=True):
            starts, ends, word, doc = _distinct(slab)
            if not len(word):
                continue
            own = part[slab.rows].astype(np.int64)
            yield from _steps(*paths(slab.data, starts, ends), _by_part(word, doc, own, len(starts)), 0, 0)
            value, length, of = windows(slab.data, starts, ends)
            if not len(value):
                continue
            # Each distinct word's windows, for every text that has the word.
            pairs = np.unique(word * len(own) + doc)
            word, doc = np.divmod(pairs, len(own))
            low, high = np.searchsorted(of, word), np.searchsorted(of, word, "right")
            size = high - low
            at = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            _, one, window = np.unique(value, return_index=True, return_inverse=True)
            counts = _by_part(window[at], np.repeat(doc, size), own, len(one))
            yield from _steps(*window_paths(value[one], length[one]), counts, len(LEVELS) + 1, WINDOWS_ROOT)


def step_counts(labelled: DataFrame) -> DataFrame:
    """level, node, parent and the counts ``a0 a1 b0 b1`` by half and class.

    ``labelled`` has text and part (class + 2 for the second half). Each task sums its slabs before
    the shuffle.
    """
    rows = labelled.select("text", "part").mapInArrow(_count, "level int, node long, parent long, part int, n long")
    sums = [F.sum(F.when(F.col("part") == p, F.col("n")).otherwise(0)).alias(c) for p, c in enumerate(("a0", "a1", "b0", "b1"))]
    return rows.groupBy("level", "node", "parent").agg(*sums)


def _ratios(counts: DataFrame, ordinary: Column, toxic: Column) -> DataFrame:
    """known, at, value: the log ratio of each known step, and of an unknown step below a node."""
    rows = counts.select("level", "node", "parent", ordinary.alias("c0"), toxic.alias("c1")).where("c0 + c1 > 0")
    below = rows.groupBy("level", "parent").agg(
        *[F.sum(f"c{i}").alias(f"n{i}") for i in (0, 1)],
        *[F.count(F.when(F.col(f"c{i}") > 0, 1)).alias(f"u{i}") for i in (0, 1)],
    )
    joined = rows.join(below, ["level", "parent"])
    shared_mass = DISCOUNT * (F.col("u0") + F.col("u1")) * FLOOR
    shared = (F.greatest(F.col("c0") + F.col("c1") - DISCOUNT, F.lit(0.0)) + shared_mass) / (F.col("n0") + F.col("n1"))

    def log_p(i: int, backoff: Column, count: Column) -> Column:
        own = (F.greatest(count - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col(f"u{i}") * backoff) / F.col(f"n{i}")
        return F.log(F.when(F.col(f"n{i}") > 0, own).otherwise(backoff))

    zero = F.lit(0.0)
    unseen = shared_mass / (F.col("n0") + F.col("n1"))
    known = joined.select(F.lit(True).alias("known"), F.col("node").alias("at"), (log_p(1, shared, F.col("c1")) - log_p(0, shared, F.col("c0"))).alias("value"))
    unknown = below.select(F.lit(False).alias("known"), F.col("parent").alias("at"), (log_p(1, unseen, zero) - log_p(0, unseen, zero)).alias("value"))
    return known.unionByName(unknown).withColumn("value", F.col("value").cast("float"))


class Ratios:
    """Values by whole node: sorted nodes and, for the leading bits of a node, where such nodes begin."""

    def __init__(self, nodes: np.ndarray, values: np.ndarray):
        order = np.argsort(nodes.view(np.uint64))
        self.nodes, self.values = nodes.view(np.uint64)[order], values[order]
        bits = max(1, len(nodes).bit_length())
        self.shift = np.uint64(64 - bits)
        self.begin = np.searchsorted(self.nodes >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    def get(self, nodes: np.ndarray) -> np.ndarray:
        """The value of every node; NaN where there is none."""
        nodes = nodes.view(np.uint64)
        out = np.full(len(nodes), np.nan, np.float32)
        bucket = (nodes >> self.shift).astype(np.int64)
        at, end = self.begin[bucket], self.begin[bucket + 1]
        left = np.flatnonzero(at < end)
        while len(left):
            hit = self.nodes[at[left]] == nodes[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
        return out


class Parts:
    """``Ratios`` in parts by the leading bits of a node; a part may be a broadcast variable."""

    def __init__(self, parts: list, bits: int):
        self.parts, self.shift = parts, np.uint64(64 - bits) if bits else None

    def get(self, nodes: np.ndarray) -> np.ndarray:
        if self.shift is None:
            return self._part(0).get(nodes)
        out = np.full(len(nodes), np.nan, np.float32)
        place = nodes.view(np.uint64) >> self.shift
        for i in np.unique(place).tolist():
            own = np.flatnonzero(place == i)
            out[own] = self._part(i).get(nodes[own])
        return out

    def _part(self, i: int) -> Ratios:
        part = self.parts[i]
        return part if isinstance(part, Ratios) else part.value

    def destroy(self) -> None:
        for part in self.parts:
            if not isinstance(part, Ratios):
                part.destroy()


def tables(ratios: DataFrame, size: int = PART) -> tuple[Parts, Parts]:
    """The ratios of known steps by node and of unknown steps by parent, as broadcast variables.

    The driver has one part of about ``size`` ratios at a time, however many there are.
    """
    spark = ratios.sparkSession
    ratios, path = staged_at(ratios, "ratios")
    counts = {r.known: r["count"] for r in ratios.groupBy("known").count().collect()}
    out = []
    for known in (True, False):
        bits = max(0, -(-counts.get(known, 0) // size) - 1).bit_length()
        place = F.shiftrightunsigned("at", 64 - bits) if bits else F.lit(0)
        parts = []
        for i in range(1 << bits):
            got = ratios.where((F.col("known") == known) & (place == i)).select("at", "value").toArrow()
            parts.append(spark.sparkContext.broadcast(Ratios(got.column("at").to_numpy(), got.column("value").to_numpy())))
        out.append(Parts(parts, bits))
    remove(spark, path)
    return out[0], out[1]


def _path_ratios(nodes: list[np.ndarray], last: np.ndarray, model: tuple[Parts, Parts], root: int = 0) -> np.ndarray:
    """The sum of the log ratios of each path's steps; an unknown step takes its parent's backoff."""
    known, below = model
    ratio = np.zeros(len(last), np.float32)
    parent = np.full(len(last), root, np.int64)
    for level, node in enumerate(nodes):
        value = known.get(node)
        gap = np.flatnonzero(np.isnan(value) & (last >= level))
        value[gap] = below.get(parent[gap])
        ratio += np.where((last >= level) & ~np.isnan(value), value, 0)
        parent = node
    return ratio


def _features(slab: Slab, model: tuple[Parts, Parts]) -> np.ndarray:
    """Figures for each text: the mean of what the expressions' ratios exceed the margins by, and of the ratios."""
    starts, ends, word, doc = _distinct(slab)
    ratio = _path_ratios(*paths(slab.data, starts, ends), model)
    value, length, of = windows(slab.data, starts, ends)
    _, one, window = np.unique(value, return_index=True, return_inverse=True)
    inner = _path_ratios(*window_paths(value[one], length[one]), model, WINDOWS_ROOT)[window]
    texts, words = len(slab.counts), len(starts)
    weight = 1 + WINDOW_WEIGHT * np.bincount(of, minlength=words)
    weights = np.bincount(doc, weight[word], texts) + SHORT
    out = np.zeros((texts, FIGURES))
    for j, margin in enumerate(MARGINS):
        over = np.maximum(ratio - margin, 0).astype(np.float64)
        over += WINDOW_WEIGHT * np.bincount(of, np.maximum(inner - margin, 0), words)
        out[:, j] = np.log1p(100 * np.bincount(doc, over[word], texts) / weights)
    plain = ratio + WINDOW_WEIGHT * np.bincount(of, inner, words)
    out[:, -1] = np.bincount(doc, plain[word], texts) / weights
    return out


def _scorer(model, weights: np.ndarray | None, name: str = ""):
    """Scores the last column, which goes; without ``weights`` it gives the features."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [_features(slab, model) for slab in slabs(batch.column(batch.num_columns - 1), lower=True)]
            x = np.concatenate(parts) if parts else np.zeros((0, FIGURES))
            kept = {n: batch.column(n) for n in batch.schema.names[:-1]}
            if weights is None:
                yield pa.RecordBatch.from_pydict(kept | {f"x{j}": pa.array(x[:, j]) for j in range(FIGURES)})
            else:
                z = weights[0] + x @ weights[1:]
                yield pa.RecordBatch.from_pydict(kept | {name: pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))})

    return score


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Intercept and weights, by Newton's steps; weights below zero are left out."""
    keep = list(range(x.shape[1]))
    while True:
        a = np.column_stack([np.ones(len(x)), x[:, keep]])
        w = np.zeros(a.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            hessian = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
            step = np.linalg.solve(hessian, a.T @ (y - p) - ridge * w)
            w += np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-8:
                break
        if len(keep) == 0 or (w[1:] >= 0).all():
            break
        keep.pop(int(np.argmin(w[1:])))
    out = np.zeros(x.shape[1] + 1)
    out[0] = w[0]
    out[[1 + k for k in keep]] = w[1:]
    return out


class ToxicityModel:
    """Both models and the fit; ``score`` adds a probability to any documents."""

    def __init__(self, model: tuple[Parts, Parts] | None, weights: np.ndarray):
        self.model, self.weights = model, weights

    def score(self, docs: DataFrame, keep: list[str], name: str = "score") -> DataFrame:
        """The ``keep`` columns of ``docs``, which has a text, and the probability ``name`` (double).

        Null, empty and blank texts have no words and so the score of no evidence. Whole texts count.
        ``name`` must not be one of ``keep``.
        """
        rows = docs.select(*keep, F.col("text").alias("_laurel_text"))
        if self.model is None:
            return rows.select(*keep, F.lit(float(self.weights[0])).alias(name))
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
        return rows.mapInArrow(_scorer(self.model, self.weights, name), f"{fields}, `{name}` double")


def learn(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> ToxicityModel:
    """Learn from ``docs`` (doc_id, text) as ``labels`` (doc_id, toxic) mark them, but for fold 0.

    At most about ``labelled`` labels are used, chosen by a hash; only those are broadcast. Null ids
    and labels are not used; a label that is given twice counts as toxic if it ever is. With no
    document of one class every score is 0 (or 1 if all are toxic).
    """
    spark = prepare(docs.sparkSession)
    marks = sample(labels, "toxic", labelled)
    # The last fold is held back for the logistic fit.
    second = (fold(F.col("_id")) == FOLDS - 1).cast("int")
    marks = marks.select("_id", (F.col("toxic") + 2 * second).alias("part"))
    rows = docs.select("doc_id", "text").join(F.broadcast(marks), F.col("doc_id") == F.col("_id"))
    counts, counts_path = staged_at(step_counts(rows), "steps")
    seen = {r.part: r.n for r in marks.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, ordinary = seen.get(1, 0) + seen.get(3, 0), seen.get(0, 0) + seen.get(2, 0)
    if not toxic or not ordinary:
        return ToxicityModel(None, np.array([1.0 if toxic else 0.0]))
    first = tables(_ratios(counts, F.col("a0"), F.col("a1")))
    fields = "part int, " + ", ".join(f"x{j} double" for j in range(FIGURES))
    held = rows.where("part >= 2").select("part", "text").mapInArrow(_scorer(first, None), fields).toArrow()
    y = held.column("part").to_numpy() - 2.0
    x = np.column_stack([held.column(f"x{j}").to_numpy() for j in range(FIGURES)])
    weights = fit_logistic(x, y) if len(y) else np.array([-2.0, 1.0, 0.0, 0.0])
    for part in first:
        part.destroy()
    model = tables(_ratios(counts, F.col("a0") + F.col("b0"), F.col("a1") + F.col("b1")))
    remove(spark, counts_path)
    return ToxicityModel(model, weights)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = learn(docs, read(spark, sf_dir, "labels"))
    scored = model.score(docs, ["doc_id"])
    held_out = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
