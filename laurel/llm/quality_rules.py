"""Quality rules with thresholds that follow each language and source.

Every text is measured (words, symbols, repeated lines and windows). The measures of a language and source
are summed up in a quantile sketch: counts of log-linear buckets, exact below ``EXACT`` and within a 32nd
above. Sketches are merged by adding counts, so Spark's partial aggregates do it before the shuffle, and the
sketches of a language and of the whole table are the sums of those below. A threshold lies ``SPREAD``
times the distance between median and quartile beyond the median, and a slack that says which differences
are too small to matter. Groups of fewer than ``SUPPORT`` texts take their language's thresholds, or the
whole table's where that has fewer too. Texts are then joined to their group's thresholds.

Everything in a sketch is a whole number, so thresholds do not depend on the order of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from laurel.llm.tables import prepare, read, staged
from laurel.llm.words import Slab, grams, is_space, mix, slabs, span_hashes

WINDOW = 8
FEWEST_WORDS = 20
MOST_REPEATED = 30  # per cent
SUPPORT = 100
SPREAD = 3
EXACT = 64
_U = np.uint64
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


@dataclass(frozen=True)
class Measure:
    """A share in thousandths, the difference that does not matter, and whether small values are bad too."""

    name: str
    part: str
    whole: str
    slack: int
    two_sided: bool = False

    def value(self) -> Column:
        return F.when(F.col(self.whole) > 0, F.floor(1000 * F.col(self.part) / F.col(self.whole)))


MEASURES = (
    Measure("word_length", "word_chars", "n_words", 2000, True),
    Measure("symbols", "n_symbols", "n_words", 1000),
    Measure("dup_lines", "n_dup_lines", "n_lines", 500),
    Measure("repeats", "n_repeat_words", "n_words", 300),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _per_text(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def lines(slab: Slab) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every line that has a word, and the number of its text."""
    cuts = np.flatnonzero(slab.data == 0x0A)
    starts = np.unique(np.concatenate([slab.offsets[:-1], cuts + 1]))
    starts = starts[starts < len(slab.data)]
    ends = np.append(starts[1:], len(slab.data))[: len(starts)]
    ends = ends - (slab.data[ends - 1] == 0x0A)
    # A line has a word if one begins in it: lines are cut at white space or at a text's end.
    full = np.searchsorted(slab.starts, ends) > np.searchsorted(slab.starts, starts)
    starts, ends = starts[full], ends[full]
    return span_hashes(slab.data, starts, ends), np.searchsorted(slab.offsets, starts, "right") - 1


def repeated(slab: Slab) -> np.ndarray:
    """Which words stand in a window that its text has twice or more."""
    hashes, doc = slab.hashes(), slab.doc_of_word()
    found = grams(hashes, WINDOW)
    covered = np.zeros(len(hashes) + 1, np.int64)
    inside = np.flatnonzero(doc[: len(found)] == doc[WINDOW - 1 :]) if len(found) else np.zeros(0, np.int64)
    if len(inside):
        own = mix(found[inside] + doc[inside].astype(np.uint64) * _U(0x9E3779B97F4A7C15))
        _, back, count = np.unique(own, return_inverse=True, return_counts=True)
        starts = inside[count[back] > 1]
        covered[starts] += 1
        np.subtract.at(covered, starts + WINDOW, 1)
    return np.cumsum(covered[:-1]) > 0


def measures(slab: Slab) -> dict[str, np.ndarray]:
    texts = len(slab.counts)
    lead = (slab.data & 0xC0) != 0x80  # the first byte of a code point
    line, of = lines(slab)
    new = np.unique(mix(line + of.astype(np.uint64) * _U(0x9E3779B97F4A7C15)), return_index=True)[1]
    n_lines = np.bincount(of, minlength=texts)
    return {
        "n_words": slab.counts,
        "word_chars": _per_text(lead & ~is_space(slab.data), slab.offsets),
        "n_symbols": _per_text(_SYMBOL[slab.data], slab.offsets),
        "n_lines": n_lines,
        "n_dup_lines": n_lines - np.bincount(of[new], minlength=texts),
        "n_repeat_words": _per_text(repeated(slab), slab.first),
    }


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for slab in slabs(batch.column("text")):
            rows = slab.rows.start, slab.rows.stop - slab.rows.start
            own = {c: batch.column(c).slice(*rows) for c in ("doc_id", "lang", "source")}
            yield pa.RecordBatch.from_pydict(own | {k: pa.array(v.astype(np.int64)) for k, v in measures(slab).items()})


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and ``COUNTS`` of every row; null is an empty text."""
    schema = "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS)
    return docs.select("doc_id", "lang", "source", "text").mapInArrow(_measured, schema)


def bucket(value: Column) -> Column:
    """Log-linear: half of ``EXACT`` buckets for each power of two."""
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return 32 * shift + F.call_function("shiftright", value, shift)


def least(number: Column) -> Column:
    """The smallest value of a bucket."""
    shift = F.greatest(F.floor(number / 32) - 1, F.lit(0)).cast("int")
    return F.call_function("shiftleft", (number - 32 * shift).cast("long"), shift)


def sketch(rows: DataFrame) -> DataFrame:
    """lang, source, measure, bucket and count, of all ``rows`` of ``measured``; one row per non-empty bucket."""
    values = F.explode(F.array(*(F.struct(F.lit(m.name).alias("measure"), m.value().cast("long").alias("value")) for m in MEASURES))).alias("m")
    long = rows.select("lang", "source", values).where("m.value IS NOT NULL")
    return long.groupBy("lang", "source", F.col("m.measure").alias("measure"), bucket(F.col("m.value")).alias("bucket")).agg(F.count(F.lit(1)).alias("count"))


def merged(sketches: DataFrame, *scope: str) -> DataFrame:
    """Sketches added up over all columns but ``scope``."""
    return sketches.groupBy(*scope, "measure", "bucket").agg(F.sum("count").alias("count"))


def limits(sketches: DataFrame, *scope: str) -> DataFrame:
    """For each scope its number of texts and every measure's least and most accepted value."""
    whole = Window.partitionBy(*scope, "measure")
    so_far = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    reached = sketches.withColumns({"so_far": F.sum("count").over(so_far), "size": F.sum("count").over(whole)})
    quarter = {f"q{k}": least(F.min(F.when(4 * F.col("so_far") >= k * F.col("size"), F.col("bucket")))) for k in (1, 2, 3)}
    quartiles = reached.groupBy(*scope, "measure").agg(F.max("size").alias("size"), *(c.alias(n) for n, c in quarter.items()))
    wide = [F.max("size").alias("size")]
    for m in MEASURES:
        own = F.col("measure") == m.name
        wide.append(F.max(F.when(own, F.col("q2") + SPREAD * (F.col("q3") - F.col("q2")) + m.slack)).alias(f"{m.name}_most"))
        if m.two_sided:
            wide.append(F.max(F.when(own, F.col("q2") - SPREAD * (F.col("q2") - F.col("q1")) - m.slack)).alias(f"{m.name}_least"))
    return quartiles.groupBy(*scope).agg(*wide)


BOUNDS = tuple(f"{m.name}_{side}" for m in MEASURES for side in (("most", "least") if m.two_sided else ("most",)))


def thresholds(sketches: DataFrame, support: int = SUPPORT) -> DataFrame:
    """lang, source and ``BOUNDS`` for every pair that the sketches have."""
    own = limits(sketches, "lang", "source")
    wider = limits(merged(sketches, "lang"), "lang").select(F.col("lang").alias("_lang"), F.struct("size", *BOUNDS).alias("_by_lang"))
    widest = limits(merged(sketches)).select(F.struct("size", *BOUNDS).alias("_all"))  # one row
    rows = own.join(wider, F.col("lang").eqNullSafe(F.col("_lang"))).crossJoin(F.broadcast(widest))
    chosen = F.when(F.col("size") >= support, F.struct("size", *BOUNDS)).when(F.col("_by_lang.size") >= support, F.col("_by_lang")).otherwise(F.col("_all"))
    return rows.select("lang", "source", chosen.alias("_chosen")).select("lang", "source", *(F.col(f"_chosen.{b}").alias(b) for b in BOUNDS))


def judged(docs: DataFrame, support: int = SUPPORT) -> DataFrame:
    """Verdicts on ``docs`` (doc_id, text, lang, source), a row for each row.

    Returns doc_id, lang, source, ``COUNTS``, base_failed, failed (the measures beyond their thresholds) and
    kept. Null language or source is a group of its own. Null, empty and blank texts have no words: they fail
    and are in no sketch. A measure without a value (no lines) does not fail. Equal rows get equal verdicts;
    an empty table gives an empty one. Other columns are ignored.
    """
    prepare(docs.sparkSession)
    rows = staged(measured(docs), "measured")
    sketches = staged(sketch(rows), "sketches")
    bounds = staged(thresholds(sketches, support), "thresholds").withColumnsRenamed({"lang": "_lang", "source": "_source"})
    joined = rows.join(bounds, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    beyond = []
    for m in MEASURES:
        out = m.value() > F.col(f"{m.name}_most")
        out = out | (m.value() < F.col(f"{m.name}_least")) if m.two_sided else out
        beyond.append(F.when(out, F.lit(m.name)))
    base = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    joined = joined.withColumns({"base_failed": base, "failed": F.array_compact(F.array(*beyond))})
    kept = ~F.col("base_failed") & (F.size("failed") == 0)
    return joined.select("doc_id", "lang", "source", *COUNTS, "base_failed", "failed", kept.alias("kept"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    def bucket_of(v: str) -> str:
        shift = f"greatest(length(bin({v})) - 6, 0)"
        return f"32 * {shift} + ({v} >> {shift})"

    def least_of(b: str) -> str:
        shift = f"greatest({b} // 32 - 1, 0)"
        return f"(({b} - 32 * {shift}) << {shift})"

    values = ", ".join(f"(CASE WHEN {m.whole} > 0 THEN 1000 * {m.part} // {m.whole} END) AS {m.name}" for m in MEASURES)
    long = " UNION ALL ".join(f"SELECT lang, source, '{m.name}' AS measure, {m.name} AS v FROM v WHERE {m.name} IS NOT NULL" for m in MEASURES)
    wide = []
    for m in MEASURES:
        wide.append(f"max(q2 + {SPREAD} * (q3 - q2) + {m.slack}) FILTER (measure = '{m.name}') AS {m.name}_most")
        if m.two_sided:
            wide.append(f"max(q2 - {SPREAD} * (q2 - q1) - {m.slack}) FILTER (measure = '{m.name}') AS {m.name}_least")
    bounds = []
    for name, scope in (("own", "lang, source"), ("wider", "lang"), ("widest", "1")):
        keys = scope if scope != "1" else "'all' AS everything"
        quarters = ", ".join(f"{least_of(f'min(CASE WHEN 4 * so_far >= {k} * size THEN bucket END)')} AS q{k}" for k in (1, 2, 3))
        by = f"{scope}, " if scope != "1" else ""
        bounds.append(
            f"""{name} AS (SELECT {keys}, max(size) AS size, {", ".join(wide)} FROM (
              SELECT {by}measure, max(size) AS size, {quarters} FROM (
                SELECT *, sum(n) OVER (PARTITION BY {by}measure ORDER BY bucket) AS so_far, sum(n) OVER (PARTITION BY {by}measure) AS size FROM (
                  SELECT {by}measure, bucket, sum(n) AS n FROM sk GROUP BY {by}measure, bucket))
              GROUP BY {by}measure) GROUP BY {scope if scope != "1" else "everything"})"""
        )
    chosen = ", ".join(f"CASE WHEN own.size >= {SUPPORT} THEN own.{b} WHEN wider.size >= {SUPPORT} THEN wider.{b} ELSE widest.{b} END AS {b}" for b in BOUNDS)
    passed = " AND ".join(
        f"coalesce(v.{m.name} <= t.{m.name}_most, true)" + (f" AND coalesce(v.{m.name} >= t.{m.name}_least, true)" if m.two_sided else "") for m in MEASURES
    )
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT rid, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS win FROM (SELECT rid, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w)),
hit AS (SELECT DISTINCT rid, unnest(range(i, i + {WINDOW})) AS j FROM (SELECT *, count(*) OVER (PARTITION BY rid, win) AS k FROM g) WHERE k > 1),
r AS (SELECT rid, count(*) AS n FROM hit GROUP BY rid),
c AS (SELECT w.rid, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words FROM w LEFT JOIN r ON r.rid = w.rid),
v AS (SELECT *, {values} FROM c),
sk AS (SELECT lang, source, measure, {bucket_of("v")} AS bucket, count(*) AS n FROM ({long}) GROUP BY ALL),
{", ".join(bounds)},
t AS (SELECT own.lang, own.source, {chosen} FROM own JOIN wider ON own.lang IS NOT DISTINCT FROM wider.lang CROSS JOIN widest),
b AS (SELECT v.*, n_words < {FEWEST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM v)
SELECT v.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {passed} AS kept
FROM b AS v LEFT JOIN t ON v.lang IS NOT DISTINCT FROM t.lang AND v.source IS NOT DISTINCT FROM t.source
"""


ORACLE = _sql()
