"""Secret scans: known patterns, and strings whose sliding-window entropy is high.

DataFrame and SQL functions only. Matches of a pattern get their places from the pieces between them: a
match starts after all pieces and matches before it. Places count code points, ends are exclusive.

Entropy: a candidate is a run of at least ``WINDOW`` letters, digits or ``+/_=-`` with a digit and a
letter. Its character class is hex (digits and a-f of one case only), base36 (digits and letters of one case,
other ones too) or, with both cases, base64; other runs are no candidates. A window moves over the candidate one character at a time. The sum of
``c * log2(c)`` over its character counts, in fixed point, is kept by the count of the character that
enters and of the one that leaves; entropy is ``log2(WINDOW) - sum / WINDOW``. The span goes from the
first window at or over the class's threshold to the last. Candidates that an allow-list pattern matches
are suppressed, and spans inside a pattern's match are not added.

Work grows with the text, also with very long strings and very many matches in one: places are added up in
chunks of ``CHUNK`` matches, and a candidate is cut into pieces of ``PIECE`` windows' starts, each with the
characters that its last windows need.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laurel.llm.tables import prepare, read

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # runs are maximal, so 16 characters can be asked for at once
HEX = r"[0-9a-f]{32,}"
WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{%d,}" % WINDOW
CLASSES = (
    ("entropy_hex", r"^(?=.*[0-9])(?=.*[A-Fa-f])([0-9a-f]+|[0-9A-F]+)$", 3.0),
    ("entropy_base64", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z]).*$", 3.7),
    ("entropy_base36", r"^(?=.*[0-9])(?=.*[G-Zg-z])([0-9a-z]+|[0-9A-Z]+)$", 3.7),
)
ALLOWED = (
    r"(?i)example|sample|placeholder|dummy|changeme|your[_-]",
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",  # UUID
    r"^sha(256|384|512)-",  # integrity digest
    r"0123456789|(?i)abcdefghij",
)
CHUNK = 64
PIECE = 256
_SCALE = 1 << 20
KINDS = ("assign", "access", "hex", *[c[0] for c in CLASSES])


def _literal(text: str) -> Column:
    return F.lit(text)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def _chunks(values: Column, size: int) -> Column:
    """An array cut into arrays of ``size`` values."""
    return _once(values, lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(v), F.lit(1)) - 1) / size).cast("int")), lambda k: F.slice(v, k * size + 1, F.lit(size))))


def matches(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches: array of (start, end, text); none for other texts."""
    found = F.regexp_extract_all(text, _literal(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    # A running length over pieces and matches gives the starts: inside chunks, and over the chunks.
    pairs = F.arrays_zip(gaps.alias("gap"), found.alias("hit"))
    spans = "array<struct<start: int, end: int, hit: string>>"
    of_chunk = F.expr(f"CAST(array() AS {spans})")
    of_all = F.expr(f"struct(0 AS at, CAST(array() AS array<{spans}>) AS spans)")

    def add(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["gap"])
        end = start + F.coalesce(F.length(pair["hit"]), F.lit(0))
        span = F.struct(start.alias("start"), end.alias("end"), pair["hit"].alias("hit"))
        grown = F.when(pair["hit"].isNull(), acc["spans"]).otherwise(F.concat(acc["spans"], F.array(span)))
        return F.struct(end.alias("at"), grown.alias("spans"))

    def add_chunk(acc: Column, chunk: Column) -> Column:
        return _once(
            F.aggregate(chunk, F.struct(acc["at"].alias("at"), of_chunk.alias("spans")), add),
            lambda own: F.struct(own["at"].alias("at"), F.concat(acc["spans"], F.array(own["spans"])).alias("spans")),
        )

    every = F.aggregate(_chunks(pairs, CHUNK), of_all, add_chunk, lambda acc: F.flatten(acc["spans"]))
    return F.when(F.regexp_like(text, _literal(pattern)), every)


def _spans(found: Column, number: int) -> Column:
    """As array of (start, kind number, end), which sorts as asked for."""
    return F.transform(
        F.coalesce(found, F.expr("CAST(array() AS array<struct<start: int, end: int, hit: string>>)")),
        lambda m: F.struct(m["start"].alias("start"), F.lit(number).alias("kind"), m["end"].alias("end")),
    )


def _entropy_sums(hit: Column) -> Column:
    """For each window of the string: the scaled sum of ``c * log2(c)`` over its counts."""
    table = F.array(*[F.lit(round(c * math.log2(c) * _SCALE) if c else 0) for c in range(WINDOW + 2)])
    w = F.lit(WINDOW)

    def step(acc: Column, j: Column) -> Column:
        # What the window holds without the character that leaves and the one that enters.
        core_start = F.greatest(F.lit(1), j - w + 1)
        core = F.substr(hit, core_start, j - core_start)

        def count(char: Column) -> Column:
            return F.length(core) - F.length(F.replace(core, char, F.lit("")))

        def gain(n: Column) -> Column:
            return F.element_at(table, n + 2) - F.element_at(table, n + 1)

        enters = gain(count(F.substr(hit, j, F.lit(1))))
        leaves = F.when(j > w, gain(count(F.substr(hit, j - w, F.lit(1))))).otherwise(0)
        total = acc["sum"] - leaves + enters
        sums = F.when(j >= w, F.concat(acc["sums"], F.array(total))).otherwise(acc["sums"])
        return F.struct(total.alias("sum"), sums.alias("sums"))

    start = F.expr("struct(0 AS sum, CAST(array() AS array<int>) AS sums)")
    return F.aggregate(F.sequence(F.lit(1), F.length(hit)), start, step, lambda acc: acc["sums"])


def limit(threshold: float) -> int:
    """The largest scaled sum whose entropy is at least the threshold."""
    return math.floor((math.log2(WINDOW) - threshold) * WINDOW * _SCALE)


def _entropy_spans(found: Column, number: int, shape: str, threshold: float, allowed: Sequence[str]) -> Column:
    none = F.expr("CAST(array() AS array<struct<start: int, end: int, hit: string>>)")

    def wanted(m: Column) -> Column:
        keep = F.regexp_like(m["hit"], _literal(shape))
        for pattern in allowed:
            keep = keep & ~F.regexp_like(m["hit"], _literal(pattern))
        return keep

    def hot(piece: Column, at: Column) -> Column:
        """The first and the last place of a piece where a window of enough entropy starts; null without one."""
        high = F.transform(_entropy_sums(piece), lambda s: s <= limit(threshold))
        return _once(
            high,
            lambda h: F.when(
                F.array_contains(h, True),
                F.struct(
                    (at + F.array_position(h, F.lit(True)).cast("int") - 1).alias("first"),
                    (at + F.size(h) - F.array_position(F.reverse(h), F.lit(True)).cast("int")).alias("last"),
                ),
            ),
        )

    def span(m: Column) -> Column:
        pieces = F.regexp_extract_all(m["hit"], _literal(f"(?s).{{1,{PIECE}}}"), F.lit(0))

        def of_pieces(p: Column) -> Column:
            more = lambda k: F.coalesce(F.get(p, k + 1), F.lit(""))
            found_in = F.transform(p, lambda piece, k: hot(F.concat(piece, F.substr(more(k), F.lit(1), F.lit(WINDOW - 1))), k * PIECE))
            return _once(
                F.array_compact(found_in),
                lambda f: F.when(
                    F.size(f) > 0,
                    F.struct(
                        (m["start"] + F.array_min(F.transform(f, lambda x: x["first"]))).alias("start"),
                        F.lit(number).alias("kind"),
                        (m["start"] + F.array_max(F.transform(f, lambda x: x["last"])) + WINDOW).alias("end"),
                    ),
                ),
            )

        return _once(pieces, of_pieces)

    return F.array_compact(F.transform(F.filter(F.coalesce(found, none), wanted), span))


def scan(docs: DataFrame, allowed: Sequence[str] = ALLOWED) -> DataFrame:
    """doc_id and the spans found in the whole text of ``docs`` (doc_id, text).

    Returns doc_id, base (patterns) and spans (all), arrays of (start, kind, end) sorted by start and
    kind; a kind is a place in ``KINDS``. Null and empty texts have no spans; every row is scanned for
    itself, so equal rows give equal results. Other columns are ignored.
    """
    prepare(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("_text"))
    assign = F.filter(matches(F.col("_text"), ASSIGN), lambda m: F.length(F.regexp_extract(m["hit"], ASSIGN, 2)) >= 8)
    rows = rows.select(
        "doc_id",
        assign.alias("_assign"),
        matches(F.col("_text"), ACCESS).alias("_access"),
        matches(F.col("_text"), HEX).alias("_hex"),
        F.filter(matches(F.col("_text"), CANDIDATE), lambda m: F.regexp_like(m["hit"], _literal("[0-9]"))).alias("_long"),
    )
    base = F.array_sort(F.concat(*[_spans(F.col(c), i) for i, c in enumerate(("_assign", "_access", "_hex"))]))
    found = [_entropy_spans(F.col("_long"), 3 + i, shape, bits, allowed) for i, (_, shape, bits) in enumerate(CLASSES)]
    rows = rows.select("doc_id", base.alias("base"), F.concat(*found).alias("_more"))

    def outside(m: Column) -> Column:
        return ~F.exists("base", lambda b: (b["start"] <= m["start"]) & (m["end"] <= b["end"]))

    return rows.select("doc_id", "base", F.array_sort(F.concat("base", F.filter("_more", outside))).alias("spans"))


def joined(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"], s["end"])), ",")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(read(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS[:3])]
    digest = F.sha2(joined(F.col("base")).cast("binary"), 256)
    return rows.select("doc_id", *counts, digest.alias("base_sha256"), joined(F.col("spans")).alias("spans"))
