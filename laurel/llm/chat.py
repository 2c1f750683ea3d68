"""Chat formatting from event logs.

A conversation is a log of events in sequence: whole messages, streamed deltas, edits and
regenerations, each for a turn. Folding a turn's events gives its final messages; rendering puts turn
marks around them and escapes control strings inside them.

The template: ``<s>`` opens a conversation's first message. A user text stands between ``[INST]`` and
``[/INST]``, a system text between ``[SYS]`` and ``[/SYS]``, an assistant text ends with ``</s>``, and
any other role's text stands between ``[ROLE]name[/ROLE]`` and ``[/TURN]``. In texts and names a
backslash is doubled and a control string gets one after its first character, so no text holds a
control string and everything can be read back. The loss mask covers assistant texts only.

Hot conversations: folding is by conversation and turn. Output is one row for each message, and
whatever goes through a whole conversation streams over sorted rows with the state of one message, so a
conversation of any length needs no more memory than its longest message.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laurel.llm.tables import prepare, read

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]", "[/TURN]")
_FRAMES = {"user": ("[INST]", "[/INST]"), "system": ("[SYS]", "[/SYS]"), "assistant": ("", "</s>")}
_SPECIAL = re.compile("|".join(["\\\\", *map(re.escape, CONTROL)]))
_ESCAPED = re.compile(r"\\(\\?)")
# Kinds of events; of events with the same sequence number the earlier kind goes first.
KINDS = ("message", "regenerate", "edit", "delta")


def escape(text: str) -> str:
    return _SPECIAL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def frame(role: str) -> tuple[str, str]:
    """What stands before and after a text of this role."""
    return _FRAMES.get(role) or (f"[ROLE]{escape(role)}[/ROLE]", "[/TURN]")


def _streams(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(c).to_pylist() for c in columns], strict=True)


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 512) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


MESSAGES = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def messages() -> Iterator[tuple]:
        key, place, role, pieces = None, 0, None, []
        for conv, turn, kind, who, text in _streams(batches, ["conv_id", "turn", "kind", "role", "text"]):
            if key != (conv, turn):
                if pieces is not None and key is not None:
                    yield (*key, place, role, "".join(pieces))
                key, place, role, pieces = (conv, turn), 0, who, None
            if kind == "message" and pieces is not None:  # one more message of this turn
                yield (*key, place, role, "".join(pieces))
                place += 1
            if kind in ("message", "edit", "regenerate") or pieces is None:
                pieces = [] if kind == "regenerate" else [text or ""]
                role = who if who is not None or kind == "message" else role
            else:
                pieces.append(text or "")
        if key is not None and pieces is not None:
            yield (*key, place, role, "".join(pieces))

    yield from _batched(messages(), MESSAGES)


def folded(events: DataFrame) -> DataFrame:
    """Final messages of ``events`` (conv_id, seq, turn, kind, role, text): conv_id, turn, place, role, text.

    By ``seq`` within a conversation's turn: a message opens a message of the turn (``place`` numbers
    them from 0), a delta appends to the last one, an edit replaces its text, a regeneration empties it
    (its new text follows as deltas). Any of them opens the turn where nothing does; unknown kinds count
    as deltas. Edits and regenerations may name another role. Null texts are empty, events of equal
    sequence go by kind, then role and text, and a null conv_id or turn is a value like others.
    Repeated messages stay repeated. An empty log gives no messages. Other columns are ignored.
    """
    prepare(events.sparkSession)
    names = F.array(*[F.lit(k) for k in KINDS])
    kind = F.coalesce(F.nullif(F.array_position(names, F.col("kind")), F.lit(0)), F.lit(len(KINDS)))
    rows = events.select("conv_id", "turn", "seq", kind.alias("_kind"), "kind", "role", "text")
    rows = rows.repartition("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "seq", "_kind", "role", "text")
    rows = rows.select(*[F.col(c).cast("long") for c in ("conv_id", "turn")], "kind", "role", "text")
    return rows.mapInArrow(_fold, "conv_id long, turn long, place long, role string, text string")


RENDERED = pa.schema(
    [("conv_id", pa.int64()), ("turn", pa.int64()), ("place", pa.int64()), ("formatted", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())]
)


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        last = ()
        for conv, turn, place, role, text in _streams(batches, ["conv_id", "turn", "place", "role", "text"]):
            before, after = frame(role or "")
            before = before if last == (conv,) else "<s>" + before
            last = (conv,)
            inner = escape(text or "")
            masked = role == "assistant"
            yield conv, turn, place, before + inner + after, len(before) if masked else None, len(before) + len(inner) if masked else None

    yield from _batched(rows(), RENDERED)


def rendered(messages: DataFrame) -> DataFrame:
    """Formatted messages: conv_id, turn, place, formatted, loss_start and loss_end.

    A conversation's text is its rows' ``formatted`` by turn and place, joined. The loss mask of a
    message is the code points from loss_start to loss_end of ``formatted``; null where it has none. A
    null role is an empty one.
    """
    rows = messages.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "place")
    fields = "conv_id long, turn long, place long, formatted string, loss_start long, loss_end long"
    return rows.mapInArrow(_render, fields)


class Parser:
    """Reads formatted text piece by piece; a piece must not cut a turn."""

    _CLOSE = {"[INST]": ("user", "[/INST]"), "[SYS]": ("system", "[/SYS]")}

    def turns(self, text: str) -> Iterator[tuple[str, str]]:
        at = 0
        while at < len(text):
            if text.startswith("<s>", at):
                at += 3
                continue
            for opening, (role, closing) in self._CLOSE.items():
                if text.startswith(opening, at):
                    at += len(opening)
                    break
            else:
                role, closing = "assistant", "</s>"
                if text.startswith("[ROLE]", at):
                    end = text.index("[/ROLE]", at)
                    role, closing = unescape(text[at + 6 : end]), "[/TURN]"
                    at = end + 7
            end = text.index(closing, at)
            yield role, unescape(text[at:end])
            at = end + len(closing)


DIGEST = pa.schema(
    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        parser, key = Parser(), ()
        for conv, text, start, end in _streams(batches, ["conv_id", "formatted", "loss_start", "loss_end"]):
            if key != (conv,):
                if key:
                    yield key[0], turns, all_turns.hexdigest(), loss_chars, loss.hexdigest(), chars
                key, turns, chars, loss_chars = (conv,), 0, 0, 0
                all_turns, loss = hashlib.sha256(), hashlib.sha256()
            chars += len(text)
            for role, inner in parser.turns(text):
                turns += 1
                all_turns.update(f"{role}\n{inner}\n".encode())
            if start is not None:
                masked = unescape(text[start:end])
                loss_chars += len(masked)
                loss.update(masked.encode())
        if key:
            yield key[0], turns, all_turns.hexdigest(), loss_chars, loss.hexdigest(), chars

    yield from _batched(rows(), DIGEST)


def read_back(formatted: DataFrame) -> DataFrame:
    """Parses formatted conversations and describes what was read: one row for each conversation."""
    rows = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "place")
    fields = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return rows.mapInArrow(_read_back, fields)


def as_events(conversations: DataFrame) -> DataFrame:
    """A log in which every row is a message event at its turn."""
    turn: Column = F.col("turn")
    return conversations.select("conv_id", turn.alias("seq"), "turn", F.lit("message").alias("kind"), "role", "text")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = as_events(read(spark, sf_dir, "conversations"))
    control = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"), F.lit(control).alias("text"),
    )
    return read_back(rendered(folded(events.unionByName(as_events(more)))))


# Rows that share a conversation's turn go by role and text, nulls first.
ORACLE = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(regexp_replace(text, '\\\\|</?s>|\\[/?(?:INST|SYS|ROLE)\\]|\\[/TURN\\]', '\\0_', 'g')) AS inner_chars,
         length(regexp_replace(role, '\\\\|</?s>|\\[/?(?:INST|SYS|ROLE)\\]|\\[/TURN\\]', '\\0_', 'g')) AS role_chars FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(3 + sum(inner_chars + CASE role WHEN 'user' THEN 13 WHEN 'system' THEN 11 WHEN 'assistant' THEN 4
                    ELSE 20 + role_chars END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
