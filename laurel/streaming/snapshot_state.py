"""Stateful diff of full round snapshots and single-row updates.

State lives per round: the content mark of each result and the row itself, so a change carries what was
before. A round's results are kept in a few parts, so a frame costs a few calls to the state store and not
several for each result; an update reads and writes only the parts of its results. The state store spills to
disk, and rounds spread over the cluster by key.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from laurel.session import tune

_PARTS = 4
OUTPUT = (
    "round_id string, seq bigint, observed_at timestamp, result_id string, change string, mark string, evaluate boolean, "
    "row string, before string"
)


def _part(result_id: str | None) -> int:
    return zlib.crc32((result_id or "").encode()) % _PARTS


class SnapshotDiff(StatefulProcessor):
    """Rows in: ``round_id, seq, observed_at, type, rows`` (``rows``: result_id, mark, entered_at, row).

    ``type`` is ``snapshot`` (all results of the round) or ``update`` (changed results). A snapshot is the
    first while no row of the round is stored: then only results entered within the catch-up time are
    marked for evaluation; with a negative catch-up all are. Frames without rows (null, a payload that
    could not be read) are rejected and change nothing. A ``retire`` message forgets the round.
    """

    def __init__(self, catchup_minutes: int) -> None:
        self.catchup = pd.Timedelta(minutes=max(catchup_minutes, 0)) if catchup_minutes >= 0 else None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "part int", "results array<struct<result_id:string,mark:string,row:string>>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # A micro-batch's frames of a round must be put in order; the source's batch size bounds them.
        frames = pd.concat(list(rows)).sort_values("seq")
        for frame in frames.itertuples(index=False):
            changes = self._apply(frame)
            if changes:
                out = pd.DataFrame(changes, columns=["result_id", "change", "mark", "evaluate", "row", "before"])
                out.insert(0, "observed_at", frame.observed_at)
                out.insert(0, "seq", frame.seq)
                out.insert(0, "round_id", key[0])
                yield out

    def _apply(self, frame) -> list[tuple]:
        if frame.type == "retire":
            self.known.clear()
            return []
        if frame.rows is None:
            return [(None, "rejected", None, False, None, None)]
        given = {r["result_id"]: r for r in frame.rows}
        whole = frame.type == "snapshot"
        known = self._read(None if whole else sorted({_part(i) for i in given}))
        first = whole and not any(known.values())
        changes, touched = [], set()
        for result_id, row in given.items():
            held = known[_part(result_id)]
            old = held.get(result_id)
            if old is not None and old[0] == row["mark"]:
                continue
            change = "addition" if old is None else "change"
            changes.append((result_id, change, row["mark"], self._due(first, row, frame), row["row"], old and old[1]))
            held[result_id] = (row["mark"], row["row"])
            touched.add(_part(result_id))
        if whole:
            for part, held in known.items():
                for result_id in [i for i in held if i not in given]:
                    changes.append((result_id, "removal", None, True, None, held.pop(result_id)[1]))
                    touched.add(part)
        self._write(known, touched)
        return changes

    def _read(self, parts: list[int] | None) -> dict[int, dict[str, tuple]]:
        """The results of these parts, or of all, by result_id."""
        if parts is None:
            stored = {key[0]: value for key, value in self.known.iterator()}
            parts = range(_PARTS)
        else:
            stored = {part: self.known.getValue((part,)) for part in parts}
        return {part: {i: (mark, row) for i, mark, row in stored[part][0]} if stored.get(part) else {} for part in parts}

    def _write(self, known: dict[int, dict[str, tuple]], parts: Iterable[int]) -> None:
        for part in sorted(parts):
            if known[part]:
                self.known.updateValue((part,), ([(i, *held) for i, held in known[part].items()],))
            else:
                self.known.removeKey((part,))

    def _due(self, first: bool, row, frame) -> bool:
        if not first or self.catchup is None:
            return True
        entered = row["entered_at"]
        return entered is not None and pd.Timestamp(entered) >= pd.Timestamp(frame.observed_at) - self.catchup

    def close(self) -> None:
        pass


def snapshot_changes(frames: DataFrame, catchup_minutes: int = 60) -> DataFrame:
    """Additions, changes and removals of a frame stream, in frame order per round."""
    tune(frames.sparkSession)  # its state needs RocksDB
    return frames.groupBy("round_id").transformWithStateInPandas(
        statefulProcessor=SnapshotDiff(catchup_minutes),
        outputStructType=OUTPUT,
        outputMode="append",
        timeMode="None",
    )
