"""Running values in one global order without a single-task sort.

Rows are range-partitioned and sorted; every task runs over its own range as a stream and writes it, and
one row per range carries what the ranges before it add. A key with most of the rows is spread over ranges
like any other, and no task holds more than an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laurel.llm.tables import staged

_SELF = {"add": np.add, "xor": np.bitwise_xor}
_LESS = {"add": np.subtract, "xor": np.bitwise_xor}


def _runs(key: pa.Array) -> np.ndarray:
    """Where a value differs from the one before it; the first place counts as new."""
    codes = key.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return np.append(True, codes[1:] != codes[:-1])


def _scanner(key: str, ways: dict[str, str]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, number, last = TaskContext.get().partitionId(), 0, -1, None
        sums = dict.fromkeys(ways, 0)
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            column = batch.column(key)
            new = _runs(column)
            new[0] = number < 0 or column[0].as_py() != last
            run = np.cumsum(new)
            first = np.flatnonzero(new)
            out = {name: batch.column(name) for name in batch.schema.names}
            for name, way in ways.items():
                values = batch.column(name).to_numpy()
                total = _SELF[way].accumulate(values)
                # What the batch held before a row's own run; the run that goes on takes what is open.
                before = np.zeros(len(first) + 1, values.dtype)
                before[1:] = np.where(first > 0, total[first - 1], values.dtype.type(0))
                before[0] = _LESS[way](values.dtype.type(0), values.dtype.type(sums[name]))
                total = _LESS[way](total, before[run])
                sums[name] = total[-1]
                out[name] = pa.array(total)
            out |= {"_number": pa.array(number + run), "_at": pa.array(np.arange(seen, seen + rows)), "_part": pa.array(np.full(rows, part, np.int32))}
            seen, number, last = seen + rows, int(number + run[-1]), column[-1].as_py()
            yield pa.RecordBatch.from_pydict(out)

    return scan


def running(rows: DataFrame, key: str, order: Sequence[str], adds: Sequence[str] = (), xors: Sequence[str] = (), name: str = "running", keep: Sequence[Column | str] = ("*",)) -> DataFrame:
    """``rows`` with the long columns ``adds`` and ``xors`` replaced by their running sum or exclusive or.

    Both include the row itself and start again with every value of ``key`` (nulls first, strings by their
    bytes); inside a key rows go by ``order``, which must leave no ties but between equal rows. Column
    ``_number`` has the place of the key among the different ones, from 0. Sums must stay below 2 ** 63.
    """
    spark = rows.sparkSession
    ways = {**dict.fromkeys(adds, "add"), **dict.fromkeys(xors, "xor")}
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    sorted_ = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), key, *order).sortWithinPartitions(key, *order)
    placed = staged(sorted_.mapInArrow(_scanner(key, ways), f"{fields}, _number long, _at long, _part int"), name)

    # One row per range comes to the driver: its first and last key and what is open at its end.
    ends = placed.groupBy("_part").agg(
        F.min_by(F.struct(key), "_at").alias("first"), F.max_by(F.struct(F.col(key).alias("_key"), "_number", *ways), "_at").alias("last")
    )
    carried, base, open_key, open_sums = [], 0, None, dict.fromkeys(ways, 0)
    for row in sorted(ends.collect(), key=lambda r: r["_part"]):
        goes_on = open_key is not None and row["first"][key] == open_key[0]
        base -= goes_on
        more = open_sums if goes_on else dict.fromkeys(ways, 0)
        carried.append((row["_part"], base, *more.values()))
        alone = row["last"]["_number"] == 0
        open_sums = {n: (row["last"][n] + more[n] if w == "add" else row["last"][n] ^ more[n]) if alone else row["last"][n] for n, w in ways.items()}
        base += row["last"]["_number"] + 1
        open_key = (row["last"]["_key"],)
    schema = ", ".join(["_part int", "_base long", *(f"`_more_{n}` long" for n in ways)])
    offsets = F.broadcast(spark.createDataFrame(carried, schema))
    joined = placed.join(offsets, "_part")
    first = F.col("_number") == 0
    after = {n: F.when(first, F.col(n) + F.col(f"_more_{n}") if w == "add" else F.col(n).bitwiseXOR(F.col(f"_more_{n}"))).otherwise(F.col(n)) for n, w in ways.items()}
    joined = joined.withColumns({**after, "_number": F.col("_number") + F.col("_base")})
    return joined.select(*rows.columns, "_number")
