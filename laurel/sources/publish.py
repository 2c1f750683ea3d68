"""Publishing tables that belong together: written, checked, then switched by one commit.

A release is a folder with all its tables. It counts once the list of releases has a file of its number;
readers take the newest. A failing write or check leaves the published release as it was.

Publishers do not wait for each other: a release takes the number after the newest, and the file of a number
is created only where there is none. Who comes second finds it taken and goes on to the next number.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laurel.session import delete


@dataclass(frozen=True)
class Table:
    rows: DataFrame
    check: Callable[[DataFrame], object] = field(default=lambda df: None)
    partition_by: tuple[str, ...] = ()


def _list(root: str) -> str:
    return f"{root.rstrip('/')}/releases"


def releases(spark: SparkSession, root: str) -> DataFrame:
    """All releases so far: number, path and metadata (JSON)."""
    where = spark._jvm.org.apache.hadoop.fs.Path(_list(root))
    schema = "number long, path string, metadata string"
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(_list(root)).where("number IS NOT NULL")


def create(spark: SparkSession, path: str, content: str) -> bool:
    """Write a small file where there is none; false if there is one.

    The file system decides between two writers, as HDFS does; a store that only overwrites cannot.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        out = system.create(where, False)
    except Py4JJavaError as error:
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    out.write(bytearray(content.encode()))
    out.close()
    return True


def commit(spark: SparkSession, root: str, path: str, note: str) -> int:
    """Make ``path`` the newest release; returns its number, the first one that nobody else has taken."""
    newest = releases(spark, root).agg(F.max("number")).first()[0] or 0
    number = newest + 1
    while not create(spark, f"{_list(root)}/release-{number:012d}.json", json.dumps({"number": number, "path": path, "metadata": note}) + "\n"):
        number += 1
    return number


def publish(spark: SparkSession, root: str, tables: dict[str, Table], metadata: DataFrame, keep: int = 2) -> str:
    """Publish ``tables`` with a one-row ``metadata`` as the next release; only the last ``keep`` stay on disk."""
    path = f"{root.rstrip('/')}/release-{uuid.uuid4().hex}"
    for name, table in tables.items():
        writer = table.rows.write.partitionBy(*table.partition_by) if table.partition_by else table.rows.write
        writer.parquet(f"{path}/{name}")
    for name, table in tables.items():
        table.check(spark.read.parquet(f"{path}/{name}"))
    number = commit(spark, root, path, metadata.select(F.to_json(F.struct("*"))).first()[0])
    # Releases of a number above are another publisher's; they delete what is too old for them.
    older = releases(spark, root).where(F.col("number") <= number).orderBy(F.desc("number")).limit(keep + 20).collect()
    for old in older[keep:]:
        delete(spark, old.path)
    return path


def published(spark: SparkSession, root: str, name: str) -> DataFrame:
    newest = releases(spark, root).orderBy(F.desc("number")).first()
    if newest is None:
        raise ValueError(f"Nothing is published under {root}")
    return spark.read.parquet(f"{newest.path}/{name}")


def metadata(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The newest release's metadata, read as ``schema``."""
    newest = releases(spark, root).orderBy(F.desc("number")).limit(1)
    return newest.select("number", F.from_json("metadata", schema).alias("_m")).select("number", "_m.*")


def write_detections(detections: DataFrame, path: str) -> None:
    """All detections as JSON lines."""
    detections.write.mode("overwrite").json(path)
