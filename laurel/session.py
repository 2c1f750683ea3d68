"""Session settings and the shared folder for staged tables."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

# Settings every plan relies on; the number of shuffle partitions stays the cluster's choice.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Let a skewed join be split even when that costs one more shuffle afterwards.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # State of streams spills to disk.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


_folders: dict[str, str] = {}


def tune(spark: SparkSession) -> SparkSession:
    for name, value in RUNTIME_SETTINGS.items():
        spark.conf.set(name, value)
    ship(spark)
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="laurel-package-")).resolve() / "laurel_package.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, f"{package.name}/{file.relative_to(package)}")
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(application)


def build_session(app_name: str = "laurel", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    for name, value in {**RUNTIME_SETTINGS, **settings}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """This application's folder in the one that ``spark.checkpoint.dir`` names.

    Where the setting is missing a local folder stands in, in local mode only. The folder is deleted when
    the driver's Python ends while its session still runs, or by ``clean``; results that are read later
    must be written elsewhere.
    """
    application = spark.sparkContext.applicationId
    if application not in _folders:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            master = spark.sparkContext.master
            if master != "local" and not master.startswith("local["):
                raise RuntimeError("Set spark.checkpoint.dir to a folder every executor can reach")
            base = tempfile.mkdtemp(prefix="laurel-")
        _folders[application] = f"{base.rstrip('/')}/laurel-{application}"
        atexit.register(_clean_at_exit, spark, application)
    return _folders[application]


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def clean(spark: SparkSession) -> None:
    """Delete all that this application has staged."""
    folder = _folders.pop(spark.sparkContext.applicationId, None)
    if folder:
        delete(spark, folder)


def _clean_at_exit(spark: SparkSession, application: str) -> None:
    context = SparkContext._active_spark_context
    if context is not None and context._jsc is not None and context.applicationId == application:
        clean(spark)


_open = threading.local()


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Tables that this thread stages inside are deleted at the end; for jobs that repeat, such as micro-batches."""
    outer, _open.paths = getattr(_open, "paths", None), []
    try:
        yield
    finally:
        for path in _open.paths:
            delete(spark, path)
        _open.paths = outer


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where several branches need the same expensive rows, or where a value such as the
    partition number must not change between two evaluations. The files outlive executors.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/staged/{uuid.uuid4().hex}"
    if getattr(_open, "paths", None) is not None:
        _open.paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
