"""Tables written to the shared folder that ``spark.checkpoint.dir`` names.

A written table cuts the lineage, survives lost executors and lets each later reader scan only
the columns it needs.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# A writer holds a row group in memory until it is full.
ROW_GROUP_BYTES = 16 << 20
_LOCAL_ROOTS: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None)
    application = spark.sparkContext.applicationId
    if configured:
        return f"{configured.rstrip('/')}/tidemark-{application}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    if application not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[application] = tempfile.mkdtemp(prefix="tidemark-")
    return _LOCAL_ROOTS[application]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path nobody else writes to."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def written(frame: DataFrame, label: str) -> DataFrame:
    """Write ``frame`` once and return the stored table."""
    spark = frame.sparkSession
    path = scratch_path(spark, label)
    frame.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more, and let Spark drop shuffle files that only they needed.

    Spark drops a shuffle's files once the driver's garbage collector finds that no plan refers to it, which may
    be long after.
    """
    for table in tables:
        root = scratch_root(table.sparkSession)
        for folder in {path.rpartition("/")[0] for path in table.inputFiles()}:
            if root.rpartition("/")[2] in folder:
                remove(table.sparkSession, folder)
    if tables:
        tables[0].sparkSession._jvm.System.gc()


def _file_system(spark: SparkSession, path: str):
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()), location


def exists(spark: SparkSession, path: str) -> bool:
    file_system, location = _file_system(spark, path)
    return file_system.exists(location)


def folders(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob pattern, from a listing alone."""
    file_system, location = _file_system(spark, pattern)
    return [str(status.getPath()) for status in file_system.globStatus(location) or []]


def dated(
    spark: SparkSession, path: str, schema: StructType, column: str, days: Iterable[date]
) -> DataFrame:
    """The folders of some dates of a table partitioned by ``column`` first; no others are listed."""
    named = ",".join(sorted({str(day) for day in days}))
    found = folders(spark, f"{path}/{column}={{{named}}}") if named else []
    if not found:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(*found)


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a path this library wrote, on whatever file system holds it."""
    file_system, location = _file_system(spark, path)
    return file_system.delete(location, True)


def make_folder(spark: SparkSession, path: str) -> None:
    file_system, location = _file_system(spark, path)
    file_system.mkdirs(location)


def moved(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder; on file systems with atomic renames it appears whole or not at all."""
    file_system, location = _file_system(spark, source)
    if not file_system.rename(location, spark._jvm.org.apache.hadoop.fs.Path(target)):
        raise OSError(f"cannot rename {source} to {target}")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file that appears whole: under another name first, then renamed."""
    file_system, location = _file_system(spark, path)
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.draft")
    out = file_system.create(draft, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    file_system.delete(location, False)
    if not file_system.rename(draft, location):
        raise OSError(f"cannot write {path}")


def read_text(spark: SparkSession, path: str) -> str:
    file_system, location = _file_system(spark, path)
    source = file_system.open(location)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()


def release(spark: SparkSession) -> bool:
    """Drop every scratch table of this application; call it when the job's results are stored."""
    return remove(spark, scratch_root(spark))
