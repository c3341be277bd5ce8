"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: With it, the shuffle files of an action go as soon as it ends, instead of when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a local folder if Spark runs in one process (tests), else an error."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="coppice-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, not there yet; what is written to it goes when the driver's file system handle closes."""
    above = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(above)
    files = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(hpath)
    files.deleteOnExit(hpath)
    return f"{above}/data"


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors once a session, so that they need no copy of their own."""
    sc = spark.sparkContext
    if getattr(sc, "_coppice_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="coppice-")) / "coppice_package.zip"
    with zipfile.ZipFile(path, "w") as out:
        for f in sorted(root.rglob("*.py")):
            out.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(path))
    sc._coppice_shipped = True


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Actions in it leave no shuffle files. For those whose plan is not run again; a frame that is run again shuffles anew either way."""
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)


def stage(df: DataFrame, by: str | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage is cut, and a lost executor costs nothing of it.

    Parquet rather than checkpoint(): it is compressed, and the reader forgets the writer's
    partitioning, so that a later join gets exchanges which AQE may split when a key is hot.
    With `by`, rows lie in folders by that column, and a filter on it reads its folders alone.
    What was shuffled for it goes at once. The files go when the driver's file system handle closes.
    """
    spark = df.sparkSession
    path = folder(spark, "coppice")
    with shuffles_dropped(spark):
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
