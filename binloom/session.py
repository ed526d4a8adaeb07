"""Session helpers shared by tests, the bench and library code."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and single-machine runs; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("binloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BINLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder for cut points: ``spark.checkpoint.dir``, as the session or context names it.

    A machine-local folder is used only on a local master without that setting; it is
    removed when the process ends. A shared folder belongs to whoever named it.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="binloom-checkpoint-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.setCheckpointDir(folder)
    return folder


#: Tables cut inside the open scopes, innermost last.
_scopes: list[list[str]] = []


@contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that ``cut_lineage`` writes inside, unless cut with ``keep``, on leaving.

    What is computed inside must be written by then: frames that still read those tables
    fail afterwards. A failed run leaves no tables either.
    """
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def without_broadcast(spark: SparkSession) -> Iterator[None]:
    """No table is gathered on the driver for a join that runs inside; hints to do so still hold.

    For steps whose joins have two sides that grow with the input: files and shuffled blocks below the
    limit unfold to many times their size on the driver, one beside the other.
    """
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def cut_lineage(df: DataFrame, keep: bool = False, codec: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Later operators scan the table several times: with pruned columns, known sizes, and
    nothing to recompute when an executor is lost. ``keep`` lets the table outlive an open
    ``scratch_tables``; ``codec`` is the compression of a table that is large for its job.
    """
    path = f"{shared_folder(df.sparkSession)}/binloom-{uuid.uuid4().hex}"
    if _scopes and not keep:
        _scopes[-1].append(path)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)
