"""Stored tables that know the files they were built from."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def source_state(spark: SparkSession, paths: Sequence[str]) -> str:
    """Digest of path, size and modification time of all files under ``paths``.

    Files are listed by Spark, with no column of content read, and summed up in any order.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    one = F.xxhash64("path", "length", F.col("modificationTime").cast("double")).cast("decimal(38,0)")
    row = files.select("path", "length", "modificationTime").agg(F.count("*").alias("n"), F.sum("length").alias("size"), F.sum(one).alias("h")).head()
    return hashlib.sha256(f"{row['n']}:{row['size']}:{row['h']}".encode()).hexdigest()[:24]


def fresh_table(spark: SparkSession, sources: Sequence[str], path: str, build: Callable[[], DataFrame], parameters: object = "") -> DataFrame:
    """The table under ``path`` built from ``sources``, built anew when they or ``parameters`` changed.

    Each build goes to a folder of its own. Only when it is whole does an empty marker appear, named
    after the state of the sources and that folder; a reader takes the folder of a marker of the
    present state, the first by name if two builders ran at once. So a failed build leaves no
    trace for readers, and nobody sees a table change while reading it.
    """
    state = hashlib.sha256(f"{source_state(spark, sources)}:{parameters!r}".encode()).hexdigest()[:24]
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = jvm(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def built() -> str | None:
        found = files.globStatus(jvm(f"{path}/ready-{state}-*")) or []
        names = sorted(status.getPath().getName() for status in found)
        return names[0].rsplit("-", 1)[1] if names else None

    version = built()
    if version is None:
        own = uuid.uuid4().hex
        build().write.parquet(f"{path}/table-{own}")
        files.create(jvm(f"{path}/ready-{state}-{own}"), False).close()
        version = built()
    return spark.read.parquet(f"{path}/table-{version}")


def dropped_versions(spark: SparkSession, sources: Sequence[str], path: str, parameters: object = "") -> int:
    """Deletes tables and markers of other states than the present one; the number of tables."""
    state = hashlib.sha256(f"{source_state(spark, sources)}:{parameters!r}".encode()).hexdigest()[:24]
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = jvm(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = 0
    for status in files.globStatus(jvm(f"{path}/ready-*")) or []:
        name = status.getPath().getName()
        if not name.startswith(f"ready-{state}-"):
            files.delete(status.getPath(), False)  # first the marker: no new reader comes
            files.delete(jvm(f"{path}/table-{name.rsplit('-', 1)[1]}"), True)
            gone += 1
    return gone
