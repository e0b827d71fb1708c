"""Lineage cuts in the folder that the cluster shares.

A table written there survives the loss of executors and is read back with
its exact schema.  The folder is ``spark.checkpoint.dir`` of the session; where
that is unset, a session on one machine (tests, notebooks) gets a temporary
folder and any other session an error, since executors can't read each other's disks.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_OWN = "lexquarry.shared.dir"
#: Spark's own switch: a finished write needs its shuffle files no more.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session."""
    found = spark.conf.get(_KEY, None) or spark.conf.get(_OWN, None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"set {_KEY} to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-lexquarry-")
        spark.conf.set(_OWN, found)
    return found.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return it as read back; its shuffle files are freed at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexquarry/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def drop_written(*tables: DataFrame) -> None:
    """Delete tables that :func:`written` returned, once nothing will read them any more."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.written_at)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def written_bytes(table: DataFrame) -> int:
    """How many bytes a table that :func:`written` returned takes in the shared folder."""
    path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.written_at)
    return path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def width(spark: SparkSession, least: int = 8) -> int:
    """How many ways a hot group is split: follows the shuffle partitions."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


#: Bytes of input files for each partition of a wide step.
SPREAD = 4 << 20


def spread(df: DataFrame, *keys: str, source: DataFrame | None = None) -> DataFrame:
    """``df`` in partitions by ``keys`` whose number grows with the files that ``source`` (itself unless given) reads.

    Spark joins small shuffle partitions and never makes more of them than the session says, so the hash tables and
    sorts of one task would grow with the input.
    """
    spark = df.sparkSession
    conf, size = spark._jsc.hadoopConfiguration(), 0
    for name in (source or df).inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name))  # names come encoded
        size += path.getFileSystem(conf).getFileStatus(path).getLen()
    least = min(16, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    return df.repartition(max(least, -(-size // SPREAD)), *keys)
