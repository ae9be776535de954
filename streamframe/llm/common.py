"""Helpers shared by the training-data operators.

Materialised intermediates are written as Parquet tables in the folder named by
``spark.checkpoint.dir`` (one sub-folder per session), so that any executor can
read them again after another one is lost. Where that setting is absent (local
tests) a temporary folder is used and registered as the checkpoint folder.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys whose values a lookup broadcasts, at most, and rows of a key that are never too many for a task.
HOT_KEYS = 50_000
HOT_ROWS = 64

_SESSION_TAG = uuid.uuid4().hex[:12]
_LOCAL: dict[str, str] = {}
_CLEANUP: set[str] = set()

#: ASCII white space of the word pattern ``[^\x20\x09-\x0D]+``; ``bytes.split()`` splits on exactly these.
ASCII_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver share."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="streamframe-")
            spark.sparkContext.setCheckpointDir(_LOCAL[app])
        base = _LOCAL[app]
    return f"{base.rstrip('/')}/streamframe-{_SESSION_TAG}"


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _cleanup(spark: SparkSession, path: str) -> None:
    try:
        _remove(spark, path)
    except Exception:  # the JVM is gone already; the session's folder is left to the cluster's cleaner
        pass


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; the session's folder goes at exit."""
    base = shared_dir(spark)
    if base not in _CLEANUP:
        _CLEANUP.add(base)
        atexit.register(_cleanup, spark, base)
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends there."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a materialised table that no later plan reads."""
    _remove(spark, path)


def table(sf_dir: str, name: str) -> str:
    return f"{sf_dir}/{name}.parquet"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table(sf_dir, name))


def small_batches(spark: SparkSession, rows: int = 512, size: int = 64 << 20) -> None:
    """Arrow batches of few rows and bytes for the session's plans to come: texts may be very long, and a batch is held whole.

    A session that asks for smaller batches keeps them.
    """
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        name = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(name).rstrip("bB")
        if now.lstrip("-").isdigit() and not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def lookup(rows: DataFrame, values: DataFrame, key: str, count: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``values``, a written table of one row for each key; its column ``count`` says how many rows have the key.

    Keys of more than one in HOT_KEYS of all rows cannot be more than HOT_KEYS: their values are broadcast and their rows
    stay where they are. All other rows are shuffled, of which no key has many. ``how`` is inner or left.
    """
    total = values.agg(F.sum(count)).first()[0] or 0
    least = max(HOT_ROWS, -(-total // HOT_KEYS))
    hot, cold = values.filter(F.col(count) > least), values.filter(F.col(count) <= least)
    other = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(other.join(cold, key, how))


def size_of(df: DataFrame) -> int:
    return df.agg(F.count("*")).first()[0]


def fresh(columns: Iterable[str], name: str) -> str:
    """``name``, or one like it that none of the columns has in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
