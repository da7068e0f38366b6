"""Intermediate tables in the folder that all executors share.

Iterative operators cut their lineage by writing a table and reading it again, so
a lost executor costs a re-read and not a replay of every round."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table up to this many rows of a few longs (some MB) is broadcast, a longer one is joined by a shuffle. Broadcasts of many rounds lie in the driver together.
BROADCAST_ROWS = 100_000


class _Scopes(threading.local):
    """Scopes that are open in this thread: queries in other threads keep and drop their own tables."""

    def __init__(self):
        self.open: list[list[DataFrame]] = []


_scopes = _Scopes()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only where that is absent and all tasks run in this process, as in
    tests, a private one is made (and named there); a cluster must name one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def write_shared(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write df under the shared folder and return the written table. Inside scratch() it is deleted at the end
    of the block; what is to be kept goes with the block around that one, if there is one."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    scopes = _scopes.open[:-1] if keep else _scopes.open
    if scopes:
        scopes[-1].append(out)
    return out


def drop_shared(*tables: DataFrame) -> None:
    """Delete tables of write_shared that no later read needs."""
    for df in tables:
        path = getattr(df, "_shared_path", None)
        if path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that are written inside the block and not kept are deleted at its end, so what leaves the block must not
    read them: write it with keep=True."""
    _scopes.open.append([])
    try:
        yield
    finally:
        drop_shared(*_scopes.open.pop())


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A written table, marked for broadcast if it has at most `most` rows."""
    return F.broadcast(df) if df.count() <= most else df
