"""Written stages: cut lineage through the shared folder that the cluster names.

Spark's ``checkpoint()`` would compute a plan twice (once to count, once to
write), so a stage here is a Parquet table under ``spark.checkpoint.dir``.
Everything survives the loss of executors, because nothing is kept on them.

A result may still read its stages when the operator returns, so an operator
cannot delete them.  ``scope`` is for callers that write the result: stages that
were made inside it are deleted at its end.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder from ``spark.checkpoint.dir``; where unset, one of our own, in local mode only."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        known = spark.sparkContext.getCheckpointDir()
        if not known:
            master = spark.sparkContext.master
            if not (master == "local" or master.startswith("local[")):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            made = tempfile.mkdtemp(prefix="wordloom-")
            atexit.register(shutil.rmtree, made, ignore_errors=True)
            known = f"file://{made}"
            spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


#: Up to so many ids (16 MB of longs) are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def broadcast_if_few(ids: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """A written table of ids, hinted for broadcast if its count is within the bound."""
    return F.broadcast(ids) if ids.count() <= most else ids


def delete_folder(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


#: Folders made inside each open scope, innermost last.
_open: list[list[str]] = []


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes the stages that operators wrote inside, once the caller has written what it needs of them."""
    made: list[str] = []
    _open.append(made)
    try:
        yield
    finally:
        _open.remove(made)
        for path in made:
            delete_folder(spark, path)


class Workspace:
    """A folder of stages that belong to one run of an operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._made = 0
        if _open:
            _open[-1].append(self.path)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Writes a table once and reads it back; what comes later starts from its files."""
        self._made += 1
        path = f"{self.path}/{self._made}-{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Deletes stages that nothing reads any more."""
        for table in tables:
            for file in table.inputFiles()[:1]:
                delete_folder(self.spark, file.rsplit("/", 1)[0])
