"""Session helpers: reading tables, shipping the package, tables in the shared folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder; any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    here = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(), f"{here.name}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one set
    here where that is unset and all runs on this machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not found:
        found = os.path.join(tempfile.gettempdir(), "loamgraph-checkpoints")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir() or found
    return found


#: Rows of a narrow table that a task is started for.
TASK_ROWS = 50_000


def in_few_tasks(df: DataFrame, rows: int, each: int = TASK_ROWS) -> DataFrame:
    """`df`, which comes from about so many rows, in no more tasks than they need."""
    tasks = rows // each + 1
    return df.coalesce(tasks) if tasks < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


@contextmanager
def batch_bytes(spark: SparkSession, most: int) -> Iterator[None]:
    """Actions within hand on Arrow batches of about `most` bytes at most; the session's
    setting comes back afterwards."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Written tables that cut lineage: each survives the loss of any executor.

    The tables stay until the application ends, since the lazy result reads them;
    `drop` removes one as soon as nothing lazy needs it any more.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(self.close)

    def write(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def counted(self, df: DataFrame) -> tuple[DataFrame, int]:
        """A written table and its number of rows, in one pass."""
        seen = Observation()
        out = self.write(df.observe(seen, F.count(F.lit(1)).alias("rows")))
        return out, seen.get["rows"]

    def drop(self, df: DataFrame) -> None:
        delete(self.spark, df._scratch_path)

    def close(self) -> None:
        try:
            delete(self.spark, self.root)
        except Exception:  # noqa: BLE001  the JVM may have ended before this hook
            pass
