"""What every part of the library needs from the session it is given.

Nothing here keeps state on a machine: shared tables go to the folder named by
``spark.checkpoint.dir``; the package itself reaches the executors with ``addPyFile``.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()
#: Bytes of input for a file of a table between steps.
FILE = 4 << 20


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers (once per application)."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="pkg-"), f"{_PACKAGE.name}.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(_PACKAGE.parent))
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is ``spark.checkpoint.dir``. Where the session names none and runs on this machine alone (tests),
    a fresh folder is made and set as the checkpoint folder; on a cluster that is an error.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="shared-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        base = f"file://{own}"
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def plan_bytes(df: DataFrame) -> int:
    """Bytes of the files that a table is read from, as the planner knows them; 0 for other sources."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(k).stats().sizeInBytes()) for k in range(leaves.size())]
    return sum(x for x in sizes if x < 1 << 60)  # an unknown size is told as a very large one


def settled(df: DataFrame) -> DataFrame:
    """``df`` in no more partitions than its input needs: one for each ``FILE`` bytes of it, two for each core at least.

    Shuffles of small tables into very many partitions would leave as many files, each of which costs
    calls to the store (and, on a local file system without native code, programs started by the executor).
    """
    least = 2 * df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(max(least, -(-plan_bytes(df) // FILE)))


def _saved(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    settled(df).write.option("compression", "zstd").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it again."""
    return _saved(spark, df, fresh_path(spark, name))


class Scratch:
    """Tables between the steps of one function: written like ``written``, removed at its end."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        path = fresh_path(self.spark, name)
        self.paths.append(path)
        return _saved(self.spark, df, path)

    def __exit__(self, *_) -> None:
        for path in self.paths:
            drop_path(self.spark, path)


def clean(spark: SparkSession) -> None:
    """Remove all that this application has left in the shared folder; results that read it must be saved before."""
    drop_path(spark, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a path of the shared folder through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
