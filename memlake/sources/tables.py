"""Readers for parquet tables and scratch tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers wherever they run; once per Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_memlake_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    if root.is_dir() and root.parent.suffix != ".zip":
        at = Path(tempfile.mkdtemp(prefix="memlake-code-")) / "memlake.zip"  # served to the workers by the driver itself
        with zipfile.ZipFile(at, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(str(at))
        atexit.register(shutil.rmtree, at.parent, True)
    sc._memlake_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` under ``sf_dir`` (a parquet file or a folder of them)."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: ``spark.checkpoint.dir``.

    Where that is unset a folder of this machine serves a local master (tests); on a
    cluster executors would each write to their own disk, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="memlake-"))
    return spark.sparkContext.getCheckpointDir()


def _delete(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        at = hadoop.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session is gone already
        pass


#: Folders of scratch tables that are still there.
_HELD: set[str] = set()


def release(spark: SparkSession) -> None:
    """Deletes every scratch table; for long sessions, once the results that read them have been consumed."""
    while _HELD:
        _delete(spark, _HELD.pop())


class Scratch:
    """Written tables that cut lineage: they outlive lost executors, unlike cached or locally checkpointed data.

    ``write`` returns the table read back. ``drop`` deletes what is no longer needed.
    Results are lazy and read these tables, so the rest stays until ``release`` or the end
    of the driver process.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_dir(spark)}/memlake/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        _HELD.add(self.base)
        atexit.register(_delete, spark, self.base)

    def write(self, df: DataFrame, files: int | None = None) -> DataFrame:
        path = f"{self.base}/{self.n}"
        self.n += 1
        (df.coalesce(files) if files else df).write.option("compression", "zstd").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._memlake_path = path
        return back

    def drop(self, df: DataFrame) -> None:
        _delete(self.spark, df._memlake_path)

    def settle(self) -> None:
        """Lets Spark remove the shuffle files of finished stages, which nothing needs once their result is written."""
        self.spark.range(1).count()  # the scheduler holds on to the last job
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
