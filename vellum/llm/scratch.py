"""Intermediate tables in the folder that driver and executors share.

Lineage is cut by writing Parquet under ``spark.checkpoint.dir``: every
executor can read it again after another one is lost, and only the needed
columns are read back.  The folder is read from the session; only in local
mode, where driver and executors are one process, a default is set.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_DEFAULT = "/tmp/checkpoints/vellum"


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a default only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(LOCAL_DEFAULT)
    return LOCAL_DEFAULT


class Scratch:
    """Names tables of one operator call; they go when the session's JVM ends."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/vellum-{what}-{uuid.uuid4().hex}"
        self._n = 0
        self._path(self.root, "deleteOnExit")

    def _path(self, path: str, call: str, *args):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return getattr(fs, call)(p, *args)

    def place(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return a DataFrame that reads it back."""
        path = self.place(name)
        df.write.option("compression", "zstd").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._vellum_path = path
        return back

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables of ``write`` that nothing reads any more."""
        for t in tables:
            self._path(t._vellum_path, "delete", True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while f"_{name}".lower() in taken:
        name = f"_{name}"
    return f"_{name}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
