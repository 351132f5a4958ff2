"""Session services: the shared folder, scratch tables that cut lineage."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the context's own.

    Where none is set, a temporary folder is made for a local session; on a
    cluster that would be a different folder on each machine, so it is an error.
    """
    own = spark.conf.get("spark.checkpoint.dir", None)
    if own:
        return own.rstrip("/")
    sc = spark.sparkContext
    there = sc._jsc.sc().getCheckpointDir()
    if there.isDefined():
        return there.get().rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="cartoframe-")
    sc.setCheckpointDir(f"file://{made}")
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def shipped(query):
    """The query, with this package on the path of a local session's Python workers.  On a cluster it is installed or sent with the job."""

    @functools.wraps(query)
    def run(spark: SparkSession, *args):
        sc = spark.sparkContext
        if sc.master.startswith("local[") or sc.master == "local":
            here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
            there = sc.environment.get("PYTHONPATH", "")
            if here not in there.split(os.pathsep):
                sc.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [here, there]))
        return query(spark, *args)

    return run


class Scratch:
    """Parquet tables in the shared folder.  They survive lost executors and cut the lineage of what reads them.

    Tables not dropped before are deleted when the application ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        fs = self._path(self.root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        fs.mkdirs(self._path(self.root))
        fs.deleteOnExit(self._path(self.root))
        self._fs = fs
        self._made: dict[int, str] = {}

    def table(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/t{len(self._made)}-{uuid.uuid4().hex[:8]}"
        schema = df.schema
        df.write.parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        self._made[id(out)] = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes a table that no later step reads."""
        if path := self._made.pop(id(df), None):
            self._fs.delete(self._path(path), True)
