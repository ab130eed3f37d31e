"""Tables written between the steps of one operator, in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from pathlib import Path

from py4j.java_gateway import is_instance_of
from pyspark.sql import DataFrame, SparkSession

from tidegraph import compiled


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: spark.checkpoint.dir of the session. Only a local master, as in tests, may do without."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if spark.sparkContext.master.split("[")[0] == "local":
        return "file:///tmp/checkpoints"
    raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def write_options(spark: SparkSession, path: str) -> dict[str, str]:
    """Options of a writer to path that keep executors from starting a process for each file (see PlainLocalFiles.java).

    Only for local files; if the driver's loader takes no classes, none, and the table is the same.
    """
    jvm = spark._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    loader = conf.getClassLoader()
    if jvm.org.apache.hadoop.fs.Path(path).getFileSystem(conf).getScheme() != "file" or not is_instance_of(spark.sparkContext._gateway, loader, "org.apache.spark.util.MutableURLClassLoader"):
        return {}
    file = compiled.jar(spark, Path(__file__).with_name("PlainLocalFiles.java"))
    url = jvm.java.io.File(file).toURI().toURL()
    if url not in list(loader.getURLs()):
        loader.addURL(url)
        spark.sql(f"ADD JAR '{file}'")
    # The instance that Spark itself holds stays what it is.
    return {"fs.file.impl": "PlainLocalFiles", "fs.file.impl.disable.cache": "true"}


class Scratch:
    """A folder of intermediate Parquet tables.

    A written table cuts lineage and survives the loss of executors: a lost task
    rereads it instead of recomputing what made it.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
        # Results are read lazily, so what no caller drops goes when the driver ends.
        atexit.register(self._end)

    def _end(self) -> None:
        with contextlib.suppress(Exception):  # the session may be gone by then
            self.drop()

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and return the table as read back."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").options(**write_options(self.spark, path)).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        """Delete one table, or all of them, once nothing reads it any more."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
