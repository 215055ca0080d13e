"""Scratch tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders made for local sessions that name none, by application.
_LOCAL: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. A local session without one, as in tests, gets a temporary folder; a cluster without one is an error."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir")
    if root:
        return root
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _LOCAL.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="tesselq-"))


def _path(df: DataFrame, path: str):
    context = df.sparkSession.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(context._jsc.hadoopConfiguration())


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back, which cuts its lineage. The files go with the driver's JVM."""
    path = f"{scratch_root(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where, system = _path(df, path)
    system.deleteOnExit(where)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Remove the files of a table that ``stored`` gave; nothing may read it again."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        where, system = _path(df, folder)
        system.delete(where, True)
