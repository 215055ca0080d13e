"""What several of the operators share: table access, scratch tables, Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import scratch_root


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet to the shared scratch folder (in a subfolder for each value of ``by``) and read it back.

    The files outlive lost executors; the driver's JVM removes them when it ends. The write's own shuffle
    files go as soon as it is done.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path, partitionBy=by)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame, subfolder: str) -> None:
    """Remove a subfolder of a table that ``materialize`` wrote; nothing may read that part again."""
    spark = df.sparkSession
    folder = {f.rsplit("/", 2)[0] for f in df.inputFiles() if f"/{subfolder}/" in f}
    for path in folder:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{subfolder}")
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Rows of keys (ids and hashes) that a join broadcasts at most.
BROADCAST_ROWS = 500_000


def bounded(keys: DataFrame) -> DataFrame:
    """``keys``, a stored table of ids, to be joined with texts: broadcast up to ``BROADCAST_ROWS``, beyond by a shuffle without sort."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys.hint("shuffle_hash")


def fresh(name: str, df: DataFrame) -> str:
    """``name``, with as many underscores as it takes to differ from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_mod(column: str, n: int) -> F.Column:
    """crc32 of the column's decimal text, modulo n (null for null)."""
    return F.crc32(F.col(column).cast("string")) % F.lit(n)


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The texts of an Arrow string column as UTF-8, nulls as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def rows_of(batches: Iterator[pa.RecordBatch], limit: int, column: str = "text") -> Iterator[pa.Table]:
    """Regroup a partition's batches so that each table holds about ``limit`` bytes of ``column`` (a longer row stands alone).

    Memory per task is then bounded by ``limit`` plus one row, however rows are batched by Spark.
    """
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = 0
        for i, n in enumerate(sizes):
            size += n
            if size >= limit:
                held.append(batch.slice(start, i + 1 - start))
                yield pa.Table.from_batches(held)
                held, size, start = [], 0, i + 1
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)
