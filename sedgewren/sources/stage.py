"""Tables between stages, in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    Only where ``spark.checkpoint.dir`` is unset (single-machine sessions, such as tests) a local folder is made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sedgewren-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


#: Bytes of a task's share of a small table.
SHARE = 128 << 20


def spread(df: DataFrame, path: str, *by: str) -> DataFrame:
    """Deal a table that lies in fewer files than there are cores out to all cores, by its key, before work that costs more than that.

    Larger tables, and those of many files, are left as they are read: nothing of them is shuffled.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    where, system = located(spark, path)
    found = system.getContentSummary(where)
    return df.repartition(cores, *by) if found.getFileCount() < cores and found.getLength() < cores * SHARE else df


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, whose content is deleted when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    where, system = located(spark, path)
    system.mkdirs(where)
    system.deleteOnExit(where)
    return path


def staged(df: DataFrame, name: str, by: str | None = None, group: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage and survives lost executors.

    ``by`` names a column by whose values the files are laid out, so that freed() can delete those of one value; ``group`` is the
    size of a row group in bytes, where readers are to leave out some of them.
    The files are deleted when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
    out = df.write.option("parquet.block.size", group) if group else df.write
    (out.partitionBy(by) if by else out).parquet(path)
    where, system = located(spark, path)
    system.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def located(spark: SparkSession, path: str):
    """Hadoop's path and file system of a path."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def freed(*tables: DataFrame, part: str | None = None) -> None:
    """Delete staged tables (or one part of them, as ``column=value``) that no later table needs.

    What was made of them must have been staged itself.
    """
    for table in tables:
        where, system = located(table.sparkSession, f"{table.staged_at}/{part}" if part else table.staged_at)
        system.delete(where, True)


def small(df: DataFrame, most: int = 32 << 20) -> DataFrame:
    """Mark a stored table for broadcast if its values take at most ``most`` bytes; beyond that it is shuffled.

    The items of an array count eight bytes each, as vectors are what arrays of queries hold.
    """
    wide = [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    fixed = sum(8 if f.name in wide else 16 for f in df.schema) + 16
    items = [F.octet_length(f"`{c}`") for c in wide] + [8 * F.array_size(f"`{f.name}`") for f in df.schema if isinstance(f.dataType, T.ArrayType)]
    rows, more = df.agg(F.count("*"), sum((F.coalesce(F.sum(x), F.lit(0)) for x in items), F.lit(0))).first()
    return F.broadcast(df) if rows * fixed + more <= most else df
