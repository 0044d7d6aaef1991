"""Session settings and the shared folder that jobs may write to."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(cores: str = "8", partitions: int = 8, app: str = "lectern") -> SparkSession:
    """Local session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    A local session that names none gets a folder of its own; a cluster must name one, since
    its machines do not see each other's disks.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: bytes of a table from which on the shuffles behind it are worth letting go
LARGE_TABLE = 4 << 20


def write_table(df: DataFrame, path: str) -> None:
    """Write a table of the shared folder, small on disk, and let the shuffles behind a large one go.

    Spark deletes a finished step's shuffle files when the driver's garbage is collected, which
    may else be long after; until then they take room beside the table that holds their result.
    """
    spark = df.sparkSession
    df.write.parquet(path, compression="zstd")
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.getContentSummary(folder).getLength() < LARGE_TABLE:
        return
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def through_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives loss.

    Runs a job. Use where one result feeds several branches of a plan.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    write_table(df, path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a small table out to all cores before heavy row work.

    A table of as many splits as cores is left as it is; at scale this adds no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 32 << 20


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a table for broadcast if it has at most ``rows`` rows and ``size`` bytes (as JSON).

    Runs a job: the table is written once, measured, and read back by the join, so that its
    plan runs a single time. A larger table is left to a shuffled join.
    """
    held = through_table(df, "side")
    measured = held.limit(rows + 1).select(F.octet_length(F.to_json(F.struct("*"))).alias("n")).agg(F.count("*"), F.sum("n")).first()
    return F.broadcast(held) if measured[0] <= rows and (measured[1] or 0) <= size else held
