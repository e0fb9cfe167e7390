"""Cutting lineage with tables in the folder all executors share, and a broadcast whose size is checked."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``. Only where that is unset and the
    session is local, as in tests, a folder of this machine is set."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = f"file://{tempfile.gettempdir()}/siltra-shared"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def forget(spark: SparkSession) -> None:
    """Delete what this session has written to the shared folder; call it when its results are no longer read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/siltra/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it again: it is computed once, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/siltra/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a few numbers that are sent to all tasks rather than have a table shuffled.
FEW = 100_000


def few(df: DataFrame, name: str) -> DataFrame:
    """``df``, a list of a few numbers a row to be joined with a table: written once, and sent to the tasks if it is short.
    Else the planner would shuffle the table before it knows the list's size."""
    df = materialize(df, name)
    return F.broadcast(df) if df.count() <= FEW else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many parts as there are task slots, where it comes from fewer files: a table in one row group is else one task."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if len(df.inputFiles()) < slots else df


def number_rows(df: DataFrame, order: list[str], name: str = "row_no", start: int = 1) -> DataFrame:
    """Dense numbers in the order of ``order``, without ordering all rows in one task.

    A range sort is written once; each part numbers its own rows and adds the sizes of the parts before it (one
    row a part). ``order`` must be total, else ties are numbered in any order.
    """
    df = materialize(df, "unnumbered")  # the sample for the ranges then reads the order columns only
    laid = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    laid = laid.withColumn("_at", F.monotonically_increasing_id() - F.shiftleft(F.col("_part").cast("long"), 33))
    laid = materialize(laid, "numbered")
    sizes = {r["_part"]: r["n"] for r in laid.groupBy("_part").agg(F.max("_at").alias("n")).collect()}  # one row a part
    rows, upto = [], start
    for part in sorted(sizes):
        rows.append((part, upto))
        upto += sizes[part] + 1
    offsets = F.broadcast(df.sparkSession.createDataFrame(rows, "_part int, _base long"))
    return laid.join(offsets, "_part").withColumn(name, F.col("_base") + F.col("_at")).drop("_part", "_at", "_base")
