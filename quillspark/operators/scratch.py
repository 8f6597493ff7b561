"""Scratch tables that cut the lineage of loops, and numbering sorted rows without one big task."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_made: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession, name: str) -> str:
    """A new path below the folder that spark.checkpoint.dir names; a local session without one (tests) gets its own.
    :func:`release` deletes what is written there."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", shared)
    path = f"{shared.rstrip('/')}/quillspark-scratch/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


@atexit.register
def release() -> None:
    """Delete every scratch table of this process; frames that still read one must be used up before."""
    while _made:
        spark, path = _made.pop()
        with contextlib.suppress(Exception):  # the session may have ended, and its folder with it
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def keep(df: DataFrame) -> DataFrame:
    """The frame as a table of its own, written once and read back, with true sizes for the joins that follow."""
    path = folder(df.sparkSession, "kept")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, order: list[Column], name: str, kind: str = "int") -> DataFrame:
    """Rows with their place (from 1) in a total order. They are sorted by range; a place is the one in its partition
    plus the sizes of the partitions before, so no task sees more than a range."""
    part, at = F.spark_partition_id(), F.monotonically_increasing_id()
    t = keep(rows.orderBy(*order).withColumns({"_part": part, "_at": at.bitwiseAND(F.lit((1 << 33) - 1))}))
    sizes = t.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row for each partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return t.join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part").withColumn(name, (F.col("_before") + F.col("_at") + 1).cast(kind)).drop("_part", "_at", "_before")
