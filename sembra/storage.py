"""The shared folder, tables written to cut lineage, and global positions without a single task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``; a folder of our own only where that is unset."""
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not conf:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not own.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf = own.get() if own.isDefined() else "file://" + tempfile.mkdtemp(prefix="sembra-")
        if not own.isDefined():
            spark.sparkContext.setCheckpointDir(conf)
    return f"{conf}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_position(df: DataFrame, order: list[str], out: str = "_pos") -> DataFrame:
    """df with the place of each row in the order, from 0; equal rows get places in any order.

    Range partitions are sorted and written; one count per partition comes to the driver.  Meant for
    narrow frames: join wide columns back by an id.
    """
    s = df.repartitionByRange(*order).sortWithinPartitions(*order)
    s = materialise(s.withColumns({"_pid": F.spark_partition_id(), "_mid": F.monotonically_increasing_id()}), "position")
    sizes = s.groupBy("_pid").agg(F.count("*").alias("n"), F.min("_mid").alias("first")).orderBy("_pid").collect()
    shift, at = [], 0
    for r in sizes:
        shift.append((r._pid, at - r.first))
        at += r.n
    offsets = s.sparkSession.createDataFrame(shift or [(0, 0)], "_pid int, _shift long")
    return s.join(F.broadcast(offsets), "_pid").withColumn(out, F.col("_mid") + F.col("_shift")).drop("_pid", "_mid", "_shift")
