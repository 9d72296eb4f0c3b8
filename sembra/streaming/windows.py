"""Streams (an extension): windows with watermarks, sessions, and row-wise model steps by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..storage import shared_path


def tumbling(df: DataFrame, time_col: str, width: str, keys: list[str], slide: str | None = None, late: str | None = None, **aggs: str) -> DataFrame:
    """Aggregates per window (sliding with ``slide``); ``late`` sets a watermark.  For batches and streams."""
    df = df.withWatermark(time_col, late) if late else df
    w = F.window(time_col, width, slide) if slide else F.window(time_col, width)
    out = df.groupBy(w.alias("w"), *keys).agg(*[F.expr(e).alias(n) for n, e in aggs.items()])
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *aggs)


def sessions(df: DataFrame, time_col: str, gap: str, keys: list[str], late: str | None = None, **aggs: str) -> DataFrame:
    """Aggregates per session: events of a key with less than ``gap`` between them."""
    df = df.withWatermark(time_col, late) if late else df
    out = df.groupBy(F.session_window(time_col, gap).alias("w"), *keys).agg(*[F.expr(e).alias(n) for n, e in aggs.items()])
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, *aggs)


def read_stream(spark: SparkSession, path: str, schema, **options) -> DataFrame:
    return spark.readStream.schema(schema).options(**options).parquet(path)


def run_available(df: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Process what is there into a parquet table of the shared folder and return it.

    In mode complete each batch writes the whole result, the last of which stands; in mode append a
    batch has a folder of its own, so one that is run again replaces its own rows.
    """
    spark = df.sparkSession
    sink = shared_path(spark, name)

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{sink}/batch={number if mode == 'append' else 0}")

    writer = df.writeStream.foreachBatch(batch).outputMode(mode).trigger(availableNow=True)
    writer = writer.option("checkpointLocation", checkpoint or shared_path(spark, f"{name}-checkpoint"))
    writer.start().awaitTermination()
    return spark.read.schema(df.schema).parquet(sink).select(*df.columns)


def sem_stream(engine: Engine, stream: DataFrame, step: Callable[[Engine, DataFrame], DataFrame], sink: str, checkpoint: str):
    """A row-wise semantic step on a stream: each micro-batch goes through the barrier and is appended to ``sink``.

    The batch number is part of the folder, so a batch that is run again replaces its own rows; the
    call log makes its calls free.
    """

    def batch(df: DataFrame, number: int) -> None:
        step(engine, df).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
