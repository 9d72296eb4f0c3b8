"""Helpers of the training-data operators: tables, the shared folder, native word splitting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The separators of ``[^\x20\x09-\x0D]+``.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a new one where that is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        if own.isDefined():
            return own.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sembra-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A key is hot if it has more than this share of the rows, so there are fewer than 1 / HOT_SHARE of them.
HOT_SHARE = 0.001


def spread_join(rows: DataFrame, about: DataFrame, keys: str | list[str], n: str) -> DataFrame:
    """rows left join about (one row per key, which says in column n how many of rows have it), hot keys split.

    The rows of about for the hot keys are broadcast (fewer than 1 / HOT_SHARE by their definition);
    rows with a hot key don't meet by key but go to tasks evenly.  ``about`` is a written table.
    """
    total = about.agg(F.sum(n)).first()[0] or 0
    keys = [keys] if isinstance(keys, str) else keys
    others = [c for c in about.columns if c not in (*keys, n)]
    hot = F.col(n) > HOT_SHARE * total
    few = F.broadcast(about.where(hot).select(*keys, F.struct(*others).alias("_hot")))
    rest = about.where(~hot).select(*keys, F.lit(0).alias("_salt"), F.struct(*others).alias("_rest"))
    salt = F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(F.pmod(F.monotonically_increasing_id(), F.lit(4096)).cast("int") + 1)
    met = rows.join(few, keys, "left").withColumn("_salt", salt).join(rest, [*keys, "_salt"], "left")
    return met.select(*rows.columns, F.coalesce("_hot", "_rest").alias("_about")).select(*rows.columns, *[F.col("_about")[c].alias(c) for c in others])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as it takes to be no column of df (names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def open_folder(uri: str):
    """(file system, path) of a folder by its address; pyarrow knows local, HDFS and object stores."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null and for a text of white space only."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS, -1))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def or_all(parts: list[Column]) -> Column:
    """Bitwise OR of the columns, as a balanced tree."""
    while len(parts) > 1:
        parts = [a.bitwiseOR(b[0]) if b else a for a, *b in (parts[i : i + 2] for i in range(0, len(parts), 2))]
    return parts[0]
