"""Packing by power-of-two decomposition.

A document of n tokens is cut into floor(n / 2048) pieces of 2048 and one piece for each binary digit
of the rest, longest first.  Every piece is a sequence of its own whose length is a power of two, so
nothing is padded and no sequence crosses documents; equal lengths form a bucket (``write_buckets``),
from which ``batches`` of one shape are made.  The work is within a row: no shuffle, no state, any part can be recomputed.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .tokens import encoder, slices, tokenizer_path

SEQUENCE = 2048
END_ID = 1


def cut(n: int, longest: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; longest is a power of two."""
    out, at = [], 0
    while n - at >= longest:
        out.append((at, longest))
        at += longest
    for bit in range(longest.bit_length() - 2, -1, -1):
        if (n - at) >> bit & 1:
            out.append((at, 1 << bit))
            at += 1 << bit
    return out


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", longest: int = SEQUENCE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket (and ids).

    doc_tokens counts the ids of the text and end_id after them; a null or empty text has end_id
    alone.  sequence_id is unique in the result and the same when a lost part is recomputed; offset
    is 0, as each sequence is one piece.  Repeated rows and null ids are packed as rows of their own.
    An empty table gives no rows; a very long text is cut into many pieces of ``longest``.  Other
    columns are ignored.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())] + [("ids", pa.binary())] * with_ids
    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    tail = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path)
        for batch in batches:
            keys, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for a, b in slices(texts):
                cols: list[list] = [[] for _ in fields]
                for key, packed in zip(keys[a:b], model.packed(texts[a:b])):
                    packed += tail
                    n = len(packed) // 4
                    for start, length in cut(n, longest):
                        ids = packed[4 * start : 4 * (start + length)]
                        row = (key, start, length, zlib.crc32(ids), n, ids)
                        for col, v in zip(cols, row):
                            col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields)], names=[n for n, _ in fields])

    pieces = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, kinds)
    extra = {"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"), "bucket": F.col("length").cast("int")}
    return pieces.withColumns(extra)


def write_buckets(docs: DataFrame, path: str, folder: str, **settings) -> None:
    """Pack with ids and write one folder per length (bucket=1, 2, 4 …), pieces of equal length together."""
    pack(docs, path, with_ids=True, **settings).write.partitionBy("bucket").parquet(folder)


def batches(spark: SparkSession, folder: str, length: int, tokens: int = 64 * SEQUENCE) -> DataFrame:
    """Batches of one bucket: doc_ids, n, ids (n x length little-endian uint32), n being tokens / length or, at a task's end, less.

    A batch has one shape and needs no mask: each row of it is a piece of one document.
    """
    if tokens < length:
        raise ValueError("a batch holds one sequence at least")
    most = tokens // length
    schema = "doc_ids array<long>, n int, ids binary"

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list = []
        ids: list[bytes] = []

        def out() -> pa.RecordBatch:
            cols = [pa.array([keys[:most]], pa.list_(pa.int64())), pa.array([len(keys[:most])], pa.int32()), pa.array([b"".join(ids[:most])], pa.binary())]
            del keys[:most], ids[:most]
            return pa.RecordBatch.from_arrays(cols, names=["doc_ids", "n", "ids"])

        for part in parts:
            keys += part.column("doc_id").to_pylist()
            ids += part.column("ids").to_pylist()
            while len(keys) >= most:
                yield out()
        if keys:
            yield out()

    return spark.read.schema("doc_id long, ids binary, bucket int").parquet(folder).where(F.col("bucket") == length).select("doc_id", "ids").mapInArrow(run, schema)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document, whole texts; their bucket is their length."""
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


QUERIES = {"op5_packing": op5_packing}
ORACLES: dict[str, str] = {}
