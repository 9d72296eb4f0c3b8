"""Token counts through a digest cache.

Texts are named by the SHA-256 of their normalised content (UTF-8, null as empty; nothing else, so
that equal digests mean equal counts for any tokenizer), the tokenizer by the SHA-256 of its file.
Distinct digests are joined with the stored counts; only distinct misses are encoded, and appended
to the cache, which is partitioned by tokenizer.  Digests of very many rows are joined without meeting
in one task.  Copies collapse before the shuffle (partial aggregation keeps one text per digest and
task), so a group of copies of any size is encoded once and crosses the network at most once a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import WordBpe, file_digest
from .common import materialise, shared_dir, shared_path, spread_join, table

#: Characters of text that are encoded at a time in a worker.
SLICE_CHARS = 4_000_000
CACHE_SCHEMA = "digest binary, n_tokens long, tokenizer string"
#: Part of a tokenizer's version: change it when the encoders below change what they return.
ENCODER = "1"
#: Up to this number, missing digests are broadcast.
FEW_MISSES = 100_000


class PieceModel:
    """Counts by sentencepiece, without begin and end."""

    def __init__(self, path: str):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)

    def counts(self, texts: list[str | None]) -> list[int]:
        return [len(x) for x in self.lib.encode([t or "" for t in texts], num_threads=1)]


class JsonModel:
    """Counts by tokenizers for files that WordBpe doesn't know."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()

    def counts(self, texts: list[str | None]) -> list[int]:
        return [len(e.ids) for e in self.lib.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@lru_cache(maxsize=4)
def encoder(path: str):
    """One encoder for a worker process and file; worker processes are used again."""
    if path.endswith(".model"):
        return PieceModel(path)
    word = WordBpe(path)
    return word if word.fast is not None else JsonModel(path)


def slices(texts: list[str | None], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Index ranges of about ``limit`` characters, of one text at least."""
    start, n = 0, 0
    for i, t in enumerate(texts):
        if n and n + len(t or "") > limit:
            yield start, i
            start, n = i, 0
        n += len(t or "") + 1
    if start < len(texts):
        yield start, len(texts)


def encode_misses(misses: DataFrame, path: str, version: str) -> DataFrame:
    """(digest, n_tokens, tokenizer) of (digest, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            counts = [n for a, b in slices(texts) for n in model.counts(texts[a:b])]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(counts, pa.int64()), pa.array([version] * len(texts), pa.string())], names=["digest", "n_tokens", "tokenizer"])

    return misses.select("digest", "text").mapInArrow(run, CACHE_SCHEMA)


def default_cache(spark: SparkSession) -> str:
    """The cache of a cluster: a folder under the shared one that stays, so a later run finds the counts."""
    return f"{shared_dir(spark)}/token-cache"


def token_counts(docs: DataFrame, path: str, cache: str | None = None, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    ``cache`` is a parquet folder of counts, partitioned by tokenizer version and made if it isn't
    there; misses are appended to it before this returns.  Where all digests are stored no text moves,
    where few are missing only their texts do.  A null text counts as empty; a very long text is
    encoded as a whole; repeated rows and null ids stay; other columns are ignored; an empty table
    gives no rows.  Writers that race append a digest twice at worst; readers take one.
    """
    spark = docs.sparkSession
    cache = cache or default_cache(spark)
    version = f"{ENCODER}-{file_digest(path)}"
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.unhex(F.sha2(text, 256)).alias("digest")
    keys = materialise(docs.select(F.col(id_col).alias("doc_id"), digest, F.octet_length(text).cast("long").alias("n_bytes")), "token-keys")
    needed = materialise(keys.groupBy("digest").agg(F.count("*").alias("n")), "token-digests")
    stored = stored_counts(spark, cache, version, needed)
    missing = needed.select("digest") if stored is None else materialise(needed.select("digest").join(stored, "digest", "left_anti"), "token-misses")
    n = missing.count()
    if n:
        texts = docs.select(digest, text.alias("text"))
        if n <= FEW_MISSES:
            texts = texts.join(F.broadcast(missing), "digest", "left_semi")
        texts = texts.groupBy("digest").agg(F.first("text").alias("text"))
        if n > FEW_MISSES and stored is not None:
            texts = texts.join(missing, "digest", "left_semi")
        encode_misses(texts, path, version).write.mode("append").partitionBy("tokenizer").parquet(cache)
        stored = stored_counts(spark, cache, version, needed)
    if stored is None:  # an empty table and no cache
        return keys.select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_tokens"), F.lit(False).alias("over_limit"))
    counts = materialise(needed.join(stored, "digest"), "token-counts")
    return spread_join(keys, counts, "digest", "n").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def stored_counts(spark: SparkSession, cache: str, version: str, needed: DataFrame) -> DataFrame | None:
    """(digest, n_tokens) of a tokenizer version for the digests that are needed, one row each; None where there is no cache."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{cache}/tokenizer={version}")
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return None
    rows = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == version).select("digest", "n_tokens")
    return rows.join(needed.select("digest"), "digest", "left_semi").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, whole texts: a cold run that fills a new cache, then the warm run that answers.

    The cache is new each time, so that every run does the whole job; a cluster would keep
    ``default_cache``.
    """
    docs, cache = table(spark, sf_dir, "documents"), shared_path(spark, "token-cache")
    token_counts(docs, tokenizer_path(), cache)
    return token_counts(docs, tokenizer_path(), cache)


QUERIES = {"op10_tokens": op10_tokens}
ORACLES: dict[str, str] = {}
