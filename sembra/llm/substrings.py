"""Substring deduplication by recompression.

Every document is parsed into spans of windows (recompress.py); equal windows of different documents
always fall under the same anchor name.  Spark then works on names only:

1. by (anchor, span) the least doc_id: later documents with the same span have all its windows
   covered, and exact and near copies are settled here, one name for many windows;
2. anchors that hold different spans: for the first document of each span, single windows are named
   and their least doc_id is taken, which settles the borders of repeats exactly;
3. each document is joined with its covered spans and windows, and cut.

Groups are aggregated, never listed.  What is listed per document is bounded by its own length.  Spans
and windows of very many documents are joined without meeting in one task.

Departure from the method as it is usually told: its Spark rounds name runs and pairs through global
tables.  Here a name is a digest of what it stands for, so all partitions agree without a table, and
the rounds run within a task; a table a round would shuffle every token three times over (about 40 M
rows of the 80 M words of 0.5 GB in the first round alone, where the disk budget is 4 times the
input).  Candidates are verified by three digests of 64 bits that must all agree: the anchor, the
words' names, and a second name of each word from the other half of XXH3-128 of its bytes, under
another base, which shares nothing with the first.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, spread_join, table
from .recompress import Parse
from .tokens import slices

WINDOW = 50
SLICE_CHARS = 2_000_000
NAME_CACHE = 400_000


class Names(dict):
    """Word -> place of its two names, the halves of XXH3-128; emptied between slices when it is large."""

    def __init__(self):
        self.first, self.second = array("Q"), array("Q")

    def __missing__(self, word: bytes) -> int:
        import xxhash

        x = xxhash.xxh3_128_intdigest(word)
        self.first.append(x & 0xFFFFFFFFFFFFFFFF)
        self.second.append(x >> 64)
        self[word] = at = len(self)
        return at

    def of(self, split: list[list[bytes]], n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self) > NAME_CACHE:
            self.clear()
            self.first, self.second = array("Q"), array("Q")
        at = np.fromiter((self[x] for w in split for x in w), np.int64, n)
        return np.array(self.first, np.uint64)[at], np.array(self.second, np.uint64)[at]


def _parsed(texts: list[str | None], names: Names, window: int):
    """(words of each text, parse)."""
    split = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in texts]
    ends = np.cumsum([len(w) for w in split], dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    flat, checks = names.of(split, total)
    return split, ends, Parse(flat, ends, window, checks=checks)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def span_names(docs: DataFrame, window: int) -> DataFrame:
    """(anchor, span, check, doc_id) of all documents with an id; a slice of documents names a span of a document once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Names()
        for batch in batches:
            ids, texts = np.array(batch.column("doc_id").to_pylist(), dtype=np.int64), batch.column("text").to_pylist()
            for a, b in slices(texts, SLICE_CHARS):
                _, _, p = _parsed(texts[a:b], names, window)
                if len(p.doc):
                    order = np.lexsort((p.span, p.anchor, p.doc))
                    d, x, s = p.doc[order], p.anchor[order], p.span[order]
                    new = np.ones(len(d), dtype=bool)
                    new[1:] = (d[1:] != d[:-1]) | (x[1:] != x[:-1]) | (s[1:] != s[:-1])
                    yield pa.RecordBatch.from_arrays([_signed(x[new]), _signed(s[new]), _signed(p.check[order][new]), pa.array(ids[a:b][d[new]])], names=["anchor", "span", "check", "doc_id"])

    return docs.where("doc_id IS NOT NULL").mapInArrow(run, "anchor long, span long, check long, doc_id long")


def window_names(docs: DataFrame, window: int) -> DataFrame:
    """(anchor, name, check, doc_id) of the windows of the spans listed in column spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Names()
        for batch in batches:
            ids, texts, lists = (batch.column(c).to_pylist() for c in ("doc_id", "text", "spans"))
            for a, b in slices(texts, SLICE_CHARS):
                _, _, p = _parsed(texts[a:b], names, window)
                wanted = np.zeros(len(p.doc), dtype=bool)
                edge = np.searchsorted(p.doc, np.arange(b - a + 1))
                spans = p.span.view(np.int64)
                for k in range(b - a):
                    if edge[k] < edge[k + 1]:
                        wanted[edge[k] : edge[k + 1]] = np.isin(spans[edge[k] : edge[k + 1]], np.array(lists[a + k], dtype=np.int64))
                of, at = p.windows(np.flatnonzero(wanted))
                if len(of):
                    own = np.array(ids[a:b], dtype=np.int64)[p.doc[of]]
                    yield pa.RecordBatch.from_arrays([_signed(p.anchor[of]), _signed(p.window_hash(at)), _signed(p.window_check(at)), pa.array(own)], names=["anchor", "name", "check", "doc_id"])

    return docs.mapInArrow(run, "anchor long, name long, check long, doc_id long")


def cut(docs: DataFrame, window: int, with_text: bool) -> DataFrame:
    """Remove the words of covered spans and windows (columns spans, windows)."""
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())] + [("kept_text", pa.string())] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Names()
        for batch in batches:
            ids, texts, spans, wins = (batch.column(c).to_pylist() for c in ("doc_id", "text", "spans", "windows"))
            out: list[tuple] = [()] * len(ids)
            touched = [i for i in range(len(ids)) if spans[i] or wins[i]]
            for a, b in slices([texts[i] for i in touched], SLICE_CHARS):
                some = touched[a:b]
                split, ends, p = _parsed([texts[i] for i in some], names, window)
                edge = np.searchsorted(p.doc, np.arange(len(some) + 1))
                for k, i in enumerate(some):
                    n, base = len(split[k]), int(ends[k]) - len(split[k])
                    mine = np.arange(edge[k], edge[k + 1])
                    marks = np.zeros(n + 1, dtype=np.int64)
                    hit = mine[np.isin(p.span[mine].view(np.int64), np.array(spans[i] or [], dtype=np.int64))]
                    np.add.at(marks, p.first[hit] - base, 1)
                    np.add.at(marks, p.last[hit] + window - base, -1)
                    if wins[i] and n >= window:
                        at = np.arange(base, base + n - window + 1)
                        at = at[np.isin(p.window_hash(at).view(np.int64), np.array(wins[i], dtype=np.int64))]
                        np.add.at(marks, at - base, 1)
                        np.add.at(marks, at + window - base, -1)
                    keep = np.cumsum(marks[:-1]) == 0
                    kept = b" ".join(compress(split[k], keep.tolist()))
                    out[i] = (ids[i], n, int(n - keep.sum()), hashlib.sha256(kept).hexdigest(), kept)
            for i, row in enumerate(out):
                if not row:
                    own = texts[i].encode("utf-8", "surrogatepass").split() if texts[i] else []
                    kept = b" ".join(own)
                    out[i] = (ids[i], len(own), 0, hashlib.sha256(kept).hexdigest(), kept)
            if out:
                cols = list(zip(*out))
                if with_text:
                    cols[4] = [x.decode("utf-8", "replace") for x in cols[4]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields)], names=[n for n, _ in fields])

    kinds = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return docs.mapInArrow(run, kinds)


def dedup_substrings(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256 (and kept_text).

    A word goes if a window of ``window`` words covers it whose word sequence also starts in a
    document with a smaller doc_id.  Null and shorter texts keep all words (null: none).  Rows with a
    null doc_id are never smaller and are returned whole.  Rows with one doc_id don't remove each
    other's words.  Ties between more than two documents: the least doc_id keeps the words.  A very
    long text is parsed as a whole; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    spans = materialise(span_names(rows, window), "substrings-spans")
    key = ["anchor", "span", "check"]
    by_span = materialise(spans.groupBy(*key).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")), "substrings-groups")
    repeated = by_span.where("first < last").select(*key, "n", "first")
    covered = spread_join(spans, repeated, key, "n").where("doc_id > first").select("doc_id", "span")
    split = by_span.groupBy("anchor").agg(F.count("*").alias("n"), F.min("first").alias("least"), F.max("first").alias("most")).where("n > 1 AND least < most").select("anchor", "n", "least")
    unsettled = spread_join(by_span.select("anchor", "span", "first"), materialise(split, "substrings-anchors"), "anchor", "n").where("least IS NOT NULL").select(F.col("first").alias("doc_id"), "span")
    unsettled = unsettled.groupBy("doc_id").agg(F.collect_set("span").alias("spans"))
    named = materialise(window_names(rows.join(unsettled, "doc_id"), window).distinct(), "substrings-windows")
    key = ["anchor", "name", "check"]
    by_window = named.groupBy(*key).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("first < last").select(*key, "n", "first")
    late = spread_join(named, materialise(by_window, "substrings-repeats"), key, "n").where("doc_id > first").select("doc_id", "name")
    marks = covered.select("doc_id", "span", F.lit(None).cast("long").alias("name")).union(late.select("doc_id", F.lit(None).cast("long"), "name"))
    marks = marks.groupBy("doc_id").agg(F.collect_set("span").alias("spans"), F.collect_set("name").alias("windows"))
    return cut(rows.join(marks, "doc_id", "left"), window, with_text)


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, whole texts, without the passages that start in an earlier one."""
    return dedup_substrings(table(spark, sf_dir, "documents"))


QUERIES = {"op3_substrings": op3_substrings}
ORACLES: dict[str, str] = {}
