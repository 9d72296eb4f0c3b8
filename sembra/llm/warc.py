"""WARC records in seekable Zstandard bundles.

Each task writes one bundle: records are grouped into independent Zstandard frames, and a footer
(a skippable frame, magic 0x184D2A5E, with the sizes and a checksum of every frame) is the seek
table.  A second skippable frame before it maps record identifiers to frame, offset within the frame
and length.  The same map for all bundles is a table: one record is read by one seek and one frame.
The table names only the bundles of tasks that were committed, so a lost or repeated attempt leaves an
orphan at most; ``index_of_bundles`` makes it again from the bundles' own maps.

Equal payloads of at least ``min_bytes``: the record with the largest id is the response, the others
are revisits that refer to it.  Only digests that occur twice are looked up, by a table that Spark
broadcasts if its size allows; else texts are shuffled by digest, small payloads by id, and payloads
that very many records share don't meet in one task.
"""

from __future__ import annotations

import base64
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, open_folder, shared_path, spread_join, table

SEEK_FRAME, SEEK_FOOTER = 0x184D2A5E, 0x8F92EAB1
MAP_FRAME = 0x184D2A5D
ENTRY = struct.Struct("<?qIII")  # has an id, id, frame, offset in the frame, length
FRAME_BYTES = 1 << 18
LEVEL = 3
INDEX = "page_id long, bundle string, frame int, offset long, length long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
WHEN = "2024-01-01T00:00:00Z"


def _urn(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(urn: bytes) -> int | None:
    body = urn[10:-1]
    return int(body) if body else None


def record(page_id, url: str | None, payload: bytes, sha1_hex: str, keeper, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP head, with the full length, and no payload."""
    digest = base64.b32encode(bytes.fromhex(sha1_hex)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {WHEN}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + " ".join(url.split()))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(keeper)}"]
    block = http if revisit else http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload) of one record; checks the digest."""
    import hashlib

    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if version != b"WARC/1.1":
        raise ValueError("not a WARC record")
    named = dict(x.split(b": ", 1) for x in lines)
    block = rest[: int(named[b"Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    full = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = base64.b32decode(named[b"WARC-Payload-Digest"].removeprefix(b"sha1:")).hex()
    kind = named[b"WARC-Type"].decode()
    if kind == "response" and (len(payload) != full or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {named[b'WARC-Record-ID']!r} differs from its digest")
    refers = _page(named[b"WARC-Refers-To"]) if kind == "revisit" else None
    url = named.get(b"WARC-Target-URI")
    return _page(named[b"WARC-Record-ID"]), full, digest, kind, refers, None if url is None else url.decode(), payload if kind == "response" else None


class BundleWriter:
    """Frames of whole records, then the seek table."""

    def __init__(self, sink, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        import zstandard

        self.sink, self.frame_bytes = sink, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.parts: list[bytes] = []
        self.size = 0
        self.entries: list[tuple[int, int, int]] = []
        self.map = bytearray()

    def add(self, data: bytes, key: int | None = None) -> tuple[int, int, int]:
        """(frame, offset in the frame, length) of the record."""
        if self.size and self.size + len(data) > self.frame_bytes:
            self.flush()
        at = (len(self.entries), self.size, len(data))
        self.parts.append(data)
        self.size += len(data)
        self.map += ENTRY.pack(key is not None, key or 0, *at)
        return at

    def flush(self) -> None:
        import xxhash

        if self.size:
            raw = b"".join(self.parts)
            packed = self.zstd.compress(raw)
            self.sink.write(packed)
            self.entries.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.parts, self.size = [], 0

    def close(self) -> None:
        self.flush()
        packed = self.zstd.compress(bytes(self.map))
        self.sink.write(struct.pack("<III", MAP_FRAME, 4 + len(packed), len(self.map)) + packed)
        table_ = b"".join(struct.pack("<III", *e) for e in self.entries) + struct.pack("<IBI", len(self.entries), 0x80, SEEK_FOOTER)
        self.sink.write(struct.pack("<II", SEEK_FRAME, len(table_)) + table_)


class BundleReader:
    """Frames of a bundle by number, found through the footer."""

    def __init__(self, source):
        import zstandard

        self.source, self.zstd = source, zstandard.ZstdDecompressor()
        size = source.size()
        source.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEK_FOOTER:
            raise ValueError("no seek table")
        width = 12 if flags & 0x80 else 8
        source.seek(size - 9 - n * width)
        raw = source.read(n * width)
        self.entries, at = [], 0
        for i in range(n):
            packed, full, *check = struct.unpack_from("<III" if width == 12 else "<II", raw, i * width)
            self.entries.append((at, packed, full, check[0] if check else None))
            at += packed
        self.end = at
        self.now: tuple[int, bytes] = (-1, b"")

    def records(self) -> list[tuple[int | None, int, int, int]]:
        """(id, frame, offset, length) of every record, from the bundle's own map."""
        self.source.seek(self.end)
        magic, size, full = struct.unpack("<III", self.source.read(12))
        if magic != MAP_FRAME:
            raise ValueError("no record map")
        raw = self.zstd.decompress(self.source.read(size - 4), max_output_size=full)
        return [(key if has else None, *at) for has, key, *at in ENTRY.iter_unpack(raw)]

    def frame(self, number: int) -> bytes:
        import xxhash

        if self.now[0] != number:
            at, packed, full, check = self.entries[number]
            self.source.seek(at)
            raw = self.zstd.decompress(self.source.read(packed), max_output_size=full)
            if check is not None and xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
                raise ValueError(f"frame {number} is damaged")
            self.now = (number, raw)
        return self.now[1]


def with_roles(pages: DataFrame, min_bytes: int) -> DataFrame:
    """Adds keeper (the response's id, where a payload occurs twice) to page_id, url, html, digest, n."""
    html = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html).alias("digest"), F.octet_length(html).cast("long").alias("n"))
    twice = rows.where(F.col("n") >= min_bytes).groupBy("digest").agg(F.count("*").alias("copies"), F.max("page_id").alias("keeper")).where("copies > 1 AND keeper IS NOT NULL")
    twice = materialise(twice.select(F.col("digest").alias("key"), "keeper", "copies"), "warc-twice")
    key = F.when(F.col("n") >= min_bytes, F.col("digest")).otherwise(F.concat_ws("-", F.lit(""), "page_id", "digest"))
    return spread_join(rows.withColumn("key", key), twice, "key", "copies").drop("key")


def write_bundles(pages: DataFrame, folder: str, min_bytes: int = 1000, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Write all rows of pages (page_id, url, html) as records; the index of them, already written itself.

    Null html is an empty payload; a null url leaves the target out.  Rows with the keeper's id are
    responses all (repeated rows included); a null id is never a keeper.  An empty table writes no
    bundle; a payload longer than a frame is a frame of its own.  Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_folder(folder)
        name, writer = f"{uuid.uuid4().hex}.warc.zst", None
        for batch in batches:
            rows = []
            for x in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "keeper"))):
                if writer is None:
                    fs.create_dir(path, recursive=True)
                    sink = fs.open_output_stream(f"{path}/{name}.tmp")
                    writer = BundleWriter(sink, frame_bytes)
                page_id, url, html, digest, keeper = x
                rows.append((page_id, name, *writer.add(record(page_id, url, html, digest, keeper, keeper is not None and keeper != page_id), page_id)))
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()))], names=["page_id", "bundle", "frame", "offset", "length"])
        if writer is not None:
            writer.close()
            sink.close()
            fs.move(f"{path}/{name}.tmp", f"{path}/{name}")

    return materialise(with_roles(pages, min_bytes).mapInArrow(run, INDEX), "warc-index")


def read_records(index: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records that index names: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload."""
    kinds = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())]
    kinds = kinds if with_payload else kinds[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_folder(folder)
        name, reader, source = None, None, None
        for batch in batches:
            rows = []
            for bundle, frame, offset, length in zip(*(batch.column(c).to_pylist() for c in ("bundle", "frame", "offset", "length"))):
                if bundle != name:
                    if source is not None:
                        source.close()
                    source = fs.open_input_file(f"{path}/{bundle}")
                    name, reader = bundle, BundleReader(source)
                rows.append(parse(reader.frame(frame)[offset : offset + length])[: len(kinds)])
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), kinds)], names=[n for n, _ in kinds])
        if source is not None:
            source.close()

    return index.select("bundle", "frame", "offset", "length").mapInArrow(run, RECORD if with_payload else RECORD.rpartition(",")[0])


def index_of_bundles(spark: SparkSession, folder: str) -> DataFrame:
    """The index, from the maps in all bundles of a folder (orphans of lost attempts too)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_folder(folder)
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64())
        for batch in batches:
            for name in batch.column("name").to_pylist():
                with fs.open_input_file(f"{path}/{name}") as source:
                    rows = [(key, name, *at) for key, *at in BundleReader(source).records()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["page_id", "bundle", "frame", "offset", "length"])

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name")).mapInArrow(run, INDEX)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a record and read back from the bundles."""
    folder = shared_path(spark, "warc")
    index = write_bundles(table(spark, sf_dir, "pages"), folder)
    return read_records(index, folder, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT payload_digest, max(page_id) AS keeper FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM p LEFT JOIN k ON p.payload_digest = k.payload_digest AND payload_bytes >= 1000"""

QUERIES = {"op2_warc": op2_warc}
ORACLES = {"op2_warc": ORACLE}
