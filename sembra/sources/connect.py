"""Tables from databases, object stores and folders; sinks are DataFrame writers."""

from __future__ import annotations

import json
import re
import sqlite3
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FORMATS = ("csv", "json", "parquet", "txt", "xlsx")


def _connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _kind(found: set[str]) -> str:
    """The Spark type that holds values of these SQLite types without loss."""
    found = found - {"null"}
    return "bigint" if found == {"integer"} else "double" if found and found <= {"integer", "real"} else "binary" if found == {"blob"} else "string"


class SqliteSource(DataSource):
    """``spark.read.format("sqlite")``: options path and query, or path and table with partitions (rowid ranges).

    Types come from all values, by one aggregate over SQLite's ``typeof``, so that none is lost: a
    column of integers and reals is double, one of numbers and texts is string.  A given schema is kept;
    a value that it can't hold raises.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        con = _connect(self.options["path"])
        query = _query(self.options)
        names = [c[0] for c in con.execute(f"SELECT * FROM ({query}) LIMIT 0").description]
        quoted = ['"' + n.replace('"', '""') + '"' for n in names]
        kinds = con.execute("SELECT " + ", ".join(f"group_concat(DISTINCT typeof({q}))" for q in quoted) + f" FROM ({query})").fetchone()
        con.close()
        return ", ".join(f"`{n}` {_kind(set((k or '').split(',')) - {''})}" for n, k in zip(names, kinds))

    def reader(self, schema) -> DataSourceReader:
        return _SqliteReader(self.options, schema)


def _query(options) -> str:
    if options.get("query"):
        return options["query"]
    return 'SELECT * FROM "' + options["table"].replace('"', '""') + '"'


class _Range(InputPartition):
    def __init__(self, low: int | None = None, high: int | None = None):
        self.low, self.high = low, high


class _SqliteReader(DataSourceReader):
    def __init__(self, options, schema):
        self.options, self.kinds, self.names = dict(options), [f.dataType.typeName() for f in schema], [f.name for f in schema]

    def partitions(self) -> list[InputPartition]:
        n = int(self.options.get("partitions", 1))
        if n < 2 or not self.options.get("table"):
            return [_Range()]
        con = _connect(self.options["path"])
        low, high = con.execute('SELECT min(rowid), max(rowid) FROM "' + self.options["table"].replace('"', '""') + '"').fetchone()
        con.close()
        if low is None:
            return [_Range()]
        step = -(-(high - low + 1) // n)
        return [_Range(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def _value(self, v, kind: str, name: str):
        if v is None or kind == "string" and isinstance(v, str) or kind == "binary" and isinstance(v, bytes):
            return v
        try:
            if kind == "long" and int(v) == v:
                return int(v)
            if kind == "double" and not isinstance(v, str) and float(v) == v:
                return float(v)
            if kind == "string" and not isinstance(v, bytes):
                return repr(v) if isinstance(v, float) else str(v)
        except (TypeError, ValueError):
            pass
        raise ValueError(f"column {name!r} is declared {kind} and can't hold {v!r}")

    def read(self, partition) -> Iterator[tuple]:
        con = _connect(self.options["path"])
        query = _query(self.options)
        if partition.low is not None:
            query += f" WHERE rowid >= {partition.low} AND rowid < {partition.high}"
        for row in con.execute(query):
            yield tuple(self._value(v, k, n) for v, k, n in zip(row, self.kinds, self.names))
        con.close()


def load_from_db(spark: SparkSession, url: str, query: str | None = None, schema: str | None = None, table: str | None = None, partitions: int = 1, **options) -> DataFrame:
    """The rows of a query or a table: ``sqlite:///path`` by the source above, any other JDBC url by its driver.

    ``partitions`` reads a SQLite table by ranges of its rowid.
    """
    if (query is None) == (table is None):
        raise ValueError("a query or a table is needed")
    if url.startswith("sqlite:///"):
        spark.dataSource.register(SqliteSource)
        reader = spark.read.format("sqlite").option("path", url.removeprefix("sqlite:///")).option("partitions", partitions)
        reader = reader.option("query", query) if query else reader.option("table", table)
        return (reader.schema(schema) if schema else reader).load()
    jdbc = url if url.startswith("jdbc:") else "jdbc:" + url
    reader = spark.read.format("jdbc").option("url", jdbc).options(**options)
    return (reader.option("query", query) if query else reader.option("dbtable", table)).load()


def load_files(spark: SparkSession, path: str, kind: str | None = None, schema: str | None = None, **options) -> DataFrame:
    """csv, json, parquet, txt (tabs) or xlsx, from any file system that Spark reads (s3a://, hdfs://, file)."""
    kind = (kind or path.rpartition(".")[2]).lower()
    if kind not in FORMATS:
        raise ValueError(f"format is one of {FORMATS}")
    if kind == "xlsx":
        return _load_xlsx(spark, path, schema, options)
    reader = spark.read.schema(schema) if schema else spark.read
    if kind in ("csv", "txt"):
        return reader.options(**{"header": True, "inferSchema": schema is None, "sep": "\t" if kind == "txt" else ",", **options}).csv(path)
    return reader.options(**options).format(kind).load(path)


def read_xlsx(data: bytes, **options) -> pd.DataFrame:
    """One workbook, by the library that pandas finds; replace it in XLSX where there is another."""
    import io

    return pd.read_excel(io.BytesIO(data), **options)


XLSX: list = [read_xlsx]


def _load_xlsx(spark: SparkSession, path: str, schema: str | None, options: dict) -> DataFrame:
    """All workbooks of a folder or glob; without a schema, all are read once for their columns, and these for the types."""
    raw = spark.read.format("binaryFile").load(path).select("content")
    read = XLSX[0]

    def lines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for data in frame["content"]:
                book = read(bytes(data), **options)
                book.columns = [str(c) for c in book.columns]
                yield pd.DataFrame({"line": [json.dumps({k: None if pd.isna(v) else v.item() if hasattr(v, "item") else v if isinstance(v, (bool, int, float, str)) else str(v) for k, v in r.items()}) for r in book.to_dict("records")]}, dtype=object)

    text = raw.mapInPandas(lines, "line string")
    if schema is None:
        schema = spark.read.json(text.rdd.map(lambda r: r[0])).schema
    return text.select(F.from_json("line", schema).alias("row")).select("row.*")


def s3_options(spark: SparkSession, key: str, secret: str, endpoint: str | None = None) -> None:
    """Access to an S3-compatible store for s3a:// paths of this session."""
    conf = spark._jsc.hadoopConfiguration()
    conf.set("fs.s3a.access.key", key)
    conf.set("fs.s3a.secret.key", secret)
    if endpoint:
        conf.set("fs.s3a.endpoint", endpoint)
        conf.set("fs.s3a.path.style.access", "true")


#: Extension -> bytes to pages of text; add parsers for further formats.
PARSERS: dict = {}


def parser(*extensions: str):
    def wrap(fn):
        PARSERS.update({e: fn for e in extensions})
        return fn

    return wrap


@parser("txt", "md", "csv", "json", "py", "log")
def _plain(data: bytes) -> list[str]:
    return [data.decode("utf-8", "replace")]


@parser("html", "htm")
def _html(data: bytes) -> list[str]:
    from .web import html_text

    return [html_text(data.decode("utf-8", "replace"))]


@parser("ipynb")
def _notebook(data: bytes) -> list[str]:
    cells = json.loads(data).get("cells", [])
    return ["".join(c["source"]) if isinstance(c["source"], list) else c["source"] for c in cells if c.get("source")]


@parser("docx", "pptx", "epub")
def _zipped_xml(data: bytes) -> list[str]:
    """Text runs of Office files and the pages of an EPUB, in the order of the parts' names."""
    import io
    import zipfile
    from xml.etree import ElementTree

    pages = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        numbered = lambda n: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", n)]
        for name in sorted(z.namelist(), key=numbered):
            if re.fullmatch(r"word/document\.xml|ppt/slides/slide\d+\.xml", name):
                root = ElementTree.fromstring(z.read(name))
                paragraphs = [p for p in root.iter() if p.tag.endswith("}p")]
                pages.append("\n".join(t for t in ("".join(x.text or "" for x in p.iter() if x.tag.endswith("}t")) for p in paragraphs) if t))
            elif name.endswith((".xhtml", ".html", ".htm")):
                pages += _html(z.read(name))
    return pages


class DirectoryReader:
    """Files and folders as rows: content, path, page, chunk."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.recursive = spark, [], True
        self.urls: list[str] = []
        self.fetch = None

    def add_file(self, path: str) -> DirectoryReader:
        self.paths.append(path)
        return self

    def add_dir(self, path: str, recursive: bool = True) -> DirectoryReader:
        self.recursive = recursive
        return self.add_file(path)

    def add_multiple(self, paths: list[str]) -> DirectoryReader:
        return self.add(*paths)

    def add_url(self, url: str, fetch=None) -> DirectoryReader:
        """A page that is fetched by the task that parses it; its path is the address."""
        self.urls.append(url)
        self.fetch = fetch or self.fetch
        return self

    def add(self, *paths: str) -> DirectoryReader:
        for p in paths:
            self.add_file(p)
        return self

    def to_df(self, per_page: bool = True, chunk_tokens: int | None = None, overlap: int = 50) -> DataFrame:
        """One row per page (or file); with chunk_tokens, per chunk, neighbours sharing ``overlap`` tokens.

        A file that has no parser or can't be parsed gives one row with a null content and an error.
        """
        known, fetch = dict(PARSERS), self.fetch
        raw = None
        if self.paths:
            raw = self.spark.read.format("binaryFile").option("recursiveFileLookup", str(self.recursive).lower()).load(self.paths).select("path", "content")
        if self.urls:
            pages = self.spark.createDataFrame([(u, None) for u in self.urls], "path string, content binary").repartition(len(self.urls))
            raw = pages if raw is None else raw.union(pages)
        if raw is None:
            raise ValueError("nothing was added")

        def body(path: str, data) -> tuple[str, bytes]:
            """(kind, bytes); pages are fetched here."""
            if data is not None:
                return path.rpartition(".")[2].lower(), bytes(data)
            if fetch is not None:
                got = fetch(path)
            else:
                from urllib.request import urlopen

                got = urlopen(path, timeout=60).read()
            last = path.rpartition("/")[2].partition("?")[0]
            kind = last.rpartition(".")[2].lower() if "." in last else "html"
            return kind if kind in known else "html", got.encode() if isinstance(got, str) else got

        def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                rows = []
                for path, data in zip(frame["path"], frame["content"]):
                    try:
                        kind, got = body(path, data)
                        pages = known[kind](got)
                        pages = pages if per_page else ["\n".join(pages)]
                        rows += [(path, i, p, None) for i, p in enumerate(pages)]
                    except Exception as wrong:
                        rows.append((path, 0, None, f"{type(wrong).__name__}: {wrong}"))
                yield pd.DataFrame(rows, columns=["path", "page", "content", "error"])

        out = raw.mapInPandas(parse, "path string, page int, content string, error string")
        if chunk_tokens:
            step = chunk_tokens - overlap
            if step < 1:
                raise ValueError("the overlap is smaller than a chunk")
            out = out.withColumn("_t", F.split(F.trim(F.coalesce("content", F.lit(""))), r"\s+", -1))
            last = F.greatest(F.lit(0), F.ceil((F.size("_t") - overlap) / step).cast("int") - 1)
            out = out.withColumn("chunk", F.explode(F.sequence(F.lit(0), last)))
            out = out.withColumn("content", F.when(F.col("content").isNotNull(), F.array_join(F.slice("_t", F.col("chunk") * step + 1, chunk_tokens), " "))).drop("_t")
        return out
