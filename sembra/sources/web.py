"""Web search and page extraction; fetchers are plug-ins, so that offline runs use stubs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SKIPPED = {"script", "style", "noscript"}
BACKENDS: dict[str, Callable] = {}


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.depth = [], 0

    def handle_starttag(self, tag, attrs):
        self.depth += tag in SKIPPED

    def handle_endtag(self, tag):
        if tag in SKIPPED and self.depth:
            self.depth -= 1

    def handle_data(self, data):
        if not self.depth and data.strip():
            self.parts.append(data.strip())


def html_text(html: str | None, max_length: int | None = None) -> str:
    """The visible text, pieces joined by a blank; script, style and noscript are left out."""
    p = _Text()
    p.feed(html or "")
    p.close()
    return " ".join(p.parts)[:max_length]


def extract_html(df: DataFrame, html_col: str, out: str = "full_text", max_length: int | None = None) -> DataFrame:
    @F.pandas_udf("string")
    def text(s: pd.Series) -> pd.Series:
        return s.map(lambda h: html_text(h, max_length))

    return df.withColumn(out, text(F.col(html_col)))


def web_backend(name: str):
    """Register fn(query, K, start_date, end_date, sort_by_date) -> list of dicts."""

    def wrap(fn):
        BACKENDS[name] = fn
        return fn

    return wrap


@web_backend("arxiv")
def _arxiv(query: str, K: int, start_date=None, end_date=None, sort_by_date: bool = False) -> list[dict]:
    from urllib.parse import urlencode
    from urllib.request import urlopen
    from xml.etree import ElementTree

    ask = {"search_query": f"all:{query}", "max_results": K, "sortBy": "submittedDate" if sort_by_date else "relevance"}
    feed = ElementTree.fromstring(urlopen("http://export.arxiv.org/api/query?" + urlencode(ask), timeout=60).read())
    ns = {"a": "http://www.w3.org/2005/Atom"}
    take = lambda e, tag: (e.findtext(f"a:{tag}", "", ns) or "").strip()
    rows = [{"id": take(e, "id"), "url": take(e, "id"), "title": take(e, "title"), "snippet": take(e, "summary"), "date": take(e, "published")[:10]} for e in feed.findall("a:entry", ns)]
    return [r for r in rows if (not start_date or r["date"] >= str(start_date)[:10]) and (not end_date or r["date"] <= str(end_date)[:10])]


RESULT = "query string, rank int, id string, url string, title string, snippet string, date string"


def web_search(spark: SparkSession, corpus: str, query: str | list[str], K: int, cols: list[str] | None = None, sort_by_date: bool = False, start_date=None, end_date=None) -> DataFrame:
    """Up to K results per query, ranked from 1; queries are spread over tasks.  Backends other than arxiv are plug-ins."""
    if corpus not in BACKENDS:
        raise ValueError(f"no search backend {corpus!r}; known: {sorted(BACKENDS)}")
    fetch = BACKENDS[corpus]
    names = ["id", "url", "title", "snippet", "date"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for q in frame["query"]:
                for i, r in enumerate(fetch(q, K, start_date, end_date, sort_by_date)[:K]):
                    rows.append((q, i + 1, *(None if r.get(n) is None else str(r[n]) for n in names)))
            yield pd.DataFrame(rows, columns=["query", "rank", *names])

    queries = [query] if isinstance(query, str) else list(query)
    out = spark.createDataFrame([(q,) for q in queries], "query string").repartition(max(1, len(queries))).mapInPandas(run, RESULT)
    return out.select(*cols) if cols else out


def web_extract(df: DataFrame, url_col: str, fetch: Callable[[str], str] | None = None, max_length: int | None = None) -> DataFrame:
    """df with full_text of each page; a page that can't be fetched has null."""
    if fetch is None:
        from urllib.request import urlopen

        def fetch(url: str) -> str:
            return urlopen(url, timeout=60).read().decode("utf-8", "replace")

    @F.pandas_udf("string")
    def text(s: pd.Series) -> pd.Series:
        def one(u):
            try:
                return html_text(fetch(u), max_length)
            except OSError:
                return None

        return s.map(one)

    return df.withColumn("full_text", text.asNondeterministic()(F.col(url_col)))
