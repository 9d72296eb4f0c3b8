"""Benchmark decontamination by the q-gram lemma, diagonal bands and banded alignment.

Texts are normalised to code points: lower case, and each run of characters that are neither letter
nor digit is one blank.  A benchmark item is cut into segments of at most SEGMENT characters that
overlap by half.  If a segment of m characters occurs in a text with k edits or fewer, at least
m - q + 1 - k q of its q-grams occur in it on k + 1 neighbouring diagonals.  Shared q-grams are
counted in bands of 2 (k + 1) diagonals that overlap by half, so every such occurrence lies in one
band whole; bands that meet the bound are retained and verified by a banded alignment.

Items longer than WINDOW are also searched by windows of WINDOW characters, one each STRIDE and one
at the end, so that parts of an item are found: of a verbatim run of WINDOW + STRIDE - 1 normalised
characters or more none is missed.  Their regions count where no whole segment of the item is found.

Items are searched by the longest q-grams, of Q characters or a power of two below, for which the
bound is positive.  Items so short that no edit is allowed are found on word borders only.

The items are written to the shared folder, in blocks of about BLOCK_CHARS characters by a hash, and
never come to the driver; a task reads a block and makes a sorted table of its q-grams.  Each block is
a pass over the documents, which are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import open_folder, shared_path, table
from .tokens import slices

Q = 8
SEGMENT = 160
WINDOW, STRIDE = 64, 16
EDIT_SHARE = 0.08
SHORTEST = 1
BLOCK_CHARS = 1_400_000
BASE = np.uint64(0x9E3779B97F4A7C15)
SLICE_CHARS = 1_000_000
#: Pairs of a text's and the items' equal q-grams that are counted at a time.
MOST_PAIRS = 8_000_000
SCHEMA = "doc_id long, n_regions long, first_start long, first_end long, least_edits long, items array<long>"


def _fold_table() -> np.ndarray:
    """Code point -> lower-cased code point, or blank; characters that lower-case to more than one stay as they are."""
    out = np.full(0x110000, 32, dtype=np.uint32)
    for i in range(0x30000):
        c = chr(i)
        if c.isalnum():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


_FOLD: list[np.ndarray] = []


def normalise(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points, and the position in text of each of them."""
    if not _FOLD:
        _FOLD.append(_fold_table())
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    code = _FOLD[0][raw]
    blank = code == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    at = np.flatnonzero(keep)
    return code[at], at


def qgrams(code: np.ndarray, q: int = Q) -> np.ndarray:
    """64-bit names of all q-grams (q a power of two)."""
    h, step, base = code.astype(np.uint64) + np.uint64(1), 1, BASE
    with np.errstate(over="ignore"):
        while step < q:
            if len(h) <= step:
                return h[:0]
            h = h[:-step] * base + h[step:]
            base, step = base * base, step * 2
    return h


def _joined_script() -> np.ndarray:
    """Code points of scripts that set no blank between words, or (Hangul) join particles to them."""
    out = np.zeros(0x110000, dtype=bool)
    for a, b in ((0x0E00, 0x0EFF), (0x1000, 0x11FF), (0x1780, 0x17FF), (0x2E80, 0x9FFF), (0xA960, 0xA97F), (0xAC00, 0xD7FF), (0xF900, 0xFAFF), (0xFF66, 0xFFDC), (0x1B000, 0x1B16F), (0x20000, 0x3FFFF)):
        out[a : b + 1] = True
    return out


_JOINED = _joined_script()


def on_borders(code: np.ndarray, a: int, b: int) -> bool:
    """Neither end of code[a:b] is inside a word."""
    inside = lambda x: 0 < x < len(code) and all(c > 32 and not _JOINED[c] for c in (code[x - 1], code[x]))
    return not inside(a) and not inside(b)


class Index:
    """The q-grams of the items' segments; ``shorter`` has the items that need shorter q-grams."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, segment: int = SEGMENT, edit_share: float = EDIT_SHARE, shortest: int = SHORTEST, window: int = WINDOW, stride: int = STRIDE):
        self.q = q
        short: list[tuple[int, str]] = []
        self.segments: list[tuple[int, np.ndarray, int, int]] = []  # item, code, edits, bound
        self.windows: list[bool] = []
        self._masks: dict[int, dict[int, int]] = {}
        names, seg, pos = [], [], []
        for item, text in items:
            code = normalise(text or "")[0]
            while len(code) and code[-1] == 32:
                code = code[:-1]
            while len(code) and code[0] == 32:
                code = code[1:]
            if len(code) < max(1, shortest):
                continue
            if len(code) - q + 1 - int(edit_share * len(code)) * q < 1 and q > 1:
                short.append((item, text))
                continue
            n = 1 if len(code) <= segment else 2 * -(-len(code) // segment) - 1
            width = len(code) if n == 1 else -(-2 * len(code) // (n + 1))
            starts = [(min(i * width // 2, len(code) - width), width) for i in range(n)]
            if len(code) > window:
                starts += [(i, window) for i in range(0, len(code) - window, stride)] + [(len(code) - window, window)]
            for i, (at, size) in enumerate(starts):
                part = code[at : at + size]
                k = int(edit_share * len(part))
                bound = len(part) - q + 1 - k * q
                if bound < 1:
                    raise ValueError("the edit share is too large for the lemma")
                g = qgrams(part, q)
                names.append(g)
                seg.append(np.full(len(g), len(self.segments)))
                pos.append(np.arange(len(g)))
                self.segments.append((item, part, k, bound))
                self.windows.append(i >= n)
        self.shorter = Index(short, q // 2, segment, edit_share, shortest, window, stride) if short else None
        self.names = np.concatenate(names) if names else np.zeros(0, np.uint64)
        order = np.argsort(self.names, kind="stable")
        self.names = self.names[order]
        self.seg = np.concatenate(seg)[order].astype(np.int64) if names else np.zeros(0, np.int64)
        self.pos = np.concatenate(pos)[order].astype(np.int64) if names else np.zeros(0, np.int64)
        self.unique, self.first, self.count = np.unique(self.names, return_index=True, return_counts=True)
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[(self.names >> np.uint64(44)).astype(np.int64)] = True
        self.edits = np.array([k for _, _, k, _ in self.segments], dtype=np.int64)
        self.bounds = np.array([b for *_, b in self.segments], dtype=np.int64)
        self.least = int(self.bounds.min()) if self.segments else 0
        self.span = max((len(p) + 3 * (k + 1) for _, p, k, _ in self.segments), default=0)

    def masks(self, seg: int) -> dict[int, int]:
        """The positions of each character in a segment, as bits."""
        if seg not in self._masks:
            out: dict[int, int] = {}
            for i, c in enumerate(self.segments[seg][1].tolist()):
                out[c] = out.get(c, 0) | 1 << i
            self._masks[seg] = out
        return self._masks[seg]

    def bands(self, grams: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(segment, first and last diagonal) of the bands that meet the bound, for the q-grams of a text in order."""
        hit = np.flatnonzero(self.maybe[(grams >> np.uint64(44)).astype(np.int64)])
        slot = np.searchsorted(self.unique, grams[hit])
        slot[slot == len(self.unique)] = 0
        real = self.unique[slot] == grams[hit]
        hit, slot = hit[real], slot[real]
        # an occurrence holds bound or more hits within the longest segment plus its edits: others can't count
        reach = self.span
        near = np.searchsorted(hit, hit + reach) - np.searchsorted(hit, hit - reach)
        hit, slot = hit[near >= self.least], slot[near >= self.least]
        if not len(hit):
            return
        lo, n = self.first[slot], self.count[slot]
        total = int(n.sum())
        if total > MOST_PAIRS and len(grams) > 4 * reach:  # halves that overlap hold every occurrence whole
            half = len(grams) // 2
            yield from self.bands(grams[: half + reach])
            for i, low, high in self.bands(grams[half - reach :]):
                yield i, low + half - reach, high + half - reach
            return
        start = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(total)
        seg, diagonal = self.seg[start], np.repeat(hit, n) - self.pos[start]
        key = (diagonal // (self.edits[seg] + 1) + (1 << 30)) * len(self.segments) + seg
        cells, counts = np.unique(key, return_counts=True)
        # band b has the diagonals of cells b and b + 1
        after = np.searchsorted(cells, cells + len(self.segments))
        after[after == len(cells)] = 0
        joint = counts + np.where(cells[after] == cells + len(self.segments), counts[after], 0)
        s = cells % len(self.segments)
        full = joint >= self.bounds[s]
        for c, i in zip(cells[full].tolist(), s[full].tolist()):
            b, w = c // len(self.segments) - (1 << 30), int(self.edits[i]) + 1
            yield i, b * w, (b + 2) * w - 1


def banded(pattern: np.ndarray, text: np.ndarray, low: int, high: int, k: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of a best occurrence of pattern in text with k edits or fewer.

    Its unharmed q-grams lie on diagonals (text minus pattern position) from low to high; with k edits
    the path, its start included, leaves them by k at most.
    """
    m, n = len(pattern), len(text)
    lo, width = low - k, high - low + 1 + 2 * k
    far = m + n + 1
    offs = np.arange(width)
    j = lo + offs  # text positions before the first pattern character
    free = (j >= 0) & (j <= n)
    cost = np.where(free, 0, far)
    origin = np.where(free, j, -1)
    for i in range(m):
        at = i + lo + offs  # text position that the diagonal step reads
        ok = (at >= 0) & (at < n)
        same = np.zeros(width, dtype=bool)
        same[ok] = text[at[ok]] == pattern[i]
        step = np.where(ok, cost + ~same, far)
        skip = np.append(cost[1:] + 1, far)  # a pattern character that the text lacks
        new = np.where(skip < step, skip, step)
        org = np.where(skip < step, np.append(origin[1:], -1), origin)
        # extra text characters: new[x] = min over y <= x of new[y] + x - y
        run = np.minimum.accumulate(new - offs)
        first = np.maximum.accumulate(np.where(new - offs == run, offs, 0))
        cost, origin = run + offs, org[first]
        if cost.min() > k:
            return None
    end = m + lo + offs
    cost = np.where((end >= 0) & (end <= n) & (origin >= 0), cost, far)
    x = int(cost.argmin())
    return (int(cost[x]), int(origin[x]), int(end[x])) if cost[x] <= k else None


def _near(masks: dict[int, int], m: int, text: list[int], k: int) -> bool:
    """A pattern of m characters occurs anywhere in text with k edits or fewer (Myers' bit vectors)."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    for c in text:
        eq = masks.get(c, 0)
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score <= k:
                return True
        xv = eq | mv
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
    return False


def _verified(index: Index, code: np.ndarray, origin: np.ndarray, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(item, start, end, edits) of the bands (segment, low, high) of one text that hold an occurrence.

    The best of each segment; then, of windows that overlap none of these, the best, overlapping ones of an item joined.
    """
    whole = _best(index, code, [x for x in found if not index.windows[x[0]]])
    out = [(index.segments[s][0], a, b, e) for s, (e, a, b) in whole.items()]
    taken: dict[int, list[tuple[int, int]]] = {}
    for item, a, b, _ in out:
        taken.setdefault(item, []).append((a, b))

    def free(s: int, low: int, high: int) -> bool:
        """An occurrence between the diagonals need not overlap a region of its item."""
        item, pattern, k, _ = index.segments[s]
        return not any(high + k < b and low + len(pattern) - 2 * k > a for a, b in taken.get(item, []))

    part = _best(index, code, [x for x in found if index.windows[x[0]] and free(*x)])
    last: list | None = None
    for item, a, b, e in sorted((index.segments[s][0], a, b, e) for s, (e, a, b) in part.items()):
        if any(a < y and b > x for x, y in taken.get(item, [])):
            continue
        if last and last[0] == item and a <= last[2]:
            last[2:] = max(b, last[2]), min(e, last[3])
        else:
            out.append(last := [item, a, b, e])
    return sorted({(i, int(origin[a]), int(origin[b - 1]) + 1, e) for i, a, b, e in out if b > a})


def _best(index: Index, code: np.ndarray, found: list[tuple[int, int, int]]) -> dict[int, tuple[int, int, int]]:
    """(edits, start, end) by segment."""
    best: dict[int, tuple[int, int, int]] = {}
    for seg, low, high in found:
        _, pattern, k, _ = index.segments[seg]
        if seg in best and best[seg][0] == 0:
            continue
        hit = None
        for d in range(max(low, 0), min(high, len(code) - len(pattern)) + 1):  # exact copies need no alignment
            if code[d] == pattern[0] and np.array_equal(code[d : d + len(pattern)], pattern) and (k or on_borders(code, d, d + len(pattern))):
                hit = (0, d, d + len(pattern))
                break
        if k and not hit and _near(index.masks(seg), len(pattern), code[max(0, low - k) : max(0, high + len(pattern) + 2 * k + 1)].tolist(), k):
            hit = banded(pattern, code, low, high, k)
        if hit and (seg not in best or hit < best[seg]):
            best[seg] = hit
    return best


def regions(index: Index, text: str) -> list[tuple[int, int, int, int]]:
    """(item, start, end, edits) of verified regions, in code points of the text; see _verified."""
    return next((found for _, found in search(index, [text])), [])


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", keep_rows: bool = False, **settings) -> DataFrame:
    """Contaminated documents: doc_id, n_regions, first_start, first_end, least_edits, items.

    One row per document row with a verified region; clean rows give none.  Regions are code points
    of the text, end exclusive.  items are the distinct item ids, sorted; items without an id are
    searched like any other and named null.  Null and empty texts are clean.  Items of fewer than
    ``shortest`` letters and digits aren't searched: by default those without any; equal items are
    all named.  An empty benchmark finds nothing, an empty table gives no rows.  Repeated rows and null
    doc_ids stay.  A very long text is searched as a whole.  Other columns are ignored.
    With keep_rows, instead the rows of docs that are clean, unchanged.
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).alias("text")).where("text IS NOT NULL")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // BLOCK_CHARS))
    folder = shared_path(docs.sparkSession, "benchmark")
    items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks))).write.partitionBy("block").parquet(folder)
    if keep_rows:
        out = docs
        for b in range(blocks):
            out = _clean(out, f"{folder}/block={b}", text_col, settings)
        return out
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("rid"))
    out = reduce(DataFrame.union, [_found(rows, f"{folder}/block={b}", settings) for b in range(blocks)])
    if blocks > 1:  # a document may meet items of several blocks
        out = out.groupBy("rid", "doc_id").agg(F.sum("n_regions").alias("n_regions"), F.min(F.struct("first_start", "first_end")).alias("f"), F.min("least_edits").alias("least_edits"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")).select("doc_id", "n_regions", "f.*", "least_edits", "items")
    return out.select("doc_id", "n_regions", "first_start", "first_end", "least_edits", "items")


def read_items(folder: str) -> list[tuple[int | None, str]]:
    """(item, text) of a block, read in a worker; a block without items has no folder."""
    from pyarrow import fs as kinds
    from pyarrow import parquet

    fs, path = open_folder(folder)
    if fs.get_file_info(path).type == kinds.FileType.NotFound:
        return []
    t = parquet.read_table(path, columns=["item", "text"], filesystem=fs, partitioning=None)
    return sorted(zip(t.column("item").to_pylist(), t.column("text").to_pylist()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


def _indexed(folder: str, settings: dict) -> tuple[list[int | None], Index]:
    """The items' ids, and an index of the items by their place in that list."""
    items = read_items(folder)
    return [i for i, _ in items], Index([(n, t) for n, (_, t) in enumerate(items)], **settings)


def _found(rows: DataFrame, folder: str, settings: dict) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, index = _indexed(folder, settings)
        for batch in batches:
            out = []
            texts, ids, rids = (batch.column(c).to_pylist() for c in ("text", "doc_id", "rid"))
            for i, found in search(index, texts):
                first = min((a, e) for _, a, e, _ in found)
                items = sorted({names[x[0]] for x in found}, key=lambda n: (n is not None, n or 0))
                out.append((ids[i], len(found), *first, min(e for *_, e in found), items, rids[i]))
            if out:
                kinds = [pa.int64()] * 5 + [pa.list_(pa.int64()), pa.int64()]
                cols = ["doc_id", "n_regions", "first_start", "first_end", "least_edits", "items", "rid"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=cols)

    return rows.mapInArrow(run, SCHEMA + ", rid long")


def _clean(docs: DataFrame, folder: str, text_col: str, settings: dict) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, index = _indexed(folder, settings)
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            bad = {i for i, _ in search(index, texts)}
            yield batch.filter(pa.array([i not in bad for i in range(len(texts))], pa.bool_())) if bad else batch

    return docs.mapInArrow(run, docs.schema)


def search(index: Index, texts: list[str | None]) -> Iterator[tuple[int, list]]:
    """(position, regions) of the texts that have any."""
    found = dict(_search(index, texts))
    while index.shorter:
        index = index.shorter
        for i, more in _search(index, texts):
            found[i] = sorted(found.get(i, []) + more)
    yield from sorted(found.items())


def _search(index: Index, texts: list[str | None]) -> Iterator[tuple[int, list]]:
    """search() of the items of one length of q-grams.

    Bands are counted for a slice of texts at once: diagonals of the joined texts tell them apart,
    and a band that reaches over an end only adds a candidate.
    """
    if not index.segments:
        return
    for a, b in slices(texts, SLICE_CHARS):
        some = [(i, texts[i]) for i in range(a, b) if texts[i]]
        code, origin = normalise("\x00".join(t for _, t in some)) if some else (np.zeros(0, np.uint32), None)
        if len(code) < index.q:
            continue
        raw_ends = np.cumsum([len(t) + 1 for _, t in some])
        ends = np.searchsorted(origin, raw_ends)
        by_text: dict[int, list[tuple[int, int, int]]] = {}
        for seg, low, high in index.bands(qgrams(code, index.q)):
            first = max(0, int(np.searchsorted(ends, low, side="right")))
            last = min(len(some) - 1, int(np.searchsorted(ends, high + len(index.segments[seg][1]), side="right")))
            for x in range(min(first, last), last + 1):
                by_text.setdefault(x, []).append((seg, low, high))
        for x, found in sorted(by_text.items()):
            start, raw = (int(ends[x - 1]), int(raw_ends[x - 1])) if x else (0, 0)
            part = code[start : ends[x]]
            done = _verified(index, part, origin[start : ends[x]] - raw, [(s, lo - start, hi - start) for s, lo, hi in found])
            if done:
                yield some[x][0], done


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, whole texts, that hold a benchmark item or a part of one."""
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op1_decontaminate": op1_decontaminate}
ORACLES: dict[str, str] = {}
