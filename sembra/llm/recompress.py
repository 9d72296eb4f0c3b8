"""Local recompression: consistent symbols over word sequences, and the spans of windows they anchor.

A round names maximal runs of one symbol and then pairs (left class, right class) of neighbours.  A
name is a 64-bit digest of what it stands for, so equal content has the same name in every partition
and every round without a dictionary.  Each symbol carries the range of words that its name and its
borders depend on: neighbours that were looked at count.  A window of W words uses only symbols
whose range lies inside it, so equal windows see equal symbols wherever they stand.  The window's
anchor is the usable symbol of least rank, the leftmost of equals; consecutive windows with one
anchor form a span.  A window without a usable symbol (inside long runs) is a span of its own.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
ROUNDS = 3
B1, B2, B3 = U(0x9E3779B97F4A7C15 | 1), U(0xC2B2AE3D27D4EB4F | 1), U(0xD6E8FEB86659FD93 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def _inverse(b: int) -> int:
    return pow(b, -1, 1 << 64)


class Ranges:
    """64-bit hashes of any range of a symbol array, by wrapping prefix sums."""

    def __init__(self, x: np.ndarray, base: U = B2):
        n = len(x)
        with np.errstate(over="ignore"):
            power = np.full(n + 1, base, dtype=U)
            power[0] = 1
            power = np.cumprod(power)
            self.back = np.full(n + 1, U(_inverse(int(base))), dtype=U)
            self.back[0] = 1
            self.back = np.cumprod(self.back)
            self.sums = np.zeros(n + 1, dtype=U)
            np.cumsum(x * power[:n], out=self.sums[1:])

    def hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of x[a:b]; lengths count."""
        with np.errstate(over="ignore"):
            return mix((self.sums[b] - self.sums[a]) * self.back[a] + (b - a).astype(U) * B1)


def _round(name, lo, hi, start, doc, level):
    """One round on symbols with dependency ranges [lo, hi]; start: first word of each symbol."""
    n = len(name)
    # neighbours that are looked at; beyond a document's end that is a word outside of it
    head = np.ones(n, dtype=bool)
    head[1:] = doc[1:] != doc[:-1]
    tail = np.ones(n, dtype=bool)
    tail[:-1] = head[1:]
    # runs
    new = head.copy()
    new[1:] |= name[1:] != name[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], n) - 1
    k = last - first + 1
    left = np.where(head[first], start[first] - 1, lo[first - 1])
    nxt = np.minimum(last + 1, n - 1)
    right = np.where(tail[last], hi[last] + 1, hi[nxt])
    with np.errstate(over="ignore"):
        named = np.where(k > 1, mix(name[first] * B1 + k.astype(U) * B2 + U(2 * level + 1)), name[first])
    lo, hi, start, doc, name = np.minimum(left, lo[first]), np.maximum(right, hi[last]), start[first], doc[first], named
    n = len(name)
    head = np.ones(n, dtype=bool)
    head[1:] = doc[1:] != doc[:-1]
    tail = np.ones(n, dtype=bool)
    tail[:-1] = head[1:]
    # pairs: left class before right class, by a bit of the name that changes with the round
    with np.errstate(over="ignore"):
        is_left = (mix(name + U(level) * B2) >> U(63)) == 0
    joins = np.zeros(n, dtype=bool)
    joins[:-1] = is_left[:-1] & ~is_left[1:] & ~tail[:-1]
    second = np.zeros(n, dtype=bool)
    second[1:] = joins[:-1]
    # a left symbol looks to the right, a right symbol to the left
    before = np.where(head, start - 1, np.append(lo[:1], lo[:-1]))
    after = np.where(tail, hi + 1, np.append(hi[1:], hi[-1:]))
    lo2 = np.where(is_left, lo, np.minimum(lo, before))
    hi2 = np.where(is_left, np.maximum(hi, after), hi)
    at = np.flatnonzero(~second)
    mate = np.minimum(at + 1, n - 1)
    both = joins[at]
    with np.errstate(over="ignore"):
        out = np.where(both, mix(name[at] * B1 + name[mate] * B2 + U(2 * level + 2)), name[at])
    return out, np.where(both, lo[at], lo2[at]), np.where(both, hi[mate], hi2[at]), start[at], doc[at]


def _least(rank: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Index of the leftmost least rank in [a, b], for many ranges."""
    width = b - a + 1
    level = np.frexp(width.astype(np.float64))[1] - 1
    out = np.empty(len(a), dtype=np.int64)
    table = np.arange(len(rank))
    for k in range(int(level.max(initial=0)) + 1):
        if k:
            half = 1 << (k - 1)
            l, r = table[:-half], table[half:]
            table = np.where(rank[r] < rank[l], r, l)
        here = np.flatnonzero(level == k)
        l, r = table[a[here]], table[b[here] - (1 << k) + 1]
        out[here] = np.where(rank[r] < rank[l], r, l)
    return out


class Parse:
    """Spans of the windows of some documents.

    words: name of each word, documents one after the other; ends: past the last word of each;
    checks: second, independent names, for verification (by default there are none, and words serve).
    Arrays by span: doc (position of the document), first and last (window starts), anchor, span
    (names), check (a second digest of the span's words, by other names and another base).
    ``window_hash`` names single windows, ``window_check`` is their second digest.
    """

    def __init__(self, words: np.ndarray, ends: np.ndarray, window: int = 50, rounds: int = ROUNDS, checks: np.ndarray | None = None):
        n, self.window = len(words), window
        starts = np.append(0, ends[:-1]).astype(np.int64)
        lengths = ends - starts
        doc = np.repeat(np.arange(len(ends)), lengths)
        self.ranges, self.second = Ranges(words), Ranges(words if checks is None else checks, B3)
        pos = np.arange(n, dtype=np.int64)
        name, lo, hi, start, d = words, pos, pos.copy(), pos, doc
        for level in range(rounds if n else 0):
            name, lo, hi, start, d = _round(name, lo, hi, start, d, level)
        # windows of the documents
        per = np.maximum(lengths - window + 1, 0)
        total = int(per.sum())
        i = np.repeat(starts - (np.cumsum(per) - per), per) + np.arange(total)
        if not total:
            self.doc = self.first = self.last = np.zeros(0, np.int64)
            self.anchor = self.span = self.check = np.zeros(0, U)
            return
        key = self.ranges.hash(np.maximum(lo, 0), np.minimum(hi + 1, n))
        below = np.cumsum(np.bincount(np.maximum(lo, -1) + 1, minlength=n + 2))  # symbols with lo < i
        upto = np.cumsum(np.bincount(np.minimum(hi, n), minlength=n + 2))  # symbols with hi <= i
        a, b = below[i], upto[i + window - 1] - 1
        has = b >= a
        chosen = np.full(total, -1, dtype=np.int64)
        chosen[has] = _least(mix(key), a[has], b[has])
        new = np.ones(total, dtype=bool)
        new[1:] = (chosen[1:] != chosen[:-1]) | (chosen[1:] < 0) | (doc[i[1:]] != doc[i[:-1]])
        at = np.flatnonzero(new)
        end = np.append(at[1:], total) - 1
        self.doc, self.first, self.last = doc[i[at]], i[at], i[end]
        self.span = self.ranges.hash(self.first, self.last + window)
        self.check = self.second.hash(self.first, self.last + window)
        pick = chosen[at]
        self.anchor = np.where(pick >= 0, key[np.maximum(pick, 0)], self.span)

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(span position, window start) of all windows of the spans at these positions."""
        n = self.last[which] - self.first[which] + 1
        total = int(n.sum())
        return np.repeat(which, n), np.repeat(self.first[which] - (np.cumsum(n) - n), n) + np.arange(total)

    def window_hash(self, at: np.ndarray) -> np.ndarray:
        return self.ranges.hash(at, at + self.window)

    def window_check(self, at: np.ndarray) -> np.ndarray:
        return self.second.hash(at, at + self.window)
