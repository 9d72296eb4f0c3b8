import hashlib
import random
import re
from collections import Counter

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def edge_docs() -> list[tuple]:
    """Nulls, empty and blank texts, ties, repeated rows, a very long text."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    return [(1, ""), (2, None), (3, " \t\n "), (4, "one"), (5, "one two"), (6, "Same Text here and there"), (7, "same text here and there"), (7, "same text here and there"), (None, "same text here and there"), (9, long), (10, long + " tail"), (11, "é ñ  x\x1cy \x85 z"), (12, " ".join(f"word{i}" for i in range(90)))]


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def shared_passages(n: int, seed: int, vocabulary: list[str]) -> list[tuple]:
    rng, docs = random.Random(seed), []
    for d in range(n):
        t = []
        goal = rng.choice([0, 10, 49, 50, 51, 80, 200])
        while len(t) < goal:
            z = rng.random()
            if z < 0.3 and docs:
                src = docs[rng.randrange(len(docs))][1].split()
                a = rng.randrange(max(1, len(src)))
                t += src[a : a + rng.randint(1, 130)]
            elif z < 0.4:
                t += [rng.choice(vocabulary)] * rng.randint(1, 90)
            else:
                t += [rng.choice(vocabulary) for _ in range(rng.randint(1, 40))]
        docs.append((d, " ".join(t)))
    return docs


def substrings(docs: list[tuple], window: int) -> list[tuple]:
    split = [(d, (t or "").encode().split()) for d, t in docs]
    first: dict = {}
    for d, w in split:
        for i in range(len(w) - window + 1 if d is not None else 0):
            k = tuple(w[i : i + window])
            first[k] = min(d, first.get(k, d))
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1 if d is not None else 0):
            if first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        out.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return out


def fingerprint(text: str | None) -> int:
    import xxhash

    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near(prints: dict[int, int], distance: int = 3) -> dict[int, tuple[int, int]]:
    ids = sorted(prints)
    root = {d: d for d in ids}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    count = Counter()
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= distance:
                count[a] += 1
                count[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (count[d], find(d)) for d in ids}


KINDS = {
    "assign": (re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), 2, 12),
    "access": (re.compile("AKIA[A-Z0-9]+"), 0, 18),
    "hex": (re.compile("[0-9a-f]+"), 0, 16),
}


def secret_spans(text: str | None) -> list[tuple[int, int, str]]:
    found = [(m.start(), k, m.end(), kind) for k, (kind, (rx, group, least)) in enumerate(KINDS.items()) for m in rx.finditer(text or "") if len(m[group]) >= least]
    return [(a, b, kind) for a, _, b, kind in sorted(found)]


def quality_counts(text: str | None) -> tuple:
    t = text or ""
    w = WORD.findall(t)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), failed
