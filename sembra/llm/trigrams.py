"""Boolean trigram queries from regular expressions (driver side, pure Python).

A query is in disjunctive form: a set of clauses, each a set of trigrams that all occur in every
text with a match; ``None`` means that nothing can be required, so the rule scans fully.  Trigrams
are of lower-cased ASCII, so they hold for either case.
"""

from __future__ import annotations

import re
from re import _constants as c
from re import _parser as parser

MAX_SET = 24  # strings that are followed exactly; beyond it a part of the pattern counts as anything


def _grams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def _chars(items) -> set[str] | None:
    """The lower-cased characters of a class, or None if there are many."""
    out: set[str] = set()
    for op, arg in items:
        if op is c.LITERAL:
            out.add(chr(arg).lower())
        elif op is c.RANGE and arg[1] - arg[0] < 60:
            out |= {chr(x).lower() for x in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def _simplify(q: set[frozenset[str]] | None) -> set[frozenset[str]] | None:
    if q is None or frozenset() in q:
        return None
    return {a for a in q if not any(b < a for b in q)}


def _and(p, q):
    if p is None or q is None:
        return q if p is None else p
    if len(p) * len(q) > 256:
        return p
    return _simplify({a | b for a in p for b in q})


def _or(p, q):
    return None if p is None or q is None else _simplify(p | q)


def _of_strings(strings: set[str]):
    return _simplify({_grams(s) for s in strings})


def _options(node) -> list | None:
    """For one node: alternatives, each a sequence of pieces (a string or None for anything); None if too many."""
    op, arg = node
    if op is c.LITERAL:
        return [[chr(arg).lower()]]
    if op is c.IN:
        got = _chars(arg)
        return [[None]] if got is None else [[x] for x in sorted(got)]
    if op is c.SUBPATTERN:
        return _sequence(arg[3])
    if op is c.BRANCH:
        out = []
        for branch in arg[1]:
            got = _sequence(branch)
            if got is None:
                return None
            out += got
        return out if len(out) <= MAX_SET else None
    if op in (c.MAX_REPEAT, c.MIN_REPEAT):
        low, high, body = arg
        inner = _sequence(body)
        if inner is None:
            return None
        if low == 0:
            return [[""], *inner] if high == 1 and len(inner) < MAX_SET else [[None]]
        out = [[]]
        for _ in range(min(low, 6)):
            out = [a + b for a in out for b in inner]
            if len(out) > MAX_SET:
                return [[None]]
        return [a + [None] for a in out] if high != low or low > 6 else out
    if op is c.AT:
        return [[""]]
    return [[None]]


def _sequence(pattern) -> list | None:
    out: list = [[]]
    for node in pattern:
        options = _options(node)
        if options is None or len(out) * len(options) > MAX_SET:
            options = [[None]]
        out = [a + b for a in out for b in options]
    return out


def trigram_query(pattern: str) -> set[frozenset[str]] | None:
    """Clauses of trigrams, one of which occurs in full in every text (lower-cased) that has a match."""
    q: set[frozenset[str]] | None = set()
    for pieces in _sequence(parser.parse(pattern)) or [[None]]:
        clause: frozenset[str] = frozenset()
        run = ""
        for p in [*pieces, None]:
            if p is None:
                clause |= _grams(run)
                run = ""
            else:
                run += p
        q = _or(q, {clause} if clause else None) if q is not None else None
    return q or None


def holds(query: set[frozenset[str]] | None, text: str) -> bool:
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return query is None or any(all(g in low for g in clause) for clause in query)
