"""From raw answers to values, by SQL expressions only."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

THINK = r"(?s)^\s*<think>(.*?)</think>\s*"
ANSWER = r"(?is)answer\s*:\s*(.*)$"


def _trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(" \n\r\t"))


def body(raw: Column) -> Column:
    """What comes after the reasoning: a think block is dropped, and text up to ``Answer:``."""
    rest = F.regexp_replace(F.coalesce(raw, F.lit("")), THINK, "")
    return _trimmed(F.when(F.rlike(rest, F.lit(ANSWER)), F.regexp_extract(rest, ANSWER, 1)).otherwise(rest))


def explanation(raw: Column) -> Column:
    """The reasoning, or null where there is none."""
    think = F.regexp_extract(raw, THINK, 1)
    before = F.regexp_extract(raw, r"(?is)^(.*?)answer\s*:", 1)
    before = F.regexp_replace(before, r"(?i)^\s*reasoning\s*:\s*", "")
    found = _trimmed(F.when(think != "", think).otherwise(before))
    return F.when(found != "", found)


def verdict(raw: Column, default: bool = True, tokens: tuple[str, str] = ("True", "False")) -> Column:
    """True or false by the first token found as a word, then as a part of a longer word; else the default.

    One-letter tokens only count as words.
    """
    text = F.lower(body(raw))
    out = None
    for pattern in (lambda t: rf"(?<!\w){re.escape(t.lower())}(?!\w)", lambda t: re.escape(t.lower()) if len(t) > 1 else r"(?!)"):
        for token, value in zip(tokens, (True, False)):
            test = F.rlike(text, F.lit(pattern(token)))
            out = F.when(test, F.lit(value)) if out is None else out.when(test, F.lit(value))
    return out.otherwise(F.lit(default))


def json_fields(raw: Column) -> Column:
    """map<string,string> of the JSON object in the answer; empty where it isn't an object."""
    found = F.regexp_extract(body(raw), r"(?s)(\{.*\})", 1)
    return F.coalesce(F.from_json(found, "map<string,string>"), F.create_map().cast("map<string,string>"))


def first_wins(raw: Column) -> Column:
    """Whether ``Document 1`` was chosen; an answer that names neither is for the first."""
    number = F.regexp_extract(body(raw), r"(?i)document\s*([12])", 1)
    return number != "2"


def keep_or_drop(raw: Column) -> Column:
    """VERDICT: KEEP or DROP; anything else keeps."""
    return ~F.rlike(F.coalesce(raw, F.lit("")), F.lit(r"(?i)verdict\s*:\s*drop"))
