"""Queries and SQL of the training-data operators, for the driver's entry file."""

from __future__ import annotations

from importlib import import_module

MODULES = ("decontaminate", "warc", "substrings", "simhash", "packing", "secrets", "language", "licenses", "quality", "tokens")


def _gather(attr: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(import_module(f"{__package__}.{m}"), attr)
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("ORACLES")
