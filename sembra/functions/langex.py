"""Instructions over named columns: ``"{Course Name} needs calculus"``, ``"{skill:right} helps in {course:left}"``."""

from __future__ import annotations

import re

_NAME = re.compile(r"(?<!\{)\{(?!\{)([^{}]+)\}(?!\})")


def columns_of(instruction: str) -> list[str]:
    """Column names in order of first appearance; ValueError where there is none."""
    found = list(dict.fromkeys(_NAME.findall(instruction)))
    if not found:
        raise ValueError(f"no {{column}} in the instruction: {instruction!r}")
    return found


def label_of(column: str) -> str:
    """The name that a prompt shows for a column."""
    return column.capitalize()


def rendered(instruction: str) -> str:
    """The instruction with each placeholder replaced by its column's label, side suffixes dropped."""
    return _NAME.sub(lambda m: label_of(side_of(m[1])[0]), instruction)


def side_of(name: str) -> tuple[str, str | None]:
    """``c:left`` -> (c, left); a name without a side has None."""
    base, sep, side = name.rpartition(":")
    return (base, side) if sep and side in ("left", "right") else (name, None)


def sides(instruction: str, left: list[str], right: list[str]) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """(placeholder, column) of each side; a name without a side must be in one frame only."""
    out: dict[str, list[tuple[str, str]]] = {"left": [], "right": []}
    for name in columns_of(instruction):
        base, side = side_of(name)
        if side is None:
            where = [s for s, cols in (("left", left), ("right", right)) if base in cols]
            if len(where) != 1:
                raise ValueError(f"{base!r} is in {'both frames' if where else 'neither frame'}; write {base}:left or {base}:right")
            side = where[0]
        elif base not in (left if side == "left" else right):
            raise ValueError(f"{base!r} is not a column of the {side} frame")
        out[side].append((name, base))
    if not out["left"] or not out["right"]:
        raise ValueError("a join instruction names columns of both frames")
    return out["left"], out["right"]
