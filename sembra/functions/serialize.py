"""Rows as prompt text, by SQL expressions only."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .langex import label_of

FORMATS = ("default", "json", "xml")


def as_text(col: Column, kind: T.DataType) -> Column:
    """A value as text: True/False, whole doubles as 1.0, nested values as JSON, null as None.

    Doubles below 1e-3 keep the JVM's exponent form (1.0E-4).
    """
    if isinstance(kind, T.BooleanType):
        out = F.when(col, "True").otherwise("False")
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        whole = (col == F.floor(col)) & (F.abs(col) >= 1e7) & (F.abs(col) < 1e16)
        out = F.when(whole, F.concat(col.cast("decimal(20,0)").cast("string"), F.lit(".0"))).otherwise(col.cast("string"))
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        out = F.to_json(col)
    else:
        out = col.cast("string")
    return F.when(col.isNull(), F.lit("None")).otherwise(out)


def row_text(df: DataFrame, columns: list[str], how: str = "default", labels: dict[str, str] | None = None) -> Column:
    """The named columns of a row as one text; unknown names are left out, none gives an empty text."""
    if how not in FORMATS:
        raise ValueError(f"serialization is one of {FORMATS}")
    known = [c for c in columns if c in df.columns]
    labels = labels or {}
    value = {c: as_text(F.col(f"`{c}`"), df.schema[c].dataType) for c in known}
    name = {c: label_of(labels.get(c, c)) for c in known}
    if not known:
        return F.lit("")
    if how == "json":
        return F.to_json(F.struct(*[F.col(f"`{c}`").alias(name[c]) for c in known]), {"ignoreNullFields": "false"})
    if how == "xml":
        tag = {c: re.sub(r"\W+", "", name[c]) for c in known}
        escape = lambda x: reduce(lambda a, p: F.replace(a, F.lit(p[0]), F.lit(p[1])), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")], x)
        return F.concat(F.lit("<row>"), *[F.concat(F.lit(f"<{tag[c]}>"), escape(value[c]), F.lit(f"</{tag[c]}>")) for c in known], F.lit("</row>"))
    return F.concat(*[F.concat(F.lit(f"[{name[c]}]: «"), value[c], F.lit("»\n")) for c in known])


def joined_text(left: Column, right: Column) -> Column:
    """The text of a pair of rows."""
    return F.concat_ws("\n", left, right)


def document(text: Column, images: Column | None = None) -> Column:
    """A multimodal row: text, and images by label as base64."""
    none = F.create_map().cast("map<string,string>")
    return F.struct(text.alias("text"), (none if images is None else images).alias("image"))


def fields_of(text: str) -> dict[str, str]:
    """The labelled values of a default-format text (what a rule sees)."""
    return dict(re.findall(r"\[([^\]\n]+)\]: «(.*?)»\n?", text, re.DOTALL))
