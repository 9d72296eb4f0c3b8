"""Long rows: cut to a token budget, or split into rows; tokens are runs of non-blank characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def n_tokens(text: Column) -> Column:
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, r"\s+", -1)))


def truncate(text: Column, budget: int) -> Column:
    """The first ``budget`` tokens and "..."; a text within the budget is unchanged."""
    if budget < 1:
        raise ValueError("the budget is at least one token")
    cut = F.array_join(F.slice(F.split(F.trim(text), r"\s+", -1), 1, budget), " ")
    return F.when(n_tokens(text) > budget, F.concat(cut, F.lit("..."))).otherwise(text)


def chunk(df: DataFrame, columns: list[str], budget: int, id_col: str | None = None) -> DataFrame:
    """Rows whose columns exceed the budget become several: the longest column in pieces, the others repeated.

    Adds chunk (from 0), chunk_column (null for whole rows).  A row whose other columns alone take the
    budget raises when it is reached.
    """
    df = df.withColumns({f"_tokens_{i}": n_tokens(F.col(c)) for i, c in enumerate(columns)})
    counts = {c: F.col(f"_tokens_{i}") for i, c in enumerate(columns)}
    total = sum((counts[c] for c in columns), F.lit(0))
    most = F.greatest(*counts.values()) if len(columns) > 1 else counts[columns[0]]
    which = F.coalesce(*[F.when(counts[c] == most, F.lit(c)) for c in columns])
    room = F.lit(budget) - (total - most)
    room = F.when(total <= budget, F.lit(budget)).when(room < 1, F.raise_error(F.lit("a document can't be fitted: its other columns fill the budget")).cast("int")).otherwise(room)
    out = df.withColumns({"_which": F.when(total > budget, which), "_room": room})
    longest = F.coalesce(*[F.when(F.col("_which") == c, F.col(c)) for c in columns])
    parts = F.split(F.trim(longest), r"\s+", -1)
    n = F.when(F.col("_which").isNull(), F.lit(1)).otherwise(F.ceil(F.size(parts) / F.col("_room")).cast("int"))
    # apart from the explode, so that a text is split once and not for each of its chunks
    out = out.withColumns({"_parts": parts, "_n": n})
    out = out.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    piece = F.array_join(F.slice("_parts", F.col("chunk") * F.col("_room") + 1, F.col("_room")), " ")
    out = out.withColumns({c: F.when(F.col("_which") == c, piece).otherwise(F.col(c)) for c in columns})
    return out.withColumn("chunk_column", F.col("_which")).drop("_which", "_room", "_parts", "_n", *[f"_tokens_{i}" for i in range(len(columns))])
