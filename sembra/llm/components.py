"""Connected components by alternating large-star and small-star rounds, without any per-group list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, materialise

#: Pairs of one node below which it is not worth to split them.
HOT_PAIRS = 1_000_000


def _meet(pairs: DataFrame, least: DataFrame, hot: DataFrame | None) -> DataFrame:
    """pairs join least by a; nodes in ``hot`` (few by definition) are broadcast, so that their pairs stay where they are."""
    if hot is None:
        return pairs.join(least, "a")
    few = F.broadcast(least.join(F.broadcast(hot), "a", "left_semi"))
    return pairs.join(few, "a").union(pairs.join(F.broadcast(hot), "a", "left_anti").join(least, "a"))


def _large_star(pairs: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return _meet(both.where("b > a"), least, hot).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    down = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(pairs: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the undirected pairs; root is the least node of its component.

    Pairs may repeat, come in either direction and hold self-loops (dropped).  No pairs: no rows.
    Each round is written to the shared folder; a round that changes nothing ends the loop.  Roots
    that gather more than HOT_SHARE of the pairs don't gather them in one task.
    """
    at = pairs.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    at = materialise(at, "cc")
    before = None
    for _ in range(max_rounds):
        by_root = at.groupBy("b").agg(F.count("*").alias("n"), F.sum(F.hash("a", "b").cast("long")).alias("s"), F.bit_xor(F.xxhash64("a", "b")).alias("x"))
        *sign, most = by_root.agg(F.coalesce(F.sum("n"), F.lit(0)), F.sum("s"), F.bit_xor("x"), F.coalesce(F.max("n"), F.lit(0))).first()
        if sign == before or sign[0] == 0:
            break
        before = sign
        hot = by_root.where(F.col("n") > max(HOT_PAIRS, HOT_SHARE * sign[0])).select(F.col("b").alias("a")) if most > max(HOT_PAIRS, HOT_SHARE * sign[0]) else None
        at = materialise(_small_star(_large_star(at, hot)), "cc")
    else:
        raise RuntimeError("components did not settle")
    return at.select(F.col("a").alias("node"), F.col("b").alias("root")).union(at.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
