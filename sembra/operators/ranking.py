"""Top-k by pairwise comparison: naive, quick, quick over vectors, heap; grouped and cascaded.

Texts stay in Spark and each round of comparisons is one barrier.  Naive is a join of a group with
itself, whose votes are counted in Spark.  The other methods keep ids and order on the driver, and compare
up to COMPARED_ROWS rows from there; larger groups are first cut by pivots in Spark, until what is left of a
part fits.  Rounds broadcast nothing, as each would pass its tables through the driver.
"""

from __future__ import annotations

import functools
import random
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..engine import Engine
from ..functions import answers
from ..functions.langex import columns_of, rendered
from ..functions.prompts import Strategy, chat, system_text
from ..functions.serialize import row_text

METHODS = ("naive", "quick", "quick-sem", "heap")
DRIVER_ROWS = 100_000
#: Rows that are compared from the driver, and of larger groups the rows among which a pivot is chosen.
COMPARED_ROWS, PIVOT_ROWS = 4_000, 500


@dataclass
class TopKStats:
    calls: int = 0
    helper_calls: int = 0
    rounds: int = 0


class _Comparer:
    """(i, j) -> whether i is better, for many pairs at once; each pair is asked once."""

    def __init__(self, engine: Engine, docs: DataFrame, instruction: str, strategy: Strategy, threshold: float | None):
        self.engine, self.docs, self.threshold = engine, docs, threshold
        self.task = f"Criterion: {rendered(instruction)}"
        self.head = [{"role": "system", "content": system_text("topk", strategy)}]
        self.stats = TopKStats()
        self.known: dict[tuple[int, int], bool] = {}

    def ask(self, both: DataFrame, n: int | None = None, pivot: int | None = None) -> DataFrame:
        """(i, j, w): for pairs of ids (__sembra_i, __sembra_j), n of them if that is known, whether the first is better.

        ``pivot``: the one id that all are compared with; its text then is a constant.
        """
        a = self.docs.select(F.col("__sembra_id").alias("__sembra_i"), F.col("__sembra_text").alias("__sembra_a"))
        shown = both.join(a.hint("merge"), "__sembra_i")
        if pivot is not None:
            shown = shown.withColumn("__sembra_b", F.lit(self.docs.where(F.col("__sembra_id") == pivot).first()["__sembra_text"]))
        else:
            b = self.docs.select(F.col("__sembra_id").alias("__sembra_j"), F.col("__sembra_text").alias("__sembra_b"))
            shown = shown.join(b.hint("merge"), "__sembra_j")
        shown = shown.withColumn("__sembra_both", F.concat(F.lit("Document 1:\n"), "__sembra_a", F.lit("\nDocument 2:\n"), "__sembra_b"))
        prompt = chat(self.head, F.col("__sembra_both"), self.task)
        first = answers.first_wins(F.col("__sembra_said.text")).alias("w")
        ids = [F.col("__sembra_i").alias("i"), F.col("__sembra_j").alias("j")]
        self.stats.rounds += 1
        if self.threshold is None:
            out = self.engine.ask(shown, prompt, merge=True).select(*ids, first)
            if n is None:
                out = self.engine.materialise(out, "compared")
                n = out.count()
            self.stats.calls += n
            return out
        # the helper's choice stands where it is sure enough
        said = self.engine.ask(shown, prompt, self.engine.helper, merge=True).select("__sembra_i", "__sembra_j", "__sembra_both", first, "__sembra_said.positive_prob")
        said = self.engine.materialise(said, "compared")
        self.stats.helper_calls += said.count()
        p = F.coalesce("positive_prob", F.lit(0.5))
        sure = F.greatest(p, 1 - p) >= self.threshold
        rest = said.where(~sure)
        self.stats.calls += rest.count()
        return said.where(sure).select(*ids, "w").union(self.engine.ask(rest.drop("w", "positive_prob"), prompt, merge=True).select(*ids, first))

    def __call__(self, pairs: list[tuple[int, int]]) -> list[bool]:
        new = [p for p in dict.fromkeys(pairs) if p not in self.known]
        if new:
            both = self.engine.spark.createDataFrame(new, "__sembra_i long, __sembra_j long")
            self.known |= {(r.i, r.j): r.w for r in self.ask(both, len(new), new[0][1] if len({j for _, j in new}) == 1 else None).collect()}
        return [self.known[p] for p in pairs]


def _narrowed(ids: DataFrame, n: int, k: int, better: _Comparer, order: Callable[[list[int], int], list[int]], seed: int) -> list[int]:
    """The k best of n ids (column id), best first; parts of more than COMPARED_ROWS are cut by a pivot in Spark.

    The pivot is one of the best of a few (one row in 64 at most), so that not many more than k ids win against it.
    """
    k = min(k, n)
    if k <= 0:
        return []
    if n <= min(COMPARED_ROWS, DRIVER_ROWS):
        return order([r[0] for r in ids.orderBy("id").collect()], k)
    some = [r[0] for r in ids.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(max(1, min(PIVOT_ROWS, DRIVER_ROWS, n // 64))).collect()]
    place = min((len(some) + 1) // 2, k * len(some) // n + 3)
    pivot = _quick(sorted(some), max(1, place), better, random.Random(seed))[-1]
    pairs = ids.where(F.col("id") != pivot).select(F.col("id").alias("__sembra_i"), F.lit(pivot).cast("long").alias("__sembra_j"))
    won = better.engine.materialise(better.ask(pairs, pivot=pivot), "pivot")
    high, low = won.where("w").select(F.col("i").alias("id")), won.where("NOT w").select(F.col("i").alias("id"))
    wins = high.count()
    top = _narrowed(high, wins, k, better, order, seed + 1)
    return top if wins >= k else [*top, pivot, *_narrowed(low, n - 1 - wins, k - wins - 1, better, order, seed + 1)]


def _naive(rows: DataFrame, k: int, better: _Comparer) -> DataFrame:
    """(__sembra_id, rank) of the k with most votes per group (columns g, id; equal votes by id), every pair being asked."""
    a, b = rows.select("g", F.col("id").alias("__sembra_i")), rows.select("g", F.col("id").alias("__sembra_j"))
    won = better.ask(a.join(b, "g").where("__sembra_i < __sembra_j").select("__sembra_i", "__sembra_j"))
    votes = won.select(F.when(F.col("w"), F.col("i")).otherwise(F.col("j")).alias("id")).groupBy("id").agg(F.count("*").alias("v"))
    order = Window.partitionBy("g").orderBy(F.desc("v"), "id")
    ranked = rows.join(votes, "id", "left").withColumn("v", F.coalesce("v", F.lit(0))).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select(F.col("id").alias("__sembra_id"), "rank")


def _quick(ids: list[int], k: int, better: Callable, rng: random.Random | None) -> list[int]:
    """The k best in order; without rng the ids are roughly ordered, and the k-th is the pivot."""
    if k <= 0 or len(ids) <= 1:
        return ids[:k]
    pivot = rng.choice(ids) if rng else ids[min(k, len(ids) // 2 if k > len(ids) - 1 else k) - 1]
    rest = [i for i in ids if i != pivot]
    wins = better([(i, pivot) for i in rest])
    high = [i for i, w in zip(rest, wins) if w]
    low = [i for i, w in zip(rest, wins) if not w]
    top = _quick(high, min(k, len(high)), better, rng)
    if len(high) >= k:
        return top
    return [*top, pivot, *_quick(low, k - len(high) - 1, better, rng)]


def _heap(ids: list[int], k: int, better: Callable) -> list[int]:
    import heapq

    return heapq.nsmallest(k, ids, key=functools.cmp_to_key(lambda a, b: -1 if better([(a, b)])[0] else 1))


def _first_order(engine: Engine, rows: DataFrame, instruction: str, sem_order: DataFrame | None) -> dict[int, int]:
    """The place of each id by similarity with the instruction, or by the scores that are given."""
    if sem_order is None:
        from .vectors import embed_column, similarity

        query = engine.embedder.embed([rendered(instruction)])[0].tolist()
        scored = embed_column(engine, rows.select("__sembra_id", "__sembra_text"), "__sembra_text").select("__sembra_id", similarity(F.col("_vec"), query).alias("score"))
    else:
        scored = sem_order.toDF("__sembra_id", "score")
    return {r[0]: i for i, r in enumerate(scored.orderBy(F.desc("score"), "__sembra_id").collect())}


def sem_topk(engine: Engine, df: DataFrame, instruction: str, K: int, method: str = "quick", id_col: str | None = None, group_by: list[str] | None = None, strategy: str | None = None, cascade_threshold: float | None = None, seed: int = 0, sem_order: DataFrame | None = None, rank_col: str | None = None, return_stats: bool = False):
    """The K best rows (per group), best first; order of equals, and of what is compared, by id_col.

    ``sem_order``: for quick-sem, (id, score) of a first ranking.  ``rank_col`` keeps the rank from 1.
    """
    if method not in METHODS:
        raise ValueError(f"method is one of {METHODS}")
    if cascade_threshold is not None and engine.helper is None:
        raise ValueError("a cascade needs a helper model")
    cols = columns_of(instruction)
    if method == "quick-sem" and len(cols) != 1:
        raise ValueError("quick-sem takes one column")
    rows = df.withColumn("__sembra_id", F.col(id_col).cast("long") if id_col else F.monotonically_increasing_id())
    rows = engine.materialise(rows.withColumn("__sembra_text", row_text(df, cols, engine.serialization)), "topk")
    groups = group_by or []
    key = F.to_json(F.struct(*groups)) if groups else F.lit("")
    narrow = engine.materialise(rows.select(key.alias("g"), F.col("__sembra_id").alias("id")), "topk-ids")
    better = _Comparer(engine, rows.select("__sembra_id", "__sembra_text"), instruction, Strategy.of(strategy), cascade_threshold)
    schema = "__sembra_id long, rank int"
    if method == "naive":
        ranked = engine.materialise(_naive(narrow, K, better), "topk-ranks")
    else:
        place: dict[int, int] = {}
        sizes = {r.g: r["count"] for r in narrow.groupBy("g").count().collect()}  # one row per group
        if method == "quick-sem" and sum(sizes.values()) <= DRIVER_ROWS:
            place = _first_order(engine, rows, instruction, sem_order)

        def order(own: list[int], k: int) -> list[int]:
            if method == "heap":
                return _heap(own, k, better)
            if place:
                return _quick(sorted(own, key=lambda i: place.get(i, len(place))), k, better, None)
            return _quick(own, k, better, random.Random(seed))

        rank = []
        every = sum(sizes.values()) <= DRIVER_ROWS  # then one look at the ids is enough
        by_group: dict[str, list[int]] = {}
        for r in narrow.orderBy("id").collect() if every else []:
            by_group.setdefault(r.g, []).append(r.id)
        for g in sorted(sizes):
            listed = every and (place or sizes[g] <= COMPARED_ROWS)
            best = order(by_group[g], min(K, sizes[g])) if listed else _narrowed(narrow.where(F.col("g") == g).select("id"), sizes[g], K, better, order, seed)
            rank += [(i, n + 1) for n, i in enumerate(best)]
        ranked = engine.spark.createDataFrame(rank, schema)
    name = rank_col or "_rank"
    out = rows.join(ranked.withColumnRenamed("rank", name), "__sembra_id").orderBy(*groups, name).drop("__sembra_id", "__sembra_text")
    out = out if rank_col else out.drop("_rank")
    return (out, better.stats) if return_stats else out
