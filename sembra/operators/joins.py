"""Semantic joins: full, and by cascade with a choice of proxy plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cascade import CascadeArgs, draw, learn
from ..engine import Engine, operator_cache
from ..functions import answers
from ..functions.langex import rendered, sides
from ..functions.prompts import Strategy, chat, example_turns, system_text
from ..functions.serialize import joined_text, row_text
from .rowwise import sem_map
from .vectors import embed_column, similar_pairs, top_pairs

BROADCAST_ROWS = 20_000


@dataclass
class JoinStats:
    plan: str
    pos_threshold: float | None = None
    neg_threshold: float | None = None
    helper_positive: int = 0
    helper_negative: int = 0
    asked: int = 0


def _distinct(engine: Engine, df: DataFrame, names: list[tuple[str, str]], side: str) -> DataFrame:
    """The distinct values that a side shows, their text, and an id."""
    cols = [c for _, c in names]
    some = df.select(*cols).distinct()
    text = row_text(some, cols, engine.serialization)
    some = some.withColumn(f"__sembra_{side}text", text).select(*[F.col(c).alias(f"__sembra_{side}{i}") for i, c in enumerate(cols)], f"__sembra_{side}text")
    return engine.materialise(some.withColumn(f"__sembra_{side}id", F.monotonically_increasing_id()), f"join-{side}")


@operator_cache
def sem_join(engine: Engine, left: DataFrame, right: DataFrame, instruction: str, how: str = "inner", suffix: str = "_join", examples: list[dict] | None = None, strategy: str | None = None, default: bool = True, cascade: CascadeArgs | None = None, return_explanations: bool = False, return_stats: bool = False):
    """Pairs of rows whose claim is judged true; clashing columns become ``c:left`` and ``c:right``.

    Only distinct shown values are paired, so the model sees each pair of values once.  With a
    cascade and enough pairs a similarity proxy settles most of them.  ``Limits`` and ``safe_mode`` of
    the engine bound what a join may ask.
    """
    if how != "inner":
        raise NotImplementedError("semantic joins are inner joins")
    lnames, rnames = sides(instruction, left.columns, right.columns)
    strat = Strategy.of(strategy)
    l, r = _distinct(engine, left, lnames, "l"), _distinct(engine, right, rnames, "r")
    nl, nr = l.count(), r.count()
    task = f"Claim: {rendered(instruction)}"
    head = [{"role": "system", "content": system_text("filter", strat, None, ("True", "False"))}, *example_turns(examples, [c for _, c in lnames + rnames], task, strat, ("True", "False"))]
    prompt = chat(head, joined_text(F.col("__sembra_ltext"), F.col("__sembra_rtext")), task)
    verdict = answers.verdict(F.col("__sembra_said.text"), default)
    stats = JoinStats("full")
    use_cascade = cascade is not None and nl * nr >= cascade.min_join_size
    if not use_cascade:
        # each value meets each value: the smaller side goes to all tasks while its counted rows allow
        small = F.broadcast(r) if nr <= BROADCAST_ROWS else r
        judged = engine.ask(l.crossJoin(small), prompt).withColumn("__sembra_ok", verdict).withColumn("__sembra_why", answers.explanation(F.col("__sembra_said.text"))).drop("__sembra_said")
        stats.asked = nl * nr
    else:
        judged, stats = _cascade(engine, l, r, instruction, lnames, prompt, verdict, cascade)
    ok = judged.where("__sembra_ok").drop("__sembra_ok", "__sembra_ltext", "__sembra_rtext", "__sembra_lid", "__sembra_rid", "__sembra_score", "__sembra_pid")
    shared = set(left.columns) & set(right.columns)
    ls = left.select(*[F.col(c).alias(f"{c}:left" if c in shared else c) for c in left.columns])
    rs = right.select(*[F.col(c).alias(f"{c}:right" if c in shared else c) for c in right.columns])
    named = lambda c, side: f"`{c}:{side}`" if c in shared else f"`{c}`"
    out = ls.join(ok, [ls[named(c, "left")].eqNullSafe(ok[f"__sembra_l{i}"]) for i, (_, c) in enumerate(lnames)])
    out = out.join(rs, [out[f"__sembra_r{i}"].eqNullSafe(rs[named(c, "right")]) for i, (_, c) in enumerate(rnames)])
    out = out.drop(*[c for c in ok.columns if c != "__sembra_why"])
    out = out.withColumnRenamed("__sembra_why", "explanation" + suffix) if return_explanations else out.drop("__sembra_why")
    return (out, stats) if return_stats else out


def _vectors(engine: Engine, l: DataFrame, r: DataFrame, left_text: str) -> tuple[DataFrame, DataFrame]:
    """The ids and vectors of both sides."""
    side = lambda d, i, t: engine.materialise(embed_column(engine, d.select(i, F.col(t).alias("t")), "t").select(i, "_vec"), "vectors")
    return side(l, "__sembra_lid", left_text), side(r, "__sembra_rid", "__sembra_rtext")


def _learned(engine: Engine, vectors: tuple, with_text, prompt, verdict, args: CascadeArgs) -> tuple[float, float]:
    """Thresholds from pairs drawn among the highest scores; no other pair leaves its block."""
    top, n, total = top_pairs(*vectors, "__sembra_lid", "__sembra_rid", args.max_sample_range)
    chosen = draw([((x.lid, x.rid), x.score) for x in top], n, total, args)
    if not chosen:
        return learn([], args)
    some = with_text(engine.spark.createDataFrame([tuple(i) for i in chosen], "__sembra_lid long, __sembra_rid long"))
    judged = {(x[0], x[1]): x[2] for x in engine.ask(some, prompt).withColumn("__sembra_ok", verdict).select("__sembra_lid", "__sembra_rid", "__sembra_ok").collect()}
    return learn([(d.score, judged[i], d.correction, d.times) for i, d in chosen.items()], args)


def _cascade(engine: Engine, l: DataFrame, r: DataFrame, instruction: str, lnames: list, prompt, verdict, args: CascadeArgs):
    """Pairs at or below the negative threshold are counted, and never leave the block in which they are scored."""
    plans = {}
    if args.plan in (None, "map_search_filter"):
        names = {f"__sembra_l{i}": c for i, (_, c) in enumerate(lnames)}
        ask = args.map_instruction or "Write what would match " + ", ".join(f"{{{c}}}" for c in names.values()) + " under: " + rendered(instruction)
        plans["map_search_filter"] = _vectors(engine, sem_map(engine, l.withColumnsRenamed(names), ask, suffix="__sembra_mapped"), r, "__sembra_mapped")
    if args.plan in (None, "search_filter"):
        plans["search_filter"] = _vectors(engine, l, r, "__sembra_ltext")
    best = None
    with_text = lambda p: p.join(l, "__sembra_lid").join(r, "__sembra_rid")
    for name, vectors in plans.items():
        pos, neg = args.fixed or _learned(engine, vectors, with_text, prompt, verdict, args)
        pairs = similar_pairs(*vectors, "__sembra_lid", "__sembra_rid", above=neg if neg >= 0 else -2.0)
        pairs = pairs.select(F.col("lid").alias("__sembra_lid"), F.col("rid").alias("__sembra_rid"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), "score")).alias("__sembra_score"))
        pairs = engine.materialise(pairs.where((F.col("__sembra_score") > neg) | (F.col("__sembra_score") >= pos)), "scored")
        unsure = pairs.where(F.col("__sembra_score") < pos).count()
        if best is None or unsure < best[0]:  # ties go to the plan that maps first
            best = (unsure, name, pairs, pos, neg)
    unsure, name, pairs, pos, neg = best
    score = F.col("__sembra_score")
    sure = with_text(pairs.where(score >= pos)).withColumn("__sembra_ok", F.lit(True)).withColumn("__sembra_why", F.lit(None).cast("string"))
    asked = engine.ask(with_text(pairs.where(score < pos)), prompt).withColumn("__sembra_ok", verdict).withColumn("__sembra_why", answers.explanation(F.col("__sembra_said.text"))).drop("__sembra_said")
    positive = pairs.where(score >= pos).count()
    stats = JoinStats(name, pos, neg, positive, l.count() * r.count() - positive - unsure, unsure)
    return sure.unionByName(asked), stats
