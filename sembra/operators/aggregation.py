"""Hierarchical reduction of many rows to one answer, and partition ids that steer it.

Each level packs documents in order under a token budget and asks once per pack.  Packing is a scan in
order, but its state is only (pack, partition, tokens so far): token counts of a block of documents come
to one task and the next block goes on from there; texts stay in columns and are put together by SQL.
Groups are independent.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..engine import Engine, operator_cache
from ..functions import answers
from ..functions.context import chunk, n_tokens, truncate
from ..functions.langex import columns_of, rendered
from ..functions.prompts import SYSTEMS, chat
from ..functions.serialize import row_text
from ..storage import with_position

PARTITION = "_partition_id"
BLOCK = 1_000_000


def sem_partition_by(df: DataFrame, fn: Callable[[DataFrame], Column] | Column) -> DataFrame:
    """Attach partition ids: rows of one id are reduced together before ids meet."""
    return df.withColumn(PARTITION, (fn(df) if callable(fn) else fn).cast("long"))


def _packs(engine: Engine, docs: DataFrame, budget: int) -> DataFrame:
    """(_rid, _pack): greedy packs in order; a partition's end closes a pack unless a group's ids are all different.

    Only ids and token counts are scanned.  A task takes a block of BLOCK documents of a group; the next
    block of the group goes on from where it ended, so packs don't depend on blocks.  Groups run side
    by side, so there are as many rounds as the largest group has blocks.
    """
    narrow = docs.select("_g", "_rid", "_pos", "_part", n_tokens(F.col("_doc")).alias("_n"))
    narrow = with_position(narrow, ["_g", "_pos"], "_at")  # without gaps, so no block of a group is empty
    fold = narrow.groupBy("_g").agg((F.count("*") == F.count_distinct("_part")).alias("_fold"), F.min("_at").alias("_from"))
    narrow = narrow.join(fold, "_g").withColumn("_block", F.floor((F.col("_at") - F.col("_from")) / BLOCK)).drop("_from", "_at")
    rounds = narrow.agg(F.max("_block")).first()[0] or 0
    schema = "_g string, _rid long, _pos long, _pack long, _used long, _last long"

    def scan(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_pos")
        first = frame.iloc[0]
        pack, used, now = (None, 0, None) if pd.isna(first["_pack"]) else (int(first["_pack"]), int(first["_used"]), int(first["_last"]))
        packs, sums = [], []
        for pos, part, n, fold_ in zip(frame["_pos"], frame["_part"], frame["_n"], frame["_fold"]):
            if pack is None or used + n > budget or (part != now and not fold_):
                pack, used, now = pos, 0, part
            used += n
            packs.append(pack)
            sums.append(used)
        last = pd.Series(frame["_part"].to_numpy()).where(pd.Series(packs) == frame["_pos"].to_numpy()).ffill().fillna(-1 if now is None else now)
        return pd.DataFrame({"_g": frame["_g"].to_numpy(), "_rid": frame["_rid"].to_numpy(), "_pos": frame["_pos"].to_numpy(), "_pack": packs, "_used": sums, "_last": last.astype("int64")})

    done, carry = [], None
    for i in range(int(rounds) + 1):
        here = narrow.where(F.col("_block") == i)
        if carry is None:
            here = here.withColumns({c: F.lit(None).cast("long") for c in ("_pack", "_used", "_last")})
        else:
            here = here.join(carry, "_g", "left")
        out = engine.materialise(here.groupBy("_g").applyInPandas(scan, schema), "packs")
        done.append(out.select("_rid", "_pack"))
        carry = out.groupBy("_g").agg(F.max_by(F.struct("_pack", "_used", "_last"), "_pos").alias("_c")).select("_g", "_c.*")
    return reduce(DataFrame.union, done)


@operator_cache
def sem_agg(engine: Engine, df: DataFrame, instruction: str, all_cols: bool = False, suffix: str = "_output", group_by: list[str] | None = None, order_by: list[str] | None = None, budget: int | None = None, long_context: str = "chunk", response_schema: str | None = None, split_fields: bool = True, max_levels: int = 30) -> DataFrame:
    """One answer per group in column ``suffix`` (or one column per field of ``response_schema``).

    ``budget``: tokens of documents in a prompt, by default what the model's context leaves.  Longer
    documents are split ("chunk") or cut ("truncate").  An empty frame gives no rows.  A level that
    doesn't shrink raises.
    """
    if long_context not in ("chunk", "truncate"):
        raise ValueError("long_context is chunk or truncate")
    groups = group_by or []
    cols = [c for c in df.columns if c != PARTITION] if all_cols else columns_of(instruction)
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are not there")
    budget = budget or engine.lm.max_context - engine.lm.max_tokens - 200
    key = F.to_json(F.struct(*groups)) if groups else F.lit("")
    part = F.col(PARTITION) if PARTITION in df.columns else F.lit(0).cast("long")
    order = [F.col(c) for c in order_by] if order_by else [F.monotonically_increasing_id()]
    docs = df.select(key.alias("_g"), part.alias("_part"), row_text(df, cols, engine.serialization).alias("_doc"), F.struct(*order).alias("_order"))
    label_tokens = 2
    if long_context == "truncate":
        docs = docs.withColumn("_doc", truncate(F.col("_doc"), budget - label_tokens))
        docs = docs.withColumn("chunk", F.lit(0))
    else:
        docs = chunk(docs, ["_doc"], budget - label_tokens)
    docs = engine.materialise(docs.withColumn("_rid", F.monotonically_increasing_id()), "agg")
    place = with_position(docs.select("_g", "_part", "_order", "chunk", "_rid"), ["_g", "_part", "_order", "chunk"])
    docs = docs.select("_g", "_part", "_doc", "_rid").join(place.select("_rid", "_pos"), "_rid")
    keys = engine.materialise(df.select(key.alias("_g"), *groups).distinct(), "agg-keys") if groups else None
    task = f"Instruction: {rendered(instruction) if not all_cols else instruction}"
    head = [{"role": "system", "content": SYSTEMS["agg"]}]
    done, level = None, 0
    before = None
    while True:
        docs = engine.materialise(docs, "agg-level")
        word = "Document" if level == 0 else "Source"
        packed = docs.join(_packs(engine, docs, budget), "_rid")
        place = F.row_number().over(Window.partitionBy("_g", "_pack").orderBy("_pos"))
        packed = packed.withColumn("_line", F.concat(F.lit(f"{word} "), place.cast("string"), F.lit(": "), "_doc"))
        lines = F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_line"))), lambda x: x["_line"])
        prompts = packed.groupBy("_g", "_pack").agg(F.array_join(lines, "\n").alias("_text"), F.min(F.struct("_pos", "_part"))["_part"].alias("_part"))
        said = engine.ask(prompts, chat(head, F.col("_text"), task)).select("_g", F.col("_pack").alias("_pos"), F.col("_pack").alias("_rid"), "_part", F.coalesce("__sembra_said.text", F.lit("")).alias("_doc"))
        said = engine.materialise(said, "agg-said")
        n = said.groupBy("_g").agg(F.count("*").alias("_n"))
        single = said.join(n.where("_n = 1"), "_g", "left_semi").select("_g", "_doc")
        done = single if done is None else done.unionByName(single)
        docs = said.join(n.where("_n > 1"), "_g", "left_semi")
        left = docs.count()
        if not left:
            break
        if before is not None and left >= before or level >= max_levels:
            raise RuntimeError("the answers of a level don't fit fewer prompts than the level had")
        before, level = left, level + 1
    value = answers.body(F.col("_doc"))
    if response_schema:
        parsed = F.from_json(F.regexp_extract(value, r"(?s)(\{.*\})", 1), response_schema)
        out = done.withColumn(suffix, parsed)
        if split_fields:
            out = out.select("_g", f"{suffix}.*")
    else:
        out = done.select("_g", value.alias(suffix))
    return out.join(keys, "_g").drop("_g") if groups else out.drop("_g")
