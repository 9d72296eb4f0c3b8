"""Agentic map, filter and reduce over a corpus of units."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.serialize import as_text
from ..storage import materialise, with_position
from .loop import Tool, run_agent

OPS = ("map", "filter", "reduce")
#: per_unit: one agent a unit; batched: one a shard, which answers for each unit; shared_context: one a unit, which
#: also sees a digest of the whole corpus (or the context that is given).
STRATEGIES = ("per_unit", "batched", "shared_context")
DIGEST_UNITS, DIGEST_CHARS = 20, 200
SYSTEM = {
    "map": "Work on the unit below as the instruction says and reply with the result.",
    "filter": "Decide if the unit below is kept. End with VERDICT: KEEP or VERDICT: DROP.",
    "reduce": "Combine the findings below into one answer.",
}
BLOCK = 1_000_000
UNITS = "id string, ord long, content string, metadata map<string,string>"


def normalize_ops(ops: list[str] | None) -> list[str]:
    """Known names in lower case, each once, reduce last; by default map and reduce."""
    out = [o.strip().lower() for o in (ops or ["map", "reduce"])]
    if bad := [o for o in out if o not in OPS]:
        raise ValueError(f"unknown operations {bad}")
    if len(set(out)) != len(out):
        raise ValueError("an operation is there twice")
    if "reduce" in out and out[-1] != "reduce":
        raise ValueError("reduce comes last")
    return out


@dataclass(frozen=True)
class Plan:
    ops: tuple[str, ...]
    instructions: dict[str, str]
    strategies: dict[str, str] = field(default_factory=dict)
    shard_size: int = 1


def derive_plan(task: str, ops: list[str] | None = None, lm=None, overrides: dict | None = None) -> Plan:
    """The task for every operation; a model's draft (JSON) changes it where it can be read."""
    names = normalize_ops(ops)
    plan = {"instructions": {o: task for o in names}, "strategies": {o: "per_unit" for o in names}, "shard_size": 1}
    if lm is not None:
        try:
            draft = json.loads(re.search(r"\{.*\}", lm.get_completion("Plan the operations " + ", ".join(names) + " as a JSON object with instructions, strategies and shard_size.", task), re.DOTALL)[0])
            plan["instructions"] |= {o: str(v) for o, v in dict(draft.get("instructions", {})).items() if o in names}
            plan["strategies"] |= {o: v for o, v in dict(draft.get("strategies", {})).items() if o in names and v in STRATEGIES}
            plan["shard_size"] = max(1, int(draft.get("shard_size", 1)))
        except (TypeError, ValueError, KeyError, AttributeError):
            pass
    for k, v in (overrides or {}).items():
        plan[k] = plan[k] | v if isinstance(v, dict) else v
    if bad := set(plan["strategies"].values()) - set(STRATEGIES):
        raise ValueError(f"unknown strategies {sorted(bad)}")
    return Plan(tuple(names), plan["instructions"], plan["strategies"], plan["shard_size"])


@dataclass
class Result:
    plan: Plan
    corpus: Corpus
    findings: DataFrame | None
    output: str | None


class Corpus:
    """Units in order: a DataFrame of id, ord, content, metadata."""

    def __init__(self, units: DataFrame):
        self.units = units

    @classmethod
    def from_documents(cls, spark: SparkSession, docs: list[str], ids: list[str] | None = None) -> Corpus:
        if ids is not None and len(ids) != len(docs):
            raise ValueError("as many ids as documents are needed")
        rows = [(str(ids[i]) if ids else str(i), i, d, {}) for i, d in enumerate(docs)]
        return cls(spark.createDataFrame(rows, UNITS))

    @classmethod
    def from_dataframe(cls, df: DataFrame, id_col: str, content_cols: list[str] | None = None) -> Corpus:
        """A row is a unit, its content one ``column: value`` line for each column; the order is that of the id."""
        cols = content_cols or df.columns
        lines = [F.concat(F.lit(f"{c}: "), as_text(F.col(c), df.schema[c].dataType)) for c in cols]
        return cls(df.select(F.col(id_col).cast("string").alias("id"), F.col(id_col).cast("long").alias("ord"), F.concat_ws("\n", *lines).alias("content"), F.create_map().cast("map<string,string>").alias("metadata")))

    @classmethod
    def from_files(cls, spark: SparkSession, pattern: str, recursive: bool = True) -> Corpus:
        """Files in the order of their paths; unreadable bytes are replaced."""
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(pattern)
        text = F.decode(F.col("content"), F.lit("UTF-8"))
        places = with_position(raw.select("path"), ["path"], "ord")
        return cls(raw.join(places, "path").select(F.col("path").alias("id"), "ord", text.alias("content"), F.create_map(F.lit("path"), F.col("path")).alias("metadata")))

    @classmethod
    def from_text(cls, spark: SparkSession, text: str, chunk_chars: int = 4000) -> Corpus:
        """Pieces of fixed length, one at least."""
        return cls.from_documents(spark, [text[i : i + chunk_chars] for i in range(0, len(text), chunk_chars)] or [""])

    def sample(self, n: int = 3) -> Corpus:
        return Corpus(self.units.orderBy("ord").limit(n))

    def digest(self, n: int = DIGEST_UNITS, chars: int = DIGEST_CHARS) -> str:
        """Background for agents that see one unit: how many there are, and how the first ones begin."""
        shown = self.units.orderBy("ord").limit(n).select("id", F.substring("content", 1, chars).alias("content")).collect()
        return "\n".join([f"The unit is one of {self.units.count()}.", *(f"[{r.id}] {r.content}" for r in shown)])

    def shards(self, size: int = 1) -> DataFrame:
        """Units with column shard: consecutive places by size."""
        places = with_position(self.units.select("ord", "id"), ["ord", "id"], "_place")
        return self.units.join(places, ["ord", "id"]).withColumn("shard", F.floor(F.col("_place") / size).cast("long")).drop("_place")

    def agent(self, task: str, complete: Callable, ops: list[str] | None = None, tools: list[Tool] = (), plan: Plan | None = None, contexts: dict[str, str] | None = None, max_steps: int = 6, reduce_budget: int = 50_000, lm=None) -> Result:
        """Run the operations in order; ``complete`` is the agent's completer (see run_agent)."""
        plan = plan or derive_plan(task, ops, lm)
        at, findings, output = self, None, None
        for op in plan.ops:
            context = (contexts or {}).get(op)
            if context is None and op != "reduce" and plan.strategies.get(op) == "shared_context":
                context = at.digest()
            run = {"plan": plan, "complete": complete, "tools": list(tools), "context": context, "max_steps": max_steps}
            if op == "reduce":
                source = findings if findings is not None else at.units
                output = reduce_findings(source, plan.instructions[op], complete, list(tools), max_steps, reduce_budget)
            else:
                said = run_units(at, op, **run)
                if op == "map":
                    findings = said.select("id", "ord", F.col("result").alias("content"), "trace")
                    at = Corpus(said.select("id", "ord", F.col("result").alias("content"), "metadata"))
                else:
                    kept = said.where("keep").select("id", "ord", "content", "metadata")
                    at = Corpus(kept)
                    if findings is not None:
                        findings = findings.join(kept.select("id"), "id", "left_semi")
        return Result(plan, at, findings, output)


def run_units(corpus: Corpus, op: str, plan: Plan, complete: Callable, tools: list[Tool], context: str | None, max_steps: int) -> DataFrame:
    """One agent per unit, or per batch of units (a JSON array keyed by id; what is missing keeps its content)."""
    how, instruction = plan.strategies.get(op, "per_unit"), plan.instructions[op]
    schema = UNITS + ", result string, keep boolean, trace array<struct<tool:string,arguments:string,result:string>>"
    extra = f"Context:\n{context}\n\n" if context else ""
    keep = lambda text: not re.search(r"verdict\s*:\s*drop", text, re.IGNORECASE)

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            said = [run_agent(complete, tools, SYSTEM[op], f"{extra}Instruction: {instruction}\n\nUnit {i}:\n{c}", max_steps) for i, c in zip(frame["id"], frame["content"])]
            yield frame.assign(result=[s.text for s in said], keep=[keep(s.text) for s in said], trace=[s.trace for s in said])

    def batch(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ord").drop(columns=["shard"])
        shown = json.dumps([{"id": i, "content": c} for i, c in zip(frame["id"], frame["content"])], ensure_ascii=False)
        said = run_agent(complete, tools, SYSTEM[op] + " Reply with a JSON array of {id, result}.", f"{extra}Instruction: {instruction}\n\nUnits:\n{shown}", max_steps)
        try:
            found = re.search(r"\[.*\]", said.text, re.DOTALL)
            by_id = {str(x["id"]): str(x["result"]) for x in json.loads(found[0])}
        except (TypeError, ValueError, KeyError):
            by_id = {}
        result = [by_id.get(i, c) for i, c in zip(frame["id"], frame["content"])]
        return frame.assign(result=result, keep=[keep(by_id.get(i, "")) for i in frame["id"]], trace=[said.trace] * len(frame))

    if how == "batched":
        return corpus.shards(max(2, plan.shard_size)).groupBy("shard").applyInPandas(batch, schema)
    return corpus.units.mapInPandas(each, schema)


def reduce_findings(findings: DataFrame, instruction: str, complete: Callable, tools: list[Tool], max_steps: int, budget: int) -> str:
    """One answer of all findings in order; where they exceed the budget of characters, in levels."""
    level, before = findings.select("ord", "id", "content"), None
    while True:
        level = materialise(level, "findings")
        places = with_position(level.select("ord", "id", (F.length("content") + 20).alias("n")), ["ord", "id"])
        # sizes add up within a block of places, so that no task sees all of them, and go on from the sum of the blocks before
        places = places.withColumn("_block", F.floor(F.col("_pos") / BLOCK))
        before_, at = [], 0
        for r in places.groupBy("_block").agg(F.sum("n").alias("n")).orderBy("_block").collect():
            before_.append((r._block, at))
            at += r.n
        offsets = F.broadcast(level.sparkSession.createDataFrame(before_ or [(0, 0)], "_block long, _before long"))
        size = F.sum("n").over(Window.partitionBy("_block").orderBy("_pos"))
        packs = places.join(offsets, "_block").withColumn("pack", F.floor((F.col("_before") + size - F.col("n")) / budget))
        packs = level.join(packs.select("ord", "id", "_pos", "pack"), ["ord", "id"])
        lines = F.transform(F.array_sort(F.collect_list(F.struct("_pos", "content"))), lambda x: x["content"])
        packed = packs.groupBy("pack").agg(F.min("_pos").alias("first"), lines.alias("lines"))

        def combine(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                texts = ["\n".join(f"[shard {i}] {c}" for i, c in enumerate(x)) for x in frame["lines"]]
                said = [run_agent(complete, tools, SYSTEM["reduce"], f"Instruction: {instruction}\n\nFindings:\n{t}", max_steps).text for t in texts]
                yield pd.DataFrame({"ord": frame["first"], "id": "", "content": said})

        said = materialise(packed.select("first", "lines").mapInPandas(combine, "ord long, id string, content string"), "findings")
        n = said.count()
        if n <= 1:
            got = said.first()
            return got.content if got else ""
        if before is not None and n >= before:
            raise RuntimeError("the findings don't shrink; raise the budget")
        level, before = said, n
