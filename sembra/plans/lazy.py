"""Lazy plans of semantic and relational operators, their rewrites, and plan documents in JSON.

A relational filter is a SQL predicate, so what it reads is known and it can be moved; a model step is
only a name and arguments until the plan runs.  Equal sub-plans run once.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cascade import CascadeArgs
from ..engine import Engine
from ..functions.langex import columns_of
from ..storage import materialise

#: Arguments that are instructions.
TEXTS = ("instruction", "system_prompt", "extra_instructions")
#: Steps that ask a model, and the columns that they add.
MODEL_STEPS = ("sem_map", "sem_filter", "sem_extract", "sem_agg", "sem_topk", "sem_join", "llm_as_judge", "pairwise_judge")
RELATIONAL = ("filter", "select", "with_columns", "rename", "drop", "group_by", "distinct", "sort", "limit", "join", "union", "explode", "sql", "window")


@dataclass(frozen=True)
class Step:
    op: str
    args: dict
    inputs: tuple[Step, ...] = ()
    tuned: tuple[str, ...] | None = None  # the parameters that an optimiser may change; None: all

    def document(self) -> dict:
        plain = {k: v.document() if isinstance(v, CascadeArgs) else v for k, v in self.args.items()}
        return {"op": self.op, "args": plain, "inputs": [i.document() for i in self.inputs], **({"tuned": list(self.tuned)} if self.tuned is not None else {})}

    @classmethod
    def of(cls, doc: dict) -> Step:
        args = {k: CascadeArgs.of(v) if isinstance(v, dict) and "__cascade__" in v else v for k, v in doc["args"].items()}
        return cls(doc["op"], args, tuple(cls.of(d) for d in doc["inputs"]), None if doc.get("tuned") is None else tuple(doc["tuned"]))

    def parameters(self) -> dict[str, str]:
        """What an optimiser may change, by name: instructions, field descriptions, and those of a cascade (``cascade.x``)."""
        out: dict[str, str] = {}
        for k, v in self.args.items():
            if k in TEXTS and isinstance(v, str):
                out[k] = v
            elif k == "output_cols":
                out.update({f"output_cols[{c!r}]": d for c, d in v.items() if d})
            elif isinstance(v, CascadeArgs):
                own = self.args.get("instruction", "")
                if self.op in ("sem_filter", "pairwise_judge") and v.proxy == "helper":
                    out[f"{k}.helper_instruction"] = v.helper_instruction or own
                if self.op == "sem_join" and v.plan in (None, "map_search_filter"):
                    out[f"{k}.map_instruction"] = v.map_instruction or own
        return out if self.tuned is None else {k: v for k, v in out.items() if k in self.tuned}

    def patched(self, values: dict[str, str]) -> Step:
        args = dict(self.args)
        for name, v in values.items():
            head, dot, inner = name.partition(".")
            if m := re.fullmatch(r"output_cols\['(.*)'\]", name):
                args["output_cols"] = args["output_cols"] | {m[1]: v}
            elif dot and isinstance(args.get(head), CascadeArgs):
                args[head] = replace(args[head], **{inner: v})
            elif name in args:
                args[name] = v
        return replace(self, args=args)

    @property
    def fingerprint(self) -> str:
        return hashlib.sha256(json.dumps(self.document(), sort_keys=True, default=repr).encode()).hexdigest()

    def __hash__(self):
        return hash(self.fingerprint)

    def adds(self) -> set[str] | None:
        """Columns that the step makes; None if it changes rows or columns otherwise."""
        a = self.args
        if self.op == "sem_filter":
            if a.get("return_all"):
                return {a.get("suffix", "_filter")} | self._notes(a, "_filter")
            return self._notes(a, "_filter")
        if self.op == "sem_map":
            return {a.get("suffix", "_map")} | self._notes(a, "_map") | {"explanation" + a.get("suffix", "_map")}
        if self.op == "sem_extract":
            return {*a["output_cols"], *(f"{c}_quote" for c in a["output_cols"]), "raw_output", "explanation"}
        if self.op == "llm_as_judge":
            s = a.get("suffix", "_judge")
            return {f"{p}{s}_{t}" for p in ("", "raw_output", "explanation") for t in range(a.get("n_trials", 1))}
        if self.op == "with_columns":
            return set(a["exprs"])
        return None

    @staticmethod
    def _notes(a: dict, suffix: str) -> set[str]:
        s = a.get("suffix", suffix)
        return ({"explanation" + s} if a.get("return_explanations") else set()) | ({"raw_output" + s} if a.get("return_raw_outputs") else set())


def columns_read(predicate: str) -> set[str]:
    """The column names of a SQL predicate (anything that looks like one)."""
    bare = re.sub(r"'(?:[^'\\]|\\.|'')*'", "", predicate)
    return {m[0] or m[1] for m in re.findall(r"`([^`]+)`|([A-Za-z_]\w*)", bare)}


def push_filters(step: Step) -> Step:
    """Relational filters below model steps (filter, map, extract, judge) whose new columns they don't read."""
    step = replace(step, inputs=tuple(push_filters(i) for i in step.inputs))
    if step.op == "filter" and step.inputs:
        below = step.inputs[0]
        made = below.adds() if below.op in MODEL_STEPS else None
        if made is not None and not below.args.get("return_stats") and not made & columns_read(step.args["predicate"]) and not re.search(r"\b(rand|randn|uuid|monotonically_increasing_id)\b", step.args["predicate"]):
            inner = push_filters(Step("filter", step.args, below.inputs))
            return replace(below, inputs=(inner,))
    return step


def order_model_filters(step: Step, cost: Callable[[Step], float]) -> Step:
    """Neighbouring model filters, the one of lower cost first (rank by (selectivity - 1) / cost, say)."""
    step = replace(step, inputs=tuple(order_model_filters(i, cost) for i in step.inputs))
    if step.op == "sem_filter" and step.inputs and step.inputs[0].op == "sem_filter":
        below = step.inputs[0]
        free = not below.args.get("return_all") and not step.args.get("return_all")
        if free and cost(step) < cost(below):
            return replace(below, inputs=(order_model_filters(replace(step, inputs=below.inputs), cost),))
    return step


def pull_above_joins(step: Step) -> Step:
    """A model filter on one input of a relational inner join goes above it, so that it sees only joined rows."""
    step = replace(step, inputs=tuple(pull_above_joins(i) for i in step.inputs))
    if step.op == "join" and step.args.get("how", "inner") == "inner":
        left, right = step.inputs
        if left.op == "sem_filter" and not left.adds() and not left.args.get("return_all"):
            return replace(left, inputs=(replace(step, inputs=(left.inputs[0], right)),))
    return step


class LazyFrame:
    """A plan; methods return new plans."""

    def __init__(self, step: Step | None = None, name: str = "input"):
        self.step = step or Step("source", {"name": name})

    def _then(self, op: str, *others: LazyFrame, **args) -> LazyFrame:
        return LazyFrame(Step(op, args, (self.step, *(o.step for o in others))))

    def filter(self, predicate: str) -> LazyFrame:
        return self._then("filter", predicate=predicate)

    def select(self, *exprs: str) -> LazyFrame:
        return self._then("select", exprs=list(exprs))

    def with_columns(self, **exprs: str) -> LazyFrame:
        return self._then("with_columns", exprs=exprs)

    def rename(self, **names: str) -> LazyFrame:
        return self._then("rename", names=names)

    def drop(self, *cols: str) -> LazyFrame:
        return self._then("drop", cols=list(cols))

    def group_by(self, *keys: str, sets: str | list[list[str]] | None = None, **aggs: str) -> LazyFrame:
        """``sets``: rollup, cube, or the grouping sets as a list of lists of keys; aggregates are SQL, registered UDAFs too."""
        return self._then("group_by", keys=list(keys), aggs=aggs, sets=sets)

    def table_function(self, name: str, *args: str) -> LazyFrame:
        """The rows that a registered table function makes of each row (LATERAL), beside the row."""
        return self._then("lateral", fn=name, args=list(args))

    def distinct(self, *cols: str) -> LazyFrame:
        return self._then("distinct", cols=list(cols))

    def sort(self, *exprs: str) -> LazyFrame:
        return self._then("sort", exprs=list(exprs))

    def limit(self, n: int, offset: int = 0) -> LazyFrame:
        return self._then("limit", n=n, offset=offset)

    def join(self, other: LazyFrame, on: list[str], how: str = "inner") -> LazyFrame:
        return self._then("join", other, on=on, how=how)

    def concat(self, other: LazyFrame, how: str = "union") -> LazyFrame:
        """union (all columns, by name), intersect, except; distinct variants by ``distinct``."""
        return self._then("union", other, how=how)

    def concat_columns(self, other: LazyFrame, order: list[str], other_order: list[str]) -> LazyFrame:
        """Rows of both side by side, by their place in the orders; where one is shorter its columns are null."""
        return self._then("beside", other, order=order, other_order=other_order)

    @classmethod
    def from_fn(cls, name: str, *inputs: LazyFrame, **args) -> LazyFrame:
        """A registered function of (engine, *frames, **args)."""
        return cls(Step("apply", {"fn": name, "args": args}, tuple(i.step for i in inputs)))

    def explode(self, col: str, alias: str | None = None) -> LazyFrame:
        return self._then("explode", col=col, alias=alias or col)

    def sql(self, query: str, **views: LazyFrame) -> LazyFrame:
        """A query over ``{this}`` and named plans."""
        return LazyFrame(Step("sql", {"query": query, "views": ["this", *views]}, (self.step, *(v.step for v in views.values()))))

    def apply(self, name: str, **args) -> LazyFrame:
        """A registered function of (engine, df, **args)."""
        return self._then("apply", fn=name, args=args)

    def __getattr__(self, op: str):
        if op not in (*MODEL_STEPS, *FUNCTIONS):
            raise AttributeError(op)

        def call(*others: LazyFrame, **args) -> LazyFrame:
            if op in ("sem_map", "sem_filter", "sem_topk"):
                columns_of(args["instruction"])
            return self._then(op, *others, **args)

        return call

    # plans as documents

    def to_json(self) -> str:
        return json.dumps(self.step.document(), indent=1)

    @classmethod
    def from_json(cls, text: str) -> LazyFrame:
        return cls(Step.of(json.loads(text)))

    def save(self, path: str) -> None:
        with open(path, "w") as f:
            f.write(self.to_json())

    @classmethod
    def load(cls, path: str) -> LazyFrame:
        with open(path) as f:
            return cls.from_json(f.read())

    def tree(self) -> str:
        def lines(s: Step, depth: int) -> list[str]:
            return ["  " * depth + s.op + " " + json.dumps(s.args, default=repr)[:100], *(x for i in s.inputs for x in lines(i, depth + 1))]

        return "\n".join(lines(self.step, 0))

    # rewriting and running

    def parameters(self) -> dict[str, str]:
        """Instructions in the plan, by path: what a prompt optimiser may change."""
        out: dict[str, str] = {}

        def walk(s: Step, at: str) -> None:
            out.update({f"{at}.{k}": v for k, v in s.parameters().items()})
            for n, i in enumerate(s.inputs):
                walk(i, f"{at}/{n}")

        walk(self.step, "")
        return out

    def patched(self, values: dict[str, str]) -> LazyFrame:
        """A plan with other parameters, by path (steps by input numbers from the last one, then the parameter)."""

        def walk(s: Step, at: str) -> Step:
            own = {path[len(at) + 1 :]: v for path, v in values.items() if path.startswith(at + ".")}
            return replace(s.patched(own), inputs=tuple(walk(i, f"{at}/{n}") for n, i in enumerate(s.inputs)))

        return LazyFrame(walk(self.step, ""))

    def mark_optimizable(self, *params: str) -> LazyFrame:
        """Let an optimiser change only these parameters of the last step (none: leave the step alone)."""
        known = replace(self.step, tuned=None).parameters()
        if unknown := [p for p in params if p not in known and p not in self.step.args]:
            raise ValueError(f"{self.step.op} has no parameters {unknown}; it has {sorted(known)}")
        return LazyFrame(replace(self.step, tuned=tuple(params)))

    def add_source(self, name: str = "input", schema: dict[str, str] | None = None) -> LazyFrame:
        """The plan with its source replaced: another name, and types that the frame must have."""

        def walk(s: Step) -> Step:
            if s.op == "source":
                return Step("source", {"name": name, **({"expected_schema": schema} if schema else {})})
            return replace(s, inputs=(walk(s.inputs[0]), *s.inputs[1:])) if s.inputs else s

        return LazyFrame(walk(self.step))

    def optimize(self, *rules: Callable[[Step], Step]) -> LazyFrame:
        step = self.step
        for rule in rules or (push_filters, pull_above_joins, push_filters):
            step = rule(step)
        return LazyFrame(step)

    def run(self, engine: Engine, inputs: dict[str, DataFrame] | DataFrame, done: dict[str, DataFrame] | None = None) -> DataFrame:
        tables = inputs if isinstance(inputs, dict) else {"input": inputs}
        return execute(engine, self.step, tables, {} if done is None else done)


def register_udaf(engine: Engine, name: str, fn: Callable, returns: str = "double") -> None:
    """A function of pandas series to one value, for SQL in ``group_by``; rows of a group meet in one task."""
    import pandas as pd

    def run(*cols):
        return fn(*cols)

    run.__annotations__ = {"cols": pd.Series, "return": float}
    engine.spark.udf.register(name, F.pandas_udf(run, returns, functionType=F.PandasUDFType.GROUPED_AGG))


def register_udtf(engine: Engine, name: str, cls: type, returns: str) -> None:
    """A table function: a class whose ``eval`` yields rows."""
    engine.spark.udtf.register(name, F.udtf(cls, returnType=returns))


def _beside(l: DataFrame, r: DataFrame, a: dict) -> DataFrame:
    from ..storage import with_position

    place = "__sembra_place"
    l, r = with_position(l, a["order"], place), with_position(r, a["other_order"], place)
    return l.join(r, place, "full").drop(place)


def _group(df: DataFrame, a: dict) -> DataFrame:
    if isinstance(a.get("sets"), list):
        sets = [[F.col(k) for k in s] for s in a["sets"]]
        return df.groupingSets(sets, *[F.col(k) for k in a["keys"]]).agg(*[F.expr(e).alias(n) for n, e in a["aggs"].items()])
    g = {None: df.groupBy, "rollup": df.rollup, "cube": df.cube}[a.get("sets")](*a["keys"])
    return g.agg(*[F.expr(e).alias(n) for n, e in a["aggs"].items()])


def _join(l: DataFrame, r: DataFrame, a: dict) -> DataFrame:
    if a["how"] in FULL and a["on"]:
        return _full(l, r, a["on"])
    return l.crossJoin(r) if a["how"] == "cross" else l.join(r, a["on"], a["how"])


FULL = ("full", "outer", "fullouter", "full_outer")


def _full(l: DataFrame, r: DataFrame, on: list[str]) -> DataFrame:
    """A full join as a left join and the right rows that meet none.

    Spark's own keeps all that one key gives in memory, pairs included; a left join hands pairs on.
    """
    l, r = (d if d._jdf.queryExecution().analyzed().deterministic() else materialise(d) for d in (l, r))  # both are read twice
    own = [F.lit(None).cast(f.dataType).alias(f.name) for f in l.schema if f.name not in on]
    alone = r.join(l.select(*on), on, "left_anti").select(*on, *own, *[F.col(f"`{c}`") for c in r.columns if c not in on])
    return l.join(r, on, "left").union(alone)


FUNCTIONS: dict[str, Callable] = {}


def function(name: str):
    """Register a function of (engine, df, **args) for ``apply`` and as a method of plans."""

    def wrap(fn):
        FUNCTIONS[name] = fn
        return fn

    return wrap


def _model_steps() -> dict[str, Callable]:
    from ..operators import aggregation, joins, ranking, rowwise, vectors

    return {
        **{n: getattr(rowwise, n) for n in ("sem_map", "sem_filter", "sem_extract", "llm_as_judge", "pairwise_judge")},
        "sem_agg": aggregation.sem_agg, "sem_topk": ranking.sem_topk, "sem_join": joins.sem_join,
        "sem_search": vectors.sem_search, "load_sem_index": vectors.load_sem_index, "sem_dedup": vectors.sem_dedup,
        "sem_sim_join": lambda engine, l, r, **a: vectors.sem_sim_join(l, r, **a),
        "sem_cluster_by": lambda engine, d, **a: vectors.sem_cluster_by(d, **a),
        "sem_partition_by": lambda engine, d, expr: aggregation.sem_partition_by(d, F.expr(expr)),
        "embed": vectors.embed_column,
    }


def execute(engine: Engine, step: Step, tables: dict[str, DataFrame], done: dict[str, DataFrame]) -> DataFrame:
    """Run a plan; ``done`` keeps the results of model steps by fingerprint, so equal parts run once."""
    key = step.fingerprint
    if key in done:
        return done[key]
    if step.op == "source":
        df = tables[step.args["name"]]
        if expected := step.args.get("expected_schema"):
            got = dict(df.dtypes)
            if bad := {c: (t, got.get(c)) for c, t in expected.items() if got.get(c) != t}:
                raise ValueError(f"the source differs from what was declared: {bad}")
        return df
    ins = [execute(engine, i, tables, done) for i in step.inputs]
    a, df = step.args, ins[0] if ins else None
    if step.op == "filter":
        out = df.where(a["predicate"])
    elif step.op == "select":
        out = df.selectExpr(*a["exprs"])
    elif step.op == "with_columns":
        out = df.withColumns({n: F.expr(e) for n, e in a["exprs"].items()})
    elif step.op == "rename":
        out = df.withColumnsRenamed(a["names"])
    elif step.op == "drop":
        out = df.drop(*a["cols"])
    elif step.op == "group_by":
        out = _group(df, a)
    elif step.op == "distinct":
        out = df.dropDuplicates(a["cols"]) if a["cols"] else df.distinct()
    elif step.op == "sort":
        out = df.orderBy(*[F.desc(e.removesuffix(" desc")) if e.endswith(" desc") else F.expr(e) for e in a["exprs"]])
    elif step.op == "limit":
        out = df.offset(a["offset"]).limit(a["n"]) if a.get("offset") else df.limit(a["n"])
    elif step.op == "join":
        out = _join(df, ins[1], a)
    elif step.op == "union":
        out = {"union": lambda: df.unionByName(ins[1], allowMissingColumns=True), "intersect": lambda: df.intersect(ins[1]), "intersect_all": lambda: df.intersectAll(ins[1]), "except": lambda: df.subtract(ins[1]), "except_all": lambda: df.exceptAll(ins[1])}[a["how"]]()
    elif step.op == "beside":
        out = _beside(df, ins[1], a)
    elif step.op == "lateral":
        call = f"{a['fn']}({', '.join(a['args'])})"
        out = engine.spark.sql("SELECT * FROM {this}, LATERAL " + call, this=df)
    elif step.op == "explode":
        out = df.withColumn(a["alias"], F.explode(F.expr(a["col"])))
    elif step.op == "sql":
        out = engine.spark.sql(a["query"], **dict(zip(a["views"], ins)))
    elif step.op == "apply":
        out = FUNCTIONS[a["fn"]](engine, *ins, **a["args"])
    else:
        known = _model_steps()
        call = known.get(step.op) or FUNCTIONS[step.op]
        out = call(engine, *ins, **a)
        done[key] = out
    return out


for _name in ("sem_search", "load_sem_index", "sem_dedup", "sem_sim_join", "sem_cluster_by", "sem_partition_by", "embed"):
    FUNCTIONS.setdefault(_name, lambda engine, *ins, _n=_name, **a: _model_steps()[_n](engine, *ins, **a))


class PromptOptimizer:
    """Keeps the proposal of greatest value: ``propose(params) -> list of changes``, ``value(plan) -> float``."""

    def __init__(self, propose: Callable[[dict[str, str]], list[dict[str, str]]], value: Callable[[LazyFrame], float], rounds: int = 1):
        self.propose, self.value, self.rounds = propose, value, rounds

    def optimize(self, plan: LazyFrame) -> LazyFrame:
        best, most = plan, self.value(plan)
        for _ in range(self.rounds):
            for change in self.propose(best.parameters()):
                new = best.patched(change)
                v = self.value(new)
                if v > most:
                    best, most = new, v
        return best


class CascadeOptimizer:
    """Learns the thresholds of a plan's cascades (filters, joins, pairwise judges) on training data and stores them in the plan."""

    OPS = ("sem_filter", "sem_join", "pairwise_judge")

    def __init__(self, engine: Engine, training: dict[str, DataFrame]):
        self.engine, self.training = engine, training

    def optimize(self, plan: LazyFrame) -> LazyFrame:
        def walk(s: Step) -> Step:
            s = replace(s, inputs=tuple(walk(i) for i in s.inputs))
            args = s.args.get("cascade")
            if s.op in self.OPS and args is not None and args.fixed is None:
                ins = [execute(self.engine, i, self.training, {}) for i in s.inputs]
                _, stats = _model_steps()[s.op](self.engine, *ins, **{k: v for k, v in s.args.items() if k != "return_stats"}, return_stats=True)
                one = next((x for x in stats if x is not None), None) if isinstance(stats, list) else stats
                if one is not None and one.pos_threshold is not None:
                    learned = replace(args, fixed=(one.pos_threshold, one.neg_threshold))
                    s = replace(s, args=s.args | {"cascade": replace(learned, plan=one.plan) if s.op == "sem_join" else learned})
            return s

        return LazyFrame(walk(plan.step))
