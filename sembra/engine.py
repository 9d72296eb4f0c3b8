"""The engine: settings, and the barrier through which every model call goes.

A model call is not a function for Catalyst: it would be evaluated twice, pushed below joins, and its
deduplication undone.  So a call is lowered as distinct prompts -> anti-join with the call log ->
one Arrow-batched stage -> a new part of the log (parquet) -> join back by key.  The log is the source
of truth for calls, tokens and cost, it outlives executors, and a later plan over it is free.  Its parts
lie in folders by model and trial, and a barrier reads those of its own alone.

Columns whose names begin with ``__sembra`` are the engine's own.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import wraps

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .backend import Backend, Embedder, HashEmbedder, Limits, Reranker, Usage, cost_of
from .functions.prompts import Chat
from .storage import materialise, shared_path

#: Logs of more calls are first cut to the keys that a barrier needs, which takes a job.
LARGE_LOG = 1_000_000
LOG = "key string, model string, text string, positive_prob double, tokens_in long, tokens_out long"


@dataclass
class Engine:
    """Everything an operator needs; captured by plans, so nothing is global."""

    spark: SparkSession
    lm: Backend | None = None
    helper: Backend | None = None
    embedder: Embedder = field(default_factory=HashEmbedder)
    reranker: Reranker = field(default_factory=Reranker)
    serialization: str = "default"
    use_log: bool = True
    log_path: str | None = None
    limits: Limits = Limits()
    usage: Usage = field(default_factory=Usage)
    count_rows: bool = False  # one more job per call; gives usage.rows and cache_hits
    requests_per_minute: int | None = None
    tokens_per_minute: int | None = None
    use_operator_cache: bool = False  # whole results by the content of their input, see operator_cache
    cache_path: str | None = None
    safe_mode: bool = False  # calls and tokens are counted, and limits checked, before a barrier spends anything
    estimates: list[dict] = field(default_factory=list)
    log_rows: dict[str, int] = field(default_factory=dict)  # calls in the log, by folder

    def with_(self, **changes) -> Engine:
        return replace(self, **changes)

    def shared_path(self, name: str) -> str:
        return shared_path(self.spark, name)

    def materialise(self, df: DataFrame, name: str = "step") -> DataFrame:
        return materialise(df, name)

    def ask(self, df: DataFrame, prompt: Chat, backend: Backend | None = None, salt: str = "", merge: bool = False) -> DataFrame:
        """df with column _said: struct<text, positive_prob>; one call for equal prompts, none for logged ones.

        ``salt`` tells calls apart that must not share an answer (trials).  A null context isn't asked.
        Equal prompts are found by their contexts, hashed; whole prompts are made of distinct ones, as they are asked.
        ``merge``: no table of the barrier is broadcast, for rounds whose tables would pass the driver each time.
        """
        met = (lambda d: d.hint("merge")) if merge else (lambda d: d)
        backend = backend or self.lm
        if backend is None:
            raise ValueError("no model is configured")
        if self.log_path is None or not self.use_log:
            log = self.shared_path("calls")
            if self.use_log:
                self.log_path = log
        else:
            log = self.log_path
        name = json.dumps([backend.model, backend.max_tokens, salt])
        log = f"{log}/{hashlib.sha256(name.encode()).hexdigest()[:16]}"
        key = lambda p: F.sha2(F.concat(F.lit(name), p.text()), 256)
        every = df.select(prompt.context.alias("__sembra_context")).where("__sembra_context IS NOT NULL").groupBy("__sembra_context").agg(F.count("*").alias("__sembra_n"))
        df, prompt = df.withColumn("__sembra_key", key(prompt)), prompt.of("__sembra_context")
        every = every.withColumn("__sembra_key", key(prompt))
        known = self._log(log)
        asked = every
        hits = None
        if known is not None:
            if log not in self.log_rows:
                self.log_rows[log] = known.count()
            large = self.log_rows[log] > LARGE_LOG
            hits = materialise(known.join(met(every.select(F.col("__sembra_key").alias("key"))), "key", "left_semi"), "hits") if large else known
            asked = every.join(met(hits.select(F.col("key").alias("__sembra_key"))), "__sembra_key", "left_anti")
        if self.safe_mode:
            self._check_before(asked, prompt, backend)
        rpm, tpm = self.requests_per_minute, self.tokens_per_minute
        # shares of a limit are those of as many tasks as there are, and never less than one request
        tasks = max(1, min(self.spark.sparkContext.defaultParallelism, rpm or tpm or 1))
        asked = asked.repartition(tasks) if rpm or tpm else asked

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from .backend import RateLimiter

            limiter = RateLimiter(rpm, tpm, tasks) if rpm or tpm else None
            for frame in frames:
                for at in range(0, len(frame), backend.max_batch):
                    part = frame.iloc[at : at + backend.max_batch]
                    chats = [json.loads(p) for p in part["__sembra_prompt"]]
                    if limiter:
                        for c in chats:
                            limiter.wait(sum(backend.tokenizer.count(m["content"]) for m in c))
                    said = backend.complete(chats)
                    yield pd.DataFrame({"key": part["__sembra_key"].to_numpy(), "model": backend.model, "text": [s.text for s in said], "positive_prob": pd.array([s.positive_prob for s in said], dtype="Float64"), "tokens_in": [s.tokens_in for s in said], "tokens_out": [s.tokens_out for s in said]})

        part = f"{log}/part-{uuid.uuid4().hex}"
        asked.select("__sembra_key", prompt.text().alias("__sembra_prompt")).mapInPandas(run, LOG).write.parquet(part)
        new = self.spark.read.schema(LOG).parquet(part)
        calls, tin, tout = new.agg(F.count("*"), F.coalesce(F.sum("tokens_in"), F.lit(0)), F.coalesce(F.sum("tokens_out"), F.lit(0))).first()
        found = new if hits is None else new.union(hits)
        u = self.usage
        if self.count_rows:  # what the same answers would have taken without the log and with equal prompts asked again
            once = found.dropDuplicates(["key"]).withColumnRenamed("key", "__sembra_key")
            rows, vin, vout = every.join(once, "__sembra_key").agg(F.sum("__sembra_n"), F.sum(F.col("__sembra_n") * F.col("tokens_in")), F.sum(F.col("__sembra_n") * F.col("tokens_out"))).first()
            u.rows += rows or 0
            u.virtual_tokens_in += vin or 0
            u.virtual_tokens_out += vout or 0
            u.virtual_cost += cost_of(backend.model, vin or 0, vout or 0)
        u.calls += calls
        u.tokens_in += tin
        u.tokens_out += tout
        u.cost += cost_of(backend.model, tin, tout)
        self.log_rows[log] = self.log_rows.get(log, 0) + calls
        self.limits.check(u)
        said = found.groupBy("key").agg(F.first(F.struct("text", "positive_prob")).alias("__sembra_said"))
        return df.join(met(said.withColumnRenamed("key", "__sembra_key")), "__sembra_key", "left").drop("__sembra_key")

    def _check_before(self, asked: DataFrame, prompt: Chat, backend: Backend) -> None:
        """Record what a barrier would ask, and raise where that alone passes a limit."""
        got = self.estimate(asked, prompt, backend)
        self.estimates.append(got)
        u = replace(self.usage)
        u.calls += got["calls"]
        u.tokens_in += got["tokens_in"]
        u.cost += cost_of(backend.model, got["tokens_in"], 0)
        self.limits.check(u)

    def _log(self, log: str) -> DataFrame | None:
        """The call log as it is now, None where there is none.

        Its parts are named one by one: Spark takes two readings of one folder for the same table, and
        would use an exchange of the older one again.
        """
        p = self.spark._jvm.org.apache.hadoop.fs.Path(log)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        parts = sorted(str(x.getPath()) for x in fs.listStatus(p)) if fs.exists(p) else []
        return self.spark.read.schema(LOG).parquet(*parts) if parts else None

    def estimate(self, df: DataFrame, prompt: Chat, backend: Backend | None = None) -> dict[str, int]:
        """Calls (equal prompts once) and prompt tokens, by the backend's tokenizer, that asking would take."""
        tokenizer = (backend or self.lm).tokenizer

        @F.pandas_udf("long")
        def tokens(s: pd.Series) -> pd.Series:
            return s.map(lambda p: sum(tokenizer.count(m["content"]) for m in json.loads(p))).astype("int64")

        one = df.select(prompt.context.alias("__sembra_context")).where("__sembra_context IS NOT NULL").distinct()
        r = one.select(prompt.of("__sembra_context").text().alias("p")).agg(F.count("p"), F.sum(tokens("p"))).first()
        return {"calls": r[0], "tokens_in": r[1] or 0}


def _content(df: DataFrame) -> list:
    """A digest of a frame's rows and schema, whatever their order."""
    every = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    row = F.to_json(every, {"ignoreNullFields": "false"})
    got = df.select(F.xxhash64(row).alias("a"), F.xxhash64(F.lit(1), row).alias("b")).agg(F.count("*"), F.bit_xor("a"), F.sum(F.col("a").cast("decimal(20,0)")), F.sum(F.col("b").cast("decimal(20,0)"))).first()
    return [df.schema.simpleString(), *map(str, got)]


def operator_cache(fn: Callable) -> Callable:
    """An operator whose whole result is kept, by name, arguments, models and the content of its input frames.

    Used where the engine has ``use_operator_cache`` and the result is one frame; a hit asks nothing.
    """

    @wraps(fn)
    def run(engine: Engine, *args, **kwargs):
        if not engine.use_operator_cache or kwargs.get("return_stats"):
            return fn(engine, *args, **kwargs)
        plain = lambda v: _content(v) if isinstance(v, DataFrame) else [plain(x) for x in v] if isinstance(v, (list, tuple)) else {str(k): plain(x) for k, x in v.items()} if isinstance(v, dict) else getattr(v, "__qualname__", None) or repr(v)
        models = [None if m is None else [m.model, m.max_tokens] for m in (engine.lm, engine.helper)]
        key = hashlib.sha256(json.dumps([fn.__qualname__, models, engine.serialization, plain(args), plain(kwargs)], sort_keys=True).encode()).hexdigest()
        engine.cache_path = engine.cache_path or engine.shared_path("operators")
        at = f"{engine.cache_path}/{key}"
        done = engine.spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
        if done.getFileSystem(engine.spark._jsc.hadoopConfiguration()).exists(done):
            engine.usage.operator_cache_hits += 1
            return engine.spark.read.parquet(at)
        fn(engine, *args, **kwargs).write.mode("overwrite").parquet(at)
        return engine.spark.read.parquet(at)

    return run
