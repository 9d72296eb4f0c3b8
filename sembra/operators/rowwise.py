"""Row-wise model operators: map, filter, extract, judge, pairwise judge."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cascade import CascadeArgs, calibrate, learn, sample_ids
from ..engine import Engine, operator_cache
from ..functions import answers
from ..functions.langex import columns_of, rendered
from ..functions.prompts import Strategy, extract_prompt, row_prompt



def _said() -> Column:
    return F.col("__sembra_said.text")


def _free(df: DataFrame, name: str) -> str:
    """``name``, or name_1, name_2, … where it is taken."""
    out, n = name, 0
    while out in df.columns:
        n += 1
        out = f"{name}_{n}"
    return out


def _notes(df: DataFrame, suffix: str, explain: bool, raw: bool) -> DataFrame:
    if explain:
        df = df.withColumn("explanation" + suffix, answers.explanation(_said()))
    if raw:
        df = df.withColumn("raw_output" + suffix, _said())
    return df.drop("__sembra_said")


@operator_cache
def sem_map(engine: Engine, df: DataFrame, instruction: str, suffix: str = "_map", examples: list[dict] | None = None, strategy: str | None = None, system_prompt: str | None = None, postprocess: Callable[[Column], Column] = answers.body, return_explanations: bool = False, return_raw_outputs: bool = False, salt: str = "") -> DataFrame:
    """One answer per row in column ``suffix``."""
    how = Strategy.of(strategy)
    prompt = row_prompt(df, "map", instruction, engine.serialization, how, examples, system_prompt)
    out = engine.ask(df, prompt, salt=salt).withColumn(suffix, postprocess(_said()))
    return _notes(out, suffix, return_explanations or (how is Strategy.COT and bool(examples)), return_raw_outputs)


@operator_cache
def sem_extract(engine: Engine, df: DataFrame, input_cols: list[str], output_cols: dict[str, str | None], extract_quotes: bool = False, strategy: str | None = None, return_raw_outputs: bool = False, return_explanations: bool = False, extra_col: str | None = None) -> DataFrame:
    """One string column per requested field (and ``_quote``); null where the answer lacks it or isn't an object."""
    how = Strategy.of(strategy)
    out = engine.ask(df, extract_prompt(df, input_cols, output_cols, extract_quotes, engine.serialization, how))
    out = out.withColumn("__sembra_fields", answers.json_fields(_said()))
    names = [*output_cols, *([f"{c}_quote" for c in output_cols] if extract_quotes else [])]
    out = out.withColumns({c: F.col("__sembra_fields")[c] for c in names})
    if extra_col:
        out = out.withColumn(extra_col, F.map_filter("__sembra_fields", lambda k, v: ~k.isin(names)))
    return _notes(out.drop("__sembra_fields"), "", return_explanations or how.reasons, return_raw_outputs)


@dataclass
class FilterStats:
    """What a cascade did."""

    pos_threshold: float
    neg_threshold: float
    resolved_by_helper: int
    resolved_by_large: int


def _proxy_scores(engine: Engine, df: DataFrame, instruction: str, args: CascadeArgs, tokens: tuple[str, str], examples: list[dict] | None) -> DataFrame:
    """df with a score in [0, 1]: the helper's probability (calibrated), or the similarity of row text and instruction."""
    instruction = args.helper_instruction or instruction
    if args.proxy == "embedding":
        from .vectors import embed_column, similarity

        cols = columns_of(instruction)
        text = F.concat_ws(" ", *[F.col(f"`{c}`").cast("string") for c in cols])
        query = engine.embedder.embed([rendered(instruction)])[0]
        scored = embed_column(engine, df.withColumn("__sembra_text", text), "__sembra_text", "__sembra_vec")
        return scored.withColumn("__sembra_score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), similarity(F.col("__sembra_vec"), [float(x) for x in query])))).drop("__sembra_text", "__sembra_vec")
    if engine.helper is None:
        raise ValueError("a helper cascade needs a helper model")
    prompt = row_prompt(df, "filter", instruction, engine.serialization, Strategy.DEFAULT, examples, tokens=tokens)
    said = engine.ask(df, prompt, engine.helper)
    score = F.coalesce("__sembra_said.positive_prob", F.when(answers.verdict(_said(), False, tokens), F.lit(1.0)).otherwise(F.lit(0.0)))
    scored = said.withColumn("__sembra_score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))).drop("__sembra_said")
    return calibrate(engine.materialise(scored, "helper"), args.quantiles) if args.calibrated else scored


@operator_cache
def sem_filter(engine: Engine, df: DataFrame, instruction: str, return_all: bool = False, default: bool = True, suffix: str = "_filter", examples: list[dict] | None = None, helper_examples: list[dict] | None = None, strategy: str | None = None, helper_strategy: str | None = None, cascade: CascadeArgs | None = None, system_prompt: str | None = None, extra_instructions: str = "", output_tokens: tuple[str, str] = ("True", "False"), return_explanations: bool = False, return_raw_outputs: bool = False, return_stats: bool = False, salt: str = ""):
    """Rows whose claim is judged true; with return_all every row and the verdict.

    With ``cascade`` a proxy settles rows outside (neg, pos) and the model the rest; thresholds are
    learned from a sample unless they are fixed.  A cascade's answers must be single tokens of both
    models, and its helper doesn't reason.
    """
    how = Strategy.of(strategy)
    prompt = lambda d: row_prompt(d, "filter", instruction, engine.serialization, how, examples, system_prompt, output_tokens, extra_instructions)
    verdict = answers.verdict(_said(), default, output_tokens)
    name = _free(df, suffix)
    stats = None
    if cascade is None:
        out = engine.ask(df, prompt(df), salt=salt).withColumn(name, verdict)
        out = _notes(out, suffix, return_explanations, return_raw_outputs)
    else:
        if cascade.proxy == "helper" and Strategy.of(helper_strategy).reasons:
            raise ValueError("the helper of a cascade doesn't reason")
        for model in (engine.lm, engine.helper if cascade.proxy == "helper" else None):
            for token in output_tokens:
                if model is not None and (n := model.tokenizer.count(token)) != 1:
                    raise ValueError(f"{token!r} has {n} tokens for {model.model}; a cascade needs answers of one token")
        scored = _proxy_scores(engine, df, instruction, cascade, output_tokens, helper_examples)
        scored = engine.materialise(scored.withColumn("__sembra_id", F.monotonically_increasing_id()), "cascade")
        if cascade.fixed is not None:
            pos, neg = cascade.fixed
        else:
            chosen = sample_ids(scored, cascade)
            some = scored.join(engine.spark.createDataFrame([(i,) for i in chosen], "__sembra_id long"), "__sembra_id", "left_semi")
            judged = {r[0]: r[1] for r in engine.ask(some, prompt(some), salt=salt).withColumn("__sembra_ok", verdict).select("__sembra_id", "__sembra_ok").collect()}
            pos, neg = learn([(d.score, judged[i], d.correction, d.times) for i, d in chosen.items()], cascade)
        score = F.col("__sembra_score")
        sure = scored.where((score >= pos) | (score <= neg)).withColumn(name, score >= pos)
        unsure = scored.where((score < pos) & (score > neg))
        asked = engine.ask(unsure, prompt(unsure), salt=salt).withColumn(name, verdict)
        if return_explanations or return_raw_outputs:
            sure = sure.withColumn("__sembra_said", F.lit(None).cast("struct<text:string,positive_prob:double>"))
            out = sure.unionByName(_keep_said(asked))
            out = _notes(out, suffix, return_explanations, return_raw_outputs)
        else:
            out = sure.unionByName(asked.drop("__sembra_said"))
        if return_stats:
            stats = FilterStats(pos, neg, sure.count(), unsure.count())
        out = out.drop("__sembra_score", "__sembra_id")
    out = out if return_all else out.where(F.col(name)).drop(name)
    return (out, stats) if return_stats else out


def _keep_said(df: DataFrame) -> DataFrame:
    return df.withColumn("__sembra_said", F.col("__sembra_said").cast("struct<text:string,positive_prob:double>"))


@operator_cache
def llm_as_judge(engine: Engine, df: DataFrame, instruction: str, n_trials: int = 1, suffix: str = "_judge", response_schema: str | None = None, strategy: str | None = None, examples: list[dict] | None = None, system_prompt: str | None = None, extra_cols: list[str] = (), return_raw_outputs: bool = False, return_explanations: bool = False) -> DataFrame:
    """Independent verdicts in columns ``suffix``_0 …; trials have log entries of their own.

    ``response_schema`` (DDL) makes each verdict a struct read from JSON, null where it can't be read.
    """
    how = Strategy.of(strategy)
    if response_schema and how.reasons:
        raise ValueError("a response schema and reasoning can't be combined")
    out = df
    for trial in range(n_trials):
        name = f"{suffix}_{trial}"
        prompt = row_prompt(out, "judge", instruction, engine.serialization, how, examples, system_prompt, more=list(extra_cols))
        out = engine.ask(out, prompt, salt=f"trial {trial}")
        value = F.from_json(_said(), response_schema) if response_schema else answers.body(_said())
        out = _notes(out.withColumn(name, value), f"{suffix}_{trial}", return_explanations, return_raw_outputs)
    return out


@operator_cache
def pairwise_judge(engine: Engine, df: DataFrame, col1: str, col2: str, instruction: str, n_trials: int = 1, permute_cols: bool = False, suffix: str = "_judge", default_to_col1: bool = True, cascade: CascadeArgs | None = None, strategy: str | None = None, examples: list[dict] | None = None, helper_examples: list[dict] | None = None, system_prompt: str | None = None, extra_instructions: str = "", return_raw_outputs: bool = False, return_explanations: bool = False, return_stats: bool = False):
    """"A" if col1 is better, "B" if col2 is, per trial; permute_cols swaps the columns in every second half.

    Explanations and raw answers are in columns per trial, as the judge saw the pair; with
    return_stats also the cascade's stats of each trial (None without a cascade).  An example has
    ``response A``, ``response B`` and Answer.
    """
    if permute_cols and n_trials % 2:
        raise ValueError("swapped trials need an even number of trials")
    shown_as = {c: f"__sembra_own_{i}" for i, c in enumerate(("response A", "response B"))}
    own = {c: n for c, n in shown_as.items() if c in df.columns}
    out = df.withColumnsRenamed(own)
    col1, col2 = own.get(col1, col1), own.get(col2, col2)
    all_stats = []
    for trial in range(n_trials):
        swapped = permute_cols and trial >= n_trials // 2
        a, b = (col2, col1) if swapped else (col1, col2)
        shown = out.withColumns({"response A": F.col(a), "response B": F.col(b)})
        ask = f"{rendered(instruction) if '{' in instruction else instruction} Which is better, {{response A}} or {{response B}}?"
        args = None if cascade is None else cascade.swapped() if swapped else cascade
        name = f"{suffix}_{trial}"
        judged, stats = sem_filter(engine, shown, ask, return_all=True, default=default_to_col1 != swapped, suffix="__sembra_first", output_tokens=("A", "B"), cascade=args, strategy=strategy, examples=examples, helper_examples=helper_examples, system_prompt=system_prompt, extra_instructions=extra_instructions, return_raw_outputs=return_raw_outputs, return_explanations=return_explanations, return_stats=True, salt=f"trial {trial}")
        all_stats.append(stats)
        first = ~F.col("__sembra_first") if swapped else F.col("__sembra_first")
        judged = judged.withColumnsRenamed({f"{note}__sembra_first": f"{note}{name}" for note in ("explanation", "raw_output")})
        out = judged.withColumn(name, F.when(first, "A").otherwise("B")).drop("__sembra_first", "response A", "response B")
    out = out.withColumnsRenamed({n: c for c, n in own.items()})
    return (out, all_stats) if return_stats else out
