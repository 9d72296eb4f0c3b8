"""Chat prompts: a constant head made on the driver, and the row's message made by SQL."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .langex import columns_of, label_of, rendered


class Strategy(str, Enum):
    DEFAULT = "default"
    COT = "cot"
    ZS_COT = "zs_cot"
    FEW_SHOT = "few_shot"

    @classmethod
    def of(cls, value: Strategy | str | None) -> Strategy:
        return cls.DEFAULT if value is None else cls(value.lower() if isinstance(value, str) else value)

    @property
    def reasons(self) -> bool:
        return self in (Strategy.COT, Strategy.ZS_COT)


REASON_FIRST = "Write your reasoning after 'Reasoning:', then one line that starts with 'Answer:' and holds nothing but the answer."
SYSTEMS = {
    "filter": "A claim and a context follow. Decide if the context makes the claim true.",
    "map": "An instruction and a context follow. Do what the instruction says with the context.",
    "extract": "Fields and a context follow. Reply with one JSON object that has each field, taken from the context.",
    "topk": "Two documents and a criterion follow. Reply with 'Document 1' or 'Document 2', whichever meets the criterion better.",
    "judge": "You are a judge. A question about quality and the material follow. Give your verdict.",
    "agg": "Several documents follow. Combine them into one answer to the instruction.",
}


def system_text(kind: str, strategy: Strategy, system_prompt: str | None = None, tokens: tuple[str, str] | None = None, extra: str = "") -> str:
    parts = [system_prompt or SYSTEMS[kind]]
    if tokens and (strategy.reasons or not system_prompt):
        parts.append(f"Answer {tokens[0]} or {tokens[1]}.")
    if strategy.reasons:
        parts.append(REASON_FIRST)
    if extra:
        parts.append(extra)
    return " ".join(parts)


def user_text(context: str, instruction: str) -> str:
    return f"Context:\n{context}\n\n{instruction}"


def plain_fields(row: dict, columns: list[str]) -> str:
    return "".join(f"[{label_of(c)}]: «{row[c]}»\n" for c in columns if c in row)


def example_turns(examples: list[dict] | None, columns: list[str], task: str, strategy: Strategy, tokens: tuple[str, str] | None = None) -> list[dict]:
    """Few-shot turns; an example has the columns, Answer and, if wanted, Reasoning."""
    out = []
    for ex in examples or []:
        if "Answer" not in ex:
            raise ValueError("an example needs an Answer")
        answer = ex["Answer"]
        if tokens and isinstance(answer, bool):
            answer = tokens[0] if answer else tokens[1]
        elif tokens and str(answer).lower() not in [t.lower() for t in tokens]:
            raise ValueError(f"the answer of an example is one of {tokens}")
        reasoning = ex.get("Reasoning")
        content = f"Reasoning: {reasoning or 'left out'}\nAnswer: {answer}" if strategy is Strategy.COT or reasoning else str(answer)
        out += [{"role": "user", "content": user_text(plain_fields(ex, columns), task)}, {"role": "assistant", "content": content}]
    return out


@dataclass(frozen=True)
class Chat:
    """The messages of each row: ``head``, then a user message of the row's context and ``task``.

    Prompts of equal contexts are equal, and no others: what tells them apart is much smaller than they are.
    """

    head: list[dict]
    context: Column
    task: str

    def of(self, context: str) -> Chat:
        """The same messages about the contexts in a column of that name."""
        return replace(self, context=F.col(context))

    def text(self) -> Column:
        """The messages as JSON text."""
        start = json.dumps(self.head, ensure_ascii=False)[:-1] + (", " if self.head else "")
        content = F.concat(F.lit("Context:\n"), self.context, F.lit("\n\n" + self.task))
        return F.concat(F.lit(start), F.to_json(F.struct(F.lit("user").alias("role"), content.alias("content"))), F.lit("]"))


def chat(head: list[dict], context: Column, task: str) -> Chat:
    """Bytes that aren't UTF-8 are replaced and collations dropped, so that contexts compare as their prompts."""
    return Chat(head, F.collate(F.make_valid_utf8(context), "UTF8_BINARY"), task)


def task_of(kind: str, instruction: str) -> str:
    word = {"filter": "Claim", "map": "Instruction", "judge": "Question", "topk": "Criterion", "agg": "Instruction"}[kind]
    return f"{word}: {rendered(instruction)}"


def row_prompt(df: DataFrame, kind: str, instruction: str, how: str, strategy: Strategy, examples: list[dict] | None = None, system_prompt: str | None = None, tokens: tuple[str, str] | None = None, extra: str = "", more: list[str] = ()) -> Chat:
    from .serialize import row_text

    cols = columns_of(instruction)
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are not there")
    task = task_of(kind, instruction)
    head = [{"role": "system", "content": system_text(kind, strategy, system_prompt, tokens, extra)}]
    head += example_turns(examples, cols, task, strategy, tokens)
    return chat(head, row_text(df, [*cols, *more], how), task)


def extract_prompt(df: DataFrame, input_cols: list[str], output_cols: dict[str, str | None], quotes: bool, how: str, strategy: Strategy) -> Chat:
    from .serialize import row_text

    fields = {k: v or "value of that name" for k, v in output_cols.items()}
    if quotes:
        fields |= {f"{k}_quote": f"the passage of the context that supports {k}" for k in output_cols}
    head = [{"role": "system", "content": system_text("extract", strategy)}]
    return chat(head, row_text(df, input_cols, how), "Fields: " + json.dumps(fields, ensure_ascii=False))
