"""Deterministic rules that stand in for a model in the registered queries (and have SQL twins)."""

from __future__ import annotations

import json
import re

import numpy as np

from .backend import Completion, Embedder, RuleBackend


def names_a_ring(f: dict, message: str) -> str:
    return "True" if re.search(r"\bring\b", f["P_name"]) else "False"


def first_letter(f: dict, message: str) -> str:
    return f["P_type"][0].lower()


def key_of_props(f: dict, message: str) -> str:
    return json.dumps({"k": str(json.loads(f["Props"])["k"])})


def long_or_short(f: dict, message: str) -> str:
    return "long" if int(f["N_chars"]) >= 1500 else "short"


def longer(f: dict, message: str) -> str:
    a, b = len(f["Response a"]), len(f["Response b"])
    return "A" if a > b else "B" if b > a else "neither"


def letter_in_region(f: dict, message: str) -> str:
    return "True" if f["P_type"][0] in f["R_name"] else "False"


def size_prob(f: dict, message: str) -> Completion:
    p = int(f["P_size"]) / 50
    return Completion("True" if p >= 0.5 else "False", p)


def ring_or_size(f: dict, message: str) -> str:
    return "True" if re.search(r"\bring\b", f["P_name"]) else "False"


def own_type(f: dict, message: str) -> str:
    return f["P_type"]


def _two(message: str, label: str) -> tuple[float, float]:
    a, _, b = message.partition("\nDocument 2:\n")
    value = lambda t: float(re.search(rf"\[{label}\]: «(.*?)»", t)[1])
    return value(a), value(b)


def larger_balance(f: dict, message: str) -> Completion:
    a, b = _two(message, "S_acctbal")
    return Completion("Document 1" if a > b else "Document 2", 0.95 if a > b else 0.05)


def larger_key(f: dict, message: str) -> Completion:
    a, b = _two(message, "N_nationkey")
    return Completion("Document 1" if a > b else "Document 2", 0.95 if a > b else 0.05)


def hasty_key(f: dict, message: str) -> Completion:
    """A helper that is right and sure about keys far apart, and wrong and unsure about close ones."""
    a, b = _two(message, "N_nationkey")
    if abs(a - b) > 5:
        return larger_key(f, message)
    return Completion("Document 2" if a > b else "Document 1", 0.4 if a > b else 0.6)


def ring_with_reason(f: dict, message: str) -> str:
    return f"Reasoning: read {f['P_name']}\nAnswer: {names_a_ring(f, message)}"


def letter_with_thought(f: dict, message: str) -> str:
    return f"<think>It is {f['P_type']}.</think>\n{first_letter(f, message)}"


def longer_with_reason(f: dict, message: str) -> str:
    return f"Reasoning: {len(f['Response a'])} to {len(f['Response b'])}\nAnswer: {longer(f, message)}"


def key_with_quote(f: dict, message: str) -> str:
    return json.dumps({"k": str(json.loads(f["Props"])["k"]), "k_quote": f["Props"], "more": "x"})


class LetterEmbedder(Embedder):
    """A quarter for each letter a to z that a text has, so that similarities are exact sixteenths."""

    dim = 26

    def embed(self, texts: list[str]) -> np.ndarray:
        return np.array([[0.25 * (chr(97 + i) in (t or "").lower()) for i in range(26)] for t in texts]).reshape(len(texts), 26)


def larger_region(f: dict, message: str) -> str:
    a, b = _two(message, "R_regionkey")
    return "Document 1" if a > b else "Document 2"


def list_values(f: dict, message: str) -> str:
    leaves = re.findall(r"Document \d+: \[[^\]]+\]: «(.*?)»", message)
    return ",".join(leaves or re.findall(r"Source \d+: (.*)", message))


RULES = {
    "names jewellery": ring_with_reason, "letter, after a thought": letter_with_thought, "say why": longer_with_reason, "k_quote": key_with_quote, "nation key is bigger": larger_key,
    "Write what would match": own_type,
    "names a ring": names_a_ring, "first letter": first_letter, "Fields: {\"k\"": key_of_props, "long or short": long_or_short, "Which is better": longer, "has a letter": letter_in_region,
    "balance is larger": larger_balance, "nation key is larger": larger_key, "region key is larger": larger_region, "List the values": list_values, "big or a ring": ring_or_size,
}
HELPER_RULES = {"nation key is bigger": hasty_key, "big or a ring": size_prob, "nation key is larger": larger_key, "balance is larger": larger_balance}


def backend() -> RuleBackend:
    return RuleBackend(rules=RULES)


def helper() -> RuleBackend:
    return RuleBackend(rules=HELPER_RULES, model="helper")


def agent(chat: list[dict], tools: list) -> dict:
    """A completer for the agentic queries: lower-cases a unit, keeps names with an A, lists findings."""
    system, user = chat[0]["content"], chat[1]["content"]
    if system.startswith("Combine"):
        return {"text": "|".join(re.findall(r"\[shard \d+\] (.*)", user))}
    content = re.split(r"\n\nUnit [^\n]*:\n", user, maxsplit=1)[-1]
    if system.startswith("Decide"):
        return {"text": "VERDICT: KEEP" if "A" in content.partition(": ")[2] else "VERDICT: DROP"}
    return {"text": content.lower()}


def agent_with_background(chat: list[dict], tools: list) -> dict:
    """Lower-cases a unit and says of how many it is one, which only the shared background tells."""
    user = chat[1]["content"]
    content = re.split(r"\n\nUnit [^\n]*:\n", user, maxsplit=1)[-1]
    return {"text": f"{content.lower()} of {re.search(r'one of (\d+)', user)[1]}"}


def agent_of_batches(chat: list[dict], tools: list) -> dict:
    """Lower-cases each unit of a batch."""
    units = json.loads(chat[1]["content"].partition("Units:\n")[2])
    return {"text": json.dumps([{"id": u["id"], "result": u["content"].lower()} for u in units])}
