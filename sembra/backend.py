"""Model backends: the protocol, a rule backend for offline use, a scripted one, limits and prices."""

from __future__ import annotations

import json
import math
import re
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np

from .functions.serialize import fields_of


class Completion(NamedTuple):
    text: str
    positive_prob: float | None = None
    tokens_in: int = 0
    tokens_out: int = 0


class UsageLimitError(RuntimeError):
    """A token, call or cost limit was passed."""


@dataclass
class Usage:
    """calls: sent to the backend; rows: answered; the rest of the rows came from the log or from equal prompts."""

    calls: int = 0
    rows: int = 0
    tokens_in: int = 0
    tokens_out: int = 0
    cost: float = 0.0
    virtual_tokens_in: int = 0  # what no log and no shared prompts would have taken; counted with count_rows
    virtual_tokens_out: int = 0
    virtual_cost: float = 0.0
    operator_cache_hits: int = 0

    @property
    def cache_hits(self) -> int:
        return self.rows - self.calls


@dataclass(frozen=True)
class Limits:
    calls: int | None = None
    tokens_in: int | None = None
    tokens_out: int | None = None
    total_tokens: int | None = None
    cost: float | None = None

    def check(self, u: Usage) -> None:
        for name, now in (("calls", u.calls), ("tokens_in", u.tokens_in), ("tokens_out", u.tokens_out), ("total_tokens", u.tokens_in + u.tokens_out), ("cost", u.cost)):
            most = getattr(self, name)
            if most is not None and now > most:
                raise UsageLimitError(f"{name} is {now}; the limit is {most}")


#: Dollars per million tokens (in, out), by model name; unknown models cost nothing known.
PRICES: dict[str, tuple[float, float]] = {}


def set_price(model: str, per_million_in: float, per_million_out: float) -> None:
    """The price of a model; prices change, so none are kept here."""
    PRICES[model] = (per_million_in, per_million_out)


def cost_of(model: str, tokens_in: int, tokens_out: int) -> float:
    a, b = PRICES.get(model, (0.0, 0.0))
    return (a * tokens_in + b * tokens_out) / 1e6


class Tokenizer:
    """Tokens are runs of non-blank characters."""

    def encode(self, text: str) -> list[str]:
        return text.split()

    def decode(self, tokens: list[str]) -> str:
        return " ".join(tokens)

    def count(self, text: str) -> int:
        return len(text.split())


class FileTokenizer(Tokenizer):
    """A vocabulary file of the tokenizers library (.json), sentencepiece (.model) or tiktoken; loaded where it is used."""

    def __init__(self, path: str):
        self.path, self._lib = path, None

    def __getstate__(self):
        return {"path": self.path, "_lib": None}

    @property
    def lib(self):
        if self._lib is None:
            if self.path.endswith(".model"):
                import sentencepiece

                self._lib = sentencepiece.SentencePieceProcessor(model_file=self.path)
            else:
                from tokenizers import Tokenizer as Lib

                self._lib = Lib.from_file(self.path)
        return self._lib

    def encode(self, text: str) -> list[int]:
        return self.lib.encode(text) if self.path.endswith(".model") else self.lib.encode(text, add_special_tokens=False).ids

    def decode(self, tokens: list[int]) -> str:
        if not self.path.endswith(".model") and self.lib.decoder is None:  # a file without a decoder: pieces, words by their end marks
            pieces = [self.lib.id_to_token(t) or "" for t in tokens]
            ends = any(p.endswith("</w>") for p in pieces)
            return "".join(p.replace("</w>", " ") for p in pieces).strip() if ends else "".join(pieces)
        return self.lib.decode(list(tokens))

    def count(self, text: str) -> int:
        return len(self.encode(text))


@dataclass
class Backend:
    """Answers batches of chats; made on the driver, used in the workers, so it must pickle."""

    model: str = "model"
    max_context: int = 128_000
    max_tokens: int = 512
    max_batch: int = 64
    tokenizer: Tokenizer = field(default_factory=Tokenizer)

    def complete(self, chats: list[list[dict]]) -> list[Completion]:
        raise NotImplementedError

    def get_completion(self, system: str, user: str) -> str:
        return self.complete([[{"role": "system", "content": system}, {"role": "user", "content": user}]])[0].text


@dataclass
class RuleBackend(Backend):
    """Rules by a part of the task line; a rule maps (fields, message) to an answer or a Completion.

    Exercises the whole path (text, prompt, parse, route); it says nothing about a model's quality.
    """

    rules: dict[str, Callable] = field(default_factory=dict)
    model: str = "rules"

    def complete(self, chats: list[list[dict]]) -> list[Completion]:
        return [self._one(c) for c in chats]

    def _one(self, chat: list[dict]) -> Completion:
        message = chat[-1]["content"]
        task = message.rpartition("\n\n")[2]
        for part, rule in self.rules.items():
            if part in task or part in message:
                got = rule(fields_of(message), message)
                got = got if isinstance(got, Completion) else Completion(str(got))
                n = sum(self.tokenizer.count(m["content"]) for m in chat)
                return got._replace(tokens_in=n, tokens_out=self.tokenizer.count(got.text))
        raise KeyError(f"no rule for {task!r}")


@dataclass
class ScriptedBackend(Backend):
    """Answers by a function of the whole chat."""

    script: Callable[[list[dict]], str] = lambda chat: ""
    model: str = "script"

    def complete(self, chats: list[list[dict]]) -> list[Completion]:
        return [Completion(self.script(c), None, sum(len(m["content"].split()) for m in c), 1) for c in chats]


@dataclass
class HttpBackend(Backend):
    """A chat-completions endpoint over HTTP; requests of a batch run in threads."""

    url: str = ""
    key: str = ""
    positive: str = "True"
    negative: str = "False"
    timeout: float = 120.0

    def complete(self, chats: list[list[dict]]) -> list[Completion]:
        with ThreadPoolExecutor(self.max_batch) as pool:
            return list(pool.map(self._one, chats))

    def _one(self, chat: list[dict]) -> Completion:
        from urllib.request import Request, urlopen

        ask = {"model": self.model, "messages": chat, "temperature": 0, "max_tokens": self.max_tokens, "logprobs": True, "top_logprobs": 10}
        req = Request(self.url, json.dumps(ask).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
        got = json.loads(urlopen(req, timeout=self.timeout).read())
        choice, use = got["choices"][0], got.get("usage", {})
        steps = ((choice.get("logprobs") or {}).get("content")) or []
        prob = positive_prob([{t["token"]: t["logprob"] for t in s.get("top_logprobs", [])} for s in steps], choice["message"]["content"], self.positive, self.negative)
        return Completion(choice["message"]["content"], prob, use.get("prompt_tokens", 0), use.get("completion_tokens", 0))


def positive_prob(steps: list[dict[str, float]], text: str, positive: str, negative: str) -> float:
    """P(positive) against P(negative) at the first step whose likely tokens hold both; else by the text."""
    for step in steps:
        if positive in step and negative in step:
            p, n = math.exp(step[positive]), math.exp(step[negative])
            return p / (p + n)
    return 1.0 if positive.lower() in text.lower() else 0.0


class RateLimiter:
    """A task's share of requests and tokens per minute."""

    def __init__(self, requests: int | None = None, tokens: int | None = None, tasks: int = 1, clock=time.monotonic, sleep=time.sleep):
        self.requests = None if requests is None else max(1, requests // tasks)
        self.tokens = None if tokens is None else max(1, int(0.95 * tokens) // tasks)
        self.clock, self.sleep, self.sent = clock, sleep, []

    def wait(self, tokens: int) -> None:
        if self.tokens is not None and tokens > self.tokens:
            raise ValueError("one prompt needs more tokens than a minute has")
        while True:
            now = self.clock()
            self.sent = [s for s in self.sent if now - s[0] < 60]
            full = self.requests is not None and len(self.sent) >= self.requests
            full |= self.tokens is not None and sum(s[1] for s in self.sent) + tokens > self.tokens
            if not full:
                self.sent.append((now, tokens))
                return
            self.sleep(60 - (now - self.sent[0][0]))


class Embedder:
    """Texts to vectors of one length."""

    dim = 0

    def embed(self, texts: list[str]) -> np.ndarray:
        raise NotImplementedError


class HashEmbedder(Embedder):
    """Counts of hashed words, normalised: offline, and equal in every process."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), self.dim))
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", (t or "").lower()):
                h = zlib.crc32(w.encode())
                out[i, h % self.dim] += 1 if h >> 16 & 1 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)


class FixedEmbedder(Embedder):
    """Vectors known beforehand, by text; an unknown text raises."""

    def __init__(self, vectors: dict[str, list[float]]):
        self.vectors = {k: np.asarray(v, dtype=float) for k, v in vectors.items()}
        self.dim = len(next(iter(self.vectors.values()))) if vectors else 0

    def embed(self, texts: list[str]) -> np.ndarray:
        return np.stack([self.vectors[t] for t in texts]) if texts else np.zeros((0, self.dim))


class HttpEmbedder(Embedder):
    """An embeddings endpoint over HTTP ({"model", "input"} to {"data": [{"index", "embedding"}]}); texts over the limit are cut."""

    def __init__(self, url: str, model: str, key: str = "", dim: int = 0, max_batch: int = 64, max_chars: int = 30_000, timeout: float = 120.0):
        self.url, self.model, self.key, self.dim, self.max_batch, self.max_chars, self.timeout = url, model, key, dim, max_batch, max_chars, timeout

    def embed(self, texts: list[str]) -> np.ndarray:
        out = [self._some(texts[i : i + self.max_batch]) for i in range(0, len(texts), self.max_batch)]
        return np.concatenate(out) if out else np.zeros((0, self.dim))

    def _some(self, texts: list[str]) -> np.ndarray:
        from urllib.request import Request, urlopen

        body = json.dumps({"model": self.model, "input": [t[: self.max_chars] or " " for t in texts]}).encode()
        got = json.loads(urlopen(Request(self.url, body, {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"}), timeout=self.timeout).read())
        return np.array([d["embedding"] for d in sorted(got["data"], key=lambda d: d["index"])], dtype=float)


class SentenceEmbedder(Embedder):
    """A model of the sentence_transformers library, where that is installed; loaded in each worker once."""

    def __init__(self, name: str, normalise: bool = True, max_batch: int = 64):
        self.name, self.normalise, self.max_batch, self._model = name, normalise, max_batch, None

    def __getstate__(self):
        return self.__dict__ | {"_model": None}

    def embed(self, texts: list[str]) -> np.ndarray:
        if self._model is None:
            from sentence_transformers import SentenceTransformer

            self._model = SentenceTransformer(self.name)
        return np.asarray(self._model.encode(texts, batch_size=self.max_batch, normalize_embeddings=self.normalise), dtype=float)


class Reranker:
    """Scores of texts for a query; the rule here is the share of the query's words."""

    def score(self, query: str, texts: list[str]) -> list[float]:
        q = set(re.findall(r"\w+", query.lower()))
        return [len(q & set(re.findall(r"\w+", (t or "").lower()))) / max(1, len(q)) for t in texts]
