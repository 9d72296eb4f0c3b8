"""Tools and the agent loop; runs inside a worker, so everything pickles."""

from __future__ import annotations

import inspect
import json
import subprocess
import sys
import tempfile
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path


@dataclass
class Tool:
    """A named function with a description and the names and types of its arguments."""

    name: str
    description: str
    fn: Callable
    args: dict[str, str] = field(default_factory=dict)

    def run(self, **kwargs) -> str:
        unknown = set(kwargs) - set(self.args)
        if unknown:
            raise TypeError(f"{self.name} has no argument {sorted(unknown)}")
        return str(self.fn(**kwargs))


def tool(name: str | None = None, description: str | None = None):
    """Make a Tool of a function, from its signature and docstring."""

    def wrap(fn: Callable) -> Tool:
        kinds = {k: getattr(p.annotation, "__name__", str(p.annotation)) for k, p in inspect.signature(fn).parameters.items()}
        return Tool(name or fn.__name__, description or (fn.__doc__ or "").strip(), fn, kinds)

    return wrap


@dataclass
class ExecResult:
    stdout: str
    stderr: str
    code: int


class LocalSandbox:
    """Code in a process of its own, in a temporary folder, under a time limit (code 124 beyond it)."""

    def __init__(self, timeout: float = 30.0):
        self.timeout = timeout

    def run_code(self, code: str, files: dict[str, str] | None = None) -> ExecResult:
        with tempfile.TemporaryDirectory() as folder:
            for name, body in (files or {}).items():
                Path(folder, Path(name).name).write_text(body)
            try:
                done = subprocess.run([sys.executable, "-I", "-c", code], cwd=folder, capture_output=True, text=True, timeout=self.timeout)
            except subprocess.TimeoutExpired:
                return ExecResult("", "time limit", 124)
            return ExecResult(done.stdout, done.stderr, done.returncode)


class DockerSandbox(LocalSandbox):
    """Code in a new container without network, its folder mounted; needs the docker command where it runs."""

    def __init__(self, image: str = "python:3.12-slim", timeout: float = 60.0, memory: str = "512m", command: str = "docker"):
        super().__init__(timeout)
        self.image, self.memory, self.command = image, memory, command

    def run_code(self, code: str, files: dict[str, str] | None = None) -> ExecResult:
        with tempfile.TemporaryDirectory() as folder:
            for name, body in (files or {}).items():
                Path(folder, Path(name).name).write_text(body)
            ask = [self.command, "run", "--rm", "--network=none", f"--memory={self.memory}", f"--volume={folder}:/work", "--workdir=/work", self.image, "python", "-I", "-c", code]
            try:
                done = subprocess.run(ask, capture_output=True, text=True, timeout=self.timeout)
            except subprocess.TimeoutExpired:
                return ExecResult("", "time limit", 124)
            except FileNotFoundError:
                return ExecResult("", f"{self.command} isn't there", 127)
            return ExecResult(done.stdout, done.stderr, done.returncode)


def python_tool(sandbox: LocalSandbox | None = None) -> Tool:
    box = sandbox or LocalSandbox()

    def run_python(code: str) -> str:
        got = box.run_code(code)
        return got.stdout if got.code == 0 else f"{got.stdout}\n{got.stderr}\nexit code {got.code}"

    return Tool("python", "Run Python code and return what it prints.", run_python, {"code": "str"})


@dataclass
class AgentResult:
    text: str
    trace: list[dict]
    completions: int


def run_agent(complete: Callable[[list[dict], list[Tool]], dict], tools: list[Tool], system: str, user: str, max_steps: int = 6) -> AgentResult:
    """Completions and tool calls in turn; after max_steps one answer without tools is asked for.

    ``complete`` returns {"text": …} or {"tool": name, "arguments": {…}} (or a list of such calls
    under "calls").  A tool's error is told to the agent.
    """
    known = {t.name: t for t in tools}
    chat = [{"role": "system", "content": system}, {"role": "user", "content": user}]
    trace: list[dict] = []
    for step in range(max_steps):
        said = complete(chat, tools)
        calls = said.get("calls") or ([said] if "tool" in said else [])
        if not calls:
            return AgentResult(said.get("text", ""), trace, step + 1)
        for call in calls:
            args = call.get("arguments") or {}
            try:
                result = known[call["tool"]].run(**args) if call["tool"] in known else f"error: no tool {call['tool']}"
            except Exception as wrong:  # told to the agent, which may try otherwise
                result = f"error: {type(wrong).__name__}: {wrong}"
            trace.append({"tool": call["tool"], "arguments": json.dumps(args, sort_keys=True), "result": result})
            chat += [{"role": "assistant", "content": json.dumps(call, sort_keys=True)}, {"role": "tool", "content": result}]
    said = complete([*chat, {"role": "user", "content": "Answer now, without tools."}], [])
    return AgentResult(said.get("text", ""), trace, max_steps + 1)
