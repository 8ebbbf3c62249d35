"""User code in a child process: checked before it runs, bounded in time and memory, and unable to take its task along.

Each Python worker keeps one child. A symbol's bars go to it as one framed message and its decisions come back as another, in JSON, so
nothing that user code makes is unpickled. A child that loops, crashes or needs too much memory is killed; its symbol is reported and
the next symbol gets a new child. This bounds accidents; it is no sandbox against hostile code, which may still read what the user may.
"""

from __future__ import annotations

import ast
import atexit
import json
import os
import select
import struct
import subprocess
import sys
import time
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame

from barspark.operators.strategy import CUSTOM, Costs, Strategy, decisions

#: What a strategy may import, and calls that have no place in one.
MODULES = {"math", "statistics", "numpy", "pandas", "datetime", "collections", "itertools", "functools"}
FORBIDDEN = {"exec", "eval", "compile", "open", "__import__", "input", "breakpoint", "globals", "locals", "vars", "exit", "quit"}
SCRIPT_CALLS = {"run_pending", "sleep", "login", "schedule"}


def problems(source: str) -> list[str]:
    """What speaks against running a source, found without running it; an empty list if nothing does."""
    if not (source or "").strip():
        return ["there is no code; define on_bar(ctx)"]
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError) as e:
        return [f"line {getattr(e, 'lineno', '?')}: {getattr(e, 'msg', e)}"]
    out = []
    handlers = [x for x in tree.body if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef) and x.name == "on_bar"]
    if not handlers:
        out.append("on_bar(ctx) is missing at the outermost level")
    elif isinstance(handlers[-1], ast.AsyncFunctionDef):
        out.append("on_bar is a plain function")
    elif not (handlers[-1].args.posonlyargs or handlers[-1].args.args or handlers[-1].args.vararg):
        out.append("on_bar takes ctx")
    for x in tree.body:
        if isinstance(x, ast.While):
            out.append(f"line {x.lineno}: a loop outside of functions")
        elif isinstance(x, ast.If) and any(isinstance(n, ast.Name) and n.id == "__name__" for n in ast.walk(x.test)):
            out.append(f"line {x.lineno}: a script's main block")
    for x in ast.walk(tree):
        if isinstance(x, ast.Import | ast.ImportFrom):
            names = [a.name for a in x.names] if isinstance(x, ast.Import) else [x.module or "."]
            out += [f"line {x.lineno}: import of {n}" for n in names if n.split(".")[0] not in MODULES]
        elif isinstance(x, ast.Attribute) and x.attr.startswith("__"):
            out.append(f"line {x.lineno}: use of {x.attr}")
        elif isinstance(x, ast.Name) and x.id in FORBIDDEN:
            out.append(f"line {x.lineno}: use of {x.id}")
        elif isinstance(x, ast.Call):
            called = x.func.attr if isinstance(x.func, ast.Attribute) else getattr(x.func, "id", "")
            if called in SCRIPT_CALLS:
                out.append(f"line {x.lineno}: call of {called}")
    return sorted(set(out))


@dataclass(frozen=True)
class Limits:
    """For one symbol: seconds of clock and of CPU, and bytes of memory of the child besides what it has to begin with."""

    seconds: float = 30.0
    memory: int = 1 << 30


class Fault(Exception):
    """Why a child gave no decisions."""


class Child:
    """A process that answers frames: four bytes of length, then JSON."""

    def __init__(self, limits: Limits):
        self.limits = limits
        env = {k: os.environ[k] for k in ("PATH", "LANG", "LC_ALL", "LD_LIBRARY_PATH", "HOME") if k in os.environ}
        env |= {"PYTHONPATH": os.pathsep.join(p for p in sys.path if p), "OMP_NUM_THREADS": "1", "OPENBLAS_NUM_THREADS": "1"}
        self.process = subprocess.Popen([sys.executable, "-c", "from barspark.operators.isolated import serve; serve()"], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, env=env, start_new_session=True)
        self._send({"seconds": limits.seconds, "memory": limits.memory})
        if self._receive(time.monotonic() + 60) != {"ready": True}:
            raise Fault("the child did not start")

    def _send(self, message: dict) -> None:
        data = json.dumps(message).encode()
        try:
            self.process.stdin.write(struct.pack(">I", len(data)) + data)
            self.process.stdin.flush()
        except BrokenPipeError as e:
            raise Fault("the child has ended") from e

    def _read(self, n: int, until: float) -> bytes:
        data = b""
        while len(data) < n:
            left = until - time.monotonic()
            if left <= 0 or not select.select([self.process.stdout], [], [], left)[0]:
                raise Fault(f"no answer within {self.limits.seconds:g} seconds")
            part = os.read(self.process.stdout.fileno(), min(1 << 20, n - len(data)))
            if not part:
                raise Fault(f"the child ended with code {self.process.wait(5)}")
            data += part
        return data

    def _receive(self, until: float) -> dict:
        (n,) = struct.unpack(">I", self._read(4, until))
        return json.loads(self._read(n, until))

    def ask(self, message: dict) -> dict:
        self._send(message)
        return self._receive(time.monotonic() + self.limits.seconds)

    def kill(self) -> None:
        self.process.kill()
        self.process.wait()
        self.process.stdin.close()
        self.process.stdout.close()


def serve() -> None:
    """The child: answers requests until its parent is gone. What user code prints goes nowhere."""
    import resource

    inward, outward = os.fdopen(os.dup(0), "rb"), os.fdopen(os.dup(1), "wb")
    os.dup2(os.open(os.devnull, os.O_RDWR), 1)

    def answer(message: dict) -> None:
        data = json.dumps(message).encode()
        outward.write(struct.pack(">I", len(data)) + data)
        outward.flush()

    def request() -> dict | None:
        head = inward.read(4)
        return json.loads(inward.read(struct.unpack(">I", head)[0])) if len(head) == 4 else None

    limits = request()
    with open("/proc/self/statm") as f:
        used = int(f.read().split()[0]) * resource.getpagesize()
    resource.setrlimit(resource.RLIMIT_AS, (used + limits["memory"],) * 2)
    resource.setrlimit(resource.RLIMIT_CORE, (0, 0))
    answer({"ready": True})
    while (asked := request()) is not None:
        bars = pd.DataFrame(asked["bars"])
        bars["ts"] = pd.to_datetime(bars["ts"], unit="us")
        own = asked["strategy"]
        costs = own.pop("costs")
        try:
            rows = decisions(bars, asked["source"], asked["params"], Strategy(**_tuples(own), costs=None if costs is None else Costs(**costs)))
            answer({"rows": [(t.value // 1000, *rest) for t, *rest in rows]})
        except MemoryError:
            answer({"fault": "out of memory"})
        except BaseException as e:  # noqa: BLE001  whatever user code raises, SystemExit too, is its own
            answer({"fault": f"{type(e).__name__}: {e}"[:500]})


def _tuples(own: dict) -> dict:
    return {k: tuple(tuple(x) if isinstance(x, list) else x for x in v) if isinstance(v, list) else v for k, v in own.items()}


_CHILD: dict[Limits, Child] = {}
atexit.register(lambda: [c.kill() for c in _CHILD.values()])


def run_isolated(bars: DataFrame, source: str, params: dict | None = None, s: Strategy | None = None, limits: Limits = Limits()) -> DataFrame:
    """symbol, ts, decision, actions, price as run_custom() gives them, and fault: null, or why a symbol has no decisions.

    A source with problems() raises before anything runs. A symbol whose child loops, crashes or runs out of memory gives one row with a fault, a null
    decision and the time of its last bar; other symbols go on. params are values that JSON has. Fewer than three bars give no decisions.
    """
    if found := problems(source):
        raise ValueError("; ".join(found))
    own, params = asdict(s or CUSTOM), dict(params or {})
    kinds = {f.name: f.dataType.simpleString() for f in bars.schema.fields}
    columns = ["symbol", "ts", "decision", "actions", "price", "fault"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", ignore_index=True)
        symbol, times = pdf["symbol"].iloc[0], pd.to_datetime(pdf["ts"])
        us = times.astype("datetime64[us]").astype("int64").tolist()
        at = dict(zip(us, pdf["ts"], strict=True))
        values = {c: [None if v != v else float(v) for v in pdf[c]] for c in ("open", "high", "low", "close", "volume")}
        try:
            child = _CHILD.get(limits)
            if child is None or child.process.poll() is not None:
                child = _CHILD[limits] = Child(limits)
            answer = child.ask({"bars": {"ts": us, **values}, "source": source, "params": params, "strategy": own})
            if "fault" in answer:
                raise Fault(answer["fault"])
            rows = [(symbol, at[t], *rest, None) for t, *rest in answer["rows"]]
        except (Fault, ValueError, KeyError) as e:
            if (child := _CHILD.pop(limits, None)) is not None:
                child.kill()
            rows = [(symbol, pdf["ts"].iloc[-1], None, None, None, str(e))]
        return pd.DataFrame(rows, columns=columns, dtype=object)

    wanted = bars.select("symbol", "ts", "open", "high", "low", "close", "volume")
    return wanted.groupBy("symbol").applyInPandas(run, f"symbol {kinds['symbol']}, ts {kinds['ts']}, decision string, actions string, price double, fault string")
