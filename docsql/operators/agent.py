"""Tools with declared inputs, a registry of them, and the loop of a model that calls them.

A conversation is driven step by step; what the loop keeps between steps are the calls made so far and the citations.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsql.functions.text import PROMISES, safe_json

REMINDER = "You said you would call a tool but did not call it. Call it now, or answer if no call is needed."
_promise = re.compile(PROMISES, re.I)
_kinds = {T.StringType: str, T.BooleanType: bool, T.IntegerType: int, T.LongType: int, T.DoubleType: (int, float), T.FloatType: (int, float)}


def invalid(value: object, kind: T.DataType, path: str = "input") -> list[str]:
    """What is wrong with a JSON value against a declared type; unknown fields count as wrong."""
    if value is None:
        return [f"{path} is missing"]
    if isinstance(kind, T.StructType):
        if not isinstance(value, dict):
            return [f"{path} is no object"]
        names = {f.name for f in kind}
        wrong = [f"{path}.{k} is unknown" for k in value if k not in names]
        for f in kind:
            if value.get(f.name) is not None or not f.nullable:
                wrong += invalid(value.get(f.name), f.dataType, f"{path}.{f.name}")
        return wrong
    if isinstance(kind, T.ArrayType):
        return [w for i, v in enumerate(value) for w in invalid(v, kind.elementType, f"{path}[{i}]")] if isinstance(value, list) else [f"{path} is no list"]
    wanted = _kinds.get(type(kind), object)
    good = isinstance(value, wanted) and (wanted is bool or not isinstance(value, bool))
    return [] if good else [f"{path} is no {kind.simpleString()}"]


@dataclass(frozen=True)
class Tool:
    """input: a DDL schema of the fields (`not null` for the required ones). shape turns the result into what the model sees."""

    name: str
    input: T.StructType
    execute: Callable[[dict], object]
    needs_approval: bool = False
    shape: Callable[[object], object] = lambda x: x

    def call(self, given: object, approve: Callable[[str, object], bool] = lambda *_: True) -> tuple[object, bool]:
        """(result, failed): a wrong input, a refusal and an exception are results as well."""
        wrong = invalid(given, self.input)
        if wrong:
            return {"error": "invalid input: " + "; ".join(wrong)}, True
        if self.needs_approval and not approve(self.name, given):
            return {"error": "the user declined this call"}, True
        try:
            return self.shape(self.execute(given)), False
        except Exception as x:  # noqa: BLE001 - the model is told
            return {"error": f"{type(x).__name__}: {x}"}, True

    def column(self) -> Callable[[Column], Column]:
        """The tool over a Column of JSON inputs: struct<output, failed>; rows with a wrong input are marked, not dropped."""

        @F.pandas_udf("output string, failed boolean")
        def run(inputs: pd.Series) -> pd.DataFrame:
            rows = []
            for text in inputs:
                try:
                    given = json.loads(text) if text is not None else None
                except ValueError as x:
                    rows.append((safe_json({"error": f"no JSON: {x}"}), True))
                    continue
                out, failed = self.call(given)
                rows.append((safe_json(out), failed))
            return pd.DataFrame(rows, columns=["output", "failed"])

        return run


class Registry:
    """Tools by name, in groups that can be switched on; a name can be taken once."""

    def __init__(self) -> None:
        self.groups: dict[str, list[Tool]] = {}
        self.active: set[str] = set()

    def add(self, group: str, tools: list[Tool], lazy: bool = False) -> None:
        taken = {t.name: g for g, ts in self.groups.items() for t in ts}
        for t in tools:
            if t.name in taken:
                raise ValueError(f"tool {t.name} of {group} is already one of {taken[t.name]}")
            taken[t.name] = group
        self.groups[group] = tools
        if not lazy:
            self.active.add(group)

    def activate(self, group: str) -> None:
        if group not in self.groups:
            raise KeyError(group)
        self.active.add(group)

    def tools(self) -> dict[str, Tool]:
        return {t.name: t for g, ts in self.groups.items() if g in self.active for t in ts}


@dataclass
class Ledger:
    """Numbers citations by their first appearance in a run: a passage of a document is one, as often as it comes."""

    numbers: dict[tuple, int] = field(default_factory=dict)

    def cite(self, document: str, chunk: object, content: str) -> int:
        key = (document, chunk) if chunk is not None else (document, None, content)
        return self.numbers.setdefault(key, len(self.numbers) + 1)


def run(model: Callable[[list[dict]], dict], registry: Registry, history: list[dict], most_steps: int = 8, approve: Callable[[str, object], bool] = lambda *_: True) -> Iterator[dict]:
    """Messages that a run adds to the history, and at last how it finished.

    model: history to {"content", "toolCalls": [{"id", "name", "input"}]}. A call like the one before it, or made more than
    twice in all, is answered without running it. A text that only promises a call, after tools were used since the last
    question, is followed by one reminder.
    """
    seen: dict[str, int] = {}
    last, reminded = None, False
    for step in range(1, most_steps + 1):
        reply = {"role": "assistant"} | model(history)
        history.append(reply)
        yield reply
        calls = reply.get("toolCalls") or []
        if not calls:
            since = next((i for i in range(len(history) - 1, -1, -1) if history[i]["role"] == "user" and not history[i].get("synthetic")), -1)
            if not reminded and step < most_steps and _promise.search(reply.get("content") or "") and any(m["role"] == "tool" for m in history[since + 1 :]):
                reminded = True
                history.append({"role": "user", "content": REMINDER, "synthetic": True})
                yield history[-1]
                continue
            yield {"role": "finish", "reason": "stop", "steps": step}
            return
        for c in calls:
            signature = f"{c['name']}:{safe_json(c['input'])}"
            seen[signature] = seen.get(signature, 0) + 1
            repeated, last = signature == last or seen[signature] > 2, signature
            tool = registry.tools().get(c["name"])
            if repeated:
                out, failed = {"error": f"{c['name']} was already called with these arguments; its result is above"}, True
            elif tool is None:
                out, failed = {"error": f"there is no tool {c['name']}"}, True
            else:
                out, failed = tool.call(c["input"], approve)
            history.append({"role": "tool", "toolCallId": c["id"], "name": c["name"], "content": safe_json(out), "isError": failed})
            yield history[-1]
    yield {"role": "finish", "reason": "max-steps", "steps": most_steps}
