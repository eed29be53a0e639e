"""Tools that a model may call, and the loop around them (UDF-18 to UDF-20, STR-24, ARR-13, UDF-02)."""

from __future__ import annotations

import asyncio
import inspect
import json
import threading
from collections import deque
from collections.abc import Callable
from typing import Any, get_args, get_origin

from pagemill.functions.rewriting import tool_call

#: JSON-schema names of Python types.
TYPES = {str: "string", int: "integer", float: "number", bool: "boolean", list: "array", dict: "object"}


def json_type(annotation: Any) -> dict:
    """ARR-13: lists with the type of their items; string where nothing is known."""
    kind = get_origin(annotation) or annotation
    out: dict = {"type": TYPES.get(kind, "string") if isinstance(kind, type) else "string"}
    if get_origin(annotation) is list:
        out["items"] = json_type((get_args(annotation) or (str,))[0])
    return out


#: Fixed by custom: titles of the part of a docstring that describes arguments.
ARGUMENTS = {"args", "arguments", "parameters"}


def _depth(line: str) -> int:
    return len(line) - len(line.lstrip())


def parse_docstring(text: str | None) -> tuple[str, dict[str, str]]:
    """STR-24: the text before the first title, and the descriptions of arguments from the first part that has them.

    Read by indentation: a title is a line at the margin of words and a colon; below it, lines of the least depth open an
    entry (a name, perhaps a type in brackets, a colon) and deeper ones go on with it.
    """
    lines = inspect.cleandoc(text or "").splitlines()
    titles = [i for i, x in enumerate(lines) if x.endswith(":") and not _depth(x) and x[:-1].replace(" ", "").isalpha()]
    summary = "\n".join(lines[: titles[0]] if titles else lines).strip()
    start = next((i for i in titles if lines[i][:-1].strip().lower() in ARGUMENTS), None)
    if start is None:
        return summary, {}
    body = [x for x in lines[start + 1 : next((i for i in titles if i > start), len(lines))] if x.strip()]
    margin = min(map(_depth, body), default=0)
    entries: dict[str, list[str]] = {}
    own: list[str] = []
    for line in body:
        if _depth(line) == margin:
            typed = line.find(")") + 1 if "(" in line.partition(":")[0] else 0  # a colon within the brackets is the type's
            head, colon, rest = line[:typed] + line[typed:].partition(":")[0], *line[typed:].partition(":")[1:]
            name = head.partition("(")[0].strip()
            own = entries.setdefault(name, []) if colon and name.isidentifier() else []
            own[:] = [rest.strip()]
        else:
            own.append(line.strip())
    return summary, {name: " ".join(x for x in said if x) for name, said in entries.items()}


class Registry:
    """Functions by name; the first parameter of each is the context that the caller gives."""

    def __init__(self):
        self.functions: dict[str, Callable] = {}

    def tool(self, function: Callable) -> Callable:
        self.functions[function.__name__] = function
        return function

    def schemas(self) -> list[dict]:
        out = []
        for name, f in self.functions.items():
            summary, described = parse_docstring(f.__doc__)
            parameters = list(inspect.signature(f, eval_str=True).parameters.values())[1:]
            properties = {p.name: json_type(p.annotation) | ({"description": described[p.name]} if p.name in described else {}) for p in parameters}
            required = [p.name for p in parameters if p.default is inspect.Parameter.empty]
            out.append({"type": "function", "function": {"name": name, "description": summary, "parameters": {"type": "object", "properties": properties, "required": required}}})
        return out

    def dispatch(self, context: Any, name: str, arguments: str | dict) -> str:
        """The result as text; a failure is told as text too."""
        try:
            values = json.loads(arguments) if isinstance(arguments, str) else arguments
            found = self.functions[name](context, **values)
            return found if isinstance(found, str) else json.dumps(found, default=str)
        except Exception as e:
            return f"Error: {type(e).__name__}: {e}"


class Agent:
    """Asks the model until it calls no tool. model: messages, schemas -> message with content and tool_calls."""

    def __init__(self, model: Callable[[list[dict], list[dict]], dict], registry: Registry, context: Any, max_steps: int = 20):
        self.model, self.registry, self.context, self.max_steps = model, registry, context, max_steps
        self.messages: list[dict] = []

    def run(self, text: str) -> str:
        self.messages.append({"role": "user", "content": text})
        for _ in range(self.max_steps):
            reply = self.model(self.messages, self.registry.schemas())
            self.messages.append({"role": "assistant", **reply})
            calls = reply.get("tool_calls") or ([dict(zip(("name", "arguments"), c))] if (c := tool_call(reply.get("content"))) else [])
            if not calls:
                return reply.get("content") or ""
            for call in calls:
                self.messages.append({"role": "tool", "name": call["name"], "content": self.registry.dispatch(self.context, call["name"], call["arguments"])})
        return ""


async def gather_limited(tasks: list[Callable], limit: int) -> list:
    """UDF-02: results of coroutine functions in order. limit workers take the next task from a common queue; after a
    failure the others stop and it is raised."""
    waiting = deque(enumerate(tasks))
    out: list = [None] * len(tasks)

    async def worker():
        while waiting:
            place, task = waiting.popleft()
            out[place] = await task()

    async with asyncio.TaskGroup() as group:
        for _ in range(max(1, min(limit, len(tasks)))):
            group.create_task(worker())
    return out


def run_async(coroutine):
    """UDF-02: its result, also where a loop runs already (then in a thread)."""
    try:
        asyncio.get_running_loop()
    except RuntimeError:
        return asyncio.run(coroutine)
    out: list = []
    thread = threading.Thread(target=lambda: out.append(asyncio.run(coroutine)))
    thread.start()
    thread.join()
    return out[0]
