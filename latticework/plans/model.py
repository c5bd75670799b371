"""A chat model as a selector: prompts, the call, retries. Answers are written once, before anything reads them."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

from .selection import Selector

#: Seconds before each attempt. What a message must hold for another attempt.
DELAYS = (0.0, 5.0, 15.0)
TRANSIENT = ("429", "rate", "timeout", "connection", "overloaded", "decode", "json")

PICK = """You choose covariates for forecasting one sensor of a building. You are shown where the sensor sits: its own node, the nodes that
feed or contain it, its peers, and hosts that matter to the whole building.

Think about what drives the quantity, which points on its own node belong to it, which small group of peers behaves alike, and
where its drivers are. Prefer a tight group to a whole class. Then end your answer with one fenced json block:

```json
{"pulls": [{"anchor": "A1", "expand": "self", "point_class": "Some_Class", "reason": "why"}], "summary": "one line"}
```

anchor is a label such as A1. expand is self (points on the anchor), subtree (below it), building (that class anywhere) or cluster (the
recovered group of a sensor without a place). Leave point_class empty for all classes; building needs one."""

AUDIT = """You check another engineer's covariates for forecasting one sensor of a building. You are shown the same surroundings and the
classes chosen, with counts. Name only real gaps (a peer group or driver that is shown but missing) and real excess. End your
answer with one fenced json block:

```json
{"verdict": "ok", "add": [{"anchor": "A1", "expand": "self", "point_class": "Some_Class", "reason": "why"}], "drop": ["Some_Class"], "note": "one line"}
```

verdict is ok, with nothing to add or drop, or revise."""


def http(base_url: str, model: str, key: str = "x", max_tokens: int = 16_000, effort: str | None = None, timeout: float = 600.0) -> Callable[[str, str], str]:
    """ask(system, user) over an endpoint with chat completions, at temperature 0."""

    def ask(system: str, user: str) -> str:
        body = {"model": model, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}], "temperature": 0, "max_tokens": max_tokens}
        if effort:
            body["reasoning_effort"] = effort
        request = urllib.request.Request(f"{base_url.rstrip('/')}/chat/completions", json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            return json.load(reply)["choices"][0]["message"]["content"] or ""

    return ask


def retried(ask: Callable[[str, str], str], system: str, user: str, delays: Sequence[float] = DELAYS) -> tuple[str | None, str | None]:
    """(content, error): another attempt only after a message that names something transient; the last message, if none succeeds."""
    said = "no attempt"
    for delay in delays:
        time.sleep(delay)
        try:
            return ask(system, user), None
        except Exception as error:  # whatever the client raises: it is the answer's error
            said = f"{type(error).__name__}: {error}"
            if not any(word in said.lower() for word in TRANSIENT):
                break
    return None, said


def chat(ask: Callable[[str, str], str], system: str = PICK, delays: Sequence[float] = DELAYS) -> Selector:
    """The selector that asks about each context on the executors. ask has to be picklable; with several tasks, so many calls
    run at a time. A target's failure is its own: it gets no content and an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers = [retried(ask, system, context or "", delays) for context in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([a[i] for a in answers], pa.string()) for i in range(2))], ["target", "content", "error"])

    def selector(contexts: DataFrame) -> DataFrame:
        return contexts.select("target", "context").mapInArrow(run, "target string, content string, error string")

    return selector
