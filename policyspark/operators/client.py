"""A model behind HTTP: checks before a run, streamed answers, errors by kind, several workers; as a ModelFn it runs in any task."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import pandas as pd

from policyspark.operators.model import ModelFn, Options

# Settings of sampling and their bounds, beside those of Options.
SAMPLING = {"top_k": (1, 1000), "top_p": (0.0, 1.0), "min_p": (0.0, 1.0), "repeat_penalty": (0.0, 2.0), "seed": (0, 2**31 - 1), "num_batch": (1, 4096)}
SHARED_WORKERS = 3


class ModelError(ValueError):
    """kind: connection, timeout, cancelled, context limit, output limit, invalid JSON, schema, grammar, model."""

    def __init__(self, kind: str, text: str = ""):
        super().__init__(f"{kind}: {text}" if text else kind)
        self.kind = kind


def sampling(settings: dict) -> dict:
    """Sampling settings within their bounds; unknown names and values out of bounds raise."""
    for name, value in settings.items():
        if name not in SAMPLING:
            raise ValueError(f"unknown sampling setting {name}")
        low, high = SAMPLING[name]
        if isinstance(value, bool) or not isinstance(value, int | float) or not low <= value <= high:
            raise ValueError(f"{name} has to lie in {low} to {high}")
    return dict(settings)


@dataclass(frozen=True)
class Endpoint:
    """Where a model is served, and how it is asked."""

    url: str
    model: str
    options: Options = field(default_factory=Options)
    sampling: tuple[tuple[str, float], ...] = ()
    think: bool | None = None
    digest: str | None = None
    schema: str | None = None  # a JSON schema the answer has to follow, or `json`

    def settings(self) -> dict:
        """Everything an answer depends on, for fingerprints and metadata."""
        return {"url": self.url, "model": self.model, "digest": self.digest, "think": self.think, "schema": self.schema, "context": self.options.context, "output": self.options.output, "temperature": self.options.temperature, **dict(self.sampling)}


def _call(url: str, body: dict | None, timeout: float) -> object:
    data = None if body is None else json.dumps(body).encode()
    try:
        return urllib.request.urlopen(urllib.request.Request(url, data, {"Content-Type": "application/json"}), timeout=timeout)
    except urllib.error.HTTPError as e:
        text = e.read(2000).decode("utf-8", "replace")
        if e.code == 400 and "failed to parse grammar" in text:
            raise ModelError("grammar", text) from e
        raise ModelError("context limit" if "context" in text and "exceed" in text else "model", f"{e.code} {text}") from e
    except TimeoutError as e:
        raise ModelError("timeout") from e
    except OSError as e:
        raise ModelError("connection", str(e)) from e


def preflight(endpoint: Endpoint, timeout: float = 10) -> Endpoint:
    """endpoint with the digest of its model, which has to be listed there, and whether thinking can be switched."""
    with _call(endpoint.url.rstrip("/") + "/api/tags", None, timeout) as r:
        listed = {m.get("name"): m.get("digest") for m in json.load(r).get("models", [])}
    if endpoint.model not in listed or not listed[endpoint.model]:
        raise ModelError("model", f"{endpoint.model} is not installed")
    if endpoint.digest and endpoint.digest != listed[endpoint.model]:
        raise ModelError("model", f"{endpoint.model} is not the one a run began with")
    with _call(endpoint.url.rstrip("/") + "/api/show", {"model": endpoint.model}, timeout) as r:
        can = json.load(r).get("capabilities") or []
    return replace(endpoint, digest=listed[endpoint.model], think=endpoint.think if "thinking" in can else None)


def generate(endpoint: Endpoint, prompt: str, form: str | None = None, cancelled: Callable[[], bool] = lambda: False, output: int | None = None) -> tuple[str, dict]:
    """(text, usage) of one streamed answer. Nothing is cut in silence: an answer that ends by length is an error, and so is one that runs out of time or is cancelled."""
    o, began = endpoint.options, time.monotonic()
    form = form if form is not None else endpoint.schema
    body = {"model": endpoint.model, "prompt": prompt, "stream": True, "options": {"temperature": o.temperature, "num_ctx": o.context, "num_predict": output or o.output, **dict(endpoint.sampling)}}
    if endpoint.think is not None:
        body["think"] = endpoint.think
    if form:
        body["format"] = form if form == "json" else json.loads(form)
    parts, last = [], {}
    with _call(endpoint.url.rstrip("/") + "/api/generate", body, o.timeout) as r:
        for line in r:
            if cancelled():
                raise ModelError("cancelled")
            if time.monotonic() - began > o.timeout:
                raise ModelError("timeout")
            try:
                last = json.loads(line)
            except ValueError as e:
                raise ModelError("invalid JSON", "in the stream") from e
            if "error" in last:
                raise ModelError("context limit" if "context" in last["error"] else "model", last["error"])
            parts.append(last.get("response", ""))
    if not last.get("done"):
        raise ModelError("connection", "the answer broke off")
    if last.get("done_reason") == "length":
        raise ModelError("output limit")
    usage = {"tokens_in": last.get("prompt_eval_count", 0), "tokens_out": last.get("eval_count", 0), "seconds": time.monotonic() - began}
    if usage["tokens_in"] >= o.context:
        raise ModelError("context limit")
    return "".join(parts), usage


def answer(endpoint: Endpoint, prompt: str, check: Callable[[object], list[str]] = lambda _: [], cancelled: Callable[[], bool] = lambda: False) -> tuple[object, dict, Endpoint]:
    """(value, usage, endpoint) of one answer as JSON that `check` finds no fault in.

    An endpoint that can't read the schema is asked for plain JSON, now and from then on; an answer
    that ran into the output limit is asked for once more with twice the room, if the context has it.
    """
    need = len(prompt.encode()) + (len(endpoint.schema or "") if endpoint.schema != "json" else 0)
    if need > endpoint.options.bytes:
        raise ModelError("context limit", f"{need} bytes of request, room for {endpoint.options.bytes}")
    room = endpoint.options.output
    for _ in range(3):
        try:
            text, usage = generate(endpoint, prompt, cancelled=cancelled, output=room)
            break
        except ModelError as e:
            if e.kind == "grammar" and endpoint.schema not in (None, "json"):
                endpoint = replace(endpoint, schema="json")
            elif e.kind == "output limit" and room == endpoint.options.output and 2 * room + 1024 < endpoint.options.context:
                room *= 2
            else:
                raise
    else:
        raise ModelError("output limit")
    try:
        value = json.loads(text)
    except ValueError as e:
        raise ModelError("invalid JSON", str(e)) from e
    if faults := check(value):
        raise ModelError("schema", "; ".join(faults)[:500])
    return value, usage, endpoint


def unload(endpoint: Endpoint, patience: float = 5) -> bool:
    """Asks for the model to be let go and whether, within patience, it was."""
    _call(endpoint.url.rstrip("/") + "/api/generate", {"model": endpoint.model, "keep_alive": 0}, patience).close()
    until = time.monotonic() + patience
    while time.monotonic() < until:
        with _call(endpoint.url.rstrip("/") + "/api/ps", None, patience) as r:
            if endpoint.model not in {m.get("name") for m in json.load(r).get("models", [])}:
                return True
        time.sleep(0.2)
    return False


@dataclass(frozen=True)
class Pool:
    """Endpoints of one and the same model; a task is served by the one its partition number picks."""

    endpoints: tuple[Endpoint, ...]
    shared: bool = False

    def __post_init__(self) -> None:
        if not 1 <= len(self.endpoints) <= 32:
            raise ValueError("a pool has 1 to 32 endpoints")
        if len({e.url.rstrip("/") for e in self.endpoints}) != len(self.endpoints):
            raise ValueError("endpoints of a pool are different")
        if len({(e.model, e.digest) for e in self.endpoints}) > 1:
            raise ValueError("endpoints of a pool serve the same model")
        if self.shared and sum(e.options.workers for e in self.endpoints) > SHARED_WORKERS:
            raise ValueError(f"shared endpoints take {SHARED_WORKERS} workers at most")

    def checked(self) -> Pool:
        return replace(self, endpoints=tuple(map(preflight, self.endpoints)))

    def workers(self) -> int:
        return sum(e.options.workers for e in self.endpoints)

    def model(self, prompt: Callable[[str], str], check: Callable[[object], list[str]] = lambda _: []) -> ModelFn:
        """The pool as a model stage's function: prompt makes a request's text of its value. Errors are answers, so one doesn't end a task."""
        endpoints = self.endpoints

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from pyspark import TaskContext

            task = TaskContext.get()
            own = endpoints[(task.partitionId() if task else 0) % len(endpoints)]
            for batch in batches:
                rows = []
                for request, value in zip(batch["request_id"], batch["value_json"], strict=True):
                    try:
                        found, _, own = answer(own, prompt(value), check)
                        rows.append((request, json.dumps(found, ensure_ascii=False), None))
                    except ModelError as e:
                        rows.append((request, None, str(e)))
                yield pd.DataFrame(rows, columns=["request_id", "answer_json", "error"])

        return run
