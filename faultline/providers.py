"""Model providers: the one place where the engine meets a model. Offline by default, HTTP when configured.

A provider answers a batch of prompts; ``answer`` runs it inside the tasks, with a bounded number of
requests in flight and retries for busy endpoints. The offline readers of ``operators.evaluate`` need no
provider.
"""

from __future__ import annotations

import json
import os
import random
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

# Answers of an endpoint that are worth another try.
RETRYABLE = frozenset({408, 425, 429, 500, 502, 503, 504})
# What a busy endpoint says, whatever its code.
BUSY = ("queue_age", "queue full", "overloaded", "too many requests", "rate limit", "capacity", "try again")


class Busy(Exception):
    """An endpoint that answers without a choice because it is busy."""


def is_busy(text: str | None) -> bool:
    return any(mark in (text or "").lower() for mark in BUSY)


def resolve(value: str | None, *names: str, default: str | None = None) -> str | None:
    """The value given, else that of the first of these environment variables that is set, else the default."""
    return (value or next((os.environ[n] for n in names if os.environ.get(n)), None) or default or "").strip() or None


@dataclass(frozen=True)
class Endpoint:
    """A chat endpoint of the common completion format; the key is read from the environment inside the task."""

    url: str
    model: str
    key_variable: str = "CHAT_API_KEY"
    temperature: float = 0.0
    max_tokens: int = 256
    attempts: int = 5
    base_delay: float = 2.0
    concurrency: int = 8

    def request(self, prompt: str, system: str = "") -> str:
        messages = [{"role": "system", "content": system}] * bool(system) + [{"role": "user", "content": prompt}]
        body = json.dumps({"model": self.model, "messages": messages, "temperature": self.temperature, "max_tokens": self.max_tokens}).encode()
        base = self.url.rstrip("/").removesuffix("/v1")
        call = urllib.request.Request(f"{base}/v1/chat/completions", body, {"Content-Type": "application/json", "Authorization": f"Bearer {os.environ.get(self.key_variable, '')}"})
        with urllib.request.urlopen(call, timeout=120) as response:
            said = json.load(response)
        if not said.get("choices"):
            raise Busy(json.dumps(said)[:500]) if is_busy(json.dumps(said)[:500]) else ValueError("an answer without choices")
        return said["choices"][0]["message"]["content"] or ""

    def complete(self, prompt: str, system: str = "", request: Callable[[str, str], str] | None = None, sleep: Callable[[float], None] = time.sleep) -> str:
        """One answer, with growing delays (a quarter either way, a minute at most) between attempts."""
        for attempt in range(self.attempts):
            try:
                return (request or self.request)(prompt, system)
            except urllib.error.HTTPError as e:
                said = e.read()[:500].decode(errors="replace") if e.fp else ""
                if not (e.code in RETRYABLE or is_busy(said)) or attempt + 1 == self.attempts:
                    raise
                wait = e.headers.get("Retry-After") if e.headers else None
                delay = float(wait) if wait and wait.replace(".", "", 1).isdigit() else self.base_delay * 2**attempt * random.uniform(0.75, 1.25)
            except (urllib.error.URLError, TimeoutError, Busy):
                if attempt + 1 == self.attempts:
                    raise
                delay = self.base_delay * 2**attempt * random.uniform(0.75, 1.25)
            sleep(min(delay, 60.0))
        raise RuntimeError("no attempt was made")


def _asked(prompts: DataFrame, ask: Callable[[str], tuple], kinds: dict[str, pa.DataType], ddl: str, concurrency: int, prompt_column: str) -> DataFrame:
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema.fields)
    names, at = [*prompts.columns, *kinds], prompts.columns.index(prompt_column)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(max(concurrency, 1)) as pool:
            for batch in batches:
                found = list(pool.map(ask, batch.column(at).to_pylist()))
                columns = zip(*found) if found else [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(list(c), t) for c, t in zip(columns, kinds.values()))], names)

    return prompts.mapInArrow(work, f"{schema}, {ddl}")


def answer(prompts: DataFrame, complete: Callable[..., str], concurrency: int = 8, prompt_column: str = "prompt", system: str | None = None) -> DataFrame:
    """All columns, with ``answer`` and ``error`` (null if there was an answer; the answer is empty otherwise)."""

    def one(prompt: str | None) -> tuple[str, str | None]:
        try:
            return complete(prompt or "") if system is None else complete(prompt or "", system), None
        except Exception as e:  # noqa: BLE001  an outage is a row with an error, not a lost partition
            return "", f"request_error: {type(e).__name__}: {e}"[:500] if system is not None else f"{type(e).__name__}: {e}"[:500]

    return _asked(prompts, one, {"answer": pa.string(), "error": pa.string()}, "answer string, error string", concurrency, prompt_column)


def answer_json(prompts: DataFrame, complete: Callable[[str, str], str], system: str = "", flags: tuple[str, ...] = (), numbers: tuple[str, ...] = (), concurrency: int = 8, prompt_column: str = "prompt") -> DataFrame:
    """All columns, with ``answer``, ``error`` (request_error or json_parse_error) and ``data``, the object as a map of
    texts. ``flags`` become true or false by their truth (any text but the empty one is true) and ``numbers``
    numbers; absent ones stay absent. A row with a null prompt is not asked."""

    def one(prompt: str | None) -> tuple[str | None, str | None, list | None]:
        if prompt is None:
            return None, None, None
        try:
            said = complete(prompt, system)
        except Exception as e:  # noqa: BLE001
            return "", f"request_error: {type(e).__name__}: {e}"[:500], None
        if not (found := extract_json(said)):
            return said, "json_parse_error", None
        try:
            shown = {k: str(bool(v)).lower() if k in flags else str(float(v or 0)) if k in numbers else str(v) for k, v in found.items() if v is not None}
        except (TypeError, ValueError):
            return said, "json_parse_error", None
        return said, None, list(shown.items())

    kinds = {"answer": pa.string(), "error": pa.string(), "data": pa.map_(pa.string(), pa.string())}
    return _asked(prompts, one, kinds, "answer string, error string, data map<string,string>", concurrency, prompt_column)


def extract_json(text: str) -> dict | None:
    """The object of a fenced block, of the whole text, or of the first balanced braces; else None."""
    fenced = re.search(r"```(?:json)?\s*(\{.*?\})\s*```", text or "", re.S)
    tries = [fenced[1]] if fenced else []
    tries.append((text or "").strip())
    start = (text or "").find("{")
    depth = 0
    for k in range(start, len(text or "")) if start >= 0 else ():
        depth += {"{": 1, "}": -1}.get(text[k], 0)
        if not depth:
            tries.append(text[start : k + 1])
            break
    for part in tries:
        try:
            if isinstance(found := json.loads(part), dict):
                return found
        except ValueError:
            continue
    return None
