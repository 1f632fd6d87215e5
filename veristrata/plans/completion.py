"""The completion stage: calling a provider for every pending request, with retries.

A provider is any callable from a request to a response text.  Each attempt is
one pass over the rows still failing; its outcome is written before the next,
so a lost executor can't repeat a finished call.
"""

from __future__ import annotations

import json
import random
import re
import time
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veristrata.functions import json_schema
from veristrata.sources.scratch import new_path

#: How much of an error's body is kept, and HTTP statuses worth another try.
ERROR_BODY = 500
RETRYABLE = (408, 429, 500, 502, 503, 504)


class ProviderError(Exception):
    def __init__(self, code: str, message: str, status: int | None = None, wait: float | None = None):
        super().__init__(message[: ERROR_BODY + 100])
        self.code, self.status, self.wait = code, status, wait


@dataclass(frozen=True)
class Retry:
    """Exponential waits with jitter; a server's own wait goes first, both within ``cap`` seconds."""

    attempts: int = 3
    first: float = 0.2
    cap: float = 5.0

    def waits(self, seed: int = 0):
        rng = random.Random(seed)
        for k in range(self.attempts):
            yield min(self.cap, self.first * 2**k) * rng.uniform(0.9, 1.1)

    def run(self, call: Callable[[], str], sleep=time.sleep) -> str:
        for wait in [*self.waits(), None]:
            try:
                return call()
            except ProviderError as e:
                if wait is None or e.status not in RETRYABLE:
                    raise
                sleep(min(self.cap, e.wait) if e.wait is not None else wait)
        raise AssertionError


def retry_after(header: str | None, now: datetime) -> float | None:
    """Seconds to wait: a non-negative number, or the time until a date still to come."""
    header = (header or "").strip()
    if re.fullmatch(r"\d+", header):
        return float(header)
    try:
        left = (parsedate_to_datetime(header) - now.astimezone(UTC)).total_seconds()
    except (TypeError, ValueError):
        return None
    return left if left > 0 else None


def openai_request(model: str, system: str, user: str, schema: dict) -> dict:
    return {"model": model, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}], "response_format": {"type": "json_schema", "json_schema": {"name": "extraction", "strict": True, "schema": schema}}}


def json_object_request(model: str, system: str, user: str, schema: dict) -> dict:
    return openai_request(model, system, user, schema) | {"response_format": {"type": "json_object"}}


def tool_request(model: str, system: str, user: str, schema: dict, max_tokens: int = 4096) -> dict:
    tool = {"name": "extraction", "description": "Record the extracted values.", "input_schema": schema}
    return {
        "model": model,
        "max_tokens": max_tokens,
        "system": [{"type": "text", "text": system, "cache_control": {"type": "ephemeral"}}],
        "messages": [{"role": "user", "content": user}],
        "tools": [tool],
        "tool_choice": {"type": "tool", "name": "extraction"},
    }


def generate_content_request(system: str, user: str, schema: dict) -> dict:
    config = {"responseMimeType": "application/json", "responseSchema": json_schema.for_provider(schema)}
    return {"system_instruction": {"parts": [{"text": system}]}, "contents": [{"role": "user", "parts": [{"text": user}]}], "generationConfig": config}


def chat_text(response: Column) -> Column:
    return F.get_json_object(response, "$.choices[0].message.content")


def tool_input(response: Column) -> Column:
    """The forced tool's input; null if the first block isn't that tool."""
    return F.when(F.get_json_object(response, "$.content[0].name") == "extraction", F.get_json_object(response, "$.content[0].input"))


def candidate_text(response: Column) -> Column:
    return F.get_json_object(response, "$.candidates[0].content.parts[0].text")


def http_provider(url: str, headers: dict[str, str], request: Callable[[str], dict], timeout: float = 60.0, send=None) -> Callable[[str, int], str]:
    """A provider that posts ``request(prompt)`` as JSON and gives back the response's body.

    Statuses from 300 on are errors PROVIDER_HTTP_<status> with the body's beginning; a
    server's wait goes with them.  ``send(url, body, headers, timeout)`` gives ``(status, body, headers)``.
    """

    def call(prompt: str, attempt: int) -> str:
        try:
            body = json.dumps(request(prompt)).encode()
        except (TypeError, ValueError) as e:
            raise ProviderError("PROVIDER_REQUEST_INVALID", str(e)) from e
        try:
            status, text, said = (send or _post)(url, body, {"Content-Type": "application/json"} | headers, timeout)
        except OSError as e:
            raise ProviderError("PROVIDER_TRANSPORT_FAILED", str(e), 503) from e
        if not 200 <= status < 300:
            short = text if len(text) <= ERROR_BODY else text[:ERROR_BODY] + "...(truncated)"
            raise ProviderError(f"PROVIDER_HTTP_{status}", f"HTTP {status}: {short}", status, retry_after(said.get("Retry-After"), datetime.now(UTC)))
        try:
            json.loads(text)
        except ValueError as e:
            raise ProviderError("PROVIDER_RESPONSE_INVALID", str(e)) from e
        return text

    return call


def _post(url: str, body: bytes, headers: dict[str, str], timeout: float) -> tuple[int, str, dict]:
    from urllib import error, request

    try:
        with request.urlopen(request.Request(url, body, headers, method="POST"), timeout=timeout) as r:
            return r.status, r.read().decode("utf-8", "replace"), dict(r.headers)
    except error.HTTPError as e:
        return e.code, e.read().decode("utf-8", "replace"), dict(e.headers)


def _written(df: DataFrame) -> DataFrame:
    path = new_path(df.sparkSession, "completions")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def complete(requests: DataFrame, provider: Callable[[str, int], str], schema: dict, check: Callable[[DataFrame], DataFrame] | None = None, max_retries: int = 0, repair: bool = True, key: str = "request_id", retry: Retry | None = None) -> DataFrame:
    """``key, response, attempts, error_code, error`` for requests ``key, prompt``.

    A response that doesn't parse, breaks the schema, or fails ``check`` (which
    adds ``check_error``) is asked for again, at most ``max_retries`` times;
    with ``repair`` its errors are added to the prompt.  An error of the
    provider itself ends its request, at once or after the tries that ``retry`` allows.
    """
    kind = requests.schema[key].dataType.simpleString()

    def call(attempt: int):
        def run(batches):
            for pdf in batches:
                rows = []
                for k, prompt in zip(pdf[key], pdf["_ask"], strict=True):
                    try:
                        rows.append((k, retry.run(partial(provider, prompt, attempt)) if retry else provider(prompt, attempt), None, None))
                    except ProviderError as e:
                        rows.append((k, None, e.code, str(e)))
                yield pd.DataFrame(rows, columns=[key, "response", "provider_code", "provider_error"])

        return run

    pending, done = requests.select(key, "prompt").withColumn("_ask", F.col("prompt")), None
    for attempt in range(1, max_retries + 2):
        answers = _written(pending.select(key, "_ask").mapInPandas(call(attempt), f"`{key}` {kind}, response string, provider_code string, provider_error string"))
        errors = json_schema.validate(F.col("response"), schema)
        seen = answers.withColumn("_errors", F.when(F.col("provider_code").isNull(), errors))
        if check is not None:
            seen = check(seen)
        else:
            seen = seen.withColumn("check_error", F.lit(None).cast("string"))
        code = (
            F.when(F.col("provider_code").isNotNull(), F.col("provider_code"))
            .when(F.col("_errors").isNull(), "EXTRACTION_PARSE_FAILED")
            .when(F.size("_errors") > 0, "EXTRACTION_SCHEMA_VALIDATION_FAILED")
            .when(F.col("check_error").isNotNull(), "EXTRACTION_CONSTRAINT_FAILED")
        )
        text = F.coalesce("provider_error", F.when(F.size("_errors") > 0, F.array_join("_errors", "; ")), "check_error")
        judged = _written(seen.select(key, "response", F.lit(attempt).alias("attempts"), code.alias("error_code"), text.alias("error"), F.col("provider_code").isNotNull().alias("_final")))
        last = attempt == max_retries + 1
        ended = judged if last else judged.where(F.col("error_code").isNull() | F.col("_final"))
        ended = ended.drop("_final")
        done = ended if done is None else done.unionByName(ended)
        if last:
            break
        failing = judged.where(F.col("error_code").isNotNull() & ~F.col("_final")).select(key, "error")
        if not failing.head(1):
            break
        again = requests.select(key, "prompt").join(failing, key)
        ask = F.concat("prompt", F.lit("\n\nThe last answer was rejected: "), F.coalesce("error", F.lit("it is not JSON"))) if repair else F.col("prompt")
        pending = again.withColumn("_ask", ask).drop("error")
    return done


def canned(responses: dict[str, list[str]]) -> Callable[[str, int], str]:
    """A provider for tests: the answers of each prompt's first line, one an attempt."""

    def answer(prompt: str, attempt: int) -> str:
        given = responses[prompt.split("\n", 1)[0]]
        return given[min(attempt, len(given)) - 1]

    return answer


def load_config(text: str, environment: dict[str, str], prefix: str) -> dict[str, str]:
    """Flat ``key: value`` lines, the last of a key wins; the environment overrides."""
    out = {}
    for line in text.splitlines():
        line = line.split("#", 1)[0].strip()
        if ":" in line:
            k, v = line.split(":", 1)
            out[k.strip()] = v.strip().strip("\"'")
    return out | {k[len(prefix) :].lower(): v for k, v in environment.items() if k.startswith(prefix)}


def schema_of_model(spec: str) -> str:
    """The JSON Schema text of ``module:Model``, for models that offer one."""
    import importlib

    module, _, name = spec.partition(":")
    return json.dumps(getattr(importlib.import_module(module), name).model_json_schema())
