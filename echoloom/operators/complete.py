"""Calls of a pluggable completion function, as a Spark job: gates before, errors as rows, log rows after."""

from __future__ import annotations

import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type, to_arrow_type
from pyspark.sql.types import StructField, StructType

from ..schemas import COMPLETION
from .validate import screen_injection, with_token_estimate

MAX_TOKENS = 100_000
#: Waits double from 0.5 s up to this, in seconds, and all calls of one row end after BUDGET timeouts.
MAX_WAIT = 10.0
BUDGET = 3

# The classes of errors.
TIMEOUT, RATE_LIMIT, BAD_REQUEST, CONTENT_POLICY, TOO_LARGE, INJECTION, BAD_ANSWER, OTHER = (
    "LLMTimeoutError", "LLMRateLimitError", "LLMBadRequestError", "LLMContentPolicyError", "DocumentsTooLargeError", "AnalysisError", "LLMResponseError", "LLMError",
)

#: What a completion function gets: (system, user) pairs; what it gives: for each a dict with content, model, input_tokens, output_tokens and cost, or an exception.
Complete = Callable[[list[tuple[str, str]]], list]


class RateLimitError(Exception):
    """A completion function raises or returns it when it is asked too often."""


class ContentPolicyError(Exception):
    """The provider refused the text."""


def error_class(e: BaseException) -> str:
    for kind, name in ((TimeoutError, TIMEOUT), (RateLimitError, RATE_LIMIT), (ContentPolicyError, CONTENT_POLICY), (ValueError, BAD_REQUEST)):
        if isinstance(e, kind):
            return name
    return OTHER


def _answer(got, seconds: float) -> dict:
    row = {"content": None, "model": "", "input_tokens": 0, "output_tokens": 0, "cost": 0.0, "status": "error", "error_class": None, "duration_ms": int(seconds * 1000)}
    if isinstance(got, BaseException):
        return row | {"error_class": error_class(got)}
    if not isinstance(got, dict) or not isinstance(got.get("content"), str) or got.get("input_tokens") is None or got.get("output_tokens") is None:
        return row | {"error_class": BAD_ANSWER}
    return row | {"content": got["content"], "model": got.get("model") or "", "input_tokens": int(got["input_tokens"]), "output_tokens": int(got["output_tokens"]), "cost": float(got.get("cost") or 0.0), "status": "ok"}


def call_with_retries(fn: Complete, messages: list[tuple[str, str]], timeout: float, sleep=time.sleep) -> list[dict]:
    """Answers for all messages. Only timeouts and rate limits are tried again."""
    began, wait = time.monotonic(), 0.5
    out: list = [None] * len(messages)
    todo = list(range(len(messages)))
    while todo:
        at = time.monotonic()
        try:
            got = fn([messages[k] for k in todo])
            if len(got) != len(todo):
                raise ValueError(f"{len(got)} answers to {len(todo)} messages")
        except Exception as e:  # noqa: BLE001  an error is a row
            got = [e] * len(todo)
        seconds = time.monotonic() - at
        again = []
        for k, g in zip(todo, got, strict=True):
            out[k] = _answer(g, seconds / max(1, len(todo)))
            if out[k]["error_class"] in (TIMEOUT, RATE_LIMIT):
                again.append(k)
        if not again or time.monotonic() - began + wait > BUDGET * timeout:
            break
        sleep(wait)
        todo, wait = again, min(2 * wait, MAX_WAIT)
    return out


def complete(df: DataFrame, fn: Complete, system: str = "system", user: str = "user", out: str = "completion", screen: str | None = None, max_tokens: int = MAX_TOKENS, chars_per_token: int = 4, batch: int = 16, timeout: float = 120.0, concurrency: int | None = None, too_large: str | None = None, blocked: str | None = None, only: str | None = None) -> DataFrame:
    """Adds out, a struct with content, model, tokens, cost, status, error_class and duration.

    Rows whose screened text (column screen) looks like an injection, that the column blocked says hold one, or whose messages are over
    max_tokens, are not sent; nor those where the column too_large says that the message was not even built. Rows for which the column only
    is not true are not asked about: out is null. concurrency bounds the calls at one time, by the number of partitions. The result is not to be computed twice:
    write or checkpoint it before a second use.
    """
    from pyspark.sql import types as T

    kind = T._parse_datatype_string(COMPLETION)
    gated = with_token_estimate(df, [system, user], chars_per_token, max_tokens)
    if too_large:
        gated = gated.withColumn("over_limit", F.col("over_limit") | F.col(too_large))
    screens = [F.coalesce(F.col(blocked), F.lit(False))] if blocked else []
    if screen:
        gated = screen_injection(gated, screen)
        screens.append(F.col("injection").isNotNull())
    stop = F.when(F.col("over_limit"), TOO_LARGE)
    for found in screens:
        stop = F.when(found, INJECTION).otherwise(stop)
    ask = F.coalesce(F.col(only), F.lit(False)) if only else F.lit(True)
    gated = gated.withColumns({"_stop": stop, "_ask": ask}).select(*df.columns, "_stop", "_ask")
    if concurrency:
        gated = gated.repartition(concurrency)
    schema = StructType([*df.schema.fields, StructField(out, kind)])
    arrow = to_arrow_type(kind)
    assert from_arrow_type(arrow) == kind

    def run(batches):
        # A few messages at a time are taken out of a batch: thousands of long ones would fill the worker several times over.
        for b in (whole.slice(i, batch) for whole in batches for i in range(0, whole.num_rows, batch)):
            stops = b.column("_stop").to_pylist()
            asks = b.column("_ask").to_pylist()
            rows: list = [_answer(None, 0) | {"error_class": s} if a and s is not None else None for a, s in zip(asks, stops, strict=True)]
            todo = [k for k, r in enumerate(rows) if r is None and asks[k]]
            if todo:
                messages = [(b.column(system)[k].as_py(), b.column(user)[k].as_py()) for k in todo]
                for k, r in zip(todo, call_with_retries(fn, messages, timeout), strict=True):
                    rows[k] = r
            kept = [b.column(c) for c in df_columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(rows, arrow)], names=[*df_columns, out])

    df_columns = list(df.columns)
    return gated.mapInArrow(run, schema)


# ---------------------------------------------------------------- functions for tests and dry runs


def _unit(text: str) -> float:
    """A number in [0, 1) that only depends on the text."""
    import hashlib

    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) / 2**32


def stub_complete(kind: str, fail_below: float = 0.0) -> Complete:
    """A completion function without a model: answers follow from a digest of the message; the share fail_below of them fail."""

    def one(system: str, user: str):
        import hashlib
        import json
        import re

        u = _unit(user)
        if u < fail_below:
            return ContentPolicyError("stub") if u < fail_below / 2 else ValueError("stub")  # errors that are not tried again
        tag = hashlib.md5(user.encode()).hexdigest()[:12]
        if kind == "judge":
            content = json.dumps({"quality_score": round(u, 2), "uncertainty_explanation": f"because {tag}"})
        elif kind == "score":
            content = f"{round(u, 2)}\nbecause {tag}"
        elif kind == "pick":
            n = len(re.findall(r"(?m)^\d+: ", user[user.rfind("<options>") :]))
            content = json.dumps({"selected": sorted({int(u * n), int(u * 7919) % max(n, 1)}) if n else []})
        elif kind == "summary":
            content = json.dumps({"title": f"Title {tag[:4]}", "summary": f"Summary {tag}", "quality_score": round(u, 2)})
        elif kind == "sensitive":
            words = user.lower()
            types = [t for t, keys in KEYWORDS.items() if any(k in words for k in keys)]
            content = json.dumps({"sensitivity_types": types, "explanation": ", ".join(types)})
        else:
            content = f"analysis {tag}"
        return {"content": content, "model": "stub", "input_tokens": (len(system) + len(user)) // 4, "output_tokens": len(content) // 4, "cost": 0.0}

    return lambda messages: [one(s, u) for s, u in messages]


def stub_failures() -> Complete:
    """A completion function that fails in every way that has a class, and answers in every way that is none, by the tenth that a message's digest falls in; one tenth is right."""
    usage = {"model": "stub", "input_tokens": 3, "output_tokens": 2}
    outcomes = (TimeoutError(), RateLimitError(), ContentPolicyError(), ValueError(), RuntimeError(), None, usage | {"content": None}, {"content": "no usage"}, usage | {"content": 5}, usage | {"content": "right", "cost": None})
    return lambda messages: [outcomes[int(_unit(user) * 10)] for _, user in messages]


# Words that stand for kinds of sensitive content in the offline screen.
KEYWORDS = {
    "CORRUPTION": ("bribe", "corrupt"),
    "FRAUD": ("fraud", "scam", "fake"),
    "HARASSMENT": ("harass", "pathetic", "scum", "worthless"),
    "THEFT": ("stole", "theft", "steal"),
    "THREATS_AND_PHYSICAL_VIOLENCE": ("threat", "beat me", "violence"),
    "FOOD_SAFETY": ("rotten", "spoiled"),
}
