"""Translators: batches (doc_id, part, batch_id, items) to answers (doc_id, part, batch_id, translations, error)."""

from __future__ import annotations

import http.client
import json
import os
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonguemill.core.config import JobConfig
from tonguemill.operators.glossary import glossary  # noqa: F401  one of the translators
from tonguemill.operators.translation import KEY, RETRY, build_prompt, guard_prompt, read_responses, retry_union

VOWELS, TURNED = "aeiou", "eioua"


def pseudo_text(c: Column) -> Column:
    """A deterministic stand-in for a translation: vowels move on by one, so length and layout stay."""
    return F.translate(c, VOWELS, TURNED)


def pseudo(batches: DataFrame, config: JobConfig) -> DataFrame:
    return batches.select(*KEY, "batch_id", F.transform("items", lambda i: pseudo_text(i["text"])).alias("translations"), F.lit(None).cast("string").alias("error"))


# a translator that is an expression over a batch's items can work where they stand
pseudo.column = lambda items, config: F.transform(items, lambda i: pseudo_text(i["text"]))


ANSWERS = "doc_id {id}, part string, batch_id int, expected int, http_status int, body string"


def http_call(url: str, model: str, key_variable: str, timeout: float = 120.0) -> Callable[[str], tuple[int, str]]:
    """A prompt to (status, body); status 0 if nobody answers. The key is read on the executor from its environment and never becomes data."""

    def ask(prompt: str) -> tuple[int, str]:
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {os.environ[key_variable]}"} if os.environ.get(key_variable) else {})
        data = json.dumps({"model": model, "input": prompt, "temperature": 0.15, "store": False}).encode()
        try:
            with urllib.request.urlopen(urllib.request.Request(url, data, head), timeout=timeout) as r:
                return r.status, r.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as e:
            return e.code, e.read().decode("utf-8", "replace")
        except (OSError, http.client.HTTPException) as e:
            return 0, json.dumps({"error": str(e)})

    return ask


def http_calls(url: str, model: str, key_variable: str, timeout: float = 120.0) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """For mapInPandas: prompts to bodies, one call at a time."""
    ask = http_call(url, model, key_variable, timeout)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            got = [ask(prompt) for prompt in rows.prompt]
            yield rows.drop(columns="prompt").assign(http_status=[g[0] for g in got], body=[g[1] for g in got])

    return run


def model(call: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], save: Callable[[DataFrame, str], DataFrame], calls: int = 8) -> Callable[[DataFrame, JobConfig], DataFrame]:
    """A translator that asks a model, twice at most. `save(df, label)` writes a table and reads it again, so that a lost executor or a
    later step never asks again for what was answered. Batches are dealt by their own key over `calls` partitions, which bounds the
    calls at a time; a long document doesn't keep one partition busy."""

    def run(batches: DataFrame, config: JobConfig) -> DataFrame:
        asked = guard_prompt(build_prompt(batches, config.target), config.max_prompt).withColumn("expected", F.size("items"))
        schema = ANSWERS.format(id=batches.schema["doc_id"].dataType.simpleString())

        def attempt(rows: DataFrame, label: str) -> DataFrame:
            sent = rows.select(*KEY, "batch_id", "expected", "prompt").repartition(calls, *KEY, "batch_id")
            return read_responses(save(sent.mapInPandas(call, schema), label)).select(*KEY, "batch_id", "translations", "error")

        good = asked.where("status = 'ok'")
        first = attempt(good, "attempt1")
        again = good.join(first.where("error is not null").select(*KEY, "batch_id"), [*KEY, "batch_id"], "left_semi").withColumn("prompt", F.concat("prompt", F.lit(RETRY)))
        refused = asked.where("status <> 'ok'").select(*KEY, "batch_id", F.lit(None).cast("array<string>").alias("translations"), "error")
        return retry_union(first, attempt(again, "attempt2")).unionByName(refused)

    return run
