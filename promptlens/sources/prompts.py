"""Prompt requests as JSON (files or a value column from a message bus)."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def prompt_of(body: str | None) -> str | None:
    """The prompt of one request body, or None where the request is rejected.

    The whole body must be one JSON document. Of a repeated key the last value counts. Any
    failure to read it (broken or trailing text, too deep, a number too long) rejects it, as
    does a prompt that is no text or holds half of a surrogate pair.
    """
    if body is None:
        return None
    try:
        request = json.loads(body.removeprefix("\ufeff"))
        prompt = request.get("prompt") if isinstance(request, dict) else None
        if not isinstance(prompt, str):
            return None
        prompt.encode()
        return prompt
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(T.StringType())
def _prompts_of(bodies: pd.Series) -> pd.Series:
    return bodies.map(prompt_of)


def parse_prompt_requests(df: DataFrame, value_col: str = "value") -> DataFrame:
    """Adds ``prompt`` and ``valid`` from a JSON request body ``{"prompt": "..."}``.

    A request is valid when the body is one JSON object whose ``prompt`` is a JSON string (an
    empty string is accepted); malformed bodies, text after the object, a missing prompt, a
    non-string prompt and a null body are rejected, as the request model does. Bodies have
    no size limit of their own. One narrow Arrow pass: the built-in JSON functions reject a
    repeated key or overlook trailing text.
    """
    return df.withColumn("prompt", _prompts_of(F.col(value_col))).withColumn("valid", F.col("prompt").isNotNull())


def read_prompt_requests(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """JSON Lines request files → value, prompt, valid: one row per line, or per file with ``whole_files``."""
    return parse_prompt_requests(spark.read.text(path, wholetext=whole_files))


def split_valid(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    return parsed.filter(F.col("valid")), parsed.filter(~F.col("valid"))
