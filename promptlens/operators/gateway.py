"""The gateway as one operator: admission, payload size, scoring, and what is stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptlens.functions.text import payload_bytes
from promptlens.operators import ratelimit as RL
from promptlens.operators import scoring as S
from promptlens.operators import tables as G
from promptlens.operators.references import by_reference, with_texts
from promptlens.schemas import DEFAULT_RATE_LIMIT, DEFAULT_RATE_WINDOW_S

DENIED, TOO_LARGE, SCORED = "DENIED", "TOO_LARGE", "SCORED"


def gateway(requests: DataFrame, changes: DataFrame, rules: DataFrame | None = None, text_col: str = "prompt",
            limit: int = DEFAULT_RATE_LIMIT, window: float = DEFAULT_RATE_WINDOW_S) -> DataFrame:
    """Every request with its ``outcome`` and, where it was scored, its verdict (null otherwise).

    In this order, each under the settings in force at the request's own time: the client's
    rate limit denies, the payload limit rejects, the switched-on detections score. The
    limiter's own figures hold for the whole run: its state would not outlive a change.
    Denied and rejected requests are never scored. Requests are admitted and meet their
    settings without their texts, which are moved once per text.
    """
    columns = requests.columns
    size = payload_bytes(F.coalesce(F.col(text_col), F.lit("")))
    rows, texts = by_reference(requests.withColumn("__size", size), [text_col])
    decided = RL.rate_limit_admit(rows, limit=limit, window=window)
    held = G.settings_as_of(decided, changes)
    held = held.withColumn("outcome", F.when(~F.col("admitted"), DENIED).when(F.col("__size") > G.number_of("max_payload_size"), TOO_LARGE).otherwise(SCORED))
    held = with_texts(held, texts).select(*columns, "settings", "outcome")
    scored = F.col("outcome") == SCORED
    out = S.score_prompts(held, text_col, enable_injection=scored & G.switched_on("enable_injection_detection"),
                          enable_pii=scored & G.switched_on("enable_pii_detection"), custom_rules=rules)
    verdict = ("status", "severity", "matched_rule", "sanitized_text", "tokens_masked")
    return out.withColumns({c: F.when(scored, F.col(c)) for c in verdict}).drop("settings")


def stored(decided: DataFrame, text_col: str = "prompt", ts_col: str | None = None) -> DataFrame:
    """The ledger rows of a gateway run: those of the scored requests alone."""
    return S.event_project(decided.filter(F.col("outcome") == SCORED), text_col=text_col, ts_col=ts_col)
