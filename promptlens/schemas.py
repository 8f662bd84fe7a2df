"""Schemas of the gateway's tables, as Spark StructTypes."""

from __future__ import annotations

from pyspark.sql import types as T

PROMPT_REQUEST = T.StructType([T.StructField("prompt", T.StringType(), True)])

# The verdict ledger. ``timestamp`` is local-time text (yyyy-MM-dd HH:mm:ss),
# ``unix_ts`` epoch seconds; range filters use unix_ts, buckets use timestamp.
LEDGER = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("timestamp", T.StringType(), False),
    T.StructField("unix_ts", T.DoubleType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("severity", T.StringType(), False),
    T.StructField("latency_ms", T.DoubleType(), False),
    T.StructField("tokens_masked", T.IntegerType(), False),
    T.StructField("payload_bytes", T.IntegerType(), False),
    T.StructField("matched_rule", T.StringType(), True),
    T.StructField("full_payload", T.StringType(), False),
    T.StructField("sanitized_payload", T.StringType(), False),
    T.StructField("ip_address", T.StringType(), True),
    T.StructField("snippet", T.StringType(), False),
])
LEDGER_COLUMNS = [f.name for f in LEDGER.fields]
# The texts of a row, as long as the prompt or made from it.
PAYLOAD_COLUMNS = ["full_payload", "sanitized_payload", "snippet"]
# Physical layout adds the partition column derived from ``timestamp``.
LEDGER_PARTITION = "event_date"

POLICY_RULES = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("pattern", T.StringType(), False),
    T.StructField("severity", T.StringType(), False),
    T.StructField("enabled", T.BooleanType(), False),
    T.StructField("created_at", T.StringType(), False),
])

# Change log that drives the rule table: one row per create/update/delete call.
RULE_CHANGES = T.StructType([
    T.StructField("seq", T.LongType(), False),
    T.StructField("op", T.StringType(), False),  # insert | update | delete
    T.StructField("id", T.StringType(), False),
    T.StructField("name", T.StringType(), True),
    T.StructField("pattern", T.StringType(), True),
    T.StructField("severity", T.StringType(), True),
    T.StructField("enabled", T.BooleanType(), True),
    T.StructField("ts", T.StringType(), True),
])

SETTINGS = T.StructType([
    T.StructField("key", T.StringType(), False),
    T.StructField("value", T.StringType(), False),
])
SETTINGS_CHANGES = T.StructType([
    T.StructField("seq", T.LongType(), False),
    T.StructField("key", T.StringType(), False),
    T.StructField("value", T.StringType(), True),
])

# FIXED VALUES — default settings rows, in creation order.
DEFAULT_SETTINGS: list[tuple[str, str]] = [
    ("rate_limit", "100"),
    ("rate_window", "60"),
    ("max_payload_size", "10240"),
    ("log_retention_days", "30"),
    ("enable_pii_detection", "true"),
    ("enable_injection_detection", "true"),
    ("alert_email", ""),
    ("webhook_url", ""),
]

# FIXED VALUES — gateway defaults.
DEFAULT_RATE_LIMIT = 100
DEFAULT_RATE_WINDOW_S = 60
DEFAULT_MAX_EVENTS = 500
DEFAULT_MAX_PAYLOAD = 10240
DEFAULT_RETENTION_DAYS = 30
