"""The gateway's text audit log: rendering verdict lines and parsing them back.

Line format: ``<yyyy-MM-dd HH:mm:ss> [<LEVEL>] <logger> — <message>``. Verdict
messages are ``<STATUS> [<event id>] ip=<ip> masked=<n>``, or in the older
blocked form ``BLOCKED [<event id>] ip=<ip> rule=<rule>``. Other lines (start,
shutdown, settings) are kept with null verdict fields.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptlens.functions import rules as R

# FIXED VALUES — log line layout.
LOG_SEPARATOR = " — "
LINE_RE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) \[(\w+)\] (\S+) — (.*)$"
VERDICT_RE = r"^(BLOCKED|SANITIZED|PASSED) \[([^\]]+)\] ip=(\S+)(?: masked=(\d+))?(?: rule=(.+))?$"
UNKNOWN_IP = "unknown"


def render_audit_lines(ledger: DataFrame, logger: str = "gateway") -> DataFrame:
    """One log line per ledger row (``value`` column), as the gateway writes them."""
    ip = F.coalesce(F.col("ip_address"), F.lit(UNKNOWN_IP))
    blocked = F.col("status") == F.lit(R.STATUS_BLOCKED)
    msg = F.when(blocked, F.concat(F.lit("BLOCKED ["), F.col("id"), F.lit("] ip="), ip, F.lit(" rule="),
                                   F.coalesce(F.col("matched_rule"), F.lit(""))))\
           .otherwise(F.concat(F.col("status"), F.lit(" ["), F.col("id"), F.lit("] ip="), ip,
                               F.lit(" masked="), F.col("tokens_masked").cast("string")))
    level = F.when(blocked, F.lit("WARNING")).otherwise(F.lit("INFO"))
    return ledger.select(F.concat(F.col("timestamp"), F.lit(" ["), level, F.lit("] "), F.lit(logger),
                                  F.lit(LOG_SEPARATOR), msg).alias("value"))


def parse_audit_lines(lines: DataFrame, value_col: str = "value") -> DataFrame:
    v = F.col(value_col)
    msg = F.regexp_extract(v, LINE_RE, 4)
    is_line = v.rlike(LINE_RE)
    is_verdict = is_line & msg.rlike(VERDICT_RE)

    def part(src, rx, g):
        return F.regexp_extract(src, rx, g)

    def opt(cond, val):
        return F.when(cond & (val != F.lit("")), val)

    return lines.select(
        F.when(is_line, part(v, LINE_RE, 1)).alias("ts"),
        F.when(is_line, part(v, LINE_RE, 2)).alias("level"),
        F.when(is_line, part(v, LINE_RE, 3)).alias("logger"),
        F.when(is_line, msg).otherwise(v).alias("message"),
        F.when(is_verdict, part(msg, VERDICT_RE, 1)).alias("status"),
        F.when(is_verdict, part(msg, VERDICT_RE, 2)).alias("event_id"),
        F.when(is_verdict, part(msg, VERDICT_RE, 3)).alias("ip"),
        opt(is_verdict, part(msg, VERDICT_RE, 4)).cast("int").alias("masked"),
        opt(is_verdict, part(msg, VERDICT_RE, 5)).alias("rule"),
    )


def audit_log_scan(spark: SparkSession, path: str) -> DataFrame:
    """Read log files line by line (splittable text source) and parse them."""
    return parse_audit_lines(spark.read.text(path))


def write_audit_lines(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)
