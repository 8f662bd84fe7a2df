"""Ledger reports: counters, charts, threat intelligence, analytics.

``now`` is always a parameter (epoch seconds). Range filters use ``unix_ts``
strictly (``unix_ts > now - N``); hour and day buckets are cut from the
``timestamp`` text, so no timestamp parsing happens per row. Every report is a
partial (map-side) + final hash aggregation over the columns it needs only —
the payload columns are never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptlens.functions import rules as R
from promptlens.schemas import LEDGER_PARTITION

DAY_S, WEEK_S, MONTH_S = 86400, 604800, 2592000
STATUSES = [R.STATUS_BLOCKED, R.STATUS_SANITIZED, R.STATUS_PASSED]
AVG_DIGITS = 4


def cents(c):
    """A 2-decimal amount as exact integer hundredths."""
    return F.round(c * 100).cast("long")


def avg4(units_sum, n, units_per_1e4: int):
    """Average rounded half-up to 4 decimals, computed exactly from an integer sum.

    A double average depends on summation order, which differs between tasks
    and engines; an integer sum does not. ``units_per_1e4`` converts the sum's
    unit into 1e-4 (100 for cents, 10000 for whole units).
    """
    q = F.floor((F.lit(2 * units_per_1e4) * units_sum + n) / (F.lit(2) * n))
    return F.when(n > 0, q / F.lit(10000.0))


def avg_latency(c="latency_ms"):
    return avg4(F.sum(cents(F.col(c))), F.count(c), 100)


def hour_of_day(ts_text):
    return F.concat(F.substring(ts_text, 12, 2), F.lit(":00"))


def hour_label(ts_text):
    return F.concat(F.substring(ts_text, 1, 13), F.lit(":00"))


def day_label(ts_text):
    return F.substring(ts_text, 1, 10)


def _since(now_unix: float, span_s: int):
    return F.col("unix_ts") > F.lit(float(now_unix) - span_s)


def _recent(ledger: DataFrame, now_unix: float, span_s: int) -> DataFrame:
    """Rows with ``unix_ts > now - span``; on a stored ledger also a partition bound.

    The bound keeps one spare day below the cut-off's UTC date, so it holds
    for timestamp text written in any zone and only ever skips whole
    partitions that cannot hold a qualifying row.
    """
    out = ledger.filter(_since(now_unix, span_s))
    if LEDGER_PARTITION in ledger.columns:
        first_day = F.date_sub(F.to_date(F.timestamp_seconds(F.lit(float(now_unix) - span_s))), 1)
        out = out.filter((F.col(LEDGER_PARTITION) >= first_day) | F.col(LEDGER_PARTITION).isNull())
    return out


def _blocked(ledger: DataFrame) -> DataFrame:
    return ledger.filter(F.col("status") == F.lit(R.STATUS_BLOCKED))


def counters_total(ledger: DataFrame) -> DataFrame:
    """All-time totals; a status outside the three known ones counts in total only."""
    st = F.col("status")
    return ledger.agg(
        F.count(F.lit(1)).alias("total_processed"),
        F.count_if(st == R.STATUS_BLOCKED).alias("total_blocked"),
        F.count_if(st == R.STATUS_SANITIZED).alias("total_sanitized"),
        F.count_if(st == R.STATUS_PASSED).alias("total_passed"))


def chart_24h(ledger: DataFrame, now_unix: float) -> DataFrame:
    """Hour-of-day label (no date) x status counts over the last 24 h, ordered by hour."""
    return (_recent(ledger, now_unix, DAY_S)
                  .groupBy(hour_of_day(F.col("timestamp")).alias("hour"), "status")
                  .agg(F.count(F.lit(1)).alias("count"))
                  .orderBy("hour", "status"))


def chart_dense_12h(ledger: DataFrame, now_unix: float) -> DataFrame:
    """12 hour labels ending at the hour of ``now``; counts per status (0 when absent),
    stacked total and the chart scale max(1, max total).

    The 24 h chart has at most 24 x 3 rows, so joining it to the 12 labels and
    pivoting over the three known statuses is bounded work.
    """
    spark = ledger.sparkSession
    labels = (spark.range(12).select(
        (F.col("id")).cast("int").alias("slot"),
        hour_of_day(F.date_format(F.timestamp_seconds(F.lit(float(now_unix)) - (F.lit(11) - F.col("id")) * 3600),
                                  "yyyy-MM-dd HH:mm:ss")).alias("hour")))
    chart = (chart_24h(ledger, now_unix).groupBy("hour").pivot("status", STATUSES)
             .agg(F.first("count")))
    dense = labels.join(F.broadcast(chart), "hour", "left").select(
        "slot", "hour", *[F.coalesce(F.col(s), F.lit(0)).cast("long").alias(s.lower()) for s in STATUSES])
    dense = dense.withColumn("total", sum(F.col(s.lower()) for s in STATUSES))
    # 12 rows: the global window is one tiny partition.
    return dense.withColumn("scale", F.greatest(F.lit(1), F.max("total").over(Window.partitionBy())).cast("long"))


def top_patterns(ledger: DataFrame, k: int = 10) -> DataFrame:
    """Blocked rules by count (top k, ties by rule); severity = most severe seen for the rule.

    Rows are hashed into counts per (rule, severity); only these few are sorted by rule.
    """
    return (_blocked(ledger).filter(F.col("matched_rule").isNotNull())
            .groupBy("matched_rule", "severity").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("matched_rule")
            .agg(F.sum("n").alias("count"),
                 F.max_by("severity", R.severity_rank(F.col("severity"))).alias("severity"))
            .orderBy(F.col("count").desc(), F.col("matched_rule").asc()).limit(k))


def attack_sources(ledger: DataFrame, k: int = 10) -> DataFrame:
    """Blocked requests per client IP (null is its own group), top k, ties by ip (nulls first)."""
    return (_blocked(ledger).groupBy("ip_address").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), F.col("ip_address").asc_nulls_first()).limit(k))


def severity_distribution(ledger: DataFrame) -> DataFrame:
    return _blocked(ledger).groupBy("severity").agg(F.count(F.lit(1)).alias("count"))


def recent_threats_24h(ledger: DataFrame, now_unix: float, k: int = 5) -> DataFrame:
    return (_recent(_blocked(ledger), now_unix, DAY_S)
            .groupBy("matched_rule", "severity").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), F.col("matched_rule").asc_nulls_first(),
                     F.col("severity").asc()).limit(k))


THREAT_COLUMNS = ["section", "matched_rule", "ip_address", "severity", "count"]


def _top_of_sections(rows: DataFrame, limits: dict[str, int], *order) -> DataFrame:
    """The first rows of each section with a limit, and all rows of the others.

    Rows of a section without a limit are windows of their own (``__own``), so one rank
    filter serves all, and it is applied within tasks before any row moves.
    """
    at = Window.partitionBy("section", F.when(~F.col("section").isin(*limits), F.col("__own"))).orderBy(*order)
    within = F.lit(True)
    for section, k in limits.items():
        within = within & ((F.col("section") != section) | (F.col("__rank") <= k))
    return rows.withColumn("__rank", F.row_number().over(at)).filter(F.col("__rank") <= max(limits.values())).filter(within).drop("__rank", "__own")


def threat_report(ledger: DataFrame, now_unix: float) -> DataFrame:
    """The four threat sections from one scan of the blocked rows.

    Blocked rows are counted once per (rule, ip, severity); each count then adds to its
    group in every section, and each section keeps its first rows. One chain, one consumer.
    """
    pre = (_blocked(ledger).groupBy("matched_rule", "ip_address", "severity")
           .agg(F.count(F.lit(1)).alias("n"), F.count_if(_since(now_unix, DAY_S)).alias("recent")))
    none = F.lit(None).cast("string")
    part = lambda name, rule, ip, severity, n: F.struct(
        F.lit(name).alias("section"), rule.alias("matched_rule"), ip.alias("ip_address"), severity.alias("__severity"), n.alias("n"))
    rule, ip, severity = F.col("matched_rule"), F.col("ip_address"), F.col("severity")
    parts = F.array(
        F.when(rule.isNotNull(), part("top_patterns", rule, none, none, F.col("n"))),
        part("attack_sources", none, ip, none, F.col("n")),
        part("severity_distribution", none, none, severity, F.col("n")),
        F.when(F.col("recent") > 0, part("recent_threats_24h", rule, none, severity, F.col("recent"))))
    worst = F.max(F.struct(R.severity_rank(F.col("severity")).alias("rank"), "severity"))
    groups = (pre.select("severity", F.explode(F.array_compact(parts)).alias("p")).select("severity", "p.*")
              .groupBy("section", "matched_rule", "ip_address", "__severity")
              .agg(F.sum("n").alias("count"), worst.alias("__worst")))
    top = F.when(F.col("section") == "top_patterns", F.col("__worst.severity")).otherwise(F.col("__severity"))
    rows = groups.select("section", "matched_rule", "ip_address", top.alias("severity"), "count", F.col("__severity").alias("__own"))
    limits = {"top_patterns": 10, "attack_sources": 10, "recent_threats_24h": 5}
    return _top_of_sections(rows, limits, F.col("count").desc(), F.col("matched_rule").asc_nulls_first(),
                            F.col("ip_address").asc_nulls_first(), F.col("severity").asc_nulls_first()).select(*THREAT_COLUMNS)


def hourly_stats_7d(ledger: DataFrame, now_unix: float) -> DataFrame:
    return (_recent(ledger, now_unix, WEEK_S)
            .groupBy(hour_label(F.col("timestamp")).alias("hour"), "status")
            .agg(F.count(F.lit(1)).alias("count"), avg_latency().alias("avg_latency"))
            .orderBy("hour", "status"))


def daily_stats_30d(ledger: DataFrame, now_unix: float, days: int = 30) -> DataFrame:
    st = F.col("status")
    return (_recent(ledger, now_unix, MONTH_S)
            .groupBy(day_label(F.col("timestamp")).alias("day"))
            .agg(F.count(F.lit(1)).alias("total"),
                 F.count_if(st == R.STATUS_BLOCKED).alias("blocked"),
                 F.count_if(st == R.STATUS_SANITIZED).alias("sanitized"),
                 avg_latency().alias("avg_latency"))
            .orderBy(F.col("day").desc()).limit(days))


def performance_summary(ledger: DataFrame) -> DataFrame:
    """Global latency and size figures; all null on an empty ledger."""
    return ledger.agg(avg_latency().alias("avg_latency"),
                      F.min("latency_ms").alias("min_latency"),
                      F.max("latency_ms").alias("max_latency"),
                      avg4(F.sum("payload_bytes"), F.count("payload_bytes"), 10000).alias("avg_payload_size"))


def pii_summary(ledger: DataFrame) -> DataFrame:
    return ledger.agg(F.sum("tokens_masked").cast("long").alias("total_tokens_masked"),
                      F.count_if(F.col("tokens_masked") > 0).alias("events_with_pii"))


ANALYTICS_COLUMNS = ["section", "hour", "day", "status", "count", "blocked", "sanitized", "avg_latency",
                     "min_latency", "max_latency", "avg_payload_size", "total_tokens_masked", "events_with_pii"]


def analytics_report(ledger: DataFrame, now_unix: float) -> DataFrame:
    """The four analytics sections from one scan and one pre-aggregation.

    The ledger is reduced once to (hour, status, in-7d, in-30d) with sums, counts, min and
    max. Each of these few rows then adds to its group in every section, in one aggregation;
    an empty row makes the two global sections exist for an empty ledger.
    """
    pre = (ledger.groupBy(hour_label(F.col("timestamp")).alias("hour"), "status",
                          _since(now_unix, WEEK_S).alias("in7"), _since(now_unix, MONTH_S).alias("in30"))
           .agg(F.count(F.lit(1)).alias("n"), F.sum(cents(F.col("latency_ms"))).alias("lat_sum"),
                F.count("latency_ms").alias("lat_n"),
                F.min("latency_ms").alias("lat_min"), F.max("latency_ms").alias("lat_max"),
                F.sum("payload_bytes").alias("bytes_sum"), F.count("payload_bytes").alias("bytes_n"),
                F.sum("tokens_masked").cast("long").alias("tok_sum"), F.count_if(F.col("tokens_masked") > 0).alias("pii_n")))
    none = F.lit(None).cast("string")
    key = lambda section, hour=none, day=none, status=none: F.struct(
        F.lit(section).alias("section"), hour.alias("hour"), day.alias("day"), status.alias("__status"))
    keys = F.array(F.when(F.col("in7"), key("hourly_stats", F.col("hour"), none, F.col("status"))),
                   F.when(F.col("in30"), key("daily_stats", none, F.substring("hour", 1, 10))),
                   key("performance"), key("pii_detection"))
    values = [c for c in pre.columns if c not in ("hour", "in7", "in30")]
    rows = pre.select(*values, F.explode(F.array_compact(keys)).alias("k")).select(*values, "k.*")
    empty = (ledger.sparkSession.range(1).select(F.explode(F.array(key("performance"), key("pii_detection"))).alias("k")).select("k.*"))
    st, n = F.col("status"), F.col("n")
    groups = (rows.unionByName(empty, allowMissingColumns=True).groupBy("section", "hour", "day", "__status")
              .agg(F.sum("n").alias("count"), F.sum(F.when(st == R.STATUS_BLOCKED, n).otherwise(0)).alias("blocked"),
                   F.sum(F.when(st == R.STATUS_SANITIZED, n).otherwise(0)).alias("sanitized"),
                   avg4(F.sum("lat_sum"), F.sum("lat_n"), 100).alias("avg_latency"),
                   F.min("lat_min").alias("min_latency"), F.max("lat_max").alias("max_latency"),
                   avg4(F.sum("bytes_sum"), F.sum("bytes_n"), 10000).alias("avg_payload_size"),
                   F.sum("tok_sum").alias("total_tokens_masked"), F.coalesce(F.sum("pii_n"), F.lit(0)).alias("events_with_pii")))
    shown = {"hour": "hourly_stats", "day": "daily_stats", "__status": "hourly_stats", "count": ("hourly_stats", "daily_stats"),
             "blocked": "daily_stats", "sanitized": "daily_stats", "avg_latency": ("hourly_stats", "daily_stats", "performance"),
             "min_latency": "performance", "max_latency": "performance", "avg_payload_size": "performance",
             "total_tokens_masked": "pii_detection", "events_with_pii": "pii_detection"}
    only = [F.when(F.col("section").isin(*([s] if isinstance(s, str) else s)), F.col(c)).alias(c.replace("__", "")) for c, s in shown.items()]
    # An hour and its status are a window of their own; days keep the newest.
    own = F.struct(F.col("hour"), F.col("__status"))
    return _top_of_sections(groups.select("section", *only, own.alias("__own")), {"daily_stats": 30}, F.col("day").desc()).select(*ANALYTICS_COLUMNS)
