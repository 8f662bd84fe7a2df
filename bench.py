"""Benchmark of the headline operators; prints one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).

Stages: scoring of every document, building and writing the verdict ledger
(Parquet, partitioned by event_date), every report and listing over the written
ledger, the rate limiter over every event, and the text-heavy analyses. Each
query is forced with a no-op write (full computation, nothing collected).
Read-only queries report the best of two runs after the JVM and the Python
workers are warmed up (steady state); the ledger write runs once.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    m = re.search(r"sf([0-9.]+)$", sf_dir)
    sf = float(m.group(1)) if m else None

    from pyspark.sql import functions as F

    from promptlens.operators import ledger as L
    from promptlens.operators import ratelimit as RL
    from promptlens.operators import reports as E
    from promptlens.operators import scoring as S
    from promptlens.plans import catalog as C
    from promptlens.plans import testdata as TD
    from promptlens.session import build_session, scratch_path
    from promptlens.sources import ledger_io as IO

    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=cpus)
    spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().collect()  # JVM warm-up
    spark.range(1000).mapInPandas(lambda it: it, "id long").collect()  # Python worker warm-up

    def force(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}

    def timed(name, fn, repeat=1):
        best = None
        for _ in range(repeat):
            t = time.perf_counter()
            fn()
            dt = time.perf_counter() - t
            best = dt if best is None else min(best, dt)
        times[name] = round(best, 3)

    n_docs = TD.n_documents(spark, sf_dir)
    n_chars = TD.table(spark, sf_dir, "documents").agg(F.sum(F.length("text"))).collect()[0][0]

    timed("score_prompts", lambda: force(TD.scored_prompts(spark, sf_dir)), repeat=2)
    path = scratch_path(spark, "bench-ledger")
    timed("ledger_build", lambda: IO.ledger_append(TD.ledger(spark, sf_dir), path))
    led = IO.ledger_scan(spark, path)
    n_ledger = led.count()
    now = TD.NOW_UNIX

    reports = {
        "counters_total": lambda: E.counters_total(led),
        "chart_24h": lambda: E.chart_24h(led, now),
        "chart_dense_12h": lambda: E.chart_dense_12h(led, now),
        "top_patterns": lambda: E.top_patterns(led),
        "attack_sources": lambda: E.attack_sources(led),
        "severity_distribution": lambda: E.severity_distribution(led),
        "recent_threats_24h": lambda: E.recent_threats_24h(led, now),
        "threat_report": lambda: E.threat_report(led, now),
        "hourly_stats_7d": lambda: E.hourly_stats_7d(led, now),
        "daily_stats_30d": lambda: E.daily_stats_30d(led, now),
        "performance_summary": lambda: E.performance_summary(led),
        "pii_summary": lambda: E.pii_summary(led),
        "analytics_report": lambda: E.analytics_report(led, now),
        "ledger_query": lambda: L.ledger_query(led, 100, "BLOCKED", "override"),
        "ledger_search": lambda: L.ledger_search(led, C.SEARCH_LIKE),
        "prune_max_events": lambda: L.prune_max_events(led, 500),
        "prune_expired": lambda: L.prune_expired(led, now, 30),
        "sanitized_diff": lambda: L.sanitized_diff(led),
    }
    for name, build in reports.items():
        timed(name, lambda b=build: force(b()), repeat=2)

    reqs = TD.requests(spark, sf_dir).select("id", "ip_address", "unix_ts")
    timed("rate_limit_admit_default", lambda: force(RL.rate_limit_decisions(reqs)), repeat=2)
    timed("rate_limit_admit_3_6h", lambda: force(RL.rate_limit_decisions(reqs, limit=3, window=21600.0)), repeat=2)
    timed("pii_by_type", lambda: force(S.pii_by_type(TD.prompts(spark, sf_dir))), repeat=2)
    timed("injection_all_hits", lambda: force(S.injection_all_hits(TD.prompts(spark, sf_dir))), repeat=2)
    timed("policy_rule_scan", lambda: force(C.QUERIES["policy_rule_scan"](spark, sf_dir)), repeat=2)

    total = round(sum(times.values()), 3)
    out = {
        "metric": "total_sec",
        "value": total,
        "unit": "sec",
        "queries": times,
        "sf": sf,
        "cpus": cpus,
        "documents": n_docs,
        "document_chars": n_chars,
        "ledger_rows": n_ledger,
        "score_docs_per_sec": round(n_docs / times["score_prompts"], 1),
        "score_chars_per_sec": round(n_chars / times["score_prompts"], 1),
        "rate_limit_rows_per_sec": round(n_ledger / times["rate_limit_admit_default"], 1),
    }
    print(json.dumps(out), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
