"""Ledger filters, reports, retention, exports and the audit log: fixture vectors."""

import pytest
from pyspark.sql import functions as F

from promptlens.operators import ledger as L
from promptlens.operators import reports as E
from promptlens.schemas import LEDGER
from promptlens.sources import audit_log as AL
from promptlens.sources import exports as X
from promptlens.sources import ledger_io as IO
from promptlens.session import scratch_path

NOW = 1_706_661_000.0  # 2024-01-31 00:30:00 UTC


def row(i, ts, status="BLOCKED", severity="CRITICAL", rule="Instruction override", ip="1.1.1.1", masked=0,
        payload="p", latency=10.0, snippet=None, sanitized=None):
    from datetime import datetime, timezone
    text = datetime.fromtimestamp(ts, timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
    return (f"id{i:04d}", text, float(ts), status, severity, float(latency), masked, len(payload.encode()), rule,
            payload, sanitized if sanitized is not None else ("" if status == "BLOCKED" else payload), ip,
            snippet if snippet is not None else payload[:80])


def ledger_of(spark, rows):
    return spark.createDataFrame(rows, LEDGER)


def test_sqlite_like_search(spark):
    led = ledger_of(spark, [row(1, NOW, payload="discount 100% off x"), row(2, NOW, payload="100a_x"),
                            row(3, NOW, payload="Éclair"), row(4, NOW, payload="éclair"),
                            row(5, NOW, payload="path c:\\dir")])
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(L.ledger_search(led, "100%_x")) == ["id0001", "id0002"]       # wildcards stay wildcards
    assert ids(L.ledger_search_literal(led, "100%_x")) == []                 # literal in the dashboard filter
    assert ids(L.ledger_search(led, "É")) == ["id0003"]                      # ASCII-only case folding
    assert ids(L.ledger_search_literal(led, "É")) == ["id0003", "id0004"]
    assert ids(L.ledger_search(led, "C:\\DIR")) == ["id0005"]                # backslash is not an escape
    assert ids(L.ledger_search(led, "")) == ["id0001", "id0002", "id0003", "id0004", "id0005"]


def test_recent_and_query(spark):
    led = ledger_of(spark, [row(i, NOW - i, status="PASSED" if i % 2 else "BLOCKED") for i in range(20)])
    assert [r["id"] for r in L.ledger_recent(led, 3).collect()] == ["id0000", "id0001", "id0002"]
    assert [r["id"] for r in L.ledger_query(led, 2, "PASSED").collect()] == ["id0001", "id0003"]
    with pytest.raises(ValueError):
        L.ledger_recent(led, 501)


def test_chart_boundary_and_merge(spark):
    rows = [row(1, NOW - 86400), row(2, NOW - 86399), row(3, NOW - 100)]  # 00:30 yesterday excluded, 00:30:01 kept
    led = ledger_of(spark, rows)
    chart = [(r["hour"], r["status"], r["count"]) for r in E.chart_24h(led, NOW).collect()]
    assert chart == [("00:00", "BLOCKED", 2)]  # yesterday's and today's 00h merge
    hourly = sorted((r["hour"], r["count"]) for r in E.hourly_stats_7d(led, NOW).collect())
    assert hourly == [("2024-01-30 00:00", 2), ("2024-01-31 00:00", 1)]


def test_dense_chart(spark):
    led = ledger_of(spark, [row(1, NOW - 100), row(2, NOW - 3600 * 3, status="PASSED")])
    rows = E.chart_dense_12h(led, NOW).orderBy("slot").collect()
    assert [r["hour"] for r in rows][-1] == "00:00" and rows[0]["hour"] == "13:00"
    assert rows[-1]["blocked"] == 1 and rows[-4]["passed"] == 1 and rows[0]["total"] == 0
    assert {r["scale"] for r in rows} == {1}


def test_top_patterns_severity_and_recent(spark):
    led = ledger_of(spark, [row(1, NOW - 10, severity="CRITICAL"), row(2, NOW - 20, severity="MEDIUM"),
                            row(3, NOW - 30, severity="MEDIUM", rule="Role override", ip=None)])
    tp = [(r["matched_rule"], r["count"], r["severity"]) for r in E.top_patterns(led).collect()]
    assert tp == [("Instruction override", 2, "CRITICAL"), ("Role override", 1, "MEDIUM")]
    assert len(E.recent_threats_24h(led, NOW).filter(F.col("matched_rule") == "Instruction override").collect()) == 2
    src = {r["ip_address"]: r["count"] for r in E.attack_sources(led).collect()}
    assert src == {"1.1.1.1": 2, None: 1}
    rep = E.threat_report(led, NOW).collect()
    assert {r["section"] for r in rep} == {"top_patterns", "attack_sources", "severity_distribution",
                                           "recent_threats_24h"}


def test_empty_ledger_reports(spark):
    led = ledger_of(spark, [])
    p = E.performance_summary(led).collect()[0]
    assert p["avg_latency"] is None and p["min_latency"] is None and p["avg_payload_size"] is None
    s = E.pii_summary(led).collect()[0]
    assert s["total_tokens_masked"] is None and s["events_with_pii"] == 0
    c = E.counters_total(led).collect()[0]
    assert tuple(c) == (0, 0, 0, 0)


def test_averages_exact_half_up(spark):
    led = ledger_of(spark, [row(1, NOW, latency=0.01), row(2, NOW, latency=0.02), row(3, NOW, latency=0.02),
                            row(4, NOW, latency=0.02)])
    assert E.performance_summary(led).collect()[0]["avg_latency"] == 0.0175


def test_prune_and_counters(spark, monkeypatch):
    rows = [row(i, NOW - i) for i in range(501)]
    led = ledger_of(spark, rows)
    kept = L.prune_max_events(led, 500)
    assert kept.count() == 500 and kept.filter(F.col("id") == "id0500").count() == 0
    assert E.counters_total(led).collect()[0]["total_processed"] == 501
    big = L.prune_max_events(led.repartition(7), 123)
    assert sorted(r["id"] for r in big.collect()) == [f"id{i:04d}" for i in range(123)]


def test_prune_expired(spark):
    led = ledger_of(spark, [row(1, NOW - 30 * 86400 - 1), row(2, NOW - 30 * 86400), row(3, NOW)])
    assert sorted(r["id"] for r in L.prune_expired(led, NOW, 30).collect()) == ["id0002", "id0003"]


def test_dedup_first_write_wins(spark):
    led = ledger_of(spark, [row(1, NOW, latency=1.0), row(1, NOW + 5, latency=2.0), row(2, NOW)])
    got = {r["id"]: r["latency_ms"] for r in L.ledger_dedup(led).collect()}
    assert got == {"id0001": 1.0, "id0002": 10.0}


def test_sanitized_diff_and_view(spark):
    led = ledger_of(spark, [row(1, NOW, status="SANITIZED", payload="a@b.co x", sanitized="[REDACTED] x", masked=1),
                            row(2, NOW, status="PASSED", payload="y" * 71)])
    d = L.sanitized_diff(led).collect()
    assert [(r["id"], r["redaction_marks"]) for r in d] == [("id0001", 1)]
    v = {r["id"]: r for r in L.ledger_view(led).collect()}
    assert v["id0002"]["payload_view"] == "y" * 70 + "…" and v["id0002"]["has_more"]


def test_export_csv_cells(spark):
    led = ledger_of(spark, [row(1, NOW, status="PASSED", rule=None, snippet='say "hi"\nnow', latency=7.0)])
    lines = [r["line"] for r in X.export_csv(led).orderBy("row_no").collect()]
    assert lines[0] == "id,timestamp,status,severity,latency_ms,tokens_masked,payload_bytes,matched_rule,snippet"
    assert lines[1] == '"id0001","2024-01-31 00:30:00","PASSED","CRITICAL",7,0,1,"","say \\"hi\\"\\nnow"'


def test_ledger_io_roundtrip_and_reset(spark):
    path = scratch_path(spark, "test-ledger")
    led = ledger_of(spark, [row(i, NOW - i * 40000) for i in range(5)])
    IO.ledger_append(led, path)
    back = IO.ledger_scan(spark, path)
    assert back.count() == 5 and "event_date" in back.columns
    assert IO.ledger_scan(spark, path).filter(F.col("event_date") >= "2024-01-30").count() == 3
    IO.ledger_reset(spark, path)
    assert IO.ledger_scan(spark, path).count() == 0


def test_audit_log_parse(spark):
    lines = spark.createDataFrame([
        ("2026-05-27 16:30:05 [WARNING] gateway — BLOCKED [da982a1c-24b] ip=127.0.0.1 rule=Instruction override",),
        ("2026-05-28 13:00:50 [INFO] gateway — SANITIZED [29204aa1-919] ip=127.0.0.1 masked=4",),
        ("2026-05-27 16:28:34 [INFO] gateway — Database initialised at ledger.db",),
        ("garbage",)], "value string")
    got = AL.parse_audit_lines(lines).collect()
    assert (got[0]["status"], got[0]["rule"], got[0]["masked"]) == ("BLOCKED", "Instruction override", None)
    assert (got[1]["status"], got[1]["event_id"], got[1]["masked"]) == ("SANITIZED", "29204aa1-919", 4)
    assert got[2]["status"] is None and got[2]["level"] == "INFO"
    assert got[3]["ts"] is None and got[3]["message"] == "garbage"


def test_reports_on_stored_ledger_equal_in_memory(spark):
    """Partition bounds on the stored ledger only skip partitions, never rows."""
    from tests.paths import SF_SMOKE
    from promptlens.plans import testdata as TD
    mem = TD.ledger(spark, SF_SMOKE)
    path = scratch_path(spark, "test-stored-ledger")
    IO.ledger_append(mem, path)
    disk = IO.ledger_scan(spark, path)
    now = TD.NOW_UNIX
    for build in (lambda d: E.daily_stats_30d(d, now), lambda d: E.hourly_stats_7d(d, now),
                  lambda d: E.chart_24h(d, now), lambda d: E.recent_threats_24h(d, now),
                  lambda d: L.prune_expired(d, now, 7).select(*mem.columns)):
        assert sorted(build(mem).collect()) == sorted(build(disk).collect())


@pytest.mark.parametrize("report", [E.threat_report, E.analytics_report])
def test_reports_scan_the_ledger_once(spark, report):
    """One scan in the plan, no reused or repeated branch, and no view left behind."""
    at = scratch_path(spark, "ledger")
    IO.ledger_append(spark.createDataFrame([row(i, NOW - 3600 * i, rule=f"r{i % 13}", ip=f"1.1.1.{i}") for i in range(40)], LEDGER), at)
    views = len(spark.catalog.listTables())
    df = report(IO.ledger_scan(spark, at), NOW)
    assert df.count() > 20
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan") == 1 and len(spark.catalog.listTables()) == views
    empty = report(IO.ledger_scan(spark, at).limit(0), 0.0).collect()
    assert [r.section for r in empty] in ([], ["performance", "pii_detection"])


def _by_order(rows, n):
    """The first ``n`` of (unix_ts, id), newest first, null times last and smaller ids first; rows equal to the last one stay."""
    key = lambda r: (float("inf") if r[0] is None else -r[0], r[1] is not None, (r[1] or "").encode())
    ordered = sorted(rows, key=key)
    return sorted((r for r in ordered if n and len(ordered) >= n and key(r) <= key(ordered[n - 1])) if len(ordered) >= n else ordered, key=key)


@pytest.mark.parametrize("cells,held", [(1024, 10_000), (3, 2)])
def test_retention_cut_against_sorting(spark, monkeypatch, cells, held):
    """Null, equal and distant times, null, empty, long and repeated ids, at every cut."""
    import random
    monkeypatch.setattr(L, "CUT_CELLS", cells)
    monkeypatch.setattr(L, "CUT_ROWS", held)
    rnd = random.Random(5)
    rows = [(rnd.choice([None, 5.0, 5.0, 5.5, 1e9 + rnd.random(), -3.25, 0.0]), rnd.choice([None, "", "a", "ab", "abc", "abcdefgh", "é", "z" * 9, f"id{rnd.randrange(40)}"])) for _ in range(60)]
    led = spark.createDataFrame(rows, "unix_ts double, id string").repartition(3)
    key = lambda r: (float("inf") if r[0] is None else -r[0], r[1] is not None, (r[1] or "").encode())
    for n in (1, 7, 30, 55, 60, 61):
        assert sorted((tuple(r) for r in L.prune_max_events(led, n).collect()), key=key) == _by_order(rows, n)
    assert L.prune_max_events(led.filter("id = 'none'"), 5).collect() == [] == L.prune_max_events(led, 0).collect()


def test_retention_cut_of_one_hot_minute(spark):
    """A million rows in one minute, half of them at one time: what is ordered in a task stays bounded."""
    led = spark.range(1_000_000).select(F.when(F.col("id") % 2 == 0, 1000.0).otherwise(990.0 + (F.col("id") * 7919 % 1_000_003) / 1e5).alias("unix_ts"), F.sha2(F.col("id").cast("string"), 256).alias("id"))
    for n in (300_000, 700_000):
        cell, left = L.cut_cell(L._newest_first(led), n)
        assert 0 < left <= cell.count() <= L.CUT_ROWS
        assert L.prune_max_events(led, n).count() == n


def test_dedup_moves_and_sorts_no_payload(spark):
    rows = [("a", 2.0, "late"), ("a", 1.0, "first"), ("b", 1.0, "only"), ("c", 1.0, "twice"), ("c", 1.0, "twice"), (None, 3.0, "x"), (None, 2.0, "y"), ("d", None, "n"), ("d", 1.0, "o"),
            ("e", 1.0, "one"), ("e", 1.0, "two")] + [("hot", float(i), f"p{i}") for i in range(500, 0, -1)]
    led = spark.createDataFrame(rows, "id string, unix_ts double, full_payload string").repartition(5)
    got = {}
    for r in L.ledger_dedup(led).collect():
        assert r.id not in got
        got[r.id] = r.full_payload
    assert got.pop("e") in ("one", "two")
    assert got == {"a": "first", "b": "only", "c": "twice", None: "y", "d": "n", "hot": "p1"}
    plan = L.ledger_dedup(led)._jdf.queryExecution().executedPlan().toString()
    lines = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x or " Sort [" in x or "SortAggregate" in x]
    assert lines and not [x for x in lines if "full_payload" in x.split("]")[0] or "SortAggregate" in x]
