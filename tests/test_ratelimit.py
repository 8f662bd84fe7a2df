"""Rate limiter: fixture vectors, brute force against the Python loop, window property."""

import pytest
from pyspark.sql import functions as F

import model
from tests.paths import SF_SMALL
from promptlens.operators import ratelimit as RL
from promptlens.plans import testdata as TD


def _decide(spark, rows, limit=100, window=60.0):
    df = spark.createDataFrame(rows, "id string, ip_address string, unix_ts double")
    return {r["id"]: r["admitted"] for r in RL.rate_limit_admit(df, limit=limit, window=window).collect()}


def test_hundred_then_boundary(spark):
    rows = [(f"a{i:03d}", "1.1.1.1", 0.0) for i in range(100)]
    rows += [("b", "1.1.1.1", 59.9), ("c", "1.1.1.1", 60.0)]
    got = _decide(spark, rows)
    assert all(got[f"a{i:03d}"] for i in range(100))
    assert got["b"] is False  # denied and not remembered
    assert got["c"] is True   # 60 - 0 is not < 60: every earlier hit expired


def test_denied_hits_are_forgotten(spark):
    rows = [(f"a{i:03d}", "ip", 0.0) for i in range(101)] + [(f"b{i:03d}", "ip", 60.0) for i in range(100)]
    got = _decide(spark, rows)
    assert sum(got.values()) == 200 and list(got.values()).count(False) == 1


def test_keys_are_independent_and_null_is_a_key(spark):
    rows = [(f"a{i}", "x", float(i)) for i in range(3)] + [(f"b{i}", "y", float(i)) for i in range(3)]
    rows += [(f"n{i}", None, float(i)) for i in range(3)]
    got = _decide(spark, rows, limit=2, window=100.0)
    assert [got[f"{p}{i}"] for p in "abn" for i in range(3)] == [True, True, False] * 3


@pytest.mark.parametrize("limit,window", [(3, 21600.0), (5, 3600.0), (1, 60.0), (100, 60.0)])
def test_brute_force_on_events(spark, limit, window):
    req = TD.requests(spark, SF_SMALL).select("id", "ip_address", "unix_ts")
    want = model.rate_limit([(r["ip_address"], r["unix_ts"], r["id"]) for r in req.collect()], limit, window)
    got = {r["id"]: r["admitted"] for r in RL.rate_limit_decisions(req, limit=limit, window=window).collect()}
    assert got == want


def test_admitted_per_window_never_exceeds_limit(spark):
    req = TD.requests(spark, SF_SMALL).select("id", "ip_address", "unix_ts")
    dec = RL.rate_limit_admit(req, limit=3, window=21600.0).filter("admitted").collect()
    by_key = {}
    for r in dec:
        by_key.setdefault(r["ip_address"], []).append(r["unix_ts"])
    for ts in by_key.values():
        ts.sort()
        j = 0
        for i, t in enumerate(ts):
            while t - ts[j] >= 21600.0:
                j += 1
            assert i - j + 1 <= 3


def test_denials_report(spark):
    req = TD.requests(spark, SF_SMALL).select("id", "ip_address", "unix_ts")
    rep = RL.rate_limit_denials(RL.rate_limit_admit(req, limit=3, window=21600.0))
    tot = rep.agg(F.sum("requests"), F.sum("denied")).collect()[0]
    assert tot[0] == 10000 and 0 < tot[1] < 10000


def _bursty(seed, n_keys=3, n=1500):
    """A hot key with alternating calm and overloaded stretches, no idle gaps, ties."""
    import random
    rnd = random.Random(seed)
    rows, t = [], 1_700_000_000.0
    for i in range(n):
        calm = (i // 150) % 2 == 0
        t += rnd.uniform(2.5, 4.0) if calm else rnd.uniform(0.0, 0.4)
        if rnd.random() < 0.05:
            t = float(round(t))  # ties on whole seconds
        key = "hot" if rnd.random() < 0.8 else (f"k{rnd.randrange(n_keys)}" if rnd.random() < 0.9 else None)
        rows.append((f"r{i:05d}", key, t))
    return rows


@pytest.mark.parametrize("limit,window,seed", [(5, 10.0, 2), (5, 10.0, 32), (2, 7.5, 3), (40, 30.0, 2)])
def test_bursty_hot_key_against_loop(spark, limit, window, seed):
    rows = _bursty(limit * 7 + seed)
    df = spark.createDataFrame(rows, "id string, ip_address string, unix_ts double")
    want = model.rate_limit([(k, ts, i) for i, k, ts in rows], limit, window)
    got = {r["id"]: r["admitted"] for r in RL.rate_limit_decisions(
        df, limit=limit, window=window).collect()}
    assert got == want
    assert 0 < list(want.values()).count(False) < len(rows)


def test_busy_key_without_idle_gap_is_split(spark):
    # One key, a hit every 2 s for 2,000 hits: never idle for a whole window
    # (10 s), but always under the limit, so nearly every hit is a split point.
    rows = [(f"r{i:05d}", "hot", 1000.0 + 2.0 * i) for i in range(2000)]
    df = spark.createDataFrame(rows, "id string, ip_address string, unix_ts double")
    keyed = df.select(F.col("ip_address").alias("__k"), F.col("unix_ts").alias("__ts"), F.col("id").alias("__id"))
    segs = RL._segments(keyed, 6, 10.0).select("__seg").distinct().count()
    assert segs > 1000
    got = RL.rate_limit_decisions(df, limit=6, window=10.0)
    assert got.filter("admitted").count() == 2000


def test_requests_that_share_id_time_and_key_get_as_many_admissions_as_the_loop(spark):
    """Null ids, repeated ids, identical rows and null keys; limit 3 in 10 s."""
    rows = [(None, "a", 100.0, f"p{i}") for i in range(200)]                                   # only three of these
    rows += [("x", "a", 105.0, "late")] * 2 + [("x", "a", 120.0, "again")] * 2 + [("x", "b", 120.0, "other key")]
    rows += [(None, None, 100.0, "same")] * 5 + [("y", None, 100.0, None)]
    df = spark.createDataFrame(rows, "id string, ip_address string, unix_ts double, note string")
    out = RL.rate_limit_admit(df, limit=3, window=10.0)
    assert out.columns == ["id", "ip_address", "unix_ts", "note", "admitted"]
    got = {}
    for r in out.collect():
        n, a = got.get((r.id, r.ip_address, r.unix_ts), (0, 0))
        got[r.id, r.ip_address, r.unix_ts] = (n + 1, a + r.admitted)
    assert got == {(None, "a", 100.0): (200, 3), ("x", "a", 105.0): (2, 0), ("x", "a", 120.0): (2, 2), ("x", "b", 120.0): (1, 1),
                   (None, None, 100.0): (5, 3), ("y", None, 100.0): (1, 0)}
    again = RL.rate_limit_admit(df.repartition(3), limit=3, window=10.0)
    assert sorted(map(str, out.collect())) == sorted(map(str, again.collect()))
    assert RL.rate_limit_admit(df.limit(0), limit=3, window=10.0).collect() == []


def test_admission_numbers_no_payload_of_distinct_requests(spark):
    df = spark.createDataFrame([(f"r{i}", "k", float(i), "text") for i in range(50)], "id string, ip_address string, unix_ts double, note string")
    plan = RL.rate_limit_admit(df, limit=3, window=10.0)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "row_number()" in line]
    assert windows and all("__h" in line for line in windows)
