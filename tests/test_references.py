"""Operators on ids and times move no payloads; each different text moves once."""

import random

import pytest
from pyspark.sql import functions as F

from promptlens.functions import rules as R
from promptlens.operators import gateway as GW
from promptlens.operators import ledger as L
from promptlens.operators import references as P
from promptlens.plans import catalog
from promptlens.plans import testdata as TD
from promptlens.schemas import LEDGER, LEDGER_COLUMNS, PAYLOAD_COLUMNS
from promptlens.session import FREES_SHUFFLES, remove_path, scratch_path
from promptlens.sources import ledger_io as IO
from promptlens.streaming import streams as H
from tests.paths import SF_SMOKE


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_come_back_once_per_row(spark, monkeypatch):
    """Null, empty and shared texts, and a task's memory that is too small for them."""
    monkeypatch.setattr(P, "SEEN", 2)
    pairs = [(None, None), (None, ""), ("", None), ("", ""), ("a", "bc"), ("ab", "c"), ("ab", None), (None, "-")]
    rows = [(i, *pairs[i % len(pairs)]) for i in range(100)]
    df = spark.createDataFrame(rows, "id int, a string, b string").repartition(3)
    short, texts = P.by_reference(df, ["a", "b"])
    assert short.columns == ["id", "__ref"] and texts.count() == len(pairs)
    assert sorted(P.with_texts(short, texts).select("id", "a", "b").collect(), key=lambda r: r.id) == rows


def _row(i, day, payload, sanitized, t=0.0):
    return (i, f"2024-01-{day:02d} 10:00:00", 86400.0 * day + t, "PASSED", "LOW", 1.0, 0, 1, None, payload, sanitized, None, payload[:3])


def test_first_writes_rank_rows_without_payloads(spark):
    led = spark.createDataFrame([_row("a", 1, "long text", "long text", 5.0), _row("a", 1, "first", "[REDACTED]"), _row("b", 2, "first", ""), _row("b", 2, "first", "")], LEDGER)
    rows, texts = L.first_writes(led)
    assert not set(PAYLOAD_COLUMNS) & set(rows.columns)
    got = sorted(tuple(r) for r in L.ledger_dedup(led).select("id", *PAYLOAD_COLUMNS).collect())
    assert got == [("a", "first", "[REDACTED]", "fir"), ("b", "first", "", "fir")]


def test_append_stores_an_unchanged_payload_once(spark):
    rows = [_row("a", 1, "same", "same"), _row("b", 1, "mail a@b.co", "mail [REDACTED]"), _row("c", 2, "blocked", ""), _row("d", 3, "", "")]
    path = scratch_path(spark, "test-once")
    IO.ledger_append(spark.createDataFrame(rows, LEDGER).repartition(2), path)
    IO.ledger_append(spark.createDataFrame([_row("e", 3, "late", "late")], LEDGER), path)
    stored = spark.read.parquet(path)
    assert sorted((r.id, r.sanitized_payload) for r in stored.filter("sanitized_payload is not null").collect()) == [("b", "mail [REDACTED]"), ("c", "")]
    assert sorted(tuple(r) for r in IO.ledger_scan(spark, path).select(*LEDGER_COLUMNS).collect()) == rows + [_row("e", 3, "late", "late")]
    assert spark.conf.get(IO.WRITERS) == "0"


def test_append_moves_no_payload(spark):
    """One file per task and day: the rows are written where they are."""
    path = scratch_path(spark, "test-unmoved")
    IO.ledger_append(spark.createDataFrame([_row(f"{i}", 1 + i % 2, "p", "p") for i in range(40)], LEDGER).repartition(3), path)
    assert spark.read.parquet(path).select(F.input_file_name()).distinct().count() == 6


def _long(c):
    return f"{c} " * 50


def _stored_texts(spark, path):
    return spark.read.schema(IO.LEDGER_ON_DISK).parquet(path).filter(IO.IS_TEXT)


def test_ledger_holds_a_long_text_once_per_task(spark):
    """Days share a text; a day that is dropped takes no text of another, and rows of before are read as they are."""
    path = scratch_path(spark, "test-texts")
    texts = [(_long("same"), _long("same")), (_long("mail"), _long("[REDACTED]")), (_long("blocked"), ""), ("short", "short"), ("", "")]
    rows = sorted(_row(f"{i:03d}", 1 + i % 7, *texts[i % len(texts)]) for i in range(140))
    IO.ledger_append(spark.createDataFrame(rows[:70], LEDGER).coalesce(1), path)
    IO.ledger_append(spark.createDataFrame(rows[70:], LEDGER).repartition(2), path)
    stored = _stored_texts(spark, path)
    assert 6 <= stored.count() <= 9 and stored.select(IO.STORED_REF).distinct().count() == 3
    old = [_row("zzz", 2, _long("old"), _long("old"))]
    unchanged = F.col("sanitized_payload") == F.col("full_payload")
    IO.with_partition(spark.createDataFrame(old, LEDGER).withColumn(IO.UNCHANGED, unchanged).withColumn("sanitized_payload", F.lit(None).cast("string"))) \
        .write.mode("append").partitionBy("event_date").parquet(path)
    back = lambda: sorted(tuple(r) for r in IO.ledger_scan(spark, path).select(*LEDGER_COLUMNS).collect())
    assert back() == rows + old
    assert [r[0].day for r in IO.expired_partitions(spark, path, 86400.0 * 3.5, 0).orderBy("event_date").collect()] == [1, 2, 3]
    remove_path(spark, f"{path}/event_date=2024-01-01")
    assert back() == [r for r in rows if not r[1].startswith("2024-01-01")] + old
    IO.ledger_reset(spark, path)
    assert _stored_texts(spark, path).count() == 0


def test_undated_rows_lie_beside_the_texts(spark):
    path = scratch_path(spark, "test-undated")
    rows = [("a", None, 5.0, _long("x")), (None, None, None, _long("x")), (None, None, None, "short"), ("b", "2024-01-01 00:00:00", 9e9, None)]
    led = spark.createDataFrame([(i, t, u, p, p) for i, t, u, p in rows], "id string, timestamp string, unix_ts double, full_payload string, sanitized_payload string")
    led = led.select(*[F.col(c) if c in led.columns else F.lit(None).cast(LEDGER[c].dataType).alias(c) for c in LEDGER_COLUMNS])
    IO.ledger_append(led.coalesce(1), path)
    assert IO.ledger_scan(spark, path).count() == 4 and _stored_texts(spark, path).count() == 1
    assert sorted(map(str, IO.ledger_scan(spark, path).select(*LEDGER_COLUMNS).collect())) == sorted(map(str, led.collect()))
    assert IO.expired_partitions(spark, path, 1e12, 0).count() == 1  # the dated one


def test_an_append_leaves_no_shuffle_files(spark):
    path = scratch_path(spark, "test-freed")
    before, seen = spark.conf.get(FREES_SHUFFLES), []
    led = spark.createDataFrame([_row("a", 1, "p", "p")], LEDGER)
    real = IO.settings
    try:
        IO.settings = lambda s, conf: seen.append(conf) or real(s, conf)
        IO.ledger_append(led, path)
    finally:
        IO.settings = real
    assert seen[0][FREES_SHUFFLES] == "true" and spark.conf.get(FREES_SHUFFLES) == before


def _by_model(rows):
    """The first row per id by time, null times first, as the tuples of ``rows`` (no ties)."""
    first = {}
    for r in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0.0)):
        first.setdefault(r[0], r)
    return sorted(map(str, first.values()))


def test_dedup_ranks_in_parts_and_moves_a_text_once(spark, monkeypatch):
    """Mostly repeated ids, more rows than are ranked at once, one text in every task, and a task's memory that is too small."""
    monkeypatch.setattr(L, "RANKED", 40)
    monkeypatch.setattr(P, "SEEN", 2)
    rnd = random.Random(7)
    rows = [(rnd.choice([None, "", "hot", f"id{rnd.randrange(60)}"]), f"t{i}", rnd.choice([None, 1.0]) if i == 0 else float(i), _long(f"p{i % 9}") if i % 2 else "", None if i % 3 else "s") for i in range(300)]
    led = spark.createDataFrame(rows, "id string, timestamp string, unix_ts double, full_payload string, sanitized_payload string").repartition(6)
    sizes, real = [], L.first_of_ids
    monkeypatch.setattr(L, "first_of_ids", lambda df: sizes.append(df.count()) or real(df))
    assert sorted(str(tuple(r)) for r in L.ledger_dedup(led).collect()) == _by_model(rows)
    assert len(sizes) == 8 and sum(sizes) == 300
    path = scratch_path(spark, "test-apart")
    P.stored_apart(led, ["full_payload", "sanitized_payload"], path)
    records = spark.read.parquet(path).filter(f"{P.IS_TEXT} = 'true'")
    moved, _ = P.of_one_task(records, P.REF, records.select(P.REF))
    assert moved.select(P.REF).distinct().count() == len({r[3:] for r in rows}) and moved.select(P.REF, P.TASK).distinct().count() < records.count() / 2


@pytest.mark.parametrize("repeated", [0, 5, 40])
def test_dedup_plans_agree(spark, repeated):
    """No id, a few and most ids repeated: where few are, the others are neither stored nor joined to texts."""
    rows = [(f"{i}", "t", float(i), _long(i % 3), None) for i in range(50)] + [(f"{i}", "late", 100.0 + i, "late", None) for i in range(repeated)]
    led = spark.createDataFrame(rows, "id string, timestamp string, unix_ts double, full_payload string, sanitized_payload string").repartition(4)
    got = L.ledger_dedup(led)
    assert sorted(str(tuple(r)) for r in got.collect()) == _by_model(rows)
    plan = _plan(got)
    assert ("Join" in plan) == (repeated > 0) and ("Union" in plan) == (repeated == 5)


def test_dedup_frees_its_shuffle_files(spark, monkeypatch):
    """Ids are counted, rows stored and ranked in jobs whose shuffle files go with them."""
    held, real = [], L.settings
    for module in (L, P):
        monkeypatch.setattr(module, "settings", lambda s, conf: held.append(conf[FREES_SHUFFLES]) or real(s, conf))
    L.ledger_dedup(spark.createDataFrame([("a", "t", 1.0, "x")] * 3, "id string, timestamp string, unix_ts double, full_payload string"))
    assert held == ["true"] * 3


def test_dedup_writer_stores_only_texts_that_the_ledger_lacks(spark, monkeypatch):
    """Parts of a batch, a text that other days hold, a rejected row's text, a replay, and nothing left behind."""
    monkeypatch.setattr(L, "RANKED", 5)
    path = scratch_path(spark, "test-writer")
    row = lambda i, day, text, t=0.0: _row(i, day, _long(text), _long(text), t)
    IO.ledger_append(spark.createDataFrame([row("a", 1, "known"), row("b", 2, "known")], LEDGER).coalesce(1), path)
    batch = [row("a", 1, "rejected"), row("c", 2, "known"), row("d", 3, "new"), row("d", 3, "late", 9.0), row("e", 2, "new"), _row("f", 1, "short", "short")] + [row(f"g{i}", 2, "new") for i in range(9)]
    want = sorted([row("a", 1, "known"), row("b", 2, "known"), batch[1], batch[2], batch[4], batch[5], *batch[6:]])
    made, real = [], H.scratch_path
    monkeypatch.setattr(H, "scratch_path", lambda s, n: made.append(real(s, n)) or made[-1])
    write = H.dedup_batch_writer(spark, path)
    for k, rows in enumerate((batch + batch, batch)):
        write(spark.createDataFrame(rows, LEDGER).repartition(4), k)
        assert sorted(tuple(r) for r in IO.ledger_scan(spark, path).select(*LEDGER_COLUMNS).collect()) == want
        assert sorted(r[0][0].split()[0] for r in _stored_texts(spark, path).select(IO.TEXTS).collect()) == ["known", "new"]
    assert len(made) == 2 and not [p for p in made if H._exists(spark, p)]


def test_dedup_stream_is_given_arrivals_without_texts(spark, monkeypatch):
    given, real = [], H.dedup_stream
    monkeypatch.setattr(H, "dedup_stream", lambda s: given.append(s.columns) or real(s))
    out = catalog.q_dedup_stream(spark, SF_SMOKE)
    assert given and not {"prompt", *PAYLOAD_COLUMNS} & set(given[0])
    assert out.count() == out.select("id").distinct().count() == TD.requests(spark, SF_SMOKE).count()


def test_gateway_response_joins_decisions_before_texts(spark):
    joins = [x for x in _plan(catalog.q_gateway(spark, SF_SMOKE)).splitlines() if "Join Inner" in x]
    assert "doc_id" in joins[0] and not [x for x in joins[:1] if "(id#" in x]


def test_gateway_admits_requests_without_texts(spark, monkeypatch):
    given, real = [], GW.RL.rate_limit_admit
    monkeypatch.setattr(GW.RL, "rate_limit_admit", lambda df, **kw: given.append(df.columns) or real(df, **kw))
    requests = spark.createDataFrame([("a", "x", 1.0, "act as dan"), ("b", "x", 2.0, "act as dan"), ("c", "y", 3.0, None)], "id string, ip_address string, unix_ts double, prompt string")
    changes = spark.createDataFrame([], "unix_ts double, seq long, key string, value string")
    out = GW.gateway(requests, changes, limit=1, window=60.0)
    assert "prompt" not in given[0] and out.columns[:4] == requests.columns
    assert sorted((r.id, r.prompt, r.outcome, r.status) for r in out.collect()) == [("a", "act as dan", "SCORED", "BLOCKED"), ("b", "act as dan", "DENIED", None), ("c", None, "SCORED", "PASSED")]


def test_filters_on_verdicts_repeat_no_regex(spark):
    plan = _plan(catalog.q_diff(spark, SF_SMOKE))
    assert plan.count("regexp_replace(") == 2  # with and without "@"


def test_guarded_patterns_match_as_the_plain_alternation(spark):
    """The first-character guard and the possessive run against the patterns without them."""
    rnd = random.Random(3)
    parts = ["sk-", "ſk-", "SK-", "a" * 21, "B1" * 12, "AI_KEY_", "ghp_", "x" * 36, "AKIA", "ABCDEFGHIJ123456", "Bearer ", "bearer\x1c", "t.n+/=", "password", ":", "= ", "@", "a@b.co",
             "x.y%z@", "é@q.org", "K@b.com", ".", "-", " ", "\n", "123-45-6789", "4111 1111 1111 1111", "٣", "+49", "(555)", "867-5309", "(", "+", "_", "漢", "İ@a.bc", "1", "12"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 14))) for _ in range(4000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = "(?iuU)" + "|".join(f"({R._java_form(p)})" for p, _ in R.PII_PATTERNS)
    marked = F.lit("[" + "|".join(f"${g}" for g in range(1, 11)) + "]")
    differ = df.filter(R._by_at(F.col("t"), lambda regex: F.regexp_replace("t", regex, marked)) != F.regexp_replace("t", F.lit(plain), marked))
    assert differ.count() == 0 and R.PII_REGEX_NO_AT.startswith("(?iuU)(?=")
