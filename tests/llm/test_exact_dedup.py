import hashlib
import re
from collections import defaultdict

from conftest_llm import SF_SMALL
from pyspark.sql import functions as F

from promptlens.llm import exact_dedup as X
from promptlens.llm import queries


def brute(texts):
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in texts.items()}
    groups = defaultdict(list)
    for i, t in norm.items():
        groups[t].append(i)
    return {(i, min(groups[t]), len(groups[t]), i == min(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm.items()}


def test_query_over_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    got = queries.op8_exact_dedup(spark, SF_SMALL).collect()
    assert {tuple(r) for r in got} == brute(texts) and len(got) == len(texts)


def test_directory_splits_and_buckets_are_key_ranges(make):
    texts = {i: f"text  {i % 300}" for i in range(900)}
    table = make([(i, t, None, "a") for i, t in texts.items()])
    index, rows = X.build_index(table, bucket_entries=8, max_depth=9)
    got = index.collect()
    assert len(got) == 300 and rows.count() == 900
    held = defaultdict(list)
    for r in got:
        held[(r.bucket, r.depth)].append(r.key)
    assert len(held) > 300 // 8 and all(len(k) <= 8 or d == 9 for (_, d), k in held.items())
    for (bucket, depth), keys in held.items():
        top = lambda x: (x % 2**64) >> (64 - depth) if depth else 0
        assert {top(k) for k in keys} == {top(bucket)}
    # No two buckets share a prefix, and a split bucket's parts held too many together.
    spans = sorted(((b % 2**64), (b % 2**64) + 2**(64 - d)) for b, d in held)
    assert all(hi <= lo for (_, hi), (lo, _) in zip(spans, spans[1:]))
    assert {r.chain for r in got} == {1}
    assert {tuple(r) for r in X.exact_dedup(table, bucket_entries=8, max_depth=9).collect()} == brute(texts)


def test_colliding_keys_are_chained_by_their_bytes(make, monkeypatch):
    # A key of four values: every bucket is a chain of different texts.
    monkeypatch.setattr(X, "text_key", lambda c: F.pmod(F.crc32(F.col(c).cast("binary")), F.lit(4)))
    texts = {i: f"{'w ' * (i % 7)}x" for i in range(50)}
    got = X.exact_dedup(make([(i, t, None, "a") for i, t in texts.items()])).collect()
    assert {tuple(r) for r in got} == brute(texts)


def test_directory_decides_the_groups(make, monkeypatch):
    table = make([(i, f"text {i % 5}", None, "a") for i in range(20)])
    whole = X.directory
    # A directory without the slots of one half of the keys leaves their texts without an owner, and so without a group.
    monkeypatch.setattr(X, "directory", lambda keys, *a: whole(keys, *a).where(F.col("slot") < 2**(X.MAX_DEPTH - 1)))
    index, rows = X.build_index(table)
    upper = {r.key for r in rows.collect() if r.key < 0}
    assert upper and {r.key for r in index.collect()} == {r.key for r in rows.collect()} - upper
    assert len(X.exact_dedup(table).collect()) == sum(r.key >= 0 for r in rows.collect())


def test_hot_text_reaches_its_owner_merged(make):
    texts = {i: "the same" if i % 3 else f"own {i}" for i in range(300)}
    table = make([(i, t, None, "a") for i, t in texts.items()]).repartition(7)
    assert {tuple(r) for r in X.exact_dedup(table).collect()} == brute(texts)


def test_stage_keeps_one_of_each_group(make):
    got = X.drop_copies(make([(3, "a  b", None, "s"), (1, "a\tb", None, "s"), (2, "c", None, "s"), (9, None, None, None)]))
    assert sorted(r.doc_id for r in got.collect()) == [1, 2, 9]
