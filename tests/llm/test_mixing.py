"""The mix against water filling step by step, and the schedule against its weights."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from conftest_llm import SF_SMOKE

from promptlens.llm import mixing, queries


def fill(sizes):
    """Targets by resharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, full = 1.5 * sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in full]
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            return full | share
        for s in over:
            full[s] = 2.0 * sizes[s]
        left = 1.5 * sum(sizes.values()) - sum(full.values())


def brute(rows):
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    total = Counter()
    for i, _, s in rows:
        total[s] += size[i]
    goal = fill(total)
    of = defaultdict(list)
    for i, _, s in rows:
        of[s].append(i)
    taken = Counter()
    for s, ids in of.items():
        left = int(goal[s] + 0.5)
        for _ in range(2):
            for i in sorted(ids, key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i)):
                n = min(size[i], left)
                taken[i] += n
                left -= n
    return {i: (size[i], total[s], pytest.approx(goal[s], rel=1e-12), taken[i]) for i, _, s in rows}


@pytest.mark.parametrize("block", [7, 1024])
def test_mix_matches_water_filling(make, block):
    rows = [(i, " ".join(["w"] * (i * 37 % 90)), ["a", "b", "c", None, "d", "big"][0 if i % 7 == 0 else 5 if i % 3 else i % 5]) for i in range(400)]
    got = mixing.mixed_words(make([(i, t, "en", s) for i, t, s in rows]), block_words=block).collect()
    assert {r.doc_id: (r["size"], r.source_size, r.target, r.taken) for r in got} == brute(rows)


def test_test_table(spark):
    docs = spark.read.parquet(f"{SF_SMOKE}/documents.parquet")
    got = queries.op1_mix(spark, SF_SMOKE).collect()
    assert {r.doc_id: (r["size"], r.source_size, r.target, r.taken) for r in got} == brute([(r.doc_id, r.text, r.source) for r in docs.collect()])


def test_schedule_keeps_to_the_weights_all_along(spark):
    recipe = spark.createDataFrame([(0, "a", 40_000, 3, 60_000.0), (1, "b", 50_000, 1, 20_000.0), (2, "c", 50_000, 2, 40_000.0)],
                                   "src int, source string, source_size long, weight long, target double")
    slots = sorted((r.slot, r.src, r["rank"]) for r in mixing.schedule(recipe, 100).collect())
    seen = Counter()
    for k, (_, src, rank) in enumerate(slots, 1):
        assert rank == seen[src]
        seen[src] += 1
        assert all(abs(seen[s] - k * share) < 6 for s, share in ((0, 1 / 2), (1, 1 / 6), (2, 1 / 3)))
    assert seen == {0: 600, 1: 200, 2: 400}


def test_documents_come_as_often_as_taken(make):
    table = make([(i, " ".join(["w"] * (1 + i % 9)), "en", "abc"[i % 3]) for i in range(300)])
    got = Counter(r.doc_id for r in mixing.mixed_documents(table, block_words=16).collect())
    words = {r.doc_id: (r["size"], r.taken) for r in mixing.mixed_words(table, block_words=16).collect()}
    assert {i: int(t / n + 0.5) for i, (n, t) in words.items() if int(t / n + 0.5)} == got


def test_rows_without_ids_keep_the_targets(make):
    rows = [(None if i % 2 else i, f"t{i} " + " ".join(["w"] * (i % 9)), "en", "abc"[i % 3]) for i in range(600)]
    rows += [(5000 + i % 20, f"again {i}", "en", "a") for i in range(60)]  # ids that repeat with other texts
    size, got = Counter(), Counter()
    for _, t, _, s in rows:
        size[s] += len(t.split())
    for r in mixing.mixed_documents(make(rows), block_words=16).collect():
        got[r.source] += len(r.text.split())
    assert all(abs(got[s] - want) <= 10 for s, want in fill(size).items())
