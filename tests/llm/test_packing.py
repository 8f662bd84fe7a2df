import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import SF_SMOKE
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from promptlens.llm import packing as P
from promptlens.llm import queries

ODD = ["it's I'M we'll x'y", "éte é x", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "İstanbul ΣΣ", "½ ²x 12ab3 ªºµ", "a\tb c\x0bd e\x1cf\x7f",
       "中文 \U0001f600!!", "", "  ", "\n\n", "ÀÉß÷×Ÿ x\u00a0y", "a'", "'s 's't ,.;", "AbC-dEf_9.1,,x|y<z<|"]


@pytest.fixture(scope="module")
def words():
    return P.WordIds(P.default_tokenizer())


def direct(words, text):
    return words.tokenizer.encode(text, add_special_tokens=False).ids


def test_ids_are_those_of_the_tokenizer(words):
    assert [x.tolist() for x in words.encode(ODD * 2)] == [direct(words, t) for t in ODD * 2]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aZ é'ß\n\t1.|<>×ö́İ中½ "), max_size=30), min_size=1, max_size=4))
def test_ids_of_any_text(words, texts):
    assert [x.tolist() for x in words.encode(texts)] == [direct(words, t) for t in texts]


def test_long_texts_go_in_parts(words, monkeypatch):
    text = "some words,\nand more " * 400 + "y" * 500 + " end"
    want = direct(words, text)
    monkeypatch.setattr(P, "PART_CHARS", 97)
    assert words.encode([text])[0].tolist() == want and words.encode(["a", text])[1].tolist() == want


def test_whole_table(spark):
    tokenizer = Tokenizer.from_file(P.default_tokenizer())
    got = queries.op6_packing(spark, SF_SMOKE).collect()
    ids = {r.doc_id: np.asarray(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4")
           for r in spark.read.parquet(f"{SF_SMOKE}/documents.parquet").collect()}
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_bin[r.sequence_id].append(r)
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start:r.start + r.length].tobytes())
    for doc, rs in by_doc.items():
        rs.sort(key=lambda r: r.piece)
        assert [r.piece for r in rs] == list(range(len(rs))) and [r.start for r in rs] == [2048 * k for k in range(len(rs))]
        assert all(r.length == 2048 for r in rs[:-1]) and sum(r.length for r in rs) == len(ids[doc])
    assert set(by_doc) == set(ids)
    for rs in by_bin.values():
        rs.sort(key=lambda r: r.offset)
        at = 0
        for r in rs:
            assert r.offset == at
            at += r.length
        assert at <= 2048
    lengths = np.array([r.length for r in got])
    assert P.bin_bound(lengths) <= len(by_bin) <= P.bin_bound(lengths) * 1.01 + 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_bound_holds_and_fits(lengths):
    a = np.array(lengths, np.int64)
    bins, offset, fill = P.best_fit(a, 20)
    best = _fewest(sorted(lengths, reverse=True), [])
    used = len(set(bins.tolist()))
    assert P.bin_bound(a, 20) <= best <= used
    for b in set(bins.tolist()):
        own = sorted((o, n) for o, n, c in zip(offset.tolist(), lengths, bins.tolist()) if c == b)
        assert sum(n for _, n in own) <= 20 and all(o == sum(n for _, n in own[:i]) for i, (o, _) in enumerate(own))


def _fewest(rest, bins):
    if not rest:
        return len(bins)
    best = _fewest(rest[1:], [*bins, 20 - rest[0]])
    for i in range(len(bins)):
        if bins[i] >= rest[0] and bins[i] not in bins[:i]:
            best = min(best, _fewest(rest[1:], [*bins[:i], bins[i] - rest[0], *bins[i + 1:]]))
    return best


def test_groups_exchange_documents(spark):
    rng = np.random.default_rng(1)
    sizes = rng.integers(300, 1200, 4000)
    pieces = spark.createDataFrame([(i, 0, 0, int(n), 0) for i, n in enumerate(sizes)], P.PIECE)
    alone = P.place(pieces, group_tokens=20_000, rounds=0)
    shared = P.place(pieces, group_tokens=20_000)
    a, b = (x.select("sequence_id").distinct().count() for x in (alone, shared))
    assert b < a and shared.count() == 4000
    assert shared.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0


def test_sequences_hold_the_ids(spark, words):
    docs = spark.createDataFrame([(i, "some words here " * (i % 40 * 30)) for i in range(30)], "doc_id long, text string")
    got = b"".join(sorted(r.ids for r in P.packed_ids(docs).collect()))
    want = [np.asarray(direct(words, "some words here " * (i % 40 * 30)) + [0], "<u4") for i in range(30)]
    assert sorted(np.frombuffer(got, "<u4").tolist()) == sorted(np.concatenate(want).tolist())


def test_a_worker_reads_a_batch_in_small_parts():
    """Every row once and in order; what a worker holds at once is bounded, however many rows and units a batch has."""
    texts = ["".join(f" w{i * 70 + j:07d}" for j in range(70)) for i in range(3000)] + [None, "", "x" * 9, None]
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    parts = list(P._batches(rows))
    assert [k for keys, _ in parts for k in keys] == list(range(len(texts)))
    assert [t for _, part in parts for t in part] == [t or "" for t in texts]
    assert max(len("".join(part[:-1])) for _, part in parts) < P.BATCH_BYTES
    assert list(P._batches(rows.slice(0, 0))) == []
    ids = P.WordIds(P.default_tokenizer())
    tracemalloc.start()
    for _, part in P._batches(rows):
        ids.encode(part)
    assert tracemalloc.get_traced_memory()[1] < 40 << 20
    tracemalloc.stop()
