"""The whole pipeline against plain Python versions of its five stages, on the small table with planted rows."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import test_jaccard_join
import test_mixing
from conftest_llm import SF_SMOKE
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from promptlens.llm import jaccard_join, language_id, packing

SPACES = "[\x20\x09-\x0D]+"


def plain_grams(text):
    s = re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in text.lower() + "\n")).removeprefix(" ")
    return Counter(g for n in language_id.SIZES for g in (s[i:i + n] for i in range(len(s) - n + 1)) if " " not in g[1:-1] and g.strip())


def plain_languages(docs):
    """Share of its n-grams that the best language contains, per doc_id; exact sets stand for the filters."""
    counts = defaultdict(Counter)
    for d in docs:
        if d.text is not None and d.lang is not None and zlib.crc32(str(d.doc_id).encode()) % 3 != 1:
            counts[d.lang].update(plain_grams(d.text))
    share = {x: {g: n / c.total() for g, n in c.items()} for x, c in counts.items()}
    top = Counter()
    for of in share.values():
        for g, p in of.items():
            top[g] = max(top[g], p)
    sets = {x: {g for g, n in c.items() if n >= language_id.MIN_COUNT and share[x][g] >= language_id.TYPICAL * top[g]} for x, c in counts.items()}
    assert all(len(s) <= language_id.GRAMS for s in sets.values())
    out = {}
    for d in docs:
        grams = plain_grams(d.text or "")
        out[d.doc_id] = max(sum(n for g, n in grams.items() if g in s) for s in sets.values()) / grams.total() if grams else -1.0
    return out


def plain_pipeline(docs):
    """doc_id of the rows after each of the first four stages; the last as often as the mix takes them."""
    score = plain_languages(docs)
    assert not any(0.38 < x < 0.42 for x in score.values())  # the filters' correction decides nothing here
    told = [d for d in docs if score[d.doc_id] >= language_id.MIN_SCORE]
    first = {}
    for d in sorted(told, key=lambda d: d.doc_id):
        first.setdefault(re.sub(SPACES, " ", d.text), d)
    once = list(first.values())
    classes = test_jaccard_join.brute({d.doc_id: d.text for d in once}, jaccard_join.NEAR)
    apart = [d for d in once if classes[d.doc_id][1] == d.doc_id]
    taken = test_mixing.brute([(d.doc_id, d.text, d.source) for d in apart])
    mix = Counter({i: int(t / n + 0.5) for i, (n, _, _, t) in taken.items() if n and int(t / n + 0.5)})
    return [Counter(d.doc_id for d in part) for part in (told, once, apart)] + [mix]


def plain_bins(lengths, size):
    """The number of bins of best-fit decreasing."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, g in enumerate(gaps) if g >= n]
        if fits:
            gaps[min(fits, key=gaps.__getitem__)] -= n
        else:
            gaps.append(size - n)
    return len(gaps)


def test_run_is_the_plain_pipeline(spark, tmp_path, monkeypatch):
    base = spark.read.parquet(f"{SF_SMOKE}/documents.parquet")
    ids, long = F.col("doc_id"), F.size(F.split("text", " ")) > 60
    planted = [base.where(long & (ids % 7 == 0)).withColumns({"doc_id": ids + 100_000, "text": F.regexp_replace("text", " ", " \n\t")}),
               base.where(long & (ids % 5 == 0)).withColumns({"doc_id": ids + 200_000, "text": F.concat(F.lit("changed "), "text")}),
               base.where(long & (ids % 11 == 0)).withColumns({"doc_id": ids + 300_000, "source": F.lit(None).cast("string")}),
               base.where(ids < 4).withColumns({"doc_id": ids + 400_000, "text": F.element_at(F.array(
                   F.lit("12 34 !"), F.lit(None), F.lit(""), F.lit("中文字符 测试文本")), (ids + 1).cast("int")), "lang": F.lit(None).cast("string")})]
    table = base
    for p in planted:
        table = table.unionByName(p.select(*base.columns))
    table.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").collect()

    after, write = [], corpus_pipeline.written

    def recorded(df, name):
        after.append(write(df, name))
        return after[-1]
    monkeypatch.setattr(corpus_pipeline, "written", recorded)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = plain_pipeline(docs)
    assert [Counter(r.doc_id for r in df.select("doc_id").collect()) for df in after] == want
    assert all(df.columns == base.columns for df in after)
    assert len(docs) > want[0].total() > want[1].total() > want[2].total() > 50 and set(want[3].values()) == {1, 2}
    texts = {d.doc_id: d for d in docs}
    assert all(texts[r.doc_id] == r for r in after[-1].collect())

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    pieces = Counter()
    for i, times in want[3].items():
        tokens = np.asarray(tokenizer.encode(texts[i].text, add_special_tokens=False).ids + [0], "<u4")
        for k in range(0, len(tokens), packing.MAX_TOKENS):
            part = tokens[k:k + packing.MAX_TOKENS]
            pieces[i, k // packing.MAX_TOKENS, k, len(part), zlib.crc32(part.tobytes())] += times
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == pieces
    bins = defaultdict(list)
    for r in packed:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.MAX_TOKENS
    assert len(bins) <= plain_bins([p[3] for p, n in pieces.items() for _ in range(n)], packing.MAX_TOKENS)


def test_run_of_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{SF_SMOKE}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
