"""The join against brute force over all pairs, on groups of near copies, shared passages and small sets."""

import random
import re

import numpy as np
import pytest
from conftest_llm import SF_SMOKE

from promptlens.llm import jaccard_join as J
from promptlens.llm import queries


def plain_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(texts, m):
    sets = {i: plain_set(t, m.words) for i, t in texts.items()}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    ids = sorted(i for i in sets if sets[i])
    for a in ids:
        for b in ids:
            if a < b and m.den * len(sets[a] & sets[b]) >= m.num * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    texts, passage = [], prose(60)
    for n in (60, 150, 151, 400):  # a star of near copies of each base, from none to many edits
        base = prose(n)
        for k in range(25):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 8, 12])):
                copy[rng.randrange(n)] = rng.choice(vocabulary)
            texts.append(" ".join(copy) + (" tail" * (k % 3)))
    for _ in range(40):  # a passage in many texts
        texts.append(" ".join(prose(rng.randrange(5, 50)) + passage + prose(rng.randrange(5, 50))))
    chain = prose(120)
    for _ in range(12):  # links from text to text, whose ends are far apart
        chain = chain[4:] + prose(4)
        texts.append(" ".join(chain))
    texts += [" ".join(prose(n)) for n in range(14)] + ["A b", "a  B", "a b c", "", None, "same words here now"] * 2
    return dict(enumerate(texts))


@pytest.mark.parametrize("measure", [J.Measure(), J.NEAR, J.Measure(words=1, num=60), J.Measure(num=100)])
def test_components_are_those_of_all_pairs(make, measure):
    texts = corpus(measure.words)
    got = J.jaccard_classes(make([(i, t, None, "s") for i, t in texts.items()]).repartition(5), measure=measure).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(texts, measure)


def templated(seed):
    """Texts of one template whose own parts lie on both sides of the threshold, the bare template, and groups of near copies of some."""
    rng, fill = random.Random(seed), [f"t{i}" for i in range(40)]
    texts = []
    for n in (9, 12, 40):
        for k in range(45):
            own = [f"x{n}x{k}x{j}" for j in range(rng.choice([1, 1, 2, 4, 6]))]
            texts.append(" ".join(fill[:n] + own))
            if k % 9 == 0:
                texts += [" ".join(fill[:n] + own + [f"y{j}"]) for j in range(6)]
    texts += [" ".join(fill[:n]) for n in (9, 12, 39, 40)]
    rng.shuffle(texts)
    return dict(enumerate(texts))


@pytest.mark.parametrize("measure, outside", [(J.Measure(), 0), (J.NEAR, 5), (J.Measure(words=1, num=60), 0)])
def test_hot_blocks_lose_no_link(make, monkeypatch, measure, outside):
    monkeypatch.setattr(J, "OUTSIDE", outside)
    texts = templated(outside)
    got = J.jaccard_classes(make([(i, t, None, "s") for i, t in texts.items()]).repartition(5), measure=measure).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(texts, measure)


def test_texts_of_one_template_do_not_all_meet(make, monkeypatch):
    fill, met = " ".join(f"t{i}" for i in range(11)), []
    monkeypatch.setattr(J, "written", lambda df, name, w=J.written: _counted(w(df, name), name, met))
    got = J.jaccard_classes(make([(i, f"{fill} x{i}", None, "s") for i in range(600)])).collect()
    assert all(r.component_id == r.doc_id for r in got)
    assert sum(n for name, n in met if name == "rare-blocks") == 0 and any(name == "hot-sets" for name, _ in met)


def _counted(df, name, met):
    met.append((name, df.count() if name == "rare-blocks" else None))
    return df


def test_query_over_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMOKE}/documents.parquet").collect()}
    got = queries.op5_jaccard(spark, SF_SMOKE).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(texts, J.Measure())


def test_hamming_distances_are_lower_bounds():
    rng = np.random.default_rng(3)
    for _ in range(200):
        both, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in rng.integers(1, 60, 3))
        x, y = np.unique(np.concatenate((both, a))), np.unique(np.concatenate((both, b)))
        differ = len(np.setxor1d(x, y))
        assert (J.sketch(x, 40, 1) != J.sketch(y, 40, 1)).sum() <= differ
        assert sum(int(v).bit_count() for v in (J.bit_sketch(x) ^ J.bit_sketch(y)).view(np.uint64)) <= differ


def test_bands_cover_every_linked_pair():
    for m in (J.Measure(), J.Measure(words=5, num=80), J.Measure(num=50)):
        lows = m.bands(5000)
        for n in range(m.smallest(), 2000):
            most = n * m.den // m.num  # the largest set that can link
            for other in {n + 1, most} - {n}:
                if other <= most:
                    top = int(np.searchsorted(lows, other, "right"))
                    home = int(np.searchsorted(lows, n, "right"))
                    assert top == home or top == home + 1 and n * m.den >= m.num * lows[home]
                    assert m.blocks(lows[top])[1] - m.agreed(lows[top]) >= m.furthest(n + other)


def test_long_word_lists_are_hashed_in_slices(monkeypatch):
    text = " ".join(f"word{i % 91}" for i in range(2000)).encode()
    whole = J.word_hashes(text)
    monkeypatch.setattr(J, "BYTES", 64)
    assert (J.word_hashes(text) == whole).all() and len(whole) == 2000
