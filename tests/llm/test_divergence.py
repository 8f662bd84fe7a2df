import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest_llm import EDGES

from promptlens.llm import divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def brute(docs, min_docs=3, top=200):
    """The audit of (lang, source, text) rows in plain loops."""
    docs = [(lang or "", source or "", Counter(TERM.findall((text or "").translate(LOWER)))) for lang, source, text in docs]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in d[2])
        kept = sorted(t for t in df if df[t] >= min_docs)
        by = defaultdict(Counter)
        for _, s, c in own:
            by[s].update({t: n for t, n in c.items() if df[t] >= min_docs})
        total, v = sum((by[s] for s in by), Counter()), len(kept)
        share = lambda c, t: 1 + 10 ** 9 * (c[t] + 1) // (sum(c.values()) + v)
        f = lambda p, q: (p - q) ** 2 // q
        for s in by:
            pairs = [(-sum(f(share(by[s], t), share(by[o], t)) for t in kept), o.encode()) for o in by if o != s]
            terms = [(-f(share(by[s], t), share(total, t)), t.encode()) for t in kept if by[s][t] and share(by[s], t) > share(total, t)]
            for part, found in (("pair", pairs), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -value, k + 1) for k, (value, item) in enumerate(sorted(found))]
    return sorted(out)


def audited(make, docs, **options):
    return sorted(tuple(r) for r in D.audit(make([(i, t, lang, s) for i, (lang, s, t) in enumerate(docs)]), **options).collect())


@pytest.mark.parametrize("seed", range(3))
def test_rows_are_those_of_plain_loops(make, seed):
    rng = np.random.default_rng(seed)
    words = ["a", "B", "é", "Ünder", "ß", "x1y", "the", "漢字", "z_z", "don't"] + [f"w{chr(97 + i)}" for i in range(20)]
    docs = [(rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "é", None, "S"], p=[.5, .2, .1, .1, .1]), " ".join(rng.choice(words, rng.integers(0, 40)) if rng.random() > .1 else []))
            for _ in range(120)]
    assert audited(make, docs, top=5) == brute(docs, top=5)


def test_languages_without_terms_and_single_sources(make):
    docs = [("en", "a", "only twice"), ("en", "b", "only twice"), ("de", "x", "eins eins"), ("de", "x", "eins"), ("de", "x", "eins"), ("fr", None, None), (None, None, ""), ("fr", "", "x")]
    got = audited(make, docs)
    assert got == brute(docs)
    assert ("en", "a", "pair", "b", 0, 1) in got and not [r for r in got if r[0] == "fr"]


def test_edge_rows(edges, nothing):
    got = sorted(tuple(r) for r in D.audit(edges).collect())
    assert got == brute([(lang, s, t) for _, t, lang, s in EDGES])
    assert D.audit(nothing).collect() == []


def test_flushed_counts_add_up(make, monkeypatch):
    docs = [("en", f"s{i % 4}", f"a b c {chr(97 + i % 26)} the the") for i in range(60)]
    monkeypatch.setattr(D, "HELD_TERMS", 5)
    monkeypatch.setattr(D, "COMBINATIONS", 3)
    assert audited(make, docs) == brute(docs)


def test_tree_shares_beginnings():
    """Four rows, two of them equal by prefix: a node holds the multiplicity of all rows through it."""
    rows = [([0], [5], 7), ([0, 1], [5, 2], 3), ([0, 1, 2], [5, 2, 9], 1), ([0, 2], [5, 9], 2)]
    starts = np.cumsum([0] + [len(r[0]) for r in rows])
    tree = D.build_tree(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), starts, np.array([r[2] for r in rows]))
    assert sorted(zip(tree.parent.tolist(), tree.source.tolist(), tree.p.tolist(), tree.weight.tolist())) == [(-1, 0, 5, 13), (0, 1, 2, 4), (0, 2, 9, 2), (1, 2, 9, 1)]
    zero = np.array([1, 1, 1])
    got = Counter()
    for a, b, v in D.corrections(tree, zero):
        for x, y, z in zip(a.tolist(), b.tolist(), v.tolist()):
            got[x, y] += z
    f = lambda p, q: (p - q) ** 2 // q
    want = Counter()
    for sources, p, m in rows:
        for i, x in zip(sources, p):
            for j, y in zip(sources, p):
                if i != j:
                    want[i, j] += m * (f(x, y) - f(x, 1) - f(1, y) + f(1, 1))
    assert got == want


def test_shares_are_exact_in_64_bits(spark):
    from pyspark.sql import functions as F
    cases = [(1, 3), (7, 7), (123_456_789_012_345, 8_999_999_999_999_999), (1, 8_999_999_999_999_999), (8_999_999_999_999_999, 8_999_999_999_999_999)]
    got = spark.createDataFrame(cases, "x long, d long").select("x", "d", D.share(F.col("x"), F.col("d")).alias("p")).collect()
    assert all(r.p == 1 + 10 ** 9 * r.x // r.d for r in got)
