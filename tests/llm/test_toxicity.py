import numpy as np
import pytest
from conftest_llm import EDGES, SF_SMALL
from hypothesis import given, settings
from hypothesis import strategies as st

from promptlens.llm import queries
from promptlens.llm import toxicity as T

TERMS = [T.Term("idiot", False, 1.0), T.Term("worthless", False, 0.9), T.Term("scum", False, 0.8), T.Term("idiom", False, 0.5), T.Term("lowei", True, 0.7), T.Term("verbrau", True, 0.6)]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def brute(word, terms=TERMS):
    found = []
    for i, t in enumerate(terms):
        d = min(distance(word[:k], t.text) for k in range(len(word) + 1)) if t.stem else distance(word, t.text)
        if d <= t.edits:
            found.append((d, i))
    return min(d for d, _ in found) if found else None


WORDS = st.one_of(st.text("idotmscuwrhlevba", max_size=11),
                  st.tuples(st.sampled_from([t.text for t in TERMS]), st.lists(st.tuples(st.integers(0, 12), st.sampled_from(["", "i", "x", "ss"])), max_size=3)).map(
                      lambda x: "".join(c if i not in dict(x[1]) else dict(x[1])[i] for i, c in enumerate(x[0] + "en"))))


@settings(max_examples=400, deadline=None)
@given(WORDS)
def test_automaton_finds_what_distances_find(word):
    got = T.Lexicon(TERMS).find(word)
    assert (got[1] if got else None) == brute(word)
    if got:
        t = TERMS[got[0]]
        assert got[1] == (min(distance(word[:k], t.text) for k in range(len(word) + 1)) if t.stem else distance(word, t.text))


def test_states_that_start_afresh_find_the_same(monkeypatch):
    words = ["idiot", "1diot", "idio", "worhtless", "worthles", "scum", "scam", "loweix", "lowe", "verbrxucht", "idiom", "idiox"] * 3
    want = [T.Lexicon(TERMS).find(w) for w in words]
    monkeypatch.setattr(T, "STATES", 3)
    monkeypatch.setattr(T, "WORDS", 2)
    lexicon = T.Lexicon(TERMS)
    assert [lexicon.find(w) for w in words] == want


def test_known_words_are_no_misspellings():
    assert T.Lexicon(TERMS).find("idiots") == (0, 1)
    assert T.Lexicon(TERMS, frozenset({"idiots", "idiot"})).find("idiots") is None
    assert T.Lexicon(TERMS, frozenset({"idiots", "idiot"})).find("idiot") == (0, 0)


def test_quotation_and_report_weigh_less_than_abuse():
    lexicon = T.Lexicon(TERMS)
    weight = lambda text: T.evidence(text, lexicon)[0]
    assert weight("you are an idiot and that is all") > weight("the idiot walks past the old house") > weight("he called him idiot at some point") > weight('there was "idiot" on the wall')
    assert weight("da stand „idiot“ an der wand") == weight("on lit « idiot » sur le mur") == pytest.approx(T.QUOTED)
    assert weight('a "thing" ends. idiot walks past "another" one') == 1.0
    assert weight("no such term") == 0.0


def test_long_text_is_read_whole(monkeypatch):
    text = "plain words here " * 500 + "worthless" + " and more words" * 500
    whole = T.find_terms(text, T.Lexicon(TERMS))
    monkeypatch.setattr(T, "CHUNK", 7)
    assert T.find_terms(text, T.Lexicon(TERMS)) == whole and len(whole) == 1 and text[whole[0][0]:whole[0][1]] == "worthless"


def test_learned_terms(spark, make):
    """The lexicon holds the planted word and stem, and not the words of one text's many copies."""
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdeghik"), 6))
    common = [word() for _ in range(60)]
    bad = lambda: ["zumpel", "quorv" + "".join(rng.choice(list("abc"), 3))][rng.integers(2)]
    copied = " ".join(word() for _ in range(30))
    docs, labels = [], []
    for i in range(400):
        words = list(rng.choice(common, 20))
        if toxic := i % 5 == 0:
            words.insert(int(rng.integers(20)), bad())
        docs.append((i, " ".join(words), "en", "a"))
        labels.append((i, int(toxic)))
    for i in range(400, 460):
        docs.append((i, f"{copied} {word()}", "en", "a"))
        labels.append((i, 1))
    model = T.learn(make(docs).select("doc_id", "text"), spark.createDataFrame(labels, "doc_id long, label long"))
    texts = {t.text + "*" * t.stem for t in model.terms}
    assert {"zumpel", "quorv*"} <= texts and not {w for w in copied.split() if w in texts}
    lexicon = model.lexicon()
    score = lambda t: model.score(*T.evidence(t, lexicon)[:2])
    assert score("you zumpel") > 0.5 and score("some zumpol walks") > score("some plain words") and score("quorvxyz") > 0.5 > score("")


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    got = queries.op13_toxicity(spark, SF_SMALL).join(labels, "doc_id").where("held_out").select("predicted", "toxic", "score").collect()
    assert np.mean([r.predicted == r.toxic for r in got]) > 0.95
    assert not [r for r in got if r.predicted and not r.toxic]
    bad, good = ([r.score for r in got if r.toxic == k] for k in (1, 0))
    assert np.mean([(a > b) + (a == b) / 2 for a in bad for b in good]) > 0.8


def test_edge_rows(spark, edges, nothing, make):
    labels = edges.select("doc_id", (edges["doc_id"] % 2).alias("toxic")).distinct()
    got = T.classify(edges, labels).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, *_ in EDGES) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1
    assert T.classify(nothing, labels).collect() == []
    none = spark.createDataFrame([], "doc_id long, toxic long")
    assert {r.score for r in T.classify(edges, none).collect()} == {0.5}
    odd = spark.createDataFrame([(None, 1), (4, None), (5, 7), (2 ** 62 + 1, 1), (99, 0)], "doc_id long, toxic long")
    rows = make([(None, "a b c", None, None), (2 ** 62 + 1, "large id", None, None), (2 ** 62 + 1, "large id", None, None), (-(2 ** 63), "least", None, None)])
    assert len(T.classify(rows, odd).collect()) == 4
