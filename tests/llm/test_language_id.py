import numpy as np
from conftest_llm import SF_SMALL
from pyspark.sql import functions as F

from promptlens.llm import language_id as L
from promptlens.llm import queries


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "lang")
    got = queries.op4_language(spark, SF_SMALL).join(docs, "doc_id")
    rates = {r.held_out: r[1] for r in got.groupBy("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).collect()}
    assert rates[True] > 0.97 and rates[False] > 0.97
    assert got.where("score < 0 or score > 1").count() == 0


def test_counts_match_sets_but_for_false_positives():
    sets = {x: np.unique(np.random.default_rng(i).integers(0, 2**63, 5000).astype(np.uint64)) for i, x in enumerate("abc")}
    f = L.make_filters(sets)
    assert f.languages == ["a", "b", "c"] and (f.false_rate < 1e-3).all()
    for i, x in enumerate("abc"):
        at = L._addresses(sets[x])
        mask = f.slots[at[0], 0] & f.slots[at[1], 0]
        assert (mask >> np.uint64(i) & np.uint64(1)).all()  # no false negatives
        other = (i + 1) % 3
        assert (mask >> np.uint64(other) & np.uint64(1)).mean() < 0.01


def test_more_languages_than_bits_of_a_word():
    words = {f"l{i:03}": "".join(chr(97 + (i * 7 + j * (1 + i % 11)) % 26) for j in range(9)) for i in range(80)}
    grams = {k: np.unique(L.n_grams([w])[1]) for k, w in words.items()}
    f = L.make_filters(grams)
    assert f.slots.shape == (L.SLOTS, 2)
    found, score = L.classify(list(words.values()), f)
    assert sum(a == b for a, b in zip(found, words)) >= 78 and (score > 0.9).all()


def test_n_grams_against_plain_ones():
    def plain(text):
        s = "".join(c if c.isalpha() else " " for c in text.lower() + "\n")
        while "  " in s:
            s = s.replace("  ", " ")
        s = s.removeprefix(" ")
        return sum(all(c != " " for c in g[1:-1]) and g.strip() != "" and not (n == 1 and g == " ") for n in L.SIZES for g in (s[i:i + n] for i in range(len(s) - n + 1)))
    texts = ["Hello, wörld!", "a", "", " 12 ", "x y  z", "ß-É 中文"]
    doc, _, letters = L.n_grams(texts)
    assert np.bincount(doc, minlength=len(texts)).tolist() == [plain(t) for t in texts]
    assert letters.tolist() == [True, True, False, False, True, True]


def test_stage_without_labels_drops_only_texts_without_letters(make):
    got = L.keep_identified(make([(1, "some words", None, "a"), (2, "123 !", None, "a"), (3, None, None, "a"), (None, "mots", None, None)]))
    assert sorted(str(r.doc_id) for r in got.collect()) == ["1", "None"]
