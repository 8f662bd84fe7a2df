import numpy as np
from conftest_llm import SF_SMALL

from promptlens.llm import quality_knn as K
from promptlens.llm import queries


def test_held_out_order_and_accuracy(spark):
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    got = queries.op3_quality(spark, SF_SMALL).join(labels, "doc_id").where("held_out").select("score", "predicted", "quality").collect()
    good, bad = ([r.score for r in got if r.quality == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([r.predicted == r.quality for r in got]) > 0.95


def test_vote_is_that_of_a_plain_search():
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("abcdef !*"), 80)) for _ in range(60)]
    counts, labels = K.trigrams(texts), np.arange(60) % 2
    m = K.fit(counts, labels)
    new = K.trigrams(["".join(rng.choice(list("abcdef !*"), 80)) for _ in range(20)] + [""])
    got = K.vote(new, m)
    for row, score in zip(new, got):
        z = K._weighted(row[None], m.idf)[0] @ m.basis
        cos = [max(0.0, float(v @ z) / max(float(np.linalg.norm(z)), 1e-12)) for v in m.vectors]
        near = sorted(range(60), key=lambda i: -cos[i])[:K.NEIGHBOURS]
        w = [cos[i] ** K.POWER for i in near]
        want = (sum(x * labels[i] for x, i in zip(w, near)) + 1e-3 * m.prior) / (sum(w) + 1e-3) if sum(w) else m.prior
        assert abs(score - want) < 1e-3


def test_long_text_is_counted_whole(monkeypatch):
    text = "ab cd cd ef " * 500
    whole = K.trigrams([text, "x"])
    monkeypatch.setattr(K, "BYTES", 101)
    parts = K.trigrams([text, "x"])
    assert (whole[:, :K.FEATURES] == parts[:, :K.FEATURES]).all()


def test_ids_of_any_size_labels_and_repeated_rows(spark, make):
    rows = [(2 ** 63 - 1, "good plain text", None, None), (-(2 ** 63), "bad *** text", None, None), (2 ** 62, "other text", None, None), (2 ** 62, "another text", None, None), (5, "x", None, None)]
    labels = spark.createDataFrame([(2 ** 63 - 1, 1), (-(2 ** 63), 0), (2 ** 62, 1), (2 ** 62, 0), (5, 2)], "doc_id long, quality long")
    got = K.classify(make(rows), labels).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, *_ in rows) and all(0 <= r.score <= 1 for r in got)
    model = K.learn(make(rows * 30).select("doc_id", "text"), labels.where("quality < 2").withColumnRenamed("quality", "label"))
    assert len(model.labels) == 3
