import re
from collections import Counter

from conftest_llm import SF_SMALL

from promptlens.llm import quality_rules as Q
from promptlens.llm import queries


def stats(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_query_over_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()}
    got = queries.op9_quality_rules(spark, SF_SMALL).collect()
    assert len(got) == len(texts)
    for r in got:
        want = stats(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r.kept == (not r.base_failed and r.rule is None)
    free = [(labels[r.doc_id], r.kept) for r in got if r.doc_id in labels and not r.base_failed]
    assert sum(bool(q) == k for q, k in free) / len(free) > 0.93
    assert sum(k for q, k in free if q) / sum(1 for q, _ in free if q) > 0.97


def test_statistics_of_odd_texts(make):
    texts = ["", "a", "a b", "a b c", "a a a a", "x y z x y z", "é\U0001f600 é\n\né \U0001f600#", "l\nl\n l\n\t\n\t\nl", "a b c d a b c e a b", "\x0b\x1c x"]
    got = {r.doc_id: r for r in Q.statistics(make([(i, t, None, None) for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == stats(t), t


def test_a_planted_conjunction_is_found(make, spark):
    rows, labels = [], []
    for i in range(1500):
        shout, spaced = i % 3 == 0, i % 2 == 0
        word = ("WORD" if shout else "word") + str(i)
        rows.append((i, " ".join(f"{word}{k} |" if spaced else f"{word}{k}" for k in range(60 + i % 40)), None, None))
        labels.append((i, int(shout and spaced)))
    s = Q.written(Q.statistics(make(rows)), "t")
    rules = Q.learn(s, spark.createDataFrame(labels, "doc_id long, bad int"))
    assert rules and len(rules[0]) >= 2
    got = s.withColumn("rule", Q.decision(rules)).collect()
    want = dict(labels)
    # Cuts lie at quantiles, so a few texts beside the border may be judged wrongly.
    assert sum((r.rule is not None) == bool(want[r.doc_id]) for r in got) / len(got) > 0.97


def test_labels_of_one_kind_teach_nothing(make, spark):
    s = Q.written(Q.statistics(make([(i, "word " * 70, None, None) for i in range(40)])), "t")
    assert Q.learn(s, spark.createDataFrame([(i, 0) for i in range(40)], "doc_id long, bad int")) == []
