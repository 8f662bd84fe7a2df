"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for every operator and stage."""

import corpus_pipeline
import pytest
from conftest_llm import EDGES
from pyspark.sql import functions as F

from promptlens.llm import exact_dedup, jaccard_join, language_id, licenses, mixing, packing, quality_knn, quality_rules, secrets, url_filter


def labels(docs):
    return docs.select("doc_id", (F.col("doc_id") % 2).alias("quality"), F.lit("x").alias("label"), F.lit("y").alias("bad")).distinct()


OPERATORS = {
    "mix": mixing.mixed_words,
    "secrets": secrets.scan_secrets,
    "quality": lambda d: quality_knn.classify(d, labels(d)),
    "language": language_id.identify,
    "jaccard": jaccard_join.jaccard_classes,
    "packing": packing.pack,
    "urls": lambda d: url_filter.filter_urls(d.withColumnRenamed("doc_id", "page_id").withColumnRenamed("text", "url")),
    "dedup": exact_dedup.exact_dedup,
    "rules": lambda d: quality_rules.apply_rules(d, labels(d)),
    "licenses": licenses.scan_licenses,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_edge_rows(name, edges):
    got = OPERATORS[name](edges).collect()
    ids = sorted(r[0] for r in got if not (name == "packing" and r["piece"]))
    assert ids == sorted(i for i, *_ in EDGES)
    by = {r[0]: r for r in got}
    if name == "mix":
        assert by[1].size == by[1].taken == by[2].taken == by[3].size == 0 and by[3].target == 2 * by[3].source_size
    if name == "secrets":
        assert by[1].spans == by[2].spans == "" and by[1].base_sha256 == by[2].base_sha256
    if name == "quality":
        assert all(0 <= r.score <= 1 for r in got) and by[1].score == by[2].score
    if name == "language":
        assert {by[i].lang_pred for i in (1, 2, 3, 7)} == {"und"} and by[1].score == 0.0
    if name == "jaccard":
        assert [by[i].n_shingles for i in (1, 2, 3, 4, 5, 6)] == [0, 0, 0, 1, 1, 1]
        assert [by[i].component_id for i in (1, 2, 3, 4, 5, 6, 10, 11)] == [1, 2, 3, 4, 5, 5, 8, 8]
    if name == "packing":
        assert by[1].length == by[2].length == 1
    if name == "urls":
        assert by[1].host == by[1].path == by[4].path == "" and by[1].rule is None
    if name == "dedup":
        assert by[2].keep_id == 1 and by[1].group_size == 2 and by[6].keep_id == 5 and by[6].group_size == 3 and not by[11].kept
    if name == "rules":
        assert by[1].n_words == by[2].n_words == by[3].n_words == 0 and by[1].base_failed and not by[1].kept
        assert by[10].n_dup_lines == 11 and by[10].n_repeat_words == by[10].n_words
    if name == "licenses":
        assert by[12].own_license == "MIT" and by[1].n_headers == 0 and by[13].n_headers == 1


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(name, nothing):
    assert OPERATORS[name](nothing).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_null_ids(name, make):
    table = make([(None, "a b c d", None, None), (None, None, None, None), (3, "a b c d", None, None)])
    got = OPERATORS[name](table).collect()
    assert sum(r[0] is None for r in got) == 2 and sum(r[0] == 3 for r in got) == 1


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_stages(stage, spark, edges, nothing):
    name, fn = corpus_pipeline.STAGES[stage]
    got = fn(spark, edges, "")
    if stage < len(corpus_pipeline.STAGES) - 1:
        assert got.columns == edges.columns
        assert fn(spark, nothing, "").columns == edges.columns
    ids = sorted(r[0] for r in got.select("doc_id").collect())
    if name == "language id":
        assert not {1, 2, 3, 7} & set(ids) and {8, 10, 11} <= set(ids)
    if name == "exact dedup":
        assert 11 not in ids and {1, 3, 4, 5, 10} <= set(ids) and 2 not in ids and 6 not in ids
    if name == "n-gram Jaccard join":
        assert {1, 2, 3, 4, 5, 8} <= set(ids) and not {6, 10, 11} & set(ids)
    if name == "mixing sources":
        assert not {1, 2, 3} & set(ids) and all(ids.count(i) <= 4 for i in ids)
    assert fn(spark, nothing, "").collect() == []


@pytest.mark.parametrize("drop", [exact_dedup.drop_copies, jaccard_join.drop_similar])
def test_rows_are_dropped_by_id_and_text(drop, make):
    a, b, c, d = ("one two three four five six", "sun moon stars sky and sea", "red green blue grey pink black", "salt bread milk rice oil wine")
    rows = [(3, a, None, None), (7, a, None, None), (7, b, None, None), (5, c, None, None), (5, c, None, None), (9, c, None, None),
            (None, d, None, None), (None, d, None, None), (None, b, None, None), (2, "", None, None)]
    got = sorted(((r.doc_id, r.text) for r in drop(make(rows)).collect()), key=str)
    assert got == sorted([(3, a), (7, b), (5, c), (None, d), (2, "")], key=str)


def test_smallest_id_of_similar_texts_stays_where_it_is_repeated(make):
    a, b = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    rows = [(7, a, None, None), (7, b, None, None), (9, a + " more", None, None), (4, b + " more", None, None)]
    got = sorted((r.doc_id, r.text) for r in jaccard_join.drop_similar(make(rows)).collect())
    assert got == [(4, b + " more"), (7, a)]
