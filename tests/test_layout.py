import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from promptlens.plans import testdata as TD

TEXT = "{} " + "abcdefghij" * 20


@pytest.fixture
def small_splits(spark):
    set_to = {"spark.sql.files.maxPartitionBytes": "16384", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in set_to}
    for k, v in set_to.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def _write(path, ids, group):
    table = pa.table({"doc_id": pa.array(ids, pa.int64()), "text": [TEXT.format(i) if i % 9 else None for i in range(len(ids))]})
    pq.write_table(table, path, row_group_size=group, compression="none", use_dictionary=False)


def _rows(prompts):
    return sorted((tuple(r) for r in prompts.collect()), key=str)


def _held(prompts):
    return [n for n in prompts.rdd.glom().map(len).collect() if n]


@pytest.mark.parametrize("first", [4000, 3600])
def test_texts_of_one_row_group_reach_all_cores(spark, tmp_path, small_splits, first):
    """A file is cut by its size, but a row group is read in one split: all rows, or most of them, lay in one task."""
    ids = [None if i % 500 == 7 else i // 2 for i in range(4000)]
    folder = tmp_path / "documents.parquet"
    folder.mkdir()
    _write(folder / "large.parquet", ids[:first], 1 << 20)
    _write(folder / "small.parquet", ids[first:], 10)
    raw = spark.read.parquet(str(folder))
    cores = spark.sparkContext.defaultParallelism
    assert raw.rdd.getNumPartitions() >= cores
    assert max(_held(raw)) >= first
    prompts = TD.prompts(spark, str(tmp_path))
    held = _held(prompts)
    assert len(held) >= cores and sum(held) == 4000 and max(held) <= 2 * 4000 / cores
    assert _rows(prompts) == _rows(raw.select("doc_id", TD.planted_text().alias("prompt")))


def test_texts_of_many_row_groups_stay_where_they_are(spark, tmp_path, small_splits, capsys):
    _write(tmp_path / "documents.parquet", list(range(4000)), 10)
    prompts = TD.prompts(spark, str(tmp_path))
    prompts.explain()
    assert "Exchange" not in capsys.readouterr().out
    assert len(_rows(prompts)) == 4000
