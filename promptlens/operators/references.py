"""Rows and their texts apart: operators on ids and times move short rows, each different text moves once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptlens.operators.bits import bit_filter, maybe_in
from promptlens.session import FREES_SHUFFLES, settings

REF = "__ref"
# Columns of a stored text record (``stored_apart``): its mark, its texts, the task that wrote it.
IS_TEXT, TEXTS, TASK = "is_text", "texts", "task"
# Tasks keep a file open for each kind of record, and buffer row groups of so many bytes.
WRITERS, ROW_GROUP = "spark.sql.maxConcurrentOutputFileWriters", 32 << 20
# Digests of texts that a task remembers; beyond them it starts anew, and may pass a text on again.
SEEN = 1 << 20
# Bytes of texts that stay in their row: a reference and a join cost as much.
SHORT = 64


def reference(texts: list[str]) -> Column:
    """A digest (16 bytes) of the columns ``texts`` together; nulls are not empty texts."""
    whole = F.sha2(F.concat(*[F.coalesce(F.sha2(F.col(c).cast("string"), 256), F.lit("-")) for c in texts]), 256)
    return F.substring(F.unhex(whole), 1, 16)


def first_in_task(ref: Column) -> Column:
    """Whether a reference comes for the first time in its task (null: never); beyond SEEN of them, again."""
    most = SEEN

    @F.arrow_udf("boolean")
    def first(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        seen: set = set()
        for refs in batches:
            new = []
            for r in refs.to_pylist():
                new.append(r is not None and r not in seen)
                seen.add(r)
            if len(seen) > most:
                seen.clear()
            yield pa.array(new, pa.bool_())

    return first.asNondeterministic()(ref)


def _first_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set = set()
    for batch in batches:
        new = []
        for ref in batch.column(0).to_pylist():
            new.append(ref not in seen)
            seen.add(ref)
        if len(seen) > SEEN:
            seen.clear()
        yield batch.filter(pa.array(new, pa.bool_()))


def by_reference(df: DataFrame, texts: list[str]) -> tuple[DataFrame, DataFrame]:
    """``df`` with a digest (``__ref``) in place of its columns ``texts``, and (``__ref``, ``texts``) once per digest.

    Copies are left out in the tasks that read them, so that one row per task and text is
    shuffled at most, and of these one stays. ``with_texts`` undoes it.
    """
    ref = reference(texts).alias(REF)
    rows = df.select(*[c for c in df.columns if c not in texts], ref)
    schema = T.StructType([T.StructField(REF, T.BinaryType())] + [df.schema[c] for c in texts])
    own = df.select(ref, *texts).mapInArrow(_first_in_task, schema)
    number = F.row_number().over(Window.partitionBy(REF).orderBy(REF))
    return rows, own.withColumn("__no", number).filter("__no = 1").drop("__no")


def first_of_task(ref: Column) -> Column:
    """A generator: one row of false, and one of true behind it where the reference is new to the task."""
    return F.explode(F.when(first_in_task(ref), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False))))


def of_one_task(records: DataFrame, ref: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``records`` (``ref``, TASK, texts), those of one task for each reference of ``wanted``, and a few more; and these pairs.

    The task is chosen by references alone. A filter of bounded size holds the other records back where
    they lie, so that a text moves once, however many tasks wrote it.
    """
    key = F.xxhash64(ref, TASK)
    chosen = records.select(ref, TASK).join(wanted, ref, "left_semi").groupBy(ref).agg(F.min(TASK).alias(TASK))
    bits = bit_filter(chosen.select(key.alias("__key")), "__key")
    return maybe_in(records.withColumn("__key", key), "__key", bits, "__maybe").filter("__maybe").drop("__maybe", "__key"), chosen


def stored_apart(df: DataFrame, texts: list[str], path: str) -> DataFrame:
    """The rows of ``by_reference``, written to ``path`` with the texts by the tasks that make ``df``.

    ``df`` is made once and not shuffled, and the shuffle files behind it are gone then. A text is
    written once per task, all of a record in one array: side by side they compress as one.
    ``texts_apart`` reads them.
    """
    spark, columns = df.sparkSession, [c for c in df.columns if c not in texts]
    both = df.withColumn(REF, reference(texts))
    both = both.select("*", first_of_task(F.col(REF)).alias(IS_TEXT))
    held = F.when(F.col(IS_TEXT), F.array(*texts).cast("array<string>")).alias(TEXTS)
    both = both.select(*[F.when(~F.col(IS_TEXT), F.col(c)).alias(c) for c in columns], REF, held, F.spark_partition_id().alias(TASK), IS_TEXT)
    with settings(spark, {WRITERS: "2", FREES_SHUFFLES: "true"}):
        both.write.partitionBy(IS_TEXT).option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(both.select(*columns, REF, IS_TEXT).schema).parquet(path).filter(~F.col(IS_TEXT)).drop(IS_TEXT)


def texts_apart(spark: SparkSession, texts: list[str], path: str) -> DataFrame:
    """(``__ref``, ``texts``) once per reference, of what ``stored_apart`` wrote to ``path``."""
    records = spark.read.schema(f"{REF} binary, {TEXTS} array<string>, {TASK} int, {IS_TEXT} boolean").parquet(path).filter(IS_TEXT).drop(IS_TEXT)
    one, _ = of_one_task(records, REF, records.select(REF))
    number = F.row_number().over(Window.partitionBy(REF).orderBy(REF))
    return one.repartition(REF).withColumn("__no", number).filter("__no = 1").select(REF, *[F.col(TEXTS)[i].alias(c) for i, c in enumerate(texts)])


def with_texts(rows: DataFrame, texts: DataFrame) -> DataFrame:
    return rows.join(texts, REF).drop(REF)
