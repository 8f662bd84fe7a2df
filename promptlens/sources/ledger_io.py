"""The verdict ledger as a Parquet table partitioned by event_date.

Appends are plain ``mode("append")`` writes (Spark's commit protocol makes
each job's files appear atomically); a reset writes an empty table over the
old one. Reads use the fixed schema (no inference) and expose ``event_date``
so date predicates prune whole partitions.

A row keeps short payloads and a reference to longer ones. These are text records
of the same table, each once per task that wrote it, in the partition without a
date, so that a day can be dropped and no other day loses a text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptlens.operators.references import ROW_GROUP, SHORT, WRITERS, first_of_task, reference
from promptlens.schemas import LEDGER, LEDGER_COLUMNS, LEDGER_PARTITION, PAYLOAD_COLUMNS
from promptlens.session import FREES_SHUFFLES, settings

# A sanitized payload equal to the full one, as of all clean prompts, is stored as this mark alone.
UNCHANGED = "sanitized_unchanged"
# The reference of a row without payloads and of its text record, which is marked and holds them as
# one array (side by side they compress as one); null in a row that holds its own.
STORED_REF, IS_TEXT, TEXTS = "payload_ref", "is_text", "payload_texts"
_STORED = [T.StructField(f.name, f.dataType, True) for f in LEDGER.fields] + [T.StructField(UNCHANGED, T.BooleanType()), T.StructField(STORED_REF, T.BinaryType())]
_PARTITION = T.StructField(LEDGER_PARTITION, T.DateType())
LEDGER_ON_DISK = T.StructType(_STORED + [T.StructField(IS_TEXT, T.BooleanType()), T.StructField(TEXTS, T.ArrayType(T.StringType())), _PARTITION])
# Days that a task writes side by side; those beyond are sorted.
OPEN_DAYS = 100


def with_partition(ledger: DataFrame) -> DataFrame:
    return ledger.withColumn(LEDGER_PARTITION, F.to_date(F.substring("timestamp", 1, 10)))


def on_disk(ledger: DataFrame) -> DataFrame:
    """``ledger`` as it is stored, its other columns kept: rows, and a record of each text that a task meets first.

    No row is shuffled, sorted or held back: a task remembers the references it passed on.
    """
    unchanged = F.coalesce(F.col("sanitized_payload") == F.col("full_payload"), F.lit(False))
    size = F.coalesce(F.octet_length("full_payload"), F.lit(0)) + F.coalesce(F.octet_length("sanitized_payload"), F.lit(0))
    rows = with_partition(ledger.withColumn(UNCHANGED, unchanged))
    rows = rows.withColumn("sanitized_payload", F.when(~F.col(UNCHANGED), F.col("sanitized_payload")))
    rows = rows.withColumn(STORED_REF, F.when(size > SHORT, reference(PAYLOAD_COLUMNS)))
    out = rows.select("*", first_of_task(F.col(STORED_REF)).alias("__text"))
    text, apart = F.col("__text"), F.col(STORED_REF).isNotNull()
    kept = [F.when(~(apart if c in PAYLOAD_COLUMNS else text), F.col(c)).alias(c) for c in rows.columns if c != STORED_REF]
    return out.select(*kept, STORED_REF, F.when(text, True).alias(IS_TEXT), F.when(text, F.array(*PAYLOAD_COLUMNS)).alias(TEXTS))


def append_stored(stored: DataFrame, path: str) -> None:
    """Append rows and text records (``on_disk``) by date, from the tasks that make them.

    A task keeps one file open for each of up to OPEN_DAYS dates, so that a day has as many
    files as tasks that saw it. Shuffle files of the job are gone when it ends.
    """
    with settings(stored.sparkSession, {WRITERS: str(OPEN_DAYS), FREES_SHUFFLES: "true"}):
        (stored.write.mode("append").partitionBy(LEDGER_PARTITION).option("compression", "zstd")
            .option("parquet.block.size", ROW_GROUP).parquet(path))


def ledger_append(ledger: DataFrame, path: str) -> None:
    """Append verdict rows: payloads are neither shuffled nor sorted, and each is written once per task that holds it."""
    append_stored(on_disk(ledger.select(*LEDGER_COLUMNS)), path)


def stored_rows(spark: SparkSession, path: str, more: str = "") -> DataFrame:
    """The rows as stored, with payloads or a reference; ``more``: a DDL of further columns."""
    also = list(T.StructType.fromDDL(more)) if more else []
    stored = spark.read.schema(T.StructType(_STORED + also + [T.StructField(IS_TEXT, T.BooleanType()), _PARTITION])).parquet(path)
    return stored.filter(F.col(IS_TEXT).isNull()).drop(IS_TEXT)


def text_records(spark: SparkSession, path: str, more: str = "") -> DataFrame:
    """(STORED_REF, TEXTS) as stored: more than one task may have written a text; ``more`` as above."""
    schema = T.StructType(list(LEDGER_ON_DISK) + (list(T.StructType.fromDDL(more)) if more else []))
    records = spark.read.schema(schema).parquet(path).filter(F.col(LEDGER_PARTITION).isNull() & F.col(IS_TEXT))
    return records.select(STORED_REF, TEXTS, *schema.fieldNames()[len(LEDGER_ON_DISK):])


def stored_texts(spark: SparkSession, path: str) -> DataFrame:
    """The text records, once per reference."""
    # Dealt by reference before they are grouped, so that texts are sorted once, in pieces of a shuffle's size.
    return text_records(spark, path).repartition(STORED_REF).groupBy(STORED_REF).agg(F.first(TEXTS).alias(TEXTS))


def ledger_scan(spark: SparkSession, path: str) -> DataFrame:
    """All rows with their payloads. Texts are read and joined only where a payload is asked for."""
    # A row that holds its payloads has no reference; a key of another length finds no text and deals such rows out.
    key = F.coalesce(F.col(STORED_REF), F.unhex(F.hex(F.xxhash64("id", "timestamp", "unix_ts"))))
    texts = stored_texts(spark, path).withColumnRenamed(STORED_REF, "__ref")
    joined = stored_rows(spark, path).join(texts, key == F.col("__ref"), "left")
    whole = {c: F.when(F.col(STORED_REF).isNull(), F.col(c)).otherwise(F.col(TEXTS)[i]) for i, c in enumerate(PAYLOAD_COLUMNS)}
    whole["sanitized_payload"] = F.when(F.col(UNCHANGED), whole["full_payload"]).otherwise(whole["sanitized_payload"])
    return joined.select(*[whole[c].alias(c) if c in whole else F.col(c) for c in LEDGER_COLUMNS + [LEDGER_PARTITION]])


def ledger_reset(spark: SparkSession, path: str) -> None:
    """Empty the ledger (counters derived from it then read 0)."""
    empty = spark.createDataFrame([], LEDGER)
    # Static whatever the session says: a dynamic overwrite by no rows would leave every partition.
    (with_partition(empty).write.mode("overwrite").option("partitionOverwriteMode", "static")
        .partitionBy(LEDGER_PARTITION).parquet(path))


def expired_partitions(spark: SparkSession, path: str, now_unix: float, retention_days: int) -> DataFrame:
    """Dates of partitions that hold only expired events (candidates to delete).

    Never the partition without a date, which holds the texts of all days.
    """
    cutoff = float(now_unix) - retention_days * 86400.0
    return (ledger_scan(spark, path).filter(F.col(LEDGER_PARTITION).isNotNull()).groupBy(LEDGER_PARTITION)
            .agg(F.max("unix_ts").alias("newest"))
            .filter(F.col("newest") < F.lit(cutoff)).select(LEDGER_PARTITION))
