"""Exact dedup: an extendible-hash index on shared files.

Every normalised text has a 64-bit key. A directory over the leading key bits starts
with one bucket and doubles: a bucket with more than ``bucket_entries`` keys splits
on its next bit, others keep their depth. Each bucket is a contiguous key range with one
owner task. Copies are pre-aggregated where they lie and their entries routed to the bucket
that the directory names; the owner sorts a key's entries by their bytes into a chain, a
link for each text that differs, and a link's entries are one group. A key seen once
needs no text to be compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptlens.llm.common import SPACES, bit_filter, maybe_in, whole_rows, without, written

BUCKET_ENTRIES = 8192
# 2^16 directory slots; buckets at that depth keep all their entries (1.5 M each at 10^11 texts).
MAX_DEPTH = 16


def text_key(norm: str) -> Column:
    return F.xxhash64(F.col(norm))


def _normal(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACES, " ")
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("norm"))


def _slot(depth: int) -> Column:
    """The leading ``depth`` bits of the key, as unsigned."""
    return F.expr(f"case when {depth} = 0 then 0L else shiftrightunsigned(key, 64 - {depth}) end")


def directory(keys: DataFrame, bucket_entries: int = BUCKET_ENTRIES, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(slot, depth): for every slot of the fully doubled directory the depth of its bucket.

    A slot's bucket is its shortest leading prefix that holds at most ``bucket_entries`` of ``keys``.
    The counts per slot come first, so each doubling adds up at most 2^max_depth rows.
    """
    slots = keys.groupBy(_slot(max_depth).alias("slot")).agg(F.count("*").alias("n"))
    doubled = slots.select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(max_depth))).alias("depth")) \
        .withColumn("prefix", F.expr(f"shiftrightunsigned(slot, {max_depth} - depth)"))
    fits = doubled.groupBy("depth", "prefix").agg(F.sum("n").alias("held")) \
        .where((F.col("held") <= bucket_entries) | (F.col("depth") == max_depth))
    # A directory has at most 2^(max_depth + 1) prefixes, so it may be broadcast; every slot then has a key of its own.
    return doubled.join(F.broadcast(fits.select("depth", "prefix")), ["depth", "prefix"]).groupBy("slot").agg(F.min("depth").alias("depth"))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                bucket_entries: int = BUCKET_ENTRIES, max_depth: int = MAX_DEPTH) -> tuple[DataFrame, DataFrame]:
    """(index, rows), both on shared files.

    ``index``: one row per distinct normalised text: bucket (first key of its range),
    depth, key, chain (place among the texts of one key), text_sha256, keep_id, group_size.
    ``rows``: one row per document: doc_id, key, text_sha256.
    """
    normal = _normal(docs, id_col, text_col)
    rows = written(normal.select("doc_id", text_key("norm").alias("key"), F.sha2("norm", 256).alias("text_sha256")), "dedup-rows")
    keys = written(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("keep_id"), F.min("text_sha256").alias("text_sha256")), "dedup-keys")
    slots = written(directory(keys, bucket_entries, max_depth), "dedup-directory")
    twice = keys.where("n > 1").select("key")
    maybe = maybe_in(normal.withColumn("key", text_key("norm")), "key", bit_filter(twice, "key"), "_again").where("_again").drop("_again")
    # Copies are merged per input partition, so a hot text sends its owner one entry of each.
    merged = maybe.groupBy("key", "norm", F.spark_partition_id().alias("_at")).agg(F.count("*").alias("n"), F.min("doc_id").alias("keep_id"))
    merged = merged.select("key", "norm", "n", "keep_id", F.sha2("norm", 256).alias("text_sha256"))
    alone = keys.where("n = 1").select("key", F.lit(None).cast("string").alias("norm"), "n", "keep_id", "text_sha256")
    bucket = F.expr("case when depth = 0 then 0L else shiftleft(shiftrightunsigned(key, 64 - depth), 64 - depth) end")
    # The directory has at most 2^max_depth slots, so it may be broadcast.
    routed = merged.unionByName(alone).withColumn("slot", _slot(max_depth)).join(F.broadcast(slots), "slot") \
        .withColumn("bucket", bucket).drop("slot").repartition("bucket")
    # The filter lets some keys through that are seen once; their text is not looked at.
    of_key = Window.partitionBy("bucket", "key")
    chained = routed.withColumn("_alone", F.max(F.col("norm").isNull()).over(of_key)).where(F.col("norm").isNull() | ~F.col("_alone")) \
        .withColumn("chain", F.dense_rank().over(of_key.orderBy("norm")))
    index = chained.groupBy("bucket", "depth", "key", "chain").agg(
        F.min("text_sha256").alias("text_sha256"), F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    return written(index, "dedup-index"), rows


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **index) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of white space becomes one space; the
    smallest doc_id of a group stays. A null text counts as empty. A repeated row counts
    once more in group_size, and all rows of one doc_id and text share its decision. A null
    doc_id is kept only if its whole group has none. An empty table gives no rows; other
    columns of ``docs`` are not read.
    """
    found, rows = build_index(docs, id_col, text_col, **index)
    return (rows.join(found.select("key", "text_sha256", "keep_id", "group_size"), ["key", "text_sha256"])
            .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, one with its smallest doc_id; all columns.

    Rows are dropped by doc_id and text, so other texts of a repeated doc_id stay; of repeated
    rows, and of copies that all lack an id, any one stays.
    """
    key = lambda i, digest: F.concat_ws(":", F.col(i).isNull().cast("string"), F.col(i).cast("string"), digest).alias("_key")
    copies = exact_dedup(docs, id_col, text_col).where("group_size > 1")
    copies = written(copies.groupBy(key("doc_id", F.col("text_sha256"))).agg(F.first("kept").alias("kept"), F.count("*").alias("n")), "dedup-copies")
    normal = F.regexp_replace(F.coalesce(F.col("_text"), F.lit("")), SPACES, " ")
    rows = whole_rows(docs, _doc_id=id_col, _text=text_col).select("_doc", key("_doc_id", F.sha2(normal, 256)))
    rows = maybe_in(without(rows, copies.where("not kept").select("_key"), "_key"), "_key", bit_filter(copies.where("kept and n > 1"), "_key"), "_again")
    return rows.where("not _again").select("_doc.*").unionByName(rows.where("_again").dropDuplicates(["_key"]).select("_doc.*"))
