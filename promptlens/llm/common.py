"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptlens.session import scratch_path

# The white space of every contract: space and U+0009..U+000D; a word is a run of the rest.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

# A filter of id bits sent to every task: 2^20 words of 64 bits, 8 MB of them, at most.
FILTER_WORDS = 1 << 20


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor costs a re-read of shared files only.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running(df: DataFrame, group: str, digits: tuple[str, str], order: list[str], value: Column,
            out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows before each row of its ``group``.

    Rows are ordered by the two ``digits`` and then ``order``. Sums per digit cell come
    first, so that no window ever holds a whole group: one holds the cells below one
    first digit, one the first digits of a group, and one the rows of a single cell.
    """
    d1, d2 = digits
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    prior = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    cells = df.groupBy(group, d1, d2).agg(F.sum(value).alias("_cell"))
    tops = (cells.groupBy(group, d1).agg(F.sum("_cell").alias("_top"))
            .select(group, d1, prior("_top", before(group).orderBy(d1)).alias("_above")))
    cells = (cells.withColumn("_left", prior("_cell", before(group, d1).orderBy(d2)))
             .join(tops, [group, d1])
             .select(group, d1, d2, (F.col("_above") + F.col("_left")).alias("_start")))
    return (df.withColumn("_own", value).join(cells, [group, d1, d2])
            .withColumn(out, F.col("_start") + prior("_own", before(group, d1, d2).orderBy(*order)))
            .drop("_own", "_start"))


def _bit_of(h: Column) -> Column:
    return F.pmod(F.shiftright(h, 32), F.lit(64)).cast("int")


def bit_filter(keys: DataFrame, key: str) -> DataFrame:
    """The 64-bit words (word, bits) of a one-hash filter over ``key``: FILTER_WORDS rows at most."""
    h = F.xxhash64(F.col(key))
    return (keys.select(F.pmod(h, F.lit(FILTER_WORDS)).alias("_word"),
                        F.call_function("shiftleft", F.lit(1).cast("long"), _bit_of(h)).alias("_bit"))
            .groupBy("_word").agg(F.bit_or("_bit").alias("_bits")))


def maybe_in(df: DataFrame, key: str, bits: DataFrame, flag: str) -> DataFrame:
    """Add boolean ``flag``: false where ``key`` is certainly not among the filter's keys.

    The filter's size is bounded by FILTER_WORDS whatever the data, so it may be broadcast;
    a full filter only lets more rows through to the exact join that follows.
    """
    h = F.xxhash64(F.col(key))
    return (df.withColumn("_word", F.pmod(h, F.lit(FILTER_WORDS)))
            .join(F.broadcast(bits), "_word", "left")
            .withColumn(flag, F.coalesce(F.getbit(F.col("_bits"), _bit_of(h)) == 1, F.lit(False)))
            .drop("_word", "_bits"))


def without(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` less the rows whose id is in ``dropped`` (column ``id_col``).

    Most texts never move: a bounded bit filter settles the documents that certainly
    stay, and only the possible hits go through the exact anti join. Null ids stay.
    """
    marked = maybe_in(whole_rows(docs, **{"_id": id_col}), "_id", bit_filter(dropped, id_col), "_maybe")
    gone = dropped.select(F.col(id_col).alias("_id")).distinct()
    doubtful = marked.where("_maybe").join(gone, "_id", "left_anti")
    return marked.where("not _maybe").select("_doc.*").unionByName(doubtful.select("_doc.*"))


def whole_rows(docs: DataFrame, **named: str) -> DataFrame:
    """``docs`` as one column ``_doc``, beside copies of some columns: other names cannot clash with its own."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), *[F.col(f"`{c}`").alias(n) for n, c in named.items()])
