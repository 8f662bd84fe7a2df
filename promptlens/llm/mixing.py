"""Mixing sources to target weights by a low-discrepancy schedule.

The documents of a source are shuffled (by MD5 of the id, or of the text's hash where there is no id) and laid end to end, and that
stream is cut into blocks of ``block_words`` words. Slot t of the mix has the golden-ratio
point frac(t * phi); the cumulative weights map the point to a source, and the slot's rank
among the slots of its source says which block it takes, from a second pass over the
source once the first has ended. The last block of a source is cut at its target, slots
past that are void, and slots that the points left short by rounding follow at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptlens.llm.common import WORD, running, whole_rows, written

# FIXED VALUES: weights of the sources in code-point order (repeating), share of all words, most passes.
WEIGHTS = (3, 1, 2)
SHARE_NUM, SHARE_DEN = 3, 2
PASSES = 2
BLOCK_WORDS = 1024
GOLDEN = 0.6180339887498949
# Cells of [0, 1) by which points meet the cumulative weights in an equi-join.
CELLS = 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _order(doc_id: Column, digest: Column) -> Column:
    """The place of a row in its shuffled source; rows without an id are told apart by their texts."""
    return F.md5(F.coalesce(doc_id.cast("string"), F.concat(F.lit(":"), digest.cast("string"))))


def _digest(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(src, source, source_size, weight, target) for each row (source, source_size).

    Filled like water: sources are taken by their cap per weight; while a source's share of
    what is left reaches its cap it gets the cap, the rest share by weight. The sources are
    the entries of a mixing recipe, so one window over them is small.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    numbered = sizes.select("source", "source_size", (F.row_number().over(by_name) - 1).alias("src"))
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("src") % len(weights) + 1).cast("int"))
    every = Window.partitionBy()
    fill = every.orderBy(F.col("source_size") / F.col("weight"), "src")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    w = (numbered.withColumn("weight", weight)
         .withColumn("_all", SHARE_NUM * F.sum("source_size").over(every))
         .withColumn("_capped", F.coalesce(F.sum("source_size").over(before), F.lit(0)) * (PASSES * SHARE_DEN))
         .withColumn("_rest", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
         .withColumn("_left", F.col("_all") - F.col("_capped"))
         .withColumn("_full", F.col("weight") * F.col("_left") > PASSES * SHARE_DEN * F.col("source_size") * F.col("_rest")))
    # From the first source that is not full on, all share what was left there.
    first = F.row_number().over(fill)
    w = w.withColumn("_row", first).withColumn("_open", F.min(F.when(~F.col("_full"), F.col("_row"))).over(every))
    at = lambda c: F.max(F.when(F.col("_row") == F.col("_open"), F.col(c))).over(every)
    shared = (F.col("weight") * at("_left")).cast("double") / (SHARE_DEN * at("_rest")).cast("double")
    capped = (PASSES * F.col("source_size")).cast("double")
    return w.withColumn("target", F.when(F.col("_open").isNull() | (F.col("_row") < F.col("_open")), capped).otherwise(shared)) \
        .select("src", "source", "source_size", "weight", "target")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        block_words: int = BLOCK_WORDS, weights: tuple[int, ...] = WEIGHTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(takes, rows, recipe).

    ``takes``: what each slot takes, in the order of the mix: slot, src, pass, block,
    row, doc_id, from_word, to_word (words of the document, end exclusive). ``rows``: one
    row per input row: row, doc_id, size, src and its order digits. ``recipe``: one row per
    source: src, source, source_size, weight, target. A null text has no words and a document
    without words is never taken; a null source is the last source; repeated rows are
    documents of their own; an empty table gives three empty results.
    """
    sized = written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"),
                                _digest(F.col(text_col)).alias("digest"), F.monotonically_increasing_id().alias("row")), "mix-sizes")
    recipe = written(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights), "mix-recipe")
    order = _order(F.col("doc_id"), F.col("digest"))
    rows = sized.join(recipe.select("src", F.col("source").alias("_source")), F.col("source").eqNullSafe(F.col("_source"))) \
        .select("row", "doc_id", "size", "src", "digest", order.alias("order")) \
        .withColumn("d1", F.substring("order", 1, 2)).withColumn("d2", F.substring("order", 3, 2))
    rows = written(running(rows, "src", ("d1", "d2"), ["order", "doc_id", "digest", "row"], F.col("size"), "start"), "mix-rows")
    slots = schedule(recipe, block_words)
    end = F.col("start") + F.col("size")
    parts = rows.where("size > 0").select("src", "row", "doc_id", "start", end.alias("end"), F.explode(F.sequence(
        F.floor(F.col("start") / block_words), F.floor((end - 1) / block_words))).alias("block"))
    lo = F.greatest("start", F.col("block") * block_words)
    hi = F.least("end", F.col("block") * block_words + F.col("words"))
    takes = parts.join(slots, ["src", "block"]).withColumn("_lo", lo).withColumn("_hi", hi).where("_hi > _lo").select(
        "slot", "src", "pass", "block", "row", "doc_id", (F.col("_lo") - F.col("start")).alias("from_word"), (F.col("_hi") - F.col("start")).alias("to_word"))
    return takes, rows, recipe


def schedule(recipe: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The slots of the mix: slot, src, rank, pass, block, words (of the block, from its start)."""
    spark = recipe.sparkSession
    goal = F.floor(F.col("target") + 0.5)
    blocks = F.ceil(F.col("source_size") / block_words)
    passes = F.floor(goal / F.col("source_size"))
    plan = recipe.where("source_size > 0").select(
        "src", "source_size", goal.alias("goal"), blocks.alias("blocks"),
        (passes * blocks + F.ceil((goal - passes * F.col("source_size")) / block_words)).alias("needed"), "target")
    total = plan.agg(F.sum("target")).first()[0] or 0.0
    n = int(-(-total // block_words))
    cum = F.sum("target").over(Window.orderBy("src"))
    cover = plan.select("src", ((cum - F.col("target")) / total).alias("lo"), (cum / total).alias("hi")) if n else \
        plan.select("src", F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi"))
    cover = cover.where("hi > lo").withColumn("cell", F.explode(F.sequence(
        F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1).cast("long")))))
    turn = F.col("slot") * F.lit(GOLDEN)
    points = spark.range(n).withColumnRenamed("id", "slot").withColumn("point", turn - F.floor(turn)) \
        .withColumn("cell", F.floor(F.col("point") * CELLS))
    # The cover is one row per cell and source border; rounding at the very end of [0, 1) falls to the top-up below.
    drawn = points.join(cover, "cell").where("point >= lo and point < hi").select("slot", "src") \
        .withColumn("d1", F.shiftright("slot", 24)).withColumn("d2", F.shiftright("slot", 12))
    ranked = written(running(drawn, "src", ("d1", "d2"), ["slot"], F.lit(1), "rank").select("slot", "src", "rank"), "mix-slots")
    short = plan.join(ranked.groupBy("src").agg(F.count("*").alias("_drawn")), "src", "left") \
        .withColumn("_drawn", F.coalesce("_drawn", F.lit(0))).where("_drawn < needed") \
        .select("src", F.explode(F.sequence(F.col("_drawn"), F.col("needed") - 1)).alias("rank")) \
        .select((F.lit(n).cast("long") + F.row_number().over(Window.orderBy("rank", "src")) - 1).alias("slot"), "src", "rank")
    before = F.col("pass") * F.col("source_size") + F.col("block") * block_words
    return (ranked.unionByName(short).join(plan, "src").where("rank < needed")
            .withColumn("pass", F.floor(F.col("rank") / F.col("blocks")))
            .withColumn("block", F.col("rank") - F.col("pass") * F.col("blocks"))
            .withColumn("words", F.least(F.lit(block_words).cast("long"), F.col("goal") - before))
            .select("slot", "src", "rank", "pass", "block", "words"))


def mixed_words(docs: DataFrame, **kw) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken (words, repeats counted)."""
    takes, rows, recipe = mix(docs, **kw)
    taken = takes.groupBy("row").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    return (rows.join(taken, "row", "left").join(recipe.select("src", "source_size", "target"), "src")
            .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken")))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **kw) -> DataFrame:
    """``docs`` repeated as the mix takes them: whole documents, each 0, 1 or 2 times; all columns.

    A source's blocks follow its shuffled stream, so what the last pass takes ends at one
    document. That document's order key is the source's cut: a text stays where it is and
    compares its own key with the cut of its source (one row per source). Rows are ordered by
    id and text, rows without an id by text alone; only rows that repeat both are taken together.
    """
    takes, rows, recipe = mix(docs, id_col, text_col, source_col, **kw)
    per_doc = takes.groupBy("row", "src").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken")) \
        .join(rows.select("row", "size", "order", "doc_id", "digest"), "row") \
        .withColumn("times", F.floor(F.col("taken") / F.col("size") + 0.5))
    # The id as it is: ties are ordered as in the stream.
    key = F.struct("order", "doc_id", "digest")
    cuts = per_doc.groupBy("src").agg(*[F.max(F.when(F.col("times") >= k, key)).alias(f"_cut{k}") for k in range(1, PASSES + 1)])
    cuts = recipe.join(cuts, "src").select(F.col("source").alias("_source"), *[f"_cut{k}" for k in range(1, PASSES + 1)])
    own_digest = _digest(F.col(f"_doc.`{text_col}`"))
    own = F.struct(_order(F.col("_id"), own_digest).alias("order"), F.col("_id").alias("doc_id"), own_digest.alias("digest"))
    times = sum((F.when(own <= F.col(f"_cut{k}"), 1).otherwise(0) for k in range(2, PASSES + 1)), F.when(own <= F.col("_cut1"), 1).otherwise(0))
    return (whole_rows(docs, _id=id_col, _of=source_col).join(cuts, F.col("_of").eqNullSafe(F.col("_source")))
            .withColumn("_times", F.when(F.coalesce(F.col(f"_doc.`{text_col}`").rlike(WORD), F.lit(False)), times).otherwise(0))
            .where("_times > 0").select("_doc", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_doc.*"))
