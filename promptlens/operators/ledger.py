"""Ledger filters, searches, top-k, projections, dedup and retention.

Filters are plain Catalyst predicates, so on a Parquet ledger they reach the
scan (``PushedFilters``) and prune ``event_date`` partitions. Top-k uses
``orderBy().limit()`` which plans as TakeOrderedAndProject (per-task heaps,
no global sort). Ties in every ordering are broken by ``id``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptlens.functions import rules as R
from promptlens.functions.text import VIEW_CHARS, VIEW_SUFFIX, literal_search, sqlite_like_search
from promptlens.operators.bits import bit_filter, maybe_in
from promptlens.operators.references import IS_TEXT, stored_apart, texts_apart, with_texts
from promptlens.schemas import LEDGER_COLUMNS, LEDGER_PARTITION, PAYLOAD_COLUMNS
from promptlens.session import FREES_SHUFFLES, remove_path, scratch_path, settings

# Bounds of the events listing (reference: 1..500, default 50).
MIN_LIMIT, MAX_LIMIT, DEFAULT_LIMIT = 1, 500, 50
# Retention's cut-off: cells of a histogram, and the rows up to which the last cell is ordered.
CUT_CELLS, CUT_ROWS = 1024, 10_000
# A row's digest, and the rows that are ranked at once.
DIGEST, RANKED = "__digest", 1 << 23


def _no_filter(status: str | None) -> bool:
    return status is None or status == "" or status == "ALL"


def ledger_by_status(ledger: DataFrame, status: str | None = "ALL") -> DataFrame:
    return ledger if _no_filter(status) else ledger.filter(F.col("status") == F.lit(status))


def ledger_search(ledger: DataFrame, search: str | None) -> DataFrame:
    """``snippet LIKE %s% OR full_payload LIKE %s%`` with SQLite LIKE semantics."""
    if not search:
        return ledger
    return ledger.filter(sqlite_like_search(F.col("snippet"), search)
                         | sqlite_like_search(F.col("full_payload"), search))


def ledger_search_literal(ledger: DataFrame, search: str | None, status: str | None = "ALL") -> DataFrame:
    """Dashboard filter: status, then case-insensitive literal substring in payload or snippet."""
    out = ledger_by_status(ledger, status)
    if not search:
        return out
    return out.filter(literal_search(F.coalesce(F.col("full_payload"), F.lit("")), search)
                      | literal_search(F.coalesce(F.col("snippet"), F.lit("")), search))


def _check_limit(limit: int) -> int:
    if not (MIN_LIMIT <= int(limit) <= MAX_LIMIT):
        raise ValueError(f"limit must be within {MIN_LIMIT}..{MAX_LIMIT}")
    return int(limit)


def ledger_recent(ledger: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Newest first by unix_ts (ties by id), ``limit`` rows (top-k heap)."""
    return ledger.orderBy(F.col("unix_ts").desc(), F.col("id").asc()).limit(_check_limit(limit))


def ledger_query(ledger: DataFrame, limit: int = DEFAULT_LIMIT, status: str | None = "ALL",
                 search: str | None = None) -> DataFrame:
    """The events listing: status filter AND search, newest ``limit``."""
    return ledger_recent(ledger_search(ledger_by_status(ledger, status), search), limit)


def event_lookup(ledger: DataFrame, event_id: str) -> DataFrame:
    return ledger.filter(F.col("id") == F.lit(event_id))


def sanitized_diff(ledger: DataFrame) -> DataFrame:
    """Events whose sanitized payload is non-empty and differs from the original."""
    return (ledger.filter((F.col("sanitized_payload") != F.lit(""))
                          & (F.col("sanitized_payload") != F.col("full_payload")))
                  .select("id", "full_payload", "sanitized_payload",
                          F.regexp_count(F.col("sanitized_payload"), F.lit(r"\[REDACTED\]"))
                           .cast("int").alias("redaction_marks")))


def ledger_view(ledger: DataFrame) -> DataFrame:
    """Table rows of the dashboard; the payload cut at 70 code points plus an ellipsis."""
    payload = F.coalesce(F.col("full_payload"), F.lit(""))
    return ledger.select(
        "id", "timestamp", "status", F.coalesce(F.col("severity"), F.lit("—")).alias("severity"),
        "latency_ms", "tokens_masked", "payload_bytes", "matched_rule",
        F.when(F.length(payload) > VIEW_CHARS, F.concat(F.substring(payload, 1, VIEW_CHARS), F.lit(VIEW_SUFFIX)))
         .otherwise(payload).alias("payload_view"),
        (F.length(payload) > VIEW_CHARS).alias("has_more"))


def ledger_dedup(ledger: DataFrame) -> DataFrame:
    """First write wins per id (``id`` is the primary key); equal times go by the row's digest.

    Ids are counted alone. Where most ids come once, the rows that may be others, found by a
    bit filter of bounded size, are ranked by ``first_writes``, and the rest never move. Else
    every row is: the two ways are a choice of plan, not of result.
    """
    spark, columns = ledger.sparkSession, ledger.columns
    counts = ledger.groupBy("id").agg(F.count(F.lit(1)).alias("__n"))
    with settings(spark, {FREES_SHUFFLES: "true"}):
        n, repeated = counts.agg(F.sum("__n"), F.sum(F.when(F.col("__n") > 1, F.col("__n")))).first()
    if not repeated:
        return ledger
    if 2 * repeated > n:
        return with_texts(*first_writes(ledger)).select(*columns)
    keys = counts.filter(F.col("__n") > 1).select(F.coalesce("id", F.lit("")).alias("__id"))
    marked = maybe_in(ledger.withColumn("__id", F.coalesce("id", F.lit(""))), "__id", bit_filter(keys, "__id"), "__maybe").drop("__id")
    ranked = with_texts(*first_writes(marked.filter("__maybe").select(*columns)))
    return marked.filter("not __maybe").select(*columns).unionByName(ranked.select(*columns))


def row_digest(ledger: DataFrame) -> Column:
    return F.xxhash64(*[F.col(c) for c in ledger.columns if c != "id"]).alias(DIGEST)


def first_of_ids(rows: DataFrame) -> DataFrame:
    """The first row per id by (time, digest). Each task keeps one row per id before anything is shuffled."""
    first = Window.partitionBy("id").orderBy("unix_ts", DIGEST)
    return rows.withColumn("__rank", F.row_number().over(first)).filter(F.col("__rank") == 1).drop("__rank", DIGEST)


def in_parts(rows: DataFrame, decide: Callable[[Callable[[DataFrame], DataFrame]], DataFrame], path: str) -> DataFrame:
    """Writes what ``decide`` makes of each part of the ids to ``path``, and reads it.

    A part holds about RANKED of ``rows`` (stored ones) and takes its own ids of every table that ``decide``
    hands to the function it is given. A part's shuffle files are gone before the next one begins, so
    that their disk is bounded, for one more reading of short columns per part.
    """
    spark, parts = rows.sparkSession, rows.count() // RANKED + 1
    place = F.pmod(F.xxhash64(F.lit(parts), F.coalesce("id", F.lit(""))), F.lit(parts))
    for k in range(parts):
        made = decide(lambda df: df.filter(place == k))
        with settings(spark, {FREES_SHUFFLES: "true"}):
            made.write.mode("append").option("compression", "zstd").parquet(path)
    return spark.read.schema(made.schema).parquet(path)


def first_writes(ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first row per id, with references to its payload texts, and these (see ``by_reference``).

    Rows and texts are stored apart in one pass. The rank sorts (id, time, digest) of rows without
    payloads, part by part, so a hot id costs one short row per task and part. A payload is
    moved once, however many rows bear it.
    """
    spark, texts = ledger.sparkSession, [c for c in PAYLOAD_COLUMNS if c in ledger.columns]
    path = scratch_path(spark, "first-writes")
    rows = stored_apart(ledger.withColumn(DIGEST, row_digest(ledger)), texts, f"{path}/apart")
    first = in_parts(rows, lambda part: first_of_ids(part(rows)), f"{path}/first")
    remove_path(spark, f"{path}/apart/{IS_TEXT}=false")
    return first, texts_apart(spark, texts, f"{path}/apart")


def _newest_first(ledger: DataFrame) -> DataFrame:
    """(age, id) of every row: ages grow with time past, a null time is oldest."""
    return ledger.select(F.coalesce(-F.col("unix_ts"), F.lit(float("inf"))).alias("age"), "id")


def cut_cell(rows: DataFrame, n: int) -> tuple[DataFrame, int] | None:
    """The cell of ``rows`` (age, id) that holds the n-th in order, and its number in the cell; None if there are no n rows.

    Histograms of at most CUT_CELLS ages narrow the cell until it holds at most CUT_ROWS rows
    or one age; among rows of one age, counts by the next two bytes of the id go on. Each
    step reads the rows once and returns one bounded histogram or a single cell.
    """
    left, held, hexed = n, None, F.hex(F.encode(F.coalesce("id", F.lit("")), "UTF-8"))
    while held is None or held > CUT_ROWS:
        finite = F.when(F.col("age") < float("inf"), F.col("age"))
        lo, hi = rows.agg(F.min(finite), F.max(finite)).first()
        if lo is None or lo == hi and not rows.filter(F.col("age") == float("inf")).limit(1).count():
            break
        width = (hi - lo) / CUT_CELLS
        place = F.floor((F.col("age") - F.lit(lo)) / F.lit(width)).cast("long") if width > 0 else F.lit(0).cast("long")
        cell = F.when(finite.isNull(), CUT_CELLS).otherwise(F.least(place, F.lit(CUT_CELLS - 1)))
        counts = sorted(map(tuple, rows.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect()))
        if sum(c for _, c in counts) < left:
            return None
        for at, held in counts:
            if held >= left:
                break
            left -= held
        rows = rows.filter(cell == F.lit(at))
    if held is None and rows.count() < left:
        return None
    digits = 0
    while held is None or held > CUT_ROWS:
        digits += 4
        prefix = F.substring(hexed, 1, digits)
        counts = rows.groupBy(prefix.alias("prefix")).agg(F.count(F.lit(1)).alias("n"), F.max(F.length(hexed)).alias("longest"))
        # At most 65,536 next bytes, and the shorter ids.
        upto = counts.withColumn("upto", F.sum("n").over(Window.orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0)))
        at = upto.filter(F.col("upto") >= left).orderBy("prefix").first()
        left, held = left - (at["upto"] - at["n"]), at["n"]
        rows = rows.filter(prefix == F.lit(at["prefix"]))
        if at["longest"] <= digits:  # rows of one age and one id (or null and the empty one)
            break
    return rows, left


def prune_max_events(ledger: DataFrame, max_events: int = 500) -> DataFrame:
    """Keep the newest ``max_events`` rows by unix_ts (ties: smaller id kept).

    One cut-off for every n, found by refining histograms of times and ids until the cell
    that holds the n-th row is small. The ledger is then filtered by that cut-off;
    payloads neither move nor are sorted.
    """
    n = int(max_events)
    if n <= 0:
        return ledger.limit(0)
    found = cut_cell(_newest_first(ledger), n)
    if found is None:
        return ledger
    cell, left = found
    # Rows equal in time and id are one entry, so a cell of repeated rows is as small.
    upto = Window.orderBy("age", "id").rowsBetween(Window.unboundedPreceding, 0)
    last = cell.groupBy("age", "id").agg(F.count(F.lit(1)).alias("n")).withColumn("upto", F.sum("n").over(upto)) \
        .filter(F.col("upto") >= left).orderBy("age", "id").first()
    age, at = F.coalesce(-F.col("unix_ts"), F.lit(float("inf"))), F.lit(last["age"])
    upto = F.struct(at.cast("double").alias("age"), F.lit(last["id"]).cast("string").alias("id"))
    return ledger.filter((age < at) | (age == at) & (F.struct(age.alias("age"), "id") <= upto))


def prune_expired(ledger: DataFrame, now_unix: float, retention_days: int = 30) -> DataFrame:
    """Drop events older than the retention period (kept: unix_ts >= now - days).

    When the ledger carries the ``event_date`` partition column, the same
    bound is added on it so whole expired partitions are never listed.
    """
    cutoff = float(now_unix) - retention_days * 86400.0
    out = ledger.filter(F.col("unix_ts") >= F.lit(cutoff))
    if LEDGER_PARTITION in ledger.columns:
        first_day = F.date_sub(F.to_date(F.timestamp_seconds(F.lit(cutoff))), 1)  # any zone's text
        out = out.filter((F.col(LEDGER_PARTITION) >= first_day) | F.col(LEDGER_PARTITION).isNull())
    return out


def policy_rules_list(rules: DataFrame) -> DataFrame:
    return rules.orderBy(F.col("created_at").desc(), F.col("id").asc())


def alert_feed(ledger: DataFrame) -> DataFrame:
    """Critical blocked events (what a webhook or e-mail alert would carry)."""
    return ledger.filter((F.col("status") == F.lit(R.STATUS_BLOCKED)) & (F.col("severity") == F.lit("CRITICAL")))


def ledger_columns(df: DataFrame) -> DataFrame:
    return df.select(*LEDGER_COLUMNS)
